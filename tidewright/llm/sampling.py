"""Problem 5: a sample with given category proportions, by the cube method.

Every row gets an inclusion probability: what its target asks for over what there is, 1 at most. The flight phase
runs in every input partition: it moves the probabilities of two undecided rows of one category against each
other, a direction in which no category's expected number changes, until one of the two is decided; at the end
each category has one undecided row at most. Undecided rows merge upward, a fixed number of partitions at a time,
and fly again; the landing phase decides what the top has left by its probability. Since what a category is asked for is a whole number, the
landing has nothing to round but floating-point dust, and the residual imbalance is reported.

Defined results. A null split is `train`; a null category is no target and is not drawn. Copies and blank rows
count. Categories without a target are not drawn; targets without rows are reported. A target that asks for more
than there is takes everything and reports the shortfall. Repeated targets are read once, the larger demand
holds. Empty labels: every target that asks for a row is reported. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import label
from ..runtime import cut

FAN_IN = 16
LEVELS = 3
_FLOWN = "id long, split string, category string, pi double, part long"
_OPEN = pa.schema([("id", pa.int64()), ("split", pa.string()), ("category", pa.string()), ("pi", pa.float64())])
_EPS = 1e-9


def plan(labels: DataFrame, targets: DataFrame, fraction_of: int = 5) -> DataFrame:
    """(split, category, split_as, category_as, sample_size, available, asked, taken): the demand of every target.

    The sample of a split has one row of every `fraction_of`; a target asks for its share of that, rounded up, and
    for min_rows at least.
    """
    have = labels.groupBy("split", "category").agg(F.count(F.lit(1)).alias("available"))
    size = have.groupBy("split").agg(F.floor(F.sum("available") / fraction_of).cast("long").alias("sample_size"))
    want = targets.select(
        F.col("split").alias("split_as"), F.col("category_name").alias("category_as"), label(F.col("split"), "train").alias("split"),
        label(F.col("category_name")).alias("category"), F.col("target_share").cast("decimal(10,4)").alias("share"), F.coalesce(F.col("min_rows"), F.lit(0)).alias("least"),
    )
    want = want.groupBy("split", "category").agg(F.min("split_as").alias("split_as"), F.min("category_as").alias("category_as"), F.max("share").alias("share"), F.max("least").alias("least"))
    out = want.join(size, "split", "left").join(have, ["split", "category"], "left").na.fill({"sample_size": 0, "available": 0})
    by_share = F.coalesce(F.ceil(F.col("share") * F.col("sample_size").cast("decimal(18,0)")).cast("long"), F.lit(0))
    out = out.withColumn("asked", F.greatest(by_share, F.col("least").cast("long")))
    return out.withColumn("taken", F.least("asked", "available")).drop("share", "least")


def flight(pi: np.ndarray, group: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase, each 0 or 1 but for one row of a group at most.

    The balancing equations are the groups' totals; the vector that adds to one row of a group what it takes from
    another is in their kernel. Its two longest admissible steps are taken with probabilities that keep the
    expectation of every row.
    """
    pi, held = pi.copy(), {}
    draws = rng.random(len(pi))
    p = pi.tolist()
    for i, (g, u) in enumerate(zip(group.tolist(), draws.tolist())):
        j = held.get(g)
        if j is None:
            held[g] = i
        else:
            a, b = p[j], p[i]
            up, down = min(1 - a, b), min(a, 1 - b)  # steps of +1, -1 on j and of -1, +1 on i
            step = up if u * (up + down) < down else -down
            a, b = a + step, b - step
            p[j], p[i] = a, b
            if _EPS < b < 1 - _EPS:
                held[g] = i
            elif not _EPS < a < 1 - _EPS:
                del held[g]
    out = np.asarray(p)
    return np.where(out <= _EPS, 0.0, np.where(out >= 1 - _EPS, 1.0, out))


def _fly(t: pa.Table, part: int, seed: int, landing: bool) -> pa.Table:
    ids, split, cat, pi = (t.column(n).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(n).to_numpy() for n in ("id", "split", "category", "pi"))
    rng = np.random.default_rng([seed, part])
    order = rng.permutation(np.argsort(ids, kind="stable")) if len(ids) else np.arange(0)
    names: dict = {}
    group = np.fromiter((names.setdefault(k, len(names)) for k in zip(split[order], cat[order])), np.int64, len(ids))
    p = flight(pi[order].astype(float), group, rng)
    if landing:
        p = np.where(rng.random(len(p)) < p, 1.0, 0.0) if len(p) else p
    return pa.table({"id": ids[order].astype(np.int64), "split": pa.array(split[order], pa.string()), "category": pa.array(cat[order], pa.string()), "pi": p, "part": np.full(len(p), part, np.int64)})


def draw(labels: DataFrame, demand: DataFrame, seed: int = 7) -> DataFrame:
    """(id, split, category) of the drawn rows. labels: (id, split, category); demand: see plan()."""
    share = demand.filter("taken > 0").select("split", "category", (F.col("taken") / F.col("available")).alias("pi"))
    rows = labels.join(share, ["split", "category"])  # as many targets as sample_targets lists: small, and measured by Spark

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, left = TaskContext.get().partitionId(), None
        for k, b in enumerate(batches):  # what a batch leaves undecided flies again with the next
            t = pa.Table.from_batches([b]).cast(_OPEN)
            t = _fly(t if left is None else pa.concat_tables([left, t]), part, seed + k * 1_000_003, False)
            p = t.column("pi").to_numpy()
            open_ = (p > 0) & (p < 1)
            left = t.filter(pa.array(open_)).select(_OPEN.names).cast(_OPEN)
            yield from t.filter(pa.array(p == 1)).to_batches()
        if left is not None:
            yield from left.append_column("part", pa.array(np.full(left.num_rows, part, np.int64))).to_batches()

    def merge(last: bool):
        return lambda key, t: _fly(t, key[0].as_py(), seed, last)

    flown = cut(rows.select(F.col("id").cast("long"), "split", "category", "pi").mapInArrow(within, _FLOWN))
    done, left, bits = [flown.filter("pi = 1")], flown.filter("pi > 0 and pi < 1"), FAN_IN.bit_length() - 1
    for level in range(1, LEVELS + 1):
        last = level == LEVELS
        group = F.lit(0).cast("long") if last else F.shiftright("part", bits).cast("long")
        again = cut(left.withColumn("g", group).groupBy("g").applyInArrow(merge(last), _FLOWN))
        done.append(again.filter("pi = 1"))
        left = again.filter("pi > 0 and pi < 1")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "split", "category")


def read_labels(df: DataFrame) -> DataFrame:
    """(id, split, category) of shipment_labels, read trimmed and ignoring case."""
    return df.select("id", label(F.col("split"), "train").alias("split"), label(F.col("category_name")).alias("category"))


def sample(labels: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(id, split, category): the rows of shipment_labels that are drawn."""
    rows = read_labels(labels)
    return draw(rows, cut(plan(rows, targets)), seed)


def report(labels: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """For every target: sample_size, available, asked, drawn, shortfall, and residual, what drawing is off the possible."""
    rows = read_labels(labels)
    demand = cut(plan(rows, targets))
    got = draw(rows, demand, seed).groupBy("split", "category").agg(F.count(F.lit(1)).alias("drawn"))
    out = demand.join(got, ["split", "category"], "left").na.fill({"drawn": 0})
    return out.select(
        F.col("split_as").alias("split"), F.col("category_as").alias("category_name"), "sample_size", "available", "asked", "drawn",
        F.greatest(F.col("asked") - F.col("available"), F.lit(0)).alias("shortfall"), (F.col("drawn") - F.col("taken")).alias("residual"),
    )


def unmet(reported: DataFrame) -> DataFrame:
    """(split, category_name) of the targets whose drawn rows fall short for want of rows."""
    return reported.filter("shortfall > 0 and drawn < asked").select("split", "category_name").distinct()
