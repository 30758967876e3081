"""Problem 6: filling containers of fixed capacity.

Best-fit decreasing runs inside every input partition, without a shuffle. Dual-feasible functions give a lower
bound on the bins that a partition's items need; a partition whose bins equal its bound is certified and keeps
them, save its emptiest bin. Partitions with a gap give up their emptiest bins as well. What is given up is
exchanged among ever larger groups of partitions and packed again, until one group is left; that group holds a
bounded number of bins for each partition it comes from.

Defined results. Null, empty and blank texts have no tokens and are put in no container. A text longer than the
capacity is cut into full pieces, each a container of its own, and one remainder that is packed like any other;
no other text is cut. Equal sizes are taken in order of id. Repeated ids are packed as items of their own. Empty
table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD
from ..runtime import cut

CAPACITY = 1024
#: Partitions that exchange bins at the first level; each level after it has as many times more.
FAN_IN = 16
LEVELS = 3
#: Bins that are given up for each bin of gap, and by every partition.
GIVE_PER_GAP, GIVE_ALWAYS = 4, 1
_PACKED = "doc_id long, piece int, tokens int, part long, bin long, fill int, given boolean, bins long, bound long"


def word_tokens(text: Column) -> Column:
    """Tokens of text: runs of letters, digits or underscores, and runs of other characters without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"[{WORD}]+|[^{WORD}{SPACE}]+")), F.lit(0))


def tokenizer_sizes(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens) by a public tokenizer file, which every executor reads once for each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores, not threads
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], ["doc_id", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(count, "doc_id long, tokens int")


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens) by word_tokens."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), word_tokens(F.col(text_col)).cast("int").alias("tokens"))


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Bins that items of these sizes need at least: the largest bound that a family of dual-feasible functions gives.

    Beside the volume, for each k up to half the capacity: items over capacity - k count as a whole bin, items
    under k as nothing, the rest by volume; and, for a few k, the rounding function x -> floor((k + 1) x) / k.
    counts: how many items there are of each size, one by default.
    """
    if not len(sizes):
        return 0
    o = np.argsort(sizes, kind="stable")
    s = sizes[o].astype(np.int64)
    c = np.ones(len(s), np.int64) if counts is None else counts[o].astype(np.int64)
    total, many = np.concatenate([[0], np.cumsum(s * c)]), np.concatenate([[0], np.cumsum(c)])
    best = -(-int(total[-1]) // capacity)
    ks = np.unique(np.concatenate([s[s <= capacity // 2], [1]]))
    low, high = np.searchsorted(s, ks, "left"), np.searchsorted(s, capacity - ks, "right")
    high = np.maximum(high, low)
    volume = (many[-1] - many[high]) * capacity + total[high] - total[low]
    best = max(best, int(-(-volume.max() // capacity)))
    for k in range(1, 21):
        up = (k + 1) * s
        f = np.where(up % capacity == 0, s * k, up // capacity * capacity)  # scaled by k * capacity
        best = max(best, int(-(-int((f * c).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, order: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and the fill of each bin. order: the items, largest first.

    The open bins are kept by their free space, and a bit set of the spaces that occur finds the tightest in a
    few machine operations.
    """
    where, fill = np.empty(len(sizes), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for i in order.tolist():
        s = int(sizes[i])
        rest = bits >> s
        if rest:
            space = s + (rest & -rest).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                bits ^= 1 << space
            fill[b] += s
        else:
            space, b = capacity, len(fill)
            fill.append(s)
        where[i] = b
        if left := space - s:
            free[left].append(b)
            bits |= 1 << left
    return where, np.asarray(fill, np.int64)


def _pack(ids: np.ndarray, pieces: np.ndarray, sizes: np.ndarray, part: int, capacity: int, last: bool) -> pa.RecordBatch:
    order = np.lexsort((pieces, ids, -sizes))
    where, fill = best_fit_decreasing(sizes, order, capacity)
    bound = lower_bound(sizes, capacity)
    given = np.zeros(len(fill), bool)
    if not last and len(fill):
        give = min(len(fill), GIVE_ALWAYS + GIVE_PER_GAP * (len(fill) - bound))
        emptiest = np.argsort(fill, kind="stable")[:give]
        given[emptiest[fill[emptiest] < capacity]] = True
    n = len(sizes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(sizes, pa.int32()), pa.array(np.full(n, part, np.int64)), pa.array(where),
            pa.array(fill[where], pa.int32()), pa.array(given[where]), pa.array(np.full(n, len(fill), np.int64)), pa.array(np.full(n, bound, np.int64)),
        ],
        ["doc_id", "piece", "tokens", "part", "bin", "fill", "given", "bins", "bound"],
    )


def _cols(t: pa.RecordBatch | pa.Table, names: tuple[str, ...]) -> list[np.ndarray]:
    return [t.column(n).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(n).to_numpy() for n in names]


def pack(sizes: DataFrame, capacity: int = CAPACITY, chunk: int = 500_000) -> DataFrame:
    """(container_id, doc_id, piece, tokens, fill, cut, level, part, bins, bound): every piece of every document and its container.

    level and part name the partition that packed it last, bins and bound the bins that this partition's items took and
    the least that they need; a full piece of a longer text is a container of its own and has none.
    sizes: (doc_id, tokens). chunk: items that a task packs at a time, which bounds its memory; a partition with
    more is packed chunk by chunk.
    """

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, rows, k = TaskContext.get().partitionId(), [], 0, 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk:
                yield _pack(*_cols(pa.Table.from_batches(held), ("doc_id", "piece", "tokens")), part | k << 32, capacity, False)
                held, rows, k = [], 0, k + 1
        if rows:
            yield _pack(*_cols(pa.Table.from_batches(held), ("doc_id", "piece", "tokens")), part | k << 32, capacity, False)

    def exchange(last: bool):
        def again(key: tuple, t: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_pack(*_cols(t, ("doc_id", "piece", "tokens")), key[0].as_py(), capacity, last)])

        return again

    items = cut(sizes.select("doc_id", "tokens").filter("tokens > 0")).withColumns({"full": F.expr(f"tokens div {capacity}"), "rest": F.col("tokens") % capacity})
    whole = items.filter("full > 0").withColumn("piece", F.explode(F.expr("sequence(0, cast(full as int) - 1)")))
    whole = whole.select(
        F.concat_ws("-", F.lit("w"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", F.lit(capacity).alias("tokens"), F.lit(capacity).alias("fill"), (F.col("tokens") > capacity).alias("cut"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("part", "long"), ("bins", "long"), ("bound", "long"))),
    )
    rest = items.filter("rest > 0").select("doc_id", F.col("full").cast("int").alias("piece"), F.col("rest").cast("int").alias("tokens"))
    packed = cut(rest.mapInArrow(within, _PACKED))
    kept, given, bits = [packed.filter("not given").withColumn("level", F.lit(0))], packed.filter("given"), FAN_IN.bit_length() - 1
    for level in range(1, LEVELS + 1):
        last = level == LEVELS
        group = F.lit(0).cast("long") if last else F.shiftright(F.col("part").bitwiseAND((1 << 32) - 1), bits).cast("long")
        again = cut(given.withColumn("g", group).groupBy("g").applyInArrow(exchange(last), _PACKED))
        kept.append(again.filter("not given").withColumn("level", F.lit(level)))
        given = again.filter("given")
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return whole.unionByName(
        out.select(F.concat_ws("-", "level", "part", "bin").alias("container_id"), "doc_id", "piece", "tokens", "fill", (F.col("piece") > 0).alias("cut"), "level", "part", "bins", "bound")
    )


def certificates(packed: DataFrame) -> DataFrame:
    """(level, part, bins, bound, certified): what every partition packed, and whether it is proven to be the least."""
    rows = packed.filter("part is not null").groupBy("level", "part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
    return rows.withColumn("certified", F.col("bins") == F.col("bound"))


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, bound, gap and unused, the share of space that is left unused.

    bound: containers that all items together need at least, by the same functions; it takes how many items there are
    of each size, `capacity` numbers at most.
    """
    sizes = packed.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    bound = lower_bound(np.array([r["tokens"] for r in sizes], np.int64), capacity, np.array([r["n"] for r in sizes], np.int64))
    total = packed.agg(F.countDistinct("container_id").alias("containers"), F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return total.withColumns(
        {
            "bound": F.lit(bound).cast("long"),
            "gap": F.col("containers") - F.lit(bound),
            "unused": F.when(F.col("containers") > 0, F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6)).otherwise(0.0),
        }
    )


def longer_than_container(packed: DataFrame) -> DataFrame:
    """(doc_id) of the documents that were cut."""
    return packed.filter("cut").select("doc_id").distinct()
