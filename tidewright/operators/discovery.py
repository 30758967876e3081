"""Density clustering of what no category claims, and a hint at the nearest category.

HDBSCAN after Campello, Moulavi and Sander (2013). Conventions: the core distance is the distance to the
min_samples-th other point; the root is no cluster; excess of mass selects; label -1 is noise. Distances between all
points are computed in blocks on the executors, again in each Boruvka round; points are limited to MOST_POINTS,
above which the vectors no longer fit an executor, and the operator refuses instead of dropping rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label
from ..functions.vectors import is_usable, rows_of, unit_rows
from ..runtime import cut
from .dimensions import Model

MOST_POINTS = 200_000
VARIANT = 0.80


def unclassified_vectors(classifications: DataFrame, dim: int = 384) -> DataFrame:
    """(shipment_id, embedding) of the unclassified rows with a usable embedding."""
    state = label(F.col("confidence_state"), "classified")
    return classifications.filter((state == "unclassified") & is_usable(F.col("embedding"), dim)).select("shipment_id", "embedding")


def _points(rows: DataFrame, dim: int):
    got = rows.select(F.col("id").cast("string"), F.col("v").cast("array<float>")).limit(MOST_POINTS + 1).toArrow()
    if got.num_rows > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points")
    ids = np.array(got.column(0).to_pylist(), object)
    x = unit_rows(rows_of(got.column(1).combine_chunks(), dim)) if got.num_rows else np.zeros((0, dim))
    o = np.argsort(ids.astype(str), kind="stable")
    return ids[o], x[o]


def _blocks(spark, n: int, size: int = 256) -> DataFrame:
    """(lo, hi) row ranges, spread over the executors."""
    k = max(1, -(-n // size))
    return spark.range(0, k, 1, min(k, 4 * spark.sparkContext.defaultParallelism)).select((F.col("id") * size).alias("lo"), F.least((F.col("id") + 1) * size, F.lit(n)).alias("hi"))


def _distances(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x[lo:hi] @ x.T), 0))


def core_distance(rows: DataFrame, min_samples: int = 5, dim: int = 384) -> DataFrame:
    """(id, core): distance of each unit vector to its min_samples-th other. rows: (id, v)."""
    ids, x = _points(rows, dim)
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, y = shared.value
        for b in batches:
            for lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                d = _distances(y, lo, hi)
                d[np.arange(hi - lo), np.arange(lo, hi)] = np.inf
                core = np.partition(d, min_samples - 1, axis=1)[:, min_samples - 1] if len(y) > min_samples else np.full(hi - lo, np.inf)
                yield pa.RecordBatch.from_pydict({"id": pa.array(names[lo:hi].tolist(), pa.string()), "core": core})

    return _blocks(rows.sparkSession, len(ids)).mapInArrow(run, "id string, core double")


def mutual_reachability(rows: DataFrame, min_samples: int = 5, dim: int = 384) -> DataFrame:
    """(id, nearest, reach): for each point the smallest max(core, core, distance) to another, and the first id that has it."""
    ids, x = _points(rows, dim)
    core = {r["id"]: r["core"] for r in core_distance(rows, min_samples, dim).collect()}  # one number a point, MOST_POINTS at most
    c = np.array([core[i] for i in ids])
    shared = rows.sparkSession.sparkContext.broadcast((ids, x, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, y, k = shared.value
        for b in batches:
            for lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                d = np.maximum(np.maximum(_distances(y, lo, hi), k[None]), k[lo:hi, None])
                d[np.arange(hi - lo), np.arange(lo, hi)] = np.inf
                d = np.round(d, 6)
                j = d.argmin(axis=1)
                yield pa.RecordBatch.from_pydict({"id": pa.array(names[lo:hi].tolist(), pa.string()), "nearest": pa.array(names[j].tolist(), pa.string()), "reach": d[np.arange(hi - lo), j]})

    return _blocks(rows.sparkSession, len(ids)).mapInArrow(run, "id string, nearest string, reach double") if len(ids) > 1 else rows.sparkSession.createDataFrame([], "id string, nearest string, reach double")


def spanning_tree(rows: DataFrame, ids: np.ndarray, x: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of a minimum spanning tree of the mutual reachability graph, by Boruvka rounds."""
    n, comp, edges = len(ids), np.arange(len(ids)), []
    shared = rows.sparkSession.sparkContext.broadcast((x, core))
    while len(edges) < n - 1:

        def run(batches: Iterator[pa.RecordBatch], comp=comp) -> Iterator[pa.RecordBatch]:
            y, k = shared.value
            best: dict[int, tuple] = {}
            for b in batches:
                for lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    d = np.maximum(np.maximum(_distances(y, lo, hi), k[None]), k[lo:hi, None])
                    d[comp[lo:hi, None] == comp[None]] = np.inf
                    j = d.argmin(axis=1)
                    for i, jj, dd in zip(range(lo, hi), j.tolist(), d[np.arange(hi - lo), j].tolist()):
                        e = (dd, min(i, jj), max(i, jj))
                        if comp[i] not in best or e < best[comp[i]]:
                            best[int(comp[i])] = e
            yield pa.RecordBatch.from_pydict({"c": list(best), "d": [e[0] for e in best.values()], "i": [e[1] for e in best.values()], "j": [e[2] for e in best.values()]})

        found = _blocks(rows.sparkSession, n).mapInArrow(run, "c long, d double, i long, j long").groupBy("c").agg(F.min(F.struct("d", "i", "j")).alias("e")).select("e.*").collect()
        before = len(edges)
        for d, i, j in sorted((r["d"], r["i"], r["j"]) for r in found):
            if comp[i] != comp[j]:
                edges.append((d, i, j))
                comp = np.where(comp == comp[j], comp[i], comp)
        if len(edges) == before:
            raise AssertionError("the graph is complete, so every round must join components")
    return sorted(edges)


def condense(edges: list[tuple[float, int, int]], n: int, min_cluster_size: int) -> np.ndarray:
    """Labels from the tree's edges: single linkage, condensed at min_cluster_size, selected by excess of mass."""
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    left, right, height = [0] * (2 * n - 1), [0] * (2 * n - 1), [0.0] * (2 * n - 1)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (d, i, j) in enumerate(edges):
        a, b, new = root(i), root(j), n + k
        left[new], right[new], height[new], size[new] = a, b, d, size[a] + size[b]
        parent[a] = parent[b] = new
    labels = np.full(n, -1, np.int64)
    if n < 2 or n < min_cluster_size:
        return labels

    def leaves(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += [left[v], right[v]]
        return out

    inverse = lambda d: 1 / d if d > 0 else np.inf
    kids: dict[int, list[int]] = {0: []}
    born, stability, members = {0: 0.0}, {0: 0.0}, {0: 2 * n - 2}
    todo, next_id = [(2 * n - 2, 0)], 1
    while todo:
        v, c = todo.pop()
        while v >= n:
            level = min(inverse(height[v]), 1e12)
            a, b = left[v], right[v]
            big = [s for s in (a, b) if size[s] >= min_cluster_size]
            if len(big) == 2:
                stability[c] += size[v] * (level - born[c])
                for s in big:
                    kids[c].append(next_id)
                    kids[next_id], born[next_id], stability[next_id], members[next_id] = [], level, 0.0, s
                    todo.append((s, next_id))
                    next_id += 1
                break
            if not big:
                stability[c] += size[v] * (level - born[c])
                break
            small = b if big[0] == a else a
            stability[c] += size[small] * (level - born[c])
            v = big[0]
    chosen, value = {}, {}
    for c in sorted(kids, reverse=True):
        below = sum(value[k] for k in kids[c])
        if c and (not kids[c] or stability[c] >= below):
            value[c], chosen[c] = stability[c], True
        else:
            value[c], chosen[c] = below, False
    todo, picked = [0], []
    while todo:
        c = todo.pop()
        if chosen[c]:
            picked.append(c)
        else:
            todo += kids[c]
    groups = sorted((sorted(leaves(members[c])) for c in picked), key=lambda g: g[0])
    for k, g in enumerate(groups):
        labels[g] = k
    return labels


def hdbscan(rows: DataFrame, min_cluster_size: int = 50, min_samples: int = 5, dim: int = 384) -> DataFrame:
    """(id, cluster): clusters numbered by their smallest id, -1 for noise; with fewer points than a cluster needs, all are noise."""
    spark = rows.sparkSession
    rows = cut(rows)
    ids, x = _points(rows, dim)
    if len(ids) < max(min_cluster_size, min_samples + 1, 2):
        return rows.select(F.col("id").cast("string").alias("id"), F.lit(-1).cast("long").alias("cluster"))
    core = {r["id"]: r["core"] for r in core_distance(rows, min_samples, dim).collect()}
    edges = spanning_tree(rows, ids, x, np.array([core[i] for i in ids]))
    labels = condense(edges, len(ids), min_cluster_size)
    return spark.createDataFrame(pa.table({"id": pa.array(ids.tolist(), pa.string()), "cluster": labels}))


def cluster_summary(members: DataFrame, first: int = 10) -> DataFrame:
    """(cluster, size, sample_ids) of each cluster, noise as -1. members: (id, cluster).

    The sample ids come from a ranked window, so a cluster's ids are never gathered whole.
    """
    r = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    some = members.withColumn("r", r).filter(F.col("r") <= first).groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("sample_ids"))
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(some, "cluster")


def cluster_hint(centroids: DataFrame, model: Model, key: str) -> DataFrame:
    """(key, nearest, similarity, is_variant): the category whose centroid is nearest to each cluster's; no rows without categories."""
    if not model.names:
        return centroids.select(key, F.lit("").alias("nearest"), F.lit(0.0).alias("similarity"), F.lit(False).alias("is_variant")).limit(0)
    from .scoring import with_semantic

    s = with_semantic(centroids.select(key, "centroid").withColumnRenamed("centroid", "_c"), model, "_c", model.matrix.shape[1])
    names = F.array(*(F.lit(n) for n in model.names))
    best = F.array_max("semantic")
    s = s.withColumn("nearest", F.element_at(names, F.array_position("semantic", best).cast("int"))).withColumn("similarity", F.round(best, 3))
    return s.select(key, "nearest", "similarity", (F.col("similarity") > VARIANT).alias("is_variant"))
