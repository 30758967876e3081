"""Problem 2: clusters of mutually similar records, by bisecting k-means.

The tree of nodes is grown in passes over the rows. A pass sends every row down the tree to its node and, for all
nodes that still have to be split, sums the rows by the nearer of two tentative centres; only these sums leave the
executors, one for each open node and partition. A node is done when it is compact, that is when `COMPACT` of its
rows lie within `RADIUS` of its mean direction, or when it has no more than `LOCAL` rows; nodes of the second kind
are finished each in one task, where the node of the largest dispersion is split next until all are compact or too
small; all its rows are compared there too, since splits leave pieces of a small group that are too small to be seen.
A split may cut a group in two, so the centres of all compact leaves are made again from every row near
them, and centres that become one are merged; the tree is grown again over the rows that no centre is near to,
until nothing new is found. Every row goes to the nearest centre that is near enough; the rest
and what is left of clusters under `min_size` is noise.

Defined results. Rows with an unusable vector (see neighbours) take no part. Repeated rows are members like any
other; a repeated id is listed once for each cluster it is in. cluster_id is the smallest id. At equal similarity
the smaller id is the more typical. Empty table, or no dense group: no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .neighbours import DIM, matrix, unit, usable

#: Cosine to the mean direction that members of a compact node have, and the share of rows that must have it.
RADIUS, COMPACT = 0.60, 0.90
#: Cosine between rows from which they are taken for rows of one cluster when all pairs of a node are compared; looser clusters are left to the splits.
PAIR = 0.45
#: Rows that a node may have to be finished in one task.
LOCAL = 4096
#: Least rows of a leaf that may be part of a cluster.
LEAST = 4
#: Cosine between a row and a centre from which the row belongs to it, and between centres that are one.
NEAR, SAME = 0.525, 0.80
LLOYD = 3
#: Tasks that nodes are finished in, at least, when they may have more rows than `LOCAL`; and the rows that they may have at most.
TASKS, MOST_LOCAL = 16, 32768
#: Cosines, and centres to be merged, that are in memory at a time.
AT_ONCE, MERGED_AT_ONCE = 1 << 23, 1024


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A column of the bytes of vectors as a matrix, without a copy."""
    _, ends, data = col.buffers()
    if not len(col) or data is None:
        return np.zeros((0, dim), np.float32)
    ends = np.frombuffer(ends, np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(-1, dim)


def _vectors(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return _matrix(b.column("v"), dim)


def _to_units(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = matrix(b.column(1), dim), b.column(0)
            good = np.isfinite(x).all(axis=1)
            x = unit(x[good])
            yield pa.RecordBatch.from_pydict({"id": ids.filter(pa.array(good)), "v": pa.array([r.tobytes() for r in x], pa.binary())})

    return run


def _direction(s: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(s, axis=-1, keepdims=True)
    return (s / np.where(n > 0, n, 1)).astype(np.float32)


class Tree:
    """Inner nodes hold two centres; a row goes to the nearer one."""

    def __init__(self) -> None:
        self.children: dict[int, tuple[int, int]] = {}
        self.centres: dict[int, np.ndarray] = {}

    def route(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node in self.children and len(rows):
                side = np.argmax(x[rows] @ self.centres[node].T, axis=1)
                for k, child in enumerate(self.children[node]):
                    todo.append((child, rows[side == k]))
            else:
                at[rows] = node
        return at


def _pass(tree: Tree, trial: dict[int, np.ndarray], mean: dict[int, np.ndarray], dim: int):
    """Sums of the open nodes' rows by the nearer trial centre: (node, side, n, within, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            x = _vectors(b, dim)
            at = tree.route(x)
            for node in np.unique(at).tolist():
                if node not in trial:
                    continue
                rows = x[at == node]
                side = np.argmax(rows @ trial[node].T, axis=1)
                near = rows @ mean[node] >= RADIUS if node in mean else np.zeros(len(rows), bool)
                for k in (0, 1):
                    t = total.setdefault((node, k), [0, 0, np.zeros(dim)])
                    t[0] += int((side == k).sum())
                    t[1] += int(near[side == k].sum())
                    t[2] += rows[side == k].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_pydict(
                {"node": [k[0] for k in total], "side": [k[1] for k in total], "n": [t[0] for t in total.values()], "within": [t[1] for t in total.values()], "s": pa.array([t[2].tobytes() for t in total.values()], pa.binary())}
            )

    return run


def _add(key: tuple, t: pa.Table) -> pa.Table:
    s = np.frombuffer(b"".join(t.column("s").to_pylist())).reshape(t.num_rows, -1).sum(axis=0)
    n, w = (int(np.sum(t.column(c).to_numpy())) for c in ("n", "within"))
    return pa.table({"node": [key[0].as_py()], "side": [key[1].as_py()], "n": [n], "within": [w], "s": pa.array([s.tobytes()], pa.binary())})


_SUMS = "node long, side long, n long, within long, s binary"
_SUM = "node long, n long, s binary"


def grow(rows: DataFrame, dim: int, local: int, seed: int = 3) -> tuple[Tree, list[np.ndarray]]:
    """The tree down to nodes of at most `local` rows, and the centres of the compact nodes that are larger."""
    rng, tree, done, next_id = np.random.default_rng(seed), Tree(), [], 1

    def trial_of() -> np.ndarray:
        r = _direction(rng.standard_normal(dim))
        return np.stack([r, -r])

    trial, mean, size, stage = {0: trial_of()}, {}, {}, 0
    while trial:
        sums = rows.mapInArrow(_pass(tree, trial, mean, dim), _SUMS).groupBy("node", "side").applyInArrow(_add, _SUMS).collect()  # two sums for each node that is larger than `local`
        got = {(r["node"], r["side"]): (r["n"], r["within"], np.frombuffer(r["s"])) for r in sums}
        zero, closing = (0, 0, np.zeros(dim)), stage >= LLOYD
        after: dict[int, np.ndarray] = {}
        for node in trial:
            a, b = got.get((node, 0), zero), got.get((node, 1), zero)
            n = a[0] + b[0]
            if n == 0:
                continue
            compact = stage > 0 and node in mean and a[1] + b[1] >= COMPACT * n
            if n <= local:
                continue
            if closing and not compact and min(a[0], b[0]) == 0:  # rows that are apart, but not in this direction: another one
                size[node] = n
                continue
            if compact:
                done.append(_direction(a[2] + b[2]))
                tree.children.setdefault(node, (-1, -1))
                tree.centres[node] = np.stack([_direction(a[2] + b[2])] * 2)
                continue
            mean[node] = _direction(a[2] + b[2])
            if not closing:
                # a side without rows starts again from a direction of its own
                after[node] = np.stack([_direction(s[2]) if s[0] else trial_of()[0] for s in (a, b)])
                continue
            tree.children[node], tree.centres[node] = (next_id, next_id + 1), trial[node]
            for k, s in enumerate((a, b)):
                if s[0] > local:
                    size[next_id + k] = s[0]
            next_id += 2
        if closing:
            trial, stage = {c: trial_of() for c in size}, 0
            mean, size = {}, {}
        else:
            trial, stage = after, stage + 1
    return tree, done


def bisect(x: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """Centres of the compact leaves among the unit vectors x; the node of the largest dispersion is split next."""
    out, heap, k = [], [], 0

    def push(rows: np.ndarray) -> None:
        nonlocal k
        if len(rows) < least:
            return
        s = x[rows].sum(axis=0, dtype=np.float64)
        c = _direction(s)
        near = x[rows] @ c >= RADIUS
        if near.mean() >= COMPACT:
            out.append(_direction(x[rows[near]].sum(axis=0, dtype=np.float64)))
            return
        heapq.heappush(heap, (float(np.linalg.norm(s)) - len(rows), k, rows, c))
        k += 1

    push(np.arange(len(x)))
    while heap:
        _, _, rows, c = heapq.heappop(heap)
        y = x[rows]
        first = int(np.argmin(y @ c))
        two = np.stack([y[first], y[int(np.argmin(y @ y[first]))]])
        side = np.zeros(len(y), np.int64)
        for _ in range(8):
            new = np.argmax(y @ two.T, axis=1)
            if (new == side).all() and 0 < side.sum() < len(y):
                break
            side = new
            if not 0 < side.sum() < len(y):
                break
            two = np.stack([_direction(y[side == j].sum(axis=0, dtype=np.float64)) for j in (0, 1)])
        if not 0 < side.sum() < len(y):  # no two centres part these rows: the half that is nearer to the first
            side = (np.argsort(np.argsort(-(y @ y[first]), kind="stable"), kind="stable") >= len(y) // 2).astype(np.int64)
        push(rows[side == 0])
        push(rows[side == 1])
    return out


def dense(x: np.ndarray, least: int = LEAST) -> list[np.ndarray]:
    """Centres of the groups of at least `least` of the unit vectors x, found by comparing all of them.

    A split that goes through a small group leaves pieces too small to be seen; here only the splits above this node do.
    """
    out, taken = [], np.zeros(len(x), bool)
    for lo, c in _cosines(x, x):
        near = c >= PAIR
        for i in np.flatnonzero(near.sum(axis=1) >= least).tolist():
            if taken[lo + i]:
                continue
            y = x[near[i]]
            d = _direction(y.sum(axis=0, dtype=np.float64))
            if (y @ d >= RADIUS).sum() < least:
                continue
            member = x @ d >= RADIUS
            out.append(_direction(x[member].sum(axis=0, dtype=np.float64)))
            taken |= member
            taken[lo + i] = True
    return out


def _finish(tree: Tree, dim: int):
    def node_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = tree.route(_vectors(b, dim))
            keep = pa.array(at >= 0)
            yield pa.RecordBatch.from_pydict({"node": pa.array(at), "v": b.column("v")}).filter(keep)

    def leaves(key: tuple, t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(-1, dim)
        x = x[np.lexsort(x.T[:4])]  # the order in which rows arrive must not matter
        found = dense(x)
        have = np.array(found, np.float32).reshape(-1, dim)
        found += [c for c in bisect(x) if not len(have) or (have @ c).max() < SAME]
        return pa.table({"s": pa.array([c.tobytes() for c in found], pa.binary())})

    return node_of, leaves


def _cosines(x: np.ndarray, centres: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The cosines with all centres, of a stretch of rows at a time, of about `AT_ONCE` numbers."""
    step = max(1, AT_ONCE // max(len(centres), 1))
    for lo in range(0, len(x), step):
        yield lo, x[lo : lo + step] @ centres.T


def _near(shared, dim: int):
    """Sums of the rows that are near each centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            x = _vectors(b, dim)
            for lo, c in _cosines(x, shared.value):
                row, node = np.nonzero(c >= RADIUS - 0.05)
                _sum_by(total, node, np.ones(len(node), np.int64), x[lo + row])
        yield from _batches_of({k: [n, v.astype(np.float32)] for k, (n, v) in total.items()})  # half of what is sent

    return run


def _sum_by(total: dict[int, list], node: np.ndarray, n: np.ndarray, v: np.ndarray) -> None:
    """Adds up the numbers n and the rows of v by node."""
    o = np.argsort(node, kind="stable")
    node, n, v = node[o], n[o], v[o]
    at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else node
    for k, i, j in zip(node[at].tolist(), at.tolist(), [*at[1:].tolist(), len(node)]):
        t = total.setdefault(k, [0, 0.0])
        t[0] += int(n[i:j].sum())
        t[1] = t[1] + v[i:j].sum(axis=0, dtype=np.float64)


def _batches_of(total: dict[int, list]) -> Iterator[pa.RecordBatch]:
    nodes = list(total)
    for lo in range(0, len(nodes), 1024):
        some = nodes[lo : lo + 1024]
        yield pa.RecordBatch.from_pydict({"node": pa.array(some, pa.int64()), "n": pa.array([total[k][0] for k in some], pa.int64()), "s": pa.array([total[k][1].tobytes() for k in some], pa.binary())})


def _added(least: int, dim: int):
    """The sums of all tasks as one for each node, as directions; those of fewer than `least` rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            _sum_by(total, b.column("node").to_numpy(), b.column("n").to_numpy(), _matrix(b.column("s"), dim))
        yield from _batches_of({k: [n, _direction(v)] for k, (n, v) in total.items() if n >= least})

    return run


def merged(centres: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The centres without those that are one with a centre of more rows."""
    keep, k, order = np.empty_like(centres), 0, np.argsort(-n, kind="stable")
    for lo in range(0, len(order), MERGED_AT_ONCE):
        some = centres[order[lo : lo + MERGED_AT_ONCE]]
        if k:
            some = some[(some @ keep[:k].T).max(axis=1) < SAME]
        alike, new = some @ some.T >= SAME, np.zeros(len(some), bool)
        for i in range(len(some)):
            new[i] = not (alike[i] & new).any()
        keep[k : k + new.sum()] = some[new]
        k += int(new.sum())
    return keep[:k]


def _assign(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, sim = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.float32)
            for lo, c in _cosines(_vectors(b, dim), shared.value):
                best[lo : lo + len(c)] = at = np.argmax(c, axis=1)
                sim[lo : lo + len(c)] = c[np.arange(len(c)), at]
            keep = sim >= NEAR
            yield pa.RecordBatch.from_pydict({"id": b.column("id").filter(pa.array(keep)), "c": pa.array(best[keep]), "cosine": pa.array(np.round(sim[keep].astype(np.float64), 6))})

    return run


def _far(shared, dim: int):
    """The rows that no centre is near to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = [c.max(axis=1) < NEAR for _, c in _cosines(_vectors(b, dim), shared.value)]
            yield b.filter(pa.array(np.concatenate([*far, np.zeros(0, bool)])))

    return run


def _again(rows: DataFrame, centres: np.ndarray, size: int, dim: int) -> np.ndarray:
    """The centres made again from the rows near them, those with fewer than `size` left out, and merged."""
    if not len(centres):
        return centres
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    sums = rows.mapInArrow(_near(shared, dim), _SUM).repartition("node").mapInArrow(_added(size, dim), _SUM).toArrow().sort_by("node")
    shared.unpersist()
    return merged(_matrix(sums.column("s").combine_chunks(), dim), sums.column("n").to_numpy())


def _among(new: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """Which centres are the same as one that was tried before, and would be judged as it was."""
    if not len(tried):
        return np.zeros(len(new), bool)
    return np.concatenate([*(c.max(axis=1) >= 1 - 1e-6 for _, c in _cosines(new, tried)), np.zeros(0, bool)])


def clusters(df: DataFrame, min_size: int = 10, id_col: str = "shipment_id", vec_col: str = "embedding", dim: int = DIM, local: int = LOCAL) -> DataFrame:
    """(id, cluster_id, cosine): the members of every cluster, with their cosine to its mean direction."""
    rows = left = cut(usable(df, id_col, vec_col, dim).mapInArrow(_to_units(dim), "id string, v binary"))
    local = max(local, min(rows.count() // TASKS, MOST_LOCAL))
    centres = tried = np.zeros((0, dim), np.float32)
    idle = 0
    for seed in count(3):  # until two trees with other starts find nothing new in what is left; every round before adds a centre
        tree, done = grow(left, dim, local, seed)
        node_of, leaves = _finish(tree, dim)
        found = left.mapInArrow(node_of, "node long, v binary").groupBy("node").applyInArrow(leaves, "s binary").collect()
        # centres of leaves: a few for each cluster, which are far fewer than rows
        new = np.array([*(np.frombuffer(r["s"], np.float32) for r in found), *done], np.float32).reshape(-1, dim)
        new = _again(left, new, LEAST, dim)
        new = new[~_among(new, tried)]
        tried = np.vstack([tried, new])
        new = _again(rows, new, min_size, dim)
        both = merged(np.vstack([centres, new]), np.r_[np.full(len(centres), 2), np.ones(len(new))])
        if len(both) == len(centres):
            if idle:
                break
            idle = 1
            continue
        idle = 0
        shared = rows.sparkSession.sparkContext.broadcast(both[len(centres) :])  # what is left is far from those before
        left, centres = cut(left.mapInArrow(_far(shared, dim), "id string, v binary")), both
        shared.unpersist()
    if not len(centres):
        return rows.select("id", F.col("id").alias("cluster_id"), F.lit(0.0).alias("cosine")).limit(0)
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    members = cut(rows.mapInArrow(_assign(shared, dim), "id string, c long, cosine double").distinct())
    sizes = members.groupBy("c").agg(F.min("id").alias("cluster_id"), F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    return members.join(F.broadcast(sizes.select("c", "cluster_id")), "c").select("id", "cluster_id", "cosine")


def describe(members: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster_id, size, mean_cosine, typical): size, compactness and the ids nearest the centre."""
    near = members.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("cosine"), "id"))).filter(F.col("r") <= typical)
    near = near.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda s: s["id"]), ",").alias("typical"))
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.round(F.avg("cosine"), 4).alias("mean_cosine"))
    return size.join(near, "cluster_id")
