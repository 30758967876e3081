"""Exact vector search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, doubles, is_usable, rows_of, unit_rows

#: Vectors of a block, about.
BLOCK = 4096


def nearest(rows: DataFrame, reference: DataFrame, k: int, id_col: str, vec_col: str, dim: int = 384) -> DataFrame:
    """(id, distance): the k rows nearest to the one reference row, which is itself among them; unusable vectors come last, ids break ties."""
    ref = F.broadcast(reference.select(doubles(F.col(vec_col)).alias("_q")).limit(1))
    v = F.when(is_usable(F.col(vec_col), dim), doubles(F.col(vec_col)))
    out = rows.crossJoin(ref).select(id_col, F.round(cosine_distance(v, F.col("_q")), 6).alias("distance"))
    return out.orderBy(F.asc_nulls_last("distance"), id_col).limit(k)


def _vectors(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of a block, in order of id."""
    ids = np.array(t.column("id").to_pylist(), object).astype(str)
    o = np.argsort(ids, kind="stable")
    return ids[o], unit_rows(rows_of(t.column("v").combine_chunks(), dim))[o]


def _best(q: np.ndarray, x: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the k best rows for each query; of equal ones the first. same: pairs that are one row."""
    s = np.round(q @ x.T, 6)
    s[same] = -9
    last = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if k < s.shape[1] else np.full((len(s), 1), -8.0)
    i, j = np.nonzero((s >= last) & (s > -9))
    e = s[i, j]
    o = np.lexsort((j, -e, i))
    i, j, e = i[o], j[o], e[o]
    first = np.searchsorted(i, i)
    keep = np.arange(len(i)) - first < k
    return i[keep], j[keep], e[keep]


def knn_join(queries: DataFrame, rows: DataFrame, k: int, id_col: str, vec_col: str, dim: int = 384, block: int = BLOCK) -> DataFrame:
    """(query_id, neighbour_id, similarity): the k rows nearest to each query, the query itself left out.

    A stated query set against all rows, in blocks: both sides are cut into blocks of about `block` vectors by hash of the
    id, every block of queries meets every block of rows in one task, which sends on the k best of each query only.
    Nothing comes to the driver but the two counts.
    """

    def usable(d: DataFrame) -> DataFrame:
        return d.filter(is_usable(F.col(vec_col), dim)).select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))

    asked, rows = usable(queries), usable(rows)
    n_asked, n_rows = (max(1, -(-d.count() // block)) for d in (asked, rows))
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("a", number(n_asked)).withColumn("b", every(n_rows))
    right = rows.withColumn("b", number(n_rows)).withColumn("a", every(n_asked))

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and x.num_rows:
            (qid, qv), (xid, xv) = _vectors(q, dim), _vectors(x, dim)
            for lo in range(0, len(qid), 256):
                part = qid[lo : lo + 256]
                i, j, e = _best(qv[lo : lo + 256], xv, part[:, None] == xid[None], k)
                out.append((part[i], xid[j], e))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, str), np.zeros(0, str), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0].tolist(), pa.string()), "neighbour_id": pa.array(cols[1].tolist(), pa.string()), "similarity": pa.array(cols[2], pa.float64())})

    out = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, "query_id string, neighbour_id string, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
