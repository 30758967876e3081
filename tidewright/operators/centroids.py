"""Mean vectors per category."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_usable, rows_of, unit_rows
from ..sources.sinks import upsert


def centroid_build(rows: DataFrame, key: str, vec_col: str, dim: int = 384) -> DataFrame:
    """(key, centroid, sample_count): the mean of each key's unit vectors at length 1; raises on a mean of zero.

    Each partition adds its rows up by key first, so what is shuffled is a sum for each key and partition,
    however many rows a key has. Sums are of doubles, so that the order of adding shows in no printed digit.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for b in batches:
            x, keys = unit_rows(rows_of(b.column(1), dim)), np.array(b.column(0).to_pylist(), object)
            for k in set(keys):
                s = sums.setdefault(k, [np.zeros(dim), 0])
                m = keys == k
                s[0] += x[m].sum(axis=0)
                s[1] += int(m.sum())
        yield pa.RecordBatch.from_pydict(
            {"key": pa.array(list(sums), pa.string()), "s": pa.array([s[0].tolist() for s in sums.values()], pa.list_(pa.float64())), "n": pa.array([s[1] for s in sums.values()], pa.int64())}
        )

    def total(key_: tuple, t: pa.Table) -> pa.Table:
        s, n = np.array(t.column("s").to_pylist()).sum(axis=0), int(np.sum(t.column("n").to_numpy()))
        length = np.linalg.norm(s)
        if n == 0 or length == 0:
            raise ValueError(f"no centroid for {key_[0].as_py()!r}: the mean is zero")
        return pa.table({"key": [key_[0].as_py()], "centroid": pa.array([(s / length).tolist()], pa.list_(pa.float64())), "sample_count": [n]})

    some = rows.filter(F.col(key).isNotNull() & is_usable(F.col(vec_col), dim)).select(F.col(key).cast("string").alias("key"), F.col(vec_col).cast("array<float>").alias("v"))
    out = some.mapInArrow(partial, "key string, s array<double>, n long").groupBy("key").applyInArrow(total, "key string, centroid array<double>, sample_count long")
    return out.withColumnRenamed("key", key)


def centroid_upsert(existing: DataFrame, built: DataFrame, categories: DataFrame) -> DataFrame:
    """Centroids with the built ones in place; categories that were not built keep theirs. built: (name, centroid, sample_count, updated_at)."""
    new = built.join(categories.select(F.col("id").alias("category_id"), "name"), "name")
    return upsert(existing, new.select("category_id", F.col("centroid").cast("array<float>").alias("centroid"), F.col("sample_count").cast("int").alias("sample_count"), "updated_at"), ["category_id"])
