"""Text to vector. The default embedder hashes words into a fixed number of dimensions; any function on batches of texts can take its place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words
from ..functions.vectors import l2_normalise

Embedder = Callable[[list[str]], np.ndarray]


def bucket(word: Column, dim: int) -> Column:
    """A number under 2 * dim from the first 32 bits of the word's MD5, which any engine can compute; even ones add, odd ones subtract."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(2 * dim))


def hashed(text: Column, dim: int = 384) -> Column:
    """Deterministic hashed bag of words at length 1; texts without words are all zeros."""
    h = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: bucket(w, dim))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (F.size(F.filter(h, lambda x: x == d * 2)) - F.size(F.filter(h, lambda x: x == d * 2 + 1))).cast("double"))
    return l2_normalise(counts)


def embed_hashed(df: DataFrame, text: Column, dim: int = 384) -> DataFrame:
    """Adds `embedding` by the hashed embedder, in Arrow batches: one pass over a text's words, whatever the dimension."""
    hashes = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: bucket(w, dim).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("_h")
            n = np.diff(lists.offsets.to_numpy())
            v, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
            x = np.zeros((len(n), dim))
            np.add.at(x, (row, v // 2), np.where(v % 2 == 0, 1.0, -1.0))
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = (x / np.where(length > 0, length, 1)).astype(np.float32)
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            keep = [c for c in b.schema.names if c != "_h"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), out], [*keep, "embedding"])

    return df.withColumn("_h", hashes).mapInArrow(run, T.StructType(list(df.schema.fields)).add("embedding", T.ArrayType(T.FloatType())))


def embed_with(df: DataFrame, text: Column, embedder: Embedder) -> DataFrame:
    """Adds `embedding` by any embedder, which gets the texts batch by batch (spark.sql.execution.arrow.maxRecordsPerBatch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(embedder([t or "" for t in b.column("_t").to_pylist()]), np.float32)
            keep = [c for c in b.schema.names if c != "_t"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(list(x), pa.list_(pa.float32()))], [*keep, "embedding"])

    return df.withColumn("_t", text).mapInArrow(run, T.StructType(list(df.schema.fields)).add("embedding", T.ArrayType(T.FloatType())))
