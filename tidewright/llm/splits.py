"""Problem 4: evaluation rows that stand, exactly or nearly, in the training split.

Rows with the same canonical fields and the same words form one text class, so copies are handled once. The words
of a class are a multiset; its elements, a word with the number of its earlier occurrences, are put in one global
order, rare ones first. Two classes of n and m words overlap enough when they share 3/4 of the larger number, so
the shares that either side needs bound how far into the order a common element may come first: the prefix filter.
Elements of these short texts are drawn from a small vocabulary, so one common element tells little; the prefix is
taken longer by two and three elements at a time are the key, which is as exact and far more selective. Texts over
`SHORT` words use single elements. The evaluation keys are indexed first: a bit for each of their hashes goes to the
executors, and a training key without its bit, which can match none, is not sent on. What is left is joined under the
length and the position filter and a bound on the difference of their bit signatures, and every candidate's overlap is
counted.

Rows that are equal without white space and punctuation (see formatting) but differ in their words are joined on
that key.

Defined results. A null split is `train`; splits other than train, validation and test take no part. Rows with a
null or blank field are left out. Rows whose fields have no letter or digit are joined on the canonical key alone.
Repeated rows are all listed. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import label, words
from ..runtime import cut
from .formatting import keyed

BUCKETS = 1 << 16
#: Texts of more words than this have single-element keys; so have, beside the others, those that can pair with them.
SHORT = 32
#: Bits of the evaluation keys that go to every executor, at most, and the bytes of them that travel together.
MOST_BITS, CHUNK = 1 << 28, 1 << 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.uint64(0x165667B19E3779F9)
    for p in parts:
        h = (h ^ (p.astype(np.uint64) * _M2)) * _M1
        h = h ^ (h >> np.uint64(29))
    return h.view(np.int64)


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values and the lengths of a column of lists without nulls."""
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, np.int64)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each class its elements: word hashes, the k-th repeat of a word being an element of its own."""
    for b in batches:
        v, n = _lists(b.column(1))
        row = np.repeat(np.arange(len(n)), n)
        o = np.lexsort((v, row))
        v, row = v[o], row[o]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (row[1:] != row[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0)) if len(v) else np.zeros(0, np.int64)
        k = np.arange(len(v)) - first
        e = np.where(k == 0, v, _mix(v, k.astype(np.int64)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        cols = {"cid": b.column(0), "elements": pa.ListArray.from_arrays(offsets, pa.array(e)), "words": pa.ListArray.from_arrays(offsets, pa.array(v)), "n": pa.array(n.astype(np.int32))}
        yield pa.RecordBatch.from_pydict(cols | {c: b.column(i) for i, c in enumerate(b.schema.names) if i > 1})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the words of each bucket occur in a partition."""
    n = np.zeros(BUCKETS, np.int64)
    for b in batches:
        n += np.bincount(_lists(b.column(0))[0] & (BUCKETS - 1), minlength=BUCKETS)
    hit = np.flatnonzero(n)
    yield pa.RecordBatch.from_pydict({"b": pa.array(hit.astype(np.int32)), "c": pa.array(n[hit])})


def _keys(b: pa.RecordBatch, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, position, words of each row, bits of each row): the join keys of the classes of a batch."""
    e, n = _lists(b.column("elements"))
    w, _ = _lists(b.column("words"))
    row = np.repeat(np.arange(len(n)), n)
    e = e[np.lexsort((e, freq[w & (BUCKETS - 1)], row))]
    at, need = _starts(n), (3 * n + 3) // 4
    bits = np.zeros(len(n), np.int64)
    np.bitwise_or.at(bits, row, np.int64(1) << (e.astype(np.uint64) * _M1 >> np.uint64(58)).astype(np.int64))
    sig, who, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

    def emit(rows: np.ndarray, size: int, k: int) -> None:
        m = e[at[rows][:, None] + np.arange(size)]
        for c in combinations(range(size), k):
            sig.append(_mix(np.full(len(rows), k, np.int64), *(m[:, j] for j in c)))
            who.append(rows)
            pos.append(np.full(len(rows), c[0], np.int32))

    tiny, short, long_ = (n > 0) & (n < 3), (n >= 3) & (n <= SHORT), n > SHORT * 3 // 4
    for m in np.unique(n[tiny]):
        emit(np.flatnonzero(tiny & (n == m)), int(m), int(m))
    size = np.minimum(n, n - need + 3)
    for m in np.unique(size[short]):
        emit(np.flatnonzero(short & (size == m)), int(m), 3)
    for i in np.flatnonzero(long_):
        p = int(n[i] - need[i] + 1)
        sig.append(_mix(np.full(p, 1, np.int64), e[at[i] : at[i] + p]))
        who.append(np.full(p, i))
        pos.append(np.arange(p, dtype=np.int32))
    return np.concatenate(who), np.concatenate(sig), np.concatenate(pos), n, bits


def _marks(freq: np.ndarray, size: int):
    """The bits of all keys of a partition, as (chunk, bits) of the chunks that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size >> 3, np.uint8)
        for b in batches:
            h = np.unique(_keys(b, freq)[1].view(np.uint64) & np.uint64(size - 1))
            np.bitwise_or.at(seen, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        step = min(CHUNK, len(seen))
        hit = np.flatnonzero(seen.reshape(-1, step).any(axis=1))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(hit), "bits": pa.array([seen[c * step : (c + 1) * step].tobytes() for c in hit], pa.binary())})

    return run


def _either(key: tuple, t: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()], axis=0)
    return pa.table({"chunk": [key[0].as_py()], "bits": pa.array([bits.tobytes()], pa.binary())})


def marked(evals: DataFrame, freq: np.ndarray) -> np.ndarray:
    """A bit for each hash of an evaluation key, eight for each expected key, `MOST_BITS` at most; where more keys share them, fewer others are told apart."""
    size = 1 << 16
    while size < min(MOST_BITS, 8 * 40 * evals.count()):
        size <<= 1
    seen = np.zeros(size >> 3, np.uint8)
    step = min(CHUNK, len(seen))
    for r in evals.select("elements", "words").mapInArrow(_marks(freq, size), "chunk long, bits binary").groupBy("chunk").applyInArrow(_either, "chunk long, bits binary").collect():
        seen[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return seen


def _prefixes(freq: np.ndarray, shared=None):
    """The join keys of each class: (sig, cid, n, pos, bits); bits has one bit for each element's hash. shared: the bits of the keys that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value if shared is not None else None
        for b in batches:
            i, s, p, n, bits = _keys(b, freq)
            if seen is not None:
                h = s.view(np.uint64) & np.uint64(8 * len(seen) - 1)
                keep = (seen[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                i, s, p = i[keep], s[keep], p[keep]
            for lo in range(0, len(i), 500_000):
                k = i[lo : lo + 500_000]
                yield pa.RecordBatch.from_pydict({"sig": s[lo : lo + 500_000], "cid": b.column("cid").take(pa.array(k)), "n": pa.array(n[k].astype(np.int32)), "pos": pa.array(p[lo : lo + 500_000]), "bits": pa.array(bits[k])})

    return run


def _rows(labels: DataFrame, fields: tuple[str, str], id_col: str) -> DataFrame:
    """(id, split, source, h128, h64, words, c1, c2) of the rows that take part; c1 and c2 name the text class."""
    split = label(F.col("split"), "train")
    toks = F.transform(words(F.concat_ws(" ", *fields)), lambda w: F.xxhash64(w))
    some = labels.withColumns({"_s": split}).filter(F.col("_s").isin("train", "validation", "test"))
    source = F.col("source") if "source" in labels.columns else F.lit(None).cast("string")
    extra = some.select(F.col(id_col).alias("id"), F.col("_s").alias("split"), source.alias("source"), F.sort_array(toks).alias("words"), *(F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)))
    keys = keyed(extra, ("_f0", "_f1"), "id", keep=("split", "source", "words"))
    return keys.withColumns({"c1": F.xxhash64("h64", "words"), "c2": F.xxhash64(F.lit(1), "h128", "words")})


def _beside(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def overlaps(labels: DataFrame, fields: tuple[str, str] = ("cargo_text", "commodity_text"), id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, split, source, c1, c2) of every row that takes part; pairs (e1, e2, t1, t2, exact) of all text classes that overlap.

    All joins here are between tables that grow alike, and Spark takes the size of what Arrow functions return from
    their input, so each join is told to merge: none may become a broadcast by such an estimate.
    """
    spark, rows = labels.sparkSession, cut(_rows(labels, fields, id_col))
    is_train = F.col("split") == "train"
    classes = rows.groupBy("c1", "c2").agg(F.min("id").cast("long").alias("cid"), F.max(is_train).alias("train"), F.max(~is_train).alias("eval"), *(F.first(c).alias(c) for c in ("words", "h128", "h64")))
    schema = "cid long, elements array<long>, words array<long>, n int, h128 binary, h64 long, c1 long, c2 long, train boolean, eval boolean"
    classes = cut(classes.select("cid", "words", "h128", "h64", "c1", "c2", "train", "eval").mapInArrow(_elements, schema))
    freq = np.zeros(BUCKETS, np.int64)
    for b, c in classes.select("words").mapInArrow(_count, "b int, c long").groupBy("b").agg(F.sum("c")).collect():  # one number for each of BUCKETS hash buckets, whatever the vocabulary
        freq[b] = c
    evals, trains = classes.filter("eval"), classes.filter("train")
    shared = spark.sparkContext.broadcast(marked(evals, freq))
    keys, schema = ("cid", "elements", "words"), "sig long, cid long, n int, pos int, bits long"
    a = evals.select(*keys).mapInArrow(_prefixes(freq), schema).select("sig", F.col("cid").alias("e"), "n", F.col("pos").alias("p"), F.col("bits").alias("x"))
    b = trains.select(*keys).mapInArrow(_prefixes(freq, shared), schema).select("sig", F.col("cid").alias("t"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("bits").alias("y"))
    # length, position, and bits: sets differ in as many elements as their bits do, at least
    fits = "4 * least(n, m) >= 3 * greatest(n, m) and 4 * (least(p, q) + least(n - p, m - q)) >= 3 * greatest(n, m) and bit_count(x ^ y) <= n + m - 2 * ((3 * greatest(n, m) + 3) div 4)"
    found = a.join(b.hint("merge"), "sig").filter(fits).select("e", "t").distinct()
    text = ("cid", "elements", "n", "h128", "h64", "c1", "c2")
    near = found.join(_beside(evals.select(*text), "a_").hint("merge"), F.col("e") == F.col("a_cid"))
    near = near.join(_beside(trains.select(*text), "b_").hint("merge"), F.col("t") == F.col("b_cid"))
    near = near.filter("4 * size(array_intersect(a_elements, b_elements)) >= 3 * greatest(a_n, b_n)")
    pair = [F.col(a).alias(b) for a, b in (("a_c1", "e1"), ("a_c2", "e2"), ("b_c1", "t1"), ("b_c2", "t2"))]
    near = near.select(*pair, F.expr("a_h128 = b_h128 and a_h64 = b_h64").alias("exact"))
    text = ("h128", "h64", "c1", "c2")
    same = _beside(evals.select(*text), "a_").join(_beside(trains.select(*text), "b_").hint("merge"), F.expr("a_h128 = b_h128 and a_h64 = b_h64"))
    pairs = cut(near.unionByName(same.select(*pair, F.lit(True).alias("exact"))).distinct())
    return rows.select("id", "split", "source", "c1", "c2"), pairs


def row_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of an evaluation row and a training row that overlap.

    Copies are multiplied out here, and only here: `overlaps` names each pair of different texts once.
    """
    e = members.filter("split <> 'train'").select(F.col("c1").alias("e1"), F.col("c2").alias("e2"), F.col("id").alias("e"))
    t = members.filter("split = 'train'").select(F.col("c1").alias("t1"), F.col("c2").alias("t2"), F.col("id").alias("t"))
    both = pairs.drop("exact").join(e.hint("merge"), ["e1", "e2"]).join(t.hint("merge"), ["t1", "t2"])
    return both.select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b"))


def report(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split, source, rows, exact, near): evaluation rows of each split and source, and how many of them overlap with training rows."""
    best = pairs.groupBy(F.col("e1").alias("c1"), F.col("e2").alias("c2")).agg(F.max("exact").alias("exact"))
    e = members.filter("split <> 'train'").join(best.hint("merge"), ["c1", "c2"], "left")
    one = lambda c: F.count(F.when(c, 1))
    return e.groupBy("split", "source").agg(F.count(F.lit(1)).alias("rows"), one(F.col("exact")).alias("exact"), one(~F.col("exact")).alias("near"))
