"""Problem 7: evaluation texts that leak into training text.

Latent semantic retrieval. Words are read without markup, punctuation, case and the differences that misread
characters make, and hashed into `BUCKETS` features; passages are `2 * STEP` words that overlap by half. Document
frequencies are counted over the whole corpus. A randomised SVD of the passages' TF-IDF matrix is made with two
distributed multiplications by the matrix and its transpose over a sample of `FIT_DOCS` documents at most, taken
by hash of the id; every passage of every document is then mapped into the whitened latent space and compared
with the passages of all items, which are a given, small set. A document and an item with a cosine of
`MIN_COSINE` somewhere are candidates. A candidate is checked on words: the best of all windows of the document, a little
longer than the item, must hold `MIN_ORDER` of the item's words in the item's order (longest common subsequence).
Frequent words stand in order by chance, so the answer is checked too: the share of the item's weight (IDF, nothing for
standard clauses) that a window can have in order, raised where it also has whole runs of three words, must be
`MIN_WEIGHT`. Upper bounds on both, from the words that document and window have at all and from what a stretch of
several windows has in order, decide what need not be aligned. A run is a clause's if more than two different items share it and twice as many documents have it as leaks of
these items account for; an item that is nearly all clauses is weighed whole. Equal items are one item until the pairs
are listed. Items are searched for in blocks of `ITEMS_AT_ONCE`, so what goes to the executors is bounded.

Defined results. Null and blank texts, of documents or items, are in no pair. Items under `SHORTEST` words are
searched for as a whole: they are candidates by their runs too, and those of one or two words must stand as they are. Copies of a document are all listed; repeated ids are listed once for each item. Very
long documents are searched whole. Empty tables: no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

BUCKETS, RANK, EXTRA, STEP = 1 << 14, 128, 16, 20
#: Documents that the latent space is fitted on, at most.
FIT_DOCS = 2048
MIN_COSINE, MIN_ORDER, SHORTEST = 0.55, 0.40, 2 * STEP
#: Share of an item's weight in order, with `RUNS` times the share of its runs, that a leak has at least.
MIN_WEIGHT, RUNS = 0.42, 0.6
#: Weight of an item's lightest words, together, without which its heavier words are aligned first.
LIGHT = 0.10
#: Share of its runs from which a short item is a candidate whatever its cosine, and under which an item is nearly all clauses.
MIN_RUNS = 0.16
#: Items whose words and latent vectors go to the executors at a time.
ITEMS_AT_ONCE = 4096
CHUNK = 256
#: Characters that misreading swaps, with the one that stands for them.
LOOKALIKES = {"0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "e": "c", "8": "b", "9": "g", "2": "z"}
_TAG = re.compile(r"<[^<>]{0,60}>")


class _Fold(dict):
    def __missing__(self, o: int):
        c = chr(o)
        if c.isspace():
            r = " "
        elif c.isalnum():
            r = "".join(LOOKALIKES.get(x, x) for x in c.lower())
        else:
            r = LOOKALIKES.get(c)
        self[o] = r
        return r


class _Hashes(dict):
    """Hashes of words as they stand in the text; -1 for those of which nothing is left."""

    fold = _Fold()

    def __missing__(self, word: str) -> int:
        w = word.translate(self.fold).replace("rn", "m")
        h = self[word] = zlib.crc32(w.encode("utf-8", "surrogatepass")) if w else -1
        return h


class Reader:
    """Texts as arrays of 32-bit word hashes."""

    def __init__(self, keep: int = 500_000) -> None:
        self.known, self.keep = _Hashes(), keep

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        if "<" in text:
            text = _TAG.sub(" ", text)
        words, known = text.split(), self.known
        if len(known) > self.keep:
            known.clear()
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return out[out >= 0]


def _once(x: np.ndarray) -> np.ndarray:
    """The distinct numbers of x, in order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class _Sieve:
    """Leaves out most numbers that are not among the 64-bit hashes given, and none that are."""

    def __init__(self, hashes: np.ndarray) -> None:
        bits = min(max(16, (16 * len(hashes)).bit_length()), 24)
        self.shift, self.some = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.some[hashes >> self.shift] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return hashes[self.some[hashes >> self.shift]]


def passages(weights: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The latent vectors of the overlapping passages of texts, at length 1, one text after the other, and the number of each text's.

    A row of zeros after the weights fills a text's last block; without one it is added.
    """
    size = np.array([len(w) for w in texts], np.int64)
    blocks = -(-size // STEP)
    p = np.zeros((blocks.sum(), weights.shape[1]), np.float32)
    words = np.append(np.concatenate([*texts, np.zeros(0, np.int64)]) & (BUCKETS - 1), BUCKETS)
    nth = np.arange(len(p)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = np.append(np.repeat(np.cumsum(size) - size, blocks) + nth * STEP, len(words) - 1)
    weights = weights if len(weights) > BUCKETS else np.append(weights, np.zeros_like(weights[:1]), axis=0)
    for lo in range(0, len(p), 128):
        start, end = at[:-1][lo : lo + 128, None], at[1:][lo : lo + 128, None]
        k = start + np.arange(STEP)
        p[lo : lo + 128] = weights.take(words[np.where(k < end, k, -1)], axis=0).sum(axis=1)
    last = nth == np.repeat(blocks, blocks) - 1
    whole = last & (nth == 0)
    first = np.flatnonzero(~last | whole)
    p = p[first] + p[np.minimum(first + 1, len(p) - 1)] * ~whole[first, None]
    return p / (np.linalg.norm(p, axis=1, keepdims=True) + 1e-9), np.maximum(blocks - 1, np.minimum(blocks, 1))


def _df(shared):
    """Documents that have each bucket's words, all documents at -1, and those that have run i at -2 - i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        read, n, docs, have = Reader(), np.zeros(BUCKETS, np.int64), 0, np.zeros(len(runs), np.int64)
        sieve, last = _Sieve(runs), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                w = read(t)
                if len(w):
                    bucket, k = w & (BUCKETS - 1), np.arange(len(w))
                    last[bucket] = k
                    n[bucket[last[bucket] == k]] += 1  # each bucket once
                    docs += 1
                    if len(runs):
                        r = _once(sieve(_runs(w)))
                        at = np.minimum(np.searchsorted(runs, r), len(runs) - 1)
                        have[at[runs[at] == r]] += 1
        hit, seen = np.flatnonzero(n), np.flatnonzero(have)
        yield pa.RecordBatch.from_pydict({"bucket": np.concatenate([hit, [-1], -2 - seen]), "n": np.concatenate([n[hit], [docs], have[seen]])})

    return run


def frequencies(docs: DataFrame, runs: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(documents, those that have each bucket, those that have each of the sorted runs). docs: (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    got = docs.select("text").mapInArrow(_df(shared), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one number for each bucket and run of the items
    df, have, n_docs = np.zeros(BUCKETS), np.zeros(len(runs), np.int64), 0
    for b, n in got:
        if b >= 0:
            df[b] = n
        elif b == -1:
            n_docs = n
        else:
            have[-2 - b] = n
    return n_docs, df, have


def _triples(read: Reader, texts: list, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(passage, bucket, value) of the passages' TF-IDF matrix, rows at length 1, and its number of rows."""
    rows, cols, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for t in texts:
        w = read(t) & (BUCKETS - 1)
        if not len(w):
            continue
        block = np.arange(len(w)) // STEP
        last = max(int(block[-1]) - 1, 0)
        for r in (np.minimum(block, last), np.where((block >= 1) & (block <= last), block - 1, -1)):
            rows.append(n + r[r >= 0])
            cols.append(w[r >= 0])
        n += last + 1
    row, col = np.concatenate(rows), np.concatenate(cols)
    v = idf[col]
    norm = np.sqrt(np.bincount(row, v * v, n)) if n else np.zeros(0)
    return row, col, (v / np.maximum(norm[row], 1e-6)).astype(np.float32), n


def _times(key: np.ndarray, other: np.ndarray, value: np.ndarray, m: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros((rows, m.shape[1]), np.float32)
    if len(key):
        o = np.argsort(key, kind="stable")
        k = key[o]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        out[k[at]] = np.add.reduceat(m[other[o]] * value[o][:, None], at, axis=0)
    return out


def _multiply(shared, idf: np.ndarray, gram: bool):
    """Aᵀ A V by blocks of rows, or, for the last step, (A V)ᵀ (A V)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, read = shared.value, Reader()
        total = np.zeros((v.shape[1] if gram else BUCKETS, v.shape[1]), np.float32)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo in range(0, len(texts), 64):
                row, col, val, n = _triples(read, texts[lo : lo + 64], idf)
                y = _times(row, col, val, v, n)
                total += y.T @ y if gram else _times(col, row, val, y, BUCKETS)
        if gram:
            yield pa.RecordBatch.from_pydict({"chunk": [0], "s": pa.array([total.tobytes()], pa.binary())})
        else:
            parts = [(k, total[k * CHUNK : (k + 1) * CHUNK]) for k in range(BUCKETS // CHUNK)]
            parts = [(k, p) for k, p in parts if p.any()]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k for k, _ in parts], pa.int64()), "s": pa.array([p.tobytes() for _, p in parts], pa.binary())})

    return run


def _sum(key: tuple, t: pa.Table) -> pa.Table:
    s = np.sum([np.frombuffer(x, np.float32) for x in t.column("s").to_pylist()], axis=0, dtype=np.float32)
    return pa.table({"chunk": [key[0].as_py()], "s": pa.array([s.tobytes()], pa.binary())})


def fit(docs: DataFrame, n_docs: int, df: np.ndarray, seed: int = 11) -> np.ndarray:
    """Weights (BUCKETS, RANK): what a word adds to the whitened latent vector of its passage. docs: (doc_id, text); n_docs, df: see `frequencies`."""
    spark = docs.sparkSession
    if not n_docs:
        return np.zeros((BUCKETS, RANK), np.float32)
    idf = np.log((n_docs + 1) / (df + 1)).astype(np.float32)
    share = min(1.0, FIT_DOCS / n_docs)
    some = cut(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(FIT_DOCS).select("text").repartition(8))
    v = np.random.default_rng(seed).standard_normal((BUCKETS, RANK + EXTRA)).astype(np.float32)
    for step in range(3):
        shared = spark.sparkContext.broadcast(v)
        got = some.mapInArrow(_multiply(shared, idf, step == 2), "chunk long, s binary").groupBy("chunk").applyInArrow(_sum, "chunk long, s binary").collect()
        shared.unpersist()
        if step == 2:
            values, turn = np.linalg.eigh(np.frombuffer(got[0]["s"], np.float32).reshape(RANK + EXTRA, -1).astype(np.float64))
            order = np.argsort(-values)[:RANK]
            sigma = np.sqrt(np.maximum(values[order], 0))
            scale = np.where(sigma > 1e-4 * sigma[0], sigma[0] / np.maximum(sigma, 1e-9), 0)
            return (idf[:, None] * (v @ turn[:, order]) * scale).astype(np.float32)
        z = np.zeros((BUCKETS, RANK + EXTRA), np.float32)
        for r in got:
            z[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["s"], np.float32).reshape(CHUNK, -1)
        v = np.linalg.qr(z)[0].astype(np.float32)
    raise AssertionError


def _runs(w: np.ndarray) -> np.ndarray:
    """A hash of each run of three words."""
    m = np.uint64(0x9E3779B97F4A7C15)
    w = w.astype(np.uint64)
    return ((w[:-2] * m + w[1:-1]) * m + w[2:]) * m if len(w) > 2 else np.zeros(0, np.uint64)


def _grams(w: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of one or two words."""
    w = w.astype(np.uint64)
    return w if n == 1 else w[:-1] << np.uint64(32) | w[1:]


def masks(a: list[int]) -> dict[int, int]:
    """The places of each word of a, as bits."""
    at: dict[int, int] = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    return at


def aligned(n: int, found: list[int]) -> int:
    """Length of the longest common subsequence of n words and a text, of which the masks of the words in both are given; by bit-parallel addition."""
    v = full = (1 << n) - 1
    for m in found:
        u = v & m
        v = (v + u | v - u) & full
    return n - v.bit_count()


def common_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    at = masks(a)
    return aligned(len(a), [at[w] for w in b if w in at])


class Items:
    """What the search needs of the evaluation items."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        read = Reader()
        self.ids, self.words, at = [], [], {}  # ids: of the items with these words
        for i, t in rows:
            w = read(t)
            if len(w):
                k = at.setdefault(w.tobytes(), len(self.words))
                if k == len(self.words):
                    self.ids.append([])
                    self.words.append(w)
                self.ids[k].append(i)
        self.short = np.array([len(w) < SHORTEST for w in self.words], bool)
        self.tiny = {n: [k for k, w in enumerate(self.words) if len(w) == n] for n in (1, 2)}
        self.tiny_keys = {n: _grams(np.concatenate([self.words[k] for k in ks]), n)[::n] for n, ks in self.tiny.items() if ks}
        runs = [np.unique(_runs(w)) for w in self.words]
        flat = np.concatenate([*runs, np.zeros(0, np.uint64)])
        own = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        o = np.argsort(flat, kind="stable")
        self.run, self.of = flat[o], own[o]
        self.distinct, self.back = np.unique(self.run, return_inverse=True)
        self.vocabulary = np.unique(np.concatenate([*self.words, np.zeros(0, np.int64)]))
        self.local = np.full(len(self.vocabulary) + 1, -1, np.int64)  # scratch: see order()
        self.has = np.zeros(len(self.vocabulary) + 1)  # scratch: see shared_words()
        self.ignore_clauses(np.zeros(len(self.distinct), np.int64))
        self.weigh(np.ones(BUCKETS))

    def weigh(self, idf: np.ndarray) -> None:
        """Gives every word of every item its weight, those of standard clauses none."""
        self.weight, self.bags, self.sums, self.places = [], [], [], []
        for k, w in enumerate(self.words):
            x = idf[w & (BUCKETS - 1)].astype(np.float64)
            if not self.bare[k]:
                for j in np.flatnonzero(~np.isin(_runs(w), self.kept[k])):
                    x[j : j + 3] = 0
            if not x.sum() > 0:
                x = np.ones(len(w))
            x = x / x.sum()
            self.weight.append(x)
            distinct, which, many = np.unique(w, return_inverse=True, return_counts=True)
            self.sums.append((np.searchsorted(self.vocabulary, distinct), np.array([np.bincount(which, x), many / len(w)])))
            places: list[list[tuple[int, float]]] = [[] for _ in distinct]
            for p in np.flatnonzero(x > 0)[::-1].tolist():
                places[which[p]].append((p, float(x[p])))
            self.places.append(places)
            heavy = np.zeros(len(distinct))
            np.maximum.at(heavy, which, x)
            by_word = masks(w.tolist())
            light = heavy * many
            o = np.argsort(light, kind="stable")
            light[o] = np.cumsum(light[o])
            light = light <= LIGHT
            o = np.argsort(-x, kind="stable")
            o = o[~light[which[o]]]  # the places of the heavier words, heaviest first
            self.bags.append((distinct, many, heavy, [by_word[d] for d in distinct.tolist()], light, 1 - x[o].sum(), which[o], x[o]))

    def ignore_clauses(self, have: np.ndarray) -> None:
        """Leaves out the runs of standard clauses. have: documents that have each of the distinct runs."""
        n = np.bincount(self.back, minlength=len(self.distinct))
        every = np.bincount(self.of, minlength=len(self.words))
        leaked = np.zeros(len(self.words))  # documents that have the usual run of an item
        o = np.argsort(self.of, kind="stable")
        for k, at in enumerate(np.split(self.back[o], np.cumsum(every)[:-1]) if len(every) else []):
            rare = at[n[at] <= 2]
            leaked[k] = np.median(have[rare if len(rare) else at]) if len(at) else 0
        due = np.bincount(self.back, leaked[self.of] + 1, minlength=len(self.distinct))
        keep = ~((n > 2) & (have > 2 * due))[self.back]
        self.run, self.of = self.run[keep], self.of[keep]
        self.distinct, self.back = np.unique(self.run, return_inverse=True)
        self.first, self.sieve = np.searchsorted(self.run, self.distinct), _Sieve(self.distinct)
        self.first = np.append(self.first, len(self.run))
        kept = np.bincount(self.of, minlength=len(self.words))
        self.n_runs = np.maximum(kept, 1)
        self.kept = np.split(self.run[np.argsort(self.of, kind="stable")], np.cumsum(kept)[:-1]) if len(kept) else []
        self.bare = kept < np.maximum(MIN_RUNS * every, 1)

    def queries(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passages of all items at every `STEP / 2` words, and the item of each."""
        q, of = [np.zeros((0, weights.shape[1]), np.float32)], []
        for k, w in enumerate(self.words):
            for lo in range(0, max(len(w) - SHORTEST + STEP // 2, 1), STEP // 2):
                v = weights[w[lo : lo + SHORTEST] & (BUCKETS - 1)].sum(axis=0)
                q.append((v / (np.linalg.norm(v) + 1e-9))[None])
                of.append(k)
        return np.concatenate(q).astype(np.float32), np.array(of, np.int64)

    def shared_runs(self, words: np.ndarray) -> np.ndarray:
        """Share of each item's runs that the text has, without those of clauses."""
        r = _once(self.sieve(_runs(words)))
        if not len(r) or not len(self.distinct):
            return np.zeros(len(self.ids))
        at = np.minimum(np.searchsorted(self.distinct, r), len(self.distinct) - 1)
        at = at[self.distinct[at] == r]
        lo, n = self.first[at], self.first[at + 1] - self.first[at]
        hit = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.of[hit], minlength=len(self.ids)) / self.n_runs

    def seen(self, words: np.ndarray) -> np.ndarray:
        """The places of words in the vocabulary; its size for those that no item has."""
        at = np.searchsorted(self.vocabulary, words)
        at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] != words] = len(self.vocabulary)
        return at

    def shared_words(self, near: list[int], seen: np.ndarray) -> np.ndarray:
        """The shares of weight and words of each of the items near that the text has, in any order."""
        self.has[seen], out = 1, []
        for k in near:
            at, sums = self.sums[k]
            out.append(sums @ self.has.take(at))
        self.has[seen] = 0
        return np.array(out).T

    def stands(self, words: np.ndarray) -> np.ndarray:
        """The items of one or two words that the text has as they are."""
        found = [np.array(self.tiny[n])[np.isin(keys, _grams(words, n))] for n, keys in self.tiny_keys.items()]
        return np.concatenate([np.zeros(0, np.int64), *found])

    def candidates(self, cosines: np.ndarray, runs: np.ndarray, words: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """The items to check on words."""
        near = np.flatnonzero((cosines >= MIN_COSINE) | self.short & (runs >= MIN_RUNS))
        if len(near):
            weight, share = self.shared_words(near.tolist(), seen)
            near = near[(weight + RUNS * runs[near] >= MIN_WEIGHT - 1e-9) & (share >= MIN_ORDER - 1e-9)]
        if not self.tiny_keys:
            return near
        return np.union1d(near[[len(self.words[k]) > 2 for k in near.tolist()]] if len(near) else near, self.stands(words))

    def weighs(self, k: int, at: np.ndarray, need: float) -> bool:
        """Whether a text has `need` of item k's weight in order. at: the words of the text that the item has, as places among its distinct ones.

        Heaviest increasing subsequence: of the common subsequences so far those are kept that end earlier in the
        item than all heavier ones.
        """
        if need <= 0:
            return True
        places, ends, sums = self.places[k], [-1, 1 << 62], [0.0, np.inf]
        for j in at.tolist():
            for p, x in places[j]:  # from the last, so that a word of the text stands for one of the item's
                i = e = bisect_left(ends, p)
                s = sums[i - 1] + x
                while sums[e] <= s:
                    e += 1
                if e > i or ends[i] > p:
                    if s >= need:
                        return True
                    ends[i:e], sums[i:e] = [p], [s]
        return False

    def answered(self, k: int, window: np.ndarray, at: np.ndarray) -> bool:
        """Whether the window has enough of item k's weight in order. at: see weighs()."""
        kept, runs = self.kept[k], 0.0
        if len(kept):
            r = _runs(window)
            i = np.minimum(np.searchsorted(kept, r), len(kept) - 1)
            runs = len(set(i[kept[i] == r].tolist())) / len(kept)
        return self.weighs(k, at, MIN_WEIGHT - RUNS * runs)

    def _bounds(self, k: int, at: np.ndarray, pos: np.ndarray, size: int, n: int, runs: float) -> np.ndarray:
        """For each of n windows of `size` words the number of item k's words that it has in any order; 0 where their weight is too little.

        at, pos: the words of the text that the item has, and where they stand. A word that the item has m times counts
        in the windows that begin after its m-th last occurrence.
        """
        many, heavy = self.bags[k][1:3]
        o = np.argsort(at, kind="stable")
        at, pos = at[o], pos[o]
        back = np.arange(len(at)) - many[at]
        same = (back >= 0) & (at[back] == at)
        lo = np.maximum(np.where(same, pos[back] + 1, 0), np.maximum(pos - size + 1, 0))
        hi = np.minimum(pos, n - 1) + 1
        some = lo < hi
        lo, hi, x = lo[some], hi[some], heavy[at[some]]
        enough = np.cumsum(np.bincount(lo, x, n + 1) - np.bincount(hi, x, n + 1))[:n] + RUNS * runs >= MIN_WEIGHT - 1e-9
        if not enough.any():
            return np.zeros(n, np.int64)
        return np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1))[:n] * enough

    def order(self, k: int, words: np.ndarray, runs: float = 1.0, seen: np.ndarray | None = None) -> tuple[float, int]:
        """Share of item k's words that the best window of the text has in order, and where the window starts; 0 when no window is a leak.

        runs: share of the item's runs that the whole text has, at most. seen: see seen(). What a window has of the item's words
        bounds what it has in order; so does what a stretch of twice its length has in order, by weight and by number;
        and a window n words on has at most n more. Windows that no bound rules out are aligned.
        """
        a = self.words[k]
        distinct, _, _, mask, light, rest, which, x = self.bags[k]
        least, size = MIN_ORDER * len(a), min(int(1.3 * len(a)) + STEP, len(words))
        n = len(words) - size + 1
        mine = self.sums[k][0]
        self.local[mine] = np.arange(len(mine))
        at = self.local[self.seen(words) if seen is None else seen]
        self.local[mine] = -1
        pos = np.flatnonzero(at >= 0)
        at = at[pos]
        bound = self._bounds(k, at, pos, size, n, runs)
        if bound.max() < least:
            return 0.0, 0
        need = MIN_WEIGHT - RUNS * runs - 1e-9 - rest
        heavy = ~light[at]
        heavy_pos, heavy_at = pos[heavy], at[heavy]
        for lo in range(0, n, size):
            if bound[lo : lo + size].max() >= least:
                ends = lo, min(lo + size, n) + size - 1
                i, j = np.searchsorted(heavy_pos, ends)
                part = heavy_at[i:j]
                c = aligned(len(a), [mask[w] for w in part.tolist()])
                has = np.bincount(part, minlength=len(distinct)) > 0
                if x[has[which]][:c].sum() < need or not self.weighs(k, part, need):
                    bound[lo : lo + size] = 0
                else:
                    i, j = np.searchsorted(pos, ends)
                    c = aligned(len(a), [mask[w] for w in at[i:j].tolist()])
                    bound[lo : lo + size] = np.minimum(bound[lo : lo + size], c)
        if bound.max() < least:
            return 0.0, 0
        found, far = [mask[j] for j in at.tolist()], np.arange(n)
        best, where = 0, 0
        while True:
            lo = int(np.argmax(bound))
            if bound[lo] <= best or bound[lo] < least:
                return best / len(a), where
            i, j = np.searchsorted(pos, (lo, lo + size))
            c = aligned(len(a), found[i:j])
            bound = np.minimum(bound, c + np.abs(far - lo))
            if c > best and c >= least and self.answered(k, words[lo : lo + size], at[i:j]):
                best, where = c, lo
            else:
                bound[lo] = min(c, best)


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = shared.value
        q, of = items.queries(weights)
        weights = np.append(weights, np.zeros_like(weights[:1]), axis=0)  # what no word adds: see passages()
        many = np.bincount(of, minlength=len(items.words))
        o = np.argsort(-many, kind="stable")  # items with the most passages first: a passage of each, then a second one of those that have it, and so on
        back, start = np.argsort(o), np.cumsum(many) - many
        level = [o[: np.searchsorted(-many[o], -j)] for j in range(many.max(initial=0))]
        turned = np.ascontiguousarray(q[np.concatenate([start[x] + j for j, x in enumerate(level)])].T) if len(q) else q.T
        read = Reader()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = []
            for lo in range(0, len(ids), 64):
                words = [read(t) for t in texts[lo : lo + 64]]
                p, n = passages(weights, words)
                if not len(p) or not len(q):
                    continue
                best = np.empty((len(p), len(o)), np.float32)
                for r in range(0, len(p), 256):
                    cosines, top, j = p[r : r + 256] @ turned, best[r : r + 256], 0
                    top[:] = cosines[:, : len(o)]
                    for x in level:
                        np.maximum(top[:, : len(x)], cosines[:, j : j + len(x)], out=top[:, : len(x)])
                        j += len(x)
                at = 0
                for i, w, m in zip(ids[lo : lo + 64], words, n.tolist()):
                    if m:
                        cos = best[at : at + m].max(axis=0)[back]
                        at += m
                        if cos.max() < MIN_COSINE and not items.short.any():
                            continue
                        runs, seen = items.shared_runs(w), items.seen(w)
                        for k in items.candidates(cos, runs, w, seen).tolist():
                            share, where = items.order(k, w, float(runs[k]), seen)
                            if share >= MIN_ORDER:
                                out += [(i, one, float(cos[k]), float(runs[k]), share, where) for one in items.ids[k]]
            cols = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "item_id", "cosine", "runs", "in_order", "first_word"])

    return run


_LEAKS = "doc_id long, item_id long, cosine double, runs double, in_order double, first_word long"


def _block(docs: DataFrame, items: DataFrame) -> DataFrame:
    held = Items([tuple(r) for r in items.orderBy("item_id").collect()])
    n_docs, df, have = frequencies(docs, held.distinct)
    held.ignore_clauses(have)
    held.weigh(np.log((n_docs + 1) / (df + 1)))
    shared = docs.sparkSession.sparkContext.broadcast((fit(docs, n_docs, df), held))
    return docs.mapInArrow(_search(shared), _LEAKS)


def leaks(docs: DataFrame, items: DataFrame, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, cosine, runs, in_order, first_word): every document and the items that leaked into it.

    items: the stated query set; each block of about `at_once` of them, by hash of the text so that equal items stay
    together, is read on the driver, sent to the executors and held against all documents.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(r"\S"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    blocks = max(1, -(-items.count() // at_once))
    if blocks == 1:
        return _block(docs, items)
    out = None
    for b in range(blocks):
        one = cut(_block(docs, items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)))
        out = one if out is None else out.unionByName(one)
    return out


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, documents, strongest): the items that leaked, in how many documents, and the largest share of their words."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.max("in_order"), 4).alias("strongest"))
