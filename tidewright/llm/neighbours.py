"""Problem 1: the k most similar vectors for every vector.

Additive quantisation. Each of M codebooks holds full-dimensional codewords for the residual that the codebooks
before it leave; beam search picks the codewords whose sum is nearest, and the norm of that sum is stored with the
code. The codebooks are fitted on a bounded sample (`SAMPLE` rows, taken by hash of the id); every row is encoded.

The leading codewords make a tree of cells, whose root holds everything: a cell that more than `max_cell` vectors share is split by the next
codeword, so cells keep their size while the table grows; a cell that the deepest level cannot split is cut into
blocks, and its queries visit every block. Rows of a split cell that lie close around its centre are no longer told
apart by further codewords: they stay together, in blocks, and all queries that come through the cell visit them. Every vector is a query of its own cell and of the further cells that
its beam ends in. In a cell, a table of the query's products with all codewords is made, the sums of looked-up
products over the stored norm give approximate cosines; the best of these are compared exactly, then every other row
of the cell whose approximate cosine and quantisation error together can reach the k-th of them.

Exact copies of a vector are collapsed before anything moves: a partition sends one of them on, a cell keeps one,
and the first k + 1 ids of each group stand for it in the results, which is all that a list of k can need.

Defined results. A vector is usable when it is not null, has `dim` numbers, all finite, and not all zeros; other
rows are in no result. Similarities are rounded to 6 decimals; at equal similarity the smaller id comes first.
Rows with a repeated id count once for each different vector. Fewer than k others: as many as there are. Empty
table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

DIM, WORDS, LEVELS, BEAM, DEPTH = 384, 64, 16, 8, 4
ROOT = 1
#: Rows that the codebooks are fitted on, at most.
SAMPLE = 8192
MAX_CELL = 4096
#: Rows of a split cell with this cosine to its words' sum are alike, so the next words cannot tell them apart; more than `LEAST_CORE` stay together.
CORE, LEAST_CORE = 0.87, 64


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int = DIM) -> DataFrame:
    """(id, v) of the rows whose vector has dim numbers, not all zero."""
    v = F.col(vec_col)
    rows = df.filter(v.isNotNull() & (F.size(v) == dim) & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("string").alias("id"), v.cast("array<float>").alias("v"))


def matrix(col: pa.Array, dim: int = DIM) -> np.ndarray:
    """A column of lists of dim numbers as a float32 matrix."""
    flat = col.flatten()
    if flat.null_count:
        flat = flat.fill_null(float("nan"))
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of x at length 1, as float32."""
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def bounded_sample(rows: DataFrame, n: int, total: int) -> np.ndarray:
    """Up to n unit vectors, chosen by hash of the id. total: rows in the table, an upper bound of the usable ones."""
    share = min(1.0, 1.2 * n / max(total, 1))
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(n).toArrow()
    if not some.num_rows:
        return np.zeros((0, DIM), np.float32)
    x = matrix(some.column("v").combine_chunks(), len(some.column("v")[0]))
    x = x[np.isfinite(x).all(axis=1)]
    return unit(x[np.abs(x).sum(axis=1) > 0])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        o = np.argsort(a, kind="stable")
        at = np.searchsorted(a[o], np.arange(k))
        n = np.bincount(a, minlength=k)
        sums = np.add.reduceat(np.vstack([x[o], np.zeros((1, x.shape[1]), np.float32)]), at, axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return c


def fit(x: np.ndarray, levels: int = LEVELS, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """Residual codebooks (levels, words, dim) of the unit vectors x."""
    rng, left, books = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(levels):
        c = _kmeans(left, words, rng)
        left = left - c[np.argmax(left @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)]
        books.append(c)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(codes, scale, paths): the best code of each row, one over its sum's norm, and the beam after each of the first DEPTH levels."""
    levels, words, dim = books.shape
    flat = books.reshape(-1, dim)
    gram = (flat @ flat.T).reshape(levels, words, levels, words)
    norms = (books * books).sum(axis=2)
    dots = (x @ flat.T).reshape(len(x), levels, words)
    rows = np.arange(len(x))[:, None]
    cost, codes, paths = np.zeros((len(x), 1), np.float32), np.zeros((len(x), 1, 0), np.int16), []
    for m in range(levels):
        d = cost[:, :, None] + (norms[m] - 2 * dots[:, m])[:, None, :]
        for p in range(m):
            d += 2 * gram[p, :, m][codes[:, :, p]]
        d = d.reshape(len(x), -1)
        # the cells need the full beam; a worse code only leaves more rows to the exact comparison, by its stored error
        keep = min(beam if m < DEPTH else max(beam // 2, 1), d.shape[1])
        best = np.argpartition(d, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1)
        cost = np.take_along_axis(d, best, 1)
        codes = np.concatenate([codes[rows, best // words], (best % words).astype(np.int16)[:, :, None]], axis=2)
        if m < DEPTH:
            paths.append(codes.copy())
    code = codes[:, 0]
    total = cost[:, 0] + 2 * np.einsum("nd,nd->n", x, books[np.arange(levels), code].sum(axis=1))
    return code.astype(np.uint8), (1 / np.sqrt(np.maximum(total, 1e-12))).astype(np.float32), paths


def _greedy(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The codewords that are nearest one level at a time: the address of a row's own cell."""
    left, out = x, []
    for c in books[:DEPTH]:
        a = np.argmax(left @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        out.append(a)
        left = left - c[a]
    return np.stack(out, axis=1)


def _merged(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, middle) of the first codewords: the first one that each is alike to, and the sum of those that share it.

    A group of near copies that is a large part of the table gets many codewords, which must not divide it.
    """
    u = words / (np.linalg.norm(words, axis=1, keepdims=True) + 1e-9)
    first = np.arange(len(words))
    for i in range(len(words)):
        if first[i] == i:
            first[i:] = np.where((first[i:] == np.arange(i, len(words))) & (u[i:] @ u[i] >= CORE), i, first[i:])
    middle = np.zeros_like(words)
    np.add.at(middle, first, words)
    return first, middle


def _core(x: np.ndarray, home: np.ndarray, books: np.ndarray, first: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """A number for each row whose bit d is set if the row is alike to the sum of the first d + 1 words of its address."""
    sums, bits = np.zeros_like(x), np.zeros(len(x), np.int32)
    for d in range(home.shape[1]):
        sums += books[d][home[:, d]]
        c = sums if d else middle[first[home[:, 0]]]
        bits |= (np.einsum("nd,nd->n", x, c) >= CORE * np.linalg.norm(c, axis=1)).astype(np.int32) << d
    return bits


def _address(path: np.ndarray) -> np.ndarray:
    """A number for each code prefix, different for prefixes of different length."""
    a = np.ones(path.shape[:-1], np.int64)
    for j in range(path.shape[-1]):
        a = a << 8 | path[..., j].astype(np.int64)
    return a


def _encoder(books: np.ndarray, dim: int):
    first, middle = _merged(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                s = b.slice(lo, 1024)
                raw, ids = np.ascontiguousarray(matrix(s.column(1), dim)), s.column(0)
                good = np.isfinite(raw).all(axis=1)
                if not good.all():
                    raw, ids = raw[good], ids.filter(pa.array(good))
                raw = raw + np.float32(0)  # -0 and 0 are the same number
                data = [r.tobytes() for r in raw]
                h = [hashlib.blake2b(r, digest_size=16).digest() for r in data]
                new = np.array([not (k in seen or seen.add(k)) for k in h], bool)
                x = unit(raw[new]) if new.any() else np.zeros((0, dim), np.float32)
                code, scale, paths = encode(x, books) if len(x) else (np.zeros((0, len(books)), np.uint8), np.zeros(0, np.float32), [])
                home = _greedy(x, books)
                core = _core(x, home, books, first, middle)
                for p in (home, *paths):
                    p[..., 0] = first[p[..., 0]]
                at = iter(range(len(x)))
                full = [next(at) if n else None for n in new]
                pick = pa.array(full, pa.int32())
                beams = [_address(p) for p in paths]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": ids, "h": pa.array(h, pa.binary()), "v": pa.array([r if n else None for r, n in zip(data, new)], pa.binary()),
                        "code": pa.array([r.tobytes() for r in code], pa.binary()).take(pick), "scale": pa.array(scale).take(pick),
                        **{f"home{d + 1}": pa.array(_address(home[:, : d + 1])).take(pick) for d in range(DEPTH)},
                        "core": pa.array(core).take(pick),
                        "beam": pa.array([r.tobytes() for r in np.concatenate(beams, axis=1)] if len(x) else [], pa.binary()).take(pick),
                    }
                )

    return run


_ENCODED = "id string, h binary, v binary, code binary, scale float, home1 long, home2 long, home3 long, home4 long, core int, beam binary"
_ROUTED = "cell long, block int, asks boolean, h binary, v binary, code binary, scale float"


def _router(split: dict[int, int], cores: set[int], blocks: dict[int, int], probes: tuple[int, ...]):
    """Sends each vector to its own cell, and as a query to the other cells of its beam.

    split: the cells that the next level divides; cores: those of them whose alike rows stay together, as cell -a.
    """

    def leaf_of(homes: tuple[int, ...]) -> int:
        return next((a for a in (ROOT, *homes) if a not in split), homes[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core = b.column("core").to_pylist()
            homes = list(zip(*(b.column(f"home{d + 1}").to_pylist() for d in range(DEPTH))))
            take, cell, block, asks = [], [], [], []
            for i, (hs, beam, h) in enumerate(zip(homes, b.column("beam").to_pylist(), b.column("h").to_pylist())):
                leaf = leaf_of(hs)
                through = [d for d, p in enumerate(hs) if p in cores and p != leaf]
                own = next((-hs[d] for d in through if core[i] >> d & 1), leaf)
                visits = {own: None, leaf: None} | dict.fromkeys(-hs[d] for d in through)
                a = np.frombuffer(beam, np.int64)
                at = 0
                for d in range(DEPTH):
                    width = min(probes[d], BEAM)
                    for p in a[at : at + width].tolist():
                        if p >> 8 in split and p not in split:
                            visits[p] = None
                        elif p in cores:
                            visits[-p] = None
                    at += min(BEAM, len(a) - at)
                mine = int.from_bytes(h[:4], "little") % blocks.get(own, 1)
                for c in visits:
                    for k in range(blocks.get(c, 1)):
                        take.append(i)
                        cell.append(c)
                        block.append(k)
                        asks.append(not (c == own and k == mine))
            t = pa.array(take, pa.int32())
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int64()), "block": pa.array(block, pa.int32()), "asks": pa.array(asks, pa.bool_())} | {c: b.column(c).take(t) for c in ("h", "v", "code", "scale")})

    return run


def slack(x: np.ndarray, books: np.ndarray, code: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """(2, rows): cosine and sine of the angle between each unit vector and the sum of its code's words."""
    near = np.zeros_like(x)
    for m in range(len(books)):
        near += books[m][code[:, m]]
    c = np.clip(np.einsum("nd,nd->n", x, near) * scale, -1, 1)
    return np.stack([c, np.sqrt(1 - c * c)]).astype(np.float32)


def _kth(near: np.ndarray, k: int) -> np.ndarray:
    n = near.shape[1]
    return np.partition(near, n - min(k, n), axis=1)[:, n - min(k, n)] if n else np.zeros(len(near), np.float32)


def rank(q: np.ndarray, x: np.ndarray, x32: np.ndarray, lut: np.ndarray, code: np.ndarray, scale: np.ndarray, off: np.ndarray, same: np.ndarray, k: int, least: float, shortlist: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the k best rows for each query, and of those as good as the last.

    The `shortlist` that the codes rank first are compared exactly; then every row is that can still reach the k-th
    of them and `least`: a query's angle to a row is no less than its angle to the row's code less that of code and
    row. q, x: unit vectors in float64; off: the latter angles (see `slack`); same: each query's own row or -1.
    """
    words = lut.shape[1] // code.shape[1]
    s = np.take(lut[:, :words], code[:, 0], axis=1)
    for m in range(1, code.shape[1]):
        s += np.take(lut[:, m * words : (m + 1) * words], code[:, m], axis=1)
    s *= scale
    n, q32 = s.shape[1], q.astype(np.float32)
    own = np.flatnonzero(same >= 0)
    s[own, same[own]] = -np.inf
    r = min(shortlist, n)
    c = np.argpartition(-s, r - 1, axis=1)[:, :r] if r < n else np.broadcast_to(np.arange(r), s.shape)
    near = np.empty(c.shape, np.float32)
    for lo in range(0, len(q), 64):
        if 6 * r > n:  # one product with all rows is cheaper than as many gathered ones
            near[lo : lo + 64] = np.take_along_axis(q32[lo : lo + 64] @ x32.T, c[lo : lo + 64], 1)
            continue
        near[lo : lo + 64] = np.matmul(x32[c[lo : lo + 64]], q32[lo : lo + 64, :, None])[:, :, 0]
    near[c == same[:, None]] = -np.inf
    last = _kth(near, k)
    more = []
    if r < n:
        s[own, same[own]] = 0
        np.clip(s, -1, 1, out=s)
        reach = s * off[0]
        reach += np.sqrt(1 - s * s) * off[1]
        open_ = reach >= (np.maximum(last, least) - 1e-4)[:, None]
        np.put_along_axis(open_, c, False, 1)
        open_[own, same[own]] = False
        todo = np.flatnonzero(open_.any(axis=1))
        for lo in range(0, len(todo), 64):
            t = todo[lo : lo + 64]
            i, j = np.nonzero(open_[t])
            if 20 * len(i) > len(t) * n:
                e = (q32[t] @ x32.T)[i, j]
            else:
                e = np.einsum("nd,nd->n", q32[t[i]], x32[j])
            at = e >= np.maximum(last[t[i]], least) - 4e-6
            i, j, e = i[at], j[at], e[at]
            if not len(i):
                continue
            # the k-th of the shortlist and the rows that reach it together
            rows, first, count = np.unique(i, return_index=True, return_counts=True)
            both = np.full((len(rows), k + count.max()), -np.inf, np.float32)
            both[:, : min(k, r)] = -np.partition(-near[t[rows]], min(k, r) - 1, axis=1)[:, : min(k, r)]
            both[np.repeat(np.arange(len(rows)), count), k + np.arange(len(i)) - np.repeat(first, count)] = e
            last[t[rows]] = _kth(both, k)
            more.append((t[i], j, e))
    i, j = np.nonzero(np.isfinite(near))
    i, j, near = (np.concatenate(p) for p in zip((i, c[i, j], near[i, j]), *more))
    # single precision tells the k best but for rounding; the rest is told apart by double precision and, at equal cosines, by id
    keep = (near >= last[i] - 4e-6) & (near >= least - 4e-6)
    i, j = i[keep], j[keep]
    exact = np.round(np.einsum("nd,nd->n", q[i], x[j]), 6)
    keep = exact >= least
    return i[keep], j[keep], exact[keep]


def _searcher(books: np.ndarray, dim: int, k: int, least: float, shortlist: int):
    flat = books.reshape(-1, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None

        def build() -> tuple:
            h = np.concatenate([p[0] for p in held])
            _, first = np.unique(h, return_index=True)
            v, code, scale = (np.concatenate([p[i] for p in held])[first] for i in (1, 2, 3))
            x = v.astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            x32 = x.astype(np.float32)
            return h[first], x, code, scale, x32, slack(x32, books, code, scale)

        def ask(h: np.ndarray, q: np.ndarray, same: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(q), 512):
                part = q[lo : lo + 512]
                i, j, e = rank(part, index[1], index[4], part.astype(np.float32) @ flat.T, index[2], index[3], index[5], same[lo : lo + 512], k, least, shortlist)
                if len(i):
                    yield pa.RecordBatch.from_pydict({"qh": pa.array(h[lo : lo + 512][i].tolist(), pa.binary()), "xh": pa.array(index[0][j].tolist(), pa.binary()), "similarity": pa.array(e)})

        for b in batches:
            cell, block, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "block", "asks"))
            h = np.array(b.column("h").to_pylist(), object)
            v = np.frombuffer(b"".join(b.column("v").to_pylist()), np.float32).reshape(-1, dim)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(h), -1)
            scale = b.column("scale").to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])]))
            for lo, hi in zip(new, [*new[1:], len(h)]):
                if key != (cell[lo], block[lo]):
                    if held:
                        if index is None:
                            index = build()
                            yield from ask(index[0], index[1], np.arange(len(index[0])))
                    key, held, index = (cell[lo], block[lo]), [], None
                if not asks[lo]:
                    held.append((h[lo:hi], v[lo:hi], code[lo:hi], scale[lo:hi]))
                elif held:
                    if index is None:
                        index = build()
                        yield from ask(index[0], index[1], np.arange(len(index[0])))
                    q = v[lo:hi].astype(np.float64)
                    q /= np.linalg.norm(q, axis=1, keepdims=True)
                    yield from ask(h[lo:hi], q, np.full(hi - lo, -1))
        if held and index is None:
            index = build()
            yield from ask(index[0], index[1], np.arange(len(index[0])))

    return run


def neighbours(
    df: DataFrame, k: int = 10, min_similarity: float | None = None, id_col: str = "shipment_id", vec_col: str = "embedding", dim: int = DIM,
    probes: tuple[int, ...] = (2, 6, 8, 8), max_cell: int = MAX_CELL, sample: int = SAMPLE, words: int = WORDS, shortlist: int | None = None,
) -> DataFrame:
    """(id, neighbour_id, similarity): the k most similar other vectors of every vector, those of min_similarity or more.

    probes: entries of the beam that a query visits at each depth of the cell tree, `BEAM` at most. shortlist: rows
    of a cell that are compared exactly at first, 4 k by default; it bears on the time, not on the result, as all
    others that can be among the k best follow.
    """
    rows = usable(df, id_col, vec_col, dim)
    total = df.count()
    train = bounded_sample(rows, sample, total)
    if not len(train):
        return rows.select("id", F.col("id").alias("neighbour_id"), F.lit(0.0).alias("similarity")).limit(0)
    books = fit(train, words=words)
    least = -2.0 if min_similarity is None else min_similarity
    coded = cut(rows.mapInArrow(_encoder(books, dim), _ENCODED))
    vectors = coded.filter("v is not null")
    # one number for each cell that holds more than max_cell vectors, so at most DEPTH * rows / max_cell of them
    homes = F.array(F.struct(F.lit(ROOT).cast("long").alias("cell"), F.lit(0).alias("core")), *(F.struct(F.col(f"home{d + 1}").alias("cell"), F.shiftright("core", d).bitwiseAND(1).alias("core")) for d in range(DEPTH)))
    over = vectors.select(F.inline(homes)).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("core").alias("core")).filter(F.col("n") > max_cell).collect()
    split = {r["cell"]: r["n"] for r in over}
    deepest = 1 << 8 * DEPTH
    blocks = {c: -(-n // max_cell) for c, n in split.items() if c >= deepest}
    split = {c: n for c, n in split.items() if c < deepest}
    cores = {r["cell"]: r["core"] for r in over if r["cell"] in split and r["core"] > LEAST_CORE}
    blocks |= {-c: -(-n // max_cell) for c, n in cores.items()}
    # as many partitions as there are about cells, so that a task holds a few cells whatever the size of the table
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // max_cell))
    routed = vectors.mapInArrow(_router(split, set(cores), blocks, probes), _ROUTED).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "asks")
    found = routed.mapInArrow(_searcher(books, dim, k, least, shortlist or 4 * k), "qh binary, xh binary, similarity double").distinct()
    return expand(coded.select("id", "h"), found, k)


def expand(members: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Lists of ids from lists of distinct vectors. members: (id, h); found: (qh, xh, similarity)."""
    members = members.distinct()
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).filter(F.col("r") <= k + 1)
    several = first.filter("r = 2").select(F.col("h").alias("qh"), F.col("h").alias("xh"), F.lit(1.0).alias("similarity"))
    lists = found.unionByName(several).join(first.select(F.col("h").alias("xh"), F.col("id").alias("neighbour_id")), "xh")
    lists = lists.withColumn("r", F.row_number().over(Window.partitionBy("qh").orderBy(F.desc("similarity"), "neighbour_id"))).filter(F.col("r") <= k + 1)
    out = lists.drop("r", "xh").join(members.select(F.col("h").alias("qh"), "id"), "qh").filter("id <> neighbour_id")
    out = out.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour_id"))).filter(F.col("r") <= k)
    return out.select("id", "neighbour_id", "similarity")
