"""Nearest neighbours and clusters against brute force."""

import numpy as np
import pytest

from tidewright.llm import clusters, neighbours

DIM = 24
SCHEMA = "shipment_id string, embedding array<float>, h string, cell int"


def table(spark, x, extra=(), parts=5):
    rows = [(f"s{i:04d}", v.astype(np.float32).tolist(), "clash", 1) for i, v in enumerate(x)]
    rows += [(f"u{i}", v, "clash", 1) for i, v in enumerate(extra)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


BAD = [None, [], [1.0] * 3, [0.0] * DIM, [float("nan")] * DIM, [None] + [1.0] * (DIM - 1)]


def truth(x, k, least):
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for i in range(len(x)):
        best = sorted((-s[i, j], f"s{j:04d}") for j in range(len(x)) if j != i)[:k]
        out |= {(f"s{i:04d}", n) for c, n in best if -c >= least}
    return out


def points(n=400, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, DIM))
    x = centres[rng.integers(0, 20, n)] + 0.3 * rng.standard_normal((n, DIM))
    x[50:90] = x[50]  # a hot vector
    x[100] = 3 * x[101]
    return x


def test_one_cell_is_exact(spark):
    x = points()
    got = {(r["id"], r["neighbour_id"]) for r in neighbours.neighbours(table(spark, x, BAD), 10, 0.8, dim=DIM).collect()}
    assert got == truth(x, 10, 0.8)
    full = {(r["id"], r["neighbour_id"]) for r in neighbours.neighbours(table(spark, x, BAD), 5, dim=DIM).collect()}
    assert full == truth(x, 5, -2)


@pytest.mark.parametrize("cell", [60, 5])
def test_many_cells_keep_recall(spark, cell):
    x = points()
    want = truth(x, 10, 0.8)
    got = {(r["id"], r["neighbour_id"]) for r in neighbours.neighbours(table(spark, x), 10, 0.8, dim=DIM, max_cell=cell, words=8, probes=(8, 8, 8, 8)).collect()}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("cell", [4096, 100])
def test_near_copies_that_codes_cannot_order(spark, cell):
    rng = np.random.default_rng(3)
    dim = 96
    jitter = neighbours.unit(rng.standard_normal((300, dim)))
    x = np.concatenate([0.95 * np.eye(dim)[0] + 0.31 * jitter, rng.standard_normal((600, dim))])
    want = truth(x, 10, 0.8)
    got = {(r["id"], r["neighbour_id"]) for r in neighbours.neighbours(table(spark, x), 10, 0.8, dim=dim, max_cell=cell, words=16).collect()}
    assert len(want) == 3000
    assert len(got & want) >= (1 if cell > len(x) else 0.99) * len(want)


def test_few_rows(spark):
    assert neighbours.neighbours(table(spark, np.zeros((0, DIM)), BAD), 3, dim=DIM).isEmpty()
    one = np.ones((1, DIM))
    assert neighbours.neighbours(table(spark, one), 3, dim=DIM).isEmpty()
    same = neighbours.neighbours(table(spark, np.ones((3, DIM))), 5, dim=DIM).collect()
    assert sorted((r["id"], r["neighbour_id"], r["similarity"]) for r in same) == [(f"s000{i}", f"s000{j}", 1.0) for i in range(3) for j in range(3) if i != j]


def test_code_sums():
    rng = np.random.default_rng(1)
    x = neighbours.unit(rng.standard_normal((300, DIM)))
    books = neighbours.fit(x, levels=4, words=16)
    code, scale, paths = neighbours.encode(x, books)
    sums = books[np.arange(4), code].sum(axis=1)
    assert np.allclose(1 / scale, np.linalg.norm(sums, axis=1), atol=1e-3)
    greedy = x.copy()
    for c in books:
        greedy -= c[np.argmax(greedy @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)]
    # the beam is no worse than taking the nearest word level by level
    assert np.linalg.norm(x - sums, axis=1).mean() <= np.linalg.norm(greedy, axis=1).mean() + 1e-6
    assert [p.shape[2] for p in paths] == [1, 2, 3, 4]


def groups(seed=0, n=(40, 25, 12, 9)):
    rng = np.random.default_rng(seed)
    dim = 64
    c = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    x, own = [], []
    for g, m in enumerate(n):
        v = rng.standard_normal((m, dim))
        v -= np.outer(v @ c[g], c[g])
        x.append(0.8 * c[g] + 0.6 * v / np.linalg.norm(v, axis=1, keepdims=True))
        own += [g] * m
    noise = rng.standard_normal((150, dim))
    noise -= noise @ c[: len(n)].T @ c[: len(n)]
    return np.concatenate([*x, noise]), np.array(own + [-1] * 150), dim


@pytest.mark.parametrize("local", [4096, 60])
def test_clusters(spark, local):
    x, own, dim = groups()
    df = table(spark, x * 3, [None, [0.0] * dim, [1.0]])
    got = {r["id"]: r["cluster_id"] for r in clusters.clusters(df, 10, dim=dim, local=local).collect()}
    want = {}
    for g in (0, 1, 2):  # the fourth is under the least size
        ids = [f"s{i:04d}" for i in np.flatnonzero(own == g)]
        want |= dict.fromkeys(ids, min(ids))
    assert got == want


def test_bisection_parts_every_node():
    """Rows that two centres cannot part are halved; no group is lost in a node that stays as it is."""
    e = np.eye(8, dtype=np.float32)
    x = np.concatenate([np.repeat(e[:1], 6, 0), np.repeat(-e[:1], 6, 0), np.repeat(e[1:2], 6, 0), e[2:], -e[2:]])
    found = clusters.bisect(x)
    assert all(max(c @ want for c in found) > 0.99 for want in (e[0], -e[0], e[1]))


def test_hot_vector_is_a_cluster(spark):
    x = np.concatenate([np.tile(np.eye(16)[0], (300, 1)), np.eye(16)[1:9]])
    out = clusters.clusters(table(spark, x), 10, dim=16, local=50)
    assert out.count() == 300
    d = clusters.describe(out).first()
    assert (d["cluster_id"], d["size"], d["mean_cosine"], d["typical"]) == ("s0000", 300, 1.0, "s0000,s0001,s0002,s0003,s0004")
    assert clusters.clusters(table(spark, np.zeros((0, 16)), [None]), 10, dim=16).isEmpty()


def test_rounds_read_what_is_left_once(spark, monkeypatch):
    """Rows are held against the centres once a round, not in every pass over the tree."""
    x, _, dim = groups()
    seen, grow = [], clusters.grow
    monkeypatch.setattr(clusters, "grow", lambda rows, *a: seen.append((rows.count(), rows._jdf.queryExecution().toString())) or grow(rows, *a))
    clusters.clusters(table(spark, x), 10, dim=dim, local=50).count()
    assert seen[0][0] == len(x) > seen[-1][0] and not any("MapInArrow" in plan for _, plan in seen)


def test_dense_groups_are_found_whatever_the_splits(monkeypatch):
    rng = np.random.default_rng(3)
    means = neighbours.unit(rng.standard_normal((40, 96)))
    x = neighbours.unit(np.concatenate([np.repeat(means, 4, 0) + 0.05 * rng.standard_normal((160, 96)), 0.1 * rng.standard_normal((1500, 96))]))
    found = np.array(clusters.dense(x))
    assert ((means @ found.T).max(axis=1) > 0.9).all()
    monkeypatch.setattr(clusters, "AT_ONCE", 1 << 12)
    assert np.allclose(np.array(clusters.dense(x)), found, atol=1e-5)


def test_merging_in_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    x = neighbours.unit(np.repeat(rng.standard_normal((30, 16)), 4, 0) + 0.4 * rng.standard_normal((120, 16)))
    n, keep = rng.integers(1, 9, 120), []
    for i in np.argsort(-n, kind="stable"):
        if not keep or (x[keep] @ x[i]).max() < clusters.SAME:
            keep.append(i)
    monkeypatch.setattr(clusters, "MERGED_AT_ONCE", 7)
    assert (clusters.merged(x, n) == x[keep]).all()
