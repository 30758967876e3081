"""Formatting duplicates, overlaps between splits and balanced samples, against brute force."""

import random
import re
import unicodedata
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest

from tidewright.llm import formatting, sampling, splits

SCHEMA = "id int, split string, source string, category_name string, cargo_text string, commodity_text string, words string, cid int, h128 string"


def canon(s):
    return "".join(c for c in s.upper().lower() if not c.isspace() and unicodedata.category(c)[0] not in "PZ")


def present(s):
    return s is not None and s.strip() != ""


def words(s):
    return Counter(re.findall(r"[^\W_]+", s.upper().lower()))


def noisy(r, s):
    k = r.randrange(6)
    return [s, s.upper(), s.replace(" ", "  "), f"({s})!", s.replace(" ", " –"), s.replace(" ", "_")][k]


def labels(n=160, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = [(" ".join(r.choices(vocab, k=8)), " ".join(r.choices(vocab, k=7))) for _ in range(30)]
    out = []
    for i in range(n):
        a, b = r.choice(base)
        if r.random() < 0.5:
            t = a.split()
            for _ in range(r.randrange(4)):
                t[r.randrange(len(t))] = r.choice(vocab)
            a = " ".join(t)
        a, b = noisy(r, a), noisy(r, b)
        if r.random() < 0.2:
            a, b = b, a
        if r.random() < 0.08:
            a = r.choice([None, "", "  "])
        out.append((i, r.choice(["train", " Train", None, "validation", "TEST ", "other"]), r.choice(["s1", None]), r.choice(["x", " X ", "y", None]), a, b, "clash", 1, "clash"))
    out += [(n, "train", None, "x", "tiny", "one", "", 1, ""), (n + 1, "test", None, "x", "one", "tiny", "", 1, ""), (n + 2, "test", None, "x", "!!", "??", "", 1, ""), (n + 3, "train", None, "x", "--", "..", "", 1, "")]
    long_ = " ".join(f"z{i}" for i in range(900))
    out += [(n + 4, "train", "s1", "x", long_, long_ + " extra", "", 1, ""), (n + 5, "validation", "s1", "x", long_, long_ + " other words", "", 1, "")]
    return out


def test_copies_match_brute_force(spark):
    data = labels()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    groups = {}
    for row in data:
        if present(row[4]) and present(row[5]):
            groups.setdefault(tuple(sorted((canon(row[4]), canon(row[5])))), []).append(row[0])
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in formatting.copies(df).collect()} == want
    assert sorted(r["copies"] for r in formatting.collapse(df).collect()) == sorted(map(len, groups.values()))
    assert formatting.conflicts(formatting.groups(formatting.keyed(df, ("cargo_text", "commodity_text"), "id"))).isEmpty()


def test_overlaps_match_brute_force(spark):
    data = labels()
    side = lambda s: "train" if s is None else s.strip().lower()
    ok = [r for r in data if present(r[4]) and present(r[5])]
    want = set()
    for e in ok:
        for t in ok:
            if side(e[1]) in ("validation", "test") and side(t[1]) == "train":
                a, b = words(f"{e[4]} {e[5]}"), words(f"{t[4]} {t[5]}")
                most = max(sum(a.values()), sum(b.values()))
                same = sorted((canon(e[4]), canon(e[5]))) == sorted((canon(t[4]), canon(t[5])))
                if same or (most and 4 * sum((a & b).values()) >= 3 * most):
                    want.add((min(e[0], t[0]), max(e[0], t[0])))
    members, pairs = splits.overlaps(spark.createDataFrame(data, SCHEMA).repartition(4))
    got = [tuple(r) for r in splits.row_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    near = sum(r["exact"] + r["near"] for r in splits.report(members, pairs).collect())
    evals = {r[0] for r in ok if side(r[1]) in ("validation", "test")}
    assert near == len({i for p in want for i in p if i in evals})


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert formatting.copies(df).isEmpty() and formatting.collapse(df).isEmpty()
    assert splits.row_pairs(*splits.overlaps(df)).isEmpty()
    targets = spark.createDataFrame([("train", "x", Decimal("0.5"), 1)], "split string, category_name string, target_share decimal(5,4), min_rows int")
    assert [tuple(r) for r in sampling.unmet(sampling.report(df, targets)).collect()] == [("train", "x")]


def test_flight_keeps_totals_and_expectations():
    rng = np.random.default_rng(0)
    pi, group = rng.random(40), rng.integers(0, 3, 40)
    for g in range(3):  # whole totals
        m = group == g
        pi[m] *= np.floor(pi[m].sum()) / pi[m].sum()
    got = np.array([sampling.flight(pi, group, np.random.default_rng(s)) for s in range(3000)])
    for g in range(3):
        assert np.allclose(got[:, group == g].sum(axis=1), pi[group == g].sum())
    assert ((got > 0) & (got < 1)).sum(axis=1).max() <= 3
    assert np.abs(got.mean(axis=0) - pi).max() < 0.05


def test_sample_meets_targets(spark):
    r = random.Random(1)
    data = [(i, r.choice([None, "train", "Test"]), r.choice(["x", " X", "y", "z", None])) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, split string, category_name string").repartition(7)
    targets = spark.createDataFrame(
        [("train", "x", Decimal("0.5"), 5), ("train", "y", Decimal("0.3"), 5), ("train", "none", Decimal("0.1"), 2), ("test", "z", Decimal("0.01"), 30), ("test", "y", Decimal("0.0"), 100000)],
        "split string, category_name string, target_share decimal(5,4), min_rows int",
    )
    rep = {(x["split"], x["category_name"]): x for x in sampling.report(df, targets).collect()}
    n = sum(1 for _, s, _ in data if s in (None, "train")) // 5
    assert rep["train", "x"]["drawn"] == -(-n // 2) and all(x["residual"] == 0 for x in rep.values())
    assert rep["test", "z"]["drawn"] == 30 and rep["test", "y"]["drawn"] == rep["test", "y"]["available"]
    assert {tuple(x) for x in sampling.unmet(sampling.report(df, targets)).collect()} == {("train", "none"), ("test", "y")}
    ids = [x["id"] for x in sampling.sample(df, targets).collect()]
    assert len(ids) == len(set(ids))


@pytest.mark.parametrize("size", [50])
def test_many_batches_in_a_partition(spark, size):
    """What a batch leaves undecided joins the next one, whatever Arrow says about nulls."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        df = spark.createDataFrame([(i, "train" if i % 2 else None, "x") for i in range(1000)], "id int, split string, category_name string").coalesce(1)
        targets = spark.createDataFrame([("train", "x", Decimal("1.0"), 1)], "split string, category_name string, target_share decimal(5,4), min_rows int")
        assert sampling.report(df, targets).first()["drawn"] == 200
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
