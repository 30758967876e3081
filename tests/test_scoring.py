"""Scoring against a plain Python model of the same rules, and the bands' edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import scoring as S
from tidewright.operators.dimensions import Model, load_model

DIM = 4
MODEL = Model(("a", "b", "c"), np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], float), ((0, "led", 1.5), (0, "lamp", 0.5), (1, "pipe", 1.0)))


def plain(cargo, commodity, v, threshold, floor):
    text = f"{cargo or ''} {commodity or ''}".strip()
    if len(text) < 10 or text.lower() in S.GENERIC or v is None or len(v) != DIM or not any(v):
        return "unclassified", "insufficient_input", [], None
    u = np.array(v, float) / np.linalg.norm(v)
    final = {}
    for i, n in enumerate(MODEL.names):
        own = [(k, w) for c, k, w in MODEL.keywords if c == i]
        kw = S._round(np.array(sum(w for k, w in own if k in text.lower()) / sum(w for _, w in own)), 3) if own else 0.0
        final[n] = float(S._round(np.array(float(S._round(u @ MODEL.matrix[i], 4)) * 0.8 + kw * 0.2), 4))
    top = max(0.0, *final.values())
    if top < floor:
        return "unclassified", "low_similarity", [], top
    if top < threshold:
        return "low_confidence", None, [min(final, key=lambda n: (-final[n], n))], top
    return "classified", None, [n for n in final if final[n] >= threshold], top


def rows(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        v = r.choice([None, [], [0.0] * DIM, [1.0], [r.uniform(-1, 1) for _ in range(DIM)], [r.uniform(0, 1) for _ in range(DIM)], [1.0, 0.0, 0.0, 0.0]])
        out.append((str(i), r.choice(["LED lamps", "goods", None, "steel Pipe \t", "general"]), r.choice(["for export", "", None, "cargo", "cheap led"]), v, r.choice([0.3, 0.45, 0.8])))
    return out


SCHEMA = "shipment_id string, cargo_description string, commodity_description string, embedding array<float>, t double"


def test_bands_follow_the_rules(spark):
    data = rows(300)
    df = S.banded(S.scored(spark.createDataFrame(data, SCHEMA), MODEL, dim=DIM), MODEL, F.col("t"), 0.35)
    got = {r["shipment_id"]: r for r in df.collect()}
    for i, cargo, commodity, v, t in data:
        state, reason, cats, top = plain(cargo, commodity, v, t, 0.35)
        r = got[i]
        assert (r["confidence_state"], r["reason"], r["categories"]) == (state, reason, cats), (cargo, commodity, v, t)
        assert r["max_score"] == (None if top is None else pytest.approx(top, abs=1e-9))
        assert (r["categories"] == []) == (state == "unclassified")
        assert state != "low_confidence" or len(r["categories"]) == 1


def test_order_and_partitioning_do_not_matter(spark):
    data = rows(80, 2)
    one = S.banded(S.scored(spark.createDataFrame(data, SCHEMA).coalesce(1), MODEL, dim=DIM), MODEL)
    many = S.banded(S.scored(spark.createDataFrame(data[::-1], SCHEMA).repartition(5), MODEL, dim=DIM), MODEL)
    pick = lambda d: sorted((r["shipment_id"], r["confidence_state"], tuple(r["categories"])) for r in d.collect())
    assert pick(one) == pick(many)


def test_gate(spark):
    texts = {"": "too_short", "misc": "too_short", "goods": "too_short", "general cargo": "generic", "As per INVOICE": "generic", "cargo goods": "ok", "\t general merchandise \n": "generic"}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.quality(S.joined_text(F.col("t"), F.lit(""))).alias("q"))
    assert {r["t"]: r["q"] for r in df.collect()} == texts


def test_scores_map_and_envelope(spark):
    df = S.banded(S.scored(spark.createDataFrame([("1", "LED lamps", "for export", [1.0, 0.0, 0.0, 0.0], 0.5), ("2", "x", None, None, 0.5)], SCHEMA), MODEL, dim=DIM), MODEL)
    m = {r["shipment_id"]: r["m"] for r in df.select("shipment_id", S.scores_map(MODEL).alias("m")).collect()}
    assert m["2"] == {} and set(m["1"]) == {"a", "b", "c"}
    assert sorted(m["1"]["a"]["keywords_hit"]) == ["lamp", "led"] and m["1"]["a"]["matched"] and not m["1"]["b"]["matched"]
    e = {r["shipment_id"]: r["e"] for r in df.select("shipment_id", S.envelope(df, MODEL, F.current_timestamp(), "v").alias("e")).collect()}
    assert '"reason"' in e["2"] and '"reason"' not in e["1"]


def test_without_categories(spark):
    empty = Model((), np.zeros((0, DIM)), ())
    df = S.banded(S.scored(spark.createDataFrame([("1", "LED lamps", "for export", [1.0, 0.0, 0.0, 0.0], 0.5)], SCHEMA), empty, dim=DIM), empty)
    assert [(r["confidence_state"], r["reason"]) for r in df.collect()] == [("unclassified", "low_similarity")]


def test_dimensions(spark):
    cats = spark.createDataFrame([(1, "b", True), (2, "a", True), (3, "off", False), (4, "null", None)], "id int, name string, is_active boolean")
    cent = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "category_id int, centroid array<float>").withColumn("sample_count", F.lit(1)).withColumn("updated_at", F.current_timestamp())
    kw = spark.createDataFrame([(1, "PIPE", None), (2, "Led", 0.5), (4, "x", 1.0)], "category_id int, keyword string, weight double")
    m = load_model(cats, cent, kw, 2)
    assert m.names == ("a", "b") and m.keywords == ((0, "led", 0.5), (1, "pipe", 1.0)) and m.totals == [0.5, 1.0]
