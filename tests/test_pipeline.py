"""From texts to stored results, and the evaluation that starts from labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import evaluation as E
from tidewright.operators import pipeline as P
from tidewright.operators import scoring as S
from tidewright.operators.dimensions import Model
from tidewright.sources import sinks
from tidewright.streaming import classify as K

REQUEST = "shipment_id string, cargo_description string, commodity_description string, threshold double, persist boolean, requested_at timestamp"
def clock():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def requests(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(*r[:5], datetime(2026, 1, r[5])) for r in rows], REQUEST)


@pytest.fixture(scope="module")
def model(spark):
    labels = spark.createDataFrame([(1, "pipes", "steel pipes", "for water", None), (2, "Pipes ", "copper pipes", "for gas", "train"), (3, "fruit", "fresh apples", "from farms", " TRAIN"), (4, "fruit", "ripe pears", "from farms", "test")], "id int, category_name string, cargo_text string, commodity_text string, split string")
    cats = spark.createDataFrame([(1, "pipes", True), (2, "fruit", True), (3, "none", True)], "id int, name string, is_active boolean")
    words = spark.createDataFrame([(1, "pipe", None), (2, "Apple", 2.0)], "category_id int, keyword string, weight double")
    return P.model_from_labels(labels, cats, words)


def test_model_from_labels(model):
    assert model.names == ("fruit", "pipes") and np.allclose(np.linalg.norm(model.matrix, axis=1), 1) and len(model.keywords) == 2


def test_requests_are_checked(spark):
    rows = requests(spark, [("a", None, "x", 0.5, True, 1), ("b", "c", "d", 1.5, True, 1), ("c", "c", "d", None, False, 1)])
    assert sorted((r["shipment_id"], r["error"]) for r in P.errors(rows).collect()) == [("a", "cargo_description"), ("b", "threshold")]
    assert {r["shipment_id"]: r["threshold"] for r in P.valid(rows).collect()} == {"a": 0.5, "c": 0.45}
    assert P.one_call(rows, 3).count() == 3
    with pytest.raises(ValueError, match="more than 2"):
        P.one_call(rows, 2)


def test_predict_and_persist(spark, model, tmp_path):
    """The same id twice in a batch: the last one is kept; without persist nothing is written."""
    rows = requests(spark, [("s1", "fresh apples", "from farms", 0.45, True, 1), ("s1", "steel pipes", "for water", 0.45, True, 2), ("s2", "cargo", None, 0.45, True, 1), ("s3", "copper pipes", "for gas", 0.45, False, 1), ("s4", "----------", "!!!", 0.45, True, 1)])
    got = {(r["shipment_id"], r["requested_at"].day): r for r in P.predict(rows, model, F.col("threshold")).collect()}
    assert got["s1", 1]["categories"] == ["fruit"] and got["s1", 2]["categories"] == ["pipes"] and got["s2", 1]["reason"] == "insufficient_input" and got["s4", 1]["embedding"] is None
    old = P.results(P.predict(requests(spark, [("s9", "steel pipes", "for water", 0.45, True, 1)]), model), model, "v0", clock())
    for _ in range(2):
        new = P.persist(old, rows, model, "v1", clock())
        found = {r["shipment_id"]: r for r in new.collect()}
        assert set(found) == {"s1", "s2", "s4", "s9"} and found["s1"]["categories"] == ["pipes"] and found["s9"]["model_version"] == "v0" and found["s1"]["model_version"] == "v1"
        assert found["s2"]["scores"] == {} and found["s1"]["scores"]["pipes"]["matched"] and len(found["s1"]["embedding"]) == 384
    base, stream = str(tmp_path / "done"), str(tmp_path / "in")
    old.write.parquet(base)
    rows.write.parquet(stream)
    for _ in range(2):  # the second run finds nothing new
        K.persist_stream(K.read_requests(spark, stream), base, model, "v1", clock(), str(tmp_path / "c"))
        assert {r["shipment_id"]: r["model_version"] for r in spark.read.parquet(base).collect()} == {"s1": "v1", "s2": "v1", "s4": "v1", "s9": "v0"}


def test_evaluation_counts_what_was_not_scored(spark, model):
    """An empty prediction against a label is a false negative."""
    rows = spark.createDataFrame([("1", "steel pipes", "for water", ["pipes"]), ("2", "x", None, ["fruit"])], "shipment_id string, cargo_text string, commodity_text string, expected array<string>")
    swept = E.sweep(E.predictions(P.evaluated(rows, model, "shipment_id", "cargo_text", "commodity_text"), (0.45,), S.FLOOR))
    r = swept.first()
    assert (r["n_samples"], r["tp"], r["fp"], r["fn"]) == (2, 1, 0, 1)
    assert E.report_lines(swept).first()["line"].split() == ["0.45", "1.0000", "0.5000", "0.6667", "1", "0", "1", "2"]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(' a "b", c ', "d", ["x", "y"]), ("e\nf", "", [])], "cargo string, commodity string, expected array<string>")
    E.write_csv(rows, str(tmp_path / "s"))
    assert sorted(map(str, E.csv_samples(spark, str(tmp_path / "s")).collect())) == sorted(map(str, rows.collect()))


def test_constraints(spark):
    rows = spark.createDataFrame([(1, "a", "train"), (1, None, "x")], "id int, name string, split string")
    assert {r["rule"]: r["n"] for r in sinks.violations(rows, ["id"], ["name"], {"split": ("train",)}).collect()} == {"name_null": 1, "split_value": 1, "key_repeated": 1}
    with pytest.raises(ValueError, match="key_repeated"):
        sinks.enforced(rows, ["id"])
    assert sinks.enforced(rows.limit(1), ["id"], ["name"]).count() == 1


def test_keyword_automaton():
    m = Model(("a", "b"), np.eye(2), ((0, "led", 1.0), (0, "le", 1.0), (1, "led", 2.0), (1, "", 0.5)))
    for text in ("", "led lamp", "apple", "sledge"):
        want = sorted(i for i, (_, k, _) in enumerate(m.keywords) if k in text)
        plain = S.Keywords(m)
        assert plain(text) == want
        plain.automaton = None
        assert plain(text) == want
