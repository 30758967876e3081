import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import centroids as C
from tidewright.operators import discovery as X
from tidewright.operators import embedding as B
from tidewright.operators import evaluation as E
from tidewright.operators import search as N
from tidewright.sources import sinks


def test_sweep_and_best(spark):
    score = "array<struct<name:string,score:double>>"
    df = spark.createDataFrame([("1", ["a"], [("a", 0.6), ("b", 0.5)]), ("2", ["b"], [("a", 0.4), ("b", 0.4)]), ("3", ["c"], [("a", 0.1)])], f"sample string, expected array<string>, scores {score}")
    p = E.predictions(df, (0.45, 0.55), 0.35)
    got = {r["threshold"]: r for r in E.sweep(p).collect()}
    # sample 2 is below either threshold: the first name of the best scores is taken
    assert (got[0.55]["tp"], got[0.55]["fp"], got[0.55]["fn"]) == (1, 1, 2) and (got[0.45]["tp"], got[0.45]["fp"]) == (1, 2)
    assert E.best_threshold(E.sweep(p)).first()["threshold"] == 0.55
    assert sum(r["tp"] + r["fn"] for r in E.per_category(p).filter("threshold = 0.45").collect()) == 3


def test_csv_samples(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text('cargo,commodity,expected_labels\n"a, ""x""","b","p, q ,p"\nc,,\n')
    assert [(r["cargo"], r["commodity"], r["expected"]) for r in E.csv_samples(spark, str(f)).collect()] == [('a, "x"', "b", ["p", "q"]), ("c", "", [])]
    f.write_text("cargo,commodity,expected_labels\n")
    with pytest.raises(ValueError):
        E.csv_samples(spark, str(f))


def test_centroids(spark):
    df = spark.createDataFrame([("a", [2.0, 0.0]), ("a", [0.0, 1.0]), ("b", None), ("c", [0.0, 0.0])], "k string, v array<float>")
    got = {r["k"]: r for r in C.centroid_build(df, "k", "v", 2).collect()}
    assert set(got) == {"a"} and got["a"]["sample_count"] == 2 and np.allclose(got["a"]["centroid"], [2**-0.5] * 2)
    opposite = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [-1.0, 0.0])], "k string, v array<float>")
    with pytest.raises(Exception, match="mean is zero"):
        C.centroid_build(opposite, "k", "v", 2).collect()


def test_merges(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    once = sinks.upsert(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "z"), (3, "w")] == sorted(map(tuple, sinks.upsert(once, new, ["id"]).collect()))
    assert sorted(map(tuple, sinks.insert_ignore(old, new.union(new), ["id"]).collect())) == [(1, "x"), (2, "y"), (3, "w")]


def test_bootstrap_is_idempotent(spark, tmp_path):
    seed = [("classification_categories", lambda s: s.createDataFrame([(1, "a", "A", None, True, None, None)], "id int, name string, display_name string, description string, is_active boolean, created_at timestamp, updated_at timestamp"))]
    for _ in range(2):
        counts = {r["table_name"]: r["n"] for r in sinks.bootstrap(spark, str(tmp_path), seed).collect()}
        assert counts["classification_categories"] == 1 and counts["shipment_labels"] == 0


def test_search(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8)).round(2)
    x[7] = x[3]
    df = spark.createDataFrame([(f"r{i:02d}", v.tolist()) for i, v in enumerate(x)] + [("zz", None)], "id string, v array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    got = N.knn_join(df.filter("id < 'r05'"), df.repartition(3), 4, "id", "v", 8).collect()
    for i in range(5):
        want = sorted((-s[i, j], f"r{j:02d}") for j in range(60) if j != i)[:4]
        mine = sorted((-r["similarity"], r["neighbour_id"]) for r in got if r["query_id"] == f"r{i:02d}")
        assert [n for _, n in mine] == [n for _, n in want]
    top = N.nearest(df, df.filter("id = 'r03'"), 3, "id", "v", 8).collect()
    assert [r["id"] for r in top[:2]] == ["r03", "r07"]


def test_hdbscan_finds_dense_groups(spark):
    rng = np.random.default_rng(1)
    a, b = (c + 0.05 * rng.standard_normal((15, 16)) for c in (np.eye(16)[0], np.eye(16)[1]))
    x = np.concatenate([a, b, rng.standard_normal((6, 16))])
    df = spark.createDataFrame([(f"{i:02d}", v.tolist()) for i, v in enumerate(x)], "id string, v array<float>")
    got = {r["id"]: r["cluster"] for r in X.hdbscan(df, 10, 3, 16).collect()}
    assert len({got[f"{i:02d}"] for i in range(15)}) == 1 and len({got[f"{i:02d}"] for i in range(15, 30)}) == 1
    assert got["00"] == 0 and got["15"] == 1 and {got[f"{i:02d}"] for i in range(30, 36)} <= {-1, 0, 1}
    assert {r["cluster"] for r in X.hdbscan(df.limit(5), 10, 3, 16).collect()} == {-1}


def test_embedding_is_deterministic(spark):
    df = spark.createDataFrame([(1, "Red pipes, red"), (2, "PIPES red Red"), (3, None)], "id int, t string")
    got = {r["id"]: r["embedding"] for r in B.embed_hashed(df, F.col("t"), 16).collect()}
    assert got[1] == got[2] and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and not any(got[3])
    flat = {r["id"]: r["e"] for r in df.select("id", B.hashed(F.col("t"), 16).alias("e")).collect()}
    assert np.allclose(flat[1], got[1], atol=1e-6)
    own = B.embed_with(df, F.col("t"), lambda ts: np.array([[len(t), 1] for t in ts]))
    assert {r["id"]: r["embedding"][0] for r in own.collect()} == {1: 14, 2: 13, 3: 0}


def test_stream(spark, tmp_path):
    from tidewright.operators.dimensions import Model
    from tidewright.streaming import classify as K

    model = Model(("a",), np.eye(384)[:1], ())
    rows = spark.createDataFrame([("s1", "long enough text", "here", None, None)], "shipment_id string, cargo_description string, commodity_description string, threshold double, requested_at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    vectors = spark.createDataFrame([("s1", np.eye(384)[0].tolist())], "shipment_id string, embedding array<float>")
    for _ in range(2):  # the second run finds nothing new
        K.run_once(K.classify_stream(K.read_requests(spark, str(tmp_path / "in")), vectors, model), str(tmp_path / "c"), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("shipment_id", "confidence_state", "categories").collect()] == [("s1", "classified", "a")]


@pytest.mark.parametrize("parts", [0, 20])
def test_stream_of_a_table(spark, tmp_path, parts):
    """The requests' table is one file among others or a folder of files, and is read whole either way."""
    import os

    from tidewright.plans.queries import queries
    from tidewright.sources.tables import table

    given, base, name = "/root/testdata/sf0.001", tmp_path / "base", "classify_requests.parquet"
    base.mkdir()
    for f in os.listdir(given):
        if f != name or not parts:
            (base / f).symlink_to(f"{given}/{f}")
    rows = table(spark, given, name[:-8])
    if parts:
        rows.repartition(parts).write.parquet(str(base / name))
    want = sorted(map(str, queries()["classify_bands"](spark, given).select("shipment_id", "max_score").collect()))
    got = queries()["stream_classify"](spark, str(base))
    assert sorted(map(str, got.select("shipment_id", "max_score").collect())) == want
