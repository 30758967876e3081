"""The registered queries: each takes a session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label
from ..functions.vectors import doubles, is_usable
from ..functions.vectors import l2_normalise as unit
from ..operators import centroids as C
from ..operators import dimensions as D
from ..operators import discovery as X
from ..operators import embedding as B
from ..operators import evaluation as E
from ..operators import pipeline as P
from ..operators import scoring as S
from ..operators import search as N
from ..runtime import scratch
from ..sources import sinks
from ..sources.schemas import SPLITS, STATES
from ..sources.tables import table
from ..streaming import classify as K

#: Ids ending in these digits are held out.
SPLIT_RULES = {"validation": r"[0-9]*[78]$", "test": r"[0-9]*9$"}
#: Keywords given by category name.
SEED_KEYWORDS = (("circuitry", "oscillators"), ("pantry", "preserves"), ("pantry", "cordials"), ("foundry", "castings"), ("no_such_category", "nothing"))
VERSION = "enc-384-v2"
CLOCK = "2026-01-01 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _model(spark: SparkSession, base: str) -> D.Model:
    return D.load_model(*(table(spark, base, t) for t in ("classification_categories", "category_centroids", "category_keywords")))


def _requests(spark: SparkSession, base: str) -> DataFrame:
    vectors = table(spark, base, "shipment_classifications").select("shipment_id", "embedding")
    return table(spark, base, "classify_requests").join(vectors, "shipment_id", "left")


def _scored(spark: SparkSession, base: str) -> tuple[DataFrame, D.Model]:
    m = _model(spark, base)
    return S.scored(_requests(spark, base), m), m


def _banded(spark: SparkSession, base: str, threshold=S.THRESHOLD, floor: float = S.FLOOR) -> tuple[DataFrame, D.Model]:
    df, m = _scored(spark, base)
    return S.banded(df, m, threshold, floor), m


def _named(df: DataFrame) -> DataFrame:
    return df.select("shipment_id", "requested_at", "confidence_state", "reason", F.array_join("categories", ",").alias("categories"), "max_score")


def _label_model(spark: SparkSession, base: str) -> D.Model:
    """The model whose centroids come from the training texts, in the space of the hashed embedder."""
    return P.model_from_labels(*(table(spark, base, t) for t in ("shipment_labels", "classification_categories", "category_keywords")))


def _samples(spark: SparkSession, base: str, split: str) -> DataFrame:
    """The labelled texts of a split, scored once by the model of the training texts; expected are their labels."""
    rows = E.labels_grouped(table(spark, base, "shipment_labels"), split)
    return P.evaluated(rows, _label_model(spark, base), "shipment_id", "cargo_text", "commodity_text")


def _csv(spark: SparkSession, base: str) -> DataFrame:
    """The test split written as CSV files into the shared folder, and read from there."""
    path = scratch(spark, "csv")
    rows = E.labels_grouped(table(spark, base, "shipment_labels"), "test")
    E.write_csv(rows.select(F.col("cargo_text").alias("cargo"), F.col("commodity_text").alias("commodity"), "expected"), path)
    return E.csv_samples(spark, path)


@query
def active_centroids(spark: SparkSession, base: str) -> DataFrame:
    rows = D.active_centroids(table(spark, base, "classification_categories"), table(spark, base, "category_centroids"))
    return rows.select("category_id", "name", "sample_count", F.size("centroid").alias("dim"))


@query
def active_keywords(spark: SparkSession, base: str) -> DataFrame:
    return D.active_keywords(table(spark, base, "classification_categories"), table(spark, base, "category_keywords")).orderBy("name", "keyword")


@query
def text_quality(spark: SparkSession, base: str) -> DataFrame:
    text = S.joined_text(F.col("cargo_description"), F.col("commodity_description"))
    return table(spark, base, "classify_requests").select("shipment_id", "requested_at", text.alias("text")).withColumn("quality", S.quality(F.col("text")))


@query
def keyword_hits(spark: SparkSession, base: str) -> DataFrame:
    df, m = _scored(spark, base)
    names = F.array(*(F.lit(n) for n in m.names))
    rows = df.select("shipment_id", "requested_at", F.explode("hits").alias("h"))
    return rows.select("shipment_id", "requested_at", F.element_at(names, F.col("h.c") + 1).alias("name"), F.col("h.k").alias("keyword"))


@query
def keyword_scores(spark: SparkSession, base: str) -> DataFrame:
    df, m = _scored(spark, base)
    names = F.array(*(F.lit(n) for n in m.names))
    z = F.explode(F.arrays_zip(names.alias("name"), F.col("keyword").alias("keyword_score"))).alias("z")
    return df.select("shipment_id", "requested_at", z).select("shipment_id", "requested_at", "z.name", "z.keyword_score").filter("keyword_score > 0")


@query
def semantic_scores(spark: SparkSession, base: str) -> DataFrame:
    m = _model(spark, base)
    names = F.array(*(F.lit(n) for n in m.names))
    rows = S.with_semantic(table(spark, base, "shipment_classifications").select("shipment_id", "embedding"), m, "embedding").filter("semantic is not null")
    z = F.explode(F.arrays_zip(names.alias("name"), F.col("semantic").alias("semantic_score"))).alias("z")
    return rows.select("shipment_id", z).select("shipment_id", "z.name", "z.semantic_score")


@query
def blended_scores(spark: SparkSession, base: str) -> DataFrame:
    df, m = _scored(spark, base)
    return S.long_form(df, m, ["shipment_id", "requested_at"])


@query
def classify_bands(spark: SparkSession, base: str) -> DataFrame:
    return _named(_banded(spark, base)[0])


@query
def classify_bands_tuned(spark: SparkSession, base: str) -> DataFrame:
    return _named(_banded(spark, base, 0.40, 0.20)[0])


@query
def classify_batch(spark: SparkSession, base: str) -> DataFrame:
    m = _model(spark, base)
    return _named(S.banded(S.scored(P.valid(_requests(spark, base)), m), m, F.col("threshold")))


@query
def request_errors(spark: SparkSession, base: str) -> DataFrame:
    return P.errors(table(spark, base, "classify_requests"))


@query
def predict_batch(spark: SparkSession, base: str) -> DataFrame:
    rows = P.valid(table(spark, base, "classify_requests"))
    return _named(P.predict(rows, _label_model(spark, base), F.col("threshold")))


@query
def persist_results(spark: SparkSession, base: str) -> DataFrame:
    done = P.persist(table(spark, base, "shipment_classifications"), table(spark, base, "classify_requests"), _label_model(spark, base), VERSION, F.lit(CLOCK).cast("timestamp"))
    return done.select(
        "shipment_id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"), F.array_join("categories", ",").alias("categories"), F.size("scores").alias("n_scores"),
        "confidence_state", "reason", "threshold_used", "model_version", "classified_at",
    )


@query
def stream_classify(spark: SparkSession, base: str) -> DataFrame:
    """The requests' table, one file or a folder of them, as a stream; what has arrived is classified, written once and read."""
    out = scratch(spark, "stream")
    vectors = table(spark, base, "shipment_classifications").select("shipment_id", "embedding")
    K.run_once(K.classify_stream(K.read_requests(spark, f"{base}/classify_requests.parquet"), vectors, _model(spark, base)), f"{out}/checkpoint", f"{out}/table")
    return spark.read.parquet(f"{out}/table")


@query
def health(spark: SparkSession, base: str) -> DataFrame:
    return P.health(_model(spark, base), VERSION, spark)


@query
def low_confidence_top1(spark: SparkSession, base: str) -> DataFrame:
    rows = _banded(spark, base)[0].filter("confidence_state = 'low_confidence'")
    return rows.select("shipment_id", "requested_at", F.element_at("categories", 1).alias("category"), "max_score")


@query
def multi_label_assign(spark: SparkSession, base: str) -> DataFrame:
    rows = _banded(spark, base)[0].filter("confidence_state = 'classified'")
    return rows.select("shipment_id", "requested_at", F.explode("categories").alias("category"))


@query
def scores_json(spark: SparkSession, base: str) -> DataFrame:
    """The JSON of every record's scores, read again: one row for each category."""
    df, m = _banded(spark, base)
    kind = "map<string,struct<semantic_score:double,keyword_score:double,final_score:double,matched:boolean,keywords_hit:array<string>>>"
    rows = df.select("shipment_id", "requested_at", F.to_json(S.scores_map(m)).alias("scores"))
    rows = rows.select("shipment_id", "requested_at", F.explode(F.from_json("scores", kind)).alias("name", "s"))
    return rows.select("shipment_id", "requested_at", "name", "s.semantic_score", "s.keyword_score", "s.final_score", "s.matched", F.size("s.keywords_hit").alias("hits"))


@query
def response_envelope(spark: SparkSession, base: str) -> DataFrame:
    """The response to every request, and its fields read from the JSON."""
    m = _model(spark, base)
    df = S.banded(S.scored(P.valid(_requests(spark, base)), m), m, F.col("threshold"))
    rows = df.select("requested_at", S.envelope(df, m, F.lit(CLOCK).cast("timestamp"), VERSION).alias("r"))
    field = lambda path, kind="string": F.get_json_object("r", f"$.{path}").cast(kind)
    return rows.select(
        field("shipment_id").alias("shipment_id"), "requested_at", field("input.cargo_description").alias("cargo_description"), field("result.confidence_state").alias("confidence_state"),
        field("result.threshold", "double").alias("threshold"), field("result.reason").alias("reason"), F.coalesce(F.json_array_length(field("result.categories")), F.lit(0)).alias("n_categories"),
        field("meta.model_version").alias("model_version"), field("meta.total_categories", "int").alias("total_categories"), field("meta.classified_at").alias("classified_at"),
    )


@query
def l2_normalise(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "shipment_classifications").filter(is_usable(F.col("embedding"), 384))
    return rows.select("shipment_id", F.posexplode(unit(doubles(F.col("embedding")))).alias("pos", "x")).select("shipment_id", "pos", F.round("x", 6).alias("value"))


@query
def centroid_build(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "shipment_classifications").select("embedding", F.explode("categories").alias("name"))
    built = C.centroid_build(rows, "name", "embedding")
    return built.select("name", "sample_count", F.posexplode("centroid").alias("pos", "x")).select("name", "sample_count", "pos", F.round("x", 6).alias("value"))


@query
def centroid_upsert(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "shipment_classifications").select("embedding", F.explode("categories").alias("name"))
    built = C.centroid_build(rows, "name", "embedding").withColumn("updated_at", F.lit(CLOCK).cast("timestamp"))
    return C.centroid_upsert(table(spark, base, "category_centroids"), built, table(spark, base, "classification_categories")).select("category_id", "sample_count", "updated_at")


@query
def split_assign(spark: SparkSession, base: str) -> DataFrame:
    return E.split_assign(table(spark, base, "shipment_labels"), SPLIT_RULES).select("id", "split")


@query
def split_distribution(spark: SparkSession, base: str) -> DataFrame:
    return E.group_count(table(spark, base, "shipment_labels").select(label(F.col("split"), "train").alias("split")), "split").orderBy("split")


@query
def train_rows_per_category(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "shipment_labels").filter(label(F.col("split"), "train") == "train").select(label(F.col("category_name")).alias("category"))
    return E.group_count(rows, "category").orderBy("category")


@query
def sample_per_category(spark: SparkSession, base: str) -> DataFrame:
    return E.sample_per_category(table(spark, base, "shipment_labels"), table(spark, base, "classification_categories")).select("category", "id", "rank")


@query
def labels_grouped(spark: SparkSession, base: str) -> DataFrame:
    return E.labels_grouped(table(spark, base, "shipment_labels"), "validation").withColumn("expected", F.array_join("expected", ","))


@query
def csv_label_sets(spark: SparkSession, base: str) -> DataFrame:
    return _csv(spark, base).select("cargo", "commodity", F.array_join(F.sort_array("expected"), ",").alias("expected"))


@query
def centroids_from_labels(spark: SparkSession, base: str) -> DataFrame:
    built = P.built_from_labels(table(spark, base, "shipment_labels"), table(spark, base, "classification_categories"))
    return built.select("name", "sample_count", F.posexplode("centroid").alias("pos", "x")).select("name", "sample_count", "pos", F.round("x", 6).alias("value")).filter("value <> 0")


@query
def threshold_sweep(spark: SparkSession, base: str) -> DataFrame:
    return E.sweep(E.predictions(_samples(spark, base, "validation"), E.SWEEP, S.FLOOR))


@query
def best_threshold(spark: SparkSession, base: str) -> DataFrame:
    return E.best_threshold(threshold_sweep(spark, base)).select("threshold", "f1")


@query
def sweep_report(spark: SparkSession, base: str) -> DataFrame:
    return E.report_lines(threshold_sweep(spark, base))


@query
def per_category_prf(spark: SparkSession, base: str) -> DataFrame:
    return E.per_category(E.predictions(_samples(spark, base, "validation"), (0.35, 0.45, 0.55), S.FLOOR))


@query
def test_confirmation(spark: SparkSession, base: str) -> DataFrame:
    return E.confirmed(_samples(spark, base, "test"), S.THRESHOLD, S.FLOOR)


@query
def csv_sweep(spark: SparkSession, base: str) -> DataFrame:
    rows = P.evaluated(_csv(spark, base).withColumn("sample", F.lit("")), _label_model(spark, base), "sample", "cargo", "commodity")
    return E.sweep(E.predictions(rows, E.SWEEP, S.FLOOR))


@query
def missing_centroids(spark: SparkSession, base: str) -> DataFrame:
    have = table(spark, base, "category_centroids").select(F.col("category_id").alias("id"))
    return table(spark, base, "classification_categories").join(have, "id", "left_anti").select("id", "name")


@query
def centroid_freshness(spark: SparkSession, base: str) -> DataFrame:
    rows = D.active_centroids(table(spark, base, "classification_categories"), table(spark, base, "category_centroids"))
    return rows.select("name", "sample_count", "updated_at").orderBy(F.desc_nulls_first("updated_at"), "name")


def _queue(spark: SparkSession, base: str, state: str) -> DataFrame:
    rows = table(spark, base, "shipment_classifications").filter(label(F.col("confidence_state"), "classified") == state)
    return rows.orderBy(F.desc_nulls_first("classified_at"), "shipment_id")


@query
def review_queue(spark: SparkSession, base: str) -> DataFrame:
    return _queue(spark, base, "unclassified").select("shipment_id", "reason", "classified_at")


@query
def low_confidence_queue(spark: SparkSession, base: str) -> DataFrame:
    return _queue(spark, base, "low_confidence").select("shipment_id", F.array_join("categories", ",").alias("categories"), "classified_at")


@query
def contains_all(spark: SparkSession, base: str) -> DataFrame:
    wanted = F.array(F.lit("circuitry"))
    rows = table(spark, base, "shipment_classifications").filter(F.col("categories").isNotNull() & (F.size(F.array_except(wanted, "categories")) == 0))
    return rows.select("shipment_id", F.array_join("categories", ",").alias("categories"))


@query
def nearest_neighbours(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "shipment_classifications")
    ref = rows.filter(is_usable(F.col("embedding"), 384)).orderBy("shipment_id").limit(1)
    return N.nearest(rows, ref, 10, "shipment_id", "embedding")


@query
def knn_join(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "shipment_classifications")
    asked = rows.filter(F.regexp_extract("shipment_id", "([0-9]+)$", 1).cast("long") % 20 == 0)
    return N.knn_join(asked, rows, 5, "shipment_id", "embedding").select("query_id", "neighbour_id", "similarity")


@query
def upsert_merge(spark: SparkSession, base: str) -> DataFrame:
    old = table(spark, base, "shipment_classifications").select("shipment_id", "confidence_state", "classified_at")
    new = table(spark, base, "classify_requests").filter("persist").select("shipment_id", F.lit("requested").alias("confidence_state"), F.col("requested_at").alias("classified_at"))
    new = sinks.latest(new, ["shipment_id"], [F.desc_nulls_last("classified_at")])
    return sinks.upsert(old, new, ["shipment_id"])


@query
def insert_ignore(spark: SparkSession, base: str) -> DataFrame:
    old = table(spark, base, "classification_categories").select("name", "display_name")
    new = table(spark, base, "shipment_labels").select(F.col("category_name").alias("name"), F.lit("unnamed").alias("display_name")).filter("name is not null")
    return sinks.insert_ignore(old, new, ["name"])


@query
def seed_keyword_join(spark: SparkSession, base: str) -> DataFrame:
    seed = spark.createDataFrame(list(SEED_KEYWORDS), "name string, keyword string")
    rows = table(spark, base, "classification_categories").select(F.col("id").alias("category_id"), "name").join(seed, "name").select("category_id", "keyword")
    old = table(spark, base, "category_keywords").select("category_id", "keyword")
    return sinks.insert_ignore(old, rows, ["category_id", "keyword"])


@query
def cascade_delete(spark: SparkSession, base: str) -> DataFrame:
    gone = table(spark, base, "classification_categories").filter("name = 'pantry'")
    left = sinks.cascade_delete(
        table(spark, base, "classification_categories"), gone,
        {"category_keywords": (table(spark, base, "category_keywords"), "category_id", "id"), "category_centroids": (table(spark, base, "category_centroids"), "category_id", "id"), "shipment_labels": (table(spark, base, "shipment_labels"), "category_name", "name")},
    )
    return sinks.row_counts(left)


@query
def constraint_violations(spark: SparkSession, base: str) -> DataFrame:
    labels, done = table(spark, base, "shipment_labels"), table(spark, base, "shipment_classifications")
    cats = table(spark, base, "classification_categories").select(F.col("name").alias("category_name"))
    rules = [
        ("label_split", labels.filter(~F.col("split").isin(*SPLITS))),
        ("label_text_null", labels.filter("cargo_text is null or commodity_text is null")),
        ("label_category_unknown", labels.join(cats, "category_name", "left_anti")),
        ("keyword_repeated", table(spark, base, "category_keywords").groupBy("category_id", "keyword").count().filter("count > 1")),
        ("label_shipment_repeated", labels.groupBy("shipment_id").count().filter("count > 1")),
        ("classification_state", done.filter(~F.col("confidence_state").isin(*STATES))),
        ("classification_vector", done.filter("embedding is not null and size(embedding) <> 384")),
    ]
    return sinks.row_counts(dict(rules)).select(F.col("table_name").alias("rule"), F.col("n").alias("violations"))


@query
def row_counts(spark: SparkSession, base: str) -> DataFrame:
    names = ("classification_categories", "category_keywords", "category_centroids", "shipment_labels", "shipment_classifications", "classify_requests")
    return sinks.row_counts({n: table(spark, base, n) for n in names})


@query
def unclassified_vectors(spark: SparkSession, base: str) -> DataFrame:
    return X.unclassified_vectors(table(spark, base, "shipment_classifications")).select("shipment_id")


def _points(spark: SparkSession, base: str) -> DataFrame:
    return X.unclassified_vectors(table(spark, base, "shipment_classifications")).select(F.col("shipment_id").alias("id"), F.col("embedding").alias("v"))


@query
def core_distance(spark: SparkSession, base: str) -> DataFrame:
    return X.core_distance(_points(spark, base)).select("id", F.round("core", 5).alias("core"))


@query
def mutual_reachability(spark: SparkSession, base: str) -> DataFrame:
    return X.mutual_reachability(_points(spark, base)).select("id", F.round("reach", 5).alias("reach"))


@query
def hdbscan_clusters(spark: SparkSession, base: str) -> DataFrame:
    return X.hdbscan(_points(spark, base), 10, 5)


def _given_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Classified rows under their first category, a given clustering; the rest is noise."""
    first = F.coalesce(F.get("categories", F.lit(0)), F.lit("-1"))
    return table(spark, base, "shipment_classifications").select(F.col("shipment_id").alias("id"), first.alias("cluster"), "embedding")


@query
def category_summary(spark: SparkSession, base: str) -> DataFrame:
    return X.cluster_summary(_given_clusters(spark, base).select("id", "cluster"))


@query
def category_hint(spark: SparkSession, base: str) -> DataFrame:
    built = C.centroid_build(_given_clusters(spark, base).filter("cluster <> '-1'"), "cluster", "embedding")
    return X.cluster_hint(built, _model(spark, base), "cluster")


@query
def cluster_summary(spark: SparkSession, base: str) -> DataFrame:
    return X.cluster_summary(hdbscan_clusters(spark, base))


@query
def cluster_hint(spark: SparkSession, base: str) -> DataFrame:
    rows = hdbscan_clusters(spark, base).filter("cluster >= 0").join(_points(spark, base), "id")
    return X.cluster_hint(C.centroid_build(rows, "cluster", "v"), _model(spark, base), "cluster")


@query
def embed_batches(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "shipment_labels").select("id", "cargo_text", "commodity_text")
    return B.embed_hashed(rows, F.concat("cargo_text", F.lit(" "), "commodity_text")).select("id", F.posexplode("embedding").alias("pos", "x")).filter("x <> 0").select("id", "pos", F.round(F.col("x").cast("double"), 5).alias("value"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
