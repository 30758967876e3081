"""From texts to stored results: validation, gate, embedding, scores, bands, upsert; and the model from labelled texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import latest, upsert
from .centroids import centroid_build
from .dimensions import Model, load_model
from .embedding import embed_hashed
from .evaluation import sample_per_category
from .scoring import FLOOR, THRESHOLD, banded, joined_text, quality, scored, scores_map

#: Requests that one call may hold.
MOST_REQUESTS = 500
#: Adds `embedding` to a table by the texts of a column.
Embed = Callable[[DataFrame, Column], DataFrame]


def errors(requests: DataFrame) -> DataFrame:
    """(shipment_id, requested_at, error) of the requests that are not valid: a text is missing, or the threshold is not between 0 and 1. A missing threshold is the default."""
    checks = ((F.col("cargo_description").isNull(), "cargo_description"), (F.col("commodity_description").isNull(), "commodity_description"), (~F.col("threshold").between(0, 1), "threshold"))
    found = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in checks)), lambda x: x.isNotNull())
    return requests.select("shipment_id", "requested_at", F.explode(found).alias("error"))


def valid(requests: DataFrame) -> DataFrame:
    """The requests whose threshold is between 0 and 1, a missing one being the default; missing texts go on to the gate, which stops them."""
    return requests.withColumn("threshold", F.coalesce("threshold", F.lit(THRESHOLD))).filter(F.col("threshold").between(0, 1))


def one_call(requests: DataFrame, most: int = MOST_REQUESTS) -> DataFrame:
    """The requests of one call; ValueError when there are more than it may hold."""
    if requests.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} requests")
    return requests


def predict(records: DataFrame, model: Model, threshold: Column | float = THRESHOLD, floor: float = FLOOR, embed: Embed = embed_hashed, cargo: str = "cargo_description", commodity: str = "commodity_description", dim: int = 384) -> DataFrame:
    """Gate, embed, score and band texts in one plan without a shuffle; keeps the vector, null where the gate stopped the text."""
    text = joined_text(F.col(cargo), F.col(commodity))
    rows = embed(records.drop("embedding"), F.when(quality(text) == "ok", text))
    has = F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("embedding", F.when(has, F.col("embedding"))).withColumn("_vector", F.col("embedding"))
    return banded(scored(rows, model, cargo, commodity, "_vector", dim), model, threshold, floor)


def results(predicted: DataFrame, model: Model, version: str, clock: Column) -> DataFrame:
    """Predictions as rows of shipment_classifications."""
    return predicted.select(
        "shipment_id", F.col("embedding").cast("array<float>").alias("embedding"), "categories", scores_map(model).alias("scores"), "confidence_state", "reason",
        F.col("threshold_used").cast("decimal(4,3)").alias("threshold_used"), F.lit(version).alias("model_version"), clock.alias("classified_at"),
    )


def last_requests(requests: DataFrame) -> DataFrame:
    """Of the requests to be stored the last of each shipment, as if they were written one after the other."""
    order = [F.desc_nulls_last("requested_at"), F.desc_nulls_last("cargo_description"), F.desc_nulls_last("commodity_description"), F.desc_nulls_last("threshold")]
    return latest(requests.filter("persist"), ["shipment_id"], order)


def persist(existing: DataFrame, requests: DataFrame, model: Model, version: str, clock: Column, embed: Embed = embed_hashed) -> DataFrame:
    """shipment_classifications with the results of the requests that ask for it in place of the same shipments."""
    rows = last_requests(valid(requests))
    return upsert(existing, results(predict(rows, model, F.col("threshold"), embed=embed), model, version, clock), ["shipment_id"])


def built_from_labels(labels: DataFrame, categories: DataFrame, n: int = 2000, embed: Embed = embed_hashed, dim: int = 384) -> DataFrame:
    """(name, centroid, sample_count) from at most n training texts of each active category."""
    some = sample_per_category(labels, categories, n)
    text = joined_text(F.col("cargo_text"), F.col("commodity_text"))
    return centroid_build(embed(some.select(F.col("category").alias("name"), text.alias("_text")), F.col("_text")), "name", "embedding", dim)


def model_from_labels(labels: DataFrame, categories: DataFrame, keywords: DataFrame, n: int = 2000, embed: Embed = embed_hashed, dim: int = 384) -> Model:
    """The model whose centroids are built from labelled texts by the embedder that predicts."""
    built = built_from_labels(labels, categories, n, embed, dim).join(categories.select(F.col("id").alias("category_id"), "name"), "name")
    return load_model(categories, built.withColumn("updated_at", F.lit(None).cast("timestamp")).drop("name"), keywords, dim)


def evaluated(samples: DataFrame, model: Model, sample: str, cargo: str, commodity: str, embed: Embed = embed_hashed) -> DataFrame:
    """(sample, expected, scores) of labelled texts, each scored once; a text that was not scored has no scores and stays a sample."""
    names = F.array(*(F.lit(n) for n in model.names))
    rows = predict(samples, model, embed=embed, cargo=cargo, commodity=commodity)
    pairs = F.arrays_zip(names.alias("name"), F.col("final").alias("score"))
    none = F.array().cast("array<struct<name:string,score:double>>")
    return rows.select(F.col(sample).alias("sample"), "expected", F.coalesce(F.when(F.col("final").isNotNull(), pairs), none).alias("scores"))


def health(model: Model, version: str, spark) -> DataFrame:
    """One row: status, categories_loaded, model_version."""
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(len(model.names)).alias("categories_loaded"), F.lit(version).alias("model_version"))
