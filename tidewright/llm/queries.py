"""The pN_ queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..functions.text import label
from . import clusters, evalleak, formatting, neighbours, packing, pii, sampling, splits

#: File of the public tokenizer that measures texts where nothing else is set.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    found = neighbours.neighbours(table(spark, base, "shipment_classifications"), k=10, min_similarity=0.80)
    return found.select(F.col("id").alias("shipment_id"), "neighbour_id")


def p1_neighbours(spark: SparkSession, base: str) -> DataFrame:
    found = neighbours.neighbours(table(spark, base, "shipment_classifications"), k=10, probes=(8, 8, 8, 8), shortlist=400)
    return found.select(F.col("id").alias("shipment_id"), "neighbour_id", "similarity")


def _unclassified(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "shipment_classifications").filter(label(F.col("confidence_state"), "classified") == "unclassified")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return clusters.clusters(_unclassified(spark, base)).select(F.col("id").alias("shipment_id"), "cluster_id")


def p2_clusters(spark: SparkSession, base: str) -> DataFrame:
    return clusters.describe(clusters.clusters(_unclassified(spark, base)))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return formatting.copies(table(spark, base, "shipment_labels"))


def p3_records(spark: SparkSession, base: str) -> DataFrame:
    return formatting.collapse(table(spark, base, "shipment_labels"))


def p3_conflicts(spark: SparkSession, base: str) -> DataFrame:
    """The collision check: 128-bit hashes that more than one text has."""
    rows = formatting.conflicts(formatting.groups(formatting.keyed(table(spark, base, "shipment_labels"), ("cargo_text", "commodity_text"), "id")))
    return rows.select(F.hex("h128").alias("hash"), "texts")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return splits.row_pairs(*splits.overlaps(table(spark, base, "shipment_labels")))


def p4_report(spark: SparkSession, base: str) -> DataFrame:
    return splits.report(*splits.overlaps(table(spark, base, "shipment_labels")))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return sampling.unmet(p5_report(spark, base))


def p5_report(spark: SparkSession, base: str) -> DataFrame:
    return sampling.report(table(spark, base, "shipment_labels"), table(spark, base, "sample_targets"))


def p5_sample(spark: SparkSession, base: str) -> DataFrame:
    return sampling.sample(table(spark, base, "shipment_labels"), table(spark, base, "sample_targets"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """In the tokens that the tables' description defines."""
    return packing.longer_than_container(packing.pack(packing.word_sizes(table(spark, base, "documents"))))


def p6_packed(spark: SparkSession, base: str) -> DataFrame:
    """In tokens of a public tokenizer, whose file the setting tidewright.tokenizer names."""
    return packing.pack(packing.tokenizer_sizes(table(spark, base, "documents"), spark.conf.get("tidewright.tokenizer", TOKENIZER)))


def p6_containers(spark: SparkSession, base: str) -> DataFrame:
    return packing.containers(p6_packed(spark, base))


def p6_certificates(spark: SparkSession, base: str) -> DataFrame:
    return packing.certificates(p6_packed(spark, base))


def _leaks(spark: SparkSession, base: str) -> DataFrame:
    return evalleak.leaks(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return _leaks(spark, base).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, base: str) -> DataFrame:
    return evalleak.leaked_items(_leaks(spark, base))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return pii.mentions(table(spark, base, "documents")).select("doc_id", "pii_type", "start_char").distinct()


def p8_redacted(spark: SparkSession, base: str) -> DataFrame:
    return pii.redacted(table(spark, base, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
