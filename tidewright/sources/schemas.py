"""Declared schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampType()
_SCORE = T.StructType(
    [T.StructField("semantic_score", T.DoubleType()), T.StructField("keyword_score", T.DoubleType()), T.StructField("final_score", T.DoubleType()), T.StructField("matched", T.BooleanType()), T.StructField("keywords_hit", T.ArrayType(_S))]
)

CATEGORIES = T.StructType(
    [T.StructField("id", _I, False), T.StructField("name", _S, False), T.StructField("display_name", _S, False), T.StructField("description", _S), T.StructField("is_active", T.BooleanType()), T.StructField("created_at", _TS), T.StructField("updated_at", _TS)]
)
KEYWORDS = T.StructType(
    [T.StructField("id", _I, False), T.StructField("category_id", _I, False), T.StructField("keyword", _S, False), T.StructField("weight", T.DecimalType(3, 2)), T.StructField("created_at", _TS)]
)
CENTROIDS = T.StructType(
    [T.StructField("category_id", _I, False), T.StructField("centroid", T.ArrayType(T.FloatType()), False), T.StructField("sample_count", _I), T.StructField("updated_at", _TS)]
)
LABELS = T.StructType(
    [T.StructField("id", _I, False), T.StructField("shipment_id", _S, False), T.StructField("category_name", _S, False), T.StructField("cargo_text", _S), T.StructField("commodity_text", _S), T.StructField("split", _S)]
)
CLASSIFICATIONS = T.StructType(
    [T.StructField("shipment_id", _S, False), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("categories", T.ArrayType(_S)), T.StructField("scores", T.MapType(_S, _SCORE)), T.StructField("confidence_state", _S), T.StructField("reason", _S), T.StructField("threshold_used", T.DecimalType(4, 3)), T.StructField("model_version", _S), T.StructField("classified_at", _TS)]
)

SCHEMAS = {"classification_categories": CATEGORIES, "category_keywords": KEYWORDS, "category_centroids": CENTROIDS, "shipment_labels": LABELS, "shipment_classifications": CLASSIFICATIONS}
SPLITS = ("train", "validation", "test")
STATES = ("classified", "low_confidence", "unclassified")
