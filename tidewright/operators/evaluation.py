"""Splits, samples, label sets and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import label

# Fixed grid of the sweep.
SWEEP = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)


def split_assign(labels: DataFrame, rules: dict[str, str], default: str = "train", id_col: str = "shipment_id") -> DataFrame:
    """Resets split to the default, then sets it for the ids that match a rule; of two rules that match, the later holds."""
    c: Column = F.lit(default)
    for name, pattern in rules.items():
        c = F.when(F.col(id_col).rlike(pattern), name).otherwise(c)
    return labels.withColumn("split", c)


def group_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def sample_per_category(labels: DataFrame, categories: DataFrame, n: int = 2000, seed: str = "7", split: str = "train") -> DataFrame:
    """At most n rows of the split for each active category, in the order of a seeded hash; ids break ties."""
    rows = labels.filter(label(F.col("split"), "train") == split).withColumn("category", label(F.col("category_name")))
    rows = rows.join(categories.filter("is_active").select(F.col("name").alias("category")), "category")
    w = Window.partitionBy("category").orderBy(F.md5(F.concat(F.lit(seed), F.lit("|"), F.col("id").cast("string"))), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def labels_grouped(labels: DataFrame, split: str) -> DataFrame:
    """(shipment_id, cargo_text, commodity_text, expected): one sample for each shipment, with the set of its categories in order.

    Raises ValueError when the split has no rows.
    """
    rows = labels.filter(label(F.col("split"), "train") == split)
    if rows.isEmpty():
        raise ValueError(f"no labels in split {split!r}")
    return rows.groupBy("shipment_id").agg(
        F.max("cargo_text").alias("cargo_text"), F.max("commodity_text").alias("commodity_text"), F.sort_array(F.collect_set(label(F.col("category_name")))).alias("expected")
    )


def label_set(c: Column) -> Column:
    """A cell of labels as a set: split at commas, trimmed, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def csv_samples(spark: SparkSession, path: str) -> DataFrame:
    """(cargo, commodity, expected) of a CSV file with the header cargo, commodity, expected_labels; ValueError when it has no rows."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, schema="cargo string, commodity string, expected_labels string", enforceSchema=False)
    if rows.isEmpty():
        raise ValueError(f"no samples in {path}")
    return rows.select(F.coalesce("cargo", F.lit("")).alias("cargo"), F.coalesce("commodity", F.lit("")).alias("commodity"), label_set(F.coalesce("expected_labels", F.lit(""))).alias("expected"))


def write_csv(samples: DataFrame, path: str) -> None:
    """Samples (cargo, commodity, expected) as the CSV files that csv_samples reads."""
    rows = samples.select("cargo", "commodity", F.array_join("expected", ",").alias("expected_labels"))
    rows.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def confirmed(samples: DataFrame, threshold: float, floor: float) -> DataFrame:
    """The figures of the held-out samples at the one threshold that was chosen before."""
    return sweep(predictions(samples, (threshold,), floor))


def report_lines(swept: DataFrame) -> DataFrame:
    """(threshold, line): the sweep as lines of text."""
    return swept.select("threshold", F.format_string("%10.2f  %10.4f  %8.4f  %8.4f  %5d  %5d  %5d  %5d", "threshold", "precision", "recall", "f1", "tp", "fp", "fn", "n_samples").alias("line"))


def predictions(samples: DataFrame, thresholds: tuple[float, ...], floor: float) -> DataFrame:
    """(sample, expected, threshold, predicted) from samples (sample, expected, scores: array<struct<name, score>>).

    Scores are read once for all thresholds: a sample grows by as many rows as there are thresholds, not by re-scoring.
    """
    top = F.array_max(F.transform("scores", lambda s: s["score"]))
    best = F.array_min(F.transform(F.filter("scores", lambda s: s["score"] == F.col("top")), lambda s: s["name"]))
    rows = samples.withColumn("top", F.greatest(F.lit(0.0), F.coalesce(top, F.lit(0.0)))).withColumn("best", best)
    rows = rows.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    over = F.transform(F.filter("scores", lambda s: s["score"] >= F.col("threshold")), lambda s: s["name"])
    none = F.array().cast("array<string>")
    predicted = F.when(F.col("top") < floor, none).when(F.col("top") < F.col("threshold"), F.array("best")).otherwise(over)
    return rows.select("sample", "expected", "threshold", predicted.alias("predicted"))


def counted(pred: DataFrame) -> DataFrame:
    """Adds tp, fp and fn to each row of predictions()."""
    return pred.withColumns(
        {
            "tp": F.size(F.array_intersect("predicted", "expected")), "fp": F.size(F.array_except("predicted", "expected")), "fn": F.size(F.array_except("expected", "predicted")),
        }
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def sweep(pred: DataFrame) -> DataFrame:
    """(threshold, n_samples, tp, fp, fn, precision, recall, f1): micro averages to 4 digits, F1 from the unrounded values."""
    t = counted(pred).groupBy("threshold").agg(F.count(F.lit(1)).alias("n_samples"), *(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    t = t.withColumn("p", p).withColumn("r", r).withColumn("f", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return t.select("threshold", "n_samples", "tp", "fp", "fn", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round("f", 4).alias("f1"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The row of the best rounded F1; at equal F1 the lowest threshold."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)


def per_category(pred: DataFrame) -> DataFrame:
    """(threshold, category, tp, fp, fn, precision, recall) of the categories that occur."""
    both = F.array_union("predicted", "expected")
    rows = pred.withColumn("category", F.explode(both))
    hit, want = F.array_contains("predicted", F.col("category")), F.array_contains("expected", F.col("category"))
    t = rows.groupBy("threshold", "category").agg(
        F.count(F.when(hit & want, 1)).alias("tp"), F.count(F.when(hit & ~want, 1)).alias("fp"), F.count(F.when(~hit & want, 1)).alias("fn")
    )
    return t.withColumns({"precision": F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4), "recall": F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4)})
