"""Bootstrap, table writes and merges. Parquet has no MERGE: a new version is written beside the old one and swapped in."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import SCHEMAS


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key: a batch that repeats a key is written as if its rows came one after the other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows with those of incoming in place of the same keys. incoming has each key once."""
    return incoming.unionByName(existing.join(incoming.select(*keys), keys, "left_anti"))


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Existing rows and those of incoming whose key is new; of a key that incoming repeats, the first by order."""
    first = latest(incoming, keys, order or [F.lit(1)]) if order else incoming.dropDuplicates(keys)
    return existing.unionByName(first.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def cascade_delete(parents: DataFrame, gone: DataFrame, children: dict[str, tuple[DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Children without the rows that belong to deleted parents. children: name -> (table, its column, the parent's column)."""
    return {name: child.join(gone.select(F.col(parent).alias(column)), column, "left_anti") for name, (child, column, parent) in children.items()}


def violations(rows: DataFrame, keys: list[str], required: list[str] = (), among: dict[str, tuple] | None = None) -> DataFrame:
    """(rule, n) of the rules that rows break: repeated keys, nulls in required columns, values that are not among those allowed."""
    checks = {f"{c}_null": F.col(c).isNull() for c in required} | {f"{c}_value": ~F.col(c).isin(*some) for c, some in (among or {}).items()}
    one = rows.agg(*(F.count(F.when(bad, 1)).alias(name) for name, bad in checks.items()), F.count(F.lit(1)).alias("_all"))
    out = one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in checks))).alias("r")).select("r.rule", "r.n") if checks else None
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("key_repeated").alias("rule"), "n")
    return (repeated if out is None else out.unionByName(repeated)).filter("n > 0")


def enforced(rows: DataFrame, keys: list[str], required: list[str] = (), among: dict[str, tuple] | None = None) -> DataFrame:
    """rows, or ValueError with the rules that they break; to be asked before a table is written."""
    broken = {r["rule"]: r["n"] for r in violations(rows, keys, required, among).collect()}
    if broken:
        raise ValueError(f"constraints broken: {broken}")
    return rows


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def swap(df: DataFrame, path: str) -> None:
    """Write df as the table at path, which df may itself read; the old version goes once the new one is whole."""
    spark = df.sparkSession
    fs, p, of = _files(spark, path)
    new, old = of(path + ".new"), of(path + ".old")
    df.write.mode("overwrite").parquet(path + ".new")
    try:
        if fs.exists(p):
            fs.delete(old, True)
            fs.rename(p, old)
        fs.rename(new, p)
        fs.delete(old, True)
    except Py4JJavaError:
        if not fs.exists(p) and fs.exists(old):
            fs.rename(old, p)
        raise


def bootstrap(spark: SparkSession, base: str, seeds: list[tuple[str, Callable[[SparkSession], DataFrame]]] | None = None, dry_run: bool = False) -> DataFrame:
    """Create missing tables under base and insert the seed rows that are new; returns (table, rows).

    Seeds run in the order given. dry_run plans everything and writes nothing.
    """
    fs, _, of = _files(spark, base)
    made = {}
    for name, schema in SCHEMAS.items():
        path = f"{base}/{name}.parquet"
        made[name] = spark.read.parquet(path) if fs.exists(of(path)) else spark.createDataFrame([], schema)
        if not dry_run and not fs.exists(of(path)):
            made[name].write.parquet(path)
    keys = {"classification_categories": ["name"], "category_keywords": ["category_id", "keyword"], "shipment_labels": ["shipment_id"], "category_centroids": ["category_id"], "shipment_classifications": ["shipment_id"]}
    for name, rows in seeds or []:
        merged = insert_ignore(made[name], rows(spark), keys[name])
        if not dry_run:
            swap(merged, f"{base}/{name}.parquet")
            merged = spark.read.parquet(f"{base}/{name}.parquet")
        made[name] = merged
    return row_counts(made)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
