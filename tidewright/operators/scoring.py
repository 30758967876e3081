"""Gate, similarity, keyword score, blend and bands.

Scoring is local to a record: the dimensions are small and go to the executors, so classifying a table of any size
needs no shuffle. The records' scores are kept in arrays in the order of the model's names; `long_form` explodes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..functions.vectors import is_usable, rows_of, unit_rows
from .dimensions import Model

# Fixed values of the classifier: weights, bands, the shortest text and the phrases that say nothing.
SEMANTIC_WEIGHT, KEYWORD_WEIGHT, FLOOR, THRESHOLD, SHORTEST = 0.8, 0.2, 0.35, 0.45, 10
GENERIC = (
    "cargo", "goods", "items", "as per invoice", "general merchandise", "various",
    "misc", "miscellaneous", "freight", "shipment", "commodity", "general cargo",
)


def joined_text(cargo: Column, commodity: Column) -> Column:
    """Both fields with a blank between them, without white space at the ends; a null field is empty."""
    return strip(F.concat(F.coalesce(cargo, F.lit("")), F.lit(" "), F.coalesce(commodity, F.lit(""))))


def quality(text: Column) -> Column:
    """too_short, generic or ok, tested in this order."""
    t = F.lower(text)
    return F.when(F.length(t) < SHORTEST, "too_short").when(t.isin(*GENERIC), "generic").otherwise("ok")


def _round(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as round() of SQL does."""
    f = 10.0**digits
    return np.sign(x) * np.floor(np.abs(x) * f + 0.5) / f + 0.0


_HITS = T.ArrayType(T.StructType([T.StructField("c", T.IntegerType()), T.StructField("k", T.StringType())]))


def _lists(values: np.ndarray, ok: np.ndarray, width: int) -> pa.Array:
    """Rows of values as lists, null where not ok."""
    offsets = np.concatenate([[0], np.cumsum(np.where(ok, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.concatenate([~ok, [False]])), pa.array(values.ravel(), pa.float64()))


def _cosines(v: pa.Array, ok: np.ndarray, m: np.ndarray, dim: int) -> np.ndarray:
    return _round(unit_rows(rows_of(v.filter(pa.array(ok)), dim)) @ m.T, 4) if ok.any() else np.zeros((0, len(m)))


def with_semantic(df: DataFrame, model: Model, vec_col: str, dim: int = 384) -> DataFrame:
    """Adds `semantic` in place of the vector: cosines with the model's centroids to 4 digits; null where it is unusable."""
    m = model.matrix

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.num_columns - 1)
            ok = v.is_valid().to_numpy(zero_copy_only=False)
            keep = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _lists(_cosines(v, ok, m, dim), ok, len(m))], [*keep, "semantic"])

    v = F.when(is_usable(F.col(vec_col), dim), F.col(vec_col).cast("array<float>"))
    plain = df.drop(vec_col)
    columns = plain.columns
    schema = T.StructType(list(plain.schema.fields)).add("semantic", T.ArrayType(T.DoubleType()))
    return df.select(*columns, v.alias("_v")).mapInArrow(score, schema)


class Keywords:
    """All keywords of a model in one automaton, so that a text is read once however many there are."""

    def __init__(self, model: Model) -> None:
        words: dict[str, list[int]] = {}
        for i, (_, k, _) in enumerate(model.keywords):
            words.setdefault(k, []).append(i)
        self.everywhere = words.pop("", [])
        self.automaton, self.words = None, words
        try:
            import ahocorasick
        except ImportError:
            return
        if words:
            self.automaton = ahocorasick.Automaton()
            for k, at in words.items():
                self.automaton.add_word(k, at)
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[int]:
        """The places in the model of the keywords that text holds as substrings, in order."""
        if self.automaton is None:
            found = [i for k, at in self.words.items() if k in text for i in at]
        else:
            found = {i for _, at in self.automaton.iter(text) for i in at}
        return sorted([*found, *self.everywhere])


def found_keywords(texts: list[str | None], model: Model, find: Keywords | None = None) -> tuple[list[list[int]], np.ndarray]:
    """The keywords, by place in the model, that each text holds as substrings, without word boundaries; and each category's score.

    The score is the weight of the hits over the weight of all the category's keywords, to 3 digits; 0 without keywords.
    """
    find = find or Keywords(model)
    known: dict[str, list[int]] = {}
    category, weight = (np.array([k[j] for k in model.keywords], t) for j, t in ((0, np.int64), (2, np.float64)))
    totals = np.array(model.totals)
    scores, hits = np.zeros((len(texts), len(model.names))), []
    for r, t in enumerate(texts):
        h = known.get(t) if t else []
        if h is None:
            h = known[t] = find(t)
        hits.append(h)
        if h:
            scores[r] = np.bincount(category[h], weight[h], len(model.names))
    return hits, _round(np.divide(scores, totals, out=np.zeros_like(scores), where=totals > 0), 3)


def scored(records: DataFrame, model: Model, cargo: str = "cargo_description", commodity: str = "commodity_description", vec_col: str = "embedding", dim: int = 384) -> DataFrame:
    """Adds text, quality, semantic, keyword, final and hits in place of the vector, in one pass over Arrow batches.

    Records that the gate stops, or without a usable vector, have no final scores.
    """
    m = model.matrix

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Keywords(model)
        for b in batches:
            *plain, low, v = b.columns
            ok = v.is_valid().to_numpy(zero_copy_only=False)
            hits, kw = found_keywords(low.to_pylist(), model, find)
            sem = _cosines(v, ok, m, dim)
            gate = ok & (plain[-1].to_numpy(zero_copy_only=False) == "ok")
            final = _round(sem * SEMANTIC_WEIGHT + kw[ok] * KEYWORD_WEIGHT, 4)[gate[ok]]
            rows = [[{"c": model.keywords[i][0], "k": model.keywords[i][1]} for i in h] for h in hits]
            new = [_lists(sem, ok, len(m)), _lists(kw, np.ones(len(kw), bool), len(m)), _lists(final, gate, len(m)), pa.array(rows, pa.list_(pa.struct([("c", pa.int32()), ("k", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*plain, *new], [*b.schema.names[:-2], "semantic", "keyword", "final", "hits"])

    df = records.withColumn("text", joined_text(F.col(cargo), F.col(commodity))).withColumn("quality", quality(F.col("text")))
    v = F.when(is_usable(F.col(vec_col), dim), F.col(vec_col).cast("array<float>"))
    plain = df.drop(vec_col)
    columns, schema = plain.columns, T.StructType(list(plain.schema.fields))
    for name in ("semantic", "keyword", "final"):
        schema = schema.add(name, T.ArrayType(T.DoubleType()))
    return df.select(*columns, F.lower("text").alias("_low"), v.alias("_v")).mapInArrow(score, schema.add("hits", _HITS))


def banded(df: DataFrame, model: Model, threshold: Column | float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """Adds max_score, confidence_state, reason and categories.

    No score: unclassified, insufficient_input. Below floor: unclassified, low_similarity. Below threshold:
    low_confidence with the best category, at equal scores the first by name. Else classified, with all at or over it.
    """
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    names = F.array(*(F.lit(n) for n in model.names)) if model.names else F.array().cast("array<string>")
    pairs = F.arrays_zip(names.alias("name"), F.col("final").alias("score"))
    top = F.greatest(F.lit(0.0), F.coalesce(F.array_max("final"), F.lit(0.0)))
    df = df.withColumn("max_score", F.when(F.col("final").isNotNull(), top)).withColumn("_t", t)
    best = F.element_at(names, F.array_position(F.col("final"), F.array_max("final")).cast("int"))
    over = F.transform(F.filter(pairs, lambda p: p["score"] >= F.col("_t")), lambda p: p["name"])
    state = F.when(F.col("max_score").isNull() | (F.col("max_score") < floor), "unclassified").when(F.col("max_score") < F.col("_t"), "low_confidence").otherwise("classified")
    reason = F.when(F.col("max_score").isNull(), "insufficient_input").when(F.col("max_score") < floor, "low_similarity")
    cats = F.when(state == "classified", over).when(state == "low_confidence", F.array(best)).otherwise(F.array().cast("array<string>"))
    return df.withColumns({"confidence_state": state, "reason": reason, "categories": cats}).withColumnRenamed("_t", "threshold_used")


def long_form(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """One row for each record with scores and category: keep, name, semantic_score, keyword_score, final_score."""
    names = F.array(*(F.lit(n) for n in model.names))
    z = F.arrays_zip(names.alias("name"), F.col("semantic").alias("semantic_score"), F.col("keyword").alias("keyword_score"), F.col("final").alias("final_score"))
    return df.filter(F.col("final").isNotNull()).select(*keep, F.explode(z).alias("z")).select(*keep, "z.name", "z.semantic_score", "z.keyword_score", "z.final_score")


def scores_map(model: Model) -> Column:
    """Map of category to its breakdown, over the columns that scored() and banded() add; empty where nothing was scored."""
    names = F.array(*(F.lit(n) for n in model.names))
    z = F.arrays_zip(names.alias("name"), F.col("semantic").alias("s"), F.col("keyword").alias("k"), F.col("final").alias("f"), F.sequence(F.lit(0), F.lit(len(model.names) - 1)).alias("i"))
    entry = lambda p: F.struct(
        p["name"].alias("key"),
        F.struct(
            p["s"].alias("semantic_score"), p["k"].alias("keyword_score"), p["f"].alias("final_score"), F.array_contains("categories", p["name"]).alias("matched"),
            F.transform(F.filter("hits", lambda h: h["c"] == p["i"]), lambda h: h["k"]).alias("keywords_hit"),
        ).alias("value"),
    )
    empty = F.expr("cast(map() as map<string,struct<semantic_score:double,keyword_score:double,final_score:double,matched:boolean,keywords_hit:array<string>>>)")
    return F.when(F.col("final").isNotNull(), F.map_from_entries(F.transform(z, entry))).otherwise(empty)


def envelope(df: DataFrame, model: Model, clock: Column, version: str, cargo: str = "cargo_description", commodity: str = "commodity_description") -> Column:
    """The response as JSON; `reason` is left out when there is none."""
    n = F.lit(len(model.names))
    return F.to_json(
        F.struct(
            "shipment_id",
            F.struct(F.col(cargo).alias("cargo_description"), F.col(commodity).alias("commodity_description")).alias("input"),
            F.struct("categories", "confidence_state", F.col("threshold_used").alias("threshold"), scores_map(model).alias("scores"), "reason").alias("result"),
            F.struct(F.lit(version).alias("model_version"), F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("classified_at"), n.alias("total_categories"), n.alias("evaluated")).alias("meta"),
        )
    )
