"""The small tables that scoring needs, joined to the active categories."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, is_usable

#: Rows of a dimension that may be sent to every executor.
MOST_CENTROIDS, MOST_KEYWORDS = 20_000, 200_000


def active(categories: DataFrame) -> DataFrame:
    """Categories with is_active = true; null is not active."""
    return categories.filter("is_active")


def active_centroids(categories: DataFrame, centroids: DataFrame) -> DataFrame:
    """(category_id, name, centroid, sample_count, updated_at) of the active categories that have one."""
    return centroids.join(active(categories).select(F.col("id").alias("category_id"), "name"), "category_id")


def active_keywords(categories: DataFrame, keywords: DataFrame) -> DataFrame:
    """(name, keyword, weight) of the active categories: keywords in lower case, a null weight is 1."""
    rows = keywords.join(active(categories).select(F.col("id").alias("category_id"), "name"), "category_id").filter("keyword is not null")
    return rows.select("name", F.lower("keyword").alias("keyword"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))


@dataclass(frozen=True)
class Model:
    """What a record is scored against; a category without keywords scores 0 on them, one without a centroid does not score."""

    names: tuple[str, ...]
    matrix: np.ndarray
    keywords: tuple[tuple[int, str, float], ...]

    @property
    def totals(self) -> list[float]:
        t = [0.0] * len(self.names)
        for c, _, w in self.keywords:
            t[c] += w
        return t


def load_model(categories: DataFrame, centroids: DataFrame, keywords: DataFrame, dim: int = 384) -> Model:
    """Read the dimensions to the driver, as long as they are small enough to be sent to every executor."""
    cent = active_centroids(categories, centroids).filter(is_usable(F.col("centroid"), dim)).select("name", doubles(F.col("centroid")).alias("v")).limit(MOST_CENTROIDS + 1).collect()
    kw = active_keywords(categories, keywords).limit(MOST_KEYWORDS + 1).collect()
    if len(cent) > MOST_CENTROIDS or len(kw) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids or {MOST_KEYWORDS} keywords: too many to send to every executor")
    cent = sorted(cent, key=lambda r: r["name"])
    at = {r["name"]: i for i, r in enumerate(cent)}
    words = sorted((at[r["name"]], r["keyword"], r["weight"]) for r in kw if r["name"] in at)
    return Model(tuple(at), np.array([r["v"] for r in cent], np.float64).reshape(-1, dim), tuple(words))
