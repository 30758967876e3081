"""Problem 3: records that are the same but for formatting and field order.

Each field loses white space, punctuation and letter case; the two results are put in order, so that swapped
fields meet; the pair is hashed to 128 bits and the rows are aggregated by hash with map-side combining. A
second, independent 64-bit hash is part of the grouping, so texts that collide in the first hash stay apart,
and `conflicts` lists such hashes.

Defined results. Null or blank fields: the row is in no group. A field of punctuation only is not blank and is
the empty text once canonical. Repeated rows count as copies. Ties for the representative cannot occur, ids being
unique; with repeated ids the id is its own representative. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, fold, is_blank
from ..runtime import cut


def canonical(c: Column) -> Column:
    """c without white space, punctuation and letter case."""
    return F.regexp_replace(fold(c), rf"[\p{{P}}{SPACE}]+", "")


def keyed(df: DataFrame, fields: tuple[str, str], id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, h128, h64) and the columns to keep of every row whose two fields are both present."""
    a, b = (canonical(F.col(f)) for f in fields)
    rows = df.filter(~is_blank(F.col(fields[0])) & ~is_blank(F.col(fields[1])))
    both = F.concat(F.least("_a", "_b"), F.lit("\x00"), F.greatest("_a", "_b"))
    return (
        rows.select(F.col(id_col).alias("id"), a.alias("_a"), b.alias("_b"), *keep)
        .select("id", both.alias("_t"), *keep)
        .select("id", *keep, F.unhex(F.md5("_t")).alias("h128"), F.xxhash64("_t").alias("h64"))
    )


def groups(keys: DataFrame) -> DataFrame:
    """(h128, h64, rep_id, copies): one row for each distinct record."""
    return keys.groupBy("h128", "h64").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("copies"))


def conflicts(grouped: DataFrame) -> DataFrame:
    """128-bit hashes that more than one text has; expected to be empty."""
    return grouped.groupBy("h128").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")


def collapse(df: DataFrame, fields: tuple[str, str] = ("cargo_text", "commodity_text"), id_col: str = "id") -> DataFrame:
    """(rep_id, copies): one record for each group of rows that differ in formatting or field order only."""
    return groups(keyed(df, fields, id_col)).select("rep_id", "copies")


def copies(df: DataFrame, fields: tuple[str, str] = ("cargo_text", "commodity_text"), id_col: str = "id") -> DataFrame:
    """(rep_id, id): every row of a group of two or more but its representative.

    Only groups of two or more are joined back, so the side that is matched stays small; a hot group makes its
    key's rows many on the row side alone, which adaptive execution splits.
    """
    keys = cut(keyed(df, fields, id_col))  # texts are canonicalised once; what is kept is an id and two hashes a row
    many = groups(keys).filter("copies > 1").select("h128", "h64", "rep_id")
    return keys.join(many.hint("merge"), ["h128", "h64"]).filter("id <> rep_id").select("rep_id", "id").distinct()
