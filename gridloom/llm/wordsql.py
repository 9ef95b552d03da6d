"""Word columns from DataFrame functions, shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of ASCII digits, a-z and everything outside ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of words of A-Z lower-cased text; null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def placed(df: DataFrame, array: str) -> DataFrame:
    """One row a word with its place ``at`` (from 0), and one row more a document with ``at`` -1 and an empty word."""
    return df.select("*", F.posexplode(F.concat(F.array(F.lit("")), array)).alias("_at", "word")).withColumn("at", F.col("_at") - 1).drop("_at")
