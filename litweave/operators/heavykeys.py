"""Per-key results where a few keys hold most rows: value-frequency compression.

Rows are first grouped by (key, value), which spreads the rows of any key over all tasks and leaves one weighted row
for each distinct value. The per-key figures then follow from the weighted values: row counts are sums of weights,
distinct counts are exact row counts, the mode is the largest weight. Both steps combine map-side, so a key holding a
third of all rows reaches the last shuffle as one row per task.

Defined results
    * null key: a group of its own with key null. Null value: counted in n_rows, not in n_values or the mode.
    * mode ties: the smallest value. Key without any value: n_values 0, mode null. Null times are ignored.
    * repeated rows count each time in n_rows and once in n_values. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**64 and half of it, as decimal literals
_SHIFT, _HALF = "18446744073709551616", "9223372036854775808"


def _decimal(text: str) -> Column:
    return F.lit(text).cast("decimal(20,0)")


def compress_values(df: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key_id, value, n, first_at, last_at): one weighted row for each value of a key."""
    return df.groupBy(F.col(key).alias("key_id"), F.col(value).alias("value")).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def key_profile(df: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key_id, n_rows, n_values, mode_value, mode_rows, first_at, last_at) of every key. Keys and values are integers."""
    pairs = compress_values(df, key, value, at)
    # weight and value in one number, so that the mode is a plain maximum (hash aggregate) with ties to the smallest value
    rank = F.when(F.col("value").isNotNull(), F.col("n").cast("decimal(38,0)") * _decimal(_SHIFT) - F.col("value").cast("decimal(20,0)")).cast("decimal(38,0)")
    out = pairs.groupBy("key_id").agg(
        F.sum("n").alias("n_rows"),
        F.count("value").alias("n_values"),
        F.max(rank).alias("__mode"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )
    n = F.ceil((F.col("__mode") - _decimal(_HALF)) / _decimal(_SHIFT)).cast("long")
    value = (n.cast("decimal(38,0)") * _decimal(_SHIFT) - F.col("__mode")).cast("long")
    return out.select("key_id", "n_rows", "n_values", value.alias("mode_value"), n.alias("mode_rows"), "first_at", "last_at")


def heavy_keys(profile: DataFrame, total_rows: int, one_in: int) -> DataFrame:
    """The keys of a profile holding at least one row in ``one_in`` of ``total_rows``; the null key is none."""
    return profile.where(F.col("key_id").isNotNull() & (F.col("n_rows") * one_in >= total_rows))
