"""Ordered and set operators with deterministic ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The row of smallest ordinal of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(ordinal))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def hash_sample(df: DataFrame, keys: list[str], k: int, by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """k rows (of each group), by the MD5 of their keys and the seed: the same rows in any run and engine."""
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.lit(str(seed))))
    if not by:
        return df.withColumn("_h", digest).orderBy("_h", *keys).limit(k).drop("_h")
    n = F.row_number().over(Window.partitionBy(*by).orderBy("_h", *keys))
    return df.withColumn("_h", digest).withColumn("_n", n).filter(F.col("_n") <= k).drop("_h", "_n")


def top_per_group(df: DataFrame, group: str | list[str], order: list[Column | str], k: int) -> DataFrame:
    group = [group] if isinstance(group, str) else group
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", n).filter(F.col("rank") <= k)


def circular_slice(df: DataFrame, ordinal: str, n: int, seed: Column, k: int = 5) -> DataFrame:
    """k consecutive rows from position seed % n, wrapping around (at most twice round):
    df's columns and position, 0 for the first."""
    k = min(k, 2 * n) if n else 0
    twice = df.withColumn("_at", F.explode(F.array(F.col(ordinal), F.col(ordinal) + n)))
    at = F.col("_at") - seed % n if n else F.lit(0)
    return twice.withColumn("position", at).filter((F.col("position") >= 0) & (F.col("position") < k)).drop("_at")


def newest(df: DataFrame, time_col: str, id_col: str, k: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc(time_col), F.desc(id_col))
    return out if k is None else out.limit(k)


def top_labels(df: DataFrame, label: str, k: int = 10) -> DataFrame:
    """The rows whose label is one of the k most frequent."""
    top = df.filter(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(k).select(label)
    return df.join(top, label, "left_semi")
