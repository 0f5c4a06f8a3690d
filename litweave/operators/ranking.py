"""Ranks over whole tables, combined scores, top-k, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litweave.functions.scores import clean_nan, inverse_normal
from litweave.runtime import materialise, skew_join

METHODS = ("ranking", "geometric", "harmonic", "z-score", "van-der-waerden")


def distinct_ranks(df: DataFrame, score: str) -> DataFrame:
    """(score, rank, n_rows): ascending average rank of every distinct score and its rows, without a global window.

    Distinct scores are counted, range-partitioned and written; the rows of the partitions before give each
    partition its offset (one number a partition on the driver), and ranks are local from there.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score)).agg(F.count("*").alias("n_rows"))
    parts = materialise(counts.repartitionByRange(F.col(score)).withColumn("part", F.spark_partition_id()), "ranks")
    offsets, below = [], 0
    for r in parts.groupBy("part").agg(F.sum("n_rows").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], below))
        below += r["n"]
    start = df.sparkSession.createDataFrame(offsets, "part int, start long")
    upto = F.sum("n_rows").over(Window.partitionBy("part").orderBy(score)) - F.col("n_rows")
    return parts.withColumn("upto", upto).join(F.broadcast(start), "part").select(score, (F.col("start") + F.col("upto") + (F.col("n_rows") + 1) / 2).alias("rank"), "n_rows")


def with_rank(df: DataFrame, score: str, out: str) -> DataFrame:
    """Adds the ascending average rank of a score; equal scores share the mean of their ranks."""
    return skew_join(df, distinct_ranks(df, score).select(score, F.col("rank").alias(out)), score, how="left")


def with_zscores(df: DataFrame, *cols: str) -> DataFrame:
    """Replaces columns by their distance from the mean in population deviations; null where all are equal."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(c, F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0))))
    return out.drop(*stats.columns)


def normal_scores(df: DataFrame, s1: str, s2: str) -> DataFrame:
    """Adds q1 and q2: standardised normal quantiles of the ranks of two scores."""
    n = df.count()
    ranked = with_rank(with_rank(df, s1, "__r1"), s2, "__r2")
    quantile = lambda c: inverse_normal((F.col(c) / F.lit(float(n + 1))).cast("double"))
    return with_zscores(materialise(ranked.withColumn("q1", quantile("__r1")).withColumn("q2", quantile("__r2")).drop("__r1", "__r2"), "quantiles"), "q1", "q2")


def combine(df: DataFrame, s1: str, s2: str, beta: float, method: str) -> DataFrame:
    """Adds ``score`` from two score columns over the whole table. Ranks are ascending averages."""
    a, c = F.col(s1), F.col(s2)
    if method in ("ranking", "van-der-waerden"):
        df = materialise(df, "scores")
    if method == "ranking":
        ranked = with_rank(with_rank(df, s1, "__r1"), s2, "__r2")
        return ranked.withColumn("score", -(beta * F.col("__r1") + (1 - beta) * F.col("__r2"))).drop("__r1", "__r2")
    if method == "geometric":
        return df.withColumn("score", F.sqrt(F.pow(a, F.lit(beta)) * F.pow(c, F.lit(1 - beta))))
    if method == "harmonic":
        return df.withColumn("score", F.try_divide(F.lit(2.0), F.try_divide(F.lit(beta), a) + F.try_divide(F.lit(1 - beta), c)))
    if method == "z-score":
        z = with_zscores(df.withColumn("__z1", a).withColumn("__z2", c), "__z1", "__z2")
        return z.withColumn("score", beta * F.col("__z1") + (1 - abs(beta)) * F.col("__z2")).drop("__z1", "__z2")
    if method == "van-der-waerden":
        return normal_scores(df, s1, s2).withColumn("score", beta * F.col("q1") + (1 - abs(beta)) * F.col("q2")).drop("q1", "q2")
    raise ValueError(f"method {method}")


def top_k(df: DataFrame, k: int, score: str = "score", key: str = "v", ascending: bool = False) -> DataFrame:
    """The k best rows, ties by key, missing scores last: a distributed partial top-k, not a full sort."""
    s = clean_nan(F.col(score).cast("double"))
    return df.orderBy(s.asc_nulls_last() if ascending else s.desc_nulls_last(), key).limit(k)


def top_k_by(df: DataFrame, k: int, group: str, score: str = "score", key: str = "v") -> DataFrame:
    """The k best rows of each group; Spark keeps at most k rows a group and task before the shuffle."""
    w = Window.partitionBy(group).orderBy(clean_nan(F.col(score).cast("double")).desc_nulls_last(), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distance_bin(distance: Column) -> Column:
    """Shortest-path distance in bins: up to 4 as it is, 5 for farther, 6 for unreachable (-1 or null)."""
    return F.when(distance.isNull() | (distance < 0), 6).when(distance <= 4, distance).otherwise(5).cast("int")
