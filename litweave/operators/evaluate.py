"""Predictions against later discoveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litweave.operators.ranking import distance_bin, distinct_ranks, normal_scores, top_k_by
from litweave.runtime import materialise


def precision_by_year(preds: DataFrame, truth: DataFrame, year: int, last_year: int, cumulative: bool = True, key: str = "v") -> DataFrame:
    """(year, precision) for [year, last_year): share of the predictions found true in a year, or up to it. Null without predictions."""
    spark = preds.sparkSession
    years = spark.range(year, last_year).select(F.col("id").cast("int").alias("year"))
    hits = truth.where(F.col("year").between(year, last_year - 1)).join(preds.select(key).distinct(), key, "left_semi").select(key, "year").distinct().groupBy("year").agg(F.count("*").alias("hits"))
    n = preds.select(key).distinct().agg(F.count("*").alias("n"))
    found = years.join(hits, "year", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    if cumulative:
        found = found.withColumn("hits", F.sum("hits").over(Window.partitionBy(F.lit(1)).orderBy("year")))
    return found.join(F.broadcast(n)).select("year", F.try_divide(F.col("hits"), F.col("n")).alias("precision"))


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(auc) by average ranks (exact with ties); null with one class. Missing scores are left out."""
    own = materialise(scored.where(~F.isnan(F.col(score).cast("double"))).select(F.col(score).alias("s"), F.col(label).cast("long").alias("y")), "auc")
    pos = own.groupBy("s").agg(F.sum("y").alias("pos"))
    ranked = distinct_ranks(own, "s").join(pos, "s")
    out = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n_rows") - F.col("pos")).alias("q"))
    return out.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, (F.col("p") * F.col("q")).cast("double")).alias("auc"))


def author_years(preds: DataFrame, truth: DataFrame, year: int, last_year: int) -> DataFrame:
    """(author, years): predicted authors with the years in which they were discoverers."""
    hits = truth.where(F.col("year").between(year, last_year - 1)).join(preds.select("author").distinct(), "author", "left_semi")
    return hits.groupBy("author").agg(F.sort_array(F.collect_set("year")).alias("years"))


#: Bins of distance: 1 to 4, farther, unreachable.
LEVELS = 6


def _best_by_beta(items: DataFrame, betas: list[float], k: int) -> DataFrame:
    """The k best items of every beta by beta * (normal score of distance) + (1 - |beta|) * (normal score of similarity)."""
    grid = items.sparkSession.createDataFrame([(float(b),) for b in betas], "beta double")
    ready = materialise(items.withColumn("level", distance_bin(F.col("spd"))).withColumn("near", F.exp("sim")), "orbits")
    scored = normal_scores(ready, "level", "near").join(F.broadcast(grid))
    scored = scored.withColumn("score", F.round(F.col("beta") * F.col("q1") + (1 - F.abs("beta")) * F.col("q2"), 9))
    return materialise(top_k_by(scored, k, "beta"), "orbits-best")


def orbit_scores(items: DataFrame, betas: list[float], k: int = 50, truth: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Where the k best of each beta lie by distance, and how good they are, from items(v, spd, sim, outer).

    (beta, level, share, mean_outer) for all LEVELS, share of the predictions made and 0 where a level has none or no
    outer score; (beta, precision, score): share of the predictions in truth(v) and mean outer score, which at beta -1
    and 1 is that of the nearest and farthest orbits themselves.
    """
    best = _best_by_beta(items, betas, k)
    n = best.groupBy("beta").agg(F.count("*").alias("n"))
    levels = n.select("beta", "n", F.explode(F.sequence(F.lit(1), F.lit(LEVELS))).alias("level"))
    held = best.groupBy("beta", "level").agg(F.count("*").alias("m"), F.avg("outer").alias("mean_outer"))
    by_level = levels.join(held, ["beta", "level"], "left").select("beta", "level", (F.coalesce("m", F.lit(0)) / F.col("n")).alias("share"), F.coalesce("mean_outer", F.lit(0.0)).alias("mean_outer"))
    hit = best if truth is None else best.join(truth.select("v").distinct().withColumn("hit", F.lit(1)), "v", "left")
    hits = F.lit(None).cast("double") if truth is None else F.count("hit") / F.count("*")
    whole = hit.groupBy("beta").agg(hits.alias("precision"), F.avg("outer").alias("score"))
    known = materialise(items.where(F.col("outer").isNotNull()).select("spd", F.col("outer").alias("score")), "orbits-known")
    for beta, far in ((-1.0, False), (1.0, True)):
        if beta in [float(b) for b in betas]:
            edge = extreme_orbits(known.where(F.col("spd") > 0), k, farthest=far).select(F.col("score").alias("__edge"))
            whole = whole.join(F.broadcast(edge)).withColumn("score", F.when(F.col("beta") == beta, F.col("__edge")).otherwise(F.col("score"))).drop("__edge")
    return by_level, whole


def extreme_orbits(items: DataFrame, k: int, farthest: bool = False, literal: bool = False) -> DataFrame:
    """(score): mean score of k slots filled orbit by orbit from the nearest (or farthest) distance.

    The last orbit fills the slots that are left with its mean. ``literal`` divides once more by the number of orbits used.
    """
    orbits = items.groupBy("spd").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    order = F.col("spd").desc() if farthest else F.col("spd").asc()
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy(order)) - F.col("n")
    used = orbits.withColumn("take", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(k) - before))).where(F.col("take") > 0)
    total = used.agg(F.sum(F.col("mean") * F.col("take")).alias("s"), F.sum("take").alias("n"), F.count("*").alias("o"))
    score = F.try_divide(F.col("s"), F.col("n").cast("double"))
    return total.select((F.try_divide(score, F.col("o").cast("double")) if literal else score).alias("score"))


def validation_precision(dots: DataFrame, truth: DataFrame, k: int = 50) -> DataFrame:
    """(precision) of the k best of dots(v, score) against truth(v)."""
    top = dots.orderBy(F.desc_nulls_last("score"), "v").limit(k)
    hit = top.join(truth.select("v").distinct().withColumn("hit", F.lit(1)), "v", "left")
    return hit.agg(F.try_divide(F.count("hit"), F.count("*")).alias("precision"))
