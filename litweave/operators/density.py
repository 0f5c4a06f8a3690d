"""Co-occurrence with a property by year, and the overlap of the people behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litweave.operators.incidence import Hypergraph
from litweave.operators.truth import keyword_edges, studied_pairs


def cooccurrences(g: Hypergraph) -> DataFrame:
    """(v, year, n): papers of a year with the entity and the keyword; only years with some."""
    return studied_pairs(g).groupBy("v", "year").agg(F.count("*").alias("n"))


def dense_years(counts: DataFrame, value: str = "n") -> DataFrame:
    """Counts with zeros for every year from the first to the last of the table. The bounds are one row."""
    lo, hi = counts.agg(F.min("year"), F.max("year")).first()
    if lo is None:
        return counts
    years = counts.select("v").distinct().select("v", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("year"))
    return years.join(counts, ["v", "year"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def social_density(g: Hypergraph) -> DataFrame:
    """(v, year, sd): shared over joint authors of the entity's and the keyword's papers of a year.

    Years without keyword authors do not appear; entities without authors in a year have no row (density 0).
    """
    dated = g.edges.where(F.col("year").isNotNull())
    authors = g.inc.where(F.col("t") == "author").select("e", F.col("v").alias("author"))
    y = keyword_edges(g).join(authors, "e").select("year", "author").distinct()
    n_y = y.groupBy("year").agg(F.count("*").alias("n_y"))
    x = g.inc.where(F.col("t") == "entity").select("e", "v").join(dated, "e").join(authors, "e").select("v", "year", "author").distinct()
    shared = x.join(y.withColumn("both", F.lit(1)), ["year", "author"], "left").groupBy("v", "year").agg(F.count("*").alias("n_x"), F.count("both").alias("n"))
    return shared.join(n_y, "year").select("v", "year", (F.col("n") / (F.col("n_x") + F.col("n_y") - F.col("n"))).alias("sd"))


def author_sets(x: DataFrame, y: DataFrame) -> DataFrame:
    """(year, n_both, n_any) of author tables (year, author); the years of y."""
    years = y.select("year").distinct()
    a = x.select("year", "author").distinct().withColumn("in_x", F.lit(1))
    b = y.select("year", "author").distinct().withColumn("in_y", F.lit(1))
    all_ = a.join(b, ["year", "author"], "full_outer").join(years, "year", "left_semi")
    return all_.groupBy("year").agg(F.sum(F.coalesce(F.col("in_x") * F.col("in_y"), F.lit(0))).alias("n_both"), F.count("*").alias("n_any"))


def scalar_density(sd: DataFrame, before: int, memory: int = 5) -> DataFrame:
    """(v, score): density summed over [before - memory, before)."""
    return sd.where(F.col("year").between(before - memory, before - 1)).groupBy("v").agg(F.sum("sd").alias("score"))


def random_density(sd: DataFrame, before: int, memory: int = 5, size: int = 50, seed: int = 42) -> DataFrame:
    """(v, score): 1 for ``size`` entities of positive density, chosen by a hash of the seed, and 0 for all others."""
    some = scalar_density(sd, before, memory).where(F.col("score") > 0)
    chosen = some.orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(size).select("v", F.lit(1.0).alias("score"))
    return sd.select("v").distinct().join(chosen, "v", "left").select("v", F.coalesce("score", F.lit(0.0)).alias("score"))


def joint_density(tokens: DataFrame, first: str, second: str) -> DataFrame:
    """(jsd): authors shared by two terms over the sum of the authors of each, 0 to 1/2; tokens(term, author)."""
    own = tokens.where(F.col("term").isin(first, second)).select("term", "author").distinct()
    by = own.groupBy("author").agg(F.max((F.col("term") == first).cast("int")).alias("a"), F.max((F.col("term") == second).cast("int")).alias("b"))
    n = by.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n"))
    return n.select(F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), F.col("n") / (F.col("n_a") + F.col("n_b"))).otherwise(F.lit(0.0)).alias("jsd"))


def by_position(points: DataFrame, order: str, stat: str = "mean") -> DataFrame:
    """(pos, value): mean or population deviation at each place of yearly series (year, ``order``, value), numbered from 0 by
    ``order`` within the year, as far as the series of the first year goes. No series is held in one row."""
    placed = points.withColumn("pos", F.row_number().over(Window.partitionBy("year").orderBy(order)) - 1)
    years = points.groupBy("year").agg(F.count("*").alias("n"))
    first = years.agg(F.min_by("n", "year").alias("n"))
    agg = F.avg("value") if stat == "mean" else F.stddev_pop("value")
    return placed.groupBy("pos").agg(agg.alias("value")).join(F.broadcast(first), F.col("pos") < F.col("n")).select("pos", "value")


def running(counts: DataFrame) -> DataFrame:
    """(v, year, total): co-occurrences up to each year."""
    return counts.select("v", "year", F.sum("n").over(Window.partitionBy("v").orderBy("year")).alias("total"))
