"""Temporal ground truth: what was studied when. All years come from one first-year aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.operators.incidence import Hypergraph

Constraint = Callable[[DataFrame], DataFrame]


def keyword_edges(g: Hypergraph) -> DataFrame:
    """(e, year) of hyperedges with the keyword and a year."""
    return g.edges.where(F.col("year").isNotNull()).join(g.inc.where(F.col("t") == "keyword").select("e").distinct(), "e", "left_semi")


def studied_pairs(g: Hypergraph) -> DataFrame:
    """(v, e, year): entities on keyword hyperedges."""
    return g.inc.where(F.col("t") == "entity").select("v", "e").join(keyword_edges(g), "e")


def first_years(g: Hypergraph) -> DataFrame:
    """(v, year): first year in which an entity shares a hyperedge with the keyword."""
    return studied_pairs(g).groupBy("v").agg(F.min("year").alias("year"))


def studied_before(g: Hypergraph, year: int) -> DataFrame:
    """(v) of entities studied before a year."""
    return first_years(g).where(F.col("year") < year).select("v")


def studied_by_links(links: DataFrame, year: int) -> DataFrame:
    """(entity) with a link (entity, year) before a year."""
    return links.where(F.col("year") < year).select("entity").distinct()


def unstudied(g: Hypergraph, year: int) -> DataFrame:
    """(v) of entities with a hyperedge that were not studied before a year."""
    return g.inc.where(F.col("t") == "entity").select("v").distinct().join(studied_before(g, year), "v", "left_anti")


def discoveries(g: Hypergraph, constraint: Constraint | None = None) -> DataFrame:
    """(v, year): every discovery of every year; ``constraint`` narrows the entities."""
    found = first_years(g)
    return constraint(found) if constraint else found


def year_discoveries(g: Hypergraph, year: int, papers: bool = False) -> DataFrame:
    """(v[, e]) first studied in a year, with the papers of that year."""
    found = first_years(g).where(F.col("year") == year)
    return studied_pairs(g).join(found, ["v", "year"], "left_semi").select("v", "e") if papers else found.select("v")


def discoverers(g: Hypergraph, constraint: Constraint | None = None) -> DataFrame:
    """(year, author) of the papers with discoveries; no rows for years without."""
    found = studied_pairs(g).join(discoveries(g, constraint), ["v", "year"], "left_semi").select("e", "year").distinct()
    return g.inc.where(F.col("t") == "author").select("e", F.col("v").alias("author")).join(found, "e").select("year", "author").distinct()


def links_of_json(df: DataFrame, column: str, disease: str | None = None) -> DataFrame:
    """(disease, entity, year) of JSON objects disease -> entity -> year; names in lower case with underscores."""
    diseases = df.select(F.explode(F.from_json(column, "map<string,map<string,int>>")).alias("disease", "m"))
    out = diseases.select("disease", F.explode("m").alias("entity", "year")).withColumn("entity", F.replace(F.lower("entity"), F.lit(" "), F.lit("_")))
    return out.where(F.col("disease") == disease) if disease else out
