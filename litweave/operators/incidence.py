"""The hypergraph: papers as hyperedges over authors, entities, affiliations and keywords, in one long table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.functions.predicates import year_in, year_window
from litweave.runtime import materialise
from litweave.sources.catalog import Catalog

NODE = ["t", "v"]


@dataclass(frozen=True)
class Hypergraph:
    """edges(e, year) and inc(e, t, v), distinct; t is author, entity, affiliation or keyword."""

    edges: DataFrame
    inc: DataFrame

    def years(self, years: list[int]) -> Hypergraph:
        """Only the hyperedges of these years."""
        return self._keep(self.edges.where(year_in(F.col("year"), years)))

    def window(self, year: int, memory: int) -> Hypergraph:
        """Only the hyperedges of [year - memory, year)."""
        return self._keep(self.edges.where(year_window(F.col("year"), year, memory)))

    def _keep(self, edges: DataFrame) -> Hypergraph:
        return Hypergraph(edges, self.inc.join(edges.select("e"), "e", "left_semi"))

    def only(self, *kinds: str) -> Hypergraph:
        """Only the nodes of these kinds. Nodes without hyperedge do not exist, so nothing is left to prune."""
        return replace(self, inc=self.inc.where(F.col("t").isin(list(kinds))))

    def written(self) -> Hypergraph:
        """The incidence written once, partitioned by hyperedge: for operators that read it several times."""
        return replace(self, inc=materialise(self.inc.repartition("e"), "incidence"))


def author_block(c: Catalog) -> DataFrame:
    """(e, t, v) of known papers and authors."""
    return c.paper_author.join(c.paper.select("paper_id"), "paper_id", "left_semi").join(c.author.select("author_id"), "author_id", "left_semi").select(F.col("paper_id").alias("e"), F.lit("author").alias("t"), F.col("author_id").alias("v")).distinct()


def entity_block(c: Catalog) -> DataFrame:
    """(e, t, v) of known papers and entities."""
    return c.paper_entity.join(c.paper.select("paper_id"), "paper_id", "left_semi").join(c.entity.select("entity_id"), "entity_id", "left_semi").select(F.col("paper_id").alias("e"), F.lit("entity").alias("t"), F.col("entity_id").alias("v")).distinct()


def affiliation_block(c: Catalog) -> DataFrame:
    """(e, t, v) of papers and the affiliations of their authors."""
    return author_block(c).select("e", F.col("v").alias("author_id")).join(c.author_affiliation, "author_id").join(c.affiliation.select("aff_id"), "aff_id", "left_semi").select("e", F.lit("affiliation").alias("t"), F.col("aff_id").alias("v")).distinct()


def keyword_block(keyword_papers: list[DataFrame], collapse: bool = True) -> DataFrame:
    """(e, t, v) of keyword papers: one node for all keywords, or node i for the i-th."""
    out = None
    for i, papers in enumerate(keyword_papers):
        one = papers.select(F.col("paper_id").alias("e"), F.lit("keyword").alias("t"), F.lit(0 if collapse else i).cast("long").alias("v"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def hypergraph(c: Catalog, *blocks: DataFrame) -> Hypergraph:
    """Blocks side by side over the papers of the catalog."""
    inc = blocks[0]
    for b in blocks[1:]:
        inc = inc.unionByName(b)
    return Hypergraph(c.paper.select(F.col("paper_id").alias("e"), "year"), inc)


def node_degrees(inc: DataFrame) -> DataFrame:
    """(t, v, d): hyperedges of each node, combined map-side."""
    return inc.groupBy(NODE).agg(F.count("*").alias("d"))


def edge_sizes(inc: DataFrame) -> DataFrame:
    """(e, size): nodes of each hyperedge."""
    return inc.groupBy("e").agg(F.count("*").alias("size"))


def neighbors(inc: DataFrame, seeds: DataFrame) -> DataFrame:
    """(t, v) of the nodes that share a hyperedge with a seed (t, v); seeds with a hyperedge are their own neighbours."""
    edges = inc.join(seeds.select(NODE).distinct(), NODE, "left_semi").select("e").distinct()
    return inc.join(edges, "e", "left_semi").select(NODE).distinct()


def coauthor_rings(inc: DataFrame, seed: DataFrame, degree: int) -> DataFrame:
    """(v, ring): authors at each distance from the seed authors (v), up to ``degree``; the seeds are ring 0."""
    authors = inc.where(F.col("t") == "author")
    seen = seed.select("v").distinct().withColumn("ring", F.lit(0))
    front = seen
    for k in range(1, degree + 1):
        near = neighbors(authors, front.select(F.lit("author").alias("t"), "v")).select("v")
        front = near.join(seen, "v", "left_anti").withColumn("ring", F.lit(k))
        if k < degree:
            front = materialise(front, "ring")
        seen = seen.unionByName(front)
    return seen


def coauthors(inc: DataFrame, seed: DataFrame, degree: int) -> DataFrame:
    """(v): authors within ``degree`` steps, the seeds left out."""
    return coauthor_rings(inc, seed, degree).where(F.col("ring") > 0).select("v")


def projection(inc: DataFrame) -> DataFrame:
    """(t1, v1, t2, v2) of all node pairs that share a hyperedge, self loops kept."""
    a = inc.select("e", F.col("t").alias("t1"), F.col("v").alias("v1"))
    b = inc.select("e", F.col("t").alias("t2"), F.col("v").alias("v2"))
    return a.join(b, "e").select("t1", "v1", "t2", "v2").distinct()
