"""Shortest paths from the keyword: breadth-first over frontiers, with a visited set."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.operators.incidence import NODE
from litweave.runtime import materialise


#: After so many steps the visited nodes and opened hyperedges are written as one table each.
FOLD = 16


def distances(inc: DataFrame, seeds: DataFrame) -> DataFrame:
    """(t, v, dist) in hyperedges from the seeds (t, v), which have distance 0; unreachable nodes do not appear.

    A hyperedge is opened once. Each step is written, so that lineage stays flat, until a step reaches nothing new.
    """
    seen = front = seeds.select(NODE).distinct().withColumn("dist", F.lit(0))
    opened = None
    for k in count(1):
        edges = inc.join(front.select(NODE), NODE, "left_semi").select("e").distinct()
        if opened is not None:
            edges = edges.join(opened, "e", "left_anti")
        edges = materialise(edges, "bfs-edges")
        opened = edges if opened is None else opened.unionByName(edges)
        near = inc.join(edges, "e", "left_semi").select(NODE).distinct().join(seen.select(NODE), NODE, "left_anti")
        front = materialise(near.withColumn("dist", F.lit(k)), "bfs-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if k % FOLD == 0:
            seen, opened = materialise(seen, "bfs-seen"), materialise(opened, "bfs-opened")
    return seen


def keyword_distance(inc: DataFrame) -> DataFrame:
    """(v, dist) of every entity over the whole graph, in edges of the bipartite graph (two a hyperedge); -1 unreachable."""
    found = distances(inc, inc.where(F.col("t") == "keyword").select(NODE).distinct())
    every = inc.where(F.col("t") == "entity").select("t", "v").distinct()
    return every.join(found, NODE, "left").select("v", F.coalesce(F.col("dist") * 2, F.lit(-1)).alias("dist"))


def keyword_distance_by_authors(inc: DataFrame) -> DataFrame:
    """(v, dist) of every entity when only authors lie between it and the keyword; -1 unreachable.

    One search over keyword and authors serves all entities: 1 for a shared paper, else one more than the nearest co-author.
    """
    people = inc.where(F.col("t").isin("author", "keyword"))
    reach = distances(people, inc.where(F.col("t") == "keyword").select(NODE).distinct()).where(F.col("dist") > 0).unionByName(inc.where(F.col("t") == "keyword").select(NODE).distinct().withColumn("dist", F.lit(0)))
    on_edges = people.join(reach, NODE).groupBy("e").agg(F.min("dist").alias("dist"))
    entities = inc.where(F.col("t") == "entity")
    found = entities.join(on_edges, "e").groupBy("v").agg((F.min("dist") + 1).alias("dist"))
    return entities.select("v").distinct().join(found, "v", "left").select("v", F.coalesce("dist", F.lit(-1)).alias("dist"))
