"""Transition probabilities and accessibility without forming the transition matrix.

A step of the walk is two joins and two aggregations: node mass to hyperedges, hyperedge mass to nodes. The mass is
divided by degree while it is one row a node or hyperedge, so the incidence is only ever joined with narrow tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave.operators.incidence import NODE, edge_sizes, node_degrees
from litweave.runtime import materialise

Keep = Callable[[Column], Column]


def edge_weights(inc: DataFrame, alpha: float | None = None, literal: bool = False) -> DataFrame:
    """(e, w_author, w_other): share of a hyperedge's mass that each of its authors or other nodes receives.

    Without alpha all nodes share alike. With alpha, authors together get 1/(alpha+1) and the others alpha/(alpha+1);
    a hyperedge of one group shares alike (``literal``: the reciprocal of its scaled weight instead).
    """
    if alpha is None:
        return edge_sizes(inc).select("e", (1 / F.col("size")).alias("w_author"), (1 / F.col("size")).alias("w_other"))
    is_author = (F.col("t") == "author").cast("int")
    n = inc.groupBy("e").agg(F.sum(is_author).alias("a"), F.sum(1 - is_author).alias("o"))
    a, o = F.col("a"), F.col("o")
    both = (a > 0) & (o > 0)
    one_a = a * (alpha + 1) if literal else F.try_divide(F.lit(1.0), a)
    one_o = (F.try_divide(o * (alpha + 1), F.lit(float(alpha)))) if literal else F.try_divide(F.lit(1.0), o)
    return n.select("e", F.when(both, F.try_divide(F.lit(1 / (alpha + 1)), a)).otherwise(one_a).alias("w_author"), F.when(both, F.try_divide(F.lit(alpha / (alpha + 1)), o)).otherwise(one_o).alias("w_other"))


def _weight() -> Column:
    return F.when(F.col("t") == "author", F.col("w_author")).otherwise(F.col("w_other"))


def forward(x: DataFrame, inc: DataFrame, degrees: DataFrame, weights: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One step of a row vector: x(t, v, x) -> y. ``extra`` keeps columns such as a source apart."""
    share = x.join(degrees, NODE).select(*extra, *NODE, (F.col("x") / F.col("d")).alias("x"))
    on_edges = inc.join(share, NODE).groupBy("e", *extra).agg(F.sum("x").alias("m")).join(weights, "e")
    return inc.join(on_edges, "e").groupBy(*extra, *NODE).agg(F.sum(F.col("m") * _weight()).alias("x"))


def backward(x: DataFrame, inc: DataFrame, degrees: DataFrame, weights: DataFrame) -> DataFrame:
    """One step of a column vector: probability to reach x in one step."""
    on_edges = inc.join(x, NODE).join(weights, "e").groupBy("e").agg(F.sum(F.col("x") * _weight()).alias("m"))
    return inc.join(on_edges, "e").groupBy(NODE).agg(F.sum("m").alias("m")).join(degrees, NODE).select(*NODE, (F.col("m") / F.col("d")).alias("x"))


def multistep(x: DataFrame, inc: DataFrame, nstep: int, through: Keep, step: Callable = forward, alpha: float | None = None, literal: bool = False) -> DataFrame:
    """``nstep`` steps from x, intermediate nodes limited to those that ``through`` keeps (by kind t)."""
    degrees, weights = node_degrees(inc), edge_weights(inc, alpha, literal)
    for i in range(nstep):
        x = step(x, inc, degrees, weights)
        if i < nstep - 1:
            x = x.where(through(F.col("t")))
            if nstep > 2:
                x = materialise(x, "hop")
    return x


def unit(inc: DataFrame, kind: str) -> DataFrame:
    """Mass 1 on each node of a kind."""
    return inc.where(F.col("t") == kind).select(NODE).distinct().withColumn("x", F.lit(1.0))


def accessibility(inc: DataFrame, direction: str = "KWtoC", nstep: int = 1, alpha: float | None = None, literal: bool = False) -> DataFrame:
    """(v, score) of each entity (of each author for KWtoA) that has a hyperedge.

    CtoKW: from the entity to the keyword through authors. KWtoC: from the keyword through anything but the keyword.
    both_way: mean of both directions through authors. KWtoA: from the keyword to authors through entities.
    """
    authors, others, entities = (lambda t: t == "author"), (lambda t: t != "keyword"), (lambda t: t == "entity")
    target = "author" if direction == "KWtoA" else "entity"

    def run(step: Callable, through: Keep) -> DataFrame:
        return multistep(unit(inc, "keyword"), inc, nstep, through, step, alpha, literal).where(F.col("t") == target).select("v", "x")

    if direction == "CtoKW":
        found = run(backward, authors)
    elif direction == "KWtoC":
        found = run(forward, others)
    elif direction == "KWtoA":
        found = run(forward, entities)
    elif direction == "both_way":
        found = run(forward, authors).unionByName(run(backward, authors)).groupBy("v").agg((F.sum("x") / 2).alias("x"))
    else:
        raise ValueError(f"direction {direction}")
    every = inc.where(F.col("t") == target).select("v").distinct()
    return every.join(found, "v", "left").select("v", F.coalesce("x", F.lit(0.0)).alias("score"))


def accessibility_by_year(g, years: list[int], how: str = "SUM", nstep: int = 1) -> DataFrame:
    """(v, score): accessibility from the keyword within each year, as SUM, MEAN or MAX over the years.

    A year without the entity counts 0. The years are a short list; each is its own small graph.
    """
    each = None
    for y in years:
        one = accessibility(g.years([y]).inc, "KWtoC", nstep).select("v", "score")
        each = one if each is None else each.unionByName(one)
    total = {"SUM": F.sum("score"), "MEAN": F.sum("score") / len(years), "MAX": F.max("score")}[how]
    return each.groupBy("v").agg(total.alias("score"))


def transition_matrix(inc: DataFrame, sources: Keep, targets: Keep, alpha: float | None = None, literal: bool = False) -> DataFrame:
    """(t1, v1, t2, v2, p) of a block of the transition matrix, diagonal kept. For blocks, not for whole graphs."""
    a = inc.where(sources(F.col("t"))).select("e", F.col("t").alias("t1"), F.col("v").alias("v1"))
    b = inc.where(targets(F.col("t"))).join(edge_weights(inc, alpha, literal), "e").select("e", F.col("t").alias("t2"), F.col("v").alias("v2"), _weight().alias("w"))
    pairs = a.join(b, "e").groupBy("t1", "v1", "t2", "v2").agg(F.sum("w").alias("w"))
    d = node_degrees(inc).select(F.col("t").alias("t1"), F.col("v").alias("v1"), "d")
    return pairs.join(d, ["t1", "v1"]).select("t1", "v1", "t2", "v2", (F.col("w") / F.col("d")).alias("p"))


def entity_graph(inc: DataFrame, two_step: bool = False) -> DataFrame:
    """(t1, v1, t2, v2, p) between entities and keyword: no diagonal, rows sum to one; optionally with two steps through authors."""
    not_author, author = (lambda t: t != "author"), (lambda t: t == "author")
    p = transition_matrix(inc, not_author, not_author)
    if two_step:
        up = transition_matrix(inc, not_author, author).select("t1", "v1", F.col("v2").alias("a"), F.col("p").alias("p1"))
        down = transition_matrix(inc, author, not_author).select(F.col("v1").alias("a"), "t2", "v2", F.col("p").alias("p2"))
        p = p.unionByName(up.join(down, "a").select("t1", "v1", "t2", "v2", (F.col("p1") * F.col("p2")).alias("p"))).groupBy("t1", "v1", "t2", "v2").agg(F.sum("p").alias("p"))
    p = p.where((F.col("t1") != F.col("t2")) | (F.col("v1") != F.col("v2")))
    rows = p.groupBy("t1", "v1").agg(F.sum("p").alias("total"))
    return p.join(rows, ["t1", "v1"]).select("t1", "v1", "t2", "v2", (F.col("p") / F.col("total")).alias("p"))
