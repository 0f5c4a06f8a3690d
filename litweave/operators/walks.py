"""Random walks over the hypergraph, many at once.

All walks step together. A node's hyperedges are numbered once, within salted groups so that a node with a third of
all rows is spread; a step draws a number and joins on it, one row a walk whatever the degree. A hyperedge's nodes
are few, so there the candidates are joined and one is kept: of candidates with weights w and uniform hashes u, the
one with the smallest -ln(u)/w is a draw in proportion to w, and a minimum combines map-side. The uniform numbers
come from a hash of seed, walk, step and candidate, so walks repeat exactly and survive retries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litweave.operators.incidence import NODE
from litweave.runtime import materialise
from litweave.sources.upsert import with_surrogate

Weight = Callable[[DataFrame], DataFrame]


def uniform(*keys: Column | int) -> Column:
    """A number in (0, 1) from a hash."""
    cols = [F.lit(k) if isinstance(k, int) else k for k in keys]
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


def _draw(weight: Column, *keys: Column | int) -> Column:
    return -F.ln(uniform(*keys)) / weight


def weight_entities(c: DataFrame) -> DataFrame:
    """Authors get no weight; entities and the keyword share alike."""
    return c.withColumn("w", (F.col("t") != "author").cast("double"))


def weight_authors(c: DataFrame) -> DataFrame:
    """Only authors get weight."""
    return c.withColumn("w", (F.col("t") == "author").cast("double"))


def weight_alpha(alpha: float) -> Weight:
    """Authors and keyword together 1/(alpha+1), entities alpha/(alpha+1), each shared alike in its group; one group takes all."""

    def apply(c: DataFrame) -> DataFrame:
        group = (F.col("t") == "entity").cast("int")
        n = c.groupBy("walk").agg(F.sum(group).alias("n_e"), F.sum(1 - group).alias("n_a"))
        mass = F.when(F.col("t") == "entity", F.lit(float(alpha)) / F.col("n_e")).otherwise(1.0 / F.col("n_a"))
        return c.join(n, "walk").withColumn("w", F.when((F.col("n_e") > 0) & (F.col("n_a") > 0), mass).otherwise(1.0)).drop("n_e", "n_a")

    return apply


def weight_mixture(shares: dict[str, float]) -> Weight:
    """A share of the mass for each kind of node, over the kinds present; the keyword counts with the authors."""

    def apply(c: DataFrame) -> DataFrame:
        kind = F.when(F.col("t") == "keyword", "author").otherwise(F.col("t"))
        c = c.withColumn("kind", kind)
        n = c.groupBy("walk", "kind").agg(F.count("*").alias("n"))
        pie = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(v))) for k, v in shares.items()], F.lit(0.0))
        return c.join(n, ["walk", "kind"]).withColumn("w", pie / F.col("n")).drop("kind", "n")

    return apply


#: Groups over which the hyperedges of a node are numbered.
SALTS = 64


def edge_numbers(inc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, nodes): index(t, v, salt, i, e) numbers the hyperedges of each node and salt from 0; nodes(t, v, d, groups) has
    each node's degree and, for its at most SALTS groups, the number before them."""
    salted = inc.withColumn("salt", F.pmod(F.xxhash64("e", F.lit(11)), F.lit(SALTS)).cast("int"))
    index = materialise(salted.withColumn("i", F.row_number().over(Window.partitionBy(*NODE, "salt").orderBy("e")) - 1).select(*NODE, "salt", "i", "e"), "edge-numbers")
    sizes = index.groupBy(*NODE, "salt").agg(F.count("*").alias("n"))
    lists = sizes.groupBy(NODE).agg(F.sum("n").alias("d"), F.sort_array(F.collect_list(F.struct("salt", "n"))).alias("g"))
    before = lambda g, k: F.aggregate(F.slice(g, 1, k), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    groups = F.transform("g", lambda x, k: F.struct(x["salt"].alias("salt"), before(F.col("g"), k).alias("start"), x["n"].alias("n")))
    return index, materialise(lists.select(*NODE, "d", groups.alias("groups")), "edge-groups")


def _pick_edges(here: DataFrame, index: DataFrame, nodes: DataFrame, seed: int, step: int) -> DataFrame:
    """(walk, ct, cv, e): a hyperedge of each walk's node, all alike."""
    at = here.select("walk", *NODE).join(nodes, NODE)
    at = at.withColumn("r", F.floor(uniform(seed, F.col("walk"), step) * F.col("d")))
    at = at.withColumn("g", F.get(F.filter("groups", lambda g: (g["start"] <= F.col("r")) & (F.col("r") < g["start"] + g["n"])), F.lit(0)))
    picks = at.select("walk", *NODE, F.col("g.salt").alias("salt"), (F.col("r") - F.col("g.start")).cast("int").alias("i"))
    return picks.join(index, [*NODE, "salt", "i"]).select("walk", F.col("t").alias("ct"), F.col("v").alias("cv"), "e")


#: Hyperedges a walk tries at once when they have weights.
TRIES = 8


def _pick_edges_by_return(here: DataFrame, prev: DataFrame, inc: DataFrame, index: DataFrame, nodes: DataFrame, q: float, seed: int, step: int) -> DataFrame:
    """(walk, ct, cv, e): a hyperedge of each walk's node, those without the node before with weight 1/q.

    By rejection: hyperedges are drawn by number and the first is kept that passes with its share of the largest
    weight. A try costs one row whatever the degree; walks without success try again.
    """
    heavy = max(1.0, 1.0 / q)
    back = prev.select("walk", F.col("t").alias("pt"), F.col("v").alias("pv"))
    left, out, start = here.select("walk", *NODE).join(nodes.select(NODE), NODE, "left_semi"), None, 0
    while True:
        tries = left.select(F.col("walk").alias("of"), *NODE, F.explode(F.sequence(F.lit(start), F.lit(start + TRIES - 1))).alias("n"))
        tries = tries.withColumn("walk", F.struct("of", "n"))
        drawn = _pick_edges(tries, index, nodes, seed, step).select(F.col("walk.of").alias("walk"), F.col("walk.n").alias("n"), "ct", "cv", "e").join(back, "walk")
        on_prev = inc.select("e", F.col("t").alias("pt"), F.col("v").alias("pv"), F.lit(1).alias("same"))
        judged = drawn.join(on_prev, ["e", "pt", "pv"], "left")
        share = F.when(F.col("same").isNotNull(), 1.0).otherwise(1.0 / q) / heavy
        passed = judged.where(uniform(seed + 2, F.col("walk"), step, F.col("n")) < share).groupBy("walk", "ct", "cv").agg(F.min_by("e", "n").alias("e"))
        passed = materialise(passed, "walk-edges")
        out = passed if out is None else out.unionByName(passed)
        left = materialise(left.join(passed.select("walk"), "walk", "left_anti"), "walk-left")
        if left.isEmpty():
            return out
        start += TRIES


def hypergraph_walks(inc: DataFrame, starts: DataFrame, length: int, lazy: bool = True, weight: Weight | None = None, q: float | None = None, seed: int = 42) -> DataFrame:
    """(walk, pos, t, v, e) of walks from starts(walk, t, v); e is the hyperedge that led to the node.

    Non-lazy walks leave their node at each step. With ``q``, hyperedges without the previous node weigh 1/q. A walk ends when no node is eligible; a start without hyperedges is a walk of its start alone.
    """
    here = starts.select("walk", *NODE).withColumn("pos", F.lit(0)).withColumn("e", F.lit(None).cast("long"))
    out = [here]
    prev = None
    index, degrees = edge_numbers(inc)
    for k in range(1, length):
        if q is None or prev is None:
            picked = _pick_edges(here, index, degrees, seed, 2 * k)
        else:
            picked = _pick_edges_by_return(here, prev, inc, index, degrees, q, seed, 2 * k)
        nodes = picked.join(inc, "e")
        if not lazy:
            nodes = nodes.where((F.col("t") != F.col("ct")) | (F.col("v") != F.col("cv")))
        nodes = weight(nodes).where(F.col("w") > 0) if weight else nodes.withColumn("w", F.lit(1.0))
        draw = _draw(F.col("w"), seed, F.col("walk"), 2 * k + 1, F.hash("t"), F.col("v"))
        step = nodes.groupBy("walk", "e").agg(F.min_by(F.struct("t", "v"), draw).alias("n")).select("walk", F.col("n.t").alias("t"), F.col("n.v").alias("v"), F.lit(k).alias("pos"), "e")
        prev, here = here, materialise(step, "walk")
        out.append(here)
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def keyword_walks(inc: DataFrame, size: int, length: int, **options) -> DataFrame:
    """``size`` non-lazy walks from the keyword."""
    spark = inc.sparkSession
    start = inc.where(F.col("t") == "keyword").select(NODE).distinct()
    starts = spark.range(size).select(F.col("id").alias("walk")).join(F.broadcast(start.limit(1)))
    return hypergraph_walks(inc, starts, length, lazy=False, **options)


def sentences(walks: DataFrame, token: Column) -> DataFrame:
    """(walk, sentence): tokens of a walk in order. A walk has at most its length of tokens."""
    ordered = walks.withColumn("token", token).groupBy("walk").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("s"))
    return ordered.select("walk", F.concat_ws(" ", F.col("s.token")).alias("sentence"))


def edge_sequences(walks: DataFrame) -> DataFrame:
    """(walk, edges): hyperedges of a walk in order."""
    some = walks.where(F.col("e").isNotNull()).groupBy("walk").agg(F.sort_array(F.collect_list(F.struct("pos", "e"))).alias("s"))
    return some.select("walk", F.concat_ws(" ", F.transform("s.e", lambda x: x.cast("string"))).alias("edges"))


def matrix_walks(trans: DataFrame, starts: DataFrame, length: int, seed: int = 42) -> DataFrame:
    """(walk, pos, v) on a plain transition table (src, dst, p) from starts(walk, v); a walk ends at a node without row."""
    here = starts.select("walk", "v").withColumn("pos", F.lit(0))
    out = here
    # a row is cut into groups; a walk draws a group by its mass and meets only the entries of that group
    rows = materialise(trans.where(F.col("p") > 0).withColumn("salt", F.pmod(F.xxhash64("dst", F.lit(13)), F.lit(SALTS)).cast("int")), "transitions")
    masses = rows.groupBy("src", "salt").agg(F.sum("p").alias("m")).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("salt", "m"))).alias("groups"))
    masses = materialise(masses, "transition-groups")
    for k in range(1, length):
        race = lambda g, k=k: F.struct(_draw(g["m"], seed + 1, F.col("walk"), k, g["salt"]).alias("at"), g["salt"].alias("salt"))
        at = here.select("walk", F.col("v").alias("src")).join(masses, "src").select("walk", "src", F.array_min(F.transform("groups", race))["salt"].alias("salt"))
        draw = _draw(F.col("p"), seed, F.col("walk"), k, F.col("dst"))
        here = at.join(rows, ["src", "salt"]).groupBy("walk").agg(F.min_by("dst", draw).alias("v")).withColumn("pos", F.lit(k))
        here = materialise(here, "walk")
        out = out.unionByName(here.select("walk", "v", "pos"))
    return out


def positive_samples(trans: DataFrame, walks: int, length: int, seed: int = 42) -> DataFrame:
    """(src, dst): distinct nodes reached by ``walks`` walks from each node, itself left out."""
    nodes = trans.select(F.col("src").alias("start")).distinct()
    starts = nodes.select("start", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("m")).select(F.xxhash64("start", "m").alias("walk"), "start")
    seen = matrix_walks(trans, starts.select("walk", F.col("start").alias("v")), length, seed)
    return seen.join(starts, "walk").where(F.col("v") != F.col("start")).select(F.col("start").alias("src"), F.col("v").alias("dst")).distinct()


def expert_walks(density: DataFrame, graph: DataFrame, pool: DataFrame, starts: DataFrame, steps: int, beta: float, seed: int = 42) -> DataFrame:
    """(walk, pos, v) of walks that follow, or avoid, the people: steps + 1 nodes of pool(v) from starts(walk, v).

    density(src, dst, d): how much two nodes share people; pairs that are not listed share none. A step takes the row of
    the current node (beta <= 0) or the geometric mean of the rows of all nodes visited (beta > 0), the softmax of
    -sign(beta) times that row over the whole pool, and the uniform choice among the neighbours in graph(src, dst), or
    over the pool where there are none; |beta| is the share of the first. The walk never stays where it is.

    Nodes without density and edge are alike, so they are one candidate with their common mass, and one of them is taken
    by number if it wins: a step costs the listed nodes of the walks, not walks times pool.
    """
    own = pool.select("v").distinct()
    numbered = materialise(with_surrogate(own, "i", -1), "pool")
    size = numbered.count()
    code = lambda df, c: df.join(numbered.select(F.col("v").alias(c), F.col("i").alias(f"{c}_i")), c).drop(c)
    rows = materialise(code(code(density, "src"), "dst"), "pool-density")
    near = materialise(code(code(graph.select("src", "dst").distinct(), "src"), "dst"), "pool-graph")
    here = materialise(starts.select("walk", "v").join(numbered, "v").select("walk", "i", F.lit(0).alias("pos")), "walk")
    out, sign, share = here, (beta > 0) - (beta < 0), abs(beta)
    for k in range(1, steps + 1):
        visited = here if beta <= 0 else out
        met = visited.select("walk", F.col("i").alias("src_i")).join(rows, "src_i").where(F.col("d") > 0)
        shared = met.groupBy("walk", "dst_i").agg(F.exp(F.avg(F.ln("d"))).alias("d"), F.count("*").alias("n"))
        shared = shared.where(F.col("n") == F.lit(1 if beta <= 0 else k)).select("walk", "dst_i", "d", F.lit(0).alias("edge"))
        edges = here.select("walk", F.col("i").alias("src_i")).join(near, "src_i").select("walk", "dst_i", F.lit(0.0).alias("d"), F.lit(1).alias("edge"))
        stay = here.select("walk", F.col("i").alias("dst_i"), F.lit(0.0).alias("d"), F.lit(0).alias("edge"))
        listed = shared.unionByName(edges).unionByName(stay).groupBy("walk", "dst_i").agg(F.sum("d").alias("d"), F.max("edge").alias("edge"))
        listed = listed.withColumn("soft", F.exp(-sign * F.col("d")))
        mass = listed.groupBy("walk").agg(F.sum("soft").alias("z"), F.sum("edge").alias("edges"), F.count("*").alias("n"), F.sort_array(F.collect_list("dst_i")).alias("taken"))
        mass = mass.withColumn("z", F.col("z") + (size - F.col("n")))
        alone = F.when(F.col("edges") == 0, F.lit((1 - share) / size)).otherwise(0.0)
        each = listed.join(mass.select("walk", "z", "edges"), "walk").join(here.select("walk", F.col("i").alias("now")), "walk").where(F.col("dst_i") != F.col("now"))
        w = share * F.col("soft") / F.col("z") + alone + F.when(F.col("edge") == 1, (1 - share) / F.col("edges")).otherwise(0.0)
        ones = each.select("walk", F.col("dst_i"), w.alias("w"))
        rest = mass.select("walk", F.lit(None).cast("long").alias("dst_i"), ((size - F.col("n")) * (share / F.col("z") + alone)).alias("w"))
        drawn = ones.unionByName(rest).where(F.col("w") > 0)
        race = _draw(F.col("w"), seed, F.col("walk"), k, F.coalesce("dst_i", F.lit(-1)))
        won = drawn.groupBy("walk").agg(F.min_by(F.struct("dst_i"), race).alias("s")).join(mass.select("walk", "n", "taken"), "walk")
        free = F.floor(uniform(seed + 1, F.col("walk"), k) * (size - F.col("n")))
        among = F.aggregate("taken", free, lambda r, t: F.when(t <= r, r + 1).otherwise(r))  # the number-th node that is not listed
        here = materialise(won.select("walk", F.coalesce("s.dst_i", among).alias("i"), F.lit(k).alias("pos")), "walk")
        out = out.unionByName(here)
    return out.join(numbered, "i").select("walk", "pos", "v")


def random_entities(walks: DataFrame, members: DataFrame, seed: int = 42) -> DataFrame:
    """(walk, pos, v): an entity of the paper of every step; while a paper repeats, its entities are not picked again.

    Equivalent to drawing without replacement in a run of the same paper: the run's entities are ordered by a hash
    and its i-th step takes the i-th; v is null when they are used up or the paper has none.
    """
    w = Window.partitionBy("walk").orderBy("pos")
    new = (F.col("e") != F.lag("e").over(w)).cast("int")
    runs = walks.where(F.col("e").isNotNull()).withColumn("run", F.sum(F.coalesce(new, F.lit(1))).over(w))
    runs = runs.withColumn("i", F.row_number().over(Window.partitionBy("walk", "run").orderBy("pos")))
    heads = runs.select("walk", "run", "e").distinct().join(members.select("e", "v"), "e")
    order = F.row_number().over(Window.partitionBy("walk", "run").orderBy(uniform(seed, F.col("walk"), F.col("run"), F.col("v")), "v"))
    pool = heads.select("walk", "run", "v", order.alias("i"))
    return runs.select("walk", "run", "i", "pos").join(pool, ["walk", "run", "i"], "left").select("walk", "pos", "v")


def first_passage(tokens: DataFrame, source: str, targets: list[str] | DataFrame | None = None) -> DataFrame:
    """(target, dist, n): mean steps from an occurrence of the source to the first target before the next source.

    tokens(walk, pos, token). Targets never reached do not appear, unless a table (target) is given: then with null.
    """
    w = Window.partitionBy("walk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.last(F.when(F.col("token") == source, F.col("pos")), ignorenulls=True).over(w)
    hits = tokens.withColumn("src", at).where(F.col("src").isNotNull() & (F.col("token") != source))
    each = hits.groupBy("walk", "src", F.col("token").alias("target")).agg(F.min(F.col("pos") - F.col("src")).alias("d"))
    out = each.groupBy("target").agg(F.avg("d").alias("dist"), F.count("*").alias("n"))
    if isinstance(targets, DataFrame):
        return targets.select("target").distinct().join(out, "target", "left")
    return out.where(F.col("target").isin(targets)) if targets is not None else out
