"""Queries of the hypergraph operators, accessibility, paths and walks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.functions import text
from litweave.operators import hops, incidence, paths, walks
from litweave.operators.ranking import distance_bin
from litweave.plans.common import BASE, PROPERTY, YEAR, catalog, graph, recent
from litweave.plans.predictors import hypergraph_transition
from litweave.runtime import materialise, table, to_utc_ntz

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"{BASE} SELECT * FROM inc")
def incidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).inc


@query(f"{BASE} SELECT i.e, i.t, i.v FROM inc i JOIN p USING (e) WHERE p.year IN (2008, 2010)")
def restricted_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).years([2008, 2010]).inc


@query(f"{BASE} SELECT t, v, count(*) AS d FROM inc GROUP BY t, v")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidence.node_degrees(graph(spark, sf_dir).inc)


@query(f"{BASE} SELECT DISTINCT t, v FROM inc WHERE e IN (SELECT e FROM inc WHERE t = 'keyword')")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    return incidence.neighbors(g.inc, g.inc.where(F.col("t") == "keyword"))


_SEED = "s0 AS (SELECT DISTINCT pa.v FROM pa JOIN kwp USING (e) WHERE kwp.year = 1995)"
_RING = "s{k} AS (SELECT DISTINCT b.v FROM pa a JOIN pa b USING (e) WHERE a.v IN (SELECT v FROM s{j}) AND b.v NOT IN ({seen}))"
_RINGS = ", ".join([_SEED, _RING.format(k=1, j=0, seen="SELECT v FROM s0"), _RING.format(k=2, j=1, seen="SELECT v FROM s0 UNION ALL SELECT v FROM s1")])


def _seed_authors(g: incidence.Hypergraph) -> DataFrame:
    kw = g.inc.where(F.col("t") == "keyword").join(g.edges.where(F.col("year") == 1995), "e", "left_semi")
    return g.inc.where(F.col("t") == "author").join(kw.select("e"), "e", "left_semi").select("v").distinct()


@query(f"{BASE}, {_RINGS} SELECT v, 0 AS ring FROM s0 UNION ALL SELECT v, 1 FROM s1 UNION ALL SELECT v, 2 FROM s2")
def coauthor_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir).written()
    return incidence.coauthor_rings(g.inc, _seed_authors(g), 2)


@query(f"{BASE}, {_RINGS} SELECT v FROM s1 UNION ALL SELECT v FROM s2")
def coauthors_deg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir).written()
    return incidence.coauthors(g.inc, _seed_authors(g), 2)


@query(f"{BASE} SELECT DISTINCT a.t AS t1, a.v AS v1, b.t AS t2, b.v AS v2 FROM win a JOIN win b USING (e)")
def projection_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidence.projection(recent(spark, sf_dir).inc)


_TM = "SELECT a.t AS t1, a.v AS v1, b.t AS t2, b.v AS v2, sum({w}) / any_value(deg.d) AS p FROM win a JOIN win b USING (e) JOIN {s} USING (e) JOIN deg ON deg.t = a.t AND deg.v = a.v"
_ENTITY = lambda t: t == "entity"


@query(f"{BASE} SELECT t1, v1, t2, v2, round(p, 9) AS p FROM ({_TM.format(w='1.0 / siz.s', s='siz')} WHERE a.t = 'entity' AND b.t = 'entity' GROUP BY 1, 2, 3, 4)")
def transprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = hops.transition_matrix(recent(spark, sf_dir).inc, _ENTITY, _ENTITY)
    return m.withColumn("p", F.round("p", 9))


def _alpha_sql(alpha: float) -> str:
    return f"""grp AS (SELECT e, sum((t = 'author')::INT)::DOUBLE AS a, sum((t <> 'author')::INT)::DOUBLE AS o FROM win GROUP BY e),
wts AS (SELECT e, CASE WHEN a > 0 AND o > 0 THEN {1 / (alpha + 1)!r} / a WHEN a > 0 THEN 1 / a END AS w_author, CASE WHEN a > 0 AND o > 0 THEN {alpha / (alpha + 1)!r} / o WHEN o > 0 THEN 1 / o END AS w_other FROM grp)"""


_W = "CASE WHEN {b}.t = 'author' THEN wts.w_author ELSE wts.w_other END"


@query(f"{BASE}, {_alpha_sql(2.0)} SELECT t1, v1, t2, v2, round(p, 9) AS p FROM ({_TM.format(w=_W.format(b='b'), s='wts')} WHERE a.t <> 'author' AND b.t = 'entity' GROUP BY 1, 2, 3, 4)")
def transprob_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = hops.transition_matrix(recent(spark, sf_dir).inc, lambda t: t != "author", _ENTITY, 2.0)
    return m.withColumn("p", F.round("p", 9))


_PLAIN = "wts AS (SELECT e, 1.0 / s AS w_author, 1.0 / s AS w_other FROM siz)"


def _steps(nstep: int, through: str, forward: bool, name: str = "x") -> str:
    """CTEs name0 .. name<nstep> of a walk from the keyword; intermediates limited by a predicate on t."""
    out = [f"{name}0 AS (SELECT 'keyword' AS t, 0::BIGINT AS v, 1.0::DOUBLE AS x WHERE EXISTS (SELECT 1 FROM win WHERE t = 'keyword'))"]
    for i in range(1, nstep + 1):
        src = f"(SELECT * FROM {name}{i - 1} WHERE {through})" if i > 1 else f"{name}0"
        if forward:
            out.append(f"{name}m{i} AS (SELECT w.e, sum(x.x / deg.d) AS m FROM {src} x JOIN deg USING (t, v) JOIN win w USING (t, v) GROUP BY w.e)")
            out.append(f"{name}{i} AS (SELECT w.t, w.v, sum(m.m * {_W.format(b='w')}) AS x FROM {name}m{i} m JOIN win w USING (e) JOIN wts USING (e) GROUP BY w.t, w.v)")
        else:
            out.append(f"{name}m{i} AS (SELECT w.e, sum(x.x * {_W.format(b='w')}) AS m FROM {src} x JOIN win w USING (t, v) JOIN wts USING (e) GROUP BY w.e)")
            out.append(f"{name}{i} AS (SELECT w.t, w.v, sum(m.m) / any_value(deg.d) AS x FROM {name}m{i} m JOIN win w USING (e) JOIN deg USING (t, v) GROUP BY w.t, w.v)")
    return ", ".join(out)


def _access(nstep: int, through: str, forward: bool = True, target: str = "entity", weights: str = _PLAIN) -> str:
    return f"{BASE}, {weights}, {_steps(nstep, through, forward)} SELECT k.v, round(coalesce(x.x, 0), 9) AS score FROM (SELECT DISTINCT v FROM win WHERE t = '{target}') k LEFT JOIN (SELECT v, x FROM x{nstep} WHERE t = '{target}') x USING (v)"


def _scores(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return hops.accessibility(recent(spark, sf_dir).inc, **options).select("v", F.round("score", 9).alias("score"))


def _predict_sql(nstep: int, weights: str = _PLAIN) -> str:
    return f"""{BASE}, {weights}, {_steps(nstep, "t <> 'keyword'", True)}
SELECT k.v, round(coalesce(x.x, 0), 9) AS score FROM (SELECT DISTINCT v FROM inc WHERE t = 'entity' AND v NOT IN (SELECT v FROM fy WHERE year < {YEAR})) k LEFT JOIN (SELECT v, x FROM x{nstep} WHERE t = 'entity') x USING (v)
ORDER BY round(coalesce(x.x, 0), 9) DESC, k.v LIMIT 50"""


def _predicted(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return hypergraph_transition(graph(spark, sf_dir).written(), **options)(YEAR, size=50, scores=True)


@query(_predict_sql(1))
def access_kw_to_entity_1step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best entities not yet studied, one step from the property (0 by definition: ties by id)."""
    return _predicted(spark, sf_dir)


@query(_predict_sql(2))
def predict_hypergraph_2step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the 50 entities not yet studied that are nearest to the property in two steps."""
    return _predicted(spark, sf_dir, nstep=2)


@query(_predict_sql(2, _alpha_sql(0.5)))
def predict_hypergraph_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, nstep=2, alpha=0.5)


@query(_access(2, "t <> 'keyword'"))
def access_kw_to_entity_2step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, nstep=2)


@query(_access(3, "t <> 'keyword'"))
def access_kw_to_entity_3step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, nstep=3)


@query(_access(2, "t <> 'keyword'", weights=_alpha_sql(2.0)))
def access_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, nstep=2, alpha=2.0)


@query(_access(2, "t = 'author'", forward=False))
def access_entity_to_kw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, direction="CtoKW", nstep=2)


@query(f"""{BASE}, {_PLAIN}, {_steps(2, "t = 'author'", True, "x")}, {_steps(2, "t = 'author'", False, "y")}
SELECT k.v, round((coalesce(x2.x, 0) + coalesce(y2.x, 0)) / 2, 9) AS score FROM (SELECT DISTINCT v, t FROM win WHERE t = 'entity') k LEFT JOIN x2 USING (t, v) LEFT JOIN y2 USING (t, v)""")
def access_both_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, direction="both_way", nstep=2)


@query(_access(2, "t = 'entity'", target="author"))
def access_kw_to_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, direction="KWtoA", nstep=2)


@query(f"""{BASE}, q AS ({_TM.format(w="1.0 / siz.s", s="siz")} WHERE a.t <> 'author' AND b.t <> 'author' AND NOT (a.t = b.t AND a.v = b.v) GROUP BY 1, 2, 3, 4)
SELECT t1, v1, t2, v2, round(p / sum(p) OVER (PARTITION BY t1, v1), 9) AS p FROM q""")
def entity_transition_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops.entity_graph(recent(spark, sf_dir).inc).withColumn("p", F.round("p", 9))


@query(f"""{BASE}, m AS ({_TM.format(w="1.0 / siz.s", s="siz")} WHERE NOT (a.t = 'author' AND b.t = 'author') GROUP BY 1, 2, 3, 4),
q AS (SELECT t1, v1, t2, v2, sum(p) AS p FROM (SELECT * FROM m WHERE t1 <> 'author' AND t2 <> 'author'
  UNION ALL SELECT u.t1, u.v1, w.t2, w.v2, u.p * w.p FROM m u JOIN m w ON u.t2 = 'author' AND w.t1 = 'author' AND u.v2 = w.v1 WHERE u.t1 <> 'author' AND w.t2 <> 'author') GROUP BY 1, 2, 3, 4),
r AS (SELECT * FROM q WHERE NOT (t1 = t2 AND v1 = v2))
SELECT t1, v1, t2, v2, round(p / sum(p) OVER (PARTITION BY t1, v1), 9) AS p FROM r""")
def entity_transition_graph_2step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hops.entity_graph(recent(spark, sf_dir).inc, True).withColumn("p", F.round("p", 9))


def _bfs_sql(kinds: str) -> str:
    """Distances of nodes by doubling the frontier; UNION keeps (node, distance) pairs once, up to a depth that covers the tables."""
    return f"""g AS (SELECT * FROM inc WHERE t IN ({kinds})),
b AS (SELECT 'keyword' AS t, 0::BIGINT AS v, 0 AS dist UNION SELECT n.t, n.v, b.dist + 1 FROM b JOIN g s USING (t, v) JOIN g n USING (e) WHERE b.dist < 6),
ds AS (SELECT t, v, min(dist) AS dist FROM b GROUP BY t, v)"""


@query(f"{BASE}, {_bfs_sql(chr(39) + 'author' + chr(39) + ', ' + chr(39) + 'entity' + chr(39) + ', ' + chr(39) + 'keyword' + chr(39))} SELECT k.v, coalesce(ds.dist * 2, -1) AS dist FROM (SELECT DISTINCT t, v FROM inc WHERE t = 'entity') k LEFT JOIN ds USING (t, v)")
def shortest_path_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.keyword_distance(graph(spark, sf_dir).written().inc)


@query(f"""{BASE}, {_bfs_sql("'author', 'keyword'")}, oe AS (SELECT g.e, min(ds.dist) AS dist FROM g JOIN ds USING (t, v) GROUP BY g.e)
SELECT k.v, coalesce(min(oe.dist) + 1, -1) AS dist FROM (SELECT e, v FROM inc WHERE t = 'entity') k LEFT JOIN oe USING (e) GROUP BY k.v""")
def shortest_path_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.keyword_distance_by_authors(graph(spark, sf_dir).written().inc)


@query(f"""{BASE}, {_bfs_sql("'author', 'keyword'")}, oe AS (SELECT g.e, min(ds.dist) AS dist FROM g JOIN ds USING (t, v) GROUP BY g.e),
d AS (SELECT k.v, coalesce(min(oe.dist) + 1, -1) AS dist FROM (SELECT e, v FROM inc WHERE t = 'entity') k LEFT JOIN oe USING (e) GROUP BY k.v)
SELECT CASE WHEN dist < 0 THEN 6 WHEN dist <= 4 THEN dist ELSE 5 END::INT AS bin, count(*) AS n FROM d GROUP BY 1""")
def spd_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paths.keyword_distance_by_authors(graph(spark, sf_dir).written().inc)
    return d.groupBy(distance_bin(F.col("dist")).alias("bin")).agg(F.count("*").alias("n"))


def _named(spark: SparkSession, sf_dir: str, w: DataFrame) -> DataFrame:
    """Walk nodes as tokens."""
    names = catalog(spark, sf_dir).entity.select(F.lit("entity").alias("t"), F.col("entity_id").alias("v"), "name")
    named = w.join(names, ["t", "v"], "left")
    return named.withColumn("token", F.when(F.col("t") == "keyword", PROPERTY.replace(" ", "_")).otherwise(F.coalesce(text.node_token(F.col("t"), F.col("v"), F.col("name")), F.concat(F.lit("e_"), F.col("v").cast("string")))))


@query()
def deepwalk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = walks.keyword_walks(recent(spark, sf_dir).inc, 200, 6)
    return walks.sentences(_named(spark, sf_dir, w), F.col("token"))


@query()
def deepwalk_edge_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.edge_sequences(walks.keyword_walks(recent(spark, sf_dir).inc, 200, 6))


@query()
def node2vec_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.keyword_walks(recent(spark, sf_dir).inc, 200, 6, q=0.5)


@query()
def weighted_walks_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.keyword_walks(recent(spark, sf_dir).inc, 200, 5, weight=walks.weight_alpha(2.0))


@query()
def weighted_walks_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.keyword_walks(recent(spark, sf_dir).inc, 200, 5, weight=walks.weight_entities)


@query()
def weighted_walks_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.keyword_walks(recent(spark, sf_dir).inc, 200, 5, weight=walks.weight_mixture({"author": 0.4, "entity": 0.6}))


def _plain_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = hops.entity_graph(recent(spark, sf_dir).inc).where((F.col("t1") == "entity") & (F.col("t2") == "entity"))
    return materialise(m.select(F.col("v1").alias("src"), F.col("v2").alias("dst"), "p"), "transitions")


@query()
def positive_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.positive_samples(_plain_transitions(spark, sf_dir), 3, 4)


@query(f"""{BASE}, q AS ({_TM.format(w="1.0 / siz.s", s="siz")} WHERE a.t = 'entity' AND b.t = 'entity' AND a.v <> b.v GROUP BY 1, 2, 3, 4) SELECT DISTINCT v1 AS src, v2 AS dst FROM q""")
def edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_transitions(spark, sf_dir).select("src", "dst").distinct()


@query()
def expert_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expert(spark, sf_dir)[0]


def _expert(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Walks from the property (node -1) over its entities, with the shared authors of two nodes as density; and the pool."""
    inc = recent(spark, sf_dir).inc
    node = F.when(F.col("t") == "keyword", F.lit(-1)).otherwise(F.col("v"))
    near = hops.entity_graph(inc)
    code = lambda i: F.when(F.col(f"t{i}") == "keyword", F.lit(-1)).otherwise(F.col(f"v{i}"))
    edges = near.select(code(1).alias("src"), code(2).alias("dst"))
    density = materialise(hops.entity_graph(inc, True).select(code(1).alias("src"), code(2).alias("dst"), F.col("p").alias("d")), "expert-density")
    pool = inc.where(F.col("t").isin("entity", "keyword")).select(node.alias("v")).distinct()
    starts = spark.range(50).select(F.col("id").alias("walk"), F.lit(-1).cast("long").alias("v"))
    return walks.expert_walks(density, edges, pool, starts, 4, 0.4), pool


@query()
def random_entities_of_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    inc = recent(spark, sf_dir).inc
    return walks.random_entities(walks.keyword_walks(inc, 200, 6), inc.where(F.col("t") == "entity"))


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as walks: (walk, pos, token) of each user in order of time."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("ts", to_utc_ntz(F.col("ts")))
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("walk"), pos.alias("pos"), F.col("event_type").alias("token"))


EVENTS = "ev AS (SELECT user_id AS walk, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS token FROM events)"


@query(f"""WITH {EVENTS}, s AS (SELECT *, last_value(CASE WHEN token = 'signup' THEN pos END IGNORE NULLS) OVER (PARTITION BY walk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM ev),
h AS (SELECT walk, src, token AS target, min(pos - src) AS d FROM s WHERE src IS NOT NULL AND token <> 'signup' GROUP BY 1, 2, 3) SELECT target, round(avg(d), 9) AS dist, count(*) AS n FROM h GROUP BY target""")
def first_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.first_passage(event_tokens(spark, sf_dir), "signup").withColumn("dist", F.round("dist", 9))
