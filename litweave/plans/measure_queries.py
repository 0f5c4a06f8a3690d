"""Queries of ground truth, co-occurrence, density, ranking, predictors and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.functions import scores
from litweave.operators import density, evaluate, hops, paths, ranking, truth
from litweave.plans import predictors
from litweave.plans.common import BASE, LAST, MEMORY, PROPERTY, YEAR, catalog, graph, keyword_papers, recent
from litweave.plans.graph_queries import _PLAIN, _bfs_sql, _predict_sql, _steps
from litweave.runtime import materialise

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ground truth


@query(f"{BASE} SELECT v FROM fy WHERE year < {YEAR}")
def studied_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.studied_before(graph(spark, sf_dir), YEAR)


@query(f"{BASE} SELECT DISTINCT v AS entity FROM fy WHERE year < {YEAR}")
def studied_by_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = truth.studied_pairs(graph(spark, sf_dir)).select(F.col("v").alias("entity"), "year")
    return truth.studied_by_links(links, YEAR)


@query(f"{BASE} SELECT DISTINCT v FROM pe WHERE v NOT IN (SELECT v FROM fy WHERE year < {YEAR})")
def unstudied_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.unstudied(graph(spark, sf_dir), YEAR)


@query(f"{BASE} SELECT st.v, st.e FROM st JOIN fy USING (v, year) WHERE year = {YEAR}")
def year_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.year_discoveries(graph(spark, sf_dir), YEAR, papers=True)


@query(f"{BASE} SELECT v, year FROM fy")
def all_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.discoveries(graph(spark, sf_dir))


@query(f"{BASE} SELECT DISTINCT st.year, pa.v AS author FROM st JOIN fy USING (v, year) JOIN pa ON pa.e = st.e")
def year_discoverers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth.discoverers(graph(spark, sf_dir))


@query(f"{BASE} SELECT '{PROPERTY}' AS disease, lower(replace(c.name, ' ', '_')) AS entity, fy.year FROM fy JOIN chemical c ON c.chemical_id = fy.v WHERE c.name IS NOT NULL")
def links_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First years as JSON objects by entity, and read back."""
    named = truth.discoveries(graph(spark, sf_dir)).join(catalog(spark, sf_dir).entity.withColumnRenamed("entity_id", "v"), "v").where(F.col("name").isNotNull())
    docs = named.select(F.to_json(F.create_map(F.lit(PROPERTY), F.create_map("name", "year"))).alias("json"))
    return truth.links_of_json(docs, "json")


# co-occurrence and density


@query(f"{BASE} SELECT v, year, count(*) AS n FROM st GROUP BY v, year")
def cooccurrence_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.cooccurrences(graph(spark, sf_dir))


@query(f"{BASE}, c AS (SELECT v, year, count(*) AS n FROM st GROUP BY v, year), y AS (SELECT unnest(range((SELECT min(year) FROM c), (SELECT max(year) FROM c) + 1))::INT AS year) SELECT k.v, y.year, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT v FROM c) k CROSS JOIN y LEFT JOIN c USING (v, year)")
def cooccurrence_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.dense_years(density.cooccurrences(graph(spark, sf_dir)))


@query(f"{BASE} SELECT v, year, sum(n) OVER (PARTITION BY v ORDER BY year)::BIGINT AS total FROM (SELECT v, year, count(*) AS n FROM st GROUP BY v, year)")
def cooccurrence_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.running(density.cooccurrences(graph(spark, sf_dir)))


_SD = f"""{BASE}, ya AS (SELECT DISTINCT kwp.year, pa.v AS author FROM kwp JOIN pa USING (e) WHERE kwp.year IS NOT NULL),
xa AS (SELECT DISTINCT pe.v, p.year, pa.v AS author FROM pe JOIN p USING (e) JOIN pa USING (e) WHERE p.year IS NOT NULL),
ny AS (SELECT year, count(*) AS n FROM ya GROUP BY year),
nx AS (SELECT xa.v, xa.year, count(*) AS n, count(ya.author) AS b FROM xa LEFT JOIN ya ON ya.year = xa.year AND ya.author = xa.author GROUP BY 1, 2),
sd AS (SELECT nx.v, nx.year, nx.b::DOUBLE / (nx.n + ny.n - nx.b) AS sd FROM nx JOIN ny USING (year))"""


@query(f"{_SD} SELECT v, year, round(sd, 9) AS sd FROM sd")
def social_density_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.social_density(graph(spark, sf_dir).written()).withColumn("sd", F.round("sd", 9))


@query(f"{_SD} SELECT v, round(sum(sd), 9) AS score FROM sd WHERE year BETWEEN {YEAR - MEMORY} AND {YEAR - 1} GROUP BY v")
def social_density_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.scalar_density(density.social_density(graph(spark, sf_dir).written()), YEAR, MEMORY).withColumn("score", F.round("score", 9))


@query()
def social_density_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.random_density(density.social_density(graph(spark, sf_dir)), YEAR, MEMORY)


_SETS = f"""{BASE}, x AS (SELECT DISTINCT p.year, pa.v AS author FROM p JOIN pa USING (e) WHERE p.year IS NOT NULL AND p.title ILIKE '%film%'),
y AS (SELECT DISTINCT kwp.year, pa.v AS author FROM kwp JOIN pa USING (e) WHERE kwp.year IS NOT NULL)"""


@query(f"""{_SETS} SELECT year, count(*) FILTER (x.author IS NOT NULL AND y.author IS NOT NULL) AS n_both, count(*) AS n_any
FROM x FULL JOIN y USING (year, author) WHERE year IN (SELECT year FROM y) GROUP BY year""")
def yearwise_author_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litweave.functions.predicates import keyword
    from litweave.operators.incidence import author_block

    c = catalog(spark, sf_dir)
    pa = author_block(c).select(F.col("e").alias("paper_id"), F.col("v").alias("author"))
    dated = c.paper.where(F.col("year").isNotNull())
    x = dated.where(keyword(("title",), "film")).join(pa, "paper_id").select("year", "author")
    y = keyword_papers(c).join(dated, "paper_id").join(pa, "paper_id").select("year", "author")
    return density.author_sets(x, y)


@query("""WITH t AS (SELECT DISTINCT w AS term, venue AS author FROM (SELECT venue, unnest(string_split_regex(trim(text, ' '), '\\s+')) AS w FROM documents WHERE venue IS NOT NULL) WHERE w IN ('membranes', 'charge')),
a AS (SELECT author, max((term = 'membranes')::INT) AS a, max((term = 'charge')::INT) AS b FROM t GROUP BY author)
SELECT round(CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(a * b)::DOUBLE / (sum(a) + sum(b)) ELSE 0 END, 9) AS jsd FROM a""")
def jaccard_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litweave.runtime import table

    d = table(spark, sf_dir, "documents").where(F.col("venue").isNotNull())
    tokens = d.select(F.explode(F.split("text", r"\s+")).alias("term"), F.col("venue").alias("author"))
    return density.joint_density(tokens, "membranes", "charge").withColumn("jsd", F.round("jsd", 9))


# combined scores: social density against two-step accessibility, over entities that have both

_BOTH_SQL = f"""{_SD}, {_PLAIN}, {_steps(2, "t <> 'keyword'", True)},
s1 AS (SELECT v, round(sum(sd), 9) AS s1 FROM sd WHERE year BETWEEN {YEAR - MEMORY} AND {YEAR - 1} GROUP BY v HAVING round(sum(sd), 9) > 0),
s2 AS (SELECT v, round(x, 9) AS s2 FROM x2 WHERE t = 'entity' AND round(x, 9) > 0),
s AS (SELECT * FROM s1 JOIN s2 USING (v)),
r AS (SELECT *, rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / 2.0 AS r1, rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2.0 AS r2 FROM s)"""
BETA = 0.3


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir).written()
    s1 = density.scalar_density(density.social_density(g), YEAR, MEMORY).select("v", F.round("score", 9).alias("s1")).where(F.col("s1") > 0)
    s2 = hops.accessibility(g.window(YEAR, MEMORY).written().inc, nstep=2).select("v", F.round("score", 9).alias("s2")).where(F.col("s2") > 0)
    return s1.join(s2, "v")


def _combined(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return ranking.combine(_both(spark, sf_dir), "s1", "s2", BETA, method).select("v", F.round("score", 6).alias("score"))


@query(f"{_BOTH_SQL} SELECT v, round(-({BETA} * r1 + {1 - BETA} * r2), 6) AS score FROM r")
def combine_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir, "ranking")


@query(f"{_BOTH_SQL} SELECT v, round(sqrt(pow(s1, {BETA}) * pow(s2, {1 - BETA})), 6) AS score FROM s")
def combine_geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir, "geometric")


@query(f"{_BOTH_SQL} SELECT v, round(2 / ({BETA} / s1 + {1 - BETA} / s2), 6) AS score FROM s")
def combine_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir, "harmonic")


@query(f"{_BOTH_SQL} SELECT v, round({BETA} * (s1 - avg(s1) OVER ()) / nullif(stddev_pop(s1) OVER (), 0) + {1 - BETA} * (s2 - avg(s2) OVER ()) / nullif(stddev_pop(s2) OVER (), 0), 6) AS score FROM s")
def combine_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir, "z-score")


def _inverse_normal_sql(p: str) -> str:
    """The same rational approximation in SQL."""
    h = lambda x, cs: "".join("(" for _ in cs[1:]) + repr(cs[0]) + "".join(f" * {x} + {c!r})" for c in cs[1:])
    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    mid = f"{h(r, scores._A)} * {q} / ({h(r, scores._B)} * {r} + 1.0)"
    tail = lambda x: f"{h(x, scores._C)} / ({h(x, scores._D)} * {x} + 1.0)"
    return f"CASE WHEN {p} < {scores._LOW} THEN {tail(f'sqrt(-2.0 * ln({p}))')} WHEN {p} > {1 - scores._LOW} THEN -({tail(f'sqrt(-2.0 * ln(1.0 - {p}))')}) ELSE {mid} END"


@query(f"""{_BOTH_SQL}, u AS (SELECT v, (r1 / (count(*) OVER () + 1))::DOUBLE AS p1, (r2 / (count(*) OVER () + 1))::DOUBLE AS p2 FROM r),
n AS (SELECT v, {_inverse_normal_sql("p1")} AS s1, {_inverse_normal_sql("p2")} AS s2 FROM u)
SELECT v, round({BETA} * (s1 - avg(s1) OVER ()) / nullif(stddev_pop(s1) OVER (), 0) + {1 - BETA} * (s2 - avg(s2) OVER ()) / nullif(stddev_pop(s2) OVER (), 0), 6) AS score FROM n""")
def combine_van_der_waerden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir, "van-der-waerden")


@query(f"{_BOTH_SQL} SELECT v, s2 AS score FROM s ORDER BY s2 DESC, v LIMIT 50")
def top_k_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(_both(spark, sf_dir).select("v", F.col("s2").alias("score")), 50)


# evaluation


@query(f"""WITH RECURSIVE preds AS ({_predict_sql(2)}), tr AS (SELECT v, year FROM ({BASE} SELECT * FROM fy)), y AS (SELECT unnest(range({YEAR}, {LAST}))::INT AS year),
h AS (SELECT y.year, count(DISTINCT tr.v) AS hits FROM y LEFT JOIN (SELECT tr.* FROM tr JOIN preds USING (v)) tr USING (year) GROUP BY y.year)
SELECT year, round(sum(hits) OVER (ORDER BY year)::DOUBLE / (SELECT count(*) FROM preds), 9) AS precision FROM h""")
def precision_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir).written()
    preds = materialise(predictors.hypergraph_transition(g, 2)(YEAR), "predictions")
    return evaluate.precision_by_year(preds, truth.discoveries(g), YEAR, LAST).withColumn("precision", F.round("precision", 9))


@query(f"""{BASE}, {_PLAIN}, {_steps(2, "t <> 'keyword'", True)},
k AS (SELECT u.v, round(coalesce(x.x, 0), 9) AS s, (u.v IN (SELECT v FROM fy WHERE year BETWEEN {YEAR} AND {LAST - 1}))::INT AS y FROM (SELECT DISTINCT v FROM pe WHERE v NOT IN (SELECT v FROM fy WHERE year < {YEAR})) u LEFT JOIN (SELECT v, x FROM x2 WHERE t = 'entity') x USING (v)),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM k)
SELECT round((sum(y * r) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)::DOUBLE, 9) AS auc FROM r""")
def auc_of_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir).written()
    scored = predictors.hypergraph_transition(g, 2)(YEAR, size=None, scores=True)
    later = truth.discoveries(g).where(F.col("year").between(YEAR, LAST - 1)).select("v", F.lit(1).alias("label"))
    return evaluate.auc(scored.join(later, "v", "left").withColumn("label", F.coalesce("label", F.lit(0)))).withColumn("auc", F.round("auc", 9))


_AUTHORS = f"""{BASE}, {_PLAIN}, {_steps(2, "t <> 'keyword'", True)}, preds AS (SELECT v AS author FROM x2 WHERE t = 'author' ORDER BY round(x, 9) DESC, v LIMIT 50),
tr AS (SELECT DISTINCT st.year, pa.v AS author FROM st JOIN fy USING (v, year) JOIN pa ON pa.e = st.e)"""


def _authors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = graph(spark, sf_dir).written()
    return materialise(predictors.author_access_predictor(g, 2)(YEAR, size=50), "predictions"), truth.discoverers(g)


@query(f"{_AUTHORS}, y AS (SELECT unnest(range({YEAR}, {LAST}))::INT AS year) SELECT y.year, round(count(DISTINCT t.author)::DOUBLE / (SELECT count(*) FROM preds), 9) AS precision FROM y LEFT JOIN (SELECT tr.* FROM tr JOIN preds USING (author)) t USING (year) GROUP BY y.year")
def author_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds, found = _authors(spark, sf_dir)
    return evaluate.precision_by_year(preds, found, YEAR, LAST, cumulative=False, key="author").withColumn("precision", F.round("precision", 9))


@query(f"{_AUTHORS} SELECT author, list_sort(list(DISTINCT year)) AS years FROM tr JOIN preds USING (author) WHERE year BETWEEN {YEAR} AND {LAST - 1} GROUP BY author")
def author_hit_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.author_years(*_authors(spark, sf_dir), YEAR, LAST)


@query(f"{_AUTHORS} SELECT author FROM preds")
def predict_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _authors(spark, sf_dir)[0]


@query(f"{_SD} SELECT v, round(sum(sd), 9) AS score FROM sd WHERE year BETWEEN {YEAR - MEMORY} AND {YEAR - 1} AND v NOT IN (SELECT v FROM fy WHERE year < {YEAR}) GROUP BY v ORDER BY 2 DESC, v LIMIT 50")
def predict_social_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictors.social_density_predictor(graph(spark, sf_dir).written())(YEAR, scores=True)


@query(f"""{BASE}, {_PLAIN}, {_steps(2, "t <> 'keyword'", True)}, y AS (SELECT v, year, count(*)::DOUBLE AS n FROM st WHERE year >= 2005 GROUP BY v, year),
s AS (SELECT year, list(n ORDER BY v) AS values FROM y GROUP BY year), u AS (SELECT unnest(values) AS value, generate_subscripts(values, 1) - 1 AS pos FROM s)
SELECT pos::INT AS pos, round(avg(value), 9) AS value FROM u WHERE pos < (SELECT len(values) FROM s ORDER BY year LIMIT 1) GROUP BY pos""")
def mean_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = materialise(density.cooccurrences(graph(spark, sf_dir)).where(F.col("year") >= 2005), "counts")
    return density.by_position(c.select("year", "v", F.col("n").cast("double").alias("value")), "v").withColumn("value", F.round("value", 9))


# distance against score: the trade-off between near and far entities

_ORBITS = f"""{BASE}, {_bfs_sql("'author', 'keyword'")}, oe AS (SELECT g.e, min(ds.dist) AS dist FROM g JOIN ds USING (t, v) GROUP BY g.e),
d AS (SELECT k.v, coalesce(min(oe.dist) + 1, -1) AS spd FROM (SELECT e, v FROM inc WHERE t = 'entity') k LEFT JOIN oe USING (e) GROUP BY k.v),
o AS (SELECT d.v, d.spd, n.n::DOUBLE AS score FROM d JOIN (SELECT v, count(*) AS n FROM pe GROUP BY v) n USING (v) WHERE d.spd > 0)"""


def _orbit_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litweave.operators.incidence import node_degrees

    g = graph(spark, sf_dir).written()
    d = paths.keyword_distance_by_authors(g.inc)
    n = node_degrees(g.inc.where(F.col("t") == "entity")).select("v", F.col("d").cast("double").alias("score"))
    return d.join(n, "v").select("v", F.col("dist").alias("spd"), "score")


@query(f"""{_ORBITS}, ob AS (SELECT spd, avg(score) AS m, count(*) AS n FROM o GROUP BY spd), oc AS (SELECT *, greatest(0, least(n, 500 - (sum(n) OVER (ORDER BY spd) - n))) AS take FROM ob)
SELECT round(sum(m * take) / sum(take), 9) AS score FROM oc WHERE take > 0""")
def extreme_orbit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _orbit_items(spark, sf_dir).where(F.col("spd") > 0)
    return evaluate.extreme_orbits(items, 500).withColumn("score", F.round("score", 9))


_BETAS = [b / 10 for b in range(-10, 11)]
_TRADEOFF = f"""{_ORBITS.replace("WHERE d.spd > 0)", ")")}, lv AS (SELECT v, spd, CASE WHEN spd < 0 THEN 6 WHEN spd <= 4 THEN spd ELSE 5 END::INT AS level, score AS near, score AS outer_ FROM o),
rk AS (SELECT *, (rank() OVER (ORDER BY level) + (count(*) OVER (PARTITION BY level) - 1) / 2.0)::DOUBLE / (count(*) OVER () + 1) AS p1, (rank() OVER (ORDER BY near) + (count(*) OVER (PARTITION BY near) - 1) / 2.0)::DOUBLE / (count(*) OVER () + 1) AS p2 FROM lv),
nq AS (SELECT *, {_inverse_normal_sql("p1")} AS s1, {_inverse_normal_sql("p2")} AS s2 FROM rk),
qs AS (SELECT *, (s1 - avg(s1) OVER ()) / nullif(stddev_pop(s1) OVER (), 0) AS q1, (s2 - avg(s2) OVER ()) / nullif(stddev_pop(s2) OVER (), 0) AS q2 FROM nq),
bt AS (SELECT unnest({_BETAS!r})::DOUBLE AS beta),
bs AS (SELECT * FROM (SELECT beta, v, level, outer_, row_number() OVER (PARTITION BY beta ORDER BY round(beta * q1 + (1 - abs(beta)) * q2, 9) DESC, v) AS k FROM qs, bt) WHERE k <= 50)"""


@query(f"{_TRADEOFF} SELECT b.beta, l.level, round(count(x.v) / 50.0, 9)::DOUBLE AS share, round(coalesce(avg(x.outer_), 0), 9) AS mean_outer FROM bt b CROSS JOIN (SELECT unnest(range(1, 7))::INT AS level) l LEFT JOIN bs x ON x.beta = b.beta AND x.level = l.level GROUP BY 1, 2")
def orbit_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares and mean scores of the 50 best by distance level, for every beta."""
    levels, _ = _orbits(spark, sf_dir)
    return levels.select("beta", "level", F.round("share", 9).alias("share"), F.round("mean_outer", 9).alias("mean_outer"))


def _edge_sql(order: str) -> str:
    return f"(SELECT sum(m * take) / sum(take) FROM (SELECT *, greatest(0, least(n, 50 - (sum(n) OVER (ORDER BY spd {order}) - n))) AS take FROM (SELECT spd, avg(score) AS m, count(*) AS n FROM o WHERE spd > 0 GROUP BY spd)) WHERE take > 0)"


@query(f"{_TRADEOFF} SELECT beta, round(count(*) FILTER (v IN (SELECT v FROM fy WHERE year BETWEEN {YEAR} AND {LAST - 1}))::DOUBLE / count(*), 9) AS precision, round(CASE WHEN beta = -1 THEN {_edge_sql('ASC')} WHEN beta = 1 THEN {_edge_sql('DESC')} ELSE avg(outer_) END, 9) AS score FROM bs GROUP BY beta")
def orbit_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and mean score of the 50 best for every beta."""
    _, whole = _orbits(spark, sf_dir)
    return whole.select("beta", F.round("precision", 9).alias("precision"), F.round("score", 9).alias("score"))


def _orbits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = _orbit_items(spark, sf_dir).select("v", "spd", F.log("score").alias("sim"), F.col("score").alias("outer"))
    later = truth.discoveries(graph(spark, sf_dir)).where(F.col("year").between(YEAR, LAST - 1))
    return evaluate.orbit_scores(materialise(items, "orbits"), _BETAS, 50, later)


@query(f"""{BASE}, sim AS (SELECT a.v AS i, b.v AS j, count(*) / sqrt(any_value(na.d) * any_value(nb.d)) AS c FROM win a JOIN win b USING (e) JOIN deg na ON na.t = 'entity' AND na.v = a.v JOIN deg nb ON nb.t = 'entity' AND nb.v = b.v
  WHERE a.t = 'entity' AND b.t = 'entity' AND a.v <> b.v GROUP BY 1, 2),
x AS (SELECT i, j, exp(10 * ((c + 1) / 2 - 0.3 * (1.0 / deg.d))) AS s FROM sim JOIN deg ON deg.t = 'entity' AND deg.v = j)
SELECT i, j, round(s / sum(s) OVER (PARTITION BY i), 9) AS p FROM x""")
def softmax_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition from similarity and density: row softmax of 10 ((cos + 1) / 2 - 0.3 density)."""
    from litweave.operators.incidence import node_degrees

    inc = recent(spark, sf_dir).inc.where(F.col("t") == "entity")
    d = node_degrees(inc).select("v", "d")
    pairs = inc.select("e", F.col("v").alias("i")).join(inc.select("e", F.col("v").alias("j")), "e").where(F.col("i") != F.col("j")).groupBy("i", "j").agg(F.count("*").alias("n"))
    both = pairs.join(d.select(F.col("v").alias("i"), F.col("d").alias("di")), "i").join(d.select(F.col("v").alias("j"), F.col("d").alias("dj")), "j")
    cos = F.col("n") / F.sqrt((F.col("di") * F.col("dj")).cast("double"))
    scored = both.select("i", "j", (10 * ((cos + 1) / 2 - 0.3 / F.col("dj"))).alias("s"))
    return scored.select("i", "j", F.round(scores.softmax(F.col("s"), "i"), 9).alias("p"))


@query(f"{BASE}, q AS (SELECT v, pow(d, 0.75) AS w FROM deg WHERE t = 'entity') SELECT v, round(w / (SELECT sum(w) FROM q), 9) AS p FROM q")
def negative_sampling_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    from litweave.operators.training import negative_distribution

    return negative_distribution(recent(spark, sf_dir).inc.where(F.col("t") == "entity")).select("v", F.round("p", 9).alias("p"))


@query(f"""{BASE}, ys AS (SELECT i.e, i.t, i.v, p.year FROM inc i JOIN p USING (e) WHERE p.year BETWEEN {YEAR - MEMORY} AND {YEAR - 1}),
sy AS (SELECT e, count(*) AS s FROM ys GROUP BY e), dk AS (SELECT year, count(*) AS d FROM ys WHERE t = 'keyword' GROUP BY year),
ay AS (SELECT n.v, n.year, sum(1.0 / (dk.d * sy.s)) AS x FROM ys k JOIN ys n USING (e) JOIN sy USING (e) JOIN dk ON dk.year = n.year WHERE k.t = 'keyword' AND n.t = 'entity' GROUP BY 1, 2)
SELECT q.v, round(coalesce(sum(ay.x), 0), 9) AS score FROM (SELECT DISTINCT v FROM ys WHERE t = 'entity') q LEFT JOIN ay USING (v) GROUP BY q.v""")
def access_scalar_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessibility of each of the years before, summed."""
    found = hops.accessibility_by_year(recent(spark, sf_dir), list(range(YEAR - MEMORY, YEAR)))
    return found.withColumn("score", F.round("score", 9))


@query(f"""WITH RECURSIVE preds AS ({_predict_sql(2)}), tr AS (SELECT v FROM ({BASE} SELECT v FROM fy WHERE year = {YEAR + 1}))
SELECT round(count(tr.v)::DOUBLE / count(*), 9) AS precision FROM preds LEFT JOIN tr USING (v)""")
def validation_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir).written()
    dots = materialise(predictors.hypergraph_transition(g, 2)(YEAR, scores=True), "predictions")
    return evaluate.validation_precision(dots, truth.year_discoveries(g, YEAR + 1)).withColumn("precision", F.round("precision", 9))
