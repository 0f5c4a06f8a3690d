"""The toy hypergraph with values worked out by hand, and invariants."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from fractions import Fraction as Fr
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from litweave.operators import density, evaluate, hops, incidence, paths, ranking, textstats, truth, walks
from litweave.operators.incidence import Hypergraph

A, X, K = "author", "entity", "keyword"
EDGES = {1: (2000, "a1 x K"), 2: (2000, "a1 a2 y"), 3: (2001, "a2 a3 z"), 4: (2001, "a2 y K"), 5: (2002, "a3 z K")}
IDS = {"a1": (A, 1), "a2": (A, 2), "a3": (A, 3), "x": (X, 11), "y": (X, 12), "z": (X, 13), "K": (K, 0)}
NAMES = {v: k for k, v in IDS.items()}


@pytest.fixture(scope="module")
def toy(spark):
    inc = spark.createDataFrame([(e, *IDS[n]) for e, (_, ns) in EDGES.items() for n in ns.split()], "e long, t string, v long").cache()
    return Hypergraph(spark.createDataFrame([(e, y) for e, (y, _) in EDGES.items()], "e long, year int").cache(), inc)


@pytest.fixture(scope="module")
def win(toy):
    return toy.window(2002, 5).inc.cache()


def near(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(float(want[k]), abs=1e-9), k


def test_degrees(win):
    assert {NAMES[r.t, r.v]: r.d for r in incidence.node_degrees(win).collect()} == {"a1": 2, "a2": 3, "a3": 1, "x": 1, "y": 2, "z": 1, "K": 2}


def test_transition_rows(win):
    every = lambda t: t.isNotNull()
    m = {(NAMES[r.t1, r.v1], NAMES[r.t2, r.v2]): r.p for r in hops.transition_matrix(win, every, every).collect()}
    near({k[1]: p for k, p in m.items() if k[0] == "K"}, {"a1": Fr(1, 6), "a2": Fr(1, 6), "x": Fr(1, 6), "y": Fr(1, 6), "K": Fr(1, 3)})
    near({k[1]: p for k, p in m.items() if k[0] == "a2"}, {"a1": Fr(1, 9), "a2": Fr(1, 3), "a3": Fr(1, 9), "y": Fr(2, 9), "z": Fr(1, 9), "K": Fr(1, 9)})
    alpha = {(NAMES[r.t1, r.v1], NAMES[r.t2, r.v2]): r.p for r in hops.transition_matrix(win, every, every, 1.0).collect()}
    near({k[1]: p for k, p in alpha.items() if k[0] == "K"}, {"a1": Fr(1, 4), "a2": Fr(1, 4), "x": Fr(1, 8), "y": Fr(1, 8), "K": Fr(1, 4)})
    for table in (m, alpha):
        for u in NAMES.values():
            assert sum(p for k, p in table.items() if k[0] == u) == pytest.approx(1)


@pytest.mark.parametrize(
    ("direction", "nstep", "want"),
    [
        ("KWtoC", 1, {"x": Fr(1, 6), "y": Fr(1, 6), "z": 0}),
        ("KWtoC", 2, {"x": Fr(1, 12), "y": Fr(13, 108), "z": Fr(1, 54)}),
        ("KWtoC", 3, {"x": Fr(35, 648), "y": Fr(7, 72), "z": Fr(1, 36)}),
        ("CtoKW", 2, {"x": Fr(1, 18), "y": Fr(7, 108), "z": Fr(1, 27)}),
        ("both_way", 2, {"x": Fr(1, 24), "y": Fr(7, 108), "z": Fr(1, 36)}),
    ],
)
def test_accessibility(win, direction, nstep, want):
    near({NAMES[X, r.v]: r.score for r in hops.accessibility(win, direction, nstep).collect()}, want)


def test_truth(toy):
    named = lambda df: {NAMES[X, r.v] for r in df.collect()}
    assert named(truth.studied_before(toy, 2002)) == {"x", "y"}
    assert named(truth.unstudied(toy, 2002)) == {"z"}
    for year, want in ((2000, {"x"}), (2001, {"y"}), (2002, {"z"})):
        found = named(truth.year_discoveries(toy, year))
        assert found == want
        assert named(truth.studied_before(toy, year)) | found == named(truth.studied_before(toy, year + 1))
    assert {(r.year, r.author) for r in truth.discoverers(toy).collect()} == {(2000, 1), (2001, 2), (2002, 3)}


def test_rings_and_paths(spark, toy, win):
    rings = {r.v: r.ring for r in incidence.coauthor_rings(toy.inc, spark.createDataFrame([(1,)], "v long"), 3).collect()}
    assert rings == {1: 0, 2: 1, 3: 2}
    assert {NAMES[X, r.v]: r.dist for r in paths.keyword_distance(win).collect()} == {"x": 2, "y": 2, "z": 4}
    assert {NAMES[X, r.v]: r.dist for r in paths.keyword_distance_by_authors(win).collect()} == {"x": 1, "y": 1, "z": 2}


def test_walks(spark, toy):
    for options in ({}, {"q": 0.5}, {"weight": walks.weight_alpha(2.0)}, {"weight": walks.weight_mixture({"author": 0.5, "entity": 0.5})}):
        rows = walks.keyword_walks(toy.inc, 40, 5, **options).collect()
        by = {}
        for r in rows:
            by.setdefault(r.walk, {})[r.pos] = r
        members = {e: {IDS[n] for n in ns.split()} for e, (_, ns) in EDGES.items()}
        for steps in by.values():
            assert sorted(steps) == list(range(len(steps))) and len(steps) <= 5
            for k in range(1, len(steps)):
                a, b = steps[k - 1], steps[k]
                assert (a.t, a.v) != (b.t, b.v)
                assert {(a.t, a.v), (b.t, b.v)} <= members[b.e]
        again = walks.keyword_walks(toy.inc, 40, 5, **options).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    only = walks.keyword_walks(toy.inc, 20, 4, weight=walks.weight_authors).where("pos > 0").select("t").distinct().collect()
    assert {r.t for r in only} == {A}


def test_draws_follow_weights(spark):
    trans = spark.createDataFrame([(0, 1, 0.2), (0, 2, 0.8)], "src long, dst long, p double")
    starts = spark.range(4000).select(F.col("id").alias("walk"), F.lit(0).cast("long").alias("v"))
    n = {r.v: r["count"] for r in walks.matrix_walks(trans, starts, 3).where("pos = 1").groupBy("v").count().collect()}
    assert n[2] / 4000 == pytest.approx(0.8, abs=0.03)
    assert walks.matrix_walks(trans, starts, 3).where("pos = 2").count() == 0


def test_random_entities(spark):
    w = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (1, 3, 7), (1, 4, 8), (1, 5, 7)], "walk long, pos int, e long")
    got = {r.pos: r.v for r in walks.random_entities(w, spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "e long, v long")).collect()}
    assert {got[1], got[2]} == {1, 2} and got[3] is None and got[4] == 3 and got[5] in (1, 2)


def test_first_passage(spark):
    rows = [(i, p, t) for i, s in enumerate(["K a x K b x x", "K x"]) for p, t in enumerate(s.split())]
    got = {r.target: r.dist for r in walks.first_passage(spark.createDataFrame(rows, "walk int, pos int, token string"), "K", spark.createDataFrame([("a",), ("x",), ("b",), ("q",)], "target string")).collect()}
    assert got.pop("q") is None
    near(got, {"a": 1, "x": Fr(5, 3), "b": 1})
    rows = [(0, p, t) for p, t in enumerate("K a x K b".split())] + [(1, p, t) for p, t in enumerate("K b".split())]
    assert {r.target: r.n for r in walks.first_passage(spark.createDataFrame(rows, "walk int, pos int, token string"), "K").collect()}["b"] == 2


def test_skipgrams(spark):
    tokens = textstats.positions(spark.createDataFrame([(1, "a b a c"), (2, "b c")], "d int, s string"), "d", "s")
    grams = textstats.skipgrams(tokens, 3)
    assert {(r.center, r.context): r.n for r in grams.collect()} == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}
    near({(r.center, r.context): r.v for r in textstats.sppmi(grams, 1).collect() if r.center == "a"}, {("a", "b"): math.log(16 / 9), ("a", "c"): math.log(8 / 6)})
    assert textstats.sppmi(grams, 3).count() == 0


def test_combined_scores(spark):
    df = spark.createDataFrame([(0, 1.0, 0.1), (1, 2.0, 0.4), (2, 2.0, 0.2), (3, 5.0, 0.3)], "v int, s1 double, s2 double")
    assert {r.v: r.rank for r in ranking.with_rank(df, "s1", "rank").collect()} == {0: 1, 1: 2.5, 2: 2.5, 3: 4}
    want = {
        "ranking": (-1, -3.25, -2.25, -3.5),
        "geometric": (0.562341, 0.945742, 0.795271, 1.106682),
        "z-score": (-1.170820, 0.504154, -0.390273, 1.056940),
        "van-der-waerden": (-1.384201, 0.677095, -0.203821, 0.910928),
    }
    for method, values in want.items():
        got = {r.v: r.score for r in ranking.combine(df, "s1", "s2", 0.5, method).collect()}
        for v, x in enumerate(values):
            assert got[v] == pytest.approx(x, abs=2e-6), method
    harmonic = {r.v: r.score for r in ranking.combine(df, "s1", "s2", 0.5, "harmonic").collect()}
    assert harmonic[0] == pytest.approx(2 / (0.5 / 1 + 0.5 / 0.1))


def test_auc(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (float("nan"), 1), (None, 0)], "score double, label int")
    assert evaluate.auc(df).first().auc == pytest.approx(0.875)
    assert evaluate.auc(df.withColumn("score", F.exp("score"))).first().auc == pytest.approx(0.875)
    assert evaluate.auc(df.where("label = 1")).first().auc is None


def test_precision_without_predictions(spark):
    truth_ = spark.createDataFrame([(1, 2001), (2, 2002)], "v long, year int")
    preds = spark.createDataFrame([(1,), (2,), (9,), (8,)], "v long")
    assert [r.precision for r in evaluate.precision_by_year(preds, truth_, 2001, 2004).orderBy("year").collect()] == [0.25, 0.5, 0.5]
    assert [r.precision for r in evaluate.precision_by_year(preds.limit(0), truth_, 2001, 2003).collect()] == [None, None]


def test_density_bounds(toy):
    for r in density.social_density(toy).collect():
        assert 0 <= r.sd <= 1


def test_orbits(spark):
    items = spark.createDataFrame([(1, 2, 1.0), (2, 2, 3.0), (3, 4, 10.0), (4, 6, 0.0)], "v int, spd int, score double")
    assert evaluate.extreme_orbits(items, 3).first().score == pytest.approx((1 + 3 + 10) / 3)
    assert evaluate.extreme_orbits(items, 3, literal=True).first().score == pytest.approx((1 + 3 + 10) / 6)
    assert evaluate.extreme_orbits(items, 1, farthest=True).first().score == 0


def test_empty_graph(spark, toy):
    empty = SimpleNamespace(inc=toy.inc.where("false"), edges=toy.edges)
    assert hops.accessibility(empty.inc, "KWtoC", 2).count() == 0
    assert paths.keyword_distance(empty.inc).count() == 0
    assert incidence.projection(empty.inc).count() == 0


def test_pipelines(spark, toy):
    from litweave.operators.walks import uniform
    from litweave.plans import pipeline
    from litweave.sources.catalog import Catalog

    titles = {e: "about K" if "K" in ns else "other" for e, (_, ns) in EDGES.items()}
    ids = lambda t: sorted(v for k, v in IDS.values() if k == t)
    inc = toy.inc
    c = Catalog(
        paper=spark.createDataFrame([(e, None, y, titles[e], None) for e, (y, _) in EDGES.items()], "paper_id long, doi string, year int, title string, abstract string"),
        author=spark.createDataFrame([(v,) for v in ids(A)], "author_id long"),
        entity=spark.createDataFrame([(v, NAMES[X, v]) for v in ids(X)], "entity_id long, name string"),
        affiliation=spark.createDataFrame([], "aff_id long"),
        paper_author=inc.where(F.col("t") == A).select(F.col("e").alias("paper_id"), F.col("v").alias("author_id")),
        paper_entity=inc.where(F.col("t") == X).select(F.col("v").alias("entity_id"), F.col("e").alias("paper_id")),
        author_affiliation=spark.createDataFrame([], "author_id long, aff_id long"),
    )
    preds, precision = pipeline.predict_and_evaluate(c, ["about k"], 2002, 2004)
    near({NAMES[X, r.v]: r.score for r in preds.collect()}, {"z": round(1 / 54, 9)})
    assert [r.precision for r in precision.orderBy("year").collect()] == [1.0, 1.0]
    features = spark.createDataFrame([(v,) for v in [*ids(X), -1]], "v long").select("v", F.array(*[uniform(7, F.col("v"), i) - 0.5 for i in range(4)]).alias("vec"))
    got = pipeline.encode_and_predict(pipeline.property_graph(c, ["about k"]), features, 2002, size=4, n_walks=4, length=3).collect()
    assert [NAMES[X, r.v] for r in got] == ["z"]


def test_models(spark):
    import numpy as np

    from litweave.operators import training, vectors

    m = np.outer([3.0, 1, 2], [1.0, 2, 0, 1]) + np.outer([0.0, 1, -1], [1.0, 0, 2, 0])
    cells = [(f"r{i}", f"c{j}", float(m[i, j])) for i in range(3) for j in range(4)]
    got = training.spectral(spark.createDataFrame(cells, "center string, context string, v double"), 2, 6).collect()
    u = {r.token: r.vec for r in got if r.vec}
    v = {r.token: r.out_vec for r in got if r.out_vec}
    for i in range(3):
        for j in range(4):
            assert np.dot(u[f"r{i}"], v[f"c{j}"]) == pytest.approx(m[i, j], abs=1e-6)
    x = np.random.default_rng(1).normal(size=(5, 3))
    rows = [(1, x[k].tolist()) for k in range(5)] + [(2, [1.0, 0.0, 0.0])]
    out = {r.author: np.array(r.vec) for r in vectors.author_vectors(spark.createDataFrame(rows, "author long, vec array<double>"), 3).collect()}
    first = np.linalg.svd(x)[2][0]
    want = x.sum(0) - first * (first @ x.sum(0))
    assert np.allclose(out[1], want / np.linalg.norm(want)) and np.allclose(out[2], 0)
    feats = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "v long, vec array<double>")
    edges = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    near_ = np.array([[1.0, 0], [0, -2]])
    layer = {r.v: r.vec for r in training.graph_layer(feats, edges, np.eye(2), near_, True).collect()}
    own = np.array([1.0, 0]) + np.array([0.5, 1.0]) @ near_
    assert np.allclose(layer[1], np.maximum(own / np.linalg.norm(own), 0)) and np.allclose(layer[2], [0, 1])
    assert training.sample_neighbors(edges, 1).count() == 1
    assert sorted(map(tuple, training.positive_pairs(spark.createDataFrame([(0, "1,2"), (1, ""), (2, "0")], "src long, value string")).collect())) == [(0, 1), (0, 2), (2, 0)]


def test_edges_are_drawn_alike(spark):
    inc = spark.createDataFrame([(e, K, 0) for e in range(300)] + [(e, X, 1) for e in range(300)], "e long, t string, v long")
    n = {}
    for r in walks.keyword_walks(inc, 6000, 2).where("pos = 1").groupBy("e").count().collect():
        n[r.e] = r["count"]
    assert len(n) == 300 and max(n.values()) < 50 and sum(n.values()) == 6000
    index, nodes = walks.edge_numbers(inc)
    assert {r.d for r in nodes.collect()} == {300} and index.count() == 600


def _expert_step(density, graph, n, visited, beta):
    """The distribution of one step, the plain way."""
    now = visited[-1]
    rows = [[density.get((v, u), 0.0) for u in range(n)] for v in ([now] if beta <= 0 else visited)]
    d = [math.prod(r[u] for r in rows) ** (1 / len(rows)) for u in range(n)]
    sign = (beta > 0) - (beta < 0)
    soft = [math.exp(-sign * x) for x in d]
    near = [u for u in range(n) if (now, u) in graph]
    p = [abs(beta) * soft[u] / sum(soft) + (1 - abs(beta)) * ((u in near) / len(near) if near else 1 / n) for u in range(n)]
    p[now] = 0.0
    return [x / sum(p) for x in p]


@pytest.mark.parametrize("beta", [-0.6, 0.0, 0.7])
def test_expert_walks_follow_the_distribution(spark, beta):
    density = {(0, 1): 0.9, (1, 0): 0.9, (0, 2): 0.3, (2, 0): 0.3, (1, 2): 0.5, (2, 1): 0.5, (0, 0): 1.0}
    graph = {(0, 3), (0, 1), (1, 0), (3, 0), (0, 0)}
    n, walks_ = 7, 6_000
    table = spark.createDataFrame([(a, b, d) for (a, b), d in density.items()], "src long, dst long, d double")
    edges = spark.createDataFrame(sorted(graph), "src long, dst long")
    found = walks.expert_walks(table, edges, spark.range(n).select(F.col("id").alias("v")), spark.range(walks_).select(F.col("id").alias("walk"), F.lit(0).cast("long").alias("v")), 2, beta)
    seen = defaultdict(dict)
    for r in found.collect():
        seen[r.walk][r.pos] = r.v
    assert len(seen) == walks_ and all(set(w) == {0, 1, 2} and w[0] == 0 and w[1] != 0 and w[2] != w[1] for w in seen.values())
    for first in (None, *range(1, n)):
        own = [w for w in seen.values() if first is None or w[1] == first]
        if len(own) < 300:
            continue
        want = _expert_step(density, graph, n, [0] if first is None else [0, first], beta)
        got = Counter(w[1 if first is None else 2] for w in own)
        for u in range(n):
            assert got[u] / len(own) == pytest.approx(want[u], abs=4 * math.sqrt(want[u] * (1 - want[u]) / len(own)) + 1e-9), (beta, first, u)


def test_a_path_of_many_hyperedges(spark):
    inc = spark.createDataFrame([(0, "keyword", 0)] + [(e, "author", v) for e in range(66) for v in (e, e + 1)] + [(65, "entity", 5), (100, "entity", 6)], "e long, t string, v long")
    assert {r.v: r.dist for r in paths.keyword_distance(inc).collect()} == {5: 132, 6: -1}


def test_returning_walks_follow_their_weights(spark):
    """From node 2, reached from 1, over edges 10 (with 1) and 11, 12 (without): shares 1 : 1/q : 1/q."""
    inc = spark.createDataFrame([(10, A, 1), (10, A, 2), (11, A, 2), (11, A, 3), (12, A, 2), (12, A, 4), (13, A, 1), (13, K, 0)], "e long, t string, v long")
    here = spark.range(4_000).select(F.col("id").alias("walk"), F.lit(A).alias("t"), F.lit(2).cast("long").alias("v"))
    prev = here.withColumn("v", F.lit(1).cast("long"))
    index, nodes = walks.edge_numbers(inc)
    for q in (4.0, 0.25):
        got = Counter(r.e for r in walks._pick_edges_by_return(here, prev, inc, index, nodes, q, 7, 2).collect())
        assert sum(got.values()) == 4_000
        for e, w in ((10, 1.0), (11, 1 / q), (12, 1 / q)):
            assert got[e] / 4_000 == pytest.approx(w / (1 + 2 / q), abs=0.03)


def test_matrix_walks_follow_the_rows(spark):
    trans = spark.createDataFrame([(0, d, p) for d, p in ((1, 0.1), (2, 0.6), (3, 0.3), (4, 0.0))], "src long, dst long, p double")
    starts = spark.range(4_000).select(F.col("id").alias("walk"), F.lit(0).cast("long").alias("v"))
    got = Counter(r.v for r in walks.matrix_walks(trans, starts, 3).where("pos = 1").collect())
    assert set(got) == {1, 2, 3} and all(got[d] / 4_000 == pytest.approx(p, abs=0.03) for d, p in ((1, 0.1), (2, 0.6), (3, 0.3)))


def test_layers_learn_communities(spark):
    """Two groups of nodes with edges inside only: after training, pairs of a group lie closer than pairs across."""
    import numpy as np

    from litweave.operators import training

    rng = np.random.default_rng(1)
    group = {v: v % 2 for v in range(60)}
    rows = sorted({(a, b) for a in range(60) for b in rng.integers(0, 60, 8).tolist() if a != b and group[a] == group[b]})
    edges = spark.createDataFrame([*rows, *[(b, a) for a, b in rows]], "src long, dst long").distinct()
    features = spark.createDataFrame([(v, rng.normal(0, 1, 6).tolist()) for v in range(60)], "v long, vec array<double>")
    losses = []
    layers = training.train_sage(features, edges, edges, (8, 8), sample=300, on_round=lambda r, x: losses.append(x))
    assert [w.shape for pair in layers for w in pair] == [(6, 8), (6, 8), (8, 8), (8, 8)] and min(losses) < 0.8 * losses[0]
    z = {r.v: np.array(r.vec) for r in training.graph_inference(features, edges, layers).collect()}
    near = np.mean([z[a] @ z[b] for a in z for b in z if a < b and group[a] == group[b]])
    far = np.mean([z[a] @ z[b] for a in z for b in z if a < b and group[a] != group[b]])
    assert near > far + 0.3, (near, far)
    assert len(training.train_sage(features.limit(0), edges.limit(0), edges.limit(0))) == 2
