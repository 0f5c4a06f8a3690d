"""Predictors: functions (year, subset) -> ranked nodes (v, score), best first.

A predictor filters the entities not yet studied, scores them, and keeps the best. ``subset`` (v) limits the
entities; ``constraint`` is a function DataFrame -> DataFrame over (v).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.operators import density, hops, textstats, truth, walks
from litweave.operators.incidence import Hypergraph
from litweave.operators.ranking import top_k
from litweave.operators.vectors import cosine_to_anchor

Predictor = Callable[..., DataFrame]


def _ranked(scored: DataFrame, size: int | None, scores: bool, subset: DataFrame | None, ascending: bool = False, key: str = "v") -> DataFrame:
    if subset is not None:
        scored = scored.join(subset.select(key).distinct(), key, "left_semi")
    rounded = scored.select(key, F.round("score", 9).alias("score"))
    best = rounded if size is None else top_k(rounded, size, "score", key, ascending)  # all of them need no order
    return best if scores else best.select(key)


def hypergraph_transition(g: Hypergraph, nstep: int = 1, memory: int = 5, alpha: float | None = None, constraint: Callable[[DataFrame], DataFrame] | None = None) -> Predictor:
    """Accessibility from the keyword over the years before, among entities not studied until then (0 where unreachable)."""

    def predict(year: int, subset: DataFrame | None = None, size: int | None = 50, scores: bool = False) -> DataFrame:
        w = g.window(year, memory).written()
        score = hops.multistep(hops.unit(w.inc, "keyword"), w.inc, nstep, lambda t: t != "keyword", alpha=alpha).where(F.col("t") == "entity").select("v", F.col("x").alias("score"))
        left = truth.unstudied(g, year).join(score, "v", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return _ranked(constraint(left) if constraint else left, size, scores, subset)

    return predict


def social_density_predictor(g: Hypergraph, memory: int = 5, how: str = "SUM", seed: int = 42) -> Predictor:
    """Density of the people around the keyword, among entities without co-occurrence before."""

    def predict(year: int, subset: DataFrame | None = None, size: int = 50, scores: bool = False) -> DataFrame:
        sd = density.social_density(g)
        score = density.scalar_density(sd, year, memory) if how == "SUM" else density.random_density(sd, year, memory, size or 50, seed)
        return _ranked(score.join(truth.studied_before(g, year), "v", "left_anti"), size, scores, subset)

    return predict


def embedding_predictor(g: Hypergraph, emb: DataFrame, names: DataFrame, keyword: str, out_vectors: bool = False) -> Predictor:
    """Cosine with the keyword's vector; names(v, token)."""

    def predict(year: int, subset: DataFrame | None = None, size: int = 50, scores: bool = False) -> DataFrame:
        sims = cosine_to_anchor(names, emb, keyword, out_vectors).where(F.col("sim").isNotNull()).join(names, "token").select("v", F.col("sim").alias("score"))
        return _ranked(sims.join(truth.studied_before(g, year), "v", "left_anti"), size, scores, subset)

    return predict


def author_embedding_predictor(emb: DataFrame, keyword: str) -> Predictor:
    """Authors by cosine of their token's vector with the keyword's; the year does not matter."""

    def predict(year: int = 0, subset: DataFrame | None = None, size: int = 50, scores: bool = False) -> DataFrame:
        from litweave.functions.text import author_of_token

        tokens = emb.select("token").where(author_of_token(F.col("token")).isNotNull())
        sims = cosine_to_anchor(tokens, emb, keyword).select(author_of_token(F.col("token")).alias("author"), F.col("sim").alias("score"))
        return _ranked(sims, size, scores, subset, key="author")

    return predict


def author_access_predictor(g: Hypergraph, nstep: int = 1, memory: int = 5) -> Predictor:
    """Authors by accessibility from the keyword through anything but it; size None keeps all."""

    def predict(year: int, subset: DataFrame | None = None, size: int | None = None, scores: bool = False) -> DataFrame:
        w = g.window(year, memory)
        x = hops.multistep(hops.unit(w.inc, "keyword"), w.inc, nstep, lambda t: t != "keyword").where(F.col("t") == "author").select(F.col("v").alias("author"), F.col("x").alias("score"))
        return _ranked(x, size, scores, subset, key="author")

    return predict


def walk_predictor(tokens: DataFrame, keyword: str, studied: Callable[[int], DataFrame], how: str = "count", sims: DataFrame | None = None, seed: int = 42) -> Predictor:
    """Tokens of a walk corpus (walk, pos, token) by count, mean first passage, context similarity, given similarities (token, sim), or at random.

    ``studied`` gives the tokens (token) studied before a year.
    """

    def predict(year: int, subset: DataFrame | None = None, size: int = 50, scores: bool = False) -> DataFrame:
        seen = textstats.walk_token_counts(tokens, keyword)
        if how == "count":
            scored = seen.select("token", F.col("n").cast("double").alias("score"))
        elif how == "random":
            scored = seen.select("token", walks.uniform(seed, F.col("token")).alias("score"))
        elif how == "passage":
            scored = walks.first_passage(tokens, keyword).select(F.col("target").alias("token"), F.col("dist").alias("score"))
        elif how == "similar":
            grams = textstats.skipgrams(tokens.withColumnRenamed("walk", "doc"), 9)
            scored = textstats.similar_terms(grams, keyword).select("token", F.col("sim").alias("score"))
        elif how == "given":
            scored = seen.join(sims, "token").select("token", F.col("sim").alias("score"))
        else:
            raise ValueError(f"how {how}")
        return _ranked(scored.join(studied(year), "token", "left_anti"), size, scores, subset, how == "passage", "token")

    return predict
