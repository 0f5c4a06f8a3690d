"""End-to-end runs: store -> graph -> prediction -> evaluation, and store -> entity graph -> encoder -> prediction."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.operators import evaluate, hops, training, truth, walks
from litweave.operators.incidence import Hypergraph, author_block, entity_block, hypergraph, keyword_block
from litweave.operators.lookup import papers_by_keyword
from litweave.plans.predictors import hypergraph_transition
from litweave.runtime import materialise
from litweave.sources.catalog import Catalog


def property_graph(c: Catalog, words: list[str]) -> Hypergraph:
    """Authors, entities and one node for the property's keywords."""
    return hypergraph(c, author_block(c), entity_block(c), keyword_block([papers_by_keyword(c, words)])).written()


def predict_and_evaluate(c: Catalog, words: list[str], year: int, last_year: int, nstep: int = 2, memory: int = 5, size: int = 50) -> tuple[DataFrame, DataFrame]:
    """(predictions, cumulative precision by year)."""
    g = property_graph(c, words)
    preds = materialise(hypergraph_transition(g, nstep, memory)(year, size=size, scores=True), "predictions")
    return preds, evaluate.precision_by_year(preds, truth.discoveries(g), year, last_year)


def encode_and_predict(g: Hypergraph, features: DataFrame, year: int, memory: int = 5, size: int = 16, n_walks: int = 20, length: int = 5, k: int = 50) -> DataFrame:
    """(v, score): entities not studied, by inner product of encoded vectors with the keyword's.

    Walks over the entity graph of the years before give positive pairs, two layers are fitted on a bounded sample of
    them, and all nodes are encoded by full-neighbourhood inference. features(v, vec); the keyword is node -1.
    """
    near = hops.entity_graph(g.window(year, memory).inc)
    code = lambda t, v: F.when(F.col(t) == "keyword", F.lit(-1)).otherwise(F.col(v))
    trans = materialise(near.select(code("t1", "v1").alias("src"), code("t2", "v2").alias("dst"), "p"), "entity-graph")
    pairs = materialise(walks.positive_samples(trans, n_walks, length), "positive-pairs")
    edges = materialise(trans.select("src", "dst").distinct(), "entity-edges")
    layers = training.train_sage(features, edges, pairs, (size, size))
    encoded = training.graph_inference(features, edges, layers)
    anchor = encoded.where(F.col("v") == -1).select(F.col("vec").alias("q"))
    dot = F.aggregate(F.zip_with("vec", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = encoded.where(F.col("v") != -1).join(F.broadcast(anchor)).select("v", dot.alias("score"))
    left = scored.join(truth.studied_before(g, year), "v", "left_anti")
    return left.orderBy(F.desc_nulls_last("score"), "v").limit(k)


def main(args: list[str] | None = None) -> None:
    """Predict from a directory of Parquet tables, and print the predictions and their precision by year."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("tables")
    p.add_argument("keyword", nargs="+")
    p.add_argument("--year", type=int, default=2012)
    p.add_argument("--last-year", type=int, default=2020)
    p.add_argument("--memory", type=int, default=5)
    p.add_argument("--steps", type=int, default=2)
    p.add_argument("--size", type=int, default=50)
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("litweave").getOrCreate()
    preds, precision = predict_and_evaluate(Catalog.from_parquet(spark, o.tables), o.keyword, o.year, o.last_year, o.steps, o.memory, o.size)
    preds.show(o.size, truncate=False)
    precision.orderBy("year").show(o.last_year - o.year)


if __name__ == "__main__":
    main()
