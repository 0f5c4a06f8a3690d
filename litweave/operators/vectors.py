"""Vector similarity and text vectors. Embeddings are (token, vec[, out_vec, n])."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave.functions.scores import cosine, norm

#: A query set is broadcast up to this number of vectors (counted before); more must be handled in blocks.
QUERY_VECTORS = 20_000


def cosine_to_anchor(tokens: DataFrame, emb: DataFrame, anchor: str, out_vectors: bool = False) -> DataFrame:
    """(token, sim) with the anchor's input vector; null for tokens without vector."""
    vec = F.col("out_vec" if out_vectors else "vec")
    one = emb.where(F.col("token") == anchor).select(F.col("vec").alias("q")).limit(1)
    return tokens.select("token").join(emb.select("token", vec.alias("x")), "token", "left").join(F.broadcast(one)).select("token", cosine(F.col("x"), F.col("q")).alias("sim"))


def cosine_pairs(queries: DataFrame, emb: DataFrame) -> DataFrame:
    """(a, b, sim) of a stated query set against all vectors, in blocks of QUERY_VECTORS queries that are broadcast."""
    queries = queries.select(F.col("token").alias("a"), F.col("vec").alias("q"))
    n = queries.count()
    blocks = -(-n // QUERY_VECTORS) or 1
    out = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("a"), F.lit(2 * blocks)).isin(2 * i, 2 * i + 1))
        one = emb.select(F.col("token").alias("b"), "vec").join(F.broadcast(part)).select("a", "b", cosine(F.col("vec"), F.col("q")).alias("sim"))
        out = one if out is None else out.unionByName(one)
    return out


def max_cosine(left: DataFrame, right: DataFrame, emb: DataFrame) -> DataFrame:
    """(sim): largest cosine between two token lists (token); null when one has no vectors."""
    a = left.select("token").distinct().join(emb, "token").select("token", "vec")
    return cosine_pairs(a, right.select("token").distinct().join(emb, "token").select("token", "vec")).agg(F.max("sim").alias("sim"))


def author_similarity(tokens: DataFrame, keywords: Iterable[str], emb: DataFrame, stop: Iterable[str] = ()) -> DataFrame:
    """(author, paper, year, sim): largest cosine of a paper's tokens with the keywords; tokens(author, paper, year, token)."""
    words = emb.where(F.col("token").isin(list(keywords))).select("token", "vec")
    best = cosine_pairs(words, emb).groupBy("b").agg(F.max("sim").alias("sim"))
    own = tokens.where(~F.col("token").isin(list(stop))) if list(stop) else tokens
    return own.join(best, own["token"] == best["b"]).groupBy("author", "paper", "year").agg(F.max("sim").alias("sim"))


def mean_vector(value: Column, pos: Column) -> Column:
    """Struct of position and value, for element-wise aggregation."""
    return F.struct(pos.alias("pos"), value.alias("value"))


def sentence_vectors(tokens: DataFrame, emb: DataFrame, alpha: float = 1e-3, stop: Iterable[str] = ()) -> DataFrame:
    """(doc, sent, vec): mean of v * alpha / (alpha + n) over the known tokens of each sentence; tokens(doc, sent, token)."""
    own = tokens.where(~F.col("token").isin(list(stop))) if list(stop) else tokens
    scaled = own.join(emb, "token").withColumn("w", alpha / (alpha + F.col("n")))
    parts = scaled.select("doc", "sent", "w", F.posexplode("vec").alias("pos", "x"))
    avg = parts.groupBy("doc", "sent", "pos").agg(F.avg(F.col("x").cast("double") * F.col("w")).alias("x"))
    return avg.groupBy("doc", "sent").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("s")).select("doc", "sent", F.col("s.x").alias("vec"))


def author_vectors(sentences: DataFrame, size: int) -> DataFrame:
    """(author, vec): sum of an author's sentence vectors without their first principal direction, of length one.

    sentences(author, vec). The direction comes from the sum of outer products, which combines map-side: a prolific
    author costs size * size numbers a task, never all of their sentences in one.
    """
    pairs = [(i, j) for i in range(size) for j in range(i, size)]

    def partial(batches):
        for pdf in batches:
            rows = []
            for author, own in pdf.groupby("author")["vec"]:
                x = np.stack([np.asarray(v, float) for v in own])
                rows.append((author, x.sum(0).tolist(), (x.T @ x)[np.triu_indices(size)].tolist()))
            yield pd.DataFrame(rows, columns=["author", "total", "outer"])

    part = sentences.select("author", "vec").mapInPandas(partial, "author long, total array<double>, outer array<double>")

    def final(batches):
        for pdf in batches:
            rows = []
            for a, total, outer in pdf.itertuples(index=False):
                m = np.zeros((size, size))
                m[np.triu_indices(size)] = outer
                m = m + np.triu(m, 1).T
                u = np.linalg.eigh(m)[1][:, -1]
                v = np.asarray(total) - u * (u @ np.asarray(total))
                length = np.linalg.norm(v)
                rows.append((a, (v / length if length > 1e-9 else v).tolist()))
            yield pd.DataFrame(rows, columns=["author", "vec"])

    total = F.array(*[F.sum(F.col("total")[i]) for i in range(size)])
    outer = F.array(*[F.sum(F.col("outer")[i]) for i in range(len(pairs))])
    return part.groupBy("author").agg(total.alias("total"), outer.alias("outer")).mapInPandas(final, "author long, vec array<double>")


def unit_vectors(emb: DataFrame, vec: str = "vec") -> DataFrame:
    """(token, vec) of length one."""
    length = norm(F.col(vec))
    return emb.select("token", F.transform(vec, lambda x: F.try_divide(x.cast("double"), length)).alias("vec"))


def composition_vectors(entities: DataFrame, elements: list[str], extra: int = 2) -> DataFrame:
    """(v, vec): amounts of the listed elements and ``extra`` zeros (author and keyword flags), of length one."""
    from litweave.functions.text import composition

    amounts = F.array(*[F.coalesce(F.col("m")[e], F.lit(0.0)) for e in elements], *[F.lit(0.0)] * extra)
    raw = entities.select("v", composition(F.col("name")).alias("m")).select("v", amounts.alias("vec"))
    length = norm(F.col("vec"))
    return raw.select("v", F.transform("vec", lambda x: F.when(length > 0, x / length).otherwise(x)).alias("vec"))


def euclid_similarity(a: Column, b: Column) -> Column:
    """exp(-distance)."""
    return F.exp(-F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)))


def aligned_scores(wanted: DataFrame, scores: DataFrame, keep_missing: bool = True) -> DataFrame:
    """(pos, token, score) in the order of wanted(pos, token); missing scores null or left out."""
    return wanted.join(scores.select("token", "score"), "token", "left" if keep_missing else "inner").select("pos", "token", "score")


def locate(moving: DataFrame, fixed: DataFrame) -> DataFrame:
    """(pos, value, at): place of each value of moving(pos, value) in fixed(pos, value), the first one; null where absent."""
    places = fixed.groupBy("value").agg(F.min("pos").alias("at"))
    return moving.join(places, "value", "left").select("pos", "value", "at")


def node_features(nodes: DataFrame, features: DataFrame, size: int) -> DataFrame:
    """(t, v, vec) of nodes(t, v): their features(t, v, vec), zeros where there are none."""
    return nodes.join(features, ["t", "v"], "left").select("t", "v", F.coalesce("vec", F.array(*[F.lit(0.0)] * size)).alias("vec"))
