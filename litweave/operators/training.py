"""Embedding models from Spark parts: skip-gram vectors, spectral PPMI vectors, neighbour sampling, graph inference."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litweave.operators.incidence import node_degrees
from litweave.operators.walks import uniform
from litweave.runtime import materialise


def phrases(tokens: DataFrame, min_count: int = 5, threshold: float = 10.0) -> DataFrame:
    """(first, second, n, score) of neighbouring tokens that occur together far more often than apart; tokens(doc, pos, token)."""
    uni = tokens.groupBy("token").agg(F.count("*").alias("n"))
    total = uni.agg(F.count("*").alias("v"))
    w = Window.partitionBy("doc").orderBy("pos")
    pairs = tokens.withColumn("second", F.lead("token").over(w)).where(F.col("second").isNotNull()).groupBy(F.col("token").alias("first"), "second").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    both = pairs.join(uni.select(F.col("token").alias("first"), F.col("n").alias("n1")), "first").join(uni.select(F.col("token").alias("second"), F.col("n").alias("n2")), "second").join(F.broadcast(total))
    return both.withColumn("score", (F.col("n") - min_count) * F.col("v").cast("double") / (F.col("n1").cast("double") * F.col("n2"))).where(F.col("score") > threshold).select("first", "second", "n", "score")


def word2vec(sentences: DataFrame, column: str, size: int = 32, window: int = 5, min_count: int = 5, epochs: int = 1, seed: int = 42) -> DataFrame:
    """(token, vec) by skip-gram with hierarchical softmax. Input vectors only; see ``spectral`` for output vectors."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    parts = max(1, min(64, sentences.rdd.getNumPartitions()))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, numPartitions=parts, seed=seed, inputCol=column, outputCol="v").fit(sentences)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector", "float32").alias("vec"))


def spectral(matrix: DataFrame, size: int = 16, rounds: int = 8, value: str = "v", seed: int = 42) -> DataFrame:
    """(token, vec, out_vec) of a (center, context, value) table: its leading factors, by orthogonal iteration.

    Each round multiplies the table with a token's ``size`` numbers as joins and sums and orthogonalises with a
    size * size matrix on the driver; the table itself is never collected.
    """
    m = matrix.select("center", "context", F.col(value).cast("double").alias("x"))

    def times(vectors: DataFrame, a: str, b: str) -> DataFrame:
        """Rows of the product: sum over b of x * vector(b)."""
        sums = [F.sum(F.col("x") * F.col("vec")[i]) for i in range(size)]
        return m.join(vectors.withColumnRenamed("token", b), b).groupBy(a).agg(F.array(*sums).alias("vec")).withColumnRenamed(a, "token")

    def gram(vectors: DataFrame) -> np.ndarray:
        cells = [F.sum(F.col("vec")[i] * F.col("vec")[j]) for i in range(size) for j in range(size)]
        return np.array(vectors.agg(F.array(*cells)).first()[0], float).reshape(size, size)

    def apply(vectors: DataFrame, right: np.ndarray) -> DataFrame:
        cells = [sum((F.col("vec")[i] * float(right[i, j]) for i in range(size)), F.lit(0.0)) for j in range(size)]
        return vectors.select("token", F.array(*cells).alias("vec"))

    def orthonormal(vectors: DataFrame) -> DataFrame:
        vectors = materialise(vectors, "spectral")
        values, basis = np.linalg.eigh(gram(vectors))
        scale = np.where(values > 1e-12 * max(values.max(), 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0)
        return apply(vectors, basis * scale)

    v = m.select(F.col("context").alias("token")).distinct().select("token", F.array(*[uniform(seed, F.col("token"), i) - 0.5 for i in range(size)]).alias("vec"))
    v = orthonormal(v)
    for _ in range(rounds):
        u = orthonormal(times(v, "center", "context"))
        v = orthonormal(times(u, "context", "center"))
    scaled = times(v, "center", "context")
    return scaled.join(v.withColumnRenamed("vec", "out_vec"), "token", "full_outer")


def negative_distribution(inc: DataFrame, power: float = 0.75) -> DataFrame:
    """(t, v, p): share of each node in degree to a power."""
    w = node_degrees(inc).withColumn("w", F.pow("d", F.lit(power)))
    total = w.agg(F.sum("w").alias("total"))
    return w.join(F.broadcast(total)).select("t", "v", (F.col("w") / F.col("total")).alias("p"))


def sample_neighbors(edges: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(src, dst): up to ``size`` neighbours of each node, chosen by a hash."""
    w = Window.partitionBy("src").orderBy(uniform(seed, F.col("src"), F.col("dst")), "dst")
    return edges.withColumn("k", F.row_number().over(w)).where(F.col("k") <= size).select("src", "dst")


def positive_pairs(lines: DataFrame) -> DataFrame:
    """(src, dst) of lines (src, value) that list neighbours by commas; empty lines give none."""
    return lines.select("src", F.explode(F.split("value", ",")).alias("dst")).where(F.trim("dst") != "").select("src", F.trim("dst").cast("long").alias("dst"))


def graph_layer(features: DataFrame, edges: DataFrame, w_self: np.ndarray, w_near: np.ndarray, relu: bool) -> DataFrame:
    """(v, vec): one mean-aggregating layer over full neighbourhoods, of length one; features(v, vec).

    Feature sums combine map-side, so a node of any degree costs one row a task.
    """
    size = w_near.shape[0]
    near = edges.join(features.withColumnRenamed("v", "dst"), "dst").groupBy("src").agg(F.array(*[F.avg(F.col("vec")[i].cast("double")) for i in range(size)]).alias("near")).withColumnRenamed("src", "v")
    both = features.join(near, "v", "left")

    def cell(j: int):
        own = sum((F.col("vec")[i].cast("double") * float(w_self[i, j]) for i in range(w_self.shape[0])), F.lit(0.0))
        return own + sum((F.coalesce(F.col("near")[i], F.lit(0.0)) * float(w_near[i, j]) for i in range(size)), F.lit(0.0))

    out = both.select("v", F.array(*[cell(j) for j in range(w_self.shape[1])]).alias("vec"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    out = out.select("v", F.transform("vec", lambda x: F.when(length > 0, x / length).otherwise(x)).alias("vec"))
    return out.select("v", F.transform("vec", lambda x: F.greatest(x, F.lit(0.0))).alias("vec")) if relu else out


def graph_inference(features: DataFrame, edges: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(v, vec) after all layers, ReLU between them."""
    for i, (w_self, w_near) in enumerate(layers):
        features = materialise(graph_layer(features, edges, w_self, w_near, i < len(layers) - 1), "layer")
    return features


def _mean(x: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the rows x[dst] of each src, and how many there are (1 where none)."""
    total, count = np.zeros((n, x.shape[1])), np.maximum(np.bincount(src, minlength=n), 1)[:, None]
    np.add.at(total, src, x[dst])
    return total / count, count


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return x / length, length


def _through_unit(grad: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (grad - y * (grad * y).sum(1, keepdims=True)) / length


def train_sage(
    features: DataFrame, edges: DataFrame, pairs: DataFrame, sizes: tuple[int, int] = (16, 16), fan: tuple[int, int] = (25, 10), negatives: int = 2,
    rounds: int = 60, rate: float = 0.5, sample: int = 2_000, seed: int = 42, on_round: Callable[[int, float], None] | None = None,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights (own, neighbours) of two mean-aggregating layers, for ``graph_inference``.

    Positive pairs (src, dst) shall score above pairs with nodes drawn by degree to 0.75. Fitted on at most ``sample``
    pairs, ``negatives`` drawn nodes a pair, and ``fan`` sampled neighbours of each node at each layer: all documented
    bounds of what comes to the driver, (2 + negatives) * sample * (1 + fan) rows at most. ``on_round`` hears of each
    round's loss; the weights of the best round are returned.
    """
    own = materialise(pairs.orderBy(uniform(seed, F.col("src"), F.col("dst")), "src", "dst").limit(sample), "pairs")
    weight = negative_distribution(edges.select(F.col("src").alias("v"), F.lit("n").alias("t"), F.col("dst").alias("e"))).select("v", "p")
    drawn = weight.orderBy(-F.log(uniform(seed + 1, F.col("v"))) / F.col("p"), "v").limit(sample * negatives).select("v")
    first = materialise(own.select(F.col("src").alias("v")).unionByName(own.select(F.col("dst").alias("v"))).unionByName(drawn).distinct(), "sage-nodes")
    near2 = materialise(sample_neighbors(edges.join(first.withColumnRenamed("v", "src"), "src", "left_semi"), fan[0], seed), "sage-near")
    second = materialise(first.unionByName(near2.select(F.col("dst").alias("v"))).distinct(), "sage-nodes")
    near1 = materialise(sample_neighbors(edges.join(second.withColumnRenamed("v", "src"), "src", "left_semi"), fan[1], seed + 1), "sage-near")
    third = second.unionByName(near1.select(F.col("dst").alias("v"))).distinct()
    rows = features.join(third, "v", "left_semi").select("v", "vec").orderBy("v").toPandas()
    ids = rows["v"].to_numpy()
    width = len(rows["vec"].iloc[0]) if len(rows) else 1
    rng = np.random.default_rng(seed)
    layers = [(rng.normal(0, 1 / np.sqrt(i), (i, o)), rng.normal(0, 1 / np.sqrt(i), (i, o))) for i, o in ((width, sizes[0]), (sizes[0], sizes[1]))]
    x = np.array(rows["vec"].tolist(), float).reshape(len(rows), width)

    def coded(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.select("src", "dst").toPandas()
        got = got[got["src"].isin(ids) & got["dst"].isin(ids)].sort_values(["src", "dst"])
        return np.searchsorted(ids, got["src"]), np.searchsorted(ids, got["dst"])

    (u, v), (s2, d2), (s1, d1) = coded(own), coded(near2), coded(near1)
    pool = np.searchsorted(ids, drawn.where("v is not null").join(features.select("v"), "v", "left_semi").orderBy("v").toPandas()["v"])
    if not len(u) or not len(pool):
        return layers
    n, best, kept = len(ids), np.inf, layers
    near_x, _ = _mean(x, s1, d1, n)
    for r in range(rounds):
        (ws1, wn1), (ws2, wn2) = layers
        y1, l1 = _unit(x @ ws1 + near_x @ wn1)
        h1 = np.maximum(y1, 0)
        near_h, count = _mean(h1, s2, d2, n)
        z, l2 = _unit(h1 @ ws2 + near_h @ wn2)
        w = pool[rng.integers(0, len(pool), (len(u), negatives))]
        score = lambda a, b: 1 / (1 + np.exp(-np.clip(4 * (a * b).sum(-1), -30, 30)))
        good, bad = score(z[u], z[v]), score(z[u][:, None], z[w])
        loss = float(-np.log(good + 1e-9).mean() - np.log(1 - bad + 1e-9).mean())
        if on_round:
            on_round(r, loss)
        if loss < best:
            best, kept = loss, layers
        g, gg, gb = np.zeros_like(z), 4 * (good - 1)[:, None] / len(u), 4 * bad[..., None] / bad.size
        np.add.at(g, u, gg * z[v] + (gb * z[w]).sum(1))
        np.add.at(g, v, gg * z[u])
        np.add.at(g, w.ravel(), (gb * z[u][:, None]).reshape(-1, z.shape[1]))
        g = _through_unit(g, z, l2)
        gh = g @ ws2.T
        np.add.at(gh, d2, (g @ wn2.T / count)[s2])
        g1 = _through_unit(gh * (y1 > 0), y1, l1)
        steps = ((x.T @ g1, near_x.T @ g1), (h1.T @ g, near_h.T @ g))
        layers = [(a - rate * da, b - rate * db) for (a, b), (da, db) in zip(layers, steps, strict=True)]
    return kept


def mini_batches(df: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Adds ``batch``: rows in a hashed order, about ``size`` in each batch. Another seed gives another order."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("batch", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed)), F.lit(n)).cast("int"))
