"""Token statistics: counts, skip-grams, shifted PPMI, similar terms. Tokens are (doc, pos, token)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litweave.functions.text import normal_formula, simple_formula


def positions(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, token) of blank-separated texts."""
    return texts.select(F.col(doc).alias("doc"), F.posexplode(F.split(F.trim(F.col(text)), r"\s+")).alias("pos", "token")).where(F.col("token") != "")


def unigrams(tokens: DataFrame) -> DataFrame:
    """(token, n)."""
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(token, n, doc, pos): counts with the first place of each token, for an order by first appearance."""
    return tokens.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("f")).select("token", "n", "f.doc", "f.pos")


def skipgrams(tokens: DataFrame, window: int) -> DataFrame:
    """(center, context, n) within (window - 1) / 2 positions, repeated tokens counted.

    Documents are shuffled once by document; the neighbours of a position come from window functions, so no position
    is joined. Positions must be consecutive within a document.
    """
    half = int((window - 1) / 2)
    w = Window.partitionBy("doc").orderBy("pos")
    near = F.array(*[f("token", k).over(w) for k in range(1, half + 1) for f in (F.lag, F.lead)])
    pairs = tokens.withColumn("near", near).select(F.col("token").alias("center"), F.explode("near").alias("context")).where(F.col("context").isNotNull())
    return pairs.groupBy("center", "context").agg(F.count("*").alias("n"))


def sppmi(grams: DataFrame, shift: float) -> DataFrame:
    """(center, context, v): ln(N n_ij / (n_i n_j)) - ln(shift) where positive."""
    rows = grams.groupBy("center").agg(F.sum("n").alias("n_i"))
    total = grams.agg(F.sum("n").alias("total"))
    both = grams.join(rows, "center").join(rows.select(F.col("center").alias("context"), F.col("n_i").alias("n_j")), "context").join(F.broadcast(total))
    v = F.ln(F.col("n") * F.col("total").cast("double") / (F.col("n_i").cast("double") * F.col("n_j"))) - F.ln(F.lit(float(shift)))
    return both.select("center", "context", v.alias("v")).where(F.col("v") > 0)


def similar_terms(matrix: DataFrame, term: str, value: str = "n", top: int | None = None, threshold: float = 0.0) -> DataFrame:
    """(token, sim): cosine of the rows of a (center, context, value) table with the row of a term, itself left out."""
    v = F.col(value).cast("double")
    own = matrix.where(F.col("center") == term).select("context", v.alias("q"))
    norms = matrix.groupBy("center").agg(F.sqrt(F.sum(v * v)).alias("norm"))
    q_norm = own.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    dots = matrix.where(F.col("center") != term).join(own, "context").groupBy("center").agg(F.sum(v * F.col("q")).alias("dot"))
    out = dots.join(norms, "center").join(F.broadcast(q_norm)).select(F.col("center").alias("token"), (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("sim")).where(F.col("sim") > threshold)
    return out.orderBy(F.desc("sim"), "token").limit(top) if top else out


def walk_token_counts(tokens: DataFrame, keyword: str) -> DataFrame:
    """(token, n) of walk tokens without the keyword."""
    return unigrams(tokens.where(F.col("token") != keyword))


def frequent_vocabulary(vocab: DataFrame, threshold: int, unnormalised: tuple[str, ...] = ("H2", "O2", "N2")) -> DataFrame:
    """(token, n): formulas above a count that are written in their normal form, or in another listed one."""
    token = F.col("token")
    return vocab.where(simple_formula(token) & (F.col("n") > threshold) & ((normal_formula(token) == token) | token.isin(list(unnormalised))))
