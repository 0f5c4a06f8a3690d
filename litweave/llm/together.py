"""Pairs of items that occur together, with huge baskets split into blocks.

Items are hashed into chunks of about CHUNK within their basket; an ordinary basket is one chunk. Pairs come from
within each chunk and from each pair of chunks of a basket, which are separate rows and so spread over all tasks.
Pair counts are combined map-side before they are shuffled.

``min_together`` and ``min_part`` (pairs in at least N / min_part baskets) are applied exactly, and early: an item in
fewer baskets than a pair needs cannot be part of such a pair.

Defined results
    * null item or basket: left out. Repeated rows count once. Baskets of one item count in N and give no pair.
    * item of any integer value; the smaller one comes first. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave.runtime import materialise, skew_join

CHUNK = 64
#: Frequent items are broadcast up to this number of rows (16 bytes each), counted before; beyond it they are joined by shuffle.
BROADCAST_ROWS = 500_000


def _exact(*factors: Column | int) -> Column:
    """A product of counts without overflow."""
    out = None
    for f in factors:
        x = (F.lit(f) if isinstance(f, int) else f).cast("decimal(19,0)")
        out = x if out is None else (out * x).cast("decimal(38,0)")
    return out


def _within(items: Column) -> Column:
    return F.flatten(F.transform(items, lambda x: F.transform(F.filter(items, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def _across(left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))


def pair_counts(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n_together) over distinct rows (item, basket)."""
    sizes = rows.groupBy("basket").agg(F.count("*").alias("size")).where(F.col("size") > chunk)
    sized = skew_join(rows, sizes.select("basket", F.ceil(F.col("size") / chunk).cast("int").alias("n_chunks")), "basket", how="left")
    n = F.coalesce("n_chunks", F.lit(1))
    chunks = sized.select("basket", "item", n.alias("n_chunks"), F.pmod(F.xxhash64("item", F.lit(7)), n).cast("int").alias("chunk"))
    chunks = chunks.groupBy("basket", "n_chunks", "chunk").agg(F.collect_list("item").alias("items"))
    chunks = materialise(chunks, "together-chunks")
    near = chunks.select(F.inline(_within(F.col("items"))))
    huge = chunks.where(F.col("n_chunks") > 1)
    sides = huge.select("basket", "chunk", "items", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("partner"))
    left = sides.where(F.col("chunk") < F.col("partner")).select("basket", F.col("chunk").alias("i"), F.col("partner").alias("j"), F.col("items").alias("left"))
    right = sides.where(F.col("chunk") > F.col("partner")).select("basket", F.col("partner").alias("i"), F.col("chunk").alias("j"), F.col("items").alias("right"))
    far = left.join(right, ["basket", "i", "j"]).select(F.inline(_across(F.col("left"), F.col("right"))))
    return near.unionByName(far).groupBy("a", "b").agg(F.count("*").alias("n_together"))


def associations(df: DataFrame, item: str, basket: str, min_together: int = 1, min_part: int | None = None, min_lift: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b, n_together, n_a, n_b, n_baskets, lift, pmi) of the pairs that meet the thresholds."""
    rows = df.select(F.col(item).cast("long").alias("item"), F.col(basket).alias("basket")).where(F.col(item).isNotNull() & F.col(basket).isNotNull())
    rows = materialise(rows.distinct(), "together-rows")
    n_baskets = rows.groupBy("basket").agg(F.lit(1).alias("x")).count()
    least = max(min_together, -(-n_baskets // min_part) if min_part else 1)
    counts = rows.groupBy("item").agg(F.count("*").alias("n"))
    if least > 1:
        counts = materialise(counts.where(F.col("n") >= least), "together-items")
        keep = counts.select("item")
        rows = rows.join(F.broadcast(keep), "item", "left_semi") if keep.count() <= BROADCAST_ROWS else skew_join(rows, keep, "item")
    pairs = pair_counts(rows, chunk).where(F.col("n_together") >= least)
    small = least > 1 and counts.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)
    pairs = pairs.join(hint(counts.select(F.col("item").alias("a"), F.col("n").alias("n_a"))), "a").join(hint(counts.select(F.col("item").alias("b"), F.col("n").alias("n_b"))), "b")
    lift = F.col("n_together") * F.lit(float(n_baskets)) / (F.col("n_a").cast("double") * F.col("n_b"))
    if min_lift is not None:
        pairs = pairs.where(_exact(F.col("n_together"), n_baskets) >= (_exact(F.col("n_a"), F.col("n_b")) * min_lift).cast("decimal(38,0)"))
    return pairs.select("a", "b", "n_together", "n_a", "n_b", F.lit(n_baskets).cast("long").alias("n_baskets"), lift.alias("lift"), F.log2(lift).alias("pmi"))
