"""A corpus mixed from sources to target weights, by Poisson replication.

Each document gets a uniform number from a hash of its id and the seed. Inverting a Poisson distribution at that
number gives its copies, cut at the cap of its source; the rate of a source is the one at which the tokens of all
copies come closest to its target, found from the token mass by uniform number, so the shares hold for the realised
mix and not only on average. Every copy has a random place in the mix, and the mix is range-partitioned by place.

Defined results
    * T: tokens of all documents of listed sources, each once; target of a source: its share of T.
    * source null, blank of a listed name, or not listed: no part in the mix. Listed without documents: 0 tokens.
    * share or cap null, negative or 0: nothing is taken. A target at or above cap times tokens: every document cap times.
    * text null or empty: 0 tokens; copies follow the same rule and weigh nothing. Repeated doc ids: same copies each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.llm.bpe import VOCABULARY, token_counts
from litweave.runtime import materialise, skew_join

#: Uniform numbers are multiples of 1 / LEVELS.
LEVELS = 1 << 16
#: Levels of all sources (one number a possible copy) are broadcast up to this many numbers, counted before; beyond it the
#: documents meet them in a salted join.
BROADCAST_LEVELS = 500_000


def source_totals(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, total) of every listed source."""
    held = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    listed = targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).dropDuplicates(["source"])
    both = listed.join(held, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    total = both.agg(F.sum("tokens").alias("total")).first()[0] or 0
    return both.withColumn("total", F.lit(int(total)).cast("long"))


def short_sources(totals: DataFrame) -> DataFrame:
    """Listed sources whose share of the total is more than all their documents, repeated as often as allowed."""
    return totals.where(F.col("target_share") * F.col("total") > F.col("max_repeats") * F.col("tokens"))


def exhausted_sources(mixed: DataFrame, totals: DataFrame) -> DataFrame:
    """Listed sources of which the mix holds every token as often as allowed, and still less than their share.

    What is used up is read from the realised mix; the closed formula then sets apart those that only just reach their share.
    """
    used = shares(mixed, totals).where(F.col("mix_tokens") >= F.col("max_repeats") * F.col("tokens")).select("source")
    return short_sources(totals.join(used, "source", "left_semi"))


def _poisson_levels(rate: float, cap: int) -> np.ndarray:
    """The level at which the copies of a document reach 1, 2 ... cap: the distribution function, summed from logarithms."""
    k = np.arange(cap)
    logs = -rate + k * math.log(rate) - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, cap)))])[:cap] if rate > 0 else np.where(k == 0, 0.0, -np.inf)
    return np.minimum(LEVELS, np.round(np.cumsum(np.exp(logs)) * LEVELS)).astype(np.int64)


def fit_levels(mass: np.ndarray, target: float, cap: int) -> np.ndarray:
    """Levels of the rate whose realised tokens are nearest to the target. mass: tokens by level."""
    tail = np.concatenate([np.cumsum(mass[::-1])[::-1], [0]])  # tokens at this level and above
    if cap < 1 or target <= 0:
        return np.empty(0, np.int64)
    if target >= cap * tail[0]:
        return np.zeros(cap, np.int64)
    realised = lambda rate: int(tail[_poisson_levels(rate, cap)].sum())
    lo, hi = 0.0, 1.0
    while realised(hi) < target and hi < 1e9:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if realised(mid) < target else (lo, mid)
    return _poisson_levels(min((lo, hi), key=lambda r: abs(realised(r) - target)), cap)


def source_levels(placed: DataFrame, totals: DataFrame) -> DataFrame:
    """(source, levels) of every listed source, each fitted in a task of its own from at most LEVELS token masses."""
    mass = placed.where(F.col("n_tokens") > 0).groupBy("source", "level").agg(F.sum("n_tokens").alias("n"))
    wanted = totals.select("source", (F.coalesce("target_share", F.lit(0.0)) * F.col("total")).alias("target"), F.coalesce("max_repeats", F.lit(0)).alias("cap"))

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        tokens = np.zeros(LEVELS, np.int64)
        known = own.dropna(subset=["level"])
        tokens[known["level"].to_numpy(np.int64)] = known["n"].to_numpy(np.int64)
        levels = fit_levels(tokens, float(own["target"].iloc[0]), int(own["cap"].iloc[0]))
        return pd.DataFrame({"source": [own["source"].iloc[0]], "levels": [levels.astype(np.int32)]})

    rows = wanted.join(mass, "source", "left").select("source", "target", "cap", "level", "n")
    return materialise(rows.groupBy("source").applyInPandas(fit, "source string, levels array<int>"), "mix-levels")


def sized_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, source, n_tokens), written once: every later step reads these narrow rows instead of the texts."""
    return materialise(token_counts(docs, (key, "source"), text, vocabulary), "mix-sizes")


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """(key, source, n_tokens, copy_no, place): one row for each use of a document, range-partitioned and sorted by place."""
    level = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 48)
    placed = sized.where(F.col("source").isNotNull()).withColumn("level", level.cast("int"))
    levels = source_levels(placed, source_totals(sized, targets))
    small = (levels.agg(F.sum(F.size("levels"))).first()[0] or 0) + levels.count() <= BROADCAST_LEVELS
    met = placed.join(F.broadcast(levels), "source") if small else skew_join(placed, levels, "source")
    counted = met.withColumn("copies", F.size(F.filter("levels", lambda t: t <= F.col("level"))))
    used = counted.where(F.col("copies") > 0).select(key, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
    return used.withColumn("place", F.xxhash64(F.col(key), F.col("copy_no"), F.lit(seed + 1))).repartitionByRange("place").sortWithinPartitions("place")


def with_texts(mixed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix with the text of every use, in the order of its place. Repeated ids in ``docs``: a use for each."""
    found = mixed.join(docs.select(key, text), key)
    return found.repartitionByRange("place").sortWithinPartitions("place")


def shares(mixed: DataFrame, totals: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, mix_tokens, actual_share) of every listed source."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"))
    both = materialise(totals.join(got, "source", "left").withColumn("mix_tokens", F.coalesce("mix_tokens", F.lit(0))), "mix-shares")
    whole = both.agg(F.sum("mix_tokens")).first()[0] or 0
    return both.select("source", "target_share", "max_repeats", "tokens", "mix_tokens", (F.col("mix_tokens") / F.lit(float(whole or 1))).alias("actual_share"))
