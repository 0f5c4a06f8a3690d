"""Frequency of every term, by heavy-light aggregation.

Terms that hold much of the corpus are found with a sketch over all rows and broadcast (at most HEAVY short terms).
Every task counts those exactly in local arrays and emits them once; all other terms are counted per batch and
shuffled. Both count tables meet in one sum by term. Which terms count as heavy only decides the route, never a count.

Defined results
    * null text: no terms. Text of any length. A term occurring many times in a row counts once in n_docs.
    * repeated rows count each time. Empty table: no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the broadcast: number of heavy terms, and their length in characters (longer terms take the shuffle).
HEAVY, HEAVY_CHARS, TRACKED = 512, 64, 4096


def terms_of(*fields: Column) -> Column:
    """All terms of the lower-cased fields, in order and with repetitions."""
    found = [F.coalesce(F.regexp_extract_all(F.lower(f), F.lit(r"\p{L}+"), F.lit(0)), F.array().cast("array<string>")) for f in fields]
    return F.concat(*found)


def detect_heavy(terms: DataFrame) -> list[str]:
    """Heavy terms of a table (terms array), from a mergeable sketch over all rows: bounded by HEAVY."""
    flat = terms.select(F.explode("terms").alias("term")).where(F.length("term") <= HEAVY_CHARS)
    top = flat.agg(F.expr(f"approx_top_k(term, {HEAVY}, {TRACKED})").alias("top")).first()
    return sorted({r["item"] for r in (top["top"] or []) if r["item"] is not None}) if top else []


def _count(heavy: list[str]):
    """A counter over batches of term lists: heavy terms into arrays, the others by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(heavy, pa.string())
        k = max(1, len(heavy))
        n_terms, n_docs = np.zeros(k, np.int64), np.zeros(k, np.int64)

        def emit(terms, a, b):
            return pa.RecordBatch.from_arrays([terms, pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["term", "n_terms", "n_docs"])

        for batch in batches:
            col = batch.column(0)
            flat = pc.list_flatten(col)
            flat = flat.cast(pa.string())
            doc = pc.list_parent_indices(col).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.index_in(flat, value_set=known)
            is_heavy = pc.is_valid(at).to_numpy(zero_copy_only=False)
            where = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            own = where[is_heavy]
            n_terms += np.bincount(own, minlength=k)
            n_docs += np.bincount(np.unique(doc[is_heavy] * k + own) % k, minlength=k)
            light = flat.filter(pa.array(~is_heavy)).dictionary_encode()
            size = len(light.dictionary)
            if size:
                code = light.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                yield emit(light.dictionary, np.bincount(code, minlength=size), np.bincount(np.unique(doc[~is_heavy] * size + code) % size, minlength=size))
        seen = np.flatnonzero(n_terms)
        if len(seen):
            yield emit(known.take(pa.array(seen)), n_terms[seen], n_docs[seen])

    return run


def term_counts(df: DataFrame, *fields: str) -> DataFrame:
    """(term, n_terms, n_docs) of every term of the fields."""
    terms = df.select(terms_of(*[F.col(f) for f in fields]).alias("terms"))
    heavy = detect_heavy(terms)
    partial = terms.mapInArrow(_count(heavy), "term string, n_terms long, n_docs long")
    return partial.groupBy("term").agg(F.sum("n_terms").alias("n_terms"), F.sum("n_docs").alias("n_docs"))


def mark_terms(counts: DataFrame, n_rows: int, rare: int = 2, common_in: int = 4) -> DataFrame:
    """Adds mark: rare up to ``rare`` rows, else common in more than one row of ``common_in``, else null."""
    n = F.col("n_docs")
    return counts.withColumn("mark", F.when(n <= rare, F.lit("rare")).when(n * common_in > n_rows, F.lit("common")))
