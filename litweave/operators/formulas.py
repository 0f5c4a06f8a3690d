"""Repair of split formulas: runs of neighbouring tokens that together are a known term become that term."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "([{\"'", ".,;:!?)]}\"'"


def runs(tokens: list[str], longest: int) -> Iterator[tuple[int, int, str]]:
    """(start, number of tokens, joined form) of all runs of two tokens or more with a form of at most ``longest`` characters.

    A form is the joined tokens as they are, and without the punctuation around them. Both ends hold a letter or digit.
    """
    good = [any(c.isalnum() for c in t) for t in tokens]
    for i, first in enumerate(tokens):
        if not good[i]:
            continue
        raw, bare = first, first.lstrip(OPEN)
        for j in range(i + 1, len(tokens)):
            if len(bare) >= longest:
                break
            raw, bare = raw + tokens[j], bare + tokens[j]
            if good[j]:
                for form in {raw, bare, raw.rstrip(CLOSE), bare.rstrip(CLOSE)}:
                    if len(form) <= longest:
                        yield i, j + 1 - i, form


def merged(tokens: list[str], found: list[tuple[int, int]]) -> list[str]:
    """The tokens with the found runs (start, number of tokens) joined: from the left, the longest first."""
    best: dict[int, int] = {}
    for at, n in found:
        best[at] = max(n, best.get(at, 0))
    out, i = [], 0
    while i < len(tokens):
        n = best.get(i, 1)
        out.append("".join(tokens[i : i + n]))
        i += n
    return out


def merge_split_terms(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "name") -> DataFrame:
    """The rows of ``texts`` with ``tokens`` (split at blanks, known terms joined) in place of the text; null texts give no row.

    Runs are joined with all terms by form, so there may be any number of terms; equal texts are looked up once.
    """
    known = terms.select(F.col(term).alias("form")).where(F.col("form").isNotNull() & (F.col("form") != "") & ~F.col("form").rlike(r"\s")).distinct()
    longest = known.agg(F.max(F.length("form"))).first()[0] or 0
    own = texts.where(F.col(text).isNotNull()).withColumn("__key", F.sha2(text, 256))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(key, *r) for r in runs(t.split(), longest)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["__key", "at", "n", "form"])

    tried = own.select("__key", text).dropDuplicates(["__key"]).mapInArrow(find, "__key string, at int, n int, form string")
    found = tried.join(known, "form", "left_semi").groupBy("__key").agg(F.collect_set(F.struct("at", "n")).alias("__found"))
    kept = [c for c in texts.columns if c != text]
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept), "tokens array<string>"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True)
            tokens = [merged(t.split(), [(f["at"], f["n"]) for f in found or ()]) for t, found in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(tokens, pa.list_(pa.string()))], [*kept, "tokens"])

    return own.join(found, "__key", "left").select(*kept, text, "__found").mapInArrow(join, schema)
