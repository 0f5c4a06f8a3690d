"""Row predicates as Columns: keywords and years."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword(fields: Iterable[str], word: str, case_sensitive: bool = False, wildcards: bool = False) -> Column:
    """Whether any of the fields contains the word. ``wildcards`` leaves % and _ in it live. Null fields do not match."""
    if not wildcards:
        for c in ("\\", "%", "_"):
            word = word.replace(c, "\\" + c)
    like = lambda c: F.col(c).like(f"%{word}%") if case_sensitive else F.col(c).ilike(f"%{word}%")
    return reduce(Column.__or__, [F.coalesce(like(c), F.lit(False)) for c in fields])


def keywords(words: Iterable[str], fields: Iterable[str] = ("title", "abstract"), comb: str = "OR", case_sensitives: Iterable[str] = (), wildcards: bool = False) -> Column:
    """Keyword predicates combined by AND or OR; words in ``case_sensitives`` are compared as written."""
    if comb.upper() not in ("AND", "OR"):
        raise ValueError("comb is AND or OR")
    fields, exact = tuple(fields), set(case_sensitives)
    each = [keyword(fields, w, w in exact, wildcards) for w in words]
    return reduce(Column.__and__ if comb.upper() == "AND" else Column.__or__, each)


def year_in(col: Column, years: Iterable[int]) -> Column:
    """Whether the year is one of those given; no years means any."""
    years = list(years)
    return col.isin(years) if years else F.lit(True)


def year_window(col: Column, year: int, memory: int) -> Column:
    """Years [year - memory, year); ``memory`` <= 0 means all before."""
    return col < year if memory <= 0 else col.between(year - memory, year - 1)
