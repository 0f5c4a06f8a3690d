"""Quarantine of delimited lines that cannot be read, with the reason, beside the clean load.

A line is parsed into cells (row, column, value); cell 0 stands for the whole line. The cells meet a rule table on
their column number, each rule is evaluated, failures are aggregated to the first reason of a row, and the clean rows
are those without failure (anti-join).

Defined results
    * line null: ``column_count`` (it has no six values). Empty line: one value, so ``column_count``.
    * repeated line_id: the rows are judged apart, reported once with the first reason of any of them, and loaded where good.
    * values of any length; extra columns of the input are ignored by ``reject_reasons`` and kept by ``load_clean``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("number", "doc_type", "date", "title", "abstract", "doi")
#: One cell: quoted with doubled quotes, or free of quotes and commas. Possessive, so the matcher does not recurse.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_CONTROL = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_BLANK = r"\A[\s\p{Z}\x{85}]*+\z"


@dataclass(frozen=True)
class Rule:
    """``holds`` is true for a good value. Rules are tried by priority; ``reason`` is reported."""

    column: int
    name: str
    reason: str
    priority: int
    holds: Callable[[Column], Column]


def _is_day(v: Column) -> Column:
    return v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~v.startswith("0000") & v.try_cast("date").isNotNull()


#: Column 0 is the whole line.
HARVEST_RULES = (
    Rule(0, "quotes close", "quoting", 1, lambda v: v.isNull() | v.rlike(rf"(?s)\A{_CELL}(?:,{_CELL})*+\z")),
    Rule(0, "six values", "column_count", 2, lambda v: F.coalesce(F.size(cells_of(v)) == len(FIELDS), F.lit(False))),
    Rule(1, "number of 1 to 9 digits", "bad_value", 3, lambda v: v.rlike(r"\A[0-9]{1,9}\z")),
    Rule(2, "type not blank", "bad_value", 3, lambda v: ~v.rlike(_BLANK)),
    Rule(3, "real day or empty", "bad_value", 3, lambda v: (v == "") | _is_day(v)),
    Rule(4, "title not blank", "bad_value", 3, lambda v: ~v.rlike(_BLANK)),
    Rule(4, "title printable", "bad_value", 3, lambda v: ~v.rlike(_CONTROL)),
    Rule(5, "abstract printable", "bad_value", 3, lambda v: ~v.rlike(_CONTROL)),
    Rule(6, "doi, NA or empty", "bad_value", 3, lambda v: (v == "") | (v == "NA") | v.startswith("10.")),
)


def cells_of(line: Column) -> Column:
    """Raw cells of a line whose quotes close."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf"(?s),({_CELL})"), F.lit(1))


def unquote(cell: Column) -> Column:
    """The value of a raw cell."""
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"'), inner).otherwise(cell)


def explode_cells(df: DataFrame, key: str, line: str) -> DataFrame:
    """(key, col_no, value); cell 0 is the line itself."""
    whole = F.array(F.col(line))
    values = F.coalesce(F.transform(cells_of(F.col(line)), unquote), F.array().cast("array<string>"))
    return df.select(F.col(key), F.posexplode(F.concat(whole, values)).alias("col_no", "value"))


def failures(df: DataFrame, key: str, line: str, rules: tuple[Rule, ...] = HARVEST_RULES) -> DataFrame:
    """(key, rule_no, priority, reason) for each rule that a cell breaks. No shuffle: the rule table has a row per rule and is broadcast."""
    spark = df.sparkSession
    rule_table = spark.createDataFrame([(i, r.column, r.name, r.priority, r.reason) for i, r in enumerate(rules)], "rule_no int, col_no int, rule string, priority int, reason string")
    met = explode_cells(df, key, line).join(F.broadcast(rule_table), "col_no")
    holds = F.lit(True)
    for i, r in enumerate(rules):
        holds = F.when(F.col("rule_no") == i, r.holds(F.col("value"))).otherwise(holds)
    return met.where(~F.coalesce(holds, F.lit(False))).select(key, "rule_no", "rule", "priority", "reason")


def reject_reasons(df: DataFrame, key: str = "line_id", line: str = "line", rules: tuple[Rule, ...] = HARVEST_RULES) -> DataFrame:
    """(key, reason): each rejected row once, with its first reason. Only failures are shuffled, combined map-side."""
    first = failures(df, key, line, rules).groupBy(key).agg(F.min("priority").alias("priority"))
    reason = F.coalesce(*[F.when(F.col("priority") == r.priority, F.lit(r.reason)) for r in rules])
    return first.select(key, reason.alias("reason"))


def load_clean(df: DataFrame, key: str = "line_id", line: str = "line", rules: tuple[Rule, ...] = HARVEST_RULES) -> DataFrame:
    """The rows without failure, with typed fields (empty date or doi becomes null, as does the doi ``NA``).

    A row is identified by its key and line, so a good row stays that shares its key with a bad one; the anti-join
    shuffles the few failed rows and, where they are many, the rows by a hash of both.
    """
    whole = F.xxhash64(F.col(key), F.col(line))
    bad = failures(df.withColumn("__row", F.struct(F.col(key), F.col(line))), "__row", line, rules).select("__row").distinct()
    bad = bad.select(F.col(f"__row.{key}").alias("__k"), F.col(f"__row.{line}").alias("__l")).withColumn("__h", F.xxhash64("__k", "__l"))
    rows = df.withColumn("__h", whole)
    good = rows.join(bad, (rows["__h"] == bad["__h"]) & rows[key].eqNullSafe(bad["__k"]) & rows[line].eqNullSafe(bad["__l"]), "left_anti").drop("__h")
    cells = good.withColumn("__cells", F.transform(cells_of(F.col(line)), unquote))
    get = lambda i: F.col("__cells")[i]
    typed = [get(0).cast("int"), get(1), F.nullif(get(2), F.lit("")).cast("date"), get(3), get(4), F.when(~get(5).isin("", "NA"), get(5))]
    return cells.select(F.col(key), *[c.alias(n) for n, c in zip(FIELDS, typed, strict=True)])
