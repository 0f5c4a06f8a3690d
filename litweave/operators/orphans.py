"""References to rows that are missing, withdrawn or not there yet, found with bitmaps.

Ids become integers: integer keys are their own code, other types get one from a dictionary (``encode_keys``). A code is
split into a range of 64 and a bit. For each range and month the referring ids are one word of bits, ranges without any
are not stored, and words are combined map-side before the shuffle. The parents of a range say which of its bits stood
throughout a month; reference AND-NOT parent leaves the ids that may dangle. The surviving bits are decoded, joined back
to their rows, and each row is judged by its exact times.

A range has at most 64 parents and one word a field and month, whatever the skew; the rows of a hot id are only met in
the last join, which salts them. Each mapping table is read twice. Everything is a JVM expression.

Defined results
    * null id, other id or time in a mapping row: no case. Repeated mapping rows: one case.
    * a parent stored more than once stands from its first load until its last deletion (never, if one is open).
    * a parent without load time counts as always loaded. Empty tables: every reference is missing, or no rows.
    * keys that are no integers: compared as text; ref_id and other_id are then text for all references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litweave.runtime import materialise, skew_join, to_utc_ntz, watch_keys

#: Ids of a range: as many as a word has bits.
WORD_BITS = 6


@dataclass(frozen=True)
class Reference:
    """``field`` of the mapping table refers to ``parent_key`` of the parent table."""

    src_table: str
    field: str
    other: str
    parent: str
    parent_key: str


REFERENCES = (
    Reference("paper_author_mapping", "author_id", "paper_id", "author", "author_id"),
    Reference("paper_author_mapping", "paper_id", "author_id", "paper", "paper_id"),
    Reference("chemical_paper_mapping", "chemical_id", "paper_id", "chemical", "chemical_id"),
    Reference("author_affiliation_mapping", "author_id", "aff_id", "author", "author_id"),
)

#: Times and months of parents that were always there, and of those that stay.
_EVER, _NEVER = -(1 << 62), (1 << 63) - 1
_BEFORE, _AFTER = -1, 1 << 30
_INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def encode_keys(*columns: DataFrame) -> DataFrame:
    """A dictionary (key, code) over the values of one-column tables: dense within each of 2**20 hash ranges."""
    every = columns[0]
    for c in columns[1:]:
        every = every.union(c)
    key = every.columns[0]
    every = every.where(F.col(key).isNotNull()).distinct().withColumn("__h", F.pmod(F.xxhash64(key), F.lit(1 << 20)))
    rank = F.row_number().over(Window.partitionBy("__h").orderBy(key))
    return every.select(F.col(key).alias("key"), (F.col("__h") * (1 << 24) + rank).alias("code"))


def _month(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _word(code: Column) -> Column:
    return F.shiftright(code, WORD_BITS)


def _bit(code: Column) -> Column:
    return code.bitwiseAND((1 << WORD_BITS) - 1).cast("int")


def mapping_rows(tables: dict[str, DataFrame], refs: tuple[Reference, ...], kind: str = "long") -> DataFrame:
    """(ref_no, ref_id, other_id, loaded_at, month): each mapping table is read once, whatever the number of its fields."""
    out = None
    for src in dict.fromkeys(r.src_table for r in refs):
        own = [(i, r) for i, r in enumerate(refs) if r.src_table == src]
        cells = [F.struct(F.lit(i).alias("ref_no"), F.col(r.field).cast(kind).alias("ref_id"), F.col(r.other).cast(kind).alias("other_id"), to_utc_ntz(F.col("loaded_at")).alias("loaded_at")) for i, r in own]
        part = tables[src].select(F.inline(F.array(*cells))).where(F.col("ref_id").isNotNull() & F.col("other_id").isNotNull() & F.col("loaded_at").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out.withColumn("month", _month(F.col("loaded_at")))


def parent_rows(tables: dict[str, DataFrame], refs: tuple[Reference, ...], kind: str = "long") -> DataFrame:
    """(parent, id, loaded_at, deleted_at) of every parent row with an id."""
    out = None
    for parent, key in dict.fromkeys((r.parent, r.parent_key) for r in refs):
        one = tables[parent].where(F.col(key).isNotNull()).select(F.lit(parent).alias("parent"), F.col(key).cast(kind).alias("id"), to_utc_ntz(F.col("loaded_at")).alias("loaded_at"), to_utc_ntz(F.col("deleted_at")).alias("deleted_at"))
        out = one if out is None else out.unionByName(one)
    return out


def reference_words(rows: DataFrame) -> DataFrame:
    """(ref_no, month, word_no, bits) over rows with a code: the bitmaps of the referring ids, without empty words."""
    one = F.expr(f"shiftleft(1L, cast(code & {(1 << WORD_BITS) - 1} as int))")
    return rows.groupBy("ref_no", "month", _word(F.col("code")).alias("word_no")).agg(F.bit_or(one).alias("bits"))


def parent_words(parents: DataFrame) -> DataFrame:
    """(parent, word_no, own): the parents of each range with their bit, times, and months of coming and going. One shuffle."""
    placed = parents.withColumn("word_no", _word(F.col("code"))).repartition("parent", "word_no")
    loaded, gone = _micros(F.col("loaded_at")), _micros(F.col("deleted_at"))
    once = placed.groupBy("parent", "word_no", "code").agg(
        F.min(F.coalesce(loaded, F.lit(_EVER))).alias("loaded"),
        F.min(F.coalesce(_month(F.col("loaded_at")), F.lit(_BEFORE))).alias("first"),
        F.max(F.coalesce(gone, F.lit(_NEVER))).alias("deleted"),
        F.max(F.coalesce(_month(F.col("deleted_at")), F.lit(_AFTER))).alias("last"),
    )
    return once.groupBy("parent", "word_no").agg(F.collect_list(F.struct(_bit(F.col("code")).alias("bit"), "loaded", "deleted", "first", "last")).alias("own"))


def surviving_ids(words: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref_no, month, code, known, loaded, deleted): reference AND-NOT parent, decoded. words hold their parent table."""
    stood = F.filter("own", lambda p: (p["first"] < F.col("month")) & (p["last"] > F.col("month")))
    standing = F.aggregate(stood, F.lit(0).cast("long"), lambda bits, p: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p["bit"])))
    met = words.join(parents, ["parent", "word_no"], "left")
    left = met.withColumn("left", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(standing, F.lit(0).cast("long"))))).where(F.col("left") != 0)
    bits = F.filter(F.sequence(F.lit(0), F.lit((1 << WORD_BITS) - 1)), lambda b: F.call_function("shiftright", F.col("left"), b).bitwiseAND(1) == 1)
    each = left.select("ref_no", "month", "word_no", "own", F.explode(bits).alias("bit"))
    one = F.get(F.filter("own", lambda p: p["bit"] == F.col("bit")), 0)
    each = each.select("ref_no", "month", (F.shiftleft("word_no", WORD_BITS) + F.col("bit")).alias("code"), one.alias("p"))
    return each.select("ref_no", "month", "code", F.col("p").isNotNull().alias("known"), "p.loaded", "p.deleted")


def orphans(tables: dict[str, DataFrame], refs: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """(src_table, ref_field, ref_id, other_id, period, reason): every dangling reference once per reason."""
    spark = next(iter(tables.values())).sparkSession
    keys = [(r.src_table, c) for r in refs for c in (r.field, r.other)] + [(r.parent, r.parent_key) for r in refs]
    kind = "long" if all(dict(tables[t].dtypes)[c] in _INTEGERS for t, c in keys) else "string"
    rows, parents = mapping_rows(tables, refs, kind), parent_rows(tables, refs, kind)
    if kind == "long":
        rows, parents = rows.withColumn("code", F.col("ref_id")), parents.withColumn("code", F.col("id"))
    else:
        known = materialise(encode_keys(rows.select("ref_id"), parents.select("id")), "orphan-dictionary")
        rows = skew_join(rows, known.withColumnRenamed("key", "ref_id"), "ref_id")
        parents = parents.join(known.withColumnRenamed("key", "id"), "id")
    names = F.create_map(*[x for i, r in enumerate(refs) for x in (F.lit(i), F.lit(r.parent))])
    watched, hot = watch_keys(rows, "code")
    words = reference_words(watched).withColumn("parent", names[F.col("ref_no")])
    left = materialise(surviving_ids(words, parent_words(parents)), "orphan-ids")
    facts = spark.createDataFrame([(i, r.src_table, r.field) for i, r in enumerate(refs)], "ref_no int, src_table string, ref_field string")
    met = skew_join(rows, left, "code", ("ref_no", "month"), hot=hot())
    at = _micros(F.col("loaded_at"))
    reasons = F.array(
        F.when(~F.col("known"), F.lit("missing")),
        F.when(F.col("known") & (F.col("loaded") > at), F.lit("late")),
        F.when(F.col("known") & (F.col("deleted") <= at), F.lit("deleted")),
    )
    met = met.select("ref_no", "ref_id", "other_id", F.date_format("loaded_at", "yyyy-MM").alias("period"), F.explode(reasons).alias("reason")).where(F.col("reason").isNotNull())
    return met.distinct().join(F.broadcast(facts), "ref_no").select("src_table", "ref_field", "ref_id", "other_id", "period", "reason")


def orphan_report(cases: DataFrame) -> DataFrame:
    """Cases and distinct ids per table, field, month and reason; ids are counted after a first grouping by id, so no key is hot."""
    by_id = cases.groupBy("src_table", "ref_field", "period", "reason", "ref_id").agg(F.count("*").alias("n"))
    return by_id.groupBy("src_table", "ref_field", "period", "reason").agg(F.sum("n").alias("n_cases"), F.count("*").alias("n_ids"))
