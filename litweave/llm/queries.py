"""Queries of the corpus operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.llm import bpe, ledger, mixing, pii, terms, together
from litweave.runtime import materialise, table


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return ledger.collapse_copies(table(spark, sf_dir, "paper"), "paper_id", ("doi", "title"), "loaded_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of papers with the representative of their group."""
    return ledger.copies(*_ledger(spark, sf_dir))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once with the number of its copies, its smallest id and the one that arrived first."""
    return _ledger(spark, sf_dir)[0].select("first_id", "n_copies", "earliest_id")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and papers of every term, with its mark."""
    papers = table(spark, sf_dir, "paper")
    return terms.mark_terms(terms.term_counts(papers, "title", "abstract"), papers.count())


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in too few or too many papers."""
    return p4_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("term", "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chemicals studied together far more often than chance."""
    pairs = together.associations(table(spark, sf_dir, "chemical_paper_mapping"), "chemical_id", "paper_id", 3, 500, 5)
    return pairs.select(F.col("a").alias("chemical_a"), F.col("b").alias("chemical_b"))


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of chemicals with their counts and association."""
    pairs = together.associations(table(spark, sf_dir, "chemical_paper_mapping"), "chemical_id", "paper_id")
    return pairs.select(F.col("a").alias("chemical_a"), F.col("b").alias("chemical_b"), "n_together", "n_a", "n_b", "n_baskets", F.round("lift", 9).alias("lift"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.sized_documents(table(spark, sf_dir, "documents")), table(spark, sf_dir, "source_target")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that the mix uses up to their cap and that still miss their share."""
    sized, targets = _sized(spark, sf_dir)
    mixed = materialise(mixing.mix(sized, targets), "mix")
    return mixing.exhausted_sources(mixed, materialise(mixing.source_totals(sized, targets), "mix-totals")).select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: one row for each use of a document, in the order of its place."""
    return mixing.mix(*_sized(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    sized, targets = _sized(spark, sf_dir)
    return mixing.shares(mixing.mix(sized, targets), mixing.source_totals(sized, targets))


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mix, as one row of truths."""
    sized, targets = _sized(spark, sf_dir)
    mixed, totals = materialise(mixing.mix(sized, targets), "mix"), materialise(mixing.source_totals(sized, targets), "mix-totals")
    uses = mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("copy_no").alias("last")).join(totals.select("source", "max_repeats"), "source", "left")
    copies = uses.agg(F.every(F.col("n") == F.col("last")).alias("numbered"), F.every(F.col("n") <= F.col("max_repeats")).alias("within_cap"))
    got = mixing.shares(mixed, totals).join(mixing.short_sources(totals).select("source", F.lit(True).alias("short")), "source", "left")
    whole = float(totals.first()["total"] or 1)
    near = F.when(F.col("short"), F.col("mix_tokens") == F.col("max_repeats") * F.col("tokens")).otherwise(F.abs(F.col("mix_tokens") / whole - F.col("target_share")) <= 0.01)
    held = got.agg(F.every(near).alias("near_target"), F.every(F.abs(F.col("actual_share") - F.col("mix_tokens") / F.lit(float(mixed.agg(F.sum("n_tokens")).first()[0] or 1))) < 1e-9).alias("shares_add_up"), F.count("*").alias("n_sources"))
    return copies.join(F.broadcast(held))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: each distinct run and kind."""
    model, spans = pii.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "author"))
    return pii.found_spans(model, spans)


def p10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with typed placeholders in place of personal data."""
    model, spans = pii.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "author"), keep_text=True)
    return pii.mask_spans(spans, model)


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p4_found, p4_terms, p5_found, p5_pairs, p8_ids, p9_found, p9_mix, p9_shares, p9_checks, p10_found, p10_masked)}

_CANON = "regexp_replace(lower(upper({0})), '[^\\pL\\pN]+', '', 'g')"
_GROUPS = f"""
WITH c AS (SELECT paper_id, {_CANON.format("doi")} AS d, {_CANON.format("title")} AS t FROM paper WHERE doi IS NOT NULL AND title IS NOT NULL),
g AS (SELECT paper_id, least(d, t) AS a, greatest(d, t) AS b FROM c WHERE d NOT IN ('', 'na') AND t NOT IN ('', 'na'))
"""
_TERMS = """
WITH w AS (SELECT row_number() OVER () AS r, list_concat(coalesce(regexp_extract_all(lower(title), '\\pL+'), []), coalesce(regexp_extract_all(lower(abstract), '\\pL+'), [])) AS l FROM paper),
u AS (SELECT r, unnest(l) AS term FROM w),
n AS (SELECT term, count(*) AS n_terms, count(DISTINCT r) AS n_docs FROM u GROUP BY term),
m AS (SELECT *, CASE WHEN n_docs <= 2 THEN 'rare' WHEN n_docs * 4 > (SELECT count(*) FROM paper) THEN 'common' END AS mark FROM n)
"""
_PAIRS = """
WITH r AS (SELECT DISTINCT chemical_id AS item, paper_id AS basket FROM chemical_paper_mapping WHERE chemical_id IS NOT NULL AND paper_id IS NOT NULL),
n AS (SELECT item, count(*) AS n FROM r GROUP BY item), t AS (SELECT count(DISTINCT basket) AS n FROM r),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM r x JOIN r y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)
"""
_FROM_PAIRS = "FROM p JOIN n na ON na.item = p.a JOIN n nb ON nb.item = p.b, t"

ORACLE = {
    "p9_checks": "SELECT true AS numbered, true AS within_cap, true AS near_target, true AS shares_add_up, count(DISTINCT source) AS n_sources FROM source_target WHERE source IS NOT NULL",
    "p1_found": f"{_GROUPS} SELECT first_id, paper_id AS copy_id FROM (SELECT paper_id, min(paper_id) OVER (PARTITION BY a, b) AS first_id FROM g) WHERE paper_id <> first_id",
    "p1_records": f"{_GROUPS} SELECT min(paper_id) AS first_id, count(*) AS n_copies, arg_min(paper_id, (coalesce(epoch_us(loaded_at), -1e18::BIGINT), paper_id)) AS earliest_id FROM g JOIN paper USING (paper_id) GROUP BY a, b",
    "p4_found": f"{_TERMS} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p4_terms": f"{_TERMS} SELECT * FROM m",
    "p5_found": f"{_PAIRS} SELECT p.a AS chemical_a, p.b AS chemical_b {_FROM_PAIRS} WHERE p.n >= 3 AND 500 * p.n >= t.n AND t.n::HUGEINT * p.n >= 5::HUGEINT * na.n * nb.n",
    "p5_pairs": f"{_PAIRS} SELECT p.a AS chemical_a, p.b AS chemical_b, p.n AS n_together, na.n AS n_a, nb.n AS n_b, t.n AS n_baskets, round(p.n * t.n::DOUBLE / (na.n::DOUBLE * nb.n), 9) AS lift {_FROM_PAIRS}",
}
