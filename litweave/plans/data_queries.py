"""Queries of the data-preparation operators in the core, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.operators.heavykeys import heavy_keys, key_profile
from litweave.operators.nested import flatten_values, store_nested
from litweave.operators.orphans import REFERENCES, orphan_report, orphans
from litweave.operators.rejects import load_clean, reject_reasons
from litweave.runtime import table, to_utc_ntz

#: (table, key) pairs whose rows per key are uneven.
KEYED = (("chemical_paper_mapping", "chemical_id"), ("paper_author_mapping", "author_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of nested harvest records with their record, ordinal and parent."""
    return flatten_values(table(spark, sf_dir, "harvest_record"))


def p2_affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct affiliation objects and the number of distinct author objects that hold them."""
    store = store_nested(table(spark, sf_dir, "harvest_record"), "record_id", "payload")
    places = store.bridge().where(F.col("kind") == "affiliation").groupBy("child").agg(F.count("*").alias("n_places"))
    return store.table("affiliation").join(places, F.col("object_id") == F.col("child")).select(F.col("value").alias("afid"), "name", "city", "country", "n_places")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged harvest lines with the first reason."""
    return reject_reasons(table(spark, sf_dir, "raw_harvest_line"))


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that can be read, typed."""
    return load_clean(table(spark, sf_dir, "raw_harvest_line"))


def _store_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in dict.fromkeys(x for r in REFERENCES for x in (r.src_table, r.parent))}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references of the mapping tables."""
    return orphans(_store_tables(spark, sf_dir))


def p6_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references counted by table, field, month and reason."""
    return orphan_report(orphans(_store_tables(spark, sf_dir)))


def _profiles(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, DataFrame, DataFrame]]:
    out = []
    for name, key in KEYED:
        rows = table(spark, sf_dir, name)
        out.append((name, key, rows, key_profile(rows.withColumn("loaded_at", to_utc_ntz(F.col("loaded_at"))), key, "paper_id", "loaded_at")))
    return out


def p7_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct papers, most frequent paper, first and last load of every chemical and author id."""
    a, b = (p.where(F.col("key_id").isNotNull()).select(F.lit(t).alias("src_table"), F.lit(k).alias("ref_field"), "*") for t, k, _, p in _profiles(spark, sf_dir))
    return a.unionByName(b)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids holding at least 2 % of the rows of their table."""
    a, b = (heavy_keys(p, rows.count(), 50).select(F.lit(t).alias("src_table"), F.lit(k).alias("ref_field"), "key_id") for t, k, rows, p in _profiles(spark, sf_dir))
    return a.unionByName(b)


QUERIES = {f.__name__: f for f in (p2_found, p2_affiliations, p3_found, p3_loaded, p6_found, p6_by_period, p7_found, p7_profile)}

_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN json_extract({0}, '$[*]') WHEN 'NULL' THEN [] ELSE CASE WHEN {0} IS NULL THEN [] ELSE [{0}] END END"
_SCALAR = "CASE WHEN json_type({0}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string({0}, '$') END"


def _list_sql(frm: str, path: str, cols: str) -> str:
    x = f"json_extract(j, '{path}')"
    return f"SELECT {cols}, unnest(l) AS e, generate_subscripts(l, 1) AS node_no FROM (SELECT {cols}, {_LIST.format(x)} AS l FROM {frm})"


_P2 = f"""
WITH r AS (SELECT record_id, payload::JSON AS j FROM harvest_record),
titles AS ({_list_sql("r", "$.static_data.summary.titles.title", "record_id")}),
abstracts AS ({_list_sql("r", "$.static_data.abstracts.abstract", "record_id")}),
authors AS ({_list_sql("r", "$.static_data.contributors.author", "record_id")}),
identifiers AS ({_list_sql("r", "$.dynamic_data.identifiers.identifier", "record_id")}),
paragraphs AS ({_list_sql("(SELECT record_id, e AS j, node_no AS parent_no FROM abstracts)", "$.paragraphs.p", "record_id, parent_no")}),
affiliations AS ({_list_sql("(SELECT record_id, e AS j, node_no AS parent_no FROM authors)", "$.affiliations.affiliation", "record_id, parent_no")}),
n AS (
  SELECT record_id, 'date' AS node_kind, 0 AS parent_no, 1 AS node_no, json_extract(j, '$.static_data.summary.pub_info.sortdate') AS v FROM r
  UNION ALL SELECT record_id, 'title', 0, node_no, json_extract(e, '$.content') FROM titles
  UNION ALL SELECT record_id, 'paragraph', parent_no, node_no, CASE WHEN json_type(e) = 'OBJECT' THEN json_extract(e, '$.content') ELSE e END FROM paragraphs
  UNION ALL SELECT record_id, 'author', 0, node_no, json_extract(e, '$.auid') FROM authors
  UNION ALL SELECT record_id, 'affiliation', parent_no, node_no, json_extract(e, '$.afid') FROM affiliations
  UNION ALL SELECT record_id, 'identifier', 0, node_no, json_extract(e, '$.value') FROM identifiers
)
SELECT * FROM (SELECT record_id, node_kind, parent_no::BIGINT AS parent_no, node_no::BIGINT AS node_no, {_SCALAR.format("v")} AS node_value FROM n) WHERE node_value IS NOT NULL
"""

def _part(e: str, path: str) -> str:
    return _SCALAR.format(f"json_extract({e}, '{path}')")


#: Author objects are the same when their own values and their affiliations, in order, are.
_P2_AFFILIATIONS = f"""
{_P2.split("paragraphs AS")[0].rstrip().rstrip(",")},
af AS ({_list_sql("(SELECT record_id, node_no AS parent_no, e AS j FROM authors)", "$.affiliations.affiliation", "record_id, parent_no")}),
o AS (SELECT record_id, parent_no, node_no, {_part("e", "$.afid")} AS afid, {_part("e", "$.name")} AS name, {_part("e", "$.address.city")} AS city, {_part("e", "$.address.country")} AS country FROM af),
l AS (SELECT record_id, parent_no, list([afid, name, city, country] ORDER BY node_no) AS kids FROM o GROUP BY ALL),
w AS (SELECT a.record_id, a.node_no AS parent_no, dense_rank() OVER (ORDER BY {_part("a.e", "$.auid")}, {_part("a.e", "$.given")}, {_part("a.e", "$.surname")}, l.kids) AS author
  FROM authors a LEFT JOIN l ON l.record_id = a.record_id AND l.parent_no = a.node_no),
d AS (SELECT DISTINCT w.author, o.node_no, o.afid, o.name, o.city, o.country FROM o JOIN w USING (record_id, parent_no))
SELECT afid, name, city, country, count(*) AS n_places FROM d GROUP BY ALL
"""

_CELL_SQL = '(?:"(?:[^"]|"")*"|[^",]*)'
_CELLS = f"""
cells AS (
  SELECT line_id, line, regexp_extract_all(',' || line, ',({_CELL_SQL})', 1) AS raw FROM raw_harvest_line
),
vals AS (
  SELECT line_id, line, list_transform(raw, lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM cells
),
judged AS (
  SELECT line_id, v, CASE
    WHEN NOT coalesce(regexp_full_match(line, '{_CELL_SQL}(?:,{_CELL_SQL})*'), true) THEN 'quoting'
    WHEN line IS NULL OR len(v) <> 6 THEN 'column_count'
    WHEN NOT regexp_full_match(v[1], '[0-9]{{1,9}}') OR regexp_full_match(v[2], '[\\s\\pZ]*') OR regexp_full_match(v[4], '[\\s\\pZ]*')
      OR NOT (v[3] = '' OR (regexp_full_match(v[3], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND v[3] NOT LIKE '0000%' AND try_cast(v[3] AS DATE) IS NOT NULL))
      OR regexp_matches(v[4] || v[5], '[\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')
      OR NOT (v[6] IN ('', 'NA') OR v[6] LIKE '10.%') THEN 'bad_value' END AS reason
  FROM vals
)
"""

_REFS_SQL = " UNION ALL ".join(
    f"SELECT '{r.src_table}' AS src_table, '{r.field}' AS ref_field, m.{r.field} AS ref_id, m.{r.other} AS other_id, strftime(m.loaded_at, '%Y-%m') AS period, "
    f"unnest([CASE WHEN p.{r.parent_key} IS NULL THEN 'missing' END, CASE WHEN p.loaded_at > m.loaded_at THEN 'late' END, CASE WHEN p.deleted_at <= m.loaded_at THEN 'deleted' END]) AS reason "
    f"FROM {r.src_table} m LEFT JOIN {r.parent} p ON p.{r.parent_key} = m.{r.field} WHERE m.{r.field} IS NOT NULL AND m.{r.other} IS NOT NULL AND m.loaded_at IS NOT NULL"
    for r in REFERENCES
)
_P6 = f"SELECT DISTINCT * FROM ({_REFS_SQL}) WHERE reason IS NOT NULL"


def _p7_sql(found: bool) -> str:
    out = []
    for name, key in KEYED:
        if found:
            out.append(f"SELECT '{name}' AS src_table, '{key}' AS ref_field, {key} AS key_id FROM {name} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) * 50 >= (SELECT count(*) FROM {name})")
        else:
            out.append(
                f"""SELECT '{name}' AS src_table, '{key}' AS ref_field, g.{key} AS key_id, g.n_rows, g.n_values, m.mode_value, m.mode_rows, g.first_at, g.last_at FROM
                (SELECT {key}, count(*) AS n_rows, count(DISTINCT paper_id) AS n_values, min(loaded_at) AS first_at, max(loaded_at) AS last_at FROM {name} WHERE {key} IS NOT NULL GROUP BY {key}) g
                LEFT JOIN (SELECT {key}, paper_id AS mode_value, n AS mode_rows FROM (SELECT {key}, paper_id, count(*) AS n, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, paper_id) AS k FROM {name} WHERE paper_id IS NOT NULL GROUP BY {key}, paper_id) WHERE k = 1) m USING ({key})"""
            )
    return " UNION ALL ".join(out)


ORACLE = {
    "p2_found": _P2,
    "p2_affiliations": _P2_AFFILIATIONS,
    "p3_found": f"WITH {_CELLS} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_loaded": f"""WITH {_CELLS} SELECT line_id, v[1]::INT AS number, v[2] AS doc_type, nullif(v[3], '')::DATE AS date, v[4] AS title, v[5] AS abstract,
      CASE WHEN v[6] NOT IN ('', 'NA') THEN v[6] END AS doi FROM judged WHERE reason IS NULL""",
    "p6_found": _P6,
    "p6_by_period": f"SELECT src_table, ref_field, period, reason, count(*) AS n_cases, count(DISTINCT ref_id) AS n_ids FROM ({_P6}) GROUP BY ALL",
    "p7_found": _p7_sql(True),
    "p7_profile": _p7_sql(False),
}
