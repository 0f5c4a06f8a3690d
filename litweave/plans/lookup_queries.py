"""Queries of the bibliographic lookups and text predicates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.functions import predicates, text
from litweave.operators import lookup
from litweave.operators.incidence import affiliation_block
from litweave.plans.common import BASE, LAST, PROPERTY, SECOND, YEAR, catalog, has, keyword_papers
from litweave.runtime import table

NAMES = ("Ga5V5N3", "Ga3SbNi3Si", "flincrynate", "SrWSe2", "lithium hexene")
YEARS = tuple(range(2005, YEAR))
_NAMES = ", ".join(f"'{n}'" for n in NAMES)
_YEARS = ", ".join(map(str, YEARS))

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT count(*) AS n_rows FROM paper")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).count("paper")


@query("SELECT name FROM chemical")
def column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).column("entity", "name")


@query("SELECT year(date)::INT AS year, count(*) AS papers FROM paper GROUP BY 1")
def raw_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).sql(spark, "SELECT year, count(*) FROM paper GROUP BY year", ["year", "papers"])


@query("SELECT m.paper_id, a.author_id, a.surname FROM paper_author_mapping m JOIN author a USING (author_id)")
def authors_of_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.authors_of_papers(catalog(spark, sf_dir), cols=("author_id", "surname"))


@query("SELECT m.paper_id, c.chemical_id AS entity_id, c.name FROM chemical_paper_mapping m JOIN chemical c USING (chemical_id)")
def entities_of_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.entities_of_papers(catalog(spark, sf_dir), cols=("entity_id", "name"))


@query("SELECT paper_id, count(*) AS n_authors FROM paper_author_mapping WHERE paper_id IS NOT NULL GROUP BY paper_id")
def num_authors_per_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.count_authors(catalog(spark, sf_dir))


@query("SELECT paper_id, count(*) AS n_entities FROM chemical_paper_mapping WHERE paper_id IS NOT NULL GROUP BY paper_id")
def num_entities_per_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.count_entities(catalog(spark, sf_dir))


@query(f"SELECT m.author_id, count(*) AS n_papers FROM paper_author_mapping m JOIN paper p USING (paper_id) WHERE m.author_id IS NOT NULL AND year(p.date) IN ({_YEARS}) GROUP BY m.author_id")
def num_papers_per_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.count_papers(catalog(spark, sf_dir), years=YEARS)


@query(f"SELECT m.author_id, p.paper_id, p.title FROM paper_author_mapping m JOIN paper p USING (paper_id) WHERE m.author_id IS NOT NULL AND year(p.date) IN ({_YEARS})")
def papers_of_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.papers_of_authors(catalog(spark, sf_dir), years=YEARS, cols=("paper_id", "title"))


@query(f"SELECT p.paper_id, a.author_id, c.name FROM chemical c JOIN chemical_paper_mapping e USING (chemical_id) JOIN paper p USING (paper_id) JOIN paper_author_mapping m USING (paper_id) JOIN author a USING (author_id) WHERE c.name IN ({_NAMES})")
def authors_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.authors_by_entity(catalog(spark, sf_dir), NAMES, papers=True)


@query(f"SELECT c.name, p.paper_id FROM chemical c JOIN chemical_paper_mapping e USING (chemical_id) JOIN paper p USING (paper_id) WHERE c.name IN ({_NAMES}) AND year(p.date) IN ({_YEARS})")
def papers_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.papers_by_entity(catalog(spark, sf_dir), NAMES, YEARS)


@query(f"SELECT paper_id, title FROM paper WHERE {has(PROPERTY)}")
def papers_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.papers_by_keyword(catalog(spark, sf_dir), [PROPERTY], cols=("paper_id", "title"))


@query(f"SELECT paper_id FROM paper WHERE {has(PROPERTY)} AND (coalesce(title LIKE '%{SECOND}%', false) OR coalesce(abstract LIKE '%{SECOND}%', false)) AND year(date) IN ({_YEARS})")
def papers_by_two_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.papers_by_keyword(catalog(spark, sf_dir), [PROPERTY, SECOND], YEARS, "AND", [SECOND])


@query(f"SELECT p.paper_id, a.author_id FROM paper p JOIN paper_author_mapping m USING (paper_id) JOIN author a USING (author_id) WHERE {has(PROPERTY, 'p.abstract')}")
def authors_by_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.authors_by_keyword(catalog(spark, sf_dir), [PROPERTY], papers=True)


@query("SELECT m.author_id, f.aff_id, f.name FROM author_affiliation_mapping m JOIN affiliation f USING (aff_id) WHERE m.author_id IS NOT NULL")
def affiliations_of_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.affiliations_of_author(catalog(spark, sf_dir))


@query("SELECT DISTINCT f.aff_id, m.paper_id FROM affiliation f JOIN author_affiliation_mapping x USING (aff_id) JOIN paper_author_mapping m USING (author_id) WHERE m.paper_id IS NOT NULL")
def papers_by_affiliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.papers_by_affiliation(catalog(spark, sf_dir))


@query(f"""{BASE} SELECT y.year, m.author_id FROM (SELECT unnest(range(1990, {LAST}))::INT AS year) y
LEFT JOIN (SELECT DISTINCT kwp.year, m.author_id FROM kwp JOIN paper_author_mapping m ON m.paper_id = kwp.e WHERE m.author_id IS NOT NULL) m USING (year)""")
def yearwise_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return lookup.yearwise_authors(keyword_papers(c), c, 1990, LAST - 1)


@query(f"""{BASE},
be AS (SELECT DISTINCT chemical_id AS v, paper_id AS e FROM chemical_paper_mapping WHERE chemical_id IS NOT NULL AND paper_id IS NOT NULL),
ba AS (SELECT DISTINCT author_id AS a, paper_id AS e FROM paper_author_mapping WHERE author_id IS NOT NULL AND paper_id IS NOT NULL),
bk AS (SELECT be.v, be.e, kwp.year FROM be JOIN kwp USING (e) WHERE kwp.year IS NOT NULL),
f AS (SELECT v, min(year) AS year FROM bk GROUP BY v HAVING min(year) >= 2001),
d AS (SELECT bk.year, bk.v, bk.e, ba.a FROM bk JOIN f USING (v, year) JOIN ba USING (e)),
py AS (SELECT ba.a, kwp.e, kwp.year FROM kwp JOIN ba USING (e) WHERE kwp.year IS NOT NULL),
px AS (SELECT be.v, ba.a, p.e, p.year FROM be JOIN p USING (e) JOIN ba USING (e) WHERE p.year IS NOT NULL)
SELECT d.year, d.v AS entity_id, d.e AS paper_id, d.a AS author_id, 'Y' AS role, py.year AS prior_year, py.e AS prior_paper FROM d JOIN py ON py.a = d.a AND py.year < d.year
UNION ALL SELECT d.year, d.v, d.e, d.a, 'X', px.year, px.e FROM d JOIN px ON px.a = d.a AND px.v = d.v AND px.year < d.year""")
def discovery_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return lookup.discovery_lineage(c, keyword_papers(c), 2001)


@query(f"""{BASE} SELECT DISTINCT pa.e, 'affiliation' AS t, x.aff_id AS v FROM pa JOIN author_affiliation_mapping x ON x.author_id = pa.v WHERE x.aff_id IN (SELECT aff_id FROM affiliation)""")
def affiliation_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affiliation_block(catalog(spark, sf_dir))


@query("""SELECT DISTINCT a.surname AS entry, d.doc_id FROM (SELECT DISTINCT surname FROM author WHERE surname IS NOT NULL) a
JOIN (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents) d ON d.w = a.surname""")
def authors_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = catalog(spark, sf_dir).author.select(F.col("surname").alias("entry")).where(F.col("entry").isNotNull())
    return lookup.find_in_texts(table(spark, sf_dir, "documents"), people)


@query("""WITH a AS (SELECT paper_id, replace(replace(coalesce(title, '') || '. ' || coalesce(abstract, ''), 'Inf', 'inf'), 'All rights reserved.', '') AS x FROM paper WHERE NOT (title IS NULL AND abstract IS NULL)),
b AS (SELECT paper_id, CASE WHEN regexp_extract(x, '\\[DOI:(.*)\\]') <> '' AND len(string_split(regexp_extract(x, '\\[DOI:(.*)\\]'), ' ')) < 20 THEN regexp_replace(x, '\\[DOI:(.*)\\]', '', 'g') ELSE x END AS x FROM a)
SELECT paper_id, CASE WHEN regexp_extract(x, '©(.*)\\.') <> '' AND len(string_split(regexp_extract(x, '©(.*)\\.'), ' ')) < 20 THEN regexp_replace(x, '©(.*)\\.', '', 'g') ELSE x END AS text FROM b""")
def titles_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "paper")
    return papers.select("paper_id", text.title_and_abstract(F.col("title"), F.col("abstract")).alias("text")).where(F.col("text").isNotNull())


@query("SELECT paper_id, regexp_extract_all(abstract, '[\\pL\\pN]+(?:[.\\-][\\pL\\pN]+)*') AS tokens FROM paper WHERE abstract IS NOT NULL")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "paper").where(F.col("abstract").isNotNull()).select("paper_id", text.words(F.col("abstract")).alias("tokens"))


@query("SELECT paper_id, array_to_string(list_transform(regexp_extract_all(lower(abstract), '[\\pL\\pN]*\\pL[\\pL\\pN]*|[0-9]+(?:\\.[0-9]+)?'), lambda t: CASE WHEN regexp_full_match(t, '[0-9.]+') THEN '<nUm>' ELSE t END), ' ') AS text FROM paper WHERE abstract IS NOT NULL")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "paper").where(F.col("abstract").isNotNull()).select("paper_id", text.normalise(F.col("abstract")).alias("text"))


@query("SELECT chemical_id, len(regexp_extract_all(name, '[A-Z][a-z]?')) > 1 AND regexp_full_match(name, '(?:[A-Z][a-z]?[0-9.]*){2,}') AS simple FROM chemical WHERE name IS NOT NULL")
def simple_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chemical").where(F.col("name").isNotNull()).select("chemical_id", text.simple_formula(F.col("name")).alias("simple"))


@query(f"SELECT paper_id FROM paper WHERE coalesce(abstract LIKE '%Curie%', false) AND year(date) BETWEEN {YEAR - 5} AND {YEAR - 1}")
def keyword_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return c.paper.where(predicates.keyword(("abstract",), "Curie", True) & predicates.year_window(F.col("year"), YEAR, 5)).select("paper_id")
