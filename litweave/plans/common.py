"""What the queries over the bibliographic tables share: the property, the years, and the SQL of the hypergraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litweave.operators.incidence import Hypergraph, author_block, entity_block, hypergraph, keyword_block
from litweave.operators.lookup import papers_by_keyword
from litweave.sources.catalog import Catalog

#: The property whose entities are predicted, the year of prediction and the years before it that count.
PROPERTY, YEAR, MEMORY, LAST = "remanent polarization", 2012, 5, 2020
SECOND = "charge transfer"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.from_parquet(spark, sf_dir)


def keyword_papers(c: Catalog, word: str = PROPERTY) -> DataFrame:
    return papers_by_keyword(c, [word])


def graph(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """Authors, entities and the property over all papers."""
    c = catalog(spark, sf_dir)
    return hypergraph(c, author_block(c), entity_block(c), keyword_block([keyword_papers(c)]))


def recent(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """The graph of the years before the prediction."""
    return graph(spark, sf_dir).window(YEAR, MEMORY).written()


def has(word: str, *fields: str) -> str:
    """SQL of a keyword predicate."""
    return "(" + " OR ".join(f"coalesce({f} ILIKE '%{word}%', false)" for f in fields or ("title", "abstract")) + ")"


BASE = f"""WITH RECURSIVE
p AS (SELECT paper_id AS e, year(date)::INT AS year, title, abstract FROM paper),
kwp AS (SELECT e, year FROM p WHERE {has(PROPERTY)}),
pa AS (SELECT DISTINCT m.paper_id AS e, m.author_id AS v FROM paper_author_mapping m WHERE m.paper_id IN (SELECT e FROM p) AND m.author_id IN (SELECT author_id FROM author)),
pe AS (SELECT DISTINCT m.paper_id AS e, m.chemical_id AS v FROM chemical_paper_mapping m WHERE m.paper_id IN (SELECT e FROM p) AND m.chemical_id IN (SELECT chemical_id FROM chemical)),
inc AS (SELECT e, 'author' AS t, v FROM pa UNION ALL SELECT e, 'entity', v FROM pe UNION ALL SELECT e, 'keyword', 0::BIGINT FROM kwp),
win AS (SELECT i.e, i.t, i.v FROM inc i JOIN p USING (e) WHERE p.year BETWEEN {YEAR - MEMORY} AND {YEAR - 1}),
deg AS (SELECT t, v, count(*) AS d FROM win GROUP BY t, v),
siz AS (SELECT e, count(*) AS s FROM win GROUP BY e),
st AS (SELECT pe.v, pe.e, kwp.year FROM pe JOIN kwp USING (e) WHERE kwp.year IS NOT NULL),
fy AS (SELECT v, min(year) AS year FROM st GROUP BY v)
"""
