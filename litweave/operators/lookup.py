"""Bibliographic lookups: filters and equi-joins on ids.

``ids``/``names`` may be a list or a one-column DataFrame; a DataFrame becomes a semi-join, so that long lists never
turn into long predicates. None means all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.functions.predicates import keywords, year_in
from litweave.sources.catalog import Catalog

Ids = Iterable | DataFrame | None


def among(df: DataFrame, column: str, ids: Ids) -> DataFrame:
    """Rows whose column is among the ids."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(ids)))


def _dated(c: Catalog, years: Iterable[int] = ()) -> DataFrame:
    return c.paper.where(year_in(F.col("year"), years))


def authors_of_papers(c: Catalog, papers: Ids = None, cols: Iterable[str] = ("author_id",)) -> DataFrame:
    """(paper_id, author columns), one row for each bridge row."""
    return among(c.paper_author, "paper_id", papers).join(c.author, "author_id").select("paper_id", *cols)


def entities_of_papers(c: Catalog, papers: Ids = None, cols: Iterable[str] = ("entity_id",)) -> DataFrame:
    """(paper_id, entity columns), one row for each bridge row."""
    return among(c.paper_entity, "paper_id", papers).join(c.entity, "entity_id").select("paper_id", *cols)


def count_authors(c: Catalog, papers: Ids = None) -> DataFrame:
    """(paper_id, n_authors) of papers that have some; bridge rows, not distinct authors."""
    return among(c.paper_author, "paper_id", papers).where(F.col("paper_id").isNotNull()).groupBy("paper_id").agg(F.count("*").alias("n_authors"))


def count_entities(c: Catalog, papers: Ids = None) -> DataFrame:
    """(paper_id, n_entities) of papers that have some; bridge rows."""
    return among(c.paper_entity, "paper_id", papers).where(F.col("paper_id").isNotNull()).groupBy("paper_id").agg(F.count("*").alias("n_entities"))


def authors_by_entity(c: Catalog, names: Ids, years: Iterable[int] = (), cols: Iterable[str] = ("author_id",), papers: bool = False) -> DataFrame:
    """Authors of papers on named entities, one row for each author, paper and entity."""
    found = among(c.entity, "name", names).join(c.paper_entity, "entity_id").join(_dated(c, years).select("paper_id"), "paper_id")
    return found.join(c.paper_author, "paper_id").join(c.author, "author_id").select(*(["paper_id"] if papers else []), *cols, "name")


def papers_by_keyword(c: Catalog, words: Iterable[str], years: Iterable[int] = (), comb: str = "OR", case_sensitives: Iterable[str] = (), cols: Iterable[str] = ("paper_id",), fields: Iterable[str] = ("title", "abstract")) -> DataFrame:
    """Papers whose fields contain the words."""
    return _dated(c, years).where(keywords(words, fields, comb, case_sensitives)).select(*cols)


def authors_by_keyword(c: Catalog, words: Iterable[str], years: Iterable[int] = (), comb: str = "OR", case_sensitives: Iterable[str] = (), cols: Iterable[str] = ("author_id",), fields: Iterable[str] = ("abstract",), papers: bool = False) -> DataFrame:
    """Authors of papers that contain the words (in the abstract by default), one row for each author and paper."""
    found = papers_by_keyword(c, words, years, comb, case_sensitives, fields=fields)
    return found.join(c.paper_author, "paper_id").join(c.author, "author_id").select(*(["paper_id"] if papers else []), *cols)


def papers_of_authors(c: Catalog, authors: Ids = None, years: Iterable[int] = (), cols: Iterable[str] = ("paper_id",)) -> DataFrame:
    """(author_id, paper columns)."""
    return among(c.paper_author, "author_id", authors).join(_dated(c, years), "paper_id").where(F.col("author_id").isNotNull()).select("author_id", *cols)


def count_papers(c: Catalog, authors: Ids = None, years: Iterable[int] = ()) -> DataFrame:
    """(author_id, n_papers) of authors that have some."""
    return papers_of_authors(c, authors, years).groupBy("author_id").agg(F.count("*").alias("n_papers"))


def papers_by_entity(c: Catalog, names: Ids, years: Iterable[int] = (), cols: Iterable[str] = ("paper_id",)) -> DataFrame:
    """Papers on named entities, one row for each paper and entity."""
    return among(c.entity, "name", names).join(c.paper_entity, "entity_id").join(_dated(c, years), "paper_id").select("name", *cols)


def affiliations_of_author(c: Catalog, authors: Ids = None, cols: Iterable[str] = ("aff_id", "name")) -> DataFrame:
    """(author_id, affiliation columns)."""
    return among(c.author_affiliation, "author_id", authors).where(F.col("author_id").isNotNull()).join(c.affiliation, "aff_id").select("author_id", *cols)


def papers_by_affiliation(c: Catalog) -> DataFrame:
    """(aff_id, paper_id) distinct, over the authors of the papers."""
    return c.author_affiliation.join(c.affiliation.select("aff_id"), "aff_id").join(c.paper_author, "author_id").where(F.col("paper_id").isNotNull()).select("aff_id", "paper_id").distinct()


def yearwise_authors(papers: DataFrame, c: Catalog, min_year: int, max_year: int) -> DataFrame:
    """(year, author_id) distinct for the given papers (paper_id); years without authors keep one row with null."""
    spark = papers.sparkSession
    years = spark.range(min_year, max_year + 1).select(F.col("id").cast("int").alias("year"))
    own = papers.select("paper_id").distinct().join(c.paper.select("paper_id", "year"), "paper_id").join(c.paper_author, "paper_id").where(F.col("author_id").isNotNull()).select("year", "author_id").distinct()
    return years.join(own, "year", "left")


def grouped(df: DataFrame, key: str) -> DataFrame:
    """The nested form of a lookup: one row a key with its rows as structs. For keys of bounded size only."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))


def discovery_lineage(c: Catalog, keyword_papers: DataFrame, from_year: int) -> DataFrame:
    """(year, entity_id, paper_id, author_id, role, prior_year, prior_paper) behind each first study of an entity.

    A discovery is the first year in which an entity shares a paper with the keyword. For the authors of those
    papers: earlier papers on the keyword (role Y) and on the entity (role X).
    """
    dated = c.paper.where(F.col("year").isNotNull()).select("paper_id", "year")
    kw = keyword_papers.select("paper_id").distinct().join(dated, "paper_id")
    pe = c.paper_entity.where(F.col("entity_id").isNotNull() & F.col("paper_id").isNotNull()).distinct()
    pa = c.paper_author.where(F.col("author_id").isNotNull() & F.col("paper_id").isNotNull()).distinct()
    both = pe.join(kw, "paper_id")
    first = both.groupBy("entity_id").agg(F.min("year").alias("year")).where(F.col("year") >= from_year)
    found = both.join(first, ["entity_id", "year"]).join(pa, "paper_id").select("year", "entity_id", "paper_id", "author_id")
    prior_y = kw.join(pa, "paper_id").select("author_id", F.col("paper_id").alias("prior_paper"), F.col("year").alias("prior_year"))
    prior_x = pe.join(dated, "paper_id").join(pa, "paper_id").select("author_id", "entity_id", F.col("paper_id").alias("prior_paper"), F.col("year").alias("prior_year"))
    before = F.col("prior_year") < F.col("year")
    y = found.join(prior_y, "author_id").where(before).withColumn("role", F.lit("Y"))
    x = found.join(prior_x, ["author_id", "entity_id"]).where(before).withColumn("role", F.lit("X"))
    return y.unionByName(x).select("year", "entity_id", "paper_id", "author_id", "role", "prior_year", "prior_paper")


def find_in_texts(texts: DataFrame, entries: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(entry, key): documents that hold an entry as a token. The entries' tokens join the exploded tokens."""
    tokens = texts.select(key, F.explode(F.array_distinct(F.split(F.col(text), r"\s+"))).alias("entry"))
    return tokens.join(entries.select("entry").distinct(), "entry").select("entry", key)
