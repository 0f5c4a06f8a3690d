"""Relational ingestion: new rows found by natural key, surrogate keys, bridges without repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.runtime import materialise


def with_surrogate(new: DataFrame, key: str, start: int) -> DataFrame:
    """Adds dense keys after ``start``: numbers within partitions, plus the rows of the partitions before."""
    from pyspark.sql import Window

    cols = new.columns
    parts = materialise(new.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()), "surrogates")
    offsets, below = [], start
    for r in parts.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect():
        offsets.append((r["__p"], below))
        below += r["n"]
    base = new.sparkSession.createDataFrame(offsets, "__p int, __start long")
    number = F.row_number().over(Window.partitionBy("__p").orderBy("__i"))
    return parts.withColumn("__k", number).join(F.broadcast(base), "__p").select((F.col("__start") + F.col("__k")).alias(key), *cols)


def get_or_create(table: DataFrame, incoming: DataFrame, natural: str, key: str) -> DataFrame:
    """The table with a row for each natural key of the incoming rows; known ones keep their key, null ones get none."""
    fresh = incoming.where(F.col(natural).isNotNull()).dropDuplicates([natural]).join(table.select(natural), natural, "left_anti")
    top = table.agg(F.max(key)).first()[0] or 0
    added = with_surrogate(fresh.select(*[c for c in table.columns if c != key and c in fresh.columns]), key, top)
    return table.unionByName(added, allowMissingColumns=True)


def upsert_papers(paper: DataFrame, author: DataFrame, affiliation: DataFrame, paper_author: DataFrame, author_affiliation: DataFrame, incoming: DataFrame) -> dict[str, DataFrame]:
    """All five tables after a delivery.

    incoming(doi, date, title, abstract, authors array<struct<scopus_id, given_name, surname, affiliations
    array<struct<scopus_id, name, city, country>>>>). Papers with a known doi are left out; authors and affiliations
    are matched by external id.
    """
    new = materialise(incoming.where(F.col("doi").isNotNull()).dropDuplicates(["doi"]).join(paper.select("doi").where(F.col("doi").isNotNull()), "doi", "left_anti"), "delivery")
    papers = materialise(get_or_create(paper, new, "doi", "paper_id"), "papers")
    people = new.select("doi", F.explode("authors").alias("a")).select("doi", "a.*")
    authors = materialise(get_or_create(author, people, "scopus_id", "author_id"), "authors")
    places = people.select(F.col("scopus_id").alias("author_scopus"), F.explode("affiliations").alias("f")).select("author_scopus", "f.*")
    affiliations = materialise(get_or_create(affiliation, places, "scopus_id", "aff_id"), "affiliations")
    by_doi, by_person, by_place = papers.select("doi", "paper_id"), authors.select("scopus_id", "author_id"), affiliations.select("scopus_id", "aff_id")
    pa = people.select("doi", "scopus_id").distinct().join(by_doi, "doi").join(by_person, "scopus_id").select("paper_id", "author_id")
    af = places.join(by_person.withColumnRenamed("scopus_id", "author_scopus"), "author_scopus").join(by_place, "scopus_id").select("author_id", "aff_id")
    return {
        "paper": papers,
        "author": authors,
        "affiliation": affiliations,
        "paper_author": paper_author.unionByName(pa).distinct(),
        "author_affiliation": author_affiliation.unionByName(af).distinct(),
    }


def complete_affiliations(author: DataFrame, affiliation: DataFrame, author_affiliation: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(affiliations, bridge, unknown authors) after adding places(author_scopus, scopus_id, name, city, country) of known authors."""
    known = author.select(F.col("scopus_id").alias("author_scopus"), "author_id")
    own = places.join(known, "author_scopus")
    affiliations = materialise(get_or_create(affiliation, own, "scopus_id", "aff_id"), "affiliations")
    bridge = own.select("author_id", "scopus_id").join(affiliations.select("scopus_id", "aff_id"), "scopus_id").select("author_id", "aff_id")
    unknown = places.join(known, "author_scopus", "left_anti").select("author_scopus").distinct()
    return affiliations, author_affiliation.unionByName(bridge).distinct(), unknown
