"""The bibliographic store as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.runtime import table


@dataclass(frozen=True)
class Catalog:
    """Papers, authors, entities and affiliations with their bridges, under canonical column names."""

    paper: DataFrame
    author: DataFrame
    entity: DataFrame
    affiliation: DataFrame
    paper_author: DataFrame
    paper_entity: DataFrame
    author_affiliation: DataFrame

    @classmethod
    def from_parquet(cls, spark: SparkSession, sf_dir: str, entity: str = "chemical", entity_col: str = "name") -> Catalog:
        """From a directory of Parquet tables; the entity table and its name column can be chosen."""
        t = lambda name: table(spark, sf_dir, name)
        return cls._of(t, entity, entity_col)

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, entity: str = "entity", entity_col: str = "name", **options: str) -> Catalog:
        """From a relational database; predicates and columns are pushed to it."""
        return cls._of(lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load(), entity, entity_col)

    @classmethod
    def _of(cls, t, entity: str, entity_col: str) -> Catalog:
        return cls(
            paper=t("paper").select("paper_id", "doi", "date", F.year("date").alias("year"), "title", "abstract"),
            author=t("author").select("author_id", "scopus_id", "given_name", "surname"),
            entity=t(entity).select(F.col(f"{entity}_id").alias("entity_id"), F.col(entity_col).alias("name")),
            affiliation=t("affiliation").select("aff_id", "scopus_id", "name", "city", "country"),
            paper_author=t("paper_author_mapping").select("paper_id", "author_id"),
            paper_entity=t(f"{entity}_paper_mapping").select(F.col(f"{entity}_id").alias("entity_id"), "paper_id"),
            author_affiliation=t("author_affiliation_mapping").select("author_id", "aff_id"),
        )

    def count(self, name: str) -> DataFrame:
        """Rows of a table, as a table."""
        return getattr(self, name).agg(F.count("*").alias("n_rows"))

    def column(self, name: str, column: str) -> DataFrame:
        """One column of a table."""
        return getattr(self, name).select(column)

    def sql(self, spark: SparkSession, text: str, columns: list[str] | None = None) -> DataFrame:
        """A query over the tables as views, its columns renamed by position."""
        for name in self.__dataclass_fields__:
            getattr(self, name).createOrReplaceTempView(name)
        out = spark.sql(text)
        return out.toDF(*columns) if columns else out

    def save(self, spark: SparkSession, database: str) -> None:
        """All tables as managed tables of a database, created where missing and replaced where present."""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        for name in self.__dataclass_fields__:
            getattr(self, name).write.mode("overwrite").saveAsTable(f"`{database}`.{name}")
