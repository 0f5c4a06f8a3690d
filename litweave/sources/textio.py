"""Text, CSV and JSON files of the workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus_tokens(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, tokens) of the lines of text files."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.split(F.trim("value"), r"\s+").alias("tokens"))


def write_walks(sentences: DataFrame, path: str, column: str = "sentence") -> None:
    """Walk sentences appended as lines, a file a task."""
    sentences.select(column).write.mode("append").text(path)


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    """(walk, pos, token) of walk lines; walks are numbered by file and place."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("walk", F.xxhash64("_metadata.file_path", F.monotonically_increasing_id()))
    return lines.select("walk", F.posexplode(F.split("value", " ")).alias("pos", "token"))


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a file with a number a line; lines that are none become null."""
    return spark.read.text(path).select(F.trim("value").try_cast("double").alias("value"))


def read_columns(spark: SparkSession, path: str, columns: dict[str, str], sep: str = "\t") -> DataFrame:
    """Named columns of a delimited file with header, renamed; only they are parsed."""
    df = spark.read.csv(path, sep=sep, header=True)
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in columns.items()])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(token, vec) of lines id, component, component ..."""
    parts = F.split("value", ",")
    return spark.read.text(path).select(parts[0].alias("token"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.trim(x).try_cast("float")).alias("vec"))


def read_json_map(spark: SparkSession, path: str, value: str = "int") -> DataFrame:
    """(key, value) of JSON objects."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def write_by_year(df: DataFrame, path: str, year: str = "year") -> None:
    """Parquet partitioned by year, one shuffle by year and hash, so that a large year is not one task."""
    df.repartition(F.col(year), F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(16))).write.mode("overwrite").partitionBy(year).parquet(path)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of adjacency lines: node, neighbour, neighbour ...; comments start with #."""
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+").alias("n"))
    return lines.select(F.get("n", 0).try_cast("long").alias("src"), F.explode(F.slice("n", F.lit(2), F.size("n"))).alias("dst")).select("src", F.col("dst").try_cast("long").alias("dst"))
