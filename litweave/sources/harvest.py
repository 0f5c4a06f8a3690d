"""Harvest archives: zip files of compressed XML members, read into records."""

from __future__ import annotations

import gzip
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.runtime import ship
from litweave.sources.files import open_fs

#: The parts of a record that are read.
RECORD_XML = """static_data struct<
  summary: struct<
    pub_info: struct<_sortdate: string>,
    titles: struct<title: array<struct<_VALUE: string, _type: string>>>,
    doctypes: struct<doctype: array<string>>>,
  fullrecord_metadata: struct<abstracts: struct<abstract: array<struct<abstract_text: struct<p: array<string>>>>>>>,
dynamic_data struct<cluster_related: struct<identifiers: struct<identifier: array<struct<_type: string, _value: string>>>>>"""


def _strip(element: ElementTree.Element) -> ElementTree.Element:
    """Tags and attributes without namespaces."""
    for e in element.iter():
        e.tag = e.tag.rpartition("}")[2]
        for k in [k for k in e.attrib if "}" in k]:
            e.attrib[k.rpartition("}")[2]] = e.attrib.pop(k)
    return element


def _records(archive) -> Iterator[tuple[str, int, str | None]]:
    """(member, number, xml) of each record of an archive (a seekable file); a member that breaks off gives null once."""
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if not name.endswith(".xml.gz"):
                continue
            n = 0
            try:
                with z.open(name) as raw, gzip.open(raw) as member:
                    depth, root = 0, None
                    for event, e in ElementTree.iterparse(member, ("start", "end")):
                        depth += 1 if event == "start" else -1
                        if root is None:
                            root = e
                        if event == "end" and depth == 1:
                            yield name, n, ElementTree.tostring(_strip(e), encoding="unicode")
                            n += 1
                            root.clear()  # records that are done are let go of
            except (ElementTree.ParseError, OSError, EOFError):
                yield name, n, None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, year, member, number, xml): one row a record; the year is the number in the archive's name.

    One task an archive, which is opened where it lies and never held whole: members are streamed, records leave in small
    batches.
    """

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows: list[tuple] = []
                system, at = open_fs(unquote(archive))
                with system.open_input_file(at) as f:
                    for row in _records(f):
                        rows.append((archive, *row))
                        if len(rows) == 500:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "member", "number", "xml"])

    files = spark.read.format("binaryFile").load(path).select("path")
    files = files.repartition(max(1, min(files.count(), 10_000)), "path")
    out = files.mapInArrow(run, "archive string, member string, number long, xml string")
    return out.select("archive", F.regexp_extract("archive", r"([0-9]{4})[^/]*$", 1).try_cast("int").alias("year"), "member", "number", "xml")


def extract_records(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): type, date, title, abstract and doi of each record; rejects hold what is not XML.

    doi: the last identifier whose type contains doi; title: the first of type item; abstract: the last abstract's
    first paragraph. Missing parts are null.
    """
    parsed = archives.withColumn("r", F.when(F.col("xml").isNotNull(), F.from_xml("xml", RECORD_XML, {"mode": "PERMISSIVE"})))
    bad = F.col("r").isNull() | (F.col("r.static_data").isNull() & F.col("r.dynamic_data").isNull())
    keys = ["archive", "year", "member", "number"]
    summary = F.col("r.static_data.summary")
    item = F.filter(summary["titles"]["title"], lambda t: t["_type"] == "item")
    doi = F.filter(F.col("r.dynamic_data.cluster_related.identifiers.identifier"), lambda i: i["_type"].contains("doi"))
    records = parsed.where(~bad).select(
        *keys,
        F.get(summary["doctypes"]["doctype"], 0).alias("doc_type"),
        summary["pub_info"]["_sortdate"].try_cast("date").alias("date"),
        F.get(item, 0)["_VALUE"].alias("title"),
        F.get(F.try_element_at(F.col("r.static_data.fullrecord_metadata.abstracts.abstract"), F.lit(-1))["abstract_text"]["p"], 0).alias("abstract"),
        F.try_element_at(doi, F.lit(-1))["_value"].alias("doi"),
    )
    return records, parsed.where(bad).select(*keys, "xml")


def replay(rejects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rejected records tried again without backslashes and control characters."""
    return extract_records(rejects.withColumn("xml", F.regexp_replace("xml", r"[\\\x00-\x08\x0B\x0C\x0E-\x1F]", "")))
