"""Schemas of the bibliographic tables."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _STRING = T.LongType(), T.StringType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PAPER = _schema(paper_id=_LONG, doi=_STRING, date=T.DateType(), title=_STRING, abstract=_STRING)
AUTHOR = _schema(author_id=_LONG, scopus_id=_STRING, given_name=_STRING, surname=_STRING)
ENTITY = _schema(entity_id=_LONG, name=_STRING)
AFFILIATION = _schema(aff_id=_LONG, scopus_id=_STRING, name=_STRING, city=_STRING, country=_STRING)
PAPER_AUTHOR = _schema(paper_id=_LONG, author_id=_LONG)
PAPER_ENTITY = _schema(entity_id=_LONG, paper_id=_LONG)
AUTHOR_AFFILIATION = _schema(author_id=_LONG, aff_id=_LONG)
RAW_HARVEST = _schema(number=T.IntegerType(), type=_STRING, date=T.DateType(), title=_STRING, abstract=_STRING, doi=_STRING)
