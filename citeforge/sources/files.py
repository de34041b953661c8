"""Catalogue files: JSON lines, BibTeX and XML in, guarded CSV, BibTeX and JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import csv_guard, normalize_doi, year_key
from ..functions.render import bibtex

PAPER = "id string, title string, year int, doi string, authors array<string>"


def read_json_lines(spark: SparkSession, path: str, schema: str = PAPER) -> DataFrame:
    """One paper a line, compressed or not; a line that isn't JSON or has no title leaves."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("trim(title) <> ''")


def _field(name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract("value", rf'(?is)[\s,]{name}\s*=\s*[{{"]?(.*?)[}}"]?\s*(?:,\s*\n|\n\s*\}}|\}}\s*$)', 1)), F.lit(""))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, year, doi, authors); entries begin a line with @, so files split between tasks."""
    entry = spark.read.option("lineSep", "\n@").text(path)
    key = F.regexp_extract("value", r"^@?\w+\{\s*([^,\s]+)\s*,", 1)
    authors = F.transform(F.split(_field("author"), r"\s+and\s+"), lambda a: F.trim(a))
    return entry.select(key.alias("id"), _field("title").alias("title"), F.nullif(year_key(_field("year")), F.lit("")).cast("int").alias("year"), normalize_doi(_field("doi")).alias("doi"), authors.alias("authors")).where("id <> '' and title is not null")


def read_xml(spark: SparkSession, path: str, row: str = "paper", schema: str = "title string, year int, doi string, author array<string>") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path).withColumnRenamed("author", "authors")


def write_csv(rows: DataFrame, path: str) -> None:
    """Text cells that a spreadsheet would take for a formula are guarded."""
    kinds = dict(rows.dtypes)
    rows.select(*[csv_guard(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in rows.columns]).write.option("header", True).csv(path)


def write_bibtex(papers: DataFrame, path: str) -> None:
    papers.select(bibtex(*[F.col(c) for c in ("id", "doi", "title", "authors", "year")])).write.text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
