"""Bibliographies in TEI and JSON, and the first parser of several that gave anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEI = """_id string, analytic struct<title:string, author:array<struct<persName:struct<forename:array<string>, surname:string>>>, idno:array<struct<_type:string, _VALUE:string>>>,
    monogr struct<title:string, imprint:struct<date:struct<_when:string, _VALUE:string>>>, note array<struct<_type:string, _VALUE:string>>"""


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """(reference_id, title, authors, venue, year, doi, raw) of the bibliography entries in TEI files; authors as "Surname, F."."""
    rows = spark.read.format("xml").option("rowTag", "biblStruct").option("attributePrefix", "_").option("ignoreNamespace", "true").schema(_TEI).load(path)
    typed = lambda items, kind: F.try_element_at(F.filter(F.transform(items, lambda i: F.when(F.lower(i["_type"]) == kind, i["_VALUE"])), lambda v: v.isNotNull()), F.lit(1))
    name = lambda a: F.concat_ws(", ", a["persName"]["surname"], F.array_join(F.transform(a["persName"]["forename"], lambda f: F.concat(F.substring(f, 1, 1), F.lit("."))), " "))
    date = F.col("monogr.imprint.date")
    title = F.coalesce("analytic.title", "monogr.title")
    return rows.select(
        F.col("_id").alias("reference_id"), title.alias("title"), F.filter(F.transform("analytic.author", name), lambda a: a != "").alias("authors"), F.when(F.col("analytic.title").isNotNull(), F.col("monogr.title")).alias("venue"),
        F.nullif(F.regexp_extract(F.coalesce(date["_when"], date["_VALUE"]), r"(\d{4})", 1), F.lit("")).cast("int").alias("year"), typed(F.col("analytic.idno"), "doi").alias("doi"), typed(F.col("note"), "raw_reference").alias("raw"),
    )


def read_json_anthology(spark: SparkSession, path: str) -> DataFrame:
    """(title, authors, year, venue, doi) from files that hold one array of works each; works without a title are left out."""
    rows = spark.read.schema("title string, authors array<string>, year string, venue string, doi string").option("multiLine", "true").json(path)
    return rows.where("trim(title) <> ''").select("title", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.col("year").try_cast("int").alias("year"), "venue", "doi")


def first_parsed(*attempts: Column) -> Column:
    """struct(parser, text): the first of several parsers' texts that is not empty, with its place in the list."""
    out = F
    for i, text in enumerate(attempts):
        out = out.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.struct(F.lit(i).alias("parser"), text.alias("text")))
    return out.otherwise(F.struct(F.lit(None).cast("int").alias("parser"), F.lit(None).cast("string").alias("text")))
