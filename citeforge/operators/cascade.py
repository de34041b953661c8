"""Every way of linking an occurrence to references, in order; the first that finds any decides.

In order: the parser's own links, DOI, number, author and year (each part of "A, 2001; B, 2002"), author with a
year or a name slightly wrong, author and page, organisation, and title. Acronyms that a text explains count as names of
organisations. An "ibid." takes the first link of the last linked occurrence before it. Each way is an equi-join within a document;
what an earlier way has linked is not asked again, so the dearer ways see the rest alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import extract_doi
from ..functions.normalize import author_years, present, title_tokens
from ..sources.store import written
from .linking import by_author_year, by_key, by_number, by_title
from .linking_fuzzy import acronyms, by_author_page, by_fuzzy_author_year, by_organisation, by_reference_id, with_acronyms

IBID = r"(?i)^\s*\(?\s*(?:ibid(?:em)?|id)\b\.?"
#: Methods in their order, with the confidence of their links.
METHODS = {"parser": 0.98, "doi": 0.95, "numeric": 0.95, "author_year": 0.85, "fuzzy_author_year": 0.75, "author_page": 0.8, "organisation": 0.8, "title": 0.75, "ibid": 0.7}


def link_all(occurrences: DataFrame, references: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, reference_id, method, confidence) of every occurrence that any method links.

    occurrences: (doc_id, pos, raw), and if known parser_id, a reference that the parser has linked, and title; references:
    (doc_id, reference_id, order_index, numeric_index, author, year, suffix, doi, title), author a surname or an organisation; texts: (doc_id, text)
    in which acronyms are explained. An occurrence may have several links by number, or by author and year. Both tables are
    written first, as every way reads them, and what they are made of may be dear."""
    o = occurrences.select("doc_id", "pos", "raw", *[F.col(c) for c in ("parser_id", "title") if c in occurrences.columns])
    o = o.withColumn("doi", F.lower(extract_doi(F.col("raw")))).withColumn("key", F.get(author_years(F.col("raw")), F.lit(0)))
    o = written(o.withColumn("author", F.col("key.author")).withColumn("year", F.col("key.year")).drop("key"), "cascade-occurrences")
    r = written(references.withColumn("doi", F.lower(present(F.col("doi")))).withColumn("year", F.col("year").cast("string")), "cascade-references")
    named = r.select("doc_id", "reference_id", "order_index", "author", "year", "title")
    if texts is not None:
        more = with_acronyms(named, acronyms(texts)).join(named.select("doc_id", "reference_id", "title"), ["doc_id", "reference_id"])
        named = more.select("doc_id", "reference_id", "order_index", "author", "year", "title")
    years = r.select("doc_id", "reference_id", "order_index", F.array(F.lower("author")).alias("authors"), "year", "suffix")
    ways = {
        "parser": (lambda left: by_reference_id(left.where("parser_id is not null").withColumnRenamed("parser_id", "reference_id"), r)) if "parser_id" in o.columns else None,
        "doi": lambda left: by_key(left.where("doi is not null"), r, "doi"),
        "numeric": lambda left: by_number(left, r),
        "author_year": lambda left: by_author_year(left, years).where("reference_id is not null").select("doc_id", "pos", "reference_id"),
        "fuzzy_author_year": lambda left: by_fuzzy_author_year(left.where("author is not null"), r),
        "author_page": lambda left: by_author_page(left, r),
        "organisation": lambda left: by_organisation(left.where("author is not null"), named),
        "title": (lambda left: by_title(left.where("title is not null").withColumn("words", title_tokens(F.col("title"))), r.withColumn("words", title_tokens(F.col("title")))).select("doc_id", "pos", "reference_id")) if "title" in o.columns else None,
    }
    found = None
    for name, way in ways.items():
        if way is None:
            continue
        left = o if found is None else o.join(found.select("doc_id", "pos").distinct(), ["doc_id", "pos"], "left_anti")
        links = written(way(left).select("doc_id", "pos", "reference_id").distinct().withColumn("method", F.lit(name)), "cascade-links")
        found = links if found is None else found.unionByName(links)
    first = found.groupBy("doc_id", "pos").agg(F.min("reference_id").alias("link"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    again = o.select("doc_id", "pos", F.col("raw").rlike(IBID).alias("ibid")).join(first, ["doc_id", "pos"], "left").withColumn("before", F.last("link", True).over(before)).where("ibid and link is null and before is not null")
    every = found.unionByName(again.select("doc_id", "pos", F.col("before").alias("reference_id"), F.lit("ibid").alias("method")))
    sure = F.create_map(*[x for k, v in METHODS.items() for x in (F.lit(k), F.lit(v))])
    return every.withColumn("confidence", sure[F.col("method")])
