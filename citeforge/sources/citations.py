"""Citations made from the driver's documents, in expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

_TITLE = r"trim(regexp_extract(text, '^[^.!?\n]*', 0))"
_CASE = lambda n, values: f"CASE doc_id % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

#: One citation for each document: made-up and real authors, hosts and DOIs, and all kinds of venues.
FIRST = [
    "doc_id", f"{_TITLE} AS title", "1990 + doc_id % 40 AS year",
    _CASE(8, ["'Vaswani'", "'Nguyễn'", "'Fake Author'", "'Müller'", "'Unknown'", "'van Dijk'", "'Fictional Scholar'", "'Smith'"]) + " AS surname",
    _CASE(9, ["'Journal of Tests, 12(3), 45-67'", "'MIT Press'", "'PhD thesis, Somewhere'", "'Nghị định 12'", "'The Bible'", "'Proceedings of Things'", "'Clinical reports'", "'arXiv:2101.00001'", "'neural archives'"]) + " AS venue",
    _CASE(7, ["'10.1234/fake' || CAST(doc_id AS STRING)", "'10.5555/' || md5(text)", "'10.0000/x'", "'10.48550/arXiv.2101.0000' || CAST(doc_id % 10 AS STRING)", "NULL", "NULL", "NULL"]) + " AS doi",
    _CASE(6, ["'https://www.example.com/a'", "'http://fake-portal.io/x'", "'https://sub.test.com:80/p'", "'https://real.org/page' || CAST(doc_id AS STRING)", "NULL", "NULL"]) + " AS url",
]
SECOND = ["*", "surname || ', J. (' || CAST(year AS STRING) || '). ' || title || '. ' || venue || coalesce(' https://doi.org/' || doi, '') || coalesce(' ' || url, '') AS raw"]

CITATIONS = f"citations AS (SELECT {', '.join(SECOND)} FROM (SELECT {', '.join(FIRST)} FROM documents))"


def citations(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, title, year, surname, venue, doi, url, raw)."""
    return table(spark, folder, "documents").selectExpr(*FIRST).selectExpr(*SECOND)


#: A text of each document with citations, a reference list and an appendix behind it.
TEXT = (
    "text || ' As shown (Smith et al., ' || CAST(1990 + doc_id % 30 AS STRING) || ') and by Tran (' || CAST(2000 + doc_id % 20 AS STRING) || '), see [1, 3-5] and [' || CAST(doc_id % 9 + 1 AS STRING) || "
    "'].' || chr(10) || 'References' || chr(10) || '[1] Smith, J. (2001). One study. Press.' || chr(10) || '[2] Tran, A. (2002). Two' || chr(10) || 'studies. Press.' || chr(10) || 'Appendix A' || chr(10) || 'More.'"
)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr("doc_id", f"{TEXT} AS text")
