"""Queries over author lists and links that need more than an exact key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.authors import author_list_score, corporate_keys, parse_authors
from ..operators import linking_fuzzy as fuzzy
from ..sources.tables import table

_NAMES = ["Smith", "Nguyen", "Muller", "Okafor", "Tanaka", "Rossi", "Novak"]
_ORGS = ["World Health Organization", "National Institute of Standards", "United Nations", "Some Press"]


def _pick(names, i):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))


def parsed_authors(spark, d):
    """Last names and initials from lists written in five ways."""
    i = F.col("doc_id")
    a, b = _pick(_NAMES, i), _pick(_NAMES, i * 3 + 1)
    form = i % 5
    raw = (
        F.when(form == 0, F.concat(a, F.lit(", J. K., & "), b, F.lit(", A.")))
        .when(form == 1, F.concat(F.lit("J. K. "), a, F.lit(" and A. "), b))
        .when(form == 2, F.concat(a, F.lit(" JK; "), b, F.lit(" A")))
        .when(form == 3, F.concat(a, F.lit(", J. K., "), b, F.lit(", A., et al.")))
        .otherwise(F.concat(a, F.lit(", John Karl; "), b, F.lit(", Anna")))
    )
    return table(spark, d, "documents").select("doc_id", F.posexplode(parse_authors(raw)).alias("place", "p")).select("doc_id", "place", F.col("p.last").alias("last"), F.array_join("p.initials", ".").alias("initials"))


def author_scores(spark, d):
    """Agreement of cited and candidate lists: subsets, organisations by acronym, strangers."""
    i = F.col("doc_id")
    a, b, c = _pick(_NAMES, i), _pick(_NAMES, i + 1), _pick(_NAMES, i + 2)
    cited = F.when(i % 4 == 0, F.array(a)).when(i % 4 == 1, F.array(a, b)).when(i % 4 == 2, F.array(F.lit("WHO"))).otherwise(F.array(a, F.lit("Stranger")))
    found = F.when(i % 4 == 2, F.array(_pick(_ORGS, F.floor(i / 4)))).otherwise(F.array(b, c, F.lit("Other")))
    return table(spark, d, "documents").select("doc_id", author_list_score(cited, found).alias("score"))


def organisation_keys(spark, d):
    org = _pick(_ORGS, F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(corporate_keys(org)), "|").alias("keys"))


def _references(spark, d):
    """Seven references of each document, one undated, and one of an organisation."""
    o = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("order_index")
    refs = table(spark, d, "documents").select("doc_id", o)
    i = F.col("order_index")
    return refs.select("doc_id", i.alias("reference_id"), "order_index", F.when(i == 7, _ORGS[0]).otherwise(_pick(_NAMES, i)).alias("author"), F.when(i != 3, 2000 + i).alias("year"), F.when(i == 5, "Global report of things").otherwise("Study").alias("title"))


def fuzzy_author_links(spark, d):
    """Misspelt authors, years that slipped and undated references."""
    n, pos = F.col("doc_id"), F.col("pos")
    k = (n + pos) % 7
    name = _pick(_NAMES, k)
    author = F.when(pos == 0, F.concat(name, F.lit("h"))).when(pos == 1, F.concat(F.substring(name, 1, 3), F.lit("x"), F.substr(name, F.lit(5)))).otherwise(name)
    occ = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).select("doc_id", "pos", author.alias("author"), F.when(pos == 3, 2030).when(pos == 2, 1999).otherwise(2000 + k).alias("year"))
    return fuzzy.by_fuzzy_author_year(occ, _references(spark, d).where("order_index < 7"))


def page_links(spark, d):
    n, pos = F.col("doc_id"), F.col("pos")
    raw = F.concat(F.lit("("), _pick(_NAMES, n + pos), F.when(pos == 1, ", 2001)").otherwise(" 12-14)"))
    occ = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos")).select("doc_id", "pos", raw.alias("raw"))
    return fuzzy.by_author_page(occ, _references(spark, d))


def organisation_links(spark, d):
    """Organisations by acronym or name, and titles cited by their beginning."""
    pos = F.col("pos")
    author = F.when(pos == 0, "WHO").when(pos == 1, "The World Health Organization").when(pos == 2, "Global report").otherwise("UNESCO")
    occ = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).select("doc_id", "pos", author.alias("author"), F.when(pos == 2, 2005).otherwise(2007 + F.col("doc_id") % 2).cast("int").alias("year"))
    return fuzzy.by_organisation(occ, _references(spark, d))


def acronym_references(spark, d):
    """References under acronyms that the text explains."""
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit(" The World Health Organization (WHO) said.")).otherwise(F.lit(" The World Health Organization (ABC) said.")))
    learned = fuzzy.acronyms(table(spark, d, "documents").select("doc_id", text.alias("text"))).where("acronym in ('who', 'abc')")
    return fuzzy.with_acronyms(_references(spark, d), learned).where("order_index = 7").select("doc_id", "reference_id", "author")


def parser_links(spark, d):
    occ = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos")).select("doc_id", "pos", (F.col("pos") * 2).alias("reference_id"), (1993 + F.col("doc_id") % 4 + F.col("pos")).alias("year"))
    return fuzzy.by_reference_id(occ, _references(spark, d))


QUERIES = {f.__name__: f for f in (parsed_authors, author_scores, organisation_keys, fuzzy_author_links, page_links, organisation_links, acronym_references, parser_links)}

_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"

ORACLE_SQL = {
    "parsed_authors": f"SELECT doc_id, p AS place, lower({_LIST}[CASE p WHEN 0 THEN doc_id ELSE doc_id * 3 + 1 END % 7 + 1]) AS last, CASE p WHEN 0 THEN 'j.k' ELSE 'a' END AS initials FROM documents, range(0, 2) t(p)",
    "author_scores": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.25 WHEN 2 THEN CASE (doc_id // 4) % 4 WHEN 0 THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS score FROM documents",
    "organisation_keys": "SELECT doc_id, ['who|world health organization', 'national institute standards|nis', 'un|united nations', ''][doc_id % 4 + 1] AS keys FROM documents",
    "fuzzy_author_links": """SELECT doc_id, p AS pos, k AS reference_id FROM (SELECT doc_id, p, (doc_id + p) % 7 AS k FROM documents, range(0, 4) t(p)) WHERE (p < 2 AND k <> 3) OR (p = 0 AND k = 99) OR (p = 2) OR (p = 3 AND k = 3)""",
    "page_links": "SELECT doc_id, p AS pos, (doc_id + p) % 7 AS reference_id FROM documents, range(0, 3) t(p) WHERE p <> 1",
    "organisation_links": "SELECT doc_id, p AS pos, CASE p WHEN 2 THEN 5 ELSE 7 END AS reference_id FROM documents, range(0, 3) t(p) WHERE p = 2 OR doc_id % 2 = 0",
    "acronym_references": "SELECT doc_id, 7 AS reference_id, 'World Health Organization' AS author FROM documents UNION ALL SELECT doc_id, 7, 'who' FROM documents WHERE doc_id % 2 = 0",
    "parser_links": "SELECT doc_id, p AS pos, 2 * p AS reference_id FROM documents, range(0, 5) t(p) WHERE p < 4 AND abs(1993 + doc_id % 4 + p - 2000 - 2 * p) <= 9",
}
