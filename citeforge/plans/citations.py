"""Queries over citation texts: guards, identifiers, authors, occurrences, sections, entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guards as g
from ..functions import identifiers as ids
from ..functions.authors import author_key, author_match, first_surname, fold_author
from ..operators import extraction
from ..operators.cascade import link_all
from ..sources.citations import CITATIONS, TEXT, citations, texts
from ..sources.cited import CITED, MANY, cited, references
from ..sources.store import written
from ..sources.tables import table


def _authors():
    return F.array(F.concat(F.col("surname"), F.lit(", J.")))


def citation_guards(spark, d):
    """What speaks against a citation, or for a source that no registry lists."""
    c = citations(spark, d)
    raw, url, doi = F.col("raw"), F.col("url"), F.col("doi")
    other = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Book review: "), F.col("title"))).otherwise(F.col("title"))
    return c.select("doc_id", g.fake_url(url).alias("fake_url"), g.fabricated_doi(doi).alias("fabricated_doi"), g.fake_author(raw, _authors()).alias("fake_author"), g.source_kind(raw, url, doi).alias("kind"), g.known_author(raw, _authors()).alias("known_author"), g.substantive(raw, _authors(), F.col("year")).alias("substantive"), g.book_review_mismatch(F.col("title"), _authors(), other, _authors()).alias("review"))


def citation_identifiers(spark, d):
    """DOI, address, year and keys found in raw texts, and how much of a citation is known."""
    c = citations(spark, d)
    raw = F.col("raw")
    doi, url, year = ids.extract_doi(raw), ids.extract_url(raw), ids.extract_year(raw)
    none = F.lit(None).cast("array<string>")
    return c.select("doc_id", doi.alias("doi"), url.alias("url"), year.alias("year"), ids.verdict_key(raw).alias("verdict_key"), ids.merge_key(F.concat(F.lit("https://doi.org/"), F.coalesce("doi", F.lit("none")), F.lit("."))).alias("merge_key"), ids.occurrence_confidence(year, doi, url, none, F.col("title")).alias("occurrence"), ids.reference_confidence(F.col("title"), year, _authors(), doi).alias("reference"), ids.same_doi(F.concat(F.lit("doi:"), F.upper("doi")), F.col("doi")).alias("same"))


def author_forms(spark, d):
    """Keys of author names, and how they match the author of the next document."""
    c = citations(spark, d).select("doc_id", "surname", "raw")
    n = c.select((F.col("doc_id") - 1).alias("doc_id"), F.col("surname").alias("other"))
    name = F.concat(F.col("surname"), F.lit(", J."))
    return c.join(n, "doc_id").select("doc_id", author_key(name).alias("key"), first_surname(F.array(name), F.col("raw")).alias("first"), fold_author(F.concat(F.col("surname"), F.lit(" Jr."))).alias("folded"), author_match(F.array(name), F.array(F.concat(F.lit("A. "), F.col("other")))).alias("match"))


_FILES = "'Thesis_' || CAST(o_custkey AS STRING) || CASE o_orderkey % 6 WHEN 0 THEN '_v2' WHEN 1 THEN '_Final' WHEN 2 THEN ' (1)' WHEN 3 THEN '-draft2_fixed' ELSE '' END || '.docx'"


def manuscript_families(spark, d):
    """How many files each manuscript has."""
    files = table(spark, d, "orders").selectExpr(f"{_FILES} AS filename")
    return files.groupBy(ids.manuscript_stem(F.col("filename")).alias("stem")).agg(F.count("*").alias("files"))


def text_occurrences(spark, d):
    """Every citation in each text, where it starts and which pattern claims it."""
    return extraction.occurrences(cited(spark, d)).select("doc_id", "pos", "start", "pattern", "raw")


def linked_occurrences(spark, d):
    """Every citation of each text, found in it, with the references that it links to and the method that says so."""
    whole = written(cited(spark, d), "cited")
    found = extraction.occurrences(whole)
    return link_all(found.select("doc_id", "pos", "raw"), references(spark, d), whole).select("doc_id", "pos", "reference_id", "method")


def text_sections(spark, d):
    """Lines and characters of each section of each text."""
    return extraction.sections(texts(spark, d)).groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


def list_entries(spark, d):
    """The entries of each reference list, taken apart."""
    bib = extraction.sections(texts(spark, d)).where("section = 'bibliography'")
    e = extraction.reference_entries(bib).withColumn("p", extraction.parse_entry(F.col("raw")))
    return e.select("doc_id", "entry", "marker", "raw", F.col("p.style").alias("style"), F.col("p.authors").alias("authors"), F.col("p.title").alias("title"), F.col("p.venue").alias("venue"), F.col("p.year").alias("year"))


# Entries of five styles, made of parts that the query has to find again.
_PARTS = ["doc_id", "'Smith J, Lee A' AS authors", "'Study ' || CAST(doc_id AS STRING) || ' of ' || lang AS title", "'Venue ' || source AS venue", "CAST(1990 + doc_id % 30 AS STRING) AS year", "doc_id % 5 AS k"]
_ENTRY = """CASE k WHEN 0 THEN authors || ' (' || year || '). ' || title || '. ' || venue WHEN 1 THEN authors || ', "' || title || '," ' || venue || ', ' || year || '.'
    WHEN 2 THEN authors || '. "' || title || '." ' || venue || ', ' || year || ', pp. 1-2.' WHEN 3 THEN authors || '. ' || title || '. ' || venue || '. ' || year || ';1:2.' ELSE authors || '. ' || year || '. ' || title || '. ' || venue END"""


def parsed_entries(spark, d):
    p = table(spark, d, "documents").selectExpr(*_PARTS).selectExpr("doc_id", f"{_ENTRY} AS raw").withColumn("p", extraction.parse_entry(F.col("raw")))
    return p.select("doc_id", "p.*")


def style_profiles(spark, d):
    """The style of each document, from four occurrences and two to five entries."""
    docs = table(spark, d, "documents").select("doc_id")
    pos = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")
    numeric = (F.col("doc_id") + F.col("pos")) % (F.col("doc_id") % 3 + 1) == 0
    body = docs.select("doc_id", pos).select("doc_id", F.when(numeric, "[3]").otherwise("(Smith, 2001)").alias("raw"), F.when(numeric, "numeric").otherwise("in_text").alias("kind"))
    entries = docs.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4 + 1).cast("int"))).alias("pos")).select("doc_id", F.lit("Smith").alias("raw"), F.when((F.col("doc_id") % 7 + F.col("pos")) % 3 == 0, "apa").otherwise("ieee").alias("style"))
    return extraction.style_profile(body, entries)


QUERIES = {f.__name__: f for f in (citation_guards, citation_identifiers, author_forms, manuscript_families, text_occurrences, linked_occurrences, text_sections, list_entries, parsed_entries, style_profiles)}


def _re(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


_PLAIN = "trim(regexp_replace(strip_accents(lower({})), '[^a-z ]', '', 'g'))"

_OCCURRENCES = rf"""WITH {CITED}, k AS (SELECT doc_id, {', '.join(f"length(body || {' || '.join([*(f'l{j} || r{j} || {chr(39)} here{chr(39)}' for j in range(i)), f'l{i}'])}) AS s{i}, r{i}, p{i}" for i in range(MANY))} FROM cited),
        own AS (SELECT doc_id, body, regexp_extract_all(body, '\(\d+(?:[,\s\-]+\d+)*\)') AS m, string_split_regex(body, '\(\d+(?:[,\s\-]+\d+)*\)') AS s FROM cited),
        own_at AS (SELECT doc_id, body, m[i] AS raw, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM own)),
        every AS ({' UNION ALL '.join(f"SELECT doc_id, s{i} AS start, p{i} AS pattern, r{i} AS raw FROM k" for i in range(MANY))} UNION ALL
            SELECT doc_id, start, 'numeric_parenthesized', regexp_replace(raw, '\s+', ' ', 'g') FROM own_at WHERE NOT regexp_matches(substr(body, 1, start), '(^|\n)\s*$') OR regexp_matches(substr(body, start + length(raw) + 1, 200), '^\s*[,.;:)\]]|^\s+[a-z]'))"""

ORACLE_SQL = {
    "citation_guards": f"""WITH {CITATIONS}, c AS (SELECT *, lower(coalesce(url, '')) AS u, raw || coalesce(' ' || url, '') AS both_, lower(surname) AS s, regexp_extract(lower(coalesce(url, '')), '://([^/:]*)', 1) AS h FROM citations)
        SELECT doc_id, h IN ('example.com', 'test.com') OR h LIKE '%.example.com' OR h LIKE '%.test.com' OR h LIKE 'fake-%' AS fake_url,
            coalesce(doi LIKE '10.1234/fake%' OR doi LIKE '10.0000/%', false) AS fabricated_doi, s IN ('fake author', 'unknown', 'fictional scholar') AS fake_author,
            CASE WHEN doi IS NOT NULL OR regexp_matches(raw, {_re(g.PERIODICAL)}) THEN NULL WHEN regexp_matches(both_, {_re(g.LEGAL)}) THEN 'legal_or_standard' WHEN u LIKE 'http%' THEN 'web_resource'
                WHEN regexp_matches(both_, {_re(g.CLASSICAL)}) THEN 'classical_or_scriptural' WHEN regexp_matches(both_, {_re(g.THESIS)}) AND NOT regexp_matches(both_, {_re(g.MADE_UP)}) THEN 'thesis_or_report'
                WHEN regexp_matches(both_, {_re(g.PUBLISHER)}) THEN 'book_or_monograph' END AS kind,
            s = 'vaswani' AS known_author, true AS substantive, doc_id % 5 = 0 AND NOT contains(lower(title), 'review') AS review FROM c""",
    "citation_identifiers": rf"""WITH {CITATIONS}, c AS (SELECT *, regexp_replace(raw, {_re(ids.NOT_YEARS.removeprefix('(?iu)'))}, ' ', 'g') AS y0 FROM citations),
        e AS (SELECT *, regexp_extract(y0, '\b(?:19|20)\d\d[a-z]?\b') AS y, regexp_extract(raw, '10\.\d{{4,9}}/[^\s\]\),;()]+') AS doi_found,
            nullif(regexp_replace(regexp_extract(raw, 'https?://[^\s\]\),;]+'), '[.,;:)]+$', ''), '') AS url_found FROM c)
        SELECT doc_id, nullif(regexp_replace(doi_found, '[.,;:]+$', ''), '') AS doi, url_found AS url, y AS year,
            CASE WHEN regexp_matches(lower(raw), '10\.\d{{4,9}}/[^\s,;)\]]+') THEN 'doi:' || rtrim(regexp_extract(lower(raw), '10\.\d{{4,9}}/[^\s,;)\]]+'), '.') ELSE array_to_string(regexp_extract_all(lower(raw), '[a-z0-9]{{3,}}')[1:14], ' ') END AS verdict_key,
            lower(coalesce(doi, 'none')) AS merge_key, round(0.25 + CASE WHEN doi_found <> '' THEN 0.4 ELSE 0 END + CASE WHEN url_found IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN title <> '' THEN 0.1 ELSE 0 END, 2)::DOUBLE AS occurrence,
            round(CASE WHEN title <> '' THEN 0.4 ELSE 0 END + 0.5 + CASE WHEN doi_found <> '' THEN 0.1 ELSE 0 END, 2)::DOUBLE AS reference, doi IS NOT NULL AS same FROM e""",
    "author_forms": f"""WITH {CITATIONS}, k AS (SELECT doc_id, surname, list_last(string_split({_PLAIN.format('surname')}, ' ')) AS key, {_PLAIN.format('surname')} AS folded FROM citations)
        SELECT a.doc_id, a.key, a.surname AS first, a.folded, CASE WHEN a.key = b.key THEN 1.0 ELSE 0.0 END AS match FROM k a JOIN k b ON b.doc_id = a.doc_id + 1""",
    "manuscript_families": "SELECT 'thesis_' || o_custkey AS stem, count(*) AS files FROM orders GROUP BY 1",
    # What the texts were made with, and numbers in brackets that the documents hold themselves.
    "text_occurrences": _OCCURRENCES + """
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS pos, CAST(start AS INTEGER) AS start, pattern, raw FROM every""",
    "linked_occurrences": _OCCURRENCES + rf""", o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS pos, raw FROM every),
        r AS ({' UNION ALL '.join(f"SELECT doc_id, {i} AS id, lower(a{i}) AS author, CAST(y{i} AS INTEGER) AS year, lower(d{i}) AS doi FROM cited" for i in range(MANY))}),
        q AS (SELECT *, lower(regexp_extract(raw, '^\(?([A-Z][a-z]+)', 1)) AS author, TRY_CAST(nullif(regexp_extract(raw, '^\(?[A-Z][a-z]+(?: and [A-Z][a-z]+| et al\.)?,? \(?((?:19|20)\d\d)', 1), '') AS INTEGER) AS year FROM o),
        doi AS (SELECT q.doc_id, pos, max(id) AS id FROM q JOIN r ON q.doc_id = r.doc_id AND lower(raw) = doi GROUP BY ALL),
        num AS (SELECT q.doc_id, pos, id FROM q JOIN r ON q.doc_id = r.doc_id AND (regexp_matches(raw, '^\[') OR raw LIKE '^%') AND list_contains(list_transform(regexp_extract_all(raw, '\d+'), lambda x: CAST(x AS INTEGER)), id + 1)),
        who AS (SELECT q.doc_id, pos, min(id) AS id FROM q JOIN r ON q.doc_id = r.doc_id AND q.author = r.author AND q.year = r.year GROUP BY ALL),
        near AS (SELECT q.doc_id, pos, id FROM q JOIN r ON q.doc_id = r.doc_id AND length(q.author) >= 4 AND (q.year = r.year AND id = 3 AND left(q.author, -1) = left(r.author, -1) OR q.author = r.author AND abs(q.year - r.year) <= 9)
            QUALIFY row_number() OVER (PARTITION BY q.doc_id, pos ORDER BY q.year <> r.year, id) = 1)
        SELECT doc_id, CAST(pos AS INTEGER) AS pos, id AS reference_id, method FROM (SELECT *, 'doi' AS method FROM doi UNION ALL SELECT *, 'numeric' FROM num ANTI JOIN doi USING (doc_id, pos) UNION ALL SELECT *, 'author_year' FROM who ANTI JOIN doi USING (doc_id, pos)
            UNION ALL SELECT *, 'fuzzy_author_year' FROM near ANTI JOIN who USING (doc_id, pos))""",
    "text_sections": f"""WITH t AS (SELECT doc_id, length(text) AS n, length(text) - length(replace(text, chr(10), '')) AS breaks, {TEXT} AS text FROM documents), l AS (SELECT *, strpos(substr(text, n + 1), chr(10)) - 1 AS more FROM t)
        SELECT doc_id, 'body' AS section, breaks + 1 AS lines, n - breaks + more AS chars FROM l UNION ALL SELECT doc_id, 'bibliography', 4, 10 + 39 + 24 + 15 FROM l UNION ALL SELECT doc_id, 'appendix', 2, 10 + 5 FROM l""",
    "list_entries": """SELECT doc_id, e AS entry, e AS marker, CASE e WHEN 1 THEN 'Smith, J. (2001). One study. Press.' ELSE 'Tran, A. (2002). Two studies. Press.' END AS raw, 'apa' AS style, CASE e WHEN 1 THEN 'Smith, J.' ELSE 'Tran, A.' END AS authors,
        CASE e WHEN 1 THEN 'One study' ELSE 'Two studies' END AS title, 'Press.' AS venue, CASE e WHEN 1 THEN '2001' ELSE '2002' END AS year FROM documents, range(1, 3) t(e)""",
    "parsed_entries": f"SELECT doc_id, CASE k WHEN 0 THEN 'apa' WHEN 1 THEN 'ieee' WHEN 2 THEN 'mla' WHEN 3 THEN 'vancouver' ELSE 'chicago' END AS style, authors, title, venue, year FROM (SELECT {', '.join(_PARTS)} FROM documents)",
    "style_profiles": """WITH b AS (SELECT doc_id, count_if((doc_id + p) % (doc_id % 3 + 1) = 0) / 4 AS i FROM documents, range(0, 4) t(p) GROUP BY 1),
        e AS (SELECT doc_id, count(*) AS m, count_if((doc_id % 7 + p) % 3 = 0) / count(*) AS a FROM documents, range(0, 5) t(p) WHERE p <= doc_id % 4 + 1 GROUP BY 1),
        r AS (SELECT doc_id, m, (1 - i + a) / 2 AS apa, (i + 1 - a) / 2 AS ieee FROM b JOIN e USING (doc_id)),
        s AS (SELECT *, CASE WHEN m + 4 < 5 THEN 'UNKNOWN' WHEN apa > 0.3 AND ieee > 0.3 THEN 'MIXED' WHEN apa > ieee AND apa > 0.5 THEN 'APA-like' WHEN ieee > apa AND ieee > 0.5 THEN 'IEEE-like' ELSE 'UNKNOWN' END AS style FROM r)
        SELECT doc_id, apa, ieee, style, CASE WHEN style LIKE '%-like' THEN least(1, greatest(apa, ieee) + 0.1) ELSE greatest(apa, ieee) END AS confidence FROM s""",
}
