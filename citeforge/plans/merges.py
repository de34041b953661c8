"""Queries over lists that two sources give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging
from ..sources.cited import DUCK_NAMES, SPARK_NAMES
from ..sources.lists import DUCK_WORDS, SPARK_WORDS
from ..sources.tables import PAPERS, papers, table

# Some terms of Vietnamese titles and their English counterparts.
TERMS = {"học máy": "machine learning", "học sâu": "deep learning", "trí tuệ nhân tạo": "artificial intelligence", "dữ liệu": "data"}


def _reference(k: int, word) -> list[str]:
    """Author, title and year of the k-th of five references, of the document's own words."""
    return [f"coalesce({word(6 * k + 1)}, 'anon') AS a{k}", f"concat_ws(' ', {', '.join(word(6 * k + i) for i in range(2, 7))}) AS t{k}", f"CAST(1950 + (n_chars * {k + 2}) % 70 AS INT) AS y{k}"]


#: What each of two parsers makes of the k-th reference: (id, author, title, year, doi); None: it misses it.
_LEFT = lambda k: None if k == 4 else (f"{k}", f"upper(a{k})", f"t{k}", f"y{k}", f"'10.1/A' || CAST(doc_id AS STRING)" if k == 0 else "CAST(NULL AS STRING)")  # noqa: E731, F541
_RIGHT = lambda k: (f"10 + ({3 * k} + doc_id) % 5", f"a{k} || ', B.'", ["'Another name for it'", "upper(t1)", "'The ' || substr(t2, 1, length(t2) - 2)", "substr(t3, 1, CAST(floor(length(t3) / 2) AS INT))", "t4"][k], f"y{k} + CASE WHEN doc_id % 4 = {k} THEN 1 ELSE 0 END", "'https://doi.org/10.1/a' || CAST(doc_id AS STRING)" if k == 0 else "CAST(NULL AS STRING)")


def _lists(spark, d):
    """The references of each document as two parsers see them: in another order, with other titles, years that differ, and one missed."""
    docs = table(spark, d, "documents").selectExpr("doc_id", "n_chars", f"{SPARK_NAMES} AS words").selectExpr("doc_id", *[x for k in range(5) for x in _reference(k, lambda i: f"try_element_at(words, {i})")])
    made = lambda side, venue: docs.selectExpr("doc_id", "inline(array(" + ", ".join(f"named_struct('reference_id', cast({r[0]} as bigint), 'author', {r[1]}, 'title', {r[2]}, 'year', {r[3]}, 'doi', {r[4]}, 'venue', {venue})" for k in range(5) if (r := side(k))) + "))")
    return made(_LEFT, "CAST(NULL AS STRING)"), made(_RIGHT, "'Venue'")


def merged_lists(spark, d):
    """References of two parsers as one list, with the fields in which they differ."""
    got = merging.merge_lists(*_lists(spark, d))
    return got.select("doc_id", "left_id", "right_id", "title", "year", "venue", "author", F.array_join("conflicts", ",").alias("conflicts"))


def written_back(spark, d):
    """Verified candidates that the catalogue lacks."""
    p = papers(spark, d)
    new = p.select(F.when(F.col("id") % 2 == 0, F.col("doi")).otherwise(F.concat(F.lit("10.77/"), (F.col("id") % 40).cast("string"))).alias("doi"), F.when(F.col("id") % 4 == 1, F.concat(F.lit("New work "), (F.col("id") % 40).cast("string"))).otherwise(F.col("title")).alias("title"), "year", (F.col("id") % 10).alias("confidence"))
    return merging.write_back(p.where("doi is not null or id % 3 = 0"), new).select("doi", F.col("confidence"))


_CONTEXT = "regexp_extract(text, '^[^.!?\n]*', 0) || CASE doc_id % 4 WHEN 0 THEN ' dùng học máy và BERT-base cho dữ liệu' WHEN 1 THEN ' theo trí tuệ nhân tạo' WHEN 2 THEN ' with GPT_2.' ELSE '' END"


def bridged_contexts(spark, d):
    """Contexts with the words that help to compare them with an English source, the next document's title."""
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{_CONTEXT} AS context", "trim(regexp_extract(text, '^[^.!?\n]*', 0)) AS title")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("other"))
    b = docs.join(other, "doc_id", "left").select("doc_id", merging.bridge(F.col("context"), F.col("other"), F.lit(None).cast("string"), TERMS).alias("b"))
    return b.select("doc_id", F.col("b.cross").alias("cross"), F.md5(F.col("b.text")).alias("text"))


def restored_abstracts(spark, d):
    """Texts out of indexes of their words' places, every seventh of which is broken."""
    index = table(spark, d, "documents").select("doc_id", merging.to_positions(F.array_join(F.expr(SPARK_WORDS), " ")).alias("x")).where("x is not null")
    broken = F.when(F.col("doc_id") % 7 == 3, F.substring("x", 2, 1_000_000_000)).when(F.col("doc_id") % 7 == 5, F.concat(F.lit('{"odd": 7, "text": "x", '), F.substring("x", 2, 1_000_000_000))).otherwise(F.col("x"))
    return index.select("doc_id", F.md5(merging.from_positions(broken)).alias("text"))


def swapped_authors(spark, d):
    names = ["Wei, G.", "Guodong, W.", "Wei, X.", "Wei Guodong"]
    a = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", merging.swapped_names(a, F.lit("Guodong Wei")).alias("same"))


QUERIES = {f.__name__: f for f in (merged_lists, written_back, bridged_contexts, restored_abstracts, swapped_authors)}

_KEY = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"

_UNION = lambda side, venue: " UNION ALL ".join(f"SELECT *, list_distinct(list_filter(string_split(k, ' '), lambda x: length(x) > 1)) AS w FROM (SELECT doc_id, CAST({r[0]} AS BIGINT) AS id, {r[1]} AS author, {r[2]} AS title, {r[3]} AS year, {r[4]} AS doi, {_KEY.format(r[2])} AS k, lower(a{k}) AS who FROM d)" for k in range(5) if (r := side(k))).replace("AS STRING", "AS VARCHAR")

ORACLE_SQL = {
    # Pairs are taken one by one, the surest first.
    "merged_lists": rf"""WITH RECURSIVE d AS (SELECT doc_id, {', '.join(x for k in range(5) for x in _reference(k, lambda i: f'words[{i}]'))} FROM (SELECT doc_id, n_chars, {DUCK_NAMES} AS words FROM documents)),
        l AS ({_UNION(_LEFT, 'NULL')}), r AS ({_UNION(_RIGHT, "'Venue'")}),
        byd AS (SELECT l.doc_id, l.id AS a, r.id AS b FROM l JOIN r ON l.doc_id = r.doc_id AND lower(l.doi) = replace(r.doi, 'https://doi.org/', '')),
        l1 AS (SELECT * FROM l ANTI JOIN byd ON l.doc_id = byd.doc_id AND l.id = byd.a), r1 AS (SELECT * FROM r ANTI JOIN byd ON r.doc_id = byd.doc_id AND r.id = byd.b),
        byt AS (SELECT x.doc_id, a, b FROM (SELECT doc_id, k, min(id) AS a FROM l1 WHERE k <> '' GROUP BY ALL) x JOIN (SELECT doc_id, k, min(id) AS b FROM r1 WHERE k <> '' GROUP BY ALL) y ON x.doc_id = y.doc_id AND x.k = y.k),
        l2 AS (SELECT * FROM l1 ANTI JOIN byt ON l1.doc_id = byt.doc_id AND l1.id = byt.a), r2 AS (SELECT * FROM r1 ANTI JOIN byt ON r1.doc_id = byt.doc_id AND r1.id = byt.b),
        p AS (SELECT l2.doc_id, l2.id AS a, r2.id AS b, 100 * len(list_intersect(l2.w, r2.w)) // len(list_distinct(list_concat(l2.w, r2.w))) + CASE WHEN l2.year = r2.year THEN 20 ELSE 0 END + CASE WHEN l2.who = r2.who AND l2.who <> '' THEN 30 ELSE 0 END AS s
            FROM l2 JOIN r2 ON l2.doc_id = r2.doc_id WHERE len(list_intersect(l2.w, r2.w)) > 0),
        q AS (SELECT doc_id, list(struct_pack(s := -s, a := a, b := b) ORDER BY s DESC, a, b) AS pairs FROM p WHERE s >= 60 GROUP BY doc_id),
        g(doc_id, pairs, a, b) AS (SELECT doc_id, pairs, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM q UNION ALL SELECT doc_id, list_filter(pairs, lambda x: x.a <> pairs[1].a AND x.b <> pairs[1].b), pairs[1].a, pairs[1].b FROM g WHERE len(pairs) > 0),
        m AS (SELECT doc_id, a, b FROM g WHERE a IS NOT NULL UNION ALL SELECT * FROM byd UNION ALL SELECT * FROM byt),
        j AS (SELECT l.doc_id AS x, r.doc_id AS y, l.id AS left_id, r.id AS right_id, l.title AS lt, r.title AS rt, l.year AS ly, r.year AS ry, l.doi AS ld, r.doi AS rd, l.author AS la, r.author AS ra FROM l LEFT JOIN m ON m.doc_id = l.doc_id AND m.a = l.id FULL JOIN r ON r.doc_id = m.doc_id AND r.id = m.b)
        SELECT coalesce(x, y) AS doc_id, left_id, right_id, coalesce(lt, rt) AS title, coalesce(ly, ry) AS year, CASE WHEN right_id IS NOT NULL THEN 'Venue' END AS venue, coalesce(la, ra) AS author,
            array_to_string(list_filter([CASE WHEN lower(ld) <> lower(rd) THEN 'doi' END, CASE WHEN lower(lt) <> lower(rt) THEN 'title' END, CASE WHEN ly <> ry THEN 'year' END, CASE WHEN lower(la) <> lower(ra) THEN 'author' END], lambda c: c IS NOT NULL), ',') AS conflicts FROM j""",
    "written_back": rf"""WITH {PAPERS}, n AS (SELECT *, {_KEY.format('title')} AS t FROM papers), b AS (SELECT * FROM n WHERE doi IS NOT NULL OR id % 3 = 0),
        have AS (SELECT coalesce('doi:' || doi, t || '|' || year) AS k FROM b UNION SELECT t || '|' || year FROM b),
        c AS (SELECT CASE WHEN id % 2 = 0 THEN doi ELSE '10.77/' || id % 40 END AS doi, CASE WHEN id % 4 = 1 THEN 'New work ' || id % 40 ELSE title END AS title, year, id % 10 AS confidence FROM papers),
        k AS (SELECT *, {_KEY.format('title')} || '|' || year AS loose FROM c), m AS (SELECT *, coalesce('doi:' || doi, loose) AS k FROM k),
        f AS (SELECT * FROM m WHERE k NOT IN (SELECT k FROM have) AND loose NOT IN (SELECT k FROM have))
        SELECT doi, confidence FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY confidence DESC, title) = 1""",
    "bridged_contexts": rf"""WITH d AS (SELECT doc_id, {_CONTEXT} AS context, trim(regexp_extract(text, '^[^.!?\n]*')) AS title FROM documents),
        j AS (SELECT a.doc_id, coalesce(a.context, '') AS context, coalesce(b.title, '') || ' ' AS source FROM d a LEFT JOIN d b ON b.doc_id = a.doc_id + 1),
        k AS (SELECT *, len(regexp_extract_all(lower(context), '[{merging.MARKED}]')) >= 3 AND len(regexp_extract_all(lower(source), '[{merging.MARKED}]')) <= 5 AS cross_,
            list_concat(list_filter(list_transform(regexp_extract_all(context, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_+.\-]*'), lambda w: rtrim(w, '+.-')), lambda w: regexp_matches(w, '^[A-Za-z][A-Za-z0-9_+.\-]{{2,}}$')),
                list_filter([{', '.join(f"CASE WHEN contains(lower(context), '{p}') THEN '{e}' END" for p, e in TERMS.items())}], lambda x: x IS NOT NULL)) AS more FROM j)
        SELECT doc_id, cross_ AS cross, md5(CASE WHEN NOT cross_ THEN '' WHEN len(more) = 0 THEN context ELSE context || ' (' || array_to_string(more, ' ') || ')' END) AS text FROM k""",
    # What the indexes were made from.
    "restored_abstracts": f"SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN md5(array_to_string(w, ' ')) END AS text FROM (SELECT doc_id, {DUCK_WORDS} AS w FROM documents) WHERE len(w) > 0",
    "swapped_authors": "SELECT doc_id, [true, true, false, true][doc_id % 4 + 1] AS same FROM documents",
}
