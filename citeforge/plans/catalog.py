"""Queries over the catalogue and its log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import citation_key, csv_guard, fingerprint, normalize_doi, normalize_text
from ..operators import maintenance, postings
from ..operators.catalog import NOT_A_TITLE, bm25, keep_best, like_search, quality_sample, survivors, upsert
from ..sources import versions
from ..sources.store import new_path
from ..sources.tables import ESSAYS, LOG, PAPERS, essays, papers, query_log, table


def catalog_doi_survivors(spark, d):
    return survivors(papers(spark, d), query_log(spark, d), F.lower("doi"))


def catalog_title_year_survivors(spark, d):
    return survivors(papers(spark, d), query_log(spark, d), F.concat(F.lower("title"), F.lit("|"), F.coalesce("year", F.lit(-1)).cast("string")))


_SURVIVORS = """WITH {papers}, {log}, refs AS (SELECT paper_id, count(*) AS n FROM log GROUP BY 1),
    c AS (SELECT id, {key} AS k, coalesce(n, 0) AS refs FROM papers LEFT JOIN refs ON paper_id = id WHERE {key} IS NOT NULL)
    SELECT id, refs, first_value(id) OVER (PARTITION BY k ORDER BY refs DESC, id) AS survivor_id, count(*) OVER (PARTITION BY k) AS copies FROM c
    QUALIFY count(*) OVER (PARTITION BY k) > 1"""


def query_log_stats(spark, d):
    return query_log(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("found").alias("hits"), (F.avg("found") * 100).alias("hit_rate"))


def recent_queries(spark, d):
    log, p = query_log(spark, d), papers(spark, d).select("id", "title")
    return log.orderBy(F.desc("queried_at"), F.desc("id")).limit(10).join(p.withColumnRenamed("id", "paper_id"), "paper_id", "left").select("id", "found", "paper_id", "title")


def paper_keys(spark, d):
    p = papers(spark, d)
    none = F.lit(None).cast("string")
    return p.select("id", normalize_doi(F.concat(F.lit("https://doi.org/"), F.upper("doi"), F.lit("."))).alias("doi_key"), normalize_text(F.col("title")).alias("title_key"), citation_key(F.col("doi"), none, F.col("title"), F.col("authors")[0], F.col("year"), none).alias("cite_key"), fingerprint(F.col("doi"), F.col("title")).alias("print"), csv_guard(F.concat(F.lit("="), "title")).alias("cell"))


def paper_upsert(spark, d):
    p = papers(spark, d).select("id", "doi", "title", "year")
    changes = p.select((F.col("id") + 5 * (F.col("id") % 3)).alias("id"), F.lit(None).cast("string").alias("doi"), F.concat(F.lit("new "), "title").alias("title"), (F.col("year") + 1).alias("year"))
    return upsert(p, keep_best(changes, ["id"], [F.desc("year"), "title"]), "id")


def paper_search_bm25(spark, d):
    return bm25(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), ["thing", "that", "und", "trash"])


def _index(spark, d):
    """An index over the texts, written in two segments as a catalogue that has grown."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    path = new_path(spark, "postings")
    for part in (0, 1):
        postings.add(docs.where(F.col("id") % 2 == part), path)
    return postings.Index(spark, path)


def paper_search_batch(spark, d):
    """The five texts that best match the title of each hundredth paper, all its words held."""
    asked = papers(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("text"))
    return _index(spark, d).search(asked, 5)


def word_search_batch(spark, d):
    """The ten texts that best match the longest word and the last word of each hundredth paper's title, together."""
    word = F.array_max(F.transform(postings.words_of(F.col("title")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = papers(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", word, F.try_element_at(postings.words_of(F.col("title")), F.lit(-1))).alias("text"))
    return _index(spark, d).search(asked, 10)


_SOURCE = "CASE WHEN length(title) % 3 = 0 THEN 'known_papers' ELSE source END"


def maintained_catalog(spark, d):
    """The catalogue after maintenance as its next version has it, and how often the log refers to each row."""
    p = papers(spark, d).select("id", F.expr("CASE WHEN length(title) % 3 = 0 THEN NULL ELSE doi END").alias("doi"), F.expr("CASE WHEN id % 40 = 7 THEN ' ' ELSE title END").alias("title"), "year", F.expr(_SOURCE).alias("source"))
    kept = versions.Versions(spark, new_path(spark, "catalogue"))
    kept.commit({"papers": p, "query_log": query_log(spark, d).select("id", "paper_id", "found")})
    maintenance.maintain(kept, papers(spark, d).select("title", "doi").where("doi is not null"))
    now = kept.tables()
    refs = now["query_log"].groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("refs"))
    return now["papers"].join(refs, "id", "left").select("id", F.coalesce("refs", F.lit(0)).alias("refs"), "source")


def quality_papers(spark, d):
    """Thirty good records at random; the abstract is a text's second half, if it has one."""
    text = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("CASE WHEN n_chars % 3 > 0 THEN substr(text, length(text) DIV 2) END").alias("abstract"))
    p = papers(spark, d).select("id", "doi", F.expr("substr(title, 1, 170 + id % 20)").alias("title"), F.array("source").alias("authors"), "year").join(text, "id")
    return quality_sample(p, 11, 30).select("id", "title", "year", "doi")


def like_matches(spark, d):
    """Papers whose title holds two middle words of each paper's own, of its year and source."""
    p = papers(spark, d).select("id", "title", F.array("source").alias("authors"), "year", "source")
    words = F.split("title", " ")
    middle = F.array_join(F.slice(words, F.floor(F.size(words) / 2).cast("int") + 1, 2), " ")
    return like_search(p, p.select(F.col("id").alias("query_id"), middle.alias("title"), F.expr("upper(substr(source, 2))").alias("author"), F.when(F.col("id") % 2 == 0, F.col("year")).alias("year")))


def essay_keep_best(spark, d):
    return keep_best(essays(spark, d), ["user_id", "class_id"], [F.desc("uploaded_at"), "essay_id"]).select("essay_id", "user_id", "class_id")


QUERIES = {f.__name__: f for f in (catalog_doi_survivors, catalog_title_year_survivors, query_log_stats, recent_queries, paper_keys, paper_upsert, paper_search_bm25, paper_search_batch, word_search_batch, maintained_catalog, quality_papers, like_matches, essay_keep_best)}

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_SEARCH = """WITH {papers}, n AS (SELECT doc_id AS id, {words} AS words FROM documents), t AS (SELECT sum(len(words)) / count(*) AS mean, count(*) AS total FROM n),
        tf AS (SELECT id, len, word, count(*) AS tf FROM (SELECT id, len(words) AS len, unnest(words) AS word FROM n) GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
        q AS (SELECT id AS query_id, list_distinct({asked}) AS words FROM (SELECT id, {title} AS w FROM papers WHERE id % 100 = 0)), u AS (SELECT query_id, len(words) AS many, unnest(words) AS word FROM q),
        s AS (SELECT query_id, id, any_value(many) AS many, count(*) AS held, CAST(sum(CAST(floor(1e6 * greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) + 0.5) AS BIGINT)) AS BIGINT) AS score
            FROM u JOIN tf USING (word) JOIN df USING (word), t GROUP BY query_id, id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM s WHERE held = many QUALIFY rank <= {top}"""

_KEY = r"trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"

ORACLE_SQL = {
    "quality_papers": rf"""WITH {PAPERS}, p AS (SELECT p.id, doi, substr(title, 1, CAST(170 + id % 20 AS INTEGER)) AS title, p.source, year, CASE WHEN n_chars % 3 > 0 THEN substr(text, length(text) // 2) END AS abstract FROM papers p JOIN documents ON doc_id = id),
        t AS (SELECT *, regexp_replace(trim(title), '\.+$', '') AS t FROM p),
        g AS (SELECT *, coalesce(trim(abstract), '') = '' AS bare, md5(CAST(id AS VARCHAR) || '-11') AS h FROM t WHERE length(t) BETWEEN 18 AND 180 AND NOT regexp_matches(t, '[.?!]') AND NOT regexp_matches(t, '{NOT_A_TITLE}') AND year BETWEEN 1995 AND 2026 AND length(regexp_replace(source, '[^A-Za-zÀ-ÿ]', '', 'g')) >= 3 AND doi IS NOT NULL)
        SELECT id, title, year, doi FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY lower(t) ORDER BY bare, h, id) = 1) ORDER BY bare, h, id LIMIT 30""",
    "like_matches": rf"""WITH {PAPERS}, w AS (SELECT *, string_split(title, ' ') AS w FROM papers), q AS (SELECT id AS query_id, trim(array_to_string(w[len(w) // 2 + 1:len(w) // 2 + 2], ' ')) AS asked, upper(substr(source, 2)) AS author, CASE WHEN id % 2 = 0 THEN year END AS y FROM w)
        SELECT query_id, id FROM q JOIN papers ON contains(lower(title), lower(asked)) AND contains(lower(source), lower(author)) AND (y IS NULL OR y = year)
            AND list_has_any(regexp_split_to_array(lower(title), '[^\p{{L}}\p{{N}}]+'), [list_max(list_transform(list_filter(regexp_split_to_array(lower(asked), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), lambda x: {{'n': length(x), 'w': x}})).w])
        WHERE len(list_filter(regexp_split_to_array(lower(asked), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) > 0""",
    # One step after another, the log rewritten after each.
    "maintained_catalog": f"""WITH {PAPERS}, {LOG}, p0 AS (SELECT id, CASE WHEN length(title) % 3 = 0 THEN NULL ELSE doi END AS doi, CASE WHEN id % 40 = 7 THEN ' ' ELSE title END AS title, year, {_SOURCE} AS source FROM papers),
        p1 AS (SELECT * FROM p0 WHERE trim(title) <> ''), l1 AS (SELECT paper_id FROM log), r1 AS (SELECT paper_id AS id, count(*) AS refs FROM l1 GROUP BY 1),
        m1 AS (SELECT id, first_value(id) OVER (PARTITION BY lower(doi) ORDER BY coalesce(refs, 0) DESC, id) AS s FROM p1 LEFT JOIN r1 USING (id) WHERE doi IS NOT NULL),
        p2 AS (SELECT * FROM p1 WHERE id NOT IN (SELECT id FROM m1 WHERE id <> s)), l2 AS (SELECT coalesce(s, paper_id) AS paper_id FROM l1 LEFT JOIN m1 ON m1.id = paper_id), r2 AS (SELECT paper_id AS id, count(*) AS refs FROM l2 GROUP BY 1),
        m2 AS (SELECT id, first_value(id) OVER (PARTITION BY lower(trim(title)), coalesce(year, -1) ORDER BY coalesce(refs, 0) DESC, id) AS s FROM p2 LEFT JOIN r2 USING (id)),
        p3 AS (SELECT * FROM p2 WHERE id NOT IN (SELECT id FROM m2 WHERE id <> s)), l3 AS (SELECT coalesce(s, paper_id) AS paper_id FROM l2 LEFT JOIN m2 ON m2.id = paper_id),
        c AS (SELECT {_KEY.format('title')} AS k, min(doi) AS doi FROM papers WHERE doi IS NOT NULL AND {_KEY.format('title')} <> '' GROUP BY 1),
        m3 AS (SELECT a.id, min(b.id) AS s FROM p3 a LEFT JOIN c ON c.k = {_KEY.format('a.title')} JOIN p3 b ON b.doi = coalesce(a.doi, c.doi) AND b.source <> 'known_papers' WHERE a.source = 'known_papers' GROUP BY a.id),
        p4 AS (SELECT * FROM p3 WHERE id NOT IN (SELECT id FROM m3)), l4 AS (SELECT coalesce(s, paper_id) AS paper_id FROM l3 LEFT JOIN m3 ON m3.id = paper_id), r4 AS (SELECT paper_id AS id, count(*) AS refs FROM l4 GROUP BY 1)
        SELECT id, coalesce(refs, 0) AS refs, source FROM p4 LEFT JOIN r4 USING (id)""",
    "paper_search_batch": _SEARCH.format(papers=PAPERS, words=_WORDS.format("text"), title=_WORDS.format("title"), asked="w", top=5),
    "word_search_batch": _SEARCH.format(papers=PAPERS, words=_WORDS.format("text"), title=_WORDS.format("title"), asked="list_filter([list_max(list_transform(w, lambda x: {'n': length(x), 'w': x})).w, w[-1]], lambda x: x IS NOT NULL)", top=10),
    "catalog_doi_survivors": _SURVIVORS.format(papers=PAPERS, log=LOG, key="lower(doi)"),
    "catalog_title_year_survivors": _SURVIVORS.format(papers=PAPERS, log=LOG, key="lower(title) || '|' || CAST(coalesce(year, -1) AS VARCHAR)"),
    "query_log_stats": f"WITH {LOG} SELECT source, count(*) AS n, CAST(sum(found) AS BIGINT) AS hits, avg(found) * 100 AS hit_rate FROM log GROUP BY source",
    "recent_queries": f"WITH {PAPERS}, {LOG}, r AS (SELECT * FROM log ORDER BY queried_at DESC, id DESC LIMIT 10) SELECT r.id, found, paper_id, title FROM r LEFT JOIN papers ON papers.id = paper_id",
    "paper_keys": rf"""WITH {PAPERS}, n AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(title), 'ß', 'ss'), '\bet\s+al\b\.?', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS words FROM papers)
        SELECT id, doi AS doi_key, words AS title_key, coalesce('doi:' || doi, CASE WHEN title <> '' THEN 'title:' || words || '|' || lower(authors[1]) || '|' || CAST(year AS VARCHAR) END) AS cite_key,
        coalesce(doi, substr(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]', '', 'g'), 1, 120)) AS print, '''=' || title AS cell FROM n""",
    "paper_upsert": f"""WITH {PAPERS}, c AS (SELECT id + 5 * (id % 3) AS id, 'new ' || title AS title, year + 1 AS year FROM papers
            QUALIFY row_number() OVER (PARTITION BY id + 5 * (id % 3) ORDER BY year DESC, title) = 1)
        SELECT coalesce(c.id, p.id) AS id, p.doi, coalesce(c.title, p.title) AS title, coalesce(c.year, p.year) AS year FROM papers p FULL JOIN c ON c.id = p.id""",
    "paper_search_bm25": r"""WITH n AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM documents),
        t AS (SELECT sum(len(words)) / count(*) AS mean, count(*) AS total FROM n),
        w AS (SELECT id, len(words) AS len, unnest(words) AS word FROM n),
        tf AS (SELECT id, len, word, count(*) AS tf FROM w WHERE word IN ('thing', 'that', 'und', 'trash') GROUP BY ALL),
        df AS (SELECT word, count(*) AS df FROM tf GROUP BY word)
        SELECT id, CAST(sum(CAST(floor(1e6 * greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) + 0.5) AS BIGINT)) AS BIGINT) AS score
        FROM tf JOIN df USING (word), t GROUP BY id ORDER BY score DESC, id LIMIT 10""",
    "essay_keep_best": f"WITH {ESSAYS} SELECT essay_id, user_id, class_id FROM essays QUALIFY row_number() OVER (PARTITION BY user_id, class_id ORDER BY uploaded_at DESC, essay_id) = 1",
}
