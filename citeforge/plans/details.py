"""Queries over text cleaning, venues, laws, rendering and small catalogue steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import context, laws, render, venues
from ..functions.normalize import citation_key
from ..operators import scores
from ..sources.citations import CITATIONS, citations
from ..sources.tables import PAPERS, PREDICTIONS, papers, predictions, table

_MONTH = "CAST(doc_id % 12 + 1 AS STRING)"


def cleaned_contexts(spark, d):
    """Texts with a broken word, a kept hyphen and a broken line put in, made whole again, and the sentence that cites."""
    c = table(spark, d, "documents").select("doc_id", F.concat(F.lit("The cal- ibration of pre- trained nets, see Fig. 2, is known [7]. Number "), "doc_id", F.lit(" of J. Smith et al. is another one.")).alias("t"))
    lines = F.concat(F.lit("machine\nlearning is\n\n\n\nﬁne "), F.col("doc_id").cast("string"))
    return c.select("doc_id", context.dehyphenate(F.col("t")).alias("whole"), F.size(context.split_sentences(F.col("t"))).alias("sentences"), context.focal_sentence(F.col("t"), F.lit("[7]"), F.lit(None).cast("string")).alias("focal"), context.clean_lines(lines).alias("lines"))


def best_segments(spark, d):
    """Of the first five pieces of each text, how many there are and which one holds most spaces."""
    s = table(spark, d, "documents").select("doc_id", context.segments(F.col("text")).alias("s"))
    each = s.select("doc_id", F.posexplode("s").alias("i", "piece")).select("doc_id", "i", (F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit("")))).alias("n"))
    return each.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.max("n").alias("most"), F.max_by("i", F.struct("n", -F.col("i"))).alias("best"))


def venue_names(spark, d):
    """Venues written in several ways, and how like the full name they are."""
    i = F.col("doc_id") % 6
    v = F.when(i == 0, "Proceedings of the NeurIPS 2020").when(i == 1, "ICML").when(i == 2, "Some Journal, 2001").when(i == 3, "ISSN 1234-567x").when(i == 4, "Advances in Neural Networks").otherwise(None)
    full = F.lit("Advances in Neural Information Processing Systems")
    return table(spark, d, "documents").select("doc_id", venues.venue_name(v).alias("name"), F.round(venues.venue_similarity(v, full), 6).alias("likeness"))


def legal_citations(spark, d):
    """Labels of legal citations, some of them made up."""
    texts = [
        "Bộ luật Dân sự 2015, số 91/2015/QH13", "Bộ luật Dân sự 2005, số 33/2005/QH11", "Bộ luật Dân sự 2011", "Nghị định 13/2023/NĐ-CP của Chính phủ", "Nghị định 13/2023/NĐ-CP của Quốc hội", "Luật số 888/2023/QH15",
        "Bộ luật Vũ trụ 2020", "Thông tư ngày 31/02/2020", "Nghị định 10/2020/NĐ-CP ngày 05/03/2021", "Công văn nội bộ",
    ]
    raw = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("doc_id") % len(texts) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", laws.legal_check(raw).alias("c")).select("doc_id", laws.legal_label(F.col("c")).alias("label"), F.col("c.code").alias("code"), F.array_join("c.mismatches", ",").alias("mismatches"))


def rendered_entries(spark, d):
    """Entries in IEEE and Harvard form, their keys and an explanation."""
    i = F.col("doc_id")
    authors = F.when(i % 3 == 0, F.array(F.lit("Smith, John K."), F.lit("Lee, Ann"))).when(i % 3 == 1, F.array(F.lit("Tran, A."))).otherwise(F.array(*[F.lit(f"Name{c}, X.") for c in "ABCDEFG"]))
    doi, url = F.when(i % 2 == 0, F.concat(F.lit("10.1/"), i.cast("string"))), F.when(i % 2 == 1, F.lit("https://x.org"))
    label = F.when(i % 2 == 0, "verified").otherwise("unresolved")
    title, year, venue = F.concat(F.lit("Deep study "), i.cast("string"), F.lit(".")), 2000 + i % 20, F.lit("Venue.")
    return table(spark, d, "documents").select("doc_id", render.ieee(i, title, authors, year, venue, doi, url).alias("ieee"), render.harvard(title, authors, year, venue, doi, url).alias("harvard"), render.cite_key(authors, year, title).alias("key"), render.explanation(label, F.lit("R-X"), F.lit(0.785), F.lit(0.5), i % 4).alias("why"))


def unique_citations(spark, d):
    """One citation for each key, the first; keys come from DOI, else title, author and year."""
    c = citations(spark, d)
    none = F.lit(None).cast("string")
    key = citation_key(F.col("doi"), none, F.col("title"), F.col("surname"), F.col("year"), F.col("raw"))
    w = Window.partitionBy("key").orderBy("doc_id")
    return c.select("doc_id", key.alias("key")).withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "key")


def verifiable_citations(spark, d):
    """Reference entries, and DOIs and addresses that say anything."""
    c = citations(spark, d).withColumn("type", F.element_at(F.array(*[F.lit(t) for t in ("reference_list", "in_text", "numeric", "doi", "url")]), (F.col("doc_id") % 5 + 1).cast("int")))
    known = F.col("type").isin("doi", "url") & (F.col("doi").isNotNull() | F.col("url").isNotNull())
    return c.where((F.col("type") == "reference_list") | known).select("doc_id", "type")


def confident_share(spark, d):
    """The share of predictions at or above each threshold."""
    t = spark.range(5, 10).select((F.col("id") / 10).alias("threshold"))
    per = predictions(spark, d).select("p").withColumn("threshold", F.explode(F.array(*[F.lit(i / 10) for i in range(5, 10)]))).groupBy("threshold").agg(F.avg(F.when(F.col("p") >= F.col("threshold"), 1.0).otherwise(0.0)).alias("coverage"))
    return t.join(per, "threshold")


def spoiled_verdicts(spark, d):
    """Verdicts by how many rules spoil their identifier."""
    rules = F.array(F.when(F.col("l_linenumber") % 2 == 0, "R-DEAD-URL").otherwise("R-X"), F.when(F.col("l_linenumber") % 3 == 0, "R-FAKE-URL").otherwise("R-Y"))
    return table(spark, d, "lineitem").groupBy(scores.rule_hits(rules, scores.SPOILING).alias("spoiling")).agg(F.count("*").alias("n"))


def cached_reports(spark, d):
    """Documents whose report exists already, told by the content's hash, and those to be analysed, once for each content."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    done = docs.where("doc_id % 4 = 0").select("key").distinct().withColumn("cached", F.lit(True))
    return docs.join(done, "key", "left").groupBy(F.coalesce("cached", F.lit(False)).alias("cached")).agg(F.count("*").alias("documents"), F.countDistinct("key").alias("contents"))


def curated_papers(spark, d):
    """Curated rows beside the live paper of the same DOI."""
    live = papers(spark, d)
    seed = live.where("doi is not null").groupBy("doi").agg(F.max("id").alias("seed_id"))
    return seed.join(live.select("doi", "id", "year"), "doi").groupBy("seed_id").agg(F.min("id").alias("id"), F.count("*").alias("live"))


def split_entries(spark, d):
    """Entries that were glued together, apart again."""
    raw = F.concat(F.lit("Smith, J. (2001). One study. Press. Tran, A. (2002). Two studies "), F.col("doc_id").cast("string"), F.lit(". Press."))
    return table(spark, d, "documents").select("doc_id", F.posexplode(context.split_merged(raw)).alias("place", "raw"))


def shelved_sources(spark, d):
    """Papers that are no works: titles without four letters, addresses, test sources."""
    t = F.coalesce(F.col("title"), F.lit(""))
    academic = ~t.rlike(r"^https?://|^www\.") & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 4) & ~F.col("source").rlike("(?i)test")
    return papers(spark, d).groupBy(academic.alias("academic")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        cleaned_contexts, best_segments, venue_names, legal_citations, rendered_entries, unique_citations, verifiable_citations, confident_share, spoiled_verdicts, cached_reports, curated_papers, split_entries, shelved_sources,
    )
}

_C = "SELECT doc_id, {} FROM documents"

_PLAIN_WORDS = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({}), 'ß', 'ss'), '\bet\s+al\b\.?', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"

ORACLE_SQL = {
    "cleaned_contexts": "SELECT doc_id, 'The calibration of pre-trained nets, see Fig. 2, is known [7]. Number ' || doc_id || ' of J. Smith et al. is another one.' AS whole, 2 AS sentences, 'The calibration of pre-trained nets, see Fig. 2, is known [7].' AS focal, 'machine learning is' || chr(10) || chr(10) || 'fine ' || doc_id AS lines FROM documents",
    "best_segments": """WITH s AS (SELECT doc_id, i, substr(text, i * 512 + 1, 512) AS piece FROM documents, range(0, 5) t(i) WHERE i = 0 OR i * 512 < length(text)), n AS (SELECT doc_id, i, length(piece) - length(replace(piece, ' ', '')) AS n FROM s)
        SELECT doc_id, count(*) AS pieces, max(n) AS most, arg_max(i, (n, -i)) AS best FROM n GROUP BY 1""",
    "venue_names": """SELECT doc_id, ['advances in neural information processing systems', 'international conference on machine learning', 'some journal', 'issn:1234-567X', 'advances in neural networks', ''][doc_id % 6 + 1] AS name,
        [1.0, 0.0, 0.0, 0.0, 0.428571, 0.0][doc_id % 6 + 1]::DOUBLE AS likeness FROM documents""",
    "legal_citations": """SELECT doc_id, ['verified', 'superseded', 'mismatch', 'verified', 'mismatch', 'fabricated', 'fabricated', 'fabricated', 'mismatch', 'unverified'][doc_id % 10 + 1] AS label,
        ['91/2015/QH13', '33/2005/QH11', NULL, '13/2023/NĐ-CP', '13/2023/NĐ-CP', '888/2023/QH15', NULL, NULL, '10/2020/NĐ-CP', NULL][doc_id % 10 + 1] AS code, ['', '', 'year', '', 'venue', 'title', 'title', 'year', 'year', ''][doc_id % 10 + 1] AS mismatches FROM documents""",
    "rendered_entries": """SELECT doc_id, '[' || doc_id || '] ' || ['J. K. Smith and A. Lee', 'A. Tran', 'X. NameA et al.'][doc_id % 3 + 1] || ', "Deep study ' || doc_id || '," Venue, ' || (2000 + doc_id % 20) || CASE doc_id % 2 WHEN 0 THEN ', doi: 10.1/' || doc_id || '.' ELSE '. [Online]. Available: https://x.org' END AS ieee,
        ['Smith, John K. and Lee, Ann', 'Tran, A.', 'NameA, X. et al.'][doc_id % 3 + 1] || ' (' || (2000 + doc_id % 20) || '), ''Deep study ' || doc_id || ''', Venue, ' || CASE doc_id % 2 WHEN 0 THEN 'DOI: 10.1/' || doc_id ELSE 'URL: https://x.org' END || '.' AS harvard,
        ['smith', 'tran', 'namea'][doc_id % 3 + 1] || (2000 + doc_id % 20) || 'deep' AS key,
        CASE doc_id % 2 WHEN 0 THEN 'The work was found in ' || doc_id % 4 || ' source(s)' ELSE 'The evidence does not decide' END || ' (title 50 % alike); rule R-X, sure to 79 %.' AS why FROM documents""",
    "unique_citations": rf"""WITH {CITATIONS}, n AS (SELECT *, {_PLAIN_WORDS.format('title')} AS words, {_PLAIN_WORDS.format('raw')} AS whole FROM citations),
        k AS (SELECT doc_id, coalesce('doi:' || regexp_replace(lower(doi), '[\s.,;:)\]}}>]+$', ''), CASE WHEN trim(title) <> '' THEN 'title:' || words || '|' || lower(surname) || '|' || CAST(year AS VARCHAR) END, 'raw:' || whole) AS key FROM n)
        SELECT min(doc_id) AS doc_id, key FROM k GROUP BY key""",
    "verifiable_citations": "SELECT doc_id, ['reference_list', 'in_text', 'numeric', 'doi', 'url'][doc_id % 5 + 1] AS type FROM documents WHERE doc_id % 5 = 0 OR (doc_id % 5 IN (3, 4) AND (doc_id % 7 < 4 OR doc_id % 6 < 4))",
    "confident_share": f"WITH {PREDICTIONS} SELECT t / 10 AS threshold, avg(CASE WHEN p >= t / 10 THEN 1 ELSE 0 END) AS coverage FROM predictions, range(5, 10) r(t) GROUP BY 1",
    "spoiled_verdicts": "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS spoiling, count(*) AS n FROM lineitem GROUP BY 1",
    "cached_reports": "WITH k AS (SELECT text, text IN (SELECT text FROM documents WHERE doc_id % 4 = 0) AS cached FROM documents) SELECT cached, count(*) AS documents, count(DISTINCT text) AS contents FROM k GROUP BY 1",
    "curated_papers": f"WITH {PAPERS} SELECT max(id) AS seed_id, min(id) AS id, count(*) AS live FROM papers WHERE doi IS NOT NULL GROUP BY doi",
    "split_entries": "SELECT doc_id, 0 AS place, 'Smith, J. (2001). One study. Press.' AS raw FROM documents UNION ALL SELECT doc_id, 1, 'Tran, A. (2002). Two studies ' || doc_id || '. Press.' FROM documents",
    "shelved_sources": rf"WITH {PAPERS} SELECT NOT regexp_matches(coalesce(title, ''), '^(https?://|www\.)') AND length(regexp_replace(coalesce(title, ''), '[^\p{{L}}]', '', 'g')) >= 4 AND NOT contains(lower(source), 'test') AS academic, count(*) AS n FROM papers GROUP BY 1",
}
