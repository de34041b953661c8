"""Queries over baselines, candidates, reference lists and class membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ratios import title_ratios
from ..operators import baselines, candidates, linking
from ..operators import evaluation as ev
from ..operators.rules import EVIDENCE_RULES, classify, demote_retracted
from ..sources.tables import ESSAYS, PAPERS, PREDICTIONS, essays, papers, predictions, table
from . import citations
from .analysis import _LINKS, _cascade, _is, _occurrences, _references

# The features, in words that Spark and DuckDB share; all from whole numbers.
_FEATURES = [
    "id", "id % 7 = 0 AS doi_ok", "(id * 37 % 101) / 1e2 AS fuzzy", "(id * 53 % 101) / 1e2 AS semantic", "(id * 29 % 11) / 1e1 AS author", "id % 4 AS years",
    "id * 31 % 4 AS consensus", "id % 3 = 0 AS crossref", "id % 5 = 0 AS cited_doi", "CASE WHEN id % 13 = 0 THEN 'fake_domain' WHEN id % 6 = 0 THEN 'dead_link' ELSE 'ok' END AS url_status",
    "id % 2 = 0 AS aligned", "(id * 17 % 21) / 2e1 AS alignment", "CASE WHEN id % 9 = 0 THEN 'high' ELSE 'low' END AS alignment_level",
]

_CANDIDATES = [
    "id AS citation_id", "seq", "CASE seq WHEN 0 THEN 'registry' WHEN 1 THEN 'index' ELSE 'local' END AS source_name", "(id + seq) % 11 <> 0 AS found",
    "CASE WHEN (id + seq) % 3 > 0 THEN doi END AS doi", "CASE WHEN id % 5 <> seq THEN title END AS title", "CASE WHEN id % 7 <> seq THEN year + id % 2 * seq END AS year",
    "CASE WHEN doi IS NOT NULL AND (id + seq) % 3 > 0 THEN 1 ELSE 0 END AS doi_match", "CASE WHEN id % 5 <> seq THEN 1 ELSE 0 END AS title_sim", "(id % 4) / 4e0 AS author_sim",
    "CASE WHEN id % 2 * seq = 0 THEN 1 ELSE 0 END AS year_match", "((id * 31 + seq * 17) % 100) / 1e2 AS confidence",
]


_EVIDENCE = [
    "id", "id % 8 <> 0 AS has_candidate", "id % 3 <> 0 AS has_doi", "id % 6 = 1 AS doi_exact_match", "(id * 37 % 101) / 1e2 AS title_sim", "(id * 29 % 11) / 1e1 AS author_sim",
    "CASE WHEN id % 17 = 0 THEN 999 ELSE id * 31 % 4 END AS year_distance", "id * 7 % 3 AS consensus", 
    "id % 37 = 3 AS future_year", "CASE id * 11 % 7 WHEN 0 THEN 'dead_link' WHEN 1 THEN 'archived_alive' WHEN 2 THEN 'alive' END AS url_status",
    "id * 13 % 5 AS clean_sources", "id * 5 % 7 AS sources_queried", 
    "CASE id * 19 % 9 WHEN 0 THEN 'tech_standard' WHEN 1 THEN 'wikidata_opencitations' WHEN 2 THEN 'huggingface' END AS best_source", "id % 4 = 1 AS linked", "id % 11 = 5 AS ambiguous", "id % 5 = 2 AS book",
    "(id % 3) * 75 / 1e3 AS style_penalty", "(id % 2) * 5 / 1e2 AS provenance_penalty", "id % 23 = 0 AS retracted",
]


def _candidates(spark, d):
    three = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("seq")
    return papers(spark, d).select("*", three).selectExpr(*_CANDIDATES)


def baseline_labels(spark, d):
    return baselines.label(papers(spark, d).select("id").selectExpr(*_FEATURES)).select("id", *[n.lower() for n in baselines.BASELINES])


def evidence_labels(spark, d):
    """Labels of the whole chain: guards come from the citations' texts, similarities from their ids."""
    guards = citations.citation_guards(spark, d).select(F.col("doc_id").alias("id"), *[F.col(c) for c in ("fake_url", "fabricated_doi", "fake_author", "kind", "known_author", "substantive")])
    got = classify(papers(spark, d).select("id").selectExpr(*_EVIDENCE).join(guards, "id"), EVIDENCE_RULES)
    return demote_retracted(got).select("id", "label", "confidence", "rule")


def best_candidates(spark, d):
    return candidates.best_candidate(_candidates(spark, d))


def fused_metadata(spark, d):
    return candidates.fuse(_candidates(spark, d), ["doi", "title", "year"])


def abstention_threshold(spark, d):
    return ev.abstention_threshold(predictions(spark, d), 0.8)


def cited_counts(spark, d):
    return linking.cited_counts(_references(spark, d), _cascade(spark, d))


def link_summary(spark, d):
    return linking.link_summary(_occurrences(spark, d), _cascade(spark, d), ["doi", "numeric", "title"])


def title_links(spark, d):
    ten = lambda start: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i + start).cast("string"))
    occurrences = table(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).select("doc_id", "pos", ten(F.col("n_chars") % 9 + F.col("pos")).alias("words"))
    return linking.by_title(occurrences, _references(spark, d).withColumn("words", ten(F.col("order_index"))))


def author_year_links(spark, d):
    """Occurrences of two parts, such as "(Tran et al., 2001a; Lee, 2002)", against eight references."""
    names = ["Smith", "Tran", "García", "Okafor", "Lee", "Nobody", "Unknown"]
    name = lambda i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    n, pos = F.col("n_chars"), F.col("pos")
    raw = F.concat(F.lit("("), name((n + pos) % 5), F.lit(" et al., "), (2000 + n % 3).cast("string"), F.element_at(F.array(F.lit(""), F.lit("a"), F.lit("b")), (pos % 3 + 1).cast("int")), F.lit("; "), name((n + 2 * pos + 1) % 7), F.lit(", "), (2000 + (n + 1) % 3).cast("string"), F.lit(")"))
    occurrences = table(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).select("doc_id", "pos", raw.alias("raw"))
    o = F.col("order_index")
    references = _references(spark, d).select("doc_id", "reference_id", "order_index", F.array(F.lower(name(o % 5))).alias("authors"), (2000 + o % 3).alias("year"), F.when(o % 2 == 0, "a").otherwise("b").alias("suffix"))
    return linking.by_author_year(occurrences, references)


def exact_duplicate_references(spark, d):
    arxiv = (F.col("order_index") * (F.col("doc_id") % 5 + 1)) % 3
    return linking.exact_duplicates(_references(spark, d).withColumn("arxiv_id", arxiv))


def class_essay_counts(spark, d):
    """Essays of each class: those handed in to it, and those of its members that name no class."""
    e = essays(spark, d).withColumn("named", F.when(F.col("essay_id") % 3 > 0, F.col("class_id")))
    members = e.select("class_id", "user_id").distinct()
    named = e.where("named is not null").select(F.col("named").alias("class_id"), "essay_id")
    through = e.where("named is null").select("user_id", "essay_id").join(members, "user_id").select("class_id", "essay_id")
    return named.union(through).groupBy("class_id").agg(F.count("*").alias("n"))


def fuzzy_title_ratios(spark, d):
    """Each paper's title against the next paper's; beyond SQL."""
    p = papers(spark, d).select("id", "title")
    return p.join(p.select((F.col("id") - 1).alias("id"), F.col("title").alias("other")), "id").select("id", title_ratios(F.col("title"), F.col("other")).alias("r")).select("id", "r.*")


QUERIES = {f.__name__: f for f in (baseline_labels, evidence_labels, best_candidates, fused_metadata, abstention_threshold, cited_counts, link_summary, title_links, author_year_links, exact_duplicate_references, class_essay_counts, fuzzy_title_ratios)}

_CAND = f"{PAPERS}, cand AS (SELECT {', '.join(_CANDIDATES)} FROM papers, range(0, 3) t(seq)), got AS (SELECT * FROM cand WHERE found)"

ORACLE_SQL = {
    "baseline_labels": f"WITH f AS (SELECT {', '.join(_FEATURES)} FROM (SELECT doc_id AS id FROM documents)) SELECT id, {', '.join(f'{baselines.case(n)} AS {n.lower()}' for n in baselines.BASELINES)} FROM f",
    "evidence_labels": f"""WITH g AS ({citations.ORACLE_SQL['citation_guards']}),
        f AS (SELECT e.*, fake_url, fabricated_doi, fake_author, kind, known_author, style_penalty AS sp, provenance_penalty AS pp,
            NOT has_candidate AND clean_sources >= 2 AND NOT known_author AS gone, year_distance <= 1 OR year_distance >= 900 AS near
            FROM (SELECT {', '.join(_EVIDENCE)} FROM (SELECT doc_id AS id FROM documents)) e JOIN g ON doc_id = id),
        v AS (SELECT id, retracted, CASE
            WHEN fake_url THEN {_is('suspected_hallucination', '0.95', 'R-FAKE-URL')}
            WHEN fabricated_doi THEN {_is('suspected_hallucination', '0.9', 'R-FABRICATED-DOI')}
            WHEN fake_author AND (NOT doi_exact_match OR title_sim < 0.85) THEN {_is('suspected_hallucination', '0.95', 'R-FAKE-AUTHOR')}
            WHEN future_year AND (known_author OR has_candidate AND (doi_exact_match OR title_sim >= 0.85)) THEN {_is('metadata_error', '0.65', 'R-FUTURE-YEAR-KNOWN-AUTHOR')}
            WHEN future_year THEN {_is('suspected_hallucination', '0.95', 'R-FUTURE-YEAR')}
            WHEN NOT has_candidate AND url_status = 'dead_link' AND NOT known_author THEN {_is('suspected_hallucination', 'greatest(0, 0.85 - sp)', 'R-DEAD-URL')}
            WHEN NOT has_candidate AND NOT has_doi AND url_status = 'archived_alive' THEN {_is('resource', '0.9', 'R-WAYBACK-ARCHIVED')}
            WHEN NOT has_candidate AND NOT has_doi AND url_status = 'alive' THEN {_is('resource', '0.95', 'R-URL-RESOURCE')}
            WHEN gone AND has_doi THEN {_is('suspected_hallucination', 'greatest(0, 0.85 - sp)', 'R-NONEXISTENT-DOI')}
            WHEN gone AND kind IN ('web_resource', 'legal_or_standard') THEN {_is('resource', '0.85', 'R-NON-SCHOLARLY-RESOURCE')}
            WHEN gone AND kind IS NOT NULL THEN {_is('unresolved', 'greatest(0, 0.55 - sp)', 'R-UNINDEXED-BOOK-OR-SOURCE')}
            WHEN gone THEN {_is('suspected_hallucination', 'greatest(0, 0.8 - sp)', 'R-NO-SCHOLARLY-RECORD')}
            WHEN NOT has_candidate THEN {_is('unresolved', '0.5', 'R-NO-CANDIDATE')}
            WHEN doi_exact_match AND title_sim >= 0.9 AND author_sim >= 0.5 AND near THEN {_is('verified', 'greatest(0, least(0.95, 0.7 + 0.2 * title_sim + 0.1 * author_sim) - sp - pp)', 'R-DOI-TITLE-AUTHOR')}
            WHEN best_source = 'tech_standard' AND title_sim >= 0.8 AND near THEN {_is('verified', 'greatest(0, 0.92 - sp - pp)', 'R-RFC-VERIFIED')}
            WHEN best_source = 'tech_standard' AND title_sim >= 0.8 THEN {_is('metadata_error', 'greatest(0, 0.75 - sp)', 'R-RFC-VERIFIED')}
            WHEN best_source = 'wikidata_opencitations' AND title_sim >= 0.8 AND near THEN {_is('verified', 'greatest(0, 0.9 - sp - pp)', 'R-WIKIDATA-VERIFIED')}
            WHEN best_source = 'wikidata_opencitations' AND title_sim >= 0.8 THEN {_is('metadata_error', 'greatest(0, 0.75 - sp)', 'R-WIKIDATA-VERIFIED')}
            WHEN best_source = 'huggingface' AND title_sim >= 0.85 AND near THEN {_is('verified', 'greatest(0, 0.9 - sp - pp)', 'R-HF-VERIFIED')}
            WHEN linked AND title_sim >= 0.7 AND author_sim >= 0.3 AND year_distance <= 1 THEN {_is('verified', 'greatest(0, 0.85 - sp - pp)', 'R-WELL-LINKED')}
            WHEN linked AND title_sim >= 0.5 AND title_sim < 0.7 AND author_sim >= 0.3 AND year_distance <= 1 AND (doi_exact_match OR consensus > 1) THEN {_is('verified', 'greatest(0, 0.75 - sp - pp)', 'R-WELL-LINKED-MODERATE')}
            WHEN NOT linked AND doi_exact_match AND title_sim >= 0.6 AND title_sim < 0.9 THEN {_is('metadata_error', '0.7', 'R-DOI-TITLE-MISMATCH')}
            WHEN consensus > 1 AND title_sim >= 0.9 AND author_sim >= 0.5 AND year_distance <= 1 THEN {_is('verified', 'greatest(0, 0.8 - sp - pp)', 'R-CONSENSUS-FULL')}
            WHEN consensus > 1 AND title_sim >= 0.9 THEN {_is('metadata_error', 'greatest(0, 0.65 - sp)', 'R-CONSENSUS-PARTIAL')}
            WHEN title_sim >= 0.9 AND author_sim >= 0.8 AND year_distance <= 1 THEN {_is('verified', '0.78', 'R-SINGLE-SOURCE-VERIFIED')}
            WHEN book AND title_sim >= 0.95 AND author_sim >= 0.9 AND year_distance BETWEEN 2 AND 15 THEN {_is('verified', '0.78', 'R-BOOK-EDITION-VERIFIED')}
            WHEN title_sim >= 0.9 AND year_distance > 1 THEN {_is('metadata_error', '0.68', 'R-SINGLE-SOURCE-PARTIAL')}
            WHEN ambiguous THEN {_is('unresolved', 'least(0.5, title_sim)', 'R-AMBIGUOUS-MAPPING')}
            WHEN has_doi AND NOT doi_exact_match AND title_sim < 0.6 AND consensus = 0 THEN {_is('suspected_hallucination', '0.85', 'R-NONEXISTENT-DOI')}
            WHEN url_status = 'dead_link' AND title_sim < 0.6 THEN {_is('suspected_hallucination', '0.85', 'R-DEAD-URL')}
            WHEN url_status = 'archived_alive' AND NOT has_doi AND title_sim < 0.6 THEN {_is('resource', '0.9', 'R-WAYBACK-ARCHIVED')}
            WHEN url_status = 'alive' AND NOT has_doi AND title_sim < 0.6 THEN {_is('resource', '0.95', 'R-URL-RESOURCE')}
            WHEN title_sim >= 0.4 AND title_sim <= 0.6 AND NOT (author_sim = 0 AND NOT doi_exact_match AND consensus < 2 AND sources_queried > 3) THEN {_is('unresolved', 'greatest(0, title_sim - sp)', 'R-ABSTENTION-BORDER')}
            WHEN doi_exact_match AND title_sim < 0.6 AND consensus > 1 THEN {_is('metadata_error', 'greatest(0, 0.5 - sp)', 'R-DOMAIN-EXCEPTION')}
            WHEN known_author THEN {_is('metadata_error', '0.55', 'R-KNOWN-AUTHOR-WEAK-EVIDENCE')}
            WHEN title_sim < 0.4 AND author_sim < 0.3 THEN {_is('suspected_hallucination', 'least(0.95, greatest(0.05, 0.85 - 0.5 * title_sim))', 'R-HALLUCINATED-SOURCE')}
            ELSE {_is('unresolved', 0.4, 'R-WEAK-EVIDENCE')} END AS s FROM f)
        SELECT id, CASE WHEN retracted AND s.l IN ('verified', 'unresolved') THEN 'metadata_error' ELSE s.l END AS label, s.c AS confidence, s.r AS rule FROM v""",
    "best_candidates": f"""WITH {_CAND}, s AS (SELECT *, 2 * doi_match::DOUBLE + title_sim::DOUBLE + 0.5::DOUBLE * author_sim + 0.2::DOUBLE * year_match::DOUBLE + 0.05::DOUBLE * confidence AS score FROM got)
        SELECT citation_id, seq, source_name, score FROM s QUALIFY row_number() OVER (PARTITION BY citation_id ORDER BY score DESC, seq) = 1""",
    "fused_metadata": f"WITH {_CAND} SELECT citation_id, arg_min(doi, seq) FILTER (doi IS NOT NULL) AS doi, arg_min(title, seq) FILTER (title IS NOT NULL) AS title, arg_min(year, seq) FILTER (year IS NOT NULL) AS year, count(*) AS n FROM got GROUP BY 1",
    "abstention_threshold": f"""WITH {PREDICTIONS}, r AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS k, count(*) OVER () AS n FROM predictions),
        t AS (SELECT p AS threshold FROM r WHERE k = greatest(1, round_even(n * 0.8::DOUBLE, 0)))
        SELECT threshold, (SELECT count(*) FROM predictions WHERE p >= threshold) / (SELECT count(*) FROM predictions) AS coverage FROM t""",
    "cited_counts": f"""WITH {_LINKS}, c AS (SELECT doc_id, reference_id, count(DISTINCT pos) AS n, string_agg(DISTINCT pos::VARCHAR, ',' ORDER BY pos::VARCHAR) AS places FROM links GROUP BY ALL)
        SELECT r.doc_id, r.reference_id, coalesce(n, 0) AS n, coalesce(places, '') AS places FROM refs r LEFT JOIN c ON c.doc_id = r.doc_id AND c.reference_id = r.reference_id""",
    "link_summary": f"""WITH {_LINKS}, o AS (SELECT occ.doc_id, occ.pos, coalesce(min(method), 'missing') AS method FROM occ LEFT JOIN links ON links.doc_id = occ.doc_id AND links.pos = occ.pos GROUP BY ALL)
        SELECT m.method, count(o.method) AS n FROM (VALUES ('doi'), ('numeric'), ('title'), ('missing')) m(method) LEFT JOIN o ON o.method = m.method GROUP BY 1""",
    "title_links": """WITH s AS (SELECT doc_id, pos, o AS reference_id, 10 - abs(n_chars % 9 + pos - o) AS b FROM documents, range(0, 4) t(pos), range(0, 8) u(o))
        SELECT doc_id, pos, reference_id, b / (20 - b) AS score FROM s WHERE b > 0 AND b / (20 - b) >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY b DESC, reference_id) = 1""",
    "author_year_links": """WITH p AS (SELECT doc_id, pos, 0 AS part, (n_chars + pos) % 5 AS a, n_chars % 3 AS y, pos % 3 AS s FROM documents, range(0, 4) t(pos)
            UNION ALL SELECT doc_id, pos, 1, (n_chars + 2 * pos + 1) % 7, (n_chars + 1) % 3, 0 FROM documents, range(0, 4) t(pos)),
        r AS (SELECT o, o % 5 AS a, o % 3 AS y, o % 2 + 1 AS s FROM range(0, 8) t(o)), x AS (SELECT a, y, s, min(o) AS o FROM r GROUP BY ALL), l AS (SELECT a, y, min(o) AS o FROM r GROUP BY ALL),
        m AS (SELECT doc_id, pos, part, coalesce(x.o, l.o) AS reference_id FROM p LEFT JOIN x ON x.a = p.a AND x.y = p.y AND x.s = p.s LEFT JOIN l ON l.a = p.a AND l.y = p.y)
        SELECT *, CASE WHEN reference_id IS NULL THEN 'missing_reference' ELSE 'matched' END AS status FROM m QUALIFY count(reference_id) OVER (PARTITION BY doc_id, pos) > 0""",
    "exact_duplicate_references": """WITH r AS (SELECT doc_id, o, CASE WHEN o % 2 = 0 THEN o % 4 END AS doi, o * (doc_id % 5 + 1) % 3 AS arxiv FROM documents, range(0, 8) t(o)),
        g AS (SELECT doc_id, 'doi' AS kind, doi AS key, count(*) AS n, min(o) AS representative FROM r WHERE doi IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
        x AS (SELECT r.* FROM r WHERE NOT EXISTS (FROM g WHERE g.doc_id = r.doc_id AND g.key = r.doi))
        SELECT doc_id, kind, key::VARCHAR AS key, n, representative FROM g UNION ALL
        SELECT doc_id, 'arxiv', arxiv::VARCHAR, count(*), min(o) FROM x GROUP BY ALL HAVING count(*) > 1""",
    "class_essay_counts": f"""WITH {ESSAYS}, e AS (SELECT *, CASE WHEN essay_id % 3 > 0 THEN class_id END AS named FROM essays), m AS (SELECT DISTINCT class_id, user_id FROM e),
        a AS (SELECT named AS class_id, essay_id FROM e WHERE named IS NOT NULL UNION ALL SELECT m.class_id, essay_id FROM e JOIN m USING (user_id) WHERE named IS NULL)
        SELECT class_id, count(*) AS n FROM a GROUP BY 1""",
}
