"""Queries over candidates, papers, scores and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.alignment import alignment, argmax, feature_vector, intent, logits, stance
from ..functions.ordering import legal_rank, order_violations
from ..operators import fusion, routing, scores, search
from ..operators import catalog_more as more
from ..operators.duplicates import similar_references
from ..sources.citations import CITATIONS, citations
from ..sources.tables import ESSAYS, LOG, PAPERS, VERDICTS, essays, papers, query_log, table, verdicts

_STATUS = "CASE (essay_id + line) % 9 WHEN 0 THEN 'missing_reference' WHEN 1 THEN 'uncited_reference' WHEN 2 THEN 'in_text_mismatch' WHEN 3 THEN 'duplicate_reference' WHEN 4 THEN 'ambiguous_mapping' ELSE 'matched' END"
_RULE = "CASE line % 4 WHEN 0 THEN 'R-DEAD-URL' WHEN 1 THEN 'R-WELL-LINKED' WHEN 2 THEN 'R-FAKE-URL' ELSE 'R-NO-CANDIDATE' END"


def integrity_scores(spark, d):
    """The score of each essay and its components, from verdicts, links of even essays, and a style."""
    v = verdicts(spark, d).selectExpr("essay_id AS doc_id", "line", "label", f"{_STATUS} AS status", "line % 3 > 0 AS has_id", f"array({_RULE}) AS rules", "CASE WHEN line = 6 THEN 'dead_link' END AS url_status", "false AS exception")
    links = v.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("line") % 2 == 0, "missing_reference").otherwise("matched").alias("status"))
    both = scores.components(v).join(scores.link_consistency(links, v), "doc_id")
    style = F.when(F.col("doc_id") % 4 == 0, "MIXED").when(F.col("doc_id") % 4 == 1, "APA-like").when(F.col("doc_id") % 4 == 2, "UNKNOWN")
    styled = both.withColumn("format_consistency", scores.format_consistency(style, (F.col("doc_id") % 10) / 10.0, F.col("doc_id") % 3, F.col("n")))
    return styled.select("doc_id", "n", "verified_ratio", "metadata_accuracy", "link_consistency", "format_consistency", "identifier_validity", scores.integrity_score(styled).alias("score"))


def rescored_essays(spark, d):
    """Scores after teachers' overrides."""
    v = verdicts(spark, d).selectExpr("essay_id AS doc_id", "label", "is_overridden")
    stored = essays(spark, d).select(F.col("essay_id").alias("doc_id"), F.when(F.col("essay_id") % 3 > 0, 0.5).alias("link_consistency"), F.lit(0.8).alias("format_consistency"), F.lit(None).cast("double").alias("identifier_validity"))
    return scores.rescored(stored, v)


def near_duplicate_references(spark, d):
    """Groups of similar references among eight of each document: authors alternate, titles share 10, 9 or fewer words."""
    o = F.col("order_index")
    word = lambda i: (F.when(o == 4, i + 1).when(o == 6, i + 5).when(o == 3, i + 2).otherwise(i)).cast("string")
    refs = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("order_index")).select("doc_id", o.alias("reference_id"), "order_index", F.array(F.when(o % 2 == 0, "Smith, J.").otherwise("SMITHS, K.")).alias("authors"), F.lit(None).cast("string").alias("raw"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), word), " ").alias("title"), F.when(o == 7, 1999).otherwise(2001).alias("year"))
    return similar_references(refs)


def paper_matches(spark, d):
    """The paper that each citation means: citations are papers with fields left out or changed."""
    p = papers(spark, d).withColumn("arxiv_id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("arXiv:2101."), F.lpad(F.col("id").cast("string"), 5, "0"))))
    c = p.select(F.col("id").alias("citation_id"), F.when(F.col("id") % 3 == 0, F.upper("doi")).alias("doi"), F.when(F.col("id") % 5 == 0, F.concat("arxiv_id", F.lit("v2"))).alias("arxiv_id"), F.upper("title").alias("title"), "authors", (F.col("year") + F.col("id") % 3).alias("year"))
    return search.match_papers(c, p)


def retrieval_plan(spark, d):
    """Registries for each citation, by what its text says."""
    c = citations(spark, d)
    flagged = c.withColumn("s", routing.signals(F.col("title"), F.col("venue"), F.col("raw"), F.col("url"), F.col("doi")))
    return routing.plan(flagged).select("doc_id", F.array_join("first", " ").alias("first"), F.array_join("second", " ").alias("second"))


def claim_alignment(spark, d):
    """Intent, stance and alignment of a sentence of each document with made-up similarities."""
    c = citations(spark, d)
    tail = F.when(F.col("doc_id") % 4 == 0, " we use this framework").when(F.col("doc_id") % 4 == 1, " accuracy compared with others").when(F.col("doc_id") % 4 == 2, " it does not work").otherwise(" and so on")
    evidence = F.when(F.col("doc_id") % 3 == 0, "we show it is effective").when(F.col("doc_id") % 3 == 1, "it cannot be").otherwise("")
    sim = lambda k, n: (F.col("doc_id") * k % n) / float(n)
    sentence = F.concat(F.lit("item"), tail)
    a = alignment(sim(37, 101), sim(53, 97), sim(29, 89), F.when(F.col("doc_id") % 2 == 0, sim(31, 83)).otherwise(0.0))
    return c.select("doc_id", intent(sentence, sim(7, 50) / 5, sim(11, 50) / 5, sim(13, 50) / 5).alias("intent"), stance(sentence, evidence, sim(37, 101), evidence, F.lit(False)).alias("stance"), a.alias("a")).select("doc_id", "intent", "stance", F.round("a.score", 9).alias("score"), F.col("a.level").alias("level"), F.col("a.aligned").alias("aligned"))


_LABELS = ["verified", "metadata_error", "suspected_hallucination", "unresolved"]
_WEIGHTS = [[2, 1, 3, 2, 1, 2, 1, 0.5, 1, 1, 1, 1, -1, -1, -1, -1], [1, 1, 1, 0, 0, 0.5, 0, 0, -1, 1, 0, 0, 2, 2, 2, 0], [-2, -1, -3, -2, 0, -1, -1, 0, 0, -1, 0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 0, 0, 0, 0, -1, 0, 0, 0, 0, 0, 3]]
_BIAS = [-3, 0, 2, 0.5]


def calibrated_labels(spark, d):
    """Feature vectors and the label of the largest probability."""
    i = F.col("doc_id")
    f = feature_vector((i * 37 % 101) / 100.0, (i * 53 % 101) / 100.0, (i * 29 % 11) / 10.0, F.when(i % 9 > 0, i % 5), i % 6 == 1, i % 7, (i % 4) / 4.0, (i * 17 % 21) / 20.0, F.when(i % 3 == 0, "high").otherwise("low"), i % 2 == 0)
    p = table(spark, d, "documents").select("doc_id", f.alias("f"))
    return p.select("doc_id", F.round(F.aggregate("f", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), argmax(logits(F.col("f"), _WEIGHTS, _BIAS), _LABELS).alias("label"))


# Reference labels in the order of Vietnamese collation.
_NAMES = ["An", "Anh", "Ánh", "Ăn", "Bình", "Dung", "Đăng", "Em", "Nam", "Xuân"]


def list_order_violations(spark, d):
    """References out of order, in lists of six."""
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), ((F.col("doc_id") * 7 + F.col("order_index") * 3) % 10 + 1).cast("int"))
    group = F.when((F.col("doc_id") + F.col("order_index")) % 5 == 0, "legal").when(F.col("order_index") < 3, "vi").otherwise("foreign")
    title = F.when(F.col("order_index") % 3 == 0, "Hiến pháp 2013").when(F.col("order_index") % 3 == 1, "Luật Giáo dục").otherwise("Thông tư 1")
    refs = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("order_index")).select("doc_id", "order_index", group.alias("group"), legal_rank(title).alias("rank"), name.alias("label"))
    return order_violations(refs)


_CAND = [
    "id AS citation_id", "seq", "CASE seq WHEN 0 THEN 'registry' WHEN 1 THEN 'index' ELSE 'local' END AS source_name", "(id + seq) % 11 <> 0 AS found", "CASE WHEN (id + seq) % 3 > 0 THEN doi END AS doi",
    "CASE WHEN id % 5 = seq THEN 'another title of a work' ELSE title END AS title", "CASE WHEN id % 7 <> seq THEN year END AS year", "((id * 31 + seq * 17) % 100) / 1e2 AS confidence", "CAST(seq % 2 + 1 AS BIGINT) AS merged", "CAST(id % 5 AS BIGINT) AS queried",
]


def _candidates(spark, d):
    return papers(spark, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq")).selectExpr(*_CAND)


def candidate_works(spark, d):
    """Candidates fused by work, with the sources that agree."""
    return fusion.fuse_works(_candidates(spark, d), ["doi", "title", "year"])


def weighted_consensus(spark, d):
    return fusion.consensus(_candidates(spark, d))


def candidate_quality(spark, d):
    """Candidates of each reason to leave them out."""
    title = F.when(F.col("id") % 6 == 0, "2020").when(F.col("id") % 6 == 1, "Proverbs").when(F.col("id") % 6 == 2, "12345 67890 1").otherwise(F.col("title"))
    doi = F.when(F.col("id") % 4 == 0, "10.9999/X").otherwise(F.col("doi"))
    authors = F.when(F.col("id") % 5 > 0, F.col("authors"))
    flags = fusion.quality_flags(title, authors, doi, F.lit(False))
    return papers(spark, d).select("id", *[v.alias(k) for k, v in flags.items()])


def paper_lookup(spark, d):
    """Papers by DOI, however it is written."""
    p = papers(spark, d).withColumn("arxiv_id", F.lit(None).cast("string"))
    asked = p.where("doi is not null").select(F.col("id").alias("query_id"), F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), "arxiv_id")
    return more.lookup(p, asked)


def upsert_by_doi(spark, d):
    """The catalogue after changes that meet it by DOI, or by title and year."""
    p = papers(spark, d).select("id", "doi", "title", "authors", "year", F.lit("venue").alias("venue"), F.lit("").alias("abstract"), F.when(F.col("id") % 4 == 0, "acl").otherwise("crossref").alias("source"))
    changes = p.select((F.col("id") + 1_000_000).alias("id"), F.upper("doi").alias("doi"), F.when(F.col("doi").isNull(), F.col("title")).alias("title"), "authors", "year", F.lit("").alias("venue"), F.concat(F.lit("abstract "), "id").alias("abstract"), F.when(F.col("id") % 3 == 0, "local_db").otherwise("openalex").alias("source"))
    return more.upsert_papers(p, changes).select("id", "doi", "title", "year", "venue", "abstract", "source")


def orphan_log(spark, d):
    """Log rows whose paper is gone."""
    return more.orphans(query_log(spark, d).select("id", "paper_id"), "paper_id", papers(spark, d).where("year <> 2001"), "id").select("id", "paper_id")


def logged_queries(spark, d):
    q = query_log(spark, d).select("id", (F.col("found") == 1).alias("found"), "source", "paper_id", "queried_at", F.lit("t").alias("title"), F.col("paper_id").alias("year"))
    return more.log_rows(q, ["year", "title"]).select("id", "query_hash", "found", "source")


def merged_citations(spark, d):
    """Citations of list, body and appendix without those that name the same identifier."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    raw = lambda before, k: F.concat(F.lit(before), ((F.col("doc_id") + F.col("pos") * k) % 5).cast("string"))
    part = lambda before, k: docs.select("doc_id", "pos", raw(before, k).alias("raw"), F.lit("apa").alias("style"))
    return more.merge_citations(part("https://doi.org/10.1/", 2), part("10.1/", 1), part("DOI.ORG/10.1/", 3)).groupBy("doc_id", "part").agg(F.count("*").alias("n"))


def reference_contexts(spark, d):
    """Distinct contexts among the first eight of each reference."""
    o = table(spark, d, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos")).select("doc_id", (F.col("pos") % 2).alias("reference_id"), "pos", F.concat(F.lit("Context "), (F.col("pos") % 5).cast("string")).alias("focal"))
    return more.distinct_contexts(o)


QUERIES = {
    f.__name__: f
    for f in (
        integrity_scores, rescored_essays, near_duplicate_references, paper_matches, retrieval_plan, claim_alignment, calibrated_labels, list_order_violations, candidate_works, weighted_consensus,
        candidate_quality, paper_lookup, upsert_by_doi, orphan_log, logged_queries, merged_citations, reference_contexts,
    )
}


def _re(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


_S = {k: f"regexp_matches(t, {_re(v)})" for k, v in routing.SIGNALS.items()}
_TOKENS = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({}), 'ß', 'ss'), '\bet\s+al\b\.?', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 1))"
_PENALTY = "CASE {} WHEN 'missing_reference' THEN 0.2 WHEN 'uncited_reference' THEN 0.1 WHEN 'in_text_mismatch' THEN 0.15 WHEN 'duplicate_reference' THEN 0.1 WHEN 'ambiguous_mapping' THEN 0.05 ELSE 0 END::DOUBLE"

ORACLE_SQL = {
    "integrity_scores": f"""WITH {VERDICTS}, v AS (SELECT *, {_STATUS} AS status, line % 3 > 0 AS has_id FROM verdicts),
        a AS (SELECT essay_id AS doc_id, count(*) AS n, count_if(label = 'verified') / count(*) AS verified_ratio, 1 - count_if(label IN ('metadata_error', 'suspected_hallucination')) / count(*) AS metadata_accuracy,
            coalesce(count_if(has_id AND line % 4 NOT IN (0, 2) AND line <> 6 AND label IN ('verified', 'metadata_error')) / nullif(count_if(has_id), 0), 1.0) AS identifier_validity,
            greatest(0, CASE WHEN essay_id % 2 = 0 THEN 1 - (count_if(line % 2 = 0) * 0.2::DOUBLE + count_if(status IN ('uncited_reference', 'duplicate_reference')) * 0.1::DOUBLE) / (count(*) + count_if(status IN ('uncited_reference', 'duplicate_reference')))
                ELSE 1 - sum({_PENALTY.format('status')}) / count(*) END) AS link_consistency,
            CASE essay_id % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.8 + 0.2 * (essay_id % 10) / 10 WHEN 2 THEN 0.5 ELSE CASE WHEN essay_id % 3 > 0 THEN greatest(0.3, 1 - (essay_id % 3) / count(*)) ELSE 0.8 END END::DOUBLE AS format_consistency FROM v GROUP BY essay_id)
        SELECT *, round(100 * (0.35::DOUBLE * verified_ratio + 0.25::DOUBLE * metadata_accuracy + 0.25::DOUBLE * link_consistency + 0.1::DOUBLE * format_consistency + 0.05::DOUBLE * identifier_validity) + 1e-9, 2) AS score FROM a""",
    "rescored_essays": f"""WITH {ESSAYS}, {VERDICTS}, v AS (SELECT essay_id, CASE WHEN is_overridden THEN 'verified' ELSE label END AS label FROM verdicts),
        a AS (SELECT essay_id, count(*) AS n, count_if(label = 'verified') / count(*) AS r, 1 - count_if(label IN ('metadata_error', 'suspected_hallucination')) / count(*) AS m FROM v GROUP BY 1)
        SELECT essays.essay_id AS doc_id, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN round(100 * (0.35::DOUBLE * r + 0.25::DOUBLE * m + 0.25::DOUBLE * CASE WHEN essays.essay_id % 3 > 0 THEN 0.5 ELSE 1 END + 0.08::DOUBLE + 0.05::DOUBLE) + 1e-9, 2) ELSE 0 END AS score FROM essays LEFT JOIN a USING (essay_id)""",
    "near_duplicate_references": "SELECT doc_id, r AS reference_id, l AS leader_id FROM documents, (VALUES (0, 0), (2, 0), (4, 0), (1, 1), (5, 1)) t(r, l)",
    "paper_matches": f"""WITH {PAPERS}, p AS (SELECT *, CASE WHEN id % 4 = 0 THEN id END AS ax, {_TOKENS.format('title')} AS w FROM papers),
        c AS (SELECT id AS cid, CASE WHEN id % 3 = 0 THEN doi END AS cdoi, CASE WHEN id % 5 = 0 THEN ax END AS cax, w AS cw, authors AS ca, year + id % 3 AS cy FROM p),
        d AS (SELECT cid, min(id) AS id, 'doi' AS method, 0 AS prio FROM c JOIN p ON doi = cdoi GROUP BY cid), a AS (SELECT cid, id, 'arxiv', 1 FROM c JOIN p ON ax = cax),
        f AS (SELECT cid, id, len(list_intersect(w, cw)) AS both_, len(w) AS n, len(cw) AS m, cy - year AS dy, len(list_intersect(w, cw)) / len(list_distinct(list_concat(w, cw))) AS j FROM c JOIN p ON list_has_any(w, cw) AND list_has_any(authors, ca) AND abs(cy - year) <= 3),
        g AS (SELECT *, both_ = m AS whole, both_ >= m - 1 AND m >= 3 AND len(list_intersect((SELECT w FROM p WHERE p.id = f.id), (SELECT cw[2:] FROM c WHERE c.cid = f.cid))) = m - 1 AS tail FROM f),
        h AS (SELECT *, bool_or(whole) OVER (PARTITION BY cid) AS anyone FROM g),
        s AS (SELECT cid, id, dy, round(CASE WHEN whole AND m / n >= 0.6 THEN 0.95 ELSE j END + 0.08::DOUBLE - 0.02::DOUBLE * abs(dy) + 0.08::DOUBLE, 6) AS score, CASE WHEN whole AND m / n >= 0.6 THEN 0.95 ELSE j END AS base FROM h WHERE CASE WHEN anyone THEN whole ELSE tail END),
        z AS (SELECT cid, id, 'fuzzy', 2 FROM (FROM s WHERE base >= 0.85 QUALIFY row_number() OVER (PARTITION BY cid ORDER BY score DESC, id) = 1) WHERE abs(dy) <= 1)
        SELECT cid AS citation_id, id, method FROM (FROM d UNION ALL FROM a UNION ALL FROM z) QUALIFY row_number() OVER (PARTITION BY cid ORDER BY prio, id) = 1""",
    "retrieval_plan": f"""WITH {CITATIONS}, c AS (SELECT *, regexp_replace(concat_ws(' ', title, venue, raw, url), '[^\\x00-\\x7F]', 'z', 'g') AS t, coalesce(lower(doi), '') AS k FROM citations),
        s AS (SELECT doc_id, doi IS NOT NULL AS has, k LIKE '10.48550/arxiv%' AS ad, k LIKE '10.48550/arxiv%' OR regexp_matches(t, '(?i)\\barxiv\\b|\\bcorr\\b') AS arx, regexp_matches(t, '(?i)\\brfc\\s*\\d{{1,5}}\\b') AS rfc, {_S['thesis']} AS thesis, {_S['book']} AS bk, {_S['regional']} AS reg, {_S['biomed']} AS bio, {_S['cs']} AS cs, {_S['periodical']} AS per FROM c),
        f AS (SELECT *, bk AND NOT arx AND NOT thesis AS book FROM s), q AS (SELECT *, per AND NOT book AS peri FROM f)
        SELECT doc_id,
            CASE WHEN rfc THEN 'tech_standard crossref openalex' WHEN ad THEN 'arxiv datacite dblp openalex' WHEN arx THEN 'arxiv dblp openalex' WHEN book THEN 'openlibrary crossref openalex' WHEN thesis THEN 'openaire_hal openalex crossref'
                WHEN bio THEN 'crossref openalex europepmc' WHEN cs THEN 'crossref openalex dblp' WHEN reg THEN 'crossref openalex doaj' ELSE 'crossref openalex' END AS first,
            CASE WHEN rfc THEN 'dblp' WHEN ad THEN 'huggingface' WHEN arx THEN 'datacite huggingface crossref' WHEN book THEN CASE WHEN cs THEN 'dblp' ELSE '' END WHEN thesis THEN 'datacite doaj dblp'
                WHEN bio THEN 'ncbi_biorxiv doaj' || CASE WHEN cs THEN ' dblp arxiv' WHEN NOT has THEN ' openlibrary' ELSE '' END
                WHEN cs THEN 'arxiv datacite openaire_hal' || CASE WHEN NOT has AND NOT peri THEN ' openlibrary' ELSE '' END
                WHEN has THEN 'datacite doaj europepmc dblp' WHEN peri THEN 'doaj dblp arxiv europepmc openaire_hal' ELSE 'doaj openaire_hal dblp arxiv openlibrary europepmc' END AS second FROM q""",
    "claim_alignment": """WITH s AS (SELECT doc_id AS i, (doc_id * 37 % 101) / 101 AS t, (doc_id * 53 % 97) / 97 AS a, (doc_id * 29 % 89) / 89 AS e, CASE WHEN doc_id % 2 = 0 THEN (doc_id * 31 % 83) / 83 ELSE 0 END AS b,
            (doc_id * 7 % 50) / 250 + CASE doc_id % 4 WHEN 0 THEN 0.22 ELSE 0 END::DOUBLE AS m, (doc_id * 11 % 50) / 250 + CASE doc_id % 4 WHEN 1 THEN 0.24 ELSE 0 END::DOUBLE AS r, (doc_id * 13 % 50) / 250 + 0.05::DOUBLE AS g FROM documents),
        w AS (SELECT *, greatest(a, CASE WHEN e > 0 THEN 0.65::DOUBLE * e + 0.35::DOUBLE * a ELSE a END) AS whole, CASE WHEN e > 0 THEN e ELSE greatest(t, a) END AS best FROM s),
        x AS (SELECT *, (0.3::DOUBLE * t + CASE WHEN whole > 0 THEN 0.5::DOUBLE * whole ELSE 0 END + CASE WHEN b > 0 THEN 0.2::DOUBLE * b ELSE 0 END) / (0.3::DOUBLE + CASE WHEN whole > 0 THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN b > 0 THEN 0.2 ELSE 0 END::DOUBLE) AS mean FROM w),
        z AS (SELECT *, CASE WHEN whole >= 0.7 THEN greatest(mean, 0.92::DOUBLE * whole, 0.9::DOUBLE * best) WHEN best >= 0.65 AND whole > 0 THEN greatest(mean, 0.88::DOUBLE * best) ELSE mean END AS score FROM x)
        SELECT i AS doc_id, CASE WHEN m >= r AND m >= g THEN 'methodology' WHEN r >= g THEN 'result_comparison' ELSE 'background' END AS intent,
            CASE WHEN t >= 0.3 AND i % 4 = 2 AND i % 3 = 0 THEN 'contradiction_risk' WHEN t >= 0.5 THEN 'supported' WHEN t >= 0.35 THEN 'partially_supported' WHEN i % 3 < 2 AND t < 0.22 THEN 'contradiction_risk' ELSE 'neutral' END AS stance,
            round(score, 9) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS level, score >= 0.5 AS aligned FROM z""",
    "calibrated_labels": """WITH r AS (SELECT doc_id, (doc_id * 37 % 101) / 100 AS f, (doc_id * 53 % 101) / 100 AS s, (doc_id * 29 % 11) / 10 AS a, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE exp(-0.5::DOUBLE * (doc_id % 5)) END AS y, CASE WHEN doc_id % 6 = 1 THEN 1 ELSE 0 END AS d,
            least(doc_id % 7, 4) / 4 AS n, (doc_id % 4) / 4 AS v, (doc_id * 17 % 21) / 20 AS c, doc_id % 2 = 0 AS ok, doc_id % 3 = 0 AS high FROM documents),
        t AS (SELECT *, greatest(f, s) AS t FROM r),
        x AS (SELECT doc_id, [f, s, t, a, y, d, n, v, CASE WHEN ok AND c >= 0.45 THEN c WHEN high AND NOT ok AND c > 0 AND c < 0.25 THEN -0.6 ELSE 0 END::DOUBLE, CASE WHEN n > 0 OR t > 0 OR d > 0 THEN 1 ELSE 0 END, t * a, t * y,
            CASE WHEN t >= 0.6 THEN t * (1 - a) ELSE 0 END, CASE WHEN t >= 0.6 THEN t * (1 - y) ELSE 0 END, d * (1 - t), CASE WHEN t >= 0.4 AND t < 0.6 AND d = 0 THEN 1 ELSE 0 END]::DOUBLE[] AS x0 FROM t),
        u AS (SELECT doc_id, list_transform(x0, lambda z: round(z, 6)) AS x FROM x),
        z AS (SELECT doc_id, x, list_inner_product(x, [2, 1, 3, 2, 1, 2, 1, 0.5, 1, 1, 1, 1, -1, -1, -1, -1]::DOUBLE[]) - 3 AS z1, list_inner_product(x, [1, 1, 1, 0, 0, 0.5, 0, 0, -1, 1, 0, 0, 2, 2, 2, 0]::DOUBLE[]) AS z2,
            list_inner_product(x, [-2, -1, -3, -2, 0, -1, -1, 0, 0, -1, 0, 0, 0, 0, 1, 0]::DOUBLE[]) + 2 AS z3, list_inner_product(x, [0, 0, 0, 0, 0, 0, 0, 0, 0, -1, 0, 0, 0, 0, 0, 3]::DOUBLE[]) + 0.5::DOUBLE AS z4 FROM u)
        SELECT doc_id, round(list_sum(x), 4) AS total, CASE greatest(z1, z2, z3, z4) WHEN z1 THEN 'verified' WHEN z2 THEN 'metadata_error' WHEN z3 THEN 'suspected_hallucination' ELSE 'unresolved' END AS label FROM z""",
    "list_order_violations": """WITH r AS (SELECT doc_id, o, (doc_id * 7 + o * 3) % 10 AS k, CASE WHEN (doc_id + o) % 5 = 0 THEN 0 WHEN o < 3 THEN 1 ELSE 2 END AS g, o % 3 + 1 AS rank FROM documents, range(0, 6) t(o)),
        w AS (SELECT *, lag(g) OVER (PARTITION BY doc_id ORDER BY o) AS before, row_number() OVER (PARTITION BY doc_id, g ORDER BY o) AS seen, lag(k) OVER (PARTITION BY doc_id, g ORDER BY o) AS kb, lag(rank) OVER (PARTITION BY doc_id, g ORDER BY o) AS rb FROM r)
        SELECT doc_id, o AS order_index, CASE WHEN seen > 1 THEN 'interleaved' ELSE 'section' END AS kind FROM w WHERE before <> g AND (seen > 1 OR g < before) UNION ALL
        SELECT doc_id, o, 'hierarchy' FROM w WHERE g = 0 AND rb > rank UNION ALL SELECT doc_id, o, 'alphabet' FROM w WHERE g > 0 AND kb > k""",
    "candidate_works": f"""WITH {PAPERS}, c AS (SELECT {', '.join(_CAND)} FROM papers, range(0, 3) t(seq)), f AS (SELECT *, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS t FROM c WHERE found),
        k AS (SELECT *, coalesce(lower(doi), nullif(substr(t, 1, 120), ''), 'seq:' || seq) AS a FROM f), l AS (SELECT *, CASE WHEN length(t) >= 6 THEN substr(t, 1, 120) ELSE a END AS b FROM k),
        x AS (SELECT *, least(min(seq) OVER (PARTITION BY citation_id, a), min(seq) OVER (PARTITION BY citation_id, b)) AS r FROM l), y AS (SELECT *, min(r) OVER (PARTITION BY citation_id, a) AS q FROM x), z AS (SELECT *, min(q) OVER (PARTITION BY citation_id, b) AS work FROM y)
        SELECT citation_id, work, count(DISTINCT source_name) AS sources, arg_min(doi, (-confidence, seq)) FILTER (doi IS NOT NULL) AS doi, arg_min(title, (-confidence, seq)) FILTER (title IS NOT NULL) AS title, arg_min(year, (-confidence, seq)) FILTER (year IS NOT NULL) AS year FROM z GROUP BY ALL""",
    "weighted_consensus": f"""WITH {PAPERS}, c AS (SELECT {', '.join(_CAND)} FROM papers, range(0, 3) t(seq)),
        f AS (SELECT citation_id, coalesce(lower(doi), substr(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 1, 120)) AS k, sum(merged) AS n FROM c WHERE found GROUP BY ALL),
        m AS (SELECT citation_id, max(n) AS n FROM f GROUP BY 1)
        SELECT id AS citation_id, coalesce(n, 0)::BIGINT AS consensus, CASE WHEN id % 5 > 0 THEN coalesce(n, 0) / (id % 5) ELSE 0 END AS score, coalesce(n, 0) >= 2 AS strong FROM papers LEFT JOIN m ON citation_id = id""",
    "candidate_quality": f"""WITH {PAPERS}, t AS (SELECT id, CASE id % 6 WHEN 0 THEN '2020' WHEN 1 THEN 'Proverbs' WHEN 2 THEN '12345 67890 1' ELSE title END AS t FROM papers)
        SELECT id, t <> '' AND length(trim(t)) <= 4 AS only_year, t <> '' AND length(trim(t)) < 10 AS short_title, false AS review, id % 5 = 0 AS no_author, id % 4 = 0 AS bad_doi,
            t <> '' AND (length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 3 OR regexp_full_match(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g'), '\\d+')) AS garbage FROM t""",
    "paper_lookup": f"WITH {PAPERS} SELECT id AS query_id, min(id) OVER (PARTITION BY doi) AS id FROM papers WHERE doi IS NOT NULL",
    "upsert_by_doi": rf"""WITH {PAPERS}, p AS (SELECT *, coalesce(doi, trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')) || '|' || year) AS k FROM papers),
        l AS (SELECT k, max(id) AS last, min(id) AS first FROM p GROUP BY 1)
        SELECT p.id, doi, title, year, 'venue' AS venue, CASE WHEN p.id = first THEN 'abstract ' || last ELSE '' END AS abstract,
            CASE WHEN p.id % 4 = 0 THEN 'acl' WHEN p.id = first AND doi IS NOT NULL AND last % 3 > 0 THEN 'openalex' ELSE 'crossref' END AS source FROM p JOIN l USING (k)""",
    "orphan_log": f"WITH {PAPERS}, {LOG} SELECT id, paper_id FROM log WHERE paper_id NOT IN (SELECT id FROM papers WHERE year <> 2001)",
    "logged_queries": f"""WITH {LOG} SELECT id, md5('{{"title":"t","year":' || paper_id || '}}') AS query_hash, found, source FROM log""",
    "merged_citations": """WITH r AS (SELECT doc_id, p, 0 AS o, (doc_id + 2 * p) % 5 AS k FROM documents, range(0, 4) t(p) UNION ALL SELECT doc_id, p, 1, (doc_id + p) % 5 FROM documents, range(0, 4) t(p) UNION ALL SELECT doc_id, p, 2, (doc_id + 3 * p) % 5 FROM documents, range(0, 4) t(p)),
        b AS (FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY o, p) = 1)
        SELECT doc_id, CASE o WHEN 0 THEN 'references' WHEN 1 THEN 'body' ELSE 'appendix' END AS part, count(*) AS n FROM b GROUP BY ALL""",
    "reference_contexts": "SELECT doc_id, p % 2 AS reference_id, p AS pos, 'Context ' || p % 5 AS focal FROM documents, range(0, 10) t(p)",
}
