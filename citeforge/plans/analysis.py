"""Queries over verdicts, links, candidates and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import cosine, jaccard, levenshtein_similarity, numeric_indices, platt, year_distance
from ..operators import evaluation as ev
from ..operators import linking
from ..operators.rules import classify
from ..sources.tables import ESSAYS, PAPERS, PREDICTIONS, VERDICTS, essays, papers, predictions, table, verdicts

_PLATT = (2.162054, 0.629903)


def score_components(spark, d):
    """Share of verified verdicts for each essay; essays without verdicts stay."""
    per = verdicts(spark, d).groupBy("essay_id").agg(F.count("*").alias("n"), F.count_if((F.col("label") == "verified") | F.col("is_overridden")).alias("ok"), F.count_if(F.col("label") == "metadata_error").alias("errors"))
    return essays(spark, d).select("essay_id").join(per, "essay_id", "left").select("essay_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.try_divide("ok", "n"), F.lit(0.0)).alias("verified_ratio"), F.coalesce(1 - F.try_divide("errors", "n"), F.lit(1.0)).alias("metadata_accuracy"))


def class_labels(spark, d):
    """Verdicts of each class by label; an overridden verdict counts as verified."""
    label = F.when(F.col("is_overridden"), "verified").otherwise(F.col("label"))
    v = verdicts(spark, d).groupBy("essay_id", label.alias("label")).agg(F.count("*").alias("n"))
    return v.join(essays(spark, d), "essay_id").groupBy("class_id", "label").agg(F.sum("n").alias("n"), F.countDistinct("user_id").alias("students"))


def pending_reviews(spark, d):
    """Open flagged verdicts of each class, zero where there are none."""
    flagged = verdicts(spark, d).where(~F.col("is_overridden") & F.col("label").isin("suspected_hallucination", "unresolved"))
    e = essays(spark, d)
    per = flagged.join(e, "essay_id").groupBy("class_id").agg(F.count("*").alias("pending"), F.countDistinct("essay_id").alias("essays"))
    return e.select("class_id").distinct().join(per, "class_id", "left").select("class_id", F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("essays", F.lit(0)).alias("essays"))


def brier_score(spark, d):
    return ev.brier(predictions(spark, d))


def calibration_error(spark, d):
    return ev.expected_calibration_error(predictions(spark, d))


def coverage_curve(spark, d):
    return ev.coverage_accuracy(predictions(spark, d))


def class_metrics(spark, d):
    return ev.class_metrics(predictions(spark, d))


def platt_calibration(spark, d):
    return predictions(spark, d).select("id", platt(F.col("p"), *_PLATT).alias("calibrated"))


def _occurrences(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "n_chars")
    each = doc.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    i = F.col("n_chars") % 9 + F.col("pos")
    raw = F.concat(F.lit("["), i.cast("string"), F.lit(", "), (i + 1).cast("string"), F.lit("-"), (i + 3).cast("string"), F.lit("]"))
    return each.select("doc_id", "pos", raw.alias("raw"), F.when(F.col("pos") == 2, F.col("n_chars") % 5).alias("doi"), (F.col("pos") == 3).alias("ibid"))


def _references(spark, d):
    doc = table(spark, d, "documents").select("doc_id")
    return doc.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("order_index")).select("doc_id", "order_index", F.col("order_index").alias("reference_id"), (F.col("order_index") % 6 + 1).alias("numeric_index"), F.when(F.col("order_index") % 2 == 0, F.col("order_index") % 4).cast("long").alias("doi"))


_LINKS = """occ AS (SELECT doc_id, pos, n_chars % 9 + pos AS i, CASE WHEN pos = 2 THEN n_chars % 5 END AS doi, pos = 3 AS ibid FROM documents, range(0, 4) t(pos)),
    refs AS (SELECT doc_id, o AS order_index, o AS reference_id, o % 6 + 1 AS numeric_index, CASE WHEN o % 2 = 0 THEN o % 4 END AS doi FROM documents, range(0, 8) t(o)),
    num AS (SELECT doc_id, pos, min(order_index) AS reference_id FROM occ JOIN refs USING (doc_id) WHERE numeric_index BETWEEN i AND i + 3 GROUP BY doc_id, pos, numeric_index),
    dois AS (SELECT occ.doc_id, pos, max(order_index) AS reference_id FROM occ JOIN refs ON occ.doc_id = refs.doc_id AND occ.doi = refs.doi GROUP BY ALL),
    links AS (SELECT *, 'doi' AS method FROM dois UNION ALL SELECT num.*, 'numeric' AS method FROM num ANTI JOIN dois USING (doc_id, pos))"""


def _cascade(spark, d):
    o, r = _occurrences(spark, d), _references(spark, d)
    return linking.cascade([("doi", linking.by_key(o.where("doi is not null"), r, "doi")), ("numeric", linking.by_number(o, r))])


def link_cascade(spark, d):
    return _cascade(spark, d)


def uncited_references(spark, d):
    return linking.uncited(_references(spark, d), _cascade(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))


def ibid_links(spark, d):
    first = _cascade(spark, d).groupBy("doc_id", "pos").agg(F.min("reference_id").alias("link"))
    return linking.inherit(_occurrences(spark, d).select("doc_id", "pos", "ibid").join(first, ["doc_id", "pos"], "left"), "link", "ibid").select("doc_id", "pos", "link")


def numeric_ranges(spark, d):
    return _occurrences(spark, d).select("doc_id", "pos", F.size(numeric_indices(F.col("raw"))).alias("n"), F.array_max(numeric_indices(F.col("raw"))).cast("long").alias("last"))


def _features(spark, d):
    """Each paper against the next one of its source: what a matcher sees."""
    # ASCII only: the oracle's edit distance counts bytes.
    p = papers(spark, d).withColumn("title", F.regexp_replace(F.lower("title"), "[^a-z0-9]", ""))
    b = p.select((F.col("id") - 1).alias("id"), F.col("title").alias("t2"), F.col("doi").alias("d2"), F.col("authors").alias("a2"), F.col("year").alias("y2"))
    return p.join(b, "id", "left").select(
        "id", F.col("t2").isNotNull().alias("has_candidate"), F.col("doi").isNotNull().alias("has_doi"), F.coalesce(F.col("doi") == F.col("d2"), F.lit(False)).alias("doi_exact_match"),
        F.coalesce(levenshtein_similarity(F.col("title"), F.col("t2")), F.lit(0.0)).alias("title_sim"), F.coalesce(jaccard(F.col("authors"), F.col("a2")), F.lit(0.0)).alias("author_sim"),
        year_distance(F.col("year"), F.col("y2")).alias("year_distance"), (F.col("id") % 4).cast("int").alias("consensus"),
    )


def rule_labels(spark, d):
    return classify(_features(spark, d)).select("id", "title_sim", "label", "confidence", "rule")


def candidate_consensus(spark, d):
    c = papers(spark, d).select(F.col("year").alias("citation_id"), F.col("source").alias("source_name"), F.col("title").alias("fingerprint"), F.lit(True).alias("found"))
    return ev.consensus(c)


def embedding_alignment(spark, d):
    """Cosine of each vector with the first vector of its label, in millionths."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.floor(cosine(F.col("embedding"), F.col("first")) * 1e6 + 0.5).alias("score"))


QUERIES = {f.__name__: f for f in (score_components, class_labels, pending_reviews, brier_score, calibration_error, coverage_curve, class_metrics, platt_calibration, link_cascade, uncited_references, ibid_links, numeric_ranges, rule_labels, candidate_consensus, embedding_alignment)}



def _is(label: str, confidence, rule: str) -> str:
    return f"{{'l': '{label}', 'c': ({confidence})::DOUBLE, 'r': '{rule}'}}"


ORACLE_SQL = {
    "score_components": f"""WITH {ESSAYS}, {VERDICTS}, v AS (SELECT essay_id, count(*) AS n, count_if(label = 'verified' OR is_overridden) AS ok, count_if(label = 'metadata_error') AS errors FROM verdicts GROUP BY 1)
        SELECT essay_id, coalesce(n, 0) AS n, coalesce(ok / n, 0.0) AS verified_ratio, coalesce(1 - errors / n, 1.0) AS metadata_accuracy FROM essays LEFT JOIN v USING (essay_id)""",
    "class_labels": f"WITH {ESSAYS}, {VERDICTS} SELECT class_id, CASE WHEN is_overridden THEN 'verified' ELSE label END AS label, count(*) AS n, count(DISTINCT user_id) AS students FROM verdicts JOIN essays USING (essay_id) GROUP BY ALL",
    "pending_reviews": f"""WITH {ESSAYS}, {VERDICTS}, f AS (SELECT class_id, count(*) AS pending, count(DISTINCT essay_id) AS essays FROM verdicts JOIN essays USING (essay_id)
        WHERE NOT is_overridden AND label IN ('suspected_hallucination', 'unresolved') GROUP BY 1)
        SELECT class_id, coalesce(pending, 0) AS pending, coalesce(f.essays, 0) AS essays FROM (SELECT DISTINCT class_id FROM essays) c LEFT JOIN f USING (class_id)""",
    "brier_score": f"WITH {PREDICTIONS} SELECT avg((p - y) * (p - y)) AS brier, count(*) AS n FROM predictions",
    "calibration_error": f"WITH {PREDICTIONS}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM predictions GROUP BY 1) SELECT sum(n * gap) / sum(n) AS ece FROM b",
    "coverage_curve": f"""WITH {PREDICTIONS}, r AS (SELECT *, row_number() OVER (ORDER BY p DESC, id) AS rank FROM predictions),
        c AS (SELECT coverage, CAST(greatest(1, round_even((SELECT count(*) FROM predictions) * coverage, 0)) AS BIGINT) AS k FROM (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (1.0::DOUBLE)) t(coverage))
        SELECT coverage, k, avg(CASE WHEN y = pred THEN 1 ELSE 0 END) AS accuracy FROM r JOIN c ON rank <= k GROUP BY coverage, k""",
    "class_metrics": f"""WITH {PREDICTIONS}, l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, count_if(y = label) AS support, count_if(pred = label) AS predicted, count_if(y = label AND pred = label) AS hits FROM l, predictions GROUP BY label)
        SELECT label, support, coalesce(hits / nullif(predicted, 0), 0.0) AS precision_, coalesce(hits / nullif(support, 0), 0.0) AS recall_, coalesce(2 * hits / nullif(support + predicted, 0), 0.0) AS f1 FROM c""",
    "platt_calibration": f"WITH {PREDICTIONS} SELECT id, CASE WHEN p <= 0 THEN 0.0 ELSE least(greatest(1 / (1 + exp(-({_PLATT[0]}::DOUBLE * ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) + {_PLATT[1]}::DOUBLE))), 0.01), 0.99) END AS calibrated FROM predictions",
    "link_cascade": f"WITH {_LINKS} SELECT DISTINCT doc_id, pos, reference_id, method FROM links",
    "uncited_references": f"WITH {_LINKS} SELECT doc_id, count(*) AS n FROM refs ANTI JOIN links USING (doc_id, reference_id) GROUP BY doc_id",
    "ibid_links": f"""WITH {_LINKS}, f AS (SELECT doc_id, pos, min(reference_id) AS link FROM links GROUP BY ALL), o AS (SELECT occ.doc_id, occ.pos, ibid, link FROM occ LEFT JOIN f ON f.doc_id = occ.doc_id AND f.pos = occ.pos)
        SELECT doc_id, pos, CASE WHEN ibid THEN last_value(link IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE link END AS link FROM o""",
    "numeric_ranges": "SELECT doc_id, pos, 4 AS n, n_chars % 9 + pos + 3 AS last FROM documents, range(0, 4) t(pos)",
    "rule_labels": f"""WITH {PAPERS}, q AS (SELECT * REPLACE (regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title) FROM papers), f AS (SELECT p.id, b.title IS NOT NULL AS has_candidate, p.doi IS NOT NULL AS has_doi, coalesce(p.doi = b.doi, false) AS doi_exact_match,
            coalesce(CASE WHEN greatest(length(p.title), length(b.title)) > 0 THEN 1 - levenshtein(p.title, b.title) / greatest(length(p.title), length(b.title)) ELSE 0.0 END, 0.0) AS title_sim,
            coalesce(len(list_intersect(p.authors, b.authors)) / len(list_distinct(list_concat(p.authors, b.authors))), 0.0) AS author_sim,
            coalesce(abs(p.year - b.year), 999) AS year_distance, p.id % 4 AS consensus FROM q p LEFT JOIN q b ON b.id = p.id + 1),
        d AS (SELECT id, title_sim, CASE WHEN NOT has_candidate THEN {_is('unresolved', 0.5, 'R-NO-CANDIDATE')}
            WHEN doi_exact_match AND title_sim >= 0.9 AND author_sim >= 0.5 AND (year_distance <= 1 OR year_distance >= 900) THEN {_is('verified', 'least(0.95, 0.7 + 0.2 * title_sim + 0.1 * author_sim)', 'R-DOI-TITLE-AUTHOR')}
            WHEN doi_exact_match AND title_sim BETWEEN 0.6 AND 0.8999999999999999 THEN {_is('metadata_error', 0.7, 'R-DOI-TITLE-MISMATCH')}
            WHEN consensus > 1 AND title_sim >= 0.9 THEN CASE WHEN author_sim < 0.5 OR year_distance > 1 THEN {_is('metadata_error', 0.65, 'R-CONSENSUS-PARTIAL')} ELSE {_is('verified', 0.8, 'R-CONSENSUS-FULL')} END
            WHEN title_sim >= 0.9 AND year_distance > 1 THEN {_is('metadata_error', 0.68, 'R-SINGLE-SOURCE-PARTIAL')} WHEN title_sim >= 0.9 AND author_sim >= 0.8 THEN {_is('verified', 0.78, 'R-SINGLE-SOURCE-VERIFIED')}
            WHEN has_doi AND NOT doi_exact_match AND consensus = 0 AND title_sim < 0.6 THEN {_is('suspected_hallucination', 0.85, 'R-NONEXISTENT-DOI')}
            WHEN title_sim >= 0.4 AND title_sim <= 0.6 THEN {_is('unresolved', 'title_sim', 'R-ABSTENTION-BORDER')}
            WHEN doi_exact_match AND consensus > 1 AND title_sim < 0.6 THEN {_is('metadata_error', 0.5, 'R-DOMAIN-EXCEPTION')}
            WHEN title_sim < 0.4 AND author_sim < 0.3 THEN {_is('suspected_hallucination', 'least(0.95, greatest(0.05, 0.85 - 0.5 * title_sim))', 'R-HALLUCINATED-SOURCE')}
            ELSE {_is('unresolved', 0.4, 'R-WEAK-EVIDENCE')} END AS s FROM f)
        SELECT id, title_sim, s.l AS label, s.c AS confidence, s.r AS rule FROM d""",
    "candidate_consensus": f"""WITH {PAPERS}, s AS (SELECT year AS citation_id, title AS fingerprint, count(DISTINCT source) AS n FROM papers GROUP BY ALL)
        SELECT citation_id, n AS consensus, fingerprint FROM s QUALIFY row_number() OVER (PARTITION BY citation_id ORDER BY n DESC, fingerprint) = 1""",
    "embedding_alignment": """WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label)
        SELECT vec_id, CAST(floor(least(greatest(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(first AS DOUBLE[])), 0), 1) * 1e6 + 0.5) AS BIGINT) AS score FROM embeddings JOIN f USING (label)""",
}
