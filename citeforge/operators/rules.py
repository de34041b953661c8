"""Ordered rules as one CASE expression over feature columns; the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule id, condition, label, base confidence, in the order of evaluation.
RULES: tuple[tuple[str, str, str, str], ...] = (
    ("R-NO-CANDIDATE", "not has_candidate", "unresolved", "0.5"),
    ("R-DOI-TITLE-AUTHOR", "doi_exact_match and title_sim >= 0.9 and author_sim >= 0.5 and (year_distance <= 1 or year_distance >= 900)", "verified", "least(0.95, 0.7 + 0.2 * title_sim + 0.1 * author_sim)"),
    ("R-DOI-TITLE-MISMATCH", "doi_exact_match and title_sim >= 0.6 and title_sim < 0.9", "metadata_error", "0.7"),
    ("R-CONSENSUS-FULL", "consensus >= 2 and title_sim >= 0.9 and author_sim >= 0.5 and year_distance <= 1", "verified", "0.8"),
    ("R-CONSENSUS-PARTIAL", "consensus >= 2 and title_sim >= 0.9", "metadata_error", "0.65"),
    ("R-SINGLE-SOURCE-VERIFIED", "title_sim >= 0.9 and author_sim >= 0.8 and year_distance <= 1", "verified", "0.78"),
    ("R-SINGLE-SOURCE-PARTIAL", "title_sim >= 0.9 and year_distance > 1", "metadata_error", "0.68"),
    ("R-NONEXISTENT-DOI", "has_doi and not doi_exact_match and title_sim < 0.6 and consensus = 0", "suspected_hallucination", "0.85"),
    ("R-ABSTENTION-BORDER", "title_sim between 0.4 and 0.6", "unresolved", "title_sim"),
    ("R-DOMAIN-EXCEPTION", "doi_exact_match and title_sim < 0.6 and consensus >= 2", "metadata_error", "0.5"),
    ("R-HALLUCINATED-SOURCE", "title_sim < 0.4 and author_sim < 0.3", "suspected_hallucination", "least(0.95, greatest(0.05, 0.85 - 0.5 * title_sim))"),
)
DEFAULT = ("R-WEAK-EVIDENCE", "unresolved", "0.4")


_SURE_YEAR = "(year_distance <= 1 or year_distance >= 900)"
_NOT_FOUND = "not has_candidate and substantive and clean_sources >= 2 and not known_author"
# Four registries or more were asked and nothing but a similar meaning was found.
_NOISE = "(title_sim < 0.65 and author_sim = 0 and not doi_exact_match and consensus <= 1 and sources_queried >= 4)"
_STYLE, _BOTH = "- style_penalty", "- style_penalty - provenance_penalty"


def _own(rule: str) -> tuple[str, str, str, str]:
    return next(r for r in RULES if r[0] == rule)


# The chain with guards, resource and specialist rules. Besides the columns above it reads fake_url,
# fabricated_doi, fake_author, future_year, known_author, url_status, clean_sources (registries that answered "none"), sources_queried,
# substantive, kind (of a source that no registry indexes), best_source, linked, ambiguous, book, style_penalty and
# provenance_penalty. Conditions that may be null stand for false.
EVIDENCE_RULES: tuple[tuple[str, str, str, str], ...] = (
    ("R-FAKE-URL", "fake_url", "suspected_hallucination", "0.95"),
    ("R-FABRICATED-DOI", "fabricated_doi", "suspected_hallucination", "0.9"),
    ("R-FAKE-AUTHOR", "fake_author and not (doi_exact_match and title_sim >= 0.85)", "suspected_hallucination", "0.95"),
    ("R-FUTURE-YEAR-KNOWN-AUTHOR", "future_year and (known_author or (has_candidate and (doi_exact_match or title_sim >= 0.85)))", "metadata_error", "0.65"),
    ("R-FUTURE-YEAR", "future_year", "suspected_hallucination", "0.95"),
    ("R-DEAD-URL", "not has_candidate and url_status = 'dead_link' and not known_author", "suspected_hallucination", f"greatest(0, 0.85 {_STYLE})"),
    ("R-WAYBACK-ARCHIVED", "not has_candidate and not has_doi and url_status = 'archived_alive'", "resource", "0.9"),
    ("R-URL-RESOURCE", "not has_candidate and not has_doi and url_status in ('alive', 'restricted_alive')", "resource", "0.95"),
    ("R-NONEXISTENT-DOI", f"{_NOT_FOUND} and has_doi", "suspected_hallucination", f"greatest(0, 0.85 {_STYLE})"),
    ("R-NON-SCHOLARLY-RESOURCE", f"{_NOT_FOUND} and kind in ('web_resource', 'legal_or_standard')", "resource", "0.85"),
    ("R-UNINDEXED-BOOK-OR-SOURCE", f"{_NOT_FOUND} and kind is not null", "unresolved", f"greatest(0, 0.55 {_STYLE})"),
    ("R-NO-SCHOLARLY-RECORD", _NOT_FOUND, "suspected_hallucination", f"greatest(0, 0.8 {_STYLE})"),
    _own("R-NO-CANDIDATE"),
    ("R-DOI-TITLE-AUTHOR", _own("R-DOI-TITLE-AUTHOR")[1], "verified", f"greatest(0, least(0.95, 0.7 + 0.2 * title_sim + 0.1 * author_sim) {_BOTH})"),
    ("R-RFC-VERIFIED", f"best_source = 'tech_standard' and title_sim >= 0.8 and {_SURE_YEAR}", "verified", f"greatest(0, 0.92 {_BOTH})"),
    ("R-RFC-VERIFIED", "best_source = 'tech_standard' and title_sim >= 0.8", "metadata_error", f"greatest(0, 0.75 {_STYLE})"),
    ("R-WIKIDATA-VERIFIED", f"best_source = 'wikidata_opencitations' and title_sim >= 0.8 and {_SURE_YEAR}", "verified", f"greatest(0, 0.9 {_BOTH})"),
    ("R-WIKIDATA-VERIFIED", "best_source = 'wikidata_opencitations' and title_sim >= 0.8", "metadata_error", f"greatest(0, 0.75 {_STYLE})"),
    ("R-HF-VERIFIED", f"best_source = 'huggingface' and title_sim >= 0.85 and {_SURE_YEAR}", "verified", f"greatest(0, 0.9 {_BOTH})"),
    ("R-WELL-LINKED", "linked and title_sim >= 0.7 and author_sim >= 0.3 and year_distance <= 1", "verified", f"greatest(0, 0.85 {_BOTH})"),
    ("R-WELL-LINKED-MODERATE", "linked and title_sim >= 0.5 and title_sim < 0.7 and author_sim >= 0.3 and year_distance <= 1 and (doi_exact_match or consensus >= 2)", "verified", f"greatest(0, 0.75 {_BOTH})"),
    ("R-DOI-TITLE-MISMATCH", "not linked and " + _own("R-DOI-TITLE-MISMATCH")[1], "metadata_error", "0.7"),
    ("R-CONSENSUS-FULL", _own("R-CONSENSUS-FULL")[1], "verified", f"greatest(0, 0.8 {_BOTH})"),
    ("R-CONSENSUS-PARTIAL", _own("R-CONSENSUS-PARTIAL")[1], "metadata_error", f"greatest(0, 0.65 {_STYLE})"),
    _own("R-SINGLE-SOURCE-VERIFIED"),
    ("R-BOOK-EDITION-VERIFIED", "book and title_sim >= 0.95 and author_sim >= 0.9 and year_distance > 1 and year_distance <= 15", "verified", "0.78"),
    _own("R-SINGLE-SOURCE-PARTIAL"),
    ("R-AMBIGUOUS-MAPPING", "ambiguous", "unresolved", "least(0.5, title_sim)"),
    ("R-NONEXISTENT-DOI", _own("R-NONEXISTENT-DOI")[1], "suspected_hallucination", "0.85"),
    ("R-DEAD-URL", "url_status = 'dead_link' and title_sim < 0.6", "suspected_hallucination", "0.85"),
    ("R-WAYBACK-ARCHIVED", "url_status = 'archived_alive' and not has_doi and title_sim < 0.6", "resource", "0.9"),
    ("R-URL-RESOURCE", "url_status in ('alive', 'restricted_alive') and not has_doi and title_sim < 0.6", "resource", "0.95"),
    ("R-ABSTENTION-BORDER", f"title_sim between 0.4 and 0.6 and not {_NOISE}", "unresolved", f"greatest(0, title_sim {_STYLE})"),
    ("R-DOMAIN-EXCEPTION", _own("R-DOMAIN-EXCEPTION")[1], "metadata_error", f"greatest(0, 0.5 {_STYLE})"),
    ("R-KNOWN-AUTHOR-WEAK-EVIDENCE", "known_author", "metadata_error", "0.55"),
    _own("R-HALLUCINATED-SOURCE"),
)


_NEAR = "year_distance <= 1"
_ALIAS = "(doi_exact_match or arxiv_alias)"
_STRONG = f"((title_fuzzy >= 0.9 and (doi_exact_match or author_sim >= 0.35 or {_NEAR})) or (doi_exact_match and title_fuzzy >= 0.35) or (author_sim >= 0.8 and {_NEAR} and title_fuzzy >= 0.55 and title_fuzzy < 0.9))"
_ODD = "(title_fuzzy < 0.9 or author_sim < 0.5 or (year_distance > 1 and year_distance < 900) or (both_dois and not doi_exact_match))"
_CONTENT = "content_score > 0 and not missing_reference"
# Rules that look at the record found, each with the rule of EVIDENCE_RULES that it goes before. Besides those
# columns they read title_fuzzy (title_sim is the greater of it and the semantic one), registered (found through a DOI
# registration agency), local_only (no live source, or the best candidate is a local record), live (a live source found it),
# arxiv_alias (one of the DOIs is arXiv's and the titles agree), both_dois, doi_conflict, content_score, content_aligned,
# missing_reference, matched (null: not mapped at all), quality_candidate and url_only.
RECORD_RULES: tuple[tuple[str, str, str, str, str], ...] = (
    ("R-GLOBAL-DOI-RA-VERIFIED", f"registered and doi_exact_match and title_fuzzy >= 0.85 and {_SURE_YEAR}", "verified", f"greatest(0, 0.88 {_BOTH})", "R-WELL-LINKED"),
    ("R-LOCAL_DB_VERIFIED", f"local_only and title_fuzzy >= 0.9 and title_sim >= 0.95 and author_sim >= 0.8 and {_NEAR}", "verified", f"greatest(0, case when doi_exact_match then 0.9 else 0.8 end {_STYLE})", "R-WELL-LINKED"),
    ("R-LOCAL_DB_GOOD_MATCH", f"local_only and title_fuzzy >= 0.9 and title_sim >= 0.95 and {_NEAR} and (author_sim >= 0.5 or ({_ALIAS} and author_sim >= 0.35) or (title_fuzzy >= 0.98 and author_sim >= 0.35 and not (both_dois and not {_ALIAS})))", "verified", f"greatest(0, 0.75 {_STYLE})", "R-WELL-LINKED"),
    ("R-CONTENT-ALIGNMENT", f"{_CONTENT} and content_aligned and title_fuzzy >= 0.6 and author_sim >= 0.5 and {_NEAR} and not doi_conflict and (consensus >= 2 or matched is null or matched)", "verified", f"greatest(0, 0.85 {_STYLE})", "second R-NONEXISTENT-DOI"),
    ("R-CONTENT-MISMATCH", f"{_CONTENT} and not content_aligned and content_score >= 0.3 and title_fuzzy >= 0.75 and author_sim >= 0.5", "suspected_hallucination", f"greatest(0, 0.8 {_STYLE})", "second R-NONEXISTENT-DOI"),
    ("R-CONTENT-ALIGNMENT", f"{_CONTENT} and not content_aligned and content_score >= 0.2 and content_score < 0.5 and author_sim >= 0.3 and {_NEAR} and not url_only", "unresolved", f"greatest(0, content_score {_STYLE})", "second R-NONEXISTENT-DOI"),
    ("R-SINGLE-SOURCE-PARTIAL", f"consensus >= 1 and live and not doi_conflict and (author_sim > 0 or doi_exact_match or (consensus >= 2 and title_sim >= 0.9 and {_NEAR})) and ((title_sim >= 0.9 and (author_sim < 0.5 or year_distance > 1)) or (title_sim >= 0.6 and title_sim < 0.9 and (author_sim >= 0.3 or year_distance <= 2)))", "metadata_error", f"greatest(0, 0.68 {_STYLE})", "second R-NONEXISTENT-DOI"),
    ("R-LOCAL_DB_METADATA_ERROR", f"local_only and {_STRONG} and {_ODD}", "metadata_error", f"greatest(0, 0.78 {_STYLE})", "second R-NONEXISTENT-DOI"),
    ("R-KNOWN-AUTHOR-TITLE-MISMATCH", "known_author and quality_candidate and author_sim >= 0.5 and title_sim >= 0.3 and title_sim < 0.9", "metadata_error", "0.65", "second R-NONEXISTENT-DOI"),
)


def _placed() -> tuple[tuple[str, str, str, str], ...]:
    """EVIDENCE_RULES with each of RECORD_RULES before the rule that it names."""
    out: list[tuple[str, str, str, str]] = []
    met: dict[str, int] = {}
    for rule in EVIDENCE_RULES:
        met[rule[0]] = met.get(rule[0], 0) + 1
        here = rule[0] if met[rule[0]] == 1 else f"second {rule[0]}"
        out += [r[:4] for r in RECORD_RULES if r[4] == here]
        out.append(rule)
    return tuple(out)


#: The whole chain.
FULL_RULES = _placed()


def decide(rules: tuple[tuple[str, str, str, str], ...] = RULES) -> Column:
    """struct(label, confidence, rule)."""
    chain = F
    for rule, when, label, confidence in rules:
        chain = chain.when(F.expr(when), F.struct(F.lit(label).alias("label"), F.expr(confidence).cast("double").alias("confidence"), F.lit(rule).alias("rule")))
    rule, label, confidence = DEFAULT
    return chain.otherwise(F.struct(F.lit(label).alias("label"), F.expr(confidence).cast("double").alias("confidence"), F.lit(rule).alias("rule")))


def classify(features: DataFrame, rules: tuple[tuple[str, str, str, str], ...] = RULES) -> DataFrame:
    return features.withColumn("_d", decide(rules)).select("*", "_d.label", "_d.confidence", "_d.rule").drop("_d")


def demote_retracted(verdicts: DataFrame) -> DataFrame:
    """A retracted paper is no verified or open one: its label becomes metadata_error; other labels stay."""
    hit = F.coalesce("retracted", F.lit(False)) & F.col("label").isin("verified", "unresolved")
    return verdicts.withColumn("label", F.when(hit, "metadata_error").otherwise(F.col("label")))
