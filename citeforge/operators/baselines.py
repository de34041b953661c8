"""Baseline classifiers, each an ordered list of conditions over feature columns.

Columns: doi_ok, fuzzy, semantic, author, years (absolute distance), consensus, crossref, cited_doi (has
one), url_status, aligned, alignment, alignment_level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BEST = "greatest(fuzzy, semantic)"
_OK, _META, _FAKE, _OPEN = "verified", "metadata_error", "suspected_hallucination", "unresolved"

# For each baseline its conditions in order with their labels, and the label of the rest.
BASELINES: dict[str, tuple[tuple[tuple[str, str], ...], str]] = {
    "B0": ((("doi_ok", _OK),), _OPEN),
    "B1": ((("doi_ok", _OK), ("crossref and fuzzy >= 0.88 and author >= 0.5 and years <= 1", _OK), ("crossref and fuzzy >= 0.6", _META)), _FAKE),
    "B2": ((("0.7 * fuzzy + 0.3 * author >= 0.8 and years <= 1", _OK), ("0.7 * fuzzy + 0.3 * author >= 0.55", _META)), _FAKE),
    "B3": ((("semantic >= 0.88", _OK), ("semantic >= 0.65", _META)), _FAKE),
    "B4": ((("doi_ok", _OK), (f"{_BEST} * 0.65 + author * 0.35 >= 0.8 and years <= 1", _OK), (f"{_BEST} * 0.65 + author * 0.35 >= 0.5", _META)), _FAKE),
    "proposed": (
        (
            ("url_status = 'fake_domain'", _FAKE),
            (f"not doi_ok and {_BEST} < 0.6 and (cited_doi or url_status = 'dead_link')", _FAKE),
            ("not aligned and alignment >= 0.3 and fuzzy >= 0.75 and author >= 0.5 and not doi_ok and consensus <= 1", _FAKE),
            (f"alignment_level = 'high' and not aligned and alignment > 0 and alignment < 0.25 and {_BEST} >= 0.85", _META),
            ("aligned and alignment >= 0.6 and fuzzy >= 0.6 and author >= 0.5 and years <= 1 and consensus >= 2", _OK),
            (f"{_BEST} >= 0.85 and years <= 1 and (doi_ok or (author >= 0.5 and consensus >= 1))", _OK),
            (f"doi_ok and {_BEST} < 0.85", _META),
            (f"{_BEST} >= 0.6 and (author < 0.5 or years > 1 or {_BEST} < 0.85)", _META),
            (f"{_BEST} >= 0.4 and {_BEST} < 0.6", _OPEN),
        ),
        _FAKE,
    ),
}


def case(name: str) -> str:
    """The classifier as a CASE expression that Spark and DuckDB both read."""
    conditions, rest = BASELINES[name]
    return "CASE " + " ".join(f"WHEN {when} THEN '{label}'" for when, label in conditions) + f" ELSE '{rest}' END"


def label(features: DataFrame) -> DataFrame:
    """features with a column of labels for each baseline, all in one pass."""
    return features.select("*", *[F.expr(case(name)).alias(name.lower()) for name in BASELINES])
