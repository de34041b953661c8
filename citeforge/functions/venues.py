"""Names of journals and conferences."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import jaccard

# Short names and what they stand for; a larger dictionary is a parameter.
VENUES = {
    "neurips": "advances in neural information processing systems",
    "nips": "advances in neural information processing systems",
    "icml": "international conference on machine learning",
    "iclr": "international conference on learning representations",
    "acl": "annual meeting of the association for computational linguistics",
    "emnlp": "empirical methods in natural language processing",
    "naacl": "north american chapter of the association for computational linguistics",
    "cvpr": "conference on computer vision and pattern recognition",
    "aaai": "aaai conference on artificial intelligence",
    "pnas": "proceedings of the national academy of sciences",
    "jmlr": "journal of machine learning research",
    "tacl": "transactions of the association for computational linguistics",
}


def issn(x: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(x, F.lit("")), r"\b(\d{4}-\d{3}[\dXx])\b", 1)), F.lit(""))


def venue_key(x: Column) -> Column:
    """Lower case without punctuation, years and "proceedings of the"."""
    low = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\b(19|20)\d{2}\b", " ")
    low = F.regexp_replace(low, r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"\s+", " "), r"^\s*(in )?(proceedings of( the)? |proc )", ""))


def venue_name(x: Column, names: dict[str, str] | None = None) -> Column:
    """The full name of a venue if it is known, else its ISSN, else its key."""
    table = VENUES if names is None else names
    known = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(known, venue_key(x)), F.concat(F.lit("issn:"), issn(x)), venue_key(x))


def venue_similarity(a: Column, b: Column, names: dict[str, str] | None = None) -> Column:
    """1 or 0 by ISSN if both have one, 1 for one name, else the Jaccard of words; 0 if either is missing."""
    x, y = venue_name(a, names), venue_name(b, names)
    words = lambda c: F.array_distinct(F.split(c, " "))
    both = issn(a).isNotNull() & issn(b).isNotNull()
    none = (venue_key(a) == "") | (venue_key(b) == "")
    return F.when(none, 0.0).when(both, F.when(issn(a) == issn(b), 1.0).otherwise(0.0)).when(x == y, 1.0).otherwise(jaccard(words(x), words(y)))
