"""Keys and similarities as column expressions; null and empty text count as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .characters import compatible, hyphens

MISSING_YEAR = 999


def present(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def normalize_doi(x: Column) -> Column:
    """Lower case, without a resolver or ``doi:`` prefix and trailing punctuation; null if nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(compatible(x))), r"^(https?://)?(dx\.)?(doi\.org/)?(doi:)?\s*", "")
    return present(F.regexp_replace(bare, r"[\s.,;:)\]}>]+$", ""))


def normalize_arxiv(x: Column) -> Column:
    """Lower case, without prefix, query part, trailing punctuation and, last, version."""
    bare = F.regexp_replace(F.lower(F.trim(compatible(x))), r"^(https?://)?(www\.)?(arxiv\.org/(abs|pdf)/)?(arxiv:)?\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"[\s.,;:)\]}>]+$", "")
    return present(F.regexp_replace(bare, r"v[0-9]+$", ""))


def normalize_text(x: Column) -> Column:
    """Letters, digits and single spaces, lower case, without "et al"."""
    low = F.replace(F.lower(hyphens(compatible(x))), F.lit("ß"), F.lit("ss"))
    low = F.regexp_replace(low, r"\bet\s+al\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def title_tokens(x: Column) -> Column:
    """Distinct words of two or more characters."""
    return F.array_distinct(F.filter(F.split(normalize_text(x), " "), lambda t: F.length(t) > 1))


def year_key(x: Column) -> Column:
    return F.regexp_extract(x, r"(19|20)\d{2}", 0)


def year_distance(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b), F.lit(MISSING_YEAR))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(0.0)


def citation_key(doi: Column, arxiv: Column, title: Column, author: Column, year: Column, raw: Column) -> Column:
    """The strongest identifier that a citation has."""
    named = lambda kind, x: F.concat(F.lit(kind), x)
    triple = F.concat_ws("|", normalize_text(title), F.coalesce(F.lower(author), F.lit("")), F.coalesce(year.cast("string"), F.lit("")))
    return F.coalesce(named("doi:", normalize_doi(doi)), named("arxiv:", normalize_arxiv(arxiv)), F.when(present(title).isNotNull(), named("title:", triple)), named("raw:", normalize_text(raw)))


def fingerprint(doi: Column, title: Column) -> Column:
    """What makes two candidates the same work: the DOI, or 120 letters and digits of the title."""
    return F.coalesce(normalize_doi(doi), F.substring(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", ""), 1, 120))


def numeric_indices(x: Column, widest: int = 50) -> Column:
    """Indices of the first ``[1, 3-5]`` of the text, or else of its first ``^2-4``; none without either.

    A range wider than ``widest``, or one that runs backwards, gives its ends only."""
    group = r"(\d+(?:\s*[-–,]\s*\d+)*)"
    inner = F.coalesce(F.nullif(F.regexp_extract(x, r"\[\s*" + group + r"\s*\]", 1), F.lit("")), F.regexp_extract(x, r"\^" + group, 1), F.lit(""))
    parts = F.filter(F.split(F.regexp_replace(F.translate(inner, "–", "-"), r"\s", ""), ","), lambda p: p != F.lit(""))

    def span(p):
        a, b = F.split(p, "-")[0].try_cast("int"), F.try_element_at(F.split(p, "-"), F.lit(2)).try_cast("int")
        return F.when(b.isNull(), F.array(a)).when((b >= a) & (b - a <= widest), F.sequence(a, F.greatest(a, F.least(b, a + widest)))).otherwise(F.array(a, b))

    return F.filter(F.flatten(F.transform(parts, span)), lambda i: i.isNotNull())


def csv_guard(x: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe."""
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def platt(p: Column, a: float, b: float) -> Column:
    """Calibrated probability in [0.01, 0.99]; 0 stays 0."""
    c = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    z = F.lit(a) * F.ln(c / (1 - c)) + F.lit(b)
    return F.when(p <= 0, 0.0).otherwise(F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(0.01)), F.lit(0.99)))


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors, clamped to [0, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, F.least(F.greatest(dot(a, b) / norm, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def author_overlap(a: Column, b: Column) -> Column:
    """struct(score, matched, only_cited, only_candidate): shared authors over the shorter list, and sorted lists."""
    a, b = (F.array_distinct(F.filter(x, lambda v: v.isNotNull())) for x in (a, b))
    least = F.least(F.size(a), F.size(b))
    score = F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)
    return F.struct(score.alias("score"), F.sort_array(F.array_intersect(a, b)).alias("matched"), F.sort_array(F.array_except(a, b)).alias("only_cited"), F.sort_array(F.array_except(b, a)).alias("only_candidate"))


def blend(base: Column, model: Column) -> Column:
    """Rule and model confidence together; a sure rule that the model contradicts weighs more."""
    a = F.when((F.abs(base - model) > 0.45) & (base >= 0.85), 0.9).otherwise(0.72)
    return a * base + (1 - a) * model


def sentences(x: Column, least: int = 25) -> Column:
    """Sentences and lines of ``least`` characters or more; null has none."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"[.!?]+([ \t\n\r]+|$)|\n+"), lambda s: F.length(F.trim(s)) >= least)


def author_years(x: Column) -> Column:
    """array of struct(author, year, suffix), one for each ``;``-part of "(Smith et al., 2020a; Lê, n.d.)".

    Authors are lower case without "et al." and co-authors; a part without a year is left out."""
    pattern = r"^[\s(]*(\p{L}[^,;()&]*?)(?:\s+et al\.?|\s+(?:&|and)\s[^,;()]*)?,?\s*\(?((?:19|20)\d{2}|n\.d\.)([a-z]?)"
    part = lambda p: F.struct(F.lower(F.regexp_extract(p, pattern, 1)).alias("author"), F.regexp_extract(p, pattern, 2).alias("year"), F.regexp_extract(p, pattern, 3).alias("suffix"))
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ";"), part), lambda s: s["year"] != F.lit(""))
