"""Identifiers, years and keys found in raw citation texts and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a DOI looks like in running text, and DOIs of one work.
DOI = r"10\.\d{4,9}/(?:[^\s\]\),;()]|\([^\s\]\),;()]*\))+"
SAME_DOIS = (("10.18653/v1/n19-1423", "10.48550/arxiv.1810.04805"),)
# Notes on the medium that may stand behind a title.
MEDIUM = (
    r"(?iu)\s*\[(?:online|internet|preprint|computer\s+software|software|data\s*set|dataset|audio\s+podcast|podcast|video|film|white\s+paper|working\s+paper|master'?s\s+thesis"
    r"|doctoral\s+dissertation|dissertation|thesis|tech\.?\s*rep\.?|technical\s+report|monograph|electronic\s+resource|cd-rom|báo\s+cáo|luận\s+văn(?:\s+thạc\s+sĩ)?|luận\s+án(?:\s+tiến\s+sĩ)?|trực\s+tuyến)\]"
)
# What a revised manuscript's file name ends with.
REVISION = r"(?i)(?:[_\-\s]+(?:v\d+(?:\.\d+)?|rev\d*|version\d*|draft\d*|final|fixed|remediated|updated|corrected|revised|edited|healed|auto[_\-\s]*healed|clean|copy)|\s*\(\d+\))+$"


def _found(x: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), pattern, group), F.lit(""))


def extract_doi(x: Column) -> Column:
    """The first DOI of a text, or null."""
    return F.regexp_replace(_found(x, DOI), r"[.,;:]+$", "")


def extract_url(x: Column) -> Column:
    """The first web address of a text whose host has a dot, or null."""
    url = F.regexp_replace(_found(x, r"https?://[^\s\]\),;]+"), r"(?i)[(\[](ac-?\s*cessed|re-?\s*trieved)\b.*$", "")
    url = F.regexp_replace(url, "[.,;:)'\"’”]+$", "")
    return F.when(F.regexp_extract(url, r"(?i)^https?://([^/\s]+)", 1).rlike(r"\.|^localhost$"), url)


# Numbers of four digits that are no year, and notes on when a page was read.
NOT_YEARS = (
    r"(?iu)https?://\S+|www\.\S+|\b10\.\d{4,9}/\S+|\barxiv\s*:\s*(?:[a-z\-]+/\d+|\d{4}\.\d+(?:v\d+)?)|\(\s*(?:18|19|20)\d{2}\s*[-–—]\s*\)"
    r"|\b(?:pp?\.?|pages?|trang|tr\.)\s*[a-z]?\d+(?:\s*[-–—/]\s*[a-z]?\d+)?\b"
    r"|\b(?:vol(?:ume)?|no|number|iss(?:ue)?|art(?:icle)?(?:\s+(?:no|id)\.?)?|lncs|lnai|isbn|issn|pmid|pmcid)\.?\s*[a-z]?\d+(?:\s*[-–—/]\s*[a-z]?\d+)?\b"
)
READ_ON = r"(?iu)[(\[]\s*(?:accessed|retrieved|last accessed)\b[^)\]]*[)\]]|\b(?:accessed|retrieved(?:\s+on|\s+from)?|last accessed)\s*:?\s*(?:\d{1,2}\s+[a-z.]+\s+|[a-z.]+\s+\d{1,2}\s*,?\s*)?(?:19|20)\d{2}\b"
PAGE_RANGE = r"\b[A-Za-z]?\d{3,5}\s*[-–—]\s*[A-Za-z]?\d{3,5}\b"


def extract_year(x: Column) -> Column:
    """The first year of a text with its suffix, or null; pages, volumes and addresses have none, dates of access only if nothing else has."""
    text = F.regexp_replace(F.coalesce(x, F.lit("")), NOT_YEARS, " ")
    published = F.regexp_replace(text, READ_ON, " ")
    pattern = r"\b(?:19|20)\d{2}[a-z]?\b"
    return F.coalesce(_found(F.regexp_replace(published, PAGE_RANGE, " "), pattern), _found(published, pattern), _found(text, pattern))


def bare_doi(x: Column) -> Column:
    """Lower case without resolver or ``doi:`` and last dots; '' if missing."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"^(https?://doi\.org/)?\s*(doi:)?\s*", ""), r"\.+$", "")


def same_doi(a: Column, b: Column) -> Column:
    """Equal, cut off at a closing bracket, or known as one work."""
    x, y = bare_doi(a), bare_doi(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    cut = short.contains("(") & ~short.contains(")") & long.startswith(F.concat(short, F.lit(")")))
    known = F.lit(False)
    for group in SAME_DOIS:
        known = known | (x.isin(*group) & y.isin(*group))
    return (x != "") & (y != "") & ((x == y) | cut | known)


def title_forms(x: Column) -> Column:
    """struct(main, other): the title without notes on its medium, and a translation that stands in brackets behind it."""
    clean = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), MEDIUM, ""))
    tidy = lambda c: F.regexp_replace(F.trim(c), "[.,;:]+$", "")
    pattern = r"^(.+?)\s*\[([^\]]{10,})\]\s*$"
    main, other = tidy(F.regexp_extract(clean, pattern, 1)), tidy(F.regexp_extract(clean, pattern, 2))
    two = (F.length(main) >= 6) & (F.length(other) >= 10)
    return F.struct(F.when(two, main).otherwise(clean).alias("main"), F.when(two, other).alias("other"))


def _has(x: Column, score: float) -> Column:
    return F.when(F.coalesce(x.cast("string"), F.lit("")) != "", score).otherwise(0.0)


def occurrence_confidence(year: Column, doi: Column, url: Column, authors: Column, title: Column) -> Column:
    """How much of an in-text citation is known, 0 to 1."""
    named = F.when(F.coalesce(F.size(authors) > 0, F.lit(False)), 0.15).otherwise(0.0)
    return F.least(F.round(_has(year, 0.25) + _has(doi, 0.4) + _has(url, 0.1) + named + _has(title, 0.1), 2), F.lit(1.0))


def reference_confidence(title: Column, year: Column, authors: Column, doi: Column) -> Column:
    """How much of a reference is known, 0 to 1."""
    named = F.when(F.coalesce(F.size(authors) > 0, F.lit(False)), 0.2).otherwise(0.0)
    return F.least(F.round(_has(title, 0.4) + _has(year, 0.3) + named + _has(doi, 0.1), 2), F.lit(1.0))


def merge_key(x: Column) -> Column:
    """What tells raw citations apart when lists are merged: lower case without resolver and last punctuation."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), "[.,;:]+$", ""), r"(?i)^(https?://)?doi\.org/?", "")))


def manuscript_stem(x: Column) -> Column:
    """A file's name without folder, extension and marks of revision."""
    raw = F.trim(F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("essay")), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")))
    clean = F.regexp_replace(F.regexp_replace(raw, REVISION, ""), r"^[ _\-]+|[ _\-]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.nullif(raw, F.lit("")), F.lit("essay"))


def same_manuscript(a: Column, b: Column) -> Column:
    """Stems of one paper: equal, or one of 12 letters or more that the other goes on from."""
    x, y = F.lower(F.trim(F.coalesce(a, F.lit("")))), F.lower(F.trim(F.coalesce(b, F.lit(""))))
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    longer = (F.length(short) >= 12) & long.startswith(short) & F.substr(long, F.length(short) + 1, F.lit(1)).isin("_", "-", " ")
    return ~x.isin("", "essay") & ~y.isin("", "essay") & ((x == y) | longer)


def verdict_key(x: Column) -> Column:
    """The DOI of a citation, or else its first 14 words of three characters or more."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    doi = F.regexp_extract(low, r"10\.\d{4,9}/[^\s,;)\]]+", 0)
    return F.when(doi != "", F.concat(F.lit("doi:"), F.regexp_replace(doi, r"\.+$", ""))).otherwise(F.array_join(F.slice(F.regexp_extract_all(low, F.lit("[a-z0-9]{3,}"), F.lit(0)), 1, 14), " "))


def title_key(x: Column) -> Column:
    """A title without regard to case and punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
