"""Running text made readable: broken words and lines, sentences, the sentence that cites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .characters import compatible

# First parts that keep their hyphen at a line's end, and abbreviations that end no sentence.
KEEP_HYPHEN = (
    "pre post self non co multi cross sub inter intra semi quasi meta micro macro high low well real open two three four five one single double full end fine class word page line user data time zero few over under"
).split()
ABBREVIATIONS = "Fig Figs Table Tab Eq Eqs Sec Secs Ch Vol Iss No Nos pp Dr Prof Mr Mrs Ms Jr Sr Inc Ltd Co Corp vs cf viz approx est dept univ proc intl conf".split()
_DOT = "․"


def clean_lines(x: Column) -> Column:
    """Ligatures written out, lines joined that end and go on in lower case, runs of blanks and empty lines cut."""
    text = F.regexp_replace(compatible(F.coalesce(x, F.lit(""))), r"([\p{Ll},;])\n(?=\p{Ll})", "$1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def dehyphenate(x: Column) -> Column:
    """"cal- ibration" becomes one word, "pre- trained" keeps its hyphen."""
    text = F.replace(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")), F.lit("­"), F.lit(""))
    kept = F.regexp_replace(text, r"(?i)\b(" + "|".join(KEEP_HYPHEN) + r")-\s+(?=\p{Ll}{2})", "$1-")
    return F.regexp_replace(kept, r"(\p{L}{2,})-\s+(\p{Ll}{2,})", "$1$2")


def protect(x: Column) -> Column:
    """Full stops that end no sentence, of abbreviations, initials and numbers, as another character."""
    out = F.regexp_replace(x, r"\.\.\.", _DOT * 3)
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)\b(et al)\.", "$1" + _DOT), r"(?i)\b([ei])\.([ge])\.", f"$1{_DOT}$2{_DOT}")
    out = F.regexp_replace(out, r"(?i)\b(" + "|".join(ABBREVIATIONS) + r")\.", "$1" + _DOT)
    return F.regexp_replace(F.regexp_replace(out, r"\b(\p{Lu})\.(?=\s+\p{Lu})", "$1" + _DOT), r"(\d)\.(\d)", f"$1{_DOT}$2")


def split_sentences(x: Column, least: int = 20) -> Column:
    """Sentences of ``least`` characters or more; abbreviations, initials and decimals end none."""
    parts = F.split(protect(dehyphenate(x)), r"(?<=[.!?;])\s+(?=[\p{Lu}0-9\[(])")
    return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit(_DOT), F.lit(".")))), lambda p: F.length(p) >= least)


def focal_sentence(context: Column, marker: Column, title: Column) -> Column:
    """The sentence with the citation's marker, or else the one that shares most words with the cited title; the whole context if there are no sentences."""
    s = split_sentences(context)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}0-9]{3,})"), F.lit(1)))
    asked = words(title)
    marked = F.try_element_at(F.filter(s, lambda p: (F.coalesce(marker, F.lit("")) != "") & p.contains(marker)), F.lit(1))
    rated = F.transform(s, lambda p, i: F.struct((F.size(F.array_intersect(asked, words(p))) * 2.5 + F.when(p.rlike(r"\[\d+(\s*[,–-]\s*\d+)*\]|\(\p{L}[^)]*(19|20)\d{2}[a-z]?\)"), 2.0).otherwise(0.0) + F.least(F.length(p), F.lit(180)) / 300.0).alias("score"), (-i).alias("place"), p.alias("p")))
    return F.coalesce(marked, F.array_max(rated)["p"], F.nullif(dehyphenate(context), F.lit("")))


def segments(x: Column, size: int = 512, most: int = 5) -> Column:
    """The first ``most`` pieces of ``size`` characters, for models that read no more."""
    text = F.coalesce(x, F.lit(""))
    n = F.least(F.greatest(F.ceil(F.length(text) / size), F.lit(1)), F.lit(most)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))


def split_merged(raw: Column) -> Column:
    """Entries that a parser has glued into one: cut before an author in inverted form that follows a full stop and precedes a year."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"(?<=[.)\d])\s+(?=\p{Lu}[\p{L}'’\-]+,\s+\p{Lu}\.[^()]{0,80}\((?:19|20)\d{2})"), lambda p: F.trim(p)), lambda p: p != "")
