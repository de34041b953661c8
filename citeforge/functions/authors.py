"""Keys of author names, and how far two author lists agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .characters import ascii_letters, without_marks
from .normalize import title_tokens

# What stands behind a name, and beginnings that are no name of their own.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
PREFIXES = ("mac", "van", "von", "fitz", "del", "dal", "das", "dos", "las", "los", "san", "bin", "abu", "ben")
_JOINED = r"^([A-ZÀ-ÖØ-Þ][a-zà-ÿ]{2,})([A-ZÀ-ÖØ-Þ][a-zà-ÿ]+)$"
_NONE = "array<string>"


def author_key(x: Column) -> Column:
    """The surname as one ASCII word: "Smith, J." and "J. Smith" give "smith"; '' if there is none."""
    text = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)\bet\s+al\b\.?", " "))
    text = F.regexp_replace(F.translate(text, "’‘`", "'''"), r"\b([A-Za-z])'([A-Za-z])", "$1$2")
    first, second = F.regexp_extract(text, _JOINED, 1), F.regexp_extract(text, _JOINED, 2)
    joined = (first != "") & ~F.lower(first).isin(*PREFIXES)
    head, tail = F.trim(F.substring_index(text, ",", 1)), F.trim(F.regexp_replace(text, "^[^,]*,", ""))
    suffix = F.regexp_replace(F.lower(head), r"\.+$", "").isin(*SUFFIXES)
    name = F.when(joined, first).when(text.contains(","), F.when(suffix, tail).otherwise(head)).otherwise(text)
    words = title_tokens(name)
    plain = F.filter(words, lambda w: ~w.isin(*SUFFIXES))
    last = F.coalesce(F.try_element_at(plain, F.lit(-1)), F.try_element_at(words, F.lit(-1)), F.lit(""))
    return F.coalesce(F.nullif(without_marks(last), F.lit("")), last)


def author_keys(authors: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(F.coalesce(authors, F.array().cast(_NONE)), author_key)), lambda k: k != "")


def author_match(a: Column, b: Column) -> Column:
    """Shared surnames over the shorter list; 0.8 if one surname of four letters or more contains another."""
    x, y = author_keys(a), author_keys(b)
    least, both = F.least(F.size(x), F.size(y)), F.size(F.array_intersect(x, y))
    within = F.exists(x, lambda p: F.exists(y, lambda q: (F.length(p) >= 4) & (F.length(q) >= 4) & (p.contains(q) | q.contains(p))))
    return F.when(least == 0, 0.0).when(both > 0, both / least).when(within, 0.8).otherwise(0.0)


def first_surname(authors: Column, raw: Column) -> Column:
    """Of the first author: before the comma, or else behind a leading initial; of the raw text if there are none."""
    one = F.try_element_at(authors, F.lit(1))
    words = F.filter(F.split(F.trim(one), r"\s+"), lambda w: w != "")
    initial = (F.size(words) > 1) & (F.length(F.regexp_replace(words[0], r"\.+$", "")) == 1)
    named = F.when(one.contains(","), F.trim(F.substring_index(one, ",", 1))).when(initial, F.element_at(words, -1)).otherwise(F.try_element_at(words, F.lit(1)))
    return F.when(F.coalesce(F.size(authors) > 0, F.lit(False)), named).otherwise(F.nullif(F.regexp_extract(F.substring_index(F.coalesce(raw, F.lit("")), ",", 1), r"^([A-Z][a-zÀ-ÿ'\-]+)", 1), F.lit("")))


def fold_author(x: Column) -> Column:
    """Lower-case ASCII with single spaces and bare hyphens, without a suffix such as "Jr."."""
    low = F.trim(F.lower(ascii_letters(F.translate(F.coalesce(x, F.lit("")), "’‘`–", "'''-"))))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"\s*-\s*", "-"), r"\s+\b(iii|ii|iv|jr|sr)\.?$", ""), r"\s+", " "))


_INITIALS = r"(?:\p{Lu}\.[\s\-]?)+|\p{Lu}{1,3}"
# Words that make a name that of an organisation, and words that its initials leave out.
CORPORATE = tuple("organization organisation university institute association society committee department ministry agency center centre centers council commission bureau foundation world national united".split())
SMALL_WORDS = ("and", "the", "for", "of", "in", "on", "a", "an", "de", "la")


def parse_authors(raw: Column) -> Column:
    """array of struct(last, initials) from a list of authors in any of the usual forms.

    "Smith, J. K., & Lê, A.", "J. Smith and A. Lee", "Smith JK; Lee A", "Smith, John K." and "Smith, J., et al."
    are told apart by where initials stand; last names are lower case."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?iu),?\s*(et\s+al\.?|và\s+cộng\s+sự)\s*$", "")
    text = F.regexp_replace(text, r"(?iu)\s+(and|và)\s+|\s*&\s*", ";")
    pieces = F.filter(F.split(text, ";"), lambda p: F.trim(p) != "")

    def names(piece):
        marked = F.regexp_replace(F.trim(piece), r",\s*(" + _INITIALS + r")(?=\s*(?:,|$))", "|$1")
        parts = F.split(marked, ",")
        given = (F.size(parts) == 2) & ~marked.contains("|") & ~F.trim(parts[0]).contains(" ")
        return F.when(given, F.array(F.concat(parts[0], F.lit("|"), F.try_element_at(parts, F.lit(2))))).otherwise(parts)

    def one(p):
        name = F.regexp_replace(F.trim(p), r"(?i)[,\s]+(jr|sr|iii|ii|iv)\.?$", "")
        front, back = r"^((?:" + _INITIALS + r")[\s\-]*)(\S.*)$", r"^(\S.*?)\s+(" + _INITIALS + r")$"
        first = F.when(name.contains("|"), F.substring_index(name, "|", -1)).when(name.rlike(r"^(\p{Lu}\.[\s\-]?)+\S"), F.regexp_extract(name, r"^((?:\p{Lu}\.[\s\-]?)+)", 1)).when(name.rlike(back), F.regexp_extract(name, back, 2)).when(name.contains(" ") & ~F.lower(name).rlike(r"^(van|von|de|der|den|la|le|da|del)\s"), F.regexp_replace(name, r"\s+\S+$", "")).otherwise("")
        last = F.when(name.contains("|"), F.substring_index(name, "|", 1)).when(name.rlike(r"^(\p{Lu}\.[\s\-]?)+\S"), F.regexp_replace(name, r"^(\p{Lu}\.[\s\-]?)+", "")).when(name.rlike(back), F.regexp_extract(name, back, 1)).when(first != "", F.regexp_extract(name, r"(\S+)$", 1)).otherwise(name)
        capital = F.upper(first) == first
        letters = F.when(capital, F.regexp_extract_all(first, F.lit(r"(\p{L})"), F.lit(1))).otherwise(F.regexp_extract_all(first, F.lit(r"(\p{L})[\p{L}'’]*"), F.lit(1)))
        return F.struct(F.lower(F.trim(last)).alias("last"), F.transform(letters, F.lower).alias("initials"))

    return F.filter(F.transform(F.flatten(F.transform(pieces, names)), one), lambda a: a["last"] != "")


def corporate_keys(name: Column) -> Column:
    """Keys by which an organisation may be named: its acronym in brackets, itself if it is one, its words and their initials."""
    raw = F.trim(F.coalesce(name, F.lit("")))
    bracket = F.transform(F.regexp_extract_all(raw, F.lit(r"[(\[]([A-Za-z]{2,12})[)\]]"), F.lit(1)), F.lower)
    words = F.filter(F.split(F.regexp_replace(ascii_letters(F.regexp_replace(raw, r"[(\[][^)\]]*[)\]]", " ")), r"[^A-Za-z0-9\s]", " "), r"\s+"), lambda w: w != "")
    low = F.transform(words, F.lower)
    main = F.filter(low, lambda w: ~w.isin(*SMALL_WORDS))
    initials = lambda x: F.array_join(F.transform(x, lambda w: F.substring(w, 1, 1)), "")
    acronym = (F.size(words) == 1) & F.length(words[0]).between(2, 10) & (F.upper(words[0]) == words[0])
    whole = F.when(F.arrays_overlap(low, F.array(*[F.lit(c) for c in CORPORATE])) & (F.size(main) > 0), F.array_compact(F.array(F.array_join(main, " "), F.when(F.size(main) >= 2, initials(main)), F.when(F.size(main) >= 4, initials(F.slice(main, 1, F.size(main) - 1)))))).otherwise(F.array().cast(_NONE))
    return F.array_distinct(F.concat(bracket, F.when(acronym, F.array(low[0])).otherwise(whole)))


def author_list_score(cited: Column, candidate: Column) -> Column:
    """How far lists of names agree: 1 if every cited surname is there or the only candidate leads the citation, else the Jaccard of surnames, else shared beginnings.

    An organisation counts as there under any of its :func:`corporate_keys`."""
    x, y0 = author_keys(cited), author_keys(candidate)
    there = F.flatten(F.transform(F.coalesce(candidate, F.array().cast(_NONE)), corporate_keys))
    named = F.transform(F.filter(F.coalesce(cited, F.array().cast(_NONE)), lambda a: F.coalesce(F.arrays_overlap(corporate_keys(a), there), F.lit(False))), author_key)
    y = F.array_union(y0, named)
    both, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    lead = (F.size(y) == 1) & (author_key(F.try_element_at(cited, F.lit(1))) == F.try_element_at(y, F.lit(1)))
    begins = F.size(F.filter(x, lambda a: F.exists(y, lambda b: (F.length(a) >= 5) & (F.length(b) >= 5) & (a.startswith(b) | b.startswith(a) | a.endswith(b) | b.endswith(a)))))
    return F.when((F.size(x) == 0) | (F.size(y0) == 0), 0.0).when((F.size(F.array_except(x, y)) == 0) | lead, 1.0).when(both > 0, both / every).otherwise(begins / F.size(x))
