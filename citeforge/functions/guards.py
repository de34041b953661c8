"""Predicates over one citation that decide before any evidence is looked at.

Arguments that are null count as missing; every predicate is true or false, never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .authors import author_keys, author_match
from .normalize import normalize_text, present

# Hosts that no real source has.
FAKE_HOSTS = ("example.com", "example.org", "example.net", "example.edu", "test.com", "fake.com", "localhost")
# Shapes of DOIs that were made up.
FABRICATED_DOIS = (
    r"10\.1234/(?:ncr|fake|fab|hallucination)",
    r"10\.9999?/(?:jmle|fake|fab|pseudonym)",
    r"10\.\d{4,}/(?:nonexistent|imaginary|temp)",
    r"10\.0000/",
    r"10\.\d{4,}/(?:paper-\d+|fake-\w+)",
)
# Author names that were made up, in lower case, and raw texts that begin with one.
FAKE_AUTHORS = (
    r"\b(fictional|fabricated|fake|counterfeit|phantom|hypothetical|mystery|synthetic)\b.*\b(scholar|author|researcher|scientist|paper|research)\b",
    r"\b(artificial|mock|pseudo|fraudulent)\b.*\b(author|scholar)\b",
    r"\b(unknown|unnamed|anonymous)\b",
    r"\b(example|sample|test)\b.*\b(author|scholar)\b",
    r"^(fictional|fabricated|fake|counterfeit|phantom|hypothetical|mystery|synthetic|artificial|unknown|pseudo)",
)
FAKE_OPENINGS = (
    r"^[\(\s]*(fictional|fabricated|fake|counterfeit|phantom|hypothetical|mystery|synthetic|artificial|mock|pseudo)\s+(scholar|author|researcher|scientist)",
    r"^[\(\s]*example\s+(scholar|author)",
    r"^[\(\s]*test\s+(author|scholar)",
)
# Surnames of authors whose papers everybody cites.
KNOWN_AUTHORS = tuple(
    "vaswani shazeer parmar uszkoreit gomez kaiser polosukhin devlin toutanova goodfellow pouget-abadie mirza warde-farley lecun bottou bengio hinton "
    "hochreiter schmidhuber bahdanau sutskever vinyals mikolov corrado radford narasimhan raffel dosovitskiy kolesnikov kingma loshchilov hutter sennrich "
    "haddow birch manning karpukhin kojima finn snell velickovic socher mnih kavukcuoglu bojanowski joulin bowman".split()
)
# Signals of what kind of source a text cites; all without regard to case.
PERIODICAL = (
    r"\b(?:journal\s+of|international\s+journal|proceedings\s+of|transactions\s+on|conference\s+on|symposium\s+on|workshop\s+on|annals\s+of|bulletin\s+of|archives\s+of"
    r"|quarterly\s+journal|european\s+journal|american\s+journal|british\s+journal|asian\s+journal|australian\s+journal|canadian\s+journal"
    r"|ieee\s+(?:transactions|journal|access|letters|software|network|communications|spectrum)|acm\s+(?:transactions|computing\s+surveys)"
    r"|nature\s+[a-z]+|lancet|jama|bmj|plos\s+one|frontiers\s+in|sensors|energies|sustainability|vol\.\s*\d+|no\.\s*\d+|pp\.\s*\d+\s*[-–—]\s*\d+)\b"
    r"|,\s*\d{1,4}\s*\(\s*\d{1,3}\s*\)\s*,\s*(?:e?\d+|\d+\s*[-–—]\s*\d+)\b"
)
LEGAL = (
    r"\b(?:quốc\s+hội|chính\s+phủ|thủ\s+tướng|bộ\s+[a-zà-ỹ]+|nghị\s+định|thông\s+tư|quyết\s+định|luật\s+số|bộ\s+luật|hiến\s+pháp"
    r"|u\.?s\.?c\.?\s*§|c\.?f\.?r\.?\s*§|pub\.\s*l\.\s*no\.|iso/iec\s*\d+|nist\s+special\s+publication|nist\s+sp\s*\d+|rfc\s*\d+)\b"
)
SCHOLARLY_HOST = r"doi\.org|arxiv\.org|aclanthology\.org|ieee\.org|acm\.org|springer\.com|sciencedirect\.com|nature\.com|wiley\.com"
WEB = r"\b(?:youtube\.com|youtu\.be|\[video\]|\[online\]|retrieved\s+[a-z]+\s+\d{1,2},\s+\d{4},\s+from\s+https?://)\b"
CLASSICAL = (
    r"\b(?:holy\s+bible|the\s+bible|esv|niv|kjv|nrsv|nasb|nkjv|english\s+standard\s+version|new\s+international\s+version|king\s+james\s+version"
    r"|shakespeare|plato|aristotle|aquinas|augustine|homer|sophocles|euripides|aeschylus|cicero|virgil|ovid|seneca|marcus\s+aurelius|epictetus|plutarch|herodotus|thucydides"
    r"|dante|chaucer|milton|cervantes|machiavelli|hobbes|locke|rousseau|kant|hegel|nietzsche|kierkegaard|dostoevsky|tolstoy|dickens|austen|bront[eë]|melville|hawthorne|twain"
    r"|project\s+gutenberg|gutenberg\.org|oxford\s+world['’]?s\s+classics|penguin\s+classics|loeb\s+classical\s+library|translated\s+by|trans\.\s+[a-z])\b"
)
THESIS = (
    r"\b(?:master['’]?s\s+thesis|doctoral\s+dissertation|phd\s+thesis|honours\s+thesis|honors\s+thesis|senior\s+thesis|bachelor['’]?s\s+thesis"
    r"|unpublished\s+(?:master|doctoral|thesis|dissertation|manuscript)|proquest\s+dissertations|digitalcommons|scholarscentre|scholars\s+crossing|liberty\s+university"
    r"|technical\s+report|working\s+paper|white\s+paper|policy\s+brief|fact\s+sheet|u\.?s\.?\s+department\s+of|ministry\s+of|world\s+health\s+organization|united\s+nations"
    r"|national\s+institute\s+of|centers\s+for\s+disease\s+control|bureau\s+of\s+labor\s+statistics|substance\s+abuse\s+and\s+mental\s+health|security\s+risk\s+advisors|crowdstrike|mandiant)\b"
)
MADE_UP = r"\b(?:imaginaire|imaginary|fictional|fabricated|nonexistent|hal-0999|tel-0999)\b"
PUBLISHER = (
    r"\b(?:isbn(?:-1[03])?|(?:1st|2nd|3rd|\d+th|first|second|third|fourth|fifth|revised|expanded)\s+(?:ed\.?|edition)|university\s+press|mit\s+press|uchicago\s+press"
    r"|routledge|sage\s+publications|palgrave\s+macmillan|bloomsbury|penguin|random\s+house|harper\s*collins|harper\s*one|simon\s*&\s*schuster|farrar,\s*straus|knopf|doubleday"
    r"|norton|little,\s*brown|hachette|macmillan|scholastic|wiley|pearson|mcgraw-hill|prentice\s+hall|addison-wesley|o['’]reilly"
    r"|springer\s+nature|academic\s+press|crc\s+press|elsevier\s+books|de\s+gruyter|brill|zondervan|crossway|baker\s+academic|baker\s+books|baker\s+publishing|eerdmans"
    r"|intervarsity\s+press|ivp\s+academic|ivp\s+books|brazos\s+press|thomas\s+nelson|b&h\s+publishing|b&h\s+academic|holman|tyndale|moody\s+publishers|waterbrook"
    r"|westminster\s+john\s+knox|fortress\s+press|abingdon\s+press|ignatius\s+press|nhà\s+xuất\s+bản|nxb)\b"
)
BOOK_REVIEW = r"\b(?:book\s+review|reviewed\s+work)\b|\(\s*reviews?\s*\)|^\s*reviews?\s*[:\-]"
YEAR = r"\(\s*(?:19|20)\d{2}[a-z]?\s*\)|\b(?:19|20)\d{2}[a-z]?\b"


def _any(x: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(x.rlike(f"(?iu){p}"), F.lit(False)) for p in patterns])


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def host(url: Column) -> Column:
    """Lower case, without port; '' if there is none."""
    return F.regexp_extract(F.lower(_text(url)), r"^[a-z][a-z0-9+.\-]*://([^/?#:]*)", 1)


def fake_url(url: Column) -> Column:
    """The host is reserved, a placeholder or this machine."""
    h = host(url)
    low = F.lower(_text(url))
    named = reduce(lambda a, b: a | b, [(h == f) | h.endswith(f".{f}") for f in FAKE_HOSTS])
    return low.contains("localhost") | low.contains("127.0.0.1") | named | h.rlike(r"^(www\.)?(fake-|placeholder-)")


def fabricated_doi(doi: Column) -> Column:
    return _any(doi, FABRICATED_DOIS)


def author_segment(raw: Column, authors: Column) -> Column:
    """Parsed authors and what stands before the first year, in lower case."""
    before = F.nullif(F.trim(F.split(raw, YEAR, 2)[0]), F.lit(""))
    return F.lower(F.concat_ws(" ; ", authors, before))


def fake_author(raw: Column, authors: Column) -> Column:
    """An author's name was made up; words of the title say nothing."""
    return _any(author_segment(raw, authors), FAKE_AUTHORS) | _any(F.lower(raw), FAKE_OPENINGS)


def source_kind(raw: Column, url: Column, doi: Column) -> Column:
    """Kind of a source that no registry indexes, null for articles and what has a DOI."""
    text, link = F.trim(_text(raw)), F.trim(_text(url))
    both = F.trim(F.concat_ws(" ", text, link))
    web = link.rlike("(?i)^https?://") & ~link.rlike(f"(?i){SCHOLARLY_HOST}")
    return (
        F.when(present(doi).isNotNull() | (both == "") | _any(text, [PERIODICAL]), None)
        .when(_any(both, [LEGAL]), "legal_or_standard")
        .when(web | _any(both, [WEB]), "web_resource")
        .when(_any(both, [CLASSICAL]), "classical_or_scriptural")
        .when(_any(both, [THESIS]) & ~_any(both, [MADE_UP]), "thesis_or_report")
        .when(_any(both, [PUBLISHER]), "book_or_monograph")
    )


def known_author(raw: Column, authors: Column) -> Column:
    """A known author is named before the first year, or is the last word of a parsed author."""
    before = F.split(F.lower(_text(raw)), r"\b(?:19|20)\d{2}\b", 2)[0]
    named = before.rlike(r"\b(" + "|".join(KNOWN_AUTHORS) + r")\b")
    last = F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.element_at(F.split(F.trim(F.lower(a)), r"\s+"), -1))
    return named | F.coalesce(F.arrays_overlap(last, F.array(*[F.lit(k) for k in KNOWN_AUTHORS])), F.lit(False))


def book_review_mismatch(title: Column, authors: Column, other: Column, other_authors: Column) -> Column:
    """The candidate reviews the book that the citation cites: it says so, or names the cited author in its title."""
    cited, found = F.trim(_text(title)), F.trim(_text(other))
    here, there = normalize_text(cited), normalize_text(found)
    word = lambda text, k: F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), k, F.lit(" ")))
    named = F.exists(author_keys(authors), lambda k: (F.length(k) >= 4) & word(there, k) & ~word(here, k))
    both = (F.size(F.coalesce(authors, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(other_authors, F.array().cast("array<string>"))) > 0)
    by_name = both & (author_match(authors, other_authors) == 0) & named
    return (found != "") & ~F.lower(cited).contains("review") & (_any(found, [BOOK_REVIEW]) | F.coalesce(by_name, F.lit(False)))


def substantive(raw: Column, authors: Column, year: Column) -> Column:
    """There is something to look up: authors, a year, or a longer text with one."""
    text = F.trim(_text(raw))
    return F.coalesce(F.size(authors) > 0, F.lit(False)) | (F.coalesce(year.cast("string"), F.lit("")) != "") | ((F.length(text) >= 25) & text.rlike(r"\b(?:19|20)\d{2}\b"))


def clean_miss(error: Column) -> Column:
    """A registry answered and had nothing."""
    return _any(error, ["no results for", "no title match"])
