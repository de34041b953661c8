"""Citation occurrences in running text, with offsets, and the sections of a text.

Spark's own regular expression functions give no offsets, so one Arrow UDF a batch of texts finds the
spans; what follows is joins, windows and aggregates over its rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import extract_doi, extract_url, extract_year, occurrence_confidence
from .spans import find_spans

_SPAN = "array<struct<start:int,end:int,raw:string,pattern:string,kind:string>>"


def _find(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("start", "end", "raw", "pattern", "kind"), x)) for x in sorted(find_spans(t))])


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, start, end, raw, pattern, kind, doi, url, year, confidence) of every citation in docs (doc_id, text).

    pos counts from 0 in order of offsets, which are those of characters; null and empty texts have none."""
    each = docs.select("doc_id", F.posexplode(F.pandas_udf(_find, _SPAN)("text")).alias("pos", "s")).select("doc_id", "pos", "s.*")
    doi, url, year = extract_doi(F.col("raw")), extract_url(F.col("raw")), extract_year(F.col("raw"))
    none = F.lit(None).cast("array<string>")
    return each.select("*", doi.alias("doi"), url.alias("url"), year.alias("year")).withColumn("confidence", occurrence_confidence(F.col("year"), F.col("doi"), F.col("url"), none, F.lit(None)))


def own_spans(spans: DataFrame) -> DataFrame:
    """Of spans (doc_id, start, end, priority) that overlap, the one of smallest priority, then earliest, stays.

    A span stays if none that goes before it overlaps it, which a join on buckets of offsets finds."""
    wide = 256
    keyed = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / wide), F.floor((F.col("end") - 1) / wide))))
    a, b = keyed.alias("a"), keyed.alias("b")
    before = (F.col("b.priority") < F.col("a.priority")) | ((F.col("b.priority") == F.col("a.priority")) & ((F.col("b.start") < F.col("a.start")) | ((F.col("b.start") == F.col("a.start")) & (F.col("b.end") < F.col("a.end")))))
    beaten = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.start") < F.col("b.end")) & (F.col("a.end") > F.col("b.start")) & before).select("a.doc_id", "a.start", "a.end", "a.priority").distinct()
    return spans.join(beaten, ["doc_id", "start", "end", "priority"], "left_anti")


# Lines that head a bibliography or an appendix.
BIBLIOGRAPHY = r"(?iu)^\s*(?:\d+\.?\s*)?(?:references?|reference list|bibliography|works cited|literature cited|tài liệu tham khảo)\s*:?\s*$"
APPENDIX = r"(?iu)^\s*(?:appendix|appendices|phụ lục|acknowledge?ments?|supplementary material)\b[^.]{0,70}$"


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text, section) of every line: body, bibliography from the last of its headings on, appendix after that.

    Without a heading, the bibliography is the last run of three or more numbered lines that ends the text."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    per = Window.partitionBy("doc_id")
    after = per.orderBy("line")
    head, numbered = F.col("text").rlike(BIBLIOGRAPHY), F.col("text").rlike(r"^\s*(\[\d+\]|\d{1,3}\.)\s+\S")
    marked = lines.withColumn("bib", F.max(F.when(head, F.col("line"))).over(per)).withColumn("other", F.max(F.when(~numbered & (F.trim("text") != ""), F.col("line"))).over(per)).withColumn("entries", F.count_if(numbered & (F.col("line") > F.coalesce("other", F.lit(-1)))).over(per))
    start = F.coalesce(F.col("bib"), F.when(F.col("entries") >= 3, F.coalesce("other", F.lit(-1))))
    placed = marked.withColumn("start", start).withColumn("appendix", F.max(F.when((F.col("line") > F.col("start")) & F.col("text").rlike(APPENDIX), 1).otherwise(0)).over(after.rowsBetween(Window.unboundedPreceding, 0)))
    section = F.when(F.col("start").isNull() | (F.col("line") <= F.when(F.col("bib").isNull(), F.col("start")).otherwise(F.col("start") - 1)), "body").when(F.col("appendix") == 1, "appendix").otherwise("bibliography")
    return placed.select("doc_id", "line", "text", section.alias("section"))


def reference_entries(lines: DataFrame) -> DataFrame:
    """(doc_id, entry, raw, marker) from lines (doc_id, line, text) of a bibliography.

    A line opens an entry if it begins with ``[n]`` or ``n.``, or, where no line does, with an author before a year; others go on."""
    text = F.trim("text")
    number = F.coalesce(F.nullif(F.regexp_extract(text, r"^\[(\d+)\]\s*\S", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^(\d{1,3})\.\s+\S", 1), F.lit(""))).cast("int")
    author = text.rlike(r"^[A-ZÀ-Ý][\w'’\-]+,\s+[A-ZÀ-Ý].*\(?(19|20)\d{2}")
    real = lines.where((text != "") & ~F.col("text").rlike(BIBLIOGRAPHY)).select("doc_id", "line", text.alias("text"), number.alias("marker"), author.alias("author"))
    any_ = F.count("marker").over(Window.partitionBy("doc_id"))
    opened = real.withColumn("open", F.when(any_ > 0, F.col("marker").isNotNull()).otherwise(F.col("author")))
    order = Window.partitionBy("doc_id").orderBy("line")
    entry = F.count_if("open").over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = opened.withColumn("entry", entry).where("entry > 0")
    joined = parts.groupBy("doc_id", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("raw"), F.min_by("marker", "line").alias("marker"))
    return joined.select("doc_id", "entry", F.regexp_replace("raw", r"^(\[\d+\]|\d{1,3}\.)\s*", "").alias("raw"), "marker")


# Shapes of reference entries in order of priority; groups are authors, title, venue and year as numbered.
ENTRY_STYLES = (
    ("apa", r"^(.+?)\s*\(((?:18|19|20)\d{2})[a-z]?\)\.?\s*([^.]+?)\.\s*(.+)$", (1, 3, 4, 2)),
    ("ieee", r'^(.+?),\s*["“]([^"”]+?),?["”],?\s*(.+?),?\s*((?:18|19|20)\d{2})\.?$', (1, 2, 3, 4)),
    ("mla", r'^(.+?)\.\s*["“]([^"”]+?)\.?["”]\s*(.+?),\s*((?:18|19|20)\d{2})\b.*$', (1, 2, 3, 4)),
    ("vancouver", r"^([^.]+?)\.\s*([^.]+?)\.\s*([^.]+?)\.\s*((?:18|19|20)\d{2})\b.*$", (1, 2, 3, 4)),
    ("chicago", r"^(.+?)\.\s*((?:18|19|20)\d{2})\.\s*([^.]+?)\.\s*(.+)$", (1, 3, 4, 2)),
)


def parse_entry(raw: Column) -> Column:
    """struct(style, authors, title, venue, year) of a reference entry by the first shape that fits; all null if none does."""
    out = F
    for style, pattern, groups in ENTRY_STYLES:
        part = lambda g, pattern=pattern: F.nullif(F.trim(F.regexp_extract(raw, pattern, g)), F.lit(""))
        a, t, v, y = groups
        out = out.when(raw.rlike(pattern), F.struct(F.lit(style).alias("style"), part(a).alias("authors"), part(t).alias("title"), part(v).alias("venue"), part(y).alias("year")))
    none = F.lit(None).cast("string")
    return out.otherwise(F.struct(*[none.alias(c) for c in ("style", "authors", "title", "venue", "year")]))


def context(text: Column, start: Column, end: Column, around: int = 100, reach: int = 20) -> Column:
    """The text ``around`` characters to either side of a span, on to the next blank within ``reach`` more."""
    left = F.greatest(start - around, F.lit(0))
    before = F.substr(text, F.greatest(left - reach, F.lit(0)) + 1, left - F.greatest(left - reach, F.lit(0)))
    more_left = F.when(before.contains(" ") | (F.length(before) < reach), F.length(F.substring_index(before, " ", -1))).otherwise(0)
    after = F.substr(text, end + around + 1, F.lit(reach))
    more_right = F.when(after.contains(" ") | (F.length(after) < reach), F.length(F.substring_index(after, " ", 1))).otherwise(0)
    return F.trim(F.substr(text, left - more_left + 1, end + around + more_right - left + more_left))


def style_profile(body: DataFrame, entries: DataFrame, few: int = 5, mixed: float = 0.3, unknown: float = 0.15) -> DataFrame:
    """(doc_id, apa, ieee, style, confidence) from occurrences (doc_id, raw, kind) and entries (doc_id, raw, style)."""
    numeric = (F.col("kind") == "numeric") | F.col("raw").rlike(r"\[\d+(?:\s*[-,]\s*\d+)*\]")
    dated = ~numeric & F.col("raw").rlike(r"\([A-Z][^()]{0,80},\s*(19|20)\d{2}[a-z]?\)|\((19|20)\d{2}[a-z]?\)")
    b = body.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(dated).alias("a"), F.count_if(numeric).alias("i"))
    marked = F.col("raw").rlike(r"^\s*\[\s*\d+\s*\]")
    e = entries.groupBy("doc_id").agg(F.count("*").alias("m"), F.count_if(~marked & F.col("style").isin("apa", "harvard", "mla", "chicago", "cse")).alias("x"), F.count_if(marked | F.col("style").isin("ieee", "acm", "nature", "acs", "ama", "vancouver")).alias("y"))
    both = b.join(e, "doc_id", "full_outer").na.fill(0)
    share = lambda p, q: F.when(F.col("m") == 0, F.col(p) / F.col("n")).when(F.col("n") == 0, F.col(q) / F.col("m")).otherwise((F.col(p) / F.col("n") + F.col(q) / F.col("m")) / 2)
    scored = both.select("doc_id", "m", (F.col("n") + F.col("m")).alias("signals"), share("a", "x").alias("apa"), share("i", "y").alias("ieee"))
    best = F.greatest("apa", "ieee")
    vague = (F.col("signals") < few) | (best < unknown)
    style = F.when(vague, "UNKNOWN").when((F.col("apa") > mixed) & (F.col("ieee") > mixed), "MIXED").when((F.col("apa") > F.col("ieee")) & (F.col("apa") > 0.5), "APA-like").when((F.col("ieee") > F.col("apa")) & (F.col("ieee") > 0.5), "IEEE-like").otherwise("UNKNOWN")
    sure = F.when(style.endswith("-like") & (F.col("m") > 0), F.least(F.lit(1.0), best + 0.1)).otherwise(best)
    return scored.select("doc_id", "apa", "ieee", style.alias("style"), sure.alias("confidence"))
