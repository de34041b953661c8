"""Reference lists without markers: where one hides in a text, and how its lines fall into entries.

A hidden list is the run of lines of greatest sum, entries counting for and prose against it, from running sums over the
lines of texts that have enough entries at all; only counts of lines are shuffled. A list's best cut is found by dynamic
programming over all cuts in one ordered fold over a list's lines, the state being how many years the entry has so far.

Defined results: a null or empty text has no list and no entries; a list of one line is one entry; of equal cuts the one
with fewer entries, then the one that cuts later; of equal runs the one that ends first, then the shorter one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Lines that begin like an entry of a numbered list, and prose.
BRACKET_LINE = r"^\s*\[\d+\](?:\s+\S|\s*$)"
DOT_LINE = r"^\s*(\d{1,3})\.(?:\s+[A-ZÀ-Ý]|\s*$)"
PROSE_LINE = r"\.\s*$"
YEAR = r"\b(?:18|19|20)\d{2}\b"
#: A run with this share of entry lines among entry and prose lines, and so many of them, is a list: 7 * entries >= 3 * prose.
ENTRY_GAIN, PROSE_COST, LEAST_ENTRIES, LEAST_YEARS = 7, 3, 3, 3

# How a line of a list begins and ends, for the cut.
AUTHOR_START = r"^\p{Lu}[\p{L}'’\-]+,\s+\p{Lu}"
UPPER_START = r"^[\p{Lu}\"“]"
GOES_ON = r"^(?:URL\b|https?:|doi:|DOI:|ISBN\b|ISSN\b|arXiv:|volume\b|vol\.|pages\b|pp\.|In\s)"
CLOSED_END = r"(?:[.\d]|https?://\S+)$"
PUBLISHED = r"\b(?:18|19|20)\d{2}[a-z]?\b"
#: Scores of an entry's first line, of its last one, and of 0, 1, 2, 3 or more years in it.
AUTHOR_GAIN, UPPER_GAIN, ELSE_COST, GOES_ON_COST, END_GAIN, END_COST, YEARS = 3, 1, 3, 4, 2, 2, (-3, 3, 0, -3)
INLINE = r"(?<=[.)\d/])\s+(?=\p{Lu}[\p{L}'’\-]+,\s+\p{Lu}\.)"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r?\n")


def implicit_lists(texts: DataFrame) -> DataFrame:
    """(doc_id, first, last, entries, years) of the run of lines, from the middle of each text (doc_id, text) on, with most entries over prose.

    Lines count from 0. A line is an entry's if it begins with a number in brackets, or with one and a full stop that
    goes on from the numbered line before or leads to the next one. Without three lines in brackets three years are
    needed; texts without such a run give no row."""
    # Only texts with three such lines go on, and of their lines no more than what they are. No filter on the texts, which would
    # take what they are made of apart and make it again for each reference.
    lines = texts.select("doc_id", lines_of(F.col("text")).alias("lines"))
    likely = F.size(F.filter("lines", lambda x: x.rlike(BRACKET_LINE) | x.rlike(DOT_LINE))) >= LEAST_ENTRIES
    each = lines.select("doc_id", F.size("lines").alias("of"), F.posexplode(F.when(likely, F.col("lines"))).alias("line", "x")).where("line >= of DIV 2")
    years = F.size(F.regexp_extract_all("x", F.lit(f"({YEAR})"), F.lit(1)))
    t = each.select("doc_id", "line", F.col("x").rlike(BRACKET_LINE).alias("bracket"), F.when(F.col("x").rlike(DOT_LINE), F.regexp_extract("x", DOT_LINE, 1).try_cast("int")).alias("number"), F.col("x").rlike(PROSE_LINE).alias("prose"), years.alias("years"))
    ordered = Window.partitionBy("doc_id").orderBy("line")
    before = F.last("number", True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("number", True).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    t = t.withColumn("goes_on", (F.coalesce(before, F.lit(-9)) == F.col("number") - 1) | (F.coalesce(after, F.lit(-9)) == F.col("number") + 1))
    # A number that goes on somewhere counts wherever the text has it.
    t = t.withColumn("goes_on", F.max("goes_on").over(Window.partitionBy("doc_id", "number")))
    entry = F.col("bracket") | F.coalesce("goes_on", F.lit(False))
    t = t.withColumn("entry", entry).withColumn("w", F.when(F.col("entry"), ENTRY_GAIN).when(F.col("prose"), -PROSE_COST).otherwise(0))
    counts = {"w": F.col("w"), "n": F.col("entry").cast("int"), "k": F.col("bracket").cast("int"), "y": F.col("years")}
    upto = {c: F.sum(v).over(ordered) for c, v in counts.items()}
    t = t.select("doc_id", "line", *[upto[c].alias(c) for c in counts], F.struct((upto["w"] - counts["w"]).alias("w"), (-F.col("line")).alias("line"), *[(upto[c] - counts[c]).alias(c) for c in "nky"]).alias("gone"))
    # The run that ends here begins after the least sum so far, the last of equal ones.
    t = t.withColumn("from", F.min("gone").over(ordered))
    runs = t.select("doc_id", F.struct((F.col("w") - F.col("from.w")).alias("sum"), (-F.col("line")).alias("line"), (-F.col("from.line")).alias("first"), *[(F.col(c) - F.col(f"from.{c}")).alias(c) for c in "nky"]).alias("r"))
    best = runs.groupBy("doc_id").agg(F.max("r").alias("r")).where(f"r.sum > 0 and r.n >= {LEAST_ENTRIES} and (r.k >= 3 or r.y >= {LEAST_YEARS})")
    return best.select("doc_id", F.col("r.first").alias("first"), (-F.col("r.line")).alias("last"), F.col("r.n").cast("int").alias("entries"), F.col("r.y").cast("int").alias("years"))


def list_lines(text: Column) -> Column:
    """The list's lines without blanks around them, cut where an entry begins within a line."""
    return F.filter(F.transform(F.flatten(F.transform(lines_of(text), lambda x: F.split(x, INLINE))), lambda x: F.trim(x)), lambda x: x != "")


def _features(lines: Column) -> Column:
    starts = lambda x: F.when(x.rlike(GOES_ON), -GOES_ON_COST).when(x.rlike(AUTHOR_START), AUTHOR_GAIN).when(x.rlike(UPPER_START), UPPER_GAIN).otherwise(-ELSE_COST)
    ends = lambda x: F.when(x.rlike(CLOSED_END), END_GAIN).otherwise(-END_COST)
    years = lambda x: F.least(F.size(F.regexp_extract_all(x, F.lit(f"({PUBLISHED})"), F.lit(1))), F.lit(3))
    return F.transform(lines, lambda x, i: F.struct(starts(x).alias("s"), years(x).alias("y"), ends(F.coalesce(F.get(lines, i - 1), F.lit(""))).alias("e")))


def _cut(lines: list[dict]) -> str:
    """The fold over a list's lines: of each number of years so far the best (score, -entries, cuts), until the last line."""
    states: dict[int, tuple[int, int, str]] = {}
    for f in lines:
        closed = max(((score + YEARS[y], n, cuts) for y, (score, n, cuts) in states.items()), default=None)
        after: dict[int, tuple[int, int, str]] = {}
        for y, (score, n, cuts) in states.items():
            on = (score, n, cuts + "0")
            y = min(3, y + f["y"])
            after[y] = max(after[y], on) if y in after else on
        anew = (f["s"], -1, "1") if closed is None else (closed[0] + f["e"] + f["s"], closed[1] - 1, closed[2] + "1")
        after[f["y"]] = max(after[f["y"]], anew) if f["y"] in after else anew
        states = after
    return max(((score + YEARS[y], n, cuts) for y, (score, n, cuts) in states.items()), default=(0, 0, ""))[2]


@F.pandas_udf(StringType())
def _cuts(features: pd.Series) -> pd.Series:
    return features.map(lambda x: None if x is None else _cut(list(x)))


def best_cut(lines: Column) -> Column:
    """For each line "1" if an entry begins with it, else "0", as one string: the cut of greatest score.

    What lines look like are column expressions; the fold itself is small and goes over Arrow batches, since nested
    expressions would be evaluated many times a line."""
    return _cuts(_features(lines))


def joined(parts: Column) -> Column:
    """Wrapped lines as one: words and addresses that a line's end has broken are mended."""
    text = F.regexp_replace(F.array_join(parts, " "), r"(\p{L})-\s+(\p{Ll})", "$1$2")
    return F.regexp_replace(text, r"(https?://\S+[/\-_?&=])\s+([a-z0-9])", "$1$2")


def unmarked_entries(texts: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, entry, raw): the entries, from 0 on, of each list (doc_id, text) without markers that are longer than ``least`` characters."""
    t = texts.select("doc_id", list_lines(F.col("text")).alias("lines")).withColumn("cuts", best_cut(F.col("lines")))
    t = t.withColumn("first", F.filter(F.transform(F.split("cuts", ""), lambda c, i: F.when(c == "1", i + 1)), lambda i: i.isNotNull()))
    t = t.withColumn("raw", F.transform("first", lambda i, k: joined(F.slice("lines", i, F.coalesce(F.get(F.col("first"), k + 1), F.size("lines") + 1) - i))))
    return t.select("doc_id", F.posexplode(F.filter("raw", lambda e: F.length(e) > least)).alias("entry", "raw"))
