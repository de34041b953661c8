"""The passage of a text that best fits a reference which it cites nowhere.

A text's windows of two sentences are found with column expressions; one Arrow UDF a batch puts the words of a
text's windows into an inverted index and lets its references probe it. A reference goes through the lists of its
words in order of rarity. Once eight windows are sure to beat whatever has none of the words so far, lists add to
known windows only. Of the eight windows with most hits, the one that holds the greatest share of the
reference's own words (containment, asymmetric) is its passage.

A title's word counts 2, an author's surname 3, a phrase of another language that stands for one of the title's 2.2, and a longer
window up to 0.87. Windows that look like an entry of a reference list, or hold the title itself, do not count.

Defined results: a null or short text, a reference without title, and one without any hit give no row; ties go to
the earlier window; references of one text are told apart by ``ref``; texts and references that repeat a doc_id
meet as in any join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.context import _DOT, dehyphenate, protect

# Words of titles that say nothing of their subject.
COMMON = (
    "the", "and", "for", "with", "from", "using", "based", "edition",
    "guide", "definitive", "introduction", "learning", "pro", "good", "parts",
    "techniques", "development", "theory", "study", "analysis",
)
# Least lengths of texts, windows and sentences; how many windows are compared; weights.
TEXT_LEAST, WINDOW_LEAST, SENTENCE_LEAST, COMPARED = 60, 45, 25, 8
TITLE_WEIGHT, AUTHOR_WEIGHT, CUE_WEIGHT = 2.0, 3.0, 2.2
#: Words, as RE2, Java and Python read them.
WORD = "[a-zA-ZÀ-ỹ0-9]{3,}"
ENTRY = r"\b[A-ZÀ-Ỹ][a-zà-ỹ]+,\s+[A-Z]\.(?:.*?\(\s*(?:19|20)\d{2}[a-z]?\s*\))"
# What marks an entry of a reference list.
ENTRY_MARKS = ("in proceedings of", "https://doi.org/", "arxiv preprint")
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_FOUND = "array<struct<ref:bigint,place:int,passage:string,hits:double,similarity:double>>"


def sentences(text: Column) -> Column:
    """Sentences of 25 characters or more, lines joined and broken words mended."""
    parts = F.split(protect(dehyphenate(text)), r"[.!?]+(?:\s+|$)|\n+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit(_DOT), F.lit(".")))), lambda p: F.length(p) >= SENTENCE_LEAST)


def windows(text: Column, s: Column) -> Column:
    """struct(place, passage): two of a text's sentences s on end each, none that is an entry of a reference list; no text with a table of contents has any.

    s has to be a column that is made once, not an expression, which would be made again for each window."""
    two = F.transform(s, lambda p, i: F.struct(i.cast("int").alias("place"), F.trim(F.array_join(F.slice(s, i + 1, 2), " ")).alias("passage")))
    entry = lambda p: p.rlike(ENTRY) | F.lower(p).rlike("|".join(re.escape(m) for m in ENTRY_MARKS))
    kept = F.filter(two, lambda w: (F.length(w["passage"]) >= WINDOW_LEAST) & ~entry(w["passage"]))
    fit = (F.length(F.trim(text)) >= TEXT_LEAST) & ~text.contains("......") & ~F.upper(text).contains("TABLE OF CONTENTS")
    return F.when(fit, kept)


def _words(text: str | None) -> list[str]:
    return list(dict.fromkeys(re.findall(WORD, (text or "").lower())))


def _passage(ref, places, passages: list[str], index: dict[str, list[int]], cues: list[tuple[str, list[str]]], lows: list[str] | None = None):
    """(place, passage, hits, similarity) of a reference, or None. lows: the passages in lower case, if they are known."""
    lows = [p.lower() for p in passages] if lows is None else lows
    title = [w for w in _words(ref["title"]) if w not in COMMON]
    names = {re.sub(r"[^a-zA-ZÀ-ỹ]", "", a.split(",")[0].split()[0]).lower() for a in ref["authors"] if a and len(a.strip()) >= 3 and a.split(",")[0].split()}
    source = f"{ref['title']} {ref['abstract'] or ''}".lower()
    weight: dict[str, float] = {}
    for w in title:
        weight[w] = TITLE_WEIGHT
    for w in names - {""}:
        weight[w] = weight.get(w, 0.0) + AUTHOR_WEIGHT
    lists = [(w, index[w]) for w in sorted(weight, key=lambda w: (len(index.get(w, ())), w)) if w in index]
    hits: dict[int, float] = {}
    # Windows that hold the title are out from the start: those that are counted as sure to win have to be able to.
    head = re.sub(r"\s+", " ", ref["title"].lower().strip())[:35]
    held = {i for i, p in enumerate(lows) if head in p and (len(head) >= 24 or _YEAR.search(p))} if len(head) >= 12 else set()
    # Phrases are looked for in whole windows; they have no lists.
    for phrase, equal in cues:
        if any(e in source for e in equal):
            for i, p in enumerate(lows):
                if phrase in p and i not in held:
                    hits[i] = hits.get(i, 0.0) + CUE_WEIGHT
    left, closed = sum(weight[w] for w, _ in lists), False
    for w, rows in lists:
        if not closed and len(hits) >= COMPARED:
            # What no list so far holds can reach the rest's weights and the greatest bonus at most.
            sure = sorted((h + min(len(passages[i]), 260) / 300.0 for i, h in hits.items()), reverse=True)
            closed = sure[COMPARED - 1] > left + 260 / 300.0
        for i in rows:
            if i in hits or not closed and i not in held:
                hits[i] = hits.get(i, 0.0) + weight[w]
        left -= weight[w]
    scored = [(-round(h + min(len(passages[i]), 260) / 300.0, 9), i) for i, h in hits.items()]
    asked = set(_words(f"{ref['title']}. {(ref['abstract'] or '')[:320]}"))
    best = None
    for score, i in sorted(scored)[:COMPARED]:
        share = len(asked & set(_words(passages[i]))) / len(asked) if asked else 0.0
        if best is None or share > best[3]:
            best = (places[i], passages[i], -score, share)
    return best


def discover(texts: DataFrame, references: DataFrame, cues: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, ref, place, passage, hits, similarity) for references (doc_id, ref, title, abstract, authors) of texts (doc_id, text).

    cues: phrases of another language, and the words that they stand for. place numbers a text's sentences from 0."""
    known = [(phrase, re.findall("[a-z0-9-]{3,}", equal.lower())) for phrase, equal in (cues or {}).items()]
    own = references.where("trim(coalesce(title, '')) <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ref").cast("bigint").alias("ref"), "title", F.col("abstract").cast("string").alias("abstract"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors")))).alias("refs"))

    @F.pandas_udf(_FOUND)
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for found, refs in batches:
            out = []
            for mine, asked in zip(found, refs):
                rows = [] if mine is None else list(mine)
                passages, index = [w["passage"] for w in rows], {}
                lows = [p.lower() for p in passages]
                for i, p in enumerate(passages):
                    for word in _words(p):
                        index.setdefault(word, []).append(i)
                got = []
                for ref in asked:
                    hit = _passage(ref, [w["place"] for w in rows], passages, index, known, lows) if rows else None
                    if hit:
                        got.append({"ref": ref["ref"], "place": hit[0], "passage": hit[1], "hits": hit[2], "similarity": hit[3]})
                out.append(got)
            yield pd.Series(out)

    met = texts.select("doc_id", "text").join(own, "doc_id").withColumn("sentences", sentences(F.col("text")))
    met = met.select("doc_id", windows(F.col("text"), F.col("sentences")).alias("windows"), "refs")
    return met.select("doc_id", F.explode(probe("windows", "refs")).alias("f")).select("doc_id", "f.*")
