"""Foot- and endnotes linked to references: full notes, "ibid.", "op. cit." and "supra note n".

A full note meets references by equal keys alone: the DOI in it, a word that is a surname, words of titles. What it names
again later is an as-of join on (author, number of the note): the last full note before that named a work by that author,
first one of which the note repeats a word of the title. "ibid." takes the first work of the last linked note before it.

Defined results: a note that names nothing known gives no row; notes and references meet within a doc_id only; of several works of
one author an op. cit. takes the one whose title it repeats, else the last named; a reference without surname and title is
met by its DOI alone; null texts are no notes; notes that repeat a number within a text are taken as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.characters import ascii_letters
from ..sources.store import written

# How many words of a title count, how long they have to be, and how long a title's beginning is compared.
TITLE_WORDS, WORD_LEAST, PREFIX_LEAST, PREFIX_MOST = 5, 4, 12, 38
NOTE_LINE = r"^\s*(\d{1,3})[.)]?\s+(\S.*)$"
IBID = r"(?i)^\s*(?:see\s+)?(?:ibid(?:em)?|id)\b\.?"
OP_CIT = r"(?i)\b(?:op|loc)\.?\s*cit\b"
SUPRA = r"(?i)\bsupra\s+(?:note\s+|n\.\s*)(\d{1,3})\b"
DOI = r"(10\.\d{4,9}/[^\s\]\),;()]+)"


def note_lines(texts: DataFrame) -> DataFrame:
    """(doc_id, note, text) of the lines of texts (doc_id, text) that begin with a number; of a number met twice the first line."""
    lines = texts.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line", "x")).where(F.col("x").rlike(NOTE_LINE))
    rows = lines.select("doc_id", "line", F.regexp_extract("x", NOTE_LINE, 1).cast("int").alias("note"), F.trim(F.regexp_extract("x", NOTE_LINE, 2)).alias("text"))
    return rows.groupBy("doc_id", "note").agg(F.min_by("text", "line").alias("text"))


def _plain(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(ascii_letters(F.coalesce(x, F.lit("")))), r"[^a-z0-9]+", " "))


def _title_words(x: Column) -> Column:
    return F.slice(F.array_distinct(F.filter(F.split(_plain(x), " "), lambda w: F.length(w) >= WORD_LEAST)), 1, TITLE_WORDS)


def full_notes(notes: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, note, reference_id, author) of notes that name works themselves; references are (doc_id, reference_id, author, title, doi), author a surname."""
    n = notes.where(~F.col("text").rlike(IBID) & ~F.col("text").rlike(OP_CIT) & ~F.col("text").rlike(SUPRA)).select("doc_id", "note", _plain(F.col("text")).alias("plain"), F.rtrim(F.lower(F.regexp_extract("text", DOI, 1)), F.lit(".")).alias("doi"))
    words = n.select("doc_id", "note", F.explode(F.array_distinct(F.split("plain", " "))).alias("word"))
    r = references.select("doc_id", "reference_id", _plain(F.col("author")).alias("author"), _title_words(F.col("title")).alias("words"), _plain(F.col("title")).alias("title"), F.rtrim(F.lower(F.coalesce("doi", F.lit(""))), F.lit(".")).alias("r_doi"))
    r = r.withColumn("alone", F.count("*").over(Window.partitionBy("doc_id", "author")) == 1)
    # Keys of a reference: its author's words, kind 0, and its title's words, kind 1. Two words of a name both count once.
    keys = r.select("doc_id", "reference_id", F.explode(F.concat(F.transform(F.filter(F.split("author", " "), lambda w: F.length(w) >= 3), lambda w: F.struct(w.alias("word"), F.lit(0).alias("kind"))), F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(1).alias("kind"))))).alias("k")).select("doc_id", "reference_id", "k.*")
    met = words.join(keys, ["doc_id", "word"]).groupBy("doc_id", "note", "reference_id").agg(F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("hits"))
    both = met.join(r.drop("r_doi"), ["doc_id", "reference_id"]).join(n.drop("doi"), ["doc_id", "note"])
    spaced = F.concat(F.lit(" "), "plain", F.lit(" "))
    last = F.element_at(F.split("author", " "), -1)
    held = lambda x: spaced.contains(F.concat(F.lit(" "), x, F.lit(" ")))
    named = ((F.length("author") >= 3) & held(F.col("author"))) | (F.col("author").contains(" ") & (F.length(last) >= 4) & held(last))
    prefix = F.trim(F.substring("title", 1, PREFIX_MOST))
    sure = (named & ((F.col("hits") >= 1) | (F.col("alone") & (F.length("author") >= 4)))) | ((F.length(prefix) >= PREFIX_LEAST) & F.col("plain").contains(prefix)) | ((F.length("title") >= PREFIX_LEAST) & (F.size("words") >= 3) & (F.col("hits") >= 3))
    by_doi = n.where("doi <> ''").join(r.where("r_doi <> ''").select("doc_id", "reference_id", "author", F.col("r_doi").alias("doi")), ["doc_id", "doi"]).select("doc_id", "note", "reference_id", "author")
    return both.where(sure).select("doc_id", "note", "reference_id", "author").union(by_doi).distinct()


def link_notes(notes: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, note, reference_id, how): how is full, op_cit, supra or ibid; a full note gives a row for each work it names.

    Notes, references and what each step links are written, as several steps read them, and what they are made of may be dear."""
    notes, references = written(notes, "notes"), written(references, "note-references")
    full = written(full_notes(notes, references), "notes-full")
    words = references.select("doc_id", "reference_id", _title_words(F.col("title")).alias("words"))
    # op. cit.: the last full note before, by author and a word of the title, or else by author alone. Askers and full
    # notes are one sequence for each key; a name of two words is asked for by its last one.
    again = notes.where(F.col("text").rlike(OP_CIT)).select("doc_id", "note", F.array_distinct(F.split(_plain(F.col("text")), " ")).alias("said"))
    named = full.join(words, ["doc_id", "reference_id"]).withColumn("author", F.element_at(F.split("author", " "), -1))
    none = F.lit(None).cast(references.schema["reference_id"].dataType)

    def last_named(known: DataFrame, asked: DataFrame, keys: list[str], rank: int) -> DataFrame:
        line = known.select("doc_id", *keys, "note", F.lit(0).alias("asks"), "reference_id").unionByName(asked.select("doc_id", *keys, "note", F.lit(1).alias("asks"), none.alias("reference_id")))
        upto = Window.partitionBy("doc_id", *keys).orderBy("note", "asks", "reference_id").rowsBetween(Window.unboundedPreceding, -1)
        best = F.last(F.when(F.col("asks") == 0, F.struct("note", "reference_id")), True).over(upto)
        return line.withColumn("best", best).where("asks = 1 and best is not null").select("doc_id", "note", F.struct(F.lit(rank).alias("rank"), F.col("best.note").alias("note"), F.col("best.reference_id").alias("reference_id")).alias("best"))

    by_author = again.select("doc_id", "note", "said", F.explode("said").alias("author"))
    # Only authors whom a full note names have words to ask with.
    by_word = by_author.join(named.select("doc_id", "author").distinct(), ["doc_id", "author"], "left_semi").select("doc_id", "note", "author", F.explode("said").alias("word"))
    found = last_named(named, by_author, ["author"], 0).unionByName(last_named(named.withColumn("word", F.explode("words")), by_word, ["author", "word"], 1))
    op_cit = found.groupBy("doc_id", "note").agg(F.max("best").alias("b")).select("doc_id", "note", F.col("b.reference_id").alias("reference_id"), F.lit("op_cit").alias("how"))
    direct = full.select("doc_id", "note", "reference_id", F.lit("full").alias("how")).unionByName(written(op_cit, "notes-op-cit"))
    first = direct.groupBy("doc_id", "note").agg(F.min("reference_id").alias("reference_id"))
    supra = notes.where(F.col("text").rlike(SUPRA)).select("doc_id", "note", F.regexp_extract("text", SUPRA, 1).cast("int").alias("at")).join(first.withColumnRenamed("note", "at"), ["doc_id", "at"]).where("at < note").select("doc_id", "note", "reference_id", F.lit("supra").alias("how"))
    linked = direct.unionByName(written(supra, "notes-supra"))
    # ibid.: the last linked note before, whatever linked it.
    ibid = notes.where(F.col("text").rlike(IBID)).select("doc_id", "note", none.alias("reference_id"), F.lit(True).alias("asks"))
    known = linked.groupBy("doc_id", "note").agg(F.min("reference_id").alias("reference_id")).withColumn("asks", F.lit(False))
    earlier = Window.partitionBy("doc_id").orderBy("note").rowsBetween(Window.unboundedPreceding, -1)
    chained = known.unionByName(ibid).withColumn("reference_id", F.when(F.col("asks"), F.last("reference_id", True).over(earlier)).otherwise(F.col("reference_id"))).where("asks and reference_id is not null")
    return linked.unionByName(chained.select("doc_id", "note", "reference_id", F.lit("ibid").alias("how")))
