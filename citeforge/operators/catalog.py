"""Catalogue maintenance, search and write-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .postings import B, K1, words_of


def survivors(papers: DataFrame, refs: DataFrame, key) -> DataFrame:
    """(id, survivor_id) for papers that share a key: most referred to, then smallest id, survives."""
    counted = papers.withColumn("key", key).where("key is not null").join(refs.groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("refs")), "id", "left").select("id", "key", F.coalesce("refs", F.lit(0)).alias("refs"))
    # The survivor is an aggregate, so a key with many papers is combined before the shuffle.
    best = counted.groupBy("key").agg(F.min_by("id", F.struct(-F.col("refs"), "id")).alias("survivor_id"), F.count("*").alias("copies")).where("copies > 1")
    return counted.join(best, "key").select("id", "refs", "survivor_id", "copies")


def bm25(papers: DataFrame, query: list[str], top: int = 10) -> DataFrame:
    """(id, score) of the best papers for any of the query's words, in millionths; weights as in :mod:`.postings`.

    For a single search without an index: texts are read once, and counts of the query's words written."""
    wanted = F.array(*[F.lit(q) for q in sorted(set(query))])
    n = papers.select("id", words_of(F.col("text")).alias("words"))
    counts = written(n.select("id", F.size("words").alias("len"), F.transform(wanted, lambda q: F.size(F.filter("words", lambda w: w == q))).alias("tf")), "bm25-counts")
    held = [F.sum(F.when(F.col("tf")[i] > 0, 1).otherwise(0)) for i in range(len(set(query)))]
    size = counts.agg(F.count("*").alias("total"), F.sum("len").alias("words"), F.array(*held).alias("df")).where("total > 0")
    one = counts.where("exists(tf, x -> x > 0)").join(F.broadcast(size))
    idf = lambda df: F.greatest(F.ln((F.col("total") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    gain = lambda tf, df: F.round(idf(df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") * F.col("total") / F.col("words"))) * 1e6).cast("long")
    score = F.aggregate(F.zip_with("tf", "df", gain), F.lit(0).cast("long"), lambda a, x: a + x)
    return one.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(top)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with changes merged by key: what a change has wins, what it lacks stays."""
    columns = [c for c in base.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return base.join(new, key, "full_outer").select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])


def keep_best(rows: DataFrame, key: list[str], quality: list) -> DataFrame:
    """The first row of each key in the order of quality."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*quality))).where("_n = 1").drop("_n")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of rows in an order that has to be total."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def hashed_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows at random, the same ones for the same seed."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(n)


# Titles that are no paper's, the years and lengths of good records.
NOT_A_TITLE = (
    r"(?i)(?:this\s+essay|comprehensive\s+survey|comprehensive\s+review|introduction\s+to\s+|abstract\s+|survey\s*$|:?\s*survey\s+of\s+|a\s+(?:brief\s+)?(?:survey|review|introduction)|"
    r"^\s*(?:deep\s+learning|natural\s+language\s+processing)|[{}\\]|^proceedings\s+of|^book\s+reviews?)"
)
TITLE_LENGTHS, YEARS, SURNAME_LEAST = (18, 180), (1995, 2026), 3


def quality_sample(papers: DataFrame, seed: int, n: int, prefer_with_doi: bool = True) -> DataFrame:
    """n good records of papers (id, doi, title, authors, year, abstract) at random, the same ones for the same seed; no two of one title.

    A good one has a title of one sentence and of fair length, a first author with a surname, a year, and with prefer_with_doi a
    DOI. Records with an abstract come before those without."""
    t = F.regexp_replace(F.trim(F.coalesce("title", F.lit(""))), r"\.+$", "")
    good = F.length(t).between(*TITLE_LENGTHS) & ~t.rlike(r"[.?!]") & ~t.rlike(NOT_A_TITLE) & F.col("year").between(*YEARS)
    named = F.length(F.regexp_replace(F.coalesce(F.get("authors", F.lit(0)), F.lit("")), r"[^A-Za-zÀ-ÿ]", "")) >= SURNAME_LEAST
    kept = papers.where(good & named & ((F.trim(F.coalesce("doi", F.lit(""))) != "") if prefer_with_doi else F.lit(True)))
    order = F.struct((F.trim(F.coalesce("abstract", F.lit(""))) == "").alias("bare"), F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{seed}"))).alias("h"), "id")
    one = kept.withColumn("o", order).groupBy(F.lower(t).alias("key")).agg(F.min_by(F.struct(*papers.columns), "o").alias("p"), F.min("o").alias("o"))
    return one.orderBy("o").limit(n).select("p.*")


def like_search(papers: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id) of papers (id, title, authors, year) whose title holds the asked words in order as they stand, whatever their case, of that year and with an author whose name holds the asked one.

    asked: (query_id, title, author, year); what is null or empty does not narrow. The title's longest word has to stand in the paper's, so pairs come from an equi-join."""
    longest = F.array_max(F.transform(words_of(F.col("title")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    q = asked.select("query_id", F.lower(F.trim("title")).alias("asked"), F.lower(F.trim(F.coalesce("author", F.lit("")))).alias("author"), F.col("year").cast("int").alias("of_year"), longest.alias("word")).where("word is not null")
    p = papers.select("id", F.lower("title").alias("held"), F.lower(F.array_join("authors", "\n")).alias("names"), F.col("year").cast("int").alias("year"))
    # Titles and questions are compared once, copies of either meet the result alone; titles go by a digest until they are read.
    p, q = p.withColumn("kind", F.md5(F.to_json(F.struct("held", "names", "year")))), q.withColumn("question", F.md5(F.to_json(F.struct("asked", "author", "of_year", "word"))))
    titles = p.groupBy("kind").agg(F.first("held").alias("held"), F.first("names").alias("names"), F.first("year").alias("year"))
    questions = q.groupBy("question").agg(*[F.first(c).alias(c) for c in ("asked", "author", "of_year", "word")])
    of_word = titles.select("kind", "names", "year", F.explode(F.array_distinct(words_of(F.col("held")))).alias("word"))
    fits = F.col("names").contains(F.col("author")) & (F.col("of_year").isNull() | (F.col("of_year") == F.col("year")))
    met = questions.join(of_word, "word").where(fits).select("question", "asked", "kind")
    found = met.join(titles.select("kind", "held"), "kind").where(F.col("held").contains(F.col("asked"))).select("question", "kind")
    return found.join(q.select("question", "query_id"), "question").join(p.select("kind", "id"), "kind").select("query_id", "id")
