"""Catalogue lookups, writes keyed by identifiers, and merging of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import merge_key, title_key
from ..functions.normalize import normalize_arxiv, normalize_doi, present

# Sources that are caches, and the one that nothing replaces.
CACHES, KEPT_SOURCE = ("local_db", "known_papers"), "acl"


def lookup(papers: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id) of papers by the DOI or arXiv id of asked (query_id, doi, arxiv_id), case and form aside; a DOI goes first."""
    by = lambda key, normal, prio: asked.select("query_id", normal(F.col(key)).alias("k")).where("k is not null").join(papers.select(normal(F.col(key)).alias("k"), "id").where("k is not null"), "k").select("query_id", "id", F.lit(prio).alias("prio"))
    return by("doi", normalize_doi, 0).unionByName(by("arxiv_id", normalize_arxiv, 1)).groupBy("query_id").agg(F.min_by("id", F.struct("prio", "id")).alias("id"))


def upsert_papers(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base merged with changes by DOI; both (id, doi, title, authors, year, venue, abstract, source).

    A change without a DOI goes to the paper without one of equal title and year, and only fills its
    abstract; of changes with one key the last (largest id) counts, as if they came one after the other.
    What a change has wins, what it lacks stays; a cache does not replace a live source, nor anything
    KEPT_SOURCE. Changes that meet nothing are added with their own ids."""
    doi = normalize_doi(F.col("doi"))
    loose = F.concat_ws("|", title_key(F.col("title")), F.coalesce(F.col("year").cast("string"), F.lit("")))
    key = F.when(doi.isNotNull(), F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("title:"), loose))
    b = base.withColumn("doi", doi).withColumn("key", key)
    c = changes.withColumn("doi", doi).withColumn("key", key)
    newest = lambda x: F.expr(f"max_by({x}, id) filter (where {x} is not null and cast({x} as string) <> '')")
    last = c.groupBy("key").agg(F.max("id").alias("c_id"), F.max("doi").alias("c_doi"), *[newest(x).alias(f"c_{x}") for x in ("title", "year", "venue", "abstract", "source")], F.expr("max_by(authors, id) filter (where size(authors) > 0)").alias("c_authors"))
    one = b.groupBy("key").agg(F.min("id").alias("id"))  # further papers of a key stay as they are
    joined = b.join(one.select("id", F.lit(True).alias("first")), "id", "left").withColumn("join_key", F.when(F.col("first"), F.col("key")).otherwise(F.concat(F.lit("id:"), F.col("id").cast("string")))).join(last.withColumnRenamed("key", "join_key"), "join_key", "full_outer")
    new, exact = F.col("id").isNull(), F.col("c_doi").isNotNull()
    pick = lambda x: F.when(new | exact, F.coalesce(f"c_{x}", x)).otherwise(F.col(x))
    abstract = F.when(new | exact, F.coalesce(F.nullif("c_abstract", F.lit("")), "abstract")).otherwise(F.coalesce(F.nullif("abstract", F.lit("")), "c_abstract", "abstract"))
    source = F.when(new, F.col("c_source")).when(~exact | (F.col("c_source").isin(*CACHES) & ~F.col("source").isin(*CACHES)) | ((F.col("source") == KEPT_SOURCE) & (F.col("c_source") != KEPT_SOURCE)), F.col("source")).otherwise(F.coalesce("c_source", "source"))
    return joined.select(F.coalesce("id", "c_id").alias("id"), F.coalesce("doi", "c_doi").alias("doi"), *[pick(x).alias(x) for x in ("title", "authors", "year", "venue")], abstract.alias("abstract"), source.alias("source"))


def log_rows(queries: DataFrame, params: list[str]) -> DataFrame:
    """queries (id, found, source, paper_id, queried_at and params) as rows of the log: a hash stands for the parameters by name."""
    return queries.select("id", F.md5(F.to_json(F.struct(*sorted(params)))).alias("query_hash"), F.when(F.col("found"), 1).otherwise(0).alias("found"), "source", "paper_id", "queried_at")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """rows whose key no parent has; a null key is none."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def paper_predicate(title: Column, authors: Column, year: Column, q_title: Column, q_authors: Column, q_year: Column) -> Column:
    """Whether a paper fits a query: title contained, year within one, one of the first three authors contained; what either lacks fits."""
    t = present(q_title).isNull() | present(title).isNull() | F.lower(title).contains(F.lower(q_title))
    y = F.coalesce(q_year, F.lit(0)).eqNullSafe(F.lit(0)) | F.coalesce(year, F.lit(0)).eqNullSafe(F.lit(0)) | (F.abs(q_year - year) <= 1)
    known = (F.coalesce(F.size(q_authors), F.lit(0)) > 0) & (F.coalesce(F.size(authors), F.lit(0)) > 0)
    named = F.exists(F.slice(q_authors, 1, 3), lambda q: F.exists(authors, lambda a: F.lower(a).contains(F.lower(q))))
    return t & y & (~known | F.coalesce(named, F.lit(False)))


def merge_citations(references: DataFrame, body: DataFrame, appendix: DataFrame) -> DataFrame:
    """(doc_id, pos, raw, style, part): of citations with one style and identifier the first, references going before body and appendix."""
    parts = [(references, 0, "references"), (body, 1, "body"), (appendix, 2, "appendix")]
    every = [df.select("doc_id", "pos", "raw", "style", F.lit(name).alias("part"), F.lit(i).alias("prio")) for df, i, name in parts]
    rows = every[0].unionByName(every[1]).unionByName(every[2])
    best = Window.partitionBy("doc_id", "style", merge_key(F.col("raw"))).orderBy("prio", "pos")
    return rows.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "prio")


def distinct_contexts(occurrences: DataFrame, most: int = 8, length: int = 120) -> DataFrame:
    """(doc_id, reference_id, pos, focal): of the first ``most`` contexts of a reference those that begin differently."""
    w = Window.partitionBy("doc_id", "reference_id").orderBy("pos")
    first = occurrences.where("trim(focal) <> ''").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    key = Window.partitionBy("doc_id", "reference_id", F.lower(F.substring("focal", 1, length))).orderBy("pos")
    return first.withColumn("k", F.row_number().over(key)).where("k = 1").select("doc_id", "reference_id", "pos", "focal")


def bootstrap(rows: DataFrame, value: Column, key: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """(mean, low, high): the mean of a value and its 95 % interval over resamples in which each row counts Poisson(1) times.

    How often a row counts in a round comes from a hash of its key, so reruns agree; each task sums its rows for all rounds."""
    u = lambda b: F.pmod(F.xxhash64(F.col(key), F.lit(seed), b), F.lit(1_000_003)) / F.lit(1_000_003.0)
    times = F.expr("case when u < 0.36787944 then 0 when u < 0.73575888 then 1 when u < 0.91969860 then 2 when u < 0.98101184 then 3 when u < 0.99634015 then 4 when u < 0.99940582 then 5 else 6 end")
    each = rows.select(key, value.cast("double").alias("v")).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("u", u(F.col("round"))).withColumn("n", times)
    per = each.groupBy("round").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m"))
    real = rows.agg(F.avg(value.cast("double")).alias("mean"))
    return per.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")).join(F.broadcast(real)).select("mean", "low", "high")
