"""Candidates of several sources for one citation: quality, identity, fusion and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import fingerprint

# Registrants whose DOIs were made up.
BAD_DOIS = ("10.1234", "10.9999", "10.0000", "10.null")


def quality_flags(title: Column, authors: Column, doi: Column, review: Column, least_title: int = 10) -> dict[str, Column]:
    """Reasons to leave a candidate out, each true or false."""
    t = F.trim(F.coalesce(title, F.lit("")))
    titled = F.coalesce(title, F.lit("")) != ""
    bare = F.regexp_replace(t, r"[^\p{L}\p{N}]", "")
    return {
        "only_year": titled & (F.length(t) <= 4),
        "short_title": titled & (F.length(t) < least_title),
        "review": review,
        "no_author": F.coalesce(F.size(authors), F.lit(0)) < 1,
        "bad_doi": F.coalesce(F.lower(doi).rlike("^(" + "|".join(d.replace(".", r"\.") for d in BAD_DOIS) + ")"), F.lit(False)),
        "garbage": titled & ((F.length(bare) < 3) | bare.rlike(r"^\d+$")),
    }


def same_work(candidates: DataFrame) -> DataFrame:
    """candidates with ``work``: the earliest candidate (by seq) of a citation that is the same work.

    Candidates are one by DOI or title fingerprint, and a title ties candidates with and without a DOI."""
    title = F.when(F.length(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]", "")) >= 6, F.substring(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]", ""), 1, 120))
    keyed = candidates.withColumn("print", F.coalesce(fingerprint(F.col("doi"), F.col("title")), F.concat(F.lit("seq:"), F.col("seq").cast("string")))).withColumn("title_print", F.coalesce(title, F.col("print")))
    first = lambda *keys: F.min("seq").over(Window.partitionBy("citation_id", *keys))
    # The first with this fingerprint, then the first whose title is its own, then that one's fingerprint again.
    one = keyed.withColumn("by_print", first("print")).withColumn("by_title", first("title_print"))
    two = one.withColumn("root", F.least("by_print", "by_title")).withColumn("root", F.min("root").over(Window.partitionBy("citation_id", "print"))).withColumn("work", F.min("root").over(Window.partitionBy("citation_id", "title_print")))
    return two.drop("print", "title_print", "by_print", "by_title", "root")


def fuse_works(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """(citation_id, work, sources, fields): of each work the fields of its most confident candidate that has them, and how many sources agree."""
    w = same_work(candidates.where("found"))
    order = lambda c: F.struct(-F.col("confidence"), "seq")
    return w.groupBy("citation_id", "work").agg(F.countDistinct("source_name").alias("sources"), *[F.expr(f"min_by({c}, struct(-confidence, seq)) filter (where {c} is not null)").alias(c) for c in fields])


def consensus(candidates: DataFrame, queried: str = "queried", strong: int = 2) -> DataFrame:
    """(citation_id, consensus, score, strong): the most sources that agree on one work, over those asked."""
    prints = candidates.where("found").withColumn("print", fingerprint(F.col("doi"), F.col("title"))).where("print is not null")
    per = prints.groupBy("citation_id", "print").agg(F.sum(F.coalesce("merged", F.lit(1))).alias("n")).groupBy("citation_id").agg(F.max("n").alias("consensus"))
    asked = candidates.groupBy("citation_id").agg(F.max(queried).alias("asked"))
    both = asked.join(per, "citation_id", "left").select("citation_id", F.coalesce("consensus", F.lit(0)).alias("consensus"), "asked")
    return both.select("citation_id", "consensus", F.when(F.col("asked") > 0, F.col("consensus") / F.col("asked")).otherwise(0.0).alias("score"), (F.col("consensus") >= strong).alias("strong"))
