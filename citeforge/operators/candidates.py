"""Choosing among the candidates that sources return for a citation; all by aggregates that combine partially."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidate_score() -> Column:
    """From doi_match, title_sim, author_sim, year_match and confidence; missing ones count nothing."""
    of = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return 2 * of("doi_match") + of("title_sim") + 0.5 * of("author_sim") + 0.2 * of("year_match") + 0.05 * of("confidence")


def best_candidate(features: DataFrame) -> DataFrame:
    """(citation_id, seq, source_name, score) of the found candidate of highest score; the first of equal ones."""
    f = features.where("found").withColumn("score", candidate_score())
    return f.groupBy("citation_id").agg(F.max_by(F.struct("seq", "source_name", "score"), F.struct("score", -F.col("seq"))).alias("best")).select("citation_id", "best.*")


def fuse(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """(citation_id, *fields, n): each field from the first found candidate that has it, and how many were found."""
    first = lambda x: F.min_by(x, F.when(F.col(x).isNotNull(), F.col("seq"))).alias(x)
    return candidates.where("found").groupBy("citation_id").agg(*[first(x) for x in fields], F.count("*").alias("n"))
