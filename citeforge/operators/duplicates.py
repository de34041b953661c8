"""References of one list that are nearly the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.authors import first_surname
from ..functions.normalize import jaccard, levenshtein_similarity

#: Below this, references of other years or first authors could reach the threshold, and blocks would miss them.
LEAST = 0.9


def reference_similarity(year: tuple[Column, Column], author: tuple[Column, Column], words: tuple[Column, Column]) -> Column:
    """0.2 for the year, 0.4 for the first author (0.3 if nearly equal), 0.4 times the Jaccard of title words."""
    same = F.coalesce((year[0] == year[1]) & (year[0].cast("string") != ""), F.lit(False))
    a, b = F.lower(author[0]), F.lower(author[1])
    close = F.when(a == b, 0.4).when(levenshtein_similarity(author[0], author[1]) > 0.8, 0.3).otherwise(0.0)
    return F.when(same, 0.2).otherwise(0.0) + F.coalesce(close, F.lit(0.0)) + 0.4 * F.coalesce(jaccard(*words), F.lit(0.0))


def similar_references(references: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(doc_id, reference_id, leader_id) for groups of two or more of references (doc_id, reference_id, order_index, authors, raw, title, year).

    In their order, each reference joins the first leader that it is similar to, or becomes one. From a
    threshold of LEAST on, similar references have one year and one first author, since near names and
    equal titles give 0.9 at most, so lists fall into small blocks and nothing else is compared."""
    if threshold <= LEAST:
        raise ValueError(f"the threshold has to be above {LEAST}")
    words = F.filter(F.array_distinct(F.split(F.trim(F.coalesce("title", F.lit(""))), r"\s+")), lambda w: w != "")
    keyed = references.select("doc_id", "reference_id", "order_index", F.lower(first_surname(F.col("authors"), F.col("raw"))).alias("author"), F.col("year").cast("string").alias("year"), words.alias("words")).where("author is not null and author <> '' and year is not null and year <> ''")
    least = (threshold - 0.6) / 0.4 - 1e-9
    block = keyed.groupBy("doc_id", "author", "year").agg(F.array_sort(F.collect_list(F.struct("order_index", "reference_id", "words"))).alias("items")).where("size(items) > 1")
    fits = lambda leader, x: jaccard(leader["words"], x["words"]) >= least
    kind = block.schema["items"].dataType.elementType["reference_id"].dataType.simpleString()
    start = F.struct(F.slice("items", 1, 0).alias("leaders"), F.expr(f"cast(array() as array<struct<reference_id:{kind},leader_id:{kind}>>)").alias("placed"))

    def step(state, x):
        hit = F.try_element_at(F.filter(state["leaders"], lambda l: fits(l, x)), F.lit(1))  # noqa: E741
        placed = F.concat(state["placed"], F.array(F.struct(x["reference_id"].alias("reference_id"), F.coalesce(hit["reference_id"], x["reference_id"]).alias("leader_id"))))
        return F.struct(F.when(hit.isNull(), F.concat(state["leaders"], F.array(x))).otherwise(state["leaders"]).alias("leaders"), placed.alias("placed"))

    placed = block.select("doc_id", F.explode(F.aggregate("items", start, step)["placed"]).alias("p")).select("doc_id", "p.*")
    size = placed.groupBy("doc_id", "leader_id").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return placed.join(size, ["doc_id", "leader_id"]).select("doc_id", "reference_id", "leader_id")
