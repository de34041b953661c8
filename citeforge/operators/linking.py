"""Linking in-text occurrences to references: each method is an equi-join, the first that hits wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import author_years, numeric_indices


def by_number(occurrences: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, pos, reference_id): every index of an occurrence that some reference has; the first of equal ones."""
    first = references.groupBy("doc_id", "numeric_index").agg(F.min_by("reference_id", "order_index").alias("reference_id"))
    asked = occurrences.select("doc_id", "pos", F.explode(F.array_distinct(numeric_indices(F.col("raw")))).alias("numeric_index"))
    return asked.join(first, ["doc_id", "numeric_index"]).select("doc_id", "pos", "reference_id")


def by_key(occurrences: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Equal key within a document; of equal references the last wins."""
    last = references.where(F.col(key).isNotNull()).groupBy("doc_id", key).agg(F.max_by("reference_id", "order_index").alias("reference_id"))
    return occurrences.join(last, ["doc_id", key]).select("doc_id", "pos", "reference_id")


def cascade(methods: list[tuple[str, DataFrame]]) -> DataFrame:
    """(doc_id, pos, reference_id, method): all links of the first method that has any for an occurrence."""
    every = reduce(DataFrame.unionByName, [links.select("doc_id", "pos", "reference_id", F.lit(i).alias("prio"), F.lit(name).alias("method")) for i, (name, links) in enumerate(methods)])
    best = Window.partitionBy("doc_id", "pos").orderBy("prio")
    return every.withColumn("r", F.rank().over(best)).where("r = 1").select("doc_id", "pos", "reference_id", "method").distinct()


def inherit(occurrences: DataFrame, link: str, is_ibid: str) -> DataFrame:
    """An "ibid." takes the link of the last occurrence before it that has one."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return occurrences.withColumn(link, F.when(F.col(is_ibid), F.last(link, ignorenulls=True).over(before)).otherwise(F.col(link)))


def uncited(references: DataFrame, links: DataFrame) -> DataFrame:
    return references.join(links, ["doc_id", "reference_id"], "left_anti")


def by_title(occurrences: DataFrame, references: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, pos, reference_id, score): the reference of highest Jaccard over title words, the first of equal ones.

    ``words`` are distinct. Sets of n words as like as ``least`` share n * least of them, so also one of the first n - n * least + 1
    of each in the order of hashes; pairs come from a join on these alone. Of a pair, bits of one mask that the other lacks are words
    that it lacks, which rules out most of those that are not alike enough; what is left is compared by its whole sets once."""
    size = F.size("words")
    head = F.explode(F.slice(F.sort_array(F.transform("words", lambda w: F.xxhash64(w))), 1, size - F.ceil(size * least - 1e-9).cast("int") + 1)).alias("head")
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(w).bitwiseAND(F.lit(63)).cast("int"))
    mask = F.aggregate("words", F.lit(0).cast("long"), lambda m, w: m.bitwiseOR(bit(w)))
    left = occurrences.select("doc_id", "pos", size.alias("n1"), mask.alias("m1"), head)
    right = references.select("doc_id", "reference_id", size.alias("n2"), mask.alias("m2"), head)
    most = lambda n, m, other: F.col(n) - F.bit_count(F.col(m).bitwiseAND(F.bitwise_not(other)))
    likely = F.least(most("n1", "m1", "m2"), most("n2", "m2", "m1")) >= (F.col("n1") + F.col("n2")) * (least / (1 + least)) - 1e-9
    pairs = left.join(right, ["doc_id", "head"]).where(likely).select("doc_id", "pos", "reference_id").distinct()
    whole = pairs.join(references.select("doc_id", "reference_id", "order_index", F.col("words").alias("theirs")), ["doc_id", "reference_id"]).join(occurrences.select("doc_id", "pos", "words"), ["doc_id", "pos"])
    both = F.size(F.array_intersect("words", "theirs"))
    scored = whole.select("doc_id", "pos", "reference_id", "order_index", (both / (F.size("words") + F.size("theirs") - both)).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("doc_id", "pos").agg(F.max_by(F.struct("reference_id", "score"), F.struct("score", -F.col("order_index"))).alias("best"))
    return best.select("doc_id", "pos", "best.*")


def cited_counts(references: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, reference_id, n, places): how many occurrences cite each reference, and which; 0 and '' for none."""
    per = links.groupBy("doc_id", "reference_id").agg(F.collect_set("pos").alias("at"))
    return references.select("doc_id", "reference_id").join(per, ["doc_id", "reference_id"], "left").select("doc_id", "reference_id", F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.sort_array("at"), ","), F.lit("")).alias("places"))


def link_summary(occurrences: DataFrame, links: DataFrame, methods: list[str]) -> DataFrame:
    """(method, n): occurrences by the method that linked them, "missing" for none; methods without any count 0."""
    one = links.groupBy("doc_id", "pos").agg(F.first("method").alias("method"))
    per = occurrences.select("doc_id", "pos").join(one, ["doc_id", "pos"], "left").groupBy(F.coalesce("method", F.lit("missing")).alias("method")).agg(F.count("*").alias("n"))
    every = occurrences.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in [*methods, "missing"]])).alias("method"))
    return every.join(per, "method", "left").select("method", F.coalesce("n", F.lit(0)).alias("n"))


def exact_duplicates(references: DataFrame) -> DataFrame:
    """(doc_id, kind, key, n, representative): references of a document with one DOI; of the others, with one arXiv id.

    The representative is the first in order."""
    size = lambda *keys: F.count("*").over(Window.partitionBy("doc_id", *keys))
    doi = references.withColumn("doi_group", F.when(F.col("doi").isNotNull() & (size("doi") > 1), F.col("doi").cast("string")))
    rest = doi.withColumn("arxiv_left", F.when(F.col("doi_group").isNull(), F.col("arxiv_id").cast("string")))
    kind = F.when(F.col("doi_group").isNotNull(), "doi").when(F.col("arxiv_left").isNotNull(), "arxiv")
    keyed = rest.select("doc_id", kind.alias("kind"), F.coalesce("doi_group", "arxiv_left").alias("key"), "reference_id", "order_index").where("kind is not null")
    return keyed.groupBy("doc_id", "kind", "key").agg(F.count("*").alias("n"), F.min_by("reference_id", "order_index").alias("representative")).where("n > 1")


def by_author_year(occurrences: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, pos, part, reference_id, status): each part of an occurrence by author and year, first with its suffix.

    ``authors`` of references are lower-case last names; of equal references the first wins. A part that has
    none is missing_reference if another part of its occurrence matched; else the occurrence gives no row."""
    keyed = references.select("doc_id", "reference_id", "order_index", F.explode("authors").alias("author"), F.col("year").cast("string").alias("year"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    first = lambda *keys: keyed.groupBy("doc_id", *keys).agg(F.min_by("reference_id", "order_index").alias("_".join(keys)))
    parts = occurrences.select("doc_id", "pos", F.posexplode(author_years(F.col("raw"))).alias("part", "key")).select("doc_id", "pos", "part", "key.*")
    found = parts.join(first("author", "year", "suffix"), ["doc_id", "author", "year", "suffix"], "left").join(first("author", "year"), ["doc_id", "author", "year"], "left")
    linked = found.withColumn("reference_id", F.coalesce(F.when(F.col("suffix") != "", F.col("author_year_suffix")), F.col("author_year")))
    any_ = F.count("reference_id").over(Window.partitionBy("doc_id", "pos"))
    return linked.withColumn("any", any_).where("any > 0").select("doc_id", "pos", "part", "reference_id", F.when(F.col("reference_id").isNull(), "missing_reference").otherwise("matched").alias("status"))
