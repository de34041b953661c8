"""Links for occurrences that no exact key finds: misspelt names, other years, organisations, pages.

Each method is an equi-join on the document and a key (year, first letter or word), with a residual
condition; of the references that fit, the first in the list wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.authors import SMALL_WORDS, corporate_keys, fold_author
from ..functions.ratios import ratio


def _first(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("doc_id", "pos").agg(F.min_by("reference_id", F.struct("prio", "order_index")).alias("reference_id"))


def misspelt(a: Column, b: Column) -> Column:
    """Names of four letters or more with one first letter that differ in one letter, in an added end, in the order of a few letters, or little in all."""
    m, n = F.length(a), F.length(b)
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    wrong = F.size(F.filter(F.zip_with(chars(a), chars(b), lambda p, q: p.eqNullSafe(q)), lambda e: ~e))
    one = (m == n) & (wrong == 1)
    end = (F.abs(m - n) == 1) & (a.startswith(b) | b.startswith(a))
    order = (m >= 5) & (m == n) & (F.array_sort(chars(a)) == F.array_sort(chars(b))) & (wrong <= 3)
    return (m >= 4) & (n >= 4) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (one | end | order | (ratio(a, b) >= 0.84))


def by_fuzzy_author_year(occurrences: DataFrame, references: DataFrame, slip: int = 9) -> DataFrame:
    """(doc_id, pos, reference_id) for occurrences (doc_id, pos, author, year) of references (doc_id, reference_id, order_index, author, year).

    First an undated reference of that author, then a misspelt author of that year, then that author within ``slip`` years."""
    o = occurrences.select("doc_id", "pos", fold_author(F.col("author")).alias("a"), F.col("year").cast("int").alias("y")).where(F.length("a") >= 3).withColumn("letter", F.substring("a", 1, 1))
    r = references.select("doc_id", "reference_id", "order_index", fold_author(F.col("author")).alias("b"), F.col("year").cast("int").alias("z")).withColumn("letter", F.substring("b", 1, 1))
    pairs = o.join(r, ["doc_id", "letter"])
    prio = F.when(F.col("z").isNull() & ((F.col("a") == F.col("b")) | ((F.length("a") >= 5) & F.col("b").contains(F.col("a")))), 0).when((F.col("y") == F.col("z")) & misspelt(F.col("a"), F.col("b")), 1).when((F.length("a") >= 4) & (F.col("a") == F.col("b")) & (F.abs(F.col("y") - F.col("z")) <= slip), 2)
    return _first(pairs.withColumn("prio", prio).where("prio is not null"))


def by_author_page(occurrences: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, pos, reference_id) of every reference whose first author, or its last word, is the one of "(Author 12)"."""
    pattern = r"^\(\s*([\p{L}'’\-]+(?:\s+[\p{L}'’\-]+)?)\s+\d{1,4}(?:\s*[-–]\s*\d{1,4})?\s*\)$"
    o = occurrences.select("doc_id", "pos", fold_author(F.regexp_extract(F.trim("raw"), pattern, 1)).alias("key")).where("key <> ''")
    folded = fold_author(F.col("author"))
    r = references.select("doc_id", "reference_id", F.explode(F.array_distinct(F.array(folded, F.element_at(F.split(folded, " "), -1)))).alias("key")).where("key <> ''")
    return o.join(r, ["doc_id", "key"]).select("doc_id", "pos", "reference_id").distinct()


def by_organisation(occurrences: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, pos, reference_id): an organisation of the same year named by one of its keys, or a title that begins with the name cited."""
    low = lambda x: F.trim(F.regexp_replace(F.lower(F.trim(x)), r"^the\s+", ""))
    o = occurrences.select("doc_id", "pos", "year", F.explode(F.array_distinct(F.concat(corporate_keys(F.col("author")), F.array(low(F.col("author")))))).alias("key")).where("length(key) >= 2")
    words = F.filter(F.split(low(F.col("author")), r"\W+"), lambda w: (F.length(w) > 2) & ~w.isin(*SMALL_WORDS))
    short = F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    heads = F.transform(F.sequence(F.lit(1), F.least(F.size(F.split(low(F.col("title")), " ")), F.lit(6))), lambda n: F.array_join(F.slice(F.split(low(F.col("title")), " "), 1, n), " "))
    keys = F.array_distinct(F.array_compact(F.concat(corporate_keys(F.col("author")), F.array(low(F.col("author")), short), heads)))
    # Keys are dear, so only references of years that are asked for get any.
    asked = references.join(o.select("doc_id", "year").distinct(), ["doc_id", "year"], "left_semi")
    r = asked.select("doc_id", "reference_id", "order_index", "year", F.explode(keys).alias("key"))
    return _first(o.join(r, ["doc_id", "year", "key"]).withColumn("prio", F.lit(0)))


def acronyms(texts: DataFrame) -> DataFrame:
    """(doc_id, name, acronym) learned from texts (doc_id, text) that say "World Health Organization (WHO)": initials have to agree."""
    found = F.regexp_extract_all("text", F.lit(r"((?:[A-Z][\p{L}\-]+\s+(?:(?:of|for|and|the|on|in)\s+)*){1,7})\(([A-Z]{2,8})\)"), F.lit(0))
    each = texts.select("doc_id", F.explode(F.array_distinct(found)).alias("hit")).select("doc_id", F.trim(F.regexp_replace("hit", r"\s*\([A-Z]{2,8}\)$", "")).alias("name"), F.regexp_extract("hit", r"\(([A-Z]{2,8})\)$", 1).alias("acronym"))
    main = F.filter(F.split("name", r"\s+"), lambda w: ~F.lower(w).isin(*SMALL_WORDS))
    n = F.length("acronym")
    last = F.slice(main, F.greatest(F.size(main) - n + 1, F.lit(1)), n)
    agree = F.upper(F.array_join(F.transform(last, lambda w: F.substring(w, 1, 1)), "")) == F.col("acronym")
    # Small words in front may be the name's own ("De La Salle University") or the sentence's ("On The World Health Organization"): both are learned.
    whole = F.regexp_replace(F.lower("name"), r"^the\s+", "")
    bare = F.regexp_replace(F.lower("name"), rf"^(?:(?:{'|'.join(SMALL_WORDS)})\s+)+", "")
    names = F.when(F.size(main) <= n, F.array(whole, bare)).otherwise(F.array(F.lower(F.array_join(last, " "))))
    return each.where(agree).select("doc_id", F.explode(F.array_distinct(names)).alias("name"), F.lower("acronym").alias("acronym")).distinct()


def with_acronyms(references: DataFrame, learned: DataFrame) -> DataFrame:
    """references (doc_id, reference_id, order_index, author, year) and once more under each acronym that their author has in the text."""
    extra = references.join(learned, (references["doc_id"] == learned["doc_id"]) & (F.lower("author") == F.col("name"))).select(references["doc_id"], "reference_id", "order_index", F.col("acronym").alias("author"), "year")
    return references.select("doc_id", "reference_id", "order_index", "author", "year").unionByName(extra)


def by_reference_id(occurrences: DataFrame, references: DataFrame, gap: int = 9) -> DataFrame:
    """(doc_id, pos, reference_id) where the parser has linked already and the years are no more than ``gap`` apart."""
    r = references.select("doc_id", "reference_id", F.col("year").cast("int").alias("z"))
    return occurrences.select("doc_id", "pos", "reference_id", F.col("year").cast("int").alias("y")).join(r, ["doc_id", "reference_id"]).where(F.coalesce(F.abs(F.col("y") - F.col("z")), F.lit(0)) <= gap).select("doc_id", "pos", "reference_id")
