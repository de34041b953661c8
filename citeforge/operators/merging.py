"""Lists of references from two parsers made one, and verified candidates written back."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.authors import author_key
from ..functions.identifiers import title_key
from ..functions.normalize import normalize_doi
from ..sources.store import written


#: Of a pair of entries: hundredths of shared title words, and what an equal year and an equal author add; less than LEAST is no pair.
YEAR_GAIN, AUTHOR_GAIN, LEAST = 20, 30, 60


def best_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, left_id, right_id): one-to-one, the surest pairs first, among entries (doc_id, reference_id, title, year, author) that share a word.

    A pair is taken if it is the best that either side still has; so rounds of mutually best pairs end as one pass over a
    document's pairs in the order of their score, ties to the smaller ids."""
    words = lambda df, name: df.select("doc_id", F.col("reference_id").alias(name), F.array_distinct(F.filter(F.split(title_key(F.col("title")), " "), lambda w: F.length(w) > 1)).alias(f"{name}_words"), F.col("year").cast("string").alias(f"{name}_year"), F.lower(author_key(F.col("author"))).alias(f"{name}_author"))
    a, b = words(left, "left_id"), words(right, "right_id")
    met = a.select("doc_id", "left_id", F.explode("left_id_words").alias("w")).join(b.select("doc_id", "right_id", F.explode("right_id_words").alias("w")), ["doc_id", "w"]).groupBy("doc_id", "left_id", "right_id").agg(F.count("*").alias("both"))
    pairs = met.join(a, ["doc_id", "left_id"]).join(b, ["doc_id", "right_id"])
    like = F.floor(100 * F.col("both") / (F.size("left_id_words") + F.size("right_id_words") - F.col("both")))
    equal = lambda c, gain: F.when((F.col(f"left_id_{c}") == F.col(f"right_id_{c}")) & (F.col(f"left_id_{c}") != ""), gain).otherwise(0)
    scored = pairs.select("doc_id", "left_id", "right_id", (like + equal("year", YEAR_GAIN) + equal("author", AUTHOR_GAIN)).cast("int").alias("score")).where(F.col("score") >= LEAST)
    each = scored.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "left_id", "right_id"))).alias("pairs"))
    kind = scored.select("left_id", "right_id").schema
    l, r = (f.dataType.simpleString() for f in kind)  # noqa: E741
    none = F.array().cast(f"array<struct<left_id:{l},right_id:{r}>>")
    free = lambda got, p: ~F.exists(got, lambda g: (g["left_id"] == p["left_id"]) | (g["right_id"] == p["right_id"]))
    taken = F.aggregate("pairs", none, lambda got, p: F.when(free(got, p), F.concat(got, F.array(F.struct(p["left_id"].alias("left_id"), p["right_id"].alias("right_id"))))).otherwise(got))
    return each.select("doc_id", F.explode(taken).alias("t")).select("doc_id", "t.*")


def merge_lists(left: DataFrame, right: DataFrame, fields: tuple[str, ...] = ("doi", "title", "year", "venue", "author")) -> DataFrame:
    """(doc_id, left_id, right_id, fields, conflicts) of references (doc_id, reference_id, fields) that two parsers found.

    Entries meet by DOI, then by title, then one-to-one by what else is alike (:func:`best_pairs`); left's fields win, right's
    fill gaps, and fields in which both have something else are named. Entries of one side alone stay. Both lists and the pairs of
    each step are written, as later steps read them, and what the lists are made of may be dear."""
    left, right = written(left, "merge-left"), written(right, "merge-right")

    def pairs(a: DataFrame, b: DataFrame, key) -> DataFrame:
        keyed = lambda df, name: df.select("doc_id", key(df).alias("k"), F.col("reference_id").alias(name)).where("k is not null and k <> ''").groupBy("doc_id", "k").agg(F.min(name).alias(name))
        return keyed(a, "left_id").join(keyed(b, "right_id"), ["doc_id", "k"]).select("doc_id", "left_id", "right_id")

    by_doi = lambda df: normalize_doi(F.col("doi"))
    by_title = lambda df: title_key(F.col("title"))
    rest = lambda df, found, name: df.join(found.select("doc_id", F.col(name).alias("reference_id")), ["doc_id", "reference_id"], "left_anti")
    first = written(pairs(left, right, by_doi), "merge-doi")
    a, b = rest(left, first, "left_id"), rest(right, first, "right_id")
    second = written(pairs(a, b, by_title), "merge-title")
    a, b = rest(a, second, "left_id"), rest(b, second, "right_id")
    third = best_pairs(*(written(x, f"merge-rest-{side}") for x, side in ((a, "left"), (b, "right"))))
    links = first.unionByName(second).unionByName(third)
    named = lambda df, side: df.select("doc_id", F.col("reference_id").alias(f"{side}_id"), *[F.col(f).alias(f"{side}_{f}") for f in fields])
    whole = named(left, "left").join(links, ["doc_id", "left_id"], "left").join(named(right, "right"), ["doc_id", "right_id"], "full_outer")
    clash = [F.when(F.lower(F.col(f"left_{f}").cast("string")) != F.lower(F.col(f"right_{f}").cast("string")), f) for f in fields]
    return whole.select("doc_id", "left_id", "right_id", *[F.coalesce(f"left_{f}", f"right_{f}").alias(f) for f in fields], F.array_compact(F.array(*clash)).alias("conflicts"))


def write_back(papers: DataFrame, verified: DataFrame) -> DataFrame:
    """verified candidates (doi, title, year, confidence) that the catalogue lacks by DOI, title and year; of equal ones the surest."""
    key = F.coalesce(F.concat(F.lit("doi:"), normalize_doi(F.col("doi"))), F.concat(title_key(F.col("title")), F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    loose = F.concat(title_key(F.col("title")), F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit("")))
    have = papers.select(key.alias("key")).union(papers.select(loose)).distinct()
    new = verified.withColumn("key", key).withColumn("loose", loose).join(have, "key", "left_anti").join(have.select(F.col("key").alias("loose")), "loose", "left_anti")
    best = Window.partitionBy("key").orderBy(F.desc("confidence"), "title")
    return new.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "key", "loose")


def swapped_names(a: Column, b: Column) -> Column:
    """Two names of which one has given and family name the other way round: "Wei, G." and "Guodong Wei", "Guodong, W." and "Wei Guodong"."""
    words = lambda x: F.filter(F.split(F.lower(F.regexp_replace(x, r"[^\p{L}\s]", " ")), r"\s+"), lambda w: w != "")
    x, y = words(a), words(b)
    two = (F.size(x) == 2) & (F.size(y) == 2)
    begins = lambda p, q: p.startswith(q) | q.startswith(p)
    straight = ((x[0] == y[0]) & begins(x[1], y[1])) | ((x[1] == y[1]) & begins(x[0], y[0]))
    crossed = ((x[0] == y[1]) & begins(x[1], y[0])) | ((x[1] == y[0]) & begins(x[0], y[1]))
    return F.coalesce(two & (straight | crossed) & (F.length(author_key(a)) > 0), F.lit(False))


# Letters that Vietnamese alone has with their marks, and how many make a text Vietnamese, or a source not English.
MARKED = "àáảãạăắằẳẵặâấầẩẫậđèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵ"
CONTEXT_LEAST, SOURCE_MOST = 3, 5


def bridge(context: Column, title: Column, abstract: Column, dictionary: dict[str, str]) -> Column:
    """struct(cross, text): whether a Vietnamese context cites an English source, and the context with what helps to compare them.

    The context stays as it is; behind it, in brackets, come its own words in plain Latin letters and the equivalents of the
    dictionary's phrases in it. Otherwise the text is empty."""
    marks = lambda x: F.length(x) - F.length(F.translate(F.lower(x), MARKED, ""))
    own = F.coalesce(context, F.lit(""))
    source = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))
    cross = (marks(own) >= CONTEXT_LEAST) & (marks(source) <= SOURCE_MOST)
    words = F.transform(F.regexp_extract_all(own, F.lit(r"([\p{L}\p{N}_][\p{L}\p{N}_+.\-]*)"), F.lit(1)), lambda w: F.regexp_replace(w, r"[+.\-]+$", ""))
    latin = F.filter(words, lambda w: w.rlike(r"^[A-Za-z][A-Za-z0-9_+.\-]{2,}$"))
    low = F.lower(own)
    equal = F.array_compact(F.array(*[F.when(low.contains(phrase), F.lit(equivalent)) for phrase, equivalent in dictionary.items()]))
    more = F.concat(latin, equal)
    return F.struct(cross.alias("cross"), F.when(~cross, "").when(F.size(more) == 0, own).otherwise(F.concat(own, F.lit(" ("), F.array_join(more, " "), F.lit(")"))).alias("text"))


@F.pandas_udf(StringType())
def to_positions(text: pd.Series) -> pd.Series:
    """The index of words to their places, from 0 on, as JSON, of a text whose words are parted by one blank; null if it is null or empty. Rows don't meet."""

    def index(x: str | None) -> str | None:
        places: dict[str, list[int]] = {}
        for i, word in enumerate(x.split(" ") if x else ()):
            places.setdefault(word, []).append(i)
        return json.dumps(places, ensure_ascii=False, separators=(",", ":")) if places else None

    return text.map(index)


def from_positions(x: Column) -> Column:
    """The text that an index of words to their places, as JSON, was made from; null if it is broken or holds none.

    Words whose places are no list are left out, and so are places that are no whole numbers; of equal places the smaller word comes first."""
    index = F.from_json(x, "map<string,string>", {"mode": "PERMISSIVE"})
    places = lambda v: F.filter(F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>")), lambda p: p.rlike(r"^-?\d+$"))
    each = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(places(F.when(e["value"].startswith("["), e["value"])), lambda p: F.struct(p.cast("long").alias("at"), e["key"].alias("word")))))
    return F.nullif(F.trim(F.array_join(F.transform(F.array_sort(each), lambda e: e["word"]), " ")), F.lit(""))
