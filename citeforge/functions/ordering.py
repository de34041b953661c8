"""Order of reference lists: collation of Vietnamese, ranks of laws, groups that must not mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Letters in order, each with its tones in order.
ALPHABET = [" ", *"0123456789", "aàảãáạ", "ăằẳẵắặ", "âầẩẫấậ", *"bcdđ", "eèẻẽéẹ", "êềểễếệ", *"fgh", "iìỉĩíị", *"jklmn", "oòỏõóọ", "ôồổỗốộ", "ơờởỡớợ", *"pqrst", "uùủũúụ", "ưừửữứự", *"vwx", "yỳỷỹýỵ", "z"]


def collation_key(x: Column) -> Column:
    """struct(letters, tones), arrays that compare as Vietnamese words do: letters first, then tones; other characters stand last."""
    low = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    ranks = F.create_map(*[F.lit(v) for i, group in enumerate(ALPHABET) for t, c in enumerate(group) for v in (c, i * 10 + t)])
    code = F.transform(F.filter(F.split(low, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(ranks, c), (F.lit(len(ALPHABET)) + F.ascii(c)) * 10))
    return F.struct(F.transform(code, lambda r: F.floor(r / 10).cast("int")).alias("letters"), F.transform(code, lambda r: (r % 10).cast("int")).alias("tones"))


def legal_rank(title: Column) -> Column:
    """1 for a constitution, 2 for a law, 3 for what stands below laws."""
    t = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"^\s*\d+\s*[.)]\s*", "")
    return F.when(t.rlike(r"(?iu)^hiến\s+pháp(\s|$)"), 1).when(t.rlike(r"(?iu)^(bộ\s+luật|luật|pháp\s+lệnh)(\s|$)"), 2).otherwise(3)


def reference_group(raw: Column, legal: Column) -> Column:
    """legal, vi (with a Vietnamese letter) or foreign."""
    marked = "".join(c for g in ALPHABET for c in g[1:]) + "ăâđêôơư"
    return F.when(legal, "legal").when(F.lower(F.coalesce(raw, F.lit(""))).rlike(f"[{marked}]"), "vi").otherwise("foreign")


def order_violations(references: DataFrame) -> DataFrame:
    """(doc_id, order_index, kind) of references (doc_id, order_index, group, rank, label) out of order.

    kind: ``interleaved`` (a group comes back), ``section`` (legal, vi, foreign is the order), ``hierarchy``
    (a law before one that ranks above it) or ``alphabet`` (within vi and foreign, by :func:`collation_key`)."""
    order = Window.partitionBy("doc_id").orderBy("order_index")
    own = Window.partitionBy("doc_id", "group").orderBy("order_index")
    place = F.when(F.col("group") == "legal", 0).when(F.col("group") == "vi", 1).otherwise(2)
    r = references.withColumn("key", collation_key(F.col("label"))).withColumn("place", place)
    r = r.withColumns({"before": F.lag("group").over(order), "before_place": F.lag("place").over(order), "seen": F.row_number().over(own), "rank_before": F.lag("rank").over(own), "key_before": F.lag("key").over(own)})
    changed = F.col("before").isNotNull() & (F.col("before") != F.col("group"))
    kinds = F.array_compact(F.array(
        F.when(changed & (F.col("seen") > 1), "interleaved").when(changed & (F.col("place") < F.col("before_place")), "section"),
        F.when((F.col("group") == "legal") & (F.col("rank_before") > F.col("rank")), "hierarchy"),
        F.when((F.col("group") != "legal") & (F.col("key_before") > F.col("key")), "alphabet"),
    ))
    return r.select("doc_id", "order_index", F.explode(kinds).alias("kind"))
