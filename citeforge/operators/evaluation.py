"""Consensus, calibration and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consensus(candidates: DataFrame) -> DataFrame:
    """(citation_id, consensus, fingerprint): distinct sources of the fingerprint that has most; first by name on ties."""
    per = candidates.where("found and fingerprint is not null").groupBy("citation_id", "fingerprint").agg(F.countDistinct("source_name").alias("sources"))
    return per.groupBy("citation_id").agg(F.max("sources").alias("consensus"), F.min_by("fingerprint", F.struct(-F.col("sources"), "fingerprint")).alias("fingerprint"))


def brier(rows: DataFrame) -> DataFrame:
    p = F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))
    return rows.agg(F.avg(F.pow(p - F.col("y"), 2)).alias("brier"), F.count("*").alias("n"))


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, gap): equal-width bins, the last one closed; gap is |mean probability - accuracy|."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))


def expected_calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    return calibration_bins(rows, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """(label, support, precision_, recall_, f1): a class that is never predicted or never true counts 0."""
    each = rows.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("y") == F.col("pred")).cast("int").alias("hit")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    got = each.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("hit").alias("hits"))
    return got.select("label", "support", F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0)).alias("precision_"), F.coalesce(F.try_divide("hits", "support"), F.lit(0.0)).alias("recall_"), F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0)).alias("f1"))


def coverage_accuracy(rows: DataFrame, levels=(0.5, 0.7, 0.9, 0.95, 1.0)) -> DataFrame:
    """(coverage, k, accuracy) of the k most confident rows; ties by id, a number.

    Ranks add up from counts: of 4096 ranges of p, of the probabilities within a range, of 1024 ranges of ids
    within a probability; only what shares all three is put in order, so no task gets many rows."""
    span = rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    keyed = rows.join(F.broadcast(span)).withColumn("bucket", F.floor(F.col("p") * 4096)).withColumn("part", F.floor((F.col("id") - F.col("lo")) * 1024 / (F.col("hi") - F.col("lo") + 1)))
    per = keyed.groupBy("bucket", "p", "part").agg(F.count("*").alias("c"))
    up_to = lambda df, *order: df.withColumn("before", F.sum("c").over(Window.partitionBy(*order[:-1]).orderBy(order[-1])) - F.col("c"))
    wide = up_to(per.groupBy("bucket").agg(F.sum("c").alias("c")), F.desc("bucket")).select("bucket", F.col("before").alias("b0"))  # at most 4097 rows
    within = up_to(per.groupBy("bucket", "p").agg(F.sum("c").alias("c")), "bucket", F.desc("p")).select("bucket", "p", F.col("before").alias("b1"))
    above = up_to(per, "p", "part").join(within, ["bucket", "p"]).join(F.broadcast(wide), "bucket").select("p", "part", (F.col("b0") + F.col("b1") + F.col("before")).alias("above"))
    ranked = keyed.join(above, ["p", "part"]).withColumn("rank", F.col("above") + F.row_number().over(Window.partitionBy("p", "part").orderBy("id")))
    total = rows.agg(F.count("*").alias("n"))
    want = total.withColumn("coverage", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("k", F.greatest(F.lit(1), F.bround(F.col("n") * F.col("coverage"))).cast("long"))
    top = ranked.withColumn("l", F.explode(F.array(*[F.lit(x) for x in levels]))).join(F.broadcast(want), F.col("l") == F.col("coverage")).where("rank <= k")
    return top.groupBy("coverage", "k").agg(F.avg((F.col("y") == F.col("pred")).cast("int")).alias("accuracy"))


def hashed_split(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``split``: 70 % train, 15 % validation, 15 % test, by a hash of the key alone, so equal keys stay together."""
    h = F.substring(F.md5(F.col(key).cast("string")), 1, 4)
    return rows.withColumn("split", F.when(h < "b333", "train").when(h < "d99a", "validation").otherwise("test"))


def stratified_split(rows: DataFrame, key: str, stratum: str, shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """rows with ``split``: of every stratum the shares of its rows go to train and validation, rounded half to even, the rest to test.

    Rows stand in the order of their key's hash, so the split is at random but the same for the same rows. A row's place is what
    the 65,536 ranges of hashes before its own hold, by one aggregate, and its place within its range; so no stratum, however large,
    is put in order by one task. Null is a stratum of its own."""
    # The rows' own columns go in a struct, so that none of their names can clash with ours.
    placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(key).alias("k"), F.col(stratum).alias("s"), F.md5(F.col(key).cast("string")).alias("h")).withColumn("bucket", F.conv(F.substring("h", 1, 4), 16, 10).cast("int"))
    held = placed.groupBy(F.col("s").alias("of"), F.col("bucket").alias("b")).agg(F.count("*").alias("c"))
    # At most 65,536 rows a stratum.
    held = held.select("of", "b", (F.sum("c").over(Window.partitionBy("of").orderBy("b")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("of")).alias("n"))
    inside = Window.partitionBy("s", "bucket").orderBy("h", "k")
    ranked = placed.join(held, F.col("s").eqNullSafe(F.col("of")) & (F.col("bucket").eqNullSafe(F.col("b")))).withColumn("rank", F.col("before") + F.row_number().over(inside))
    first, second = (F.bround(F.col("n") * F.lit(x)) for x in shares)
    split = F.when(F.col("rank") <= first, "train").when(F.col("rank") <= first + second, "validation").otherwise("test")
    return ranked.select("row.*", split.alias("split"))


def split_audit(rows: DataFrame, key: str) -> DataFrame:
    """(split, n, keys, shared) of rows with ``split``: rows and different keys of each split, and how many of these another split has too."""
    per = rows.groupBy(key, "split").agg(F.count("*").alias("n"))
    many = per.groupBy(key).agg(F.count("*").alias("in_"))
    return per.join(many, per[key].eqNullSafe(many[key])).groupBy("split").agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.count_if(F.col("in_") > 1).alias("shared"))


def threshold_metrics(rows: DataFrame, thousandths: list[int]) -> DataFrame:
    """(threshold, tp, fp, tn, fn, precision_, recall_, f1) of p against y, all thresholds in one aggregation."""
    yes, p = F.col("y") == 1, F.round(F.col("p") * 1000)
    counts = lambda t: F.struct(F.lit(t).alias("threshold"), F.count_if((p >= t) & yes).alias("tp"), F.count_if((p >= t) & ~yes).alias("fp"), F.count_if((p < t) & ~yes).alias("tn"), F.count_if((p < t) & yes).alias("fn"))
    c = rows.agg(F.array(*[counts(t) for t in thousandths]).alias("c")).select(F.inline("c"))
    share = lambda a, b: F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(0.0))
    return c.select("*", share("tp", "tp + fp").alias("precision_"), share("tp", "tp + fn").alias("recall_"), share("2 * tp", "2 * tp + fp + fn").alias("f1"))


def abstention_threshold(rows: DataFrame, target: float = 0.8) -> DataFrame:
    """(threshold, coverage): the probability in [0, 1] that a share ``target`` of the rows reach, and the share that do.

    A histogram finds the bucket that holds it, so that only that bucket's different values are put in order."""
    bucket = F.floor(F.col("p") * 1000)
    total = rows.agg(F.greatest(F.lit(1), F.bround(F.count("p") * F.lit(target))).alias("k"), F.count("p").alias("total"))
    high_first = Window.orderBy(F.desc("bucket"))  # at most 1001 rows
    hist = rows.where("p is not null").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(high_first))
    held = hist.join(F.broadcast(total)).where("upto >= k").agg(F.max("bucket").alias("at"), F.max_by(F.col("upto") - F.col("c"), "bucket").alias("before"), F.max("k").alias("k"), F.max("total").alias("total"))
    inside = rows.join(F.broadcast(held), bucket == F.col("at")).groupBy("p").agg(F.count("*").alias("c"), F.first("before").alias("before"), F.first("k").alias("k"), F.first("total").alias("total"))
    reach = inside.withColumn("reach", F.col("before") + F.sum("c").over(Window.orderBy(F.desc("p")))).where("reach >= k")
    return reach.agg(F.max("p").alias("threshold"), F.max_by(F.col("reach") / F.col("total"), "p").alias("coverage"))
