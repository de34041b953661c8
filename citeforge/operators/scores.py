"""The integrity score of a document and its components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each mapping status takes off, the weights of the components, and rules that spoil an identifier.
PENALTIES = {"missing_reference": 0.20, "uncited_reference": 0.10, "in_text_mismatch": 0.15, "duplicate_reference": 0.10, "ambiguous_mapping": 0.05, "style_inconsistent": 0.02}
WEIGHTS = {"verified_ratio": 0.35, "metadata_accuracy": 0.25, "link_consistency": 0.25, "format_consistency": 0.10, "identifier_validity": 0.05}
SPOILING = ("R-FAKE-URL", "R-FABRICATED-DOI", "R-NONEXISTENT-DOI", "R-DEAD-URL", "R-BROKEN-LINK")


def penalty(status: Column) -> Column:
    return reduce(lambda out, kv: out.when(status == kv[0], kv[1]), PENALTIES.items(), F).otherwise(0.0)


def link_consistency(links: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(doc_id, link_consistency) by links (doc_id, status) and, of verdicts (doc_id, status), uncited and duplicate references.

    Documents without a link are judged by their verdicts' statuses alone; an unknown status takes nothing off."""
    side = F.col("status").isin("uncited_reference", "duplicate_reference")
    a = links.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(penalty(F.col("status"))).alias("p"))
    b = verdicts.groupBy("doc_id").agg(F.count("*").alias("all"), F.sum(penalty(F.col("status"))).alias("all_p"), F.count_if(side).alias("side"), F.sum(F.when(side, penalty(F.col("status"))).otherwise(0.0)).alias("side_p"))
    both = a.join(b, "doc_id", "full_outer").na.fill(0)
    by_links = 1 - (F.col("p") + F.col("side_p")) / (F.col("n") + F.col("side"))
    by_verdicts = 1 - F.col("all_p") / F.col("all")
    return both.select("doc_id", F.greatest(F.lit(0.0), F.when(F.col("n") > 0, by_links).otherwise(by_verdicts)).alias("link_consistency"))


def format_consistency(style: Column, confidence: Column, inconsistent: Column, n: Column) -> Column:
    """By the document's style; without one, by how many of its n verdicts are of another style."""
    base = F.when(style.contains("MIXED"), 0.4).when(style.contains("UNKNOWN"), 0.5).when(style.contains("APA") | style.contains("IEEE"), 0.8 + 0.2 * confidence).otherwise(0.5)
    styled = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base))
    plain = F.when(n <= 0, 0.5).when(inconsistent > 0, F.greatest(F.lit(0.3), 1 - inconsistent / n)).otherwise(0.8)
    return F.when(style.isNotNull(), styled).otherwise(plain)


def identifier_valid(label: Column, rules: Column, url_status: Column, exception: Column) -> Column:
    """An identifier counts if no rule or status spoils it and the label is verified or metadata_error."""
    spoilt = F.coalesce(F.arrays_overlap(rules, F.array(*[F.lit(r) for r in SPOILING])), F.lit(False)) | F.coalesce(exception, F.lit(False)) | F.coalesce(url_status.isin("dead_link", "fake_domain"), F.lit(False))
    return ~spoilt & label.isin("verified", "metadata_error")


def components(verdicts: DataFrame) -> DataFrame:
    """(doc_id, n, verified_ratio, metadata_accuracy, identifier_validity) of verdicts (doc_id, label, has_id, rules, url_status, exception); resources don't count."""
    v = verdicts.where("label <> 'resource'")
    valid = identifier_valid(F.col("label"), F.col("rules"), F.col("url_status"), F.col("exception"))
    got = v.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "verified").alias("ok"), F.count_if(F.col("label").isin("metadata_error", "suspected_hallucination")).alias("bad"), F.count_if("has_id").alias("ids"), F.count_if(F.col("has_id") & valid).alias("good"))
    return got.select("doc_id", "n", (F.col("ok") / F.col("n")).alias("verified_ratio"), (1 - F.col("bad") / F.col("n")).alias("metadata_accuracy"), F.when(F.col("ids") > 0, F.col("good") / F.col("ids")).otherwise(1.0).alias("identifier_validity"))


def integrity_score(parts: DataFrame) -> Column:
    """0 to 100 with two decimals (ties go up), from columns named as WEIGHTS; 0 without verdicts."""
    total = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in WEIGHTS.items()])
    return F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, F.round(total * 100 + 1e-9, 2)).otherwise(0.0)


def rescored(stored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Scores after overrides: verified ratio and accuracy anew, an overridden verdict being verified; other stored components stay."""
    label = F.when(F.col("is_overridden"), "verified").otherwise(F.col("label"))
    new = verdicts.withColumn("label", label).where("label <> 'resource'").groupBy("doc_id").agg(F.count("*").alias("n"), (F.count_if(F.col("label") == "verified") / F.count("*")).alias("verified_ratio"), (1 - F.count_if(F.col("label").isin("metadata_error", "suspected_hallucination")) / F.count("*")).alias("metadata_accuracy"))
    kept = stored.select("doc_id", *[F.coalesce(F.col(c), F.lit(1.0)).alias(c) for c in ("link_consistency", "format_consistency", "identifier_validity")])
    joined = kept.join(new, "doc_id", "left").na.fill(0)
    return joined.select("doc_id", "n", integrity_score(joined).alias("score"))


def rule_hits(rules: Column, wanted: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(rules, F.array(*[F.lit(r) for r in wanted])))
