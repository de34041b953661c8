"""The engine's tables, derived from the driver's by expressions that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """(id, doi, title, authors, year, source); the title is the whole first sentence, and keys depend on the content, so copies collide."""
    d = table(spark, folder, "documents")
    digest = F.md5("text")
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(F.substring(digest, 1, 1).isin(*"012345"), F.concat(F.lit("10.5555/"), digest)).alias("doi"),
        F.trim(F.regexp_extract("text", "^[^.!?\n]*", 0)).alias("title"),
        F.array("lang", "source").alias("authors"),
        (2000 + F.col("n_chars") % 24).cast("int").alias("year"),
        "source",
    )


PAPERS = r"""papers AS (SELECT doc_id AS id,
    CASE WHEN substr(md5(text), 1, 1) IN ('0','1','2','3','4','5') THEN '10.5555/' || md5(text) END AS doi,
    trim(regexp_extract(text, '^[^.!?\n]*')) AS title,
    [lang, source] AS authors, CAST(2000 + n_chars % 24 AS INTEGER) AS year, source FROM documents)"""


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """(id, found, source, paper_id, queried_at) from events."""
    e, n = table(spark, folder, "events"), table(spark, folder, "documents").agg(F.count("*").alias("n"))
    return e.join(F.broadcast(n)).select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("found"), F.col("event_type").alias("source"), (F.col("event_id") % F.col("n")).alias("paper_id"), F.col("ts").alias("queried_at"))


LOG = """log AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS found, event_type AS source,
    event_id % (SELECT count(*) FROM documents) AS paper_id, ts AS queried_at FROM events)"""


def essays(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("essay_id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 20).alias("class_id"), F.col("o_orderdate").alias("uploaded_at"))


ESSAYS = "essays AS (SELECT o_orderkey AS essay_id, o_custkey AS user_id, o_custkey % 20 AS class_id, o_orderdate AS uploaded_at FROM orders)"


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """(essay_id, line, key, label, confidence, is_overridden); key is what is cited."""
    l = table(spark, folder, "lineitem")  # noqa: E741
    label = F.when(F.col("l_returnflag") == "R", "suspected_hallucination").when(F.col("l_returnflag") == "A", "metadata_error").when(F.col("l_linestatus") == "F", "unresolved").otherwise("verified")
    return l.select(F.col("l_orderkey").alias("essay_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("key"), label.alias("label"), ((F.col("l_orderkey") * 7919 % 1000) / 1000.0).alias("confidence"), (F.col("l_linenumber") == 7).alias("is_overridden"))


VERDICTS = """verdicts AS (SELECT l_orderkey AS essay_id, l_linenumber AS line, l_partkey AS key,
    CASE WHEN l_returnflag = 'R' THEN 'suspected_hallucination' WHEN l_returnflag = 'A' THEN 'metadata_error' WHEN l_linestatus = 'F' THEN 'unresolved' ELSE 'verified' END AS label,
    (l_orderkey * 7919 % 1000) / 1000.0 AS confidence, l_linenumber = 7 AS is_overridden FROM lineitem)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(id, y, p, pred): labelled documents with an integer-derived probability."""
    return table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"), ((F.col("doc_id") * 7919 % 1000) / 1000.0).alias("p")).withColumn("pred", F.when(F.col("p") >= 0.5, 1).otherwise(0))


PREDICTIONS = "predictions AS (SELECT doc_id AS id, quality AS y, (doc_id * 7919 % 1000) / 1000.0 AS p, CASE WHEN (doc_id * 7919 % 1000) >= 500 THEN 1 ELSE 0 END AS pred FROM labels)"
