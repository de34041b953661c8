"""Results kept for each document and made anew only where the document has changed or the result is too old.

The kept results are one table of :class:`..sources.versions.Versions`, so a reader sees those before a refresh or after it. A
refresh joins documents to results by id, hands those on that need it to ``compute``, and writes the rest as it is. As a stream's
batch function it does the same for each batch of documents that arrive.

Defined results: a null text has a hash of its own; of rows that repeat a doc_id in a batch the one of greatest hash counts;
documents that a batch lacks keep their results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Versions

TABLE = "results"


def content_hash(text: Column) -> Column:
    return F.sha2(F.concat(F.when(text.isNull(), "-").otherwise("="), F.coalesce(text, F.lit(""))), 256)


def stale(docs: DataFrame, kept: DataFrame | None, now: int, max_age: int) -> DataFrame:
    """docs (doc_id, text) with their hash, without those whose kept result (doc_id, hash, made_at) is of the same text and not older than max_age."""
    hashed = docs.select("doc_id", "text", content_hash(F.col("text")).alias("hash"))
    one = hashed.groupBy("doc_id").agg(F.max_by("text", "hash").alias("text"), F.max("hash").alias("hash"))
    if kept is None:
        return one
    fresh = kept.where(F.col("made_at") >= now - max_age).select("doc_id", "hash")
    return one.join(fresh, ["doc_id", "hash"], "left_anti")


def refresh(store: Versions, docs: DataFrame, compute: Callable[[DataFrame], DataFrame], now: int, max_age: int) -> int:
    """Makes the next version of the results with those of stale docs from compute (doc_id, text -> doc_id, ...); returns how many were made."""
    at = store.current()
    kept = store.tables(at).get(TABLE)
    todo = stale(docs, kept, now, max_age).persist()
    try:
        many = todo.count()
        if many:
            made = todo.select("doc_id", "hash", F.lit(now).cast("long").alias("made_at")).join(compute(todo.select("doc_id", "text")), "doc_id")
            whole = made if kept is None else kept.join(todo.select("doc_id"), "doc_id", "left_anti").unionByName(made)
            store.commit({TABLE: whole}, after=at)
        return many
    finally:
        todo.unpersist()


def follow(stream: DataFrame, store: Versions, compute: Callable[[DataFrame], DataFrame], clock: Callable[[], int], max_age: int, checkpoint: str):
    """A started query that refreshes the results with each batch of the stream (doc_id, text).

    A batch that is run again after a failure finds its results fresh and makes none twice."""
    return stream.writeStream.foreachBatch(lambda batch, _: refresh(store, batch, compute, clock(), max_age)).option("checkpointLocation", checkpoint).start()
