"""A kept inverted index with ranked search for many queries at once, weighted like SQLite's FTS5.

The index is a folder of Parquet, ``postings``: a row for each word and block of documents, with the places in the block of
those that hold it and how often they do, packed; and a row of no word for each block, with its documents' ids and lengths.
Rows are partitioned by a hash of the word and sorted by it. A segment is written once, documents are added as further
segments. A search reads the rows of its words alone.

The rows that a search needs meet by block, and only they are shuffled, three bytes or so a posting. A task goes through its
blocks one by one with all queries, those of the same words once: where a block holds a query's rarest word, the places of
its words are cut with each other and scored there, and what is kept are the best of each query so far. So no match ever
leaves its block but for these: what is shuffled after grows with queries and tasks, not with the texts that words are in.
A word that a third of all documents hold has its postings in as many blocks, never in one row or task.

Weights: idf is ln((N - n + 0.5) / (n + 0.5)), at least 1e-6; scores are sums over words of millionths, rounded. Ids are
whole numbers, unique in the index; rows that repeat one in a segment are one document together. Null texts have no word.
A query without words finds nothing; a document without id is left out. Words are not stemmed unless ``words`` does so.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import written

K1, B = 1.2, 0.75
#: Places in a block are numbers of two bytes, so it has at most 65,536 documents.
BUCKETS, BLOCK = 32, 4096
#: Queries go to all tasks if they have no more words than this; more go so in several passes.
BROADCAST_WORDS = 500_000
_MADE = "word string, block bigint, n int, words bigint, places binary, tfs binary"
_ROWS = "word string, segment string, block bigint, n int, words bigint, places binary, tfs binary, bucket int"


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case, repeats kept."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _postings(batches: Iterator[pa.RecordBatch], block_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, words) of a task as postings of each block, so many documents as they come; neighbours of one id are one document."""
    kinds = {"word": pa.string(), "block": pa.int64(), "n": pa.int32(), "words": pa.int64(), "places": pa.binary(), "tfs": pa.binary()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=[*kinds])

    def packed(block: int, docs: list[tuple[int, Counter]]) -> Iterator[pa.RecordBatch]:
        lists: dict[str, tuple[list, list]] = {}
        for place, (_, counts) in enumerate(docs):
            for word, tf in counts.items():
                places, tfs = lists.setdefault(word, ([], []))
                places.append(place)
                tfs.append(tf)
        lens = [counts.total() for _, counts in docs]
        yield batch_of([("", block, len(docs), sum(lens), np.array([i for i, _ in docs], "<i8").tobytes(), np.array(lens, "<i4").tobytes())])
        keys = sorted(lists)
        for lo in range(0, len(keys), 5000):
            rows = []
            for word in keys[lo : lo + 5000]:
                places, tfs = lists[word]
                rows.append((word, block, len(places), sum(tfs), np.array(places, "<u2").tobytes(), bytes(tfs) if max(tfs) < 256 else np.array(tfs, "<i4").tobytes()))
            yield batch_of(rows)

    # Numbers of blocks are a task's own, and the same if it runs again.
    block_docs = min(block_docs, 1 << 16)
    block, docs = TaskContext.get().partitionId() << 32, []
    for batch in batches:
        for id_, words in zip(*(batch.column(i).to_pylist() for i in range(2))):
            if docs and docs[-1][0] == id_:
                docs[-1][1].update(words)
                continue
            if len(docs) == block_docs:
                yield from packed(block, docs)
                block, docs = block + 1, []
            docs.append((id_, Counter(words)))
    if docs:
        yield from packed(block, docs)


def add(docs: DataFrame, path: str, words=words_of, block: int = BLOCK, buckets: int = BUCKETS) -> None:
    """Writes docs (id, text) as a new segment of the index at path.

    A block is what a task reads on end, and its postings are made and written where its texts are: neither is shuffled. Only
    rows that repeat an id go to one task first, as a segment of their own."""
    known = docs.where("id is not null").select(F.col("id").cast("bigint").alias("id"), "text")
    twice = known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if twice.isEmpty():
        _segment(known, path, words, block, buckets)
        return
    _segment(known.join(twice, "id", "left_anti"), path, words, block, buckets)
    _segment(known.join(twice, "id", "left_semi").repartition("id").sortWithinPartitions("id"), path, words, block, buckets)


def _segment(docs: DataFrame, path: str, words, block: int, buckets: int) -> None:
    rows = docs.select("id", words(F.col("text")).alias("words")).mapInArrow(lambda batches: _postings(batches, block), _MADE)
    bucket = F.when(F.col("word") == "", -1).otherwise(F.expr(f"pmod(xxhash64(word), {buckets})")).cast("int")
    out = rows.withColumn("bucket", bucket).sortWithinPartitions("bucket", "word", "block")
    out = out.select("word", F.lit(uuid.uuid4().hex).alias("segment"), "block", "n", "words", "places", "tfs", "bucket")
    out.write.mode("append").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")


def _best(score: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The top highest scores and their ids, equal ones by id."""
    if len(score) > top:
        near = score >= np.partition(score, len(score) - top)[len(score) - top]
        score, ids = score[near], ids[near]
    order = np.lexsort((ids, -score))[:top]
    return score[order], ids[order]


class Index:
    """The index at path, as it is when a search runs."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def search(self, queries: DataFrame, top: int = 10, words=words_of) -> DataFrame:
        """(query_id, rank, id, score) of the best documents that hold all words of each query (query_id, text)."""
        rows = self.spark.read.schema(_ROWS).parquet(f"{self.path}/postings")
        size = rows.where("bucket = -1").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        many, mean = size.n or 0, (size.words or 0) / size.n if size.words else 1.0
        asked = queries.select("query_id", F.array_sort(F.array_distinct(words(F.col("text")))).alias("words")).where("size(words) > 0").withColumn("key", F.array_join("words", "\0"))
        sets = written(asked.select("key", "words").distinct().withColumn("set", F.monotonically_increasing_id()), "searches")
        passes = max(1, -(-(sets.agg(F.sum(F.size("words")).alias("n")).first().n or 0) // BROADCAST_WORDS))
        found = None
        for turn in range(passes):
            part = sets.where(F.expr(f"pmod(xxhash64(key), {passes}) = {turn}"))
            got = self._found(rows, part, top, many, mean)
            found = got if found is None else found.unionByName(got)
        place = Window.partitionBy("set").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        return asked.select("query_id", "key").join(sets.select("key", "set").join(ranked, "set"), "key").select("query_id", "rank", "id", "score")

    def _found(self, rows: DataFrame, sets: DataFrame, top: int, many: int, mean: float) -> DataFrame:
        """(set, id, score) of each task's best documents for sets (set, words)."""
        wanted = F.broadcast(sets.select(F.explode("words").alias("word")).distinct().withColumn("bucket", F.expr(f"pmod(xxhash64(word), {self.buckets})").cast("int")))
        held = rows.where("bucket >= 0").join(wanted, ["bucket", "word"])
        df = {r.word: r.df for r in held.groupBy("word").agg(F.sum("n").alias("df")).collect()}  # within BROADCAST_WORDS
        # Words from rare to frequent; a query with a word that no document holds finds nothing.
        names = sorted(df, key=lambda w: (df[w], w))
        number = {w: i for i, w in enumerate(names)}
        idf = [max(math.log((many - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) for w in names]
        leads: dict[int, list[tuple]] = {}
        for r in sets.select("set", "words").collect():
            if all(w in number for w in r.words):
                first, *others = sorted(number[w] for w in r.words)
                leads.setdefault(first, []).append((r.set, others))
        sent = self.spark.sparkContext.broadcast((number, idf, leads))

        def score(batches):
            number, idf, leads = sent.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for _, block in groupby((r for b in batches for r in b.to_pylist()), lambda r: (r["segment"], r["block"])):
                own = next(block)  # the row of no word
                ids, lens = np.frombuffer(own["places"], "<i8"), np.frombuffer(own["tfs"], "<i4")
                norm = K1 * (1 - B + B * lens / mean)
                packed = {number[r["word"]]: (r["places"], r["tfs"]) for r in block}
                parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                wide: dict[int, np.ndarray] = {}

                def part(w: int) -> tuple[np.ndarray, np.ndarray]:
                    """Places of a word and its part of their scores."""
                    if w not in parts:
                        places, tfs = packed[w]
                        at = np.frombuffer(places, "<u2").astype(np.int64)
                        tf = np.frombuffer(tfs, np.uint8 if len(tfs) == len(at) else "<i4").astype(np.float64)
                        parts[w] = at, np.floor(1e6 * idf[w] * tf * (K1 + 1) / (tf + norm[at]) + 0.5).astype(np.int64)
                    return parts[w]

                def spread(w: int) -> np.ndarray:
                    """Its part at each place of the block, -1 where it is not."""
                    if w not in wide:
                        wide[w] = np.full(len(ids), -1)
                        at, got = part(w)
                        wide[w][at] = got
                    return wide[w]

                for lead in packed.keys() & leads.keys():
                    for q, others in leads[lead]:
                        if not all(w in packed for w in others):
                            continue
                        at, total = part(lead)
                        for w in others:
                            more = spread(w)[at]
                            keep = more >= 0
                            at, total = at[keep], total[keep] + more[keep]
                            if not len(at):
                                break
                        before = best.get(q)
                        if before and len(before[0]) == top:
                            keep = total >= before[0][-1]
                            at, total = at[keep], total[keep]
                        if len(at):
                            found = ids[at]
                            best[q] = _best(*((np.r_[before[0], total], np.r_[before[1], found]) if before else (total, found)), top)
            qs = list(best)
            for lo in range(0, len(qs), 5000):
                got = [(q, *best[q]) for q in qs[lo : lo + 5000]]
                cols = [np.repeat([g[0] for g in got], [len(g[1]) for g in got]), np.concatenate([g[2] for g in got]), np.concatenate([g[1] for g in got])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["set", "id", "score"])

        need = ["segment", "block", "word", "places", "tfs"]
        tasks = 3 * self.spark.sparkContext.defaultParallelism
        met = rows.where("bucket = -1").select(need).unionByName(held.select(need)).repartition(tasks, "segment", "block").sortWithinPartitions("segment", "block", "word")
        return met.mapInArrow(score, "set long, id long, score long")
