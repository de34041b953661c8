"""Exact top-k inner-product search with block-at-a-time pruning.

Candidates are dealt by ranges of their id into segments, and a segment into blocks of consecutive
ids. Segments and blocks keep the largest and the smallest value of each dimension, their term maxima for
positive and negative query components; a block's forward index are the vectors themselves. The bound of
a segment or block for a query is the sum of its term maxima.

A query first visits the segment of greatest bound, in a task that holds that segment and a block of such
queries, and takes its k-th score on. Then it visits those of the others whose bound reaches that score;
pairs that can't reach it are never shipped, nor are scores below it. Within a segment a query scores blocks in the
order of their bounds and stops at the first whose bound is below the k-th score so far. The segments' maxima go to all
tasks if they take no more than BROADCAST_BYTES; beyond that every query visits every segment. Queries and segments meet
by a merge join, in TASKS tasks at most: pairs grow with the square of the input, so they are never broadcast, and each
segment is shuffled once a round. So neither side is held whole anywhere.

Defined results: a vector that is null, or has null or non-finite components, takes no part, nor does one
with a component beyond LARGEST once scaled or of more than LONGEST components, whose scores could leave
64 bits; dimensions that a vector lacks count as zero; equal scores go to the smaller id; rows that repeat an
id are candidates each, but never for a query of their own id; a null id takes no part; fewer than k
candidates give all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import measured, written
from .textbytes import tidy

SEGMENT, BLOCK, QUERY_BLOCK = 8192, 64, 4096
#: Maxima of segments are broadcast if they take no more bytes than this.
BROADCAST_BYTES = 32_000_000
#: What the driver keeps of a stage grows with its tasks, so segments share them beyond this.
TASKS = 1000
#: Stands for the k-th score of a query that has fewer.
NONE = -(2**63)
#: LONGEST products of two such numbers stay below 2**63.
LARGEST, LONGEST = 2**26, 2047


def _matrix(vectors: list[list[int]], dims: int, kind) -> np.ndarray:
    out = np.zeros((len(vectors), dims), kind)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search_segment(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, least: np.ndarray | None = None):
    """(query, candidate, score) of each query's k best candidates of other ids in the segment, of scores not below its least."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    starts = np.arange(0, len(cid), BLOCK)
    high, low = np.maximum.reduceat(c, starts), np.minimum.reduceat(c, starts)
    # Products stay exact in doubles below 2**53; beyond that integers are used.
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2**53
    kind = np.float64 if exact else np.int64
    c, qk = c.astype(kind), q.astype(kind)
    bounds = np.maximum(qk, 0) @ high.astype(kind).T + np.minimum(qk, 0) @ low.astype(kind).T
    turn = np.argsort(-bounds, axis=1, kind="stable")
    out = []
    for i in range(len(qid)):
        best_s, best_id, kth = np.zeros(0, kind), np.zeros(0, np.int64), None if least is None or least[i] == NONE else kind(least[i])
        for b in turn[i]:
            if kth is not None and bounds[i, b] < kth:
                break
            lo = starts[b]
            s, ids = c[lo : lo + BLOCK] @ qk[i], cid[lo : lo + BLOCK]
            keep = ids != qid[i]
            if kth is not None:
                keep &= s >= kth
            if not keep.any():
                continue
            s, ids = np.r_[best_s, s[keep]], np.r_[best_id, ids[keep]]
            top = np.lexsort((ids, -s))[:k]
            best_s, best_id = s[top], ids[top]
            if len(top) == k:
                kth = best_s[-1]
        out.append((np.full(len(best_id), qid[i]), best_id, best_s.astype(np.int64)))
    return (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (vec_id, embedding); queries have vec_id % every = 0."""
    x = F.col("embedding")
    whole = vectors.select(F.col("vec_id").cast("long").alias("id"), x.cast("array<double>").alias("x")).where("id is not null and x is not null and size(x) <= " + str(LONGEST) + f" and not exists(x, v -> v is null or isnan(v) or abs(v) > {LARGEST / 256}D)")
    ints = whole.select("id", F.expr("transform(x, v -> cast(floor(256 * v) as bigint))").alias("v"))
    size = ints.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0L, (a, y) -> greatest(a, abs(y)))")).alias("most")).first()
    total, segments = size.n, max(1, -(-size.n // SEGMENT))
    # Vectors travel in the smallest integers that hold them.
    sql, kind = next((x, y) for x, y, most in (("smallint", np.int16, 2**15 - 1), ("int", np.int32, 2**31 - 1), ("bigint", np.int64, 2**63)) if (size.most or 0) <= most)
    ints = ints.select("id", F.col("v").cast(f"array<{sql}>").alias("v"))
    # Range partitions give segments of about equal size; rows that repeat an id may be dealt to several.
    order = ["id", F.xxhash64("v")]
    dealt = ints.repartitionByRange(segments, *order)

    def pack(batches):
        """Rows of at most SEGMENT ids and vectors each."""
        held: list[tuple[int, list[int]]] = []

        def row():
            dims = max(len(v) for _, v in held)
            m = _matrix([v for _, v in held], dims, kind)
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([np.array([i for i, _ in held], np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["dims", "ids", "m"])

        for batch in batches:
            for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(pair)
                if len(held) == SEGMENT:
                    yield row()
                    held.clear()
        if held:
            yield row()

    made = "dims int, ids binary, m binary"
    # A segment's part is a number of its own; both sides are written, so that it stays.
    candidates = written(dealt.mapInArrow(tidy(pack), made).select(F.monotonically_increasing_id().alias("part"), "dims", "ids", "m"), "topk-segments")
    blocks = max(1, -(-total // (every * QUERY_BLOCK)))
    asked = ints.where(F.col("id") % every == 0).repartitionByRange(blocks, *order).mapInArrow(tidy(pack), made)
    asked = written(asked.select(F.monotonically_increasing_id().alias("block"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m")), "topk-queries")

    def maxima(batches):
        for batch in batches:
            for r in batch.to_pylist():
                m = np.frombuffer(r["m"], kind).reshape(-1, r["dims"]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]]), pa.array([m.max(0).tobytes()], pa.binary()), pa.array([m.min(0).tobytes()], pa.binary())], names=["part", "high", "low"])

    tops, bytes_ = measured(candidates.mapInArrow(tidy(maxima), "part long, high binary, low binary"), "topk-maxima", "high")

    def score(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dims = max(r["dims"], r["q_dims"])
                qid, cid = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, c = (np.pad(np.frombuffer(m, kind).reshape(len(i), d).astype(np.int64), ((0, 0), (0, dims - d))) for m, i, d in ((r["q_m"], qid, r["q_dims"]), (r["m"], cid, r["dims"])))
                a, b, s = search_segment(qid, q, cid, c, k, np.frombuffer(r["q_least"], np.int64))
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": a, "vec_id": b, "score": s}), preserve_index=False)

    def scored(pairs: DataFrame) -> DataFrame:
        """Scores of pairs, each some queries and the part of a segment that they visit."""
        tasks = min(segments, TASKS)
        met = pairs.repartition(tasks, "part").hint("merge").join(candidates.repartition(tasks, "part"), "part")
        return met.select("q_ids", "q_dims", "q_m", "q_least", "ids", "dims", "m").mapInArrow(tidy(score), "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if 2 * bytes_ > BROADCAST_BYTES:
        # Each block of queries is sent to each slot, and so to every segment that is dealt there.
        placed = candidates.select("part", F.expr(f"pmod(xxhash64(part), {segments})").alias("slot"))
        spread = asked.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(segments - 1).cast("long"))))
        none = F.udf(lambda ids: np.full(len(ids) // 8, NONE, np.int64).tobytes(), "binary")
        return top(scored(spread.hint("merge").join(placed, "slot").select("part", "q_ids", "q_dims", "q_m", none("q_ids").alias("q_least"))))
    rows = tops.collect()  # within BROADCAST_BYTES
    dims = max((len(r.high) // 8 for r in rows), default=0)
    # Dimensions that a segment lacks are zero.
    wide = lambda blobs: np.array([np.pad(np.frombuffer(x, np.int64), (0, dims - len(x) // 8)) for x in blobs], np.float64).reshape(len(rows), dims)
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r.part for r in rows], np.int64), wide([r.high for r in rows]), wide([r.low for r in rows])))

    def visits(first: bool):
        """For each part the queries that visit it: in the first round those whose best it is, then those of whom it can beat the k-th score."""

        def run(batches):
            part, high, low = sent.value
            for batch in batches:
                for r in batch.to_pylist():
                    ids = np.frombuffer(r["q_ids"], np.int64)
                    own = np.frombuffer(r["q_m"], kind).reshape(len(ids), r["q_dims"])
                    q = np.pad(own.astype(np.float64), ((0, 0), (0, max(0, dims - r["q_dims"]))))[:, :dims]
                    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    # What doubles may lose of sums of up to LONGEST products is far less than this.
                    bound += (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T) * 1e-9 + 1
                    go, lead = np.zeros(bound.shape, bool), (np.arange(len(ids)), bound.argmax(1))
                    least = np.full(len(ids), NONE)
                    if not first:
                        known = {x["query_id"]: x["kth"] for x in r["kth"]}
                        least = np.array([known.get(i, NONE) for i in ids.tolist()], np.int64)
                        go = bound >= least.astype(np.float64)[:, None]
                    go[lead] = first
                    for j in np.flatnonzero(go.any(0)):
                        i = np.flatnonzero(go[:, j])
                        yield pa.RecordBatch.from_arrays([pa.array([part[j]]), pa.array([ids[i].tobytes()], pa.binary()), pa.array([r["q_dims"]], pa.int32()), pa.array([own[i].tobytes()], pa.binary()), pa.array([least[i].tobytes()], pa.binary())], names=["part", "q_ids", "q_dims", "q_m", "q_least"])

        return tidy(run)

    visit = "part long, q_ids binary, q_dims int, q_m binary, q_least binary"
    lead = written(top(scored(asked.mapInArrow(visits(True), visit))), "topk-first")
    # Each block of queries gets its queries' k-th scores; one that has found fewer than k has none to reach.
    kth = lead.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("query_id", "kth")

    def listed(batches):
        for batch in batches:
            for block, x in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                ids = np.unique(np.frombuffer(x, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], names=["block", "query_id"])

    known = asked.select("block", "q_ids").mapInArrow(tidy(listed), "block long, query_id long").join(kth, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "kth")).alias("kth"))
    again = asked.join(known, "block", "left").select("q_ids", "q_dims", "q_m", F.coalesce("kth", F.array().cast("array<struct<query_id:bigint,kth:bigint>>")).alias("kth"))
    rest = scored(again.mapInArrow(visits(False), visit))
    return top(lead.select("query_id", "vec_id", "score").unionByName(rest))
