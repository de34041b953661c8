"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

The rates of documents are those closest to one, in relative entropy over documents, for which every
source's expected tokens equal its target, no rate above the cap. Their form is exponentially tilted by
size, min(cap, exp(lambda * size / scale)) with a lambda for each source and its mean size as scale:
longer documents come more often where a source has to grow, and give way first where it has to shrink.
The lambdas minimise the convex dual; its gradient is expected tokens less target, and each Newton
iteration is one aggregation over all documents, pre-summed in every task, so that a source with a
third of the rows is no group of its own anywhere. A step that leaves what is known to hold the
minimum is halved into it. A target of cap times the size takes all documents at the cap.

Rates become whole copies by a hash of the document as threshold, shifted by one offset for each
source; the offset is searched, in a few aggregations, for the least distance from the target.

Sums are of whole numbers (billionths of a word), so reruns agree to the last bit.

Defined results: a null or empty text has size 0 and 0 or more copies that take nothing; null is a
source of its own, the last; rows that repeat doc_id and text get the same copies; an empty table
gives an empty table. Sources are listed on the driver, MAX_SOURCES at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import measured, written

WORD = r"[^\x20\x09-\x0D]+"
MAX_SOURCES = 200_000
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
STEPS = 16
#: Copies are broadcast to the texts if they take no more bytes than this, else both are shuffled.
BROADCAST_BYTES = 32_000_000
_MICRO = 1_000_000_000


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Tokens of each source: share of all by weight, none above cap times its size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def _micro_sum(x: Column) -> Column:
    return F.sum(F.round(x * F.lit(float(_MICRO))).cast("decimal(38,0)"))


def _with(base: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """base with columns of its source's row, which are broadcast unless the sources' names are too long in all."""
    side = base.sparkSession.createDataFrame(rows, "of_source string, " + names)
    small = sum(100 + 4 * len(r[0] or "") for r in rows) <= BROADCAST_BYTES
    return base.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


#: Stands for a lambda beyond which all documents are at the cap.
_FULL = 1e9


def _rate(cap: float) -> Column:
    """A document's rate from lam and scale of its source; without lam it is 0."""
    tilted = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(700.0))), F.lit(cap))
    return F.when(F.col("lam").isNull(), 0.0).when(F.col("lam") >= _FULL, cap).otherwise(tilted)


def _newton(base: DataFrame, size: dict, count: dict, target: dict, cap: float) -> dict[str | None, tuple[float | None, float]]:
    """(lambda, scale) of each source at the dual's minimum; lambda None where the target is 0."""
    scale = {s: max(1.0, size[s] / max(1, count[s])) for s in size}
    out: dict = {s: (None, scale[s]) for s in size} | {s: (_FULL, scale[s]) for s in size if target[s] > 0 and target[s] >= cap * size[s] * (1 - 1e-12)}
    at = {s: 0.0 for s in size if target[s] > 0 and out[s][0] is None}
    bracket = {s: [-1e6, 1e6] for s in at}
    for _ in range(80):
        if not at:
            break
        tilt = F.col("lam") * F.col("size") / F.col("scale")
        slope = F.when(F.exp(F.least(tilt, F.lit(700.0))) < cap, F.col("size") / F.col("scale") * F.exp(F.least(tilt, F.lit(700.0)))).otherwise(0.0)
        got = _with(base, [(s, v, scale[s]) for s, v in at.items()], "lam double, scale double").groupBy("source").agg(_micro_sum(F.col("size") * _rate(cap)).alias("taken"), _micro_sum(F.col("size") * slope).alias("slope")).collect()
        for r in got:
            s, gradient, second = r.source, float(r.taken) / _MICRO - target[r.source], float(r.slope) / _MICRO
            out[s] = (at[s], scale[s])
            bracket[s][0 if gradient < 0 else 1] = at[s]
            lo, hi = bracket[s]
            if abs(gradient) < 1e-10 * target[s] or hi - lo < 1e-15 * max(1.0, abs(lo)):
                del at[s]
                continue
            step = at[s] - gradient / second if second > 0 else hi
            # Newton's step, unless it leaves the bracket; far ones are taken in parts.
            step = max(at[s] - 2.0, min(at[s] + 2.0, step))
            at[s] = step if lo < step < hi else (lo + hi) / 2
    return out


def _copies(rate: Column, u: Column, offset: Column, cap: float) -> Column:
    return F.least(F.greatest(F.floor(rate + u + offset), F.lit(0)), F.lit(int(cap))).cast("long")


def _offsets(base: DataFrame, tilt: dict, target: dict, cap: float) -> dict[str | None, float]:
    """For each source the offset at which its copies take the tokens nearest its target."""
    span = {s: (-1.0, 1.0) for s in target}
    best: dict[str | None, tuple[float, float]] = {}
    for _ in range(5):
        joined = _with(base, [(s, *tilt[s], *span[s]) for s in span], "lam double, scale double, lo double, hi double")
        at = lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(j / STEPS)
        got = joined.groupBy("source").agg(*[F.sum(F.col("size") * _copies(_rate(cap), F.col("u"), at(j), cap)).alias(f"t{j}") for j in range(STEPS + 1)]).collect()
        for r in got:
            lo, hi = span[r.source]
            taken = [r[f"t{j}"] for j in range(STEPS + 1)]
            off = [lo + (hi - lo) * (j / STEPS) for j in range(STEPS + 1)]
            for t, o in zip(taken, off):
                gap = abs(t - target[r.source])
                if r.source not in best or gap < best[r.source][0]:
                    best[r.source] = (gap, o)
            j = max([i for i in range(STEPS) if taken[i] <= target[r.source]], default=0)
            span[r.source] = (off[j], off[j + 1])
    return {s: o for s, (_, o) in best.items()}


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(doc_id, source, th, size, source_size, target, rate, copies, taken) for each row of docs.

    th is xxhash64 of the text, for joining copies back where a doc_id repeats."""
    u = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("th")), F.lit(2**40)) / F.lit(float(2**40))
    base = written(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("th"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")).withColumn("u", u), "mix-sizes"
    )
    per = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("count"))
    found = per.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    size, count = {r.source: r["size"] for r in found}, {r.source: r["count"] for r in found}
    target = targets(size, weights, share, cap)
    tilt = _newton(base, size, count, target, cap)
    offset = _offsets(base, tilt, target, cap) if size else {}
    # What is left of a gap, mostly part of one long document, is shared out among documents shorter than it.
    first = _copies(_rate(cap), F.col("u"), F.col("offset"), cap)
    once = _with(base, [(s, *tilt[s], offset[s]) for s in size], "lam double, scale double, offset double").groupBy("source").agg(F.sum(F.col("size") * first).alias("t")).collect()
    gap = {r.source: target[r.source] - r.t for r in once}
    short = _with(base, [(s, abs(gap[s]), *tilt[s], offset[s]) for s in size], "limit double, lam double, scale double, offset double").where("size <= limit").withColumn("now", F.col("size") * first)
    small = {r.source: r.t for r in short.groupBy("source").agg(F.sum("now").alias("t")).collect()}
    offset2 = _offsets(short.drop("lam", "scale", "offset", "limit", "now"), tilt, {s: t + gap[s] for s, t in small.items()}, cap) if small else {}
    final = _with(base, [(s, int(size[s]), float(target[s]), *tilt[s], offset[s], abs(gap[s]), offset2.get(s, offset[s])) for s in size], "source_size long, target double, lam double, scale double, offset double, limit double, offset2 double")
    copies = _copies(_rate(cap), F.col("u"), F.when(F.col("size") <= F.col("limit"), F.col("offset2")).otherwise(F.col("offset")), cap)
    return final.withColumn("rate", _rate(cap)).withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("u", "lam", "scale", "offset", "offset2", "limit")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it has copies, with all its columns, whatever their names."""
    plan = mix(docs, **options).groupBy("doc_id", "source", "th").agg(F.max("copies").alias("copies"))
    plan, size = measured(plan.where("copies > 0").select(*[F.col(c).alias(f"mix_{c}") for c in plan.columns]), "mix-copies", "mix_source")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("of"), F.xxhash64("text").alias("th"))
    same = F.col("id").eqNullSafe(F.col("mix_doc_id")) & F.col("of").eqNullSafe(F.col("mix_source")) & (F.col("th") == F.col("mix_th"))
    joined = rows.join(F.broadcast(plan) if size <= BROADCAST_BYTES else plan, same)
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("row.*")
