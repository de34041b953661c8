"""Centroid clustering: plain Lloyd over whole numbers, so that results are the same on every cluster.

A component x counts as floor(scale * x). The centroids, a few vectors, are broadcast to the tasks;
mapInPandas takes integer squared differences to each of them in NumPy, and argmin the lowest index of
the nearest. A task adds up its vectors by cluster and component; these sums, never vectors, meet in a
groupBy, k * dims rows of which reach the driver. A centroid becomes the floor of sum by count; an empty one stays. Rounds end
early when no centroid moves, since no later round would change anything.

Defined results: vectors that are null, are not of ``dims`` components, or hold a null or non-finite one
take no part, nor do those with a component beyond LARGEST once scaled, whose distances could leave 64
bits; fewer vectors than k give as many centroids; a vector without id can be a first centroid only after
all others; rows that repeat an id are vectors each, and stand in the order of their components; an inertia
beyond 64 bits is null; columns besides ``vec_id`` and ``embedding`` are left out; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Differences of two such numbers, squared and summed over 64 components, stay within 2**62.
LARGEST = 2**27


def whole_numbers(vectors: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, x array<int>) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(f"x is not null and size(x) = {dims} and not exists(x, v -> v is null or isnan(v) or abs(v) > {LARGEST / scale}D)")
    return fit.select("vec_id", F.expr(f"transform(x, v -> cast(floor({scale} * v) as int))").alias("x"))


def first_centroids(points: DataFrame, k: int, start: Column) -> list[list[int]]:
    """The k points of smallest start, then id and components; null last."""
    rows = points.orderBy(start.asc_nulls_last(), F.col("vec_id").asc_nulls_last(), "x").limit(k).select("x").collect()
    return [list(r.x) for r in rows]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of x; of equal distances the lowest cluster."""
    d = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        diff = x - c
        np.einsum("ij,ij->i", diff, diff, out=d[:, j])
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best]


def _stacked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for pdf in batches:
        if len(pdf):
            yield pdf["vec_id"], np.stack(pdf["x"].to_numpy()).astype(np.int64)


def step(points: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round of assigning and averaging."""
    sent = points.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        total, count = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for _, x in _stacked(batches):
            best, _ = nearest(x, c)
            np.add.at(total, best, x)
            count += np.bincount(best, minlength=len(c))
        j, i = np.divmod(np.arange(c.size), c.shape[1])
        got = pd.DataFrame({"cluster": j, "part": i, "total": total.ravel(), "n": count[j]})
        yield got[got["n"] > 0]

    merged = points.mapInPandas(sums, "cluster long, part long, total long, n long").groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = [list(c) for c in centroids]
    for r in merged.collect():  # k * dims rows
        out[r.cluster][r.part] = int(r.total) // r.n
    sent.unpersist()
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, start: Column | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) for each vector that takes part, and the centroids.

    start orders the vectors by vec_id; the first k are the first centroids."""
    points = written(whole_numbers(vectors, dims, scale), "lloyd-points")
    start = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256) if start is None else start
    centroids = first_centroids(points, k, start)
    for _ in range(rounds if centroids else 0):
        moved = step(points, centroids)
        if moved == centroids:
            break
        centroids = moved
    sent = points.sparkSession.sparkContext.broadcast(np.array(centroids, np.int64).reshape(len(centroids), dims))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _stacked(batches):
            best, d = nearest(x, sent.value)
            yield pd.DataFrame({"vec_id": ids, "cluster": best, "distance": d})

    return written(points.mapInPandas(assign, "vec_id long, cluster int, distance long"), "lloyd-clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned with the sums of distances over each cluster and over all, and each centroid's digest."""
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(total.alias("total")).collect()}  # k rows
    fit = lambda n: n if n < 2**63 else None
    rows = [(j, fit(per.get(j, 0)), fit(sum(per.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    table = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
