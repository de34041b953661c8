"""Language identification by multilingual mixture inference.

Training counts, over all learning documents, how often each language uses each character n-gram
(of 1 to 3 lower-cased characters from letter to letter, in a fixed number of hash buckets). A text is then a mixture of
languages: expectation-maximisation estimates its proportions from the likelihoods of its n-grams.
The set of languages is the one of best penalised likelihood: sets are nested by proportion, and a
language more has to raise the likelihood by half the logarithm of the text's length. The prediction
is the language of the largest proportion in that set. Texts are counted in pieces of bounded size,
whole. More than MAX_LANGUAGES languages are refused.

Learning reads text and lang, prediction the text alone. Defined results: a text that is null or has
no letter is ``und`` with score 0; a null lang teaches nothing; without learning documents all is
``und``; equal proportions go to the language first by code point.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches
from .textbytes import tidy

BUCKETS, ROUNDS, GROUP = 4096, 12, 128
#: Characters that are counted at once; a longer text is counted piece by piece.
PIECE = 300_000
UNKNOWN = "und"
#: Languages at most; the table of counts is this times BUCKETS numbers.
MAX_LANGUAGES = 500


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)], bool)


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of at most GROUP texts and about PIECE characters, as (from, to)."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and (i - a == GROUP or size + len(t or "") > PIECE):
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text's n-grams by bucket, and whether it has a letter; memory is bounded whatever the texts' lengths."""
    if len(texts) == 1 and len(texts[0] or "") > PIECE:
        low = texts[0].lower()
        out, letter = np.zeros((1, BUCKETS)), np.zeros(1, bool)
        for at in range(0, len(low), PIECE):
            # Pieces share two characters; the n-grams of the shared ones alone are taken off again.
            got, any_ = _counts([low[at : at + PIECE + 2]])
            twice, _ = _counts([low[at + PIECE : at + PIECE + 2]])
            out, letter = out + got - twice, letter | any_
        return out, letter
    return _counts([(t or "").lower() for t in texts])


def _counts(joined: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in joined])
    c = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(joined)), size)
    letter = _letters()[c.astype(np.int64)]
    # Anything but letters is one kind of gap; texts are kept apart by their rows.
    c = np.where(letter, c, np.uint64(32))
    any_letter = np.bincount(row, letter, len(joined)) > 0
    out = np.zeros((len(joined), BUCKETS))
    flat = out.reshape(-1)
    for n in (1, 2, 3):
        if len(c) < n:
            break
        h = c[: len(c) - n + 1] * np.uint64(n)
        for i in range(1, n):
            h = h * np.uint64(0x100000001B3) + c[i : len(c) - n + 1 + i]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        ok = (row[: len(h)] == row[n - 1 :]) & letter[: len(h)] & letter[n - 1 :]
        flat += np.bincount(row[: len(h)][ok] * BUCKETS + h[ok].astype(np.int64), minlength=len(flat))
    return out, any_letter


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each bucket in each of them."""
    small_batches(docs.sparkSession)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in groups(texts):
                got, _ = gram_counts(texts[a:b])
                for lang in set(langs[a:b]):
                    mine = [i for i, x in enumerate(langs[a:b]) if x == lang]
                    total[lang] = total.get(lang, 0) + got[mine].sum(0)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = docs.where("lang is not null").select("text", "lang").mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).limit(MAX_LANGUAGES * BUCKETS + 1).toArrow()
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = {x: i for i, x in enumerate(languages)}
    table = np.full((len(languages), BUCKETS), 0.5)
    if names:
        table[[place[x] for x in names], rows.column("bucket").to_numpy()] += rows.column("n").to_numpy()
    return languages, table / table.sum(1, keepdims=True)


def _em(counts: np.ndarray, model: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text over the allowed languages, and the log-likelihood."""
    total = counts.sum(1, keepdims=True)
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(rounds):
        share = share * ((counts / np.maximum(share @ model, 1e-300)) @ model.T) / np.maximum(total, 1)
    return share, (counts * np.log(np.maximum(share @ model, 1e-300))).sum(1)


def infer(counts: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions in the chosen set of languages, and the size of that set."""
    n, k = len(counts), len(model)
    full, _ = _em(counts, model, np.ones((n, k)), ROUNDS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    penalty = 0.5 * np.log(np.maximum(counts.sum(1), 2))
    best, size, worth = None, np.zeros(n, int), np.full(n, -np.inf)
    open_ = np.arange(n)
    for m in range(1, k + 1):  # a text's sets grow until one more language does not pay
        share, like = _em(counts[open_], model, (rank[open_] < m).astype(float), 0 if m == 1 else ROUNDS)
        gain = like - penalty[open_] * m
        better = gain > worth[open_]
        best = share.copy() if best is None else best
        at = open_[better]
        best[at], size[at], worth[at] = share[better], m, gain[better]
        open_ = at
        if not len(open_):
            break
    return best, size


def identify(docs: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """docs with ``lang_pred``, ``score`` (proportion of that language) and ``languages`` (the chosen set) added."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((languages, model))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "languages")]
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"))

    def predict(batches):
        names, table = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            pred, score, sets = [], [], []
            for a, b in groups(texts):
                counts, letter = gram_counts(texts[a:b])
                if not names:
                    letter[:] = False
                else:
                    share, _ = infer(counts, table)
                for i in range(len(counts)):
                    if not letter[i]:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        sets.append([])
                        continue
                    j = int(np.argmax(share[i]))
                    pred.append(names[j])
                    score.append(float(min(1.0, share[i, j])))
                    sets.append([names[x] for x in np.argsort(-share[i], kind="stable") if share[i, x] > 1e-3])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))], names=["own", "lang_pred", "score", "languages"])

    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType()))]
    out = packed.mapInArrow(tidy(predict), T.StructType([packed.schema["own"], *made]))
    return out.select(*[F.col("own").getField(c).alias(c) for c in keep], "lang_pred", "score", "languages")


def held_out(remainder: int, of: int):
    return F.crc32(F.col("doc_id").cast("string")) % of == remainder
