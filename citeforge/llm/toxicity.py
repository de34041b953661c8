"""Toxicity by class-conditional Kneser-Ney models.

Two word bigram models, of toxic and of ordinary labelled documents, with interpolated Kneser-Ney
smoothing. Counts are of different contexts, as in its lower orders, so that a passage that many
documents share counts once: n(h, w) is the number of different words before h w in the class. With D
the discount,

    P(w | h) = max(n(h, w) - D, 0) / n(h) + L(h) * P(w)         L(h) = D * |{w: n(h, w) > 0}| / n(h)
    P(w)     = max(k(w) - D, 0) / K       + D * V / K * S(w)    k(w) = |{h: n(h, w) > 0}|, K = sum of k

where L is 1 for a context that the class lacks, V is the number of its words (below the discount their
counts, so that the sums stay 1), and S is the shared distribution that both classes back off to:
(occurrences of w in all documents + 1) / (all occurrences + words + 1), with 1 / (...) left for a word
that no document has. D is larger than the textbook's discounts between 0 and 1: a count up to D keeps
no mass of its own and is left to the lower order, so bigrams of few different contexts weigh by their
context's L(h) and their word's P(w) alone. Discounts estimated from counts of counts let chance pairs of
words outweigh all else; cross-validated within the learning rows (README) they find four tenths of the
toxic rows, D = 4 finds 98 of 100.

A text is told by the difference of the two log-likelihoods, normalised by length: over the whole
text, over its most toxic passage of PASSAGE words, since one insult in a long text is one, and by
what its telling words add up to beside the logarithm of its length. No word says more than MOST. A
line over these, fitted on labelled rows that the counts have not seen, gives the probability.

Bounds: the class models are fitted on labelled rows of smallest hash, at most SAMPLE of each class
and SAMPLE_BYTES of their texts, no text longer than LONGEST among them; three quarters teach counts
and the rest the line, whose rows weigh as the class does among all labelled rows. So a model has at
most SAMPLE_BYTES / 2 bigrams of each class. The shared counts are a written table of every word of
all documents. Every text is scored whole.

Words are runs of letters, digits and bytes beyond ASCII, with A-Z lower-cased. Defined results: null
and empty texts get the score of a text without evidence and length; a null doc_id or label is never
learned from; a doc_id that repeats counts as often as it occurs; labels that contradict each other
count both ways; without labels of both classes every score is 0; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, written
from .textbytes import LOWER, mix, slices, split_words, tidy

SAMPLE, SAMPLE_BYTES, LONGEST = 20_000, 8_000_000, 400_000
#: Chosen, as MOST, by cross-validation within the learning rows: taught by those of crc32 mod 3 = 2, tried on those of 0.
DISCOUNT, PASSAGE = 4.0, 4
#: One word says no more than this, for or against: a rare pair of words in a shared passage is no proof.
MOST, TELLING, FEATURES = 3.0, 2.0, 4
#: Words that a task counts before it passes the counts on.
HELD = 2_000_000
#: Bits of the filter that keeps most bigrams that no class has from being looked up.
FILTER_BITS = 24
_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(texts):
    """Per slice: first row, the words, their hashes, the hash of the word before each (0: none), and that of both."""
    for a, _, data, base in slices(texts):
        w = split_words(LOWER[data], base, _SEP)
        h = w.hashes()
        before = np.zeros(len(h), np.uint64)
        if len(h) > 1:
            before[1:] = np.where(w.doc[1:] == w.doc[:-1], h[:-1], np.uint64(0))
        yield a, w, h, before, mix(h * np.uint64(3) + mix(before))


def sample(docs: DataFrame, labels: DataFrame, remainder: int, of: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic, fold) of the learning rows, written, and the number of labelled rows of each class; fold 0 is for the line."""
    use = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string")) % of != remainder)
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), F.xxhash64(F.lit("toxicity"), "doc_id").alias("h"))
        .distinct()
    )
    size = {r.toxic: r.n for r in use.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [use.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(SAMPLE) for c in (1, 0)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"octet_length(text) <= {LONGEST}")
    rows = written(texts.join(F.broadcast(chosen), "doc_id").groupBy("toxic", F.sha2("text", 256)).agg(F.first("text").alias("text"), F.min("h").alias("h")).select("text", "toxic", "h"), "toxicity-sample")
    # Sizes by hash, at most SAMPLE of a class; the last hash within the bound.
    per = rows.groupBy("toxic", "h").agg(F.sum(F.octet_length("text")).alias("bytes")).toArrow()
    toxic, h, size_ = (per.column(c).to_numpy() for c in ("toxic", "h", "bytes"))
    last = []
    for c in (1, 0):
        mine = np.flatnonzero(toxic == c)
        mine = mine[np.argsort(h[mine])]
        fits = np.flatnonzero(np.cumsum(size_[mine]) <= SAMPLE_BYTES)
        if len(fits):
            last.append((c, int(h[mine[fits[-1]]])))
    last = docs.sparkSession.createDataFrame(last, "of_class int, last long")
    within = rows.join(F.broadcast(last), (F.col("toxic") == F.col("of_class")) & (F.col("h") <= F.col("last")))
    return within.select("text", "toxic", F.when(F.pmod("h", F.lit(4)) == 0, 0).otherwise(1).alias("fold")), size


def bigram_counts(rows: DataFrame) -> DataFrame:
    """(key, before, word, n1, n0) of every bigram of rows (text, toxic): in how many different contexts, words before it, each class has it."""

    def count(batches):
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for a, w, h, before, pair in _words(batch.column(0)):
                if not len(h):
                    continue
                y = toxic[a + w.doc].astype(np.int32)
                two = np.zeros(len(h), np.uint64)
                two[1:] = np.where(w.doc[1:] == w.doc[:-1], before[:-1], np.uint64(0))
                context = mix(pair + np.uint64(0x9E3779B97F4A7C15) * mix(two + y.astype(np.uint64)))
                _, at = np.unique(context, return_index=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in (context, pair, before, h)), pa.array(y[at])], names=["context", "key", "before", "word", "toxic"])

    seen = rows.mapInArrow(tidy(count), "context long, key long, before long, word long, toxic int").dropDuplicates(["context"])
    return seen.groupBy("key").agg(F.first("before").alias("before"), F.first("word").alias("word"), F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often every word occurs in all documents."""

    def settled(held):
        word, n = np.unique(np.concatenate(held), return_counts=True)
        for lo in range(0, len(word), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(word[lo : lo + 100_000].view(np.int64)), pa.array(n[lo : lo + 100_000])], names=["word", "n"])

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for _, _, h, _, _ in _words(batch.column(0)):
                held.append(h)
                n += len(h)
                if n >= HELD:
                    yield from settled(held)
                    held, n = [], 0
        if n:
            yield from settled(held)

    return docs.select("text").mapInArrow(tidy(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, dict[int, float]] | None:
    """From bigram counts and shared word counts: (key, q1, q0) of bigrams, (word, p1, p0) of words,
    (before, l1, l0) of contexts, and D * V / K times the shared probability of an unseen word in each class."""
    total = counts.agg(*[F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (1, 0)]).first()
    if not total.k1 or not total.k0:
        return None
    cut = lambda x: F.sum(F.least(F.col(x), F.lit(DISCOUNT)))
    words = counts.groupBy("word").agg(*[F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (1, 0)])
    given = words.agg(*[cut(f"k{c}").alias(f"d{c}") for c in (1, 0)]).first()
    all_ = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    unseen = 1.0 / (all_.n + all_.v + 1)
    back = {c: given[f"d{c}"] / total[f"k{c}"] for c in (1, 0)}
    shared = (F.coalesce("n", F.lit(0)) + 1) * F.lit(unseen)
    p = lambda c: F.greatest(F.col(f"k{c}") - DISCOUNT, F.lit(0.0)) / total[f"k{c}"] + back[c] * shared
    word = words.join(every, "word", "left").select("word", p(1).alias("p1"), p(0).alias("p0"))
    context = counts.groupBy("before").agg(*[F.sum(f"n{c}").alias(f"c{c}") for c in (1, 0)], *[cut(f"n{c}").alias(f"d{c}") for c in (1, 0)])
    weigh = lambda c: F.when(F.col(f"c{c}") > 0, F.col(f"d{c}") / F.col(f"c{c}")).otherwise(1.0)
    context = context.select("before", "c1", "c0", weigh(1).alias("l1"), weigh(0).alias("l0"))
    q = lambda c: F.when(F.col(f"c{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"c{c}")).otherwise(0.0) + F.col(f"l{c}") * F.col(f"p{c}")
    pair = counts.join(context, "before").join(word, "word").select("key", q(1).alias("q1"), q(0).alias("q0"))
    return pair, word, context.select("before", "l1", "l0"), {c: back[c] * unseen for c in (1, 0)}


@dataclass
class Model:
    """Differences of log-probabilities, toxic minus ordinary, by sorted hash."""

    pairs: np.ndarray
    pair_diff: np.ndarray
    likely: np.ndarray  # a filter over pairs, in packed bits
    words: np.ndarray
    word_diff: np.ndarray
    contexts: np.ndarray
    context_diff: np.ndarray
    unseen: float
    line: tuple[float, ...] = ()

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, x: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(x), default)
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[i] == x, values[i], default)

    def differences(self, h: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log P1(w | h) - log P0(w | h) for each word."""
        cell = pair >> np.uint64(64 - FILTER_BITS)
        maybe = np.flatnonzero((self.likely[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1)
        i = np.minimum(np.searchsorted(self.pairs, pair[maybe]), max(len(self.pairs) - 1, 0))
        hit = self.pairs[i] == pair[maybe] if len(self.pairs) else np.zeros(len(maybe), bool)
        known = np.zeros(len(h), bool)
        known[maybe[hit]] = True
        out = np.zeros(len(h))
        out[maybe[hit]] = self.pair_diff[i[hit]]
        rest = np.flatnonzero(~known)
        out[rest] = self._find(self.contexts, self.context_diff, before[rest], 0.0) + self._find(self.words, self.word_diff, h[rest], self.unseen)
        # A bigram that repeats at once, as in "a a a a", is one piece of evidence, as it is one count in training.
        out[1:][pair[1:] == pair[:-1]] = 0.0
        return out

    def features(self, texts, n: int) -> np.ndarray:
        """Per text: difference per word over the whole text, over its most toxic passage, log(1 + what single words exceed TELLING by), and log(1 + words)."""
        out = np.zeros((n, FEATURES))
        for a, w, h, before, pair in _words(texts):
            if not len(h):
                continue
            d = np.clip(self.differences(h, before, pair), -MOST, MOST)
            up, strong = np.r_[0.0, np.cumsum(d)], np.r_[0.0, np.cumsum(np.maximum(d - TELLING, 0.0))]
            size = np.diff(w.first)
            full = np.flatnonzero(size)
            lo, hi = w.first[:-1][full], w.first[1:][full]
            end = np.minimum(np.arange(len(h)) + PASSAGE, np.repeat(hi, size[full]))
            best = np.maximum.reduceat(up[end] - up[: len(h)], lo) / PASSAGE
            out[a + full] = np.c_[(up[hi] - up[lo]) / size[full], best, np.log1p(strong[hi] - strong[lo]), np.log1p(size[full])]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.line[0] + x @ np.array(self.line[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sorted(df: DataFrame, key: str, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and log a - log b; as many rows as the sample has bigrams at most."""
    got = df.select(key, (F.ln(a) - F.ln(b)).cast("float").alias("d")).toArrow()
    keys = got.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column(1).to_numpy()[order]


def train(docs: DataFrame, labels: DataFrame, remainder: int, of: int) -> Model | None:
    """The model learned from labelled rows whose crc32(doc_id) mod ``of`` is not ``remainder``; None without both classes."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, size = sample(docs, labels, remainder, of)
    counts = written(bigram_counts(rows.where("fold = 1")), "toxicity-bigrams")
    got = probabilities(counts, written(word_counts(docs), "toxicity-words"))
    if got is None:
        return None
    pair, word, context, unseen = got
    pairs, pair_diff = _sorted(pair, "key", "q1", "q0")
    likely = np.zeros(1 << FILTER_BITS, bool)
    likely[pairs >> np.uint64(64 - FILTER_BITS)] = True
    model = Model(pairs, pair_diff, np.packbits(likely, bitorder="little"), *_sorted(word, "word", "p1", "p0"), *_sorted(context, "before", "l1", "l0"), float(np.log(unseen[1] / unseen[0])))
    seen = _apply(rows.where("fold = 0").select("text", F.col("toxic").alias("own")), model, "x", T.ArrayType(T.DoubleType()), lambda m, x: pa.array(list(x), pa.list_(pa.float64()))).toPandas()
    y = seen["own"].to_numpy(np.int64)
    x = np.array(seen["x"].tolist(), float).reshape(-1, FEATURES)
    model.line = _line(x, y, np.array([size.get(0, 0) / max(1, (y == 0).sum()), size.get(1, 0) / max(1, (y == 1).sum())]))
    return model


def _line(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Logistic regression of y on x by Newton's method; weights: of a row of each class."""
    if len(x) == 0 or y.min() == y.max():
        return (-3.0, 0.0, 4.0, 0.0, 0.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    weight = weights[y] / weights[y].sum()
    free = np.r_[1e-9, np.ones(x.shape[1])] * ridge
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (p - y)) + free * beta
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(free + 1e-12), grad)
        beta -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    slope = beta[1:] / scale
    return (float(beta[0] - slope @ mean), *map(float, slope))


def _apply(rows: DataFrame, model: Model | None, name: str, kind: T.DataType, finish) -> DataFrame:
    """rows (text, own) as own and a column: finish of the model and the text's features."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        got = shared.value
        for batch in batches:
            x = np.zeros((batch.num_rows, FEATURES)) if got is None else got.features(batch.column(0), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(1), finish(got, x)], names=["own", name])

    return rows.mapInArrow(tidy(run), T.StructType([rows.schema["own"], T.StructField(name, kind)]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with ``score`` and ``predicted`` added (replacing columns of these names)."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"))
    out = _apply(packed, model, "score", T.DoubleType(), lambda m, x: pa.array(np.zeros(len(x)) if m is None else m.probability(x)))
    return out.select(*[F.col("own").getField(c).alias(c) for c in keep], "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
