"""Quality rules by weak supervision, with DataFrame operations only.

Each rule votes good, votes bad or abstains. The votes of all documents are counted by pattern, at
most 3 ** len(RULES) of them, and expectation-maximisation over these counts estimates the share of
good documents, how often each rule fires by mistake, and how often on each kind of bad ones. A
document is kept if its posterior probability of being good is at least one half and it passes the
base rules. So one vote against is no veto: it counts by how reliable its rule turned out.

Defined results: a null or empty text has no words, fails the base rules and is not kept; rows that
repeat are judged each; doc_id may be null; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Between words, as the inside of a character class.
WHITE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 8  # a power of two
ITERATIONS = 3000
PRIOR = 20
#: Imagined documents of a kind on which another kind's rule has no cause to fire: votes that mistakes explain are left to them.
SPARSE = 200
#: Part of each rule's votes against that EM takes for mistakes at first.
START = 0.1

# (name, bad if, good if); neither: the rule abstains. Shares are of words unless named otherwise.
RULES: tuple[tuple[str, str, str], ...] = (
    ("length", "n_words < 20", "n_words >= 50"),
    ("word_length", "word_chars > 7 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 6 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words", "50 * n_symbols < n_words"),
    ("lines", "n_dup_lines > 0", "n_dup_lines = 0"),
    ("one_line", "n_lines = 1 and n_words >= 100", "n_lines > 1"),
    ("repeats", "100 * n_repeat_words > 27 * n_words", "n_repeat_words = 0"),
    ("capitals", "2 * n_upper > word_chars", "5 * n_upper < word_chars"),
    ("exclaims", "2 * n_exclaim > n_words", "10 * n_exclaim < n_words"),
    ("stutter", "100 * n_stutter > 20 * n_words", "100 * n_stutter < 3 * n_words"),
    ("sentences", "n_stops = 0 and n_words >= 50", "n_stops between 1 and n_words / 2"),
)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_exclaim, n_stops, n_stutter)."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, f"[{WHITE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    one = docs.select(
        "doc_id",
        words.alias("words"),
        lines.alias("lines"),
        count(f"[{SYMBOLS}]").alias("n_symbols"),
        count("[A-Z]").alias("n_upper"),
        count("!").alias("n_exclaim"),
        count("[.?]").alias("n_stops"),
    )
    base = [
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
        "n_exclaim",
        "n_stops",
    ]
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_exclaim", "n_stops", "n_stutter"]
    table = one.select("doc_id", *base, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    stutter = F.size(F.expr("filter(hashes, (h, i) -> i > 0 and h = hashes[greatest(i - 1, 0)])")).cast("long")
    table = table.withColumn("n_stutter", stutter)
    # Hashes of one word become those of two, of four and of WINDOW words.
    width = 1
    while width < WINDOW:
        pairs = F.expr(f"zip_with(slice(hashes, 1, greatest(size(hashes) - {width}, 0)), slice(hashes, {width + 1}, size(hashes)), (x, y) -> xxhash64(x, y))")
        table = table.select(*counts, pairs.alias("hashes"))
        width *= 2
    table = table.select(*counts, "hashes", (F.size("hashes") > F.size(F.array_distinct("hashes"))).alias("repeats"))
    # Windows by hash and place; those equal to a neighbour in this order occur more than once.
    table = table.select(*counts, F.when(F.col("repeats"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    places = F.expr("sort_array(transform(filter(sorted, (x, k) -> (k > 0 and x.h = sorted[greatest(k - 1, 0)].h) or (k < size(sorted) - 1 and x.h = sorted[least(k + 1, size(sorted) - 1)].h)), x -> x.i))")
    table = table.select(*counts, places.alias("places"))
    covered = F.expr(f"case when places is null or size(places) = 0 then 0L else {WINDOW}L + aggregate(transform(places, (p, k) -> if(k = 0, 0, least({WINDOW}, p - places[greatest(k - 1, 0)]))), 0L, (a, x) -> a + x) end")
    return table.select(*counts[:5], covered.alias("n_repeat_words"), *counts[5:])


def votes() -> list[Column]:
    return [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").alias(name) for name, bad, good in RULES]


def _posteriors(share: list[float], chance: list[list[float]]) -> Column:
    """Array of class probabilities from the votes; chance[class][rule] is that of a vote against, where the rule votes."""
    logs = []
    for k, p in enumerate(share):
        terms = F.lit(math.log(p))
        for j, (name, _, _) in enumerate(RULES):
            x = chance[k][j]
            terms = terms + F.when(F.col(name) == -1, F.lit(math.log(x))).when(F.col(name) == 1, F.lit(math.log(1 - x))).otherwise(F.lit(0.0))
        logs.append(terms)
    return F.transform(F.array(*logs), F.exp)


def fit(voted: DataFrame) -> tuple[list[float], list[list[float]]]:
    """EM over the counts of vote patterns, which Spark counts over all documents.

    Class 0 is good, and each rule has a class of bad documents of its kind, since kinds of bad text
    exclude each other and one class for all would have to explain why most rules don't fire on it.
    A rule fires by mistake equally often in every class, good ones among them, and for cause only in
    classes of bad documents. So a rule that fires alone and is as frequent among documents that other
    rules find bad is noise; one that is rarer among them than alone marks a kind of its own.
    What is iterated over is the table of patterns, whose size does not depend on the documents'.
    """
    names = [r[0] for r in RULES]
    table = [(tuple(r[v] for v in names), r.n) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    table.sort()  # sums in one order, so that reruns agree
    return expectation_maximisation(np.array([v for v, _ in table], float).reshape(-1, len(names)), np.array([x for _, x in table], float))


def expectation_maximisation(votes_: np.ndarray, n: np.ndarray) -> tuple[list[float], list[list[float]]]:
    """(share of each class, chance of a vote against by class and rule) from patterns of votes and how often each occurs."""
    k = votes_.shape[1]
    against, cleared = (votes_ == -1).astype(float), (votes_ == 1).astype(float)
    rate = (n @ against + 1) / (n @ (against + cleared) + 2)
    mistake = START * rate
    own = np.r_[np.zeros((1, k)), np.eye(k)] == 1
    cause = np.where(own, 0.9, 0.05)
    cause[0] = 0
    share = np.minimum(np.r_[0, (1 - START) * rate], 0.5 / k)
    share[0] = 1 - share.sum()
    # Imagined votes, as many whatever the number of documents, keep estimates inside (0, 1) and say which class is which.
    fires, silent = np.where(own, PRIOR, 1), np.where(own, 1, SPARSE)
    for _ in range(ITERATIONS):
        chance = 1 - (1 - mistake) * (1 - cause)
        logs = np.log(share) + against @ np.log(chance).T + cleared @ np.log(1 - chance).T
        weight = np.exp(logs - logs.max(axis=1, keepdims=True))
        mass = weight / weight.sum(axis=1, keepdims=True) * n[:, None]
        bad, every = mass.T @ against, mass.T @ (against + cleared)
        old = np.r_[share, mistake]
        cause, mistake = (bad * cause / chance + fires) / (every + fires + silent), ((bad * mistake / chance).sum(axis=0) + 1) / (every.sum(axis=0) + 1 + PRIOR)
        cause[0] = 0
        share = (mass.sum(axis=0) + 1) / (n.sum() + len(share))
        if np.abs(np.r_[share, mistake] - old).max() < 1e-9:
            break
    return share.tolist(), (1 - (1 - mistake) * (1 - cause)).tolist()


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, votes, ``quality`` (posterior), ``base_failed`` and ``kept`` for each row of docs."""
    table = written(statistics(docs), "quality-statistics")
    voted = table.select("*", *votes())
    p = _posteriors(*fit(voted))
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return voted.withColumn("quality", F.get(p, F.lit(0)) / F.aggregate(p, F.lit(0.0), lambda a, x: a + x)).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
