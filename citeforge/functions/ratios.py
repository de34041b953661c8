"""Similarity ratios of titles that Spark's functions lack, as one Arrow-batched function."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words, and the shared words with either side's own words after them."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    if shared and (x <= y or y <= x):
        return 1.0
    own = [" ".join(sorted(s)) for s in (x - y, y - x)]
    gap = 1 if shared else 0
    whole = [len(shared) + gap + len(s) for s in own]
    apart = len(own[0]) + len(own[1]) - 2 * common_length(*own)
    ratios = [1 - apart / sum(whole)]
    if shared:
        ratios += [1 - (gap + len(s)) / (len(shared) + w) for s, w in zip(own, whole)]
    return max(ratios)


def partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter text with any stretch of the longer one that is as long, or shorter at an end.

    A stretch is compared bit-parallel, and only if the characters it shares with the shorter text, counted as they come and go
    at the stretch's ends, allow more than the best ratio so far."""
    if not a or not b:
        return 0.0
    if len(a) == len(b):
        return max(_partial(a, b), _partial(b, a))
    return _partial(*sorted((a, b), key=len))


def _partial(short: str, long: str) -> float:
    m, n = len(short), len(long)
    need = Counter(short)
    held: Counter = Counter()
    best, common, lo = 0.0, 0, 0
    # The stretch ends before hi, and begins at 0 until it is as long as the shorter text; then it moves, and last it shrinks.
    for hi in range(1, n + m):
        if hi <= n:
            c = long[hi - 1]
            held[c] += 1
            common += held[c] <= need[c]
        if hi > m:
            c = long[lo]
            common -= held[c] <= need[c]
            held[c] -= 1
            lo += 1
        size = min(hi, n) - lo
        if 2 * common > best * (m + size):
            best = max(best, indel_ratio(short, long[lo : min(hi, n)]))
            if best == 1.0:
                break
    return best


#: What a method has to reach to count.
TOKEN_SET_LEAST, PARTIAL_LEAST, RATIO_LEAST = 0.85, 0.80, 0.85


def best_ratio(ratio: float, token_set: float, partial: float) -> tuple[str, float]:
    """The method of greatest score among those that reach their thresholds, the first of equal ones, and its score."""
    method, score = "", 0.0
    for name, x, least in (("token_set", token_set, TOKEN_SET_LEAST), ("partial", partial, PARTIAL_LEAST), ("levenshtein", ratio, RATIO_LEAST)):
        if x >= least and x > score:
            method, score = name, x
    return method, score


def normalize_title(x: Column) -> Column:
    """Lower case, punctuation to single spaces; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


@F.pandas_udf(StructType().add("ratio", DoubleType()).add("token_set", DoubleType()))
def _ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    pairs = list(zip(a, b))
    return pd.DataFrame({"ratio": [indel_ratio(x, y) if x and y else 0.0 for x, y in pairs], "token_set": [token_set_ratio(x, y) if x and y else 0.0 for x, y in pairs]})


def title_ratios(a: Column, b: Column) -> Column:
    """struct(ratio, token_set) of normalised titles in [0, 1]; a null or empty title gives 0."""
    return _ratios(normalize_title(a), normalize_title(b))


def ratio(a: Column, b: Column) -> Column:
    """The indel ratio of two texts as they are, in [0, 1]; a null or empty one gives 0."""
    return _ratios(a, b)["ratio"]


@F.pandas_udf(StructType().add("levenshtein", DoubleType()).add("token_set", DoubleType()).add("partial", DoubleType()).add("best_method", StringType()).add("best_score", DoubleType()))
def _scores(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(a, b):
        three = (indel_ratio(x, y), token_set_ratio(x, y), partial_ratio(x, y)) if x and y else (0.0, 0.0, 0.0)
        rows.append((*three, *best_ratio(*three)))
    return pd.DataFrame(rows, columns=["levenshtein", "token_set", "partial", "best_method", "best_score"])


def fuzzy_scores(a: Column, b: Column) -> Column:
    """struct(levenshtein, token_set, partial, best_method, best_score) of normalised titles; a null or empty one gives zeros and no method."""
    return _scores(normalize_title(a), normalize_title(b))
