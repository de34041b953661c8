"""Fitted models against plain versions of their definitions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from .test_operators import fixture, words


@pytest.mark.parametrize("discount", [0.75, 4.0])
def test_kneser_ney_probabilities(spark, monkeypatch, discount):
    from citeforge.llm import toxicity as t

    assert t.DISCOUNT == 4.0
    monkeypatch.setattr(t, "DISCOUNT", discount)
    rows = [("you stupid fool", 1), ("stupid stupid fool you", 1), ("a stupid old fool", 1), ("you are kind", 0), ("a kind old man", 0), ("you and a man", 0), ("", 1), (None, 0)]
    every = [r[0] for r in rows] + ["never labelled words here", "you again"]
    counts = t.bigram_counts(spark.createDataFrame(rows, "text string, toxic int"))
    pair, word, context, unseen = t.probabilities(counts, t.word_counts(spark.createDataFrame([(x,) for x in every], "text string")))

    def hashed(text):
        for _, _, h, before, key in t._words(pa.array([text])):
            return h.view(np.int64).tolist(), before.view(np.int64).tolist(), key.view(np.int64).tolist()

    # The plain version.
    seen, shared = [set(), set()], Counter()
    for text, c in rows:
        w = (text or "").split()
        seen[c] |= set(zip(["", "", *w], ["", *w], w))
    n = [Counter((a, b) for _, a, b in x) for x in seen]
    for text in every:
        shared.update((text or "").split())
    total = sum(shared.values()) + len(shared) + 1
    q = {}
    for c in (0, 1):
        k = Counter(b for _, b in n[c])
        big = sum(k.values())
        back = sum(min(v, discount) for v in k.values()) / big
        p = {w: max(k[w] - discount, 0) / big + back * (shared[w] + 1) / total for w in shared}
        assert unseen[c] == pytest.approx(back / total)
        assert sum(p.values()) + unseen[c] == pytest.approx(1)
        for h in {a for x in n for a, _ in x}:
            mine = {b: v for (a, b), v in n[c].items() if a == h}
            size = sum(mine.values())
            lam = sum(min(v, discount) for v in mine.values()) / size if size else 1.0
            for w in shared:
                q[c, h, w] = (max(mine.get(w, 0) - discount, 0) / size if size else 0) + lam * p[w]
            assert sum(q[c, h, w] for w in shared) + lam * unseen[c] == pytest.approx(1)
    got = {r.key: (r.q1, r.q0) for r in pair.collect()}
    assert len(got) == len(n[0].keys() | n[1].keys())
    for h, w in n[0].keys() | n[1].keys():
        key = hashed(f"{h} {w}")[2][-1]
        assert got[key] == pytest.approx((q[1, h, w], q[0, h, w]))
    # Bigrams that no class has come to the context's weight and the word.
    model = t.Model(np.sort(np.array(list(got), np.int64).view(np.uint64)), np.zeros(len(got)), np.zeros(0, np.uint8), *t._sorted(word, "word", "p1", "p0"), *t._sorted(context, "before", "l1", "l0"), math.log(unseen[1] / unseen[0]))
    order = np.argsort(np.array(list(got), np.int64).view(np.uint64))
    model.pair_diff = np.array([math.log(a / b) for a, b in got.values()])[order]
    likely = np.zeros(1 << t.FILTER_BITS, bool)
    likely[model.pairs >> np.uint64(64 - t.FILTER_BITS)] = True
    model.likely = np.packbits(likely, bitorder="little")
    text = "you stupid man never kind fool"
    want = [math.log(q[1, a, b] / q[0, a, b]) if (0, a, b) in q else None for a, b in zip(["", *text.split()], text.split())]
    h, before, key = (np.array(x, np.int64).view(np.uint64) for x in hashed(text))
    d = model.differences(h, before, key)
    assert all(w is None or abs(x - w) < 1e-5 for x, w in zip(d, want)) and sum(w is not None for w in want) >= 4
    x = model.features(pa.array([text, "", None, "stupid"]), 4)
    d = np.clip(d, -t.MOST, t.MOST)
    assert x[0, 0] == pytest.approx(d.mean()) and x[0, 3] == pytest.approx(math.log(7)) and not x[1:3].any()
    assert x[0, 2] == pytest.approx(math.log1p(np.maximum(d - t.TELLING, 0).sum()))
    assert x[0, 1] == pytest.approx(max(d[i : i + t.PASSAGE].sum() for i in range(len(d))) / t.PASSAGE)


def test_toxic_expressions_of_ordinary_words(spark):
    """Two words that are ordinary by themselves are toxic together; a rare toxic word is smoothed, not lost."""
    from citeforge.llm import toxicity as t

    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["dirty", "dog"]
    docs, labels = [], []
    for i in range(1500):
        w = [rng.choice(vocab) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(50) : 0] = ["dirty", "dog"]
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = t.train(d, l, 1, 3)
    plain = lambda n: " ".join(rng.choice(vocab[:300]) for _ in range(n))
    probe = [(0, plain(60)), (1, f"{plain(30)} dirty dog {plain(30)}"), (2, f"{plain(20)} dog {plain(20)} dirty {plain(20)}"), (3, None), (4, "")]
    p = {r.doc_id: r.score for r in t.score(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()}
    assert p[1] > 0.7 and max(p[i] for i in (0, 2, 3, 4)) < 0.5
    assert t.train(d, l.where("toxic = 0"), 1, 3) is None and {r.score for r in t.score(d, None).collect()} == {0.0}


def test_language_counts_and_mixture():
    from citeforge.llm import langid

    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abc dé.ß"), 5000))
    whole, _ = langid._counts([text.lower()])
    old, langid.PIECE = langid.PIECE, 700
    try:
        got, letter = langid.gram_counts([text])
    finally:
        langid.PIECE = old
    assert (got == whole).all() and letter.all()
    # n-grams that begin and end with a letter, by plain loops.
    n = sum(text[i].isalpha() and text[i + k - 1].isalpha() for k in (1, 2, 3) for i in range(len(text) - k + 1))
    assert whole.sum() == n
    model = rng.random((3, langid.BUCKETS)) + 0.01
    model /= model.sum(1, keepdims=True)
    counts = rng.multinomial(400, 0.7 * model[1] + 0.3 * model[2], 2).astype(float)
    share, like = langid._em(counts, model, np.ones((2, 3)), langid.ROUNDS)
    for i in range(2):
        s = [1 / 3] * 3
        for _ in range(langid.ROUNDS):
            new = [0.0] * 3
            for g in np.flatnonzero(counts[i]):
                mix = sum(s[k] * model[k, g] for k in range(3))
                for k in range(3):
                    new[k] += counts[i, g] * s[k] * model[k, g] / mix
            s = [x / counts[i].sum() for x in new]
        assert share[i] == pytest.approx(s) and like[i] == pytest.approx(sum(counts[i, g] * math.log(sum(s[k] * model[k, g] for k in range(3))) for g in np.flatnonzero(counts[i])))
        # The set of best penalised likelihood among those nested by proportion.
        order = np.argsort(-np.array(s))
        worth = []
        for m in (1, 2, 3):
            allowed = np.zeros((1, 3))
            allowed[0, order[:m]] = 1
            _, x = langid._em(counts[i : i + 1], model, allowed, 0 if m == 1 else langid.ROUNDS)
            worth.append(x[0] - m * 0.5 * math.log(counts[i].sum()))
        best, size = langid.infer(counts[i : i + 1], model)
        stop = next((m for m in (1, 2) if worth[m] <= worth[m - 1]), 3)
        assert size[0] == stop and (best[0] > 0).sum() == stop


def test_quality_columns_and_votes(spark):
    from citeforge.llm.quality import RULES, statistics

    rows = [(i, t) for i, t in fixture()] + [(900, "A line of it!\nA line of it!\n\n \t\nother # $5 |x| <b>\nA line of it!"), (901, "x x x x x y. Y? " * 9), (902, "ÄÖ\x1c ß\u3000ß")]
    got = statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in got:
        ok = False
        for t in texts[r.doc_id]:
            w = words(t)
            lines = [x for x in t.split("\n") if words(x)]
            win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
            seen, cover = Counter(win), [0] * len(w)
            for i, x in enumerate(win):
                if seen[x] > 1:
                    cover[i : i + 8] = [1] * 8
            want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(cover), len(lines), sum("A" <= c <= "Z" for c in t), t.count("!"), t.count(".") + t.count("?"), sum(a == b for a, b in zip(w, w[1:])))
            ok |= want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines, r.n_upper, r.n_exclaim, r.n_stops, r.n_stutter)
        assert ok, r
    assert len({name for name, *_ in RULES}) == len(RULES)


def test_expectation_maximisation_by_loops(monkeypatch):
    from citeforge.llm import quality as q

    monkeypatch.setattr(q, "ITERATIONS", 40)
    votes = [(1, 1, 1), (-1, 1, 0), (1, -1, -1), (-1, -1, -1), (0, 1, 1), (1, 1, -1)]
    n = [900, 40, 30, 5, 60, 12]
    share, chance = q.expectation_maximisation(np.array(votes, float), np.array(n, float))
    k = 3
    rate = [(sum(c for v, c in zip(votes, n) if v[j] == -1) + 1) / (sum(c for v, c in zip(votes, n) if v[j]) + 2) for j in range(k)]
    mistake = [q.START * r for r in rate]
    cause = [[0.0] * k] + [[0.9 if i == j else 0.05 for j in range(k)] for i in range(k)]
    s = [0.0] + [min((1 - q.START) * r, 0.5 / k) for r in rate]
    s[0] = 1 - sum(s)
    for _ in range(40):
        fire = [[1 - (1 - mistake[j]) * (1 - cause[c][j]) for j in range(k)] for c in range(k + 1)]
        mass = []
        for v, count in zip(votes, n):
            w = [s[c] * math.prod(fire[c][j] if v[j] == -1 else 1 - fire[c][j] if v[j] == 1 else 1 for j in range(k)) for c in range(k + 1)]
            mass.append([x / sum(w) * count for x in w])
        bad = [[sum(m[c] for m, v in zip(mass, votes) if v[j] == -1) for j in range(k)] for c in range(k + 1)]
        every = [[sum(m[c] for m, v in zip(mass, votes) if v[j]) for j in range(k)] for c in range(k + 1)]
        new_cause = [[(bad[c][j] * cause[c][j] / fire[c][j] + (q.PRIOR if c == j + 1 else 1)) / (every[c][j] + (q.PRIOR + 1 if c == j + 1 else 1 + q.SPARSE)) if c else 0.0 for j in range(k)] for c in range(k + 1)]
        mistake = [(sum(bad[c][j] * mistake[j] / fire[c][j] for c in range(k + 1)) + 1) / (sum(every[c][j] for c in range(k + 1)) + 1 + q.PRIOR) for j in range(k)]
        cause = new_cause
        s = [(sum(m[c] for m in mass) + 1) / (sum(n) + k + 1) for c in range(k + 1)]
    assert share == pytest.approx(s) and np.array(chance) == pytest.approx(np.array([[1 - (1 - mistake[j]) * (1 - cause[c][j]) for j in range(k)] for c in range(k + 1)]))


def test_entropy_balancing(spark):
    """The dual's minimum, and targets by hand: weights 5, 2, 1 by code point with null last, capped at twice the size."""
    from citeforge.llm import mixing

    assert mixing.targets({"b": 100, "a": 100, None: 100, "c": 100}) == pytest.approx({"a": 200.0, "b": 400 / 3, "c": 200 / 3, None: 200.0})
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}
    rows = [(i, " ".join(["x"] * (i % 50)), "ab"[i % 2] if i % 7 else None) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    target = mixing.targets(dict(size))
    base = docs.select("doc_id", "source", F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long").alias("size"))
    many = Counter(s for _, _, s in rows)
    tilt = mixing._newton(base, dict(size), dict(many), target, 2.0)
    # The plain dual: its gradient vanishes, and rates of one source differ by size.
    for s in size:
        lam, scale = tilt[s]
        own = [len(t.split()) for _, t, x in rows if x == s]
        rates = [2.0 if lam >= mixing._FULL else min(2.0, math.exp(lam * n / scale)) for n in own]
        assert scale == size[s] / many[s] and abs(sum(r * n for r, n in zip(rates, own)) - target[s]) < 1e-9 * target[s]
        assert lam >= mixing._FULL or len({round(r, 9) for r in rates}) > 20
    got = mixing.mix(docs).collect()
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
        lam, scale = tilt[r.source]
        assert r.rate == pytest.approx(2.0 if lam >= mixing._FULL else min(2.0, math.exp(lam * r["size"] / scale)))
    assert all(abs(taken[s] - target[s]) <= 50 for s in size)
