"""What a citing sentence wants and whether the cited text bears it out, as column expressions over similarities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues of method, result, negation, strong claim, refutation and support.
METHOD = r"\b(?:used\s+by|we\s+use|implemented\s+in|built\s+on|based\s+on|adopted|employs|extractor|parser|library|framework|pipeline|module|architecture|algorithm|following\s+[a-z]|sử\s+dụng|áp\s+dụng|triển\s+khai|xây\s+dựng\s+trên)\b"
RESULT = r"\b(?:accuracy|precision|recall|f1|brier\s+score|calibration\s+error|ece|outperforms|compared\s+with|benchmark|evaluation|measured\s+by|agreement|kappa|alpha|achieved|9\d%|8\d%|0\.\d+|kết\s+quả|độ\s+chính\s+xác|so\s+sánh|thực\s+nghiệm)\b"
NEGATION = r"\b(?:not|never|no\s+longer|fails?\s+to|cannot|ineffective|insufficient|weak|worse\s+than|unreliable|impossible|evaded\s+by|lack\s+of|useless|incapable|contrary\s+to|disproves?|refutes?|invalidates?|không\s+thể|không\s+hiệu\s+quả|thất\s+bại|kém\s+hơn|vô\s+dụng|bác\s+bỏ|trái\s+ngược)\b"
CLAIM = r"\b(?:always\s+correct|completely\s+solves|100%\s+accurate|guarantees|perfectly|never\s+fails|eliminates\s+all|surprisingly\s+effective|highly\s+effective|superior\s+in\s+quality|significantly\s+outperforms|hoàn\s+toàn\s+chính\s+xác|luôn\s+đúng|rất\s+hiệu\s+quả|tối\s+ưu\s+tuyệt\s+đối)\b"
REFUTE = r"\b(?:completely\s+ineffective|fails?\s+to\s+\w+|useless|does\s+not\s+work|cannot\s+improve|worse\s+than\s+random|incapable\s+of|no\s+significant\s+effect|hoàn\s+toàn\s+thất\s+bại|không\s+có\s+tác\s+dụng|hoàn\s+toàn\s+vô\s+dụng|không\s+mang\s+lại\s+hiệu\s+quả)\b"
SUPPORT = r"\b(?:state-of-the-art|outperforms?|effective|improves?|achieves?|successfully|we\s+introduce|we\s+present|we\s+propose|we\s+demonstrate|we\s+show|superior|accurate|robust|significant\s+improvement)\b"


def _cue(x: Column, pattern: str) -> Column:
    return F.coalesce(x.rlike(f"(?iu){pattern}"), F.lit(False))


def intent(sentence: Column, method: Column, result: Column, background: Column) -> Column:
    """methodology, result_comparison or background: similarity to each kind's prototype, with cues; background for no sentence."""
    a = F.greatest(method, F.lit(0.0)) + F.when(_cue(sentence, METHOD), 0.22).otherwise(0.0)
    b = F.greatest(result, F.lit(0.0)) + F.when(_cue(sentence, RESULT), 0.24).otherwise(0.0)
    c = F.greatest(background, F.lit(0.0)) + 0.05
    return F.when(F.coalesce(sentence, F.lit("")) == "", "background").when((a >= b) & (a >= c), "methodology").when(b >= c, "result_comparison").otherwise("background")


def stance(sentence: Column, evidence: Column, similarity: Column, abstract: Column, other_language: Column) -> Column:
    """supported, partially_supported, neutral or contradiction_risk."""
    neg, ev_neg = _cue(sentence, NEGATION), _cue(evidence, NEGATION)
    against = (_cue(sentence, CLAIM) & ev_neg & ~neg) | (neg & _cue(evidence, CLAIM) & ~ev_neg) | (_cue(sentence, REFUTE) & (_cue(evidence, SUPPORT) | _cue(abstract, SUPPORT)) & ~ev_neg)
    has = F.coalesce(abstract, F.lit("")) != ""
    return (
        F.when(F.coalesce(sentence, F.lit("")) == "", "neutral")
        .when((F.coalesce(evidence, F.lit("")) != "") & (similarity >= 0.3) & against, "contradiction_risk")
        .when(similarity >= 0.5, "supported")
        .when(similarity >= 0.35, "partially_supported")
        .when(has & (similarity < 0.22) & ~other_language, "contradiction_risk")
        .otherwise("neutral")
    )


def alignment(title: Column, abstract: Column, sentence: Column, body: Column, share: float = 0.65) -> Column:
    """struct(score, level, aligned) from similarities; 0 stands for a part that is missing.

    The abstract counts by itself or with its best sentence, whichever is more; weights are 0.3, 0.5 and
    0.2 over the parts there are; strong evidence sets a floor."""
    whole = F.greatest(abstract, F.when(sentence > 0, share * sentence + (1 - share) * abstract).otherwise(abstract))
    parts = [(title, F.lit(0.3)), (whole, F.when(whole > 0, 0.5).otherwise(0.0)), (body, F.when(body > 0, 0.2).otherwise(0.0))]
    mean = reduce(lambda a, b: a + b, [s * w for s, w in parts]) / reduce(lambda a, b: a + b, [w for _, w in parts])
    best = F.when(sentence > 0, sentence).otherwise(F.greatest(title, abstract))
    score = F.when(whole >= 0.7, F.greatest(mean, 0.92 * whole, 0.9 * best)).when((best >= 0.65) & (whole > 0), F.greatest(mean, 0.88 * best)).otherwise(mean)
    level = F.when(score >= 0.7, "high").when(score >= 0.3, "medium").otherwise("low")
    return F.struct(score.alias("score"), level.alias("level"), (score >= 0.5).alias("aligned"))


def feature_vector(fuzzy: Column, semantic: Column, author: Column, years: Column, doi: Column, consensus: Column, venue: Column, content: Column, level: Column, aligned: Column) -> Column:
    """The 16 features of the calibrated model, rounded to six decimals."""
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    f, s, a, v, c = zero(fuzzy), zero(semantic), zero(author), zero(venue), zero(content)
    d = F.when(F.coalesce(doi, F.lit(False)), 1.0).otherwise(0.0)
    n = F.coalesce(consensus, F.lit(0))
    y = F.abs(F.coalesce(years, F.lit(999)))
    near = F.when(y >= 50, 0.0).otherwise(F.exp(-0.5 * F.least(y, F.lit(10))))
    t = F.greatest(f, s)
    yes = F.coalesce(aligned, F.lit(False))
    signal = F.when(yes & (c >= 0.45), c).when((level == "high") & ~yes & (c > 0) & (c < 0.25), -0.6).otherwise(0.0)
    any_ = F.when((n > 0) | (f > 0) | (s > 0) | (d > 0), 1.0).otherwise(0.0)
    high = lambda x: F.when(t >= 0.6, x).otherwise(0.0)
    border = F.when((t >= 0.4) & (t < 0.6) & (d == 0) & (any_ > 0), 1.0).otherwise(0.0)
    values = [f, s, t, a, near, d, F.least(F.greatest(n, F.lit(0)), F.lit(4)) / 4.0, v, signal, any_, t * a, t * near, high(t * (1 - a)), high(t * (1 - near)), d * (1 - t), border]
    return F.array(*[F.round(x, 6) for x in values])


def logits(features: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Class scores, in the order of the rows of weights.

    Products enter their sum unrounded, as by fused multiply-add, which DuckDB's SQL has: where scores all but tie, the last bit decides."""

    def split(x):
        return x * 134217729.0 - (x * 134217729.0 - x)

    def product(x: Column, w: Column) -> Column:
        h = split(x)
        rest = ((h * w["high"] - x * w["w"]) + h * w["low"] + (x - h) * w["high"]) + (x - h) * w["low"]
        return F.struct((x * w["w"]).alias("p"), rest.alias("e"))

    def plus(s: Column, x: Column) -> Column:
        p, t = x["p"], s + x["p"]
        return t + (((s - (t - (t - s))) + (p - (t - s))) + x["e"])

    def dot(w: list[float]) -> Column:
        parts = [(float(v), split(float(v))) for v in w]
        row = F.array(*[F.struct(F.lit(v).alias("w"), F.lit(h).alias("high"), F.lit(v - h).alias("low")) for v, h in parts])
        return F.aggregate(F.zip_with(features, row, product), F.lit(0.0), plus)

    return F.array(*[dot(w) + b for w, b in zip(weights, bias)])


def softmax(features: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Class probabilities, in the order of the rows of weights. Labels are better picked by :func:`logits`: scores that all but tie have equal probabilities."""
    z = logits(features, weights, bias)
    e = F.transform(z, lambda x: F.exp(F.greatest(x - F.array_max(z), F.lit(-60.0))))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(scores: Column, labels: list[str]) -> Column:
    """The label of the largest score or probability, the first of equal ones."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(scores, F.array_max(scores)).cast("int"))
