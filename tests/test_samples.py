"""Sampling, LIKE search and the stratified split on small fixtures."""

import hashlib

from pyspark.sql import functions as F


def test_quality_sample(spark):
    from citeforge.operators.catalog import quality_sample

    good = "A fair title of some length"
    rows = [
        (1, "10.1/a", good, ["Smith, J."], 2001, "text"), (2, "10.1/b", good.upper() + ".", ["Smith, J."], 2001, None), (3, "10.1/c", "Short title", ["Smith"], 2001, "x"), (4, "10.1/d", "A title. With two sentences", ["Smith"], 2001, "x"),
        (5, None, "Another fair title of length", ["Smith"], 2001, "x"), (6, "10.1/f", "A comprehensive survey of all things", ["Smith"], 2001, "x"), (7, "10.1/g", "One more title of some length", ["Li"], 2001, "x"), (8, "10.1/h", "One more title of some size", ["Smith"], 1990, "x"),
        (9, "10.1/i", "A fair title without abstract", ["Smith"], 2010, " "), (10, "10.1/j", None, None, None, None), (11, "10.1/k", "No author is given for this", [], 2010, "x"),
    ]
    df = spark.createDataFrame(rows, "id long, doi string, title string, authors array<string>, year int, abstract string")
    assert [r.id for r in quality_sample(df, 1, 10).collect()] == [1, 9] == [r.id for r in quality_sample(df, 1, 10).collect()]
    assert {r.id for r in quality_sample(df, 1, 10, prefer_with_doi=False).collect()} == {1, 5, 9} and quality_sample(df, 1, 1).first().id == 1
    assert quality_sample(df.where("false"), 1, 3).count() == 0


def test_like_search(spark):
    from citeforge.operators.catalog import like_search

    p = spark.createDataFrame([(1, "Deep Learning for Text", ["Smith, J."], 2001), (2, "On deep learning", ["Doe"], 2002), (3, "Learning deep things", ["Doe"], 2001), (4, None, None, None)], "id long, title string, authors array<string>, year int")
    q = spark.createDataFrame([(0, "deep LEARNING", None, None), (1, "deep learning", "SMI", None), (2, "deep learning", "", 2002), (3, "", None, None), (4, None, "Doe", 2001), (5, "learning for", None, 2001)], "query_id long, title string, author string, year int")
    assert sorted(tuple(r) for r in like_search(p, q).collect()) == [(0, 1), (0, 2), (1, 1), (2, 2), (5, 1)]


def test_split_is_exact_in_every_stratum(spark):
    from citeforge.operators.evaluation import split_audit, stratified_split

    sizes = {"hot": 997, "b": 10, "one": 1, None: 7}
    rows = [(i, s, "own") for s, n in sizes.items() for i in range(n)]
    rows = [(k, s, x) for k, (_, s, x) in enumerate(rows)]
    got = stratified_split(spark.createDataFrame(rows, "id long, s string, _n string"), "id", "s").collect()
    for s, n in sizes.items():
        order = sorted((r.id for r in got if r.s == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        a, b = round(n * 0.70), round(n * 0.15)
        want = {i: "train" if k < a else "validation" if k < a + b else "test" for k, i in enumerate(order)}
        assert {r.id: r.split for r in got if r.s == s} == want and len(order) == n
    # A key that stands in two strata may fall in two splits, and the audit tells.
    two = spark.createDataFrame([(i, s) for i in range(200) for s in "ab"] + [(1000 + i, "c") for i in range(50)], "id long, s string")
    odd = stratified_split(two.where("s = 'a' or id % 2 = 0"), "id", "s").withColumn("split", F.when((F.col("id") == 7), "test").otherwise(F.col("split")))
    audit = {r.split: r for r in split_audit(odd, "id").collect()}
    assert sum(r.n for r in audit.values()) == odd.count() and sum(r.keys - r.shared for r in audit.values()) <= odd.select("id").distinct().count()
    assert all(r.shared == 0 for r in split_audit(spark.createDataFrame([(1, "train"), (2, "test")], "id long, split string"), "id").collect())
