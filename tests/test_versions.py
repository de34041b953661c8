"""Tables that change as a whole, maintenance on them, and results refreshed where documents change."""

import pytest
from pyspark.sql import functions as F

from citeforge.operators.maintenance import dedupe, maintain
from citeforge.sources.versions import Conflict, Versions
from citeforge.streaming.refresh import TABLE, follow, refresh

PAPERS = [
    (1, "10.1/A", "One title", 2001, "x"), (2, "10.1/a", "Other title", 2002, "x"), (3, None, "other TITLE ", 2002, "x"), (4, None, " ", 2000, "x"), (5, None, None, 2000, "x"),
    (6, None, "Curated work", 2010, "known_papers"), (7, "10.2/c", "Something else", 2011, "x"), (8, "10.3/z", "Third", None, "x"), (9, "", "third", None, "x"), (10, None, "Curated work two", 2010, "known_papers"),
]
SCHEMA = "id long, doi string, title string, year int, source string"


def log(spark, ids):
    return spark.createDataFrame([(i, p) for i, p in enumerate(ids)], "q long, paper_id long")


def curated(spark):
    return spark.createDataFrame([("Curated work", "https://doi.org/10.2/C"), ("Curated work two", "10.9/none")], "title string, doi string")


def test_dedupe_resolves_chains(spark):
    # 1 and 2 share a DOI and the log prefers 2; then 2 and 3 share title and year and the log prefers 3, so 1 ends at 3.
    papers, out, steps = dedupe(spark.createDataFrame(PAPERS, SCHEMA), log(spark, [1, 2, 2, 3, 3, 3, 3, 6, 9, 99, None]), curated(spark))
    assert {r.id for r in papers.collect()} == {3, 7, 9, 10} and papers.columns == ["id", "doi", "title", "year", "source"]
    assert sorted(r.paper_id or 0 for r in out.collect()) == sorted([3, 3, 3, 3, 3, 3, 3, 7, 9, 99, 0])
    assert {k: {r.id: r.survivor for r in v.collect()} for k, v in steps.items()} == {"empty_title": {4: None, 5: None}, "doi": {1: 2}, "title": {2: 3, 8: 9}, "known_papers": {6: 7}}


def test_readers_see_one_version(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "cat"))
    assert v.current() == 0 and v.tables() == {}
    v.commit({"papers": spark.createDataFrame(PAPERS, SCHEMA), "query_log": log(spark, [1, 2])})
    old = v.tables()
    assert maintain(v, curated(spark)) == {"empty_title": 2, "doi": 1, "title": 1, "known_papers": 1}
    # A reader that began before reads on what it began with.
    assert v.current() == 2 and old["papers"].count() == 10 and v.tables()["papers"].count() == 5 and v.tables(1)["query_log"].count() == 2
    # Maintenance again finds nothing to do.
    assert set(maintain(v, curated(spark)).values()) == {0}


def test_a_run_that_fails_changes_nothing(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "cat"))
    v.commit({"a": spark.range(3), "b": spark.range(4)})
    broken = spark.range(5).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        v.commit({"a": spark.range(9), "b": broken})
    assert v.current() == 1 and v.tables()["a"].count() == 3
    # Of two writers that began at one version the second loses.
    v.commit({"a": spark.range(5)}, after=1)
    with pytest.raises(Conflict):
        v.commit({"a": spark.range(7)}, after=1)
    assert {k: t.count() for k, t in v.tables().items()} == {"a": 5, "b": 4}


def test_only_changed_documents_are_touched(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "results"))
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    length = lambda d: d.select("doc_id", F.length("text").alias("n"))
    first = [(i, "x" * i) for i in range(10)] + [(11, None)]
    assert refresh(v, docs(first), length, 100, 50) == 11
    assert refresh(v, docs(first), length, 120, 50) == 0 and v.current() == 1
    changed = [*first[:8], (8, "new text"), (9, None), (12, "added"), (12, "added"), (11, None)]
    assert refresh(v, docs(changed), length, 130, 50) == 3
    kept = {r.doc_id: (r.n, r.made_at) for r in v.tables()[TABLE].collect()}
    assert kept[8] == (8, 130) and kept[9] == (None, 130) and kept[12] == (5, 130) and kept[3] == (3, 100) and len(kept) == 12
    # Results older than the limit are made again, changed or not.
    assert refresh(v, docs(changed), length, 151, 50) == 9


def test_results_follow_a_stream(spark, tmp_path):
    v, source = Versions(spark, str(tmp_path / "results")), tmp_path / "in"
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
    count = lambda d: d.select("doc_id", F.size(F.split("text", " ")).alias("n"))

    def run(now):
        stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
        q = follow(stream, v, count, lambda: now, 10, str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        q.stop()

    docs([(1, "a b"), (2, "c")])
    run(5)
    docs([(2, "c d e"), (3, "f"), (1, "a b")])
    run(6)
    assert {r.doc_id: (r.n, r.made_at) for r in v.tables()[TABLE].collect()} == {1: (2, 5), 2: (3, 6), 3: (1, 6)}
