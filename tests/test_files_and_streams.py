"""Files in and out, and the log as a stream against the same log as a table."""

import datetime as dt

from pyspark.sql import functions as F

from citeforge.sources import files
from citeforge.streaming import log as stream


def test_bibtex_round_trip(spark, tmp_path):
    rows = [("1", "10.1/a", "on things", ["Ann Lee", "Bo"], 2001), ("2", None, "more {things}, and more", ["C"], 2002), ("3", "10.1/b", None, ["D"], None)]
    df = spark.createDataFrame(rows, "id string, doi string, title string, authors array<string>, year int")
    files.write_bibtex(df.coalesce(1), str(tmp_path / "bib"))
    got = {r.id: (r.doi, r.title, r.authors, r.year) for r in files.read_bibtex(spark, str(tmp_path / "bib")).collect()}
    assert got == {"paper1": ("10.1/a", "on things", ["Ann Lee", "Bo"], 2001), "paper2": (None, "more {things}, and more", ["C"], 2002)}


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "a", "title": "t", "year": 1999}\n{"id": "b", "title": " "}\nnot json\n')
    assert [(r.id, r.year, r.doi) for r in files.read_json_lines(spark, str(tmp_path / "p.jsonl")).collect()] == [("a", 1999, None)]
    (tmp_path / "p.xml").write_text("<c><paper><title>t</title><year>2000</year><author>A</author><author>B</author></paper><paper><title>u</title></paper></c>")
    got = {r.title: (r.year, r.authors) for r in files.read_xml(spark, str(tmp_path / "p.xml")).collect()}
    assert got["t"] == (2000, ["A", "B"]) and got["u"][0] is None


def test_csv_is_guarded(spark, tmp_path):
    files.write_csv(spark.createDataFrame([("=1+1", 3), ("plain", -4), (None, 5)], "a string, n int"), str(tmp_path / "c"))
    got = {r.n: r.a for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()}
    assert got == {"3": "'=1+1", "-4": "plain", "5": None}


def test_stream_equals_table(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i % 40, i % 2, "ab"[i % 2], start + dt.timedelta(minutes=7 * (i % 40))) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, found int, source string, queried_at timestamp")
    table.write.parquet(str(tmp_path / "in"))
    for name, make in (("windows", stream.windows), ("sessions", stream.sessions), ("once", stream.once)):
        source = stream.read_log(spark, str(tmp_path / "in"))
        mode = "append" if name == "once" else "complete"
        q = make(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        want = make(spark.read.parquet(str(tmp_path / "in")))
        order = [F.col(c).cast("string") for c in want.columns]
        assert spark.table(name).select(*order).orderBy(*order).collect() == want.select(*order).orderBy(*order).collect()
