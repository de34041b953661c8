"""TEI and JSON bibliographies, and several parsers' texts."""

from pyspark.sql import functions as F


def test_tei(spark, tmp_path):
    from citeforge.sources.structured import read_tei

    (tmp_path / "a.xml").write_text("""<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><back><listBibl>
        <biblStruct xml:id="b0"><analytic><title level="a">One study</title><author><persName><forename>John</forename><forename>K</forename><surname>Smith</surname></persName></author>
        <author><persName><surname>Lee</surname></persName></author><idno type="DOI">10.1/x</idno></analytic><monogr><title>Journal</title><imprint><date when="2001-05">2001</date></imprint></monogr><note type="raw_reference">Smith 2001</note></biblStruct>
        <biblStruct xml:id="b1"><monogr><title>A book</title><imprint><date>1999</date></imprint></monogr></biblStruct></listBibl></back></text></TEI>""")
    got = [tuple(r) for r in read_tei(spark, str(tmp_path / "a.xml")).orderBy("title", ascending=False).select("title", "authors", "venue", "year", "doi", "raw").collect()]
    assert got == [("One study", ["Smith, J. K.", "Lee"], "Journal", 2001, "10.1/x", "Smith 2001"), ("A book", None, None, 1999, None, None)]


def test_json_anthology(spark, tmp_path):
    from citeforge.sources.structured import read_json_anthology

    (tmp_path / "a.json").write_text('[{"title": "A", "authors": ["X"], "year": "2001", "venue": "V", "doi": null},\n {"title": " "}, {"title": "B", "year": "n.d."}]')
    assert [tuple(r) for r in read_json_anthology(spark, str(tmp_path)).orderBy("title").collect()] == [("A", ["X"], 2001, "V", None), ("B", [], None, None, None)]


def test_first_parsed(spark):
    from citeforge.sources.structured import first_parsed

    df = spark.createDataFrame([("", "b", "c"), (None, " ", "c"), ("a", None, None), (None, None, "")], "x string, y string, z string")
    assert [tuple(r.p) for r in df.select(first_parsed(*[F.col(c) for c in "xyz"]).alias("p")).collect()] == [(1, "b"), (2, "c"), (0, "a"), (None, None)]
