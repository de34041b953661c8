"""Texts with notes, and references that they name, made of each document's own words, in expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .cited import DUCK_NAMES, SPARK_NAMES
from .tables import table

NOTES, REFERENCES = 8, 3


def _name(word, i: int) -> str:
    return f"(upper(substr(coalesce({word(i)}, 'smith'), 1, 1)) || substr(coalesce({word(i)}, 'smith'), 2) || 'son')"


def _reference(word, r: int) -> list[str]:
    """Author, title and DOI of the r-th reference; the third one has the first one's author in every other document."""
    author = _name(word, 5 * r + 1) if r < 2 else f"CASE WHEN doc_id % 2 = 0 THEN {_name(word, 1)} ELSE {_name(word, 5 * r + 1)} END"
    title = f"concat_ws(' ', {', '.join(word(5 * r + i) for i in range(2, 6))})"
    return [f"{author} AS a{r}", f"{title} AS t{r}", f"CASE WHEN doc_id % 3 = {r} THEN '10.1000/' || lower({_name(word, 5 * r + 1)}) || CAST(doc_id AS STRING) END AS d{r}"]


def _note(k: int) -> str:
    """The k-th note: a full one, ibid., op. cit. with and without a word of the title, supra, a DOI, or nothing known."""
    r = f"CASE (doc_id + {k}) % 3 WHEN 0 THEN {{}}0 WHEN 1 THEN {{}}1 ELSE {{}}2 END"
    a, t, d = (r.format(x, x, x) for x in "atd")
    ways = [f"'Jane ' || {a} || ', ' || {t} || ' (Press, 1999), 12.'", "'Ibid., 14.'", f"{a} || ', op. cit., 25.'", f"{a} || ', ' || {t} || ', op. cit., 3.'", f"'See supra note ' || CAST({max(k - 2, 0)} + 1 AS STRING) || ', at 4.'", f"'At https://doi.org/' || coalesce({d}, 'none') || '.'", "'No work is named here.'"]
    return f"'{k + 1} ' || CASE (n_chars + {k} * (doc_id % 5 + 1)) % {len(ways)} " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(ways)) + " END"


_TEXT = "text || " + " || ".join(f"chr(10) || {_note(k)}" for k in range(NOTES))


def _parts(word) -> list[str]:
    return [x for r in range(REFERENCES) for x in _reference(word, r)]


#: noted has the notes n1, ... without their numbers, and references a0, t0, d0, ...
NOTED = f"noted AS (SELECT *, {', '.join(f'substr({_note(k)}, 3) AS n{k + 1}' for k in range(NOTES))} FROM (SELECT doc_id, n_chars, {', '.join(_parts(lambda i: f'words[{i}]'))} FROM (SELECT doc_id, n_chars, {DUCK_NAMES} AS words FROM documents)))".replace(" AS STRING", " AS VARCHAR")


def noted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(texts (doc_id, text), references (doc_id, reference_id, author, title, doi))."""
    d = table(spark, folder, "documents").selectExpr("doc_id", "n_chars", "coalesce(text, '') AS text", f"{SPARK_NAMES} AS words").selectExpr("doc_id", "n_chars", "text", *_parts(lambda i: f"try_element_at(words, {i})"))
    refs = d.selectExpr("doc_id", "inline(array(" + ", ".join(f"named_struct('reference_id', {r}L, 'author', a{r}, 'title', t{r}, 'doi', d{r})" for r in range(REFERENCES)) + "))")
    return d.selectExpr("doc_id", f"{_TEXT} AS text"), refs
