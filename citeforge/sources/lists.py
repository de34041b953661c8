"""Reference lists without markers, made of each document's own words, in expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.characters import simple_upper
from .tables import table

SPARK_WORDS = "filter(split(text, '[ \\t\\n\\r]+'), w -> w <> '')"
DUCK_WORDS = r"list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')"


def _entry(k: int, word, upper) -> str:
    """The k-th entry of a list in one of four layouts: year in brackets, at the end, in one line with its neighbours, after the author."""
    w = [word(7 * k + i) for i in range(1, 8)]
    name = f"coalesce({upper(f'substr({w[0]}, 1, 1)')} || lower(substr({w[0]}, 2)), 'Anon') || ', A.'"
    head, tail = (f"concat_ws(' ', {', '.join(x)})" for x in (w[1:4], w[4:7]))
    year = f"CAST(1950 + (n_chars * {k + 2}) % 70 AS STRING)"
    return f"""CASE doc_id % 4 WHEN 0 THEN {name} || ' (' || {year} || '). ' || {head} || chr(10) || {tail} || '. Press.' WHEN 1 THEN {name} || ' ' || {head} || '.' || chr(10) || 'Journal of ' || {tail} || ', ' || {year} || '.'
        WHEN 2 THEN {name} || ' (' || {year} || '). ' || {head} || ' ' || {tail} || '. Press.' ELSE {name} || ' ' || {year} || '. ' || {head} || chr(10) || {tail} || '. Press.' END"""


def _parts(word, upper, many: int = 4) -> str:
    """Two to four entries; those of one line are parted by a blank."""
    gap = "CASE WHEN doc_id % 4 = 2 THEN ' ' ELSE chr(10) END"
    rest = [f"CASE WHEN doc_id % 3 + 2 > {k} THEN {gap} || {_entry(k, word, upper)} ELSE '' END" for k in range(1, many)]
    return " || ".join([_entry(0, word, upper), *rest])


def _marked(word, upper, many: int = 5) -> str:
    """Three to five entries with numbers, in brackets or with a full stop; every fifth list has its last ones out of order."""
    mark = lambda k: f"CASE WHEN doc_id % 2 = 0 THEN '[{k}] ' ELSE CAST({k} + CASE WHEN doc_id % 5 = 0 THEN {2 * k} ELSE 0 END AS STRING) || '. ' END"
    line = lambda k: f"{mark(k)} || coalesce({upper(f'substr({word(5 * k)}, 1, 1)')} || substr({word(5 * k)}, 2), 'X') || ', A. ' || concat_ws(' ', {word(5 * k + 1)}, {word(5 * k + 2)}) || ', ' || CAST(1950 + (n_chars * {k}) % 70 AS STRING)"
    return " || ".join(f"CASE WHEN doc_id % 3 + 3 >= {k} THEN chr(10) || {line(k)} ELSE '' END" for k in range(1, many + 1))


#: How each engine reaches a word and spells its first letter in upper case; they differ on ß.
_SPARK, _DUCK = (lambda i: f"try_element_at(words, {i})", simple_upper), (lambda i: f"words[{i}]", lambda x: f"upper({x})")
LISTS = f"lists AS (SELECT doc_id, {_parts(*_DUCK)} AS list, text || {_marked(*_DUCK)} || chr(10) || 'That is all.' AS body FROM (SELECT doc_id, n_chars, text, {DUCK_WORDS} AS words FROM documents))".replace(" AS STRING", " AS VARCHAR")


def lists(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, list, body): a list of references without markers, and the document's text with a numbered one behind it."""
    docs = table(spark, folder, "documents").selectExpr("doc_id", "n_chars", "text", f"{SPARK_WORDS} AS words")
    return docs.selectExpr("doc_id", f"{_parts(*_SPARK)} AS list", f"text || {_marked(*_SPARK)} || chr(10) || 'That is all.' AS body")
