"""Texts that cite in twelve ways, by names made of their own words, in expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

MANY = 6
#: Names of different citations of a text begin with different letters.
FIRST = "BDFGKM"
#: One pass of one pattern over a text; words of other shapes are never made.
SPARK_NAMES = r"regexp_extract_all(text, '(?<![^ \\t\\n\\r])[a-z]{4,12}+(?![^ \\t\\n\\r])', 0)"
DUCK_NAMES = r"list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: regexp_matches(w, '^[a-z]{4,12}$'))"


def name(k: int, word, i: int) -> str:
    """The i-th name of the k-th citation, made of a word of the text."""
    return f"('{FIRST[k]}' || coalesce({word(3 * k + i)}, 'smith') || 'son')"


def year(k: int) -> str:
    return f"1900 + (n_chars * {k + 1}) % 120"


def _references(word) -> list[str]:
    """Author, year and DOI of the k-th reference: the fourth one's author is misspelt, the last one's year is off by two."""
    out = []
    for k in range(MANY):
        author = f"(substr({name(k, word, 1)}, 1, length({name(k, word, 1)}) - 1) || 'm')" if k == 3 else name(k, word, 1)
        out += [f"{author} AS a{k}", f"CAST({year(k)} + {2 if k == 5 else 0} AS STRING) AS y{k}", f"CASE WHEN (doc_id + {k}) % 12 = 9 THEN '10.1000/' || upper({name(k, word, 1)}) END AS d{k}"]
    return out


def _ways(k: int, word) -> list[tuple[str, str, str]]:
    """(what stands before, the citation, the pattern that should claim it) of the k-th citation, for each way."""
    n, m, y = name(k, word, 1), name(k, word, 2), f"CAST({year(k)} AS STRING)"
    says = "' so says '"
    return [
        (says, f"'(' || {n} || ', ' || {y} || ')'", "apa_intext_parenthetical"),
        (says, f"{n} || ' and ' || {m} || ' (' || {y} || ')'", "apa_intext_narrative"),
        (says, f"'[' || CAST({k} + 1 AS STRING) || ', ' || CAST(n_chars % 90 + 9 AS STRING) || ']'", "ieee_numeric"),
        (says, f"'[' || CAST(3000 + n_chars % 500 AS STRING) || ']'", "acm_numeric_range"),
        (says, f"'(' || {n} || ' ' || {y} || ': 25)'", "harvard_parenthetical"),
        (says, f"'(' || {n} || ' et al., ' || {y} || ': 25)'", "harvard_parenthetical_comma"),
        (f"{says} || {n}", "'^4,5'", "nature_superscript"),
        (says, f"'(' || {n} || ' and ' || {m} || ' 25-27)'", "mla_intext_parenthetical_page"),
        (says, f"{n} || ' (p. 25)'", "mla_intext_narrative"),
        (says, f"'10.1000/' || lower({n})", "doi"),
        (says, f"'https://' || lower({n}) || '.org/' || {y}", "url"),
        (says, f"'(' || CAST({k} + 1 AS STRING) || ', ' || CAST(n_chars % 90 + 9 AS STRING) || ')'", "numeric_parenthesized"),
    ]


def _columns(word) -> list[str]:
    out = []
    for k in range(MANY):
        ways = _ways(k, word)
        for column, at in (("l", 0), ("r", 1), ("p", 2)):
            out.append(f"CASE (doc_id + {k}) % 12 " + " ".join(f"WHEN {i} THEN {repr(w[at]) if column == 'p' else w[at]}" for i, w in enumerate(ways)) + f" END AS {column}{k}")
    return out


_TEXT = "text || " + " || ".join(f"l{k} || r{k} || ' here'" for k in range(MANY)) + " || ' (May 2012) and (Table 4).'"
#: cited has the i-th citation's lead, raw text and pattern as l{i}, r{i} and p{i}, and the i-th reference's author, year and DOI as a{i}, y{i} and d{i}.
CITED = f"cited AS (SELECT *, text AS body, {_TEXT} AS cited FROM (SELECT doc_id, text, {', '.join(_columns(lambda i: f'words[{i}]') + _references(lambda i: f'words[{i}]'))} FROM (SELECT doc_id, n_chars, coalesce(text, '') AS text, {DUCK_NAMES} AS words FROM documents)))".replace(" AS STRING", " AS VARCHAR")


def cited(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text): each document's text with six citations behind it."""
    docs = table(spark, folder, "documents").selectExpr("doc_id", "n_chars", "coalesce(text, '') AS text", f"{SPARK_NAMES} AS words")
    return docs.selectExpr("doc_id", "text", *_columns(lambda i: f"try_element_at(words, {i})")).selectExpr("doc_id", f"{_TEXT} AS text")


def references(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, reference_id, order_index, numeric_index, author, year, suffix, doi, title) of what the citations name."""
    docs = table(spark, folder, "documents").selectExpr("doc_id", "n_chars", f"{SPARK_NAMES} AS words").selectExpr("doc_id", *_references(lambda i: f"try_element_at(words, {i})"))
    rows = ", ".join(f"named_struct('reference_id', {k}L, 'order_index', {k}, 'numeric_index', {k + 1}, 'author', a{k}, 'year', y{k}, 'suffix', '', 'doi', d{k}, 'title', CAST(NULL AS STRING))" for k in range(MANY))
    return docs.selectExpr("doc_id", f"inline(array({rows}))")
