"""Queries over whole texts and the references that they don't cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.context import ABBREVIATIONS, KEEP_HYPHEN
from ..functions.normalize import jaccard
from ..operators import discovery
from ..operators import lists as cut
from ..operators import notes
from ..operators.rules import RECORD_RULES, classify
from ..sources import lists
from ..sources import notes as noted
from ..sources.tables import table

#: Two references for each text: the first sentence of the next document, and the middle words of its own; authors are the first words of both.
_WORDS = "filter(split(text, '[ \\t\\n\\r]+'), w -> w <> '')"
_REFS = [
    "doc_id", "trim(regexp_extract(text, '^[^.!?\\n]*', 0)) AS head", f"{_WORDS} AS words",
]
#: Phrases of one of the data's languages and their equivalents.
CUES = {"und": "that thing", "der": "trash", "la": "with data", "que": "which"}


def implicit_references(spark, d):
    """(doc_id, ref, title, abstract, authors)."""
    docs = table(spark, d, "documents").selectExpr(*_REFS)
    own = docs.selectExpr("doc_id", "1L AS ref", "array_join(slice(words, cast(size(words) DIV 2 as int) + 1, 7), ' ') AS title", "array_join(slice(words, 1, 12), ' ') AS abstract", "array(coalesce(try_element_at(words, 1), ''), coalesce(try_element_at(words, -1), '')) AS authors")
    other = docs.selectExpr("doc_id - 1 AS doc_id", "2L AS ref", "head AS title", "CAST(NULL AS STRING) AS abstract", "array(coalesce(try_element_at(words, 2), '') || ', J.') AS authors")
    return own.unionByName(other)


def implicit_passages(spark, d):
    """The passage of each text that fits each of its references best."""
    got = discovery.discover(table(spark, d, "documents").select("doc_id", "text"), implicit_references(spark, d), CUES)
    return got.select("doc_id", "ref", "place", F.md5("passage").alias("passage"), F.round("hits", 6).alias("hits"), F.round("similarity", 6).alias("similarity"))


def unmarked_entries(spark, d):
    """The entries of lists without markers."""
    return cut.unmarked_entries(lists.lists(spark, d).select("doc_id", F.col("list").alias("text")))


def implicit_bibliographies(spark, d):
    """Where a list hides in each text, and how many entries and years it has."""
    return cut.implicit_lists(lists.lists(spark, d).select("doc_id", F.col("body").alias("text")))


def linked_notes(spark, d):
    """What each note of each text refers to, and how it says so."""
    texts, references = noted.noted(spark, d)
    return notes.link_notes(notes.note_lines(texts), references)


#: What a record found says of a citation: the document's own record, or one of the next two documents', by the text's length.
_OF = "doc_id + n_chars % 3"
_TITLE = "trim(regexp_extract(text, '^[^.!?\\n]*', 0))"
_FLAGS = [
    "length(title) % 2 = 0 AS registered", "length(title) % 3 = 0 AS local_only", "length(title) % 5 <> 0 AS live", "length(title) % 7 = 0 AS arxiv_alias", "doi IS NOT NULL AND other_doi IS NOT NULL AS both_dois",
    "coalesce(doi <> other_doi, false) AND length(title) % 7 <> 0 AS doi_conflict", "length(title) % 11 = 0 AS missing_reference", "CASE length(title) % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS matched",
    "length(title) % 6 <> 0 AS quality_candidate", "length(title) % 13 = 0 AS url_only", "length(title) % 9 < 4 AS known_author", "length(title) % 3 AS consensus", "(length(title) % 3) * 75 / 1e3 AS style_penalty", "(length(title) % 2) * 5 / 1e2 AS provenance_penalty",
]


def record_labels(spark, d):
    """What the rules on records found make of each document, with similarities of whole titles and whole texts."""
    word_set = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({discovery.WORD})"), F.lit(1)))
    docs = table(spark, d, "documents").selectExpr("doc_id", "n_chars", "text", "lang", "source", f"{_TITLE} AS title", "CASE WHEN n_chars % 2 = 0 THEN md5(text) END AS doi").withColumn("words", word_set(F.col("text"))).withColumn("topic", word_set(F.col("title"))).drop("text")
    other = docs.select(F.col("doc_id").alias("of"), *[F.col(c).alias(f"other_{c}") for c in ("lang", "source", "doi", "words", "topic", "n_chars")])
    pairs = docs.withColumn("of", F.expr(_OF)).join(other, "of")
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)
    f = pairs.select(
        "doc_id", jaccard(F.col("topic"), F.col("other_topic")).alias("title_fuzzy"), share(F.col("topic"), F.col("other_words")).alias("semantic"), share(F.col("words"), F.col("other_words")).alias("content_score"),
        (((F.col("lang") == F.col("other_lang")).cast("int") + (F.col("source") == F.col("other_source")).cast("int")) / 2.0).alias("author_sim"), F.abs(F.col("n_chars") % 24 - F.col("other_n_chars") % 24).alias("year_distance"), F.coalesce(F.col("doi") == F.col("other_doi"), F.lit(False)).alias("doi_exact_match"), *[F.expr(x) for x in _FLAGS],
    )
    f = f.withColumn("title_sim", F.greatest("title_fuzzy", "semantic")).withColumn("content_aligned", F.col("content_score") >= 0.5)
    got = classify(f, tuple(r[:4] for r in RECORD_RULES))
    return got.select("doc_id", "label", F.round("confidence", 6).alias("confidence"), "rule")


QUERIES = {f.__name__: f for f in (record_labels, implicit_passages, unmarked_entries, implicit_bibliographies, linked_notes)}

# RE2 knows the edges of ASCII words alone, so what stands before a word is part of the match.
_B = r"(^|[^\p{L}\p{N}_])"
_CLEAN = r"replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '­', '')"
_KEPT = rf"regexp_replace({_CLEAN}, '(?i){_B}({'|'.join(KEEP_HYPHEN)})-\s+(\p{{Ll}}{{2}})', '\1\2-\3', 'g')"
_WHOLE = rf"regexp_replace({_KEPT}, '(\p{{L}}{{2,}})-\s+(\p{{Ll}}{{2,}})', '\1\2', 'g')"
_P1 = rf"regexp_replace(regexp_replace(regexp_replace({_WHOLE}, '\.\.\.', '․․․', 'g'), '(?i){_B}(et al)\.', '\1\2․', 'g'), '(?i){_B}([ei])\.([ge])\.', '\1\2․\3․', 'g')"
_P2 = rf"regexp_replace({_P1}, '(?i){_B}({'|'.join(ABBREVIATIONS)})\.', '\1\2․', 'g')"
# RE2 can't look ahead: an initial before another one is matched twice, so that runs of initials are met.
_P3 = rf"regexp_replace(regexp_replace({_P2}, '{_B}(\p{{Lu}})\.(\s+\p{{Lu}})', '\1\2․\3', 'g'), '{_B}(\p{{Lu}})\.(\s+\p{{Lu}})', '\1\2․\3', 'g')"
_P4 = rf"regexp_replace(regexp_replace({_P3}, '(\d)\.(\d)', '\1․\2', 'g'), '(\d)\.(\d)', '\1․\2', 'g')"
_TOKENS = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '{discovery.WORD}'))"
_SPLIT = r"list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')"
_CUE = " + ".join(f"CASE WHEN contains(lower(passage), '{p}') AND ({' OR '.join(f'contains(source, {chr(39)}{e}{chr(39)})' for e in q.split() if len(e) >= 3)}) THEN 2.2 ELSE 0 END" for p, q in CUES.items())

_UPPER = r"\p{Lu}[\p{L}''’\-]+,\s+\p{Lu}"

ORACLE_SQL = {
    # Every way to cut a list.
    "unmarked_entries": rf"""WITH {lists.LISTS}, l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(list, '([.)\d/])\s+({_UPPER}\.)', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM lists),
        f AS (SELECT doc_id, len(lines) AS n, unnest(range(len(lines))) AS i, unnest(lines) AS line, unnest(list_transform(range(len(lines)), lambda i: coalesce(lines[i], ''))) AS before FROM l),
        g AS (SELECT doc_id, n, i, CASE WHEN regexp_matches(line, '{cut.GOES_ON}') THEN -4 WHEN regexp_matches(line, '^{_UPPER}') THEN 3 WHEN regexp_matches(line, '^[\p{{Lu}}"“]') THEN 1 ELSE -3 END AS s,
            least(len(regexp_extract_all(line, '{cut.PUBLISHED}')), 3) AS y, CASE WHEN regexp_matches(before, '{cut.CLOSED_END}') THEN 2 ELSE -2 END AS e FROM f),
        m AS (SELECT doc_id, n, unnest(range(CAST(2 ** (n - 1) AS BIGINT))) AS mask FROM (SELECT DISTINCT doc_id, n FROM f)),
        c AS (SELECT m.doc_id, m.mask, g.i, s, y, e, i = 0 OR (mask >> (m.n - 1 - i)) & 1 = 1 AS starts FROM m JOIN g ON g.doc_id = m.doc_id),
        k AS (SELECT *, count_if(starts) OVER (PARTITION BY doc_id, mask ORDER BY i) AS entry FROM c),
        p AS (SELECT doc_id, mask, entry, sum(CASE WHEN starts THEN s + CASE WHEN i > 0 THEN e ELSE 0 END ELSE 0 END) + CASE least(sum(y), 3) WHEN 0 THEN -3 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE -3 END AS score FROM k GROUP BY ALL),
        best AS (SELECT doc_id, mask FROM (SELECT doc_id, mask, sum(score) AS score, count(*) AS n FROM p GROUP BY doc_id, mask) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n, mask DESC) = 1),
        r AS (SELECT doc_id, entry, regexp_replace(regexp_replace(string_agg(line, ' ' ORDER BY i), '(\p{{L}})-\s+(\p{{Ll}})', '\1\2', 'g'), '(https?://\S+[/\-_?&=])\s+([a-z0-9])', '\1\2', 'g') AS raw FROM k JOIN best USING (doc_id, mask) JOIN f USING (doc_id, i) GROUP BY doc_id, entry)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY entry) - 1 AS INTEGER) AS entry, raw FROM r WHERE length(raw) > 20""",
    # Every run of lines.
    "implicit_bibliographies": rf"""WITH {lists.LISTS}, t AS (SELECT doc_id, string_split(body, chr(10)) AS lines FROM lists), h AS (SELECT doc_id, len(lines) // 2 AS lo, lines[len(lines) // 2 + 1:] AS lines FROM t),
        l AS (SELECT doc_id, lo, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM h),
        d AS (SELECT *, TRY_CAST(nullif(regexp_extract(line, '{cut.DOT_LINE}', 1), '') AS INTEGER) AS number FROM l),
        q AS (SELECT doc_id, number, lag(number) OVER w AS a, lead(number) OVER w AS b FROM d WHERE number IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        ok AS (SELECT DISTINCT doc_id, number FROM q WHERE a = number - 1 OR b = number + 1),
        w AS (SELECT d.*, regexp_matches(line, '{cut.BRACKET_LINE}') AS bracket, CASE WHEN regexp_matches(line, '{cut.BRACKET_LINE}') OR ok.number IS NOT NULL THEN 7 WHEN regexp_matches(line, '{cut.PROSE_LINE}') THEN -3 ELSE 0 END AS w FROM d LEFT JOIN ok ON ok.doc_id = d.doc_id AND ok.number = d.number),
        s AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS p, count_if(w = 7) OVER (PARTITION BY doc_id ORDER BY i) AS n, count_if(bracket) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w),
        r AS (SELECT b.doc_id, b.lo, a.i AS a, b.i AS b, b.n - a.n + CASE WHEN a.w = 7 THEN 1 ELSE 0 END AS entries, b.k - a.k + CASE WHEN a.bracket THEN 1 ELSE 0 END AS brackets FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.i <= b.i
            WHERE b.p - a.p + a.w > 0 QUALIFY row_number() OVER (PARTITION BY b.doc_id ORDER BY b.p - a.p + a.w DESC, b.i, a.i DESC) = 1),
        y AS (SELECT r.doc_id, sum(len(regexp_extract_all(line, '{cut.YEAR}'))) AS years FROM r JOIN l ON l.doc_id = r.doc_id AND l.i BETWEEN a AND b GROUP BY r.doc_id)
        SELECT doc_id, CAST(lo + a AS INTEGER) AS first, CAST(lo + b AS INTEGER) AS last, CAST(entries AS INTEGER) AS entries, CAST(years AS INTEGER) AS years FROM r JOIN y USING (doc_id) WHERE entries >= 3 AND (brackets >= 3 OR years >= 3)""",
    "record_labels": f"""WITH d AS (SELECT doc_id, n_chars, lang, source, {_TITLE} AS title, CASE WHEN n_chars % 2 = 0 THEN md5(text) END AS doi, {_TOKENS('text')} AS words, {_TOKENS(_TITLE)} AS topic FROM documents),
        j AS (SELECT a.*, b.lang AS l2, b.source AS s2, b.doi AS other_doi, b.words AS w2, b.topic AS t2, b.n_chars AS n2 FROM d a JOIN d b ON b.doc_id = a.doc_id + a.n_chars % 3),
        s AS (SELECT *, CASE WHEN len(list_distinct(list_concat(topic, t2))) > 0 THEN len(list_intersect(topic, t2)) / len(list_distinct(list_concat(topic, t2))) ELSE 0 END AS fuzzy, CASE WHEN len(topic) > 0 THEN len(list_intersect(topic, w2)) / len(topic) ELSE 0 END AS semantic,
            CASE WHEN len(words) > 0 THEN len(list_intersect(words, w2)) / len(words) ELSE 0 END AS content, (CAST(lang = l2 AS INTEGER) + CAST(source = s2 AS INTEGER)) / 2 AS who, abs(n_chars % 24 - n2 % 24) AS years, coalesce(doi = other_doi, false) AS same, length(title) AS n FROM j),
        f AS (SELECT *, greatest(fuzzy, semantic) AS best, n % 7 = 0 AS alias_, doi IS NOT NULL AND other_doi IS NOT NULL AS both_, coalesce(doi <> other_doi, false) AND n % 7 <> 0 AS clash, (n % 3) * 75 / 1e3 AS sp, (n % 2) * 5 / 1e2 AS pp FROM s),
        v AS (SELECT doc_id, CASE
            WHEN n % 2 = 0 AND same AND fuzzy >= 0.85 AND (years <= 1 OR years >= 900) THEN ['verified', CAST(greatest(0, 0.88 - sp - pp) AS VARCHAR), 'R-GLOBAL-DOI-RA-VERIFIED']
            WHEN n % 3 = 0 AND fuzzy >= 0.9 AND best >= 0.95 AND who >= 0.8 AND years <= 1 THEN ['verified', CAST(greatest(0, (CASE WHEN same THEN 0.9 ELSE 0.8 END) - sp) AS VARCHAR), 'R-LOCAL_DB_VERIFIED']
            WHEN n % 3 = 0 AND fuzzy >= 0.9 AND best >= 0.95 AND years <= 1 AND (who >= 0.5 OR who >= 0.35 AND (same OR alias_) OR who >= 0.35 AND fuzzy >= 0.98 AND (NOT both_ OR same OR alias_)) THEN ['verified', CAST(greatest(0, 0.75 - sp) AS VARCHAR), 'R-LOCAL_DB_GOOD_MATCH']
            WHEN content > 0 AND n % 11 <> 0 AND content >= 0.5 AND fuzzy >= 0.6 AND who >= 0.5 AND years <= 1 AND NOT clash AND (n % 3 = 2 OR n % 4 <> 1) THEN ['verified', CAST(greatest(0, 0.85 - sp) AS VARCHAR), 'R-CONTENT-ALIGNMENT']
            WHEN n % 11 <> 0 AND content >= 0.3 AND content < 0.5 AND fuzzy >= 0.75 AND who >= 0.5 THEN ['suspected_hallucination', CAST(greatest(0, 0.8 - sp) AS VARCHAR), 'R-CONTENT-MISMATCH']
            WHEN n % 11 <> 0 AND content >= 0.2 AND content < 0.5 AND who >= 0.3 AND years <= 1 AND n % 13 <> 0 THEN ['unresolved', CAST(greatest(0, content - sp) AS VARCHAR), 'R-CONTENT-ALIGNMENT']
            WHEN n % 3 >= 1 AND n % 5 <> 0 AND NOT clash AND (who > 0 OR same OR n % 3 = 2 AND best >= 0.9 AND years <= 1) AND (best >= 0.9 AND (who < 0.5 OR years > 1) OR best >= 0.6 AND best < 0.9 AND (who >= 0.3 OR years <= 2)) THEN ['metadata_error', CAST(greatest(0, 0.68 - sp) AS VARCHAR), 'R-SINGLE-SOURCE-PARTIAL']
            WHEN n % 3 = 0 AND (fuzzy >= 0.9 AND (same OR who >= 0.35 OR years <= 1) OR same AND fuzzy >= 0.35 OR who >= 0.8 AND years <= 1 AND fuzzy >= 0.55 AND fuzzy < 0.9) AND (fuzzy < 0.9 OR who < 0.5 OR years > 1 AND years < 900 OR both_ AND NOT same) THEN ['metadata_error', CAST(greatest(0, 0.78 - sp) AS VARCHAR), 'R-LOCAL_DB_METADATA_ERROR']
            WHEN n % 9 < 4 AND n % 6 <> 0 AND who >= 0.5 AND best >= 0.3 AND best < 0.9 THEN ['metadata_error', '0.65', 'R-KNOWN-AUTHOR-TITLE-MISMATCH']
            ELSE ['unresolved', '0.4', 'R-WEAK-EVIDENCE'] END AS v FROM f)
        SELECT doc_id, v[1] AS label, round(CAST(v[2] AS DOUBLE), 6) AS confidence, v[3] AS rule FROM v""",
    "linked_notes": rf"""WITH {noted.NOTED}, n AS ({' UNION ALL '.join(f"SELECT doc_id, {k + 1} AS note, n{k + 1} AS text FROM noted" for k in range(noted.NOTES))}
            UNION ALL SELECT doc_id, CAST(regexp_extract(x, '{notes.NOTE_LINE}', 1) AS INTEGER), trim(regexp_extract(x, '{notes.NOTE_LINE}', 2)) FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE regexp_matches(x, '{notes.NOTE_LINE}')),
        p AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS plain, regexp_matches(text, '{notes.IBID}') AS ibid, regexp_matches(text, '{notes.OP_CIT}') AS op, regexp_matches(text, '{notes.SUPRA}') AS supra, rtrim(lower(regexp_extract(text, '{notes.DOI}', 1)), '.') AS doi FROM n),
        r AS ({' UNION ALL '.join(f"SELECT doc_id, {i} AS reference_id, trim(lower(a{i})) AS author, trim(regexp_replace(lower(t{i}), '[^a-z0-9]+', ' ', 'g')) AS title, lower(d{i}) AS doi FROM noted" for i in range(noted.REFERENCES))}),
        w AS (SELECT *, list_filter(list_distinct(string_split(title, ' ')), lambda x: length(x) >= 4) AS words, count(*) OVER (PARTITION BY doc_id, author) = 1 AS alone FROM r),
        f AS (SELECT p.doc_id, note, reference_id, author, words FROM p JOIN w ON p.doc_id = w.doc_id WHERE NOT ibid AND NOT op AND NOT supra AND (p.doi = w.doi
            OR (contains(' ' || plain || ' ', ' ' || author || ' ') AND length(author) >= 3 AND (alone AND length(author) >= 4 OR len(list_intersect(words, string_split(plain, ' '))) > 0))
            OR (length(title) >= 12 AND (contains(plain, trim(substr(title, 1, 38))) AND length(trim(substr(title, 1, 38))) >= 12 OR len(words) >= 3 AND len(list_intersect(words, string_split(plain, ' '))) >= 3)))),
        o AS (SELECT a.doc_id, a.note, f.reference_id, 'op_cit' AS how FROM p a, LATERAL (SELECT reference_id FROM f WHERE f.doc_id = a.doc_id AND f.note < a.note AND contains(' ' || a.plain || ' ', ' ' || f.author || ' ')
            ORDER BY len(list_intersect(words, string_split(a.plain, ' '))) > 0 DESC, f.note DESC, reference_id DESC LIMIT 1) f WHERE op),
        d AS (SELECT doc_id, note, reference_id, 'full' AS how FROM f UNION ALL SELECT * FROM o),
        l AS (SELECT * FROM d UNION ALL SELECT a.doc_id, a.note, min(reference_id), 'supra' FROM p a JOIN d ON d.doc_id = a.doc_id AND d.note = CAST(nullif(regexp_extract(a.text, '{notes.SUPRA}', 1), '') AS INTEGER) AND d.note < a.note WHERE supra GROUP BY a.doc_id, a.note)
        SELECT * FROM l UNION ALL SELECT a.doc_id, a.note, b.reference_id, 'ibid' FROM p a, LATERAL (SELECT reference_id FROM l WHERE l.doc_id = a.doc_id AND l.note < a.note ORDER BY l.note DESC, reference_id LIMIT 1) b WHERE ibid""",
    # Every window of a text against every reference of it.
    "implicit_passages": rf"""WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex({_P4}, '[.!?]+(?:\s+|$)|\n+'), lambda p: trim(replace(p, '․', '.'))), lambda p: length(p) >= 25) AS s FROM documents
            WHERE length(trim(text)) >= 60 AND NOT contains(text, '......') AND NOT contains(upper(text), 'TABLE OF CONTENTS')),
        w AS (SELECT doc_id, unnest(range(len(s))) AS place, trim(unnest(list_transform(range(len(s)), lambda i: array_to_string(s[i + 1:i + 2], ' ')))) AS passage FROM s),
        k AS (SELECT *, {_TOKENS('passage')} AS words FROM w WHERE length(passage) >= 45 AND NOT regexp_matches(passage, '{discovery.ENTRY.replace(chr(92) + 'b[', _B + '[', 1)}') AND NOT regexp_matches(lower(passage), 'in proceedings of|https://doi\.org/|arxiv preprint')),
        d AS (SELECT doc_id, trim(regexp_extract(text, '^[^.!?\n]*')) AS head, {_SPLIT} AS words FROM documents),
        r AS (SELECT doc_id, 1 AS ref, array_to_string(words[len(words) // 2 + 1:len(words) // 2 + 7], ' ') AS title, array_to_string(words[1:12], ' ') AS abstract, [coalesce(words[1], ''), coalesce(words[-1], '')] AS authors FROM d UNION ALL
            SELECT doc_id - 1, 2, head, NULL, [coalesce(words[2], '') || ', J.'] FROM d),
        a AS (SELECT *, list_filter({_TOKENS('title')}, lambda x: x NOT IN {discovery.COMMON}) AS topic, lower(title || ' ' || coalesce(abstract, '')) AS source, {_TOKENS("title || '. ' || coalesce(substr(abstract, 1, 320), '')")} AS asked,
            substr(regexp_replace(trim(lower(title)), '\s+', ' ', 'g'), 1, 35) AS start,
            list_filter(list_distinct(list_transform(list_filter(authors, lambda x: length(trim(x)) >= 3), lambda x: regexp_replace(lower(string_split_regex(trim(string_split(x, ',')[1]), '\s+')[1]), '[^a-zA-ZÀ-ỹ]', '', 'g'))), lambda x: x <> '') AS names FROM r WHERE trim(title) <> ''),
        h AS (SELECT a.doc_id, ref, place, passage, asked, words, len(list_intersect(topic, words)) * 2.0 + len(list_intersect(names, words)) * 3.0 + {_CUE} AS hit FROM a JOIN k USING (doc_id)
            WHERE NOT (length(start) >= 12 AND contains(lower(passage), start) AND (length(start) >= 24 OR regexp_matches(lower(passage), '\b(?:19|20)\d{{2}}\b')))),
        b AS (SELECT *, round(hit + least(length(passage), 260) / 300.0, 9) AS hits FROM h WHERE hit > 0),
        e AS (SELECT *, CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, words)) / len(asked) ELSE 0 END AS share FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, ref ORDER BY hits DESC, place) <= 8)
        SELECT doc_id, ref, CAST(place AS INTEGER) AS place, md5(passage) AS passage, CAST(round(hits, 6) AS DOUBLE) AS hits, round(share, 6) AS similarity FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, ref ORDER BY share DESC, hits DESC, place) = 1""",
}
