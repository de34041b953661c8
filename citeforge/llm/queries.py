"""The queries of this subpackage: name to (function of spark and folder, SQL or None)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, from the folder in TOKENIZERS_DIR or the installed package."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_chunk_reuse(spark, sf_dir):
    from .bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_ngram_jaccard_join(spark, sf_dir):
    from .jaccard import op_rows

    return op_rows(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark, sf_dir):
    from .substring import remove_repeats

    got = remove_repeats(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_token_binary(spark, sf_dir):
    from .tokenfile import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_url_bloom_cascade(spark, sf_dir):
    from .urlfilter import judge

    return judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_block_topk(spark, sf_dir):
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op1_mix_entropy(spark, sf_dir):
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_votes(spark, sf_dir):
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_language_mixture(spark, sf_dir):
    from .langid import held_out, identify, train

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out(2, 4))
    languages, model = train(docs.where(~F.coalesce("held_out", F.lit(False))))
    return identify(docs.select("doc_id", "text", "held_out"), languages, model).select("doc_id", "held_out", "lang_pred", "score", "languages")


def op8_toxicity_kneser_ney(spark, sf_dir):
    from .langid import held_out
    from .toxicity import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _table(spark, sf_dir, "labels"), 1, 3)
    return score(docs.withColumn("held_out", held_out(1, 3)), model).select("doc_id", "held_out", "score", "predicted")


def op11_merkle_manifest(spark, sf_dir):
    from .merkle import leaves, manifest

    return manifest(leaves(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op12_suffix_array_dedup(spark, sf_dir):
    from .suffix import remove_repeats

    got = remove_repeats(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_centroid_lloyd(spark, sf_dir):
    from .lloyd import cluster, with_inertia

    return with_inertia(*cluster(_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_suffix_array_dedup": op12_suffix_array_dedup,
    "op13_centroid_lloyd": op13_centroid_lloyd,
    "op5_language_mixture": op5_language_mixture,
    "op8_toxicity_kneser_ney": op8_toxicity_kneser_ney,
    "op1_mix_entropy": op1_mix_entropy,
    "op7_quality_votes": op7_quality_votes,
    "op3_url_bloom_cascade": op3_url_bloom_cascade,
    "op10_block_topk": op10_block_topk,
    "op2_bpe_chunk_reuse": op2_bpe_chunk_reuse,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op9_token_binary": op9_token_binary,
}

def _merkle_sql(levels: int = 8) -> str:
    """The tree level by level: as many levels as 16**levels rows of a source, or sources, need."""

    def climb(name: str, part: str) -> list[str]:
        """Tables name1, ...: the runs of the level before, as long as more than one node remains."""
        out = []
        for k in range(1, levels + 1):
            out.append(f"{name}{k} AS MATERIALIZED (SELECT {part}, i // 16 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d, string_agg(d, '' ORDER BY i) AS run, count(*) OVER (PARTITION BY {part}) AS n FROM {name}{k - 1} WHERE n > 1 GROUP BY {part}, i // 16)")
        return out

    def steps(name: str, part: str) -> list[str]:
        """Of a leaf at k, the siblings left and right of it, and the fold of a changed digest."""
        out = []
        for k in range(1, levels + 1):
            at = f"(i // CAST(16 ** {k - 1} AS BIGINT)) % 16"
            left, right = f"substr(r.run, 1, 64 * ({at}))", f"substr(r.run, 64 * ({at}) + 65)"
            # Beyond the level at which one node remains nothing changes.
            out.append(f"{name}f{k} AS (SELECT f.* EXCLUDE (proof, f), proof || CASE WHEN r.run IS NULL THEN '' ELSE {left} || {right} END AS proof, CASE WHEN r.run IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f FROM {name}f{k - 1} f LEFT JOIN {name}{k} r ON r.{part} = f.{part} AND r.i = f.i // CAST(16 ** {k} AS BIGINT))".replace("(i // CAST", "(f.i // CAST"))
        return out

    h = lambda text: "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH RECURSIVE table_(i, v) AS (SELECT CAST(range AS UBIGINT), CAST(range AS UBIGINT) FROM range(256)),
        crc(i, k, v) AS (SELECT i, 0, v FROM table_ UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM crc WHERE k < 8),
        words AS (SELECT list(v ORDER BY i) AS w FROM crc WHERE k = 8),
        crc_of AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(str_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda a, c: xor(a >> 8, w[CAST(xor(a, c) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS c FROM documents, words),
        leaf AS (SELECT d.doc_id, source, {h("text")} AS leaf, CASE WHEN c % 5 = 0 THEN {h(lower)} ELSE {h("text")} END AS altered FROM documents d JOIN crc_of USING (doc_id)),
        placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM leaf),
        a0 AS (SELECT s, i, leaf AS d, count(*) OVER (PARTITION BY s) AS n FROM placed),
        {", ".join(climb("a", "s"))},
        sub AS ({" UNION ALL ".join(f"SELECT s, d FROM a{k} WHERE n = 1" for k in range(levels + 1))}),
        b0 AS (SELECT 0 AS p, s AS i, d, count(*) OVER () AS n FROM sub),
        {", ".join(climb("b", "p"))},
        root AS ({" UNION ALL ".join(f"SELECT d FROM b{k} WHERE n = 1" for k in range(levels + 1))}),
        af0 AS (SELECT *, '' AS proof, altered AS f FROM placed),
        {", ".join(steps("a", "s"))},
        bf0 AS (SELECT * EXCLUDE (s, i), s AS i, s, 0 AS p FROM af{levels}),
        {", ".join(steps("b", "p"))}
        SELECT doc_id, leaf, sub.d AS subroot, (SELECT d FROM root) AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = (SELECT d FROM root) AS verified FROM bf{levels} JOIN sub USING (s)"""


def _lloyd_sql(rounds: int = 10, k: int = 8) -> str:
    square = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    out = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x FROM (SELECT x, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        out.append(f"n{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, arg_min(j, d) AS j, min(d) AS d FROM (SELECT vec_id, v.x, j, {square} AS d, d * {k} + j AS o FROM v, c{r} c) GROUP BY vec_id)".replace("arg_min(j, d)", "arg_min(j, o)"))
        if r < rounds:
            out.append(f"s{r} AS (SELECT j, i, CAST(sum(y) AS BIGINT) AS t, count(*) AS n FROM (SELECT j, unnest(x) AS y, unnest(range(64)) AS i FROM n{r}) GROUP BY j, i)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT j, list((t - ((t % n) + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY j) m ON m.j = c.j)")
    return f"""
        WITH {", ".join(out)}
        SELECT vec_id, CAST(n.j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM n{rounds} n JOIN c{rounds} c ON c.j = n.j"""


#: What DuckDB can run over whole tables; the other queries are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op13_centroid_lloyd": _lloyd_sql(),
    "op12_suffix_array_dedup": r"""
        WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        piece AS (SELECT doc_id, unnest(range(0, greatest(n - 99, 0), 400)) AS lo, h, n FROM h),
        part AS (SELECT doc_id, lo, substr(h, 2 * lo + 1, 2 * 499) AS part, least(400, n - 99 - lo) AS m FROM piece),
        gram AS (SELECT doc_id, lo + k AS i, substr(part, 2 * k + 1, 200) AS g FROM (SELECT doc_id, lo, part, unnest(range(m)) AS k FROM part)),
        late AS (SELECT doc_id, i FROM gram QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
        run AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS before FROM late)),
        span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM run GROUP BY doc_id, r),
        edge AS (SELECT doc_id, b, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 2000000000) AS next FROM span UNION ALL SELECT doc_id, 0, min(a) FROM span GROUP BY doc_id),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, 2 * (least(next, n) - b)), '' ORDER BY b) AS h FROM edge JOIN h USING (doc_id) WHERE least(next, n) > b GROUP BY doc_id),
        gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
        SELECT h.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(CASE WHEN n_removed IS NULL THEN h.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
        FROM h LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS either, count(*) AS both_ FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
        l AS (SELECT a, b FROM p WHERE 100 * both_ >= 80 * either UNION ALL SELECT b, a FROM p WHERE 100 * both_ >= 80 * either),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
        SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op6_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM p) QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, range(0, 20) t(k)),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op3_url_bloom_cascade": r"""
        WITH u AS (
            SELECT page_id,
                translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        hit AS (
            SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
            FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN hit USING (page_id)""",
    "op10_block_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
