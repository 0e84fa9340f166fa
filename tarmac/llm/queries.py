"""Registered queries of the training-text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm import conversation_trie, decontamination, line_dedup, packing, passage_dedup, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, url_rules, vector_codes, wavelet
from tarmac.llm.common import read_documents

#: The rules by which pages are judged.
PAGE_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack_documents(read_documents(spark, sf_dir)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.length_histogram(read_documents(spark, sf_dir)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score_documents(docs, model).select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_rules.rule_table(spark, PAGE_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.document_digests(wavelet.token_files(read_documents(spark, sf_dir)))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir)).select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(read_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(read_documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.lit(vector_codes.books_digest(books))
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passage_dedup.remove_passages(read_documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = conversation_trie.grafted_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_packing, op3_token_counts, op4_quality_classifier, op5_line_dedup, op6_url_rules, op7_wavelet, op8_simhash, op9_quality_rules, op10_suffix_dedup, op11_vector_codes, op12_passage_dedup, op13_conversation_trie, pipeline)
    return {f.__name__: f for f in own}


_SHINGLES = """
{name}_words AS (
  SELECT {key}, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\\[-`{{-~]', '', 'g'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM {table}),
{name} AS (
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM {name}_words)"""

_OP1 = (
    "WITH "
    + _SHINGLES.format(name="d", key="doc_id", table="documents")
    + ","
    + _SHINGLES.format(name="b", key="item_id", table="benchmark")
    + """,
sizes AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
met AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM met JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9"""
)

_OP5 = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.largest AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id"""

_OP6 = """
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(verdict, rule) AS (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')),
s AS (SELECT verdict, rule, string_split(rule, '/')[1] AS h, substr(rule, strpos(rule, '/')) AS q FROM r),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN s
  ON (p.host = s.h OR ends_with(p.host, '.' || s.h)) AND starts_with(p.path, s.q) GROUP BY page_id)
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)"""


_OP10 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, x.i AS i, x.s AS s FROM (SELECT doc_id, unnest(list_transform(range(0, greatest(length(h) // 2 - 49, 0)), lambda i: {'i': i, 's': substring(h, 2 * i + 1, 100)})) AS x FROM t)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
g AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS fresh FROM w JOIN f USING (s) WHERE first < doc_id),
r AS (SELECT doc_id, i, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
k AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM q JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
 sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE head || substring(h, 2 * last + 1) END)) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id"""


def _op11() -> str:
    """Six rounds, each from the last one's codebooks. Inner products of these integers are exact as doubles."""
    nearest = "arg_min(k, [list_inner_product(c, c) - 2 * list_inner_product(v, c), k])"
    steps = []
    for r in range(1, 8):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, any_value(v) AS v, {nearest} AS k FROM x JOIN b{r - 1} USING (p) GROUP BY vec_id, label, p)")
        if r < 7:
            steps.append(
                f"""s{r} AS MATERIALIZED (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c
  FROM (SELECT p, k, i, CAST(sum(CAST(u AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, k, unnest(v) AS u, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY p, k, i) GROUP BY p, k),
b{r} AS MATERIALIZED (SELECT p, k, coalesce(s{r}.c, b{r - 1}.c) AS c FROM b{r - 1} LEFT JOIN s{r} USING (p, k))"""
            )
    rounds = ",\n".join(steps)
    return f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS v FROM e, range(8) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v AS c FROM x QUALIFY k < 16),
{rounds},
f AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(k AS BIGINT)), '' ORDER BY p) AS code,
  CAST(sum(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)) AS BIGINT) AS error FROM a7 JOIN b6 USING (p, k) GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda z: CAST(CAST(z AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, h"""


_OP12 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM g JOIN f USING (s) WHERE first < doc_id),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL) AS kept, count(c.i) AS n_removed
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

# CRC-32 bit by bit. Prefixes are named by all digests of their turns, end to end.
_OP13 = """
WITH t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, length(coalesce(text, '')) AS points,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT crc.conv_id, 0 AS own, pos, turn, points FROM crc JOIN t ON t.conv_id = base WHERE pos <= h
  UNION ALL SELECT crc.conv_id, 1, pos, turn, points FROM crc JOIN t USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(turn, '') OVER w AS key, points FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM crc),
n AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(points) AS own FROM p GROUP BY key, depth),
c AS (SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (SELECT left(key, 32 * e) AS key, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved_tokens
  FROM (SELECT n.*, c.key IS NULL AS leaf, unnest(range(depth + 1)) AS e FROM n LEFT JOIN c USING (key)) GROUP BY 1),
l AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
z AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM p JOIN l USING (conv_id, depth) GROUP BY key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n up ON n.depth > 0 AND up.depth = n.depth - 1 AND up.key = left(n.key, 32 * (n.depth - 1)) LEFT JOIN c ON c.key = n.key JOIN u ON u.key = n.key LEFT JOIN z ON z.key = n.key"""


def oracle_sql() -> dict[str, str]:
    """No SQL for encoded texts, models and fingerprints: tests hold those against brute force."""
    return {"op1_decontamination": _OP1, "op5_line_dedup": _OP5, "op6_url_rules": _OP6, "op10_suffix_dedup": _OP10, "op11_vector_codes": _op11(), "op12_passage_dedup": _OP12, "op13_conversation_trie": _OP13}
