"""The queries that apply the corpus operators to whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, mixing, prefix_trie, quality_classifier, quality_rules, resampling, sharding, simhash, substring_dedup, suffix_dedup, toxicity, vector_topk
from .common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality_rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each leak: doc_id, item_id and how well they meet."""
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_products(read(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_quality_rules, op3_mixing, op4_suffix_dedup, op5_decontamination, op6_substring_dedup, op7_simhash, op8_sharding, op9_quality_classifier, op10_line_dedup, op11_vector_topk, op12_resampling, op13_prefix_trie)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: crc: the checksum's byte table, made from its polynomial. Bytes are read off the hexadecimal form.
_CRC = """crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def _crc_sql(hexed: str) -> str:
    """The CRC-32 of what hexed is the upper-case hexadecimal form of; t is in scope."""
    digit = "(strpos('0123456789ABCDEF', substr({0}, {1}, 1)) - 1)"
    byte = f"16 * {digit.format(hexed, '2 * k + 1')} + {digit.format(hexed, '2 * k + 2')}"
    return f"xor(CAST(4294967295 AS BIGINT), list_reduce(range(length({hexed}) // 2), lambda c, k: xor(t[(xor(c, {byte}) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)))"


ORACLE_SQL: dict[str, str] = {
    "op3_mixing": f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS weight FROM s),
c AS (SELECT *, 2.0 * source_size AS cap, 2.0 * source_size / weight AS ratio FROM w),
l AS (
  SELECT *, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(CAST(cap AS DOUBLE)) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c),
t AS (
  SELECT source, source_size,
    round(CAST(coalesce(least(cap, max(CASE WHEN lev <= ratio THEN lev END) OVER () * weight), cap) AS DOUBLE), 6) AS target FROM l),
p AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
e AS (
  SELECT doc_id, size, t.source_size, target, start, CAST(floor(target) AS BIGINT) // greatest(t.source_size, 1) AS epochs,
    CAST(floor(target) AS BIGINT) - (CAST(floor(target) AS BIGINT) // greatest(t.source_size, 1)) * t.source_size AS rest
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, greatest(0, least(size, rest - start)) AS part FROM e)
SELECT doc_id, size, source_size, target, CAST(epochs * size + part AS BIGINT) AS taken,
  CAST(epochs + CASE WHEN part * 2 >= size AND part > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (
  SELECT doc_id, i, md5_number(array_slice(b, i, i + 49)) AS gram
  FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 48)) AS i FROM d WHERE octet_length(b) >= 50)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) < doc_id AS again FROM g),
e AS (SELECT doc_id, b, unnest(range(1, octet_length(b) + 1)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM f WHERE again)),
m AS (
  SELECT e.doc_id, e.i, array_slice(b, e.i, e.i) AS x, coalesce(max(CAST(again AS INT)) OVER (
    PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM e LEFT JOIN f ON e.doc_id = f.doc_id AND e.i = f.i),
s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS opens FROM m),
r AS (
  SELECT doc_id, sum(gone) AS n_removed, sum(CAST(opens AS INT)) AS n_spans,
    sha256(unhex(coalesce(string_agg(CASE WHEN gone = 0 THEN hex(x) END, '' ORDER BY i), ''))) AS kept_sha256 FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, coalesce(kept_sha256, sha256(b)) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id""",
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM d WHERE len(ws) >= 20),
h AS (SELECT doc_id, i, sha256(array_to_string(list_slice(ws, i, i + 19), ' ')) AS gram FROM g),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1 AS again FROM h),
m AS (
  SELECT w.doc_id, w.i, w.word, coalesce(max(CAST(again AS INT)) OVER (
    PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM w LEFT JOIN f ON w.doc_id = f.doc_id AND w.i = f.i),
r AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
    sha256(coalesce(string_agg(CASE WHEN gone = 0 THEN word END, ' ' ORDER BY i), '')) AS kept_sha256 FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id""",
    "op10_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, i, line, c.last IS NOT NULL AND c.last <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op11_vector_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_resampling": rf"""
WITH {_CRC},
a AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM a),
f AS (
  SELECT side, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS f FROM w),
c AS (SELECT side, id, f, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT f, h, t FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM c)), crc),
b AS (SELECT f, {_crc_sql("h")} % 10000 AS bucket FROM u),
g AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM c JOIN b ON c.f = b.f GROUP BY bucket),
z AS (SELECT CAST(sum(s) AS DOUBLE) AS ss, CAST(sum(t) AS DOUBLE) AS tt FROM g),
e AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * (ss + 10000)) / (CAST(s + 1 AS DOUBLE) * (tt + 10000)))) AS BIGINT) AS gain FROM g, z),
d AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM c JOIN b ON c.f = b.f JOIN e ON b.bucket = e.bucket WHERE side = 0 GROUP BY id),
k AS (SELECT id, len(ws) AS n_words, list_reduce(range(8), lambda v, i: 16 * v + strpos('0123456789abcdef', substr(sha256('42:' || CAST(id AS VARCHAR)), i + 1, 1)) - 1, CAST(0 AS BIGINT)) AS h FROM w WHERE side = 0),
o AS (
  SELECT k.id AS doc_id, n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM k LEFT JOIN d ON k.id = d.id),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM r""",
    "op13_prefix_trie": f"""
WITH {_CRC},
t AS (
  SELECT conv_id, sha256(coalesce(role, '') || chr(1) || coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) AS b,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c0 AS (SELECT conv_id, list(struct_pack(k := k, b := b) ORDER BY pos) AS own FROM t GROUP BY conv_id),
c1 AS (SELECT conv_id, own, {_crc_sql("h")} % 9 AS h FROM (SELECT conv_id, own, hex(encode(CAST(conv_id AS VARCHAR))) AS h FROM c0), crc),
c AS (
  SELECT x.conv_id, list_concat(coalesce(y.own[1:x.h], CAST([] AS STRUCT(k VARCHAR, b BIGINT)[])), x.own[x.h + 1:]) AS s
  FROM c1 x LEFT JOIN c1 y ON y.conv_id = x.conv_id - x.conv_id % 5),
r AS (
  SELECT conv_id, d, len(s) AS size, sha256('/' || array_to_string(list_transform(s[1:d], lambda x: x.k), ',')) AS node, sha256('/' || array_to_string(list_transform(s[1:d - 1], lambda x: x.k), ',')) AS parent,
    s[d].b AS b FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM c)),
n AS (
  SELECT d AS depth, node, CASE WHEN d > 0 THEN min(parent) END AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(min(b), 0) AS own,
    sha256(coalesce(string_agg(CASE WHEN size = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM r GROUP BY d, node),
k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.parent AND n.node IS NOT NULL),
u AS (SELECT DISTINCT a.node AS top, z.node AS low FROM r a JOIN r z ON a.conv_id = z.conv_id AND z.d >= a.d),
v AS (SELECT top, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM u JOIN m ON u.low = m.node GROUP BY top)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN v ON m.node = v.top LEFT JOIN m p ON m.parent = p.node""",
}
