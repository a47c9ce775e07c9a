"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat import chat_digests, event_log
from .common import table
from .hard_negatives import hard_negatives
from .line_dedup import drop_repeated_lines
from .near_dup import near_duplicates
from .packing import pack
from .pii import find_pii
from .quality_classifier import classify_quality
from .quality_rules import line_quality
from .sharding import shard
from .spelling import spelling_variants
from .token_count import count_tokens
from .unigram import encode_texts


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is told as events and folded back; conversation -1 says control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat_digests(event_log(rows.unionByName(extra)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False, special_tokens=True)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is wrong on purpose, so that some rows of other labels are near."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id % 100 = 0")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_token_counts": op7_token_counts,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_sharding": op11_sharding,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}

_OP1 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) AS n,
    length(role) + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')) AS header
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN n + 7 ELSE header + n + 17 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_OP8 = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.k, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS lost FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, source IS NULL AS no_host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w
), grams AS (
  SELECT doc_id, i, word, lead(word, 1) OVER v AS w2, lead(word, 2) OVER v AS w3 FROM word WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AS again FROM grams
), covered AS (
  SELECT doc_id, i, again OR coalesce(lag(again, 1) OVER v, false) OR coalesce(lag(again, 2) OVER v, false) AS c FROM twice WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), repeats AS (
  SELECT doc_id, count(*) FILTER (c) AS n FROM covered GROUP BY doc_id
), line AS (
  SELECT doc_id, host, no_host, unnest(string_split(text, chr(10))) AS line FROM w
), worded AS (
  SELECT *, regexp_replace(translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id
), common AS (
  SELECT host, no_host, norm, min(doc_id) AS first FROM worded GROUP BY ALL HAVING count(DISTINCT doc_id) > 20
), removed AS (
  SELECT x.doc_id, sum(x.n) AS n FROM worded x JOIN common c ON x.host = c.host AND x.no_host = c.no_host AND x.norm = c.norm AND x.doc_id <> c.first GROUP BY x.doc_id
), base AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
    CAST(coalesce(removed.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN repeats ON w.doc_id = repeats.doc_id LEFT JOIN dups ON w.doc_id = dups.doc_id LEFT JOIN removed ON w.doc_id = removed.doc_id
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 0.3 * n_words AS kept
FROM base
"""

_OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM w)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), way AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), walk(doc, reached) AS (
  SELECT a, a FROM way UNION SELECT doc, b FROM walk JOIN way ON reached = a
), component AS (SELECT doc, min(reached) AS c FROM walk GROUP BY doc)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN size ON size.doc_id = w.doc_id LEFT JOIN component ON doc = w.doc_id
"""

_OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), r AS MATERIALIZED (
  SELECT doc_id, strlen(text) + 8 AS size, CAST('0x' || left(md5(text), 15) AS BIGINT) AS key,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(text), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), crc
), whole AS (SELECT CAST(sum(size) AS BIGINT) AS total, CAST(sum(size) AS BIGINT) // 768 AS most_bytes, count(*) // 768 AS most_rows FROM r
), long AS MATERIALIZED (SELECT r.*, row_number() OVER (ORDER BY size DESC, key, doc_id NULLS FIRST) AS k FROM r, whole WHERE size > most_bytes
), deal AS (
  SELECT CAST(0 AS BIGINT) AS k, list_transform(range(24), lambda x: CAST(0 AS BIGINT)) AS loads, CAST(0 AS BIGINT) AS shard
  UNION ALL
  SELECT long.k, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + size ELSE x END), CAST(list_position(loads, list_min(loads)) - 1 AS BIGINT)
  FROM deal JOIN long ON long.k = deal.k + 1
), loaded AS (SELECT unnest(range(24)) AS shard, unnest(loads) AS load FROM (SELECT arg_max(loads, k) AS loads FROM deal)
), more AS (SELECT total - (SELECT sum(load) FROM loaded) AS bytes FROM whole
), level AS (
  SELECT min((bytes + below + k - 1) // k) AS l FROM (SELECT sum(load) OVER (ORDER BY load, shard) AS below, row_number() OVER (ORDER BY load, shard) AS k FROM loaded), more
), ends AS (SELECT shard, sum(greatest(0, l - load)) OVER (ORDER BY shard) AS e FROM loaded, level
), rest AS (
  SELECT r.*, sum(size) OVER g AS unit, count(*) OVER g AS copies, sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY key, doc_id NULLS FIRST) AS number
  FROM r, whole WHERE size <= most_bytes WINDOW g AS (PARTITION BY key)
), placed AS (
  SELECT doc_id, size, text_crc32, number, CASE WHEN unit > most_bytes OR copies > most_rows THEN 2 * upto - size ELSE 2 * min(upto - size) OVER (PARTITION BY key) + unit END AS middle FROM rest, whole
), short AS (SELECT p.*, (SELECT count(*) FROM ends WHERE shard < 23 AND 2 * e <= middle) AS shard FROM placed p
), dealt AS (
  SELECT doc_id, size, text_crc32, d.shard, 0 AS later, k AS number FROM long JOIN deal d USING (k)
  UNION ALL SELECT doc_id, size, text_crc32, shard, 1, number FROM short
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY later, number) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM dealt
"""

_OP12 = r"""
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, e.vec_id, e.label, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM e a JOIN e ON len(a.v) = len(e.v) AND (a.vec_id <> e.vec_id OR a.label <> e.label OR a.v <> e.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.own AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

_OP13 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS t
), run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), runs AS (SELECT id, run, count(*) AS n FROM run WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT *, list_transform(regexp_extract_all(hex(id || ':' || run), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM bytes, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), less AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pair AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, min_by(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM pair GROUP BY ALL
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word
), chain AS (
  SELECT word, form AS leads, 1 AS k FROM formed WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN formed f ON f.word = c.leads WHERE f.form IS NOT NULL
)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM formed f LEFT JOIN (SELECT word, max_by(leads, k) AS root FROM chain GROUP BY word) r ON r.word = f.word
"""

ORACLES: dict[str, str] = {
    "op1_chat_formatting": _OP1, "op8_line_dedup": _OP8, "op9_quality_rules": _OP9, "op10_minhash_near_dedup": _OP10,
    "op11_sharding": _OP11, "op12_hard_negatives": _OP12, "op13_spelling_variants": _OP13,
}
