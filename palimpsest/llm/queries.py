"""One query for each operator of this subpackage, over whole tables with the
production parameters, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokens
from .lm_score import lm_scores
from .mixing import mix
from .pii import personal_data
from .quality import quality
from .quotes import link_quotes
from .secret_scan import BASE_KINDS, KINDS, secret_spans, span_text
from .sharding import shard_documents
from .simhash import near_duplicates
from .vectors import near_vectors

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 3).alias("score"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(read(spark, sf_dir, "conversations"))


def chat_quotes_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8_chat_quotes`` without its bound: every earlier message of a passage has a vote."""
    return link_quotes(read(spark, sf_dir, "conversations"), common=None)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == BASE_KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(span_text(F.col("base"), KINDS), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_lm_scoring, op2_pii, op3_sharding, op4_quality_rules, op5_simhash,
        op6_embeddings, op7_mixing, op8_chat_quotes, op9_secrets, op10_bpe,
        chat_quotes_every,
    )
    return {f.__name__: f for f in found}


# The same n-grams, counts and backoff as relations of words.
OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS w FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents)),
g AS (SELECT doc_id, i, w AS w0,
    lag(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w1,
    lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM w),
c1 AS (SELECT w0, count(*) AS n FROM g GROUP BY ALL),
c2 AS (SELECT w1, w0, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT w2, w1, w0, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
d1 AS (SELECT doc_id, w0, count(*) AS n FROM g GROUP BY ALL),
d2 AS (SELECT doc_id, w1, w0, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
d3 AS (SELECT doc_id, w2, w1, w0, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS n FROM w GROUP BY ALL),
total AS (SELECT count(*) AS n FROM w),
o1 AS (SELECT doc_id, w0, c1.n - d1.n AS n FROM d1 JOIN c1 USING (w0)),
o2 AS (SELECT doc_id, w1, w0, c2.n - d2.n AS n FROM d2 JOIN c2 USING (w1, w0)),
o3 AS (SELECT doc_id, w2, w1, w0, c3.n - d3.n AS n FROM d3 JOIN c3 USING (w2, w1, w0)),
s AS (
  SELECT g.doc_id, CASE
    WHEN coalesce(t.n, 0) > 0 THEN ln(t.n / tc.n)
    WHEN coalesce(b.n, 0) > 0 THEN ln(b.n / bc.n) + CASE WHEN g.w2 IS NULL THEN 0 ELSE ln(0.4) END
    ELSE ln(greatest(u.n, 1) / greatest(total.n - len.n, 1))
       + CASE WHEN g.w1 IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN g.w2 IS NULL THEN 0 ELSE ln(0.4) END
    END AS s
  FROM g JOIN o1 u ON u.doc_id = g.doc_id AND u.w0 = g.w0
  LEFT JOIN o1 bc ON bc.doc_id = g.doc_id AND bc.w0 = g.w1
  LEFT JOIN o2 b ON b.doc_id = g.doc_id AND b.w1 = g.w1 AND b.w0 = g.w0
  LEFT JOIN o2 tc ON tc.doc_id = g.doc_id AND tc.w1 = g.w2 AND tc.w0 = g.w1
  LEFT JOIN o3 t ON t.doc_id = g.doc_id AND t.w2 = g.w2 AND t.w1 = g.w1 AND t.w0 = g.w0
  JOIN len ON len.doc_id = g.doc_id CROSS JOIN total)
SELECT d.doc_id, coalesce(len.n, 0)::BIGINT AS n_words, round(coalesce(x.s, 0), 3) AS score
FROM documents d LEFT JOIN len USING (doc_id) LEFT JOIN (SELECT doc_id, sum(s) AS s FROM s GROUP BY 1) x USING (doc_id)
"""

# Repeats of n words or more cover the same words as n-word windows found twice.
OP4_SQL = r"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
w AS (SELECT doc_id, len(a) AS n, generate_subscripts(a, 1) AS i, a FROM a),
win AS (
  SELECT doc_id, k, i, list_slice(a, i, i + k - 1) AS v FROM w, (VALUES (3), (8), (61)) AS sizes(k) WHERE i + k - 1 <= n),
twice AS (SELECT doc_id, k, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k, v) > 1),
inside AS (
  SELECT doc_id, k, count(DISTINCT j) AS n FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS j FROM twice) GROUP BY ALL),
line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM a) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (
  SELECT a.doc_id, len(a.a)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(a.a, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(a.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(line.n, 0)::BIGINT AS n_dup_lines,
    coalesce(r3.n, 0)::BIGINT AS n_repeat_words, coalesce(r8.n, 0)::BIGINT AS covered_words, r61.n IS NULL AS short
  FROM a LEFT JOIN line USING (doc_id)
  LEFT JOIN inside r3 ON r3.doc_id = a.doc_id AND r3.k = 3
  LEFT JOIN inside r8 ON r8.doc_id = a.doc_id AND r8.k = 8
  LEFT JOIN inside r61 ON r61.doc_id = a.doc_id AND r61.k = 61)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * covered_words <= 30 * n_words AND short AS kept
FROM f
"""

OP6_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
  FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.sound AND b.sound
    AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) n ON n.a = v.vec_id
JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = v.vec_id
"""

OP8_SQL = r"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
raw AS (SELECT rid, conv_id, turn, generate_subscripts(ls, 1) AS pos, unnest(ls) AS x FROM split),
marked AS (
  SELECT *, regexp_extract(x, '^((?: {0,3}>)+) ?(.*)$', 1) AS marks,
    CASE WHEN regexp_matches(x, '^((?: {0,3}>)+) ?(.*)$') THEN regexp_extract(x, '^((?: {0,3}>)+) ?(.*)$', 2) ELSE x END AS line FROM raw),
lines AS (
  SELECT *, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS passage FROM marked),
own AS (SELECT DISTINCT conv_id, passage, turn FROM lines WHERE level = 0 AND passage <> ''),
held AS (SELECT conv_id, passage, count(*) > 16 AS common, min(turn) AS earliest FROM own GROUP BY ALL),
hits AS (
  SELECT q.rid, q.pos, q.conv_id, q.turn, q.level, own.turn AS origin, held.common
  FROM lines q LEFT JOIN held ON held.conv_id = q.conv_id AND held.passage = q.passage
  LEFT JOIN own ON own.conv_id = q.conv_id AND own.passage = q.passage AND own.turn < q.turn AND (NOT held.common OR own.turn = held.earliest)
  WHERE q.level > 0 AND q.passage <> ''),
facts AS (
  SELECT conv_id, turn, count(DISTINCT (rid, pos)) AS n_quoted, max(level) AS max_level,
    count(DISTINCT (rid, pos)) FILTER (origin IS NOT NULL) AS n_linked FROM hits GROUP BY ALL),
best AS (
  SELECT conv_id, turn, origin AS reply_to FROM (
    SELECT conv_id, turn, origin, count(*) FILTER (NOT common) AS n, count(*) FILTER (common) AS m
    FROM hits WHERE origin IS NOT NULL AND level = 1 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, m DESC, origin DESC) = 1),
up(conv_id, turn, thread, depth) AS (
  SELECT conv_id, turn, reply_to, 1 FROM best
  UNION SELECT up.conv_id, up.turn, best.reply_to, up.depth + 1 FROM up JOIN best ON best.conv_id = up.conv_id AND best.turn = up.thread),
chain AS (SELECT conv_id, turn, max(depth) AS depth, min(thread) AS thread FROM up GROUP BY ALL),
kept AS (
  SELECT conv_id, turn, line, pos FROM (
    SELECT *, lead(level) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS after FROM lines)
  WHERE level = 0 AND NOT (coalesce(after, 0) > 0
    AND regexp_matches(line, '(?i)^.{0,200}(?:wrote|writes|schrieb|a écrit|escribió) ?:\s*$'))),
bodies AS (SELECT conv_id, turn, trim(string_agg(line, chr(10) ORDER BY pos), E'\n ') AS body FROM kept GROUP BY ALL)
SELECT c.conv_id, c.turn, c.role, coalesce(bodies.body, '') AS body, coalesce(n_quoted, 0)::BIGINT AS n_quoted,
  coalesce(max_level, 0)::INT AS max_level, coalesce(n_linked, 0)::BIGINT AS n_linked, reply_to,
  coalesce(chain.thread, c.turn) AS thread, coalesce(chain.depth, 0)::INT AS depth
FROM conversations c LEFT JOIN bodies USING (conv_id, turn) LEFT JOIN facts USING (conv_id, turn)
LEFT JOIN best USING (conv_id, turn) LEFT JOIN chain USING (conv_id, turn)
"""

# The same without the bound: no passage is common.
EVERY_SQL = OP8_SQL.replace("count(*) > 16 AS common", "false AS common")


def oracle_sql() -> dict[str, str]:
    return {
        "op1_lm_scoring": OP1_SQL, "op4_quality_rules": OP4_SQL, "op6_embeddings": OP6_SQL, "op8_chat_quotes": OP8_SQL,
        "chat_quotes_every": EVERY_SQL,
    }
