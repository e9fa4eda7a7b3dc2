"""The numbered operators as queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import bpe, chat, class_lm, conversation_repair, decontaminate, html_text, mixing, quality
from winnow.llm import simhash, spelling, substring_dedup, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.deduplicate(docs).drop("text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``conversations`` is a message of its own, and conversation -1 speaks in control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    events = rows.unionByName(tricky).select(
        "conv_id",
        F.monotonically_increasing_id().alias("message_id"),
        F.col("turn").alias("seq"),
        F.lit("message").alias("event"),
        "role",
        "text",
    )
    return chat.digests(chat.read_back(chat.render(chat.fold(events))))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "weight", "epoch", "position")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.train(pages))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.digests(conversation_repair.repair(conversation_repair.damage(rows)), rows)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash": op2_simhash,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_exact_topk": op5_exact_topk,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_html_text": op10_html_text,
    "op11_bpe": op11_bpe,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS seq
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)
), repeats AS (
  SELECT doc_id, s FROM windows
  QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM repeats
), placed AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
  SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS text
  FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
         sum(24 + length(regexp_replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '<(!*)\|', '<!\1|', 'g'))
             + length(regexp_replace(text, '<(!*)\|', '<!\1|', 'g'))) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars
FROM joined
"""

OP5_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w, row_number() OVER () AS place
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.place, c.vec_id,
         list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

OP6_SQL = r"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens,
         md5(concat_ws(':', '0', doc_id::VARCHAR)) AS ord
  FROM documents
), sums AS (
  SELECT source, sum(n_tokens)::BIGINT AS tokens, count(*) AS docs FROM counted GROUP BY source HAVING sum(n_tokens) > 0
), shares AS (
  SELECT list(tokens::DOUBLE / (SELECT sum(tokens) FROM sums) ORDER BY source) AS p, sum(tokens)::DOUBLE AS total FROM sums
), target AS (
  SELECT p, total, -list_sum([x * ln(x) FOR x IN p]) * 0.5 + 0.5 * ln(len(p)) AS h FROM shares
), bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, p, h FROM target
  UNION ALL
  SELECT step + 1, CASE WHEN met THEN low ELSE mid END, CASE WHEN met THEN mid ELSE high END, p, h
  FROM (
    SELECT *, (low + high) / 2 AS mid,
           ln(list_sum([pow(x, (low + high) / 2) FOR x IN p]))
             - (low + high) / 2 * list_sum([pow(x, (low + high) / 2) * ln(x) FOR x IN p])
               / list_sum([pow(x, (low + high) / 2) FOR x IN p]) <= h
           AND pow(list_min(p), (low + high) / 2 - 1) / list_sum([pow(x, (low + high) / 2) FOR x IN p]) <= 4.0 AS met
    FROM bisect WHERE step < 50
  )
), chosen AS (
  SELECT round(high, 9) AS a, list_sum([pow(x, round(high, 9)) FOR x IN p]) AS norm FROM bisect WHERE step = 50
), parts AS (
  SELECT s.source, s.tokens, pow(s.tokens / total, a) / norm AS w,
         round(pow(s.tokens / total, a) / norm * total)::BIGINT AS quota, ceil(docs / 2048)::BIGINT AS blocks
  FROM sums s, chosen, target
), dealt AS (
  SELECT c.*, p.tokens, p.w, p.quota, ('0x' || substr(ord, 1, 8))::BIGINT % p.blocks AS block
  FROM counted c JOIN parts p ON c.source IS NOT DISTINCT FROM p.source WHERE p.quota > 0
), sizes AS (
  SELECT source, block, sum(n_tokens)::BIGINT AS size, any_value(tokens) AS tokens, any_value(quota) AS quota
  FROM dealt GROUP BY source, block
), passes AS (
  SELECT *, unnest(range(0, (quota - 1) // tokens + 1)) AS epoch FROM sizes
), starts AS (
  SELECT source, block, epoch,
         epoch * tokens + coalesce(sum(size) OVER (PARTITION BY source, epoch
           ORDER BY md5(concat_ws(':', '0', epoch::VARCHAR, source, block::VARCHAR)), block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM passes
), inside AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY ord, n_tokens
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM dealt
)
SELECT i.doc_id, i.source, i.n_tokens, round(i.w, 9) AS weight, s.epoch::BIGINT AS epoch,
       round((s.start + i.before)::DOUBLE / i.quota, 9) AS position
FROM inside i JOIN starts s ON i.source IS NOT DISTINCT FROM s.source AND i.block = s.block
WHERE s.start + i.before < i.quota
"""

STATEMENTS = {
    "op1_substring_dedup": OP1_SQL,
    "op4_chat_formatting": OP4_SQL,
    "op5_exact_topk": OP5_SQL,
    "op6_mixing": OP6_SQL,
}
