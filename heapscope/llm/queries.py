"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import attribution, bpe, brown, chat, embeddings, minhash, mixing, pii, syncmers, toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_syncmer_fingerprints": syncmers.op1_syncmer_fingerprints,
        "op2_chat_formatting": chat.op2_chat_formatting,
        "op3_token_attribution": attribution.op3_token_attribution,
        "op4_class_lm_scoring": brown.op4_class_lm_scoring,
        "op5_pii_pseudonyms": pii.op5_pii_pseudonyms,
        "op6_bpe_encoding": bpe.op6_bpe_encoding,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_embedding_near_dedup": embeddings.op8_embedding_near_dedup,
        "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
        "op10_mixing": mixing.op10_mixing,
        "pipeline": pipeline,
    }


#: Control strings do not overlap themselves, so each adds two characters for every occurrence; an escape character adds one.
CHAT_LENGTH = " + ".join(f"2*(length({{0}})-length(replace({{0}},'{c}','')))//{len(c)}" for c in chat.CONTROL) + f" + length({{0}})-length(replace({{0}},'{chat.ESCAPE}','')) + length({{0}})"

CHAT = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, {CHAT_LENGTH.format('role')} + {CHAT_LENGTH.format('text')} + length('[INST][/INST]</s>') AS width FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role='assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role='assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  (sum(width) + 3)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id"""

EMBEDDINGS = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS most FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / most) AS e FROM u WHERE most > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93
), r AS (SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT r.i, l.y FROM r JOIN l ON l.x = r.j)
SELECT i AS vec_id, (SELECT count(*) FROM l WHERE l.x = i) AS n_links, min(j) AS component_id, i = min(j) AS kept FROM r GROUP BY i"""

NEAR = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, l.y FROM r JOIN l ON l.x = r.j),
m AS (SELECT i, min(j) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON m.i = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others need a tokenizer, a trained model or hashed permutations, which SQL has not; tests hold them against brute force."""
    return {"op2_chat_formatting": CHAT, "op8_embedding_near_dedup": EMBEDDINGS, "op9_minhash_near_dedup": NEAR}
