"""Registered queries of the operators: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import (
    chat, hmm, minhash, packing, personal, quality_rules, repair, secrets, suffix_repeats, token_count, topk, trie_bpe, whitening,
)
from tapeloom.llm.tables import staged, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.NearDuplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80).classes()
    return found.withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(ws) - 2)), lambda i: array_to_string(ws[i:i + 3], ' '))) AS sh
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_n >= 80 * (na.n + nb.n - both_n)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(docs, secrets.train(docs))


def op4_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql("SELECT -7L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text UNION ALL "
                        "SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    nodes = staged(chat.turn_nodes(rows.unionByName(control)), "turns")
    return chat.digests(chat.format_paths(nodes, chat.best_paths(nodes)))


_ESCAPED = "replace({}, '%', '%25')"
for _c in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{chat.MASKED[_c[0]] + _c[1:]}')"

OP4_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
parts AS (
  SELECT *, length({_ESCAPED.format('text')}) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17
    ELSE 21 + length({_ESCAPED.format('role')}) END AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id"""


def op5_quality_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = staged(quality_rules.text_stats(docs).drop("text"), "stats")
    rules = quality_rules.learn(stats, table(spark, sf_dir, "labels"), lambda df: staged(df, "cells"))
    return quality_rules.judge(stats, rules)


def op6_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.digests(table(spark, sf_dir, "documents"), length=400)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), capacity=2048)


def op9_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op10_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


# Per conversation one row of costs, audits and repaired lines by place (nothing yet, after s, after u, after a): two steps of inserts
# and one row, in turn. A cell is cost (12 digits), audit, "|", lines; the least cell of a place is the cheapest, then ASCII-least.
_CELL = "lpad(CAST(CAST(left({0}, 12) AS BIGINT) + {1} AS VARCHAR), 12, '0') || substr({0}, 13, strpos({0}, '|') - 13) || '{2}' || substr({0}, strpos({0}, '|')){3}"


def _cell(place: str, cost: str, letter: str, line: str = "") -> str:
    return _CELL.format(place, cost, letter, f" || CASE WHEN strpos({place}, '|') = length({place}) THEN '' ELSE chr(10) END || {line}" if line else "")


_TO_USER = [_cell(p, "3", "I", "'user:'") for p in ("p0", "p1", "p3")]
_STEP = {p: f"CASE WHEN m.part < 2 THEN {ins} ELSE least({', '.join(row)}) END" for p, ins, row in [
    ("p0", "p0", [_cell("p0", "4", "D")]),
    ("p1", "p1", [_cell("p1", "4", "D"), f"CASE WHEN m.initial = 's' AND NOT m.gone THEN {_cell('p0', 'm.cut', 'K', 'm.line')} END"]),
    ("p2", f"least(p2, {', '.join(_TO_USER)})",
     [_cell("p2", "4", "D"), *(f"CASE WHEN m.initial = 'u' AND NOT m.gone THEN {_cell(p, 'm.cut', 'K', 'm.line')} END" for p in ("p0", "p1", "p3")),
      *(f"CASE WHEN NOT m.gone THEN {_cell(p, '3 + m.cut', 'R', chr(39) + 'user:' + chr(39) + ' || m.text')} END" for p in ("p0", "p1", "p3"))]),
    ("p3", f"least(p3, {_cell('p2', '3', 'I', chr(39) + 'assistant:' + chr(39))})",
     [_cell("p3", "4", "D"), f"CASE WHEN m.initial = 'a' AND NOT m.gone THEN {_cell('p2', 'm.cut', 'K', 'm.line')} END",
      f"CASE WHEN NOT m.gone THEN {_cell('p2', '3 + m.cut', 'R', chr(39) + 'assistant:' + chr(39) + ' || m.text')} END"])]}

OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), list_transform(range(8), lambda z: CAST(z AS BIGINT))),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS k
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM named, range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
  FROM damaged),
marked AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN shown = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, i > 1 AS follows
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (follows AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id),
m AS (
  SELECT conv_id, 3 * i - 2 + part AS step, part, initial, fault IN (1, 2) AS gone, CASE fault WHEN 3 THEN 3 ELSE 0 END AS cut, text, role || ':' || text AS line
  FROM marked, range(3) r(part)
  UNION ALL SELECT conv_id, 3 * n + 1 + part, part, NULL, NULL, NULL, NULL, NULL FROM counts, range(2) r(part)),
run AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS step, '000000000000|' AS p0, CAST(NULL AS VARCHAR) AS p1, CAST(NULL AS VARCHAR) AS p2, CAST(NULL AS VARCHAR) AS p3 FROM counts
  UNION ALL
  SELECT r.conv_id, m.step, {', '.join(_STEP.values())} FROM run r JOIN m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.step = r.step + 1),
ended AS (
  SELECT c.*, least(p0, p3) AS won FROM counts c JOIN run r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND r.step = 3 * c.n + 2)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(left(won, 12) AS BIGINT), 0) AS cost, coalesce(substr(won, 13, strpos(won, '|') - 13), '') AS audit,
  sha256(coalesce(substr(won, strpos(won, '|') + 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal.digests(docs, personal.train(docs))


QUERIES = [op1_token_counts, op2_minhash_near_dedup, op3_secret_scan, op4_reply_tree_chat, op5_quality_decision_list, op6_block_top_k,
           op7_suffix_array_dedup, op8_best_fit_packing, op9_hidden_markov_scores, op10_bpe_trie, op11_conversation_repair,
           op12_embedding_whitening, op13_personal_data]
SQL = {"op2_minhash_near_dedup": OP2_SQL, "op4_reply_tree_chat": OP4_SQL, "op6_block_top_k": OP6_SQL, "op11_conversation_repair": OP11_SQL}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository top; it imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def register(registry) -> None:
    for query in [*QUERIES, pipeline]:
        registry.add(query.__name__, query, SQL.get(query.__name__))
