"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from joulegrid.llm.common import read_table


def op1_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.dual_tree import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), 5, 50)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.langid import identify

    return identify(read_table(spark, sf_dir, "documents"), 5, 0)


def op4_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.lexicon_bpe import round_trip_digests

    return round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 32_768)


def op5_gray_order_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), 2, 3)


def op6_weakly_supervised_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.privacy import find_personal_data

    return find_personal_data(read_table(spark, sf_dir, "documents"))


def op7_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.toxicity import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), 0.3, 4, 2)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.seekable import token_files

    return token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op9_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.quality import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), 0.5, 3, 1)


def op10_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.pruned_graph import graph_search

    return graph_search(read_table(spark, sf_dir, "embeddings"), 20, 20)


def op11_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fractions import Fraction

    from joulegrid.llm.token_groups import jaccard_join

    return jaccard_join(read_table(spark, sf_dir, "documents"), Fraction(9, 10), 3)


def op12_cholesky_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"), 4, 256.0)


def op13_splitter_skeleton_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from joulegrid.llm.prefix_trie import trie

    return trie(read_table(spark, sf_dir, "conversations"), 6, 100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dual_tree_top_k": op1_dual_tree_top_k,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_lexicon_bpe": op4_lexicon_bpe,
    "op5_gray_order_simhash": op5_gray_order_simhash,
    "op6_weakly_supervised_privacy": op6_weakly_supervised_privacy,
    "op7_boosted_toxicity": op7_boosted_toxicity,
    "op8_token_files": op8_token_files,
    "op9_attention_quality": op9_attention_quality,
    "op10_robust_pruned_graph": op10_robust_pruned_graph,
    "op11_token_group_join": op11_token_group_join,
    "op12_cholesky_jacobi_whitening": op12_cholesky_jacobi_whitening,
    "op13_splitter_skeleton_trie": op13_splitter_skeleton_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_dual_tree_top_k": """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_token_group_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM w
), t AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), links AS (
  SELECT a.doc_id AS i, b.doc_id AS j FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS i, doc_id AS j FROM s UNION SELECT r.i, l.j FROM reached r JOIN links l ON r.j = l.i
)
SELECT s.doc_id, len(s.g) AS n_shingles, c.component_id FROM s JOIN (SELECT i, min(j) AS component_id FROM reached GROUP BY i) c ON c.i = s.doc_id
""",
    # crc32 bit by bit: a list of bytes, each followed by eight shifts, is folded into the register.
    "op13_splitter_skeleton_trie": """
WITH t AS (
  SELECT conv_id, turn, left(sha256(strlen(r) || ':' || r || x), 32) || printf('%08x', length(x)) AS token
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL) c
), own AS (
  SELECT conv_id, list(token ORDER BY turn NULLS FIRST, token) AS own FROM t GROUP BY conv_id
), steps AS (
  SELECT conv_id, own, list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(conv_id::VARCHAR, '')])) AS s FROM own
), hashed AS (
  SELECT conv_id, own, CAST(xor(list_reduce(s, lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 6 AS INTEGER) AS h FROM steps
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(f.own[1:o.h], []), o.own[o.h + 1:]) AS path
  FROM hashed o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 100
), members AS (
  SELECT conv_id, d AS depth, array_to_string(path[1:d], '') AS node, len(path) AS turns FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM rebuilt) r
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), children AS (
  SELECT left(node, 40 * (depth - 1)::INTEGER) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), each AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * ('0x' || right(node, 8))::BIGINT ELSE 0 END AS saved
  FROM nodes n LEFT JOIN children USING (node)
), subtree AS (
  SELECT left(node, 40 * k::INTEGER) AS node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM each) e GROUP BY 1
)
SELECT e.conv_id, e.depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.n_leaves, s.saved_tokens, e.ends_sha256
FROM each e JOIN subtree s USING (node) LEFT JOIN each p ON e.depth > 0 AND p.node = left(e.node, 40 * (e.depth - 1)::INTEGER)
""",
}
