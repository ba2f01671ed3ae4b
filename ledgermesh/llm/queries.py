"""Queries of the training-data operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The tokenizer model; a parameter of the operator, never copied.
BPE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.quality import quality_documents

    return quality_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.mixing import mix_order

    return mix_order(_table(spark, sf_dir, "documents"))


def op3_matroska_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.matroska import media_documents

    return media_documents(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.licenses import scan_documents

    return scan_documents(_table(spark, sf_dir, "documents"))


def op5_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), length=13)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgermesh.llm.bpe import digest_documents

    return digest_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_MODEL))


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.vector_search import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.toxicity import toxicity_documents

    return toxicity_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.prefix_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.url_templates import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgermesh.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_perplexity,
        op2_pfair_mixing,
        op3_matroska_columns,
        op4_license_scan,
        op5_seed_and_extend,
        op6_sentencepiece,
        op7_minhash_forest,
        op8_learned_partitions,
        op9_bootstrapped_pii,
        op10_toxicity,
        op11_prefix_trie,
        op12_url_templates,
        op13_whitening,
        pipeline,
    )
    return {f.__name__: f for f in found}


#: Window by window: the smallest document of each 13-word sequence, and the words that windows of larger ones cover.
OP5_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
low AS (SELECT g, min(doc_id) AS lo FROM win GROUP BY g),
gone AS (SELECT DISTINCT r, p + k AS p FROM (SELECT r, p FROM win JOIN low USING (g) WHERE lo < doc_id), range(0, 13) AS t(k)),
pos AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""

#: Sets of shingles, all pairs that share one, and the links' closure.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, least(len(ws) + 1, 2)))) AS p FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
way AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM way UNION SELECT r.a, e.b FROM reach r JOIN way e ON e.a = r.b),
comp AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""

#: Rebuilt conversations by windows, prefixes by hashes of their turns, subtrees by the paths of their nodes' smallest members.
OP11_SQL = r"""
WITH t AS (SELECT conv_id, turn, sha256(length(r) || ':' || r || x) AS g, length(x) AS chars FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
o AS MATERIALIZED (SELECT conv_id, g, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) - 1 AS p FROM t),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS family, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda b: ascii(b)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, o.p, o.g, o.chars FROM c JOIN o ON o.conv_id = c.family AND o.p < c.h UNION ALL SELECT c.conv_id, o.p, o.g, o.chars FROM c JOIN o ON o.conv_id = c.conv_id AND o.p >= c.h),
d AS MATERIALIZED (SELECT conv_id, g, chars, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d FROM r),
l AS (SELECT conv_id, list(g ORDER BY d) AS gs FROM d GROUP BY conv_id),
m AS MATERIALIZED (SELECT d.conv_id, d.d, sha256(array_to_string(l.gs[1:d.d], ',')) AS k, d.chars FROM d JOIN l USING (conv_id) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id),
n AS MATERIALIZED (SELECT k, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS w FROM m GROUP BY k),
up AS MATERIALIZED (SELECT n.k, m.k AS parent FROM n JOIN m ON m.conv_id = n.conv_id AND m.d = n.depth - 1),
kids AS MATERIALIZED (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
s AS (SELECT m.k, sum(n.w) AS saved, count(*) FILTER (WHERE kids.k IS NULL) AS leaves FROM n JOIN m ON m.conv_id = n.conv_id AND m.d <= n.depth LEFT JOIN kids ON kids.k = n.k GROUP BY m.k),
ends AS (SELECT m.k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM m JOIN e USING (conv_id, d) GROUP BY m.k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM n JOIN s USING (k) LEFT JOIN up USING (k) LEFT JOIN n q ON q.k = up.parent LEFT JOIN kids ON kids.k = n.k LEFT JOIN ends ON ends.k = n.k"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose rows SQL can say; the others are tested against brute force, round trips or held-out labels."""
    return {"op5_seed_and_extend": OP5_SQL, "op7_minhash_forest": OP7_SQL, "op11_prefix_trie": OP11_SQL}
