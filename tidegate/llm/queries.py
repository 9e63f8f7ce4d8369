"""The thin ``opN_*`` queries over whole tables, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import cross_entropy, dual_tree, entropy_secrets, fair_mix, hilbert_pack, jump_shards, mcd_quality, merkle, mph_store, nnpu_toxicity, radix_audit, simhash_dedup, suffix_dedup
from tidegate.llm.common import fresh_path, table, vocabulary


def op1_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd_quality.judge(table(spark, sf_dir, "documents"))


def op2_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_pack.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jump_shards.assign_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fair_mix.fair_schedule(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op5_mph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "store")
    mph_store.write_store(docs, path, vocabulary("byte_bpe_50k.json"))
    return mph_store.read_store(spark, path, docs.schema["doc_id"].dataType)


def op6_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.select("vec_id", dual_tree.scaled(vectors["embedding"]).alias("v"))
    return dual_tree.search(vectors, F.pmod("vec_id", F.lit(100)) == 0, 10)


def op7_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnpu_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_secrets.digest(entropy_secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash_dedup.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check(table(spark, sf_dir, "documents")).drop("path")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op13_radix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_audit.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_mcd_quality": op1_mcd_quality,
        "op2_hilbert_pack": op2_hilbert_pack,
        "op3_jump_shards": op3_jump_shards,
        "op4_fair_mix": op4_fair_mix,
        "op5_mph_store": op5_mph_store,
        "op6_dual_tree": op6_dual_tree,
        "op7_nnpu_toxicity": op7_nnpu_toxicity,
        "op8_entropy_secrets": op8_entropy_secrets,
        "op9_simhash_dedup": op9_simhash_dedup,
        "op10_cross_entropy": op10_cross_entropy,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_suffix_dedup": op12_suffix_dedup,
        "op13_radix_audit": op13_radix_audit,
    }


#: Exact search by comparing each query with every vector.
_OP6 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

#: Levels of both trees by recursion; a proof takes the other children of each node's parent; each tampered leaf is folded level by level.
_OP11 = r"""
WITH RECURSIVE told AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS uid, doc_id, source,
    coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
leaf AS (
  SELECT uid, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS r, row_number() OVER (PARTITION BY source ORDER BY uid) - 1 AS i,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS h,
    sha256(head || CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN coalesce(octet_length(encode(low)) || ':' || low, '-') ELSE coalesce(octet_length(encode(text)) || ':' || text, '-') END) AS trial
  FROM told),
up AS (
  SELECT 0 AS l, r, i, h, count(*) OVER (PARTITION BY r) AS n FROM leaf
  UNION ALL
  SELECT l + 1, r, i // 16, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 15) // 16 FROM up WHERE n > 1 GROUP BY l, r, i // 16),
tops AS (SELECT r, l AS height, h AS subroot FROM up WHERE n = 1),
up2 AS (
  SELECT 0 AS l, r AS i, subroot AS h, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT l + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 15) // 16 FROM up2 WHERE n > 1 GROUP BY l, i // 16),
root AS (SELECT l AS height, h AS root FROM up2 WHERE n = 1),
-- Steps of a leaf: the children of its parent at each level of its source's tree, then of the sources' tree.
steps AS (
  SELECT f.uid, u.l AS step, u.i AS kid, f.i >> (4 * u.l) AS own, u.h FROM leaf f JOIN up u ON u.r = f.r AND u.n > 1 AND u.i >> 4 = f.i >> (4 * u.l + 4)
  UNION ALL
  SELECT f.uid, t.height + u.l, u.i, f.r >> (4 * u.l), u.h FROM leaf f JOIN tops t ON t.r = f.r JOIN up2 u ON u.n > 1 AND u.i >> 4 = f.r >> (4 * u.l + 4)),
proof AS (SELECT uid, coalesce(string_agg(h, '' ORDER BY step, kid) FILTER (WHERE kid <> own), '') AS siblings FROM steps GROUP BY uid),
sides AS (
  SELECT uid, step, coalesce(string_agg(h, '' ORDER BY kid) FILTER (WHERE kid < own), '') AS before, coalesce(string_agg(h, '' ORDER BY kid) FILTER (WHERE kid > own), '') AS behind
  FROM steps GROUP BY uid, step),
folds AS (
  SELECT uid, 0 AS step, trial AS h FROM leaf
  UNION ALL
  SELECT f.uid, f.step + 1, sha256(s.before || f.h || s.behind) FROM folds f JOIN sides s ON s.uid = f.uid AND s.step = f.step)
SELECT f.doc_id, f.h AS leaf, t.subroot, root.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, d.h AS folded_root, d.h = root.root AS verified
FROM leaf f JOIN tops t ON t.r = f.r CROSS JOIN root LEFT JOIN proof p ON p.uid = f.uid
JOIN folds d ON d.uid = f.uid AND d.step = t.height + root.height
"""

#: Every window of every text by its bytes; a run of repeated starts goes on while the next one begins within the one before.
_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT uid, unnest(range(octet_length(b) - 399)) AS s, b FROM d WHERE octet_length(b) >= 400),
h AS (SELECT uid, s, md5(array_slice(b, s + 1, s + 400)) AS h FROM w),
twice AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
hits AS (SELECT uid, s FROM h SEMI JOIN twice USING (h)),
marked AS (SELECT uid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY uid ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM hits),
grouped AS (SELECT uid, s, sum(new) OVER (PARTITION BY uid ORDER BY s) AS span FROM marked),
spans AS (SELECT uid, span, min(s) AS a, max(s) + 400 AS e FROM grouped GROUP BY uid, span),
pieces AS (
  SELECT uid, coalesce(lag(e) OVER (PARTITION BY uid ORDER BY a), 0) AS a, a AS e FROM spans
  UNION ALL
  SELECT s.uid, max(s.e), octet_length(any_value(d.b)) FROM spans s JOIN d ON d.uid = s.uid GROUP BY s.uid),
kept AS (SELECT p.uid, sha256(unhex(string_agg(hex(CASE WHEN p.e > p.a THEN array_slice(d.b, p.a + 1, p.e) ELSE ''::BLOB END), '' ORDER BY p.a, p.e))) AS kept FROM pieces p JOIN d ON d.uid = p.uid GROUP BY p.uid),
lost AS (SELECT uid, sum(e - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY uid)
SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(l.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(l.n_spans, 0) AS BIGINT) AS n_spans, coalesce(k.kept, sha256(d.b)) AS kept_sha256
FROM d LEFT JOIN lost l ON l.uid = d.uid LEFT JOIN kept k ON k.uid = d.uid
"""

_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT uid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c_lang FROM w GROUP BY lang, term HAVING count(DISTINCT uid) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(c_lang) AS n_lang FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (
  SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (n.n + l.v) AS p,
    1 + 1000000000::HUGEINT * (k.c_lang + 1) // (l.n_lang + l.v) AS q
  FROM n JOIN langs l ON l.lang = n.lang JOIN kept k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms QUALIFY rank <= 200)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    """SQL can't say the others (trained models, tokenizers, 64-bit hashes of this engine, entropy windows, robust fits): brute force in tests/llm checks them."""
    return {"op6_dual_tree": _OP6, "op11_merkle_manifest": _OP11, "op12_suffix_dedup": _OP12, "op13_radix_audit": _OP13}
