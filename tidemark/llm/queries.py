"""The corpus queries, one for each operator, over whole tables."""

from __future__ import annotations

import os
import secrets
import warnings

from pyspark.sql import DataFrame, SparkSession

from . import best_fit, centroids, divergence, exact_dedup, langid, mixing, neardup, packing, pii, quotes, suffix_dedup, topk, warc
from .common import read_table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary file; TIDEMARK_TOKENIZERS names another folder to take it from."""
    folder = os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, lambda vec_id: vec_id % 20 == 0, k=20)


OP1_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM valid q JOIN valid d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
"""


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("copies")


def op4_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, similarity=(85, 100))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH digests AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER best = 1 AS kept, text_sha256
FROM digests
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(read_table(spark, sf_dir, "conversations"))


def pseudonym_key() -> str:
    """The secret of the pseudonyms from TIDEMARK_PSEUDONYM_KEY.

    Without it each call draws a new one: values stay linked within a run, but not between runs.
    """
    key = os.environ.get("TIDEMARK_PSEUDONYM_KEY")
    if not key:
        warnings.warn("TIDEMARK_PSEUDONYM_KEY is not set: pseudonyms of this run link to those of no other run", stacklevel=2)
    return key or secrets.token_hex(32)


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"), pseudonym_key())


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(read_table(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def _lloyd_sql(components: int, clusters: int, rounds: int, scale: int, seed: int) -> str:
    """Lloyd's rounds as a chain of tables: assignments ``a0``, ``a1``, ... and centroids ``c0``, ``c1``, ..."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, v AS c
  FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {clusters}
)"""
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT row_id, any_value(vec_id) AS vec_id, any_value(v) AS v,
         min({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': cluster}}) AS best
  FROM kept CROSS JOIN c{n} GROUP BY row_id
)"""
        )
        if n < rounds:
            parts.append(
                f"""m{n} AS (
  SELECT best.c AS cluster, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n
  FROM a{n} CROSS JOIN range(1, {components + 1}) AS places(i) GROUP BY ALL
),
c{n + 1} AS MATERIALIZED (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{n} GROUP BY cluster
  UNION ALL SELECT cluster, c FROM c{n} WHERE cluster NOT IN (SELECT cluster FROM m{n})
)"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON best.c = cluster
"""
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
found AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
kept AS (SELECT lang, term FROM found GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
),
langs AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM dense GROUP BY lang, term),
shares AS (
  SELECT lang, source, term, n,
         1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p
  FROM dense
),
lang_shares AS (
  SELECT lang, term, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM langs
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS place FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR place <= 50
"""


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_best_fit(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


OP11_SQL = _lloyd_sql(64, centroids.CLUSTERS, centroids.ROUNDS, centroids.SCALE, centroids.SEED)


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_language_id": op2_language_id,
    "op3_source_mix": op3_source_mix,
    "op4_minhash_near_duplicates": op4_minhash_near_duplicates,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op8_quotation_linking": op8_quotation_linking,
    "op9_feistel_pseudonyms": op9_feistel_pseudonyms,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_source_divergence": op12_source_divergence,
    "op13_best_fit_packing": op13_best_fit_packing,
}
ORACLES = {"op1_topk_search": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op11_centroid_clustering": OP11_SQL, "op12_source_divergence": OP12_SQL}
