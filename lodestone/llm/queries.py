"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import cluster_vectors
from .chunk_bpe import encode_documents as encode_in_chunks
from .common import table
from .divergence import audit_sources
from .embedding_dedup import embedding_dedup
from .html_text import extract
from .langid import identify
from .licenses import scan
from .multiset_hash import neighbour_fingerprints
from .packing import pack_documents
from .pieces import encode_documents
from .quality import resample
from .simhash import simhash_dedup
from .token_counts import count_revisions


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_revisions(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents"), keep_counts=False)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op13_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_in_chunks(table(spark, sf_dir, "documents"), keep_ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in sorted(globals().items()) if k.startswith("op") and k[2].isdigit()}


def _op11_sql(rounds: int = 3) -> str:
    far = "list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i])))"
    steps = []
    for n in range(rounds + 1):
        # the least of 16 * distance + number is the nearest centroid, the one of smaller number on ties
        steps.append(f"a{n} AS (SELECT k.r, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min(16 * {far} + m.c) AS best FROM kept k CROSS JOIN m{n} m GROUP BY k.r)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT best % 16 AS c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{n}) GROUP BY c, i)")
            steps.append(f"f{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY c)")
            steps.append(f"m{n + 1} AS (SELECT m.c, coalesce(f.v, m.v) AS v FROM m{n} m LEFT JOIN f{n} f USING (c))")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), h AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c FROM kept),
m0 AS (SELECT c, v FROM h WHERE c < 16),
{", ".join(steps)},
e AS (SELECT vec_id, CAST(best % 16 AS INTEGER) AS cluster, CAST(best // 16 AS BIGINT) AS distance FROM a{rounds})
SELECT e.vec_id, e.cluster, e.distance,
  CAST(sum(e.distance) OVER (PARTITION BY e.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(e.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM e JOIN m{rounds} m ON m.c = e.cluster
"""


_OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM t GROUP BY lang, source, term),
k AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY lang, term HAVING sum(df) >= 10),
l AS (SELECT lang, count(*) AS v, CAST(sum(total) AS HUGEINT) AS size FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
z AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS size
  FROM g LEFT JOIN (SELECT c.* FROM c SEMI JOIN k ON k.lang = c.lang AND k.term = c.term) c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT z.lang, z.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (z.size + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 2)) // (l.size + 2 * l.v) AS q
  FROM z JOIN l ON l.lang = z.lang JOIN k ON k.lang = z.lang LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term),
w AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(w.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what can be stated in it; the other operators are held against brute force in the tests."""
    return {"op11_centroids": _op11_sql(), "op12_divergence": _OP12_SQL}
