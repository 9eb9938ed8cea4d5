"""The registered queries of the operators, each over its whole tables, and their check SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskflow.llm import ann, bpe, centroids, fingerprint, jaccard, license, main_text, packing, quality, repair, toxicity, url_filter, warc
from riskflow.llm.common import held_out, materialize, read
from riskflow.session import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _judged(scored: DataFrame, least: float, *more: str) -> DataFrame:
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), *more)


# The rules of the URL query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@register()
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = ann.index(read(spark, sf_dir, "embeddings"))
    return ann.search(coded, coded.filter(F.col("vec_id") % 20 == 0), 20)


@register()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _judged(quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels"))), 0.7)


@register("""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "rule string, verdict string"))


@register()
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(read(spark, sf_dir, "documents"))


@register()
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classify(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


@register()
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read(spark, sf_dir, "documents"))


@register()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.judged(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return _judged(scored, 0.3, "threshold", "toxic")


@register()
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read(spark, sf_dir, "documents"))


@register()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@register("""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > low THEN low END AS refers_to FROM f""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    path = path if "://" in path or path.startswith("file:") else f"file://{path}"
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _clusters_sql(rounds: int) -> str:
    """Plain assignment to all centroids, round after round; vec_id is taken as unique."""
    apart = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = ["""WITH kept AS MATERIALIZED (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM kept ORDER BY k LIMIT 16)"]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
          SELECT vec_id, v, k, c, CAST(d AS BIGINT) AS d FROM (SELECT vec_id, v, k, c, {apart} AS d FROM kept CROSS JOIN c{i})
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)""")
        parts.append(f"""c{i + 1} AS MATERIALIZED (
          SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
            SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i) GROUP BY k
          UNION ALL SELECT k, c FROM c{i} WHERE k NOT IN (SELECT k FROM a{i}))""")
    return ", ".join(parts) + f"""
    SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds}"""


@register(_clusters_sql(3))
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(read(spark, sf_dir, "embeddings"))
    return centroids.inertia(found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@register()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ids = repair.damage(read(spark, sf_dir, "conversations"))
    found = materialize(repair.audits(rows, ids), "repair-audits")
    return repair.repair(rows, found, digest=True).select(
        repair.conv_id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@register()
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read(spark, sf_dir, "pages"))


@register(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
