"""One query opN_<name> for each operator, over its whole table with production parameters, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from rastermill.llm import pii, secrets
from rastermill.llm.clustering import delta_lloyd
from rastermill.llm.decontamination import contaminated
from rastermill.llm.negatives import hard_negatives
from rastermill.llm.ngram_join import ngram_jaccard_join
from rastermill.llm.packing import pack_sequences
from rastermill.llm.sharding import sharded
from rastermill.llm.suffix_dedup import repeated_strings
from rastermill.llm.token_counts import token_counts
from rastermill.llm.top_k import exact_top_k
from rastermill.llm.toxicity import toxicity
from rastermill.llm.warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = exact_top_k(vectors, vectors.where("vec_id % 50 = 0"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"), keep_text=False)
    base = f"filter(spans, x -> x.k < {len(pii.BASE)})"
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.k = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(pii.BASE)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(F.expr(pii.listed(base)), 256).alias("base_sha256"), F.expr(pii.listed("spans")).alias("spans"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), VOCABULARY).withColumnRenamed("id", "doc_id")


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, threshold=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.k = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(secrets.BASE)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(F.expr(secrets.listed("base")), 256).alias("base_sha256"), F.expr(secrets.listed("spans")).alias("spans"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_strings(table(spark, sf_dir, "documents"), length=200)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack_sequences(table(spark, sf_dir, "documents"), VOCABULARY)
    return found.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delta_lloyd(table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return sharded(table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


ORACLES["op1_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES["op4_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS gs FROM w),
g AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS k FROM s),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.k = b.k AND a.doc_id <> b.doc_id AND a.n >= 0.9 * b.n AND b.n >= 0.9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS at FROM s UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.at = l.x)
SELECT s.doc_id, len(gs)::BIGINT AS n_shingles, min(r.at) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, gs
"""

ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS b, sha1(coalesce(html, '')) AS d FROM pages),
t AS (SELECT *, CASE WHEN b >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS top FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM t
"""


def _lloyd_sql(k: int, rounds: int, width: int, scale: int) -> str:
    steps = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding AS raw, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(range({width})) AS dim, unnest(e) AS c FROM v),
f AS (SELECT *, row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id, raw) - 1 AS cluster FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT cluster, unnest(range({width})) AS dim, unnest(e) AS c FROM f)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(d).d AS distance, min(d).k AS cluster FROM (SELECT r, {{'d': sum((x.c - c.c) * (x.c - c.c))::BIGINT, 'k': cluster}} AS d FROM x JOIN c{i} c USING (dim) GROUP BY r, cluster) GROUP BY r)""")
        if i < rounds:  # whole division downwards: s - mod, mod not negative
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.cluster, o.dim, CASE WHEN n > 0 THEN (s - ((s % n) + n) % n) // n ELSE o.c END AS c FROM c{i} o
  LEFT JOIN (SELECT cluster, dim, sum(c)::BIGINT AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY ALL) USING (cluster, dim))""")
    steps.append(f"h AS (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h USING (cluster)
"""


ORACLES["op11_centroid_clustering"] = _lloyd_sql(8, 10, 64, 1024)

ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor, b.id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor, p.id AS positive, p.score AS positive_score, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score FROM n WHERE rank <= 5
"""
