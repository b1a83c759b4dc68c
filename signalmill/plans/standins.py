"""The engine's relations over the driver's tables, as frames and as SQL (common table expressions) for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.operators.staging import bound_batches

NOW = "2024-01-31 00:00:00"
KINDS = ("pain", "build", "signal", "research", "read", "pattern", "oddity")


def now():
    return F.lit(NOW).cast("timestamp")


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def kind_of(n):
    return F.element_at(F.array(*map(F.lit, KINDS)), (n % len(KINDS) + 1).cast("int"))


def items(spark: SparkSession, d: str) -> DataFrame:
    from signalmill.functions.text import content_hash

    i = F.col("doc_id")
    s = i.cast("string")
    m = i % 10
    return load(spark, d, "documents").select(
        i.alias("id"), "source", s.alias("source_id"), F.when(i % 3 != 0, F.concat(F.lit("https://"), "source", F.lit(".example/"), s)).alias("url"), F.col("text").alias("raw_text"),
        content_hash(F.col("text")).alias("content_hash"),
        F.when(m < 5, "ready").when(m < 7, "processing").when(m == 7, "done").when(m == 8, "failed").otherwise("fetched").alias("state"),
        (i % 4).cast("int").alias("attempts"), (now() - F.make_dt_interval(mins=(i % 180).cast("int"))).alias("processing_at"), now().alias("fetched_at"),
        F.when(i % 4 == 0, F.concat(F.lit('{"publication":"Pub '), (i % 8).cast("string"), F.lit('","points":'), (i % 90).cast("string"), F.lit("}"))).alias("metadata"),
        F.when(i % 5 != 0, F.concat(F.lit("t"), (i % 50).cast("string"))).alias("thread_id"),
    )


ITEMS = r"""items AS (
  SELECT doc_id AS id, source, CAST(doc_id AS VARCHAR) AS source_id,
         CASE WHEN doc_id % 3 <> 0 THEN 'https://' || source || '.example/' || CAST(doc_id AS VARCHAR) END AS url, text AS raw_text,
         sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS content_hash,
         CASE WHEN doc_id % 10 < 5 THEN 'ready' WHEN doc_id % 10 < 7 THEN 'processing' WHEN doc_id % 10 = 7 THEN 'done' WHEN doc_id % 10 = 8 THEN 'failed' ELSE 'fetched' END AS state,
         CAST(doc_id % 4 AS INTEGER) AS attempts, TIMESTAMP '2024-01-31 00:00:00' - to_minutes(CAST(doc_id % 180 AS INTEGER)) AS processing_at,
         CASE WHEN doc_id % 4 = 0 THEN '{"publication":"Pub ' || CAST(doc_id % 8 AS VARCHAR) || '","points":' || CAST(doc_id % 90 AS VARCHAR) || '}' END AS metadata,
         CASE WHEN doc_id % 5 <> 0 THEN 't' || CAST(doc_id % 50 AS VARCHAR) END AS thread_id
  FROM documents)"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return load(spark, d, "documents").select(
        i.alias("id"), F.when(i % 11 != 0, i).alias("item_id"), kind_of(i).alias("kind"), F.col("text").alias("statement"),
        F.when(i % 2 == 0, F.concat(F.lit("because "), "lang")).otherwise("").alias("why_it_matters"), "lang",
        F.when(i % 3 == 0, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(F.concat(F.lit("not "), "text")).alias("evidence_quote"),
        F.when(i % 13 != 0, F.col("n_chars") % 101 / 100.0).cast("double").alias("confidence"), F.when(i % 19 != 0, i % 150).alias("cluster_id"),
        (now() - F.make_dt_interval(hours=(i % 48).cast("int"))).alias("created_at"),
    ).withColumnRenamed("lang", "domain")


FINDINGS = """findings AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 11 <> 0 THEN doc_id END AS item_id,
         ['pain', 'build', 'signal', 'research', 'read', 'pattern', 'oddity'][doc_id % 7 + 1] AS kind, text AS statement,
         CASE WHEN doc_id % 2 = 0 THEN 'because ' || lang ELSE '' END AS why_it_matters, lang AS domain,
         CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'E') ELSE 'not ' || text END AS evidence_quote,
         CASE WHEN doc_id % 13 <> 0 THEN (n_chars % 101) / 100.0::DOUBLE END AS confidence, CASE WHEN doc_id % 19 <> 0 THEN doc_id % 150 END AS cluster_id,
         TIMESTAMP '2024-01-31 00:00:00' - to_hours(CAST(doc_id % 48 AS INTEGER)) AS created_at
  FROM documents)"""


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("cluster_id"), F.col("event_type").alias("source"), F.to_date("ts").alias("seen_on"), "ts")


MENTIONS = "mentions AS (SELECT event_id AS id, user_id AS cluster_id, event_type AS source, CAST(ts AS DATE) AS seen_on, ts FROM events)"


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the mentions; some are muted or pinned, every seventh has no score yet."""
    from signalmill.operators.clusters import mention_sets
    from signalmill.operators.ranking import score_clusters

    m = mentions(spark, d)
    last = m.groupBy("cluster_id").agg(F.max("ts").alias("last_seen"), F.min("ts").alias("first_seen"))
    i = F.col("cluster_id")
    c = mention_sets(m).join(last, "cluster_id").select(
        i.alias("id"), kind_of(i).alias("kind"), F.concat(F.lit("cluster "), i.cast("string")).alias("canonical_statement"), "sources_seen", "days_seen",
        F.col("mention_count").cast("int").alias("mention_count"), "first_seen", "last_seen", (i % 17 == 0).alias("muted"), (i % 5 == 0).alias("pinned"), (i % 90).cast("int").alias("pinned_mention_count"),
    )
    return score_clusters(c, now()).withColumn("score", F.when(F.col("id") % 23 != 0, F.col("score")))


CLUSTERS = (
    MENTIONS
    + """, clusters AS (
  SELECT cluster_id AS id, ['pain', 'build', 'signal', 'research', 'read', 'pattern', 'oddity'][cluster_id % 7 + 1] AS kind, 'cluster ' || CAST(cluster_id AS VARCHAR) AS canonical_statement,
         list_sort(list_distinct(list(source))) AS sources_seen, list_sort(list_distinct(list(seen_on))) AS days_seen,
         CAST(count(DISTINCT source || '|' || CAST(seen_on AS VARCHAR)) AS INTEGER) AS mention_count, min(ts) AS first_seen, max(ts) AS last_seen,
         cluster_id % 17 = 0 AS muted, cluster_id % 5 = 0 AS pinned, CAST(cluster_id % 90 AS INTEGER) AS pinned_mention_count,
         max(ts) >= TIMESTAMP '2024-01-24 00:00:00' AS recent,
         CASE WHEN cluster_id % 23 <> 0 THEN 2.0::DOUBLE * count(DISTINCT source) + 1.5::DOUBLE * count(DISTINCT seen_on)
              + log2(1 + count(DISTINCT source || '|' || CAST(seen_on AS VARCHAR))) + CASE WHEN max(ts) >= TIMESTAMP '2024-01-24 00:00:00' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END END AS score
  FROM mentions GROUP BY cluster_id)"""
)


def section_of(n):
    from signalmill.functions.jsons import SECTIONS

    return F.element_at(F.array(*map(F.lit, SECTIONS)), (n % 7 + 1).cast("int"))


SECTION = "['patterns', 'papers', 'worth_reading', 'shipped', 'market', 'gaps', 'someone_built']"
