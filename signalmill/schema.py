"""Tables of the engine, as DDL strings and as empty frames; migrations only add columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The states an item goes through, in the order they are reported.
STATES = ("fetched", "ready", "processing", "done", "failed", "duplicate")

TABLES = {
    "sources": "name string, adapter string, config_json string, cursor_field string, last_successful_fetch_at timestamp, enabled boolean, created_at timestamp",
    "items": "id long, source string, source_id string, url string, raw_text string, content_hash string, state string, attempts int, processing_at timestamp, fetched_at timestamp, metadata string, thread_id string",
    "clusters": "id long, kind string, canonical_statement string, centroid array<float>, sources_seen array<string>, days_seen array<date>, mention_count int, first_seen timestamp, last_seen timestamp, score double, score_version string, muted boolean, pinned boolean, pinned_mention_count int",
    "findings": "id long, item_id long, kind string, statement string, why_it_matters string, domain string, evidence_quote string, confidence double, embedding array<float>, cluster_id long, created_at timestamp",
    "mentions": "id long, cluster_id long, source string, seen_on date",
    "feedback": "id long, cluster_id long, verdict string, features_json string, score_version string, created_at timestamp",
    "runs": "id long, started_at timestamp, finished_at timestamp, items_fetched int, findings_created int, errors array<string>",
    "nightly_dispatch_log": "id long, request_id long, attempt int, created_at timestamp, checked boolean, status_code int, note string",
}
#: Items as adapters yield them; created_at_i serves windows and is not kept.
FETCHED = "source string, source_id string, url string, raw_text string, content_hash string, created_at_i long, thread_id string, metadata string"
#: The six keys of a finding, in JSON.
FINDING = "kind string, statement string, why_it_matters string, domain string, evidence_quote string, confidence double"


def empty(spark: SparkSession, table: str) -> DataFrame:
    """An empty frame of a table."""
    return spark.createDataFrame([], TABLES[table])


def bootstrap(spark: SparkSession, database: str = "default") -> list[str]:
    """Create the tables that are missing, as Parquet tables; returns their names."""
    made = []
    for name, columns in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING parquet")
            made.append(name)
    return made


def add_columns(df: DataFrame, table: str) -> DataFrame:
    """The frame with the table's missing columns as nulls, in the table's order (an additive migration)."""
    want = df.sparkSession.createDataFrame([], TABLES[table]).schema
    from pyspark.sql import functions as F

    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want])
