"""Writes as new versions of a table: pure functions, no row is changed in place.

Plain Parquet tables know no UPDATE, DELETE or MERGE; each function returns the table's next version, or the rows to
append, and ``write`` puts a version in place of another by overwrite of a fresh folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The incoming rows that are inserted: new keys only, the first by ``order`` of each key."""
    fresh = incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return fresh.withColumn("_first", first).where("_first = 1").drop("_first")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows without an incoming key, and all incoming rows (one a key)."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def _dealt(df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``df`` with ``_part``, the number of edges at or below the row in ``order``; a sample of ``parts`` rows gives the
    edges, as literals, so every use of the plan deals alike."""
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    drawn = df.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(parts - 1).collect()
    if len(drawn) < max(1, parts - 1):
        # The sample is all there is: too few rows to deal.
        return df.withColumn("_part", F.lit(0))
    types = [f.dataType for f in df.select(key.alias("k")).schema["k"].dataType]
    edges = [F.struct(*[F.lit(v).cast(t).alias(f"o{i}") for i, (v, t) in enumerate(zip(r["k"], types))]) for r in drawn]
    return df.withColumn("_part", F.size(F.filter(F.array(*edges), lambda e: e <= key)))


def running_sum(df: DataFrame, by: list[str], order: list[Column], value: Column, out: str, parts: int = 64) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before it in its ``by`` group, also where a group is hot.

    Rows are dealt by group and range of ``order``, summed there, and shifted by what the ranges before hold.
    """
    dealt = _dealt(df, order, parts).withColumn("_v", value)
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy(*by, "_part").agg(F.sum("_v").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.withColumn("_before", before).select(*by, "_part", "_before")
    return dealt.withColumn("_n", inside).join(shifts, [*by, "_part"]).withColumn(out, F.col("_before") + F.col("_n")).select(*df.columns, out)


def rank_in_order(df: DataFrame, by: list[str], order: list[Column], out: str, parts: int = 64) -> DataFrame:
    """``df`` with the row's number from 1 inside its ``by`` group in ascending ``order``, also where a group is hot."""
    return running_sum(df, by, order, F.lit(1).cast("long"), out, parts).withColumn(out, F.col(out) + 1)


def with_ids(existing: DataFrame, incoming: DataFrame, order: list[Column], column: str = "id") -> DataFrame:
    """Incoming rows with ids that follow the largest existing one in ascending ``order``; ids order the queue, so they are dense."""
    numbered = rank_in_order(incoming.drop(column).withColumn("_all", F.lit(0)), ["_all"], order, "_id")
    # A global aggregate is one row; the constant key joins it to every row.
    top = existing.agg(F.coalesce(F.max(column), F.lit(0)).alias("_top")).withColumn("_all", F.lit(0))
    rest = [c for c in incoming.columns if c != column]
    return numbered.join(F.broadcast(top), "_all").select((F.col("_top") + F.col("_id")).cast("long").alias(column), *rest)


def set_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """``values`` in the rows that meet the condition."""
    met = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(met, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def set_state(items: DataFrame, decided: DataFrame) -> DataFrame:
    """States of ``decided`` (id, state) in the items."""
    new = decided.select("id", F.col("state").alias("_state"))
    return items.join(new, "id", "left").withColumn("state", F.coalesce("_state", "state")).drop("_state").select(*items.columns)


def record_judgement(items: DataFrame, judged: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next items, findings to append, item_id with the number written) for judged (item_id, p_findings JSON array)."""
    from signalmill.schema import FINDING

    parsed = judged.select("item_id", F.from_json("p_findings", f"array<struct<{', '.join(x.replace(' ', ':') for x in FINDING.split(', '))}>>").alias("f"))
    findings = parsed.select("item_id", F.explode("f").alias("f")).select("item_id", "f.*").withColumn("created_at", now)
    counts = parsed.select("item_id", F.coalesce(F.when(F.col("f").isNull(), 0).otherwise(F.size("f")), F.lit(0)).alias("n"))
    done = counts.select(F.col("item_id").alias("_done")).distinct()
    hit = F.col("_done").isNotNull()
    changed = items.join(done, F.col("id") == F.col("_done"), "left")
    changed = changed.withColumns({"raw_text": F.when(~hit, F.col("raw_text")), "state": F.when(hit, "done").otherwise(F.col("state"))})
    return changed.select(*items.columns), findings, counts


def set_embedding(findings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Embeddings given as text (id, vec) in the findings."""
    from signalmill.functions.vectors import parse_vector

    new = vectors.select("id", parse_vector(F.col("vec")).alias("_v"))
    return findings.join(new, "id", "left").withColumn("embedding", F.coalesce("_v", "embedding")).select(*findings.columns)


def advance_watermarks(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """Sources with the fetch start of those fetched (name, started_at) as watermark."""
    new = fetched.select("name", F.col("started_at").alias("_wm"))
    return sources.join(new, "name", "left").withColumn("last_successful_fetch_at", F.coalesce("_wm", "last_successful_fetch_at")).select(*sources.columns)


def reset(tables: dict[str, DataFrame], keep_sources: list[str], now: Column) -> dict[str, DataFrame]:
    """All tables but the registry emptied; other sources gone, watermarks six hours before now."""
    from signalmill.functions.times import ago

    out = {name: df.limit(0) for name, df in tables.items() if name != "sources"}
    kept = tables["sources"].where(F.col("name").isin(keep_sources))
    return out | {"sources": kept.withColumn("last_successful_fetch_at", ago(now, hours=6))}


def mute(clusters: DataFrame, cluster_id: int) -> DataFrame:
    return set_where(clusters, F.col("id") == cluster_id, muted=True)


def pin(clusters: DataFrame, cluster_id: int) -> DataFrame:
    return set_where(clusters, F.col("id") == cluster_id, pinned=True, pinned_mention_count=F.coalesce("mention_count", F.lit(0)))


def feedback_rows(clusters: DataFrame, cluster_id: int, verdict: str, now: Column) -> DataFrame:
    """The feedback row for a button press: verdict and feature snapshot as JSON."""
    from signalmill.functions.scoring import SCORE_VERSION, feature_snapshot
    from signalmill.functions.times import recent

    if verdict not in ("interesting", "kill", "watch"):
        raise ValueError(f"unknown verdict {verdict!r}")
    shot = feature_snapshot(F.col("kind"), F.col("sources_seen"), F.col("days_seen"), F.col("mention_count"), recent(F.col("last_seen"), now))
    return clusters.where(F.col("id") == cluster_id).select(F.col("id").alias("cluster_id"), F.lit(verdict).alias("verdict"), F.to_json(shot).alias("features_json"), F.lit(SCORE_VERSION).alias("score_version"), now.alias("created_at"))


def run_row(run_id: int, started_at: Column, finished_at: Column | None, fetched: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """One metrics row of a run; ``errors`` (source, error) become "source: error" in name order."""
    n = fetched.agg(F.count(F.lit(1)).cast("int").alias("items_fetched"))
    m = findings.agg(F.count(F.lit(1)).cast("int").alias("findings_created"))
    e = errors.agg(F.array_sort(F.collect_list(F.concat_ws(": ", "source", "error"))).alias("errors"))
    end = finished_at if finished_at is not None else F.lit(None).cast("timestamp")
    one = [x.withColumn("_one", F.lit(1)) for x in (n, m, e)]
    return one[0].join(one[1], "_one").join(one[2], "_one").select(F.lit(run_id).cast("long").alias("id"), started_at.alias("started_at"), end.alias("finished_at"), "items_fetched", "findings_created", "errors")


def get(df: DataFrame, **equal) -> DataFrame:
    """The first row whose columns have the given values, or none."""
    for column, value in equal.items():
        df = df.where(F.col(column) == F.lit(value))
    return df.limit(1)


def write(df: DataFrame, path: str) -> DataFrame:
    """Write a version to a new folder and read it back."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
