"""Operators' counts and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions.scoring import rate
from signalmill.functions.times import time_since
from signalmill.operators.clusters import with_source
from signalmill.operators.rendering import known_kind
from signalmill.schema import STATES


def by_kind(findings: DataFrame) -> DataFrame:
    """kind, n, known, first_id; shown by n descending, then first_id."""
    n = findings.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return n.withColumn("known", F.coalesce(known_kind(F.col("kind")), F.lit(False)))


def by_state(items: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """Every state in its fixed place with its number of items, 0 too."""
    spark = items.sparkSession
    all_states = spark.createDataFrame(list(enumerate(states)), "place int, state string")
    n = items.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return all_states.join(n, "state", "left").select("place", "state", F.coalesce("n", F.lit(0)).alias("n"))


def by_source(sources: DataFrame, items: DataFrame) -> DataFrame:
    """Each source with its items, watermark ("never") and whether it is disabled."""
    n = items.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return sources.join(n, "name", "left").select(
        "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.date_format("last_successful_fetch_at", "yyyy-MM-dd HH:mm:ss"), F.lit("never")).alias("watermark"), (~F.coalesce("enabled", F.lit(False))).alias("disabled")
    )


def findings_by_source(findings: DataFrame, items: DataFrame) -> DataFrame:
    """Findings per source, "unknown" without an item; duplicates count."""
    return with_source(findings, items).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def zero_filled(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """Every source with its count, 0 too."""
    return sources.select(F.col("name").alias("source")).join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def run_counters(log: DataFrame, by: list[str]) -> DataFrame:
    """Judged, failed, empty, triaged out, deep reads, capped, findings of a judging log, per ``by``.

    The log has outcome (judged, failed, capped), triaged_out and deep_read booleans and n findings.
    """
    n = lambda c: F.count_if(c)
    judged = F.col("outcome") == "judged"
    return log.groupBy(*by).agg(
        n(judged).alias("judged"), n(F.col("outcome") == "failed").alias("failed"), n(judged & (F.col("n") == 0)).alias("empty"), n(judged & F.col("triaged_out")).alias("triaged_out"),
        n(F.col("deep_read")).alias("deep_reads"), n(F.col("outcome") == "capped").alias("capped"), F.coalesce(F.sum(F.when(judged, F.col("n"))), F.lit(0)).alias("findings"),
    )


def run_rates(counters: DataFrame, seconds: Column) -> DataFrame:
    """Counters with the rates of triage, empty deep reads, and seconds a deep read; nothing over nothing is 0."""
    return counters.withColumns({
        "triage_kill_rate": rate(F.col("triaged_out"), F.col("judged")), "empty_rate": rate(F.col("empty") - F.col("triaged_out"), F.col("deep_reads")), "seconds_per_read": rate(seconds, F.col("deep_reads")),
    })


def fetched_and_inserted(fetched: DataFrame, inserted: DataFrame) -> DataFrame:
    """Per source the items fetched and those that were new."""
    a = fetched.groupBy("source").agg(F.count(F.lit(1)).alias("items_fetched"))
    b = inserted.groupBy("source").agg(F.count(F.lit(1)).alias("items_inserted"))
    return a.join(b, "source", "left").select("source", "items_fetched", F.coalesce("items_inserted", F.lit(0)).alias("items_inserted"))


def last_run(runs: DataFrame, now: Column) -> DataFrame:
    """One row: the footer on the latest run by start, or that there is none."""
    r = runs.agg(F.max_by(F.struct("finished_at", "started_at", "items_fetched", "findings_created"), "started_at").alias("r"))
    stamp = F.coalesce("r.finished_at", "r.started_at")
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    text = F.concat(F.lit("last run "), time_since(stamp, now), F.lit(" · "), n("r.items_fetched"), F.lit(" fetched · "), n("r.findings_created"), F.lit(" findings"))
    return r.select(F.when(F.col("r").isNull(), "no runs yet").otherwise(text).alias("footer"))


def dispatch_reconcile(log: DataFrame, responses: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    """What happens to each unchecked dispatch older than 45 seconds, given the responses (id, status_code, error_msg, content).

    accepted (2xx), retry or alert; wait for a response for ten minutes, then lost.
    """
    due = log.where(~F.col("checked") & (F.col("created_at") < now - F.expr("INTERVAL 45 SECONDS")))
    got = responses.select(F.col("id").alias("request_id"), F.col("status_code").alias("_status"), "error_msg", "content", F.lit(True).alias("_found"))
    j = due.join(got, "request_id", "left")
    found, status = F.coalesce("_found", F.lit(False)), F.col("_status")
    ok = F.coalesce(status.between(200, 299), F.lit(False))
    old = F.col("created_at") < now - F.expr("INTERVAL 10 MINUTES")
    action = (
        F.when(~found, F.when(old, "lost").otherwise("wait"))
        .when(ok, "accepted").when(F.col("attempt") < max_attempts, "retry").otherwise("alert")
    )
    detail = F.coalesce("error_msg", F.left("content", F.lit(200)), F.lit("no detail"))
    note = F.when(~found & old, "no response row found").when(found, F.coalesce("error_msg", F.left("content", F.lit(400))))
    alert = F.when(action == "alert", F.concat(F.lit(f"dispatch failed after {max_attempts} attempts: HTTP "), F.coalesce(status.cast("string"), F.lit("none")), F.lit(" - "), detail))
    return j.select("id", "request_id", "attempt", action.alias("action"), (action != "wait").alias("checked"), status.alias("status_code"), note.alias("note"), alert.alias("alert"))
