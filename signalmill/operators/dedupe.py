"""Structural deduplication: fetched items become ready or duplicate, with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.functions.text import link_only, too_short

#: States whose hashes count as accepted; failed and duplicate items do not hold theirs.
ACCEPTED = ("ready", "processing", "done")


def decide(items: DataFrame) -> DataFrame:
    """id, state, reason of the fetched items: too_short, link_only, content_hash or ready, in that order.

    The first eligible item of a hash by id is ready, unless an accepted item holds the hash. Items without a hash never
    match one.
    """
    text = F.col("raw_text")
    fetched = items.where("state = 'fetched'").select("id", "content_hash", F.when(too_short(text), "too_short").when(link_only(text), "link_only").alias("junk"))
    hashed = F.coalesce(F.col("content_hash"), F.lit("")) != ""
    eligible = fetched.where(F.col("junk").isNull() & hashed)
    held = items.where(F.col("state").isin(*ACCEPTED) & hashed).select("content_hash").distinct()
    # A plain aggregate with map-side combine names the first of each hash; a hot hash is one row a task.
    first = eligible.join(held, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    reason = F.coalesce(F.col("junk"), F.when(hashed & F.col("first").isNull(), "content_hash"), F.lit("ready"))
    out = fetched.join(first, "id", "left").withColumn("reason", reason)
    return out.select("id", F.when(F.col("reason") == "ready", "ready").otherwise("duplicate").alias("state"), "reason")


def summary(decided: DataFrame) -> DataFrame:
    """Totals of a run by reason and state."""
    return decided.groupBy("state", "reason").agg(F.count(F.lit(1)).alias("n"))
