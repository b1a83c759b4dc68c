"""Recurrence ranking, leaderboards and shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.scoring import SCORE_VERSION, SINGLE_SHOT, recurrence_score, set_size
from signalmill.functions.times import recent

# How many cards each list reads and shows.
RECURRING_POOL, RECURRING, SINGLE_POOL, SINGLE, SHORTLIST = 50, 5, 30, 3, 40


def features(clusters: DataFrame, now: Column) -> DataFrame:
    return clusters.withColumns({
        "n_sources": set_size(F.col("sources_seen")), "n_days": set_size(F.col("days_seen")), "n_mentions": F.coalesce(F.col("mention_count"), F.lit(0)),
        "recent": recent(F.col("last_seen"), now),
    })


def score_clusters(clusters: DataFrame, now: Column) -> DataFrame:
    """Clusters with score and score_version."""
    f = features(clusters, now)
    return f.withColumns({"score": recurrence_score(F.col("n_sources"), F.col("n_days"), F.col("n_mentions"), F.col("recent")), "score_version": F.lit(SCORE_VERSION)})


def visible() -> Column:
    """Not muted, and not pinned unless it came up again since."""
    again = F.coalesce(F.col("mention_count"), F.lit(0)) > F.coalesce(F.col("pinned_mention_count"), F.lit(0))
    return ~F.coalesce(F.col("muted"), F.lit(False)) & (~F.coalesce(F.col("pinned"), F.lit(False)) | again)


def new_this_week(days_seen: Column, today: Column) -> Column:
    """Days seen from seven days ago on, eight calendar days."""
    return F.when(days_seen.isNull(), 0).otherwise(F.size(F.filter(days_seen, lambda d: d >= F.date_sub(today, 7))))


def _top(clusters: DataFrame, order: list, pool: int, keep: Column, n: int) -> DataFrame:
    """The first ``n`` of the ``pool`` first that meet ``keep``, with their rank; the filter stays above the limit."""
    pooled = clusters.orderBy(*order).limit(pool).where(keep)
    return pooled.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= n)


def recurring(clusters: DataFrame) -> DataFrame:
    """The recurring leaderboard; clusters without score lead, as a descending sort with nulls first has it."""
    order = [F.col("score").desc_nulls_first(), F.col("id")]
    return _top(clusters.where("muted = false"), order, RECURRING_POOL, visible() & ~F.col("kind").isin(*SINGLE_SHOT), RECURRING)


def single_shot(clusters: DataFrame) -> DataFrame:
    """The latest clusters of the kinds that count once."""
    order = [F.col("last_seen").desc_nulls_first(), F.col("id")]
    return _top(clusters.where("muted = false").where(F.col("kind").isin(*SINGLE_SHOT)), order, SINGLE_POOL, visible(), SINGLE)


def shortlist(clusters: DataFrame, n: int = SHORTLIST) -> DataFrame:
    """Of the ``n`` best unmuted clusters those that recur and are of no single-shot kind."""
    order = [F.col("score").desc_nulls_first(), F.col("id")]
    keep = ~F.col("kind").isin(*SINGLE_SHOT) & (F.coalesce(F.col("mention_count"), F.lit(0)) > 1)
    return _top(clusters.where("muted = false"), order, n, keep, n)


def shortlist_line() -> Column:
    """A shortlist row as text."""
    count = lambda c: set_size(F.col(c)).cast("string")
    return F.concat(
        F.lit("- "), F.col("canonical_statement"), F.lit(" ("), F.col("kind"), F.lit(") — "), F.col("mention_count").cast("string"), F.lit(" mentions, "), count("sources_seen"),
        F.lit(" sources, "), count("days_seen"), F.lit(" days, last seen "), F.coalesce(F.date_format("last_seen", "yyyy-MM-dd"), F.lit("")),
    )


def top_findings(findings: DataFrame, n: int) -> DataFrame:
    """Each cluster's ``n`` most confident findings with their rank, equals by id; null confidence leads a descending sort."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("confidence").desc_nulls_first(), "id"))
    return findings.where("cluster_id is not null").withColumn("rank", rank).where(F.col("rank") <= n)


def with_evidence(clusters: DataFrame, findings: DataFrame, items: DataFrame) -> DataFrame:
    """Clusters with why, quote and url of their most confident finding."""
    best = top_findings(findings, 1).select("cluster_id", F.col("why_it_matters").alias("why"), F.col("evidence_quote").alias("quote"), "item_id")
    url = items.select(F.col("id").alias("item_id"), "url")
    return clusters.join(best.join(url, "item_id", "left").drop("item_id"), F.col("id") == F.col("cluster_id"), "left").drop("cluster_id")
