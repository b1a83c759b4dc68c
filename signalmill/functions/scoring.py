"""Scores, quotas and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score's name and the kinds that count once only.
SCORE_VERSION = "v1-recurrence"
SINGLE_SHOT = ("research", "read")


def recurrence_score(sources: Column, days: Column, mentions: Column, recent: Column) -> Column:
    return sources * 2.0 + days * 1.5 + F.log2(mentions + F.lit(1.0)) + F.when(recent, 2.0).otherwise(0.0)


def set_size(values: Column) -> Column:
    """Number of elements, 0 for null."""
    return F.when(values.isNull(), 0).otherwise(F.size(values))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 for nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def per_source_quota(n: int, share: float) -> int:
    """How many of ``n`` places one source may take at first: at least one, the fraction cut off."""
    return max(1, int(n * share))


def cap_for_thread(taken: Column, wanted: Column, cap: int = 2) -> Column:
    """How many of an item's findings its thread still has room for."""
    return F.greatest(F.lit(0), F.least(wanted, F.lit(cap) - taken))


def feature_snapshot(cluster_kind: Column, sources_seen: Column, days_seen: Column, mention_count: Column, recent: Column) -> Column:
    """What is logged with feedback; the names are a contract."""
    return F.struct(
        set_size(sources_seen).alias("n_sources"), set_size(days_seen).alias("n_days"), F.coalesce(mention_count, F.lit(0)).alias("mention_count"),
        recent.alias("recent"), cluster_kind.alias("kind"),
    )
