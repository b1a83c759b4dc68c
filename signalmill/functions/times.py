"""Times as Column expressions; the clock is always a parameter. Sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_epoch(text: Column) -> Column:
    """Seconds of an ISO-8601 text, UTC where it names no zone; null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(F.trim(text)))


def rfc822_epoch(text: Column) -> Column:
    """Seconds of an RFC-822 date; null if it is none. The weekday is skipped, it carries nothing."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]+,\s*", ""), r"\s(GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(*[F.unix_timestamp(F.try_to_timestamp(bare, F.lit(f))) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss")])


def epoch(value: Column, iso: bool) -> Column:
    """A timestamp field as seconds: whole seconds, or ISO text."""
    return iso_epoch(value.cast("string")) if iso else F.try_to_number(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit("999999999999999")).cast("long")


def ago(now: Column, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    return now - F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds).cast("decimal(18,6)"))


def lower_bound(watermark: Column, now: Column, days: int = 30) -> Column:
    """Where fetching starts: the watermark, or ``days`` before now."""
    return F.coalesce(watermark, ago(now, days=days))


def in_window(ts: Column, since: Column, until: Column | None = None, overlap_hours: float = 0) -> Column:
    """since - overlap <= ts < until, in seconds."""
    low = ts >= since - F.lit(int(overlap_hours * 3600))
    return low if until is None else low & (until.isNull() | (ts < until))


def recent(last_seen: Column, now: Column, days: int = 7) -> Column:
    """Seen at most ``days`` ago, that instant included; null is not recent."""
    return F.coalesce(last_seen >= ago(now, days=days), F.lit(False))


def long_date(day: Column) -> Column:
    return F.date_format(day, "d MMMM yyyy")


def time_since(stamp: Column, now: Column) -> Column:
    """"5m ago" below two hours, else whole hours; "?" without a stamp."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(stamp)) / 60)
    return F.coalesce(F.when(minutes < 120, F.concat(minutes.cast("string"), F.lit("m ago"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))), F.lit("?"))
