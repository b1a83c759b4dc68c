"""The work queue as state transitions, and the order and caps of judging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.scoring import cap_for_thread
from signalmill.functions.text import thread_key
from signalmill.functions.times import ago
from signalmill.operators.tables import rank_in_order, running_sum, set_where

# An item is stuck after an hour, dies after three attempts; five per source and cycle; two findings a thread.
STUCK_SECONDS, MAX_ATTEMPTS, PER_SOURCE, PER_THREAD, MAX_ERRORS = 3600, 3, 5, 2, 3


def stuck(now: Column, stuck_seconds: int = STUCK_SECONDS) -> Column:
    return (F.col("state") == "processing") & (F.col("processing_at") < ago(now, seconds=stuck_seconds))


def of_source(source: str | None) -> Column:
    return F.lit(True) if source is None else F.col("source") == source


def to_retire(now: Column, source: str | None = None, stuck_seconds: int = STUCK_SECONDS, max_attempts: int = MAX_ATTEMPTS) -> Column:
    return stuck(now, stuck_seconds) & (F.col("attempts") >= max_attempts) & of_source(source)


def claimable(now: Column, source: str | None = None, stuck_seconds: int = STUCK_SECONDS, max_attempts: int = MAX_ATTEMPTS) -> Column:
    open_ = (F.col("state") == "ready") | (stuck(now, stuck_seconds) & (F.col("attempts") < max_attempts))
    return open_ & of_source(source)


def claim_items(items: DataFrame, batch_size: int, now: Column, source: str | None = None, stuck_seconds: int = STUCK_SECONDS, max_attempts: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(next items, claimed items): dead ones fail, the oldest claimable ones start processing with one more attempt."""
    retired = set_where(items, to_retire(now, source, stuck_seconds, max_attempts), state="failed")
    oldest = retired.where(claimable(now, source, stuck_seconds, max_attempts)).orderBy("id").limit(batch_size).select(F.col("id").alias("_claimed"))
    after, claimed = _claimed(retired, oldest, now)
    return after.select(*items.columns), claimed.select(*items.columns)


def claim_in_turns(items: DataFrame, batch_size: int, now: Column, per_source: int = PER_SOURCE, stuck_seconds: int = STUCK_SECONDS, max_attempts: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """``claim_items`` with turns: ``per_source`` of each source in each cycle, sources by name, items by id. The claimed
    ones have their ``turn``, (cycle, source, number in the source)."""
    retired = set_where(items, to_retire(now, None, stuck_seconds, max_attempts), state="failed")
    open_ = in_turns(retired.where(claimable(now, None, stuck_seconds, max_attempts)), per_source)
    turn = F.struct("cycle", "source", "rn")
    first = open_.select(F.col("id").alias("_claimed"), turn.alias("turn")).orderBy("turn").limit(batch_size)
    after, claimed = _claimed(retired, first, now)
    return after.select(*items.columns), claimed.select(*items.columns, "turn")


def changes_of_claim(
    items: DataFrame, batch_size: int, now: Column, per_source: int = PER_SOURCE, stuck_seconds: int = STUCK_SECONDS, max_attempts: int = MAX_ATTEMPTS, turns: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(retired items, claimed items with their ``turn``), the rows that ``claim_in_turns`` changes and no others.

    With ``turns``, as ``numbered_turns`` gave them when the claims began, turns go on where the last claim ended; the
    batch, which may be large then, is told by numbers that are counted in parts, not by one task's sort.
    """
    retired = items.where(to_retire(now, None, stuck_seconds, max_attempts)).withColumn("state", F.lit("failed"))
    order = items.where(claimable(now, None, stuck_seconds, max_attempts)).select("id", "source")
    if turns is None:
        turn = F.struct("cycle", "source", "rn")
        first = in_turns(order, per_source).select(F.col("id").alias("_claimed"), turn.alias("turn")).orderBy("turn").limit(batch_size)
    else:
        left = turns.join(order.select("id"), "id").withColumn("_all", F.lit(0))
        numbered = rank_in_order(left, ["_all"], [F.col(f"turn.{c}") for c in ("cycle", "source", "rn")], "_place")
        first = numbered.where(F.col("_place") <= batch_size).select(F.col("id").alias("_claimed"), "turn")
    claimed = items.join(first, F.col("id") == F.col("_claimed"))
    return retired, claimed.withColumns({"state": F.lit("processing"), "processing_at": now, "attempts": F.col("attempts") + 1}).select(*items.columns, "turn")


def numbered_turns(items: DataFrame, now: Column, per_source: int = PER_SOURCE, stuck_seconds: int = STUCK_SECONDS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """id and ``turn`` of all claimable items."""
    order = items.where(claimable(now, None, stuck_seconds, max_attempts)).select("id", "source")
    return in_turns(order, per_source).select("id", F.struct("cycle", "source", "rn").alias("turn"))


def _claimed(items: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    marked = items.join(ids, F.col("id") == F.col("_claimed"), "left")
    hit = F.col("_claimed").isNotNull()
    after = set_where(marked, hit, state="processing", processing_at=now, attempts=F.col("attempts") + 1)
    return after, after.where(hit)


def mark(items: DataFrame, ids: DataFrame, state: str) -> DataFrame:
    """done, failed or ready (release, attempts kept) for the given ids; done items lose their text."""
    picked = ids.select(F.col("id").alias("_id")).distinct()
    marked = items.join(picked, F.col("id") == F.col("_id"), "left")
    values = {"state": state} | ({"raw_text": F.lit(None).cast("string")} if state == "done" else {})
    return set_where(marked, F.col("_id").isNotNull(), **values).select(*items.columns)


def after_model_error(items: DataFrame, ids: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Items whose model call failed: ready again, or failed once the attempts are used up."""
    picked = ids.select(F.col("id").alias("_id")).distinct()
    marked = items.join(picked, F.col("id") == F.col("_id"), "left")
    state = F.when(F.col("attempts") >= max_attempts, "failed").otherwise("ready")
    return set_where(marked, F.col("_id").isNotNull(), state=state).select(*items.columns)


def in_turns(items: DataFrame, per_source: int = PER_SOURCE) -> DataFrame:
    """Items with their number in their source and the cycle that this is in. A source may hold most items, so its numbers
    are counted in parts."""
    return rank_in_order(items, ["source"], [F.col("id")], "rn").withColumn("cycle", F.floor((F.col("rn") - 1) / per_source))


def fair_order(items: DataFrame, per_source: int = PER_SOURCE) -> DataFrame:
    """Ready items with their turn: cycles of ``per_source`` of each source, sources by name, items by id.

    The order over all is the caller's sort by (cycle, source, rn).
    """
    return in_turns(items.where("state = 'ready'"), per_source)


def capped_findings(findings: DataFrame, order: list[str], cap: int = PER_THREAD, qualify_source: bool = False) -> DataFrame:
    """The first ``cap`` findings of each thread in processing order."""
    key = thread_key(F.col("thread_id"), F.col("item_id"), F.col("source") if qualify_source else None)
    n = F.row_number().over(Window.partitionBy("thread_key").orderBy(*order))
    return findings.withColumn("thread_key", key).withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def retired_by_cap(judged: DataFrame, order: list[str], count: str, cap: int = PER_THREAD) -> DataFrame:
    """Judged items with the findings their thread had before, what they may add, and whether they were retired unread."""
    before = Window.partitionBy("thread_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = judged.withColumn("before", F.coalesce(F.sum(count).over(before), F.lit(0)))
    return out.withColumns({"allowed": cap_for_thread(F.col("before"), F.col(count), cap), "retired": F.col("before") >= cap})


def error_streaks(events: DataFrame, by: list[str], order: list[str], outcome: str = "outcome", limit: int = MAX_ERRORS) -> DataFrame:
    """Runs of consecutive "error" outcomes per ``by``, with whether they reach the limit; "success" ends a run, other
    outcomes neither count nor end it."""
    island = F.sum(F.when(F.col(outcome) == "success", 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    runs = events.withColumn("island", island).where(F.col(outcome) == "error").groupBy(*by, "island").agg(F.count(F.lit(1)).alias("errors"))
    return runs.withColumn("aborts", F.col("errors") >= limit)


def within_budget(judged: DataFrame, order: list[str], seconds: str | None = None, max_seconds: float | None = None, max_items: int | None = None) -> DataFrame:
    """The items judged before the budgets are used up; items with ``capped`` true cost no place. Sums run in parts."""
    names, by_order = judged.columns, [F.col(c) for c in order]
    every = judged.withColumn("_all", F.lit(0))
    if max_items is not None:
        every = running_sum(every, ["_all"], by_order, F.when(F.col("capped"), 0).otherwise(1).cast("long"), "_k").where(F.col("_k") < max_items).drop("_k")
    if max_seconds is not None:
        every = running_sum(every, ["_all"], by_order, F.col(seconds).cast("double"), "_s").where(F.col("_s") < max_seconds).drop("_s")
    return every.select(*names)
