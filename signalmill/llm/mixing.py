"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Each source has a weight; together they share ``share`` times all words. A source's target stops at ``cap`` times its own
size and what it leaves is shared again by weight among the others. A source is taken in complete epochs first; the rest
of its target, less than one epoch, is drawn: a document's key is -ln(u) / w, u uniform by a hash of the document and w its
quality weight, documents are taken by ascending key until the budget of words is used up, and the one at the edge is cut
there. So a source's words meet its target to less than one word, and heavier documents are likelier to be drawn.

Scale: one scan of the texts leaves a narrow table (size, key). Keys are sorted in two steps: a bucket is ln(key) times
``per_unit``, rounded down, and as -ln(u) / w has density 1 / e at most in ln(key) whatever w is, about 1 / (e *
per_unit) of a source's distinct documents share a bucket at most, however large the source is. Words a bucket are summed
with map-side combine, prefix sums over buckets (some thousands a source) find the bucket that holds the edge, and only this one
is sorted by rows. Everything before it is drawn, everything behind it is not. The draw depends on documents alone, so reruns and other partitionings agree.

Defined results: a null text has no words; words are what lies between space and the control characters 9 to 13; null
sources are one source and the last one in the order; sources without words have target 0; keys tie for rows that agree in
doc_id and text only, and of those it does not matter which one is cut; rows without doc_id are drawn by their text; weights
that are null, NaN or below ``LEAST_WEIGHT`` count as that; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.operators.tables import rank_in_order

from .common import arrow_map, materialize

LEAST_WEIGHT = 0.05
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LETTER = np.array([chr(c).isalpha() if c < 128 else c >= 0xC0 for c in range(256)])
_SOLID = ~_BLANK & ((np.arange(256) < 0x80) | (np.arange(256) >= 0xC0))


def measure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, quality weights) of texts without nulls, over the bytes of all of them at once.

    The weight is the share of letters, ASCII ones and every character beyond ASCII, among the characters that are not blank.
    """
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    blank = _BLANK[raw]
    begins = ~blank
    begins[1:] &= blank[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    begins[firsts] = ~blank[firsts]
    words, letters, solid = (np.diff(np.concatenate([[0], np.cumsum(hit)])[at]) for hit in (begins, _LETTER[raw], _SOLID[raw]))
    return words, letters / np.maximum(solid, 1)


def draw_keys(docs: DataFrame, weight: Column | None, per_unit: int) -> DataFrame:
    """doc_id, source, size, name, key and bucket of every document; the only step that reads texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(text)))
    measured = weight is None
    given = (F.lit(None) if measured else weight).cast("double")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), name.alias("name"), given.alias("w"), text.alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            words, share = measure(batch.column("text"))
            return {c: batch.column(c) for c in ("doc_id", "source", "name")} | {"size": words, "w": share if measured else batch.column("w")}

        return step

    counted = arrow_map(rows, make, "doc_id long, source string, name string, size long, w double")
    # 52 bits, so that u is a double strictly between 0 and 1.
    u = (F.conv(F.substring("name", 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    bare = F.coalesce(F.nanvl(F.col("w"), F.lit(0.0)), F.lit(0.0))
    keyed = counted.select("doc_id", "source", "size", "name", (-F.log(u) / F.greatest(bare, F.lit(LEAST_WEIGHT))).alias("key"))
    return keyed.withColumn("bucket", F.floor(F.log("key") * per_unit))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Sources (source, source_size) with their ``target``.

    Targets are min(cap * size, level * weight). The level is that of the sources that do not stop, until no further one is
    above its stop; every round is an aggregate of one row.
    """
    ranked = rank_in_order(sizes.withColumns({"_all": F.lit(0), "_null": F.col("source").isNull()}), ["_all"], [F.col("_null"), F.col("source")], "_rank", parts=8)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = materialize(ranked.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(float(cap))).alias("_most")), "mix-sources")
    all_ = rows.agg((F.sum("source_size") * F.lit(float(share))).alias("words"), F.sum("_w").alias("weights")).first()
    left, open_ = all_["words"] or 0.0, all_["weights"] or 0.0
    while True:
        stops = F.lit(left) * F.col("_w") >= F.col("_most") * F.lit(open_)
        gone = rows.where(stops).agg(F.coalesce(F.sum("_most"), F.lit(0.0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
        now = ((all_["words"] or 0.0) - gone[0], (all_["weights"] or 0.0) - gone[1])
        if now == (left, open_):
            break
        left, open_ = now
    target = F.when(stops, F.col("_most")).otherwise(F.col("_w") * F.lit(left) / F.lit(open_ or 1.0))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, weight: Column | None = None, per_unit: int = 256) -> DataFrame:
    """doc_id, source, size, source_size, target (the source's) and the words ``taken``, for each row of ``docs``.

    ``weight`` is a column of ``docs``, the quality weights of the draw; by default the share of letters (``measure``).
    """
    keyed = materialize(draw_keys(docs, weight, per_unit), "mix-keys")
    held = materialize(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    goals = targets(held.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    goals = materialize(goals.withColumnRenamed("source", "_source"), "mix-goals")
    # Words before each bucket; the edge is in the bucket that begins within the budget and ends beyond it.
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = held.withColumn("_upto", upto).join(goals, F.col("source").eqNullSafe(F.col("_source")))
    edge = found.where("_upto > budget and _upto - words <= budget").groupBy("_source").agg(F.min(F.struct("bucket", (F.col("_upto") - F.col("words")).alias("before"))).alias("edge"))
    plan = goals.join(edge.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of")), "left")
    plan = materialize(plan.select("_source", "source_size", "target", "epochs", "budget", "edge.bucket", "edge.before").withColumnRenamed("bucket", "_edge"), "mix-plan")
    rows = keyed.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    at_edge = F.coalesce(F.col("bucket") == F.col("_edge"), F.lit(False))
    # Without an edge the budget holds the whole source.
    clear = rows.where(~at_edge).withColumn("part", F.when(F.col("_edge").isNull() | (F.col("bucket") < F.col("_edge")), F.col("size")).otherwise(F.lit(0)))
    earlier = Window.partitionBy("source").orderBy("key", "name").rowsBetween(Window.unboundedPreceding, -1)
    drawn = rows.where(at_edge).withColumn("_before", F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    drawn = drawn.withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("budget") - F.col("_before"))))
    kept = ["doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")]
    return clear.select(*kept).unionByName(drawn.select(*kept))
