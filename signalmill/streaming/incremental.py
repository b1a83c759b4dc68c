"""The incremental side: fetched items and mentions as streams.

A source's "watermark" is its high-water mark, kept by the stream's checkpoint; late data come by re-reading an overlap,
and keys make that harmless. Clusters grow with the stream in a stateful operator keyed by kind, one entry a founder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from signalmill.operators import dedupe, tables
from signalmill.operators.clusters import Fold, never_the_same
from signalmill.operators.queue import MAX_ATTEMPTS, STUCK_SECONDS


def insert_stream(fetched: DataFrame, root: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """Append each micro-batch's new (source, source_id) to ``root``; one folder a batch, so a replayed batch replaces itself.

    ``then`` gets a batch's new rows as they were written. The source's offset is committed after it returns; a batch whose
    ``then`` fails is fetched and handed over again, so it should write what it makes of a batch under the batch's number.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _earlier(spark, root, batch_id, batch.schema)
        fresh = tables.insert_ignore(done, batch, ["source", "source_id"], [F.col("created_at_i"), F.col("url")])
        fresh.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        if then is not None:
            then(spark.read.schema(batch.schema).parquet(f"{root}/batch={batch_id}"), batch_id)

    return fetched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _earlier(spark, root: str, batch_id: int, schema) -> DataFrame:
    """What earlier batches wrote; the batch's own folder, left by a run that died, is not part of it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path) or not any(s.isDirectory() and s.getPath().getName().startswith("batch=") for s in files.listStatus(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).option("basePath", root).parquet(root).where(F.col("batch") < batch_id).drop("batch")


def deduped_stream(fetched: DataFrame, delay: str = "7 days", time: str = "event_time") -> DataFrame:
    """Items whose (source, source_id) was not seen within the delay: bounded state for endless streams."""
    return fetched.withWatermark(time, delay).dropDuplicatesWithinWatermark(["source", "source_id"])


def decide_stream(items: DataFrame, accepted: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Structural decisions per micro-batch against the items accepted so far."""

    def write(batch: DataFrame, batch_id: int) -> None:
        known = accepted()
        together = known.select("id", "content_hash", "raw_text", "state").unionByName(batch.select("id", "content_hash", "raw_text", F.lit("fetched").alias("state")))
        sink(dedupe.decide(together), batch_id)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def mention_stream(mentions: DataFrame, delay: str = "2 days", time: str = "event_time") -> DataFrame:
    """New mentions only: the first of each (cluster_id, source, seen_on) within the delay."""
    return mentions.withWatermark(time, delay).dropDuplicatesWithinWatermark(["cluster_id", "source", "seen_on"])


class Clusters(StatefulProcessor):
    """The clusters of a kind: a list with one entry a founder, in the order they were founded.

    A batch reads the list once and appends what it founds, so what is written follows the batch, not the state.
    """

    def __init__(self, merge: float, low: float, same: Callable[[str, str], bool]):
        self.merge, self.low, self.same = merge, low, same

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.founders = handle.getListState("founders", "key long, text string, centroid array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold = Fold(key[0], self.merge, self.low, self.same)
        for founder, text, centroid in self.founders.get():
            fold.add(founder, text, np.asarray(centroid))
        known, got = len(fold.keys), []
        for r in pd.concat(list(rows)).sort_values("id").itertuples():
            v = np.asarray(r.embedding, dtype=np.float64)
            target, _, action, merged = fold.place(int(r.id), r.statement or "", v / (np.linalg.norm(v) or 1))
            if not merged:
                # Streams name a cluster by the finding that founded it.
                fold.keys[-1] = target = int(r.id)
            got.append((int(r.id), key[0], target, action))
        if len(fold.keys) > known:
            self.founders.appendList([(fold.keys[i], fold.texts[i], fold.centroids[i].tolist()) for i in range(known, len(fold.keys))])
        yield pd.DataFrame(got, columns=["id", "kind", "cluster_key", "action"])

    def close(self) -> None:
        return


def cluster_stream(findings: DataFrame, merge: float = 0.90, low: float = 0.75, same: Callable[[str, str], bool] = never_the_same) -> DataFrame:
    """id, kind, cluster_key, action of findings (id, kind, statement, embedding); founders are the state of their kind.

    A micro-batch's findings of a kind are folded in id order, as the batch operator does. The session needs the RocksDB
    state store, whose change log and files hold single entries (``use_entries``).
    """
    out = "id long, kind string, cluster_key long, action string"
    return findings.groupBy("kind").transformWithStateInPandas(Clusters(merge, low, same), out, "Append", "None")


class Claims(StatefulProcessor):
    """An item in work and the timer that ends its hour: a value with its attempts and when it is due."""

    def __init__(self, stuck_seconds: int, max_attempts: int):
        self.stuck_ms, self.max_attempts = stuck_seconds * 1000, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "attempts int, due long")

    def _forget(self) -> None:
        if self.claim.exists():
            self.handle.deleteTimer(self.claim.get()[1])
            self.claim.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of one instant the end of a claim comes before the next claim.
        for r in pd.concat(list(rows)).assign(_c=lambda d: d.event == "claimed").sort_values(["at", "_c"]).itertuples():
            self._forget()
            if r.event == "claimed":
                # An item is stuck when more than its time has passed.
                due = int(r.at.value // 1_000_000) + self.stuck_ms + 1
                self.claim.update((int(r.attempts), due))
                self.handle.registerTimer(due)
        yield pd.DataFrame(columns=["id", "state", "attempts", "due"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, due = self.claim.get()
        self.claim.clear()
        yield pd.DataFrame([(key[0], "failed" if attempts >= self.max_attempts else "ready", attempts, due)], columns=["id", "state", "attempts", "due"])

    def close(self) -> None:
        return


def release_stream(claims: DataFrame, stuck_seconds: int = STUCK_SECONDS, max_attempts: int = MAX_ATTEMPTS, clock: str = "ProcessingTime") -> DataFrame:
    """(id, state, attempts, due in ms) of items whose claim was not ended in time: ready again, or failed once their
    attempts are used up, when their hour ends and not at the next claim.

    ``claims`` has (id, event, attempts, at): "claimed" starts or renews an item's hour, any other event ends it. ``clock``
    "EventTime" takes the watermark of ``at`` as the time, for replays; rows with ids of no item may move it. The session needs
    the RocksDB state store (``use_entries``).
    """
    out = "id long, state string, attempts int, due long"
    return claims.groupBy("id").transformWithStateInPandas(Claims(stuck_seconds, max_attempts), out, "Append", clock)


def use_entries(spark: SparkSession) -> None:
    """Keep stream state in RocksDB with a change log, for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
