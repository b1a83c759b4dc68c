
import pathlib

import numpy as np
import pytest

from signalmill.operators import clusters
from signalmill.streaming import incremental as I

SCHEMA = "source string, source_id string, url string, created_at_i long"


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def test_overlapping_batches_and_a_restart_lose_and_double_nothing(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run():
        q = I.insert_stream(spark.readStream.schema(SCHEMA).json(src), out, check).trigger(availableNow=True).start()
        q.awaitTermination()

    land(spark, src, [("a", "1", "u", 1), ("a", "1", "v", 1), ("a", "2", "u", 2)])
    run()
    land(spark, src, [("a", "2", "late", 2), ("a", "3", "u", 3), ("b", "1", "u", 1)])
    # A run that died after writing but before committing leaves its folder; the replayed batch replaces it.
    spark.createDataFrame([("a", "3", "half", 3)], SCHEMA).write.mode("overwrite").parquet(f"{out}/batch=1")
    run()
    got = sorted((r.source, r.source_id, r.url) for r in spark.read.parquet(out).collect())
    assert got == [("a", "1", "u"), ("a", "2", "u"), ("a", "3", "u"), ("b", "1", "u")]


@pytest.fixture
def entries(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")
    before = {n: spark.conf.get(n, None) for n in names}
    I.use_entries(spark)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def cluster_run(spark, src, check, got):
    """One run of the stream over what is new, and the bytes that its state wrote."""
    s = I.cluster_stream(spark.readStream.schema("id long, kind string, statement string, embedding array<double>").json(src), 0.9, 0.75)
    before = {f for f in pathlib.Path(check).rglob("*") if f.is_file()}
    q = s.writeStream.outputMode("append").foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(f.stat().st_size for f in pathlib.Path(check).rglob("*.changelog") if f not in before)


def test_stateful_clusters_continue_across_batches(spark, tmp_path, entries):
    src, check = str(tmp_path / "in"), str(tmp_path / "check")
    schema = "id long, kind string, statement string, embedding array<double>"
    got = []
    for rows in ([(1, "k", "s", [1.0, 0.0]), (2, "k", "s", [0.0, 1.0])], [(3, "k", "s", [0.99, 0.05]), (4, "j", "s", [1.0, 0.0])]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        cluster_run(spark, src, check, got)
    assert sorted((r.id, r.cluster_key, r.action) for r in got) == [(1, 1, "new"), (2, 2, "new"), (3, 1, "merge"), (4, 4, "new")]


def test_the_stream_is_the_batch_fold_and_writes_what_a_batch_founds(spark, tmp_path, entries):
    src, check, rng = str(tmp_path / "in"), str(tmp_path / "check"), np.random.default_rng(6)
    schema = "id long, kind string, statement string, embedding array<double>"
    rows = [(i, "k" if i % 4 else "j", "s", rng.normal(size=24).tolist()) for i in range(1, 401)]
    rows += [(i, "k", "s", (np.array(rows[i % 300][3]) * 2).tolist()) for i in range(401, 421)]
    got, wrote = [], []
    for part in (rows[:200], rows[200:390], rows[390:400], rows[400:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(src)
        wrote.append(cluster_run(spark, src, check, got))
    none = spark.createDataFrame([], "id long, kind string, canonical_statement string, centroid array<double>")
    batch = clusters.greedy(spark.createDataFrame(rows, schema), none, 0.9, 0.75).collect()
    assert {r.id: (abs(r.cluster_key), r.action) for r in batch} == {r.id: (r.cluster_key, r.action) for r in got}
    # Ten founders after 390 cost a fraction of 190 after 200; twenty findings that only join cost nothing for centroids.
    assert wrote[1] > 0 and wrote[2] < wrote[1] / 4 and wrote[3] < wrote[1] / 10


def test_claims_are_released_when_their_hour_ends(spark, tmp_path, entries):
    """The watermark is the clock; runs are restarts that go on from the checkpoint."""
    src, check, got = str(tmp_path / "in"), str(tmp_path / "check"), []

    def run(*rows):
        spark.createDataFrame(rows, "id long, event string, attempts int, at string").coalesce(1).write.mode("append").json(src)
        claims = spark.readStream.schema("id long, event string, attempts int, at timestamp").json(src).withWatermark("at", "0 seconds")
        q = I.release_stream(claims, clock="EventTime").writeStream.outputMode("append").foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        out = sorted((r.id, r.state, r.attempts) for r in got)
        got.clear()
        return out

    claimed = lambda i, n, at: (i, "claimed", n, f"2024-01-01T{at}Z")
    tick = lambda at: (-1, "tick", None, f"2024-01-01T{at}Z")
    assert run(claimed(1, 1, "10:00:00"), claimed(2, 3, "10:00:00"), claimed(3, 1, "10:00:00"), claimed(4, 2, "10:00:01")) == []
    assert run((3, "done", None, "2024-01-01T10:30:00Z"), claimed(4, 3, "10:40:00"), tick("11:00:00")) == []
    # More than an hour: the first two, not the third that was done, nor the fourth that was claimed again.
    assert run(tick("11:00:01")) == [(1, "ready", 1), (2, "failed", 3)]
    assert run(claimed(1, 2, "11:10:00"), tick("11:39:59")) == []
    assert run(tick("13:00:00")) == [(1, "ready", 2), (4, "failed", 3)] and run(tick("15:00:00")) == []


def test_mentions_and_items_are_new_once(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "a", "2024-01-01", "2024-01-01 10:00:00"), (1, "a", "2024-01-01", "2024-01-01 11:00:00"), (1, "b", "2024-01-01", "2024-01-01 10:00:00")]
    spark.createDataFrame(rows, "cluster_id long, source string, seen_on string, event_time string").coalesce(1).write.json(src)
    stream = spark.readStream.schema("cluster_id long, source string, seen_on string, event_time timestamp").json(src)
    got = []
    I.mention_stream(stream).writeStream.foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.cluster_id, r.source) for r in got) == [(1, "a"), (1, "b")]


def test_decisions_per_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    long = "x" * 50
    schema = "id long, content_hash string, raw_text string"
    spark.createDataFrame([(1, "h", long), (2, "g", long), (3, "g", long)], schema).coalesce(1).write.json(src)
    known = lambda: spark.createDataFrame([(0, "h", None, "done")], schema + ", state string")
    got = []
    I.decide_stream(spark.readStream.schema(schema).json(src), known, lambda d, i: got.extend(d.collect()), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.reason for r in got} == {1: "content_hash", 2: "ready", 3: "content_hash"}


def test_repeated_items_pass_a_stream_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "source string, source_id string, event_time timestamp"

    def run(rows):
        spark.createDataFrame(rows, "source string, source_id string, event_time string").coalesce(1).write.mode("append").json(src)
        s = I.deduped_stream(spark.readStream.schema(schema).json(src))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    run([("a", "1", "2024-01-01T00:00:00Z"), ("a", "1", "2024-01-02T00:00:00Z"), ("a", "2", "2024-01-01T00:00:00Z")])
    run([("a", "1", "2024-01-03T00:00:00Z"), ("b", "1", "2024-01-03T00:00:00Z")])
    assert sorted((r.source, r.source_id) for r in spark.read.schema(schema).parquet(out).collect()) == [("a", "1"), ("a", "2"), ("b", "1")]
