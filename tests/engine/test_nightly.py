import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from signalmill.operators import models, rendering, threads
from signalmill.plans import nightly
from signalmill.schema import FETCHED, STATES, TABLES, bootstrap


def fetched(spark, n, start=0):
    from signalmill.functions.text import content_hash

    rows = [("hackernews" if i % 3 else "github", str(i), f"http://x/{i}", f"Training run number {i} is slow because loaders stall. The rest of the text goes on for a while {i}.", 1000 + i, f"t{i % 4}" if i % 2 else None) for i in range(start, start + n)]
    d = spark.createDataFrame(rows, "source string, source_id string, url string, raw_text string, created_at_i long, thread_id string")
    return d.select("source", "source_id", "url", "raw_text", content_hash(F.col("raw_text")).alias("content_hash"), "created_at_i", "thread_id", F.lit(None).cast("string").alias("metadata"))


def test_two_nights(spark, tmp_path):
    state = nightly.State(spark, str(tmp_path))
    one = nightly.run(state, fetched(spark, 30), "2024-01-30 03:00:00", clock=lambda: 0.0)
    items = one.read("items").collect()
    assert sorted(r.id for r in items) == list(range(1, 31)) and {r.state for r in items} <= set(STATES) and all(r.raw_text is None for r in items if r.state == "done")
    findings, clusters = one.read("findings").collect(), one.read("clusters").collect()
    assert findings and sorted(r.id for r in findings) == list(range(1, len(findings) + 1)) and {f.cluster_id for f in findings} == {c.id for c in clusters}
    per_thread = {}
    thread = {r.id: r.thread_id or f"_item:{r.id}" for r in items}
    for f in findings:
        per_thread[thread[f.item_id]] = per_thread.get(thread[f.item_id], 0) + 1
    assert max(per_thread.values()) <= 2
    counted = {c.id: c.mention_count for c in clusters}
    mentions = one.read("mentions").collect()
    assert counted == {c: sum(m.cluster_id == c for m in mentions) for c in counted}
    two = nightly.run(one, fetched(spark, 30, 20), "2024-01-31 03:00:00", clock=lambda: 0.0)
    assert two.read("items").count() == 50 and two.read("runs").count() == 2 and one.read("items").count() == 30
    again = nightly.run(one, fetched(spark, 30, 20), "2024-01-31 03:00:00", clock=lambda: 0.0)
    for table in ("items", "findings", "clusters", "mentions"):
        assert sorted(map(str, again.read(table).collect())) == sorted(map(str, two.read(table).collect())), "a run repeated after a crash changes nothing"
    md = nightly.digest(two, F.lit("2024-01-31 04:00:00").cast("timestamp"), nightly.Parameters(), nightly.offline_synthesis)
    assert md.startswith("# 31 January 2024\n\nOffline briefing.\n\n## ") and "[source](http://x/" in md
    sources = spark.createDataFrame([("github", None, True), ("rss", None, False)], "name string, last_successful_fetch_at timestamp, enabled boolean")
    status = nightly.status(two, sources, F.lit("2024-01-31 04:00:00").cast("timestamp"))
    assert status["states"].count() == 6 and status["last_run"].first().footer.startswith("last run 60m ago")


def test_empty_night_and_failing_model(spark, tmp_path):
    none = nightly.run(nightly.State(spark, str(tmp_path / "a")), spark.createDataFrame([], FETCHED), "2024-01-30 03:00:00")
    assert none.read("items").count() == 0 and none.read("clusters").count() == 0
    bad = nightly.run(nightly.State(spark, str(tmp_path / "b")), fetched(spark, 3), "2024-01-30 03:00:00", nightly.Models(reader=lambda t: "not json"))
    assert {r.state for r in bad.read("items").collect()} == {"failed"} and bad.read("findings").count() == 0

    def broken(_):
        raise ValueError("broken")

    state = nightly.State(spark, str(tmp_path / "c"))
    with pytest.raises(Exception, match="broken"):
        nightly.run(state, fetched(spark, 3), "2024-01-30 03:00:00", nightly.Models(reader=broken))
    assert nightly.State.latest(spark, str(tmp_path / "c")).version == 0


def answer(kinds=1):
    return json.dumps([{"kind": "pain", "statement": f"s{k}", "why_it_matters": "", "domain": "", "evidence_quote": "", "confidence": 0.5} for k in range(kinds)])


def counting(folder, name, reply):
    """A model that leaves a line in a file for each call, as its calls are made in other processes."""

    def model(text):
        with open(f"{folder}/{name}", "a") as f:
            f.write(text[:40].replace("\n", " ") + "\n")
        return reply

    return model


def test_models_are_asked_once_an_item_and_full_threads_never(spark, tmp_path):
    calls = lambda name: len(open(tmp_path / name).read().splitlines())
    lone = fetched(spark, 20).withColumn("thread_id", F.lit(None).cast("string"))
    m = nightly.Models(triage=counting(tmp_path, "triage", '{"worth_reading": true}'), reader=counting(tmp_path, "read", answer()))
    night = nightly.run(nightly.State(spark, str(tmp_path / "a")), lone, "2024-01-30 03:00:00", m, nightly.Parameters(wave=7))
    assert calls("triage") == calls("read") == 20 and night.read("findings").count() == 20 and {r.state for r in night.read("items").collect()} == {"done"}
    one = fetched(spark, 20).withColumn("thread_id", F.lit("t"))
    m = nightly.Models(triage=counting(tmp_path, "triage2", '{"worth_reading": true}'), reader=counting(tmp_path, "read2", answer()))
    night = nightly.run(nightly.State(spark, str(tmp_path / "b")), one, "2024-01-30 03:00:00", m, nightly.Parameters(wave=7))
    assert calls("triage2") == calls("read2") == 2 and night.read("findings").count() == 2 and {r.state for r in night.read("items").collect()} == {"done"}
    m = nightly.Models(triage=counting(tmp_path, "triage3", '{"worth_reading": false}'), reader=counting(tmp_path, "read3", answer(3)))
    night = nightly.run(nightly.State(spark, str(tmp_path / "c")), lone, "2024-01-30 03:00:00", m, nightly.Parameters(max_items=9, wave=4))
    states = sorted(r.state for r in night.read("items").collect())
    assert calls("triage3") == 9 and not (tmp_path / "read3").exists() and states == ["done"] * 9 + ["ready"] * 11
    sources = {r.source for r in night.read("items").where("state = 'done'").collect()}
    assert sources == {"github", "hackernews"}, "turns go round the sources"


def test_waves_are_few_and_keep_the_order_of_one(spark, tmp_path):
    waves = lambda night: len(list(Path(night).glob("stages/waves/*/log/wave=*")))
    said = answer()
    m = nightly.Models(triage=lambda t: '{"worth_reading": true}', reader=lambda t: said)
    lone = fetched(spark, 40).withColumn("thread_id", F.lit(None).cast("string"))
    night = lambda name, **p: nightly.run(nightly.State(spark, str(tmp_path / name)), lone, "2024-01-30 03:00:00", m, nightly.Parameters(**p))
    read = lambda state: [r.item_id for r in state.read("findings").orderBy("id").collect()]
    once, many, timed = read(night("a", wave=40)), read(night("b", wave=3)), night("c", wave=16, max_seconds=1e9)
    assert len(once) == 40 and many == once, "a wave ends inside a cycle and the next one goes on there"
    assert (waves(tmp_path / "a"), waves(tmp_path / "b"), waves(tmp_path / "c")) == (1, 5, 3), "3, 3, 6, 12, 16; a limit of time keeps waves as they are"
    assert read(timed) == once


def test_silent_host_ends_the_run_and_blips_do_not(spark, tmp_path):
    def silent(_):
        raise models.TransportError("no answer")

    with pytest.raises(nightly.Aborted) as e:
        nightly.run(nightly.State(spark, str(tmp_path / "a")), fetched(spark, 20), "2024-01-30 03:00:00", nightly.Models(triage=silent))
    after = nightly.State.latest(spark, str(tmp_path / "a"))
    assert after.version == e.value.state.version == 1 and {r.state for r in after.read("items").collect()} == {"ready"}
    row = after.read("runs").first()
    assert row.errors == ["judge: the model host stayed silent"] and row.finished_at is None

    def one_blip(text):
        if "number 3 " in text:
            raise models.TransportError("no answer")
        return '{"worth_reading": false}'

    night = nightly.run(nightly.State(spark, str(tmp_path / "b")), fetched(spark, 8), "2024-01-30 03:00:00", nightly.Models(triage=one_blip))
    items = {r.source_id: (r.state, r.attempts) for r in night.read("items").collect()}
    assert items.pop("3") == ("failed", 3) and {v for v in items.values()} == {("done", 1)}


def test_fetching_watermarks_preflight_and_pointer(spark, tmp_path):
    def reader_of(source):
        def good(spark, source, since, until):
            assert since == 1704067200 if source["name"] == "new" else since > 0
            return fetched(spark, 4).withColumn("source", F.lit(source["name"]))

        def bad(*_):
            raise OSError("down\nfor good")

        return bad if source["name"] == "bad" else good

    root = str(tmp_path / "a")
    rows = [("bad", "x", "{}", None, None, True, None), ("new", "x", "{}", None, None, True, None), ("off", "x", "{}", None, None, False, None)]
    nightly.State(spark, root).write("sources", spark.createDataFrame(rows, TABLES["sources"]), 1)
    for t in TABLES:
        if t != "sources":
            nightly.State(spark, root).write(t, spark.createDataFrame([], TABLES[t]), 1)
    nightly.State(spark, root).completed(1)
    with pytest.raises(nightly.PreflightError, match="b"):
        nightly.run(nightly.State.latest(spark, root), None, "2024-01-31 00:00:00", nightly.Models(required=frozenset("ab"), listed=lambda: {"a"}), reader_of=reader_of)
    assert nightly.State.latest(spark, root).version == 1
    night = nightly.run(nightly.State.latest(spark, root), None, "2024-01-31 00:00:00", nightly.Models(required=frozenset("a"), listed=lambda: {"a"}), synthesis=nightly.offline_synthesis, digests=str(tmp_path / "digests"), reader_of=reader_of)
    marks = {r.name: r.last_successful_fetch_at for r in night.read("sources").collect()}
    assert str(marks["new"]) == "2024-01-31 00:00:00" and marks["bad"] is None and marks["off"] is None
    run = night.read("runs").first()
    assert run.items_fetched == 4 and run.errors == ["bad: OSError: down"] and night.read("items").count() == 4
    assert (tmp_path / "digests" / "2024-01-31.md").read_text().startswith("# 31 January 2024\n") and nightly.State.latest(spark, root).version == 2


def test_failing_stages_lose_nothing(spark, tmp_path):
    def no_vectors(_):
        raise ValueError("no vectors")

    state = nightly.State(spark, str(tmp_path / "a"))
    one = nightly.run(state, fetched(spark, 12), "2024-01-30 03:00:00", nightly.Models(embedder=no_vectors))
    n = one.read("findings").count()
    assert n and one.read("clusters").count() == 0 and one.read("runs").first().errors[0].startswith("embed: ")
    two = nightly.run(one, spark.createDataFrame([], FETCHED), "2024-01-31 03:00:00")
    assert two.read("findings").where("cluster_id is not null").count() == n and two.read("clusters").count() > 0, "the next night takes up what was left"


def test_discussions_reach_the_reader(spark, tmp_path):
    def thread(story):
        if story == "t1":
            return {"title": "T", "text": None, "children": [{"author": "ann", "text": "<p>first", "children": [{"author": "bob", "text": "deeper", "children": [None, 3]}]}, {"author": None, "text": "second"}]}
        raise OSError("gone")

    m = nightly.Models(triage=lambda t: '{"worth_reading": true}', reader=counting(tmp_path, "seen", "[]"), thread=thread)
    nightly.run(nightly.State(spark, str(tmp_path / "a")), fetched(spark, 2), "2024-01-30 03:00:00", m)
    assert sorted(open(tmp_path / "seen").read().splitlines())[1].startswith("[Discussion around the item")
    stories = spark.createDataFrame([("t1",), ("t2",)], "thread string")
    assert [(r.thread, r.context) for r in threads.live_contexts(stories, thread).collect()] == [("t1", "Story: T\n\nComments:\n\n- ann: first\n\n- someone: second\n\n- bob: deeper")]
    deep = spark.createDataFrame([("t", k, k - 1 if k else None, 0, "a", f"c{k}") for k in range(12)] + [("t", 50, 51, 0, "a", "loop"), ("t", 51, 50, 0, "a", "loop")], "thread string, node long, parent long, ord long, author string, text string")
    assert sorted(r.depth for r in threads.walk(deep).collect()) == list(range(12)), "any depth; loops are out of reach"


def test_why_text(spark):
    c = spark.createDataFrame([(7, "pain", "slow", 2.55, 3)], "id long, kind string, canonical_statement string, score double, mention_count int")
    f = spark.createDataFrame([(1, 1, 7, "q1", 0.2), (2, 2, 7, "", 0.9), (3, None, 8, "x", 0.9)], "id long, item_id long, cluster_id long, evidence_quote string, confidence double")
    i = spark.createDataFrame([(1, "http://u"), (2, None)], "id long, url string")
    assert rendering.why_text(c, f, i, 7).first().text == '*#7 — slow*\n_pain · score 2.6 · 3 mentions_\n\n• "(no quote)"\n• "q1"\n  http://u'
    assert rendering.why_text(c, f, i, 9).first().text == "No cluster #9."


def test_bootstrap(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS engine_test")
    for t in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS engine_test.{t}")
    assert set(bootstrap(spark, "engine_test")) == set(TABLES) and bootstrap(spark, "engine_test") == []
    spark.sql("DROP DATABASE engine_test CASCADE")


def test_readers_get_texts_in_batches_of_bounded_size(spark):
    said = json.loads(answer())[0]

    def rows_at_hand(_):
        frame = sys._getframe()
        while "texts" not in frame.f_locals:
            frame = frame.f_back
        return json.dumps([said | {"statement": str(len(frame.f_locals["texts"]))}])

    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        texts = spark.range(0, 200, 1, 1).select("id", F.repeat(F.lit("many words "), 10_000).alias("raw_text"))
        read = models.deep_read(texts, rows_at_hand).select(F.col("findings")[0]["statement"].cast("int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", limit)
    assert len(read) == 200 and max(r.n for r in read) <= 40, "4 MB of texts of 110 kB, not all 200"
