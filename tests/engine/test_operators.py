import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.operators import briefing, clusters, counts, dedupe, models, queue, ranking, rendering, tables, threads

NOW = None


@pytest.fixture(autouse=True)
def clock(spark):
    global NOW
    NOW = F.lit("2024-01-31 00:00:00").cast("timestamp")


def items(spark, rows):
    """rows: (id, source, state, attempts, minutes since processing began)."""
    d = spark.createDataFrame(rows, "id long, source string, state string, attempts int, age int")
    return d.select("id", "source", "state", "attempts", (NOW - F.make_dt_interval(mins=F.col("age"))).alias("processing_at"), F.lit("t").alias("raw_text"))


def test_dedupe_first_of_a_hash_and_states(spark):
    long = "x" * 50
    rows = [(1, long, "h1", "done"), (2, long, "h1", "fetched"), (3, long, "h2", "failed"), (4, long, "h2", "fetched"), (5, long, "h2", "fetched"), (6, "short", "h3", "fetched"), (7, long, "h3", "fetched"), (8, long, None, "fetched"), (9, long, "", "fetched"), (10, "https://a.example/" + long, "h9", "fetched")]
    got = {r.id: (r.state, r.reason) for r in dedupe.decide(spark.createDataFrame(rows, "id long, raw_text string, content_hash string, state string")).collect()}
    dup = lambda r: ("duplicate", r)
    ready = ("ready", "ready")
    assert got == {2: dup("content_hash"), 4: ready, 5: dup("content_hash"), 6: dup("too_short"), 7: ready, 8: ready, 9: ready, 10: dup("link_only")}


def test_claims_retire_reclaim_and_scope(spark):
    rows = [(1, "a", "processing", 3, 61), (2, "a", "processing", 1, 61), (3, "a", "processing", 1, 59), (4, "b", "ready", 0, 0), (5, "a", "ready", 2, 0), (6, "a", "done", 1, 0)]
    after, claimed = queue.claim_items(items(spark, rows), 2, NOW)
    state = {r.id: (r.state, r.attempts) for r in after.collect()}
    assert state == {1: ("failed", 3), 2: ("processing", 2), 3: ("processing", 1), 4: ("processing", 1), 5: ("ready", 2), 6: ("done", 1)} and sorted(r.id for r in claimed.collect()) == [2, 4]
    after, claimed = queue.claim_items(items(spark, rows), 9, NOW, source="b")
    assert [r.id for r in claimed.collect()] == [4] and {r.id: r.state for r in after.collect()}[1] == "processing"
    assert queue.claim_items(items(spark, rows).limit(0), 2, NOW)[1].collect() == []


def test_marks_and_model_errors(spark):
    i = items(spark, [(1, "a", "processing", 3, 0), (2, "a", "processing", 2, 0), (3, "a", "processing", 1, 0)])
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert {r.id: r.state for r in queue.after_model_error(i, ids).collect()} == {1: "failed", 2: "ready", 3: "processing"}
    done = {r.id: (r.state, r.raw_text) for r in queue.mark(i, ids, "done").collect()}
    assert done == {1: ("done", None), 2: ("done", None), 3: ("processing", "t")}
    assert {r.id: r.attempts for r in queue.mark(i, ids, "ready").collect()} == {1: 3, 2: 2, 3: 1}


def test_fair_order_is_the_round_robin(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice("aaab"), "ready", 0, 0) for i in range(60)]
    left = {s: [r[0] for r in rows if r[1] == s] for s in "ab"}
    want = []
    while any(left.values()):
        for s in sorted(left):
            want += left[s][:5]
            left[s] = left[s][5:]
    got = queue.fair_order(items(spark, rows)).orderBy("cycle", "source", "rn").collect()
    assert [r.id for r in got] == want


def test_thread_caps_and_streaks(spark):
    f = spark.createDataFrame([(i, "t" if i % 2 else None, "s", i) for i in range(6)], "item_id long, thread_id string, source string, pos int")
    assert sorted(r.item_id for r in queue.capped_findings(f, ["item_id"]).collect()) == [0, 1, 2, 3, 4]
    log = spark.createDataFrame([(i, "k", o) for i, o in enumerate(["error", "error", "capped", "error", "success", "error", "error", "success", "success", "error"])], "n int, k string, outcome string")
    got = sorted((r.errors, r.aborts) for r in queue.error_streaks(log, ["k"], ["n"]).collect())
    assert got == [(1, False), (2, False), (3, True)]
    b = spark.createDataFrame([(i, 10.0, i == 1) for i in range(5)], "n int, s double, capped boolean")
    assert [r.n for r in queue.within_budget(b, ["n"], max_items=2).orderBy("n").collect()] == [0, 1, 2]
    assert [r.n for r in queue.within_budget(b, ["n"], "s", 25).orderBy("n").collect()] == [0, 1, 2]


def brute_greedy(rows, merge, low):
    out, seen = {}, []
    for i, v in sorted(rows):
        v = np.array(v) / np.linalg.norm(v)
        sims = [float(c @ v) for _, c in seen]
        best = int(np.argmax(sims)) if sims else -1
        if best >= 0 and sims[best] >= merge:
            out[i] = seen[best][0]
        else:
            out[i] = -i
            seen.append((-i, v))
    return out


def test_greedy_fold_equals_the_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(i + 1, "k" + str(i % 2), "s", rng.normal(size=3).tolist()) for i in range(80)]
    f = spark.createDataFrame(rows, "id long, kind string, statement string, embedding array<double>").repartition(3)
    none = spark.createDataFrame([], "id long, kind string, canonical_statement string, centroid array<double>")
    got = {r.id: r.cluster_key for r in clusters.greedy(f, none, 0.9, 0.75).collect()}
    want: dict = {}
    for k in ("k0", "k1"):
        want |= brute_greedy([(i, v) for i, kind, _, v in rows if kind == k], 0.9, 0.75)
    assert got == want


def test_greedy_rounds_over_many_small_blocks(spark):
    """Blocks of five and folds of nine: rounds, stored clusters in parts, tie-breaks and equal vectors, against one pass."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(14, 4))
    words = ["slow data", "slow data loading", "cats", ""]
    rows, stored = [], []
    for i in range(1, 301):
        v = centres[int(rng.integers(0, 14))] + rng.normal(size=4) * (0.0 if i % 5 == 0 else 0.35)
        rows.append((i, None if i % 9 == 0 else "hot" if i % 9 < 7 else f"k{i % 3}", words[int(rng.integers(0, 4))], v.tolist()))
    for j in range(23):
        stored.append((j + 1, "hot" if j % 4 else "k1", words[j % 4], (centres[j % 14] + rng.normal(size=4) * 0.5).tolist()))
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    same, want = clusters.shared_words(), {}
    for kind in {r[1] for r in rows}:
        known = [(i, text, unit(v)) for i, k, text, v in stored if k == kind]
        for i, k, text, v in sorted(rows, key=lambda r: r[0]):
            if k != kind:
                continue
            sims = [round(float(np.dot(c, unit(v))), 12) for _, _, c in known]
            best = max(range(len(sims)), key=lambda n: (sims[n], -n)) if sims else None
            action = "new" if best is None or sims[best] < 0.75 else "tiebreak" if sims[best] < 0.9 else "merge"
            merged = action == "merge" or action == "tiebreak" and same(text, known[best][1])
            if not merged:
                known.append((-i, text, unit(v)))
            want[i] = (kind, known[best][0] if merged else -i, None if best is None else round(sims[best], 9), action, merged)
    f = spark.createDataFrame(rows, "id long, kind string, statement string, embedding array<double>").repartition(5)
    c = spark.createDataFrame(stored, "id long, kind string, canonical_statement string, centroid array<double>")
    for size in ({"block": 5, "fold": 9}, {"block": 64, "fold": 64}, {}):
        got = clusters.greedy(f, c, 0.9, 0.75, same, **size).collect()
        assert len(got) == 300 and {r.id: (r.kind, r.cluster_key, None if r.similarity is None else round(r.similarity, 9), r.action, r.merged) for r in got} == want


def test_paraphrases_share_a_cluster_with_a_tiebreak(spark):
    f = spark.createDataFrame([(1, "pain", "slow data loading in training", [1.0, 0.0]), (2, "pain", "slow data loading in big training", [0.8, 0.6]), (3, "pain", "cats", [0.0, 1.0])], "id long, kind string, statement string, embedding array<double>")
    stored = spark.createDataFrame([(77, "pain", "dogs", [0.0, -1.0]), (78, "read", "x", [1.0, 0.0])], "id long, kind string, canonical_statement string, centroid array<double>")
    got = {r.id: (r.cluster_key, r.action, r.merged) for r in clusters.greedy(f, stored, 0.9, 0.75, clusters.shared_words()).collect()}
    assert got == {1: (-1, "new", False), 2: (-1, "tiebreak", True), 3: (-3, "new", False)}


def test_selection_equals_the_loop(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 0.1, 0.5, 0.9]), rng.choice([None, "2024-01-01", "2024-01-02"])) for i in range(50)]
    d = spark.createDataFrame(rows, "id long, source string, confidence double, created_at string")
    for n, share in ((10, 0.3), (10, 1.0), (0, 0.5), (60, 0.2), (7, 0.01)):
        ranked = sorted(rows, key=lambda r: r[0])
        ranked = sorted(ranked, key=lambda r: (r[2] or 0.0, r[3] or ""), reverse=True)
        quota, taken, left, seen = max(1, int(n * share)), [], [], {}
        for r in ranked:
            if len(taken) < n and seen.get(r[1], 0) < quota:
                taken.append(r)
                seen[r[1]] = seen.get(r[1], 0) + 1
            else:
                left.append(r)
        want = {r[0] for r in (taken + left[: max(0, n - len(taken))] if 0 < n < len(rows) else rows)}
        assert {r.id for r in briefing.select_for_prompt(d, n, share).collect()} == want


def test_story_fold_caps_and_links_equal_the_loop(spark):
    from signalmill.functions.jsons import SECTIONS

    rng = random.Random(9)
    rows = [(s, p, [rng.randint(0, 40) for _ in range(rng.randint(0, 2))], [f"u{rng.randint(0, 15)}"] if rng.random() < 0.5 else []) for s in SECTIONS for p in range(6)]
    d = spark.createDataFrame(rows, "section string, pos int, finding_ids array<long>, urls array<string>").repartition(4)
    ids, urls, kept = set(), set(), []
    for s, p, i, u in sorted(rows, key=lambda r: (SECTIONS.index(r[0]), r[1])):
        if not (set(i) & ids or set(u) & urls):
            ids |= set(i)
            urls |= set(u)
            kept.append((s, p))
    got = briefing.one_per_story(d)
    assert sorted((r.section, r.pos) for r in got.collect()) == sorted(kept)
    # The same in rounds, with what two and more items leave open.
    for fold in (0, 7):
        assert sorted((r.section, r.pos) for r in briefing.one_per_story(d, fold=fold).collect()) == sorted(kept)
    sizes = {"patterns": 4, "papers": 4, "market": 4, "someone_built": 10}
    d = spark.createDataFrame([(s, p) for s, n in sizes.items() for p in range(n)], "section string, pos int")
    count = lambda b, t: {r.section: r["count"] for r in briefing.apply_caps(d, b, t).groupBy("section").count().collect()}
    assert count(5, 20) == {"patterns": 4, "papers": 4, "market": 4, "someone_built": 5} and count(3, 8) == {"patterns": 4, "papers": 4} and count(-1, 13) == {"patterns": 4, "papers": 4, "market": 4}


def test_digest_text(spark):
    rows = [("papers", 0, "H1", " body ", "", [1, 2, 1]), ("someone_built", 0, "H2", "", "T", [3, 4]), ("papers", 1, "H3", "", "", [])]
    x = spark.createDataFrame(rows, "section string, pos int, headline string, body string, topic string, finding_ids array<long>")
    index = spark.createDataFrame([(1, "http://a", None, None), (2, "http://b", None, 8), (3, None, "Pub", 9), (4, "", "Pub", 7)], "id long, url string, publication string, cluster_id long")
    linked = briefing.numbered(briefing.with_links(x, index, ["section", "pos"]))
    md = rendering.digest_markdown(linked, F.lit("2024-02-03").cast("date"), F.lit("Sum")).first().markdown
    assert md == "# 3 February 2024\n\nSum\n\n## Papers\n\n### 1. H1\nbody\n\n[source](http://a) · [source](http://b)\n\n### 2. H3\n\n## Someone built\n\n### 3. [T] H2\n\nvia Pub\n"
    h = briefing.headlines(linked, 2).orderBy("n").collect()
    assert [(r.n, r.headline, r.cluster_id, r.url) for r in h] == [(1, "H1", 8, "http://a"), (2, "H3", None, None)]
    quiet = rendering.digest_markdown(linked.limit(0), F.lit("2024-02-03").cast("date"), F.lit(""))
    assert quiet.first().markdown == "# 3 February 2024\n\nNothing worth surfacing tonight.\n"


def test_leaderboard_filters_after_the_limit_and_nulls_lead(spark):
    rows = [(i, "read" if i < 50 else "pain", False, False, None, float(100 - i), 2) for i in range(60)] + [(99, "pain", False, False, None, None, 2), (98, "pain", True, False, None, None, 9)]
    c = spark.createDataFrame(rows, "id long, kind string, muted boolean, pinned boolean, pinned_mention_count int, score double, mention_count int")
    assert [r.id for r in ranking.recurring(c).orderBy("rank").collect()] == [99]
    vis = spark.createDataFrame([(False, True, 5, 5), (False, True, 4, 5), (False, True, None, 1), (True, False, None, 9), (None, None, None, None)], "muted boolean, pinned boolean, pinned_mention_count int, mention_count int")
    assert [r.v for r in vis.select(ranking.visible().alias("v")).collect()] == [False, True, True, False, True]


def test_table_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    new = spark.createDataFrame([("b", 1), ("c", 2), ("c", 1)], "name string, n int")
    assert sorted((r.name, r.n) for r in tables.insert_ignore(old, new, ["name"], ["n"]).collect()) == [("c", 1)]
    assert sorted(r.id for r in tables.with_ids(old, new.repartition(3), [F.col("name"), F.col("n")]).collect()) == [3, 4, 5]
    got = tables.with_ids(old, new.repartition(3), [F.col("name"), F.col("n")]).orderBy("id").collect()
    assert [(r.name, r.n) for r in got] == [("b", 1), ("c", 1), ("c", 2)]
    assert [r.id for r in tables.get(old, name="b").collect()] == [2] and tables.get(old, name="z").collect() == []
    i = spark.createDataFrame([(1, "ready", "x"), (2, "ready", "y")], "id long, state string, raw_text string")
    j = spark.createDataFrame([(1, '[{"kind":"k","statement":"s","confidence":0.5},{"kind":"k2","statement":"t","confidence":1}]'), (3, "[]")], "item_id long, p_findings string")
    after, found, n = tables.record_judgement(i, j, NOW)
    assert {r.id: (r.state, r.raw_text) for r in after.collect()} == {1: ("done", None), 2: ("ready", "y")} and sorted(r.kind for r in found.collect()) == ["k", "k2"] and {r.item_id: r.n for r in n.collect()} == {1: 2, 3: 0}
    with pytest.raises(ValueError):
        tables.feedback_rows(old, 1, "maybe", NOW)


def test_mentions(spark):
    m = spark.createDataFrame([(1, 5, "a", "2024-01-01"), (2, 5, "a", "2024-01-01"), (3, 5, "b", "2024-01-01")], "id long, cluster_id long, source string, seen_on string")
    stored = m.where("source = 'b'").select("cluster_id", "source", "seen_on")
    assert {r.id: r.is_new for r in clusters.new_mentions(m, stored, ["id"]).collect()} == {1: True, 2: False, 3: False}


def test_a_large_briefing_is_decided_in_rounds(spark):
    """Twenty thousand items of one briefing, one id in a third of them, no task with more than five hundred."""
    rng = random.Random(2)
    rows = [(i, [0] if rng.random() < 0.33 else [rng.randint(1, 9000)], [f"u{rng.randint(0, 9000)}", None] if i % 4 else None) for i in range(20_000)]
    d = spark.createDataFrame(rows, "pos int, finding_ids array<long>, urls array<string>").withColumn("section", F.lit("papers")).repartition(4)
    seen, kept = set(), []
    for i, ids, urls in rows:
        cites = set(ids) | {u for u in urls or [] if u}
        if not cites & seen:
            seen |= cites
            kept.append(i)
    assert sorted(r.pos for r in briefing.one_per_story(d, fold=500).select("pos").collect()) == kept


def test_a_chain_of_five_thousand_replies_is_a_few_tables(spark):
    n = spark.range(5000).select(F.lit("t").alias("thread"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).cast("long").alias("ord"), F.lit("a").alias("author"), F.col("id").cast("string").alias("text"))
    written = []
    real, threads.staged = threads.staged, lambda df, tag: written.append(tag) or real(df, tag)
    try:
        got = threads.walk(n)
        assert got.agg(F.max("depth"), F.count(F.lit(1)), F.sum((F.size("bfs_path") == F.col("depth") + 1).cast("int"))).first()[:] == (4999, 5000, 5000)
    finally:
        threads.staged = real
    assert len(written) <= 8


def test_paths_of_random_trees_and_what_leads_nowhere(spark):
    rng = random.Random(3)
    rows, paths = [], {}
    for t in ("t", "u"):
        for i in range(120):
            parent = None if i < 3 else rng.randrange(i) if i < 100 else {100: 101, 101: 100, 102: 101, 103: 999}[i] if i < 104 else rng.randrange(100, i)
            rows.append((t, i, parent, rng.randint(0, 3), "a", f"c{i}"))
            above = paths.get((t, parent)) if parent is not None else []
            if above is not None:
                paths[t, i] = [*above, rows[-1][3]]
    d = spark.createDataFrame(rows, "thread string, node long, parent long, ord long, author string, text string").repartition(3)
    for hops in (1, 2):
        got = {(r.thread, r.node): r.bfs_path for r in threads.walk(d, hops).collect()}
        assert got == paths and min(n for _, n in got) == 0 and max(n for _, n in got) == 99


def test_threads_walk_breadth_first_and_cut(spark):
    nodes = [("t", 1, None, 0, "a", "first"), ("t", 2, None, 1, None, "second"), ("t", 3, 1, 0, "c", "reply"), ("t", 4, 3, 0, "d", " "), ("t", 5, 3, 1, "e", "deep")]
    n = spark.createDataFrame(nodes, "thread string, node long, parent long, ord long, author string, text string")
    s = spark.createDataFrame([("t", " Title ", "Body"), ("u", "", None)], "thread string, title string, text string")
    got = {r.thread: r.context for r in threads.contexts(s, threads.walk(n)).collect()}
    assert got == {"t": "Story: Title\n\nBody\n\nComments:\n\n- a: first\n\n- someone: second\n\n- c: reply\n\n- e: deep"}
    cut = threads.contexts(s, threads.walk(n), max_comments=1, max_chars=20).first().context
    assert cut == "Story: Title\n\nBody" + threads.CUT_MARK
    i = spark.createDataFrame([("hackernews", "t", "9"), ("hackernews", None, "t"), ("github", "t", "1")], "source string, thread_id string, source_id string")
    assert [r.context is not None for r in threads.attach(i, threads.contexts(s, threads.walk(n))).orderBy("source", "source_id").collect()] == [False, True, True]


def test_last_run_without_runs(spark):
    none = spark.createDataFrame([], "finished_at timestamp, started_at timestamp, items_fetched int, findings_created int")
    assert counts.last_run(none, NOW).first().footer == "no runs yet"


def test_model_contracts():
    assert models.read_triage("garbage") is True and models.read_triage("{}") is False and models.read_triage('{"worth_reading": true}') is True
    pauses, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise models.TransportError("down")
        return "ok"

    assert models.with_retry(flaky, sleep=pauses.append) == "ok" and pauses == [1, 2]
    with pytest.raises(ValueError):
        models.with_retry(lambda: (_ for _ in ()).throw(ValueError()), sleep=pauses.append)
    answers = iter(["not json", "[]"])
    assert models.judge_one("t", lambda p: next(answers)) == ([], None, 2)
    assert models.ask_same(lambda a, b: '{"same": true}')("a", "b") is True and models.ask_same(lambda a, b: "?")("a", "b") is False
    assert models.missing_models({"a", "b"}, {"b"}) == ["a"]


def test_actions_and_reset(spark):
    c = spark.createDataFrame([(1, "pain", ["a"], None, 4, None, False, False, None), (2, "read", None, None, None, None, False, False, None)], "id long, kind string, sources_seen array<string>, days_seen array<date>, mention_count int, last_seen timestamp, muted boolean, pinned boolean, pinned_mention_count int")
    assert {r.id: r.muted for r in tables.mute(c, 1).collect()} == {1: True, 2: False}
    assert {r.id: (r.pinned, r.pinned_mention_count) for r in tables.pin(c, 2).collect()} == {1: (False, None), 2: (True, 0)}
    row = tables.feedback_rows(c, 1, "watch", NOW).first()
    assert row.features_json == '{"n_sources":1,"n_days":0,"mention_count":4,"recent":false,"kind":"pain"}' and row.score_version == "v1-recurrence"
    s = spark.createDataFrame([("a", None), ("b", None)], "name string, last_successful_fetch_at timestamp")
    got = tables.reset({"sources": s, "clusters": c}, ["a"], NOW)
    assert got["clusters"].count() == 0 and [(r.name, str(r.last_successful_fetch_at)) for r in got["sources"].collect()] == [("a", "2024-01-30 18:00:00")]
    adv = tables.advance_watermarks(s, s.where("name = 'b'").select("name", NOW.alias("started_at")))
    assert {r.name: str(r.last_successful_fetch_at) for r in adv.collect()} == {"a": "None", "b": "2024-01-31 00:00:00"}
    errors = spark.createDataFrame([("b", "x"), ("a", "y")], "source string, error string")
    run = tables.run_row(3, NOW, None, s, c, errors).first()
    assert (run.id, run.items_fetched, run.findings_created, run.errors, run.finished_at) == (3, 2, 2, ["a: y", "b: x"], None)


def test_cards_reports_and_prompts(spark):
    x = spark.createDataFrame([(7, "pain", "S", "why", "", 3, 2, 1), (8, "odd", "T", None, "q", 1, 1, 0)], "id long, kind string, statement string, why string, quote string, mention_count int, n_sources int, new_this_week int")
    assert [r.c for r in x.select(rendering.card().alias("c")).collect()] == ["🔴 S\n   why\n   3 mentions · 2 sources · 1 new this week  ·  #7", '• T\n   "q"\n   1 mentions · 1 sources · 0 new this week  ·  #8']
    f = spark.createDataFrame([(1, 1, "k", "s1", None, "", "q", 0.5), (2, None, None, "s2", "w", "d", None, None), (3, 1, "k", "s3", None, None, None, 0.9)], "id long, item_id long, kind string, statement string, why_it_matters string, domain string, evidence_quote string, confidence double")
    i = spark.createDataFrame([(1, "")], "id long, url string")
    rows = rendering.report_rows(f, i)
    assert sorted((r.kind_rank, r.place, r.id, r.kind, r.url) for r in rows.collect()) == [(1, 1, 3, "k", "(no url)"), (1, 2, 1, "k", "(no url)"), (2, 1, 2, "unknown", "(no url)")]
    text = "\n".join(r.text for r in rendering.report_lines(rows).orderBy("kind_rank", "place").collect())
    assert "_3 findings across 2 kinds_" in text and "**Why it matters:** w" in text and "[source]((no url)) · d" in text and "confidence 0.90" in text
    m = spark.createDataFrame([('{"points": 5, "num_comments": 2}',), ("{}",), (None,)], "m string")
    lines = [r.x for r in m.select(rendering.engagement_line(F.col("m")).alias("x")).collect()]
    assert lines[0].startswith("[Engagement: 5 points, 2 comments;") and lines[1] == "" and not lines[2]
    deep = spark.range(1).select(rendering.deep_read_input(F.lit("T"), F.lit(" ctx "), F.lit(None).cast("string"), F.lit("bad")).alias("x")).first().x
    assert deep.endswith("[The item:]\nT\n\n[The last answer was refused: bad]") and "\nctx\n" in deep
    lead = spark.createDataFrame([(2, "b"), (1, "a")], "id int, line string")
    assert briefing.block(lead, "line", "id", "(none)").first().text == "a\nb" and briefing.block(lead.limit(0), "line", "id", "(none)").first().text == "(none)"
    assert spark.range(1).select(briefing.synthesis_input(F.lit(""), F.lit(None).cast("string")).alias("x")).first().x == "Findings of the night:\n(none tonight)\n\nRecurring so far:\n(none yet)"


def test_dispatches(spark):
    log = spark.createDataFrame([(i, i, a, m, False) for i, a, m in ((1, 1, 1), (2, 3, 1), (3, 1, 1), (4, 1, 1), (5, 1, 11), (6, 1, 0))], "id long, request_id long, attempt int, age int, checked boolean")
    log = log.withColumn("created_at", NOW - F.make_dt_interval(mins=F.col("age")))
    got = spark.createDataFrame([(1, 204, None, ""), (2, 401, None, "denied"), (3, None, "timeout", None)], "id long, status_code int, error_msg string, content string")
    out = {r.id: (r.action, r.note, r.alert) for r in counts.dispatch_reconcile(log, got, NOW).collect()}
    assert out == {1: ("accepted", "", None), 2: ("alert", "denied", "dispatch failed after 3 attempts: HTTP 401 - denied"), 3: ("retry", "timeout", None), 4: ("wait", None, None), 5: ("lost", "no response row found", None)}


def test_ranks_of_a_hot_group_equal_a_sort(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aaaaab"), rng.choice([None, "x", "y", "é", ""]), i) for i in range(500)]
    d = spark.createDataFrame(rows, "g string, s string, i long").repartition(5)
    got = {r.i: r.n for r in tables.rank_in_order(d, ["g"], [F.col("s"), F.col("i")], "n", parts=8).collect()}
    want = {}
    for g in "ab":
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or "", r[2])), 1):
            want[r[2]] = n
    assert got == want


def test_turns_of_a_claim(spark):
    rows = [(i, "a", "ready") for i in range(1, 13)] + [(i, "b", "ready") for i in (20, 21)] + [(30, "c", "done")]
    d = spark.createDataFrame(rows, "id long, source string, state string").withColumns({"attempts": F.lit(0), "processing_at": F.lit(None).cast("timestamp")})
    after, claimed = queue.claim_in_turns(d, 9, NOW)
    assert [r.id for r in claimed.orderBy("turn").collect()] == [1, 2, 3, 4, 5, 20, 21, 6, 7]
    assert after.where("state = 'processing' and attempts = 1").count() == 9 and after.count() == len(rows)


def test_running_sums_in_parts(spark):
    rows = [(i % 2, i * 7 % 101, i % 5) for i in range(400)]
    d = spark.createDataFrame(rows, "g int, o int, v int").withColumn("i", F.monotonically_increasing_id())
    from signalmill.operators.tables import rank_in_order, running_sum

    for parts in (1, 3, 64):
        got = sorted((r.g, r.o, r.i, r.v, r.s) for r in running_sum(d, ["g"], [F.col("o"), F.col("i")], F.col("v"), "s", parts).collect())
        total = {0: 0, 1: 0}
        for g, _, _, v, s in got:
            assert s == total[g]
            total[g] += v
    ranks = sorted((r.g, r.o, r.i, r.n) for r in rank_in_order(d, ["g"], [F.col("o"), F.col("i")], "n", 5).collect())
    assert [n for g, _, _, n in ranks if g == 0] == list(range(1, 201))


def test_a_saved_report_and_captions(spark, tmp_path):
    f = spark.createDataFrame([(1, 1, "pain", "s1", "w", "d", "q", 0.5), (2, None, "", "s2", "", "", "", None)], "id long, item_id long, kind string, statement string, why_it_matters string, domain string, evidence_quote string, confidence double")
    rows = rendering.report_rows(f, spark.createDataFrame([(1, "http://u")], "id long, url string"))
    rendering.save_report(rendering.report_lines(rows), str(tmp_path / "report"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    assert text.startswith("# findings\n\n_2 findings across 2 kinds_") and text.index("## pain") < text.index("### s1") < text.index("## unknown") < text.index("### s2") and "[source]((no url))" in text
    cut = spark.range(1).select(rendering.caption(F.lit("é" * 1200)).alias("c")).first().c
    assert len(cut) == rendering.CAPTION


def test_nearest_of_a_hot_kind_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    x[10] = x[3]
    rows = [(i, "k" if i < 55 else "j", v.tolist()) for i, v in enumerate(x)] + [(99, "lone", [1.0, 0.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "id long, kind string, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for block in (7, 1000):
        got = {r.id: (r.nearest, round(r.similarity, 9)) for r in clusters.nearest_same_kind(d, d, block=block).collect()}
        assert set(got) == set(range(60))
        for i in range(60):
            others = [(-round(float(unit[i] @ unit[j]), 12), j) for j in range(60) if j != i and (j < 55) == (i < 55)]
            assert got[i] == (min(others)[1], round(-min(others)[0], 9))


def test_nearest_in_cells_skips_pairs_and_stays_exact(spark):
    """Clustered vectors of a hot and a small kind, with equal vectors, zero vectors and other candidates than vectors."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 8))
    x = centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 8)) * 0.15
    x[40], x[41], x[900], x[7] = x[3], x[3], 0.0, 0.0
    rows = [(i, "hot" if i % 8 else "small" if i % 16 else None, v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "id long, kind string, embedding array<double>").repartition(3)
    unit = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    sims = np.round(unit @ unit.T, 12)
    for asked, held in ((d, d), (d.where("id < 200"), d.where("id >= 150"))):
        best, told = clusters.nearest_found(asked, held, block=64)
        got = {r.id: (r.kind, r.nearest, round(r.similarity, 9)) for r in best.collect()}
        kind = {r.id: r.kind for r in asked.collect() if r.kind}
        others = {r.id: r.kind for r in held.collect() if r.kind}
        assert set(got) == set(kind)
        for i, k in kind.items():
            near = min((-sims[i, j], j) for j, o in others.items() if o == k and j != i)
            assert got[i][:2] == (k, near[1]) and abs(got[i][2] + near[0]) < 1e-8, i
        share = 1 - told["multiplied"] / told["pairs"]
        print("share of pairs skipped", round(share, 3))
        assert share > 0.5
    assert clusters.nearest_same_kind(d.limit(0), d).collect() == [] and clusters.nearest_same_kind(d, d.limit(0)).collect() == []
