import re

from hypothesis import given
from hypothesis import strategies as st

from signalmill.llm import decontaminate as D


def brute_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, window):
    wins = {(tuple(w[i : i + n]), k) for k, t in items if k is not None for w in [brute_words(t)] if w for n in [min(window, len(w))] for i in range(len(w) - n + 1)}
    out = []
    for d, t in docs:
        w, hit, ids = brute_words(t), set(), set()
        for g, k in wins:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    ids.add(str(k))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


@given(st.text(max_size=40))
def test_words_equal_their_definition(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [w.decode() for w in D.words(text)] == brute_words(text)


def test_equals_brute_force_in_one_and_in_many_blocks(spark):
    docs = [(1, "The cat, SAT on a mat today"), (2, None), (3, ""), (4, "on a mat today on a MAT"), (4, "on a mat today on a MAT"), (None, "é zoë1 é zoë1 é"), (6, "x " * 30_000 + "cat sat on"), (7, "!!!")]
    items = [(10, "cat sat on a"), (11, "mat"), (12, "É zoë1 é"), (12, "é zoë1 é"), (13, None), (14, ""), (None, "today"), (15, "cat sat on a")]
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    for block in (10**9, 8):
        got = D.decontaminate(d, b, window=3, block_bytes=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute(docs, items, 3)
        spans = {r.doc_id: r.spans for r in D.decontaminate(d, b, window=3, block_bytes=block).collect()}
        assert spans[1] == "4:21" and spans[2] == ""
        clean = D.keep_clean(d, b, window=3, block_bytes=block)
        assert clean.columns == d.columns and sorted((r.doc_id for r in clean.collect()), key=str) == [2, 3, 7]


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 7))
def test_scan_equals_brute_force(items, text, window):
    items = [(str(k), " ".join(w)) for k, w in enumerate(items)]
    spans, ids = D.Matcher(items, window).scan(D.words(" ".join(text)))
    (want,) = brute([(0, " ".join(text))], items, window)
    assert (sum(b - a for a, b in spans), sorted(ids)) == want[2:]


def test_the_automaton_is_about_as_long_as_the_benchmark():
    import random

    rng = random.Random(1)
    items = [(str(i), " ".join(f"w{rng.randint(0, 20_000)}" for _ in range(200))) for i in range(500)]
    m = D.Matcher(items, 10)
    assert m.auto.get_stats()["nodes_count"] <= 1.01 * 500 * 200 + 1, "a node a word at most"


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in D.decontaminate(d, none).collect()] == [(2, 0)]
    assert D.decontaminate(d.limit(0), none).collect() == []


def test_windows_overlapping_a_word_match_at_word_bounds_only(spark):
    d = spark.createDataFrame([(1, "xcat sat on"), (2, "cat sat onx"), (3, "a cat sat on")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "cat sat on")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in D.decontaminate(d, b, window=3).collect()} == {1: 0, 2: 0, 3: 3}


def test_blocks_have_one_process_a_core_and_one_build_a_process(spark, tmp_path, monkeypatch):
    import os

    build = D.Matcher
    log = str(tmp_path)

    def logged(items, window):
        with open(f"{log}/{os.getpid()}", "a") as f:
            f.write("x")
        return build(items, window)

    monkeypatch.setattr(D, "Matcher", logged)
    d = spark.createDataFrame([(i, f"text w{i % 60} of a kind") for i in range(600)], "doc_id long, text string").repartition(16)
    b = spark.createDataFrame([(i, f"w{i} of a kind") for i in range(60)], "item_id long, text string")
    blocks = len(D._blocks(b, 150))
    assert blocks > 3 and D.decontaminate(d, b, window=4, block_bytes=150).where("n_hit = 4").count() == 600
    cores = spark.sparkContext.defaultParallelism
    builds = [os.path.getsize(f"{log}/{p}") for p in os.listdir(log)]
    assert len(builds) <= cores and max(builds) <= blocks


def test_repeated_words_cost_no_more_than_others():
    import time

    def took(n):
        m, text = D.Matcher([("a", "x " * n)], 10), D.words("x " * 4 * n)
        at = time.perf_counter()
        assert m.scan(text) == ([(0, 4 * n)], {"a"})
        return time.perf_counter() - at

    assert min(took(16_000) for _ in range(3)) < 12 * min(took(4_000) for _ in range(3)), "quadratic would be 16 times"


def test_processes_that_other_steps_left_idle_build_no_blocks(spark, tmp_path, monkeypatch):
    import os

    cores, build, log = spark.sparkContext.defaultParallelism, D.Matcher, str(tmp_path)

    def slow(batches):
        import time

        for batch in batches:
            time.sleep(0.2)
            yield batch

    # Each of these tasks has three processes at once, which Spark then keeps for later tasks and takes in turn.
    spark.range(0, 400, 1, cores).mapInArrow(slow, "id long").mapInArrow(slow, "id long").mapInArrow(slow, "id long").count()

    def logged(items, window):
        with open(f"{log}/{os.getpid()}", "a") as f:
            f.write("x")
        return build(items, window)

    monkeypatch.setattr(D, "Matcher", logged)
    d = spark.createDataFrame([(i, f"text w{i % 60} of a kind") for i in range(600)], "doc_id long, text string").repartition(16)
    b = spark.createDataFrame([(i, f"w{i} of a kind") for i in range(60)], "item_id long, text string")
    blocks = len(D._blocks(b, 150))
    assert blocks > 3 and D.decontaminate(d, b, window=4, block_bytes=150).where("n_hit = 4").count() == 600
    builds = [os.path.getsize(f"{log}/{p}") for p in os.listdir(log)]
    assert len(builds) <= cores and max(builds) <= blocks
