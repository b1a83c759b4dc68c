import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from signalmill.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size int, target string, bucket string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x", None) for i, t, s in rows], SCHEMA)


def by_rounds(sizes, weights, share, cap):
    """Targets by sharing the excess again and again."""
    budget, target, stopped = share * sum(sizes), [0.0] * len(sizes), set()
    while True:
        left, open_ = budget - sum(cap * sizes[i] for i in stopped), sum(w for i, w in enumerate(weights) if i not in stopped)
        above = {i for i, w in enumerate(weights) if i not in stopped and w * left / open_ > cap * sizes[i]}
        if not above:
            return [cap * sizes[i] if i in stopped else w * left / open_ for i, w in enumerate(weights)]
        stopped |= above


def test_targets_against_rounds_by_hand(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        sizes = [int(x) for x in rng.pareto(0.7, n) * 100 + 1]
        names = sorted(f"s{i}" for i in range(n))
        got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()}
        want = by_rounds(sizes, [(5, 2, 1)[i % 3] for i in range(n)], 1.5, 2.0)
        assert np.allclose([got[s] for s in names], want) and math.isclose(sum(got.values()), 1.5 * sum(sizes))


def test_the_draw_against_a_sort_of_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("wörd"[: 1 + int(x)] + "7" * int(y) for x, y in rng.integers(0, 4, (int(rng.integers(0, 40)), 2))), ("a", "b", None, "hot")[min(3, int(rng.integers(0, 8)))]) for i in range(700)]
    rows.append((700, "long " * 30_000, "b"))
    d = docs(spark, rows)
    got = M.mix(d, per_unit=4).collect()
    keys = {r.doc_id: (r.key, r.name) for r in M.draw_keys(d, None, 4).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    assert {r.doc_id: r["size"] for r in got} == size and len(got) == len(rows)
    for source in ("a", "b", None, "hot"):
        mine = [r for r in got if r.source == source]
        target, held = mine[0].target, mine[0].source_size
        assert held == sum(r["size"] for r in mine)
        epochs = int(target // held)
        left = math.floor(target - epochs * held + 0.5)
        want = {}
        for r in sorted(mine, key=lambda r: keys[r.doc_id]):
            want[r.doc_id] = epochs * r["size"] + min(r["size"], left)
            left -= min(r["size"], left)
        assert {r.doc_id: r.taken for r in mine} == want
        assert abs(sum(r.taken for r in mine) - target) <= 0.5 and all(0 <= r.taken <= 2 * r["size"] for r in mine)
    for n in (1, 9):
        assert sorted(M.mix(d.repartition(n)).select("doc_id", "taken").collect()) == sorted(M.mix(d).select("doc_id", "taken").collect())


def test_heavier_documents_are_likelier(spark):
    rows = [(i, "word " * 10, "a") for i in range(4000)]
    d = docs(spark, rows).withColumn("size", F.when(F.col("doc_id") % 2 == 0, 4).otherwise(1))
    got = M.mix(d, weights=(1,), share=0.3, weight=F.col("size")).where("taken > 0").collect()
    heavy = sum(r.doc_id % 2 == 0 for r in got)
    # Chances of the first draw are 4 to 1; without replacement they come down as heavy ones go.
    assert len(got) == 1200 and 860 < heavy < 960


def test_weights_count_characters_not_bytes():
    words, weight = M.measure(pa.array(["", "a b", "é1 ", "\tx\x0b-", "日本 5", "…"])[1:])
    assert words.tolist() == [2, 1, 2, 2, 1] and weight.tolist() == [1.0, 0.5, 0.5, 2 / 3, 1.0]


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (None, "x y", "a"), (3, "one two", None), (3, "one two", None), (4, None, "empty"), (5, "  \t", "empty")]
    got = M.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows) and {r.taken for r in got if r.source == "empty"} == {0} and {r.target for r in got if r.source == "empty"} == {0.0}
    assert sum(r.taken for r in got) == 12 and {r["size"] for r in got if r.doc_id in (1, 2)} == {0}
    assert M.mix(docs(spark, rows).limit(0)).collect() == []
    odd = M.mix(docs(spark, [(i, "w", "a") for i in range(10)]), share=0.5, weight=F.when(F.col("doc_id") == 0, F.lit(float("nan"))).when(F.col("doc_id") == 1, -1.0)).collect()
    assert sum(r.taken for r in odd) == 5
