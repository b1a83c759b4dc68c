import numpy as np

from signalmill.llm import permutation as N
from signalmill.llm.queries import op7_permutation


def exact(rows, k, every):
    out = {}
    for q, v in rows:
        if q % every == 0:
            s = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_recall_of_the_registered_query_and_the_same_rows_however_it_is_read(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    want = exact(rows, 20, 20)
    got: dict[int, list] = {}
    registered = op7_permutation(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect()
    for r in registered:
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want)
    recall = [len(set(got[q]) & set(want[q])) / 20 for q in want]
    print("recall", np.mean(recall), min(recall))
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.7
    for n in (3, 16):
        assert N.nearest_neighbours(e.repartition(n), block_rows=40).orderBy("query_id", "rank").collect() == registered


def test_agreement_is_the_footrule_distance():
    rng = np.random.default_rng(2)
    x, pivots, m = rng.normal(size=(50, 6)), rng.normal(size=(12, 6)), 5
    files = N.Files.unpack(N.Files.build(x, [[i] for i in range(50)], np.hstack([pivots, np.zeros((12, 1))]), float(np.linalg.norm(x, axis=1).max()), m).pack(), 6)
    near = N.nearest_pivots(x, pivots, m)
    for q in near[:10]:
        got = files.agreement(q)
        for i, v in enumerate(near):
            place = {p: j for j, p in enumerate(v.tolist())}
            assert m * m - got[i] == sum(abs(j - place[p]) if p in place else m for j, p in enumerate(q.tolist()))


def test_copies_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20 * i, [1.0, 0.0]) for i in range(30)] + [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [])]
    d = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, query_id string")
    out = N.nearest_neighbours(d, k=5).orderBy("query_id", "rank").collect()
    by: dict[int, list] = {}
    for r in out:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {20 * i for i in range(30)}
    assert [v for _, v, _ in by[0]] == [20, 40, 60, 80, 100] and [v for _, v, _ in by[100]] == [0, 20, 40, 60, 80]
    assert all(s == 1.0 for rows in by.values() for _, _, s in rows)
    few = N.nearest_neighbours(d.where("vec_id in (0, 1)"), k=5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 1, 0.5)]
    assert N.nearest_neighbours(d.limit(0)).collect() == [] and N.nearest_neighbours(d.where("vec_id = 1")).collect() == []


def test_longer_vectors_win_by_inner_product(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)) * rng.uniform(0.1, 5, size=(600, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    want = exact(rows, 10, 20)
    got: dict[int, set] = {}
    for r in N.nearest_neighbours(d, k=10, share=0.3, least=20, block_rows=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & set(want[q])) / 10 for q in want]) >= 0.9


def test_an_id_with_many_near_vectors_takes_one_place(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 * i]) for i in range(400)] + [(i, [0.5, 0.01 * i]) for i in range(2, 12)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = N.nearest_neighbours(d, k=5, share=0.05, least=10).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 1.0)] + [(i, 0.5) for i in range(2, 6)]
