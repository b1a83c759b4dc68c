import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from signalmill.llm import quality as Q
from signalmill.llm import toxicity as T

SF = "/root/testdata/sf0.1"


@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 5)), min_size=1, max_size=8))
def test_pooling_is_the_isotonic_fit(groups):
    n = np.array([float(a) for a, _ in groups])
    k = np.array([float(min(a, b)) for a, b in groups])
    fit = Q.pool_adjacent(n, k)
    assert len(fit) == len(n) and (np.diff(fit) >= -1e-12).all()
    means = [[k[i : j + 1].sum() / n[i : j + 1].sum() if i <= j else 0 for j in range(len(n))] for i in range(len(n))]
    want = [max(min(means[i][j] for j in range(m, len(n))) for i in range(m + 1)) for m in range(len(n))]
    assert fit == pytest.approx(want)


def held_out(spark, f, label):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, f(docs, labels).where("held_out").join(labels, "doc_id").collect()


def test_quality_on_held_out_rows(spark):
    docs, labels, rows = held_out(spark, Q.classify, "quality")
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1]
    print("bad", sum(r.predicted == 0 for r in bad), len(bad), "good", sum(r.predicted == 1 for r in good), len(good))
    assert sum(r.predicted == 0 for r in bad) >= 0.95 * len(bad) and sum(r.predicted == 1 for r in good) >= 0.99 * len(good)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, rows = held_out(spark, T.score_toxicity, "toxic")
    toxic = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    print("toxic", sum(r.predicted for r in toxic), len(toxic), "clean", sum(r.predicted for r in clean), len(clean))
    assert sum(r.predicted for r in toxic) >= 0.93 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(r.spans for r in toxic if r.predicted)


@pytest.mark.parametrize("f,label", [(Q.classify, "quality"), (T.score_toxicity, "toxic")])
def test_odd_rows(spark, f, label):
    rows = [(i, "fine words here." if i % 2 else "BAD!! idiot!! ***") for i in range(80)] + [(900, None), (901, ""), (901, ""), (None, "x"), (902, "word " * 30_000)]
    d = spark.createDataFrame([(*r, 1.0, "s") for r in rows], "doc_id long, text string, score double, source string")
    marks = [(i, i % 2, 1 - i % 2) for i in range(80)] + [(None, 1, 1), (3, None, None), (5, 1, 0), (5, 1, 0), (7777, 0, 1)]
    lab = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = f(d, lab).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    if label == "quality":
        assert by[0].predicted == 0 and by[1].predicted == 1
    else:
        assert by[0].predicted == 1 and by[1].predicted == 0
    none = f(d, lab.limit(0)).collect()
    assert len({r.score for r in none}) == 1 and f(d.limit(0), lab).collect() == []
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)


def random_field(rng, n):
    field = T.Field(n)
    field.set(rng.normal(size=n + 7))
    return field


def path_score(field, tokens, y):
    bias = field.w[-1]
    return field.start[y[0]] + sum(field.t[a, b] for a, b in zip(y, y[1:])) + sum(bias + sum(field.w[f] for f in fs) for v, fs in zip(y, tokens) if v)


@given(st.lists(st.sampled_from([(), (), (0,), (1, 2), (2,)]), min_size=1, max_size=9), st.integers(0, 99))
def test_marginals_of_every_token_equal_enumeration(tokens, seed):
    from itertools import product

    field = random_field(np.random.default_rng(seed), 3)
    total, ones = 0.0, np.zeros(len(tokens))
    for y in product((0, 1), repeat=len(tokens)):
        p = np.exp(path_score(field, tokens, y))
        total += p
        ones += p * np.array(y)
    assert field.marginals(tokens) == pytest.approx(ones / total)


def test_long_stretches_are_exact_too():
    field = random_field(np.random.default_rng(4), 2)
    tokens = [()] * 700 + [(0,)] + [()] * 900 + [(1,), (0, 1)] + [()] * 3
    t, own = np.exp(field.t), [np.array([1.0, np.exp(field.w[-1] + sum(field.w[f] for f in fs))]) for fs in tokens]
    fwd, back = [np.exp(field.start) * own[0]], [np.ones(2)]
    for e in own[1:]:
        x = fwd[-1] @ t * e
        fwd.append(x / x.sum())
    for e in own[:0:-1]:
        x = t @ (e * back[-1])
        back.append(x / x.sum())
    both = np.array(fwd) * np.array(back[::-1])
    assert field.marginals(tokens) == pytest.approx(both[:, 1] / both.sum(1))


def test_gradient_equals_differences():
    from itertools import product

    rng = np.random.default_rng(2)
    texts = [([(0,), (), (1,)], [1, 0]), ([(), (1,), (0, 1)], [0, 1]), ([(), ()], []), ([(), (0,), (), (), (1,), ()], [1, 1]), ([(1,)], [0])]
    field = T.Field(2)
    theta = rng.normal(size=9)

    def likelihood(th):
        field.set(th)
        out = 0.0
        for tokens, labels in texts:
            left = iter(labels)
            y = [next(left) if fs else 0 for fs in tokens]
            out += path_score(field, tokens, y) - np.log(sum(np.exp(path_score(field, tokens, z)) for z in product((0, 1), repeat=len(tokens))))
        return out

    field.set(theta.copy())
    got = field.gradient(T._packed([(T.compressed(tokens), labels) for tokens, labels in texts]))
    for i in range(9):
        e = np.zeros(9)
        e[i] = 1e-5
        assert got[i] == pytest.approx((likelihood(theta + e) - likelihood(theta - e)) / 2e-5, abs=1e-4)


def test_long_texts_train_whole():
    from signalmill.llm import toxicity as T

    for size, longest in ((0, 3), (1, 3), (3, 3), (4, 3), (11, 3), (11, 100)):
        seen, gaps = [(i,) for i in range(size)], list(range(1, size + 2))
        parts = T.cut((seen, gaps), longest)
        assert [f for s, _ in parts for f in s] == seen and sum(sum(g) for _, g in parts) == sum(gaps)
        assert all(len(g) == len(s) + 1 and len(s) <= longest for s, g in parts)


def test_features_far_behind_in_long_texts_are_learned(spark):
    from signalmill.llm import toxicity as T

    rows = [(i, "plain words here " * (40 if i % 2 else 300) + ("badbad plain " * 100 + "vileone here" if i % 4 == 0 else "good ones")) for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    new = spark.createDataFrame([(10_001, "a vileone there"), (10_002, "a plain good thing")], "doc_id long, text string")
    model = T.fit(d, y, longest=64)
    best = {r.doc_id: model.evidence(r.text, T._Known(model.ids), {})[0] for r in new.collect()}
    assert best[10_001] > 0.5 > best[10_002], "the word that ends each toxic text is tagged"
