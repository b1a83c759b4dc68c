import hashlib

import numpy as np
import pytest

from signalmill.llm import partial_distance as P

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string, error int"


def full(x, book):
    d = ((x[:, None, :].astype(object) - book[None, :, :].astype(object)) ** 2).sum(2)
    return np.array([min(range(len(book)), key=lambda k: (row[k], k)) for row in d]), np.array([min(row) for row in d])


def reference(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and digest by the full search; rows of (vec_id, vector, label) with distinct ids."""
    rows = sorted(rows)
    x = np.floor(np.array([v for _, v, _ in rows], np.float64) * 1024).astype(np.int64)
    cut = np.split(x, parts, axis=1)
    books = [c[:entries].copy() for c in cut]
    for _ in range(rounds):
        for c, b in zip(cut, books):
            code, _ = full(c, b)
            for k in set(code.tolist()):
                of = c[code == k]
                b[k] = [int(s) // len(of) for s in of.sum(0)]
    found = [full(c, b) for c, b in zip(cut, books)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b.tolist() for c in e).encode()).hexdigest()
    return {r[0]: ("".join(f"{int(code[i]):02x}" for code, _ in found), int(sum(e[i] for _, e in found))) for i, r in enumerate(rows)}, digest


def rows_of(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y", 1) for i, v, y in rows], SCHEMA)


@pytest.mark.parametrize("shape", [(300, 256, 16), (50, 7, 5), (40, 1, 1), (64, 256, 2), (200, 30, 64)])
@pytest.mark.parametrize("spread", [2, 300, 2**20])
def test_search_is_the_full_search_ties_included(shape, spread):
    rng = np.random.default_rng(sum(shape) + spread)
    n, k, d = shape
    x, book = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-spread, spread + 1, (k, d))
    book[k // 2 :: 3] = book[0]
    x[::7] = book[rng.integers(0, k, len(x[::7]))]
    code, error = P.search(x, book)
    want, least = full(x, book)
    assert (code == want).all() and (error == least).all()


def test_rounds_against_the_full_search(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 8))
    rows = [(int(i), (centres[i % 20] + rng.normal(size=8) * 0.05).astype(np.float32).tolist(), int(i % 3) or None) for i in rng.permutation(400)]
    want, digest = reference(rows)
    d = rows_of(spark, rows)
    for n in (1, 7):
        got = P.compress(d.repartition(n)).collect()
        assert {r.vec_id: (r.code, r.error) for r in got} == want and {r.codebooks_sha256 for r in got} == {digest}
    label = {i: y for i, _, y in rows}
    for r in got:
        assert r.label_error == sum(e for i, (_, e) in want.items() if label[i] == label[r.vec_id])


def test_unused_entries_stay_and_repeated_rows_are_coded_each(spark):
    rows = [(i, [0.5, -0.5, 0.0, 1.0], 1) for i in range(10)] + [(10, [1.0, 1.0, 1.0, 1.0], None)] * 2
    got = P.compress(rows_of(spark, rows)).collect()
    assert len(got) == 12 and {r.code for r in got if r.vec_id < 10} == {"00000000"} and all(r.error == 0 for r in got)
    books = [[512] * 10 + [1024], [-512] * 10 + [1024], [0] * 10 + [1024], [1024] * 11]
    assert got[0].codebooks_sha256 == hashlib.sha256(",".join(str(c) for b in books for c in b).encode()).hexdigest()
    assert [r.code for r in got if r.vec_id == 10] == ["0a0a0a00"] * 2


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.25] * 6, 1), (1, [0.5] * 6, 2), (2, None, 1), (3, [nan] * 6, 1), (4, [inf] * 6, 1), (5, [None] * 6, 1), (6, [], 1), (7, [0.5] * 3, 1), (None, [0.5] * 6, None), (1, [0.75] * 6, 2)]
    got = sorted(((r.vec_id if r.vec_id is not None else -1), r.code, r.error, r.label_error) for r in P.compress(rows_of(spark, rows)).collect())
    # Six components are filled up to eight; the vectors 0.5 (also without id) and 0.75 have the mean 597.
    assert [g[:2] for g in got] == [(-1, "01010100"), (0, "00000000"), (1, "01010100"), (1, "01010100")]
    assert got[0][2] == got[0][3] == 6 * (597 - 512) ** 2 and got[2][3] == got[3][3] == 6 * ((597 - 512) ** 2 + (768 - 597) ** 2)
    assert P.compress(rows_of(spark, rows).limit(0)).collect() == [] and P.compress(rows_of(spark, [(1, None, 1)])).collect() == []
    assert [(r.code, r.error) for r in P.compress(rows_of(spark, [(None, [1.0] * 4, 1)])).collect()] == [(None, None)]
    with pytest.raises(Exception, match="too large"):
        P.compress(rows_of(spark, [(1, [1e30] * 4, 1)])).collect()
