import random

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from signalmill.llm import simhash as S


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@given(st.text(alphabet="aB \n\té\x0b x.", max_size=60))
def test_fingerprint_equals_its_definition(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def brute_components(rows):
    ids, fps = [r[0] for r in rows], [r[1] for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 4:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            k = find(i)
            out[k] = min(out.get(k, ids[i]), ids[i])
    return sorted(((ids[i], out.get(find(i))) for i in range(len(rows))), key=str)


def test_covering_triples_cover_every_four_positions():
    from itertools import combinations

    triples = S.covering_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(q) for t in triples) for q in combinations(range(8), 4))


@pytest.mark.parametrize("limit", [4096, 16, 2])
def test_links_equal_brute_force(spark, limit):
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(25)} | {0, 2**64 - 1}
    signed = sorted(int(np.uint64(f).view(np.int64)) for f in fps)
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    from signalmill.llm.common import components

    roots = {r.node: r.root for r in components(S.fingerprint_links(nodes, limit), "test").collect()}
    got = sorted((f, roots.get(f, f)) for f in signed)
    assert got == sorted(brute_components([(f, f) for f in signed]))


def test_documents_with_nulls_copies_and_short_texts(spark):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w17 ", "x ")
    rows = [(5, base), (3, base), (9, near), (None, base), (1, None), (2, ""), (2, ""), (4, "Hi there"), (7, "hi  THERE"), (8, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, root string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    signed = [(i, brute_fingerprint(t)) for i, t in rows]
    assert got == brute_components(signed)
    assert S.near_duplicates(docs.limit(0)).collect() == []


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    got = S.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{brute_fingerprint(r.text):016x}" for r in docs.collect()}


def test_dense_neighbourhoods_equal_brute_force(spark):
    """A list of far more nodes than the limit, in which four and five bytes are shared by most."""
    from signalmill.llm.common import components

    rng = random.Random(3)
    fps = {0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 9))) for _ in range(400)}
    signed = sorted(int(np.uint64(f).view(np.int64)) for f in fps)
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in components(S.fingerprint_links(nodes, 20), "test").collect()}
    assert sorted((f, roots.get(f, f)) for f in signed) == sorted(brute_components([(f, f) for f in signed]))


def test_representatives_with_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, 1), (3, base, 2), (3, base, 1), (None, base, 3), (9, "other words here", 4)]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, K int, _gone string, kk string")
    got = S.keep_representatives(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or -1, r.K) for r in got.collect()) == [(-1, 3), (3, 1), (9, 4)]
