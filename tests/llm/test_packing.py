import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalmill.llm import packing as P


@pytest.fixture(scope="module")
def enc():
    return P.Encoder(P.default_tokenizer())


PARTS = [*"abZ .,'s!-\n\t09éßΣσİı\u0308ﬁǅΩ日\u00a0\u200b|<>\x1c", "e\u0301", "<|endoftext|>", "don't", "ABC. "]
TEXT = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_shortcut_equals_the_tokenizer(text):
    enc = P.encoder(P.default_tokenizer())
    for _ in range(2):
        assert enc.encode(text) == enc._whole(text)
        assert enc.encode_many(pa.array(["x", text, None, "y. z"])) == [enc._whole(t) for t in ("x", text, "", "y. z")]


def test_full_caches_change_nothing(enc):
    enc.LIMIT = 3
    text = "one two three. Four, five six seven " * 3
    for other in (text, "eight nine ten", text.upper()):
        assert enc.encode(other) == enc._whole(other)
        assert enc.encode_many(pa.array([other])) == [enc._whole(other)]


def check_plan(plan, counts, size):
    at: dict[int, list] = {}
    used = Counter()
    for length, a, b, seq, offset, per in plan.slots:
        for r in range(a, b):
            at.setdefault(seq + (r - a) // per, []).append((offset + (r - a) % per * length, length))
            used[length, r] += 1
    assert all(v == 1 for v in used.values()) and Counter(k for k, _ in used) == Counter({k: v for k, v in counts.items() if v})
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    assert len(at) == plan.sequences


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12), st.sampled_from([((1, 2, 3),), ((1,), (2,), (3,)), ((3,),), ()]), st.sampled_from([0, 4, 8, 15, 30]))
def test_plans_place_every_piece_once_without_gaps(counts, passes, late):
    check_plan(P.Plan(counts, 30, passes, late), counts, 30)


@given(st.sets(st.integers(1, 40), max_size=12))
def test_sums_of_pairs_and_triples_equal_enumeration(lengths):
    from itertools import combinations_with_replacement as chosen

    sums = P.Sums(np.array(sorted(lengths), np.int64), 40)
    for total in range(1, 41):
        assert sums.single[total] == (total in lengths)
        assert sums.pairs(total).tolist() == sorted((max(c) for c in chosen(lengths, 2) if sum(c) == total), reverse=True)
        assert sums.triples(total).tolist() == sorted({max(c) for c in chosen(lengths, 3) if sum(c) == total}, reverse=True)


def best_fit_decreasing(lengths, size):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(size - x)
    return len(rooms)


def fewest(lengths, size):
    """The least number of sequences, by trying all."""
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[i]:
                rest = list(rooms)
                rest.remove(r)
                place(i + 1, [*rest, r - lengths[i]])
        place(i + 1, [*rooms, size - lengths[i]])

    place(0, [])
    return best[0]


def test_sequences_against_reference_packers():
    rng = random.Random(9)
    plan = wanted = fitted = 0
    for _ in range(60):
        lengths = sorted((rng.randint(1, 25) for _ in range(9)), reverse=True)
        got = P.best_plan(Counter(lengths), 25).sequences
        least = fewest(lengths, 25)
        assert least <= got <= least + 1
        plan, wanted = plan + got, wanted + least
    assert plan <= 1.03 * wanted
    plan = 0
    for _ in range(20):
        lengths = [min(4096, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(1500)]
        plan += P.best_plan(Counter(lengths)).sequences
        fitted += best_fit_decreasing(lengths, 4096)
    assert plan <= fitted


def test_exact_complements_fill_sequences():
    plan = P.Plan({6: 5, 4: 5, 10: 2, 3: 2, 5: 1, 2: 1}, 10)
    assert plan.sequences == 5 + 2 + 2
    rng = random.Random(3)
    counts = Counter(rng.randint(1, 4096) for _ in range(5000))
    plan = P.best_plan(counts)
    check_plan(plan, counts, 4096)
    halves = sum(v for k, v in counts.items() if k > 2048)
    assert plan.sequences <= 1.01 * max(halves, sum(k * v for k, v in counts.items()) / 4096)


def test_documents_with_nulls_ties_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "word " * 9000)] + [(i, "same text") for i in range(10, 200)]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, length int")
    out = P.pack(d).collect()
    enc = P.Encoder(P.default_tokenizer())
    want = Counter()
    for i, t in rows:
        ids = np.frombuffer(enc._whole(t or "") + np.array([1], "<u4").tobytes(), "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by: dict[int, list] = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == list(np.cumsum([0] + [n for _, n in sorted(places)])[:-1]) and sum(n for _, n in places) <= 4096
    assert len(by) == -(-sum(r.length for r in out) // 4096)
    assert P.pack(d.limit(0)).collect() == []


def test_places_are_the_same_for_any_partitions(spark):
    rows = [(i, "same text" if i % 3 else "other text here") for i in range(3000)] + [(7, "same text")] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(tuple, P.pack(d.repartition(n)).collect())) for n in (1, 3, 16)]
    assert got[0] == got[1] == got[2]
