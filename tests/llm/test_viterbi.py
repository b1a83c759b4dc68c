import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalmill.llm import viterbi as V


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer, models

    pieces, of_bytes = V.vocabulary(V.default_model())
    least = min(s for _, s in pieces)
    vocab = [("<unk>", 0.0), *pieces, *((f"<0x{b:02X}>", least) for b in sorted(of_bytes))]
    return Tokenizer(models.Unigram(vocab, 0, True)), V.counter(V.default_model())


@settings(max_examples=200)
@given(text=st.text(alphabet="athe .é\n日😀▁_x1ß\t", max_size=30))
def test_counts_equal_the_public_tokenizer(public, text):
    reference, counter = public
    want = len(reference.encode(V.MARK + text.replace(" ", V.MARK)).ids) if text else 0
    assert counter.count(text)[1] == want


def brute(text, vocab, unknown):
    """All segmentations by recursion: best score; of equals, at each end the one whose last piece starts first."""
    best = {0: (0.0, ())}
    for end in range(1, len(text) + 1):
        options = []
        for a in range(end):
            piece = text[a:end]
            if piece in vocab:
                options.append((best[a][0] + vocab[piece], a, best[a][1] + (piece,)))
            elif end - a == 1:
                options.append((best[a][0] + unknown, a, best[a][1] + (None,)))
        s, _, path = max(options, key=lambda o: (o[0], -o[1]))
        best[end] = (s, path)
    score, path = best[len(text)]
    n = sum(1 for i, p in enumerate(path) if p is not None or i == 0 or path[i - 1] is not None)
    return score, n


@given(st.text(alphabet="abc?", max_size=12), st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=3), st.integers(-6, -1).map(float), min_size=1, max_size=8))
def test_small_vocabularies_equal_brute_force(text, vocab):
    counter = V.Counter(list(vocab.items()), set())
    got = counter.segment(text)
    want = brute(text, vocab, min(vocab.values()) - 10)
    assert got == (pytest.approx(want[0]), want[1])


def test_rows(spark):
    d = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "the cat", 5), (3, "the cat", 5), (None, "x" * 5000, 5)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_tokens) for r in V.count_tokens(d).collect()))
    assert got[1:3] == [(1, 0), (2, 0)] and got[3] == got[4] and got[3][1] > 0 and got[0][1] > 0
    assert V.count_tokens(d.limit(0)).collect() == []


@given(st.text(alphabet="ab\n▁ x", max_size=30), st.sampled_from([{"▁a": -1.0, "▁": -2.0}, {"a\nb": -1.0, "▁": -2.0}, {"a": -1.0}, {"a▁b": -1.0, "▁": -1.0}]))
def test_parts_are_the_text(text, vocab):
    counter = V.Counter(list(vocab.items()), set())
    assert "".join(counter._parts(text)) == text


def test_a_long_unbroken_text_takes_a_window_of_the_longest_piece():
    import tracemalloc

    counter = V.counter(V.default_model())
    text = "abcde" * 60_000
    counter.segment("warm")
    tracemalloc.start()
    score, n = counter.segment(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 0 and peak < 5 * len(text), "no more than the automaton's copy of the text"
