"""Count-only Viterbi segmentation under a unigram vocabulary.

Text is prefixed with a space, and spaces become the word mark. An Aho-Corasick automaton over the vocabulary lists
every piece that ends at each position; dynamic programming carries the best score and its piece count, no
back pointers. Rules of the public unigram tokenizer, exactly:

- of candidates with equal score at a position the one that starts first wins (a later one must be strictly better);
- a position at which no single-character piece starts may be left by an unknown character, scored least score - 10,
  considered after the pieces that start there;
- a run of unknown characters is one unknown piece, replaced by its UTF-8 bytes where the vocabulary has them all.

Scale: one narrow pass. Where no piece crosses, the best path splits: before a run of word marks and around line feeds,
which are in no piece. Parts recur, so each worker remembers theirs in a bounded cache. Parts are met one after another
and the programme holds as many positions as the longest piece has characters, so a text of any length takes no memory
beside itself and a copy.

Defined results: null or empty text has 0 pieces and score 0; texts of any length are read whole; ties go by the rules
above; repeated rows each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

MARK = "▁"
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[tuple[str, float]], set[int]]:
    """(piece, score) of a sentencepiece model's ordinary pieces, and the bytes that have pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, of_bytes = [], set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_bytes.add(int(piece[3:5], 16))
        elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
            pieces.append((piece, model.get_score(i)))
    return pieces, of_bytes


class Counter:
    """Piece counts of texts under a vocabulary of (piece, score)."""

    LIMIT = 1_000_000

    def __init__(self, pieces: list[tuple[str, float]], of_bytes: set[int]):
        import ahocorasick

        best = {p: s for p, s in reversed(pieces) if p}
        self.auto = ahocorasick.Automaton()
        for p, s in best.items():
            self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.unknown = min(best.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, best))
        self.of_bytes = of_bytes
        # A part may start at a mark only if no piece has a mark after another character.
        self.splits = not any(MARK in p.lstrip(MARK) for p in best) and MARK in best
        line_feeds = not any("\n" in p for p in best)
        # Marks and what follows them up to the next one; line feeds by themselves.
        whole = "[^\n]+|\n" if line_feeds else "(?s:.)+"
        word = f"[^{MARK}\n]" if line_feeds else f"[^{MARK}]"
        self.cut = re.compile(f"{MARK}+{word}*|{word}+" + ("|\n" if line_feeds else "") if self.splits else whole)
        self.known: dict[str, tuple[float, int]] = {}

    def _unknown_pieces(self, run: str) -> int:
        raw = run.encode("utf-8", "surrogatepass")
        return len(raw) if self.of_bytes.issuperset(raw) else 1

    def segment(self, text: str) -> tuple[float, int]:
        """Best score and its number of pieces, by the whole dynamic programme."""
        size = self.longest + 1
        none = float("-inf")
        # Position i is kept at i modulo size. run: length of the unknown run that the best path there ends with; its pieces
        # are counted when it ends.
        score, count, run = [0.0] + [none] * self.longest, [0] * size, [0] * size
        matches = self.auto.iter(text)
        match = next(matches, None)
        for end in range(1, len(text) + 1):
            best, kept, length, single = none, 0, 0, False
            while match is not None and match[0] == end - 1:  # longest first, so the earliest start wins a tie
                n, s = match[1]
                single = n == 1
                a = (end - n) % size
                if score[a] + s > best:
                    best, length = score[a] + s, 0
                    kept = count[a] + 1 + (self._unknown_pieces(text[end - n - run[a] : end - n]) if run[a] else 0)
                match = next(matches, None)
            last = (end - 1) % size
            if not single and score[last] + self.unknown > best:
                best, kept, length = score[last] + self.unknown, count[last], run[last] + 1
            i = end % size
            score[i], count[i], run[i] = best, kept, length
        i = len(text) % size
        return score[i], count[i] + (self._unknown_pieces(text[len(text) - run[i] :]) if run[i] else 0)

    def _parts(self, text: str):
        """The text cut where no piece crosses, part by part."""
        return (m[0] for m in self.cut.finditer(text))

    def count(self, text: str | None) -> tuple[float, int]:
        """Best score and number of pieces of a text."""
        if not text:
            return 0.0, 0
        score, n, known = 0.0, 0, self.known
        for part in self._parts(MARK + text.replace(" ", MARK)):
            got = known.get(part)
            if got is None:
                got = self.segment(part)
                if len(part) <= 64:
                    if len(known) > self.LIMIT:
                        known.clear()
                    known[part] = got
            score += got[0]
            n += got[1]
        return score, n


def counter(path: str) -> Counter:
    """The process' counter for a model file."""
    cache = worker_cache("viterbi")
    if path not in cache:
        cache[path] = Counter(*vocabulary(path))
    return cache[path]


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score per document row."""
    path = model or default_model()

    def run(batches):
        count = counter(path).count
        for batch in batches:
            got = [count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
