"""Best-fit packing with exact-complement hashing.

Documents become token ids plus an end id; longer ones than a sequence are cut. Which pieces share a sequence depends
on lengths alone, so the plan is made from the histogram of lengths (at most ``size`` counts, whatever the corpus):

1. Exact complements: single lengths, pairs and triples of the lengths that occur are indexed by their sum. For each
   length, longest first, what fills its gap exactly is looked up by the gap - a length, then a pair, then a triple -
   and consumed as often as the counts still available allow.
2. Best fit, longest first, of the rest, again by counts: a length goes to the open sequences with the least room that
   holds it.

   Three orders are tried and the plan with the fewest sequences is taken: all three complements length by length;
   singles for all lengths, then pairs, then triples; and singles for all lengths, best fit down to an eighth of a
   sequence, then complements of the open sequences' rooms from the short lengths that are left, and best fit to the end.

A plan is a list of slots: pieces of a length with ranks from a to b lie at an offset in consecutive sequences.

Scale: texts are tokenised once, in one narrow pass that keeps lengths and checksums, written to the shared folder. Ranks
inside a length are counted per (length, salt), so that a length which a third of the pieces have is dealt over many
tasks; the slots (bounded by the plan, not the data) are broadcast.

Defined results: null text is empty and gives the end id alone; texts of any length are tokenised whole and cut into pieces;
pieces of equal length take their places in the order of a hash of (doc_id, piece, checksum), then of these themselves, so
every column is the same for any partitioning of the input; rows without doc_id are packed too, but are dealt by their
tasks so that many of them are no hot group: which of their places is whose may differ between runs; repeated rows are
packed each and share their places; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release_memory, worker_cache

SIZE = 4096
END_ID = 1
# Fixed value: how the tokenizer cuts normalised text.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Texts with characters beyond extended Latin (below, all are composed already), with a dotted capital I, or with what
#: may be a special token.
_ODD = r"[^\x{0}-\x{24f}]|\x{130}|<\|"
_BYTES = 5_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids as little-endian 32-bit bytes, equal to encoding the whole text.

    The tokenizer's normalisation and cuts never reach across a space or line feed, so the ids of a text are those of
    its parts between them; parts and the pieces they are cut into are remembered. What the shortcut is not sure
    to cut alike (anything but printable Latin, or special tokens' strings) goes to the tokenizer itself.
    """

    LIMIT = 700_000

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.tokenizer = path, None
        # For pieces, which are normalised and cut already: the model without those steps.
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = None
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.cut = regex.compile(_CUT).findall
        self.known: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        """The ids by the tokenizer itself."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_pieces(self, new: list[str]) -> None:
        """Encode pieces together, one apart from the next by a space; each ends with its only end-of-word token."""
        ids = np.array(self.model.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(new):
            raw, at = ids.tobytes(), 0
            for piece, stop in zip(new, (stops * 4).tolist()):
                self.known[piece] = raw[at:stop]
                at = stop
        else:
            self.known.update((piece, self._whole(piece)) for piece in new)

    def _learn(self, parts: set[str], keep_all: bool = False) -> None:
        if len(self.known) > self.LIMIT and not keep_all:
            self.known = {"": b""}
        known, cuts = self.known, {}
        for p in parts:
            plain = p.isascii() or (max(p) < "ɐ" and unicodedata.is_normalized("NFC", p))
            if plain and p.isprintable() and "<|" not in p:
                cuts[p] = self.cut(p.lower())
            else:
                known[p] = self._whole(p)
        new = list({c for cut in cuts.values() for c in cut if c not in known})
        if new:
            self._learn_pieces(new)
        for p, cut in cuts.items():
            if p not in known:
                known[p] = b"".join([known[c] for c in cut])

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        parts = text.replace("\n", " ").split(" ")
        missing = {p for p in parts if p not in self.known}
        if missing:
            self._learn(missing)
        known = self.known  # emptied if it was full: what is gone is encoded again
        return b"".join([known[p] if p in known else self._whole(p) for p in parts])

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null is empty. Plain Latin texts are cut, and their parts told apart, all at once."""
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
        # Lower case and a space before a lone mark at a word's end change no ids and make parts recur.
        plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"([a-z])([.,])([ \n])", r"\1 \2\3")
        if len(odd):
            keep = np.ones(len(texts), bool)
            keep[odd] = False
            plain = pc.if_else(pa.array(keep), plain, "")
        cut = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        missing = [p for p in distinct if p not in self.known]
        if len(self.known) + len(missing) > self.LIMIT:
            self.known, missing = {"": b""}, distinct
        if missing:
            self._learn({p for p in missing if p not in self.known}, keep_all=True)
        ids = [self.known[p] for p in distinct]
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        index = words.indices.to_numpy(zero_copy_only=False)
        taken = sizes[index]
        ends = np.concatenate([[0], np.cumsum(taken)])
        raw = flat[np.repeat((first[index] - ends[:-1]).astype(np.int32), taken) + np.arange(ends[-1], dtype=np.int32)].tobytes()
        at = (ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()] * 4).tolist()
        out = [raw[a:b] for a, b in zip(at, at[1:])]
        for i in odd.tolist():
            out[i] = self.encode(texts[i].as_py())
        return out


def encoder(path: str) -> Encoder:
    """The process' encoder for a tokenizer file."""
    cache = worker_cache("encoders")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def _encoded(enc: Encoder, texts: pa.Array):
    """The ids of a batch's texts, by parts of about ``_BYTES`` so that intermediate arrays stay small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _BYTES, side="right")))
        yield from enc.encode_many(texts.slice(a, b - a))
        a = b


def tokenised(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 and salt, a number that deals equal lengths evenly: a hash of the row, or counted where doc_id is null."""

    def run(batches):
        enc, n = encoder(path), None
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, pieces, starts, lengths, crcs, salts = [], [], [], [], [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), _encoded(enc, batch.column(1))):
                raw += end
                for k, a in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[a : a + 4 * size]
                    crc = zlib.crc32(part)
                    if doc_id is None:
                        n = crc if n is None else n + 1
                        salt = n
                    else:
                        salt = zlib.crc32(struct.pack("<qqI", doc_id, k, crc))
                    ids.append(doc_id), pieces.append(k), starts.append(a // 4)
                    lengths.append(len(part) // 4), crcs.append(crc), salts.append(salt & 0xFFFF)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip((ids, pieces, starts, lengths, crcs, salts), kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
            )
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt int")


class Sums:
    """The single lengths, pairs and triples of some lengths, by their sum up to ``size``."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.lengths, self.size = np.sort(lengths), size
        self.single = np.zeros(size + 1, bool)
        self.single[self.lengths] = True
        # Of a pair the larger length is kept; those of one sum follow each other, largest first.
        of = [(x, self.lengths[: np.searchsorted(self.lengths, min(x, size - x), "right")]) for x in self.lengths[::-1].tolist()]
        large = np.concatenate([np.full(len(small), x, np.int32) for x, small in of] or [np.zeros(0, np.int32)])
        sums = large + np.concatenate([small.astype(np.int32) for _, small in of] or [np.zeros(0, np.int32)])
        self.large = large[np.argsort(sums, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(sums, minlength=size + 1))])
        self._triples: dict[int, np.ndarray] = {}

    def pairs(self, total: int) -> np.ndarray:
        """The larger lengths of the pairs with this sum, largest first."""
        return self.large[self.at[total] : self.at[total + 1]]

    def triples(self, total: int) -> np.ndarray:
        """The largest lengths of the triples with this sum, largest first; the other two are a pair."""
        if total not in self._triples:
            y = self.lengths[(self.lengths < total) & (3 * self.lengths >= total)][::-1]
            rest = total - y
            has = self.at[rest + 1] > self.at[rest]
            # Pairs are largest first, so the last one's larger length is the least there is.
            fits = has & (self.large[np.maximum(self.at[rest + 1] - 1, 0)] <= y) if len(self.large) else has
            self._triples[total] = y[fits]
        return self._triples[total]


class Plan:
    """Sequences for a histogram of lengths: ``slots`` rows (length, from, to, sequence, offset, per)."""

    def __init__(self, counts: dict[int, int], size: int = SIZE, passes: tuple[tuple[int, ...], ...] = ((1, 2, 3),), late: int = 0):
        """``passes`` over the lengths, each seeking complements of so many lengths in turn. From ``late`` down, lengths
        are first sought as complements of what best fit left open."""
        self.size, self.late = size, late
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            if not 1 <= length <= size:
                raise ValueError(f"length {length}")
            self.left[length] = n
        self.total = self.left.copy()
        self.next = np.zeros(size + 1, np.int64)
        self.slots: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.sums = Sums(np.flatnonzero(self.left), size)
        for sought in passes:
            for x in range(size, 0, -1):
                for n in sought:
                    if self.left[x]:
                        self._complement(x, n)
        self._best_fit()

    def _emit(self, pattern: list[tuple[int, int]], times: int) -> None:
        """``times`` sequences of a pattern of (length, how many)."""
        offset = 0
        for length, per in pattern:
            a = int(self.next[length])
            self.next[length] = b = a + per * times
            self.slots.append((length, a, int(b), self.sequences, offset, per))
            offset += per * length
        self.sequences += times

    def _consume(self, lengths: tuple[int, ...], most: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The lengths as a pattern, and how often the counts (and ``most``) allow to consume them together."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(self.left[x]) // k for x, k in need.items())
        times = times if most is None else min(times, most)
        for x, k in need.items():
            self.left[x] -= k * times
        return sorted(need.items(), reverse=True), times

    def _take(self, lengths: tuple[int, ...]) -> None:
        """Consume the lengths together as often as the counts allow, each time as one sequence."""
        pattern, times = self._consume(lengths)
        if times:
            self._emit(pattern, times)

    def _complement(self, x: int, n: int) -> None:
        """Consume ``x`` with what fills its gap by ``n`` lengths, none of them longer than it."""
        gap, left = self.size - x, self.left
        if gap == 0:
            self._take((x,))
        elif n == 1:
            if gap <= x and self.sums.single[gap]:
                self._take((x, gap))
        elif n == 2:
            self._pairs((x,), gap, x)
        else:
            y = self.sums.triples(gap)
            for y in y[(y <= x) & (left[y] > 0)].tolist():
                if not left[x]:
                    break
                if left[y]:
                    self._pairs((x, y), gap - y, y)

    def _pairs(self, held: tuple[int, ...], gap: int, most: int) -> None:
        """Consume ``held`` with the pairs that fill ``gap``, their larger length at most ``most``."""
        for y in self._open_pairs(gap, most):
            if not all(self.left[x] for x in held):
                break
            self._take((*held, y, gap - y))

    def _close(self, rooms: dict[int, list[list]], has: np.ndarray) -> None:
        """Fill open sequences exactly by single lengths, pairs and triples of at most ``late``."""
        for room in np.flatnonzero(has)[::-1].tolist():
            groups = rooms[room]
            for lengths in self._fillings(room):
                while groups:
                    pattern, times = self._consume(lengths, groups[-1][1])
                    if not times:
                        break
                    rooms.setdefault(0, []).append([[*groups[-1][0], *pattern], times])
                    groups[-1][1] -= times
                    if not groups[-1][1]:
                        groups.pop()
                if not groups:
                    break
            has[room] = bool(groups)

    def _fillings(self, room: int):
        """The available single length, pairs and triples of at most ``late`` that fill a room, as they are asked for."""
        most, left = min(room, self.late), self.left
        if room <= self.late and left[room]:
            yield (room,)
        for y in self._open_pairs(room, most):
            yield (y, room - y)
        triples = self.sums.triples(room)
        for y in triples[(triples <= most) & (left[triples] > 0)].tolist():
            if left[y]:
                for z in self._open_pairs(room - y, y):
                    yield (y, z, room - y - z)

    def _open_pairs(self, total: int, most: int) -> list[int]:
        """The larger lengths of the pairs of this sum that are available, none longer than ``most``."""
        a, left = self.sums.pairs(total), self.left
        return a[(a <= most) & (left[a] > 0) & (left[total - a] > 0)].tolist()

    def _best_fit(self) -> None:
        """Open sequences by room: room -> list of [pattern, times]."""
        size, left = self.size, self.left
        rooms: dict[int, list[list]] = {}
        has = np.zeros(size + 1, bool)
        for x in range(size, 0, -1):
            if x == self.late:
                self._close(rooms, has)
            n = int(left[x])
            while n:
                fit = np.flatnonzero(has[x:])
                if not len(fit):
                    break
                room = int(fit[0]) + x
                pattern, times = rooms[room].pop()
                # As many as the room holds go in at once: after the first, the same sequence fits best again.
                per = room // x
                if n >= per:
                    used = min(times, n // per)
                    put = per
                else:
                    used, put = 1, n
                if used < times:
                    rooms[room].append([pattern, times - used])
                has[room] = bool(rooms[room])
                new = room - put * x
                rooms.setdefault(new, []).append([[*pattern, (x, put)], used])
                has[new] = new > 0
                n -= used * put
            if n:
                per = size // x
                full, rest = divmod(n, per)
                for put, times in ((per, full), (rest, 1 if rest else 0)):
                    if times:
                        new = size - put * x
                        rooms.setdefault(new, []).append([[(x, put)], times])
                        has[new] = new > 0
            left[x] = 0
        for groups in rooms.values():
            for pattern, times in groups:
                self._emit(pattern, times)


def best_plan(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Of the three orders the plan with the fewest sequences, the first of equals."""
    least = -(-sum(k * n for k, n in counts.items()) // size)
    plans = []
    for passes, late in ((((1, 2, 3),), 0), (((1,), (2,), (3,)), 0), (((1,),), size // 8)):
        plans.append(Plan(counts, size, passes, late))
        if plans[-1].sequences == least:
            break
    return min(plans, key=lambda p: p.sequences)


def _placed(ranked: DataFrame, plan: Plan) -> DataFrame:
    slots = np.array(sorted(plan.slots), np.int64).reshape(-1, 6)
    shared = ranked.sparkSession.sparkContext.broadcast(slots)

    def run(batches):
        table = shared.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            step, within = np.divmod(rank - table[at, 1], table[at, 5])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(table[at, 3] + step), pa.array(table[at, 4] + within * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, rows_per_salt: int = 500_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    pieces = materialize(tokenised(docs, tokenizer or default_tokenizer(), size), "op4-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = min(1 << 16, max(64, sum(histogram.values()) // rows_per_salt))
    dealt = pieces.withColumn("salt", F.pmod("salt", F.lit(salts)))
    per = dealt.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("r", F.row_number().over(within)).join(base, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") - 1 + F.col("base")).alias("rank"))
    return _placed(ranked, best_plan(histogram, size))
