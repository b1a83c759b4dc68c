"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items scans each text once.

Words are maximal runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. A window is ``window``
consecutive words of a benchmark item, or the whole item if it has fewer words (an item without words has none). A
document word inside any occurrence of a window is hit.

The automaton reads words, numbered by the benchmark's vocabulary. Its patterns are the items' blocks of half a window,
end to end, and the whole of items shorter than a window. Every window holds one whole block first; around a block that is
met, the words of a window to either side are compared, and what reaches a window's length is hit. So each word of an item
is in one pattern, not in ``window`` of them, and the automaton is about as long as the benchmark. Blocks with the same
words around them are one place with several items, so a run of one repeated word costs no more than other text.

Scale: the automaton holds the benchmark only; its texts are gathered in blocks of at most ``block_bytes`` bytes. The driver
and a process hold one block (some 50 bytes a byte of text), whatever the benchmark's size: one block is one narrow pass over
the documents; of several each has tasks of its own, which write the hit texts' digests and runs of words, and a join by
digest brings them to the rows. A process keeps the block it built, named by its content, so it builds once a block; passes of
several blocks have processes of their own, no more than run at once, whatever other steps have left idle. A single
item may exceed a block and then has one of its own.

Defined results: null or empty text has no words and no hits; texts of any length are scanned whole; null ``item_id``
items are ignored, a null item text has no windows; repeated rows each give a row; equal windows of several items count for
each item, items are listed by their ids as texts; other columns of either input are ignored; with no items every document
is clean; without documents there are no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import materialize, release_memory, utf8, worker_cache

#: A-Z to a-z, other ASCII that is no digit or lower-case letter to a space, the bytes of other characters kept.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_ORIGINAL = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return utf8(text).translate(_WORDS).split()


class Matcher:
    """The automaton of some items and what is needed to follow its matches."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.window = window
        self.number: dict[bytes, int] = {}
        ids: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words_ = tuple([self.number.setdefault(w, len(self.number) + 1) for w in words(text)])
            if words_:
                ids.setdefault(words_, set()).add(item_id)
        self.items = [array("i", w) for w in ids]
        self.half = max(1, window // 2)
        #: Words of a window before its first whole block, and behind it.
        self.before, self.behind = self.half - 1, window - self.half
        short: dict[tuple[int, ...], set[str]] = {}
        places: dict[tuple[int, ...], dict[tuple, list]] = {}
        for k, (w, names) in enumerate(ids.items()):
            if len(w) < window:
                short[w] = names
                continue
            for a in range(0, len(w) - self.half + 1, self.half):
                around = (w[max(0, a - self.before) : a], w[a + self.half : a + self.half + self.behind])
                same = places.setdefault(w[a : a + self.half], {}).setdefault(around, [k, a, names])
                same[2] = same[2] if names <= same[2] else same[2] | names
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if ids else None
        for pattern in short.keys() | places.keys():
            # Places are looked up by the word behind the block, which each of their windows holds.
            follow: dict[int, list] = {}
            for (_, right), place in places.get(pattern, {}).items():
                if len(right) or not self.behind:
                    follow.setdefault(right[0] if right else -1, []).append(tuple(place))
            self.auto.add_word(pattern, (len(pattern), short.get(pattern, ()), follow))
        if ids:
            self.auto.make_automaton()

    def scan(self, normal: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [from, to) word intervals that are hit, and the items that occur."""
        get = self.number.get
        text = tuple([get(w, 0) for w in normal])
        items: set[str] = set()
        spans: list[tuple[int, int]] = []
        for last, (size, short, follow) in self.auto.iter(text) if self.auto is not None and any(text) else ():
            i, j = last + 1 - size, last + 1
            if short:
                spans.append((i, j))
                items |= short
            if not follow:
                continue
            for k, a, names in follow.get(text[j] if self.behind and j < len(text) else -1, ()):
                item, b = self.items[k], a + size
                x = min(self.before, a, i)
                left = next((n for n in range(x) if text[i - 1 - n] != item[a - 1 - n]), x)
                y = min(self.behind, len(item) - b, len(text) - j)
                right = next((n for n in range(y) if text[j + n] != item[b + n]), y)
                if left + size + right >= self.window:
                    spans.append((i - left, j + right))
                    items |= names
        return _merge(spans), items


def matcher(key: str, items: list[tuple[str, str]], window: int) -> Matcher:
    """The process' matcher of a block; one is kept."""
    cache = worker_cache("matchers")
    if key not in cache:
        cache.clear()
        cache[key] = Matcher(items, window)
    return cache[key]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_bytes`` at most."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) if total else 0
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items] * n


def _shared(spark: SparkSession, block: DataFrame | None, window: int) -> tuple[str, Broadcast]:
    """A block's items for the tasks, and a name that equal blocks share."""
    items = sorted((r[0], r[1]) for r in block.collect()) if block is not None else []
    digest = hashlib.sha256(repr((window, items)).encode("utf-8", "surrogatepass"))
    return digest.hexdigest(), spark.sparkContext.broadcast(items)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8_000_000, keep: list[str] | None = None) -> DataFrame:
    """Per document row: the columns ``keep`` (default doc_id), n_words, n_hit, items (sorted), spans.

    ``spans`` are the hit runs of words as "start:end" code-point offsets into the original text, comma-joined.
    """
    keep = keep or ["doc_id"]
    rows, blocks = docs.select(*dict.fromkeys([*keep, "text"])), _blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        return _joined(rows, _hits(rows, blocks, window), keep)
    key, shared = _shared(docs.sparkSession, blocks[0] if blocks else None, window)
    schema = StructType([rows.schema[c] for c in keep])
    schema = schema.add("n_words", LongType()).add("n_hit", LongType()).add("items", ArrayType(StringType())).add("spans", StringType())
    at, where = [rows.columns.index(c) for c in keep], rows.columns.index("text")

    def run(batches):
        auto = matcher(key, shared.value, window)
        for batch in batches:
            n_words, n_hit, found, places = [], [], [], []
            for text in batch.column(where):
                text = text.as_py()
                normal = words(text)
                runs, ids = auto.scan(normal)
                n_words.append(len(normal))
                n_hit.append(sum(b - a for a, b in runs))
                found.append(sorted(ids))
                places.append(",".join(f"{s}:{e}" for s, e in _offsets(text, runs)))
            own = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(places, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in at] + own, names=schema.names)
        release_memory()

    return rows.mapInArrow(run, schema)


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code points of the original text."""
    places = [m.span() for m in _ORIGINAL.finditer(text)] if runs else []
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


_RUN = "struct<from:int,to:int,start:int,end:int>"


@contextmanager
def _own_processes(spark: SparkSession):
    """Functions that are handed to Spark within run in Python processes that no others use.

    Spark keeps idle processes by their environment and takes them in turn: steps with several functions a task leave more
    than there are cores, and each would build every block.
    """
    environment = spark.sparkContext.environment
    environment["SIGNALMILL_PROCESSES"] = "op10-blocks"
    try:
        yield
    finally:
        environment.pop("SIGNALMILL_PROCESSES", None)


def _hits(docs: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """The digest of each text that a block hits, once a block: the hit runs in words and code points, the items.

    Every block's pass is a branch of a union, so its tasks are its own; branches run one after the other.
    """
    schema = f"digest string, runs array<{_RUN}>, items array<string>"
    texts, branches = docs.where("text is not null").select(F.sha2("text", 256).alias("digest"), "text"), []
    for number, block in enumerate(blocks):
        key, shared = _shared(docs.sparkSession, block, window)

        def run(batches, key=key, shared=shared):
            auto = matcher(key, shared.value, window)
            for batch in batches:
                digests, hit, found = [], [], []
                for digest, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py()
                    runs, ids = auto.scan(words(text))
                    if runs:
                        digests.append(digest.as_py())
                        hit.append([{"from": a, "to": b, "start": s, "end": e} for (a, b), (s, e) in zip(runs, _offsets(text, runs))])
                        found.append(sorted(ids))
                run_type = pa.struct([(c, pa.int32()) for c in ("from", "to", "start", "end")])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.string()), pa.array(hit, pa.list_(run_type)), pa.array(found, pa.list_(pa.string()))], names=["digest", "runs", "items"]
                )
            release_memory()

        with _own_processes(docs.sparkSession):
            branches.append(texts.mapInArrow(run, schema).withColumn("block", F.lit(number)))
    # Copies of a text have equal runs: one a block is kept, before anything is exchanged.
    once = reduce(DataFrame.union, branches).groupBy("digest", "block").agg(F.min("runs").alias("runs"), F.min("items").alias("items"))
    # A list has one entry a block at most.
    by_text = once.groupBy("digest").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return materialize(by_text, "op10-hits")


def _joined(docs: DataFrame, hits: DataFrame, keep: list[str]) -> DataFrame:
    """The rows with what all blocks found: runs that meet or overlap are one."""

    def grow(done, x):
        last = F.element_at(done, -1)
        wider = F.struct(last["from"].alias("from"), F.greatest(last["to"], x["to"]).alias("to"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["to"] < x["from"])
        return F.when(apart, F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider)))

    merged = F.aggregate(F.array_sort("runs"), F.array().cast(f"array<{_RUN}>"), grow)
    found = hits.select("digest", merged.alias("_runs"), F.col("items").alias("_items"))
    n_words = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    # Only the digest moves with a row, not its text.
    rows = docs.select(F.struct(*keep).alias("_row"), n_words.cast("long").alias("n_words"), F.sha2("text", 256).alias("digest")).join(found, "digest", "left")
    none = F.array().cast(f"array<{_RUN}>")
    runs = F.coalesce("_runs", none)
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in keep], "n_words",
        F.aggregate(runs, F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"]).alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
        F.array_join(F.transform(runs, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8_000_000) -> DataFrame:
    """The document rows, with all their columns, in which no window of any item occurs.

    One block is a narrow filter; the texts that several blocks hit are joined out by digest."""
    at, blocks = docs.columns.index("text"), _blocks(benchmark, block_bytes)
    if not blocks:
        return docs
    if len(blocks) > 1:
        hit = _hits(docs, blocks, window).select(F.col("digest").alias("_hit_digest"))
        return docs.join(hit, F.sha2(docs["text"], 256) == hit["_hit_digest"], "left_anti")
    key, shared = _shared(docs.sparkSession, blocks[0], window)

    def run(batches):
        auto = matcher(key, shared.value, window)
        for batch in batches:
            clean = [not auto.scan(words(x.as_py()))[0] for x in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
