"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints within 4 bits differ in at most 4 of their 8 bytes, so they share at least 4 positional bytes
(the guaranteed minimum). Posting lists are read by three positions at once: 20 position triples are enough for every
set of four positions to contain one (a covering design), so each pair that reaches the minimum meets in a list. For
pairs that meet, the shared positional bytes are tallied, pairs below the minimum go, the rest is verified by popcount.

Scale: texts are hashed in one narrow pass; equal fingerprints are one node from then on, so groups of exact copies
cost one row. A list key has 24 bits and its position triple, and each node has 20 postings: about 20 n^2 / 2^25 pairs
for n nodes, below 10 per node at 10^7. Lists of any length are read in the same way; one of more than ``list_limit``
nodes is only dealt differently, without loss: its members are posted again by each further byte (a pair that counts
shares four, so one beside the triple), and a list that is still longer is dealt in pairs of blocks, so that no task
holds more than ``list_limit`` nodes of a list. A task emits a spanning forest, not pairs. Components are found by
distributed star rounds.

Defined results: null, empty or wordless text has fingerprint 0, linked like any other; fewer words than a shingle are
one shingle; a text of any length is hashed whole, in bounded steps; a null ``doc_id`` takes part in links and its
component_id is the smallest non-null id reachable, null if there is none; repeated rows each give a row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, arrow_map, components, materialize, utf8

BITS = 4


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a text: bit set if it is set in over half of the shingles' XXH64, repeats included."""
    import xxhash

    w = utf8(text).translate(ASCII_LOWER).split()
    n = len(w)
    if n == 0:
        return 0
    line = b" ".join(w)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    digest = xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1)
    starts = [0, *ends[: n - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    step = 1 << 16
    for k in range(0, len(stops), step):
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(starts[k : k + step], stops[k : k + step])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(stops)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) per row."""

    def make():
        def step(batch: pa.RecordBatch):
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            return {"doc_id": batch.column(0), "fp": fp}

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, fp long")


def covering_triples() -> list[tuple[int, int, int]]:
    """Position triples of which every set of four of the 8 byte positions contains one.

    Positions fall in three classes by remainder mod 3; the triples are those inside a class and those with two
    positions of a class and one of the next class.
    """
    kind = [p % 3 for p in range(8)]
    out = []
    for t in combinations(range(8), 3):
        k = sorted(kind[p] for p in t)
        if k[0] == k[2] or any(k.count(c) == 2 and k.count((c + 1) % 3) == 1 for c in range(3)):
            out.append(t)
    return out


def _byte(p: int):
    return F.shiftrightunsigned("fp", 8 * (7 - p)).bitwiseAND(F.lit(255))


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, fp): the key is the triple's number and its three bytes."""
    keys = [
        F.lit(k << 24).cast("long") + F.shiftleft(_byte(a), 16) + F.shiftleft(_byte(b), 8) + _byte(c)
        for k, (a, b, c) in enumerate(covering_triples())
    ]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def forest(fps: np.ndarray, bits: int = BITS, minimum: int = 4) -> list[tuple[int, int]]:
    """Spanning forest of the links among the fingerprints of one list: tally shared bytes, filter, verify."""
    n = len(fps)
    u = fps.view(np.uint64)
    by = u.view(np.uint8).reshape(n, 8)
    root = np.arange(n)
    out = []
    for i in range(1, n):
        tally = (by[:i] == by[i]).sum(1)
        near = np.flatnonzero(tally >= minimum)
        near = near[np.bitwise_count(u[near] ^ u[i]) <= bits]
        for r in np.unique(root[near]):
            j = int(near[root[near] == r][0])
            out.append((int(fps[i]), int(fps[j])))
        if len(near):
            root[np.isin(root, root[near])] = i
            root[i] = i
    return out


def _closer(nodes: DataFrame) -> DataFrame:
    """(key, fp) of postings (key, fp) of long lists, posted again by each byte beside the key's triple.

    The new key names the triple, the further position, and all four bytes.
    """
    further = []
    for k, triple in enumerate(covering_triples()):
        number = F.shiftrightunsigned("key", 24)
        for p in range(8):
            if p not in triple:
                further.append(F.when(number == k, F.lit((k * 8 + p) << 32).cast("long") + F.shiftleft(F.col("key").bitwiseAND(F.lit(0xFFFFFF)), 8) + _byte(p)))
    return nodes.select("fp", F.explode(F.filter(F.array(*further), lambda x: x.isNotNull())).alias("key"))


def _dealt(lists: DataFrame, limit: int) -> DataFrame:
    """fps of each pair of blocks of each list (key, n, fp), blocks of about half the limit; a short list is one block."""
    blocks = F.when(F.col("n") <= limit, 1).otherwise(F.ceil(F.col("n") / (limit // 2))).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "own").alias("x"), F.greatest(b, "own").alias("y")))
    spread = lists.withColumn("blocks", blocks).withColumn("own", own).select("key", "fp", F.explode(pairs).alias("pair"))
    return spread.groupBy("key", "pair").agg(F.collect_list("fp").alias("fps")).select("fps")


def fingerprint_links(nodes: DataFrame, list_limit: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect exactly what lies within 4 bits of each other."""

    def counted(postings: DataFrame, tag: str) -> DataFrame:
        return materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), tag)

    lists = counted(_postings(nodes), "op6-lists")
    met = _postings(nodes).join(lists, "key")
    read = met.where(F.col("n") <= list_limit).select("key", "n", "fp")
    if not lists.where(F.col("n") > list_limit).isEmpty():
        closer = materialize(_closer(met.where(F.col("n") > list_limit).select("key", "fp")), "op6-closer")
        read = read.union(closer.join(counted(closer, "op6-closer-lists"), "key").select("key", "n", "fp"))

    def compare():
        def step(batch: pa.RecordBatch):
            pairs = [p for x in batch.column(0) for p in forest(np.array(x.as_py(), np.int64))]
            return {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}

        return step

    return arrow_map(_dealt(read, list_limit), compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, list_limit: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, fp (the same bits as a signed long), per document row."""
    rows = materialize(fingerprints(docs, shingle), "op6-fp")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    links = fingerprint_links(nodes.select("fp"), list_limit)
    roots = components(links, "op6")
    grouped = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    several = materialize(grouped.where("root is not null and low is not null").groupBy("root").agg(F.min("low").alias("component_id")), "op6-low")
    named = materialize(grouped.join(several, "root", "left").select("fp", "component_id"), "op6-named")
    return rows.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp"
    )


def keep_representatives(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The document rows, with all their columns, that stand for their group of near duplicates.

    The smallest doc_id of a group stays. Rows repeating a doc_id are one document, of which the row with the least
    text hash stays; rows without doc_id stay. Ids to drop are joined by id, so Spark broadcasts them only while they are
    small and otherwise shuffles the texts once.
    """
    rows = materialize(near_duplicates(docs, shingle).select("doc_id", "component_id", "fp"), "op6-groups").where("doc_id is not null")
    each = rows.groupBy("doc_id").agg(F.min("component_id").alias("low"), F.count(F.lit(1)).alias("n"))
    named = materialize(each.select("doc_id", (F.col("low") != F.col("doc_id")).alias("drop"), (F.col("n") > 1).alias("again")).where("drop or again"), "op6-named")
    # Helper columns take a name that the documents do not have, in whatever case.
    key = "k"
    while key in {c.lower() for c in docs.columns}:
        key += "k"
    gone = materialize(named.where("drop").select(F.col("doc_id").alias(key)), "op6-gone")
    left = docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")
    if named.where("again and not drop").isEmpty():
        return left
    again = materialize(named.where("again and not drop").select(F.col("doc_id").alias(key)), "op6-again")
    twice = left.join(again, F.col("doc_id") == F.col(key), "left_semi")
    names = docs.columns
    least = twice.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.struct(F.xxhash64("text"), F.to_json(F.struct(*names)))).alias(key))
    return left.join(again, F.col("doc_id") == F.col(key), "left_anti").unionByName(least.select(f"{key}.*"))
