"""Vector codes by product quantisation in integers, with partial-distance search.

Components become floor(``scale`` * x). A vector is cut into ``parts`` equal consecutive parts, each with a codebook of
``entries`` integer vectors: first those of the smallest vec_ids, then ``rounds`` times the floored means of what is nearest
to them. The search of an entry goes through the dimensions by falling variance of the codebook. Squared differences are
summed for all vectors of a batch at once, the first half of the dimensions for all entries and then ``step`` dimensions at
a time; an entry is dropped from a vector's mask once its sum is strictly above the vector's least complete distance so
far. The entry whose sum is least after the first half gives the first complete distance, later leaders better ones. As
sums only grow and ties are never dropped, the nearest entry, the lowest of equals, always stays, so the result is that of
the full search.

Scale: a round reads the integer vectors once, tasks keep sums and counts by entry (``parts`` * ``entries`` short vectors
whatever they read), these are added by Spark, and the codebooks, bounded by the same number, go back with the next round's
function. No vector is shuffled. Errors by label are sums with map-side combine, joined back to a written table, so a hot
label is split by adaptive execution.

Defined results: rows whose vector is null or holds null or non-finite components take no part, nor do empty vectors and
those of another dimension than most (the smaller of equally frequent); a dimension that ``parts`` does not divide is
filled up with zeros; rows that repeat are coded each, but of one vec_id only the least vector by components is a first
entry; rows without vec_id are coded and are never a first entry; fewer ids than ``entries`` give fewer entries; an unused
entry stays; null labels are one label; components beyond 2^24 after scaling are refused with an error, as distances
might not fit a long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory

LARGEST = 2**24
ROWS = 1024


def kept(rows: DataFrame, scale: int, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) with integer components, written, and the components of a part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    most = some.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return some.limit(0), 0
    pad = -most["d"] % parts
    x = F.transform("v", lambda c: F.floor(c * scale))
    small = F.forall(x, lambda c: F.abs(c) <= LARGEST)
    whole = F.concat(F.transform(x, lambda c: c.cast("int")), F.array_repeat(F.lit(0), pad))
    checked = F.when(small, whole).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>"))
    return materialize(some.where(F.size("v") == most["d"]).select("vec_id", "label", checked.alias("v")), "codes-vectors"), (most["d"] + pad) // parts


def first_entries(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """Each part's codebook before the first round."""
    ids = [r[0] for r in vectors.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return []
    least = vectors.where(F.col("vec_id") <= ids[-1]).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    return [np.ascontiguousarray(b) for b in np.split(np.array([r["v"] for r in least], np.int64), parts, axis=1)]


def search(x: np.ndarray, book: np.ndarray, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each vector, the lowest of equals, by partial distances."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    span = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    whole = np.int32 if span * span * x.shape[1] < 2**31 else np.int64
    x, book = np.ascontiguousarray(x[:, order], whole), np.ascontiguousarray(book[:, order], whole)
    n, d = x.shape
    # Few entries can be dropped before half of the variance is summed, so masks begin there.
    lead = min(d, max(step, d // 2))
    sums, gap = np.zeros((n, len(book)), whole), np.empty((n, len(book)), whole)
    for j in range(lead):
        np.subtract(x[:, j, None], book[None, :, j], out=gap)
        np.multiply(gap, gap, out=gap)
        np.add(sums, gap, out=sums)
    best = ((x - book[sums.argmin(1)]) ** 2).sum(1, dtype=whole)
    at = np.flatnonzero(sums <= best[:, None])
    sums = sums.ravel()[at]
    at, entry = np.divmod(at, len(book))
    for j in range(lead, d, step):
        stop = min(d, j + step)
        gap = x[at, j:stop] - book[entry, j:stop]
        sums = sums + np.einsum("ij,ij->i", gap, gap)
        if stop < d:
            # The leader of what is left is completed; with it the bound may come down.
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            leader = np.minimum.reduceat(sums.astype(np.int64) * len(book) + entry, starts) % len(book)
            rows = at[starts]
            best[rows] = np.minimum(best[rows], ((x[rows] - book[leader]) ** 2).sum(1, dtype=whole))
        stay = sums <= best[at]
        at, entry, sums = at[stay], entry[stay], sums[stay]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    low = np.minimum.reduceat(sums, starts)
    tied = sums == np.repeat(low, np.diff(np.append(starts, len(at))))
    return np.minimum.reduceat(np.where(tied, entry, len(book)), starts), low.astype(np.int64)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ``ROWS`` rows with their vectors; masks of that many rows and all entries are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            yield rows, rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows.num_rows, -1)


def refined(vectors: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: floored means of the parts that are nearest to each entry."""
    size, d = books[0].shape

    def run(batches):
        sums, counts = np.zeros((len(books), size, d), np.int64), np.zeros((len(books), size), np.int64)
        for _, x in _matrices(batches):
            for p, book in enumerate(books):
                part = x[:, p * d : (p + 1) * d]
                code, _ = search(part, book)
                np.add.at(sums[p], code, part)
                counts[p] += np.bincount(code, minlength=size)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts.ravel()[slot]), pa.array(list(sums.reshape(-1, d)[slot]), pa.list_(pa.int64()))], names=["slot", "n", "sums"])
        release_memory()

    told = vectors.select("v").mapInArrow(run, "slot long, n long, sums array<long>")
    # One row an entry and position, added up before they are moved; the entries are bounded by the codebooks' size.
    by_place = told.select("slot", "n", F.posexplode("sums").alias("place", "s")).groupBy("slot", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    flat = np.concatenate(books)
    for r in by_place.collect():
        flat[r["slot"], r["place"]] = r["s"] // r["n"]
    return list(flat.reshape(len(books), size, d))


def compress(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error and codebooks_sha256 of each vector that takes part."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    vectors, d = kept(rows, scale, parts)
    books = first_entries(vectors, parts, entries) if d else []
    label = vectors.schema["label"].dataType.simpleString()
    if not books:
        # Nothing to code, or nothing that names a first entry.
        none = [F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]
        return vectors.select("vec_id", "label", *none)
    for _ in range(rounds):
        books = refined(vectors, books)
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book.tolist() for c in entry).encode()).hexdigest()

    def run(batches):
        for batch, x in _matrices(batches):
            found = [search(x[:, p * d : (p + 1) * d], book) for p, book in enumerate(books)]
            codes = np.stack([code for code, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(e for _, e in found))], names=["vec_id", "label", "code", "error"])
        release_memory()

    coded = materialize(vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long"), "codes")
    by_label = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "codes-labels")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
