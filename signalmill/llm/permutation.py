"""Nearest neighbours by largest inner product through a permutation index.

A vector is represented by its ``posted`` nearest pivots in order. It is posted, with the pivot's position in that order,
in the inverted file of each of them; files are sorted by position. A query walks the files of its own ``posted`` nearest
pivots and sums the footrule distance |own position - posted position|, where a pivot that only one of both has counts
``posted``. The ``share`` of the vectors with the least distances (``least`` at least) is reranked by the exact inner
product in double precision. Pivots are spread by farthest-first choice from a bounded sample. Inner products are reduced
to angles by one extra coordinate sqrt(M^2 - |x|^2), M the largest norm.

Scale: the files are kept by document, not by pivot, so that sums stay where the files are and only results are shuffled:
distinct vectors are dealt by their hash into parts of about ``part_rows``, and each part's files are built once and
written, one row a part, to the shared folder. The parts, and so the results, depend on the set of vectors alone, not on
how it is read. Queries are a stated set (ids divisible by ``every``) and run in blocks of about ``block_rows``; a block is
broadcast, scans the written files once and is written before the next begins, so driver and executors hold one block. A
part gives a query its ``k`` best ids, and the best of all parts are merged. Identical vectors are one entry with their
smallest ids, of which no more than k + 1 can be among a query's neighbours; they are cut on the map side.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without
id or with another dimension than most (the smaller of equally frequent); rows that repeat an id and vector count
once; rows that repeat an id with other vectors are candidates each, and the id's query is the least of them by
components; equal scores go to the smaller id, equal footrule distances to the vector with the smaller first id; other
columns are ignored; with no query or no candidate, or an empty table, there are no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release_memory


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part, before the dimension is known; floats stay floats while they are moved."""
    held = rows.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if held in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(finite & F.exists("v", lambda x: x != 0))


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` directions of the sample, each the one least like those before it."""
    c = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    pick, most = [0], np.full(len(c), -np.inf)
    for _ in range(min(n, len(c)) - 1):
        most = np.maximum(most, c @ c[pick[-1]])
        pick.append(int(np.argmin(most)))
    return c[pick]


def augmented(x: np.ndarray, largest: float | None) -> np.ndarray:
    """The vectors with the coordinate that turns inner products into angles; 0 for queries (``largest`` None)."""
    extra = np.zeros(len(x)) if largest is None else np.sqrt(np.maximum(largest**2 - (x * x).sum(1), 0))
    return np.hstack([x, extra[:, None]])


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """Per vector its ``m`` nearest pivots, nearest first (ties to the earlier pivot)."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :m].astype(np.int32)


_TYPES = (("<f4", "<f8"), ("<i8",), ("u1", "<i8"), ("<u2", "<i4"), ("u1", "<i4"), ("<i8",))


class Files:
    """The pivots' inverted files over a part's vectors: nodes and positions, by pivot and position."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, counts: np.ndarray, files: np.ndarray, places: np.ndarray, starts: np.ndarray):
        self.x, self.ids, self.files, self.places, self.starts = x, ids, files, places, starts
        self.at = np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def build(cls, x: np.ndarray, ids: list[list[int]], pivots: np.ndarray, largest: float, posted: int) -> Files:
        order = np.argsort([i[0] for i in ids], kind="stable")
        x, ids = np.ascontiguousarray(x[order]), [ids[k] for k in order.tolist()]
        near = nearest_pivots(augmented(x, largest), pivots, posted)
        width = near.shape[1]
        by = np.argsort((near.astype(np.int64) * width + np.arange(width)).ravel(), kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(near.ravel(), minlength=len(pivots)))])
        return cls(x, np.concatenate(ids), np.array([len(i) for i in ids]), (by // width).astype(np.int32), (by % width).astype(np.int32), starts)

    def pack(self) -> list[bytes]:
        """The arrays as bytes, each in the first of its types that holds it without loss; ``unpack`` reads them."""
        out = []
        for a, types in zip((self.x, self.ids, np.diff(self.at), self.files, self.places, self.starts), _TYPES):
            k = next(k for k, t in enumerate(types) if (a.astype(t) == a).all())
            out.append(bytes([k]) + a.astype(types[k]).tobytes())
        return out

    @classmethod
    def unpack(cls, raw: list[bytes], width: int) -> Files:
        x, ids, counts, files, places, starts = (np.frombuffer(b, types[b[0]], offset=1) for b, types in zip(raw, _TYPES))
        return cls(x.astype(np.float64).reshape(-1, width), ids, counts.astype(np.int64), files, places.astype(np.int32), starts)

    def agreement(self, near: np.ndarray) -> np.ndarray:
        """Per vector what its footrule distance to a query of these nearest pivots lacks to that of no common pivot."""
        m, spans = len(near), [(self.starts[p], self.starts[p + 1]) for p in near.tolist()]
        nodes = np.concatenate([self.files[a:b] for a, b in spans])
        gains = np.concatenate([m - np.abs(self.places[a:b] - j) for j, (a, b) in enumerate(spans)])
        return np.bincount(nodes, gains, minlength=len(self.x)).astype(np.int64)

    def nearest(self, query_id: int, q: np.ndarray, near: np.ndarray, k: int, share: float, least: int) -> list[tuple[int, float]]:
        """The query's ``k`` best (id, score) among the vectors with the least footrule distances."""
        n = len(self.x)
        keep = min(n, max(least, k + 1, int(np.ceil(share * n))))
        # Of equal distances the earlier vector counts as nearer, so what is kept does not depend on the order of selection.
        far = np.arange(n) - self.agreement(near) * n if keep < n else None
        while True:
            some = np.argpartition(far, keep - 1)[:keep] if keep < n else np.arange(n)
            score = (self.x[some] * q).sum(1)
            best: dict[int, float] = {}
            last = float("inf")
            # By falling score, so an id counts with its best vector; entries that tie with the k-th id's are taken too.
            for x in np.argsort(-score, kind="stable").tolist():
                s = float(score[x])
                if len(best) >= k and s < last:
                    break
                node = some[x]
                for i in self.ids[self.at[node] : self.at[node + 1]].tolist():
                    if i != query_id and i not in best:
                        best[i] = last = s
            if len(best) >= k or keep == n:
                return sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]
            keep = min(n, 2 * keep)


def nearest_neighbours(
    rows: DataFrame, k: int = 20, every: int = 20, n_pivots: int = 256, posted: int = 64, share: float = 0.2, least: int = 512, sample: int = 4096, part_rows: int = 8_192, block_rows: int = 8_192
) -> DataFrame:
    """query_id, rank, vec_id, score. ``sample`` bounds the pivots' source, ``least`` a part's candidates from below."""
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    every_row = usable(rows)
    sizes = every_row.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("m"))
    main = sizes.orderBy(F.desc("n"), "d").first()
    if main is None:
        return spark.createDataFrame([], schema)
    width, largest = main["d"], float(main["m"])
    vectors = every_row.where(F.size("v") == width)
    h = F.xxhash64("v")
    drawn = vectors.groupBy(F.pmod(h, F.lit(sample)).alias("b")).agg(F.min_by("v", F.struct(h, "v")).alias("v")).orderBy("b").collect()
    pivots = spread_pivots(augmented(np.array([r["v"] for r in drawn]), largest), n_pivots)
    asked = materialize(vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "op7-asked")
    n_asked = asked.count()
    if n_asked == 0:
        return spark.createDataFrame([], schema)
    files = index(vectors, pivots, largest, k, posted, part_rows)
    blocks = max(1, -(-n_asked // block_rows))
    found = []
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        if some:
            found.append(materialize(_searched(files, np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some]), pivots, k, posted, share, least), "op7-found"))
    best = found[0]
    for f in found[1:]:
        best = best.union(f)
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def index(vectors: DataFrame, pivots: np.ndarray, largest: float, k: int, posted: int, part_rows: int) -> DataFrame:
    """The written inverted files, one row a part: x, ids, counts, files, places, starts as bytes."""
    # Row numbers up to a limit are cut before the shuffle too, so a vector with a third of all ids is no hot group.
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = vectors.distinct().withColumn("_n", copy).where(F.col("_n") <= k + 1)
    nodes = materialize(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "op7-nodes")
    parts = max(1, -(-nodes.count() // part_rows))
    dealt = nodes.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part")
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    names = ("x", "ids", "counts", "files", "places", "starts")

    def made(held):
        x = np.concatenate([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for b in held]).astype(np.float64)
        raw = Files.build(x, [i for b in held for i in b.column(1).to_pylist()], shared.value, largest, posted).pack()
        return pa.RecordBatch.from_arrays([pa.array([r], pa.binary()) for r in raw], names=list(names))

    def run(batches):
        # A part's rows follow each other; a batch is cut where the part changes.
        held, part = [], None
        for batch in batches:
            number = batch.column(2).to_numpy(zero_copy_only=False)
            at = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)] if len(number) else []
            for a, b in zip(at, at[1:]):
                if held and number[a] != part:
                    yield made(held)
                    held = []
                part = number[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield made(held)
        release_memory()

    return materialize(dealt.select("v", "ids", "part").mapInArrow(run, ", ".join(f"{n} binary" for n in names)), "op7-files")


def _searched(files: DataFrame, ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int, posted: int, share: float, least: int) -> DataFrame:
    """Each part's ``k`` best for each query of a block."""
    shared = files.sparkSession.sparkContext.broadcast((ids, q, nearest_pivots(augmented(q, None), pivots, posted)))

    def run(batches):
        ids, q, near = shared.value
        for batch in batches:
            for raw in zip(*(c.to_pylist() for c in batch.columns)):
                part = Files.unpack(raw, q.shape[1])
                out = [(i, v, s) for i, x, m in zip(ids.tolist(), q, near) for v, s in part.nearest(i, x, m, k, share, least)]
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])
        release_memory()

    # A row is a whole part, so each is a task's work.
    return files.repartition(files.count()).mapInArrow(run, "query_id long, vec_id long, score double")
