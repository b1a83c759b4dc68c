"""Findings to clusters: the greedy fold, mentions, nearest of a kind."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.vectors import decide, normalize
from signalmill.operators.staging import bound_batches, staged
from signalmill.operators.tables import rank_in_order


def never_the_same(a: str, b: str) -> bool:
    return False


def shared_words(threshold: float = 0.5) -> Callable[[str, str], bool]:
    """An offline tie-breaker: the share of words in common."""

    def same(a: str, b: str) -> bool:
        x, y = set((a or "").lower().split()), set((b or "").lower().split())
        return bool(x | y) and len(x & y) / len(x | y) >= threshold

    return same


def unclustered(findings: DataFrame) -> DataFrame:
    return findings.where("embedding is not null and cluster_id is null").orderBy("id")


def greedy(
    findings: DataFrame, clusters: DataFrame, merge: float = 0.90, low: float = 0.75, same: Callable[[str, str], bool] = never_the_same, block: int = 1024, fold: int = 4096,
) -> DataFrame:
    """id, kind, cluster_key, similarity, action, merged of each finding, folded in id order inside its kind.

    A finding joins the most similar cluster of its kind (the earliest of equals, to twelve decimals) or founds one whose
    centroid it stays. Stored clusters (id, kind, canonical_statement, centroid) come first, by id, and keep their id as key;
    new ones get minus the founding finding's id.

    The result is that of one pass in order, found in rounds. A kind lies in blocks of ``block`` findings in order. Each knows
    its best founder so far, and one that is at or above ``merge`` cannot found a cluster, so it is closed whatever comes.
    A round takes a kind's first blocks with at most ``fold`` open findings and folds these in order in one task. As everything
    before them is known, this is exact. The round's founders, at most ``fold`` vectors a kind, then meet all later blocks, and
    the closed findings of its own blocks, as one matrix product a block. So the work of a kind is spread over its blocks, no
    task holds more than ``fold`` findings, and there are about as many rounds as founders over ``fold``.
    """
    fresh = findings.select("kind", F.col("id").cast("long").alias("ord"), F.coalesce("statement", F.lit("")).alias("text"), F.col("embedding").cast("array<double>").alias("v"))
    bound_batches(findings.sparkSession)
    fold = max(fold, block)
    old = clusters.select("kind", F.col("id").cast("long").alias("key"), F.coalesce("canonical_statement", F.lit("")).alias("text"), F.col("centroid").cast("array<double>").alias("v"))
    sizes = fresh.select("kind").unionByName(old.select("kind")).groupBy("kind").count()
    if (sizes.agg(F.max("count")).first()[0] or 0) <= fold:
        # Every kind is what one task may hold, stored clusters and all: one pass.
        none = {"sim": F.lit(None).cast("double"), "near": F.lit(None).cast("string")}
        rows = old.withColumns({"ord": F.col("key") - 2**62, **none}).unionByName(fresh.withColumns({"key": F.lit(None).cast("long"), **none}))
        once = rows.repartition("kind").sortWithinPartitions("kind", "ord").select("kind", "ord", "text", "v", "sim", "key", "near")
        return once.mapInArrow(_folded(merge, low, same), f"{_RESULT}, text string, v array<double>").select("id", "kind", "cluster_key", "similarity", "action", "merged")
    ranked = _ranked(staged(fresh, "fold-findings"))
    dealt = ranked.withColumn("block", F.floor((F.col("_rank") - 1) / block)).groupBy("kind", "block").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "v"))).alias("m"))
    now = staged(dealt.select("kind", "block", "m.ord", "m.text", "m.v").mapInArrow(_packed, _BLOCK), "fold-blocks")
    # Stored clusters are before every finding.
    stored = old.withColumn("ord", F.col("key") - 2**62)
    stored = staged(_ranked(staged(stored, "fold-stored")).withColumn("part", F.floor((F.col("_rank") - 1) / fold)), "fold-founders")
    for part in range((stored.agg(F.max("part")).first()[0] or 0) + 1 if not stored.isEmpty() else 0):
        now = staged(_met(now, stored.where(F.col("part") == part)).mapInArrow(_updated(merge), _BLOCK), "fold-blocks")
    out = []
    while not now.isEmpty():
        # Block counts only: one row a block.
        upto = F.sum("n_open").over(Window.partitionBy("kind").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ends = staged(now.select("kind", "block", "n_open").withColumn("upto", upto).where(F.col("upto") <= fold).groupBy(F.col("kind").alias("_kind")).agg(F.max("block").alias("last")), "fold-ends")
        told = now.join(ends, F.col("kind").eqNullSafe(F.col("_kind"))).drop("_kind")
        taken, later = told.where("block <= last").drop("last"), told.where("block > last").drop("last")
        open_ = taken.where("n_open > 0").mapInArrow(_open(merge), _ITEM).repartition("kind").sortWithinPartitions("kind", "ord")
        decided = staged(open_.mapInArrow(_folded(merge, low, same), f"{_RESULT}, text string, v array<double>"), "fold-decided")
        founders = decided.where("not merged").select("kind", F.col("id").alias("ord"), F.col("cluster_key").alias("key"), "text", "v")
        out.append(decided.select("id", "kind", "cluster_key", "similarity", "action", "merged"))
        if not taken.where(F.col("n_open") < F.size("ord")).isEmpty():
            out.append(staged(_met(taken, founders).mapInArrow(_closed(merge), _RESULT), "fold-closed"))
        if later.isEmpty():
            break
        now = staged(_met(later, founders).mapInArrow(_updated(merge), _BLOCK), "fold-blocks")
    every = findings.sparkSession.createDataFrame([], _RESULT)
    for part in out:
        every = every.unionByName(part)
    return every


# A block: its findings in order, their unit vectors, and of each the best founder so far (key null: none).
_BLOCK = "kind string, block long, n_open long, ord array<long>, text array<string>, x binary, sim array<double>, key array<long>, near array<string>"
_ITEM = "kind string, ord long, text string, v array<double>, sim double, key long, near string"
_RESULT = "id long, kind string, cluster_key long, similarity double, action string, merged boolean"
_SLOTS = 64


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with their number in their kind, which may be null."""
    named = rows.withColumn("_k", F.coalesce(F.concat(F.lit("="), "kind"), F.lit("")))
    return rank_in_order(named, ["_k"], [F.col("ord")], "_rank", parts=16).drop("_k")


class Block(NamedTuple):
    kind: str | None
    block: int
    ord: np.ndarray
    text: list[str]
    x: np.ndarray
    sim: np.ndarray
    key: list[int | None]
    near: list[str | None]

    @classmethod
    def rows(cls, batch: pa.RecordBatch):
        """The blocks of a batch, and each one's founders (ord, key, text, x) where it has any."""
        for r in range(batch.num_rows):
            at = lambda c: batch.column(c)[r]  # noqa: B023,E731
            ords = at("ord").values.to_numpy()
            x = np.frombuffer(at("x").as_py(), np.float64).reshape(len(ords), -1)
            block = cls(at("kind").as_py(), at("block").as_py(), ords, at("text").as_py(), x, at("sim").values.to_numpy(zero_copy_only=False).copy(), at("key").as_py(), at("near").as_py())
            founders = at("founders") if "founders" in batch.schema.names else None
            if founders is None or not founders.is_valid:
                yield block, None
            else:
                f = founders.values
                yield block, (f.field("ord").to_numpy(), f.field("key").to_pylist(), f.field("text").to_pylist(), _units(f.field("v")))

    def met(self, founders, merge: float) -> Block:
        """The block after founders that came later than those it knows; each finding meets those before it."""
        if founders is None:
            return self
        ords, keys, texts, x = founders
        sims = np.round(self.x @ x.T, 12)
        sims[ords[None, :] >= self.ord[:, None]] = -np.inf
        best = sims.argmax(1)
        top = sims[np.arange(len(best)), best]
        for i in np.flatnonzero(top > np.where(np.isnan(self.sim), -np.inf, self.sim)).tolist():
            self.sim[i], self.key[i], self.near[i] = top[i], keys[best[i]], texts[best[i]]
        return self

    def closed(self, merge: float) -> np.ndarray:
        return self.sim >= merge

    @staticmethod
    def batch(blocks: list[Block], merge: float) -> pa.RecordBatch:
        cols = [
            pa.array([b.kind for b in blocks], pa.string()), pa.array([b.block for b in blocks], pa.int64()), pa.array([int((~b.closed(merge)).sum()) for b in blocks], pa.int64()),
            pa.array([b.ord for b in blocks], pa.list_(pa.int64())), pa.array([b.text for b in blocks], pa.list_(pa.string())), pa.array([b.x.tobytes() for b in blocks], pa.binary()),
            pa.array([b.sim for b in blocks], pa.list_(pa.float64())), pa.array([b.key for b in blocks], pa.list_(pa.int64())), pa.array([b.near for b in blocks], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["kind", "block", "n_open", "ord", "text", "x", "sim", "key", "near"])


def _units(vectors: pa.Array) -> np.ndarray:
    """Unit vectors of a list column, straight from its buffer."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _packed(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            kind, block, ords, text, v = (batch.column(c)[r] for c in ("kind", "block", "ord", "text", "v"))
            n = len(ords)
            yield Block.batch([Block(kind.as_py(), block.as_py(), ords.values.to_numpy(), text.as_py(), _units(v.values), np.full(n, np.nan), [None] * n, [None] * n)], np.inf)


def _met(blocks: DataFrame, founders: DataFrame) -> DataFrame:
    """Blocks with the founders of their kind (at most a fold's) as one array, dealt so that a large kind is many tasks."""
    of = founders.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "text", "v"))).alias("founders"))
    slot = F.pmod(F.col("block"), F.lit(_SLOTS))
    slots = blocks.select(F.col("kind").alias("_kind"), slot.alias("_slot")).distinct()
    dealt = staged(of.join(slots, F.col("kind").eqNullSafe(F.col("_kind"))).select("_kind", "_slot", "founders"), "fold-dealt")
    return blocks.withColumn("slot", slot).join(dealt, F.col("kind").eqNullSafe(F.col("_kind")) & (F.col("slot") == F.col("_slot")), "left").drop("slot", "_kind", "_slot")


def _updated(merge: float):
    def run(batches):
        for batch in batches:
            for block, founders in Block.rows(batch):
                yield Block.batch([block.met(founders, merge)], merge)

    return run


def _open(merge: float):
    """The open findings of blocks, one a row."""

    def run(batches):
        for batch in batches:
            for b, _ in Block.rows(batch):
                i = np.flatnonzero(~b.closed(merge)).tolist()
                sims = [None if np.isnan(b.sim[k]) else float(b.sim[k]) for k in i]
                cols = [[b.kind] * len(i), b.ord[i], [b.text[k] for k in i], list(b.x[i]), sims, [b.key[k] for k in i], [b.near[k] for k in i]]
                types = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "ord", "text", "v", "sim", "key", "near"])

    return run


def _folded(merge: float, low: float, same: Callable[[str, str], bool]):
    """Open findings, sorted by kind and order, with what becomes of them; rows with a key and no similarity are stored
    clusters, which are known before."""

    def run(batches):
        fold: Fold | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "ord", "text", "sim", "key", "near")))
            got, at, x = [], [], _units(batch.column("v"))
            for r, (kind, ord_, text, sim, key, near) in enumerate(rows):
                if fold is None or fold.kind != kind:
                    fold = Fold(kind, merge, low, same)
                if key is not None and sim is None:
                    fold.add(key, text, x[r])
                else:
                    got.append((ord_, kind, *fold.place(ord_, text, x[r], sim, key, near)))
                    at.append(r)
            cols, kept = list(zip(*got)) if got else [[]] * 6, pa.array(at, pa.int64())
            types = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), batch.column("text").take(kept), batch.column("v").take(kept)], names=["id", "kind", "cluster_key", "similarity", "action", "merged", "text", "v"])

    return run


def _closed(merge: float):
    """The closed findings of blocks whose founders are all known."""

    def run(batches):
        for batch in batches:
            for b, founders in Block.rows(batch):
                closed = np.flatnonzero(b.closed(merge))
                b = b.met(founders, merge)
                n = len(closed)
                yield pa.RecordBatch.from_arrays([
                    pa.array(b.ord[closed], pa.int64()), pa.array([b.kind] * n, pa.string()), pa.array([b.key[i] for i in closed], pa.int64()), pa.array(b.sim[closed], pa.float64()),
                    pa.array(["merge"] * n, pa.string()), pa.array([True] * n, pa.bool_()),
                ], names=["id", "kind", "cluster_key", "similarity", "action", "merged"])

    return run


class Fold:
    """The clusters that a run of findings of one kind founded: keys, texts and unit centroids, in order."""

    def __init__(self, kind: str | None, merge: float, low: float, same: Callable[[str, str], bool]):
        self.kind, self.merge, self.low, self.same = kind, merge, low, same
        self.keys: list[int] = []
        self.texts: list[str] = []
        self.centroids = np.zeros((0, 0))

    def add(self, key: int, text: str, v: np.ndarray) -> None:
        n = len(self.keys)
        if n == len(self.centroids):
            grown = np.zeros((max(16, 2 * n), len(v)))
            if n:
                grown[:n] = self.centroids
            self.centroids = grown
        self.centroids[n] = v
        self.keys.append(key), self.texts.append(text)

    def place(self, id_: int, text: str, v: np.ndarray, sim: float | None = None, key: int | None = None, near: str | None = None) -> tuple[int, float | None, str, bool]:
        """(cluster key, similarity, action, merged) of the next finding, whose best earlier founder is given."""
        sims = np.round(self.centroids[: len(self.keys)] @ v, 12) if self.keys else np.zeros(0)
        best = int(np.argmax(sims)) if len(sims) else -1
        if best >= 0 and (sim is None or sims[best] > sim):
            sim, key, near = float(sims[best]), self.keys[best], self.texts[best]
        action = "new" if sim is None or sim < self.low else "tiebreak" if sim < self.merge else "merge"
        if action == "merge" or action == "tiebreak" and self.same(text, near):
            return key, sim, action, True
        self.add(-id_, text, v)
        return -id_, sim, action, False


def new_clusters(folded: DataFrame, findings: DataFrame, now: Column) -> DataFrame:
    """The rows of clusters that the fold founded, without ids; mention counts start at 0."""
    founded = folded.where("cluster_key = -id").select("id")
    return findings.join(founded, "id").select(
        (-F.col("id")).alias("cluster_key"), "kind", F.col("statement").alias("canonical_statement"), F.col("embedding").alias("centroid"),
        F.array().cast("array<string>").alias("sources_seen"), F.array().cast("array<date>").alias("days_seen"), F.lit(0).alias("mention_count"),
        now.alias("first_seen"), now.alias("last_seen"),
    )


def nearest_same_kind(vectors: DataFrame, candidates: DataFrame, kind: str = "kind", merge: float = 0.90, low: float = 0.75, block: int = 2048) -> DataFrame:
    """Each vector's most similar candidate of its kind, itself excluded, and the decision; equals (to twelve decimals) go
    to the lower id. Rows without kind or embedding take no part. ``nearest_found`` tells how."""
    best, _ = nearest_found(vectors, candidates, kind, block, report=False)
    return best.select("id", kind, "nearest", "similarity").withColumn("action", decide(F.col("similarity"), merge, low))


MOST_PIVOTS, CLOSE_CELLS, MARGIN = 4096, 4, 2e-6


def nearest_found(vectors: DataFrame, candidates: DataFrame, kind: str = "kind", block: int = 2048, report: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """((id, kind, nearest, similarity), {"pairs", "multiplied"}): the nearest candidates and, with ``report``, how many pairs
    there are and how many were met.

    Vectors lie in cells around pivots, a bounded sample of the candidates (``MOST_PIVOTS``, so about four to a block), and
    cells in blocks. Angles obey the triangle inequality: nothing in a cell is nearer to a vector than the vector's angle to
    the pivot less the cell's radius. So every vector first meets its own cell, then the ``CLOSE_CELLS`` cells next to it,
    and then only those whose bound is not beyond the best it has found, cell by cell and inside a product row by row.
    ``MARGIN`` covers the rounding of angles. A product of two blocks is one task's row, so a large kind is many tasks, and
    what leaves a task is one row a vector. Vectors of length zero and kinds without pivots are in cells that nothing bounds.
    """
    rows = lambda d: d.where(F.col(kind).isNotNull() & F.col("embedding").isNotNull()).select("id", kind, normalize(F.col("embedding")).alias("v"))
    left = rows(vectors)
    right = left if candidates is vectors else rows(candidates)
    wanted = min(MOST_PIVOTS, 4 * (candidates.count() // block))
    pivots: dict = {}
    if wanted > 1:
        drawn = right.where(F.exists("v", lambda x: x != 0)).select(kind, "v", F.xxhash64("id", "v").alias("h")).distinct().orderBy("h").limit(wanted).collect()
        for r in drawn:
            pivots.setdefault(r[kind], []).append(r["v"])
    pivots = {k: np.array(v) for k, v in pivots.items() if len(v) > 1}
    asked = _cells(left, kind, pivots, block)
    held = asked if right is left else _cells(right, kind, pivots, block)
    radii = held.groupBy(kind, F.col("cell").alias("other_cell")).agg(F.max("radius").alias("radius"))
    cells = asked.select(kind, "cell").distinct().join(radii, kind)
    turns = 3 if pivots else 1
    if pivots:
        cells = staged(cells.mapInArrow(_between(kind, pivots), f"{kind} {_kind_of(left, kind)}, cell long, other_cell long, radius double, apart double"), "near-cells")
        own = F.col("cell") == F.col("other_cell")
        close = F.row_number().over(Window.partitionBy(kind, "cell").orderBy(own.desc(), "apart", "other_cell"))
        planned = staged(cells.withColumn("turn", F.when(own, 0).when(close <= CLOSE_CELLS + 1, 1).otherwise(2)), "near-pairs")
    else:
        planned = cells.withColumn("turn", F.lit(0))
    best, met = None, 0
    for turn in range(turns):
        pairs = planned.where(F.col("turn") == turn).select(kind, "cell", "other_cell")
        if turn == 2:
            # The worst that any vector of a cell has found; none, where one has found nothing.
            worst = asked.select(kind, "cell", F.explode("ids").alias("id")).join(best, ["id", kind], "left").groupBy(kind, "cell").agg(F.min(F.coalesce("similarity", F.lit(-2.0))).alias("worst"))
            told = planned.where("turn = 2").join(worst, [kind, "cell"])
            reach = F.when(F.col("worst") < -1, F.lit(float(np.pi))).otherwise(F.acos(F.least("worst", F.lit(1.0))))
            pairs = told.join(staged(asked.groupBy(kind, "cell").agg(F.max("radius").alias("own_radius")), "near-own"), [kind, "cell"])
            pairs = staged(pairs.where(F.col("apart") - F.col("radius") - F.col("own_radius") <= reach + MARGIN).select(kind, "cell", "other_cell"), "near-pairs")
        known = asked.withColumn("known", F.transform("ids", lambda _: F.lit(None).cast("double"))) if best is None else _with_known(asked, best, kind)
        one = known.select(kind, "cell", F.col("ids").alias("a"), F.col("vs").alias("x"), "known").join(pairs, [kind, "cell"])
        two = held.select(kind, F.col("cell").alias("other_cell"), F.col("ids").alias("b"), F.col("vs").alias("y"), "radius")
        found = one.join(two, [kind, "other_cell"]).select(kind, "other_cell", "a", "x", "known", "b", "y", "radius")
        few = staged(found.mapInArrow(_products(kind, pivots), f"id long, {kind} {_kind_of(left, kind)}, other long, similarity double, met long"), "near-found")
        met += (few.agg(F.sum("met")).first()[0] or 0) if report else 0
        every = few.where("id is not null").select("id", kind, "other", "similarity")
        if best is not None:
            every = every.unionByName(best.select("id", kind, F.col("nearest").alias("other"), "similarity"))
        top = every.groupBy("id", kind).agg(F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("b"))
        best = top.select("id", kind, (-F.col("b.o")).alias("nearest"), F.col("b.similarity").alias("similarity"))
        best = best if turn == turns - 1 else staged(best, "near-best")
    if not report:
        return best, {}
    sizes = left.groupBy(kind).count().join(right.groupBy(kind).agg(F.count(F.lit(1)).alias("_n")), kind)
    return best, {"pairs": sizes.agg(F.sum(F.col("count") * F.col("_n"))).first()[0] or 0, "multiplied": met}


def _kind_of(df: DataFrame, kind: str) -> str:
    return df.schema[kind].dataType.simpleString()


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, straight from its buffer."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def _cells(rows: DataFrame, kind: str, pivots: dict, block: int) -> DataFrame:
    """(kind, cell, radius, ids, vs): vectors of a cell in blocks, by id; -1 is the cell of zero vectors."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, kinds = _matrix(batch.column("v")), batch.column(kind).to_pylist()
            cell, angle = np.zeros(len(x), np.int64), np.full(len(x), np.pi)
            for k in set(kinds) & set(pivots):
                at = np.flatnonzero(np.array([y == k for y in kinds]))
                apart = _angles(x[at], pivots[k])
                cell[at], angle[at] = apart.argmin(1), apart.min(1)
            zero = ~x.any(axis=1)
            cell[zero], angle[zero] = -1, np.pi
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", kind, "v")), pa.array(cell), pa.array(angle)], names=["id", kind, "v", "cell", "angle"])

    dealt = staged(rows.mapInArrow(run, f"id long, {kind} {_kind_of(rows, kind)}, v array<double>, cell long, angle double"), "near-dealt")
    sizes = dealt.groupBy(kind, "cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
    parts = dealt.join(sizes, [kind, "cell"]).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")))
    packed = parts.groupBy(kind, "cell", "_b").agg(F.max("angle").alias("radius"), F.array_sort(F.collect_list(F.struct("id", "v"))).alias("_m"))
    return staged(packed.select(kind, "cell", "_b", "radius", F.transform("_m", lambda m: m["id"]).alias("ids"), F.transform("_m", lambda m: m["v"]).alias("vs")), "near-blocks")


def _between(kind: str, pivots: dict):
    """Pairs of cells of a kind with the angle between their pivots, 0 where one has none."""

    def run(batches):
        for batch in batches:
            a, b, kinds = batch.column("cell").to_numpy(), batch.column("other_cell").to_numpy(), batch.column(kind).to_pylist()
            apart = np.zeros(len(a))
            for k in set(kinds) & set(pivots):
                at = np.flatnonzero(np.array([y == k for y in kinds]) & (a >= 0) & (b >= 0))
                apart[at] = np.arccos(np.clip((pivots[k][a[at]] * pivots[k][b[at]]).sum(1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(kind), batch.column("cell"), batch.column("other_cell"), batch.column("radius"), pa.array(apart)], names=[kind, "cell", "other_cell", "radius", "apart"])

    return run


def _with_known(blocks: DataFrame, best: DataFrame, kind: str) -> DataFrame:
    """Blocks with the best similarity of each vector so far, in the order of their ids."""
    each = blocks.select(kind, "cell", "_b", F.posexplode("ids").alias("_at", "id")).join(best.select("id", kind, "similarity"), ["id", kind], "left")
    known = each.groupBy(kind, "cell", "_b").agg(F.array_sort(F.collect_list(F.struct("_at", "similarity"))).alias("_k"))
    return blocks.join(staged(known.select(kind, "cell", "_b", F.transform("_k", lambda k: k["similarity"]).alias("known")), "near-known"), [kind, "cell", "_b"])


def _products(kind: str, pivots: dict):
    """The best of a block of candidates for each vector of another block that they may still be nearest to, and in a row
    without id how many pairs were met."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                k, a, x, known, b, y = (batch.column(c)[r] for c in (kind, "a", "x", "known", "b", "y"))
                k, a, b = k.as_py(), a.values.to_numpy(), b.values.to_numpy()
                x, y = _matrix(x.values), _matrix(y.values)
                cell, radius = batch.column("other_cell")[r].as_py(), batch.column("radius")[r].as_py()
                if k in pivots and cell >= 0:
                    found = known.values.to_numpy(zero_copy_only=False).astype(float)
                    reach = np.where(np.isnan(found), np.pi, np.arccos(np.clip(found, -1, 1)))
                    stay = (_angles(x, pivots[k][cell : cell + 1])[:, 0] - radius <= reach + MARGIN) | ~x.any(axis=1)
                    a, x = a[stay], x[stay]
                sims = x @ y.T
                sims[a[:, None] == b[None, :]] = -np.inf
                best = sims.max(1, initial=-np.inf)
                other = np.where(sims >= best[:, None] - 5e-13, b[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
                ok = best > -np.inf
                m = int(ok.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*a[ok].tolist(), None], pa.int64()), pa.array([k] * (m + 1), batch.schema.field(kind).type), pa.array([*other[ok].tolist(), None], pa.int64()), pa.array([*np.round(best[ok], 12).tolist(), None], pa.float64()), pa.array([None] * m + [sims.size], pa.int64())],
                    names=["id", kind, "other", "similarity", "met"],
                )

    return run


def with_source(findings: DataFrame, items: DataFrame) -> DataFrame:
    """Findings with their item's source, "unknown" without one."""
    of = items.select(F.col("id").alias("item_id"), F.col("source").alias("_s"))
    return findings.join(of, "item_id", "left").withColumn("source", F.coalesce("_s", F.lit("unknown"))).drop("_s")


def new_mentions(assigned: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """Assigned findings (cluster_id, source, seen_on) with is_new: first of its triple, and not stored before."""
    keys = ["cluster_id", "source", "seen_on"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
    return assigned.withColumn("_first", first).join(known, keys, "left").withColumn("is_new", F.col("_first") & F.col("_known").isNull()).drop("_first", "_known")


def mention_sets(mentions: DataFrame) -> DataFrame:
    """Per cluster the sets of sources and days and the number of distinct (source, day)."""
    once = mentions.select("cluster_id", "source", "seen_on").distinct()
    return once.groupBy("cluster_id").agg(
        F.array_sort(F.collect_set("source")).alias("sources_seen"), F.array_sort(F.collect_set("seen_on")).alias("days_seen"), F.count(F.lit(1)).alias("mention_count")
    )


def record_mentions(clusters: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Clusters after new mentions (cluster_id, source, seen_on): counts up, sets joined, last_seen now where any came."""
    add = mention_sets(fresh).select(F.col("cluster_id").alias("_c"), F.col("sources_seen").alias("_s"), F.col("days_seen").alias("_d"), F.col("mention_count").alias("_n"))
    joined = clusters.join(add, F.col("id") == F.col("_c"), "left")
    hit = F.col("_c").isNotNull()
    union = lambda c, x: F.when(hit, F.array_union(F.coalesce(c, F.array().cast(clusters.schema[c].dataType)), F.col(x))).otherwise(F.col(c))
    return joined.withColumns({
        "sources_seen": union("sources_seen", "_s"), "days_seen": union("days_seen", "_d"),
        "mention_count": (F.coalesce("mention_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast(clusters.schema["mention_count"].dataType),
        "last_seen": F.when(hit, now).otherwise(F.col("last_seen")),
    }).select(*clusters.columns)
