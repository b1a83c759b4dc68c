"""A keyed table whose changes are small files, merged on read.

The table is a list of segments. Row segments hold whole rows, bucketed and sorted by key; a key is in one of them. Change
segments hold the key and the columns that may change; the newest change of a key wins. What a writer adds is seen by
readers of a list that names it, and a list is written last, so a writer that dies leaves the table as it was and its
files unread.

Reads join the row segments with the newest changes. The row segments are one bucketed scan, so only changes are shuffled
(or broadcast, by their size), and joins and aggregates on the key need no exchange of the rows either. ``compact`` folds
the changes in: rows that can no longer change go to a settled segment, which is neither rewritten nor read by those that
look for open rows only; the others become the new open segment. Its cost follows the open and changed rows. Many settled
segments are joined into one now and then.

Defined results: a change of an unknown key does nothing; of changes written together a key has one; a null in a change is
a value; ``clears`` columns become null with the first change that asks for it and stay so; rows need a key that no other
row has.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, SETTLED, CHANGE = "open", "settled", "change"
SEGMENT = "kind string, folder string, number long, rows long, buckets int"


class Segment(NamedTuple):
    kind: str
    folder: str
    number: int
    rows: int


@dataclass(frozen=True)
class MergedTable:
    """A version of a table under ``root``; every method that writes gives the next one, which ``save`` makes permanent.

    ``mutable`` are the columns that changes hold, ``clears`` those that a change with ``clear`` true sets to null.
    """

    spark: SparkSession
    root: str
    schema: str
    key: str = "id"
    mutable: tuple[str, ...] = ()
    clears: tuple[str, ...] = ()
    buckets: int = 8
    segments: tuple[Segment, ...] = ()

    def at(self, version: int) -> MergedTable:
        """The table as ``save`` wrote it; version 0 is empty."""
        if not version:
            return replace(self, segments=())
        rows = self.spark.read.schema(SEGMENT).parquet(f"{self.root}/segments/v{version}").collect()
        segments = sorted((Segment(*r[:4]) for r in rows), key=lambda s: s.number)
        return replace(self, segments=tuple(segments), buckets=rows[0]["buckets"] if rows else self.buckets)

    def save(self, version: int) -> MergedTable:
        """Write the list of segments: one row a segment, some dozens."""
        self.spark.createDataFrame([(*s, self.buckets) for s in self.segments], SEGMENT).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/segments/v{version}")
        return self

    def _of(self, *kinds: str) -> list[Segment]:
        return [s for s in self.segments if s.kind in kinds]

    def _with(self, kind: str, folder: str, gone: tuple[str, ...] = ()) -> MergedTable:
        rows = self.spark.read.schema(f"{self.key} {self._types()[self.key]}").parquet(f"{self.root}/{folder}").count()
        number = max((s.number for s in self.segments), default=0) + 1
        kept = tuple(s for s in self.segments if s.kind not in gone)
        return replace(self, segments=kept + ((Segment(kind, folder, number, rows),) if rows else ()))

    def _types(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.spark.createDataFrame([], self.schema).schema}

    def _bucketed(self, df: DataFrame) -> str:
        """Write rows as a bucketed segment, one file a bucket; its folder's name is new, so leftovers are never met."""
        folder = f"rows/segment={uuid.uuid4().hex}"
        name = f"signalmill_{uuid.uuid4().hex}"
        dealt = df.select(*self._types()).repartition(self.buckets, self.key)
        dealt.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.root}/{folder}").saveAsTable(name)
        # The definition goes, the files stay.
        self.spark.sql(f"DROP TABLE {name}")
        return folder

    def _rows(self, kinds: tuple[str, ...]) -> DataFrame:
        """The row segments of these kinds as one bucketed scan, a partition a segment."""
        segments = self._of(*kinds)
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        name = "signalmill_" + hashlib.md5(f"{self.root}{self.schema}{self.buckets}{[s.folder for s in segments]}".encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self.schema}, segment STRING) USING parquet PARTITIONED BY (segment) CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/rows'")
            parts = " ".join(f"PARTITION (segment = '{s.folder.partition('=')[2]}') LOCATION '{self.root}/{s.folder}'" for s in segments)
            self.spark.sql(f"ALTER TABLE {name} ADD {parts}")
        return self.spark.table(name).drop("segment")

    def newest(self) -> DataFrame:
        """The newest change of each key, with whether any cleared."""
        changes = self._of(CHANGE)
        types = self._types()
        shape = ", ".join(f"{c} {types[c]}" for c in (self.key, *self.mutable)) + ", clear boolean, number long"
        every = self.spark.read.schema(shape).parquet(*[f"{self.root}/{s.folder}" for s in changes]) if changes else self.spark.createDataFrame([], shape)
        return every.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(F.struct(*self.mutable), "number").alias("_new"), F.bool_or("clear").alias("_clear"))

    def read(self, open_only: bool = False) -> DataFrame:
        """The rows as they are now; ``open_only`` leaves out those that were settled when last compacted."""
        rows = self._rows((OPEN,) if open_only else (OPEN, SETTLED))
        if not self._of(CHANGE):
            return rows
        joined = rows.join(self.newest(), F.col(self.key) == F.col("_key"), "left")
        hit = F.col("_key").isNotNull()
        new = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in self.mutable}
        new |= {c: F.when(~F.coalesce("_clear", F.lit(False)), F.col(c)).alias(c) for c in self.clears}
        return joined.select(*[new.get(c, F.col(c)) for c in rows.columns])

    def insert(self, rows: DataFrame) -> MergedTable:
        """The table with more rows, of keys that it does not have."""
        return self._with(OPEN, self._bucketed(rows))

    def change(self, changed: DataFrame) -> MergedTable:
        """The table with the ``mutable`` columns of ``changed`` rows; a boolean column ``clear`` is optional."""
        number = max((s.number for s in self.segments), default=0) + 1
        clear = F.coalesce("clear", F.lit(False)) if "clear" in changed.columns else F.lit(False)
        folder = f"changes/{uuid.uuid4().hex}"
        changed.select(self.key, *self.mutable, clear.alias("clear"), F.lit(number).cast("long").alias("number")).write.parquet(f"{self.root}/{folder}")
        return self._with(CHANGE, folder)

    def compact(self, settled: Column, most_settled: int = 32) -> MergedTable:
        """The same rows without changes; rows that meet ``settled`` go to a segment of their own."""
        if not self._of(OPEN, CHANGE):
            return self
        now, done = self.read(open_only=True), F.coalesce(settled, F.lit(False))
        out = self._with(SETTLED, self._bucketed(now.where(done)))._with_open(self._bucketed(now.where(~done)))
        if len(out._of(SETTLED)) > most_settled:
            out = out._with(SETTLED, out._bucketed(out._rows((SETTLED,))), (SETTLED,))
        return out

    def _with_open(self, folder: str) -> MergedTable:
        return self._with(OPEN, folder, (OPEN, CHANGE))
