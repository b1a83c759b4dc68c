"""What the operators of this subpackage share: durable intermediate tables, byte-level words, component labelling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []
BATCH_BYTES = 4_000_000

#: Maps A-Z to a-z and every other byte to itself.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a folder of our own.

    A cluster without that setting is refused, as a machine-local folder would lose tables with their machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="signalmill-"))
    return _LOCAL_ROOT[0]


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ``BATCH_BYTES`` at most, as rows are texts of any length.

    The session's limit is lowered once and stays, so queries that run at the same time see one value; results do not
    depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    The table stays for as long as the shared folder's owner keeps it.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader so that any store works."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]], schema: str) -> DataFrame:
    """``mapInArrow`` with one function per task: ``make()`` builds it, it maps a batch to columns named in ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            got = step(batch)
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)
        release_memory()

    return df.mapInArrow(run, schema)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of ``edges`` (a, b longs) as (node, root), root the smallest node of its component.

    Alternating large-star and small-star rounds; each is two shuffles of at most as many rows as there are edges, so
    a star with a hot centre stays a plain aggregate. Every round is written to the shared folder. Nulls and self
    loops are dropped; a node without a proper edge has no row. Rounds go on until the edges stay the same, which is told by
    their number and the sum of their hashes.
    """

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()

    now = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), f"{tag}-cc"
    )
    before = state(now)
    while True:
        # Large star: each node's larger neighbours are hung on its smallest neighbour (or itself).
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # Small star: each node's smaller neighbours and itself are hung on the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        nxt = materialize(small.where("a > b").distinct(), f"{tag}-cc")
        now, after = nxt, state(nxt)
        if after == before:
            roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        before = after


def release_memory() -> None:
    """Give freed memory back to the system; a reused worker would keep it beside its executor's next stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python process does, so that reused workers keep what is costly to build."""
    import sys
    import types

    module = sys.modules.setdefault("_signalmill_worker_cache", types.ModuleType("_signalmill_worker_cache"))
    return module.__dict__.setdefault(name, {})
