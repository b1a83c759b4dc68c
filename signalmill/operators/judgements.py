"""Items and findings of judgements, written together or not at all.

Format "signalmill_judgements": a row is a judged item (id, state, attempts, processing_at) with its findings. A task writes
two Parquet files, one of item changes and one of findings, and reports their names; the driver's commit lists the files of
all tasks in one file that appears by a rename, and readers read what commits list and nothing else. So a task that dies
between its two files leaves neither to be seen, a task that ran twice counts once, and a batch that is written again under its
name replaces its list.

Options: root (a folder that driver and executors share, of a file system that pyarrow knows) and batch (the commit's name).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from signalmill.schema import FINDING

ITEMS = "id long, state string, attempts int, processing_at timestamp"
FINDINGS = "item_id long, pos int, " + FINDING
JUDGED = f"{ITEMS}, findings array<struct<{', '.join(x.replace(' ', ':') for x in FINDING.split(', '))}>>"
_ROWS = 10_000


@dataclass
class Written(WriterCommitMessage):
    """The files of one task and their rows."""

    items: str
    findings: str
    n_items: int
    n_findings: int


def _folder(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class JudgementWriter(DataSourceWriter):
    def __init__(self, root: str, batch: str):
        self.root, self.batch = root.rstrip("/"), batch

    def write(self, iterator: Iterator[Row]) -> Written:
        files, path = _folder(self.root)
        files.create_dir(f"{path}/files")
        name = uuid.uuid4().hex
        out = Written(f"files/{name}-items.parquet", f"files/{name}-findings.parquet", 0, 0)
        texts = [x.split(" ") for x in FINDING.split(", ")]
        items = pa.schema([("id", pa.int64()), ("state", pa.string()), ("attempts", pa.int32()), ("processing_at", pa.timestamp("us", "UTC"))])
        findings = pa.schema([("item_id", pa.int64()), ("pos", pa.int32())] + [(c, pa.float64() if t == "double" else pa.string()) for c, t in texts])
        try:
            with pq.ParquetWriter(f"{path}/{out.items}", items, filesystem=files) as left, pq.ParquetWriter(f"{path}/{out.findings}", findings, filesystem=files) as right:
                changed, found = [], []

                def flush() -> None:
                    left.write_table(pa.Table.from_pylist(changed, items))
                    right.write_table(pa.Table.from_pylist(found, findings))
                    out.n_items, out.n_findings = out.n_items + len(changed), out.n_findings + len(found)
                    changed.clear(), found.clear()

                for r in iterator:
                    changed.append({c: r[c] for c in items.names})
                    found += [{"item_id": r["id"], "pos": k} | {c: f[c] for c, _ in texts} for k, f in enumerate(r["findings"] or [])]
                    if len(changed) + len(found) >= _ROWS:
                        flush()
                flush()
        except BaseException:
            _remove(files, path, out)
            raise
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, path = _folder(self.root)
        done = [m for m in messages if isinstance(m, Written)]
        files.create_dir(f"{path}/commits")
        # Hidden from readers until it has its name.
        with files.open_output_stream(f"{path}/commits/_{self.batch}") as f:
            f.write("".join(json.dumps({"batch": self.batch} | vars(m)) + "\n" for m in done).encode())
        files.move(f"{path}/commits/_{self.batch}", f"{path}/commits/{self.batch}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, path = _folder(self.root)
        for m in messages:
            if isinstance(m, Written):
                _remove(files, path, m)


def _remove(files: fs.FileSystem, path: str, written: Written) -> None:
    for name in (written.items, written.findings):
        if files.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
            files.delete_file(f"{path}/{name}")


class JudgementSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signalmill_judgements"

    def schema(self) -> str:
        return JUDGED

    def writer(self, schema, overwrite: bool) -> JudgementWriter:
        return JudgementWriter(self.options["root"], self.options["batch"])


def save(judged: DataFrame, root: str, batch: str) -> None:
    """Write judged items (the columns of ``JUDGED``) under the name of a batch: letters, digits and dashes."""
    spark = judged.sparkSession
    spark.dataSource.register(JudgementSink)
    want = spark.createDataFrame([], JUDGED).schema
    judged.select(*[judged[f.name].cast(f.dataType) for f in want]).write.format("signalmill_judgements").mode("append").option("root", root).option("batch", batch).save()


def read(spark: SparkSession, root: str, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(item changes, findings) of a batch or of all; the lists hold one row a task."""
    root = root.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    lists = spark.read.schema("batch string, items string, findings string").json(f"{root}/commits") if known else spark.createDataFrame([], "batch string, items string, findings string")
    named = (lists if batch is None else lists.where(lists["batch"] == batch)).collect()
    of = lambda shape, names: spark.read.schema(shape).parquet(*[f"{root}/{n}" for n in names]) if names else spark.createDataFrame([], shape)
    return of(ITEMS, [r["items"] for r in named]), of(FINDINGS, [r["findings"] for r in named])
