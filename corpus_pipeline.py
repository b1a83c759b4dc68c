"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir); its result, written as Parquet, is the next one's ``docs``. All but the last
return the columns of ``documents``.

1. quality: documents that the classifier rejects go. The classifier learns from ``labels`` joined to the stage's own
   input.
2. near_dedup: of each group of near duplicates the document with the smallest doc_id stays. Rows that repeat a doc_id
   are one document; the row with the smallest text hash stays. Rows without doc_id cannot be named by a group and stay.
3. decontaminate: documents with any benchmark window go. 4. secrets: every secret span is replaced by a mark.
5. pack: the pieces of what is left, placed in sequences.

Defined results: a null text is an empty one to every stage and stays null until it is packed as the end id alone; texts
of any length are read whole; of equal rows under one doc_id one stays; rows of any extra columns keep them up to the last
stage, whatever they are called; an empty table gives no rows; without labels nothing is rejected, without a benchmark
nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalmill.llm.common import materialize, table
from signalmill.llm.decontaminate import keep_clean
from signalmill.llm.packing import pack
from signalmill.llm.quality import keep_good
from signalmill.llm.secrets import redact
from signalmill.llm.simhash import keep_representatives

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, every stage written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
