import datetime
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from signalmill.operators import judgements as J

AT = datetime.datetime(2024, 1, 31, tzinfo=datetime.UTC)


def judged(spark, ids, parts=3):
    one = F.struct(F.lit("pain").alias("kind"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("statement"), F.lit("w").alias("why_it_matters"), F.lit(None).cast("string").alias("domain"), F.lit("").alias("evidence_quote"), F.lit(0.5).alias("confidence"))
    rows = spark.createDataFrame([(i,) for i in ids], "id long").repartition(parts)
    return rows.select("id", F.lit("done").alias("state"), F.lit(1).alias("attempts"), F.lit("2024-01-31 00:00:00").cast("timestamp").alias("processing_at"), F.when(F.col("id") % 3 != 2, F.array_repeat(one, (F.col("id") % 3).cast("int"))).alias("findings"))


def test_batches_are_read_by_their_lists(spark, tmp_path):
    root = str(tmp_path)
    assert [d.count() for d in J.read(spark, root)] == [0, 0]
    J.save(judged(spark, range(20)), root, "a")
    J.save(judged(spark, range(20, 25)), "file://" + root, "b")
    J.save(judged(spark, []), root, "c")
    items, findings = J.read(spark, root)
    assert sorted(r.id for r in items.collect()) == list(range(25)) and sorted((r.item_id, r.pos, r.statement, r.confidence) for r in findings.collect()) == [(i, 0, f"s{i}", 0.5) for i in range(25) if i % 3 == 1]
    assert sorted(r.id for r in J.read(spark, root, "b")[0].collect()) == list(range(20, 25)) and items.first().processing_at == datetime.datetime(2024, 1, 31)
    # A batch that is written again replaces its list, and what was written before is not read any more.
    J.save(judged(spark, range(30, 33), 1), root, "b")
    assert sorted(r.id for r in J.read(spark, root)[0].collect()) == [*range(20), 30, 31, 32]


def test_a_task_that_fails_leaves_nothing_of_any_to_be_read(spark, tmp_path):
    root = str(tmp_path)
    J.save(judged(spark, range(4)), root, "before")
    bad = judged(spark, range(100, 130)).withColumn("state", F.when(F.col("id") == 111, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("state")))
    with pytest.raises(Exception, match="lost"):
        J.save(bad, root, "bad")
    assert [n for n in os.listdir(tmp_path / "commits") if n.endswith(".json")] == ["before.json"]
    items, findings = J.read(spark, root)
    assert sorted(r.id for r in items.collect()) == [0, 1, 2, 3] and findings.where("item_id > 3").count() == 0


def test_death_between_the_files_and_a_task_that_runs_twice(spark, tmp_path, monkeypatch):
    writer = J.JudgementWriter(str(tmp_path), "x")
    finding = Row(kind="pain", statement="s", why_it_matters="", domain="", evidence_quote="", confidence=1.0)
    rows = [Row(id=i, state="done", attempts=1, processing_at=AT, findings=[finding] * (i % 2)) for i in range(6)]
    real, made = J.pq.ParquetWriter, []

    def second_fails(path, *a, **k):
        made.append(path)
        if len(made) == 2:
            raise OSError("disk")
        return real(path, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(J.pq, "ParquetWriter", second_fails)
        with pytest.raises(OSError, match="disk"):
            writer.write(iter(rows))
    assert os.listdir(tmp_path / "files") == []
    # A speculative copy writes files of its own; the one whose message is committed counts.
    first, second = writer.write(iter(rows)), writer.write(iter(rows))
    writer.commit([first, None])
    items, findings = J.read(spark, str(tmp_path), "x")
    assert (first.n_items, first.n_findings) == (second.n_items, second.n_findings) == (6, 3) and items.count() == 6 and findings.count() == 3
    writer.abort([second])
    assert len(os.listdir(tmp_path / "files")) == 2


def test_many_rows_pass_in_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "_ROWS", 7)
    rows = [Row(id=i, state="done", attempts=None, processing_at=None, findings=None) for i in range(50)]
    assert J.JudgementWriter(str(tmp_path), "g").write(iter(rows)).n_items == 50
