import pytest
from pyspark.sql import functions as F

from signalmill.operators.merged import MergedTable
from signalmill.plans import nightly
from tests.engine.test_nightly import fetched

SCHEMA = "id long, body string, state string, attempts int"


def table(spark, root):
    return MergedTable(spark, str(root), SCHEMA, mutable=("state", "attempts"), clears=("body",), buckets=4)


def rows(spark, *ranges):
    return spark.range(*ranges).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("body"), F.lit("ready").alias("state"), F.lit(0).alias("attempts"))


def test_newest_change_wins_and_cleared_stays_cleared(spark, tmp_path):
    t = table(spark, tmp_path).insert(rows(spark, 100)).insert(rows(spark, 100, 130))
    t = t.change(spark.createDataFrame([(i, "work", 1) for i in (1, 2, 3, 105)], "id long, state string, attempts int"))
    t = t.change(spark.createDataFrame([(1, "done", 1, True), (2, None, None, False), (999, "done", 1, True)], "id long, state string, attempts int, clear boolean"))
    t = t.change(spark.createDataFrame([(1, "late", 2)], "id long, state string, attempts int"))
    want = {1: (None, "late", 2), 2: ("text 2", None, None), 3: ("text 3", "work", 1), 105: ("text 105", "work", 1)}
    for now in (t, t.compact(F.col("state") == "late"), t.compact(F.lit(False)).compact(F.col("id") < 50).compact(F.lit(True))):
        got = {r.id: (r.body, r.state, r.attempts) for r in now.read().collect()}
        assert len(got) == 130 and {i: got[i] for i in want} == want and got[7] == ("text 7", "ready", 0)
    assert [(s.kind, s.rows) for s in t.compact(F.col("state") == "late").segments] == [("settled", 1), ("open", 129)]
    assert t.compact(F.col("state") == "late").read(open_only=True).count() == 129


def test_settled_segments_are_joined_and_none_are_lost(spark, tmp_path):
    t = table(spark, tmp_path)
    for k in range(5):
        t = t.insert(rows(spark, 10 * k, 10 * k + 10)).compact(F.col("id") % 2 == 0, most_settled=2)
    assert sorted(r.id for r in t.read().collect()) == list(range(50)) and len([s for s in t.segments if s.kind == "settled"]) <= 2


def test_rows_are_not_shuffled(spark, tmp_path):
    t = table(spark, tmp_path).insert(rows(spark, 1000)).change(rows(spark, 20).withColumn("state", F.lit("done")))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = t.read().groupBy("id").agg(F.max("state"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scan, exchange = plan.index("Bucketed: true"), plan.index("Exchange")
    # The one exchange is that of the changes, which have a number.
    assert plan.count("Exchange") == 1 and exchange > scan and "number" in plan[exchange:] and "Bucketed" not in plan[exchange:]


def test_what_was_not_saved_is_not_read(spark, tmp_path):
    t = table(spark, tmp_path).insert(rows(spark, 10)).save(1)
    t.change(rows(spark, 5).withColumn("state", F.lit("lost"))).compact(F.lit(True)).insert(rows(spark, 10, 20))
    again = table(spark, tmp_path).at(1)
    assert again.read().count() == 10 and again.read().where("state = 'lost'").count() == 0
    assert table(spark, tmp_path).read().count() == 0 and table(spark, tmp_path).at(0).compact(F.lit(True)).segments == ()


def test_a_wave_writes_its_own_rows_only(spark, tmp_path, monkeypatch):
    written = []
    real = MergedTable.change

    def counted(self, changed):
        out = real(self, changed)
        written.append(out.segments[-1].rows)
        return out

    monkeypatch.setattr(MergedTable, "change", counted)
    state = nightly.run(nightly.State(spark, str(tmp_path)), fetched(spark, 40), "2024-01-30 03:00:00", p=nightly.Parameters(wave=6, max_items=12), clock=lambda: 0.0)
    # The night's structural decisions first, then waves of six, whatever the table's size.
    assert written[0] == 40 and len(written) >= 3 and max(written[1:]) <= 6
    written.clear()
    nightly.run(state, fetched(spark, 4, 40), "2024-01-31 03:00:00", p=nightly.Parameters(wave=6, max_items=6), clock=lambda: 0.0)
    assert written[0] == 4 and max(written[1:]) <= 6


def test_a_night_that_dies_between_its_files_and_the_pointer(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    one = nightly.run(nightly.State(spark, root), fetched(spark, 12), "2024-01-30 03:00:00", p=nightly.Parameters(max_items=5, wave=5), clock=lambda: 0.0)
    before = sorted(map(str, one.read("items").collect()))

    def dies(self, version):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(nightly.State, "completed", dies)
        with pytest.raises(OSError, match="lost"):
            nightly.run(one, fetched(spark, 12, 6), "2024-01-31 03:00:00", clock=lambda: 0.0)
    last = nightly.State.latest(spark, root)
    assert last.version == 1 and sorted(map(str, last.read("items").collect())) == before
    two = nightly.run(nightly.State.latest(spark, root), fetched(spark, 12, 6), "2024-01-31 03:00:00", clock=lambda: 0.0)
    items = two.read("items").collect()
    assert len(items) == 18 and {r.state for r in items} <= set(nightly.FINAL) and sorted(r.id for r in items) == list(range(1, 19))
