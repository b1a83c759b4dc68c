import corpus_pipeline as P

from signalmill.llm import decontaminate, quality, secrets, simhash

SF = "/root/testdata/sf0.001"


def test_stages_in_order_equal_their_operators_decisions(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {r.doc_id for r in docs.collect()}
    for name, stage in P.STAGES:
        if name == "quality":
            kept = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
        elif name == "near_dedup":
            kept = {r.doc_id for r in simhash.near_duplicates(docs).where("doc_id = component_id").collect()}
        elif name == "decontaminate":
            kept = {r.doc_id for r in decontaminate.decontaminate(docs, bench).where("n_hit = 0").collect()}
        else:
            kept = want
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
        if name == "secrets":
            assert secrets.find_secrets(docs).where("spans != ''").count() == 0
        want = kept
    direct = P.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, direct.collect())) == sorted(map(key, docs.collect()))


def test_stages_with_odd_rows(spark):
    rows = [(1, "some words to keep here", "en", "s", 23), (1, "some words to keep here", "en", "s", 23), (1, "another text altogether, quite different words", None, None, None), (None, None, None, None, None), (None, "text", "en", "s", 4), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).collect() == []
        if name == "near_dedup":
            got = out.collect()
            assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 2] or sorted(r.doc_id or 0 for r in got) == [0, 0, 1]
        assert out.count() <= len(rows)


def test_very_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{i % 977} and so on." for i in range(60_000))
    rows = [(1, long, "en", "s", len(long), "x", 1.0, 7), (2, "Some plain words stand here for the pipeline to keep.", "en", "s", 52, "y", 2.0, 8), (3, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, k int")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "score", "k"]
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert all(kept[i] == t for i, t, *_ in rows if i in kept)
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(kept)
