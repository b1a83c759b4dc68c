import json

import pytest
from pyspark.sql import functions as F

from signalmill.functions import jsons, scoring, text, times, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def s(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("value,want", [("a" * 39, True), ("a" * 40, False), (" a\n" * 19, True), (None, True), ("word " * 8, True), ("words " * 8, False)])
def test_too_short(spark, value, want):
    assert one(spark, text.too_short(s(value))) is want


@pytest.mark.parametrize("value,want", [("  HTTPS://x.y/z \n", True), ("see https://x.y", False), ("https://x y", False), (None, False)])
def test_link_only(spark, value, want):
    assert one(spark, text.link_only(s(value))) is want


def test_hash_ignores_case_and_any_white_space(spark):
    import hashlib

    want = hashlib.sha256(b"a b c").hexdigest()
    for value in ("A b c", "  a\tB\n\nc ", "a b c", "a\x1cb\x1fc"):
        assert one(spark, text.content_hash(s(value))) == want


def test_clean_html(spark):
    html = "<p>one<br/>two &amp; &#x27;three&#x27; <a href='x'>link</a></p>\n\n\n\n<div>4 &lt; 5 &copy &hellip;</div>"
    assert one(spark, text.clean_html(s(html))) == "one\ntwo & 'three' link\n\n4 < 5 © …"
    assert one(spark, text.clean_html(s("<p class='x'>a</p><script>b</script>"))) == "a\nb"
    assert one(spark, text.clean_html(s(None))) is None
    assert one(spark, text.clean_html(s("a&ampp{} &amp; &copy 1 &copy; &#x27;&#39 &ampx; &amp;lt;&quot"), closed_only=True)) == "a&ampp{} & &copy 1 © '&#39 &ampx; &lt;&quot"


def test_page_queries_equal_their_sql_on_entities_without_semicolon(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(1, "<p>AT&ampT &amp; x&ampp{}</p>"), (2, "&copy 2024 &copy; &quot&quot;"), (3, "&am<b>p; &amp;lt; &amp"), (4, "&ampquot; &lt&lt;"), (5, None)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("clean_html_pages", "clean_html_builtin_pages"):
        assert dict(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())) == dict(con.sql(entry.oracle_sql()[name]).fetchall()), name


def test_titles_and_links(spark):
    assert one(spark, text.normalize_title(s("## **New  Model!** (3 minute read)"))) == "new model"
    assert one(spark, text.normalize_title(s("Émile & co"))) == "mile co"
    assert one(spark, text.sanitize_links(s("a [**[X] y**](http://u?t=1) b https://z/q c [w\nv](u)"))) == "a **[X] y** b  c w\nv"
    assert one(spark, text.free_lines(s("a\n# Subscribe to Foo to unlock the rest\nb"))) == ["a"]
    assert one(spark, text.free_lines(s("a\nb"))) == ["a", "b"]
    assert one(spark, text.content_lines(F.split(s(" a \n---\n🎁\n**\n9"), "\n"))) == ["a", "9"]


def test_names_and_keys(spark):
    assert one(spark, text.publication_name(s('"T AI" <d@t.com>'), s("slug"))) == "T AI"
    assert one(spark, text.publication_name(s("d@t.com"), s("slug"))) == "d"
    assert one(spark, text.publication_name(s(""), s("slug"))) == "slug"
    assert one(spark, text.thread_key(s(""), F.lit(5))) == "_item:5"
    assert one(spark, text.thread_key(s("t"), F.lit(5), s("src"))) == "src/t"
    assert one(spark, text.strip_nul(s("a\x00b"))) == "ab"
    got = one(spark, text.split_db_url(s("postgresql://user.ref:p@ss:w@db.proj.host.co:6543/postgres")))
    assert (got.user, got.password, got.host, got.port, got.database, got.project) == ("user.ref", "p@ss:w", "db.proj.host.co", 6543, "postgres", "proj")
    nested = spark.range(1).select(F.array(F.struct(F.lit("a\x00").alias("k"), F.lit(1).alias("n"))).alias("v"))
    assert nested.select(text.strip_nul_deep(F.col("v"), nested.schema["v"].dataType).alias("x")).first().x[0].k == "a"


@pytest.mark.parametrize("value,want", [("2024-01-02T03:04:05Z", 1704164645), ("2024-01-02T03:04:05+02:00", 1704157445), ("2024-01-02 03:04:05", 1704164645), ("2024-01-02", 1704153600), ("soon", None), (None, None)])
def test_iso(spark, value, want):
    assert one(spark, times.iso_epoch(s(value))) == want


@pytest.mark.parametrize("value,want", [("Tue, 02 Jan 2024 03:04:05 +0000", 1704164645), ("2 Jan 2024 03:04:05 GMT", 1704164645), ("Tue, 02 Jan 2024 05:04:05 +0200", 1704164645), ("Tue", None), (None, None)])
def test_rfc822(spark, value, want):
    assert one(spark, times.rfc822_epoch(s(value))) == want


def test_windows_and_ages(spark):
    ts = F.lit(1000)
    assert one(spark, times.in_window(ts, F.lit(1000), F.lit(1001))) and not one(spark, times.in_window(ts, F.lit(900), F.lit(1000)))
    assert one(spark, times.in_window(ts, F.lit(4600), overlap_hours=1)) and not one(spark, times.in_window(ts, F.lit(4601), overlap_hours=1))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    at = lambda t: F.lit(t).cast("timestamp")
    assert one(spark, times.recent(at("2024-01-24 00:00:00"), now)) and not one(spark, times.recent(at("2024-01-23 23:59:59"), now)) and one(spark, times.recent(at(None), now)) is False
    assert one(spark, times.time_since(at("2024-01-30 22:01:00"), now)) == "119m ago" and one(spark, times.time_since(at("2024-01-30 22:00:00"), now)) == "2h ago" and one(spark, times.time_since(at(None), now)) == "?"
    assert one(spark, times.long_date(F.lit("2024-02-03").cast("date"))) == "3 February 2024"
    assert one(spark, times.epoch(s("17"), False)) == 17 and one(spark, times.epoch(s("x"), False)) is None


def test_scores(spark):
    score = lambda *a: one(spark, scoring.recurrence_score(*[F.lit(x) for x in a]))
    assert score(3, 5, 8, True) == pytest.approx(18.67, abs=0.01) and score(1, 1, 30, True) == pytest.approx(10.45, abs=0.01)
    assert one(spark, scoring.set_size(F.lit(None).cast("array<string>"))) == 0
    assert one(spark, scoring.rate(F.lit(1), F.lit(0))) == 0.0
    assert scoring.per_source_quota(100, 0.29) == 28 and scoring.per_source_quota(3, 0.01) == 1
    assert [one(spark, scoring.cap_for_thread(F.lit(a), F.lit(b))) for a, b in ((0, 5), (1, 5), (2, 5), (3, 1), (0, 1))] == [2, 1, 0, 0, 1]


@pytest.mark.parametrize("sim,want", [(None, "new"), (0.7499, "new"), (0.75, "tiebreak"), (0.8999, "tiebreak"), (0.9, "merge"), (1.0, "merge")])
def test_decide(spark, sim, want):
    assert one(spark, vectors.decide(F.lit(sim).cast("double"))) == want


def test_vectors(spark):
    assert one(spark, vectors.format_vector(F.array(F.lit(0.1), F.lit(-2.0)))) == "[0.100000,-2.000000]"
    assert one(spark, vectors.parse_vector(s("[0.5,1]"))) == [0.5, 1.0]
    assert one(spark, vectors.normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8]) and one(spark, vectors.normalize(F.array(F.lit(0.0)))) == [0.0]


GOOD = '{"kind":"pain","statement":"s","why_it_matters":"","domain":"d","evidence_quote":"q","confidence":0.5,"extra":1}'


@pytest.mark.parametrize("raw,n,word", [
    (f"[{GOOD}]", 1, None), ("[]", 0, None), (f"[{GOOD}, {GOOD}]", 2, None), ("not json", None, "JSON"), (f"[{GOOD}] trailing", None, "JSON"), (GOOD, None, "array"), ("[1]", None, "element 0"),
    (f'[{GOOD}, {{"kind":"x"}}]', None, "element 1 lacks confidence"), (f"[{GOOD.replace('0.5', '1.5')}]", None, "confidence"), (f"[{GOOD.replace('0.5', 'true')}]", None, "confidence"),
    (f"[{GOOD.replace('0.5', 'NaN')}]", None, "confidence"), (f'[{GOOD.replace(chr(34) + "s" + chr(34), chr(34) + " " + chr(34))}]', None, "statement"), (None, None, "JSON"),
])
def test_findings_are_judged_strictly(spark, raw, n, word):
    r = spark.createDataFrame([(raw,)], "r string").select(jsons.validate_findings("r").alias("v")).first().v
    assert (None if r.findings is None else len(r.findings)) == n and (word is None) == (r.error is None) and (word or "") in (r.error or "")


def test_briefings(spark):
    raw = 'Here: {"night_summary":" quiet ","papers":[{"headline":"h","body":"b","finding_ids":[1,2.7,"x",true,null]},{"headline":" "},3],"gaps":"no"} done'
    answers = [raw, "{}", '{"a":', "[1]", None, '[{"headline":"h"}]', "5", "no object", '{"papers":[{"headline":7,"finding_ids":"x"}]}']
    parsed = spark.createDataFrame(list(enumerate(answers)), "k int, r string").select("k", jsons.parse_briefing("r").alias("b")).select("k", "b.*")
    got = {r.k: r for r in parsed.withColumn("e", jsons.briefing_empty(F.col("sections"))).collect()}
    assert got[0].night_summary == "quiet" and [r.asDict() for r in got[0].sections["papers"]] == [{"headline": "h", "body": "b", "topic": "", "finding_ids": [1, 2]}]
    assert got[0].sections["gaps"] == [] and set(got[0].sections) == set(jsons.SECTIONS) and not got[0].e and got[1].e
    assert [got[k].night_summary for k in (2, 3, 4, 5, 6, 7)] == [jsons.UNPARSEABLE, jsons.NON_OBJECT, jsons.UNPARSEABLE, jsons.NON_OBJECT, jsons.NON_OBJECT, jsons.UNPARSEABLE]
    assert all(got[k].sections == {} and got[k].e for k in (2, 3, 4, 5, 6, 7)) and got[8].sections["papers"][0].headline == "7" and got[8].sections["papers"][0].finding_ids == []


def test_json_columns(spark):
    payload = s('{"id":7,"paper":{"id":"p9"},"likes":3,"none":null}')
    assert one(spark, jsons.url_template("https://x/{paper[id]}/{id}", payload)) == "https://x/p9/7"
    assert one(spark, jsons.url_template("https://x/{missing}", payload)) is None
    assert one(spark, jsons.picked(payload, ["likes", "none"])) == '{"likes":"3"}' and one(spark, jsons.picked(payload, ["none"])) is None
    assert one(spark, jsons.config_value(payload, "nope", 20)) == "20"


HOSTILE = [
    None, "", "  ", "[]", "[] x", "[] []", "[]]", "[],", "[]}", '[],"a":1', "[]\x0b", "{}", "null", "1", '"[]"', "[1]", "[null]", "[[]]", "[{}]", "['a']", "[1,]", "[01]", "﻿[]", " \n[]\t ", "[] // c", "]", "}", '1}, {"v":[]',
]


def answers():
    good = {"kind": "k", "statement": "s é \n", "why_it_matters": None, "domain": "d", "evidence_quote": 'q"', "confidence": 0.25}
    change = lambda **c: json.dumps([good, {**good, **c}])
    yield from HOSTILE
    yield from (json.dumps([good] * n) for n in (1, 3))
    yield from (json.dumps([{k: v for k, v in good.items() if k not in gone}]) for gone in (["kind"], ["why_it_matters", "confidence"], ["domain", "kind", "statement"]))
    yield from (change(confidence=c) for c in (0, 1, 1.0, -0.1, 1.5, True, False, None, "0.5", [0.5], 10**30, 1e-300))
    yield from (change(kind=x) for x in ("", " \t\n", "  ", "\x1c", None, 5, True, [], {}))
    yield from (change(statement=x) for x in ("", "\x85", "x" * 100_000, 0, False))
    yield from (change(**{k: x}) for k in ("confidence", "domain") for x in (float("nan"), float("-inf")))
    yield from ("NaN", "[NaN]", "[-Infinity, {}]", '[{NaN: 1}]', "[-NaN]", "[1NaN]", change(domain='"NaN" \\" \\\\', kind=float("inf")), change(domain="\x01 NaN"), change(domain="a").replace('"a"', '"\x01", "b": NaN'))
    yield change(extra={"a": [1]}, confidence=1)
    yield json.dumps([good]) + " trailing"
    yield json.dumps([good])[:-1]


def test_findings_by_expressions_equal_the_python_contract(spark):
    raws = list(answers())
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", jsons.validate_findings("raw").alias("v")).collect()
    assert len(got) == len(raws)
    for r in got:
        findings, error = jsons.check_findings(raws[r.i])
        assert (r.v.error or "").split(":")[0] == (error or "").split(":")[0] and (error or "").startswith(r.v.error or ""), raws[r.i]
        assert (None if r.v.findings is None else [f.asDict() for f in r.v.findings]) == findings, raws[r.i]
    df = spark.createDataFrame([('[{"kind": 1, "kind": 2}]',), ("[" * 1200 + "]" * 1200,)], "raw string")
    assert {r.e for r in df.select(jsons.validate_findings("raw")["error"].alias("e")).collect()} == {"not valid JSON"}, "no JSON here, unlike for Python"
    assert "Python" not in df.select(jsons.validate_findings("raw"))._jdf.queryExecution().executedPlan().toString()
