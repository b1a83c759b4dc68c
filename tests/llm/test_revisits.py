import random

import pytest

from signalmill.llm import revisits as R

SCHEMA = "record_id long, url string, ts long, status int, etag string, last_modified string, digest string, headers map<string,string>, bucket int"


def brute(rows):
    out = {}
    for i, url, ts, status, etag, date, *_ in rows:
        if status != 304:
            continue
        full = [r for r in rows if r[3] == 200 and None not in (r[0], r[1], r[2], url, ts, i) and r[1] == url and r[2] < ts]
        r = max(full, key=lambda r: (r[2], r[0]), default=None)
        weak = lambda t: t.removeprefix("W/") if t else t
        if r is None:
            state = "no_earlier"
        elif etag is not None:
            state = "resolved_etag" if weak(etag) == weak(r[4]) and r[4] else "mismatch"
        elif date is not None:
            state = "resolved_date" if date == r[5] else "mismatch"
        else:
            state = "resolved_url"
        out.setdefault(i, []).append((state, r[0] if r and state.startswith("resolved") else None))
    return {k: sorted(v, key=str) for k, v in out.items()}


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_equals_brute_force(spark, buckets):
    rng = random.Random(buckets)
    rows = [
        (i if i % 29 else None, rng.choice(["h/a", "h/b", "h/hot", "h/hot", "h/hot", None]), rng.choice([*range(40), None]), rng.choice([200, 304, 304, 404]), rng.choice(['"x"', 'W/"x"', '"y"', None]), rng.choice(["d1", "d2", None]), "dg", None, 1)
        for i in range(400)
    ]
    frame = spark.createDataFrame([(r[0], r[1] and "http://" + r[1], *r[2:]) for r in rows], SCHEMA)
    got: dict = {}
    for r in R.resolve_revisits(frame, buckets).collect():
        got.setdefault(r.record_id, []).append((r.state, r.target_id))
    assert {k: sorted(v, key=str) for k, v in got.items()} == brute(rows)
    assert R.resolve_revisits(frame.limit(0)).collect() == []


def test_headers_and_urls(spark):
    rows = [
        (1, "HTTP://Ex.org:80/a/?b=2&utm_source=f&a=1#x", 1, 200, '"e"', "d", "dg", {"etag": '"e"', "content-length": "9", "set-cookie": "s"}, 0),
        (2, "https://ex.org/a?a=1&b=2", 2, 304, 'W/"e"', None, None, {"cache-control": "no-store", "content-length": "0", "etag": 'W/"e"'}, 0),
    ]
    r = R.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.canonical_url == "//ex.org/a?a=1&b=2" and r.target_id == 1 and r.digest == "dg"
    assert r.headers == {"etag": 'W/"e"', "content-length": "9", "set-cookie": "s", "cache-control": "no-store"}


def test_urls_are_told_apart(spark):
    same = [["http://h/p", "HTTPS://H:443/p/", "//h:80/p", " http://h/p#x"], ["ftp://h:80/p"], ["h/p"], ["other.org/b"], ["mailto:x"], ["mailto:y"], ["/p"], ["http://h:8080/p"], ["http://h:443/p"], ["x?u=http://h/p"], [None, "", "  ", "#x"], ["http://h/p?b=1&a=2", "http://h/p?a=2&gclid=7&b=1"], ["///p"], ["//h2/p\nq"]]
    rows = [(k, u) for k, urls in enumerate(same) for u in urls]
    got = spark.createDataFrame(rows, "k int, u string").select("k", R.canonical_url(R.F.col("u")).alias("c")).collect()
    of: dict = {}
    for r in got:
        of.setdefault(r.k, set()).add(r.c)
    assert all(len(v) == 1 for v in of.values()) and len({next(iter(v)) for v in of.values()}) == len(same) and of[10] == {None}
    records = [(1, "example.com/a", 1, 200, None, None, "d1", None, 0), (2, "other.org/b", 2, 304, None, None, None, None, 0), (3, "", 1, 200, None, None, "d3", None, 0), (4, "", 2, 304, None, None, None, None, 0), (5, "example.com/a", 3, 304, None, None, None, None, 0)]
    found = {r.record_id: (r.state, r.target_id) for r in R.resolve_revisits(spark.createDataFrame(records, SCHEMA)).collect()}
    assert found == {2: ("no_earlier", None), 4: ("no_earlier", None), 5: ("resolved_url", 1)}


def test_http_dates_repeated_rows_and_long_values(spark):
    d = lambda x: (x, "http://h/p", 2, 304, None, x, None, None, 0)
    long = "http://h/" + "p" * 200_000
    rows = [(1, "http://h/p", 1, 200, None, "Sun, 06 Nov 1994 08:49:37 GMT", "d", None, 0), (10, "http://h/p", 2, 304, None, "6 Nov 1994 08:49:37 GMT", None, None, 0), (11, "http://h/p", 2, 304, None, "Sun, 06 Nov 1994 08:49:38 GMT", None, None, 0), (12, "http://h/p", 2, 304, None, "junk", None, None, 0)]
    rows += [rows[1], (20, long, 1, 200, '"e"', None, "d", {"x": "y" * 100_000}, 0), (21, long, 2, 304, '"e"', None, None, None, 0)]
    got = [(r.record_id, r.state, len(r.headers["x"]) if r.record_id == 21 else 0) for r in R.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == [(10, "resolved_date", 0), (10, "resolved_date", 0), (11, "mismatch", 0), (12, "mismatch", 0), (21, "resolved_etag", 100_000)]


def test_warc_records(spark):
    head = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:{}>\r\nWARC-Target-URI: <{}>\r\nWARC-Date: {}\r\n{}\r\n"
    response = head.format("response", "a", "http://h/p", "2024-01-01T00:00:00Z", "WARC-Payload-Digest: sha1:X\r\n") + 'HTTP/1.1 200 OK\r\nETag: "e"\r\nContent-Type: text/html\r\nX-A: 1\r\nx-a: 2\r\n\r\nbody: text\r\n\r\nmore'
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/{}\r\n"
    revisit = head.format("revisit", "b", "https://h/p/", "2024-01-02T00:00:00Z", profile.format("server-not-modified")) + 'HTTP/1.1 304 Not Modified\r\nETag: W/"e"\r\n\r\n'
    other = head.format("revisit", "c", "http://elsewhere/", "2024-01-03T00:00:00Z", profile.format("server-not-modified") + "WARC-Refers-To-Target-URI: http://h/p\r\n")
    rest = [head.format("revisit", "d", "http://h/p", "2024-01-02T00:00:00Z", profile.format("identical-payload-digest")), head.format("request", "e", "http://h/p", "2024-01-02T00:00:00Z", ""), "junk", "", None, response.replace("200 OK", "500 No").replace("urn:a", "urn:f")]
    raw = spark.createDataFrame([(r,) for r in [response, revisit, other, *rest]], "record string")
    records = R.warc_records(raw)
    assert sorted(r.record_id for r in records.collect()) == ["<urn:a>", "<urn:b>", "<urn:c>"]
    got = {r.record_id: r for r in R.resolve_revisits(records).collect()}
    assert (got["<urn:b>"].state, got["<urn:b>"].target_id, got["<urn:b>"].digest) == ("resolved_etag", "<urn:a>", "sha1:X")
    assert got["<urn:b>"].headers == {"etag": 'W/"e"', "content-type": "text/html", "x-a": "1"} and got["<urn:c>"].state == "resolved_url"


def test_blank_urls_meet_no_window(spark):
    from signalmill.llm.revisits import resolve_revisits

    schema = "record_id long, url string, ts long, status int, etag string, last_modified string, digest string, headers map<string,string>"
    rows = [(1, "http://a/", 1, 200, "e", None, "d", {}), (2, "http://a", 2, 304, "e", None, None, None), (3, None, 3, 304, "e", None, "x", {"date": "d"}), (4, " ", 3, 304, None, None, None, None), (None, "http://a", 3, 304, "e", None, None, None), (6, "http://a", None, 304, "e", None, None, None), (7, None, 1, 200, "e", None, "d", {})]
    out = resolve_revisits(spark.createDataFrame(rows, schema))
    got = {r.record_id: (r.state, r.target_id, r.target_ts, r.digest, r["headers"]) for r in out.collect()}
    assert got == {2: ("resolved_etag", 1, 1, "d", {}), **{k: ("no_earlier", None, None, None, None) for k in (3, 4, None, 6)}}
