import json
import re
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from signalmill.operators import models
from signalmill.sources import hits as H
from signalmill.streaming import incremental as I


@pytest.fixture
def service():
    """A search over ``hits`` that serves 40 of them at most and tells how many there are; it keeps what it was asked."""
    hits, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
            found = list(hits)
            for field, op, value in re.findall(r"(\w+)(>=|<)(-?\d+)", q.get("numericFilters", "")):
                found = [h for h in found if h[field] is not None and (h[field] >= int(value) if op == ">=" else h[field] < int(value))]
            if url.path == "/list":
                body = [{"objectID": h["objectID"], "created_at_i": h["created_at_i"], "text": h["text"]} for h in hits]
            else:
                size, page = int(q["hitsPerPage"]), int(q["page"])
                asked.append((size, q["numericFilters"]))
                served = sorted(found, key=lambda h: -h["created_at_i"])[:40]
                body = {"hits": served[page * size : (page + 1) * size], "nbHits": len(found), "nbPages": -(-len(served) // size)}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", hits, asked
    httpd.shutdown()


def hit(i, at=None, points=None):
    return {"objectID": str(i), "created_at_i": 1000 + i if at is None else at, "points": points, "text": f"text of hit {i}"}


def source(url, endpoint="search", **config):
    own = {"adapter_impl": "hackernews", "searches": [{"tags": "story"}], "result_cap": 40, "hits_per_page": 10, "overlap_hours": 0} if endpoint == "search" else {"hits_path": "", "pages_path": "", "page_param": "", "hits_per_page_param": ""}
    return {"name": "s", "config_json": json.dumps({"base_url": url, "endpoint": endpoint, "text_fields": ["text"]} | own | config)}


def test_halving_covers_a_range_once():
    stamps = [5, 5, 5, 6, 9, 9, 30, 31, 31, 31, 31]
    count = lambda a, b: sum(a <= s < b for s in stamps)
    cuts = H.halved(count, 0, 40, 3)
    assert cuts[0][0] == 0 and cuts[-1][1] == 40 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert all(count(a, b) <= 3 or b - a == 1 for a, b in cuts) and H.halved(count, 7, 8, 0) == [(7, 8)]


def test_bounds_go_to_the_service_and_a_capped_search_is_many_tasks(spark, service):
    url, hits, asked = service
    hits += [hit(i, points=i % 100 if i % 3 else None) for i in range(400)]
    table = H.table_of(spark, source(url))
    some = table.where("created_at_i >= 1100 and created_at_i < 1301 and points > 9 and seq = 0")
    plan = some._jdf.queryExecution().executedPlan().toString()
    # What the service bounds is not compared again; the number of the search is.
    condition = re.search(r"Filter (.*)", plan)[1]
    assert re.search(r"seq#\d+ = 0", condition) and "created_at_i" not in condition and not re.search("[<>]", condition)
    got = sorted(int(json.loads(r.hit)["objectID"]) for r in some.collect())
    assert got == [i for i in range(100, 301) if i % 3 and i % 100 > 9]
    assert some.rdd.getNumPartitions() > 2
    reads = [f for size, f in asked if size == 10]
    assert reads and all("points>=10" in f and "created_at_i<" in f for f in reads)
    whole = table.where("created_at_i < 2000").select("hit").collect()
    assert sorted(int(json.loads(r.hit)["objectID"]) for r in whole) == list(range(400)), "no hit twice, none lost"
    assert table.where("created_at_i < 10 and created_at_i > 20").count() == 0
    # Without an upper bound a search walks down by its earliest hit; a listing knows no bounds and is cut here.
    assert table.where("created_at_i >= 1350").select("hit").distinct().count() == 50
    listing = H.table_of(spark, source(url, "list")).where("created_at_i = 1007 and points is null")
    assert [json.loads(r.hit)["objectID"] for r in listing.collect()] == ["7"]


@pytest.mark.parametrize("endpoint", ["search", "list"])
def test_a_stream_that_dies_loses_and_repeats_nothing(spark, service, tmp_path, endpoint):
    url, hits, _ = service
    where, check, judged = str(tmp_path / "items"), str(tmp_path / "check"), tmp_path / "judged"
    spec = source(url, endpoint, overlap_hours=0.05)

    def run(now, fails=False):
        def judge(fresh, batch_id):
            models.triage(fresh).select("source_id", "worth_reading").write.mode("overwrite").parquet(f"{judged}/batch={batch_id}")
            if fails:
                raise OSError("the host went away")

        q = I.insert_stream(H.stream_of(spark, spec, 1000, now), where, check, judge).trigger(availableNow=True).start()
        q.awaitTermination()

    hits += [hit(i) for i in range(60)]
    run(1060)
    hits += [hit(i) for i in range(60, 130)] + [hit(900, at=1055)]
    with pytest.raises(Exception, match="the host went away"):
        run(1130, fails=True)
    # The planned batch is the one that is repeated; what came meanwhile belongs to the next one.
    hits += [hit(i) for i in range(130, 150)] + [hit(901, at=1100)]
    run(1150)
    assert not {"140", "149"} & {r.source_id for r in spark.read.parquet(where).collect()}
    run(1150)
    want = sorted([str(i) for i in range(150)] + ["900", "901"])
    assert sorted(r.source_id for r in spark.read.parquet(where).collect()) == want
    assert sorted(r.source_id for r in spark.read.parquet(str(judged)).collect()) == want
    offsets = sorted(int(f.name) for f in (tmp_path / "check" / "commits").iterdir() if f.name.isdigit())
    assert offsets == list(range(len(offsets))) and len(offsets) == 3
    run(1150)
    assert spark.read.parquet(where).count() == len(want)
