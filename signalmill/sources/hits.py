"""Hits of paged sources as a table with time bounds, and as a stream with a high-water mark.

Format "signalmill_hits": one row a hit (seq, hit as JSON, created_at_i, points, low, high). As a batch it takes bounds of
time and points from the query's filters, and a search is one partition a time range, halved as long as the service counts
more hits in it than it serves. As a stream its offset is the source's high-water mark in seconds: a batch reads from the
mark less the configured overlap up to now, so late items are met again and keys make that harmless (``insert_stream``). Spark
commits an offset after the batch's sink is done, so what was fetched but not judged is fetched again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from signalmill.sources.apis import SEARCH_CAP, Ask, PagedReader, Sequence, hit_list, map_hits, map_issues, stamp_of

SCHEMA = "seq int, hit string, created_at_i long, points long, low long, high long"


class TimeRange(InputPartition):
    """A search of [low, high) with at least so many points."""

    def __init__(self, number: int, search: dict, low: int, high: int | None, points: int | None = None):
        self.number, self.search, self.low, self.high, self.points = number, search, low, high, points


def halved(count: Callable[[int, int], int], low: int, high: int, cap: int) -> list[tuple[int, int]]:
    """[low, high) in ranges of at most ``cap`` hits as ``count`` tells, or of one second."""
    out, todo = [], [(low, high)]
    while todo:
        a, b = todo.pop()
        if b - a <= 1 or count(a, b) <= cap:
            out.append((a, b))
        else:
            middle = (a + b) // 2
            todo += [(middle, b), (a, middle)]
    return out


def _number(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


class Service:
    """What batch and stream share: asking a configured source for hits of a range."""

    def __init__(self, config: dict):
        self.config, self.searched = config, config.get("adapter_impl") == "hackernews"

    def pages(self, low: int, high: int | None, points: int | None = None, **config) -> PagedReader:
        """The paging of [low, high); the overlap is the caller's."""
        reader = PagedReader(self.config | {"overlap_hours": 0} | config, low, high)
        reader.least_points = points
        return reader

    def count(self, search: dict, low: int, high: int, points: int | None = None) -> int:
        """The service's count of a range's hits, by a page of one."""
        reader = self.pages(low, high, points, hits_per_page=1)
        return int(json.loads(reader.ask_for(search, Ask(0, high=high))).get("nbHits") or 0)

    def ranges(self, low: int, high: int | None, points: int | None = None) -> list[TimeRange]:
        """One partition a search and range. Listings and issues have no upper bound to ask for, so they are one each."""
        out = []
        for part in self.pages(low, high).partitions():
            if self.searched and high is not None and low < high:
                cap = int(self.config.get("result_cap", SEARCH_CAP))
                cuts = halved(lambda a, b, s=part.search: self.count(s, a, b, points), low, high, cap)
            else:
                cuts = [(low, high)]
            out += [TimeRange(part.number, part.search, a, b, points) for a, b in cuts]
        return out

    def hits(self, part: TimeRange) -> Iterable[tuple]:
        reader = self.pages(part.low, part.high, part.points)
        for _, _, body in reader.read(Sequence(part.number, part.search)):
            for hit in hit_list(json.loads(body), reader.path):
                stamp, points = (stamp_of(hit.get(reader.field), reader.iso), _number(hit.get("points"))) if isinstance(hit, dict) else (None, None)
                if stamp is None or stamp < part.low or part.high is not None and stamp >= part.high:
                    continue
                if part.points is None or points is not None and points >= part.points:
                    yield part.number, json.dumps(hit), stamp, points, part.low, part.high


class HitsReader(DataSourceReader):
    """Hits between the bounds that the query's filters give."""

    def __init__(self, config: dict):
        self.service, self.low, self.high, self.points = Service(config), 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of created_at_i are taken from any source, bounds of points by searches; the rest is left to Spark."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("created_at_i",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual)) and value is not None:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    end = value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            elif name == ("points",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and value is not None and self.service.searched:
                least = value + isinstance(f, GreaterThan)
                self.points = least if self.points is None else max(self.points, least)
            elif not (name == ("created_at_i",) and isinstance(f, IsNotNull)):
                yield f

    def partitions(self):
        return [] if self.high is not None and self.high <= self.low else self.service.ranges(self.low, self.high, self.points)

    def read(self, partition):
        # Without partitions Spark asks for one that is None.
        return iter(()) if partition is None else self.service.hits(partition)


class HitsStream(DataSourceStreamReader):
    """Hits since the high-water mark; the mark is the time up to which was read."""

    def __init__(self, config: dict, since: int, now: int | None):
        self.service, self.since, self.now = Service(config), since, now
        self.overlap = int(float(config.get("overlap_hours", 6 if self.service.searched else 0)) * 3600)

    def initialOffset(self) -> dict:
        return {"until": self.since}

    def latestOffset(self) -> dict:
        return {"until": max(self.since, int(time.time()) if self.now is None else self.now)}

    def partitions(self, start: dict, end: dict):
        low, high = start["until"] - self.overlap, end["until"]
        return self.service.ranges(low, high) if start["until"] < high else []

    def read(self, partition):
        return self.service.hits(partition)


class HitsSource(DataSource):
    """Options: config (JSON); for streams since and, where a clock is not wanted, now (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "signalmill_hits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return HitsReader(json.loads(self.options["config"]))

    def streamReader(self, schema):
        now = self.options.get("now")
        return HitsStream(json.loads(self.options["config"]), int(self.options.get("since", "0")), int(now) if now else None)


def _config(source: dict) -> dict:
    config = source["config_json"]
    return json.loads(config) if isinstance(config, str) else config


def table_of(spark: SparkSession, source: dict) -> DataFrame:
    """The hits of a source; filters on created_at_i and points go to the service."""
    spark.dataSource.register(HitsSource)
    # Python sources are told of filters only where the session allows it.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("signalmill_hits").option("config", json.dumps(_config(source))).load()


def items_of(hits: DataFrame, source: dict) -> DataFrame:
    """Items of hits, as the batch readers give them."""
    config = _config(source)
    if config.get("adapter_impl") == "github":
        return map_issues(hits, source["name"])
    return map_hits(hits, source["name"], config)


def stream_of(spark: SparkSession, source: dict, since: int, now: int | None = None) -> DataFrame:
    """The items of a source from ``since`` on, as a stream."""
    spark.dataSource.register(HitsSource)
    r = spark.readStream.format("signalmill_hits").option("config", json.dumps(_config(source))).option("since", str(since))
    return items_of((r if now is None else r.option("now", str(now))).load(), source)
