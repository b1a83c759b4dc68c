"""Atom and RSS feeds by Spark's XML functions, whatever their namespaces."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.functions.text import blank_to_null, clean_html, content_hash
from signalmill.functions.times import iso_epoch, rfc822_epoch
from signalmill.sources.apis import http_get, windowed
from signalmill.sources.registry import reader

ATOM = (
    "id string, title string, summary string, content struct<_VALUE:string,_type:string>, published string, updated string, "
    "link array<struct<_href:string,_rel:string>>, author array<struct<name:string>>, category array<struct<_term:string>>"
)
RSS = "guid struct<_VALUE:string,_isPermaLink:string>, title string, description string, link string, pubDate string, category array<string>"
_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE"}


def entries(bodies: DataFrame, tag: str) -> DataFrame:
    """One XML text per ``tag`` element of the feeds' bodies (feed, body); a body that is no feed has none."""
    # Elements are cut out as text, so one broken entry costs no other; prefixes of tags go, CDATA becomes text.
    plain = F.regexp_replace(F.col("body"), r"<(/?)(?!xml\b)[A-Za-z][\w.-]*:([A-Za-z])", "<$1$2")
    found = F.regexp_extract_all(plain, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.lit(0))
    return bodies.select("feed", F.posexplode(found).alias("pos", "xml"))


def atom_fields(xml: DataFrame) -> DataFrame:
    """id, title, summary (else content), link (alternate first), created_at_i (published, else updated), authors, categories."""
    e = xml.withColumn("e", F.from_xml("xml", ATOM, _OPTIONS))
    text = lambda c: blank_to_null(F.col(c))
    named = F.filter("e.link", lambda x: x["_href"].isNotNull())
    first = F.filter(named, lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    stamp = F.coalesce(text("e.published"), text("e.updated"))
    full = lambda a: F.when(F.size(a) > 0, a)
    return e.select(
        "feed", text("e.id").alias("id"), text("e.title").alias("title"), F.coalesce(text("e.summary"), text("e.content._VALUE")).alias("summary"),
        F.coalesce(F.get(first, F.lit(0))["_href"], F.get(named, F.lit(0))["_href"]).alias("link"), iso_epoch(stamp).alias("created_at_i"),
        full(F.filter(F.transform("e.author", lambda a: blank_to_null(a["name"])), lambda a: a.isNotNull())).alias("authors"),
        full(F.filter(F.transform("e.category", lambda c: c["_term"]), lambda c: c.isNotNull())).alias("categories"),
    )


def rss_fields(xml: DataFrame) -> DataFrame:
    """The same of RSS items: guid, description, link, pubDate, category texts."""
    e = xml.withColumn("e", F.from_xml("xml", RSS, _OPTIONS))
    text = lambda c: blank_to_null(F.col(c))
    categories = F.filter(F.transform("e.category", lambda c: blank_to_null(c)), lambda c: c.isNotNull())
    return e.select(
        "feed", text("e.guid._VALUE").alias("id"), text("e.title").alias("title"), text("e.description").alias("summary"), text("e.link").alias("link"),
        rfc822_epoch(F.col("e.pubDate")).alias("created_at_i"), F.lit(None).cast("array<string>").alias("authors"), F.when(F.size(categories) > 0, categories).alias("categories"),
    )


def feed_fields(bodies: DataFrame) -> DataFrame:
    """Entries of Atom feeds and items of RSS feeds together."""
    return atom_fields(entries(bodies, "entry")).unionByName(rss_fields(entries(bodies, "item")))


def map_entries(fields: DataFrame, source: str, config: dict) -> DataFrame:
    """Items of feed fields: all text fields joined by blank lines; the id is its field, else id, else link."""
    known = set(fields.columns)
    col = lambda c: F.col(c) if c in known else F.lit(None).cast("string")
    clean = bool(config.get("clean_html"))

    def text(c: str) -> Column:
        value = blank_to_null(col(c).cast("string"))
        return F.nullif(clean_html(value), F.lit("")) if clean else value

    extra = [c for c in config.get("metadata_fields", []) if c in known]
    metadata = F.to_json(F.struct(*[F.col(c) for c in extra])) if extra else F.lit(None).cast("string")
    out = fields.select(
        F.lit(source).alias("source"), F.coalesce(blank_to_null(col(config.get("id_field", "id"))), "id", "link").alias("source_id"), col(config.get("url_field", "link")).alias("url"),
        F.nullif(F.concat_ws("\n\n", *[text(c) for c in config.get("text_fields", ["title", "summary"])]), F.lit("")).alias("raw_text"), "created_at_i",
        F.lit(None).cast("string").alias("thread_id"), F.nullif(metadata, F.lit("{}")).alias("metadata"),
    )
    kept = out.where("raw_text is not null and source_id is not null and created_at_i is not null")
    return kept.select("source", "source_id", "url", "raw_text", content_hash(F.col("raw_text")).alias("content_hash"), "created_at_i", "thread_id", "metadata")


def feed_urls(config: dict) -> list[str]:
    """The feeds of a source: feed_urls, else feed_url, else base_url with its endpoint."""
    if config.get("feed_urls"):
        return list(config["feed_urls"])
    if config.get("feed_url"):
        return [config["feed_url"]]
    base = (config.get("base_url") or "").rstrip("/")
    return [f"{base}/{config['endpoint']}" if config.get("endpoint") else base] if base else []


def fetch_feeds(spark: SparkSession, urls: list[str], timeout: float = 20) -> DataFrame:
    """(feed, body, error), one task a feed. A dead feed has an error and no body."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            bodies, errors = [], []
            for url in batch.column(0).to_pylist():
                try:
                    bodies.append(http_get(url, {}, timeout).decode("utf-8", "replace"))
                    errors.append(None)
                except OSError as error:
                    bodies.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(errors, pa.string())], names=["feed", "body", "error"])

    frame = spark.createDataFrame([(u,) for u in urls], "feed string").repartition(max(1, len(urls)))
    return frame.mapInArrow(run, "feed string, body string, error string")


def all_dead(fetched: DataFrame) -> bool:
    return fetched.where("body is not null").isEmpty()


@reader("atom")
@reader("rss")
def read_feeds(spark: SparkSession, source: dict, since: int, until: int | None = None) -> DataFrame:
    """Items of a source's feeds in its window; raises if every feed is dead."""
    config = source["config_json"]
    config = json.loads(config) if isinstance(config, str) else config
    fetched = fetch_feeds(spark, feed_urls(config), float(config.get("timeout_seconds", 20))).cache()
    if all_dead(fetched):
        raise RuntimeError(f"all feeds of {source['name']} are dead")
    items = map_entries(feed_fields(fetched.where("body is not null")), source["name"], config)
    return windowed(items, since, until, float(config.get("overlap_hours", 6)))
