"""Not-modified revisit resolution: an as-of join of 304 captures to the latest earlier full response.

Captures are matched by canonical URL. A not-modified capture takes the latest strictly earlier full (200) capture of its
URL; of several at that instant the one with the largest record id. Validators are checked against that response: an
entity tag by weak comparison if the capture names one, else the modification date; without either the link is taken
on the URL alone and says so. Resolved captures get the response's headers, overlaid with the capture's own headers of
the names that a 304 may update.

[native] DataFrame functions only. Scale: bodies are not moved, only digests. A URL's captures are split into time
buckets at the same quantiles for all URLs, so one URL with a third of all captures is dealt over as many windows as
there are buckets; the last full capture of each (URL, bucket) is carried forward by a window over at most
``buckets`` rows a URL. Captures without URL, time or record id go past the windows. Captures of one URL at one instant
are one task's rows.

Defined results: captures with a null or blank URL, a null time or record id resolve to nothing ("no_earlier"); null headers
are empty; other statuses than 200 and 304 are ignored; repeated rows each give a row; URLs and headers of any length are
read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header names that a not-modified response may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Query parameters that do not select content.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"


#: An absolute or network-path URL: scheme, authority, path, query.
_ABSOLUTE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?]+)([^?]*)(?:\?(.*))?$"


def canonical_url(url: Column) -> Column:
    """What captures of one resource have in common; null for a null or blank URL.

    "//host/path?query" for http, https and network-path URLs, "scheme://..." for others: host in lower case without the
    scheme's default port, path without final slashes, content parameters in order. What has no authority (a relative
    reference, a mail address) stands for itself. A fragment is no part of any of them.
    """
    bare = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    part = lambda k: F.coalesce(F.regexp_extract(bare, _ABSOLUTE, k), F.lit(""))
    scheme = F.lower(part(1))
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").when(scheme == "", ":(80|443)$").otherwise("(?!)")
    host, path = F.regexp_replace(F.lower(part(2)), port, F.lit("")), F.regexp_replace(part(3), "/+$", "")
    params = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    lead = F.when(scheme.isin("", "http", "https"), F.lit("//")).otherwise(F.concat(scheme, F.lit("://")))
    whole = F.concat(lead, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(bare.rlike(_ABSOLUTE), whole).otherwise(F.nullif(bare, F.lit("")))


def http_seconds(date: Column) -> Column:
    """The instant of an HTTP date in seconds, null if it is none; the weekday plays no part."""
    text = F.regexp_extract(date, r"(\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) (?:GMT|UTC|[+-]0000)\s*$", 1)
    return F.unix_timestamp(F.try_to_timestamp(F.concat(F.nullif(text, F.lit("")), F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z")))


def same_date(a: Column, b: Column) -> Column:
    """Equal texts, or HTTP dates of one instant."""
    return (F.trim(a) == F.trim(b)) | F.coalesce(http_seconds(a) == http_seconds(b), F.lit(False))


def weak_tag(tag: Column) -> Column:
    """An entity tag without its weakness mark."""
    return F.regexp_replace(F.trim(tag), "^[Ww]/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers with the permitted fresh ones in place of theirs."""
    new = F.map_filter(fresh, lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def resolve_revisits(records: DataFrame, buckets: int = 64) -> DataFrame:
    """Per 304 record: record_id, canonical_url, target_id, target_ts, digest, state and headers.

    ``records``: record_id (of any orderable type), url, ts long (any unit), status int, etag, last_modified, digest strings, headers
    map<string,string> with lower-case names. state: resolved_etag, resolved_date, resolved_url, mismatch, no_earlier.
    """
    none = F.create_map().cast("map<string,string>")
    rows = records.where("status in (200, 304)").select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "status", "etag", "last_modified", "digest",
        F.coalesce("headers", none).alias("headers"),
    )
    # What can have no earlier response takes no part in the windows, where all blank URLs would be one.
    usable = F.col("ts").isNotNull() & F.col("record_id").isNotNull() & F.col("canonical_url").isNotNull()
    lone, rows = rows.where(~usable & (F.col("status") == 304)), rows.where(usable)
    cuts = [k / buckets for k in range(1, buckets)]
    edges = rows.agg(F.percentile_approx("ts", cuts, 10_000)).first()[0]
    edges = sorted(set(edges or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("ts"))) if edges else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    order = F.when(F.col("status") == 200, F.struct("ts", "record_id"))
    held = F.struct(F.col("record_id").alias("id"), "ts", "etag", "last_modified", "digest", "headers")

    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Buckets that hold 304 records only have to be there too, to receive what is carried.
    slots = rows.groupBy("canonical_url", "bucket").agg(F.max(order).alias("at"), F.max_by(held, order).alias("own"))
    carried = slots.withColumn("carried", F.max_by("own", "at").over(before)).select("canonical_url", "bucket", "carried").where("carried is not null")
    earlier = Window.partitionBy("canonical_url", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("inside", F.max_by(held, order).over(earlier)).where("status = 304").join(carried, ["canonical_url", "bucket"], "left")
    found = seen.withColumn("r", F.coalesce("inside", "carried"))
    state = (
        F.when(F.col("r").isNull(), "no_earlier")
        .when(F.col("etag").isNotNull(), F.when(weak_tag(F.col("etag")) == weak_tag(F.col("r.etag")), "resolved_etag").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull(), F.when(same_date(F.col("last_modified"), F.col("r.last_modified")), "resolved_date").otherwise("mismatch"))
        .otherwise("resolved_url")
    )
    done = F.col("state").startswith("resolved")
    out = found.withColumn("state", state).select(
        "record_id", "canonical_url", F.when(done, F.col("r.id")).alias("target_id"), F.when(done, F.col("r.ts")).alias("target_ts"),
        F.when(done, F.col("r.digest")).alias("digest"), "state", F.when(done, merged_headers(F.col("r.headers"), F.col("headers"))).alias("headers"),
    )
    nothing = {"target_id": "record_id", "target_ts": "ts", "digest": "digest", "headers": "headers"}
    alone = lone.withColumns({k: F.when(F.lit(False), F.col(c)) for k, c in nothing.items()}).withColumn("state", F.lit("no_earlier"))
    return out.union(alone.select(*out.columns))


def _fields(block: Column) -> Column:
    """The "Name: value" lines of a header block as a map with lower-case names, the first of equal names."""
    lines = F.filter(F.split(block, "\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    name = lambda x: F.lower(F.substring_index(x, ":", 1))
    names = F.transform(lines, name)
    firsts = F.filter(lines, lambda x, i: F.array_position(names, name(x)) == i + 1)
    return F.map_from_entries(F.transform(firsts, lambda x: F.struct(name(x).alias("key"), F.trim(F.regexp_replace(x, "(?s)^[^:]*:", "")).alias("value"))))


def warc_records(raw: DataFrame, record: str = "record") -> DataFrame:
    """``resolve_revisits``' input from WARC records as texts (header block, blank line, HTTP block with its headers).

    Responses with status 200 are full captures, revisits of the server-not-modified profile are 304; other records,
    revisits by equal payload digest among them, are left out. A revisit that names the target it refers to
    (WARC-Refers-To-Target-URI) is matched by that URI. Validators are those of the HTTP headers, times are in
    microseconds, ids are the records' own.
    """
    blocks = F.split(F.col(record), "\r?\n\r?\n", 3)
    head = raw.select(_fields(F.get(blocks, F.lit(0))).alias("w"), F.coalesce(F.get(blocks, F.lit(1)), F.lit("")).alias("h"))
    field = lambda m, k: F.try_element_at(m, F.lit(k))
    http = head.select("w", _fields(F.col("h")).alias("f"), F.regexp_extract("h", r"^HTTP/\S+ (\d{3})", 1).try_cast("int").alias("code"))
    kind, profile = F.lower(field("w", "warc-type")), F.coalesce(field("w", "warc-profile"), F.lit(""))
    status = F.when((kind == "response") & (F.col("code") == 200), 200).when((kind == "revisit") & profile.contains("server-not-modified"), 304)
    url = F.coalesce(F.when(kind == "revisit", field("w", "warc-refers-to-target-uri")), field("w", "warc-target-uri"))
    return http.withColumn("status", status).where("status is not null").select(
        field("w", "warc-record-id").alias("record_id"), F.regexp_replace(url, "^<|>$", "").alias("url"), F.unix_micros(F.try_to_timestamp(field("w", "warc-date"))).alias("ts"), "status",
        field("f", "etag").alias("etag"), field("f", "last-modified").alias("last_modified"), field("w", "warc-payload-digest").alias("digest"), F.col("f").alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log over ``pages``: each page is fetched in full at minute page_id and asked again at page_id + 7 (page_id
    mod 5 of 0 to 3) or one minute before its own fetch (4), under a variant of its URL, with a matching tag, weak tag,
    date (with or without its weekday) or no validator; every tenth tag is another one's. Six of 16 pages go by a URL
    without scheme, a mail address, a network path, a blank, one shared bare name, or another scheme with a port."""
    i = F.col("page_id")
    odd = i % 16
    rest = F.regexp_replace("url", "^[A-Za-z]+://", "")
    url = (
        F.when(odd == 10, rest).when(odd == 11, F.concat(F.lit("mailto:p"), (i % 5).cast("string"))).when(odd == 12, F.concat(F.lit("//H.example:80/"), (i % 7).cast("string"), F.lit("/")))
        .when(odd == 13, F.lit(" ")).when(odd == 14, F.lit("other.org/b?utm_x=1")).when(odd == 15, F.concat(F.lit("FTP://"), rest)).otherwise(F.col("url"))
    )
    p = pages.where("page_id is not null").select("page_id", url.alias("url"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    tag = F.concat(F.lit('"'), F.left("digest", F.lit(16)), F.lit('"'))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(i / 1440).cast("int"))
    date = F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT"))
    k = i % 5
    full = p.select(
        (i * 2).alias("record_id"), "url", i.alias("ts"), F.lit(200).alias("status"), tag.alias("etag"), date.alias("last_modified"), "digest",
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("cache-control"), F.lit("max-age=60"), F.lit("x-cache"), F.lit("miss")).alias("headers"),
    )
    asked = F.when(i % 10 == 1, F.lit('"other"')).when(k == 0, tag).when(k == 1, F.concat(F.lit("W/"), tag))
    bare_date = F.concat(F.date_format(day, "d MMM yyyy"), F.lit(" 00:00:00 GMT"))
    again = p.select(
        (i * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"),
        (i + F.when(k == 4, -1).otherwise(7)).alias("ts"), F.lit(304).alias("status"), asked.alias("etag"),
        F.when(k == 2, F.when(i % 2 == 0, date).otherwise(bare_date)).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=120"), F.lit("x-cache"), F.lit("hit"), F.lit("date"), i.cast("string")).alias("headers"),
    )
    return full.unionByName(again)
