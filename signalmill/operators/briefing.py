"""From findings to a briefing: gathering, prompt selection, one item a story, size caps, numbering."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.jsons import SECTIONS
from signalmill.functions.scoring import per_source_quota, set_size
from signalmill.operators.staging import staged
from signalmill.operators.tables import rank_in_order

# The digest's size.
SOMEONE_BUILT_CAP, TOTAL_CAP, HEADLINES = 5, 20, 5


def since(run_started_at: Column | None, now: Column) -> Column:
    """Where tonight begins: the run's start, else a day before now."""
    from signalmill.functions.times import ago

    return ago(now, hours=24) if run_started_at is None else F.coalesce(run_started_at, ago(now, hours=24))


def gather(findings: DataFrame, items: DataFrame, clusters: DataFrame, start: Column) -> DataFrame:
    """Findings since ``start`` with their item's url, source and publication and their cluster's recurrence."""
    of_item = items.select(F.col("id").alias("item_id"), "url", "source", F.get_json_object("metadata", "$.publication").alias("publication"))
    of_cluster = clusters.select(
        F.col("id").alias("cluster_id"), F.col("mention_count").alias("c_mentions"), set_size(F.col("sources_seen")).alias("c_sources"), set_size(F.col("days_seen")).alias("c_days")
    )
    return findings.where(F.col("created_at") >= start).join(of_item, "item_id", "left").join(of_cluster, "cluster_id", "left")


def finding_line() -> Column:
    """A gathered finding as a prompt line; recurrence only where there is any."""
    why = F.nullif(F.trim(F.coalesce(F.col("why_it_matters"), F.lit(""))), F.lit(""))
    recurring = F.when(
        F.col("c_mentions") > 1,
        F.concat(F.lit("recurring: "), F.col("c_mentions").cast("string"), F.lit(" mentions across "), F.col("c_sources").cast("string"), F.lit(" sources, "), F.col("c_days").cast("string"), F.lit(" days")),
    )
    head = F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), F.coalesce("kind", F.lit("?")), F.lit(": "), F.trim(F.coalesce("statement", F.lit(""))))
    return F.concat_ws(" | ", head, F.concat(F.lit("why: "), why), F.concat(F.lit("source: "), F.nullif(F.col("source"), F.lit(""))), F.nullif(F.col("url"), F.lit("")), recurring)


def block(lines: DataFrame, line: str, order: str, placeholder: str) -> DataFrame:
    """One row: the lines in order, or the placeholder. For prompts, whose lines are capped before."""
    got = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n").alias("text"))
    return got.select(F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit(placeholder)).alias("text"))


def synthesis_input(findings_text: Column, shortlist_text: Column) -> Column:
    """The prompt's data part: tonight's lines and the recurring ones."""
    tonight = F.coalesce(F.nullif(findings_text, F.lit("")), F.lit("(none tonight)"))
    before = F.coalesce(F.nullif(shortlist_text, F.lit("")), F.lit("(none yet)"))
    return F.concat(F.lit("Findings of the night:\n"), tonight, F.lit("\n\nRecurring so far:\n"), before)


def select_for_prompt(findings: DataFrame, n: int, share: float = 1.0) -> DataFrame:
    """At most ``n`` findings: the most confident, then newest, then lowest id; a source's quota first, then the rest.

    ``n`` <= 0 keeps all. The global rank orders quota and refill alike, so it need not be computed.
    """
    if n <= 0:
        return findings
    best = [F.coalesce("confidence", F.lit(0.0)).desc(), F.coalesce(F.col("created_at").cast("string"), F.lit("")).desc(), F.col("id")]
    in_source = F.row_number().over(Window.partitionBy("source").orderBy(*best))
    # No source can place more than ``n``, so each task passes on its n best of a source at most.
    few = findings.withColumn("_sr", in_source).where(F.col("_sr") <= n)
    return few.withColumn("_over", F.col("_sr") > per_source_quota(n, share)).orderBy("_over", *best).limit(n).drop("_sr", "_over")


def section_rank(section: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SECTIONS)), section).cast("int")


def flatten(briefings: DataFrame) -> DataFrame:
    """(section, pos, headline, body, topic, finding_ids) rows of parsed briefings with their key columns kept."""
    keys = [c for c in briefings.columns if c not in ("sections", "night_summary")]
    return briefings.select(*keys, F.explode("sections").alias("section", "items")).select(*keys, "section", F.posexplode("items").alias("pos", "i")).select(*keys, "section", "pos", "i.*")


def apply_caps(items: DataFrame, built_cap: int = SOMEONE_BUILT_CAP, total_cap: int = TOTAL_CAP, by: list[str] | None = None) -> DataFrame:
    """The last section's cap first, then the total cap in section order; caps below 0 count as 0."""
    by = by or []
    pos = F.row_number().over(Window.partitionBy(*by, "section").orderBy("pos"))
    # No section can place more than the total, so the last window sees that many of each at most.
    few = items.withColumn("_k", pos).where(F.col("_k") <= max(0, total_cap))
    kept = few.where((F.col("section") != "someone_built") | (F.col("_k") <= max(0, built_cap)))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(section_rank(F.col("section")), "pos"))
    return kept.withColumn("_k", n).where(F.col("_k") <= max(0, total_cap)).drop("_k")


def numbered(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Items with their number ``n`` across sections in document order."""
    order = [section_rank(F.col("section")), F.col("pos")]
    numbered = rank_in_order(items.withColumn("_all", F.lit(0)), by or ["_all"], order, "n", parts=16)
    return numbered.drop("_all").withColumn("n", F.col("n").cast("int"))


def one_per_story(items: DataFrame, by: list[str] | None = None, fold: int = 5_000) -> DataFrame:
    """Items (section, pos, finding_ids, urls) that share no id and no url with an earlier item of their briefing that was
    kept; dropped items add nothing to what is seen. Items of equal section and pos are ordered by their ids and urls.

    An id or url is a list of the items that cite it. In rounds an item that is the first in all its lists is kept and the
    others in these lists fall; lists are aggregates with map-side combine, so one that most items are in is no hot group.
    What is open of a briefing after that, once it is at most ``fold`` items, is folded in order in one task.
    """
    given = items.withColumns({"_b": F.to_json(F.struct(*by)) if by else F.lit(""), "_cites": _cites()})
    order = [section_rank(F.col("section")), F.col("pos"), F.array_join("_cites", "\x00")]
    given = staged(given, "stories")
    if (given.groupBy("_b").count().agg(F.max("count")).first()[0] or 0) <= fold:
        ranked = given.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(*order)).cast("long"))
        kept = [_folded(ranked.select("_b", "_n", F.explode("_cites").alias("_k")))]
        links = None
    else:
        ranked, kept = staged(rank_in_order(given, ["_b"], order, "_n", parts=16), "stories"), []
        links = staged(ranked.select("_b", "_n", F.explode("_cites").alias("_k")), "story-lists")
    while links is not None:
        most = links.groupBy("_b").agg(F.count_distinct("_n").alias("m")).agg(F.max("m")).first()[0] or 0
        if most <= fold:
            kept.append(_folded(links))
            break
        first = staged(links.groupBy("_b", "_k").agg(F.min("_n").alias("_first")), "story-first")
        heads = links.join(first, ["_b", "_k"]).groupBy("_b", "_n").agg(F.bool_and(F.col("_first") == F.col("_n")).alias("_head"))
        heads = staged(heads.where("_head").select("_b", "_n"), "story-heads")
        taken = staged(links.join(heads, ["_b", "_n"]).select("_b", "_k"), "story-taken")
        gone = staged(links.join(taken, ["_b", "_k"]).select("_b", "_n").distinct(), "story-gone")
        kept.append(heads)
        links = staged(links.join(gone, ["_b", "_n"], "left_anti"), "story-lists")
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    return ranked.where(F.size("_cites") == 0).unionByName(ranked.join(found, ["_b", "_n"], "left_semi")).select(*items.columns)


def _cites() -> Column:
    """The distinct ids and urls of an item as texts."""
    ids = F.transform(F.coalesce("finding_ids", F.array().cast("array<bigint>")), lambda x: F.concat(F.lit("i"), x.cast("string")))
    urls = F.transform(F.coalesce("urls", F.array().cast("array<string>")), lambda x: F.concat(F.lit("u"), x))
    return F.array_sort(F.array_distinct(F.filter(F.concat(ids, urls), lambda x: x.isNotNull())))


def _folded(links: DataFrame) -> DataFrame:
    """(_b, _n) of the items kept, of briefings whose items one task may hold."""
    dealt = links.groupBy("_b", "_n").agg(F.collect_list("_k").alias("_ks")).repartition("_b").sortWithinPartitions("_b", "_n")

    def run(batches):
        briefing, seen = None, set()
        for batch in batches:
            kept = []
            for b, n, ks in zip(*(batch.column(c).to_pylist() for c in ("_b", "_n", "_ks"))):
                if b != briefing:
                    briefing, seen = b, set()
                if seen.isdisjoint(ks):
                    seen.update(ks)
                    kept.append((b, n))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["_b", "_n"])

    return dealt.mapInArrow(run, "_b string, _n long")


def with_links(items: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """Items with links (distinct urls of their findings in order), via (publications of url-less ones) and cluster_id
    (the first known), from an index (id, url, publication, cluster_id)."""
    of = index.select(F.col("id").alias("_f"), "url", "publication", "cluster_id")
    exploded = items.select(*key, F.posexplode_outer("finding_ids").alias("_at", "_f")).join(of, "_f", "left")
    meta = exploded.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", F.nullif("url", F.lit("")).alias("url"), F.nullif("publication", F.lit("")).alias("publication"), "cluster_id"))).alias("_m"))
    filled = lambda f: F.array_distinct(F.filter(F.transform("_m", f), lambda x: x.isNotNull()))
    return items.join(meta, key, "left").withColumns({
        "links": filled(lambda x: x["url"]), "via": filled(lambda x: F.when(x["url"].isNull(), x["publication"])),
        "cluster_id": F.get(F.filter(F.transform("_m", lambda x: x["cluster_id"]), lambda x: x.isNotNull()), F.lit(0)),
    }).drop("_m")


def headlines(items: DataFrame, n: int = HEADLINES) -> DataFrame:
    """The first ``n`` numbered items for buttons: number, section, headline, cluster, first link."""
    return items.orderBy("n").limit(n).select("n", "section", "headline", "cluster_id", F.get("links", F.lit(0)).alias("url"))
