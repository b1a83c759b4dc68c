"""The nightly run: pure stages from state to state, each written before the next one reads it.

State is a folder of table versions. A run writes new versions beside the old ones and moves the pointer last, so a run
that dies leaves the state as it was; ids and insert-ignore make a second run harmless.

Items are a merged table (``operators.merged``): a night inserts its new items, each wave writes the changed states of
the items it claimed, and at the end the changes are folded into the open rows, so what is written follows the new items.

Models are asked once an item: each wave of claimed items is judged into a written table, from which findings, states,
counts and the error streak all derive. Turns are numbered once a night; a wave takes as many items as the waves before it
together, so a night has few waves however many items it has, and what waves read and write stays in proportion to them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.functions import times
from signalmill.functions.jsons import parse_briefing
from signalmill.functions.text import strip_nul, thread_key
from signalmill.operators import briefing, clusters, counts, dedupe, models, queue, ranking, rendering, tables, threads
from signalmill.operators.merged import MergedTable
from signalmill.operators.staging import bound_batches
from signalmill.schema import FETCHED, TABLES, add_columns, empty
from signalmill.sources import registry


#: What an item's changes hold, and the states that it does not leave.
CHANGING, FINAL = ("state", "attempts", "processing_at"), ("done", "failed", "duplicate")


@dataclass
class Models:
    """The models, what the host must list (``required``, against ``listed()``), and how a discussion is fetched."""

    triage: Callable[[str], str] = models.offline_triage
    reader: Callable[[str], str] = models.offline_reader
    embedder: Callable[[list[str]], list[list[float]]] = models.offline_embedder
    same: Callable[[str, str], bool] = field(default_factory=clusters.shared_words)
    required: frozenset[str] = frozenset()
    listed: Callable[[], set[str]] | None = None
    thread: Callable[[str], dict] | None = None


@dataclass
class Parameters:
    """``wave``: items claimed and judged together at first; without ``max_seconds`` a later wave has as many as all before
    it, if that is more. ``max_items`` and ``max_seconds`` end judging, checked between waves."""

    wave: int = 10_000
    max_items: int | None = None
    max_seconds: float | None = None
    max_errors: int = queue.MAX_ERRORS
    merge: float = 0.90
    low: float = 0.75
    prompt_findings: int = 120
    source_share: float = 0.4
    lookback_days: int = 30


class PreflightError(RuntimeError):
    """A run that must not start: required models are missing."""


class Aborted(RuntimeError):
    """A run that was given up because the model host stayed silent; ``state`` holds what was judged until then."""

    def __init__(self, message: str, state: State):
        super().__init__(message)
        self.state = state


class State:
    """Versions of the tables under ``root``: ``<table>/v<n>``, items as segments; ``latest`` finds the newest that was
    completed."""

    def __init__(self, spark: SparkSession, root: str, version: int = 0):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    @classmethod
    def latest(cls, spark: SparkSession, root: str) -> State:
        """The newest complete version, 0 where there is none: the pointer is a folder's name, written last."""
        path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/complete")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return cls(spark, root, max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0))

    def completed(self, version: int) -> State:
        """Move the pointer to a version whose tables are written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/complete/v{version}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return State(self.spark, self.root, version)

    def items(self) -> MergedTable:
        """The items of this version."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return MergedTable(self.spark, f"{self.root}/items", TABLES["items"], mutable=CHANGING, clears=("raw_text",), buckets=buckets).at(self.version)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        v = self.version if version is None else version
        if table == "items":
            return State(self.spark, self.root, v).items().read()
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}/v{v}") if v else empty(self.spark, table)

    def write(self, table: str, df: DataFrame, version: int) -> DataFrame:
        if table == "items":
            return State(self.spark, self.root).items().insert(add_columns(df, table)).save(version).read()
        add_columns(df, table).write.mode("overwrite").parquet(f"{self.root}/{table}/v{version}")
        return self.read(table, version)

    def staged(self, name: str, df: DataFrame) -> DataFrame:
        """A table of the run itself, written and read back."""
        bound_batches(self.spark)
        path = f"{self.root}/stages/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def preflight(m: Models) -> None:
    """Nothing is fetched unless the host lists every required model."""
    missing = models.missing_models(set(m.required), m.listed() if m.listed else set()) if m.required else []
    if missing:
        raise PreflightError("models not listed: " + ", ".join(missing))


def fetch(state: State, v: int, now: str, p: Parameters, reader_of: Callable = registry.reader_of) -> tuple[DataFrame, list[str], list[tuple[str, str]]]:
    """(fetched items, names of the sources read, (source, error) of the others), every enabled source by itself.

    A source's window begins at its watermark, or ``lookback_days`` before now.
    """
    spark = state.spark
    since = F.unix_timestamp(times.lower_bound(F.col("last_successful_fetch_at"), F.lit(now).cast("timestamp"), p.lookback_days))
    got, read, errors = spark.createDataFrame([], FETCHED), [], []
    # The registry is configuration: a row a source.
    for row in registry.enabled(state.read("sources")).withColumn("_since", since).collect():
        source = row.asDict()
        try:
            found = reader_of(source)(spark, source, int(source.pop("_since")), None)
            got = got.unionByName(state.staged(f"fetched/v{v}/{source['name']}", add_fetched(found)))
            read.append(source["name"])
        except Exception as error:  # noqa: BLE001  a bad source must cost only itself
            errors.append((source["name"], f"{type(error).__name__}: {str(error).splitlines()[0][:300] if str(error) else ''}"))
    return got, read, errors


def add_fetched(found: DataFrame) -> DataFrame:
    """A reader's items with exactly the columns that are kept."""
    want = found.sparkSession.createDataFrame([], FETCHED).schema
    return found.select(*[F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want])


def ingest(state: State, v: int, fetched: DataFrame, now) -> tuple[MergedTable, DataFrame]:
    """(items with the new ones, the new ones): unknown (source, source_id) only, and what structure decides of all that are
    just fetched."""
    table = state.items()
    items = table.read()
    fresh = tables.insert_ignore(items, fetched.withColumns({"state": F.lit("fetched"), "attempts": F.lit(0), "fetched_at": now, "processing_at": F.lit(None).cast("timestamp")}), ["source", "source_id"], [F.col("created_at_i"), F.col("url")])
    fresh = state.staged(f"ingested/v{v}", tables.with_ids(items, fresh, [F.col("source"), F.col("source_id")]).select(*items.columns))
    table = table.insert(fresh)
    items = table.read()
    decided = dedupe.decide(items).select("id", F.col("state").alias("_state"))
    open_ = items.where("state = 'fetched'").select("id", "attempts", "processing_at").join(decided, "id")
    return table.change(open_.withColumnRenamed("_state", "state")), fresh


def wave(items: DataFrame, turns: DataFrame, found: DataFrame, m: Models, now, size: int) -> tuple[DataFrame, DataFrame]:
    """(retired items, claimed items ready to be judged): turns, what their threads hold in this run, and the prompt."""
    retired, claimed = queue.changes_of_claim(items, size, now, turns=turns)
    claimed = claimed.withColumn("thread_key", thread_key(F.col("thread_id"), F.col("id")))
    taken = found.groupBy("thread_key").agg(F.count(F.lit(1)).alias("_taken"))
    claimed = claimed.join(taken, "thread_key", "left").withColumn("before", F.coalesce("_taken", F.lit(0))).drop("_taken")
    if m.thread is None:
        claimed = claimed.withColumn("context", F.lit(None).cast("string"))
    else:
        of = F.coalesce(F.nullif("thread_id", F.lit("")), "source_id")
        claimed = threads.attach(claimed, threads.live_contexts(claimed.where("source = 'hackernews'").select(of.alias("thread")), m.thread))
    return retired, claimed.withColumn("prompt", rendering.deep_read_input(F.col("raw_text"), F.col("context"), F.col("metadata")))


def judge(state: State, v: int, table: MergedTable, m: Models, p: Parameters, now, clock: Callable[[], float]) -> tuple[MergedTable, DataFrame, DataFrame, bool]:
    """(items, new findings with their order, log, aborted): waves until the queue is empty, a budget is used up, or the
    host was silent ``max_errors`` times in a row.

    A wave reads the open items and writes changes of those it claimed or retired. Findings and log are a folder each with
    a partition a wave, so they are one scan however many waves there were. Nothing becomes claimable during a night that was
    not when it began, so the turns numbered then hold for all waves; an item that is ready again keeps its turn.
    """
    spark, began, n, streak, aborted = state.spark, clock(), 0, 0, False
    names = [f.name for f in spark.createDataFrame([], TABLES["findings"]).schema if f.name not in ("id", "embedding", "cluster_id", "created_at", "item_id")]
    shape = "turn struct<cycle:bigint,source:string,rn:bigint>, pos int, thread_key string, item_id long, " + ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in names)
    # A new folder for each attempt at a night: waves of one that died are not met.
    folder = f"{state.root}/stages/waves/v{v}-{uuid.uuid4().hex}"

    def written(name: str, columns: str, df: DataFrame | None = None) -> DataFrame:
        if df is not None:
            df.write.parquet(f"{folder}/{name}/wave={n}")
        return spark.read.schema(f"{columns}, wave int").option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}") if n else spark.createDataFrame([], f"{columns}, wave int")

    found, log = written("found", shape), written("log", models.OUTCOME)
    turns = state.staged(f"turns/v{v}", queue.numbered_turns(table.read(open_only=True), now))
    left, claimed = p.max_items, 0
    while not aborted and (left is None or left > 0) and (p.max_seconds is None or clock() - began < p.max_seconds):
        size = p.wave if p.max_seconds is not None else max(p.wave, claimed)
        size = size if left is None else min(size, left)
        retired, ready = wave(table.read(open_only=True), turns, found, m, now, size)
        ready = state.staged(f"claimed/v{v}/{n + 1}", ready)
        if ready.isEmpty():
            break
        n, claimed = n + 1, claimed + size
        log = written("log", models.OUTCOME, models.judge_in_turn(ready, m.triage, m.reader, queue.PER_THREAD, p.max_errors))
        outcome = log.where(F.col("wave") == n).drop("wave")
        good = outcome.where("outcome = 'judged'").join(ready.select("id", "thread_key", "turn"), "id").select("id", "thread_key", "turn", F.posexplode("findings").alias("pos", "f"))
        clean = [strip_nul(F.col(f"f.{c}")).alias(c) if c != "confidence" else F.col("f.confidence") for c in names]
        found = written("found", shape, good.select("turn", "pos", "thread_key", F.col("id").alias("item_id"), *clean))
        ids = lambda *o: outcome.where(F.col("outcome").isin(*o)).select("id")
        after = ready.select("id", "raw_text", *CHANGING)
        after = queue.mark(queue.mark(queue.mark(after, ids("judged", "capped"), "done"), ids("failed"), "failed"), ids("skipped"), "ready")
        after = queue.after_model_error(after, ids("error"))
        table = table.change(after.unionByName(retired.select(*after.columns)).withColumn("clear", F.col("state") == "done"))
        streak, aborted = error_state(outcome.join(ready.select("id", "turn"), "id"), streak, p.max_errors)
        if left is not None:
            left -= outcome.where("outcome in ('judged', 'failed')").count()
    return table, found, log, aborted


def error_state(outcome: DataFrame, carried: int, limit: int) -> tuple[int, bool]:
    """(errors in a row at the end of a wave, whether the run is to be given up), in turn order and with those carried
    from the wave before. Retired items neither count nor end a row; a skipped one says that a task gave up."""
    events = outcome.select("turn", F.when(F.col("outcome") == "error", "error").when(F.col("outcome").isin("judged", "failed"), "success").otherwise("other").alias("outcome"))
    before = outcome.sparkSession.range(carried).select(F.struct(F.lit(-1).cast("long").alias("cycle"), F.lit("").alias("source"), F.col("id").alias("rn")).alias("turn"), F.lit("error").alias("outcome"))
    every = events.unionByName(before).withColumn("_all", F.lit(0))
    order = [F.col("turn.cycle"), F.col("turn.source"), F.col("turn.rn")]
    islands = tables.running_sum(every, ["_all"], order, (F.col("outcome") == "success").cast("long"), "island", parts=8)
    runs = islands.where("outcome = 'error'").groupBy("island").agg(F.count(F.lit(1)).alias("errors"))
    last = events.where("outcome = 'success'").count()
    got = runs.agg(F.max("errors").alias("most"), F.max(F.when(F.col("island") == last, F.col("errors"))).alias("tail")).first()
    given_up = not outcome.where("outcome = 'skipped'").isEmpty()
    return got["tail"] or 0, given_up or (got["most"] or 0) >= limit


def run(
    state: State, fetched: DataFrame | None, now: str, m: Models | None = None, p: Parameters | None = None, synthesis: Callable[[str], str] | None = None,
    digests: str | None = None, reader_of: Callable = registry.reader_of, clock: Callable[[], float] = time.monotonic,
) -> State:
    """One night; returns the state with the next version.

    ``fetched`` None reads the state's enabled sources, each by itself, and moves the watermarks of those read to the
    night's start once judging went through. Embedding, clustering, ranking and the digest may fail without losing the
    night: their errors go to the run's row, and the next night takes up what they left. With ``digests`` the digest is
    written there. A silent model host ends the run with ``Aborted`` after what was judged is stored.
    """
    m, p, spark, v, began = m or Models(), p or Parameters(), state.spark, state.version + 1, clock()
    at = F.lit(now).cast("timestamp")
    preflight(m)
    read, errors = [], []
    if fetched is None:
        fetched, read, errors = fetch(state, v, now, p, reader_of)
    table, inserted = ingest(state, v, fetched, at)
    table, found, log, aborted = judge(state, v, table, m, p, at, clock)
    table = table.compact(F.col("state").isin(*FINAL)).save(v)
    items = table.read()
    state.staged(f"log/v{v}", log)
    old = state.read("findings")
    bare = found.withColumns({"created_at": at, "embedding": F.lit(None).cast("array<float>"), "cluster_id": F.lit(None).cast("long")})
    new = state.staged(f"findings-new/v{v}", tables.with_ids(old, bare, [F.col(c) for c in ("wave", "turn.cycle", "turn.source", "turn.rn", "pos")]).select(*old.columns))
    findings = state.staged(f"findings/v{v}", old.unionByName(new))
    sources, known = state.read("sources"), state.read("clusters")
    made = {"findings": findings, "clusters": known, "mentions": state.read("mentions")}
    if aborted:
        errors.append(("judge", "the model host stayed silent"))
    else:
        started = spark.createDataFrame([(name,) for name in read], "name string").withColumn("started_at", at)
        sources = tables.advance_watermarks(sources, started)
        made, failed = grown(state, v, made, items, m, p, at)
        errors += failed
    state.write("sources", sources, v)
    for table, df in made.items():
        state.write(table, df, v)
    after = State(spark, state.root, v)
    if synthesis is not None and not aborted:
        try:
            text = digest(after, at, p, synthesis)
            if digests is not None:
                rendering.save_text(text, digests, f"{now[:10]}.md")
        except Exception as error:  # noqa: BLE001  a digest must not lose an otherwise good night
            errors.append(("synthesis", f"{type(error).__name__}: {error}"))
    end = F.timestamp_seconds(F.unix_timestamp(at) + int(clock() - began))
    problems = spark.createDataFrame(errors, "source string, error string")
    state.write("runs", state.read("runs").unionByName(tables.run_row(v, at, None if aborted else end, inserted, new, problems)), v)
    state.completed(v)
    if aborted:
        raise Aborted("the model host stayed silent", after)
    return after


def grown(state: State, v: int, made: dict[str, DataFrame], items: DataFrame, m: Models, p: Parameters, at) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Findings, clusters and mentions after embedding, clustering and ranking, and the stages that failed.

    Each stage takes whatever lacks it, from earlier nights too; a stage that fails leaves its tables as they were.
    """
    errors: list[tuple[str, str]] = []

    def attempt(name: str, stage: Callable[[], dict[str, DataFrame]]) -> None:
        try:
            made.update(stage())
        except Exception as error:  # noqa: BLE001  see above
            errors.append((name, f"{type(error).__name__}: {str(error).splitlines()[0][:300] if str(error) else ''}"))

    def embedded():
        return {"findings": state.staged(f"findings-embedded/v{v}", models.embed(made["findings"], m.embedder))}

    def clustered():
        findings, known, stored = made["findings"], made["clusters"], made["mentions"]
        open_ = clusters.unclustered(findings)
        folded = state.staged(f"folded/v{v}", clusters.greedy(open_, known, p.merge, p.low, m.same))
        founded = tables.with_ids(known, clusters.new_clusters(folded, findings, at), [-F.col("cluster_key")])
        key = founded.select("cluster_key", F.col("id").alias("_new"))
        named = state.staged(f"named/v{v}", folded.join(key, "cluster_key", "left").select("id", F.coalesce("_new", "cluster_key").alias("_cluster")))
        findings = findings.join(named, "id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "_cluster")).select(*findings.columns)
        findings = state.staged(f"findings-clustered/v{v}", findings)
        seen = clusters.with_source(findings.join(named.select("id"), "id", "left_semi"), items).select("id", "cluster_id", "source", F.to_date(at).alias("seen_on"))
        fresh = clusters.new_mentions(seen, stored, ["id"]).where("is_new").select("cluster_id", "source", "seen_on")
        fresh = state.staged(f"mentions-new/v{v}", tables.with_ids(stored, fresh, [F.col("cluster_id"), F.col("source")]).select(*stored.columns))
        every = known.unionByName(founded.drop("cluster_key"), allowMissingColumns=True).withColumns({"muted": F.coalesce("muted", F.lit(False)), "pinned": F.coalesce("pinned", F.lit(False))})
        counted = state.staged(f"clusters/v{v}", clusters.record_mentions(every, fresh, at))
        return {"findings": findings, "mentions": stored.unionByName(fresh), "clusters": counted}

    attempt("embed", embedded)
    attempt("cluster", clustered)
    attempt("rank", lambda: {"clusters": state.staged(f"ranked/v{v}", ranking.score_clusters(made["clusters"], at))})
    return made, errors


def digest(state: State, now, p: Parameters, synthesis: Callable[[str], str]) -> str:
    """The night's digest as Markdown: capped prompt, one model call, one item a story, caps, links."""
    gathered = briefing.gather(state.read("findings"), state.read("items"), state.read("clusters"), briefing.since(None, now))
    chosen = briefing.select_for_prompt(gathered, p.prompt_findings, p.source_share)
    tonight = briefing.block(chosen.select("id", briefing.finding_line().alias("line")), "line", "id", "").first()["text"]
    recurring = briefing.block(ranking.shortlist(state.read("clusters")).select("rank", ranking.shortlist_line().alias("line")), "line", "rank", "").first()["text"]
    raw = models.synthesize(state.spark.range(1).select(briefing.synthesis_input(F.lit(tonight), F.lit(recurring))).first()[0], synthesis)
    parsed = state.spark.createDataFrame([(raw,)], "raw string").select(parse_briefing("raw").alias("b")).select("b.*")
    flat = briefing.flatten(parsed)
    index = gathered.select("id", "url", "publication", "cluster_id")
    linked = briefing.with_links(flat, index, ["section", "pos"])
    kept = briefing.apply_caps(briefing.one_per_story(linked.withColumn("urls", F.col("links"))))
    items = briefing.numbered(kept)
    summary = parsed.first()["night_summary"]
    return rendering.digest_markdown(items, F.to_date(now), F.lit(summary)).first()["markdown"]


def status(state: State, sources: DataFrame, now) -> dict[str, DataFrame]:
    """What operators look at: states, sources, kinds, the last run."""
    items, findings = state.read("items"), state.read("findings")
    return {"states": counts.by_state(items), "sources": counts.by_source(sources, items), "kinds": counts.by_kind(findings), "last_run": counts.last_run(state.read("runs"), now)}


def offline_synthesis(prompt: str) -> str:
    """A briefing that files each finding of the prompt by its kind."""
    import re

    section = {"pain": "gaps", "build": "someone_built", "signal": "shipped", "research": "papers", "read": "worth_reading"}
    out: dict = {"night_summary": "Offline briefing."}
    for m in re.finditer(r"^\[(\d+)\] (\w+): (.*?)(?: \| .*)?$", prompt, re.M):
        out.setdefault(section.get(m[2], "patterns"), []).append({"headline": m[3][:80], "body": "", "finding_ids": [int(m[1])]})
    return json.dumps(out)
