"""Text that people read: cards, the digest, the findings report, prompt parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.jsons import SECTIONS
from signalmill.functions.times import long_date
from signalmill.operators.briefing import section_rank
from signalmill.operators.tables import rank_in_order

# Marks of the kinds and titles of the sections.
KIND_MARKS = {"pain": "🔴", "build": "🛠️", "signal": "📡", "research": "🔬", "read": "📄", "pattern": "🧩", "open_problem": "🧭"}
SECTION_TITLES = dict(zip(SECTIONS, ("Patterns", "Papers", "Worth reading", "Shipped", "Market & funding", "Gaps", "Someone built")))
CAPTION, REPLY = 1000, 4000


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def kind_mark(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(KIND_MARKS), kind), F.lit("•"))


def known_kind(kind: Column) -> Column:
    return kind.isin(*KIND_MARKS)


def section_title(section: Column) -> Column:
    return F.try_element_at(_map(SECTION_TITLES), section)


def card() -> Column:
    """A leaderboard row (kind, statement, why, quote, mention_count, n_sources, new_this_week, id) as text."""
    s = lambda c: F.col(c).cast("string")
    why = F.concat(F.lit("   "), F.nullif(F.col("why"), F.lit("")))
    quote = F.concat(F.lit('   "'), F.nullif(F.col("quote"), F.lit("")), F.lit('"'))
    counts = F.concat(F.lit("   "), s("mention_count"), F.lit(" mentions · "), s("n_sources"), F.lit(" sources · "), s("new_this_week"), F.lit(" new this week  ·  #"), s("id"))
    return F.concat_ws("\n", F.concat_ws(" ", kind_mark(F.col("kind")), F.col("statement")), why, quote, counts)


def caption(text: Column, n: int = CAPTION) -> Column:
    return F.left(text, F.lit(n))


def why_text(clusters: DataFrame, findings: DataFrame, items: DataFrame, cluster_id: int, most: int = 20, n: int = REPLY) -> DataFrame:
    """One row: what stands behind a cluster, its ``most`` most confident quotes with their links, cut to a reply's length."""
    from signalmill.operators.ranking import top_findings

    url = items.select(F.col("id").alias("item_id"), "url")
    best = top_findings(findings.where(F.col("cluster_id") == cluster_id), most).join(url, "item_id", "left")
    quote = F.concat(F.lit('• "'), F.coalesce(F.nullif("evidence_quote", F.lit("")), F.lit("(no quote)")), F.lit('"'), F.coalesce(F.concat(F.lit("\n  "), F.nullif("url", F.lit(""))), F.lit("")))
    lines = best.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", quote.alias("q")))), lambda x: x["q"]), "\n").alias("_quotes"))
    one = clusters.where(F.col("id") == cluster_id).join(lines, F.col("id") == F.col("cluster_id"), "left")
    head = F.concat(F.lit("*#"), F.col("id").cast("string"), F.lit(" — "), F.col("canonical_statement"), F.lit("*"))
    sub = F.concat(F.lit("_"), F.col("kind"), F.lit(" · score "), F.format_string("%.1f", F.coalesce("score", F.lit(0.0))), F.lit(" · "), F.coalesce("mention_count", F.lit(0)).cast("string"), F.lit(" mentions_"))
    said = one.agg(F.first(F.concat_ws("\n", head, sub, F.lit(""), "_quotes")).alias("text"))
    return said.select(F.left(F.coalesce("text", F.lit(f"No cluster #{cluster_id}.")), F.lit(n)).alias("text"))


def item_markdown() -> Column:
    """A numbered briefing item with links and via."""
    topic = F.nullif(F.trim(F.coalesce("topic", F.lit(""))), F.lit(""))
    head = F.concat(F.lit("### "), F.col("n").cast("string"), F.lit(". "), F.coalesce(F.concat(F.lit("["), topic, F.lit("] ")), F.lit("")), F.col("headline"))
    links = F.transform("links", lambda u: F.concat(F.lit("[source]("), u, F.lit(")")))
    via = F.when(F.size("via") > 0, F.array(F.concat(F.lit("via "), F.array_join("via", ", ")))).otherwise(F.array().cast("array<string>"))
    refs = F.nullif(F.array_join(F.concat(links, via), " · "), F.lit(""))
    return F.concat_ws("\n", head, F.nullif(F.trim(F.coalesce("body", F.lit(""))), F.lit("")), F.concat(F.lit("\n"), refs))


def digest_markdown(items: DataFrame, day: Column, night_summary: Column) -> DataFrame:
    """One row: the day's digest. Items are numbered, capped (so one task holds a few dozen) and linked."""
    titled = items.select("n", "section", item_markdown().alias("md"), F.row_number().over(Window.partitionBy("section").orderBy("n")).alias("_first"))
    text = titled.select("n", F.concat(F.when(F.col("_first") == 1, F.concat(F.lit("## "), section_title(F.col("section")), F.lit("\n\n"))).otherwise(""), F.col("md")).alias("md"))
    body = text.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "md"))), lambda x: x["md"]), "\n\n").alias("body"))
    summary = F.nullif(F.trim(F.coalesce(night_summary, F.lit(""))), F.lit(""))
    filled = F.nullif(F.col("body"), F.lit(""))
    nothing = F.when(filled.isNull() & summary.isNull(), "Nothing worth surfacing tonight.")
    return body.select(F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), long_date(day)), summary, filled, nothing), F.lit("\n")).alias("markdown"))


def save_text(text: str, folder: str, name: str) -> str:
    """Write one text file of the driver's; returns its path."""
    import os

    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def report_rows(findings: DataFrame, items: DataFrame) -> DataFrame:
    """Findings in report order: kind ("unknown" without one), its size and rank, place in it, url and entry text."""
    url = items.select(F.col("id").alias("item_id"), "url")
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("unknown"))
    named = findings.withColumn("kind", kind)
    sizes = named.groupBy("kind").agg(F.count(F.lit(1)).alias("kind_size"), F.min("id").alias("_first"))
    # One row a kind; findings are ranked in parts, as a kind may hold most of them.
    sizes = sizes.withColumn("kind_rank", F.row_number().over(Window.orderBy(F.desc("kind_size"), "_first"))).drop("_first")
    placed = rank_in_order(named, ["kind"], [-F.coalesce("confidence", F.lit(0.0)), F.col("id")], "place", parts=16)
    rows = placed.join(url, "item_id", "left").withColumn("url", F.coalesce(F.nullif("url", F.lit("")), F.lit("(no url)")))
    return rows.join(sizes, "kind").withColumn("place", F.col("place").cast("int"))


def report_entry() -> Column:
    """A report row as Markdown."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    tail = F.concat_ws(" · ", F.concat(F.lit("[source]("), F.col("url"), F.lit(")")), filled("domain"), F.concat(F.lit("confidence "), F.format_string("%.2f", F.col("confidence"))))
    tail = F.when(F.col("confidence").isNull(), F.concat_ws(" · ", F.concat(F.lit("[source]("), F.col("url"), F.lit(")")), filled("domain"))).otherwise(tail)
    return F.concat_ws("\n\n", F.concat(F.lit("### "), F.col("statement")), F.concat(F.lit("**Why it matters:** "), filled("why_it_matters")), F.concat(F.lit("> "), filled("evidence_quote")), tail)


def report_lines(rows: DataFrame, title: str = "findings") -> DataFrame:
    """The report as ordered lines (kind_rank, place, text): heading, counts by kind, then each kind's entries.

    It stays a table; ``save_report`` writes it sorted, one part after another, without gathering it in one task.
    """
    kinds = rows.select("kind", "kind_size", "kind_rank").distinct()
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("k")).select(F.lit(0).alias("kind_rank"), F.lit(0).alias("place"), F.concat(F.lit(f"# {title}\n\n_"), F.col("n").cast("string"), F.lit(" findings across "), F.col("k").cast("string"), F.lit(" kinds_")).alias("text"))
    counts = kinds.select(F.lit(0).alias("kind_rank"), F.col("kind_rank").alias("place"), F.concat(F.lit("- **"), F.col("kind"), F.lit("** — "), F.col("kind_size").cast("string")).alias("text"))
    titles = kinds.select("kind_rank", F.lit(0).alias("place"), F.concat(F.lit("## "), F.col("kind"), F.lit("  ("), F.col("kind_size").cast("string"), F.lit(")")).alias("text"))
    return head.unionByName(counts).unionByName(titles).unionByName(rows.select("kind_rank", "place", report_entry().alias("text")))


def save_report(lines: DataFrame, folder: str) -> None:
    """The report as text parts in order."""
    lines.orderBy("kind_rank", "place").select("text").write.text(folder)


def engagement_line(metadata: Column, min_points: int = 50, min_comments: int = 30) -> Column:
    """A line on a submission's points and comments, empty where it has none."""
    part = lambda key, word: F.concat(F.get_json_object(metadata, f"$.{key}"), F.lit(word))
    both = F.concat_ws(", ", part("points", " points"), part("num_comments", " comments"))
    line = F.concat(F.lit("[Engagement: "), both, F.lit(f"; {min_points} points or {min_comments} comments are strong.]\n\n"))
    return F.when(both == "", "").otherwise(line)


def context_block(context: Column) -> Column:
    """Thread context in a frame, empty without any."""
    text = F.nullif(F.trim(F.coalesce(context, F.lit(""))), F.lit(""))
    return F.coalesce(F.concat(F.lit("[Discussion around the item, for understanding only:]\n"), text, F.lit("\n\n[The item:]\n")), F.lit(""))


def deep_read_input(text: Column, context: Column, metadata: Column, error: Column | None = None) -> Column:
    """The data part of a deep read: engagement, context, text, and on a retry what was wrong."""
    retry = F.lit("") if error is None else F.coalesce(F.concat(F.lit("\n\n[The last answer was refused: "), error, F.lit("]")), F.lit(""))
    return F.concat(engagement_line(metadata), context_block(context), F.coalesce(text, F.lit("")), retry)


def triage_input(text: Column, max_chars: int = 2000) -> Column:
    return F.substring(text, 1, max_chars)
