"""Discussion context: breadth-first comments of a thread, capped and cut."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.text import clean_html_builtin
from signalmill.operators.staging import staged

# Comments of a thread and characters of its context.
MAX_COMMENTS, MAX_CHARS = 40, 6000
CUT_MARK = "\n…[thread truncated]"


def walk(nodes: DataFrame, hops: int = 2) -> DataFrame:
    """Comments with depth and bfs_path, breadth first: (thread, node, parent, ord, author, text), parent null at the top.

    Every comment holds an ancestor and the path below it. A round takes the ancestor's own ancestor and puts its path in
    front, so what is known doubles; ``hops`` doublings are one written table, and a chain of n comments takes log n of
    them. When a doubling completes no path, what is left leads round in a circle (a path that is longer by one would
    have been completed before). Nodes in or below a circle, or below a node that is not there, are left out. Texts are not
    moved until the paths are known.
    """
    links = staged(nodes.select("thread", "node", F.col("parent").alias("above"), F.array("ord").alias("bfs_path")), "threads")
    complete = -1
    while True:
        told = links.agg(F.count(F.when(F.col("above").isNull(), 1)).alias("complete"), F.count("above").alias("left")).first()
        if not told["left"] or told["complete"] == complete:
            break
        complete = told["complete"]
        for _ in range(hops):
            links = _doubled(links)
        links = staged(links, "threads")
    tops = nodes.where("parent is null").withColumns({"depth": F.lit(0), "bfs_path": F.array("ord")})
    paths = links.where("above is null and size(bfs_path) > 1").select("thread", "node", (F.size("bfs_path") - 1).alias("depth"), "bfs_path")
    return tops.unionByName(nodes.where("parent is not null").join(paths, ["thread", "node"]).select(*tops.columns))


def _doubled(links: DataFrame) -> DataFrame:
    """(thread, node, above, bfs_path) with the ancestor of each ancestor; those at the top stay."""
    known = links.select("thread", F.col("node").alias("above"), F.col("above").alias("_above"), F.col("bfs_path").alias("_path"))
    further = links.where("above is not null").join(known, ["thread", "above"])
    return links.where("above is null").unionByName(further.select("thread", "node", F.col("_above").alias("above"), F.concat("_path", "bfs_path").alias("bfs_path")))


def fetch_nodes(stories: DataFrame, get: Callable[[str], dict]) -> DataFrame:
    """The discussion trees of ``stories`` (thread) as nodes (thread, node, parent, ord, author, text); the story itself is
    the node without parent and ord -1, its title in ``author``. A story whose fetch fails in any way has no nodes."""

    def run(batches):
        for batch in batches:
            rows = []
            for thread in batch["thread"]:
                try:
                    tree = get(thread)
                    rows += flat_tree(thread, tree)
                except Exception:  # noqa: BLE001  what goes wrong with one story must not cost the others
                    continue
            yield pd.DataFrame(rows, columns=["thread", "node", "parent", "ord", "author", "text"])

    return stories.select("thread").distinct().mapInPandas(run, "thread string, node long, parent long, ord long, author string, text string")


def flat_tree(thread: str, tree: dict) -> list[tuple]:
    """A nested discussion (title, text, author, children) as node rows, numbered as met; the story is node 0."""
    rows = [(thread, 0, None, -1, tree.get("title"), tree.get("text"))]
    todo = [(child, None, k) for k, child in enumerate(tree.get("children") or [])]
    for child, parent, k in todo:
        if isinstance(child, dict):
            number = len(rows)
            rows.append((thread, number, parent, k, child.get("author"), child.get("text")))
            todo += [(grandchild, number, j) for j, grandchild in enumerate(child.get("children") or [])]
    return rows


def live_contexts(stories: DataFrame, get: Callable[[str], dict]) -> DataFrame:
    """(thread, context) of stories (thread) whose discussions are fetched."""
    nodes = staged(fetch_nodes(stories, get), "threads")
    plain = nodes.where("ord >= 0").withColumn("text", clean_html_builtin(F.col("text")))
    heads = nodes.where("ord = -1").select("thread", F.col("author").alias("title"), clean_html_builtin(F.col("text")).alias("text"))
    return contexts(heads, walk(plain))


def contexts(stories: DataFrame, comments: DataFrame, max_comments: int = MAX_COMMENTS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(thread, context): title and text of the story, then its first comments in (depth, bfs_path) order.

    Blank comments take no place; a context over ``max_chars`` is cut and marked; a thread with nothing has none.
    """
    full = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    said = comments.withColumn("_t", full("text")).where("_t is not null")
    n = F.row_number().over(Window.partitionBy("thread").orderBy("depth", "bfs_path", "node"))
    said = said.withColumn("_n", n).where(F.col("_n") <= max_comments)
    line = F.concat(F.lit("- "), F.coalesce(full("author"), F.lit("someone")), F.lit(": "), F.col("_t"))
    joined = said.groupBy("thread").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("l")))), lambda x: x["l"]).alias("_lines"))
    all_ = stories.join(joined, "thread", "full_outer")
    parts = F.concat_ws("\n\n", F.concat(F.lit("Story: "), full("title")), full("text"), F.when(F.size("_lines") > 0, F.lit("Comments:")), F.array_join("_lines", "\n\n"))
    cut = F.concat(F.regexp_replace(F.left("context", F.lit(max_chars)), r"\s+$", ""), F.lit(CUT_MARK))
    return all_.select("thread", parts.alias("context")).where("context != ''").select("thread", F.when(F.length("context") > max_chars, cut).otherwise(F.col("context")).alias("context"))


def attach(items: DataFrame, thread_contexts: DataFrame, source: str = "hackernews") -> DataFrame:
    """Items of ``source`` with their thread's context, by thread_id, else by their own source_id."""
    key = F.when(F.col("source") == source, F.coalesce(F.nullif("thread_id", F.lit("")), "source_id"))
    return items.withColumn("_k", key).join(thread_contexts.withColumnRenamed("thread", "_k"), "_k", "left").drop("_k")


def quotes_found(findings: DataFrame, items: DataFrame) -> DataFrame:
    """Findings with verbatim: the quote, its case and white space aside, stands in the item's text."""
    from signalmill.functions.text import collapsed

    text = items.select(F.col("id").alias("item_id"), F.col("raw_text").alias("_text"))
    norm = lambda c: collapsed(F.lower(F.coalesce(c, F.lit(""))))
    return findings.join(text, "item_id", "left").withColumn("verbatim", F.contains(norm("_text"), norm("evidence_quote"))).drop("_text")
