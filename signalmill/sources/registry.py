"""The source registry: which reader a source takes, the seeded sources, and configuration from the environment."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-z0-9_]+")
_READERS: dict[str, Callable] = {}


def reader(name: str) -> Callable[[Callable], Callable]:
    """Register a reader under a name: ``reader(spark, source, since, until)`` gives fetched items."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"bad reader name {name!r}")

    def add(f: Callable) -> Callable:
        _READERS[name] = f
        return f

    return add


def reader_of(source: Mapping) -> Callable:
    """The reader of a source row: its configuration's adapter_impl, else its adapter column."""
    config = source.get("config_json") or {}
    config = json.loads(config) if isinstance(config, str) else config
    name = config.get("adapter_impl") or source.get("adapter") or ""
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise ValueError(f"bad adapter name {name!r}")
    from signalmill.sources import apis, feeds, vault  # noqa: F401  they register themselves

    if name not in _READERS:
        raise ValueError(f"no adapter {name!r}")
    return _READERS[name]


# The seeded sources. JSON APIs first, then feeds, then the mail vault.
_HN_TEXTS = ("I built", "frustrated with", "wish there was", "workaround", "manually", "there's no good")
_ARXIV = "https://export.arxiv.org/api/query?search_query=cat:{}&sortBy=submittedDate&sortOrder=descending&max_results={}"
_FEED = {"adapter_impl": "atom", "id_field": "id", "url_field": "link", "clean_html": True, "text_fields": ["title", "summary"], "overlap_hours": 6, "timeout_seconds": 20}
_ARRAY = {"adapter_impl": "json_api", "hits_path": "", "hits_per_page_param": "", "page_param": "", "timestamp_is_iso": True, "timeout_seconds": 20}
_HUB = {**_ARRAY, "base_url": "https://huggingface.co/api", "date_sorted": True, "params": {"sort": "createdAt", "direction": "-1", "limit": 50}, "id_field": "id", "timestamp_field": "createdAt", "metadata_fields": ["likes", "downloads"]}
SEEDS = [
    ("hackernews", "json_api", "created_at_i", True, {
        "adapter_impl": "hackernews", "base_url": "https://hn.algolia.com/api/v1", "endpoint": "search_by_date",
        "searches": [{"tags": "ask_hn"}, {"tags": "show_hn"}, {"tags": "story", "min_points": 300}, *({"tags": "comment", "query": q} for q in _HN_TEXTS)],
        "hits_per_page": 100, "overlap_hours": 6, "clean_html": True, "id_field": "objectID", "timestamp_field": "created_at_i", "thread_id_field": "story_id",
        "metadata_fields": ["points", "num_comments"], "text_fields": ["comment_text", "story_text", "title"], "url_template": "https://news.ycombinator.com/item?id={objectID}", "timeout_seconds": 20}),
    ("github", "json_api", "updated_at", True, {
        "adapter_impl": "github", "base_url": "https://api.github.com", "endpoint": "search/issues",
        "queries": [
            'org:huggingface org:pytorch org:vllm-project org:ggml-org org:ray-project is:issue is:open label:"feature request" comments:>3',
            'org:langchain-ai org:run-llama org:pydantic org:BerriAI org:sgl-project is:issue is:open label:"feature request" comments:>3',
            "org:huggingface org:vllm-project org:pytorch org:langchain-ai org:ggml-org label:wontfix"],
        "hits_per_page": 100, "hits_per_page_param": "per_page", "page_param": "page", "overlap_hours": 0, "throttle_seconds": 2, "timeout_seconds": 20}),
    ("lobsters", "json_api", "created_at", True, {**_ARRAY, "base_url": "https://lobste.rs", "endpoint": "newest.json", "date_sorted": True, "id_field": "short_id", "timestamp_field": "created_at",
        "text_fields": ["description_plain", "description", "title"], "url_template": "{comments_url}", "clean_html": True}),
    ("stackoverflow", "json_api", "creation_date", False, {
        "adapter_impl": "json_api", "base_url": "https://api.stackexchange.com/2.3", "endpoint": "questions", "params": {"site": "stackoverflow", "order": "desc", "sort": "creation", "filter": "withbody"},
        "hits_path": "items", "more_path": "has_more", "date_sorted": True, "page_start": 1, "hits_per_page": 100, "hits_per_page_param": "pagesize", "page_param": "page", "id_field": "question_id",
        "timestamp_field": "creation_date", "text_fields": ["body"], "url_template": "{link}", "clean_html": True, "max_pages": 3, "timeout_seconds": 20}),
    ("arxiv", "rss", "published", True, {**_FEED, "feed_urls": [_ARXIV.format(c, 50) for c in ("cs.LG", "cs.CL", "cs.AI")], "metadata_fields": ["authors", "categories"]}),
    ("producthunt", "rss", "published", True, {**_FEED, "feed_url": "https://www.producthunt.com/feed"}),
    ("hf_papers", "json_api", "publishedAt", True, {**_ARRAY, "base_url": "https://huggingface.co/api", "endpoint": "daily_papers", "params": {"limit": 50}, "date_sorted": False, "id_field": "title",
        "timestamp_field": "publishedAt", "text_fields": ["summary", "title"], "url_template": "https://huggingface.co/papers/{paper[id]}"}),
    ("hf_datasets", "json_api", "createdAt", True, {**_HUB, "endpoint": "datasets", "text_fields": ["description", "id"], "url_template": "https://huggingface.co/datasets/{id}"}),
    ("hf_models", "json_api", "createdAt", False, {**_HUB, "endpoint": "models", "text_fields": ["id"], "url_template": "https://huggingface.co/{id}"}),
    ("yc_launches", "json_api", "created_at", True, {
        "adapter_impl": "json_api", "base_url": "https://www.ycombinator.com", "endpoint": "launches", "hits_path": "hits", "pages_path": "nbPages", "date_sorted": True, "hits_per_page": 50,
        "hits_per_page_param": "hitsPerPage", "page_param": "page", "id_field": "id", "timestamp_field": "created_at", "timestamp_is_iso": True, "text_fields": ["tagline", "title"],
        "url_template": "{search_path}", "timeout_seconds": 20}),
    ("newsletters", "bulk", "date", True, {"adapter_impl": "newsletters", "vault_dir_env": "VAULT_NEWSLETTERS_DIR", "exclude_senders": [], "lookback_days": 2, "chunk_max_chars": 4000, "chunk_min_chars": 400}),
]
# arXiv's categories after the later migration, with how many papers each is asked for.
ARXIV_LATER = (("cs.LG", 50), ("cs.CL", 50), ("cs.AI", 50), ("cs.DC", 30), ("cs.CR", 30), ("cs.SE", 30), ("cs.CV", 25))
LATER_SEEDS = [
    ("lab_blogs", "rss", "published", True, {**_FEED, "feed_urls": [
        "https://openai.com/news/rss.xml", "https://deepmind.google/blog/rss.xml", "https://engineering.fb.com/feed/", "https://huggingface.co/blog/feed.xml", "https://www.databricks.com/feed",
        "https://pytorch.org/blog/feed.xml", "https://www.together.ai/blog/rss.xml", "https://research.google/blog/rss/"]}),
    ("research_blogs", "rss", "published", True, {**_FEED, "feed_urls": [
        "https://lilianweng.github.io/index.xml", "https://magazine.sebastianraschka.com/feed", "https://huyenchip.com/feed.xml", "https://www.interconnects.ai/feed", "https://simonwillison.net/tags/ai.atom"]}),
    ("systems_blogs", "rss", "published", True, {**_FEED, "feed_urls": ["https://muratbuffalo.blogspot.com/feeds/posts/default", "https://brooker.co.za/blog/rss.xml"]}),
    ("startup_news", "rss", "published", True, {**_FEED, "feed_urls": [
        "https://techcrunch.com/category/artificial-intelligence/feed/", "https://techcrunch.com/category/startups/feed/", "https://news.crunchbase.com/feed/", "https://inc42.com/feed/", "https://www.ycombinator.com/blog/rss"]}),
]


def seed_frame(spark: SparkSession, seeds: list | None = None) -> DataFrame:
    """Seeds as registry rows without watermark."""
    rows = [(n, a, json.dumps(c), f, None, e, None) for n, a, f, e, c in (SEEDS if seeds is None else seeds)]
    from signalmill.schema import TABLES

    return spark.createDataFrame(rows, TABLES["sources"])


def add_missing(sources: DataFrame, seeds: DataFrame) -> DataFrame:
    """The registry with the seeds whose names it lacks."""
    return sources.unionByName(seeds.join(sources.select("name"), "name", "left_anti"))


def set_config(sources: DataFrame, name: str, key: str, value) -> DataFrame:
    """The registry with one configuration key of one source replaced."""
    rest = F.map_filter(F.from_json("config_json", "map<string,variant>"), lambda k, _: k != key)
    new = F.to_json(F.map_concat(rest, F.create_map(F.lit(key), F.parse_json(F.lit(json.dumps(value))))))
    return sources.withColumn("config_json", F.when(F.col("name") == name, new).otherwise(F.col("config_json")))


def widened(sources: DataFrame) -> DataFrame:
    """The registry after the later migration: arXiv in seven categories and the later seeds; running it again changes
    nothing. A paper that several categories list is one item, as items are told apart by source and id."""
    arxiv = set_config(sources, "arxiv", "feed_urls", [_ARXIV.format(*c) for c in ARXIV_LATER])
    return add_missing(arxiv, seed_frame(sources.sparkSession, LATER_SEEDS))


def enabled(sources: DataFrame) -> DataFrame:
    return sources.where("enabled").orderBy("name")


def settings(environment: Mapping[str, str] | None = None, required: tuple[str, ...] = (), defaults: Mapping[str, object] | None = None, file: str | None = None) -> dict:
    """Settings from a KEY=value file and the environment, which wins; blank counts as missing; all missing keys are named."""
    found: dict[str, str] = {}
    if file and os.path.exists(file):
        with open(file, encoding="utf-8") as lines:
            for line in lines:
                key, eq, value = line.strip().partition("=")
                if eq and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("'\"")
    found.update({k: v for k, v in (os.environ if environment is None else environment).items() if v.strip()})
    missing = [k for k in required if not found.get(k, "").strip()]
    if missing:
        raise ValueError("missing settings: " + ", ".join(missing))
    out: dict = {k: found[k] for k in required}
    for key, default in (defaults or {}).items():
        out[key] = type(default)(found[key]) if found.get(key, "").strip() else default
    return out
