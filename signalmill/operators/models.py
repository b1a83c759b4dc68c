"""Model calls behind small interfaces, with deterministic offline stand-ins.

A model is any callable; the operators run it in Arrow batches with the retry contract and never inside a query that is
held against SQL.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.functions.jsons import check_findings
from signalmill.operators.staging import bound_batches

# Attempts, the longest pause, texts in an embedding batch.
ATTEMPTS, LONGEST_PAUSE, EMBED_BATCH = 3, 5, 64


class TransportError(OSError):
    """A model host that did not answer; other errors are not retried."""


def with_retry(call: Callable, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """The call's result; after a transport error again, at most ``attempts`` times, pausing 1, 2, 4, 5, ... seconds."""
    for k in range(1, attempts + 1):
        try:
            return call()
        except (TransportError, ConnectionError, TimeoutError):
            if k == attempts:
                raise
            sleep(min(2 ** (k - 1), LONGEST_PAUSE))


def read_triage(raw: str | None) -> bool:
    """worth_reading of a triage answer: what cannot be read is worth reading, an answer without the key is not."""
    try:
        data = json.loads(raw or "")
    except ValueError:
        return True
    return bool(data.get("worth_reading", False)) if isinstance(data, dict) else True


def read_same(raw: str | None) -> bool:
    """same of a tie-break answer; anything unreadable is a no."""
    try:
        data = json.loads(raw or "")
    except ValueError:
        return False
    return bool(data.get("same", False)) if isinstance(data, dict) else False


def ask_same(model: Callable[[str, str], str]) -> Callable[[str, str], bool]:
    """A tie-breaker around a model; a host that stays silent is a no."""

    def same(a: str, b: str) -> bool:
        try:
            return read_same(with_retry(lambda: model(a, b), sleep=lambda _: None))
        except OSError:
            return False

    return same


def offline_triage(text: str) -> str:
    """Worth reading are texts of at least 12 words."""
    return json.dumps({"worth_reading": len((text or "").split()) >= 12})


def offline_reader(text: str) -> str:
    """One finding from the first sentence; none for texts whose hash is a multiple of five."""
    digest = int(hashlib.sha256((text or "").encode()).hexdigest()[:8], 16)
    first = (text or "").replace("\n", " ").split(". ")[0].strip()[:200]
    if digest % 5 == 0 or not first:
        return "[]"
    kind = ("pain", "build", "signal", "research", "read")[digest % 7 % 5]
    return json.dumps([{"kind": kind, "statement": first, "why_it_matters": "", "domain": "", "evidence_quote": first, "confidence": digest % 101 / 100}])


def offline_embedder(texts: list[str], width: int = 384) -> list[list[float]]:
    """Hashed bags of words, unit length."""
    out = np.zeros((len(texts), width))
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[i, h % width] += 1 if h >> 63 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(n == 0, 1, n)).tolist()


def triage(items: DataFrame, model: Callable[[str], str] = offline_triage, max_chars: int = 2000) -> DataFrame:
    """Items with worth_reading, judged on the text's beginning, as a separate stage before any deep read."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: read_triage(with_retry(lambda: model((t or "")[:max_chars]))))

    bound_batches(items.sparkSession)
    return items.withColumn("worth_reading", F.pandas_udf(run, "boolean")("raw_text"))


def judge_one(text: str, model: Callable[[str], str]) -> tuple[list[dict] | None, str | None, int]:
    """(findings, error, attempts): one retry that tells the model what was refused."""
    error, findings = None, None
    for attempt in (1, 2):
        prompt = text if error is None else f"{text}\n\n[The last answer was refused: {error}]"
        findings, error = check_findings(with_retry(lambda p=prompt: model(p)))
        if error is None:
            return findings, None, attempt
    return None, error, 2


def deep_read(items: DataFrame, model: Callable[[str], str] = offline_reader, text: str = "raw_text") -> DataFrame:
    """Items with findings, error, attempts of the deep read."""
    element = "struct<kind:string,statement:string,why_it_matters:string,domain:string,evidence_quote:string,confidence:double>"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            got = [judge_one(t or "", model) for t in texts]
            yield pd.DataFrame({"findings": [g[0] for g in got], "error": [g[1] for g in got], "attempts": [g[2] for g in got]})

    bound_batches(items.sparkSession)
    read = F.pandas_udf(run, f"findings array<{element}>, error string, attempts int")
    out = items.withColumn("_r", read(text))
    return out.select(*items.columns, "_r.findings", "_r.error", "_r.attempts")


#: What became of a claimed item: judged, failed (refused twice), capped (its thread is full, no call), error (the host did
#: not answer), skipped (not tried, the host had not answered several times in a row).
OUTCOME = "id long, outcome string, triaged_out boolean, deep_read boolean, findings array<struct<kind:string,statement:string,why_it_matters:string,domain:string,evidence_quote:string,confidence:double>>, error string"


def judge_in_turn(claimed: DataFrame, triage_model: Callable[[str], str] = offline_triage, reader: Callable[[str], str] = offline_reader, cap: int = 2, max_errors: int = 3, max_chars: int = 2000) -> DataFrame:
    """The outcome of each claimed item (id, thread_key, turn, before, raw_text, prompt).

    A thread's items are judged in turn in one task: once ``before`` and what its items gave reach ``cap``, the rest are
    retired without a call. An item is triaged on its text's beginning and, if worth it, read by its prompt; findings
    beyond the cap are cut off. A task that meets ``max_errors`` errors in a row leaves the rest of its items alone.
    Materialise the result: every action on it would ask the models again.
    """
    rows = claimed.select("id", "thread_key", "turn", "before", "raw_text", "prompt").repartition("thread_key").sortWithinPartitions("turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, int] = {}
        streak = 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                room = cap - held.get(r.thread_key, int(r.before))
                worth, findings, error = None, [], None
                if room <= 0:
                    outcome = "capped"
                elif streak >= max_errors:
                    outcome = "skipped"
                else:
                    try:
                        text = r.raw_text or ""
                        worth = read_triage(with_retry(lambda t=text: triage_model(t[:max_chars])))
                        findings, error, _ = judge_one(r.prompt or "", reader) if worth else ([], None, 0)
                        outcome, streak = "judged" if error is None else "failed", 0
                    except (TransportError, ConnectionError, TimeoutError) as silent:
                        outcome, error, streak = "error", f"{type(silent).__name__}: {silent}", streak + 1
                findings = (findings or [])[: max(room, 0)]
                held[r.thread_key] = cap - room + len(findings)
                out.append((r.id, outcome, worth is False, bool(worth), findings, error))
            yield pd.DataFrame(out, columns=["id", "outcome", "triaged_out", "deep_read", "findings", "error"])

    bound_batches(claimed.sparkSession)
    return rows.mapInPandas(run, OUTCOME)


def embed(findings: DataFrame, model: Callable[[list[str]], list[list[float]]] = offline_embedder, text: str = "statement", batch: int = EMBED_BATCH) -> DataFrame:
    """Findings with the embedding of their statement where they lack one; texts go to the model in batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.fillna("").tolist()
            got: list = []
            for k in range(0, len(values), batch):
                got += with_retry(lambda k=k: model(values[k : k + batch]))
            yield pd.Series(got)

    bound_batches(findings.sparkSession)
    return findings.withColumn("embedding", F.when(F.col("embedding").isNull(), F.pandas_udf(run, "array<float>")(text)).otherwise(F.col("embedding")))


def synthesize(prompt: str, model: Callable[[str], str]) -> str:
    """The briefing's raw text: one driver-side call, after an error once more with half the prompt."""
    try:
        return with_retry(lambda: model(prompt))
    except OSError:
        return with_retry(lambda: model(prompt[: len(prompt) // 2]))


def missing_models(required: set[str], listed: set[str]) -> list[str]:
    """Required models that the host does not list; a run starts only if there are none."""
    return sorted(required - listed)
