"""Toxicity: a linear-chain conditional random field tags offending tokens; its marginals score the documents.

Tokens are whitespace-separated. Their features are the lower-cased words in them and word prefixes of 3 to 9 letters,
of which those are kept that mark toxic documents in the labelled sample (number of toxic documents,
and log odds of token frequencies). In training, a token with kept features is labelled offending in toxic documents;
every other token is not. The field is one chain over all tokens of a text. Tokens without kept features all have one
emission, so a stretch of k of them is the k-th power of one 2 x 2 matrix, taken by its eigenvalues: forward-backward is
exact over every token and costs a step a token with features and one a stretch. A logistic curve over the largest
marginal and the expected number and share of offending tokens, fitted on documents that the field did not see, is the
document's score.

Scale: the model is fitted on a bounded sample, at most ``sample`` labelled documents (the least by hash of their id in
as many buckets, ids broadcast), of which the driver holds the tokens with features and the lengths of the stretches between
them. The field is trained on whole texts, cut into chains of ``longest`` tokens with features so that its steps stay matrix
operations; the curve is fitted on uncut chains, as scoring sees them. Scoring is one narrow pass over whole texts.

Defined results: null or empty text has no tokens and the score of a text without evidence; texts of any length are one
chain; of equal features the first by name is kept; null labels or ids teach nothing; several labels of an id teach their
mean (1 from 0.5 on); repeated document rows each count and each give a row; without both classes in the sample the score
is the sample's mean label (0 without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality import fold, labelled_sample

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")


def token_features(token: str) -> set[str]:
    """The words of a token as ``w:`` and their prefixes as ``p:`` features."""
    out = set()
    for w in _WORD.findall(token.lower()):
        out.add("w:" + w)
        out.update("p:" + w[:n] for n in range(3, 10) if len(w) > n)
    return out


class _Known(dict):
    """Token to the ids of its kept features; filled on demand, emptied when large."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, token: str) -> tuple[int, ...]:
        got = tuple(sorted(self.ids[f] for f in token_features(token) if f in self.ids))
        if len(self) > 400_000:
            self.clear()
        self[token] = got
        return got


Chain = tuple[list[tuple[int, ...]], list[int]]


def compressed(tokens: list[tuple[int, ...]]) -> Chain:
    """(features of the tokens that have any, numbers of tokens without before, between and after them)."""
    at = [i for i, f in enumerate(tokens) if f]
    ends = [-1, *at, len(tokens)]
    return [tokens[i] for i in at], [b - a - 1 for a, b in zip(ends, ends[1:])]


class Field:
    """Weights: one per feature and a bias for state 1, start and transition scores."""

    def __init__(self, n_features: int):
        self.w = np.zeros(n_features + 1)
        self.t = np.zeros((2, 2))
        self.start = np.zeros(2)

    def theta(self) -> np.ndarray:
        return np.concatenate([self.w, self.t.ravel(), self.start])

    def set(self, theta: np.ndarray) -> None:
        n = len(self.w)
        self.w, self.t, self.start = theta[:n], theta[n : n + 4].reshape(2, 2), theta[n + 4 :]
        self.__dict__.pop("_steps", None)

    def steps(self) -> _Steps:
        """The chain's matrices under the weights."""
        if "_steps" not in self.__dict__:
            self._steps = _Steps(self.w[-1:], self.t[None], self.start[None])
        return self._steps

    def marginals(self, tokens: list[tuple[int, ...]]) -> np.ndarray:
        """P(state 1) of each token of a text."""
        return self.chain(*compressed(tokens))

    def chain(self, seen: list[tuple[int, ...]], gaps: list[int]) -> np.ndarray:
        """P(state 1) of each token of a compressed text."""
        m, s = len(seen), self.steps()
        if m == 0:
            return s.stretch(s.first[0], s.one, gaps[0])
        w, bias = self.w, float(self.w[-1])
        emit = [math.exp(min(60.0, bias + sum(float(w[f]) for f in fs))) for fs in seen]
        across = [s.across(k) for k in gaps[1:m]]
        x, y = s.leading(gaps[0])
        fwd = []
        for i in range(m):
            if i:
                (a, b), (c, d) = across[i - 1]
                x, y = x * a + y * c, x * b + y * d
            y *= emit[i]
            x, y = x / (x + y), y / (x + y)
            fwd.append((x, y))
        back = [(0.0, 0.0)] * m
        u, v = s.trailing(gaps[m])
        for i in range(m - 1, -1, -1):
            back[i] = (u, v)
            if i:
                (a, b), (c, d) = across[i - 1]
                e = emit[i] * v
                u, v = a * u + b * e, c * u + d * e
                u, v = u / (u + v), v / (u + v)
        parts = []
        for i in range(m + 1):
            k = gaps[i]
            if k:
                left = s.first[0] if i == 0 else np.array(fwd[i - 1]) @ s.step[0]
                right = s.one if i == m else s.turn[0] @ np.array([back[i][0], emit[i] * back[i][1]])
                parts.append(s.stretch(left, right, k))
            if i < m:
                p = fwd[i][1] * back[i][1]
                parts.append(np.array([p / (p + fwd[i][0] * back[i][0])]))
        return np.concatenate(parts)

    def train(self, data: list[tuple[Chain, list[int]]], rounds: int = 150, l2: float = 1e-4) -> None:
        """Adam on the mean log likelihood of (compressed text, labels of its tokens with features)."""
        packs = _packed(data)
        theta = self.theta()
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, rounds + 1):
            self.set(theta)
            g = self.gradient(packs) / len(data) - l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.set(theta)

    def gradient(self, packs: list[_Pack]) -> np.ndarray:
        """Of the sum of log likelihoods: labelled less expected counts. Those of features come from the marginals; the
        few shared weights' are central differences of the log partition function."""
        n = len(self.w)
        eps = 1e-4
        shared = np.concatenate([self.w[-1:], self.t.ravel(), self.start])
        moved = shared + np.concatenate([np.zeros((1, 7)), eps * np.eye(7), -eps * np.eye(7)])
        s = _Steps(moved[:, 0], moved[:, 1:5].reshape(-1, 2, 2), moved[:, 5:])
        out = np.zeros(n + 6)
        for pack in packs:
            log_z, p = pack.forward_backward(s, self.w)
            out[:n] += np.bincount(pack.feats, ((pack.y - p) * pack.mask)[pack.rows, pack.cols], minlength=n)
            slope = (log_z[1:8].sum(1) - log_z[8:].sum(1)) / (2 * eps)
            out[n - 1] += pack.counts[0] - slope[0]
            out[n:] += pack.counts[1:] - slope[1:]
        return out


class _Steps:
    """Matrices of the chain for several settings of the shared weights at once (first axis)."""

    def __init__(self, bias: np.ndarray, t: np.ndarray, start: np.ndarray):
        own = np.stack([np.ones_like(bias), np.exp(bias)], -1)
        self.turn = np.exp(t)
        self.begin = np.exp(start)
        #: Into a token without features, and the first token if it has none.
        self.step, self.first = self.turn * own[:, None, :], self.begin * own
        self.one = np.ones(2)
        a, b, c, d = (self.step[:, i, j] for i in (0, 1) for j in (0, 1))
        root = np.sqrt((a - d) ** 2 + 4 * b * c)
        self.large, self.small = (a + d + root) / 2, (a + d - root) / 2
        #: step = large * P + small * Q for complementary projections P and Q.
        eye = np.eye(2)[None]
        self.p = (self.step - self.small[:, None, None] * eye) / root[:, None, None]
        self.q = eye - self.p
        self.ratio = self.small / self.large
        self._ratio_powers = np.ones(1)
        self._known: dict = {}

    def power(self, k: np.ndarray) -> np.ndarray:
        """step^k / large^k for an array of exponents; axes: setting, exponent, 2, 2."""
        return self.p[:, None] + (self.ratio[:, None] ** k[None, :])[:, :, None, None] * self.q[:, None]

    def _powers(self, k: int) -> np.ndarray:
        if len(self._ratio_powers) < k:
            self._ratio_powers = float(self.ratio[0]) ** np.arange(max(k, 2 * len(self._ratio_powers)))
        return self._ratio_powers[:k]

    def _remember(self, key, make):
        got = self._known.get(key)
        if got is None:
            if len(self._known) > 100_000:
                self._known.clear()
            got = self._known[key] = make()
        return got

    def across(self, k: int) -> list[list[float]]:
        """From a token with features over ``k`` without to the next, up to scale."""
        return self._remember(("x", k), lambda: (self.power(np.array([k]))[0, 0] @ self.turn[0]).tolist())

    def leading(self, k: int) -> list[float]:
        """Into the first token with features after ``k`` without, up to scale."""
        return self._remember(("l", k), lambda: (self.begin[0] if k == 0 else self.first[0] @ self.power(np.array([k - 1]))[0, 0] @ self.turn[0]).tolist())

    def trailing(self, k: int) -> list[float]:
        """From the last token with features over ``k`` without to the end, up to scale."""
        return self._remember(("t", k), lambda: (self.power(np.array([k]))[0, 0] @ self.one).tolist())

    def stretch(self, left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
        """P(state 1) of ``k`` tokens without features: ``left`` leads into the first of them, ``right`` follows the last."""
        up = self._powers(k)
        l1, l2, r1, r2 = left @ self.p[0], left @ self.q[0], self.p[0] @ right, self.q[0] @ right
        on = (l1[1] + l2[1] * up) * (r1[1] + r2[1] * up[::-1])
        return on / (on + (l1[0] + l2[0] * up) * (r1[0] + r2[0] * up[::-1]))


class _Pack:
    """Compressed texts of about equally many tokens with features, padded to one width, and their labelled counts of
    (bias on tokens without features, transitions, starts)."""

    def __init__(self, data: list[tuple[Chain, list[int]]], width: int):
        n = len(data)
        self.y, self.mask = np.zeros((n, width)), np.zeros((n, width), bool)
        self.gaps, self.size = np.zeros((n, width), np.int64), np.array([len(labels) for _, labels in data])
        self.tail = np.array([gaps[-1] for (_, gaps), _ in data], np.int64)
        rows, cols, feats = [], [], []
        self.counts = np.zeros(7)
        for r, ((seen, gaps), labels) in enumerate(data):
            self.y[r, : len(labels)], self.mask[r, : len(labels)] = labels, True
            self.gaps[r, : len(labels)] = gaps[:-1]
            for c, fs in enumerate(seen):
                rows += [r] * len(fs)
                cols += [c] * len(fs)
                feats += fs
            path = None
            for label, gap in zip([*labels, None], gaps):
                # States of a stretch are 0; the text begins with the first of these, each follows the one before.
                for state, times in ((0, min(gap, 1)), (0, max(gap - 1, 0)), (label, 1)):
                    if state is not None and times:
                        self.counts[5 + state if path is None else 1 + 2 * path + state] += times
                        path = state
            self.counts[0] += sum(labels)
        self.rows, self.cols, self.feats = np.array(rows, np.int64), np.array(cols, np.int64), np.array(feats, np.int64)

    def forward_backward(self, s: _Steps, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log partition function per setting and text, P(state 1) of the tokens with features under the first setting)."""
        n, width = self.y.shape
        own = np.bincount(self.rows * max(width, 1) + self.cols, w[self.feats], minlength=n * max(width, 1)).reshape(n, max(width, 1))
        log = np.log(s.large)
        # The bias is one of the shared weights, so emissions differ by setting.
        bias = np.log(s.first[:, 1] / s.begin[:, 1])
        unique, where = np.unique(self.gaps, return_inverse=True)
        where = where.reshape(self.gaps.shape)
        power = s.power(unique)
        across = power @ s.turn[:, None]
        lead = np.where((unique == 0)[None, :, None], s.begin[:, None], np.einsum("vi,vuij,vjk->vuk", s.first, s.power(np.maximum(unique - 1, 0)), s.turn))
        log_z = (self.gaps * self.mask).sum(1)[None] * log[:, None]
        log_z = log_z - ((self.gaps[:, 0] > 0) if width else 0) * log[:, None]
        if width == 0:
            whole = np.einsum("vi,vnij->vn", s.first, s.power(np.maximum(self.tail - 1, 0)))
            return np.where(self.tail[None] > 0, np.log(whole) + np.maximum(self.tail - 1, 0)[None] * log[:, None], 0.0), np.zeros((n, 0))
        fwd = np.zeros((width, n, 2))
        for i in range(width):
            emit = np.exp(np.clip(bias[:, None] + own[None, :, i], -60, 60))
            if i == 0:
                now = lead[:, where[:, 0]]
            else:
                now = (state[:, :, None, :] @ across[:, where[:, i]])[:, :, 0]
            now = np.stack([now[..., 0], now[..., 1] * emit], -1)
            total = now.sum(-1)
            on = self.mask[:, i]
            log_z = log_z + np.where(on[None], np.log(total), 0)
            state = now / total[..., None] if i == 0 else np.where(on[None, :, None], now / total[..., None], state)
            fwd[i] = state[0]
        end = s.power(self.tail).sum(-1)
        log_z = log_z + np.log((state * end).sum(-1)) + self.tail[None] * log[:, None]
        p = np.zeros((n, width))
        back = end[0]
        for i in range(width - 1, -1, -1):
            both = fwd[i] * back
            p[:, i] = both[:, 1] / both.sum(1)
            if i:
                emit = np.exp(np.clip(bias[0] + own[:, i], -60, 60))
                before = (across[0, where[:, i]] @ np.stack([back[:, 0], back[:, 1] * emit], -1)[..., None])[..., 0]
                back = np.where(self.mask[:, i, None], before / before.sum(1, keepdims=True), back)
        return log_z, p


def cut(chain: Chain, longest: int) -> list[Chain]:
    """A compressed text as consecutive chains of at most ``longest`` tokens with features; nothing is left out."""
    seen, gaps = chain
    at = range(0, max(1, len(seen)), longest)
    return [(seen[a : a + longest], [*gaps[a : a + longest], 0] if a + longest < len(seen) else list(gaps[a:])) for a in at]


def _packed(data: list[tuple[Chain, list[int]]]) -> list[_Pack]:
    groups: dict[int, list[int]] = {}
    for k, (_, labels) in enumerate(data):
        groups.setdefault(1 << (len(labels) - 1).bit_length() if labels else 0, []).append(k)
    return [_Pack([data[k] for k in ks], max(len(data[k][1]) for k in ks)) for ks in groups.values()]


class Model:
    """The kept features, the field and the logistic curve."""

    def __init__(self, ids: dict[str, int], field: Field, curve: np.ndarray, prior: float | None = None):
        self.ids, self.field, self.curve, self.prior = ids, field, curve, prior

    def evidence(self, text: str | None, known: _Known, bare: dict[int, tuple[float, float]]) -> tuple[float, float, int, list[int]]:
        """Largest marginal, expected number of offending tokens, number of tokens, and the tagged tokens' numbers.

        ``bare`` remembers what texts of so many tokens without features give.
        """
        tokens = list(map(known.__getitem__, (text or "").split()))
        n = len(tokens)
        if n == 0:
            return 0.0, 0.0, 0, []
        plain = not any(tokens)
        if plain and n in bare:
            return *bare[n], n, []
        p = self.field.marginals(tokens)
        best, total = float(p.max()), float(p.sum())
        tagged = np.flatnonzero(p >= 0.5).tolist()
        if plain and not tagged:
            bare[n] = best, total
        return best, total, n, tagged

    def score(self, best: float, total: float, n: int) -> float:
        if self.prior is not None:
            return self.prior
        x = float(self.curve @ summary(best, total, n))
        return 1 / (1 + math.exp(min(700, -x)))


def summary(best: float, total: float, n: int) -> np.ndarray:
    """What the curve sees: a constant, the largest marginal, the expected number and share of offending tokens."""
    return np.array([1.0, best, math.log1p(total), math.log1p(500 * total / (n + 20))])


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Newton's method; ``l2`` keeps separable data finite."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 8_000, n_features: int = 2_000, least_odds: float = 2.0, longest: int = 512) -> Model:
    """Features and field from folds 1 to 3 of the sample, the curve from fold 4 (all from all if one lacks a class)."""
    drawn = labelled_sample(labels, label, sample)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    taught = named.join(F.broadcast(drawn), "doc_id").select("text", (F.col("y") >= 0.5).alias("y"), (F.col("fold") == 4).alias("last"))
    rows = materialize(taught.repartition(max(1, sample // 1000)), "op9-taught")
    counts = {(r["last"], r["y"]): r["n"] for r in rows.groupBy("last", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n = sum(v for (_, y), v in counts.items() if y), sum(counts.values())
    if not 0 < n1 < n:
        return Model({}, Field(0), np.zeros(4), n1 / n if n else 0.0)
    split = all(counts.get((last, y), 0) >= 3 for last in (True, False) for y in (True, False))
    part = rows.where("not last") if split else rows
    n1 = counts.get((False, True), 0) + (0 if split else counts.get((True, True), 0))

    def frequencies(batches):
        def full(c):
            keys = list(c[0].keys() | c[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([x[k] for k in keys], pa.int64()) for x in c)], names=["f", "t0", "t1", "n1"])

        c = (Counter(), Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1)):
                found, tokens = Counter(), Counter(text.as_py().split())
                for token, k in tokens.items():
                    for f in token_features(token):
                        found[f] += k
                found["total"] = sum(tokens.values())
                c[int(y.as_py())].update(found)
                if y.as_py():
                    c[2].update(found.keys())
                if len(c[0]) + len(c[1]) > 1_000_000:
                    yield full(c)
                    c = (Counter(), Counter(), Counter())
        yield full(c)

    each = part.select("text", "y").mapInArrow(frequencies, "f string, t0 long, t1 long, n1 long")
    each = materialize(each.groupBy("f").agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "n1"))), "op9-features")
    total = each.where("f = 'total'").first()
    strong = each.where((F.col("n1") >= max(3, 0.008 * n1)) & (F.col("f") != "total"))
    strong = strong.withColumn("odds", F.log((F.col("t1") + 0.5) / (F.col("t0") + 0.5) * (total["t0"] + 1) / (total["t1"] + 1))).where(F.col("odds") >= least_odds)
    kept = strong.orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "f").limit(n_features).collect()
    ids = {r["f"]: k for k, r in enumerate(kept)}

    def chains(batches):
        known = _Known(ids)
        for batch in batches:
            seen, gaps, sizes = [], [], []
            for text in batch.column(0):
                found, between = compressed(list(map(known.__getitem__, text.as_py().split())))
                seen.append([list(f) for f in found])
                gaps.append(between)
                sizes.append(sum(between) + len(found))
            lists = pa.list_(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(seen, lists), pa.array(gaps, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), batch.column(1), batch.column(2)], names=["s", "g", "n", "y", "last"])

    # At most ``sample`` rows.
    drawn = rows.mapInArrow(chains, "s array<array<long>>, g array<long>, n long, y boolean, last boolean").where("n > 0").collect()
    as_chain = lambda r: ([tuple(f) for f in r["s"]], list(r["g"]))
    field = Field(len(ids))
    data = [(c, [int(r["y"])] * len(c[0])) for r in drawn if not (split and r["last"]) for c in cut(as_chain(r), longest)]
    if data:
        field.train(data)
    x, y = [], []
    for r in drawn:
        if r["last"] or not split:
            p = field.chain(*as_chain(r))
            x.append(summary(float(p.max()), float(p.sum()), len(p)))
            y.append(float(r["y"]))
    return Model(ids, field, _logistic(np.array(x).reshape(-1, 4), np.array(y)))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (tagged tokens as "start:end" code points, comma-joined) per row."""
    model = fit(docs, labels, **fitting)

    def run(batches):
        known, bare = _Known(model.ids), {}
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                text = text.as_py()
                best, total, n, tagged = model.evidence(text, known, bare)
                scores.append(model.score(best, total, n))
                where = [m.span() for m in _TOKEN.finditer(text)] if tagged else []
                spans.append(",".join(f"{where[i][0]}:{where[i][1]}" for i in tagged))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans string")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
