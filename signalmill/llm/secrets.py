"""Secret scan: fixed patterns, and formats learned from their matches by grammar inference.

Base spans are the fixed patterns' matches. Their values, a bounded sample labelled by kind, train one probabilistic
automaton a kind: a prefix tree of the values, whose statistically compatible states are merged (Hoeffding bound on the
frequencies of each symbol and of ending, recursively; states in one of which every value ends and in the other none do not
merge, however few their visits), most frequent states first. Every other credential-like run of
each text is then a candidate, scored by its likelihood under the automata against a model of ordinary runs: how the run is
cased, and which characters follow each other, case aside. What an automaton accepts with ``spare_bits`` bits to spare
becomes a further span; by the model of ordinary runs, at most one in 2^spare_bits of them would. A run that is one
word or number to that model's eye (its letters all of one case, or capitalised, without digits) is scored like any other.

Scale: two narrow passes over the texts. The sample is one value for each of ``sample`` hash buckets and kind, a plain
aggregate with map-side combine, so it is bounded, uniform over distinct values and the same for any partitioning. The
model of ordinary runs counts all candidates: a row for each case pattern and pair of characters, some 2,000 in all.

Defined results: null or empty text has no spans; repeated rows each give a row; of texts of any length all candidates are
scored, in time linear in their length; spans are ordered by start, then kind; of formats that are equally likely the alphabetically last kind is taken; a kind with fewer than ``least`` sampled
values has no automaton; values over ``LONGEST`` characters are base spans but do not train; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory

# The base patterns and the least lengths of a match.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Candidates have the alphabet and least length of assigned values and any length; a part holds no separator.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_PART = re.compile(r"[A-Za-z0-9+/_-]{8,}")
_KNOWN = 100_000
#: Longest value in the labelled sample that trains an automaton, so that the driver's prefix tree is bounded.
LONGEST = 256


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of the base matches, by start, then kind."""
    out = []
    low = text.lower()
    if "token" in low or "passw" in low or "secret" in low or "key" in low:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    for run in _RUN.finditer(text):
        a, b = run.span()
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= LEAST_ACCESS]
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text, a, b)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal credential-like runs that overlap no base span, and the parts without separators of the others that do not.

    ``taken`` are the base spans by start; they are merged into disjoint ones, among which each run is looked up.
    """
    if not taken:
        return [m.span() for m in _CANDIDATE.finditer(text)]
    starts, ends = [], []
    for x, y in taken:
        if ends and x <= ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x), ends.append(y)
    free = lambda a, b: (i := bisect_left(starts, b)) == 0 or ends[i - 1] <= a
    out = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        if free(a, b):
            out.append((a, b))
        else:
            out += [p.span() for p in _PART.finditer(text, a, b) if free(*p.span())]
    return out


def learned_spans(run: str, grammar: Grammar) -> list[tuple[int, int, str]]:
    """(start, end, kind) within a candidate: the whole run, without separators around it, what follows its last inner
    "=", or each of its parts without separators, whichever first has a learned format."""
    known = grammar.known
    if run in known:
        return known[run]
    x, y = len(run) - len(run.lstrip(".=")), len(run.rstrip(".="))
    inner = run.rfind("=", 0, y) + 1
    out: list[tuple[int, int, str]] = []
    tried = set()
    for a, b in ((0, len(run)), (x, len(run)), (0, y), (x, y), (inner, len(run)), (inner, y)):
        if (a, b) not in tried and b - a >= LEAST_VALUE and (kind := grammar.kind(run[a:b])):
            out = [(a, b, kind)]
            break
        tried.add((a, b))
    else:
        parts = [m.span() for m in _PART.finditer(run)]
        out = [(a, b, kind) for a, b in parts if (a, b) not in tried and (kind := grammar.kind(run[a:b]))]
    if len(run) <= LONGEST:
        if len(known) >= _KNOWN:
            known.clear()
        known[run] = out
    return out


_HEXES, _UPPER, _LOWER = set("0123456789abcdef"), set("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("0123456789abcdefghijklmnopqrstuvwxyz")


def symbols(value: str, prefix: str) -> list[tuple[str, int]]:
    """(symbol, number of characters it stands for): a learned literal prefix, then the narrowest alphabet of digits and
    letters of one case if the value has both (or the prefix), else a class a character."""
    n = len(prefix) if value.startswith(prefix) else 0
    rest = value[n:]
    chars = set(rest)
    both = n > 0 or any(c.isdigit() for c in chars) and any(c.isalpha() for c in chars)
    if both and chars <= _HEXES:
        body = [("x", 16)] * len(rest)
    elif both and chars <= _UPPER:
        body = [("U", 36)] * len(rest)
    elif both and chars <= _LOWER:
        body = [("l", 36)] * len(rest)
    else:
        body = [("d", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) if c.isupper() else (c, 1) for c in rest]
    return [("=" + c, 1) for c in value[:n]] + body


def common_prefix(values: list[str]) -> str:
    """The longest prefix of at least 3 characters that over nine tenths of the values share, else none."""
    out = ""
    while True:
        nxt = Counter(v[len(out)] for v in values if v.startswith(out) and len(v) > len(out)).most_common(1)
        if not nxt or nxt[0][1] < 0.9 * len(values):
            return out if len(out) >= 3 else ""
        out += nxt[0][0]


class Automaton:
    """A probabilistic finite automaton: per state the visits, the endings and (next state, visits) per symbol."""

    def __init__(self, values: list[str], alpha: float = 0.01):
        self.prefix = common_prefix(values)
        self.n, self.end, self.to, self.via = [0], [0], [{}], [{}]
        for v in values:
            s = 0
            self.n[0] += 1
            for sym, _ in symbols(v, self.prefix):
                if sym not in self.to[s]:
                    self.to[s][sym] = len(self.n)
                    self.n.append(0), self.end.append(0), self.to.append({}), self.via.append({})
                self.via[s][sym] = self.via[s].get(sym, 0) + 1
                s = self.to[s][sym]
                self.n[s] += 1
            self.end[s] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n, m = self.n[p], self.n[q]
            ends, stops = self.end[p], self.end[q]
            # States of few visits differ too if all values end in one and none in the other, so that lengths are kept.
            if self._differ(ends, n, stops, m) or abs(ends / n - stops / m) == 1:
                return False
            for sym in self.via[p].keys() | self.via[q].keys():
                if self._differ(self.via[p].get(sym, 0), n, self.via[q].get(sym, 0), m):
                    return False
                if sym in self.to[p] and sym in self.to[q]:
                    stack.append((self.to[p][sym], self.to[q][sym]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree below q to the automaton at p."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.n[p] += self.n[q]
            self.end[p] += self.end[q]
            for sym, k in self.via[q].items():
                self.via[p][sym] = self.via[p].get(sym, 0) + k
                if sym in self.to[p]:
                    stack.append((self.to[p][sym], self.to[q][sym]))
                else:
                    self.to[p][sym] = self.to[q][sym]

    def _merge_all(self) -> None:
        settled = [0]
        while True:
            known = set(settled)
            border = {t: (s, sym) for s in settled for sym, t in self.to[s].items() if t not in known}
            if not border:
                return
            q = max(border, key=lambda t: (self.n[t], -t))
            for p in settled:
                if self._compatible(p, q):
                    s, sym = border[q]
                    self.to[s][sym] = p
                    self._fold(p, q)
                    break
            else:
                settled.append(q)

    def states(self) -> set[int]:
        """The states that can be reached."""
        seen, stack = {0}, [0]
        while stack:
            for t in self.to[stack.pop()].values():
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return seen

    def bits(self, value: str) -> float | None:
        """log2 of the value's probability, or None if the automaton does not accept it."""
        s, out = 0, 0.0
        for sym, size in symbols(value, self.prefix):
            k = self.via[s].get(sym)
            if not k:
                return None
            out += math.log2(k / self.n[s] / size)
            s = self.to[s][sym]
        return out + math.log2(self.end[s] / self.n[s]) if self.end[s] else None


_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CODE = {c: i + 1 for i, c in enumerate(_ALPHABET)}
#: Case patterns of a run's letters.
CASES = ("none", "lower", "upper", "capital", "mixed")


def case_of(run: str) -> str:
    """How a run is cased."""
    if run.islower():
        return "lower"
    if run.isupper():
        return "upper"
    if not any(map(str.isalpha, run)):
        return "none"
    rest = run[1:]
    return "capital" if run[0].isupper() and rest.islower() else "mixed"


class Ordinary:
    """The model of ordinary runs: counts of case patterns, and of pairs of neighbouring characters, case aside; the ends
    of a run count as a character."""

    def __init__(self, cases: dict[str, int], pairs: np.ndarray):
        total = sum(cases.values()) + len(CASES)
        self.case = {c: math.log2((cases.get(c, 0) + 1) / total) for c in CASES}
        # One occurrence of each pair is left out, so that a run does not vouch for itself.
        smooth = np.maximum(pairs - 1, 0) + 0.5
        self.pair = np.log2(smooth / smooth.sum(1, keepdims=True)).tolist()

    @staticmethod
    def count(runs: dict[str, int]) -> tuple[Counter, np.ndarray]:
        """(case patterns, pairs) of runs with their numbers."""
        cases: Counter = Counter()
        for run, n in runs.items():
            cases[case_of(run)] += n
        size = len(_ALPHABET) + 1
        raw = np.frombuffer(("\n" + "\n".join(runs) + "\n").translate(_FOLD).encode("ascii"), np.uint8) if runs else np.zeros(0, np.uint8)
        code = np.zeros(256, np.int64)
        for c, i in _CODE.items():
            code[ord(c)] = i
        at = code[raw]
        if not len(at):
            return cases, np.zeros((size, size))
        # A pair belongs to the run that its first character ends or its second one begins.
        of_run = np.minimum(np.cumsum(raw == 10) - 1, len(runs) - 1)
        weight = np.fromiter(runs.values(), np.float64, len(runs))[of_run]
        return cases, np.bincount(at[:-1] * size + at[1:], weight[:-1], minlength=size * size).reshape(size, size)

    def bits(self, run: str) -> float:
        """log2 of the probability of an ordinary run."""
        case = case_of(run)
        out, last = self.case[case], 0
        for c in run.translate(_FOLD):
            code = _CODE[c]
            out += self.pair[last][code]
            last = code
        return out + self.pair[last][0] - (sum(map(str.isalpha, run)) if case == "mixed" else 0)


class Grammar:
    """The automata by kind and the model of ordinary runs."""

    def __init__(self, by_kind: dict[str, list[str]], ordinary: Ordinary, least: int = 10, spare_bits: float = 20.0):
        self.automata = {k: Automaton(sorted(v)) for k, v in by_kind.items() if len(v) >= least}
        self.ordinary, self.spare_bits = ordinary, spare_bits
        self.known: dict[str, list[tuple[int, int, str]]] = {}

    def spare(self, value: str) -> tuple[float, str] | None:
        """(bits by which the likeliest format exceeds an ordinary run, its kind), none if no automaton accepts the value."""
        got = [(b, k) for k, a in self.automata.items() if (b := a.bits(value)) is not None]
        if not got:
            return None
        best, kind = max(got)
        return best - self.ordinary.bits(value), kind

    def kind(self, value: str) -> str | None:
        """The kind whose format the value has, if its likelihood exceeds that of an ordinary run by ``spare_bits``."""
        got = self.spare(value)
        return got[1] if got and got[0] >= self.spare_bits else None


def learn(docs: DataFrame, sample: int = 500, least: int = 10) -> Grammar:
    """The grammar of the whole corpus' base matches, from at most ``sample`` values a kind and the counts of all other runs."""

    def run(batches):
        size = len(_ALPHABET) + 1
        for batch in batches:
            kinds, values = [], []
            runs: Counter = Counter()
            for text in batch.column(0):
                text = text.as_py() or ""
                spans = base_spans(text)
                for _, k, _, value in spans:
                    if len(value) <= LONGEST:
                        kinds.append(KINDS[k])
                        values.append(value)
                runs.update([text[a:b] for a, b in candidates(text, [(s[0], s[2]) for s in spans])])
            cases, pairs = Ordinary.count(runs)
            at = np.flatnonzero(pairs.ravel())
            counts = [0] * len(kinds) + list(cases.values()) + pairs.ravel()[at].astype(np.int64).tolist()
            kinds += ["case"] * len(cases) + ["pair"] * len(at)
            values += [*cases, *(f"{i // size},{i % size}" for i in at.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(counts, pa.int64())], names=["kind", "value", "n"])
        release_memory()

    # A count's row has a bucket of its own.
    hashed = docs.select("text").mapInArrow(run, "kind string, value string, n long").withColumn("h", F.xxhash64("value"))
    bucket = F.when(F.col("kind").isin("case", "pair"), F.col("value")).otherwise(F.pmod("h", F.lit(sample)).cast("string"))
    drawn = hashed.groupBy("kind", bucket.alias("bucket")).agg(F.min_by("value", "h").alias("value"), F.sum("n").alias("n")).collect()
    by_kind: dict[str, list[str]] = {}
    cases, pairs = {}, np.zeros((len(_ALPHABET) + 1, len(_ALPHABET) + 1))
    for r in drawn:
        if r["kind"] == "case":
            cases[r["value"]] = r["n"]
        elif r["kind"] == "pair":
            i, j = map(int, r["value"].split(","))
            pairs[i, j] = r["n"]
        else:
            by_kind.setdefault(r["kind"], []).append(r["value"])
    return Grammar(by_kind, Ordinary(cases, pairs), least)


def all_spans(text: str, grammar: Grammar) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans as (start, end, name) by start, then kind; learned ones are named learned_<kind>."""
    base = base_spans(text)
    out = [(s, k, e, KINDS[k]) for s, k, e, _ in base]
    for a, b in candidates(text, [(s, e) for s, _, e, _ in base]):
        for x, y, kind in learned_spans(text[a:b], grammar):
            out.append((a + x, len(KINDS) + KINDS.index(kind), a + y, "learned_" + kind))
    return base, [(s, e, name) for s, _, e, name in sorted(out)]


def find_secrets(docs: DataFrame, sample: int = 500, grammar: Grammar | None = None) -> DataFrame:
    """Per document row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned."""
    grammar = grammar or learn(docs, sample)

    def run(batches):
        for batch in batches:
            counts, digests, spans, learned = [[], [], []], [], [], []
            for text in batch.column(1):
                base, found = all_spans(text.as_py() or "", grammar)
                for k in range(3):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
                spans.append(",".join(f"{name}:{s}:{e}" for s, e, name in found))
                learned.append(len(found) - len(base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans, pa.string()), pa.array(learned, pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"],
            )
        release_memory()

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, sample: int = 500, mark: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced by ``mark``; all columns stay, n_chars follows the text if present."""
    grammar = learn(docs, sample)
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            changed = {}
            for i, text in enumerate(texts):
                spans = all_spans(text, grammar)[1] if text else []
                if spans:
                    out, done = [], 0
                    for s, e, _ in spans:
                        if s >= done:
                            out += [text[done:s], mark]
                        done = max(done, e)
                    changed[i] = "".join([*out, text[done:]])
            if changed:
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[at].type)
                if size is not None:
                    old = columns[size].to_pylist()
                    columns[size] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(old)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        release_memory()

    return docs.mapInArrow(run, docs.schema)
