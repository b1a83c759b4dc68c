"""Quality classifier: ridge regression on random Fourier features of document statistics, isotonically calibrated.

The features are the random ones and a constant, nothing else.

Each text gives 32 statistics (shares of character classes and punctuation, word and line lengths, repetition).
Random Fourier features z approximate a Gaussian kernel on the standardised statistics. The normal equations
sum(z z') and sum(z y) are summed inside each partition and then over partitions; ridge weights follow on the driver
from one (features x features) matrix. Scores of a part of the training rows that the ridge did not see are
calibrated by pooling adjacent violators over a fixed grid.

Scale: the model is fitted on a bounded sample: at most ``sample`` labelled documents, the least by hash of their id in
each of as many buckets, broadcast as (doc_id, label) pairs, so one narrow pass over the texts computes their
statistics. Scoring is one more narrow pass; no text is shuffled.

Defined results: null or empty text has statistics 0 and is scored as such; texts of any length are read whole; equal
scores are one step of the calibration; an empty table gives no rows; null labels or ids teach nothing; a doc_id
with several labels teaches their mean, and repeated document rows each count; with fewer than 2 classes in the sample
every score is the sample's mean label (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory, utf8

_CLASS = np.zeros((256, 16), np.float64)
#: Byte classes in order: lower, upper, digit, space, line feed, other control, UTF-8 lead, then these groups of marks.
_MARKS = (b".", b",", b"!?", b";:", b"'\"`", b"()[]{}<>", b"-_/\\", b"+*=|~^", b"#$%&@")
for _b in range(128):
    _k = next((7 + i for i, group in enumerate(_MARKS) if _b in group), 5)
    _CLASS[_b, 0 if 97 <= _b <= 122 else 1 if 65 <= _b <= 90 else 2 if 48 <= _b <= 57 else 3 if _b == 32 else 4 if _b == 10 else _k] = 1
_CLASS[192:, 6] = 1
N_STATS = 32
_STEP = 1 << 16


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a text; zeros if it is null or empty."""
    out = np.zeros(N_STATS)
    raw = utf8(text)
    if not raw:
        return out
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:16] = np.sqrt(count @ _CLASS / n)
    words = raw.split()
    if not words:
        return out
    m = len(words)
    lengths = np.fromiter(map(len, words), np.float64, m)
    out[16:20] = np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(lengths.max()), np.log(m + 1) / 10
    out[20] = len(set(words)) / m
    out[21] = sum(map(bytes.isupper, words)) / m
    out[22] = sum(map(bytes.istitle, words)) / m
    out[23] = sum(not any(map(str.isalnum, w)) for w in raw.decode("utf-8", "replace").split()) / m
    lines = raw.split(b"\n")
    out[24] = np.log1p(len(lines)) / 10
    out[25] = 1 - len(set(lines)) / len(lines)
    out[26] = np.log1p(m / len(lines)) / 5
    sentences = max(1, raw.count(b".") + raw.count(b"!") + raw.count(b"?"))
    out[27] = np.log1p(m / sentences) / 5
    out[28] = (lengths == 1).mean()
    out[29] = (lengths <= 3).mean()
    out[30] = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / m
    ends = [w[-3:] for w in words if len(w) > 3]
    out[31] = len(set(ends)) / (len(ends) + 1)
    return out


class Model:
    """Standardisation, random features, ridge weights and the calibration's steps."""

    def __init__(self, mean, scale, freq, phase, weights, grid, value):
        self.mean, self.scale, self.freq, self.phase, self.weights, self.grid, self.value = mean, scale, freq, phase, weights, grid, value

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / self.freq.shape[1]) * np.cos(x @ self.freq + self.phase)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        return np.clip(np.interp(self.raw(stats), self.grid, self.value), 0, 1) if self.weights is not None else np.full(len(stats), self.value)


def pool_adjacent(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Isotonic (non-decreasing) means of groups in order, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for n, k in zip(total.tolist(), ones.tolist()):
        blocks.append([n, k, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, k2, w2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + k2, blocks[-1][2] + w2]
    return np.repeat([k / n for n, k, _ in blocks], [w for *_, w in blocks])


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5; 0 is held out. A null id is held out too."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(0).cast("long"))


def labelled_sample(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(doc_id, y, fold) of at most ``sample`` labelled ids outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    each = known.withColumn("fold", fold(F.col("doc_id"))).where("fold != 0").groupBy("doc_id", "fold").agg(F.avg("y").alias("y"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(sample))
    return each.groupBy(bucket.alias("bucket")).agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), "doc_id", "y", "fold")).alias("r")).select("r.doc_id", "r.y", "r.fold")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 40_000, n_features: int = 256, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fit on folds 1 to 3 of the sample and calibrate on fold 4 (on all where one of them lacks a class)."""
    drawn = labelled_sample(labels, label, sample)

    def run(batches):
        for batch in batches:
            stats = [statistics(x.as_py()).astype("<f8").tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(stats, pa.binary()), batch.column(1), batch.column(2)], names=["x", "y", "fold"])

    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").select("text", "y", "fold")
    rows = materialize(taught.mapInArrow(run, "x binary, y double, fold long"), "op8-taught")

    def sums(batches, model: Model | None, train: bool):
        """One partition's share of the moments, or of the normal equations."""
        a = None
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f8").reshape(-1, N_STATS)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            z = np.hstack([np.ones((len(x), 1)), x, x * x, y[:, None]]) if model is None else np.hstack([model.features(x), y[:, None]])
            part = np.vstack([z.sum(0), (z[:, -1:] * z).sum(0)]) if model is None else z.T @ z
            a = part if a is None else a + part
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(a))), pa.array(list(a), pa.list_(pa.float64()))], names=["i", "v"])

    def summed(df: DataFrame, model: Model | None, width: int) -> np.ndarray:
        """The partitions' shares summed by row; at most ``width`` rows of ``width`` numbers reach the driver."""
        part = df.mapInArrow(lambda b: sums(b, model, True), "i long, v array<double>")
        cells = part.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
        out = np.zeros((width, width))
        for r in cells.collect():
            out[r.i, r.j] = r.v
        return out

    moments = summed(rows, None, 2 * N_STATS + 2)
    n, ones = moments[0, 0], moments[0, -1]
    if n == 0 or ones <= 0 or ones >= n:
        return Model(None, None, None, None, None, None, float(ones / n) if n else 0.5)
    mean = moments[0, 1 : 1 + N_STATS] / n
    scale = np.sqrt(np.maximum(moments[0, 1 + N_STATS : 1 + 2 * N_STATS] / n - mean**2, 1e-8)) + 1e-3
    rng = np.random.default_rng(seed)
    freq = rng.normal(size=(N_STATS, n_features)) / np.sqrt(N_STATS)
    model = Model(mean, scale, freq, rng.uniform(0, 2 * np.pi, n_features), None, None, None)
    classes = {r.fold < 4: (r.n, r.k) for r in rows.groupBy((F.col("fold") < 4).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).collect()}
    both = all(t in classes and 5 <= classes[t][1] <= classes[t][0] - 5 for t in (True, False))
    width = n_features + 2
    normal = summed(rows.where("fold < 4") if both else rows, model, width)
    gram, right = normal[:-1, :-1], normal[:-1, -1]
    model.weights = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), right)

    grid = np.linspace(-0.5, 1.5, 401)

    def binned(batches):
        total, k = np.zeros(len(grid)), np.zeros(len(grid))
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f8").reshape(-1, N_STATS)
            at = np.clip(np.round((model.raw(x) + 0.5) / 0.005).astype(int), 0, len(grid) - 1)
            total += np.bincount(at, minlength=len(grid))
            k += np.bincount(at, batch.column(1).to_numpy(zero_copy_only=False), minlength=len(grid))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid))), pa.array(total), pa.array(k)], names=["i", "n", "k"])

    bins = (rows.where("fold = 4") if both else rows).mapInArrow(binned, "i long, n double, k double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n > 0").orderBy("i").collect()
    total, k = np.array([r.n for r in bins]), np.array([r.k for r in bins])
    model.grid, model.value = grid[[r.i for r in bins]], pool_adjacent(total, k)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted per document row."""
    model = fit(docs, labels, **fitting)

    def run(batches):
        for batch in batches:
            got = model.score(np.array([statistics(x.as_py()) for x in batch.column(1)]).reshape(-1, N_STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])
        release_memory()

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """The document rows, with all their columns, that the classifier does not reject."""
    model = fit(docs, labels, **fitting)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            got = model.score(np.array([statistics(x.as_py()) for x in batch.column(at)]).reshape(-1, N_STATS))
            yield batch.filter(pa.array(got >= threshold))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
