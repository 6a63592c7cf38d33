"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), the pairwise interactions in time linear
in the features by the sum-of-squares identity. Features: words hashed to BUCKETS (log counts, unit length), binned structure
statistics, and given metadata columns, hashed by name and value. It is fitted on the driver on at most `sample` labelled rows (those with
the smallest hash of their key); texts never leave the executors, only their feature lists do. Scoring is one narrow pass over whole texts.

Defined cases: null is the empty text, which has a score like any other; rows without or with null labels aren't learned from; an id with several
labels is good if most say so; with fewer than two classes the score is the share of good labels, or 0.5 without any. Ties of the sample's hash are broken by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_batches, texts_of

BUCKETS = 1 << 14
#: Bound of the labelled sample, and the folds: rows with crc32(key) mod FOLDS = 0 are held out.
SAMPLE_ROWS = 6_000
FOLDS = 5
FACTORS = 8
#: Edges of the bins of each structure statistic.
STATS = {
    "words": (0.5, 5, 20, 50, 100, 300, 1000, 5000),
    "word_length": (2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 14),
    "symbols": (0.001, 0.01, 0.03, 0.1, 0.3, 0.6, 1.0),
    "marks": (0.001, 0.01, 0.03, 0.1, 0.3, 0.6, 0.9),
    "bars": (0.001, 0.01, 0.03, 0.1, 0.3, 0.5),
    "upper": (0.02, 0.1, 0.2, 0.4, 0.6, 0.9),
    "digits": (0.001, 0.01, 0.03, 0.1, 0.3),
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "runs": (0.001, 0.01, 0.05, 0.2, 0.5, 0.8),
    "lines": (0.5, 1.5, 3.5, 10, 50),
    "same_lines": (0.001, 0.05, 0.2, 0.4, 0.6),
}
_FIRST = {name: BUCKETS + 16 * k for k, name in enumerate(STATS)}
META = BUCKETS + 16 * len(STATS)
META_BUCKETS = 256
SIZE = META + META_BUCKETS


def structure(text: bytes, words: list[bytes]) -> dict[str, float]:
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    per = max(n, 1)
    return {
        "words": n,
        "word_length": sum(map(len, words)) / per,
        "symbols": sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">")) / per,
        "marks": (text.count(b"!") + text.count(b"?")) / per,
        "bars": text.count(b"|") / per,
        "upper": sum(map(bytes.isupper, words)) / per,
        "digits": sum(map(bytes.isdigit, words)) / per,
        "distinct": len(set(words)) / per,
        "runs": sum(map(bytes.__eq__, words, words[1:])) / per,
        "lines": len(lines),
        "same_lines": 1 - len(set(lines)) / max(len(lines), 1),
    }


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower()) % BUCKETS
        return h


def features(text: bytes, buckets: Buckets, meta: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one text."""
    words = text.split()
    index, counts = np.unique(np.array(list(map(buckets.__getitem__, words)), np.int64), return_counts=True)
    values = np.log1p(counts)
    values /= max(float(np.sqrt((values * values).sum())), 1e-9)
    bins = [_FIRST[k] + int(np.searchsorted(STATS[k], v)) for k, v in structure(text, words).items()]
    bins += [META + xxhash.xxh3_64_intdigest(m.encode()) % META_BUCKETS for m in meta]
    return np.concatenate([index, bins]).astype(np.int32), np.concatenate([values, np.full(len(bins), 0.5)]).astype(np.float32)


class Machine:
    """Parameters and scores of a factorisation machine."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def margins(self, index: np.ndarray, values: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margins of n rows given as triples, and the sums of v x that the identity and the gradient share."""
        xv = self.v[index] * values[:, None]
        sums = np.zeros((n, self.v.shape[1]))
        np.add.at(sums, rows, xv)
        squares = np.bincount(rows, (xv * xv).sum(1), n)
        return self.bias + np.bincount(rows, self.w[index] * values, n) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, index: np.ndarray, values: np.ndarray) -> float:
        xv = self.v[index] * values[:, None]
        s = xv.sum(0)
        m = self.bias + float(self.w[index] @ values) + 0.5 * float(s @ s - (xv * xv).sum())
        return float(1 / (1 + np.exp(-np.clip(m, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 1) -> Machine:
    """AdaGrad on the logistic loss. rows: feature numbers, values, label."""
    share = np.mean([r[2] for r in rows]) if rows else 0.5
    prior = np.clip(share, 1e-3, 1 - 1e-3)
    rng = np.random.default_rng(seed)
    m = Machine(float(np.log(prior / (1 - prior))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, FACTORS)))
    if len({r[2] for r in rows}) < 2:
        m.v[:] = 0
        return m
    gw, gv, gb = np.full(SIZE, 1e-2), np.full((SIZE, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 64):
            part = [rows[i] for i in order[at : at + 64]]
            n = len(part)
            index, values = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part]).astype(float)
            row = np.repeat(np.arange(n), [len(r[0]) for r in part])
            margin, sums = m.margins(index, values, row, n)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - np.array([r[2] for r in part])) / n
            used, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, slope[row] * values, len(used)) + decay * m.w[used]
            dv = np.zeros((len(used), FACTORS))
            np.add.at(dv, back, (slope[row] * values)[:, None] * (sums[row] - m.v[index] * values[:, None]))
            dv += decay * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += slope.sum() ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
            m.bias -= rate * slope.sum() / np.sqrt(gb)
    return m


def sample(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...], key: str, text: str, label: str, bound: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and labels of at most `bound` rows out of the held-out fold."""
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold != 0)).groupBy(F.col(key).alias("__key")).agg((F.avg(F.col(label).cast("double")) > 0.5).cast("int").alias("__label"))
    chosen = marks.orderBy(F.xxhash64("__key"), "__key").limit(bound)  # bound rows at most: broadcast
    rows = docs.join(F.broadcast(chosen), F.col(key) == F.col("__key")).select(F.col(text).alias("text"), "__label", F.col("__key"), *[F.col(c).cast("string").alias(f"m_{c}") for c in metadata])

    def run(batches: Iterator):
        import pyarrow as pa

        buckets = Buckets()
        for b in batches:
            meta = _metadata(b, metadata)
            got = [features(t, buckets, m) for t, m in zip(texts_of(b), meta)]
            yield pa.RecordBatch.from_arrays([b.column("__key").cast(pa.string()), b.column("__label"), pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([y.tobytes() for _, y in got], pa.binary())], names=["key", "label", "index", "values"])

    bounded_batches(docs.sparkSession)
    out = rows.mapInArrow(run, "key string, label int, index binary, values binary").orderBy("key", "index").limit(bound).collect()
    return [(np.frombuffer(r["index"], np.int32), np.frombuffer(r["values"], np.float32), r["label"]) for r in out]


def _metadata(batch, metadata: tuple[str, ...]) -> list[list[str]]:
    columns = [[f"{c}={v}" for v in batch.column(f"m_{c}").to_pylist()] for c in metadata]
    return [list(x) for x in zip(*columns)] if columns else [[]] * batch.num_rows


def scored(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """key, held_out, score, predicted of every row."""
    machine = fit(sample(docs, labels, metadata, key, text, label, bound))
    w, v, bias = machine.w.astype(np.float32), machine.v.astype(np.float32), machine.bias

    def run(batches: Iterator):
        import pyarrow as pa

        fm, buckets = Machine(bias, w, v), Buckets()
        for b in batches:
            meta = _metadata(b, metadata)
            s = [fm.score(*features(t, buckets, m)) for t, m in zip(texts_of(b), meta)]
            if len(buckets) > 400_000:
                buckets.clear()
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[key, "held_out", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), (F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0).alias("held_out"), F.col(text).alias("text"), *[F.col(c).cast("string").alias(f"m_{c}") for c in metadata])
    return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")
