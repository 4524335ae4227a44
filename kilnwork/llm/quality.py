"""Quality scores from Bradley-Terry pairs.

A document's strength is a linear function of features of its whole text; that a good document beats a bad one has the
logistic probability of the difference. Preference pairs come from the labels: each good training document is paired with bad
ones, and the weights minimise the logistic loss on the differences of their features (iteratively reweighted least squares
with a ridge). The threshold is the quantile of the training documents' strengths at their share of bad labels; the score is
the logistic of (strength - threshold), so 0.5 is the threshold.

Features are shares of kinds of bytes and words, repetition of words and lines, and lengths, each cut at training
quantiles into steps. Language, source, id and labels are no features.

The fit uses at most SAMPLE training documents, those with the smallest hashes of their ids; all else covers every row.

Defined cases: null texts count as empty; empty texts get the score of their features; without labels of both kinds
every document has the score 0.5 and is kept; repeated rows each get a row; repeated labels of a document count by
their largest; other columns are ignored by score() and kept by keep_good().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTES, U64, pieces, texts, word_hashes, word_spans
from .ranking import uniform52

#: Documents to fit on, pairs a good document gets, steps a feature, ridge.
SAMPLE, PAIRS, STEPS, RIDGE = 20_000, 3, 12, 3.0

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:", "call": b"!?", "quote": b"\"'()", "sign": b"#$%&*@^~", "bar": b"|<>[]{}\\/=+_-", "line": b"\n\r", "high": range(128, 256)}
_CLASS = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(_KINDS.values()):
    _CLASS[list(_bytes)] = _i + 1


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends[1:]] - total[ends[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    kinds = _CLASS[data]
    columns = [_sums(kinds == i + 1, offsets) / np.maximum(size, 1) for i in range(len(_KINDS))]
    starts, ends, rows = word_spans(data, offsets)
    at = np.searchsorted(rows, np.arange(n + 1))
    words = np.diff(at).astype(np.float64)
    some = np.maximum(words, 1)
    hashes = word_hashes(data, starts, ends)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    keys = np.unique((rows.astype(U64) << U64(40)) | (hashes >> U64(24)))
    distinct = np.diff(np.searchsorted(keys, np.arange(n + 1, dtype=U64) << U64(40)))
    last = kinds[ends - 1] if len(ends) else np.zeros(0)
    first = kinds[starts] if len(starts) else np.zeros(0)
    upper = np.zeros(len(data) + 1)
    np.cumsum(kinds == 1, out=upper[1:])
    loud = (upper[ends] - upper[starts]) >= 2 if len(starts) else np.zeros(0)
    columns += [
        np.log1p(size),
        np.log1p(words),
        (size - words) / some,
        _sums(same, at) / some,
        distinct / some,
        np.log1p(distinct) / np.log1p(some),
        _sums((last == 5) | (last >= 7), at) / some,
        _sums(last == 4, at) / some,
        _sums(first == 1, at) / some,
        _sums(loud, at) / some,
        _sums((ends - starts) == 1, at) / some,
        _sums((ends - starts) > 14, at) / some,
    ]
    # lines that another line of the text repeats
    breaks = data == 10
    line_starts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(breaks) + 1])) if n else np.zeros(0, np.int64)
    line_starts = line_starts[line_starts < len(data)]
    line_rows = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.concatenate([line_starts[1:], [len(data)]]) if len(line_starts) else line_starts
    lines = np.unique((line_rows.astype(U64) << U64(40)) | (word_hashes(data, line_starts, line_ends) >> U64(24)))
    each = np.diff(np.searchsorted(line_rows, np.arange(n + 1)))
    columns.append(np.diff(np.searchsorted(lines, np.arange(n + 1, dtype=U64) << U64(40))) / np.maximum(each, 1))
    return np.stack(columns, 1)


class Ranker:
    """Cut points of the features, weights of the steps, threshold."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, steps: int = STEPS, ridge: float = RIDGE, seed: int = 0):
        self.weights, self.threshold = np.zeros(0), 0.0
        self.cuts = [np.unique(np.quantile(c, np.arange(1, steps) / steps)) for c in x.T] if len(x) else []
        up, down = np.flatnonzero(good), np.flatnonzero(~good)
        if not len(up) or not len(down):
            return
        z = self.stepped(x)
        rng = np.random.default_rng(seed)
        # every good document and every bad one is in pairs
        wins = np.concatenate([np.repeat(up, pairs), rng.choice(up, pairs * len(down))])
        losses = np.concatenate([rng.choice(down, pairs * len(up)), np.repeat(down, pairs)])
        d = z[wins] - z[losses]
        w = np.zeros(d.shape[1])
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            h = ((d * (p * (1 - p)).astype(np.float32)[:, None]).T @ d).astype(np.float64) + ridge * np.eye(len(w))
            step = np.linalg.solve(h, d.T @ (1 - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-4:
                break
        self.weights = w
        strength = z @ w
        self.threshold = float(np.quantile(strength, (~good).mean()))
        # the middle of the gap there, if there is one: a threshold on a training document would be arbitrary
        below, above = strength[strength <= self.threshold], strength[strength > self.threshold]
        if len(below) and len(above):
            self.threshold = float(below.max() + above.min()) / 2

    def stepped(self, x: np.ndarray) -> np.ndarray:
        """0/1 columns: feature above cut."""
        return np.concatenate([(x[:, i, None] > c[None, :]).astype(np.float32) for i, c in enumerate(self.cuts)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.stepped(x) @ self.weights - self.threshold, -500, 500)))


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Fits on the features of at most sample labelled documents that are not held out; only their features pass the driver."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    known = known.orderBy(uniform52(F.col("id").cast("string")), "id").limit(sample)  # bounded, so that it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            x = features(*texts(batch["text"]))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], ["id", "label", "x"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"))), "id")
    rows = sorted(own.mapInArrow(run, "id long, label int, x array<double>").collect())
    x = np.array([r["x"] for r in rows]) if rows else np.zeros((0, 0))
    return Ranker(x, np.array([r["label"] == 1 for r in rows], bool))


def _scored(df: DataFrame, ranker: Ranker) -> DataFrame:
    """df, which has its texts as __text, with __score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text", 1 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranker.scores(features(*texts(batch["__text"]))))], [*batch.schema.names, "__score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("__score", T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) of every document, one pass without a shuffle."""
    ranker = fit(docs, labels, sample, id_col, text_col, label_col)
    out = _scored(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), ranker)
    return out.select(F.col("__id").alias(id_col), held_out("__id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents with a score of 0.5 or more, all columns as they were."""
    ranker = fit(docs, labels, sample, id_col, text_col, label_col)
    out = _scored(docs.withColumn("__text", F.col(text_col)), ranker)
    return out.filter("__score >= 0.5").select(*docs.columns)
