"""Document fingerprints from closed syncmers.

A k-mer of the UTF-8 bytes is chosen when its smallest s-mer (by hash) is its first or its last one. The
choice depends on the k-mer alone, so equal passages give equal anchors wherever they stand.

Defined cases: a null text counts as empty; an empty text has the fingerprint "" ; a text in which no
k-mer is chosen, as one shorter than k bytes, is one anchor at 0; repeated rows each get a row; null ids come last in the order; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, U64, mixed, partitions, pieces, texts

K, S, SIZE = 12, 4, 128
_STEP = 1 << 20


def anchors_of(data: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, byte positions in data and 64-bit hashes of the closed syncmers of each row; windows of _STEP bytes bound the memory."""
    width, rows, places, hashes = k - S + 1, [], [], []
    for at in range(0, max(0, len(data) - k + 1), _STEP):
        v = data[at : at + _STEP + k - 1].astype(U64)
        for i in (1, 2):  # S bytes in a word
            v = v[:-i] | v[i:] << U64(8 * i)
        v = mixed(v)
        low, span = v, 1
        while span < width:
            step = min(span, width - span)
            low, span = np.minimum(low[:-step], low[step:]), span + step
        n = len(low)
        chosen = np.flatnonzero((low == v[:n]) | (low == v[width - 1 : width - 1 + n]))
        row = np.searchsorted(offsets, chosen + at, "right") - 1
        inside = chosen + at + k <= offsets[row + 1]
        chosen, row = chosen[inside], row[inside]
        whole = v[chosen]
        for i in (*range(S, k - S, S), k - S):
            whole = whole * ODD + v[chosen + i]
        rows.append(row)
        places.append(chosen + at)
        hashes.append(mixed(whole))
    size = np.diff(offsets)
    found = np.zeros(len(size), bool)
    if rows:
        found[np.concatenate(rows)] = True
    for row in np.flatnonzero((size > 0) & ~found):
        rows.append(np.array([row]))
        places.append(offsets[row : row + 1])
        hashes.append(np.frombuffer(hashlib.blake2b(data[offsets[row] : offsets[row + 1]].tobytes(), digest_size=8).digest(), U64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)


def sketches(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """For each row the smallest distinct 32-bit anchor hashes, ascending."""
    rows, _, hashes = anchors_of(data, offsets)
    keys = np.unique(rows.astype(U64) << U64(32) | hashes >> U64(32))
    ends = np.searchsorted(keys, np.arange(len(offsets), dtype=U64) << U64(32))
    low = (keys & U64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a : min(b, a + size)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of the anchor sets: exact while both have fewer than size anchors. Two empty texts: 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:size]
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).mean())


def hexed(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def _encoded(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode() for x in values]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def anchors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, positions array<long> in bytes, hashes array<long>) of every text, in order of position: for positional matching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets = texts(batch["text"])
            rows, places, hashes = anchors_of(data, offsets)
            order = np.lexsort((places, rows))
            rows, places, hashes = rows[order], places[order] - offsets[rows[order]], hashes[order].view(np.int64)
            ends = pa.array(np.searchsorted(rows, np.arange(len(offsets))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(ends, pa.array(places)), pa.ListArray.from_arrays(ends, pa.array(hashes))], ["id", "positions", "hashes"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, positions array<long>, hashes array<long>")
    return out.withColumnRenamed("id", id_col)


def _dealt(df: DataFrame) -> DataFrame:
    """The rows (id, text) dealt to one partition for each range of ids, descending, each partition with a guest
    at its end: the row that follows its last one. Only cut points and one id a partition pass the driver."""
    spark, n = df.sparkSession, partitions(df.sparkSession)
    key = F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))
    df = df.withColumn("key", -key)
    cuts = df.select(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("x")).first()["x"] or []
    cuts = sorted({c for c in cuts if np.isfinite(c)})
    if cuts:
        df = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="key", outputCol="part").transform(df).withColumn("part", F.col("part").cast("int"))
    else:
        df = df.withColumn("part", F.lit(0))
    firsts = sorted((r["part"], r["first"]) for r in df.groupBy("part").agg(F.min("key").alias("first")).collect())
    guests = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]  # the first row of a range also closes the range before it; the very first closes the last
    table = F.broadcast(spark.createDataFrame(guests, "key double, host int"))
    df = df.join(table, "key", "left").withColumn("to", F.explode(F.when(F.col("host").isNull(), F.array(F.struct(F.col("part"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("part"), F.lit(True).alias("guest"))))))
    df = df.select("id", "text", "key", "to.part", "to.guest", F.xxhash64("text").alias("tie"))
    return df.repartitionById(max(n, len(cuts) + 1), F.col("part")).sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), "tie", "text")


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every whole text and of its edited text, whose last floor(n / 2) code points are replaced by the
    first as many (or all) of the next text in descending order of id; likeness of the text to the edited and to the next text.

    Texts are shuffled once, in ranges of ids, and streamed; repeated ids follow each other in order of a hash of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in pieces(batches, "text"):
            own = [x or "" for x in batch["text"].to_pylist()]
            found = sketches(*_encoded(own))
            rows = list(zip(batch["id"].to_pylist(), own, batch["guest"].to_pylist(), found, strict=True))
            if last is not None:
                rows.insert(0, last)
            edits, pairs = [], []
            for now, after in zip(rows[:-1], rows[1:], strict=True):
                if not now[2]:
                    half = len(now[1]) // 2
                    edits.append(now[1][: len(now[1]) - half] + after[1][:half])
                    pairs.append((now, after))
            last = rows[-1]
            changed = sketches(*_encoded(edits))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": pa.array([a[0] for a, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()),
                    "fingerprint": pa.array([hexed(a[3]) for a, _ in pairs], pa.string()),
                    "edited_fingerprint": pa.array([hexed(x) for x in changed], pa.string()),
                    "near_edited": pa.array([likeness(a[3], x) for (a, _), x in zip(pairs, changed, strict=True)], pa.float64()),
                    "near_next": pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                }
            )

    rows = _dealt(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    return rows.select("id", "text", "guest").mapInArrow(run, _OUT).withColumnRenamed("id", id_col)
