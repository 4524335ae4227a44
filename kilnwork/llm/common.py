"""What the operators share: durable tables, Arrow texts as byte arrays, vectorised word hashes."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random 64-bit value for each byte; LOWER gives A-Z the values of a-z.
BYTES = np.random.default_rng(20240611).integers(1, 2**63, 256, np.uint64) * U64(2) + U64(1)
LOWER = BYTES.copy()
LOWER[65:91] = BYTES[97:123]
ODD = U64(0x9E3779B97F4A7C15)
#: Longest words that are hashed by the polynomial.
LONG = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; where none is set, a temporary one, and only for a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='kilnwork-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and outlives executors. The shuffle files of
    the write go when it ends."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/kilnwork-{name}-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kilnwork_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Empties tables that written() made and nothing will read again."""
    for t in tables:
        t.limit(0).write.mode("overwrite").parquet(t._kilnwork_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of two numbers that may be broadcast (about 20 MB), once they are counted; beyond, tables are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few enough of its (counted) rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sized(df: DataFrame, rows: int, per: int = 100_000) -> DataFrame:
    """df, of narrow rows just shuffled, in as few partitions as so many rows need."""
    return df.coalesce(max(1, min(partitions(df.sparkSession), -(-rows // per))))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column (null: empty) and the rows' offsets in them."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most so many bytes of text (one row at least): bounds the memory of what follows."""
    for batch in batches:
        size = np.cumsum(np.diff(texts(batch[column])[1]))
        start = 0
        while start < len(size):
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), on uint64."""
    x = x ^ (x >> U64(32))
    for _ in range(2):
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
    return x


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = U64(pow(int(ODD), -1, 1 << 64))
_TABLES: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse modulo 2**64, n of each at least."""
    if len(_TABLES.get("up", ())) < n:
        n = max(n, 1 << 21)
        _TABLES.update(up=_powers(n, ODD), down=_powers(n, _INVERSE))
    return _TABLES["up"], _TABLES["down"]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (in bytes) and rows of the words [^\\x20\\x09-\\x0D]+; no word crosses a row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """64-bit hashes of the words: prefix sums of a polynomial over random byte values for those of up to LONG bytes. For longer ones,
    among which words can be built whose polynomials are equal modulo 2**64, a digest of the bytes (of lower case as the table is)."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    out = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        raw = data[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw.lower() if table is LOWER else raw, digest_size=8).digest(), "little")
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(words) - n + 1, U64)
    for i in range(n):
        out = out * ODD + words[i : len(words) - n + 1 + i]
    return mixed(out)
