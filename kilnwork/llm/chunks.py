"""Texts in chunks, and the windows (of words or of bytes) that may recur: what both substring operators ask first.

Texts are held in chunks of about CHUNK bytes, compressed, in one table. A window's anchor is its gram with the smallest
hash; equal windows have equal anchors. Anchors are exchanged once between the chunks and shards of the hash space, 32 bits
each, one or two entries a chunk, and those that occur in one document only rule their windows out. Hashes only rule out
here: two grams with one hash leave a window open that could have been closed, and the operators decide on exact text.

Documents with the text of a smaller id take no part: all their windows start earlier. A document lies in one chunk, so a
task holds some 100 times the bytes of its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTES, U64, mixed, partitions, power_tables, word_hashes, word_spans, written
from .lattice import _runs as runs

CHUNK = 1 << 20
#: Takes the place of a null id in comparisons: null ids count as the largest, and as equal to this one.
NULL_ID = 2**63 - 1


@dataclass(frozen=True)
class Kind:
    """Units, units a window, units a gram."""

    words: bool
    window: int
    gram: int


class Chunk:
    """The documents of a chunk and their units. Hashes are made when they are asked for."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, data: np.ndarray, offsets: np.ndarray, kind: Kind):
        self.ids, self.null, self.data, self.offsets, self.kind = ids, null, data, offsets, kind
        if kind.words:
            self.starts, self.ends, rows = word_spans(data, offsets)
            self.bounds = np.searchsorted(rows, np.arange(len(offsets)))
            self.size = len(self.starts)
        else:
            self.bounds, self.size = offsets, len(data)

    @cached_property
    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        units = word_hashes(self.data, self.starts, self.ends) if self.kind.words else BYTES[self.data]
        up, down = power_tables(len(units) + 1)
        total = np.zeros(len(units) + 1, U64)
        np.cumsum(units * up[: len(units)], out=total[1:])
        return total, down

    def hashes(self, n: int) -> np.ndarray:
        """64-bit hashes of all runs of n units, those across documents too; only fit to rule out."""
        count = max(0, self.size - n + 1)
        if not count:
            return np.zeros(0, U64)
        total, down = self._sums
        out = (total[n:] - total[:-n])[:count]
        out *= down[:count]
        out += U64(n)
        return mixed(out)

    def inside(self, skip: np.ndarray) -> np.ndarray:
        """Whether each window lies in one document, and that one is not to be skipped."""
        w = self.kind.window
        out = np.zeros(max(0, self.size - w + 1), bool)
        for i in np.flatnonzero(~skip).tolist():
            a, b = int(self.bounds[i]), int(self.bounds[i + 1])
            if b - a >= w:
                out[a : b - w + 1] = True
        return out

    def anchors(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of windows of one anchor begin that are all inside or all not, and the hash of each run's anchor. Between windows
        inside two documents there are some that are not inside, so a run is in one document."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, U64)
        least = slid(np.minimum, self.hashes(self.kind.gram), self.kind.window - self.kind.gram + 1)
        new = np.ones(len(inside), bool)
        new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        heads = np.flatnonzero(new)
        return heads, least[heads]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, "right") - 1

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=self.null)


def slid(best: np.ufunc, x: np.ndarray, k: int) -> np.ndarray:
    """best over each k neighbours."""
    span, spare = 1, [np.empty(len(x), x.dtype) for _ in range(2)]
    while span < k:
        step = min(span, k - span)
        x, span = best(x[:-step], x[step:], out=spare[0][: max(0, len(x) - step)]), span + step
        spare.reverse()
    return x


def covered(places: np.ndarray, width: int, size: int) -> np.ndarray:
    """Whether each of size units is in one of the windows of so many units that start at places."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + width, -1)
    return np.cumsum(edges[:-1]) > 0


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all first bytes first: what is zero or alike then compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(U64).reshape(-1)


_PACKER, _UNPACKER = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeezed(raw: bytes) -> bytes:
    return _PACKER.compress(raw)


def expanded(raw: bytes) -> bytes:
    return _UNPACKER.decompress(raw)


def bits(flags: np.ndarray) -> bytes:
    return squeezed(np.packbits(flags).tobytes())


def unbits(raw: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(expanded(raw), np.uint8), count=count).astype(bool)


def _chunked(df: DataFrame, size: int) -> DataFrame:
    """(chunk, ids, digests, packed) of (id, text), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, part, n = zstandard.ZstdCompressor(level=4), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []

        def flushed() -> pa.RecordBatch:
            ids = np.array([NULL_ID if i is None else i for i, _ in held], np.int64)
            null = np.array([i is None for i, _ in held], np.uint8)
            sizes = np.array([len(x) for _, x in held], np.int64)
            digests = b"".join(hashlib.blake2b(x, digest_size=16).digest() for _, x in held)
            packed = packer.compress(sizes.tobytes() + b"".join(x for _, x in held))
            columns = {"chunk": pa.array([(part << 32) + n], pa.int64()), "ids": [ids.tobytes() + null.tobytes()], "digests": [digests], "packed": [packed]}
            return pa.RecordBatch.from_pydict(columns)

        total = 0
        for batch in batches:
            for i, x in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                raw = (x or "").encode()
                if held and total + len(raw) > size:
                    yield flushed()
                    held, total, n = [], 0, n + 1
                held.append((i, raw))
                total += len(raw) + 8
        if held:
            yield flushed()

    return written(df.mapInArrow(run, "chunk long, ids binary, digests binary, packed binary"), "chunks")


def opened(ids: bytes, packed: bytes, kind: Kind) -> Chunk:
    n = len(ids) // 9
    raw = np.frombuffer(expanded(packed), np.uint8)
    sizes = raw[: 8 * n].view(np.int64)
    null = np.frombuffer(ids, np.uint8)[8 * n :].astype(bool)
    return Chunk(np.frombuffer(ids, np.int64, n), null, raw[8 * n :], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), kind)


def _copies(chunks: DataFrame) -> DataFrame:
    """(chunk, role, payload): places of the documents whose text a smaller id has. Texts are told apart by 128-bit digests."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, digests in zip(*(batch[c].to_pylist() for c in ("chunk", "ids", "digests")), strict=True):
                own = np.frombuffer(ids, np.int64, len(ids) // 9)
                digest = pa.array([digests[i : i + 16] for i in range(0, len(digests), 16)], pa.binary())
                columns = [pa.array(np.full(len(own), chunk)), pa.array(np.arange(len(own))), pa.array(own), digest]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "place", "id", "digest"])

    rows = chunks.select("chunk", "ids", "digests").mapInArrow(spread, "chunk long, place long, id long, digest binary")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(written(first, "copied"), "digest").filter("id > first").groupBy("chunk")
    payload = F.array_join(F.collect_list(F.col("place").cast("string")), ",").cast("binary")
    return rows.agg(payload.alias("payload")).select("chunk", F.lit(1).alias("role"), "payload")


def with_chunks(chunks: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """Rows (chunk, role, ids, payload), those of a chunk together, its texts (role 0) first."""
    rows = chunks.select("chunk", F.lit(0).alias("role"), "ids", F.col("packed").alias("payload"))
    for reply in replies:
        rows = rows.unionByName(reply.select("chunk", "role", F.lit(None).cast("binary").alias("ids"), "payload"))
    return rows.repartition(partitions(chunks.sparkSession), "chunk").sortWithinPartitions("chunk", "role")


def by_chunk(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[tuple[int, Chunk, np.ndarray, dict[int, list[bytes]]]]:
    """(chunk's number, chunk, documents to skip, payloads by role)."""

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                yield batch.slice(i, 64)

    for group in runs(small(batches), ["chunk"]):
        found: dict[int, list[bytes]] = {}
        for role, payload in zip(group["role"].to_pylist(), group["payload"].to_pylist(), strict=True):
            found.setdefault(role, []).append(payload)
        chunk = opened(group["ids"][0].as_py(), found.pop(0)[0], kind)
        skip = np.zeros(len(chunk.ids), bool)
        for payload in found.pop(1, []):
            skip[[int(x) for x in payload.split(b",")]] = True
        yield group["chunk"][0].as_py(), chunk, skip, found


def dealt(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted hashes the shards by their upper bits that occur, and where each of them begins, with the end: work by hash, not by shard."""
    full, cuts = begins(hashes >> U64(65 - shards.bit_length()) if shards > 1 else np.zeros(len(hashes), U64))
    return full.astype(np.int64), cuts


def begins(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values the distinct ones, and where each begins, with the end."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(new)
    return values[at], np.append(at, len(values))


def stable(x: np.ndarray) -> np.ndarray:
    """The stable order of numbers: places are sorted with them, in one plain sort where both fit into 64 bits, else in two, by the lower
    bits, then by the upper ones."""
    n = int(len(x)).bit_length()
    low, mask = U64(n), U64((1 << n) - 1)
    places = np.arange(len(x), dtype=U64)
    if not len(x) or n > 32:
        return np.argsort(x, kind="stable")
    x = x - x.min()
    by = (np.sort(x << low | places) & mask).astype(np.int64)  # the shift leaves the lower bits alone
    if int(x.max()).bit_length() + n > 64:
        by = by[(np.sort((x >> U64(64 - n))[by] << low | places) & mask).astype(np.int64)]
    return by


def place_of(full: np.ndarray, number: int) -> int:
    """The place of a shard among those that occur."""
    i = int(np.searchsorted(full, number))
    if i == len(full) or full[i] != number:
        raise ValueError(f"an answer from shard {number}, to which nothing was sent")
    return i


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, chunk, payload), those of a shard together."""
    return rows.repartition(min(shards, 4 * partitions(rows.sparkSession)), "shard").sortWithinPartitions("shard").select("shard", "chunk", "payload")


def packets(number: int, shards: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(shards, pa.int32()), pa.array([number] * len(shards), pa.int64()), pa.array(payloads, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["shard", "chunk", "payload"])


def replies(role: int, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([c for c, _ in found], pa.int64()), pa.array([role] * len(found), pa.int32()), pa.array([x for _, x in found], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "role", "payload"])


PACKETS, REPLIES = "shard int, chunk long, payload binary", "chunk long, role int, payload binary"


def _anchors(chunks: DataFrame, kind: Kind, shards: int) -> DataFrame:
    """Packets: 32 bits of each anchor of a chunk below the shard's; twice if two of its documents have it."""
    low = U64(64 - (shards.bit_length() - 1) - 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, packed in zip(*(batch[c].to_pylist() for c in ("chunk", "ids", "packed")), strict=True):
                chunk = opened(ids, packed, kind)
                inside = chunk.inside(np.zeros(len(chunk.ids), bool))
                at, values = chunk.anchors(inside)
                own = inside[at]
                at, values = at[own], values[own] >> low
                order = stable(values)  # documents of equal anchors stay in order
                values, owner = values[order], chunk.document(at)[order]
                if len(at):
                    own, starts = begins(values)
                    values = np.repeat(own, 1 + (owner[starts[:-1]] != owner[starts[1:] - 1]))
                full, cuts = dealt(values << low, shards)
                yield packets(number, full.tolist(), [values[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    return chunks.select("chunk", "ids", "packed").mapInArrow(run, PACKETS)


def _recurring(anchors: DataFrame, shards: int) -> DataFrame:
    """Replies of role 2: shard number and the anchors of the chunk that occur in two documents at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard"]):
            number, chunk = group["shard"][0].as_py(), group["chunk"].to_pylist()
            parts = [np.frombuffer(x, np.uint32) for x in group["payload"].to_pylist()]
            every = np.sort(np.concatenate(parts))
            again = np.unique(every[1:][every[1:] == every[:-1]])
            found = []
            for c, part in zip(chunk, parts, strict=True) if len(again) else ():
                part = begins(part)[0]
                part = part[again[np.minimum(np.searchsorted(again, part), len(again) - 1)] == part]
                if len(part):
                    found.append((c, np.int32(number).tobytes() + part.tobytes()))
            yield replies(2, found)

    return by_shard(anchors, shards).mapInArrow(run, REPLIES)


def _open(chunk: Chunk, skip: np.ndarray, recurring: list[bytes], shards: int) -> np.ndarray:
    """Whether each window of the chunk has a recurring anchor."""
    low, inside = U64(64 - (shards.bit_length() - 1) - 32), chunk.inside(skip)
    if not recurring or not len(inside):
        return np.zeros(len(inside), bool)
    heads, value = chunk.anchors(inside)
    known = np.sort(np.concatenate([(U64(np.frombuffer(x[:4], np.int32)[0]) << U64(32)) | np.frombuffer(x[4:], np.uint32).astype(U64) for x in recurring]))
    value >>= low
    again = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
    return inside & np.repeat(again, np.diff(heads, append=len(inside)))


@dataclass
class Store:
    """The chunks; replies of role 1, copies, and of role 2, a bit for each window that may recur; the number of shards."""

    chunks: DataFrame
    copies: DataFrame
    open: DataFrame
    shards: int


def shards_for(chunks: int, partitions: int, per: int) -> int:
    return 1 << max(4, int(np.ceil(np.log2(max(partitions, min(chunks / 8, 4 * partitions), chunks / per, 1)))))


def stored(df: DataFrame, kind: Kind, size: int = CHUNK, per: int = 8) -> Store:
    """The texts of df (id, text) in chunks, with their copies and open windows. A shard for each 8 chunks; where these are more than the
    partitions of by_shard, for each `per`: a chunk sends a packet to each shard, so more of them make more packets, fewer larger shards."""
    chunks = _chunked(df, size)
    shards = shards_for(chunks.count(), partitions(df.sparkSession), per)
    copies = written(_copies(chunks), "copies")
    recurring = written(_recurring(_anchors(chunks, kind, shards), shards), "recurring")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, skip, found in by_chunk(batches, kind):
            flags = _open(chunk, skip, found.get(2, []), shards)
            yield replies(2, [(number, bits(flags))] if flags.any() else [])

    return Store(chunks, copies, written(with_chunks(chunks, [copies, recurring]).mapInArrow(run, REPLIES), "open"), shards)
