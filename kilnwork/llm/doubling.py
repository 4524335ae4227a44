"""Exact substring dedup by distributed prefix doubling.

The rank of a position at length n + o comes from its ranks at length n there and o bytes on. At 8 bytes the rank is the
bytes themselves, as a number; offsets then grow (8, 16, ... and what is left to the threshold: 18 for 50 bytes). In each
round the chunks of texts send (rank, rank at the offset) pairs to the ranges of ranks, Spark shuffles them, each range is sorted
and ranked densely, and the new ranks go back to the positions. A pair that occurs in one document only has no rank: its
position, and every window that needs it, is done. Past the threshold a pair learns the smallest id it starts in.

Pairs are compared as they are, so the result is exact; hashes only rule windows out beforehand (see chunks) and bring equal pairs
together, where different ones of one hash are sorted: ranks ascend with the first half, then by a hash of the second. A chunk sends a pair once, however often it holds it, so a passage in very many documents costs a range one
entry a chunk. The first round's ranges are cut at sampled pairs, so that a frequent first half is cut inside. The sample and the ranges
have a fixed bound; beyond it each range is cut further by a hash of the second half: equal pairs still meet, and the cuts do not
change the result. A chunk's work goes by the ranges it has pairs in, not by all there are.

Defined cases: null and empty texts have no bytes; texts under 50 bytes lose nothing; documents with the text of a smaller id
lose all bytes if they have 50; rows with equal ids do not remove from each other; null ids count as the largest (and
as equal to 2**63 - 1); ties have no order to keep; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import (
    CHUNK,
    PACKETS,
    REPLIES,
    Chunk,
    Kind,
    Store,
    begins,
    bits,
    by_chunk,
    by_shard,
    covered,
    expanded,
    opened,
    packets,
    place_of,
    replies,
    runs,
    squeezed,
    stored,
    unbits,
    with_chunks,
)
from .chunks import stable as _stable
from .common import ODD, U64, dropped, mixed, written

LENGTH, GRAM, SEED = 50, 26, 8
#: A rank is (range + 1) << LOCAL, plus its place in the range; pairs sampled for each range to find its ends.
LOCAL, SAMPLES = 32, 40
#: Ranges that are cut by the sample, at most: what is sampled, sorted on the driver and sent to tasks does not grow with the data.
RANGES = 1 << 12
#: Parts in which the ranges of the first round are sent, one after the other: its pairs are the bulk of what is shuffled.
PARTS = 2


def steps(length: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """Of each round the length it starts from, its offset, and where, from a window's start on, its new ranks are needed."""
    if length < 2 * SEED:
        raise ValueError(f"length must be {2 * SEED} at least")
    rounds, n = [], SEED
    while n < length:
        rounds.append((n, min(n, length - n)))
        n += rounds[-1][1]
    out, needed = [], {0}
    for n, o in reversed(rounds):
        out.append((n, o, tuple(sorted(needed))))
        needed |= {s + o for s in needed}
    return out[::-1]


def _shifted(windows: np.ndarray, shifts: tuple[int, ...]) -> np.ndarray:
    """Positions that are so far from one of the windows' starts."""
    out = np.zeros(len(windows), bool)
    for s in shifts:
        out[s:] |= windows[: len(windows) - s]
    return np.flatnonzero(out)


def _values(data: np.ndarray) -> np.ndarray:
    """The SEED bytes at each position as a number, the first one highest; 0 where fewer are left."""
    raw = np.zeros(len(data) + SEED - 1, np.uint8)
    raw[: len(data)] = data
    return np.ndarray(len(data), ">u8", raw, 0, (1,)).astype(U64)


def _slim(x: np.ndarray) -> bytes:
    """64-bit numbers by planes, only as many bytes of each as the largest has, after the number of these."""
    w = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([w]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes()


def _full(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n numbers that _slim wrote at a place, and the place behind them."""
    w = raw[at]
    x = np.zeros((n, 8), np.uint8)
    x[:, :w] = np.frombuffer(raw, np.uint8, w * n, at + 1).reshape(w, n).T
    return x.view(U64).reshape(-1), at + 1 + w * n


def _steps(x: np.ndarray) -> np.ndarray:
    """The differences of numbers below 2**63, small ones of either sign as small numbers."""
    d = x.astype(np.int64)
    d[1:] -= x[:-1].view(np.int64)
    return (d << 1 ^ d >> 63).view(U64)


def _summed(d: np.ndarray) -> np.ndarray:
    """The numbers that have these _steps."""
    return np.cumsum((d >> U64(1)).view(np.int64) ^ -(d & U64(1)).view(np.int64)).view(U64)


@dataclass
class Ranked:
    """The documents of a chunk, the windows that are still open, and ranks by position."""

    ids: np.ndarray
    offsets: np.ndarray
    windows: np.ndarray
    ranks: np.ndarray

    def packed(self, shifts: tuple[int, ...]) -> bytes:
        own = self.ranks[_shifted(self.windows, shifts)]
        flags = np.packbits(self.windows).tobytes()
        head = np.array([len(self.offsets), len(self.windows)], np.int64).tobytes()
        return squeezed(head + self.offsets.tobytes() + flags + _slim(own & U64((1 << LOCAL) - 1)) + _slim(own >> U64(LOCAL)))

    def owners(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in order, and of ascending positions the place of their document's id there."""
        ids, place = np.unique(self.ids, return_inverse=True)
        return ids, np.repeat(place, np.diff(np.searchsorted(places, self.offsets)))


def _reopened(ids: bytes, packed: bytes, shifts: tuple[int, ...]) -> Ranked:
    raw = expanded(packed)
    n, size = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    offsets, at = np.frombuffer(raw, np.int64, n, 16), 16 + 8 * n
    windows = np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at), count=size).astype(bool)
    q, ranks = _shifted(windows, shifts), np.zeros(size, U64)
    low, at = _full(raw, at + -(-size // 8), len(q))
    ranks[q] = low | _full(raw, at, len(q))[0] << U64(LOCAL)
    return Ranked(np.frombuffer(ids, np.int64, len(ids) // 9), offsets, windows, ranks)


def _started(chunk: Chunk, flags: bytes) -> Ranked:
    windows = np.zeros(len(chunk.data), bool)
    inside = max(0, len(chunk.data) - chunk.kind.window + 1)
    windows[:inside] = unbits(flags, inside)
    return Ranked(chunk.ids, chunk.offsets, windows, _values(chunk.data))


@dataclass
class Entries:
    """The distinct pairs of a chunk by (range, first rank): how many, the ranges that occur and where each begins, with the end. What is
    not asked for is None: for those who send, the pairs and of each the smallest id or whether two documents have it; for those who
    get answers, positions, the entry of each, and the smallest ids. Ids are places in ids, which ascend; owner is that of each position."""

    size: int
    full: np.ndarray
    cuts: np.ndarray
    a: np.ndarray | None = None
    b: np.ndarray | None = None
    least: np.ndarray | None = None
    several: np.ndarray | None = None
    ids: np.ndarray | None = None
    owner: np.ndarray | None = None
    places: np.ndarray | None = None
    entry: np.ndarray | None = None

    @cached_property
    def gaps(self) -> np.ndarray:
        """Of each first rank the difference to that before it in its range."""
        out = np.zeros(self.size, U64)
        np.subtract(self.a[1:], self.a[:-1], out=out[1:])
        out[self.cuts[:-1]] = 0
        return out


def _entries(own: Ranked, offset: int, shifts: tuple[int, ...], ends: list[tuple[int, int]] | None, shards: int, last: bool, part: int | None = None, parts: int = 1) -> Entries:
    """ends: the pairs at which ranges end, in the first round; later (None), the ranges are those of the first ranks. part: for those who
    send, the remainder by parts of the ranges that are sent; what is left of other ranges is in the order it has among all."""
    q = _shifted(own.windows, shifts)
    a, b, low = own.ranks[q], own.ranks[q + offset], int(len(q)).bit_length()
    ids, owner = own.owners(q) if part is not None or last else (None, None)
    if part is not None and parts > 1:
        some = np.flatnonzero(_maybe(a, b, ends, shards, part, parts))
        a, b, owner = a[some], b[some], owner[some]
    by = None
    if ends is None and (keys := _ranked_keys(a, b, low)) is not None:
        order, x, y, new = _grouped(keys, low, a, b)
        heads = np.flatnonzero(new)
        x, y = x[heads], y[heads]
    else:
        order, x, y, new = _grouped(mixed(a * ODD + b) >> U64(low) << U64(low) | np.arange(len(a), dtype=U64), low, a, b)
        heads = np.flatnonzero(new)
        x, y = x[heads], y[heads]
        by = _stable(x)
    if ends is not None:
        by, number = _cut(x, y, by, ends, shards)
    else:
        number = ((x if by is None else x[by]) >> U64(LOCAL)) - U64(1)
    full, cuts = begins(number)
    out, entry = Entries(len(x), full.astype(np.int64), cuts, ids=ids), np.cumsum(new) - 1
    if owner is not None:
        held, more = owner[order], np.flatnonzero(~new)
        if last:
            out.least = held[heads]
            np.minimum.at(out.least, entry[more], held[more])
            out.least = out.least if by is None else out.least[by]
        else:
            out.several = np.zeros(len(x), bool)
            out.several[entry[more[held[more] != held[more - 1]]]] = True
            out.several = out.several if by is None else out.several[by]
    if part is not None:
        out.a, out.b = (x, y) if by is None else (x[by], y[by])
        return out
    if by is not None:
        place = np.empty(len(x), np.int64)
        place[by] = np.arange(len(x))
        entry = place[entry]
    out.places, out.owner, out.entry = q, owner, np.empty(len(q), np.int64)
    out.entry[order] = entry
    return out


def _grouped(keys: np.ndarray, low: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of pairs by keys, which are alike above the lower bits for equal pairs and have the place in these; the pairs in this order;
    and whether each is another one than that before it. Equal pairs are neighbours: different ones of one key are sorted."""
    keys = np.sort(keys)
    order = (keys & U64((1 << low) - 1)).astype(np.int64)
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    same = (keys[1:] ^ keys[:-1]) >> U64(low) == 0
    if (clash := new[1:] & same).any():
        group = np.concatenate([[0], np.cumsum(~same)])
        at = np.flatnonzero(np.isin(group, group[1:][clash]))
        order[at] = order[at][np.lexsort((y[at], x[at], group[at]))]
        x, y = a[order], b[order]
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return order, x, y, new


def _ranked_keys(a: np.ndarray, b: np.ndarray, low: int) -> np.ndarray | None:
    """Keys for _grouped, in the order of the first ranks: these without the bits that none has, a hash of the second, the place. None if
    too few bits are left for the hash."""
    if not len(a):
        return a
    local, high = a & U64((1 << LOCAL) - 1), a >> U64(LOCAL)
    high -= high.min()
    inner = int(local.max()).bit_length()
    width = inner + int(high.max()).bit_length()
    if width + low > 52:
        return None
    return _keys(high << U64(inner) | local, width, b, low, np.arange(len(a), dtype=U64))


def _keys(first: np.ndarray, width: int, b: np.ndarray, low: int, places: np.ndarray) -> np.ndarray:
    """first, below 2**width, as upper bits, places as the low lower ones, and as much of a hash of b as fits between."""
    keys = (mixed(b) >> U64(width + low)) << U64(low) | places
    return first << U64(64 - width) | keys if width else keys


def _maybe(a: np.ndarray, b: np.ndarray, ends: list[tuple[int, int]] | None, shards: int, part: int, parts: int) -> np.ndarray:
    """Whether a pair may be in a range of the part: for certain, but where a first half has several ranges."""
    if (inside := shards // RANGES) > 1:
        return (mixed(b) & U64(inside - 1)) % U64(parts) == U64(part)
    if not ends:
        return np.full(len(a), part == 0)
    first = np.array([x for x, _ in ends], U64)
    # where no range ends among the numbers of two first bytes, these tell
    ending = np.bincount((first >> U64(48)).astype(np.int64), minlength=1 << 16)
    known = np.where(ending > 0, 2, (np.cumsum(ending) % parts == part)).astype(np.uint8)
    out = known[(a >> U64(48)).astype(np.int64)]
    at = np.flatnonzero(out == 2)
    number = np.searchsorted(first, a[at])
    out[at] = (number % parts == part) | (first[np.minimum(number, len(first) - 1)] == a[at])
    return out.view(bool)


def _cut(x: np.ndarray, y: np.ndarray, by: np.ndarray, ends: list[tuple[int, int]], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' order by range, then first rank, from their order by first rank; and the range of each."""
    number = np.zeros(len(x), U64)
    if ends:
        first, second = (np.array(v, U64) for v in zip(*ends, strict=True))
        ordered = x[by]
        at, to = np.searchsorted(ordered, first), np.searchsorted(ordered, first, "right")
        for lo, hi in {(int(lo), int(hi)) for lo, hi in zip(at, to, strict=True) if lo < hi}:
            by[lo:hi] = by[lo:hi][np.argsort(y[by[lo:hi]], kind="stable")]
        starts = [int(lo) + int(np.searchsorted(y[by[lo:hi]], s)) for lo, hi, s in zip(at, to, second, strict=True)]
        number = np.repeat(np.arange(len(starts) + 1, dtype=U64), np.diff([0, *starts, len(x)]))
    inside = max(1, shards // RANGES)  # a power of two
    if inside > 1:
        number = number * U64(inside) + (mixed(y[by]) & U64(inside - 1))
        again = _stable(number)
        by, number = by[again], number[again]
    return by, number


def _packed(e: Entries, s: int, last: bool) -> bytes:
    """Of the s-th of the ranges that occur its number of pairs, first ranks as differences, second ranks, and whether two documents have them; in the last round, smallest ids."""
    a, b = int(e.cuts[s]), int(e.cuts[s + 1])
    parts = [np.array([b - a, e.a[a].view(np.int64)], np.int64).tobytes(), _slim(e.gaps[a:b]), _slim(e.b[a:b])]
    if last:
        least, held = e.least[a:b], np.zeros(len(e.ids), bool)
        held[least] = True
        place = np.cumsum(held) - 1
        return squeezed(b"".join([*parts, _slim(place[least].view(U64)), e.ids[held].tobytes()]))
    return squeezed(b"".join([*parts, np.packbits(e.several[a:b]).tobytes()]))


def _unpacked(packed: bytes, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second ranks; in the last round the smallest ids, else whether two documents have them."""
    raw = expanded(packed)
    m = int(np.frombuffer(raw, np.int64, 1)[0])
    a, at = _full(raw, 16, m)
    a = np.cumsum(a, dtype=U64) + np.frombuffer(raw, U64, 1, 8)
    b, at = _full(raw, at, m)
    if last:
        place, at = _full(raw, at, m)
        return a, b, np.frombuffer(raw, np.int64, -1, at)[place.view(np.int64)]
    return a, b, np.unpackbits(np.frombuffer(raw, np.uint8, -1, at), count=m).view(bool)


def _order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the pairs by the first side in which equal ones are neighbours, and whether each is another one than that before it."""
    low, first, places = int(len(a)).bit_length(), a - a.min(), np.arange(len(a), dtype=U64)
    second = b
    if int(first.max()).bit_length() + low > 48:  # the first side is numbered densely, so that a hash of the second fits beside it
        by = _stable(a)
        x, second, places = a[by], b[by], by.astype(U64)
        first = np.cumsum(np.concatenate([[False], x[1:] != x[:-1]])).astype(U64)
    order, _, _, new = _grouped(_keys(first, int(first.max()).bit_length(), second, low, places), low, a, b)
    return order, new


def _sorted(pairs: DataFrame, shards: int, last: bool) -> DataFrame:
    """Replies of role 3: the range's number and, for each entry of the chunk there, its new rank (0: in one document only), or,
    in the last round, whether it starts in a smaller id than the chunk's smallest. A pair of two chunks is one of two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard"]):
            number, chunk = group["shard"][0].as_py(), group["chunk"].to_pylist()
            parts = [_unpacked(x, last) for x in group["payload"].to_pylist()]
            ends = np.cumsum([0, *(len(p[0]) for p in parts)])
            a, b, rest = (np.concatenate([p[i] for p in parts]) for i in range(3))
            del parts
            order, new = _order(a, b)
            rest, out = rest[order], []
            if last:
                heads = np.flatnonzero(new)
                late = np.empty(len(a), bool)
                late[order] = rest > np.repeat(np.minimum.reduceat(rest, heads), np.diff(heads, append=len(a)))
                for c, i, j in zip(chunk, ends[:-1], ends[1:], strict=True):
                    out.append((c, np.int64(number).tobytes() + bits(late[i:j])))
            else:
                again = rest | ~new
                again[:-1] |= ~new[1:]
                rank = np.empty(len(a), np.int64)
                rank[order] = np.cumsum(again & new) * again
                for c, i, j in zip(chunk, ends[:-1], ends[1:], strict=True):
                    own = rank[i:j]
                    held = own > 0
                    if held.any():
                        out.append((c, np.int64(number).tobytes() + squeezed(np.packbits(held).tobytes() + _slim(_steps(own[held])))))
            yield replies(3, out)

    return by_shard(pairs, shards).mapInArrow(run, REPLIES)


def _ranks(e: Entries, found: list[bytes]) -> np.ndarray:
    """The new rank of each position."""
    rank = np.zeros(e.size, U64)
    for x in found:
        s = int(np.frombuffer(x, np.int64, 1)[0])
        p = place_of(e.full, s)
        a, b = int(e.cuts[p]), int(e.cuts[p + 1])
        raw = expanded(x[8:])
        flags = np.unpackbits(np.frombuffer(raw, np.uint8, -(-(b - a) // 8)), count=b - a).view(bool)
        rank[a:b][flags] = _summed(_full(raw, -(-(b - a) // 8), int(np.count_nonzero(flags)))[0]) + (U64(s + 1) << U64(LOCAL))
    return rank[e.entry]


def _late(own: Ranked, e: Entries, found: list[bytes]) -> np.ndarray:
    """Whether each position's window starts in a smaller id."""
    late = np.zeros(e.size, bool)
    for x in found:
        s = place_of(e.full, int(np.frombuffer(x, np.int64, 1)[0]))
        late[int(e.cuts[s]) : int(e.cuts[s + 1])] = unbits(x[8:], int(e.cuts[s + 1] - e.cuts[s]))
    out = np.zeros(len(own.windows), bool)
    out[e.places] = late[e.entry] | (e.owner > e.least[e.entry])
    return out


def _range_ends(chunks: DataFrame, kind: Kind, shards: int) -> list[tuple[int, int]]:
    """Pairs that cut the first round's pairs into ranges of about one size, RANGES at most, from some SAMPLES positions for each."""
    n, shards = chunks.count(), min(shards, RANGES)
    per = -(-SAMPLES * shards // max(1, min(n, 4096)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, packed in zip(batch["ids"].to_pylist(), batch["packed"].to_pylist(), strict=True):
                v = _values(opened(ids, packed, kind).data)
                at = np.arange(0, len(v) - SEED, max(1, len(v) // per))
                yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(v[at + SEED].view(np.int64))], ["a", "b"])

    some = chunks.select("ids", "packed").sample(min(1.0, 4096 / max(1, n)), seed=1)
    sample = sorted((r["a"] % 2**64, r["b"] % 2**64) for r in some.mapInArrow(run, "a long, b long").collect())
    return sorted({sample[len(sample) * i // shards] for i in range(1, shards)}) if sample else []


def _late_windows(store: Store, kind: Kind) -> DataFrame:
    """Replies of role 3: a bit for each byte of the chunk, set where a window starts that starts in a smaller id as well."""
    shards, plan = store.shards, steps(kind.window)
    ends = _range_ends(store.chunks, kind, shards)
    state = None
    for turn, (_, offset, shifts) in enumerate(plan):
        last, cuts = turn + 1 == len(plan), ends if turn == 0 else None
        before, parts = plan[turn - 1][2] if turn else (), PARTS if turn == 0 else 1

        def held(batches: Iterator[pa.RecordBatch], before: tuple[int, ...] = before) -> Iterator[tuple[int, Ranked, list[bytes]]]:
            """(chunk's number, ranks, replies) of rows of texts with open windows, or of states."""
            if not before:
                for number, chunk, _, found in by_chunk(batches, kind):
                    if 2 in found:
                        yield number, _started(chunk, found[2][0]), found.get(3, [])
            else:
                for group in runs(batches, ["chunk"]):
                    ids, payloads = group["ids"].to_pylist(), group["payload"].to_pylist()
                    yield group["chunk"][0].as_py(), _reopened(ids[0], payloads[0], before), payloads[1:]

        def send(part: int, offset: int = offset, shifts: tuple[int, ...] = shifts, cuts: list | None = cuts, held=held, last: bool = last, parts: int = parts) -> Callable:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for number, own, _ in held(batches):
                    e = _entries(own, offset, shifts, cuts, shards, last, part, parts)
                    own_part = [(i, s) for i, s in enumerate(e.full.tolist()) if s % parts == part]
                    yield packets(number, [s for _, s in own_part], [_packed(e, i, last) for i, _ in own_part])

            return run

        def rank(batches: Iterator[pa.RecordBatch], offset: int = offset, shifts: tuple[int, ...] = shifts, cuts: list | None = cuts, held=held) -> Iterator[pa.RecordBatch]:
            for number, own, found in held(batches):
                e = _entries(own, offset, shifts, cuts, shards, False)
                ranks = np.zeros(len(own.ranks), U64)
                ranks[e.places] = _ranks(e, found)
                windows = np.flatnonzero(own.windows)
                for s in shifts:
                    windows = windows[ranks[windows + s] > 0]
                if len(windows):
                    left = np.zeros(len(own.windows), bool)
                    left[windows] = True
                    ids = own.ids.tobytes() + bytes(len(own.ids))
                    packed = Ranked(own.ids, own.offsets, left, ranks).packed(shifts)
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.binary()), pa.array([packed], pa.binary())], ["chunk", "ids", "packed"])

        def end(batches: Iterator[pa.RecordBatch], offset: int = offset, shifts: tuple[int, ...] = shifts, cuts: list | None = cuts, held=held) -> Iterator[pa.RecordBatch]:
            for number, own, found in held(batches):
                late = _late(own, _entries(own, offset, shifts, cuts, shards, True), found)
                yield replies(3, [(number, bits(late))] if late.any() else [])

        rows = with_chunks(store.chunks, [store.open]) if state is None else state.select("chunk", F.lit(0).alias("role"), "ids", F.col("packed").alias("payload"))
        answers = [written(_sorted(rows.mapInArrow(send(i), PACKETS), shards, last), "ranks") for i in range(parts)]
        rows = with_chunks(store.chunks, [store.open, *answers]) if state is None else with_chunks(state, answers)
        after = written(rows.mapInArrow(end, REPLIES), "late") if last else written(rows.mapInArrow(rank, "chunk long, ids binary, packed binary"), "state")
        dropped(*answers, *([state] if state is not None else []))
        state = after
    return state


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), and with spans the removed runs and the bytes that are left."""
    kind = Kind(False, length, gram)
    store = stored(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), kind, chunk)
    late = _late_windows(store, kind)

    def finish(c: Chunk, skip: np.ndarray, flags: list[bytes]) -> pa.RecordBatch:
        gone = covered(np.flatnonzero(unbits(flags[0], c.size)), length, c.size) if flags else np.zeros(c.size, bool)
        rows = []
        for i, (a, b) in enumerate(zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True)):
            own = gone[a:b]
            if skip[i] and b - a >= length:
                own = np.ones(b - a, bool)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            rows.append((b - a, int(own.sum()), len(edges) // 2, c.data[a:b][~own].tobytes(), edges.tolist()))
        columns = {
            "id": c.id_column(),
            **{k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("n_bytes", "n_removed", "n_spans"))},
            "kept_sha256": pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string()),
        }
        if spans:
            columns |= {"span_edges": pa.array([r[4] for r in rows], pa.list_(pa.int64())), "kept_bytes": pa.array([r[3] for r in rows], pa.binary())}
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, skip, found in by_chunk(batches, kind):
            yield finish(c, skip, found.get(3, []))

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", span_edges array<long>, kept_bytes binary" * spans
    return with_chunks(store.chunks, [store.copies, late]).mapInArrow(run, schema).withColumnRenamed("id", id_col)


#: The same for DuckDB, by definition: every 50-byte string, in hexadecimal, with the smallest id it starts in.
SQL = f"""with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) as s from (select doc_id, h, unnest(range(n - {LENGTH - 1})) as i from d where n >= {LENGTH})),
f as (select s, min(doc_id) as least from w group by s having min(doc_id) < max(doc_id)),
late as (select distinct w.doc_id, w.i from w join f using (s) where w.doc_id > f.least),
runs as (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from (select *, (coalesce(i > lag(i) over (partition by doc_id order by i) + {LENGTH}, true))::int as new from late)),
spans as (select doc_id, min(i) as a, max(i) + {LENGTH} as b from runs group by doc_id, g),
cut as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans, max(b) as ended, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) as head
  from (select s.*, d.h, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans s join d using (doc_id)) group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(ended, 0) + 1))) as kept_sha256
from d left join cut using (doc_id)"""
