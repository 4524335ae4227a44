"""Substring dedup by repeated-phrase automata.

1. Recurring passages are confirmed. Windows of 13 words that may recur (see chunks) are named by a 128-bit digest of their
   words; a name is exchanged once a chunk, with the smallest id there, and the document in which a recurring window starts first
   learns so.
2. Runs of windows with one anchor (the gram with the smallest hash, so equal windows have equal anchors) go to the shard that owns
   the anchor, each text once a chunk: runs of recurring windows of the document in which they start first as phrases, with its id, and
   the runs of all windows that may recur as segments to be searched. A run of n windows has n + 12 words, four windows on average.
3. A shard's phrases are compiled, once, into an Aho-Corasick automaton (pyahocorasick, a letter a word) of their windows, or several of
   at most SHARD words, and its segments stream through. The automaton says which window of which phrase a match is; the words of both
   are compared, as different words may have one letter. A chunk learns the smallest id of each window, and removes those of a smaller
   id than their document's. Nothing is removed that no automaton has matched.

A segment passes the phrases of its own shard only, so the work of step 3 grows with the words that may recur, not with them times
the shards. Digests serve to tell distinct windows apart in step 1; removal is decided on the words themselves.

Defined cases: null and empty texts have no words; texts under 13 words lose nothing; documents with the text of a smaller id
lose all words if they have 13; rows with equal ids do not remove from each other; null ids count as the largest (and as equal
to 2**63 - 1); ties have no order to keep; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import (
    CHUNK,
    NULL_ID,
    PACKETS,
    REPLIES,
    Chunk,
    Kind,
    Store,
    bits,
    by_chunk,
    by_shard,
    covered,
    dealt,
    expanded,
    packets,
    place_of,
    planes,
    replies,
    runs,
    slid,
    squeezed,
    stored,
    unbits,
    unplaned,
    with_chunks,
)
from .common import U64, dropped, mixed, word_hashes, word_spans, written

WINDOW, GRAM = 13, 6
#: Words of the phrases of an automaton, which has up to 13 nodes a window.
SHARD = 400_000
#: Chunks a shard, where there are many.
PER = 32
#: Bytes of segments that are searched at once, and at least those of one chunk.
SEARCHED = 1 << 20


def _words(chunk: Chunk) -> list[bytes]:
    """All words of the chunk, document by document. Of bytes, split() cuts at the six blanks only."""
    raw, out = chunk.data.tobytes(), []
    for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
        out += raw[a:b].split()
    return out


def _joined(chunk: Chunk) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of the chunk joined by blanks, where each begins and ends."""
    sizes = chunk.ends - chunk.starts
    ends = np.cumsum(sizes + 1) - 1
    return b" ".join(_words(chunk)), ends - sizes, ends


@dataclass
class Entries:
    """The distinct windows of a chunk that may recur: places, the entry of each, names (sorted), and of each entry the smallest
    id and whether another document has it."""

    places: np.ndarray
    entry: np.ndarray
    names: np.ndarray
    least: np.ndarray
    several: np.ndarray


def _entries(chunk: Chunk, joined: tuple[bytes, np.ndarray, np.ndarray], flags: bytes) -> Entries:
    n, (raw, begin, end) = chunk.kind.window, joined
    places = np.flatnonzero(unbits(flags, max(0, chunk.size - n + 1)))
    spans = zip(begin[places].tolist(), end[places + n - 1].tolist(), strict=True)
    digests = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in spans])
    names = np.frombuffer(digests, U64).reshape(-1, 2)
    owner = chunk.ids[chunk.document(places)]
    order = np.lexsort((names[:, 1], names[:, 0]))
    ranked = names[order]
    new = np.ones(len(order), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(1)
    heads, entry = np.flatnonzero(new), np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(owner[order], heads) if len(heads) else owner
    several = (np.maximum.reduceat(owner[order], heads) if len(heads) else owner) > least
    return Entries(places, entry, ranked[heads], least, several)


def _named(store: Store, kind: Kind) -> DataFrame:
    """Packets of names, each once, with the smallest id and whether another document of the chunk has it."""
    shards = store.shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, _, found in by_chunk(batches, kind):
            if 2 not in found:
                continue
            e = _entries(chunk, _joined(chunk), found[2][0])
            full, cuts = dealt(np.ascontiguousarray(e.names[:, 0]), shards)
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = slice(a, b)
                own, place = np.unique(e.least[part], return_inverse=True)
                head = np.array([len(place), len(own)], np.int64).tobytes()
                rest = np.packbits(e.several[part]).tobytes()
                names = [planes(np.ascontiguousarray(e.names[part, i])) for i in (0, 1)]
                out.append(squeezed(b"".join([head, *names, planes(place.astype(U64)), planes(own.view(U64)), rest])))
            yield packets(number, full.tolist(), out)

    return with_chunks(store.chunks, [store.open]).mapInArrow(run, PACKETS)


def _firsts(named: DataFrame, shards: int) -> DataFrame:
    """Replies of role 3: the shard's number and a bit for each entry of the chunk there, set if the window recurs and the chunk's
    smallest id is the smallest of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard"]):
            number, chunk = group["shard"][0].as_py(), group["chunk"].to_pylist()
            parts = []
            for packed in group["payload"].to_pylist():
                raw = expanded(packed)
                m, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
                high, low, place = (unplaned(raw[16 + 8 * m * i : 16 + 8 * m * (i + 1)]) for i in range(3))
                at = 16 + 24 * m
                own = unplaned(raw[at : at + 8 * n]).view(np.int64)
                several = np.unpackbits(np.frombuffer(raw, np.uint8, offset=at + 8 * n), count=m).astype(bool)
                parts.append((high, low, own[place.astype(np.int64)], several))
            ends = np.cumsum([0, *(len(p[0]) for p in parts)])
            high, low, least, several = (np.concatenate([p[i] for p in parts]) for i in range(4))
            order = np.lexsort((low, high))
            new = np.ones(len(order), bool)
            new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
            heads, group_of = np.flatnonzero(new), np.cumsum(new) - 1
            smallest = np.minimum.reduceat(least[order], heads)
            again = np.logical_or.reduceat(several[order], heads) | (np.maximum.reduceat(least[order], heads) > smallest)
            first = np.empty(len(order), bool)
            first[order] = again[group_of] & (least[order] == smallest[group_of])
            found = [(c, np.int64(number).tobytes() + bits(first[i:j])) for c, i, j in zip(chunk, ends[:-1], ends[1:], strict=True) if first[i:j].any()]
            yield replies(3, found)

    return by_shard(named, shards).mapInArrow(run, REPLIES)


def _runs_of_anchors(chunk: Chunk, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of consecutive windows of one anchor: first window, windows, hash of the anchor."""
    anchors = slid(np.minimum, chunk.hashes(chunk.kind.gram), chunk.kind.window - chunk.kind.gram + 1)[places]
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(places) != 1) | (anchors[1:] != anchors[:-1])])[: len(places)])
    return places[heads], np.diff(np.append(heads, len(places))), mixed(anchors[heads])


def _texts(joined: tuple[bytes, np.ndarray, np.ndarray], heads: np.ndarray, tails: np.ndarray) -> list[bytes]:
    """The words from each head to its tail."""
    raw, begin, end = joined
    return [raw[a:b] for a, b in zip(begin[heads].tolist(), end[tails].tolist(), strict=True)]


def _packed(phrases: list[tuple[int, bytes]], segments: list[bytes]) -> bytes:
    text = b"\n".join([x for _, x in phrases])
    return squeezed(np.array([len(phrases), len(text), *(i for i, _ in phrases)], np.int64).tobytes() + text + b"\n".join(segments))


def _unpacked(packed: bytes) -> tuple[list[tuple[int, bytes]], bytes]:
    """The phrases with their ids, and the segments as lines."""
    raw = expanded(packed)
    n, size = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16 + 8 * n
    texts = raw[at : at + size].split(b"\n") if n else []
    return list(zip(np.frombuffer(raw, np.int64, n, 16).tolist(), texts, strict=True)), raw[at + size :]


@dataclass
class Sites:
    """Where the segments of a chunk stand: shards, and the first segment of each, with the end; windows of each segment; of each
    occurrence the segment and its first word."""

    shards: np.ndarray
    cuts: np.ndarray
    windows: np.ndarray
    segment: np.ndarray
    place: np.ndarray

    def packed(self) -> bytes:
        parts = [x.astype(np.int64) for x in (self.shards, self.cuts, self.windows, self.segment, self.place)]
        return squeezed(np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(planes(x) for x in parts))

    @classmethod
    def unpacked(cls, packed: bytes) -> Sites:
        raw, parts = expanded(packed), []
        at = 8 * 5
        for n in np.frombuffer(raw, np.int64, 5).tolist():
            parts.append(unplaned(raw[at : at + 8 * n]).view(np.int64))
            at += 8 * n
        return cls(*parts)

    def late(self, replies: list[bytes], owner: Chunk) -> np.ndarray:
        """The windows whose smallest id, by the shards' replies, is less than their document's."""
        first = np.append(0, np.cumsum(self.windows))
        least = np.full(first[-1], NULL_ID)
        for x in replies:
            s = place_of(self.shards, int(np.frombuffer(x, np.int64, 1)[0]))
            least[first[self.cuts[s]] : first[self.cuts[s + 1]]] = unplaned(expanded(x[8:])).view(np.int64)
        size = self.windows[self.segment]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        places = np.repeat(self.place, size) + step
        return places[least[np.repeat(first[self.segment], size) + step] < owner.ids[owner.document(places)]]


def _first(chunk: Chunk, joined: tuple[bytes, np.ndarray, np.ndarray], found: dict[int, list[bytes]], shards: int) -> np.ndarray:
    """The recurring windows of the chunk's documents in which they start first."""
    e = _entries(chunk, joined, found[2][0])
    full, cuts = dealt(np.ascontiguousarray(e.names[:, 0]), shards)
    first = np.zeros(len(e.names), bool)
    for x in found[3]:
        s = place_of(full, int(np.frombuffer(x, np.int64, 1)[0]))
        first[cuts[s] : cuts[s + 1]] = unbits(x[8:], int(cuts[s + 1] - cuts[s]))
    return e.places[first[e.entry] & (chunk.ids[chunk.document(e.places)] == e.least[e.entry])]


def _sent(store: Store, kind: Kind) -> DataFrame:
    """Packets of a chunk's phrases and segments to the shards of their anchors, and one to shard -1: the segments' Sites."""
    shards = store.shards
    firsts = written(_firsts(_named(store, kind), shards), "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk, _, found in by_chunk(batches, kind):
            if 2 not in found:
                continue
            joined, more = _joined(chunk), kind.window - 2
            heads, count, anchor = _runs_of_anchors(chunk, np.flatnonzero(unbits(found[2][0], max(0, chunk.size - kind.window + 1))))
            numbers: dict[bytes, int] = {}
            segment = np.array([numbers.setdefault(x, len(numbers)) for x in _texts(joined, heads, heads + count + more)], np.int64)
            texts, once = list(numbers), np.unique(segment, return_index=True)[1]
            order = np.argsort(anchor[once], kind="stable")
            once, rank = once[order], np.argsort(order)
            full, cuts = dealt(anchor[once], shards)
            phrases: dict[int, dict[tuple[int, bytes], None]] = {}
            if 3 in found:
                places = _first(chunk, joined, found, shards)
                starts, size, own = _runs_of_anchors(chunk, places)
                # the anchor of a phrase is that of a segment
                shard = np.searchsorted(cuts, np.searchsorted(anchor[once], own), "right") - 1
                for s, i, x in zip(shard.tolist(), chunk.ids[chunk.document(starts)].tolist(), _texts(joined, starts, starts + size + more), strict=True):
                    phrases.setdefault(s, {})[i, x] = None
            out = [
                _packed(list(phrases.get(s, ())), [texts[i] for i in order[a:b].tolist()])
                for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            ]
            yield packets(number, [-1, *full.tolist()], [Sites(full, cuts, count[once], rank[segment], heads).packed(), *out])

    sent = written(with_chunks(store.chunks, [store.open, firsts]).mapInArrow(run, PACKETS), "sent")
    dropped(store.open, firsts)
    return sent


class Lines:
    """Lines of words joined by blanks: where the words begin and end, the line of each, and a letter for each by its hash."""

    def __init__(self, raw: bytes):
        self.raw, data = raw, np.frombuffer(raw, np.uint8)
        self.starts, self.ends, self.rows = word_spans(data, np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]]))
        self.letters = (word_hashes(data, self.starts, self.ends) >> U64(56)).astype(np.uint8).tobytes().decode("latin-1")

    def inside(self, window: int) -> np.ndarray:
        """The windows that lie in one line."""
        return np.flatnonzero(self.rows[: max(0, len(self.rows) - window + 1)] == self.rows[window - 1 :])

    def words(self, place: int, count: int) -> bytes:
        return self.raw[self.starts[place] : self.ends[place + count - 1]]


class Automaton:
    """The automaton of the windows of phrases, by letters. What it yields at a match is the place of the window in the phrases."""

    def __init__(self, phrases: list[tuple[int, str]], window: int):
        phrases = sorted(phrases)
        self.window, self.lines = window, Lines("\n".join([x for _, x in phrases]).encode())
        self.ids = np.array([i for i, _ in phrases], np.int64)[self.lines.rows]
        self.trie, letters, again = ahocorasick.Automaton(ahocorasick.STORE_INTS), self.lines.letters, set()
        places = self.lines.inside(window).tolist()
        for p in reversed(places):  # the smallest id comes last and stays
            if not self.trie.add_word(letters[p : p + window], p):
                again.add(letters[p : p + window])
        self.trie.make_automaton()
        #: By words, where windows have the same letters: the smallest id.
        self.known: dict[bytes, int] = {}
        for p in places if again else ():
            if letters[p : p + window] in again:
                self.known.setdefault(self.lines.words(p, window), int(self.ids[p]))

    def least(self, lines: Lines) -> np.ndarray:
        """For each run of so many words, the smallest id of a phrase that has them; NULL_ID where none has, or where they cross lines."""
        w = self.window
        out = np.full(max(0, len(lines.starts) - w + 1), NULL_ID)
        found = np.fromiter(chain.from_iterable(self.trie.iter(lines.letters)), np.int64).reshape(-1, 2)
        at, place = found[:, 0] - (w - 1), found[:, 1]
        whole = lines.rows[at] == lines.rows[at + w - 1]
        at, place = at[whole], place[whole]
        out[at] = self.ids[place]
        # matches that follow each other in both texts are compared at once
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(place) != 1)])[: len(at)])
        counts = np.diff(np.append(heads, len(at)))
        last = counts + w - 2
        spans = (lines.starts[at[heads]], lines.ends[at[heads] + last], self.lines.starts[place[heads]], self.lines.ends[place[heads] + last])
        raw, own = lines.raw, self.lines.raw
        for k, (a, b, c, d) in enumerate(zip(*(x.tolist() for x in spans), strict=True)):
            if raw[a:b] != own[c:d]:
                for i, p in zip(at[heads[k] : heads[k] + counts[k]].tolist(), place[heads[k] : heads[k] + counts[k]].tolist(), strict=True):
                    words = lines.words(i, w)
                    out[i] = self.ids[p] if words == self.lines.words(p, w) else self.known.get(words, NULL_ID)
        return out

    def matched(self, words: list[bytes], inside: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Whether each word is in a window of a phrase that has a smaller id. inside: window starts that lie in one document; owner: ids by word."""
        least = self.least(Lines(b" ".join(words)))
        return covered(np.flatnonzero(inside & (least < owner[: len(least)])), self.window, len(words))


def _compiled(phrases: list[tuple[int, bytes]], window: int, words: int) -> Iterator[Automaton]:
    """Automata of about so many words of the phrases."""
    part, total = [], 0
    for own, text in phrases:
        part.append((own, text.decode()))
        total += text.count(b" ") + 1
        if total >= words:
            yield Automaton(part, window)
            part, total = [], 0
    if part:
        yield Automaton(part, window)


def _searched(sent: DataFrame, window: int, shards: int, words: int) -> DataFrame:
    """Replies of role 3: the shard's number and, for each window of the chunk's segments there, the smallest id of a phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard"]):
            number = np.int64(group["shard"][0].as_py()).tobytes()
            phrases: dict[tuple[int, bytes], None] = {}
            parts: list[list[tuple[int, bytes]]] = []
            size = SEARCHED
            for c, packed in zip(group["chunk"].to_pylist(), group["payload"].to_pylist(), strict=True):
                own, segments = _unpacked(packed)
                phrases.update(dict.fromkeys(own))
                if size >= SEARCHED:
                    parts.append([])
                    size = 0
                parts[-1].append((c, segments))
                size += len(segments)
            least: list[np.ndarray] = []
            for automaton in _compiled(list(phrases), window, words):
                new = [automaton.least(lines)[lines.inside(window)] for lines in (Lines(b"\n".join([x for _, x in part])) for part in parts)]
                least = [np.minimum(x, y) for x, y in zip(least, new, strict=True)] if least else new
            for part, ids in zip(parts, least, strict=False):  # without phrases none
                # a line of n words has n - window + 1 windows
                ends = np.cumsum([x.count(b" ") - (window - 2) * (x.count(b"\n") + 1) for _, x in part])
                own = zip([c for c, _ in part], np.split(ids, ends[:-1]), strict=True)
                yield replies(3, [(c, number + squeezed(planes(x.view(U64)))) for c, x in own if (x < NULL_ID).any()])

    return by_shard(sent.filter("shard >= 0"), shards).mapInArrow(run, REPLIES)


def remove_repeats(df: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", kept: bool = True, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256), and with kept the words that are left, joined by blanks."""
    kind = Kind(True, window, gram)
    store = stored(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), kind, chunk, PER)
    sent = _sent(store, kind)
    found = written(_searched(sent, window, store.shards, shard), "found")
    sites = sent.filter("shard < 0").select("chunk", F.lit(4).alias("role"), "payload")

    def finish(c: Chunk, skip: np.ndarray, sites: list[bytes], least: list[bytes]) -> pa.RecordBatch:
        gone = covered(Sites.unpacked(sites[0]).late(least, c), window, c.size) if least else np.zeros(c.size, bool)
        words, bounds = _words(c), c.bounds.tolist()
        left, removed = [], []
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            out = np.ones(b - a, bool) if skip[i] and b - a >= window else gone[a:b]
            removed.append(int(out.sum()))
            left.append(b" ".join([w for w, g in zip(words[a:b], out.tolist(), strict=True) if not g] if removed[-1] else words[a:b]))
        columns = {
            "id": c.id_column(),
            "n_words": pa.array(np.diff(c.bounds), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
        }
        if kept:
            columns["kept_text"] = pa.array([x.decode() for x in left], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, skip, told in by_chunk(batches, kind):
            yield finish(c, skip, told.get(4, []), told.get(3, []))

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * kept
    return with_chunks(store.chunks, [store.copies, sites, found]).mapInArrow(run, schema).withColumnRenamed("id", id_col)


#: The same for DuckDB, by definition: every 13 words with the smallest id they start in.
SQL = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
v as (select doc_id, i, array_to_string(w[i + 1 : i + {WINDOW}], ' ') as s from (select doc_id, w, unnest(range(len(w) - {WINDOW - 1})) as i from d where len(w) >= {WINDOW})),
f as (select s, min(doc_id) as least from v group by s having min(doc_id) < max(doc_id)),
late as (select distinct v.doc_id, v.i from v join f using (s) where v.doc_id > f.least),
runs as (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from (select *, (coalesce(i > lag(i) over (partition by doc_id order by i) + {WINDOW}, true))::int as new from late)),
spans as (select doc_id, min(i) as a, max(i) + {WINDOW} as b from runs group by doc_id, g),
cut as (select doc_id, sum(b - a)::bigint as n_removed, max(b) as ended, string_agg(nullif(array_to_string(w[before + 1 : a], ' '), ''), ' ' order by a) as head
  from (select s.*, d.w, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from spans s join d using (doc_id)) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(concat_ws(' ', head, nullif(array_to_string(w[coalesce(ended, 0) + 1 :], ' '), ''))) as kept_sha256
from d left join cut using (doc_id)"""
