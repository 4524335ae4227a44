"""WARC archives as seekable Zstandard bundles, with an index of their records.

A bundle is a file of independent Zstandard frames, each of some whole records, and a footer: a skippable frame with the seek table of the
seekable format (compressed size, size and checksum by frame), so that any decoder of Zstandard reads the whole file and one of the seekable
format reads single frames. The index maps a record's identifier to its bundle, its frame and its place in the unpacked frame.

Bundles are written by the tasks through Arrow's file systems, to the folder that the cluster shares. A bundle has a random name; one
that a lost or repeated task left is in no index, as the index is a table that Spark commits.

Of pages with equal payloads that with the largest id is a response, the others are revisits of it that hold its HTTP head only.
Defined cases: a null text is an empty payload, which counts as equal to other empty ones; a null id is smaller than any other; rows of
one id and one payload get records of the same kind and identifier, repeated rows too; a null address is written as the record's identifier;
blanks, control characters and line breaks in an address are written as %XX; an empty table makes no bundle; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_dir, texts, written

#: Unpacked bytes from which a frame ends, and packed bytes from which a bundle does.
FRAME, BUNDLE = 1 << 20, 128 << 20
#: Groups of equal payloads that may be broadcast (some 15 MB), once they are counted; beyond, pages are joined with them by a shuffle.
GROUPS = 200_000
#: Parts into which the copies of one payload are dealt.
SALTS = 64
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the formats: a skippable frame's and the seek table's magic numbers, the descriptor of a table with checksums.
SKIPPABLE, SEEKABLE, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRIES = "record_id string, bundle string, frame int, frame_offset long, frame_packed long, frame_size long, start long, length long"
_NAME = "urn:x-page:"
_RECORD = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(address: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in address)


def record(page: int | None, url: str | None, payload: bytes, response: int | None, revisit: bool, date: str = DATE) -> tuple[str, bytes]:
    """(identifier, bytes) of a page's record; response: the id of the page whose record holds the payload."""
    sha = digest(payload)
    name = f"{_NAME}{'' if page is None else page}:{sha}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {name if url is None else _safe(url)}", f"WARC-Payload-Digest: sha1:{sha}"]
    if revisit:
        lines += [f"WARC-Refers-To: <{_NAME}{response}:{sha}>", f"WARC-Profile: {PROFILE}", "WARC-Truncated: length"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return name, "\r\n".join(lines).encode() + block + _RECORD


def parse(data: bytes, start: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The fields (names in lower case) and the block of the record at start, and where it ends."""
    stop = data.index(_RECORD, start)
    version, *lines = data[start:stop].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at {start}")
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    body = stop + len(_RECORD)
    end = body + int(fields["content-length"])
    if data[end : end + len(_RECORD)] != _RECORD:
        raise ValueError(f"the record at {start} does not end at {end}")
    return fields, data[body:end], end + len(_RECORD)


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The footer for frames of (packed size, size, checksum)."""
    entries = b"".join(struct.pack("<III", *f) for f in frames)
    tail = struct.pack("<IBI", len(frames), WITH_CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(tail)) + entries + tail


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int, int, int]]:
    """(offset, packed size, size, checksum) of each frame: two short reads at the file's end."""
    end = file.size()
    file.seek(end - 9)
    n, descriptor, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if descriptor & WITH_CHECKSUMS else 8
    file.seek(end - 9 - n * width - 8)
    kind, size = struct.unpack("<II", file.read(8))
    if kind != SKIPPABLE or size != n * width + 9:
        raise ValueError("the seek table is damaged")
    entries = np.frombuffer(file.read(n * width), "<u4").reshape(n, width // 4).astype(np.int64)
    starts = np.cumsum(entries[:, 0]) - entries[:, 0]
    return [(int(s), int(e[0]), int(e[1]), int(e[2]) if width == 12 else -1) for s, e in zip(starts, entries, strict=True)]


def checksum(data: bytes) -> int:
    """The lower 32 bits of XXH64, as the format asks."""
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class _Bundle:
    """One file: records are gathered into a frame, frames are written as they end, the seek table at last."""

    def __init__(self, folder: str, level: int, frame: int = FRAME):
        self.most = frame
        store, path = fs.FileSystem.from_uri(folder)
        self.name = f"{folder}/pages-{uuid4().hex}.warc.zst"
        self.file = store.open_output_stream(f"{path}/{self.name.rsplit('/', 1)[1]}", compression=None)  # by its name it would be packed twice
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames, self.held, self.size, self.written, self.index = [], [], 0, 0, []
        self.waiting: list[tuple[str, int, int]] = []

    def add(self, name: str, data: bytes) -> None:
        self.waiting.append((name, self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.most:
            self.end_frame()

    def end_frame(self) -> None:
        if not self.held:
            return
        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self.file.write(packed)
        self.index += [(n, self.name, len(self.frames), self.written, len(packed), len(data), s, k) for n, s, k in self.waiting]
        self.frames.append((len(packed), len(data), checksum(data)))
        self.written += len(packed)
        self.held, self.size, self.waiting = [], 0, []

    def close(self) -> list[tuple]:
        self.end_frame()
        self.file.write(seek_table(self.frames))
        self.file.close()
        return self.index


_INDEX = pa.schema([("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), *[(n, pa.int64()) for n in ("frame_offset", "frame_packed", "frame_size", "start", "length")]])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)


def responses(pages: DataFrame, key: Column, least: int = 0) -> DataFrame:
    """pages (page_id, url, payload) with revisit and response, the page whose record holds the payload. key: the payload's digest.

    Copies of one payload are counted in parts by salt and then together. Groups of several rows alone are joined with the pages: broadcast
    if they are few, else by (key, salt), so that no task gets all copies of a payload.
    """
    pages = pages.withColumn("__key", F.when(F.octet_length("payload") >= least, key)).withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    parts = pages.filter("__key is not null").groupBy("__key", "__salt").agg(F.max("page_id").alias("most"), F.count(F.lit(1)).alias("n"))
    parts = written(parts, "payloads")
    groups = parts.groupBy("__key").agg(F.max("most").alias("response"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    groups = written(groups, "copies")
    n = groups.count()
    if n <= GROUPS:
        joined = pages.join(F.broadcast(groups), "__key", "left")
    else:
        joined = pages.join(parts.select("__key", "__salt").join(groups, "__key"), ["__key", "__salt"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.withColumn("revisit", revisit).drop("__key", "__salt")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0, level: int = 3, date: str = DATE, frame: int = FRAME, most: int = BUNDLE) -> DataFrame:
    """Writes a record for each page into bundles in the folder (a URI) and returns the index, a table: (record_id, bundle, frame,
    frame_offset, frame_packed, frame_size, start, length). Records of payloads of less than least bytes are all responses.

    A task holds one frame (of frame bytes and a record at most) and the index of one bundle (of most bytes and a frame). The result is computed once, by this call.
    """
    payload = F.coalesce(F.col(text_col), F.lit(""))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = responses(own, F.unhex(F.sha2("payload", 256)), least).select("page_id", "url", "payload", "response", "revisit")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            data, ends = texts(batch["payload"])
            rest = [batch[c].to_pylist() for c in ("page_id", "url", "response", "revisit")]
            for i, (page, url, response, revisit) in enumerate(zip(*rest, strict=True)):
                bundle = bundle or _Bundle(folder, level, frame)
                bundle.add(*record(page, url, data[ends[i] : ends[i + 1]].tobytes(), response, revisit, date))
                if bundle.written >= most:
                    yield _table(bundle.close())
                    bundle = None
        if bundle:
            yield _table(bundle.close())

    return written(rows.mapInArrow(run, ENTRIES), "index")


_FRAMES = "bundle string, frame int, frame_offset long, frame_packed long, frame_size long, checksum long"


def frames(index: DataFrame) -> DataFrame:
    """All frames of the bundles of an index, by the files' seek tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch["bundle"].to_pylist():
                store, path = fs.FileSystem.from_uri(bundle)
                with store.open_input_file(path) as file:
                    found = read_seek_table(file)
                yield pa.RecordBatch.from_pylist([dict(zip(("bundle", "frame", "frame_offset", "frame_packed", "frame_size", "checksum"), (bundle, i, *f), strict=True)) for i, f in enumerate(found)])

    kind = pa.schema([("bundle", pa.string()), ("frame", pa.int32()), *[(n, pa.int64()) for n in ("frame_offset", "frame_packed", "frame_size", "checksum")]])
    typed = lambda batches: (pa.RecordBatch.from_arrays([b[f.name].cast(f.type) for f in kind], schema=kind) for b in run(batches))
    return index.select("bundle").distinct().mapInArrow(typed, _FRAMES)


RECORDS = "record_id string, page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _page(name: str) -> int | None:
    number = name.removeprefix(f"<{_NAME}").split(":", 1)[0]
    return int(number) if number else None


def told(fields: dict[str, str], block: bytes, payload: bool) -> dict:
    """A record's row. A response's payload is measured and its digest compared with the record's; a revisit's HTTP head has its length."""
    head, _, body = block.partition(_RECORD)
    sha = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and digest(body) != sha:
        raise ValueError(f"{fields['warc-record-id']}: its payload is damaged")
    length = next(int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    name = fields["warc-record-id"]
    row = {
        "record_id": name.strip("<>"), "page_id": _page(name), "target_uri": fields["warc-target-uri"], "record_type": fields["warc-type"],
        "refers_to": _page(fields["warc-refers-to"]) if revisit else None, "payload_bytes": length if revisit else len(body), "payload_digest": sha,
    }
    return row | ({"payload": None if revisit else body} if payload else {})


_KIND = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
#: Unpacked bytes of payloads in a batch that a task hands on.
_BATCH = 8 << 20


def _unpacked(batches: Iterator[pa.RecordBatch], payload: bool, places: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the records in the given frames; places: of those at start alone."""
    kind = _KIND.append(pa.field("payload", pa.binary())) if payload else _KIND
    opened: tuple[str, pa.NativeFile] | None = None
    held: tuple[tuple[str, int], bytes] | None = None
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, size = [], 0
        for r in batch.to_pylist():
            if held is None or held[0] != (r["bundle"], r["frame_offset"]):
                if opened is None or opened[0] != r["bundle"]:
                    store, path = fs.FileSystem.from_uri(r["bundle"])
                    opened = (r["bundle"], store.open_input_file(path))
                opened[1].seek(r["frame_offset"])
                data = unpack.decompress(opened[1].read(r["frame_packed"]), max_output_size=r["frame_size"])
                if len(data) != r["frame_size"] or r.get("checksum", -1) not in (-1, checksum(data)):
                    raise ValueError(f"{r['bundle']}: the frame at {r['frame_offset']} is damaged")
                held = ((r["bundle"], r["frame_offset"]), data)
            data, at = held[1], r["start"] if places else 0
            while at < len(data):
                fields, block, at = parse(data, at)
                rows.append(told(fields, block, payload))
                size += len(block) if payload else 200
                if places:
                    break
                if size >= _BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
                    rows, size = [], 0
            if size >= _BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)


def read(index: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the bundles of an index: (record_id, page_id, target_uri, record_type, refers_to, payload_bytes, payload_digest,
    payload). Frames are dealt to tasks one by one, whatever bundle they are in; payloads, frames and checksums are verified."""
    n = partitions(index.sparkSession)
    dealt = frames(index).repartition(n, "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return dealt.mapInArrow(lambda b: _unpacked(b, payload, False), RECORDS + ", payload binary" * payload)


def lookup(index: DataFrame, ids: DataFrame, payload: bool = True) -> DataFrame:
    """The records of ids (record_id), each read at its place: only frames that hold one are fetched and unpacked, once a task."""
    found = index.join(ids.select("record_id").distinct(), "record_id", "left_semi")
    dealt = found.repartition(partitions(index.sparkSession), "bundle", "frame").sortWithinPartitions("bundle", "frame", "start")
    return dealt.mapInArrow(lambda b: _unpacked(b, payload, True), RECORDS + ", payload binary" * payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to new bundles in the shared folder and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    index = write(pages, f"{shared_dir(pages.sparkSession)}/kilnwork-warc-{uuid4().hex}")
    return read(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SYMBOLS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
#: Five hex digits are four symbols of five bits.
_BASE32 = " || ".join(f"substr({_SYMBOLS}, cast((('0x' || substr(h, {5 * i + 1}, 5))::bigint >> {15 - 5 * j}) & 31 as int) + 1, 1)" for i in range(8) for j in range(4))
SQL = f"""
select page_id, cast(strlen(p) as bigint) as payload_bytes, {_BASE32} as payload_digest,
  case when page_id is not distinct from most then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from most then most end as refers_to
from (select page_id, coalesce(html, '') as p, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as most from pages)
"""
