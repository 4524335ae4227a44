"""Hard negatives, WARC bundles and the Merkle manifest against plain Python, odd rows included."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from kilnwork.llm import merkle, mixing, negatives, warc
from kilnwork.llm.common import shared_dir

# hard negatives ---------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, near string"


def _plain(rows, every=50, positives=5, negatives_=3):
    known = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        known[(i, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v), y)] = None
    out = []
    for i, v, y in known:
        if i % every:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=False))  # noqa: B023, E731
        same = sorted((-score(w), j) for j, w, z in known if z == y and j != i)[:positives]
        for s, j in same:
            s = -s
            other = sorted((-score(w), k) for k, w, z in known if z != y and k != i and 50 * s <= 100 * score(w) <= 95 * s)[:negatives_]
            out += [(i, j, r, k, s, -t) for r, (t, k) in enumerate(other, 1)]
    return sorted(out)


def _cloud(n, seed, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=dims) * rng.choice([0.0, 0.02, 0.8])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([0.5, 1.0, 3.0])], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_a_plain_search(spark, seed):
    rows = _cloud(220, seed)
    found = negatives.hard_negatives(spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(3), every=5, leaf=7, tile=3, held=40)
    assert sorted(map(tuple, found.collect())) == _plain(rows, 5)


def test_negatives_of_odd_rows(spark):
    rows = _cloud(120, 9)
    rows += [(100, None, 1), (None, [1.0] * 8, 1), (150, [1.0] * 8, None), (200, [float("nan")] * 8, 2), (250, [None] * 8, 2), (255, [float("inf")] + [1.0] * 7, 0)]
    rows += [(50, [0.0] * 8, 1), (300, [], 1), (350, [2.0, 1.0], 1), rows[3], rows[3], (rows[3][0], [1.0] * 8, 1), (400, [1e30] * 8, 1)]
    found = negatives.hard_negatives(spark.createDataFrame([(*r, "x") for r in rows], VECTORS))
    assert sorted(map(tuple, found.collect())) == _plain([r for r in rows if r[0] != 400])
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).collect() == []


def test_score_bounds_hold_and_leave_rows_out():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 16)) * 300
    rows = np.floor(centres[rng.integers(5, size=2000)] + rng.normal(size=(2000, 16)) * 20)
    references = centres / np.linalg.norm(centres, axis=1)[:, None]
    leaves = negatives.Leaves(np.arange(2000), np.zeros(2000, int), rows, references)
    norms = np.linalg.norm(rows[:50], axis=1)
    lower, upper = leaves.scores(norms, negatives.angles(rows[:50], norms, references))
    score = rows[:50] @ leaves.vectors.T
    for leaf, (a, b) in enumerate(leaves.bounds):
        assert (score[:, a:b] <= upper[:, leaf, None]).all() and (score[:, a:b] >= lower[:, leaf, None]).all()
    best = np.sort(score, axis=1)[:, -5]
    assert (upper < best[:, None]).mean() > 0.4  # the rest need no scores


# mixing: a bound on the schedule ---------------------------------------------------------------------------------------------------


def test_weights_far_off_are_refused_before_the_schedule(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a" if i < 100 else "b") for i in range(200)], "doc_id long, source string")
    monkeypatch.setattr(mixing, "schedule", lambda *_: pytest.fail("scheduled"))
    with pytest.raises(ValueError, match="too small"):
        mixing.mix(df, {"a": 1.0, "b": 1e-7}, block=1)


# WARC -------------------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string"


def _pages():
    random.seed(4)
    rows = [(i, f"http://h/{i}?q={i % 7}", random.choice(["", "a" * 30, "ü\r\n\r\nWARC/1.1\r\n", f"<p>{i}</p>" * 50])) for i in range(300)]
    rows += [(1000, None, "x" * 2_500_000), (1001, "http://a b\r\nX: y", "odd"), (None, "http://n", "none"), (None, "http://n", "odd"), (1002, "u", None), (1003, "u", "twice"), (1003, "u", "twice")]
    return rows


def _told(rows):
    most: dict[str, int | None] = {}
    for i, _, t in rows:
        t = t or ""
        most[t] = max((x for x in (most.get(t), i) if x is not None), default=None)
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        first = most[t or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("groups", [200_000, 0])
def test_warc_round_trip(spark, monkeypatch, groups):
    monkeypatch.setattr(warc, "GROUPS", groups)
    rows = _pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(4)
    got = warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == _told(rows)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_warc_bundles_are_seekable(spark):
    rows = [(i, f"http://h/{i}", f"<p>{hashlib.sha256(str(i).encode()).hexdigest() * 5}</p>") for i in range(400)]
    index = warc.write(spark.createDataFrame([(*r, "") for r in rows], PAGES).repartition(2), f"{shared_dir(spark)}/warc-seek", frame=4000, most=9000)
    held = index.collect()
    assert len({r.bundle for r in held}) > 2 and len({(r.bundle, r.frame) for r in held}) > 20
    for bundle in {r.bundle for r in held}:
        store, path = fs.FileSystem.from_uri(bundle)
        raw = store.open_input_file(path).read()
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()  # any decoder reads it from the start
        parsed, at = [], 0
        while at < len(whole):
            fields, block, at = warc.parse(whole, at)
            parsed.append(fields["warc-record-id"].strip("<>"))
        assert sorted(parsed) == sorted(r.record_id for r in held if r.bundle == bundle)
        for r in [r for r in held if r.bundle == bundle][:5]:
            frame = zstandard.ZstdDecompressor().decompress(raw[r.frame_offset : r.frame_offset + r.frame_packed])
            fields, block, end = warc.parse(frame, r.start)
            assert (fields["warc-record-id"], end - r.start) == (f"<{r.record_id}>", r.length)
    wanted = spark.createDataFrame([(r.record_id,) for r in held[::37]] + [("urn:x-page:none",)], "record_id string")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.lookup(index, wanted).collect()}
    assert got == {i: t for i, _, t in rows if any(r.record_id.split(":")[2] == str(i) for r in held[::37])}
    assert {(r.page_id, bytes(r.payload).decode()) for r in warc.read(index).collect()} == {(i, t) for i, _, t in rows}


def test_warc_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcd", ""), (4, "u", "abcd", "")], PAGES)
    index = warc.write(df, f"{shared_dir(spark)}/warc-small", least=3)
    assert {r.page_id: r.record_type for r in warc.read(index).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_damage_is_noticed(spark):
    index = warc.write(spark.createDataFrame([(1, "u", "abc" * 100, "")], PAGES), f"{shared_dir(spark)}/warc-damaged")
    row = index.first()
    path = row.bundle.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    other = zstandard.ZstdCompressor().compress(b"y" * row.frame_size)
    raw[: len(other)] = other
    open(path, "wb").write(bytes(raw))
    with pytest.raises(Exception, match="damaged|decompress"):
        warc.read(index).collect()


# Merkle manifest ---------------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string, path string"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _up(nodes, fan):
    return [_h(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]


def _manifest(rows, fan=16):
    leaf_of = lambda r: _h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in r])
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    trees = {}
    for s, held in by.items():
        held.sort(key=lambda x: x[:3])
        levels = [[x[2] for x in held]]
        while len(levels[-1]) > 1:
            levels.append(_up(levels[-1], fan))
        trees[s] = levels
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = [[trees[s][-1][0] for s in order]]
    while len(top[-1]) > 1:
        top.append(_up(top[-1], fan))
    root = top[-1][0] if order else None
    out = []
    for s, held in by.items():
        for place, (_, _, leaf, r) in enumerate(held):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            at, proof = (leaf_of((*r[:4], lower(r[4]))) if changed else leaf), ""
            for levels, p in ((trees[s], place), (top, order.index(s))):
                for nodes in levels[:-1]:
                    run, i = nodes[p // fan * fan : p // fan * fan + fan], p % fan
                    left, right = "".join(run[:i]), "".join(run[i + 1 :])
                    proof += left + right
                    at = _h(left + at + right)
                    p //= fan
            out.append((r[0], leaf, trees[s][-1][0], root, _h(proof), at, at == root))
    return sorted(out, key=str)


def _rows(n, sources, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Ab ü", "lower", "", None, "X" * 400])) for i in range(n)]


CASES = {
    "hot": _rows(700, ["a"] * 5 + ["b", "é", None, ""], 1) + [(5000, "lone", "en", 1, "T")],
    "one source": _rows(300, ["a"], 2),
    "one run": _rows(5, ["a"], 3),
    "one leaf": _rows(1, [None], 4),
    "many sources": [(i, f"s{i % 290}", "en", i, "Text") for i in range(400)],
    "ties": [(7, "a", "en", 1, "T")] * 20 + [(None, "a", None, None, None)] * 2 + [(None, "a", "en", 2, "U"), (7, "a", "en", 1, "V"), (-3, None, "en", 1, "V")],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_manifest_equals_a_plain_tree(spark, monkeypatch, case):
    if case == "hot":
        monkeypatch.setattr(merkle, "NODES", 0)  # by shuffles alone
    df = spark.createDataFrame([(*r, "clash") for r in CASES[case]], DOCS).repartition(3)
    got = merkle.audit(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == _manifest(CASES[case])


def test_a_deep_tree_jumps_to_its_root(spark):
    rows = [(i, "a" if i % 5 else "b", "en", i, f"Text {i}") for i in range(90)]
    df = spark.createDataFrame([(*r, "") for r in rows], DOCS)
    out = merkle.proofs(df, fan=2)  # seven levels and one above: three joins
    got = out.select("id", merkle.fold(F.col("leaf"), F.col("path")).alias("folded"), "root", F.size("path").alias("levels")).collect()
    assert len(got) == 90 and all(r.folded == r.root for r in got) and {r.levels for r in got} == {8, 6}
    plain = {r[0]: r[3] for r in _manifest(rows, 2)}
    assert {r.id: r.root for r in got} == plain
