"""Embedding near-duplicates by lattice hashing.

A table turns each unit vector by random orthonormal rows into a few points of 8 dimensions, decodes each to the
nearest point of the E8 lattice, and joins them to a cell. A vector stands in its home cell and also visits the cells in which
one of its points is the second nearest. Vectors that meet in a cell are candidates unless their cosine, from components of one byte
and the length of what these leave out, is surely below the threshold. A few tables at a time are shuffled, so that disk holds the
standings of those only.
The candidates' connected components, which are all but those of the links, are then compared whole, in blocks, by cosine in double
precision: every pair that any table found is in one component, and each pair is counted once whatever the number of tables that found it.

Equal vectors are one class, so copies cost no pairs. Cells and components of any size are cut into blocks, and the
pairs of blocks are dealt over tasks; only counts and one edge a vector and block come out.

Defined cases: null, empty and zero vectors, and those with null or non-finite components, link with nothing and are kept;
vectors of different lengths do not link; rows repeated whole are copies (ids tell vectors apart); the other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ODD, U64, dropped, mixed, partitions, small, texts, written
from .components import Forest, components

#: TABLES x POINTS lattice points; SCALE lattice units are a distance of 1. At cosine 0.95 a table finds about half of
#: the pairs, so that all tables together miss fewer than one in a million.
TABLES, POINTS, SCALE = 16, 3, 2.2
#: Rows of a cell, and of a component, from which it is cut into blocks; into SPLIT of them at most, as a row goes to so many tasks.
BLOCK, MEMBERS, SPLIT = 65536, 8192, 8
#: Rows that stand in the cells of the tables taken at a time, one table at least; rows a task is meant to get of them.
STANDING, PER_TASK = 1 << 18, 20_000
#: The share of vectors by which cells to cut are told; rows compared at once; groups of up to FEW rows are compared many at a time.
SHARE, SIDE, FEW = 16, 512, 32


def _half(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two nearest points of D8 (even coordinate sums): rounding, then at need the least certain coordinates go the other way."""
    near = np.rint(x)
    rest = x - near
    away = np.where(rest >= 0, 1.0, -1.0)
    rows, size = np.arange(len(x)), np.abs(rest)
    order = np.empty((len(x), 2), np.int64)
    order[:, 0] = size.argmax(1)
    size[rows, order[:, 0]] = -1
    order[:, 1] = size.argmax(1)
    odd = near.sum(1) % 2 != 0
    one, two = near.copy(), near.copy()
    one[rows[odd], order[odd, 0]] += away[rows[odd], order[odd, 0]]
    two[rows[odd], order[odd, 1]] += away[rows[odd], order[odd, 1]]
    for k in (0, 1):
        even = rows[~odd]
        two[even, order[~odd, k]] += away[even, order[~odd, k]]
    return one, two


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second of the nearest points of E8 (D8 and D8 + 1/2) found, doubled to whole numbers."""
    points = [*_half(x), *[p + 0.5 for p in _half(x - 0.5)]]
    far = np.stack([((x - p) ** 2).sum(1) for p in points], 1)
    both, rows = np.stack(points, 1) * 2, np.arange(len(x))
    one = far.argmin(1)
    far[rows, one] = np.inf
    return both[rows, one].astype(np.int64), both[rows, far.argmin(1)].astype(np.int64)


@lru_cache(maxsize=8)
def _frames(dim: int, tables: int, points: int, seed: int) -> np.ndarray:
    """(tables, points, dim, 8): orthonormal where dim allows."""
    rng = np.random.default_rng(seed + dim)
    out = np.empty((tables, points, dim, 8))
    for t in range(tables):
        raw = rng.standard_normal((dim, max(dim, points * 8)))
        turned = np.linalg.qr(raw)[0] if dim >= points * 8 else raw / np.sqrt(dim)
        for p in range(points):
            out[t, p] = turned[:, p * 8 : p * 8 + 8] * np.sqrt(dim / 64.0)
    return out


def cells(unit: np.ndarray, tables: int = TABLES, points: int = POINTS, scale: float = SCALE, seed: int = 1, only: range | None = None) -> np.ndarray:
    """(n, tables, 1 + points) uint64: the home cell, then the visited ones; of the tables in only, if given."""
    only = range(tables) if only is None else only
    n, dim = unit.shape
    frames = _frames(dim, tables, points, seed)
    offsets = np.random.default_rng(seed).random((tables, points, 8)) * 2
    odds = np.array([pow(int(ODD), i + 1, 1 << 64) for i in range(8)], U64)
    out = np.empty((n, len(only), 1 + points), U64)
    for at, t in enumerate(only):
        found = [[mixed((c.astype(np.int64).view(U64) * odds).sum(1) + U64(p + 1)) for c in decode(unit @ frames[t, p] * scale + offsets[t, p])] for p in range(points)]
        for probe in range(1 + points):
            key = np.full(n, t + 1, U64)
            for p in range(points):
                key = mixed(key * ODD + found[p][1 if probe == p + 1 else 0])
            out[:, at, probe] = key
    return out


def _units(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each length; invalid vectors are in none."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, values = np.cumsum(sizes) - sizes, vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null: NaN
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        x = values.reshape(-1, size) if len(own) * size == len(values) else values[starts[own][:, None] + np.arange(size)]
        top = np.abs(x).max(1)
        valid = np.isfinite(top) & (top > 0)
        own, x = own[valid], x[valid] / top[valid, None]  # no overflow in the norm
        if len(own):
            yield own, x / np.sqrt((x * x).sum(1))[:, None]


def _portions(batches: Iterator[pa.RecordBatch], column: str, values: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into portions of so many values of the vectors at most (one row at least): bounds the memory of what is made of them."""
    for batch in batches:
        most = pc.max(pc.list_value_length(batch[column])).as_py() or 1
        rows = max(1, min(4096, values // most))
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _classes(df: DataFrame) -> DataFrame:
    """(id, class, embedding): class is a digest of the unit vector, null where the vector is invalid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, "embedding"):
            digest: list[bytes | None] = [None] * len(part)
            for own, unit in _units(part["embedding"]):
                for i, x in zip(own.tolist(), unit, strict=True):
                    digest[i] = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(digest, pa.binary()), part["embedding"]], ["id", "class", "embedding"])

    return df.mapInArrow(run, f"id long, class binary, embedding {df.schema['embedding'].dataType.simpleString()}")


def brief(unit: np.ndarray) -> np.ndarray:
    """(n, dim + 8) bytes: the components as whole numbers of up to 127 steps, the step, and the length of what they leave out at most (float32)."""
    step = (np.abs(unit).max(1) / 127).astype(np.float32)
    short = np.clip(np.rint(unit / step[:, None]), -127, 127).astype(np.int8)
    rest = unit - short.astype(np.float32) * step[:, None]
    left = (np.sqrt((rest * rest).sum(1)) * 1.0001 + 1e-7).astype(np.float32)
    return np.concatenate([short.view(np.uint8), step.view(np.uint8).reshape(-1, 4), left.view(np.uint8).reshape(-1, 4)], axis=1)


def unpacked(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The float32 vectors of brief(), and the length of what each leaves out at most."""
    step, left = (np.ascontiguousarray(raw[:, a:b]).view(np.float32)[:, 0] for a, b in ((-8, -4), (-4, raw.shape[1])))
    return raw[:, :-8].view(np.int8).astype(np.float32) * step[:, None], left


def _standing(classes: DataFrame, tables: int, points: int, scale: float, only: range, whole: bool = True) -> DataFrame:
    """(cell, rep, brief) for each cell of the tables in only that a class stands in or visits; without whole the cell alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, "embedding", (1 << 22) // (len(only) * (1 + points))):
            for own, unit in _units(part["embedding"]):
                at = cells(unit, tables, points, scale, only=only).reshape(len(own), -1)
                n = at.shape[1]
                out = [pa.array(at.reshape(-1).view(np.int64))]
                if whole:
                    short = brief(unit)
                    ends = pa.py_buffer((np.arange(len(own) * n + 1) * short.shape[1]).astype(np.int32))
                    held = pa.Array.from_buffers(pa.binary(), len(own) * n, [None, ends, pa.py_buffer(np.repeat(short, n, axis=0).tobytes())])
                    out += [pa.array(np.repeat(part["rep"].to_numpy()[own], n)), held]
                yield pa.RecordBatch.from_arrays(out, ["cell", "rep", "brief"][: len(out)])

    return classes.select("rep", "embedding").mapInArrow(run, "cell long, rep long, brief binary" if whole else "cell long")


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches as one table for each value of key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = list(zip(*[batch[k].to_numpy(zero_copy_only=False) for k in key], strict=True))
        cuts = [i for i in range(1, len(values)) if values[i] != values[i - 1]]
        if held and tuple(held[-1][k][-1].as_py() for k in key) != tuple(batch[k][0].as_py() for k in key):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _whole(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of sorted batches in tables that hold all rows of each value of key, and where these begin in the table."""

    def starts(columns: list[np.ndarray]) -> np.ndarray:
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cut = int(starts([batch[k].to_numpy() for k in key])[-1])
        if not cut and held and all(held[-1][k][-1] == batch[k][0] for k in key):
            held.append(batch)
            continue
        done = [*held, batch.slice(0, cut)] if cut else held
        held = [batch.slice(cut)]
        if done:
            whole = pa.Table.from_batches(done)
            yield whole, starts([whole[k].to_numpy() for k in key])
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, starts([whole[k].to_numpy() for k in key])


def in_blocks(rows: DataFrame, key: str, item: str, cut: DataFrame | None) -> DataFrame:
    """rows with left, right and mine: a key that stands in cut with a number of blocks is cut into them by a hash of item, and each
    row goes to every pair of blocks that holds its own; mine tells on which sides it stands (0 left, 1 right, 2 both)."""
    if cut is None:
        return rows.withColumns({"left": F.lit(0), "right": F.lit(0), "mine": F.lit(2)})
    rows = rows.join(F.broadcast(cut), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other"), "mine": F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)}).drop("own", "other", "blocks")


def _blocks(counts: DataFrame, key: str, n: str, block: int) -> DataFrame | None:
    """(key, blocks) of the keys with more than block rows, of which there are at most as many as blocks of rows; None if there are none."""
    cut = written(counts.filter(F.col(n) > block).select(key, F.least(F.ceil(F.col(n) / block), F.lit(SPLIT)).cast("int").alias("blocks")), "blocks")
    return cut if cut.count() else None


def _stars(reps: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (reps[a], reps[b]) as a star around the smallest of each connected set."""
    order = np.argsort(reps, kind="stable")
    place = np.empty(len(reps), np.int64)
    place[order] = np.arange(len(reps))
    forest = Forest(len(reps))
    for x, y in zip(place[a].tolist(), place[b].tolist(), strict=True):
        forest.join(x, y)
    roots = forest.roots()
    moved = np.flatnonzero(roots != np.arange(len(reps)))
    return reps[order[moved]], reps[order[roots[moved]]]


def _places(near: np.ndarray) -> tuple[np.ndarray, ...]:
    """np.nonzero, but by the faster search of one dimension."""
    return np.unravel_index(np.flatnonzero(near), near.shape)


def _tie(labels: np.ndarray, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> None:
    """Joins in labels (the smallest place of each place's set) the places left[i] and right[j] where near."""
    i, j = _places(near)
    one, two = labels[left[i]], labels[right[j]]
    while (apart := one != two).any():
        one, two = one[apart], two[apart]
        up = np.arange(len(labels))
        np.minimum.at(up, np.maximum(one, two), np.minimum(one, two))
        while not (up[up] == up).all():
            up = up[up]
        labels[:] = up[labels]
        one, two = up[one], up[two]


def _many(starts: np.ndarray, ends: np.ndarray, cost: int) -> Iterator[np.ndarray]:
    """(groups, rows) of places, for groups of one size at a time and no more of them than keep rows * rows * groups and cost * rows * groups bounded."""
    for size in np.unique(ends - starts).tolist():
        first = starts[ends - starts == size]
        step = max(1, (1 << 20) // (size * max(size, cost)))
        for at in range(0, len(first), step):
            yield first[at : at + step, None] + np.arange(size)


def _tied_in(reps: np.ndarray, near: np.ndarray) -> np.ndarray:
    """(groups, rows): the smallest of reps that each is connected to by near (groups, rows, rows)."""
    out = reps
    while True:
        new = np.minimum(out, np.where(near, out[:, None, :], np.iinfo(np.int64).max).min(2))
        if (new == out).all():
            return out
        out = new


def _compared(starts: np.ndarray, reps: np.ndarray, mine: np.ndarray, vectors: np.ndarray, test: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(to, links) for each row: the smallest of reps in its connected set of the group, and the copies of the rows linked to it (if
    copies are given). A group begins at each of starts; test(products, a, b) tells which products of the rows a and b link."""
    to, links, weights = reps.copy(), np.zeros(len(reps), np.int64), None if copies is None else copies.astype(np.float64)
    ends = np.append(starts[1:], len(reps))
    whole = mine[starts] == 2
    few = whole & (ends - starts > 1) & (ends - starts <= FEW)
    for at in _many(starts[few], ends[few], vectors.shape[1]):
        near = test(vectors[at] @ vectors[at].transpose(0, 2, 1), at[:, :, None], at[:, None, :]) & (reps[at][:, :, None] != reps[at][:, None, :])
        some = near.any((1, 2))
        at, near = at[some], near[some]
        if len(at):
            to[at] = _tied_in(reps[at], near)
            if copies is not None:
                links[at] = (near * copies[at][:, None, :]).sum(2)
    for start, end, both in zip(starts[ends - starts > FEW].tolist(), ends[ends - starts > FEW].tolist(), whole[ends - starts > FEW].tolist(), strict=True):
        _compared_one(np.arange(start, end)[np.argsort(reps[start:end], kind="stable")], both, reps, mine, vectors, test, weights, to, links)
    for start, end in zip(starts[~whole & (ends - starts <= FEW)].tolist(), ends[~whole & (ends - starts <= FEW)].tolist(), strict=True):
        _compared_one(np.arange(start, end)[np.argsort(reps[start:end], kind="stable")], False, reps, mine, vectors, test, weights, to, links)
    return to, links


def _compared_one(rows: np.ndarray, both: bool, reps: np.ndarray, mine: np.ndarray, vectors: np.ndarray, test: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], weights: np.ndarray | None, to: np.ndarray, links: np.ndarray) -> None:
    """_compared for a group's rows, by rep: all with all if both, else those on the left with those on the right, SIDE by SIDE at a time."""
    labels, at = np.arange(len(rows)), np.arange(len(rows))
    one, two = (at, at) if both else (at[mine[rows] == 0], at[mine[rows] == 1])
    ours, theirs = np.ascontiguousarray(vectors[rows[one]]), np.ascontiguousarray(vectors[rows[two]].T)
    space = np.empty(SIDE * SIDE, vectors.dtype)
    for i in range(0, len(one), SIDE):
        a = one[i : i + SIDE]
        for j in range(i if both else 0, len(two), SIDE):
            b = two[j : j + SIDE]
            alike = (labels[a] == labels[a[0]]).all() and (labels[b] == labels[a[0]]).all()
            if alike and weights is None:
                continue  # connected already, and nothing is counted
            products = np.matmul(ours[i : i + SIDE], theirs[:, j : j + SIDE], out=space[: len(a) * len(b)].reshape(len(a), len(b)))
            near = test(products, rows[a][:, None], rows[b][None, :])
            if both and i == j:
                near &= reps[rows[a]][:, None] != reps[rows[b]][None, :]
            if not near.any():
                continue
            if not alike:
                _tie(labels, a, b, near)
            if weights is not None:
                links[rows[a]] += (near @ weights[rows[b]]).astype(np.int64)
                if not both or i != j:
                    links[rows[b]] += (weights[rows[a]] @ near).astype(np.int64)
    to[rows] = reps[rows[labels]]


def _met(standing: DataFrame, n: int, least: float) -> DataFrame:
    """(a, b): star edges of the classes that meet in a cell and may link; n: rows about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, starts in _whole(batches, ["cell", "left", "right"]):
            data, offsets = texts(whole["brief"].combine_chunks())
            sizes, group = np.diff(offsets), np.searchsorted(starts, np.arange(len(whole)), "right")
            reps, mine = whole["rep"].to_numpy(), whole["mine"].to_numpy()
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                vectors, left = unpacked(data.reshape(-1, size) if len(own) == len(whole) else data[offsets[own][:, None] + np.arange(size)])
                slack = 1e-4 + 1e-7 * size  # of sums in float32

                def test(products: np.ndarray, a: np.ndarray, b: np.ndarray, left: np.ndarray = left, floor: float = least - slack) -> np.ndarray:
                    top = left[a].max()
                    near = products >= floor - top - (1 + top) * left[b].max()
                    if near.any():
                        some = _places(near)
                        one, two = (np.broadcast_to(left[x], near.shape)[some] for x in (a, b))
                        near[some] = products[some] + one + (1 + one) * two >= floor
                    return near

                to, _ = _compared(np.flatnonzero(np.diff(group[own], prepend=-1)), reps[own], mine[own], vectors, test)
                moved = to != reps[own]
                if moved.any():
                    a, b = np.unique(np.stack([reps[own][moved], to[moved]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    key = ["cell", "left", "right"]
    dealt = standing.repartition(max(1, min(partitions(standing.sparkSession), -(-n // PER_TASK))), *key).sortWithinPartitions(*key)
    return dealt.select(*key, "mine", "rep", "brief").mapInArrow(run, "a long, b long").distinct()


def _candidates(classes: DataFrame, least: float, tables: int, points: int, scale: float) -> list[DataFrame]:
    """(a, b) of _met, in a table for each run of lattice tables that are shuffled at a time: their standings leave the disk before the next."""
    n, cut = classes.count(), None
    if n > BLOCK:  # a class stands in a cell once
        some = classes.filter(F.pmod(F.xxhash64("rep"), F.lit(SHARE)) == 0)
        counts = _standing(some, tables, points, scale, range(tables), False).groupBy("cell").agg((F.count(F.lit(1)) * SHARE).alias("n"))
        cut = _blocks(counts, "cell", "n", BLOCK)  # an estimate, and all that hangs on it is how large the blocks are
    probes = (1 + points) * max(1, n)
    run = max(1, min(tables, STANDING // probes))
    return [
        written(_met(in_blocks(_standing(classes, tables, points, scale, range(t, min(t + run, tables))), "cell", "rep", cut), probes * run, least), "met")
        for t in range(0, tables, run)
    ]


def _links(members: DataFrame, least: float) -> DataFrame:
    """(rep, links, to): for each class and block the number of rows linked to it, and the smallest class of its connected set there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, starts in _whole(batches, ["root", "left", "right"]):
            reps, copies, mine = (whole[c].to_numpy() for c in ("rep", "copies", "mine"))
            group = np.searchsorted(starts, np.arange(len(whole)), "right")
            for own, unit in _units(whole["embedding"].combine_chunks()):
                to, links = _compared(np.flatnonzero(np.diff(group[own], prepend=-1)), reps[own], mine[own], unit, lambda products, a, b: products >= least, copies[own])
                yield pa.RecordBatch.from_arrays([pa.array(reps[own]), pa.array(links), pa.array(to)], ["rep", "links", "to"])

    cut = _blocks(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root", "n", MEMBERS)
    key = ["root", "left", "right"]
    dealt = in_blocks(members, "root", "rep", cut).repartition(*key).sortWithinPartitions(*key)
    return dealt.select(*key, "mine", "rep", "copies", "embedding").mapInArrow(run, "rep long, links long, to long")


def near_duplicates(df: DataFrame, least: float = 0.95, tables: int = TABLES, points: int = POINTS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of each vector."""
    given = _classes(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding")))
    valid = given.filter("class is not null and id is not null")
    classes = written(valid.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "classes")
    met = _candidates(classes, least, tables, points, scale)
    candidates = components(reduce(DataFrame.unionByName, met).distinct())
    dropped(*met)
    n = candidates.count()
    members = written(classes.select("rep", "copies", "embedding").join(small(candidates.select(F.col("id").alias("rep"), "root"), n), "rep"), "members")
    links = written(_links(members, least), "links")
    dropped(members)
    roots = components(links.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    told = classes.select("class", "rep", "copies").join(counts, "rep", "left").join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    told = written(told.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")), "told")
    # a row without an id is no vector of the table: it links with nothing, whatever its embedding
    rows = written(given.select("id", "class"), "vectors")
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("class")).alias("class")).join(told, "class", "left").withColumn("component_id", F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The same for DuckDB, by definition: the cosine of every two vectors, and what is reachable over the links.
SQL = """with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
ok as (select * from v where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(v, lambda x: x * x)) > 0),
e as (select a.vec_id as a, b.vec_id as b from ok a join ok b on len(a.v) = len(b.v) and a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.95),
n as (select a as vec_id, count(*) as n from e group by 1),
r(id, root) as (select distinct a, a from e union select e.b, r.root from r join e on e.a = r.id),
c as (select id as vec_id, min(root) as root from r group by 1)
select vec_id, coalesce(n, 0) as n_links, coalesce(root, vec_id) as component_id, coalesce(root, vec_id) = vec_id as kept from embeddings left join n using (vec_id) left join c using (vec_id)"""
