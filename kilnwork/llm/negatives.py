"""Hard negatives by angular triangle filtering.

Each vector's angles to a few reference directions are stored. By the triangle inequality on the sphere the angle of two vectors is at
least the difference of their angles to a reference and at most the sum (or 360 degrees less it), so the references give an interval of
cosines, and the norms make it an interval of scores, widened by what rounding can do. Rows stand in leaves of neighbours, and an anchor is
scored, in whole numbers, with those leaves alone whose interval meets the window of scores it still wants.

The rows are cut into parts that a task can hold; the anchors, a stated query set, stream past each part.

Defined cases: rows whose label, vector or id is null, whose vector has a null or non-finite entry, or whose whole-number vector has a
squared length of 2**53 or more (its scores would not be exact) take no part; shorter vectors are padded with zeros, vectors of zeros score 0;
equal scores stand by id; rows repeated whole count once, rows of one id that differ are rows of their own but no partners of each
other; an anchor without positives, or a positive without negatives in its window, has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Reference directions, chosen far from each other among so many rows (of the first hashes of ids): they only decide how much is left out.
REFERENCES, SAMPLE = 16, 1024
#: Rows that a task holds, about; neighbours in a leaf; anchors that are compared at once; finds that are held before they are cut.
PART, LEAF, TILE, HELD = 65_536, 256, 512, 400_000
#: What rounding can do to an angle.
SLACK = 1e-7
EXACT = float(2**53)


def whole(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors floor(scale * x) one after the other, their lengths, and which take part."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    values = column.flatten()
    flat = np.floor(np.asarray(pc.fill_null(values.cast(pa.float64()), np.nan)) * scale) + 0.0
    row = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(over="ignore", invalid="ignore"):
        square = np.bincount(row, weights=flat * flat, minlength=len(lengths))
    return flat, lengths, (square < EXACT) & np.asarray(column.is_valid())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Stored vectors (int64 bytes) as rows of float64, padded with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        own = np.frombuffer(v, np.int64)
        out[i, : len(own)] = own
    return out


def angles(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """To each reference (of length 1), 0 where the vector is zero."""
    cosine = (vectors @ references.T) / np.maximum(norms, 1e-300)[:, None]
    return np.where(norms[:, None] > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


def score_bounds(low: np.ndarray, high: np.ndarray, norm: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of vectors whose angle is in [low, high] and whose norms are norm and one in [least, most]; safe against rounding."""
    up, down = np.cos(np.maximum(low - SLACK, 0)), np.cos(np.minimum(high + SLACK, np.pi))
    upper = norm * np.where(up > 0, most, least) * up
    lower = norm * np.where(down > 0, least, most) * down
    return lower - 1 - 1e-9 * np.abs(lower), upper + 1 + 1e-9 * np.abs(upper)


class Leaves:
    """The rows of a part by runs of neighbours: their vectors, and the intervals of their angles and norms."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, references: np.ndarray, leaf: int = LEAF):
        norms = np.sqrt((vectors * vectors).sum(1))
        own = angles(vectors, norms, references)
        near = own.argmin(1) if len(references) else np.zeros(len(ids), int)
        order = np.lexsort((ids, own[np.arange(len(ids)), near], near))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        starts = np.arange(0, len(ids), leaf)
        self.bounds = [(s, min(s + leaf, len(ids))) for s in starts.tolist()]
        self.first, self.last = np.minimum.reduceat(own[order], starts), np.maximum.reduceat(own[order], starts)
        self.least, self.most = np.minimum.reduceat(norms[order], starts), np.maximum.reduceat(norms[order], starts)

    def scores(self, norms: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of anchors (norms, angles) with the rows of each leaf."""
        low, high = np.zeros((len(own), len(self.bounds))), np.full((len(own), len(self.bounds)), np.pi)
        for a, first, last in zip(own.T, self.first.T, self.last.T, strict=True):
            low = np.maximum(low, np.maximum(first[None] - a[:, None], a[:, None] - last[None]))
            high = np.minimum(high, np.minimum(a[:, None] + last[None], 2 * np.pi - a[:, None] - first[None]))
        return score_bounds(low, np.maximum(high, low), norms[:, None], self.least[None], self.most[None])


class Finds:
    """The best n finds of each slot, by score, then id; floor: what a find must score to get in."""

    def __init__(self, floor: np.ndarray, n: int, held: int = HELD):
        self.floor, self.n, self.held, self.parts, self.size = floor.copy(), n, held, [], 0

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((slot, ids, score))
        self.size += len(slot)
        if self.size > self.held:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = place == self.n - 1
        self.floor[slot[last]] = np.maximum(self.floor[slot[last]], score[last])
        keep = place < self.n
        self.parts, self.size = [(slot[keep], ids[keep], score[keep])], int(keep.sum())
        return self.parts[0]


def _scored(leaves: Leaves, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, n: int, held: int = HELD) -> Finds:
    """For each anchor and window [low, high] (anchors x windows) the best n rows in it of the anchor's label, or of other ones."""
    windows = low.shape[1]
    finds = Finds(low.reshape(-1), n, held)
    lower, upper = leaves.scores(np.sqrt((vectors * vectors).sum(1)), own)
    for leaf in np.argsort(-upper.mean(0), kind="stable").tolist():
        floor = finds.floor.reshape(low.shape)
        active = np.flatnonzero(((upper[:, leaf, None] >= floor) & (lower[:, leaf, None] <= high) & (floor <= high)).any(1))
        if not len(active):
            continue
        start, stop = leaves.bounds[leaf]
        score = vectors[active] @ leaves.vectors[start:stop].T
        fits = (labels[active][:, None] == leaves.labels[None, start:stop]) == same
        fits &= ids[active][:, None] != leaves.ids[None, start:stop]
        for w in range(windows):
            a, b = np.nonzero(fits & (score >= floor[active, w, None]) & (score <= high[active, w, None]))
            finds.add(active[a] * windows + w, leaves.ids[start:stop][b], score[a, b])
        if finds.size > held // 4:
            finds.best()
    return finds


def _compared(rows: DataFrame, anchors: DataFrame, width: int, references: np.ndarray, sizes: tuple[int, int, int], same: bool, n: int, low: int = 0, high: int = 0) -> DataFrame:
    """(anchor, slot, id, score): for each anchor (anchor, id, label, v, wants) the best n rows of its label, or of other labels in the
    window of each wanted score (percent low to high of it), in each part of the rows (part, id, label, v)."""
    leaf, tile_, most_held = sizes
    parts = rows.agg(F.max("part")).first()[0]
    parts = 0 if parts is None else parts + 1
    none = F.lit(None).cast("long")
    own = rows.select("part", F.lit(0).alias("kind"), none.alias("anchor"), "id", "label", "v", F.array().cast("array<bigint>").alias("wants"))
    sent = anchors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(parts - 1, 0))))).select("part", F.lit(1).alias("kind"), "anchor", "id", "label", "v", "wants")
    both = own.unionByName(sent).repartition(max(parts, 1), "part").sortWithinPartitions("part", "kind", "anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, leaves = None, [], None
        for batch in batches:
            at, kinds = batch["part"].to_numpy(), batch["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                piece = batch.slice(a, b - a)
                if at[a] != part:
                    part, held, leaves = at[a], [], None
                if not kinds[a]:
                    held.append((piece["id"].to_numpy(), piece["label"].to_numpy(), _matrix(piece["v"], width)))
                    continue
                if not held:
                    continue
                leaves = leaves or Leaves(*(np.concatenate(x) for x in zip(*held, strict=True)), references, leaf)
                for t in range(0, b - a, tile_):
                    tile = piece.slice(t, tile_)
                    vectors = _matrix(tile["v"], width)
                    mine = angles(vectors, np.sqrt((vectors * vectors).sum(1)), references)
                    wants = tile["wants"].to_pylist()
                    most = max(map(len, wants), default=0)
                    lows, highs = np.full((len(tile), max(most, 1)), -np.inf), np.full((len(tile), max(most, 1)), np.inf)
                    if not same:
                        lows, highs = np.full((len(tile), most), np.inf), np.full((len(tile), most), -np.inf)
                        for i, scores in enumerate(wants):
                            lows[i, : len(scores)] = [-(-low * s // 100) for s in scores]
                            highs[i, : len(scores)] = [high * s // 100 for s in scores]
                    if not lows.shape[1]:
                        continue
                    slot, ids, score = _scored(leaves, tile["id"].to_numpy(), tile["label"].to_numpy(), vectors, mine, lows, highs, same, n, most_held).best()
                    anchor = tile["anchor"].to_numpy()[slot // lows.shape[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array((slot % lows.shape[1]).astype(np.int32)), pa.array(ids), pa.array(score.astype(np.int64))], ["anchor", "slot", "id", "score"])

    return both.mapInArrow(run, "anchor long, slot int, id long, score long")


def _references(rows: DataFrame, width: int) -> np.ndarray:
    """Directions of rows, each the farthest from those before it, among SAMPLE rows (a bounded sample)."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    found = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        own = np.frombuffer(r["v"], np.int64)
        found[i, : len(own)] = own
    norms = np.sqrt((found * found).sum(1))
    found = found[norms > 0] / norms[norms > 0, None]
    if not len(found):
        return np.zeros((0, width))
    chosen, nearest = [0], found @ found[0]
    while len(chosen) < min(REFERENCES, len(found)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, found @ found[chosen[-1]])
    return found[chosen]


def hard_negatives(
    df: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    leaf: int = LEAF, tile: int = TILE, held: int = HELD,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (rows whose id is divisible by every)
    and each of its positives, the best rows of its label, the best rows of other labels whose score is low to high percent of the
    positive's. Scores are products of the vectors floor(scale * x). leaf, tile and held bound
    what a task compares and holds at once; they don't change the result."""
    spark = df.sparkSession
    own = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths, fits = whole(batch["v"], scale)
            data = np.where(np.abs(flat) < EXACT, flat, 0).astype(np.int64).tobytes()
            ends = np.concatenate([[0], np.cumsum(lengths)]) * 8
            v = pa.array([data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], v], ["id", "label", "v"]).filter(pa.array(fits))

    rows = own.filter("id is not null and label is not null and v is not null").mapInArrow(prepared, "id long, label long, v binary").distinct()
    rows = written(rows, "whole")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("v")).alias("bytes")).first()
    width = (shape["bytes"] or 0) // 8
    references = _references(rows, width)
    parts = max(spark.sparkContext.defaultParallelism, -(-shape["n"] // PART))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch["v"], width)
            mine = angles(vectors, np.sqrt((vectors * vectors).sum(1)), references)
            near = mine.argmin(1) if len(references) else np.zeros(len(vectors), int)
            angle = mine[np.arange(len(vectors)), near] if len(references) else np.zeros(len(vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "near", "angle"])

    near = written(rows.mapInArrow(located, "id long, label long, v binary, near int, angle double"), "angles")
    placed = written(near.repartitionByRange(parts, "near", "angle", "id").withColumn("part", F.spark_partition_id()), "parts")
    anchors = near.filter(F.col("id") % every == 0).select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "v")
    anchors = written(anchors, "anchors")
    asked = anchors.withColumn("wants", F.array().cast("array<bigint>"))
    found = _compared(placed, asked, width, references, (leaf, tile, held), True, positives)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id"))
    best = written(found.withColumn("place", place).filter(F.col("place") <= positives).select("anchor", "place", "id", "score"), "positives")
    wants = best.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("wants"))
    found = _compared(placed, anchors.join(wants, "anchor"), width, references, (leaf, tile, held), False, negatives, low, high)
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id"))
    taken = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    taken = taken.select("anchor", (F.col("slot") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("anchor", F.col("id").alias("anchor_id")).join(best.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "anchor")
    return named.join(taken, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted(df: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """df with the label of every seventh id moved to the next of ten."""
    return df.withColumn(label_col, F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col)))


SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
scored as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positive as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as int) as rank,
  id as negative_id, positive_score, score as negative_score
from positive join scored using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
