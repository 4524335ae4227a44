"""Near-duplicate documents by a chosen-path set similarity join on word shingles.

A document's set is its distinct 5-word shingles (all its words as one if it has fewer). Documents with equal sets are
one class. Each class stands in one root node a tree, named by the smallest hash of its shingles under the tree's
order (a minwise token), and a node branches by further minwise tokens, chosen by the node: similar sets go down the same paths.
A node whose classes can be compared is compared whole; others branch on. TREES independent trees bring the recall to target.

What may be in very large groups is first tied to one class of each node (a star, not all pairs) and confirmed; from then on only pairs
of different components are of interest, so a node of one component ends at once, and in others the rows outside the
largest component decide: at most NODE of them are compared to all rows of the node, in blocks.

Every candidate is confirmed on the full sets, rebuilt from the whole texts. At a similarity of 0.75, a tree finds a pair
with probability 0.75 in its root node and 2/3 at any depth, and each sketch test keeps all but one in 10^5: of such links one in 30,000 is
missed, one in 6,000 where all the root nodes are large, and fewer the more alike the sets are. More trees miss fewer: trees_for
tells how many meet a target recall where all nodes branch.

Defined cases: a null text, an empty one or one without words has the empty set and links with nothing; rows repeated whole are
copies; component_id is the smallest id reachable; the other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ODD, U64, mixed, pieces, run_hashes, sized, small, texts, word_hashes, word_spans, written
from .components import components
from .lattice import _runs as runs
from .lattice import _stars as stars

SHINGLE, PERCENT = 5, 75
#: Trees; minwise tokens a sketch; children a row gets when a node branches; rows that are compared with a whole node; rows a block; levels.
TREES, TOKENS, BRANCH, NODE, BLOCK, DEPTH = 8, 64, 2, 4096, 4096, 40
#: Alike pairs a row from which a block counts as dense.
DENSE = 8
#: Bins of the finer sketch: a byte of the smallest hash in each of 256 parts of the hash space, 0 for none.
BINS = 256

_RNG = np.random.default_rng(77)
_A = _RNG.integers(0, 2**63, TOKENS, np.uint64) * U64(2) + U64(1)
_B = _RNG.integers(0, 2**63, TOKENS, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    starts, ends, rows = word_spans(data, offsets)
    words = word_hashes(data, starts, ends, LOWER)
    grams = run_hashes(words, k)
    at = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(mixed(run_hashes(words[a:b], b - a) + U64(b - a)) if b > a else np.zeros(0, U64))
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest hashes under TOKENS orders."""
    low = np.full(TOKENS, 2**64 - 1, U64)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[i : i + 2048, None] * _A + _B).min(0))
    return (low >> U64(32)).astype(np.uint32)


def fine_sketch(hashes: np.ndarray) -> np.ndarray:
    """BINS bytes of sorted hashes."""
    out = np.zeros(BINS, np.uint8)
    part = (hashes >> U64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(hashes) else part
    out[part[first]] = hashes[first] % U64(255) + U64(1)
    return out


def finely_alike(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows of finer sketches may belong to a link: no fewer equal bins, of those that either fills, than a link has but once in 10^5."""
    filled = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    p = percent / 100
    return same >= filled * p - 4.3 * np.sqrt(filled * p * (1 - p)) - 1


def _bins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BINS)


def _sketched(df: DataFrame) -> DataFrame:
    """(id, n, digest, tokens, fine): digest is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            sets = shingle_sets(*texts(batch["text"]))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            tokens = [sketch(s).tobytes() if len(s) else None for s in sets]
            fine = [fine_sketch(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(tokens, pa.binary()), pa.array(fine, pa.binary())], ["id", "n", "digest", "tokens", "fine"])

    return df.mapInArrow(run, "id long, n long, digest binary, tokens binary, fine binary")


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), TOKENS)


def tree_recall(percent: int = PERCENT) -> float:
    """The least share of links at the threshold that one tree finds, however deep it branches: of a node's BRANCH children one at least
    must be shared and find the pair below it."""
    p, found = percent / 100, 1.0
    for _ in range(1000):
        found = 1 - (1 - p * found) ** BRANCH
    return p * found


def trees_for(recall: float, percent: int = PERCENT) -> int:
    """Trees that find this share (below 1) of the links at the threshold, even where all of a document's nodes branch."""
    if not 0 < recall < 1:
        raise ValueError("recall must be between 0 and 1")
    one, n = tree_recall(percent), 1
    if one < 0.05:
        raise ValueError(f"paths of sets that are {percent} % alike die out: recall can't be targeted")
    while (1 - one) ** n > 1 - recall:
        n += 1
    return n


def _roots(classes: DataFrame, trees: int = TREES) -> DataFrame:
    """(node, rep) for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _tokens(batch["tokens"])[:, :trees].astype(U64)
            nodes = mixed(values * ODD + np.arange(1, trees + 1, dtype=U64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.reshape(-1).view(np.int64)), pa.array(np.repeat(batch["rep"].to_numpy(), trees))], ["node", "rep"])

    return classes.select("rep", "tokens").mapInArrow(run, "node long, rep long")


def _branched(rows: DataFrame, trees: int = TREES) -> DataFrame:
    """The children of (node, rep, comp, tokens): BRANCH minwise tokens, chosen by the node among those no root uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, node = _tokens(batch["tokens"]), batch["node"].to_numpy().view(U64)
            at, spare = np.arange(len(node)), TOKENS - trees
            one = mixed(node + ODD) % U64(spare)
            out = []
            for i in range(BRANCH):
                place = ((one + U64(i) * (U64(1) + mixed(node) % U64(spare - 1))) % U64(spare)).astype(np.int64) + trees
                out.append(mixed(mixed(node + values[at, place]) + place.astype(U64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.tile(batch["rep"].to_numpy(), BRANCH)), pa.array(np.tile(batch["comp"].to_numpy(), BRANCH))], ["node", "rep", "comp"])

    return rows.select("node", "rep", "comp", "tokens").mapInArrow(run, "node long, rep long, comp long")


def least_matches(percent: int = PERCENT) -> int:
    p = percent / 100 + (1 - percent / 100) / 256
    return int(TOKENS * p - 4.3 * np.sqrt(TOKENS * p * (1 - p)))


def _alike(tokens: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Matching token bytes of the rows a (down) and b (across); 0 where the sizes alone rule a link out."""
    low = tokens.astype(np.uint8)
    out = np.zeros((len(a), len(b)), np.uint8)
    for t in range(TOKENS):
        out += low[a, t][:, None] == low[b, t][None, :]
    small, large = np.minimum(n[a][:, None], n[b][None, :]), np.maximum(n[a][:, None], n[b][None, :])
    return np.where(small * 100 >= large * percent, out, 0)


def _sides(comp: np.ndarray, major: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows outside the largest component, and the rows that they are compared to in this block."""
    few = np.flatnonzero(comp != major)
    return few, np.arange(len(comp)) if block == 0 else np.flatnonzero(comp == major)


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """(node, block, a, b): pairs of rows of a block (node, block, rep, comp, major, n, sketches) that are of different components and look alike.
    Rows outside the node's largest component (major) are in all of its blocks; pairs among them are told in block 0.
    A block with more than DENSE pairs a row tells only itself, with null for a and b: its rows are compared by their full sets."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["node", "block"]):
            if len(group) < 2:
                continue
            group = group.combine_chunks()
            rep, comp, n = (group[c].to_numpy() for c in ("rep", "comp", "n"))
            tokens, fine = _tokens(group["tokens"]), _bins(group["fine"])
            few, every = _sides(comp, group["major"].to_numpy(), group["block"][0].as_py())
            found, total = [], 0
            for i in range(0, len(few), 128):
                part = few[i : i + 128]
                near = (_alike(tokens, n, part, every, percent) >= least) & (comp[part][:, None] != comp[every][None, :])
                x, y = np.nonzero(near)
                keep = np.concatenate([finely_alike(fine[part[x[j : j + 8192]]], fine[every[y[j : j + 8192]]], percent) for j in range(0, len(x), 8192)]) if len(x) else np.zeros(0, bool)
                a, b = rep[part[x[keep]]], rep[every[y[keep]]]
                found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
                total += len(found[-1])
                if total > DENSE * len(rep):
                    break
            key = [group[c][0].as_py() for c in ("node", "block")]
            if total > DENSE * len(rep):
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64())], ["node", "block", "a", "b"])
            elif total:
                pairs = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), key[0])), pa.array(np.full(len(pairs), key[1], np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["node", "block", "a", "b"])

    return rows.select("node", "block", "rep", "comp", "major", "n", "tokens", "fine").repartition("node", "block").sortWithinPartitions("node", "block").mapInArrow(run, "node long, block int, a long, b long")


def _stars(rows: DataFrame, count: int, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the one class, smallest in one of its nodes, that looks most alike, if any looks alike."""
    hubs = rows.groupBy("node").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("node", "hub")
    hubs = written(sized(hubs, count), "hubs")
    pairs = rows.join(small(hubs, hubs.count()), "node").filter("rep != hub").select("rep", "hub").distinct()
    pairs = written(sized(pairs, count), "stars")
    n = pairs.count()
    side = lambda names: classes.select(*[F.col(c).alias(x) for c, x in names.items()])
    pairs = side({"rep": "rep", "n": "n", "fine": "fine"}).join(small(pairs, n), "rep").join(side({"rep": "hub", "n": "m", "fine": "others"}), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _bins(batch["fine"]), _bins(batch["others"])
            n, m = batch["n"].to_numpy(), batch["m"].to_numpy()
            keep = np.flatnonzero(finely_alike(a, b, percent) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent))
            same = ((a == b) & (a > 0)).sum(1) * 1000 // np.maximum(((a > 0) | (b > 0)).sum(1), 1)
            yield pa.RecordBatch.from_arrays([batch["rep"].take(pa.array(keep)), batch["hub"].take(pa.array(keep)), pa.array(same[keep].astype(np.int64))], ["b", "a", "same"])

    found = pairs.select("rep", "hub", "n", "m", "fine", "others").mapInArrow(run, "b long, a long, same long")
    return sized(found.groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a")), n)


def _packed(docs: DataFrame) -> DataFrame:
    """(id, packed): whole texts, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([packer.compress((x or "").encode()) for x in batch["text"].to_pylist()], pa.binary())], ["id", "packed"])

    return docs.mapInArrow(pack, "id long, packed binary")


def _set_of(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def _dense(rows: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the rows (node, block, rep, comp, major) of dense blocks, as a star for each connected set: sizes of
    intersections are counted for one row at a time along the lists of its shingles, on full sets; no pair leaves the task."""
    ids = written(rows.select(F.col("rep").alias("id")).distinct(), "ids")
    texts_of = _packed(docs.join(small(ids, ids.count()), "id", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["node", "block"]):
            group = group.combine_chunks()
            rep, first = np.unique(group["rep"].to_numpy(), return_index=True)
            comp, major = group["comp"].to_numpy()[first], group["major"].to_numpy()[first]
            sets = [_set_of(x) for x in group["packed"].take(pa.array(first)).to_pylist()]
            size = np.array([len(x) for x in sets])
            order = np.argsort(np.concatenate(sets), kind="stable")
            owner = np.repeat(np.arange(len(sets)), size)[order]
            values = np.concatenate(sets)[order]
            heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            lists = np.empty(len(order), np.int64)
            lists[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
            tails, at = np.append(heads[1:], len(order)), np.concatenate([[0], np.cumsum(size)])
            few, every = _sides(comp, major, group["block"][0].as_py())
            a, b = [], []
            for i in few.tolist():
                own = lists[at[i] : at[i + 1]]
                both = np.bincount(np.concatenate([owner[heads[x] : tails[x]] for x in own.tolist()]), minlength=len(sets))[every]
                linked = every[(both * 100 >= percent * (size[i] + size[every] - both)) & (comp[every] != comp[i])]
                a.append(np.full(len(linked), i))
                b.append(linked)
            a, b = stars(rep, np.concatenate(a), np.concatenate(b))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    both = rows.join(texts_of.withColumnRenamed("id", "rep"), "rep").repartition("node", "block").sortWithinPartitions("node", "block")
    return both.select("node", "block", "rep", "comp", "major", "packed").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Texts travel compressed; only those of the pairs do."""
    n = pairs.count()
    ids = written(sized(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * n), "ids")
    texts_of = docs.join(small(ids, 2 * n), "id", "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                a, b = part["a"].to_pylist(), part["b"].to_pylist()
                keep = []
                sets = {}
                if last:
                    sets[last[0]] = last[1]
                for i, (x, y, s, t) in enumerate(zip(a, b, part["pa"].to_pylist(), part["pb"].to_pylist(), strict=True)):
                    for k, z in ((x, s), (y, t)):
                        if k not in sets:
                            sets[k] = _set_of(z)
                    p, q = sets[x], sets[y]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both) and both:
                        keep.append(i)
                    last = (x, p)
                yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    packed = written(_packed(texts_of), "packed")
    both = packed.select(F.col("id").alias("b"), F.col("packed").alias("pb")).join(small(pairs, n), "b").join(packed.select(F.col("id").alias("a"), F.col("packed").alias("pa")), "a")
    return both.select("a", "b", "pa", "pb").mapInArrow(check, "a long, b long")


def _looked_through(rows: DataFrame, count: int, classes: DataFrame, docs: DataFrame, percent: int, trees: int = TREES) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): the alike pairs of different components in the trees below the rows (node, rep, comp); and links of dense nodes."""
    found, links = None, []
    for depth in range(DEPTH + 1):
        per = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("k"))
        sizes = per.groupBy("node").agg(F.sum("k").alias("rows"), F.max(F.struct("k", "comp")).alias("top")).filter(F.col("rows") > F.col("top.k"))
        sizes = written(sized(sizes.select("node", "rows", (F.col("rows") - F.col("top.k")).alias("few"), F.col("top.comp").alias("major")), count), "nodes")
        live = written(sized(rows.join(small(sizes, sizes.count()), "node"), count), "live")
        n = live.count()
        live = classes.select("rep", "n", "tokens", "fine").join(small(live, n), "rep")
        final = (F.col("few") <= NODE) | F.lit(depth == DEPTH)
        blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
        ready = live.filter(final).withColumn("block", F.explode(F.when((blocks == 1) | (F.col("comp") == F.col("major")), F.array(F.pmod(F.xxhash64("rep"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))))
        pairs = written(_compared(ready, percent), "pairs")
        dense = pairs.filter("a is null").select("node", "block")
        if k := dense.count():
            links.append(written(_dense(ready.select("node", "block", "rep", "comp", "major").join(small(dense, k), ["node", "block"]), docs, percent), "dense"))
        pairs = pairs.filter("a is not null").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        if depth == DEPTH or sizes.filter(~final).isEmpty():
            return found, links
        rows = written(_branched(live.filter(~final), trees), "rows")
        count = BRANCH * n
    raise AssertionError


def near_duplicates(df: DataFrame, percent: int = PERCENT, trees: int = TREES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each document; links: Jaccard similarity of percent / 100 or more. trees: half of TOKENS at
    most, as a node's branches need tokens that are no root's; see trees_for."""
    if not 1 <= trees <= TOKENS // 2:
        raise ValueError(f"trees must be between 1 and {TOKENS // 2}")
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = written(_sketched(docs), "sketches")
    classes = written(rows.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("fine").alias("fine")), "classes")
    roots = written(_roots(classes, trees), "roots")
    count = roots.count()
    stars = written(_stars(roots, count, classes, percent), "tied")
    tied = written(_confirmed(stars, docs, percent), "links")
    first = components(tied)
    n = 2 * tied.count()
    roots = roots.join(small(first.select(F.col("id").alias("rep"), F.col("root").alias("comp")), n), "rep", "left").select("node", "rep", F.coalesce("comp", "rep").alias("comp"))
    pairs, dense = _looked_through(roots, count, classes, docs, percent, trees)
    more = _confirmed(written(pairs.distinct(), "pairs"), docs, percent)
    for links in dense:
        more = more.unionByName(links)
    more = written(more, "links")
    ends = more
    for side in ("a", "b"):
        ends = ends.join(small(first.select(F.col("id").alias(side), F.col("root").alias(f"r{side}")), n), side, "left").withColumn(side, F.coalesce(f"r{side}", side)).drop(f"r{side}")
    second = components(ends)
    named = classes.select("digest", "rep").join(small(first.select(F.col("id").alias("rep"), F.col("root").alias("one")), n), "rep", "left").withColumn("one", F.coalesce("one", "rep"))
    named = named.join(small(second.select(F.col("id").alias("one"), F.col("root").alias("two")), 2 * more.count()), "one", "left").select("digest", F.coalesce("two", "one").alias("root"))
    out = rows.select("id", "n", "digest").join(written(named, "named"), "digest", "left").withColumn("component_id", F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: The same for DuckDB, by definition: sizes of intersections by a join on shingles, and what is reachable over the links.
SQL = f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
links as (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y using (g) where x.doc_id < y.doc_id group by all)
  join n p on p.doc_id = a join n q on q.doc_id = b where 100 * shared >= {PERCENT} * (p.n + q.n - shared)),
e as (select a, b from links union all select b, a from links),
r(id, root) as (select distinct a, a from e union select e.b, r.root from r join e on e.a = r.id),
c as (select id as doc_id, min(root) as root from r group by 1)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(root, doc_id) as component_id, coalesce(root, doc_id) = doc_id as kept from d left join n using (doc_id) left join c using (doc_id)"""
