"""Merkle manifest of a table: a tree for each group, one over the groups' roots, and a proof for every row by pointer jumping.

A node points at an ancestor and holds the siblings on the way there, a segment for each level. At first that is its parent; a join of
the nodes with themselves doubles the distance and appends the ancestor's segments, until all point at the root: log2(height) joins.
The 16 leaves of a run have one way up, so only nodes above the leaves jump; a leaf adds its own run's siblings in the end.

Defined cases: a null field counts as '-' (not as an empty text); leaves with a null id come first in their group, the null group first
among the groups; leaves of equal ids stand by their digests, so repeated rows are leaves of their own and the root does not
depend on the order of the input; a group of one leaf has that leaf as its root; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.places import numbered
from .common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
#: Nodes that may be broadcast, once they are counted: their segments are of 0.5 KB a level.
NODES = 5_000
_PATH = "array<struct<left:binary,right:binary,top:boolean>>"


def leaf_digest(fields: Sequence[Column | str]) -> Column:
    """Lowercase hex SHA-256 of the fields: each '-' if null, else its UTF-8 length, ':' and its value."""
    parts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)) for p in parts]), 256)


def told(digests: Column | str) -> Column:
    """Digests, joined as bytes, as lowercase hex text."""
    return F.lower(F.hex(digests))


def fold(leaf: Column, path: Column) -> Column:
    """The digest that a leaf (hex) and its siblings on the way up make."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(told(s["left"]), at, told(s["right"])), 256))


def _runs(nodes: DataFrame, keep: list[str], fan: int) -> DataFrame:
    """Nodes (group, pos, digest, keep...) in runs of fan: (group, pos, kids, joined, alone); alone: the only node there is."""
    own = F.sort_array(F.collect_list(F.struct("pos", "digest", *keep)))
    runs = nodes.withColumn("run", F.floor(F.col("pos") / fan)).groupBy("group", "run").agg(own.alias("kids"))
    joined = F.aggregate("kids", F.lit(b""), lambda s, x: F.concat(s, x["digest"]))
    return runs.select("group", F.col("run").alias("pos"), "kids", joined.alias("joined"), ((F.col("run") == 0) & (F.size("kids") == 1)).alias("alone"))


def _segment(place: Column, top: bool) -> Column:
    """The siblings of the place-th kid (from 0) in its run's digests."""
    return F.struct(
        F.expr("substring(joined, 1, 32 * place)").alias("left"), F.expr("substring(joined, 32 * place + 33)").alias("right"), F.lit(top).alias("top")
    )


def _key(level: int, top: bool = False) -> Column:
    """The name of the node (group, pos) of a level, leaves being level 0; top: of the tree over the groups."""
    place = F.concat(F.lit(f"{'^' * top}{level}:"), F.col("pos").cast("string"))
    return place if top else F.concat(place, F.coalesce(F.concat(F.lit("="), F.col("group")), F.lit("")))


def _climb(nodes: DataFrame, start: int, top: bool, fan: int) -> tuple[list[DataFrame], DataFrame, int]:
    """All levels above the nodes (group, pos, digest, node) of level start: tables of (node, up, path), the groups' roots as (group, node,
    digest), and how many levels there are."""
    steps, roots, level = [], None, start
    while True:
        runs = written(_runs(nodes, ["node"], fan), "nodes")
        ended = runs.filter("alone").select("group", F.col("kids")[0]["node"].alias("node"), F.col("kids")[0]["digest"].alias("digest"))
        roots = ended if roots is None else roots.unionByName(ended)
        going = runs.filter("not alone")
        if going.isEmpty():
            return steps, roots, level - start
        level += 1
        here = _key(level, top)
        kids = going.select(here.alias("up"), "joined", F.posexplode("kids").alias("place", "kid"))
        steps.append(kids.select(F.col("kid.node").alias("node"), "up", F.array(_segment(F.col("place"), top)).alias("path")))
        nodes = going.select("group", "pos", F.unhex(F.sha2(told("joined"), 256)).alias("digest"), here.alias("node"))


def _jump(steps: DataFrame, root: str, height: int) -> DataFrame:
    """(node, path): each node's segments all the way up to the root.

    Once nodes point d levels up, they are joined with those ancestors, of each of which at most fan ** d stand below: keys get hot only
    where ancestors are so few that they are broadcast.
    """
    distance = 1
    steps = written(steps, "steps")
    while distance < height:
        open_ = steps.filter(F.col("up") != root)
        over = open_.select("up").distinct()
        n = over.count()
        over = over.join(steps.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("path").alias("rest")), "up")
        over = F.broadcast(over) if n <= NODES else over
        moved = open_.join(over, "up").select("node", F.col("further").alias("up"), F.concat("path", "rest").alias("path"))
        steps = written(moved.unionByName(steps.filter(F.col("up") == root).select("node", "up", "path")), "steps")
        distance *= 2
    return steps.select("node", "path")


def proofs(df: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS, fan: int = FAN, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, group, leaf, path, subroot, root, carry...): each row's leaf (hex), the siblings from there to the root (left and right, digests
    joined as bytes, and whether they are of the tree over the groups), its group's root and the root. carry: columns made of a row's own.

    Texts are read once, for the leaves; what is shuffled is ids and digests.
    """
    carry = carry or {}
    own = [F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("group"), F.unhex(leaf_digest(fields)).alias("leaf")]
    rows = written(df.select(*own, *[c.alias(f"carry {n}") for n, c in carry.items()]), "leaves")
    kept = [f"carry {n}" for n in carry]
    placed = numbered(rows, ["id", "leaf"], "pos", ["group"])
    runs = written(_runs(placed.withColumn("digest", F.col("leaf")), ["id", *kept], fan), "runs")
    runs = runs.withColumn("node", F.when(F.col("alone"), _key(0)).otherwise(_key(1)))
    single = runs.filter("alone").select("group", "node", F.col("kids")[0]["digest"].alias("digest"))
    above = runs.filter("not alone").select("group", "pos", F.unhex(F.sha2(told("joined"), 256)).alias("digest"), "node")
    steps, roots, height = _climb(above, 1, False, fan)
    roots = numbered(roots.unionByName(single), ["group"], "pos")
    top, last, more = _climb(roots.select(F.lit("").alias("group"), "pos", "digest", "node"), 0, True, fan)
    root = last.first()
    if root is None:
        empty = f"id {{}}, group string, leaf string, path {_PATH}, subroot string, root string"
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        return df.sparkSession.createDataFrame([], empty.format(kinds["id"]) + "".join(f", `{n}` {kinds[f'carry {n}']}" for n in carry))
    none = F.array().cast(_PATH)
    named = runs.withColumn("above", none)
    if edges := [*steps, *top]:
        paths = _jump(reduce(DataFrame.unionByName, edges), root["node"], height + more)
        named = runs.join(paths.withColumnRenamed("path", "above"), "node", "left").withColumn("above", F.coalesce("above", none))
    here = F.when(F.col("alone"), told(F.col("kids")[0]["digest"])).otherwise(F.sha2(told("joined"), 256))
    named = named.withColumn("subroot", fold(here, F.filter("above", lambda s: ~s["top"])))
    leaves = named.select("group", "joined", "alone", "above", "subroot", F.posexplode("kids").alias("place", "kid"))
    path = F.when(F.col("alone"), F.col("above")).otherwise(F.concat(F.array(_segment(F.col("place"), False)), "above"))
    return leaves.select(
        F.col("kid.id").alias("id"), "group", told("kid.digest").alias("leaf"), path.alias("path"), "subroot", F.lit(bytes(root["digest"]).hex()).alias("root"),
        *[F.col("kid")[f"carry {n}"].alias(n) for n in carry],
    )


def proof_digest(path: Column | str) -> Column:
    """SHA-256 of all siblings' hex digests, level by level, left to right."""
    path = F.col(path) if isinstance(path, str) else path
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(told(s["left"]), told(s["right"]))), ""), 256)


def audit(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The manifest checked against a copy of the table in which every fifth row (by CRC-32 of its id) has its text's A-Z lower-cased:
    (id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    changed = F.when(tampered, F.unhex(leaf_digest([lower if f == "text" else f for f in FIELDS])))
    out = proofs(df, id_col, carry={"changed": changed})
    out = out.withColumn("folded_root", fold(F.coalesce(told("changed"), F.col("leaf")), F.col("path")))
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || {0} end"
_HASH = "sha256(" + " || ".join(_FIELD.format(f) for f in FIELDS) + ")"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Nodes of a level as a list; the next one hashes its runs.
_UP = f"list_transform(range(0, (len(l) + {FAN - 1}) // {FAN}), lambda i: sha256(array_to_string(l[i * {FAN} + 1 : i * {FAN} + {FAN}], '')))"
_RUN = f"l[p // {FAN} * {FAN} + 1 : p // {FAN} * {FAN} + {FAN}]"
_SIDES = f"array_to_string(({_RUN})[1 : p % {FAN}], '') as l_side, array_to_string(({_RUN})[p % {FAN} + 2 :], '') as r_side"
SQL = f"""
with recursive steps as (
  select i, list_reduce(list_prepend(i::bigint, range(8)),
    lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as v from range(256) r(i)),
crcs as (select list(v order by i) as tab from steps),
leaves as (
  select doc_id, source, {_HASH} as leaf, {_HASH.replace("|| text", f"|| {_LOWER}").replace("cast(text as", f"cast({_LOWER} as")} as changed,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(cast(doc_id as varchar))), '..'), lambda x: ('0x' || x)::bigint)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint) as crc
  from documents, crcs),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from leaves),
up as (
  select source, 0 as level, list(leaf order by pos) as l from placed group by source
  union all select source, level + 1, {_UP} from up where len(l) > 1),
subroots as (select source, l[1] as subroot, row_number() over (order by source nulls first) - 1 as s from up where len(l) = 1),
over_all as (
  select 0 as level, list(subroot order by s) as l from subroots
  union all select level + 1, {_UP} from over_all where len(l) > 1),
total as (select l[1] as root from over_all where len(l) = 1),
located as (select p.*, s.subroot, s.s, row_number() over () as n from placed p join subroots s on p.source is not distinct from s.source),
ways as (
  select n, 0 as part, level, {_SIDES} from (select n, u.level, u.l, cast(floor(pos / pow({FAN}, u.level)) as bigint) as p from located d join up u on d.source is not distinct from u.source where len(u.l) > 1)
  union all select n, 1 as part, level, {_SIDES} from (select n, u.level, u.l, cast(floor(s / pow({FAN}, u.level)) as bigint) as p from located d, over_all u where len(u.l) > 1)),
paths as (select n, string_agg(l_side || r_side, '' order by part, level) as proof, list(l_side || '|' || r_side order by part, level) as sides from ways group by n),
folded as (
  select d.*, t.root, coalesce(proof, '') as proof,
    list_reduce(list_prepend(case when crc % 5 = 0 then changed else leaf end, coalesce(sides, [])), lambda c, x: sha256(split_part(x, '|', 1) || c || split_part(x, '|', 2))) as folded_root
  from located d left join paths using (n), total t)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded_root, folded_root = root as verified from folded
"""
