"""Mixing sources to target weights by Pfair scheduling.

A source with the share w of the mix gives its block j (from 0) the release time floor(j / w) and the deadline
ceil((j + 1) / w). Earliest deadline first over the released blocks meets every deadline, so after any number of slots
each source is less than one block from its target, however long the mix is and however small the source. Shares are the
target weights in units of 2**-50, so that they sum to one and times are exact in whole numbers.

Each slot follows from the one before, so the slots are scheduled in one pass on the driver, over numbers of blocks only. A
block is a 2**20th of the table, 8 rows at least, so the schedule has about as many slots whatever the size of the table, and more
where given weights are unlike the sources' sizes, by as often as the mix repeats them: the length is known before, and weights
that make it more than LONGEST blocks are an error. Rows are ranked and placed by Spark.

The mix ends with the slot in which the last source has given its last row; a source that is over earlier starts again
(epoch 1, 2, ...), so no row is left out and every prefix of the mix holds the target shares. A source with fewer rows
than its first block repeats them in it, so very many such sources make the mix up to a block's rows times as long.

Defined cases: a null source is a source of its own; rows without text are rows like others; repeated rows stay apart;
an empty table gives an empty mix; columns mix_pos, mix_epoch and mix_share of the table are replaced, all others kept. Sources missing from given weights have the weight 0 and are an error if they have rows.
"""

from __future__ import annotations

import heapq
from array import array

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import positions, uniform52

FRAME, BLOCK, POWER = 512, 8, 0.9
#: Blocks the table's rows are cut into, about: bounds the schedule, which is made on the driver (some 6 s and 16 MB) and broadcast.
BLOCKS = 1 << 20
#: Slots that are scheduled: weights that make the mix longer are refused (some 20 s of the driver's time).
LONGEST = 1 << 23
UNITS = 1 << 50
_NULL = "\u0000null"


def _name(source: str) -> Column:
    return F.coalesce(F.col(source).cast("string"), F.lit(_NULL))


def _shares(sizes: dict[str, int], weights: dict[str, float] | None, power: float) -> dict[str, int]:
    """Units of each source, by name; they sum to UNITS. What rounding leaves goes to the largest: at most half a unit a source."""
    if weights is None:
        own = {s: float(n) ** power for s, n in sizes.items()}
    else:
        if not weights or min(weights.values()) <= 0:
            raise ValueError("weights must be positive")
        if missing := sorted(sizes.keys() - {str(s) for s in weights}):
            raise ValueError(f"no weight for source {missing[0].replace(_NULL, 'null')}")
        given = {str(s): float(w) for s, w in weights.items()}
        own = {s: given[s] for s in sizes}
    total = sum(own.values())
    shares = {s: max(1, round(w / total * UNITS)) for s, w in sorted(own.items())}
    if shares:
        shares[max(shares, key=shares.__getitem__)] += UNITS - sum(shares.values())
    return shares


def schedule(shares: list[int], needed: list[int]) -> list[array]:
    """The slots of each source's blocks, until each has given as many as it needs: earliest deadline first, ties by place in the list."""
    slots = [array("q") for _ in shares]
    waiting, ready = [(0, i) for i in range(len(shares))], []
    left, t = len(shares), 0
    while left:
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * UNITS // shares[i]), i))
        i = heapq.heappop(ready)[1]
        slots[i].append(t)
        left -= len(slots[i]) == needed[i]
        t += 1
        heapq.heappush(waiting, (len(slots[i]) * UNITS // shares[i], i))
    return slots


def _frames(spark: SparkSession, slots: list[array], frame: int) -> DataFrame:
    """(__h, __frame, __slots): the slots of a source's blocks, so many in a row."""
    rows = [(i, k, s[k * frame : (k + 1) * frame].tolist()) for i, s in enumerate(slots) for k in range(-(-len(s) // frame))]
    return F.broadcast(spark.createDataFrame(rows, "__h int, __frame long, __slots array<long>"))  # LONGEST bounds it


def mix(df: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, frame: int = FRAME, block: int | None = None, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of df with mix_pos (long, from 0, gapless), mix_epoch (int) and mix_share (double, the target of its source).

    weights: by source; None: the number of rows to the given power. Rows of a source come in order of the hash of (seed, id).
    frame: blocks of a source in a row of the schedule as it is sent to Spark; the mix does not depend on it.
    block: rows of a block; None: as many as cut the table into BLOCKS blocks, BLOCK at least.
    """
    if frame < 1 or (block is not None and block < 1):
        raise ValueError("frame and block must be positive")
    spark, df = df.sparkSession, df.drop("mix_pos", "mix_epoch", "mix_share")
    rows = df.withColumn("__group", _name(source_col)).withColumn("__key", uniform52(F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sizes = {r["__group"]: r["n"] for r in rows.groupBy("__group").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a source
    block = block or max(BLOCK, -(-sum(sizes.values()) // BLOCKS))
    shares = _shares(sizes, weights, power)
    needed = [-(-sizes[s] // block) for s in shares]
    if (length := max((n * UNITS // a for n, a in zip(needed, shares.values(), strict=True)), default=0)) > LONGEST:
        raise ValueError(f"with these weights the mix has {length} blocks of {block} rows, more than {LONGEST}: a source's weight is too small for its rows")
    slots = schedule(list(shares.values()), needed)
    groups = F.broadcast(spark.createDataFrame([(s, i, sizes[s], len(slots[i]), a / UNITS) for i, (s, a) in enumerate(shares.items())], "__name string, __g int, __size long, __blocks long, mix_share double"))
    ranked = positions(rows, ["__group"], "__key", [F.col(id_col)], "__rank")
    mixed = ranked.join(groups, F.col("__group") == F.col("__name"))
    epochs = F.ceil((F.col("__blocks") * block - F.col("__rank")) / F.col("__size")).cast("int")
    mixed = mixed.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.greatest(epochs - 1, F.lit(0)))))
    mixed = mixed.withColumn("__number", F.col("__rank") + F.col("mix_epoch") * F.col("__size")).withColumn("__nth", F.floor(F.col("__number") / block))
    mixed = mixed.join(_frames(spark, slots, frame), (F.col("__g") == F.col("__h")) & (F.floor(F.col("__nth") / frame) == F.col("__frame")))
    slot = F.element_at("__slots", (F.pmod("__nth", F.lit(frame)) + 1).cast("int"))
    mixed = mixed.withColumn("mix_pos", (slot * block + F.pmod("__number", F.lit(block))).cast("long"))
    return mixed.select(*[F.col(c) for c in df.columns], "mix_pos", "mix_epoch", "mix_share")
