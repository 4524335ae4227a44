"""Exact quantiles of groups of any size, without a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Different values of a bracket that one task orders; ranks of a group to a share of which a first guess is right.
CELLS, ACCURACY = 500_000, 10_000
#: Brackets that may be broadcast, once they are counted.
BROADCAST_ROWS = 200_000


def _guessed(rows: DataFrame, groups: list[str], at: list[Column], wide: float) -> Column:
    """array<double>: values a little below and above each quantile, to within ACCURACY."""
    own = [x for p in at for x in (F.greatest(p - wide, F.lit(0.0)), F.least(p + wide, F.lit(1.0)))]
    return F.percentile_approx("__x", F.array(*own), ACCURACY)


def exact_quantiles(df: DataFrame, groups: list[str], column: str, at: list[float]) -> DataFrame:
    """(groups..., q): array<double>, the quantiles of a group's values, between two values in proportion; nulls do not count, NaN is
    the largest; a group without values is not there.

    Each quantile starts with a bracket of values from a summary of bounded size. Rows in a bracket are counted by value, those below it as
    one, both before the shuffle. A bracket that turns out to miss its rank is opened to all values, one with more than CELLS different values is
    narrowed to a part or two of them (at least halved, so this ends); the others are ordered by one task each.
    """
    rows = df.select(*groups, F.col(column).cast("double").alias("__x")).filter("__x is not null")
    names = [f"__g{i}" for i in range(len(groups))]
    same = F.lit(True)
    for g, n in zip(groups, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    first = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), _guessed(rows, groups, [F.lit(float(p)) for p in at], 2 / ACCURACY).alias("guess"))
    want = F.explode(F.array(*[F.struct(F.lit(i).alias("want"), F.lit(float(p)).alias("p"), F.col("guess")[2 * i].alias("a"), F.col("guess")[2 * i + 1].alias("b")) for i, p in enumerate(at)]))
    open_ = first.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], "n", want.alias("w")).select(*names, "n", "w.*")
    place = F.col("p") * (F.col("n") - 1)
    open_ = stored(open_.withColumn("low", F.floor(place)).withColumn("high", F.ceil(place)).withColumn("share", place - F.floor(place)), "brackets")
    done = []
    while n := open_.count():
        held = F.broadcast(open_) if n <= BROADCAST_ROWS else open_
        cell = F.when(F.col("__x") >= F.col("a"), F.col("__x"))
        cells = stored(rows.join(held, same).filter(F.col("__x") <= F.col("b")).groupBy(*names, "want", cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows")), "cells")
        below = F.coalesce(F.sum(F.when(F.col("cell").isNull(), F.col("rows"))), F.lit(0))
        told = cells.groupBy(*names, "want").agg(below.alias("below"), F.sum("rows").alias("reach"), F.count("cell").alias("width"))
        on = [F.col(f"t.{x}").eqNullSafe(F.col(f"o.{x}")) for x in [*names, "want"]]
        both = on[0]
        for c in on[1:]:
            both = both & c
        state = stored(open_.alias("o").join(told.alias("t"), both, "left").select("o.*", "below", "reach", "width"), "state")
        missed = F.col("reach").isNull() | (F.col("below") > F.col("low")) | (F.col("reach") <= F.col("high"))
        fits = ~missed & (F.col("width") <= CELLS)
        ready = state.filter(fits)
        c = cells.alias("c").join(F.broadcast(ready.select(*[F.col(x).alias(f"r_{x}") for x in [*names, "want"]], "low", "high", "share")) if n <= BROADCAST_ROWS else ready.select(*[F.col(x).alias(f"r_{x}") for x in [*names, "want"]], "low", "high", "share"), _all_same([*names, "want"]))
        ahead = F.sum("rows").over(Window.partitionBy(*names, "want").orderBy(F.col("cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
        c = c.withColumn("ahead", ahead)
        value = lambda rank: F.min(F.when(F.col("ahead") > F.col(rank), F.col("cell")))
        got = c.groupBy(*names, "want").agg(value("low").alias("x"), value("high").alias("y"), F.first("share").alias("share"))
        done.append(stored(got.select(*names, "want", F.when(F.col("share") == 0, F.col("x")).otherwise(F.col("x") + (F.col("y") - F.col("x")) * F.col("share")).alias("q")), "found"))
        lost = state.filter(missed).withColumns({"a": F.lit(float("-inf")), "b": F.lit(float("nan"))})
        over = state.filter(~missed & (F.col("width") > CELLS))
        columns = [*names, "n", "want", "p", "a", "b", "low", "high", "share"]
        nxt = lost.select(*columns)
        if not over.isEmpty():
            nxt = nxt.unionByName(_narrowed(cells, over, names, columns))
        open_ = stored(nxt, "brackets")
    empty = open_.select(*names, "want", F.lit(None).cast("double").alias("q"))
    found = empty
    for d in done:
        found = found.unionByName(d)
    q = F.transform(F.sort_array(F.collect_list(F.struct("want", "q"))), lambda s: s["q"])
    return found.groupBy(*names).agg(q.alias("q")).withColumnsRenamed(dict(zip(names, groups, strict=True)))


#: Parts into which a bracket's different values are cut.
PARTS = 200


def _narrowed(cells: DataFrame, over: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """Brackets around the parts of over's values that hold the ranks: a part has so many different values, however often they occur."""
    keys = [*names, "want"]
    own = cells.join(over.select(*[F.col(x).alias(f"r_{x}") for x in keys], "low", "high", "below", *[c for c in columns if c not in (*keys, "low", "high")]), _all_same(keys))
    own = own.filter("cell is not null").select(*columns, "below", "cell", "rows")
    cuts = own.groupBy(*keys).agg(F.percentile_approx("cell", F.array(*[F.lit(i / PARTS) for i in range(PARTS + 1)]), ACCURACY).alias("cuts"))
    cuts = cuts.select(*[F.col(x).alias(f"r_{x}") for x in keys], "cuts")
    part = F.size(F.filter("cuts", lambda v: v < F.col("cell")))
    held = [c for c in columns if c not in (*keys, "a", "b")]
    parts = own.join(cuts, _all_same(keys)).groupBy(*keys, *held, "below", part.alias("part")).agg(F.sum("rows").alias("rows"), F.min("cell").alias("least"), F.max("cell").alias("most"))
    ahead = F.col("below") + F.sum("rows").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("ahead", ahead)
    ends = [F.min(F.when(F.col("ahead") > F.col("low"), F.col("least"))).alias("a"), F.min(F.when(F.col("ahead") > F.col("high"), F.col("most"))).alias("b")]
    return parts.groupBy(*keys, *held).agg(*ends).select(*columns)


def _all_same(columns: list[str]) -> Column:
    out = F.lit(True)
    for x in columns:
        out = out & F.col(x).eqNullSafe(F.col(f"r_{x}"))
    return out
