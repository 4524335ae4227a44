"""Gapless positions inside groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, small, written


def uniform52(*parts: Column | str) -> Column:
    """An integer in [0, 2**52), uniform, from the MD5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def positions(df: DataFrame, groups: list[str], key: str, ties: list[str | Column], out: str) -> DataFrame:
    """df with out: the place from 0 of each row in its group, by key (uniform52), then ties.

    A group is split by the leading bits of key into as many buckets as make every task small; rows are ranked in their
    bucket, and a bucket starts where those before it end. Only counts by group and bucket are summed over a group. They are counted
    themselves, so that rows aren't shuffled again to meet them while they are few.
    """
    buckets = 4 * partitions(df.sparkSession)
    df = df.withColumn("__bucket", F.floor(F.col(key) * F.lit(buckets) / F.lit(2.0**52)).cast("int"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*groups, "__bucket").count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__bucket").alias("__b"), "__start")
    )
    starts = written(starts, "starts")
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    on = F.col("__bucket") == F.col("__b")
    for s in same:
        on = on & s
    inside = Window.partitionBy(*groups, "__bucket").orderBy(key, *ties)
    df = df.withColumn("__row", F.row_number().over(inside) - 1)
    return df.join(small(starts, starts.count()), on).withColumn(out, (F.col("__start") + F.col("__row")).cast("long")).drop("__bucket", "__row", "__b", "__start", *[f"__g{i}" for i in range(len(groups))])
