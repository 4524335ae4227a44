"""Gapless places in an order, of a whole table or inside groups of any size: no task ranks a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def numbered(df: DataFrame, order: list[str], out: str, groups: list[str] | None = None) -> DataFrame:
    """df with out: the place (long, from 0) of each row in its group, by order.

    Rows are sorted into ranges of (groups, order) and written once with their range's number; each is numbered in its range, and a range
    goes on where those before it end. Only counts by group and range are summed over a group. Ties are numbered in any order.
    """
    groups = groups or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.repartitionByRange(n, *groups, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*groups, "__range").count().withColumn("__start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    starts = starts.select(*[F.col(g).alias(f"__s{i}") for i, g in enumerate(groups)], F.col("__range").alias("__r"), "__start")
    on = F.col("__range") == F.col("__r")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__s{i}"))
    inside = F.row_number().over(Window.partitionBy(*groups, "__range").orderBy(*order)) - 1
    out_of = rows.withColumn("__inside", inside).join(starts, on)
    return out_of.withColumn(out, (F.col("__start") + F.col("__inside")).cast("long")).drop("__range", "__r", "__inside", "__start", *[f"__s{i}" for i in range(len(groups))])
