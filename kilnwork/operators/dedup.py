"""Curation of raw pools: dates, duplicates, overlaps, ids, token budget. Wide rows are never ranked: narrow keys
are, and rows are fetched by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import shuffle_key
from ..functions.text import has_text
from .places import numbered


def filter_dates(df: DataFrame, start: str, end: str, origins: list[str] | None = None, date: str = "date", origin: str = "origin") -> tuple[DataFrame, DataFrame]:
    """F1. Rows in the range, both ends included, and counts. Of an invalid date, a wrong origin and a date outside, the first is the reason."""
    day = F.to_date(F.to_utc_timestamp(F.col(date).try_cast("timestamp"), F.current_timezone()))
    allowed = sorted({o.lower() for o in origins or []})
    wrong = ~F.lower(F.coalesce(F.col(origin), F.lit(""))).isin(allowed) if allowed else F.lit(False)
    reason = F.when(day.isNull(), "invalid_dates").when(wrong, "wrong_origin").when(~day.between(F.lit(start).cast("date"), F.lit(end).cast("date")), "outside_range")
    rows = df.withColumn("__reason", reason)
    of = lambda name: F.count_if(F.col("__reason") == name).alias(name)
    counts = rows.agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("__reason").isNull()).alias("after"), of("invalid_dates"), of("outside_range"), of("wrong_origin"))
    return rows.filter(F.col("__reason").isNull()).drop("__reason"), counts


def filter_tokens(df: DataFrame, most: int, code: str = "code", count: Column | str = "token_len", key: str = "sample_id", dataset: str = "dataset") -> tuple[DataFrame, DataFrame, DataFrame]:
    """F2. Rows with a code of at most so many tokens, the rejects with their reason, and counts by dataset."""
    rows = df.withColumn("__n", F.when(has_text(code), count if isinstance(count, Column) else F.col(count)).otherwise(0))
    rows = rows.withColumn("__reason", F.when(~has_text(code), "empty_code").when(F.col("__n") > most, "too_long"))
    rejects = rows.filter("__reason is not null").select(dataset, key, F.col("__n").alias("token_count"), F.col("__reason").alias("reason"))
    counts = rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("__reason").isNull()).alias("after"), F.count_if(F.col("__reason").isNotNull()).alias("rejected"), F.max("__n").alias("max_seen"))
    return rows.filter("__reason is null").drop("__n", "__reason"), rejects, counts


def first_occurrence(df: DataFrame, seed: int, key: str, code_hash: str = "code_hash") -> DataFrame:
    """W1. Of rows with equal hashes the first in shuffled order; all rows with an empty hash. The first is a minimum, combined
    before the shuffle: a hash of very many rows costs one a task."""
    first = df.filter(F.col(code_hash) != "").groupBy(F.col(code_hash).alias("__h")).agg(F.min(F.struct(shuffle_key(seed, key).alias("o"), F.col(key).alias("k"))).alias("__first"))
    chosen = first.select("__h", F.col("__first.k").alias("__k"))
    kept = df.join(chosen, (F.col(code_hash) == F.col("__h")) & (F.col(key) == F.col("__k")), "left_semi")
    return kept.unionByName(df.filter(F.coalesce(F.col(code_hash), F.lit("")) == ""))


def decontaminate(train: DataFrame, bench: DataFrame, code_hash: str = "code_hash") -> DataFrame:
    """J1. Train rows whose hash is not in bench; an empty hash never is."""
    keys = bench.filter(F.col(code_hash) != "").select(F.col(code_hash).alias("__h")).distinct()
    return train.join(keys, F.nullif(F.col(code_hash), F.lit("")) == F.col("__h"), "left_anti")


def hash_intersection(a: DataFrame, b: DataFrame, code_hash: str = "code_hash") -> DataFrame:
    """U2. Non-empty hashes of both."""
    own = lambda d: d.filter(F.col(code_hash) != "").select(code_hash)
    return own(a).intersect(own(b))


def duplicate_stats(df: DataFrame, code_hash: str = "code_hash") -> DataFrame:
    """A1. One row: groups, rows removed, groups of 2, 3, 4, 5 and more, largest group (1 if there is none)."""
    groups = df.filter(F.col(code_hash) != "").groupBy(code_hash).count().filter("count > 1")
    n = F.col("count")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(F.count(F.lit(1)).alias("groups"), total(n - 1).alias("rows_removed"), *[F.count_if(n == i).alias(f"exactly_{i}") for i in (2, 3, 4)], F.count_if(n >= 5).alias("five_or_more"), F.coalesce(F.max(n), F.lit(1)).cast("long").alias("largest"))


def cross_overlap_stats(train: DataFrame, bench: DataFrame, code_hash: str = "code_hash") -> DataFrame:
    """A2. One row: hashes of both pools, train rows with such a hash, unique train rows removed (one a hash)."""
    own = train.filter(F.col(code_hash) != "").groupBy(code_hash).agg(F.count(F.lit(1)).alias("n"))
    both = own.join(bench.select(code_hash).distinct(), code_hash, "left_semi")
    return both.agg(F.count(F.lit(1)).alias("matching_hashes"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("train_rows"), F.count(F.lit(1)).alias("unique_rows_removed"))


def assign_ids(df: DataFrame, source: str, raw: str, code_hash: str, tie: str) -> DataFrame:
    """W2. sample_id: source:id, with row-<place> for a missing id and :k:hash8 for the second and later of an id.

    Places count the rows without an id only, in order of tie: positions come from counts by range, not from one window.
    """
    name = F.trim(F.coalesce(F.col(raw).cast("string"), F.lit("")))
    missing = df.filter(name == "").select(F.col(tie).alias("__t"))
    places = numbered(missing, ["__t"], "__place")
    rows = df.join(places, F.when(name == "", F.col(tie)) == F.col("__t"), "left")
    base = F.concat(F.lit(f"{source}:"), F.when(name == "", F.concat(F.lit("row-"), F.lpad(F.col("__place").cast("string"), 9, "0"))).otherwise(name))
    rows = rows.withColumn("__base", base)
    k = F.row_number().over(Window.partitionBy("__base").orderBy(tie))
    rows = rows.withColumn("__k", k)
    return rows.withColumn("sample_id", F.when(F.col("__k") == 1, F.col("__base")).otherwise(F.concat_ws(":", "__base", F.col("__k").cast("string"), F.left(F.col(code_hash), F.lit(8))))).drop("__t", "__place", "__base", "__k")


def pipeline_funnel(stages: list[tuple[str, DataFrame, DataFrame]], dataset: str = "dataset") -> DataFrame:
    """A20. (stage, dataset, before, after, rejected)."""
    out = None
    for name, before, after in stages:
        n = before.groupBy(dataset).agg(F.count(F.lit(1)).alias("before")).join(after.groupBy(dataset).agg(F.count(F.lit(1)).alias("after")), dataset, "left")
        n = n.select(F.lit(name).alias("stage"), dataset, "before", F.coalesce("after", F.lit(0)).alias("after"), (F.col("before") - F.coalesce("after", F.lit(0))).alias("rejected"))
        out = n if out is None else out.unionByName(n)
    return out
