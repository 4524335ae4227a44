"""Reading and writing tables of samples."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored


@dataclass(frozen=True)
class SourceSpec:
    """A pool's name and its columns by role; a role without a column is None."""

    name: str
    id: str | None = None
    code: str | None = None
    image: str | None = None
    source: str | None = None
    date: str | None = None

    def roles(self) -> dict[str, str]:
        return {r: c for r in ("id", "code", "image", "source", "date") if (c := getattr(self, r))}


def check_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def mapped(df: DataFrame, spec: SourceSpec) -> DataFrame:
    check_columns(df, list(spec.roles().values()))
    return df.select(*[F.col(c).alias(r) for r, c in spec.roles().items()], F.lit(spec.name).alias("dataset"))


def read_samples(spark: SparkSession, path: str, spec: SourceSpec) -> DataFrame:
    """S1. All Parquet files below path; only the mapped columns, under their roles, are read."""
    return mapped(spark.read.option("recursiveFileLookup", True).parquet(path), spec)


def read_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """S2. The folder named like the split; else the files with its name in their path below root; else all files."""
    everything = spark.read.option("recursiveFileLookup", True).parquet(root)
    path = F.lower(F.substring_index(F.col("_metadata.file_path"), root.rstrip("/").split("://")[-1].rstrip("/") + "/", -1))
    split = split.lower()
    for fits in (path.startswith(f"{split}/"), path.contains(split)):
        part = everything.filter(fits)
        if not part.isEmpty():
            return part
    return everything


def resolve_code_column(df: DataFrame, candidates: tuple[str, ...] = ("reference_code", "code", "tikz_code")) -> str:
    """S3. The first of the candidates that df has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {', '.join(candidates)} is a column")


def read_manifest(spark: SparkSession, path: str, required: list[str], limit: int | None = None, key: str | None = None) -> DataFrame:
    """S4. A CSV with header, all columns strings; a byte order mark is no part of a name. limit: the first rows by key. An error if there is no row."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = check_columns(df.toDF(*[c.lstrip("\ufeff") for c in df.columns]), required)
    if limit is not None:
        df = df.orderBy(key or df.columns[0]).limit(limit)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def normalize_path(c: Column | str, base: str, roots: dict[str, str]) -> Column:
    """S5. Without file://; below an old root: below its new one; relative: below base."""
    c = F.col(c) if isinstance(c, str) else c
    p = F.regexp_replace(c, "\\Afile://", "")
    out = F.when(~p.startswith("/"), F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(p, "\\A(?:\\./)+", ""))).otherwise(p)
    for old, new in roots.items():
        old = old.rstrip("/")
        out = F.when((p == old) | p.startswith(old + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(p, F.lit(len(old) + 1), F.length(p)))).otherwise(out)
    return out


def row_bytes(df: DataFrame) -> Column:
    """Estimated bytes of a row's strings, binaries and other fields."""
    total = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType
        size = F.octet_length(f.name) if isinstance(kind, (T.StringType, T.BinaryType)) else F.octet_length(F.to_json(F.struct(f.name))) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total.cast("long")


#: Shards of a range of rows that one task packs, about, and ranges whose borders may be broadcast.
PER_RANGE, BROADCAST_ROWS = 16, 20_000


def packed(sizes: list[int], most: int) -> list[int]:
    """Where new shards begin when rows are put one after the other into shards of at most most bytes."""
    starts, held = [], None
    for i, size in enumerate(sizes):
        if held is None or held + size > most:
            starts.append(i)
            held = 0
        held += size
    return starts


def with_shards(df: DataFrame, most: int, key: str, split: str = "split") -> DataFrame:
    """df with shard (by split, from 0) and shard_bytes: rows are put into a shard until the next would not fit. Rows of one key stay together.

    Each of many ranges of the key's hash, of about PER_RANGE shards, is packed by itself, from (key, bytes) alone, so one shard in
    PER_RANGE + 1 is not full. A range tells the keys its shards begin with, and a row finds its shard among those of its range.
    """
    rows = df.withColumn("__bytes", row_bytes(df))
    sizes = rows.groupBy(F.col(split).alias("__s")).agg(F.sum("__bytes").alias("sum"), F.max("__bytes").alias("top"))
    sizes = stored(sizes.select("__s", "top", F.greatest(F.lit(1), F.round(F.col("sum") / (PER_RANGE * most))).cast("long").alias("__n")), "splits")
    if not sizes.filter(F.col("top") > most).isEmpty():
        raise ValueError("a row is larger than a shard may be")
    few = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    rows = rows.join(few(sizes.drop("top")), F.col(split).eqNullSafe(F.col("__s"))).withColumn("__range", F.pmod(F.xxhash64(key), F.col("__n"))).drop("__n")

    def borders(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group["k"], null_placement="at_start"))
        sizes = group["bytes"].to_pylist()
        if max(sizes) > most:
            raise ValueError("rows of one key are larger than a shard may be")
        return pa.table({"s": group["s"][:1], "r": group["r"][:1], "firsts": pa.array([group["k"].take(pa.array(packed(sizes, most))).to_pylist()], pa.list_(group["k"].type))})

    held = rows.groupBy(F.col("__s").alias("s"), F.col("__range").alias("r"), F.col(key).alias("k")).agg(F.sum("__bytes").alias("bytes"))
    found = held.groupBy("s", "r").applyInArrow(borders, T.StructType([T.StructField("s", df.schema[split].dataType), T.StructField("r", T.LongType()), T.StructField("firsts", T.ArrayType(df.schema[key].dataType))]))
    found = stored(found, "borders")
    before = F.coalesce(F.sum(F.size("firsts")).over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = found.withColumn("__start", before)
    rows = rows.join(few(starts), F.col("__s").eqNullSafe(F.col("s")) & (F.col("__range") == F.col("r")))
    inside = F.size(F.filter("firsts", lambda f: f.isNull() | (f <= F.col(key)))) - 1
    rows = rows.withColumn("shard", (F.col("__start") + F.when(F.col(key).isNull(), F.lit(0)).otherwise(inside)).cast("int"))
    return rows.withColumnRenamed("__bytes", "shard_bytes").drop("__range", "__s", "__start", "s", "r", "firsts")


def shard_manifest(df: DataFrame, split: str = "split") -> DataFrame:
    """S7. (split, shard, rows, bytes) of rows with shard and shard_bytes."""
    return df.groupBy(split, "shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("shard_bytes").alias("bytes"))


def write_shards(df: DataFrame, path: str, most: int, key: str, split: str = "split") -> DataFrame:
    """S6. zstd Parquet below path/split=.../shard=..., one file a shard of at most so many estimated bytes; returns the manifest."""
    rows = with_shards(df, most, key, split)
    rows.drop("shard_bytes").repartition(split, "shard").write.partitionBy(split, "shard").option("compression", "zstd").parquet(path)
    return shard_manifest(rows, split)


#: Fixed names: columns of the manifest.
MANIFEST = ["sample_id", "input_image", "reference_image", "llm_description", "llm_description_source", "reference_code", "class", "repetition_class", "token_len", "source", "type"]


def export_manifest(df: DataFrame, path: str | None = None) -> DataFrame:
    """S8. The manifest's columns, missing ones empty; written as CSV if there is a path."""
    out = df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in MANIFEST])
    if path:
        out.write.option("escape", '"').csv(path, header=True)
    return out


def read_jsonl_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S9. JSON lines; blank ones are skipped, no file is an empty log."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def fetch_rows(wide: DataFrame, keys: DataFrame, columns: list[str], key: str = "sample_id") -> DataFrame:
    """S10. key and payload columns of the chosen keys. Spark broadcasts the keys if they are few enough."""
    return wide.select(key, *columns).join(keys.select(key).distinct(), key, "left_semi")
