"""Sharding by weighted rendezvous hashing.

Every shard draws an exponential with rate weight from the hash of (key, shard); the smallest draw takes the record.
The draw of one shard does not depend on the others, so one more shard takes rows only into itself, and shares follow the weights.

Defined cases: a null key is hashed as the empty string; a null text has size 8 and the CRC of the empty text; repeated
rows get the same shard and slots of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import positions, uniform52


def shards(df: DataFrame, n: int = 24, weights: list[float] | None = None, new_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): the shard among n, the place in it, and the shard with one more.

    Slots follow the hash of the key, then id, CRC and size. Nothing but (id, size, crc) is shuffled.
    """
    weights = list(weights or [1.0] * n)
    if len(weights) != n or min(weights) <= 0 or new_weight <= 0:
        raise ValueError("one positive weight for each shard is needed")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    out = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    draws = [(-F.log((uniform52(key, F.lit(str(i))) + F.lit(0.5)) / F.lit(2.0**52)) / F.lit(float(w))) for i, w in enumerate([*weights, new_weight])]
    out = out.withColumn("__draws", F.array(*draws)).withColumn("__best", F.array_min(F.slice("__draws", 1, n)))
    shard = (F.array_position("__draws", F.col("__best")) - 1).cast("int")
    out = out.withColumn("shard", shard).withColumn("grown_shard", F.when(F.col("__draws")[n] < F.col("__best"), F.lit(n)).otherwise(shard).cast("int")).drop("__draws", "__best")
    out = positions(out.withColumn("__key", uniform52(key)), ["shard"], "__key", ["id", "text_crc32", "size"], "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


SQL = """
with steps as (
  select i, list_reduce(list_prepend(i::bigint, range(8)),
    lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as v from range(256) r(i)),
crcs as (select list(v order by i) as tab from steps),
keyed as (
  select doc_id, cast(strlen(coalesce(text, '')) + 8 as bigint) as size, coalesce(cast(doc_id as varchar), '') as k,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint) as text_crc32
  from documents, crcs),
drawn as (
  select doc_id, size, text_crc32, k, s,
    -ln((cast('0x' || substr(md5(k || ':' || s), 1, 13) as bigint) + 0.5) / 4503599627370496.0) as draw
  from keyed, range(25) r(s)),
won as (
  select doc_id, size, text_crc32, k, arg_min(s, draw) filter (where s < 24) as shard, arg_min(s, draw) as grown_shard
  from drawn group by all)
select doc_id, size, text_crc32, 'key' as law, cast(shard as int) as shard, cast(grown_shard as int) as grown_shard,
  cast(row_number() over (partition by shard order by cast('0x' || substr(md5(k), 1, 13) as bigint), doc_id, text_crc32, size) - 1 as bigint) as slot
from won
"""
