"""The queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.views import table
from . import bpe, doubling, lattice, merkle, minhash, mixing, negatives, phrases, quality, secrets, sharding, syncmers, warc


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def tokenizer_path() -> str:
    """The public vocabulary of op 4; a worker finds its own copy."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(table(spark, sf_dir, "documents"), kept=False)


def op8_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.remove_repeats(table(spark, sf_dir, "documents"), spans=False)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 24)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.shifted(table(spark, sf_dir, "embeddings")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_lattice": op2_lattice,
    "op3_mixing": op3_mixing,
    "op4_bpe": op4_bpe,
    "op5_quality": op5_quality,
    "op6_minhash": op6_minhash,
    "op7_phrases": op7_phrases,
    "op8_doubling": op8_doubling,
    "op9_sharding": op9_sharding,
    "op10_secrets": op10_secrets,
    "op11_negatives": op11_negatives,
    "op12_warc": op12_warc,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {
    "op2_lattice": lattice.SQL,
    "op6_minhash": minhash.SQL,
    "op7_phrases": phrases.SQL,
    "op8_doubling": doubling.SQL,
    "op9_sharding": sharding.SQL,
    "op11_negatives": negatives.SQL,
    "op12_warc": warc.SQL,
    "op13_merkle": merkle.SQL,
}
