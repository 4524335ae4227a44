"""The corpus pipeline: quality, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.llm import bpe, minhash, mixing, quality, queries, secrets
from kilnwork.llm.common import small, written
from kilnwork.plans.paths import ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays.

    Ids stay or go as a whole: of rows with one id and different texts all stay if one does. Of rows with one id and one text, null ids
    included, one stays, the first by its other columns. Null, empty and blank texts are near-duplicates of nothing.
    """
    ids = minhash.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__n"))
    ids = written(ids.filter("__kept and doc_id is not null").select(F.col("doc_id").alias("__id"), "__n"), "kept-ids")
    n = ids.count()  # few enough ids go to the texts, else texts are shuffled by id
    rows = lambda which: docs.join(small(ids.filter(which), n), F.col("doc_id") == F.col("__id"), "left_semi")
    several = rows("__n > 1").unionByName(docs.filter("doc_id is null"))
    # a minimum is combined before the shuffle: a row that occurs very often costs one a task, and rows of one text carry it once
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = [F.min(F.struct(*others)).alias("__first")] if others else []
    group = several.groupBy("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text").isNull()).agg(F.first("text").alias("text"), *first)
    one = group.select(*[F.col(f"__first.{c}").alias(c) if c in others else F.col(c) for c in docs.columns])
    return rows("__n = 1").unionByName(one)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(out.schema["n_chars"].dataType)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the shares of their target weights: those that are over early start again, no document is left out.

    Rows are sorted over the whole table, so the order of the files and of the rows in them is the mix. Columns of docs with the
    names of the mix's own are kept as they are.
    """
    own = [c for c in docs.columns if c in ("mix_pos", "mix_epoch", "mix_share")]
    mix = mixing.mix(docs.withColumnsRenamed({c: f"{c} of docs" for c in own})).orderBy("mix_pos")
    return mix.drop("mix_pos", "mix_epoch", "mix_share").withColumnsRenamed({f"{c} of docs": c for c in own}).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to, by digest."""
    return bpe.encode(docs, queries.tokenizer_path())


STAGES = [("quality", good), ("near duplicates", single), ("secrets", clean), ("mixing", mixed), ("bpe", tokens)]
#: The classifier and the tokenizer can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
