"""From generated samples to scores and profiles of providers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helpers import neutralize_labels, token_edit_distance
from ..functions.scores import PASS_AT, relative_length, score_result
from ..functions.text import tokenize_code
from .ngrams import bleu_of, crystal_bleu
from .quantile import exact_quantiles


def pair_generations(refs: DataFrame, gens: DataFrame, key: str = "test_id") -> DataFrame:
    """J5. Every test case with each provider's output and repeat."""
    return refs.join(gens, key)


def score_pairs(df: DataFrame, metrics: Mapping[str, Column], keys: list[str], thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """X1. (keys..., metric, score, pass, reason): each metric is a column, a pandas UDF's too; thresholds as given or the fixed ones."""
    at = {**PASS_AT, **(thresholds or {})}
    rows = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), score_result(c, at[m], m).alias("r")) for m, c in metrics.items()])).alias("x"))
    return rows.select(*keys, "x.metric", "x.r.score", "x.r.pass", "x.r.reason")


def text_scores(pairs: DataFrame, keys: list[str], reference: str, generated: str, shared: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """X1 with the metrics of the texts themselves: (keys..., metric, score, pass, reason) for crystalbleu (M2), ted (M3, as 1 / (1 + the distance's
    share of the reference's tokens)) and relative_length (M4). What cannot be measured has score 0 and fails. No shuffle."""
    rows = pairs.withColumns({"__r": tokenize_code(reference), "__g": tokenize_code(generated)})
    rows = rows.withColumns({"__far": token_edit_distance("__r", "__g") / F.size("__r"), "__bleu": bleu_of("__r", "__g", shared)})
    metrics = {"crystalbleu": F.col("__bleu"), "ted": F.when(F.size("__r") > 0, 1 / (1 + F.col("__far"))), "relative_length": relative_length(reference, generated)["similarity"]}
    return score_pairs(rows, metrics, keys, thresholds)


def text_neutral_metrics(pairs: DataFrame, key: str, reference: str, generated: str, shared: DataFrame, mode: str = "replace_sequential") -> DataFrame:
    """M9. (key, crystalbleu, distance, reference_tokens, similarity): BLEU, token edit distance and relative length of each pair, with the labels of both
    sides neutralised first. key must be unique."""
    rows = pairs.select(key, *[neutralize_labels(c, mode).alias(x) for c, x in ((reference, "r"), (generated, "g"))])
    bleu = crystal_bleu(rows, key, "r", "g", shared)
    own = rows.select(key, tokenize_code("r").alias("rt"), tokenize_code("g").alias("gt"), relative_length("r", "g")["similarity"].alias("similarity"))
    own = own.select(key, token_edit_distance("rt", "gt").alias("distance"), F.size("rt").alias("reference_tokens"), "similarity")
    return bleu.join(own, key)


def provider_means(scores: DataFrame) -> DataFrame:
    """A12. Mean score and pass rate by provider and metric; a failed result counts with 0."""
    return scores.groupBy("provider", "metric").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"), F.avg(F.coalesce("pass", F.lit(False)).cast("int")).alias("pass_rate"), F.count(F.lit(1)).alias("results"))


def quantiles_by(df: DataFrame, groups: list[str], column: str, at: list[float], exact: bool = True) -> DataFrame:
    """(groups..., q): array<double>. Those that are not exact are right to a ten-thousandth of the ranks, by one pass."""
    if exact:
        return exact_quantiles(df, groups, column, at)
    return df.groupBy(*groups).agg(F.percentile_approx(F.col(column).cast("double"), at, 10_000).alias("q"))


def _beside(df: DataFrame, other: DataFrame, groups: list[str]) -> DataFrame:
    """df with the columns of other, a row a group: null groups too."""
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return df.join(other.withColumnsRenamed({g: f"__{g}" for g in groups}), same, "left").drop(*[f"__{g}" for g in groups])


def score_distribution(scores: DataFrame, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """A13. Median, quartiles and whiskers by provider and metric, and the rows beyond the whiskers. exact: see quantiles_by."""
    box = quantiles_by(scores, ["provider", "metric"], "score", [0.25, 0.5, 0.75], exact)
    box = box.select("provider", "metric", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    far = 1.5 * (F.col("q3") - F.col("q1"))
    box = box.withColumn("low", F.col("q1") - far).withColumn("high", F.col("q3") + far)
    beyond = scores.join(F.broadcast(box), ["provider", "metric"]).filter(~F.col("score").between(F.col("low"), F.col("high")))  # one row a provider and metric
    return box, beyond


def combined_score(scores: DataFrame, keys: list[str], lower_is_better: list[str] | None = None) -> DataFrame:
    """A14. (keys..., combined): mean of the metrics after scaling each to [0, 1] over all results; a constant metric counts for nothing."""
    ends = scores.groupBy("metric").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    x = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    x = F.when(F.col("metric").isin(lower_is_better or []), 1 - x).otherwise(x)
    return scores.join(F.broadcast(ends), "metric").groupBy(*keys).agg(F.avg(x).alias("combined"))  # one row a metric


def best_and_worst(combined: DataFrame, k: int, ties: list[str]) -> DataFrame:
    """O5. The k best and the k worst results of each provider, with end and place."""
    out = None
    for end, first in (("best", F.col("combined").desc_nulls_last()), ("worst", F.col("combined").asc_nulls_last())):
        place = F.row_number().over(Window.partitionBy("provider").orderBy(first, *ties))
        part = combined.withColumn("place", place).filter(F.col("place") <= k).withColumn("end", F.lit(end))
        out = part if out is None else out.unionByName(part)
    return out


def most_repetitive(df: DataFrame, k: int = 50, key: str = "sample_id") -> DataFrame:
    """O4."""
    return df.orderBy(F.col("repetition_score").desc(), key).limit(k)


def describe_by(df: DataFrame, by: str, columns: list[str], exact: bool = True) -> DataFrame:
    """A11. (by, column, count, mean, std, min, q1, median, q3, max). exact: see quantiles_by."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = df.select(by, F.expr(f"stack({len(columns)}, {pairs}) as (column, x)"))
    told = long.groupBy(by, "column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    told = _beside(told, quantiles_by(long, [by, "column"], "x", [0.25, 0.5, 0.75], exact), [by, "column"])
    return told.select(by, "column", "count", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def reward_summary(records: DataFrame, by: str = "step") -> DataFrame:
    """A15. Means of all numeric columns by step; nulls do not count."""
    columns = [f.name for f in records.schema.fields if f.name != by and f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    return records.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def group_advantage(records: DataFrame, group: str, reward: str = "total_score") -> DataFrame:
    """A16. df with advantage: the reward less the mean of its group, not scaled."""
    mean = records.groupBy(F.col(group).alias("__g")).agg(F.avg(reward).alias("__mean"))
    return records.join(mean, F.col(group).eqNullSafe(F.col("__g"))).withColumn("advantage", F.col(reward) - F.col("__mean")).drop("__g", "__mean")
