"""Training rows and the logs of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_structure, extract_document, has_text, normal_lines, render_instruction

IGNORED = -100


def message(role: str, text: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")))


def sft_rows(df: DataFrame, prompt: str, code: str = "code", description: str = "description", use_description: bool = True, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """R1. (key, prompt, completion, structure of the code) and the rows with a blank code."""
    out = df.withColumn("__code", extract_document(code))
    rows = out.filter(has_text("__code")).select(key, message("user", render_instruction(F.lit(prompt), description, use_description)).alias("prompt"), message("assistant", F.col("__code")).alias("completion"), code_structure("__code").alias("__s"))
    return rows.select(key, "prompt", "completion", "__s.*"), out.filter(~has_text("__code")).select(key, F.lit("empty_code").alias("reason"))


def rl_rows(df: DataFrame, prompt: str, code: str = "code", description: str = "description", use_description: bool = True, key: str = "sample_id") -> DataFrame:
    """R2. (key, prompt, answer, reference_key)."""
    return df.select(key, message("user", render_instruction(F.lit(prompt), description, use_description)).alias("prompt"), extract_document(code).alias("answer"), F.col(key).alias("reference_key"))


def mask_labels(df: DataFrame, prompt_ids: str = "prompt_ids", target_ids: str = "target_ids", eos: int = 1) -> DataFrame:
    """R3. df with input_ids, labels (the prompt's are ignored) and active_targets."""
    target = F.concat(F.col(target_ids), F.array(F.lit(eos)))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt_ids)), target)
    return df.withColumn("input_ids", F.concat(F.col(prompt_ids), target)).withColumn("labels", labels).withColumn("active_targets", F.size(F.filter("labels", lambda x: x != IGNORED)))


def _padded(c: str, n: Column, value: int) -> Column:
    return F.concat(F.col(c), F.array_repeat(F.lit(value), n - F.size(c)))


def pad_batches(df: DataFrame, batch: str, pad_id: int = 0) -> DataFrame:
    """R4. input_ids, attention_mask and labels padded on the right to the longest of the batch (a column)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    df = df.withColumn("__n", longest)
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), F.col("__n") - F.size("input_ids")))
    return df.withColumn("attention_mask", mask).withColumn("labels", _padded("labels", F.col("__n"), IGNORED)).withColumn("input_ids", _padded("input_ids", F.col("__n"), pad_id)).drop("__n")


def truncate_tokens(tokens: Column | str, n: int) -> Column:
    """R5."""
    return F.slice(tokens, 1, n)


def token_budget(df: DataFrame, most_prompt: int, most_target: int, prompt: str = "prompt_ids", target: str = "target_ids", key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """F9. Rows within both budgets, and the others with their reason."""
    reason = F.when(F.size(prompt) > most_prompt, "prompt_too_long").when(F.size(target) > most_target, "target_too_long")
    rows = df.withColumn("__reason", reason)
    return rows.filter("__reason is null").drop("__reason"), rows.filter("__reason is not null").select(key, F.size(prompt).alias("prompt_len"), F.size(target).alias("target_len"), F.col("__reason").alias("reason"))


def train_step_index(df: DataFrame, microbatch: str, accumulation: int) -> DataFrame:
    """W8. df with optimizer_step and accumulation_slot, both from 1."""
    at = F.col(microbatch) - 1
    return df.withColumn("optimizer_step", (F.floor(at / accumulation) + 1).cast("long")).withColumn("accumulation_slot", (F.pmod(at, F.lit(accumulation)) + 1).cast("int"))


def train_step_summary(log: DataFrame) -> DataFrame:
    """A17. By optimizer_step; of equally repetitive samples the first micro-batch's path."""
    rep = F.coalesce("normalized_line_repetition_ratio", F.lit(0.0))
    return log.groupBy("optimizer_step").agg(
        F.count(F.lit(1)).alias("samples"), F.avg(rep).alias("mean_line_repetition"), F.max(rep).alias("max_line_repetition"),
        F.max(F.coalesce("max_identical_normalized_line_run", F.lit(0))).alias("max_identical_normalized_line_run"), F.max(F.coalesce("active_targets", F.lit(0))).alias("max_active_targets"),
        F.max_by(F.coalesce("code_path", F.lit("")), F.struct(rep, -F.col("microbatch"))).alias("most_repetitive_code_path"),
    )


def generation_health(log: DataFrame) -> DataFrame:
    """A18. Rates by step."""
    rate = lambda c: F.avg(F.col(c).cast("int")).alias(f"{c}_rate")
    return log.groupBy("step").agg(rate("terminated_by_stop_token"), rate("hit_max_new_tokens"), rate("contains_end_document"), F.avg("normalized_line_repetition_ratio").alias("mean_line_repetition"))


def longest_runs(df: DataFrame, key: str, code: str = "code") -> DataFrame:
    """W9. (key, longest_run): of each sample the longest run of equal normal lines, over rows of lines; 0 without lines. key must be unique."""
    lines = df.select(key, F.posexplode(normal_lines(code)).alias("at", "line"))
    inside = Window.partitionBy(key).orderBy("at")
    new = F.coalesce(F.lag("line").over(inside) != F.col("line"), F.lit(True))
    runs = lines.withColumn("run", F.sum(new.cast("int")).over(inside)).groupBy(key, "run").count()
    longest = runs.groupBy(key).agg(F.max("count").alias("longest_run"))
    return df.select(key).join(longest, key, "left").select(key, F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run"))


def label_audit(rows: DataFrame, stop_ids: list[int], labels: str = "labels", mask: str = "attention_mask") -> DataFrame:
    """A19. One row: samples, those without a stop token among their targets, those whose padding has targets."""
    stop = F.arrays_overlap(labels, F.array(*[F.lit(i) for i in stop_ids]))
    padded = F.exists(F.zip_with(labels, mask, lambda x, m: (m == 0) & (x != IGNORED)), lambda x: x)
    return rows.agg(F.count(F.lit(1)).alias("samples"), F.count_if(~stop).alias("without_stop"), F.count_if(padded).alias("with_active_padding"))
