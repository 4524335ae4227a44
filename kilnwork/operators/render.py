"""Results of an external renderer, given as tables of attempts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMED_OUT = 124


def pick_render_attempt(attempts: DataFrame, key: str = "sample_id", order: str = "attempt", strict: bool = True) -> DataFrame:
    """W3. (key, success, reason, attempt, pages, errors, warnings, badboxes) of each sample.

    Columns of an attempt: order, returncode, pdf_created, pages, errors, warnings, badboxes. The first attempt with a PDF decides; strict
    (curation): one that timed out never succeeds, and a PDF of more than one page ends the search with multipage_pdf. Otherwise
    (evaluation): a PDF after a time-out counts, one of more pages is one more failure. Without a success: latex_timeout if any attempt timed out, else
    render_failed, with the last attempt's figures.
    """
    pdf = F.col("pdf_created") & ((F.col("returncode") != TIMED_OUT) if strict else F.lit(True))
    ends = pdf if strict else pdf & (F.col("pages") == 1)
    row = F.struct(F.col(order).alias("attempt"), "pages", "errors", "warnings", "badboxes")
    out = attempts.groupBy(key).agg(F.min_by(F.when(ends, row), F.when(ends, F.col(order))).alias("first"), F.max_by(row, F.col(order)).alias("last"), F.bool_or(F.col("returncode") == TIMED_OUT).alias("late"))
    good = F.col("first").isNotNull() & (F.col("first.pages") == 1)
    reason = F.when(good, F.lit(None)).when(F.col("first").isNotNull(), "multipage_pdf").when(F.col("late"), "latex_timeout").otherwise("render_failed")
    return out.select(key, good.alias("success"), reason.alias("reason"), F.coalesce("first", "last").alias("x")).select(key, "success", "reason", "x.*")


def render_gate(least_ink: float = 0.002, errors: str = "errors", pages: str = "pages", ink: str = "ink") -> Column:
    """F3. Null if accepted, else latex_error, multipage_pdf or blank_image, the first that holds."""
    return F.when(F.coalesce(F.col(errors), F.lit(0)) > 0, "latex_error").when(F.coalesce(F.col(pages), F.lit(0)) != 1, "multipage_pdf").when(F.coalesce(F.col(ink), F.lit(0.0)) < least_ink, "blank_image")


#: Least similarity by encoder.
SIMILAR_AT = {"clip": 0.85, "siglip2": 0.85}


def flag_low_similarity(df: DataFrame, encoder: str = "siglip2", similarity: str = "image_similarity") -> tuple[DataFrame, DataFrame]:
    """F4. All rows with low_similarity, and the report of the flagged ones: none is dropped."""
    flagged = df.withColumn("low_similarity", F.coalesce(F.col(similarity) < SIMILAR_AT[encoder], F.lit(False)))
    return flagged, flagged.filter("low_similarity")


def failure_report(failures: DataFrame, dataset: str = "dataset", reason: str = "reason") -> DataFrame:
    """A22. Counts by dataset and reason; a reason ends before its first colon."""
    return failures.groupBy(dataset, F.substring_index(F.col(reason), ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("failures"))


def dedupe_expensive(df: DataFrame, columns: list[str], step: Callable[[DataFrame], DataFrame], settings: str = "") -> DataFrame:
    """J7. step, run once for each distinct value of columns under the settings; its new columns joined back by cache_key."""
    key = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(settings)).cast("binary"), 256)
    keyed = df.withColumn("cache_key", key)
    once = step(keyed.select("cache_key", *columns).dropDuplicates(["cache_key"]))
    return keyed.join(once.drop(*columns), "cache_key")
