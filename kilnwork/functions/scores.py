"""Scores of one generated sample, from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, text_of

#: Least score to pass, by metric.
PASS_AT = {"renderable": 1.0, "ssim": 0.75, "ms_ssim": 0.75, "clip": 0.60, "siglip": 0.60, "lpips": 0.80, "dreamsim": 0.75, "dists": 0.80, "crystalbleu": 0.10, "ted": 0.50, "relative_length": 0.80}
#: Multipliers and bounds of the rewards.
REWARD = {"not_renderable": -2.0, "renderable": 1.0, "code": 3.0, "visual": 0.5, "error": 0.10, "warning": 0.05, "badbox": 0.01, "least": -2.0, "most": 1.0, "siglip": 0.15, "lpips": 0.5, "dreamsim": 0.35, "crystalbleu": 1.0, "ted": 0.5}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def relative_length(reference: Column | str, generated: Column | str) -> Column:
    """M4. struct(similarity, ratio, output_length, reference_length); null for a blank reference."""
    r, g = F.length(strip(text_of(reference))), F.length(strip(text_of(generated)))
    return F.when(r > 0, F.struct((1 / (1 + F.abs(g - r) / r)).alias("similarity"), (g / r).alias("ratio"), g.alias("output_length"), r.alias("reference_length")))


def score_result(score: Column | str, threshold: Column | float, metric: str = "score") -> Column:
    """M5. struct(pass, score, reason): a score that is null or not finite fails with 0; others are clamped to [0, 1]."""
    score = _c(score).cast("double")
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    own = clamped(score)
    told = F.format_string("%s=%.4f; threshold=%.4f", F.lit(metric), own, threshold)
    good = F.struct((own >= threshold).alias("pass"), own.alias("score"), told.alias("reason"))
    bad = F.struct(F.lit(False).alias("pass"), F.lit(0.0).alias("score"), F.lit(f"{metric} failed: no finite score").alias("reason"))
    return F.when(finite(score), good).otherwise(bad)


def distance_to_similarity(d: Column | str, kind: str = "inverse") -> Column:
    """M6. 1 / (1 + d); for "complement" 1 - d."""
    d = _c(d)
    return 1 / (1 + d) if kind == "inverse" else 1 - d


def thinking_length(c: Column | str) -> Column:
    """M7. A count from text, 0 if it is none or negative; never clamped from above."""
    return F.greatest(F.lit(0), F.coalesce(_c(c).try_cast("int"), F.lit(0))).cast("double")


def renderable_score(ok: Column | str, errors: Column | str, warnings: Column | str, badboxes: Column | str) -> Column:
    """M8. struct(score, named_scores)."""
    named = F.create_map(*[x for name, c in (("errors", errors), ("warnings", warnings), ("badboxes", badboxes)) for x in (F.lit(name), _c(c).cast("double"))])
    return F.struct(F.when(_c(ok), 1.0).otherwise(0.0).alias("score"), named.alias("named_scores"))


def diagnostic_reward(errors: Column | str, warnings: Column | str, badboxes: Column | str) -> Column:
    """M10. The most less penalties by issue, within bounds; null and negative counts are 0."""
    n = lambda c: F.greatest(F.lit(0.0), F.coalesce(_c(c).cast("double"), F.lit(0.0)))
    penalty = n(errors) * REWARD["error"] + n(warnings) * REWARD["warning"] + n(badboxes) * REWARD["badbox"]
    return clamped(REWARD["most"] - penalty, REWARD["least"], REWARD["most"])


def code_reward(crystalbleu: Column | str, ted: Column | str) -> Column:
    """M11. Weighted mean of BLEU and the similarity of the edit distance, each clamped."""
    total = REWARD["crystalbleu"] + REWARD["ted"]
    return (clamped(_c(crystalbleu)) * REWARD["crystalbleu"] + clamped(distance_to_similarity(F.greatest(_c(ted), F.lit(0.0)))) * REWARD["ted"]) / total


def visual_reward(siglip: Column | str, lpips: Column | str, dreamsim: Column | str) -> Column:
    """M12. Weighted sum of image similarities, each clamped."""
    return sum((clamped(_c(c)) * REWARD[k] for k, c in (("siglip", siglip), ("lpips", lpips), ("dreamsim", dreamsim))), F.lit(0.0))


def total_reward(render_ok: Column | str, diagnostic: Column | str, code: Column | str, visual: Column | str) -> Column:
    """M13. A fixed score if it does not render; else the parts, a missing one counting 0."""
    part = lambda c: F.coalesce(_c(c), F.lit(0.0))
    return F.when(_c(render_ok), REWARD["renderable"] + part(diagnostic) + REWARD["code"] * part(code) + REWARD["visual"] * part(visual)).otherwise(REWARD["not_renderable"])
