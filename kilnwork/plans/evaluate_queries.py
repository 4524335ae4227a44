"""Queries of pair metrics, rewards and profiles, training rows and logs, vectors and clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import helpers, scores, text, vectors
from ..operators import clustering, density, ngrams, scoring, training
from .text_queries import _LINES
from .views import attempts, pairs, quoted, samples, sql_grams, sql_strip, sql_tokens, table, trainlog, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def one() -> Column:
    return F.count(F.lit(1)).alias("rows")


def add(name: str, sql: str | None = None, *views: str) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return put


# pairs ------------------------------------------------------------------------------------------------------------


@add("j5_pair_generations", "select test_id, provider from pairs", "pairs")
def j5(spark, d):
    p = pairs(spark, d)
    return scoring.pair_generations(p.select("test_id", "reference"), p.select("test_id", "provider", "generated")).select("test_id", "provider")


def _corpus(spark, d):
    return table(spark, d, "benchmark").select(F.col("text").alias("code"))


_CORPUS = f"tokenized as (select item_id as doc_id, {sql_tokens('text')} as tokens from benchmark where {sql_strip('text')} <> '')"
_SHARED = f"shared as (select *, row_number() over (order by count desc, n, gram) as rank from (select n, gram, count(*) as count from ({sql_grams('1,2,3,4')}) group by all) qualify rank <= 100)"


@add("m1_shared_ngrams", f"with {_CORPUS}, {_SHARED} select cast(rank as int) as rank, n, md5(gram) as gram, count from shared")
def m1(spark, d):
    return ngrams.shared_ngrams(_corpus(spark, d), "code", 100).select("rank", "n", F.md5("gram").alias("gram"), "count")


def _sided(side: str) -> str:
    return f"(select test_id as doc_id, {sql_tokens(side)} as tokens from pairs)"


_BLEU = f"""rg as ({sql_grams('1,2,3,4', _sided('reference'))}), gg as ({sql_grams('1,2,3,4', _sided('generated'))}),
c as (select doc_id, n, gram, sum(r) as r, sum(g) as g from (select *, 1 as r, 0 as g from rg union all select *, 0, 1 from gg) group by all),
k as (select doc_id, n, sum(least(r, g)) as m, greatest(1, sum(g)) as t from c where not exists (select 1 from shared s where s.n = c.n and s.gram = c.gram) group by all),
z as (select test_id, len({sql_tokens('reference')}) as rl, len({sql_tokens('generated')}) as gl from pairs),
bleu as (select test_id, case when rl = 0 or gl = 0 then null when coalesce((select m from k where doc_id = test_id and k.n = 1), 0) = 0 then 0.0
  else exp(sum(ln(case when coalesce(m, 0) = 0 then 0.1 else m end / coalesce(t, 1))) / 4) * case when gl < rl then exp(1 - rl / gl) else 1 end end as b
  from (select z.*, o.n as o, k.m, k.t from z cross join (values (1), (2), (3), (4)) o(n) left join k on k.doc_id = z.test_id and k.n = o.n) group by test_id, rl, gl)"""


@add("m2_crystal_bleu", with_views("", "pairs").rstrip() + f", {_CORPUS}, {_SHARED}, {_BLEU} select test_id, round(b, 6) as crystalbleu from bleu")
def m2(spark, d):
    shared = ngrams.shared_ngrams(_corpus(spark, d), "code", 100)
    return ngrams.crystal_bleu(pairs(spark, d), "test_id", "reference", "generated", shared).select("test_id", F.round("crystalbleu", 6).alias("crystalbleu"))


@add("m3_token_edit_distance")
def m3(spark, d):
    p = pairs(spark, d).select("test_id", text.tokenize_code("reference").alias("r"), text.tokenize_code("generated").alias("g"))
    return p.select("test_id", helpers.token_edit_distance("r", "g").alias("distance"), F.size("r").alias("reference_tokens"))


_R, _G = f"length({sql_strip('coalesce(reference, ' + chr(39) * 2 + ')')})", f"length({sql_strip('coalesce(generated, ' + chr(39) * 2 + ')')})"


@add("m4_relative_length", f"select test_id, round(1 / (1 + abs({_G} - {_R}) / {_R}), 9) as similarity, round({_G} / {_R}, 9) as ratio from pairs where {_R} > 0", "pairs")
def m4(spark, d):
    return pairs(spark, d).select("test_id", scores.relative_length("reference", "generated").alias("x")).filter("x is not null").select("test_id", F.round("x.similarity", 9).alias("similarity"), F.round("x.ratio", 9).alias("ratio"))


_RAW = "case event_id % 20 when 0 then cast('NaN' as double) when 1 then cast('Infinity' as double) when 2 then null else value / 60 - 0.05 end"
_S = "(select *, " + _RAW + " as raw from events)"


@add("m5_score_result", f"select event_id, coalesce(isfinite(raw) and least(1, greatest(0, raw)) >= 0.5, false) as pass, round(case when isfinite(raw) then least(1, greatest(0, raw)) else 0.0 end, 9) as score from {_S}")
def m5(spark, d):
    return table(spark, d, "events").select("event_id", scores.score_result(F.expr(_RAW), 0.5).alias("x")).select("event_id", "x.pass", F.round("x.score", 9).alias("score"))


@add("m6_distance_to_similarity", "select event_id, round(1 / (1 + value), 9) as inverse, round(1 - value, 9) as complement from events")
def m6(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scores.distance_to_similarity("value"), 9).alias("inverse"), F.round(scores.distance_to_similarity("value", "complement"), 9).alias("complement"))


_TH = "case event_id % 4 when 0 then 'x' when 1 then '-' || event_id when 2 then null else '' || event_id end"


@add("m7_thinking_length", "select event_id, case when event_id % 4 = 3 then cast(event_id as double) else 0.0 end as score from events")
def m7(spark, d):
    return table(spark, d, "events").select("event_id", scores.thinking_length(F.expr(_TH)).alias("score"))


@add("m8_renderable_score", "select event_id, case when pdf_created then 1.0 else 0.0 end::double as score, errors + warnings + badboxes as issues from attempts", "attempts")
def m8(spark, d):
    x = attempts(spark, d).select("event_id", scores.renderable_score("pdf_created", "errors", "warnings", "badboxes").alias("x"))
    return x.select("event_id", "x.score", F.aggregate(F.map_values("x.named_scores"), F.lit(0.0), lambda a, b: a + b).cast("int").alias("issues"))


def _neutral(spark, d):
    """Each sample against itself with a node more, labels hidden on both sides, by M2, M3 and M4."""
    p = samples(spark, d).select("sample_id", F.coalesce("code", F.lit("")).alias("r"), F.concat(F.coalesce("code", F.lit("")), F.lit("\n\\node {z};")).alias("g"))
    return scoring.text_neutral_metrics(p, "sample_id", "r", "g", ngrams.shared_ngrams(_corpus(spark, d), "code", 100), "clean_all_text")


def _hidden(c: str) -> str:
    return f"replace({c}, '\\begin{{tikzpicture}}', {quoted(helpers.HIDE)} || '\\begin{{tikzpicture}}')"


# the reference's tokens are the first of the generated side's, so their distance is the number of the others
_NEUTRAL = with_views("", "samples").rstrip() + f""", pairs as (select sample_id as test_id, {_hidden("coalesce(code, '')")} as reference, {_hidden("coalesce(code, '') || chr(10) || '" + chr(92) + "node {z};'")} as generated from samples),
{_CORPUS}, {_SHARED}, {_BLEU}, neutral as (select test_id as sample_id, round(b, 6) as crystalbleu, (gl - rl)::bigint as distance, (gl - rl) / rl as ted, case when {_R} > 0 then round(1 / (1 + abs({_G} - {_R}) / {_R}), 6) end as similarity
  from bleu join z using (test_id) join pairs using (test_id) where rl > 0)"""


@add("m9_text_neutral_metrics", _NEUTRAL + " select sample_id, crystalbleu, distance, similarity from neutral")
def m9(spark, d):
    x = _neutral(spark, d).filter("reference_tokens > 0")
    return x.select("sample_id", F.round("crystalbleu", 6).alias("crystalbleu"), F.col("distance").cast("long").alias("distance"), F.round("similarity", 6).alias("similarity"))


@add("m10_diagnostic_reward", "select event_id, round(greatest(-2, least(1, 1 - 0.1 * errors - 0.05 * warnings - 0.01 * badboxes)), 9)::double as reward from attempts", "attempts")
def m10(spark, d):
    return attempts(spark, d).select("event_id", F.round(scores.diagnostic_reward("errors", "warnings", "badboxes"), 9).alias("reward"))


@add("m11_code_reward", _NEUTRAL + " select sample_id, round((least(1, greatest(0, crystalbleu)) + 0.5 / (1 + ted)) / 1.5, 5) as reward from neutral")
def m11(spark, d):
    x = _neutral(spark, d).filter("reference_tokens > 0")
    return x.select("sample_id", F.round(scores.code_reward(F.round("crystalbleu", 6), F.col("distance") / F.col("reference_tokens")), 5).alias("reward"))


@add("m12_visual_reward", "select event_id, round(0.15 * least(1, value / 50) + 0.5 * least(1, value / 80) + 0.35 * least(1, value / 20), 9) as reward from events")
def m12(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scores.visual_reward(F.col("value") / 50, F.col("value") / 80, F.col("value") / 20), 9).alias("reward"))


_PART = "case when event_id % {k} = 0 then null else value / 100 end"


@add("m13_total_reward", f"select event_id, round(case when pdf_created then 1 + ink / 100 + 3 * coalesce({_PART.format(k=3).replace('value', 'ink')}, 0) + 0.5 * coalesce({_PART.format(k=4).replace('value', 'ink')}, 0) else -2 end, 9)::double as reward from attempts", "attempts")
def m13(spark, d):
    a = attempts(spark, d).withColumn("value", F.col("ink"))
    return a.select("event_id", F.round(scores.total_reward("pdf_created", F.col("ink") / 100, F.expr(_PART.format(k=3)), F.expr(_PART.format(k=4))), 9).alias("reward"))


def _scored(spark, d):
    p = pairs(spark, d)
    r = scores.relative_length("reference", "generated")
    return scoring.score_pairs(p, {"relative_length": r["similarity"], "ted": F.when(F.length("generated") % 7 == 0, F.lit(float("nan"))).otherwise(1 / (1 + F.length("generated") / 100))}, ["provider", "test_id"])


_SCORED = f"""scored as (select provider, test_id, metric, coalesce(case when isfinite(x) then least(1, greatest(0, x)) end, 0.0) as score, coalesce(isfinite(x) and least(1, greatest(0, x)) >= least_score, false) as pass from (
  select provider, test_id, 'relative_length' as metric, case when {_R} > 0 then 1 / (1 + abs({_G} - {_R}) / {_R}) end as x, 0.8 as least_score from pairs
  union all select provider, test_id, 'ted', case when length(generated) % 7 = 0 then cast('NaN' as double) else 1 / (1 + length(generated) / 100) end, 0.5 from pairs))"""


def scored(sql: str) -> str:
    return with_views("", "pairs").rstrip() + f", {_SCORED}" + (sql if sql.startswith(",") else f" {sql}")


@add("x1_score_pairs", scored("select provider, test_id, metric, round(score, 9) as score, pass from scored"))
def x1(spark, d):
    return _scored(spark, d).select("provider", "test_id", "metric", F.round("score", 9).alias("score"), "pass")


@add("x1_text_scores")
def x1_texts(spark, d):
    out = scoring.text_scores(pairs(spark, d), ["provider", "test_id"], "reference", "generated", ngrams.shared_ngrams(_corpus(spark, d), "code", 100))
    return out.select("provider", "test_id", "metric", F.round("score", 6).alias("score"), "pass")


@add("a12_provider_means", scored("select provider, metric, round(avg(score), 6) as mean_score, round(avg(pass::int), 6) as pass_rate, count(*) as results from scored group by all"))
def a12(spark, d):
    return scoring.provider_means(_scored(spark, d)).withColumn("mean_score", F.round("mean_score", 6)).withColumn("pass_rate", F.round("pass_rate", 6))


_BOX = "box as (select provider, metric, quantile_cont(score, 0.25) as q1, quantile_cont(score, 0.5) as median, quantile_cont(score, 0.75) as q3 from scored group by all)"


@add("a13_score_distribution", scored(f", {_BOX} select provider, metric, {', '.join(f'round({e}, 6) as {n}' for n, e in (('q1', 'q1'), ('median', 'median'), ('q3', 'q3'), ('low', 'q1 - 1.5 * (q3 - q1)'), ('high', 'q3 + 1.5 * (q3 - q1)')))} from box"))
def a13(spark, d):
    return scoring.score_distribution(_scored(spark, d))[0].select("provider", "metric", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "low", "high")])


@add("a13_outliers", scored(f", {_BOX} select provider, metric, test_id from scored join box using (provider, metric) where score not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)"))
def a13o(spark, d):
    return scoring.score_distribution(_scored(spark, d))[1].select("provider", "metric", "test_id")


_COMBINED = "combined as (select provider, test_id, avg(case when metric = 'ted' then 1 - x else x end) as combined from (select *, case when hi > lo then (score - lo) / (hi - lo) end as x from scored join (select metric, min(score) as lo, max(score) as hi from scored group by 1) using (metric)) group by all)"


@add("a14_combined_score", scored(f", {_COMBINED} select provider, test_id, round(combined, 6) as combined from combined"))
def a14(spark, d):
    return scoring.combined_score(_scored(spark, d), ["provider", "test_id"], ["ted"]).withColumn("combined", F.round("combined", 6))


_ENDS = "select provider, test_id, 'best' as e, row_number() over (partition by provider order by c desc, test_id) as k from r union all select provider, test_id, 'worst', row_number() over (partition by provider order by c, test_id) from r"


@add("o5_best_and_worst", scored(f", {_COMBINED}, r as (select *, round(combined, 9) as c from combined) select provider, test_id, e as \"end\", cast(k as int) as place from ({_ENDS}) where k <= 5"))
def o5(spark, d):
    c = scoring.combined_score(_scored(spark, d), ["provider", "test_id"], ["ted"]).withColumn("combined", F.round("combined", 9))
    return scoring.best_and_worst(c, 5, ["test_id"]).select("provider", "test_id", "end", "place")


@add("o4_most_repetitive", "select microbatch from trainlog order by normalized_line_repetition_ratio desc, microbatch limit 50", "trainlog")
def o4(spark, d):
    return scoring.most_repetitive(trainlog(spark, d).withColumnRenamed("normalized_line_repetition_ratio", "repetition_score"), 50, "microbatch").select("microbatch")


@add("a11_describe_by", "select event_type, 'value' as \"column\", count(value) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q3, max(value) as max from events group by all")
def a11(spark, d):
    out = scoring.describe_by(table(spark, d, "events"), "event_type", ["value"])
    return out.select("event_type", "column", "count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q1", "median", "q3")])


@add("a15_reward_summary", "select event_type as step, round(avg(case when event_id % 3 > 0 then value end), 6) as total_score, round(avg(event_id % 5), 6) as latex_errors from events group by all")
def a15(spark, d):
    r = table(spark, d, "events").select(F.col("event_type").alias("step"), F.expr("case when event_id % 3 > 0 then value end").alias("total_score"), F.expr("cast(event_id % 5 as double)").alias("latex_errors"))
    return scoring.reward_summary(r).select("step", F.round("total_score", 6).alias("total_score"), F.round("latex_errors", 6).alias("latex_errors"))


@add("a16_group_advantage", "select event_id, round(value - avg(value) over (partition by user_id), 6) as advantage from events")
def a16(spark, d):
    return scoring.group_advantage(table(spark, d, "events"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


# training rows and logs -------------------------------------------------------------------------------------------

_STEP = "cast((microbatch - 1) // 32 + 1 as bigint)"


@add("w8_train_step_index", f"select microbatch, {_STEP} as optimizer_step, cast((microbatch - 1) % 32 + 1 as int) as accumulation_slot from trainlog", "trainlog")
def w8(spark, d):
    return training.train_step_index(trainlog(spark, d), "microbatch", 32).select("microbatch", "optimizer_step", "accumulation_slot")


@add("a17_train_step_summary", f"select {_STEP} as optimizer_step, count(*) as samples, round(avg(normalized_line_repetition_ratio), 6) as mean_line_repetition, max(normalized_line_repetition_ratio) as max_line_repetition, max(max_identical_normalized_line_run) as max_identical_normalized_line_run, max(active_targets) as max_active_targets, (array_agg(code_path order by normalized_line_repetition_ratio desc, microbatch))[1] as most_repetitive_code_path from trainlog group by 1", "trainlog")
def a17(spark, d):
    return training.train_step_summary(training.train_step_index(trainlog(spark, d), "microbatch", 32)).withColumn("mean_line_repetition", F.round("mean_line_repetition", 6))


@add("a18_generation_health", "select event_type as step, round(avg((event_id % 2 = 0)::int), 6) as terminated_by_stop_token_rate, round(avg((event_id % 3 = 0)::int), 6) as hit_max_new_tokens_rate, round(avg((event_id % 5 = 0)::int), 6) as contains_end_document_rate, round(avg(value), 6) as mean_line_repetition from events group by 1")
def a18(spark, d):
    log = table(spark, d, "events").selectExpr("event_type as step", "event_id % 2 = 0 as terminated_by_stop_token", "event_id % 3 = 0 as hit_max_new_tokens", "event_id % 5 = 0 as contains_end_document", "value as normalized_line_repetition_ratio")
    out = training.generation_health(log)
    return out.select("step", *[F.round(c, 6).alias(c) for c in out.columns if c != "step"])


@add("w9_longest_run", f"""select s.doc_id, cast(coalesce(run, 0) as bigint) as longest_run from samples s left join (select doc_id, max(n) as run from (select doc_id, x, g, count(*) as n
  from (select doc_id, x, i - row_number() over (partition by doc_id, x order by i) as g from (select doc_id, unnest(r) as x, generate_subscripts(r, 1) as i from (select doc_id, {_LINES} as r from samples))) group by all) group by doc_id) w on w.doc_id = s.doc_id""", "samples")
def w9(spark, d):
    return training.longest_runs(samples(spark, d), "doc_id")


_PROMPT = "Draw it."


@add("r1_sft_rows", "select conv_id || ':' || turn as sample_id, 'user' as role, md5(coalesce(text, '')) as answer, length(text) as code_chars from conversations where false union all select sample_id, 'user', md5(v), length(v) from (select sample_id, regexp_replace(text, '^[\\s\\v]+|[\\s\\v]+$', '', 'g') as v from samples) where v <> ''", "samples")
def r1(spark, d):
    rows, _ = training.sft_rows(samples(spark, d).withColumn("description", F.lit("d")), _PROMPT, "text")
    return rows.select("sample_id", F.col("prompt")[0]["role"].alias("role"), F.md5(text.extract_text("completion")).alias("answer"), F.col("code_chars").cast("long").alias("code_chars"))


@add("r2_rl_rows", "select sample_id, sample_id as reference_key, md5(regexp_replace(coalesce(text, ''), '^[\\s\\v]+|[\\s\\v]+$', '', 'g')) as answer from samples", "samples")
def r2(spark, d):
    return training.rl_rows(samples(spark, d).withColumn("description", F.lit("d")), _PROMPT, "text").select("sample_id", "reference_key", F.md5("answer").alias("answer"))


def _token_ids(c: str) -> Column:
    """Numbers of a text's tokens, by hash."""
    return F.transform(text.tokenize_code(c), lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % 50000 + 2)


def _ids(spark, d):
    """A user's turn as prompt and the answer as target, whole."""
    return pairs(spark, d).select(F.col("test_id").alias("sample_id"), "conv_id", _token_ids("reference").alias("prompt_ids"), _token_ids("generated").alias("target_ids"))


def _sql_ids(c: str) -> str:
    return f"list_transform({sql_tokens(c)}, lambda t: ('0x' || substr(md5(t), 1, 6))::int % 50000 + 2)"


_NUMBERED = f"(select test_id as sample_id, conv_id, p, t, len(p) + len(t) + 1 as n from (select *, {_sql_ids('reference')} as p, {_sql_ids('generated')} as t from pairs))"
#: The number of the token ".".
_STOP = 0x5058F1 % 50000 + 2


@add("r3_mask_labels", f"select sample_id, cast(n as int) as input_len, cast(len(t) + 1 as int) as active_targets, cast(coalesce(list_sum(t), 0) + 1 as bigint) as target_sum from {_NUMBERED}", "pairs")
def r3(spark, d):
    rows = training.mask_labels(_ids(spark, d))
    total = F.aggregate(F.filter("labels", lambda x: x != training.IGNORED), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("sample_id", F.size("input_ids").alias("input_len"), "active_targets", total.alias("target_sum"))


@add("r4_pad_batches", f"select sample_id, cast(max(n) over (partition by conv_id // 4) as int) as padded, cast(n as int) as attended from {_NUMBERED}", "pairs")
def r4(spark, d):
    rows = training.pad_batches(training.mask_labels(_ids(spark, d)).withColumn("batch", F.expr("conv_id div 4")), "batch")
    return rows.select("sample_id", F.size("labels").alias("padded"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("attended"))


@add("r5_truncate_tokens", "select doc_id, cast(least(5, len(tokens)) as int) as kept from tokenized", "tokenized")
def r5(spark, d):
    return samples(spark, d).select("doc_id", text.tokenize_code("code").alias("t")).select("doc_id", F.size(training.truncate_tokens("t", 5)).alias("kept"))


@add("f9_token_budget", f"select sample_id, cast(len(p) as int) as prompt_len, cast(len(t) as int) as target_len, case when len(p) > 40 then 'prompt_too_long' else 'target_too_long' end as reason from {_NUMBERED} where len(p) > 40 or len(t) > 30", "pairs")
def f9(spark, d):
    return training.token_budget(_ids(spark, d), 40, 30)[1]


@add("a19_label_audit", f"select count(*) as samples, count(*) filter (where not list_contains(t, {_STOP})) as without_stop, count(*) filter (where conv_id % 5 = 0) as with_active_padding from {_NUMBERED}", "pairs")
def a19(spark, d):
    rows = training.pad_batches(training.mask_labels(_ids(spark, d)).withColumn("batch", F.expr("conv_id div 4")), "batch")
    wrong = F.when(F.col("conv_id") % 5 == 0, F.transform("attention_mask", lambda x: F.lit(0))).otherwise(F.col("attention_mask"))
    return training.label_audit(rows.withColumn("attention_mask", wrong), [_STOP])


# vectors ----------------------------------------------------------------------------------------------------------

_V = "list_transform(embedding, lambda x: x::double)"
_N = f"sqrt(list_sum(list_transform({_V}, lambda x: x * x)))"


def _vec(spark, d):
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "sample_id")


_ENTRIES = "select sample_id, unnest({v}) as value, unnest(range(len({v}))) as place from "


def _entries(df: DataFrame, column: Column) -> DataFrame:
    """A row for each entry of a vector."""
    return df.select("sample_id", F.posexplode(column).alias("place", "value")).select("sample_id", F.round("value", 6).alias("value"), F.col("place").cast("long").alias("place"))


@add("v1_l2_normalize", f"select sample_id, round(value, 6) as value, place from ({_ENTRIES.format(v='v')} (select vec_id as sample_id, list_transform(v, lambda x: x / greatest(n, 1e-12)) as v from (select vec_id, {_V} as v, {_N} as n from embeddings)))")
def v1(spark, d):
    return _entries(_vec(spark, d), vectors.l2_normalize("embedding"))


_NEXT = "(select a.vec_id as sample_id, a.embedding as a, b.embedding as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def _next(spark, d):
    e = _vec(spark, d)
    return e.select("sample_id", F.col("embedding").alias("a")).join(e.select((F.col("sample_id") - 1).alias("sample_id"), F.col("embedding").alias("b")), "sample_id")


@add("v2_cosine", f"select sample_id, round(list_cosine_similarity(list_transform(a, lambda x: x::double), list_transform(b, lambda x: x::double)), 6) as cosine from {_NEXT}")
def v2(spark, d):
    return _next(spark, d).select("sample_id", F.round(vectors.cosine("a", "b"), 6).alias("cosine"))


def _unit(x: str) -> str:
    return f"list_transform({x}, lambda x: x::double / greatest(sqrt(list_sum(list_transform({x}, lambda y: y::double * y::double))), 1e-12))"


@add("v3_combine", f"select sample_id, round(value, 6) as value, place from ({_ENTRIES.format(v='v')} (select sample_id, {_unit('c')} as v from (select sample_id, list_concat(a, b) as c from (select sample_id, {_unit('a')} as a, {_unit('b')} as b from {_NEXT}))))")
def v3(spark, d):
    return _entries(_next(spark, d), vectors.combine("a", "b"))


@add("v4_mean_pool", f"select sample_id, round(value, 6) as value, place from ({_ENTRIES.format(v='v')} (select sample_id, list_transform(range(1, len(a) + 1), lambda i: (a[i]::double + b[i]::double * (sample_id % 2)) / (1 + sample_id % 2)) as v from {_NEXT}))")
def v4(spark, d):
    x = _next(spark, d).select("sample_id", F.array("a", "b").alias("v"), F.array(F.lit(1), F.col("sample_id") % 2).alias("m"))
    return _entries(x, vectors.mean_pool("v", "m"))


@add("f8_validate_encoder", "select count(*) as rows from embeddings")
def f8(spark, d):
    return clustering.validate_encoder(_vec(spark, d).withColumn("image_encoder", F.lit("SigLIP2")), "siglip2").agg(one())


@add("v5_reduce_pca")
def v5(spark, d):
    length = F.sqrt(F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x * x))
    return clustering.reduce_pca(_vec(spark, d), 8)[0].select("sample_id", F.size("reduced").alias("size"), F.round(length, 6).alias("length"))


@add("v6_cluster_kmeans")
def v6(spark, d):
    return clustering.cluster_kmeans(clustering.reduce_pca(_vec(spark, d), 8)[0], 6).select("sample_id", "cluster")


def _pca(spark, d):
    return clustering.reduce_pca(_vec(spark, d), 4)[0].select("sample_id", "reduced")


@add("v7_cluster_density")
def v7(spark, d):
    out = density.cluster_density(_pca(spark, d), 5, 3)
    return out.select("sample_id", "cluster", F.round("membership_probability", 6).alias("membership_probability"))


_FAR = "(select a.vec_id as i, b.vec_id as j, list_distance(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double)) as d from embeddings a, embeddings b)"


@add("v7_core_distances", f"select i as sample_id, round(max(d), 6) as core from (select i, d, row_number() over (partition by i order by d) as k from {_FAR}) where k <= 4 group by i")
def v7_core(spark, d):
    return density.with_core(_vec(spark, d), 4, vector="embedding").select("sample_id", F.round("core", 6).alias("core"))


#: Prim's tree grown from the first row; a step holds each row's way to the tree.
_PRIM = f"""with recursive far as {_FAR},
core as (select i, max(d) as core from (select i, d, row_number() over (partition by i order by d) as k from far) where k <= 4 group by i),
ids as (select list(i order by i) as ids, count(*) as n from core),
reach as (select i, list(greatest(d, a.core, b.core) order by j) as r from far join core a using (i) join core b on b.i = j group by i),
ways as (select list(r order by i) as w, count(*) as n from reach),
grown as (
  select 0 as step, 1 as place, list_transform(range(n), lambda x: 1e300::double) as best, 0.0::double as weight from ways
  union all
  select step + 1, list_position(b, list_min(b)), b, weight + list_min(b) from (
    select step, weight, list_transform(best, lambda x, y: case when x is not null and y <> place then least(x, w[place][y]) end) as b, n from grown, ways)
  where step < n - 1)
select cast(max(step) as bigint) as edges, round(max(weight), 6) as weight from grown"""


@add("v7_spanning_tree", _PRIM)
def v7_tree(spark, d):
    _, tree = density.spanning_tree(_vec(spark, d), 4, vector="embedding")
    return tree.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("w"), 6).alias("weight"))


@add("v8_assign_classes", "select case when vec_id % 3 = 0 then 'benchmark' else 'pool' end as dataset, count(*) as rows, count(*) filter (where label = 0) as noise, round(avg((label = 0)::int), 6) as noise_fraction, count(distinct case when label > 0 then label end) as clusters from embeddings group by 1")
def v8(spark, d):
    rows = _vec(spark, d).withColumn("cluster", F.col("label") - 1).withColumn("dataset", F.expr("case when sample_id % 3 = 0 then 'benchmark' else 'pool' end"))
    return clustering.assign_classes(rows)[1].withColumn("noise_fraction", F.round("noise_fraction", 6))


@add("v9_silhouette", """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
d as (select a.vec_id, a.label, b.label as other, sum(list_distance(a.v, b.v)) as far, count(*) as n from e a, e b group by all),
s as (select vec_id, max(case when label = other then far / greatest(n - 1, 1) end) as inside, max(case when label = other then n end) as own, min(case when label <> other then far / n end) as outside from d group by vec_id)
select count(*) as rows, round(avg(case when own > 1 then (outside - inside) / greatest(inside, outside) else 0 end), 6) as silhouette from s""")
def v9(spark, d):
    rows = _vec(spark, d).withColumn("cluster", F.col("label"))
    s = clustering.silhouette(rows, vector="embedding")
    return rows.agg(one()).withColumn("silhouette", F.round(F.lit(s), 6))


@add("v10_cluster_sweep")
def v10(spark, d):
    return clustering.cluster_sweep(_vec(spark, d), [2, 4], [5, 10], 3)


@add("o6_rank_sweep", "select label, cast(row_number() over (order by s desc, n) as int) as place from (select label, round(avg(embedding[1]), 9) as s, count(*) as n from embeddings group by 1)")
def o6(spark, d):
    from pyspark.sql import Window

    r = table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(F.col("embedding")[0].cast("double")), 9).alias("silhouette"), F.count(F.lit(1)).alias("noise_fraction"))
    return clustering.rank_sweep(r).select("label", F.row_number().over(Window.orderBy(F.col("silhouette").desc(), "noise_fraction")).alias("place"))


@add("v11_cluster_exemplars", "select vec_id as sample_id, label as cluster, cast(k as int) as place from (select *, row_number() over (partition by label order by embedding[1] desc, vec_id) as k from embeddings) where k <= 4")
def v11(spark, d):
    rows = _vec(spark, d).select("sample_id", F.col("label").alias("cluster"), F.col("embedding")[0].alias("membership_probability"))
    return clustering.cluster_exemplars(rows, 4).select("sample_id", "cluster", "place")
