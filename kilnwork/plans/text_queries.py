"""Queries of the column functions and of local repetition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import helpers, text
from ..operators import ngrams
from .views import samples, sql_comments_off, sql_grams, sql_normal, sql_numbers, sql_strip, sql_tokens, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def over_samples(name: str, column: Column | Callable[[], Column], sql: str | None) -> None:
    """A query (doc_id, value) over the samples."""
    QUERIES[name] = lambda spark, d: samples(spark, d).select("doc_id", (column() if callable(column) else column).alias("value"))
    if sql:
        SQL[name] = with_views(f"select doc_id, {sql} as value from samples", "samples")


def _doc(x: str) -> str:
    t = sql_strip(x)
    t = f"case when instr({t}, '\\documentclass') > 0 then substr({t}, instr({t}, '\\documentclass')) else {t} end"
    return sql_strip(f"case when instr({t}, '\\end{{document}}') > 0 then substr({t}, 1, instr({t}, '\\end{{document}}') + 13) else {t} end")


def _last(x: str, mark: str) -> str:
    """Place of the last mark, 0 for none."""
    return f"case when instr({x}, '{mark}') > 0 then length({x}) - instr(reverse({x}), '{mark[::-1]}') - {len(mark)} + 2 else 0 end"


def _between(x: str, first: str, last: str) -> str:
    return f"case when instr({x}, '{first}') > 0 and ({_last(x, last)}) >= instr({x}, '{first}') then {sql_strip(f'substr({x}, instr({x}, {chr(39)}{first}{chr(39)}), ({_last(x, last)}) - instr({x}, {chr(39)}{first}{chr(39)}) + {len(last)})')} end"


_C = "coalesce(code, '')"
over_samples("p1_normalize_code", lambda: F.sha2(text.normalize_code("code").cast("binary"), 256), f"sha256({sql_normal('code')})")
over_samples("p2_code_hash", lambda: text.code_hash("code"), f"case when {sql_normal('code')} = '' then '' else sha256({sql_normal('code')}) end")
over_samples("p3_strip_comments", lambda: F.md5(text.strip_comments("code")), f"md5({sql_comments_off('code')})")
over_samples("p4_normalize_numbers", lambda: F.md5(text.normalize_numbers("code")), f"md5({sql_numbers(_C)})")
over_samples("p5_tokenize_code", lambda: F.md5(F.array_join(text.tokenize_code("code"), "\n")), f"md5(array_to_string({sql_tokens('code')}, chr(10)))")
QUERIES["p6_ngrams"] = lambda spark, d: samples(spark, d).select("doc_id", text.tokenize_code("code").alias("t")).select("doc_id", F.md5(F.array_join(text.ngrams("t", 3), "\n")).alias("value"))
SQL["p6_ngrams"] = with_views("", "tokenized").rstrip() + f", g as (select doc_id, i, n, gram from (select doc_id, i, 3 as n, string_agg(tok, chr(1)) over (partition by doc_id order by i rows between current row and 2 following) as gram, len from (select doc_id, unnest(tokens) as tok, generate_subscripts(tokens, 1) as i, len(tokens) as len from tokenized)) where i <= len - 2) select doc_id, md5(coalesce(v, '')) as value from tokenized left join (select doc_id, string_agg(gram, chr(10) order by i) as v from g group by doc_id) using (doc_id)"
over_samples("p7_token_len", lambda: text.token_len("code", 4096).cast("long"), f"cast(least(len({sql_tokens('code')}), 4097) as bigint)")
over_samples("p8_extract_document", lambda: F.md5(text.extract_document("code")), f"md5({_doc(_C)})")
_f = f"regexp_replace({sql_strip(_C)}, '(?i)^```(?:latex|tex)?[\\s\\v]*', '')"
over_samples("p9_clean_completion", lambda: F.md5(text.clean_completion("code")), f"md5({_doc(f'regexp_replace({_f}, {chr(39)}[\\s\\v]*```$' + chr(39) + ', ' + chr(39) * 2 + ')')})")
_b = "(?is)```(?:latex|tex)?[ \\t]*\\r?\\n?(.*?)```"
over_samples("p10_extract_fenced", lambda: F.md5(text.extract_fenced("code")), f"md5(case when regexp_matches({sql_strip(_C)}, '{_b}') then {sql_strip(f'regexp_extract({sql_strip(_C)}, {chr(39)}{_b}{chr(39)}, 1)')} else {sql_strip(_C)} end)")
_l = "(?is)```[a-zA-Z0-9_-]*[ \\t]*\\r?\\n?(.*?)```"
QUERIES["p11_extract_latex"] = lambda spark, d: samples(spark, d).select("doc_id", F.md5(text.extract_latex("code")).alias("value"))
SQL["p11_extract_latex"] = with_views(
    f"""select doc_id, md5(coalesce({_between('t', chr(92) + 'documentclass', chr(92) + 'end{document}')}, {_between('t', chr(92) + 'begin{tikzpicture}', chr(92) + 'end{tikzpicture}')}, {sql_strip('t')})) as value
    from (select doc_id, case when regexp_matches({sql_strip(_C)}, '{_l}') then {sql_strip(f"regexp_extract({sql_strip(_C)}, '{_l}', 1)")} else {sql_strip(_C)} end as t from samples)""",
    "samples",
)
QUERIES["p12_extract_text"] = lambda spark, d: (
    table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))).alias("content"))).alias("m"))
    .select("conv_id", F.md5(text.extract_text("m")).alias("value"))
)
SQL["p12_extract_text"] = "select conv_id, md5(coalesce(string_agg(coalesce(text, ''), '' order by turn, role, text), '')) as value from conversations group by conv_id"
_p = "\\begin{document}"
over_samples("p13_disable_page_numbers", lambda: F.md5(text.disable_page_numbers("code")), f"md5(case when instr({_C}, '{_p}') > 0 then substr({_C}, 1, instr({_C}, '{_p}') - 1) || '\\pagestyle{{empty}}' || chr(10) || '{_p}' || chr(10) || '\\thispagestyle{{empty}}' || substr({_C}, instr({_C}, '{_p}') + {len(_p)}) else {_C} end)")
QUERIES["p14_neutralize_labels"] = lambda spark, d: samples(spark, d).select("doc_id", *[F.md5(helpers.neutralize_labels("code", m)).alias(m) for m in ("replace_sequential", "replace_all", "clean_all_text")])
_LOG = "case doc_id % 4 when 0 then '! Undefined' || chr(10) || './f.tex:12: bad' when 1 then 'LaTeX Warning: x' || chr(10) || 'Package rerunfilecheck Warning: y' when 2 then 'Overfull ' || chr(92) || 'hbox' || chr(13) || chr(10) || '  Underfull ' || chr(92) || 'vbox' else '' end || chr(10) || text"
QUERIES["p15_latex_issues"] = lambda spark, d: table(spark, d, "documents").select("doc_id", text.latex_issues(F.expr(_LOG)).alias("x")).selectExpr("doc_id", "cast(x.errors as bigint) as errors", "cast(x.warnings as bigint) as warnings", "cast(x.badboxes as bigint) as badboxes")
SQL["p15_latex_issues"] = f"""select doc_id, len(list_filter(r, lambda x: starts_with(x, '!') or regexp_matches(x, '^\\.?/?.*\\.tex:\\d+:'))) as errors,
  len(list_filter(r, lambda x: contains(x, 'Warning:') and not starts_with(x, 'Package rerunfilecheck Warning:'))) as warnings,
  len(list_filter(r, lambda x: starts_with(x, 'Overfull \\') or starts_with(x, 'Underfull \\'))) as badboxes
  from (select doc_id, list_transform(regexp_split_to_array({_LOG}, '\\r\\n|[\\n\\r\\v\\f]'), lambda x: {sql_strip('x')}) as r from documents)"""
_LINES = f"list_transform(list_filter(list_transform(regexp_split_to_array({_C}, '\\r\\n|[\\n\\r\\v\\f]'), lambda x: {sql_strip('x')}), lambda x: x <> ''), lambda x: regexp_replace(x, '[-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:[eE][-+]?\\d+)?', '<NUM>', 'g'))"
QUERIES["p16_code_structure"] = lambda spark, d: samples(spark, d).select("doc_id", text.code_structure("code").alias("s")).select("doc_id", *[F.col(f"s.{c}").cast("long").alias(c) for c in ("code_chars", "code_lines", "draw_count", "fill_count", "node_count", "max_identical_normalized_line_run")], *[F.round(f"s.{c}", 9).alias(c) for c in ("normalized_line_repetition_ratio", "dominant_normalized_line_fraction")])
SQL["p16_code_structure"] = with_views(
    f"""select s.doc_id, cast(length({_C}) as bigint) as code_chars, cast(len(r) as bigint) as code_lines, {', '.join(f"cast((length({_C}) - length(replace({_C}, '{m}', ''))) / 5 as bigint) as {n}" for m, n in ((chr(92) + 'draw', 'draw_count'), (chr(92) + 'fill', 'fill_count'), (chr(92) + 'node', 'node_count')))},
    coalesce(run, 0) as max_identical_normalized_line_run, round(case when len(r) = 0 then 0.0 else 1 - len(list_distinct(r)) / len(r) end, 9) as normalized_line_repetition_ratio,
    round(case when len(r) = 0 then 0.0 else most / len(r) end, 9) as dominant_normalized_line_fraction
    from (select *, {_LINES} as r from samples) s
    left join (select doc_id, max(n) as run from (select doc_id, x, g, count(*) as n from (select doc_id, x, i - row_number() over (partition by doc_id, x order by i) as g
      from (select doc_id, unnest(r) as x, generate_subscripts(r, 1) as i from (select doc_id, {_LINES} as r from samples))) group by all) group by doc_id) w on w.doc_id = s.doc_id
    left join (select doc_id, max(n) as most from (select doc_id, x, count(*) as n from (select doc_id, unnest({_LINES}) as x from samples) group by all) group by doc_id) m on m.doc_id = s.doc_id""",
    "samples",
)
over_samples("p17_line_repetition_ratio", lambda: F.round(text.line_repetition_ratio("code"), 9), f"round(case when len({_LINES}) = 0 then 0.0 else 1 - len(list_distinct({_LINES})) / len({_LINES}) end, 9)")
_R16 = "select doc_id, 1 - count(distinct gram) / count(*) as r from (" + sql_grams("16") + ") group by doc_id"
QUERIES["p18_ngram_repetition_ratio"] = lambda spark, d: samples(spark, d).select("doc_id", text.tokenize_code("code").alias("t")).select("doc_id", F.round(text.ngram_repetition_ratio("t", 16), 9).alias("value"))
SQL["p18_ngram_repetition_ratio"] = with_views(f"select doc_id, round(coalesce(r, 0.0), 9) as value from tokenized left join ({_R16}) using (doc_id)", "tokenized")
over_samples("p19_has_text", lambda: text.has_text("code"), f"{sql_strip(_C)} <> ''")
over_samples("p20_slug", lambda: text.slug("text"), "case when regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') = '' then 'class' else regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') end")
over_samples("p22_render_instruction", lambda: F.md5(text.render_instruction(F.lit(" Draw it. "), F.when(F.col("doc_id") % 3 == 0, F.col("text")))), f"md5('Draw it.' || case when doc_id % 3 = 0 and {sql_strip('coalesce(text, '')')} <> '' then chr(10) || chr(10) || 'Additionally, here is a description of the image with some creation hints:' || chr(10) || {sql_strip('coalesce(text, '')')} else '' end)")
over_samples("p23_truncate_text", lambda: F.md5(text.truncate_text("text", 1000)), "md5(case when length(text) > 1000 then left(text, 1000) || chr(10) || chr(10) || '...[truncated]...' else text end)")
QUERIES["p24_class_name"] = lambda spark, d: table(spark, d, "embeddings").select("vec_id", text.class_name(F.col("label") - 1, {3: "plots"}).alias("value"))
SQL["p24_class_name"] = "select vec_id, case when label < 1 then 'noise' when label - 1 = 3 then 'plots' else 'class_' || label end as value from embeddings"
_COVER = f"""grams as (select doc_id, n, gram as g, count(*) as c from ({sql_grams("2,3,4,6")}) group by all),
cover as (select doc_id, n, sum(case when c >= 3 then c else 0 end) / sum(c) as v3, sum(case when c >= 2 then c else 0 end) / sum(c) as v2 from grams group by all)"""
QUERIES["a3_ngram_coverage"] = lambda spark, d: samples(spark, d).select("doc_id", helpers.ngram_coverages(text.tokenize_code("code"), list(text.WEIGHTS)).alias("c")).select("doc_id", *[F.round(F.element_at("c", i), 9).alias(f"coverage_{n}") for i, n in enumerate(text.WEIGHTS, 1)])
SQL["a3_ngram_coverage"] = with_views("", "tokenized").rstrip() + f", {_COVER} select t.doc_id, " + ", ".join(f"round(coalesce(max(case when n = {n} then v3 end), 0.0), 9) as coverage_{n}" for n in (2, 3, 4, 6)) + " from tokenized t left join cover using (doc_id) group by t.doc_id"
_SCORE = "coalesce(sum(v3 * case n when 2 then 0.35 when 3 then 0.3 else 0.2 end), 0) / 1.05"
QUERIES["a4_repetition_score"] = lambda spark, d: ngrams.repetition_score(samples(spark, d)).select("doc_id", F.round("repetition_score", 6).alias("repetition_score"), "repetition_class")
_CLASS = "case when {s} < 0.25 then 'low' when {s} < 0.45 then 'medium' when {s} < 0.65 then 'high' when {s} < 0.85 then 'very_high' else 'critical' end"
SQL["a4_repetition_score"] = with_views("", "tokenized").rstrip() + f", {_COVER} select doc_id, round(s, 6) as repetition_score, {_CLASS.format(s='s')} as repetition_class from (select t.doc_id, {_SCORE} as s from tokenized t left join cover using (doc_id) group by t.doc_id)"
QUERIES["p25_repetition_class"] = lambda spark, d: ngrams.repetition_score(samples(spark, d)).groupBy("dataset", "repetition_class").agg(F.count(F.lit(1)).alias("rows"))
SQL["p25_repetition_class"] = with_views("", "tokenized").rstrip() + f", {_COVER} select dataset, {_CLASS.format(s='s')} as repetition_class, count(*) as rows from (select t.doc_id, t.dataset, {_SCORE} as s from tokenized t left join cover using (doc_id) group by all) group by all"
QUERIES["a5_repetition_profile"] = lambda spark, d: ngrams.repetition_profile(samples(spark, d), "doc_id").select("doc_id", F.round("repetition_score", 6).alias("repetition_score"), "repetition_class", F.col("token_count").cast("long").alias("token_count"), *[F.round(f"ngram_{n}_coverage", 6).alias(f"ngram_{n}_coverage") for n in text.WEIGHTS], "top_local_ngrams")
_P = "coalesce(sum(v2 * case n when 2 then 0.35 when 3 then 0.3 else 0.2 end), 0)"
SQL["a5_repetition_profile"] = with_views("", "tokenized").rstrip() + f""", {_COVER},
best as (select doc_id, '[' || string_agg('{{"count":' || c || ',"n":' || n || ',"ngram":' || to_json(replace(g, chr(1), ' ')) || '}}', ',' order by p) || ']' as j
  from (select *, row_number() over (partition by doc_id order by c desc, n desc, g) as p from grams where c >= 2) where p <= 20 group by doc_id)
select doc_id, round(s, 6) as repetition_score, case when s < 0.25 then 'low' when s < 0.45 then 'medium' when s < 0.65 then 'high' else 'very_high' end as repetition_class, k as token_count,
  ngram_2_coverage, ngram_3_coverage, ngram_4_coverage, ngram_6_coverage, coalesce(j, '[]') as top_local_ngrams
from (select t.doc_id, {_P} as s, max(len(tokens)) as k, {', '.join(f"round(coalesce(max(case when n = {n} then v2 end), 0.0), 6) as ngram_{n}_coverage" for n in (2, 3, 4, 6))} from tokenized t left join cover using (doc_id) group by t.doc_id) left join best using (doc_id)"""
QUERIES["a6_repetition_stats"] = lambda spark, d: (
    ngrams.repetition_stats(ngrams.repetition_score(samples(spark, d).withColumn("token_len", text.token_len("code"))))
    .select("dataset", "low", "medium", "high", "very_high", "critical", F.round("mean_score", 6).alias("mean_score"), F.col("token_min").cast("long").alias("token_min"), F.col("token_max").cast("long").alias("token_max"), F.round("token_mean", 6).alias("token_mean"))
)
SQL["a6_repetition_stats"] = with_views("", "tokenized").rstrip() + f""", {_COVER} select dataset, {', '.join(f"count(*) filter (where cls = '{c}') as {c}" for c in ('low', 'medium', 'high', 'very_high', 'critical'))}, round(avg(s), 6) as mean_score, min(k) as token_min, max(k) as token_max, round(avg(k), 6) as token_mean
from (select dataset, s, k, {_CLASS.format(s='s')} as cls from (select t.doc_id, t.dataset, {_SCORE} as s, max(len(tokens)) as k from tokenized t left join cover using (doc_id) group by all)) group by dataset"""
QUERIES["a7_common_ngrams"] = lambda spark, d: ngrams.common_ngrams(samples(spark, d).select(text.tokenize_code("code").alias("t")), "t", [20, 50], 200).select("rank", F.col("n"), F.md5("gram").alias("gram"), "count")
_top = lambda orders: f"select n, gram, count(*) as count from ({sql_grams(orders)}) group by all"
SQL["a7_common_ngrams"] = with_views(f"select cast(rank as int) as rank, n, md5(gram) as gram, count from (select *, row_number() over (order by count desc, n, gram) as rank from ({_top('20,50')})) where rank <= 200", "tokenized")
QUERIES["a8_common_ngrams_per_order"] = lambda spark, d: ngrams.common_ngrams_per_order(samples(spark, d).select(text.tokenize_code("code").alias("t")), "t", [3, 6], 50).select("rank", "n", F.md5("gram").alias("gram"), "count")
SQL["a8_common_ngrams_per_order"] = with_views(f"select cast(rank as int) as rank, n, md5(gram) as gram, count from (select *, row_number() over (partition by n order by count desc, gram) as rank from ({_top('3,6')})) where rank <= 50", "tokenized")


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = samples(spark, d).select("doc_id", text.tokenize_code("code").alias("t"))
    out = ngrams.filter_coverage(rows, "doc_id", "t", ngrams.common_ngrams(rows, "t", [2, 4], 200), [2, 4])
    return out.select("doc_id", "total", "filtered", "total_2", "filtered_2", "total_4", "filtered_4", *[F.round(c, 9).alias(c) for c in ("coverage", "coverage_2", "coverage_4")])


QUERIES["a9_filter_coverage"] = _coverage
_share = lambda s: f"round(case when total{s} > 0 then filtered{s} / total{s} else 0.0 end, 9) as coverage{s}"
SQL["a9_filter_coverage"] = with_views("", "tokenized").rstrip() + f""", top as (select n, gram from ({_top('2,4')}) order by count desc, n, gram limit 200),
g as ({sql_grams('2,4')}),
s as (select t.doc_id, count(g.gram) as total, count(top.gram) as filtered, {', '.join(f"count(g.gram) filter (where g.n = {n}) as total_{n}, count(top.gram) filter (where g.n = {n}) as filtered_{n}" for n in (2, 4))}
  from tokenized t left join g using (doc_id) left join top on top.n = g.n and top.gram = g.gram group by t.doc_id)
select *, {_share('')}, {_share('_2')}, {_share('_4')} from s"""
