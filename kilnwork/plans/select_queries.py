"""Queries of selection, split building and descriptions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quota
from ..operators import select as sel
from .views import master, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def one() -> Column:
    return F.count(F.lit(1)).alias("rows")
MIX = {"llm_description": 2.0, "llm_description_image": 1.0}
IMPORTANCE = {"*": "not important", "class_1": "extremely-important", "CLASS_2": "really_important", "class_3": "none"}
_M = "md5('{s}:' || sample_id)"


def add(name: str, sql: str | None = None, view: str | None = "master") -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql, view) if view else sql
        return f

    return put


@add("p21_importance_weight", "select sample_id, case lower(class) when 'class_1' then 50.0 when 'class_2' then 20.0 when 'class_3' then 0.0 else 1.0 end::double as weight from master")
def p21(spark, d):
    return master(spark, d).select("sample_id", sel.importance_weight("class", IMPORTANCE).alias("weight"))


@add("f5_repetition_candidates", "select sample_id from master where repetition_class in ('low', 'high')")
def f5(spark, d):
    return sel.repetition_candidates(master(spark, d), ["LOW", "high"]).select("sample_id")


@add("f6_is_noise", "select sample_id, class = 'noise' as noise from master")
def f6(spark, d):
    return master(spark, d).select("sample_id", sel.is_noise("class").alias("noise"))


@add("f7_require_values", "select sample_id from master where llm_description is not null and llm_description_image is not null")
def f7(spark, d):
    return sel.require_values(master(spark, d), ["llm_description", "llm_description_image"]).select("sample_id")


@add("o2_prefer_described", f"select sample_id from master order by not coalesce(described, false), {_M.format(s=3)}, sample_id limit 60")
def o2(spark, d):
    return sel.sample_n(master(spark, d), 60, 3, "sample_id", True).select("sample_id")


@add("o3_curriculum_order", "select sample_id, row_number() over (order by (class = 'noise')::int, case repetition_class when 'low' then 0 when 'high' then 1 when 'critical' then 2 else 3 end, doc_id) - 1 as place from master where doc_id is not null")
def o3(spark, d):
    return sel.curriculum_places(master(spark, d).filter("doc_id is not null"), "doc_id").select("sample_id", "place")


@add("j3_without", "select sample_id from master where not coalesce(described, false) and repetition_class <> 'low'")
def j3(spark, d):
    m = master(spark, d)
    return sel.without(m, m.filter("described"), m.filter("repetition_class = 'low'")).select("sample_id")


@add("u3_remainder", f"select sample_id from master where sample_id not in (select sample_id from master order by {_M.format(s=5)}, sample_id limit 50)")
def u3(spark, d):
    m = master(spark, d)
    return sel.without(m, sel.sample_n(m, 50, 5, "sample_id")).select("sample_id")


@add("u4_union_keys", "select sample_id from master where repetition_class in ('low', 'critical') or class = 'noise' and repetition_class = 'medium'")
def u4(spark, d):
    m = master(spark, d)
    return sel.union_keys(m.filter("repetition_class = 'low'"), m.filter("repetition_class = 'critical'"), m.filter(sel.is_noise("class") & (F.col("repetition_class") == "medium"))).select("sample_id")


_PER = "(select *, row_number() over (partition by class order by not coalesce(described, false), md5('{s}:' || sample_id), sample_id) as k from master where class <> 'noise')"


@add("q5_choose_per_class", f"select sample_id, class from {_PER.format(s=42)} where k <= 7")
def q5(spark, d):
    m = master(spark, d)
    return sel.choose_per_class(m, [f"Class_{i}" for i in range(1, 11)], 7, 42).select("sample_id", "class")


_SPLIT = """select sample_id from {per} where k <= {n} union all select sample_id from (select sample_id, row_number() over (order by md5('{s}n:' || sample_id), sample_id) as k from master where class = 'noise')
  where k <= {noise} + (select sum(greatest(0, {n} - c)) from (select x.class, count(m.class) as c from (select 'class_' || i as class from range(1, 13) r(i)) x left join master m on m.class = x.class group by 1))"""


@add("q6_choose_class_split", _SPLIT.format(per=_PER.format(s=42), n=9, s=42, noise=11))
def q6(spark, d):
    return sel.choose_class_split(master(spark, d), [f"class_{i}" for i in range(1, 13)], 9, 11, 42).select("sample_id")


#: Quotas of a total by weight: x the exact share; spare ones by fraction, then by name; then, if there is enough for all, the classes
#: that got none take one each from the largest (which stays the largest here).
_QUOTAS = """w as (select lower(class) as class, count(*) as have, case lower(class) when 'class_1' then 50.0 when 'class_2' then 20.0 else 1.0 end::double as weight from master where class not in ('noise', 'class_3') group by 1),
x as (select *, {total}::double * weight / (select sum(weight) from w) as x from w),
f as (select *, floor(x) + case when row_number() over (order by x - floor(x) desc, md5(class)) <= {total} - (select sum(floor(x)) from x) then 1 else 0 end as n from x),
q as (select class, have, case when {total} < (select count(*) from f) then n when n = 0 then 1 when n = (select max(n) from f) then n - (select count(*) from f where n = 0) else n end as quota from f)"""


#: Equal shares of a total among classes, the small ones used up first: round by round, spare ones by name.
_EQUAL = """recursive c as (select class, count(*) as have from master where class <> 'noise' group by 1),
r(turn, class, have, got) as (select 0, class, have, 0::bigint from c union all
  select turn + 1, class, have, got + case when have > got then least(have - got, spare // opened + case when place <= spare % opened then 1 else 0 end) else 0 end
  from (select *, {total} - sum(got) over () as spare, sum((have > got)::int) over () as opened, sum((have > got)::int) over (order by md5(class)) as place from r where turn < 40) where spare > 0 and opened > 0),
q as (select class, cast(arg_max(got, turn) as bigint) as quota from r group by class)"""


def _ctes(sql: str, ctes: str) -> str:
    """sql over the master view and further tables."""
    views = with_views("", "master").rstrip()
    if ctes.startswith("recursive "):
        return views.replace("with ", "with recursive ", 1) + ", " + ctes.removeprefix("recursive ") + " " + sql
    return views + ", " + ctes + " " + sql


# a shortage, of class_1 if any, may go to no other class, as none has its weight: it is filled from noise
@add("q7_choose_weighted", _ctes("select class, cast(least(quota, have) as bigint) as rows from q where quota > 0 union all select 'noise', cast(sum(quota - least(quota, have)) as bigint) from q having sum(quota - least(quota, have)) > 0", _QUOTAS.format(total=40)), None)
def q7(spark, d):
    return sel.choose_weighted(master(spark, d), 40, IMPORTANCE, 42).groupBy("class").agg(one())


@add("q8_choose_uniform", _ctes("select class, quota as rows from q where quota > 0", _EQUAL.format(total=77)), None)
def q8(spark, d):
    return sel.choose_uniform(master(spark, d), 77, [f"class_{i}" for i in range(1, 11)], 42).groupBy("class").agg(one())


def _quotas(spark, d, f):
    """Quota steps over the observed capacities: one row a class."""
    have = {c: n for c, n in sel.class_counts(master(spark, d)).items() if c != sel.NOISE}
    return spark.createDataFrame(sorted(f(have).items()), "class string, quota int")


@add("q1_weighted_quota", "select class, cast(floor(x) + case when row_number() over (order by x - floor(x) desc, md5(class)) <= 80 - (sum(floor(x)) over ()) then 1 else 0 end as int) as quota from (select class, 80.0 * n / sum(n) over () as x from (select lower(class) as class, count(*) as n from master where class <> 'noise' group by 1))")
def q1(spark, d):
    return _quotas(spark, d, lambda have: quota.weighted_quota(have, 80))


# what class_1 lacks no other class may take, as none has its weight
@add("q2_weighted_counts", _ctes("select class, cast(least(quota, have) as int) as quota from q", _QUOTAS.format(total=90)), None)
def q2(spark, d):
    return _quotas(spark, d, lambda have: quota.weighted_counts(have, sel.train_class_names(master(spark, d), IMPORTANCE), 90)[0])


@add("q3_uniform_counts", _ctes("select class, cast(quota as int) as quota from q", _EQUAL.format(total=77)), None)
def q3(spark, d):
    return _quotas(spark, d, lambda have: quota.uniform_counts(have, 77)[0])


@add("q4_largest_remainder", "with m as (select source as class, count(*) as n, 100.0 * count(*) / (select count(*) from documents) as x from documents group by 1) select class, cast(floor(x + 1e-9) + case when row_number() over (order by round(x - floor(x + 1e-9), 9) desc, class) <= 100 - (select sum(floor(x + 1e-9)) from m) then 1 else 0 end as int) as quota from m", None)
def q4(spark, d):
    counts = {r["source"]: r["n"] for r in table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a source
    total = sum(counts.values())
    return spark.createDataFrame(sorted(quota.largest_remainder(100, {c: n / total for c, n in counts.items()}).items()), "class string, quota int")


@add("q9_class_names", "select distinct class, case class when 'class_1' then 50.0 when 'class_2' then 20.0 else 1.0 end::double as weight from master where class not in ('noise', 'class_3')")
def q9(spark, d):
    return spark.createDataFrame(sorted(sel.train_class_names(master(spark, d), IMPORTANCE).items()), "class string, weight double")


CFG = sel.Selection(importance={"*": "not important"}, benchmark_classes=[f"class_{i}" for i in range(1, 11)], per_class=2, noise_benchmark=10, noise_validation=12, train=60, corpus=40, rl=40, rl_noise=8)


@add("q10_build_benchmark", """select s.sample_id, case when b.sample_id is null then 'corpus' else 'benchmark' end as split from master s left join (""" + _SPLIT.replace("range(1, 13)", "range(1, 11)").format(per=_PER.format(s=42), n=2, s=42, noise=10) + """) b on b.sample_id = s.sample_id""")
def q10(spark, d):
    return sel.build_benchmark(master(spark, d), CFG).select("sample_id", "split")


def _grown(m: DataFrame) -> sel.Selection:
    """CFG with splits that grow with the table: shares of its rows that are no noise."""
    n = m.filter(~sel.is_noise("class")).count()
    return replace(CFG, noise_validation=round(0.06 * n), train=round(0.3 * n), corpus=round(0.2 * n), rl=round(0.2 * n), rl_noise=round(0.04 * n))


#: Sizes of the splits as _grown sets them, and the classes in order of their names' hashes. No class is short of rows here.
_SIZES = """c as (select class, count(*) as have, row_number() over (order by md5(class)) as place from master where class <> 'noise' group by 1),
z as (select count(*) as k, sum(have)::double as n from c),
t as (select k, round_even(0.06 * n, 0)::bigint as noise, round_even(0.3 * n, 0)::bigint as train, round_even(0.2 * n, 0)::bigint as corpus, round_even(0.2 * n, 0)::bigint as rl, round_even(0.04 * n, 0)::bigint as rl_noise from z)"""
_Q11 = """select 'validation' as split, class, 2::bigint as rows from c union all select 'validation', 'noise', noise from t
  union all select 'train', class, train // k + (place <= train % k)::bigint from c, t union all select 'corpus', class, corpus // k + (place <= corpus % k)::bigint from c, t"""
_PICK = "select class, repetition_class from (select *, row_number() over (partition by class order by not coalesce(described, false), md5('{seed}:' || sample_id), sample_id) as j from master where class <> 'noise' and repetition_class in ({levels})) join c using (class), u where j <= {n} // k + (place <= {n} % k)::bigint"
_Q12 = f"""select repetition_class, class, count(*) as rows from ({_PICK.format(seed=42, levels="'low'", n="low")} union all {_PICK.format(seed=43, levels="'high', 'critical'", n="hard")}) group by all
  union all select level, 'noise', rows from noise_of"""


@add("q11_build_train", _ctes(_Q11, _SIZES), None)
def q11(spark, d):
    m = master(spark, d)
    return sel.build_train(m, _grown(m)).groupBy("split", "class").agg(one())


@add("q12_build_rl", _ctes(_Q12, _SIZES + """, u as (select k, rl, rl_noise, round_even((rl - rl_noise) * 0.25::double, 0)::bigint as low, rl - rl_noise - round_even((rl - rl_noise) * 0.25::double, 0)::bigint as hard from t),
noise_of as (select level, floor(x)::bigint + (row_number() over (order by x - floor(x) desc, level) <= rl_noise - sum(floor(x)) over ())::bigint as rows
  from (select level, rl_noise, rl_noise * share as x from u, (values ('low', 0.25::double), ('high', 0.25::double), ('critical', 0.5::double)) m(level, share)))"""), None)
def q12(spark, d):
    m = master(spark, d)
    return sel.build_rl(m, _grown(m)).groupBy("repetition_class", "class").agg(one())


_U = "(('0x' || substr(md5('9:' || sample_id), 1, 8))::bigint / 4294967296.0)"
_A, _B = "(coalesce(trim(llm_description), '') <> '')", "(coalesce(trim(llm_description_image), '') <> '')"


@add("q13_choose_description", f"""select sample_id, case when {_A} and {_U} * (2.0 + {_B}::int) < 2.0 then 'llm_description' when {_B} then 'llm_description_image' else '' end as source from master""")
def q13(spark, d):
    return master(spark, d).select("sample_id", sel.choose_description(MIX, 9, "sample_id")["source"].alias("source"))


@add("q14_described", f"select sample_id, {_A} or {_B} as described from master")
def q14(spark, d):
    return master(spark, d).select("sample_id", sel.described(MIX).alias("described"))


@add("q15_split_label", "select sample_id, case when dataset = 'benchmark' then 'benchmark' else 'train' end as split from master")
def q15(spark, d):
    return sel.split_label(master(spark, d)).select("sample_id", "split")


TARGETS = {"low": 3, "high": 5, "critical": 2}
_T = "case repetition_class when 'low' then 3 when 'high' then 5 when 'critical' then 2 else 0 end"


@add("w4_description_candidates", f"select sample_id, k as candidate, least(t, n) as wanted from (select sample_id, cast(row_number() over w as int) as k, {_T} as t, count(*) over (partition by dataset, class, repetition_class) as n from master window w as (partition by dataset, class, repetition_class order by {_M.format(s=1)}, sample_id)) where k <= 3 * t")
def w4(spark, d):
    return sel.description_candidates(master(spark, d), TARGETS, 3, ["dataset", "class"], 1).select("sample_id", "candidate", "wanted")


_LONG = "(select * from (select *, 'llm_description' as description_type, llm_description as dtext from master union all select *, 'llm_description_image', llm_description_image from master) where coalesce(trim(dtext), '') = '')"


@add("w5_missing_description_candidates", f"select sample_id, description_type, k as candidate, least(t, n) as wanted from (select sample_id, description_type, cast(row_number() over w as int) as k, {_T} as t, count(*) over (partition by description_type, class, repetition_class) as n from {_LONG} window w as (partition by description_type, class, repetition_class order by {_M.format(s=1)}, sample_id)) where k <= 3 * t")
def w5(spark, d):
    return sel.missing_description_candidates(master(spark, d), list(MIX), TARGETS, 3, ["class"], 1).select("sample_id", "description_type", "candidate", "wanted")


def _outcomes(spark, d):
    return sel.description_candidates(master(spark, d), TARGETS, 3, ["dataset", "class"], 1).withColumn("success", F.col("doc_id") % 3 != 1)


_W6 = f"""select sample_id from (select *, coalesce(sum(ok::int) over (partition by dataset, class, repetition_class order by k rows between unbounded preceding and 1 preceding), 0) as before from (
  select sample_id, dataset, class, repetition_class, doc_id % 3 <> 1 as ok, row_number() over w as k, {_T} as t, count(*) over (partition by dataset, class, repetition_class) as n from master window w as (partition by dataset, class, repetition_class order by {_M.format(s=1)}, sample_id)) where k <= 3 * t) where before < least(t, n) and """


@add("w6_accept_with_fallback", _W6 + "ok")
def w6(spark, d):
    return sel.accept_with_fallback(_outcomes(spark, d), ["dataset", "class", "repetition_class"])[0].select("sample_id")


@add("w6_fallback_failures", _W6 + "not ok")
def w6f(spark, d):
    return sel.accept_with_fallback(_outcomes(spark, d), ["dataset", "class", "repetition_class"])[1].select("sample_id")


@add("w7_sample_names", "select sample_id, class || '_' || lpad(cast(row_number() over (partition by class order by sample_id) - 1 as varchar), 8, '0') as sample_name from master")
def w7(spark, d):
    return sel.sample_names(master(spark, d)).select("sample_id", "sample_name")


@add("j2_attach_metadata", "select sample_id, class, token_len from master")
def j2(spark, d):
    m = master(spark, d)
    return sel.attach_metadata(m.select("sample_id", "class"), m.select("sample_id", "token_len"))


@add("j4_merge_descriptions", f"select sample_id, md5(case when {_A} then llm_description when doc_id % 2 = 0 then 'new ' || doc_id else coalesce(llm_description, '') end) as value from master")
def j4(spark, d):
    m = master(spark, d)
    new = m.filter("doc_id % 2 = 0").select("sample_id", F.lit("llm_description").alias("description_type"), F.concat(F.lit("new "), "doc_id").alias("text"))
    return sel.merge_descriptions(m, new, ["llm_description"]).select("sample_id", F.md5(F.coalesce("llm_description", F.lit(""))).alias("value"))


@add("a10_class_distribution", "select dataset, class, repetition_class, count(*) as rows from master group by all")
def a10(spark, d):
    return sel.class_distribution(master(spark, d), ["dataset", "class", "repetition_class"])


@add("a21_description_report", f"select * from (select 'llm_description' as description_type, dataset, count(*) as generated from master where {_A} group by dataset union all select 'llm_description_image', dataset, count(*) from master where {_B} group by dataset)")
def a21(spark, d):
    return sel.description_report(master(spark, d), list(MIX), ["dataset"])



