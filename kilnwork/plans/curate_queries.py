"""Queries of sources, filters, deduplication, render results and the curation flow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, ngrams, render
from ..operators import select as sel
from ..sources import tables
from .text_queries import _CLASS, _COVER, _SCORE
from .views import attempts, hashed, samples, sql_strip, table, with_views

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


def _pools(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = hashed(spark, d)
    return rows.filter("dataset = 'pool'"), rows.filter("dataset = 'benchmark'")


@add("s1_read_samples", "select cast(doc_id as bigint) as id, md5(coalesce(text, '')) as code, source, 'pool' as dataset from documents")
def s1(spark, d):
    return tables.read_samples(spark, f"{d}/documents.parquet", tables.SourceSpec("pool", id="doc_id", code="text", source="source")).withColumn("code", F.md5(F.coalesce("code", F.lit(""))))


@add("s2_read_split", "select 'documents' as split, count(*) as rows, sum(strlen(text)) as bytes from documents")
def s2(spark, d):
    return tables.mapped(tables.read_split(spark, f"{d}/documents.parquet", "documents"), tables.SourceSpec("x", code="text")).agg(F.lit("documents").alias("split"), one(), F.sum(F.octet_length("code")).cast("double").alias("bytes")).select("split", "rows", "bytes")


@add("s3_resolve_code_column", "select 'text' as column, count(*) as rows from documents where text is not null")
def s3(spark, d):
    docs = table(spark, d, "documents")
    name = tables.resolve_code_column(docs, ("reference_code", "code", "text"))
    return docs.filter(F.col(name).isNotNull()).agg(F.lit(name).alias("column"), one()).select("column", "rows")


@add("s4_read_manifest", "select cast(doc_id as varchar) as sample_id, source from documents where doc_id is not null")
def s4(spark, d):
    from ..plans.paths import scratch

    path = scratch(spark, "manifest")
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "source").write.csv(path, header=True)
    return tables.read_manifest(spark, path, ["sample_id", "source"]).select("sample_id", "source")


_PATH = "case page_id % 4 when 0 then 'file:///images/' || page_id || '.png' when 1 then 'img/' || page_id || '.png' when 2 then '/references/' || page_id else '/other/' || page_id end"


@add("s5_normalize_paths", "select page_id, case page_id % 4 when 0 then '/data/img/' || page_id || '.png' when 1 then '/base/img/' || page_id || '.png' when 2 then '/data/ref/' || page_id else '/other/' || page_id end as path from pages")
def s5(spark, d):
    return table(spark, d, "pages").select("page_id", tables.normalize_path(F.expr(_PATH), "/base", {"/images": "/data/img", "/references": "/data/ref/"}).alias("path"))


def _shardable(spark, d):
    return samples(spark, d).select("sample_id", "text", F.col("dataset").alias("split"))


@add("s6_write_shards", "select dataset as split, count(*) as rows, cast(sum(strlen(sample_id) + strlen(coalesce(text, '')) + strlen(dataset)) as bigint) as bytes, count(*) as rows_read, true as within from samples group by dataset", "samples")
def s6(spark, d):
    from ..plans.paths import scratch

    path = scratch(spark, "shards")
    wrote = tables.write_shards(_shardable(spark, d), path, 1 << 20, "sample_id")
    back = spark.read.parquet(path).groupBy("split", "shard").agg(one())
    both = wrote.join(back.withColumnRenamed("rows", "rows_read"), ["split", "shard"])
    return both.groupBy("split").agg(F.sum("rows").alias("rows"), F.sum("bytes").cast("long").alias("bytes"), F.sum("rows_read").alias("rows_read"), (F.max("bytes") <= (1 << 20)).alias("within"))


@add("s7_shard_manifest", "select dataset as split, count(*) as rows, cast(sum(strlen(sample_id) + strlen(coalesce(text, '')) + strlen(dataset)) as bigint) as bytes, true as within from samples group by dataset", "samples")
def s7(spark, d):
    m = tables.shard_manifest(tables.with_shards(_shardable(spark, d), 1 << 20, "sample_id"))
    return m.groupBy("split").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), (F.max("bytes") <= (1 << 20)).alias("within"))


@add("s8_export_manifest", "select sample_id, '' as input_image, '' as reference_image, '' as llm_description, '' as llm_description_source, md5(coalesce(code, '')) as reference_code, '' as class, '' as repetition_class, cast(length(text) as varchar) as token_len, source, '' as type from samples", "samples")
def s8(spark, d):
    return tables.export_manifest(samples(spark, d).withColumn("reference_code", F.md5(F.coalesce("code", F.lit("")))).withColumn("token_len", F.length("text")))


@add("s9_read_jsonl_log", "select event_id, event_type, value from events")
def s9(spark, d):
    from ..plans.paths import scratch

    path = scratch(spark, "log")
    table(spark, d, "events").select("event_id", "event_type", "value").write.json(path)
    return tables.read_jsonl_log(spark, path, "event_id long, event_type string, value double")


@add("s10_fetch_rows", "select sample_id, md5(coalesce(code, '')) as code from samples where sample_id in (select 's' || doc_id from labels where toxic = 1)", "samples")
def s10(spark, d):
    keys = table(spark, d, "labels").filter("toxic = 1").select(F.concat(F.lit("s"), "doc_id").alias("sample_id"))
    return tables.fetch_rows(samples(spark, d), keys, ["code"]).withColumn("code", F.md5(F.coalesce("code", F.lit(""))))


_DATE = "case when doc_id % 50 = 0 then 'n/a' else '2025-' || lpad(cast(8 + doc_id % 5 as {s}), 2, '0') || '-' || lpad(cast(1 + doc_id % 28 as {s}), 2, '0') end"


def _dated(spark, d):
    return samples(spark, d).filter("dataset = 'benchmark'").withColumn("date", F.expr(_DATE.format(s="string"))).withColumnRenamed("source", "origin")


_SQLDATE = f"(select *, try_cast({_DATE.format(s='varchar')} as date) as day from samples where dataset = 'benchmark')"


@add("f1_filter_dates", f"select doc_id, source as origin from {_SQLDATE} where day between date '2025-10-01' and date '2026-04-30' and source in ('src0', 'src1', 'src2')", "samples")
def f1(spark, d):
    return dedup.filter_dates(_dated(spark, d), "2025-10-01", "2026-04-30", ["SRC0", "src1", "src2"])[0].select("doc_id", "origin")


@add("f1_filter_dates_counts", f"""select count(*) as before, count(*) filter (where day is not null and source <> 'src3' and day between date '2025-10-01' and date '2026-04-30') as after,
  count(*) filter (where day is null) as invalid_dates, count(*) filter (where day is not null and source = 'src3') as wrong_origin,
  count(*) filter (where day is not null and source <> 'src3' and not day between date '2025-10-01' and date '2026-04-30') as outside_range from {_SQLDATE}""", "samples")  # fmt: skip
def f1c(spark, d):
    return dedup.filter_dates(_dated(spark, d), "2025-10-01", "2026-04-30", ["src0", "src1", "src2"])[1]


_COUNTED = f"(select *, case when {sql_strip(chr(99) + 'oalesce(code, ' + chr(39) * 2 + ')')} <> '' then len(tokens) else 0 end as n from tokenized join samples using (doc_id, sample_id, dataset))"


def _tokened(spark, d):
    return samples(spark, d).withColumn("token_len", text.token_len("code"))


@add("f2_filter_tokens", f"select dataset, sample_id, cast(n as int) as token_count, case when n = 0 then 'empty_code' else 'too_long' end as reason from {_COUNTED} where n = 0 or n > 600", "tokenized")
def f2(spark, d):
    return dedup.filter_tokens(_tokened(spark, d), 600)[1]


@add("f2_filter_tokens_counts", f"select dataset, count(*) as before, count(*) filter (where n > 0 and n <= 600) as after, count(*) filter (where n = 0 or n > 600) as rejected, cast(max(n) as int) as max_seen from {_COUNTED} group by dataset", "tokenized")
def f2c(spark, d):
    return dedup.filter_tokens(_tokened(spark, d), 600)[2]


@add("w1_first_occurrence", "select sample_id, code_hash from (select *, row_number() over (partition by code_hash order by md5('42:' || sample_id), sample_id) as k from hashed) where k = 1 or code_hash = ''", "hashed")
def w1(spark, d):
    return dedup.first_occurrence(hashed(spark, d), 42, "sample_id").select("sample_id", "code_hash")


@add("j1_decontaminate", "select sample_id from hashed where dataset = 'pool' and (code_hash = '' or code_hash not in (select code_hash from hashed where dataset = 'benchmark'))", "hashed")
def j1(spark, d):
    return dedup.decontaminate(*_pools(spark, d)).select("sample_id")


@add("u2_hash_intersection", "select code_hash from hashed where dataset = 'pool' and code_hash <> '' intersect select code_hash from hashed where dataset = 'benchmark'", "hashed")
def u2(spark, d):
    return dedup.hash_intersection(*_pools(spark, d))


@add("a1_duplicate_stats", """select count(*) as groups, cast(coalesce(sum(n - 1), 0) as bigint) as rows_removed, count(*) filter (where n = 2) as exactly_2, count(*) filter (where n = 3) as exactly_3,
  count(*) filter (where n = 4) as exactly_4, count(*) filter (where n >= 5) as five_or_more, coalesce(max(n), 1) as largest from (select code_hash, count(*) as n from hashed where code_hash <> '' group by 1 having count(*) > 1)""", "hashed")  # fmt: skip
def a1(spark, d):
    return dedup.duplicate_stats(hashed(spark, d))


@add("a2_cross_overlap_stats", "select count(*) as matching_hashes, cast(coalesce(sum(n), 0) as bigint) as train_rows, count(*) as unique_rows_removed from (select code_hash, count(*) as n from hashed where dataset = 'pool' and code_hash <> '' group by 1) where code_hash in (select code_hash from hashed where dataset = 'benchmark')", "hashed")
def a2(spark, d):
    return dedup.cross_overlap_stats(*_pools(spark, d))


@add("w2_assign_ids", """select doc_id, case when k = 1 then b else b || ':' || k || ':' || left(code_hash, 8) end as sample_id from (select *, row_number() over (partition by b order by doc_id) as k from (
  select doc_id, code_hash, 'pool:' || case when doc_id % 10 = 0 then 'row-' || lpad(cast(row_number() over (partition by doc_id % 10 = 0 order by doc_id) - 1 as varchar), 9, '0') else 'k' || (doc_id // 3) end as b from hashed))""", "hashed")  # fmt: skip
def w2(spark, d):
    rows = hashed(spark, d).drop("sample_id").withColumn("raw", F.expr("case when doc_id % 10 = 0 then null else 'k' || (doc_id div 3) end"))
    return dedup.assign_ids(rows, "pool", "raw", "code_hash", "doc_id").select("doc_id", "sample_id")


@add("a20_pipeline_funnel", """select stage, dataset, before, after, before - after as rejected from (
  select 'dedup' as stage, dataset, count(*) as before, count(*) filter (where k = 1 or code_hash = '') as after from (select *, row_number() over (partition by code_hash order by md5('42:' || sample_id), sample_id) as k from hashed) group by dataset
  union all select 'blank', dataset, count(*), count(*) filter (where code_hash <> '') from hashed group by dataset)""", "hashed")  # fmt: skip
def a20(spark, d):
    rows = hashed(spark, d)
    return dedup.pipeline_funnel([("dedup", rows, dedup.first_occurrence(rows, 42, "sample_id")), ("blank", rows, rows.filter("code_hash <> ''"))])


_REASON = "case when errors > 0 then 'latex_error' when pages <> 1 then 'multipage_pdf' when ink < 0.5 then 'blank_image' end"


@add("w3_pick_render_attempt", """select sample_id, coalesce(fp = 1, false) as success, case when fp = 1 then null when fp is not null then 'multipage_pdf' when late then 'latex_timeout' else 'render_failed' end as reason,
  case when fp is not null then fa else la end as attempt, case when fp is not null then fp else lp end as pages, case when fp is not null then fe else le end as errors, case when fp is not null then fw else lw end as warnings, case when fp is not null then fb else lb end as badboxes
  from (select sample_id, min(attempt) filter (where ok) as fa, arg_min(pages, attempt) filter (where ok) as fp, arg_min(errors, attempt) filter (where ok) as fe, arg_min(warnings, attempt) filter (where ok) as fw, arg_min(badboxes, attempt) filter (where ok) as fb,
    max(attempt) as la, arg_max(pages, attempt) as lp, arg_max(errors, attempt) as le, arg_max(warnings, attempt) as lw, arg_max(badboxes, attempt) as lb, bool_or(returncode = 124) as late
    from (select *, pdf_created and returncode <> 124 as ok from attempts) group by sample_id)""", "attempts")  # fmt: skip
def w3(spark, d):
    return render.pick_render_attempt(attempts(spark, d))


@add("f3_render_gate", f"select event_id, {_REASON} as reason from attempts", "attempts")
def f3(spark, d):
    return attempts(spark, d).select("event_id", render.render_gate(0.5).alias("reason"))


@add("f4_flag_low_similarity", "select event_id, value / 100 < 0.85 as low_similarity from events")
def f4(spark, d):
    return render.flag_low_similarity(table(spark, d, "events").withColumn("image_similarity", F.col("value") / 100))[0].select("event_id", "low_similarity")


@add("a22_failure_report", "select event_type as dataset, 'bad_' || (event_id % 3) as reason, count(*) as failures from events group by all")
def a22(spark, d):
    return render.failure_report(table(spark, d, "events").select(F.col("event_type").alias("dataset"), F.expr("'bad_' || (event_id % 3) || ': at ' || event_id").alias("reason")))


@add("j7_dedupe_expensive", "select doc_id, cast(length(coalesce(text, '')) as bigint) as size from documents")
def j7(spark, d):
    return render.dedupe_expensive(table(spark, d, "documents"), ["text"], lambda x: x.withColumn("size", F.length(F.coalesce("text", F.lit(""))).cast("long")), "v1").select("doc_id", "size")


@add("o1_seeded_order", "select sample_id from samples order by md5('7:' || sample_id), sample_id limit 100", "samples")
def o1(spark, d):
    return sel.sample_n(samples(spark, d), 100, 7, "sample_id").select("sample_id")


@add("u1_union_sources", "select 'docs' as dataset, count(*) as rows from documents union all select 'pages', count(*) from pages")
def u1(spark, d):
    return sel.union_sources(docs=table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code")), pages=table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("code"))).groupBy("dataset").agg(one())


def curate_flow(spark: SparkSession, d: str) -> DataFrame:
    """Documents normalised, deduplicated in their pool, decontaminated, classified and counted."""
    train, bench = (dedup.first_occurrence(p, 42, "sample_id") for p in _pools(spark, d))
    rows = dedup.decontaminate(train, bench).select("doc_id")
    return ngrams.repetition_score(samples(spark, d).join(rows, "doc_id", "left_semi")).groupBy("source", "repetition_class").agg(one())


QUERIES["curate_flow"] = curate_flow
SQL["curate_flow"] = with_views("", "hashed", "tokenized").rstrip() + f""", {_COVER},
kept as (select doc_id, source from (select *, row_number() over (partition by code_hash order by md5('42:' || sample_id), sample_id) as k from hashed where dataset = 'pool')
  where code_hash = '' or (k = 1 and code_hash not in (select code_hash from hashed where dataset = 'benchmark')))
select source, {_CLASS.format(s='s')} as repetition_class, count(*) as rows
from (select k.doc_id, k.source, {_SCORE} as s from kept k join tokenized t using (doc_id) left join cover using (doc_id) group by all) group by all"""

