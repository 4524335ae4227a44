"""The given tables in the roles of pools, pairs, attempts and logs: once as DataFrames, once as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import code_hash
from ..sources.scratch import stored
from .paths import ship


#: Tables with long texts, over which queries compute much.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One of texts that lies in fewer files than there are cores (a small file is one row group, so one task) is
    dealt to all of them; others are read as they are split."""
    ship(spark)
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in TEXTS and len(rows.inputFiles()) < cores else rows


def quoted(text: str) -> str:
    """A string for both dialects: backslashes and breaks by number."""
    for raw, code in (("\\", 92), ("\n", 10), ("\r", 13)):
        text = text.replace(raw, f"' || chr({code}) || '")
    return f"'{text}'"


_Q = quoted
#: Code of a document, around its whole text: fenced, with comments and numbers, inside a document or a picture, or as it is.
CODE = f"""case
 when doc_id % 5 = 0 then {_Q("```LaTeX" + chr(10))} || text || {_Q(" " + chr(10) + "```" + chr(10))}
 when doc_id % 5 = 1 then text || {_Q(chr(13) + chr(10) + "\\draw (0,1.5) -- (x12,-2e3); % note \\% x" + chr(10) + "  \\draw (0,2.5) -- (x12,-3e4);" + chr(10) + "\\node at (1,2) {a}; \\% kept % gone" + chr(10))}
 when doc_id % 5 = 2 then {_Q("see \\documentclass{a}" + chr(10) + "\\begin{document}" + chr(10))} || text || {_Q(" \\end{document} tail \\end{document} more")}
 when doc_id % 5 = 3 then {_Q("text ```tex" + chr(10) + "\\begin{tikzpicture}")} || text || {_Q("\\end{tikzpicture} x``` after it")}
 else text end"""
DATASET = "case when source in ('src0', 'src1', 'src2', 'src3') then 'benchmark' else 'pool' end"
WS = "[\\s\\v]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_normal(x: str) -> str:
    t = sql_strip(f"replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))")
    t = f"regexp_replace({t}, '(?i)^```(?:latex|tex|tikz)?{WS}*', '')"
    t = f"regexp_replace({t}, '{WS}*```$', '')"
    return sql_strip(f"regexp_replace({t}, '[ \\t\\v\\f\\r]+(\\n|$)', '\\1', 'g')")


def sql_comments_off(x: str) -> str:
    lines = f"regexp_replace(regexp_replace(coalesce({x}, ''), '\\r\\n|[\\r\\v\\f\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '\\n$', '')"
    return f"regexp_replace({lines}, '(?m)(^|[^\\\\\\n])%[^\\n]*', '\\1', 'g')"


def sql_numbers(x: str) -> str:
    """No look-behind in this dialect: a letter and the character after it are a match of their own, put back afterwards."""
    number = "[-+]?(?:\\d+\\.\\d*|\\.\\d+|\\d+)(?:[eE][-+]?\\d+)?"
    held = f"regexp_replace({x}, '{number}|([A-Za-z][-+.0-9])', '\\1\x01NUM', 'g')"
    return f"replace(regexp_replace({held}, '([A-Za-z][-+.0-9])\x01NUM', '\\1', 'g'), '\x01', '')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all({sql_numbers(sql_comments_off(x))}, '\\\\[A-Za-z@]+|NUM|[A-Za-z_][A-Za-z0-9_]*|--|->|<-|<->|[^\\s\\v]')"


def sql_grams(orders: str, view: str = "tokenized") -> str:
    """(doc_id, n, gram): all n-grams of the view's tokens."""
    at = f"select doc_id, unnest(tokens) as tok, generate_subscripts(tokens, 1) as i, len(tokens) as k from {view}"
    each = [f"select doc_id, {n} as n, gram from (select doc_id, i, k, string_agg(tok, chr(1)) over (partition by doc_id order by i rows between current row and {int(n) - 1} following) as gram from ({at})) where i <= k - {n} + 1" for n in orders.split(",")]
    return " union all ".join(each)


VIEWS = {
    "samples": f"select doc_id, 's' || doc_id as sample_id, source, {DATASET} as dataset, text, {CODE} as code from documents",
    "normal": f"select *, {sql_normal('code')} as norm from samples",
    "hashed": "select *, case when norm = '' then '' else sha256(norm) end as code_hash from normal",
    "tokenized": f"select doc_id, sample_id, dataset, {sql_tokens('code')} as tokens from samples",
    "master": """select s.doc_id, s.sample_id, s.source, s.dataset, case when s.doc_id % 6 = 5 then 'noise' else coalesce('class_' || (e.label + 1), 'noise') end as class,
      case s.doc_id % 5 when 0 then 'low' when 1 then 'medium' when 2 then 'high' when 3 then 'very_high' else 'critical' end as repetition_class,
      cast(length(s.text) as int) as token_len, case when l.quality = 1 then s.text end as llm_description,
      case when s.doc_id % 3 = 0 then s.text end as llm_description_image, l.quality = 1 as described
      from samples s left join embeddings e on e.vec_id = s.doc_id left join (select doc_id, max(quality) as quality from labels group by doc_id) l on l.doc_id = s.doc_id""",
    "pairs": """select conv_id || ':' || turn as test_id, 'model_' || (conv_id % 3) as provider, conv_id, before as reference, text as generated
      from (select *, lag(text) over (partition by conv_id order by turn) as before, lag(role) over (partition by conv_id order by turn) as role_before from conversations) x
      where role = 'assistant' and role_before = 'user'""",
    "attempts": """select cast(user_id as varchar) as sample_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as attempt,
      case when event_type = 'error' then 1 when event_type = 'signup' then 124 else 0 end as returncode, event_type <> 'error' as pdf_created,
      cast(case when event_id % 4 = 0 then 2 else 1 end as int) as pages, cast(event_id % 3 as int) as errors, cast(event_id % 5 as int) as warnings, cast(event_id % 2 as int) as badboxes,
      value as ink, event_id from events""",
    "trainlog": """select event_id + 1 as microbatch, cast(user_id as varchar) as code_path, cast(event_id % 97 as double) / 97 as normalized_line_repetition_ratio,
      cast(event_id % 13 as int) as max_identical_normalized_line_run, cast(event_id % 4096 as int) as active_targets from events""",
}
NEEDS = {"tokenized": ["samples"], "normal": ["samples"], "hashed": ["normal"], "master": ["samples"]}


def with_views(sql: str, *names: str) -> str:
    """sql over the given views and what they stand on."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in order) + "\n" + sql


def samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", "'s' || doc_id as sample_id", "source", f"{DATASET} as dataset", "text", f"{CODE} as code")


def hashed(spark: SparkSession, d: str) -> DataFrame:
    """Keys and hashes of the samples, computed once: what finds duplicates needs no text."""
    return stored(samples(spark, d).select("doc_id", "sample_id", "source", "dataset", code_hash("code").alias("code_hash")), "hashes")


def master(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = samples(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left").join(labels, "doc_id", "left")
    return rows.selectExpr("doc_id", "sample_id", "source", "dataset", "case when doc_id % 6 = 5 then 'noise' else coalesce('class_' || (label + 1), 'noise') end as class", "case doc_id % 5 when 0 then 'low' when 1 then 'medium' when 2 then 'high' when 3 then 'very_high' else 'critical' end as repetition_class", "length(text) as token_len", "case when quality = 1 then text end as llm_description", "case when doc_id % 3 = 0 then text end as llm_description_image", "quality = 1 as described")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "conversations").createOrReplaceTempView("kiln_conversations")
    return spark.sql(VIEWS["pairs"].replace("from conversations", "from kiln_conversations"))


def _events(spark: SparkSession, d: str, view: str) -> DataFrame:
    table(spark, d, "events").createOrReplaceTempView("kiln_events")
    return spark.sql(VIEWS[view].replace("from events", "from kiln_events").replace("as varchar", "as string"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "attempts")


def trainlog(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "trainlog")
