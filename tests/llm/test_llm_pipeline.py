"""The pipeline's stages against brute-force versions on the smallest table."""

from __future__ import annotations

import glob
import hashlib

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline as pipeline
from kilnwork.llm import minhash, mixing, quality, secrets
from kilnwork.llm.common import written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for name, stage in pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], DATA), name.replace(" ", "-")))
        if name != "bpe":
            assert kept[-1].columns == docs.columns
    ids = [sorted(r["doc_id"] for r in d.collect()) for d in kept]
    scores = quality.score(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids[1] == sorted(r["doc_id"] for r in scores.filter("predicted = 1").collect())
    near = minhash.near_duplicates(kept[1])
    assert ids[2] == sorted(r["doc_id"] for r in near.filter("kept").collect())
    assert ids[3] == ids[2]
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(kept[2]).collect()}
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (kept[2], kept[3]))
    assert all((before[i] != after[i]) == bool(spans[i]) for i in before)
    assert set(ids[4]) == set(ids[3])  # mixing leaves none out
    last = {r["doc_id"]: r for r in kept[5].collect()}
    for i, t in after.items():
        r = last[i]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["token_ids"])).encode()).hexdigest()
        assert (r["n_tokens"] > 0) == bool((t or "").strip())
    assert sorted(r["doc_id"] for r in pipeline.run(spark, DATA).collect()) == ids[5]


def test_the_files_of_the_mixing_stage_are_in_the_order_of_the_mix(spark, tmp_path):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 10 < 6 then 'a' when id % 10 < 9 then 'b' else 'c' end as source").repartition(7)
    pipeline.mixed(spark, docs, DATA).write.parquet(str(tmp_path / "mixed"))
    files = [pq.read_table(f).to_pylist() for f in sorted(glob.glob(str(tmp_path / "mixed" / "part-*.parquet")))]
    got = [r for rows in files for r in rows]
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in mixing.mix(docs).orderBy("mix_pos").collect()]
    total = sum(n**mixing.POWER for n in (3600, 1800, 600))
    for s, n in (("a", 3600), ("b", 1800), ("c", 600)):
        seen = np.cumsum([r["source"] == s for r in got])
        assert np.abs(seen - n**mixing.POWER / total * np.arange(1, len(seen) + 1)).max() < 2 * mixing.BLOCK


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, shard int, size int, mix_pos int, component_id int"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and ids, an empty table, columns with the operators' own names."""
    extra = ("k", 0.5, 1, 2, 3, 4)
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, "one two three four five six seven", "en", "a", 33), (1, "one two three four five six seven", "en", "a", 33), (1, "another text of the same id", "en", "a", 27)]
    rows += [(None, "one two three four five six seven", "en", "a", 33), (None, "one two three four five six seven", "en", "a", 33), (2, None, None, None, None), (3, "", "en", None, 0)]
    rows += [(4, long, "en", "b", len(long)), (5, "password = hunter2hunter2", "en", "b", 25), (5, "password = hunter2hunter2", "en", "c", 25)]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], ODD).repartition(3)
    spark.createDataFrame([(4, 1, 0), (1, 1, 0), (3, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    data = f"file://{tmp_path}"
    for d in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            out = written(stage(spark, d, data), name.replace(" ", "-"))
            assert name == "bpe" or out.columns == d.columns, name
            assert (out.count() > 0) == (d.count() > 0) or name == "quality", name
    kept = sorted(((r["doc_id"], r["text"], r["source"]) for r in pipeline.single(spark, docs, data).collect()), key=repr)
    assert kept == sorted([(1, rows[0][1], "a"), (1, rows[2][1], "a"), (None, rows[0][1], "a"), (2, None, None), (3, "", None), (4, long, "b"), (5, rows[8][1], "b")], key=repr)
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.clean(spark, docs, data).collect()}
    assert clean[5] == ("<assign>", 8) and clean[2] == (None, None) and clean[3] == ("", 0)
    mixed = pipeline.mixed(spark, docs, data).collect()
    assert {(r["doc_id"], r["text"], r["mix_pos"]) for r in mixed} == {(r[0], r[1], 3) for r in rows}


def test_mixing_shuffles_texts_twice_and_few_kept_ids_shuffle_none(spark):
    """Starts of buckets and kept ids are counted and broadcast even where estimates would shuffle the texts to meet them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = written(spark.range(400).selectExpr("id as doc_id", "concat('text of its own ', id, ' ', sha2(string(id), 256)) as text", "string(id % 3) as source", "50L as n_chars"), "docs")
        mixed = pipeline.mixed(spark, docs, DATA)
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and mixed.select("doc_id").distinct().count() == 400
        assert "SortMergeJoin" not in pipeline.single(spark, docs, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
