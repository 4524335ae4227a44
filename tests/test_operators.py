"""Hand-made rows for render results, scores, vectors, sources."""

from __future__ import annotations

import gc
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kilnwork.functions import grams, helpers, scores
from kilnwork.operators import clustering, dedup, ngrams, render, scoring, training
from kilnwork.operators import select as sel
from kilnwork.operators.places import numbered
from kilnwork.sources import tables
from kilnwork.sources.scratch import scratch


def test_render_attempts(spark):
    rows = [("a", 1, 1, False, 0), ("a", 2, 1, False, 0), ("a", 3, 0, True, 1), ("b", 1, 124, True, 1), ("b", 2, 1, False, 0), ("c", 1, 0, True, 2), ("c", 2, 0, True, 1), ("d", 1, 1, False, 0)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "sample_id string, attempt int, returncode int, pdf_created boolean, pages int, errors int, warnings int, badboxes int")
    strict = {r["sample_id"]: (r["success"], r["reason"], r["attempt"]) for r in render.pick_render_attempt(df).collect()}
    assert strict == {"a": (True, None, 3), "b": (False, "latex_timeout", 2), "c": (False, "multipage_pdf", 1), "d": (False, "render_failed", 1)}
    loose = {r["sample_id"]: (r["success"], r["attempt"]) for r in render.pick_render_attempt(df, strict=False).collect()}
    assert loose == {"a": (True, 3), "b": (True, 1), "c": (True, 2), "d": (False, 1)}


def test_scores(spark):
    df = spark.createDataFrame([(x,) for x in (math.nan, math.inf, -1.0, 2.0, 0.5, None)], "x double")
    assert [(r[0][0], r[0][1]) for r in df.select(scores.score_result("x", 0.5)).collect()] == [(False, 0.0), (False, 0.0), (False, 0.0), (True, 1.0), (True, 0.5), (False, 0.0)]
    r = spark.range(1).select(scores.diagnostic_reward(F.lit(2), F.lit(2), F.lit(5)), scores.total_reward(F.lit(True), F.lit(1.0), F.lit(1.0), F.lit(1.0)), scores.total_reward(F.lit(False), F.lit(1.0), F.lit(1.0), F.lit(1.0))).first()
    assert [round(x, 9) for x in r] == [0.65, 5.5, -2.0]
    long = spark.createDataFrame([("p", "t", "m", 0.3), ("p", "u", "m", 0.3)], "provider string, test_id string, metric string, score double")
    assert [r["combined"] for r in scoring.combined_score(long, ["provider", "test_id"]).collect()] == [None, None]


def test_ids(spark):
    rows = [(1, "a"), (2, "a"), (3, "a"), (4, None), (5, ""), (6, "b")]
    df = spark.createDataFrame([(i, r, "f" * 64) for i, r in rows], "i int, raw string, h string")
    got = [r["sample_id"] for r in dedup.assign_ids(df, "s", "raw", "h", "i").orderBy("i").collect()]
    assert got == ["s:a", "s:a:2:ffffffff", "s:a:3:ffffffff", "s:row-000000000", "s:row-000000001", "s:b"]


def test_dates(spark):
    df = spark.createDataFrame([("2025-10-01", "x"), ("2026-04-30T23:59:59Z", "X"), ("2026-05-01", "x"), ("bad", "x"), ("2025-12-01", "y"), (None, None)], "date string, origin string")
    kept, counts = dedup.filter_dates(df, "2025-10-01", "2026-04-30", ["X"])
    assert kept.count() == 2 and counts.first().asDict() == {"before": 6, "after": 2, "invalid_dates": 2, "outside_range": 1, "wrong_origin": 1}


def test_silhouette_and_pca(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (40, 5)), rng.normal(4, 1, (30, 5))])
    y = np.array([0] * 40 + [1] * 30)
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for i in range(70):
        own = far[i][(y == y[i]) & (np.arange(70) != i)].mean()
        other = far[i][y != y[i]].mean()
        s.append((other - own) / max(own, other))
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))], "sample_id long, reduced array<double>, cluster int")
    assert abs(clustering.silhouette(df) - np.mean(s)) < 1e-9
    assert clustering.silhouette(df.filter("cluster = 0")) is None
    out, share = clustering.reduce_pca(df.withColumnRenamed("reduced", "embedding"), 2)
    u, sv, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = np.array([r["reduced"] for r in out.orderBy("sample_id").collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ vt[:2].T), atol=1e-6) and abs(share - (sv[:2] ** 2).sum() / (sv**2).sum()) < 1e-6
    with pytest.raises(ValueError):
        clustering.cluster_kmeans(df.limit(3), 5)


def test_shards(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("t"), (F.col("id") % 2).alias("split"))
    m = tables.write_shards(df, f"file://{tmp_path}/s", 3000, "k").collect()
    assert sum(r["rows"] for r in m) == 200 and max(r["bytes"] for r in m) <= 3000
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 200
    with pytest.raises(ValueError):
        tables.with_shards(df, 100, "k")


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("\ufeffa,b\n1,\"x\ny\"\n2,z\n".encode())
    df = tables.read_manifest(spark, f"file://{tmp_path}/m.csv", ["a", "b"], 1)
    assert df.collect()[0].asDict() == {"a": "1", "b": "x\ny"}
    with pytest.raises(ValueError):
        tables.read_manifest(spark, f"file://{tmp_path}/m.csv", ["c"])
    assert tables.read_jsonl_log(spark, f"file://{tmp_path}/none", "a int").count() == 0
    for name in ("train", "other"):
        spark.range(3).write.parquet(f"file://{tmp_path}/root/{name}")
    assert tables.read_split(spark, f"file://{tmp_path}/root", "train").count() == 3
    assert tables.read_split(spark, f"file://{tmp_path}/root", "missing").count() == 6


def test_batches(spark):
    df = spark.createDataFrame([(1, [5, 6], [7]), (1, [5], [7, 8, 9])], "b int, prompt_ids array<int>, target_ids array<int>")
    got = training.pad_batches(training.mask_labels(df, eos=2), "b", 0).orderBy("active_targets").collect()
    assert got[0]["input_ids"] == [5, 6, 7, 2, 0] and got[0]["labels"] == [-100, -100, 7, 2, -100] and got[0]["attention_mask"] == [1, 1, 1, 1, 0]
    assert got[1]["active_targets"] == 4


def test_places_in_groups(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("g"), F.pmod(F.col("id") * 7919, F.lit(1000)).alias("o")).repartition(7)
    got = numbered(df, ["o"], "place", ["g"]).collect()
    for g in (0, 1):
        rows = sorted((r["o"], r["place"]) for r in got if r["g"] == g)
        assert [p for _, p in rows] == list(range(len(rows)))
    assert sorted((r["o"], r["place"]) for r in numbered(df, ["o"], "place").collect()) == [(i, i) for i in range(1000)]
    assert numbered(df.limit(0), ["o"], "place").count() == 0


def test_names_number_each_class(spark):
    df = spark.createDataFrame([(f"s{i:03}", "noise" if i % 3 else f"Class {i % 2}") for i in range(90)] + [("s999", None)], "sample_id string, class string")
    got = {r["sample_id"]: r["sample_name"] for r in sel.sample_names(df).collect()}
    assert got["s001"] == "noise_00000000" and got["s089"] == "noise_00000059" and got["s000"] == "Class_0_00000000" and got["s999"] == "class_00000000"
    with pytest.raises(ValueError):
        sel.sample_names(spark.createDataFrame([("a", "x y"), ("b", "x_y")], "sample_id string, class string"))


def test_metadata_rows_are_one_a_sample(spark):
    staging = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    meta = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "sample_id string, n int")
    assert sel.attach_metadata(staging, meta("a", "b", "c")).count() == 2
    for wrong in (meta("a"), meta("a", "b", "b")):
        with pytest.raises(ValueError):
            sel.attach_metadata(staging, wrong)


def test_benchmark_class_names(spark):
    df = spark.createDataFrame([("B",), ("a",), ("noise",), (None,), ("b",)], "class string")
    assert sel.benchmark_class_names(["X", " ", "noise", "x", "Y", "NOISE"]) == ["X", "Y"]
    assert sel.benchmark_class_names(None, df) == ["a", "b"]


def test_common_ngrams_by_hash_first(spark):
    rng = random.Random(4)
    rows = [[rng.choice("abcd") for _ in range(rng.randrange(40))] for _ in range(60)] + [[], None, ["a"]]
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>")
    want = Counter((n, "\u0001".join(r[i : i + n])) for r in rows if r for n in (2, 5) for i in range(len(r) - n + 1))
    order = sorted(want.items(), key=lambda x: (-x[1], x[0][0], x[0][1]))
    for k in (1, 7, 40):
        got = [((r["n"], r["gram"]), r["count"]) for r in ngrams.common_ngrams(df, "t", [2, 5], k).orderBy("rank").collect()]
        assert got == order[:k]
    per = [((r["n"], r["gram"]), r["count"]) for r in ngrams.common_ngrams_per_order(df, "t", [2, 5], 6).orderBy("n", "rank").collect()]
    assert per == [x for n in (2, 5) for x in [y for y in order if y[0][0] == n][:6]]
    assert ngrams.common_ngrams(df.limit(0), "t", [2], 5).count() == 0


def test_longest_runs(spark):
    rows = [(1, "a\na\n\nb 1\nb 2\nb 3\na"), (2, ""), (3, None), (4, "x")]
    got = {r["i"]: r["longest_run"] for r in training.longest_runs(spark.createDataFrame(rows, "i int, code string"), "i").collect()}
    assert got == {1: 3, 2: 0, 3: 0, 4: 1}


def test_coverage_of_odd_token_lists(spark):
    df = spark.createDataFrame([(1, ["a"] * 7), (2, []), (3, None), (4, ["a", None, "a", None, "a", None, "a"]), (5, ["x", "y"])], "i int, t array<string>").coalesce(1)
    got = {r["i"]: [round(x, 6) for x in r["c"]] for r in df.select("i", helpers.ngram_coverages("t", [2, 6]).alias("c")).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [1.0, 0.0], 5: [0.0, 0.0]}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return None

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        scratch(Session, "x")


def test_coverage_holds_nothing_of_earlier_batches():
    tokens = pa.array([[f"w{(i * i + j) % 97}" for j in range(500)] for i in range(200)], pa.list_(pa.string()))
    helpers._coverages(tokens, [2, 3, 4, 6], 3)
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for _ in range(3):
            helpers._coverages(tokens, [2, 3, 4, 6], 3)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
        gc.enable()
    assert held < 500_000 and peak < 400 * 100_000


def test_coverage_of_many_lists_is_counted_in_slices(spark, monkeypatch):
    rows = [(i, [f"w{(i + j) % (i + 1)}" for j in range(i)]) for i in range(40)] + [(40, None), (41, [])]
    df = spark.createDataFrame(rows, "i int, t array<string>").coalesce(1)
    whole = {r["i"]: r["c"] for r in df.select("i", helpers.ngram_coverages("t", [2, 6]).alias("c")).collect()}
    monkeypatch.setattr(helpers, "COUNTED", 7)
    assert whole == {r["i"]: r["c"] for r in df.select("i", helpers.ngram_coverages("t", [2, 6]).alias("c")).collect()}


def test_lists_are_numbered_some_200_000_tokens_at_once():
    lengths = [1000, 0, 7] * 400
    lists = pa.array([["a"] * n for n in lengths], pa.list_(pa.string()))
    runs = list(grams.slices(lists))
    assert [a for a, _ in runs] == [0, *[b for _, b in runs[:-1]]] and runs[-1][1] == len(lengths)
    assert all(sum(lengths[a:b]) <= 1 << 18 for a, b in runs)
