"""V5, V6 and O6 against NumPy, X1 with the text metrics it is meant to carry against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilnwork.functions import text
from kilnwork.operators import clustering
from kilnwork.plans import registry, views

DATA = "/root/testdata/sf0.001"


def _embeddings(spark):
    rows = views.table(spark, DATA, "embeddings").orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)


def test_axes_are_those_of_the_decomposition(spark):
    """Directions are known up to their sign: compare what they span."""
    ids, x = _embeddings(spark)
    df = views.table(spark, DATA, "embeddings").withColumnRenamed("vec_id", "sample_id")
    reduced, share = clustering.reduce_pca(df, 8)
    got = {r["sample_id"]: r["reduced"] for r in reduced.collect()}
    found = np.array([got[i] for i in ids])
    centred = x - x.mean(0)
    _, spread, axes = np.linalg.svd(centred, full_matrices=False)
    assert share == pytest.approx((spread[:8] ** 2).sum() / (spread**2).sum(), rel=1e-6)
    expected = centred @ axes[:8].T
    assert np.allclose(np.abs(found), np.abs(expected), atol=1e-6)
    query = {r["sample_id"]: (r["size"], r["length"]) for r in registry.QUERIES["v5_reduce_pca"](spark, DATA).collect()}
    assert np.allclose([query[i][1] for i in ids], np.linalg.norm(expected, axis=1), atol=1e-5) and {s for s, _ in query.values()} == {8}


def _lloyd(x, k, seed):
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(100):
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[at == c].mean(0) if (at == c).any() else centres[c] for c in range(k)])
    return ((x - centres[at]) ** 2).sum()


def test_kmeans_is_as_good_as_plain_lloyd(spark):
    ids, x = _embeddings(spark)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in zip(ids, x[:, :6], strict=True)], "sample_id long, reduced array<double>")
    held = {r["sample_id"]: r["cluster"] for r in clustering.cluster_kmeans(df, 5).collect()}
    labels, points = np.array([held[i] for i in ids]), x[:, :6]
    centres = np.array([points[labels == c].mean(0) for c in range(5)])
    inertia = ((points - centres[labels]) ** 2).sum()
    assert inertia <= 1.1 * min(_lloyd(points, 5, s) for s in range(5))
    nearest = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (nearest == labels).mean() > 0.9  # Spark stops within a tolerance, or after 20 rounds


def test_rank_of_a_real_sweep(spark):
    df = views.table(spark, DATA, "embeddings").withColumnRenamed("vec_id", "sample_id")
    sweep = clustering.cluster_sweep(df, [2, 3], [5, 12, 400], 3)
    ranked = clustering.rank_sweep(sweep).collect()
    told = sorted((r for r in sweep.collect() if r["silhouette"] is not None), key=lambda r: (-r["silhouette"], r["noise_fraction"]))
    assert [(r["components"], r["min_cluster_size"]) for r in ranked] == [(r["components"], r["min_cluster_size"]) for r in told]
    assert 0 < len(ranked) < 6  # 400 rows make no two clusters


def _far(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_text_scores_by_definition(spark):
    got = {(r["test_id"], r["metric"]): (r["score"], r["pass"]) for r in registry.QUERIES["x1_text_scores"](spark, DATA).collect()}
    bleu = {r["test_id"]: r["crystalbleu"] for r in registry.QUERIES["m2_crystal_bleu"](spark, DATA).collect()}
    pairs = views.pairs(spark, DATA).select("test_id", text.tokenize_code("reference").alias("r"), text.tokenize_code("generated").alias("g"), F.length(F.trim("reference")).alias("rl")).collect()
    assert {m for _, m in got} == {"crystalbleu", "ted", "relative_length"} and len(got) == 3 * len(pairs) > 10
    for p in pairs:
        similarity = 1 / (1 + _far(p["r"], p["g"]) / len(p["r"]))
        score, passed = got[(p["test_id"], "ted")]
        assert score == pytest.approx(similarity, abs=1e-6) and passed == (similarity >= 0.5)
        score, passed = got[(p["test_id"], "crystalbleu")]
        assert math.isclose(score, bleu[p["test_id"]] or 0.0, abs_tol=2e-6) and passed == ((bleu[p["test_id"]] or 0.0) >= 0.1)
