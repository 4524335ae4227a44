"""N-gram summaries, edit distance, quantiles and shards on the paths that small tables do not take by themselves."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kilnwork.functions import grams, helpers
from kilnwork.operators import ngrams, quantile, scoring
from kilnwork.sources import tables


def _lists(seed, n, alphabet, most):
    rng = random.Random(seed)
    return [[rng.choice(alphabet) for _ in range(rng.randrange(most))] for _ in range(n)] + [[], None, ["a"], ["é", "a"]]


def _counts(rows, orders):
    return Counter((n, grams.SEP.join(r[i : i + n])) for r in rows if r for n in orders for i in range(len(r) - n + 1))


# few: no task holds all; flat: so little is frequent that all must be counted; skewed: the bound decides
@pytest.mark.parametrize("case", [("skewed", "aaaaaabbbcd", 400, 60), ("flat", [f"t{i}" for i in range(300)], 10, 4), ("few", "ab", 10_000, 10_000)])
def test_frequent_ngrams_by_summaries(spark, monkeypatch, case):
    _, alphabet, summary, handed = case
    monkeypatch.setattr(ngrams, "SUMMARY", summary)
    monkeypatch.setattr(ngrams, "HANDED", handed)
    rows = _lists(3, 300, alphabet, 60)
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>").repartition(4)
    want = _counts(rows, (3, 5, 6))
    for k in (1, 12):
        got = [(r["n"], r["gram"], r["count"]) for r in ngrams.common_ngrams(df, "t", [3, 6], k).orderBy("rank").collect()]
        order = sorted(((n, g, c) for (n, g), c in want.items() if n != 5), key=lambda x: (-x[2], x[0], x[1]))
        assert got == order[:k]
    per = [(r["n"], r["gram"], r["count"]) for r in ngrams.common_ngrams_per_order(df, "t", [3, 5], 9).orderBy("n", "rank").collect()]
    assert per == [x for n in (3, 5) for x in sorted(((m, g, c) for (m, g), c in want.items() if m == n), key=lambda x: (-x[2], x[1]))[:9]]


def test_summaries_fall_short_by_what_they_say():
    rows = [r for r in _lists(5, 400, "aaabbcdefgh", 50) if r]
    held = ngrams._Summary(4, 30)
    for i in range(0, len(rows), 20):
        held.add(grams.Grams(pa.array(rows[i : i + 20])))
    lists = grams.Grams(pa.array(rows))
    h, _, counts = lists.counted(4, lists.places(4))
    true, low = dict(zip(h.tolist(), counts.tolist(), strict=True)), dict(zip(held.h.tolist(), held.count.tolist(), strict=True))
    assert held.off > 0 and len(low) <= 30
    assert all(low.get(x, 0) <= c <= low.get(x, 0) + held.off for x, c in true.items())


def test_equal_hashes_are_told_apart(monkeypatch):
    rows = [r for r in _lists(6, 50, "abcd", 30) if r]
    want = _counts(rows, (3,))
    monkeypatch.setattr(grams, "text_hashes", lambda words: np.arange(len(words), dtype=np.uint64) % np.uint64(2))
    lists = grams.Grams(pa.array(rows))
    _, first, counts = lists.counted(3, lists.places(3))
    assert Counter(dict(zip(lists.texts(3, first), counts.tolist(), strict=True))) == Counter({g: c for (_, g), c in want.items()})
    asked = sorted(g for _, g in want)[::3]
    hits = grams.Known([(3, g) for g in asked]).hits(lists, 3, lists.places(3))
    assert [t in asked for t in lists.texts(3, lists.places(3))] == hits.tolist()


def test_coverage_and_local_ngrams(spark):
    rows = _lists(7, 80, "aabcd", 40)
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t array<string>").repartition(3)
    known = [(2, grams.SEP.join("ab")), (2, grams.SEP.join("aa")), (4, grams.SEP.join("aabc")), (4, grams.SEP.join("zzzz"))]
    top = spark.createDataFrame(known, "n int, gram string")
    out = ngrams.filter_coverage(df, "id", "t", top, [2, 4])
    assert "Exchange" not in df.sparkSession.createDataFrame([], out.schema)._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        own = _counts([rows[r["id"]]], (2, 4))
        assert (r["total_2"], r["total_4"]) == tuple(sum(c for (n, _), c in own.items() if n == m) for m in (2, 4))
        assert r["filtered"] == sum(c for g, c in own.items() if g in known)
    got = df.select("id", grams.frequent_in_list("t", [2, 3], 4, 2).alias("x"))
    assert "Exchange" not in got.select("x")._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "").replace("REPARTITION", "")
    for r in got.collect():
        own = sorted((-c, -n, g.replace(grams.SEP, " ")) for (n, g), c in _counts([rows[r["id"]]], (2, 3)).items() if c >= 2)[:4]
        assert [(x["count"], x["n"], x["ngram"]) for x in r["x"]] == [(-c, -n, g) for c, n, g in own]


def test_crystal_bleu_counts_by_definition(spark):
    left, right = _lists(8, 60, "aabcd", 25), _lists(9, 60, "abbcd", 25)
    known = {(1, "b"), (2, grams.SEP.join("ab")), (3, grams.SEP.join("aab"))}
    df = spark.createDataFrame([(i, r, g) for i, (r, g) in enumerate(zip(left, right, strict=True))], "id int, r array<string>, g array<string>")
    for row in df.select("id", grams.overlaps("r", "g", grams.Known(sorted(known)), [1, 2, 3]).alias("x")).collect():
        r, g = (_counts([x[row["id"]]], (1, 2, 3)) for x in (left, right))
        match = [sum(min(c, r[k]) for k, c in g.items() if k[0] == n and k not in known) for n in (1, 2, 3)]
        total = [sum(c for k, c in g.items() if k[0] == n and k not in known) for n in (1, 2, 3)]
        assert row["x"] == match + total


def test_edit_distance_with_a_limit():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(150))] for _ in range(2))
        far = plain(a, b)
        assert helpers.token_distance(a, b) == far
        assert [helpers.token_distance(a, b, k) for k in (0, 5, 60, 200)] == [min(far, k + 1) for k in (0, 5, 60, 200)]


@pytest.mark.parametrize("sizes", [(500_000, 10_000), (40, 10_000), (40, 25)])
def test_exact_quantiles(spark, monkeypatch, sizes):
    """Coarse guesses that miss, brackets that are narrowed again, ties, null groups, NaN and groups of one."""
    monkeypatch.setattr(quantile, "CELLS", sizes[0])
    monkeypatch.setattr(quantile, "ACCURACY", sizes[1])
    rng = np.random.default_rng(3)
    values = {"wide": rng.normal(size=6000) * 1e3, "ties": rng.integers(0, 3, 900).astype(float), "one": np.array([4.5]), None: rng.exponential(size=501)}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("wide", None), ("none", None), ("nan", float("nan")), ("nan", 1.0), ("nan", float("inf"))]
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in quantile.exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(4), ["g"], "x", at).collect()}
    assert set(got) == {*values, "nan"}
    for g, v in values.items():
        assert np.allclose(got[g], np.quantile(v, at), rtol=1e-12)
    assert got["nan"][0] == 1.0 and np.isnan(got["nan"][-1])
    assert quantile.exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", at).count() == 0


def test_describe_by_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, None), (None, 5.0, 7.0)], "g string, x double, y double")
    got = {(r["g"], r["column"]): (r["count"], r["q1"], r["median"], r["max"]) for r in scoring.describe_by(df, "g", ["x", "y"]).collect()}
    assert got == {("a", "x"): (2, 1.25, 1.5, 2.0), ("a", "y"): (0, None, None, None), (None, "x"): (1, 5.0, 5.0, 5.0), (None, "y"): (1, 7.0, 7.0, 7.0)}


def test_shards_are_full(spark):
    rng = random.Random(5)
    rows = [(f"k{i:05}", rng.choice(["train", "test", None]), "x" * rng.randrange(10, 400)) for i in range(6000)] + [("k00007", "train", "twice"), (None, "train", "no key"), (None, "train", "no key")]
    df = spark.createDataFrame(rows, "sample_id string, split string, text string").repartition(5)
    most = 8000
    placed = tables.with_shards(df, most, "sample_id")
    made = placed.groupBy("split", "shard").agg(F.sum("shard_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    assert sum(r["rows"] for r in made) == len(rows) and max(r["bytes"] for r in made) <= most
    for s in ("train", "test", None):
        own = [r for r in made if r["split"] == s]
        assert sorted(r["shard"] for r in own) == list(range(len(own)))
        assert sum(r["bytes"] for r in own) / (most * len(own)) > 0.9
    held = placed.groupBy("split", "sample_id").agg(F.count_distinct("shard").alias("n")).filter("n > 1")
    assert held.count() == 0
    with pytest.raises(ValueError, match="larger than a shard"):
        tables.with_shards(df, 300, "sample_id")
