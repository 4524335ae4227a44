"""N-gram statistics of samples and corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grams import SEP, Grams, Known, covered, frequent_in_list, overlaps, slices
from ..functions.helpers import ngram_coverages
from ..functions.text import WEIGHTS, repetition_class, tokenize_code, weighted_repetition
from ..sources.scratch import stored

def repetition_score(df: DataFrame, code: str = "code") -> DataFrame:
    """A4. df with repetition_score and repetition_class; a code without tokens is low with 0. No shuffle."""
    df = df.withColumn("__cover", ngram_coverages(tokenize_code(code), list(WEIGHTS)))
    score = weighted_repetition({n: F.element_at("__cover", i) for i, n in enumerate(WEIGHTS, 1)})
    df = df.withColumn("repetition_score", score)
    return df.withColumn("repetition_class", repetition_class("repetition_score")).drop("__cover")


#: Thresholds of the four classes of the profile.
PROFILE = {"medium": 0.25, "high": 0.45, "very_high": 0.65}


def repetition_profile(df: DataFrame, key: str, code: str = "code", top: int = 20, least: int = 2) -> DataFrame:
    """A5. (key, repetition_score, repetition_class, token_count, coverage by order, top_local_ngrams): unnormalised weights; the most frequent n-grams as
    JSON, by count, then order, both descending. No shuffle."""
    df = df.select(key, tokenize_code(code).alias("__tokens"))
    local = frequent_in_list("__tokens", list(WEIGHTS), top, least)
    own = df.select(key, F.size("__tokens").alias("token_count"), ngram_coverages("__tokens", list(WEIGHTS), least).alias("__cover"), local.alias("__local"))
    own = own.select(key, "token_count", "__local", *[F.element_at("__cover", i).alias(f"ngram_{n}_coverage") for i, n in enumerate(WEIGHTS, 1)])
    score = sum((F.lit(w) * F.col(f"ngram_{n}_coverage") for n, w in WEIGHTS.items()), F.lit(0.0))
    own = own.withColumn("repetition_score", score).withColumn("repetition_class", repetition_class("repetition_score", PROFILE))
    return own.withColumn("top_local_ngrams", F.coalesce(F.to_json("__local"), F.lit("[]"))).drop("__local")


def repetition_stats(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """A6. Class counts, mean score, token minimum, maximum and mean by dataset."""
    classes = ["low", "medium", "high", "very_high", "critical"]
    return df.groupBy(dataset).agg(*[F.count_if(F.col("repetition_class") == c).alias(c) for c in classes], F.avg("repetition_score").alias("mean_score"), F.min("token_len").alias("token_min"), F.max("token_len").alias("token_max"), F.avg("token_len").alias("token_mean"))


#: Different n-grams of an order that a task's summary holds, and that it hands on; n-grams of a list that tasks get whole.
SUMMARY, HANDED, LISTED = 100_000, 20_000, 100_000
_LOW, _EXACT, _MANY = 0, 1, 2
_KINDS = pa.schema([("kind", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("gram", pa.string()), ("count", pa.int64())])


def _rows(kind: int, n: int, count: np.ndarray, h: np.ndarray | None = None, gram: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(count), 50_000):
        b = min(a + 50_000, len(count))
        own = pa.nulls(b - a, pa.int64()) if h is None else pa.array(h[a:b].view(np.int64))
        text = pa.nulls(b - a, pa.string()) if gram is None else pa.array(gram[a:b], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, kind), pa.int32()), pa.array(np.full(b - a, n), pa.int32()), own, text, pa.array(count[a:b].astype(np.int64))], schema=_KINDS)


class _Summary:
    """Counts of the n-grams of one order that a task meets: by text while they are few, and lower bounds of the frequent ones, by hash. Where
    more than most are held, the count of the first beyond is taken off all, and those at nothing go: so no count falls short by more
    than the sum of what was taken off."""

    def __init__(self, n: int, most: int):
        self.n, self.most, self.off = n, most, 0
        self.exact: dict[str, int] | None = {}
        self.h, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, grams: Grams) -> None:
        h, first, count = grams.counted(self.n, grams.places(self.n))
        if self.exact is not None and len(self.exact) + len(h) <= self.most:
            for text, c in zip(grams.texts(self.n, first), count.tolist(), strict=True):
                self.exact[text] = self.exact.get(text, 0) + c
        else:
            self.exact = None
        h, of = np.unique(np.concatenate([self.h, h]), return_inverse=True)
        total = np.zeros(len(h), np.int64)
        np.add.at(total, of, np.concatenate([self.count, count]))
        if len(h) > self.most:
            off = np.partition(total, len(total) - self.most - 1)[len(total) - self.most - 1]
            total -= off
            self.off += int(off)
            h, total = h[total > 0], total[total > 0]
        self.h, self.count = h, total

    def rows(self, handed: int) -> Iterator[pa.RecordBatch]:
        """The counts by text, if they are few; the largest lower bounds; and what others can have been counted at the most."""
        order = np.argsort(-self.count, kind="stable")
        others = self.off + (int(self.count[order[handed]]) if len(order) > handed else 0)
        if self.exact is None:
            yield from _rows(_MANY, self.n, np.array([others]))
        else:
            yield from _rows(_EXACT, self.n, np.array([*self.exact.values()]), None, [*self.exact])
            yield from _rows(_MANY, self.n, np.array([others])) if others else ()
        yield from _rows(_LOW, self.n, self.count[order[:handed]], self.h[order[:handed]])


def _summed(df: DataFrame, tokens: str, orders: list[int]) -> DataFrame:
    """(kind, n, h, gram, count): the summaries of all tasks."""
    most, handed = SUMMARY, HANDED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Summary(n, most) for n in orders]
        for batch in batches:
            lists = batch.column(0)
            for a, b in slices(lists):
                grams = Grams(lists.slice(a, b - a))
                for s in held:
                    s.add(grams)
        few = all(s.exact is not None for s in held)
        for s in held:
            s.exact = s.exact if few else None
            yield from s.rows(handed)
        if not few:
            yield from _rows(_MANY, 0, np.zeros(1))

    return df.select(tokens).mapInArrow(run, "kind int, n int, h long, gram string, count long")


def _counted(df: DataFrame, tokens: str, likely: dict[int, np.ndarray | None]) -> DataFrame:
    """(n, gram, count) of the n-grams of each order whose hashes are among these, in order; of all, where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            for a, b in slices(lists):
                grams = Grams(lists.slice(a, b - a))
                for n, wanted in likely.items():
                    at = grams.places(n)
                    if wanted is not None and len(at):
                        own = grams.hashes(n)[at]
                        at = at[wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own] if len(wanted) else at[:0]
                    _, first, count = grams.counted(n, at)
                    for x in range(0, len(first), 50_000):
                        part = first[x : x + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), n), pa.int32()), pa.array(grams.texts(n, part), pa.string()), pa.array(count[x : x + 50_000].astype(np.int64))], ["n", "gram", "count"])

    return df.select(tokens).mapInArrow(run, "n int, gram string, count long").groupBy("n", "gram").agg(F.sum("count").alias("count"))


def _frequent(df: DataFrame, tokens: str, orders: list[int], k: int, by_order: bool) -> DataFrame:
    """(n, gram, count) of all n-grams that may be among the k most frequent (of each order).

    Each task sums up what it meets. Where all met few n-grams, the summaries are the counts. Else the k-th largest sum of lower bounds is the
    least count that can matter; n-grams whose sum stays below it by more than all that tasks can have left out are out, and a second
    pass counts the others by text: of the rest no row leaves a task. If tasks can have left out as much as that, there are no frequent n-grams
    to speak of, and all are counted by a shuffle. Hashes only ever let too many through, unless two frequent ones met: then the k-th
    exact count is lower than the bound, and it is done again from there.
    """
    summed = stored(_summed(df, tokens, orders), "grams")
    many = dict(summed.filter(F.col("kind") == _MANY).groupBy("n").agg(F.sum("count")).collect())  # one number an order
    if 0 not in many:
        return summed.filter(F.col("kind") == _EXACT).groupBy("n", "gram").agg(F.sum("count").alias("count"))
    per = [[n] for n in orders] if by_order else [orders]
    lows = stored(summed.filter(F.col("kind") == _LOW).groupBy("n", "h").agg(F.sum("count").alias("count")), "bounds")

    def kth(counts: DataFrame, group: list[int]) -> int:
        """The k-th largest count, 0 where there are fewer."""
        held = counts.filter(F.col("n").isin(group)).orderBy(F.col("count").desc()).limit(k).agg(F.count(F.lit(1)).alias("rows"), F.min("count").alias("least")).first()
        return held["least"] if held["rows"] == k else 0

    least = {n: kth(lows, g) for g in per for n in g}
    while True:
        likely: dict[int, np.ndarray | None] = dict.fromkeys(orders)
        for n in orders:
            if many.get(n, 0) < least[n]:
                found = lows.filter((F.col("n") == n) & (F.col("count") + many.get(n, 0) >= least[n])).select("h").limit(LISTED + 1).toPandas()["h"]
                likely[n] = np.sort(found.to_numpy().astype(np.int64).view(np.uint64)) if len(found) <= LISTED else None
        found = stored(_counted(df, tokens, likely), "frequent")
        reached = {n: kth(found, g) for g in per for n in g}
        if all(likely[n] is None or reached[n] >= least[n] for n in orders):
            return found
        least = {n: min(least[n], reached[n]) for n in orders}


def common_ngrams(df: DataFrame, tokens: str, orders: list[int], k: int) -> DataFrame:
    """A7. (rank, n, gram, count): the k most frequent of all orders; ties by order, then gram."""
    best = _frequent(df, tokens, orders, k, False).orderBy(F.col("count").desc(), "n", "gram").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), "n", "gram"))).select("rank", "n", "gram", "count")


def common_ngrams_per_order(df: DataFrame, tokens: str, orders: list[int], k: int) -> DataFrame:
    """A8. The k most frequent of each order."""
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.col("count").desc(), "gram"))
    return _frequent(df, tokens, orders, k, True).withColumn("rank", rank).filter(F.col("rank") <= k).select("rank", "n", "gram", "count")


def filter_coverage(df: DataFrame, key: str, tokens: str, top: DataFrame, orders: list[int]) -> DataFrame:
    """A9 (and J6). (key, total, filtered, coverage) and the same by order: how many of a sample's n-grams are among top (n, gram), the
    few most frequent. No shuffle."""
    counts = df.select(key, covered(tokens, _known(top), orders).alias("__c"))
    of = lambda i: F.element_at("__c", i)
    share = lambda hit, n: F.when(n > 0, hit / n).otherwise(0.0)
    m = len(orders)
    for i, n in enumerate(orders, 1):
        counts = counts.withColumns({f"total_{n}": of(i), f"filtered_{n}": of(m + i)})
    counts = counts.withColumns({"total": sum((F.col(f"total_{n}") for n in orders), F.lit(0)), "filtered": sum((F.col(f"filtered_{n}") for n in orders), F.lit(0))})
    out = counts.select(key, "total", "filtered", *[x for n in orders for x in (f"total_{n}", f"filtered_{n}")])
    out = out.withColumn("coverage", share(F.col("filtered"), F.col("total")))
    return out.withColumns({f"coverage_{n}": share(F.col(f"filtered_{n}"), F.col(f"total_{n}")) for n in orders})


def _known(top: DataFrame) -> Known:
    """The list top (n, gram), a bounded one, as the tasks look n-grams up in it."""
    held = top.select("n", "gram").limit(LISTED + 1).collect()
    if len(held) > LISTED:
        raise ValueError(f"more than {LISTED} listed n-grams")
    return Known([(r["n"], r["gram"]) for r in held])


def shared_ngrams(corpus: DataFrame, code: str, k: int = 500, n: int = 4) -> DataFrame:
    """M1. (rank, n, gram, count): the k most frequent n-grams of orders 1 to n over the texts that are not blank."""
    return common_ngrams(corpus.select(tokenize_code(code).alias("__tokens")), "__tokens", list(range(1, n + 1)), k)


def bleu_of(reference: Column | str, generated: Column | str, shared: DataFrame, n: int = 4, smoothing: bool = True) -> Column:
    """M2 as a column over two token lists; shared is read at once."""
    orders = list(range(1, n + 1))
    rl, gl = F.size(reference), F.size(generated)
    short = F.when(gl < rl, F.exp(1 - rl / gl)).otherwise(1.0)

    def score(counts: Column) -> Column:
        matches = lambda i: counts[i - 1].cast("double")
        part = lambda i: F.log(F.when(matches(i) == 0, F.lit(0.1 if smoothing else 1e-300)).otherwise(matches(i)) / F.greatest(counts[n + i - 1], F.lit(1)))
        mean = sum((part(i) for i in orders), F.lit(0.0)) / n
        return F.when(matches(1) == 0, 0.0).otherwise(F.exp(mean))

    # bound once: the counts are used many times
    own = F.transform(F.array(overlaps(reference, generated, _known(shared), orders)), score)[0]
    return F.when((rl == 0) | (gl == 0), F.lit(None)).otherwise(short * own)


def crystal_bleu(pairs: DataFrame, key: str, reference: str, generated: str, shared: DataFrame, n: int = 4, smoothing: bool = True) -> DataFrame:
    """M2. (key, crystalbleu): BLEU of each pair without the shared n-grams; null if a side is blank.

    By order: matches are the lesser counts of the n-grams of both sides, the total those of the generated side, 1 at
    least. No match of order 1: 0. With smoothing an order without a match counts 0.1. Brevity: exp(1 - r / h) for h < r. No shuffle.
    """
    rows = pairs.select(key, tokenize_code(reference).alias("__r"), tokenize_code(generated).alias("__g"))
    return rows.select(key, bleu_of("__r", "__g", shared, n, smoothing).alias("crystalbleu"))
