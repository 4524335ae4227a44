"""N-grams of token lists in Arrow batches: numbered or hashed from two halves, so no text of an n-gram is built but of those asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u0001"
#: Tokens that are numbered at once: some 30 numbers are held for each.
TOKENS = 1 << 18
U64 = np.uint64
_ODD, _OTHER = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def slices(tokens: pa.ListArray, most: int = TOKENS) -> Iterator[tuple[int, int]]:
    """Runs of lists [start, stop) of at most so many tokens, or of one list."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def text_hashes(words: list[str]) -> np.ndarray:
    """64 bits of each text, the same in any batch."""
    return pd.util.hash_array(np.array(words, object), categorize=False).astype(U64) if words else np.zeros(0, U64)


class Grams:
    """The n-grams of some token lists (null: empty). Places are those of their first tokens in the joined lists."""

    def __init__(self, tokens: pa.ListArray):
        self.lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
        coded = pc.dictionary_encode(tokens.flatten(), null_encoding="encode")
        self.codes = np.asarray(coded.indices, np.int64)
        self.words = ["" if w is None else w for w in coded.dictionary.to_pylist()]
        starts = np.cumsum(self.lengths) - self.lengths
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.left = np.repeat(self.lengths, self.lengths) - (np.arange(len(self.row)) - starts[self.row])
        self._numbers: dict[int, np.ndarray] = {1: self.codes}
        self._hashes: dict[int, np.ndarray] = {}

    def places(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.left >= n)

    def numbers(self, n: int) -> np.ndarray:
        """A number for the n-gram at each place, the same for equal ones; -1 where fewer tokens are left."""
        if n not in self._numbers:
            half = (n + 1) // 2
            own, at, out = self.numbers(half), self.places(n), np.full(len(self.codes), -1)
            if len(at):
                out[at] = np.unique(own[at] * (own.max() + 2) + own[at + n - half] + 1, return_inverse=True)[1]
            self._numbers[n] = out
        return self._numbers[n]

    def hashes(self, n: int) -> np.ndarray:
        """64 bits of the n-gram at each place, the same in any batch; those at places with fewer tokens left mean nothing."""
        if n not in self._hashes:
            if n == 1:
                self._hashes[1] = text_hashes(self.words)[self.codes] if len(self.codes) else np.zeros(0, U64)
            else:
                half = (n + 1) // 2
                own = self.hashes(half)
                other = np.roll(own, half - n)
                self._hashes[n] = _mixed(own * _ODD + _mixed(other ^ _OTHER) + U64(n))
        return self._hashes[n]

    def equal(self, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the n-grams at places a and b are the same, token by token."""
        out = np.ones(len(a), bool)
        for i in range(n):
            out &= self.codes[a + i] == self.codes[b + i]
        return out

    def texts(self, n: int, places: np.ndarray) -> list[str]:
        words, codes = self.words, self.codes[places[:, None] + np.arange(n)[None]].tolist()
        return [SEP.join([words[c] for c in g]) for g in codes]

    def counted(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the n-grams at some places the different ones: their hashes, first places and counts. Equal hashes of different
        n-grams are told apart by their tokens."""
        if not len(at):
            return np.zeros(0, U64), at, at
        hashes, first, of, counts = np.unique(self.hashes(n)[at], return_index=True, return_inverse=True, return_counts=True)
        first = at[first]
        odd = ~self.equal(n, at, first[of])
        if not odd.any():
            return hashes, first, counts
        own, kinds = self.numbers(n)[at], np.zeros(0, np.int64)
        kinds, firsts, counts = np.unique(own, return_index=True, return_counts=True)
        return self.hashes(n)[at[firsts]], at[firsts], counts


class Known:
    """A set of n-grams, looked up by hash and compared by text."""

    def __init__(self, grams: list[tuple[int, str]]):
        self.by_order: dict[int, tuple[np.ndarray, set[str]]] = {}
        for n in {n for n, _ in grams}:
            texts = [g for m, g in grams if m == n]
            lists = Grams(pa.array([t.split(SEP) for t in texts], pa.list_(pa.string())))
            self.by_order[n] = (np.unique(lists.hashes(n)[lists.places(n)]) if n else np.zeros(0, U64), set(texts))

    def hits(self, grams: Grams, n: int, at: np.ndarray) -> np.ndarray:
        """Which n-grams at these places are in the set."""
        out = np.zeros(len(at), bool)
        if n not in self.by_order or not len(at):
            return out
        hashes, texts = self.by_order[n]
        own = grams.hashes(n)[at]
        found = np.searchsorted(hashes, own)
        out = hashes[np.minimum(found, len(hashes) - 1)] == own
        likely = np.flatnonzero(out)
        if len(likely):
            kinds, first, of = np.unique(own[likely], return_index=True, return_inverse=True)
            first = at[likely[first]]
            known = np.array([t in texts for t in grams.texts(n, first)])
            same = grams.equal(n, at[likely], first[of])
            out[likely] = known[of] & same
            for i in likely[~same]:
                out[i] = grams.texts(n, at[i : i + 1])[0] in texts
        return out


def covered(tokens: Column | str, known: Known, orders: list[int]) -> Column:
    """array<bigint>: for each order the n-grams of a list, then how many of them are known."""

    @F.arrow_udf("array<bigint>")
    def run(tokens: pa.Array) -> pa.Array:
        out = [np.zeros((0, 2 * len(orders)), np.int64)]
        for a, b in slices(tokens):
            grams = Grams(tokens.slice(a, b - a))
            part = np.zeros((b - a, 2 * len(orders)), np.int64)
            for i, n in enumerate(orders):
                at = grams.places(n)
                part[:, i] = np.bincount(grams.row[at], minlength=b - a)
                part[:, len(orders) + i] = np.bincount(grams.row[at[known.hits(grams, n, at)]], minlength=b - a)
            out.append(part)
        whole = np.concatenate(out)
        return pa.FixedSizeListArray.from_arrays(pa.array(whole.reshape(-1)), 2 * len(orders)).cast(pa.list_(pa.int64()))

    return run(tokens)


def overlaps(reference: Column | str, generated: Column | str, known: Known, orders: list[int]) -> Column:
    """array<bigint>: for each order the matches of two token lists, then the n-grams of the second. Known n-grams are left out; a match is
    the lesser of a n-gram's counts in both."""

    @F.arrow_udf("array<bigint>")
    def run(reference: pa.Array, generated: pa.Array) -> pa.Array:
        both = pa.concat_arrays([reference, generated])
        n_rows = len(reference)
        most = np.asarray(pc.fill_null(pc.list_value_length(both), 0), np.int64)
        ends = np.cumsum(most[:n_rows] + most[n_rows:])
        out, a = [np.zeros((0, 2 * len(orders)), np.int64)], 0
        while a < n_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS, "right")))
            grams = Grams(pa.concat_arrays([reference.slice(a, b - a), generated.slice(a, b - a)]))
            part = np.zeros((b - a, 2 * len(orders)), np.int64)
            for i, n in enumerate(orders):
                at, own = grams.places(n), grams.numbers(n)
                kinds, first, of = np.unique(own[at], return_index=True, return_inverse=True)
                at, of = (x[~known.hits(grams, n, at[first])[of]] for x in (at, of)) if len(at) else (at, of)
                second = grams.row[at] >= b - a
                key = (grams.row[at] % (b - a)) * (len(kinds) + 1) + of
                r, rc = np.unique(key[~second], return_counts=True)
                g, gc = np.unique(key[second], return_counts=True)
                _, x, y = np.intersect1d(r, g, assume_unique=True, return_indices=True)
                np.add.at(part[:, i], r[x] // (len(kinds) + 1), np.minimum(rc[x], gc[y]))
                np.add.at(part[:, len(orders) + i], g // (len(kinds) + 1), gc)
            out.append(part)
            a = b
        whole = np.concatenate(out)
        return pa.FixedSizeListArray.from_arrays(pa.array(whole.reshape(-1)), 2 * len(orders)).cast(pa.list_(pa.int64()))

    return run(reference, generated)


_LOCAL = pa.list_(pa.struct([("count", pa.int64()), ("n", pa.int32()), ("ngram", pa.string())]))


def frequent_in_list(tokens: Column | str, orders: list[int], top: int, least: int) -> Column:
    """array<struct<count, n, ngram>>: the top n-grams of a list that occur least times or more, by count, then order, both descending,
    then text; tokens are joined by blanks."""

    @F.arrow_udf("array<struct<count:bigint,n:int,ngram:string>>")
    def run(tokens: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for a, b in slices(tokens):
            grams = Grams(tokens.slice(a, b - a))
            rows, counts, ns, places = ([] for _ in range(4))
            for n in orders:
                at, own = grams.places(n), grams.numbers(n)
                if not len(at):
                    continue
                width = int(own.max()) + 1
                key, first, count = np.unique(grams.row[at] * width + own[at], return_index=True, return_counts=True)
                often = count >= least
                rows.append(key[often] // width), counts.append(count[often]), ns.append(np.full(int(often.sum()), n)), places.append(at[first[often]])
            found: list[list[dict]] = [[] for _ in range(b - a)]
            if rows:
                row, count, n, place = (np.concatenate(x) for x in (rows, counts, ns, places))
                order = np.lexsort((-n, -count, row))
                row, count, n, place = row[order], count[order], n[order], place[order]
                starts = np.searchsorted(row, np.arange(b - a + 1))
                for i in range(b - a):
                    s, e = starts[i], starts[i + 1]
                    if e - s > top:  # and all that are level with the last
                        c, m = count[s + top - 1], n[s + top - 1]
                        e = s + int(((count[s:e] > c) | ((count[s:e] == c) & (n[s:e] >= m))).sum())
                    told = [(-int(count[j]), -int(n[j]), grams.texts(int(n[j]), place[j : j + 1])[0]) for j in range(s, e)]
                    found[i] = [{"count": -c, "n": -m, "ngram": t.replace(SEP, " ")} for c, m, t in sorted(told)[:top]]
            out += found
        return pa.array(out, _LOCAL)

    return run(tokens)
