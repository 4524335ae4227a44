"""The scalar functions that built-in columns cannot express, or only many times slower, over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .grams import slices

#: Tokens whose n-grams are counted at once: some 30 numbers are held for each.
COUNTED = 1 << 17
#: Fixed value: the prefix that hides all node texts, put before each picture.
HIDE = "\\tikzset{every node/.append style={text opacity=0}}\n"
_PICTURE = "\\begin{tikzpicture}"
_BLANKS = r"(?:\s|%[^\n]*+)*+"
_SKIP = re.compile(_BLANKS)
#: A node command, or the word node on a path with a bracket after it.
_NODE = re.compile(rf"\\node|(?<!\w)node(?!\w)(?={_BLANKS}[\[({{])")
_OPENING = re.compile(r"[\[({]")
#: By opening bracket what a group is made of: escapes and comments, which hide brackets, and the brackets of its own kind.
_WITHIN = {pair[0]: re.compile(rf"\\.|%[^\n]*|(?P<opens>\{pair[0]})|(?P<closes>\{pair[1]})", re.S) for pair in ("[]", "()", "{}")}


def _group_end(tex: str, start: int) -> int | None:
    """Where the group that opens at start ends (exclusive), None if it does not."""
    open_groups = 0
    for m in _WITHIN[tex[start]].finditer(tex, start):
        open_groups += {"opens": 1, "closes": -1}.get(m.lastgroup, 0)
        if m.lastgroup and not open_groups:
            return m.end()
    return None


def label_spans(tex: str) -> Iterator[tuple[int, int]]:
    """The bodies of all nodes, in order, up to the first that is not closed: options and places in [] and () stand before the body."""
    at = 0
    while node := _NODE.search(tex, at):
        at = _SKIP.match(tex, node.end()).end()
        for opening in iter(lambda: _OPENING.search(tex, at), None):
            if (end := _group_end(tex, opening.start())) is None:
                return
            if opening[0] == "{":
                yield opening.end(), end - 1
                at = end
                break
            at = _SKIP.match(tex, end).end()
        else:
            return


def _letters(number: int) -> str:
    """aaaa, aaab, ..., zzzz."""
    if number >= 26**4:
        raise ValueError("more than 26 ** 4 labels in one text")
    return "".join(chr(97 + number // 26**place % 26) for place in (3, 2, 1, 0))


def neutralized(tex: str | None, mode: str, word: str) -> str:
    """tex with the bodies of its nodes replaced; of a body without text nothing is left."""
    tex, numbers, parts, at = tex or "", count(), [], 0
    for start, end in label_spans(tex):
        empty = _SKIP.fullmatch(tex, start, end) is not None
        parts += [tex[at:start], "" if empty else _letters(next(numbers)) if mode == "replace_sequential" else word]
        at = end
    return "".join(parts) + tex[at:]


def neutralize_labels(c: Column | str, mode: str = "replace_sequential", word: str = "Text") -> Column:
    """P14. Node texts replaced by aaaa, aaab, ... or one word; or hidden by a style before each picture."""
    c = F.col(c) if isinstance(c, str) else c
    if mode == "clean_all_text":
        return F.replace(F.coalesce(c, F.lit("")), F.lit(_PICTURE), F.lit(HIDE + _PICTURE))
    if mode not in ("replace_sequential", "replace_all"):
        raise ValueError(f"no such mode: {mode}")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: neutralized(t, mode, word))

    return run(c)


def token_distance(a: list[str], b: list[str], limit: int | None = None) -> int:
    """Levenshtein distance of two token lists; limit + 1 where it is beyond limit.

    Bit-parallel: a column of the table is two whole numbers, whose bits say at which tokens of a it grows or falls; a token of b
    is a few operations on them, of 64 rows at once.
    """
    a, b = list(a), list(b)
    while a and b and a[-1] == b[-1]:
        a.pop(), b.pop()
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    beyond = None if limit is None else limit + 1
    if beyond is not None and abs(len(a) - len(b)) >= beyond:
        return beyond
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, list[int]] = {}
    for i, t in enumerate(a):
        places.setdefault(t, []).append(i)
    size = len(a) // 8 + 1

    def bits(at: list[int]) -> int:
        held = bytearray(size)
        for i in at:
            held[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(held, "little")

    here = {t: bits(places[t]) for t in set(b) & set(places)}
    whole, m, far = (1 << len(a)) - 1, len(a), len(a)
    grows, falls = whole, 0
    for left, t in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = here.get(t, 0)
        diagonal = ((((same & grows) + grows) ^ grows) | same | falls) & whole
        up, down = falls | (whole ^ (diagonal | grows)), diagonal & grows
        far += (up.bit_length() == m) - (down.bit_length() == m)
        if beyond is not None and far - left >= beyond:
            return beyond
        up, down = (up << 1 | 1) & whole, down << 1 & whole
        grows, falls = down | (whole ^ (diagonal | up)), up & diagonal
    return far


def token_edit_distance(a: Column | str, b: Column | str, limit: int | None = None) -> Column:
    """M3. Distance of array<string> columns, at most limit + 1; null if one is null."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else token_distance(x, y, limit) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run(a, b)


def _numbered(known: dict[int, np.ndarray], left: np.ndarray, n: int) -> np.ndarray:
    """A number for the n-gram that starts at each token; -1 where fewer are left. No closure: one that calls itself is a cycle, and would hold
    the numbers of every batch until Python looks for cycles."""
    if n not in known:
        half = (n + 1) // 2
        own, shift = _numbered(known, left, half), n - half
        whole = np.flatnonzero(left >= n)
        out = np.full(len(own), -1)
        if len(whole):
            out[whole] = np.unique(own[whole] * (own.max() + 2) + own[whole + shift] + 1, return_inverse=True)[1]
        known[n] = out
    return known[n]


def _coverages(tokens: pa.ListArray, orders: list[int], least: int) -> pa.Array:
    """Of each list and order the share of n-grams that occur so often in it. Tokens are numbered, and an n-gram is the pair of two
    shorter, overlapping ones; the first of a pair holds the list's number, so that lists are counted apart."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
    codes = np.asarray(pc.dictionary_encode(tokens.flatten(), null_encoding="encode").indices, np.int64)
    starts, row = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(lengths, lengths) - (np.arange(len(row)) - starts[row])  # tokens of the list from here on
    known: dict[int, np.ndarray] = {1: np.unique(row * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1].astype(np.int64)}

    values = np.zeros((len(lengths), len(orders)))
    for i, n in enumerate(orders):
        whole = _numbered(known, left, n)
        at = np.flatnonzero(left >= n)
        if len(at):
            often = np.bincount(whole[at])[whole[at]] >= least
            total = np.bincount(row[at], minlength=len(lengths))
            values[:, i] = np.bincount(row[at], weights=often, minlength=len(lengths)) / np.maximum(total, 1)
    return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), len(orders)).cast(pa.list_(pa.float64()))


def ngram_coverages(tokens: Column | str, orders: list[int], min_count: int = 3) -> Column:
    """A3. array<double>: for each order the share of the n-grams that occur min_count times at least in this sample; 0 if it has none."""

    most = COUNTED

    @F.arrow_udf("array<double>")
    def run(tokens: pa.Array) -> pa.Array:
        parts = [_coverages(tokens.slice(a, b - a), orders, min_count) for a, b in slices(tokens, most)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return run(tokens)
