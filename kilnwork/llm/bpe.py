"""BPE encoding and decoding by per-prefix dynamic programming.

For a given list of merges the last token of the encoding of every prefix of a word is unique. So one pass over the
word suffices: an Aho-Corasick automaton over the vocabulary (the suffix links of an automaton of all tokens) tells the
tokens that end at a position, and the one is kept that is compatible with the last token stored for the prefix
before it. Following the stored tokens back from the end gives the ids that merging pair by pair would give.

Two neighbouring tokens are compatible when no merge across their border would come before the merges that made them.

The tokenizer's file gives vocabulary, merges, special tokens, normaliser and word pattern; its path is a parameter. Each
distinct word is encoded once for as long as a bounded table remembers it.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to ""; special tokens written in a text
are cut out first, as the tokenizer does; words of any length take time in proportion; repeated rows each get their
row; the other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

_END = ""
_INF = 1 << 60


def byte_letters() -> str:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(spare)) for b in range(256))


class Words:
    """Encodes words by one tokenizer's merges. remembered words and paired tokens bound a worker's memory (some 60 MB), not the result."""

    def __init__(self, path: str, remembered: int = 100_000, paired: int = 250_000):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, suffix = held["model"], held["model"].get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or held.get("decoder"):
            raise ValueError("a BPE tokenizer with word ends and no decoder is needed")
        self.vocab = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in held["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.suffix, self.remembered, self.paired = suffix, remembered, paired
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): n for n, (a, b) in enumerate(pairs)}
        #: Of a token that a merge makes: its rank and parts.
        self.parts: dict[int, tuple[int, int, int]] = {}
        for n, (a, b) in enumerate(pairs):
            self.parts.setdefault(self.vocab[a + b], (n, self.vocab[a], self.vocab[b]))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            if i in self.special.values():
                continue
            ended = bool(suffix) and token.endswith(suffix)
            plain = token[: len(token) - len(suffix)] if ended else token
            if len(plain) == 1 or i in self.parts:
                self.automaton.add_word(plain + _END if ended else plain, (len(plain) + ended, i))
        self.automaton.make_automaton()
        self.agree: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.letters = byte_letters()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank at which it is merged away) from the whole token down to its right (side 2) or left (side 1) edge symbol."""
        out, until = [(token, _INF)], _INF
        while token in self.parts:
            made = self.parts[token]
            until, token = made[0], made[side]
            out.append((token, until))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether the tokens a b are the encoding of what they spell. Merges go by rank, then from left to right."""
        found, right = True, self._edge(b, 1)
        for x, x_until in self._edge(a, 2):
            for y, y_until in right:
                n = self.rank.get((x, y), _INF)
                if n < x_until and n <= y_until:
                    found = False
        if len(self.agree) >= self.paired:
            self.agree.clear()
        self.agree[a, b] = found
        return found

    def ids(self, word: str) -> list[int]:
        """Ids of one word, as the pattern gives it."""
        text = word.encode("utf-8").decode("latin-1").translate(self.letters) + _END * bool(self.suffix)
        n, agree = len(text), self.agree
        last, sizes = [-1] * (n + 1), [0] * (n + 1)  # of each prefix: the last token and its length
        for at, (size, token) in self.automaton.iter(text):
            end = at + 1
            if last[end] >= 0:
                continue
            if done := end - size:
                before = last[done]
                if before < 0:
                    continue
                fits = agree.get((before, token))
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last[end], sizes[end] = token, size
        out = []
        while n:
            if last[n] < 0:
                raise ValueError(f"no token ends {word!r}")
            out.append(last[n])
            n -= sizes[n]
        return out[::-1]

    def told(self, word: str) -> tuple[int, str, str]:
        """Number of ids, ids and tokens joined by spaces."""
        found = self.known.get(word)
        if found is None:
            own = self.ids(word)
            found = len(own), " ".join(map(str, own)), " ".join(self.names[i] for i in own)
            if len(self.known) >= self.remembered:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = found
        return found


@functools.cache
def words_of(path: str) -> Words:
    return Words(path)


#: As in the tokenizer's file: contractions, runs of letters, single digits, runs of the rest; between them, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def splitter(path: str) -> Callable[[str], list[str]]:
    """Normalises a piece of text and cuts it into words."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    steps = [x["type"] for x in held["normalizer"]["normalizers"]]
    first = held["pre_tokenizer"]["pretokenizers"][0]
    if steps != ["NFC", "Replace", "Lowercase"] or first["pattern"] != {"Regex": PATTERN} or not first["invert"]:
        raise ValueError("this normaliser or word pattern is not known here")
    from tokenizers import Tokenizer

    find, rare = regex.compile(PATTERN).findall, regex.compile("[^\x00-\u0556]").search
    own = Tokenizer.from_file(path)
    back = {c: bytes([b]) for b, c in enumerate(byte_letters())}

    def split(text: str) -> list[str]:
        if rare(text):  # scripts in which versions of Unicode differ: as the tokenizer's own version of Unicode has them
            found = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(text))
            return [b"".join(back[c] for c in w).decode() for w, _ in found]
        # str.lower() looks around a final sigma; the tokenizer lowers each character by itself
        return find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    return split


def encoded(text: str, words: Words, split: Callable[[str], list[str]]) -> tuple[int, str, str]:
    """(number of ids, ids joined by spaces, decoded text) of one text."""
    cut = [text]
    if any(t in text for t in words.special):
        cut = regex.split("(" + "|".join(regex.escape(t) for t in words.special) + ")", text)
    total, ids, tokens = 0, [], []
    told, known = words.told, words.known
    for i, piece in enumerate(cut):
        if i % 2:
            total, ids, tokens = total + 1, [*ids, str(words.special[piece])], [*tokens, piece]
        elif piece:
            found = [known.get(w) or told(w) for w in split(piece)]
            if found:
                counts, own, names = zip(*found, strict=True)
                total += sum(counts)
                ids.append(" ".join(own))
                tokens.append(" ".join(names))
    return total, " ".join(ids), " ".join(tokens)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), and with ids token_ids array<int> and decoded string: the ids of
    every whole text and what they decode to. One pass over the texts without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = words_of(path), splitter(path)
        for batch in pieces(batches, "text", 1 << 20):
            rows = [encoded(x or "", words, split) for x in batch["text"].to_pylist()]
            out = {
                "id": batch["id"],
                "n_tokens": pa.array([r[0] for r in rows], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string()),
            }
            if ids:
                out |= {"token_ids": pa.array([[int(i) for i in r[1].split()] for r in rows], pa.list_(pa.int32())), "decoded": pa.array([r[2] for r in rows], pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    kind = df.schema[id_col].dataType.simpleString()
    made = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>, decoded string" * ids)
    return made.withColumnRenamed("id", id_col)
