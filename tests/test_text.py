"""Column functions against plain Python on random strings and hand-made cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from kilnwork.functions import helpers, text

PIECES = ["\r\n", "\r", "\n", "\x0b", "\u2028", "%", "\\%", "x12", "1.2cm", "-2.", ".5", "1e-3", "NUMBER", "<->", "-->", "```latex", "```", " ", "\t", "\\draw", "é", "٣", "a", "", "\x1f", "\\node at (0,0) {A};", "\\begin{document}", "\\end{document}", "\\documentclass"]


def strings(n: int = 500) -> list[str]:
    rng = random.Random(5)
    return ["", " ", "```\n```", *("".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 25))) for _ in range(n))]


def outer(t: str, left: bool = True, right: bool = True) -> str:
    """t without white space at its ends, character by character."""
    a, b = 0, len(t)
    while left and a < b and t[a].isspace():
        a += 1
    while right and b > a and t[b - 1].isspace():
        b -= 1
    return t[a:b]


def rows_of(t: str) -> list[str]:
    rows, own, i = [], "", 0
    while i < len(t):
        if t[i] in "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029":
            rows.append(own)
            own, i = "", i + (2 if t[i : i + 2] == "\r\n" else 1)
        else:
            own, i = own + t[i], i + 1
    return [*rows, own] if own else rows


def normal(t: str) -> str:
    t = outer(t.replace("\r\n", "\n").replace("\r", "\n"))
    tag = next((m for m in ("```latex", "```tikz", "```tex", "```") if t.lower().startswith(m)), "")
    t = outer(t[len(tag) :], right=False) if tag else t
    t = outer(t[:-3], left=False) if t.endswith("```") else t
    return outer("\n".join(outer(x, left=False) for x in rows_of(t)))


def uncommented(row: str) -> str:
    for i, c in enumerate(row):
        if c == "%" and row[i - 1 : i] != "\\":
            return row[:i]
    return row


def digits(t: str, i: int) -> int:
    while i < len(t) and t[i].isdecimal():
        i += 1
    return i


def number_end(t: str, i: int) -> int:
    """Where the number that starts at i ends; i if there is none."""
    a = i + (t[i : i + 1] in ("+", "-"))
    b = digits(t, a)
    if t[b : b + 1] == ".":
        c = digits(t, b + 1)
        b = c if c > b + 1 or b > a else a
    if b == a:
        return i
    if t[b : b + 1] in ("e", "E"):
        c = b + 1 + (t[b + 1 : b + 2] in ("+", "-"))
        b = digits(t, c) if digits(t, c) > c else b
    return b


def tokens(t: str) -> list[str]:
    t = "\n".join(uncommented(x) for x in rows_of(t))
    out, i = "", 0
    while i < len(t):
        before = t[i - 1] if i else " "
        end = i if before.isascii() and before.isalpha() else number_end(t, i)
        out, i = (out + "NUM", end) if end > i else (out + t[i], i + 1)
    found, i = [], 0
    name = lambda c, more: c.isascii() and (c.isalpha() or c in more or (c.isdigit() and "0" in more))
    while i < len(out):
        j = i + 1
        if out[i] == "\\":
            while j < len(out) and name(out[j], "@"):
                j += 1
        elif out.startswith("NUM", i):
            j = i + 3
        elif name(out[i], "_"):
            while j < len(out) and name(out[j], "_0"):
                j += 1
        elif out[i : i + 2] in ("--", "->", "<-"):
            j = i + 2
        if not out[i].isspace():
            found.append(out[i:j])
        i = j
    return found


def coverage(own: list[str], n: int, least: int) -> float:
    c = Counter(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    return sum(v for v in c.values() if v >= least) / sum(c.values()) if c else 0.0


def test_random_strings(spark):
    rows = strings()
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").withColumn("k", text.tokenize_code("t"))
    got = df.select("i", text.normalize_code("t").alias("n"), text.code_hash("t").alias("h"), "k", helpers.ngram_coverages("k", [2, 3, 6], 3).alias("c"), text.line_repetition_ratio("t").alias("r")).collect()
    for g in got:
        t = rows[g["i"]]
        assert g["n"] == normal(t), repr(t)
        assert g["h"] == (hashlib.sha256(normal(t).encode()).hexdigest() if normal(t) else "")
        assert g["k"] == tokens(t), repr(t)
        assert all(abs(x - coverage(tokens(t), n, 3)) < 1e-12 for x, n in zip(g["c"], (2, 3, 6), strict=True))
        own = [re.sub(r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?", "<NUM>", x.strip()) for x in t.splitlines() if x.strip()]
        assert abs(g["r"] - (1 - len(set(own)) / len(own) if own else 0)) < 1e-12


def test_token_goldens(spark):
    want = {"x12": ["x1NUM"], "1.2cm": ["NUM", "cm"], "NUMBER": ["NUM", "BER"], "<->": ["<-", ">"], "-->": ["--", ">"], "0--1": ["NUM", "-", "NUM"], None: []}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", text.tokenize_code("t").alias("k")).collect()} == want


def test_labels():
    tex = "\\node at (0,0) {A}; \\draw (0,0) -- (1,1) node[above] {b} node {};"
    assert helpers.neutralized(tex, "replace_sequential", "") == "\\node at (0,0) {aaaa}; \\draw (0,0) -- (1,1) node[above] {aaab} node {};"
    assert helpers.neutralized("\\node {a\\}b}; mynode {x} nodes={y}", "replace_all", "T") == "\\node {T}; mynode {x} nodes={y}"
    assert helpers.neutralized("\\node % {\n[x] {k {z} l}", "replace_all", "T") == "\\node % {\n[x] {T}"
    assert helpers.neutralized(None, "replace_all", "T") == ""
    assert helpers.neutralized("\\node[a (b] (c) { % x }\n}; \\node {q} node [x", "replace_all", "T") == "\\node[a (b] (c) {}; \\node {T} node [x"
    assert helpers.neutralized("\\\\node \\{x\\} y} z", "replace_all", "T") == "\\\\node \\{T} z"
    assert helpers.neutralized("node% [x] {k}\n({p) {t}", "replace_all", "T") == "node% [x] {k}\n({p) {T}"
    assert helpers.neutralized("\\node {a}" * 30, "replace_sequential", "").count("{aabd}") == 1


def test_edit_distance():
    rng = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        assert helpers.token_distance(a, b) == plain(a, b)


def test_document_and_log(spark):
    log = "! bad\n./figure.tex:12: worse\nLaTeX Warning: x\nPackage rerunfilecheck Warning: y\nOverfull \\hbox\n Underfull \\vbox"
    df = spark.createDataFrame([("a \\documentclass{x} b \\end{document} c", log)], "t string, l string")
    r = df.select(text.extract_document("t").alias("d"), text.latex_issues("l").alias("i"), text.disable_page_numbers(F.lit("\\begin{document}x\\begin{document}")).alias("p")).first()
    assert r["d"] == "\\documentclass{x} b \\end{document}"
    assert tuple(r["i"]) == (2, 1, 2)
    assert r["p"] == "\\pagestyle{empty}\n\\begin{document}\n\\thispagestyle{empty}x\\begin{document}"


def test_text_expressions_are_computed_once_and_equal_to_plain_ones(spark):
    """The text of a row is normalised, cut or trimmed once, not once for each use of the result."""
    plan = lambda c: spark.createDataFrame([("a",)], "t string").select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(text.code_hash("t")).count("tikz") == 1
    assert plan(text.line_repetition_ratio("t")).count("split(") == 1
    assert plan(text.slug("t")).count("regexp_replace(") == 1 and "A-Z" not in plan(text.slug("t"))
    assert "split(" not in plan(text.strip_comments("t"))
    rows = ["", "\n", "\r\n", "a\r\n\r\nb\r", "a % b \\% c\u2028% d\n\n%", "a\\%b\r%\rc\n", "\x0b\x85x\x1c", "__é_a b__", "_ _", "ÄÖ1.5 a-1.5e3+2 x1 .5", None, "a--b->c<-d<->e \\cmd@x NUM _a1 é ٣"]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("t", text.strip_comments("t").alias("c"), text.slug("t").alias("s"), text.tokenize_code("t").alias("k")).collect()
    number, token = r"(?<![A-Za-z])[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?", r"\\[A-Za-z@]+|NUM|[A-Za-z_][A-Za-z0-9_]*|--|->|<-|<->|\S"
    for r in got:
        t = r["t"] or ""
        bare = "\n".join(re.sub(r"(?s)(?<!\\)%.*\Z", "", x) for x in t.splitlines())
        assert r["c"] == bare
        assert r["s"] == (re.sub("[^A-Za-z0-9_.-]+", "_", t).strip("_") or "class")
        assert r["k"] == re.findall(token, re.sub(number, "NUM", bare))
