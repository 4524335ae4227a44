"""Columns over code and text; all built-in, none shuffles.

White space and line breaks are those of Unicode plus U+001C to U+001F, as scripting languages split and strip them.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, line breaks, number literals (in code, in lines) and tokens.
WS = "[\\s\\x1c-\\x1f]"
BREAK = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029](?:(?<=\\r)\\n)?"
NUMBER = "(?U)(?=[-+.\\d])(?<![A-Za-z])[-+]?(?:\\d+\\.\\d*|\\.\\d+|\\d+)(?:[eE][-+]?\\d+)?"
LINE_NUMBER = "(?U)(?=[-+.\\d])[-+]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)(?:[eE][-+]?\\d+)?"
#: Letters one by one: a class of single characters is looked up in a table, one of ranges is not. Fixed order of alternatives: command, number mark, name, arrows, any other character.
TOKEN = f"(?U)\\\\[{ascii_letters}@]+|NUM|[{ascii_letters}_][{ascii_letters}{digits}_]*|--|->|<-|<->|[^\\s\\x1c-\\x1f]"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)\\A{WS}+|{WS}+\\z", "")


def lines(c: Column) -> Column:
    """The lines, without an empty one after the last break; no line for an empty text."""
    return once(F.split(c, BREAK, -1), lambda cut: F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut))


def normalize_code(c: Column | str) -> Column:
    """P1. Line breaks to LF; one code fence at each end off; lines and text stripped; null: ""."""
    t = strip(F.regexp_replace(text_of(c), "\\r\\n?", "\n"))
    t = F.regexp_replace(t, f"(?iU)\\A```(?:latex|tex|tikz)?{WS}*", "")
    t = F.regexp_replace(t, f"(?U){WS}*```\\z", "")
    t = F.regexp_replace(t, BREAK, "\n")
    return strip(F.regexp_replace(t, "(?U)(?:(?!\\n)[\\s\\x1f])+(?=\\n|\\z)", ""))


def once(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), with x computed once a row however often it is used."""
    return F.element_at(F.transform(F.array(x), of), 1)


def code_hash(c: Column | str) -> Column:
    """P2. SHA-256 of the normalised code, "" if that is empty."""
    return once(normalize_code(c), lambda code: F.when(code == "", F.lit("")).otherwise(F.sha2(code.cast("binary"), 256)))


def strip_comments(c: Column | str) -> Column:
    """P3. Each line up to the first % without a backslash before it. Lines are cut in the whole text, not one by one."""
    whole = F.regexp_replace(F.regexp_replace(text_of(c), BREAK, "\n"), "\\n\\z", "")
    return F.regexp_replace(whole, "(?<!\\\\)%[^\\n]*+", "")


def normalize_numbers(c: Column | str, token: str = "NUM") -> Column:
    """P4. Number literals that follow no ASCII letter become token."""
    return F.regexp_replace(text_of(c), NUMBER, token)


def tokenize_code(c: Column | str) -> Column:
    """P5. Tokens of the code without comments, numbers as NUM."""
    return F.regexp_extract_all(normalize_numbers(strip_comments(c)), F.lit(TOKEN), F.lit(0))


def ngrams(tokens: Column | str, n: int, sep: str = "\u0001") -> Column:
    """P6. All runs of n tokens, joined by sep. tokens should be a column of the table: an expression would be computed anew for each run."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    at = F.sequence(F.lit(1), F.size(tokens) - n + 1)
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), sep))).otherwise(F.array().cast("array<string>"))


def token_len(c: Column | str, cap: int | None = None) -> Column:
    """P7. Number of tokens, at most cap + 1; another tokenizer may be put in its place as a pandas UDF."""
    n = F.size(tokenize_code(c))
    return n if cap is None else F.least(n, F.lit(cap + 1))


def _from(t: Column, mark: str) -> Column:
    return F.when(F.instr(t, mark) > 0, F.substring(t, F.instr(t, mark), F.length(t))).otherwise(t)


def extract_document(c: Column | str) -> Column:
    """P8. From the first documentclass to the first end of a document after it."""
    t = _from(strip(text_of(c)), "\\documentclass")
    end = F.instr(t, "\\end{document}")
    return strip(F.when(end > 0, F.substring(t, F.lit(1), end + 13)).otherwise(t))


def clean_completion(c: Column | str) -> Column:
    """P9. One fence at each end off, then P8."""
    t = F.regexp_replace(strip(text_of(c)), f"(?iU)\\A```(?:latex|tex)?{WS}*", "")
    return extract_document(F.regexp_replace(t, f"(?U){WS}*```\\z", ""))


def extract_fenced(c: Column | str) -> Column:
    """P10. Body of the first fenced block (tag latex or tex, or none), else the whole text, without a byte order mark."""
    t = F.regexp_replace(strip(text_of(c)), "\\A\\ufeff+", "")
    block = "(?is)```(?:latex|tex)?[ \\t]*\\r?\\n?(.*?)```"
    return F.when(t.rlike(block), strip(F.regexp_extract(t, block, 1))).otherwise(t)


def _between(t: Column, first: str, last: str) -> Column:
    """From the first mark to the last end mark, null if they are not there in this order."""
    start, tail = F.instr(t, first), F.instr(F.reverse(t), last[::-1])
    end = F.length(t) - tail - len(last) + 2
    return F.when((start > 0) & (tail > 0) & (end >= start), strip(F.substring(t, start, end - start + len(last))))


def extract_latex(c: Column | str) -> Column:
    """P11. Body of a fenced block with any tag; of that the document, else the picture, else all."""
    t = F.regexp_replace(strip(text_of(c)), "\\A\\ufeff+", "")
    block = "(?is)```[a-zA-Z0-9_-]*[ \\t]*\\r?\\n?(.*?)```"
    t = F.when(t.rlike(block), strip(F.regexp_extract(t, block, 1))).otherwise(t)
    return F.coalesce(_between(t, "\\documentclass", "\\end{document}"), _between(t, "\\begin{tikzpicture}", "\\end{tikzpicture}"), strip(t))


def extract_text(messages: Column | str) -> Column:
    """P12. Text parts of array<struct<role, content: array<struct<type, text>>>>, joined."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    parts = F.flatten(F.transform(messages, lambda m: F.coalesce(m["content"], F.array())))
    return F.coalesce(F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit(""))


def disable_page_numbers(c: Column | str) -> Column:
    """P13. Page styles around the first begin of a document."""
    t, mark = text_of(c), "\\begin{document}"
    at = F.instr(t, mark)
    return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.lit(f"\\pagestyle{{empty}}\n{mark}\n\\thispagestyle{{empty}}"), F.substring(t, at + len(mark), F.length(t)))).otherwise(t)


def latex_issues(log: Column | str) -> Column:
    """P15. struct(errors, warnings, badboxes) of a compiler's log."""
    rows = F.transform(lines(text_of(log)), strip)
    return F.struct(
        F.size(F.filter(rows, lambda x: x.startswith("!") | x.rlike("\\A\\.?/?.*\\.tex:\\d+:"))).alias("errors"),
        F.size(F.filter(rows, lambda x: x.contains("Warning:") & ~x.startswith("Package rerunfilecheck Warning:"))).alias("warnings"),
        F.size(F.filter(rows, lambda x: x.startswith("Overfull \\") | x.startswith("Underfull \\"))).alias("badboxes"),
    )


def normal_lines(c: Column | str) -> Column:
    """The stripped lines that are not blank, numbers as <NUM>."""
    return F.transform(F.filter(F.transform(lines(text_of(c)), strip), lambda x: x != ""), lambda x: F.regexp_replace(x, LINE_NUMBER, "<NUM>"))


def count_of(t: Column, part: str) -> Column:
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("int")


def most_alike(rows: Column) -> Column:
    """Largest number of equal entries: in sorted order they are one run."""
    return longest_run(F.array_sort(rows))


def longest_run(rows: Column) -> Column:
    """Longest run of equal neighbours, 0 for none."""
    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(s["x"] == x, s["n"] + 1).otherwise(1)
        return F.struct(x.alias("x"), n.alias("n"), F.greatest(s["most"], n).alias("most"))

    return F.aggregate(rows, start, step, lambda s: s["most"])


def line_repetition_ratio(c: Column | str) -> Column:
    """P17. 1 - distinct / all normal lines, 0 for none."""
    return once(normal_lines(c), lambda rows: F.when(F.size(rows) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(rows)) / F.size(rows)))


def code_structure(c: Column | str) -> Column:
    """P16. struct of sizes, command counts and line repetition."""
    t, rows = text_of(c), normal_lines(c)
    n = F.size(rows)
    return F.struct(
        F.length(t).alias("code_chars"),
        n.alias("code_lines"),
        count_of(t, "\\draw").alias("draw_count"),
        count_of(t, "\\fill").alias("fill_count"),
        count_of(t, "\\node").alias("node_count"),
        line_repetition_ratio(c).alias("normalized_line_repetition_ratio"),
        F.when(n == 0, F.lit(0.0)).otherwise(most_alike(rows) / n).alias("dominant_normalized_line_fraction"),
        longest_run(rows).alias("max_identical_normalized_line_run"),
    )


def ngram_repetition_ratio(tokens: Column | str, n: int = 16) -> Column:
    """P18. 1 - distinct / all n-grams, 0 if there is none."""
    once = F.transform(F.array(ngrams(tokens, n)), lambda grams: F.when(F.size(grams) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(grams)) / F.size(grams)))
    return F.element_at(once, 1)


def has_text(c: Column | str) -> Column:
    """P19. Neither null nor blank."""
    return strip(text_of(c)) != ""


def slug(c: Column | str) -> Column:
    r"""P20. A name safe for files; "class" if nothing is left. \w is A-Z, a-z, 0-9 and _ here; written out as ranges it took nine times as long."""
    t = F.btrim(F.regexp_replace(text_of(c), "[^\\w.-]+", "_"), F.lit("_"))
    return once(t, lambda t: F.when(t == "", F.lit("class")).otherwise(t))


def render_instruction(prompt: Column | str, description: Column | str, use: bool = True) -> Column:
    """P22. The prompt, and a paragraph of hints if there is a description."""
    p, d = strip(text_of(prompt)), strip(text_of(description))
    hint = F.concat(p, F.lit("\n\nAdditionally, here is a description of the image with some creation hints:\n"), d)
    return F.when((d != "") & F.lit(use), hint).otherwise(p)


def truncate_text(c: Column | str, n: int = 8000, mark: str = "\n\n...[truncated]...") -> Column:
    """P23. The first n characters and a mark, if there are more."""
    t = text_of(c)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit(mark))).otherwise(t)


def class_name(cluster: Column | str, names: dict[int, str] | None = None) -> Column:
    """P24. noise below 0, a given name, else class_<cluster + 1>."""
    c = F.col(cluster) if isinstance(cluster, str) else cluster
    out = F.concat(F.lit("class_"), (c + 1).cast("string"))
    for i, name in (names or {}).items():
        out = F.when(c == i, F.lit(name)).otherwise(out)
    return F.when(c < 0, F.lit("noise")).otherwise(out)


#: Lower ends of the classes above low.
REPETITION = {"medium": 0.25, "high": 0.45, "very_high": 0.65, "critical": 0.85}


def repetition_class(score: Column | str, thresholds: dict[str, float] | None = None) -> Column:
    """P25. low below the first threshold, then the class of the last threshold reached."""
    thresholds = thresholds or REPETITION
    ends = list(thresholds.values())
    if ends != sorted(ends) or not all(0 <= x <= 1 for x in ends):
        raise ValueError("thresholds must ascend within [0, 1]")
    score = F.col(score) if isinstance(score, str) else score
    out = F.lit("low")
    for name, least in thresholds.items():
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


#: Orders and weights of local repetition.
WEIGHTS = {2: 0.35, 3: 0.30, 4: 0.20, 6: 0.20}


def weighted_repetition(coverages: dict[int, Column], normalized: bool = True) -> Column:
    """A4. Weighted mean (or sum) of coverages by order."""
    total = sum((F.lit(WEIGHTS[n]) * c for n, c in coverages.items()), F.lit(0.0))
    return total / F.lit(sum(WEIGHTS[n] for n in coverages)) if normalized else total
