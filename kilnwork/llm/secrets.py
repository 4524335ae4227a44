"""Secret scans: fixed patterns, and a battery of randomness tests on the other tokens.

Tokens are runs of 20 or more characters of [A-Za-z0-9+/_=-]. From its characters an encoding is inferred (hex of one
case, base 32, letters and digits, base 64), and four tests ask whether the token could be uniform over that alphabet:
chi-squared of the symbols' counts and of the counts of digits, vowels, other letters and signs (Wilson-Hilferty), runs
above and below the alphabet's middle (Wald-Wolfowitz), and serial correlation of neighbours. Each gives a normal score;
one-sided for the first two, two-sided for the others. A token's p-value is that of the least of the four (Sidak).

Random tokens have uniform p-values, words and names of things tiny ones. In each band of lengths, as short tokens give the tests
less to go by, a threshold is set over the whole corpus such that of the tokens above it, which count as secrets, an estimated
RATE at most is false (see cut_of). The corpus is summed to bands x BINS counts for this.

Defined cases: a null text counts as empty and has no spans; repeated rows each get their row; an empty table gives
none; the other columns are ignored by scan() and kept by redact(). Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns; the number is the least length, of group 2 for assign and of the match for the others.
KINDS = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8),
    "access": ("AKIA[A-Z0-9]+", 16),
    "hex": ("[0-9a-f]{32,}", 32),
}
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
#: Upper ends of the bands of lengths; the share of false secrets allowed in a band; thresholds tried are 2**-1 to 2**-BINS.
BANDS, RATE, BINS = (23, 27, 31, 39, 63, 127), 0.05, 24
#: Inferred encodings: name, what a whole token must match, alphabet in order.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    "upper hex": ("^[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    "base 32": ("^[A-Z2-7]+=*$", _UPPER + _DIGITS[2:8]),
    "base 36": ("^[a-z0-9]+$", _DIGITS + _LOWER),
    "base 36 upper": ("^[A-Z0-9]+$", _DIGITS + _UPPER),
    "base 62": ("^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    "base 64": ("^[A-Za-z0-9+/_=-]+$", _UPPER + _LOWER + _DIGITS + "+/"),
}
#: Kinds of characters, for the coarse test; tests of a token; sizes of groups in running sums.
CHARACTERS = (_DIGITS, "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "aeiou", "bcdfghjklmnpqrstvwxyz", "+/")
TESTS, GROUP = 4, 256
_MARK, _OTHER = "\u0001", "\u0002"

_SPANS = "array<struct<start:int,end:int,token:string>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _prefix_sums(sizes: Column) -> Column:
    """Running sums of an array, in groups of GROUP: an array is appended to within a group and over the groups only, not over all."""
    append = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["sums"], F.array(s["at"] + n)).alias("sums"))
    run = lambda values, first: F.aggregate(values, F.struct(first.alias("at"), F.array().cast("array<int>").alias("sums")), append, lambda s: s["sums"])
    count = F.ceil(F.size(sizes) / GROUP).cast("int")
    groups = F.transform(F.sequence(F.lit(0), count - 1), lambda g: F.slice(sizes, g * GROUP + 1, F.lit(GROUP)))

    def joined(groups: Column) -> Column:
        totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda s, n: s + n))
        return once(run(totals, F.lit(0)), lambda ends: F.flatten(F.transform(groups, lambda g, i: run(g, F.when(i == 0, 0).otherwise(F.element_at(ends, F.greatest(i, F.lit(1))))))))

    return once(groups, joined)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, token): the text is cut at marks set around each match, so the
    odd pieces are the matches and the lengths before them give their places. No pattern here can match the mark."""
    cut = F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)

    def spans(cut: Column) -> Column:
        def of(ends: Column) -> Column:
            odd = F.sequence(F.lit(2), F.size(cut) - 1, F.lit(2))
            return F.transform(odd, lambda i: F.struct(F.element_at(ends, i - 1).alias("start"), F.element_at(ends, i).alias("end"), F.element_at(cut, i).alias("token")))

        return once(_prefix_sums(F.transform(cut, lambda x: F.length(x))), of)

    return F.when(text.rlike(pattern), once(cut, spans)).otherwise(F.array().cast(_SPANS))


def _long(kind: str) -> Callable[[Column], Column]:
    pattern, least = KINDS[kind]
    return lambda x: F.length(F.regexp_extract(x["token"], pattern, 2) if kind == "assign" else x["token"]) >= least


def _numbered(spans: str, number: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))


def _base(df: DataFrame, text: Column) -> DataFrame:
    """df with __assign, __access and __hex: arrays of spans."""
    return df.withColumns({f"__{kind}": F.filter(matches(text, pattern), _long(kind)) for kind, (pattern, _) in KINDS.items()})


def _tail(z: Column) -> Column:
    """P(N(0, 1) > z) for z >= 0 (rational approximation, error below 1e-7 of the leading term)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) * 0.3989422804014327 * poly, F.lit(1e-300))


def _chi_score(chi: Column, d: Column) -> Column:
    """Normal score of a chi-squared value with d degrees of freedom (Wilson-Hilferty)."""
    return (F.pow(F.greatest(chi, F.lit(0.0)) / d, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d))


def _kinds(body: Column, alphabet: Column) -> Column:
    """Chi-squared of the counts of digits, vowels, other letters and signs, as the alphabet has them, and its degrees of freedom."""
    of = lambda t, kind: (F.length(t) - F.length(F.translate(t, kind, ""))).cast("double")
    chi, d = F.lit(0.0), F.lit(-1.0)
    for kind in CHARACTERS:
        expected = F.length(body) * of(alphabet, kind) / F.length(alphabet)
        chi = chi + F.when(expected > 0, F.pow(of(body, kind) - expected, F.lit(2.0)) / F.greatest(expected, F.lit(1e-9))).otherwise(0.0)
        d = d + F.when(expected > 0, 1.0).otherwise(0.0)
    return F.struct(chi.alias("chi"), d.alias("d"))


def _tested(tokens: Column) -> Column:
    """For each (start, end, token): (start, end, band, p). A token of letters in one case, but for its first, is a word: it has no encoding and is left out."""
    encoded = F.filter(tokens, lambda x: x["token"].rlike("[0-9][A-Za-z+/_=-]*[A-Za-z]|[A-Za-z][A-Za-z+/_=-]*[0-9]|[a-z][A-Z]"))
    plain = F.transform(encoded, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.regexp_replace(F.translate(x["token"], "-_", "+/"), "=+", "").alias("body")))
    plain = F.filter(plain, lambda x: F.length(x["body"]) >= 16)

    def coded(x: Column) -> Column:
        alphabet = reduce(lambda rest, e: F.when(x["body"].rlike(ENCODINGS[e][0]), F.lit(ENCODINGS[e][1])).otherwise(rest), reversed(list(ENCODINGS)), F.lit(ENCODINGS["base 64"][1]))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["body"].alias("body"), alphabet.alias("alphabet"))

    def placed(x: Column) -> Column:
        at = F.transform(F.split(x["body"], ""), lambda c: (F.position(c, x["alphabet"]) - 1).cast("double"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), at.alias("at"), _kinds(x["body"], x["alphabet"]).alias("kinds"), F.length(x["alphabet"]).cast("double").alias("k"), F.length(x["body"]).cast("double").alias("n"))

    def scored(x: Column) -> Column:
        at, k, n = x["at"], x["k"], x["n"]
        zero = F.lit(0.0)
        squares = F.aggregate(F.sequence(F.lit(0), (k - 1).cast("int")), zero, lambda s, v: s + F.pow(F.size(F.filter(at, lambda y: y == v)).cast("double"), F.lit(2.0)))
        chi = squares * k / n - n
        z_chi = _chi_score(chi, k - 1)
        z_kinds = _chi_score(x["kinds"]["chi"], F.greatest(x["kinds"]["d"], F.lit(1.0)))
        ups = F.size(F.filter(at, lambda y: y * 2 >= k)).cast("double")
        neighbours = F.zip_with(F.slice(at, 1, (n - 1).cast("int")), F.slice(at, 2, (n - 1).cast("int")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = 1 + F.size(F.filter(neighbours, lambda p: (p["a"] * 2 >= k) != (p["b"] * 2 >= k)))
        mean = 2 * ups * (n - ups) / n + 1
        z_runs = F.when((ups == 0) | (ups == n), F.sqrt(n) * 1.2).otherwise(F.abs(runs - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))))
        product = F.aggregate(neighbours, zero, lambda s, p: s + (p["a"] - (k - 1) / 2) * (p["b"] - (k - 1) / 2))
        z_serial = F.abs(product) / (F.sqrt(n - 1) * (k * k - 1) / 12)
        least = F.least(_tail(F.greatest(z_chi, zero)), _tail(F.greatest(z_kinds, zero)), 2 * _tail(z_runs), 2 * _tail(z_serial), F.lit(0.999999))
        p = -F.expm1(TESTS * F.log1p(-least))
        band = reduce(lambda rest, i: F.when(n <= BANDS[i], F.lit(i)).otherwise(rest), range(len(BANDS) - 1, -1, -1), F.lit(len(BANDS)))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), band.alias("band"), F.least(p, F.lit(1.0)).alias("p"))

    return F.transform(F.transform(F.transform(plain, coded), placed), scored)


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log2(p)), F.lit(BINS)).cast("int")


def cut_of(per: list[int], rate: float = RATE) -> float:
    """The p-value above which a band's tokens are secrets, from the counts of p-values in (2**-(i+1), 2**-i], all smaller ones last.

    The p-values of random tokens are uniform, those of others lie near 0. So twice the tokens above 1/2 are about all random ones
    there are, and of the tokens above c, those beyond the (1 - c)th part of them are false. The smallest c with a share
    of false secrets of at most rate is taken; 1, so that none is a secret, where even c = 1/2 has no token above it.
    """
    above, cut, random = 0, 1.0, 2 * per[0]
    for i in range(BINS):
        above += per[i]
        c = 2.0 ** -(i + 1)
        if random and above - random * (1 - c) <= rate * above:
            cut = c
    return cut


def thresholds(df: DataFrame, text_col: str = "text", rate: float = RATE) -> list[float]:
    """For each band of lengths the p-value above which tokens are secrets, over all of df."""
    tokens = df.select(F.explode(_tested(matches(F.coalesce(F.col(text_col), F.lit("")), TOKEN))).alias("x")).select("x.band", _bin(F.col("x.p")).alias("bin"))
    counts = {(r["band"], r["bin"]): r["count"] for r in tokens.groupBy("band", "bin").count().collect()}  # bands x BINS rows at most
    return [cut_of([counts.get((band, i), 0) for i in range(BINS + 1)], rate) for band in range(len(BANDS) + 1)]


def _scanned(df: DataFrame, text: Column, cuts: list[float]) -> DataFrame:
    """df with __spans: (start, kind, end) of all spans in order, kinds 0 to 3, and the three base arrays."""
    df = _base(df, text).withColumn("__tested", _tested(matches(text, TOKEN)))
    cut = F.array(*[F.lit(float(c)) for c in cuts])
    base = F.concat(*[_numbered(f"__{kind}", i) for i, kind in enumerate(KINDS)])
    df = df.withColumn("__base", F.array_sort(base))
    random = F.filter("__tested", lambda x: (x["p"] > F.element_at(cut, x["band"] + 1)) & ~F.exists("__base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    random = F.transform(random, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end")))
    return df.withColumn("__spans", F.array_sort(F.concat("__base", random)))


def _told(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "random")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans). Two scans of the texts; only the corpus' counts are shuffled."""
    df = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = _scanned(df, F.col("text"), thresholds(df, "text", rate))
    return out.select(F.col("id").alias(id_col), *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_told("__base").cast("binary"), 256).alias("base_sha256"), _told("__spans").alias("spans"))


def redact(df: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """df with every span of its texts replaced by <kind>; texts without spans, nulls included, stay as they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = _scanned(df, text, thresholds(df, text_col, rate))
    names = F.array(*[F.lit(f"<{k}>") for k in (*KINDS, "random")])

    def step(s: Column, x: Column) -> Column:
        kept = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        new = x["end"] > s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(new, F.concat(s["out"], kept, F.when(x["start"] >= s["at"], F.element_at(names, x["kind"] + 1)).otherwise(""))).otherwise(s["out"]).alias("out"))

    clean = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return out.withColumn("__clean", F.when(F.size("__spans") > 0, clean).otherwise(F.col(text_col))).select(*[F.col("__clean").alias(c) if c == text_col else F.col(c) for c in df.columns])
