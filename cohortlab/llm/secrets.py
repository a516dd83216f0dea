"""Secret scanning: fixed patterns plus a randomness test battery, in DataFrame operations only.

Every candidate token is put to three tests against the uniform law of its inferred encoding: Pearson's chi-squared with exact
mean and variance, Wald-Wolfowitz runs about the middle of the alphabet, and lag-1 serial correlation. Fisher's method combines the three
p-values. In each band of token lengths the Benjamini-Hochberg procedure then finds, over the whole corpus, the tokens shown not to be
random, so that at most a share `fdr` of those cleared is expected to be random after all. The tokens it can't clear are spans of kind `random`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base scan.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
# Encodings in the order they are tried: pattern, alphabet.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("^[0-9a-f]+$", DIGITS + "abcdef"), ("^[0-9A-F]+$", DIGITS + "ABCDEF"), ("^[A-Z2-7]+$", UPPER + "234567"), ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER), ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER), ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"), ("", UPPER + LOWER + DIGITS + "+/-_"),
]
BINS_A_DECADE, LAST_BIN, CHUNK = 20, 400, 256
#: Coefficients of the rational-exponential fit of erfc in t = 1 / (1 + x / 2), whose relative error is below 1.2e-7 (fixed values).
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once."""
    return F.transform(F.array(x), body)[0]


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What `join` makes of 0 and all values before each place of an array of ints, by chunks, so that long arrays cost little more than their length."""

    def scan(items: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(items, start, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")), lambda acc: acc["all"])

    def chunked(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda i: F.slice(v, i * CHUNK + 1, F.lit(CHUNK)))
        zero = F.lit(0)
        return _let(parts, lambda ps: F.flatten(F.zip_with(ps, scan(F.transform(ps, lambda c: F.aggregate(c, zero, join)), zero), scan)))

    return _let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(chunked(v)))


def _found(text: Column, pattern: str, group: int | None = None) -> Column:
    """Array of (s, e, t): place in code points of each leftmost non-overlapping match, and its text or that of a group.

    Places come from the lengths of what lies between the matches; `split` and `regexp_extract_all` match alike.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    said = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.zip_with(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), F.arrays_zip(whole.alias("w"), said.alias("t")), lambda gap, m: F.struct(gap.alias("gap"), F.length(m["w"]).alias("n"), m["t"].alias("t")))

    def place(found: Column) -> Column:
        after = _before(F.transform(found, lambda x: x["gap"] + x["n"]), lambda a, b: a + b)
        return F.zip_with(found, after, lambda x, at: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), x["t"].alias("t")))

    spans = _let(F.filter(pairs, lambda x: x["n"].isNotNull()), place)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<s:int,e:int,t:string>>"))


def _log_tail(z: Column) -> Column:
    """Logarithm of the upper tail of the normal law, with a small relative error however far out."""
    x = F.abs(z) / 2**0.5
    t = 1.0 / (1.0 + x / 2)
    upper = F.log(t / 2) - x * x + reduce(lambda acc, c: acc * t + c, reversed(ERFC[:-1]), F.lit(ERFC[-1]))
    return F.when(z >= 0, upper).otherwise(F.log1p(-F.exp(upper)))


def _symbols(t: Column) -> Column:
    return F.filter(F.split(t, ""), lambda c: c != "")


def _squares(t: Column) -> Column:
    """Sum over the symbols of a token of the square of their counts."""
    count = lambda c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    return F.aggregate(F.array_distinct(_symbols(t)), F.lit(0.0), lambda acc, c: acc + F.pow(count(c), F.lit(2.0)))


def _cross(t: Column, alphabet: Column, mid: Column) -> Column:
    """Sum of the products of neighbouring symbol values about the middle of the alphabet."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("last"))

    def step(acc: Column, v: Column) -> Column:
        return F.struct((acc["sum"] + F.coalesce(acc["last"] * v, F.lit(0.0))).alias("sum"), v.alias("last"))

    value = F.transform(_symbols(t), lambda c: F.call_function("locate", c, alphabet).cast("double") - 1 - mid)
    return F.aggregate(value, start, step, lambda acc: acc["sum"])


def _candidates(text: Column) -> Column:
    """(s, e, band, bin) of each token of 16 or more characters that holds a digit and a letter: its place, its band of lengths, and the bin of
    Fisher's p-value of the three tests for a uniform random string over its inferred alphabet.

    Letters alone are left to the fixed patterns, since tests of so few symbols can't tell long words from keys, and so are digits alone. The steps follow each other as transforms of one array, so each quantity is computed once.
    """
    tokens = F.filter(_found(text, CANDIDATE), lambda x: x["t"].rlike("[0-9]") & x["t"].rlike("[A-Za-z]"))
    alphabet = lambda t: reduce(lambda rest, x: F.when(t.rlike(x[0]), F.lit(x[1])).otherwise(rest), reversed(ENCODINGS[:-1]), F.lit(ENCODINGS[-1][1]))
    keep = lambda x, *names: [x[n].alias(n) for n in names]
    named = F.transform(tokens, lambda x: F.struct(*keep(x, "s", "e", "t"), alphabet(x["t"]).alias("al")))

    def measure(x: Column) -> Column:
        size = F.length(x["al"])
        half = (size / 2).cast("int")
        # the token as a string of 0 (a symbol of the lower half of the alphabet) and 1
        sides = F.call_function("translate", x["t"], x["al"], F.concat(F.repeat(F.lit("0"), half), F.repeat(F.lit("1"), size - half)))
        return F.struct(*keep(x, "s", "e"), size.cast("double").alias("a"), F.length(x["t"]).cast("double").alias("n"), sides.alias("sides"), _squares(x["t"]).alias("squares"), _cross(x["t"], x["al"], (size - 1) / 2).alias("cross"))

    def count(x: Column) -> Column:
        low = F.length(F.replace(x["sides"], F.lit("1"), F.lit(""))).cast("double")
        turns = lambda y: (x["n"] - F.length(F.replace(x["sides"], F.lit(y), F.lit("")))) / 2
        return F.struct(*keep(x, "s", "e", "a", "n", "squares", "cross"), low.alias("low"), (1 + turns("01") + turns("10")).alias("runs"))

    def standardize(x: Column) -> Column:
        a, n, low = x["a"], x["n"], x["low"]
        # chi-squared as a gamma variable with its exact mean and variance, whose cube root is nearly normal
        df = (a - 1) * n / (n - 1)
        chi = (F.cbrt(F.greatest(a / n * x["squares"] - n, F.lit(0.0)) / (a - 1)) - 1 + 2 / (9 * df)) / F.sqrt(2 / (9 * df))
        less = 2 * low * (n - low) / n  # the mean number of runs, less one
        runs = (x["runs"] - 1 - less) / F.sqrt(F.greatest(less * (less - 1) / (n - 1), F.lit(1e-9)))
        serial = x["cross"] / ((a * a - 1) / 12 * F.sqrt(n - 1))
        return F.struct(*keep(x, "s", "e", "n"), ((low == 0) | (low == n)).alias("flat"), chi.alias("chi"), F.abs(runs).alias("runs"), F.abs(serial).alias("serial"))

    def combine(x: Column) -> Column:
        two_sided = lambda z: F.least(_log_tail(z) + math.log(2), F.lit(0.0))
        ps = (_log_tail(x["chi"]), F.when(x["flat"], (1 - x["n"]) * math.log(2)).otherwise(two_sided(x["runs"])), two_sided(x["serial"]))
        return F.struct(*keep(x, "s", "e", "n"), (-(ps[0] + ps[1] + ps[2])).alias("h"))

    def grade(x: Column) -> Column:
        # minus the decimal logarithm of the upper tail of chi-squared with 6 degrees, at 2 h
        b = F.floor((x["h"] - F.log(1 + x["h"] + x["h"] * x["h"] / 2)) / math.log(10) * BINS_A_DECADE).cast("int")
        band = F.when(x["n"] < 20, 3).otherwise(F.floor(F.log2(x["n"])).cast("int"))
        return F.struct(*keep(x, "s", "e"), band.alias("band"), F.greatest(F.least(b, F.lit(LAST_BIN)), F.lit(0)).alias("bin"))

    return reduce(F.transform, (measure, count, standardize, combine, grade), named)


def _cleared_from(df: DataFrame, text: Column, fdr: float) -> dict[int, int]:
    """For each length band, the first bin of p-values that Benjamini-Hochberg rejects, over the whole corpus.

    The p-values are rounded up to the edge of their bin, which is conservative. The table of counts has at most 32 x 401 rows.
    """
    bins = df.select(F.explode(_candidates(text)).alias("c")).groupBy("c.band", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[int, dict[int, int]] = {}
    for band, b, n in bins.collect():
        counts.setdefault(band, {})[b] = n
    out = {}
    for band, own in counts.items():
        total, rank, first = sum(own.values()), 0, LAST_BIN + 1
        for b in sorted(own, reverse=True):
            rank += own[b]
            if 10 ** (-b / BINS_A_DECADE) * total <= fdr * rank:
                first = b
        out[band] = first
    return out


def find_secrets(df: DataFrame, text_col: str = "text", fdr: float = 0.05, out: str = "secret_spans") -> DataFrame:
    """df with `out`: array of (s, k, e), the places of secrets in code points, sorted; k counts in KINDS.

    A null text has no spans, as an empty one; an empty df stays empty; repeated rows are scanned each by itself. A column of df named as `out` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cleared = _cleared_from(df, text, fdr)
    kind = lambda spans, k: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    assign = F.filter(_found(text, ASSIGN, 2), lambda x: F.length(x["t"]) >= 12)
    parts = [kind(assign, 0), kind(_found(text, ACCESS), 1), kind(_found(text, HEX), 2)]
    if cleared:
        first = F.create_map(*[F.lit(x) for pair in cleared.items() for x in pair])
        parts.append(kind(F.filter(_candidates(text), lambda c: c["bin"] < F.coalesce(first[c["band"]], F.lit(LAST_BIN + 1))), 3))
    return df.withColumn(out, F.array_sort(F.concat(*parts)))


def span_string(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", length_col: str | None = None, fdr: float = 0.05) -> DataFrame:
    """df with every secret span of the text replaced by `mark` (overlapping spans by one), and length_col, if given, set anew.

    Rows are never dropped; null, empty and clean texts stay as they are, and so do all other columns, whatever their names.
    """
    spans, text = "__spans_found", F.col(text_col)
    while spans in df.columns:
        spans += "_"
    found = find_secrets(df, text_col, fdr, spans)

    def masked(all_: Column) -> Column:
        ends = F.transform(all_, lambda x: x["e"])
        cut = lambda x, at: F.when(x["s"] < at, F.lit("")).otherwise(F.concat(F.substring(text, at + 1, F.greatest(x["s"] - at, F.lit(0))), F.lit(mark)))
        kept = F.zip_with(all_, _before(ends, lambda a, b: F.greatest(a, b)), cut)
        return F.concat(F.array_join(kept, ""), F.substring(text, F.array_max(ends) + 1, F.lit(2147483647)))

    clean = F.size(spans) == 0
    out = found.withColumn(text_col, F.when(clean, text).otherwise(_let(F.col(spans), masked)))
    if length_col:
        out = out.withColumn(length_col, F.when(clean, F.col(length_col)).otherwise(F.length(text_col).cast("long")))
    return out.select(*df.columns)
