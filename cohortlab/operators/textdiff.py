"""Text audit: what changed between two versions of documents, by sentences, terms, numbers and protected items."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import staged

#: Environments kept word for word, environments that hold no sentences, patterns of protected items, and terms that state how strongly something is claimed (fixed values).
ENVIRONMENTS = ["table*", "table", "figure*", "figure", "equation*", "equation", "align*", "align", "quote"]
NO_SENTENCES = ["table", "table*", "figure", "figure*", "equation", "equation*", "align", "align*"]
PATTERNS = {
    "numbers": r"\d[\d,]*\.?\d*%?|\.\d+",
    "references": r"\\(?:cite|citeA|ref|eqref|label|input|includegraphics)(?:\[[^\]]*\])?\{[^}]*\}",
    "math": r"\$[^$]*\$",
    "environments": r"\\begin\{([^}]*)\}",
    "headings": r"\\(?:chapter|section|subsection|paragraph)\*?\{[^}]*\}",
    "footnotes": r"\\footnote\{[^}]*\}",
    "dashes": r"(?<!-)-{2,3}(?!-)",
    "quotes": "``|''|\"",
}
CLAIM_NUMBER = r"\d[\d,]*\.?\d*%?"
TERMS = [
    "weak", "weakly", "small", "specification-dependent", "robust", "significan", "associat", "conditional", "exploratory", "pre-specified",
    "fragile", "absent", "largely", "mostly", "partly", "only", "at most", "at least", "no ", "not ", "never", "cannot", "may ", "might", "could",
    "suggest", "indicat", "consistent with", "appears", "seems", "likely", "possible", "tentative", "about", "approximately", "roughly",
    "clearly", "strongly", "substantial", "considerable", "important", "demonstrat", "prove", "show", "find", "found", "evidence",
    "favourable", "typical", "noisy", "noise", "attenuat", "caveat", "limitation", "unreliable", "stable", "volatile", "persist",
]
#: White space, in a form that both Java and RE2 read: ASCII controls, and the spaces and line ends of Unicode.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once."""
    return F.transform(F.array(x), body)[0]


def strip_comments(text: Column) -> Column:
    """Text without `%` comments (an escaped `%` starts none)."""
    return F.when(text.contains("%"), F.regexp_replace(text, r"(?<!\\)%[^\n]*", "")).otherwise(text)


def strip_environments(text: Column, names: list[str] = NO_SENTENCES) -> Column:
    """Text with a space in place of each of the environments, up to the first end of the same name."""
    body = "|".join(n.replace("*", r"\*") for n in names)
    return F.when(text.contains("\\begin{"), F.regexp_replace(text, rf"(?s)\\begin\{{({body})\}}.*?\\end\{{\1\}}", " ")).otherwise(text)


def clean(text: Column) -> Column:
    """Text without comments and without environments that hold no sentences."""
    return strip_environments(strip_comments(text))


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def sentences(text: Column, shortest: int = 26) -> Column:
    """Sentences of a cleaned text of at least `shortest` characters, with single spaces.

    A sentence ends at `.`, `!` or `?` before white space that a capital A to Z, a backslash or a dollar sign follows. A null text has none (null).
    """
    parts = F.split(single_spaces(_let(strip_comments(text), lambda t: strip_environments(t))), r"(?<=[.!?]) (?=[A-Z\\$])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: F.length(s) >= shortest)


def occurrences(low: Column, term: Column) -> Column:
    """Number of non-overlapping occurrences of a literal in a text of lower case."""
    return ((F.length(low) - F.length(F.replace(low, term, F.lit("")))) / F.length(term)).cast("long")


def term_counts(docs: DataFrame, ident: str, text: str, lexicon: list[str] = TERMS) -> DataFrame:
    """(ident, term, n) of every term in the sentences of every text, whatever the case, zeros left out. The lexicon is a literal, so nothing is joined and only counts leave a row."""
    terms = F.array(*[F.lit(t) for t in dict.fromkeys(lexicon)])
    said = F.lower(F.array_join(sentences(F.col(text)), " "))
    found = _let(said, lambda low: F.filter(F.transform(terms, lambda t: F.struct(t.alias("term"), occurrences(low, t).alias("n"))), lambda x: x["n"] > 0))
    return docs.select(ident, F.explode(found).alias("x")).select(ident, "x.term", "x.n")


def count_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, before, after) where the counts `n` of a key differ; a missing key counts 0."""
    a, b = before.withColumnRenamed("n", "before"), after.withColumnRenamed("n", "after")
    return a.join(b, key, "full").na.fill(0, ["before", "after"]).where("before <> after")


def claim_changes(pairs: DataFrame, before: str = "before", after: str = "after", lexicon: list[str] = TERMS) -> DataFrame:
    """The rows of `changed_sentences` to read: deleted and added sentences, and changed ones in which a term or a number appears or disappears."""
    terms = F.array(*[F.lit(t) for t in dict.fromkeys(lexicon)])
    counts = lambda c: _let(F.lower(c), lambda low: F.transform(terms, lambda t: occurrences(low, t)))
    numbers = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(CLAIM_NUMBER), F.lit(0)))
    a, b = F.col(before), F.col(after)
    return pairs.where(a.isNull() | b.isNull() | (counts(a) != counts(b)) | (numbers(a) != numbers(b)))


def extract_items(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, category, item) of all protected items, repeats included; spaces within an item are single. Blocks of one environment may lie within those of another."""
    stripped = strip_comments(F.coalesce(F.col(text), F.lit("")))
    plain = lambda t: F.regexp_replace(t, r"\\[a-zA-Z]+\*?(\[[^\]]*\])?\{[^}]*\}", " ")
    every = lambda t, p, group=0: F.regexp_extract_all(t, F.lit(p), F.lit(group))

    def found(t: Column) -> Column:
        environments = [n.replace("*", r"\*") for n in ENVIRONMENTS]
        none = F.array().cast("array<string>")
        blocks = F.when(t.contains("\\begin{"), F.concat(*[every(t, rf"(?s)\\begin\{{{n}\}}.*?\\end\{{{n}\}}") for n in environments])).otherwise(none)
        blocks = F.concat(blocks, every(t, r"(?s)\\\[.*?\\\]"))
        parts = {"blocks": blocks} | {k: every(plain(t) if k == "numbers" else t, p, int(k == "environments")) for k, p in PATTERNS.items()}
        named = lambda k: lambda x: F.struct(F.lit(k).alias("category"), x.alias("item"))
        return F.concat(*[F.transform(v, named(k)) for k, v in parts.items()])

    rows = docs.select(ident, F.explode(_let(stripped, found)).alias("x"))
    return rows.select(ident, "x.category", F.trim(single_spaces(F.col("x.item"))).alias("item"))


def multiset_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, removed, added): how many of each item one side has beyond the other. Counts are pre-aggregated, so repeats aren't shuffled."""
    count = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    both = count(before, "a").join(count(after, "b"), key, "full").na.fill(0, ["a", "b"]).where("a <> b")
    return both.select(*key, F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("removed"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added"))


def verdicts(changes: DataFrame, documents: DataFrame, ident: str) -> DataFrame:
    """(ident, removed, added, verdict): OK without changes, else CHECK."""
    total = changes.groupBy(ident).agg(F.sum("removed").alias("removed"), F.sum("added").alias("added"))
    out = documents.select(ident).distinct().join(total, ident, "left").na.fill(0, ["removed", "added"])
    return out.withColumn("verdict", F.when(F.col("removed") + F.col("added") == 0, "OK").otherwise("CHECK"))


def _letters(texts: list[str]) -> np.ndarray:
    """Counts of characters, by code modulo 128, of each text."""
    out = np.zeros((len(texts), 128), np.int32)
    for i, x in enumerate(texts):
        out[i] = np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) & 127, minlength=128)
    return out


def _bounds(text: str, letters: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Upper bounds of the ratio of a text to others: characters in common, whatever their order, against all."""
    out = np.empty(len(others))
    for i in range(0, len(others), 1 << 14):
        out[i : i + (1 << 14)] = np.minimum(others[i : i + (1 << 14)], letters).sum(1)
    return 2.0 * out / (sizes + len(text))


def match_sentences(old: list[str], new: list[str], least: float = 0.45) -> list[tuple[str | None, str | None, str]]:
    """(before, after, kind) of the sentences of one document, the old ones in order, each with its closest free new one (the last in order on ties).

    The pairs are those of `difflib.get_close_matches` over all free sentences. Candidates come by falling upper bound of their ratio, and the search
    ends where no later one can win, so that few ratios are computed even of thousands of sentences.
    """
    old, new = sorted(old), sorted(new)
    a, b = _letters(old), _letters(new)
    a_size, b_size = (np.array([len(x) for x in side], np.int64) for side in (old, new))
    free, out = np.ones(len(new), bool), []
    matcher = difflib.SequenceMatcher()
    for i, s in enumerate(old):
        matcher.set_seq2(s)
        bound = np.where(free, _bounds(s, a[i], b, b_size), -1.0)
        best, at = least, -1
        for j in np.argsort(-bound, kind="stable").tolist():
            if bound[j] < best:
                break
            matcher.set_seq1(new[j])
            if matcher.quick_ratio() < best:
                continue
            ratio = matcher.ratio()
            if ratio > best or (ratio == best and j > at):
                best, at = ratio, j
        if at >= 0:
            free[at] = False
        out.append((s, new[at] if at >= 0 else None, "changed" if at >= 0 else "deleted"))
    for j in np.flatnonzero(free).tolist():
        bound = _bounds(new[j], b[j], a, a_size)
        near = (difflib.SequenceMatcher(None, new[j], old[i]).ratio() > least for i in np.argsort(-bound, kind="stable").tolist() if bound[i] > least)
        if not any(near):
            out.append((None, new[j], "added"))
    return out


def changed_sentences(before: DataFrame, after: DataFrame, ident: str, sentence: str, least: float = 0.45) -> DataFrame:
    """(ident, before, after, kind) of sentences that only one version has: `changed` pairs, matched one to one and closest first in order, `deleted`, `added`.

    Sentences of both versions fall away by anti-joins; what is left of one document is matched in one task.
    """
    only = lambda a, b: a.select(ident, F.col(sentence)).distinct().join(b.select(ident, F.col(sentence)).distinct(), [ident, sentence], "left_anti")
    left, right = only(before, after).withColumn("side", F.lit(0)), only(after, before).withColumn("side", F.lit(1))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[ident].iloc[0]
        out = [(key, *x) for x in match_sentences(*(pdf.loc[pdf["side"] == s, sentence].tolist() for s in (0, 1)), least)]
        return pd.DataFrame(out, columns=[ident, "before", "after", "kind"])

    kind = dict(before.dtypes)[ident]
    return left.unionByName(right).groupBy(ident).applyInPandas(match, f"`{ident}` {kind}, before string, after string, kind string")


def changed_within(docs: DataFrame, ident: str, before: str, after: str, least: float = 0.45) -> DataFrame:
    """`changed_sentences` of two versions that stand in one row, as arrays of sentences. Only rows whose ident is null or repeated are shuffled."""
    docs = docs.select(ident, *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in (before, after)])
    repeated = staged(docs.groupBy(ident).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(ident), "repeated idents")
    single = docs.where(F.col(ident).isNotNull()).join(repeated, ident, "left_anti")
    several = docs.where(F.col(ident).isNull()).unionByName(docs.join(repeated, ident, "left_semi"))
    side = lambda c: several.select(ident, F.explode(c).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 256):
                keys, old, new = (whole.column(i).slice(a, 256) for i in range(3))
                found = [match_sentences(x or [], y or [], least) for x, y in zip(old.to_pylist(), new.to_pylist())]
                which = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in found]))
                flat = [x for own in found for x in own]
                yield pa.RecordBatch.from_arrays([keys.take(which), *(pa.array([x[i] for x in flat], pa.string()) for i in range(3))], [ident, "before", "after", "kind"])

    kind = dict(docs.dtypes)[ident]
    only = single.select(ident, F.array_except(before, after).alias("a"), F.array_except(after, before).alias("b")).where("size(a) > 0 or size(b) > 0")
    return only.mapInArrow(run, f"`{ident}` {kind}, before string, after string, kind string").unionByName(changed_sentences(side(before), side(after), ident, "s", least))
