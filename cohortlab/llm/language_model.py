"""Language-model scores: corpus unigram counts and a log-bilinear model trained by noise-contrastive estimation in numpy.

The model predicts the symbol of a token from those of the two before it. The end, and each of the most frequent tokens, is a symbol of its own; every other token belongs to
one of the tail symbols, by its hash. With context vectors r and target vectors q the score of a symbol is q(w).(c1*r(w1) + c2*r(w2)) + b(w), a sum of two tables, so
exp-tables E and F turn the normalisers of all contexts into one matrix product E F'. Tokens of a tail symbol share its probability by their smoothed counts, with
one share for a token never seen, so the probabilities of all tokens and of one unseen token a tail symbol sum to 1. The number of symbols grows with the distinct tokens seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textvec import ASCII_LOWER, NOT_SPACE, column, lists, parts, span_hashes, spans

END = np.uint64(0x5E17_E0D0_0E17_0001)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows, each row's end token last, and the n + 1 row offsets."""
    low = ASCII_LOWER[data]
    starts, ends, first = spans(low, offsets, NOT_SPACE)
    n = len(offsets) - 1
    out = np.full(len(starts) + n, END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))] = span_hashes(low, starts, ends)
    return out, first + np.arange(n + 1)


def in_training(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 != 1


def count_tokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, c): hash and count of every token. Each task counts its own tokens first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for _, _, data, offsets in parts(column(batch, text_col)):
                k, c = np.unique(tokens(data, offsets)[0], return_counts=True)
                keys, back = np.unique(np.concatenate((keys, k)), return_inverse=True)
                counts = np.bincount(back, np.concatenate((counts, c)), len(keys)).astype(np.int64)
                if len(keys) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["w", "c"])
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["w", "c"])

    return df.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def tail_symbol(w: np.ndarray, first: int, size: int) -> np.ndarray:
    """Symbol of a token that isn't frequent: one of first .. size - 1, by bits of its hash."""
    return first + ((w >> np.uint64(40)) % np.uint64(size - first)).astype(np.int64)


def symbols_for(distinct: int, most: int = 4096) -> int:
    """Number of symbols: a power of two near four times the square root of the number of distinct tokens, 64 at least. `most` bounds the table of normalisers, `most` squared floats."""
    return int(min(most, max(64, 1 << (round(np.log2(max(1, distinct)) / 2) + 2))))


@dataclass
class Known:
    """Tokens by falling count, as many as are broadcast: hashes in ascending order, counts and symbols. Symbols are 0 (the end), the frequent tokens, and from `tail` on the tail symbols."""

    keys: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    tail: int
    size: int

    def find(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: is it here, its count (else 0), its symbol."""
        if not len(self.keys):
            return np.zeros(len(w), bool), np.zeros(len(w), np.int64), np.where(w == END, 0, tail_symbol(w, self.tail, self.size))
        at = np.minimum(np.searchsorted(self.keys, w), len(self.keys) - 1)
        here = self.keys[at] == w
        return here, np.where(here, self.counts[at], 0), np.where(here, self.ids[at], np.where(w == END, 0, tail_symbol(w, self.tail, self.size)))


    def frequent(self) -> Symbols:
        own = np.flatnonzero(self.ids < self.tail)
        return Symbols(self.keys[own], self.ids[own], self.tail, self.size)


@dataclass
class Symbols:
    """The frequent tokens and the end alone, which is all that a token's symbol needs: hashes in ascending order, and symbols."""

    keys: np.ndarray
    ids: np.ndarray
    tail: int
    size: int

    def of(self, w: np.ndarray) -> np.ndarray:
        out = np.where(w == END, 0, tail_symbol(w, self.tail, self.size))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, w), len(self.keys) - 1)
            out = np.where(self.keys[at] == w, self.ids[at], out)
        return out


@dataclass
class LogBilinear:
    r: np.ndarray
    q: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    b: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.c1, self.c2, self.b)])

    @staticmethod
    def of(flat: np.ndarray, size: int, dim: int) -> LogBilinear:
        r, q, c1, c2, b = np.split(np.asarray(flat, np.float32).copy(), np.cumsum([size * dim, size * dim, dim, dim]))
        return LogBilinear(r.reshape(size, dim), q.reshape(size, dim), c1, c2, b)

    @staticmethod
    def start(p: np.ndarray, dim: int, seed: int = 0) -> LogBilinear:
        rng = np.random.default_rng(seed)
        draw = lambda: rng.normal(0, 0.1, (len(p), dim)).astype(np.float32)
        return LogBilinear(draw(), draw(), np.ones(dim, np.float32), np.ones(dim, np.float32), np.log(p).astype(np.float32))

    def normalisers(self, block: int = 256) -> np.ndarray:
        """Logarithm of the sum over all symbols of each context (w1, w2), by blocks of w1."""
        two = (self.r * self.c2) @ self.q.T + self.b
        top2 = two.max(1)
        two = np.exp(two - top2[:, None]).T
        out = np.empty((len(self.r), len(self.r)), np.float32)
        for a in range(0, len(out), block):
            one = (self.r[a : a + block] * self.c1) @ self.q.T
            top1 = one.max(1, keepdims=True)
            out[a : a + block] = np.log(np.exp(one - top1) @ two) + top1 + top2
        return out

    def log_p(self, w: np.ndarray, w1: np.ndarray, w2: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Natural logarithm of each symbol's probability in its context."""
        out, one, two = np.empty(len(w)), self.r * self.c1, self.r * self.c2
        for a in range(0, len(w), 1 << 14):
            x, u, v = (i[a : a + (1 << 14)] for i in (w, w1, w2))
            out[a : a + len(x)] = np.einsum("ij,ij->i", one[u] + two[v], self.q[x]) + self.b[x] - norm[u, v]
        return out

    def train(self, ids: np.ndarray, rows: np.ndarray, noise: np.ndarray, squares: LogBilinear, rng: np.random.Generator, rate: float = 0.1, batch: int = 2048, k: int = 128) -> None:
        """One pass of AdaGrad on the noise-contrastive loss over rows of tokens; k noise tokens are shared by a batch."""
        w1, w2 = contexts(ids, rows, self.size_end)
        cumulative, log_kq = np.cumsum(noise), np.log(k * noise).astype(np.float32)
        for a in range(0, len(ids), batch):
            w, u, v = ids[a : a + batch], w1[a : a + batch], w2[a : a + batch]
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(k)), len(noise) - 1)
            ru, rv, qw, qn = self.r[u], self.r[v], self.q[w], self.q[drawn]
            h = ru * self.c1 + rv * self.c2
            up = 1 - _sigmoid(np.einsum("ij,ij->i", h, qw) + (self.b[w] - log_kq[w]))
            down = _sigmoid(h @ qn.T + (self.b[drawn] - log_kq[drawn]))
            gh = up[:, None] * qw - down @ qn
            self._step("q", squares, [w, drawn], [up[:, None] * h, -(down.T @ h)], rate)
            self._step("r", squares, [u, v], [gh * self.c1, gh * self.c2], rate)
            self._step("b", squares, [w, drawn], [up, -down.sum(0)], rate)
            for name, g in (("c1", (gh * ru).sum(0)), ("c2", (gh * rv).sum(0))):
                s = getattr(squares, name)
                s += (g / len(w)) ** 2
                getattr(self, name)[:] += rate * 0.1 * g / len(w) / np.sqrt(s)

    size_end = 0  # number of the end token

    def _step(self, name: str, squares: LogBilinear, where: list[np.ndarray], gradients: list[np.ndarray], rate: float) -> None:
        value, square, at, g = getattr(self, name), getattr(squares, name), np.concatenate(where), np.concatenate(gradients)
        if g.ndim == 1:
            total = np.bincount(at, g, len(value)).astype(np.float32)
        else:
            n, d = value.shape
            total = np.bincount((at[:, None] * d + np.arange(d)).ravel(), g.ravel(), n * d).reshape(n, d).astype(np.float32)
        square += total**2
        total *= rate
        value += np.divide(total, np.sqrt(square), out=total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, of float32."""
    np.negative(np.clip(x, -30, 30, out=x), out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def contexts(ids: np.ndarray, rows: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each, and the one before that; the end token stands before a row."""
    one, two = np.full(len(ids), end), np.full(len(ids), end)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    first = rows[:-1][rows[1:] > rows[:-1]]
    one[first] = two[first] = end
    two[(first + 1)[first + 1 < len(ids)]] = end
    return one, two


def _known(counts: DataFrame, most_known: int, size: int) -> Known:
    """All tokens from a count on that at most most_known tokens reach. The counts of counts that give it, in bins of an eighth of an octave, are a few hundred rows."""
    bins = F.floor(F.log2("c") * 8).cast("int")
    reach, least = 0, None
    for b, n in sorted(map(tuple, counts.groupBy(bins.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        reach += n
        if reach > most_known:
            break
        least = b
    top = counts.where(F.lit(False) if least is None else bins >= least).select("w", "c").toArrow()  # at most most_known rows
    w, c = top.column("w").to_numpy().view(np.uint64), top.column("c").to_numpy()
    width, order = size // 4, np.lexsort((w, -c))
    chosen = order[w[order] != END][: size - width - 1]
    tail = 1 + len(chosen)
    ids, size = tail_symbol(w, tail, tail + width), tail + width
    ids[chosen] = np.arange(1, len(chosen) + 1)
    ids[w == END] = 0
    by = np.argsort(w)
    return Known(w[by], c[by], ids[by], tail, size)


def symbol_masses(counts: DataFrame, known: Known) -> np.ndarray:
    """Smoothed count of each symbol: of its tokens (c + 0.5 each), and of one unseen token a tail symbol. At most one row a tail symbol reaches the driver."""
    mass = np.zeros(known.size)
    own = (known.ids < known.tail) & (known.ids > 0)
    mass[known.ids[own]] = known.counts[own] + 0.5
    width, ends = known.size - known.tail, counts.where(F.col("w") == int(END.astype(np.int64))).first()
    symbol = F.pmod(F.shiftrightunsigned("w", 40), F.lit(width).cast("long"))
    for b, x in counts.groupBy(symbol.alias("b")).agg(F.sum(F.col("c") + 0.5).alias("x")).collect():
        mass[known.tail + b] = x
    # frequent tokens and the end have symbols of their own
    np.subtract.at(mass, tail_symbol(known.keys[own], known.tail, known.size), known.counts[own] + 0.5)
    if ends:
        mass[tail_symbol(np.array([END]), known.tail, known.size)] -= ends["c"] + 0.5
    mass[0] = (ends["c"] if ends else 0) + 0.5
    mass[known.tail :] = np.maximum(mass[known.tail :], 0.0) + 0.5
    return mass


BLOCK = 4096  # parameters a row


def _mean(blocks: DataFrame, groups: int = 64) -> np.ndarray:
    """Means of the tasks' parameters by tokens seen, from rows (block, task, n, x) of sums: first of the tasks of a group, then of the groups."""

    def add(table: pa.Table) -> pa.Table:
        x = table.column("x").combine_chunks()
        total = x.flatten().to_numpy().reshape(len(x), -1).sum(0)
        n = table.column("n").to_numpy().sum()
        return pa.table({"block": table.column("block").slice(0, 1), "task": table.column("task").slice(0, 1), "n": [n], "x": lists(total, np.array([0, len(total)]))})

    schema = "block int, task int, n double, x array<double>"
    once = blocks.withColumn("group", F.pmod("task", F.lit(groups))).groupBy("block", "group").applyInArrow(add, schema)
    got = once.groupBy("block").applyInArrow(add, schema).collect()  # the parameters once
    return np.concatenate([np.array(r["x"]) / r["n"] for r in sorted(got, key=lambda r: r["block"])]) if got else np.empty(0)


def train_model(df: DataFrame, known: Known, mass: np.ndarray, dim: int = 16, rounds: int = 2, rate: float = 0.1, text_col: str = "text") -> LogBilinear:
    """Fit on all of df in synchronised rounds: every task trains over its own texts from the common parameters, which Spark then averages by tokens seen; the rate halves.

    More text means more steps a task or more tasks, in every round. The parameters depend on how df is cut into tasks, in the way of local SGD; the scores' base does not.
    """
    size = known.size
    noise = mass / mass.sum()
    model = LogBilinear.start(noise, dim)
    context = df.sparkSession.sparkContext
    for turn in range(rounds):
        sent = context.broadcast((known.frequent(), model.flat(), noise))

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            table, flat, p = sent.value
            own, squares = LogBilinear.of(flat, size, dim), LogBilinear.of(np.full(len(flat), 1.0), size, dim)
            seen, rng, task = 0, None, 0
            for batch in batches:
                if rng is None and len(batch):
                    task = column(batch, "__task")[0].as_py()
                    rng = np.random.default_rng([turn, task])
                for _, _, data, offsets in parts(column(batch, text_col)):
                    w, rows = tokens(data, offsets)
                    own.train(table.of(w), rows, p, squares, rng, rate * 0.5**turn)
                    seen += len(w)
            if seen:
                x = own.flat().astype(np.float64) * seen
                at = np.append(np.arange(0, len(x), BLOCK), len(x))
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, task, np.int32)), pa.array(np.full(n, float(seen))), lists(x, at)], ["block", "task", "n", "x"])

        texts = df.select(F.col(text_col).cast("string").alias(text_col), F.spark_partition_id().alias("__task"))
        flat = _mean(texts.mapInArrow(run, "block int, task int, n double, x array<double>"))
        if len(flat):
            model = LogBilinear.of(flat, size, dim)
    return model


_norms: dict[str, np.ndarray] = {}


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_symbols: int = 4096, dim: int = 16, most_known: int = 1 << 19, rounds: int = 2) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities.

    Counts and training cover all rows with crc32(id) mod 5 other than 1 (a null id counts as an empty text there). Null texts count as empty: one end
    token. Tokens are told apart by 64-bit hashes. Counts of up to most_known tokens are broadcast (13 MB); rarer tokens of each text are looked up by a join with all counts.
    Rows of equal ids are scored each by itself; an empty df gives an empty result. Columns other than the id and the text are not read.
    """
    train = df.where(in_training(F.col(id_col)))
    counts = materialize(count_tokens(train, text_col), "counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"]
    known = _known(counts, most_known, symbols_for(distinct, most_symbols))
    mass = symbol_masses(counts, known)
    model = train_model(train, known, mass, dim, rounds, text_col=text_col)
    sent = df.sparkSession.sparkContext.broadcast((known, model.flat(), np.log10(mass)))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, flat, log_mass = sent.value
        own = LogBilinear.of(flat, table.size, dim)
        if key not in _norms:  # once for each Python worker
            _norms.clear()
            _norms[key] = own.normalisers()
        for batch in batches:
            for i, j, data, offsets in parts(column(batch, text_col)):
                w, rows = tokens(data, offsets)
                here, c, ids = table.find(w)
                row = np.repeat(np.arange(j - i), np.diff(rows))
                log_c = np.where(here, np.log10(c + 0.5), 0.0)
                symbol = own.log_p(ids, *contexts(ids, rows, 0), _norms[key]) / np.log(10)
                within = np.where(ids >= table.tail, log_c - log_mass[ids], 0.0)  # the share of its symbol, but for the count of a rare token
                add = lambda x: pa.array(np.bincount(row, x, j - i).astype(np.float64))  # noqa: B023, E731
                rare = ~here
                pair, n = np.unique(np.stack([row[rare].astype(np.uint64), w[rare]], 1), axis=0, return_counts=True) if rare.any() else (np.empty((0, 2), np.uint64), np.empty(0, np.int64))
                off = np.searchsorted(pair[:, 0], np.arange(j - i + 1).astype(np.uint64))
                ids_ = column(batch, id_col).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([ids_, pa.array(np.diff(rows)), pa.array(np.bincount(row, here, j - i).astype(np.int64)), add(log_c), add(symbol + within), lists(np.ascontiguousarray(pair[:, 1]).view(np.int64), off), lists(n, off)], [id_col, "n_tokens", "known", "base", "model", "rare", "times"])

    schema = f"`{id_col}` long, n_tokens long, known long, base double, model double, rare array<long>, times array<long>"
    scored = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("w"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "w", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"))
    rest, more = F.coalesce("rest", F.lit(0.0)), F.coalesce("more", F.lit(0))
    below = float(np.log10(total + 0.5 * (distinct + 1)))
    return scored.drop("rare", "times").join(rare, "row", "left").select(
        id_col, (~in_training(F.col(id_col))).alias("held_out"), "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * below).alias("base_score"), (F.col("model") + rest).alias("score"),
    )
