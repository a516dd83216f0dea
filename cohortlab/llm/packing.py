"""Best-fit-decreasing packing of tokenised documents into sequences, with a segment tree over the remaining capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .textvec import column, parts
from .tokens import Encoder, with_end


class BestFit:
    """Open bins by remaining capacity, in runs (first bin, bins, tokens used) of bins that hold as much.

    `tree` holds, for each node over the capacities, whether an open bin lies below it.
    """

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.open: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def _set(self, room: int, on: int) -> None:
        k = room + self.size
        self.tree[k] = on
        while k > 1:
            k >>= 1
            if self.tree[k] == (now := self.tree[2 * k] | self.tree[2 * k + 1]):
                break
            self.tree[k] = now

    def _tightest(self, need: int) -> int:
        """The least capacity of an open bin that is at least `need`, or -1; in logarithmic time."""
        k = need + self.size
        if self.tree[k]:
            return need
        while k > 1:  # up to the first right neighbour that holds one, then down its left edge
            if not k & 1 and self.tree[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1

    def _push(self, room: int, first: int, bins: int, used: int) -> None:
        if room and bins:
            if not self.open[room]:
                self._set(room, 1)
            self.open[room].append((first, bins, used))

    def put(self, length: int, count: int) -> list[tuple[int, int, int, int]]:
        """Places of `count` items of one length, as best fit gives them one by one: (items, first bin, items a bin, offset in the first) of each run.

        The tightest bin stays the tightest while another item fits, so it takes all it can, and then the other bins of its run do.
        """
        out = []
        while count:
            room = self._tightest(length)
            if room < 0:
                room, new = self.capacity, -(-count // (self.capacity // length))
                first, bins, used = self.bins, new, 0
                self.bins += new
            else:
                first, bins, used = self.open[room].pop()
                if not self.open[room]:
                    self._set(room, 0)
            each = room // length
            full = min(bins, count // each)
            out.append((full * each, first, each, used))
            self._push(room - each * length, first, full, used + each * length)
            first, bins, count = first + full, bins - full, count - full * each
            if bins and count:  # the last items, in one more bin
                out.append((count, first, each, used))
                self._push(room - count * length, first, 1, used + count * length)
                first, bins, count = first + 1, bins - 1, 0
            self._push(room, first, bins, used)
        return [x for x in out if x[0]]


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, items, first bin, items a bin, offset) of best-fit-decreasing packing, from the number of items of each length."""
    fit, out = BestFit(capacity), []
    for length in sorted(counts, reverse=True):
        rank = 0
        for items, first, each, offset in fit.put(length, counts[length]):
            out.append((length, rank, items, first, each, offset))
            rank += items
    return out


class _Ranks:
    """Numbers the pieces of each length that a task meets, from 0 on."""

    def __init__(self, capacity: int):
        self.seen = np.zeros(capacity + 1, np.int64)

    def of(self, length: np.ndarray) -> np.ndarray:
        count = np.bincount(length, minlength=len(self.seen))
        place = np.empty(len(length), np.int64)
        place[np.argsort(length, kind="stable")] = np.arange(len(length)) - np.repeat(np.cumsum(count) - count, count)
        out = place + self.seen[length]
        self.seen += count
        return out


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ranked: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): each text's ids and an end id, cut into pieces of `capacity` if longer.

    The first piece takes what is over; all others are full. A null text counts as empty, and has a piece with the end id alone. ranked: add what `pack` needs to know, each
    piece's task and its rank there among those of its length, which saves it a pass through Python.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ranks = Encoder.of(tokenizer, False), _Ranks(capacity)
        for batch in batches:
            for i, j, data, offsets in parts(column(batch, text_col)):
                ids, off = with_end(*encoder.encode(data, offsets), end_id)
                n = np.diff(off)
                count = -(-n // capacity)
                row = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                over = n - (count - 1) * capacity
                start = np.where(piece == 0, 0, over[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, over[row], capacity)
                raw, begin = ids.astype("<u4"), off[:-1][row] + start
                crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(begin.tolist(), length.tolist())]
                which = pa.array(row)
                more = [column(batch, "__shard").slice(i, j - i).take(which), pa.array(ranks.of(length))] if ranked else []
                yield pa.RecordBatch.from_arrays([column(batch, id_col).slice(i, j - i).take(which), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), *more], names)

    names = [id_col, "piece", "start", "length", "ids_crc32", *(["__shard", "__rank"] if ranked else [])]
    source = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col), *([F.spark_partition_id().alias("__shard")] if ranked else []))
    return source.mapInArrow(cut, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long" + (", __shard int, __rank long" if ranked else ""))


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset, packed by best-fit decreasing over all of them.

    Best fit needs only the number of pieces of each length, at most `capacity` numbers, which reach the driver. Its runs of places, a few for each length, are
    broadcast, and a piece takes the place of its rank among those of its length: its rank within its task, plus the pieces of that length in the tasks before.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "__shard", "__rank")]
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.select(*kept).dtypes) + ", __shard int, __rank long"

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _Ranks(capacity)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in kept), column(batch, "__shard"), pa.array(ranks.of(column(batch, "length").to_numpy()))], [*kept, "__shard", "__rank"])

    if "__rank" not in pieces.columns:
        pieces = pieces.select(*kept).withColumn("__shard", F.spark_partition_id()).mapInArrow(rank, schema)
    ranked = materialize(pieces, "pieces")
    counts = ranked.groupBy("length", "__shard").agg(F.count(F.lit(1)).alias("__n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    base = counts.select("length", "__shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    runs = pieces.sparkSession.createDataFrame(best_fit_runs(total, capacity), "length long, __first long, __items long, __bin long, __each long, __offset long")
    at = F.col("__rank") + F.col("__base") - F.col("__first")
    placed = ranked.join(base, ["length", "__shard"]).join(F.broadcast(runs), "length").where((at >= 0) & (at < F.col("__items")))
    return placed.select(*kept, (F.col("__bin") + F.floor(at / F.col("__each"))).alias("sequence_id"), (F.col("__offset") + at % F.col("__each") * F.col("length")).alias("offset"))


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `capacity` tokens.

    Rows of equal or null ids are packed each by itself; a null or empty text is one piece of the end id alone. An empty df gives none. Columns other than the id and the text are not read.
    """
    return pack(token_pieces(df, tokenizer, capacity, end_id, id_col, text_col, ranked=True), capacity)
