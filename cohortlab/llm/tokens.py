"""Token ids of whole texts, by encoding each distinct chunk once, and their Parquet files with ordered, selective reads.

A chunk ends where the pre-tokeniser always splits, so the ids of a text are those of its chunks, one after the other: for the word
tokenizer at any white space, which it drops; for the byte-level one before a single white-space character between two others; and for
both between an ASCII letter and a punctuation mark.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path
from .textvec import SPACE, column, gather, lists, parts, same_bytes, span_hashes

_ODD_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~")] = True  # not ', which contractions hold, nor |, which stands in the names of special tokens
_encoders: dict[tuple[str, bool], Encoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts by the tokenizers library; the chunks seen are kept, up to `most` of them.

    Chunks are found by a 64-bit hash, and their bytes are compared at every hit: a chunk whose hash another one holds is encoded by itself.
    """

    def __init__(self, path: str, words: bool, most: int = 700_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.most = Tokenizer.from_file(path), words, most
        special = sorted(self.tokenizer.get_added_tokens_decoder().items())
        self.between_id, self.between = (special[-1][0], special[-1][1].content) if special and special[-1][1].content.startswith("<|") else (-1, "")
        self._clear()

    @classmethod
    def of(cls, path: str, words: bool) -> Encoder:
        """One for each Python worker, which keeps its chunks from task to task."""
        if (path, words) not in _encoders:
            _encoders[path, words] = cls(path, words)
        return _encoders[path, words]

    def _clear(self) -> None:
        self.keys, self.at, self.n, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(1 << 16, np.int32)
        self.text, self.text_at, self.text_n = np.empty(1 << 16, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
        self.used = self.text_used = 0

    def _append(self, ids: np.ndarray, text: np.ndarray) -> None:
        grown = lambda held, used, new: held if used + len(new) <= len(held) else np.concatenate((held[:used], np.empty(used + len(new), held.dtype)))
        self.flat, self.text = grown(self.flat, self.used, ids), grown(self.text, self.text_used, text)
        self.flat[self.used : self.used + len(ids)] = ids
        self.text[self.text_used : self.text_used + len(text)] = text
        self.used, self.text_used = self.used + len(ids), self.text_used + len(text)

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        space = SPACE[data]
        full = offsets[1:] > offsets[:-1]
        cut = np.zeros(len(data), bool)
        if self.words:
            cut[1:] = ~space[1:] & space[:-1]
        else:
            cut[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:]
            cut[offsets[1:][full] - 1] = False  # the last character of a row has no neighbour there
        cut[1:] |= MARK[data[1:]] & LETTER[data[:-1]]
        if not self.words and _ODD_SPACE.search(data.tobytes()):  # such rows stay whole
            for i in range(len(offsets) - 1):
                if _ODD_SPACE.search(data[offsets[i] : offsets[i + 1]].tobytes()):
                    cut[offsets[i] : offsets[i + 1]] = False
        cut[offsets[:-1][full]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        if self.words:  # without the white space at a chunk's end, which gives no id
            last = np.where(space, 0, np.arange(1, len(data) + 1))
            ends = np.maximum(starts, np.maximum.accumulate(last)[ends - 1]) if len(starts) else ends
        return starts, ends, np.searchsorted(starts, offsets)

    def _encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has.

        Many short texts are encoded as one, with a special token between them, at which the library always splits; those that could hold a special token are encoded by themselves.
        """
        own = [i for i, x in enumerate(texts) if "<|" in x] if self.between else range(len(texts))
        alone = {i: e.ids for i, e in zip(own, self.tokenizer.encode_batch_fast([texts[i] for i in own], add_special_tokens=False))}
        rest = [x for i, x in enumerate(texts) if i not in alone] if alone else texts
        groups = [self.between.join([*rest[a : a + 256], ""]) for a in range(0, len(rest), 256)] if self.between else []
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)), np.int32) if groups else np.empty(0, np.int32)
        cut = np.flatnonzero(flat == self.between_id)
        n = np.diff(cut, prepend=-1) - 1
        flat = np.delete(flat, cut)
        if alone:
            every = np.zeros(len(texts), np.int64)
            every[[i for i in range(len(texts)) if i not in alone]] = n
            ids = np.split(flat, np.cumsum(n)[:-1]) if len(n) else []
            it = iter(ids)
            flat = np.concatenate([np.array(alone[i], np.int32) if i in alone else next(it) for i in range(len(texts))])
            for i, x in alone.items():
                every[i] = len(x)
            n = every
        return flat, n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and their n + 1 places."""
        starts, ends, first = self.chunks(data, offsets)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        keys, one, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most or self.used > 8 * self.most or self.text_used > 16 * self.most:
            self._clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
        raw = b"" if known.all() else data.tobytes()
        if not known.all():
            new = np.flatnonzero(~known)
            begin, size = starts[one[new]], ends[one[new]] - starts[one[new]]
            flat, n = self._encode_texts([raw[s : s + k].decode("utf-8", "replace") for s, k in zip(begin.tolist(), size.tolist())])
            at, text_at = self.used + np.cumsum(n) - n, self.text_used + np.cumsum(size) - size
            self._append(flat, gather(data, begin, size))
            into = place[new]  # in ascending order, as the new keys
            for name, x in (("keys", keys[new]), ("at", at), ("n", n), ("text_at", text_at), ("text_n", size)):
                setattr(self, name, np.insert(getattr(self, name), into, x))
            place = np.searchsorted(self.keys, keys)
        which = place[back]
        at, lengths, size = self.at[which], self.n[which], ends - starts
        same = size == self.text_n[which]
        same[same] = same_bytes(data, starts[same], self.text[: self.text_used], self.text_at[which[same]], size[same])
        held = self.flat
        if not same.all():
            other = np.flatnonzero(~same)
            raw = raw or data.tobytes()
            flat, n = self._encode_texts([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[other].tolist(), ends[other].tolist())])
            at[other], lengths[other] = self.used + np.cumsum(n) - n, n
            held = np.concatenate((self.flat[: self.used], flat))
        return gather(held, at, lengths), np.concatenate(([0], np.cumsum(lengths)))[first]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """An end id after the ids of each row."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)


def write_token_table(df: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = 64 << 20, page_rows: int = 2000) -> None:
    """Write the ids of every text to Parquet under `path`, in ascending order of id_col over all files.

    Rows are (id, shard, local_start, n_tokens, ids): shard numbers the range of ids, local_start counts the ids before the document in
    its shard, and `path`/offsets holds the ids before each shard. Token ids, from a small alphabet, are dictionary-encoded and bit-packed; the
    integer columns rise slowly and are delta-encoded. Row groups, pages and the page index are bounded, so a
    filter on the id reads only the pages that can hold it. Null ids come first; equal ids lie together, by a hash of their texts. Null texts count as empty.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text")).withColumn("shard", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = Encoder.of(tokenizer, True), 0
        for batch in batches:
            for i, j, data, offsets in parts(column(batch, "text")):
                ids, off = with_end(*encoder.encode(data, offsets), end_id)
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(i, j - i), column(batch, "shard").slice(i, j - i), pa.array(before + off[:-1]), pa.array(np.diff(off)), lists(ids, off)], ["id", "shard", "local_start", "n_tokens", "ids"])
                before += int(off[-1])

    encoded = ordered.mapInArrow(encode, "id long, shard int, local_start long, n_tokens long, ids array<int>")
    options = {
        "parquet.writer.version": "v2", "parquet.block.size": str(row_group_bytes), "parquet.page.row.count.limit": str(page_rows), "parquet.page.size": str(1 << 20),
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": str(1 << 20), "compression": "zstd",
    }
    encoded.write.options(**options).parquet(f"{path}/tokens")
    # one row a shard, which is a range of many documents; each holds its own sum
    shards = spark.read.parquet(f"{path}/tokens").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    total, bases = 0, []
    for shard, n in sorted(map(tuple, shards.collect())):
        bases.append((shard, total))
        total += n
    spark.createDataFrame(bases, "shard int, base long").coalesce(1).write.parquet(f"{path}/offsets")


def read_token_table(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(id, start, n_tokens, ids) of the documents with low <= id <= high; only row groups and pages that can hold them are read."""
    table = spark.read.parquet(f"{path}/tokens")
    if low is not None:
        table = table.where(F.col("id") >= low)
    if high is not None:
        table = table.where(F.col("id") <= high)
    offsets = F.broadcast(spark.read.parquet(f"{path}/offsets"))  # a row a shard
    return table.join(offsets, "shard").select("id", (F.col("local_start") + F.col("base")).alias("start"), "n_tokens", "ids")


def add_crc(df: DataFrame, ids_col: str, out: str = "ids_crc32") -> DataFrame:
    """df without the column of ids, with the unsigned CRC-32 of its ids as little-endian unsigned 32-bit integers; a column of df named `out` is replaced. Empty lists have the CRC 0."""
    rest = [c for c in df.columns if c not in (ids_col, out)]

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = column(batch, ids_col)
            off = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False).astype("<u4")
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in rest), pa.array([zlib.crc32(flat[a:b]) for a, b in zip(off[:-1], off[1:])], pa.int64())], [*rest, out])

    return df.mapInArrow(crc, ", ".join(f"`{c}` {t}" for c, t in df.select(*rest).dtypes) + f", {out} long")


def token_table_digest(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token table of df to the shared folder, read it back and return (id_col, start, n_tokens, ids_crc32), one row for each row of df; null and empty texts have the end id alone."""
    path = new_path(df.sparkSession, "tokens")
    write_token_table(df, path, tokenizer, end_id, id_col, text_col)
    return add_crc(read_token_table(df.sparkSession, path), "ids").withColumnRenamed("id", id_col)


