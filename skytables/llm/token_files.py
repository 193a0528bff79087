"""Token ids as Parquet files: written in document order, read selectively.

A file set has one row per document: `doc_id`, `shard` (the place of its file in
the order), `n_tokens`, `shard_start` (ids before it in its shard) and `tokens`, a
list column. Ids are dictionary-coded (a vocabulary fits a dictionary page); the
other columns are sorted or small numbers and delta-coded. Row groups and pages
are small enough that page indexes let a reader fetch the counts, or the tokens of
a few documents, without the rest.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import text_or_empty

#: Settings of Spark's Parquet writer for a file set.
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(32 * 1024 * 1024),
    "parquet.page.size": str(256 * 1024),
    "parquet.page.row.count.limit": "4096",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#shard_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
#: Stretches whose ids a worker remembers; others are encoded again.
CACHED_WORDS = 600_000
#: Documents encoded together.
STEP = 500
#: Stretches that the tokenizer gets as lines of one text.
LINES = 64


def _class(chars: Iterable[str]) -> str:
    """The ranges of a regular expression's character class, for characters in ascending order."""
    ranges: list[list[int]] = []
    for c in map(ord, chars):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


#: Characters of the basic plane, without surrogates.
_PLANE = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000]
#: Characters that regular expression libraries may class differently, and those of the planes above that can be
#: letters (all but the block of pictures); a text with one is encoded whole.
ODD = re.compile("[%s\U00010000-\U0001efff\U00020000-\U0010ffff]" % _class(
    c for c in _PLANE if (c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc", "Cf", "Co", "Cn")) and c not in "\t\n\v\f\r "
))
#: Letters of every script, as `\p{L}`.
_LETTER = _class(c for c in _PLANE if unicodedata.category(c)[0] == "L")
#: Stretches that a byte-level pre-tokenizer never joins: letters with the space before them; other
#: characters, with what follows an apostrophe; white space of two characters or more with all that follows it.
STRETCH = re.compile(rf"\s\s+\S*| ?[{_LETTER}]+| ?(?:[^\s{_LETTER}']|'[{_LETTER}]*)+|\s")
#: A stretch of letters, or of other characters of the basic alphabet, that can be a line among others.
WORD = re.compile(rf" ?(?:[{_LETTER}]+|[!-~]+)")


class WordEncoder:
    """Encodes texts with a byte-level tokenizer file, remembering the ids of short stretches.

    Equal to encoding whole texts, as a byte-level pre-tokenizer cuts between
    stretches too. Texts with odd characters or a special token, and all texts of
    other kinds of tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        before = self.tokenizer.pre_tokenizer
        self.by_stretch = isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space and self.tokenizer.normalizer is None
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        plain = self.tokenizer.truncation is None and self.tokenizer.padding is None
        self.line_end = line_end[0] if self.by_stretch and plain and len(line_end) == 1 else None

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of stretches without white space but a space before, LINES of them as one text: a line end
        there is a token by itself."""
        out = []
        for line in self._library(["\n".join(words[at:at + LINES]) for at in range(0, len(words), LINES)]):
            cuts = (np.flatnonzero(np.frombuffer(line, "<u4") == self.line_end) * 4).tolist()
            out += [line[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(line)], strict=True)]
        return out

    def _stretches(self, new: list[str]) -> dict[str, bytes]:
        """The ids of stretches or whole texts, each there once."""
        words = [] if self.line_end is None else [p for p in new if WORD.fullmatch(p)]
        found = dict(zip(words, self._words(words), strict=True))
        others = [p for p in new if p not in found]
        return found | dict(zip(others, self._library(others), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        split = STRETCH.findall
        parts = [split(t) if self.by_stretch and not ODD.search(t) and not any(s in t for s in self.special) else [t] for t in texts]
        known = self.known
        # Each stretch is looked up once among all that are remembered, then in the few at hand.
        now = {p: known.get(p) for p in set().union(*parts)}
        new = [p for p, ids in now.items() if ids is None]
        now |= self._stretches(new)
        out = [b"".join(map(now.__getitem__, ps)) for ps in parts]
        for p in new:
            if len(known) >= CACHED_WORDS:
                break
            if len(p) <= 40:
                known[p] = now[p]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", n_shards: int | None = None) -> DataFrame:
    """Rows of a file set, ordered by id over its shards (lazy).

    Null text counts as empty and has the end id only. Null ids come first;
    documents with equal ids follow each other by the hash of their text, then the
    text, so that repeated rows have a fixed order. `tokenizer` is the path of a
    tokenizer file that every machine has.
    """
    n = n_shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    schema = T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("shard", T.IntegerType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("shard_start", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType())),
    ])
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                ids = [x + end for x in encoder.encode(part.column(1).to_pylist())]
                ends = np.cumsum([len(x) // 4 for x in ids])
                counts = np.diff(ends, prepend=0)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.full(len(ids), shard), pa.int32()), pa.array(counts, pa.int64()),
                    pa.array(start + ends - counts, pa.int64()), tokens,
                ], names=schema.names)
                start += int(ends[-1])

    return rows.mapInArrow(encode, schema)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, **columns: str) -> None:
    encode_documents(docs, tokenizer, end_id, **columns).write.options(**FILE_OPTIONS).parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a file set with `start`, the number of ids of all documents before.

    Only the shards' sums, one row a shard, are gathered and broadcast; selecting
    no `tokens` leaves that column unread.
    """
    rows = spark.read.parquet(folder)
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "shard").withColumn("start", F.col("offset") + F.col("shard_start")).drop("offset")


def with_crc32(rows: DataFrame) -> DataFrame:
    """`tokens` replaced by `ids_crc32`, of the ids as little-endian unsigned 32-bit integers."""
    names = [c for c in rows.columns if c != "tokens"]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("ids_crc32", T.LongType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=schema.names)

    return rows.select(*names, "tokens").mapInArrow(check, schema)
