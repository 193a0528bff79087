"""Removal of long repeated passages, exactly, with suffix arrays.

A byte is removed if a string of `limit` bytes that covers it starts anywhere else
too, in the same document or another. One suffix array over a corpus cannot be
sharded by documents without comparing every pair of shards, so shards are made
by content:

1. Every window of `limit` bytes has a key, the least hash of the short strings in
   it. Equal windows have equal keys wherever they stand. Neighbouring windows mostly
   share a key, so a document becomes a few runs (key, start, end) for each KB.
2. A key that occurs in one run only, with its least string in it once, holds no
   repeat. The others are counted by a partial aggregate; a key whose runs are all
   the same bytes needs no more than that count. Of the rest, one copy of each
   distinct run's bytes is cut from its document.
3. Runs are shuffled by key, packed into shards of bounded size, and each shard
   gets a suffix array (Larsson-Sadakane doubling in numpy) with Kasai's common
   prefixes. Windows whose suffixes share `limit` bytes are repeats.
4. A key with more distinct bytes than a shard holds (a passage in a third of all
   documents) is not gathered. Its windows are reduced to 128-bit digests, and those
   that occur more than once are found by a partial aggregate over all shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import as_bytes, column_of, row_key, saved, slices, text_batches, text_or_empty, whole_row

LIMIT = 400
#: Length of the short strings whose least hash is a window's key.
GRAM = 32
#: A shard's bytes; a suffix array takes about 60 times as much memory.
SHARD_BYTES = 1 << 20

_RANDOM = np.random.default_rng(400)
_BYTE = _RANDOM.integers(0, 2**64, (2, 256), dtype=np.uint64)
_STEP = _RANDOM.integers(0, 2**64, (2, 16), dtype=np.uint64) | np.uint64(1)


def rolling(data: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """A hash of each substring of `length` bytes, by doubling."""
    h, size, step = _BYTE[lane][data], 1, 0
    while size < length:
        more = min(size, length - size)
        h = h[:-more] * _STEP[lane][step] + h[more:]
        size, step = size + more, step + 1
    h ^= h >> np.uint64(29)
    h *= _STEP[lane][15]
    h ^= h >> np.uint64(32)
    return h


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        more = min(size, width - size)
        h = np.minimum(h[:-more], h[more:])
        size += more
    return h


def runs_of(text: bytes, limit: int = LIMIT, gram: int = GRAM) -> list[tuple[int, int, int, int, bool]]:
    """Runs of windows with equal keys: first start, end of starts, key, hash of the bytes, and
    whether the least string occurs in them more than once."""
    if len(text) < limit:
        return []
    data = np.frombuffer(text, np.uint8)
    h = rolling(data, gram)
    width = limit - gram + 1
    least = sliding_least(h, width)
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    signed, out = least.view(np.int64), []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(least)], strict=True):
        content = int.from_bytes(hashlib.blake2b(text[a:b - 1 + limit], digest_size=8).digest(), "little", signed=True)
        again = np.count_nonzero(h[a:b - 1 + width] == least[a]) > 1
        out.append((a, b, int(signed[a]), content, bool(again)))
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order.

    Larsson-Sadakane: suffixes are sorted by a first few bytes, then groups of equal
    rank, and only those, by the rank of the suffix as far on as is sorted already.
    """
    n, h = len(data), 8
    packed = np.zeros(n + 8, np.uint64)
    packed[:n] = data
    key = packed.copy()
    for shift in (1, 2, 4):  # 8 bytes by doubling
        key[:-shift] = (key[:-shift] << np.uint64(8 * shift)) | key[shift:]
    order = n - 1 - np.argsort(key[:n][::-1], kind="stable")
    short = order > n - 8  # ends within these bytes, so comes before all that have zeros there, and equals none
    new = np.concatenate(([True], (key[order[1:]] != key[order[:-1]]) | short[1:] | short[:-1]))
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    while True:
        last = np.concatenate((new[1:], [True]))
        open_ = np.flatnonzero(~(new & last))  # places in groups of two or more
        if not len(open_):
            return order
        suffix = order[open_]
        by = rank[suffix] * (n + 2) + rank[np.minimum(suffix + h, n)] + 1
        perm = np.argsort(by, kind="stable")
        order[open_], by = suffix[perm], by[perm]
        new[open_[1:]] = by[1:] != by[:-1]
        new[open_[0]] = True
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[open_]] = group[open_]
        h *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, strips: int = 2048) -> np.ndarray:
    """Length of the common prefix, up to `most`, of each suffix in order with the one before it.

    Kasai: in text order the prefix shrinks by at most one from a suffix to the next
    (which holds only if suffixes are sorted to their ends).
    Strips of the text go forward in step, each an element of the vectors.
    """
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order[np.maximum(place - 1, 0)]
    before[order[0]] = n  # the first suffix has none: compares with the end
    ends = np.concatenate((data.astype(np.int16), np.full(most + 1, -1, np.int16)))
    other = np.concatenate((data.astype(np.int16), np.full(most + 1, -2, np.int16)))
    out = np.zeros(n, np.int64)
    size = -(-n // strips)
    i = np.arange(0, n, size)
    stop = np.minimum(i + size, n)
    h = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        same = (ends[i + h] == other[j + h]) & (h < most)
        h += same
        out[place[i[~same]]] = h[~same]
        i = i + ~same
        h = np.where(same, h, np.maximum(h - 1, 0))
        if (i == stop).any():
            going = i < stop
            i, h, stop = i[going], h[going], stop[going]
    return out


def repeated_starts(pieces: list[bytes], limit: int = LIMIT) -> list[np.ndarray]:
    """For each piece, which of its windows of `limit` bytes occur more than once in all pieces."""
    joined = b"\0".join(pieces)
    data = np.frombuffer(joined, np.uint8)
    valid = np.zeros(len(data), bool)
    at, firsts = 0, []
    for p in pieces:
        firsts.append(at)
        valid[at:at + len(p) - limit + 1] = True
        at += len(p) + 1
    order = suffix_array(data)
    shared = common_prefixes(data, order, limit) >= limit
    group = np.cumsum(~shared)
    often = np.bincount(group, weights=valid[order]) > 1
    found = np.zeros(len(data), bool)
    found[order] = often[group]
    found &= valid
    return [found[a:a + len(p) - limit + 1] for a, p in zip(firsts, pieces, strict=True)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_SPAN = "_id long, _hash long, from int, to int"


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["_id", "_hash", "from", "to"])


def repeated_spans(docs: DataFrame, limit: int = LIMIT, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Byte ranges (`_id`, `_hash`, `from`, `to`) of `docs` (`_id`, `_hash`, `text`) that repeated strings cover; they may overlap."""

    text_batches(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for a, b, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), strict=True):
                    out += [(a, b, *r) for r in runs_of(text, limit, gram)]
                yield _batch(out, types, ["_id", "_hash", "a", "b", "key", "content", "again"])

    runs = saved(docs.select("_id", "_hash", "text").mapInArrow(find, "_id long, _hash long, a int, b int, key long, content long, again boolean"), "suffix-runs")
    keys = runs.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("least"), F.max("content").alias("most"), F.max("again").alias("any_again"),
    ).where((F.col("n") > 1) | F.col("any_again"))
    keys = keys.select("key", (F.col("least") != F.col("most")).alias("mixed"), "n")
    hits = saved(runs.join(keys, "key"), "suffix-hits")
    span = lambda rows: rows.select("_id", "_hash", F.col("a").alias("from"), (F.col("b") + (limit - 1)).alias("to"))
    whole = span(hits.where(~F.col("mixed") & (F.col("n") > 1)))

    # Distinct runs of the other keys; one that is there several times is all repeats, but others may share parts of it.
    mixed = hits.where(F.col("mixed") | (F.col("n") == 1)).drop("n", "mixed")
    distinct = saved(mixed.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_hash", "a", "b")).alias("at")), "suffix-distinct")
    copied = distinct.where("n > 1").select("key", "content")
    whole = whole.union(span(mixed.join(copied, ["key", "content"], "left_semi")))
    size = F.sum(F.col("at.b") - F.col("at.a") + (limit - 1))
    crowded = distinct.groupBy("key").agg(size.alias("bytes")).where(F.col("bytes") > shard_bytes).select("key", F.lit(True).alias("crowded"))
    wanted = distinct.join(crowded, "key", "left").select("at.*", "key", "content", "n", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    wanted = wanted.groupBy("_id", "_hash").agg(F.collect_list(F.struct("a", "b", "key", "content", "n", "crowded")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                out = []
                for a, b, text, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), part.column(3).to_pylist(), strict=True):
                    out += [(a, b, r["a"], r["key"], r["n"], r["crowded"], text[r["a"]:r["b"] - 1 + limit]) for r in runs]
                yield _batch(out, types, ["_id", "_hash", "a", "key", "n", "crowded", "piece"])

    # Equal rows share a key and both give the piece, which is right: their runs count twice, so are repeats anyway.
    texts = docs.select("_id", "_hash", "text").join(wanted, ["_id", "_hash"])
    pieces = saved(texts.mapInArrow(cut, "_id long, _hash long, a int, key long, n long, crowded boolean, piece binary"), "suffix-pieces")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None

        def solve() -> Iterator[pa.RecordBatch]:
            if rows:
                starts = repeated_starts([r[4] for r in rows], limit)
                found = [(r[0], r[1], r[2] + x, r[2] + y - 1 + limit) for r, s in zip(rows, starts, strict=True) if r[3] == 1 for x, y in _ranges(s)]
                yield _spans(found)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for a, b, start, key, n, piece in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if size > shard_bytes and key != last:
                        yield from solve()
                        rows, size = [], 0
                    rows.append((a, b, start, n, piece))
                    size, last = size + len(piece), key
        yield from solve()

    usual = pieces.where(~F.col("crowded")).select("_id", "_hash", "a", "key", "n", "piece")
    in_shards = usual.repartition("key").sortWithinPartitions("key").mapInArrow(shards, _SPAN)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, start, n, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(piece, np.uint8)
                first, second = (rolling(data, limit, lane).view(np.int64) for lane in (0, 1))
                k = len(first)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(k, a)), pa.array(np.full(k, b)), pa.array(np.arange(start, start + k, dtype=np.int32)),
                    pa.array(np.full(k, n)), pa.array(first), pa.array(second),
                ], names=["_id", "_hash", "at", "n", "d1", "d2"])

    spread = pieces.where("crowded").select("_id", "_hash", "a", "n", "piece")
    digests = saved(spread.mapInArrow(digest, "_id long, _hash long, at int, n long, d1 long, d2 long"), "suffix-digests")
    often = digests.groupBy("d1", "d2").agg(F.sum("n").alias("times")).where("times > 1").select("d1", "d2")
    in_spread = digests.join(often, ["d1", "d2"], "left_semi").select("_id", "_hash", F.col("at").alias("from"), (F.col("at") + limit).alias("to"))
    return whole.union(in_shards).union(in_spread)


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed ranges."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    edges = [0, *(x for m in merged for x in m), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), [(a, b) for a, b in merged]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """Each row of `docs` as `_doc`, with `_kept`, the bytes of the text that are left (binary), and `_removed`, the maximal ranges cut out of it.

    Every copy of a repeated string goes, the first too. Null text counts as empty and
    keeps nothing; texts shorter than the limit are left whole, and so are empty
    tables. Repeated rows are each other's copies, also where their ids are equal or
    null. Other columns are carried as they are.
    """
    spans = repeated_spans(docs.select(*row_key(doc_id, text), text_or_empty(text).alias("text")), **settings)
    # Ranges of one document: bounded by its length.
    by_doc = spans.distinct().groupBy("_id", "_hash").agg(F.collect_list(F.struct("from", "to")).alias("_spans"))
    rows = docs.select(whole_row(docs), *row_key(doc_id, text)).join(by_doc, ["_id", "_hash"], "left")
    rows = rows.select("_doc", "_spans")
    schema = T.StructType([
        rows.schema["_doc"], T.StructField("_kept", T.BinaryType()),
        T.StructField("_removed", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))),
    ])
    range_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, removed = [], []
            for data, found in zip(as_bytes(column_of(batch, ("_doc", text))), batch.column(1).to_pylist(), strict=True):
                left, ranges = cut_spans(data, [(f["from"], f["to"]) for f in found or []])
                kept.append(left)
                removed.append([{"from": a, "to": b} for a, b in ranges])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(removed, range_type)], names=schema.names)

    return rows.mapInArrow(cut_out, schema)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: str | None = None, **settings: int) -> DataFrame:
    """`docs` with the repeats cut out of the text. A character that a cut splits goes as a whole.

    `size` names a column that is set to the new number of characters.
    """
    rows = remove_repeats(docs, doc_id, text, **settings)
    schema = T.StructType([*rows.schema.fields[:1], T.StructField("_new", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left = [b.decode("utf-8", "ignore") if cut else None for b, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], names=schema.names)

    rows = rows.mapInArrow(decode, schema)
    new = {text: F.coalesce("_new", F.col("_doc")[text])} | ({size: F.when(F.col("_new").isNull(), F.col("_doc")[size]).otherwise(F.length("_new").cast(docs.schema[size].dataType))} if size else {})
    return rows.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
