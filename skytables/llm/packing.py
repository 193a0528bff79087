"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of at most the largest length. Pieces are dealt by
hash into shards of bounded size, and each shard is packed by itself: longest
first, each into the open sequence that it leaves least room in. Where none fits, a
sequence of the length with the least expected cost for each unit of content is
opened. In the end every sequence is cut down to the shortest permitted length that
holds its content.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import row_key, saved

#: Permitted lengths, and what a sequence costs besides its length.
CAPACITIES = (1024, 2048, 4096, 8192)
OVERHEAD = 16
#: Pieces packed together. What a shard loses at its end is a few sequences.
SHARD_PIECES = 50_000


def fill(room: int, counts: list[int], have: int) -> int:
    """Content that pieces still to come put into `room`, longest first; bit k of `have` says that counts[k] > 0."""
    filled, most = 0, room
    while longest := max(0, (have & ((2 << most) - 1)).bit_length() - 1):
        n = min(counts[longest], room // longest)
        filled += n * longest
        room -= n * longest
        most = min(room, longest - 1)
    return filled


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number, place in it and the sequence's length, for each piece.

    Ties go to the piece given first and to the sequence opened last. A piece of
    length 0 takes no room.
    """
    capacities = tuple(sorted(capacities))
    order = np.argsort(-lengths, kind="stable")
    counts = np.bincount(lengths.astype(np.int64), minlength=1).tolist()  # pieces still to come by length
    have = sum(1 << k for k, n in enumerate(counts) if n)
    bins = np.zeros(len(lengths), np.int64)
    place = np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open sequences by the room left
    free = 0  # bit r: some open sequence has room r
    filled: list[int] = []
    size: list[int] = []
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        counts[length] -= 1
        if not counts[length]:
            have &= ~(1 << length)
        fits = free >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            # A longer sequence costs less a unit only as far as the pieces still to come fill it.
            k, r = len(size), min((c for c in capacities if c >= length), key=lambda c: ((overhead + c) / max(1, length + fill(c - length, counts, have)), c))
            size.append(r)
            filled.append(0)
        bins[i], place[i] = k, filled[k]
        filled[k] += length
        if r > length:
            room[r - length].append(k)
            free |= 1 << (r - length)
    fit = np.array(capacities)[np.searchsorted(capacities, filled)] if filled else np.zeros(0, np.int64)
    return bins, place, fit[bins] if len(bins) else bins


def best_fit(docs: DataFrame, length: Column, doc_id: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """One row per piece: `doc_id`, `start` and `length` in the document, `sequence`, `place` in it and its `capacity`.

    A document of length null or 0 gives one piece of length 0. Equal rows are packed
    each; an empty table gives no row. Sequence numbers are unique.
    """
    most = max(capacities)
    rows = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text), F.coalesce(length.cast("bigint"), F.lit(0)).alias("n"))
    cuts = F.greatest(F.ceil(F.col("n") / most), F.lit(1))
    pieces = rows.withColumn("k", F.explode(F.sequence(F.lit(0), cuts - 1))).withColumn("start", F.col("k") * most)
    pieces = pieces.select("doc_id", "_id", "_hash", "start", F.least(F.col("n") - F.col("start"), F.lit(most)).alias("length"))
    pieces = saved(pieces, "pieces")
    n_shards = max(1, -(-pieces.count() // SHARD_PIECES))
    # The written pieces keep their order, so a task that runs again deals alike; equal rows are spread too.
    shard = F.pmod(F.xxhash64("_id", "_hash", "start", F.monotonically_increasing_id()), F.lit(n_shards))
    schema = T.StructType([pieces.schema[c] for c in ("doc_id", "start", "length")] + [T.StructField(c, T.LongType()) for c in ("sequence", "place", "capacity")])

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "_hash", "start"], kind="stable")
        bins, place, capacity = pack(rows["length"].to_numpy(), capacities, overhead)
        out = rows[["doc_id", "start", "length"]]
        return out.assign(sequence=(int(key[0]) << 32) + bins, place=place, capacity=capacity)

    return pieces.withColumn("_shard", shard).groupBy("_shard").applyInPandas(solve, schema)
