"""Near-duplicate classes by an exact Jaccard self-join of word shingles.

The universe of shingles is partitioned: a hash deals them into segments, as many
as fit the size band of a set. Two sets of sizes a and b that reach 75 of 100 differ
in at most (a + b) / 7 shingles, so in no more segments. A set with more non-empty
segments than that shares one with every partner, and under one global order of
segments it is enough to index its first few: one more than may differ. The order
is by cost: segments whose content a bounded sample found to be frequent come last,
so that a passage in very many documents is not what documents meet on. A set with
too few non-empty segments indexes all of them, and their one-deletion
neighbourhoods, which doubles what each segment can bear.

Signatures with the same members are kept once, with their number: the segments of a
passage are all shared by the same sets. Sets that meet are compared by their exact
shingles. Stars (each set with the one of its segments' leading sets that it shares
most with) are verified first, for a few rounds; only sets of a segment that are then
in different classes are still paired, and of these only pairs whose sketches do not
rule a link out. A sketch holds, for each of a power of two of buckets, whether the
number of shingles in it is odd, so two sets differ in at least as many shingles as
their sketches in bits: the filter is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import as_bytes, broadcast_if_few, row_key, saved, text_batches, text_or_empty, whole_row

SHINGLE_WORDS = 5
#: Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Size bands reach from one power of this to the next.
BAND = 16
#: Documents sampled to find frequent segments, how often these must occur there, and how many are listed at most.
SAMPLE_DOCS, SAMPLE_TIMES, SAMPLE_LIST = 10_000, 3, 200_000
#: Pairs with one set that are compared in one task.
PART_PAIRS = 2_000
#: Rounds in which each set is compared with the likeliest center of another class, before classes are paired.
STAR_ROUNDS = 3
#: Sets of a signature, each leading a class, that others are compared with in a round.
CENTERS = 4
#: Segments indexed beyond those that the farthest partner may lack.
SHARED = 2
#: Bits of a sketch: the power of two from three bits a shingle on, within these bounds.
LEAST_BITS, MOST_BITS = 256, 4_096
#: Members of a signature that are paired in one group; more are cut into blocks, and each two blocks are a group.
BLOCK = 16_384
#: Pairs whose sketches are compared at once.
PAIRS_AT_ONCE = 10_000
#: Words whose hashes a worker remembers: some 20 MB.
WORDS_KEPT = 100_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; of all words, if they are fewer than one shingle has."""
    found = text.lower().split()  # of bytes: only A-Z, and only ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    out = h[:len(h) - size + 1]
    for j in range(1, size):
        out = _mix(out * _M1 + h[j:len(h) - size + 1 + j])
    return np.unique(_mix(out + np.uint64(size)))


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def bands_of(size: int) -> list[tuple[int, int]]:
    """Bands that a set of this size is indexed in, each with the number of shingles a partner there can differ in.

    A pair meets in the band of its larger set.
    """
    band, high = 0, BAND
    while size >= high:
        band, high = band + 1, high * BAND
    most = 100 * size // PERCENT  # size of the largest partner
    out = [(band, (100 - PERCENT) * (size + min(most, high - 1)) // (100 + PERCENT))]
    if most >= high:
        out.append((band + 1, (100 - PERCENT) * (size + most) // (100 + PERCENT)))
    return out


def n_segments(band: int) -> int:
    """In the lowest band every shingle has a segment of its own; else about one for two shingles of the largest sets."""
    return 1 << 62 if band == 0 else max(1024, 9 * BAND ** (band + 1) // 20)


def segments(tokens: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty segments: number and summed hash of each, its size, and all tokens' hashes in segment order."""
    number = _mix(tokens + np.uint64(band + 1)) % np.uint64(n_segments(band))
    order = np.argsort(number, kind="stable")
    number, h = number[order], _mix(tokens[order] * _M1)
    firsts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    return number[firsts], np.add.reduceat(h, firsts), np.diff(np.append(firsts, len(h))), h


def _signature(number: np.ndarray, total: np.ndarray, band: int) -> np.ndarray:
    return _mix(total + _mix(number * _M1 + np.uint64(band)))


class Frequent(NamedTuple):
    signatures: np.ndarray  # sorted
    times: np.ndarray


def index_entries(tokens: np.ndarray, frequent: Frequent | None, every: bool = False) -> list[tuple[np.ndarray, int]]:
    """The signatures a set is indexed by in each of its bands, and how many of its own segments they are.

    That number is 0 where the set has too few segments and is indexed with all of
    them and their one-deletion neighbourhoods. `every` gives all exact signatures.
    """
    out = []
    for band, differ in bands_of(len(tokens)):
        number, total, size, h = segments(tokens, band)
        exact = _signature(number, total, band)
        if every:
            out.append((exact, len(exact)))
        elif len(exact) > differ:
            order = np.argsort(exact)
            if frequent is not None and len(frequent.signatures):
                at = np.minimum(np.searchsorted(frequent.signatures, exact), len(frequent.signatures) - 1)
                cost = np.where(frequent.signatures[at] == exact, frequent.times[at], 0)
                order = np.lexsort((exact, cost))
            first = exact[order[:differ + SHARED]]
            out.append((first, len(first)))
        else:
            of = np.repeat(np.arange(len(number)), size)
            less = _signature(number[of], total[of] - h, band)[size[of] > 1]
            out.append((np.unique(np.concatenate((exact, less))), 0))
    return out


def shared_at_least(size_a: int, own_a: int, size_b: int, own_b: int) -> int:
    """How many signatures two sets that link have in common at least.

    At most d of either set's segments differ from the other's. The indexed segments
    of both are first ones of one order, so the equal ones among the shorter list are
    in both lists.
    """
    return max(1, min(own_a, own_b) - (100 - PERCENT) * (size_a + size_b) // (100 + PERCENT))


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the numbers of shingles per bucket."""
    bits = min(max(LEAST_BITS, 1 << (3 * len(tokens) - 1).bit_length()), MOST_BITS)
    # The low bits choose the bucket, so the sketch of half the bits is the exclusive or of both halves.
    odd = np.bincount((_mix(tokens * _M3) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], bits: int) -> np.ndarray:
    """Sketches of `bits` bits as rows of words; those of fewer bits are zero."""
    out = np.zeros((len(sketches), bits // 64), np.uint64)
    widths = np.fromiter(map(len, sketches), np.int64, len(sketches)) * 8
    for width in np.unique(widths[widths >= bits]).tolist():
        at = np.flatnonzero(widths == width)
        words = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1, bits // 64)
        out[at] = np.bitwise_xor.reduce(words, axis=1)
    return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))


_SETS = "_id long, _hash long, n int, gid long, own int, signatures array<long>, own2 int, signatures2 array<long>, sketch binary"


def _indexed(rows: DataFrame, frequent: Frequent | None, every: bool = False) -> DataFrame:
    """Sets of `rows` (`_id`, `_hash`, `text`), with signatures where the task meets a set for the first time."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)  # at most SAMPLE_LIST pairs of numbers

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, seen, listed = np.zeros(0, np.uint64), set(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sizes, ids, own, lists, sketches = [], [], ([], []), ([], []), []
                for text in as_bytes(part.column(2)):
                    tokens = shingles(text)
                    gid = set_id(tokens) if len(tokens) else None
                    first = gid is not None and gid not in seen
                    found = index_entries(tokens, listed, every) if first else []
                    sketches.append(sketch(tokens) if first and not every else None)
                    if gid is not None and len(seen) < 1_000_000:
                        seen.add(gid)
                    sizes.append(len(tokens)), ids.append(gid)
                    for i in range(2):
                        signatures, k = found[i] if i < len(found) else (none, 0)
                        own[i].append(k), lists[i].append(signatures)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(sizes, pa.int32()), pa.array(ids, pa.int64()),
                    pa.array(own[0], pa.int32()), _lists(lists[0]), pa.array(own[1], pa.int32()), _lists(lists[1]),
                    pa.array(sketches, pa.binary()),
                ], names=["_id", "_hash", "n", "gid", "own", "signatures", "own2", "signatures2", "sketch"])

    return rows.mapInArrow(index, _SETS)


def frequent_segments(rows: DataFrame) -> Frequent:
    """Segments found often in a sample of about SAMPLE_DOCS documents. They only order the index; links never depend on them."""
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("_hash", "_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows
    found = _indexed(some, None, every=True).select("gid", F.explode(F.concat("signatures", "signatures2")).alias("s")).distinct()
    times = found.groupBy("s").count().where(F.col("count") >= SAMPLE_TIMES).orderBy(F.desc("count"), "s").limit(SAMPLE_LIST).toPandas()
    signatures, count = times["s"].to_numpy().astype(np.int64).view(np.uint64), times["count"].to_numpy()
    order = np.argsort(signatures)
    return Frequent(signatures[order], count[order])


_MET = "sig long, gid long, n int, own int, list long"
_PAIRS = "a long, b long, want int, times long"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each signature with two sets or more, each once, and then a row on the signature.

    That row holds two hashes of its members (`gid` and `list`) and their number (`n`);
    `list` is null for members. Rows come by signature, then set. However many members
    a signature has, only sums over them are kept from batch to batch.
    """
    none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
    held, open_ = none, None  # the only member so far of the last signature, or its sums if it has more
    for batch in batches:
        rows = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns[:4], strict=True)]
        if not len(rows[0]):
            continue
        again = np.concatenate(([False], (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])))
        if open_ is not None:
            again[0] = rows[0][0] == open_[0] and rows[1][0] == open_[4]
        sig, gid, n, own = rows = [r[~again] for r in rows]
        if not len(sig):
            continue
        firsts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.append(firsts, len(sig)))
        h = _mix(gid.view(np.uint64) * _M1 + own.astype(np.uint64))
        x, y = np.add.reduceat(h, firsts), np.add.reduceat(_mix(h * _M3), firsts)
        ended = []
        if open_ is not None:
            if sig[0] == open_[0]:
                count[:1] += open_[1]
                x[:1] += open_[2]  # of arrays, as these sums overflow
                y[:1] += open_[3]
            else:
                ended.append(open_[:4])
        busy = count > 1
        members = [r[np.repeat(busy, np.diff(np.append(firsts, len(sig))))] for r in rows]
        if busy[-1]:
            held, open_ = none, (sig[-1], count[-1], x[-1], y[-1], gid[-1])
        else:
            held, open_ = [r[-1:] for r in rows], None
        whole = np.flatnonzero(busy[:-1])
        yield _with_lists(members, ended, (sig[firsts[whole]], count[whole], x[whole], y[whole]))
    if open_ is not None:
        yield _with_lists(none, [open_[:4]], (none[0], none[0], np.zeros(0, np.uint64), np.zeros(0, np.uint64)))


def _with_lists(members: list[np.ndarray], ended: list[tuple], lists: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    sig, count, x, y = (np.concatenate((np.array([e[i] for e in ended], c.dtype), c)) for i, c in enumerate(lists))
    k = len(members[0])
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate((members[0], sig))), pa.array(np.concatenate((members[1], x.view(np.int64)))),
        pa.array(np.concatenate((members[2], count.astype(np.int32)))), pa.array(np.concatenate((members[3], np.zeros(len(sig), np.int32)))),
        pa.array(np.concatenate((np.zeros(k, np.int64), y.view(np.int64))), mask=np.arange(k + len(sig)) < k),
    ], names=["sig", "gid", "n", "own", "list"])


def _columns(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a signature with the first one of another class whose size fits, of a few that lead their classes.

    Rows come by signature, those first that share most signatures with any other
    set: of near copies, that is the text they were copied from.
    """
    last, centers = None, []
    for batch in batches:
        out = []
        for sig, gid, n, own, label, times in zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True):
            if sig != last:
                last, centers = sig, []
            for c_gid, c_n, c_own, c_label in centers:
                if c_label != label and PERCENT * max(n, c_n) <= 100 * min(n, c_n):
                    out.append((gid, c_gid, shared_at_least(n, own, c_n, c_own), times))
                    break
            if len(centers) < CENTERS and all(c[3] != label for c in centers):
                centers.append((gid, n, own, label))
        if out:
            yield _columns(out, [pa.int64(), pa.int64(), pa.int32(), pa.int64()], ["a", "b", "want", "times"])


def _verified(pairs: DataFrame, where: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (`a`, `b`) of set ids that link, by their exact shingles.

    `where` has for each set (`gid`) the key (`_id`, `_hash`) of one of `rows` with its text. The texts of all `a`
    with one `b` meet after that of `b`, in parts of about PART_PAIRS.
    """
    parts = F.ceil(F.col("n") / PART_PAIRS)
    sized = pairs.join(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "b").select("a", "b", F.pmod(F.xxhash64("a"), parts).alias("part"))
    members = sized.join(where.withColumnRenamed("gid", "a"), "a").select("_id", "_hash", "b", "part", "a")
    firsts = sized.select("b", "part").distinct().join(where.withColumnRenamed("gid", "b"), "b").select("_id", "_hash", "b", "part", F.lit(None).cast("bigint").alias("a"))
    # Few keys are sent to the rows, so that of the texts only those to be compared are shuffled, and none is written.
    wanted = broadcast_if_few(saved(members.union(firsts), "jaccard-parts"))
    both = rows.join(wanted, ["_id", "_hash"]).select("b", "part", "a", "text")
    both = both.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = None
        for batch in batches:
            kept = []
            for i, (a, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                tokens = shingles(text.as_py().encode())
                if a is None:
                    right = tokens
                    continue
                common = len(np.intersect1d(tokens, right, assume_unique=True))
                if 100 * common >= PERCENT * (len(tokens) + len(right) - common):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return both.mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(`gid`, `label`): the least id in reach of every id in `links` (`a`, `b`).

    Each round takes the least label among neighbours and then the label's own label,
    and is written out, so that lineage stays short. Nothing is gathered.
    """
    edges = saved(links.union(links.select("b", "a")).distinct(), "links")
    labels = saved(edges.groupBy(F.col("a").alias("gid")).agg(F.least(F.min("b"), F.col("gid")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.gid).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "gid"), "gid").select("gid", F.least("label", "near").alias("new"), "label")
        jump = labels.select(F.col("gid").alias("new"), F.col("label").alias("far"))
        new = saved(new.join(jump, "new", "left").select("gid", F.least("new", F.coalesce("far", "new")).alias("label"), F.col("label").alias("old")), "labels")
        labels = new.select("gid", "label")
        if not new.where("label <> old").limit(1).count():
            return labels


_OPEN = ["sig", "i", "j", "label", "block", "gid", "n", "own", "times", "sketch"]


def _ends(*keys: np.ndarray) -> np.ndarray:
    """For each row of sorted keys the place after the last equal row."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    lasts = np.append(np.flatnonzero(new)[1:], len(new))
    return lasts[np.cumsum(new) - 1]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a group (`sig`, `i`, `j`) in different classes, of sizes that fit and sketches that do not rule a link out.

    Rows come by group, then class, in the order of _OPEN. A group is a whole signature,
    or two blocks of one, and never has many more than 2 * BLOCK rows.
    """
    rest = None
    for batch in batches:
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        sig, i, j = (rest.column(k).to_numpy() for k in range(3))
        last = np.flatnonzero((sig != sig[-1]) | (i != i[-1]) | (j != j[-1])) if len(sig) else []
        if len(last):
            done, rest = rest.slice(0, last[-1] + 1), rest.slice(last[-1] + 1)
            yield from _pairs(done)
    if rest is not None and rest.num_rows:
        yield from _pairs(rest)


def _pairs(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pairs of whole groups. A row is paired with those of its group that come after its class."""
    sig, i, j, label, block, gid, n, own, times = (rows.column(k).to_numpy() for k in range(9))
    sketches = rows.column(9).to_pylist()
    bits = np.fromiter(map(len, sketches), np.int64, len(sketches)) * 8
    words = {b: folded(sketches, b) for b in np.unique(bits).tolist()}
    start, end = _ends(sig, i, j, label), _ends(sig, i, j)
    before = np.concatenate(([0], np.cumsum(end - start)))
    for at in range(0, int(before[-1]), PAIRS_AT_ONCE):
        pair = np.arange(at, min(at + PAIRS_AT_ONCE, int(before[-1])))
        a = np.searchsorted(before, pair, side="right") - 1
        b = start[a] + pair - before[a]
        fits = PERCENT * np.maximum(n[a], n[b]).astype(np.int64) <= 100 * np.minimum(n[a], n[b]).astype(np.int64)
        fits &= (i[a] == j[a]) | (block[a] != block[b])
        a, b = a[fits], b[fits]
        width, differ = np.minimum(bits[a], bits[b]), np.zeros(len(a), np.int64)
        for w in np.unique(width).tolist():
            of = np.flatnonzero(width == w)
            differ[of] = np.bitwise_count(words[w][a[of]] ^ words[w][b[of]]).sum(axis=1, dtype=np.int64)
        sizes = n[a].astype(np.int64) + n[b]
        near = (100 + PERCENT) * differ <= (100 - PERCENT) * sizes
        a, b, sizes = a[near], b[near], sizes[near]
        if len(a):
            need = np.maximum(1, np.minimum(own[a], own[b]) - (100 - PERCENT) * sizes // (100 + PERCENT))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.minimum(gid[a], gid[b])), pa.array(np.maximum(gid[a], gid[b])),
                pa.array(need.astype(np.int32)), pa.array(times[a]),
            ], names=["a", "b", "want", "times"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`_id`, `_hash` (see `row_key`), `n_shingles` and `class_id` for each row of `docs`.

    Rows of one class are linked directly or through others. `class_id` is null for a
    text without words (empty, null, white space), which links with nothing. Equal
    rows are in one class and each gives a row; an empty table gives none.
    """
    text_batches(docs)
    spark = docs.sparkSession
    rows = docs.select(*row_key(doc_id, text), text_or_empty(text).alias("text"))
    sets = saved(_indexed(rows, frequent_segments(rows)), "jaccard-sets")
    entries = sets.select(F.explode("signatures").alias("sig"), "n", "gid", "own").union(
        sets.where("own2 > 0 or size(signatures2) > 0").select(F.explode("signatures2"), "n", "gid", "own2"))
    met = saved(entries.select("sig", "gid", "n", "own").repartition("sig").sortWithinPartitions("sig", "gid").mapInArrow(_met, _MET), "jaccard-met")
    # Of the signatures with the same members, one.
    lists = met.where("list is not null").groupBy("gid", "list", "n").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("times"))
    lists = broadcast_if_few(saved(lists.select("sig", "times", F.col("n").alias("members")), "jaccard-lists"))
    met = saved(met.where("list is null").drop("list").join(lists, "sig"), "jaccard-members")
    # Of every set that meets another, one document.
    ids = met.select("gid").distinct()
    where = sets.select("gid", "_id", "_hash").join(ids, "gid").groupBy("gid").agg(F.min(F.struct("_id", "_hash")).alias("at")).select("gid", "at.*")
    where = saved(where, "jaccard-where")
    meets = broadcast_if_few(saved(met.groupBy("gid").agg(F.sum("times").alias("meets")), "jaccard-meets"))
    met = saved(met.join(meets, "gid"), "jaccard-met-often")  # read in every round, so joined once
    none = spark.range(0)  # not from Python rows, for which each executor would start workers
    links = tested = none.select(F.col("id").alias("a"), F.col("id").alias("b"))
    labels = none.select(F.col("id").alias("gid"), F.col("id").alias("label"))
    for _ in range(STAR_ROUNDS):
        order = ["sig", F.col("meets").desc(), "gid"]
        rows_ = _open(met, labels).select("sig", "gid", "n", "own", "label", "times", "meets").repartition("sig").sortWithinPartitions(*order)
        stars = rows_.mapInArrow(_stars, _PAIRS).groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("want").alias("want"))
        # Likely links only: what they do not unite is paired below, whole.
        likely = stars.where("2 * times >= want").join(tested, ["a", "b"], "left_anti")
        best = saved(likely.groupBy("a").agg(F.max(F.struct("times", "b")).alias("best")).select("a", "best.b"), "jaccard-best")
        if not best.take(1):
            break
        new = saved(_verified(best, where, rows), "jaccard-links")
        tested = tested.union(best)
        if not new.take(1):
            break
        links = links.union(new)
        labels = saved(components(links), "jaccard-labels")
    # What the stars left open: sets of one signature in different classes.
    open_ = saved(_open(met, labels).drop("meets"), "jaccard-open")
    sketches = sets.where("sketch is not null").join(open_.select("gid").distinct(), "gid", "left_semi").select("gid", "sketch").dropDuplicates(["gid"])
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("gid"), blocks).cast("int")).select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    open_ = open_.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).join(sketches, "gid")
    groups = open_.select(*_OPEN).repartition("sig", "i", "j").sortWithinPartitions(*_OPEN[:4])
    pairs = groups.mapInArrow(_across, _PAIRS).groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("want").alias("need"))
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = saved(pairs.where("times >= need").select("a", "b").join(known, ["a", "b"], "left_anti"), "jaccard-pairs")
    labels = components(links.union(saved(_verified(pairs, where, rows), "jaccard-links")))
    return _label(sets.where("gid is not null"), labels, "gid", "class_id").select("_id", "_hash", F.col("n").cast("bigint").alias("n_shingles"), "class_id").union(
        sets.where("gid is null").select("_id", "_hash", F.lit(0).cast("bigint"), F.lit(None).cast("bigint")))


def _open(met: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the signatures whose sets are not all of one class yet, with their class as `label`."""
    labelled = _label(met, labels, "gid", "label")
    split = labelled.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("sig")
    return labelled.join(split, "sig", "left_semi")


def _label(rows: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    """`rows` with the class of the set in `column`: its own id where it has no link."""
    found = broadcast_if_few(labels.select(F.col("gid").alias(column), F.col("label").alias("_found")))
    return rows.join(found, column, "left").withColumn(out, F.coalesce("_found", column)).drop("_found")


def with_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `n_shingles` and `component_id`, the smallest id in the document's class (its own without words;
    null ids are passed over)."""
    found = near_duplicates(docs, doc_id, text).dropDuplicates(["_id", "_hash"])
    ids = docs.select(F.col(doc_id).alias("doc_id"), *row_key(doc_id, text)).join(found, ["_id", "_hash"])
    least = ids.where(F.col("class_id").isNotNull()).groupBy("class_id").agg(F.min("doc_id").alias("component_id"))
    return ids.join(least, "class_id", "left").select("doc_id", "n_shingles", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each class, that with the smallest id (of equal rows one), and all without words."""
    found = saved(near_duplicates(docs, doc_id, text).where("class_id is not null"), "jaccard-classes")
    by = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_hash")))
    kept = found.groupBy("class_id").agg(by.alias("at")).select("at._id", "at._hash")
    keys = saved(found.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("n")), "jaccard-keys")
    dropped = broadcast_if_few(saved(keys.join(kept, ["_id", "_hash"], "left_anti").select("_id", "_hash"), "jaccard-dropped"))
    again = broadcast_if_few(saved(keys.where("n > 1").select("_id", "_hash"), "jaccard-again"))
    rows = docs.select(whole_row(docs), *row_key(doc_id, text)).join(dropped, ["_id", "_hash"], "left_anti")
    once = rows.join(again, ["_id", "_hash"], "left_anti")
    more = rows.join(again, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return once.union(more).select("_doc.*")
