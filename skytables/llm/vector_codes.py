"""Product-quantised codes of vectors, with codebooks refined in whole numbers.

Vectors become whole numbers and are cut into equal parts; each part has a codebook of
up to 256 entries. A round assigns every part to its nearest entry (ties to the lower
index) and replaces each entry by the floor of the mean of its parts.

Assignments use Drake and Hamerly's adaptive bounds. Beside a part's entry the table
keeps, from one round to the next, an upper bound of its distance, the b next closest
entries with lower bounds in ascending order, and one outer bound for all others. When
entries have moved, every bound is widened by what its entry moved. If the upper bound is
below the z-th lower bound, only the z - 1 entries before it can be nearer; these are
compared, in exact whole numbers. If it is below none, all entries are, and the list is
made anew. b starts at an eighth of the entries and shrinks to the deepest place that a
round needed, but not below a sixty-fourth. Bounds are doubles with a margin above their
rounding, so what they decide is what whole numbers would; all else is verified in those.

A round is one narrow pass that writes vectors and bounds to the shared folder, and one
that adds up the parts of each entry: at most parts x 256 partial sums a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_few, saved, whole_row

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Relative margin of bounds, far above the rounding of doubles.
MARGIN = 1e-9
#: Parts whose distances to all entries are held at once.
AT_ONCE = 1024


def largest(width: int) -> int:
    """Components below this size are ints, and squared distances of `width` of them fit 64 bits."""
    return 2 ** ((62 - math.ceil(math.log2(max(width, 1)))) // 2 - 1)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (n, width) to entries (m, width), or to own entries (n, m, width)."""
    d = x[:, None, :] - (book[None] if book.ndim == 2 else book)
    return np.einsum("nmw,nmw->nm", d, d)


def _best(dist: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Columns in ascending order of (distance, entry)."""
    return np.lexsort((index, dist), axis=1)


def _roots(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of distances from exact squares."""
    root = np.sqrt(dist.astype(np.float64))
    return root * (1 - MARGIN), root * (1 + MARGIN) + 1e-300


class Part:
    """Bounds of n parts at one position: entry `a`, `upper`, `near` and `low` (n, b), `outer`, and how deep each looked."""

    def __init__(self, x: np.ndarray, book: np.ndarray, b: int):
        n, b = len(x), min(b, len(book) - 1)
        self.a, self.upper, self.outer = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        self.near, self.low, self.depth = np.zeros((n, b), np.int64), np.zeros((n, b)), np.full(n, -1, np.int64)
        self.rank(np.arange(n), x, book)

    def rank(self, rows: np.ndarray, x: np.ndarray, book: np.ndarray) -> None:
        """All entries compared, the list made anew."""
        b, every = self.near.shape[1], np.arange(len(book))
        for at in range(0, len(rows), AT_ONCE):
            r = rows[at:at + AT_ONCE]
            dist = distances(x[r], book)
            by = _best(dist, np.broadcast_to(every, dist.shape))[:, :b + 2]
            low, high = _roots(np.take_along_axis(dist, by, 1))
            self.a[r], self.upper[r] = by[:, 0], high[:, 0]
            self.near[r], self.low[r] = by[:, 1:b + 1], low[:, 1:b + 1]
            self.outer[r] = low[:, b + 1] if by.shape[1] > b + 1 else np.inf
        self.depth[rows] = -1

    def moved(self, by: np.ndarray) -> None:
        """Widens the bounds by how far each entry moved (upper bounds of it)."""
        self.upper = (self.upper + by[self.a]) * (1 + MARGIN)
        self.outer = self.outer - by.max(initial=0.0) - np.where(np.isfinite(self.outer), np.abs(self.outer), 0) * MARGIN
        low = self.low - by[self.near] - np.abs(self.low) * MARGIN
        bounds = np.concatenate([low, self.outer[:, None]], 1)
        bounds = np.minimum.accumulate(bounds[:, ::-1], 1)[:, ::-1]  # ascending again
        self.low, self.outer = bounds[:, :-1], bounds[:, -1]

    def assign(self, x: np.ndarray, book: np.ndarray) -> None:
        """The nearest entry of every part, as all distances would give it."""
        n, b = self.low.shape
        bounds = np.concatenate([self.low, self.outer[:, None]], 1)
        self.depth[:] = 0
        open_rows = np.flatnonzero(self.upper >= bounds[:, 0])
        if len(open_rows):  # first the distance itself in place of its bound
            exact = distances(x[open_rows], book[self.a[open_rows]][:, None, :])[:, 0]
            self.upper[open_rows] = _roots(exact)[1]
        below = self.upper[open_rows, None] < bounds[open_rows]
        z = np.where(below.any(1), below.argmax(1), b + 1)
        for depth in range(1, b + 1):  # only the entries before the bound can be as near
            r = open_rows[z == depth]
            if len(r):
                index = np.concatenate([self.a[r, None], self.near[r, :depth]], 1)
                dist = distances(x[r], book[index])
                by = _best(dist, index)
                low, high = _roots(np.take_along_axis(dist, by, 1))
                index = np.take_along_axis(index, by, 1)
                self.a[r], self.upper[r], self.near[r, :depth] = index[:, 0], high[:, 0], index[:, 1:]
                self.low[r, :depth] = np.minimum(low[:, 1:], bounds[r, depth, None])
                self.depth[r] = depth
        far = open_rows[z > b]
        if len(far):
            self.rank(far, x, book)

    def cut(self, b: int) -> None:
        """Keeps the first `b` of the list; the outer bound then covers the rest."""
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.low[:, b])
            self.near, self.low = self.near[:, :b], self.low[:, :b]


def _array(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


_STATE = "_a array<smallint>, _upper array<double>, _outer array<double>, _near array<smallint>, _low array<float>, _depth array<smallint>"
_FIELDS = (("a", pa.int16()), ("upper", pa.float64()), ("outer", pa.float64()), ("near", pa.int16()), ("low", pa.float32()), ("depth", pa.int16()))


def _assigned(rows: DataFrame, books: np.ndarray, moves: np.ndarray | None, b: int, new_b: int) -> DataFrame:
    """`_doc`, `_id`, `_x` and the bounds; from the bounds of the round before where `moves` says how far entries moved."""
    parts, entries, width = books.shape
    first = moves is None
    base = rows.select("_doc", "_id", "_x")
    schema = f"_doc {base.schema['_doc'].dataType.simpleString()}, _id {base.schema['_id'].dataType.simpleString()}, _x array<int>, {_STATE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = batch.num_rows
                x = _array(batch.column(2), parts * width).reshape(n, parts, width).astype(np.int64)
                done = []
                for p in range(parts):
                    own, book = np.ascontiguousarray(x[:, p]), books[p]
                    if first:
                        part = Part(own, book, b)
                    else:
                        part = Part.__new__(Part)
                        kept = min(b, entries - 1)
                        for (name, _), w in zip(_FIELDS, (1, 1, 1, kept, kept, 1), strict=True):
                            value = _array(batch.column(f"_{name}"), parts * w).reshape(n, parts, w)[:, p]
                            setattr(part, name, np.array(value if w == kept and name in ("near", "low") else value[:, 0]))
                        part.a, part.near, part.low = part.a.astype(np.int64), part.near.astype(np.int64), part.low.astype(np.float64)
                        part.moved(moves[p])
                        part.assign(own, book)
                    part.cut(min(new_b, entries - 1))
                    part.low = np.nextafter(part.low.astype(np.float32), np.float32(-np.inf))  # never above the bound
                    done.append(part)
                state = [_lists(np.stack([getattr(q, name).reshape(n, -1) for q in done], 1).reshape(n, -1), kind) for name, kind in _FIELDS]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *state],
                                                 names=["_doc", "_id", "_x", *(f"_{name}" for name, _ in _FIELDS)])

    source = base if first else rows.select("_doc", "_id", "_x", *(f"_{name}" for name, _ in _FIELDS))
    return source.mapInArrow(run, schema)


def _sums(rows: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and counts of the parts of every entry, added up in each task and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = _array(batch.column(0), parts * width).reshape(-1, width).astype(np.int64)
            at = (_array(batch.column(1), parts).astype(np.int64) + np.arange(parts) * entries).reshape(-1)
            by = np.argsort(at, kind="stable")
            found, start = np.unique(at[by], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(x[by], start, axis=0)
                count[found] += np.bincount(at, minlength=len(count))[found]
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), _lists(total[used], pa.int64())], names=["at", "n", "s"])

    added = rows.select("_x", "_a").mapInArrow(run, "at bigint, n bigint, s array<bigint>")
    sums = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    total, count = np.zeros((parts * entries, width), object), np.zeros(parts * entries, object)
    for r in added.groupBy("at").agg(F.sum("n").alias("n"), *sums).collect():  # parts x entries rows
        count[r.at], total[r.at] = r.n, [int(r[f"s{i}"]) for i in range(width)]
    return total, count


def books_sha256(books: np.ndarray) -> str:
    """Of all components by part, entry and position within the part, as decimal text joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows with `_doc`, `_code` (entry of each part) and `_error`, the codebooks (parts, entries, width)).

    Dropped are null vectors, those with a null or non-finite component, those whose length
    is not that of the one with the least id (which is the least length that `parts`
    divides, among equal ids), and those with a component beyond `largest`. With fewer kept
    vectors than `entries` the codebooks are that small. Null ids come last, equal ids in
    the order of their vectors; repeated rows each count and get a row. An empty table, or
    one where nothing is kept, gives no row and codebooks without entries.
    """
    value = F.transform(F.col(f"`{vector}`"), lambda v: v.cast("double"))
    rows = vectors.select(whole_row(vectors), F.col(f"`{vec_id}`").alias("_id"), value.alias("_v"))
    finite = F.forall("_v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where((F.size("_v") > 0) & (F.size("_v") % parts == 0) & finite)
    head = rows.orderBy(F.asc_nulls_last("_id"), F.size("_v")).select(F.size("_v").alias("n")).first()
    width = head.n // parts if head else 1
    fits = F.forall("_v", lambda v: F.abs(v * scale) < float(largest(width)))
    rows = rows.where((F.size("_v") == parts * width) & fits)
    rows = rows.select("_doc", "_id", F.transform("_v", lambda v: F.floor(v * scale).cast("int")).alias("_x"))
    rows = saved(rows, "vector-integers")
    starts = rows.orderBy(F.asc_nulls_last("_id"), "_x").limit(entries).select("_x").collect()
    books = np.array([r._x for r in starts], np.int64).reshape(len(starts), parts, width).transpose(1, 0, 2)
    entries = len(starts)
    if not entries:
        return rows.select("_doc", F.array().cast("array<smallint>").alias("_code"), F.lit(0).cast("bigint").alias("_error")), books
    b = new_b = max(1, entries // 8)
    moves = None
    for _ in range(rounds):
        rows = saved(_assigned(rows, books, moves, b, new_b), "vector-bounds")
        total, count = _sums(rows, parts, entries, width)
        new = books.copy().reshape(parts * entries, width)
        for at in np.flatnonzero(count):
            new[at] = [s // count[at] for s in total[at]]
        new = new.reshape(books.shape)
        # Lists of the table just written have new_b places; the deepest that was needed decides how many are kept.
        b = new_b
        deepest = rows.agg(F.max(F.array_max("_depth"))).first()[0]
        if moves is not None:
            new_b = max(1, entries // 64, min(b, deepest))
        moves = np.sqrt(((new - books).astype(np.float64) ** 2).sum(2)) * (1 + MARGIN)
        books = new
    last = _assigned(rows, books, moves, b, new_b)
    return _with_errors(last, books), books


def _with_errors(rows: DataFrame, books: np.ndarray) -> DataFrame:
    parts, _, width = books.shape
    own = rows.select("_doc", "_x", "_a")
    schema = f"_doc {own.schema['_doc'].dataType.simpleString()}, _code array<smallint>, _error bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = _array(batch.column(1), parts * width).reshape(n, parts, width).astype(np.int64)
            a = _array(batch.column(2), parts)
            d = x - np.stack([books[p][a[:, p]] for p in range(parts)], 1).reshape(n, parts, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array((d * d).sum((1, 2)))], names=["_doc", "_code", "_error"])

    return own.mapInArrow(run, schema)


def with_label_error(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with `_label_error`, the sum of `_error` over equal labels; null labels count as one.

    The sums are partial aggregates, so a label with most of the rows sends a row per
    task, and they are broadcast only if they are few.
    """
    rows = rows.withColumn("_label", F.col("_doc").getField(label))
    sums = saved(rows.groupBy("_label").agg(F.sum("_error").alias("_label_error")), "label-errors")
    sums = broadcast_if_few(sums.withColumnRenamed("_label", "_of"))
    return rows.join(sums, F.col("_label").eqNullSafe(F.col("_of")), "left").drop("_label", "_of")
