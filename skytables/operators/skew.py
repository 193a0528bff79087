"""Guards for hot keys and for broadcasts.

One object, name, cell or group of copies may hold a large share of all rows.
Joins split such keys with a salt; windows split them into slices
(`numbering.py`, `ephemeris.py`). A side is broadcast only after its size was
measured.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import shared_folder

#: Above this many rows a key is split.
HOT_ROWS = 2_000_000
#: A side is broadcast only when it was measured to be no larger.
BROADCAST_BYTES = 32 * 1024 * 1024
#: At most this many hot keys are listed on the driver; with more, the list stays a table.
MAX_HOT_KEYS = 10_000
#: Rows of a key just at HOT_ROWS that the hot-key sample is expected to hold.
SAMPLED_ROWS = 1_000
#: Pairs of rows with equal keys that a task of a grid join tests, about.
TASK_PAIRS = 30_000_000
#: Share of the rows on which the pairs of a grid join are counted.
PAIRS_SHARE = 0.02
#: At most this many tasks are asked for.
MAX_TASKS = 20_000


def _row_bytes(df: DataFrame) -> Column:
    size = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) + 64
        else:
            size = size + 8
    return size


def measured_bytes(df: DataFrame) -> int:
    """Estimated size in memory, from one aggregate over the rows."""
    return df.agg(F.sum(_row_bytes(df).cast("bigint"))).first()[0] or 0


def is_small(df: DataFrame) -> bool:
    return measured_bytes(df) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, small: bool | None = None) -> DataFrame:
    """`df` with a broadcast hint if measured to fit, else as it is (shuffle join, AQE skew split).

    `small` passes on the answer for a table known to be no smaller than `df`.
    """
    return F.broadcast(df) if (is_small(df) if small is None else small) else df


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a costly result once to the shared folder and reads it back.

    Later uses do not compute it again, it survives lost executors, and Spark
    knows its size from the files when it picks a join.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def restrict(rows: DataFrame, wanted: DataFrame, keys: list[str], small: bool | None = None) -> DataFrame:
    """`rows` whose key is among `wanted`, if that list is small enough to broadcast; else all rows.

    A reduction only: it never shuffles `rows`, and the caller still joins.
    """
    listed = wanted.select(*keys).distinct()
    if not (is_small(listed) if small is None else small):
        return rows
    return rows.join(F.broadcast(listed), keys, "left_semi")


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with about `hot_rows` rows or more, with their estimated count `n_rows`; None if there are none.

    Counted on a sample, so that a key space as large as the data is not
    shuffled for it: at HOT_ROWS one row in 2,000. The estimate only decides how
    rows are spread, never which rows are used.
    """
    share = min(1.0, SAMPLED_ROWS / hot_rows)
    sampled = df.select(*keys) if share == 1.0 else df.select(*keys).sample(share, seed=17)
    estimate = (F.count(F.lit(1)) / F.lit(share)).cast("bigint")
    floor = hot_rows if share == 1.0 else hot_rows // 2
    counts = sampled.groupBy(*keys).agg(estimate.alias("n_rows")).where(F.col("n_rows") > floor)
    found = counts.limit(MAX_HOT_KEYS + 1).collect()
    if not found:
        return None
    if len(found) > MAX_HOT_KEYS:
        return saved(counts, "hot-keys")
    return F.broadcast(df.sparkSession.createDataFrame(found, counts.schema))


def attach_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with what `hot` says of its key, null for ordinary keys. Null keys count as equal."""
    renamed = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], *[c for c in hot.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
    return df.join(renamed, cond, "left").drop(*[f"_hot_{k}" for k in keys])


def spread(df: DataFrame, n: Column) -> Column:
    """0 .. n-1 by row values and input partition: copies of a row spread too, and a
    recomputed task gives the same numbers."""
    hashable = [F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), n)


def salted_join(
    rows: DataFrame,
    other: DataFrame,
    keys: list[str],
    how: str = "inner",
    condition: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi join in which the hot keys of `rows` are spread over several tasks.

    `how` is 'inner', 'left', 'left_semi' or 'left_anti'. The rows of `other`
    for a hot key are repeated once per salt; all other keys join as usual.
    `condition` is an optional further condition; apart from the keys the two
    sides must not share the names it uses.
    """
    hot = hot_keys(rows, keys, hot_rows)
    on = list(keys)
    if hot is not None:
        n_salts = F.ceil(F.col("n_rows") / F.lit(hot_rows)).cast("bigint")
        salt = F.coalesce(spread(rows, n_salts), F.lit(0)).cast("bigint")
        rows = attach_hot(rows, hot, keys).withColumn("_salt", salt).drop("n_rows")
        last = F.coalesce(n_salts, F.lit(1)).cast("bigint") - F.lit(1)
        other = (
            attach_hot(other, hot, keys)
            .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("n_rows")
        )
        on.append("_salt")
    if condition is None:
        return rows.join(other, on, how).drop("_salt")
    other = other.withColumnsRenamed({k: f"_on_{k}" for k in on})
    for k in on:
        condition = condition & (F.col(k) == F.col(f"_on_{k}"))
    return rows.join(other, condition, how).drop("_salt", *[f"_on_{k}" for k in on])


class Work(NamedTuple):
    pairs: float  # rows with equal keys, one of either side
    partitions: int  # input partitions of the first side
    blocks: DataFrame | None  # keys to be cut, with `_row_parts` and `_other_parts`
    counted: DataFrame  # the keys, with the rows `_m` and `_n` of either side


def join_work(rows: DataFrame, other: DataFrame, keys: list[str], hot_rows: int, task_pairs: int) -> Work:
    """How many pairs an equi join has to test, estimated on a sample, and the keys with too many for a task.

    A key is cut into blocks of at most about `hot_rows` rows of a side and `task_pairs` pairs, as
    square as its rows allow, so that they are repeated least. The estimate only decides how rows are spread.
    """
    share = 1.0 if hot_rows <= SAMPLED_ROWS else PAIRS_SHARE

    def counted(df: DataFrame, name: str) -> DataFrame:
        sampled = df.select(*keys, F.spark_partition_id().alias("_partition")).dropna(subset=keys)
        sampled = sampled if share == 1.0 else sampled.sample(share, seed=17)
        return sampled.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(share)).alias(name), F.max("_partition").alias(f"{name}_from"))

    both = counted(rows, "_m").join(counted(other, "_n").drop("_n_from"), keys, "full")
    both = saved(both.withColumns({"_m": F.coalesce("_m", F.lit(0.0)), "_n": F.coalesce("_n", F.lit(0.0))}), "join-work")
    m, n = F.col("_m"), F.col("_n")
    total = both.agg(F.sum(m * n).alias("pairs"), F.max("_m_from").alias("last")).first()
    side = F.lit(float(task_pairs) ** 0.5)

    def parts(own: Column, its: Column) -> Column:
        """Of a key with few rows on one side only the other is cut; else both, into parts of `side` rows."""
        by_pairs = F.when(own > side, own * F.least(its, side) / F.lit(float(task_pairs))).otherwise(F.lit(1.0))
        return F.ceil(F.greatest(F.lit(1.0), own / F.lit(float(hot_rows)), by_pairs)).cast("bigint")

    cut = (m * n > task_pairs) | (m > hot_rows) | (n > hot_rows)
    hot = both.where(cut).select(*keys, parts(m, n).alias("_row_parts"), parts(n, m).alias("_other_parts"))
    found = hot.limit(MAX_HOT_KEYS + 1).collect()
    if len(found) > MAX_HOT_KEYS:
        blocks = hot
    else:
        blocks = F.broadcast(rows.sparkSession.createDataFrame(found, hot.schema)) if found else None
    return Work(total.pairs or 0.0, (total.last or 0) + 1, blocks, both)


def grid_join(
    rows: DataFrame, other: DataFrame, keys: list[str], condition: Column | None = None, hot_rows: int = HOT_ROWS,
    task_pairs: int = TASK_PAIRS, work: Work | None = None,
) -> DataFrame:
    """Inner equi join for keys that may be hot on both sides.

    The pairs to be tested decide how many tasks there are. `other` is broadcast if measured
    to fit, and `rows` are dealt anew only where their partitions are too few for the pairs.
    Else a key with many rows becomes a grid of blocks (`join_work`): each side's rows are
    dealt into its own parts and repeated for the parts of the other, so that a task meets
    about `hot_rows` rows of a key from either side and `task_pairs` pairs at most. `condition`
    and names are as for `salted_join`; its cheapest tests go first. Null keys match nothing.
    """
    work = work or join_work(rows, other, keys, hot_rows, task_pairs)
    tasks = min(MAX_TASKS, int(work.pairs // task_pairs) + 1)
    if is_small(other):
        rows = rows.repartition(tasks) if tasks > work.partitions else rows
        other, on = F.broadcast(other), list(keys)
    else:
        on = list(keys)
        if work.blocks is not None:
            on += ["_row_part", "_other_part"]

            def cut(df: DataFrame, dealt: str, repeated: str) -> DataFrame:
                own, its = F.col(f"{dealt}s"), F.coalesce(F.col(f"{repeated}s"), F.lit(1).cast("bigint"))
                part = F.coalesce(spread(df, own), F.lit(0)).cast("bigint")
                df = attach_hot(df, work.blocks, keys).withColumn(dealt, part)
                every = F.sequence(F.lit(0).cast("bigint"), its - F.lit(1).cast("bigint"))
                return df.withColumn(repeated, F.explode(every)).drop("_row_parts", "_other_parts")

            rows, other = cut(rows, "_row_part", "_other_part"), cut(other, "_other_part", "_row_part")
        # By number, so that partitions of few bytes, whose rows meet many times, are not put together.
        n = max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        # As a merge: a side of few bytes made a broadcast later would leave the pairs to the tasks that wrote the other.
        rows, other = rows.repartition(n, *on), other.repartition(n, *on).hint("merge")
    other = other.withColumnsRenamed({k: f"_on_{k}" for k in on})
    match = F.lit(True) if condition is None else condition
    for k in on:
        match = match & (F.col(k) == F.col(f"_on_{k}"))
    return rows.join(other, match).drop("_row_part", "_other_part", *[f"_on_{k}" for k in on])


def dimension_join(
    rows: DataFrame, other: DataFrame, keys: list[str], how: str, small: bool | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Joins `rows` to a side with one row per key: broadcast if measured to fit, else salted."""
    if is_small(other) if small is None else small:
        return rows.join(F.broadcast(other), keys, how)
    return salted_join(rows, other, keys, how, hot_rows=hot_rows)
