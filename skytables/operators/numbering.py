"""Row numbers within a group, and copies of equal rows, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .skew import HOT_ROWS, attach_hot, hot_keys


def number_rows(
    df: DataFrame, keys: list[str], position: list[str], out: str, slice_rows: int = HOT_ROWS
) -> DataFrame:
    """1, 2, 3, ... within `keys` in the order of `position`.

    The last `position` column is a whole number that is unique within the
    others (a row index, or file path and row index). It cuts every group into
    slices of at most `slice_rows` rows: rows are numbered inside their slice,
    and the slice's offset is the running count of the slices before it.
    """
    head, last = position[:-1], position[-1]
    part = [*keys, "_slice"]
    block = F.floor(F.col(last) / F.lit(slice_rows)).cast("bigint")
    sliced = df.withColumn("_slice", F.struct(*head, block.alias("block")))
    rows = sliced.withColumn(
        "_in_slice", F.row_number().over(Window.partitionBy(*part).orderBy(*position)).cast("bigint")
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(c).alias(f"_o{c}") for c in part], "_offset")
    )
    cond = F.lit(True)
    for c in part:
        cond = cond & rows[c].eqNullSafe(offsets[f"_o{c}"])
    return (
        rows.join(offsets, cond)
        .withColumn(out, F.col("_in_slice") + F.col("_offset"))
        .drop("_slice", "_in_slice", "_offset", *[f"_o{c}" for c in part])
    )


def _pieces(counted: DataFrame, hot: DataFrame, keys: list[str], rest: list[str], block: int) -> DataFrame:
    """`counted` with `_piece`: rows of a hot key cut into consecutive pieces of about half `block` rows.

    The cuts are values of the key's own rows, every n-th of a sample taken by
    hash, so that a recomputed task puts each row into the same piece.
    """
    every = max(1, block // 64)
    step = max(1, block // (2 * every))
    row = F.struct(*rest)
    marked = attach_hot(counted, hot, keys)
    sample = marked.where(F.col("n_rows").isNotNull() & (F.pmod(F.xxhash64(*rest), F.lit(every)) == 0))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))
    cuts = (
        sample.select(*keys, *rest).withColumn("_nth", nth).where(F.col("_nth") % step == 0)
        .groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_cuts"))
    )
    cuts = cuts.select(*[F.col(k).alias(f"_c{k}") for k in keys], "_cuts")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    halves = F.array(*[F.lit(1 << b) for b in range(24, -1, -1)])
    below = F.aggregate(
        halves, F.lit(0),
        lambda n, h: F.when((n + h <= F.size("_cuts")) & (F.get("_cuts", n + h - 1) <= row), n + h).otherwise(n))
    return (
        marked.join(cuts, cond, "left")
        .withColumn("_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(below))
        .select(*counted.columns, "_piece")
    )


def number_occurrences(df: DataFrame, keys: list[str], out: str, block: int = HOT_ROWS) -> DataFrame:
    """Rows with equal `keys` numbered 1, 2, 3, ... in the order of their other columns; equal rows follow each other.

    Equal rows are counted (map-side combined) and written out again from the count,
    so a group of copies never has to meet in one task; where it has more than
    `block` rows it is written out in blocks that are spread over the cluster.
    A key with more than `block` rows is cut into pieces, summed up piece by piece.
    """
    cols = df.columns
    rest = [c for c in cols if c not in keys]
    before = Window.partitionBy(*keys).orderBy(*(rest or keys)).rowsBetween(Window.unboundedPreceding, -1)
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(df, keys, block) if rest else None
    if hot is None:
        counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    else:
        cut = _pieces(counted, hot, keys, rest, block)
        inside = Window.partitionBy(*keys, "_piece").orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
        sums = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            cut.groupBy(*keys, "_piece").agg(F.sum("_n").alias("_sum"))
            .withColumn("_offset", F.coalesce(F.sum("_sum").over(sums), F.lit(0)))
            .select(*[F.col(k).alias(f"_o{k}") for k in [*keys, "_piece"]], "_offset")
        )
        cond = F.lit(True)
        for k in [*keys, "_piece"]:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_o{k}"))
        counted = (
            cut.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
            .join(offsets, cond)
            .select(*cols, "_n", (F.col("_inside") + F.col("_offset")).alias("_before"))
        )

    def write_out(groups: DataFrame, first, last) -> DataFrame:
        return groups.withColumn(out, F.explode(F.sequence(first, last))).withColumn(out, F.col(out) + F.col("_before")).select(*cols, out)

    one, n = F.lit(1).cast("bigint"), F.col("_n")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / F.lit(block)).cast("bigint"))
    many = counted.where(n > block).withColumn("_block", F.explode(blocks)).repartition(*cols, "_block")
    start = F.col("_block") * block
    return write_out(counted.where(n <= block), one, n).unionByName(
        write_out(many, start + 1, F.least(n, start + block)))
