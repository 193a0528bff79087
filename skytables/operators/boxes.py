"""RA/Dec boxes, single and many. All bounds are inclusive.

A box with `ra_min > ra_max` crosses RA 0/360. `ra_max = 360` means 360.
"""

from __future__ import annotations

import math
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.angles import wrap_ra
from ..functions.times import ntz, unix_micros
from ..schema import folded
from .dyadic import cell_of as time_cell, cells_of, each_level, in_use, level_of
from .skew import HOT_ROWS, MAX_TASKS, TASK_PAIRS, attach_hot, grid_join, hot_keys, is_small, join_work
from .sky_join import box_level, cover, place


#: Boxes that a task of `boxes_sso` meets, about, and cells of a box in it: they are held in memory.
TASK_BOXES, BOX_CELLS = 50_000, 12


class Box(NamedTuple):
    ra_min: float
    ra_max: float
    dec_min: float
    dec_max: float


def check_box(box: Box) -> Box:
    if box.dec_min > box.dec_max:
        raise ValueError("dec_min must not exceed dec_max")
    return box


def moment(value: datetime | str) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def check_times(t_min, t_max) -> None:
    if moment(t_min) > moment(t_max):
        raise ValueError("t_min must not exceed t_max")


def in_box(box: Box, ra: str = "ra_deg", dec: str = "dec_deg") -> Column:
    """The box as one predicate, also across RA 0/360; plain comparisons reach the Parquet scan."""
    check_box(box)
    lo, hi = F.lit(float(box.ra_min)), F.lit(float(box.ra_max))
    ra_ok = F.col(ra).between(lo, hi) if box.ra_min <= box.ra_max else (F.col(ra) >= lo) | (F.col(ra) <= hi)
    return ra_ok & F.col(dec).between(F.lit(float(box.dec_min)), F.lit(float(box.dec_max)))


def in_times(t_min, t_max, time: str = "time") -> Column:
    check_times(t_min, t_max)
    return F.col(time).between(ntz(t_min), ntz(t_max))


def box_fixed(fixed: DataFrame, box: Box) -> DataFrame:
    return fixed.where(in_box(box))


def _named(boxes: DataFrame) -> DataFrame:
    return folded(boxes, "box_id", "ra_min", "ra_max", "dec_min", "dec_max", "t_min", "t_max")


def split_boxes(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected with `reason`). RA order is free: it says whether the box wraps."""
    boxes = _named(boxes)
    no_bounds = (
        F.col("ra_min").isNull() | F.col("ra_max").isNull() | F.col("dec_min").isNull() | F.col("dec_max").isNull()
    )
    reason = F.when(no_bounds, F.lit("missing bound")).when(
        F.col("dec_min") > F.col("dec_max"), F.lit("dec_min > dec_max"))
    if {"t_min", "t_max"} <= set(boxes.columns):
        reason = reason.when(F.col("t_min").isNull() | F.col("t_max").isNull(), F.lit("missing time"))
        reason = reason.when(F.col("t_min") > F.col("t_max"), F.lit("t_min > t_max"))
    marked = boxes.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def _sized(boxes: DataFrame, timed: bool) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """Usable boxes with their level on the sky (`_sky`), with times also that in time (`_level`), and the levels in use."""
    wraps, odd = F.col("ra_min") > F.col("ra_max"), (F.col("ra_max") < 0) | (F.col("ra_min") > 360)
    span = F.when(wraps, F.when(odd, F.lit(360.0)).otherwise(F.col("ra_max") + 360.0 - F.col("ra_min"))).otherwise(F.col("ra_max") - F.col("ra_min"))
    span = F.least(F.lit(360.0), span)
    sized = split_boxes(boxes)[0].withColumn("_span", span)
    sized = sized.withColumn("_sky", box_level(F.col("_span"), F.col("dec_min"), F.col("dec_max")))
    if not timed:
        return sized, in_use(sized, F.col("_sky"))
    sized = sized.withColumn("_level", level_of(unix_micros(F.col("t_max")) - unix_micros(F.col("t_min")), 2))
    return sized, in_use(sized, F.col("_sky"), F.col("_level"))


def _in_cells(points: DataFrame, sized: DataFrame, levels: list[tuple[int, ...]], timed: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points with their cell on each level in use, boxes with each cell that they touch, and the names of the keys."""
    keys = ["_sky", "_zone", "_cell"]
    looked = points.where(F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull())
    if timed:
        cells = cells_of(unix_micros(F.col("t_min")), unix_micros(F.col("t_max")), F.col("_level"))
        sized = sized.withColumn("_tcell", F.explode(cells))
        looked = looked.where(F.col("time").isNotNull()).withColumn("_at", F.explode(each_level(levels, "sky", "level")))
        looked = looked.withColumn("_sky", F.col("_at.sky")).withColumn("_level", F.col("_at.level")).drop("_at")
        looked = looked.withColumn("_tcell", time_cell(unix_micros(F.col("time")), F.col("_level")))
        keys += ["_level", "_tcell"]
    else:
        looked = looked.withColumn("_at", F.explode(each_level(levels, "sky"))).withColumn("_sky", F.col("_at.sky")).drop("_at")
    low = F.when(F.abs("ra_min") < 1e6, wrap_ra(F.col("ra_min"))).otherwise(F.lit(0.0))
    covered = cover(sized, low, low + F.col("_span"), F.col("dec_min"), F.col("dec_max"), F.col("_sky")).drop("_span")
    return place(looked, "ra_deg", "dec_deg", F.col("_sky")), covered, keys


def _inside(timed: bool) -> Column:
    ra = F.col("ra_deg")
    ra_ok = F.when(F.col("ra_min") <= F.col("ra_max"), ra.between(F.col("ra_min"), F.col("ra_max"))).otherwise(
        (ra >= F.col("ra_min")) | (ra <= F.col("ra_max")))
    inside = ra_ok & F.col("dec_deg").between(F.col("dec_min"), F.col("dec_max"))
    return inside & F.col("time").between(F.col("t_min"), F.col("t_max")) if timed else inside


def match_boxes(points: DataFrame, boxes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every (point, box) with the point inside; with `t_min`/`t_max` also inside its times.

    A box is repeated for the sky cells it touches on the level of its own size, at most
    MAX_CELLS, and with times for the three time cells at most that it touches on the level of
    its length. A point looks into the levels that some box is on: (level, cell) of sky and
    time are one key, so boxes of other days are no candidates. Boxes measured to be few
    are broadcast, and the points are not shuffled; else crowded keys are split on both sides.
    """
    boxes = _named(boxes)
    timed = "t_min" in boxes.columns and "time" in points.columns
    placed, covered, keys = _in_cells(points, *_sized(boxes, timed), timed)
    return grid_join(placed, covered, keys, _inside(timed), hot_rows).drop(*keys)


def boxes_fixed(fixed: DataFrame, boxes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    boxes = _named(boxes)
    bounds = [c for c in boxes.columns if c not in ("t_min", "t_max")]
    return match_boxes(fixed, boxes.select(*bounds), hot_rows)


def _number(key: str, n: int) -> Column:
    """0 .. n-1, the same for equal values of either side's type."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)).cast("int")


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _dealt_pairs(ssos: DataFrame, points: DataFrame, sized: DataFrame, levels: list[tuple[int, ...]], task_pairs: int) -> DataFrame:
    """`boxes_sso` with every pair of a chunk of the objects and a part of the boxes in one task.

    Points and boxes are dealt as they are, and repeated for their cells within the task. All hits of a pair
    are then in one task, which keeps one of them, so that hits and pairs are never shuffled.
    """
    placed, covered, keys = _in_cells(points, sized, levels, True)
    # Few pairs to a task, since it holds those found; parts and chunks such that either side is repeated about as much.
    work = join_work(placed, covered, keys, HOT_ROWS, task_pairs)
    tasks = max(min(MAX_TASKS, int(work.pairs // task_pairs) + 1), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_boxes, n_points = sized.count(), max(1, points.count())
    held = max(n_boxes, covered.count() / BOX_CELLS)
    parts = max(math.ceil(held / TASK_BOXES), min(tasks, round((tasks * n_boxes / n_points) ** 0.5)))
    chunks = math.ceil(tasks / parts)

    def dealt(df: DataFrame, chunk: Column, part: Column) -> DataFrame:
        df = df.withColumn("_chunk", chunk).withColumn("_part", part)
        task = F.col("_chunk") * F.lit(parts) + F.col("_part")
        return df.withColumn("_task", task).drop("_chunk", "_part").repartitionById(chunks * parts, F.col("_task"))

    wanted = sized.select("box_id", "ra_min", "ra_max", "dec_min", "dec_max", "t_min", "t_max", "_span", "_sky", "_level")
    placed, covered, keys = _in_cells(
        dealt(points, _number("sso_id", chunks), _each(parts)), dealt(wanted, _each(chunks), _number("box_id", parts)), levels, True)
    # One short key; where two cells share it, the exact test and `distinct` follow.
    placed, covered = (df.withColumn("_key", F.xxhash64(*keys)).drop(*keys) for df in (placed, covered))
    covered = covered.withColumnsRenamed({"_task": "_on_task", "_key": "_on_key"}).hint("shuffle_hash")
    met = placed.join(covered, (F.col("_task") == F.col("_on_task")) & (F.col("_key") == F.col("_on_key")) & _inside(True))
    pairs = met.select("_task", "box_id", "sso_id").distinct()
    objects = dealt(ssos, _number("sso_id", chunks), _each(parts)).hint("shuffle_hash")
    return pairs.join(objects, ["_task", "sso_id"]).drop("_task")


def boxes_sso(
    ssos: DataFrame, points: DataFrame, boxes: DataFrame, hot_rows: int = HOT_ROWS, task_pairs: int = TASK_PAIRS
) -> DataFrame:
    """(box_id, object) for objects with at least one point in the box and its times, each once.

    With few boxes, pairs are made distinct where they are found, so an object with very many
    points in a box sends one row per task. With more, the pairs are as many as objects times
    boxes allow, and are found whole in one task each (`_dealt_pairs`); only an object with
    more than `hot_rows` points is left to the first way.
    """
    boxes = _named(boxes)
    points = points.select("sso_id", "time", "ra_deg", "dec_deg")

    def found(some: DataFrame) -> DataFrame:
        return match_boxes(some, boxes, hot_rows).select("box_id", "sso_id").distinct().join(ssos, "sso_id")

    if "t_min" not in boxes.columns:
        return found(points)
    sized, levels = _sized(boxes, True)
    if is_small(_in_cells(points, sized, levels, True)[1]):
        return found(points)
    hot = hot_keys(points, ["sso_id"], hot_rows)
    if hot is None:
        return _dealt_pairs(ssos, points, sized, levels, task_pairs)
    marked = attach_hot(points, hot, ["sso_id"])
    usual, crowded = (marked.where(cond).drop("n_rows") for cond in (F.col("n_rows").isNull(), F.col("n_rows").isNotNull()))
    return _dealt_pairs(ssos, usual, sized, levels, task_pairs).unionByName(found(crowded))
