"""Ephemeris points as a folder per day with a manifest, changed a day at a time.

A manifest row names a day's folder, its number of points and the bounds of their times
and positions. A reader asks the manifest which folders a time range or box can need, so
a filter on time alone lists those days and no others. A change rewrites the days it
touches into a new generation and writes a manifest that names them beside the old
folders of all other days. The manifest is written last: if a job dies before that, the
generation before stays in force, and readers that have begun keep the files they list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.times import ntz
from ..operators import maintain
from ..operators.boxes import Box, check_times, in_box, in_times
from ..operators.skew import restrict, saved
from ..schema import MOVING_SOURCES, conform

_BOUNDS = {"time": "timestamp_ntz", "ra_deg": "double", "dec_deg": "double"}
_ENTRY = ["generation", "day", "folder", "n_rows", *[f"{c}_{side}" for c in _BOUNDS for side in ("min", "max")]]


def manifest(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    """The entries of a generation, the latest by default: a row a day."""
    every = spark.read.parquet(f"{path}/manifest")
    number = every.agg(F.max("of")).first()[0] if generation is None else generation
    return every.where((F.col("of") == number) & F.col("folder").isNotNull()).drop("of")


def _number(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/manifest").agg(F.max("of")).first()[0]


def _commit(spark: SparkSession, path: str, number: int, table: DataFrame, kept: DataFrame | None) -> None:
    """Writes the days of `table` as generation `number`, with the `kept` entries of all other days."""
    data = f"{path}/points/g{number:06d}"
    table = conform(table, MOVING_SOURCES, keep_ids=True).withColumn("day", F.to_date("time"))
    ordered = table.repartitionByRange("day", "sso_id", "time").sortWithinPartitions("day", "sso_id", "time")
    ordered.write.partitionBy("day").parquet(data)
    written = spark.read.schema(table.schema).parquet(data)
    entries = written.groupBy("day").agg(F.count(F.lit(1)).alias("n_rows"), *[
        f(c).alias(f"{c}_{side}") for c in _BOUNDS for side, f in (("min", F.min), ("max", F.max))])
    entries = entries.select(
        F.lit(number).alias("generation"), "day", F.concat(F.lit(f"{data}/day="), F.col("day").cast("string")).alias("folder"), *_ENTRY[3:])
    if kept is not None:
        entries = kept.select(*_ENTRY).unionByName(entries)
    # A row a day, and one without a folder, so that a generation without points is there too.
    head = spark.range(1).select(*[F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in _ENTRY])
    entries.select(*_ENTRY).unionByName(head).coalesce(1).write.parquet(f"{path}/manifest/of={number}")


def write_points(points: DataFrame, path: str) -> None:
    """All points as the first generation of a new folder."""
    _commit(points.sparkSession, path, 1, points, None)


def read_points(spark: SparkSession, path: str, t_min=None, t_max=None, box: Box | None = None, generation: int | None = None, ids: str = "string") -> DataFrame:
    """Points in a time range and box, from only the folders whose bounds meet them.

    A box across RA 0/360 is looked up by Dec alone. `ids` is the type that ids were written with.
    """
    entries, rows_in = manifest(spark, path, generation), F.lit(True)
    if t_min is not None or t_max is not None:
        t_min, t_max = t_min or "0001-01-01 00:00:00", t_max or "9999-12-31 00:00:00"
        check_times(t_min, t_max)
        entries = entries.where((F.col("time_max") >= ntz(t_min)) & (F.col("time_min") <= ntz(t_max)))
        rows_in = rows_in & in_times(t_min, t_max)
    if box is not None:
        entries = entries.where((F.col("dec_deg_max") >= box.dec_min) & (F.col("dec_deg_min") <= box.dec_max))
        if box.ra_min <= box.ra_max:
            entries = entries.where((F.col("ra_deg_max") >= box.ra_min) & (F.col("ra_deg_min") <= box.ra_max))
        rows_in = rows_in & in_box(box)
    return _days(spark, entries, ids).where(rows_in)


def _days(spark: SparkSession, entries: DataFrame, ids: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {ids if f.name in ('ephem_id', 'sso_id') else f.dataType.simpleString()}" for f in MOVING_SOURCES.fields)
    folders = sorted(r.folder for r in entries.select("folder").collect())  # a row a day of the range
    return spark.read.schema(kinds).parquet(*folders) if folders else spark.createDataFrame([], kinds)


Step = Callable[[DataFrame], "maintain.Change | maintain.Insert"]


def _change(spark: SparkSession, path: str, days: DataFrame, step: Step, ids: str):
    """Applies `step` to the points of `days` and writes the days that then have points."""
    entries = saved(manifest(spark, path), "entries")
    days = saved(days.where(F.col("day").isNotNull()).distinct(), "days")
    done = step(_days(spark, entries.join(days, "day", "left_semi"), ids))
    _commit(spark, path, _number(spark, path) + 1, done.table, entries.join(days, "day", "left_anti"))
    return done


def _days_of(spark: SparkSession, path: str, keys: DataFrame, ids: str) -> DataFrame:
    """Days on which one of these points is stored; reads two columns of the points."""
    stored = read_points(spark, path, ids=ids).select("ephem_id", F.to_date("time").alias("day"))
    wanted = keys.select(F.col("ephem_id").cast(ids).alias("ephem_id")).distinct()
    return restrict(stored, wanted, ["ephem_id"]).join(wanted, "ephem_id", "left_semi").select("day")


def insert_points(spark: SparkSession, path: str, ssos: DataFrame, rows: DataFrame, ids: str = "string") -> maintain.Insert:
    """`insert_ephem` on the days of the new points. Ids given by the caller are held against those days only."""
    return _change(spark, path, rows.select(F.to_date("time").alias("day")), lambda t: maintain.insert_ephem(t, ssos, rows), ids)


def update_points(spark: SparkSession, path: str, updates: DataFrame, ids: str = "string", **options) -> maintain.Change:
    """`update_ephem` on the days of the points and of their new times."""
    days = _days_of(spark, path, updates, ids)
    if "time" in updates.columns:
        days = days.union(updates.select(F.to_date("time")))
    return _change(spark, path, days, lambda t: maintain.update_ephem(t, updates, **options), ids)


def delete_points(spark: SparkSession, path: str, keys: DataFrame, ids: str = "string") -> maintain.Change:
    return _change(spark, path, _days_of(spark, path, keys, ids), lambda t: maintain.delete(t, keys, "ephem_id"), ids)


def delete_objects(spark: SparkSession, path: str, keys: DataFrame, ids: str = "string") -> maintain.Change:
    """Removes the points of these objects (`sso_id`), on the days that they have any."""
    wanted = keys.select(F.col("sso_id").cast(ids).alias("sso_id")).distinct()
    stored = read_points(spark, path, ids=ids).select("sso_id", F.to_date("time").alias("day"))
    days = restrict(stored, wanted, ["sso_id"]).join(wanted, "sso_id", "left_semi").select("day")
    return _change(spark, path, days, lambda t: maintain.delete(t, keys, "sso_id"), ids)
