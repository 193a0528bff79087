"""JPL Horizons ephemeris Parquet."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.angles import wrap_ra
from ..functions.times import jd_to_time
from ..functions.values import optional_flux, parse_designation
from ..operators.maintain import ephem_rows, sso_id_of
from ..operators.numbering import number_rows
from ..operators.skew import broadcast_if_small, is_small, saved
from ..schema import SOLARSYSTEM_OBJECTS, conform, require_columns

REQUIRED = {"designation", "julian_day", "ra_deg", "dec_deg"}
#: File order, as the Parquet reader tells it.
FILE_ORDER = ["file_path", "row_index"]


class Ephemerides(NamedTuple):
    ssos: DataFrame
    points: DataFrame
    rejected: DataFrame


def read_jpl(spark: SparkSession, path: str) -> DataFrame:
    """The file's rows with their place in it (`file_path`, `row_index`)."""
    rows = spark.read.parquet(path)
    require_columns(rows, REQUIRED, path)
    return rows.select("*", "_metadata.file_path", "_metadata.row_index")


def downsample(rows: DataFrame, key: str, every: int, order: list[str]) -> DataFrame:
    """Every n-th row of each group in the given order, starting with the first."""
    if every < 1:
        raise ValueError("downsample must be at least 1")
    if every == 1:
        return rows
    numbered = number_rows(rows, [key], order, "_rn")
    return numbered.where((F.col("_rn") - 1) % every == 0).drop("_rn")


def ingest_jpl(
    rows: DataFrame, every: int = 1, order: list[str] | None = None, name_mode: str = "rest", monitored: bool = True,
    unique_names: bool | None = None,
) -> Ephemerides:
    """Objects and ephemeris points of `designation, julian_day, ra_deg, dec_deg[, flux_mJy]`.

    `order` names the columns that give file order (its last one a row index);
    rows of `read_jpl` have them. `name_mode='second_token', monitored=False` is
    the second form of this ingest. Rows without a designation are rejected, and so are
    all rows of a name that comes with different MPC ids, as an object has one. The second
    form cuts names short, so that different objects often share one; there this is
    checked only if `unique_names` is set.
    """
    require_columns(rows, REQUIRED)
    order = order or FILE_ORDER
    if every > 1:
        require_columns(rows, set(order), "downsampled input")
    mpc_id, name = parse_designation(F.col("designation"), name_mode)
    shaped = rows.withColumn("flux_mJy", optional_flux(rows)).withColumn("MPC_id", mpc_id).withColumn("name", name)
    unnamed = shaped.where(F.col("name").isNull())
    named = shaped.where(F.col("name").isNotNull())
    mpc = F.col("MPC_id")
    unique_names = name_mode != "second_token" if unique_names is None else unique_names
    torn = (F.min(mpc) != F.max(mpc)) | ((F.count(mpc) > 0) & (F.count(mpc) < F.count(F.lit(1))))
    keys = ["name"] if unique_names else ["name", "MPC_id"]
    objects = named.groupBy(*keys).agg(*([F.min(mpc).alias("MPC_id")] if unique_names else []), F.coalesce(torn, F.lit(False)).alias("torn"))
    objects = saved(objects, "jpl-objects")
    ssos = objects.where("not torn").select("name", "MPC_id", sso_id_of(F.col("name")).alias("sso_id"), F.lit(monitored).alias("monitored"))
    torn_names = objects.where("torn").select("name")
    clashing = named.limit(0)
    if unique_names and torn_names.take(1):
        small = is_small(torn_names)
        clashing = named.join(broadcast_if_small(torn_names, small), "name", "left_semi")
        named = named.join(broadcast_if_small(torn_names, small), "name", "left_anti")
    kept = downsample(named, "designation", every, order)
    points, faulty = ephem_rows(kept.select(
        sso_id_of(F.col("name")).alias("sso_id"), "MPC_id", "name", jd_to_time(F.col("julian_day")).alias("time"),
        wrap_ra(F.col("ra_deg")).alias("ra_deg"), "dec_deg", "flux_mJy"))
    rejected = unnamed.select(
        F.lit(None).cast("string").alias("name"), jd_to_time(F.col("julian_day")).alias("time"), "ra_deg", "dec_deg",
        F.lit("no designation").alias("reason"))
    rejected = rejected.unionByName(clashing.select(
        "name", jd_to_time(F.col("julian_day")).alias("time"), "ra_deg", "dec_deg", F.lit("name with several MPC ids").alias("reason")))
    return Ephemerides(conform(ssos, SOLARSYSTEM_OBJECTS), points,
                       rejected.unionByName(faulty.select(*rejected.columns)))
