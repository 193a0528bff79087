"""Fixed and moving sources together.

An object is chosen by a point inside the box, and is then described and
interpolated over *all* its points in the time range; fixed sources ignore the
time range. `kind` is 'fixed' or 'sso'; order by it to list fixed sources first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import ntz
from ..operators.boxes import Box, in_box, in_times, moment
from ..operators.ephemeris import (
    FIXED_T_MAX, FIXED_T_MIN, coverage_aggs, fixed_at, fixed_at_times, object_states, positions_for, positions_from_states,
    with_point_in,
)
from ..operators.lookups import flagged
from ..operators.skew import restrict


def _fixed_part(fixed: DataFrame) -> DataFrame:
    return fixed.select(
        F.lit("fixed").alias("kind"), F.col("source_id").cast("string").alias("id"), "name",
        F.lit(None).cast("bigint").alias("MPC_id"), "ra_deg", "dec_deg", "flux_mJy", "monitored", "pointing",
        ntz(FIXED_T_MIN).alias("t_min"), ntz(FIXED_T_MAX).alias("t_max"),
        F.lit(None).cast("bigint").alias("n_points"), F.col("flux_mJy").isNotNull().alias("do_flux"))


def _moving_part(ssos: DataFrame, points: DataFrame, hit: Column | None) -> DataFrame:
    """Objects with their coverage. One scan of the points: whether a point is in the
    box is aggregated beside the coverage, so the points are never joined."""
    aggs = coverage_aggs() if hit is None else [*coverage_aggs(), F.bool_or(hit).alias("_hit")]
    covered = points.groupBy("sso_id").agg(*aggs)
    if hit is not None:
        covered = covered.where("_hit").drop("_hit")
    none = F.lit(None).cast("double")
    return ssos.join(covered, "sso_id").select(
        F.lit("sso").alias("kind"), F.col("sso_id").cast("string").alias("id"), "name", "MPC_id",
        none.alias("ra_deg"), none.alias("dec_deg"), none.alias("flux_mJy"), "monitored", "pointing",
        "t_min", "t_max", "n_points", "do_flux")


def get_box(fixed: DataFrame, ssos: DataFrame, points: DataFrame, box: Box, t_min, t_max) -> DataFrame:
    """Everything inside a box during a time range, with the bounds in which each can be evaluated."""
    inside = points.where(in_times(t_min, t_max))
    return _fixed_part(fixed.where(in_box(box))).unionByName(_moving_part(ssos, inside, in_box(box)))


def flagged_sources(
    fixed: DataFrame, ssos: DataFrame, points: DataFrame, flag: str, t_min, t_max, box: Box | None = None
) -> DataFrame:
    """Sources with the flag set, moving ones if they have a point in the time range (and box)."""
    chosen = flagged(fixed, flag)
    if box is not None:
        chosen = chosen.where(in_box(box))
    inside = points.where(in_times(t_min, t_max))
    return _fixed_part(chosen).unionByName(
        _moving_part(flagged(ssos, flag), inside, None if box is None else in_box(box)))


def monitored_sources(fixed, ssos, points, t_min, t_max, box: Box | None = None) -> DataFrame:
    return flagged_sources(fixed, ssos, points, "monitored", t_min, t_max, box)


def pointing_sources(fixed, ssos, points, t_min, t_max, box: Box | None = None) -> DataFrame:
    return flagged_sources(fixed, ssos, points, "pointing", t_min, t_max, box)


def box_at_time(
    fixed: DataFrame, ssos: DataFrame, points: DataFrame, box: Box, t_min, t_max, t, *,
    ra_mode: str = "linear", check_duplicates: bool = True,
) -> DataFrame:
    """`get_box` evaluated at one time: position, flux and status of each source.

    For the duplicate check, points of objects outside the box are left out of
    the shuffle where the objects inside are few enough to broadcast.
    """
    inside = points.where(in_times(t_min, t_max))
    if check_duplicates:
        inside = restrict(inside, inside.where(in_box(box)), ["sso_id"])
    states = object_states(inside, t, hit=in_box(box), check_duplicates=check_duplicates)
    moving = positions_from_states(states, t, ra_mode).join(ssos.select("sso_id", "name"), "sso_id").select(
        F.lit("sso").alias("kind"), F.col("sso_id").cast("string").alias("id"), "name",
        "ra_deg", "dec_deg", "flux_mJy", "status")
    placed = fixed_at(fixed.where(in_box(box)), t, keep=["name"]).select(
        F.lit("fixed").alias("kind"), F.col("source_id").cast("string").alias("id"), "name",
        "ra_deg", "dec_deg", "flux_mJy", "status")
    return placed.unionByName(moving)


def _at_times(fixed: DataFrame, ssos: DataFrame, points: DataFrame, times: list, options: dict) -> DataFrame:
    """Chosen sources at each distinct time of a list the caller typed."""
    times = list(dict.fromkeys(moment(t) for t in times))
    placed = fixed_at_times(fixed, times, keep=["name"]).select(
        F.lit("fixed").alias("kind"), F.col("source_id").cast("string").alias("id"), "name", "time", "ra_deg", "dec_deg", "flux_mJy", "status")
    chosen = ssos.select("sso_id", "name")
    asked = chosen.select("sso_id", F.explode(F.array(*[ntz(t) for t in times])).alias("time"))
    moving = positions_for(points, asked, **options).join(chosen, "sso_id").select(
        F.lit("sso").alias("kind"), F.col("sso_id").cast("string").alias("id"), "name", "time", "ra_deg", "dec_deg", "flux_mJy", "status")
    return placed.unionByName(moving)


def box_at_times(
    fixed: DataFrame, ssos: DataFrame, points: DataFrame, box: Box, t_min, t_max, times: list, **options,
) -> DataFrame:
    """`get_box` evaluated at each of several times; `options` are those of `positions_for`."""
    inside = points.where(in_times(t_min, t_max))
    return _at_times(fixed.where(in_box(box)), with_point_in(ssos, inside, in_box(box)), inside, times, options)


def flagged_at_times(
    fixed: DataFrame, ssos: DataFrame, points: DataFrame, flag: str, t_min, t_max, times: list, box: Box | None = None, **options,
) -> DataFrame:
    """`flagged_sources` evaluated at each of several times."""
    inside = points.where(in_times(t_min, t_max))
    chosen = flagged(fixed, flag) if box is None else flagged(fixed, flag).where(in_box(box))
    return _at_times(chosen, with_point_in(flagged(ssos, flag), inside, F.lit(True) if box is None else in_box(box)), inside, times, options)
