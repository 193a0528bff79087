"""Moving sources: coverage, segments between points, position and flux at given times.

Between two points an object moves on a straight line in (RA, Dec, flux) over
time. Only the points handed in count: bounds, completeness of flux and the
neighbours of a point all refer to them, so filter by time first.

status values: `ok`, `out_of_range`, `too_few_points` (one point only),
`duplicate_times` (two points of the object share a time), `unknown`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.angles import wrap_ra
from ..functions.times import ntz, unix_micros
from ..functions.values import zero_to_null
from .boxes import Box, in_box, in_times
from .dyadic import cells_of, in_use, level_of, look_up
from .numbering import number_occurrences
from .skew import HOT_ROWS, broadcast_if_small, dimension_join, grid_join, hot_keys, restrict, salted_join, saved

#: Fixed sources are valid between these times, both included (fixed values).
FIXED_T_MIN = "1970-01-01 00:00:00"
FIXED_T_MAX = "2100-01-01 00:00:00"


# --- which objects -------------------------------------------------------------------------

def with_point_in(ssos: DataFrame, points: DataFrame, where: Column) -> DataFrame:
    """Objects having at least one point for which `where` holds, each once.

    The ids are made distinct before the join, so an object with a huge number
    of points sends one row per input partition.
    """
    ids = points.where(where).select("sso_id").distinct()
    return ssos.join(ids, "sso_id", "left_semi")


def box_sso(ssos: DataFrame, points: DataFrame, box: Box, t_min, t_max) -> DataFrame:
    """Objects with at least one point in the box and time range."""
    return with_point_in(ssos, points, in_box(box) & in_times(t_min, t_max))


def flagged_sso(ssos: DataFrame, points: DataFrame, flag: str, t_min, t_max) -> DataFrame:
    """Objects with the flag set and at least one point in the time range."""
    return with_point_in(ssos.where(F.col(flag)), points, in_times(t_min, t_max))


def attach_ephem(
    selected: DataFrame, points: DataFrame, t_min, t_max, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All points in the time range of the selected objects, whether inside a box or not.

    The points are shuffled only if the selected objects are too many to broadcast.
    """
    ids = selected.select("sso_id")
    return dimension_join(points.where(in_times(t_min, t_max)), ids, ["sso_id"], "left_semi", hot_rows=hot_rows)


# --- one row per object --------------------------------------------------------------------

def coverage(points: DataFrame) -> DataFrame:
    """First and last time, number of points, and whether every point has a flux."""
    return points.groupBy("sso_id").agg(*coverage_aggs())


def coverage_aggs() -> list[Column]:
    return [
        F.min("time").alias("t_min"),
        F.max("time").alias("t_max"),
        F.count(F.lit(1)).alias("n_points"),
        F.bool_and(F.col("flux_mJy").isNotNull()).alias("do_flux"),
    ]


def duplicate_times(points: DataFrame, time: str = "time") -> DataFrame:
    """Objects in which two points share a time."""
    return (
        points.groupBy("sso_id", time).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1).select("sso_id").distinct()
    )


def mark_duplicates(objects: DataFrame, points: DataFrame, check: bool) -> DataFrame:
    """Adds `duplicate_times`. Checking shuffles (object, time) of every point once.

    Pass `check=False` for tables already known to hold one point per object
    and time (see the integrity report).
    """
    if not check:
        return objects.withColumn("duplicate_times", F.lit(False))
    flagged = duplicate_times(points).withColumn("duplicate_times", F.lit(True))
    return objects.join(flagged, "sso_id", "left").withColumn(
        "duplicate_times", F.coalesce("duplicate_times", F.lit(False)))


# --- interpolation -------------------------------------------------------------------------

def _status(t: Column, first: Column, last: Column) -> Column:
    """Why an object has no position at `t`, from its coverage columns."""
    return (
        F.when(F.col("n_points").isNull(), F.lit("unknown"))
        .when(F.col("duplicate_times"), F.lit("duplicate_times"))
        .when(t.isNull() | (t < first) | (t > last), F.lit("out_of_range"))
        .when(F.col("n_points") < 2, F.lit("too_few_points"))
        .otherwise(F.lit("ok"))
    )


def interpolate(us: Column, ra_mode: str = "linear") -> tuple[Column, Column, Column]:
    """(RA, Dec, flux) at `us` on the segment from (`us0`, `ra_deg0`, ...) to (`us1`, ...).

    Times are whole microseconds here, so that joins and formulas over segments
    do no calendar arithmetic. A null `us1` means the segment is its first point.
    """
    if ra_mode not in ("linear", "shortest"):
        raise ValueError("ra_mode must be 'linear' or 'shortest'")
    share = F.coalesce((us - F.col("us0")) / (F.col("us1") - F.col("us0")), F.lit(0.0))

    def along(name: str, end: Column) -> Column:
        start = F.col(f"{name}0")
        return start + (F.coalesce(end, start) - start) * share

    if ra_mode == "linear":
        ra = along("ra_deg", F.col("ra_deg1"))
    else:
        ra = wrap_ra(along("ra_deg", shortest_end(F.col("ra_deg0"), F.col("ra_deg1"))))
    flux = F.when(F.col("do_flux"), zero_to_null(along("flux_mJy", F.col("flux_mJy1"))))
    return ra, along("dec_deg", F.col("dec_deg1")), flux


def shortest_end(start: Column, end: Column) -> Column:
    step = end - start
    return end + F.when(step > 180.0, -360.0).when(step < -180.0, 360.0).otherwise(0.0)


def object_states(points: DataFrame, t, *, hit: Column | None = None, check_duplicates: bool = True) -> DataFrame:
    """Per object: coverage and the two points around `t`, from one aggregation.

    Every value is a partial aggregate, so whatever the number of points of an
    object, only one small row per object and input partition is shuffled.
    With `hit`, only objects with a point for which it holds are kept.
    """
    t = ntz(t)
    before = F.when(F.col("time") <= t, F.col("time"))
    after = F.when(F.col("time") > t, F.col("time"))
    around = []
    for name in ("ra_deg", "dec_deg", "flux_mJy"):
        around.append(F.max_by(name, before).alias(f"{name}0"))
        around.append(F.min_by(name, after).alias(f"{name}1"))
    aggs = [*coverage_aggs(), F.max(before).alias("time0"), F.min(after).alias("time1"), *around]
    if hit is not None:
        aggs.append(F.bool_or(hit).alias("_hit"))
    states = points.groupBy("sso_id").agg(*aggs)
    if hit is not None:
        states = states.where("_hit").drop("_hit")
    return mark_duplicates(states, points, check_duplicates)


def positions_from_states(states: DataFrame, t, ra_mode: str = "linear") -> DataFrame:
    """Position and flux at `t` for rows made by `object_states`."""
    t = ntz(t)
    ra, dec, flux = interpolate(unix_micros(t), ra_mode)
    ok = F.col("status") == "ok"
    states = states.withColumn("us0", unix_micros(F.col("time0"))).withColumn("us1", unix_micros(F.col("time1")))
    return states.withColumn("status", _status(t, F.col("t_min"), F.col("t_max"))).select(
        "sso_id", "t_min", "t_max", "n_points", "do_flux",
        F.when(ok, ra).alias("ra_deg"), F.when(ok, dec).alias("dec_deg"),
        F.when(ok, flux).alias("flux_mJy"), "status",
    )


def positions_at(
    points: DataFrame, t, *, ra_mode: str = "linear", check_duplicates: bool = True, strict: bool = False
) -> DataFrame:
    """Every object at one time."""
    result = positions_from_states(object_states(points, t, check_duplicates=check_duplicates), t, ra_mode)
    return _strict(result) if strict else result


def _strict(result: DataFrame) -> DataFrame:
    bad = result.where(F.col("status") != "ok").take(1)
    if bad:
        raise ValueError(f"no position: {bad[0].asDict()}")
    return result


# --- segments ------------------------------------------------------------------------------

def time_slices(points: DataFrame, hot_rows: int = HOT_ROWS, among: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(points with `_slice`, whether any object was cut); the points carry their time as `us`.

    Objects with `hot_rows` points or fewer stay whole (slice 0). A larger one is cut
    along time into equal widths, which shrink as long as some slice holds more than
    twice that, so that no window has to hold the object. Counts are exact and widths
    depend on the points only, so another layout of the table gives the same slices.
    `among` names the objects that may be that large, if that is known.
    """
    some = points if among is None else points.join(among.select("sso_id"), "sso_id", "left_semi")
    own = some.groupBy("sso_id").agg(F.min("us").alias("_lo"), F.max("us").alias("_hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    width = F.greatest(F.lit(1), F.floor((F.col("_hi") - F.col("_lo") + 1) / F.ceil(F.col("n") / F.lit(hot_rows)))).cast("bigint")
    widths = saved(own.select("sso_id", "_lo", width.alias("_width")), "slices")
    if not widths.take(1):
        return points.withColumn("_slice", F.lit(0).cast("bigint")), False
    while True:
        sliced = _slice(points, broadcast_if_small(widths))
        full = (
            sliced.where("_width > 1").groupBy("sso_id", "_slice").count().where(F.col("count") > 2 * hot_rows)
            .groupBy("sso_id").agg(F.max("count").alias("_most"))
        )
        full = saved(full, "full-slices")
        if not full.take(1):
            return sliced, True
        less = F.greatest(F.lit(1), F.floor(F.col("_width") * hot_rows / F.col("_most"))).cast("bigint")
        widths = saved(widths.join(full, "sso_id", "left").select(
            "sso_id", "_lo", F.when(F.col("_most").isNull(), F.col("_width")).otherwise(less).alias("_width")), "slices")


def _slice(points: DataFrame, widths: DataFrame) -> DataFrame:
    index = F.floor((F.col("us") - F.col("_lo")) / F.col("_width"))
    return points.join(widths, "sso_id", "left").withColumn("_slice", F.coalesce(index, F.lit(0)).cast("bigint"))


def segments(points: DataFrame, hot_rows: int = HOT_ROWS, keep_duplicates: bool = False) -> DataFrame:
    """One row per point with the next point of the object beside it, and the object's coverage.

    (`us0`, `ra_deg0`, ...) to (`us1`, `ra_deg1`, ...), times in microseconds
    since 1970; the last point of an object has no next one. `us_end` is the
    object's last time. Objects with duplicate times give no rows, or with
    `keep_duplicates` at least one, flagged `duplicate_times`.

    One shuffle by object serves the neighbours and the whole-object columns.
    Objects above `hot_rows` points are cut into time slices, and slices are
    linked by their first points.
    """
    values = ("us", "ra_deg", "dec_deg", "flux_mJy")
    points = points.select("sso_id", unix_micros(F.col("time")).alias("us"), *values[1:])
    hot = hot_keys(points, ["sso_id"], hot_rows)
    copies = None
    if hot is not None:
        copies = saved(duplicate_times(points.join(hot, "sso_id", "left_semi"), "us"), "duplicate-times")
        points = points.join(broadcast_if_small(copies), "sso_id", "left_anti")
        points, cut = time_slices(points, hot_rows, hot)
    else:
        points, cut = points.withColumn("_slice", F.lit(0).cast("bigint")), False
    part = ["sso_id", "_slice"] if cut else ["sso_id"]
    ordered = Window.partitionBy(*part).orderBy("us")
    rows = points.select("sso_id", "_slice", *[F.col(v).alias(f"{v}0") for v in values],
                         *[F.lead(v).over(ordered).alias(f"{v}1") for v in values])
    same = F.coalesce(F.col("us1") == F.col("us0"), F.lit(False))
    object_wide = [
        (F.max, F.col("us0"), "us_end"),
        (F.bool_and, F.col("flux_mJy0").isNotNull(), "do_flux"), (F.bool_or, same, "duplicate_times"),
    ]
    columns = ["sso_id", *[f"{v}0" for v in values]]
    if not cut:
        per_object = Window.partitionBy("sso_id")
        wide = rows.select(
            *columns, *[f"{v}1" for v in values], *[f(c).over(per_object).alias(n) for f, c, n in object_wide])
    else:
        per_object, by_slice = Window.partitionBy("sso_id"), Window.partitionBy("sso_id").orderBy("_slice")
        heads = rows.groupBy("sso_id", "_slice").agg(
            *[f(c).alias(n) for f, c, n in object_wide],
            *[F.min_by(f"{v}0", "us0").alias(f"_head_{v}") for v in values])
        linked = heads.select(
            "sso_id", "_slice", *[f(n).over(per_object).alias(n) for f, _, n in object_wide],
            *[F.lead(f"_head_{v}").over(by_slice).alias(f"_next_{v}") for v in values])
        last_in_slice = F.col("us1").isNull()
        wide = rows.join(linked, ["sso_id", "_slice"]).select(
            *columns, *[F.when(last_in_slice, F.col(f"_next_{v}")).otherwise(F.col(f"{v}1")).alias(f"{v}1") for v in values],
            "us_end", "do_flux", "duplicate_times")
    if not keep_duplicates:
        return wide.where(~F.col("duplicate_times")).drop("duplicate_times")
    if copies is None:
        return wide
    return wide.unionByName(copies.select("sso_id", F.lit(True).alias("duplicate_times")), allowMissingColumns=True)


# --- many times ----------------------------------------------------------------------------

def leveled_segments(points: DataFrame, hot_rows: int = HOT_ROWS, keep_duplicates: bool = False) -> DataFrame:
    """Segments with `_level`, the dyadic time level of their length; null for an object's last point.

    Written once: which levels are in use, which keys are hot, and the join all read it.
    Without `keep_duplicates` last points and objects with duplicate times are left out.
    """
    rows = segments(points, hot_rows, keep_duplicates)
    if not keep_duplicates:
        rows = rows.where(F.col("us1").isNotNull())
    return saved(rows.withColumn("_level", level_of(F.col("us1") - F.col("us0"))), "segments")


def by_time_cell(seg: DataFrame) -> DataFrame:
    """Each segment for the one or two cells that it touches on its level."""
    return seg.withColumn("_tcell", F.explode(cells_of(F.col("us0"), F.col("us1"), F.col("_level"))))


def covers(us: Column) -> Column:
    """The segment holds the time. Half-open, the object's last one closed."""
    at_end = (us == F.col("us1")) & (F.col("us1") == F.col("us_end"))
    return (F.col("us0") <= us) & ((us < F.col("us1")) | at_end)


def positions_at_times(
    points: DataFrame, times: DataFrame, *, ra_mode: str = "linear", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every object at every distinct time of `times` (column `time`) that its points cover.

    An interval join made an equi join on dyadic time cells: a segment is there twice at
    most, a time once for each level in use. Times measured to be few are broadcast; else
    a cell with very many segments or times is split.
    """
    wanted = times.select(F.col("time").alias("t")).where(F.col("t").isNotNull()).distinct()
    seg = leveled_segments(points, hot_rows)
    wanted = look_up(wanted.withColumn("us", unix_micros(F.col("t"))), "us", in_use(seg, F.col("_level")))
    pairs = grid_join(by_time_cell(seg), wanted, ["_level", "_tcell"], covers(F.col("us")), hot_rows)
    ra, dec, flux = interpolate(F.col("us"), ra_mode)
    return pairs.select("sso_id", F.col("t").alias("time"), ra.alias("ra_deg"), dec.alias("dec_deg"),
                        flux.alias("flux_mJy"))


def positions_for(
    points: DataFrame, requests: DataFrame, *, ra_mode: str = "linear", hot_rows: int = HOT_ROWS, strict: bool = False,
) -> DataFrame:
    """One row per distinct (`sso_id`, `time`) request, with a status.

    One shuffle of the points by object gives segments, coverage and duplicate times
    together. The coverage decides the status; only requests that are `ok` look for
    their segment, and each has exactly one.
    """
    wanted = saved(requests.select("sso_id", F.col("time").alias("t")).distinct(), "requests")
    seg = leveled_segments(restrict(points, wanted, ["sso_id"]), hot_rows, keep_duplicates=True)
    about = seg.groupBy("sso_id").agg(
        F.min("us0").alias("_from"), F.max("us_end").alias("_to"), F.count(F.lit(1)).alias("n_points"), F.bool_or("duplicate_times").alias("duplicate_times"))
    about = saved(about, "coverage")
    asked = dimension_join(wanted.withColumn("us", unix_micros(F.col("t"))), about, ["sso_id"], "left", hot_rows=hot_rows)
    asked = asked.withColumn("status", _status(F.col("us"), F.col("_from"), F.col("_to")))
    found = look_up(asked.where("status = 'ok'").select("sso_id", "t", "us"), "us", in_use(seg, F.col("_level")))
    pairs = grid_join(by_time_cell(seg.where(F.col("us1").isNotNull())), found, ["sso_id", "_level", "_tcell"], covers(F.col("us")), hot_rows)
    ra, dec, flux = interpolate(F.col("us"), ra_mode)
    placed = pairs.select("sso_id", F.col("t").alias("time"), ra.alias("ra_deg"), dec.alias("dec_deg"), flux.alias("flux_mJy"), F.lit("ok").alias("status"))
    none = [F.lit(None).cast("double").alias(c) for c in ("ra_deg", "dec_deg", "flux_mJy")]
    result = placed.unionByName(asked.where("status <> 'ok'").select("sso_id", F.col("t").alias("time"), *none, "status"))
    return _strict(result) if strict else result


# --- fixed sources -------------------------------------------------------------------------

def _fixed_at(t: Column) -> list[Column]:
    ok = t.between(ntz(FIXED_T_MIN), ntz(FIXED_T_MAX))
    return [
        F.when(ok, F.col("ra_deg")).alias("ra_deg"), F.when(ok, F.col("dec_deg")).alias("dec_deg"),
        F.when(ok, zero_to_null(F.col("flux_mJy"))).alias("flux_mJy"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("out_of_range")).alias("status"),
    ]


def fixed_at(fixed: DataFrame, t, keep: list[str] = []) -> DataFrame:
    """Every fixed source at one time: constant within its validity."""
    return fixed.select("source_id", *keep, ntz(t).alias("time"), *_fixed_at(ntz(t)))


def fixed_at_times(fixed: DataFrame, times: list, keep: list[str] = []) -> DataFrame:
    """Every fixed source at each time of a list the caller typed: no join, one row generator."""
    moments = fixed.withColumn("time", F.explode(F.array(*[ntz(t) for t in times])))
    return moments.select("source_id", *keep, "time", *_fixed_at(F.col("time")))


def fixed_for(fixed: DataFrame, requests: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per distinct (`source_id`, `time`) request; unknown sources have status `unknown`."""
    wanted = requests.select("source_id", "time").distinct()
    known = fixed.select("source_id", "ra_deg", "dec_deg", "flux_mJy", F.lit(True).alias("_known"))
    found = salted_join(wanted, known, ["source_id"], "left", hot_rows=hot_rows)
    ra, dec, flux, status = _fixed_at(F.col("time"))
    return found.select("source_id", "time", ra, dec, flux,
                        F.when(F.col("_known"), status).otherwise(F.lit("unknown")).alias("status"))


def _bisect(times: Column, us: Column) -> Column:
    """How many of the ascending `times` are not after `us`."""
    span = F.struct(F.lit(0).alias("low"), F.size(times).alias("high"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(times) + F.lit(1))).cast("int") + 1)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        after = F.get(times, middle) > us  # null past the end, when the span is closed
        low = F.when((s["low"] < s["high"]) & ~after, middle + 1).otherwise(s["low"])
        high = F.when((s["low"] < s["high"]) & after, middle).otherwise(s["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    return F.aggregate(steps, span, halve, lambda s: s["low"])


def packed_at(packs: DataFrame, requests: DataFrame, *, ra_mode: str = "linear", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per distinct (`sso_id`, `time`) request, like `positions_for`, from the arrays made by `packed`.

    The points around a time are found by bisection in the array: no join with points and no
    window over them. Parts of one object are linked by the first point of the next; only
    these heads, a row a part, are put in order.
    """
    us = F.transform("points", lambda p: unix_micros(p["time"]))
    rows = packs.select("sso_id", "part", "share", "points", us.alias("times"))
    equal = F.exists(F.sequence(F.lit(1), F.size("times")), lambda i: F.get(F.col("times"), i) == F.get(F.col("times"), i - 1))
    heads = rows.select(
        "sso_id", "part", "share", F.get("times", F.lit(0)).alias("_from"), F.element_at("times", -1).alias("_last"),
        F.get("points", F.lit(0)).alias("_head"), F.size("times").cast("bigint").alias("_n"), equal.alias("_equal"),
        F.forall("points", lambda p: p["flux_mJy"].isNotNull()).alias("_flux"))
    order, whole = Window.partitionBy("sso_id").orderBy("part", "share"), Window.partitionBy("sso_id")
    linked = saved(heads.select(
        "sso_id", "part", "share", "_from", F.lead("_from").over(order).alias("_next_us"), F.lead("_head").over(order).alias("_next"),
        F.min("_from").over(whole).alias("_first"), F.max("_last").over(whole).alias("_end"), F.sum("_n").over(whole).alias("n_points"),
        F.bool_and("_flux").over(whole).alias("do_flux"), F.bool_or("_equal").over(whole).alias("_twice"),
        (F.col("_last") == F.lead("_from").over(order)).alias("_meets")), "packed-heads")
    about = linked.groupBy("sso_id").agg(
        F.min("_first").alias("_first"), F.max("_end").alias("_end"), F.max("n_points").alias("n_points"), F.max("do_flux").alias("do_flux"),
        (F.coalesce(F.bool_or("_twice"), F.lit(False)) | F.coalesce(F.bool_or("_meets"), F.lit(False))).alias("duplicate_times"))
    wanted = requests.select("sso_id", F.col("time").alias("t")).distinct().withColumn("us", unix_micros(F.col("t")))
    asked = saved(dimension_join(wanted, about, ["sso_id"], "left", hot_rows=hot_rows).withColumn(
        "status", _status(F.col("us"), F.col("_first"), F.col("_end"))), "packed-requests")
    links = linked.select("sso_id", "part", "share", "_from", "_next_us", "_next")
    part = rows.drop("times").join(links, ["sso_id", "part", "share"]).withColumn("times", us)
    here = (F.col("_from") <= F.col("us")) & (F.col("_next_us").isNull() | (F.col("us") < F.col("_next_us")))
    found = grid_join(part, asked.where("status = 'ok'").select("sso_id", "t", "us", "do_flux"), ["sso_id"], here, hot_rows)
    found = found.withColumn("_at", _bisect(F.col("times"), F.col("us")))
    ends = {}
    for side, point, time in (
        ("0", F.get("points", F.col("_at") - 1), F.get("times", F.col("_at") - 1)),
        ("1", F.coalesce(F.get("points", F.col("_at")), F.col("_next")), F.coalesce(F.get("times", F.col("_at")), F.col("_next_us"))),
    ):
        ends |= {f"us{side}": time, **{f"{v}{side}": point[v] for v in ("ra_deg", "dec_deg", "flux_mJy")}}
    ra, dec, flux = interpolate(F.col("us"), ra_mode)
    placed = found.withColumns(ends).select(
        "sso_id", F.col("t").alias("time"), ra.alias("ra_deg"), dec.alias("dec_deg"), flux.alias("flux_mJy"), F.lit("ok").alias("status"))
    none = [F.lit(None).cast("double").alias(c) for c in ("ra_deg", "dec_deg", "flux_mJy")]
    return placed.unionByName(asked.where("status <> 'ok'").select("sso_id", F.col("t").alias("time"), *none, "status"))


def packed(points: DataFrame, pack_rows: int = 100_000) -> DataFrame:
    """The ordered points of an object as arrays of bounded length, for export.

    An ordinary object is one row. One with more than `pack_rows` points gives
    several, `part` 0, 1, ... in time order; points that share a time and would
    overfill a part are shared out over `share` 0, 1, ...
    """
    point = ("time", "ra_deg", "dec_deg", "flux_mJy")
    sliced, cut = time_slices(points.withColumn("us", unix_micros(F.col("time"))), pack_rows)
    sliced = sliced.select("sso_id", F.col("_slice").alias("part"), *point)
    shared = sliced.withColumn("share", F.lit(0).cast("bigint"))
    if cut:
        key = ["sso_id", "part"]
        full = saved(sliced.groupBy(*key).count().where(F.col("count") > 2 * pack_rows).select(*key), "full-slices")
        numbered = number_occurrences(sliced.join(full, key, "left_semi"), key, "_n", pack_rows)
        shares = numbered.withColumn("share", F.floor((F.col("_n") - 1) / pack_rows).cast("bigint")).drop("_n")
        shared = shared.join(full, key, "left_anti").unionByName(shares)
    return shared.groupBy("sso_id", "part", "share").agg(
        F.count(F.lit(1)).alias("n_points"), F.array_sort(F.collect_list(F.struct(*point))).alias("points"))
