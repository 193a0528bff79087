"""Checked queries: boxes, lookups, motion and the unified queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angles, times
from ..operators import boxes, ephemeris, lookups
from . import unified
from .registry import (
    BOX, IN_BOX, IN_WRAPPED, RANGE, T_AT, T_MAX, T_MIN, WRAPPED, nine, nine_digits, query, separation_sql,
)


@query("box_fixed", f"SELECT * FROM fixed_sources WHERE {IN_BOX}", "fixed_sources")
def box_fixed(v):
    return boxes.box_fixed(v.fixed_sources, BOX)


@query("box_fixed_wrap", f"SELECT * FROM fixed_sources WHERE {IN_WRAPPED}", "fixed_sources")
def box_fixed_wrap(v):
    return boxes.box_fixed(v.fixed_sources, WRAPPED)


@query("ephem_range", f"SELECT * FROM moving_sources WHERE sso_id = 7 AND {RANGE}", "moving_sources")
def ephem_range(v):
    return lookups.ephem_of(v.moving_sources, 7, T_MIN, T_MAX)


@query("ephem_by_object", "SELECT * FROM moving_sources WHERE sso_id = 7", "moving_sources")
def ephem_by_object(v):
    return lookups.ephem_of(v.moving_sources, 7)


for _flag in ("monitored", "pointing"):
    query(f"{_flag}_fixed", f"SELECT * FROM fixed_sources WHERE {_flag}", "fixed_sources")(
        lambda v, flag=_flag: lookups.flagged(v.fixed_sources, flag))
    query(f"{_flag}_sso", f"""
        SELECT * FROM solarsystem_objects s WHERE {_flag}
          AND EXISTS (SELECT 1 FROM moving_sources m WHERE m.sso_id = s.sso_id AND {RANGE})""",
          "solarsystem_objects", "moving_sources")(
        lambda v, flag=_flag: ephemeris.flagged_sso(v.solarsystem_objects, v.moving_sources, flag, T_MIN, T_MAX))


def _part_keys(v):
    return v.table("lineitem").select(F.col("l_partkey").alias("source_id"))


@query("lookup_by_id", "SELECT * FROM fixed_sources WHERE source_id IN (SELECT l_partkey FROM lineitem)", "fixed_sources")
def lookup_by_id(v):
    return lookups.lookup(v.fixed_sources, _part_keys(v), "source_id").found


@query("lookup_missing", """
    SELECT DISTINCT l_partkey AS source_id FROM lineitem
    WHERE l_partkey NOT IN (SELECT source_id FROM fixed_sources)""", "fixed_sources")
def lookup_missing(v):
    return lookups.lookup(v.fixed_sources, _part_keys(v), "source_id").missing


@query("lookup_by_name", """
    SELECT * FROM solarsystem_objects
    WHERE name IN (SELECT concat('obj', CAST(l_suppkey AS VARCHAR)) FROM lineitem)""", "solarsystem_objects")
def lookup_by_name(v):
    keys = v.table("lineitem").select(F.concat(F.lit("obj"), F.col("l_suppkey").cast("string")).alias("name"))
    return lookups.lookup(v.solarsystem_objects, keys, "name").found


@query("lookup_by_mpc", "SELECT * FROM solarsystem_objects WHERE mpc_id IN (SELECT l_suppkey FROM lineitem)",
       "solarsystem_objects")
def lookup_by_mpc(v):
    keys = v.table("lineitem").select(F.col("l_suppkey").alias("MPC_id"))
    return lookups.lookup(v.solarsystem_objects, keys, "MPC_id").found.select(
        "sso_id", "mpc_id", "name", "monitored", "pointing")


@query("lookup_service_name", """
    SELECT * FROM services WHERE name IN (SELECT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey)
    """, "services")
def lookup_service_name(v):
    customers = v.table("customer").select(F.col("c_nationkey").alias("n_nationkey"))
    keys = v.table("nation").join(customers.distinct(), "n_nationkey").select(F.col("n_name").alias("name"))
    return lookups.lookup(v.services, keys, "name").found


@query("flat_distance", """
    SELECT det_id, round(sqrt((d.ra_deg - f.ra_deg) * (d.ra_deg - f.ra_deg)
                              + (d.dec_deg - f.dec_deg) * (d.dec_deg - f.dec_deg)), 9) AS distance
    FROM detections d JOIN orders ON o_orderkey = det_id JOIN fixed_sources f ON f.source_id = o_custkey
    """, "detections", "fixed_sources")
def flat_distance(v):
    d = angles.flat_distance(F.col("d_ra"), F.col("d_dec"), F.col("ra_deg"), F.col("dec_deg"))
    return _ordered_pairs(v).select("det_id", nine_digits(d).alias("distance"))


@query("separation", f"""
    SELECT det_id, round({separation_sql('d.ra_deg', 'd.dec_deg', 'f.ra_deg', 'f.dec_deg')}, 9) AS separation_deg
    FROM detections d JOIN orders ON o_orderkey = det_id JOIN fixed_sources f ON f.source_id = o_custkey
    """, "detections", "fixed_sources")
def separation(v):
    d = angles.separation(F.col("d_ra"), F.col("d_dec"), F.col("ra_deg"), F.col("dec_deg"))
    return _ordered_pairs(v).select("det_id", nine_digits(d).alias("separation_deg"))


def _ordered_pairs(v):
    placed = v.detections.select("det_id", F.col("ra_deg").alias("d_ra"), F.col("dec_deg").alias("d_dec"))
    owner = v.table("orders").select(F.col("o_orderkey").alias("det_id"), F.col("o_custkey").alias("source_id"))
    return placed.join(owner, "det_id").join(v.fixed_sources.select("source_id", "ra_deg", "dec_deg"), "source_id")


# --- moving sources ------------------------------------------------------------------------

for _name, _box, _sql in (("box_sso", BOX, IN_BOX), ("box_sso_wrap", WRAPPED, IN_WRAPPED)):
    query(_name, f"""
        SELECT * FROM solarsystem_objects
        WHERE sso_id IN (SELECT sso_id FROM moving_sources WHERE {RANGE} AND {_sql})""",
          "solarsystem_objects", "moving_sources")(
        lambda v, box=_box: ephemeris.box_sso(v.solarsystem_objects, v.moving_sources, box, T_MIN, T_MAX))


@query("attach_ephem", f"""
    SELECT * FROM moving_sources WHERE {RANGE}
      AND sso_id IN (SELECT sso_id FROM moving_sources WHERE {RANGE} AND {IN_BOX})""", "moving_sources")
def attach_ephem(v):
    chosen = ephemeris.box_sso(v.solarsystem_objects, v.moving_sources, BOX, T_MIN, T_MAX)
    return ephemeris.attach_ephem(chosen, v.moving_sources, T_MIN, T_MAX)


@query("coverage", f"""
    SELECT sso_id, min(time) AS t_min, max(time) AS t_max, count(*) AS n_points
    FROM moving_sources WHERE {RANGE} GROUP BY sso_id""", "moving_sources")
def coverage(v):
    return ephemeris.coverage(v.moving_sources.where(boxes.in_times(T_MIN, T_MAX))).drop("do_flux")


@query("flux_complete", f"""
    SELECT sso_id, bool_and(flux_mjy IS NOT NULL) AS do_flux
    FROM moving_sources WHERE {RANGE} GROUP BY sso_id""", "moving_sources")
def flux_complete(v):
    return ephemeris.coverage(v.moving_sources.where(boxes.in_times(T_MIN, T_MAX))).select("sso_id", "do_flux")


SEGMENTS = """
    SELECT sso_id, time AS time0, ra_deg AS ra0, dec_deg AS dec0, flux_mjy AS flux0,
           lead(time) OVER w AS time1, lead(ra_deg) OVER w AS ra1, lead(dec_deg) OVER w AS dec1,
           lead(flux_mjy) OVER w AS flux1, max(time) OVER p AS t_max,
           bool_and(flux_mjy IS NOT NULL) OVER p AS do_flux
    FROM {points} WINDOW w AS (PARTITION BY sso_id ORDER BY time), p AS (PARTITION BY sso_id)"""


def covers_sql(t: str) -> str:
    return f"time0 <= {t} AND ({t} < time1 OR ({t} = time1 AND time1 = t_max))"


def along_sql(name: str, t: str) -> str:
    share = f"((epoch_us({t}) - epoch_us(time0)) / (epoch_us(time1) - epoch_us(time0)))"
    return f"{name}0 + ({name}1 - {name}0) * {share}"


def flux_sql(t: str) -> str:
    return f"CASE WHEN do_flux THEN nullif({along_sql('flux', t)}, 0e0) END"


NARROW_MIN, NARROW_MAX = "2024-01-11 12:00:00", "2024-01-12 12:00:00"
NARROW = f"time BETWEEN TIMESTAMP '{NARROW_MIN}' AND TIMESTAMP '{NARROW_MAX}'"
AT = f"TIMESTAMP '{T_AT}'"


@query("at_time_moving", f"""
    , pts AS (SELECT * FROM moving_sources WHERE {NARROW}), seg AS ({SEGMENTS.format(points='pts')}),
    obj AS (SELECT sso_id, min(time) AS t_min, max(time) AS t_max, count(*) AS n_points,
                   bool_and(flux_mjy IS NOT NULL) AS do_flux FROM pts GROUP BY sso_id)
    SELECT obj.sso_id, obj.t_min, obj.t_max, n_points, obj.do_flux,
           round({along_sql('ra', AT)}, 9) AS ra_deg, round({along_sql('dec', AT)}, 9) AS dec_deg,
           round(CASE WHEN obj.do_flux THEN nullif({along_sql('flux', AT)}, 0e0) END, 9) AS flux_mjy,
           CASE WHEN {AT} < obj.t_min OR {AT} > obj.t_max THEN 'out_of_range'
                WHEN n_points < 2 THEN 'too_few_points' ELSE 'ok' END AS status
    FROM obj LEFT JOIN seg ON obj.sso_id = seg.sso_id AND time0 <= {AT}
      AND ({AT} < time1 OR ({AT} = time1 AND time1 = seg.t_max))""", "moving_sources")
def at_time_moving(v):
    found = ephemeris.positions_at(v.moving_sources.where(boxes.in_times(NARROW_MIN, NARROW_MAX)), T_AT)
    return found.select("sso_id", "t_min", "t_max", "n_points", "do_flux", *nine("ra_deg", "dec_deg", "flux_mJy"),
                        "status")


@query("at_time_many", f"""
    , seg AS ({SEGMENTS.format(points='moving_sources')}),
    req AS (SELECT DISTINCT date_trunc('hour', ts) AS t FROM events)
    SELECT sso_id, t AS time, round({along_sql('ra', 't')}, 9) AS ra_deg, round({along_sql('dec', 't')}, 9) AS dec_deg,
           round({flux_sql('t')}, 9) AS flux_mjy
    FROM req JOIN seg ON {covers_sql('t')}""", "moving_sources")
def at_time_many(v):
    hour = F.floor(times.unix_micros(F.col("ts")) / 3_600_000_000) * 3600.0
    moments = v.table("events").select(times.from_unix_seconds(hour).alias("time"))
    found = ephemeris.positions_at_times(v.moving_sources, moments)
    return found.select("sso_id", "time", *nine("ra_deg", "dec_deg", "flux_mJy"))


NAMED_SQL = f"""
    , seg AS ({SEGMENTS.format(points='moving_sources')}),
    obj AS (SELECT sso_id, min(time) AS t_min, max(time) AS t_max, count(*) AS n FROM moving_sources GROUP BY sso_id),
    req AS (SELECT DISTINCT o_custkey AS sso_id, d.time AS t FROM january_detections d JOIN orders ON o_orderkey = det_id)
    SELECT req.sso_id, t AS time, round({along_sql('ra', 't')}, 9) AS ra_deg,
           round({along_sql('dec', 't')}, 9) AS dec_deg, round({flux_sql('t')}, 9) AS flux_mjy,
           CASE WHEN n IS NULL THEN 'unknown' WHEN t < obj.t_min OR t > obj.t_max THEN 'out_of_range'
                WHEN n < 2 THEN 'too_few_points' ELSE 'ok' END AS status
    FROM req LEFT JOIN obj ON obj.sso_id = req.sso_id
      LEFT JOIN seg ON seg.sso_id = req.sso_id AND time0 <= t AND (t < time1 OR (t = time1 AND time1 = seg.t_max))
    """


@query("at_time_named", NAMED_SQL, "moving_sources", "january_detections")
def at_time_named(v):
    owner = v.table("orders").select(F.col("o_orderkey").alias("det_id"), F.col("o_custkey").alias("sso_id"))
    asked = v.january_detections.join(owner, "det_id").select("sso_id", "time")
    found = ephemeris.positions_for(v.moving_sources, asked)
    return found.select("sso_id", "time", *nine("ra_deg", "dec_deg", "flux_mJy"), "status")


@query("packed_at_time", NAMED_SQL, "moving_sources", "january_detections")
def packed_at_time(v):
    """The same requests, answered from the packed arrays."""
    owner = v.table("orders").select(F.col("o_orderkey").alias("det_id"), F.col("o_custkey").alias("sso_id"))
    asked = v.january_detections.join(owner, "det_id").select("sso_id", "time")
    found = ephemeris.packed_at(ephemeris.packed(v.moving_sources), asked)
    return found.select("sso_id", "time", *nine("ra_deg", "dec_deg", "flux_mJy"), "status")


@query("at_time_fixed", """
    , req AS (SELECT DISTINCT o_custkey AS source_id, o_orderdate AS time FROM orders)
    SELECT req.source_id, time, ra_deg, dec_deg, nullif(flux_mjy, 0e0) AS flux_mjy, 'ok' AS status
    FROM req JOIN fixed_sources f ON f.source_id = req.source_id""", "fixed_sources")
def at_time_fixed(v):
    asked = v.table("orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("time"))
    return ephemeris.fixed_for(v.fixed_sources, asked)


@query("packed_ephem", f"""
    SELECT sso_id, CAST(0 AS BIGINT) AS part, count(*) AS n_points, min(time) AS first_time,
           string_agg(CAST(CAST(round(ra_deg * 1e2) AS BIGINT) AS VARCHAR), ',' ORDER BY time) AS track
    FROM moving_sources WHERE {RANGE} GROUP BY sso_id""", "moving_sources")
def packed_ephem(v):
    rows = ephemeris.packed(v.moving_sources.where(boxes.in_times(T_MIN, T_MAX)))
    track = F.transform("points", lambda p: F.round(p["ra_deg"] * 100).cast("bigint").cast("string"))
    return rows.select("sso_id", "part", "n_points", F.col("points")[0]["time"].alias("first_time"),
                       F.concat_ws(",", track).alias("track"))


# --- unified -------------------------------------------------------------------------------

FIXED_PART = """
    SELECT 'fixed' AS kind, CAST(source_id AS VARCHAR) AS id, name, CAST(NULL AS BIGINT) AS mpc_id, ra_deg, dec_deg,
           flux_mjy, monitored, pointing, TIMESTAMP '1970-01-01' AS t_min, TIMESTAMP '2100-01-01' AS t_max,
           CAST(NULL AS BIGINT) AS n_points, flux_mjy IS NOT NULL AS do_flux
    FROM fixed_sources WHERE {where}"""
MOVING_PART = f"""
    SELECT 'sso', CAST(s.sso_id AS VARCHAR), any_value(s.name), any_value(s.mpc_id), NULL, NULL, NULL,
           any_value(s.monitored), any_value(s.pointing), min(time), max(time), count(*),
           bool_and(m.flux_mjy IS NOT NULL)
    FROM solarsystem_objects s JOIN moving_sources m ON m.sso_id = s.sso_id
    WHERE {RANGE} AND {{where}} GROUP BY s.sso_id"""
HAS_POINT = f"s.sso_id IN (SELECT sso_id FROM moving_sources WHERE {RANGE} AND {IN_BOX})"
ALL = ("fixed_sources", "solarsystem_objects", "moving_sources")


@query("get_box", FIXED_PART.format(where=IN_BOX) + " UNION ALL " + MOVING_PART.format(where=HAS_POINT), *ALL)
def get_box(v):
    return unified.get_box(v.fixed_sources, v.solarsystem_objects, v.moving_sources, BOX, T_MIN, T_MAX)


@query("monitored_sources", FIXED_PART.format(where="monitored") + " UNION ALL "
       + MOVING_PART.format(where="s.monitored"), *ALL)
def monitored_sources(v):
    return unified.monitored_sources(v.fixed_sources, v.solarsystem_objects, v.moving_sources, T_MIN, T_MAX)


@query("pointing_sources", FIXED_PART.format(where=f"pointing AND {IN_BOX}") + " UNION ALL "
       + MOVING_PART.format(where=f"s.pointing AND {HAS_POINT}"), *ALL)
def pointing_sources(v):
    return unified.pointing_sources(v.fixed_sources, v.solarsystem_objects, v.moving_sources, T_MIN, T_MAX, BOX)


@query("box_at_time", f"""
    , pts AS (SELECT * FROM moving_sources WHERE {RANGE}), seg AS ({SEGMENTS.format(points='pts')}),
    obj AS (SELECT sso_id, min(time) AS t_min, max(time) AS t_max, count(*) AS n FROM pts GROUP BY sso_id
            HAVING bool_or({IN_BOX}))
    SELECT 'fixed' AS kind, CAST(source_id AS VARCHAR) AS id, name, round(ra_deg, 9) AS ra_deg,
           round(dec_deg, 9) AS dec_deg, round(nullif(flux_mjy, 0e0), 9) AS flux_mjy, 'ok' AS status FROM fixed_sources WHERE {IN_BOX}
    UNION ALL
    SELECT 'sso', CAST(s.sso_id AS VARCHAR), s.name, round({along_sql('ra', AT)}, 9), round({along_sql('dec', AT)}, 9),
           round({flux_sql(AT)}, 9),
           CASE WHEN {AT} < obj.t_min OR {AT} > obj.t_max THEN 'out_of_range'
                WHEN n < 2 THEN 'too_few_points' ELSE 'ok' END
    FROM obj JOIN solarsystem_objects s ON s.sso_id = obj.sso_id
      LEFT JOIN seg ON seg.sso_id = obj.sso_id AND time0 <= {AT}
        AND ({AT} < time1 OR ({AT} = time1 AND time1 = seg.t_max))""", *ALL)
def box_at_time(v):
    found = unified.box_at_time(v.fixed_sources, v.solarsystem_objects, v.moving_sources, BOX, T_MIN, T_MAX, T_AT)
    return found.select("kind", "id", "name", *nine("ra_deg", "dec_deg", "flux_mJy"), "status")


#: Moments inside the time range, at its edge, and before any validity (fixed values).
MOMENTS = [T_AT, "2024-01-08 06:30:00", T_MAX, "1960-01-01 00:00:00"]


def _at_times_sql(fixed: str, sso: str) -> str:
    return f"""
    , pts AS (SELECT * FROM moving_sources WHERE {RANGE}), seg AS ({SEGMENTS.format(points='pts')}),
    moments AS (SELECT unnest([{', '.join(f"TIMESTAMP '{t}'" for t in MOMENTS)}]) AS t),
    obj AS (SELECT sso_id, min(time) AS t_min, max(time) AS t_max, count(*) AS n FROM pts GROUP BY sso_id {sso})
    SELECT 'fixed' AS kind, CAST(source_id AS VARCHAR) AS id, name, t AS time,
           CASE WHEN year(t) >= 1970 THEN round(ra_deg, 9) END AS ra_deg, CASE WHEN year(t) >= 1970 THEN round(dec_deg, 9) END AS dec_deg,
           CASE WHEN year(t) >= 1970 THEN round(nullif(flux_mjy, 0e0), 9) END AS flux_mjy,
           CASE WHEN year(t) >= 1970 THEN 'ok' ELSE 'out_of_range' END AS status
    FROM fixed_sources, moments WHERE {fixed}
    UNION ALL
    SELECT 'sso', CAST(s.sso_id AS VARCHAR), s.name, t, round({along_sql('ra', 't')}, 9), round({along_sql('dec', 't')}, 9),
           round({flux_sql('t')}, 9),
           CASE WHEN t < obj.t_min OR t > obj.t_max THEN 'out_of_range' WHEN n < 2 THEN 'too_few_points' ELSE 'ok' END
    FROM obj JOIN solarsystem_objects s ON s.sso_id = obj.sso_id CROSS JOIN moments
      LEFT JOIN seg ON seg.sso_id = obj.sso_id AND time0 <= t AND (t < time1 OR (t = time1 AND time1 = seg.t_max))"""


@query("box_at_times", _at_times_sql(IN_BOX, f"HAVING bool_or({IN_BOX})"), *ALL)
def box_at_times(v):
    found = unified.box_at_times(v.fixed_sources, v.solarsystem_objects, v.moving_sources, BOX, T_MIN, T_MAX, MOMENTS)
    return found.select("kind", "id", "name", "time", *nine("ra_deg", "dec_deg", "flux_mJy"), "status")


@query("flagged_at_times", _at_times_sql("monitored", "HAVING sso_id IN (SELECT sso_id FROM solarsystem_objects WHERE monitored)"), *ALL)
def flagged_at_times(v):
    found = unified.flagged_at_times(v.fixed_sources, v.solarsystem_objects, v.moving_sources, "monitored", T_MIN, T_MAX, MOMENTS)
    return found.select("kind", "id", "name", "time", *nine("ra_deg", "dec_deg", "flux_mJy"), "status")
