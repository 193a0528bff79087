"""Checked queries: scalar expressions, readers and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angles, times, values
from ..operators.boxes import split_boxes
from ..schema import FIXED_SOURCES, conform
from ..session import shared_folder
from ..sources import catalogs, fits, generations, jpl, mpc, snapshot
from .fits_files import write_parts
from .registry import nine, nine_digits, query
from .text_files import write_texts

FIXED = ["ra_deg", "dec_deg", "flux_mJy", "name", "monitored", "pointing"]
POINT = ["MPC_id", "name", "time", "ra_deg", "dec_deg", "flux_mJy"]


@query("scan_fixed", "SELECT * FROM fixed_sources", "fixed_sources")
def scan_fixed(v):
    return conform(v.fixed_sources, FIXED_SOURCES, keep_ids=True)


@query("ingest_act", """
    SELECT radeg AS ra_deg, decdeg AS dec_deg, fluxjy * 1e3 AS flux_mjy, name,
           fluxjy * 1e3 >= 2e1 AS monitored, fluxjy * 1e3 >= 3e2 AS pointing
    FROM act_rows""", "act_rows")
def ingest_act(v):
    return catalogs.ingest_act(v.act_rows.select(
        F.col("radeg").alias("raDeg"), F.col("decdeg").alias("decDeg"), F.col("fluxjy").alias("fluxJy"), "name",
    )).rows.select(*FIXED)


IAU_SQL = """
    'J' || lpad(CAST(r // 360000 AS VARCHAR), 2, '0') || lpad(CAST(r // 6000 % 60 AS VARCHAR), 2, '0')
        || lpad(CAST(r // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(r % 100 AS VARCHAR), 2, '0')
        || CASE WHEN dec_deg < 0 THEN '-' ELSE '+' END
        || lpad(CAST(d // 36000 AS VARCHAR), 2, '0') || lpad(CAST(d // 600 % 60 AS VARCHAR), 2, '0')
        || lpad(CAST(d // 10 % 60 AS VARCHAR), 2, '0') || '.' || CAST(d % 10 AS VARCHAR)"""
IAU_TICKS = """
    SELECT *, CAST(floor(ra_deg / 15e0 * 36e4 + 5e-1) AS BIGINT) % 8640000 AS r,
           CAST(floor(abs(dec_deg) * 36e3 + 5e-1) AS BIGINT) AS d"""
WEBSKY_RA = "CASE WHEN ra_deg < 0 THEN ra_deg + 36e1 ELSE ra_deg END"


@query("ingest_websky", f"""
    SELECT ra_deg, dec_deg, flux_jy * 1e3 AS flux_mjy, {IAU_SQL} AS name, false AS monitored, false AS pointing
    FROM ({IAU_TICKS} FROM (SELECT flux_jy, dec_deg, {WEBSKY_RA} AS ra_deg FROM websky_rows WHERE NOT flux_jy < 95e-3))
    """, "websky_rows")
def ingest_websky(v):
    rows = v.websky_rows.select(F.col("flux_jy").alias(" flux(Jy)"), F.col("ra_deg").alias(" RA(deg)"),
                                F.col("dec_deg").alias(" dec(deg) "))
    return catalogs.ingest_websky(rows, flux_lower_limit_jy=0.095).rows.select(*FIXED)


@query("flux_limit", "SELECT * FROM websky_rows WHERE NOT flux_jy < 95e-3", "websky_rows")
def flux_limit(v):
    return v.websky_rows.where(values.not_below(F.col("flux_jy"), 0.095))


@query("ingest_text", """
    SELECT ra AS ra_deg, dec AS dec_deg, CAST(NULL AS DOUBLE) AS flux_mjy, name,
           monitored = 'True' AS monitored, false AS pointing
    FROM text_rows""", "text_rows")
def ingest_text(v):
    return catalogs.ingest_text(v.text_rows).rows.select(*FIXED)


@query("ingest_jpl_sso", """
    SELECT DISTINCT CAST(split_part(designation, ' ', 1) AS BIGINT) AS mpc_id,
           substr(designation, strpos(designation, ' ') + 1) AS name, true AS monitored, false AS pointing
    FROM jpl_rows""", "jpl_rows")
def ingest_jpl_sso(v):
    return jpl.ingest_jpl(v.jpl_rows, every=10, order=["row_idx"]).ssos.select(
        "MPC_id", "name", "monitored", "pointing")


JPL_TIME = "TIMESTAMP '1970-01-01' + to_microseconds(CAST(round((julian_day - 24405875e-1) * 864e8) AS BIGINT))"


@query("ingest_jpl_ephem", f"""
    SELECT CAST(split_part(designation, ' ', 1) AS BIGINT) AS mpc_id,
           substr(designation, strpos(designation, ' ') + 1) AS name, {JPL_TIME} AS time, ra_deg, dec_deg, flux_mjy
    FROM (SELECT *, row_number() OVER (PARTITION BY designation ORDER BY row_idx) AS rn FROM jpl_rows)
    WHERE (rn - 1) % 10 = 0""", "jpl_rows")
def ingest_jpl_ephem(v):
    return jpl.ingest_jpl(v.jpl_rows, every=10, order=["row_idx"]).points.select(*POINT)


@query("ingest_jpl_rejected", f"""
    SELECT concat('Obj ', CAST(u - u % 6 AS VARCHAR)) AS name, {JPL_TIME} AS time, ra_deg, dec_deg, 'name with several MPC ids' AS reason
    FROM (SELECT *, CAST(split_part(designation, ' ', 1) AS BIGINT) - 1 AS u FROM jpl_rows) WHERE u % 6 < 2
      AND u - u % 6 IN (SELECT a.u FROM (SELECT DISTINCT user_id AS u FROM events) a JOIN (SELECT DISTINCT user_id AS u FROM events) b ON b.u = a.u + 1 WHERE a.u % 6 = 0)
    """, "jpl_rows")
def ingest_jpl_rejected(v):
    """Objects 6k and 6k + 1 come under one name and with two MPC ids."""
    own = F.split("designation", " ")[0].cast("bigint") - 1
    name = F.when(own % 6 == 1, own - 1).otherwise(own)
    rows = v.jpl_rows.withColumn("designation", F.concat((own + 1).cast("string"), F.lit(" Obj "), name.cast("string")))
    return jpl.ingest_jpl(rows, order=["row_idx"]).rejected


@query("ingest_jpl_second_token", f"""
    SELECT CAST(split_part(designation, ' ', 1) AS BIGINT) AS mpc_id, split_part(designation, ' ', 2) AS name,
           {JPL_TIME} AS time, ra_deg, dec_deg, flux_mjy
    FROM jpl_rows""", "jpl_rows")
def ingest_jpl_second_token(v):
    return jpl.ingest_jpl(v.jpl_rows, order=["row_idx"], name_mode="second_token", monitored=False).points.select(*POINT)


@query("downsample", """
    SELECT row_idx, designation FROM (
      SELECT *, row_number() OVER (PARTITION BY designation ORDER BY row_idx) AS rn FROM jpl_rows)
    WHERE (rn - 1) % 7 = 0""", "jpl_rows")
def downsample(v):
    return jpl.downsample(v.jpl_rows.select("row_idx", "designation"), "designation", 7, ["row_idx"])


@query("ingest_summary", """
    SELECT 'events' AS source_file, count(DISTINCT designation) AS number_of_ssos, count(*) AS number_of_ephems
    FROM jpl_rows""", "jpl_rows")
def ingest_summary(v):
    done = jpl.ingest_jpl(v.jpl_rows, order=["row_idx"])
    return catalogs.ingest_summary(done.ssos, done.points, "events")


MPC_RA = ("(CAST(substr(line, 19, 2) AS DOUBLE) + CAST(substr(line, 22, 2) AS DOUBLE) / 6e1"
          " + CAST(substr(line, 25, 4) AS DOUBLE) / 36e2) * 15e0")
MPC_DEC = ("(CASE WHEN substr(line, 30, 1) = '-' THEN -1e0 ELSE 1e0 END) * (CAST(substr(line, 31, 2) AS DOUBLE)"
           " + CAST(substr(line, 34, 2) AS DOUBLE) / 6e1 + CAST(substr(line, 37, 2) AS DOUBLE) / 36e2)")


@query("ingest_mpc_sky", f"""
    SELECT row_idx, strptime(substr(line, 1, 17), '%Y %m %d %H%M%S') AS time,
           round({MPC_RA}, 9) AS ra_deg, round({MPC_DEC}, 9) AS dec_deg
    FROM mpc_lines""", "mpc_lines")
def ingest_mpc_sky(v):
    parsed = mpc.parse_sky(v.mpc_lines)
    return parsed.select("row_idx", "time", *nine("ra_deg", "dec_deg"))


@query("ingest_mpc_vectors", """
    SELECT event_id AS row_idx, 'obj' || CAST(user_id AS VARCHAR) AS object, 2460310 + event_id % 365 + 5e-1 AS jd_tt,
           user_id + 25e-2 AS x_au, -(event_id % 1000 + 5e-1) AS y_au,
           CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 10 / 1e1 END AS z_au,
           125e-3 AS vx_au_d, -25e-2 AS vy_au_d, (event_id % 3) * 1e0 AS vz_au_d
    FROM events""")
def ingest_mpc_vectors(v):
    return mpc.parse_vectors(v.vector_lines, "heliocentric")


def _mpc_files(v):
    """A saved response per object of `events`, with every kind of motion, and with and without Moon and uncertainty blocks."""
    e, u = F.col("event_id"), F.col("user_id")

    def tenth(n):
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string"))

    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    line = F.lit("")
    first = F.when(e % 17 == 0, F.lit("2024 13 01 123000")).otherwise(F.concat(F.lit("2024 01 "), two(e % 28 + 1), F.lit(" 123000")))
    fields = [
        (0, first), (18, F.concat(two(e % 24), F.lit(" "), two(e % 60), F.lit(" 07.5"))),
        (29, F.concat(F.when(e % 2 == 0, "+").otherwise("-"), two(e % 90), F.lit(" 30 15"))), (39, tenth(e % 900)), (47, tenth(e % 700)),
        (56, tenth(e % 1800)), (62, tenth(e % 999)), (69, F.when(e % 13 == 0, F.lit("N/A")).otherwise(tenth(e % 200))), (73, tenth(e % 5000)), (82, tenth(e % 3600)),
    ]
    moon = [(92, tenth(e % 3599)), (99, tenth(e % 90)), (104, tenth(e % 80)), (110, tenth(e % 10)), (117, tenth(e % 1799)), (123, tenth(e % 70))]

    def padded(line, fields):
        for start, text in fields:
            line = F.concat(F.rpad(line, start, " "), text)
        return line

    # In steps, as each uses the line before it several times.
    lines = v.table("events").withColumn("line", padded(line, fields))
    line = F.col("line")
    lines = lines.withColumn("line", F.when(u % 2 == 0, padded(line, moon)).otherwise(line))
    unc = F.when(u % 2 == 0, F.rpad(line, 128, " ")).otherwise(F.rpad(line, 92, " "))
    line = F.when(u % 5 == 0, F.rpad(F.concat(unc, F.lpad(tenth(e % 7777), 8, " "), F.lit(" "), tenth(e % 360)), 150, " ")).otherwise(line)
    motion = F.when(u % 3 == 0, '"/hr     P.A.').when(u % 3 == 1, "RA cosD  Dec").otherwise("RA       Dec")
    title = F.concat(F.lit("Date UT R.A. Decl. Sky Motion"), F.when(u % 2 == 0, " Moon").otherwise(""), F.when(u % 5 == 0, " Uncertainty").otherwise(""))
    header = F.concat(F.lit("<html><pre>"), title, F.lit("\n"), F.rpad(F.rpad(F.lit("            h m s"), 73, " "), 73, " "), motion, F.lit("\n"))
    lines = lines.select("user_id", "event_id", line.alias("line"))
    bodies = lines.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("rows"))
    files = bodies.select("user_id", F.concat(header, F.array_join("rows.line", "\n"), F.lit("\n</pre></html>")).alias("value"))
    name = F.concat(F.lit("user_id="), F.coalesce(F.col("user_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit(".txt"))
    return write_texts(files.select(name.alias("file"), "value"), "mpc")


@query("ingest_mpc_files", """
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row_idx, motion,
           TIMESTAMP '2024-01-01 12:30:00' + INTERVAL 1 DAY * (e % 28) AS time,
           round((e % 24 + (e % 60) / 6e1 + 75e-1 / 36e2) * 15e0, 9) AS ra_deg,
           round((CASE WHEN e % 2 = 0 THEN 1 ELSE -1 END) * (e % 90 + 3e1 / 6e1 + 15e0 / 36e2), 9) AS dec_deg,
           e % 900 / 1e1 AS delta_au, e % 700 / 1e1 AS r_au, e % 1800 / 1e1 AS elongation_deg, e % 999 / 1e1 AS phase_deg,
           CASE WHEN e % 13 <> 0 THEN e % 200 / 1e1 END AS v_mag,
           CASE WHEN motion = 'total' THEN round(e % 5000 / 1e1 / 6e1, 9) END AS proper_motion_arcmin_h,
           CASE WHEN motion = 'total' THEN e % 3600 / 1e1 END AS direction_deg,
           CASE WHEN motion = 'coord' THEN round(e % 5000 / 1e1 / 6e1, 9) END AS dra_arcmin_h,
           CASE WHEN motion = 'sky' THEN round(e % 5000 / 1e1 / 6e1, 9) END AS dra_cosdec_arcmin_h,
           CASE WHEN motion <> 'total' THEN round(e % 3600 / 1e1 / 6e1, 9) END AS ddec_arcmin_h,
           CASE WHEN user_id % 2 = 0 THEN e % 3599 / 1e1 END AS azimuth_deg, CASE WHEN user_id % 2 = 0 THEN e % 90 / 1e1 END AS altitude_deg,
           CASE WHEN user_id % 2 = 0 THEN e % 80 / 1e1 END AS sun_altitude_deg, CASE WHEN user_id % 2 = 0 THEN e % 10 / 1e1 END AS moon_phase,
           CASE WHEN user_id % 2 = 0 THEN e % 1799 / 1e1 END AS moon_distance_deg, CASE WHEN user_id % 2 = 0 THEN e % 70 / 1e1 END AS moon_altitude_deg,
           CASE WHEN user_id % 5 = 0 THEN e % 7777 / 1e1 END AS uncertainty_3sig_arcsec, CASE WHEN user_id % 5 = 0 THEN e % 360 / 1e1 END AS uncertainty_pa_deg,
           CAST(e % 24 AS VARCHAR) || ':' || lpad(CAST(e % 60 AS VARCHAR), 2, '0') || ':07.5' AS ra_sexagesimal
    FROM (SELECT event_id, event_id AS e, user_id, CASE user_id % 3 WHEN 0 THEN 'total' WHEN 1 THEN 'sky' ELSE 'coord' END AS motion FROM events)
    QUALIFY e % 17 <> 0""")
def ingest_mpc_files(v):
    """Full sky layouts, written as files and read back, each by its own header."""
    found = mpc.ingest_mpc_files(v.spark, _mpc_files(v), ra_format={"unit": "hourangle", "sep": ":", "precision": 1}).rows
    object_of = F.regexp_extract("source_file", r"user_id=(\d+)", 1).cast("bigint")
    names = [c for c in found.columns if c not in ("source_file", "row_idx", "motion", "time", "ra_sexagesimal")]
    return found.select(object_of.alias("user_id"), F.col("row_idx").cast("bigint").alias("row_idx"), "motion", "time", *nine(*names), "ra_sexagesimal")


@query("ingest_mpc_rejected", """
    SELECT user_id, event_id % 24 AS hours, 'no time' AS reason FROM events WHERE event_id % 17 = 0""")
def ingest_mpc_rejected(v):
    """Lines whose month is 13."""
    faulty = mpc.ingest_mpc_files(v.spark, _mpc_files(v)).rejected
    object_of = F.regexp_extract("source_file", r"user_id=(\d+)", 1).cast("bigint")
    return faulty.select(object_of.alias("user_id"), F.substring("line", 19, 2).cast("bigint").alias("hours"), "reason")


@query("motion_arcmin", "SELECT event_id AS row_idx, value / 6e1 AS arcmin_h FROM events")
def motion_arcmin(v):
    return v.table("events").select(F.col("event_id").alias("row_idx"),
                                    mpc.motion_arcmin(F.col("value")).alias("arcmin_h"))


@query("snapshot_roundtrip", "SELECT * FROM moving_sources", "moving_sources")
def snapshot_roundtrip(v):
    folder = shared_folder(v.spark, "snapshot")
    snapshot.write_snapshot({"moving_sources": v.moving_sources}, folder)
    return snapshot.read_snapshot(v.spark, folder, "moving_sources", keep_ids=True)


@query("snapshot_tables", """
    SELECT 'fixed_sources' AS "table", CAST(source_id AS VARCHAR) AS id, name, NULL AS mpc_id, NULL AS time, ra_deg, dec_deg, flux_mjy, monitored, pointing, NULL AS config
    FROM fixed_sources
    UNION ALL SELECT 'solarsystem_objects', CAST(sso_id AS VARCHAR), name, mpc_id, NULL, NULL, NULL, NULL, monitored, pointing, NULL FROM solarsystem_objects
    UNION ALL SELECT 'moving_sources', CAST(ephem_id AS VARCHAR), name, mpc_id, time, ra_deg, dec_deg, flux_mjy, NULL, NULL, NULL FROM moving_sources
    UNION ALL SELECT 'services', CAST(service_id AS VARCHAR), name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, json_extract_string(config, '$.ra_col') FROM services
    """, "fixed_sources", "solarsystem_objects", "moving_sources", "services")
def snapshot_tables(v):
    """All four tables, written and read back."""
    folder = shared_folder(v.spark, "snapshot")
    services = v.services.withColumn("config", F.from_json("config", "map<string,string>"))
    tables = {"fixed_sources": v.fixed_sources, "solarsystem_objects": v.solarsystem_objects, "moving_sources": v.moving_sources, "services": services}
    snapshot.write_snapshot(tables, folder)
    keys = {"fixed_sources": "source_id", "solarsystem_objects": "sso_id", "moving_sources": "ephem_id", "services": "service_id"}
    kinds = {"name": "string", "mpc_id": "bigint", "time": "timestamp_ntz", "ra_deg": "double", "dec_deg": "double", "flux_mjy": "double",
             "monitored": "boolean", "pointing": "boolean", "config": "string"}
    out = None
    for name, key in keys.items():
        back = snapshot.read_snapshot(v.spark, folder, name, keep_ids=True)
        back = back.toDF(*[c.lower() for c in back.columns])
        if name == "services":
            back = back.withColumn("config", F.col("config")["ra_col"])
        row = back.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("id"),
                          *[(F.col(c) if c in back.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
        out = row if out is None else out.unionByName(row)
    return out


@query("snapshot_range", "SELECT * FROM moving_sources WHERE time BETWEEN TIMESTAMP '2024-01-05 07:00:00' AND TIMESTAMP '2024-01-09 18:30:00'", "moving_sources")
def snapshot_range(v):
    """A time range of a stored table, from the folders of its days."""
    folder = shared_folder(v.spark, "generations")
    generations.write_points(v.moving_sources, folder)
    return generations.read_points(v.spark, folder, "2024-01-05 07:00:00", "2024-01-09 18:30:00", ids="bigint")


@query("snapshot_update", """
    SELECT ephem_id, sso_id, mpc_id, name, CASE WHEN ephem_id % 9 = 0 THEN time + INTERVAL 2 DAY ELSE time END AS time, ra_deg,
           CASE WHEN ephem_id % 3 = 0 THEN 1e0 ELSE dec_deg END AS dec_deg, flux_mjy
    FROM moving_sources WHERE ephem_id NOT IN (SELECT s_suppkey * 7 FROM supplier)""", "moving_sources")
def snapshot_update(v):
    """Points deleted, then others moved in place and time, each as a generation of its own."""
    folder = shared_folder(v.spark, "generations")
    generations.write_points(v.moving_sources, folder)
    generations.delete_points(v.spark, folder, v.table("supplier").select((F.col("s_suppkey") * 7).alias("ephem_id")), ids="bigint")
    third = v.moving_sources.where(F.col("ephem_id") % 3 == 0)
    later = F.when(F.col("ephem_id") % 9 == 0, F.col("time") + F.expr("interval 2 days"))
    generations.update_points(v.spark, folder, third.select("ephem_id", later.alias("time"), F.lit(1.0).alias("dec_deg")), ids="bigint")
    return generations.read_points(v.spark, folder, ids="bigint")


@query("upgrade_flags", """
    SELECT source_id, ra_deg, dec_deg, name, monitored, false AS pointing FROM fixed_sources""", "fixed_sources")
def upgrade_flags(v):
    return snapshot.upgrade_flags(v.fixed_sources.select("source_id", "ra_deg", "dec_deg", "name", "monitored"))


@query("norm_ra", f"SELECT row_idx, {WEBSKY_RA} AS ra_deg FROM websky_rows", "websky_rows")
def norm_ra(v):
    return v.websky_rows.select("row_idx", angles.wrap_ra(F.col("ra_deg")).alias("ra_deg"))


@query("ra_to_signed", """
    SELECT source_id, CASE WHEN ra_deg > 18e1 THEN ra_deg - 36e1 ELSE ra_deg END AS ra_signed FROM fixed_sources
    """, "fixed_sources")
def ra_to_signed(v):
    return v.fixed_sources.select("source_id", angles.signed_ra(F.col("ra_deg")).alias("ra_signed"))


@query("iau_name", f"SELECT det_id, {IAU_SQL} AS name FROM ({IAU_TICKS} FROM detections)", "detections")
def iau_name(v):
    return v.detections.select("det_id", angles.iau_name(F.col("ra_deg"), F.col("dec_deg")).alias("name"))


@query("parse_designation", """
    SELECT row_idx, CAST(split_part(designation, ' ', 1) AS BIGINT) AS mpc_id,
           substr(designation, strpos(designation, ' ') + 1) AS name FROM jpl_rows""", "jpl_rows")
def parse_designation(v):
    mpc_id, name = values.parse_designation(F.col("designation"))
    return v.jpl_rows.select("row_idx", mpc_id.alias("mpc_id"), name.alias("name"))


@query("jd_to_time", f"SELECT row_idx, {JPL_TIME} AS time FROM jpl_rows", "jpl_rows")
def jd_to_time(v):
    return v.jpl_rows.select("row_idx", times.jd_to_time(F.col("julian_day")).alias("time"))


@query("unix_seconds", "SELECT ephem_id, epoch_us(time) AS micros, epoch_us(time) / 1e6 AS seconds FROM moving_sources",
       "moving_sources")
def unix_seconds(v):
    t = F.col("time")
    return v.moving_sources.select("ephem_id", times.unix_micros(t).alias("micros"), times.unix_seconds(t).alias("seconds"))


@query("sexagesimal_to_deg", f"""
    SELECT row_idx, round({MPC_RA}, 9) AS ra_deg, round({MPC_DEC}, 9) AS dec_deg FROM mpc_lines""", "mpc_lines")
def sexagesimal_to_deg(v):
    ra = angles.sexagesimal_to_deg(F.substring("line", 19, 10), hours=True)
    dec = angles.sexagesimal_to_deg(F.substring("line", 30, 9))
    return v.mpc_lines.select("row_idx", nine_digits(ra).alias("ra_deg"), nine_digits(dec).alias("dec_deg"))


@query("deg_to_sexagesimal", """
    SELECT det_id, CAST(r // 36000 AS VARCHAR) || ':' || lpad(CAST(r // 600 % 60 AS VARCHAR), 2, '0') || ':'
             || lpad(CAST(r // 10 % 60 AS VARCHAR), 2, '0') || '.' || CAST(r % 10 AS VARCHAR) AS ra_text,
           CASE WHEN dec_deg < 0 THEN '-' ELSE '' END || CAST(d // 3600 AS VARCHAR) || 'd'
             || lpad(CAST(d // 60 % 60 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(d % 60 AS VARCHAR), 2, '0') || 's' AS dec_text
    FROM (SELECT *, CAST(floor(ra_deg / 15e0 * 36e3 + 5e-1) AS BIGINT) AS r,
                 CAST(floor(abs(dec_deg) * 36e2 + 5e-1) AS BIGINT) AS d FROM detections)""", "detections")
def deg_to_sexagesimal(v):
    return v.detections.select(
        "det_id", angles.deg_to_sexagesimal(F.col("ra_deg"), unit="hourangle", sep=":", precision=1).alias("ra_text"),
        angles.deg_to_sexagesimal(F.col("dec_deg"), precision=0).alias("dec_text"))


@query("service_config", """
    SELECT service_id, name, json_extract_string(config, '$.name_col') AS name_col,
           json_extract_string(config, '$.ra_col') AS ra_col, json_extract_string(config, '$.dec_col') AS dec_col,
           json_extract_string(config, '$.flux_col') AS flux_col
    FROM services""", "services")
def service_config(v):
    keys = ("name_col", "ra_col", "dec_col", "flux_col")
    return v.services.select("service_id", "name", *[values.config_value(F.col("config"), k).alias(k) for k in keys])


@query("boxes_rejected", """
    SELECT box_id, CASE WHEN dec_min > dec_max THEN 'dec_min > dec_max' ELSE 't_min > t_max' END AS reason
    FROM (SELECT box_id, CASE WHEN box_id % 5 = 0 THEN dec_max ELSE dec_min END AS dec_min,
                 CASE WHEN box_id % 5 = 0 THEN dec_min ELSE dec_max END AS dec_max,
                 CASE WHEN box_id % 3 = 0 THEN t_max ELSE t_min END AS t_min,
                 CASE WHEN box_id % 3 = 0 THEN t_min ELSE t_max END AS t_max FROM boxes)
    WHERE dec_min > dec_max OR t_min > t_max""", "boxes")
def boxes_rejected(v):
    fifth, third = F.col("box_id") % 5 == 0, F.col("box_id") % 3 == 0
    mixed = v.boxes.select(
        "box_id", "ra_min", "ra_max",
        F.when(fifth, F.col("dec_max")).otherwise(F.col("dec_min")).alias("dec_min"),
        F.when(fifth, F.col("dec_min")).otherwise(F.col("dec_max")).alias("dec_max"),
        F.when(third, F.col("t_max")).otherwise(F.col("t_min")).alias("t_min"),
        F.when(third, F.col("t_min")).otherwise(F.col("t_max")).alias("t_max"))
    return split_boxes(mixed)[1].select("box_id", "reason")


@query("scan_fits", "SELECT radeg, decdeg, fluxjy, name FROM act_rows", "act_rows")
def scan_fits(v):
    folder = write_parts(v.act_rows.select("radeg", "decdeg", "fluxjy", "name"))
    return fits.read_fits(v.spark, folder, split_bytes=500_000)


# --- from files ----------------------------------------------------------------------------

@query("ingest_websky_file", f"""
    SELECT ra_deg, dec_deg, flux_jy * 1e3 AS flux_mjy, {IAU_SQL} AS name, false AS monitored, false AS pointing
    FROM ({IAU_TICKS} FROM (SELECT flux_jy, dec_deg, {WEBSKY_RA} AS ra_deg FROM websky_rows WHERE NOT flux_jy < 95e-3))
    """, "websky_rows")
def ingest_websky_file(v):
    folder = shared_folder(v.spark, "websky")
    rows = v.websky_rows.select(F.col("flux_jy").alias(" flux(Jy)"), F.col("ra_deg").alias(" RA(deg)"), F.col("dec_deg").alias(" dec(deg) "))
    rows.write.csv(folder, header=True)
    return catalogs.ingest_websky(catalogs.read_websky(v.spark, folder), flux_lower_limit_jy=0.095).rows.select(*FIXED)


@query("ingest_text_file", """
    SELECT ra AS ra_deg, dec AS dec_deg, CAST(NULL AS DOUBLE) AS flux_mjy, name,
           monitored = 'True' AS monitored, false AS pointing
    FROM text_rows""", "text_rows")
def ingest_text_file(v):
    """Half of the files have their columns in another order."""
    folder, odd = shared_folder(v.spark, "text"), F.pmod(F.hash("name"), F.lit(2)) == 1
    v.text_rows.where(odd).select("ra", "dec", "name", "monitored").write.csv(folder, header=True)
    v.text_rows.where(~odd).select("monitored", "dec", "ra", "name").write.mode("append").csv(folder, header=True)
    return catalogs.ingest_text(catalogs.read_text_catalog(v.spark, folder)).rows.select(*FIXED)


@query("ingest_act_file", """
    SELECT radeg AS ra_deg, decdeg AS dec_deg, fluxjy * 1e3 AS flux_mjy, name,
           fluxjy * 1e3 >= 2e1 AS monitored, fluxjy * 1e3 >= 3e2 AS pointing
    FROM act_rows""", "act_rows")
def ingest_act_file(v):
    folder = write_parts(v.act_rows.select(
        F.col("radeg").alias("raDeg"), F.col("decdeg").alias("decDeg"), F.col("fluxjy").alias("fluxJy"), "name"))
    return catalogs.ingest_act(fits.read_fits(v.spark, folder, split_bytes=500_000)).rows.select(*FIXED)


@query("ingest_jpl_file", f"""
    SELECT CAST(split_part(designation, ' ', 1) AS BIGINT) AS mpc_id,
           substr(designation, strpos(designation, ' ') + 1) AS name, {JPL_TIME} AS time, ra_deg, dec_deg, flux_mjy
    FROM (SELECT *, row_number() OVER (PARTITION BY designation ORDER BY row_idx) AS rn FROM jpl_rows)
    WHERE (rn - 1) % 10 = 0""", "jpl_rows")
def ingest_jpl_file(v):
    """Every tenth row of an object, in the order of the files and of the rows in them."""
    folder = shared_folder(v.spark, "jpl")
    v.jpl_rows.orderBy("row_idx").drop("row_idx").write.parquet(folder)
    return jpl.ingest_jpl(jpl.read_jpl(v.spark, folder), every=10).points.select(*POINT)
