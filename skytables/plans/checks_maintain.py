"""Checked queries: insert, update, delete and integrity.

Ids made on insert are hashes; the checks compare whether an id was made, and
all other columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity, maintain
from .registry import query

MADE = "length({key}) = 64"


def _made(df, key: str, *columns: str):
    return df.select((F.length(key) == 64).alias("made"), *columns)


FIXED_VALUES = ("ra_deg", "dec_deg", "flux_mJy", "name", "monitored", "pointing")


def _act(v):
    """Catalog rows, some without a position."""
    return v.act_rows.select(
        F.when(F.col("row_idx") % 17 != 0, F.col("radeg")).alias("ra_deg"), F.col("decdeg").alias("dec_deg"),
        (F.col("fluxjy") * 1e3).alias("flux_mJy"), "name")


@query("insert_fixed", """
    SELECT false AS made, ra_deg, dec_deg, flux_mjy, name, monitored, pointing FROM fixed_sources
    UNION ALL SELECT true, radeg, decdeg, fluxjy * 1e3, name, false, false FROM act_rows WHERE row_idx % 17 <> 0
    """, "fixed_sources", "act_rows")
def insert_fixed(v):
    return _made(maintain.insert_fixed(v.fixed_sources, _act(v), "act").table, "source_id", *FIXED_VALUES)


@query("insert_rejected", """
    SELECT decdeg AS dec_deg, fluxjy * 1e3 AS flux_mjy, name, 'missing position' AS reason
    FROM act_rows WHERE row_idx % 17 = 0""", "act_rows")
def insert_rejected(v):
    return maintain.insert_fixed(v.fixed_sources, _act(v), "act").rejected.select("dec_deg", "flux_mJy", "name", "reason")


@query("insert_sso", """
    SELECT false AS made, mpc_id, name, monitored, pointing FROM solarsystem_objects
    UNION ALL SELECT true, 1000000 + p_partkey, p.p_key, false, false
    FROM (SELECT p_partkey, concat('obj', CAST(p_partkey AS VARCHAR)) AS p_key FROM part) p
    WHERE p_key NOT IN (SELECT name FROM solarsystem_objects)""", "solarsystem_objects")
def insert_sso(v):
    new = v.table("part").select((F.col("p_partkey") + 1_000_000).alias("MPC_id"),
                                 F.concat(F.lit("obj"), F.col("p_partkey").cast("string")).alias("name"))
    return _made(maintain.insert_sso(v.solarsystem_objects, new).table, "sso_id", "MPC_id", "name", "monitored", "pointing")


def _new_points(v):
    o = F.col
    return v.table("orders").select(
        o("o_custkey").alias("sso_id"), o("o_orderdate").alias("time"),
        ((o("o_orderkey") * 7919 % 36000) / 1e2).alias("ra_deg"),
        ((o("o_orderkey") * 104729 % 18001) / 1e2 - 90).alias("dec_deg"))


@query("insert_ephem", """
    SELECT false AS made, CAST(sso_id AS VARCHAR) AS sso_id, mpc_id, name, time, ra_deg, dec_deg, flux_mjy
    FROM moving_sources
    UNION ALL SELECT true, CAST(o_custkey AS VARCHAR), mpc_id, name, o_orderdate, (o_orderkey * 7919 % 36000) / 1e2,
                     (o_orderkey * 104729 % 18001) / 1e2 - 90, NULL
    FROM orders JOIN solarsystem_objects ON sso_id = o_custkey""", "moving_sources", "solarsystem_objects")
def insert_ephem(v):
    done = maintain.insert_ephem(v.moving_sources, v.solarsystem_objects, _new_points(v))
    return _made(done.table, "ephem_id", "sso_id", "MPC_id", "name", "time", "ra_deg", "dec_deg", "flux_mJy")


def _services(v):
    return v.services.withColumn("config", F.from_json("config", "map<string,string>"))


@query("insert_service", """
    SELECT false AS made, name, json_extract_string(config, '$.ra_col') AS ra_col FROM services
    UNION ALL SELECT true, r_name, 'ra' FROM region""", "services")
def insert_service(v):
    new = v.table("region").select(F.col("r_name").alias("name"), F.create_map(
        F.lit("name_col"), F.lit("id"), F.lit("ra_col"), F.lit("ra"), F.lit("dec_col"), F.lit("dec")).alias("config"))
    done = maintain.insert_service(_services(v), new).table
    return _made(done.withColumn("ra_col", F.col("config")["ra_col"]), "service_id", "name", "ra_col")


def _last(column: str) -> str:
    return f"arg_max({column}, o_orderkey) FILTER (WHERE {column} IS NOT NULL)"


@query("update_source", f"""
    , u AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS flux,
                   CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus = 'F' END AS mon,
                   CASE WHEN o_orderkey % 5 = 0 THEN concat('renamed', CAST(o_orderkey AS VARCHAR)) END AS nm
            FROM orders),
    l AS (SELECT o_custkey, {_last('flux')} AS flux, {_last('mon')} AS mon, {_last('nm')} AS nm FROM u GROUP BY o_custkey)
    SELECT source_id, ra_deg, dec_deg, coalesce(flux, flux_mjy) AS flux_mjy, coalesce(nm, name) AS name,
           coalesce(mon, monitored) AS monitored, pointing
    FROM fixed_sources LEFT JOIN l ON o_custkey = source_id""", "fixed_sources")
def update_source(v):
    key = F.col("o_orderkey")
    updates = v.table("orders").select(
        F.col("o_custkey").alias("source_id"), key.alias("ord"),
        F.when(key % 3 == 0, F.col("o_totalprice")).alias("flux_mJy"),
        F.when(key % 4 == 0, F.col("o_orderstatus") == "F").alias("monitored"),
        F.when(key % 5 == 0, F.concat(F.lit("renamed"), key.cast("string"))).alias("name"))
    return maintain.update_source(v.fixed_sources, updates, order="ord").table


SSO_UPDATES = """
    u AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN concat('new', CAST(s_suppkey AS VARCHAR)) END AS nm,
                 CASE WHEN s_suppkey % 3 = 0 THEN 5000000 + s_suppkey END AS mpc FROM supplier)"""


def _sso_updates(v):
    key = F.col("s_suppkey")
    return v.table("supplier").select(
        key.alias("sso_id"), F.when(key % 2 == 0, F.concat(F.lit("new"), key.cast("string"))).alias("name"),
        F.when(key % 3 == 0, key + 5_000_000).alias("MPC_id"))


def _ssos(v):
    return v.solarsystem_objects


@query("update_sso", f"""
    , {SSO_UPDATES}
    SELECT sso_id, coalesce(mpc, mpc_id) AS mpc_id, coalesce(nm, name) AS name, monitored, pointing
    FROM solarsystem_objects LEFT JOIN u ON id = sso_id""", "solarsystem_objects")
def update_sso(v):
    return maintain.update_sso(_ssos(v), _sso_updates(v)).table


@query("update_rejected", f"""
    WITH {SSO_UPDATES} SELECT id AS sso_id, 'nothing to update' AS reason FROM u WHERE nm IS NULL AND mpc IS NULL""")
def update_rejected(v):
    return maintain.update_sso(_ssos(v), _sso_updates(v)).rejected.select("sso_id", "reason")


@query("update_missing", """
    SELECT s_suppkey AS sso_id FROM supplier WHERE (s_suppkey % 2 = 0 OR s_suppkey % 3 = 0)
      AND s_suppkey NOT IN (SELECT user_id FROM events WHERE user_id % 4 <> 0)""")
def update_missing(v):
    known = _ssos(v).where(F.col("sso_id") % 4 != 0)
    return maintain.update_sso(known, _sso_updates(v)).missing


@query("update_sso_cascade", f"""
    , {SSO_UPDATES}
    SELECT ephem_id, sso_id, CASE WHEN id IS NULL THEN mpc_id ELSE coalesce(mpc, mpc_id) END AS mpc_id,
           coalesce(nm, name) AS name, time, ra_deg, dec_deg, flux_mjy
    FROM moving_sources LEFT JOIN u ON id = sso_id""", "moving_sources")
def update_sso_cascade(v):
    return maintain.update_sso_cascade(_ssos(v), v.moving_sources, _sso_updates(v)).points


@query("update_cascade_both", f"""
    , {SSO_UPDATES}
    SELECT 'object' AS kind, NULL AS ephem_id, sso_id, coalesce(mpc, mpc_id) AS mpc_id, coalesce(nm, name) AS name
    FROM solarsystem_objects LEFT JOIN u ON id = sso_id
    UNION ALL SELECT 'point', ephem_id, sso_id, CASE WHEN id IS NULL THEN mpc_id ELSE coalesce(mpc, mpc_id) END, coalesce(nm, name)
    FROM moving_sources LEFT JOIN u ON id = sso_id""", "solarsystem_objects", "moving_sources")
def update_cascade_both(v):
    return _both_sides(maintain.update_sso_cascade(_ssos(v), v.moving_sources, _sso_updates(v)))


def _both_sides(done):
    objects = done.ssos.select(F.lit("object").alias("kind"), F.lit(None).cast("bigint").alias("ephem_id"), "sso_id", "mpc_id", "name")
    return objects.unionByName(done.points.select(F.lit("point").alias("kind"), "ephem_id", "sso_id", "mpc_id", "name"))


@query("update_ephem", """
    SELECT ephem_id, sso_id, mpc_id, name, coalesce(o_orderdate, time) AS time, ra_deg,
           coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 90 * 1e0 END, dec_deg) AS dec_deg,
           coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, flux_mjy) AS flux_mjy
    FROM moving_sources LEFT JOIN orders ON o_orderkey = ephem_id""", "moving_sources")
def update_ephem(v):
    key = F.col("o_orderkey")
    updates = v.table("orders").select(
        key.alias("ephem_id"), F.col("o_orderdate").alias("time"),
        F.when(key % 2 == 0, key % 90 * 1e0).alias("dec_deg"),
        F.when(key % 3 == 0, F.col("o_totalprice")).alias("flux_mJy"))
    return maintain.update_ephem(v.moving_sources, updates).table


@query("update_service", """
    SELECT service_id, CASE WHEN service_id % 2 = 0 THEN concat(name, '2') ELSE name END AS name,
           CASE WHEN service_id % 3 = 0 THEN 'ra2' ELSE json_extract_string(config, '$.ra_col') END AS ra_col
    FROM services""", "services")
def update_service(v):
    key = F.col("n_nationkey")
    updates = v.table("nation").select(
        key.alias("service_id"), F.when(key % 2 == 0, F.concat("n_name", F.lit("2"))).alias("name"),
        F.when(key % 3 == 0, F.create_map(F.lit("ra_col"), F.lit("ra2"))).alias("config"))
    done = maintain.update_service(_services(v), updates).table
    return done.select("service_id", "name", F.col("config")["ra_col"].alias("ra_col"))


@query("insert_sso_rejected", """
    SELECT name, mpc_id, 'name not unique' AS reason FROM solarsystem_objects
    UNION ALL SELECT concat('fresh', CAST(s_suppkey AS VARCHAR)), mpc_id, 'MPC_id not unique'
    FROM supplier JOIN solarsystem_objects ON sso_id = s_suppkey WHERE mpc_id IS NOT NULL""", "solarsystem_objects")
def insert_sso_rejected(v):
    """Known ids with another flag, and new names with the MPC id of a known object."""
    known = v.solarsystem_objects
    changed = known.withColumn("monitored", ~F.col("monitored"))
    taken = known.join(v.table("supplier"), known.sso_id == F.col("s_suppkey")).where(F.col("MPC_id").isNotNull()).select(
        F.lit(None).cast("string").alias("sso_id"), "MPC_id", F.concat(F.lit("fresh"), F.col("sso_id").cast("string")).alias("name"),
        F.lit(False).alias("monitored"), F.lit(False).alias("pointing"))
    return maintain.insert_sso(known, changed.unionByName(taken)).rejected.select("name", "mpc_id", "reason")


@query("insert_given_ids", """
    SELECT 'added' AS what, CAST(p_partkey + 10000000 AS VARCHAR) AS source_id FROM part
    UNION ALL SELECT 'rejected', CAST(source_id AS VARCHAR) FROM fixed_sources WHERE source_id % 2 = 1""", "fixed_sources")
def insert_given_ids(v):
    """New ids are added; of the ids that are there, equal rows count as there and changed ones are rejected."""
    there = v.fixed_sources.withColumn("dec_deg", F.when(F.col("source_id") % 2 == 1, -F.col("dec_deg") / 2 + 1e0).otherwise(F.col("dec_deg")))
    new = v.table("part").select((F.col("p_partkey") + 10_000_000).alias("source_id"), F.lit(1e0).alias("ra_deg"), F.lit(2e0).alias("dec_deg"))
    done = maintain.insert_fixed(v.fixed_sources, there.unionByName(new, allowMissingColumns=True))
    return done.added.select(F.lit("added").alias("what"), "source_id").union(done.rejected.select(F.lit("rejected"), "source_id"))


@query("insert_ephem_ids", """
    SELECT count(*) AS n_added, count(*) AS n_ids FROM orders JOIN solarsystem_objects ON sso_id = o_custkey""", "solarsystem_objects")
def insert_ephem_ids(v):
    done = maintain.insert_ephem(v.moving_sources, v.solarsystem_objects, _new_points(v))
    return done.added.agg(F.count("ephem_id").alias("n_added"), F.countDistinct("ephem_id").alias("n_ids"))


@query("update_sso_rejected", """
    SELECT a.sso_id, 'name not unique' AS reason FROM solarsystem_objects a
    JOIN solarsystem_objects b ON b.sso_id = a.sso_id + 1""", "solarsystem_objects")
def update_sso_rejected(v):
    """Every object is to take the name of the next one."""
    known = v.solarsystem_objects
    following = known.select((F.col("sso_id") - 1).alias("sso_id"), "name")
    updates = following.join(known.select("sso_id"), "sso_id")
    return maintain.update_sso(known, updates).rejected.select("sso_id", "reason")


@query("update_sso_swap", """
    SELECT a.sso_id, a.mpc_id, coalesce(b.name, a.name) AS name, a.monitored, a.pointing FROM solarsystem_objects a
    LEFT JOIN solarsystem_objects b ON b.sso_id = a.sso_id + 1 - 2 * (a.sso_id % 2)""", "solarsystem_objects")
def update_sso_swap(v):
    """Objects 2k and 2k + 1 swap their names in one statement; none is refused."""
    known = v.solarsystem_objects
    other = known.select((F.col("sso_id") + 1 - 2 * (F.col("sso_id") % 2)).alias("sso_id"), "name")
    return maintain.update_sso(known, other.join(known.select("sso_id"), "sso_id")).table


@query("update_sso_one_name", """
    SELECT sso_id, 'name not unique' AS reason FROM solarsystem_objects WHERE sso_id % 3 = 0""", "solarsystem_objects")
def update_sso_one_name(v):
    """Very many updates to one name are all refused."""
    known = v.solarsystem_objects
    updates = known.where(F.col("sso_id") % 3 == 0).select("sso_id", F.lit("the same").alias("name"))
    return maintain.update_sso(known, updates).rejected.select("sso_id", "reason")


@query("update_ephem_rejected", """
    SELECT ephem_id, 'unknown sso_id' AS reason FROM moving_sources WHERE ephem_id % 3 = 0""", "moving_sources")
def update_ephem_rejected(v):
    updates = v.moving_sources.where(F.col("ephem_id") % 3 == 0).select("ephem_id", (F.col("sso_id") + 1_000_000_000).alias("sso_id"))
    return maintain.update_ephem(v.moving_sources, updates, ssos=v.solarsystem_objects).rejected.select("ephem_id", "reason")


@query("update_order_rejected", """
    SELECT o_custkey AS source_id, 'missing order' AS reason FROM orders WHERE o_orderkey % 2 = 0""")
def update_order_rejected(v):
    updates = v.table("orders").select(
        F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderkey")).alias("ord"),
        F.col("o_totalprice").alias("flux_mJy"))
    return maintain.update_source(v.fixed_sources, updates, order="ord").rejected.select("source_id", "reason")


@query("delete_source", "SELECT * FROM fixed_sources WHERE source_id NOT IN (SELECT s_suppkey FROM supplier)",
       "fixed_sources")
def delete_source(v):
    keys = v.table("supplier").select(F.col("s_suppkey").alias("source_id"))
    return maintain.delete(v.fixed_sources, keys, "source_id").table


@query("delete_missing", """
    SELECT DISTINCT l_partkey AS source_id FROM lineitem WHERE l_partkey NOT IN (SELECT source_id FROM fixed_sources)
    """, "fixed_sources")
def delete_missing(v):
    keys = v.table("lineitem").select(F.col("l_partkey").alias("source_id"))
    return maintain.delete(v.fixed_sources, keys, "source_id").missing


@query("delete_ephem", "SELECT * FROM moving_sources WHERE ephem_id NOT IN (SELECT p_partkey FROM part)", "moving_sources")
def delete_ephem(v):
    keys = v.table("part").select(F.col("p_partkey").alias("ephem_id"))
    return maintain.delete(v.moving_sources, keys, "ephem_id").table


@query("delete_service", "SELECT * FROM services WHERE service_id NOT IN (SELECT r_regionkey FROM region)", "services")
def delete_service(v):
    keys = v.table("region").select(F.col("r_regionkey").alias("service_id"))
    return maintain.delete(v.services, keys, "service_id").table


@query("delete_sso_cascade", "SELECT * FROM moving_sources WHERE sso_id NOT IN (SELECT s_suppkey FROM supplier)",
       "moving_sources")
def delete_sso_cascade(v):
    keys = v.table("supplier").select(F.col("s_suppkey").alias("sso_id"))
    return maintain.delete_sso_cascade(v.solarsystem_objects, v.moving_sources, keys).points


@query("delete_cascade_both", """
    SELECT 'object' AS kind, NULL AS ephem_id, sso_id, mpc_id, name FROM solarsystem_objects WHERE sso_id NOT IN (SELECT s_suppkey FROM supplier)
    UNION ALL SELECT 'point', ephem_id, sso_id, mpc_id, name FROM moving_sources WHERE sso_id NOT IN (SELECT s_suppkey FROM supplier)
    """, "solarsystem_objects", "moving_sources")
def delete_cascade_both(v):
    keys = v.table("supplier").select(F.col("s_suppkey").alias("sso_id"))
    return _both_sides(maintain.delete_sso_cascade(v.solarsystem_objects, v.moving_sources, keys))


# --- counts and integrity ------------------------------------------------------------------

@query("catalog_counts", """
    SELECT 'fixed_sources' AS "table", count(*) AS n FROM fixed_sources
    UNION ALL SELECT 'solarsystem_objects', count(*) FROM solarsystem_objects
    UNION ALL SELECT 'moving_sources', count(*) FROM moving_sources
    UNION ALL SELECT 'services', count(*) FROM services
    """, "fixed_sources", "solarsystem_objects", "moving_sources", "services")
def catalog_counts(v):
    return integrity.catalog_counts({
        "fixed_sources": v.fixed_sources, "solarsystem_objects": v.solarsystem_objects,
        "moving_sources": v.moving_sources, "services": v.services})


# Tables with faults, made from the orders and customers.
FAULTY = """
    bad_ssos AS (SELECT c_custkey AS sso_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 END AS mpc_id,
                        CASE WHEN c_custkey % 101 = 0 THEN NULL ELSE concat('obj', CAST(c_custkey % 1000 AS string)) END AS name,
                        false AS monitored, false AS pointing FROM {customer}),
    bad_points AS (SELECT o_orderkey AS ephem_id, CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE o_custkey + 20 END AS sso_id,
                          CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 70 END AS mpc_id,
                          concat('obj', CAST(o_custkey % 1100 AS string)) AS name, o_orderdate AS time,
                          (o_orderkey * 7919 % 36100) / 1e2 AS ra_deg, (o_orderkey * 104729 % 18101) / 1e2 - 90 AS dec_deg,
                          CAST(NULL AS DOUBLE) AS flux_mjy FROM {orders})"""


def _faulty(v, name: str):
    names = {t: f"parquet.`{v.folder}/{t}.parquet`" for t in ("customer", "orders")}
    return v.spark.sql(f"WITH {FAULTY.format(**names)} SELECT * FROM {name}")


FAULTY_SQL = FAULTY.format(customer="customer", orders="orders")
NOT_OWNER = """
    concat_ws(',', CASE WHEN sso_id IS NULL OR sso_id NOT IN (SELECT sso_id FROM bad_ssos) THEN 'sso_id' END,
              CASE WHEN mpc_id IS NOT NULL AND mpc_id NOT IN (SELECT mpc_id FROM bad_ssos WHERE mpc_id IS NOT NULL) THEN 'MPC_id' END,
              CASE WHEN name IS NULL OR name NOT IN (SELECT name FROM bad_ssos WHERE name IS NOT NULL) THEN 'name' END)"""


@query("orphan_ephem", f"""
    WITH {FAULTY_SQL} SELECT * FROM (SELECT ephem_id, sso_id, mpc_id, name, {NOT_OWNER} AS detail FROM bad_points)
    WHERE detail <> ''""")
def orphan_ephem(v):
    found = integrity.orphan_ephem(_faulty(v, "bad_points"), _faulty(v, "bad_ssos"))
    return found.select("ephem_id", "sso_id", "mpc_id", "name", "detail")


@query("duplicate_sso_keys", f"""
    WITH {FAULTY_SQL}
    SELECT 'name' AS "column", name AS value, count(*) AS n_rows FROM bad_ssos WHERE name IS NOT NULL
    GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT 'MPC_id', CAST(mpc_id AS VARCHAR), count(*) FROM bad_ssos WHERE mpc_id IS NOT NULL
    GROUP BY mpc_id HAVING count(*) > 1""")
def duplicate_sso_keys(v):
    return integrity.duplicate_sso_keys(_faulty(v, "bad_ssos"))


@query("integrity_report", f"""
    WITH {FAULTY_SQL}, all_points AS (SELECT *, {NOT_OWNER} AS detail FROM bad_points)
    SELECT 'solarsystem_objects' AS "table", 'null' AS rule, CAST(sso_id AS VARCHAR) AS key, 'name' AS detail
    FROM bad_ssos WHERE name IS NULL
    UNION ALL SELECT 'solarsystem_objects', 'duplicate name', name, CAST(count(*) AS VARCHAR) FROM bad_ssos
    WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT 'solarsystem_objects', 'duplicate MPC_id', CAST(mpc_id AS VARCHAR), CAST(count(*) AS VARCHAR)
    FROM bad_ssos WHERE mpc_id IS NOT NULL GROUP BY mpc_id HAVING count(*) > 1
    UNION ALL SELECT 'moving_sources', 'null', CAST(ephem_id AS VARCHAR), 'sso_id' FROM bad_points WHERE sso_id IS NULL
    UNION ALL SELECT 'moving_sources', 'out of range', CAST(ephem_id AS VARCHAR), 'ra_deg' FROM bad_points WHERE ra_deg >= 36e1
    UNION ALL SELECT 'moving_sources', 'out of range', CAST(ephem_id AS VARCHAR), 'dec_deg' FROM bad_points WHERE dec_deg > 9e1
    UNION ALL SELECT 'moving_sources', 'orphan', CAST(ephem_id AS VARCHAR), detail FROM all_points WHERE detail <> ''
    UNION ALL SELECT 'moving_sources', 'duplicate time',
                     concat_ws(' ', CAST(sso_id AS VARCHAR), strftime(time, '%Y-%m-%d %H:%M:%S')), CAST(count(*) AS VARCHAR)
    FROM bad_points WHERE sso_id IS NOT NULL GROUP BY sso_id, time HAVING count(*) > 1""")
def integrity_report(v):
    fixed = v.detections.select(F.col("det_id").alias("source_id"), "ra_deg", "dec_deg")
    return integrity.integrity_report(fixed, _faulty(v, "bad_ssos"), _faulty(v, "bad_points"))
