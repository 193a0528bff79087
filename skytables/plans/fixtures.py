"""Catalog views over the general-purpose test tables.

The test tables hold no sky data, so positions are derived from keys. One text
serves Spark and DuckDB: `{table}` stands for the Parquet table, doubles are
written `1e2`, and arithmetic is on integers first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


VIEWS: dict[str, str] = {
    "fixed_sources": """
        SELECT c_custkey AS source_id, (c_custkey * 7919 % 36000) / 1e2 AS ra_deg,
               (c_custkey * 104729 % 18001) / 1e2 - 90 AS dec_deg,
               CASE WHEN c_acctbal > 0 THEN c_acctbal / 1e1 END AS flux_mjy, c_name AS name,
               coalesce(c_acctbal / 1e1 >= 2e1, false) AS monitored,
               coalesce(c_acctbal / 1e1 >= 3e2, false) AS pointing
        FROM {customer}""",
    "solarsystem_objects": """
        SELECT DISTINCT user_id AS sso_id, CASE WHEN user_id % 10 = 9 THEN NULL ELSE user_id + 1 END AS mpc_id,
               concat('obj', CAST(user_id AS string)) AS name, user_id % 2 = 0 AS monitored,
               user_id % 5 = 0 AS pointing
        FROM {events}""",
    "moving_sources": """
        SELECT event_id AS ephem_id, user_id AS sso_id,
               CASE WHEN user_id % 10 = 9 THEN NULL ELSE user_id + 1 END AS mpc_id,
               concat('obj', CAST(user_id AS string)) AS name, ts AS time,
               ((user_id * 240 + event_id) % 36000) / 1e2 AS ra_deg,
               ((user_id * 97 + event_id * 3) % 18001) / 1e2 - 90 AS dec_deg,
               CASE WHEN user_id % 7 = 3 AND event_id % 11 = 0 THEN NULL ELSE value END AS flux_mjy
        FROM {events}""",
    "detections": """
        SELECT o_orderkey AS det_id, ((o_orderkey * 7919 + o_custkey * 31) % 36000) / 1e2 + 3e-3 AS ra_deg,
               ((o_orderkey * 104729 + o_custkey * 17) % 18001) / 1e2 - 90 AS dec_deg, o_orderdate AS time
        FROM {orders}""",
    # Detections whose times fall into the month that the ephemerides cover.
    "january_detections": """
        SELECT o_orderkey AS det_id, ((o_orderkey * 7919 + o_custkey * 31) % 36000) / 1e2 + 3e-3 AS ra_deg,
               ((o_orderkey * 104729 + o_custkey * 17) % 18001) / 1e2 - 90 AS dec_deg,
               CAST('2024-01-01 00:00:00' AS {naive}) + INTERVAL 1 SECOND * (o_orderkey * 7919 % 2592000) AS time
        FROM {orders}""",
    "act_rows": """
        SELECT l_orderkey * 10 + l_linenumber AS row_idx, (l_partkey * 7919 % 36000) / 1e2 AS radeg,
               (l_suppkey * 104729 % 18001) / 1e2 - 90 AS decdeg, l_quantity / 1e2 AS fluxjy,
               concat('Source_', CAST(l_partkey AS string)) AS name
        FROM {lineitem}""",
    "websky_rows": """
        SELECT p_partkey AS row_idx, p_retailprice / 1e4 AS flux_jy,
               (p_partkey * 7919 % 36000) / 1e2 - 180 AS ra_deg, (p_partkey * 104729 % 18001) / 1e2 - 90 AS dec_deg
        FROM {part}""",
    "text_rows": """
        SELECT (s_suppkey * 7919 % 36000) / 1e2 AS ra, (s_suppkey * 104729 % 18001) / 1e2 - 90 AS dec, s_name AS name,
               CASE WHEN s_acctbal > 0 THEN 'True' ELSE 'False' END AS monitored
        FROM {supplier}""",
    "jpl_rows": """
        SELECT event_id AS row_idx,
               concat(CAST(user_id + 1 AS string), ' Obj ', CAST(user_id AS string)) AS designation,
               2460310.5e0 + event_id / 1024e0 AS julian_day, ((user_id * 240 + event_id) % 36000) / 1e2 AS ra_deg,
               ((user_id * 97 + event_id * 3) % 18001) / 1e2 - 90 AS dec_deg,
               CASE WHEN user_id % 7 = 3 AND event_id % 11 = 0 THEN NULL ELSE value END AS flux_mjy
        FROM {events}""",
    "mpc_lines": """
        SELECT event_id AS row_idx,
               concat('2024 01 ', lpad(CAST(1 + event_id % 28 AS string), 2, '0'), ' 123000 ',
                      lpad(CAST(event_id % 24 AS string), 2, '0'), ' ',
                      lpad(CAST(event_id % 60 AS string), 2, '0'), ' 07.5 ',
                      CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END,
                      lpad(CAST(event_id % 90 AS string), 2, '0'), ' 30 15 ') AS line
        FROM {events}""",
    "vector_lines": """
        SELECT event_id AS row_idx,
               concat(rpad(concat('obj', CAST(user_id AS string)), 12, ' '),
                      rpad(concat(CAST(2460310 + event_id % 365 AS string), '.5'), 16, ' '),
                      rpad(concat(CAST(user_id AS string), '.25'), 17, ' '),
                      rpad(concat('-', CAST(event_id % 1000 AS string), '.5'), 16, ' '),
                      rpad(CASE WHEN event_id % 13 = 0 THEN 'N/A' ELSE concat('0.', CAST(event_id % 10 AS string)) END, 16, ' '),
                      rpad('0.125', 15, ' '), rpad('-0.25', 16, ' '), CAST(event_id % 3 AS string)) AS line
        FROM {events}""",
    "provider_a": """
        SELECT c_name AS main_id, (c_custkey * 7919 % 36000) / 1e2 AS ra,
               (c_custkey * 104729 % 18001) / 1e2 - 90 AS dec
        FROM {customer}""",
    "provider_b": """
        SELECT s_name AS src, (s_suppkey * 7919 % 36000) / 1e2 + 1e-2 AS ra_j2000,
               (s_suppkey * 104729 % 18001) / 1e2 - 90 AS de_j2000, s_acctbal / 1e1 AS s_mjy
        FROM {supplier}""",
    # Boxes on the sky, some of them across RA 0/360, with a time range each.
    "boxes": """
        SELECT s_suppkey AS box_id, (s_suppkey * 37 % 360) * 1e0 AS ra_min,
               ((s_suppkey * 37 + 5 + s_suppkey % 40) % 360) * 1e0 AS ra_max,
               (s_suppkey * 13 % 160) * 1e0 - 90 AS dec_min,
               (s_suppkey * 13 % 160) * 1e0 - 90 + 1 + s_suppkey % 20 AS dec_max,
               CAST('2024-01-01 00:00:00' AS {naive}) + INTERVAL 1 DAY * (s_suppkey % 20) AS t_min,
               CAST('2024-01-01 00:00:00' AS {naive}) + INTERVAL 1 DAY * (s_suppkey % 20 + 1 + s_suppkey % 7) AS t_max
        FROM {supplier}""",
    "services": """
        SELECT n_nationkey AS service_id, n_name AS name,
               concat('{{"name_col":"main_id","ra_col":"ra_', CAST(n_regionkey AS string), '","dec_col":"dec"',
                      CASE WHEN n_nationkey % 2 = 0 THEN ',"flux_col":"mjy"' ELSE '' END, '}}') AS config
        FROM {nation}""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet files of `folder`."""
    sources = {t: f"parquet.`{folder}/{t}.parquet`" for t in TABLES}
    return spark.sql(VIEWS[name].format(**sources, naive="TIMESTAMP_NTZ"))


def with_views(sql: str, *used: str) -> str:
    """SQL text for DuckDB with the views it uses put in front."""
    sources = {t: t for t in TABLES}
    ctes = [f"{name} AS ({VIEWS[name].format(**sources, naive='TIMESTAMP')})" for name in used]
    return f"WITH {', '.join(ctes)}\n{sql}"
