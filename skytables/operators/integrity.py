"""Integrity reports: one row per violation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .skew import HOT_ROWS, attach_hot, hot_keys, saved

#: Keys that a task counts, about: it holds them all, some 100 bytes each.
TASK_KEYS = 2_000_000


def orphan_ephem(points: DataFrame, ssos: DataFrame) -> DataFrame:
    """Points whose object id, MPC id or name does not exist; a null MPC id is allowed.

    The distinct (id, MPC id, name) of the points are tested first, so an object
    with a huge number of points is tested once; only the bad ones, normally
    few or none, go back to the points.
    """
    triple = ["sso_id", "MPC_id", "name"]
    owners = points.select(*triple).distinct()
    checked = (
        owners.join(ssos.select("sso_id", F.lit(True).alias("_id")).distinct(), "sso_id", "left")
        .join(ssos.select("MPC_id", F.lit(True).alias("_mpc")).where("MPC_id is not null").distinct(), "MPC_id", "left")
        .join(ssos.select("name", F.lit(True).alias("_name")).distinct(), "name", "left")
    )
    detail = F.concat_ws(
        ",", F.when(F.col("_id").isNull(), F.lit("sso_id")),
        F.when(F.col("MPC_id").isNotNull() & F.col("_mpc").isNull(), F.lit("MPC_id")),
        F.when(F.col("_name").isNull(), F.lit("name")))
    bad = checked.select(*[F.col(c).alias(f"_{c}") for c in triple], detail.alias("detail")).where("detail != ''")
    bad = saved(bad, "orphans")
    cond = reduce(Column.__and__, [points[c].eqNullSafe(bad[f"_{c}"]) for c in triple])
    return points.join(bad, cond).drop(*[f"_{c}" for c in triple])


def repeated(table: DataFrame, columns: list[str], n_rows: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Values of `columns` (nulls exempt) held by more than one row, with `n_rows`.

    Keys are dealt by number, TASK_KEYS to a task: they compress so well that Spark would
    put partitions of many millions together for their few bytes. Values held by very many
    rows are counted where they are found first. `n_rows` passes on a count of the table.
    """
    rows = table.select(*columns)
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())

    def counted(some: DataFrame) -> DataFrame:
        return some.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)

    tasks = math.ceil((table.count() if n_rows is None else n_rows) / TASK_KEYS)
    if tasks <= 1:
        return counted(rows)
    hot = hot_keys(rows, columns, hot_rows)
    if hot is None:
        return counted(rows.repartition(tasks, *columns))
    marked = attach_hot(rows, hot.withColumnRenamed("n_rows", "_rows"), columns)
    usual, crowded = (marked.where(cond).drop("_rows") for cond in (F.col("_rows").isNull(), F.col("_rows").isNotNull()))
    return counted(usual.repartition(tasks, *columns)).unionByName(counted(crowded))


def duplicate_sso_keys(ssos: DataFrame, n_rows: int | None = None) -> DataFrame:
    """(column, value, n_rows) of SSO names and MPC ids that are not unique."""
    n_rows = ssos.count() if n_rows is None else n_rows
    parts = [
        repeated(ssos, [c], n_rows).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "n_rows")
        for c in ("name", "MPC_id")
    ]
    return parts[0].unionByName(parts[1])


def integrity_report(fixed: DataFrame, ssos: DataFrame, points: DataFrame) -> DataFrame:
    """(table, rule, key, detail) for every violation in the three tables."""

    def rows(df: DataFrame, table: str, rule: str, key: Column, detail: Column) -> DataFrame:
        return df.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"),
                         key.cast("string").alias("key"), detail.cast("string").alias("detail"))

    def per_row(df: DataFrame, table: str, key: str, required: list[str], position: bool) -> DataFrame:
        """All row rules of a table in one scan: an array of faults per row, exploded."""
        faults = [F.when(F.col(c).isNull(), F.struct(F.lit("null").alias("rule"), F.lit(c).alias("detail")))
                  for c in required]
        if position:
            for c, low, high in (("ra_deg", 0.0, 360.0), ("dec_deg", -90.0, 90.0)):
                over = F.col(c) >= high if c == "ra_deg" else F.col(c) > high
                faults.append(F.when((F.col(c) < low) | over | F.isnan(c),
                                     F.struct(F.lit("out of range").alias("rule"), F.lit(c).alias("detail"))))
        found = df.withColumn("_fault", F.explode(F.array_compact(F.array(*faults))))
        return found.select(F.lit(table).alias("table"), F.col("_fault.rule").alias("rule"),
                            F.col(key).cast("string").alias("key"), F.col("_fault.detail").alias("detail"))

    both = F.concat_ws(" ", F.col("sso_id").cast("string"), F.col("time").cast("string"))
    n_fixed, n_ssos, n_points = (df.count() for df in (fixed, ssos, points))
    parts = [
        per_row(fixed, "fixed_sources", "source_id", ["source_id", "ra_deg", "dec_deg"], True),
        per_row(ssos, "solarsystem_objects", "sso_id", ["sso_id", "name"], False),
        per_row(points, "moving_sources", "ephem_id",
                ["ephem_id", "sso_id", "name", "time", "ra_deg", "dec_deg"], True),
        rows(orphan_ephem(points, ssos), "moving_sources", "orphan", F.col("ephem_id"), F.col("detail")),
        rows(repeated(points, ["sso_id", "time"], n_points), "moving_sources", "duplicate time", both, F.col("n_rows")),
        rows(repeated(fixed, ["source_id"], n_fixed), "fixed_sources", "duplicate key", F.col("source_id"), F.col("n_rows")),
        rows(repeated(ssos, ["sso_id"], n_ssos), "solarsystem_objects", "duplicate key", F.col("sso_id"), F.col("n_rows")),
        rows(repeated(points, ["ephem_id"], n_points), "moving_sources", "duplicate key", F.col("ephem_id"), F.col("n_rows")),
        duplicate_sso_keys(ssos, n_ssos).select(
            F.lit("solarsystem_objects").alias("table"), F.concat(F.lit("duplicate "), F.col("column")).alias("rule"),
            F.col("value").alias("key"), F.col("n_rows").cast("string").alias("detail")),
    ]
    return reduce(DataFrame.unionByName, parts)


def catalog_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) for each table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
