"""Registered queries: a Spark query and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.boxes import Box
from .fixtures import view, with_views

#: The box, wrapped box, time range and moment used by the checks (fixed values).
BOX = Box(10.0, 200.0, -60.0, 60.0)
WRAPPED = Box(350.0, 20.0, -60.0, 60.0)
T_MIN, T_MAX, T_AT = "2024-01-05 00:00:00", "2024-01-19 00:00:00", "2024-01-12 00:00:00"
RANGE = f"time BETWEEN TIMESTAMP '{T_MIN}' AND TIMESTAMP '{T_MAX}'"
IN_BOX = "ra_deg BETWEEN 1e1 AND 2e2 AND dec_deg BETWEEN -6e1 AND 6e1"
IN_WRAPPED = "(ra_deg >= 3.5e2 OR ra_deg <= 2e1) AND dec_deg BETWEEN -6e1 AND 6e1"


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Views:
    """The fixture views of one folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None, *used: str):
    """Registers a function of `Views`; `used` are the views its SQL needs."""

    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Views(spark, folder))
            return df.toDF(*[c.lower() for c in df.columns])

        text = None if sql is None else (with_views(sql, *used) if used else sql)
        REGISTRY[name] = Query(run, text)
        return fn

    return register


def nine_digits(value: Column) -> Column:
    """Rounded to nine decimals, halves away from zero, in double arithmetic as DuckDB does it."""
    size = F.floor(F.abs(value) * 1e9 + 0.5) / 1e9
    return F.when(value < 0, -size).otherwise(size)


def nine(*columns: str) -> list:
    """Columns rounded to nine decimals, for results of trigonometry and interpolation."""
    return [nine_digits(F.col(c)).alias(c.lower()) for c in columns]


def separation_sql(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    a = f"sin(radians({dec1} - {dec2}) / 2e0)"
    b = f"sin(radians({ra1} - {ra2}) / 2e0)"
    return (f"degrees(asin(sqrt(least(1e0, {a} * {a} + cos(radians({dec1})) * cos(radians({dec2})) * {b} * {b})))) * 2e0")
