"""Lookups by key: batches of keys in, found rows and missing keys out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from .boxes import in_times
from .skew import dimension_join


class Lookup(NamedTuple):
    found: DataFrame
    missing: DataFrame


def lookup(table: DataFrame, keys: DataFrame, key: str, strict: bool = False) -> Lookup:
    """Rows of `table` whose `key` is among `keys`, and the keys that match nothing.

    Keys are made distinct first, so a key asked for a million times is joined
    once; a key may match several rows. `strict` raises if any key is missing.
    """
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    found = dimension_join(table, wanted, [key], "left_semi")
    known = found.select(key).distinct()
    missing = wanted.join(known, key, "left_anti")
    if strict:
        raise_if_any(missing, f"unknown {key}")
    return Lookup(found, missing)


def raise_if_any(df: DataFrame, message: str) -> None:
    sample = df.take(1)
    if sample:
        raise ValueError(f"{message}: {sample[0].asDict()}")


def flagged(table: DataFrame, flag: str) -> DataFrame:
    """Rows whose `monitored` or `pointing` flag is set."""
    if flag not in ("monitored", "pointing"):
        raise ValueError("flag must be 'monitored' or 'pointing'")
    return table.where(F.col(flag))


def ephem_of(points: DataFrame, sso_id, t_min=None, t_max=None) -> DataFrame:
    """Points of one object, optionally within inclusive times."""
    own = points.where(F.col("sso_id") == F.lit(sso_id))
    if t_min is None and t_max is None:
        return own
    return own.where(in_times(t_min, t_max))
