"""Flux, flags, designations and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Flag thresholds for point-source ingest in mJy (fixed values, inclusive).
MONITORED_MJY = 20.0
POINTING_MJY = 300.0

#: Stand-ins inside hashed keys: separator and null marker (fixed values).
KEY_SEPARATOR = "\u0001"
KEY_NULL = "\u0002"


def jy_to_mjy(flux: Column) -> Column:
    return flux * 1000.0


def at_least(value: Column, threshold: float) -> Column:
    """`value >= threshold`; null and NaN give false."""
    return F.coalesce(~F.isnan(value) & (value >= F.lit(threshold)), F.lit(False))


def not_below(value: Column, limit: float) -> Column:
    """True unless `value < limit`; null and NaN are kept."""
    return F.coalesce(F.isnan(value) | ~(value < F.lit(limit)), F.lit(True))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def optional_flux(df: DataFrame, name: str = "flux_mJy") -> Column:
    """The flux column if there is one, NaN as null; else null."""
    if name.lower() not in {c.lower() for c in df.columns}:
        return F.lit(None).cast("double")
    return nan_to_null(F.col(name).cast("double"))


def zero_to_null(flux: Column) -> Column:
    """A flux of exactly zero reads out as unknown."""
    return F.nullif(flux, F.lit(0.0))


def to_flag(value: Column) -> Column:
    """Text or boolean to boolean; text that is neither gives null."""
    return value.try_cast("boolean")


def parse_designation(text: Column, name_mode: str = "rest") -> tuple[Column, Column]:
    """(MPC id, name) of a designation such as `511 Davida`.

    The first token is the id where it is a whole number. The name is the rest
    of the text (`name_mode='rest'`) or its second token
    (`name_mode='second_token'`); a single token is its own name.
    """
    patterns = {"rest": "(?s)^\\S+\\s+(\\S.*)$", "second_token": "^\\S+\\s+(\\S+)"}
    if name_mode not in patterns:
        raise ValueError(f"name_mode must be one of {sorted(patterns)}")
    body = F.regexp_replace(text, "^\\s+", "")
    token = F.regexp_extract(body, "^(\\S+)", 1)
    rest = F.regexp_extract(body, patterns[name_mode], 1)
    mpc_id = token.try_cast("bigint")
    name = F.coalesce(F.nullif(rest, F.lit("")), mpc_id.cast("string"), F.nullif(token, F.lit("")))
    return mpc_id, name


def double_key(value: Column) -> Column:
    """A double inside a key, by its bits: hashing one 8-byte value loses nothing, and unlike
    the decimal text of a double it is the same under every Java version."""
    return F.when(value.isNotNull(), F.xxhash64(value))


def row_key(kind: str, *parts: Column) -> Column:
    """A repeatable id: SHA-256 over the kind and the parts, null kept apart from empty."""
    texts = [F.coalesce(p.cast("string"), F.lit(KEY_NULL)) for p in parts]
    return F.sha2(F.concat_ws(KEY_SEPARATOR, F.lit(kind), *texts), 256)


def config_value(config_json: Column, key: str) -> Column:
    """One entry of a provider config kept as JSON text."""
    return F.from_json(config_json, "map<string,string>")[key]
