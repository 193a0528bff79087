"""Table schemas. Units live in the column names; times are UTC without a zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _field(name, kind, nullable=True):
    return T.StructField(name, kind, nullable)


FIXED_SOURCES = T.StructType([
    _field("source_id", T.StringType(), False),
    _field("ra_deg", T.DoubleType(), False),
    _field("dec_deg", T.DoubleType(), False),
    _field("flux_mJy", T.DoubleType()),
    _field("name", T.StringType()),
    _field("monitored", T.BooleanType(), False),
    _field("pointing", T.BooleanType(), False),
])

SOLARSYSTEM_OBJECTS = T.StructType([
    _field("sso_id", T.StringType(), False),
    _field("MPC_id", T.LongType()),
    _field("name", T.StringType(), False),
    _field("monitored", T.BooleanType(), False),
    _field("pointing", T.BooleanType(), False),
])

MOVING_SOURCES = T.StructType([
    _field("ephem_id", T.StringType(), False),
    _field("sso_id", T.StringType(), False),
    _field("MPC_id", T.LongType()),
    _field("name", T.StringType(), False),
    _field("time", T.TimestampNTZType(), False),
    _field("ra_deg", T.DoubleType(), False),
    _field("dec_deg", T.DoubleType(), False),
    _field("flux_mJy", T.DoubleType()),
])

SERVICES = T.StructType([
    _field("service_id", T.StringType(), False),
    _field("name", T.StringType(), False),
    _field("config", T.MapType(T.StringType(), T.StringType()), False),
])

TABLES = {
    "fixed_sources": FIXED_SOURCES,
    "solarsystem_objects": SOLARSYSTEM_OBJECTS,
    "moving_sources": MOVING_SOURCES,
    "services": SERVICES,
}


def names(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields]


def conform(df: DataFrame, schema: T.StructType, keep_ids: bool = False) -> DataFrame:
    """Columns of `df` in the order, names and types of `schema`.

    Optional columns that are absent become null and absent flags become false.
    With `keep_ids` the columns ending in `_id` keep their own type, so tables
    with integer keys can be used as they are.
    """
    present = {c.lower() for c in df.columns}

    def one(field: T.StructField) -> Column:
        flag = isinstance(field.dataType, T.BooleanType)
        if field.name.lower() not in present:
            if not field.nullable and not flag:
                raise ValueError(f"missing required column {field.name}")
            value = F.lit(False) if flag else F.lit(None).cast(field.dataType)
            return value.alias(field.name)
        value = F.col(field.name)
        if not (keep_ids and field.name in ("source_id", "sso_id", "ephem_id", "service_id")):
            value = value.cast(field.dataType)
        if flag:
            value = F.coalesce(value, F.lit(False))
        return value.alias(field.name)

    return df.select(*[one(f) for f in schema.fields])


def folded(df: DataFrame, *known: str) -> DataFrame:
    """Columns that match a known name but for case get that name."""
    proper = {k.lower(): k for k in known}
    return df.toDF(*[proper.get(c.lower(), c) for c in df.columns])


def require_columns(df: DataFrame, required: set[str], where: str = "input") -> None:
    """Raise naming the sorted missing columns; looks at the schema only, runs no job."""
    missing = sorted(required - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns in {where}: {missing}")
