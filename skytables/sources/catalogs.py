"""Point-source catalogs: ACT tables, WebSky CSV and plain text."""

from __future__ import annotations

import csv
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.angles import iau_name, wrap_ra
from ..functions.values import MONITORED_MJY, POINTING_MJY, at_least, jy_to_mjy, not_below, to_flag
from ..operators.maintain import fixed_rows
from ..schema import require_columns


DOUBLE, TEXT = T.DoubleType(), T.StringType()


class Ingested(NamedTuple):
    rows: DataFrame
    rejected: DataFrame


def strip_names(df: DataFrame) -> DataFrame:
    """Header names without surrounding blanks."""
    return df.toDF(*[c.strip() for c in df.columns])


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """(`header`, `files`): the first lines of the files, and which files have each."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_block_start").alias("block"))
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return first.groupBy("header").agg(F.collect_list("file").alias("files"))


def _read_csv(spark: SparkSession, path: str, columns: dict[str, T.DataType]) -> DataFrame:
    """CSV with headers, in which files may order their columns differently. Values get fixed types."""
    found = _headers(spark, path).limit(2).collect()
    if not found:
        raise ValueError(f"{path} is empty")
    if len(found) == 1:
        return _read_one_header(spark, path, found[0].header, columns)
    parts = [_read_one_header(spark, r.files, r.header, columns) for r in sorted(_headers(spark, path).collect())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_one_header(spark: SparkSession, path: str | list[str], header: str, columns: dict[str, T.DataType]) -> DataFrame:
    found = [c.strip() for c in next(csv.reader([header]))]
    missing = sorted(set(columns) - set(found))
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    schema = T.StructType([T.StructField(c, columns.get(c, TEXT)) for c in found])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE")


def read_websky(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, {"flux(Jy)": DOUBLE, "RA(deg)": DOUBLE, "dec(deg)": DOUBLE})


def read_text_catalog(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, {"ra": DOUBLE, "dec": DOUBLE, "name": TEXT, "monitored": TEXT})


def ingest_act(
    rows: DataFrame, monitored_mjy: float = MONITORED_MJY, pointing_mjy: float = POINTING_MJY, catalog: str = "act"
) -> Ingested:
    """`raDeg, decDeg, fluxJy, name` to fixed sources; flags from inclusive flux thresholds."""
    require_columns(rows, {"raDeg", "decDeg", "fluxJy", "name"})
    flux = jy_to_mjy(F.col("fluxJy"))
    return Ingested(*fixed_rows(rows.select(
        F.col("raDeg").alias("ra_deg"), F.col("decDeg").alias("dec_deg"), flux.alias("flux_mJy"), "name",
        at_least(flux, monitored_mjy).alias("monitored"), at_least(flux, pointing_mjy).alias("pointing")), catalog))


def ingest_websky(rows: DataFrame, flux_lower_limit_jy: float = 0.0, catalog: str = "websky") -> Ingested:
    """`flux(Jy), RA(deg), dec(deg)` to fixed sources named after their position."""
    rows = strip_names(rows)
    require_columns(rows, {"flux(Jy)", "RA(deg)", "dec(deg)"})
    kept = rows.where(not_below(F.col("flux(Jy)"), flux_lower_limit_jy))
    ra, dec = wrap_ra(F.col("RA(deg)")), F.col("dec(deg)")
    return Ingested(*fixed_rows(kept.select(
        ra.alias("ra_deg"), dec.alias("dec_deg"), jy_to_mjy(F.col("flux(Jy)")).alias("flux_mJy"),
        iau_name(ra, dec).alias("name")), catalog))


def ingest_text(rows: DataFrame, catalog: str = "text") -> Ingested:
    """`ra, dec, name, monitored` to fixed sources without flux. A flag that is no boolean is rejected."""
    require_columns(rows, {"ra", "dec", "name", "monitored"})
    shaped = rows.select(F.col("ra").cast("double").alias("ra_deg"), F.col("dec").cast("double").alias("dec_deg"),
                         "name", to_flag(F.col("monitored")).alias("monitored"), F.lit(False).alias("pointing"))
    bad = shaped.where(F.col("monitored").isNull()).withColumn("reason", F.lit("monitored is not a boolean"))
    good, rejected = fixed_rows(shaped.where(F.col("monitored").isNotNull()), catalog)
    return Ingested(good, rejected.unionByName(bad))


def ingest_summary(ssos: DataFrame, points: DataFrame, source: str) -> DataFrame:
    """(source_file, number_of_ssos, number_of_ephems) of one ingest."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    marks = ssos.select(one.alias("sso"), none.alias("ephem")).unionByName(
        points.select(none.alias("sso"), one.alias("ephem")))
    return marks.agg(
        F.coalesce(F.sum("sso"), none).alias("number_of_ssos"), F.coalesce(F.sum("ephem"), none).alias("number_of_ephems"),
    ).select(F.lit(source).alias("source_file"), "number_of_ssos", "number_of_ephems")
