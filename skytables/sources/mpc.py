"""Saved MPC ephemeris responses: fixed-width text, one file per object.

Offsets below are fixed values of the text format: 0-based first column, and
for the sky layout the last column, included.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.angles import deg_to_sexagesimal, sexagesimal_to_deg
from ..functions.times import mpc_date

SKY = {
    "date_text": (0, 17), "ra_text": (18, 28), "dec_text": (29, 38), "delta_au": (39, 46), "r_au": (47, 55),
    "elongation_deg": (56, 61), "phase_deg": (62, 68), "v_mag": (69, 72),
}
#: The two motion columns and their names by kind of motion; text is arcsec/h or deg.
MOTION_SPANS = ((73, 81), (82, 91))
MOTIONS = {
    "total": ("proper_motion_arcmin_h", "direction_deg"),
    "coord": ("dra_arcmin_h", "ddec_arcmin_h"),
    "sky": ("dra_cosdec_arcmin_h", "ddec_arcmin_h"),
}
#: Offsets from the last column before the block: Moon geometry, then uncertainty.
MOON = {
    "azimuth_deg": (1, 7), "altitude_deg": (8, 12), "sun_altitude_deg": (13, 18), "moon_phase": (19, 25),
    "moon_distance_deg": (26, 31), "moon_altitude_deg": (32, 36),
}
UNCERTAINTY = {"uncertainty_3sig_arcsec": (1, 9), "uncertainty_pa_deg": (10, 15)}
AFTER_MOTION, AFTER_MOON = 91, 127
#: Starts of the vector layouts; each field runs to the next start.
VECTOR_STARTS = (0, 12, 28, 45, 61, 77, 92, 108)
VECTORS = {
    "heliocentric": ("object", "jd_tt", "x_au", "y_au", "z_au", "vx_au_d", "vy_au_d", "vz_au_d"),
    "geocentric": ("object", "jd_tt", "x_au", "y_au", "z_au"),
}
HEADER_MARK = {"sky": "h m s", "heliocentric": "JD_TT", "geocentric": "JD_TT"}


class Ephemeris(NamedTuple):
    rows: DataFrame
    rejected: DataFrame


def cut(line: Column, start: int | Column, end: int | Column) -> Column:
    """Columns `start` to `end` of a line, 0-based and inclusive, without blanks around."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.lit(end) if isinstance(end, int) else end
    return F.trim(F.substring(line, start + 1, end - start + 1))


def number(text: Column) -> Column:
    """A number, `N/A` and anything unreadable as null."""
    return F.nullif(text, F.lit("N/A")).try_cast("double")


def read_responses(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """(source_file, header, row_idx, line): the data lines of every saved response.

    Responses without a table or without data lines give no rows; see `empty_responses`.
    """
    lines = _tables(spark, path, layout).where(F.col("header_end") > 0).select(
        "source_file", F.substring("body", F.lit(1), F.col("header_end")).alias("header"),
        F.posexplode(F.split(F.expr("substring(body, header_end + 1)"), "\r?\n")).alias("row_idx", "line"))
    return lines.where(F.length(F.trim("line")) > 0)


def _tables(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Text between <pre> and </pre> and the end of its header: the line break after the marker."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.regexp_extract("value", "(?s)<pre>(.*?)</pre>", 1).alias("body"))
    mark = F.locate(HEADER_MARK[layout], F.col("body"))
    end = F.when(mark > 0, F.expr(f"locate('\\n', body, locate('{HEADER_MARK[layout]}', body))")).otherwise(0)
    return text.withColumn("header_end", end)


def empty_responses(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Files in which no table was found."""
    return _tables(spark, path, layout).where(F.col("header_end") == 0).select("source_file")


def parse_sky(lines: DataFrame, motion: str = "total") -> DataFrame:
    """Sky layout: time, position in degrees, distances, geometry and motion in arcmin/h.

    The Moon and uncertainty blocks are read where the header names them.
    """
    if motion not in MOTIONS:
        raise ValueError(f"motion must be one of {sorted(MOTIONS)}")
    line = F.col("line")
    texts = lines.select("*", *[cut(line, *SKY[c]).alias(c) for c in ("date_text", "ra_text", "dec_text")])
    out = [
        mpc_date(F.col("date_text")).alias("time"),
        sexagesimal_to_deg(F.col("ra_text"), hours=True).alias("ra_deg"),
        sexagesimal_to_deg(F.col("dec_text")).alias("dec_deg"),
        *[number(cut(line, *span)).alias(c) for c, span in list(SKY.items())[3:]],
    ]
    for name, span in zip(MOTIONS[motion], MOTION_SPANS):
        value = number(cut(line, *span))
        out.append((motion_arcmin(value) if name.endswith("arcmin_h") else value).alias(name))
    if "header" in lines.columns:
        moon = F.col("header").contains("Moon")
        unc = F.col("header").contains("Uncertainty")
        base = F.when(moon, F.lit(AFTER_MOON)).otherwise(F.lit(AFTER_MOTION))
        for name, (a, b) in MOON.items():
            out.append(F.when(moon, number(cut(line, AFTER_MOTION + a, AFTER_MOTION + b))).alias(name))
        for name, (a, b) in UNCERTAINTY.items():
            out.append(F.when(unc, number(cut(line, base + a, base + b))).alias(name))
    keep = [c for c in lines.columns if c not in ("line", "header")]
    return texts.select(*keep, *out)


def parse_vectors(lines: DataFrame, layout: str = "heliocentric") -> DataFrame:
    """Vector layouts: object, Julian day (TT, kept as it is) and vectors."""
    columns = VECTORS[layout]
    line = F.col("line")
    out = []
    for i, name in enumerate(columns):
        last = i + 1 == len(columns)
        text = F.trim(F.substring(line, F.lit(VECTOR_STARTS[i] + 1), F.length(line))) if last else cut(
            line, VECTOR_STARTS[i], VECTOR_STARTS[i + 1] - 1)
        out.append((text if name == "object" else number(text)).alias(name))
    keep = [c for c in lines.columns if c not in ("line", "header")]
    return lines.select(*keep, *out)


def motion_kind(header: Column) -> Column:
    """Which two motion columns a sky table has, by its last header line there: `total` with a position angle,
    `sky` where RA motion is times cos(Dec), else `coord`."""
    last = F.element_at(F.split(F.regexp_replace(header, r"\s+$", ""), "\r?\n"), -1)
    title = F.substring(last, F.lit(MOTION_SPANS[0][0] + 1), F.lit(MOTION_SPANS[1][1] - MOTION_SPANS[0][0] + 1))
    return F.when(title.contains("P.A."), "total").when(title.contains("cos"), "sky").otherwise("coord")


def ingest_sky(
    lines: DataFrame, motion: str | None = None, ra_format: dict | None = None, dec_format: dict | None = None,
) -> Ephemeris:
    """Rows of `read_responses(..., "sky")`, each file by the layout that its own header has.

    All motion columns are there, null where a file's kind has no such column; `motion`
    names the kind where headers do not tell. Moon and uncertainty columns are null in files
    without them. `ra_format` and `dec_format` are arguments of `deg_to_sexagesimal` and add
    `ra_sexagesimal` and `dec_sexagesimal`. Lines without a readable time or position are rejected.
    """
    kind = motion_kind(F.col("header")) if motion is None else F.lit(motion)
    if motion is not None and motion not in MOTIONS:
        raise ValueError(f"motion must be one of {sorted(MOTIONS)}")
    first = parse_sky(lines.select("*", F.col("line").alias("_line"), kind.alias("motion")), "total")
    pair = [number(cut(F.col("_line"), *span)) for span in MOTION_SPANS]
    by_name: dict[str, Column] = {}
    for name, columns in MOTIONS.items():
        for column, value in zip(columns, pair, strict=True):
            here = F.when(F.col("motion") == name, motion_arcmin(value) if column.endswith("arcmin_h") else value)
            by_name[column] = F.coalesce(by_name[column], here) if column in by_name else here
    rows = first.withColumns(by_name)
    if ra_format is not None:
        rows = rows.withColumn("ra_sexagesimal", deg_to_sexagesimal(F.col("ra_deg"), **ra_format))
    if dec_format is not None:
        rows = rows.withColumn("dec_sexagesimal", deg_to_sexagesimal(F.col("dec_deg"), **dec_format))
    reason = F.when(F.col("time").isNull(), "no time").when(F.col("ra_deg").isNull() | F.col("dec_deg").isNull(), "no position")
    rows = rows.withColumn("reason", reason)
    faulty = rows.where(F.col("reason").isNotNull()).select("source_file", "row_idx", F.col("_line").alias("line"), "reason")
    return Ephemeris(rows.where(F.col("reason").isNull()).drop("reason", "_line"), faulty)


def ingest_mpc_files(spark: SparkSession, path: str, **options) -> Ephemeris:
    """The sky tables of all saved responses under `path`; options as for `ingest_sky`."""
    return ingest_sky(read_responses(spark, path, "sky"), **options)


def motion_arcmin(arcsec_per_hour: Column) -> Column:
    return arcsec_per_hour / 60.0
