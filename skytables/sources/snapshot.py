"""The whole catalog as Parquet: write, read back, and bring older snapshots up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import TABLES, conform, folded


def write_snapshot(tables: dict[str, DataFrame], path: str, partitions: int | None = None) -> None:
    """One folder per table.

    Ephemerides are partitioned by day and sorted by (object, time). The range
    partitioning is sampled, so a crowded day or object is spread over several
    tasks while a quiet day stays in one file. Fixed sources are sorted by
    position for row-group statistics. `partitions` sets the number of tasks;
    the default is the session's number of shuffle partitions.
    """
    count = [] if partitions is None else [partitions]
    for name, df in tables.items():
        target = f"{path}/{name}"
        if name == "moving_sources":
            dated = df.withColumn("day", F.to_date("time"))
            (dated.repartitionByRange(*count, "day", "sso_id", "time").sortWithinPartitions("day", "sso_id", "time")
             .write.mode("overwrite").partitionBy("day").parquet(target))
        elif name == "fixed_sources":
            (df.repartitionByRange(*count, "dec_deg", "ra_deg").sortWithinPartitions("dec_deg", "ra_deg")
             .write.mode("overwrite").parquet(target))
        else:
            df.write.mode("overwrite").parquet(target)


def read_snapshot(spark: SparkSession, path: str, name: str, keep_ids: bool = False) -> DataFrame:
    """One table in the current schema. A time filter on `moving_sources` should also name `day`
    (see `between_days`) to skip whole folders."""
    return conform(spark.read.parquet(f"{path}/{name}"), TABLES[name], keep_ids)


def between_days(spark: SparkSession, path: str, t_min: str, t_max: str, keep_ids: bool = False) -> DataFrame:
    """Ephemeris points in a time range, reading only the folders of its days."""
    stored = spark.read.parquet(f"{path}/moving_sources")
    first, last = F.lit(str(t_min)[:10]).cast("date"), F.lit(str(t_max)[:10]).cast("date")
    low, high = F.lit(str(t_min)).cast("timestamp_ntz"), F.lit(str(t_max)).cast("timestamp_ntz")
    rows = stored.where(F.col("day").between(first, last) & F.col("time").between(low, high))
    return conform(rows, TABLES["moving_sources"], keep_ids)


def upgrade_flags(df: DataFrame) -> DataFrame:
    """Adds `monitored` and `pointing`, false where absent or null."""
    df = folded(df, "monitored", "pointing")
    for flag in ("monitored", "pointing"):
        have = flag in df.columns
        df = df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) if have else F.lit(False))
    return df
