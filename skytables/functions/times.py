"""Time expressions on TIMESTAMP_NTZ columns (UTC by convention)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

#: Julian day of 1970-01-01T00:00:00 (fixed value).
JD_UNIX_EPOCH = 2440587.5


def ntz(value: Column | datetime | str) -> Column:
    """A TIMESTAMP_NTZ column from a column, a naive datetime or an ISO string."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            raise ValueError("times are UTC without a zone: pass a naive datetime")
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def unix_micros(t: Column) -> Column:
    """Whole microseconds since 1970.

    Goes through an interval, which no session time zone touches; a cast to
    TIMESTAMP or `timestampdiff` would be off by an hour inside a DST gap.
    """
    seconds = (t - ntz("1970-01-01 00:00:00")).cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(1000000)).cast("bigint")


def unix_seconds(t: Column) -> Column:
    return unix_micros(t) / F.lit(1e6)


def from_unix_seconds(seconds: Column) -> Column:
    """Seconds since 1970 (double) to a time, rounded to the microsecond."""
    zero = F.lit(0)
    parts = F.make_dt_interval(zero, zero, zero, F.round(seconds, 6).cast("decimal(18,6)"))
    return ntz("1970-01-01 00:00:00") + parts


def jd_to_time(jd: Column) -> Column:
    """Julian day (UTC) to a time. A double JD resolves about 40 microseconds."""
    return from_unix_seconds((jd - F.lit(JD_UNIX_EPOCH)) * F.lit(86400.0))


def mpc_date(text: Column) -> Column:
    """`YYYY MM DD HHMMSS` (UT) to a time; anything else gives null."""
    pattern = r"^(\d{4}) (\d{2}) (\d{2}) (\d{2})(\d{2})(\d{2})$"
    text = F.trim(text)
    # Straight to a time without zone: the session's zone and its clock changes have no part in it.
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, r"$1-$2-$3 $4:$5:$6").try_cast("timestamp_ntz"))
