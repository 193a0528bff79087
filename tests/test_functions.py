import math
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skytables.functions import angles, times, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("ra, wrapped", [(-36.6374, 323.3626), (0.0, 0.0), (360.0, 0.0), (359.5, 359.5), (-180.0, 180.0)])
def test_wrap_ra(spark, ra, wrapped):
    assert one(spark, angles.wrap_ra(F.lit(ra))) == pytest.approx(wrapped, abs=1e-12)


def test_signed_ra(spark):
    assert one(spark, angles.signed_ra(F.lit(323.3626))) == pytest.approx(-36.6374)
    assert one(spark, angles.signed_ra(F.lit(180.0))) == 180.0


def test_iau_name_carries(spark):
    assert one(spark, angles.iau_name(F.lit(15.0), F.lit(-0.5))) == "J010000.00-003000.0"
    just_below = 59.9999 / 3600 * 15
    assert one(spark, angles.iau_name(F.lit(just_below), F.lit(0.0))) == "J000100.00+000000.0"
    day_end = (23 + 59 / 60 + 59.999 / 3600) * 15
    assert one(spark, angles.iau_name(F.lit(day_end), F.lit(89.999999))) == "J000000.00+900000.0"
    assert one(spark, angles.iau_name(F.lit(day_end), F.lit(1.0), ra_digits=3)) == "J235959.999+010000.0"


@pytest.mark.parametrize("text, hours, deg", [
    ("-00 30 00", False, -0.5), ("+10 30 36", False, 10.51), ("01 00 00.0", True, 15.0), ("-12:30:00", False, -12.5),
    ("12h30m00s", True, 187.5), ("junk", False, None), (None, False, None)])
def test_sexagesimal_to_deg(spark, text, hours, deg):
    got = one(spark, angles.sexagesimal_to_deg(F.lit(text).cast("string"), hours))
    assert got == (None if deg is None else pytest.approx(deg))


def test_deg_to_sexagesimal(spark):
    assert one(spark, angles.deg_to_sexagesimal(F.lit(-0.5), precision=0)) == "-0d30m00s"
    assert one(spark, angles.deg_to_sexagesimal(F.lit(15.0), unit="hourangle", sep=":", pad=True)) == "01:00:00.0"
    assert one(spark, angles.deg_to_sexagesimal(F.lit(1.99999999), sep=" ", always_sign=True)) == "+2 00 00.0"


@settings(max_examples=20, deadline=None)
@given(st.floats(-90, 90))
def test_sexagesimal_round_trip(spark, deg):
    text = angles.deg_to_sexagesimal(F.lit(deg), sep=":", precision=4)
    assert one(spark, angles.sexagesimal_to_deg(text)) == pytest.approx(deg, abs=2e-8)


def test_separation_edges(spark):
    def sep(*p):
        return one(spark, angles.separation(*[F.lit(float(x)) for x in p]))

    assert sep(359.5, 0, 0.5, 0) == pytest.approx(1.0)
    assert sep(10, 89.9, 190, 89.9) == pytest.approx(0.2)
    assert sep(123.456, -7.89, 123.456, -7.89) == 0.0
    assert sep(0, 0, 180, 0) == pytest.approx(180.0)
    flat = one(spark, angles.flat_distance(F.lit(359.5), F.lit(0.0), F.lit(0.5), F.lit(0.0)))
    assert flat == 359.0


@pytest.mark.parametrize("text, mode, want", [
    ("511 Davida", "rest", (511, "Davida")), ("511", "rest", (511, "511")), ("511 ", "rest", (511, "511")),
    ("Ceres", "rest", (None, "Ceres")), ("C/2020 F3", "rest", (None, "F3")), ("  2 Pallas Beta ", "rest", (2, "Pallas Beta ")),
    ("2 Pallas Beta", "second_token", (2, "Pallas")), ("", "rest", (None, None)), (None, "rest", (None, None))])
def test_parse_designation(spark, text, mode, want):
    mpc, name = values.parse_designation(F.lit(text).cast("string"), mode)
    assert (one(spark, mpc), one(spark, name)) == want


def test_julian_day_round_trip(spark):
    for jd in (2451545.0, 2451546.0, 2460310.5 + 7 / 1024):
        seconds = one(spark, times.unix_seconds(times.jd_to_time(F.lit(jd))))
        assert seconds / 86400 + times.JD_UNIX_EPOCH == jd


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_unix_micros_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        gap = times.ntz("2024-03-10 02:30:00.000001")  # does not exist in New York
        assert one(spark, times.unix_micros(gap)) == 1_710_037_800_000_001
        back = one(spark, times.from_unix_seconds(F.lit(1710037800.5)))
        assert back == datetime(2024, 3, 10, 2, 30, 0, 500000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_thresholds_and_nan(spark):
    nan = F.lit(float("nan"))
    assert one(spark, values.at_least(F.lit(20.0), 20.0)) is True
    assert one(spark, values.at_least(nan, 20.0)) is False
    assert one(spark, values.at_least(F.lit(None).cast("double"), 20.0)) is False
    assert one(spark, values.not_below(nan, 1.0)) is True
    assert one(spark, values.not_below(F.lit(None).cast("double"), 1.0)) is True
    assert one(spark, values.not_below(F.lit(0.5), 1.0)) is False
    assert one(spark, values.nan_to_null(nan)) is None
    assert one(spark, values.zero_to_null(F.lit(0.0))) is None


def test_flags_and_dates(spark):
    assert [one(spark, values.to_flag(F.lit(x))) for x in ("True", "False", "maybe")] == [True, False, None]
    assert one(spark, times.mpc_date(F.lit("2024 01 05 123000"))) == datetime(2024, 1, 5, 12, 30)
    assert one(spark, times.mpc_date(F.lit("2024 13 05"))) is None
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, times.mpc_date(F.lit("2024 03 10 023000")).cast("string")) == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_keys_keep_null_apart(spark):
    text = F.lit(None).cast("string")
    keys = {one(spark, values.row_key("fixed", c, F.lit("b"))) for c in (text, F.lit(""), F.lit("a"))}
    assert len(keys) == 3
    a, b = math.pi, math.nextafter(math.pi, 4)
    assert one(spark, values.double_key(F.lit(a))) != one(spark, values.double_key(F.lit(b)))
