from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skytables.operators import boxes, ephemeris, lookups, skew
from skytables.operators.boxes import Box
from skytables.plans.registry import Views
from tables import T0, fixed, hours, points, rows, seconds, ssos, track

DATA = "/root/testdata/sf0.001"


def ids(df, key="source_id"):
    return sorted(r[0] for r in df.select(key).collect())


def test_box_wrap(spark):
    table = fixed(spark, [("a", 1, 1), ("b", 2, 2), ("c", 359, 1)])
    assert ids(boxes.box_fixed(table, Box(358, 1.5, 0, 1.5))) == ["a", "c"]


def test_box_edges(spark):
    table = fixed(spark, [("z", 0, 90), ("s", 359.999, -90), ("m", 180, 0)])
    assert ids(boxes.box_fixed(table, Box(0, 360, -90, 90))) == ["m", "s", "z"]
    assert ids(boxes.box_fixed(table, Box(180, 360, -90, 0))) == ["m", "s"]
    with pytest.raises(ValueError):
        boxes.in_box(Box(0, 1, 5, 4))
    with pytest.raises(ValueError):
        boxes.in_times("2024-01-02T00:00:00", "2024-01-01 00:00:00")




def davida(spark):
    return points(
        spark, track("davida", T0, hours(1), [(1 + i, 1, None) for i in range(3)]),
        track("diotima", T0 + hours(11), hours(1), [(1 + i, 1, None) for i in range(3)]),
        track("ceres", T0, hours(1), [(4 + i, 1, None) for i in range(3)]))


def test_box_sso(spark):
    objects = ssos(spark, [("davida",), ("diotima",), ("ceres",)])
    found = ephemeris.box_sso(objects, davida(spark), Box(0, 3, 0, 3), T0, T0 + hours(5))
    assert ids(found, "sso_id") == ["davida"]
    wrapped = ephemeris.box_sso(objects, davida(spark), Box(358, 1.5, 0, 1.5), T0, T0 + hours(5))
    assert ids(wrapped, "sso_id") == ["davida"]


def test_wrapped_box_gives_an_object_once(spark):
    both_sides = points(spark, track("a", T0, hours(1), [(359, 0, None), (1, 0, None), (90, 0, None)]))
    found = ephemeris.box_sso(ssos(spark, [("a",)]), both_sides, Box(358, 2, -1, 1), T0, T0 + hours(1))
    assert ids(found, "sso_id") == ["a"]


def test_time_range_is_inclusive(spark):
    ten = points(spark, track("a", T0, hours(1), [(i, 0, None) for i in range(10)]))
    assert lookups.ephem_of(ten, "a", T0 + hours(2), T0 + hours(5)).count() == 4
    assert lookups.ephem_of(ten, "a").count() == 10
    short = points(spark, track("a", T0, seconds(100), [(0, 0, None), (1, 0, None), (50, 0, None)]))
    hit = ephemeris.box_sso(ssos(spark, [("a",)]), short, Box(0.5, 2, -1, 1), T0, T0 + seconds(100))
    assert hit.count() == 1


def test_flags(spark):
    table = fixed(spark, [("m", 0, 0, 1.0, True, False), ("p", 0, 0, 1.0, False, True),
                          ("b", 0, 0, 1.0, True, True), ("n", 0, 0, 1.0, False, False)])
    assert ids(lookups.flagged(table, "monitored")) == ["b", "m"]
    assert ids(lookups.flagged(table, "pointing")) == ["b", "p"]
    with pytest.raises(ValueError):
        lookups.flagged(table, "name")


def test_lookup_found_and_missing(spark):
    table = fixed(spark, [("a", 0, 0), ("b", 0, 0)])
    keys = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "source_id string")
    result = lookups.lookup(table, keys, "source_id")
    assert ids(result.found) == ["a"] and ids(result.missing) == ["x"]
    with pytest.raises(ValueError):
        lookups.lookup(table, keys, "source_id", strict=True)


def test_boxes_split_and_match(spark):
    day = datetime(2024, 1, 1)
    many = spark.createDataFrame(
        [(1, 350.0, 10.0, -5.0, 5.0, day, day), (2, 10.0, 20.0, 5.0, -5.0, day, day),
         (3, 0.0, 360.0, -90.0, 90.0, day, datetime(2023, 1, 1)), (4, None, 1.0, 0.0, 1.0, day, day)],
        "box_id int, ra_min double, ra_max double, dec_min double, dec_max double, t_min timestamp_ntz, t_max timestamp_ntz")
    good, bad = boxes.split_boxes(many)
    assert ids(good, "box_id") == [1]
    assert rows(bad, "box_id", "reason") == [
        (2, "dec_min > dec_max"), (3, "t_min > t_max"), (4, "missing bound")]
    table = fixed(spark, [("a", 355, 0), ("b", 5, 5), ("c", 11, 0), ("d", 350, -5)])
    assert ids(boxes.boxes_fixed(table, many.drop("t_min", "t_max").where("box_id = 1"))) == ["a", "b", "d"]


@pytest.mark.parametrize("broadcast, hot", [(0, 5), (0, 2_000_000), (2**25, 20)])
def test_boxes_grid_equals_plain(spark, monkeypatch, broadcast, hot):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", broadcast)
    v = Views(spark, DATA)
    found = boxes.match_boxes(v.moving_sources, v.boxes, hot)
    b, p = v.boxes, v.moving_sources
    ra_ok = F.when(F.col("ra_min") <= F.col("ra_max"), F.col("ra_deg").between(F.col("ra_min"), F.col("ra_max"))).otherwise(
        (F.col("ra_deg") >= F.col("ra_min")) | (F.col("ra_deg") <= F.col("ra_max")))
    plain = p.crossJoin(b).where(ra_ok & F.col("dec_deg").between(F.col("dec_min"), F.col("dec_max"))
                                 & F.col("time").between(F.col("t_min"), F.col("t_max")))
    assert rows(found, "box_id", "ephem_id") == rows(plain, "box_id", "ephem_id")
    assert plain.count() > 0


def test_box_reaches_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    path = str(tmp_path / "fixed")
    fixed(spark, [("a", 1, 1), ("b", 2, 2)]).write.parquet(path)
    stored = spark.read.parquet(path)
    plan = boxes.box_fixed(stored, Box(0, 1.5, 0, 1.5)).select("source_id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ra_deg,0.0)" in plan and "LessThanOrEqual(dec_deg,1.5)" in plan
    assert "ReadSchema: struct<source_id:string,ra_deg:double,dec_deg:double>" in plan
    wrapped = boxes.box_fixed(stored, Box(350, 1.5, 0, 1.5))._jdf.queryExecution().toString()
    assert "Or(GreaterThanOrEqual(ra_deg,350.0),LessThanOrEqual(ra_deg,1.5))" in wrapped
