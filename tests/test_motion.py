import random
import re
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skytables.functions.times import unix_micros
from skytables.operators import crossmatch, ephemeris, skew
from skytables.operators.boxes import Box
from skytables.plans import checks_match, unified
from skytables.plans.registry import Views
from tables import POINT, T0, fixed, hours, points, rows, seconds, ssos, track

DATA = "/root/testdata/sf0.001"
POINT_COLUMNS = ("sso_id", "time", "ra_deg", "dec_deg", "flux_mJy")


def at(spark, table, t, **options):
    """{object: (ra, dec, flux, status)}"""
    return {r.sso_id: (r.ra_deg, r.dec_deg, r.flux_mJy, r.status)
            for r in ephemeris.positions_at(table, t, **options).collect()}


def ten(spark, flux=lambda i: 1.2 * i + 0.1):
    return points(spark, track("a", T0, seconds(100), [(i, 1.5 * i, flux(i)) for i in range(10)]))


def test_interpolation(spark):
    ra, dec, flux, status = at(spark, ten(spark), T0 + seconds(250))["a"]
    assert (ra, dec, status) == (2.5, 3.75, "ok") and flux == pytest.approx(3.1)


def test_on_points_and_outside(spark):
    table = ten(spark)
    assert at(spark, table, T0)["a"][:2] == (0, 0)
    assert at(spark, table, T0 + seconds(300))["a"][:2] == (3, 4.5)
    assert at(spark, table, T0 + seconds(900))["a"][:2] == (9, 13.5)
    assert at(spark, table, T0 + seconds(1200))["a"] == (None, None, None, "out_of_range")
    assert at(spark, table, T0 - seconds(1))["a"][3] == "out_of_range"
    with pytest.raises(ValueError):
        ephemeris.positions_at(table, T0 + seconds(1200), strict=True)


def test_flux_rules(spark):
    one_null = ten(spark, lambda i: None if i == 7 else 1.0)
    assert at(spark, one_null, T0 + seconds(50))["a"] == (0.5, 0.75, None, "ok")
    window = one_null.where(F.col("time") <= F.lit(str(T0 + seconds(600))).cast("timestamp_ntz"))
    assert at(spark, window, T0 + seconds(50))["a"][2] == 1.0
    through_zero = points(spark, track("a", T0, seconds(100), [(0, 0, -1.0), (1, 1, 1.0)]))
    assert at(spark, through_zero, T0 + seconds(50))["a"] == (0.5, 0.5, None, "ok")


def test_one_point_and_duplicates(spark):
    table = points(spark, track("one", T0, hours(1), [(5, 5, 1.0)]),
                   track("twice", T0, hours(1), [(1, 1, 1.0), (2, 2, 1.0)]),
                   track("twice", T0, hours(2), [(1, 1, 1.0)]))
    assert at(spark, table, T0)["one"] == (None, None, None, "too_few_points")
    assert at(spark, table, T0)["twice"][3] == "duplicate_times"
    assert at(spark, table, T0, check_duplicates=False)["twice"][3] == "ok"


def test_ra_modes(spark):
    table = points(spark, track("a", T0, seconds(100), [(359, 0, None), (1, 0, None)]))
    assert at(spark, table, T0 + seconds(50))["a"][0] == 180
    assert at(spark, table, T0 + seconds(50), ra_mode="shortest")["a"][0] == 0
    assert at(spark, table, T0 + seconds(25), ra_mode="shortest")["a"][0] == 359.5
    with pytest.raises(ValueError):
        at(spark, table, T0, ra_mode="other")


def test_fixed_positions(spark):
    table = fixed(spark, [("a", 1, 1, 1.5), ("b", 2, 2), ("z", 3, 3, 0.0)])
    now = rows(ephemeris.fixed_at(table, datetime(2025, 6, 1)), "source_id", "ra_deg", "flux_mJy", "status")
    assert now == [("a", 1.0, 1.5, "ok"), ("b", 2.0, None, "ok"), ("z", 3.0, None, "ok")]
    many = ephemeris.fixed_at_times(table, [datetime(1969, 1, 1), datetime(2100, 1, 1)])
    assert rows(many.where("source_id = 'a'"), "status", "ra_deg") == [("ok", 1.0), ("out_of_range", None)]
    asked = spark.createDataFrame([("a", T0), ("a", T0), ("x", T0)], "source_id string, time timestamp_ntz")
    assert rows(ephemeris.fixed_for(table, asked), "source_id", "status") == [("a", "ok"), ("x", "unknown")]


def catalog(spark):
    stars = fixed(spark, [("f1", 1, 1, 1.0), ("f2", 10, 10, 21.0)])
    objects = ssos(spark, [("davida", True), ("diotima", False, True), ("ceres",)])
    moving = points(
        spark, track("davida", T0, hours(1), [(i, i, 1 + 0.1 * i) for i in range(10)]),
        track("diotima", T0 - hours(9), hours(1), [(i, i, None) for i in range(10)]),
        track("ceres", T0, hours(1), [(i + 5, i + 5, None) for i in range(10)]))
    return stars, objects, moving


def test_get_box(spark):
    stars, objects, moving = catalog(spark)
    box, end = Box(0, 4, 0, 4), T0 + hours(3)
    found = unified.get_box(stars, objects, moving, box, T0, end)
    assert rows(found, "kind", "id", "n_points", "do_flux") == [
        ("fixed", "f1", None, True), ("sso", "davida", 4, True)]
    placed = unified.box_at_time(stars, objects, moving, box, T0, end, T0 + seconds(1800))
    assert rows(placed, "id", "ra_deg", "status") == [("davida", 0.5, "ok"), ("f1", 1.0, "ok")]
    # Chosen by a point inside the box, described by all its points in the time range.
    wide = unified.box_at_time(stars, objects, moving, Box(0, 1, 0, 1), T0, T0 + hours(6), T0 + hours(5))
    assert ("davida", 5.0, "ok") in rows(wide, "id", "ra_deg", "status")


def test_flagged_sources(spark):
    stars, objects, moving = catalog(spark)
    found = unified.monitored_sources(stars, objects, moving, T0, T0 + hours(3))
    assert rows(found, "id") == [("davida",)]
    assert rows(unified.pointing_sources(stars, objects, moving, T0 - hours(9), T0), "id") == [("diotima",)]
    boxed = unified.monitored_sources(stars, objects, moving, T0, T0 + hours(3), Box(100, 110, 0, 1))
    assert boxed.count() == 0


def test_attach_keeps_points_outside_the_box(spark):
    _, objects, moving = catalog(spark)
    chosen = ephemeris.box_sso(objects, moving, Box(0, 1, 0, 1), T0, T0 + hours(3))
    for hot in (2, 2_000_000):
        attached = ephemeris.attach_ephem(chosen, moving, T0, T0 + hours(3), hot_rows=hot)
        assert rows(attached, "sso_id", "ra_deg") == [("davida", float(i)) for i in range(4)]


# --- hot objects give the same results as ordinary ones ---------------------------------------

@pytest.mark.parametrize("hot", [3, 20])
def test_segments_of_hot_objects(spark, hot):
    moving = Views(spark, DATA).moving_sources
    assert rows(ephemeris.segments(moving, hot)) == rows(ephemeris.segments(moving))


def test_hot_bursts_are_cut_down(spark):
    burst = [(f"b{i}", "a", None, "a", T0 + seconds(i / 1000), float(i % 360), 0.0, 1.0) for i in range(60)]
    late = track("a", T0 + hours(1000), hours(1000), [(1, 1, 1.0)] * 3)
    moving = spark.createDataFrame(burst + late, points(spark, late).schema)
    sliced, cut = ephemeris.time_slices(moving.withColumn("us", unix_micros(F.col("time"))), 10)
    assert cut and sliced.groupBy("sso_id", "_slice").count().agg(F.max("count")).first()[0] <= 20
    assert rows(ephemeris.segments(moving, 10)) == rows(ephemeris.segments(moving))


def test_hot_copies_of_one_point(spark):
    moving = spark.createDataFrame(
        track("a", T0, seconds(0), [(1, 1, 1.0)] * 50) + track("b", T0, hours(1), [(1, 1, 1.0), (2, 2, 1.0)]),
        points(spark, track("a", T0, hours(1), [(1, 1, 1.0)])).schema)
    assert rows(ephemeris.segments(moving, 5).select("sso_id").distinct()) == [("b",)]
    packed = ephemeris.packed(moving, 5)
    assert packed.agg(F.sum("n_points")).first()[0] == 52


@pytest.mark.parametrize("hot", [4, 2_000_000])
@pytest.mark.parametrize("small", [True, False])
def test_many_times_equal_plain_range_join(spark, monkeypatch, hot, small):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", skew.BROADCAST_BYTES if small else 0)
    v = Views(spark, DATA)
    moments = v.moving_sources.select("time").union(
        v.moving_sources.select((F.col("time") + F.expr("interval 17 minutes")).alias("time")))
    found = ephemeris.positions_at_times(v.moving_sources, moments, hot_rows=hot)
    seg = ephemeris.segments(v.moving_sources).where("us1 is not null")
    plain = seg.crossJoin(moments.distinct().withColumnRenamed("time", "t")).where(ephemeris.covers(unix_micros(F.col("t"))))
    got = rows(found, "sso_id", "time")
    assert got == rows(plain, "sso_id", "t") and len(got) == len(set(got)) > 1000


@pytest.mark.parametrize("hot", [3, 2_000_000])
def test_named_requests(spark, hot):
    table = points(spark, track("a", T0, hours(1), [(0, 0, 1.0), (1, 1, 2.0), (2, 2, 3.0)]),
                   track("one", T0, hours(1), [(5, 5, 1.0)]), track("twice", T0, hours(0), [(1, 1, 1.0)] * 9))
    asked = spark.createDataFrame(
        [("a", T0 + hours(0.5 * i)) for i in range(5)] + [("a", T0 + hours(3)), ("one", T0), ("x", T0), ("a", T0)]
        + [("twice", T0), ("a", None)], "sso_id string, time timestamp_ntz")
    found = ephemeris.positions_for(table, asked, hot_rows=hot)
    got = {(r.sso_id, r.time): (r.ra_deg, r.flux_mJy, r.status) for r in found.collect()}
    assert len(got) == 10 == found.count()
    assert got["a", T0 + hours(1.5)] == (1.5, 2.5, "ok") and got["a", T0 + hours(2)] == (2.0, 3.0, "ok")
    assert got["a", T0 + hours(3)][2] == "out_of_range"
    assert got["one", T0][2] == "too_few_points" and got["x", T0][2] == "unknown"
    assert got["twice", T0][2] == "duplicate_times" and got["a", None] == (None, None, "out_of_range")


def test_long_and_short_segments_together(spark):
    years = [(f"p{i}", "old", None, "old", datetime(1970 + 50 * i, 1, 1), float(i), 0.0, None) for i in range(2)]
    table = spark.createDataFrame(years + track("fast", T0, seconds(0.001), [(i, 0, None) for i in range(200)]) + track("day", T0, hours(24), [(i, 0, None) for i in range(9)]), POINT)
    seg = ephemeris.leveled_segments(table)
    assert ephemeris.by_time_cell(seg.where("sso_id = 'old'")).count() <= 2
    moments = [T0, T0 + seconds(0.0505), T0 + hours(30), datetime(1970, 1, 1), datetime(2020, 1, 1), datetime(1960, 1, 1)]
    asked = spark.createDataFrame([(m,) for m in moments], "time timestamp_ntz")
    got = {(r.sso_id, r.time): r.ra_deg for r in ephemeris.positions_at_times(table, asked).collect()}
    want = {("old", moments[3]), ("old", moments[4]), ("fast", T0), ("fast", moments[1]), ("day", T0), ("day", moments[1]), ("day", moments[2])}
    assert set(got) == want and got["fast", moments[1]] == pytest.approx(50.5) and got["day", moments[2]] == 1.25


@pytest.mark.parametrize("n", [1, 3])
def test_dyadic_cells_meet_every_moment_inside(spark, n):
    from skytables.operators import dyadic
    import random
    r = random.Random(1)
    some = [(a, a + int(2 ** r.uniform(0, 55))) for a in (r.randrange(-10**15, 10**15) for _ in range(300))]
    df = spark.createDataFrame(some, "a long, b long").withColumn("l", dyadic.level_of(F.col("b") - F.col("a"), n))
    cells = dyadic.cells_of(F.col("a"), F.col("b"), F.col("l"))
    found = df.select("*", cells.alias("cells"), F.explode(F.array("a", "b", F.expr("a + (b - a) div 3"))).alias("t"))
    assert found.where(~F.array_contains("cells", dyadic.cell_of(F.col("t"), F.col("l")))).count() == 0
    assert found.agg(F.max(F.size("cells"))).first()[0] <= n + 1


def test_packed_parts(spark):
    moving = Views(spark, DATA).moving_sources
    whole = ephemeris.packed(moving)
    assert whole.count() == moving.select("sso_id").distinct().count()
    small = ephemeris.packed(moving, 10)
    assert small.agg(F.sum("n_points")).first()[0] == moving.count()
    assert small.agg(F.max(F.size("points"))).first()[0] <= 20
    for r in small.collect():
        stamps = [p.time for p in r.points]
        assert stamps == sorted(stamps)


# --- moving cross-match -----------------------------------------------------------------------

@pytest.mark.parametrize("mode", ["linear", "shortest"])
@pytest.mark.parametrize("options", [
    {}, {"hot_rows": 3}])
def test_moving_match_equals_brute_force(spark, monkeypatch, mode, options):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0 if options else skew.BROADCAST_BYTES)
    v = Views(spark, DATA)
    moving = v.moving_sources.where("sso_id < 5")
    seen = v.january_detections
    found = crossmatch.crossmatch_moving(seen, moving, 5.0, ra_mode=mode, **options)
    every = ephemeris.positions_at_times(moving, seen, ra_mode=mode)
    from skytables.functions.angles import separation
    s = seen.select("det_id", "time", F.col("ra_deg").alias("t_ra"), F.col("dec_deg").alias("t_dec"))
    plain = every.join(s, "time").where(
        separation(F.col("t_ra"), F.col("t_dec"), F.col("ra_deg"), F.col("dec_deg")) <= 5.0)
    got = rows(found, "det_id", "sso_id")
    assert got == rows(plain, "det_id", "sso_id") and len(got) > 3 and len(set(got)) == len(got)


def test_moving_match_slow_object(spark):
    table = points(spark, track("a", T0, hours(24), [(359.9, 89.5, 1.0), (0.1, 89.6, 1.0)]))
    seen = spark.createDataFrame([(1, T0 + hours(12), 0.0, 89.55), (2, T0 + hours(12), 180.0, 89.55)],
                                 "det_id int, time timestamp_ntz, ra_deg double, dec_deg double")
    near = crossmatch.crossmatch_moving(seen, table, 0.1, ra_mode="shortest")
    assert rows(near, "det_id") == [(1,)]
    wide = crossmatch.crossmatch_moving(seen, table, 1.0, ra_mode="shortest")
    assert rows(wide, "det_id") == [(1,), (2,)]


def far_movers(spark, n_seen):
    """Objects that jump across the sky, some over a pole or not at all, and detections, a third of them at one moment."""
    r = random.Random(12)
    tracks = [track(f"o{k}", T0 + seconds(r.uniform(0, 5000)), seconds(r.choice([7, 900, 20_000])), [
        (r.uniform(0, 360), r.choice([90.0, -90.0, r.uniform(-90, 90), r.uniform(-90, 90)]), 1.0) for _ in range(25)]) for k in range(12)]
    still = [track(f"s{k}", T0, hours(50), [(359.9, 10.0 * k - 50.0, 1.0), (0.1, 10.0 * k - 50.0, None)]) for k in range(10)]
    moving = points(spark, *tracks, *still).unionByName(points(spark, track("null", T0, hours(1), [(5, 5, 1.0), (6, 7, 1.0)])).withColumn("sso_id", F.lit(None).cast("string")))
    some = [(None if i % 50 == 0 else i // 2, None if i % 40 == 0 else T0 + (hours(3) if i % 3 == 0 else seconds(r.uniform(-1000, 400_000))),
             None if i % 70 == 0 else r.uniform(0, 360), r.uniform(-90, 90)) for i in range(n_seen)]
    return moving, spark.createDataFrame(some, "det_id int, time timestamp_ntz, ra_deg double, dec_deg double")


@pytest.mark.parametrize("mode", ["linear", "shortest"])
@pytest.mark.parametrize("radius, build, work", [(8.0, 200_000, 10**7), (8.0, 2_000, 10**7), (2.0, 700, 3_000), (60.0, 300, 50_000)])
def test_moving_match_dealt_by_time(spark, monkeypatch, mode, radius, build, work):
    """Both sides dealt over many tasks, a crowded moment too; nulls and copies as brute force finds them (F1)."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(crossmatch, "BUILD_ROWS", build)
    monkeypatch.setattr(crossmatch, "TASK_WORK", work)
    moving, seen = far_movers(spark, 600)
    from skytables.functions.angles import separation, wrap_ra
    seg = ephemeris.segments(moving).where("us1 is not null").crossJoin(seen.select(
        "det_id", F.col("time").alias("t"), F.col("ra_deg").alias("a"), F.col("dec_deg").alias("b"))).where(ephemeris.covers(unix_micros(F.col("t"))))
    ra, dec, flux = ephemeris.interpolate(unix_micros(F.col("t")), mode)
    plain = seg.select("det_id", "sso_id", F.col("t").alias("time"), *[F.round(c, 6).alias(n) for c, n in (
        (wrap_ra(ra), "ra_deg"), (dec, "dec_deg"), (flux, "flux_mJy"), (separation(F.col("a"), F.col("b"), wrap_ra(ra), dec), "s"))]).where(F.col("s") <= radius)
    found = crossmatch.crossmatch_moving(seen, moving, radius, ra_mode=mode)
    got = rows(found.select("det_id", "sso_id", "time", *[F.round(c, 6) for c in ("ra_deg", "dec_deg", "flux_mJy", "separation_deg")]))
    assert got == rows(plain) and len(got) > 5
    assert found.rdd.getNumPartitions() >= (8 if work < 10**6 else 1)


@pytest.mark.parametrize("small", [True, False])
def test_far_movers_make_few_pairs(spark, monkeypatch, small):
    """With all tests of a pair taken out, the pairs that were to be tested are left: few of all (F1)."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 2**40 if small else 0)
    moving = far_movers(spark, 1)[0].where("sso_id like 'o%'")
    seen = spark.range(300_000).select(F.col("id").alias("det_id"), (F.lit(T0) + F.make_dt_interval(secs=F.rand(1) * 400_000)).alias("time"),
                                       (F.rand(2) * 360).alias("ra_deg"), (F.rand(3) * 180 - 90).alias("dec_deg"))
    monkeypatch.setattr(crossmatch, "covers", lambda us: F.lit(True))
    monkeypatch.setattr(crossmatch, "may_meet", lambda *a: F.lit(True))
    monkeypatch.setattr(crossmatch, "separation", lambda *a: F.lit(0.0))
    pairs = crossmatch.crossmatch_moving(seen, moving, 2.0).count()
    every = seen.crossJoin(moving.groupBy("sso_id").agg(F.min("time").alias("a"), F.max("time").alias("b"))).where("time between a and b")
    assert pairs * 20 < every.count()


def test_moving_match_of_nothing(spark):
    moving, seen = far_movers(spark, 20)
    for some, those in ((seen.where("false"), moving), (seen, moving.where("false")), (seen.where("false"), moving.where("false"))):
        found = crossmatch.crossmatch_moving(some, those, 5.0)
        assert found.count() == 0 and len(found.columns) == 7


def test_moving_match_can_be_compiled(spark, monkeypatch):
    """No method made for the plan is too long for the JVM to compile, which is at 8,000 bytes (F1)."""
    moving, seen = far_movers(spark, 300)
    view = SimpleNamespace(moving_sources=moving, january_detections=seen)
    for limit in (skew.BROADCAST_BYTES, 0):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
        found = checks_match.crossmatch_moving(view)
        found.collect()
        text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
        assert sizes and max(sizes) < 8000


def test_packed_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 1)
    rows_ = [p for k in range(7) for p in track(f"o{k}", T0, seconds(1 + k), [(i, 0, None) for i in range(40 + k)])]
    rows_ += track("same", T0, seconds(0), [(i % 3, 0, None) for i in range(30)])
    moving = spark.createDataFrame(rows_, POINT)
    one, many = (rows(ephemeris.packed(moving.repartition(n), 5), "sso_id", "part", "share", "n_points", "points") for n in (1, 16))
    assert one == many and sum(r[3] for r in one) == len(rows_)
    assert max(r[3] for r in one) <= 10


@pytest.mark.parametrize("pack, mode", [(100_000, "linear"), (5, "linear"), (5, "shortest")])
def test_packed_ephemerides_answer_as_points_do(spark, pack, mode):
    v = Views(spark, DATA)
    table = v.moving_sources.withColumn("sso_id", F.col("sso_id").cast("string")).select(*POINT_COLUMNS).unionByName(points(
        spark, track("one", T0, hours(1), [(5, 5, 1.0)]), track("twice", T0, hours(0), [(1, 1, 1.0)] * 9)).select(*POINT_COLUMNS))
    known = table.select("sso_id", "time")
    asked = known.union(known.select("sso_id", (F.col("time") + F.expr("interval 17 minutes")).alias("time"))).union(
        spark.createDataFrame([("x", T0), ("one", None)], "sso_id string, time timestamp_ntz"))
    digits = ["sso_id", "time", *[F.round(c, 9).alias(c) for c in ("ra_deg", "dec_deg", "flux_mJy")], "status"]
    want = rows(ephemeris.positions_for(table, asked, ra_mode=mode).select(*digits))
    got = rows(ephemeris.packed_at(ephemeris.packed(table, pack), asked, ra_mode=mode).select(*digits))
    assert got == want and len(want) > 1900


def test_each_time_is_asked_once(spark):
    stars, objects, moving = catalog(spark)
    found = unified.box_at_times(stars, objects, moving, Box(0, 4, 0, 4), T0, T0 + hours(3), [T0, T0, str(T0)])
    assert rows(found, "kind", "id") == [("fixed", "f1"), ("sso", "davida")]
