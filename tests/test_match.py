import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skytables.functions.angles import separation
from skytables.operators import boxes, crossmatch, numbering, providers, skew, sky_join
from tables import fixed, rows

POSITIONS = "det_id int, ra_deg double, dec_deg double"


def sky(n, seed):
    """Positions all over the sky, many near RA 0/360, near the poles, and piled up in one place."""
    r = random.Random(seed)
    out = [(r.uniform(0, 360), r.uniform(-90, 90)) for _ in range(n)]
    out += [(r.choice([r.uniform(0, 2), r.uniform(358, 360)]), r.uniform(-3, 3)) for _ in range(n)]
    out += [(r.uniform(0, 360), r.choice([-1, 1]) * r.uniform(87, 90)) for _ in range(n)]
    out += [(10.0 + r.uniform(0, 0.5), 20.0) for _ in range(n)] + [(10.0, 20.0)] * 5 + [(0.0, 90.0), (0.0, -90.0)]
    return out


def both(spark):
    seen = spark.createDataFrame([(i, *p) for i, p in enumerate(sky(60, 1))], POSITIONS)
    stars = fixed(spark, [(f"s{i}", *p) for i, p in enumerate(sky(50, 2))])
    return seen, stars


def brute(seen, stars, radius):
    s = seen.select("det_id", F.col("ra_deg").alias("a"), F.col("dec_deg").alias("b"))
    pairs = s.crossJoin(stars).withColumn(
        "sep", separation(F.col("a"), F.col("b"), F.col("ra_deg"), F.col("dec_deg"))).where(F.col("sep") <= radius)
    return pairs.select("det_id", "source_id", "sep")


@pytest.mark.parametrize("radius, level, hot", [
    (0.5, None, 2_000_000), (3.0, 6, 10), (0.0, None, 10), (40.0, 3, 2_000_000), (100.0, None, 50), (3.0, 8, 100)])
def test_crossmatch_equals_brute_force(spark, monkeypatch, radius, level, hot):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0 if hot < 1000 else skew.BROADCAST_BYTES)
    seen, stars = both(spark)
    found = crossmatch.crossmatch_all(seen, stars, radius, level, hot)
    plain = brute(seen, stars, radius)
    got = rows(found, "det_id", "source_id")
    assert got == rows(plain, "det_id", "source_id") and len(got) >= 20


@pytest.mark.parametrize("hot", [5, 2_000_000])
def test_nearest_equals_brute_force(spark, hot):
    seen, stars = both(spark)
    best = {}
    for r in brute(seen, stars, 2.0).collect():
        best[r.det_id] = min(best.get(r.det_id, (999, "")), (r.sep, r.source_id))
    found = {r.det_id: (r.separation_deg, r.source_id)
             for r in crossmatch.crossmatch_nearest(seen, stars, 2.0, hot_rows=hot).collect()}
    assert found == best


def test_bad_positions_match_nothing(spark):
    seen = spark.createDataFrame([(1, None, 0.0), (2, 0.0, None), (3, 0.0, 0.0)], POSITIONS)
    assert rows(crossmatch.crossmatch_all(seen, fixed(spark, [("a", 0, 0)]), 1.0), "det_id") == [(3,)]


def test_cells_shrink_to_one_at_a_pole(spark):
    z = F.col("id")
    counts = [r[0] for r in spark.range(18).select(sky_join.cells_in_zone(z, 10.0)).collect()]
    assert counts[0] == counts[-1] == 6 or counts[0] == 1
    assert max(counts) == 35


@pytest.mark.parametrize("small", [True, False])
def test_circles_of_all_sizes_in_one_batch(spark, monkeypatch, small):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", skew.BROADCAST_BYTES if small else 0)
    seen, stars = both(spark)
    radii = F.element_at(F.array(*[F.lit(x) for x in (1 / 3600, 0.0, 0.02, 0.7, 9.0, 60.0, 180.0)]), F.col("det_id") % 7 + 1)
    targets = seen.select("det_id", F.col("ra_deg").alias("t_ra"), F.col("dec_deg").alias("t_dec"), radii.alias("radius_deg"))
    listed = stars.select("source_id", F.col("ra_deg").alias("p_ra"), F.col("dec_deg").alias("p_dec"))
    apart = separation(F.col("t_ra"), F.col("t_dec"), F.col("p_ra"), F.col("p_dec"))
    plain = rows(targets.crossJoin(listed).where(apart <= F.col("radius_deg")), "det_id", "source_id")
    assert rows(sky_join.within_radius(targets, listed), "det_id", "source_id") == plain and len(plain) > 500
    reach = F.col("radius_deg") + sky_join.SLACK
    level = sky_join.level_of(F.col("radius_deg") * 4)
    half = sky_join.half_width(F.col("t_dec"), reach)
    covered = sky_join.cover(targets, F.col("t_ra") - half, F.col("t_ra") + half, F.col("t_dec") - reach, F.col("t_dec") + reach, level)
    assert covered.groupBy("det_id").count().agg(F.max("count")).first()[0] <= 9


def test_boxes_take_few_cells(spark):
    import random
    r = random.Random(4)
    some = []
    for i in range(400):
        a, b = sorted(max(-90.0, min(90.0, r.uniform(-90, 90) + r.choice([0, 1e-4, 1, 30]) * r.random())) for _ in range(2))
        some.append((i, r.uniform(0, 360), 360 * r.random() ** r.choice([1, 4, 30]), a, b if r.random() < 0.5 else min(90.0, a + 10 ** r.uniform(-5, 1))))
    df = spark.createDataFrame(some, "i int, ra double, span double, a double, b double")
    level = sky_join.box_level(F.col("span"), F.col("a"), F.col("b"))
    covered = sky_join.cover(df.withColumn("_sky", level), F.col("ra"), F.col("ra") + F.col("span"), F.col("a"), F.col("b"), F.col("_sky"))
    assert covered.groupBy("i").count().agg(F.max("count")).first()[0] <= sky_join.MAX_CELLS
    inside = df.select("*", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.37, 1.0)])).alias("x")).select(
        "i", (F.col("ra") + F.col("x") * F.col("span")).alias("p"), (F.col("a") + F.col("x") * (F.col("b") - F.col("a"))).alias("q"), level.alias("_sky"))
    placed = sky_join.place(inside, "p", "q", F.col("_sky"))
    assert placed.join(covered, ["i", "_sky", "_zone", "_cell"], "left_anti").count() == 0


def providers_of(spark):
    a = spark.createDataFrame([("x", 10.0, 20.0), ("x", 5.0, 5.0), ("y", -36.6374, 0.0)], "id string, ra double, d double")
    b = spark.createDataFrame([("x", 10.0, 21.0, 7.0)], "n string, RAJ double, DEJ double, f double")
    return [providers.Provider("Simbad", a, {"name_col": "id", "ra_col": "ra", "dec_col": "d"}),
            providers.Provider("VizieR", b, {"name_col": "n", "ra_col": "RAJ", "dec_col": "DEJ", "flux_col": "f"})]


def test_cone_search(spark):
    cones = spark.createDataFrame([(1, 10.0, 20.0, 0.0), (2, 10.0, 20.0, 1.0), (3, 323.3626, 0.0, 0.001)],
                                  "cone_id int, ra_deg double, dec_deg double, radius_deg double")
    found = providers.cone_search(cones, providers_of(spark))
    got = rows(found.select("cone_id", "provider", "name", "flux_mJy", F.round("distance", 9), F.round("separation_deg", 9)))
    assert got == [(1, "Simbad", "x", None, 0.0, 0.0), (2, "Simbad", "x", None, 0.0, 0.0),
                   (2, "VizieR", "x", 7.0, 1.0, 1.0), (3, "Simbad", "y", None, 0.0, 0.0)]


def test_config_must_name_the_columns(spark):
    with pytest.raises(ValueError, match="dec_col"):
        providers.provider_table(providers_of(spark)[0]._replace(config={"name_col": "id", "ra_col": "ra"}))


def test_load_providers(spark):
    services = spark.createDataFrame(
        [("Simbad", {"name_col": "id", "ra_col": "ra", "dec_col": "d"}), ("Gone", {"name_col": "x"})],
        "name string, config map<string,string>")
    table = providers_of(spark)[0].table
    loaded = providers.load_providers(services, {"Simbad": table, "VizieR": table})
    assert [(p.name, [r.config["ra_col"] for r in p.config.collect()]) for p in loaded] == [("Simbad", ["ra"])]
    assert rows(providers.all_providers(loaded)) == rows(providers.provider_table(providers_of(spark)[0]._replace(
        config={"name_col": "id", "ra_col": "ra", "dec_col": "d"})))
    many = spark.createDataFrame([("Simbad", {"name_col": "ID", "ra_col": "ra", "dec_col": "d", "n": str(i)}) for i in range(3)], services.schema)
    with pytest.raises(ValueError, match="no column"):
        providers.all_providers(providers.load_providers(many, {"Simbad": table}))


def test_resolve_name(spark):
    names = spark.createDataFrame([("Simbad", "x"), ("Simbad", "q"), ("Gaia", "x"), ("VizieR", "x"), ("Simbad", "x")],
                                  "provider string, name string")
    services = spark.createDataFrame([("Simbad",), ("VizieR",), ("VizieR",)], "name string")
    done = providers.resolve_name(names, providers.all_providers(providers_of(spark)), services)
    assert rows(done.found, "provider", "ra_deg", "n_matches") == [("Simbad", 5.0, 2), ("VizieR", 10.0, 1)]
    assert rows(done.missing, "provider", "name") == [("Simbad", "q")]
    assert rows(done.rejected, "provider") == [("Gaia",)]
    made = providers.create_by_name(
        fixed(spark, [("a", 0, 0)]), names, providers.all_providers(providers_of(spark)), services)
    assert rows(made.added, "name", "ra_deg") == [("x", 10.0), ("x", 5.0)] and made.table.count() == 3
    assert made.missing.count() == made.rejected.count() == 1


# --- guards -----------------------------------------------------------------------------------

def skewed(spark, n=400):
    """A third of the rows share one key, another share has a null key, and there are copies."""
    return spark.createDataFrame(
        [(7 if i % 3 == 0 else None if i % 10 == 1 else i % 50, i // 2) for i in range(n)], "k int, v int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, how):
    left = skewed(spark)
    right = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (None, "n"), (99, "z")], "k int, w string")
    assert skew.hot_keys(left, ["k"], 20) is not None
    assert rows(skew.salted_join(left, right, ["k"], how, hot_rows=20)) == rows(left.join(right, "k", how))
    cond = F.col("v") % 2 == 0
    salted = skew.salted_join(left, right, ["k"], how, cond, hot_rows=20)
    plain = left.join(right.withColumnRenamed("k", "k2"), (F.col("k") == F.col("k2")) & cond, how).drop("k2")
    assert rows(salted) == rows(plain)


@pytest.mark.parametrize("limit", [5, 1_000_000])
def test_grid_join_equals_plain(spark, monkeypatch, limit):
    """One key crowded on both sides, another on one, nulls and copies."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    left = skewed(spark)
    right = spark.createDataFrame([(7 if i % 2 else 3 if i % 10 == 0 else None if i % 3 == 0 else i, i % 30) for i in range(90)], "k int, w int")
    cond = (F.col("v") + F.col("w")) % 3 != 0
    plain = left.join(right.withColumnRenamed("k", "k2"), (F.col("k") == F.col("k2")) & cond).drop("k2")
    met = skew.grid_join(left, right, ["k"], cond, limit)
    assert rows(met) == rows(plain) and met.columns == ["k", "v", "w"]
    assert rows(skew.grid_join(left, right, ["k"], hot_rows=limit)) == rows(left.join(right, "k"))


def test_grid_join_bounds_a_block(spark, monkeypatch):
    """A crowded cell on each side: no task meets more than about the limit of a key from either."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    left, right = (spark.range(n).select((F.col("id") % 1 + 7).alias("k"), F.col("id").alias(c)) for n, c in ((400, "a"), (300, "b")))
    joined = skew.grid_join(left, right, ["k"], hot_rows=5)
    assert joined.count() == 400 * 300
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_row_part" in plan and "_other_part" in plan
    parts = skew.attach_hot(left, skew.hot_keys(left, ["k"], 5), ["k"]).withColumn("p", skew.spread(left, F.ceil(F.col("n_rows") / 5).cast("bigint")))
    assert parts.groupBy("p").count().agg(F.max("count")).first()[0] <= 25


def test_salted_join_with_a_map_column(spark):
    left = spark.createDataFrame([("a", {"x": "1"})] * 30 + [("b", {"y": "2"})], "k string, config map<string,string>")
    right = spark.createDataFrame([("a",)], "k string")
    assert skew.salted_join(left, right, ["k"], "left_anti", hot_rows=5).collect()[0].k == "b"


def test_salt_spreads_the_hot_key(spark):
    left = skewed(spark, 600).repartition(4)
    hot = skew.hot_keys(left, ["k"], 20)
    spread = skew.attach_hot(left, hot, ["k"]).where("k = 7").select(
        skew.spread(left, F.ceil(F.col("n_rows") / 20).cast("bigint")).alias("s"))
    assert spread.select("s").distinct().count() >= 5


def test_hot_keys_by_sample(spark):
    many = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    found = skew.hot_keys(many, ["k"], 20_000)
    assert [r.k for r in found.collect()] == [7]
    assert skew.hot_keys(many.where("k <> 7"), ["k"], 20_000) is None


@pytest.mark.parametrize("slice_rows", [5, 64, 10**6])
def test_number_rows(spark, slice_rows):
    df = skewed(spark).withColumn("row", F.monotonically_increasing_id() % 100_000 + F.col("v") * 0)
    df = spark.createDataFrame([(r.k, i) for i, r in enumerate(df.collect())], "k int, row bigint")
    numbered = numbering.number_rows(df, ["k"], ["row"], "rn", slice_rows)
    plain = df.withColumn("rn", F.expr("row_number() over (partition by k order by row)").cast("bigint"))
    assert rows(numbered, "k", "row", "rn") == rows(plain, "k", "row", "rn")


@pytest.mark.parametrize("block", [3, 10**6])
def test_number_occurrences(spark, block):
    df = spark.createDataFrame([("a", 1)] * 10 + [("a", 2)] * 5 + [("b", None)] * 2 + [("c", 3)], "k string, v int")
    assert rows(numbering.number_occurrences(df, ["k"], "n", block)) == sorted(
        [("a", 1, i) for i in range(1, 11)] + [("a", 2, i) for i in range(11, 16)]
        + [("b", None, 1), ("b", None, 2), ("c", 3, 1)], key=repr)


def test_number_occurrences_of_one_crowded_key(spark):
    data = [("hot", i * 7919 % 10_000, None if i % 3 else "x") for i in range(10_000)]
    data += [("hot", 5, "y")] * 12 + [(None, i, None) for i in range(20)] + [("cold", 1, None), ("cold", 0, "z")]
    df = spark.createDataFrame(data, "k string, a int, b string")
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] is not None, r[2] or ""))
    seen, want = {}, []
    for r in order:
        seen[r[0]] = seen.get(r[0], 0) + 1
        want.append((*r, seen[r[0]]))
    assert rows(numbering.number_occurrences(df, ["k"], "n", 5)) == sorted(want, key=repr)
    counted = df.groupBy(*df.columns).count()
    cut = numbering._pieces(counted, numbering.hot_keys(df, ["k"], 5), ["k"], ["a", "b"], 5)
    assert max(r["count"] for r in cut.groupBy("k", "_piece").count().collect()) <= 5


def test_broadcast_only_when_measured_small(spark, monkeypatch):
    small = spark.createDataFrame([("a",)], "k string")
    assert "broadcast" in skew.broadcast_if_small(small)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 10)
    assert "broadcast" not in skew.broadcast_if_small(small)._jdf.queryExecution().logical().toString().lower()
    big = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert rows(skew.dimension_join(big, small, ["k"], "left_anti")) == [("b", 2)]
    assert rows(skew.restrict(big, small, ["k"])) == rows(big)


@pytest.mark.parametrize("small", [True, False])
def test_grid_join_bounds_the_pairs_of_a_task(spark, monkeypatch, small):
    """A key below the hot limit on both sides, but with too many pairs for a task (F2, F4, F5)."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", skew.BROADCAST_BYTES if small else 0)
    monkeypatch.setattr(skew, "TASK_PAIRS", 1_000)
    monkeypatch.setattr(skew, "PAIRS_SHARE", 1.0)
    left = spark.range(0, 400, 1, 1).select((F.col("id") % 1 + 7).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select((F.col("id") % 1 + 7).alias("k"), F.col("id").alias("b"))
    met = skew.grid_join(left, right, ["k"], task_pairs=1_000)
    tasks = [r[0] for r in met.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(tasks) == 400 * 300 and max(tasks) <= 12_000 and len(tasks) >= 60


def test_one_shuffle_of_a_side(spark, monkeypatch):
    """With all circles on one level, the sides of a cross-match are not shuffled twice (F4)."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    seen, stars = both(spark)
    plan = crossmatch.crossmatch_all(seen, stars, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_near_positions_need_no_trigonometry(spark):
    """The plain comparisons keep every pair within the radius, also over a pole and across RA 0/360."""
    import random
    r = random.Random(8)
    some = [(r.uniform(0, 360), r.choice([90.0, -90.0, r.uniform(-90, 90)]), r.uniform(-720, 720), r.uniform(-90, 90), 10 ** r.uniform(-3, 2.2)) for _ in range(4000)]
    some += [(a, d, a + r.uniform(-1, 1) * g, max(-90.0, min(90.0, d + r.uniform(-1, 1) * g)), g) for a, d, _, _, g in some]
    df = spark.createDataFrame(some, "t_ra double, t_dec double, p_ra double, p_dec double, radius_deg double")
    at = [F.col(c) for c in ("t_ra", "t_dec", "p_ra", "p_dec")]
    reach = F.col("radius_deg") + sky_join.SLACK
    near = sky_join.may_meet(*at, sky_join.half_width(F.col("t_dec"), reach), reach)
    met = df.where(separation(*at) <= F.col("radius_deg"))
    assert met.count() > 1000 and met.where(~near).count() == 0 and df.where(~near).count() > 1000


@pytest.mark.parametrize("level", [None, 5])
def test_nearest_looks_near_first(spark, monkeypatch, level):
    """In a dense catalog only few pairs are made; results equal brute force, ids that are null or come twice too (F3)."""
    import random
    r = random.Random(2)
    stars = fixed(spark, [(f"s{i}", r.uniform(0, 30), r.uniform(-90, -60)) for i in range(3000)])
    some = [(None if i % 50 == 0 else i // 2, r.uniform(0, 40), r.uniform(-90, -50)) for i in range(300)]
    seen = spark.createDataFrame(some, "det_id int, ra_deg double, dec_deg double")
    radii = crossmatch.search_radii(20.0, 3000)
    assert len(radii) > 1 and radii[-1] == 20.0 and crossmatch.search_radii(0.5, 0) == [0.5]
    apart = separation(F.col("ra_deg"), F.col("dec_deg"), F.col("p_ra"), F.col("p_dec"))
    listed = stars.select("source_id", F.col("ra_deg").alias("p_ra"), F.col("dec_deg").alias("p_dec"))
    plain = seen.crossJoin(listed).select("det_id", apart.alias("s"), "source_id").where("s <= 20").groupBy("det_id").agg(
        F.min(F.struct("s", "source_id")).alias("b")).select("det_id", "b.source_id", F.col("b.s").alias("separation_deg"))
    made = []
    monkeypatch.setattr(crossmatch, "within_radius", lambda *a: made.append(sky_join.within_radius(*a)) or made[-1])
    assert rows(crossmatch.crossmatch_nearest(seen, stars, 20.0, level)) == rows(plain)
    assert made[0].count() * 2 < crossmatch.crossmatch_all(seen, stars, 20.0).count()


@pytest.mark.parametrize("hot, part", [(2_000_000, 100_000), (2_000_000, 7), (25, 7)])
def test_pairs_of_boxes_and_objects_are_not_shuffled(spark, monkeypatch, hot, part):
    """Hits and pairs stay in the task that found them; ids that are null or come twice, and crowded objects, as plain (F6)."""
    r, day = random.Random(6), datetime(2024, 1, 1)
    moment = lambda: day + timedelta(hours=r.randrange(240))
    seen = spark.createDataFrame(
        [(r.choice([None, *range(12), *[3] * 12]), None if i % 40 == 0 else moment(), r.uniform(0, 360), r.uniform(-90, 90)) for i in range(400)],
        "sso_id int, time timestamp_ntz, ra_deg double, dec_deg double")
    asked = []
    for i in range(80):
        t, dec = moment(), r.uniform(-90, 60)
        asked.append((None if i % 20 == 0 else i // 2, r.uniform(0, 360), r.uniform(0, 360), dec, dec + r.uniform(0, 60), t, t + timedelta(hours=r.choice([0, 5, 100]))))
    asked = spark.createDataFrame(asked, "box_id long, ra_min double, ra_max double, dec_min double, dec_max double, t_min timestamp_ntz, t_max timestamp_ntz")
    objects = spark.createDataFrame([(i, f"obj{i}") for i in [None, *range(10), 4]], "sso_id long, name string")
    ra_ok = F.expr("CASE WHEN ra_min <= ra_max THEN ra_deg BETWEEN ra_min AND ra_max ELSE ra_deg >= ra_min OR ra_deg <= ra_max END")
    inside = ra_ok & F.expr("dec_deg BETWEEN dec_min AND dec_max AND time BETWEEN t_min AND t_max")
    plain = seen.crossJoin(asked).where(inside).select("box_id", "sso_id").distinct().join(objects, "sso_id")
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(boxes, "TASK_BOXES", part)
    found = boxes.boxes_sso(objects, seen, asked, hot, task_pairs=200)
    assert rows(found) == rows(plain) and plain.count() > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning(box_id" in plan) == (hot == 25)


def test_points_meet_boxes_unsorted(spark, monkeypatch):
    """The boxes of a task are held by key, however many cells they have, and the points pass by unsorted (F2)."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(boxes, "TASK_BOXES", 10)
    day = datetime(2024, 1, 1)
    asked = spark.createDataFrame([(i, 5.0 * i, 5.0 * i + 40, -50.0, 50.0, day, day + timedelta(hours=i)) for i in range(40)],
                                  "box_id long, ra_min double, ra_max double, dec_min double, dec_max double, t_min timestamp_ntz, t_max timestamp_ntz")
    seen = spark.createDataFrame([(i % 9, day + timedelta(hours=i % 30), float(i), i % 90 - 45.0) for i in range(360)],
                                 "sso_id long, time timestamp_ntz, ra_deg double, dec_deg double")
    found = boxes.boxes_sso(spark.range(9).withColumnRenamed("id", "sso_id"), seen, asked)
    inside = F.expr("ra_deg BETWEEN ra_min AND ra_max AND dec_deg BETWEEN dec_min AND dec_max AND time BETWEEN t_min AND t_max")
    assert rows(found, "box_id", "sso_id") == rows(seen.crossJoin(asked).where(inside).select("box_id", "sso_id").distinct())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and found.count() > 20
    assert found.rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("radius, pairs, crowd", [(3.0, 10**7, 10**9), (3.0, 40, 10**9), (0.5, 10, 10**9), (20.0, 200, 10**9), (3.0, 40, 3)])
def test_targets_are_shuffled_for_areas(spark, monkeypatch, radius, pairs, crowd):
    """Many targets are shuffled for the few areas they touch, and repeated for cells after it; results as brute force (F3)."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(skew, "PAIRS_SHARE", 1.0)
    monkeypatch.setattr(sky_join, "AREA_ROWS", 1)
    monkeypatch.setattr(sky_join, "AREA_POINTS", crowd)
    monkeypatch.setattr(sky_join, "TASK_PAIRS", pairs)
    seen, stars = both(spark)
    seen = seen.unionByName(seen.limit(20)).unionByName(seen.limit(30).withColumn("det_id", F.lit(None).cast("int")))
    stars = stars.unionByName(stars.limit(10))
    found = crossmatch.crossmatch_all(seen, stars, radius)
    got = rows(found.withColumn("separation_deg", F.round("separation_deg", 9)))
    assert got == rows(brute(seen, stars, radius).withColumn("sep", F.round("sep", 9))) and len(got) >= 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning(_zone" in plan) == (crowd == 3)
    assert plan.count("Exchange shufflepartitionidpassthrough") == (0 if crowd == 3 else 2)
    assert found.rdd.getNumPartitions() >= (4 if pairs < 10**6 else 1)
