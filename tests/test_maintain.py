import pytest
from pyspark.sql import functions as F

from skytables.operators import integrity, maintain
from tables import POINT, T0, fixed, hours, points, rows, ssos, track


def test_insert_fixed_defaults_and_ids(spark):
    table = fixed(spark, [("a", 1, 1)])
    new = spark.createDataFrame([(-10.0, 5.0, "n"), (-10.0, 5.0, "n"), (None, 5.0, "x"), (1.0, 95.0, "y")],
                                "ra_deg double, dec_deg double, name string")
    done = maintain.insert_fixed(table, new, "cat")
    assert rows(done.added, "ra_deg", "flux_mJy", "monitored", "pointing") == [(350.0, None, False, False)] * 2
    assert done.added.select("source_id").distinct().count() == 2
    assert rows(done.rejected, "name", "reason") == [("x", "missing position"), ("y", "position out of range")]
    again = maintain.insert_fixed(done.table, new, "cat")
    assert again.added.count() == 0 and rows(again.table) == rows(done.table)
    other = maintain.insert_fixed(done.table, new, "another")
    assert other.added.count() == 2


def test_insert_keeps_given_ids(spark):
    new = spark.createDataFrame([("mine", 1.0, 2.0), (None, 1.0, 2.0)], "source_id string, ra_deg double, dec_deg double")
    added = maintain.insert_fixed(fixed(spark, [("a", 1, 1)]), new).added
    ids = [r[0] for r in rows(added, "source_id")]
    assert "mine" in ids and len(ids) == 2
    twice = spark.createDataFrame([("m", 1.0, 2.0), ("m", 1.0, 2.0), ("n", 1.0, 2.0), ("n", 1.0, 3.0), ("a", 9.0, 9.0)], new.schema)
    done = maintain.insert_fixed(fixed(spark, [("a", 1, 1)]), twice)
    assert rows(done.added, "source_id") == [("m",)]
    assert rows(done.rejected, "source_id", "reason") == [("a", "duplicate key")] + [("n", "duplicate key")] * 2
    named = twice.withColumnsRenamed({"source_id": "Source_Id", "ra_deg": "RA_DEG"})
    assert rows(maintain.insert_fixed(fixed(spark, [("a", 1, 1)]), named).added, "source_id") == [("m",)]


def test_insert_sso_is_unique(spark):
    table = ssos(spark, [("a",), ("b",)])
    new = spark.createDataFrame(
        [("name-a", 50), ("new", 60), ("new", 60), ("c1", 70), ("c1", 71), ("d", 1), (None, 9), ("free", None), ("free2", None)],
        "name string, MPC_id bigint")
    done = maintain.insert_sso(table, new)
    assert rows(done.added, "name", "MPC_id") == [("free", None), ("free2", None), ("new", 60)]
    assert rows(done.rejected, "name", "reason") == sorted([
        (None, "missing name"), ("c1", "name not unique"), ("c1", "name not unique"), ("d", "MPC_id not unique"),
        ("name-a", "name not unique")], key=repr)
    again = maintain.insert_sso(done.table, spark.createDataFrame([("new", 60)], "name string, MPC_id bigint"))
    assert again.added.count() == 0 and again.rejected.count() == 0
    other = maintain.insert_sso(done.table, spark.createDataFrame([("new", 61)], "name string, MPC_id bigint"))
    assert other.added.count() == 0 and rows(other.rejected, "name", "reason") == [("new", "name not unique")]
    given = spark.createDataFrame([("a", "z1", None), ("q", "z2", None), ("q", "z3", None), ("r", "z4", None)],
                                  "SSO_ID string, name string, MPC_id bigint")
    done = maintain.insert_sso(table, given)
    assert rows(done.added, "sso_id") == [("r",)]
    assert rows(done.rejected, "name", "reason") == [(n, "sso_id not unique") for n in ("z1", "z2", "z3")]


def test_infinite_position_is_rejected(spark):
    new = spark.createDataFrame([(float("inf"), 1.0), (float("nan"), 1.0), (1.0, float("-inf"))], "ra_deg double, dec_deg double")
    done = maintain.insert_fixed(fixed(spark, [("a", 1, 1)]), new)
    assert done.added.count() == 0 and rows(done.rejected, "reason") == [("position out of range",)] * 3


def test_refined_point_is_reported(spark):
    objects = ssos(spark, [("a",)])
    kind = "sso_id string, time timestamp_ntz, ra_deg double, dec_deg double, flux_mJy double"
    first = maintain.insert_ephem(points(spark, []), objects, spark.createDataFrame([("a", T0, 1.0, 1.0, 5.0)], kind))
    again = maintain.insert_ephem(first.table, objects, spark.createDataFrame([("a", T0, 1.0, 1.0, 6.0)], kind))
    assert first.added.count() == 1 and again.added.count() == 0
    assert rows(again.rejected, "sso_id", "reason") == [("a", "duplicate key")]


def test_insert_ephem_needs_its_object(spark):
    objects = ssos(spark, [("a",), ("b",)])
    table = points(spark, track("a", T0, hours(1), [(0, 0, None)]))
    new = spark.createDataFrame(
        [("a", None, None, T0 + hours(1), 1.0, 1.0), ("a", 2, None, T0, 1.0, 1.0), ("x", None, None, T0, 1.0, 1.0),
         ("b", 2, "name-b", T0, 370.0, 1.0), ("a", None, None, None, 1.0, 1.0), ("a", None, None, T0, None, 1.0)],
        "sso_id string, MPC_id bigint, name string, time timestamp_ntz, ra_deg double, dec_deg double")
    done = maintain.insert_ephem(table, objects, new)
    assert rows(done.added, "sso_id", "MPC_id", "name", "ra_deg") == [("a", 1, "name-a", 1.0), ("b", 2, "name-b", 10.0)]
    assert sorted(r.reason for r in done.rejected.collect()) == [
        "missing position", "missing time", "name or MPC_id of another object", "unknown sso_id"]
    assert maintain.insert_ephem(done.table, objects, new).added.count() == 0


def test_services(spark):
    kind = "service_id string, name string, config map<string,string>"
    table = spark.createDataFrame([("s1", "Simbad", {"name_col": "id"})], kind)
    new = spark.createDataFrame([("Simbad", {"name_col": "x"}), ("V", None)], "name string, config map<string,string>")
    done = maintain.insert_service(table, new)
    assert done.table.count() == 2 and rows(done.rejected, "name") == [("V",)]
    change = spark.createDataFrame([("s1", "VizieR", {"ra_col": "RAJ2000"})], kind)
    got = maintain.update_service(table, change).table.first()
    assert (got.service_id, got.name, got.config) == ("s1", "VizieR", {"ra_col": "RAJ2000"})


def updates(spark, values):
    return spark.createDataFrame(values, "source_id string, flux_mJy double, name string, monitored boolean, ord int")


def test_partial_update(spark):
    table = fixed(spark, [("a", 1, 2, 3.0), ("b", 4, 5, 6.0)])
    done = maintain.update_source(table, updates(spark, [("a", None, None, True, 0), ("b", None, None, None, 0),
                                                         ("x", 1.0, None, None, 0), (None, 1.0, None, None, 0)]))
    assert rows(done.table) == rows(fixed(spark, [("a", 1, 2, 3.0, True, False), ("b", 4, 5, 6.0)]))
    assert rows(done.missing) == [("x",)]
    assert rows(done.rejected, "source_id", "reason") == [("b", "nothing to update"), (None, "missing key")]
    with pytest.raises(ValueError):
        maintain.update_source(table, updates(spark, [("x", 1.0, None, None, 0)]), strict=True)


def test_several_updates_of_one_key(spark):
    table = fixed(spark, [("a", 1, 2, 3.0)])
    twice = updates(spark, [("a", 10.0, "first", None, 1), ("a", 20.0, None, None, 2)])
    last = maintain.update_source(table, twice, order="ord")
    assert rows(last.table, "flux_mJy", "name") == [(20.0, "first")]
    unordered = maintain.update_source(table, twice.drop("ord"))
    assert rows(unordered.table) == rows(table) and unordered.rejected.count() == 2


def test_update_order_and_values(spark):
    table = fixed(spark, [("a", 1, 2, 3.0)])
    tie = updates(spark, [("a", 10.0, None, None, 1), ("a", 20.0, None, None, 1), ("a", 30.0, None, None, None)])
    done = maintain.update_source(table, tie, order="ord")
    assert rows(done.table, "flux_mJy") == [(20.0,)] and rows(done.rejected, "reason") == [("missing order",)]
    bad = spark.createDataFrame([("a", float("nan")), ("b", float("inf"))], "source_id string, ra_deg double")
    done = maintain.update_source(table, bad)
    assert rows(done.table) == rows(table) and rows(done.rejected, "reason") == [("position out of range",)] * 2


def test_update_keeps_keys_unique(spark):
    objects = ssos(spark, [("a",), ("b",), ("c",)])
    change = spark.createDataFrame([("a", "name-b"), ("b", "same"), ("c", "same"), ("x", "fresh")], "SSO_ID string, Name string")
    done = maintain.update_sso(objects, change)
    assert rows(done.table) == rows(objects) and rows(done.missing) == [("x",)]
    assert rows(done.rejected, "sso_id", "reason") == [(k, "name not unique") for k in "abc"]
    moving = points(spark, track("a", T0, hours(1), [(0, 0, None)]))
    lost = spark.createDataFrame([("a-0", "nobody")], "ephem_id string, sso_id string")
    done = maintain.update_ephem(moving, lost, ssos=objects)
    assert rows(done.table) == rows(moving) and rows(done.rejected, "reason") == [("unknown sso_id",)]


def test_sso_cascade(spark):
    objects = ssos(spark, [("a", True), ("b",)])
    moving = points(spark, track("a", T0, hours(1), [(0, 0, None)] * 2), track("b", T0, hours(1), [(0, 0, None)]))
    change = spark.createDataFrame([("a", "renamed", None)], "sso_id string, name string, MPC_id bigint")
    done = maintain.update_sso_cascade(objects, moving, change)
    assert rows(done.ssos, "name", "monitored") == [("name-b", False), ("renamed", True)]
    assert rows(done.points, "sso_id", "name") == [("a", "renamed")] * 2 + [("b", "name-b")]
    gone = maintain.delete_sso_cascade(objects, moving, spark.createDataFrame([("a",), ("x",)], "sso_id string"))
    assert rows(gone.ssos, "sso_id") == [("b",)] and rows(gone.points, "sso_id") == [("b",)]
    assert rows(gone.missing) == [("x",)]


def test_delete_unknown(spark):
    table = fixed(spark, [("a", 1, 2)])
    keys = spark.createDataFrame([("x",)], "source_id string")
    assert rows(maintain.delete(table, keys, "source_id").table) == rows(table)
    with pytest.raises(ValueError):
        maintain.delete(table, keys, "source_id", strict=True)


def test_integrity(spark):
    objects = ssos(spark, [("a",), ("b",)]).union(ssos(spark, [("a",)]))
    rows_ = track("a", T0, hours(1), [(0, 0, None)]) + track("a", T0, hours(1), [(400, 0, None)]) + [
        ("o", "zz", 77, "nobody", T0, 1.0, 1.0, None)]
    moving = spark.createDataFrame(rows_, POINT)
    found = integrity.integrity_report(fixed(spark, [("s", 1, -95)]), objects, moving)
    got = {(r.table, r.rule, r.key) for r in found.collect()}
    assert got == {
        ("fixed_sources", "out of range", "s"), ("solarsystem_objects", "duplicate key", "a"),
        ("solarsystem_objects", "duplicate name", "name-a"), ("solarsystem_objects", "duplicate MPC_id", "1"),
        ("moving_sources", "out of range", "a-0"), ("moving_sources", "duplicate key", "a-0"),
        ("moving_sources", "duplicate time", "a 2025-02-01 00:00:00"), ("moving_sources", "orphan", "o")}
    clean = integrity.integrity_report(fixed(spark, [("s", 1, 1)]), ssos(spark, [("a",)]),
                                       points(spark, track("a", T0, hours(1), [(0, 0, None)])))
    assert clean.count() == 0
    assert found.where(F.col("rule") == "orphan").first().detail == "sso_id,MPC_id,name"


@pytest.mark.parametrize("hot", [2_000_000, 40])
def test_repeated_keys_are_counted_in_tasks_of_bounded_size(spark, monkeypatch, hot):
    """Few bytes of many keys are not put together into one task; results as a plain count (F9)."""
    monkeypatch.setattr(integrity, "TASK_KEYS", 500)
    keys = [(None if i % 50 == 0 else i, float("nan") if i % 7 == 0 else i / 2) for i in range(3000)]
    table = spark.createDataFrame(keys + keys[:70] + [(5, 1.0)] * 60, "k int, x double").repartition(3)
    for columns in (["k"], ["x"], ["k", "x"]):
        found = integrity.repeated(table, columns, hot_rows=hot)
        plain = table.dropna(subset=[c for c in columns if c == "k"]).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and plain.count() > 1
    tasks = integrity.repeated(table, ["k"], hot_rows=2_000_000).select(F.spark_partition_id()).distinct()
    plan = tasks._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Exchange hashpartitioning(k" in plan and ", 7), REPARTITION_BY_NUM" in plan


def _renamed(spark, known, updates):
    table = ssos(spark, [(k,) for k in known])
    changes = spark.createDataFrame(updates, "sso_id string, name string, MPC_id long")
    done = maintain.update_sso(table, changes)
    names = {r.sso_id: r.name for r in done.table.collect()}
    assert len(set(names.values())) == len(names)
    return names, sorted((r.sso_id, r.reason) for r in done.rejected.collect())


def test_names_may_be_swapped_in_one_statement(spark):
    names, rejected = _renamed(spark, "abcd", [("a", "name-b", None), ("b", "name-c", None), ("c", "name-a", None)])
    assert names == {"a": "name-b", "b": "name-c", "c": "name-a", "d": "name-d"} and rejected == []


def test_refusals_reach_those_that_wait(spark):
    """A long chain whose last name stays taken, one whose last name is free, and a cycle with a second claimant."""
    chain = [chr(97 + i) for i in range(20)]
    taken = [(a, f"name-{b}", None) for a, b in zip(chain, chain[1:], strict=False)]
    names, rejected = _renamed(spark, chain, taken)
    assert rejected == [(k, "name not unique") for k in chain[:-1]] and names["a"] == "name-a"
    names, rejected = _renamed(spark, chain, [*taken, (chain[-1], "free", None)])
    assert rejected == [] and names["a"] == "name-b" and names[chain[-1]] == "free"
    names, rejected = _renamed(spark, "abc", [("a", "name-b", None), ("b", "name-a", None), ("c", "name-a", None)])
    assert [r[0] for r in rejected] == ["a", "b", "c"]


def test_one_refused_column_holds_back_the_row(spark):
    """b cannot have its MPC id, so it keeps its name, and a cannot have that."""
    names, rejected = _renamed(spark, "abc", [("a", "name-b", None), ("b", "new", 3)])
    assert rejected == [("a", "name not unique"), ("b", "MPC_id not unique")] and names == {k: f"name-{k}" for k in "abc"}


def test_very_many_updates_to_one_name(spark):
    many = [f"k{i}" for i in range(2000)]
    _, rejected = _renamed(spark, many, [(k, "same", None) for k in many])
    assert len(rejected) == 2000
