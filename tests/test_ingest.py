from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skytables.plans.fits_files import table_bytes
from skytables.plans.registry import Views
from skytables.operators.boxes import Box
from skytables.sources import catalogs, fits, generations, jpl, mpc, snapshot
from tables import T0, fixed, hours, points, rows, ssos, track

DATA = "/root/testdata/sf0.001"


# --- catalogs ---------------------------------------------------------------------------------

def test_act(spark):
    act = spark.createDataFrame([(10.0, 1.0, 0.1, "a"), (20.0, 2.0, 0.3, "b"), (30.0, 3.0, 0.0199, "c"), (40.0, 4.0, float("nan"), "d")],
                                "raDeg double, decDeg double, fluxJy double, name string")
    done = catalogs.ingest_act(act)
    assert rows(done.rows.where("name < 'd'"), "name", "flux_mJy", "monitored", "pointing") == [
        ("a", 100.0, True, False), ("b", 300.0, True, True), ("c", pytest.approx(19.9), False, False)]
    assert rows(done.rows.where("name = 'd'"), "monitored") == [(False,)]
    with pytest.raises(ValueError, match="fluxJy"):
        catalogs.ingest_act(act.drop("fluxJy"))


def test_websky_csv(spark, tmp_path):
    path = tmp_path / "websky.csv"
    path.write_text(" flux(Jy), RA(deg), dec(deg)\n0.1,-36.6374,-0.5\n0.01,10,10\n0.2,0.0,5.25\n")
    done = catalogs.ingest_websky(catalogs.read_websky(spark, str(path)), flux_lower_limit_jy=0.05)
    got = rows(done.rows.select(F.round("ra_deg", 6), "dec_deg", "flux_mJy", "name", "monitored"))
    assert got == [(0.0, 5.25, 200.0, "J000000.00+051500.0", False), (323.3626, -0.5, 100.0, "J213327.02-003000.0", False)]
    with pytest.raises(ValueError, match="ra"):
        catalogs.read_text_catalog(spark, str(path))


def test_text_csv(spark, tmp_path):
    path = tmp_path / "text.csv"
    path.write_text("ra,dec,name,monitored\n1.5,2.5,a,True\n-1,2,b,False\n1,2,c,perhaps\n,2,d,True\n")
    done = catalogs.ingest_text(catalogs.read_text_catalog(spark, str(path)))
    assert rows(done.rows, "name", "ra_deg", "flux_mJy", "monitored", "pointing") == [
        ("a", 1.5, None, True, False), ("b", 359.0, None, False, False)]
    assert rows(done.rejected, "name", "reason") == [("c", "monitored is not a boolean"), ("d", "missing position")]


# --- JPL --------------------------------------------------------------------------------------

JPL = "designation string, julian_day double, ra_deg double, dec_deg double"


def test_jpl_file(spark, tmp_path):
    path = str(tmp_path / "jpl.parquet")
    spark.createDataFrame([("511 Davida", 2451545.0 + i, 10.0 + i, 1.0, 1.5 + 0.1 * i) for i in range(3)],
                          JPL + ", flux_mJy double").coalesce(1).write.parquet(path)
    done = jpl.ingest_jpl(jpl.read_jpl(spark, path))
    assert rows(done.ssos, "MPC_id", "name", "monitored", "pointing") == [(511, "Davida", True, False)]
    assert rows(done.points, "MPC_id", "name", "time", "flux_mJy")[0] == (511, "Davida", datetime(2000, 1, 1, 12), 1.5)
    assert done.points.join(done.ssos, "sso_id").count() == 3
    every = jpl.ingest_jpl(jpl.read_jpl(spark, path), every=2)
    assert rows(every.points, "ra_deg") == [(10.0,), (12.0,)]
    assert rows(jpl.ingest_jpl(jpl.read_jpl(spark, path), every=9).points, "ra_deg") == [(10.0,)]
    assert jpl.ingest_jpl(jpl.read_jpl(spark, path)).points.exceptAll(done.points).count() == 0


def test_jpl_without_flux_or_designation(spark):
    table = spark.createDataFrame([("2 Pallas Beta", 2451545.0, 1.0, 1.0), (None, 2451545.0, 1.0, 1.0), ("", 2451545.0, 1.0, 1.0)], JPL)
    done = jpl.ingest_jpl(table, name_mode="second_token", monitored=False)
    assert rows(done.points, "name", "flux_mJy") == [("Pallas", None)]
    assert rows(done.ssos, "name", "monitored") == [("Pallas", False)]
    assert done.rejected.count() == 2
    with pytest.raises(ValueError, match=r"\['dec_deg', 'ra_deg'\]"):
        jpl.ingest_jpl(table.drop("ra_deg", "dec_deg"))
    with pytest.raises(ValueError, match="row_index"):
        jpl.ingest_jpl(table, every=2)


# --- MPC --------------------------------------------------------------------------------------

def sky_line(date, ra, dec, motion=("120.0", "90.5"), rest=""):
    line = f"{date:<18}{ra:<11}{dec:<10}{'1.234':<8}{'2.345':<9}{'90.1':<6}{'12.3':<7}{'18.5':<4}"
    return f"{line}{motion[0]:<9}{motion[1]:<9}"[:92].ljust(92) + rest


def test_mpc_sky_files(spark, tmp_path):
    body = [
        "<html><pre>", "Date       UT      R.A. (J2000) Decl.    Delta     r     El.    Ph.   V      Sky Motion    Moon",
        "            h m s                                                            \"/h   P.A.",
        sky_line("2024 01 05 123000", "01 00 00.0", "-00 30 00", rest="123456  7890"),
        sky_line("2024 01 06 000000", "23 59 59.9", "+89 59 59", motion=("N/A", "1.0")), "</pre></html>"]
    (tmp_path / "a.txt").write_text("\n".join(body))
    (tmp_path / "none.txt").write_text("<html>no table</html>")
    lines = mpc.read_responses(spark, str(tmp_path), "sky")
    got = mpc.parse_sky(lines).orderBy("time").collect()
    assert len(got) == 2 and got[0].time == datetime(2024, 1, 5, 12, 30)
    assert (got[0].ra_deg, got[0].dec_deg, got[0].delta_au, got[0].v_mag) == (15.0, -0.5, 1.234, 18.5)
    assert (got[0].proper_motion_arcmin_h, got[0].direction_deg) == (2.0, 90.5)
    assert got[0].azimuth_deg == 123456.0 and got[0].uncertainty_pa_deg is None
    assert got[1].proper_motion_arcmin_h is None
    assert [r.source_file.endswith("none.txt") for r in mpc.empty_responses(spark, str(tmp_path), "sky").collect()] == [True]
    coord = mpc.parse_sky(lines, motion="coord").orderBy("time").first()
    assert (coord.dra_arcmin_h, coord.ddec_arcmin_h) == (2.0, pytest.approx(90.5 / 60))
    with pytest.raises(ValueError):
        mpc.parse_sky(lines, motion="other")


def test_mpc_uncertainty_after_moon(spark):
    rest = "x" * 36 + "12345678 " + "  77.5"
    line = sky_line("2024 01 05 123000", "01 00 00.0", "+00 30 00")[:92] + rest
    both = spark.createDataFrame([("Moon Uncertainty", line)], "header string, line string")
    unc = spark.createDataFrame([("Uncertainty", line[:92] + "1234567.5  12.5")], "header string, line string")
    assert mpc.parse_sky(both).first().uncertainty_3sig_arcsec == 12345678.0
    got = mpc.parse_sky(unc).first()
    assert got.uncertainty_3sig_arcsec == 1234567.5 and got.azimuth_deg is None


def test_mpc_geocentric_file(spark, tmp_path):
    text = "<pre>\nObject      JD_TT           X  Y  Z\n" + f"{'511':<12}{'2460310.5':<16}{'1.5':<17}{'-2.5':<16}N/A\n" + "</pre>"
    (tmp_path / "v.txt").write_text(text)
    got = mpc.parse_vectors(mpc.read_responses(spark, str(tmp_path), "geocentric"), "geocentric").first()
    assert (got.object, got.jd_tt, got.x_au, got.y_au, got.z_au) == ("511", 2460310.5, 1.5, -2.5, None)


# --- FITS -------------------------------------------------------------------------------------

def test_fits_row_ranges(spark, tmp_path):
    n = 1000
    names = np.array([f"Source_{i}" for i in range(n)], dtype="S20")
    data = {"raDeg": np.arange(n) * 0.36, "decDeg": np.linspace(-90, 90, n), "fluxJy": np.arange(n) / 100, "name": names}
    path = tmp_path / "act.fits"
    path.write_bytes(table_bytes(data))
    table = fits.read_fits(spark, str(path), split_bytes=10_000)
    assert table.rdd.getNumPartitions() == 6
    assert table.dtypes == [("raDeg", "double"), ("decDeg", "double"), ("fluxJy", "double"), ("name", "string")]
    got = table.agg(F.count("*"), F.sum("raDeg"), F.countDistinct("name")).first()
    assert got[0] == n and got[1] == pytest.approx(data["raDeg"].sum()) and got[2] == n
    done = catalogs.ingest_act(table)
    assert done.rows.count() == n and done.rows.where("pointing").count() == n - 30
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        (folder / f"p{i}.fits").write_bytes(table_bytes(data))
    assert fits.read_fits(spark, str(folder)).count() == 3 * n
    with pytest.raises(Exception):
        fits.read_fits(spark, str(path), hdu=2).count()


def test_fits_columns():
    raw = np.array([[1, 2], [3, 4]], dtype=">i2")
    pair = fits.Column("v", "2I", 1, 0)
    assert pair.decode(raw, fits._arrow(pair.kind.elementType and pair.kind)).to_pylist() == [[1, 2], [3, 4]]
    unsigned = fits.Column("u", "I", 1, 32768)
    assert unsigned.decode(raw[:, 0], fits._arrow(unsigned.kind)).to_pylist() == [32769, 32771]
    scaled = fits.Column("s", "J", 0.5, 1)
    assert scaled.decode(raw[:, 0].astype(">i4"), fits._arrow(scaled.kind)).to_pylist() == [1.5, 2.5]
    flag = fits.Column("f", "L", 1, 0)
    assert flag.decode(np.array([b"T", b"F", b""]), fits._arrow(flag.kind)).to_pylist() == [True, False, None]
    missing = fits.Column("m", "I", 1, 0, 3)
    assert missing.decode(raw[:, 0], fits._arrow(missing.kind)).to_pylist() == [1, None]
    widths = {"11X": 2, "2C": 16, "M": 16, "1PD(5)": 8, "Q": 16, "0P": 0}
    for form, width in widths.items():
        skipped = fits.Column("c", form, 1, 0)
        assert skipped.kind is None and np.dtype([skipped.dtype]).itemsize == width
    with pytest.raises(ValueError):
        fits.Column("c", "1Z", 1, 0)


# --- snapshot ---------------------------------------------------------------------------------

def test_snapshot(spark, tmp_path):
    path = str(tmp_path / "snap")
    stars = fixed(spark, [("a", 1, 2, 3.0), ("b", 4, 5)])
    objects, moving = ssos(spark, [("o",)]), points(spark, track("o", T0, hours(12), [(i, i, None) for i in range(10)]))
    snapshot.write_snapshot({"fixed_sources": stars, "solarsystem_objects": objects, "moving_sources": moving}, path)
    assert rows(snapshot.read_snapshot(spark, path, "fixed_sources")) == rows(stars)
    assert rows(snapshot.read_snapshot(spark, path, "solarsystem_objects")) == rows(objects)
    assert rows(snapshot.read_snapshot(spark, path, "moving_sources")) == rows(moving)
    few = snapshot.between_days(spark, path, "2025-02-02 00:00:00", "2025-02-03 00:00:00")
    assert few.count() == 3
    assert "PartitionFilters: [isnotnull(day" in few._jdf.queryExecution().toString()


def test_upgrade_flags(spark):
    old = fixed(spark, [("a", 1, 2)]).drop("pointing").withColumn("monitored", F.lit(None).cast("boolean"))
    assert rows(snapshot.upgrade_flags(old), "monitored", "pointing") == [(False, False)]
    set_ = spark.createDataFrame([("a", True)], "source_id string, Monitored boolean")
    assert rows(snapshot.upgrade_flags(set_), "monitored", "pointing") == [(True, False)]


def test_files_with_other_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ra,dec,"name",monitored\n1,2,"x,y",true\n')
    (tmp_path / "b.csv").write_text("dec, ra,monitored,name\n4,3,false,z\n")
    got = catalogs.read_text_catalog(spark, str(tmp_path))
    assert rows(got, "ra", "dec", "name", "monitored") == [(1.0, 2.0, "x,y", "true"), (3.0, 4.0, "z", "false")]


def test_downsample_in_slices(spark):
    from skytables.operators.numbering import number_rows

    lines = Views(spark, DATA).jpl_rows
    small = number_rows(lines, ["designation"], ["row_idx"], "rn", 50).where("(rn - 1) % 7 = 0").drop("rn")
    assert rows(small) == rows(jpl.downsample(lines, "designation", 7, ["row_idx"]))


def test_summary(spark):
    done = jpl.ingest_jpl(Views(spark, DATA).jpl_rows, order=["row_idx"])
    assert rows(catalogs.ingest_summary(done.ssos, done.points, "f")) == [("f", 15, 1000)]


def test_mpc_layout_by_file(spark, tmp_path):
    """Each file by its own header; faulty lines are rejected; sexagesimal output."""
    head = "x<pre>Date R.A.{0}\n" + "            h m s".ljust(73) + "{1}\n"
    line = "2024 01 05 123000".ljust(18) + "01 02 03.5 -00 30 15 ".ljust(51) + "17.5"
    line = line.ljust(73) + "120.0".ljust(9) + "-60.0"
    for name, more, motion in (("total", "", '"/hr  P.A.'), ("sky", "", "RA cosD  Dec"), ("coord", " Uncertainty", "RA  Dec")):
        body = line + ("".ljust(92 - len(line)) + "9.5".ljust(9) + "45.0" if more else "")
        (tmp_path / f"{name}.txt").write_text(head.format(more, motion) + body + "\nno data here\n</pre>")
    done = mpc.ingest_mpc_files(spark, str(tmp_path), ra_format={"unit": "hourangle", "sep": ":"}, dec_format={"precision": 0})
    got = {r.motion: r for r in done.rows.collect()}
    assert (got["total"].proper_motion_arcmin_h, got["total"].direction_deg, got["total"].ddec_arcmin_h) == (2.0, -60.0, None)
    assert (got["sky"].dra_cosdec_arcmin_h, got["sky"].ddec_arcmin_h, got["sky"].dra_arcmin_h) == (2.0, -1.0, None)
    assert (got["coord"].dra_arcmin_h, got["coord"].uncertainty_3sig_arcsec, got["coord"].uncertainty_pa_deg) == (2.0, 9.5, 45.0)
    assert (got["sky"].ra_sexagesimal, got["sky"].dec_sexagesimal, got["sky"].uncertainty_3sig_arcsec) == ("1:02:03.5", "-0d30m15s", None)
    assert [r.reason for r in done.rejected.collect()] == ["no time"] * 3 and done.rejected.first().line == "no data here"
    assert mpc.ingest_mpc_files(spark, str(tmp_path), motion="sky").rows.where("motion <> 'sky'").count() == 0
    with pytest.raises(ValueError):
        mpc.ingest_mpc_files(spark, str(tmp_path), motion="none")


def test_one_object_per_name(spark):
    rows_ = [("1 Ceres", 2460310.5, 1.0, 2.0), ("2 Ceres", 2460311.5, 1.0, 2.0), ("Vesta", 2460310.5, 1.0, 2.0), ("4 Vesta", 2460310.5, 1.0, 2.0),
             ("3 Juno", 2460310.5, 1.0, 2.0), ("3 Juno", 2460311.5, 1.0, 2.0), ("", 2460310.5, 0.0, 0.0)]
    table = spark.createDataFrame([(*r, i) for i, r in enumerate(rows_)], "designation string, julian_day double, ra_deg double, dec_deg double, at int")
    done = jpl.ingest_jpl(table, order=["at"])
    assert [(r.MPC_id, r.name) for r in done.ssos.collect() if r.name != "Vesta"] == [(3, "Juno")]
    assert {r.name for r in done.points.collect()} <= {"Juno", "Vesta"} and done.points.where("name = 'Juno'").count() == 2
    reasons = sorted((r.name or "", r.reason) for r in done.rejected.collect())
    assert ("Ceres", "name with several MPC ids") in reasons and ("", "no designation") in reasons and len(reasons) + done.points.count() == 7


def test_generations_touch_only_their_days(spark, tmp_path):
    folder = str(tmp_path / "g")
    moving = points(spark, track("a", T0, hours(6), [(i, i / 4, 1.0) for i in range(40)]), track("b", T0, hours(24), [(200 + i, -i, None) for i in range(10)]))
    generations.write_points(moving, folder)
    assert rows(generations.read_points(spark, folder)) == rows(moving)
    some = generations.read_points(spark, folder, T0 + hours(30), T0 + hours(49))
    assert len({f.split("day=")[1][:10] for f in some.inputFiles()}) == 2
    assert rows(some) == rows(moving.where("time between '2025-02-02 06:00:00' and '2025-02-03 01:00:00'"))
    boxed = generations.read_points(spark, folder, box=Box(200, 210, -9, -8.5))
    assert rows(boxed, "ra_deg") == [(209.0,)] and len({f.split("day=")[1][:10] for f in boxed.inputFiles()}) == 1
    before = {r.day: r.folder for r in generations.manifest(spark, folder).collect()}
    changed = spark.createDataFrame([("a-5", None, 77.0), ("a-6", T0 + hours(100.5), None), ("none", None, 1.0)], "ephem_id string, time timestamp_ntz, ra_deg double")
    done = generations.update_points(spark, folder, changed)
    assert rows(done.missing, "ephem_id") == [("none",)]
    after = {r.day: r.folder for r in generations.manifest(spark, folder).collect()}
    assert {str(d) for d in after if after[d] != before[d]} == {"2025-02-02", "2025-02-05"} and len(after) == len(before)
    got = {r.ephem_id: r for r in generations.read_points(spark, folder).collect()}
    assert len(got) == 50 and got["a-5"].ra_deg == 77.0 and got["a-6"].time == T0 + hours(100.5)
    generations.delete_objects(spark, folder, spark.createDataFrame([("b",)], "sso_id string"))
    owner = ssos(spark, [("a",), ("b",)])
    new = spark.createDataFrame([("b", T0 + hours(2000), 1.0, 1.0)], "sso_id string, time timestamp_ntz, ra_deg double, dec_deg double")
    assert generations.insert_points(spark, folder, owner, new).added.count() == 1
    assert generations.read_points(spark, folder).groupBy("sso_id").count().orderBy("sso_id").collect() == [("a", 40), ("b", 1)]
    assert rows(generations.read_points(spark, folder, generation=1)) == rows(moving)
    generations.delete_points(spark, folder, moving.select("ephem_id").union(generations.read_points(spark, folder).select("ephem_id")))
    assert generations.read_points(spark, folder).count() == 0 == generations.manifest(spark, folder).count()


def test_fits_files_are_bounded_and_ranges_few(spark, tmp_path):
    """A partition of many rows becomes several files (F11); many bytes are not cut into small ranges (F10)."""
    from skytables.plans.fits_files import write_parts

    df = spark.range(0, 30_000, 1, 1).select((F.col("id") / 2).alias("x"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    folder = write_parts(df, file_rows=7_000)
    files = fits._files(folder)[1]
    assert len(files) > 1 and max(f.size for f in files) < 600_000
    read = fits.read_fits(spark, folder, split_bytes=100)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, df.collect()))
    assert len(fits.FitsReader(folder, 1, 100, read.schema).partitions()) <= fits.RANGES + 2 * len(files)


def test_texts_are_files_in_few_folders(spark):
    """A file per row, but no folder per file (F7, F8)."""
    from pathlib import Path

    from skytables.plans import text_files

    df = spark.range(300).select(F.concat(F.lit("user_id="), F.col("id"), F.lit(".txt")).alias("file"), F.concat(F.lit("a\nü "), F.col("id")).alias("value"))
    folder = Path(text_files.write_texts(df, "texts"))
    assert {p.name: p.read_text("utf-8") for p in folder.rglob("*.txt")} == {r.file: f"{r.value}\n" for r in df.collect()}
    assert len(list(folder.iterdir())) <= text_files.FOLDERS
