"""Small literal tables for the tests."""

from datetime import datetime, timedelta

T0 = datetime(2025, 2, 1)
FIXED = "source_id string, ra_deg double, dec_deg double, flux_mJy double, name string, monitored boolean, pointing boolean"
SSO = "sso_id string, MPC_id bigint, name string, monitored boolean, pointing boolean"
POINT = ("ephem_id string, sso_id string, MPC_id bigint, name string, time timestamp_ntz, ra_deg double, "
         "dec_deg double, flux_mJy double")


def fixed(spark, rows):
    """rows of (id, ra, dec[, flux[, monitored[, pointing]]])"""
    full = []
    for r in rows:
        flux, mon, poi = (list(r[3:]) + [None, False, False][len(r) - 3:])[:3] if len(r) < 6 else r[3:6]
        full.append((r[0], float(r[1]), float(r[2]), flux, f"name-{r[0]}", mon, poi))
    return spark.createDataFrame(full, FIXED)


def ssos(spark, rows):
    """rows of (id[, monitored[, pointing]])"""
    return spark.createDataFrame(
        [(r[0], i + 1, f"name-{r[0]}", r[1] if len(r) > 1 else False, r[2] if len(r) > 2 else False)
         for i, r in enumerate(rows)], SSO)


def track(sso_id, start, step, values):
    """Points of an object at start, start+step, ... with (ra, dec, flux) values."""
    return [(f"{sso_id}-{i}", sso_id, None, f"name-{sso_id}", start + step * i, float(a), float(b),
             None if c is None else float(c)) for i, (a, b, c) in enumerate(values)]


def points(spark, *tracks):
    return spark.createDataFrame([p for t in tracks for p in t], POINT)


def hours(n):
    return timedelta(hours=n)


def seconds(n):
    return timedelta(seconds=n)


def rows(df, *columns):
    """Sorted tuples of the chosen columns."""
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
