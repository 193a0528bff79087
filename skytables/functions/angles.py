"""Angles: RA conventions, separations and sexagesimal text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def wrap_ra(ra: Column) -> Column:
    """RA into [0, 360)."""
    return F.pmod(ra, F.lit(360.0))


def signed_ra(ra: Column) -> Column:
    """RA in [0, 360) to (-180, 180]."""
    return F.when(ra > 180.0, ra - 360.0).otherwise(ra)


def flat_distance(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """sqrt(dRA^2 + dDec^2) in degrees: no cos(dec), no wrap."""
    return F.sqrt((ra1 - ra2) * (ra1 - ra2) + (dec1 - dec2) * (dec1 - dec2))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation in degrees (haversine, exact zero on equal positions)."""
    half_ra = F.sin(F.radians(ra1 - ra2) / 2.0)
    half_dec = F.sin(F.radians(dec1 - dec2) / 2.0)
    h = half_dec * half_dec + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half_ra * half_ra
    return F.degrees(F.asin(F.sqrt(F.least(F.lit(1.0), h)))) * 2.0


def _ticks(value: Column, per_unit: int) -> Column:
    """Round once to a whole number of the last printed digit, so 59.999 never prints as 60."""
    return F.floor(value * F.lit(float(per_unit)) + F.lit(0.5))


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b))


def _pad(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _fields(ticks: Column, digits: int) -> tuple[Column, Column, Column, Column]:
    """Whole ticks to (units, minutes, seconds, fraction) integers."""
    scale = 10**digits
    return (
        _div(ticks, 3600 * scale),
        _div(ticks, 60 * scale) % F.lit(60),
        _div(ticks, scale) % F.lit(60),
        ticks % F.lit(scale),
    )


def _seconds_text(sec: Column, frac: Column, digits: int) -> Column:
    whole = _pad(sec, 2)
    return whole if digits == 0 else F.concat(whole, F.lit("."), _pad(frac, digits))


def iau_name(ra: Column, dec: Column, ra_digits: int = 2, dec_digits: int = 1) -> Column:
    """`JHHMMSS.ss+DDMMSS.s` from degrees; digits after the point are parameters."""
    ra_ticks = _ticks(wrap_ra(ra) / F.lit(15.0), 3600 * 10**ra_digits) % F.lit(24 * 3600 * 10**ra_digits)
    h, hm, hs, hf = _fields(ra_ticks, ra_digits)
    d, dm, ds, df = _fields(_ticks(F.abs(dec), 3600 * 10**dec_digits), dec_digits)
    return F.concat(
        F.lit("J"), _pad(h, 2), _pad(hm, 2), _seconds_text(hs, hf, ra_digits),
        F.when(dec < 0, F.lit("-")).otherwise(F.lit("+")),
        _pad(d, 2), _pad(dm, 2), _seconds_text(ds, df, dec_digits),
    )


def deg_to_sexagesimal(
    deg: Column,
    unit: str = "deg",
    sep: str | None = None,
    precision: int = 1,
    always_sign: bool = False,
    pad: bool = False,
) -> Column:
    """Degrees to sexagesimal text. `sep=None` writes unit letters (`1d02m03.4s`)."""
    if unit not in ("deg", "hourangle"):
        raise ValueError(f"unit must be 'deg' or 'hourangle', not {unit!r}")
    value = deg / F.lit(15.0) if unit == "hourangle" else deg
    marks = (("d" if unit == "deg" else "h"), "m", "s") if sep is None else (sep, sep, "")
    u, m, s, f = _fields(_ticks(F.abs(value), 3600 * 10**precision), precision)
    units_text = u.cast("string")
    if pad:
        units_text = F.when(u < 10, F.concat(F.lit("0"), units_text)).otherwise(units_text)
    return F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("+" if always_sign else "")),
        units_text, F.lit(marks[0]), _pad(m, 2), F.lit(marks[1]),
        _seconds_text(s, f, precision), F.lit(marks[2]),
    )


def sexagesimal_to_deg(text: Column, hours: bool = False) -> Column:
    """Sexagesimal text to degrees. The sign is read from the text, so `-00 30 00` stays negative."""
    body = F.trim(text)
    parts = F.split(F.regexp_replace(body, "^[+-]\\s*", ""), "[^0-9.]+")
    unit, minute, second = (
        F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3)
    )
    size = unit + F.coalesce(minute, F.lit(0.0)) / 60.0 + F.coalesce(second, F.lit(0.0)) / 3600.0
    if hours:
        size = size * 15.0
    return F.when(F.startswith(body, F.lit("-")), -size).otherwise(size)
