"""Scalar functions of the engine as Column expressions; all pass nulls on."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FOOT = 0.3048
KNOT = 1852.0 / 3600.0
GRAVITY = 9.80665
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
EARTH = 6356766.0
#: Standard pressure levels in hPa, from the ground up (fixed values).
LEVELS = (1000, 975, 950, 925, 900, 875, 850, 825, 800, 775, 750, 700, 650, 600, 550, 500, 450, 400, 350, 300, 250, 225, 200, 175, 150, 125, 100, 70, 50, 30, 20, 10, 7, 5, 3, 2, 1)
#: ICAO layers: geopotential base in m, temperature in K, lapse in K/m, pressure in hPa (fixed values).
ICAO = ((0.0, 288.15, -0.0065, 1013.25), (11000.0, 216.65, 0.0, 226.32064), (20000.0, 216.65, 0.001, 54.748887), (32000.0, 228.65, 0.0028, 8.6801869), (47000.0, 270.65, 0.0, 1.1090631), (51000.0, 270.65, -0.0028, 0.66938873), (71000.0, 214.65, -0.002, 0.039564205))


def number(c: Column) -> Column:
    """NaN as null; everything downstream treats missing as null."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def clamp(c: Column, lo: float, hi: float) -> Column:
    """c within [lo, hi]; null stays null."""
    return F.when(c < lo, F.lit(float(lo))).when(c > hi, F.lit(float(hi))).otherwise(c)


def wrap(c: Column) -> Column:
    """Longitude in [-180, 180)."""
    return c - F.floor((c + 180.0) / 360.0) * 360.0


def arc(left: Column, right: Column) -> Column:
    """Shortest way from left to right in (-180, 180]."""
    d = right - left
    return d - F.ceil((d - 180.0) / 360.0) * 360.0


def round_even(c: Column, digits: int) -> Column:
    """Half-even rounding of the scaled double."""
    return F.rint(c * float(10**digits)) / float(10**digits)


def feet_to_m(c: Column) -> Column:
    return c * FOOT


def pressure(alt_m: Column) -> Column:
    """hPa at a height in m: the one-layer power law, height held within 0 to 70 km."""
    return F.pow(1.0 - clamp(alt_m, 0.0, 70000.0) * 2.25577e-5, F.lit(5.25588)) * 1013.25


def pressure_icao(alt_m: Column) -> Column:
    """hPa at a geometric height in m by the layers of the ICAO standard atmosphere."""
    h = alt_m * EARTH / (alt_m + EARTH)
    out = None
    for base, temp, lapse, p in reversed(ICAO):
        if lapse:
            here = F.pow((h - base) * lapse / temp + 1.0, F.lit(-GRAVITY * 0.0289644 / (8.31432 * lapse))) * p
        else:
            here = F.exp((h - base) * (-GRAVITY * 0.0289644 / (8.31432 * temp))) * p
        out = here if out is None else F.when(h >= next_base, out).otherwise(here)
        next_base = base
    return out


def _ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    sin, cos = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = F.lit(WGS84_A) / F.sqrt(1.0 - sin * sin * WGS84_E2)
    return (n + h) * cos * F.cos(F.radians(lon)), (n + h) * cos * F.sin(F.radians(lon)), (n * (1 - WGS84_E2) + h) * sin


def enu(lat: Column, lon: Column, h: Column, lat0: Column, lon0: Column, h0: Column) -> tuple[Column, Column, Column]:
    """East, north, up in m of a point as seen from another (WGS84); safe over the date line."""
    x, y, z = (a - b for a, b in zip(_ecef(lat, lon, h), _ecef(lat0, lon0, h0)))
    sl, cl, sp, cp = F.sin(F.radians(lon0)), F.cos(F.radians(lon0)), F.sin(F.radians(lat0)), F.cos(F.radians(lat0))
    return y * cl - x * sl, z * cp - (x * cl + y * sl) * sp, z * sp + (x * cl + y * sl) * cp


def _base(c: Column, size: int, top: int) -> Column:
    low = (F.floor(c / float(size)) * size).cast("int")
    return F.when(low >= top, top - size).otherwise(low)


def cell(lat: Column, lon: Column, size: int = 20) -> tuple[Column, Column, Column, Column]:
    """South, west, north, east of the tile that holds a point; the highest tiles reach +90 and +180."""
    south = (F.floor(lat / float(size)) * size).cast("int")
    west = _base(lon, size, 180)
    return F.greatest(F.lit(-90), south), west, F.least(F.lit(90), south + size), F.least(F.lit(180), west + size)


def tile_name(lat: Column, lon: Column, size: int = 20) -> Column:
    south, west, north, east = cell(lat, lon, size)
    return F.format_string("N(%d)W(%d)S(%d)E(%d)", north, west, south, east)


def corner_name(south: Column, west: Column) -> Column:
    """South-west corner as in N20E100 or S40W80."""
    return F.concat(F.when(south >= 0, "N").otherwise("S"), F.abs(south).cast("string"), F.when(west >= 0, "E").otherwise("W"), F.abs(west).cast("string"))


def corner_of(lat: Column, lon: Column, size: int = 20) -> Column:
    return corner_name((F.floor(lat / float(size)) * size).cast("int"), _base(lon, size, 180))


def area_of(name: Column, size: int = 20) -> Column:
    """[north, west, south, east] of a corner name; null if it isn't one."""
    form = r"^([NS])(\d+)([EW])(\d+)$"
    part = lambda i: F.regexp_extract(name, form, i)
    south = part(2).try_cast("int") * F.when(part(1) == "N", 1).otherwise(-1)
    west = part(4).try_cast("int") * F.when(part(3) == "E", 1).otherwise(-1)
    return F.when(name.rlike(form), F.array(F.least(F.lit(90), south + size), F.greatest(F.lit(-180), west), F.greatest(F.lit(-90), south), F.least(F.lit(180), west + size)))


def cells_in(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column, size: int = 20) -> Column:
    """Array of (south, west) of the tiles that a box meets."""
    low = lambda c: (F.floor(c / float(size)) * size).cast("int")
    lats = F.filter(F.sequence(low(min_lat), low(max_lat), F.lit(size)), lambda s: (s >= -100) & (s < 90))
    lons = F.filter(F.sequence(low(min_lon), low(max_lon), F.lit(size)), lambda w: (w >= -180) & (w < 180))
    return F.flatten(F.transform(lats, lambda s: F.transform(lons, lambda w: F.struct(s.alias("south"), w.alias("west")))))


def padded(c: Column, by: float, limit: float) -> Column:
    """c moved by some degrees, not beyond the limit on that side."""
    return F.greatest(F.lit(-limit), c + by) if by < 0 else F.least(F.lit(limit), c + by)


def levels_between(p_min: Column, p_max: Column, parity: bool = False) -> Column:
    """Standard levels from the first at or above p_max down to the first at or below p_min.

    Outside the levels: the four of {1000, 500, 300, 200} with parity, else the nearest levels.
    """
    levels = F.array(*map(F.lit, LEVELS))
    lo, hi = (p_min, p_max) if parity else (clamp(p_min, min(LEVELS), max(LEVELS)), clamp(p_max, min(LEVELS), max(LEVELS)))
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)  # noqa: E731  value is worked out once

    def between(ends: Column) -> Column:
        found = F.filter(levels, lambda x: (x <= ends["top"]) & (x >= ends["bottom"]))
        return F.when(ends["top"].isNull() | ends["bottom"].isNull(), F.array(*map(F.lit, (1000, 500, 300, 200)))).otherwise(found)

    def ends_of(p: Column) -> Column:
        top = F.array_min(F.filter(levels, lambda x: x >= p["hi"]))
        bottom = F.array_max(F.filter(levels, lambda x: x <= p["lo"]))
        return once(F.struct(top.alias("top"), bottom.alias("bottom")), between)

    found = once(F.struct(lo.alias("lo"), hi.alias("hi")), ends_of)
    return F.when(p_min.isNotNull() & p_max.isNotNull(), found)


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def hour_ceil(ts: Column) -> Column:
    return F.date_trunc("hour", ts + F.expr("interval 1 hour") - F.expr("interval 1 microsecond"))


def hours_between(start: Column, end: Column) -> Column:
    """Every full hour from the floor of start to the ceiling of end."""
    return F.sequence(hour_floor(start), hour_ceil(end), F.expr("interval 1 hour"))


def specific_energy(alt_m: Column, speed: Column) -> Column:
    """Height plus kinetic height of an air speed, in m."""
    return alt_m + speed * speed / (2 * GRAVITY)


def scrub(c: Column) -> Column:
    """Infinite, NaN and null as 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == math.inf), F.lit(0.0)).otherwise(c)


def key_text(c: Column) -> Column:
    """Key as trimmed text without a trailing .0."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def upscaled(pred: Column, coverage: Column, least: float = 1e-3) -> Column:
    return F.when(coverage > least, pred / coverage).otherwise(pred)
