"""Wind at each point: tiles, four-dimensional interpolation of a gridded cube, masks, fills and air speed."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.functions.columns import number, pressure, tile_name, wrap


def plausible(rows: DataFrame, u: str = "wind_u", v: str = "wind_v", most: float = 200.0) -> DataFrame:
    """Interpolated wind as null where either part is over the limit or missing."""
    bad = F.isnan(u) | F.isnan(v) | (F.abs(u) > most) | (F.abs(v) > most)
    return rows.withColumns({c: F.when(~bad, F.col(c)) for c in (u, v)})


def tiled(rows: DataFrame, seconds: str = "t", size: int = 20) -> DataFrame:
    """Adds grid_id and date (UTC): the tile and day whose weather file holds a row."""
    day = F.date_from_unix_date(F.floor(F.col(seconds) / 86400).cast("int"))
    return rows.withColumn("grid_id", tile_name(F.col("latitude"), F.col("longitude"), size)).withColumn("date", F.date_format(day, "yyyy-MM-dd"))


def on_tiles(points: DataFrame, files: DataFrame) -> DataFrame:
    """Points by (grid_id, date) with the files there are: has_tile tells whether there is one."""
    have = files.select("grid_id", "date").distinct().withColumn("has_tile", F.lit(True))
    return points.join(have, ["grid_id", "date"], "left").withColumn("has_tile", F.coalesce("has_tile", F.lit(False)))


def pruned(cube: DataFrame, points: DataFrame) -> DataFrame:
    """The part of a cube with (grid_id, date) that some point needs; partitions of other tiles and days aren't read."""
    return cube.join(points.select("grid_id", "date").distinct(), ["grid_id", "date"], "left_semi")


def gridded(weather: DataFrame, step: float = 0.25) -> DataFrame:
    """hour_no, pressure_level, lat_q, lon_q, u, v from (valid_time, pressure_level, latitude, longitude, u, v).

    Axes may come in any order and longitudes in 0 to 360; the meridian of -180 is given at +180 too, so points
    at the seam have both neighbours. Of a grid point that several tiles hold one row stays.
    """
    lon_q = F.rint(wrap(F.col("longitude")) / step).cast("long")
    rows = weather.select(
        F.floor(F.unix_seconds(F.col("valid_time").cast("timestamp")) / 3600).alias("hour_no"), F.col("pressure_level").cast("int").alias("pressure_level"),
        F.rint(F.col("latitude") / step).cast("long").alias("lat_q"), lon_q.alias("lon_q"), number(F.col("u")).alias("u"), number(F.col("v")).alias("v"),
    )
    half = round(180 / step)
    rows = rows.withColumn("lon_q", F.explode(F.when(F.col("lon_q") == -half, F.array(F.lit(-half), F.lit(half)).cast("array<bigint>")).otherwise(F.array("lon_q"))))
    return rows.groupBy("hour_no", "pressure_level", "lat_q", "lon_q").agg(F.max("u").alias("u"), F.max("v").alias("v"))


def _packed(cube: DataFrame, levels: list[int]) -> DataFrame:
    """hour_no, lat_q, lon_q and the winds of all levels as arrays in their order."""
    at = lambda c, p: F.max(F.when(F.col("pressure_level") == p, F.col(c)))
    columns = {c: F.array(*(at(c, p) for p in levels)) for c in ("u", "v")}
    return cube.groupBy("hour_no", "lat_q", "lon_q").agg(F.struct(*(x.alias(c) for c, x in columns.items())).alias("winds"))


def interpolate_cube(points: DataFrame, cube: DataFrame, levels: list[int] | None = None, step: float = 0.25, hour: float = 3600.0, day_bounded: bool = False) -> DataFrame:
    """Adds wind_u and wind_v to points (t in s, latitude, longitude, altitude_m).

    cube: (hour_no, pressure_level, lat_q, lon_q, u, v) on integer keys: t / hour, hPa, degrees / step. The eight
    columns of air around each cell that holds a point are joined once by cell; points then meet their cell by
    equality and weigh 16 corners in place. Corners of weight 0 are not needed, all others must exist. With
    day_bounded the corners of the next day count as missing.
    """
    levels = sorted(levels or [r[0] for r in cube.select("pressure_level").distinct().collect()])  # the levels of the grid
    axes = {"hour_no": F.col("t") / hour, "lat_q": F.col("latitude") / step, "lon_q": F.col("longitude") / step}
    keys = list(axes)
    based = points.withColumns({f"_{k}": F.floor(x) for k, x in axes.items()})
    cells = based.select(*(F.col(f"_{k}") for k in keys)).distinct()
    offsets = list(product((0, 1), repeat=3))
    moved = F.array(*(F.struct(F.lit(i).alias("corner"), *((F.col(f"_{k}") + d).alias(k) for k, d in zip(keys, ds))) for i, ds in enumerate(offsets)))
    corners = cells.select("*", F.explode(moved).alias("c")).select(*(f"_{k}" for k in keys), "c.*")
    met = corners.join(_packed(cube, levels), keys)
    around = met.groupBy(*(f"_{k}" for k in keys)).agg(*(F.first(F.when(F.col("corner") == i, F.col("winds")), True).alias(f"_c{i}") for i in range(8)))
    joined = based.join(around, [f"_{k}" for k in keys], "left").withColumn("_p", pressure(F.col("altitude_m")))
    known = F.array(*map(F.lit, levels))
    low = F.array_max(F.filter(known, lambda p: p <= F.col("_p")))
    high = F.array_min(F.filter(known, lambda p: p >= F.col("_p")))
    joined = joined.withColumn("_lo", low).withColumn("_hi", high)
    # Below or above all levels this weight is null, so the point has no wind.
    above = F.when(F.col("_hi") > F.col("_lo"), (F.col("_p") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).when(F.col("_hi") == F.col("_lo"), 0.0)
    joined = joined.withColumn("_above", above).withColumns({f"_w{k}": axes[k] - F.col(f"_{k}") for k in keys})
    bounded = F.lit(day_bounded) & (F.floor((F.col("_hour_no") + 1) / 24) != F.floor(F.col("_hour_no") / 24))

    def wind(part: str) -> Column:
        total = None
        for i, ds in enumerate(offsets):
            for level, share in (("_lo", 1.0 - F.col("_above")), ("_hi", F.col("_above"))):
                weight = share
                for k, d in zip(keys, ds):
                    weight = weight * (F.col(f"_w{k}") if d else 1.0 - F.col(f"_w{k}"))
                value = F.get(F.col(f"_c{i}")[part], F.array_position(known, F.col(level)).cast("int") - 1)
                value = F.when(~bounded, value) if ds[0] else value
                term = F.when(weight == 0, F.lit(0.0)).otherwise(weight * value)
                total = term if total is None else total + term
        return total

    made = joined.withColumn("wind_u", wind("u")).withColumn("wind_v", wind("v"))
    both = F.col("wind_u").isNotNull() & F.col("wind_v").isNotNull()
    return made.select(*(c for c in points.columns), *(F.when(both, F.col(c)).alias(c) for c in ("wind_u", "wind_v")))


def air_vector(samples: DataFrame) -> DataFrame:
    """as_u and as_v: ground vector less wind."""
    return samples.withColumn("as_u", F.col("gs_ve") - F.col("wind_u")).withColumn("as_v", F.col("gs_vn") - F.col("wind_v"))


def match_report(samples: DataFrame, group: str = "aircraft_type", total: str = "TOTAL") -> DataFrame:
    """rows, matched, ratio of points with wind by group, and a row of all points under the name total."""
    made = samples.rollup(group).agg(F.count("*").alias("rows"), F.count("wind_u").alias("matched"), F.grouping(group).alias("_all"))
    named = made.withColumn(group, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(group))).drop("_all")
    return named.withColumn("ratio", F.try_divide("matched", "rows"))
