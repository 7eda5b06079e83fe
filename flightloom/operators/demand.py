"""Planner of weather demand: which tiles, hours and levels the intervals need, as download jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.functions.columns import LEVELS, cells_in, corner_name, levels_between, padded, pressure_icao


def boxes(stats: DataFrame, pad: float = 0.25) -> DataFrame:
    """One row per box of an interval; intervals over the date line have one on either side."""
    box = lambda w, e: F.struct(padded(F.col("min_latitude"), -pad, 90.0).alias("s"), padded(F.col("max_latitude"), pad, 90.0).alias("n"), padded(w, -pad, 180.0).alias("w"), padded(e, pad, 180.0).alias("e"))
    cross = F.coalesce(F.col("is_cross_idl"), F.lit(False)) if "is_cross_idl" in stats.columns else F.lit(False)
    if "lon_min_east" in stats.columns:
        sides = F.filter(F.array(box(F.col("lon_min_east"), F.col("lon_max_east")), box(F.col("lon_min_west"), F.col("lon_max_west"))), lambda b: b["w"].isNotNull() & b["e"].isNotNull())
        found = F.when(cross, sides).otherwise(F.array(box(F.col("min_longitude"), F.col("max_longitude"))))
    else:
        found = F.array(box(F.col("min_longitude"), F.col("max_longitude")))
    return stats.withColumn("box", F.explode(found))


HOUR_US = 3_600_000_000


def _ones(first, last):
    """Bits first to last of a long."""
    return F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), (last - first + 1).cast("int")) - 1, first.cast("int"))


def jobs(stats: DataFrame, size: int = 20, pad: float = 0.25, parity: bool = False) -> DataFrame:
    """grid_id, date, hours (ascending), levels (descending), area: one row per tile and day, in UTC.

    stats: bounds in degrees, min_altitude and max_altitude in m, start and end as timestamps. An interval gives a row
    for each tile and day with its hours and levels as bits of two longs, which are summed by bit_or before the
    shuffle; lists are made of the few rows that are left.
    """
    levels = levels_between(pressure_icao(F.col("max_altitude")), pressure_icao(F.col("min_altitude")), parity)
    known = F.array(*map(F.lit, LEVELS))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    mask = F.aggregate(levels, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(F.array_position(known, x) - 1)))
    first = F.floor(F.unix_micros("start") / HOUR_US)
    last = F.ceil(F.unix_micros("end") / HOUR_US)
    need = boxes(stats, pad).select("box", F.coalesce(mask, F.lit(0).cast("long")).alias("levels"), first.alias("first"), last.alias("last")).where("first <= last")
    need = need.withColumn("cell", F.explode(cells_in(F.col("box.s"), F.col("box.n"), F.col("box.w"), F.col("box.e"), size)))
    need = need.withColumn("day", F.explode(F.sequence(F.floor(F.col("first") / 24), F.floor(F.col("last") / 24))))
    hours = _ones(F.greatest(F.col("first") - F.col("day") * 24, F.lit(0)), F.least(F.col("last") - F.col("day") * 24, F.lit(23)))
    found = need.select("cell.south", "cell.west", "day", hours.alias("hours"), "levels")
    found = found.groupBy("south", "west", "day").agg(F.bit_or("hours").alias("hours"), F.bit_or("levels").alias("levels"))
    south, west = F.col("south"), F.col("west")
    area = F.array(F.least(F.lit(90), south + size), west, F.greatest(F.lit(-90), south), F.least(F.lit(180), west + size))
    hour_list = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.getbit(F.col("hours"), h) == 1)
    level_list = F.filter(F.transform(known, lambda x, i: F.when(F.getbit(F.col("levels"), i) == 1, x)), lambda x: x.isNotNull())
    named = found.withColumn("grid_id", corner_name(south, west)).withColumn("date", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd"))
    named = named.withColumn("area", area).where("area[0] > area[2] and area[3] > area[1]")
    return named.select("grid_id", "date", hour_list.alias("hours"), level_list.alias("levels"), "area")


# The data set, product, variables and formats of a request.
def documents(planned: DataFrame) -> DataFrame:
    """Each job as a JSON document."""
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    part = F.split("date", "-")
    body = F.struct(
        F.lit("reanalysis-era5-pressure-levels").alias("dataset"), F.array(F.lit("reanalysis")).alias("product_type"),
        F.array(*map(F.lit, ("u_component_of_wind", "v_component_of_wind"))).alias("variable"), text(F.col("levels")).alias("pressure_level"),
        F.array(part[0]).alias("year"), F.array(part[1]).alias("month"), F.array(part[2]).alias("day"),
        F.transform("hours", lambda h: F.format_string("%02d:00", h)).alias("time"), F.col("area"),
        F.lit("netcdf").alias("data_format"), F.lit("unarchived").alias("download_format"), F.struct("grid_id", "date").alias("metadata"),
    )
    return planned.select("grid_id", "date", F.to_json(body).alias("job"))
