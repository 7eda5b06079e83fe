"""Cutting tracks by labelled intervals: range join, kinematics and statistics of each interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.functions.columns import enu, feet_to_m, round_even
def lookup(intervals: DataFrame, dimension: DataFrame, key: str, value: str, default: str = "UNKNOWN") -> DataFrame:
    """Adds value by key; of repeated keys the greatest value counts; missing, null and empty give the default."""
    once = dimension.groupBy(key).agg(F.max(value).alias(value))
    return intervals.join(once, key, "left").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), F.lit(default)))


def labelled(intervals: DataFrame, label: str = "fuel_kg", with_label: bool = True) -> DataFrame:
    """Training leaves out labels of 0 and less; null labels stay."""
    return intervals.where(F.col(label).isNull() | (F.col(label) > 0)) if with_label else intervals


def join_points(points: DataFrame, intervals: DataFrame, key: str = "flight_id", bin_size: float = 3600.0) -> DataFrame:
    """Each point with every interval of its key that holds it: start <= t < end.

    Both sides meet on (key, bin of time), so a point is compared only with the intervals of its bin and a long
    key is dealt over many tasks; Spark broadcasts the intervals where they are small. bin_size: about the length of an
    interval in s.
    """
    inside = (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))
    low, high = F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size)
    binned = intervals.where("end > start").withColumn("_bin", F.explode(F.sequence(low, high)))
    return points.withColumn("_bin", F.floor(F.col("t") / bin_size)).join(binned, [key, "_bin"]).where(inside).drop("_bin")


def kinematics(cut: DataFrame, key: list[str], digits: bool = True) -> DataFrame:
    """Pairs each point with the next of its interval; the last has none and goes.

    dt in s (1e-3 at least), gs_ve, gs_vn and vertical_rate in m/s from the unrounded dt; altitude in ft.
    """
    w = Window.partitionBy(*key).orderBy("t")
    step = cut
    for c in ("t", "latitude", "longitude", "altitude"):
        step = step.withColumn(f"_{c}", F.lead(c).over(w))
    step = step.where(F.col("_t").isNotNull())
    dt = F.greatest(F.lit(1e-3), F.col("_t") - F.col("t"))
    e, n, _ = enu(F.col("_latitude"), F.col("_longitude"), feet_to_m(F.col("_altitude")), F.col("latitude"), F.col("longitude"), feet_to_m(F.col("altitude")))
    up = (feet_to_m(F.col("_altitude")) - feet_to_m(F.col("altitude"))) / dt
    out = step.withColumn("gs_ve", e / dt).withColumn("gs_vn", n / dt)
    out = out.withColumn("vertical_rate", round_even(up, 1) if digits else up).withColumn("dt", round_even(dt, 2) if digits else dt)
    return out.drop("_t", "_latitude", "_longitude", "_altitude")


def crossing() -> Column:
    return F.max("longitude") - F.min("longitude") > 180


def stats(cut: DataFrame, key: list[str], extra: list[str] = ()) -> DataFrame:
    """One row per interval of at least two points: bounds, coverage, date-line box, sample count."""
    w = Window.partitionBy(*key).orderBy("t")
    cut = cut.withColumn("_last", F.lead("t").over(w).isNull())
    inner = lambda c: F.when(~F.col("_last"), F.col(c))
    bounds = [f(c).alias(f"{n}_{c}") for c in ("latitude", "longitude", "altitude") for f, n in ((F.min, "min"), (F.max, "max"))]
    east, west = F.when(F.col("longitude") >= 0, inner("longitude")), F.when(F.col("longitude") < 0, inner("longitude"))
    made = cut.groupBy(*key).agg(
        *bounds,
        (F.max(inner("longitude")) - F.min(inner("longitude")) > 180).alias("is_cross_idl"),
        F.min(east).alias("_e0"), F.max(east).alias("_e1"), F.min(west).alias("_w0"), F.max(west).alias("_w1"),
        (F.max("t") - F.min("t")).alias("covered_time"),
        (F.max("end") - F.max("start")).alias("total_time"),
        (F.count("*") - 1).alias("sample_count"),
        *(F.max(c).alias(c) for c in extra),
    ).where("sample_count >= 1")
    for name, c in (("lon_min_east", "_e0"), ("lon_max_east", "_e1"), ("lon_min_west", "_w0"), ("lon_max_west", "_w1")):
        made = made.withColumn(name, F.when(F.col("is_cross_idl"), F.col(c)))
    ratio = F.when(F.col("total_time") > 0, F.col("covered_time") / F.col("total_time")).otherwise(0.0)
    return made.drop("_e0", "_e1", "_w0", "_w1").withColumn("coverage_ratio", ratio)


def segments(samples: DataFrame, key: list[str]) -> DataFrame:
    """start and end of what the samples of kinematics() cover: the first one's time, and the last one's plus its dt."""
    return samples.groupBy(*key).agg(F.min("t").alias("start"), (F.max("t") + F.max_by("dt", "t")).alias("end"))


def fuel_rate(fuel: Column, total_time: Column) -> Column:
    return F.when(total_time > 1e-9, round_even(fuel / total_time, 4)).otherwise(0.0)


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "interval_id") -> DataFrame:
    """Dense number from 0 within a group. Keys of an interval are (group, number)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
