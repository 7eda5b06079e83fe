"""The feature pipeline from tracks to model input, as one composed plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.functions.columns import clamp, feet_to_m
from flightloom.operators import features, intervals, tracks, weather

KEY = ["aircraft_type", "interval_id"]


def samples(track: DataFrame, labels: DataFrame, flights: DataFrame, with_label: bool = True) -> tuple[DataFrame, DataFrame]:
    """(samples, interval statistics) of raw tracks; with_label False is for splits without fuel."""
    fixed = tracks.repair(track).withColumn("t", F.col("us") / 1e6)
    named = intervals.lookup(intervals.labelled(labels, with_label=with_label), flights, "flight_id", "aircraft_type")
    named = intervals.numbered(named, "aircraft_type", ["flight_id", "start", "idx"])
    cut = intervals.join_points(fixed, named)
    cut = tracks.thin(cut.withColumn("_key", F.concat_ws(":", *KEY)), "_key").drop("_key")
    stats = intervals.stats(cut, KEY, ["flight_id", "idx", "fuel_kg"])
    made = intervals.kinematics(cut, KEY)
    stats = stats.join(intervals.segments(made, KEY), KEY)
    if with_label:
        made = made.join(stats.select(*KEY, intervals.fuel_rate(F.col("fuel_kg"), F.col("total_time")).alias("fuel_rate_warm")), KEY)
    return made, stats


def features_of(made: DataFrame, cube: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Samples with wind, air speed and rate features; altitude becomes metres."""
    rows = made.withColumn("altitude", feet_to_m(F.col("altitude"))).withColumn("altitude_m", clamp(F.col("altitude"), 0, 1e9))
    rows = weather.plausible(weather.interpolate_cube(rows, cube, levels))
    rows = rows.withColumn("_key", F.concat_ws(":", *KEY))
    for wind in ("wind_u", "wind_v"):
        rows = tracks.fill_positional(rows, wind, "_key")
    rows = weather.air_vector(rows).drop("wind_u", "wind_v", "_key", "altitude_m")
    return features.build(rows, KEY)
