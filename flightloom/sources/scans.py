"""Scans of the engine's inputs with explicit schemas, missing values and time normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightloom.functions.columns import number

TRACK = T.StructType([T.StructField(n, t) for n, t in (("timestamp", T.TimestampType()), ("latitude", T.DoubleType()), ("longitude", T.DoubleType()), ("altitude", T.DoubleType()), ("groundspeed", T.DoubleType()), ("track", T.DoubleType()), ("flight_id", T.StringType()), ("typecode", T.StringType()), ("source", T.StringType()))])
INTERVAL = T.StructType([T.StructField(n, t) for n, t in (("idx", T.LongType()), ("flight_id", T.StringType()), ("start", T.TimestampType()), ("end", T.TimestampType()), ("fuel_kg", T.DoubleType()))])


def utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def micros(frame: DataFrame, name: str) -> Column:
    """Epoch microseconds of a column of nanoseconds (BIGINT), time with or without zone, or text."""
    kind = dict(frame.dtypes)[name]
    if kind == "bigint":
        return F.floor(F.col(name) / 1000).cast("long")
    return F.unix_micros(F.to_timestamp(name) if kind == "string" else F.col(name).cast("timestamp"))


def tracks(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """All tracks of a folder: flight_id (the file's name where it is missing), us, values with NaN as null."""
    utc(spark).conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    frame = spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").option("pathGlobFilter", pattern).parquet(folder)
    frame = frame.withColumn("us", micros(frame, "timestamp")).drop("timestamp")
    for f in TRACK:
        if f.name not in frame.columns and f.name != "timestamp":
            frame = frame.withColumn(f.name, F.lit(None).cast(f.dataType))
    frame = frame.withColumn("flight_id", F.coalesce("flight_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "")))
    return frame.withColumns({f.name: number(F.col(f.name)) for f in TRACK if isinstance(f.dataType, T.DoubleType)})


def flight(spark: SparkSession, folder: str, flight_id: str) -> DataFrame:
    """One flight's track: a pruned scan, empty if there is none."""
    return tracks(spark, folder).where(F.col("flight_id") == flight_id)


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """idx, flight_id, start, end (s), fuel_kg (null where the file has none)."""
    frame = utc(spark).read.parquet(path)
    fuel = number(F.col("fuel_kg")) if "fuel_kg" in frame.columns else F.lit(None).cast("double")
    if "idx" not in frame.columns:
        raise ValueError("intervals need a column idx")
    return frame.select("idx", "flight_id", (micros(frame, "start") / 1e6).alias("start"), (micros(frame, "end") / 1e6).alias("end"), fuel.alias("fuel_kg"))


def dimension(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("flight_id", "aircraft_type")


def stats(spark: SparkSession, root: str) -> DataFrame:
    """interval_stats under a root, older files included: missing date-line columns are false and null."""
    frame = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(root)
    cross = F.coalesce("is_cross_idl", F.lit(False)) if "is_cross_idl" in frame.columns else F.lit(False)
    frame = frame.withColumn("is_cross_idl", cross)
    for c in ("lon_min_east", "lon_max_east", "lon_min_west", "lon_max_west"):
        frame = frame.withColumn(c, number(F.col(c)) if c in frame.columns else F.lit(None).cast("double"))
    return frame


def samples(spark: SparkSession, root: str, columns: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """Samples of the hive layout aircraft_type=..., only the columns and types asked for."""
    frame = spark.read.parquet(root)
    frame = frame.where(F.col("aircraft_type").isin(types)) if types else frame
    return frame.select(*columns) if columns else frame


def rows_of(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


def moments(spark: SparkSession, path: str) -> DataFrame:
    """Feature moments stored as JSON lines."""
    return spark.read.schema("column string, mean double, std double, n long").json(path)


def template(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The template and its key: idx, else interval_id, else the first column with id in its name."""
    frame = spark.read.parquet(path)
    named = [c for c in ("idx", "interval_id") if c in frame.columns] or [c for c in frame.columns if "id" in c.lower()]
    if not named:
        raise ValueError("the template has no id column")
    return frame, named[0]


def grid_rows(time, level, latitude, longitude, u, v):
    """One frame of a file's grid: its four axes, and u and v on them in that order; masked values are NaN."""
    import numpy as np
    import pandas as pd

    axes = {"valid_time": time, "pressure_level": level, "latitude": latitude, "longitude": longitude}
    at = np.meshgrid(*(np.arange(len(a)) for a in axes.values()), indexing="ij")
    columns = {n: np.asarray(a)[g.ravel()] for (n, a), g in zip(axes.items(), at)}
    return pd.DataFrame(columns | {n: np.ma.filled(np.ma.asarray(x, float), np.nan).ravel() for n, x in (("u", u), ("v", v))})


def cube_from_netcdf(paths: list[str], spark: SparkSession) -> DataFrame:
    """Weather files as rows (valid_time, pressure_level, latitude, longitude, u, v); needs netCDF4 where tasks run.

    weather.gridded() turns them into the cube that points are interpolated in.
    """
    schema = "valid_time timestamp, pressure_level int, latitude double, longitude double, u double, v double"

    def load(frames):
        import netCDF4  # an ingest edge: not needed by anything else

        for frame in frames:
            for path in frame["path"]:
                with netCDF4.Dataset(path) as data:
                    pick = lambda *names: next(data.variables[n] for n in names if n in data.variables)
                    time = pick("valid_time", "time")
                    moments = netCDF4.num2date(time[:], time.units, only_use_cftime_datetimes=False)
                    yield grid_rows(moments, pick("pressure_level", "level", "isobaricInhPa")[:], pick("latitude")[:], pick("longitude")[:], pick("u")[:], pick("v")[:])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInPandas(load, schema)
