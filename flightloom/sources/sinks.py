"""Sinks: Parquet by type or flight, JSON jobs and moments, CSV reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = {"us": "long", "latitude": "double", "longitude": "double", "altitude": "double", "groundspeed": "double", "track": "double", "vertical_rate": "double", "dt": "double", "gs_vn": "double", "gs_ve": "double", "interval_id": "long", "fuel_rate_warm": "double", "flight_id": "string", "aircraft_type": "string"}


def enforced(frame: DataFrame, schema: dict[str, str] = SAMPLES) -> DataFrame:
    """The schema's columns in order and type; missing ones are null."""
    return frame.select(*((F.col(c) if c in frame.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()))


def samples(frame: DataFrame, path: str, schema: dict[str, str] = SAMPLES, files: int = 200) -> None:
    """aircraft_type=.../ in zstd; a type's rows are spread over files by their interval."""
    spread = enforced(frame, schema).repartition(files, "aircraft_type", "interval_id").sortWithinPartitions("aircraft_type", "interval_id", "us")
    spread.write.partitionBy("aircraft_type").option("compression", "zstd").parquet(path)


def stats(frame: DataFrame, path: str, group: str = "aircraft_type") -> None:
    frame.write.partitionBy(group).option("compression", "zstd").parquet(path)


def tracks(frame: DataFrame, path: str, files: int = 200) -> None:
    """Flights stay whole in a file, many flights to a file."""
    frame.repartition(files, "flight_id").sortWithinPartitions("flight_id", "us").write.option("compression", "zstd").parquet(path)


def jobs(documents: DataFrame, path: str) -> None:
    documents.select("job").write.text(path)


def job_document(documents: DataFrame, size: int) -> str:
    """All jobs in one indented document, as a request file is read by a person; a row per tile and day."""
    found = [json.loads(r["job"]) for r in documents.orderBy("grid_id", "date").select("job").toLocalIterator()]
    return json.dumps({"metadata": {"total_jobs": len(found), "grid_size": size}, "era5_download_jobs": found}, indent=2)


def moments(frame: DataFrame, path: str) -> None:
    frame.coalesce(1).write.json(path)


def missing_report(frame: DataFrame, path: str, target: str = "fuel_kg") -> None:
    frame.where(F.col(target).isNull()).write.option("header", True).csv(path)


def submission(frame: DataFrame, path: str, target: str = "fuel_kg") -> None:
    frame.withColumn(target, F.coalesce(F.col(target).cast(T.DoubleType()), F.lit(0.0))).write.parquet(path)
