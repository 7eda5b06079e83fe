"""Preparation of model input: moments, split, normalisation, one-hot codes and sequences."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The model's inputs in their order, and the types of its one-hot code.
FEATURES = ("gs_ve", "gs_vn", "as_u", "as_v", "altitude", "vertical_rate", "longitude", "latitude", "gs_vn_dt", "gs_ve_dt", "vertical_rate_dt", "specific_energy", "energy_rate")

TYPES = ("A20N", "A21N", "A306", "A318", "A319", "A320", "A321", "A332", "A333", "A359", "A388", "B38M", "B39M", "B737", "B738", "B739", "B744", "B748", "B752", "B763", "B772", "B77L", "B77W", "B788", "B789", "MD11")


def complete(rows: DataFrame, columns: list[str], key: list[str], least: int = 10) -> DataFrame:
    """Rows without a null, of groups that keep at least so many."""
    kept = rows.dropna(subset=list(columns))
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where(F.col("_n") >= least).drop("_n")


def covered(stats: DataFrame, least: float = 0.2) -> DataFrame:
    return stats.where(F.col("coverage_ratio") >= least)


def moments(rows: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """column, mean, std, n: population moments in one pass; the variance is at least ``floor``."""
    made = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in columns), *(F.sqrt(F.greatest(F.var_pop(c), F.lit(floor))).alias(f"s_{c}") for c in columns))
    return made.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std"), F.col("n")) for c in columns))).alias("x")).select("x.*")


def z(c: Column, mean: float, std: float) -> Column:
    return (c - mean) / std


def as_dict(fitted: DataFrame) -> dict[str, tuple[float, float]]:
    """mean and std by column of moments(), a row for each column."""
    return {r["column"]: (r["mean"], r["std"]) for r in fitted.collect()}


def normalised(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """z-scores by moments(); the moments are a row for each column."""
    found = as_dict(fitted)
    return rows.withColumns({c: z(F.col(c), *ms) for c, ms in found.items()})


def one_hot(c: Column, vocabulary: list[str]) -> Column:
    """Array of 0 and 1 over the sorted vocabulary; unknown values give zeros."""
    return F.transform(F.array(*map(F.lit, sorted(vocabulary))), lambda v: F.coalesce((v == c).cast("float"), F.lit(0.0).cast("float")))


def model_input(fitted: dict[str, tuple[float, float]], coverage: Column, kind: Column, features: tuple[str, ...] = FEATURES, vocabulary: tuple[str, ...] = TYPES) -> Column:
    """The input of a step: z-scores of the features and of dt, the coverage (null: 1), the one-hot type; 41 wide.

    fitted: mean and standard deviation of each feature and of dt.
    """
    scores = (z(F.col(c), *fitted[c]) for c in (*features, "dt"))
    return F.concat(F.array(*scores, F.coalesce(coverage, F.lit(1.0)).cast("double")), one_hot(kind, list(vocabulary)).cast("array<double>"))


def of_split(rows: DataFrame, assigned: DataFrame, key: list[str], train: bool = True) -> DataFrame:
    """The rows whose key the split puts on one side; assigned: key and is_train."""
    return rows.join(assigned.where(F.col("is_train") == train).select(*key), key, "left_semi")


def split(ids: DataFrame, group: str, name: str, val_ratio: float = 0.2, seed: int = 42, exact: bool = False) -> DataFrame:
    """Adds is_train: the first int(n * (1 - val_ratio)) of each group in a seeded order.

    The order is that of a hash; with exact it is Python's shuffle of the sorted ids of a group, which a
    single task then holds.
    """
    if exact:

        def shuffled(frame: pd.DataFrame) -> pd.DataFrame:
            order = sorted(frame[name])
            random.Random(seed).shuffle(order)
            chosen = set(order[: int(len(order) * (1 - val_ratio))])
            return frame.assign(is_train=frame[name].isin(chosen))

        schema = ids.schema.simpleString()[7:-1].replace(":", " ")
        return ids.groupBy(group).applyInPandas(shuffled, f"{schema}, is_train boolean")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(name).cast("string")).cast("binary"))
    n = F.count("*").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order, name))
    return ids.withColumn("is_train", place <= F.floor(n * (1 - val_ratio)))


def sequences(rows: DataFrame, key: list[str], order: str, vector: Column) -> DataFrame:
    """key, steps, sequence: the vectors of a group in order, as an array of arrays."""
    listed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), vector.alias("x")))).alias("s"))
    return listed.select(*key, F.size("s").alias("steps"), F.transform("s", lambda r: r["x"]).alias("sequence"))


def label_sum(rows: DataFrame, key: list[str], rate: str = "fuel_rate_warm", dt: str = "dt") -> DataFrame:
    return rows.groupBy(*key).agg(F.sum(F.col(rate) * F.col(dt)).alias("label"))


def shuffled(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Rows in random order, for training only."""
    return rows.orderBy(F.rand(seed))
