"""Kinematic features of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.functions.columns import round_even, scrub, specific_energy

RATES = {"gs_ve": "gs_ve_dt", "gs_vn": "gs_vn_dt", "vertical_rate": "vertical_rate_dt", "as_u": "as_u_dt", "as_v": "as_v_dt", "specific_energy": "energy_rate"}
#: Decimal places of the columns (fixed values).
DIGITS = {"gs_ve": 3, "gs_vn": 3, "as_u": 3, "as_v": 3, "groundspeed": 3, "airspeed": 3, "altitude": 1, "specific_energy": 1, "energy_rate": 3, "gs_ve_dt": 6, "gs_vn_dt": 6, "vertical_rate_dt": 6, "as_u_dt": 6, "as_v_dt": 6}


def forward_rate(rows: DataFrame, value: str, name: str, key: list[str], order: str = "t") -> DataFrame:
    """(next value - value) / dt within a group; dt of 0 gives null; the last row takes the rate before it, or 0."""
    w = Window.partitionBy(*key).orderBy(order)
    rate = F.try_divide(F.lead(value).over(w) - F.col(value), F.col("dt"))
    filled = F.last("_rate", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_rate", rate).withColumn(name, F.coalesce(filled, F.lit(0.0))).drop("_rate")


def rounded(rows: DataFrame, digits: dict[str, int] = DIGITS) -> DataFrame:
    return rows.withColumns({c: round_even(F.col(c), d) for c, d in digits.items() if c in rows.columns})


def build(samples: DataFrame, key: list[str] = ("aircraft_type", "interval_id"), order: str = "t") -> DataFrame:
    """Speeds, specific energy and rates of samples with gs_ve, gs_vn, as_u, as_v, altitude (m), vertical_rate, dt."""
    have = set(samples.columns)
    zero = F.lit(0.0)
    out = samples
    if {"gs_ve", "gs_vn"} <= have:
        out = out.withColumn("groundspeed", F.hypot("gs_ve", "gs_vn"))
    out = out.withColumn("airspeed", F.hypot("as_u", "as_v") if {"as_u", "as_v"} <= have else zero)
    out = out.withColumn("specific_energy", specific_energy(F.col("altitude"), F.col("airspeed")) if "altitude" in have else zero)
    for value, name in RATES.items():
        if value in out.columns:
            out = forward_rate(out, value, name, list(key), order)
    out = out.withColumns({c: scrub(F.col(c)) for c in DIGITS if c in out.columns})
    return rounded(out)
