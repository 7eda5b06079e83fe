"""Operators on irregular time series: one window key, one order, one shuffle.

All take a frame with a key column, ``t`` (seconds, double or long) or ``ts``, and the value columns named.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.functions.columns import arc, wrap


def by(key: str, order: str = "t") -> Window:
    return Window.partitionBy(key).orderBy(order)


def dedupe_near(track: DataFrame, key: str = "flight_id", least: float = 1e-6, tie: tuple[str, ...] = ()) -> DataFrame:
    """Drops rows at most ``least`` seconds after the row before them (kept or not)."""
    w = Window.partitionBy(key).orderBy("t", *tie)
    gap = F.col("t") - F.lag("t").over(w)
    return track.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > least)).drop("_gap")


def thin(track: DataFrame, key: str = "flight_id", least: float = 0.1) -> DataFrame:
    """Greedy thinning: keeps the first row and then each that is ``least`` after the last kept.

    Only keys that hold a gap under ``least`` go through Python; all others keep every row.
    """
    flagged = track.withColumn("_gap", F.col("t") - F.lag("t").over(by(key))).withColumn("_thin", F.coalesce(F.min("_gap").over(Window.partitionBy(key)) < least, F.lit(False)))
    plain = flagged.where(~F.col("_thin")).drop("_gap", "_thin")
    close = flagged.where("_thin").drop("_gap", "_thin")

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t", kind="stable")
        last, kept = None, []
        for t in frame["t"]:
            kept.append(last is None or t - last >= least)
            last = t if kept[-1] else last
        return frame[kept]

    return plain.unionByName(close.groupBy(key).applyInPandas(keep, close.schema))


def upsample(track: DataFrame, key: str = "flight_id", gap_us: int = 1_500_000, step_us: int = 1_000_000) -> DataFrame:
    """Adds rows (key and ``us`` only) every step in gaps over gap_us, strictly before the next row."""
    after = F.lead("us").over(by(key, "us"))
    gaps = track.select(key, "us", after.alias("_next")).where(F.col("_next") - F.col("us") > gap_us)
    # A gap's rows end strictly before its right end.
    made = gaps.select(key, F.explode(F.sequence(F.col("us") + step_us, F.greatest(F.col("us") + step_us, F.col("_next") - 1), F.lit(step_us))).alias("us"), "_next").where("us < _next")
    return track.withColumn("inserted", F.lit(False)).unionByName(made.drop("_next").withColumn("inserted", F.lit(True)), allowMissingColumns=True)


def _near(value: str, key: str, order: str, at: str) -> tuple[Column, Column]:
    """Last valid (at, value) up to here and first valid one from here on."""
    w = by(key, order)
    valid = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    return F.last(valid, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(valid, True).over(w.rowsBetween(0, Window.unboundedFollowing))


def interpolate(track: DataFrame, value: str, key: str = "flight_id", circular: bool = False) -> DataFrame:
    """Fills interior gaps by time, along the shortest arc if circular; edges stay null."""
    before, after = _near(value, key, "t", "t")
    out = track.withColumn("_l", before).withColumn("_r", after)
    share = (F.col("_r.t") - F.col("t")) / (F.col("_r.t") - F.col("_l.t"))
    if circular:
        made = wrap(F.col("_l.v") + arc(F.col("_l.v"), F.col("_r.v")) * (1.0 - share))
    else:
        made = share * F.col("_l.v") + (1.0 - share) * F.col("_r.v")
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), made)
    return out.withColumn(value, filled).drop("_l", "_r")


def fill_positional(track: DataFrame, value: str, key: str = "flight_id", order: str = "t") -> DataFrame:
    """Fills by position in the group: linear inside, nearest valid at the edges, 0 if nothing is valid."""
    ranked = track.withColumn("_n", F.row_number().over(by(key, order)))
    before, after = _near(value, key, order, "_n")
    out = ranked.withColumn("_l", before).withColumn("_r", after)
    made = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * ((F.col("_n") - F.col("_l.t")) / (F.col("_r.t") - F.col("_l.t")))
    return out.withColumn(value, F.coalesce(F.col(value), made, F.col("_l.v"), F.col("_r.v"), F.lit(0.0))).drop("_n", "_l", "_r")


def fill_text(track: DataFrame, value: str, key: str = "flight_id", order: str = "t") -> DataFrame:
    """Last value before, else first value after."""
    w = by(key, order)
    return track.withColumn(value, F.coalesce(F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))))


def unwrap(track: DataFrame, value: str, key: str = "flight_id") -> DataFrame:
    """Angles with their jumps over half a turn taken out; nulls are passed over."""
    w = by(key)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    turn = F.coalesce(F.ceil((F.col(value) - before - 180.0) / 360.0) * -360.0, F.lit(0.0))
    return track.withColumn("_turn", turn).withColumn(value, F.col(value) + F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def extrapolate(track: DataFrame, value: str, key: str = "flight_id", window: float = 10.0, trend_span: float = 10.0, const_span: float = 15.0, circular: bool = False) -> DataFrame:
    """Fills head and tail of an interpolated column by a weighted trend, then by a constant.

    Up to trend_span beyond the last (first) valid row: the line fitted to the valid rows within
    ``window`` of it, weighing exp(-(latest - t) / window); one valid row: its value. Up to const_span: the value
    of the farthest row filled by trend, else of the valid row. Beyond: null. Angles are unwrapped for the fit.
    All sums are windows over the key, which share one shuffle.
    """
    every = Window.partitionBy(key)
    out = track.withColumn("_v", F.col(value))
    out = unwrap(out, "_v", key) if circular else out
    valid = F.col("_v").isNotNull()
    out = out.withColumn("_head", F.min(F.when(valid, F.col("t"))).over(every)).withColumn("_tail", F.max(F.when(valid, F.col("t"))).over(every))
    made = F.col(value)
    names = ["_v"]
    for side, sign in (("_head", 1), ("_tail", -1)):
        k, within = F.col(side), valid & ((F.col("t") - F.col(side)) * sign <= window)
        beyond = (k - F.col("t")) * sign
        inside = F.when(F.col(value).isNull() & (beyond > 0) & (beyond <= trend_span), F.col("t"))
        far = F.min(inside) if sign > 0 else F.max(inside)
        first = {"lo": F.min(F.when(within, F.col("t"))), "latest": F.max(F.when(within, F.col("t"))), "vk": F.max(F.when(valid & (F.col("t") == k), F.col("_v"))), "far": far}
        out = out.withColumns({f"{side}_{n}": c.over(every) for n, c in first.items()})
        at = lambda n, side=side: F.col(f"{side}_{n}")
        w, x, v = F.exp((F.col("t") - at("latest")) / window), F.col("t") - at("lo"), F.col("_v")
        sums = {"n": F.lit(1), "s": w, "sx": w * x, "sxx": w * x * x, "sv": w * v, "sxv": w * x * v}
        out = out.withColumns({f"{side}_{n}": F.sum(F.when(within, c)).over(every) for n, c in sums.items()})
        slope = F.when(at("n") >= 2, (at("s") * at("sxv") - at("sx") * at("sv")) / F.nullif(at("s") * at("sxx") - at("sx") * at("sx"), F.lit(0.0)))
        out = out.withColumn(f"{side}_b", slope).withColumn(f"{side}_a", (at("sv") - F.col(f"{side}_b") * at("sx")) / at("s"))
        trend = lambda t, at=at: F.coalesce(at("a") + at("b") * (t - at("lo")), at("vk"))
        made = F.when(F.col(value).isNull() & (beyond > 0), F.when(beyond <= trend_span, trend(F.col("t"))).when(beyond <= const_span, trend(at("far")))).otherwise(made)
        names += [side, *(f"{side}_{n}" for n in (*first, *sums, "a", "b"))]
    return out.withColumn(value, wrap(made) if circular else made).drop(*names)


def repair(track: DataFrame, key: str = "flight_id") -> DataFrame:
    """The whole repair of tracks (key, us, latitude, longitude, altitude, ...): altitude in feet.

    Near duplicates go, gaps are upsampled, positions interpolated and extrapolated, texts filled, values
    held in their ranges and rounded; rows that still lack a position go.
    """
    from flightloom.functions.columns import clamp, number, round_even

    for c in ("latitude", "longitude", "altitude"):
        track = track.withColumn(c, number(F.col(c)))
    track = dedupe_near(track.withColumn("t", F.col("us") / 1e6), key)
    track = upsample(track.drop("t"), key).withColumn("t", F.col("us") / 1e6)
    for c in ("altitude", "latitude", "longitude"):
        track = extrapolate(interpolate(track, c, key, c == "longitude"), c, key, circular=c == "longitude")
    for c in ("typecode", "source"):
        if c in track.columns:
            track = fill_text(track, c, key)
    track = track.withColumn("altitude", round_even(clamp(F.col("altitude"), -2000, 70000), 4))
    track = track.withColumn("latitude", round_even(clamp(F.col("latitude"), -90, 90), 6)).withColumn("longitude", wrap(round_even(F.col("longitude"), 6)))
    return track.dropna(subset=["altitude", "latitude", "longitude"])
