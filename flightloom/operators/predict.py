"""Batch prediction: encoder in NumPy, upscaling by coverage, template update and reports."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.functions.columns import key_text, upscaled


def positions(steps: int, width: int) -> np.ndarray:
    """Sinusoidal position codes."""
    angle = np.arange(steps)[:, None] * np.exp(np.arange(0, width, 2) * (-math.log(10000.0) / width))
    out = np.zeros((steps, width))
    out[:, 0::2], out[:, 1::2] = np.sin(angle), np.cos(angle)[:, : width // 2]
    return out


def _norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * gain + bias


#: Error function and slope on a grid of 1/512 up to 6, beyond which it is 1 in double precision.
_GRID = np.arange(0, 6 + 2 / 512, 1 / 512)
_ERF = np.array([math.erf(x) for x in _GRID])
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-_GRID * _GRID) / 512


def erf(x: np.ndarray) -> np.ndarray:
    """Error function by cubic Hermite interpolation; within 1e-12."""
    size = np.minimum(np.abs(x), 6.0) * 512
    at = np.minimum(size.astype(np.int64), len(_GRID) - 2)
    s = size - at
    value = (1 + 2 * s) * (1 - s) ** 2 * _ERF[at] + s * (1 - s) ** 2 * _SLOPE[at] + s * s * (3 - 2 * s) * _ERF[at + 1] + s * s * (s - 1) * _SLOPE[at + 1]
    return np.copysign(value, x)


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def forward(weights: dict[str, np.ndarray], x: np.ndarray, heads: int = 4) -> np.ndarray:
    """Non-negative rate for each step of sequences of one length, x [..., steps, inputs].

    weights: in_w, in_b; per layer i: q{i}, k{i}, v{i}, o{i} with _w and _b, f{i}a, f{i}b, n{i}a, n{i}b; m0, m1, m2.
    """
    width, steps = weights["in_w"].shape[0], x.shape[-2]
    h = (x @ weights["in_w"].T + weights["in_b"]) * math.sqrt(width) + positions(steps, width)
    layer = 0
    while f"q{layer}_w" in weights:
        q, k, v = ((h @ weights[f"{p}{layer}_w"].T + weights[f"{p}{layer}_b"]).reshape(*h.shape[:-1], heads, -1).swapaxes(-2, -3) for p in "qkv")
        score = q @ k.swapaxes(-1, -2) / math.sqrt(q.shape[-1])
        score = np.exp(score - score.max(-1, keepdims=True))
        mixed = (score / score.sum(-1, keepdims=True) @ v).swapaxes(-2, -3).reshape(h.shape)
        h = _norm(h + mixed @ weights[f"o{layer}_w"].T + weights[f"o{layer}_b"], weights[f"n{layer}a_w"], weights[f"n{layer}a_b"])
        inner = np.maximum(0, h @ weights[f"f{layer}a_w"].T + weights[f"f{layer}a_b"])
        h = _norm(h + inner @ weights[f"f{layer}b_w"].T + weights[f"f{layer}b_b"], weights[f"n{layer}b_w"], weights[f"n{layer}b_b"])
        layer += 1
    for name in ("m0", "m1"):
        h = _gelu(h @ weights[f"{name}_w"].T + weights[f"{name}_b"])
    out = h @ weights["m2_w"].T + weights["m2_b"]
    return np.logaddexp(0, out[..., 0])


def random_weights(inputs: int = 41, width: int = 128, inner: int = 512, layers: int = 1, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of the model's shape, for tests and as the start of training."""
    rng = np.random.Generator(np.random.PCG64(seed))
    shapes = {"in": (width, inputs), "m0": (width, width), "m1": (width // 2, width), "m2": (1, width // 2)}
    for i in range(layers):
        shapes |= {f"{p}{i}": (width, width) for p in "qkvo"} | {f"f{i}a": (inner, width), f"f{i}b": (width, inner)}
    out = {}
    for name, (rows, cols) in shapes.items():
        out[f"{name}_w"], out[f"{name}_b"] = rng.normal(0, 1 / math.sqrt(cols), (rows, cols)), np.zeros(rows)
    for i in range(layers):
        for p in "ab":
            out[f"n{i}{p}_w"], out[f"n{i}{p}_b"] = np.ones(width), np.zeros(width)
    return out


#: Steps that are computed together: sequences of one length in slices of so many steps.
SLICE = 4096


def totals(weights: dict[str, np.ndarray], sequences: list, dts: list, heads: int = 4) -> np.ndarray:
    """Sum of rate times dt of each sequence; sequences of one length are computed together, without padding."""
    sizes = np.array([len(d) for d in dts], np.int64)
    out = np.zeros(len(sizes))
    for steps in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == steps)
        per = max(1, SLICE // steps)
        for part in np.split(rows, range(per, len(rows), per)):
            x = np.array([np.stack(sequences[i]) for i in part], float)
            out[part] = (forward(weights, x, heads) * np.array([dts[i] for i in part], float)).sum(1)
    return out


def predicted(sequences: DataFrame, weights: dict[str, np.ndarray], key: str, heads: int = 4) -> DataFrame:
    """key, prediction: the sum of rate times dt over (key, sequence, dts)."""
    held = sequences.sparkSession.sparkContext.broadcast(weights)  # the model's fixed size

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "prediction": totals(held.value, frame["sequence"].tolist(), frame["dts"].tolist(), heads)})

    kind = dict(sequences.dtypes)[key]
    return sequences.select(key, "sequence", "dts").mapInPandas(run, f"{key} {kind}, prediction double")


def mapped(predictions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Predictions by (interval_id, flight_id) with idx and coverage; keys are compared as trimmed text without .0."""
    keys = ["interval_id", "flight_id"]
    left, right = (f.withColumns({k: key_text(F.col(k)) for k in keys}) for f in (predictions, mapping))
    return left.join(right, keys)


def unmatched(predictions: DataFrame, mapping: DataFrame) -> DataFrame:
    keys = ["interval_id", "flight_id"]
    left, right = (f.withColumns({k: key_text(F.col(k)) for k in keys}) for f in (predictions, mapping))
    return left.join(right, keys, "left_anti")


def update(template: DataFrame, predictions: DataFrame, key: str = "idx", target: str = "fuel_kg") -> DataFrame:
    """Template rows with their prediction where there is one, else the value they had; null stays null."""
    made = predictions.select(key, F.col("prediction").alias("_p"))
    old = F.col(target) if target in template.columns else F.lit(None).cast("double")
    return template.join(made, key, "left").withColumn(target, F.coalesce("_p", old)).drop("_p")


def missing(filled: DataFrame, target: str = "fuel_kg") -> DataFrame:
    return filled.where(F.col(target).isNull())


def finished(filled: DataFrame, target: str = "fuel_kg") -> DataFrame:
    return filled.withColumn(target, F.coalesce(target, F.lit(0.0)))


def scaled(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("prediction", upscaled(F.col("prediction"), F.col("coverage_ratio")))


#: Ranges of the order in which rows are numbered apart.
RANGES = 64


def evaluate(predictions: DataFrame, label: str = "label", batch: int = 16, order: str = "idx") -> DataFrame:
    """Mean of the batches' mean squared errors; batches are runs of rows in the order of a number.

    Rows are numbered within ranges of the order, after the rows of the ranges before, so no task holds them all.
    Rows without an order come first, as one range; equal orders share a range too.
    """
    cuts = [i / RANGES for i in range(1, RANGES)]
    bounds = sorted(set(predictions.agg(F.percentile_approx(F.col(order).cast("double"), cuts, 10_000)).first()[0] or []))
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < F.col(order))), F.lit(-1))
    rows = predictions.select(F.col(order).alias("o"), F.pow(F.col("prediction") - F.col(label), F.lit(2.0)).alias("e"), part.alias("part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")  # a row for each range
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("o", "e")) - 1
    losses = rows.join(F.broadcast(sizes), "part").withColumn("b", F.floor(number / batch)).groupBy("b").agg(F.avg("e").alias("loss"))
    return losses.agg(F.avg("loss").alias("loss"))
