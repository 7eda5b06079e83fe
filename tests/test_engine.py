import math

import duckdb
import pytest
from pyspark.sql import functions as F

from flightloom.functions import columns as C
from flightloom.operators import features, intervals, mlprep, predict, tracks
from flightloom.plans import catalogue

DIR = "/root/testdata/sf0.001"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("x", "want"), [(180, -180), (-180, -180), (181, -179), (-190, 170)])
def test_wrap(spark, x, want):
    assert one(spark, C.wrap(F.lit(float(x)))) == want


@pytest.mark.parametrize(("a", "b", "want"), [(179, -179, 2), (-179, 179, -2), (0, 180, 180)])
def test_arc(spark, a, b, want):
    assert one(spark, C.arc(F.lit(float(a)), F.lit(float(b)))) == want


def test_pressure_vectors(spark):
    heights = (0, 1000, 3048, 10000, 11582.4)
    assert [round(one(spark, C.pressure(F.lit(float(h)))), 4) for h in heights] == [1013.25, 898.7456, 696.8164, 264.3623, 206.2939]
    for h, want in zip(heights, (1013.25, 898.763, 696.946, 264.999, 207.148)):
        assert abs(one(spark, C.pressure_icao(F.lit(float(h)))) - want) < 0.01


def test_enu_vectors(spark):
    got = one(spark, F.array(*C.enu(F.lit(48.001), F.lit(2.001), F.lit(3048.0), F.lit(48.0), F.lit(2.0), F.lit(3048.0))))
    assert [round(x, 4) for x in got] == [74.6595, 111.244, -0.0014]
    got = one(spark, F.array(*C.enu(F.lit(0.0), F.lit(-179.999), F.lit(3048.0), F.lit(0.0), F.lit(179.999), F.lit(3048.0))))
    assert [round(x, 4) for x in got] == [222.7454, 0.0, -0.0039]


def test_levels_cells_and_rounding(spark):
    assert one(spark, C.levels_between(F.lit(264.36), F.lit(301.0))) == [350, 300, 250]
    assert one(spark, C.levels_between(F.lit(226.0), F.lit(226.0))) == [250, 225]
    assert one(spark, C.levels_between(F.lit(500.0), F.lit(500.0))) == [500]
    assert set(one(spark, C.levels_between(F.lit(200.0), F.lit(1013.25), True))) == {1000, 500, 300, 200}
    assert [tuple(c) for c in one(spark, C.cells_in(F.lit(47.75), F.lit(52.25), F.lit(-1.25), F.lit(1.25)))] == [(40, -20), (40, 0)]
    assert one(spark, C.area_of(F.lit("N40W20"))) == [60, -20, 40, 0]
    assert one(spark, C.round_even(F.lit(0.25), 1)) == 0.2 and one(spark, C.round_even(F.lit(-0.35), 1)) == -0.4
    assert round(one(spark, C.specific_energy(F.lit(3048.0), F.lit(230.0))), 1) == 5745.1
    assert one(spark, C.upscaled(F.lit(80.0), F.lit(0.8))) == 100 and one(spark, C.upscaled(F.lit(80.0), F.lit(0.0005))) == 80


def frame(spark, rows, schema="flight_id string, t double, v double"):
    return spark.createDataFrame(rows, schema)


def values(frame, c="v", order="t"):
    return [r[c] for r in frame.orderBy(order).collect()]


def test_upsample_and_thin(spark):
    rows = spark.createDataFrame([("a", x) for x in (0, 1_000_000, 2_500_000, 5_000_000)], "flight_id string, us long")
    assert [r.us for r in tracks.upsample(rows).where("inserted").orderBy("us").collect()] == [3_500_000, 4_500_000]
    rows = spark.createDataFrame([("a", x) for x in (0, 2_000_000)], "flight_id string, us long")
    assert [r.us for r in tracks.upsample(rows).where("inserted").collect()] == [1_000_000]
    near = spark.createDataFrame([("a", float(x)) for x in (0, 50, 99, 100, 150, 250)] + [("b", 0.0), ("b", 500.0)], "flight_id string, t double")
    assert [(r.flight_id, r.t) for r in tracks.thin(near, least=100.0).orderBy("flight_id", "t").collect()] == [("a", 0), ("a", 100), ("a", 250), ("b", 0), ("b", 500)]


def test_fills(spark):
    rows = frame(spark, [("a", float(i), v) for i, v in enumerate((None, 1.0, None, None, 4.0, None))] + [("b", 0.0, None)])
    assert values(tracks.fill_positional(rows, "v").where("flight_id = 'a'")) == [1, 1, 2, 3, 4, 4]
    assert values(tracks.fill_positional(rows, "v").where("flight_id = 'b'")) == [0]
    assert values(tracks.interpolate(frame(spark, [("a", 0.0, 100.0), ("a", 1.0, None), ("a", 4.0, 200.0)]), "v")) == [100, 125, 200]
    assert values(tracks.interpolate(frame(spark, [("a", 0.0, 179.0), ("a", 1.0, None), ("a", 2.0, -179.0)]), "v", circular=True))[1] == -180


def test_extrapolation(spark):
    known = [("a", float(t), v) for t, v in enumerate((100.0, 110.0, 120.0, 140.0))]
    got = values(tracks.extrapolate(frame(spark, [("a", -1.0, None), *known, ("a", 4.0, None)]), "v"))
    assert math.isclose(got[0], 84.4796814, abs_tol=1e-6) and math.isclose(got[-1], 150.4948486, abs_tol=1e-6)
    got = values(tracks.extrapolate(frame(spark, [*known, ("a", 12.0, None), ("a", 15.0, None), ("a", 19.0, None)]), "v"))
    trend = 97.6827148 + 13.2030334 * 12
    assert math.isclose(got[4], trend, abs_tol=1e-5) and math.isclose(got[5], trend, abs_tol=1e-5) and got[6] is None


def test_forward_rate_and_lookup(spark):
    rows = spark.createDataFrame([("k", 0.0, 10.0, 1.0), ("k", 1.0, 12.0, 2.0), ("k", 3.0, 12.0, 1.0)], "k string, t double, x double, dt double")
    assert values(features.forward_rate(rows, "x", "r", ["k"]), "r") == [2, 0, 0]
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "flight_id string")
    types = spark.createDataFrame([("a", "A320"), ("b", ""), ("a", "A319")], "flight_id string, aircraft_type string")
    assert {r.flight_id: r.aircraft_type for r in intervals.lookup(labels, types, "flight_id", "aircraft_type").collect()} == {"a": "A320", "b": "UNKNOWN", "c": "UNKNOWN"}


def test_split_exact(spark):
    ids = spark.createDataFrame([("g", i) for i in range(10)], "g string, i long")
    assert {r.i for r in mlprep.split(ids, "g", "i", exact=True).where("not is_train").collect()} == {0, 1}


def test_update_and_missing(spark):
    template = spark.createDataFrame([(1, None), (2, 5.0), (3, None)], "idx long, fuel_kg double")
    made = spark.createDataFrame([(1, 7.0)], "idx long, prediction double")
    filled = predict.update(template, made)
    assert [r.idx for r in predict.missing(filled).collect()] == [3]
    assert [r.fuel_kg for r in predict.finished(filled).orderBy("idx").collect()] == [7, 5, 0]


def test_encoder_is_positive_and_order_sensitive():
    import numpy as np

    weights, x = predict.random_weights(3, 16, 32), np.arange(12.0).reshape(4, 3)
    out = predict.forward(weights, x, 2)
    assert out.shape == (4,) and (out >= 0).all() and not np.allclose(out, predict.forward(weights, x[::-1], 2))


def test_one_exchange_for_shared_windows(spark):
    rows = tracks.interpolate(catalogue.track(spark, DIR), "altitude", "user_id")
    plan = tracks.fill_text(rows, "typecode", "user_id")._jdf.queryExecution().sparkPlan().toString()
    from_executed = tracks.fill_text(rows, "typecode", "user_id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and from_executed.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "nation", "orders", "supplier"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, DIR)
    want = con.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    tidy = lambda v: round(v, 4) + 0.0 if isinstance(v, float) else v
    left = sorted((tuple(tidy(r[c]) for c in columns) for r in got.collect()), key=repr)
    right = sorted((tuple(tidy(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-4)) for x, y in zip(a, b)), (a, b)
