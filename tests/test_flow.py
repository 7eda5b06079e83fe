"""Sources, sinks, the composed pipeline, the stream, training and the encoder on small made tracks."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flightloom.operators import demand, intervals, mlprep, predict, tracks, training, weather
from flightloom.plans import pipeline
from flightloom.sources import scans, sinks
from flightloom.streaming.ingest import repair_landed

NOON = dt.datetime(2024, 5, 1, 12, 0, tzinfo=dt.timezone.utc)
FLIGHTS = ("f1", "f2", "f3")


def flight(name, steps=90):
    """One point a second flying east and up; near duplicates, a gap of 5 s, missing values and a missing head."""
    rows = []
    for i in range(steps):
        if 40 <= i < 44:
            continue
        altitude = None if i < 3 or 60 <= i < 63 else 30000.0 + 5.0 * i
        rows.append((NOON + dt.timedelta(seconds=i), 50.0 + FLIGHTS.index(name), 8.0 + 0.002 * i, altitude, 450.0, 90.0, "A320" if i == 10 else None, "adsb"))
        if i == 20:
            rows.append((NOON + dt.timedelta(seconds=i, microseconds=1), 1.0, 1.0, 1.0, 1.0, 1.0, None, None))
    return pd.DataFrame(rows, columns=["timestamp", "latitude", "longitude", "altitude", "groundspeed", "track", "typecode", "source"])


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    for name in FLIGHTS:
        frame = flight(name)
        if name != "f3":  # f3 is known by its file's name alone
            frame["flight_id"] = name
        frame.to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")
    (folder / "broken.parquet").write_bytes(b"not a table")
    return str(folder)


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labels") / "fuel.parquet")
    at = lambda s: NOON + dt.timedelta(seconds=s)
    pd.DataFrame([(1, "f1", at(0), at(30), 60.0), (2, "f1", at(20), at(90), 70.0), (3, "f2", at(10), at(11), 5.0), (4, "f2", at(0), at(200), 100.0), (5, "f3", at(0), at(90), -1.0), (6, "f9", at(0), at(90), 1.0)], columns=["idx", "flight_id", "start", "end", "fuel_kg"]).to_parquet(path, coerce_timestamps="us")
    return path


def test_scans(spark, landed, labels, tmp_path):
    frame = scans.tracks(spark, landed)
    assert {r.flight_id for r in frame.select("flight_id").distinct().collect()} == set(FLIGHTS)
    assert scans.flight(spark, landed, "f2").count() == 87 and scans.flight(spark, landed, "none").count() == 0
    assert frame.agg(F.min("us")).first()[0] == int(NOON.timestamp()) * 1_000_000
    got = scans.intervals(spark, labels)
    assert got.columns == ["idx", "flight_id", "start", "end", "fuel_kg"] and got.count() == 6 and got.first()["start"] == NOON.timestamp()
    with pytest.raises(ValueError):
        spark.range(1).write.parquet(str(tmp_path / "no-idx"))
        scans.intervals(spark, str(tmp_path / "no-idx"))
    for text, us in (("2024-05-01 12:00:00", NOON.timestamp() * 1e6), ("2024-05-01T14:00:00+02:00", NOON.timestamp() * 1e6)):
        one = spark.createDataFrame([(text,)], "x string")
        assert one.select(scans.micros(one, "x")).first()[0] == us
    nanos = spark.createDataFrame([(1_500,)], "x long")
    assert nanos.select(scans.micros(nanos, "x")).first()[0] == 1
    types = spark.createDataFrame([("f1", "A320", 7)], "flight_id string, aircraft_type string, more int")
    types.write.parquet(str(tmp_path / "types"))
    assert scans.dimension(spark, str(tmp_path / "types")).columns == ["flight_id", "aircraft_type"]


def test_old_and_new_statistics(spark, tmp_path):
    spark.createDataFrame([(1, 0.5)], "interval_id long, coverage_ratio double").write.parquet(str(tmp_path / "A320" / "old"))
    spark.createDataFrame([(2, 0.5, True, 170.0)], "interval_id long, coverage_ratio double, is_cross_idl boolean, lon_min_east double").write.parquet(str(tmp_path / "B738" / "new"))
    got = {r.interval_id: r for r in scans.stats(spark, str(tmp_path)).collect()}
    assert (got[1].is_cross_idl, got[1].lon_min_east, got[2].is_cross_idl, got[2].lon_min_east, got[2].lon_max_west) == (False, None, True, 170.0, None)


def test_templates(spark, tmp_path):
    for n, (columns, want) in enumerate((("a long, idx long", "idx"), ("a long, interval_id long", "interval_id"), ("a long, myID long", "myID"))):
        spark.createDataFrame([(1, 2)], columns).write.parquet(str(tmp_path / str(n)))
        assert scans.template(spark, str(tmp_path / str(n)))[1] == want
    spark.createDataFrame([(1,)], "a long").write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        scans.template(spark, str(tmp_path / "none"))


def repaired(spark, landed):
    return tracks.repair(scans.tracks(spark, landed))


def test_repair(spark, landed):
    got = repaired(spark, landed).where("flight_id = 'f1'").orderBy("us").collect()
    seconds = [(r.us // 1_000_000) - int(NOON.timestamp()) for r in got]
    assert seconds == list(range(90))  # the gap is filled, the near duplicate and nothing else is gone
    assert {r.typecode for r in got} == {"A320"}
    for i, r in enumerate(got):
        assert abs(r.altitude - (30000 + 5 * i)) < 3 and abs(r.longitude - (8 + 0.002 * i)) < 1e-5 and r.latitude == 50


def test_track_sink_and_stream(spark, landed, tmp_path):
    sinks.tracks(repaired(spark, landed), str(tmp_path / "tracks"), files=2)
    back = spark.read.parquet(str(tmp_path / "tracks"))
    whole = back.select("flight_id", F.col("_metadata.file_name").alias("file")).groupBy("flight_id").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n")).collect()
    assert {(r.flight_id, r.files, r.n) for r in whole} == {(f, 1, 90) for f in FLIGHTS}
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    for turn, names in enumerate((("f1", "f2"), ("f3",))):
        for name in names:
            frame = flight(name).assign(flight_id=name)
            frame.to_parquet(incoming / f"{name}.parquet", coerce_timestamps="us")
        repair_landed(spark, str(incoming), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        out = spark.read.parquet(str(tmp_path / "out"))
        assert {(r.flight_id, r.n) for r in out.groupBy("flight_id").agg(F.count("*").alias("n")).collect()} == {(f, 90) for f in FLIGHTS[: 2 + turn]}


def wind(spark):
    """A cube made of weather rows with falling latitudes and levels and longitudes in 0 to 360: u = 10 + lat, v = hour."""
    frames = []
    for hour in (11, 12, 13):
        levels, lats, lons = [300, 250, 200], np.arange(54.0, 48.9, -0.25), np.arange(7.0, 10.0, 0.25)
        u = np.broadcast_to((10 + lats)[None, None, :, None], (1, 3, len(lats), len(lons)))
        frames.append(scans.grid_rows([NOON.replace(hour=hour)], levels, lats, lons, u, np.full(u.shape, float(hour))))
    return weather.gridded(spark.createDataFrame(pd.concat(frames)))


def test_pipeline(spark, landed, labels, tmp_path):
    flights = spark.createDataFrame([("f1", "A320"), ("f2", "B738"), ("f3", None)], "flight_id string, aircraft_type string")
    made, stats = pipeline.samples(scans.tracks(spark, landed), scans.intervals(spark, labels), flights)
    sinks.stats(stats, str(tmp_path / "stats"))
    found = {r.idx: r for r in scans.stats(spark, str(tmp_path / "stats")).collect()}
    assert set(found) == {1, 2, 4}  # 3 holds one point, 5 has no fuel, 6 has no track
    t0 = NOON.timestamp()
    assert (found[1].start - t0, found[1].end - t0, found[1].covered_time, found[1].total_time, found[1].sample_count) == (0, 29, 29, 30, 29)
    assert (found[4].coverage_ratio, found[4].end - t0) == (89 / 200, 89)
    rows = pipeline.features_of(made, wind(spark))
    sinks.samples(rows.withColumn("us", (F.col("t") * 1_000_000).cast("long")), str(tmp_path / "samples"), sinks.SAMPLES | {"as_u": "double", "as_v": "double", "airspeed": "double", "specific_energy": "double", "energy_rate": "double", "gs_vn_dt": "double"}, files=2)
    back = scans.samples(spark, str(tmp_path / "samples"), types=["A320"])
    assert back.count() == 29 + 69 and scans.samples(spark, str(tmp_path / "samples"), ["us"]).columns == ["us"] and scans.rows_of(spark, str(tmp_path / "samples")) == 29 + 69 + 89
    speed = 0.002 * 111_412 * math.cos(math.radians(50))
    for r in back.where("us % 60000000 = 30000000").collect():
        assert abs(r.gs_ve - speed) < 1 and abs(r.gs_vn) < 0.1 and abs(r.as_u - (r.gs_ve - 60)) < 0.01 and abs(r.as_v - (r.gs_vn - 12 - 30 / 3600)) < 0.01
        assert abs(r.vertical_rate - 1.5) < 0.06 and abs(r.airspeed - math.hypot(r.as_u, r.as_v)) < 0.01 and r.track == 90
    assert {round(r.fuel_rate_warm, 4) for r in back.select("fuel_rate_warm").distinct().collect()} == {2.0, 1.0}


def test_wind_of_equal_points_and_at_the_seam(spark):
    rows = [(NOON, 500, lat, lon, 5.0, 1.0) for lat in (0.0, 0.25) for lon in (179.75, 180.0, 0.0)] + [(NOON.replace(hour=13), 500, lat, lon, 5.0, 1.0) for lat in (0.0, 0.25) for lon in (179.75, 180.0, 0.0)]
    cube = weather.gridded(spark.createDataFrame(rows, "valid_time timestamp, pressure_level int, latitude double, longitude double, u double, v double"))
    high = 5574.9  # about 500 hPa
    points = spark.createDataFrame([(NOON.timestamp() + 60, 0.1, 179.9, high)] * 2 + [(NOON.timestamp() + 60, 0.1, 10.0, high)], "t double, latitude double, longitude double, altitude_m double")
    p = points.select(weather.pressure(F.col("altitude_m"))).first()[0]
    cube = cube.withColumn("pressure_level", F.explode(F.array(F.lit(math.floor(p)), F.lit(math.ceil(p)))))
    got = weather.interpolate_cube(points, cube).collect()
    assert [(r.wind_u and round(r.wind_u, 9), r.wind_v and round(r.wind_v, 9)) for r in sorted(got, key=lambda r: -r.longitude)] == [(5, 1), (5, 1), (None, None)]
    late = spark.createDataFrame([(NOON.replace(hour=23, minute=30).timestamp(), 0.0, 179.75, high)], points.schema)
    night = cube.where("hour_no % 24 = 12").withColumn("hour_no", F.explode(F.array(F.col("hour_no") + 11, F.col("hour_no") + 12)))
    assert weather.interpolate_cube(late, night).first()["wind_u"] is not None and weather.interpolate_cube(late, night, day_bounded=True).first()["wind_u"] is None
    assert [(r.u, r.v) for r in weather.plausible(spark.createDataFrame([(201.0, 1.0), (200.0, -200.0), (None, 1.0)], "u double, v double"), "u", "v").collect()] == [(None, None), (200, -200), (None, None)]


def test_tiles(spark):
    points = weather.tiled(spark.createDataFrame([(1, 0.0, 10.0, 10.0), (2, 90000.0, 10.0, 10.0), (3, 0.0, -10.0, 10.0)], "i int, t double, latitude double, longitude double"))
    files = points.where("i = 2").select("grid_id", "date")
    assert {r.i: r.has_tile for r in weather.on_tiles(points, files).collect()} == {1: False, 2: True, 3: False}
    assert [r.i for r in weather.pruned(points, files).collect()] == [2]


def test_jobs_and_reports(spark, tmp_path):
    stats = spark.createDataFrame([(51.0, 52.0, 5.0, 6.0, 9000.0, 10000.0, NOON, NOON + dt.timedelta(hours=13, minutes=5)), (51.0, 52.0, 5.0, 6.0, 300.0, 300.0, NOON, NOON), (None, None, None, None, None, None, None, None)], "min_latitude double, max_latitude double, min_longitude double, max_longitude double, min_altitude double, max_altitude double, start timestamp, end timestamp")
    planned = demand.jobs(stats)
    got = {(r.grid_id, r.date): r for r in planned.collect()}
    assert set(got) == {("N40E0", "2024-05-01"), ("N40E0", "2024-05-02")}
    assert got["N40E0", "2024-05-01"].hours == list(range(12, 24)) and got["N40E0", "2024-05-02"].hours == [0, 1, 2]
    assert got["N40E0", "2024-05-01"].levels == [1000, 975, 350, 300, 250] and got["N40E0", "2024-05-02"].area == [60, 0, 40, 20]
    documents = demand.documents(planned)
    sinks.jobs(documents, str(tmp_path / "jobs"))
    assert sorted(json.loads(r.value)["time"][0] for r in spark.read.text(str(tmp_path / "jobs")).collect()) == ["00:00", "12:00"]
    whole = json.loads(sinks.job_document(documents, 20))
    assert whole["metadata"] == {"total_jobs": 2, "grid_size": 20} and whole["era5_download_jobs"][0]["day"] == ["01"]
    moments = mlprep.moments(spark.createDataFrame([(1.0,), (3.0,)], "x double"), ["x"])
    sinks.moments(moments, str(tmp_path / "moments"))
    assert [tuple(r) for r in scans.moments(spark, str(tmp_path / "moments")).collect()] == [("x", 2.0, 1.0, 2)]
    filled = spark.createDataFrame([(1, 2.5), (2, None)], "idx long, fuel_kg double")
    sinks.missing_report(filled, str(tmp_path / "missing"))
    assert [r.idx for r in spark.read.option("header", True).csv(str(tmp_path / "missing")).collect()] == ["2"]
    sinks.submission(filled, str(tmp_path / "submission"))
    assert sorted(r.fuel_kg for r in spark.read.parquet(str(tmp_path / "submission")).collect()) == [0.0, 2.5]
    report = {r.aircraft_type: (r.rows, r.matched, r.ratio) for r in weather.match_report(spark.createDataFrame([("a", 1.0), ("a", None), (None, 1.0)], "aircraft_type string, wind_u double")).collect()}
    assert report == {"a": (2, 1, 0.5), None: (1, 1, 1.0), "TOTAL": (3, 2, 2 / 3)}


def test_schema_and_defaults(spark):
    got = sinks.enforced(spark.createDataFrame([("7", 1)], "interval_id string, more int"), {"interval_id": "long", "dt": "double"})
    assert got.dtypes == [("interval_id", "bigint"), ("dt", "double")] and got.first() == (7, None)
    from flightloom.operators import features

    bare = features.build(spark.createDataFrame([("a", 1, 0.0, 1.0, 5.0)], "aircraft_type string, interval_id long, t double, dt double, vertical_rate double"))
    assert bare.select("airspeed", "specific_energy", "vertical_rate_dt").first() == (0.0, 0.0, 0.0)


def test_mapping_and_prediction(spark):
    predictions = spark.createDataFrame([(" 1.0", "f1", 80.0), ("2", "f1", 10.0)], "interval_id string, flight_id string, prediction double")
    mapping = spark.createDataFrame([(1, "f1 ", 5, 0.8)], "interval_id long, flight_id string, idx long, coverage_ratio double")
    got = predict.scaled(predict.mapped(predictions, mapping)).collect()
    assert [(r.idx, r.prediction) for r in got] == [(5, 100.0)] and predict.unmatched(predictions, mapping).count() == 1


def test_model_input(spark):
    names = (*mlprep.FEATURES, "dt")
    rows = spark.createDataFrame([(*map(float, range(14)), "B738", 0.5), (*map(float, range(14)), "none", None)], ", ".join(f"{n} double" for n in names) + ", kind string, cover double")
    x = [r.x for r in rows.select(mlprep.model_input({n: (1.0, 2.0) for n in names}, F.col("cover"), F.col("kind")).alias("x")).collect()]
    assert len(mlprep.TYPES) == 26 and len(x[0]) == 41 and x[0][:14] == [(i - 1) / 2 for i in range(14)] and x[0][14] == 0.5 and x[1][14] == 1.0
    assert x[0][15:].index(1.0) == sorted(mlprep.TYPES).index("B738") and sum(x[0][15:]) == 1 and sum(x[1][15:]) == 0


def test_evaluate(spark):
    rng = np.random.default_rng(1)
    order = rng.permutation(1000)
    data = [(int(i), float(p), float(y)) for i, p, y in zip(order, rng.normal(size=1000), rng.normal(size=1000))]
    errors = [(p - y) ** 2 for _, p, y in sorted(data)]
    want = np.mean([np.mean(errors[i : i + 16]) for i in range(0, 1000, 16)])
    assert abs(predict.evaluate(spark.createDataFrame(data, "idx long, prediction double, label double")).first().loss - want) < 1e-9
    assert predict.evaluate(spark.createDataFrame([], "idx long, prediction double, label double")).first().loss is None


def test_encoder_by_hand():
    """The encoder against plain loops over its definition."""
    w, heads, x = predict.random_weights(3, 4, 6, seed=3), 2, [[0.1, -0.2, 0.3], [0.5, 0.0, -0.4]]
    lin = lambda n, v: [sum(a * b for a, b in zip(row, v)) + bias for row, bias in zip(w[f"{n}_w"].tolist(), w[f"{n}_b"].tolist())]

    def norm(v):
        mean = sum(v) / len(v)
        return [(a - mean) / math.sqrt(sum((b - mean) ** 2 for b in v) / len(v) + 1e-5) for a in v]

    place = [[math.sin(t), math.cos(t), math.sin(t / 100), math.cos(t / 100)] for t in range(2)]
    h = [[a * 2 + p for a, p in zip(lin("in", v), place[t])] for t, v in enumerate(x)]
    q, k, v = ([lin(f"{p}0", r) for r in h] for p in "qkv")
    mixed = [[0.0] * 4 for _ in x]
    for head in range(heads):
        part = slice(2 * head, 2 * head + 2)
        for t in range(2):
            score = [math.exp(sum(a * b for a, b in zip(q[t][part], k[s][part])) / math.sqrt(2)) for s in range(2)]
            for c in range(2 * head, 2 * head + 2):
                mixed[t][c] = sum(score[s] * v[s][c] for s in range(2)) / sum(score)
    h = [norm([a + b for a, b in zip(r, lin("o0", m))]) for r, m in zip(h, mixed)]
    h = [norm([a + b for a, b in zip(r, lin("f0b", [max(0.0, z) for z in lin("f0a", r)]))]) for r in h]
    gelu = lambda r: [0.5 * a * (1 + math.erf(a / math.sqrt(2))) for a in r]
    want = [math.log1p(math.exp(lin("m2", gelu(lin("m1", gelu(lin("m0", r)))))[0])) for r in h]
    assert np.allclose(predict.forward(w, np.array(x), heads), want, atol=1e-12)
    assert np.allclose(predict.totals(w, [x, x[:1], [], x], [[1, 2], [3], [], [0, 1]], heads)[[0, 2, 3]], [want[0] + 2 * want[1], 0, want[1]])
    grid = np.linspace(-7, 7, 5001)
    assert np.abs(predict.erf(grid) - [math.erf(a) for a in grid]).max() < 1e-12


def test_baseline_training(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *rng.normal(size=3).tolist(), 1.0) for i in range(40) for _ in range(5)]
    frame = spark.createDataFrame(rows, "i long, a double, b double, c double, dt double")
    frame = frame.join(frame.groupBy("i").agg((F.sum("a") * 3 - F.sum("b") + 2 * F.sum("dt")).alias("label")), "i")
    model = training.baseline(frame, ["i"], features=("a", "b", "c"))
    assert np.allclose(model.coefficients.toArray()[:2], [3, -1], atol=0.5)  # a ridge
    if not __import__("importlib.util").util.find_spec("torch"):
        with pytest.raises(RuntimeError):
            training.torch_train("x", "y")


def test_interval_join_bins(spark):
    rng = np.random.default_rng(5)
    points = [(f"k{i % 3}", float(t)) for i, t in enumerate(rng.uniform(0, 20000, 300))] + [("k0", 3600.0), ("k0", 7200.0)]
    spans = [(n, f"k{n % 3}", float(a), float(a + w)) for n, (a, w) in enumerate(zip(rng.uniform(0, 19000, 40), rng.uniform(-50, 9000, 40)))] + [(100, "k0", 3600.0, 7200.0)]
    got = intervals.join_points(spark.createDataFrame(points, "flight_id string, t double"), spark.createDataFrame(spans, "idx int, flight_id string, start double, end double"))
    assert sorted((r.idx, r.t) for r in got.collect()) == sorted((n, t) for n, k, a, b in spans for f, t in points if f == k and a <= t < b)
    rows = mlprep.of_split(spark.createDataFrame([(1,), (2,)], "g int"), spark.createDataFrame([(1, True), (2, False)], "g int, is_train boolean"), ["g"])
    assert [r.g for r in rows.collect()] == [1] and mlprep.shuffled(rows).count() == 1
