"""Registered queries of the track engine on the driver's tables, and their SQL.

Roles: events are tracks (flight: user_id, altitude: value, missing where the event is an error; positions
by arithmetic on event_id), five-day buckets are intervals, suppliers with their nations are the type dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.functions import columns as C
from flightloom.operators import demand, features, intervals, mlprep, predict, tracks, weather
from flightloom.sources.scans import utc

DAY = 86400
LEVELS = [200, 300, 500, 700, 850, 1000]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("event_type") != "error"
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return _read(spark, sf_dir, "events").select(
        "user_id", "event_id", us.alias("us"), (us / 1e6).alias("t"), F.when(good, F.col("value")).alias("altitude"), F.when(good, F.col("event_type")).alias("typecode"),
        ((F.col("event_id") * 37 % 18000) / 100.0 - 90.0).alias("latitude"), ((F.col("event_id") * 53 % 36000) / 100.0 - 180.0).alias("longitude"), F.col("value"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.floor(F.col("us") / (5 * DAY * 1000000))
    rows = track(spark, sf_dir).groupBy("user_id", bucket.alias("b")).agg(F.sum("value").alias("fuel_kg"))
    return rows.select((F.col("user_id") * 100000 + F.col("b")).alias("idx"), "user_id", (F.col("b") * 5 * DAY).cast("double").alias("start"), ((F.col("b") + 1) * 5 * DAY).cast("double").alias("end"), "fuel_kg")


def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = tracks.dedupe_near(track(spark, sf_dir), "user_id").where(F.col("altitude").isNotNull())
    return intervals.join_points(points, intervals.labelled(labels(spark, sf_dir)), "user_id", 5.0 * DAY)


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by supplier; there are more users than suppliers, so some users have no type."""
    nation = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("aircraft_type"))
    return _read(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("user_id"), "aircraft_type")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.stats(cut(spark, sf_dir), ["idx"], ["user_id", "start", "end", "fuel_kg"])


def cube(spark: SparkSession) -> DataFrame:
    """Wind that is multilinear in time, pressure, latitude and longitude, so interpolation gives it exactly."""
    ids = spark.range(34 * 7 * 13).select((F.lit(19722) + F.floor(F.col("id") / 91)).alias("hour_no"), (F.floor(F.col("id") / 13) % 7 - 3).alias("lat_q"), (F.col("id") % 13 - 6).alias("lon_q"))
    rows = ids.withColumn("pressure_level", F.explode(F.array(*map(F.lit, LEVELS))))
    lat, lon, p, d = F.col("lat_q") * 30.0, F.col("lon_q") * 30.0, F.col("pressure_level") * 1.0, F.col("hour_no") - 19722.0
    return rows.withColumn("u", 5.0 + lat * 0.1 + lon * 0.05 + p * 0.01 + d * 0.2 + lat * lon * 0.0001).withColumn("v", 2.0 - lat * 0.2 + p * d * 0.0005)


def winds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_wind(track(spark, sf_dir), cube(spark))


def with_wind(points: DataFrame, cube: DataFrame) -> DataFrame:
    points = points.withColumn("altitude_m", F.col("altitude") * 40.0)
    return weather.plausible(weather.interpolate_cube(points, cube, LEVELS, 30.0, float(DAY)))


def rough_cube(spark: SparkSession) -> DataFrame:
    """Wind without any shape, beyond 200 at many corners."""
    at = F.col("hour_no"), F.col("lat_q"), F.col("lon_q"), F.col("pressure_level")
    mixed = lambda h, a, o, m: ((at[0] * h + at[1] * a + at[2] * o + at[3]) % m).cast("double") * 4.0
    return cube(spark).withColumn("u", mixed(7, 13, 29, 97)).withColumn("v", mixed(5, 3, 11, 89))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with winds and speeds; key user_id."""
    made = intervals.kinematics(track(spark, sf_dir).where(F.col("altitude").isNotNull()), ["user_id"], digits=False)
    filled = with_wind(made, cube(spark))
    for c in ("wind_u", "wind_v"):
        filled = tracks.fill_positional(filled, c, "user_id")
    return weather.air_vector(filled)


def _r(c: str, n: int = 4) -> F.Column:
    return F.round(F.col(c), n).alias(c)


def dedupe_near(s, d):
    return tracks.dedupe_near(track(s, d), "user_id", 7200.0, ("event_id",)).select("user_id", "event_id")


def thin_min_spacing(s, d):
    return tracks.thin(track(s, d).select("user_id", "event_id", "us", F.col("us").alias("t")), "user_id", DAY * 1_000_000).select("user_id", "us")


def upsample_gap(s, d):
    return tracks.upsample(track(s, d).select("user_id", "us"), "user_id", 5_400_000_000, 3_600_000_000)


def interp_linear(s, d):
    return tracks.interpolate(track(s, d), "altitude", "user_id").select("event_id", _r("altitude"))


def interp_circular(s, d):
    rows = track(s, d).withColumn("longitude", F.when(F.col("typecode").isNotNull(), F.col("longitude")))
    return tracks.interpolate(rows, "longitude", "user_id", True).select("event_id", _r("longitude"))


def angle_unwrap(s, d):
    return tracks.unwrap(track(s, d), "longitude", "user_id").select("event_id", _r("longitude"))


def trend_extrapolate(s, d):
    rows = tracks.interpolate(track(s, d), "altitude", "user_id")
    return tracks.extrapolate(rows, "altitude", "user_id", 5.0 * DAY, 1.0 * DAY, 3.0 * DAY).select("event_id", _r("altitude"))


def ffill_bfill(s, d):
    return tracks.fill_text(track(s, d), "typecode", "user_id").select("event_id", "typecode")


def gapfill_positional(s, d):
    return tracks.fill_positional(track(s, d), "altitude", "user_id").select("event_id", _r("altitude"))


def clamp_wrap(s, d):
    rows = track(s, d)
    return rows.select("event_id", F.round(C.clamp(F.col("altitude"), 20, 80), 4).alias("clamped"), F.round(C.wrap(F.col("longitude") * 3), 4).alias("wrapped"), F.round(C.arc(F.col("longitude"), F.col("latitude") * 2), 4).alias("turn"), C.round_even(F.col("value"), 1).alias("even"))


def dim_lookup(s, d):
    rows = intervals.lookup(labels(s, d), types(s, d), "user_id", "aircraft_type")
    return intervals.numbered(rows, "aircraft_type", ["user_id", "start", "idx"]).select("idx", "aircraft_type", F.col("interval_id").cast("long").alias("interval_id"))


def interval_join(s, d):
    return cut(s, d).select("idx", "event_id")


def interval_join_binned(s, d):
    orders = _read(s, d, "orders").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("start"))
    items = _read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("double").alias("t"))
    spans = orders.withColumn("end", F.col("start") + 30.0 * DAY)
    return intervals.join_points(items, spans, "o_orderkey", 30.0 * DAY).select("o_orderkey", "l_linenumber")


def interval_stats(s, d):
    rounded = ["min_latitude", "max_latitude", "min_longitude", "max_longitude", "min_altitude", "max_altitude", "covered_time", "total_time", "coverage_ratio"]
    rate = intervals.fuel_rate(F.col("fuel_kg"), F.col("total_time")).alias("fuel_rate")
    return stats(s, d).select("idx", "user_id", F.col("sample_count").cast("long").alias("sample_count"), *map(_r, rounded), F.round(rate, 4).alias("fuel_rate"))


def idl_bounds(s, d):
    return stats(s, d).select("idx", "is_cross_idl", *map(_r, ("lon_min_east", "lon_max_east", "lon_min_west", "lon_max_west")))


def enu_velocity(s, d):
    rows = intervals.kinematics(track(s, d).where(F.col("altitude").isNotNull()), ["user_id"], digits=False)
    return rows.select("event_id", _r("gs_ve"), _r("gs_vn"), F.round("vertical_rate", 6).alias("vertical_rate"), _r("dt"))


def hpa_standard(s, d):
    return track(s, d).select("event_id", F.round(C.pressure(F.col("altitude") * 100.0), 4).alias("hpa"))


def hpa_icao(s, d):
    return track(s, d).select("event_id", F.round(C.pressure_icao(F.col("altitude") * 100.0), 4).alias("hpa"))


def grid_key(s, d):
    return track(s, d).select("event_id", C.tile_name(F.col("latitude"), F.col("longitude")).alias("tile"))


def grid_key_sw(s, d):
    name = C.corner_of(F.col("latitude"), F.col("longitude"))
    return track(s, d).select("event_id", name.alias("corner"), F.concat_ws(",", F.transform(C.area_of(name), lambda x: x.cast("string"))).alias("area"))


def bbox_cells(s, d):
    box = demand.boxes(stats(s, d))
    cells = F.explode(C.cells_in(F.col("box.s"), F.col("box.n"), F.col("box.w"), F.col("box.e"))).alias("c")
    return box.select("idx", cells).select("idx", C.corner_name(F.col("c.south"), F.col("c.west")).alias("corner")).distinct()


def level_bracket(s, d):
    p = C.pressure_icao(F.col("altitude") * 100.0)
    found = C.levels_between(p * 0.8, p)
    return track(s, d).where("altitude is not null").select("event_id", F.concat_ws(",", F.transform(found, lambda x: x.cast("string"))).alias("levels"))


def hour_range(s, d):
    start = F.timestamp_micros(F.col("us"))
    hours = C.hours_between(start, start + F.expr("interval 100 minutes"))
    return track(s, d).select("event_id", F.explode(hours).alias("h")).select("event_id", F.unix_micros("h").alias("hour_us"))


def demand_jobs(s, d):
    rows = stats(s, d).withColumns({c: F.timestamp_seconds(c) for c in ("start", "end")}).withColumns({c: F.col(c) * 30.0 for c in ("min_altitude", "max_altitude")})
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)
    return demand.jobs(rows).select("grid_id", "date", text("hours"), text("levels"), text("area"))


def cube_interp(s, d):
    return winds(s, d).select("event_id", _r("wind_u"), _r("wind_v"))


def cube_interp_masked(s, d):
    """A cube that is not multilinear, with winds over the limit."""
    return with_wind(track(s, d), rough_cube(s)).select("event_id", _r("wind_u"), _r("wind_v"))


def tile_join(s, d):
    """Points with the weather files there are: tiles of the north, in the first 20 days."""
    points = weather.tiled(track(s, d))
    files = points.where((F.col("latitude") >= 0) & (F.col("date") <= "2024-01-20"))
    return weather.on_tiles(points, files).select("event_id", "grid_id", "date", "has_tile")


def segment_bounds(s, d):
    made = intervals.kinematics(cut(s, d).select("idx", "t", "latitude", "longitude", "altitude"), ["idx"])
    micros = lambda c: F.round(F.col(c) * 1e6).cast("long").alias(f"{c}_us")
    return intervals.segments(made, ["idx"]).select("idx", micros("start"), micros("end"))


def airspeed(s, d):
    return samples(s, d).select("event_id", _r("as_u", 3), _r("as_v", 3))


def coverage_report(s, d):
    rows = winds(s, d).join(types(s, d), "user_id", "left").withColumn("aircraft_type", F.coalesce("aircraft_type", F.lit("UNKNOWN")))
    return weather.match_report(rows).select("aircraft_type", "rows", "matched", _r("ratio"))


def specific_energy(s, d):
    return track(s, d).select("event_id", F.round(C.specific_energy(C.feet_to_m(F.col("altitude")), F.hypot(F.col("latitude"), F.col("longitude"))), 4).alias("energy"))


def forward_rate(s, d):
    rows = track(s, d).withColumn("dt", F.coalesce(F.lead("t").over(tracks.by("user_id")) - F.col("t"), F.lit(0.0)))
    return features.forward_rate(rows, "latitude", "rate", ["user_id"]).select("event_id", F.round("rate", 8).alias("rate"))


def feature_round(s, d):
    rows = track(s, d).select("event_id", C.scrub(F.col("altitude")).alias("altitude"), (F.col("latitude") / 7.0).alias("gs_ve"))
    return features.rounded(rows)


def moments(s, d):
    return mlprep.moments(_read(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("column", _r("mean"), _r("std"), "n")


def zscore(s, d):
    rows = _read(s, d, "lineitem")
    return mlprep.normalised(rows, mlprep.moments(rows, ["l_quantity", "l_discount"])).select("l_orderkey", "l_linenumber", _r("l_quantity"), _r("l_discount"))


def onehot(s, d):
    vocabulary = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    code = F.concat_ws("", F.transform(mlprep.one_hot(F.col("o_orderpriority"), vocabulary), lambda x: x.cast("int").cast("string")))
    return _read(s, d, "orders").select("o_orderkey", code.alias("code"))


def train_val_split(s, d):
    ids = _read(s, d, "orders").select(F.col("o_orderpriority"), "o_orderkey")
    return mlprep.split(ids, "o_orderpriority", "o_orderkey")


def semi_split(s, d):
    rows = _read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return mlprep.of_split(rows, train_val_split(s, d), ["o_orderkey"])


def feature_vector(s, d):
    """The 41 inputs of the model on line items."""
    rows = _read(s, d, "lineitem")
    for i, name in enumerate((*mlprep.FEATURES, "dt")):
        rows = rows.withColumn(name, F.col("l_tax") * float(i) + F.col("l_quantity") if i % 2 else F.col("l_discount") * float(i) + F.col("l_extendedprice") / 1000.0)
    kind = F.element_at(F.array(*map(F.lit, mlprep.TYPES)), (F.col("l_linenumber") * 3).cast("int"))
    fitted = mlprep.as_dict(mlprep.moments(rows, [*mlprep.FEATURES, "dt"]))
    x = rows.select("l_orderkey", "l_linenumber", "l_quantity", F.explode(F.array(mlprep.model_input(fitted, F.col("l_tax"), kind))).alias("x"))  # explode: the vector is made once
    return x.select("l_orderkey", "l_linenumber", "l_quantity", *(F.round(F.col("x")[i] + 0.0, 4).alias(f"x{i:02d}") for i in range(41)))


def evaluate_loss(s, d):
    rows = _read(s, d, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") / 1000.0).alias("prediction"), (F.col("o_custkey") / 10.0).alias("label"))
    return predict.evaluate(rows).select(_r("loss"))


def train_val_split_exact(s, d):
    ids = _read(s, d, "orders").select(F.col("o_orderpriority"), "o_orderkey")
    return mlprep.split(ids, "o_orderpriority", "o_orderkey", exact=True)


def seq_assemble(s, d):
    rows = mlprep.sequences(_read(s, d, "lineitem"), ["l_orderkey"], "l_linenumber", F.array(F.col("l_quantity"), F.col("l_quantity") * 2.0))
    flat = F.concat_ws(",", F.transform(F.flatten("sequence"), lambda x: x.cast("int").cast("string")))
    return rows.select("l_orderkey", F.col("steps").cast("long").alias("steps"), flat.alias("flat"))


def complete_groups(s, d):
    rows = mlprep.complete(track(s, d), ["altitude", "typecode"], ["user_id"], 50)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


def label_sum(s, d):
    return mlprep.label_sum(_read(s, d, "lineitem"), ["l_orderkey"], "l_discount", "l_quantity").select("l_orderkey", _r("label"))


def coverage_upscale(s, d):
    rows = stats(s, d).select("idx", C.upscaled(F.col("fuel_kg"), F.col("coverage_ratio")).alias("prediction"), "coverage_ratio")
    return mlprep.covered(rows, 0.2).select("idx", F.round("prediction", 2).alias("prediction"))


def _filled(s, d):
    template = _read(s, d, "orders").select(F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("fuel_kg"))
    made = _read(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("idx")).agg(F.sum("l_quantity").alias("prediction"))
    return predict.update(template, made)


def template_update(s, d):
    return predict.finished(_filled(s, d)).select("idx", F.round("fuel_kg", 2).alias("fuel_kg"))


def missing_report(s, d):
    return predict.missing(_filled(s, d)).select("idx")


def missing_keys(s, d):
    left = track(s, d).select(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(".0")).alias("interval_id"), F.lit("f").alias("flight_id")).distinct()
    right = types(s, d).select(F.col("user_id").alias("interval_id"), F.lit("f").alias("flight_id"))
    return predict.unmatched(left, right).select("interval_id")


def encoder_forward(s, d):
    """Batch inference of the encoder on sequences of line items; no SQL form."""
    rows = mlprep.sequences(_read(s, d, "lineitem"), ["l_orderkey"], "l_linenumber", F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))))
    rows = rows.withColumn("dts", F.transform("sequence", lambda x: F.lit(1.0)))
    return predict.predicted(rows, predict.random_weights(3, 16, 32), "l_orderkey", 2)


_NAMES = (
    dedupe_near, thin_min_spacing, upsample_gap, interp_linear, interp_circular, angle_unwrap, trend_extrapolate, ffill_bfill, gapfill_positional, clamp_wrap, dim_lookup,
    interval_join, interval_join_binned, interval_stats, idl_bounds, enu_velocity, hpa_standard, hpa_icao, grid_key, grid_key_sw, bbox_cells, level_bracket, hour_range,
    demand_jobs, tile_join, cube_interp, cube_interp_masked, airspeed, segment_bounds, coverage_report, specific_energy, forward_rate, feature_round, moments, zscore, onehot, feature_vector, train_val_split, semi_split, train_val_split_exact, evaluate_loss,
    seq_assemble, complete_groups, label_sum, coverage_upscale, template_update, missing_report, missing_keys, encoder_forward,
)
QUERIES = {f.__name__: f for f in _NAMES}


# The SQL side. Literals such as 1e2 are doubles.
_TRACK = """track AS (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, CASE WHEN event_type <> 'error' THEN value END AS altitude,
    CASE WHEN event_type <> 'error' THEN event_type END AS typecode, (event_id * 37 % 18000) / 1e2 - 9e1 AS latitude, (event_id * 53 % 36000) / 1e2 - 18e1 AS longitude, value FROM events)"""
_LABELS = """labels AS (SELECT user_id * 100000 + us // 432000000000 AS idx, user_id, (us // 432000000000) * 432e3 AS "start", (us // 432000000000 + 1) * 432e3 AS "end", sum(value) AS fuel_kg
    FROM track GROUP BY user_id, us // 432000000000)"""
_CUT = """gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM track),
    cut AS (SELECT l.idx, l."start", l."end", l.fuel_kg, p.* FROM gaps p JOIN labels l ON l.user_id = p.user_id AND p.t >= l."start" AND p.t < l."end"
    WHERE p.altitude IS NOT NULL AND (gap IS NULL OR gap > 1e-6) AND (fuel_kg IS NULL OR fuel_kg > 0))"""
_STATS = """marked AS (SELECT *, lead(t) OVER (PARTITION BY idx ORDER BY t) IS NULL AS is_last FROM cut),
    stats AS (SELECT idx, max(user_id) AS user_id, max("start") AS "start", max("end") AS "end", max(fuel_kg) AS fuel_kg, min(latitude) AS min_latitude, max(latitude) AS max_latitude, min(longitude) AS min_longitude, max(longitude) AS max_longitude,
    min(altitude) AS min_altitude, max(altitude) AS max_altitude, max(t) - min(t) AS covered_time, max("end") - max("start") AS total_time, count(*) - 1 AS sample_count,
    max(longitude) FILTER (NOT is_last) - min(longitude) FILTER (NOT is_last) > 180 AS is_cross_idl,
    min(longitude) FILTER (NOT is_last AND longitude >= 0) AS ee, max(longitude) FILTER (NOT is_last AND longitude >= 0) AS ex, min(longitude) FILTER (NOT is_last AND longitude < 0) AS we, max(longitude) FILTER (NOT is_last AND longitude < 0) AS wx
    FROM marked GROUP BY idx HAVING count(*) >= 2)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _near(value: str, order: str = "t", at: str = "t", key: str = "user_id") -> str:
    """Columns tl, vl, tr, vr: the nearest valid rows on both sides."""
    before, after = f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    valid = f"CASE WHEN {value} IS NOT NULL THEN {at} END"
    return f"last_value({valid} IGNORE NULLS) {before} AS tl, last_value({value} IGNORE NULLS) {before} AS vl, first_value({valid} IGNORE NULLS) {after} AS tr, first_value({value} IGNORE NULLS) {after} AS vr"


_LINEAR = f"near AS (SELECT *, {_near('altitude')} FROM track), linear AS (SELECT * REPLACE (coalesce(altitude, (tr - t) / (tr - tl) * vl + (1 - (tr - t) / (tr - tl)) * vr) AS altitude) FROM near)"


def _icao(x: str) -> str:
    h = f"({x} * 6356766e0 / ({x} + 6356766e0))"
    out = ""
    for (base, temp, lapse, p), top in zip(C.ICAO, [*(r[0] for r in C.ICAO[1:]), None]):
        here = f"pow(({h} - {base}::DOUBLE) * {lapse}::DOUBLE / {temp}::DOUBLE + 1, {-C.GRAVITY * 0.0289644 / (8.31432 * lapse)!r}::DOUBLE) * {p}::DOUBLE" if lapse else f"exp(({h} - {base}::DOUBLE) * {-C.GRAVITY * 0.0289644 / (8.31432 * temp)!r}::DOUBLE) * {p}::DOUBLE"
        out += f" WHEN {h} < {top}::DOUBLE THEN {here}" if top else f" ELSE {here} END"
    return f"CASE WHEN {x} IS NULL THEN NULL{out}"


_HPA = "pow(1 - least(greatest({x}, 0e0), 7e4) * 2.25577e-5::DOUBLE, 5.25588::DOUBLE) * 1013.25::DOUBLE"
_WIND = f"""hp AS (SELECT *, CASE WHEN altitude IS NOT NULL THEN {_HPA.format(x="(altitude * 4e1)")} END AS p, us / 864e8 - 19722 AS d FROM track),
    wind AS (SELECT *, CASE WHEN p BETWEEN 200 AND 1000 THEN 5 + latitude * 1e-1 + longitude * 5e-2 + p * 1e-2 + d * 2e-1 + latitude * longitude * 1e-4 END AS wind_u,
    CASE WHEN p BETWEEN 200 AND 1000 THEN 2 - latitude * 2e-1 + p * d * 5e-4 END AS wind_v FROM hp)"""


def _ecef(lat: str, lon: str, h: str) -> tuple[str, str, str]:
    e2 = f"{C.WGS84_E2!r}::DOUBLE"
    n = f"(6378137e0 / sqrt(1 - {e2} * pow(sin(radians({lat})), 2)))"
    return f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))", f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))", f"(({n} * (1 - {e2}) + {h}) * sin(radians({lat})))"


_XYZ = _ecef("latitude", "longitude", "(altitude * 0.3048::DOUBLE)")
_KIN = f"""xyz AS (SELECT *, {_XYZ[0]} AS x, {_XYZ[1]} AS y, {_XYZ[2]} AS z FROM track WHERE altitude IS NOT NULL),
    nxt AS (SELECT *, lead(t) OVER w - t AS gap, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz, lead(altitude) OVER w AS alt2 FROM xyz WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    kin AS (SELECT *, greatest(1e-3, gap) AS dt, (dy * cos(radians(longitude)) - dx * sin(radians(longitude))) / greatest(1e-3, gap) AS gs_ve,
    (dz * cos(radians(latitude)) - (dx * cos(radians(longitude)) + dy * sin(radians(longitude))) * sin(radians(latitude))) / greatest(1e-3, gap) AS gs_vn,
    (alt2 - altitude) * 0.3048::DOUBLE / greatest(1e-3, gap) AS vertical_rate FROM nxt WHERE gap IS NOT NULL)"""
_SW = "(floor(latitude / 2e1) * 20)::INT AS south, (CASE WHEN floor(longitude / 2e1) * 20 >= 180 THEN 160 ELSE floor(longitude / 2e1) * 20 END)::INT AS west"
_CORNER = "(CASE WHEN south >= 0 THEN 'N' ELSE 'S' END) || abs(south) || (CASE WHEN west >= 0 THEN 'E' ELSE 'W' END) || abs(west)"
_BOX = """box AS (SELECT idx, "start", "end", min_altitude, max_altitude, greatest(-90, min_latitude - 25e-2) AS s, least(90, max_latitude + 25e-2) AS n, b.w, b.e FROM (
    SELECT *, unnest(CASE WHEN is_cross_idl THEN [{'w': greatest(-180, ee - 25e-2), 'e': least(180, ex + 25e-2)}, {'w': greatest(-180, we - 25e-2), 'e': least(180, wx + 25e-2)}]
    ELSE [{'w': greatest(-180, min_longitude - 25e-2), 'e': least(180, max_longitude + 25e-2)}] END) AS b FROM stats)),
    cells AS (SELECT box.*, a.s20 AS south, o.w20 AS west FROM box, (SELECT unnest(range(-100, 90, 20)) AS s20) a, (SELECT unnest(range(-180, 180, 20)) AS w20) o
    WHERE s20 BETWEEN floor(s / 2e1) * 20 AND floor(n / 2e1) * 20 AND w20 BETWEEN floor(w / 2e1) * 20 AND floor(e / 2e1) * 20)"""
_LIST = str(list(C.LEVELS))
_BRACKET = "list_filter({l}, lambda x: x <= list_min(list_filter({l}, lambda y: y >= hi)) AND x >= list_max(list_filter({l}, lambda y: y <= lo)))".format(l=_LIST)


def _trend(side: str) -> str:
    k, sign = ("min", 1) if side == "h" else ("max", -1)
    return f"""{side}k AS (SELECT user_id, {k}(t) AS k FROM linear WHERE altitude IS NOT NULL GROUP BY user_id),
    {side}w AS (SELECT l.user_id, t, altitude AS v, k, exp((t - max(t) OVER (PARTITION BY l.user_id)) / 432e3) AS w, t - min(t) OVER (PARTITION BY l.user_id) AS x
      FROM linear l JOIN {side}k USING (user_id) WHERE altitude IS NOT NULL AND (t - k) * {sign} <= 432e3),
    {side}s AS (SELECT user_id, max(k) AS k, min(t) AS lo, count(*) AS n, arg_min(v, abs(t - k)) AS vk, sum(w) AS s, sum(w*x) AS sx, sum(w*x*x) AS sxx, sum(w*v) AS sv, sum(w*x*v) AS sxv FROM {side}w GROUP BY user_id),
    {side} AS (SELECT user_id, k, lo, vk, CASE WHEN n >= 2 THEN (s*sxv - sx*sv) / nullif(s*sxx - sx*sx, 0) END AS b, (sv - b * sx) / s AS a FROM {side}s)"""


def _rough(h: int, a: int, o: int, m: int) -> str:
    """Interpolation of the rough cube: the sum over 16 corners, those of weight 0 left out."""
    terms = []
    for dh in (0, 1):
        for da in (0, 1):
            for do in (0, 1):
                for level, share in (("lo", "1 - above"), ("hi", "above")):
                    weight = " * ".join([f"({share})", *(f"(x{n} - floor(x{n}))" if d else f"(1 - (x{n} - floor(x{n})))" for n, d in (("h", dh), ("a", da), ("o", do)))])
                    corner = f"(((floor(xh)::BIGINT + {dh}) * {h} + (floor(xa)::BIGINT + {da}) * {a} + (floor(xo)::BIGINT + {do}) * {o} + {level}) % {m}) * 4e0"
                    terms.append(f"CASE WHEN {weight} = 0 THEN 0 ELSE {weight} * {corner} END")
    return " + ".join(terms)


_ROUGH = f"""ax AS (SELECT event_id, us / 864e8 AS xh, latitude / 3e1 AS xa, longitude / 3e1 AS xo, CASE WHEN altitude IS NOT NULL THEN {_HPA.format(x="(altitude * 4e1)")} END AS p FROM track),
    br AS (SELECT *, list_max(list_filter({LEVELS}, lambda y: y <= p)) AS lo, list_min(list_filter({LEVELS}, lambda y: y >= p)) AS hi FROM ax),
    ab AS (SELECT *, CASE WHEN hi > lo THEN (p - lo) / (hi - lo)::DOUBLE WHEN hi = lo THEN 0e0 END AS above FROM br),
    rough AS (SELECT event_id, {_rough(7, 13, 29, 97)} AS u, {_rough(5, 3, 11, 89)} AS v FROM ab)"""
_INPUTS = ", ".join(f"{f'l_tax * {i}::DOUBLE + l_quantity' if i % 2 else f'l_discount * {i}::DOUBLE + l_extendedprice / 1e3'} AS f{i}" for i in range(14))
_VECTOR = ", ".join([f"round((f{i} - avg(f{i}) OVER ()) / sqrt(greatest(var_pop(f{i}) OVER (), 1e-6)), 4) AS x{i:02d}" for i in range(14)] + ["round(l_tax, 4) AS x14"] + [f"(CASE WHEN kind = '{t}' THEN 1 ELSE 0 END)::DOUBLE AS x{15 + i}" for i, t in enumerate(mlprep.TYPES)])

ORACLES = {
    "dedupe_near": _with(_TRACK) + "SELECT user_id, event_id FROM (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM track) WHERE gap IS NULL OR gap > 72e2",
    "thin_min_spacing": "WITH RECURSIVE " + _TRACK + ", kept AS (SELECT user_id, min(us) AS us FROM track GROUP BY user_id UNION ALL SELECT k.user_id, min(p.us) FROM kept k JOIN track p ON p.user_id = k.user_id AND p.us >= k.us + 86400000000 GROUP BY k.user_id, k.us) SELECT user_id, us FROM kept",
    "upsample_gap": _with(_TRACK, "g AS (SELECT user_id, us, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS n FROM track)") + "SELECT user_id, us, false AS inserted FROM track UNION ALL SELECT user_id, unnest(range(us + 3600000000, n, 3600000000)), true FROM g WHERE n - us > 5400000000",
    "interp_linear": _with(_TRACK, _LINEAR) + "SELECT event_id, round(altitude, 4) AS altitude FROM linear",
    "interp_circular": _with(_TRACK, "m AS (SELECT * REPLACE (CASE WHEN typecode IS NOT NULL THEN longitude END AS longitude) FROM track)", f"near AS (SELECT *, {_near('longitude')} FROM m)", "c AS (SELECT *, vl + ((vr - vl) - ceil((vr - vl - 18e1) / 36e1) * 360) * (1 - (tr - t) / (tr - tl)) AS x FROM near)") + "SELECT event_id, round(coalesce(longitude, x - floor((x + 180) / 36e1) * 360), 4) AS longitude FROM c",
    "angle_unwrap": _with(_TRACK, "j AS (SELECT *, coalesce(ceil((longitude - lag(longitude) OVER (PARTITION BY user_id ORDER BY t) - 180) / 36e1) * -360, 0) AS turn FROM track)") + "SELECT event_id, round(longitude + sum(turn) OVER (PARTITION BY user_id ORDER BY t), 4) AS longitude FROM j",
    "trend_extrapolate": _with(_TRACK, _LINEAR, _trend("h"), _trend("e")) + """,
        f AS (SELECT l.*, h.k AS hk, e.k AS ek, h.lo AS hlo, e.lo AS elo, h.a AS ha, h.b AS hb, h.vk AS hv, e.a AS ea, e.b AS eb, e.vk AS ev,
          min(CASE WHEN altitude IS NULL AND h.k - t > 0 AND h.k - t <= 864e2 THEN t END) OVER (PARTITION BY l.user_id) AS hf, max(CASE WHEN altitude IS NULL AND t - e.k > 0 AND t - e.k <= 864e2 THEN t END) OVER (PARTITION BY l.user_id) AS ef
          FROM linear l LEFT JOIN h USING (user_id) LEFT JOIN e USING (user_id))
        SELECT event_id, round(CASE WHEN altitude IS NOT NULL THEN altitude
          WHEN t < hk THEN CASE WHEN hk - t <= 864e2 THEN coalesce(ha + hb * (t - hlo), hv) WHEN hk - t <= 2592e2 THEN coalesce(ha + hb * (hf - hlo), hv) END
          WHEN t > ek THEN CASE WHEN t - ek <= 864e2 THEN coalesce(ea + eb * (t - elo), ev) WHEN t - ek <= 2592e2 THEN coalesce(ea + eb * (ef - elo), ev) END END, 4) AS altitude FROM f""",
    "ffill_bfill": _with(_TRACK, f"near AS (SELECT event_id, {_near('typecode')} FROM track)") + "SELECT event_id, coalesce(vl, vr) AS typecode FROM near",
    "gapfill_positional": _with(_TRACK, "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM track)", f"near AS (SELECT *, {_near('altitude', 't', 'rn')} FROM n)") + "SELECT event_id, round(coalesce(altitude, vl + (vr - vl) * ((rn - tl) / (tr - tl)::DOUBLE), vl, vr, 0), 4) AS altitude FROM near",
    "clamp_wrap": _with(_TRACK) + "SELECT event_id, round(CASE WHEN altitude < 20 THEN 20 WHEN altitude > 80 THEN 80 ELSE altitude END, 4) AS clamped, round(longitude * 3 - floor((longitude * 3 + 180) / 36e1) * 360, 4) AS wrapped, round(latitude * 2 - longitude - ceil((latitude * 2 - longitude - 180) / 36e1) * 360, 4) AS turn, round_even(value * 10, 0) / 1e1 AS even FROM track",
    "dim_lookup": _with(_TRACK, _LABELS) + "SELECT idx, coalesce(n_name, 'UNKNOWN') AS aircraft_type, row_number() OVER (PARTITION BY coalesce(n_name, 'UNKNOWN') ORDER BY user_id, \"start\", idx) - 1 AS interval_id FROM labels LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey) c ON s_suppkey = user_id",
    "interval_join": _with(_TRACK, _LABELS, _CUT) + "SELECT idx, event_id FROM cut",
    "interval_join_binned": "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY",
    "interval_stats": _with(_TRACK, _LABELS, _CUT, _STATS) + "SELECT idx, user_id, sample_count, round(min_latitude, 4) AS min_latitude, round(max_latitude, 4) AS max_latitude, round(min_longitude, 4) AS min_longitude, round(max_longitude, 4) AS max_longitude, round(min_altitude, 4) AS min_altitude, round(max_altitude, 4) AS max_altitude, round(covered_time, 4) AS covered_time, round(total_time, 4) AS total_time, round(CASE WHEN total_time > 0 THEN covered_time / total_time ELSE 0 END, 4) AS coverage_ratio, round(CASE WHEN total_time > 1e-9 THEN round_even(fuel_kg / total_time * 1e4, 0) / 1e4 ELSE 0 END, 4) AS fuel_rate FROM stats",
    "idl_bounds": _with(_TRACK, _LABELS, _CUT, _STATS) + "SELECT idx, is_cross_idl, CASE WHEN is_cross_idl THEN round(ee, 4) END AS lon_min_east, CASE WHEN is_cross_idl THEN round(ex, 4) END AS lon_max_east, CASE WHEN is_cross_idl THEN round(we, 4) END AS lon_min_west, CASE WHEN is_cross_idl THEN round(wx, 4) END AS lon_max_west FROM stats",
    "enu_velocity": _with(_TRACK, _KIN) + "SELECT event_id, round(gs_ve, 4) AS gs_ve, round(gs_vn, 4) AS gs_vn, round(vertical_rate, 6) AS vertical_rate, round(dt, 4) AS dt FROM kin",
    "hpa_standard": _with(_TRACK) + f"SELECT event_id, round(CASE WHEN altitude IS NOT NULL THEN {_HPA.format(x='(altitude * 1e2)')} END, 4) AS hpa FROM track",
    "hpa_icao": _with(_TRACK) + f"SELECT event_id, round({_icao('(altitude * 1e2)')}, 4) AS hpa FROM track",
    "grid_key": _with(_TRACK, f"c AS (SELECT event_id, {_SW} FROM track)") + "SELECT event_id, 'N(' || least(90, south + 20) || ')W(' || west || ')S(' || greatest(-90, south) || ')E(' || least(180, west + 20) || ')' AS tile FROM c",
    "grid_key_sw": _with(_TRACK, f"c AS (SELECT event_id, {_SW} FROM track)") + f"SELECT event_id, {_CORNER} AS corner, least(90, south + 20) || ',' || greatest(-180, west) || ',' || greatest(-90, south) || ',' || least(180, west + 20) AS area FROM c",
    "bbox_cells": _with(_TRACK, _LABELS, _CUT, _STATS, _BOX) + f"SELECT DISTINCT idx, {_CORNER} AS corner FROM cells",
    "level_bracket": _with(_TRACK, f"p AS (SELECT event_id, {_icao('(altitude * 1e2)')} AS p FROM track WHERE altitude IS NOT NULL)", "q AS (SELECT event_id, least(greatest(p * 8e-1, 1), 1000) AS lo, least(greatest(p, 1), 1000) AS hi FROM p)") + f"SELECT event_id, array_to_string({_BRACKET}, ',') AS levels FROM q",
    "hour_range": _with(_TRACK) + "SELECT event_id, unnest(range(us // 3600000000 * 3600000000, us + 6000000000 + 3600000000 - 1, 3600000000)) AS hour_us FROM track",
    "demand_jobs": _with(_TRACK, _LABELS, _CUT, _STATS, _BOX, f"p AS (SELECT *, least(greatest({_icao('(max_altitude * 3e1)')}, 1), 1000) AS lo, least(greatest({_icao('(min_altitude * 3e1)')}, 1), 1000) AS hi FROM cells)", f"j AS (SELECT south, west, unnest({_BRACKET}) AS level, h FROM (SELECT *, unnest(range(\"start\"::BIGINT, \"end\"::BIGINT + 1, 3600)) AS h FROM p))") + f"SELECT {_CORNER} AS grid_id, strftime(make_timestamp(h * 1000000), '%Y-%m-%d') AS date, array_to_string(list_sort(list_distinct(list((h // 3600) % 24))), ',') AS hours, array_to_string(list_reverse_sort(list_distinct(list(level))), ',') AS levels, least(90, south + 20) || ',' || west || ',' || greatest(-90, south) || ',' || least(180, west + 20) AS area FROM j WHERE least(90, south + 20) > greatest(-90, south) GROUP BY south, west, date",
    "cube_interp": _with(_TRACK, _WIND) + "SELECT event_id, round(wind_u, 4) AS wind_u, round(wind_v, 4) AS wind_v FROM wind",
    "cube_interp_masked": _with(_TRACK, _ROUGH) + "SELECT event_id, CASE WHEN abs(u) <= 200 AND abs(v) <= 200 THEN round(u, 4) END AS wind_u, CASE WHEN abs(u) <= 200 AND abs(v) <= 200 THEN round(v, 4) END AS wind_v FROM rough",
    "tile_join": _with(_TRACK, f"c AS (SELECT event_id, latitude, strftime(make_timestamp(us), '%Y-%m-%d') AS date, {_SW} FROM track)", "n AS (SELECT *, 'N(' || least(90, south + 20) || ')W(' || west || ')S(' || greatest(-90, south) || ')E(' || least(180, west + 20) || ')' AS grid_id FROM c)") + "SELECT event_id, grid_id, date, (grid_id, date) IN (SELECT (grid_id, date) FROM n WHERE latitude >= 0 AND date <= '2024-01-20') AS has_tile FROM n",
    "segment_bounds": _with(_TRACK, _LABELS, _CUT, "p AS (SELECT idx, t, lead(t) OVER (PARTITION BY idx ORDER BY t) - t AS dt FROM cut)") + 'SELECT idx, round(min(t) * 1e6)::BIGINT AS start_us, round((max(t) + round_even(greatest(1e-3, arg_max(dt, t)) * 1e2, 0) / 1e2) * 1e6)::BIGINT AS end_us FROM p WHERE dt IS NOT NULL GROUP BY idx',
    "airspeed": _with(_TRACK, _WIND, _KIN, "b AS (SELECT k.*, wind_u, wind_v, row_number() OVER (PARTITION BY k.user_id ORDER BY k.t) AS rn FROM kin k JOIN wind USING (event_id))", f"a AS (SELECT *, {_near('wind_u', 't', 'rn')} FROM b)", "u AS (SELECT * EXCLUDE (tl, vl, tr, vr), coalesce(wind_u, vl + (vr - vl) * ((rn - tl) / (tr - tl)::DOUBLE), vl, vr, 0) AS fu FROM a)", f"v AS (SELECT *, {_near('wind_v', 't', 'rn')} FROM u)") + "SELECT event_id, round(gs_ve - fu, 3) AS as_u, round(gs_vn - coalesce(wind_v, vl + (vr - vl) * ((rn - tl) / (tr - tl)::DOUBLE), vl, vr, 0), 3) AS as_v FROM v",
    "coverage_report": _with(_TRACK, _WIND) + "SELECT CASE WHEN grouping(kind) = 1 THEN 'TOTAL' ELSE kind END AS aircraft_type, count(*) AS rows, count(wind_u) AS matched, round(count(wind_u) / count(*), 4) AS ratio FROM (SELECT coalesce(n_name, 'UNKNOWN') AS kind, wind_u FROM wind LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey) c ON s_suppkey = user_id) GROUP BY ROLLUP (kind)",
    "specific_energy": _with(_TRACK) + "SELECT event_id, round(altitude * 0.3048::DOUBLE + (latitude * latitude + longitude * longitude) / 19.6133::DOUBLE, 4) AS energy FROM track",
    "forward_rate": _with(_TRACK, "g AS (SELECT *, (lead(latitude) OVER w - latitude) / nullif(lead(t) OVER w - t, 0) AS r FROM track WINDOW w AS (PARTITION BY user_id ORDER BY t))") + "SELECT event_id, round(coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 8) AS rate FROM g",
    "feature_round": _with(_TRACK) + "SELECT event_id, round_even(coalesce(altitude, 0) * 10, 0) / 1e1 AS altitude, round_even(latitude / 7 * 1e3, 0) / 1e3 AS gs_ve FROM track",
    "moments": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(sqrt(greatest(var_pop({c}), 1e-6)), 4) AS std, count(*) AS n FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "zscore": "SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / sqrt(greatest(var_pop(l_quantity) OVER (), 1e-6)), 4) AS l_quantity, round((l_discount - avg(l_discount) OVER ()) / sqrt(greatest(var_pop(l_discount) OVER (), 1e-6)), 4) AS l_discount FROM lineitem",
    "onehot": "SELECT o_orderkey, array_to_string([(o_orderpriority = p)::INT FOR p IN ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']], '') AS code FROM orders",
    "train_val_split": "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderpriority || ':' || o_orderkey), o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderpriority) * (1 - 2e-1)) AS is_train FROM orders",
    "semi_split": "SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderpriority || ':' || o_orderkey), o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderpriority) * (1 - 2e-1)) AS is_train FROM orders) WHERE is_train)",
    "feature_vector": f"SELECT l_orderkey, l_linenumber, l_quantity, {_VECTOR} FROM (SELECT *, {_INPUTS}, {list(mlprep.TYPES)}[l_linenumber * 3] AS kind FROM lineitem)",
    "evaluate_loss": "SELECT round(avg(loss), 4) AS loss FROM (SELECT avg(e) AS loss FROM (SELECT pow(o_totalprice / 1e3 - o_custkey / 1e1, 2) AS e, (row_number() OVER (ORDER BY o_orderkey) - 1) // 16 AS b FROM orders) GROUP BY b)",
    "seq_assemble": "SELECT l_orderkey, count(*) AS steps, string_agg(l_quantity::INT || ',' || (l_quantity * 2)::INT, ',' ORDER BY l_linenumber, l_quantity) AS flat FROM lineitem GROUP BY l_orderkey",
    "complete_groups": _with(_TRACK) + "SELECT user_id, count(*) AS n FROM track WHERE altitude IS NOT NULL AND typecode IS NOT NULL GROUP BY user_id HAVING count(*) >= 50",
    "label_sum": "SELECT l_orderkey, round(sum(l_discount * l_quantity), 4) AS label FROM lineitem GROUP BY l_orderkey",
    "coverage_upscale": _with(_TRACK, _LABELS, _CUT, _STATS) + "SELECT idx, round(fuel_kg / (covered_time / total_time), 2) AS prediction FROM stats WHERE covered_time / total_time >= 2e-1",
    "template_update": "SELECT o_orderkey AS idx, round(coalesce(p, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, 0), 2) AS fuel_kg FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey",
    "missing_report": "SELECT o_orderkey AS idx FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "missing_keys": "SELECT DISTINCT user_id::VARCHAR AS interval_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)",
}
