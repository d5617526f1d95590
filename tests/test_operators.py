"""Operators on small frames with hand-made expectations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import analysis, cleaning, enrichment, features
from fleetlens.plans.dialect import SPARK
from fleetlens.streaming import jobs, windows

START = dt.datetime(2024, 1, 1)


def readings(spark, speeds, step=10, vehicle=1):
    rows = [(k, vehicle, START + dt.timedelta(seconds=k * step), float(s), "view") for k, s in enumerate(speeds)]
    return spark.createDataFrame(rows, "event_id long, vehicle_id long, ts timestamp_ntz, speed_kmh double, event_type string")


def test_standardize_columns(spark):
    assert cleaning.standardize_columns(spark.createDataFrame([(1, 2)], "`Vehicle Class` int, `Fuel-Type` int")).columns == ["vehicle_class", "fuel_type"]


def test_validate_frame(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "vehid int, kind string")
    found = {(r["check"], r["column"]): r["failures"] for r in cleaning.validate_frame(df, ["vehid", "speed"], ["kind"], {"vehid": "bigint"}).collect()}
    assert found == {("missing column", "speed"): 1, ("type is int, not bigint", "vehid"): 1, ("null key", "kind"): 1}


@pytest.mark.parametrize("text, cylinders, litres, turbo, hybrid, kind", [("4-GAS/ELECTRIC 1.8L", 4, 1.8, False, True, "Hybrid"), ("4-GAS 2.0L T/C", 4, 2.0, True, False, "Gasoline"), ("6-DSL 3.0L", 6, 3.0, False, False, "Diesel"), (None, None, None, False, False, None)])
def test_parse_engine(spark, text, cylinders, litres, turbo, hybrid, kind):
    master = spark.createDataFrame([(1, "ICE", None, text, None, 2000)], "vehid int, vehicle_type string, vehicle_class string, engine_configuration string, transmission string, generalized_weight int")
    r = cleaning.parse_engine(vehicle_master=master).first()
    assert (r["engine_cylinders"], r["displacement_l"], r["is_turbo"], r["is_hybrid"], r["engine_type"]) == (cylinders, litres, turbo, hybrid, kind)


def test_acceleration(spark):
    got = [r["acceleration"] for r in features.motion_features(readings=readings(spark, [0, 30, 60, 90, 60, 30, 0, 30, 60, 90])).orderBy("event_id").collect()]
    assert got[0] is None and got[1] == 3.0 and got[4] == -3.0


def test_sessions_break_after_a_pause(spark):
    df = readings(spark, [1, 2, 3]).unionByName(readings(spark, [4]).withColumns({"event_id": F.lit(9), "ts": F.lit(START + dt.timedelta(hours=1)).cast("timestamp_ntz")})).withColumn("odometer_km", F.col("event_id").cast("double"))
    assert sorted(r["readings"] for r in features.sessionize(readings=df).collect()) == [1, 3]


def test_guarded_division():
    assert "NULL" in enrichment.guarded("a", "b") and SPARK.div("a", "b").count("NULLIF") == 1


def test_haversine(spark):
    km = spark.sql(f"SELECT {enrichment.haversine('52.5', '13.4', '48.1', '11.6')} AS km").first()["km"]
    assert 500 < km < 510


def test_refuel(spark):
    trips = spark.createDataFrame([(1, START + dt.timedelta(hours=k), 100.0, 10.0, 10.0, 1, k, 1) for k in range(3)], "vehid int, ts timestamp_ntz, trip_distance_km double, fuel_consumed_l double, fuel_efficiency_kmpl double, l_orderkey long, l_linenumber int, l_partkey long")
    r = analysis.refuel_efficiency(telemetry=trips).first()
    assert (r["distance_km"], r["fuel_l"], r["kmpl"]) == (200.0, 20.0, 10.0)


def stream_of(spark, tmp_path, frames):
    folder = str(tmp_path / "in")
    for k, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{folder}/{k}")
    return windows.with_event_time(spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), "1 minute")


def finish(df, tmp_path, mode="append"):
    if mode == "append":
        jobs.to_table(df, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
        return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out"))
    jobs.to_memory(df, "held", mode).awaitTermination()
    return df.sparkSession.table("held")


def test_windows_stream_equals_batch(spark, tmp_path):
    df = readings(spark, range(100), step=7)
    got = finish(windows.minute_rates(stream_of(spark, tmp_path, [df])), tmp_path)
    closed = df.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=1)
    want = windows.minute_rates(windows.with_event_time(df)).filter(F.col("window_end") <= F.lit(closed).cast("timestamp_ntz"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_stream_job(spark, tmp_path):
    df = stream_of(spark, tmp_path, [readings(spark, [1, 2, 3])])
    job = jobs.StreamJob({"rates": (lambda: df.select("vehicle_id"), lambda x: jobs.to_memory(x, "rates"))}).start().wait()
    assert job.status()["rates"]["error"] is None and spark.table("rates").count() == 3
    job.stop()


def test_decode_payload(spark):
    raw = spark.createDataFrame([('{"a": 1}',)], "value string")
    assert jobs.decode_payload(raw, "json", "a int").first()["a"] == 1
    with pytest.raises(ValueError):
        jobs.decode_payload(raw, "msgpack")
