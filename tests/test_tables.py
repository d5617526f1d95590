"""Sources, sinks, table changes and column functions."""

import datetime as dt

from pyspark.sql import functions as F

from fleetlens.functions import columns
from fleetlens.sources import tables


def test_read_vehicles(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Veh Id,Vehicle-Class\n1,NO DATA\n2,SUV\n")
    assert sorted(map(tuple, tables.read_vehicles(spark, str(tmp_path / "v.csv")).collect())) == [("1", None), ("2", "SUV")]


def test_read_telemetry(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,timestamp\n1,2024-01-01 10:00:00\n2,invalid\n")
    got = {r["id"]: r["timestamp"] for r in tables.read_telemetry(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {"1": dt.datetime(2024, 1, 1, 10), "2": None}


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "daily")
    day = lambda d, v: spark.createDataFrame([(d, 1, v)], "aggregation_date date, vehid int, km double")
    one, two = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    for frame in (day(one, 1.0), day(two, 2.0), day(two, 3.0), day(two, 3.0)):
        tables.upsert_daily(frame, path)
    assert {r["aggregation_date"]: r["km"] for r in spark.read.parquet(path).collect()} == {one: 1.0, two: 3.0}


def test_changes(spark, tmp_path):
    path = str(tmp_path / "a")
    tables.insert_rows(spark.createDataFrame([(1, "ACTIVE"), (2, "ACTIVE"), (3, None)], "id int, status string"), path)
    out = tables.update_status(spark, path, str(tmp_path / "b"), F.col("id") == 1, "DONE")
    assert {r["id"]: r["status"] for r in out.collect()} == {1: "DONE", 2: "ACTIVE", 3: None}
    assert {r["id"] for r in tables.delete_rows(spark, path, str(tmp_path / "c"), F.col("status") == "ACTIVE").collect()} == {3}


def test_profile_and_exports(spark, tmp_path):
    t = spark.createDataFrame([(1, 2.0), (3, 4.0)], "vehid int, km double")
    v = spark.createDataFrame([(1, "SUV")], "vehid int, vehicle_class string")
    assert {(r["column_name"], r["row_count"]) for r in tables.table_profile({"t": t}).collect()} == {("vehid", 2), ("km", 2)}
    tables.export_bi_extract(t, v, str(tmp_path / "bi"))
    assert spark.read.option("header", True).csv(str(tmp_path / "bi")).count() == 2
    tables.export_marts({"m": t}, str(tmp_path / "marts"))
    assert spark.read.json(str(tmp_path / "marts" / "m")).count() == 2


def test_column_functions(spark):
    df = spark.createDataFrame([(["P0442", "P0301"], 10.0, "Diesel", [1.0, 2.0] * 6, 30.0), ([], 1.0, "?", [], 1.0), (None, None, None, None, None)], "codes array<string>, litres double, engine string, h array<double>, x double")
    got = df.select(columns.fault_severity(F.col("codes")).alias("a"), columns.fault_severity(F.col("codes"), True).alias("b"), columns.co2_kg(F.col("litres"), F.col("engine")).alias("c"), columns.detect_anomaly(F.col("x"), F.col("h"))["severity"].alias("d")).collect()
    assert [tuple(r) for r in got] == [("WARNING", "CRITICAL", 26.8, "critical"), ("NONE", "NONE", 2.31, "none"), ("NONE", "NONE", None, "none")]
    columns.register(spark)
    assert spark.sql("SELECT guarded_div(1, 0) AS a, guarded_div(0, 0) AS b, guarded_div(3, 2) AS c").first().asDict() == {"a": 0.0, "b": None, "c": 1.5}
