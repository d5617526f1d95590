"""Figures on a limit, and joins with a row for each type."""

import datetime as dt

from pyspark.sql import functions as F

from fleetlens.operators import analysis, enrichment
from fleetlens.streaming import state, windows
from fleetlens.streaming.replay import Replay, play


def test_health_on_the_limit(spark):
    """A hundred readings of three tenths each leave an engine 70 of health, which is not under 70."""
    rows = [(1, k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), 80.0, 140.0, 900.0, 13.0, 50.0, 30.0, 0) for k in range(100)]
    df = spark.createDataFrame(rows, "vehicle_id long, event_id long, ts timestamp_ntz, engine_temperature_c double, oil_pressure_kpa double, rpm double, battery_voltage double, brake_temperature_c double, brake_pressure_bar double, slice int")
    for slices in (1, 3, 7):
        parts = df.withColumn("slice", (F.col("event_id") % slices).cast("int"))
        run = play([Replay(parts)], lambda s: state.component_health_stream(windows.with_event_time(s)), "update")
        last = run.out.filter("component = 'engine'").orderBy(F.desc("batch")).first()
        assert abs(last["health"] - 70) < 1e-9 and last["state"] == "healthy" and last["days_left"] is None


def test_types_do_not_deal_out_the_trips(spark):
    """Statistics of a few types are broadcast whatever the planner thinks of their size; trips are not shuffled by type."""
    kind = "l_orderkey long, l_linenumber int, l_partkey long, vehid int, ts timestamp_ntz, vehicle_type string, vehicle_class string, fuel_efficiency_kmpl double, avg_engine_temp_c double, avg_rpm double, avg_speed_kmph double, idle_time_min double"
    trips = spark.createDataFrame([(k, 1, k, k % 5, dt.datetime(2024, 1, 1), "AB"[k % 2], "Car", float(k % 7), 90.0, 900.0, 50.0, 1.0) for k in range(60)], kind)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for op in (enrichment.anomaly_features, analysis.zscore_anomalies):
            plan = op(telemetry=trips)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
