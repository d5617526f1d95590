"""Sliding windows of static frames: each trip is shuffled once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.streaming import windows


def trips(spark):
    at = datetime(2001, 10, 1)
    rows = [(at + timedelta(seconds=s * 37 % 90000), s % 7, float(s * s % 101) if s % 13 else None) for s in range(3000)]
    rows += [(datetime(1969, 12, 31, 23, 59), 1, 5.0), (None, 2, 7.0), (at, None, 9.0)]
    return spark.createDataFrame(rows, "ts timestamp, vehid int, avg_speed_kmph double")


@pytest.mark.parametrize("size,slide", [("10 minutes", "2 minutes"), ("5 minutes", "2 minutes"), ("1 minute", "1 minute")])
def test_sliding_fleet_equals_windows_by_spark(spark, size, slide):
    rows = trips(spark)
    want = windows.started(rows.groupBy(F.window("ts", size, slide)).agg(
        F.count_distinct(F.col("vehid")).alias("active_vehicles"), windows.r6(F.avg("avg_speed_kmph")).alias("avg_speed"), windows.r6(F.percentile("avg_speed_kmph", 0.5)).alias("median_speed")))
    got = windows.sliding_fleet(rows, size, slide)
    assert got.dtypes == want.dtypes and got.count() == want.count() > 300
    assert got.exceptAll(want).count() == 0


def test_trips_are_shuffled_before_they_are_opened_up(spark):
    plan = windows.sliding_fleet(trips(spark))._jdf.queryExecution().optimizedPlan().toString()
    physical = windows.sliding_fleet(trips(spark))._jdf.queryExecution().sparkPlan().toString()
    assert "Expand" not in plan and physical.count("Exchange") == 1
