"""Ordered state of many vehicles."""

import datetime as dt

from pyspark.sql import functions as F

from fleetlens.streaming import state, windows
from fleetlens.streaming.replay import Replay, play


def test_vehicles_share_groups(spark):
    """Three thousand vehicles, and one without a number, are at most BUCKETS groups of state, and each keeps runs of its own."""
    start = dt.datetime(2024, 1, 1)
    rows = [(v, 2 * n + k, start + dt.timedelta(seconds=100 * k), 60.0, "view", k) for n, v in enumerate([*range(3000), None]) for k in (0, 1)] + [(5, 99999, start + dt.timedelta(hours=3), 60.0, "view", 2)]
    df = spark.createDataFrame(rows, "vehicle_id long, event_id long, ts timestamp_ntz, speed_kmh double, event_type string, slice int")
    run = play([Replay(df)], lambda s: state.vehicle_runs(windows.with_event_time(s, "2 minutes"), 600))
    assert 0 < max(run.last(k, "numRowsTotal") for k in run.progress) <= state.BUCKETS
    out = run.out.filter(F.col("events") == 2)
    assert out.count() == 3001 == out.select("vehicle_id").distinct().count() and out.filter("distance <> 2.0").count() == 0
