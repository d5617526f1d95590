"""Marts that are updated by days against full refreshes of the same trips."""

import datetime as dt
import os
import random

import numpy as np
from pyspark.sql import functions as F

from fleetlens.folders import new_path
from fleetlens.plans import packaged
from fleetlens.sources.marts import Marts

TRIPS = "vehid int, vehicle_type string, ts timestamp_ntz, trip_distance_km double, fuel_consumed_l double, fuel_efficiency_kmpl double, has_fault boolean, maintenance_flag boolean, driver_behavior_score double"
AS_OF = dt.date(2024, 3, 1)


def trips(seed, days=20, n=600):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        v = rng.randrange(40)
        at = dt.datetime(2024, 2, 1) + dt.timedelta(seconds=rng.randrange(days * 86400))
        out.append((v, "ABC"[v % 3], at, rng.random() * 50, rng.random() * 5, None if rng.random() < 0.1 else 8 + rng.random() * 10, rng.random() < 0.2, rng.random() < 0.1, rng.random()))
    return out


def same(a, b):
    key = lambda r: tuple((x is None, x) for x in r)
    rows = [sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(a.columns)).collect()), key=key) for df in (a, b)]
    return rows[0] == rows[1] and rows[0] != []


def test_changed_days_only_give_what_a_full_refresh_gives(spark):
    folder = new_path(spark, "marts").replace("file://", "")
    marts = Marts(spark, folder)
    assert marts.fleet_efficiency_daily(AS_OF).count() == 0
    old, vehicles = trips(1), spark.createDataFrame([(k, "ABC"[k % 3], "Car", "gas") for k in range(45)], "vehid int, vehicle_type string, vehicle_class string, engine_type string")
    days = {r[2].date() for r in old}
    marts.update(spark.createDataFrame(old, TRIPS), days)

    def holds(rows):
        df = spark.createDataFrame(rows, TRIPS)
        assert same(marts.fleet_efficiency_daily(AS_OF), packaged.fleet_efficiency_daily(telemetry=df, as_of=str(AS_OF)))
        assert same(marts.vehicle_performance(vehicles, AS_OF), packaged.vehicle_performance(vehicles=vehicles, telemetry=df, as_of=str(AS_OF)))

    holds(old)
    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{folder}/vehicle_days/") for f in names if f.startswith("part-")}
    before = files()
    # One day changes, one loses all its trips, one is new.
    changed, gone, fresh = dt.date(2024, 2, 5), dt.date(2024, 2, 9), dt.date(2024, 2, 25)
    new = [r for r in old if r[2].date() not in (changed, gone)] + [(*r[:2], dt.datetime.combine(d, r[2].time()), *r[3:]) for d, seed in ((changed, 2), (fresh, 3)) for r in trips(seed, n=40)]
    marts.update(spark.createDataFrame(new, TRIPS), [changed, gone, fresh])
    holds(new)
    after = files()
    touched = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert touched and all(any(f"day={d}" in f for d in (changed, gone, fresh)) for f in touched) and len(before.keys() & after.keys()) == len(days) - 2


def test_spans_from_sketches(spark):
    marts = Marts(spark, new_path(spark, "marts"))
    rows = trips(7, n=3000)
    marts.update(spark.createDataFrame(rows, TRIPS), {r[2].date() for r in rows})
    first, last = dt.date(2024, 2, 3), dt.date(2024, 2, 14)
    for r in marts.span(first, last).collect():
        of = [x for x in rows if x[1] == r["vehicle_type"] and first <= x[2].date() <= last]
        values = sorted(x[5] for x in of if x[5] is not None)
        assert r["trips"] == len(of) and abs(r["vehicles"] - len({x[0] for x in of})) <= 1
        ranks = [np.searchsorted(values, q) / len(values) for q in r["efficiency_quantiles"]]
        assert np.allclose(ranks, [0.25, 0.5, 0.75], atol=0.03)


def test_trips_without_a_time_or_vehicle(spark):
    marts = Marts(spark, new_path(spark, "marts"))
    rows = [(None, "A", dt.datetime(2024, 2, 1), 1.0, 1.0, 1.0, True, True, 1.0), (1, "A", None, 1.0, 1.0, 1.0, True, True, 1.0), (2, None, dt.datetime(2024, 2, 1), None, None, None, None, None, None)]
    marts.update(spark.createDataFrame(rows, TRIPS), [dt.date(2024, 2, 1)])
    assert [(r.vehid, r.trips, r.km) for r in marts.read("vehicle_days").select("vehid", "trips", F.col("km")).collect()] == [(2, 1, None)]
    marts.update(spark.createDataFrame(rows, TRIPS), [])
