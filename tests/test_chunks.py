"""Windows in chunks give what the operators give, with nine tenths of the rows in one vehicle, and no chunk beyond its bound."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import analysis, chunks, features
from fleetlens.plans.dialect import ORACLE, SPARK
from fleetlens.sources.views import fleet_views

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for k in range(3000):
        at = None if k == 5 else START + dt.timedelta(seconds=rng.choice([rng.randrange(400_000), 3600 * rng.randrange(3)]))  # ties, busy hours
        out.append((k, None if k % 500 == 7 else 1 if k % 10 else k % 7, at, float(rng.randrange(200)), float(k)))
    df = spark.createDataFrame(out, "event_id long, vehicle_id long, ts timestamp_ntz, speed_kmh double, odometer_km double").repartition(5)
    empty = F.when(F.col("event_id") % 11 == 0, None)
    return df.withColumns({"fuel_level_percent": empty.otherwise(F.col("event_id") % 101).cast("double"), "event_type": F.when(F.col("event_id") % 7 == 0, "error")}).cache()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, a.select(*sorted(a.columns)).collect()), key=key) == sorted(map(tuple, b.select(*sorted(a.columns)).collect()), key=key)


@pytest.mark.parametrize("chunk, slot_s", [(100, 3600), (64, 60), (1 << 18, 3600)])
def test_chunks_change_no_result(spark, rows, chunk, slot_s):
    assert same(chunks.rolling_features(rows, chunk=chunk, slot_s=slot_s), features.rolling_features(readings=rows))
    assert same(chunks.lag_features(rows, chunk=chunk, slot_s=slot_s), features.lag_features(readings=rows))
    assert same(chunks.sessionize(rows.filter("ts is not null"), chunk=chunk, slot_s=slot_s), features.sessionize(readings=rows.filter("ts is not null")))


def test_places_and_bounds(spark, rows):
    got = chunks.placed(rows, "vehicle_id", ["ts", "event_id"])
    by = {}
    for r in got.collect():
        by.setdefault(r.vehicle_id, []).append((r.pos, r.ts is not None, r.ts, r.event_id))
    for places in by.values():
        places.sort()
        assert [p[0] for p in places] == list(range(len(places))) and [p[1:] for p in places] == sorted((p[1:] for p in places), key=lambda p: (p[0], p[1] or START, p[2]))
    sizes = chunks.chunked(got, 20, 100).groupBy("vehicle_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.count_if("halo").alias("h")).collect()
    assert max(r.n for r in sizes) == 120 and max(r.h for r in sizes) == 20 and len(by[1]) > 2500


def test_other_windows_are_refused(rows):
    with pytest.raises(ValueError):
        chunks.in_chunks(features.sessionize, rows, "readings", "vehicle_id", "ts, event_id", 1)
    with pytest.raises(ValueError):
        chunks.chunked(rows.withColumn("pos", F.lit(1)), 200, 100)


@pytest.mark.parametrize("span_s", [86400, 100_000, chunks.SPAN_S])
def test_roll_ups_by_seconds(rows, span_s):
    assert same(chunks.rollup_over_time(rows, span_s), features.rollup_over_time(readings=rows))
    assert chunks.rollup_over_time(rows.filter("false"), span_s).count() == 0


def test_roll_ups_need_long_spans(rows):
    with pytest.raises(ValueError):
        chunks.rollup_over_time(rows, 3600)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("chunk, slot_s", [(100, 86400), (1 << 18, 3600)])
def test_maintenance_features_of_a_hot_vehicle(spark, chunk, slot_s):
    views = fleet_views(spark, SF, ("telemetry", "vehicles"))
    vehid = views["vehicles"].agg(F.min("vehid")).first()[0]
    hot = F.when(F.col("l_partkey") % 10 > 0, F.lit(vehid)).otherwise(F.col("vehid"))
    trips = views["telemetry"].withColumn("vehid", hot).withColumn("fuel_efficiency_kmpl", F.when(F.col("l_orderkey") % 3 > 0, F.col("fuel_efficiency_kmpl")))
    assert same(chunks.maintenance_features(trips, views["vehicles"], chunk, slot_s), analysis.maintenance_features(telemetry=trips, vehicles=views["vehicles"]))


def test_trips_in_chunks_are_worked_out_once(spark):
    """The result reads stored rows, so trips are not placed and windowed again for the vehicles' first means; places take one shuffle of the rows."""
    v = fleet_views(spark, SF, ("telemetry", "vehicles"))
    got = chunks.maintenance_features(**v, chunk=128)
    assert got.inputFiles() and "Window" not in got._jdf.queryExecution().toString()
    assert same(got, analysis.maintenance_features(**v))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = chunks.placed(v["telemetry"].localCheckpoint(), "vehid", ["ts", "l_orderkey"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 4  # rows by slot; slots summed, then by vehicle, then by slot


@pytest.mark.parametrize("by", ["vehid", "vehid, chunk"])
def test_sums_of_counts_that_run_are_those_that_slide(spark, by):
    """Missing counts too; no frame of a count slides on Spark, while the oracle's text stays as it was."""
    rng = random.Random(8)
    df = spark.createDataFrame([(v, k // 70, k, None if rng.random() < 0.4 else rng.randrange(5)) for v in range(3) for k in range(200)], "vehid int, chunk int, nth int, n int")
    text = f"SELECT vehid, nth, {analysis.since('SUM', 'n', 20, 10, by)} AS x, {analysis.rolled('SUM', 'n', 20, 10, by)} AS y FROM (SELECT *, {analysis.running('n', by)} FROM {{df}})"
    got = spark.sql(text, df=df).collect()
    assert len(got) == 600 and [r.x for r in got] == [r.y for r in got] and any(r.x is None for r in got) and any(r.x for r in got)
    assert "99 PRECEDING" not in analysis.maintenance_text(SPARK, analysis.maintenance_base(SPARK)) and "99 PRECEDING" in analysis.maintenance_text(ORACLE, analysis.maintenance_base(ORACLE))
