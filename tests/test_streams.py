"""Stateful stream operators over several micro-batches with restarts, against their batch twins over the rows that are not late."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import features
from fleetlens.streaming import jobs, queries, state, windows
from fleetlens.streaming.replay import ROCKS, Replay, arrivals, play

START = dt.datetime(2024, 1, 1)
COLUMNS = {"event_id": "long", "vehicle_id": "long", "ts": "timestamp_ntz", "speed_kmh": "double", "event_type": "string", "engine_temperature_c": "double", "fuel_level_percent": "double", "battery_voltage": "double", "oil_pressure_kpa": "double", "fuel_consumption_lph": "double"}


def readings(spark, rows):
    """Rows of (event_id, vehicle, seconds, speed[, temperature, event type, slice])."""
    full = []
    for r in rows:
        k, vehicle, at, speed, hot, kind, part = (*r, *(80.0, "view", 0)[len(r) - 4 :])
        full.append((k, vehicle, START + dt.timedelta(seconds=at), float(speed), kind, float(hot), 50.0, 12.6, 300.0, 5.0, part))
    return spark.createDataFrame(full, ", ".join(f"{k} {v}" for k, v in COLUMNS.items()) + ", slice int")


def random_rows(n, slices, vehicles=3, span=6000, seed=1):
    """Rows in slices by time, some of which arrive a slice or more late."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        at = rng.randrange(span)
        part = min(slices - 1, at * slices // span + (rng.random() < 0.15) * rng.randint(1, slices))
        rows.append((k, rng.randrange(vehicles), at, rng.choice([20, 30, 40, 150]), rng.choice([80, 90, 130]), rng.choice(["view", "error"]), part))
    return rows


def marks(rows, delay_s):
    """The mark (seconds) before each slice, and the last one."""
    before, newest, out = 0, None, {}
    base = START.replace(tzinfo=dt.timezone.utc).timestamp()
    for part in sorted({r[6] for r in rows}):
        out[part] = before
        newest = max([x for x in (newest, *(base + r[2] for r in rows if r[6] == part)) if x is not None])
        before = newest - delay_s
    return out, before


def kept(rows, delay_s, window=None):
    """Rows that are not late (their window, if any, is still open when they arrive), and the last mark."""
    at, last = marks(rows, delay_s)
    base = START.replace(tzinfo=dt.timezone.utc).timestamp()
    end = lambda t: t if window is None else (t // window + 1) * window
    return [r for r in rows if end(base + r[2]) > at[r[6]]], last - base


def streamed(df, build, mode="append", delay="2 minutes", **given):
    return play([Replay(df)], lambda s: build(windows.with_event_time(s, delay)), mode, partitions=2, **given)


def test_arrivals_make_equal_spans(spark):
    df = arrivals(readings(spark, [(k, 1, k, 1) for k in range(100)]).drop("slice"), 4, F.expr("CASE WHEN event_id = 5 THEN 90 ELSE 0 END"))
    got = {r.event_id: r.slice for r in df.collect()}
    assert [sum(v == k for v in got.values()) for k in range(4)] == [24, 25, 25, 26] and got[5] == 3
    assert arrivals(readings(spark, []).drop("slice"), 4, F.lit(0)).count() == 0


def test_late_rows_are_dropped_and_counted(spark):
    rows = random_rows(300, 4)
    run = streamed(readings(spark, rows), windows.minute_rates)
    good, last = kept(rows, 120, 60)
    want = {}
    for r in good:
        want[r[2] // 60, r[5]] = want.get((r[2] // 60, r[5]), 0) + 1
    want = {k: n for k, n in want.items() if (k[0] + 1) * 60 <= last}
    got = {(int((r.window_start - START).total_seconds()) // 60, r.event_type): r.readings for r in run.out.collect()}
    assert got == want and len(good) < len(rows)
    late = {(r[6], r[2] // 60, r[5]) for r in set(rows) - set(good)}
    assert sum(run.total(k, "numRowsDroppedByWatermark") for k in run.progress) == len(late) > 0


@pytest.mark.parametrize("build, size", [(windows.vehicle_agg, 300), (lambda r: windows.fleet_agg(r, "5 minutes").drop("vehicles"), 300)], ids=["vehicle", "fleet"])
def test_windows_over_slices_equal_the_batch(spark, build, size):
    rows = random_rows(400, 3, seed=5)
    df = readings(spark, rows).withColumns({c: F.col("speed_kmh") / 7 for c in ("latitude", "longitude")})
    run = streamed(df, build)
    good, last = kept(rows, 120, size)
    closed = F.lit(START + dt.timedelta(seconds=last)).cast("timestamp_ntz")
    want = build(windows.with_event_time(df.join(spark.createDataFrame([(r[0],) for r in good], "event_id long"), "event_id", "left_semi"))).filter(F.col("window_end") <= closed)
    assert sorted(map(tuple, run.out.select(*want.columns).collect())) == sorted(map(tuple, want.collect())) != []


def passed(rows, delay_s):
    good, last = kept(rows, delay_s)
    return [r for r in good if r[2] < last]


@pytest.mark.parametrize("seed", [2, 3])
def test_ordered_state_equals_the_batch(spark, seed):
    """Files out of time order, late rows, restarts: the same rows as the window functions give."""
    rows = random_rows(400, 4, seed=seed)
    df, there = readings(spark, rows), readings(spark, passed(rows, 120))
    run = streamed(df, lambda s: state.rolling_zscore_stream(s, 20, 5, 1.0))
    want = features.rolling_zscore(readings=there, size=20, least=5, limit=1)
    columns = ["vehicle_id", "event_id", "ts", "value", "z_score", "severity"]
    assert sorted(map(tuple, run.out.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []
    run = streamed(df, state.alert_stream)
    want = features.generate_alerts(readings=there)
    columns = ["vehicle_id", "event_id", "ts", "alert_type", "priority", "heat_rise", "mean_voltage"]
    assert sorted(map(tuple, run.out.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []


def test_slices_do_not_change_ordered_results(spark):
    rows = [(*r[:6], k % 5) for k, r in enumerate(random_rows(200, 1, seed=9))]  # all times in all slices
    one = streamed(readings(spark, [(*r[:6], 0) for r in rows]), lambda s: state.rolling_zscore_stream(s, 10, 3, 1.0), delay="3 hours")
    closing = [(9000 + v, v, 40000, 20, 80, "view", 9) for v in range(3)]  # lets the watermark pass all others
    outs = []
    for given in (rows, [(*r[:6], 0) for r in rows]):
        outs.append(sorted(map(tuple, streamed(readings(spark, given + closing), lambda s: state.rolling_zscore_stream(s, 10, 3, 1.0), delay="3 hours").out.collect())))
    assert one.out.count() == 0 and outs[0] == outs[1] != []


def test_waiting_rows_leave_the_state(spark):
    rows = [(k, k % 2, k * 10, 20, 80, "view", k // 100) for k in range(600)]
    run = streamed(readings(spark, rows), lambda s: state.rolling_zscore_stream(s, 5, 3, 9.0))
    held = [run.last(k, "numRowsTotal") for k in run.progress]
    # Two minutes hold 12 readings; besides them a value, a timer and their indexes for each of two vehicles.
    assert max(held) == held[-1] <= 30 or max(held) <= 40


def test_vehicle_runs(spark):
    rows = [(0, 1, 0, 60), (1, 1, 60, 60, 80, "error"), (2, 1, 1000, 60), (3, 2, 30, 60), (4, 3, 5000, 1, 80, "view", 1), (5, 1, 1100, 60, 80, "view", 2)]
    run = streamed(readings(spark, rows), lambda s: state.vehicle_runs(s, 600))
    got = {(r.vehicle_id, (r.started - START).seconds, (r.last_update - START).seconds, r.events, r.distance, r.faults) for r in run.out.collect()}
    # Reading 5 comes when the mark is 4880, and is late; vehicle 3 still runs.
    assert got == {(1, 0, 60, 2, 2.0, 1), (1, 1000, 1000, 1, 1.0, 0), (2, 30, 30, 1, 1.0, 0)}


def test_a_silent_vehicle_expires_and_starts_anew(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    replay = Replay(readings(spark, [(0, 1, 0, 60), (1, 1, 1, 60), (2, 1, 5, 60, 80, "error", 1)]))
    seen = []
    query = (
        state.vehicle_state(windows.with_event_time(replay.stream()), 1500).writeStream.foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect())))
        .outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    )
    try:
        replay.feed(0)
        until = time.time() + 60
        while not any(r[5] for r in seen) and time.time() < until:
            time.sleep(0.2)
        replay.feed(1)
        while len(seen) < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [(r[0], r[1], r[2], r[3], r[5]) for r in seen[:3]] == [(1, 2, 2.0, 0, False), (1, 2, 2.0, 0, True), (1, 1, 1.0, 1, False)]


def test_two_streams_join_and_forget(spark):
    rng = random.Random(4)
    left = [(k, k % 3, k * 20, 20, 80, "view", k // 50) for k in range(300)]
    right = [(1000 + k, k % 3, k * 60 + rng.randrange(50), 20, 80, "error", min(5, k // 16 + (k % 7 == 0))) for k in range(100)]
    join = lambda a, b: windows.fault_join(windows.with_event_time(a, "2 minutes"), windows.with_event_time(b, "5 minutes"), "3 minutes")
    run = play([Replay(readings(spark, left)), Replay(readings(spark, right))], join, partitions=2)
    base = START.replace(tzinfo=dt.timezone.utc).timestamp()
    before, newest, want = 0, [0, 0], set()
    alive = ([], [])
    for part in range(6):
        for side, rows, delay in ((0, left, 120), (1, right, 300)):
            alive[side].extend(r for r in rows if r[6] == part and base + r[2] > before)
            newest[side] = max([newest[side], *(base + r[2] - delay for r in rows if r[6] == part)])
        before = min(newest)
    for a in alive[0]:
        want |= {(a[0], b[0]) for b in alive[1] if a[1] == b[1] and a[2] <= b[2] <= a[2] + 180}
    assert {(r.reading_id, r.fault_id) for r in run.out.collect()} == want and len(alive[1]) < len(right)
    held = [run.last(k, "numRowsTotal") for k in run.progress]
    assert all(run.total(k, "numRowsDroppedByWatermark") >= 0 for k in run.progress) and max(held[1:]) < 120 < len(left)


def test_alert_states_by_hand(spark):
    """Hot from 0 to 400 (fires at 300, resolved by a cool reading), and again from 500 to 700 (pending only), then until a pause."""
    hot = [(k, 1, t, 50, 130) for k, t in enumerate(range(0, 401, 50))] + [(20, 1, 450, 50, 80)] + [(30 + k, 1, t, 50, 130) for k, t in enumerate(range(500, 701, 50))]
    again = [(60 + k, 1, t, 50, 130, "view", 1) for k, t in enumerate(range(2000, 2351, 50))]
    end = [(99, 2, 9000, 50, 80, "view", 2)]
    run = streamed(readings(spark, hot + again + end), lambda s: state.sustained_alert_stream(s, 300))
    got = sorted((r.state, (r.since - START).seconds, (r.until - START).seconds, r.readings) for r in run.out.filter("alert = 'HighEngineTemperature'").collect())
    assert got == [("firing", 0, 300, 7), ("firing", 2000, 2300, 7), ("resolved", 0, 400, 9), ("resolved", 2000, 2350, 8)]
    batch = features.sustained_alerts(readings=readings(spark, hot + again)).filter("alert = 'HighEngineTemperature'")
    assert sorted(((r.since - START).seconds, (r.until - START).seconds, r.readings) for r in batch.collect()) == [(0, 400, 9), (2000, 2350, 8)]


def test_component_health_over_slices(spark):
    rows = random_rows(200, 4, seed=7)
    df = readings(spark, rows).withColumns({"rpm": F.lit(4500.0), "brake_temperature_c": F.lit(160.0), "brake_pressure_bar": F.lit(20.0)})
    out = streamed(df, state.component_health_stream, "update").out
    newest = out.groupBy("vehicle_id", "component").agg(F.max_by("health", "batch").alias("health"))
    want = {(r.vehicle_id, r.component): r.health for r in state.component_health_batch(df).collect()}
    assert {(r.vehicle_id, r.component): round(r.health, 6) for r in newest.collect()} == want


def test_enrichment_of_a_stream(spark):
    rows = random_rows(50, 3, seed=8)
    vehicles = spark.createDataFrame([(0, "ICE", True, "Light", 2.0), (1, "HEV", False, "Heavy", 1.8)], "vehid long, engine_type string, is_turbo boolean, weight_category string, displacement_l double")
    df = readings(spark, rows).withColumnRenamed("vehicle_id", "vehid")
    run = streamed(df, lambda s: windows.enrich_stream(s, vehicles))
    got = {r.event_id: r.engine_type for r in run.out.collect()}
    assert got == {r[0]: {0: "ICE", 1: "HEV"}.get(r[1]) for r in rows}


def test_rate_and_console(spark):
    query = jobs.to_console(jobs.rate_stream(spark, 5), "append")
    time.sleep(2)
    assert query.exception() is None
    query.stop()


def test_progress_by_listener(spark, tmp_path):
    listener = jobs.Progress()
    spark.streams.addListener(listener)
    try:
        replay = Replay(readings(spark, random_rows(60, 1)))
        replay.feed(0)
        df = windows.minute_rates(windows.with_event_time(replay.stream(), "1 minute"))
        jobs.to_memory(df, "told").awaitTermination()
        until = time.time() + 20
        while listener.queries.get("told", {}).get("active", True) and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    told = listener.queries["told"]
    assert not told["active"] and told["error"] is None and told["input_rows"] == 60 and told["batches"] >= 1 and told["slowest_ms"] > 0 and told["state_rows"] >= 0


def test_joined_streams_hold_only_what_the_join_takes(spark, monkeypatch):
    held = []
    monkeypatch.setattr(queries, "Replay", lambda rows: held.append(rows.columns))
    monkeypatch.setattr(queries, "play", lambda sides, build: None)
    queries.fault_join_run(spark, "/root/testdata/sf0.001")
    assert held == [["vehicle_id", "event_id", "ts", "speed_kmh", "slice"]] * 2
