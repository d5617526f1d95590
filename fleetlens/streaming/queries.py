"""Stream operators over the test tables: windowed ones as their batch twin (with oracle SQL), and real stream runs over the files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import new_path
from ..operators import features
from ..plans.dialect import ORACLE, SPARK, bound
from ..plans.parts import co2
from ..rules import FUEL_PRICE
from ..sources.views import fleet_views, oracle_ctes, readings
from . import clusters, jobs, state, windows
from .replay import Replay, Run, arrivals, play


def static(name: str):
    return lambda spark, sf_dir: windows.with_event_time(fleet_views(spark, sf_dir, (name,))[name])


def streamed_readings(spark: SparkSession, sf_dir: str, delay: str = "10 minutes") -> DataFrame:
    """Readings as a stream of the events file."""
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    one_file = all(f.endswith("/events.parquet") for f in static.inputFiles())  # else a folder of that name
    events = jobs.file_stream(spark, sf_dir, static.schema, "events.parquet", None) if one_file else jobs.file_stream(spark, f"{sf_dir}/events.parquet", static.schema, files_per_trigger=None)
    return windows.with_event_time(spark.sql(bound(readings(SPARK), ("events",)), events=events), delay)


def finished(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and read what it wrote."""
    spark = df.sparkSession
    base = new_path(spark, "stream")
    if mode == "append":
        jobs.to_table(df, f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")

    df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


#: Replays of the readings: slices; seconds from an event to its arrival (one in 97 is five days late, faults come sooner);
#: hours of the watermarks' delays, of readings and of faults.
SLICES = 4
LATE = "CASE WHEN event_id % 97 = 0 THEN 432000 ELSE event_id * 7919 % 10800 END"
LATE_FAULTS = "CASE WHEN event_id % 89 = 0 THEN 700000 ELSE event_id * 31 % 600 END"
HOURS, FAULT_HOURS = 2, 6


def replayed(spark: SparkSession, sf_dir: str, build, mode: str = "append") -> Run:
    """A stream operator over all readings, in slices of arrival, with a restart after each."""
    rows = fleet_views(spark, sf_dir, ("readings",))["readings"]
    return play([Replay(arrivals(rows, SLICES, F.expr(LATE)))], lambda s: build(windows.with_event_time(s, f"{HOURS} hours")), mode)


def fault_join_run(spark: SparkSession, sf_dir: str) -> Run:
    """Readings and faults as two streams, each with slices and delays of its own, of the columns that the join takes."""
    rows = fleet_views(spark, sf_dir, ("readings",))["readings"]
    taken = ["vehicle_id", "event_id", "ts", "speed_kmh"]
    sides = [Replay(arrivals(rows.select(*taken), SLICES, F.expr(LATE))), Replay(arrivals(rows.filter("event_type = 'error'").select(*taken), SLICES, F.expr(LATE_FAULTS)))]
    join = lambda r, f: windows.fault_join(windows.with_event_time(r, f"{HOURS} hours"), windows.with_event_time(f, f"{FAULT_HOURS} hours"), "30 minutes")
    return play(sides, join)


def cluster_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings scored by clusters that move, in slices of arrival."""
    rows = fleet_views(spark, sf_dir, ("readings",))["readings"]
    sink = clusters.MovingClusters(new_path(spark, "clusters"), ["speed_kmh", "engine_temperature_c", "fuel_consumption_lph"], "event_id")
    return clusters.play_clusters(Replay(arrivals(rows, SLICES, F.expr(LATE))), lambda s: s, sink)


def late_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the windows' state reports of each slice: rows read, and groups (window and kind of event) that came too late."""
    run = replayed(spark, sf_dir, windows.minute_rates)
    rows = [(k, sum(int(p["numInputRows"]) for p in run.progress[k]), run.total(k, "numRowsDroppedByWatermark")) for k in run.progress]
    return spark.createDataFrame(rows, "slice int, rows_read long, groups_dropped long")


def newest(df: DataFrame, *keys: str) -> DataFrame:
    """Of update-mode output, each key's row of the latest batch."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys and c != "batch")), "batch").alias("r")).select(*keys, "r.*")


def sliced_sql(name: str, rows: str, late: str, hours: int) -> str:
    """DuckDB: rows with their slice, and the mark after each slice (`<name>_rows`, `<name>_marks`)."""
    return f"""{name}_at AS (SELECT *, epoch_us(ts) + ({late}) * 1000000 AS at_us FROM {rows}),
{name}_rows AS (SELECT r.*, CAST((at_us - low) * {SLICES} // (high - low + 1) AS INT) AS slice FROM {name}_at AS r, (SELECT MIN(at_us) AS low, MAX(at_us) AS high FROM {name}_at) AS b),
{name}_marks AS (SELECT slice, MAX(MAX(epoch_us(ts) // 1000)) OVER (ORDER BY slice) - {hours * 3600000} AS mark FROM {name}_rows GROUP BY slice)"""


def replay_sql(select: str, grain_ms: int = 1) -> str:
    """DuckDB over the replayed readings: sliced (with the mark before and after), kept (not late), passed (and behind the last mark)."""
    return f"""WITH {oracle_ctes(["readings"])}, {sliced_sql("r", "readings", LATE, HOURS)},
before AS (SELECT slice, mark, COALESCE(LAG(mark) OVER (ORDER BY slice), 0) AS before FROM r_marks),
sliced AS (SELECT r.*, before, mark FROM r_rows AS r JOIN before USING (slice)), last AS (SELECT MAX(mark) AS mark FROM r_marks),
kept AS (SELECT * FROM sliced WHERE epoch_us(ts) > before * 1000),
passed AS (SELECT * FROM kept WHERE (epoch_us(ts) // {1000 * grain_ms} + 1) * {grain_ms} - 1 < (SELECT mark FROM last)) {select}"""


def over_passed(text: str) -> str:
    """A batch twin's SQL over the rows that the stream has handed over."""
    return re.sub(r"\bFROM readings\b", "FROM passed", text)


#: A vehicle's run ends after a pause of half a day in the test tables; alerts: as in the batch twin.
RUN_TIMEOUT_S = 43200
STALE_S, TIME_SCALE = 300, 60


def slots(seconds: int, slide: int | None = None, column: str = "ts") -> str:
    """DuckDB: epoch seconds of the start of every window that holds the row."""
    slide = slide or seconds
    return f"unnest(generate_series(CAST(floor(epoch({column}) / {slide}) AS BIGINT) * {slide} - {seconds - slide}, CAST(floor(epoch({column}) / {slide}) AS BIGINT) * {slide}, {slide}))"


def windowed(view: str, seconds: int, slide: int | None, keys: str, figures: str, having: str = "", columns: str = "*") -> str:
    group = f", {keys}" if keys else ""
    return f"""SELECT make_timestamp(CAST(w AS BIGINT) * 1000000) AS window_start, make_timestamp(CAST(w + {seconds} AS BIGINT) * 1000000) AS window_end{group}, {figures} FROM (SELECT {columns}, {slots(seconds, slide)} AS w FROM {view}) AS x GROUP BY w{group} {having}"""


def six(x: str) -> str:
    return f"ROUND(CAST({x} AS DOUBLE) + 1.3e-9, 6)"


def _with(view: str, sql: str) -> str:
    names = view.split(",")
    return f"WITH {oracle_ctes(names)} {sql}"


def queries() -> dict:
    r, t = static("readings"), static("telemetry")
    enriched = lambda s, d: windows.enrich_stream(t(s, d), fleet_views(s, d, ("vehicles",))["vehicles"])
    return {
        "w2_tumbling_fleet": lambda s, d: windows.tumbling_fleet(t(s, d)),
        "w3_sliding_fleet": lambda s, d: windows.sliding_fleet(t(s, d)),
        "w4_trip_sessions": lambda s, d: windows.trip_sessions(r(s, d)),
        "w5_minute_rates": lambda s, d: windows.minute_rates(r(s, d)),
        "w6_vehicle_agg": lambda s, d: windows.vehicle_agg(r(s, d), "1 hour"),
        "w7_fleet_agg": lambda s, d: windows.fleet_agg(r(s, d)),
        "w7_fleet_details": lambda s, d: windows.fleet_details(r(s, d)),
        "w8_efficiency_monitor": lambda s, d: windows.efficiency_monitor(t(s, d)),
        "w9_cost_savings": lambda s, d: windows.cost_savings_stream(t(s, d)),
        "w10_metric_agg": lambda s, d: windows.metric_agg(r(s, d)),
        "w12_driving_patterns": lambda s, d: windows.driving_patterns(r(s, d), ("4 hours", "2 hours"), ("2 hours", "1 hour")),
        "w13_enrich_stream": lambda s, d: enriched(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "vehid", "engine_type", "is_turbo", "weight_category"),
        "w14_fault_join": lambda s, d: windows.fault_join(r(s, d), r(s, d).filter("event_type = 'error'"), "30 minutes").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("reading_ts", "fault_ts")}),
        "w19_stream_metrics": lambda s, d: windows.stream_metrics(enriched(s, d)).select("l_orderkey", "l_linenumber", "l_partkey", "vehid", "fault_severity", "co2_kg", "cost_per_km", "trip_score"),
        "w21_component_health": lambda s, d: state.component_health_batch(r(s, d)),
        "w22_message_stats": lambda s, d: windows.message_stats(r(s, d)),
        "w23_live_kpis": lambda s, d: windows.live_kpis(r(s, d)),
        "w23_latest_by_vehicle": lambda s, d: windows.latest_by_vehicle(r(s, d)),
        "w23_last_n": lambda s, d: windows.last_n_by_vehicle(r(s, d)).select("vehicle_id", "event_id", "nth"),
        "w1_late_rows_dropped": lambda s, d: replayed(s, d, windows.minute_rates).out,
        "w1_late_by_slice": late_by_slice,
        "w4_sessions_stream": lambda s, d: finished(windows.trip_sessions(streamed_readings(s, d), "15 minutes")),
        "w11_zscore_stream": lambda s, d: replayed(s, d, state.rolling_zscore_stream).out,
        "w14_fault_join_streams": lambda s, d: fault_join_run(s, d).out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("reading_ts", "fault_ts")}),
        "w16_vehicle_runs": lambda s, d: replayed(s, d, lambda r: state.vehicle_runs(r, RUN_TIMEOUT_S)).out,
        "w17_cluster_stream": cluster_run,
        "w18_alert_stream": lambda s, d: replayed(s, d, state.alert_stream).out,
        "w21_health_stream": lambda s, d: newest(replayed(s, d, state.component_health_stream, "update").out, "vehicle_id", "component").withColumn("health", windows.r6(F.col("health"))),
        "w24_alert_states": lambda s, d: replayed(s, d, lambda r: state.sustained_alert_stream(r, STALE_S, TIME_SCALE)).out,
        "w24_firing_stream": lambda s, d: replayed(s, d, lambda r: state.sustained_alert_stream(r, STALE_S, TIME_SCALE)).out.filter("state = 'resolved'").drop("state"),
    }


def oracle_sql() -> dict[str, str]:
    loss_engine = "CASE WHEN engine_temperature_c > 120 THEN 0.5 WHEN engine_temperature_c > 100 THEN 0.2 ELSE 0 END + CASE WHEN oil_pressure_kpa < 150 THEN 0.3 WHEN oil_pressure_kpa < 180 THEN 0.1 ELSE 0 END + CASE WHEN rpm > 4000 THEN 0.1 ELSE 0 END"
    loss_battery = "CASE WHEN battery_voltage < 11.5 THEN 1.0 WHEN battery_voltage < 12.0 THEN 0.5 WHEN battery_voltage < 12.4 THEN 0.1 ELSE 0 END"
    loss_brakes = "CASE WHEN brake_temperature_c > 200 THEN 0.8 WHEN brake_temperature_c > 150 THEN 0.3 ELSE 0 END + CASE WHEN brake_pressure_bar < 15 THEN 0.2 ELSE 0 END"
    health = lambda k, x: f"SELECT vehicle_id, '{k}' AS component, {six(f'GREATEST(0, 100 - SUM({x}))')} AS health FROM readings GROUP BY vehicle_id"
    speed = f"MIN(speed_kmh) AS low, MAX(speed_kmh) AS high, MAX(speed_kmh) - MIN(speed_kmh) AS change, {six('AVG(acceleration_x)')} AS acceleration, CAST(NULL AS DOUBLE) AS spread, CAST(NULL AS DOUBLE) AS speed"
    side = f"CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, CAST(NULL AS DOUBLE) AS change, {six('AVG(acceleration_y)')} AS acceleration, {six('STDDEV_SAMP(acceleration_y)')} AS spread, {six('AVG(speed_kmh)')} AS speed"
    change = "MAX(speed_kmh) - MIN(speed_kmh)"
    patterns = " UNION ALL ".join([
        windowed("readings", 14400, 7200, "vehicle_id", speed + ", 'harsh_braking' AS pattern", f"HAVING {change} > 20 AND {six('AVG(acceleration_x)')} < -2"),
        windowed("readings", 14400, 7200, "vehicle_id", speed + ", 'rapid_acceleration' AS pattern", f"HAVING {change} > 30 AND {six('AVG(acceleration_x)')} > 3"),
        windowed("readings", 7200, 3600, "vehicle_id", side + ", 'sharp_cornering' AS pattern", f"HAVING ABS({six('AVG(acceleration_y)')}) > 2 AND {six('STDDEV_SAMP(acceleration_y)')} > 1 AND {six('AVG(speed_kmh)')} > 40"),
    ])

    def sessions(gap: int, closed: str = "") -> str:
        return f"""SELECT MIN(ts) AS window_start, MAX(ts) + INTERVAL '{gap}' SECOND AS window_end, vehicle_id, COUNT(*) AS readings, {six('AVG(speed_kmh)')} AS avg_speed, MAX(speed_kmh) AS max_speed FROM (SELECT *, SUM(CASE WHEN ts < before + INTERVAL '{gap}' SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS s FROM (SELECT *, LAG(ts) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS before FROM readings) AS l) AS x GROUP BY vehicle_id, s {closed}"""

    by_minute = windowed("readings", 60, None, "event_type", "COUNT(*) AS readings")
    out = {
        "w2_tumbling_fleet": _with("telemetry", windowed("telemetry", 300, None, "vehicle_type", f"COUNT(*) AS trips, {six('SUM(trip_distance_km)')} AS distance_km, {six('AVG(fuel_efficiency_kmpl)')} AS avg_efficiency, COUNT(*) FILTER (WHERE has_fault) AS faults")),
        "w3_sliding_fleet": _with("telemetry", windowed("telemetry", 600, 120, "", f"COUNT(DISTINCT vehid) AS active_vehicles, {six('AVG(avg_speed_kmph)')} AS avg_speed, {six('quantile_cont(avg_speed_kmph, 0.5)')} AS median_speed")),
        "w7_fleet_agg": _with("readings", windowed("readings", 60, None, "", f"COUNT(DISTINCT vehicle_id) AS vehicles, COUNT(*) AS readings, {six('AVG(speed_kmh)')} AS avg_speed")),
        "w7_fleet_details": _with("readings", "SELECT date_trunc('minute', ts) AS window_start, date_trunc('minute', ts) + INTERVAL '1' MINUTE AS window_end, vehicle_id, event_id, speed_kmh FROM readings"),
        "w8_efficiency_monitor": _with("telemetry", windowed("telemetry", 600, 300, "vehicle_type", ", ".join(f"{six(x)} AS {n}" for n, x in (("q1", "quantile_cont(fuel_efficiency_kmpl, 0.25)"), ("median", "quantile_cont(fuel_efficiency_kmpl, 0.5)"), ("q3", "quantile_cont(fuel_efficiency_kmpl, 0.75)"), ("iqr", "quantile_cont(fuel_efficiency_kmpl, 0.75) - quantile_cont(fuel_efficiency_kmpl, 0.25)"))))),
        "w23_live_kpis": _with("readings", f"SELECT COUNT(DISTINCT vehicle_id) AS active_vehicles, COUNT(*) AS messages, {six('AVG(speed_kmh)')} AS avg_speed, {six('AVG(fuel_level_percent)')} AS avg_fuel, COUNT(*) FILTER (WHERE event_type = 'error') AS faults, COUNT(*) FILTER (WHERE engine_temperature_c > 110) AS alerts FROM readings"),
        "w4_trip_sessions": _with("readings", sessions(300)),
        "w5_minute_rates": _with("readings", by_minute),
        "w6_vehicle_agg": _with("readings", windowed("readings", 3600, None, "vehicle_id", f"COUNT(*) AS readings, {six('AVG(speed_kmh)')} AS avg_speed, MAX(speed_kmh) AS max_speed, MIN(speed_kmh) AS min_speed, {six('STDDEV_SAMP(speed_kmh)')} AS speed_stddev, {six('AVG(engine_temperature_c)')} AS avg_temperature, MAX(engine_temperature_c) AS max_temperature, {six('AVG(fuel_level_percent)')} AS avg_fuel, {six('AVG(battery_voltage)')} AS avg_voltage, arg_max(latitude, ts) AS last_latitude, arg_max(longitude, ts) AS last_longitude")),
        "w9_cost_savings": _with("telemetry", windowed("telemetry", 900, None, "vehid", f"{six(f'SUM(fuel_consumed_l * {FUEL_PRICE})')} AS fuel_cost, {six(f'SUM(CASE WHEN driver_behavior_score < 0.8 THEN fuel_consumed_l * {FUEL_PRICE} * 0.1 ELSE 0 END)')} AS driving_savings, {six(f'SUM(CASE WHEN idle_time_min > 10 THEN idle_time_min / 60 * 0.5 * {FUEL_PRICE} ELSE 0 END)')} AS idle_savings")),
        "w10_metric_agg": _with("readings", " UNION ALL ".join(windowed("readings", 300, 60, "vehicle_id", f"'{m}' AS metric, COUNT({m}) AS n, {six(f'AVG({m})')} AS mean, MIN({m}) AS low, MAX({m}) AS high, {six(f'STDDEV_POP({m})')} AS std, {six(f'quantile_cont({m}, 0.5)')} AS median, {six(f'quantile_cont({m}, 0.95)')} AS p95") for m in windows.KINDS)),
        "w12_driving_patterns": _with("readings", f"SELECT * FROM ({patterns}) AS p"),
        "w13_enrich_stream": _with("vehicles,telemetry", "SELECT l_orderkey, l_linenumber, l_partkey, t.vehid, engine_type, is_turbo, weight_category FROM telemetry t LEFT JOIN vehicles v ON t.vehid = v.vehid"),
        "w14_fault_join": _with("readings", "SELECT r.vehicle_id, r.event_id AS reading_id, r.ts AS reading_ts, r.speed_kmh, f.event_id AS fault_id, f.ts AS fault_ts FROM readings r JOIN readings f ON r.vehicle_id = f.vehicle_id AND f.event_type = 'error' AND f.ts >= r.ts AND f.ts <= r.ts + INTERVAL '30' MINUTE"),
        "w19_stream_metrics": _with("vehicles,telemetry", f"SELECT l_orderkey, l_linenumber, l_partkey, t.vehid, CASE WHEN fault_codes IS NULL THEN 'NONE' ELSE CASE regexp_extract(fault_codes, '(P030[0-4]|P0420|P0171|P0172|P0442)', 1) WHEN '' THEN 'INFO' WHEN 'P0420' THEN 'WARNING' WHEN 'P0171' THEN 'WARNING' WHEN 'P0172' THEN 'WARNING' WHEN 'P0442' THEN 'WARNING' ELSE 'CRITICAL' END END AS fault_severity, {six(f'fuel_consumed_l * {co2("v.engine_type", "2.31")}')} AS co2_kg, {six(f'fuel_consumed_l * {FUEL_PRICE} / NULLIF(trip_distance_km, 0)')} AS cost_per_km, {six('driver_behavior_score * 100 - CASE WHEN has_fault THEN 10 ELSE 0 END')} AS trip_score FROM telemetry t LEFT JOIN vehicles v ON t.vehid = v.vehid"),
        "w21_component_health": _with("readings", f"SELECT *, CASE WHEN health < 10 THEN 1 WHEN health < 20 THEN 3 WHEN health < 30 THEN 7 END AS days_left, CASE WHEN health < 30 THEN 'critical' WHEN health < 70 THEN 'warning' ELSE 'healthy' END AS state FROM ({health('engine', loss_engine)} UNION ALL {health('brakes', loss_brakes)} UNION ALL {health('battery', loss_battery)}) AS h"),
        "w22_message_stats": _with("readings", f"SELECT vehicle_id, COUNT(*) AS messages, MAX(ts) AS last_seen, {six('SUM(speed_kmh)')} AS total_speed, MAX(speed_kmh) AS max_speed, {six('AVG(speed_kmh / NULLIF(rpm, 0))')} AS speed_rpm_ratio, {six('MAX(engine_temperature_c) - MIN(engine_temperature_c)')} AS temperature_range FROM readings GROUP BY vehicle_id"),
        "w23_latest_by_vehicle": _with("readings", "SELECT vehicle_id, ts, event_id, speed_kmh, engine_temperature_c FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id DESC) AS n FROM readings) AS r WHERE n = 1"),
        "w23_last_n": _with("readings", "SELECT vehicle_id, event_id, n AS nth FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id DESC) AS n FROM readings) AS r WHERE n <= 50"),
        "w1_late_rows_dropped": replay_sql(f"""SELECT make_timestamp(w * 1000000) AS window_start, make_timestamp((w + 60) * 1000000) AS window_end, event_type, COUNT(*) AS readings
FROM (SELECT *, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS w FROM sliced) AS x WHERE (w + 60) * 1000 > before AND (w + 60) * 1000 <= (SELECT mark FROM last) GROUP BY w, event_type"""),
        "w1_late_by_slice": replay_sql("""SELECT slice, COUNT(*) AS rows_read, COUNT(DISTINCT CASE WHEN (w + 60) * 1000 <= before THEN CAST(w AS VARCHAR) || event_type END) AS groups_dropped
FROM (SELECT *, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS w FROM sliced) AS x GROUP BY slice"""),
        "w11_zscore_stream": replay_sql(f"SELECT vehicle_id, event_id, ts, value, z_score, anomaly_score, severity FROM ({over_passed(features.rolling_zscore.build(ORACLE))}) AS z"),
        "w14_fault_join_streams": f"""WITH {oracle_ctes(["readings"])}, {sliced_sql("r", "readings", LATE, HOURS)}, faults AS (SELECT * FROM readings WHERE event_type = 'error'), {sliced_sql("f", "faults", LATE_FAULTS, FAULT_HOURS)},
marks AS (SELECT slice, least((SELECT MAX(mark) FROM r_marks WHERE r_marks.slice <= s.slice), (SELECT MAX(mark) FROM f_marks WHERE f_marks.slice <= s.slice)) AS mark FROM (SELECT slice FROM r_marks UNION SELECT slice FROM f_marks) AS s),
before AS (SELECT slice, COALESCE(LAG(mark) OVER (ORDER BY slice), 0) AS before FROM marks),
r AS (SELECT r_rows.* FROM r_rows JOIN before USING (slice) WHERE epoch_us(ts) > before * 1000), f AS (SELECT f_rows.* FROM f_rows JOIN before USING (slice) WHERE epoch_us(ts) > before * 1000)
SELECT r.vehicle_id, r.event_id AS reading_id, r.ts AS reading_ts, r.speed_kmh, f.event_id AS fault_id, f.ts AS fault_ts FROM r JOIN f ON r.vehicle_id = f.vehicle_id AND f.ts >= r.ts AND f.ts <= r.ts + INTERVAL '30' MINUTE""",
        "w16_vehicle_runs": replay_sql(f"""SELECT vehicle_id, started, last_update, events, distance, faults, TRUE AS expired FROM (SELECT vehicle_id, MIN(ts) AS started, MAX(ts) AS last_update, COUNT(*) AS events, {six('SUM(speed_kmh / 60)')} AS distance,
  COUNT(*) FILTER (WHERE event_type = 'error') AS faults, run < MAX(run) OVER (PARTITION BY vehicle_id) AS followed FROM (SELECT *, SUM(CASE WHEN epoch_us(ts) - epoch_us(was) > {RUN_TIMEOUT_S * 1000000} THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS run
  FROM (SELECT *, LAG(ts) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS was FROM passed) AS l) AS x GROUP BY vehicle_id, run) AS g WHERE followed OR epoch_us(last_update) // 1000 + {RUN_TIMEOUT_S * 1000} < (SELECT mark FROM last)"""),
        "w18_alert_stream": replay_sql(f"SELECT vehicle_id, event_id, ts, alert_type, priority, heat_rise, mean_voltage FROM ({over_passed(features.generate_alerts.build(ORACLE))}) AS a"),
        "w24_firing_stream": replay_sql(f"""SELECT i.vehicle_id, alert, since, until, readings, required_s FROM ({over_passed(features.sustained_alerts.build(ORACLE, stale_s=STALE_S, time_scale=TIME_SCALE))}) AS i
JOIN (SELECT vehicle_id, MAX(ts) AS newest FROM passed GROUP BY vehicle_id) AS v ON i.vehicle_id = v.vehicle_id WHERE until < newest OR epoch_us(newest) // 1000 + {(STALE_S * TIME_SCALE + 1) * 1000} < (SELECT mark FROM last)""", 1000),
        "w4_sessions_stream": _with("readings", f"SELECT * FROM ({sessions(900)}) AS s WHERE window_end <= (SELECT MAX(ts) - INTERVAL '10' MINUTE FROM readings)"),
    }
    out["w21_health_stream"] = out["w21_component_health"]
    return out
