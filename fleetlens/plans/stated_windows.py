"""Oracle SQL of windows and fleet figures, stated from the rules: windows as self-joins over numbered rows, slopes by sums."""

from __future__ import annotations

from ..rules import FUEL_PRICE


def places(x: str, n: int) -> str:
    """Rounded to n places, as operators round."""
    return f"ROUND(CAST({x} AS DOUBLE) + 1.3e-{n + 3}, {n})"


def six(x: str) -> str:
    return places(x, 6)


SEQ = "seq AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS n FROM readings)"
TRIPS = "trips AS (SELECT *, CAST(fuel_efficiency_kmpl AS DOUBLE) AS eff, ROW_NUMBER() OVER (PARTITION BY vehid ORDER BY ts, l_orderkey, l_linenumber, l_partkey, fuel_efficiency_kmpl) AS n FROM telemetry)"
TRIP = "r.l_orderkey, r.l_linenumber, r.l_partkey, r.vehid, r.ts"


def back(size: int, x: str = "r.n - p.n") -> str:
    return f"FILTER (WHERE {x} < {size})"


def rolling(sizes=(5, 15, 30, 60)) -> str:
    cols = [f"""{six(f'AVG(p.speed_kmh) {back(k)}')} AS mean_{k}, {six(f'STDDEV_SAMP(p.speed_kmh) {back(k)}')} AS std_{k}, MIN(p.speed_kmh) {back(k)} AS min_{k}, MAX(p.speed_kmh) {back(k)} AS max_{k},
  {six(f'ANY_VALUE(r.speed_kmh) / NULLIF(MAX(p.speed_kmh) FILTER (WHERE r.n - p.n = {k}), 0) - 1')} AS change_{k}""" for k in sizes]  # fmt: skip
    return f"""{SEQ} SELECT r.event_id, r.vehicle_id, r.ts, {', '.join(cols)}
FROM seq r JOIN seq p ON p.vehicle_id = r.vehicle_id AND p.n BETWEEN r.n - {max(sizes)} AND r.n GROUP BY r.event_id, r.vehicle_id, r.ts"""


def lags(of=(1, 2, 3, 5)) -> str:
    cols = ", ".join(f"l{k}.speed_kmh AS lag_{k}, {six(f'r.speed_kmh - l{k}.speed_kmh')} AS diff_{k}" for k in of)
    joins = " ".join(f"LEFT JOIN seq l{k} ON l{k}.vehicle_id = r.vehicle_id AND l{k}.n = r.n - {k}" for k in of)
    return f"{SEQ} SELECT r.event_id, r.vehicle_id, r.ts, {cols} FROM seq r {joins}"


def compared(by: str) -> str:
    return f"""g AS (SELECT v.{by}, COUNT(DISTINCT v.vehid) AS vehicle_count, {six('SUM(fuel_efficiency_kmpl) / COUNT(*)')} AS avg_efficiency, {six('sqrt(VAR_SAMP(fuel_efficiency_kmpl))')} AS efficiency_std,
  MIN(fuel_efficiency_kmpl) AS min_efficiency, MAX(fuel_efficiency_kmpl) AS max_efficiency, {places('SUM(trip_distance_km)', 2)} AS total_distance, {places('SUM(fuel_consumed_l)', 2)} AS total_fuel,
  {places(f'SUM(fuel_consumed_l * {FUEL_PRICE})', 2)} AS fuel_cost, {six(f'{FUEL_PRICE} / (SUM(trip_distance_km) / SUM(fuel_consumed_l))')} AS cost_per_km FROM telemetry t, vehicles v WHERE v.vehid = t.vehid GROUP BY v.{by})
SELECT g.*, {six('100 * (avg_efficiency / best)')} AS efficiency_score, {places('(best / avg_efficiency - 1) * fuel_cost', 2)} AS potential_savings FROM g, (SELECT MAX(avg_efficiency) AS best FROM g) AS b"""


#: key: the views that it needs, and the statement behind them.
WINDOWS: dict[str, tuple[list[str], str]] = {
    "n8_rolling_features": (["readings"], rolling()),
    "n9_lag_features": (["readings"], lags()),
    "w11_rolling_zscore": (["readings"], f"""{SEQ},
behind AS (SELECT r.event_id, r.vehicle_id, r.ts, r.speed_kmh AS value, AVG(p.speed_kmh) AS m, STDDEV_POP(p.speed_kmh) AS s FROM seq r JOIN seq p ON p.vehicle_id = r.vehicle_id AND p.n BETWEEN r.n - 100 AND r.n - 1
  GROUP BY ALL HAVING COUNT(*) >= 10),
judged AS (SELECT *, {six('ABS(value - m) / s')} AS z_score FROM behind WHERE s > 0)
SELECT event_id, vehicle_id, ts, value, {six('m')} AS mean, {six('s')} AS std, z_score, CASE WHEN z_score >= 6 THEN {six('1')} ELSE {six('z_score / 6')} END AS anomaly_score,
  CASE WHEN z_score <= 3 THEN 'low' WHEN z_score <= 4 THEN 'medium' WHEN z_score <= 5 THEN 'high' ELSE 'critical' END AS severity FROM judged WHERE z_score > 2"""),
    "w15_sessionize": (["readings"], f"""{SEQ},
begun AS (SELECT r.vehicle_id, r.n, ROW_NUMBER() OVER (PARTITION BY r.vehicle_id ORDER BY r.n) AS session FROM seq r LEFT JOIN seq p ON p.vehicle_id = r.vehicle_id AND p.n = r.n - 1
  WHERE p.n IS NULL OR floor(epoch(r.ts) - epoch(p.ts)) > 900)
SELECT r.vehicle_id, session, COUNT(*) AS readings, MIN(ts) AS started, MAX(ts) AS ended, CAST(floor(epoch(MAX(ts)) - epoch(MIN(ts))) AS BIGINT) AS seconds, {six('SUM(speed_kmh) / COUNT(speed_kmh)')} AS avg_speed,
  MAX(speed_kmh) AS max_speed, {six('MAX(odometer_km) - MIN(odometer_km)')} AS distance_km FROM seq r ASOF JOIN begun b ON r.vehicle_id = b.vehicle_id AND r.n >= b.n GROUP BY ALL"""),
    "w25_rollup_over_time": (["readings"], f"""timed AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM readings)
SELECT r.event_id, r.vehicle_id, r.ts, {six(f"AVG(p.speed_kmh) {back(18001, 'r.s - p.s')}")} AS speed_avg, MAX(p.speed_kmh) {back(18001, 'r.s - p.s')} AS speed_max, {six('AVG(p.fuel_level_percent)')} AS fuel_avg,
  COUNT(*) FILTER (WHERE p.event_type = 'error') AS errors FROM timed r JOIN timed p ON p.vehicle_id = r.vehicle_id AND p.s BETWEEN r.s - 86400 AND r.s GROUP BY r.event_id, r.vehicle_id, r.ts"""),
    "e14_rolling_efficiency": (["telemetry"], f"""{TRIPS},
sums AS (SELECT {TRIP}, r.n, COUNT(*) AS k, SUM(p.eff) AS y, SUM(p.n - r.n) AS x, SUM((p.n - r.n) * p.eff) AS xy, SUM((p.n - r.n) * (p.n - r.n)) AS xx FROM trips r JOIN trips p ON p.vehid = r.vehid AND p.n BETWEEN r.n - 9 AND r.n GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, vehid, ts, CASE WHEN k >= 5 THEN {six('y / k')} END AS efficiency_ma_10, CASE WHEN k >= 5 THEN {six('(k * xy - x * y) / (k * xx - x * x)')} END AS efficiency_trend FROM sums"""),
    "m1_maintenance_features": (["vehicles", "telemetry"], f"""{TRIPS},
sums AS (SELECT r.vehid, r.n, COUNT(*) AS k, AVG(p.eff) {back(10)} AS mean, STDDEV_SAMP(p.avg_rpm) {back(5)} AS rpm, SUM(p.harsh_braking_count) {back(20)} AS brakes,
  COUNT(*) FILTER (WHERE p.has_fault AND r.n - p.n < 50) AS faults, COUNT(*) FILTER (WHERE p.maintenance_flag) AS flags FROM trips r JOIN trips p ON p.vehid = r.vehid AND p.n BETWEEN r.n - 99 AND r.n GROUP BY r.vehid, r.n),
rolled AS (SELECT *, CASE WHEN k >= 5 THEN mean END AS ma FROM sums),
firsts AS (SELECT vehid, mean AS usual FROM sums WHERE n = 5)
SELECT {TRIP}, r.n AS nth, {six('r.avg_rpm * r.avg_engine_temp_c * CASE WHEN v.is_turbo THEN 12 ELSE 10 END / 1000000')} AS engine_stress, {six('ma')} AS efficiency_ma, {six('100 - 100 * ma / usual')} AS efficiency_degradation,
  r.avg_engine_temp_c > 105 AS temp_anomaly, CASE WHEN k >= 3 THEN {six('rpm')} END AS rpm_variance, CASE WHEN k >= 10 THEN {six('brakes')} END AS brake_wear_indicator, CASE WHEN k >= 25 THEN {six('faults')} END AS fault_history,
  CASE WHEN k >= 50 THEN {six('flags')} END AS maintenance_history, CAST(EXTRACT(hour FROM r.ts) AS INT) AS hour_of_day, CAST((EXTRACT(dow FROM r.ts) + 6) % 7 AS INT) AS day_of_week, {six('r.trip_distance_km * r.avg_speed_kmph / 100')} AS trip_intensity, {six('1 - r.driver_behavior_score')} AS driver_impact
FROM trips r JOIN vehicles v ON v.vehid = r.vehid JOIN rolled w ON w.vehid = r.vehid AND w.n = r.n LEFT JOIN firsts f ON f.vehid = r.vehid"""),
    "a1_kpi_summary": (["telemetry"], f"""each AS (SELECT vehid, COUNT(*) AS n, SUM(trip_distance_km) AS km, SUM(fuel_consumed_l) AS fuel, SUM(fuel_efficiency_kmpl) AS eff, SUM(trip_duration_min) AS minutes, SUM(idle_time_min) AS idle,
  SUM(CAST(has_fault AS INT)) AS faults, SUM(CAST(maintenance_flag AS INT)) AS flags FROM telemetry GROUP BY vehid)
SELECT CAST(SUM(n) AS BIGINT) AS total_trips, COUNT(*) AS unique_vehicles, {places('SUM(km)', 2)} AS total_distance_km, {places('SUM(fuel)', 2)} AS total_fuel_consumed_l, {six('SUM(eff) / SUM(n)')} AS avg_fuel_efficiency, {six('SUM(km) / SUM(n)')} AS avg_trip_distance,
  {six('SUM(minutes) / SUM(n)')} AS avg_trip_duration, {places('SUM(idle) / 60', 2)} AS total_idle_time_hours, {six('100 * SUM(faults) / SUM(n)')} AS fault_rate, {six('100 * SUM(flags) / SUM(n)')} AS maintenance_flag_rate FROM each"""),
    "a1_kpi_by_type": (["telemetry"], f"SELECT vehicle_type, {six('SUM(fuel_efficiency_kmpl) / COUNT(*)')} AS avg_efficiency, {six('AVG(CASE WHEN has_fault THEN 100 ELSE 0 END)')} AS fault_rate FROM telemetry GROUP BY 1"),
    "a2_daily_efficiency": (["telemetry"], f"SELECT date_trunc('day', ts)::DATE AS day, vehicle_type, {six('SUM(fuel_efficiency_kmpl) / COUNT(*)')} AS avg_efficiency, COUNT(ts) AS trips FROM telemetry GROUP BY ALL"),
    "b3_efficiency_by_road": (["telemetry"], f"SELECT vehid, road_type, {six('SUM(fuel_efficiency_kmpl) / COUNT(*)')} AS avg_efficiency, COUNT(trip_id) AS trip_count, {places('AVG(trip_distance_km) * COUNT(*)', 4)} AS total_distance FROM telemetry GROUP BY ALL"),
    "b4_efficiency_trend": (["telemetry"], f"""days AS (SELECT vehid, date_trunc('day', ts) AS day, AVG(fuel_efficiency_kmpl) AS mean FROM telemetry GROUP BY ALL),
placed AS (SELECT *, DENSE_RANK() OVER (PARTITION BY vehid ORDER BY day) - 1 AS x FROM days),
fit AS (SELECT vehid, COUNT(*) AS days, AVG(mean) AS m, AVG(x) AS mx, COVAR_POP(mean, x) / VAR_POP(x) AS slope, CASE WHEN VAR_POP(mean) > 0 THEN CORR(mean, x) * CORR(mean, x) ELSE 1 END AS r2 FROM placed GROUP BY vehid HAVING COUNT(*) >= 3),
whole AS (SELECT *, {six('slope')} AS slope_per_day FROM fit)
SELECT vehid, days, slope_per_day, {six('3000 * slope / m')} AS percent_per_30_days, CASE sign(slope_per_day) WHEN 1 THEN 'improving' WHEN -1 THEN 'declining' ELSE 'stable' END AS direction, {six('r2')} AS r2, {six('m + slope * (days - mx)')} AS next_value FROM whole"""),
    "b6_outlier_vehicles": (["telemetry"], f"""each AS (SELECT vehid, vehicle_type, vehicle_class, AVG(fuel_efficiency_kmpl) AS mean, COUNT(*) AS trips FROM telemetry GROUP BY ALL HAVING COUNT(*) >= 10),
fleet AS (SELECT AVG(mean) AS centre, STDDEV_SAMP(mean) AS spread FROM each)
SELECT vehid, vehicle_type, vehicle_class, {six('mean')} AS mean_efficiency, {six('ABS(mean - centre) / spread')} AS z_score, {places('100 * mean / centre - 100', 4)} AS deviation_percent,
  CASE WHEN mean > centre THEN 'High' ELSE 'Low' END || ' Efficiency' AS outlier_type, trips FROM each, fleet WHERE ABS(mean - centre) > 1.5 * spread"""),
    "b8_potential_savings": (["vehicles", "telemetry"], f"""sums AS (SELECT v.vehicle_type, COUNT(DISTINCT v.vehid) AS vehicle_count, SUM(trip_distance_km) AS km, SUM(fuel_consumed_l) AS fuel FROM telemetry t JOIN vehicles v USING (vehid) GROUP BY GROUPING SETS ((), (v.vehicle_type)))
SELECT vehicle_type, vehicle_count, {places('km', 4)} AS total_distance_km, {places('fuel', 4)} AS fuel_consumed, {six('km / fuel')} AS current_efficiency, {places(f'(fuel - fuel / 1.1) * {FUEL_PRICE}', 4)} AS cost_savings, {places('(fuel - fuel / 1.1) * 2.31', 4)} AS co2_reduction_kg FROM sums"""),
    "b8_report_summary": (["telemetry"], f"""each AS (SELECT vehicle_type, AVG(fuel_efficiency_kmpl) AS mean FROM telemetry GROUP BY 1)
SELECT {six('(SELECT AVG(fuel_efficiency_kmpl) FROM telemetry)')} AS fleet_efficiency, (SELECT COUNT(*) FROM telemetry) AS trips, (SELECT vehicle_type FROM each ORDER BY mean DESC LIMIT 1) AS best_type,
  (SELECT vehicle_type FROM each ORDER BY mean LIMIT 1) AS worst_type, {six('(SELECT MAX(mean) - MIN(mean) FROM each)')} AS spread"""),
} | {f"b5_compare_by_{by}": (["vehicles", "telemetry"], compared(by)) for by in ("vehicle_type", "vehicle_class", "engine_type", "transmission_type")}
