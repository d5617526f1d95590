"""Data behind dashboards and reports."""

from __future__ import annotations

from ..plans.dialect import AS_OF, AS_OF_READINGS, banded, op
from ..plans.parts import IDLE_COST, co2, n_if
from ..rules import FUEL_PRICE


@op("r1_telemetry_metrics", "readings")
def telemetry_metrics(d):
    """Mean, extremes and deviation of each figure, and counts of speeding, overheating and low fuel."""
    names = ("speed_kmh", "engine_temperature_c", "fuel_level_percent", "rpm", "battery_voltage")
    return " UNION ALL ".join(f"SELECT '{c}' AS metric, {d.r6(f'AVG({c})')} AS mean, MIN({c}) AS low, MAX({c}) AS high, {d.r6(f'STDDEV_SAMP({c})')} AS deviation, {n_if('speed_kmh > 120')} AS speeding, {n_if('engine_temperature_c > 110')} AS overheating, {n_if('fuel_level_percent < 15')} AS low_fuel, {d.seconds('MIN(ts)', 'MAX(ts)')} AS span_s FROM readings" for c in names)


@op("r2_fault_metrics", "alerts")
def fault_metrics(d):
    """Faults by component and severity, open ones, and the ten commonest."""
    return """SELECT alert_type AS component, severity, COUNT(*) AS faults, COUNT(CASE WHEN status = 'ACTIVE' THEN 1 END) AS active, COUNT(DISTINCT vehid) AS vehicles, CASE WHEN severity = 'CRITICAL' THEN 'Inspect now' WHEN COUNT(CASE WHEN status = 'ACTIVE' THEN 1 END) > 20 THEN 'Plan repairs' ELSE 'Monitor' END AS recommendation FROM alerts GROUP BY alert_type, severity"""


@op("r2_maintenance_costs", "maintenance_history")
def maintenance_costs(d):
    """Cost and count by kind of maintenance and month."""
    return f"SELECT {d.month('maintenance_date')} AS month, maintenance_type, COUNT(*) AS events, {d.r2('SUM(cost)')} AS total_cost, {d.r4('AVG(cost)')} AS avg_cost FROM maintenance_history GROUP BY {d.month('maintenance_date')}, maintenance_type"


@op("r3_fleet_metrics", "vehicles", "alerts")
def fleet_metrics(d, year=2024):
    """Vehicles by class and engine: age, odometer, and how many are free of critical alerts."""
    return f"""SELECT vehicle_class, engine_type, COUNT(*) AS vehicles, {d.r4(f'AVG({year} - manufacture_year)')} AS avg_age, MIN(manufacture_year) AS oldest, {d.r4('AVG(odometer_km)')} AS avg_odometer, {d.r4(d.share('c.vehid IS NULL'))} AS availability_percent
FROM vehicles v LEFT JOIN (SELECT DISTINCT vehid FROM alerts WHERE severity = 'CRITICAL' AND status = 'ACTIVE') AS c ON v.vehid = c.vehid GROUP BY vehicle_class, engine_type"""


@op("r3_age_histogram", "vehicles")
def age_histogram(d, bins=7):
    """Vehicles in equal bins of their year."""
    return f"SELECT CAST(LEAST(floor(CAST(manufacture_year - low AS DOUBLE) / NULLIF(high - low, 0) * {bins}), {bins - 1}) AS INT) AS bin, COUNT(*) AS vehicles, MIN(manufacture_year) AS from_year, MAX(manufacture_year) AS to_year FROM vehicles CROSS JOIN (SELECT MIN(manufacture_year) AS low, MAX(manufacture_year) AS high FROM vehicles) AS r GROUP BY 1"


@op("r4_performance_report", "telemetry", "vehicles")
def performance_report(d):
    """Distance, fuel, cost, CO2 and faults by vehicle type, with a line of advice."""
    return f"""SELECT v.vehicle_type, COUNT(*) AS trips, {d.r2('SUM(trip_distance_km)')} AS distance_km, {d.r2('SUM(fuel_consumed_l)')} AS fuel_l, {d.r2(f'SUM(fuel_consumed_l) * {FUEL_PRICE}')} AS fuel_cost, {d.r2(f'SUM(fuel_consumed_l * {co2("v.engine_type")})')} AS co2_kg, {d.r4(d.share('has_fault'))} AS fault_percent,
  CASE WHEN AVG(fuel_efficiency_kmpl) < 10 THEN 'Improve fuel efficiency' WHEN {d.r4(d.share('has_fault'))} > 10 THEN 'Reduce faults' ELSE 'Keep current practice' END AS recommendation FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid GROUP BY v.vehicle_type"""


@op("r5_hourly_usage", "telemetry")
def hourly_usage(d):
    """Trips, faults and idling by hour."""
    return f"SELECT {d.hour('ts')} AS hour, COUNT(*) AS trips, COUNT(DISTINCT vehid) AS vehicles, {d.r4(d.share('has_fault'))} AS fault_rate, {d.r4(d.div('SUM(idle_time_min)', 'SUM(trip_duration_min)') + ' * 100')} AS idle_percent, {d.r4(f'SUM(idle_time_min) {IDLE_COST}')} AS idle_cost FROM telemetry GROUP BY {d.hour('ts')}"


@op("r5_daily_fault_rate", "telemetry")
def daily_fault_rate(d):
    """Faults and maintenance flags by day."""
    return f"SELECT CAST(ts AS DATE) AS day, COUNT(*) AS trips, {d.r4(d.share('has_fault'))} AS fault_rate, {d.r4(d.share('maintenance_flag'))} AS maintenance_rate FROM telemetry GROUP BY CAST(ts AS DATE)"


@op("r5_top_alerts", "alerts")
def top_alerts(d, k=10):
    """The vehicles with most alerts (a top-k report)."""
    return f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY alerts DESC, vehid) AS place FROM (SELECT vehid, COUNT(*) AS alerts, COUNT(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical FROM alerts GROUP BY vehid) AS g) AS r WHERE place <= {k}"


@op("r5_best_and_worst_drivers", "telemetry")
def best_and_worst_drivers(d, k=5):
    """The five best and the five worst by mean driver score (a top-k report)."""
    return f"SELECT vehid, score, trips, CASE WHEN top <= {k} THEN 'top' ELSE 'bottom' END AS side FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, vehid) AS top, ROW_NUMBER() OVER (ORDER BY score, vehid) AS bottom FROM (SELECT vehid, {d.r6('AVG(driver_behavior_score)')} AS score, COUNT(*) AS trips FROM telemetry GROUP BY vehid) AS g) AS r WHERE top <= {k} OR bottom <= {k}"


@op("r5_comparison_table", "telemetry")
def comparison_table(d, as_of=AS_OF, days=365):
    """Efficiency, costs and savings by type over a filtered range."""
    return f"SELECT vehicle_type, COUNT(DISTINCT vehid) AS vehicles, {d.r4('AVG(fuel_efficiency_kmpl)')} AS efficiency, {d.r4(f'SUM(fuel_consumed_l) * {FUEL_PRICE} / SUM(trip_distance_km)')} AS cost_per_km, {d.r2(f'SUM(fuel_consumed_l) * {FUEL_PRICE} * 0.1')} AS route_savings, {d.r2(f'SUM(idle_time_min) {IDLE_COST} * 0.5')} AS idle_savings FROM telemetry WHERE {d.since(days, as_of)} GROUP BY vehicle_type"


@op("r6_calculated_fields", "telemetry")
def calculated_fields(d):
    """The BI fields of each trip."""
    fuel = f"fuel_consumed_l * {FUEL_PRICE}"
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, vehid, ts, {d.r6(f'({fuel}) / NULLIF(trip_distance_km, 0)')} AS cost_per_km, {d.r6(f'({fuel}) / NULLIF(trip_distance_km, 0) * 100')} AS cost_per_100km, {d.r6('LEAST(CAST(100 AS DOUBLE), fuel_efficiency_kmpl / 20 * 100)')} AS efficiency_score,
  CASE WHEN has_fault AND maintenance_flag THEN 'Critical' WHEN has_fault THEN 'High' WHEN maintenance_flag THEN 'Medium' ELSE 'Low' END AS urgency, {d.r6(f'({fuel}) * 0.15')} AS savings_potential, GREATEST(0, 100 - harsh_acceleration_count * 5 - harsh_braking_count * 10 - speeding_count * 3) AS safety_score FROM telemetry"""


@op("r7_metric_scores", "readings")
def metric_scores(d):
    """Metrics of the readings as scores between a good and a poor threshold, with the level."""
    rules = (("avg_temperature_c", "AVG(engine_temperature_c)", 90, 120), ("avg_speed_kmh", "AVG(speed_kmh)", 60, 130), ("overheating_percent", d.share("engine_temperature_c > 110"), 5, 50), ("p95_consumption_lph", d.pct("fuel_consumption_lph", 0.95), 15, 25))
    one = lambda n, x, good, poor: f"SELECT '{n}' AS metric, {d.r6(x)} AS value, {d.r6(f'CASE WHEN {x} <= {good} THEN 100 WHEN {x} >= {poor} THEN 0 ELSE 100 * (1 - ({x} - {good}) / ({poor} - {good})) END')} AS score FROM readings"
    return f"SELECT *, {banded('score', [('>= 90', chr(39) + 'EXCELLENT' + chr(39)), ('>= 75', chr(39) + 'GOOD' + chr(39)), ('>= 60', chr(39) + 'FAIR' + chr(39)), ('>= 40', chr(39) + 'POOR' + chr(39))], chr(39) + 'CRITICAL' + chr(39))} AS level FROM (" + " UNION ALL ".join(one(*r) for r in rules) + ") AS m"


@op("n27_report_findings", "readings", "alerts")
def report_findings(d, now=AS_OF_READINGS):
    """What to improve and to prevent: the drivers with most speeding, and components with open critical alerts."""
    return f"""SELECT 'improve driving' AS finding, driver_id AS subject, {d.r4('speeding')} AS measure FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY speeding DESC, driver_id) AS place FROM (SELECT driver_id, {d.r4(d.share('speed_kmh > 100'))} AS speeding FROM readings GROUP BY driver_id) AS g) AS r WHERE place <= 5
UNION ALL SELECT 'prevent failures', alert_type, CAST(COUNT(*) AS DOUBLE) FROM alerts WHERE severity = 'CRITICAL' AND status = 'ACTIVE' GROUP BY alert_type"""
