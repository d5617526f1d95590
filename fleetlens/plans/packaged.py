"""Packaged queries, stored views, the daily roll-up, the anomaly table function and point lookups.

Fixed values: the thresholds, weights, labels and advice texts in these queries are what results must hold; they stand where they
are used.
"""

from __future__ import annotations

from ..rules import FUEL_PRICE
from .dialect import AS_OF, AS_OF_READINGS, banded, op
from .parts import n_if

IDLE_SHARE = "idle_time_min / NULLIF(trip_duration_min, 0) * 100"


@op("p1_daily_usage_by_class", "telemetry")
def daily_usage_by_class(d):
    """Every day's trips by type and class, without rows that sum up others."""
    return f"""SELECT CAST(ts AS DATE) AS usage_date, vehicle_type, vehicle_class, COUNT(DISTINCT vehid) AS active_vehicles, COUNT(*) AS total_trips, {d.r4('SUM(trip_distance_km)')} AS total_distance_km, {d.r6('AVG(trip_distance_km)')} AS avg_trip_distance, {d.r4('SUM(trip_duration_min)')} AS total_minutes
FROM telemetry WHERE trip_id NOT LIKE '%SUMMARY' GROUP BY CAST(ts AS DATE), vehicle_type, vehicle_class"""


@op("p2_efficiency_by_configuration", "telemetry", "vehicles")
def efficiency_by_configuration(d):
    """Efficiency of trips by type, class, engine, turbo and weight, without rows that sum up others."""
    keys, x = "v.vehicle_type, v.vehicle_class, v.engine_type, v.is_turbo, v.weight_category", "t.fuel_efficiency_kmpl"
    return f"""SELECT {keys}, COUNT(*) AS trip_count, {d.r6(f'AVG({x})')} AS avg_efficiency, {d.r6(d.pct(x, 0.5))} AS median_efficiency, {d.r6(f'MIN({x})')} AS min_efficiency, {d.r6(f'MAX({x})')} AS max_efficiency, {d.r6(f'STDDEV_SAMP({x})')} AS efficiency_stddev
FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid WHERE {x} > 0 AND t.trip_id NOT LIKE '%SUMMARY' GROUP BY {keys}"""


@op("p3_maintenance_by_group", "telemetry", "vehicles")
def maintenance_by_group(d):
    """Fault and maintenance rates of vehicles by type, class and engine."""
    return f"""SELECT vehicle_type, vehicle_class, engine_type, COUNT(*) AS vehicle_count, {d.r6('AVG(fault)')} AS fault_rate_percent, {d.r6('AVG(flag)')} AS maintenance_rate_percent, {d.r6('AVG(temp)')} AS avg_engine_temp, {d.r6('AVG(idle)')} AS avg_idle_percentage,
  {banded(d.r6('AVG(fault)'), [('> 5', "'High Maintenance'"), ('> 2', "'Medium Maintenance'")], "'Low Maintenance'")} AS maintenance_category
FROM (SELECT v.vehid, v.vehicle_type, v.vehicle_class, v.engine_type, {d.share('t.has_fault')} AS fault, {d.share('t.maintenance_flag')} AS flag, AVG(t.avg_engine_temp_c) AS temp, {d.div('SUM(t.idle_time_min)', 'SUM(t.trip_duration_min)')} * 100 AS idle
  FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid GROUP BY v.vehid, v.vehicle_type, v.vehicle_class, v.engine_type) AS g GROUP BY vehicle_type, vehicle_class, engine_type"""


@op("p4_idle_by_day", "telemetry", "vehicles")
def idle_by_day(d):
    """Idling by class, engine and day, with quartiles."""
    q = lambda p: d.r6(d.pct("t.idle_time_min", p))
    return f"""SELECT v.vehicle_class, v.engine_type, CAST(t.ts AS DATE) AS day, {d.r6(f'AVG({IDLE_SHARE})')} AS avg_idle_percentage, {d.r4('SUM(t.idle_time_min)')} AS total_idle_minutes, COUNT(DISTINCT t.vehid) AS vehicles_analyzed, {q(0.25)} AS idle_p25, {q(0.5)} AS idle_median, {q(0.75)} AS idle_p75
FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid WHERE t.trip_duration_min > 0 GROUP BY v.vehicle_class, v.engine_type, CAST(t.ts AS DATE)"""


@op("p5_fault_frequency", "telemetry")
def fault_frequency(d):
    """Fault-code sets by type and class, with their share of all faults."""
    return f"""SELECT *, {d.r6('fault_count * 100.0 / SUM(fault_count) OVER ()')} AS fault_percentage, {banded('fault_count', [('> 10', "'Critical'"), ('> 5', "'High'"), ('> 2', "'Medium'")], "'Low'")} AS severity_level
FROM (SELECT vehicle_type, vehicle_class, fault_codes, COUNT(*) AS fault_count, COUNT(DISTINCT vehid) AS affected_vehicles, CAST(MIN(ts) AS DATE) AS first_occurrence, CAST(MAX(ts) AS DATE) AS last_occurrence, MAX(nth) AS longest_sequence
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehid ORDER BY ts, l_orderkey, l_linenumber, l_partkey) AS nth FROM telemetry WHERE has_fault) AS f GROUP BY vehicle_type, vehicle_class, fault_codes) AS g"""


@op("p6_hybrid_and_combustion", "telemetry", "vehicles")
def hybrid_and_combustion(d):
    """Vehicle types side by side."""
    return f"""SELECT v.vehicle_type, v.vehicle_class, v.engine_type, v.is_turbo, COUNT(DISTINCT t.vehid) AS vehicle_count, {d.r6('AVG(t.fuel_efficiency_kmpl)')} AS avg_fuel_efficiency, {d.r6('AVG(t.trip_distance_km)')} AS avg_trip_distance, {d.r6('AVG(t.avg_speed_kmph)')} AS avg_speed,
  {d.r6(f'AVG({IDLE_SHARE})')} AS avg_idle_percentage, {d.r6(d.share('t.has_fault'))} AS fault_rate_percent, {d.r6('AVG(t.driver_behavior_score)')} AS avg_driver_score FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid GROUP BY v.vehicle_type, v.vehicle_class, v.engine_type, v.is_turbo"""


@op("p7_driver_categories", "telemetry")
def driver_categories(d):
    """Drivers by category of their average score."""
    return f"""SELECT vehicle_type, vehicle_class, {banded('score', [('>= 0.9', "'Excellent'"), ('>= 0.8', "'Good'"), ('>= 0.7', "'Average'"), ('>= 0.6', "'Needs Improvement'")], "'Poor'")} AS driver_category, COUNT(*) AS driver_count, {d.r6('AVG(score)')} AS avg_driver_score, {d.r6('AVG(p10)')} AS avg_score_p10, {d.r6('AVG(p90)')} AS avg_score_p90,
  {d.r6('AVG(eff)')} AS avg_fuel_efficiency, {d.r6('AVG(speed)')} AS avg_speed, {d.r6('AVG(trips)')} AS avg_trips_per_driver
FROM (SELECT vehid, vehicle_type, vehicle_class, {d.r6('AVG(driver_behavior_score)')} AS score, {d.pct('driver_behavior_score', 0.1)} AS p10, {d.pct('driver_behavior_score', 0.9)} AS p90, COUNT(*) AS trips, AVG(fuel_efficiency_kmpl) AS eff, AVG(avg_speed_kmph) AS speed FROM telemetry GROUP BY vehid, vehicle_type, vehicle_class) AS g GROUP BY 1, 2, 3"""


@op("p8_cost_by_class", "telemetry")
def cost_by_class(d):
    """Fuel, and 150 for each maintenance flag, by type and class."""
    return f"""SELECT vehicle_type, vehicle_class, COUNT(*) AS vehicle_count, {d.r4('SUM(km)')} AS total_distance, {d.r4('SUM(fuel)')} AS total_fuel_cost, CAST(SUM(repair) AS BIGINT) AS total_maintenance_cost, {d.r4('SUM(fuel + repair)')} AS total_operating_cost, {d.r6('AVG(fuel / km * 100)')} AS cost_per_100km, {d.r6('AVG(faults)')} AS fault_rate_percent
FROM (SELECT vehid, vehicle_type, vehicle_class, SUM(fuel_consumed_l) * {FUEL_PRICE} AS fuel, SUM(trip_distance_km) AS km, {d.share('has_fault')} AS faults, {n_if('maintenance_flag')} * 150 AS repair FROM telemetry GROUP BY vehid, vehicle_type, vehicle_class) AS g GROUP BY vehicle_type, vehicle_class"""


@op("v1_vehicle_performance", "vehicles", "telemetry")
def vehicle_performance(d, as_of=AS_OF, days=30):
    """Every vehicle's last 30 days; vehicles without trips too."""
    return f"""SELECT v.vehid, v.vehicle_type, v.vehicle_class, v.engine_type, COALESCE(n, 0) AS total_trips, {d.r4('km')} AS total_distance_km, {d.r6('eff')} AS avg_efficiency, COALESCE(faults, 0) AS total_faults, COALESCE(flags, 0) AS maintenance_alerts, {d.r6('score')} AS avg_driver_score, latest AS last_trip_date
FROM vehicles v LEFT JOIN (SELECT vehid, COUNT(*) AS n, SUM(trip_distance_km) AS km, AVG(fuel_efficiency_kmpl) AS eff, {n_if('has_fault')} AS faults, {n_if('maintenance_flag')} AS flags, AVG(driver_behavior_score) AS score, MAX(ts) AS latest FROM telemetry WHERE {d.since(days, as_of)} GROUP BY vehid) AS t ON v.vehid = t.vehid"""


@op("v2_fleet_efficiency_daily", "telemetry")
def fleet_efficiency_daily(d, as_of=AS_OF, days=90):
    """Efficiency, faults and driving by day and type."""
    return f"""SELECT CAST(ts AS DATE) AS day, vehicle_type, COUNT(DISTINCT vehid) AS active_vehicles, {d.r4('SUM(trip_distance_km)')} AS total_distance_km, {d.r4('SUM(fuel_consumed_l)')} AS total_fuel_l, {d.r6('AVG(fuel_efficiency_kmpl)')} AS avg_efficiency_kmpl, {n_if('has_fault')} AS total_faults, {d.r6('AVG(driver_behavior_score)')} AS avg_driver_score
FROM telemetry WHERE {d.since(days, as_of)} GROUP BY CAST(ts AS DATE), vehicle_type"""


@op("v3_maintenance_prediction", "vehicles", "maintenance_history", "telemetry")
def maintenance_prediction(d, as_of=AS_OF, days=30):
    """Where each vehicle stands in its service interval."""
    return f"""SELECT v.vehid, vehicle_type, vehicle_class, engine_type, odometer_km, last_service_km, service_interval_km, odometer_km - last_service_km AS km_since_last_service,
  CASE WHEN odometer_km - last_service_km >= service_interval_km THEN 'IMMEDIATE' WHEN odometer_km - last_service_km >= service_interval_km * 0.8 THEN 'SOON' ELSE 'OK' END AS maintenance_urgency, COALESCE(n, 0) AS past_maintenance_count, latest AS last_maintenance_date, COALESCE(faults, 0) AS recent_faults
FROM vehicles v LEFT JOIN (SELECT vehid, COUNT(*) AS n, MAX(maintenance_date) AS latest FROM maintenance_history GROUP BY vehid) AS m ON v.vehid = m.vehid LEFT JOIN (SELECT vehid, {n_if('has_fault')} AS faults FROM telemetry WHERE {d.since(days, as_of)} GROUP BY vehid) AS t ON v.vehid = t.vehid"""


@op("f1_daily_aggregation", "telemetry")
def daily_aggregation(d):
    """The roll-up of each vehicle and day, as the daily table holds it."""
    return f"""SELECT CAST(ts AS DATE) AS aggregation_date, vehid, vehicle_type, vehicle_class, {d.r4('SUM(trip_distance_km)')} AS total_distance_km, {d.r4('SUM(fuel_consumed_l)')} AS total_fuel_l, {d.r6('AVG(fuel_efficiency_kmpl)')} AS avg_efficiency_kmpl, {d.r4('SUM(idle_time_min)')} AS total_idle_time_min, {n_if('has_fault')} AS fault_count, {n_if('maintenance_flag')} AS maintenance_alerts, {d.r6('AVG(driver_behavior_score)')} AS avg_driver_score,
  CAST(SUM(harsh_acceleration_count) AS BIGINT) AS harsh_acceleration_total, CAST(SUM(harsh_braking_count) AS BIGINT) AS harsh_braking_total, CAST(SUM(speeding_count) AS BIGINT) AS speeding_total, MAX(avg_speed_kmph) AS max_speed_kmph, MIN(avg_engine_temp_c) AS min_engine_temp_c, MAX(avg_engine_temp_c) AS max_engine_temp_c
FROM telemetry GROUP BY CAST(ts AS DATE), vehid, vehicle_type, vehicle_class"""


@op("f2_telemetry_anomalies", "telemetry")
def telemetry_anomalies(d):
    """Overheating, low efficiency and long idling, each with a severity."""

    def rule(kind, x, test, critical, warning, label, unit):
        shown = f"CAST(CAST({d.r2(x)} AS DECIMAL(12,2)) AS STRING)"
        return f"SELECT vehid, '{kind}' AS anomaly_type, CASE WHEN {x} {critical} THEN 'CRITICAL' WHEN {x} {warning} THEN 'WARNING' ELSE 'INFO' END AS severity, ts, CONCAT('{label}: ', {shown}, '{unit}') AS description FROM telemetry WHERE {x} {test}"

    return " UNION ALL ".join([
        rule("OVERHEATING", "avg_engine_temp_c", "> 110", "> 115", "> 110", "Engine temperature", " C"),
        rule("LOW_EFFICIENCY", "fuel_efficiency_kmpl", "< 8", "< 5", "< 8", "Fuel efficiency", " km/L"),
        rule("EXCESSIVE_IDLING", d.r6("idle_time_min"), "> 15", "> 30", "> 15", "Idle time", " minutes"),
    ])


@op("k1_vehicle_range", "readings")
def vehicle_range(d, vehicle=7, start="2024-01-05", end="2024-01-20"):
    """Readings of a vehicle in a range of time."""
    return f"SELECT event_id, vehicle_id, ts, speed_kmh, engine_temperature_c, fuel_level_percent FROM readings WHERE vehicle_id = {vehicle} AND ts >= {d.ts(start)} AND ts < {d.ts(end)}"


@op("k1_latest_readings", "readings")
def latest_readings(d, n=3):
    """The latest readings of every vehicle."""
    return f"SELECT vehicle_id, nth, ts, event_id, speed_kmh FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY ts DESC, event_id DESC) AS nth FROM readings) AS r WHERE nth <= {n}"


@op("k1_speed_statistics", "readings")
def speed_statistics(d):
    """Speeds of each vehicle: mean, extremes, deviation."""
    return f"SELECT vehicle_id, COUNT(*) AS readings, {d.r6('AVG(speed_kmh)')} AS avg_speed, MIN(speed_kmh) AS min_speed, MAX(speed_kmh) AS max_speed, {d.r6('STDDEV_SAMP(speed_kmh)')} AS speed_stddev FROM readings GROUP BY vehicle_id"


@op("k1_temperature_alerts", "readings")
def temperature_alerts(d, limit_c=110):
    """Readings over a temperature."""
    return f"SELECT vehicle_id, ts, event_id, engine_temperature_c, CASE WHEN engine_temperature_c > {limit_c + 10} THEN 'CRITICAL' ELSE 'HIGH' END AS level FROM readings WHERE engine_temperature_c > {limit_c}"


@op("k1_fuel_level_change", "readings")
def fuel_level_change(d):
    """Fuel level of a reading against the one before."""
    return "SELECT vehicle_id, ts, event_id, fuel_level_percent, fuel_level_percent - LAG(fuel_level_percent) OVER (PARTITION BY vehicle_id ORDER BY ts, event_id) AS fuel_change FROM readings"


@op("k1_vehicle_metrics", "readings", "alerts")
def vehicle_metrics(d, now=AS_OF_READINGS):
    """A vehicle's counts, latest reading, and open alerts."""
    return f"""SELECT r.vehicle_id, readings, latest, {d.seconds('latest', d.ts(now))} AS seconds_since, COALESCE(open_alerts, 0) AS open_alerts FROM (SELECT vehicle_id, COUNT(*) AS readings, MAX(ts) AS latest FROM readings GROUP BY vehicle_id) AS r
LEFT JOIN (SELECT vehid, COUNT(*) AS open_alerts FROM alerts WHERE status = 'ACTIVE' GROUP BY vehid) AS a ON r.vehicle_id = a.vehid"""


@op("k1_fleet_by_status", "vehicles", "alerts")
def fleet_by_status(d):
    """Vehicles by type and by whether a critical alert is open."""
    return """SELECT vehicle_type, CASE WHEN c.vehid IS NULL THEN 'ok' ELSE 'alert' END AS state, COUNT(*) AS vehicles FROM vehicles v LEFT JOIN (SELECT DISTINCT vehid FROM alerts WHERE status = 'ACTIVE' AND severity = 'CRITICAL') AS c ON v.vehid = c.vehid GROUP BY vehicle_type, CASE WHEN c.vehid IS NULL THEN 'ok' ELSE 'alert' END"""
