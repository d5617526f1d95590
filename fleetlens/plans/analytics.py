"""The analytical pack: usage, efficiency, maintenance, idling, drivers, costs, monitoring, prediction, emissions, summary.

Fixed values: the thresholds, weights, labels and advice texts in these queries are what results must hold; they stand where they
are used.
"""

from __future__ import annotations

from ..rules import FUEL_PRICE, GRID_CO2_PER_KM
from .dialect import AS_OF, AS_OF_READINGS, banded, op
from .parts import IDLE_COST, co2, fitted_benchmark, n_if, spent


@op("q1_1_daily_usage", "telemetry")
def daily_usage(d, as_of=AS_OF, days=30):
    """Trips, distance and hours by day and type, with moving averages over seven rows."""
    week = "OVER (PARTITION BY vehicle_type ORDER BY usage_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    return f"""SELECT usage_date, vehicle_type, active_vehicles, total_trips, {d.r4('km')} AS total_distance_km, {d.r6('km / total_trips')} AS avg_trip_distance,
  {d.r6('minutes / 60')} AS total_hours_driven, {d.r6('speed / total_trips')} AS avg_speed_kmph,
  {d.r6(f'AVG(active_vehicles) {week}')} AS moving_avg_active_vehicles, {d.r6(f'AVG(km) {week}')} AS moving_avg_distance
FROM (SELECT CAST(ts AS DATE) AS usage_date, vehicle_type, COUNT(DISTINCT vehid) AS active_vehicles, COUNT(*) AS total_trips, SUM(trip_distance_km) AS km, SUM(trip_duration_min) AS minutes, SUM(avg_speed_kmph) AS speed
  FROM telemetry WHERE {d.since(days, as_of)} GROUP BY CAST(ts AS DATE), vehicle_type) AS day"""


@op("q1_2_hourly_usage", "telemetry")
def hourly_usage(d, as_of=AS_OF, days=7):
    """Trips by hour of day and type, with the median distance."""
    return f"""SELECT hour_of_day, vehicle_type, COUNT(*) AS trip_count, {d.r4('SUM(trip_distance_km)')} AS total_distance_km, {d.r6('AVG(trip_distance_km)')} AS avg_trip_distance,
  {d.r6('AVG(avg_speed_kmph)')} AS avg_speed_kmph, {d.r6(d.pct('trip_distance_km', 0.5))} AS median_trip_distance
FROM (SELECT *, {d.hour('ts')} AS hour_of_day FROM telemetry WHERE {d.since(days, as_of)}) AS t GROUP BY hour_of_day, vehicle_type"""


@op("q1_3_distance_distribution", "telemetry")
def distance_distribution(d, as_of=AS_OF, days=30):
    """Distance buckets (both ends closed, so 10 and 20 count twice) and quartiles by type and class."""
    x = "trip_distance_km"
    return f"""SELECT vehicle_type, vehicle_class, {n_if(f'{x} < 5')} AS under_5km, {n_if(f'{x} BETWEEN 5 AND 10')} AS km_5_10, {n_if(f'{x} BETWEEN 10 AND 20')} AS km_10_20,
  {n_if(f'{x} BETWEEN 20 AND 50')} AS km_20_50, {n_if(f'{x} > 50')} AS over_50km, COUNT(*) AS total_trips, {d.r6(f'AVG({x})')} AS avg_distance, {d.r6(f'STDDEV_SAMP({x})')} AS stddev_distance,
  {d.r6(d.pct(x, 0.25))} AS p25_distance, {d.r6(d.pct(x, 0.5))} AS median_distance, {d.r6(d.pct(x, 0.75))} AS p75_distance
FROM telemetry WHERE {d.since(days, as_of)} GROUP BY vehicle_type, vehicle_class"""


@op("q2_1_efficiency_comparison", "telemetry", "vehicles", "efficiency_benchmarks")
def efficiency_comparison(d, as_of=AS_OF, days=30):
    """Efficiency by class, engine, turbo and weight against the benchmark of the displacement range, else of the class and engine."""
    x = "t.fuel_efficiency_kmpl"
    return f"""SELECT vehicle_type, vehicle_class, engine_type, is_turbo, weight_category, vehicle_count, trip_count, {d.r6('mean')} AS avg_efficiency_kmpl, min_efficiency_kmpl, max_efficiency_kmpl,
  {d.r6('sd')} AS efficiency_stddev, {d.r6('p25')} AS p25_efficiency, {d.r6('p50')} AS median_efficiency, {d.r6('p75')} AS p75_efficiency, {d.r6('mean - benchmark')} AS deviation_from_benchmark
FROM (SELECT v.vehicle_type, v.vehicle_class, v.engine_type, v.is_turbo, v.weight_category, COALESCE(f.fitted, g.general) AS benchmark, COUNT(DISTINCT t.vehid) AS vehicle_count, COUNT(*) AS trip_count,
    AVG({x}) AS mean, MIN({x}) AS min_efficiency_kmpl, MAX({x}) AS max_efficiency_kmpl, STDDEV_SAMP({x}) AS sd, {d.pct(x, 0.25)} AS p25, {d.pct(x, 0.5)} AS p50, {d.pct(x, 0.75)} AS p75
  FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid LEFT JOIN ({fitted_benchmark(d)}) AS f ON v.vehid = f.vehid
  LEFT JOIN (SELECT vehicle_class, engine_type, AVG(mixed_efficiency_kmpl) AS general FROM efficiency_benchmarks GROUP BY vehicle_class, engine_type) AS g ON v.vehicle_class = g.vehicle_class AND v.engine_type = g.engine_type
  WHERE {x} > 0 AND {d.since(days, as_of, 't.ts')}
  GROUP BY v.vehicle_type, v.vehicle_class, v.engine_type, v.is_turbo, v.weight_category, COALESCE(f.fitted, g.general)) AS s"""


@op("q2_2_weekly_trend", "telemetry")
def weekly_trend(d, as_of=AS_OF, days=90):
    """Weekly efficiency by type, with the change from the week before."""
    return f"""SELECT week_start, vehicle_type, vehicle_count, {d.r6('mean')} AS avg_efficiency, {d.r6('before')} AS prev_week_efficiency, {d.r6('mean - before')} AS week_over_week_change,
  {d.r6('CASE WHEN before > 0 THEN (mean - before) / before * 100 END')} AS percentage_change
FROM (SELECT *, LAG(mean) OVER (PARTITION BY vehicle_type ORDER BY week_start) AS before FROM
  (SELECT {d.week('ts')} AS week_start, vehicle_type, COUNT(DISTINCT vehid) AS vehicle_count, AVG(fuel_efficiency_kmpl) AS mean FROM telemetry WHERE {d.since(days, as_of)} GROUP BY {d.week('ts')}, vehicle_type) AS w) AS l"""


@op("q2_3_efficiency_factors", "telemetry")
def efficiency_factors(d, as_of=AS_OF, days=30):
    """Efficiency by speed band, weather, road and vehicle, and how it goes with speed and idling."""
    band = "CASE WHEN avg_speed_kmph < 30 THEN 'Urban' WHEN avg_speed_kmph <= 80 THEN 'Suburban' ELSE 'Highway' END"
    corr = lambda a: d.r6(d.corr(a, "fuel_efficiency_kmpl"))
    return f"""SELECT speed_category, weather_condition, road_type, vehicle_type, vehicle_class, COUNT(*) AS trip_count, {d.r6('AVG(fuel_efficiency_kmpl)')} AS avg_efficiency,
  {corr('avg_speed_kmph')} AS speed_efficiency_correlation, {corr('idle_time_min')} AS idle_efficiency_correlation
FROM (SELECT *, {band} AS speed_category FROM telemetry WHERE fuel_efficiency_kmpl > 0 AND {d.since(days, as_of)}) AS t GROUP BY speed_category, weather_condition, road_type, vehicle_type, vehicle_class HAVING COUNT(*) > 2"""


@op("q3_1_maintenance_indicators", "telemetry", "maintenance_history")
def maintenance_indicators(d, as_of=AS_OF, days=30):
    """Faults, temperatures and history of each vehicle, how urgent its maintenance is (3 most) and when it is due."""
    wide = f"{d._(d.r6('sd'), 'sd')} > 3"  # on Spark rounded, so that a deviation of 3 is never above it, in whatever order it was summed up
    urgency = f"CASE WHEN fault_trips > 5 THEN 'CRITICAL' WHEN fault_trips > 2 OR p95 > 110 THEN 'HIGH' WHEN fault_trips > 0 OR {wide} THEN 'MEDIUM' ELSE 'LOW' END"
    return f"""SELECT m.vehid, vehicle_type, vehicle_class, total_trips, fault_trips, {d.r6(f'{d.div("fault_trips", "total_trips")} * 100')} AS fault_rate_percent, maintenance_flag_trips,
  {d.r6('temp')} AS avg_engine_temp, {d.r6('mean')} AS avg_efficiency, {d.r6('sd')} AS efficiency_stddev, {d.r4('idle')} AS total_idle_minutes, {d.r6('p95')} AS p95_engine_temp,
  COALESCE(h.events, 0) AS past_maintenance_count, h.latest AS last_maintenance_date, {d.r4('h.mean_cost')} AS avg_maintenance_cost, {urgency} AS maintenance_urgency,
  CASE WHEN fault_trips > 5 THEN 3 WHEN fault_trips > 2 OR p95 > 110 THEN 2 WHEN fault_trips > 0 OR {wide} THEN 1 ELSE 0 END AS urgency_rank,
  CASE WHEN fault_trips > 0 THEN 7 WHEN p95 > 110 THEN 14 ELSE 30 END AS estimated_days_to_maintenance
FROM (SELECT vehid, vehicle_type, vehicle_class, COUNT(*) AS total_trips, {n_if('has_fault')} AS fault_trips, {n_if('maintenance_flag')} AS maintenance_flag_trips, AVG(avg_engine_temp_c) AS temp,
    AVG(fuel_efficiency_kmpl) AS mean, STDDEV_SAMP(fuel_efficiency_kmpl) AS sd, SUM(idle_time_min) AS idle, {d.pct('avg_engine_temp_c', 0.95)} AS p95
  FROM telemetry WHERE {d.since(days, as_of)} GROUP BY vehid, vehicle_type, vehicle_class) AS m
LEFT JOIN (SELECT vehid, COUNT(*) AS events, MAX(maintenance_date) AS latest, AVG(cost) AS mean_cost FROM maintenance_history GROUP BY vehid) AS h ON m.vehid = h.vehid"""


@op("q3_2_fault_patterns", "telemetry")
def fault_patterns(d, as_of=AS_OF, days=2000):
    """How often each fault code comes, by category and vehicle type."""
    category = "CASE substr(fault_code, 1, 3) WHEN 'P03' THEN 'Misfire' WHEN 'P04' THEN 'Emissions' WHEN 'P01' THEN 'Fuel/Air' WHEN 'P05' THEN 'Speed/Idle' WHEN 'P06' THEN 'Computer' ELSE 'Other' END"
    return f"""SELECT {category} AS fault_category, fault_code, vehicle_type, COUNT(*) AS affected_vehicles, CAST(SUM(n) AS BIGINT) AS total_occurrences, {d.r6('AVG(n)')} AS avg_occurrences_per_vehicle, MIN(n) AS min_occurrences, MAX(n) AS max_occurrences
FROM (SELECT fault_code, vehid, vehicle_type, COUNT(*) AS n FROM (SELECT vehid, vehicle_type, {d.unnest('fault_codes')} AS fault_code FROM telemetry WHERE has_fault AND fault_codes IS NOT NULL AND {d.since(days, as_of)}) AS e
  GROUP BY fault_code, vehid, vehicle_type) AS g GROUP BY fault_code, vehicle_type"""


@op("q4_1_idle_by_hour", "telemetry")
def idle_by_hour(d, as_of=AS_OF, days=30):
    """Idling and its fuel cost by type, class and hour."""
    return f"""SELECT vehicle_type, vehicle_class, hour_of_day, COUNT(*) AS trip_count, {d.r4('SUM(idle_time_min)')} AS total_idle_minutes, {d.r6('AVG(idle_time_min)')} AS avg_idle_per_trip,
  {d.r6(f'{d.div("SUM(idle_time_min)", "SUM(trip_duration_min)")} * 100')} AS idle_percentage, {d.r4('SUM(trip_duration_min)')} AS total_trip_minutes, {d.r4(f'SUM(idle_time_min) {IDLE_COST}')} AS idle_fuel_cost_usd
FROM (SELECT *, {d.hour('ts')} AS hour_of_day FROM telemetry WHERE {d.since(days, as_of)}) AS t GROUP BY vehicle_type, vehicle_class, hour_of_day"""


@op("q4_2_excessive_idling", "telemetry")
def excessive_idling(d, as_of=AS_OF, days=30):
    """Vehicles whose days average over 10 percent of idling."""
    return f"""SELECT vehid, vehicle_type, days_analyzed, {d.r6('minutes')} AS avg_daily_idle_minutes, {d.r6('share')} AS avg_daily_idle_percentage, days_with_excessive_idling, days_with_high_idle_percentage,
  {banded('share', [('> 25', "'Very High Idling'"), ('> 15', "'High Idling'"), ('> 10', "'Moderate Idling'")], "'Normal Idling'")} AS idling_classification, {d.r4(f'minutes * 365 {IDLE_COST}')} AS estimated_annual_idle_cost_usd
FROM (SELECT vehid, vehicle_type, COUNT(*) AS days_analyzed, AVG(idle) AS minutes, AVG(part) AS share, {n_if('idle > 60')} AS days_with_excessive_idling, {n_if('part > 20')} AS days_with_high_idle_percentage
  FROM (SELECT vehid, vehicle_type, CAST(ts AS DATE) AS day, SUM(idle_time_min) AS idle, {d.div('SUM(idle_time_min)', 'SUM(trip_duration_min)')} * 100 AS part FROM telemetry WHERE {d.since(days, as_of)} GROUP BY vehid, vehicle_type, CAST(ts AS DATE)) AS day
  GROUP BY vehid, vehicle_type) AS v WHERE share > 10"""


@op("q5_1_driver_safety", "driver_behavior", "vehicles")
def driver_safety(d, day="2001-10-15"):
    """Scores of a day's drivers against the fleet's, and what their insurance may save."""
    return f"""SELECT b.vehid, v.vehicle_type, b.driver_category, {d.r6('b.overall_score')} AS overall_score, b.safety_score, {d.r6('b.efficiency_score')} AS efficiency_score, b.harsh_acceleration_count, b.harsh_braking_count, b.speeding_count,
  {d.r6('b.night_driving_hours')} AS night_driving_hours, {d.r6('b.idle_time_percentage')} AS idle_time_percentage, {d.r6('b.insurance_premium_factor')} AS insurance_premium_factor,
  {d.r4('1000 * b.insurance_premium_factor')} AS estimated_annual_premium_usd, {d.r4('1000 * (1 - b.insurance_premium_factor)')} AS potential_premium_savings_usd,
  {d.r6('b.overall_score - AVG(b.overall_score) OVER ()')} AS score_vs_fleet_avg, {d.r6(f'PERCENT_RANK() OVER (ORDER BY {d.r6("b.overall_score")} DESC)')} AS percentile_rank
FROM driver_behavior b JOIN vehicles v ON b.vehid = v.vehid WHERE b.analysis_date = DATE '{day}'"""


@op("q5_2_behaviour_and_performance", "driver_behavior", "telemetry")
def behaviour_and_performance(d, as_of=AS_OF, days=30):
    """How vehicles do under drivers of each category, on the days that were scored."""
    return f"""SELECT b.driver_category, COUNT(DISTINCT b.vehid) AS driver_count, {d.r6('AVG(b.overall_score)')} AS avg_driver_score, {d.r6('AVG(t.fuel_efficiency_kmpl)')} AS avg_fuel_efficiency,
  {d.r6(d.share('t.has_fault'))} AS fault_rate_percent, {d.r6(d.share('t.maintenance_flag'))} AS maintenance_flag_rate,
  {d.r6('AVG(t.avg_speed_kmph)')} AS avg_speed, {d.r6(f'AVG({d.div("t.idle_time_min", "t.trip_duration_min")}) * 100')} AS avg_idle_percentage
FROM driver_behavior b JOIN telemetry t ON b.vehid = t.vehid AND CAST(t.ts AS DATE) = b.analysis_date WHERE {d.since(days, as_of, 't.ts')} GROUP BY b.driver_category"""


@op("q6_1_cost_of_ownership", "telemetry", "maintenance_history")
def cost_of_ownership(d, as_of=AS_OF, days=365):
    """A year's fuel, maintenance and idling by type and class."""
    whole = "fuel + repair + idle"
    return f"""SELECT vehicle_type, vehicle_class, COUNT(*) AS vehicle_count, {d.r2('SUM(fuel)')} AS total_fuel_cost, {d.r2('SUM(repair)')} AS total_maintenance_cost, {d.r2('SUM(idle)')} AS total_idle_cost, {d.r2(f'SUM({whole})')} AS total_operating_cost,
  {d.r4('SUM(km)')} AS total_distance, {d.r6(f'AVG({d.div(whole, "km")})')} AS avg_cost_per_km, {d.r6(f'AVG({d.div(whole, "km")}) * 0.85')} AS target_cost_per_km, {d.r2(f'SUM({whole}) * 0.15')} AS potential_savings_usd
FROM (SELECT t.vehid, vehicle_type, vehicle_class, SUM(fuel_consumed_l) * {FUEL_PRICE} AS fuel, COALESCE(MAX(m.cost), 0) AS repair, SUM(idle_time_min) {IDLE_COST} AS idle, SUM(trip_distance_km) AS km
  FROM telemetry t LEFT JOIN ({spent(d, days, as_of)}) AS m ON t.vehid = m.vehid WHERE {d.since(days, as_of)} GROUP BY t.vehid, vehicle_type, vehicle_class) AS c GROUP BY vehicle_type, vehicle_class"""


@op("q6_2_opportunity_roi", "telemetry", "driver_behavior")
def opportunity_roi(d, as_of=AS_OF, days=30):
    """What idling technology, routing software and driver training cost and save."""

    def row(name, means, cost, saving, price, high, source):
        return f"""SELECT '{name}' AS opportunity, '{means}' AS implementation, COUNT(DISTINCT vehid) AS affected_vehicles, {d.r4(cost)} AS current_annual_cost_usd, {d.r4(saving)} AS potential_savings_usd, {price} AS implementation_cost_usd,
  {d.r6(f'({saving}) / {price} * 100')} AS roi_percent, CASE WHEN {high} THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM {source}"""

    idle, fuel, premium = f"SUM(idle_time_min) {IDLE_COST}", f"SUM(fuel_consumed_l) * {FUEL_PRICE}", "AVG(insurance_premium_factor)"
    return " UNION ALL ".join([
        row("Idle Time Reduction", "Install idle shutdown technology", idle, f"{idle} * 0.5", 5000, f"{idle} * 0.5 / 5000 > 1", f"telemetry WHERE {d.since(days, as_of)} AND idle_time_min > 10"),
        row("Route Optimization", "Implement GPS routing software", fuel, f"{fuel} * 0.1", 3000, f"{fuel} * 0.1 / 3000 > 1", f"telemetry WHERE {d.since(days, as_of)}"),
        row("Driver Training", "Implement defensive driving course", f"1000 * {premium}", f"1000 * ({premium} - 0.9)", 2000, f"{premium} > 1.0", f"driver_behavior WHERE analysis_date >= CAST({d.ts(as_of)} - INTERVAL '{days}' DAY AS DATE) AND overall_score < 80"),
    ])


@op("q7_1_active_vehicles", "telemetry")
def active_vehicles(d, now="2001-10-20 12:00:00", hours=24):
    """Vehicles heard from lately, and their state."""
    late = f"{d.seconds('latest', d.ts(now))} / 60.0"
    return f"""SELECT vehid, vehicle_type, vehicle_class, latest AS last_telemetry_time, {d.r4(late)} AS minutes_since_last_update, {d.r6('eff')} AS last_efficiency, temp AS last_engine_temp, fault AS has_active_fault, {d.r6('score')} AS last_driver_score,
  CASE WHEN fault = 1 THEN 'FAULT' WHEN {late} > 60 THEN 'INACTIVE' WHEN temp > 110 THEN 'OVERHEATING' WHEN eff < 8 THEN 'LOW_EFFICIENCY' ELSE 'NORMAL' END AS current_status
FROM (SELECT vehid, vehicle_type, vehicle_class, MAX(ts) AS latest, MAX(fuel_efficiency_kmpl) AS eff, MAX(avg_engine_temp_c) AS temp, MAX(CASE WHEN has_fault THEN 1 ELSE 0 END) AS fault, MAX(driver_behavior_score) AS score
  FROM telemetry WHERE ts >= {d.ts(now)} - INTERVAL '{hours}' HOUR AND ts <= {d.ts(now)} GROUP BY vehid, vehicle_type, vehicle_class) AS v"""


@op("q7_2_active_alerts", "alerts", "vehicles")
def active_alerts(d, now=f"{AS_OF_READINGS} 00:00:00"):
    """Open alerts, most severe and newest first (place), and whether they are due for escalation."""
    age = f"{d.seconds('a.ts', d.ts(now))} / 60.0"
    rank = "CASE a.severity WHEN 'CRITICAL' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END"
    return f"""SELECT a.alert_id, a.vehid, v.vehicle_type, a.alert_type, a.severity, a.ts, a.status, {d.r4(age)} AS minutes_since_alert,
  CASE WHEN a.severity = 'CRITICAL' AND {age} > 30 OR a.severity = 'WARNING' AND {age} > 60 THEN 'ESCALATE' ELSE 'MONITOR' END AS escalation_status, {rank} AS severity_rank
FROM alerts a JOIN vehicles v ON a.vehid = v.vehid WHERE a.status = 'ACTIVE'"""


@op("q8_1_maintenance_schedule", "telemetry", "vehicles")
def predicted_maintenance(d, as_of=AS_OF, days=30):
    """Days to the next maintenance of every vehicle, and of which kind."""
    since = "odometer_km - last_service_km"
    return f"""SELECT v.vehid, vehicle_type, vehicle_class, odometer_km, last_service_km, service_interval_km, {since} AS km_since_last_service, COALESCE(n, 0) AS recent_faults, {d.r6('mean')} AS avg_efficiency, {d.r6('temp')} AS avg_engine_temp, {d.r6('p95')} AS p95_engine_temp,
  CAST(CASE WHEN n > 3 OR p95 > 115 THEN 0 WHEN n > 0 OR p95 > 110 THEN 7 WHEN {since} >= service_interval_km * 0.9 THEN 14 WHEN {since} >= service_interval_km * 0.8 THEN 30 ELSE service_interval_km - ({since}) END AS BIGINT) AS predicted_days_to_maintenance,
  CASE WHEN n > 3 THEN 'COMPREHENSIVE DIAGNOSTIC' WHEN p95 > 115 THEN 'COOLING SYSTEM' WHEN n > 0 THEN 'DIAGNOSTIC CHECK' WHEN {since} >= service_interval_km THEN 'SCHEDULED MAINTENANCE' ELSE 'MONITOR' END AS recommended_maintenance_type
FROM vehicles v LEFT JOIN (SELECT vehid, COUNT(*) FILTER (WHERE has_fault) AS n, AVG(fuel_efficiency_kmpl) AS mean, AVG(avg_engine_temp_c) AS temp, {d.pct('avg_engine_temp_c', 0.95)} AS p95 FROM telemetry WHERE {d.since(days, as_of)} GROUP BY vehid) AS t ON v.vehid = t.vehid"""


@op("q8_2_efficiency_degradation", "telemetry")
def efficiency_degradation(d, week="2001-09-03", as_of=AS_OF, days=180):
    """Weekly efficiency of each vehicle against one and four weeks before, and a projection over 30 days."""
    now, one, four = (d.r6(c) for c in ("now", "one", "four"))
    return f"""SELECT vehid, vehicle_type, week_start, {now} AS weekly_avg_efficiency, {one} AS prev_week_efficiency, {four} AS month_ago_efficiency, {d.r6('now - one')} AS week_over_week_change, {d.r6('now - four')} AS month_over_month_change,
  CASE WHEN {now} < {four} * 0.9 THEN 'SIGNIFICANT DEGRADATION' WHEN {now} < {four} * 0.95 THEN 'MODERATE DEGRADATION' WHEN {now} < {one} * 0.98 THEN 'SLIGHT DEGRADATION' ELSE 'STABLE' END AS degradation_status, {d.r6('now + (now - one) * 4')} AS predicted_efficiency_30_days
FROM (SELECT vehid, vehicle_type, week_start, now, LAG(now, 1) OVER w AS one, LAG(now, 4) OVER w AS four FROM
  (SELECT vehid, vehicle_type, {d.week('ts')} AS week_start, AVG(fuel_efficiency_kmpl) AS now FROM telemetry WHERE {d.since(days, as_of)} AND fuel_efficiency_kmpl > 0 GROUP BY vehid, vehicle_type, {d.week('ts')}) AS g
  WINDOW w AS (PARTITION BY vehid ORDER BY week_start)) AS l WHERE week_start >= DATE '{week}' AND one IS NOT NULL AND four IS NOT NULL"""


@op("q9_1_emissions", "telemetry", "vehicles")
def emissions(d, as_of=AS_OF, days=30):
    """CO2 by type, class and engine, against electric vehicles on grid power."""
    kg = f"t.fuel_consumed_l * {co2('v.engine_type')}"
    return f"""SELECT v.vehicle_type, v.vehicle_class, v.engine_type, COUNT(DISTINCT t.vehid) AS vehicle_count, {d.r4('SUM(t.trip_distance_km)')} AS total_distance_km, {d.r4('SUM(t.fuel_consumed_l)')} AS total_fuel_consumed_l, {d.r4(f'SUM({kg})')} AS total_co2_emissions_kg,
  {d.r6(f'AVG({d.div(kg, "t.trip_distance_km")})')} AS avg_co2_per_km, {d.r4(f'SUM(t.trip_distance_km) * {GRID_CO2_PER_KM}')} AS ev_equivalent_co2_kg, {d.r4(f'SUM({kg}) - SUM(t.trip_distance_km) * {GRID_CO2_PER_KM}')} AS co2_savings_potential_kg
FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid WHERE {d.since(days, as_of, 't.ts')} AND v.engine_type <> 'Electric' GROUP BY v.vehicle_type, v.vehicle_class, v.engine_type"""


@op("q10_1_executive_summary", "telemetry", "vehicles", "maintenance_history")
def executive_summary(d, day="2001-09-10"):
    """One row: the fleet, a day's work and its costs, with ratings."""
    rate = lambda x, marks: banded(x, marks, "'POOR'")
    return f"""SELECT total_vehicles, hybrid_vehicles, electric_vehicles, {d.r2('(hybrid_vehicles + electric_vehicles) * 100.0 / total_vehicles')} AS green_fleet_percentage, {d.r6('score')} AS avg_efficiency_score,
  active AS active_vehicles_today, {d.r4('km')} AS total_distance_today, {d.r6('eff')} AS avg_efficiency_today, faults AS total_faults_today, {d.r6('driver')} AS avg_driver_score_today,
  {d.r4('fuel')} AS daily_fuel_cost, {d.r4('repair')} AS daily_maintenance_cost, {d.r4('idle')} AS daily_idle_cost, {d.r4('fuel + repair + idle')} AS total_daily_cost,
  CASE WHEN faults > 5 THEN 'HIGH' WHEN faults > 2 THEN 'MEDIUM' ELSE 'LOW' END AS fault_severity,
  {rate('eff', [('> 15', "'EXCELLENT'"), ('> 12', "'GOOD'"), ('> 9', "'FAIR'")])} AS efficiency_rating, {rate('driver', [('> 0.9', "'EXCELLENT'"), ('> 0.8', "'GOOD'"), ('> 0.7', "'FAIR'")])} AS driver_rating
FROM (SELECT COUNT(*) AS total_vehicles, {n_if("vehicle_type = 'HEV'")} AS hybrid_vehicles, {n_if("vehicle_type = 'BEV'")} AS electric_vehicles, AVG(efficiency_score) AS score FROM vehicles) AS f
CROSS JOIN (SELECT COUNT(DISTINCT vehid) AS active, SUM(trip_distance_km) AS km, AVG(fuel_efficiency_kmpl) AS eff, {n_if('has_fault')} AS faults, AVG(driver_behavior_score) AS driver, SUM(fuel_consumed_l) * {FUEL_PRICE} AS fuel, SUM(idle_time_min) {IDLE_COST} AS idle
  FROM telemetry WHERE ts >= {d.ts(day)} AND ts < {d.ts(day)} + INTERVAL '1' DAY) AS t
CROSS JOIN (SELECT COALESCE(SUM(cost), 0) AS repair FROM maintenance_history WHERE maintenance_date = DATE '{day}') AS m"""
