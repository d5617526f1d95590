"""The business-insight pack: replacement, electrification, allocation, driver matching, maintenance value, insurance, carbon, risk.

Fixed values: the thresholds, weights, labels and advice texts in these queries are what results must hold; they stand where they
are used.
"""

from __future__ import annotations

from ..rules import FUEL_PRICE, VEHICLE_PRICE
from .dialect import AS_OF, op
from .parts import IDLE_COST, co2, fitted_benchmark, n_if, spent, steps


@op("i1_1_replacement_candidates", "telemetry", "vehicles", "maintenance_history")
def replacement_candidates(d, as_of=AS_OF, days=365):
    """A year's cost of each vehicle and a replacement score, by type, class and engine."""
    score = f"""CASE efficiency_category WHEN 'Low' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END + {steps('faults', [('> 10', 3), ('> 5', 2), ('> 0', 1)])} + {steps('repair', [('> 5000', 3), ('> 3000', 2), ('> 1000', 1)])}"""
    return f"""SELECT vehicle_type, vehicle_class, engine_type, COUNT(*) AS vehicle_count, {d.r2('AVG(total)')} AS avg_annual_cost, {d.r6(f'AVG({d.div("total", "km")})')} AS avg_cost_per_km, {d.r2('SUM(total)')} AS total_annual_cost, {d.r6('AVG(score)')} AS avg_replacement_score,
  {n_if('score >= 5')} AS high_priority_replacements, {n_if('score BETWEEN 3 AND 4')} AS medium_priority_replacements, {d.r2('SUM(total) * 0.3')} AS potential_annual_savings, {d.r6(f'CASE WHEN AVG(total) > 0 THEN {VEHICLE_PRICE} / (AVG(total) * 0.3) END')} AS estimated_payback_period_years
FROM (SELECT *, fuel + repair + idle + {VEHICLE_PRICE} * 0.15 + 1200 AS total, {score} AS score FROM
  (SELECT v.vehid, v.vehicle_type, v.vehicle_class, v.engine_type, v.efficiency_category, SUM(t.fuel_consumed_l) * {FUEL_PRICE} AS fuel, COALESCE(MAX(m.cost), 0) AS repair, SUM(t.idle_time_min) {IDLE_COST} AS idle, SUM(t.trip_distance_km) AS km, {n_if('t.has_fault')} AS faults
   FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid LEFT JOIN ({spent(d, days, as_of)}) AS m ON t.vehid = m.vehid WHERE {d.since(days, as_of, 't.ts')} GROUP BY v.vehid, v.vehicle_type, v.vehicle_class, v.engine_type, v.efficiency_category) AS c) AS s
GROUP BY vehicle_type, vehicle_class, engine_type"""


@op("i1_2_electrification", "telemetry", "maintenance_history")
def electrification(d, as_of=AS_OF, days=365):
    """What combustion and hybrid vehicles would cost as electric ones."""
    return f"""SELECT vehicle_type, n AS current_count, {d.r2('fuel')} AS current_annual_fuel_cost, {d.r2('repair')} AS current_annual_maintenance_cost, {d.r2('fuel + repair')} AS current_total_annual_cost, {d.r2('energy')} AS ev_annual_energy_cost, {d.r2('repair * 0.5')} AS ev_annual_maintenance_cost,
  {d.r2('energy + repair * 0.5')} AS ev_total_annual_cost, {d.r2('saved')} AS annual_savings_per_vehicle, premium AS ev_premium_cost, {d.r6(d.div('premium', 'saved'))} AS payback_period_years, {d.r2('n * saved')} AS total_annual_savings, n * premium AS total_ev_premium_cost, {d.r2('km * grams')} AS annual_co2_reduction_kg
FROM (SELECT *, fuel + repair - energy - repair * 0.5 AS saved FROM (SELECT vehicle_type, COUNT(*) AS n, SUM(fuel) * {FUEL_PRICE} AS fuel, SUM(repair) AS repair, SUM(km) AS km, SUM(km) * 0.2 * 0.12 AS energy,
    CASE vehicle_type WHEN 'ICE' THEN 10000 WHEN 'HEV' THEN 5000 ELSE 0 END AS premium, CASE vehicle_type WHEN 'ICE' THEN CAST(2310 AS DOUBLE) / 12 WHEN 'HEV' THEN CAST(1850 AS DOUBLE) / 12 ELSE 0 END AS grams
  FROM (SELECT t.vehid, vehicle_type, SUM(fuel_consumed_l) AS fuel, SUM(trip_distance_km) AS km, COALESCE(MAX(m.cost), 0) AS repair FROM telemetry t LEFT JOIN ({spent(d, days, as_of)}) AS m ON t.vehid = m.vehid WHERE {d.since(days, as_of)} AND vehicle_type IN ('ICE', 'HEV') GROUP BY t.vehid, vehicle_type) AS v
  GROUP BY vehicle_type) AS c) AS s"""


@op("i2_1_usage_allocation", "telemetry", "vehicles")
def usage_allocation(d, as_of=AS_OF, days=90):
    """Vehicles by usage pattern, and how well their type suits it."""
    urban, highway = d.div("urban", "trips"), d.div("highway", "trips")
    pattern = f"CASE WHEN km < 10 AND {urban} > 0.7 THEN 'Urban Short Haul' WHEN km BETWEEN 10 AND 50 AND {urban} > 0.5 THEN 'Urban Medium Haul' WHEN km > 50 AND {highway} > 0.7 THEN 'Highway Long Haul' WHEN rush > trips * 0.5 THEN 'Rush Hour Specialist' ELSE 'Mixed Usage' END"
    now = f"CASE WHEN vehicle_type = 'HEV' AND {urban} > 0.6 THEN 10 WHEN vehicle_type = 'ICE' AND {highway} > 0.6 THEN 8 WHEN vehicle_type = 'BEV' AND km < 50 THEN 9 ELSE 5 END"
    best = "CASE usage_pattern WHEN 'Urban Short Haul' THEN CASE vehicle_type WHEN 'BEV' THEN 10 WHEN 'HEV' THEN 8 ELSE 3 END WHEN 'Highway Long Haul' THEN CASE vehicle_type WHEN 'ICE' THEN 9 WHEN 'HEV' THEN 7 ELSE 2 END ELSE 5 END"
    return f"""SELECT usage_pattern, vehicle_type, vehicle_class, COUNT(*) AS vehicle_count, {d.r6('AVG(km)')} AS avg_trip_distance, {d.r6('AVG(eff)')} AS avg_efficiency, {d.r6('AVG(now)')} AS avg_current_score, {d.r6('AVG(best)')} AS avg_optimal_score, {d.r6('AVG(best - now)')} AS improvement_potential, {n_if('best - now > 2')} AS poor_fit_vehicles,
  CASE WHEN usage_pattern = 'Urban Short Haul' AND vehicle_type <> 'BEV' THEN 'Consider EV replacement' WHEN usage_pattern = 'Highway Long Haul' AND vehicle_type = 'BEV' THEN 'Reassign to urban routes' WHEN AVG(now) < 5 THEN 'Review vehicle allocation' ELSE 'Optimal allocation' END AS allocation_recommendation
FROM (SELECT *, {best} AS best FROM (SELECT *, {pattern} AS usage_pattern, {now} AS now FROM
  (SELECT v.vehid, v.vehicle_type, v.vehicle_class, AVG(trip_distance_km) AS km, AVG(fuel_efficiency_kmpl) AS eff, COUNT(*) AS trips, {n_if("road_type = 'Urban'")} AS urban, {n_if("road_type = 'Highway'")} AS highway, {n_if('hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 16 AND 18')} AS rush
   FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid WHERE {d.since(days, as_of)} GROUP BY v.vehid, v.vehicle_type, v.vehicle_class) AS u) AS p) AS s
GROUP BY usage_pattern, vehicle_type, vehicle_class"""


@op("i2_2_driver_vehicle_match", "telemetry", "driver_behavior")
def driver_vehicle_match(d, as_of=AS_OF, days=720, least_trips=10):
    """How drivers of each category do with a vehicle against all its drivers."""
    score = f"{steps('eff_delta', [('> 2', 3), ('> 1', 2), ('> 0', 1), ('> -1', 0), ('> -2', -1)], -2)} + {steps('fault_delta', [('< -0.1', 2), ('< 0', 1), ('< 0.1', 0)], -1)} + {steps('driver', [('> 90', 2), ('> 80', 1)])}"
    return f"""SELECT vehicle_type, vehicle_class, driver_category, COUNT(DISTINCT vehid) AS vehicles_used, COUNT(DISTINCT driver_id) AS drivers_assigned, {d.r6('AVG(score)')} AS avg_match_score, {d.r6('AVG(eff_delta)')} AS avg_efficiency_impact, {d.r6('AVG(fault_delta)')} AS avg_fault_rate_impact,
  {n_if('score >= 3')} AS excellent_matches, {n_if('score BETWEEN 1 AND 2')} AS good_matches, {n_if('score <= 0')} AS poor_matches,
  CASE WHEN AVG(score) < 0 AND vehicle_class = 'SUV' AND driver_category = 'Needs Improvement' THEN 'Avoid assigning inexperienced drivers to SUVs' WHEN AVG(eff_delta) < -1 AND vehicle_type = 'HEV' THEN 'Provide HEV-specific training to drivers' WHEN AVG(score) > 2 AND driver_category = 'Excellent' THEN 'Use as benchmark for driver training' ELSE 'No specific action needed' END AS recommendation
FROM (SELECT *, {score} AS score FROM (SELECT *, {d.r6('eff / trips - all_eff / all_trips')} AS eff_delta, {d.r6(f'{d.div("faults", "trips")} - {d.div("all_faults", "all_trips")}')} AS fault_delta FROM
  (SELECT *, SUM(eff) OVER (PARTITION BY vehid) AS all_eff, SUM(faults) OVER (PARTITION BY vehid) AS all_faults, SUM(trips) OVER (PARTITION BY vehid) AS all_trips FROM
   (SELECT t.vehid, vehicle_type, vehicle_class, b.driver_id, b.driver_category, {d.r2('AVG(b.overall_score)')} AS driver, SUM(fuel_efficiency_kmpl) AS eff, {n_if('has_fault')} AS faults, COUNT(*) AS trips
    FROM telemetry t JOIN driver_behavior b ON t.vehid = b.vehid AND CAST(t.ts AS DATE) = b.analysis_date WHERE {d.since(days, as_of, 't.ts')} GROUP BY t.vehid, vehicle_type, vehicle_class, b.driver_id, b.driver_category) AS g) AS w WHERE trips >= {least_trips}) AS x) AS s
GROUP BY vehicle_type, vehicle_class, driver_category"""


@op("i3_1_maintenance_effect", "telemetry", "vehicles", "maintenance_history")
def maintenance_effect(d, as_of=AS_OF, days=730):
    """Efficiency and faults in the 30 days before and after each maintenance, and its return."""
    day = "CAST(m.maintenance_date AS TIMESTAMP)" if not d.spark else "CAST(m.maintenance_date AS TIMESTAMP_NTZ)"
    before, after = f"t.ts < {day}", f"t.ts > {day}"
    gain = "(eff_after - eff_before) * km_after / eff_after * 1.2 + (faults_before - faults_after) * 500"
    return f"""SELECT maintenance_type, vehicle_type, vehicle_class, COUNT(*) AS maintenance_count, {d.r4('AVG(cost)')} AS avg_cost, {d.r6('AVG(eff_after - eff_before)')} AS avg_efficiency_improvement, {d.r6('AVG(faults_before - faults_after)')} AS avg_fault_reduction, {d.r6('AVG(km_after)')} AS avg_distance_30_days_post,
  {d.r4(f'AVG({gain} - cost)')} AS avg_net_benefit_30_days, {d.r4(f'AVG(({gain}) / cost * 100)')} AS avg_roi_percent_30_days,
  CASE WHEN AVG(eff_after - eff_before) > 2 AND AVG(faults_before - faults_after) > 1 THEN 'HIGHLY EFFECTIVE' WHEN AVG(eff_after - eff_before) > 1 OR AVG(faults_before - faults_after) > 0 THEN 'EFFECTIVE' ELSE 'INEFFECTIVE' END AS effectiveness_rating,
  CASE WHEN AVG(({gain}) / cost * 100) > 100 THEN 'Increase frequency' WHEN AVG(({gain}) / cost * 100) >= 50 THEN 'Maintain current schedule' WHEN AVG(({gain}) / cost * 100) < 50 THEN 'Review necessity or negotiate cost' ELSE 'Insufficient data' END AS recommendation
FROM (SELECT m.maintenance_id, m.maintenance_type, v.vehicle_type, v.vehicle_class, MAX(m.cost) AS cost, AVG(CASE WHEN {before} THEN fuel_efficiency_kmpl END) AS eff_before, AVG(CASE WHEN {after} THEN fuel_efficiency_kmpl END) AS eff_after,
    {n_if(f'{before} AND t.has_fault')} AS faults_before, {n_if(f'{after} AND t.has_fault')} AS faults_after, SUM(CASE WHEN {after} THEN trip_distance_km END) AS km_after
  FROM maintenance_history m JOIN vehicles v ON m.vehid = v.vehid LEFT JOIN telemetry t ON m.vehid = t.vehid AND t.ts BETWEEN {day} - INTERVAL '30' DAY AND {day} + INTERVAL '30' DAY
  WHERE m.maintenance_date >= CAST({d.ts(as_of)} - INTERVAL '{days}' DAY AS DATE) GROUP BY m.maintenance_id, m.maintenance_type, v.vehicle_type, v.vehicle_class) AS e
WHERE eff_before IS NOT NULL AND eff_after IS NOT NULL GROUP BY maintenance_type, vehicle_type, vehicle_class"""


@op("i3_2_insurance_premiums", "driver_behavior", "vehicles")
def insurance_premiums(d, day="2001-09-10"):
    """Premiums as they are and as driving would set them, by type and class."""
    base = "CASE vehicle_type WHEN 'SUV' THEN 1200 WHEN 'Truck' THEN 1400 WHEN 'ICE' THEN 1000 WHEN 'HEV' THEN 900 WHEN 'BEV' THEN 800 ELSE 1000 END"
    risk = "(CASE WHEN safety_score < 70 THEN 15 WHEN safety_score < 80 THEN 12 WHEN safety_score < 90 THEN 10 ELSE 8 END) * (CASE WHEN harsh_braking_count > 5 THEN 13 WHEN harsh_braking_count > 2 THEN 11 ELSE 10 END) * (CASE WHEN speeding_count > 10 THEN 14 WHEN speeding_count > 5 THEN 12 ELSE 10 END)"
    return f"""SELECT vehicle_type, vehicle_class, COUNT(*) AS driver_count, {d.r6('AVG(overall_score)')} AS avg_driver_score, {d.r6('AVG(safety_score)')} AS avg_safety_score, {d.r4('SUM(paid)')} AS total_current_premium, {d.r4('SUM(due)')} AS total_calculated_premium, {d.r4('SUM(paid - due)')} AS total_premium_overpayment, {d.r4('SUM(spare)')} AS total_potential_savings,
  {d.r6('AVG(GREATEST(90 - safety_score, 0))')} AS avg_safety_improvement_needed, {d.r6('AVG(GREATEST(harsh_braking_count - 2, 0))')} AS avg_braking_improvement_needed,
  CASE WHEN AVG(safety_score) < 80 AND AVG(harsh_braking_count) > 3 THEN 'High priority: Implement defensive driving training' WHEN AVG(safety_score) BETWEEN 80 AND 90 THEN 'Medium priority: Targeted coaching for high-risk drivers' WHEN AVG(safety_score) >= 90 THEN 'Negotiate with insurers for group discount' ELSE 'Maintain current program' END AS insurance_optimization_strategy,
  {d.r4('CASE WHEN AVG(safety_score) < 80 THEN SUM(spare) * 0.5 WHEN AVG(safety_score) <= 90 THEN SUM(spare) * 0.3 ELSE 0 END')} AS expected_annual_savings
FROM (SELECT *, base * insurance_premium_factor AS paid, CAST(base * risk AS DOUBLE) / 1000 AS due, base * insurance_premium_factor - base * 0.8 AS spare FROM
  (SELECT b.*, v.vehicle_type, v.vehicle_class, {base} AS base, {risk} AS risk FROM driver_behavior b JOIN vehicles v ON b.vehid = v.vehid WHERE b.analysis_date = DATE '{day}') AS r) AS p GROUP BY vehicle_type, vehicle_class"""


@op("i4_1_carbon_roadmap", "telemetry", "vehicles")
def carbon_roadmap(d, as_of=AS_OF, days=365):
    """Three years of replacing combustion and hybrid vehicles: carbon, investment, savings."""
    return f"""SELECT vehicle_type, vehicle_class, n AS vehicle_count, {d.r4('kg')} AS annual_co2_emissions_kg, {d.r4('kg / 1000')} AS annual_co2_emissions_tonnes, {d.r2('n * 0.2')} AS year1_hev_replacements, {d.r2('n * 0.3')} AS year2_hev_replacements, {d.r2('n * 0.5')} AS year3_ev_replacements,
  {d.r4('kg * 0.08')} AS year1_co2_reduction_kg, {d.r4('kg * 0.2')} AS year2_cumulative_co2_reduction_kg, {d.r4('kg * 0.6')} AS year3_cumulative_co2_reduction_kg, {d.r2(f'{d.div("kg * 0.6", "kg")} * 100')} AS total_co2_reduction_percent,
  {d.r2('n * 1000.0')} AS year1_investment, {d.r2('n * 1500.0')} AS year2_investment, {d.r2('n * 5000.0')} AS year3_investment, {d.r4(f'litres * {FUEL_PRICE} * 0.06')} AS year1_fuel_savings, {d.r4(f'litres * {FUEL_PRICE} * 0.09')} AS year2_fuel_savings, {d.r4(f'litres * {FUEL_PRICE} * 0.35')} AS year3_fuel_savings,
  {d.r6(d.div('n * 1000.0', f'litres * {FUEL_PRICE} * 0.06'))} AS year1_payback_years
FROM (SELECT v.vehicle_type, v.vehicle_class, COUNT(DISTINCT v.vehid) AS n, SUM(fuel_consumed_l) AS litres, SUM(fuel_consumed_l * {co2('v.engine_type')}) AS kg FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid
  WHERE {d.since(days, as_of)} AND v.vehicle_type IN ('ICE', 'HEV') GROUP BY v.vehicle_type, v.vehicle_class) AS e"""


@op("i5_1_safety_risk", "telemetry")
def safety_risk(d, as_of=AS_OF, days=90):
    """Risk points of vehicles from speeding, braking, night, weather and faults, by type and class."""
    part = lambda x, limits: "CASE " + " ".join(f"WHEN {x} > trips * {s} THEN {p}" for s, p in limits) + " ELSE 0 END"
    score = f"{steps('speeding', [('> 20', 3), ('> 10', 2), ('> 5', 1)])} + {steps('braking', [('> 15', 3), ('> 8', 2), ('> 3', 1)])} + {part('night', [(0.3, 2), (0.1, 1)])} + {part('wet', [(0.2, 2), (0.1, 1)])} + {steps('faults', [('> 5', 3), ('> 2', 2), ('> 0', 1)])}"
    return f"""SELECT vehicle_type, vehicle_class, COUNT(*) AS vehicle_count, {d.r6('AVG(score)')} AS avg_risk_score, {n_if('score >= 8')} AS high_risk_vehicles, {n_if('score BETWEEN 5 AND 7')} AS medium_risk_vehicles, {n_if('score <= 4')} AS low_risk_vehicles, {d.r6('AVG(driver)')} AS avg_driver_score, {d.r6('AVG(speeding)')} AS avg_speeding_events, {d.r6('AVG(braking)')} AS avg_harsh_braking,
  CASE WHEN AVG(score) >= 7 THEN 'Immediate intervention required: Review driver assignments, schedule safety training' WHEN AVG(score) >= 5 THEN 'Priority intervention: Install telematics alerts, implement coaching program' WHEN AVG(score) >= 3 THEN 'Standard monitoring: Regular safety reviews, maintain current protocols' ELSE 'Low risk: Continue current practices' END AS risk_mitigation_strategy,
  CASE WHEN AVG(score) >= 7 THEN '30-50% premium increase likely' WHEN AVG(score) >= 5 THEN '10-30% premium increase possible' WHEN AVG(score) >= 3 THEN 'Minimal impact' ELSE 'Potential for premium reduction' END AS insurance_impact
FROM (SELECT *, {score} AS score FROM (SELECT vehid, vehicle_type, vehicle_class, COUNT(*) AS trips, SUM(speeding_count) AS speeding, SUM(harsh_braking_count) AS braking, {n_if('hour(ts) >= 22 OR hour(ts) <= 5')} AS night, {n_if("weather_condition IN ('Rain', 'Snow', 'Fog')")} AS wet, {n_if('has_fault')} AS faults, AVG(driver_behavior_score) AS driver
  FROM telemetry WHERE {d.since(days, as_of)} GROUP BY vehid, vehicle_type, vehicle_class) AS r) AS s GROUP BY vehicle_type, vehicle_class"""


@op("i6_1_replacement_matrix", "telemetry", "vehicles", "maintenance_history", "efficiency_benchmarks")
def replacement_matrix(d, as_of=AS_OF):
    """Age, cost, efficiency and reliability points of vehicles, and what to do with their class."""
    total = "age_points + cost_points + eff_points + fault_points"
    return f"""SELECT vehicle_type, vehicle_class, COUNT(*) AS vehicle_count, {d.r6('AVG(age)')} AS avg_vehicle_age, {d.r6('AVG(odometer_km)')} AS avg_odometer_km, {d.r4('AVG(repair)')} AS avg_annual_maintenance_cost, {d.r6('AVG(eff)')} AS avg_current_efficiency, {d.r6('AVG(fitted)')} AS avg_benchmark_efficiency, {d.r6('AVG(points)')} AS avg_replacement_score,
  {n_if('points >= 8')} AS high_priority_replacements, {n_if('points BETWEEN 5 AND 7')} AS medium_priority_replacements, {n_if('points <= 4')} AS low_priority_replacements,
  CASE WHEN AVG(used) >= 2 AND AVG(points) >= 6 THEN 'High utilization, high maintenance: Replace with new efficient model' WHEN AVG(used) >= 2 THEN 'High utilization, good condition: Maintain and monitor' WHEN AVG(points) >= 6 THEN 'Low utilization, poor condition: Consider disposal' ELSE 'Low utilization, good condition: Retain as backup' END AS strategic_recommendation,
  {n_if('points >= 8')} * {VEHICLE_PRICE} AS estimated_replacement_cost_high_priority, {n_if('points BETWEEN 5 AND 7')} * {VEHICLE_PRICE} AS estimated_replacement_cost_medium_priority
FROM (SELECT *, {total} AS points FROM (SELECT *, {steps('age', [('> 10', 3), ('> 7', 2), ('> 5', 1)])} AS age_points, {steps('repair', [('> 5000', 3), ('> 3000', 2), ('> 1000', 1)])} AS cost_points,
    CASE WHEN eff < fitted * 0.8 THEN 3 WHEN eff < fitted * 0.9 THEN 2 WHEN eff < fitted THEN 1 ELSE 0 END AS eff_points, {steps('faults', [('> 5', 3), ('> 2', 2), ('> 0', 1)])} AS fault_points, {steps('km', [('> 10000', 3), ('> 5000', 2), ('> 1000', 1)])} AS used
  FROM (SELECT v.vehid, v.vehicle_type, v.vehicle_class, {as_of[:4]} - v.manufacture_year AS age, v.odometer_km, COALESCE(m.cost, 0) AS repair, t.eff, COALESCE(t.faults, 0) AS faults, t.km, f.fitted
    FROM vehicles v LEFT JOIN (SELECT vehid, AVG(fuel_efficiency_kmpl) AS eff, {n_if('has_fault')} AS faults, SUM(trip_distance_km) AS km FROM telemetry WHERE {d.since(90, as_of)} GROUP BY vehid) AS t ON v.vehid = t.vehid
    LEFT JOIN ({spent(d, 365, as_of)}) AS m ON v.vehid = m.vehid LEFT JOIN ({fitted_benchmark(d)}) AS f ON v.vehid = f.vehid) AS h) AS p) AS s
GROUP BY vehicle_type, vehicle_class"""
