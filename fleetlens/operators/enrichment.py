"""Trip enrichment: each group of features as SQL over trips (and vehicles); enrich_all puts them together."""

from __future__ import annotations

from ..plans.dialect import Dialect, banded, cut, op
from ..plans.parts import co2, lookup, lookup2, n_if
from ..rules import CRITICAL_FAULTS, DEPOT, EXPECTED_EFFICIENCY, FUEL_PRICE, IDLE_LITRES_PER_HOUR, KWH_PER_LITRE, ROAD_FACTOR, URGENCY_LEVELS, URGENCY_LOWEST, URGENCY_POINTS, WARNING_FAULTS, WEATHER_FACTOR, WEIGHT_KG

KEYS = "l_orderkey, l_linenumber, l_partkey, vehid, ts"
ORDER = "ts, l_orderkey, l_linenumber, l_partkey"


def guarded(a: str, b: str) -> str:
    """a / b; 0 where only b is 0; null where both are."""
    return f"CASE WHEN {b} = 0 THEN CASE WHEN {a} = 0 THEN NULL ELSE CAST(0 AS DOUBLE) END ELSE {a} / {b} END"


def basic(d: Dialect) -> dict[str, str]:
    return {
        "trip_intensity": d.r6(guarded("trip_distance_km", "trip_duration_min")),
        "fuel_rate_lph": d.r6(guarded("fuel_consumed_l", "(trip_duration_min / 60)")),
        "distance_per_rpm": d.r6(guarded("trip_distance_km", "avg_rpm")),
        "engine_load": d.r6(guarded("avg_rpm", "avg_speed_kmph")),
    }


def temporal(d: Dialect) -> dict[str, str]:
    h, w = d.hour("ts"), d.dow("ts")
    part = f"CASE WHEN {h} BETWEEN 5 AND 11 THEN 'Morning' WHEN {h} BETWEEN 12 AND 16 THEN 'Afternoon' WHEN {h} BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END"
    as_int = lambda x: f"CAST({x} AS INT)"
    return {
        "year": as_int("year(ts)"), "month": as_int("month(ts)"), "day": as_int("day(ts)"), "hour": h, "day_of_week": w, "day_of_year": as_int("dayofyear(ts)"),
        "week_of_year": as_int("weekofyear(ts)"), "quarter": as_int("quarter(ts)"), "time_of_day": part, "is_weekend": f"{w} >= 5",
        "is_rush_hour": f"{h} BETWEEN 7 AND 9 OR {h} BETWEEN 16 AND 18",
        "season": "CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) <= 5 THEN 'Spring' WHEN month(ts) <= 8 THEN 'Summer' ELSE 'Fall' END",
    }


def expected() -> str:
    base = lookup2("v.vehicle_class", "v.engine_type", EXPECTED_EFFICIENCY, "CAST(15 AS DOUBLE)")
    shrink = "CASE WHEN v.engine_type IN ('Gasoline', 'Diesel') THEN GREATEST(CAST(5 AS DOUBLE) / 10, 1 - (v.displacement_l - 2) / 10) ELSE CAST(1 AS DOUBLE) END"
    return f"ROUND({base} * {shrink} + 1.3e-7, 2)"


def driver(d: Dialect) -> dict[str, str]:
    score = "LEAST(CAST(1 AS DOUBLE), GREATEST(CAST(0 AS DOUBLE), CAST(100 - 5 * harsh_acceleration_count - 8 * harsh_braking_count - 3 * speeding_count AS DOUBLE) / 100))"
    return {
        "has_harsh_acceleration": "harsh_acceleration_count > 0", "has_harsh_braking": "harsh_braking_count > 0", "has_speeding": "speeding_count > 0", "computed_score": score,
        "driving_style": cut("driver_behavior_score", [0, 0.6, 0.8, 0.9, 1], ["Aggressive", "Moderate", "Safe", "Excellent"]),
    }


def idle(d: Dialect) -> dict[str, str]:
    share = d.r6(f"({guarded('idle_time_min', 'trip_duration_min')}) * 100")
    return {"idle_percentage": share, "has_excessive_idling": f"{share} > 20"}


def maintenance(d: Dialect) -> dict[str, str]:
    stress = "LEAST(CAST(2 AS DOUBLE), GREATEST(CAST(0 AS DOUBLE), (avg_engine_temp_c - 90) / 20 * (avg_rpm / 3000)))"
    health = cut("battery_voltage", [0, 11.5, 12, 12.5, 15], ["Critical", "Poor", "Fair", "Good"])
    points = f"COALESCE(CASE {health} WHEN 'Critical' THEN -30 WHEN 'Poor' THEN -15 WHEN 'Fair' THEN -5 ELSE 0 END, 0)"
    score = d.r6(f"LEAST(CAST(100 AS DOUBLE), GREATEST(CAST(0 AS DOUBLE), 100 - {stress} * 10 - harsh_braking_count * 2 - trip_distance_km / 50000 * 15 + {points}))")
    return {
        "engine_stress": d.r6(stress), "brake_wear_indicator": d.r6("CAST(harsh_braking_count AS DOUBLE) / 10"), "tire_wear_indicator": d.r6("trip_distance_km / 50000"), "battery_health": health,
        "maintenance_score": score, "maintenance_urgency": cut(score, [0, 40, 60, 80, 100], ["Critical", "High", "Medium", "Low"]),
    }


def environment(d: Dialect) -> dict[str, str]:
    one = "CAST(1 AS DOUBLE)"
    weather, road = lookup("weather_condition", WEATHER_FACTOR, one), lookup("road_type", ROAD_FACTOR, one)
    return {"weather_efficiency_factor": weather, "road_efficiency_factor": road, "environmental_factor": d.r6(f"({weather}) * ({road})"), "adjusted_efficiency": d.r6(f"fuel_efficiency_kmpl / (({weather}) * ({road}))")}


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Kilometres between two points on a sphere of radius 6371 km."""
    half = lambda a, b: f"POWER(SIN((RADIANS({b}) - RADIANS({a})) / 2), 2)"
    return f"2 * 6371 * ASIN(SQRT(LEAST(CAST(1 AS DOUBLE), {half(lat1, lat2)} + COS(RADIANS({lat1})) * COS(RADIANS({lat2})) * {half(lon1, lon2)})))"


def location(d: Dialect, depot=DEPOT) -> dict[str, str]:
    km = d.r6(haversine("location_lat", "location_lon", f"CAST({depot[0]} AS DOUBLE)", f"CAST({depot[1]} AS DOUBLE)"))
    return {"distance_from_depot_km": km, "distance_from_depot_mi": d.r4(f"{km} * 0.621371"), "location_density": cut(km, [0, 10, 30, 100, None], ["City Center", "Suburban", "Rural", "Remote"])}


def cost(d: Dialect) -> dict[str, str]:
    fuel, idle_cost = d.r2(f"fuel_consumed_l * {FUEL_PRICE}"), d.r2(f"idle_time_min * {IDLE_LITRES_PER_HOUR} / 60 * {FUEL_PRICE}")
    repair = f"(100 - {maintenance(d)['maintenance_score']}) * 10"
    return {
        "fuel_cost_usd": fuel, "cost_per_km": d.r4(guarded(f"({fuel})", "trip_distance_km")), "idle_fuel_cost_usd": idle_cost, "expected_maintenance_cost": d.r4(repair),
        "total_operating_cost": d.r2(f"COALESCE({fuel}, 0) + COALESCE({repair}, 0) + COALESCE({idle_cost}, 0)"),
    }


def pick(columns: dict[str, str], source: str = "telemetry") -> str:
    return f"SELECT {KEYS}, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {source}"


@op("e1_basic_features", "telemetry")
def basic_features(d):
    """Distance by time, fuel by hour, distance by engine speed, engine speed by road speed."""
    return pick(basic(d))


@op("e2_temporal_features", "telemetry")
def temporal_features(d):
    """Calendar parts, time of day, weekend, rush hour, season."""
    return pick(temporal(d))


@op("e3_performance_metrics", "telemetry", "vehicles")
def performance_metrics(d):
    """What the class, engine and displacement let expect, and how far a trip is from it."""
    return f"""SELECT {KEYS}, expected_efficiency, {d.r6('fuel_efficiency_kmpl - expected_efficiency')} AS efficiency_deviation, {d.r6(f'({guarded("(fuel_efficiency_kmpl - expected_efficiency)", "expected_efficiency")}) * 100')} AS efficiency_deviation_percent
FROM (SELECT t.*, {expected()} AS expected_efficiency FROM telemetry t LEFT JOIN vehicles v ON t.vehid = v.vehid) AS t"""


@op("e4_power_to_weight", "telemetry", "vehicles")
def power_to_weight(d):
    """Estimated power, weight, and power by weight."""
    power = "v.displacement_l * 50 * CASE WHEN v.is_turbo THEN CAST(13 AS DOUBLE) / 10 ELSE CAST(1 AS DOUBLE) END"
    return f"SELECT {KEYS}, {d.r6('hp')} AS estimated_power_hp, kg AS estimated_weight_kg, {d.r6('hp / kg')} AS power_to_weight FROM (SELECT t.*, {power} AS hp, {lookup('v.weight_category', WEIGHT_KG, 'NULL')} AS kg FROM telemetry t LEFT JOIN vehicles v ON t.vehid = v.vehid) AS t"


@op("e5_driver_features", "telemetry")
def driver_features(d):
    """Harsh events, a score from them, and the driving style."""
    return pick(driver(d))


@op("e6_idle_features", "telemetry")
def idle_features(d):
    """Share of idling, and whether it is excessive."""
    return pick(idle(d))


@op("e7_speed_consistency", "telemetry")
def speed_consistency(d):
    """Spread of a vehicle's speeds, and its score against the widest spread."""
    return f"""SELECT vehid, {d.r6('sd')} AS speed_consistency, {d.r6('CASE WHEN MAX(sd) OVER () > 0 THEN 1 - sd / MAX(sd) OVER () ELSE 1 END')} AS speed_consistency_score FROM (SELECT vehid, STDDEV_SAMP(avg_speed_kmph) AS sd FROM telemetry GROUP BY vehid) AS s"""


@op("e8_maintenance_indicators", "telemetry")
def maintenance_features(d):
    """Engine stress, wear, battery health, and the maintenance score with its urgency."""
    return pick(maintenance(d))


@op("e9_environment_features", "telemetry")
def environment_features(d):
    """Weather and road factors, and the efficiency without them."""
    return pick(environment(d))


@op("e10_location_features", "telemetry")
def location_features(d):
    """Distance from the depot and how dense that place is."""
    return pick(location(d))


@op("e11_anomaly_features", "telemetry")
def anomaly_features(d):
    """z-scores within the vehicle type (more than 10 trips), flags over 3, and jumps of efficiency over 5."""
    names = ("fuel_efficiency_kmpl", "avg_engine_temp_c", "avg_rpm", "avg_speed_kmph")
    z = lambda c: d.r6(f"CASE WHEN n > 10 AND sd_{c} > 0 THEN (t.{c} - mean_{c}) / sd_{c} END")
    stats = ", ".join(f"AVG({c}) AS mean_{c}, STDDEV_SAMP({c}) AS sd_{c}" for c in names)
    total = " + ".join(f"CASE WHEN ABS({z(c)}) > 3 THEN 1 ELSE 0 END" for c in names)
    few = d._("/*+ BROADCAST(s) */ ", "")  # a row for each type: rows are not dealt out by it
    return f"""SELECT *, total_anomalies > 0 AS has_anomaly, ABS(efficiency_change) > 5 AS efficiency_change_anomaly FROM (SELECT {few}{', '.join('t.' + k for k in KEYS.split(', '))}, {', '.join(f'{z(c)} AS {c}_zscore' for c in names)}, {total} AS total_anomalies,
  {d.r6(f'fuel_efficiency_kmpl - LAG(fuel_efficiency_kmpl) OVER (PARTITION BY t.vehid ORDER BY {ORDER}, fuel_efficiency_kmpl)')} AS efficiency_change FROM telemetry t JOIN (SELECT vehicle_type, COUNT(*) AS n, {stats} FROM telemetry GROUP BY vehicle_type) AS s ON t.vehicle_type = s.vehicle_type) AS f"""


@op("e12_cost_features", "telemetry")
def cost_features(d):
    """Fuel, idling and expected maintenance costs of a trip."""
    return pick(cost(d))


@op("e13_efficiency_metrics", "telemetry", "vehicles")
def efficiency_metrics(d):
    """Energy equivalent, CO2, and the gap to what is expected."""
    kwh = KWH_PER_LITRE
    energy = f"CASE WHEN t.vehicle_type = 'BEV' THEN NULL WHEN t.vehicle_type IN ('HEV', 'PHEV') OR v.engine_type <> 'Diesel' THEN fuel_efficiency_kmpl * {kwh['Gasoline']} ELSE fuel_efficiency_kmpl * {kwh['Diesel']} END"
    return f"""SELECT {KEYS}, {d.r6('energy')} AS energy_efficiency_kwh_per_100km, kg AS co2_emissions_kg, {d.r2(guarded('(kg * 1000)', 'trip_distance_km'))} AS co2_per_km_g, {d.r6('fuel_efficiency_kmpl - expected_efficiency')} AS efficiency_benchmark_gap, {d.r6('LEAST(CAST(200 AS DOUBLE), GREATEST(CAST(0 AS DOUBLE), fuel_efficiency_kmpl / expected_efficiency * 100))')} AS efficiency_benchmark_percent
FROM (SELECT t.*, {energy} AS energy, {d.r2(f'fuel_consumed_l * {co2("v.engine_type", "CAST(2.31 AS DOUBLE)")}')} AS kg, {expected()} AS expected_efficiency FROM telemetry t LEFT JOIN vehicles v ON t.vehid = v.vehid) AS t"""


@op("e14_rolling_efficiency", "telemetry")
def rolling_efficiency(d):
    """Mean and slope of a vehicle's last ten trips, from five on."""
    w = f"OVER (PARTITION BY vehid ORDER BY {ORDER}, fuel_efficiency_kmpl ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    return f"""SELECT {KEYS}, {d.r6(f'CASE WHEN COUNT(*) {w} >= 5 THEN AVG(fuel_efficiency_kmpl) {w} END')} AS efficiency_ma_10, {d.r6(f'CASE WHEN COUNT(*) {w} >= 5 THEN REGR_SLOPE(fuel_efficiency_kmpl, nth) {w} END')} AS efficiency_trend
FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY vehid ORDER BY {ORDER}, fuel_efficiency_kmpl) AS DOUBLE) AS nth FROM telemetry) AS t"""


@op("e15_enrich_all", "telemetry", "vehicles")
def enrich_all(d):
    """All row-wise features of a trip in one pass, with the vehicle's columns."""
    groups = basic(d) | temporal(d) | driver(d) | idle(d) | maintenance(d) | environment(d) | location(d) | cost(d)
    return f"SELECT {KEYS}, vehicle_type, vehicle_class, engine_type, expected_efficiency, {', '.join(f'{v} AS {k}' for k, v in groups.items())} FROM (SELECT t.*, v.engine_type, {expected()} AS expected_efficiency FROM telemetry t LEFT JOIN vehicles v ON t.vehid = v.vehid) AS t"


@op("e15_enrichment_summary", "telemetry", "vehicles")
def enrichment_summary(d):
    """Features of each category, and how many of their values are not null."""
    parts = {"basic": basic(d), "temporal": temporal(d), "driver": driver(d), "idle": idle(d), "maintenance": maintenance(d), "environment": environment(d), "location": location(d), "cost": cost(d)}
    present = {g: f"CAST(SUM({' + '.join(f'CASE WHEN {k} IS NOT NULL THEN 1 ELSE 0 END' for k in c)}) AS BIGINT)" for g, c in parts.items()}
    one = ", ".join(d._(f"named_struct('category', '{g}', 'features', {len(parts[g])}, 'values_present', {x})", f"{{'category': '{g}', 'features': {len(parts[g])}, 'values_present': {x}}}") for g, x in present.items())
    return f"SELECT r.category, r.features, r.values_present FROM (SELECT {d._(f'explode(array({one}))', f'unnest([{one}])')} AS r FROM ({enrich_all.build(d)}) AS e) AS x"


@op("e16_fuel_efficiency_units", "telemetry")
def fuel_efficiency_units(d):
    """Efficiency as km by litre, litres by 100 km, and miles by gallon."""
    r = d.div("trip_distance_km", "fuel_consumed_l")
    return pick({"kmpl": d.r6(r), "l_per_100km": d.r6(f"{d.div('fuel_consumed_l', 'trip_distance_km')} * 100"), "mpg": d.r6(f"{r} * 2.352145833")})


@op("u1_fault_severity", "telemetry")
def fault_severity(d):
    """Severity by the first code of the list that is critical or a warning, and by the worst of all codes."""
    quoted = lambda codes: ", ".join(f"'{c}'" for c in codes)
    known = lambda codes: d._(f"filter(split(fault_codes, ','), c -> c IN ({quoted(codes)}))", f"list_filter(string_split(fault_codes, ','), lambda c: c IN ({quoted(codes)}))")
    count = lambda codes: f"COALESCE({d._('size', 'len')}({known(codes)}), 0)"
    first = d._(f"get({known(CRITICAL_FAULTS + WARNING_FAULTS)}, 0)", f"({known(CRITICAL_FAULTS + WARNING_FAULTS)})[1]")
    level = lambda critical: f"CASE WHEN COALESCE(fault_codes, '') = '' THEN 'NONE' WHEN {critical} THEN 'CRITICAL' WHEN {count(CRITICAL_FAULTS + WARNING_FAULTS)} > 0 THEN 'WARNING' ELSE 'INFO' END"
    return f"SELECT {KEYS}, fault_codes, {level(f'{first} IN ({quoted(CRITICAL_FAULTS)})')} AS first_match, {level(f'{count(CRITICAL_FAULTS)} > 0')} AS worst FROM telemetry"


@op("u2_maintenance_urgency", "telemetry")
def maintenance_urgency(d):
    """Urgency of a vehicle's day from its faults, its loss of efficiency against the vehicle's mean, and a trip's mean minutes of idling."""
    (loss_from, loss_weight), (idle_from, idle_weight) = URGENCY_POINTS["loss"], URGENCY_POINTS["idle"]
    points = f"faults * {URGENCY_POINTS['fault']} + GREATEST(loss - {loss_from}, 0) * {loss_weight} + GREATEST(idle - {idle_from}, 0) * {idle_weight}"
    return f"""SELECT vehid, usage_date, faults, loss AS efficiency_degradation, idle AS idle_minutes, {banded(d.r6(points), [(f'> {least}', f"'{name}'") for least, name in URGENCY_LEVELS], f"'{URGENCY_LOWEST}'")} AS urgency
FROM (SELECT g.vehid, usage_date, faults, {d.r6('(m.efficiency - g.efficiency) / NULLIF(m.efficiency, 0) * 100')} AS loss, {d.r6('idle')} AS idle
  FROM (SELECT vehid, CAST(ts AS DATE) AS usage_date, {n_if('has_fault')} AS faults, AVG(fuel_efficiency_kmpl) AS efficiency, AVG(idle_time_min) AS idle FROM telemetry GROUP BY vehid, CAST(ts AS DATE)) AS g
  JOIN (SELECT vehid, AVG(fuel_efficiency_kmpl) AS efficiency FROM telemetry GROUP BY vehid) AS m ON g.vehid = m.vehid) AS v"""


@op("u3_co2_emissions", "telemetry", "vehicles")
def co2_emissions(d):
    """CO2 of a trip by its fuel."""
    return f"SELECT {', '.join('t.' + k for k in KEYS.split(', '))}, {d.r6(f'fuel_consumed_l * {co2("v.engine_type")}')} AS co2_kg FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid"
