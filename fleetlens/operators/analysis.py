"""Performance, efficiency, maintenance and driver analysis over trips: one set-based query for what concerns all vehicles."""

from __future__ import annotations

from itertools import combinations

from ..plans.dialect import AS_OF, banded, op
from ..plans.parts import co2, default_benchmark, fitted_benchmark, n_if
from ..rules import FUEL_PRICE
from .enrichment import KEYS, ORDER

NUMERIC = ("trip_distance_km", "trip_duration_min", "avg_speed_kmph", "fuel_efficiency_kmpl", "fuel_consumed_l", "avg_engine_temp_c", "avg_rpm", "idle_time_min", "driver_behavior_score", "battery_voltage")
NTH = f"ROW_NUMBER() OVER (PARTITION BY vehid ORDER BY {ORDER}, fuel_efficiency_kmpl)"
EFF = "fuel_efficiency_kmpl"


def level(x: str) -> str:
    return banded(x, [(">= 90", "'Excellent'"), (">= 80", "'Good'"), (">= 70", "'Average'"), (">= 60", "'Below Average'")], "'Poor'")


@op("a1_kpi_summary", "telemetry")
def kpi_summary(d):
    """One row of key figures."""
    return f"""SELECT COUNT(*) AS total_trips, COUNT(DISTINCT vehid) AS unique_vehicles, {d.r2('SUM(trip_distance_km)')} AS total_distance_km, {d.r2('SUM(fuel_consumed_l)')} AS total_fuel_consumed_l, {d.r6(f'AVG({EFF})')} AS avg_fuel_efficiency, {d.r6('AVG(trip_distance_km)')} AS avg_trip_distance,
  {d.r6('AVG(trip_duration_min)')} AS avg_trip_duration, {d.r2('SUM(idle_time_min) / 60')} AS total_idle_time_hours, {d.r6(d.share('has_fault'))} AS fault_rate, {d.r6(d.share('maintenance_flag'))} AS maintenance_flag_rate FROM telemetry"""


@op("a1_kpi_by_type", "telemetry")
def kpi_by_type(d):
    """Efficiency and fault rate of each vehicle type."""
    return f"SELECT vehicle_type, {d.r6(f'AVG({EFF})')} AS avg_efficiency, {d.r6(d.share('has_fault'))} AS fault_rate FROM telemetry GROUP BY vehicle_type"


@op("a2_daily_efficiency", "telemetry")
def daily_efficiency(d):
    """Mean efficiency by day and type."""
    return f"SELECT CAST(ts AS DATE) AS day, vehicle_type, {d.r6(f'AVG({EFF})')} AS avg_efficiency, COUNT(*) AS trips FROM telemetry GROUP BY CAST(ts AS DATE), vehicle_type"


@op("a3_engine_efficiency", "telemetry", "vehicles")
def engine_efficiency(d):
    """Mean, deviation and count of efficiency by engine, turbo and weight."""
    return f"SELECT v.engine_type, v.is_turbo, v.weight_category, {d.r6(f'AVG(t.{EFF})')} AS mean, {d.r6(f'STDDEV_SAMP(t.{EFF})')} AS std, COUNT(*) AS trips FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid GROUP BY v.engine_type, v.is_turbo, v.weight_category"


@op("a4_efficiency_outliers", "telemetry")
def efficiency_outliers(d, limit=3):
    """Trips whose distance or efficiency is over so many deviations from all trips' mean."""
    z = lambda c: d.r6(f"({c} - m_{c}) / NULLIF(s_{c}, 0)")
    two = (EFF, "idle_time_min")
    return f"""SELECT {KEYS}, {', '.join(f'{z(c)} AS z_{c}' for c in two)} FROM telemetry CROSS JOIN (SELECT {', '.join(f'AVG({c}) AS m_{c}, STDDEV_SAMP({c}) AS s_{c}' for c in two)} FROM telemetry) AS s WHERE {' OR '.join(f'ABS({z(c)}) > {limit}' for c in two)}"""


def pairs(d, names) -> str:
    """Each pair's correlation, from one pass of sums: an array of all pairs, then a row for each."""
    item = lambda a, b: d._(f"named_struct('column_a', '{a}', 'column_b', '{b}', 'r', {d.corr(a, b)})", f"{{'column_a': '{a}', 'column_b': '{b}', 'r': {d.corr(a, b)}}}")
    items = ", ".join(item(a, b) for a, b in combinations(names, 2))
    return f"SELECT p.column_a, p.column_b, p.r FROM (SELECT {d._(f'explode(array({items}))', f'unnest([{items}])')} AS p FROM telemetry) AS w"


@op("a6_correlation_matrix", "telemetry")
def correlation_matrix(d):
    """Correlation of every pair of trip figures, in long form."""
    return f"SELECT column_a, column_b, {d.r6('r')} AS r FROM ({pairs(d, NUMERIC)}) AS p"


@op("a6_strong_pairs", "telemetry")
def strong_pairs(d, low=0.5, high=1.0):
    """Pairs whose correlation is strong, and the ten strongest of efficiency."""
    return f"""SELECT 'strong' AS kind, column_a, column_b, {d.r6('r')} AS r FROM ({pairs(d, NUMERIC)}) AS p WHERE ABS(r) > {low} AND ABS(r) < {high}
UNION ALL SELECT 'target', column_a, column_b, {d.r6('r')} FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY ABS({d.r6('r')}) DESC, column_a, column_b) AS place FROM ({pairs(d, NUMERIC)}) AS p2 WHERE column_a = '{EFF}' OR column_b = '{EFF}') AS t WHERE place <= 10"""


@op("a7_needs_maintenance", "telemetry")
def needs_maintenance(d):
    """Vehicles with a flag, a fault, or over 10 percent less efficiency in their last trip than in their first."""
    return f"""SELECT vehid, {d.r6('loss')} AS efficiency_degradation, flags, faults, loss > 10 OR flags > 0 OR faults > 0 AS needs_maintenance FROM (SELECT vehid, CASE WHEN COUNT(*) > 1 THEN (MIN_BY({EFF}, nth) - MAX_BY({EFF}, nth)) / MIN_BY({EFF}, nth) * 100 ELSE 0 END AS loss, {n_if('maintenance_flag')} AS flags, {n_if('has_fault')} AS faults
  FROM (SELECT *, {NTH} AS nth FROM telemetry) AS o GROUP BY vehid) AS v"""


@op("a8_efficiency_scenarios", "telemetry")
def efficiency_scenarios(d, km=15000):
    """What maintenance (15 percent) and driving (10 percent) may bring by type and class, and what it saves in a year."""
    now, better = f"{km} / mean * {FUEL_PRICE}", f"{km} / (mean * 1.15) * {FUEL_PRICE}"
    return f"""SELECT vehicle_type, vehicle_class, {d.r6('mean')} AS current_efficiency, {d.r6('mean * 1.15')} AS with_maintenance, {d.r6('mean * 1.1')} AS with_better_driving, {d.r6('mean * 0.15')} AS potential_improvement, {d.r2(now)} AS current_annual_cost, {d.r2(better)} AS improved_annual_cost, {d.r2(f'{now} - {better}')} AS annual_savings, {d.r2(f'({now} - {better}) / ({now}) * 100')} AS savings_percentage
FROM (SELECT vehicle_type, vehicle_class, AVG({EFF}) AS mean FROM telemetry GROUP BY vehicle_type, vehicle_class) AS g"""


@op("a8_cost_savings_total", "telemetry")
def cost_savings_total(d, km=15000):
    """All groups' savings, and their mean."""
    one = f"{km} / mean * {FUEL_PRICE} - {km} / (mean * 1.15) * {FUEL_PRICE}"
    return f"SELECT {d.r2(f'SUM({one})')} AS total_potential_savings, {d.r2(f'AVG({one})')} AS average_savings FROM (SELECT AVG({EFF}) AS mean FROM telemetry GROUP BY vehicle_type, vehicle_class) AS g"


@op("a9_performance_recommendations", "telemetry")
def performance_recommendations(d):
    """Advice: the least efficient type, and the vehicles to be serviced."""
    return f"""SELECT 'Fuel Efficiency' AS type, 'Medium' AS priority, CONCAT('Optimize driving patterns for ', worst, ' vehicles') AS action, n AS vehicles FROM (SELECT MIN_BY(vehicle_type, mean) AS worst, CAST(MIN_BY(n, mean) AS BIGINT) AS n FROM (SELECT vehicle_type, AVG({EFF}) AS mean, COUNT(DISTINCT vehid) AS n FROM telemetry GROUP BY vehicle_type) AS g) AS w
UNION ALL SELECT 'Preventive Maintenance', 'High', 'Schedule preventive maintenance', COUNT(DISTINCT vehid) FROM telemetry WHERE maintenance_flag HAVING COUNT(*) > 0"""


BENCH = "SELECT v.*, COALESCE(f.fitted, {default}) AS benchmark FROM vehicles v LEFT JOIN ({fitted}) AS f ON v.vehid = f.vehid"


def benched(d) -> str:
    return BENCH.format(default=default_benchmark("v.vehicle_class", "v.engine_type"), fitted=fitted_benchmark(d))


@op("b1_benchmark_efficiency", "vehicles", "efficiency_benchmarks")
def benchmark_efficiency(d):
    """The benchmark of each vehicle: by displacement range, else the default of its class and engine."""
    return f"SELECT vehid, vehicle_class, engine_type, displacement_l, benchmark FROM ({benched(d)}) AS b"


@op("b2_vehicle_efficiency", "telemetry", "vehicles", "efficiency_benchmarks")
def vehicle_efficiency(d, as_of=AS_OF, days=365):
    """Efficiency, score against the benchmark, and what could be saved, of every vehicle."""
    score = "LEAST(CAST(100 AS DOUBLE), mean / benchmark * 100)"
    return f"""SELECT t.vehid, {d.r6('mean')} AS current_efficiency, {d.r6('sd')} AS efficiency_std, {d.r6('p25')} AS p25, {d.r6('p75')} AS p75, benchmark, {d.r6(score)} AS efficiency_score, {d.r6('GREATEST(0, benchmark - mean)')} AS improvement_potential, {d.r2(f'(km / {days} * 365 / mean - km / {days} * 365 / benchmark) * {FUEL_PRICE}')} AS cost_savings_potential, {level(d.r6(score))} AS category
FROM (SELECT vehid, AVG({EFF}) AS mean, STDDEV_SAMP({EFF}) AS sd, {d.pct(EFF, 0.25)} AS p25, {d.pct(EFF, 0.75)} AS p75, SUM(trip_distance_km) AS km FROM telemetry WHERE {d.since(days, as_of)} GROUP BY vehid) AS t JOIN ({benched(d)}) AS b ON t.vehid = b.vehid"""


@op("b3_efficiency_by_road", "telemetry")
def efficiency_by_road(d):
    """Efficiency of each vehicle on each kind of road."""
    return f"SELECT vehid, road_type, {d.r6(f'AVG({EFF})')} AS avg_efficiency, COUNT(*) AS trip_count, {d.r4('SUM(trip_distance_km)')} AS total_distance FROM telemetry GROUP BY vehid, road_type"


@op("b4_efficiency_trend", "telemetry")
def efficiency_trend(d):
    """Slope of a vehicle's daily efficiency, in percent of its mean by 30 days, with direction, fit and next value."""
    slope = "REGR_SLOPE(mean, x)"
    return f"""SELECT vehid, COUNT(*) AS days, {d.r6(f'COALESCE({slope}, 0)')} AS slope_per_day, {d.r6(f'COALESCE({slope}, 0) * 30 / AVG(mean) * 100')} AS percent_per_30_days, CASE WHEN {d.r6(f'COALESCE({slope}, 0)')} > 0 THEN 'improving' WHEN {d.r6(f'COALESCE({slope}, 0)')} < 0 THEN 'declining' ELSE 'stable' END AS direction,
  {d.r6('REGR_R2(mean, x)')} AS r2, {d.r6(f'REGR_INTERCEPT(mean, x) + {slope} * COUNT(*)')} AS next_value FROM (SELECT vehid, mean, CAST(ROW_NUMBER() OVER (PARTITION BY vehid ORDER BY day) - 1 AS DOUBLE) AS x FROM (SELECT vehid, CAST(ts AS DATE) AS day, AVG({EFF}) AS mean FROM telemetry GROUP BY vehid, CAST(ts AS DATE)) AS g) AS n GROUP BY vehid HAVING COUNT(*) > 2"""


def compared(by: str):
    def build(d):
        return f"""SELECT *, {d.r6(f'avg_efficiency / MAX(avg_efficiency) OVER () * 100')} AS efficiency_score, {d.r2(f'(MAX(avg_efficiency) OVER () - avg_efficiency) / avg_efficiency * fuel_cost')} AS potential_savings FROM (SELECT v.{by}, COUNT(DISTINCT t.vehid) AS vehicle_count, {d.r6(f'AVG({EFF})')} AS avg_efficiency, {d.r6(f'STDDEV_SAMP({EFF})')} AS efficiency_std, MIN({EFF}) AS min_efficiency, MAX({EFF}) AS max_efficiency,
  {d.r2('SUM(trip_distance_km)')} AS total_distance, {d.r2('SUM(fuel_consumed_l)')} AS total_fuel, {d.r2(f'SUM(fuel_consumed_l) * {FUEL_PRICE}')} AS fuel_cost, {d.r6(f'SUM(fuel_consumed_l) * {FUEL_PRICE} / SUM(trip_distance_km)')} AS cost_per_km FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid GROUP BY v.{by}) AS g"""

    build.__doc__, build.__name__ = f"The fleet compared by {by}: efficiency against the best group, cost, savings.", f"compare_by_{by}"
    return build


for _by in ("vehicle_type", "vehicle_class", "engine_type", "transmission_type"):
    op(f"b5_compare_by_{_by}", "telemetry", "vehicles")(compared(_by))


@op("b6_outlier_vehicles", "telemetry")
def outlier_vehicles(d, limit=1.5, least=10):
    """Vehicles whose mean efficiency is far from the fleet's."""
    z = "(mean - AVG(mean) OVER ()) / NULLIF(STDDEV_SAMP(mean) OVER (), 0)"
    return f"""SELECT vehid, vehicle_type, vehicle_class, {d.r6('mean')} AS mean_efficiency, {d.r6('ABS(z)')} AS z_score, {d.r4('(mean - centre) / centre * 100')} AS deviation_percent, CASE WHEN mean > centre THEN 'High Efficiency' ELSE 'Low Efficiency' END AS outlier_type, trips FROM
(SELECT *, {z} AS z, AVG(mean) OVER () AS centre FROM (SELECT vehid, vehicle_type, vehicle_class, AVG({EFF}) AS mean, COUNT(*) AS trips FROM telemetry GROUP BY vehid, vehicle_type, vehicle_class) AS g WHERE trips >= {least}) AS s WHERE ABS(z) > {limit}"""


@op("b7_factor_analysis", "telemetry", "vehicles")
def factor_analysis(d):
    """Efficiency by each value of eight factors, in long form."""
    bins = "CASE WHEN avg_speed_kmph <= 30 THEN '0-30' WHEN avg_speed_kmph <= 60 THEN '30-60' WHEN avg_speed_kmph <= 90 THEN '60-90' ELSE '90+' END"
    factors = {"vehicle_class": "v.vehicle_class", "engine_type": "v.engine_type", "is_turbo": "CASE WHEN v.is_turbo THEN 'true' ELSE 'false' END", "transmission_type": "v.transmission_type", "weight_category": "v.weight_category", "road_type": "t.road_type", "weather_condition": "t.weather_condition", "speed_bin": bins}
    return " UNION ALL ".join(f"SELECT '{k}' AS factor, {x} AS value, COUNT(*) AS trips, {d.r6(f'AVG({EFF})')} AS avg_efficiency, {d.r6(f'STDDEV_SAMP({EFF})')} AS std_efficiency FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid GROUP BY {x}" for k, x in factors.items())


@op("b8_potential_savings", "telemetry", "vehicles")
def potential_savings(d, target=0.1):
    """Savings at a target of better efficiency: for all (type null) and by type."""
    saved = f"CAST({1 - 1 / (1 + target)!r} AS DOUBLE)"
    row = lambda t, tail: f"SELECT {t} AS vehicle_type, COUNT(DISTINCT t.vehid) AS vehicle_count, {d.r4('SUM(trip_distance_km)')} AS total_distance_km, {d.r4('SUM(fuel_consumed_l)')} AS fuel_consumed, {d.r6('SUM(trip_distance_km) / SUM(fuel_consumed_l)')} AS current_efficiency, {d.r4(f'SUM(fuel_consumed_l) * {saved} * {FUEL_PRICE}')} AS cost_savings, {d.r4(f'SUM(fuel_consumed_l) * {saved} * 2.31')} AS co2_reduction_kg FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid {tail}"
    return row("CAST(NULL AS STRING)", "") + " UNION ALL " + row("v.vehicle_type", "GROUP BY v.vehicle_type")


@op("b8_report_summary", "telemetry")
def report_summary(d):
    """One row on the fleet's efficiency, with the best and the worst type."""
    return f"""SELECT {d.r6('SUM(mean * n) / SUM(n)')} AS fleet_efficiency, CAST(SUM(n) AS BIGINT) AS trips, MAX_BY(vehicle_type, mean) AS best_type, MIN_BY(vehicle_type, mean) AS worst_type, {d.r6('MAX(mean) - MIN(mean)')} AS spread FROM (SELECT vehicle_type, AVG({EFF}) AS mean, COUNT(*) AS n FROM telemetry GROUP BY vehicle_type) AS g"""


@op("b9_efficiency_recommendations", "telemetry")
def efficiency_recommendations(d):
    """Advice by rule: the three least efficient types, idling, urban trips."""
    return f"""SELECT 'Fleet Optimization' AS type, 'High' AS priority, CONCAT('Improve efficiency of ', vehicle_type, ' vehicles') AS title, n AS vehicles_affected FROM (SELECT vehicle_type, n, ROW_NUMBER() OVER (ORDER BY mean, vehicle_type) AS place FROM (SELECT vehicle_type, AVG({EFF}) AS mean, COUNT(DISTINCT vehid) AS n FROM telemetry GROUP BY vehicle_type) AS g) AS r WHERE place <= 3
UNION ALL SELECT 'Driver Behavior', 'Medium', 'Reduce vehicle idling time', COUNT(DISTINCT vehid) FROM telemetry HAVING AVG(idle_time_min) > 10
UNION ALL SELECT 'Route Optimization', 'Medium', 'Optimize urban route planning', COUNT(DISTINCT vehid) FROM telemetry HAVING {d.share("road_type = 'Urban'")} > 70"""


@op("b10_refuel_efficiency", "telemetry")
def refuel_efficiency(d):
    """Kilometres by litre from odometers and fills: last less first reading, by all fuel but the first fill."""
    odo = f"SELECT vehid, nth, SUM(trip_distance_km) OVER (PARTITION BY vehid ORDER BY nth) AS odometer_km, fuel_consumed_l AS litres FROM (SELECT *, {NTH} AS nth FROM telemetry) AS o"
    return f"""SELECT vehid, {d.r4('km')} AS distance_km, {d.r4('litres')} AS fuel_l, {d.r6('km / litres')} AS kmpl, {d.r6(f'litres * {FUEL_PRICE} / km')} AS cost_per_km, fills FROM (SELECT vehid, MAX_BY(odometer_km, nth) - MIN_BY(odometer_km, nth) AS km, SUM(CASE WHEN nth > 1 THEN litres END) AS litres, COUNT(*) AS fills FROM ({odo}) AS f GROUP BY vehid) AS g WHERE km > 0"""


@op("b10_inefficient_trips", "telemetry")
def inefficient_trips(d, below=6):
    """Trips under a limit of efficiency, with the one before."""
    return f"SELECT * FROM (SELECT {KEYS}, {EFF}, LAG({EFF}) OVER (PARTITION BY vehid ORDER BY {ORDER}, {EFF}) AS previous FROM telemetry) AS t WHERE {EFF} < {below}"


def frame(n: int, by: str = "vehid") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY nth ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolled(f: str, x: str, n: int, least: int, by: str = "vehid") -> str:
    return f"CASE WHEN COUNT({x}) {frame(n, by)} >= {least} THEN {f}({x}) {frame(n, by)} END"


def running(x: str, by: str = "vehid") -> str:
    """Sum and number of a count's values so far. On Spark a frame that slides adds up all its rows for each row, a running sum one."""
    over = f"OVER (PARTITION BY {by} ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"SUM(COALESCE({x}, 0)) {over} AS {x}_so_far, COUNT({x}) {over} AS {x}_known"


def since(f: str, x: str, n: int, least: int, by: str = "vehid") -> str:
    """`rolled` for sums of counts, by what `running` gives: the sum so far less that of n rows before."""
    within = lambda c: f"({c} - LAG({c}, {n}, 0L) OVER (PARTITION BY {by} ORDER BY nth))"
    return f"CASE WHEN {within(f'{x}_known')} >= {least} THEN {within(f'{x}_so_far')} END"


M1 = {
    "rpm_variance": ("STDDEV_SAMP", "avg_rpm", 5, 3),
    "brake_wear_indicator": ("SUM", "harsh_braking_count", 20, 10),
    "fault_history": ("SUM", "fault", 50, 25),
    "maintenance_history": ("SUM", "flag", 100, 50),
}
#: The sums of M1 are of counts.
COUNTED = [x for f, x, _, _ in M1.values() if f == "SUM"]
FIRST_MA = "FIRST_VALUE(ma) OVER (PARTITION BY vehid ORDER BY CASE WHEN ma IS NULL THEN 1 ELSE 0 END, nth ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def maintenance_base(d, nth: str = NTH.replace("vehid", "t.vehid", 1), by: str = "vehid") -> str:
    """Trips with their number in the vehicle's order, their stress, and the mean efficiency of the last ten."""
    stress = "avg_rpm / 1000 * avg_engine_temp_c / 100 * CASE WHEN v.is_turbo THEN 1.2 ELSE 1.0 END"
    flags = "CASE WHEN has_fault THEN 1 ELSE 0 END AS fault, CASE WHEN maintenance_flag THEN 1 ELSE 0 END AS flag"
    inner = f"SELECT t.*, {nth} AS nth, {flags}, {stress} AS stress, v.engine_type, v.displacement_l FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid"
    sums = d._("".join(f", {running(x, by)}" for x in COUNTED), "")
    return f"SELECT *, {rolled('AVG', EFF, 10, 5, by)} AS ma{sums} FROM ({inner}) AS b"


def maintenance_text(d, base: str, first: str = "", by: str = "vehid", also: str = "") -> str:
    first = first or d._("MIN_BY(ma, CASE WHEN ma IS NOT NULL THEN nth END) OVER (PARTITION BY vehid)", FIRST_MA)  # the first needs no order of its own on Spark
    of = lambda spec: since if d.spark and spec[1] in COUNTED else rolled
    rolling = ", ".join(f"{d.r6(of(spec)(*spec, by))} AS {k}" for k, spec in M1.items())
    return f"""SELECT {KEYS}, nth, {d.r6('stress')} AS engine_stress, {d.r6('ma')} AS efficiency_ma, {d.r6(f'({first} - ma) / {first} * 100')} AS efficiency_degradation,
  avg_engine_temp_c > 105 AS temp_anomaly, {rolling}, {d.hour('ts')} AS hour_of_day, {d.dow('ts')} AS day_of_week,
  {d.r6('trip_distance_km * avg_speed_kmph / 100')} AS trip_intensity, {d.r6('1 - driver_behavior_score')} AS driver_impact{also} FROM ({base}) AS m"""


@op("m1_maintenance_features", "telemetry", "vehicles")
def maintenance_features(d):
    """Rolling stress, degradation, variance and history of each trip's vehicle."""
    return maintenance_text(d, maintenance_base(d))


@op("m4_zscore_anomalies", "telemetry")
def zscore_anomalies(d, limit=2):
    """The farthest of four figures of a trip from its type's mean, if beyond the limit on the side that counts."""
    metrics = {EFF: "ABS(z)", "avg_engine_temp_c": "z", "avg_rpm": "ABS(z)", "idle_time_min": "z"}
    stats = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_SAMP({c}) AS s_{c}" for c in metrics)
    long = " UNION ALL ".join(f"SELECT {KEYS}, vehicle_type, vehicle_class, '{c}' AS anomaly_metric, {d.r6(f'({c} - m_{c}) / NULLIF(s_{c}, 0)')} AS z, {k} AS place FROM b" for k, c in enumerate(metrics))
    test = " OR ".join(f"anomaly_metric = '{c}' AND {side} > {limit}" for c, side in metrics.items())
    few = d._("/*+ BROADCAST(s) */ ", "")  # a row for each type: rows are not dealt out by it
    return f"""WITH b AS (SELECT {few}t.*, {', '.join(f'm_{c}, s_{c}' for c in metrics)} FROM telemetry t JOIN (SELECT vehicle_type, {stats} FROM telemetry GROUP BY vehicle_type HAVING COUNT(*) > 10) AS s ON t.vehicle_type = s.vehicle_type)
SELECT vehid, vehicle_type, vehicle_class, ts, anomaly_metric, z AS z_score, CASE WHEN ABS(z) <= {limit + 1} THEN 'LOW' WHEN ABS(z) <= {limit + 2} THEN 'MEDIUM' WHEN ABS(z) <= 10 THEN 'HIGH' END AS severity FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehid, ts ORDER BY ABS(z) DESC, place, l_orderkey, l_linenumber, l_partkey) AS nth FROM ({long}) AS l WHERE {test}) AS r WHERE nth = 1"""


@op("m5_failure_types", "telemetry")
def failure_types(d):
    """The likeliest failure of each vehicle by rules on its last 50 trips, and its other risks."""
    rules = [("ENGINE_OVERHEATING", "hot > 5", "LEAST(0.8, hot / n)"), ("FUEL_SYSTEM_ISSUE", "eff_sd > 5", "LEAST(0.6, eff_sd / 10)"), ("BRAKE_SYSTEM_ISSUE", "brakes > 20", "LEAST(0.7, brakes / 100)"), ("ELECTRICAL_SYSTEM_ISSUE", "low > 10", "LEAST(0.9, low / n)"), ("TRANSMISSION_ISSUE", "rpm_sd > 500", "LEAST(0.5, rpm_sd / 1000)")]
    p = ", ".join(f"CASE WHEN {c} THEN {d.r6(x)} END AS p{k}" for k, (_, c, x) in enumerate(rules))
    best = "GREATEST(" + ", ".join(f"COALESCE(p{k}, -1)" for k in range(5)) + ")"
    named = "CASE " + " ".join(f"WHEN p{k} = top THEN {k}" for k in range(5)) + " END"
    name = "CASE pick " + " ".join(f"WHEN {k} THEN '{r[0]}'" for k, r in enumerate(rules)) + " END"
    others = "concat_ws(', ', " + ", ".join(f"CASE WHEN p{k} IS NOT NULL AND pick <> {k} THEN '{r[0]}' END" for k, r in enumerate(rules)) + ")"
    return f"""SELECT vehid, vehicle_type, vehicle_class, {name} AS predicted_failure_type, top AS failure_probability, {d.r6('LEAST(0.9, n / 100)')} AS confidence, {others} AS additional_risks FROM (SELECT *, {named} AS pick FROM (SELECT *, {best} AS top FROM (SELECT *, {p} FROM
(SELECT vehid, vehicle_type, vehicle_class, CAST(COUNT(*) AS DOUBLE) AS n, CAST({n_if('avg_engine_temp_c > 110')} AS DOUBLE) AS hot, STDDEV_SAMP({EFF}) AS eff_sd, CAST(SUM(harsh_braking_count) AS DOUBLE) AS brakes, CAST({n_if('battery_voltage < 12')} AS DOUBLE) AS low, STDDEV_SAMP(avg_rpm) AS rpm_sd
 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehid ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, {EFF} DESC) AS latest FROM telemetry) AS r WHERE latest <= 50 GROUP BY vehid, vehicle_type, vehicle_class HAVING COUNT(*) >= 10) AS g) AS q) AS b) AS c WHERE top >= 0"""


@op("m6_maintenance_schedule", "telemetry", "vehicles")
def maintenance_schedule(d, as_of=AS_OF, horizon=90):
    """When vehicles are due for service at their kilometres a day, within the horizon."""
    return f"""SELECT *, CASE WHEN days_from_now < 7 THEN 'HIGH' WHEN days_from_now < 30 THEN 'MEDIUM' ELSE 'LOW' END AS priority, 4 AS estimated_duration_hours, 200 AS estimated_cost FROM (SELECT v.vehid, v.vehicle_type, v.vehicle_class, {d.r6('km / observed')} AS km_per_day, {d.r4('GREATEST(0, service_interval_km - (odometer_km - last_service_km)) / (km / observed)')} AS days_from_now
  FROM vehicles v JOIN (SELECT vehid, SUM(trip_distance_km) AS km, {d.days('CAST(MIN(ts) AS DATE)', 'CAST(MAX(ts) AS DATE)')} + 1 AS observed FROM telemetry GROUP BY vehid) AS t ON v.vehid = t.vehid) AS s WHERE days_from_now <= {horizon}"""


@op("m7_maintenance_cost_benefit", "telemetry", "maintenance_history")
def maintenance_cost_benefit(d, investment=10000):
    """Costs now, savings with an investment, its return and payback."""
    total = "corrective * 0.3 + emergency * 0.5 + flags * km / 365 * 0.85 * 0.2 + fuel * 0.15 * 1.2"
    return f"""SELECT {d.r2('spent')} AS annual_maintenance_cost, {d.r2('flags * km / 365 * 0.85')} AS annual_downtime_cost, {d.r2('corrective * 0.3')} AS corrective_reduction, {d.r2('emergency * 0.5')} AS emergency_reduction, {d.r2('flags * km / 365 * 0.85 * 0.2')} AS downtime_reduction, {d.r2('fuel * 0.15 * 1.2')} AS fuel_improvement, {d.r2(total)} AS total_annual_savings, {d.r2(f'({total}) / {investment} * 100')} AS annual_roi_percent, {d.r6(f'{investment} / ({total}) * 12')} AS payback_months, {d.r2(f'({total}) * 4.3294766706 - {investment}')} AS five_year_npv_at_5_percent
FROM (SELECT SUM(cost) AS spent, COALESCE(SUM(CASE WHEN maintenance_type = 'Corrective' THEN cost END), 0) AS corrective, COALESCE(SUM(CASE WHEN maintenance_type = 'Emergency' THEN cost END), 0) AS emergency FROM maintenance_history) AS m CROSS JOIN (SELECT {n_if('maintenance_flag')} AS flags, SUM(trip_distance_km) AS km, SUM(fuel_consumed_l) AS fuel FROM telemetry) AS t"""


@op("m8_component_health", "readings")
def component_health(d):
    """Health of engine, oil, battery and tyres of each vehicle, with the issues found."""
    parts = {"engine": "engine_temperature_c > 120", "oil": "oil_pressure_kpa < 150", "battery": "battery_voltage < 11.8", "tires": "tire_pressure_psi < 30"}
    return " UNION ALL ".join(f"SELECT vehicle_id, '{k}' AS component, COUNT(*) AS readings, {n_if(c)} AS issues, {d.r4(f'100 - {d.share(c)}')} AS health, CASE WHEN {d.r4(d.share(c))} > 20 THEN 'CRITICAL' WHEN {d.r4(d.share(c))} > 5 THEN 'WARNING' ELSE 'HEALTHY' END AS state FROM readings GROUP BY vehicle_id" for k, c in parts.items())


@op("m8_maintenance_forecast", "maintenance_history")
def maintenance_forecast(d):
    """Cost by month, the line through it, and next month's cost."""
    return f"""SELECT COUNT(*) AS months, {d.r2('AVG(cost)')} AS mean_cost, {d.r4('REGR_SLOPE(cost, x)')} AS slope, {d.r2('REGR_INTERCEPT(cost, x) + REGR_SLOPE(cost, x) * COUNT(*)')} AS next_month FROM (SELECT cost, CAST(ROW_NUMBER() OVER (ORDER BY month) - 1 AS DOUBLE) AS x FROM (SELECT {d.month('maintenance_date')} AS month, SUM(cost) AS cost FROM maintenance_history GROUP BY {d.month('maintenance_date')}) AS g) AS n"""


@op("m8_next_maintenance", "maintenance_history")
def next_maintenance(d):
    """The mean days between a vehicle's maintenances, and the day that gives for the next."""
    gap = d.days("LAG(maintenance_date) OVER (PARTITION BY vehid ORDER BY maintenance_date, maintenance_id)", "maintenance_date")
    return f"SELECT vehid, events, latest, {d.r4('gap')} AS mean_gap_days, latest + CAST(floor(gap) AS INT) AS next_date FROM (SELECT vehid, COUNT(*) AS events, MAX(maintenance_date) AS latest, AVG(gap) AS gap FROM (SELECT *, {gap} AS gap FROM maintenance_history) AS l GROUP BY vehid) AS g WHERE gap IS NOT NULL"


@op("d1_driver_rollup", "telemetry")
def driver_rollup(d):
    """Scores, category, advice, CO2 and premium of each vehicle's driving."""
    overall = "safety * 0.6 + efficiency * 0.4"
    low = f"{d._(d.rounded('score', '1.3e-12', 9), 'score')} < 0.8"  # on Spark rounded, so that a mean of 0.8 is never below it, in whatever order it was summed up
    advice = d.listing([("acc > 5", "Reduce harsh acceleration"), ("brake > 3", "Improve braking technique"), ("speeding > 10", "Observe speed limits"), (low, "Consider defensive driving course")])
    return f"""SELECT vehid, trips AS total_trips_analyzed, {d.r2('km')} AS total_distance_km, {d.r4('score')} AS avg_driver_score, {d.r4('safety')} AS safety_score, {d.r4('efficiency')} AS efficiency_score, {d.r4(overall)} AS overall_score, {banded(d.r4(overall), [('>= 90', "'Excellent'"), ('>= 80', "'Good'"), ('>= 70', "'Average'"), ('>= 60', "'Needs Improvement'")], "'Poor'")} AS driver_category, acc AS harsh_acceleration_count, brake AS harsh_braking_count, speeding AS speeding_count, {d.r4('idle')} AS idle_time_percentage,
  COALESCE(NULLIF({advice}, ''), 'No specific recommendations') AS recommendations, {d.r2('fuel * 2.31')} AS co2_emissions_kg, {d.r2(f'fuel * {FUEL_PRICE}')} AS fuel_cost_usd, {d.r4(f'1 - ({overall}) / 200')} AS insurance_premium_factor
FROM (SELECT *, CAST(GREATEST(0, 100 - (acc * 5 + brake * 10 + speeding * 3)) AS DOUBLE) AS safety, mean / 20 * 100 AS efficiency FROM (SELECT vehid, COUNT(*) AS trips, SUM(trip_distance_km) AS km, AVG(driver_behavior_score) AS score, CAST(SUM(harsh_acceleration_count) AS BIGINT) AS acc, CAST(SUM(harsh_braking_count) AS BIGINT) AS brake, CAST(SUM(speeding_count) AS BIGINT) AS speeding, AVG({EFF}) AS mean, SUM(fuel_consumed_l) AS fuel, {d.div('SUM(idle_time_min)', 'SUM(trip_duration_min)')} * 100 AS idle FROM telemetry GROUP BY vehid) AS g) AS s"""


STRESS = "(LEAST(GREATEST(engine_temperature_c, 70), 120) / 120 * 0.4 + LEAST(GREATEST(rpm, 0), 6000) / 6000 * 0.3 + LEAST(GREATEST(speed_kmh, 0), 150) / 150 * 0.3)"
INSTANT = "LEAST(CAST(50 AS DOUBLE), GREATEST(CAST(0 AS DOUBLE), speed_kmh / (fuel_consumption_lph + 0.000001)))"


def driver_scored(d) -> str:
    scaled = lambda x: d.div(f"({x} - MIN({x}) OVER ())", f"(MAX({x}) OVER () - MIN({x}) OVER ())")
    rate = lambda c: f"1 - {d.div(n_if(c), 'COUNT(*)')}"
    return f"""SELECT driver_id, readings, speeding, acceleration, braking, {d.r6(scaled('eff'))} AS efficiency, {d.r6(f'1 - {scaled("stress")}')} AS care FROM (SELECT driver_id, COUNT(*) AS readings, {d.r6(rate('speed_kmh > 100'))} AS speeding, {d.r6(rate('ABS(acceleration_x) > 2'))} AS acceleration, {d.r6(rate('acceleration_x < -3'))} AS braking, AVG({INSTANT}) AS eff, AVG({STRESS}) AS stress FROM readings GROUP BY driver_id) AS g"""


@op("d2_driver_scores", "readings")
def driver_scores(d):
    """Weighted score of each driver out of 100, and the rank."""
    whole = d.r6("(speeding * 0.25 + acceleration * 0.2 + braking * 0.2 + efficiency * 0.2 + care * 0.15) * 100")
    return f"SELECT *, DENSE_RANK() OVER (ORDER BY overall_score DESC) AS place FROM (SELECT driver_id, speeding AS speeding_score, acceleration AS acceleration_score, braking AS braking_score, efficiency AS efficiency_score, care AS engine_care_score, {whole} AS overall_score FROM ({driver_scored(d)}) AS s) AS w"


@op("d3_risky_behaviors", "readings")
def risky_behaviors(d):
    """Drivers who speed over a tenth, or brake hard over a twentieth, of the time."""
    found = d.listing([("speeding > 10", "Speeding"), ("braking > 5", "Hard braking"), ("accelerating > 20", "Aggressive acceleration")], ", ")
    return f"SELECT driver_id, {d.r4('speeding')} AS speeding_percent, {d.r4('braking')} AS hard_braking_percent, {d.r4('accelerating')} AS acceleration_percent, {found} AS behaviors FROM (SELECT driver_id, {d.share('speed_kmh > 100')} AS speeding, {d.share('acceleration_x < -3')} AS braking, {d.share('ABS(acceleration_x) > 2')} AS accelerating FROM readings GROUP BY driver_id) AS g WHERE speeding > 10 OR braking > 5 OR accelerating > 20"


@op("w26_window_costs", "telemetry", "vehicles")
def window_costs(d):
    """Costs and CO2 of 15-minute windows, summed up by vehicle."""
    quarter = d.div(d.seconds(d.ts("1990-01-01"), "ts"), "900")
    return f"""SELECT vehid, COUNT(*) AS windows, CAST(SUM(n) AS BIGINT) AS trips, {d.r4(f'SUM(fuel) * {FUEL_PRICE}')} AS fuel_cost, {d.r4('SUM(kg)')} AS co2_kg, {d.r4('MAX(km)')} AS longest_window_km FROM (SELECT t.vehid, floor({quarter}) AS w, COUNT(*) AS n, SUM(fuel_consumed_l) AS fuel, SUM(fuel_consumed_l * {co2('v.engine_type')}) AS kg, SUM(trip_distance_km) AS km FROM telemetry t JOIN vehicles v ON t.vehid = v.vehid GROUP BY t.vehid, floor({quarter})) AS g GROUP BY vehid"""
