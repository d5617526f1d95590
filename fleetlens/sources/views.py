"""Fleet tables as views of the test tables, in SQL that Spark and the oracle engine both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.dialect import ORACLE, SPARK, Dialect, cut
from ..rules import BENCHMARKS, EFFICIENCY_EDGES, WEIGHT_EDGES


def ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE)"


def vehicle_master(d: Dialect) -> str:
    """Raw master data, as delivered: engine and transmission are texts, some values are missing or 'NO DATA'."""
    displacement = f"CASE WHEN s_suppkey % 5 = 1 THEN CAST(0 AS DOUBLE) ELSE {ratio('10 + s_suppkey % 31', '10')} END"
    return f"""SELECT CAST(s_suppkey AS INT) AS vehid,
  CASE s_suppkey % 5 WHEN 0 THEN 'HEV' WHEN 1 THEN 'BEV' WHEN 2 THEN 'PHEV' ELSE 'ICE' END AS vehicle_type,
  CASE WHEN s_suppkey % 7 = 3 THEN 'NO DATA' ELSE CASE s_nationkey % 4 WHEN 0 THEN 'Compact' WHEN 1 THEN 'Midsize' WHEN 2 THEN 'SUV' ELSE 'Truck' END END AS vehicle_class,
  CASE WHEN s_suppkey % 5 = 1 THEN 'NO DATA' ELSE CONCAT(CAST(3 + s_suppkey % 6 AS STRING), '-', CASE WHEN s_suppkey % 5 IN (0, 2) THEN 'GAS/ELECTRIC ' WHEN s_suppkey % 2 = 0 THEN 'DSL ' ELSE 'GAS ' END,
    CAST(CAST(({displacement}) * 10 AS INT) / 10.0 AS DECIMAL(4,1)), 'L', CASE WHEN s_suppkey % 3 = 0 THEN ' T/C' ELSE '' END) END AS engine_configuration,
  CASE s_suppkey % 4 WHEN 0 THEN CONCAT(CAST(4 + s_suppkey % 6 AS STRING), '-SP AUTOMATIC') WHEN 1 THEN 'CVT' WHEN 2 THEN CONCAT(CAST(5 + s_suppkey % 2 AS STRING), '-SP MANUAL') ELSE 'NO DATA' END AS transmission,
  CASE WHEN s_suppkey % 11 = 4 THEN CAST(NULL AS INT) ELSE CAST(2000 + s_suppkey * 37 % 5000 AS INT) END AS generalized_weight
FROM supplier"""


def vehicles(d: Dialect) -> str:
    displacement = f"CASE WHEN s_suppkey % 5 = 1 THEN CAST(0 AS DOUBLE) ELSE {ratio('10 + s_suppkey % 31', '10')} END"
    base = f"""SELECT CAST(s_suppkey AS INT) AS vehid,
  CASE s_suppkey % 5 WHEN 0 THEN 'HEV' WHEN 1 THEN 'BEV' WHEN 2 THEN 'PHEV' ELSE 'ICE' END AS vehicle_type,
  CASE s_nationkey % 4 WHEN 0 THEN 'Compact' WHEN 1 THEN 'Midsize' WHEN 2 THEN 'SUV' ELSE 'Truck' END AS vehicle_class,
  CASE WHEN s_suppkey % 5 IN (0, 2) THEN 'Hybrid' WHEN s_suppkey % 5 = 1 THEN 'Electric' WHEN s_suppkey % 2 = 0 THEN 'Diesel' ELSE 'Gasoline' END AS engine_type,
  {displacement} AS displacement_l, CAST(3 + s_suppkey % 6 AS INT) AS engine_cylinders,
  s_suppkey % 3 = 0 AS is_turbo, s_suppkey % 5 IN (0, 2) AS is_hybrid,
  CAST(2000 + s_suppkey * 37 % 5000 AS INT) AS generalized_weight, CAST(2010 + s_suppkey % 14 AS INT) AS manufacture_year,
  CASE s_suppkey % 4 WHEN 0 THEN 'Automatic' WHEN 1 THEN 'CVT' WHEN 2 THEN 'Manual' ELSE 'Unknown' END AS transmission_type,
  CAST(10000 + s_suppkey * 977 % 150000 AS BIGINT) AS odometer_km,
  CAST(10000 + s_suppkey * 977 % 150000 - s_suppkey * 613 % 18000 AS BIGINT) AS last_service_km,
  CAST(10000 + 5000 * (s_suppkey % 3) AS BIGINT) AS service_interval_km
FROM supplier"""
    score = f"{ratio('generalized_weight', '1')} / (displacement_l + CAST(1 AS DOUBLE) / CAST(10 AS DOUBLE))"
    return f"""SELECT *, {cut('generalized_weight', *WEIGHT_EDGES)} AS weight_category, {score} AS efficiency_score, {cut(score, *EFFICIENCY_EDGES, lowest=False)} AS efficiency_category
FROM ({base}) AS v"""


def telemetry(d: Dialect) -> str:
    base = f"""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey AS INT) AS vehid, l_shipdate AS shipped,
  CONCAT('T', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), CASE WHEN l_partkey % 97 = 0 THEN '-SUMMARY' ELSE '' END) AS trip_id,
  l_shipdate + INTERVAL '1' MINUTE * CAST((l_orderkey * 7 + l_linenumber * 131 + l_partkey) % 1440 AS INT) AS ts,
  l_quantity * 2 AS trip_distance_km, CAST(20 + l_partkey % 111 AS DOUBLE) AS avg_speed_kmph,
  4 + l_discount * 100 + l_tax * 100 AS fuel_efficiency_kmpl, CAST(85 + l_orderkey % 36 AS DOUBLE) AS avg_engine_temp_c,
  l_returnflag = 'R' AND l_orderkey % 4 = 0 AS has_fault,
  CASE WHEN l_returnflag = 'R' AND l_orderkey % 4 = 0 THEN CONCAT(CASE l_partkey % 4 WHEN 0 THEN 'P0301' WHEN 1 THEN 'P0171' WHEN 2 THEN 'P0500' ELSE 'U0100' END, CASE WHEN l_linenumber % 2 = 0 THEN ',P0442' ELSE '' END) END AS fault_codes,
  CAST(1500 + CAST(floor(l_extendedprice) AS BIGINT) % 2000 AS DOUBLE) AS avg_rpm,
  (l_orderkey + l_linenumber) % 31 = 0 AS maintenance_flag, {ratio('60 + (l_suppkey * 13 + l_orderkey) % 41', '100')} AS driver_behavior_score,
  CAST(l_orderkey % 4 AS INT) AS harsh_acceleration_count, CAST(l_partkey % 3 AS INT) AS harsh_braking_count, CAST(l_linenumber % 6 AS INT) AS speeding_count,
  CASE l_orderkey % 4 WHEN 0 THEN 'Clear' WHEN 1 THEN 'Rain' WHEN 2 THEN 'Snow' ELSE 'Fog' END AS weather_condition,
  CASE l_partkey % 4 WHEN 0 THEN 'Urban' WHEN 1 THEN 'Highway' WHEN 2 THEN 'Mixed' ELSE 'Rural' END AS road_type,
  {ratio('110 + l_partkey % 40', '10')} AS battery_voltage, {ratio('40000 + l_orderkey % 1000', '1000')} AS location_lat, {ratio('-74500 + l_partkey % 1000', '1000')} AS location_lon
FROM lineitem"""
    timed = f"SELECT *, trip_distance_km / avg_speed_kmph * 60 AS trip_duration_min, trip_distance_km / fuel_efficiency_kmpl AS fuel_consumed_l FROM ({base}) AS b"
    return f"""SELECT t.*, trip_duration_min * {ratio('l_linenumber * 3', '100')} AS idle_time_min, v.vehicle_type, v.vehicle_class
FROM ({timed}) AS t JOIN vehicles v ON t.vehid = v.vehid"""


def maintenance_history(d: Dialect) -> str:
    return """SELECT o_orderkey AS maintenance_id, CAST(o_custkey % (SELECT COUNT(*) FROM supplier) AS INT) AS vehid, CAST(o_orderdate AS DATE) AS maintenance_date,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Emergency' WHEN '2' THEN 'Corrective' ELSE 'Preventive' END AS maintenance_type, o_totalprice / 100 AS cost
FROM orders WHERE o_orderstatus = 'P'"""


def driver_behavior(d: Dialect) -> str:
    """A day's driving of each vehicle: scores from the day's counts, and what follows from them."""
    day = """SELECT vehid, CAST(ts AS DATE) AS analysis_date, CONCAT('DRV', CAST(vehid AS STRING)) AS driver_id, COUNT(*) AS trips,
  SUM(harsh_acceleration_count) AS harsh_acceleration_count, SUM(harsh_braking_count) AS harsh_braking_count, SUM(speeding_count) AS speeding_count,
  SUM(CAST(trip_duration_min AS DECIMAL(18,4))) AS minutes, SUM(CAST(idle_time_min AS DECIMAL(18,4))) AS idle, SUM(CAST(fuel_efficiency_kmpl AS DECIMAL(18,4))) AS efficiency,
  SUM(CASE WHEN hour(ts) >= 22 OR hour(ts) <= 5 THEN CAST(trip_duration_min AS DECIMAL(18,4)) ELSE 0 END) AS night
FROM telemetry GROUP BY vehid, CAST(ts AS DATE)"""
    scored = f"""SELECT *, CAST(GREATEST(0, 100 - 5 * harsh_acceleration_count - 10 * harsh_braking_count - 3 * speeding_count) AS DOUBLE) AS safety_score,
  CAST(efficiency AS DOUBLE) / trips / 20 * 100 AS efficiency_score FROM ({day}) AS g"""
    whole = f"SELECT *, safety_score * 3 / 5 + efficiency_score * 2 / 5 AS overall_score FROM ({scored}) AS s"
    category = "CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 80 THEN 'Good' WHEN overall_score >= 70 THEN 'Average' WHEN overall_score >= 60 THEN 'Needs Improvement' ELSE 'Poor' END"
    return f"""SELECT vehid, analysis_date, driver_id, CAST(trips AS BIGINT) AS trips, CAST(harsh_acceleration_count AS BIGINT) AS harsh_acceleration_count, CAST(harsh_braking_count AS BIGINT) AS harsh_braking_count, CAST(speeding_count AS BIGINT) AS speeding_count,
  CAST(night AS DOUBLE) / 60 AS night_driving_hours, CAST(idle AS DOUBLE) / NULLIF(CAST(minutes AS DOUBLE), 0) * 100 AS idle_time_percentage,
  safety_score, efficiency_score, overall_score, {category} AS driver_category, 1 - overall_score / 200 AS insurance_premium_factor
FROM ({whole}) AS w"""


def efficiency_benchmarks(d: Dialect) -> str:
    rows = ", ".join(f"('{c}', '{e}', '{r}', CAST({x} AS DOUBLE))" for c, e, r, x in BENCHMARKS)
    low, high = d.extract("displacement_range", "^([0-9.]+)-"), d.extract("displacement_range", "-([0-9.]+)L?$")
    return f"""SELECT vehicle_class, engine_type, displacement_range, mixed_efficiency_kmpl, CAST({low} AS DOUBLE) AS low_l, CAST({high} AS DOUBLE) AS high_l
FROM (VALUES {rows}) AS b(vehicle_class, engine_type, displacement_range, mixed_efficiency_kmpl)"""


def alerts(d: Dialect) -> str:
    return """SELECT event_id AS alert_id, CAST(user_id % (SELECT COUNT(*) FROM supplier) AS INT) AS vehid, CASE WHEN value > 150 THEN 'CRITICAL' WHEN value > 50 THEN 'WARNING' ELSE 'INFO' END AS severity,
  CASE event_id % 3 WHEN 0 THEN 'ENGINE' WHEN 1 THEN 'FUEL' ELSE 'BRAKES' END AS alert_type, ts, CASE WHEN event_id % 4 = 0 THEN 'RESOLVED' ELSE 'ACTIVE' END AS status
FROM events WHERE event_type = 'error'"""


def readings(d: Dialect) -> str:
    k = d.json_int("props", "k")
    return f"""SELECT event_id, user_id AS vehicle_id, ts, event_type, LEAST(value, CAST(200 AS DOUBLE)) AS speed_kmh, CAST(80 + event_id % 50 AS DOUBLE) AS engine_temperature_c,
  CAST({k} % 101 AS DOUBLE) AS fuel_level_percent, CAST(700 + event_id * 37 % 4300 AS DOUBLE) AS rpm, {ratio('1100 + event_id % 400', '100')} AS battery_voltage,
  {ratio('40000 + event_id * 7 % 1000', '1000')} AS latitude, {ratio('-74500 + event_id * 13 % 1000', '1000')} AS longitude,
  CAST(120 + event_id * 11 % 300 AS DOUBLE) AS oil_pressure_kpa, {ratio('280 + event_id * 3 % 90', '10')} AS tire_pressure_psi,
  CAST(40 + event_id * 19 % 200 AS DOUBLE) AS brake_temperature_c, CAST(8 + event_id * 23 % 60 AS DOUBLE) AS brake_pressure_bar,
  {ratio('event_id * 17 % 100 - 50', '10')} AS acceleration_x, {ratio('event_id * 29 % 100 - 50', '10')} AS acceleration_y, {ratio('30 + event_id % 200', '10')} AS fuel_consumption_lph,
  CAST(1000 + event_id * 3 AS DOUBLE) AS odometer_km, CONCAT('DRV', CAST(user_id % 40 AS STRING)) AS driver_id
FROM events"""


VIEWS = {f.__name__: f for f in (vehicle_master, vehicles, telemetry, maintenance_history, driver_behavior, efficiency_benchmarks, alerts, readings)}
NEEDS = {"telemetry": ("vehicles",), "driver_behavior": ("vehicles", "telemetry")}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def wanted(names) -> list[str]:
    out: list[str] = []
    for name in names:
        for n in (*NEEDS.get(name, ()), name):
            if n not in out and n in VIEWS:
                out.append(n)
    return out


def oracle_ctes(names) -> str:
    return ",\n".join(f"{n} AS ({VIEWS[n](ORACLE)})" for n in wanted(names))


def fleet_views(spark: SparkSession, sf_dir: str, names=tuple(VIEWS)) -> dict[str, DataFrame]:
    """The named views as DataFrames over the Parquet tables of a folder."""
    from ..plans.dialect import bound

    out: dict[str, DataFrame] = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names if n in TABLES}
    for n in wanted(names):
        text = VIEWS[n](SPARK)
        frames = {k: v for k, v in out.items()}
        for t in TABLES:
            if f" {t}" in text:
                frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        out[n] = spark.sql(bound(text, tuple(frames)), **frames)
    return {n: out[n] for n in names}
