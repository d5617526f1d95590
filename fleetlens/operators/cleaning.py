"""Cleaning of vehicle master data and of sensor readings. Every operator: inputs in, one DataFrame out, nothing collected."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dialect import cut, op
from ..plans.parts import n_if
from ..rules import EFFICIENCY_EDGES, WEIGHT_CLASSES, WEIGHT_EDGES

SENTINEL = "NO DATA"
READING_RULES = {"speed_kmh": (0, 180), "rpm": (0, 8000), "engine_temperature_c": (-40, 120), "fuel_level_percent": (0, 100), "battery_voltage": (9, 16), "latitude": (-90, 90), "longitude": (-180, 180)}
VEHICLE_RULES = {"displacement_l": (0.5, 8), "generalized_weight": (1000, 10000)}


def standardize_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names, blanks and dashes as underscores."""
    return df.toDF(*(re.sub(r"[\s\-]+", "_", c.strip().lower()) for c in df.columns))


def validate_frame(df: DataFrame, required: list[str], keys: list[str] = (), types: dict[str, str] | None = None) -> DataFrame:
    """check, column, failures: missing columns, wrong types, and null keys, in one pass over the data."""
    session, found = df.sparkSession, dict(df.dtypes)
    static = [("missing column", c, 1) for c in required if c not in found]
    static += [(f"type is {found[c]}, not {t}", c, 1) for c, t in (types or {}).items() if c in found and found[c] != t]
    out = session.createDataFrame(static, "check string, column string, failures long")
    present = [c for c in keys if c in found]
    if present:
        nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in present))
        out = out.unionByName(nulls.unpivot([], present, "column", "failures").select(F.lit("null key").alias("check"), "column", "failures"))
    return out


def classed(weight: str, vehicle_class: str = "vehicle_class") -> str:
    by_weight = " ".join(f"WHEN {weight} < {limit} THEN '{name}'" for limit, name in WEIGHT_CLASSES)
    return f"COALESCE(NULLIF({vehicle_class}, '{SENTINEL}'), CASE WHEN {weight} IS NULL THEN 'Unknown' {by_weight} ELSE 'Heavy Duty' END)"


@op("c2_fill_vehicle_class", "vehicle_master")
def fill_vehicle_class(d):
    """The sentinel becomes null; a missing class comes from the (not yet imputed) weight."""
    return f"SELECT vehid, vehicle_type, {classed('generalized_weight')} AS vehicle_class, NULLIF(engine_configuration, '{SENTINEL}') AS engine_configuration, NULLIF(transmission, '{SENTINEL}') AS transmission, generalized_weight FROM vehicle_master"


def engine_columns(d, x: str) -> dict[str, str]:
    number = lambda text, kind: f"CAST(NULLIF({text}, '') AS {kind})"
    hybrid = f"COALESCE({x} LIKE '%ELECTRIC%', FALSE)"
    return {
        "engine_cylinders": number(d.extract(x, r"(\d+)[-\s]"), "INT"),
        "displacement_l": number(d.extract(x, r"(\d+\.?\d*)\s*[Ll]"), "DOUBLE"),
        "is_turbo": f"COALESCE({x} LIKE '%T/C%' OR {x} LIKE '%TURBO%', FALSE)",
        "is_hybrid": hybrid,
        "engine_type": f"CASE WHEN {x} IS NULL THEN NULL WHEN {hybrid} THEN 'Hybrid' WHEN {x} LIKE '%GAS%' THEN 'Gasoline' WHEN {x} LIKE '%DSL%' THEN 'Diesel' ELSE 'Gasoline' END",
    }


def items(columns: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


@op("c3_parse_engine", "vehicle_master")
def parse_engine(d):
    """Cylinders, displacement, turbo, hybrid and fuel from the engine text."""
    return f"SELECT vehid, engine_configuration, {items(engine_columns(d, 'engine_configuration'))} FROM (SELECT vehid, NULLIF(engine_configuration, '{SENTINEL}') AS engine_configuration FROM vehicle_master) AS v"


@op("c4_power_index", "vehicle_master")
def power_index(d):
    """Displacement by cylinders, half as much again with a turbo, row by row."""
    return f"SELECT vehid, displacement_l * engine_cylinders * CASE WHEN is_turbo THEN 1.5 ELSE 1.0 END AS power_index FROM ({parse_engine.build(d)}) AS e"


@op("c5_parse_transmission", "vehicle_master")
def parse_transmission(d):
    """Kind of transmission and number of speeds."""
    t = "UPPER(transmission)"
    kind = f"CASE WHEN transmission IS NULL THEN 'Unknown' WHEN {t} LIKE '%MANUAL%' THEN 'Manual' WHEN {t} LIKE '%AUTOMATIC%' AND {t} LIKE '%CVT%' THEN 'CVT' WHEN {t} LIKE '%AUTOMATIC%' AND {t} LIKE '%ECT%' THEN 'Automatic (ECT)' WHEN {t} LIKE '%AUTOMATIC%' THEN 'Automatic' WHEN {t} LIKE '%CVT%' THEN 'CVT' ELSE 'Other' END"
    speeds = d.extract("transmission", r"(\d+)[-\s]*SP")
    return f"SELECT vehid, transmission, {kind} AS transmission_type, CAST(NULLIF({speeds}, '') AS INT) AS transmission_speeds FROM (SELECT vehid, NULLIF(transmission, '{SENTINEL}') AS transmission FROM vehicle_master) AS v"


@op("c6_impute_weight", "vehicle_master")
def impute_weight(d):
    """A missing weight becomes the median of its vehicle type."""
    return "SELECT v.vehid, v.vehicle_type, COALESCE(CAST(v.generalized_weight AS DOUBLE), m.middle) AS generalized_weight FROM vehicle_master v LEFT JOIN (SELECT vehicle_type, " + d.pct("generalized_weight", 0.5) + " AS middle FROM vehicle_master GROUP BY vehicle_type) AS m ON v.vehicle_type = m.vehicle_type"


@op("c7_weight_category", "vehicle_master")
def weight_category(d):
    """Right-closed weight bands, the lowest edge included."""
    return f"SELECT vehid, generalized_weight, {cut('generalized_weight', *WEIGHT_EDGES)} AS weight_category FROM ({impute_weight.build(d)}) AS w"


@op("c8_efficiency_category", "vehicle_master")
def efficiency_category(d):
    """Weight by displacement, and its band."""
    return f"""SELECT vehid, {d.r6('score')} AS efficiency_score, {cut('score', *EFFICIENCY_EDGES, lowest=False)} AS efficiency_category
FROM (SELECT w.vehid, w.generalized_weight / (e.displacement_l + CAST(1 AS DOUBLE) / 10) AS score FROM ({impute_weight.build(d)}) AS w JOIN ({parse_engine.build(d)}) AS e ON w.vehid = e.vehid) AS s"""


@op("c9_dedup_vehicles", "vehicle_master")
def dedup_vehicles(d):
    """The first row of each vehicle, in an order that is total."""
    twice = "SELECT *, 1 AS source_row FROM vehicle_master UNION ALL SELECT *, 2 AS source_row FROM vehicle_master"
    return f"SELECT vehid, vehicle_type, vehicle_class, source_row FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehid ORDER BY source_row, vehicle_type, vehicle_class) AS nth FROM ({twice}) AS u) AS r WHERE nth = 1"


def violations(rules: dict[str, tuple]) -> str:
    return " OR ".join(f"COALESCE({c} < {low} OR {c} > {high}, FALSE)" for c, (low, high) in rules.items())


def count_rules(d, source: str, rules: dict[str, tuple]) -> str:
    one = [f"SELECT '{c}' AS rule, COUNT(*) AS checked, {n_if(f'{c} < {low} OR {c} > {high}')} AS violations, {n_if(f'{c} IS NULL')} AS missing FROM {source}" for c, (low, high) in rules.items()]
    return " UNION ALL ".join(one)


@op("c10_validate_readings", "readings")
def validate_readings(d):
    """How many readings break each range rule."""
    return count_rules(d, "readings", READING_RULES)


@op("c10_validate_vehicles", "vehicles")
def validate_vehicles(d):
    """How many vehicles break each range rule."""
    return count_rules(d, "vehicles", VEHICLE_RULES)


@op("c10_flag_rows", "readings")
def flag_rows(d):
    """Each reading, and whether it keeps all range rules."""
    return f"SELECT event_id, vehicle_id, ts, NOT ({violations(READING_RULES)}) AS is_valid FROM readings"


@op("c11_clean_timestamps", "events")
def clean_timestamps(d):
    """Timestamps from texts; a text that is none becomes null."""
    text = "CASE WHEN event_id % 10 = 3 THEN 'invalid' ELSE CONCAT('2024-01-', CASE WHEN event_id % 40 < 9 THEN '0' ELSE '' END, CAST(event_id % 40 + 1 AS STRING), ' 10:00:00') END"
    return f"SELECT event_id, text AS raw, {d.try_ts('text')} AS ts FROM (SELECT event_id, {text} AS text FROM events) AS e"


GAPPED = "SELECT event_id, vehicle_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE speed_kmh END AS speed_kmh FROM readings"


@op("c12_interpolate", "readings")
def interpolate(d):
    """Missing speeds by linear interpolation over time between a vehicle's readings; outer gaps stay null."""
    last = "OVER (PARTITION BY vehicle_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    following = "OVER (PARTITION BY vehicle_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = "CASE WHEN speed_kmh IS NOT NULL THEN ts END"
    return f"""SELECT event_id, vehicle_id, ts, speed_kmh AS raw_speed, {d.r6(f'CASE WHEN speed_kmh IS NOT NULL THEN speed_kmh WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * {d.div(d.seconds("t0", "ts"), d.seconds("t0", "t1"))} END')} AS speed_kmh
FROM (SELECT *, {d.last('speed_kmh', last)} AS v0, {d.first('speed_kmh', following)} AS v1, {d.last(at, last)} AS t0, {d.first(at, following)} AS t1 FROM ({GAPPED}) AS g) AS w"""


@op("c12_fill_mean", "readings", measured=GAPPED)
def fill_mean(d):
    """Missing speeds as the vehicle's mean and as the median of all, and the last known one carried forward."""
    return f"""SELECT event_id, {d.r6('COALESCE(speed_kmh, AVG(speed_kmh) OVER (PARTITION BY vehicle_id))')} AS by_mean, {d.r6('COALESCE(speed_kmh, middle)')} AS by_median, {d.last('speed_kmh', 'OVER (PARTITION BY vehicle_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS carried
FROM ({GAPPED}) AS g CROSS JOIN (SELECT {d.pct('speed_kmh', 0.5)} AS middle FROM ({GAPPED}) AS g2) AS m"""


@op("c12_drop_missing", "readings")
def drop_missing(d):
    """Readings without a missing speed."""
    return f"SELECT * FROM ({GAPPED}) AS g WHERE speed_kmh IS NOT NULL"


@op("c13_remove_outliers", "readings", measured="SELECT * FROM readings")
def remove_outliers(d):
    """Readings whose speed is within 1.5 quartile ranges, and which break no rule."""
    return f"""SELECT event_id, vehicle_id, speed_kmh FROM readings CROSS JOIN (SELECT {d.pct('speed_kmh', 0.25)} AS q1, {d.pct('speed_kmh', 0.75)} AS q3 FROM readings) AS q WHERE speed_kmh BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AND NOT ({violations(READING_RULES)})"""


@op("c13_clip_bounds", "readings")
def clip_bounds(d):
    """Values drawn to the bounds of their rule."""
    clip = lambda c: f"LEAST(GREATEST({c}, CAST({READING_RULES[c][0]} AS DOUBLE)), CAST({READING_RULES[c][1]} AS DOUBLE))"
    return f"SELECT event_id, {clip('speed_kmh')} AS speed_kmh, {clip('engine_temperature_c')} AS engine_temperature_c, {clip('fuel_level_percent')} AS fuel_level_percent FROM readings"


@op("c14_dedup_readings", "readings")
def dedup_readings(d):
    """One reading for each vehicle and second: the one with the smallest id."""
    return "SELECT event_id, vehicle_id, second_of, speed_kmh FROM (SELECT *, date_trunc('second', ts) AS second_of, ROW_NUMBER() OVER (PARTITION BY vehicle_id, date_trunc('second', ts) ORDER BY event_id) AS nth FROM readings) AS r WHERE nth = 1"


@op("c15_clean_all", "readings")
def clean_all(d):
    """Valid, deduplicated readings with speeds clipped to their bounds."""
    return f"SELECT event_id, vehicle_id, ts, LEAST(speed_kmh, CAST(180 AS DOUBLE)) AS speed_kmh, engine_temperature_c, fuel_level_percent FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id, ts ORDER BY event_id) AS nth FROM readings WHERE NOT ({violations({k: v for k, v in READING_RULES.items() if k != 'speed_kmh'})})) AS r WHERE nth = 1"


@op("c15_cleaning_report", "readings")
def cleaning_report(d):
    """One row: readings before and after cleaning, and why the others went."""
    rules = {k: v for k, v in READING_RULES.items() if k != "speed_kmh"}
    return f"SELECT COUNT(*) AS original_rows, {n_if('bad')} AS removed_invalid, {n_if('NOT bad AND nth > 1')} AS removed_duplicates, {n_if('NOT bad AND nth = 1')} AS cleaned_rows FROM (SELECT bad, ROW_NUMBER() OVER (PARTITION BY vehicle_id, ts, bad ORDER BY event_id) AS nth FROM (SELECT *, {violations(rules)} AS bad FROM readings) AS f) AS r"
