"""Column functions of the fleet rules, and their registration as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..rules import CO2_KG_PER_LITRE, CRITICAL_FAULTS, URGENCY_LEVELS, URGENCY_LOWEST, URGENCY_POINTS, WARNING_FAULTS


def fault_severity(codes: Column, worst: bool = False) -> Column:
    """Severity of a list of fault codes: that of its first critical or warning code, or the worst of all."""
    critical, warning = F.array(*map(F.lit, CRITICAL_FAULTS)), F.array(*map(F.lit, WARNING_FAULTS))
    known = F.filter(codes, lambda c: F.array_contains(critical, c) | F.array_contains(warning, c))
    hit = F.arrays_overlap(codes, critical) if worst else F.array_contains(critical, F.try_element_at(known, F.lit(1)))
    return F.when(codes.isNull() | (F.size(codes) == 0), "NONE").when(hit, "CRITICAL").when(F.size(known) > 0, "WARNING").otherwise("INFO")


def maintenance_urgency(faults: Column, loss: Column, idle: Column) -> Column:
    """Urgency from faults, percent of lost efficiency and minutes of idling: points for each, then the first level that they pass."""
    above = lambda x, part: F.greatest(F.lit(0.0), x - URGENCY_POINTS[part][0]) * URGENCY_POINTS[part][1]
    points = F.greatest(F.lit(0), faults) * URGENCY_POINTS["fault"] + above(loss, "loss") + above(idle, "idle")
    out = F.lit(URGENCY_LOWEST)
    for least, name in reversed(URGENCY_LEVELS):
        out = F.when(points > least, name).otherwise(out)
    return out


def co2_kg(litres: Column, engine: Column) -> Column:
    factor = F.create_map(*(F.lit(x) for kv in CO2_KG_PER_LITRE.items() for x in kv))
    return litres * F.coalesce(F.try_element_at(factor, engine), F.lit(2.31))


def fuel_efficiency(km: Column, litres: Column, unit: str = "kmpl") -> Column:
    """Efficiency as kmpl, l_per_100km or mpg; null where there is nothing to divide by."""
    if unit == "l_per_100km":
        return F.try_divide(litres, km) * 100
    return F.try_divide(km, litres) * {"kmpl": 1.0, "mpg": 2.352145833}[unit]


def detect_anomaly(value: Column, history: Column, limit: float = 3.0, least: int = 10) -> Column:
    """struct(is_anomaly, z_score, severity) of a value against a list of earlier values."""
    n = F.size(history).cast("double")
    mean = F.try_divide(F.aggregate(history, F.lit(0.0), lambda a, x: a + x), n)
    away = F.aggregate(F.transform(history, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)  # a second pass keeps the digits of large values
    std = F.sqrt(F.try_divide(away, n))
    z = F.when(n >= least, F.try_divide(F.abs(value - mean), F.nullif(std, F.lit(0.0))))
    severity = F.when(z > 5, "critical").when(z > 4, "high").when(z > limit, "medium").otherwise("none")
    return F.struct(F.coalesce(z > limit, F.lit(False)).alias("is_anomaly"), z.alias("z_score"), severity.alias("severity"))


def register(spark: SparkSession) -> None:
    """co2_kg(litres, engine) and guarded_div(a, b) as temporary SQL functions."""
    cases = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in CO2_KG_PER_LITRE.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION co2_kg(litres DOUBLE, engine STRING) RETURNS DOUBLE RETURN litres * CASE engine {cases} ELSE 2.31D END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION guarded_div(a DOUBLE, b DOUBLE) RETURNS DOUBLE RETURN CASE WHEN b = 0 THEN CASE WHEN a = 0 THEN NULL ELSE 0D END ELSE a / b END")
