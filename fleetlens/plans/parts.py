"""SQL fragments that several plans share."""

from __future__ import annotations

from ..rules import CO2_KG_PER_LITRE, DEFAULT_BENCHMARK, FUEL_PRICE, IDLE_LITRES_PER_HOUR
from .dialect import Dialect

IDLE_COST = f"/ 60 * {IDLE_LITRES_PER_HOUR} * {FUEL_PRICE}"


def n_if(condition: str) -> str:
    return f"COUNT(CASE WHEN {condition} THEN 1 END)"


def lookup(x: str, table: dict, other: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in table.items())
    return f"CASE {x} {whens} ELSE {other} END"


def lookup2(x: str, y: str, table: dict[str, dict[str, float]], other: str) -> str:
    whens = " ".join(f"WHEN {x} = '{a}' AND {y} = '{b}' THEN CAST({v} AS DOUBLE)" for a, row in table.items() for b, v in row.items())
    return f"CASE {whens} ELSE {other} END"


def co2(engine: str, other: str = "CAST(0 AS DOUBLE)") -> str:
    return lookup(engine, CO2_KG_PER_LITRE, other)


def steps(x: str, limits: list[tuple[str, int]], other: int = 0) -> str:
    """Points: those of the first limit that x passes."""
    return "CASE " + " ".join(f"WHEN {x} {c} THEN {p}" for c, p in limits) + f" ELSE {other} END"


def spent(d: Dialect, days: int, as_of: str) -> str:
    """Maintenance of each vehicle before its trips are joined, so that trips do not repeat it."""
    return f"SELECT vehid, SUM(cost) AS cost, COUNT(*) AS events FROM maintenance_history WHERE maintenance_date >= CAST({d.ts(as_of)} - INTERVAL '{days}' DAY AS DATE) GROUP BY vehid"


def fitted_benchmark(d: Dialect) -> str:
    """vehid and the benchmark of its class, engine and displacement: the range that holds it (the lowest of several)."""
    return """SELECT v.vehid, MIN_BY(b.mixed_efficiency_kmpl, b.low_l) AS fitted FROM vehicles v JOIN efficiency_benchmarks b
    ON v.vehicle_class = b.vehicle_class AND v.engine_type = b.engine_type AND v.displacement_l BETWEEN b.low_l AND b.high_l GROUP BY v.vehid"""


def default_benchmark(vehicle_class: str, engine: str) -> str:
    return lookup2(vehicle_class, engine, DEFAULT_BENCHMARK, "CAST(12 AS DOUBLE)")
