"""Oracle SQL that is stated by itself from the rules, and shares no text with the operator that it checks."""

from __future__ import annotations

from ..sources.views import oracle_ctes
from .stated_windows import WINDOWS

CODES = """codes AS (SELECT l_orderkey, l_linenumber, l_partkey, vehid, fault_codes, unnest(string_split(fault_codes, ',')) AS code, generate_subscripts(string_split(fault_codes, ','), 1) AS place FROM telemetry WHERE fault_codes IS NOT NULL),
graded AS (SELECT *, CASE code WHEN 'P0300' THEN 3 WHEN 'P0301' THEN 3 WHEN 'P0302' THEN 3 WHEN 'P0303' THEN 3 WHEN 'P0304' THEN 3 WHEN 'P0420' THEN 2 WHEN 'P0171' THEN 2 WHEN 'P0172' THEN 2 WHEN 'P0442' THEN 2 ELSE 1 END AS grade FROM codes)"""
NAME = "CASE {0} WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'WARNING' WHEN 1 THEN 'INFO' ELSE 'NONE' END"
SIX = "ROUND(CAST({0} AS DOUBLE) + 1.3e-9, 6)"


def six(x: str) -> str:
    return SIX.format(x)


#: key: the views that it needs, and the statement behind them.
STATED: dict[str, tuple[list[str], str]] = {
    "u1_fault_severity": (["telemetry"], f"""{CODES},
firsts AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, vehid, fault_codes, arg_min(grade, place) FILTER (WHERE grade > 1) AS first_grade, MAX(grade) AS worst_grade FROM graded GROUP BY ALL)
SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.vehid, t.ts, t.fault_codes, {NAME.format("CASE WHEN f.worst_grade IS NULL THEN 0 ELSE coalesce(f.first_grade, 1) END")} AS first_match, {NAME.format("coalesce(f.worst_grade, 0)")} AS worst
FROM telemetry t LEFT JOIN (SELECT fault_codes, ANY_VALUE(first_grade) AS first_grade, ANY_VALUE(worst_grade) AS worst_grade FROM firsts GROUP BY fault_codes) AS f ON t.fault_codes = f.fault_codes"""),
    "u2_maintenance_urgency": (["telemetry"], f"""days AS (SELECT vehid, CAST(ts AS DATE) AS usage_date, SUM(CAST(has_fault AS INT)) AS faults, AVG(fuel_efficiency_kmpl) AS eff, {six("AVG(idle_time_min)")} AS idle_minutes FROM telemetry GROUP BY 1, 2),
means AS (SELECT vehid, AVG(fuel_efficiency_kmpl) AS usual FROM telemetry GROUP BY vehid),
losses AS (SELECT days.vehid, usage_date, CAST(faults AS BIGINT) AS faults, {six("100 * (usual - eff) / usual")} AS efficiency_degradation, idle_minutes FROM days JOIN means ON days.vehid = means.vehid),
scored AS (SELECT *, 10 * faults + CASE WHEN efficiency_degradation > 10 THEN 2 * (efficiency_degradation - 10) ELSE 0 END + CASE WHEN idle_minutes > 10 THEN (idle_minutes - 10) / 2 ELSE 0 END AS points FROM losses)
SELECT vehid, usage_date, faults, efficiency_degradation, idle_minutes, CASE WHEN score > 30 THEN 'IMMEDIATE' WHEN score > 15 THEN 'HIGH' WHEN score > 5 THEN 'MEDIUM' ELSE 'LOW' END AS urgency FROM (SELECT *, ROUND(points + 1.3e-9, 6) AS score FROM scored) AS s"""),
    "p1_daily_usage_by_class": (["telemetry"], """trips AS (SELECT * FROM telemetry WHERE l_partkey % 97 <> 0)
SELECT date_trunc('day', ts)::DATE AS usage_date, vehicle_type, vehicle_class, COUNT(DISTINCT vehid) AS active_vehicles, COUNT(vehid) AS total_trips, ROUND(SUM(trip_distance_km)::DOUBLE + 1.3e-7, 4) AS total_distance_km, ROUND(SUM(trip_distance_km)::DOUBLE / COUNT(*) + 1.3e-9, 6) AS avg_trip_distance, ROUND(SUM(trip_duration_min)::DOUBLE + 1.3e-7, 4) AS total_minutes FROM trips GROUP BY ALL"""),
    "p2_efficiency_by_configuration": (["vehicles", "telemetry"], f"""trips AS (SELECT * FROM telemetry WHERE l_partkey % 97 <> 0 AND fuel_efficiency_kmpl > 0)
SELECT v.vehicle_type, v.vehicle_class, v.engine_type, v.is_turbo, v.weight_category, COUNT(*) AS trip_count, {six("AVG(e)")} AS avg_efficiency, {six("MEDIAN(e)")} AS median_efficiency, {six("MIN(e)")} AS min_efficiency, {six("MAX(e)")} AS max_efficiency, {six("STDDEV(e)")} AS efficiency_stddev
FROM vehicles v, (SELECT vehid, fuel_efficiency_kmpl AS e FROM trips) AS t WHERE v.vehid = t.vehid GROUP BY ALL"""),
    "a3_engine_efficiency": (["vehicles", "telemetry"], f"""SELECT engine_type, is_turbo, weight_category, {six("SUM(e) / COUNT(*)")} AS mean, {six("sqrt(CASE WHEN COUNT(*) > 1 THEN VAR_SAMP(e) END)")} AS std, COUNT(*) AS trips FROM (SELECT vehid, fuel_efficiency_kmpl AS e FROM telemetry) AS t JOIN vehicles USING (vehid) GROUP BY 1, 2, 3"""),
    "a6_correlation_matrix": (["telemetry"], ""),
}


def correlations() -> str:
    """Each pair by the engine's own correlation."""
    from itertools import combinations

    from ..operators.analysis import NUMERIC

    one = "SELECT '{0}' AS column_a, '{1}' AS column_b, CASE WHEN MIN({0}) < MAX({0}) AND MIN({1}) < MAX({1}) THEN " + six("corr({0}, {1})") + " END AS r FROM telemetry"
    return " UNION ALL ".join(one.format(a, b) for a, b in combinations(NUMERIC, 2))


def oracle_sql() -> dict[str, str]:
    texts = {k: (views, text or correlations()) for k, (views, text) in (STATED | WINDOWS).items()}
    return {k: f"WITH {oracle_ctes(views)}{' ' if text.startswith('SELECT') else ', '}{text}" for k, (views, text) in texts.items()}
