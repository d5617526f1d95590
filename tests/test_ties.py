"""Limits that exact arithmetic meets, where sums of doubles fall either way."""

import itertools
from datetime import date, datetime

from fleetlens.operators import analysis
from fleetlens.plans import analytics
from fleetlens.plans.dialect import ORACLE


def test_a_deviation_of_the_limit_is_never_above_it(spark):
    """Trips whose efficiencies deviate by exactly 3, in every order: whichever way they are added, the vehicle is not urgent."""
    exact = [c for n in (3, 4) for c in itertools.product(range(6, 22), repeat=n) if n * sum(x * x for x in c) - sum(c) ** 2 == 9 * n * (n - 1)]
    efficiency = {x: 4 + min(x - 4, 10) / 100 * 100 + max(x - 14, 0) / 100 * 100 for x in range(6, 22)}  # as the view makes them of discount and tax
    rows = [(v, "ICE", "SUV", False, False, 100.0, efficiency[x], 1.0, datetime(2001, 11, 1)) for v, c in enumerate(exact) for x in c]
    trips = spark.createDataFrame(rows, "vehid int, vehicle_type string, vehicle_class string, has_fault boolean, maintenance_flag boolean, avg_engine_temp_c double, fuel_efficiency_kmpl double, idle_time_min double, ts timestamp_ntz").coalesce(1)
    history = spark.createDataFrame([(1, date(2000, 1, 1), 5.0)], "vehid int, maintenance_date date, cost double")
    got = analytics.maintenance_indicators(telemetry=trips, maintenance_history=history).collect()
    assert len(got) == len(exact) > 100
    assert {(r["efficiency_stddev"], r["maintenance_urgency"], r["urgency_rank"]) for r in got} == {(3.0, "LOW", 0)}


def test_the_sql_of_maintenance_indicators_is_as_it_was():
    assert "OR sd > 3 THEN 'MEDIUM'" in analytics.maintenance_indicators.build(ORACLE)


def test_a_mean_score_of_the_limit_is_never_below_it(spark):
    """Scores with a mean of exactly 0.8, in many orders: whichever way they are added, the vehicle gets no course; a mean just below 0.8 does."""
    scores, rows = [100, 60, 93, 67, 81, 79, 88, 72], []
    for v, order in enumerate(itertools.islice(itertools.permutations(scores), 0, 40320, 200)):
        rows += [(v, x / 100) for x in order]
    low = len(rows) // len(scores)
    rows += [(low, x / 100) for x in scores * 20000 if x != 81] + [(low, 0.81)] * 19999 + [(low, 0.8)]
    trips = spark.createDataFrame(rows, "vehid int, driver_behavior_score double").coalesce(1)
    trips = trips.selectExpr("*", "1D AS trip_distance_km", "0 AS harsh_acceleration_count", "0 AS harsh_braking_count", "0 AS speeding_count", "8D AS fuel_efficiency_kmpl", "1D AS fuel_consumed_l", "1D AS idle_time_min", "5D AS trip_duration_min")
    got = {r["vehid"]: r for r in analysis.driver_rollup(telemetry=trips).collect()}
    advice = [got[v]["recommendations"] for v in range(low)]
    assert {got[v]["avg_driver_score"] for v in got} == {0.8} and set(advice) == {"No specific recommendations"}
    assert got[low]["recommendations"] == "Consider defensive driving course"


def test_the_sql_of_driver_rollup_is_as_it_was():
    assert "CASE WHEN score < 0.8 THEN 'Consider defensive driving course' END" in analysis.driver_rollup.build(ORACLE)
