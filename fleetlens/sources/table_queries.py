"""Table operators over the test tables: profile, upsert, retention, refresh, each read back."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..folders import new_path
from ..plans import packaged
from ..plans.dialect import AS_OF
from . import tables
from .marts import Marts
from .views import fleet_views, oracle_ctes


def folder(spark) -> str:
    return new_path(spark, "tables")


def upserted(spark, sf_dir):
    """The daily table, kept by month, after all months, and then 2001's again, went in."""
    path = folder(spark)
    daily = packaged.daily_aggregation(**fleet_views(spark, sf_dir, ("telemetry",))).withColumn("month", F.date_format("aggregation_date", "yyyy-MM"))
    tables.upsert_daily(daily, path, "month")
    tables.upsert_daily(daily.filter("aggregation_date >= DATE '2001-01-01'"), path, "month")
    return spark.read.parquet(path).select("aggregation_date", "vehid", "total_distance_km", "fault_count")


def retained(spark, sf_dir):
    """Readings of the last 14 days, after older ones were deleted."""
    path = folder(spark)
    tables.insert_rows(fleet_views(spark, sf_dir, ("readings",))["readings"].select("event_id", "vehicle_id", "ts"), f"{path}/all")
    return tables.delete_older(spark, f"{path}/all", f"{path}/kept", "ts", "2024-01-31", 14)


def updated(spark, sf_dir):
    """Alerts after all open ones below critical were acknowledged."""
    path = folder(spark)
    tables.insert_rows(fleet_views(spark, sf_dir, ("alerts",))["alerts"], f"{path}/all")
    out = tables.update_status(spark, f"{path}/all", f"{path}/new", (F.col("status") == "ACTIVE") & (F.col("severity") != "CRITICAL"), "ACKNOWLEDGED")
    return out.groupBy("severity", "status").agg(F.count(F.lit(1)).alias("alerts"), F.count("updated_at").alias("changed"))


def profile(spark, sf_dir):
    return tables.table_profile(fleet_views(spark, sf_dir, ("vehicles", "telemetry", "maintenance_history", "alerts", "readings"))).select("table_name", "column_name", "row_count")


def refreshed(spark, sf_dir):
    path = folder(spark)
    v = fleet_views(spark, sf_dir, ("vehicles", "telemetry"))
    tables.refresh({"v1": packaged.vehicle_performance(**v), "v2": packaged.fleet_efficiency_daily(telemetry=v["telemetry"])}, path)
    return spark.read.parquet(f"{path}/v2")


#: The day after the last trip.
LAST = date.fromisoformat(AS_OF)


def marted_vehicles(spark, sf_dir):
    return fleet_views(spark, sf_dir, ("vehicles",))["vehicles"]


def marted(spark, sf_dir):
    """Marts of all trips before the last week, then updated by the days of that week."""
    trips = fleet_views(spark, sf_dir, ("telemetry",))["telemetry"]
    marts = Marts(spark, new_path(spark, "marts"))
    days = [LAST - timedelta(days=k) for k in range(1, 121)]
    marts.update(trips, days[7:])
    marts.update(trips, days[:7])
    return trips, marts


def queries() -> dict:
    return {"v1_from_states": lambda s, d: marted(s, d)[1].vehicle_performance(marted_vehicles(s, d), LAST), "v2_from_states": lambda s, d: marted(s, d)[1].fleet_efficiency_daily(LAST), "f1_upsert_daily": upserted, "k2_retention": retained, "k2_update_status": updated, "k3_table_profile": profile, "v4_refresh": refreshed}


def oracle_sql() -> dict[str, str]:
    from ..plans.dialect import ORACLE

    daily = packaged.daily_aggregation.build(ORACLE)
    return {
        "f1_upsert_daily": f"WITH {oracle_ctes(['telemetry'])} SELECT aggregation_date, vehid, total_distance_km, fault_count FROM ({daily}) AS d",
        "k2_retention": f"WITH {oracle_ctes(['readings'])} SELECT event_id, vehicle_id, ts FROM readings WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL '14' DAY",
        "k2_update_status": f"WITH {oracle_ctes(['alerts'])} SELECT severity, CASE WHEN status = 'ACTIVE' AND severity <> 'CRITICAL' THEN 'ACKNOWLEDGED' ELSE status END AS status, COUNT(*) AS alerts, COUNT(CASE WHEN status = 'ACTIVE' AND severity <> 'CRITICAL' THEN 1 END) AS changed FROM alerts GROUP BY 1, 2",
        "k3_table_profile": f"WITH {oracle_ctes(['vehicles', 'telemetry', 'maintenance_history', 'alerts', 'readings'])} " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, unnest(json_keys(to_json(x))) AS column_name, (SELECT COUNT(*) FROM {t}) AS row_count FROM (SELECT * FROM {t} LIMIT 1) AS x" for t in ("vehicles", "telemetry", "maintenance_history", "alerts", "readings")),
        "v1_from_states": packaged.vehicle_performance.oracle(oracle_ctes(["vehicles", "telemetry"])),
        "v2_from_states": packaged.fleet_efficiency_daily.oracle(oracle_ctes(["telemetry"])),
        "v4_refresh": packaged.fleet_efficiency_daily.oracle(oracle_ctes(["telemetry"])),
    }
