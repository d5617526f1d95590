"""Model operators over the test tables. Where results depend on random draws there is no oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.views import fleet_views, oracle_ctes
from . import chunks, enrichment, features, models

R = models.READING_FEATURES
#: Rows of a chunk in the registered queries, so that vehicles have several in the test tables of trips.
CHUNK = 1 << 9
#: Trees and depth of the registered queries; the operator has 100 and 10.
FOREST = (20, 8)


def readings(spark, sf_dir):
    return fleet_views(spark, sf_dir, ("readings",))["readings"]


def maintenance(spark, sf_dir):
    v = fleet_views(spark, sf_dir, ("telemetry", "vehicles"))
    return models.maintenance_frame(**v), v["vehicles"]


def predicted(spark, sf_dir):
    frame, vehicles = maintenance(spark, sf_dir)
    model, _, _ = models.train_maintenance_model(frame, *FOREST)
    return models.predict_maintenance(model, frame, vehicles)


def encoded(spark, sf_dir):
    """Encoded columns in long form, so that the columns do not depend on the data."""
    wide = features.encode_categoricals(readings(spark, sf_dir), ["event_type", "driver_id", "vehicle_id"], "event_id")
    return wide.unpivot(["event_id"], wide.columns[1:], "feature", "value").withColumn("value", F.round(F.col("value") + 1.3e-9, 6))


def anomaly_profile(spark, sf_dir):
    r = readings(spark, sf_dir)
    return models.anomaly_profile(models.isolation_forest(r, R, "event_id"), r)


# Columns that tell anomalous trips.
TRIP_FEATURES = ["fuel_efficiency_kmpl", "avg_speed_kmph", "avg_rpm", "idle_time_min", "driver_behavior_score"]


def trip_anomalies(spark, sf_dir, column, most=None):
    trips = fleet_views(spark, sf_dir, ("telemetry",))["telemetry"].withColumn("trip", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    scores = models.isolation_forest(trips, TRIP_FEATURES, "trip", trees=50, keep=[column])
    return models.anomalies_by(scores, None, "trip", column, most)


def clustered(spark, sf_dir):
    """Four clusters of the readings."""
    r = readings(spark, sf_dir)
    return r, models.cluster_rows(r, R, "event_id", 4)


def queries() -> dict:
    return {
        "a5_isolation_forest": lambda s, d: models.isolation_forest(readings(s, d), R, "event_id"),
        "a5_anomaly_profile": anomaly_profile,
        "a5_anomalies_by_type": lambda s, d: trip_anomalies(s, d, "vehicle_type"),
        "a5_top_vehicles": lambda s, d: trip_anomalies(s, d, "vehid", 10),
        "e14_rolling_chunked": lambda s, d: chunks.rolling_efficiency(fleet_views(s, d, ("telemetry",))["telemetry"], CHUNK),
        "n8_rolling_chunked": lambda s, d: chunks.rolling_features(readings(s, d), chunk=CHUNK),
        "n9_lag_chunked": lambda s, d: chunks.lag_features(readings(s, d), chunk=CHUNK),
        "w11_zscore_chunked": lambda s, d: chunks.rolling_zscore(readings(s, d), chunk=CHUNK),
        "w15_sessionize_chunked": lambda s, d: chunks.sessionize(readings(s, d), chunk=CHUNK),
        "m2_maintenance_model": lambda s, d: models.train_maintenance_model(maintenance(s, d)[0], *FOREST)[1],
        "m2_importances": lambda s, d: models.train_maintenance_model(maintenance(s, d)[0], *FOREST)[2],
        "m3_predict_maintenance": predicted,
        "w17_kmeans_anomaly": lambda s, d: models.kmeans_anomaly(readings(s, d), R, "event_id"),
        "w27_maintenance_regression": lambda s, d: models.maintenance_regression(models.vehicle_periods(fleet_views(s, d, ("telemetry",))["telemetry"])),
        "n12_encode_categoricals": encoded,
        "n14_select_features": lambda s, d: models.select_features(maintenance(s, d)[0], models.FEATURES, "label", 5),
        "n14_backward_elimination": lambda s, d: models.eliminate_features(maintenance(s, d)[0], models.FEATURES, "label", 5),
        "n15_pca": lambda s, d: models.pca(readings(s, d), R, len(R)),
        "n15_svd": lambda s, d: models.svd(readings(s, d), R),
        "n17_cluster_features": lambda s, d: models.cluster_features(readings(s, d), R, most=5),
        "n17_cluster_rows": lambda s, d: clustered(s, d)[1],
        "n17_cluster_means": lambda s, d: models.cluster_means(*clustered(s, d), R, "event_id"),
        "n18_feature_pipeline": lambda s, d: models.FeaturePipeline(R, times=("ts",), categories=("event_type",)).fit(readings(s, d)).transform(readings(s, d), "event_id"),
        "n20_compare_models": lambda s, d: models.compare_models(maintenance(s, d)[0], models.FEATURES),
        "n22_consensus_anomaly": lambda s, d: models.consensus_anomaly(readings(s, d), R, "event_id"),
    }


def oracle_sql() -> dict[str, str]:
    frequency = lambda c: f"CAST(COUNT(*) OVER (PARTITION BY {c}) AS DOUBLE) / COUNT(*) OVER ()"
    coded = lambda c: f"SELECT event_id, CASE WHEN n_{c} > 50 THEN '{c}_label' ELSE '{c}_frequency' END AS feature, CASE WHEN n_{c} > 50 THEN DENSE_RANK() OVER (ORDER BY {c}) - 1 ELSE {frequency(c)} END AS value FROM readings, sizes"
    twins = {"e14_rolling_chunked": enrichment.rolling_efficiency, "n8_rolling_chunked": features.rolling_features, "n9_lag_chunked": features.lag_features, "w11_zscore_chunked": features.rolling_zscore, "w15_sessionize_chunked": features.sessionize}
    return {key: op.oracle(oracle_ctes(op.inputs)) for key, op in twins.items()} | {
        "n12_encode_categoricals": f"""WITH {oracle_ctes(["readings"])},
sizes AS (SELECT COUNT(DISTINCT driver_id) AS n_driver_id, COUNT(DISTINCT vehicle_id) AS n_vehicle_id FROM readings),
all_rows AS (SELECT event_id, 'event_type_' || k AS feature, CASE WHEN event_type = k THEN 1.0::DOUBLE ELSE 0 END AS value FROM readings, (SELECT DISTINCT event_type AS k FROM readings) AS kinds UNION ALL {coded("driver_id")} UNION ALL {coded("vehicle_id")})
SELECT event_id, feature, ROUND(value + 1.3e-9, 6) AS value FROM all_rows""",
    }
