"""Models on small frames with known answers."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from fleetlens.functions import columns
from fleetlens.operators import features, models


def test_svd_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 3)) + 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    scaled = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.svd(scaled, compute_uv=False)
    got = models.svd(df, ["a", "b", "c"]).orderBy("component").collect()
    assert np.allclose([r["singular_value"] for r in got], want) and np.isclose(sum(r["share"] for r in got), 1)


def test_regression_follows_the_count(spark):
    rows = [(k, dt.datetime(2024, 1, 1), float(100 + k), 1.0, 10.0, 1.0, k % 5, (k % 5) * 4, 0.5) for k in range(300)]
    df = spark.createDataFrame(rows, "vehid int, period timestamp_ntz, total_distance_km double, total_fuel_consumed_l double, avg_fuel_efficiency double, total_idle_min double, fault_count int, maintenance_count int, avg_driver_score double")
    out = models.maintenance_regression(df).collect()
    assert 20 < len(out) < 120 and np.corrcoef([r["predicted_maintenance_need"] for r in out], [r["maintenance_count"] for r in out])[0, 1] > 0.95
    assert all(abs(r["next_maintenance_km"] - r["total_distance_km"] * (1.2 if r["predicted_maintenance_need"] > 0.5 else 1.5)) < 1e-3 for r in out)


def test_isolation_forest_finds_the_far_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(rng.normal()), float(rng.normal())) for k in range(400)] + [(1000 + k, 40.0 + k, -40.0) for k in range(4)]
    out = {r["id"]: r for r in models.isolation_forest(spark.createDataFrame(rows, "id long, x double, y double"), ["x", "y"], "id", 0.02, 20).collect()}
    assert len(out) == 404 and all(out[1000 + k]["is_anomaly"] for k in range(4))


def test_severity_and_urgency(spark):
    codes = [(None,), ([],), (["U1"],), (["U1", "P0171", "P0300"],), (["P0301", "P0171"],), (["U1", "U2", "P0442"],)]
    df = spark.createDataFrame(codes, "codes array<string>")
    got = [tuple(r) for r in df.select(columns.fault_severity(F.col("codes")), columns.fault_severity(F.col("codes"), worst=True)).collect()]
    assert got == [("NONE", "NONE"), ("NONE", "NONE"), ("INFO", "INFO"), ("WARNING", "CRITICAL"), ("CRITICAL", "CRITICAL"), ("WARNING", "WARNING")]
    cases = [(4, 0.0, 0.0), (3, 0.0, 0.0), (0, 18.0, 0.0), (0, 0.0, 20.0), (0, 0.0, 21.0), (1, 12.0, 14.0)]
    df = spark.createDataFrame(cases, "f int, l double, i double")
    assert [r[0] for r in df.select(columns.maintenance_urgency(F.col("f"), F.col("l"), F.col("i"))).collect()] == ["IMMEDIATE", "HIGH", "HIGH", "LOW", "MEDIUM", "HIGH"]


def test_anomaly_of_large_values_keeps_its_digits(spark):
    df = spark.createDataFrame([(1e9 + 10.0, [1e9 + k % 2 for k in range(20)])], "v double, h array<double>")
    r = df.select(columns.detect_anomaly(F.col("v"), F.col("h")).alias("d")).first()["d"]
    assert abs(r["z_score"] - 19.0) < 1e-6 and r["severity"] == "critical"


def test_encodings_by_cardinality(spark):
    rows = [(k, "ab"[k % 2] if k % 7 else None, k % 30, f"v{k % 60:02d}") for k in range(120)]
    out = features.encode_categoricals(spark.createDataFrame(rows, "id int, few string, some int, many string"), ["few", "some", "many"], "id").collect()
    assert out[0].__fields__ == ["id", "few_a", "few_b", "some_frequency", "many_label"]
    for r in out:
        k = r["id"]
        assert (r["few_a"], r["few_b"]) == (float(k % 7 and k % 2 == 0 or 0) and 1.0, float(bool(k % 7 and k % 2)))
        assert abs(r["some_frequency"] - 4 / 120) < 1e-9 and r["many_label"] == k % 60


def test_valid_events_follow_their_parameters(spark):
    at = lambda s: dt.datetime(2024, 1, 31) - dt.timedelta(seconds=s)
    rows = [(1, 1, at(10), "view", 50.0, 80.0, 50.0, 900.0), (2, 1, at(3601), "view", 50.0, 80.0, 50.0, 900.0), (3, None, at(1), "view", 50.0, 80.0, 50.0, 900.0), (4, 1, at(1), "", 50.0, 80.0, 50.0, 900.0)]
    rows += [(5, 1, at(1), "view", 301.0, 80.0, 50.0, 900.0), (6, 1, at(1), "view", 50.0, -51.0, 50.0, 900.0), (7, 1, at(1), "view", 50.0, 80.0, 101.0, 900.0), (8, 1, at(1), "view", 50.0, 80.0, 50.0, 10001.0), (9, 1, None, "view", 50.0, 80.0, 50.0, 900.0)]
    df = spark.createDataFrame(rows, "event_id long, vehicle_id long, ts timestamp_ntz, event_type string, speed_kmh double, engine_temperature_c double, fuel_level_percent double, rpm double")
    got = {r["event_id"]: r["quarantine_reason"] for r in features.valid_events(readings=df).collect()}
    assert got == {1: None, 2: "too old", 3: "missing field", 4: "missing field", 5: "out of range", 6: "out of range", 7: "out of range", 8: "out of range", 9: "missing field"}
    loose = {r["event_id"] for r in features.valid_events(readings=df, max_age_s=4000, ranges={"rpm": (0, 99999)}).collect() if r["quarantine_reason"] is None}
    assert loose == {1, 2, 5, 6, 7, 8}


def test_forecast_by_vehicle_recovers_a_planted_series(spark):
    """Vehicle 1: 3 + day / 7 with two more on Sundays; vehicle 2: one reading in all."""
    start, rows = dt.datetime(2024, 1, 1), []
    for day in range(70):
        for k in range(3 + day // 7 + 2 * (day % 7 == 6)):
            rows.append((len(rows), 1, start + dt.timedelta(days=day, minutes=k)))
    rows.append((len(rows), 2, start))
    out = features.forecast_by_vehicle(readings=spark.createDataFrame(rows, "event_id long, vehicle_id long, ts timestamp_ntz")).collect()
    one = {r["day"]: r for r in out if r["vehicle_id"] == 1}
    assert len(one) == 5 and max(r["day"] for r in out) == dt.date(2024, 3, 10) and all(abs(r["actual"] - r["forecast"]) < 0.8 for r in one.values())
    assert abs(next(iter(one.values()))["mae"] - np.mean([abs(r["actual"] - r["forecast"]) for r in one.values()])) < 1e-3
    assert not [r for r in out if r["vehicle_id"] == 2 and r["forecast"] is not None]  # nothing to learn from


def planted(spark, n=600, seed=2):
    """A label that two of five columns decide; the others are noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    return spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, e double, label double")


def test_elimination_and_selection_drop_noise_first(spark):
    df = planted(spark)
    out = {r["feature"]: r for r in models.eliminate_features(df, list("abcde"), "label", 2).collect()}
    assert {f for f, r in out.items() if r["selected"]} == {"a", "b"} and sorted(r["round"] for r in out.values() if r["round"]) == [1, 2, 3] and sorted(r["place"] for r in out.values()) == [1, 2, 3, 4, 5]
    chosen = {r["feature"] for r in models.select_features(df, list("abcde"), "label", 2).collect() if r["selected"]}
    assert chosen == {"a", "b"}


def test_models_learn_a_planted_label(spark):
    figures = {r["model"]: r for r in models.compare_models(planted(spark), list("abcde")).collect()}
    assert set(figures) == {"random_forest", "boosted_trees", "logistic_regression", "ensemble"} and all(r["accuracy"] > 0.85 and r["f1"] > 0.85 for r in figures.values())


def test_clusters_distances_and_means(spark):
    rng = np.random.default_rng(5)
    at = np.array([(0, 0), (20, 0), (0, 20)])
    rows = [(k, *map(float, at[k % 3] + rng.normal(size=2))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    shape = {r["k"]: r for r in models.cluster_features(df, ["x", "y"], 5).collect()}
    assert set(shape) == {2, 3, 4, 5} and [k for k, r in shape.items() if r["is_best"]] == [3]
    out = models.cluster_rows(df, ["x", "y"], "id", 3)
    got = {r["id"]: r for r in out.collect()}
    assert all(len(r["distances"]) == 3 and np.argmin(r["distances"]) == r["cluster"] for r in got.values())
    assert all(len({got[k]["cluster"] for k in range(g, 300, 3)}) == 1 for g in range(3))
    means = {r["cluster"]: (r["rows"], r["mean_x"], r["mean_y"]) for r in models.cluster_means(df, out, ["x", "y"], "id").collect()}
    for g in range(3):
        n, x, y = means[got[g]["cluster"]]
        assert n == 100 and abs(x - np.mean([r[1] for r in rows[g::3]])) < 1e-5 and abs(y - np.mean([r[2] for r in rows[g::3]])) < 1e-5
    far = spark.createDataFrame([*rows, (999, 9.0, 9.0)], "id long, x double, y double")
    assert [r["id"] for r in models.kmeans_anomaly(far, ["x", "y"], "id").collect() if r["is_anomaly"]] == [999]


def test_numbers_of_clusters_are_tried_on_stored_columns(spark, monkeypatch):
    """Not on a cached frame, whose rows k-means would convert in every round."""
    seen, fit = [], models.KMeans.fit
    monkeypatch.setattr(models.KMeans, "fit", lambda self, df: (seen.append((df.storageLevel.useMemory, bool(df.inputFiles()))), fit(self, df))[1])
    assert models.cluster_features(planted(spark), list("abc"), 3).count() == 2 and seen == [(False, True)] * 2


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)) @ np.array([[3, 1, 0], [0, 1, 2], [0, 0, 0.2]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1] / 3
    got = models.pca(df, ["a", "b", "c"], 3).orderBy("component").collect()
    assert np.allclose([r["variance"] for r in got], want, atol=1e-6) and [r["enough"] for r in got] == [bool(c >= 0.95) for c in np.cumsum(want)]


def test_consensus_and_reports_of_anomalies(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "ab"[k % 2], float(rng.normal()), float(rng.normal())) for k in range(300)] + [(900 + k, "b", 30.0 + k, -30.0) for k in range(3)]
    df = spark.createDataFrame(rows, "id long, kind string, x double, y double")
    votes = {r["id"]: r for r in models.consensus_anomaly(df, ["x", "y"], "id").collect()}
    assert all(votes[900 + k]["is_anomaly"] and votes[900 + k]["votes"] >= 3 for k in range(3)) and np.mean([r["is_anomaly"] for k, r in votes.items() if k < 900]) < 0.05
    scores = models.isolation_forest(df, ["x", "y"], "id", 0.02, 20)
    by = {r["kind"]: r for r in models.anomalies_by(scores, df, "id", "kind").collect()}
    assert by["a"]["rows"] == 150 and by["b"]["rows"] == 153 and by["b"]["anomalies"] >= 3 and abs(sum(r["share"] for r in by.values()) - 100) < 0.01
    assert [r["kind"] for r in models.anomalies_by(scores, df, "id", "kind", 1).collect()] == [max(by, key=lambda k: (by[k]["anomalies"], k == "a"))]


def test_maintenance_model_and_its_advice(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(500):
        stress = float(rng.random())
        rows.append((k % 20, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), k, *([stress] + [0.1] * 9), float(stress > 0.6)))
    df = spark.createDataFrame(rows, "vehid int, ts timestamp_ntz, nth long, " + ", ".join(f"{f} double" for f in models.FEATURES) + ", label double")
    model, figures, importance = models.train_maintenance_model(df, 10, 5)
    assert {r["metric"]: r["value"] for r in figures.collect()}["accuracy"] > 0.95 and importance.orderBy(F.desc("importance")).first()["feature"] == "engine_stress"
    vehicles = spark.createDataFrame([(k, "ICE", "Car") for k in range(20)], "vehid int, vehicle_type string, vehicle_class string")
    out = {r["vehid"]: r for r in models.predict_maintenance(model, df, vehicles).collect()}
    last = {r[0]: r[3] for r in rows}
    assert len(out) == 20 and all((r["maintenance_probability"] > 0.5) == (last[v] > 0.6) for v, r in out.items() if abs(last[v] - 0.6) > 0.05)
    assert all((r["urgency"] == "CRITICAL") == (r["maintenance_probability"] > 0.8) and "Check engine oil and filter condition" in r["recommendations"] for r in out.values())


def test_feature_pipeline_is_saved_and_used_on_another_frame(spark, tmp_path):
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k)
    rows = [(k, float(k % 7), None if k % 9 == 0 else float(k % 5), at(k), "xyz"[k % 3]) for k in range(200)]
    kind = "id long, a double, b double, at timestamp_ntz, kind string"
    df = spark.createDataFrame(rows, kind)
    other = spark.createDataFrame([(1, 3.0, None, None, None), (2, None, 1.0, at(3), "new"), (3, 2.0, 2.0, at(5), "y")], kind)
    fitted = models.FeaturePipeline(["a", "b"], 2, ("at",), ("kind",)).fit(df)
    out = {r["id"]: r["components"] for r in fitted.transform(other, "id").collect()}
    assert len(out) == 3 and all(len(c) == 2 and np.isfinite(c).all() for c in out.values())
    fitted.save(str(tmp_path / "pipeline"))
    again = models.FeaturePipeline.load(str(tmp_path / "pipeline"))
    assert {r["id"]: r["components"] for r in again.transform(other, "id").collect()} == out
    # Against numpy: medians, hours and flags by hand.
    b = [r[2] for r in rows if r[2] is not None]
    x = np.array([[r[1], np.median(b) if r[2] is None else r[2], r[3].hour, r[3].weekday(), r[3].month, *(float(r[4] == v) for v in "xyz"), 0.0] for r in rows])
    z = (x - x.mean(0)) / np.where(x.std(0, ddof=1) > 0, x.std(0, ddof=1), np.inf)
    values = np.linalg.eigvalsh(np.cov(z.T))
    assert np.allclose(fitted.model.stages[-1].explainedVariance.toArray(), np.sort(values)[::-1][:2] / values.sum(), atol=1e-6)
