"""The rows that maintenance models learn from."""

import numpy as np
from pyspark.sql import functions as F

from fleetlens.folders import write_shared
from fleetlens.operators import analysis, model_queries, models
from fleetlens.sources.views import fleet_views

SMALL = "/root/testdata/sf0.001"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "vehid", "ts"]


def test_labels_come_with_the_features_in_one_shuffle(spark):
    """Trips with the same keys share the largest flag; rows without a key are left out; what models read is stored, not shuffled anew."""
    v = fleet_views(spark, SMALL, ("telemetry", "vehicles"))
    some = v["telemetry"].filter("vehid = 3").limit(5)
    twins = some.withColumns({"maintenance_flag": ~F.col("maintenance_flag"), "fuel_efficiency_kmpl": F.col("fuel_efficiency_kmpl") + 1})
    v["telemetry"] = v["telemetry"].unionByName(twins).unionByName(some.withColumn("l_partkey", F.lit(None).cast("long"))).localCheckpoint()
    label = v["telemetry"].groupBy(*KEYS).agg(F.max(F.col("maintenance_flag").cast("double")).alias("label"))
    want = analysis.maintenance_features(**v).join(label, KEYS).fillna(0, models.FEATURES).select("vehid", "ts", "nth", *models.FEATURES, "label")
    got = models.maintenance_frame(**v)
    assert got.count() == want.count() == v["telemetry"].count() - 5 and got.exceptAll(want).count() == 0
    assert "Exchange" not in got._jdf.queryExecution().toString() and "Window" not in got._jdf.queryExecution().toString()


def test_models_read_stored_rows(spark):
    frame, _ = model_queries.maintenance(spark, SMALL)
    assert frame.inputFiles()


def test_learners_read_the_frame_in_even_tasks(spark, monkeypatch):
    """Some tasks a core in each round, not the files packed into about one a core; the session's setting is as before afterwards."""
    seen, fit, want = [], models.RandomForestClassifier.fit, models.TASKS * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    frame, _ = model_queries.maintenance(spark, SMALL)
    assert len(frame.inputFiles()) > spark.sparkContext.defaultParallelism  # ten vehicles there
    df = write_shared(spark.range(0, 3200, 1, want).selectExpr(*(f"CAST(id * {k} % 101 AS DOUBLE) AS x{k}" for k in (3, 5, 7)), "CAST(id % 2 AS DOUBLE) AS label"), "rows")
    models.eliminate_features(df, ["x3", "x5", "x7"], "label", 2, trees=2)
    assert seen == [want] * 2 and spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_mutual_information_is_counted_in_one_pass(spark, monkeypatch):
    """Against numpy, by ten bins of each column and the label."""
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(400, 2)), (rng.random(400) < 0.3).astype(float)
    x[:, 0] += y
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    taken, to_pandas = [], type(df).toPandas
    monkeypatch.setattr(type(df), "toPandas", lambda self: (taken.append(1), to_pandas(self))[1])
    got = {r["feature"]: r["mutual_information"] for r in models.select_features(df, ["a", "b"], "label", 1).collect()}
    assert len(taken) == 1
    for i, c in enumerate("ab"):
        low, high = x[:, i].min(), x[:, i].max()
        joint = np.zeros((11, 2))
        np.add.at(joint, (np.floor((x[:, i] - low) / ((high - low) / 10)).astype(int), y.astype(int)), 1 / 400)
        each = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        assert np.isclose(got[c], (joint[joint > 0] * np.log(joint[joint > 0] / each[joint > 0])).sum())


def test_held_out_rows_do_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumn("x", F.col("id") * 0.5)
    one = {r["id"] for r in df.filter(models.held_out(df, 7)).collect()}
    many = df.repartition(13)
    assert one == {r["id"] for r in many.filter(models.held_out(many, 7)).collect()} and 900 < len(one) < 1100
    assert one != {r["id"] for r in df.filter(models.held_out(df, 8)).collect()}
