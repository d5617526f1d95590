"""Isolation trees are walked a level at a time, and scores carry the columns that reports group by."""

import numpy as np
from pyspark.sql import functions as F

from fleetlens.operators import model_queries, models

SMALL = "/root/testdata/sf0.001"


def walked(tree, row) -> float:
    while isinstance(tree, list):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def test_trees_laid_out_give_the_same_paths():
    rng = np.random.default_rng(5)
    for n, limit in ((1, 0), (2, 1), (300, 9), (256, 8)):
        tree = models.grow(rng.integers(0, 9, (n, 3)).astype(float), rng, 0, limit)
        x = rng.integers(-1, 11, (500, 3)).astype(float)
        x[0, 1] = np.inf
        assert models.paths(models.laid_out(tree), np.asfortranarray(x)).tolist() == [walked(tree, row) for row in x]


def test_anomalies_are_counted_without_a_join(spark):
    """A trip that stands twice counts twice, not four times."""
    df = spark.range(400).select((F.col("id") % 200).alias("id"), (F.col("id") % 200 * 1.0).alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"))
    scores = models.isolation_forest(df, ["x"], "id", 0.1, 10, keep=["kind"])
    assert {r["kind"]: r["rows"] for r in models.anomalies_by(scores, None, "id", "kind").collect()} == {"a": 200, "b": 200}
    plan = model_queries.trip_anomalies(spark, SMALL, "vehicle_type")._jdf.queryExecution().sparkPlan().toString()
    assert not any(join in plan for join in ("SortMergeJoin", "HashJoin"))


def test_consensus_joins_no_rows(spark):
    """A row that stands twice has two votes of its own, not four."""
    df = spark.range(300).select((F.col("id") % 150).alias("id"), (F.col("id") % 150 % 7).cast("double").alias("x"), F.when(F.col("id") % 150 == 0, 900.0).otherwise(F.col("id") % 5).alias("y"))
    out = models.consensus_anomaly(df, ["x", "y"], "id")
    assert out.count() == 300 and {r["id"] for r in out.filter("is_anomaly").collect()} == {0}
    assert not any(join in out._jdf.queryExecution().sparkPlan().toString() for join in ("SortMergeJoin", "HashJoin"))
