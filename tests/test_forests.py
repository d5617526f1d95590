"""Learners over binned columns, against brute force and against MLlib."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fleetlens.operators import forests, models

ABC = ["a", "b", "c"]


def table(spark, n=1500, seed=4):
    """Whole numbers of few values, and a label that some of them decide with noise."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, k, n) for k in (30, 17, 9)]).astype(float)
    y = (x[:, 0] / 30 + (x[:, 1] > 8) * (x[:, 2] > 3) + rng.normal(0, 0.4, n) > 1).astype(float)
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, label double"), x, y


def learnt(df, columns=ABC):
    cuts, classes = forests.measured(df, columns)
    return forests.binned(df, columns, cuts, classes), cuts


def flat_of(x, cuts):
    return np.concatenate([np.searchsorted(c, v, "right").astype(np.uint8) for c, v in zip(cuts, x.T)])


def test_bins_lie_between_values_and_missing_ones_come_last(spark):
    df, x, _ = table(spark)
    odd = df.limit(3).selectExpr("CAST(NULL AS DOUBLE) AS a", "CAST('NaN' AS DOUBLE) AS b", "0D AS c", "label")
    rows, cuts = learnt(df.union(odd).coalesce(3))
    assert [list(c) for c in cuts] == [[v + 0.5 for v in range(k - 1)] for k in (30, 17, 9)]
    got = [r for b in rows.collect() for r in zip(*(np.frombuffer(b[c], np.uint8) for c in [*ABC, "label"]))]
    assert rows.count() < 10 and sorted(r[:3] for r in got) == sorted([*map(tuple, x.astype(int)), *3 * [(29, 16, 0)]])
    batch = pa.RecordBatch.from_pydict({"a": [None, 0.5], "b": [float("nan"), 0.4], "c": [7.7, -1.0]})
    assert list(forests.bins_of(batch, ABC, cuts)) == [29, 1, 16, 0, 8, 0]


def test_many_values_get_bins_of_equal_shares(spark):
    df = spark.range(20000).selectExpr("CAST(pmod(id * 7919, 20000) AS DOUBLE) AS a", "1D AS b", "CAST(NULL AS DOUBLE) AS c", "CAST(id % 2 AS DOUBLE) AS label")
    rows, cuts = learnt(df)
    assert [len(c) for c in cuts] == [31, 0, 0]
    counts = sum(np.bincount(np.frombuffer(r["a"], np.uint8), minlength=32) for r in rows.collect())
    assert counts.sum() == 20000 and counts.min() > 400 and counts.max() < 850


def test_few_rows_are_read_in_one_task(spark):
    rows, _ = learnt(table(spark)[0].repartition(6))
    small, many = forests.in_tasks(rows)
    assert rows.rdd.getNumPartitions() > 1 and small.rdd.getNumPartitions() == 1 and not many


def test_a_split_is_the_best_of_all(spark):
    """The first split of one tree on its bag, against every cut of every column."""
    df, x, y = table(spark)
    rows, cuts = learnt(df.coalesce(1))
    tree = forests.grow_forest(rows, ABC, 1, 3, 7).trees[0]
    block = rows.first()
    w = forests.bags(np.frombuffer(block["draw"], np.uint64), 1, 7)[0].astype(float)
    bins, label = [np.frombuffer(block[c], np.uint8) for c in ABC], np.frombuffer(block["label"], np.uint8)
    gini = lambda inside: 2 * (w * label)[inside].sum() * (w * (1 - label.astype(float)))[inside].sum() / max(w[inside].sum(), 1)  # noqa: E731  times rows
    every = np.ones(len(w), bool)
    gains = {(c, k): gini(every) - gini(bins[c] <= k) - gini(bins[c] > k) for c in range(3) for k in range(len(cuts[c]))}
    assert np.isclose(tree.gain[0], max(gains.values())) and gains[tree.column[0], tree.cut[0]] == max(gains.values())
    assert 0.9 < w.mean() < 1.1 and np.isclose(tree.stats[0].sum(), w.sum())


def test_boosted_trees_are_those_of_mllib(spark):
    df, x, _ = table(spark)
    model = Pipeline(stages=[*models.assembled(df, ABC, scale=False), GBTClassifier(maxIter=4, seed=1)]).fit(df)
    want = [r[0] for r in model.transform(df).select(F.element_at(vector_to_array("probability"), 2)).collect()]
    rows, cuts = learnt(df)
    got = forests.boost(rows, ABC, 4).probability(flat_of(x, cuts), len(x))
    assert np.abs(got - want).max() < 1e-6


def test_a_forest_scores_like_the_label(spark):
    df, x, y = table(spark)
    rows, cuts = learnt(df)
    forest = models.RandomForestClassifier(numTrees=20, seed=3).fit(rows)
    p = forest.probability(flat_of(x, cuts), len(x))
    assert ((p > 0.5) == y).mean() > 0.8 and np.isclose(forest.featureImportances.sum(), 1)


def test_elimination_does_not_depend_on_tasks(spark):
    """Bags are drawn by rows: however they are dealt out, the same columns go with the same importances."""
    df, _, _ = table(spark)
    one, many = (sorted(models.eliminate_features(d, ABC, "label", 1, trees=4).collect(), key=lambda r: r["feature"]) for d in (df.coalesce(1), df.repartition(9)))
    assert [(r["feature"], r["round"], r["place"]) for r in one] == [(r["feature"], r["round"], r["place"]) for r in many]
    assert np.allclose([r["importance"] for r in one], [r["importance"] for r in many])


def test_compared_models_do_not_depend_on_tasks(spark):
    df, _, _ = table(spark)
    df = df.withColumn("id", F.expr("xxhash64(a, b, c, label)"))
    one, many = ({r["model"]: r for r in models.compare_models(d, ABC).collect()} for d in (df.coalesce(1), df.repartition(9)))
    assert one == many and set(one) == {"random_forest", "boosted_trees", "logistic_regression", "ensemble"}
    assert all(r["accuracy"] > 0.75 and r["rows"] == one["ensemble"]["rows"] for r in one.values())


def test_held_out_rows_are_scored_by_each_model(spark, monkeypatch):
    """The stored probabilities against MLlib's boosted trees and line on the same four fifths."""
    df, _, _ = table(spark)
    stored, write = [], models.write_shared
    monkeypatch.setattr(models, "write_shared", lambda d, name: (stored.append(write(d, name)), stored[-1])[1])
    models.compare_models(df, ABC, seed=3).collect()
    got = sorted(map(tuple, stored[-1].select("label", "boosted_trees", "logistic_regression").collect()))
    flagged = df.withColumn("held_out", models.held_out(df, 3))
    fit = lambda learner: Pipeline(stages=[*models.assembled(df, ABC, scale=False), learner]).fit(flagged.filter("NOT held_out"))
    p = lambda d, learner, name: fit(learner).transform(d).withColumn(name, F.element_at(vector_to_array("probability"), 2)).drop("raw", "features", "rawPrediction", "probability", "prediction")
    want = p(p(flagged.filter("held_out"), GBTClassifier(maxIter=10, seed=3), "g"), LogisticRegression(), "l")
    assert np.allclose(got, sorted(map(tuple, want.select("label", "g", "l").collect())), atol=1e-4)


def test_a_rare_class_keeps_its_importances(spark):
    """Where no leaf predicts the rare class, the column that goes with it is still the one that stays."""
    df = spark.range(6000).selectExpr("CAST(pmod(xxhash64(id, 1), 20) AS DOUBLE) AS a", "CAST(pmod(xxhash64(id, 2), 20) AS DOUBLE) AS b", "CAST(pmod(xxhash64(id, 3), 20) AS DOUBLE) AS c", "id")
    df = df.selectExpr("a", "b", "c", "CAST(pmod(xxhash64(id, 4), 100) < 2 + b / 2 AS DOUBLE) AS label")
    got = {r["feature"]: r for r in models.eliminate_features(df, ABC, "label", 1).collect()}
    assert got["b"]["selected"] and all(r["importance"] > 0 for r in got.values())


def test_partial_sums_can_be_added_up_in_tasks(spark, monkeypatch):
    df, _, _ = table(spark)
    rows, _ = learnt(df.repartition(6))
    want = forests.grow_forest(rows, ABC, 3, 3, 5).featureImportances
    monkeypatch.setattr(forests, "PARTS", 1)
    monkeypatch.setattr(forests, "LEAST_ROWS", 300)
    assert forests.in_tasks(rows)[0].rdd.getNumPartitions() > 1 and forests.in_tasks(rows)[1]
    monkeypatch.setattr(forests, "TOGETHER", 3)
    assert np.allclose(forests.grow_forest(rows, ABC, 3, 3, 5).featureImportances, want)


def test_settings_are_as_before_and_wrong_labels_stop(spark):
    df, _, _ = table(spark)
    keys = ["spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    rows, _ = learnt(df)
    forests.grow_forest(rows, ABC, 2, 2, 1)
    assert before == [spark.conf.get(k) for k in keys]
    for label in ("label + 0.5D", "label - 1", "IF(a > 3, NULL, label)"):
        with pytest.raises(ValueError):
            forests.measured(df.withColumn("label", F.expr(label)), ABC)
    with pytest.raises(ValueError):
        forests.measured(df.limit(0), ABC)
    with pytest.raises(ValueError):
        forests.boost(learnt(df.withColumn("label", F.col("a") % 3))[0], ABC, 2)
