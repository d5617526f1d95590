"""Exact quantiles against numpy, with brackets narrowed down to a few values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions.quantiles import exact_quantiles

PS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("few", [1 << 16, 200, 1])
def test_quantiles_equal_numpy(spark, few):
    rng = np.random.default_rng(few)
    n = 20_000
    data = {"even": rng.random(n), "steep": rng.lognormal(0, 3, n), "ties": rng.integers(0, 5, n).astype(float), "mostly": np.where(rng.random(n) < 0.97, 7.0, rng.random(n) * 100), "signed": rng.normal(size=n) * 1e6}
    rows = list(zip(*(map(float, v) for v in data.values())))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(7)
    got = exact_quantiles(df, {c: F.col(c) for c in data}, {c: PS for c in data}, few)
    for c, v in data.items():
        for p in PS:
            assert got[c, p] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12), (c, p)


def test_quantiles_of_few_rows_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1.0, None, 3), (None, None, 5), (2.0, None, None), (float("nan"), None, 4)], "a double, b double, c int")
    got = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c") * 2}, {"a": [0.5, 0.0], "b": [0.5], "c": [0.25]})
    assert got == {("a", 0.5): 1.5, ("a", 0.0): 1.0, ("b", 0.5): None, ("c", 0.25): 7.0}
