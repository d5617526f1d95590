"""Anomalies by distance to clusters that move with a stream: mini-batch k-means with decay, carried from batch to batch.

What is carried (`Carried`): centres and their weights, decayed moments of the columns (for scaling) and of the distances. A
batch is scored by what was carried into it, then changes it; the first one is scored by clusters of its own. All rows are
worked on by Spark; the driver sees k rows of sums and one of moments for each batch. Each batch's outcome is a file named by
the batch, so a batch that is run again after a failure, or a query that is started anew, begins from the same state.

A score is distance / reach * LIMIT, where reach is the mean of the distances plus SIGMAS deviations: over LIMIT is an
anomaly. Rows that are anomalies do not move centres or scales, so that outliers do not hide those that follow; a cluster that
gets no rows for long loses its weight, and then follows the first rows that come near.

Defined results: a missing value counts as the column's mean; rows of an empty batch change nothing; a constant column has no
part in distances.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Score above which a row is an anomaly, and deviations of the distance that it stands for.
LIMIT, SIGMAS = 0.8, 3.0
#: Rows that first centres are chosen from, and steps that settle them.
FIRST_ROWS, STEPS = 1000, 8


@dataclass
class Carried:
    centres: list[list[float]]
    weights: list[float]
    rows: float
    mean: list[float]
    variance: list[float]
    distance: float
    distance_variance: float

    @property
    def reach(self) -> float:
        return self.distance + SIGMAS * float(np.sqrt(self.distance_variance))


def distances(columns: list[str], c: Carried) -> Column:
    """Distances of a row to all centres, in deviations of the columns."""
    scale = [1 / np.sqrt(v) if v > 1e-12 else 0.0 for v in c.variance]
    value = [F.coalesce(F.col(x).cast("double"), F.lit(m)) for x, m in zip(columns, c.mean)]
    square = lambda v, at, s: (v - F.lit(at)) * (v - F.lit(at)) * F.lit(s * s)
    return F.array(*(F.sqrt(sum((square(v, at, s) for v, at, s in zip(value, centre, scale)), F.lit(0.0))) for centre in c.centres))


def scored(df: DataFrame, columns: list[str], c: Carried) -> DataFrame:
    """df with cluster (from 0), distance and score."""
    out = df.withColumn("_d", distances(columns, c)).withColumn("distance", F.array_min("_d"))
    out = out.withColumn("cluster", F.array_position("_d", F.col("distance")).cast("int") - 1).drop("_d")
    return out.withColumn("score", F.round(F.col("distance") / F.lit(max(c.reach, 1e-12)) * LIMIT, 6))


def sums_of(df: DataFrame, columns: list[str], c: Carried) -> dict[int, tuple[int, list[float]]]:
    """Rows and sums of each cluster's columns."""
    sums = [F.sum(F.coalesce(F.col(x).cast("double"), F.lit(m))).alias(f"s{i}") for i, (x, m) in enumerate(zip(columns, c.mean))]
    return {r["cluster"]: (r["n"], [r[f"s{i}"] for i in range(len(columns))]) for r in df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}


def moments(df: DataFrame, columns: list[str]) -> tuple[int, list[float], list[float]]:
    r = df.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns))).first()
    return r["n"], [float(r[f"m{i}"] or 0) for i in range(len(columns))], [float(r[f"v{i}"] or 0) for i in range(len(columns))]


def begin(df: DataFrame, columns: list[str], k: int, key: str) -> Carried:
    """Clusters of a first batch: of FIRST_ROWS rows (by hash of the key) those far from each other, then settled on all rows."""
    n, mean, variance = moments(df, columns)
    first = df.orderBy(F.xxhash64(key), key).limit(FIRST_ROWS).select(*(F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c) for c, m in zip(columns, mean)))
    x = np.array([tuple(r) for r in first.collect()], float).reshape(-1, len(columns))
    scale = np.array([1 / np.sqrt(v) if v > 1e-12 else 0.0 for v in variance])
    z = (x - mean) * scale
    chosen = [int((z**2).sum(1).argmin())]
    while len(chosen) < min(k, len(z)):
        # The upper quartile of what is left: far from what there is, but no outlier.
        near = np.min([((z - z[i]) ** 2).sum(1) for i in chosen], axis=0)
        chosen.append(int(np.argsort(near, kind="stable")[int(0.9 * (len(near) - 1))]))
    c = Carried([x[i].tolist() for i in chosen], [0.0] * len(chosen), float(n), mean, variance, 0.0, 0.0)
    for _ in range(STEPS):
        sums = sums_of(scored(df, columns, c), columns, c)
        c.centres = [[s / sums[i][0] for s in sums[i][1]] if i in sums else at for i, at in enumerate(c.centres)]
        c.weights = [float(sums[i][0]) if i in sums else 0.0 for i in range(len(c.centres))]
    _, (distance,), (spread,) = moments(scored(df, columns, c), ["distance"])
    c.distance, c.distance_variance = distance, spread
    return c


def moved(c: Carried, df: DataFrame, columns: list[str], decay: float) -> Carried:
    """What is carried on after a scored batch: everything known counts `decay` times."""
    good = df.filter(F.col("score") <= LIMIT)
    sums = sums_of(good, columns, c)
    n, figures, variances = moments(good, [*columns, "distance"])
    if not n:
        return c
    old, total = c.rows * decay, c.rows * decay + n

    def merge(m0, v0, m1, v1):
        m = (old * m0 + n * m1) / total
        return m, (old * (v0 + (m0 - m) ** 2) + n * (v1 + (m1 - m) ** 2)) / total

    merged = [merge(*x) for x in zip([*c.mean, c.distance], [*c.variance, c.distance_variance], figures, variances)]
    centres, weights = [], []
    for i, (at, w) in enumerate(zip(c.centres, c.weights)):
        count, s = sums.get(i, (0, [0.0] * len(columns)))
        w = w * decay
        centres.append([(w * a + b) / (w + count) for a, b in zip(at, s)] if w + count > 0 else at)
        weights.append(w + count)
    return Carried(centres, weights, total, [m for m, _ in merged[:-1]], [v for _, v in merged[:-1]], *merged[-1])


class MovingClusters:
    """A foreachBatch sink: scores of each batch under `<path>/scores/batch=<n>`, what is carried under `<path>/carried/<n>`."""

    def __init__(self, path: str, columns: list[str], key: str, k: int = 3, decay: float = 0.5, keep: tuple[str, ...] = ()):
        self.path, self.columns, self.key, self.k, self.decay, self.keep = path, columns, key, k, decay, keep

    def carried(self, spark: SparkSession, n: int) -> Carried | None:
        """What the last batch before n left (batches without rows leave nothing)."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/carried")
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return None
        before = [k for k in (int(f.getPath().getName()) for f in files.listStatus(folder)) if k < n]
        return Carried(**json.loads(spark.read.text(f"{self.path}/carried/{max(before)}").first()[0])) if before else None

    def __call__(self, batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        c = self.carried(spark, n)
        fresh = c is None
        if fresh:
            c = begin(batch, self.columns, self.k, self.key)
        path = f"{self.path}/scores/batch={n}"
        out = scored(batch.select(self.key, *self.keep, *self.columns), self.columns, c)
        out.write.mode("overwrite").parquet(path)
        after = c if fresh else moved(c, spark.read.parquet(path), self.columns, self.decay)
        spark.createDataFrame([(json.dumps(asdict(after)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/carried/{n}")

    def scores(self, spark: SparkSession) -> DataFrame:
        """Key, kept columns, batch, cluster, distance, score and is_anomaly of all rows so far."""
        out = spark.read.parquet(f"{self.path}/scores")
        return out.select(self.key, *self.keep, "batch", "cluster", F.round("distance", 6).alias("distance"), "score", (F.col("score") > LIMIT).alias("is_anomaly"))


def play_clusters(replay, prepare: Callable[[DataFrame], DataFrame], sink: MovingClusters) -> DataFrame:
    """A replay through the sink, slice by slice with a restart after each."""
    from .replay import play

    play([replay], prepare, "append", sink=sink)
    return sink.scores(replay.spark)
