"""Clusters that move with a stream: drift is followed, outliers are flagged, a restart or a repeated batch changes nothing."""

import random

import numpy as np
from pyspark.sql import functions as F

from fleetlens.folders import new_path
from fleetlens.streaming import clusters
from fleetlens.streaming.replay import Replay


def rows(drift=0.6, slices=6, seed=1):
    """Three groups; one moves by drift in each slice. Every slice has two outliers (ids from 100,000)."""
    rng, out = random.Random(seed), []
    for part in range(slices):
        for k in range(240):
            at = [(0, 0), (10, 0), (0, 10 + drift * part)][k % 3]
            out.append((part * 1000 + k, at[0] + rng.gauss(0, 0.5), at[1] + rng.gauss(0, 0.5), 5.0, part))
        out += [(100_000 + part * 10 + k, 30.0 + k, -20.0, 5.0, part) for k in range(2) if part]
    return out


def run(spark, given, path=None):
    df = spark.createDataFrame(given, "id long, x double, y double, same double, slice int")
    sink = clusters.MovingClusters(path or new_path(spark, "clusters"), ["x", "y", "same"], "id")
    return sink, clusters.play_clusters(Replay(df), lambda s: s, sink)


def test_drift_is_followed_and_outliers_are_flagged(spark):
    sink, out = run(spark, rows())
    got = {r.id: r for r in out.collect()}
    assert len(got) == 6 * 240 + 10 and all(got[k].is_anomaly for k in got if k >= 100_000)
    assert np.mean([r.is_anomaly for k, r in got.items() if k < 100_000]) < 0.03
    last = sink.carried(spark, 99)
    moving = min(last.centres, key=lambda c: abs(c[0]) + abs(c[1] - 13))
    assert abs(moving[0]) < 0.4 and 11.8 < moving[1] < 13.2 and last.rows < 2.1 * 240 + 1
    groups = {tuple(sorted({got[part * 1000 + k].cluster for k in range(g, 240, 3) if not got[part * 1000 + k].is_anomaly})) for part in range(6) for g in range(3)}
    assert len(groups) == 3 and all(len(g) == 1 for g in groups)


def test_scores_of_a_batch_by_plain_python(spark):
    sink, out = run(spark, rows(slices=2))
    c = sink.carried(spark, 1)
    given = {r[0]: r[1:3] for r in rows(slices=2)}
    scale = [1 / np.sqrt(v) for v in c.variance[:2]]
    for r in out.filter("batch = 1").collect():
        each = [sum(((v - m) * s) ** 2 for v, m, s in zip(given[r.id], centre, scale)) ** 0.5 for centre in c.centres]
        assert r.cluster == int(np.argmin(each)) and abs(r.distance - min(each)) < 1e-5 and abs(r.score - min(each) / c.reach * 0.8) < 1e-5


def test_a_batch_that_is_run_again_gives_the_same(spark):
    sink, out = run(spark, rows(slices=3))
    before, carried = sorted(map(tuple, out.collect())), sink.carried(spark, 3)
    again = spark.createDataFrame([r[:4] for r in rows(slices=3) if r[4] == 2], "id long, x double, y double, same double")
    sink(again, 2)
    after = sink.carried(spark, 3)
    assert sorted(map(tuple, sink.scores(spark).collect())) == before and np.allclose(after.centres, carried.centres)
    sink(again.limit(0), 7)
    assert sink.carried(spark, 99) == after


def test_missing_values_and_few_rows(spark):
    given = [(1, 1.0, None, 5.0, 0), (2, None, None, None, 0), (3, 1.0, 2.0, 5.0, 1)]
    _, out = run(spark, given)
    assert out.count() == 3 and not out.filter(F.col("distance").isNull() | F.isnan("distance")).count()
