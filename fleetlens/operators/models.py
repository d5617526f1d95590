"""Models of maintenance, anomalies and clusters: MLlib where it has them, isolation trees fitted by group and scored by Arrow batches.

Fixed values: the thresholds, weights, labels and advice texts in these queries are what results must hold; they stand where they
are used.
"""

from __future__ import annotations

import json
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import write_shared
from ..functions.quantiles import exact_quantiles
from ..plans.dialect import SPARK, bound, compilable
from . import analysis, forests
from .enrichment import ORDER
from .forests import RandomForestClassifier

FEATURES = ["engine_stress", "efficiency_ma", "efficiency_degradation", "rpm_variance", "brake_wear_indicator", "fault_history", "hour_of_day", "day_of_week", "trip_intensity", "driver_impact"]
READING_FEATURES = ["speed_kmh", "engine_temperature_c", "fuel_level_percent", "rpm", "battery_voltage", "fuel_consumption_lph"]
TREES, SAMPLE = 100, 256
#: Tasks of a core in each round of the learners over the maintenance frame, and files that it is stored in.
TASKS = 4


def in_even_tasks(learn):
    """Learners read a stored frame in each round; by Spark's default its files would be packed into little more tasks than cores, and most cores would wait for the last ones."""
    @wraps(learn)
    def run(df: DataFrame, *args, **given):
        session, key = df.sparkSession, "spark.sql.files.minPartitionNum"
        before = session.conf.get(key, None)
        if before is None:
            session.conf.set(key, TASKS * session.sparkContext.defaultParallelism)
        try:
            return learn(df, *args, **given)
        finally:
            if before is None:
                session.conf.unset(key)

    return run


def assembled(df: DataFrame, columns: list[str], scale: bool = True) -> list:
    stages = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep")]
    return [*stages, StandardScaler(inputCol="raw", outputCol="features", withMean=True)] if scale else [VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")]


def maintenance_frame(telemetry: DataFrame, vehicles: DataFrame) -> DataFrame:
    """`analysis.maintenance_features` with the flag as label (of trips of the same keys, the largest); missing values as 0.

    Trips are shuffled once, by vehicle, and the label is found in the order that the features need anyway. The result is
    written, as models read it many times.
    """
    keys = ["vehid", *ORDER.split(", ")]
    same = Window.partitionBy(*keys).orderBy(analysis.EFF).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    trips = telemetry.repartition(TASKS * telemetry.sparkSession.sparkContext.defaultParallelism, "vehid").withColumn("label", F.max(F.col("maintenance_flag").cast("double")).over(same))
    text = analysis.maintenance_text(SPARK, analysis.maintenance_base(SPARK), also=", label")
    out = compilable(telemetry.sparkSession).sql(bound(text, ("telemetry", "vehicles")), telemetry=trips, vehicles=vehicles)
    return write_shared(out.dropna(subset=keys).select("vehid", "ts", "nth", *FEATURES, "label").fillna(0, FEATURES), "maintenance")


def held_out(df: DataFrame, seed: int) -> Column:
    """Whether a row is of the fifth that is held out: by hash of all its columns, so that no order of rows and no sort decides."""
    return F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(5)) == 0


@in_even_tasks
def train_maintenance_model(df: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42):
    """A balanced random forest on four fifths; (model, one-row metrics, importances)."""
    train, test = df.filter(~held_out(df, seed)), df.filter(held_out(df, seed))
    share = train.agg(F.avg("label")).first()[0] or 0.0
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6)))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", seed=seed)
    model = Pipeline(stages=[*assembled(df, FEATURES, scale=False), forest]).fit(weighted)
    scored = write_shared(model.transform(test).select("label", "rawPrediction", "prediction"), "scored")
    figures = {m: MulticlassClassificationEvaluator(metricName=m).evaluate(scored) for m in ("accuracy", "f1", "weightedPrecision", "weightedRecall")} | {"auc": BinaryClassificationEvaluator().evaluate(scored)}
    session = df.sparkSession
    importance = session.createDataFrame([(f, float(x)) for f, x in zip(FEATURES, model.stages[-1].featureImportances.toArray())], "feature string, importance double")
    return model, session.createDataFrame([(k, float(v)) for k, v in figures.items()], "metric string, value double"), importance


def predict_maintenance(model, df: DataFrame, vehicles: DataFrame) -> DataFrame:
    """The latest row of each vehicle with probability, urgency and advice."""
    latest = df.groupBy("vehid").agg(F.max_by(F.struct(*FEATURES, "nth"), F.struct("ts", "nth")).alias("r")).select("vehid", "r.*")
    p = F.element_at(vector_to_array("probability"), 2)
    out = model.transform(latest).select("vehid", p.alias("maintenance_probability"), "efficiency_degradation").join(vehicles.select("vehid", "vehicle_type", "vehicle_class"), "vehid")
    loss, prob = F.col("efficiency_degradation"), F.col("maintenance_probability")
    urgency = F.when((prob > 0.8) | (loss > 20), "CRITICAL").when((prob > 0.6) | (loss > 15), "HIGH").when((prob > 0.4) | (loss > 10), "MEDIUM").otherwise("LOW")
    advice = F.concat(
        F.when(prob > 0.7, F.array(F.lit("Schedule immediate diagnostic check"))).when(prob > 0.5, F.array(F.lit("Schedule maintenance within 14 days"))).otherwise(F.array(F.lit("Continue regular monitoring"))),
        F.when(F.col("vehicle_type") == "ICE", F.array(F.lit("Check engine oil and filter condition"))).when(F.col("vehicle_type") == "HEV", F.array(F.lit("Check hybrid battery health"))).when(F.col("vehicle_type") == "BEV", F.array(F.lit("Check battery management system"))).otherwise(F.array().cast("array<string>")),
        F.when(loss > 10, F.array(F.lit("Check air filter and fuel system"))).otherwise(F.array().cast("array<string>")),
    )
    return out.withColumns({"urgency": urgency, "recommendations": advice})


def grow(x: np.ndarray, rng, depth: int, limit: int) -> list:
    """An isolation tree as nested lists: [column, cut, left, right], or the expected path below a leaf."""
    n = len(x)
    if depth >= limit or n <= 1:
        return depth + (0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)
    c = int(rng.integers(x.shape[1]))
    low, high = x[:, c].min(), x[:, c].max()
    if low == high:
        return depth + 2 * (np.log(max(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n
    cut = rng.uniform(low, high)
    left = x[:, c] < cut
    return [c, cut, grow(x[left], rng, depth + 1, limit), grow(x[~left], rng, depth + 1, limit)]


def laid_out(tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as a complete one: column and cut of each node (below node i are 2i+1 and 2i+2), and the value of each leaf. All nodes below a leaf lead to its value."""
    deep = lambda t: 1 + max(deep(t[2]), deep(t[3])) if isinstance(t, list) else 0
    nodes = 2 ** deep(tree) - 1
    column, cut, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.empty(nodes + 1)

    def put(t, i: int) -> None:
        if i >= nodes:
            value[i - nodes] = t
            return
        if isinstance(t, list):
            column[i], cut[i] = t[0], t[1]
        put(t[2] if isinstance(t, list) else t, 2 * i + 1)
        put(t[3] if isinstance(t, list) else t, 2 * i + 2)

    put(tree, 0)
    return column, cut, value


def paths(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The value of each row by a tree as `laid_out`: all rows go down a level at a time."""
    column, cut, value = tree
    flat, at, node = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.int64)
    for _ in range(len(value).bit_length() - 1):
        node = 2 * node + 1 + (flat.take(at + column.take(node)) >= cut.take(node))
    return value.take(node - len(cut))


def isolation_forest(df: DataFrame, columns: list[str], key: str, contamination: float = 0.1, trees: int = TREES, keep: list[str] | tuple = ()) -> DataFrame:
    """key, the columns to keep, score and is_anomaly of each row. A tree is grown on about SAMPLE rows drawn by hash, one group a tree; TREES small trees are broadcast."""
    compilable(df.sparkSession)
    n = max(df.count(), 1)
    share = min(1.0, SAMPLE / n)
    draw = lambda t: F.pmod(F.xxhash64(t, key), F.lit(1 << 30))
    draws = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share * (1 << 30))
    drawn = df.filter(F.least(*(draw(F.lit(t)) for t in range(trees)), F.lit(1 << 30)) < share * (1 << 30))  # compiled, where the lambda is not
    sample = drawn.select(*columns, F.explode(draws).alias("tree"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[columns].fillna(0).to_numpy(float)
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "shape": [json.dumps(grow(x, np.random.default_rng(int(pdf["tree"].iloc[0])), 0, int(np.ceil(np.log2(max(len(x), 2))))))]})

    grown = [r["shape"] for r in sample.groupBy("tree").applyInPandas(fit, "tree int, shape string").orderBy("tree").collect()]
    shared = df.sparkSession.sparkContext.broadcast([laid_out(json.loads(t)) for t in grown])
    size = max(min(n, SAMPLE), 3)
    usual = 2 * (np.log(size - 1) + 0.5772156649) - 2 * (size - 1) / size

    @F.pandas_udf("double")
    def score(cols: pd.DataFrame) -> pd.Series:
        x = cols.fillna(0).to_numpy(float)
        total = sum(paths(t, x) for t in shared.value) / max(len(shared.value), 1)
        return pd.Series(2.0 ** (-total / usual))

    scored = write_shared(df.select(key, *keep, score(F.struct(*columns)).alias("score")), "scores")
    limit = scored.agg(F.percentile_approx("score", 1 - contamination, 10000).alias("limit"))
    return scored.crossJoin(limit).select(key, *keep, F.round("score", 6).alias("score"), (F.col("score") > F.col("limit")).alias("is_anomaly"))


def anomaly_profile(scores: DataFrame, readings: DataFrame) -> DataFrame:
    """Rate of anomalies by hour, with means of what is anomalous and what is not."""
    both = readings.join(scores, "event_id")
    return both.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("readings"), F.count_if("is_anomaly").alias("anomalies"), *(F.round(F.avg(F.when(F.col("is_anomaly"), F.col(c))), 4).alias(f"anomalous_{c}") for c in READING_FEATURES[:2]))


def anomalies_by(scores: DataFrame, rows: DataFrame | None, key: str, column: str, most: int | None = None) -> DataFrame:
    """Rows and anomalies of each value of a column, and the share of all anomalies; `most`: those with most anomalies only (a report). Scores that kept the column need no rows."""
    both = scores if column in scores.columns else rows.select(key, column).join(scores, key)
    out = both.groupBy(column).agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_anomaly").alias("anomalies"))
    total = out.agg(F.sum("anomalies").alias("all"))
    out = out.crossJoin(total).select(column, "rows", "anomalies", F.round(F.try_divide(100 * F.col("anomalies"), "all"), 4).alias("share"))
    return out.orderBy(F.desc("anomalies"), column).limit(most) if most else out


def centre_distances(model, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, cluster, and `distances` to all centres (scaled as the model's features are)."""
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.stages[-1].clusterCenters()))
    out = model.transform(df).select(*keep, F.col("prediction").alias("cluster"), vector_to_array("features").alias("v"))
    apart = lambda c: F.sqrt(F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))
    return out.select(*keep, "cluster", F.transform(centres, apart).alias("distances"))


def kmeans_anomaly(df: DataFrame, columns: list[str], key: str, k: int = 3, limit: float = 0.8, seed: int = 1) -> DataFrame:
    """Cluster, distance to its centre, a score of it against the farthest, and whether that passes the limit."""
    model = Pipeline(stages=[*assembled(df, columns), KMeans(k=k, seed=seed)]).fit(df)
    out = centre_distances(model, df, [key]).select(key, "cluster", F.array_min("distances").alias("distance"))
    far = out.agg(F.max("distance").alias("far"))
    return out.crossJoin(far).select(key, "cluster", F.round("distance", 6).alias("distance"), (F.try_divide("distance", "far") > limit).alias("is_anomaly"))


def cluster_rows(df: DataFrame, columns: list[str], key: str, k: int, seed: int = 1) -> DataFrame:
    """The cluster of each row and its distances to all k centres."""
    model = Pipeline(stages=[*assembled(df, columns), KMeans(k=k, seed=seed)]).fit(df)
    return centre_distances(model, df, [key])


def cluster_means(df: DataFrame, rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rows and mean of each column of the clusters that `cluster_rows` gave."""
    return df.join(rows.select(key, "cluster"), key).groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in columns))


def cluster_features(df: DataFrame, columns: list[str], most: int = 10, seed: int = 1) -> DataFrame:
    """k, silhouette and cost of each number of clusters.

    The columns are stored, and `KMeans` itself keeps its vectors for its rounds; of a cached frame it would convert all rows in every round.
    """
    stored = write_shared(df.select(*columns), "columns")
    prepared = Pipeline(stages=assembled(stored, columns)).fit(stored).transform(stored).select("features")
    rows = []
    for k in range(2, most + 1):
        model = KMeans(k=k, seed=seed).fit(prepared)
        rows.append((k, float(ClusteringEvaluator().evaluate(model.transform(prepared))), float(model.summary.trainingCost)))
    best = max(r[1] for r in rows)
    return df.sparkSession.createDataFrame([(*r, r[1] == best) for r in rows], "k int, silhouette double, cost double, is_best boolean")


def pca(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Share of variance of each component, cumulated, and whether 95 percent are reached."""
    model = Pipeline(stages=[*assembled(df, columns), PCA(k=k, inputCol="features", outputCol="components")]).fit(df)
    shares = model.stages[-1].explainedVariance.toArray().tolist()
    total = np.cumsum(shares).tolist()
    return df.sparkSession.createDataFrame([(i + 1, float(a), float(b), b >= 0.95) for i, (a, b) in enumerate(zip(shares, total))], "component int, variance double, cumulative double, enough boolean")


@in_even_tasks
def select_features(df: DataFrame, columns: list[str], target: str, k: int, bins: int = 10) -> DataFrame:
    """Columns by the mean of four scores, each scaled to 0-1: correlation, forest importance, mutual information of bins, elastic-net weight. df is read many times, so it should be stored."""
    data = Pipeline(stages=assembled(df, columns)).fit(df).transform(df.withColumn("label", F.col(target).cast("double")))
    y = F.col(target).cast("double")
    found = df.agg(*(F.abs(F.covar_pop(c, y) / F.nullif(F.stddev_pop(c) * F.stddev_pop(y), F.lit(0.0))).alias(c) for c in columns), *(F.min(c).alias(f"l_{c}") for c in columns), *(F.max(c).alias(f"h_{c}") for c in columns), F.count(F.lit(1)).alias("n rows")).first()
    corr, n, info = found, found["n rows"], []
    forest = RandomForestClassifier(numTrees=20, seed=1).fit(data).featureImportances.toArray()
    lasso = np.abs(LogisticRegression(elasticNetParam=1.0, regParam=0.01).fit(data).coefficients.toArray())
    bins_of = [F.floor((F.col(c) - found[f"l_{c}"]) / ((found[f"h_{c}"] - found[f"l_{c}"]) / bins or 1.0)).alias("bin") for c in columns]
    each_bin = df.select(F.col(target).cast("int").alias("y"), F.posexplode(F.array(*bins_of)).alias("place", "bin"))
    tables = each_bin.groupBy("place", "bin", "y").count().toPandas()  # columns by bins by classes
    for i in range(len(columns)):
        joint = tables[tables["place"] == i].pivot_table(index="bin", columns="y", values="count", fill_value=0).to_numpy() / max(n, 1)
        each = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        info.append(float((joint[joint > 0] * np.log(joint[joint > 0] / each[joint > 0])).sum()))
    scores = np.array([[corr[c] or 0.0 for c in columns], forest, info, lasso])
    scaled = scores / np.maximum(scores.max(axis=1, keepdims=True), 1e-12)
    mean = scaled.mean(axis=0)
    order = np.argsort(-mean)
    rows = [(columns[i], *(float(x) for x in scores[:, i]), float(mean[i]), int(p + 1), p < k) for p, i in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "feature string, correlation double, importance double, mutual_information double, weight double, mean_score double, place int, selected boolean")


@in_even_tasks
def eliminate_features(df: DataFrame, columns: list[str], target: str, keep: int, trees: int = 10, seed: int = 1) -> DataFrame:
    """Backward elimination: a forest is fitted on what is left, the column that it needs least goes, until `keep` are left.

    feature, round (in which it went; null: it stays), importance (when it went, or at the end), place (1: the most important), selected.
    The bins of all columns are stored once, and each forest reads those of the columns that are left.
    """
    data = df.withColumn("label", F.col(target).cast("double"))
    rows = forests.binned(data, columns, *forests.measured(data, columns))
    left, gone = list(columns), []
    while True:
        found = RandomForestClassifier(numTrees=trees, seed=seed).fit(rows.select(*left, "label", "draw")).featureImportances
        if len(left) <= keep:
            break
        worst = int(np.argmin(found))
        gone.append((left.pop(worst), len(gone) + 1, float(found[worst])))
    order = np.argsort(-found, kind="stable")
    rows = [(left[i], None, float(found[i]), p + 1, True) for p, i in enumerate(order)]
    rows += [(name, r, x, len(left) + len(gone) - r + 1, False) for name, r, x in gone]
    return df.sparkSession.createDataFrame(rows, "feature string, round int, importance double, place int, selected boolean")


@in_even_tasks
def compare_models(df: DataFrame, columns: list[str], seed: int = 3) -> DataFrame:
    """Forest, boosted trees, logistic regression and their mean probability on a fifth held out. df is read many times, so it should be stored.

    Trees learn from bins of the four fifths, which are stored once; one pass scores the held-out rows by all models.
    """
    df = df.withColumn("held_out", held_out(df, seed))
    train, test = df.filter(~F.col("held_out")), df.filter("held_out")
    cuts, classes = forests.measured(train, columns)
    rows = forests.binned(train, columns, cuts, classes)
    line = Pipeline(stages=[*assembled(train, columns, scale=False), LogisticRegression()]).fit(train).stages[-1]
    weights, start = line.coefficients.toArray(), line.intercept
    trees = RandomForestClassifier(numTrees=20, seed=seed).fit(rows), forests.boost(rows, columns, 10)
    models = ["random_forest", "boosted_trees", "logistic_regression"]

    def score(batches):
        for b in batches:
            flat, x = forests.bins_of(b, columns, cuts), np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
            found = [*(t.probability(flat, b.num_rows) for t in trees), 1 / (1 + np.exp(-(x @ weights + start)))]
            yield pa.RecordBatch.from_arrays([b.column("label"), *map(pa.array, found)], ["label", *models])

    held = test.select(*(F.col(c).cast("double").alias(c) for c in columns), F.col("label").cast("double").alias("label"))
    wide = write_shared(held.mapInArrow(score, "label double, " + ", ".join(f"{m} double" for m in models)), "probabilities").withColumn("ensemble", sum(F.col(m) for m in models) / len(models))
    long = wide.unpivot(["label"], [*models, "ensemble"], "model", "p").withColumn("yes", F.col("p") > 0.5)
    hit = lambda p, y: F.count_if((F.col("yes") == p) & (F.col("label") == y))
    out = long.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), ((hit(True, 1) + hit(False, 0)) / F.count(F.lit(1))).alias("accuracy"), F.try_divide(hit(True, 1), hit(True, 1) + hit(True, 0)).alias("precision"), F.try_divide(hit(True, 1), hit(True, 1) + hit(False, 1)).alias("recall"))
    return out.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def consensus_anomaly(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rows that at least two of four detectors flag: isolation forest, z-score, median distance, cluster distance.

    The forest's stored rows keep the columns, and the other detectors go on from them: nothing is joined but single rows of figures.
    """
    rows = isolation_forest(df, columns, key, 0.05, 25, keep=columns).withColumn("by_forest", F.col("is_anomaly").cast("int"))
    model = Pipeline(stages=[*assembled(df, columns), KMeans(k=3, seed=1)]).fit(df)
    middles = lambda away: {c: F.lit(exact[c, 0.5]).cast("double") for exact in [exact_quantiles(rows, away, {c: [0.5] for c in columns})] for c in columns}
    mid = middles({c: F.col(c) for c in columns})
    spread = middles({c: F.abs(F.col(c) - mid[c]) for c in columns})
    stats = rows.agg(*(x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    near = centre_distances(model, rows, [key, *columns, "by_forest"]).withColumn("distance", F.array_min("distances"))
    z = F.greatest(*(F.abs(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}"))) for c in columns))
    mad = F.greatest(*(F.abs(F.try_divide(0.6745 * (F.col(c) - mid[c]), spread[c])) for c in columns))
    by_cluster = F.try_divide("distance", "far") > 0.8
    out = near.filter(F.col(key).isNotNull()).crossJoin(near.agg(F.max("distance").alias("far"))).crossJoin(stats)
    out = out.select(key, "by_forest", by_cluster.cast("int").alias("by_cluster"), (z > 2.5).cast("int").alias("by_zscore"), (mad > 3.5).cast("int").alias("by_median"))
    votes = F.col("by_forest") + F.col("by_cluster") + F.coalesce("by_zscore", F.lit(0)) + F.coalesce("by_median", F.lit(0))
    return out.withColumn("votes", votes).withColumn("is_anomaly", F.col("votes") >= 2)


NEED_FEATURES = ("total_distance_km", "total_fuel_consumed_l", "avg_fuel_efficiency", "total_idle_min", "fault_count", "avg_driver_score")


def vehicle_periods(trips: DataFrame, period: str = "month") -> DataFrame:
    """A vehicle's figures of each period, with how often maintenance was flagged."""
    return trips.groupBy("vehid", F.date_trunc(period, F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("period")).agg(
        F.sum("trip_distance_km").alias("total_distance_km"), F.sum("fuel_consumed_l").alias("total_fuel_consumed_l"), F.avg("fuel_efficiency_kmpl").alias("avg_fuel_efficiency"), F.sum("idle_time_min").alias("total_idle_min"),
        F.count_if("has_fault").alias("fault_count"), F.count_if("maintenance_flag").alias("maintenance_count"), F.avg("driver_behavior_score").alias("avg_driver_score"))


def maintenance_regression(periods: DataFrame, keys: tuple[str, ...] = ("vehid", "period")) -> DataFrame:
    """Elastic-net regression of maintenance_count on NEED_FEATURES: need and next maintenance of the fifth that is held out (by hash of the keys)."""
    data = periods.fillna(0, list(NEED_FEATURES)).withColumn("fifth", F.pmod(F.xxhash64(*keys), F.lit(5)))
    learner = LinearRegression(labelCol="maintenance_count", maxIter=10, regParam=0.3, elasticNetParam=0.8)
    model = Pipeline(stages=[*assembled(data, list(NEED_FEATURES), scale=False), learner]).fit(data.filter("fifth <> 0"))
    need = F.col("prediction")
    return model.transform(data.filter("fifth = 0")).select(*keys, F.round("total_distance_km", 4).alias("total_distance_km"), "maintenance_count", F.round(need, 6).alias("predicted_maintenance_need"),
        F.round(F.col("total_distance_km") * F.when(need > 0.5, 1.2).otherwise(1.5), 4).alias("next_maintenance_km"))


def svd(df: DataFrame, columns: list[str]) -> DataFrame:
    """Singular values of the standardised columns, their share of the squared sum, and each one's direction.

    The products of all pairs of columns are summed in one pass; only this small square is decomposed on the driver.
    """
    mean = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    away = {c: F.coalesce(F.col(c) - F.lit(mean[c]), F.lit(0.0)) for c in columns}
    sums = df.agg(*(F.sum(away[a] * away[b]).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i), F.count(F.lit(1)).alias("n")).first()
    square = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(columns))] for i in range(len(columns))])
    scale = np.sqrt(np.maximum(np.diag(square) / max(sums["n"] - 1, 1), 1e-300))
    values, directions = np.linalg.eigh(square / np.outer(scale, scale))
    values, directions = np.maximum(values[::-1], 0), directions[:, ::-1]
    rows = [(i + 1, float(np.sqrt(v)), float(v / max(values.sum(), 1e-300)), [float(x) for x in directions[:, i] * np.sign(directions[np.abs(directions[:, i]).argmax(), i])]) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "component int, singular_value double, share double, direction array<double>")


class FeaturePipeline:
    """Fit on one frame, transform others, save and load: numbers, times of day and categories to main components.

    Missing numbers become the median; `times` give hour, weekday and month (as numbers; missing ones 0); `categories` are indicator
    columns of the values that were there when it was fitted, and one more for all others and missing ones. All is scaled, then
    brought to main components. Every stage is one of MLlib's, so a fitted pipeline is saved and loaded by MLlib itself.
    """

    def __init__(self, columns: list[str], components: int = 3, times: tuple[str, ...] = (), categories: tuple[str, ...] = ()):
        self.columns, self.components, self.times, self.categories, self.model = columns, components, times, categories, None

    def stages(self) -> list:
        parts = {f"{t}_{name}": f"CAST({sql} AS DOUBLE)" for t in self.times for name, sql in (("hour", f"COALESCE(hour({t}), 0)"), ("weekday", f"COALESCE(weekday({t}), 0)"), ("month", f"COALESCE(month({t}), 0)"))}
        numbers = ", ".join(f"CAST({c} AS DOUBLE) AS _{c}" for c in self.columns)
        texts = "".join(f", COALESCE(CAST({c} AS STRING), '') AS _{c}_text" for c in self.categories)
        out = [SQLTransformer(statement=f"SELECT *, {numbers}{texts}{''.join(f', {v} AS _{k}' for k, v in parts.items())} FROM __THIS__")]
        out.append(Imputer(strategy="median", relativeError=1e-4, inputCols=[f"_{c}" for c in self.columns], outputCols=[f"_{c}_full" for c in self.columns]))
        ready = [*(f"_{c}_full" for c in self.columns), *(f"_{k}" for k in parts)]
        if self.categories:
            out.append(StringIndexer(inputCols=[f"_{c}_text" for c in self.categories], outputCols=[f"_{c}_index" for c in self.categories], handleInvalid="keep", stringOrderType="alphabetAsc"))
            out.append(OneHotEncoder(inputCols=[f"_{c}_index" for c in self.categories], outputCols=[f"_{c}_flags" for c in self.categories], dropLast=False, handleInvalid="keep"))
            ready += [f"_{c}_flags" for c in self.categories]
        return [*out, VectorAssembler(inputCols=ready, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), PCA(k=self.components, inputCol="_scaled", outputCol="components")]

    def fit(self, df: DataFrame) -> FeaturePipeline:
        self.model = Pipeline(stages=self.stages()).fit(df)
        return self

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        return self.model.transform(df).select(key, vector_to_array("components").alias("components"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> FeaturePipeline:
        """A fitted pipeline for `transform`."""
        out = cls([])
        out.model = PipelineModel.load(path)
        return out
