"""Forests and boosted trees over binned columns: a level of all trees is one pass, in which each task sums up its rows by bins (Arrow batches, numpy).

Rows are stored as one byte a column, a label and a draw of eight bytes, and nothing is cached: MLlib's learners keep every row as objects of some 200 bytes and
read the source three times for each forest. Bins, bags, splits, importances and steps are as MLlib has them, but leaves that predict the same class stay apart:
of a rare class nearly all do, and with them all importances would go.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.ml import classification
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import new_path, remove, write_shared

BITS, DEPTH = 5, 5
BINS, PACKED = 1 << BITS, 12
#: Blocks of a batch; each is of as many rows as Arrow batches have (10,000 by default).
BLOCKS = 64
#: Points of a column's distribution that its bins are cut from.
POINTS = 1000
#: Partial sums that the driver adds up itself; more are added up in tasks first.
PARTS, TOGETHER = 256, 32
#: How often a row is in a bag, by 16 bits of its draw (Poisson with mean 1).
TIMES = np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 16)])), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)
LEAST_GAIN = 1e-12
#: Rows that a task of a pass is started for.
LEAST_ROWS = 1 << 17


def cuts_of(points: np.ndarray) -> np.ndarray:
    """At most BINS - 1 cuts: between all values where they are few, else where the rows passed come next to equal shares."""
    values, counts = np.unique(points, return_counts=True)
    if len(values) <= BINS:
        return (values[:-1] + values[1:]) / 2
    cuts, passed, target = [], np.cumsum(counts), len(points) / BINS
    stride = target
    for i in range(1, len(values)):
        if abs(passed[i - 1] - target) < abs(passed[i] - target):
            cuts.append((values[i - 1] + values[i]) / 2)
            target += stride
    return np.array(cuts[: BINS - 1])


def measured(df: DataFrame, columns: list[str]) -> tuple[list[np.ndarray], int]:
    """The cuts of each column and the number of classes of the label, from one pass over all rows."""
    shares = F.array(*(F.lit(i / POINTS) for i in range(POINTS + 1)))
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    points = lambda c: F.when(F.count(number(c)) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(number(c), F.lit(POINTS)), shares))
    y = F.col("label").cast("double")
    found = df.agg(*(points(c).alias(f"c{i}") for i, c in enumerate(columns)), F.min(y).alias("low"), F.max(y).alias("high"), F.count_if(y.isNull() | (y != F.floor(y))).alias("bad")).first()
    if found["high"] is None or found["bad"] or not 0 <= found["low"] <= found["high"] < 256:
        raise ValueError("labels must be 0, 1, ... (below 256), and there must be some")
    return [cuts_of(np.array(found[f"c{i}"])) if found[f"c{i}"] else np.empty(0) for i in range(len(columns))], max(int(found["high"]) + 1, 2)


def bins_of(batch: pa.RecordBatch, columns: list[str], cuts: list[np.ndarray]) -> np.ndarray:
    """How many cuts are not above each value, one column after the other. Missing values are in the last bin, as the largest."""
    values = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns)
    return np.concatenate([np.searchsorted(cut, np.where(np.isnan(x), np.inf, x), "right").astype(np.uint8) for cut, x in zip(cuts, values)])


def binned(df: DataFrame, columns: list[str], cuts: list[np.ndarray], classes: int) -> DataFrame:
    """The bins of the columns, the label and a draw (by hash of all columns, so that no order of rows decides), stored in blocks: a row holds those of thousands of rows as bytes.

    Spark finds the bins (as `bins_of`) and packs twelve to a number, as values cost more on their way to Python than what is done with them there.
    """
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(float("inf"))), F.lit(float("inf")))
    cut = [i for i, x in enumerate(cuts) if len(x)]
    rows = df.select(*(value(c).alias(f"v{i}") for i, c in enumerate(columns)), F.col("label").cast("int").alias("label"), F.xxhash64(*df.columns).alias("draw"))
    if cut:
        rows = Bucketizer(splitsArray=[[-np.inf, *map(float, cuts[i]), np.inf] for i in cut], inputCols=[f"v{i}" for i in cut], outputCols=[f"b{i}" for i in cut]).transform(rows)
    place = lambda i: F.shiftleft(F.col(f"b{i}").cast("long"), BITS * (i % PACKED)) if len(cuts[i]) else F.lit(0).cast("long")
    packed = [sum((place(i) for i in range(at, min(at + PACKED, len(columns)))), F.lit(0).cast("long")) for at in range(0, len(columns), PACKED)]
    rows, count = rows.select(*(x.alias(f"p{i}") for i, x in enumerate(packed)), "label", "draw"), len(packed)

    def each(batches):
        for b in batches:
            longs = [b.column(f"p{i}").to_numpy() for i in range(count)]
            bins = [((longs[i // PACKED] >> (BITS * (i % PACKED))) & (BINS - 1)).astype(np.uint8) for i in range(len(columns))]
            block = [*bins, b.column("label").to_numpy().astype(np.uint8), b.column("draw").to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in block], [*columns, "label", "draw"])

    names = ", ".join(f"{c} binary" for c in [*columns, "label", "draw"])
    stored = write_shared(rows.mapInArrow(each, names), "bins")
    return stored.withMetadata("label", {"classes": classes, "rows": stored.agg(F.sum(F.length("label"))).first()[0]})


@contextmanager
def few_blocks(session: SparkSession):
    """Readers and Arrow batches of some blocks instead of thousands."""
    keys = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [session.conf.get(k, None) for k in keys]
    for k in keys:
        session.conf.set(k, BLOCKS)
    try:
        yield
    finally:
        for k, x in zip(keys, before):
            session.conf.unset(k) if x is None else session.conf.set(k, x)


def numbers(batch: pa.RecordBatch, column: str, i: int, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(batch.column(column)[i].as_buffer(), kind)


def blocks(batches, columns: list[str]):
    """(batch, place in it, rows, their bins: one column after the other) of each block."""
    for b in batches:
        for i in range(b.num_rows):
            bins = [numbers(b, c, i) for c in columns]
            yield b, i, len(bins[0]), np.concatenate(bins)


def bags(draw: np.ndarray, trees: int, seed: int) -> list[np.ndarray]:
    """How often each row is in each tree's bag."""
    out, base = [], np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for block in range(-(-trees // 4)):  # four trees share a number of 64 bits
        z = (draw ^ base) + np.uint64((block + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        out += [TIMES.take((z >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(min(4, trees - 4 * block))]
    return out


class Tree:
    """A complete tree: below node i are 2i+1 and 2i+2. Of nodes that are not split all rows go left."""

    def __init__(self, depth: int, width: int):
        self.depth, inner = depth, 2**depth - 1
        self.column, self.cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        self.gain, self.stats = np.zeros(inner), np.zeros((2 * inner + 1, width))  # gains are weighted by rows
        self.open = [0]

    def split(self, i: int, column: int, cut: int, gain: float, left: np.ndarray, right: np.ndarray) -> None:
        self.column[i], self.cut[i], self.gain[i] = column, cut, gain
        self.stats[2 * i + 1], self.stats[2 * i + 2] = left, right
        self.open += [2 * i + 1, 2 * i + 2]

    def leaves(self, value) -> np.ndarray:
        """The value of what a row's last node belongs to, by place in the last level."""
        of, inner = list(range(len(self.stats))), len(self.cut)
        for i in range(inner):
            if self.cut[i] == BINS:
                of[2 * i + 1] = of[2 * i + 2] = of[i]
        return np.array([value(self.stats[j]) for j in of[inner:]])

    def places(self, flat: np.ndarray, n: int, rows: np.ndarray, depth: int) -> np.ndarray:
        """The place of rows in a level; flat: bins of n rows, columns one after the other."""
        node = np.zeros(len(rows), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (flat.take(self.column.take(node) * n + rows) > self.cut.take(node))
        return node - (2**depth - 1)


def in_tasks(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The rows in no more tasks than they are worth, as each pass starts them all, and whether these are too many for the driver to add up."""
    tasks = rows.rdd.getNumPartitions()
    worth = -(-rows.schema["label"].metadata["rows"] // LEAST_ROWS)
    return (rows.coalesce(worth) if worth < tasks else rows), min(tasks, worth) > PARTS


def summed(rows: DataFrame, many: bool, count, size: int) -> np.ndarray:
    """The sum of what count(batches) gives in each task, `size` doubles; many: there are too many tasks for the driver to add up."""
    def each(batches):
        yield pa.RecordBatch.from_arrays([pa.array([count(batches).tobytes()], pa.binary())], ["total"])

    def together(batches):
        total = np.zeros(size)
        for b in batches:
            for x in b.column("total"):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    with few_blocks(rows.sparkSession):
        parts = rows.mapInArrow(each, "total binary")
        if many:
            parts = parts.repartition(TOGETHER).mapInArrow(together, "total binary")
        total = np.zeros(size)
        for r in parts.collect():
            total += np.frombuffer(r["total"])
    return total


class Forest:
    """A fitted forest: trees, and how much they need each column (shares of the gains, by tree, then over all)."""

    def __init__(self, trees: list[Tree], columns: int):
        self.trees, total = trees, np.zeros(columns)
        for t in trees:
            gains = np.bincount(t.column, t.gain, columns)
            total += gains / (gains.sum() or 1.0)
        self.featureImportances = total / (total.sum() or 1.0)

    def probability(self, flat: np.ndarray, n: int) -> np.ndarray:
        """Of class 1."""
        rows = np.arange(n)
        return sum(t.leaves(lambda s: s[1] / s.sum()).take(t.places(flat, n, rows, t.depth)) for t in self.trees) / len(self.trees)


def grow_forest(rows: DataFrame, columns: list[str], trees: int, depth: int, seed: int) -> Forest:
    """Trees on bags of the rows; each node is split at the largest gain of Gini impurity among the bins of some columns that are drawn for it."""
    classes, width = rows.schema["label"].metadata["classes"], len(columns)
    tried = width if trees == 1 else int(np.ceil(np.sqrt(width)))
    grown = [Tree(depth, classes) for _ in range(trees)]
    rows, many = in_tasks(rows)
    for level in range(depth):
        first, nodes = 2**level - 1, 2**level
        drawn = np.array([[np.random.default_rng([seed, t, first + i]).permutation(width)[:tried] for i in range(nodes)] for t in range(trees)])
        size = nodes * tried * BINS * classes

        def count(batches, level=level, drawn=drawn, size=size):
            total = np.zeros((trees, size))
            for b, i, n, flat in blocks(batches, columns):
                y = numbers(b, "label", i).astype(np.int64)
                for t, times in enumerate(bags(numbers(b, "draw", i, np.uint64), trees, seed)):
                    inside = np.flatnonzero(times)
                    node, weight, label = grown[t].places(flat, n, inside, level), times.take(inside).astype(float), y.take(inside)
                    for k in range(tried):
                        bin_ = flat.take(drawn[t, :, k].take(node) * n + inside)
                        total[t] += np.bincount(((node * tried + k) * BINS + bin_) * classes + label, weight, size)
            return total.ravel()

        total = summed(rows, many, count, trees * size).reshape(trees, nodes, tried, BINS, classes)
        for t, tree in enumerate(grown):
            now, tree.open = tree.open, []
            for i in now:
                counts = total[t, i - first]
                tree.stats[i] = whole = counts[0].sum(0)
                left = counts.cumsum(1)[:, :-1]
                right, n = whole - left, whole.sum()
                nl, nr = left.sum(2), right.sum(2)
                pure = lambda c, m: (c**2).sum(-1) / np.maximum(m, 1)
                gain = np.where((nl >= 1) & (nr >= 1), pure(left, nl) + pure(right, nr) - pure(whole, n), -1)  # rows times the gain
                k, cut = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[k, cut] > LEAST_GAIN * n:
                    tree.split(i, drawn[t, i - first, k], cut, gain[k, cut], left[k, cut], right[k, cut])
        if not any(t.open for t in grown):
            break
    return Forest(grown, width)


class RandomForestClassifier(classification.RandomForestClassifier):
    """MLlib's forest, except that rows of `binned` are learned from here."""

    def fit(self, df: DataFrame):
        if "draw" not in df.columns:
            return super().fit(df)
        return grow_forest(df, [c for c in df.columns if c not in ("label", "draw")], self.getNumTrees(), self.getMaxDepth(), self.getSeed())


class Boosted:
    """Fitted boosted trees."""

    def __init__(self, trees: list[Tree], step: float):
        self.trees, self.steps = trees, [1.0, *(len(trees) - 1) * [step]]

    def probability(self, flat: np.ndarray, n: int) -> np.ndarray:
        rows = np.arange(n)
        return 1 / (1 + np.exp(-2 * sum(w * t.leaves(mean).take(t.places(flat, n, rows, t.depth)) for w, t in zip(self.steps, self.trees))))


def mean(stats: np.ndarray) -> float:
    return stats[0] / max(stats[1], 1.0)


def boost(rows: DataFrame, columns: list[str], rounds: int, depth: int = DEPTH, step: float = 0.1) -> Boosted:
    """Regression trees on the labels (-1 and 1), then on the slopes of the log loss; each row's sum so far is stored after each tree."""
    if rows.schema["label"].metadata["classes"] != 2:
        raise ValueError("boosted trees are for labels of 0 and 1")
    session, width, grown, spent = rows.sparkSession, len(columns), [], []
    rows, many = in_tasks(rows)
    rows = rows.select(*columns, "label", F.lit(bytearray()).alias("margin"))
    for turn in range(rounds):
        tree = Tree(depth, 2)
        for level in range(depth):
            first, size = 2**level - 1, 2**level * BINS

            def count(batches, level=level, size=size, tree=tree, turn=turn):
                total = np.zeros((2, width, size))
                for b, i, n, flat in blocks(batches, columns):
                    y = numbers(b, "label", i) * 2.0 - 1
                    target = 4 * y / (1 + np.exp(2 * y * numbers(b, "margin", i, float))) if turn else y
                    node = tree.places(flat, n, np.arange(n), level) * BINS
                    for k in range(width):
                        cell = node + flat[k * n : (k + 1) * n]
                        total[0, k] += np.bincount(cell, target, size)
                        total[1, k] += np.bincount(cell, minlength=size)
                return total.ravel()

            total = summed(rows, many, count, 2 * width * size).reshape(2, width, 2**level, BINS)
            now, tree.open = tree.open, []
            for i in now:
                sums = total[:, :, i - first]
                whole = tree.stats[i] = sums[:, 0].sum(1)
                left = sums.cumsum(2)[:, :, :-1]
                right = whole[:, None, None] - left
                square = lambda s: s[0] ** 2 / np.maximum(s[1], 1)
                gain = np.where((left[1] >= 1) & (right[1] >= 1), square(left) + square(right) - square(whole), -1)
                k, cut = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[k, cut] > LEAST_GAIN * whole[1]:
                    tree.split(i, k, cut, gain[k, cut], left[:, k, cut], right[:, k, cut])
            if not tree.open:
                break
        grown.append(tree)
        if turn < rounds - 1:
            values = tree.leaves(mean) * (step if turn else 1.0)

            def add(batches, tree=tree, values=values, turn=turn):
                for b, i, n, flat in blocks(batches, columns):
                    margin = values.take(tree.places(flat, n, np.arange(n), depth)) + (numbers(b, "margin", i, float) if turn else 0.0)
                    one = b.slice(i, 1)
                    yield one.set_column(one.num_columns - 1, "margin", pa.array([margin.tobytes()], pa.binary()))

            path = new_path(session, "margins")
            with few_blocks(session):
                rows.mapInArrow(add, rows.schema).write.option("compression", "zstd").parquet(path)
            rows = session.read.schema(rows.schema).parquet(path)
            remove(session, spent)
            spent = [path]
    remove(session, spent)
    return Boosted(grown, step)
