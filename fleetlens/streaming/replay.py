"""Stored rows played to a stream in the order of their arrival, slice by slice, over many micro-batches and restarts.

`arrivals` gives rows a slice: equal spans of arrival time, which is event time and a delay. A `Replay` holds the slices and
hands them out one at a time; each is read by a run of the query of its own, which begins from the checkpoint of the one
before. So state, watermarks and timers are carried over restarts, and what is late is late by the slices.

The rules by slices, for SQL that gives the same rows: the mark after a slice is the newest event time (in ms) of all slices
up to it less the watermark's delay. Rows not newer than the mark before their slice are late; windows that end at or before
it are closed to the slice's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..folders import new_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(rows: DataFrame, slices: int, delay_s: Column) -> DataFrame:
    """The rows with the slice in which they arrive; delay_s: whole seconds from the event (ts) to its arrival. Without ts a row never does."""
    rows = rows.filter(F.col("ts").isNotNull())
    arrived = F.unix_micros(F.col("ts").cast("timestamp")) + delay_s.cast("long") * 1_000_000
    low, high = rows.agg(F.min(arrived), F.max(arrived)).first()
    if low is None:
        return rows.withColumn("slice", F.lit(0))
    return rows.withColumn("arrived_us", arrived).withColumn("slice", F.expr(f"CAST((arrived_us - {low}) * {slices} DIV {high - low + 1} AS INT)")).drop("arrived_us")


class Replay:
    """Rows (with a column `slice`) as a stream that gets one slice more at each `feed`. A slice may have many files."""

    def __init__(self, rows: DataFrame):
        self.spark: SparkSession = rows.sparkSession
        base = new_path(self.spark, "replay")
        self.held, self.inbox = f"{base}/held", f"{base}/inbox"
        rows.write.partitionBy("slice").parquet(self.held)
        self.schema = rows.drop("slice").schema
        self._fs("mkdirs", self.inbox)
        self.slices = sorted(int(r[0]) for r in rows.select("slice").distinct().collect())  # a number for each slice

    def _fs(self, call: str, *paths: str) -> None:
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        files = [jvm.Path(p) for p in paths]
        getattr(files[0].getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), call)(*files)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).parquet(self.inbox)

    def feed(self, k: int) -> None:
        if k in self.slices:
            self._fs("rename", f"{self.held}/slice={k}", f"{self.inbox}/{k}")


class Run:
    """A query over replays: what it wrote, and the progress of each slice."""

    def __init__(self, out: DataFrame, progress: dict[int, list[dict]]):
        self.out, self.progress = out, progress

    def total(self, k: int, figure: str) -> int:
        """A figure of the state operators (such as numRowsDroppedByWatermark), summed over a slice's batches."""
        return sum(int(op[figure]) for p in self.progress[k] for op in p["stateOperators"])

    def last(self, k: int, figure: str) -> int:
        """The figure after a slice's last batch."""
        return sum(int(op[figure]) for op in self.progress[k][-1]["stateOperators"]) if self.progress[k] else 0


def play(replays: list[Replay], build: Callable[..., DataFrame], mode: str = "append", partitions: int | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> Run:
    """Run build(*streams) slice by slice over the replays, which are fed together; each slice is a query started anew.

    Rows of append mode are Parquet files; those of update mode have the number of their batch beside them. sink: gets the
    micro-batches instead (then there is no output). partitions: of the state, fixed by the first slice.
    """
    spark = replays[0].spark
    base = new_path(spark, "played")
    out, checkpoint = f"{base}/out", f"{base}/checkpoint"
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    progress, schema = {}, None

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        spark.conf.set("spark.sql.shuffle.partitions", partitions or spark.sparkContext.defaultParallelism)
        for k in sorted({k for r in replays for k in r.slices}):
            for r in replays:
                r.feed(k)
            df = build(*(r.stream() for r in replays))
            writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
            if sink or mode != "append":
                writer, schema = writer.foreachBatch(sink or keep), df.withColumn("batch", F.lit(0)).schema
            else:
                writer, schema = writer.format("parquet").option("path", out), df.schema
            query: StreamingQuery = writer.start()
            query.awaitTermination()
            progress[k] = [p if isinstance(p, dict) else p.jsonValue for p in query.recentProgress]
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    written = None if sink else spark.read.schema(schema).parquet(out) if progress else spark.createDataFrame([], schema or "batch int")
    return Run(written, progress)
