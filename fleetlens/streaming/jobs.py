"""Stream sources, sinks, and a runner of several queries by configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery


def file_stream(spark: SparkSession, folder: str, schema, name: str = "*", files_per_trigger: int | None = 1) -> DataFrame:
    """Parquet files of a folder as a stream; None: all that are there in one batch, so that the order of files does not matter."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(folder)


def rate_stream(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def kafka_options(reader, servers: str, topics: str, offsets_per_trigger: int):
    return reader.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": "latest", "failOnDataLoss": "false", "maxOffsetsPerTrigger": str(offsets_per_trigger)})


def kafka_json_stream(spark: SparkSession, servers: str, topics: str, schema, offsets_per_trigger: int = 10_000) -> DataFrame:
    """JSON messages of topics; needs the Kafka connector on the classpath."""
    raw = kafka_options(spark.readStream, servers, topics, offsets_per_trigger).load()
    return decode_payload(raw, "json", schema)


def kafka_avro_stream(spark: SparkSession, servers: str, topics: str, avro_schema: str, offsets_per_trigger: int = 10_000) -> DataFrame:
    """Avro messages of topics (avro_schema: its JSON), with key, partition and offset; needs the Kafka and Avro connectors."""
    from pyspark.sql.avro.functions import from_avro

    raw = kafka_options(spark.readStream, servers, topics, offsets_per_trigger).load()
    return raw.select(F.col("key").cast("string").alias("message_key"), "partition", "offset", from_avro("value", avro_schema).alias("m")).select("message_key", "partition", "offset", "m.*")


def decode_payload(df: DataFrame, kind: str, schema=None) -> DataFrame:
    """The `value` column as fields (json) or as text (plaintext)."""
    if kind == "json":
        return df.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
    if kind == "plaintext":
        return df.withColumn("value", F.col("value").cast("string"))
    raise ValueError(f"unknown format {kind}")


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None) -> StreamingQuery:
    """Rows as JSON messages, in update mode."""
    body = df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct("*")).alias("value"))
    return body.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).outputMode("update").start()


def to_table(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet files; windowed aggregates arrive when they are closed."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def read_agg(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, column: str = "window_start") -> DataFrame:
    """What to_table wrote, in a range of time."""
    df = spark.read.parquet(path)
    if start:
        df = df.filter(F.col(column) >= F.lit(start).cast(df.schema[column].dataType))
    return df.filter(F.col(column) < F.lit(end).cast(df.schema[column].dataType)) if end else df


def to_console(df: DataFrame, mode: str = "update") -> StreamingQuery:
    return df.writeStream.format("console").outputMode(mode).option("truncate", False).start()


def to_memory(df: DataFrame, name: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Progress(StreamingQueryListener):
    """What Spark tells of each query by name, as it happens: batches, rows, the slowest batch, late rows, state rows, and its end."""

    def __init__(self):
        self.queries: dict[str, dict] = {}
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or str(event.id)
        self.queries[self.names[str(event.runId)]] = {"active": True, "batches": 0, "input_rows": 0, "slowest_ms": 0, "late_rows": 0, "state_rows": 0, "error": None}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        q = self.queries.get(self.names.get(str(p.runId), ""))
        if q:
            q["batches"] += 1
            q["input_rows"] += p.numInputRows
            q["slowest_ms"] = max(q["slowest_ms"], p.durationMs.get("triggerExecution", 0))
            q["late_rows"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            q["state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        q = self.queries.get(self.names.get(str(event.runId), ""))
        if q:
            q["active"], q["error"] = False, event.exception


@dataclass
class StreamJob:
    """Several named queries: each a builder of a DataFrame and a starter of its sink."""

    builders: dict[str, tuple[Callable[[], DataFrame], Callable[[DataFrame], StreamingQuery]]]
    running: dict[str, StreamingQuery] = field(default_factory=dict)

    def start(self, *names: str) -> StreamJob:
        for name in names or self.builders:
            build, sink = self.builders[name]
            self.running[name] = sink(build())
        return self

    def status(self) -> dict[str, dict]:
        """Progress of each query: whether it runs, batches, input rows and rate, and its error."""
        out = {}
        for name, q in self.running.items():
            last = q.lastProgress or {}
            out[name] = {"active": q.isActive, "batch": last.get("batchId"), "input_rows": last.get("numInputRows"), "rows_per_second": last.get("processedRowsPerSecond"), "error": str(q.exception()) if q.exception() else None}
        return out

    def wait(self, seconds: float | None = None) -> StreamJob:
        for q in self.running.values():
            q.awaitTermination(seconds) if seconds else q.awaitTermination()
        return self

    def stop(self) -> None:
        for q in self.running.values():
            if q.isActive:
                q.stop()
