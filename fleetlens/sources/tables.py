"""Loading, storing and changing fleet tables. Tables are Parquet folders; changes rewrite the partitions that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import SENTINEL, standardize_columns


def read_vehicles(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Master data from CSV: names in lower case with underscores, the sentinel as null."""
    reader = spark.read.option("header", True).option("nullValue", SENTINEL)
    return standardize_columns((reader.schema(schema) if schema else reader).csv(path))


def read_telemetry(spark: SparkSession, path: str, schema=None, column: str = "timestamp", form: str | None = None) -> DataFrame:
    """Trips or readings from CSV or Parquet, with the time parsed; a time that is none becomes null."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
    else:
        df = spark.read.parquet(path)
    if dict(df.dtypes).get(column) == "string":
        df = df.withColumn(column, F.try_to_timestamp(column, F.lit(form)) if form else F.try_to_timestamp(column))
    return df


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options) -> DataFrame:
    """A table or query over JDBC, read in parts by a number column if there is one."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    """Write to a table over JDBC, 1000 rows at a time (mode: append, overwrite or error)."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", 1000).options(**options).mode(mode).save()


def upsert_daily(daily: DataFrame, path: str, day_column: str = "aggregation_date") -> None:
    """Put days into the daily table: their partitions are replaced, other days stay; running it twice changes nothing."""
    stamped = daily.withColumn("updated_at", F.current_timestamp())
    stamped.repartition(day_column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_column).parquet(path)


def insert_rows(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def rewrite(spark: SparkSession, path: str, target: str, change) -> DataFrame:
    """change(the table at path) as a new table at target: a table is not overwritten while it is read."""
    change(spark.read.parquet(path)).write.mode("error").parquet(target)
    return spark.read.parquet(target)


def update_status(spark: SparkSession, path: str, target: str, where: Column, status: str) -> DataFrame:
    """Rows that meet `where` get the status and the time of the change."""
    return rewrite(spark, path, target, lambda df: df.withColumns({"updated_at": F.when(where, F.current_timestamp()), "status": F.when(where, F.lit(status)).otherwise(F.col("status"))}))


def delete_rows(spark: SparkSession, path: str, target: str, where: Column) -> DataFrame:
    return rewrite(spark, path, target, lambda df: df.filter(~F.coalesce(where, F.lit(False))))


def delete_older(spark: SparkSession, path: str, target: str, column: str, as_of: str, days: int) -> DataFrame:
    """Retention: rows older than so many days before as_of go."""
    return delete_rows(spark, path, target, F.col(column) < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def refresh(views: dict[str, DataFrame], folder: str) -> None:
    """Store views again as tables (overwriting what was stored before)."""
    for name, df in views.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, type, nullable, row_count of all columns of the tables."""
    spark = next(iter(tables.values())).sparkSession
    columns = [(t, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for f in df.schema.fields]
    counts = None
    for t, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return spark.createDataFrame(columns, "table_name string, column_name string, type string, nullable boolean").join(counts, "table_name")


def export_bi_extract(telemetry: DataFrame, vehicles: DataFrame, path: str) -> None:
    """Trips with their vehicle's columns, as CSV with a header."""
    shared = [c for c in vehicles.columns if c != "vehid" and c in telemetry.columns]
    telemetry.join(vehicles.drop(*shared), "vehid", "left").write.mode("overwrite").option("header", True).csv(path)


def export_marts(marts: dict[str, DataFrame], folder: str, form: str = "json") -> None:
    """Dashboard data, a folder for each mart, as JSON lines or CSV."""
    for name, df in marts.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if form == "csv" else writer.json)(f"{folder}/{name}")
