"""Marts of trips that are kept up to date by the days that changed: mergeable states of a day, merged when they are read.

`vehicle_days` has a row for each day and vehicle (counts, sums, latest trip); `type_days` one for each day and vehicle type,
with sketches (HLL of vehicles, KLL of efficiency) for spans of days. Both are partitioned by day. `update` computes the
states of the given days anew, from trips of these days only, and replaces their partitions; the rest is not read or written.
Sums, counts and extremes are those of a full refresh; distinct vehicles of a span are within HLL's error (about 2 percent at
LG_K 12), and quantiles within 2 percent of rank.

Defined results: trips without a time or vehicle are in no state; a day that has no trips any more loses its partition; a
missing efficiency or score counts in no mean; an empty mart gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import remove, write_shared

LG_K = 12
VEHICLE_DAYS = "day date, vehid int, vehicle_type string, trips long, km double, fuel_l double, efficiency double, efficiencies long, faults long, flags long, score double, scores long, latest timestamp_ntz"
TYPE_DAYS = "day date, vehicle_type string, trips long, vehicles binary, efficiency binary"


def r(x: Column, digits: int) -> Column:
    return F.rint((x + F.lit(1.3 / 10 ** (digits + 3))) * 10**digits) / 10**digits


class Marts:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str, first: date | None = None, last: date | None = None) -> DataFrame:
        """A table's states of first..last; partitions outside are not read."""
        schema = {"vehicle_days": VEHICLE_DAYS, "type_days": TYPE_DAYS}[name]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        df = df if first is None else df.filter(F.col("day") >= F.lit(first))
        return df if last is None else df.filter(F.col("day") <= F.lit(last))

    def update(self, trips: DataFrame, days: Iterable[date]) -> None:
        """Replace the states of these days by those of the trips on them."""
        days = sorted(set(days))
        if not days:
            return
        day = F.col("ts").cast("date")
        rows = trips.filter(day.isin(days) & F.col("vehid").isNotNull() & day.between(days[0], days[-1]))
        if "shipped" in trips.columns:  # the stored date that a trip's time lies within a day of: it reaches the scan
            rows = rows.filter(F.col("shipped").between(days[0] - timedelta(days=1), days[-1] + timedelta(days=1)))
        states = rows.groupBy(day.alias("day"), "vehid", "vehicle_type").agg(
            F.count(F.lit(1)).alias("trips"), F.sum("trip_distance_km").alias("km"), F.sum("fuel_consumed_l").alias("fuel_l"), F.sum("fuel_efficiency_kmpl").alias("efficiency"), F.count("fuel_efficiency_kmpl").alias("efficiencies"),
            F.count_if("has_fault").alias("faults"), F.count_if("maintenance_flag").alias("flags"), F.sum("driver_behavior_score").alias("score"), F.count("driver_behavior_score").alias("scores"), F.max("ts").alias("latest"))
        sketches = rows.groupBy(day.alias("day"), "vehicle_type").agg(
            F.count(F.lit(1)).alias("trips"), F.hll_sketch_agg(F.col("vehid").cast("long"), LG_K).alias("vehicles"), F.kll_sketch_agg_double(F.col("fuel_efficiency_kmpl").cast("double")).alias("efficiency"))
        for name, df in (("vehicle_days", states), ("type_days", sketches)):
            self.replace(name, write_shared(df, name), days)

    def replace(self, name: str, df: DataFrame, days: list[date]) -> None:
        left = {x["day"] for x in df.select("day").distinct().collect()}  # the days that were given
        df.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.folder}/{name}")
        remove(self.spark, [f"{self.folder}/{name}/day={d}" for d in days if d not in left])

    def vehicle_performance(self, vehicles: DataFrame, as_of: date, days: int = 30) -> DataFrame:
        """`packaged.vehicle_performance` from states: every vehicle's days before as_of."""
        s = self.read("vehicle_days", as_of - timedelta(days=days), as_of - timedelta(days=1)).groupBy("vehid").agg(
            F.sum("trips").alias("n"), F.sum("km").alias("km"), F.try_divide(F.sum("efficiency"), F.sum("efficiencies")).alias("eff"), F.sum("faults").alias("f"), F.sum("flags").alias("m"), F.try_divide(F.sum("score"), F.sum("scores")).alias("score"), F.max("latest").alias("latest"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        return vehicles.join(s, "vehid", "left").select(
            "vehid", "vehicle_type", "vehicle_class", "engine_type", zero("n").alias("total_trips"), r(F.col("km"), 4).alias("total_distance_km"), r(F.col("eff"), 6).alias("avg_efficiency"),
            zero("f").alias("total_faults"), zero("m").alias("maintenance_alerts"), r(F.col("score"), 6).alias("avg_driver_score"), F.col("latest").alias("last_trip_date"))

    def fleet_efficiency_daily(self, as_of: date, days: int = 90) -> DataFrame:
        """`packaged.fleet_efficiency_daily` from states."""
        return self.read("vehicle_days", as_of - timedelta(days=days), as_of - timedelta(days=1)).groupBy("day", "vehicle_type").agg(
            F.count_distinct("vehid").alias("active_vehicles"), r(F.sum("km"), 4).alias("total_distance_km"), r(F.sum("fuel_l"), 4).alias("total_fuel_l"), r(F.try_divide(F.sum("efficiency"), F.sum("efficiencies")), 6).alias("avg_efficiency_kmpl"),
            F.sum("faults").alias("total_faults"), r(F.try_divide(F.sum("score"), F.sum("scores")), 6).alias("avg_driver_score"))

    def span(self, first: date, last: date, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
        """Trips, distinct vehicles (about) and quantiles of efficiency (about) of each type over first..last, from sketches."""
        merged = self.read("type_days", first, last).groupBy("vehicle_type").agg(F.sum("trips").alias("trips"), F.hll_sketch_estimate(F.hll_union_agg("vehicles")).alias("vehicles"), F.kll_merge_agg_double("efficiency").alias("k"))
        return merged.withColumn("efficiency_quantiles", F.kll_sketch_get_quantile_double("k", F.array(*(F.lit(p) for p in quantiles)))).drop("k")
