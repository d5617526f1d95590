"""Windowed and joined stream operators. Each takes a streaming or a static DataFrame; on a static one it is its own batch twin.

Readings have vehicle_id, ts, speed_kmh, ...; trips have vehid, ts, vehicle_type, ... A watermark is set by with_event_time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fault_severity
from ..rules import CO2_KG_PER_LITRE, FUEL_PRICE

KINDS = ("speed_kmh", "engine_temperature_c")


def with_event_time(df: DataFrame, delay: str = "10 minutes", column: str = "ts") -> DataFrame:
    """Event time as a timestamp with a watermark: rows later than `delay` behind the newest are dropped by stateful operators."""
    typed = df.withColumn(column, F.col(column).cast("timestamp"))
    return typed.withWatermark(column, delay) if df.isStreaming else typed


def started(df: DataFrame) -> DataFrame:
    """The window as two plain timestamps, first."""
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), F.col("window.end").cast("timestamp_ntz").alias("window_end"), *rest)


def r6(x: Column) -> Column:
    return F.rint((x.cast("double") + 1.3e-9) * 1e6) / 1e6


def distinct(df: DataFrame, column: str) -> Column:
    """How many values a column has: approximate in the state of a stream, exact on a static frame."""
    return F.approx_count_distinct(column) if df.isStreaming else F.count_distinct(F.col(column))


def quantile(df: DataFrame, column: str, p: float | Column) -> Column:
    """A quantile: approximate (1 in 10,000 of rank) in the state of a stream, exact on a static frame."""
    return F.percentile_approx(column, p, 10000) if df.isStreaming else F.percentile(column, p)


def tumbling_fleet(trips: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Trips, distance, efficiency and faults by window and vehicle type."""
    return started(trips.groupBy(F.window("ts", size), "vehicle_type").agg(
        F.count(F.lit(1)).alias("trips"), r6(F.sum("trip_distance_km")).alias("distance_km"), r6(F.avg("fuel_efficiency_kmpl")).alias("avg_efficiency"), F.count_if("has_fault").alias("faults")))


def sliding_fleet(trips: DataFrame, size: str = "10 minutes", slide: str = "2 minutes") -> DataFrame:
    """Active vehicles (approximate on streams), mean and median speed by sliding window."""
    speed, names = F.avg("avg_speed_kmph"), ("active_vehicles", "avg_speed", "median_speed")
    if trips.isStreaming:
        found = trips.groupBy(F.window("ts", size, slide)).agg(distinct(trips, "vehid").alias(names[0]), r6(speed).alias(names[1]), r6(quantile(trips, "avg_speed_kmph", 0.5)).alias(names[2]))
        return started(found)
    # A trip is shuffled once, not once for each window. Spark's percentile compiles code for each group, and there are many
    # small ones: a window's group holds its vehicles and speeds instead, and the middle is taken.
    rows = by_span(trips.select("ts", "vehid", "avg_speed_kmph"), size, slide)
    found = rows.groupBy("span", "start").agg(F.size(F.collect_set("vehid")).cast("long").alias(names[0]), r6(speed).alias(names[1]), F.sort_array(F.collect_list(F.col("avg_speed_kmph").cast("double"))).alias("speeds"))
    middle = (F.get("speeds", F.floor((F.size("speeds") - 1) / 2).cast("int")) + F.get("speeds", F.floor(F.size("speeds") / 2).cast("int"))) / 2
    start = F.timestamp_micros("start")
    window = F.struct(start.alias("start"), (start + F.expr(f"INTERVAL {size}")).alias("end"))
    return started(found.select(window.alias("window"), *names[:2], r6(middle).alias(names[2])))


def by_span(rows: DataFrame, size: str, slide: str, spans: int = 24) -> DataFrame:
    """Static rows with the start of each window that holds them (epoch microseconds) and the windows' `span`: rows are dealt by span first, and opened up where they then are.

    A span is `spans` sizes long, and windows are of the span that they begin in; rows less than a size after a span's start may
    be of windows of the span before too, and are dealt to both. Groups by span and start need no further shuffle.
    """
    us = lambda length: F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {length}"))
    span = lambda start: F.floor(start / (us(size) * spans))
    at = F.unix_micros("ts")
    last = at - F.pmod(at, us(slide))
    first = last - F.floor((us(size) - 1 - (at - last)) / us(slide)) * us(slide)
    dealt = rows.filter(first <= last).withColumn("span", F.explode(F.array_distinct(F.array(span(first), span(last))))).repartition("span")
    return dealt.withColumn("start", F.explode(F.sequence(first, last, us(slide)))).filter(span(F.col("start")) == F.col("span"))


def trip_sessions(readings: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Sessions of a vehicle that end with a pause; append mode only on streams."""
    out = readings.groupBy(F.session_window("ts", gap).alias("window"), "vehicle_id").agg(F.count(F.lit(1)).alias("readings"), r6(F.avg("speed_kmh")).alias("avg_speed"), F.max("speed_kmh").alias("max_speed"))
    return started(out)


def minute_rates(readings: DataFrame) -> DataFrame:
    """Readings a minute by kind of event."""
    return started(readings.groupBy(F.window("ts", "1 minute"), "event_type").agg(F.count(F.lit(1)).alias("readings")))


def vehicle_agg(readings: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Eleven figures of a vehicle and window, with its last place."""
    return started(readings.groupBy(F.window("ts", size), "vehicle_id").agg(
        F.count(F.lit(1)).alias("readings"), r6(F.avg("speed_kmh")).alias("avg_speed"), F.max("speed_kmh").alias("max_speed"), F.min("speed_kmh").alias("min_speed"), r6(F.stddev_samp("speed_kmh")).alias("speed_stddev"),
        r6(F.avg("engine_temperature_c")).alias("avg_temperature"), F.max("engine_temperature_c").alias("max_temperature"), r6(F.avg("fuel_level_percent")).alias("avg_fuel"), r6(F.avg("battery_voltage")).alias("avg_voltage"),
        F.max_by("latitude", F.struct("ts", "event_id")).alias("last_latitude"), F.max_by("longitude", F.struct("ts", "event_id")).alias("last_longitude")))


def fleet_agg(readings: DataFrame, size: str = "1 minute") -> DataFrame:
    """Fleet figures by minute; `fleet_details` gives the readings behind them."""
    return started(readings.groupBy(F.window("ts", size)).agg(distinct(readings, "vehicle_id").alias("vehicles"), F.count(F.lit(1)).alias("readings"), r6(F.avg("speed_kmh")).alias("avg_speed")))


def fleet_details(readings: DataFrame, size: str = "1 minute") -> DataFrame:
    """Each reading under its window: rows, so that a minute's readings are never gathered in one row or in state."""
    return started(readings.select(F.window("ts", size), "vehicle_id", "event_id", "speed_kmh"))


def efficiency_monitor(trips: DataFrame, size: str = "10 minutes", slide: str = "5 minutes") -> DataFrame:
    """Quartiles of efficiency by type and sliding window, and their range."""
    q = lambda p: quantile(trips, "fuel_efficiency_kmpl", p)
    return started(trips.groupBy(F.window("ts", size, slide), "vehicle_type").agg(r6(q(0.25)).alias("q1"), r6(q(0.5)).alias("median"), r6(q(0.75)).alias("q3"), r6(q(0.75) - q(0.25)).alias("iqr")))


def cost_savings_stream(trips: DataFrame, size: str = "15 minutes") -> DataFrame:
    """Fuel cost of a vehicle and window, and what better driving and less idling would save."""
    fuel = F.col("fuel_consumed_l") * FUEL_PRICE
    return started(trips.groupBy(F.window("ts", size), "vehid").agg(
        r6(F.sum(fuel)).alias("fuel_cost"), r6(F.sum(F.when(F.col("driver_behavior_score") < 0.8, fuel * 0.1).otherwise(0.0))).alias("driving_savings"), r6(F.sum(F.when(F.col("idle_time_min") > 10, F.col("idle_time_min") / 60 * 0.5 * FUEL_PRICE).otherwise(0.0))).alias("idle_savings")))


def metric_agg(readings: DataFrame, metrics=KINDS, size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Count, mean, extremes, deviation and percentiles of each metric, in long form, by vehicle and sliding window."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics)))
    long = readings.select("ts", "vehicle_id", pairs.alias("m")).select("ts", "vehicle_id", "m.metric", "m.value")
    out = started(long.groupBy(F.window("ts", size, slide), "vehicle_id", "metric").agg(
        F.count("value").alias("n"), r6(F.avg("value")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), r6(F.stddev_pop("value")).alias("std"), quantile(readings, "value", F.array(F.lit(0.5), F.lit(0.95))).alias("q")))
    return out.withColumns({"median": r6(F.get("q", F.lit(0))), "p95": r6(F.get("q", F.lit(1)))}).drop("q")


def driving_patterns(readings: DataFrame, long: tuple[str, str] = ("30 seconds", "10 seconds"), short: tuple[str, str] = ("10 seconds", "5 seconds")) -> DataFrame:
    """Harsh braking and rapid acceleration in long windows, sharp cornering in short ones."""
    spread = F.max("speed_kmh") - F.min("speed_kmh")

    def pattern(name: str, size: str, slide: str, figures: dict[str, Column], test: Column) -> DataFrame:
        out = readings.groupBy(F.window("ts", size, slide), "vehicle_id").agg(*(v.alias(k) for k, v in figures.items())).filter(test)
        return started(out).withColumn("pattern", F.lit(name))

    speed = {"low": F.min("speed_kmh"), "high": F.max("speed_kmh"), "change": spread, "acceleration": r6(F.avg("acceleration_x"))}
    side = {"acceleration": r6(F.avg("acceleration_y")), "spread": r6(F.stddev_samp("acceleration_y")), "speed": r6(F.avg("speed_kmh"))}
    return (
        pattern("harsh_braking", *long, speed, (F.col("change") > 20) & (F.col("acceleration") < -2))
        .unionByName(pattern("rapid_acceleration", *long, speed, (F.col("change") > 30) & (F.col("acceleration") > 3)))
        .unionByName(pattern("sharp_cornering", *short, side, (F.abs("acceleration") > 2) & (F.col("spread") > 1) & (F.col("speed") > 40)), allowMissingColumns=True)
    )


def enrich_stream(stream: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Each event with its vehicle's master data, where there is one. Spark broadcasts the static side if it is small."""
    static = vehicles.select("vehid", "engine_type", "is_turbo", "weight_category", "displacement_l")
    return stream.join(static, "vehid", "left")


def fault_join(telemetry: DataFrame, faults: DataFrame, within: str = "5 minutes") -> DataFrame:
    """Readings and faults of a vehicle, the fault up to `within` after the reading. Both sides need watermarks on streams."""
    t = telemetry.select(F.col("vehicle_id"), F.col("event_id").alias("reading_id"), F.col("ts").alias("reading_ts"), "speed_kmh")
    f = faults.select(F.col("vehicle_id").alias("fault_vehicle"), F.col("event_id").alias("fault_id"), F.col("ts").alias("fault_ts"))
    after = (F.col("fault_ts") >= F.col("reading_ts")) & (F.col("fault_ts") <= F.col("reading_ts") + F.expr(f"INTERVAL {within}"))
    return t.join(f, (F.col("vehicle_id") == F.col("fault_vehicle")) & after).drop("fault_vehicle")


def stream_metrics(trips: DataFrame) -> DataFrame:
    """Fault severity, CO2, cost by kilometre and score of each trip; trips must have engine_type."""
    factor = F.create_map(*(F.lit(x) for kv in CO2_KG_PER_LITRE.items() for x in kv))
    return trips.withColumns({
        "fault_severity": fault_severity(F.split("fault_codes", ",")),
        "co2_kg": r6(F.col("fuel_consumed_l") * F.coalesce(F.try_element_at(factor, F.col("engine_type")), F.lit(2.31))),
        "cost_per_km": r6(F.try_divide(F.col("fuel_consumed_l") * FUEL_PRICE, F.col("trip_distance_km"))),
        "trip_score": r6(F.col("driver_behavior_score") * 100 - F.col("has_fault").cast("int") * 10),
    })


def message_stats(readings: DataFrame) -> DataFrame:
    """Messages, last time, total and top speed of each vehicle, and ratios; update mode on streams."""
    return readings.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("messages"), F.max("ts").cast("timestamp_ntz").alias("last_seen"), r6(F.sum("speed_kmh")).alias("total_speed"), F.max("speed_kmh").alias("max_speed"), r6(F.avg(F.try_divide("speed_kmh", "rpm"))).alias("speed_rpm_ratio"), r6(F.max("engine_temperature_c") - F.min("engine_temperature_c")).alias("temperature_range"))


def live_kpis(readings: DataFrame) -> DataFrame:
    """One row of live figures; update or complete mode on streams."""
    return readings.groupBy().agg(distinct(readings, "vehicle_id").alias("active_vehicles"), F.count(F.lit(1)).alias("messages"), r6(F.avg("speed_kmh")).alias("avg_speed"), r6(F.avg("fuel_level_percent")).alias("avg_fuel"), F.count_if(F.col("event_type") == "error").alias("faults"), F.count_if(F.col("engine_temperature_c") > 110).alias("alerts"))


def latest_by_vehicle(readings: DataFrame) -> DataFrame:
    """The newest reading of each vehicle."""
    newest = F.max_by(F.struct("event_id", "speed_kmh", "engine_temperature_c"), F.struct("ts", "event_id"))
    return readings.groupBy("vehicle_id").agg(F.max("ts").cast("timestamp_ntz").alias("ts"), newest.alias("r")).select("vehicle_id", "ts", "r.*")


def last_n_by_vehicle(readings: DataFrame, n: int = 50) -> DataFrame:
    """The newest n readings of each vehicle (static frames)."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("vehicle_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return readings.withColumn("nth", nth).filter(F.col("nth") <= n)
