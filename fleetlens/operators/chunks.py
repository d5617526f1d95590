"""Windows over the rows of a key of any size, in chunks of equal numbers of rows, so that a hot vehicle is many tasks.

Every row gets its place in the order of its key: a count of the key's rows by slots of time, summed up over the slots before,
and the row's place in its slot. Places are cut into chunks of CHUNK rows. A window of rows that reaches `halo` rows back is
computed by chunk, with the last `halo` rows of the chunk before read along; sums over all rows before are sums within the
chunk and the sums of the chunks before. A task holds a slot or a chunk, whatever the share of the key; one key's table of
slots or chunks is its time span by SLOT_S, or its rows by CHUNK.

Windows of time, whose rows have no bound, are over a vehicle's seconds instead: the rows of a second are one row of sums before
anything is shuffled, and chunks are spans of SPAN_S seconds with the last `halo` seconds of the span before.

Results are those of the operators themselves, row for row. Rows without a key or time are a key and slot of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..folders import write_shared
from ..plans.dialect import SPARK, Op, bound, compilable
from . import analysis, enrichment, features

#: Rows of a chunk, seconds of a slot, and seconds of a chunk of time.
CHUNK, SLOT_S, SPAN_S = 1 << 18, 3600, 7 * 86400


def rounded(x):
    """To six places, as `Dialect.r6` does."""
    return F.rint(((F.col(x) if isinstance(x, str) else x) + 1.3e-9) * 1e6) / 1e6


def placed(rows: DataFrame, key: str, order: list[str], slot_s: int = SLOT_S) -> DataFrame:
    """The rows with `pos`, the row's number (from 0) in the order of its key; the order begins with ts."""
    slot = F.coalesce(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / slot_s), F.lit(-(1 << 62)))
    rows = rows.withColumn("slot", F.struct(F.col(key).alias("k"), slot.alias("s")))  # never null, so one shuffle does for places and join
    before = F.sum("n").over(Window.partitionBy("slot.k").orderBy("slot.s").rowsBetween(Window.unboundedPreceding, -1))
    slots = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).select("slot", F.coalesce(before, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("slot").orderBy(*order)) - 1
    out = rows.withColumn("inside", inside).join(slots, "slot")
    return out.withColumn("pos", F.col("ahead") + F.col("inside")).drop("slot", "inside", "ahead")


def chunked(rows: DataFrame, halo: int, chunk: int = CHUNK) -> DataFrame:
    """Placed rows with their chunk; the last `halo` rows of a chunk stand, marked as `halo`, in the next one too."""
    if halo > chunk:
        raise ValueError(f"a window of {halo} rows needs chunks of as many")
    own = F.floor(F.col("pos") / chunk)
    at = lambda c, h: F.struct(c.alias("chunk"), F.lit(h).alias("halo"))
    both = F.when(F.col("pos") % chunk >= chunk - halo, F.array(at(own, False), at(own + 1, True))).otherwise(F.array(at(own, False)))
    return rows.withColumn("c", F.explode(both)).select(*rows.columns, "c.*")


def in_chunks(op: Op, frame: DataFrame, name: str, key: str, order: str, halo: int, chunk: int = CHUNK, slot_s: int = SLOT_S, **given) -> DataFrame:
    """An operator whose windows over a key reach `halo` rows back at most, over the frame that it knows by that name.

    The operator's own text, with windows by chunk and place; its first column of the row's key is null for rows read along.
    """
    text, by = op.build(SPARK, **given), f"PARTITION BY {key} ORDER BY {order}"
    if by not in text or "UNBOUNDED" in text:
        raise ValueError(f"{op.key} has other windows")
    text = text.replace(by, f"PARTITION BY {key}, chunk ORDER BY pos")
    columns = [c.strip() for c in order.split(",")]
    mark = next(c for c in columns if c != "ts")
    rows = chunked(placed(frame, key, columns, slot_s), halo, chunk).withColumn(mark, F.when(~F.col("halo"), F.col(mark)))
    return compilable(frame.sparkSession).sql(bound(text, (name,)), **{name: rows}).filter(F.col(mark).isNotNull())


def rolling_features(readings: DataFrame, sizes=(5, 15, 30, 60), chunk: int = CHUNK, slot_s: int = SLOT_S) -> DataFrame:
    """`features.rolling_features`; readings have an event_id each."""
    return in_chunks(features.rolling_features, readings, "readings", "vehicle_id", "ts, event_id", max(sizes), chunk, slot_s, sizes=sizes)


def lag_features(readings: DataFrame, lags=(1, 2, 3, 5), chunk: int = CHUNK, slot_s: int = SLOT_S) -> DataFrame:
    """`features.lag_features`; readings have an event_id each."""
    return in_chunks(features.lag_features, readings, "readings", "vehicle_id", "ts, event_id", max(lags), chunk, slot_s, lags=lags)


def rolling_zscore(readings: DataFrame, size: int = 100, chunk: int = CHUNK, slot_s: int = SLOT_S, **given) -> DataFrame:
    """`features.rolling_zscore`; readings have an event_id each."""
    return in_chunks(features.rolling_zscore, readings, "readings", "vehicle_id", "ts, event_id", size, chunk, slot_s, size=size, **given)


def rolling_efficiency(telemetry: DataFrame, chunk: int = CHUNK, slot_s: int = SLOT_S) -> DataFrame:
    """`enrichment.rolling_efficiency`: the slope over ten trips does not change when trips are numbered by chunk."""
    return in_chunks(enrichment.rolling_efficiency, telemetry, "telemetry", "vehid", f"{enrichment.ORDER}, fuel_efficiency_kmpl", 9, chunk, slot_s)


def sessionize(readings: DataFrame, gap_s: int = 900, chunk: int = CHUNK, slot_s: int = SLOT_S) -> DataFrame:
    """`features.sessionize`: beginnings of sessions are counted by chunk, and what chunks before have is added."""
    by = Window.partitionBy("vehicle_id", "chunk").orderBy("pos")
    pause = F.timestamp_diff("SECOND", F.lag("ts").over(by), F.col("ts"))
    rows = chunked(placed(readings, "vehicle_id", ["ts", "event_id"], slot_s), 1, chunk)
    rows = rows.withColumn("begins", F.when(pause <= gap_s, 0).otherwise(1)).filter("not halo")
    counted = rows.groupBy(F.col("vehicle_id").alias("v"), F.col("chunk").alias("c")).agg(F.sum("begins").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("v").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("begins").over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("within", within).join(counted.select("v", "c", before.alias("ahead")), F.col("vehicle_id").eqNullSafe(F.col("v")) & (F.col("chunk") == F.col("c")))
    return rows.groupBy("vehicle_id", (F.col("ahead") + F.col("within")).alias("session")).agg(
        F.count(F.lit(1)).alias("readings"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).alias("seconds"),
        rounded(F.avg("speed_kmh")).alias("avg_speed"), F.max("speed_kmh").alias("max_speed"), rounded(F.max("odometer_km") - F.min("odometer_km")).alias("distance_km"))


def maintenance_features(telemetry: DataFrame, vehicles: DataFrame, chunk: int = CHUNK, slot_s: int = SLOT_S) -> DataFrame:
    """`analysis.maintenance_features`: rows are stored with their mean, and a vehicle's first mean, from which it degrades, is found among them."""
    by, halo = "vehid, chunk", max(n for _, _, n, _ in analysis.M1.values()) - 1
    rows = chunked(placed(telemetry, "vehid", [*enrichment.ORDER.split(", "), analysis.EFF], slot_s), halo, chunk)
    base = analysis.maintenance_base(SPARK, "CAST(t.pos + 1 AS INT)", by)
    text = analysis.maintenance_text(SPARK, base, "CAST(NULL AS DOUBLE)", by, ", ma, halo")
    found = compilable(telemetry.sparkSession).sql(bound(text, ("telemetry", "vehicles")), telemetry=rows, vehicles=vehicles)
    stored = write_shared(found.filter("not halo").drop("halo"), "chunks")
    firsts = write_shared(stored.groupBy("vehid").agg(F.min_by("ma", F.when(F.col("ma").isNotNull(), F.col("nth"))).alias("first_ma")), "firsts")
    loss = F.expr(SPARK.r6("(first_ma - ma) / first_ma * 100"))
    return stored.join(firsts, "vehid", "left").withColumn("efficiency_degradation", loss).select(*(c for c in stored.columns if c != "ma"))


def rollup_over_time(readings: DataFrame, span_s: int = SPAN_S) -> DataFrame:
    """`features.rollup_over_time`: roll-ups of a vehicle's seconds by spans of time, then of each reading by its second."""
    short, day = features.ROLLUP_S
    if day > span_s:
        raise ValueError(f"a window of {day} seconds needs spans of as many")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    speed, fuel = F.col("speed_kmh"), F.col("fuel_level_percent")
    seconds = readings.groupBy(F.col("vehicle_id").alias("v"), at.alias("at_s")).agg(
        F.sum(speed).alias("speed"), F.count(speed).alias("speeds"), F.max(speed).alias("top"),
        F.sum(fuel).alias("fuel"), F.count(fuel).alias("fuels"), F.count_if(F.col("event_type") == "error").alias("faults"))
    own, into = F.floor(F.col("at_s") / span_s), F.pmod("at_s", F.lit(span_s))
    here = F.struct(own.alias("span"), F.lit(False).alias("halo"))
    both = F.when(into >= span_s - day, F.array(here, F.struct((own + 1).alias("span"), F.lit(True).alias("halo")))).otherwise(F.array(here))
    spans = seconds.withColumn("at_span", F.explode(both)).select("*", "at_span.*")
    within = lambda s: Window.partitionBy("v", "span").orderBy("at_s").rangeBetween(-s, 0)
    mean = lambda x, n, w: F.when(F.sum(n).over(w) > 0, F.sum(x).over(w) / F.sum(n).over(w))
    rolled = spans.select(
        "v", "at_s", "halo", mean("speed", "speeds", within(short)).alias("speed_avg"), F.max("top").over(within(short)).alias("speed_max"),
        mean("fuel", "fuels", within(day)).alias("fuel_avg"), F.sum("faults").over(within(day)).alias("errors"))
    found = readings.withColumn("second", at).join(rolled.filter("not halo"), F.col("vehicle_id").eqNullSafe(F.col("v")) & F.col("second").eqNullSafe(F.col("at_s")))
    return found.select(*features.ROW.split(", "), rounded("speed_avg").alias("speed_avg"), "speed_max", rounded("fuel_avg").alias("fuel_avg"), "errors")
