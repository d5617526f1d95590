"""Stream operators with state of their own by key. Each has a batch twin: the SQL of the same name over rows in order.

Micro-batches bring rows in any order. `InOrder` keeps a key's new rows in its state until the watermark has passed them,
and an event-time timeout then hands them over by (ts, event_id): so results do not depend on how rows fell into batches, and
are those of the batch twin over all rows that were not late. State is bounded by the watermark's delay, and by what an
operator carries from row to row. `vehicle_state` needs the RocksDB state store (`replay.ROCKS`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.features import SUSTAINED

#: Errors count as faults for so long.
FAULT_SECONDS = 300
#: Groups that vehicles share in ordered state; a checkpoint keeps the number that it began with.
BUCKETS = 1024


class InOrder:
    """Rows of a key in order, as the watermark passes them.

    FIELDS: columns of a row (type by name), `us` (event time in microseconds) and event_id among them. CARRIED: what is kept
    from row to row. `step` gets a row and what is carried, adds result rows, and gives back what to carry. `idle` gets what
    is carried when the watermark has passed its last row by `idle_ms`.

    Vehicles share BUCKETS groups by hash: a call of Python for each vehicle and batch costs far more than its few rows. A group's
    state holds, for each of its vehicles, the waiting rows and what is carried; it comes and goes with the group's batch.
    """

    FIELDS: dict[str, str] = {}
    CARRIED = ""
    OUT: dict[str, str] = {}
    #: Rows are handed over in whole units of time (milliseconds).
    grain_ms = 1
    idle_ms: int | None = None

    @classmethod
    def kept(cls) -> str:
        """The schema of a group's state."""
        inside = lambda fields: ", ".join(f"{k}: {v}" for k, v in fields)
        carried = inside(f.rsplit(" ", 1) for f in cls.CARRIED.split(", "))
        return f"vehicles array<struct<vehicle_id: long, waiting: array<struct<{inside(cls.FIELDS.items())}>>, carried: struct<{carried}>, last_us: long>>"

    def prepare(self, ready: list[tuple]) -> None:
        """A look at all rows that are handed over next."""

    def step(self, key: tuple, row: tuple, carried: tuple | None, out: list) -> tuple | None:
        raise NotImplementedError

    def idle(self, key: tuple, carried: tuple, out: list) -> tuple | None:
        return carried

    def due(self, us: int) -> int:
        """When a row's unit of time is over."""
        return (us // 1000 // self.grain_ms + 1) * self.grain_ms - 1

    def __call__(self, group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, out, kept, times = state.getCurrentWatermarkMs(), [], [], []
        vehicles = {v: ([tuple(r) for r in waiting], carried, last) for v, waiting, carried, last in (state.get[0] if state.exists else ())}
        for part in parts:
            for v, *row in zip(*(part[c].tolist() for c in ("vehicle_id", *self.FIELDS))):
                rows = vehicles.setdefault(None if v != v or v is None else int(v), ([], None, None))[0]
                rows.append(tuple(None if x != x else x for x in row))
        for v, (waiting, carried, last) in vehicles.items():
            waiting, carried, last = self.advance((v,), waiting, carried, last, mark, out)
            if waiting or carried is not None:
                kept.append((v, waiting, None if carried is None else tuple(carried), last))
            times += [self.due(r[self.at("us")]) for r in waiting]
            if carried is not None and self.idle_ms is not None:
                times.append(last // 1000 + self.idle_ms)
        if kept:
            state.update((kept,))
            if times:
                state.setTimeoutTimestamp(max(min(times), mark))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=list(self.OUT))

    def at(self, column: str) -> int:
        return list(self.FIELDS).index(column)

    def advance(self, key: tuple, waiting: list[tuple], carried: tuple | None, last: int | None, mark: int, out: list) -> tuple:
        """A vehicle's rows that the watermark has passed are handed over; what waits, what is carried, and the last row's time."""
        us, event = self.at("us"), self.at("event_id")
        ready = sorted((r for r in waiting if self.due(r[us]) < mark), key=lambda r: (r[us], r[event]))
        self.prepare(ready)
        for row in ready:
            carried = self.step(key, row, carried, out)
            last = row[us]
        if carried is not None and self.idle_ms is not None and last // 1000 + self.idle_ms < mark:
            carried = self.idle(key, carried, out)
        return [r for r in waiting if self.due(r[us]) >= mark], carried, last


def in_order(readings: DataFrame, kind: type[InOrder], *given, mode: str = "append") -> DataFrame:
    """The operator over a stream of readings by vehicle; readings need a watermark on ts. Columns in `us` come back as timestamps."""
    columns = [c for c in kind.FIELDS if c not in ("us", "vehicle_id")]
    bucket = F.pmod(F.xxhash64("vehicle_id"), F.lit(BUCKETS)).alias("bucket")
    rows = readings.select(bucket, "vehicle_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *columns)
    run = kind(*given)
    step = lambda key, parts, state: run(key, parts, state)
    out = rows.groupBy("bucket").applyInPandasWithState(step, ", ".join(f"{k} {v}" for k, v in kind.OUT.items()), kind.kept(), mode, GroupStateTimeout.EventTimeTimeout)
    times = {k: F.timestamp_micros(k).cast("timestamp_ntz") for k in kind.OUT if k.endswith("_us")}
    return out.select(*((times[k].alias(k.removesuffix("_us")) if k in times else k) for k in kind.OUT))


class Zscores(InOrder):
    FIELDS = {"us": "long", "event_id": "long", "speed_kmh": "double"}
    CARRIED = "history array<double>"
    OUT = {"vehicle_id": "long", "event_id": "long", "ts_us": "long", "value": "double", "z_score": "double", "anomaly_score": "double", "severity": "string"}

    def __init__(self, size: int, least: int, limit: float, include_current: bool):
        self.size, self.least, self.limit, self.include_current = size, least, limit, include_current

    def step(self, key, row, carried, out):
        us, event, value = row
        history = list(carried[0]) if carried else []
        past = ([*history, value] if self.include_current else history)[-self.size :]
        if len(past) >= self.least and (std := float(np.std(past))) > 0:
            z = abs(value - float(np.mean(past))) / std
            z = round(z + 1.3e-9, 6)
            if z > self.limit:
                out.append((key[0], event, us, value, z, min(1.0, round(z / 6 + 1.3e-9, 6)), "critical" if z > 5 else "high" if z > 4 else "medium" if z > 3 else "low"))
        return ([*history, value][-self.size :],)


def rolling_zscore_stream(readings: DataFrame, size: int = 100, least: int = 10, limit: float = 2.0, include_current: bool = False) -> DataFrame:
    """Values against up to `size` values before (with the value itself if include_current), from `least` on. State: the last values."""
    return in_order(readings, Zscores, size, least, limit, include_current)


class Alerts(InOrder):
    FIELDS = {"us": "long", "event_id": "long", "engine_temperature_c": "double", "battery_voltage": "double", "fuel_level_percent": "double", "speed_kmh": "double"}
    CARRIED = "heat array<double>, volts array<double>"
    OUT = {"vehicle_id": "long", "event_id": "long", "ts_us": "long", "alert_type": "string", "priority": "string", "heat_rise": "double", "mean_voltage": "double"}

    def __init__(self, size: int):
        self.size = size

    def step(self, key, row, carried, out):
        us, event, hot, volt, fuel, speed = row
        heat, volts = [*(carried[0] if carried else ()), hot][-self.size :], [*(carried[1] if carried else ()), volt][-self.size :]
        rise, mean = round(heat[-1] - heat[0] + 1.3e-9, 6), round(float(np.mean(volts)) + 1.3e-9, 6)
        rules = (("ENGINE_OVERHEATING", "CRITICAL", hot > 125), ("TEMPERATURE_RISE", "HIGH", rise > 30), ("LOW_FUEL", "MEDIUM", fuel < 5), ("EXCESSIVE_SPEED", "HIGH", speed > 150), ("BATTERY", "MEDIUM", mean < 11.8))
        hit = next(((n, p) for n, p, yes in rules if yes), None)
        if hit:
            out.append((key[0], event, us, *hit, rise, mean))
        return heat, volts


def alert_stream(readings: DataFrame, size: int = 11) -> DataFrame:
    """Alerts from a reading and the trend over the vehicle's last eleven. State: their temperatures and voltages."""
    return in_order(readings, Alerts, size)


class Runs(InOrder):
    FIELDS = {"us": "long", "event_id": "long", "speed_kmh": "double", "event_type": "string"}
    CARRIED = "started_us long, events long, distance double, faults long, ended_us long"
    OUT = {"vehicle_id": "long", "started_us": "long", "last_update_us": "long", "events": "long", "distance": "double", "faults": "long", "expired": "boolean"}

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def idle(self, key, carried, out):
        started, n, km, faults, last = carried
        out.append((key[0], started, last, n, round(km + 1.3e-9, 6), faults, True))
        return None

    def step(self, key, row, carried, out):
        us, _, speed, kind = row
        if carried and us - carried[4] > self.idle_ms * 1000:
            carried = self.idle(key, carried, out)
        started, n, km, faults, _ = carried or (us, 0, 0.0, 0, us)
        return started, n + 1, km + speed / 60, faults + (kind == "error"), us


def vehicle_runs(readings: DataFrame, timeout_s: int = 600) -> DataFrame:
    """Totals of each stretch of a vehicle's readings without a pause over the timeout (by event time), when the stretch is over."""
    return in_order(readings, Runs, timeout_s * 1000)


class Activity(StatefulProcessor):
    """Running totals in state that also has a time to live; a processing-time timer ends them."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        # The timer forgets a silent vehicle; what a lost timer would leave lives ten times as long at most.
        self.totals = handle.getValueState("totals", "events long, distance double, faults long, last string", ttlDurationMs=10 * self.timeout_ms)

    def handleInputRows(self, key, rows, timerValues):
        n, km, faults, last = self.totals.get() or (0, 0.0, 0, "")
        for part in rows:
            n, km, faults = n + len(part), km + float(part["speed_kmh"].sum()) / 60, faults + int((part["event_type"] == "error").sum())
            last = max(last, str(part["ts"].max()))
        self.totals.update((n, km, faults, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield pd.DataFrame([(key[0], n, km, faults, last, False)], columns=ACTIVITY)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        n, km, faults, last = self.totals.get() or (0, 0.0, 0, "")
        self.totals.clear()
        yield pd.DataFrame([(key[0], n, km, faults, last, True)], columns=ACTIVITY)

    def close(self) -> None:
        pass


ACTIVITY = ["vehicle_id", "events", "distance", "faults", "last_update", "expired"]


def vehicle_state(readings: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """Running totals of each vehicle, in update mode; one that is silent for the timeout (by the clock) is reported as expired and forgotten."""
    schema = "vehicle_id long, events long, distance double, faults long, last_update string, expired boolean"
    return readings.select("vehicle_id", "ts", "speed_kmh", "event_type").groupBy("vehicle_id").transformWithStateInPandas(Activity(timeout_ms), schema, "update", "ProcessingTime")


class Sustained(InOrder):
    """Pending, firing, resolved: each alert of a vehicle by the rows in order.

    An alert whose condition holds is pending from its first row, firing once it has held for its time, and resolved by a row
    where it does not hold, or by a pause. `since`, `until` and `n` have an entry for each rule; until -1: the rule is quiet.
    Faults are counted by whole seconds, so rows are handed over by these.
    """

    FIELDS = {"us": "long", "event_id": "long", "is_error": "boolean", "holds": "string"}
    CARRIED = "since array<long>, until array<long>, n array<long>, firing array<boolean>, errors array<long>, second long"
    OUT = {"vehicle_id": "long", "alert": "string", "state": "string", "since_us": "long", "until_us": "long", "readings": "long", "required_s": "int"}
    grain_ms = 1000

    def __init__(self, stale_s: int, scale: int):
        self.stale_s, self.scale = stale_s, scale
        self.idle_ms = (stale_s * scale + 1) * 1000
        self.by_faults = {k: (float((re.search(r"/ ([\d.]+)", x) or [0, 1])[1]), float(test.split()[1])) for k, (_, x, test, _) in enumerate(SUSTAINED) if "faults" in x}

    def told(self, key, k, state, since, until, n):
        return (key[0], SUSTAINED[k][0], state, since[k], until[k], n[k], SUSTAINED[k][3])

    def prepare(self, ready):
        self.errors_in = Counter(r[0] // 1_000_000 for r in ready if r[2])

    def idle(self, key, carried, out):
        since, until, n, firing = carried[:4]
        out += [self.told(key, k, "resolved", since, until, n) for k, f in enumerate(firing) if f]
        return None

    def step(self, key, row, carried, out):
        us, _, _, holds = row
        every = range(len(SUSTAINED))
        since, until, n, firing, errors = (list(x) for x in carried[:5]) if carried else ([-1] * len(SUSTAINED), [-1] * len(SUSTAINED), [0] * len(SUSTAINED), [False] * len(SUSTAINED), [])
        second = us // 1_000_000
        if not carried or carried[5] != second:
            errors = [e for e in errors if e >= second - FAULT_SECONDS * self.scale] + [second] * self.errors_in[second]
        for k in every:
            yes = len(errors) / self.by_faults[k][0] > self.by_faults[k][1] if k in self.by_faults else holds[k] == "1"
            if until[k] >= 0 and (not yes or (us - until[k]) // 1_000_000 > self.stale_s * self.scale):
                if firing[k]:
                    out.append(self.told(key, k, "resolved", since, until, n))
                until[k], firing[k] = -1, False
            if yes:
                since[k], n[k] = (us, 1) if until[k] < 0 else (since[k], n[k] + 1)
                until[k] = us
                if not firing[k] and (us - since[k]) // 1_000_000 >= SUSTAINED[k][3] * self.scale:
                    firing[k] = True
                    out.append(self.told(key, k, "firing", since, until, n))
        return since, until, n, firing, errors, second


def sustained_alert_stream(readings: DataFrame, stale_s: int = 300, time_scale: int = 1) -> DataFrame:
    """When each alert begins to fire, and when it is resolved: its first and last reading and their number. Rules of `sustained_alerts`."""
    holds = F.concat(*(F.lit("0") if "faults" in x else F.when(F.expr(f"{x} {test}"), "1").otherwise("0") for _, x, test, _ in SUSTAINED))
    return in_order(readings.withColumns({"holds": holds, "is_error": F.coalesce(F.col("event_type") == "error", F.lit(False))}), Sustained, stale_s, time_scale)


def wear(df: DataFrame) -> DataFrame:
    """What each reading takes from the health of engine, brakes and battery."""
    hot, oil, rpm, volts, brake, press = (F.col(c) for c in ("engine_temperature_c", "oil_pressure_kpa", "rpm", "battery_voltage", "brake_temperature_c", "brake_pressure_bar"))
    engine = F.when(hot > 120, 0.5).when(hot > 100, 0.2).otherwise(0.0) + F.when(oil < 150, 0.3).when(oil < 180, 0.1).otherwise(0.0) + F.when(rpm > 4000, 0.1).otherwise(0.0)
    battery = F.when(volts < 11.5, 1.0).when(volts < 12.0, 0.5).when(volts < 12.4, 0.1).otherwise(0.0)
    brakes = F.when(brake > 200, 0.8).when(brake > 150, 0.3).otherwise(0.0) + F.when(press < 15, 0.2).otherwise(0.0)
    parts = F.array(*(F.struct(F.lit(n).alias("component"), x.alias("loss")) for n, x in (("engine", engine), ("brakes", brakes), ("battery", battery))))
    return df.select("vehicle_id", "event_id", "ts", F.explode(parts).alias("w")).select("vehicle_id", "event_id", "ts", "w.*")


def component_health_stream(readings: DataFrame) -> DataFrame:
    """Health of each vehicle's components after each micro-batch, with the days that are left. State: the health.

    A loss is never negative, so clamping at 0 after each step is clamping the sum: the batch twin sums up losses.
    """

    def step(key, frames, state: GroupState):
        health = state.get[0] if state.exists else 100.0
        for part in frames:
            health = max(0.0, health - float(part["loss"].sum()))
        state.update((health,))
        h = round(health + 1.3e-9, 6)  # limits are held against this, as in the batch twin
        days = 1 if h < 10 else 3 if h < 20 else 7 if h < 30 else None
        yield pd.DataFrame([(*key, health, days, "critical" if h < 30 else "warning" if h < 70 else "healthy")], columns=["vehicle_id", "component", "health", "days_left", "state"])

    schema = "vehicle_id long, component string, health double, days_left int, state string"
    return wear(readings).groupBy("vehicle_id", "component").applyInPandasWithState(step, schema, "health double", "update", GroupStateTimeout.NoTimeout)


def component_health_batch(readings: DataFrame) -> DataFrame:
    """The batch twin of component_health_stream."""
    out = wear(readings).groupBy("vehicle_id", "component").agg(F.greatest(F.lit(0.0), 100 - F.sum("loss")).alias("health"))
    h = F.round(F.col("health") + 1.3e-9, 6)
    return out.select("vehicle_id", "component", h.alias("health"), F.when(h < 10, 1).when(h < 20, 3).when(h < 30, 7).alias("days_left"), F.when(h < 30, "critical").when(h < 70, "warning").otherwise("healthy").alias("state"))
