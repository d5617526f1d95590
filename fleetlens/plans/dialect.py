"""Operators written once as SQL text and bound either to DataFrames (Spark) or to plain table names (an oracle engine).

`@op("key", "telemetry", ...)` registers a function that gets a Dialect and returns a SELECT over the named inputs. Calling
the operator with DataFrames runs it on Spark: `daily_usage(telemetry=trips)`. Floats that are results of aggregation are
rounded with r2/r4/r6, so that two engines that add in another order agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles

#: Trips end on 2001-11-04 and readings on 2024-01-30 in the test tables; "today" is a parameter everywhere.
AS_OF = "2001-11-05"
AS_OF_READINGS = "2024-01-31"


class Dialect:
    def __init__(self, name: str):
        self.name, self.spark = name, name == "spark"

    def _(self, spark: str, other: str) -> str:
        return spark if self.spark else other

    # Rounding: an offset far below the last digit keeps exact ties from falling either way. On Spark by rint, which stays
    # in doubles: its round() goes through decimals of any size for each value.
    def rounded(self, x: str, offset: str, digits: int) -> str:
        return self._(f"(RINT((CAST({x} AS DOUBLE) + {offset}) * 1e{digits}D) / 1e{digits}D)", f"ROUND(CAST({x} AS DOUBLE) + {offset}, {digits})")

    def r2(self, x: str) -> str:
        return self.rounded(x, "1.3e-5", 2)

    def r4(self, x: str) -> str:
        return self.rounded(x, "1.3e-7", 4)

    def r6(self, x: str) -> str:
        return self.rounded(x, "1.3e-9", 6)

    def div(self, a: str, b: str) -> str:
        """a / b in doubles; null where b is 0."""
        return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"

    def pct(self, x: str, p: float) -> str:
        """Exact percentile, with linear interpolation."""
        return self._(f"percentile({x}, {p})", f"quantile_cont({x}, {p})")

    def hour(self, ts: str) -> str:
        return f"CAST(hour({ts}) AS INT)"

    def dow(self, ts: str) -> str:
        """Monday 0 to Sunday 6."""
        return f"CAST({self._(f'weekday({ts})', f'isodow({ts}) - 1')} AS INT)"

    def week(self, ts: str) -> str:
        return f"CAST(date_trunc('week', {ts}) AS DATE)"

    def month(self, ts: str) -> str:
        return f"CAST(date_trunc('month', {ts}) AS DATE)"

    def seconds(self, a: str, b: str) -> str:
        """Whole seconds from a to b (b not before a)."""
        return f"CAST({self._(f'timestampdiff(SECOND, {a}, {b})', f'floor(epoch({b}) - epoch({a}))')} AS BIGINT)"

    def corr(self, a: str, b: str) -> str:
        """Pearson correlation; null where either side is constant."""
        return f"(CASE WHEN MIN({a}) < MAX({a}) AND MIN({b}) < MAX({b}) THEN COVAR_POP({a}, {b}) / NULLIF(STDDEV_POP({a}) * STDDEV_POP({b}), 0) END)"

    def share(self, condition: str) -> str:
        """Percent of rows where a condition holds."""
        return f"({self.div(f'COUNT(CASE WHEN {condition} THEN 1 END)', 'COUNT(*)')} * 100)"

    def days(self, a: str, b: str) -> str:
        """Days from date a to date b."""
        return f"CAST({self._(f'datediff({b}, {a})', f'date_diff({chr(39)}day{chr(39)}, {a}, {b})')} AS BIGINT)"

    def rx(self, pattern: str) -> str:
        """A string literal that holds a regular expression."""
        return f"r'{pattern}'" if self.spark else f"'{pattern}'"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        """The group's text; empty where nothing matches."""
        return f"regexp_extract({x}, {self.rx(pattern)}, {group})"

    def matches(self, x: str, pattern: str) -> str:
        return self._(f"{x} RLIKE {self.rx(pattern)}", f"regexp_matches({x}, {self.rx(pattern)})")

    def unnest(self, x: str, sep: str = ",") -> str:
        """A select item: one row for each part of x."""
        return self._(f"explode(split({x}, '{sep}'))", f"unnest(string_split({x}, '{sep}'))")

    def ts(self, x: str) -> str:
        return f"TIMESTAMP '{x}'" if not self.spark else f"TIMESTAMP_NTZ '{x}'"

    def try_ts(self, x: str) -> str:
        return self._(f"CAST(try_to_timestamp({x}) AS TIMESTAMP_NTZ)", f"TRY_CAST({x} AS TIMESTAMP)")

    def since(self, days: int, as_of: str, column: str = "ts") -> str:
        """Trips of the days before as_of. The bound on `shipped`, the stored date that ts lies within a day of, reaches the Parquet scan."""
        stored = column.removesuffix("ts") + "shipped"
        return f"{column} >= {self.ts(as_of)} - INTERVAL '{days}' DAY AND {column} < {self.ts(as_of)} AND {stored} >= {self.ts(as_of)} - INTERVAL '{days + 1}' DAY AND {stored} <= {self.ts(as_of)}"

    def last(self, x: str, window: str) -> str:
        """The last value that is not null."""
        return self._(f"last_value({x}, true) {window}", f"last_value({x} IGNORE NULLS) {window}")

    def first(self, x: str, window: str) -> str:
        return self._(f"first_value({x}, true) {window}", f"first_value({x} IGNORE NULLS) {window}")

    def json_int(self, x: str, key: str) -> str:
        return self._(f"CAST(get_json_object({x}, '$.{key}') AS INT)", f"CAST(json_extract({x}, '$.{key}') AS INT)")

    def listing(self, parts: list[tuple[str, str]], sep: str = "; ") -> str:
        """The texts whose conditions hold, joined."""
        items = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in parts)
        return f"concat_ws('{sep}', {items})"


SPARK, ORACLE = Dialect("spark"), Dialect("oracle")


class Measured(Dialect):
    """Spark, with percentiles of whole tables as numbers that were measured before (`exact_quantiles`)."""

    def __init__(self):
        super().__init__("spark")
        self.known: dict[tuple[str, float], float | None] = {}
        self.asked: set[tuple[str, float]] = set()

    def value(self, x: str, p: float) -> str:
        """The percentile as a literal."""
        self.asked.add((x, p))
        v = self.known.get((x, p))
        return "CAST(NULL AS DOUBLE)" if v is None else f"({v!r}D)"

    def pct(self, x: str, p: float) -> str:
        return f"MAX({self.value(x, p)})"

    def measure(self, values: DataFrame) -> bool:
        """Find what was asked for and is not known; whether there was any."""
        new = sorted(self.asked - self.known.keys())
        names = {x: f"x{i}" for i, x in enumerate(sorted({x for x, _ in new}))}
        found = exact_quantiles(values, {n: F.expr(x) for x, n in names.items()}, {n: [p for y, p in new if y == x] for x, n in names.items()}) if new else {}
        self.known |= {(x, p): found[names[x], p] for x, p in new}
        return bool(new)


def compilable(session: SparkSession) -> SparkSession:
    """The session, told to give up whole-stage code whose methods the JVM would interpret.

    HotSpot compiles no method over 8,000 bytes; Spark's own limit is higher, so wide selects run interpreted, several times
    slower than operator by operator. A limit that the user has set stays.
    """
    if session.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        session.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return session


class Op:
    """A registered operator."""

    def __init__(self, key: str, inputs: tuple[str, ...], build: Callable, oracle: bool, given: dict, measured: str | None):
        self.key, self.inputs, self.build, self.has_oracle, self.given = key, inputs, build, oracle, given  # given: arguments of the registered query
        self.measured = measured  # rows whose percentiles are measured before the text is built
        self.__doc__, self.__name__ = build.__doc__, build.__name__

    def __call__(self, **given) -> DataFrame:
        frames = {k: v for k, v in given.items() if isinstance(v, DataFrame)}
        rest = {k: v for k, v in given.items() if k not in frames}
        missing = [i for i in self.inputs if i not in frames]
        if missing:
            raise TypeError(f"{self.key} needs {', '.join(missing)}")
        session = compilable(next(iter(frames.values())).sparkSession)
        dialect = Measured() if self.measured else SPARK
        text = self.build(dialect, **rest)
        if self.measured:
            rows = session.sql(bound(self.measured, self.inputs), **{k: frames[k] for k in self.inputs})
            while dialect.measure(rows):
                text = self.build(dialect, **rest)
        if "telemetry" in frames and "shipped" not in frames["telemetry"].columns and "shipped" in text:
            frames["telemetry"] = frames["telemetry"].withColumn("shipped", F.col("ts"))
        return session.sql(bound(text, self.inputs), **{k: frames[k] for k in self.inputs})

    def oracle(self, ctes: str) -> str:
        return f"{'WITH ' + ctes if ctes else ''} SELECT * FROM (\n{self.build(ORACLE, **self.given)}\n) AS result"


def bound(text: str, inputs: tuple[str, ...]) -> str:
    """The text with its inputs as placeholders for DataFrames."""
    return re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(inputs)})\b(?!\.)", r"\1 {\2}", text)


REGISTRY: dict[str, Op] = {}


def op(key: str, *inputs: str, oracle: bool = True, given: dict | None = None, measured: str | None = None):
    def add(build: Callable) -> Op:
        REGISTRY[key] = Op(key, inputs, build, oracle, given or {}, measured)
        return REGISTRY[key]

    return add


def banded(x: str, bands: list[tuple[str, str]], other: str) -> str:
    """CASE: the text of the first condition on x that holds."""
    return "CASE " + " ".join(f"WHEN {x} {c} THEN {t}" for c, t in bands) + f" ELSE {other} END"


def cut(x: str, edges: list[float], names: list[str], lowest: bool = True) -> str:
    """Right-closed bins (a, b]; the first bin holds its lower edge if lowest; null outside."""
    out = []
    for k, name in enumerate(names):
        low, high = edges[k], edges[k + 1]
        above = f"{x} {'>=' if lowest and k == 0 else '>'} {low}" if low is not None else "TRUE"
        below = f"{x} <= {high}" if high is not None else f"{x} IS NOT NULL"
        out.append(f"WHEN {above} AND {below} THEN '{name}'")
    return f"CASE {' '.join(out)} END"

