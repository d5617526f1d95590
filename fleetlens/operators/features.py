"""Profiling and feature engineering over sensor readings, and the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.dialect import AS_OF_READINGS, banded, cut, op
from ..plans.parts import n_if
from .analysis import INSTANT, STRESS
from .enrichment import haversine

NUMBERS = ("speed_kmh", "engine_temperature_c", "fuel_level_percent", "rpm", "battery_voltage", "fuel_consumption_lph")
BY_TIME = "PARTITION BY vehicle_id ORDER BY ts, event_id"
ROW = "event_id, vehicle_id, ts"


def moments(d, x: str) -> dict[str, str]:
    """Bias-corrected and population skewness and kurtosis, from sums of powers about the mean m."""
    n, m2, m3, m4 = "CAST(COUNT(*) AS DOUBLE)", f"SUM(POWER({x} - m, 2))", f"SUM(POWER({x} - m, 3))", f"SUM(POWER({x} - m, 4))"
    g1 = f"({m3} / {n}) / POWER({m2} / {n}, 1.5)"
    g2 = f"({m4} / {n}) / POWER({m2} / {n}, 2) - 3"
    return {"skewness": f"SQRT({n} * ({n} - 1)) / ({n} - 2) * {g1}", "kurtosis": f"({n} - 1) / (({n} - 2) * ({n} - 3)) * (({n} + 1) * ({g2}) + 6)", "skewness_pop": g1, "kurtosis_pop": g2}


ALL = "SELECT * FROM readings"


def in_columns(names, value) -> str:
    """value of the column that a row in long form is of."""
    return "CASE column_name " + " ".join(f"WHEN '{c}' THEN {value(c)}" for c in names) + " END"


def each_number(d, figures, means: bool = False) -> str:
    """figures(x, of) for each number, from one scan in long form; of(value) picks what belongs to a column, m is its mean if asked for.

    The oracle's text scans each column by itself.
    """
    if not d.spark:
        mean = lambda c: f" CROSS JOIN (SELECT AVG({c}) AS m FROM readings) AS a" if means else ""
        return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {figures(c, lambda value, c=c: value(c))} FROM readings{mean(c)}" for c in NUMBERS)
    rows = ", ".join(f"named_struct('column_name', '{c}', 'x', CAST({c} AS DOUBLE)" + (f", 'm', m_{c})" if means else ")") for c in NUMBERS)
    mean = f" CROSS JOIN (SELECT {', '.join(f'AVG({c}) AS m_{c}' for c in NUMBERS)} FROM readings) AS a" if means else ""
    return f"SELECT column_name, {figures('x', lambda value: in_columns(NUMBERS, value))} FROM (SELECT r.* FROM (SELECT explode(array({rows})) AS r FROM readings{mean}) AS e) AS long GROUP BY column_name"


@op("n1_profile_numbers", "readings", measured=ALL)
def profile_numbers(d):
    """Missing values, mean, deviation, extremes, percentiles, fences and zeros of each number."""

    def figures(x, of):
        q1, q3 = (of(lambda c, p=p: d.pct(c, p)) for p in (0.25, 0.75))
        points = ", ".join(f"{d.r6(of(lambda c, p=p: d.pct(c, p)))} AS p{round(100 * p):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
        return f"""COUNT(*) AS row_count, {n_if(f'{x} IS NULL')} AS missing, {d.r4(d.share(f'{x} IS NULL'))} AS missing_percent, {d.r6(f'AVG({x})')} AS mean, {d.r6(f'STDDEV_SAMP({x})')} AS std,
  MIN({x}) AS min_value, {points}, MAX({x}) AS max_value, {d.r6(f'MAX({x}) - MIN({x})')} AS value_range, {d.r6(f'STDDEV_SAMP({x}) / NULLIF(AVG({x}), 0)')} AS cv,
  {d.r6(f'{q1} - 1.5 * ({q3} - {q1})')} AS low_fence, {d.r6(f'{q3} + 1.5 * ({q3} - {q1})')} AS high_fence, {d.r4(d.share(f'{x} = 0'))} AS zero_percent"""

    return each_number(d, figures)


@op("n1_duplicates", "readings")
def duplicates(d):
    """Rows that repeat another whole row, or another's vehicle and second."""
    return "SELECT COUNT(*) AS row_count, COUNT(*) - COUNT(DISTINCT event_id) AS exact_duplicates, COUNT(*) - COUNT(DISTINCT CONCAT(CAST(vehicle_id AS STRING), '|', CAST(date_trunc('second', ts) AS STRING))) AS near_duplicates FROM readings"


@op("n1_top_categories", "readings")
def top_categories(d, k=3):
    """The commonest values of the text columns."""
    one = lambda c: f"SELECT '{c}' AS column_name, {c} AS value, COUNT(*) AS n FROM readings GROUP BY {c}"
    return f"SELECT column_name, value, n, place, distinct_values FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS place, COUNT(*) OVER (PARTITION BY column_name) AS distinct_values FROM ({one('event_type')} UNION ALL {one('driver_id')}) AS u) AS r WHERE place <= {k}"


@op("n2_stat_properties", "readings")
def stat_properties(d):
    """Skewness, kurtosis (both corrected and population) and a K-squared statistic from them."""

    def figures(x, of):
        m = moments(d, x)
        k2 = f"COUNT(*) / 6.0 * (POWER({m['skewness_pop']}, 2) + POWER({m['kurtosis_pop']}, 2) / 4)"
        return f"{', '.join(f'{d.r4(v)} AS {k}' for k, v in m.items())}, {d.r4(k2)} AS jarque_bera, {d.r4(k2)} < 5.991 AS looks_normal"

    return each_number(d, figures, means=True)


@op("n3_iqr_anomalies", "readings", measured=ALL)
def iqr_anomalies(d):
    """How many values of each number are beyond 1.5 quartile ranges."""
    if not d.spark:
        one = lambda c: f"SELECT '{c}' AS column_name, {d.r6('low')} AS low, {d.r6('high')} AS high, {n_if(f'{c} < low OR {c} > high')} AS anomalies, {d.r4(d.share(f'{c} < low OR {c} > high'))} AS percent FROM readings CROSS JOIN (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM (SELECT {d.pct(c, 0.25)} AS q1, {d.pct(c, 0.75)} AS q3 FROM readings) AS q) AS f GROUP BY low, high"
        return " UNION ALL ".join(one(c) for c in NUMBERS)

    def figures(x, of):
        low = of(lambda c: f"{d.value(c, 0.25)} - 1.5D * ({d.value(c, 0.75)} - {d.value(c, 0.25)})")
        high = of(lambda c: f"{d.value(c, 0.75)} + 1.5D * ({d.value(c, 0.75)} - {d.value(c, 0.25)})")
        out = f"{x} < {low} OR {x} > {high}"
        return f"{d.r6(f'MAX({low})')} AS low, {d.r6(f'MAX({high})')} AS high, {n_if(out)} AS anomalies, {d.r4(d.share(out))} AS percent"

    return each_number(d, figures)


@op("n3_zscore_flags", "readings")
def zscore_flags(d, limit=2.5):
    """Readings whose speed or heat is far from the mean, in deviations of the population."""
    z = lambda c: d.r6(f"({c} - m_{c}) / NULLIF(s_{c}, 0)")
    two = ("speed_kmh", "engine_temperature_c")
    return f"SELECT {ROW}, {', '.join(f'{z(c)} AS z_{c}' for c in two)} FROM readings CROSS JOIN (SELECT {', '.join(f'AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}' for c in two)} FROM readings) AS s WHERE {' OR '.join(f'ABS({z(c)}) > {limit}' for c in two)}"


@op("n3_mad_anomalies", "readings", measured=ALL)
def mad_anomalies(d, limit=3.5):
    """Readings whose speed has a modified z-score (by the median of distances to the median) beyond the limit."""
    if d.spark:
        med = d.value("speed_kmh", 0.5)
        middle = f"SELECT {med} AS med, {d.value(f'ABS(speed_kmh - {med})', 0.5)} AS mad"
    else:
        middle = f"SELECT MAX(med) AS med, {d.pct('ABS(speed_kmh - med)', 0.5)} AS mad FROM readings CROSS JOIN (SELECT {d.pct('speed_kmh', 0.5)} AS med FROM readings) AS m"
    z = d.r6("0.6745 * (speed_kmh - med) / NULLIF(mad, 0)")
    return f"SELECT {ROW}, speed_kmh, {z} AS modified_z FROM readings CROSS JOIN ({middle}) AS s WHERE ABS({z}) > {limit}"


@op("n4_resample_daily", "readings")
def resample_daily(d):
    """Mean and deviation by vehicle and day, with a row for days without readings between first and last."""
    spine = d._("explode(sequence(MIN(CAST(ts AS DATE)), MAX(CAST(ts AS DATE)), INTERVAL '1' DAY))", "unnest(generate_series(MIN(CAST(ts AS DATE)), MAX(CAST(ts AS DATE)), INTERVAL '1' DAY))")
    return f"""SELECT s.vehicle_id, s.day, COALESCE(n, 0) AS readings, {d.r6('mean')} AS speed_mean, {d.r6('sd')} AS speed_std FROM (SELECT vehicle_id, CAST(day AS DATE) AS day FROM (SELECT vehicle_id, {spine} AS day FROM readings GROUP BY vehicle_id) AS x) AS s
LEFT JOIN (SELECT vehicle_id, CAST(ts AS DATE) AS day, COUNT(*) AS n, AVG(speed_kmh) AS mean, STDDEV_SAMP(speed_kmh) AS sd FROM readings GROUP BY vehicle_id, CAST(ts AS DATE)) AS r ON s.vehicle_id = r.vehicle_id AND s.day = r.day"""


@op("n4_resample_hours", "readings")
def resample_hours(d, hours=6):
    """Mean and deviation of all readings in bins of some hours."""
    at = d.ts("2024-01-01")
    bin_ = f"CAST(floor({d.seconds(at, 'ts')} / ({hours} * 3600)) AS BIGINT)"
    return f"SELECT {bin_} AS bin, COUNT(*) AS readings, {d.r6('AVG(speed_kmh)')} AS speed_mean, {d.r6('STDDEV_SAMP(speed_kmh)')} AS speed_std, {d.r6('AVG(engine_temperature_c)')} AS temperature_mean FROM readings GROUP BY {bin_}"


@op("n5_seasonal_decompose", "readings")
def seasonal_decompose(d, period=7):
    """Daily mean speed as a centred moving mean, a mean for each place in the period, and what is left."""
    half = period // 2
    return f"""SELECT day, {d.r6('y')} AS observed, {d.r6('trend')} AS trend, {d.r6('seasonal - AVG(seasonal) OVER ()')} AS seasonal, {d.r6('y - trend - (seasonal - AVG(seasonal) OVER ())')} AS residual FROM (SELECT *, AVG(y - trend) OVER (PARTITION BY nth % {period}) AS seasonal FROM
(SELECT *, CASE WHEN COUNT(*) OVER w = {period} THEN AVG(y) OVER w END AS trend FROM (SELECT CAST(ts AS DATE) AS day, AVG(speed_kmh) AS y, ROW_NUMBER() OVER (ORDER BY CAST(ts AS DATE)) AS nth FROM readings GROUP BY CAST(ts AS DATE)) AS g WINDOW w AS (ORDER BY nth ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)) AS t) AS s"""


def hops(d) -> str:
    km = haversine("lat0", "lon0", "latitude", "longitude")
    return f"SELECT *, COALESCE({km}, 0) AS hop_km, {d.seconds('ts0', 'ts')} AS hop_s FROM (SELECT *, LAG(latitude) OVER ({BY_TIME}) AS lat0, LAG(longitude) OVER ({BY_TIME}) AS lon0, LAG(ts) OVER ({BY_TIME}) AS ts0 FROM readings) AS l"


@op("n6_trip_distance", "readings")
def trip_distance(d):
    """Distance from the reading before, all distance so far, and the speed that gives."""
    return f"SELECT {ROW}, {d.r6('hop_km')} AS distance_km, {d.r4(f'SUM(hop_km) OVER ({BY_TIME} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS cumulative_km, {d.r4('CASE WHEN hop_s > 0 THEN hop_km / hop_s * 3600 END')} AS derived_speed_kmh FROM ({hops(d)}) AS h"


@op("n6_bounding_box", "readings")
def bounding_box(d):
    """Where each vehicle has been."""
    return f"SELECT vehicle_id, MIN(latitude) AS south, MAX(latitude) AS north, MIN(longitude) AS west, MAX(longitude) AS east, {d.r6('AVG(latitude)')} AS mid_latitude, {d.r6('AVG(longitude)')} AS mid_longitude FROM readings GROUP BY vehicle_id"


@op("n6_density_grid", "readings")
def density_grid(d):
    """Readings by cells of a twentieth of a degree."""
    cell = lambda c: f"CAST(floor({c} * 20) AS BIGINT)"
    return f"SELECT {cell('latitude')} AS cell_lat, {cell('longitude')} AS cell_lon, COUNT(*) AS readings, COUNT(DISTINCT vehicle_id) AS vehicles FROM readings GROUP BY {cell('latitude')}, {cell('longitude')}"


@op("n7_temporal_features", "readings")
def nb_temporal(d):
    """Calendar parts, business hours, and quarters as seasons."""
    h, w = d.hour("ts"), d.dow("ts")
    return f"SELECT {ROW}, {h} AS hour, {w} AS day_of_week, CAST(day(ts) AS INT) AS day, CAST(month(ts) AS INT) AS month, CAST(quarter(ts) AS INT) AS quarter, CAST(weekofyear(ts) AS INT) AS week, {w} >= 5 AS is_weekend, {h} BETWEEN 9 AND 17 AND {w} < 5 AS is_business_hours, CASE quarter(ts) WHEN 1 THEN 'Winter' WHEN 2 THEN 'Spring' WHEN 3 THEN 'Summer' ELSE 'Fall' END AS season FROM readings"


@op("n8_rolling_features", "readings")
def rolling_features(d, sizes=(5, 15, 30, 60)):
    """Mean, deviation, extremes and relative change of speed over so many rows."""
    cols = []
    for n in sizes:
        w = f"OVER ({BY_TIME} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols.append(f"{d.r6(f'AVG(speed_kmh) {w}')} AS mean_{n}, {d.r6(f'STDDEV_SAMP(speed_kmh) {w}')} AS std_{n}, MIN(speed_kmh) {w} AS min_{n}, MAX(speed_kmh) {w} AS max_{n}, {d.r6(f'speed_kmh / NULLIF(LAG(speed_kmh, {n}) OVER ({BY_TIME}), 0) - 1')} AS change_{n}")
    return f"SELECT {ROW}, {', '.join(cols)} FROM readings"


@op("n9_lag_features", "readings")
def lag_features(d, lags=(1, 2, 3, 5)):
    """Speeds some rows before, and differences to them."""
    return f"SELECT {ROW}, {', '.join(f'LAG(speed_kmh, {n}) OVER ({BY_TIME}) AS lag_{n}, {d.r6(f'speed_kmh - LAG(speed_kmh, {n}) OVER ({BY_TIME})')} AS diff_{n}' for n in lags)} FROM readings"


@op("n10_domain_features", "readings")
def domain_features(d):
    """Load, gear, acceleration, instant efficiency, stress, warnings and health of each reading."""
    gap = f"NULLIF({d.seconds(f'LAG(ts) OVER ({BY_TIME})', 'ts')}, 0)"
    acc = f"LEAST(CAST(10 AS DOUBLE), GREATEST(CAST(-10 AS DOUBLE), COALESCE((speed_kmh - LAG(speed_kmh) OVER ({BY_TIME})) / {gap}, 0)))"
    battery = "LEAST(CAST(1 AS DOUBLE), battery_voltage / 14.5)"
    health = d.r6(f"((1 - {STRESS}) + {battery}) / 2")
    return f"""SELECT {ROW}, {d.r6('rpm * speed_kmh / 1000')} AS engine_load, {d.r6('LEAST(CAST(4 AS DOUBLE), GREATEST(CAST(0.5 AS DOUBLE), speed_kmh / (rpm / 1000)))')} AS estimated_gear, {d.r6(acc)} AS acceleration, {d.r6(INSTANT)} AS instant_fuel_efficiency, {cut(d.r6(INSTANT), [0, 5, 10, 15, 20, 100], ['Very Poor', 'Poor', 'Average', 'Good', 'Excellent'], lowest=False)} AS fuel_efficiency_category,
  {d.r6(STRESS)} AS engine_stress_score, engine_temperature_c > 100 AS overheating_risk, tire_pressure_psi < 28 AS low_tire_pressure_warning, {d.r6(battery)} AS battery_health_score, battery_voltage < 11.5 AS low_battery_warning, speed_kmh > 100 AS speeding_indicator, {health} AS vehicle_health_score, {health} < 0.7 AS maintenance_required FROM readings"""


@op("n11_series_features", "readings")
def series_features(d):
    """Mean, variance, shape, places of extremes, and peaks of each vehicle's speeds."""
    peak = " AND ".join(f"x > {f}(x, {k}) OVER (PARTITION BY vehicle_id ORDER BY nth)" for f in ("LAG", "LEAD") for k in (1, 2, 3))
    m = moments(d, "x")
    return f"""SELECT vehicle_id, COUNT(*) AS n, {d.r6('MAX(m)')} AS mean, {d.r6('STDDEV_SAMP(x)')} AS std, {d.r6('VAR_SAMP(x)')} AS variance, {d.r4(m['skewness'])} AS skewness, {d.r4(m['kurtosis'])} AS kurtosis, {d.r6('(MAX_BY(nth, x * 1000000 - nth) - 1) / CAST(COUNT(*) AS DOUBLE)')} AS first_maximum, {d.r6('(MIN_BY(nth, x * 1000000 + nth) - 1) / CAST(COUNT(*) AS DOUBLE)')} AS first_minimum, {n_if('peak')} AS peaks
FROM (SELECT *, {peak} AS peak, AVG(x) OVER (PARTITION BY vehicle_id) AS m FROM (SELECT vehicle_id, speed_kmh AS x, ROW_NUMBER() OVER ({BY_TIME}) AS nth FROM readings) AS r) AS p GROUP BY vehicle_id HAVING COUNT(*) > 4"""


def encode_categoricals(df: DataFrame, columns: list[str], key: str, few: int = 10, some: int = 50) -> DataFrame:
    """key and the columns encoded by how many values they have: up to `few` one-hot, up to `some` their share of rows, else a number in order.

    Values are counted first, so that shares and numbers are small tables that are joined back; a null has its own share and
    no number, and is no value of one-hot columns.
    """
    out = df.select(key, *columns)
    names = [key]
    for c in columns:
        counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("rows"))
        values = [r[0] for r in counts.filter(F.col(c).isNotNull()).select(c).orderBy(c).limit(some + 1).collect()]  # some + 1 values at most
        if len(values) <= few:
            out = out.withColumns({f"{c}_{v}": F.coalesce(F.col(c).eqNullSafe(F.lit(v)), F.lit(False)).cast("double") for v in values})
            names += [f"{c}_{v}" for v in values]
            continue
        if len(values) <= some:
            coded, name = counts.crossJoin(df.agg(F.count(F.lit(1)).alias("all"))).select(c, (F.col("rows") / F.col("all")).alias(f"{c}_frequency")), f"{c}_frequency"
        else:
            known = counts.filter(F.col(c).isNotNull())
            coded, name = known.select(c, (F.dense_rank().over(Window.orderBy(c)) - 1).cast("double").alias(f"{c}_label")), f"{c}_label"
        coded = coded.withColumnRenamed(c, "value_of_column")
        out = out.join(coded, F.col(c).eqNullSafe(F.col("value_of_column")), "left").drop("value_of_column")
        names.append(name)
    return out.select(*names)


@op("n13_scale", "readings", measured=ALL)
def scale(d):
    """Speeds standardised, between 0 and 1, and by median and quartile range."""
    return f"SELECT {ROW}, {d.r6('(speed_kmh - m) / NULLIF(s, 0)')} AS standard, {d.r6('(speed_kmh - low) / NULLIF(high - low, 0)')} AS minmax, {d.r6('(speed_kmh - q2) / NULLIF(q3 - q1, 0)')} AS robust FROM readings CROSS JOIN (SELECT AVG(speed_kmh) AS m, STDDEV_POP(speed_kmh) AS s, MIN(speed_kmh) AS low, MAX(speed_kmh) AS high, {d.pct('speed_kmh', 0.25)} AS q1, {d.pct('speed_kmh', 0.5)} AS q2, {d.pct('speed_kmh', 0.75)} AS q3 FROM readings) AS a"


@op("n16_interactions", "readings")
def interactions(d):
    """Products of pairs of numbers, and squares."""
    names = NUMBERS[:4]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return f"SELECT {ROW}, {', '.join(f'{d.r4(f'{a} * {b}')} AS {a}_x_{b}' for a, b in pairs)} FROM readings"


@op("n19_efficiency_ranking", "readings")
def efficiency_ranking(d):
    """Vehicles by mean instant efficiency."""
    return f"SELECT *, RANK() OVER (ORDER BY mean_efficiency DESC, vehicle_id) AS place FROM (SELECT vehicle_id, {d.r6(f'AVG({INSTANT})')} AS mean_efficiency, {d.r6(f'STDDEV_SAMP({INSTANT})')} AS std_efficiency, COUNT(*) AS readings FROM readings GROUP BY vehicle_id) AS g"


@op("n19_optimal_bins", "readings")
def optimal_bins(d, bins=20):
    """Mean efficiency in bins of speed, the best one marked."""
    bin_ = f"CAST(LEAST(floor((speed_kmh - low) / NULLIF(high - low, 0) * {bins}), {bins - 1}) AS INT)"
    return f"SELECT *, mean_efficiency = MAX(mean_efficiency) OVER () AS is_best FROM (SELECT bin, COUNT(*) AS readings, MIN(speed_kmh) AS from_speed, MAX(speed_kmh) AS to_speed, {d.r6('AVG(eff)')} AS mean_efficiency FROM (SELECT speed_kmh, {INSTANT} AS eff, {bin_} AS bin FROM readings CROSS JOIN (SELECT MIN(speed_kmh) AS low, MAX(speed_kmh) AS high FROM readings) AS r) AS b GROUP BY bin) AS g"


@op("n19_efficiency_surface", "readings")
def efficiency_surface(d):
    """Mean efficiency by bands of speed (rows) and engine speed (columns)."""
    cell = lambda lo: d.r6(f"AVG(CASE WHEN rpm >= {lo} AND rpm < {lo + 1000} THEN {INSTANT} END)")
    return f"SELECT CAST(floor(speed_kmh / 20) AS INT) AS speed_band, {', '.join(f'{cell(k * 1000)} AS rpm_{k}000' for k in range(5))} FROM readings GROUP BY CAST(floor(speed_kmh / 20) AS INT)"


@op("n21_forecast_daily", "readings")
def forecast_daily(d, hold=5):
    """Daily counts by trend and weekday means, with the errors on the last days that were held out."""
    base = f"SELECT *, ROW_NUMBER() OVER (ORDER BY day DESC) > {hold} AS train FROM (SELECT day, CAST(n AS DOUBLE) AS n, CAST(ROW_NUMBER() OVER (ORDER BY day) AS DOUBLE) AS x, {d.dow('day')} AS dow FROM (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM readings GROUP BY CAST(ts AS DATE)) AS g) AS o"
    line = f"SELECT REGR_SLOPE(n, x) AS b, REGR_INTERCEPT(n, x) AS a FROM ({base}) AS t WHERE train"
    fitted = f"SELECT dow, AVG(n - a - b * x) AS season FROM ({base}) AS t2 CROSS JOIN ({line}) AS l WHERE train GROUP BY dow"
    return f"""SELECT day, n AS actual, {d.r6('a + b * x + COALESCE(season, 0)')} AS forecast, {d.r6('AVG(ABS(n - a - b * x - COALESCE(season, 0))) OVER ()')} AS mae, {d.r4('AVG(POWER(n - a - b * x - COALESCE(season, 0), 2)) OVER ()')} AS mse FROM ({base}) AS h CROSS JOIN ({line}) AS l2 LEFT JOIN ({fitted}) AS s ON h.dow = s.dow WHERE NOT train"""


@op("n21_forecast_by_vehicle", "readings")
def forecast_by_vehicle(d, hold=5):
    """Daily counts of each vehicle (days without any are 0) by trend and weekday means, with the errors on its last days, held out.

    One aggregation by vehicle and weekday gives the sums of the normal equations; series of any number and length meet in no task.
    """
    day = d._("explode(sequence(low, high, INTERVAL 1 DAY))", "CAST(unnest(generate_series(low, high, INTERVAL 1 DAY)) AS DATE)")
    spans = "SELECT vehicle_id, MIN(CAST(ts AS DATE)) AS low, MAX(CAST(ts AS DATE)) AS high FROM readings GROUP BY vehicle_id"
    days = f"SELECT vehicle_id, low, high, {day} AS day FROM ({spans}) AS sp"
    counts = "SELECT vehicle_id, CAST(ts AS DATE) AS day, CAST(COUNT(*) AS DOUBLE) AS n FROM readings GROUP BY vehicle_id, CAST(ts AS DATE)"
    series = f"SELECT a.vehicle_id, a.day, CAST({d.days('low', 'a.day')} + 1 AS DOUBLE) AS x, COALESCE(n, 0) AS n, {d.dow('a.day')} AS dow, {d.days('a.day', 'high')} < {hold} AS held FROM ({days}) AS a LEFT JOIN ({counts}) AS c ON a.vehicle_id = c.vehicle_id AND a.day = c.day"
    sums = f"SELECT vehicle_id, dow, COUNT(*) AS k, SUM(x) AS sx, SUM(n) AS sn, SUM(x * x) AS sxx, SUM(x * n) AS sxn FROM ({series}) AS s1 WHERE NOT held GROUP BY vehicle_id, dow"
    whole = ", ".join(f"SUM({c}) OVER (PARTITION BY vehicle_id) AS t{c}" for c in ("k", "sx", "sn", "sxx", "sxn"))
    slope = f"SELECT *, COALESCE({d.div('tk * tsxn - tsx * tsn', 'tk * tsxx - tsx * tsx')}, 0) AS b FROM (SELECT *, {whole} FROM ({sums}) AS g) AS w"
    fit = f"SELECT vehicle_id, dow, b, (tsn - b * tsx) / tk AS a, (sn - k * ((tsn - b * tsx) / tk) - b * sx) / k AS season FROM ({slope}) AS sl"
    line = f"SELECT vehicle_id, MIN(a) AS a, MIN(b) AS b FROM ({fit}) AS f1 GROUP BY vehicle_id"
    guess = f"SELECT h.vehicle_id, h.day, h.n, l.a + l.b * h.x + COALESCE(f.season, 0) AS f FROM (SELECT * FROM ({series}) AS s2 WHERE held) AS h JOIN ({line}) AS l ON h.vehicle_id = l.vehicle_id LEFT JOIN ({fit}) AS f ON h.vehicle_id = f.vehicle_id AND h.dow = f.dow"
    over = "OVER (PARTITION BY vehicle_id)"
    return f"SELECT vehicle_id, day, n AS actual, {d.r4('f')} AS forecast, {d.r4(f'AVG(ABS(n - f)) {over}')} AS mae, {d.r4(f'AVG((n - f) * (n - f)) {over}')} AS mse FROM ({guess}) AS p"


@op("n23_business_insights", "readings")
def business_insights(d):
    """Risk factors, possible savings and their advice, as rows."""
    row = lambda k, c, cost, text: f"SELECT '{k}' AS insight, {d.r4(d.share(c))} AS percent_of_readings, COUNT(DISTINCT CASE WHEN {c} THEN vehicle_id END) AS vehicles, {d.r2(f'{n_if(c)} * {cost}')} AS cost_implication, '{text}' AS recommendation FROM readings"
    return " UNION ALL ".join([
        row("overheating", "engine_temperature_c > 110", 5, "Inspect cooling systems"), row("speeding", "speed_kmh > 100", 2, "Coach drivers on speed"),
        row("low battery", "battery_voltage < 11.8", 1.5, "Test batteries"), row("low fuel", "fuel_level_percent < 15", 0.5, "Plan refuelling"), row("low tyre pressure", "tire_pressure_psi < 30", 1, "Check tyres"),
    ])


@op("n24_key_metrics", "readings")
def key_metrics(d):
    """One row for the dashboard."""
    return f"SELECT COUNT(DISTINCT vehicle_id) AS vehicles, COUNT(*) AS readings, {d.r4('AVG(speed_kmh)')} AS avg_speed, {d.r4('AVG(engine_temperature_c)')} AS avg_temperature, {d.r4(d.share('engine_temperature_c > 110'))} AS overheating_percent, {d.r4(f'AVG({INSTANT})')} AS avg_efficiency, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM readings"


@op("n24_daily_series", "readings")
def daily_series(d):
    """The day's readings, speeds, heat and events, for charts."""
    return f"SELECT CAST(ts AS DATE) AS day, COUNT(*) AS readings, COUNT(DISTINCT vehicle_id) AS vehicles, {d.r4('AVG(speed_kmh)')} AS avg_speed, {d.r4('AVG(engine_temperature_c)')} AS avg_temperature, {n_if('speed_kmh > 100')} AS speeding FROM readings GROUP BY CAST(ts AS DATE)"


@op("n24_vehicle_stats", "readings")
def vehicle_stats(d):
    """Each vehicle's means, weekly trend and level of risk."""
    risk = "CASE WHEN {r} > 30 THEN 'High' WHEN {r} > 15 THEN 'Medium' ELSE 'Low' END".format(r=d.r4(d.share("engine_temperature_c > 110 OR speed_kmh > 120")))
    return f"SELECT vehicle_id, COUNT(*) AS readings, {d.r4('AVG(speed_kmh)')} AS avg_speed, {d.r4('MAX(odometer_km)')} AS odometer_km, {d.r4('10000 - MAX(odometer_km) + floor(MAX(odometer_km) / 10000) * 10000')} AS km_to_maintenance, {d.r4(f'REGR_SLOPE(speed_kmh, CAST({d.seconds(d.ts("2024-01-01"), "ts")} AS DOUBLE) / 604800)')} AS weekly_trend, {risk} AS risk_level FROM readings GROUP BY vehicle_id HAVING COUNT(*) > 2"


def motion(d) -> str:
    gap = f"NULLIF({d.seconds(f'LAG(ts) OVER ({BY_TIME})', 'ts')}, 0)"
    return f"SELECT *, {d.r6(f'(speed_kmh - LAG(speed_kmh) OVER ({BY_TIME})) / {gap}')} AS acceleration, speed_kmh > 5 AS is_moving, LAG(speed_kmh) OVER ({BY_TIME}) > 5 AS was_moving FROM readings"


@op("n25_motion_features", "readings")
def motion_features(d):
    """Acceleration in km/h a second, whether it moves, and the class of speed."""
    return f"SELECT {ROW}, acceleration, is_moving, {banded('speed_kmh', [('<= 5', "'stopped'"), ('<= 50', "'city'"), ('<= 90', "'rural'"), ('<= 130', "'highway'")], "'excessive'")} AS speed_category FROM ({motion(d)}) AS m"


@op("n25_detect_events", "readings")
def detect_events(d):
    """Starts, stops, harsh moves and speeding."""
    one = lambda name, c: f"SELECT {ROW}, '{name}' AS event, speed_kmh FROM m WHERE {c}"
    return f"WITH m AS ({motion(d)}) " + " UNION ALL ".join([one("start", "is_moving AND NOT was_moving"), one("stop", "NOT is_moving AND was_moving"), one("harsh_braking", "acceleration < -3"), one("harsh_acceleration", "acceleration > 3"), one("speeding", "speed_kmh > 120")])


@op("n26_safety_score", "readings")
def safety_score(d):
    """Harsh events, shares of driving patterns, and a safety score out of 100."""
    counts = {"harsh_acceleration": "acceleration_x > 4", "harsh_braking": "acceleration_x < -4", "sharp_turns": "ABS(acceleration_y) > 4", "speeding": "speed_kmh > 120"}
    lost = " + ".join(f"{n_if(c)} * {p}" for c, p in zip(counts.values(), (30, 40, 20, 50)))
    return f"SELECT vehicle_id, COUNT(*) AS readings, {', '.join(f'{n_if(c)} AS {k}' for k, c in counts.items())}, {d.r4(d.share('speed_kmh < 1'))} AS idle_percent, {d.r4(d.share('speed_kmh >= 1 AND speed_kmh < 50'))} AS city_percent, {d.r4(d.share('speed_kmh >= 50'))} AS highway_percent, {d.r4(f'GREATEST(CAST(0 AS DOUBLE), 100 - CAST({lost} AS DOUBLE) / COUNT(*))')} AS safety_score FROM readings GROUP BY vehicle_id"


@op("w11_rolling_zscore", "readings")
def rolling_zscore(d, size=100, least=10, limit=2):
    """Speeds against the mean and population deviation of up to 100 values before, from ten on; the value itself is left out."""
    w = f"OVER ({BY_TIME} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    z = d.r6("ABS(speed_kmh - m) / s")
    return f"""SELECT {ROW}, speed_kmh AS value, {d.r6('m')} AS mean, {d.r6('s')} AS std, {z} AS z_score, {d.r6(f'LEAST(CAST(1 AS DOUBLE), {z} / 6)')} AS anomaly_score, {banded(z, [('> 5', "'critical'"), ('> 4', "'high'"), ('> 3', "'medium'")], "'low'")} AS severity
FROM (SELECT *, AVG(speed_kmh) {w} AS m, STDDEV_POP(speed_kmh) {w} AS s, COUNT(*) {w} AS n FROM readings) AS r WHERE n >= {least} AND s > 0 AND {z} > {limit}"""


@op("w15_sessionize", "readings")
def sessionize(d, gap_s=900):
    """Sessions of a vehicle: a pause over 15 minutes begins a new one; with their statistics."""
    return f"""SELECT vehicle_id, session, COUNT(*) AS readings, MIN(ts) AS started, MAX(ts) AS ended, {d.seconds('MIN(ts)', 'MAX(ts)')} AS seconds, {d.r6('AVG(speed_kmh)')} AS avg_speed, MAX(speed_kmh) AS max_speed, {d.r6('MAX(odometer_km) - MIN(odometer_km)')} AS distance_km
FROM (SELECT *, CAST(SUM(CASE WHEN {d.seconds('before', 'ts')} <= {gap_s} THEN 0 ELSE 1 END) OVER ({BY_TIME} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM (SELECT *, LAG(ts) OVER ({BY_TIME}) AS before FROM readings) AS l) AS s GROUP BY vehicle_id, session"""


@op("w18_generate_alerts", "readings")
def generate_alerts(d):
    """Alerts from a reading and the trend over its last eleven."""
    w = f"OVER ({BY_TIME} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)"
    rules = [("ENGINE_OVERHEATING", "CRITICAL", "engine_temperature_c > 125"), ("TEMPERATURE_RISE", "HIGH", "heat_rise > 30"), ("LOW_FUEL", "MEDIUM", "fuel_level_percent < 5"), ("EXCESSIVE_SPEED", "HIGH", "speed_kmh > 150"), ("BATTERY", "MEDIUM", "mean_voltage < 11.8")]
    which = lambda k: "CASE " + " ".join(f"WHEN {r[2]} THEN '{r[k]}'" for r in rules) + " END"
    return f"SELECT {ROW}, {which(0)} AS alert_type, {which(1)} AS priority, heat_rise, mean_voltage FROM (SELECT *, {d.r6(f'engine_temperature_c - FIRST_VALUE(engine_temperature_c) {w}')} AS heat_rise, {d.r6(f'AVG(battery_voltage) {w}')} AS mean_voltage FROM readings) AS r WHERE {' OR '.join(r[2] for r in rules)}"


# Alert, column, test, seconds it must hold.
SUSTAINED = (
    ("HighEngineTemperature", "engine_temperature_c", "> 120", 300), ("CriticalEngineTemperature", "engine_temperature_c", "> 140", 120), ("LowFuelLevel", "fuel_level_percent", "< 15", 600),
    ("CriticalFuelLevel", "fuel_level_percent", "< 5", 300), ("LowBatteryVoltage", "battery_voltage", "< 12.0", 300), ("CriticalBatteryVoltage", "battery_voltage", "< 11.0", 120),
    ("LowOilPressure", "oil_pressure_kpa", "< 150", 180), ("CriticalOilPressure", "oil_pressure_kpa", "< 100", 60), ("PoorFuelEfficiency", "speed_kmh / fuel_consumption_lph", "< 8", 1800),
    ("HighFaultRate", "faults / 300.0", "> 0.1", 120), ("MultipleCriticalFaults", "faults", "> 5", 60),
)


@op("w24_sustained_alerts", "readings", given={"time_scale": 60})
def sustained_alerts(d, stale_s=300, time_scale=1):
    """Conditions that hold for a time: runs of readings without a break, or a pause over `stale_s`; readings stand `time_scale` times closer.

    Faults are the error events of the last five minutes (by the same scale): over 0.1 a second, or over five, is an alert too.
    """
    rows = " UNION ALL ".join(f"SELECT vehicle_id, event_id, ts, '{n}' AS alert, {x} {t} AS holds, {s} AS need FROM counted" for n, x, t, s in SUSTAINED)
    at = d._("unix_seconds(CAST(ts AS TIMESTAMP))", "CAST(floor(epoch(ts)) AS BIGINT)")
    counted = f"SELECT *, COUNT(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY vehicle_id ORDER BY at_s RANGE BETWEEN {300 * time_scale} PRECEDING AND CURRENT ROW) AS faults FROM (SELECT *, {at} AS at_s FROM readings) AS r"
    gap = f"{d.seconds('before', 'ts')} / {time_scale}"
    return f"""WITH counted AS ({counted}) SELECT vehicle_id, alert, MIN(ts) AS since, MAX(ts) AS until, COUNT(*) AS readings, MAX(need) AS required_s FROM (SELECT *, SUM(CASE WHEN was AND {gap} <= {stale_s} THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_id, alert ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM
(SELECT *, LAG(ts) OVER (PARTITION BY vehicle_id, alert ORDER BY ts, event_id) AS before, LAG(holds) OVER (PARTITION BY vehicle_id, alert ORDER BY ts, event_id) AS was FROM ({rows}) AS u) AS l WHERE holds) AS i GROUP BY vehicle_id, alert, island HAVING {d.seconds('MIN(ts)', 'MAX(ts)')} / {time_scale} >= MAX(need)"""


#: Seconds of the short and of the long roll-up.
ROLLUP_S = (18000, 86400)


@op("w25_rollup_over_time", "readings")
def rollup_over_time(d):
    """Range roll-ups behind each reading: mean and maximum over a window of time, and new errors in it."""
    short, day = ROLLUP_S
    at = d._("unix_seconds(CAST(ts AS TIMESTAMP))", "CAST(floor(epoch(ts)) AS BIGINT)")
    w = lambda s: f"OVER (PARTITION BY vehicle_id ORDER BY at_s RANGE BETWEEN {s} PRECEDING AND CURRENT ROW)"
    return f"SELECT {ROW}, {d.r6(f'AVG(speed_kmh) {w(short)}')} AS speed_avg, MAX(speed_kmh) {w(short)} AS speed_max, {d.r6(f'AVG(fuel_level_percent) {w(day)}')} AS fuel_avg, COUNT(CASE WHEN event_type = 'error' THEN 1 END) {w(day)} AS errors FROM (SELECT *, {at} AS at_s FROM readings) AS r"


@op("u4_detect_anomaly", "readings")
def detect_anomaly(d, size=20):
    """A value against a list of values before it, in higher-order functions over the list."""
    w = f"OVER ({BY_TIME} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    total = d._("aggregate(h, CAST(0 AS DOUBLE), (a, x) -> a + x)", "list_sum(h)")
    squares = d._("aggregate(h, CAST(0 AS DOUBLE), (a, x) -> a + x * x)", "list_sum(list_transform(h, lambda x: x * x))")
    n = d._("CAST(size(h) AS DOUBLE)", "CAST(len(h) AS DOUBLE)")
    collect = d._(f"collect_list(speed_kmh) {w}", f"list(speed_kmh) {w}")
    return f"SELECT {ROW}, {d.r4('m')} AS mean, {d.r4('s')} AS std, {d.r4('ABS(speed_kmh - m) / NULLIF(s, 0)')} AS z_score, {d.r4('ABS(speed_kmh - m) / NULLIF(s, 0)')} > 3 AS is_anomaly FROM (SELECT *, SQRT(GREATEST(sq / NULLIF(n, 0) - m * m, CAST(0 AS DOUBLE))) AS s FROM (SELECT *, total / NULLIF(n, 0) AS m FROM (SELECT {ROW}, speed_kmh, {n} AS n, {total} AS total, {squares} AS sq FROM (SELECT {ROW}, speed_kmh, {collect} AS h FROM readings) AS c) AS q WHERE n >= 10) AS m1) AS z WHERE s > 0.001"


@op("u5_degradation", "readings")
def degradation(d):
    """First against last value of each vehicle, and the slope over its readings."""
    return f"SELECT vehicle_id, {d.r6('(MIN_BY(speed_kmh, nth) - MAX_BY(speed_kmh, nth)) / NULLIF(MIN_BY(speed_kmh, nth), 0) * 100')} AS degradation_percent, {d.r6('REGR_SLOPE(speed_kmh, nth)')} AS slope FROM (SELECT *, CAST(ROW_NUMBER() OVER ({BY_TIME}) AS DOUBLE) AS nth FROM readings) AS r GROUP BY vehicle_id HAVING COUNT(*) > 2"


# What a reading's columns may hold.
VALID = {"speed_kmh": (0, 300), "engine_temperature_c": (-50, 150), "fuel_level_percent": (0, 100), "rpm": (0, 10000)}


@op("w20_valid_events", "readings", given={"max_age_s": 86400 * 20})
def valid_events(d, now=AS_OF_READINGS, max_age_s=3600, ranges=None):
    """Events with what is wrong with them, if anything: a missing vehicle, kind or time, an age over max_age_s, a value out of its range."""
    bounds = " OR ".join(f"{c} < {low} OR {c} > {high}" for c, (low, high) in (VALID if ranges is None else ranges).items()) or "FALSE"
    missing = "vehicle_id IS NULL OR ts IS NULL OR event_type IS NULL OR event_type = ''"
    return f"SELECT {ROW}, CASE WHEN {missing} THEN 'missing field' WHEN {d.seconds('ts', d.ts(now))} > {max_age_s} THEN 'too old' WHEN {bounds} THEN 'out of range' END AS quarantine_reason FROM readings"
