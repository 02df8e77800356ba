"""Queries over daily series: features, baselines, metrics and intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from granary.functions.numbers import rounded
from granary.operators import series as s
from granary.plans.market import FAULTY, RESOLVED, faulty
from granary.plans.registry import query
from granary.sources import prices as p

DAILY = f"""{RESOLVED},
series AS (
  SELECT mandi_id, commodity, reported_date, floor(median(modal_price) * 10000 + 0.5) / 10000 AS price, CASE WHEN count(min_price) = count(*) THEN min(min_price) END AS min_price, CASE WHEN count(max_price) = count(*) THEN max(max_price) END AS max_price,
         CASE WHEN count(arrival_quantity) = count(*) AND count(DISTINCT arrival_unit) = 1 THEN floor(sum(arrival_quantity) * 10000 + 0.5) / 10000 END AS arrivals, bool_or(is_sample) AS is_sample, count(*) AS contributing, min(source) AS source
  FROM resolved WHERE modal_price > 0 GROUP BY mandi_id, commodity, reported_date)"""
W = "PARTITION BY mandi_id, commodity ORDER BY reported_date"
PART = "PARTITION BY mandi_id, commodity"
BASE = f"""{DAILY},
numbered AS (SELECT *, row_number() OVER ({W}) AS place, count(*) OVER ({PART}) AS n FROM series),
split AS (SELECT *, CASE WHEN place <= floor(n * 0.6) THEN 'train' WHEN place <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS part FROM numbered),
ahead AS (
  SELECT mandi_id, commodity, reported_date, part, lag(price) OVER ({W}) AS last_value, CASE WHEN count(price) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7 THEN floor(avg(price) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) * 10000 + 0.5) / 10000 END AS mean_7,
         {", ".join(f"lead(price, {h - 1}) OVER ({W}) AS a{h}" for h in s.HORIZONS)} FROM split),
base AS (
  SELECT mandi_id, commodity, reported_date, part, horizon, actual, last_value, mean_7, last_value AS before FROM (
    {" UNION ALL ".join(f"SELECT mandi_id, commodity, reported_date, part, {h} AS horizon, a{h} AS actual, last_value, mean_7 FROM ahead" for h in s.HORIZONS)})
  WHERE actual IS NOT NULL AND last_value IS NOT NULL AND mean_7 IS NOT NULL)"""
MEAN = lambda x: f"(sum(CAST(floor({x} * 1e6 + 0.5) AS BIGINT)) / count({x}) / 1e6)"
R = lambda x, n: f"floor(({x}) * {float(10**n)} + 0.5) / {float(10**n)}"


def metrics_sql(p: str) -> str:
    return f"""count(*) AS n, {R(MEAN(f"abs(actual - {p})"), 3)} AS mae, {R(f"sqrt({MEAN(f'((actual - {p}) * (actual - {p}))')})", 3)} AS rmse, CASE WHEN min(actual) > 0 THEN {R(MEAN(f"(CASE WHEN actual > 0 THEN abs(actual - {p}) / actual END)") + " * 100", 3)} END AS mape,
  {R(MEAN(f"(CASE WHEN abs(actual) + abs({p}) > 0 THEN 2 * abs(actual - {p}) / (abs(actual) + abs({p})) END)") + " * 100", 3)} AS smape, {R(MEAN(f"({p} - actual)"), 3)} AS bias,
  CASE WHEN count(*) FILTER (WHERE actual <> before) > 0 THEN {R(f"count(*) FILTER (WHERE actual <> before AND sign(actual - before) = sign({p} - before)) * 100.0 / count(*) FILTER (WHERE actual <> before)", 1)} END AS direction"""


def bands_sql(p: str, where: str) -> str:
    q = lambda x: f"quantile_cont(ln(actual / {p}), {x})"
    return f"""SELECT mandi_id, commodity, horizon, count(*) AS n, CASE WHEN count(*) >= 5 THEN {q(0.5)} ELSE 0.0 END AS "offset", CASE WHEN count(*) >= 5 THEN {q(0.1)} - {q(0.5)} ELSE -0.16 END AS low, CASE WHEN count(*) >= 5 THEN {q(0.9)} - {q(0.5)} ELSE 0.16 END AS high
  FROM base WHERE actual > 0 AND {p} > 0 AND {where} GROUP BY mandi_id, commodity, horizon"""


FORECASTS = f"""{BASE},
bands AS ({bands_sql("mean_7", "part = 'validation'")}),
recent AS (SELECT *, row_number() OVER (PARTITION BY mandi_id, commodity ORDER BY reported_date DESC) AS k FROM series),
tail AS (
  SELECT mandi_id, commodity, {R("(sum(CAST(floor(price * 10000 + 0.5) AS BIGINT)) / count(*) / 10000)", 4)} AS predicted, max(reported_date) AS last_date, arg_max(price, reported_date) AS last_price, bool_or(is_sample) AS is_sample
  FROM recent WHERE k <= 7 GROUP BY mandi_id, commodity HAVING count(*) = 7),
forecasts AS (
  SELECT tail.mandi_id AS mandi_id, tail.commodity AS commodity, horizon, last_date, last_price, last_date + CAST(horizon AS INTEGER) AS forecast_date, predicted, {R("predicted * exp(low)", 2)} AS lower, {R("predicted * exp(high)", 2)} AS upper,
         {R("least(100.0 / (1 + (exp(high) - exp(low))) * least(1.0, n / 30.0) * greatest(1 - 0.06 * (horizon - 1), 0.4), 90.0)", 2)} AS confidence, is_sample
  FROM tail JOIN bands ON bands.mandi_id = tail.mandi_id AND bands.commodity = tail.commodity)"""


def daily(spark, d):
    return s.daily(p.observations(spark, d))


@query(f"WITH {DAILY} SELECT * FROM series")
def daily_series(spark, d):
    return daily(spark, d)


@query(f"WITH {FAULTY}, {RESOLVED.replace('FROM obs', 'FROM faulty')}, days AS (SELECT mandi_id, commodity, reported_date, count(*) FILTER (WHERE modal_price > 0) AS valid, count(*) AS n FROM resolved GROUP BY ALL) SELECT mandi_id, commodity, CAST(sum(CASE WHEN valid = 0 THEN n ELSE 0 END) AS BIGINT) AS dropped FROM days GROUP BY mandi_id, commodity")
def dropped_days(spark, d):
    return s.dropped_days(faulty(spark, d))


@query(f"WITH {DAILY} SELECT mandi_id, commodity, count(*) AS days, min(reported_date) AS first_date, max(reported_date) AS last_date, bool_and(is_sample) AS all_samples FROM series GROUP BY mandi_id, commodity HAVING count(*) >= 21")
def series_catalogue(spark, d):
    return s.catalogue(daily(spark, d))


@query(f"""WITH {DAILY}, g AS (SELECT *, date_diff('day', lag(reported_date) OVER ({W}), reported_date) AS gap FROM series)
SELECT mandi_id, commodity, count(*) AS days, count(*) FILTER (WHERE gap <> 1) AS irregular_gaps, CAST(max(gap) AS INTEGER) AS longest_gap, {R("avg(gap)", 3)} AS mean_gap, {R("count(arrivals) / count(*)", 4)} AS arrival_coverage FROM g GROUP BY mandi_id, commodity""")
def gap_report(spark, d):
    return s.gap_report(daily(spark, d))


@query(f"WITH {DAILY} SELECT commodity, count(*) AS n, min(price) AS lowest, {R('quantile_cont(price, 0.05)', 1)} AS p5, {R('quantile_cont(price, 0.5)', 1)} AS median, {R('quantile_cont(price, 0.95)', 1)} AS p95, max(price) AS highest FROM series GROUP BY commodity")
def series_stats(spark, d):
    return s.describe(daily(spark, d))


@query(f"""WITH {DAILY}, m AS (SELECT commodity, CAST(month(reported_date) AS INTEGER) AS month, sum(CAST(floor(price * 10000 + 0.5) AS BIGINT)) AS s, count(*) AS n FROM series GROUP BY 1, 2)
SELECT commodity, month, {R("(s / n) / (sum(s) OVER (PARTITION BY commodity) / sum(n) OVER (PARTITION BY commodity))", 2)} AS index FROM m""")
def seasonal_index(spark, d):
    return s.seasonal_index(daily(spark, d))


@query(f"WITH {DAILY} SELECT mandi_id, commodity, reported_date, {', '.join(f'lag(price, {k}) OVER ({W}) AS lag_{k}' for k in s.LAGS)} FROM series")
def lag_features(spark, d):
    return s.with_features(daily(spark, d)).select(*s.DAY, *[f"lag_{k}" for k in s.LAGS])


def rolling(x: str, n: int) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(price) {frame} = {n} THEN {x} {frame} END"


@query(f"""WITH {DAILY}, f AS (SELECT mandi_id, commodity, reported_date, {rolling("avg(price)", 7)} AS mean_7, {rolling("avg(price)", 14)} AS mean_14, {rolling("stddev_pop(price)", 7)} AS std_7, lag(price, 1) OVER ({W}) AS l1, lag(price, 8) OVER ({W}) AS l8 FROM series)
SELECT mandi_id, commodity, reported_date, {R("mean_7", 3)} AS mean_7, {R("mean_14", 3)} AS mean_14, {R("std_7", 3)} AS std_7, {R("CASE WHEN l8 <> 0 THEN (l1 - l8) / l8 END", 4)} AS change_7, {R("l1 - mean_14", 3)} AS deviation FROM f""")
def rolling_features(spark, d):
    out = s.with_features(daily(spark, d))
    return out.select(*s.DAY, *[rounded(F.col(c), n).alias(c) for c, n in (("mean_7", 3), ("mean_14", 3), ("std_7", 3), ("change_7", 4), ("deviation", 3))])


@query(f"""WITH {DAILY}, n AS (SELECT mandi_id, commodity, reported_date, {", ".join(f"lag(price, {k}) OVER ({W}) AS l{k}" for k in range(1, 8))} FROM series)
SELECT mandi_id, commodity, reported_date, {R("(3 * (l1 - l7) + 2 * (l2 - l6) + (l3 - l5)) / 28", 3)} AS slope_7 FROM n""")
def slope_feature(spark, d):
    return s.with_features(daily(spark, d)).select(*s.DAY, rounded(F.col("slope_7"), 3).alias("slope_7"))


@query(f"""WITH {DAILY}, c AS (SELECT DISTINCT reported_date AS d, CAST(isodow(reported_date) - 1 AS INTEGER) AS weekday, CAST(month(reported_date) AS INTEGER) AS month, CAST(dayofyear(reported_date) AS INTEGER) AS day_of_year, CAST(dayofyear(make_date(year(reported_date), 12, 31)) AS INTEGER) AS days FROM series)
SELECT d AS reported_date, weekday, month, day_of_year, {R("sin(weekday / 7.0 * 2 * 3.141592653589793)", 4)} AS weekday_sin, {R("cos(month / 12.0 * 2 * 3.141592653589793)", 4)} AS month_cos, {R("sin(day_of_year / days * 2 * 3.141592653589793)", 4)} AS year_sin FROM c""")
def calendar_features(spark, d):
    days = daily(spark, d).select("reported_date").distinct()
    return s.with_calendar(days, F.col("reported_date")).select("reported_date", "weekday", "month", "day_of_year", *[rounded(F.col(c), 4).alias(c) for c in ("weekday_sin", "month_cos", "year_sin")])


@query(f"""WITH {DAILY}, f AS (SELECT mandi_id, commodity, reported_date, lag(arrivals) OVER ({W}) AS last, last_value(arrivals IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS earlier FROM series)
SELECT mandi_id, commodity, reported_date, {R("CASE WHEN last IS NOT NULL THEN coalesce(last - earlier, 0.0) END", 4)} AS arrival_change FROM f""")
def arrival_change(spark, d):
    return s.with_features(daily(spark, d)).select(*s.DAY, rounded(F.col("arrival_change"), 4).alias("arrival_change"))


@query(f"""WITH {DAILY}, f AS (SELECT mandi_id, commodity, reported_date, count(arrivals) OVER ({PART}) / count(*) OVER ({PART}) AS coverage, lag(arrivals, 1) OVER ({W}) AS a1, lag(arrivals, 7) OVER ({W}) AS a7,
  CASE WHEN count(arrivals) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) = 7 THEN avg(arrivals) OVER ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) END AS m7, last_value(arrivals IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS earlier FROM series)
SELECT mandi_id, commodity, reported_date, {R("coverage", 4)} AS coverage, a1 AS arrival_lag_1, a7 AS arrival_lag_7, {R("m7", 4)} AS arrival_mean_7, {R("coalesce(a1 - earlier, 0.0)", 4)} AS arrival_change FROM f WHERE coverage >= 0.8 AND a1 IS NOT NULL AND a7 IS NOT NULL AND m7 IS NOT NULL""")
def arrival_features(spark, d):
    out = s.arrival_features(daily(spark, d))
    return out.select(*s.DAY, "arrival_lag_1", "arrival_lag_7", *[rounded(F.col(c), 4).alias(c) for c in ("coverage", "arrival_mean_7", "arrival_change")])


@query(f"""WITH {DAILY}, f AS (SELECT mandi_id, commodity, reported_date, row_number() OVER ({W}) AS place, lag(price, 1) OVER ({W}) AS lag_1, lag(price, 8) OVER ({W}) AS l8, lag(price, 14) OVER ({W}) AS lag_14, {rolling("avg(price)", 14)} AS mean_14, lead(price, 2) OVER ({W}) AS target, lead(reported_date, 2) OVER ({W}) AS target_date FROM series)
SELECT mandi_id, commodity, reported_date, place, lag_1, lag_14, {R("mean_14", 3)} AS mean_14, target, target_date FROM f WHERE place > 14 AND lag_14 IS NOT NULL AND mean_14 IS NOT NULL AND target IS NOT NULL AND l8 <> 0""")
def training_matrix(spark, d):
    return s.training_matrix(daily(spark, d), 3).select(*s.DAY, "place", "lag_1", "lag_14", rounded(F.col("mean_14"), 3).alias("mean_14"), "target", "target_date")


@query(f"""WITH {DAILY}, f AS (SELECT mandi_id, commodity, reported_date, row_number() OVER ({W}) AS place, count(arrivals) OVER ({PART}) / count(*) OVER ({PART}) >= 0.8 AS has_arrivals, lag(price, 1) OVER ({W}) AS lag_1, lag(price, 8) OVER ({W}) AS l8, lag(price, 14) OVER ({W}) AS lag_14,
  lead(price, 6) OVER ({W}) AS target, lead(reported_date, 6) OVER ({W}) AS target_date, lag(arrivals, 1) OVER ({W}) AS a1, lag(arrivals, 7) OVER ({W}) AS a7, {rolling("avg(arrivals)", 7).replace("count(price)", "count(arrivals)")} AS m7, last_value(arrivals IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS earlier FROM series)
SELECT mandi_id, commodity, reported_date, has_arrivals, lag_1, target, target_date, CASE WHEN has_arrivals THEN a1 END AS arrival_lag_1, CASE WHEN has_arrivals THEN a7 END AS arrival_lag_7, CASE WHEN has_arrivals THEN {R("m7", 4)} END AS arrival_mean_7, CASE WHEN has_arrivals THEN {R("coalesce(a1 - earlier, 0.0)", 4)} END AS arrival_change
FROM f WHERE place > 14 AND lag_14 IS NOT NULL AND target IS NOT NULL AND l8 <> 0 AND (NOT has_arrivals OR (a1 IS NOT NULL AND a7 IS NOT NULL AND m7 IS NOT NULL))""")
def arrival_matrix(spark, d):
    """The matrix of horizon 7 with the arrival features of the series that the gate lets through."""
    out = s.training_matrix(daily(spark, d), 7, arrivals=True)
    return out.select(*s.DAY, "has_arrivals", "lag_1", "target", "target_date", "arrival_lag_1", "arrival_lag_7", *[rounded(F.col(c), 4).alias(c) for c in ("arrival_mean_7", "arrival_change")])


@query(f"WITH {BASE} SELECT mandi_id, commodity, part, count(*) AS days, min(reported_date) AS first_date, max(reported_date) AS last_date FROM split GROUP BY mandi_id, commodity, part")
def chrono_split(spark, d):
    return s.chronological_split(daily(spark, d)).groupBy(*s.SERIES, "part").agg(F.count("*").alias("days"), F.min("reported_date").alias("first_date"), F.max("reported_date").alias("last_date"))


@query(f"WITH {BASE} SELECT mandi_id, commodity, reported_date, horizon, actual, last_value, {R('mean_7', 2)} AS mean_7 FROM base WHERE part = 'test'")
def baselines(spark, d):
    return s.baselines(daily(spark, d)).filter("part = 'test'").select(*s.DAY, "horizon", "actual", "last_value", rounded(F.col("mean_7")).alias("mean_7"))


@query(f"WITH {BASE} SELECT 'last_value' AS model, horizon, {metrics_sql('last_value')} FROM base WHERE part = 'test' GROUP BY horizon UNION ALL SELECT 'mean_7' AS model, horizon, {metrics_sql('mean_7')} FROM base WHERE part = 'test' GROUP BY horizon")
def forecast_metrics(spark, d):
    rows = s.baselines(daily(spark, d)).filter("part = 'test'")
    return reduce(lambda a, b: a.unionByName(b), [s.metrics(rows, m).withColumn("model", F.lit(m)) for m in ("last_value", "mean_7")])


@query(f"WITH {BASE}, e AS (SELECT mandi_id, commodity, 'last_value' AS model, {MEAN('abs(actual - last_value)')} AS mae FROM base WHERE part = 'validation' GROUP BY ALL UNION ALL SELECT mandi_id, commodity, 'mean_7', {MEAN('abs(actual - mean_7)')} FROM base WHERE part = 'validation' GROUP BY ALL) SELECT mandi_id, commodity, arg_min(model, {{'m': mae, 'n': model}}) AS model, {R('min(mae)', 3)} AS mae FROM e GROUP BY mandi_id, commodity")
def model_selection(spark, d):
    rows = s.baselines(daily(spark, d)).filter("part = 'validation'")
    errors = rows.groupBy(*s.SERIES).agg(*[s.exact_mean(F.abs(F.col("actual") - F.col(m))).alias(m) for m in ("last_value", "mean_7")]).unpivot([*s.SERIES], ["last_value", "mean_7"], "model", "mae")
    return s.best_model(errors, s.SERIES).withColumn("mae", rounded(F.col("mae"), 3))


@query(f"WITH {BASE}, b AS ({bands_sql('mean_7', chr(34) + 'part' + chr(34) + chr(61) + chr(39) + 'validation' + chr(39))}) SELECT mandi_id, commodity, horizon, n, {R('offset_', 4)} AS \"offset\", {R('low', 4)} AS low, {R('high', 4)} AS high FROM (SELECT *, \"offset\" AS offset_ FROM b)".replace('"part"=', "part = "))
def interval_quantiles(spark, d):
    out = s.intervals(s.baselines(daily(spark, d)).filter("part = 'validation'"), "mean_7")
    return out.select(*s.SERIES, "horizon", "n", *[rounded(F.col(c), 4).alias(c) for c in ("offset", "low", "high")])


@query(f"""WITH {BASE}, bands AS ({bands_sql("mean_7", "part = 'validation'")})
SELECT base.horizon AS horizon, count(*) AS n, {R("count(*) FILTER (WHERE ln(actual / mean_7) BETWEEN low - 1e-12 AND high + 1e-12) / count(*)", 4)} AS coverage
FROM base JOIN bands ON base.mandi_id = bands.mandi_id AND base.commodity = bands.commodity AND base.horizon = bands.horizon WHERE part = 'test' GROUP BY base.horizon""")
def interval_coverage(spark, d):
    return s.coverage(s.baselines(daily(spark, d)), "mean_7")


@query(f"WITH {FORECASTS} SELECT * FROM forecasts")
def latest_forecasts(spark, d):
    return s.forecasts(daily(spark, d))


@query(f"""WITH {DAILY}, per AS (SELECT commodity, reported_date, sum(CAST(floor(price * 10000 + 0.5) AS BIGINT)) / count(*) / 10000.0 AS price FROM series GROUP BY commodity, reported_date),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY reported_date DESC) AS k FROM per) WHERE k <= 30)
SELECT commodity, count(*) AS days, {R(MEAN("price"), 2)} AS average, {R("min(price)", 2)} AS least, {R("max(price)", 2)} AS most, {R("(arg_max(price, reported_date) - arg_min(price, reported_date)) / abs(arg_min(price, reported_date)) * 100", 1)} AS change_percent FROM r GROUP BY commodity HAVING count(*) >= 2""")
def price_trend(spark, d):
    return s.trend_summary(daily(spark, d))
