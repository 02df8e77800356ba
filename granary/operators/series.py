"""Daily price series and what models are made of: collapse, gaps, features, splits, baselines, metrics and intervals.

A series is a market and commodity; lags count reporting days, not calendar days. Everything is a window over
(series, day), so all series are worked on at once, and a feature at a row only sees rows before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numbers import rounded
from granary.operators.market import DAY, SERIES, resolved

HORIZONS = range(1, 8)
LAGS = (1, 2, 3, 7, 14)
#: Rows before a feature row, and observations that a series needs to be trained on.
HISTORY, LEAST_TRAINED = 14, 21
SPLIT = (0.6, 0.2)
#: Interval level 80 %: log residuals between these quantiles; least number of residuals; half width without any.
LOW, HIGH, LEAST_RESIDUALS, FALLBACK = 0.1, 0.9, 5, 0.16


def by_day() -> Window:
    return Window.partitionBy(*SERIES).orderBy("reported_date")


def daily(obs: DataFrame) -> DataFrame:
    """One row for each market-day of the best source: median price; lowest and highest only if all rows have them; arrivals only if all have
    them in one unit; whether any row is a sample; the number of rows. Rows without a positive price don't count."""
    rows = resolved(obs).filter(F.col("modal_price") > 0)
    whole = lambda c: F.count(c) == F.count("*")
    return rows.groupBy(*DAY).agg(
        rounded(F.median("modal_price"), 4).alias("price"), F.when(whole("min_price"), F.min("min_price")).alias("min_price"), F.when(whole("max_price"), F.max("max_price")).alias("max_price"),
        F.when(whole("arrival_quantity") & (F.count_distinct("arrival_unit") == 1), rounded(F.sum("arrival_quantity"), 4)).alias("arrivals"), F.bool_or("is_sample").alias("is_sample"), F.count("*").alias("contributing"), F.min("source").alias("source"),
    )


def dropped_days(obs: DataFrame) -> DataFrame:
    """Rows in days without any valid row, by series."""
    valid = F.count_if(F.coalesce(F.col("modal_price") > 0, F.lit(False)))
    return resolved(obs).groupBy(*DAY).agg(valid.alias("valid"), F.count("*").alias("n")).groupBy(*SERIES).agg(F.sum(F.when(F.col("valid") == 0, F.col("n")).otherwise(0)).alias("dropped"))


def catalogue(series: DataFrame, least: int = LEAST_TRAINED) -> DataFrame:
    return series.groupBy(*SERIES).agg(F.count("*").alias("days"), F.min("reported_date").alias("first_date"), F.max("reported_date").alias("last_date"), F.bool_and("is_sample").alias("all_samples")).filter(F.col("days") >= least)


def gap_report(series: DataFrame) -> DataFrame:
    gap = F.datediff("reported_date", F.lag("reported_date").over(by_day()))
    return series.withColumn("gap", gap).groupBy(*SERIES).agg(
        F.count("*").alias("days"), F.count_if(F.col("gap") != 1).alias("irregular_gaps"), F.max("gap").alias("longest_gap"), rounded(F.avg("gap"), 3).alias("mean_gap"), rounded(F.count("arrivals") / F.count("*"), 4).alias("arrival_coverage")
    )


def describe(series: DataFrame) -> DataFrame:
    p = F.percentile("price", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = series.groupBy("commodity").agg(F.count("*").alias("n"), F.min("price").alias("lowest"), p.alias("p"), F.max("price").alias("highest"))
    return out.select("commodity", "n", "lowest", *[rounded(F.col("p")[k], 1).alias(n) for k, n in enumerate(("p5", "median", "p95"))], "highest")


def seasonal_index(series: DataFrame) -> DataFrame:
    """Mean price of each month against the commodity's mean."""
    cents = F.floor(F.col("price") * 10000 + 0.5)
    month = series.groupBy("commodity", F.month("reported_date").alias("month")).agg(F.sum(cents).alias("s"), F.count("*").alias("n"))
    whole = Window.partitionBy("commodity")
    return month.select("commodity", "month", rounded((F.col("s") / F.col("n")) / (F.sum("s").over(whole) / F.sum("n").over(whole)), 2).alias("index"))


def with_features(series: DataFrame) -> DataFrame:
    """Lags, rolling mean, deviation and slope, change over 7 reports, change of arrivals, and calendar of the row's own day; null where the past is too short."""
    w = by_day()
    past = lambda n: w.rowsBetween(-n, -1)
    full = lambda n, x: F.when(F.count("price").over(past(n)) == n, x.over(past(n)))
    place = F.row_number().over(w)
    out = series.withColumn("place", place)
    for k in LAGS:
        out = out.withColumn(f"lag_{k}", F.lag("price", k).over(w))
    out = out.withColumn("mean_7", full(7, F.avg("price"))).withColumn("mean_14", full(14, F.avg("price"))).withColumn("std_7", full(7, F.stddev_pop("price")))
    # The least-squares slope of 7 evenly spaced points is a fixed combination of them.
    back = lambda k: F.lag("price", k).over(w)
    out = out.withColumn("slope_7", (3 * (back(1) - back(7)) + 2 * (back(2) - back(6)) + (back(3) - back(5))) / 28)
    base = F.lag("price", 8).over(w)
    out = out.withColumn("change_7", F.when(base != 0, (F.col("lag_1") - base) / base)).withColumn("deviation", F.col("lag_1") - F.col("mean_14"))
    earlier = F.last("arrivals", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -2))
    last = F.lag("arrivals", 1).over(w)
    out = out.withColumn("arrival_change", F.when(last.isNotNull(), F.coalesce(last - earlier, F.lit(0.0))))
    return with_calendar(out, F.col("reported_date"))


#: Share of a series' days that must have arrivals for them to be features.
LEAST_COVERAGE = 0.8


ARRIVALS = ("arrival_lag_1", "arrival_lag_7", "arrival_mean_7", "arrival_change")


def with_arrivals(rows: DataFrame) -> DataFrame:
    """Feature rows with the share of their series' days that have arrivals (coverage), arrivals 1 and 7 reports before and the mean of the 7 before; a
    day without arrivals among the 7 leaves no mean."""
    w, whole = by_day(), Window.partitionBy(*SERIES)
    seven = w.rowsBetween(-7, -1)
    return rows.withColumns({
        "coverage": F.count("arrivals").over(whole) / F.count("price").over(whole), "arrival_lag_1": F.lag("arrivals", 1).over(w), "arrival_lag_7": F.lag("arrivals", 7).over(w),
        "arrival_mean_7": F.when(F.count("arrivals").over(seven) == 7, F.avg("arrivals").over(seven)),
    })


def gated(rows: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """Rows with has_arrivals: whether their series' coverage is at least least. Such rows need all arrival features, or are left out; others have none."""
    passed = F.col("coverage") >= least
    whole = F.array_size(F.array_compact(F.array(*ARRIVALS))) == len(ARRIVALS)
    return rows.withColumn("has_arrivals", passed).filter(~passed | whole).withColumns({c: F.when(passed, F.col(c)) for c in ARRIVALS})


def arrival_features(series: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """Arrival features and the change from the report before the last that had any, of the series that the gate lets through."""
    return gated(with_arrivals(with_features(series)), least).filter("has_arrivals").select(*DAY, "coverage", *ARRIVALS)


def with_calendar(df: DataFrame, day: Column) -> DataFrame:
    days = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    turn = lambda x, n: (x / n) * 2 * 3.141592653589793
    out = df.withColumn("weekday", F.weekday(day)).withColumn("month", F.month(day)).withColumn("day_of_year", F.dayofyear(day))
    for name, x, n in (("weekday", F.weekday(day), F.lit(7.0)), ("month", F.month(day), F.lit(12.0)), ("year", F.dayofyear(day), days)):
        out = out.withColumn(f"{name}_sin", F.sin(turn(x, n))).withColumn(f"{name}_cos", F.cos(turn(x, n)))
    return out


FEATURES = (*[f"lag_{k}" for k in LAGS], "mean_7", "mean_14", "std_7", "slope_7", "change_7", "deviation")
CALENDAR = ("weekday_sin", "weekday_cos", "month_sin", "month_cos", "year_sin", "year_cos")


def training_matrix(series: DataFrame, horizon: int, arrivals: bool = False) -> DataFrame:
    """Feature rows with the price horizon - 1 reports later as target, without rows that lack any; the calendar is that of the target's day.

    With arrivals, series whose coverage is enough have the arrival features as well.
    """
    w = by_day()
    rows = with_features(series).withColumn("target", F.lead("price", horizon - 1).over(w)).withColumn("target_date", F.lead("reported_date", horizon - 1).over(w))
    rows = with_calendar(with_arrivals(rows) if arrivals else rows, F.col("target_date")).withColumn("horizon", F.lit(horizon))
    rows = rows.filter(F.col("place") > HISTORY).dropna(subset=[*FEATURES, "target"])
    return gated(rows) if arrivals else rows


def chronological_split(series: DataFrame) -> DataFrame:
    """part: train, validation or test, by whole shares of each series in order of days."""
    w = Window.partitionBy(*SERIES)
    out = series.withColumn("place", F.row_number().over(by_day())).withColumn("n", F.count("*").over(w))
    a, b = F.floor(F.col("n") * SPLIT[0]), F.floor(F.col("n") * sum(SPLIT))
    return out.withColumn("part", F.when(F.col("place") <= a, "train").when(F.col("place") <= b, "validation").otherwise("test"))


def days_ahead(series: DataFrame, horizons=HORIZONS, *also: str) -> DataFrame:
    """Each day as the last known one before it, and each horizon: the actual price, the last value and the mean of 7 before, where they are known."""
    w = by_day()
    mean = F.when(F.count("price").over(w.rowsBetween(-7, -1)) == 7, F.avg("price").over(w.rowsBetween(-7, -1)))
    out = chronological_split(series).withColumn("last_value", F.lag("price", 1).over(w)).withColumn("mean_7", rounded(mean, 4)).withColumn("before", F.lag("price", 1).over(w))
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("price", h - 1).over(w).alias("actual")) for h in horizons])
    out = out.withColumn("ahead", ahead).select(*SERIES, "reported_date", "part", "last_value", "mean_7", "before", *also, F.explode("ahead").alias("a"))
    return out.select(*SERIES, "reported_date", "part", "a.horizon", "a.actual", "last_value", "mean_7", "before", *also)


def baselines(series: DataFrame, horizons=HORIZONS) -> DataFrame:
    """For each day as the last known one before it, and each horizon: the actual price, the last value and the mean of 7 before."""
    return days_ahead(series, horizons).dropna(subset=["actual", "last_value", "mean_7"])


MICRO = 1e6


def exact_mean(x: Column) -> Column:
    """A mean over whole millionths, which adds up to the same in any order."""
    return F.sum(F.floor(x * MICRO + 0.5).cast("decimal(28,0)")).cast("double") / F.count(x) / MICRO


def metrics(rows: DataFrame, predicted: str, keys: tuple[str, ...] = ("horizon",)) -> DataFrame:
    """mae, rmse, mape (null if any actual isn't positive), smape, bias and direction (percent right, flat steps left out)."""
    a, p = F.col("actual"), F.col(predicted)
    moved = (a != F.col("before"))
    right = F.signum(a - F.col("before")) == F.signum(p - F.col("before"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), rounded(exact_mean(F.abs(a - p)), 3).alias("mae"), rounded(F.sqrt(exact_mean((a - p) * (a - p))), 3).alias("rmse"),
        F.when(F.min("actual") > 0, rounded(exact_mean(F.when(a > 0, F.abs(a - p) / a)) * 100, 3)).alias("mape"), rounded(exact_mean(F.when(F.abs(a) + F.abs(p) > 0, 2 * F.abs(a - p) / (F.abs(a) + F.abs(p)))) * 100, 3).alias("smape"),
        rounded(exact_mean(p - a), 3).alias("bias"), F.when(F.count_if(moved) > 0, rounded(F.count_if(moved & right) * 100.0 / F.count_if(moved), 1)).alias("direction"),
    )


def band(n: Column, q: Column) -> tuple[Column, Column, Column]:
    """offset, low and high of n log residuals with quantiles q: about their median, or of the fallback width with too few of them."""
    enough = n >= LEAST_RESIDUALS
    return F.when(enough, q[1]).otherwise(0.0), F.when(enough, q[0] - q[1]).otherwise(-FALLBACK), F.when(enough, q[2] - q[1]).otherwise(FALLBACK)


def quantiles(residual: Column) -> Column:
    return F.percentile(residual, F.array(F.lit(LOW), F.lit(0.5), F.lit(HIGH)))


def intervals(rows: DataFrame, predicted: str, keys: tuple[str, ...] = (*SERIES, "horizon")) -> DataFrame:
    """low and high: quantiles of the log residuals less their median (offset); the fallback width with too few residuals."""
    r = F.ln(F.col("actual") / F.col(predicted))
    good = rows.filter((F.col("actual") > 0) & (F.col(predicted) > 0)).withColumn("r", r)
    out = good.groupBy(*keys).agg(F.count("*").alias("n"), quantiles(F.col("r")).alias("q"))
    return out.select(*keys, "n", *[c.alias(name) for c, name in zip(band(F.col("n"), F.col("q")), ("offset", "low", "high"))])


def confidence(width: Column, n: Column, horizon: Column, most: float = 90.0) -> Column:
    """Less for wide bands, few residuals and far horizons."""
    return F.least(100.0 / (1 + width) * F.least(F.lit(1.0), n / 30.0) * F.greatest(1 - 0.06 * (horizon - 1), F.lit(0.4)), F.lit(most))


def forecasts(series: DataFrame) -> DataFrame:
    """For each series and horizon the mean of its last 7 days, with bounds from the residuals that the same rule had on the validation days.

    One pass: every day carries the mean of the 7 that end with it, and the last day's is the forecast. All windows and the grouping are by series.
    """
    seven = by_day().rowsBetween(-6, 0)
    mean = rounded(F.sum(F.floor(F.col("price") * 10000 + 0.5)).over(seven) / F.count("*").over(seven) / 10000.0, 4)
    now = F.struct("reported_date", "price", F.count("*").over(seven).alias("days"), mean.alias("predicted"), F.max("is_sample").over(seven).alias("is_sample"))
    actual, past = F.col("actual"), F.col("mean_7")
    residual = F.when((F.col("part") == "validation") & F.col("last_value").isNotNull() & (actual > 0) & (past > 0), F.ln(actual / past))
    out = days_ahead(series.withColumn("now", now), HORIZONS, "now").groupBy(*SERIES, "horizon").agg(F.count(residual).alias("n"), quantiles(residual).alias("q"), F.max("now").alias("now"))
    _, low, high = band(F.col("n"), F.col("q"))
    out = out.filter("n > 0 AND now.days = 7").select(*SERIES, "horizon", "n", "now.*", low.alias("low"), high.alias("high"))
    return out.select(
        *SERIES, "horizon", F.col("reported_date").alias("last_date"), F.col("price").alias("last_price"), F.expr("date_add(reported_date, horizon)").alias("forecast_date"), "predicted",
        rounded(F.col("predicted") * F.exp("low")).alias("lower"), rounded(F.col("predicted") * F.exp("high")).alias("upper"), rounded(confidence(F.exp("high") - F.exp("low"), F.col("n"), F.col("horizon")), 2).alias("confidence"), "is_sample",
    )


def coverage(rows: DataFrame, predicted: str) -> DataFrame:
    """The share of test days whose price lies in the band fitted on the validation days."""
    bands = intervals(rows.filter("part = 'validation'"), predicted).drop("n")
    test = rows.filter("part = 'test'").join(bands, [*SERIES, "horizon"])
    inside = F.ln(F.col("actual") / F.col(predicted)).between(F.col("low") - 1e-12, F.col("high") + 1e-12)
    return test.groupBy("horizon").agg(F.count("*").alias("n"), rounded(F.count_if(inside) / F.count("*"), 4).alias("coverage"))


def best_model(scores: DataFrame, keys: tuple[str, ...] = ("horizon",)) -> DataFrame:
    """Of rows (keys, model, mae) the model of least error; ties by name."""
    return scores.groupBy(*keys).agg(F.min(F.struct("mae", "model")).alias("b")).select(*keys, F.col("b.model").alias("model"), F.col("b.mae").alias("mae"))


def trend_summary(series: DataFrame, days: int = 30) -> DataFrame:
    """Of each commodity's last reporting days (2 or more): mean per day over the markets, then average, least, most and change in percent."""
    per_day = series.groupBy("commodity", "reported_date").agg((F.sum(F.floor(F.col("price") * 10000 + 0.5)) / F.count("*") / 10000.0).alias("price"))
    w = Window.partitionBy("commodity").orderBy(F.col("reported_date").desc())
    recent = per_day.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= days)
    first, last = F.min_by("price", "reported_date"), F.max_by("price", "reported_date")
    return recent.groupBy("commodity").agg(
        F.count("*").alias("days"), rounded(exact_mean(F.col("price"))).alias("average"), rounded(F.min("price")).alias("least"), rounded(F.max("price")).alias("most"), F.when(first != 0, rounded((last - first) / F.abs(first) * 100, 1)).alias("change_percent")
    ).filter("days >= 2")
