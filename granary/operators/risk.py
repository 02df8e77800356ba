"""Risk of each series from its forecasts, past prices, arrivals and age: five factors, then one level. One grouped plan for all series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numbers import rounded
from granary.operators.market import SERIES, stale_days
from granary.operators.series import by_day, exact_mean

# Thresholds of the levels.
DROP = {"high": (10.0, 18.0), "moderate": (4.0, 10.0)}  # projected, worst case, percent
VOLATILITY = {"high": (15.0, 8.0, 4.0), "moderate": (7.0, 4.0, 2.0)}  # swing, variation, deviation of returns, percent
LEAST_PRICES, LEAST_ARRIVALS = 5, 4
SURGE = {"high": 1.40, "moderate": 1.15}
WIDTH = {"high": (22.0, 60.0), "moderate": (12.0, 78.0)}  # mean width in percent, confidence
AGE = {"low": 3, "moderate": 7}


def level(known: Column, high: Column, moderate: Column) -> Column:
    return F.when(~known, "UNKNOWN").when(high, "HIGH").when(moderate, "MODERATE").otherwise("LOW")


def _drops(now: Column) -> list[Column]:
    """Aggregates over a series' forecasts, given its price now."""
    good = (F.col("predicted") > 0) & (now > 0)
    drop, worst = (F.when(good, rounded((now - x) / now * 100)) for x in (F.col("predicted"), F.coalesce("lower", "predicted")))
    floor = lambda x: F.when(F.max(x).isNotNull(), F.greatest(F.max(x), F.lit(0.0)))
    return [floor(drop).alias("max_drop"), floor(worst).alias("worst_drop"), F.max(F.when(drop > 0, F.struct(drop.alias("drop"), -F.col("horizon")))).alias("at")]


def _decline() -> Column:
    over = lambda k: (F.col("max_drop") >= DROP[k][0]) | (F.col("worst_drop") >= DROP[k][1])
    return level(F.col("max_drop").isNotNull(), over("high"), over("moderate"))


def price_decline(latest: DataFrame, forecasts: DataFrame) -> DataFrame:
    """The largest projected drop over the horizons (0 at least; the first horizon of equal ones) and the worst case by the lower bounds."""
    told = latest.select(*SERIES, F.col("price").alias("_now")).join(forecasts, [*SERIES], "left").groupBy(*SERIES).agg(*_drops(F.col("_now")))
    return told.select(*SERIES, "max_drop", "worst_drop", (-F.col("at.col2")).alias("worst_horizon"), _decline().alias("decline"))


def _with_returns(series: DataFrame) -> DataFrame:
    before = F.lag("price").over(by_day())
    return series.withColumn("return", F.when(before != 0, (F.col("price") - before) / before * 100))


def _spread() -> list[Column]:
    deviation = F.stddev_samp("price") / F.avg("price") * 100
    return [F.count("*").alias("days"), rounded(deviation).alias("variation"), rounded(F.max(F.abs("return"))).alias("max_swing"), rounded(F.stddev_samp("return")).alias("return_deviation")]


def _volatility() -> Column:
    any_of = lambda k: (F.col("max_swing") >= VOLATILITY[k][0]) | (F.col("variation") >= VOLATILITY[k][1]) | (F.col("return_deviation") >= VOLATILITY[k][2])
    return level(F.col("days") >= LEAST_PRICES, any_of("high"), any_of("moderate"))


def volatility(series: DataFrame) -> DataFrame:
    """Variation of prices, the largest daily swing and the deviation of daily returns, in percent; unknown below LEAST_PRICES days."""
    by = _with_returns(series).groupBy(*SERIES).agg(*_spread())
    return by.select(*SERIES, "days", "variation", "max_swing", "return_deviation", _volatility().alias("volatility"))


def _arrived() -> list[Column]:
    some = F.col("arrivals") > 0
    return [F.count_if(some).alias("reports"), F.max(F.when(some, F.struct("reported_date", "arrivals")))["arrivals"].alias("last"), F.sum(F.when(some, F.col("arrivals"))).alias("total")]


def _ratio() -> Column:
    return F.when(F.col("reports") >= LEAST_ARRIVALS, rounded(F.col("last") / ((F.col("total") - F.col("last")) / (F.col("reports") - 1))))


def _surge(ratio: Column) -> Column:
    return level(ratio.isNotNull(), ratio >= SURGE["high"], ratio >= SURGE["moderate"])


def arrival_surge(series: DataFrame) -> DataFrame:
    """The latest arrivals against the mean of the earlier ones; unknown below LEAST_ARRIVALS days with arrivals. Series without arrivals have no row."""
    some = series.groupBy(*SERIES).agg(*_arrived()).filter("reports > 0")
    return some.withColumn("ratio", _ratio()).select(*SERIES, "reports", "ratio", _surge(F.col("ratio")).alias("surge"))


def _bands() -> list[Column]:
    """Aggregates over a series' forecasts that have both bounds."""
    good = F.col("predicted").isNotNull() & F.col("lower").isNotNull() & F.col("upper").isNotNull()
    width = (F.col("upper") - F.col("lower")) / F.when(F.col("predicted") != 0, F.col("predicted")).otherwise(1.0) * 100
    return [F.count_if(good).alias("bounded"), rounded(exact_mean(F.when(good, width)), 1).alias("width"), rounded(exact_mean(F.when(good, F.col("confidence"))), 1).alias("mean_confidence")]


def _uncertainty() -> Column:
    wide = lambda k: (F.col("width") >= WIDTH[k][0]) | F.coalesce(F.col("mean_confidence") < WIDTH[k][1], F.lit(False))
    return level(F.col("width").isNotNull(), wide("high"), wide("moderate"))


def uncertainty(forecasts: DataFrame) -> DataFrame:
    """Mean width of the bounds in percent and mean confidence. Series without bounds have no row."""
    by = forecasts.groupBy(*SERIES).agg(*_bands()).filter("bounded > 0")
    return by.select(*SERIES, "width", "mean_confidence", _uncertainty().alias("uncertainty"))


def _fresh(age: Column) -> Column:
    return level(age.isNotNull(), age > AGE["moderate"], age > AGE["low"])


def freshness(latest: DataFrame, today: str) -> DataFrame:
    age = stale_days(F.col("reported_date"), today)
    return latest.select(*SERIES, age.alias("age"), _fresh(age).alias("freshness"))


FACTORS = ("decline", "volatility", "surge", "uncertainty", "freshness")


def overall(rows: DataFrame) -> DataFrame:
    """One level of the five factors, and warnings."""
    f = {k: F.coalesce(F.col(k), F.lit("UNKNOWN")) for k in FACTORS}
    unknown = sum((f[k] == "UNKNOWN").cast("int") for k in FACTORS)
    one = (
        F.when(((f["decline"] == "UNKNOWN") & (f["volatility"] == "UNKNOWN")) | (unknown >= 4), "UNKNOWN")
        .when((f["decline"] == "HIGH") | (f["surge"] == "HIGH"), "HIGH")
        .when((f["decline"] == "MODERATE") | (f["volatility"] == "HIGH") | (f["surge"] == "MODERATE") | (f["freshness"] == "HIGH"), "MODERATE")
        .when((f["decline"] == "LOW") & (f["volatility"] == "LOW") & (f["freshness"] == "LOW"), "LOW")
        .when(unknown > 0, "MODERATE")
        .otherwise("LOW")
    )
    codes = (("freshness", "STALE_DATA"), ("surge", "SUPPLY_GLUT"), ("decline", "PRICE_DROP_ALERT"), ("volatility", "HIGH_VOLATILITY"), ("uncertainty", "HIGH_UNCERTAINTY"))
    warnings = F.array_join(F.array_compact(F.array(*[F.when(f[k] == "HIGH", F.lit(code)) for k, code in codes])), ",")
    return rows.select(*SERIES, *[f[k].alias(k) for k in FACTORS], one.alias("overall"), warnings.alias("warnings"))


def last_rows(series: DataFrame) -> DataFrame:
    w = Window.partitionBy(*SERIES).orderBy(F.col("reported_date").desc())
    return series.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def profile(series: DataFrame, forecasts: DataFrame, today: str) -> DataFrame:
    """All five factors and the level of each series: one grouping of its days, one join with its forecasts, one grouping of those.

    All of it is by series, so rows are dealt once on each side.
    """
    facts = _with_returns(series).groupBy(*SERIES).agg(F.max_by("price", "reported_date").alias("_now"), F.max("reported_date").alias("_day"), *_spread(), *_arrived())
    facts = facts.select(*SERIES, F.struct("_now", _volatility().alias("volatility"), _surge(_ratio()).alias("surge"), _fresh(stale_days(F.col("_day"), today)).alias("freshness")).alias("f"))
    told = facts.join(forecasts.select(*SERIES, "horizon", "predicted", "lower", "upper", "confidence"), [*SERIES], "left")
    out = told.groupBy(*SERIES).agg(F.first("f").alias("f"), *_drops(F.col("f._now")), *_bands())
    return overall(out.select(*SERIES, _decline().alias("decline"), "f.volatility", "f.surge", _uncertainty().alias("uncertainty"), "f.freshness"))


def summary(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("overall").agg(F.count("*").alias("series"))
