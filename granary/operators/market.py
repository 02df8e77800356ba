"""Reads of market prices: filters, latest rows, history pages, listings, source resolution, trends and status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numbers import mean_of_hundredths, percent_change

SERIES = ("mandi_id", "commodity")
DAY = (*SERIES, "reported_date")


def where(obs: DataFrame, **asked) -> DataFrame:
    """Rows that fulfil everything asked. Text is compared without case; None asks nothing; market is a name or a number.

    commodity, category, variety, grade, state, district, mandi, market_code, source, quality_status: equal.
    is_sample: the flag. start, end: dates, inclusive. search: part of commodity or market, taken literally.
    """
    tests: list[Column] = []
    for name, value in asked.items():
        if value is None:
            continue
        if name == "market":
            number = int(value) if str(value).isdigit() else None
            same = F.lower("mandi") == str(value).lower()
            tests.append(same | (F.col("mandi_id") == number) if number is not None else same)
        elif name == "start":
            tests.append(F.col("reported_date") >= F.to_date(F.lit(value)))
        elif name == "end":
            tests.append(F.col("reported_date") <= F.to_date(F.lit(value)))
        elif name == "is_sample":
            tests.append(F.col("is_sample") == F.lit(value))
        elif name == "search":
            tests.append(F.contains(F.lower("commodity"), F.lit(value.lower())) | F.contains(F.lower("mandi"), F.lit(value.lower())))
        elif name in obs.columns:
            tests.append(F.lower(name) == str(value).lower())
        else:
            raise ValueError(f"no such filter: {name}")
    return obs.filter(reduce(lambda a, b: a & b, tests)) if tests else obs


def genuine(obs: DataFrame, level: str = "source") -> DataFrame:
    """Rows that aren't samples. "source": by flag and source name; "usable": also with a unit and a positive price; "clean": also without a synthetic flag."""
    out = obs.filter(~F.col("is_sample") & ~F.col("source").rlike("(?i)MOCK|FIXTURE|SYNTHETIC"))
    if level in ("usable", "clean"):
        out = out.filter(F.col("price_unit").isNotNull() & (F.col("modal_price") > 0))
    return out.filter(~F.array_contains("quality_flags", "SYNTHETIC_SAMPLE")) if level == "clean" else out


def first_rows(df: DataFrame, keys: tuple[str, ...], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each key in an order that leaves no ties; each task passes on no more than n of a key."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")


def latest(obs: DataFrame, keys: tuple[str, ...] = (*SERIES, "variety"), n: int = 1) -> DataFrame:
    """The newest report of each key; of one day, the greatest id."""
    return first_rows(obs, keys, F.col("reported_date").desc(), F.col("observation_id").desc(), n=n)


def newest_page(obs: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return obs.orderBy(F.col("reported_date").desc(), F.col("observation_id").desc()).offset(offset).limit(limit)


def resolved(obs: DataFrame) -> DataFrame:
    """All rows of each market-day's best source (precedence, then name), with the number of rows of all its sources."""
    day = Window.partitionBy(*DAY)
    rank = F.dense_rank().over(day.orderBy(F.col("precedence").desc(), F.col("source").asc()))
    return obs.withColumn("rows_of_day", F.count("*").over(day)).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_day(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Every row of each key's last day."""
    return df.withColumn("_last", F.max("reported_date").over(Window.partitionBy(*keys))).filter("reported_date = _last").drop("_last")


def latest_resolved(obs: DataFrame) -> DataFrame:
    """All rows of the best source on each series' last day. Every day has a best source, so the last day is taken first: other days' rows are never ranked, and what is left lies where its day is judged."""
    return resolved(latest_day(obs))


def current_prices(obs: DataFrame) -> DataFrame:
    """Each market with the reports of the best source on the last day of each of its commodities, in the order of commodity, variety and grade (null first)."""
    row = F.struct("commodity", "variety", "grade", "observation_id", "reported_date", "modal_price", "source")
    return latest_resolved(obs).groupBy("mandi_id", "mandi").agg(F.array_sort(F.collect_list(row)).alias("current_prices"))


PREVIOUS_KEYS = ("source", *SERIES, "variety", "grade")


def with_previous(df: DataFrame, history: DataFrame) -> DataFrame:
    """previous_price and previous_date: the last report strictly before the row's day, of the same source, series, variety and grade.

    Nulls in variety and grade are equal to each other. Where a day has several reports, the highest counts. The history is collapsed
    to one row a day before LAG, so no join by inequality is needed.
    """
    daily = history.groupBy(*PREVIOUS_KEYS, "reported_date").agg(F.max("modal_price").alias("_price"))
    order = Window.partitionBy(*PREVIOUS_KEYS).orderBy("reported_date")
    lagged = daily.select(*[F.col(k).alias(f"_{k}") for k in (*PREVIOUS_KEYS, "reported_date")], F.lag("_price").over(order).alias("previous_price"), F.lag("reported_date").over(order).alias("previous_date"))
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"_{k}")) for k in (*PREVIOUS_KEYS, "reported_date")])
    return df.join(lagged, same, "left").drop(*[f"_{k}" for k in (*PREVIOUS_KEYS, "reported_date")])


def with_trend(df: DataFrame, price: str = "modal_price", previous: str = "previous_price") -> DataFrame:
    """trend_percent (one digit) and trend: up, down, stable, or none without a previous price."""
    change = percent_change(F.col(previous), F.col(price))
    direction = F.when(change.isNull(), "none").when(change > 0, "up").when(change < 0, "down").otherwise("stable")
    return df.withColumn("trend_percent", change).withColumn("trend", direction)


def commodity_listing(obs: DataFrame) -> DataFrame:
    return obs.groupBy("commodity", "category").agg(
        F.count_distinct("variety").alias("varieties"), F.count_distinct("state").alias("states"), F.count("*").alias("records"), F.min("reported_date").alias("first_date"), F.max("reported_date").alias("last_date")
    )


def market_listing(obs: DataFrame) -> DataFrame:
    return obs.groupBy("state", "district", "mandi_id", "mandi").agg(
        F.max("market_code").alias("market_code"), F.count_distinct("commodity").alias("commodities"), F.count("*").alias("records"), F.min("reported_date").alias("first_date"), F.max("reported_date").alias("last_date")
    )


def stale_days(day: Column, today: str) -> Column:
    """Days from a date to today, never below 0; null if the date is."""
    return F.when(day.isNotNull(), F.greatest(F.datediff(F.to_date(F.lit(today)), day), F.lit(0)))


def source_status(obs: DataFrame, registry: DataFrame, today: str, fresh_days: int = 3) -> DataFrame:
    """Counts and freshness of every registered source, without rows too; stale beyond fresh_days or without data."""
    seen = obs.groupBy("source").agg(F.count("*").alias("records"), F.count_distinct("mandi_id").alias("markets"), F.count_distinct("commodity").alias("commodities"), F.max("reported_date").alias("last_date"))
    age = stale_days(F.col("last_date"), today)
    return registry.join(seen, "source", "left").select("source", "precedence", "is_sample", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "markets", "commodities")], "last_date", age.alias("stale_days"), (age.isNull() | (age > fresh_days)).alias("stale"))


def overall_status(obs: DataFrame) -> DataFrame:
    return obs.agg(
        F.count("*").alias("records"), F.count_if(~F.col("is_sample")).alias("genuine"), F.count_if("is_sample").alias("samples"), F.count_distinct("mandi_id").alias("markets"), F.count_distinct("commodity").alias("commodities"),
        F.count_distinct("source").alias("sources"), F.min("reported_date").alias("first_date"), F.max("reported_date").alias("last_date"),
    )


def national_reports(obs: DataFrame) -> DataFrame:
    """The mean price of a commodity on each day over all markets, in whole hundredths."""
    return obs.groupBy("commodity", "reported_date").agg(mean_of_hundredths(F.col("modal_price")).alias("price"), F.sum("arrival_quantity").alias("arrivals"), F.count("*").alias("reports"))


def with_previous_report(reports: DataFrame) -> DataFrame:
    """The report before, of those that are there: what a date filter removed doesn't count."""
    order = Window.partitionBy("commodity").orderBy("reported_date")
    return with_trend(reports.withColumn("previous_price", F.lag("price").over(order)).withColumn("previous_date", F.lag("reported_date").over(order)), "price")


def in_pairs(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose (mandi_id, commodity) is among the pairs."""
    return obs.join(pairs.select(*SERIES).distinct(), [*SERIES], "left_semi")


def matching_identity(obs: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of rows with equal series, day, variety and grade, where nulls are equal."""
    keys = (*DAY, "variety", "grade")
    right = other.select(F.col("observation_id").alias("other_id"), *[F.col(k).alias(f"_{k}") for k in keys], F.col("modal_price").alias("other_price"))
    return obs.join(right, reduce(lambda a, b: a & b, [obs[k].eqNullSafe(right[f"_{k}"]) for k in keys])).select("observation_id", "other_id", "modal_price", "other_price")


def redacted(text: Column, most: int = 200) -> Column:
    """Values of keys, tokens, secrets and passwords blanked, and the text cut."""
    return F.substring(F.regexp_replace(text, r"(?i)(api[-_]?key|token|secret|password)=[^\s&]+", "$1=[redacted]"), 1, most)
