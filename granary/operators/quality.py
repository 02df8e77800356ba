"""Data-quality reports: integrity, gaps, duplicates, overlaps and profiles. Every section is one aggregate over the observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numbers import rounded
from granary.operators.market import DAY

PROFILED = ("state", "district", "mandi", "market_code", "commodity", "variety", "grade", "min_price", "max_price", "arrival_quantity", "arrival_unit")
IDENTITY = ("source", *DAY, "variety", "grade")


def integrity(obs: DataFrame, today: str) -> DataFrame:
    p = F.col("modal_price")
    return obs.agg(
        F.count("*").alias("records"), F.count_if(p <= 0).alias("modal_not_positive"), F.count_if(F.col("min_price") > F.col("max_price")).alias("min_above_max"), F.count_if((p < F.col("min_price")) | (p > F.col("max_price"))).alias("modal_outside"),
        F.count_if(F.col("arrival_quantity").isNull()).alias("arrivals_missing"), F.count_if(F.col("arrival_quantity") < 0).alias("arrivals_negative"), F.count_if(F.col("reported_date") > F.to_date(F.lit(today))).alias("future_dated"),
        F.count_if(F.col("price_unit") != "INR/quintal").alias("unit_unknown"), F.count_if(F.col("grade").isNull()).alias("grade_missing"),
    )


def missing_profile(obs: DataFrame, columns: tuple[str, ...] = PROFILED) -> DataFrame:
    """missing and percent (two digits; null without rows) of each column, counted in one pass."""
    counts = obs.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot("_n", list(columns), "field", "missing").select("field", "missing", F.when(F.col("_n") > 0, rounded(F.col("missing") * 100.0 / F.col("_n"))).alias("percent"))


def duplicate_groups(obs: DataFrame) -> DataFrame:
    return obs.groupBy(*IDENTITY).agg(F.count("*").alias("copies")).filter("copies > 1")


def duplicate_summary(obs: DataFrame) -> DataFrame:
    return duplicate_groups(obs).agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def overlap_groups(obs: DataFrame) -> DataFrame:
    """Market-days with more than one source."""
    return obs.groupBy(*DAY).agg(F.count_distinct("source").alias("sources"), F.count("*").alias("records")).filter("sources > 1")


def overlap_pairs(obs: DataFrame) -> DataFrame:
    """In how many market-days two sources meet. A market-day has few sources, so its pairs are made from a set, without a self join."""
    sets = obs.groupBy(*DAY).agg(F.array_sort(F.collect_set("source")).alias("s")).filter(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("source_a"), b.alias("source_b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.source_a", "p.source_b").agg(F.count("*").alias("market_days"))


def distinct_tuples(obs: DataFrame) -> DataFrame:
    """Distinct identities, with those that have a null in them."""
    return obs.agg(F.count_distinct(F.struct(*DAY, "variety", "grade")).alias("identities"), F.count_distinct(F.struct(*DAY)).alias("market_days"))


def flag_histogram(obs: DataFrame, most: int = 20) -> DataFrame:
    return obs.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "flag").limit(most)


def top(obs: DataFrame, key: str, most: int = 10) -> DataFrame:
    return obs.groupBy(key).agg(F.count("*").alias("records"), F.max("reported_date").alias("last_date")).orderBy(F.desc("records"), key).limit(most)


def by_year(obs: DataFrame) -> DataFrame:
    return obs.groupBy(F.year("reported_date").alias("year")).agg(F.count("*").alias("records"), F.count_if(~F.col("is_sample")).alias("genuine"))


def year_gaps(obs: DataFrame, keys: tuple[str, ...] = ("mandi_id", "commodity", "variety")) -> DataFrame:
    """Years without a report between the first and the last of each key."""
    spans = obs.groupBy(*keys).agg(F.sort_array(F.collect_set(F.year("reported_date"))).alias("have"))
    return spans.select(*keys, F.explode(F.array_except(F.sequence(F.array_min("have"), F.array_max("have")), "have")).alias("year"))


def arrivals_coverage(obs: DataFrame) -> DataFrame:
    return obs.groupBy("commodity").agg(F.count("*").alias("records"), F.count("arrival_quantity").alias("with_arrivals"), rounded(F.count("arrival_quantity") * 100.0 / F.count("*")).alias("percent"))


def dimension_counts(obs: DataFrame) -> DataFrame:
    return obs.agg(*[F.count_distinct(c).alias(f"{c}_count") for c in ("state", "district", "mandi", "market_code", "commodity", "category", "variety", "grade")])


def source_coverage(obs: DataFrame, registry: DataFrame) -> DataFrame:
    seen = obs.groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.col("quality_status") == "FLAGGED").alias("flagged"), F.count_distinct("mandi_id").alias("markets"), F.min("reported_date").alias("first_date"), F.max("reported_date").alias("last_date"))
    return registry.select("source", "precedence").join(seen, "source", "left")


def sync_health(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source").agg(
        F.count("*").alias("runs"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("SUCCESS", "PARTIAL_SUCCESS", "FAILED")], F.coalesce(F.sum("records_fetched"), F.lit(0)).alias("fetched"), rounded(F.avg("records_fetched"), 1).alias("mean_fetched"),
        F.max(F.when(F.col("status") == "SUCCESS", F.col("synced_on"))).alias("last_success"),
    )


def last_failures(runs: DataFrame, most: int = 5) -> DataFrame:
    from granary.operators.market import redacted

    return runs.filter("status = 'FAILED'").orderBy(F.desc("synced_on"), F.desc("run_id")).limit(most).select("run_id", "source", "synced_on", redacted(F.col("message")).alias("message"))


def freshness_summary(obs: DataFrame, today: str) -> DataFrame:
    from granary.operators.market import stale_days

    last = F.max(F.when(~F.col("is_sample"), F.col("reported_date")))
    return obs.groupBy("commodity").agg(F.count_if(~F.col("is_sample")).alias("genuine"), F.count_if("is_sample").alias("samples"), last.alias("last_genuine"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).withColumn("stale_days", stale_days(F.col("last_genuine"), today))


def rows_per_source_of_day(obs: DataFrame) -> DataFrame:
    return obs.withColumn("rows_in_source", F.count("*").over(Window.partitionBy(*DAY, "source")))


def sync_states(runs: DataFrame) -> DataFrame:
    """For each source its last run, how that ended, and its last success."""
    newest = F.struct("synced_on", "run_id")
    return runs.groupBy("source").agg(F.max_by("run_id", newest).alias("last_run"), F.max_by("status", newest).alias("last_status"), F.max(F.when(F.col("status") == "SUCCESS", F.col("synced_on"))).alias("last_success"))


def sources_with_states(registry: DataFrame, runs: DataFrame, today: str, fresh_days: int = 3) -> DataFrame:
    """Every registered source with its state; due if its last success is older than fresh_days, or there is none."""
    from granary.operators.market import stale_days

    age = stale_days(F.col("last_success"), today)
    out = registry.select("source", "precedence", "is_sample").join(sync_states(runs), "source", "left")
    return out.withColumn("stale_days", age).withColumn("due", age.isNull() | (age > fresh_days))


def refresh_summary(runs: DataFrame, most: int = 5) -> DataFrame:
    """One row: how many batches there were and how they ended, the last one, and the last ones that failed, wholly or in part."""
    newest, failed = F.struct("synced_on", "run_id"), F.col("status").isin("FAILED", "PARTIAL_SUCCESS")
    last = runs.filter(failed).orderBy(F.desc("synced_on"), F.desc("run_id")).limit(most)
    last = last.agg(F.transform(F.reverse(F.array_sort(F.collect_list(newest))), lambda x: x["run_id"]).alias("runs")).scalar()
    out = runs.agg(
        F.count("*").alias("batches"), F.coalesce(F.sum("records_fetched"), F.lit(0)).alias("fetched"), F.count_if(F.col("status") == "SUCCESS").alias("successful"), F.count_if(failed).alias("failed"),
        F.max(F.when(F.col("status") == "SUCCESS", F.col("synced_on"))).alias("last_success"), F.max_by("run_id", newest).alias("last_run"), F.max_by("status", newest).alias("last_status"), F.max_by("source", newest).alias("last_source"),
    )
    return out.withColumn("last_failed", last)


def described(obs: DataFrame) -> DataFrame:
    """Number, extremes, mean and percentiles of prices and of their spread (highest less lowest, in percent of the price), for each commodity.

    Spreads are taken in steps of 0.0001, so that the number of different values, which a percentile holds, is bounded.
    """
    spread = rounded((F.col("max_price") - F.col("min_price")) / F.col("modal_price") * 100, 4)
    measures = F.array(*[F.struct(F.lit(n).alias("measure"), x.alias("x")) for n, x in (("price", F.col("modal_price")), ("spread_percent", spread))])
    rows = obs.filter("modal_price > 0").select("commodity", F.explode(measures).alias("m")).select("commodity", "m.*").filter("x is not null")
    p = F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = rows.groupBy("commodity", "measure").agg(F.count("*").alias("n"), F.min("x").alias("lowest"), p.alias("p"), F.max("x").alias("highest"), (F.sum(F.floor(F.col("x") * 10000 + 0.5)) / F.count("*") / 10000.0).alias("mean"))
    digit = lambda c: rounded(c, 1)
    return out.select("commodity", "measure", "n", *[digit(F.col(c)).alias(c) for c in ("lowest", "mean", "highest")], *[digit(F.col("p")[k]).alias(c) for k, c in enumerate(("p5", "median", "p95"))])
