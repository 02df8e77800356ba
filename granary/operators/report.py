"""The whole quality report out of one pass over the observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.market import DAY
from granary.operators.quality import PROFILED

IDENTITY = ("source", *DAY, "variety", "grade")
#: Sections with a row for each value of a column.
BY_VALUE = {"sources": "source", "records_by_year": "year", "coverage_by_state": "state", "coverage_by_district": "district", "coverage_by_commodity": "commodity"}


def sections(obs: DataFrame, today: str) -> DataFrame:
    """section, key, metric and value (whole numbers; dates as days since 1970) of all sections.

    The observations are read, joined and dealt by market-day once. In the order of a day's identities a row is an identity's first one, its second
    one or a later one, so that repeats are sums as well. Counts are taken by all values together, which are few, and out of these by nothing and by
    each value: no row is multiplied.
    """
    p, sums = F.col("modal_price"), {}
    sums |= {"records": F.count("*"), "genuine": F.count_if(~F.col("is_sample")), "flagged": F.count_if(F.col("quality_status") == "FLAGGED")}
    sums |= {
        "modal_not_positive": F.count_if(p <= 0), "min_above_max": F.count_if(F.col("min_price") > F.col("max_price")), "modal_outside": F.count_if((p < F.col("min_price")) | (p > F.col("max_price"))),
        "arrivals_negative": F.count_if(F.col("arrival_quantity") < 0), "future_dated": F.count_if(F.col("reported_date") > F.to_date(F.lit(today))), "unit_unknown": F.count_if(F.col("price_unit") != "INR/quintal"),
    }
    sums |= {f"no_{c}": F.count_if(F.col(c).isNull()) for c in PROFILED}
    values = list(BY_VALUE.values())
    whole = Window.partitionBy(*DAY)
    place = whole.orderBy(*[c for c in IDENTITY if c not in DAY])
    rows = obs.withColumns({"year": F.year("reported_date"), "_k": F.row_number().over(place), "_first": F.rank().over(place), "_both": F.min("source").over(whole) < F.max("source").over(whole)})
    first, day = F.col("_k") == F.col("_first"), F.col("_k") == 1
    sums |= {"market_days": F.count_if(day), "overlapping": F.count_if(day & F.col("_both")), "rows_of_several": F.count_if("_both")}
    sums |= {"identities": F.count_if(first), "groups": F.count_if(F.col("_k") == F.col("_first") + 1), "duplicate_rows": F.count_if(~first)}
    cells = rows.groupBy(*values).agg(F.min(F.unix_date("reported_date")).alias("first"), F.max(F.unix_date("reported_date")).alias("last"), *[x.alias(n) for n, x in sums.items()])
    groups = cells.groupingSets([[], *[[F.col(c)] for c in values]], *map(F.col, values)).agg(F.grouping_id(*values).alias("gid"), F.min("first").alias("first"), F.max("last").alias("last"), *[F.sum(n).alias(n) for n in sums])
    metric = lambda section, key, name, value: F.struct(
        F.lit(section).alias("section"), F.coalesce(key.cast("string"), F.lit("(none)")).alias("key"), F.lit(name).alias("metric"), value.cast("long").alias("value")
    )
    c, all_ = F.col, F.lit("all")
    total = [metric("coverage", all_, n, c(n)) for n in ("records", "genuine", "flagged", "first", "last")]
    total += [metric("invalid_records", all_, n, c(n)) for n in ("modal_not_positive", "min_above_max", "modal_outside", "arrivals_negative", "future_dated", "unit_unknown")]
    total += [metric("missing_values", F.lit(n), "missing", c(f"no_{n}")) for n in PROFILED]
    total += [metric("cross_source_overlaps", all_, n, c(x)) for n, x in (("market_days", "market_days"), ("overlapping", "overlapping"), ("records", "rows_of_several"))]
    total += [metric("duplicates", all_, n, c(n)) for n in ("identities", "groups", "duplicate_rows")]
    # the grouping id has a bit for each column, the first one highest, set where the set lacks it
    every = 2 ** len(values) - 1
    told = F.when(c("gid") == every, F.array(*total))
    for k, (section, column) in enumerate(BY_VALUE.items()):
        told = told.when(c("gid") == every - 2 ** (len(values) - 1 - k), F.array(*[metric(section, c(column), n, c(n)) for n in ("records", "genuine", "flagged")]))
    return groups.select(F.explode(told).alias("m")).select("m.*")


def refresh(runs: DataFrame) -> DataFrame:
    """The section of the runs, in the same form."""
    count = lambda s: F.count_if(F.col("status") == s)
    one = runs.agg(
        F.count("*").alias("runs"), count("SUCCESS").alias("succeeded"), (count("FAILED") + count("PARTIAL_SUCCESS")).alias("not_whole"), F.max(F.when(F.col("status") == "SUCCESS", F.unix_date("synced_on"))).alias("last_success"),
        F.coalesce(F.sum("records_fetched"), F.lit(0)).alias("fetched"),
    )
    names = ["runs", "succeeded", "not_whole", "last_success", "fetched"]
    return one.select(*[F.col(n).cast("long") for n in names]).unpivot([], names, "metric", "value").select(F.lit("refresh").alias("section"), F.lit("all").alias("key"), "metric", "value")


def gaps(report: DataFrame) -> DataFrame:
    """What a finished report shows to be incomplete: a sentence for each fault, with its count. report: section, key, metric, value."""
    value = F.col("value")
    at = lambda section, metric: (F.col("section") == section) & (F.col("metric") == metric)
    rules = [
        (at("coverage", "records") & (value == 0), F.lit("no records at all")),
        (at("missing_values", "missing") & (value > 0), F.concat(F.lit("records without "), F.col("key"))),
        (at("invalid_records", "modal_not_positive") & (value > 0), F.lit("prices that aren't positive")),
        (at("invalid_records", "future_dated") & (value > 0), F.lit("records of days to come")),
        (at("invalid_records", "unit_unknown") & (value > 0), F.lit("records without a known unit")),
        (at("duplicates", "duplicate_rows") & (value > 0), F.lit("rows that repeat an identity")),
        (at("refresh", "last_success") & value.isNull(), F.lit("no run has succeeded")),
        (at("refresh", "not_whole") & (value > 0), F.lit("runs that failed or were partial")),
    ]
    said = F.coalesce(*[F.when(test, text) for test, text in rules])
    return report.withColumn("gap", said).filter("gap is not null").select("gap", F.coalesce("value", F.lit(0)).alias("records"))
