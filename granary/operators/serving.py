"""What a service keeps and shows: pages with totals, lookups, conflict log, dimensions, forecast runs and incremental windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.market import DAY, SERIES, first_rows

#: Relative difference of prices that is a conflict.
TOLERANCE = 0.005
#: Days that are read again, and days that one run reads at most.
READ_AGAIN, MOST_DAYS = 3, 30


def page(rows: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit in order, each with the number of all rows: an aggregate of its own, not a window over everything."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def lookup(rows: DataFrame, asked: DataFrame, key: str, *names: str) -> DataFrame:
    """For each asked text (column asked) the row of least key one of whose names equals it, without case and outer spaces; the first name that fits counts.

    Every name is joined on equality, so both tables may have any size. A text that fits nothing, or is null, gives no row.
    """
    called = rows.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lower(F.trim(F.col(n).cast("string"))).alias("name")) for k, n in enumerate(names)])).alias("_n")).select(key, "_n.*")
    wanted = asked.select("asked", F.lower(F.trim("asked")).alias("name")).distinct()
    return first_rows(wanted.join(called, "name"), ("asked",), F.col("rank"), F.col(key)).select("asked", key)


def conflicts(obs: DataFrame, touched: DataFrame, logged: DataFrame | None = None) -> DataFrame:
    """Pairs of sources whose newest reports of one identity differ in price, on market-days that touched has rows of; those logged are left out.

    A source has one row of an identity after first_rows, so a group has as many rows as there are sources.
    """
    identity = (*DAY, "variety", "grade")
    rows = obs.join(touched.select(*DAY).distinct(), [*DAY], "left_semi")
    one = first_rows(rows, ("source", *identity), F.col("observation_id").desc())
    side = lambda s: one.select(*[F.col(c).alias(f"{c}_{s}") for c in (*identity, "source", "observation_id", "modal_price")])
    a, b = side("a"), side("b")
    pairs = a.join(b, reduce(lambda x, y: x & y, [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in identity]) & (F.col("source_a") < F.col("source_b")))
    x, y = F.col("modal_price_a"), F.col("modal_price_b")
    out = pairs.filter(F.abs(x - y) / F.greatest(F.least(x, y), F.lit(1.0)) > TOLERANCE)
    out = out.select(*[F.col(f"{c}_a").alias(c) for c in identity], "source_a", "source_b", "observation_id_a", "observation_id_b", x.alias("price_a"), y.alias("price_b"))
    return out if logged is None else out.join(logged.select("observation_id_a", "observation_id_b"), ["observation_id_a", "observation_id_b"], "left_anti")


def conflict_counts(log: DataFrame) -> DataFrame:
    """Conflicts by type and status, with totals of each type and of all (null where a column is summed up)."""
    return log.rollup("type", "status").agg(F.count("*").alias("conflicts"))


def new_members(known: DataFrame, batch: DataFrame, code: str, *names: str) -> DataFrame:
    """Members of a dimension that a batch names first: one row for each code (the least names); known ones are never renamed. Null codes are none."""
    fresh = batch.filter(F.col(code).isNotNull()).groupBy(code).agg(F.min(F.struct(*names)).alias("_m")).select(code, "_m.*")
    return fresh.join(known.select(code), code, "left_anti")


def guarded(batch: DataFrame, known: DataFrame) -> DataFrame:
    """action: skipped if the record's source has delivered its key before, in known, else read. A null key is never known."""
    keys = known.select("source", "source_record_key").distinct().withColumn("_there", F.lit(True))
    return batch.join(keys, ["source", "source_record_key"], "left").withColumn("action", F.when(F.col("_there"), "skipped").otherwise("read")).drop("_there")


FORECAST_KEY = (*SERIES, "forecast_date", "horizon", "model_version")


def upserted(forecasts: DataFrame) -> DataFrame:
    """The forecast generated last of each key."""
    return first_rows(forecasts, FORECAST_KEY, F.col("generated_at").desc(), F.col("run_id").desc())


def latest_set(forecasts: DataFrame, runs: DataFrame, horizon: int | None = None, model_version: str | None = None) -> DataFrame:
    """Of each series the forecasts that were generated last among those asked for, with what is known of their run."""
    out = forecasts
    for name, value in (("horizon", horizon), ("model_version", model_version)):
        out = out if value is None else out.filter(F.col(name) == value)
    last = F.max("generated_at").over(Window.partitionBy(*SERIES))
    out = out.withColumn("_last", last).filter("generated_at = _last").drop("_last")
    return out.join(runs.select("run_id", "status"), "run_id", "left")


def incremental_window(log: DataFrame, today: str) -> DataFrame:
    """For each source the days to read now: the last READ_AGAIN again, back to its last success, at most MOST_DAYS; without success as far back as allowed."""
    now = F.to_date(F.lit(today))
    last = F.max(F.when(F.col("status") == "SUCCESS", F.col("synced_on")))
    start = F.greatest(F.least(F.coalesce(F.col("last_success"), F.date_sub(now, MOST_DAYS - 1)), F.date_sub(now, READ_AGAIN - 1)), F.date_sub(now, MOST_DAYS - 1))
    return log.groupBy("source").agg(last.alias("last_success")).select("source", "last_success", start.alias("from"), now.alias("to"), (F.datediff(now, start) + 1).alias("days"))


def inbox(triggers: DataFrame, read: DataFrame, n: int = 5) -> DataFrame:
    """Each user's newest n triggers (user, alert_id, reported_date and more), with the numbers of all and of those unread. read: alert_id that have been seen.

    The counts are grouped for themselves and joined, so that of a user with many triggers no task passes on more than n. Triggers without a user are one user's.
    """
    seen = read.select("alert_id").distinct().withColumn("is_read", F.lit(True))
    rows = triggers.join(seen, "alert_id", "left").withColumn("is_read", F.coalesce("is_read", F.lit(False)))
    counts = rows.groupBy(F.col("user").alias("_user")).agg(F.count("*").alias("total"), F.count_if(~F.col("is_read")).alias("unread"))
    newest = first_rows(rows, ("user",), F.col("reported_date").desc(), F.col("alert_id").desc(), n=n)
    return newest.join(counts, F.col("user").eqNullSafe(F.col("_user"))).drop("_user")


def prices_in_area(obs: DataFrame, area: str, n: int = 5) -> DataFrame:
    """For each area and commodity the newest report of up to n markets: the primary one is the newest, of one day that of the least market.

    Samples count only where an area has nothing else of the commodity; sample_only says so.
    """
    keys = (area, "commodity")
    usable = obs.filter(F.col("price_unit").isNotNull() & (F.col("modal_price") > 0))
    one = first_rows(usable, (*keys, "mandi_id", "is_sample"), F.col("reported_date").desc(), F.col("observation_id").desc())
    one = one.withColumn("sample_only", F.min("is_sample").over(Window.partitionBy(*keys))).filter("is_sample = sample_only")
    out = one.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("reported_date").desc(), "mandi_id"))).filter(F.col("place") <= n)
    return out.withColumn("role", F.when(F.col("place") == 1, "primary").otherwise("alternative"))


def answers(understood: DataFrame, names: DataFrame, prices: DataFrame) -> DataFrame:
    """What turns that ask for a price are told. names: crop and commodity; prices: one row of commodity, modal_price, reported_date and mandi each.

    status: NO_COMMODITY if none was named, NO_DATA without a price, else ANSWERED, with the day and market as the source of the answer.
    """
    asked = understood.filter("intent = 'LATEST_PRICE'").join(names, "crop", "left").join(prices.select("commodity", "modal_price", "reported_date", "mandi"), "commodity", "left")
    price = F.col("modal_price")
    status = F.when(F.col("crop").isNull(), "NO_COMMODITY").when(price.isNull(), "NO_DATA").otherwise("ANSWERED")
    text = F.when(price.isNotNull(), F.format_string("The newest price of %s is ₹%.2f per quintal.", "crop", price))
    return asked.select("conv_id", "turn", "crop", status.alias("status"), text.alias("answer"), "modal_price", "reported_date", "mandi")


def respelled(asked: DataFrame, variants: DataFrame) -> DataFrame:
    """asked with the name that a spelling variant stands for (the least, if it stands for several); other texts stay. variants: variant and name."""
    known = variants.groupBy(F.lower(F.trim("variant")).alias("_variant")).agg(F.min("name").alias("_name"))
    return asked.join(known, F.lower(F.trim("asked")) == F.col("_variant"), "left").select("asked", F.coalesce("_name", "asked").alias("name"))


def series_found(obs: DataFrame) -> DataFrame:
    """Series with a whole identity, each with its number of different days."""
    keys = ("commodity", "mandi_id", "variety")
    return obs.dropna(subset=list(keys)).groupBy(*keys).agg(F.count_distinct("reported_date").alias("days"))


def counters(obs: DataFrame, log: DataFrame) -> DataFrame:
    """One row of counts over reports and runs."""
    runs = lambda what: log.agg(what).scalar()
    out = obs.agg(F.count("*").alias("records"), F.count_if(~F.col("is_sample")).alias("genuine"), F.count_distinct("mandi_id").alias("markets"), F.count_distinct("commodity").alias("commodities"), F.max("reported_date").alias("last_date"))
    return out.withColumn("runs", runs(F.count("*"))).withColumn("failed_runs", runs(F.count_if(F.col("status") == "FAILED"))).withColumn("last_success", runs(F.max(F.when(F.col("status") == "SUCCESS", F.col("synced_on")))))
