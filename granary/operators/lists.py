"""Lists that clients page through: histories of triggers, notifications, favourites, names, and how fresh a page is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.market import first_rows, stale_days
from granary.operators.requests import displayable

MOST_HISTORY, MOST_NOTIFICATIONS = 100, 200


def bounded(asked: int | None, usual: int, most: int) -> int:
    """A page's size: what is asked for, from 1 to most; the usual one without a number."""
    return min(max(asked or usual, 1), most)


def history_page(triggers: DataFrame, page: int = 1, limit: int | None = None, commodity: str | None = None, mandi_id: int | None = None, since: str | None = None) -> DataFrame:
    """A page of each user's triggers, newest first, with place, total and total_pages of all that fit the filters.

    triggers: user, alert_id, mandi_id, commodity, reported_date and more. A user with too few triggers for the page has no row. Ranks above the
    page's end are dropped before the shuffle, and totals are counted on their own, so a user with very many triggers is no large group.
    """
    size = bounded(limit, 20, MOST_HISTORY)
    rows = triggers
    if commodity is not None:
        rows = rows.filter(F.col("commodity") == commodity)
    if mandi_id is not None:
        rows = rows.filter(F.col("mandi_id") == mandi_id)
    if since is not None:
        rows = rows.filter(F.col("reported_date") >= F.to_date(F.lit(since)))
    counts = rows.groupBy(F.col("user").alias("_user")).agg(F.count("*").alias("total"))
    order = Window.partitionBy("user").orderBy(F.col("reported_date").desc(), F.col("alert_id").desc())
    last = max(page, 1) * size
    some = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= last).filter(F.col("place") > last - size)
    out = some.join(counts, F.col("user").eqNullSafe(F.col("_user"))).drop("_user")
    return out.withColumn("total_pages", F.ceil(F.col("total") / size))


def notifications(rows: DataFrame, unread_only: bool = False, limit: int | None = None) -> DataFrame:
    """Each user's newest notifications, all or those not read, with the number of unread ones whatever is shown.

    rows: user, notification_id, created_on, is_read and more. A user of whom nothing is shown has no row.
    """
    unread = rows.filter(~F.col("is_read")).groupBy(F.col("user").alias("_user")).agg(F.count("*").alias("unread"))
    shown = rows.filter(~F.col("is_read")) if unread_only else rows
    newest = first_rows(shown, ("user",), F.col("created_on").desc(), F.col("notification_id").desc(), n=bounded(limit, 50, MOST_NOTIFICATIONS))
    return newest.join(unread, F.col("user").eqNullSafe(F.col("_user")), "left").drop("_user").withColumn("unread", F.coalesce("unread", F.lit(0)))


def favourites(chosen: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Each user's favourites in the order in which they are shown: default ones first, then the latest chosen. Favourites without an item are left out.

    chosen: user, key, is_default and created_on; items: a row for each key. A missing date comes last, ties go by key.
    """
    order = Window.partitionBy("user").orderBy(F.coalesce("is_default", F.lit(False)).desc(), F.col("created_on").desc_nulls_last(), F.col(key))
    return chosen.join(items, key).withColumn("place", F.row_number().over(order))


def active_names(obs: DataFrame) -> DataFrame:
    """Commodities that have a displayable report."""
    return obs.filter(displayable(obs)).select("commodity").distinct()


def page_meta(page: DataFrame, today: str) -> DataFrame:
    """One row for the rows of a page: how many are genuine and how many samples, the newest genuine day and its age, and the sources."""
    genuine = ~F.coalesce("is_sample", F.lit(False))
    latest = F.max(F.when(genuine, F.col("reported_date")))
    return page.agg(
        F.count_if(genuine).alias("genuine_rows"), F.count_if(~genuine).alias("sample_rows"), latest.alias("latest_genuine"), stale_days(latest, today).alias("page_age"), F.array_sort(F.collect_set("source")).alias("sources"),
    )


def with_global_freshness(meta: DataFrame, statuses: DataFrame, fresh_days: int = 3) -> DataFrame:
    """A page's meta beside the freshness of everything: the page's age says nothing of whether the data are stale.

    statuses: a row for each source, of source_status; samples don't count. Without any source that has data is_stale is null, not false. The one
    row of everything comes in as a scalar subquery, not by a join.
    """
    overall = statuses.filter(~F.col("is_sample")).agg(F.struct(F.min("stale_days").alias("age"), F.max("last_date").alias("latest"), F.coalesce(F.sum("records"), F.lit(0)).alias("records")).alias("o"))
    out = meta.withColumn("_o", overall.scalar())
    return out.select(*meta.columns, F.col("_o.age").alias("global_age"), F.col("_o.latest").alias("global_latest"), F.col("_o.records").alias("global_records"), (F.col("_o.age") > fresh_days).alias("is_stale"))


def high_alerts(profiles: DataFrame) -> DataFrame:
    """Series of high risk with their warnings and how many these are."""
    some = F.when(F.col("warnings") == "", 0).otherwise(F.size(F.split("warnings", ",")))
    return profiles.filter("overall = 'HIGH'").select("mandi_id", "commodity", "warnings", some.alias("warning_count"))
