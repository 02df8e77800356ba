"""Queries of lists that clients page through."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import decisions as dec
from granary.operators import lists
from granary.operators import market as m
from granary.operators import risk as r
from granary.operators import series as s
from granary.plans.analytics import LAST, OVERALL, TRIGGERS, profiles
from granary.plans.market import LATEST
from granary.plans.registry import query
from granary.plans.series import FORECASTS, R, daily
from granary.sources import prices as p
from granary.sources.prices import TODAY


def mine(spark, d):
    """Triggers of 40 users: a user has the alerts whose numbers have the same remainder."""
    return dec.alert_triggers(p.observations(spark, d), p.alert_rules(spark, d), TODAY).withColumn("user", F.col("alert_id") % 40)


@query(f"""WITH {TRIGGERS}, fits AS (SELECT *, alert_id % 40 AS "user" FROM hits), ranked AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY reported_date DESC, alert_id DESC) AS place, count(*) OVER (PARTITION BY "user") AS total FROM fits WHERE reported_date >= DATE '1998-01-01')
SELECT "user", alert_id, mandi_id, commodity, reported_date, CAST(place AS INTEGER) AS place, total, CAST(ceil(total / 3.0) AS BIGINT) AS total_pages FROM ranked WHERE place BETWEEN 4 AND 6""")
def alert_history(spark, d):
    """The second page, of three triggers a user, of those since 1998."""
    return lists.history_page(mine(spark, d), page=2, limit=3, since="1998-01-01").select("user", "alert_id", "mandi_id", "commodity", "reported_date", "place", "total", "total_pages")


@query(f"""WITH {TRIGGERS}, fits AS (SELECT *, alert_id % 40 AS "user" FROM hits WHERE mandi_id = 4)
SELECT "user", alert_id, commodity, count(*) OVER (PARTITION BY "user") AS total, CAST(ceil(count(*) OVER (PARTITION BY "user") / 20.0) AS BIGINT) AS total_pages FROM fits QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY reported_date DESC, alert_id DESC) <= 20""")
def alert_history_of_market(spark, d):
    return lists.history_page(mine(spark, d), mandi_id=4).select("user", "alert_id", "commodity", "total", "total_pages")


@query(f"""WITH {TRIGGERS}, notes AS (SELECT alert_id % 40 AS "user", alert_id AS notification_id, reported_date AS created_on, alert_id % 3 = 0 AS is_read FROM hits)
SELECT "user", notification_id, created_on, count(*) OVER (PARTITION BY "user") AS unread FROM notes WHERE NOT is_read QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY created_on DESC, notification_id DESC) <= 5""")
def unread_notifications(spark, d):
    notes = mine(spark, d).select("user", F.col("alert_id").alias("notification_id"), F.col("reported_date").alias("created_on"), (F.col("alert_id") % 3 == 0).alias("is_read"))
    return lists.notifications(notes, unread_only=True, limit=5).select("user", "notification_id", "created_on", "unread")


@query("""WITH chosen AS (SELECT o_custkey AS "user", 'Brand#' || CAST(o_orderkey % 5 + 1 AS VARCHAR) || CAST(o_orderkey // 5 % 6 + 1 AS VARCHAR) AS commodity, bool_or(o_orderkey % 7 = 0) AS is_default, min(CAST(o_orderdate AS DATE)) AS created_on FROM orders GROUP BY 1, 2),
items AS (SELECT p_brand AS commodity, count(DISTINCT p_type) AS varieties FROM part GROUP BY 1)
SELECT "user", commodity, is_default, created_on, varieties, CAST(row_number() OVER (PARTITION BY "user" ORDER BY is_default DESC, created_on DESC, commodity) AS INTEGER) AS place FROM chosen JOIN items USING (commodity)""", obs=False)
def favourite_commodities(spark, d):
    """Customers have chosen a commodity with each order; every seventh order made it a default, and one in six names none that there is."""
    key = F.col("o_orderkey")
    brand = F.concat(F.lit("Brand#"), (key % 5 + 1).cast("string"), (F.floor(key / 5) % 6 + 1).cast("string"))
    chosen = p.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user"), brand.alias("commodity")).agg(F.bool_or(key % 7 == 0).alias("is_default"), F.min(F.col("o_orderdate").cast("date")).alias("created_on"))
    items = p.table(spark, d, "part").groupBy(F.col("p_brand").alias("commodity")).agg(F.count_distinct("p_type").alias("varieties"))
    return lists.favourites(chosen, items, "commodity").select("user", "commodity", "is_default", "created_on", "varieties", "place")


@query("""WITH chosen AS (SELECT o_custkey AS "user", CAST(o_orderkey % 25 AS BIGINT) AS mandi_id, bool_or(o_orderkey % 11 = 0) AS is_default, max(CAST(o_orderdate AS DATE)) AS created_on FROM orders GROUP BY 1, 2)
SELECT "user", mandi_id, n_name AS mandi, r_name AS state, is_default, created_on, CAST(row_number() OVER (PARTITION BY "user" ORDER BY is_default DESC, created_on DESC, mandi_id) AS INTEGER) AS place FROM chosen JOIN nation ON n_nationkey = mandi_id JOIN region ON r_regionkey = n_regionkey""", obs=False)
def favourite_markets(spark, d):
    key = F.col("o_orderkey")
    chosen = p.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user"), (key % 25).cast("long").alias("mandi_id")).agg(F.bool_or(key % 11 == 0).alias("is_default"), F.max(F.col("o_orderdate").cast("date")).alias("created_on"))
    nation, region = p.table(spark, d, "nation"), p.table(spark, d, "region")
    items = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").cast("long").alias("mandi_id"), F.col("n_name").alias("mandi"), F.col("r_name").alias("state"))
    return lists.favourites(chosen, items, "mandi_id").select("user", "mandi_id", "mandi", "state", "is_default", "created_on", "place")


@query("SELECT DISTINCT commodity FROM obs WHERE modal_price > 0 AND price_unit = 'INR/quintal' AND quality_status <> 'REJECTED'")
def active_names(spark, d):
    return lists.active_names(p.observations(spark, d))


@query(f"""WITH {LATEST}, page AS (SELECT * FROM latest ORDER BY reported_date DESC, observation_id DESC LIMIT 50),
meta AS (SELECT count(*) FILTER (WHERE NOT is_sample) AS genuine_rows, count(*) FILTER (WHERE is_sample) AS sample_rows, max(reported_date) FILTER (WHERE NOT is_sample) AS latest_genuine, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM page),
over_all AS (SELECT max(reported_date) AS global_latest, count(*) AS global_records FROM obs WHERE NOT is_sample)
SELECT genuine_rows, sample_rows, latest_genuine, CAST(greatest(date_diff('day', latest_genuine, DATE '{TODAY}'), 0) AS INTEGER) AS page_age, sources, CAST(greatest(date_diff('day', global_latest, DATE '{TODAY}'), 0) AS INTEGER) AS global_age, global_latest, CAST(global_records AS BIGINT) AS global_records,
  greatest(date_diff('day', global_latest, DATE '{TODAY}'), 0) > 3 AS is_stale FROM meta, over_all""")
def page_freshness(spark, d):
    """The first page of the latest prices beside all data."""
    obs = p.observations(spark, d)
    page = m.latest(obs).orderBy(F.col("reported_date").desc(), F.col("observation_id").desc()).limit(50)
    out = lists.with_global_freshness(lists.page_meta(page, TODAY), m.source_status(obs, p.sources(spark), TODAY))
    return out.withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {OVERALL} SELECT mandi_id, commodity, warnings, CAST(CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, ',')) END AS INTEGER) AS warning_count FROM risk WHERE overall = 'HIGH'")
def high_risk_alerts(spark, d):
    return lists.high_alerts(profiles(spark, d))


@query(f"""WITH {FORECASTS}, {LAST}, asked AS (SELECT c_custkey AS ask_id, 'Brand#' || CAST(c_custkey % 5 + 1 AS VARCHAR) || CAST(c_custkey // 5 % 6 + 1 AS VARCHAR) AS commodity, CAST(c_nationkey AS BIGINT) AS m, c_custkey % 3 AS kind, c_custkey % 9 AS days FROM customer),
parts AS (SELECT ask_id, commodity, 'single' AS mode, m AS mandi_id, 12.5 AS quantity, days FROM asked WHERE kind > 0 UNION ALL SELECT ask_id, commodity, 'plan', m, 10.0, days FROM asked WHERE kind = 0 UNION ALL SELECT ask_id, commodity, 'plan', (m + 7) % 25, 4.5, 0 FROM asked WHERE kind = 0),
valued AS (SELECT ask_id, mode, {R("price * quantity", 2)} AS now, {R("(CASE WHEN price IS NOT NULL THEN CASE WHEN days = 0 THEN price ELSE predicted END END) * quantity", 2)} AS later FROM parts a LEFT JOIN last ON last.mandi_id = a.mandi_id AND last.commodity = a.commodity LEFT JOIN forecasts f ON f.mandi_id = a.mandi_id AND f.commodity = a.commodity AND horizon = days),
sums AS (SELECT ask_id, mode, count(*) AS markets, CASE WHEN count(now) = count(*) THEN sum(CAST(floor(now * 100 + 0.5) AS BIGINT)) / 100.0 END AS value_now, CASE WHEN count(later) = count(*) THEN sum(CAST(floor(later * 100 + 0.5) AS BIGINT)) / 100.0 END AS value_then FROM valued GROUP BY ask_id, mode)
SELECT *, {R("value_then - value_now", 2)} AS difference, CASE WHEN value_now <> 0 THEN {R("(value_then - value_now) / abs(value_now) * 100.0", 1)} END AS difference_percent, CASE WHEN value_now IS NULL THEN 'NO_MARKET_DATA' WHEN value_then IS NULL THEN 'NO_FORECAST' ELSE 'AVAILABLE' END AS status FROM sums""")
def scenario_dispatch(spark, d):
    """Every customer asks: a third for a plan over two markets, the others for one market; some for days beyond the forecasts or for no commodity that there is."""
    key, series = F.col("c_custkey"), daily(spark, d)
    part = lambda market, quantity, days: F.struct(market.cast("long").alias("mandi_id"), F.lit(quantity).alias("quantity"), days.cast("int").alias("days"))
    home = F.col("c_nationkey")
    asked = p.table(spark, d, "customer").select(
        key.alias("ask_id"), F.concat(F.lit("Brand#"), (key % 5 + 1).cast("string"), (F.floor(key / 5) % 6 + 1).cast("string")).alias("commodity"), home.cast("long").alias("mandi_id"), F.lit(12.5).alias("quantity"), (key % 9).cast("int").alias("days"),
        F.when(key % 3 == 0, F.array(part(home, 10.0, key % 9), part((home + 7) % 25, 4.5, F.lit(0)))).alias("allocations"),
    )
    return dec.scenarios(asked, r.last_rows(series), s.forecasts(series))
