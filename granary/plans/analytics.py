"""Queries for risk, decisions and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import decisions as dec
from granary.operators import market as m
from granary.operators import risk as r
from granary.operators import series as s
from granary.plans.market import LATEST
from granary.plans.registry import query
from granary.plans.series import DAILY, FORECASTS, MEAN, PART, R, W, daily
from granary.sources import prices as p
from granary.sources.prices import ALERTS_SQL, TODAY

LAST = f"last AS (SELECT mandi_id, commodity, price, reported_date FROM (SELECT *, row_number() OVER ({PART} ORDER BY reported_date DESC) AS k FROM series) WHERE k = 1)"
DECLINE = f"""dec0 AS (
  SELECT f.mandi_id AS mandi_id, f.commodity AS commodity, horizon, {R("(price - predicted) / price * 100", 2)} AS drop_, {R("(price - coalesce(lower, predicted)) / price * 100", 2)} AS worst FROM forecasts f JOIN last ON last.mandi_id = f.mandi_id AND last.commodity = f.commodity WHERE predicted > 0 AND price > 0),
dec1 AS (SELECT mandi_id, commodity, greatest(max(drop_), 0.0) AS max_drop, greatest(max(worst), 0.0) AS worst_drop, min(horizon) FILTER (WHERE drop_ = top AND drop_ > 0) AS worst_horizon FROM (SELECT *, max(drop_) OVER ({PART}) AS top FROM dec0) GROUP BY mandi_id, commodity),
decline AS (
  SELECT last.mandi_id AS mandi_id, last.commodity AS commodity, max_drop, worst_drop, worst_horizon, CASE WHEN max_drop IS NULL THEN 'UNKNOWN' WHEN max_drop >= 10 OR worst_drop >= 18 THEN 'HIGH' WHEN max_drop >= 4 OR worst_drop >= 10 THEN 'MODERATE' ELSE 'LOW' END AS decline
  FROM last LEFT JOIN dec1 ON last.mandi_id = dec1.mandi_id AND last.commodity = dec1.commodity)"""
VOLATILITY = f"""ret AS (SELECT *, CASE WHEN lag(price) OVER ({W}) <> 0 THEN (price - lag(price) OVER ({W})) / lag(price) OVER ({W}) * 100 END AS ret FROM series),
vol0 AS (SELECT mandi_id, commodity, count(*) AS days, {R("stddev_samp(price) / avg(price) * 100", 2)} AS variation, {R("max(abs(ret))", 2)} AS max_swing, {R("stddev_samp(ret)", 2)} AS return_deviation FROM ret GROUP BY mandi_id, commodity),
vol AS (SELECT *, CASE WHEN days < 5 THEN 'UNKNOWN' WHEN max_swing >= 15 OR variation >= 8 OR return_deviation >= 4 THEN 'HIGH' WHEN max_swing >= 7 OR variation >= 4 OR return_deviation >= 2 THEN 'MODERATE' ELSE 'LOW' END AS volatility FROM vol0)"""
SURGE = f"""arr AS (SELECT mandi_id, commodity, count(*) AS reports, arg_max(arrivals, reported_date) AS last_, sum(arrivals) AS total FROM series WHERE arrivals > 0 GROUP BY mandi_id, commodity),
arr1 AS (SELECT mandi_id, commodity, reports, CASE WHEN reports >= 4 THEN {R("last_ / ((total - last_) / (reports - 1))", 2)} END AS ratio FROM arr),
surge AS (SELECT *, CASE WHEN ratio IS NULL THEN 'UNKNOWN' WHEN ratio >= 1.40 THEN 'HIGH' WHEN ratio >= 1.15 THEN 'MODERATE' ELSE 'LOW' END AS surge FROM arr1)"""
UNCERTAIN = f"""unc0 AS (SELECT mandi_id, commodity, {R(MEAN("((upper - lower) / (CASE WHEN predicted <> 0 THEN predicted ELSE 1.0 END) * 100)"), 1)} AS width, {R(MEAN("confidence"), 1)} AS mean_confidence FROM forecasts WHERE predicted IS NOT NULL AND lower IS NOT NULL AND upper IS NOT NULL GROUP BY mandi_id, commodity),
unc AS (SELECT *, CASE WHEN width IS NULL THEN 'UNKNOWN' WHEN width >= 22 OR coalesce(mean_confidence < 60, false) THEN 'HIGH' WHEN width >= 12 OR coalesce(mean_confidence < 78, false) THEN 'MODERATE' ELSE 'LOW' END AS uncertainty FROM unc0)"""
FRESH = f"""fresh AS (SELECT mandi_id, commodity, greatest(date_diff('day', reported_date, DATE '{TODAY}'), 0) AS age, CASE WHEN greatest(date_diff('day', reported_date, DATE '{TODAY}'), 0) > 7 THEN 'HIGH' WHEN greatest(date_diff('day', reported_date, DATE '{TODAY}'), 0) > 3 THEN 'MODERATE' ELSE 'LOW' END AS freshness FROM last)"""
JOINED = " ".join(f"LEFT JOIN {t} ON {t}.mandi_id = last.mandi_id AND {t}.commodity = last.commodity" for t in ("decline", "vol", "surge", "unc", "fresh"))
OVERALL = f"""{FORECASTS}, {LAST}, {DECLINE}, {VOLATILITY}, {SURGE}, {UNCERTAIN}, {FRESH},
factors AS (SELECT last.mandi_id AS mandi_id, last.commodity AS commodity, coalesce(decline, 'UNKNOWN') AS decline, coalesce(volatility, 'UNKNOWN') AS volatility, coalesce(surge, 'UNKNOWN') AS surge, coalesce(uncertainty, 'UNKNOWN') AS uncertainty, coalesce(freshness, 'UNKNOWN') AS freshness FROM last {JOINED}),
unknowns AS (SELECT *, (decline = 'UNKNOWN')::INT + (volatility = 'UNKNOWN')::INT + (surge = 'UNKNOWN')::INT + (uncertainty = 'UNKNOWN')::INT + (freshness = 'UNKNOWN')::INT AS u FROM factors),
risk AS (
  SELECT mandi_id, commodity, decline, volatility, surge, uncertainty, freshness,
    CASE WHEN (decline = 'UNKNOWN' AND volatility = 'UNKNOWN') OR u >= 4 THEN 'UNKNOWN' WHEN decline = 'HIGH' OR surge = 'HIGH' THEN 'HIGH' WHEN decline = 'MODERATE' OR volatility = 'HIGH' OR surge = 'MODERATE' OR freshness = 'HIGH' THEN 'MODERATE'
         WHEN decline = 'LOW' AND volatility = 'LOW' AND freshness = 'LOW' THEN 'LOW' WHEN u > 0 THEN 'MODERATE' ELSE 'LOW' END AS overall,
    concat_ws(',', CASE WHEN freshness = 'HIGH' THEN 'STALE_DATA' END, CASE WHEN surge = 'HIGH' THEN 'SUPPLY_GLUT' END, CASE WHEN decline = 'HIGH' THEN 'PRICE_DROP_ALERT' END, CASE WHEN volatility = 'HIGH' THEN 'HIGH_VOLATILITY' END, CASE WHEN uncertainty = 'HIGH' THEN 'HIGH_UNCERTAINTY' END) AS warnings FROM unknowns)"""


@query(f"WITH {FORECASTS}, {LAST}, {DECLINE} SELECT * FROM decline")
def price_decline_risk(spark, d):
    series = daily(spark, d)
    return r.price_decline(r.last_rows(series), s.forecasts(series))


@query(f"WITH {DAILY}, {VOLATILITY} SELECT * FROM vol")
def volatility_risk(spark, d):
    return r.volatility(daily(spark, d))


@query(f"WITH {DAILY}, {SURGE} SELECT * FROM surge")
def arrival_surge(spark, d):
    return r.arrival_surge(daily(spark, d))


@query(f"WITH {FORECASTS}, {UNCERTAIN} SELECT * FROM unc")
def forecast_uncertainty(spark, d):
    return r.uncertainty(s.forecasts(daily(spark, d)))


@query(f"WITH {DAILY}, {LAST}, {FRESH} SELECT * FROM fresh")
def data_freshness(spark, d):
    return r.freshness(r.last_rows(daily(spark, d)), TODAY)


def profiles(spark, d):
    series = daily(spark, d)
    return r.profile(series, s.forecasts(series), TODAY)


@query(f"WITH {OVERALL} SELECT * FROM risk")
def overall_risk(spark, d):
    return profiles(spark, d)


@query(f"WITH {OVERALL} SELECT overall, count(*) AS series FROM risk GROUP BY overall")
def risk_summary(spark, d):
    return r.summary(profiles(spark, d))


HOLD = f"""{FORECASTS}, {LAST},
hold AS (
  SELECT last.mandi_id AS mandi_id, last.commodity AS commodity, price AS price_now, predicted AS price_then, confidence, {R("price * 10.0", 2)} AS value_now, {R("predicted * 10.0", 2)} AS value_then, {R("lower * 10.0", 2)} AS value_low, {R("upper * 10.0", 2)} AS value_high
  FROM last LEFT JOIN forecasts f ON f.mandi_id = last.mandi_id AND f.commodity = last.commodity AND horizon = 3)"""


@query(f"""WITH {HOLD} SELECT *, {R("value_then - value_now", 2)} AS difference, CASE WHEN price_now <> 0 THEN {R("(price_then - price_now) / abs(price_now) * 100", 1)} END AS difference_percent,
{R(R("value_then - value_now", 2) + " - 4.0 * 3 * 10.0", 2)} AS after_storage, CASE WHEN price_then IS NULL THEN 'NO_FORECAST' ELSE 'AVAILABLE' END AS status FROM hold""")
def hold_vs_sell(spark, d):
    series = daily(spark, d)
    return dec.hold_or_sell(r.last_rows(series), s.forecasts(series), 10.0, 3, 4.0)


@query(f"""WITH {HOLD} SELECT commodity, count(*) AS markets, sum(CAST(floor(value_now * 100 + 0.5) AS BIGINT)) / 100.0 AS total_now, CASE WHEN bool_and(value_then IS NOT NULL) THEN sum(CAST(floor(value_then * 100 + 0.5) AS BIGINT)) / 100.0 END AS total_then, bool_and(value_then IS NOT NULL) AS complete FROM hold GROUP BY commodity""")
def plan_totals(spark, d):
    series = daily(spark, d)
    return dec.plan_totals(dec.hold_or_sell(r.last_rows(series), s.forecasts(series), 10.0, 3))


@query(f"""WITH {DAILY}, {LAST}, net AS (
  SELECT commodity, mandi_id, 'NATION_' || CAST(mandi_id AS VARCHAR) AS mandi, greatest({R("price - (CASE WHEN mandi_id = 4 THEN 113.75 ELSE 269.0 END)", 2)}, 0.0) AS net FROM last WHERE price > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY net DESC, mandi_id) AS k FROM net),
two AS (SELECT commodity, max(mandi) FILTER (WHERE k = 1) AS best, max(net) FILTER (WHERE k = 1) AS best_net, max(mandi) FILTER (WHERE k = 2) AS second, max(net) FILTER (WHERE k = 2) AS second_net FROM k WHERE k <= 2 GROUP BY commodity)
SELECT *, {R("best_net * 10.0", 2)} AS single_value, {R("best_net * 10.0 * 0.6 + second_net * 10.0 * 0.4", 2)} AS split_value, {R(R("best_net * 10.0", 2) + " - " + R("best_net * 10.0 * 0.6 + second_net * 10.0 * 0.4", 2), 2)} AS split_loss FROM two""")
def allocation(spark, d):
    """For a farmer in market 4: its own market is 25 km away, all others the default distance."""
    name = F.concat(F.lit("NATION_"), F.col("mandi_id").cast("string"))
    latest = r.last_rows(daily(spark, d)).withColumn("mandi", name).withColumn("district", name)
    return dec.allocation(latest, F.lit("Nation_4"), 1000.0)


MOVES = f"""per AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mandi_id, commodity, variety, reported_date ORDER BY observation_id DESC) AS i FROM obs) WHERE i = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mandi_id, commodity, variety ORDER BY reported_date DESC) AS k FROM per) WHERE k <= 2),
two AS (SELECT mandi_id, commodity, variety, max(reported_date) FILTER (WHERE k = 1) AS day, max(reported_date) FILTER (WHERE k = 2) AS day_before, max(modal_price) FILTER (WHERE k = 1) AS p1, max(modal_price) FILTER (WHERE k = 2) AS p2, max(arrival_quantity) FILTER (WHERE k = 1) AS a1, max(arrival_quantity) FILTER (WHERE k = 2) AS a2 FROM k GROUP BY mandi_id, commodity, variety),
moves AS (SELECT mandi_id, commodity, variety, day, day_before, CASE WHEN p2 <> 0 THEN {R("(p1 - p2) / abs(p2) * 100", 1)} END AS price_percent, CASE WHEN a2 <> 0 THEN {R("(a1 - a2) / abs(a2) * 100", 1)} END AS arrivals_percent FROM two WHERE day_before IS NOT NULL)"""


@query(f"WITH {MOVES} SELECT * FROM moves")
def movements(spark, d):
    return dec.movements(p.observations(spark, d))


@query(f"""WITH {MOVES} SELECT *, greatest(coalesce(abs(price_percent), 0), coalesce(abs(arrivals_percent), 0)) AS size, CASE WHEN coalesce(abs(price_percent), 0) >= coalesce(abs(arrivals_percent), 0) THEN 'price' ELSE 'arrivals' END AS driver FROM moves
ORDER BY size DESC, day DESC, mandi_id, commodity, variety LIMIT 5""")
def top_movements(spark, d):
    return dec.top_movements(dec.movements(p.observations(spark, d)))


@query("""WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commodity, variety, grade, price_unit, reported_date, mandi_id ORDER BY modal_price DESC, observation_id DESC) AS i FROM obs) WHERE i = 1),
n AS (SELECT *, count(*) OVER (PARTITION BY commodity, variety, grade, price_unit, reported_date) AS markets FROM one),
o AS (SELECT *, row_number() OVER w AS place, lead(modal_price) OVER w AS next FROM n WHERE markets >= 2 WINDOW w AS (PARTITION BY commodity, variety, grade, price_unit, reported_date ORDER BY modal_price DESC, mandi_id))
SELECT commodity, variety, grade, price_unit, reported_date, mandi_id, modal_price, place, place = 1 AND modal_price > next AS leads FROM o WHERE place <= 6""")
def price_comparison(spark, d):
    return dec.comparison(p.observations(spark, d))


NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mandi_id, commodity ORDER BY reported_date DESC, observation_id DESC) AS k FROM obs WHERE NOT is_sample AND modal_price > 0) WHERE k = 1)"
TRIGGERS = f"""{ALERTS_SQL}, {NEWEST},
hits AS (
  SELECT alert_id, a.mandi_id AS mandi_id, a.commodity AS commodity, observation_id, modal_price, target_price, condition, reported_date, source FROM alerts a JOIN newest n ON n.mandi_id = a.mandi_id AND n.commodity = a.commodity
  WHERE is_active AND date_diff('day', reported_date, DATE '{TODAY}') * 24 - 24 <= freshness_hours AND CASE WHEN condition = 'gte' THEN modal_price >= target_price ELSE modal_price <= target_price END)"""


@query(f"WITH {TRIGGERS} SELECT * FROM hits")
def alert_triggers(spark, d):
    return dec.alert_triggers(p.observations(spark, d), p.alert_rules(spark, d), TODAY)


@query(f"WITH {TRIGGERS} SELECT * FROM hits WHERE alert_id % 3 <> 0")
def alert_triggers_once(spark, d):
    """Those of a second evaluation, after the alerts with a number divisible by 3 have fired already."""
    obs, rules = p.observations(spark, d), p.alert_rules(spark, d)
    done = dec.alert_triggers(obs, rules.filter("alert_id % 3 = 0"), TODAY)
    return dec.alert_triggers(obs, rules, TODAY, done)


@query(f"""WITH {ALERTS_SQL}, {NEWEST},
pairs AS (SELECT DISTINCT c.c_custkey AS "user", m.mandi_id AS mandi_id, 'Brand#' || CAST(c.c_custkey % 20 + x.k AS VARCHAR) AS commodity FROM customer c, (VALUES (1), (2)) x(k), (SELECT CAST(n_nationkey AS BIGINT) AS mandi_id FROM nation) m WHERE m.mandi_id IN (c.c_nationkey, (c.c_nationkey + 1) % 25)
  UNION SELECT alert_id, mandi_id, commodity FROM alerts)
SELECT "user", p.mandi_id AS mandi_id, p.commodity AS commodity, modal_price, reported_date, source FROM pairs p LEFT JOIN newest n ON n.mandi_id = p.mandi_id AND n.commodity = p.commodity""")
def farmer_dashboard(spark, d):
    """Every customer is a user with favourites, two commodities and two markets, and with an alert."""
    users = p.table(spark, d, "customer").select(F.col("c_custkey").alias("user"), "c_nationkey")
    crops = users.select("user", F.explode(F.array(*[F.concat(F.lit("Brand#"), (F.col("user") % 20 + k).cast("string")) for k in (1, 2)])).alias("commodity"))
    places = users.select("user", F.explode(F.array(F.col("c_nationkey").cast("long"), (F.col("c_nationkey").cast("long") + 1) % 25)).alias("mandi_id"))
    rules = p.alert_rules(spark, d).withColumn("user", F.col("alert_id"))
    return dec.dashboard(p.observations(spark, d), dec.wanted_pairs(crops, places, rules))


@query(f"WITH {LATEST} SELECT commodity, arg_max(mandi, {{'a': arrival_quantity, 'i': observation_id}}) AS mandi, max(arrival_quantity) AS arrivals FROM latest WHERE arrival_quantity IS NOT NULL GROUP BY commodity")
def arrival_leader(spark, d):
    latest = m.latest(p.observations(spark, d)).filter("arrival_quantity is not null")
    return latest.groupBy("commodity").agg(F.max_by("mandi", F.struct("arrival_quantity", "observation_id")).alias("mandi"), F.max("arrival_quantity").alias("arrivals"))


@query(f"""WITH runs AS (SELECT CASE WHEN o_custkey % 2 = 0 THEN 'CEDA' ELSE 'DATA_GOV_IN' END AS source, max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderkey % 2 = 0) AS a, max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1)
SELECT source, 'SUCCESS' AS last_status, greatest(a, b) AS latest_date FROM runs""", obs=False)
def sync_state_upsert(spark, d):
    runs = p.sync_log(spark, d)
    half = lambda k, status: runs.filter(F.col("run_id") % 2 == k).groupBy("source").agg(F.lit(status).alias("last_status"), F.max("synced_on").alias("latest_date"))
    return dec.upsert_state(half(0, "FAILED"), half(1, "SUCCESS"))
