"""Queries over market prices and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import market as m
from granary.operators import quality as q
from granary.plans.registry import query
from granary.sources import prices as p
from granary.sources.prices import SYNC_SQL, TODAY

LATEST = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mandi_id, commodity, variety ORDER BY reported_date DESC, observation_id DESC) AS place FROM obs) WHERE place = 1)"""
RESOLVED = """resolved AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY mandi_id, commodity, reported_date) AS rows_of_day,
                        dense_rank() OVER (PARTITION BY mandi_id, commodity, reported_date ORDER BY precedence DESC, source) AS rank FROM obs) WHERE rank = 1)"""
PREVIOUS = """daily AS (SELECT source, mandi_id, commodity, variety, grade, reported_date, max(modal_price) AS price FROM obs GROUP BY ALL),
lagged AS (
  SELECT source, mandi_id, commodity, variety, grade, reported_date, lag(price) OVER w AS previous_price, lag(reported_date) OVER w AS previous_date FROM daily
  WINDOW w AS (PARTITION BY source, mandi_id, commodity, variety, grade ORDER BY reported_date))"""
TREND = """CASE WHEN {b} <> 0 THEN floor(({a} - {b}) / abs({b}) * 100 * 10 + 0.5) / 10 END AS trend_percent,
       CASE WHEN {b} IS NULL OR {b} = 0 THEN 'none' WHEN floor(({a} - {b}) / abs({b}) * 100 * 10 + 0.5) > 0 THEN 'up' WHEN floor(({a} - {b}) / abs({b}) * 100 * 10 + 0.5) < 0 THEN 'down' ELSE 'stable' END AS trend"""
FAULT = "CAST(('0x' || substr(observation_id, 1, 6)) AS BIGINT) % 97"
FAULTY = f"""faulty AS (
  SELECT * REPLACE (CASE WHEN {FAULT} = 1 OR dayofyear(reported_date) % 50 = 0 THEN 0.0 WHEN {FAULT} = 2 THEN -5.0 WHEN {FAULT} = 3 THEN modal_price * 3 ELSE modal_price END AS modal_price, CASE WHEN {FAULT} = 4 THEN max_price + 1 ELSE min_price END AS min_price,
    CASE WHEN {FAULT} = 5 THEN -3.0 ELSE arrival_quantity END AS arrival_quantity, CASE WHEN {FAULT} = 6 THEN CAST(reported_date + 14610 AS DATE) ELSE reported_date END AS reported_date, CASE WHEN {FAULT} = 7 THEN 'INR/bag' ELSE price_unit END AS price_unit) FROM obs)"""


def faulty(spark, d):
    """The observations, of which every so often one has a fault, and of every 50th day of a year no price is positive."""
    fault = F.conv(F.substring("observation_id", 1, 6), 16, 10).cast("long") % 97
    return p.observations(spark, d).withColumns({
        "modal_price": F.when((fault == 1) | (F.dayofyear("reported_date") % 50 == 0), 0.0).when(fault == 2, -5.0).when(fault == 3, F.col("modal_price") * 3).otherwise(F.col("modal_price")), "min_price": F.when(fault == 4, F.col("max_price") + 1).otherwise(F.col("min_price")),
        "arrival_quantity": F.when(fault == 5, -3.0).otherwise(F.col("arrival_quantity")), "reported_date": F.when(fault == 6, F.date_add("reported_date", 14610)).otherwise(F.col("reported_date")), "price_unit": F.when(fault == 7, "INR/bag").otherwise(F.col("price_unit")),
    })


ROW = ["observation_id", "mandi", "market_code", "commodity", "variety", "grade", "reported_date", "modal_price", "source"]
ROW_SQL = ", ".join(ROW)


@query(f"WITH {LATEST} SELECT {ROW_SQL} FROM latest")
def latest_prices(spark, d):
    return m.latest(p.observations(spark, d)).select(*ROW)


@query(f"WITH {RESOLVED} SELECT {ROW_SQL}, rows_of_day FROM resolved")
def resolved_view(spark, d):
    return m.resolved(p.observations(spark, d)).select(*ROW, "rows_of_day")


@query(f"""WITH {RESOLVED}, last AS (SELECT * FROM (SELECT *, max(reported_date) OVER (PARTITION BY mandi_id, commodity) AS last FROM resolved) WHERE reported_date = last),
{PREVIOUS}
SELECT observation_id, mandi, commodity, last.variety AS variety, last.grade AS grade, last.reported_date AS reported_date, modal_price, last.source AS source, previous_price, previous_date, {TREND.format(a="modal_price", b="previous_price")}
FROM last LEFT JOIN lagged ON last.source = lagged.source AND last.mandi_id = lagged.mandi_id AND last.commodity = lagged.commodity AND last.variety IS NOT DISTINCT FROM lagged.variety
  AND last.grade IS NOT DISTINCT FROM lagged.grade AND last.reported_date = lagged.reported_date""".replace("mandi, commodity, last", "mandi, last.commodity AS commodity, last"))
def latest_day_with_trend(spark, d):
    obs = p.observations(spark, d)
    out = m.with_trend(m.with_previous(m.latest_resolved(obs), obs))
    return out.select("observation_id", "mandi", "commodity", "variety", "grade", "reported_date", "modal_price", "source", "previous_price", "previous_date", "trend_percent", "trend")


@query(f"SELECT {ROW_SQL} FROM obs WHERE lower(commodity) = 'brand#7' ORDER BY reported_date DESC, observation_id DESC LIMIT 100 OFFSET 20")
def price_history_page(spark, d):
    page = m.newest_page(m.where(p.observations(spark, d), commodity="BRAND#7"), 100, 20)
    return page.select(*ROW).orderBy("reported_date", "observation_id")


@query(f"SELECT {ROW_SQL} FROM obs WHERE source = 'CEDA' AND mandi_id = 3 AND reported_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'")
def raw_source_history(spark, d):
    return m.where(p.observations(spark, d), source="ceda", market="3", start="1998-01-01", end="1999-12-31").select(*ROW)


@query("SELECT observation_id, mandi, commodity FROM obs WHERE contains(lower(commodity), '#1') OR contains(lower(mandi), '#1')")
def search_filter(spark, d):
    return m.where(p.observations(spark, d), search="#1").select("observation_id", "mandi", "commodity")


@query("SELECT observation_id, mandi_id, state, variety FROM obs WHERE lower(state) = 'asia' AND lower(variety) = 'economy' AND NOT is_sample AND quality_status = 'VALID'")
def identity_filter(spark, d):
    return m.where(p.observations(spark, d), state="Asia", variety="economy", is_sample=False, quality_status="VALID").select("observation_id", "mandi_id", "state", "variety")


@query("SELECT source, count(*) AS usable FROM obs WHERE NOT is_sample AND NOT regexp_matches(source, '(?i)MOCK|FIXTURE|SYNTHETIC') AND price_unit IS NOT NULL AND modal_price > 0 GROUP BY source")
def genuine_rows(spark, d):
    return m.genuine(p.observations(spark, d), "clean").groupBy("source").agg(F.count("*").alias("usable"))


@query("""SELECT a.observation_id AS observation_id, b.observation_id AS other_id, a.modal_price AS modal_price, b.modal_price AS other_price FROM obs a JOIN obs b
ON a.mandi_id = b.mandi_id AND a.commodity = b.commodity AND a.reported_date = b.reported_date AND a.variety IS NOT DISTINCT FROM b.variety AND a.grade IS NOT DISTINCT FROM b.grade WHERE a.source = 'CEDA' AND b.source = 'DATA_GOV_IN'""")
def null_safe_match(spark, d):
    obs = p.observations(spark, d)
    return m.matching_identity(m.where(obs, source="CEDA"), m.where(obs, source="DATA_GOV_IN"))


@query("SELECT observation_id FROM obs WHERE (mandi_id, commodity) IN (SELECT (CAST(c_nationkey AS BIGINT), 'Brand#' || CAST(c_custkey % 25 + 1 AS VARCHAR)) FROM customer WHERE c_mktsegment = 'MACHINERY')")
def pair_semi_join(spark, d):
    rules = p.alert_rules(spark, d).join(p.table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("alert_id")), "alert_id")
    return m.in_pairs(p.observations(spark, d), rules).select("observation_id")


@query("SELECT commodity, category, count(DISTINCT variety) AS varieties, count(DISTINCT state) AS states, count(*) AS records, min(reported_date) AS first_date, max(reported_date) AS last_date FROM obs GROUP BY commodity, category")
def list_commodities(spark, d):
    return m.commodity_listing(p.observations(spark, d))


@query("SELECT state, district, mandi_id, mandi, max(market_code) AS market_code, count(DISTINCT commodity) AS commodities, count(*) AS records, min(reported_date) AS first_date, max(reported_date) AS last_date FROM obs GROUP BY state, district, mandi_id, mandi")
def list_markets(spark, d):
    return m.market_listing(p.observations(spark, d))


@query(f"""WITH seen AS (SELECT source, count(*) AS records, count(DISTINCT mandi_id) AS markets, count(DISTINCT commodity) AS commodities, max(reported_date) AS last_date FROM obs GROUP BY source)
SELECT s.source AS source, precedence, is_sample, coalesce(records, 0) AS records, coalesce(markets, 0) AS markets, coalesce(commodities, 0) AS commodities, last_date,
       CASE WHEN last_date IS NOT NULL THEN greatest(date_diff('day', last_date, DATE '{TODAY}'), 0) END AS stale_days, last_date IS NULL OR greatest(date_diff('day', last_date, DATE '{TODAY}'), 0) > 3 AS stale
FROM sources s LEFT JOIN seen ON s.source = seen.source""")
def data_status(spark, d):
    return m.source_status(p.observations(spark, d), p.sources(spark), TODAY)


@query("SELECT count(*) AS records, count(*) FILTER (WHERE NOT is_sample) AS genuine, count(*) FILTER (WHERE is_sample) AS samples, count(DISTINCT mandi_id) AS markets, count(DISTINCT commodity) AS commodities, count(DISTINCT source) AS sources, min(reported_date) AS first_date, max(reported_date) AS last_date FROM obs")
def overall_status(spark, d):
    return m.overall_status(p.observations(spark, d))


@query(f"""WITH reports AS (SELECT commodity, reported_date, floor(sum(CAST(floor(modal_price * 100 + 0.5) AS BIGINT)) / count(*) + 0.5) / 100 AS price, count(*) AS reports FROM obs WHERE reported_date >= DATE '1999-01-01' GROUP BY commodity, reported_date),
prev AS (SELECT *, lag(price) OVER (PARTITION BY commodity ORDER BY reported_date) AS previous_price, lag(reported_date) OVER (PARTITION BY commodity ORDER BY reported_date) AS previous_date FROM reports)
SELECT commodity, reported_date, price, reports, previous_price, previous_date, {TREND.format(a="price", b="previous_price")} FROM prev""")
def commodity_reports_lag(spark, d):
    reports = m.national_reports(m.where(p.observations(spark, d), start="1999-01-01"))
    return m.with_previous_report(reports).drop("arrivals")


@query(f"""WITH {FAULTY} SELECT count(*) AS records, count(*) FILTER (WHERE modal_price <= 0) AS modal_not_positive, count(*) FILTER (WHERE min_price > max_price) AS min_above_max, count(*) FILTER (WHERE modal_price < min_price OR modal_price > max_price) AS modal_outside,
count(*) FILTER (WHERE arrival_quantity IS NULL) AS arrivals_missing, count(*) FILTER (WHERE arrival_quantity < 0) AS arrivals_negative, count(*) FILTER (WHERE reported_date > DATE '{TODAY}') AS future_dated, count(*) FILTER (WHERE price_unit <> 'INR/quintal') AS unit_unknown, count(*) FILTER (WHERE grade IS NULL) AS grade_missing FROM faulty""")
def integrity_audit(spark, d):
    return q.integrity(faulty(spark, d), TODAY)


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) - count({c}) AS missing, floor((count(*) - count({c})) * 100.0 / nullif(count(*), 0) * 100 + 0.5) / 100 AS percent FROM obs" for c in q.PROFILED))
def missing_profile(spark, d):
    return q.missing_profile(p.observations(spark, d))


@query("SELECT source, mandi_id, commodity, reported_date, variety, grade, count(*) AS copies FROM obs GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return q.duplicate_groups(p.observations(spark, d))


@query("WITH g AS (SELECT count(*) AS copies FROM obs GROUP BY source, mandi_id, commodity, reported_date, variety, grade HAVING count(*) > 1) SELECT count(*) AS groups, CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS duplicate_rows FROM g")
def duplicate_summary(spark, d):
    return q.duplicate_summary(p.observations(spark, d))


@query("SELECT mandi_id, commodity, reported_date, count(DISTINCT source) AS sources, count(*) AS records FROM obs GROUP BY mandi_id, commodity, reported_date HAVING count(DISTINCT source) > 1")
def overlap_groups(spark, d):
    return q.overlap_groups(p.observations(spark, d))


@query("WITH s AS (SELECT DISTINCT mandi_id, commodity, reported_date, source FROM obs) SELECT a.source AS source_a, b.source AS source_b, count(*) AS market_days FROM s a JOIN s b ON a.mandi_id = b.mandi_id AND a.commodity = b.commodity AND a.reported_date = b.reported_date AND a.source < b.source GROUP BY ALL")
def overlap_pairs(spark, d):
    return q.overlap_pairs(p.observations(spark, d))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT mandi_id, commodity, reported_date, variety, grade FROM obs)) AS identities, (SELECT count(*) FROM (SELECT DISTINCT mandi_id, commodity, reported_date FROM obs)) AS market_days")
def distinct_tuples(spark, d):
    return q.distinct_tuples(p.observations(spark, d))


@query("SELECT flag, count(*) AS records FROM (SELECT unnest(quality_flags) AS flag FROM obs) GROUP BY flag")
def flag_histogram(spark, d):
    return q.flag_histogram(p.observations(spark, d))


@query("SELECT commodity, count(*) AS records, max(reported_date) AS last_date FROM obs GROUP BY commodity ORDER BY records DESC, commodity LIMIT 10")
def top_commodities(spark, d):
    return q.top(p.observations(spark, d), "commodity")


@query("SELECT mandi, count(*) AS records, max(reported_date) AS last_date FROM obs GROUP BY mandi ORDER BY records DESC, mandi LIMIT 10")
def top_markets(spark, d):
    return q.top(p.observations(spark, d), "mandi")


@query("SELECT CAST(year(reported_date) AS INTEGER) AS year, count(*) AS records, count(*) FILTER (WHERE NOT is_sample) AS genuine FROM obs GROUP BY 1")
def records_by_year(spark, d):
    return q.by_year(p.observations(spark, d))


@query("""WITH y AS (SELECT DISTINCT mandi_id, commodity, variety, CAST(year(reported_date) AS INTEGER) AS year FROM obs),
span AS (SELECT mandi_id, commodity, variety, unnest(generate_series(min(year), max(year))) AS year FROM y GROUP BY mandi_id, commodity, variety)
SELECT mandi_id, commodity, variety, CAST(year AS INTEGER) AS year FROM span WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.mandi_id = span.mandi_id AND y.commodity = span.commodity AND y.variety = span.variety AND y.year = span.year)""")
def year_gaps(spark, d):
    return q.year_gaps(p.observations(spark, d))


@query("SELECT commodity, count(*) AS records, count(arrival_quantity) AS with_arrivals, floor(count(arrival_quantity) * 100.0 / count(*) * 100 + 0.5) / 100 AS percent FROM obs GROUP BY commodity")
def arrivals_coverage(spark, d):
    return q.arrivals_coverage(p.observations(spark, d))


@query("SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}_count" for c in ("state", "district", "mandi", "market_code", "commodity", "category", "variety", "grade")) + " FROM obs")
def dimension_counts(spark, d):
    return q.dimension_counts(p.observations(spark, d))


@query("SELECT s.source AS source, precedence, records, flagged, markets, first_date, last_date FROM sources s LEFT JOIN (SELECT source, count(*) AS records, count(*) FILTER (WHERE quality_status = 'FLAGGED') AS flagged, count(DISTINCT mandi_id) AS markets, min(reported_date) AS first_date, max(reported_date) AS last_date FROM obs GROUP BY source) c ON c.source = s.source")
def source_coverage(spark, d):
    return q.source_coverage(p.observations(spark, d), p.sources(spark))


@query(f"""WITH {SYNC_SQL} SELECT source, count(*) AS runs, count(*) FILTER (WHERE status = 'SUCCESS') AS success, count(*) FILTER (WHERE status = 'PARTIAL_SUCCESS') AS partial_success, count(*) FILTER (WHERE status = 'FAILED') AS failed,
CAST(coalesce(sum(records_fetched), 0) AS BIGINT) AS fetched, floor(avg(records_fetched) * 10 + 0.5) / 10 AS mean_fetched, max(synced_on) FILTER (WHERE status = 'SUCCESS') AS last_success FROM runs GROUP BY source""", obs=False)
def sync_health(spark, d):
    return q.sync_health(p.sync_log(spark, d))


@query(f"WITH {SYNC_SQL} SELECT run_id, source, synced_on, 'error: api-key=[redacted] token=[redacted]' AS message FROM runs WHERE status = 'FAILED' ORDER BY synced_on DESC, run_id DESC LIMIT 5", obs=False)
def last_failures(spark, d):
    return q.last_failures(p.sync_log(spark, d))


@query(f"""WITH g AS (SELECT commodity, count(*) FILTER (WHERE NOT is_sample) AS genuine, count(*) FILTER (WHERE is_sample) AS samples, max(reported_date) FILTER (WHERE NOT is_sample) AS last_genuine, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM obs GROUP BY commodity)
SELECT *, CASE WHEN last_genuine IS NOT NULL THEN greatest(date_diff('day', last_genuine, DATE '{TODAY}'), 0) END AS stale_days FROM g""")
def freshness_summary(spark, d):
    return q.freshness_summary(p.observations(spark, d), TODAY)


@query("SELECT observation_id, count(*) OVER (PARTITION BY mandi_id, commodity, reported_date, source) AS rows_in_source FROM obs")
def rows_per_source_of_day(spark, d):
    return q.rows_per_source_of_day(p.observations(spark, d)).select("observation_id", "rows_in_source")


@query(f"WITH {LATEST} SELECT mandi, count(*) AS series, max(reported_date) AS last_date FROM latest GROUP BY mandi")
def current_series_per_market(spark, d):
    return m.latest(p.observations(spark, d)).groupBy("mandi").agg(F.count("*").alias("series"), F.max("reported_date").alias("last_date"))


@query("SELECT DISTINCT mandi_id, commodity FROM obs WHERE source = 'CEDA' UNION SELECT DISTINCT mandi_id, commodity FROM obs WHERE source = 'DATA_GOV_IN' AND reported_date >= DATE '2001-01-01'")
def series_union(spark, d):
    obs = p.observations(spark, d)
    side = lambda **asked: m.where(obs, **asked).select(*m.SERIES)
    return side(source="CEDA").unionByName(side(source="DATA_GOV_IN", start="2001-01-01")).distinct()


@query("SELECT DISTINCT mandi_id, commodity, variety FROM obs EXCEPT SELECT mandi_id, commodity, variety FROM obs WHERE source = 'CEDA'")
def series_difference(spark, d):
    obs = p.observations(spark, d)
    keys = (*m.SERIES, "variety")
    return obs.select(*keys).distinct().join(m.where(obs, source="CEDA").select(*keys).distinct(), [*keys], "left_anti")


@query("SELECT mandi, min(reported_date) AS first_date, max(reported_date) AS last_date, count(*) AS records, string_agg(DISTINCT commodity, ',' ORDER BY commodity) AS commodities FROM obs WHERE NOT is_sample GROUP BY mandi")
def market_registry(spark, d):
    names = F.array_join(F.array_sort(F.collect_set("commodity")), ",")
    return m.genuine(p.observations(spark, d)).groupBy("mandi").agg(F.min("reported_date").alias("first_date"), F.max("reported_date").alias("last_date"), F.count("*").alias("records"), names.alias("commodities"))


@query("SELECT DISTINCT state, district, mandi FROM obs WHERE lower(state) = 'europe'")
def location_cascade(spark, d):
    return m.where(p.observations(spark, d), state="Europe").select("state", "district", "mandi").distinct()


@query("SELECT lower(variety) AS key, min(variety) AS variety FROM obs GROUP BY lower(variety)")
def varieties(spark, d):
    return p.observations(spark, d).groupBy(F.lower("variety").alias("key")).agg(F.min("variety").alias("variety"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY mandi_id, commodity ORDER BY reported_date DESC, observation_id DESC) AS k FROM obs) SELECT observation_id, mandi_id, commodity, reported_date FROM k WHERE k <= 3")
def bounded_history(spark, d):
    """The last three reports of every series, in one plan."""
    return m.latest(p.observations(spark, d), m.SERIES, n=3).select("observation_id", "mandi_id", "commodity", "reported_date")


@query(f"WITH {SYNC_SQL} SELECT run_id, source, status, synced_on, records_fetched FROM runs ORDER BY synced_on DESC, run_id DESC LIMIT 10", obs=False)
def pipeline_runs(spark, d):
    return p.sync_log(spark, d).orderBy(F.desc("synced_on"), F.desc("run_id")).limit(10).select("run_id", "source", "status", "synced_on", "records_fetched")


@query("SELECT source, quality_status, count(*) AS records FROM obs GROUP BY source, quality_status UNION ALL SELECT source, NULL, count(*) FROM obs GROUP BY source UNION ALL SELECT NULL, NULL, count(*) FROM obs")
def status_rollup(spark, d):
    return p.observations(spark, d).rollup("source", "quality_status").agg(F.count("*").alias("records"))
