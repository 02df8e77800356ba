"""Queries over requests and what clients show."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import records as rec
from granary.operators import decisions as dec
from granary.operators import market as m
from granary.operators import requests as r
from granary.operators import series as s
from granary.plans.analytics import TRIGGERS
from granary.plans.registry import query
from granary.plans.series import FORECASTS, daily
from granary.sources import prices as p
from granary.sources.prices import TODAY


@query("""WITH asks AS (SELECT o_orderkey AS ask_id, ['onion  red', '<script>', NULL, repeat('a', 65), ' Nashik '][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS search, [' ceda', 'a-b', NULL][CAST(o_custkey % 3 + 1 AS INTEGER)] AS source,
    [strftime(o_orderdate, '%Y-%m-%d'), '2026-02-31', '', '1996-06-15'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS start, CASE WHEN o_orderkey % 9 = 0 THEN '01/02/1996' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "end",
    ['0', '100', '1001', 'abc', NULL, ' 7 '][CAST(o_custkey % 6 + 1 AS INTEGER)] AS "limit", ['asc', 'sideways', NULL][CAST(o_orderkey % 3 + 1 AS INTEGER)] AS "order", ['true', 'false', 'yes', NULL][CAST(o_custkey % 4 + 1 AS INTEGER)] AS samples FROM orders),
v AS (SELECT *, trim(regexp_replace(search, '\\s+', ' ', 'g')) AS words, CASE WHEN regexp_full_match(start, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(start AS DATE) END AS a, CASE WHEN regexp_full_match("end", '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST("end" AS DATE) END AS b,
    CASE WHEN regexp_full_match(trim("limit"), '-?\\d+') THEN CAST(trim("limit") AS BIGINT) END AS n FROM asks)
SELECT ask_id, concat_ws(',', CASE WHEN words <> '' AND NOT (regexp_full_match(words, '[\\p{L}\\p{M}\\p{N}][\\p{L}\\p{M}\\p{N}\\s.,''()&/_-]*') AND length(words) <= 64) THEN 'search' END, CASE WHEN source IS NOT NULL AND NOT regexp_full_match(upper(trim(source)), '[A-Z0-9_]{1,32}') THEN 'source' END,
    CASE WHEN start <> '' AND a IS NULL THEN 'start' END, CASE WHEN "end" <> '' AND b IS NULL THEN 'end' END, CASE WHEN "limit" IS NOT NULL AND NOT coalesce(n BETWEEN 1 AND 1000, false) THEN 'limit' END, CASE WHEN "order" IS NOT NULL AND upper("order") NOT IN ('ASC', 'DESC') THEN 'order' END,
    CASE WHEN samples IS NOT NULL AND samples NOT IN ('true', 'false') THEN 'samples' END, CASE WHEN a > b THEN 'start_after_end' END, CASE WHEN date_diff('day', a, b) >= 365 THEN 'span' END) AS errors,
  CASE WHEN "limit" IS NULL THEN 100 WHEN n BETWEEN 1 AND 1000 THEN n ELSE 100 END AS "limit", CASE WHEN upper("order") IN ('ASC', 'DESC') THEN upper("order") ELSE 'ASC' END AS "order", CASE WHEN samples IN ('true', 'false') THEN samples = 'true' ELSE true END AS samples FROM v""", obs=False)
def request_validation(spark, d):
    """A request from each order, with every kind of fault."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *x: F.get(F.array(*[v if not isinstance(v, str | None) else F.lit(v) for v in x]), (n % len(x)).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    asks = p.table(spark, d, "orders").select(
        k.alias("ask_id"), pick(k, "onion  red", "<script>", None, "a" * 65, " Nashik ").alias("search"), pick(c, " ceda", "a-b", None).alias("source"), pick(k, day, "2026-02-31", "", "1996-06-15").alias("start"),
        F.when(k % 9 == 0, "01/02/1996").otherwise(day).alias("end"), pick(c, "0", "100", "1001", "abc", None, " 7 ").alias("limit"), F.lit(None).cast("string").alias("offset"), pick(k, "asc", "sideways", None).alias("order"), pick(c, "true", "false", "yes", None).alias("samples"),
    )
    return r.history_request(asks, 365).select("ask_id", F.array_join("errors", ",").alias("errors"), "limit", "order", "samples")


@query(f"""WITH named AS (SELECT *, mandi || ' APMC (Market ' || CAST(mandi_id * 7 AS VARCHAR) || ')' AS long_name FROM obs)
SELECT CASE WHEN is_sample OR regexp_matches(source, '(?i)MOCK|FIXTURE|SYNTHETIC') THEN 'sample' WHEN greatest(date_diff('day', reported_date, DATE '{TODAY}'), 0) <= 7 THEN 'verified' ELSE 'historical' END AS label, trim(regexp_replace(long_name, '\\s*\\(\\s*market\\s*\\d+\\s*\\)', '', 'gi')) AS market,
  count(*) AS records, count(*) FILTER (WHERE modal_price > 0 AND price_unit = 'INR/quintal' AND quality_status <> 'REJECTED') AS displayable FROM named GROUP BY 1, 2""")
def display_labels(spark, d):
    """Reports by the label and the market's name that a client shows."""
    obs = p.observations(spark, d)
    name = r.market_name(F.concat("mandi", F.lit(" APMC (Market "), (F.col("mandi_id") * 7).cast("string"), F.lit(")")))
    return obs.groupBy(r.label(TODAY).alias("label"), name.alias("market")).agg(F.count("*").alias("records"), F.count_if(r.displayable(obs)).alias("displayable"))


@query(f"""WITH {FORECASTS}, asks AS (SELECT c_custkey AS ask_id, CAST(c_custkey % 30 AS BIGINT) AS mandi_id, 'Brand#' || CAST(c_custkey % 25 + 1 AS VARCHAR) AS commodity, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 12 END AS horizon FROM customer),
have AS (SELECT mandi_id, commodity, count(*) AS n FROM series GROUP BY 1, 2), fc AS (SELECT DISTINCT mandi_id, commodity, horizon FROM forecasts)
SELECT ask_id, CASE WHEN coalesce(n, 0) = 0 THEN 'NO_MARKET_DATA' WHEN n < 21 THEN 'INSUFFICIENT_HISTORY' WHEN NOT EXISTS (SELECT 1 FROM fc WHERE fc.mandi_id = a.mandi_id AND fc.commodity = a.commodity) THEN 'NO_FORECAST'
  WHEN a.horizon IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fc WHERE fc.mandi_id = a.mandi_id AND fc.commodity = a.commodity AND fc.horizon = a.horizon) THEN 'NO_FORECAST_FOR_FILTER' END AS reason FROM asks a LEFT JOIN have h ON h.mandi_id = a.mandi_id AND h.commodity = a.commodity""")
def forecast_empty_reasons(spark, d):
    """Why each customer gets no forecast of a series and horizon."""
    key, series = F.col("c_custkey"), daily(spark, d)
    asks = p.table(spark, d, "customer").select(key.alias("ask_id"), (key % 30).cast("long").alias("mandi_id"), F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string")).alias("commodity"), F.when(key % 4 > 0, (key % 12).cast("int")).alias("horizon"))
    observed = series.groupBy("mandi_id", "commodity").agg(F.count("*").alias("n"))
    return r.empty_reason(asks, observed, s.forecasts(series)).select("ask_id", "reason")


@query(f"""WITH {TRIGGERS}, fired AS (SELECT alert_id, max(reported_date) AS last_triggered FROM hits GROUP BY 1),
rules AS (SELECT *, alert_id % 200 AS "user" FROM alerts)
SELECT "user", alert_id, is_active, n_name AS mandi, last_triggered, CAST(row_number() OVER (PARTITION BY "user" ORDER BY is_active DESC, last_triggered DESC NULLS LAST, alert_id DESC) AS INTEGER) AS place FROM rules LEFT JOIN fired USING (alert_id) LEFT JOIN nation ON n_nationkey = mandi_id""")
def alert_lists(spark, d):
    """200 users' alerts in the order in which they are shown."""
    rules = p.alert_rules(spark, d)
    fired = dec.alert_triggers(p.observations(spark, d), rules, TODAY)
    markets = p.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("mandi_id"), F.col("n_name").alias("mandi"))
    return r.alert_list(rules.withColumn("user", F.col("alert_id") % 200), markets, fired).select("user", "alert_id", "is_active", "mandi", "last_triggered", "place")


_SORTED = {"price-desc": "coalesce(modal_price, 0) DESC", "price-asc": "coalesce(modal_price, 0)", "arrivals-desc": "coalesce(arrival_quantity, 0) DESC", "date-desc": "reported_date DESC NULLS LAST", "name-asc": "mandi NULLS FIRST"}


@query("WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mandi_id, commodity, variety ORDER BY reported_date DESC, observation_id DESC) AS k FROM obs) WHERE k = 1) "
       + " UNION ALL ".join(f"(SELECT '{mode}' AS mode, observation_id FROM latest ORDER BY {order}, observation_id LIMIT 20)" for mode, order in _SORTED.items()))
def table_sorts(spark, d):
    """The first 20 rows of the latest prices in each order of the table."""
    latest = m.latest(p.observations(spark, d))
    return r.unioned([r.sorted_page(latest, mode, 20).select(F.lit(mode).alias("mode"), "observation_id") for mode in _SORTED])


_CODES = ", ".join(f"('{alias}', '{code}')" for alias, code in rec.CODE_OF_ALIAS.items())


@query(f"""WITH aliases(alias, code) AS (VALUES {_CODES}), said AS (SELECT doc_id AS text_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' sweet potato and ONION!' WHEN 1 THEN ' Sweet  tomato' WHEN 2 THEN ' कांदा' ELSE '' END AS text FROM documents),
w AS (SELECT text_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM said),
words AS (SELECT text_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k, w FROM w WHERE len(w) > 0),
hits AS (SELECT text_id, k, code FROM words JOIN aliases ON alias = word WHERE k = 1 OR w[k - 1] <> 'sweet'),
firsts AS (SELECT text_id, arg_min(code, k) AS code FROM hits GROUP BY text_id)
SELECT coalesce(code, '(none)') AS code, count(*) AS texts FROM w LEFT JOIN firsts USING (text_id) GROUP BY 1""", obs=False)
def alias_detection(spark, d):
    """Commodities that whole documents name first, with a planted ending."""
    key = F.col("doc_id") % 4
    ending = F.when(key == 0, " sweet potato and ONION!").when(key == 1, " Sweet  tomato").when(key == 2, " कांदा").otherwise("")
    said = p.table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), F.concat(F.coalesce("text", F.lit("")), ending).alias("text"))
    return r.alias_codes(said).groupBy(F.coalesce("code", F.lit("(none)")).alias("code")).agg(F.count("*").alias("texts"))
