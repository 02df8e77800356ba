"""Queries on the state of sources and runs, what a market pays now, and plans for a harvest."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import decisions as dec
from granary.operators import market as m
from granary.operators import quality as q
from granary.operators import risk as r
from granary.plans.analytics import LAST
from granary.plans.market import RESOLVED
from granary.plans.registry import query
from granary.plans.series import DAILY, R, daily
from granary.sources import prices as p
from granary.sources.prices import SYNC_SQL, TODAY

NEWEST = "ORDER BY synced_on DESC, run_id DESC"
FAILED = "status IN ('FAILED', 'PARTIAL_SUCCESS')"
LAST_RUN = lambda c: f"(SELECT {c} FROM runs {NEWEST} LIMIT 1) AS last_{c.removesuffix('_id')}"


@query(f"""WITH {SYNC_SQL} SELECT count(*) AS batches, CAST(coalesce(sum(records_fetched), 0) AS BIGINT) AS fetched, count(*) FILTER (WHERE status = 'SUCCESS') AS successful, count(*) FILTER (WHERE {FAILED}) AS failed,
  max(synced_on) FILTER (WHERE status = 'SUCCESS') AS last_success, {LAST_RUN("run_id")}, {LAST_RUN("status")}, {LAST_RUN("source")},
  (SELECT string_agg(CAST(run_id AS VARCHAR), ',' {NEWEST}) FROM (SELECT * FROM runs WHERE {FAILED} {NEWEST} LIMIT 5)) AS last_failed FROM runs""", obs=False)
def refresh_summary(spark, d):
    return q.refresh_summary(p.sync_log(spark, d)).withColumn("last_failed", F.array_join("last_failed", ","))


@query(f"""WITH {SYNC_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY source {NEWEST}) AS k FROM runs),
states AS (SELECT source, max(run_id) FILTER (WHERE k = 1) AS last_run, max(status) FILTER (WHERE k = 1) AS last_status, max(synced_on) FILTER (WHERE status = 'SUCCESS') AS last_success FROM k GROUP BY source)
SELECT s.source AS source, precedence, is_sample, last_run, last_status, last_success, greatest(date_diff('day', last_success, DATE '{TODAY}'), CASE WHEN last_success IS NOT NULL THEN 0 END) AS stale_days,
  last_success IS NULL OR date_diff('day', last_success, DATE '{TODAY}') > 3 AS due FROM sources s LEFT JOIN states ON states.source = s.source""")
def sources_with_states(spark, d):
    return q.sources_with_states(p.sources(spark), p.sync_log(spark, d), TODAY)


@query(f"""WITH x AS (SELECT commodity, 'price' AS measure, modal_price AS x FROM obs WHERE modal_price > 0 UNION ALL SELECT commodity, 'spread_percent', {R("(max_price - min_price) / modal_price * 100", 4)} FROM obs WHERE modal_price > 0)
SELECT commodity, measure, count(*) AS n, {R("min(x)", 1)} AS lowest, {R("CAST(sum(CAST(floor(x * 10000 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 10000.0", 1)} AS mean, {R("max(x)", 1)} AS highest,
  {R("quantile_cont(x, 0.05)", 1)} AS p5, {R("quantile_cont(x, 0.5)", 1)} AS median, {R("quantile_cont(x, 0.95)", 1)} AS p95 FROM x WHERE x IS NOT NULL GROUP BY commodity, measure""")
def price_description(spark, d):
    return q.described(p.observations(spark, d))


@query(f"""WITH {RESOLVED}, now AS (SELECT * FROM (SELECT *, max(reported_date) OVER (PARTITION BY mandi_id, commodity) AS last_day FROM resolved) WHERE reported_date = last_day)
SELECT mandi_id, mandi, count(*) AS reports, string_agg(concat_ws('|', commodity, coalesce(variety, ''), coalesce(grade, ''), observation_id, CAST(CAST(floor(modal_price * 100 + 0.5) AS BIGINT) AS VARCHAR), source), chr(10)
  ORDER BY commodity, variety NULLS FIRST, grade NULLS FIRST, observation_id) AS current_prices FROM now GROUP BY mandi_id, mandi""")
def market_current_prices(spark, d):
    line = lambda x: F.concat_ws("|", x["commodity"], F.coalesce(x["variety"], F.lit("")), F.coalesce(x["grade"], F.lit("")), x["observation_id"], F.floor(x["modal_price"] * 100 + 0.5).cast("string"), x["source"])
    return m.current_prices(p.observations(spark, d)).select("mandi_id", "mandi", F.size("current_prices").cast("long").alias("reports"), F.array_join(F.transform("current_prices", line), "\n").alias("current_prices"))


RUPEES = lambda c: f"CAST(floor(kg / 100.0::DOUBLE * {c} + 0.5) AS BIGINT)"


@query(f"""WITH {DAILY}, {LAST}, costs AS (SELECT commodity, mandi_id, 'NATION_' || CAST(mandi_id AS VARCHAR) AS mandi, price, CASE WHEN mandi_id = 4 THEN 113.75::DOUBLE ELSE 269.0::DOUBLE END AS cost FROM last WHERE price > 0),
nets AS (SELECT *, greatest({R("price - cost", 2)}, 0.0::DOUBLE) AS net_price FROM costs),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY commodity ORDER BY net_price DESC, mandi_id) AS INTEGER) AS place, count(*) OVER (PARTITION BY commodity) AS markets FROM nets),
parts AS (SELECT *, 'single' AS plan, 100 AS share_percent, 1255 AS kg FROM k WHERE place = 1 UNION ALL SELECT *, 'split', 60, 753 FROM k WHERE place = 1 AND markets > 1 UNION ALL SELECT *, 'split', 40, 502 FROM k WHERE place = 2),
sums AS (SELECT commodity, plan, place, mandi, share_percent, CAST(kg AS BIGINT) AS kg, price, net_price, {RUPEES("price")} AS gross, {RUPEES("cost")} AS freight, {RUPEES("net_price")} AS net FROM parts),
plans AS (SELECT *, CAST(sum(net) OVER (PARTITION BY commodity, plan) AS BIGINT) AS plan_net, CAST(sum(freight) OVER (PARTITION BY commodity, plan) AS BIGINT) AS plan_freight FROM sums)
SELECT *, plan_net - max(net) FILTER (WHERE plan = 'single') OVER (PARTITION BY commodity) AS delta FROM plans""")
def allocation_plans(spark, d):
    """1,255 kg of a farmer in market 4, as in allocation."""
    name = F.concat(F.lit("NATION_"), F.col("mandi_id").cast("string"))
    latest = r.last_rows(daily(spark, d)).withColumn("mandi", name).withColumn("district", name)
    return dec.allocation_plans(latest, F.lit("Nation_4"), 1255)
