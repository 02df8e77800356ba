"""Queries of a service: pages, lookups, conflict log, dimensions, forecast runs and incremental windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import texts as t
from granary.operators import decisions as dec
from granary.operators import market as m
from granary.operators import series as s
from granary.operators import serving as v
from granary.operators import talks
from granary.plans.analytics import TRIGGERS
from granary.plans.market import LATEST, ROW, ROW_SQL
from granary.plans.registry import query
from granary.plans.series import FORECASTS, daily
from granary.plans.texts import TURNS, turns
from granary.sources import prices as p
from granary.sources.prices import SYNC_SQL, TODAY


@query(f"WITH {LATEST} SELECT {ROW_SQL}, (SELECT count(*) FROM latest) AS total FROM latest ORDER BY reported_date DESC, observation_id DESC LIMIT 50 OFFSET 100")
def latest_page(spark, d):
    """The third page of the latest prices, with the number of all."""
    return v.page(m.latest(p.observations(spark, d)), F.desc("reported_date"), F.desc("observation_id"), limit=50, offset=100).select(*ROW, "total")


@query(f"WITH h AS (SELECT * FROM obs WHERE mandi_id = 3 AND source = 'CEDA') SELECT {ROW_SQL}, (SELECT count(*) FROM h) AS total FROM h ORDER BY reported_date DESC, observation_id DESC LIMIT 200")
def history_page_total(spark, d):
    history = m.where(p.observations(spark, d), market="3", source="CEDA")
    return v.page(history, F.desc("reported_date"), F.desc("observation_id"), limit=200).select(*ROW, "total")


@query("""WITH asked AS (SELECT DISTINCT ' ' || lower(s_name) AS asked FROM supplier UNION SELECT CAST(s_suppkey AS VARCHAR) FROM supplier UNION SELECT 'nowhere'),
named AS (SELECT s_suppkey, 0 AS rank, CAST(s_suppkey AS VARCHAR) AS name FROM supplier UNION ALL SELECT s_suppkey, 1, lower(trim(s_name)) FROM supplier UNION ALL SELECT s_suppkey, 2, lower(trim(n_name)) FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT asked, s_suppkey FROM (SELECT asked, s_suppkey, row_number() OVER (PARTITION BY asked ORDER BY rank, s_suppkey) AS k FROM asked JOIN named ON lower(trim(asked)) = name) WHERE k = 1""", obs=False)
def market_lookup(spark, d):
    """Markets by number, code and name, in that order."""
    markets = p.markets(spark, d)
    asked = markets.select(F.concat(F.lit(" "), F.lower("market_code")).alias("asked")).union(markets.select(F.col("s_suppkey").cast("string"))).union(spark.range(1).select(F.lit("nowhere")))
    return v.lookup(markets, asked, "s_suppkey", "s_suppkey", "market_code", "mandi")


CONFLICTS = """touched AS (SELECT DISTINCT mandi_id, commodity, reported_date FROM obs WHERE reported_date >= DATE '1997-01-01'),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, mandi_id, commodity, reported_date, variety, grade ORDER BY observation_id DESC) AS place FROM obs) WHERE place = 1 AND (mandi_id, commodity, reported_date) IN (SELECT (mandi_id, commodity, reported_date) FROM touched)),
conflicts AS (
  SELECT a.mandi_id AS mandi_id, a.commodity AS commodity, a.reported_date AS reported_date, a.variety AS variety, a.grade AS grade, a.source AS source_a, b.source AS source_b, a.observation_id AS observation_id_a, b.observation_id AS observation_id_b, a.modal_price AS price_a, b.modal_price AS price_b
  FROM one a JOIN one b ON a.mandi_id = b.mandi_id AND a.commodity = b.commodity AND a.reported_date = b.reported_date AND a.variety IS NOT DISTINCT FROM b.variety AND a.grade IS NOT DISTINCT FROM b.grade AND a.source < b.source
  WHERE abs(a.modal_price - b.modal_price) / greatest(least(a.modal_price, b.modal_price), 1.0) > 0.005)"""


def conflict_rows(spark, d):
    """Conflicts of the market-days that a batch, the reports since 1997, has touched."""
    obs = p.observations(spark, d)
    return v.conflicts(obs, m.where(obs, start="1997-01-01"))


@query(f"WITH {CONFLICTS} SELECT * FROM conflicts")
def conflict_log(spark, d):
    return conflict_rows(spark, d)


@query(f"""WITH {CONFLICTS}, log AS (SELECT CASE WHEN grade IS NULL THEN 'UNGRADED' ELSE 'GRADED' END AS type, CASE WHEN substr(observation_id_a, 1, 1) < '8' THEN 'OPEN' ELSE 'RESOLVED' END AS status FROM conflicts)
SELECT type, status, count(*) AS conflicts FROM log GROUP BY ROLLUP (type, status)""")
def conflict_counts(spark, d):
    log = conflict_rows(spark, d).select(F.when(F.col("grade").isNull(), "UNGRADED").otherwise("GRADED").alias("type"), F.when(F.substring("observation_id_a", 1, 1) < "8", "OPEN").otherwise("RESOLVED").alias("status"))
    return v.conflict_counts(log)


@query("""SELECT market_code, min({'mandi': mandi, 'state': state}).mandi AS mandi, min({'mandi': mandi, 'state': state}).state AS state FROM obs
WHERE reported_date >= DATE '1998-06-01' AND market_code NOT IN (SELECT market_code FROM obs WHERE reported_date < DATE '1992-03-01') GROUP BY market_code""")
def new_markets(spark, d):
    """Markets that reports since June 1998 name and those before March 1992 don't."""
    obs = p.observations(spark, d)
    return v.new_members(obs.filter("reported_date < DATE'1992-03-01'").select("market_code").distinct(), m.where(obs, start="1998-06-01"), "market_code", "mandi", "state")


@query("SELECT observation_id, CASE WHEN substr(observation_id, 1, 1) < '8' AND grade IS NOT NULL THEN 'skipped' ELSE 'read' END AS action FROM obs")
def source_record_guard(spark, d):
    """Records whose number begins below 8 have been delivered, unless they have no grade."""
    batch = p.observations(spark, d).withColumn("source_record_key", F.col("observation_id"))
    return v.guarded(batch, batch.filter("grade IS NOT NULL AND substr(observation_id, 1, 1) < '8'")).select("observation_id", "action")


RUNS = f"""{FORECASTS},
versions(version, back) AS (VALUES ('v1', 2), ('v2', 1), ('v1', 0)),
made AS (SELECT mandi_id, commodity, forecast_date, horizon, version AS model_version, DATE '{TODAY}' - back AS generated_at, version || '-' || back AS run_id, predicted + back AS predicted FROM forecasts JOIN versions ON version = 'v1' OR mandi_id % 2 = 0 OR horizon <= 3)"""


def made(spark, d):
    """The forecasts as three runs of two versions made them; the second left some out, and the older ones said a little more."""
    runs = F.array(*[F.struct(F.lit(version).alias("model_version"), F.lit(back).alias("back")) for version, back in (("v1", 2), ("v2", 1), ("v1", 0))])
    rows = s.forecasts(daily(spark, d)).withColumn("r", F.explode(runs)).select("*", "r.*").filter("model_version = 'v1' OR mandi_id % 2 = 0 OR horizon <= 3")
    generated = F.date_sub(F.to_date(F.lit(TODAY)), F.col("back"))
    return rows.select(*s.SERIES, "forecast_date", "horizon", "model_version", generated.alias("generated_at"), F.concat_ws("-", "model_version", F.col("back").cast("string")).alias("run_id"), (F.col("predicted") + F.col("back")).alias("predicted"))


@query(f"WITH {RUNS} SELECT * FROM (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY mandi_id, commodity, forecast_date, horizon, model_version ORDER BY generated_at DESC, run_id DESC) = 1)")
def forecast_upsert(spark, d):
    return v.upserted(made(spark, d))


@query(f"""WITH {RUNS} SELECT mandi_id, commodity, forecast_date, horizon, model_version, generated_at, run_id, predicted, CASE WHEN run_id = 'v2-1' THEN 'SUCCESS' END AS status
FROM (SELECT *, max(generated_at) OVER (PARTITION BY mandi_id, commodity) AS last FROM made WHERE model_version = 'v2') WHERE generated_at = last""")
def forecast_latest_set(spark, d):
    """The last set of version v2, though v1 has a later one."""
    runs = spark.createDataFrame([("v2-1", "SUCCESS")], "run_id string, status string")
    return v.latest_set(made(spark, d), runs, model_version="v2")


@query(f"WITH {RUNS} SELECT model_version, count(DISTINCT run_id) AS runs, count(DISTINCT mandi_id || '|' || commodity) AS series, max(generated_at) AS last_generated FROM made GROUP BY model_version")
def model_versions(spark, d):
    return made(spark, d).groupBy("model_version").agg(F.count_distinct("run_id").alias("runs"), F.count_distinct(*s.SERIES).alias("series"), F.max("generated_at").alias("last_generated"))


@query(f"""WITH {SYNC_SQL}, w AS (SELECT source, max(synced_on) FILTER (WHERE status = 'SUCCESS') AS last_success FROM runs WHERE synced_on <= DATE '1995-03-01' GROUP BY source),
f AS (SELECT source, last_success, greatest(least(coalesce(last_success, DATE '1995-03-20' - 29), DATE '1995-03-20' - 2), DATE '1995-03-20' - 29) AS "from" FROM w)
SELECT source, last_success, "from", DATE '1995-03-20' AS "to", CAST(DATE '1995-03-20' - "from" + 1 AS INTEGER) AS days FROM f""", obs=False)
def incremental_window(spark, d):
    """What is to be read on 20 March 1995, of runs up to the first of that month."""
    return v.incremental_window(p.sync_log(spark, d).filter("synced_on <= DATE'1995-03-01'"), "1995-03-20")


@query(f"""WITH {TRIGGERS}, mine AS (SELECT *, alert_id % 40 AS "user", alert_id % 3 = 0 AS is_read FROM hits),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY reported_date DESC, alert_id DESC) AS place, count(*) OVER (PARTITION BY "user") AS total, count(*) FILTER (WHERE NOT is_read) OVER (PARTITION BY "user") AS unread FROM mine)
SELECT "user", alert_id, observation_id, modal_price, reported_date, is_read, total, unread FROM ranked WHERE place <= 5""")
def alert_inbox(spark, d):
    """A user has the alerts whose numbers have the same remainder by 40; those with a number divisible by 3 have been read."""
    rules = p.alert_rules(spark, d)
    hits = dec.alert_triggers(p.observations(spark, d), rules, TODAY).withColumn("user", F.col("alert_id") % 40)
    return v.inbox(hits, rules.filter("alert_id % 3 = 0")).select("user", "alert_id", "observation_id", "modal_price", "reported_date", "is_read", "total", "unread")


@query("""WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state, commodity, mandi_id, is_sample ORDER BY reported_date DESC, observation_id DESC) AS k FROM obs WHERE modal_price > 0) WHERE k = 1),
kind AS (SELECT *, bool_and(is_sample) OVER (PARTITION BY state, commodity) AS sample_only FROM one),
placed AS (SELECT *, row_number() OVER (PARTITION BY state, commodity ORDER BY reported_date DESC, mandi_id) AS place FROM kind WHERE is_sample = sample_only)
SELECT state, commodity, mandi, modal_price, reported_date, source, sample_only, CASE WHEN place = 1 THEN 'primary' ELSE 'alternative' END AS role FROM placed WHERE place <= 5""")
def prices_in_area(spark, d):
    return v.prices_in_area(p.observations(spark, d), "state").select("state", "commodity", "mandi", "modal_price", "reported_date", "source", "sample_only", "role")


CROP_NAMES = [(name, f"Brand#{11 + k // 5 * 10 + k % 5}") for k, (name, *_) in enumerate(t.CROPS)]


@query(f"""WITH {TURNS}, names(crop, commodity) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in CROP_NAMES)}),
newest_of_all AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY reported_date DESC, observation_id DESC) AS k FROM obs WHERE NOT is_sample AND modal_price > 0) WHERE k = 1)
SELECT conv_id, turn, u.crop AS crop, CASE WHEN u.crop IS NULL THEN 'NO_COMMODITY' WHEN modal_price IS NULL THEN 'NO_DATA' ELSE 'ANSWERED' END AS status,
  CASE WHEN modal_price IS NOT NULL THEN 'The newest price of ' || u.crop || ' is ₹' || printf('%.2f', modal_price) || ' per quintal.' END AS answer, modal_price, reported_date, mandi
FROM understood u LEFT JOIN names ON names.crop = u.crop LEFT JOIN newest_of_all n ON n.commodity = names.commodity WHERE intent = 'LATEST_PRICE'""")
def grounded_answers(spark, d):
    """Answers to all turns that ask for a price; crops stand for brands, in the order of both."""
    prices = m.latest(m.genuine(p.observations(spark, d), "usable"), ("commodity",))
    return v.answers(talks.understood(turns(spark, d)), spark.createDataFrame(CROP_NAMES, "crop string, commodity string"), prices)


@query("""SELECT asked, s_suppkey FROM (SELECT DISTINCT ' Market of ' || n_name AS asked, min(s_suppkey) OVER (PARTITION BY n_name) AS s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
UNION ALL SELECT s_name, s_suppkey FROM supplier""", obs=False)
def variant_lookup(spark, d):
    """Markets by a spelling variant of their names, and by their codes, which have none."""
    markets = p.markets(spark, d)
    variant = F.concat(F.lit("MARKET OF "), F.col("mandi"))
    asked = markets.select(F.concat(F.lit(" Market of "), F.col("mandi")).alias("asked")).distinct().unionByName(markets.select(F.col("market_code").alias("asked")))
    names = v.respelled(asked, markets.select(variant.alias("variant"), F.col("mandi").alias("name")))
    found = v.lookup(markets, names.select(F.col("name").alias("asked")).distinct(), "s_suppkey", "market_code", "mandi")
    return names.join(found.withColumnRenamed("asked", "name"), "name").select("asked", "s_suppkey")


@query("SELECT commodity, mandi_id, variety, count(DISTINCT reported_date) AS days FROM obs WHERE commodity IS NOT NULL AND mandi_id IS NOT NULL AND variety IS NOT NULL GROUP BY commodity, mandi_id, variety")
def series_found(spark, d):
    return v.series_found(p.observations(spark, d))


@query(f"""WITH {SYNC_SQL} SELECT count(*) AS records, count(*) FILTER (WHERE NOT is_sample) AS genuine, count(DISTINCT mandi_id) AS markets, count(DISTINCT commodity) AS commodities, max(reported_date) AS last_date,
(SELECT count(*) FROM runs) AS runs, (SELECT count(*) FROM runs WHERE status = 'FAILED') AS failed_runs, (SELECT max(synced_on) FROM runs WHERE status = 'SUCCESS') AS last_success FROM obs""")
def pipeline_counters(spark, d):
    return v.counters(p.observations(spark, d), p.sync_log(spark, d))
