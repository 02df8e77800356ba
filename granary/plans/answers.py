"""Queries over catalogues, and answers out of several kinds of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import texts as t
from granary.operators import answers as a
from granary.operators import market as m
from granary.operators import series as s
from granary.operators import talks
from granary.plans.registry import query
from granary.plans.series import FORECASTS, daily
from granary.plans.serving import CROP_NAMES
from granary.plans.texts import TURNS, turns
from granary.sources import catalogues
from granary.sources import prices as p
from granary.sources.prices import TODAY

PROPS = "k long"


def told(spark, d):
    """The events, of which every 50th has its JSON cut off."""
    cut = F.substring("props", F.lit(1), F.length("props") - 1)
    return p.table(spark, d, "events").withColumn("props", F.when(F.col("event_id") % 50 == 0, cut).otherwise(F.col("props")))


@query("""WITH good AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS date FROM events WHERE event_id % 50 <> 0),
quantities AS (SELECT user_id AS market_id, date, arg_max(k, event_id) AS quantity FROM good WHERE event_type = 'view' GROUP BY 1, 2)
SELECT event_id AS report_id, user_id AS market_id, g.date AS date, value AS price, quantity, CASE WHEN quantity IS NOT NULL THEN 'tonne' END AS arrival_unit
FROM good g LEFT JOIN quantities q ON q.market_id = g.user_id AND q.date = g.date WHERE event_type = 'purchase'""", obs=False)
def prices_with_quantities(spark, d):
    """Purchases are price rows, views are quantity rows of the same market and day; JSON that is cut off is kept apart."""
    good, _ = catalogues.parsed(told(spark, d), "props", PROPS)
    rows = good.select(F.col("event_id").alias("report_id"), F.col("user_id").alias("market_id"), F.col("ts").cast("date").alias("date"), "event_type", F.col("value").alias("price"), F.col("props.k").alias("quantity"))
    prices = rows.filter("event_type = 'purchase'").select("report_id", "market_id", "date", "price")
    return catalogues.with_quantities(prices, rows.filter("event_type = 'view'"), F.col("report_id"))


@query("SELECT event_type, count(*) AS malformed, min(event_id) AS first_event FROM events WHERE event_id % 50 = 0 GROUP BY event_type", obs=False)
def malformed_records(spark, d):
    _, bad = catalogues.parsed(told(spark, d), "props", PROPS)
    return bad.groupBy("event_type").agg(F.count("*").alias("malformed"), F.min("event_id").alias("first_event"))


LANGUAGES = ("en", "hi", "mr", "ta")
#: Places stand for markets, in the order of both; the last ones for none.
MARKETS = [(name, f"NATION_{k}") for k, (name, *_) in enumerate(t.PLACES[:-2])]


def _said(key: str, **values: str) -> str:
    quoted = lambda lang: " || ".join(values[x] if named else "'" + x.replace("'", "''") + "'" for named, x in a.pieces(a.TEMPLATES[lang][key]))
    return "CASE language " + " ".join(f"WHEN '{lang}' THEN {quoted(lang)}" for lang in a.TEMPLATES if lang != "en") + f" ELSE {quoted('en')} END"


def _wants(kinds: tuple[str, ...]) -> str:
    return "intent IN (" + ", ".join(f"'{x}'" for x in kinds) + ")"


def _values(rows) -> str:
    return ", ".join(f"('{x}', '{y}')" for x, y in rows)


_MONEY = lambda x: f"printf('%.2f', {x})"
_TOLD = "t_price IS NOT NULL AND intent <> 'PRICE_HISTORY'"
_FORECAST = "f_price IS NOT NULL AND NOT f_sample"


@query(f"""WITH {FORECASTS}, {TURNS.strip()},
usable AS (SELECT * FROM obs WHERE NOT is_sample AND price_unit IS NOT NULL AND modal_price > 0),
scoped AS (SELECT *, mandi AS scope FROM usable UNION ALL SELECT *, '*' FROM usable),
price AS (SELECT commodity, scope, modal_price AS t_price, mandi AS t_market, source AS t_source, reported_date AS t_day, date_diff('day', reported_date, DATE '{TODAY}') AS t_age FROM (SELECT *, row_number() OVER (PARTITION BY commodity, scope ORDER BY reported_date DESC, observation_id DESC) AS k FROM scoped) WHERE k = 1),
means AS (SELECT commodity, scope, reported_date, floor(sum(CAST(floor(modal_price * 100 + 0.5) AS BIGINT)) / count(*) / 100.0 * 100 + 0.5) / 100 AS mean FROM scoped GROUP BY 1, 2, 3),
trend0 AS (SELECT commodity, scope, count(*) AS days, arg_min(mean, reported_date) AS oldest, arg_max(mean, reported_date) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY commodity, scope ORDER BY reported_date DESC) AS k FROM means) WHERE k <= 7 GROUP BY 1, 2),
trend AS (SELECT *, floor((newest - oldest) / oldest * 100 * 10 + 0.5) / 10 AS change FROM trend0 WHERE days >= 2 AND oldest > 0),
forecast AS (SELECT f.commodity AS commodity, n_name AS scope, horizon, forecast_date AS f_day, predicted AS f_price, lower AS f_lower, upper AS f_upper, is_sample AS f_sample FROM forecasts f JOIN nation ON n_nationkey = f.mandi_id),
names(crop, commodity) AS (VALUES {_values(CROP_NAMES)}), markets(place, market) AS (VALUES {_values(MARKETS)}),
asked AS (SELECT u.*, ['en', 'hi', 'mr', 'ta'][CAST(u.conv_id % 4 + 1 AS INTEGER)] AS language, n.commodity AS commodity, k.market AS market, coalesce(k.market, '*') AS scope FROM understood u LEFT JOIN names n ON n.crop = u.crop LEFT JOIN markets k ON k.place = u.place),
joined AS (SELECT a.*, CASE WHEN {_wants(a.WANTS_PRICE)} THEN p.t_price END AS t_price, t_market, t_source, t_day, t_age, CASE WHEN {_wants(a.WANTS_TREND)} THEN t.days END AS days, oldest, newest, change,
  CASE WHEN {_wants(a.WANTS_FORECAST)} THEN f_price END AS f_price, f_day, f_lower, f_upper, f_sample
  FROM asked a LEFT JOIN price p ON p.commodity = a.commodity AND p.scope = a.scope LEFT JOIN trend t ON t.commodity = a.commodity AND t.scope = a.scope LEFT JOIN forecast f ON f.commodity = a.commodity AND f.scope = a.scope AND f.horizon = coalesce(a.horizon, 1)),
state AS (SELECT *, CASE WHEN intent = 'GENERAL_GREETING' THEN 'GREETING' WHEN NOT ({_wants(a.WANTS_PRICE)}) THEN 'NOT_A_PRICE_QUESTION' WHEN crop IS NULL THEN 'NO_COMMODITY' WHEN commodity IS NULL THEN 'UNSUPPORTED_CROP' WHEN t_price IS NULL AND days IS NULL AND NOT coalesce({_FORECAST}, false) THEN 'NO_DATA' ELSE 'ANSWERED' END AS status FROM joined)
SELECT conv_id, turn, intent, crop, place, status, CASE status WHEN 'GREETING' THEN {_said("greeting")} WHEN 'NO_COMMODITY' THEN {_said("ask_crop")} WHEN 'UNSUPPORTED_CROP' THEN {_said("unsupported", crop="crop")} WHEN 'NOT_A_PRICE_QUESTION' THEN NULL ELSE concat_ws(' ',
    CASE WHEN {_TOLD} THEN {_said("price", crop="crop", price=_MONEY("t_price"), market="t_market", day="CAST(t_day AS VARCHAR)", source="t_source")} END, CASE WHEN {_TOLD} AND t_age > 7 THEN {_said("old", age="CAST(t_age AS VARCHAR)")} END,
    CASE WHEN t_price IS NULL THEN {_said("no_price", crop="crop")} END, CASE WHEN days IS NOT NULL THEN {_said("trend", days="CAST(days AS VARCHAR)", oldest=_MONEY("oldest"), latest=_MONEY("newest"), change="printf('%.1f', change)")} END,
    CASE WHEN {_FORECAST} THEN {_said("forecast", day="CAST(f_day AS VARCHAR)", predicted=_MONEY("f_price"), lower=_MONEY("f_lower"), upper=_MONEY("f_upper"))} END,
    CASE WHEN intent IN ('FORECAST', 'FORECAST_UNCERTAINTY') AND NOT coalesce({_FORECAST}, false) THEN {_said("no_forecast")} END, CASE WHEN intent = 'SELL_TIMING' THEN {_said("sell")} END, CASE WHEN intent = 'RISK_EXPLANATION' THEN {_said("risk")} END) END AS answer,
  CASE WHEN status IN ('ANSWERED', 'NO_DATA') THEN concat_ws(',', CASE WHEN t_price IS NOT NULL THEN 'price' END, CASE WHEN days IS NOT NULL THEN 'trend' END, CASE WHEN {_FORECAST} THEN 'forecast' END) END AS sources,
  CASE WHEN status IN ('ANSWERED', 'NO_DATA') THEN concat_ws(',', CASE WHEN t_price IS NOT NULL AND t_age > 7 THEN 'STALE_PRICE' END, CASE WHEN t_price IS NULL THEN 'NO_PRICE' END, CASE WHEN {_wants(a.WANTS_TREND)} AND days IS NULL THEN 'NO_TREND' END, CASE WHEN {_FORECAST} THEN 'PROJECTION' END,
    CASE WHEN f_price IS NOT NULL AND f_sample THEN 'SAMPLE_FORECAST_ONLY' END, CASE WHEN {_wants(a.WANTS_FORECAST)} AND f_price IS NULL THEN 'NO_FORECAST' END, CASE WHEN place IS NOT NULL AND market IS NULL THEN 'UNKNOWN_PLACE' END) ELSE '' END AS limitations,
  true AS grounded FROM state""")
def sourced_answers(spark, d):
    """What every turn is told, in four languages (one of which has no templates), with the kinds of its sources and its limitations."""
    usable = m.genuine(p.observations(spark, d), "usable")
    asked = talks.understood(turns(spark, d)).withColumn("language", F.get(F.array(*map(F.lit, LANGUAGES)), (F.col("conv_id") % 4).cast("int")))
    nation = p.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("mandi_id"), F.col("n_name").alias("scope"))
    forecasts = s.forecasts(daily(spark, d)).join(nation, "mandi_id")
    names, markets = spark.createDataFrame(CROP_NAMES, "crop string, commodity string"), spark.createDataFrame(MARKETS, "place string, market string")
    out = a.answered(asked, names, markets, a.price_evidence(usable, TODAY), a.trend_evidence(usable), a.forecast_evidence(forecasts))
    return out.select("conv_id", "turn", "intent", "crop", "place", "status", "answer", F.array_join("kinds", ",").alias("sources"), F.array_join("limitations", ",").alias("limitations"), "grounded")
