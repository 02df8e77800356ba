"""Queries over stored models."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.numbers import rounded
from granary.operators import series as s
from granary.operators import store
from granary.plans.registry import query
from granary.plans.series import BASE, daily
from granary.session import work_folder


@query(f"""WITH {BASE[5:] if BASE.startswith("WITH ") else BASE},
fits AS (SELECT mandi_id, commodity, horizon, count(*) AS n, regr_slope(ln(actual), ln(last_value)) AS slope, regr_intercept(ln(actual), ln(last_value)) AS intercept
  FROM base WHERE actual > 0 AND last_value > 0 GROUP BY mandi_id, commodity, horizon),
newest AS (SELECT mandi_id, commodity, max(reported_date) AS last_date, arg_max(price, reported_date) AS last_price FROM series GROUP BY mandi_id, commodity)
SELECT mandi_id, commodity, CAST(horizon AS INTEGER) AS horizon, n AS trained_rows, last_date, floor(exp(intercept + slope * ln(last_price)) * 100 + 0.5) / 100 AS predicted
FROM fits JOIN newest USING (mandi_id, commodity) WHERE n >= 10 AND slope IS NOT NULL AND NOT isnan(slope)""")
def stored_lag_forecasts(spark, d):
    """Models of one feature are trained, stored, read again and scored on each series' last price."""
    series, path = daily(spark, d), f"{work_folder(spark)}/models"
    store.save(store.lag_models(s.baselines(series)), path, "lag-1")
    last = series.groupBy("mandi_id", "commodity").agg(F.max("reported_date").alias("last_date"), F.max_by("price", "reported_date").alias("last_price"))
    values = F.create_map(F.lit("log_last"), F.ln("last_price"))
    rows = last.withColumn("values", values).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in s.HORIZONS])))
    out = store.scored(store.load(spark, path, "lag-1"), rows)
    return out.select("mandi_id", "commodity", "horizon", "trained_rows", "last_date", rounded(F.col("predicted")).alias("predicted"))


@query()
def stored_forecasts(spark, d):
    """Ridge and boosted trees of all series, trained once, stored, and scored without a further fit."""
    series, path = daily(spark, d), f"{work_folder(spark)}/models"
    store.save(store.trained(series), path, "1")
    out = store.scored(store.load(spark, path, "1"), store.latest_rows(series))
    return out.select("mandi_id", "commodity", "horizon", "model", "version", "trained_rows", "last_date", "forecast_date", rounded(F.col("predicted")).alias("predicted"))
