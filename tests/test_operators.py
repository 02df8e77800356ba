import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import texts as t
from granary.functions.numbers import percent_change, rounded
from granary.functions.speech import speech
from granary.operators import boosting, decisions, market, models, risk, serving, store, talks
from granary.operators import series as s

START = date(2026, 1, 5)
SERIES = "mandi_id long, commodity string, reported_date date, price double, arrivals double, is_sample boolean"


def prices(spark, values, arrivals=None, days=None):
    days = days or [START + timedelta(k) for k in range(len(values))]
    return spark.createDataFrame([(1, "ONION", d, float(v), None if arrivals is None else arrivals[k], False) for k, (v, d) in enumerate(zip(values, days))], SERIES)


def steady(n=60):
    return [1000 + 1.5 * i + 40 * (i % 7 - 3) for i in range(n)]


def test_rounding(spark):
    x = spark.createDataFrame([(-2.5,), (2.5,), (None,)], "x double").select(rounded(F.col("x"), 0).alias("r")).collect()
    assert [v.r for v in x] == [-2.0, 3.0, None]
    assert spark.range(1).select(percent_change(F.lit(0.0), F.lit(1.0)).alias("p")).first().p is None


def test_features_never_see_their_own_day_or_later(spark):
    values = steady()
    base = s.with_features(prices(spark, values)).filter("place <= 30").orderBy("place").collect()
    changed = s.with_features(prices(spark, values[:29] + [v * 3 for v in values[29:]])).filter("place <= 30").orderBy("place").collect()
    assert [[r[c] for c in s.FEATURES] for r in base] == [[r[c] for c in s.FEATURES] for r in changed]


def test_feature_values(spark):
    v = steady()
    row = s.with_features(prices(spark, v, [float(i % 5) for i in range(60)])).filter("place = 31").first()
    past = np.array(v[:30])
    assert row.lag_1 == past[-1] and row.lag_14 == past[-14]
    assert row.mean_7 == pytest.approx(past[-7:].mean()) and row.std_7 == pytest.approx(past[-7:].std()) and row.slope_7 == pytest.approx(np.polyfit(range(7), past[-7:], 1)[0])
    assert row.change_7 == pytest.approx((past[-1] - past[-8]) / past[-8]) and row.deviation == pytest.approx(past[-1] - past[-14:].mean())


def test_short_series_has_no_matrix(spark):
    assert s.training_matrix(prices(spark, steady(14)), 1).isEmpty()
    assert s.training_matrix(prices(spark, steady(20)), 1).count() == 6
    assert s.training_matrix(prices(spark, steady(20)), 7).count() == 0


def test_gaps(spark):
    r = s.gap_report(prices(spark, [1, 2, 3], days=[date(2026, 8, 1), date(2026, 8, 5), date(2026, 8, 6)])).first()
    assert (r.days, r.irregular_gaps, r.longest_gap, r.mean_gap) == (3, 1, 4, 2.5)


OBS = "observation_id string, mandi_id long, commodity string, reported_date date, modal_price double, min_price double, max_price double, arrival_quantity double, arrival_unit string, source string, precedence int, is_sample boolean, variety string"


def test_daily_collapse(spark):
    day = date(2026, 8, 1)
    rows = [("a", 1, "O", day, 1000.0, None, None, 10.0, "t", "DATA_GOV_IN", 40, False, "x"), ("b", 1, "O", day, 1100.0, 900.0, 1200.0, 5.0, "t", "DATA_GOV_IN", 40, False, "y"), ("c", 1, "O", day, 900.0, 800.0, 1000.0, 1.0, "t", "DATA_GOV_IN", 40, False, "z"), ("d", 1, "O", day, 2000.0, 1.0, 2.0, 3.0, "t", "MOCK_PROVIDER", 0, True, "x")]
    r = s.daily(spark.createDataFrame(rows, OBS)).first()
    assert (r.price, r.contributing, r.min_price, r.max_price, r.arrivals, r.is_sample) == (1000.0, 3, None, None, 16.0, False)


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 100.0, 110.0, 90.0), (1, 200.0, 180.0, 100.0), (1, 300.0, 330.0, 200.0), (2, 0.0, 1.0, 0.0)], "horizon int, actual double, p double, before double")
    m = {r.horizon: r for r in s.metrics(rows, "p").collect()}
    assert m[1].mae == 20 and m[1].rmse == pytest.approx(math.sqrt(1400 / 3), abs=1e-3) and m[1].direction == 100.0
    assert m[2].mape is None and m[2].direction is None


def test_interval_fallback(spark):
    few = spark.createDataFrame([(1, "O", 1, 100.0, 100.0)] * 3, "mandi_id long, commodity string, horizon int, actual double, p double")
    r = s.intervals(few, "p").first()
    assert (r.low, r.high, r.offset) == (-0.16, 0.16, 0.0)


def forecast_rows(spark, rows):
    return spark.createDataFrame([(1, "ONION", h, float(p), float(lo), float(hi), float(c)) for h, p, lo, hi, c in rows], "mandi_id long, commodity string, horizon int, predicted double, lower double, upper double, confidence double")


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, 2050, 1980, 2100, 90), (2, 2100, 2000, 2200, 90)], ("LOW", 0.0, None)),
        ([(1, 1980, 1900, 2100, 90), (2, 1900, 1820, 2100, 90)], ("MODERATE", 5.0, 2)),
        ([(1, 1900, 1800, 2100, 90), (3, 1760, 1600, 2100, 90)], ("HIGH", 12.0, 3)),
    ],
)
def test_price_decline(spark, rows, expected):
    r = risk.price_decline(prices(spark, [2000]), forecast_rows(spark, rows)).first()
    assert (r.decline, r.max_drop, r.worst_horizon) == expected


def test_price_decline_without_forecast(spark):
    assert risk.price_decline(prices(spark, [2000]), forecast_rows(spark, [(1, 1, 1, 1, 1)]).limit(0)).first().decline == "UNKNOWN"


@pytest.mark.parametrize("values, expected", [([2000, 2010, 1995, 2005, 2000, 2015], "LOW"), ([2000, 2250, 1950, 2300, 2100], "HIGH"), ([2000, 2010], "UNKNOWN")])
def test_volatility(spark, values, expected):
    assert risk.volatility(prices(spark, values)).first().volatility == expected


@pytest.mark.parametrize("arrivals, expected", [([100.0, 100.0, 100.0, 100.0, 160.0], ("HIGH", 1.6)), ([100.0, 105.0, 95.0, 102.0, 100.0], ("LOW", 1.0)), ([1.0, 2.0], ("UNKNOWN", None))])
def test_arrival_surge(spark, arrivals, expected):
    r = risk.arrival_surge(prices(spark, [1] * len(arrivals), arrivals)).first()
    assert (r.surge, r.ratio) == expected


def test_uncertainty_and_freshness(spark):
    assert risk.uncertainty(forecast_rows(spark, [(1, 2000, 1750, 2250, 55)])).first().uncertainty == "HIGH"
    for day, level, age in ((date(2026, 10, 9), "LOW", 1), (date(2026, 10, 5), "MODERATE", 5), (date(2026, 9, 28), "HIGH", 12)):
        r = risk.freshness(prices(spark, [1], days=[day]), "2026-10-10").first()
        assert (r.freshness, r.age) == (level, age)


def test_overall_is_unknown_rather_than_low(spark):
    rows = spark.createDataFrame([(1, "O", None, "UNKNOWN", None, None, "LOW")], "mandi_id long, commodity string, decline string, volatility string, surge string, uncertainty string, freshness string")
    assert risk.overall(rows).first().overall == "UNKNOWN"


def test_hold_or_sell(spark):
    f = forecast_rows(spark, [(2, 2100, 2000, 2200, 80), (7, 2300, 2100, 2500, 70)])
    r = decisions.hold_or_sell(prices(spark, [2000]), f, 10.0, 2).first()
    assert (r.value_now, r.value_then, r.value_low, r.value_high, r.difference, r.confidence) == (20000, 21000, 20000, 22000, 1000, 80)
    assert decisions.hold_or_sell(prices(spark, [2000]), f, 10.0, 0).first().difference == 0
    none = decisions.hold_or_sell(prices(spark, [2000]), f, 10.0, 5).first()
    assert none.status == "NO_FORECAST" and none.value_then is None


def test_distances_and_allocation(spark):
    km = lambda a, b: spark.range(1).select(decisions.distance_km(F.lit(a), F.lit(b)).alias("k")).first().k
    assert (km("Kolhapur", "Pune"), km("solapur ", "Ahmednagar"), km("Chhatrapati Sambhajinagar", "pune"), km("Nashik", "Dhule")) == (235, 225, 230, 160)
    assert (km("Pune", "pune"), km("Pune", "Ahmednagar"), km("nashik", "Pune"), km("Pune", "Delhi"), km("Satara", "Pune"), km(None, "Pune")) == (25, 122, 212, 140, 110, 30)
    latest = spark.createDataFrame([(1, "Pune", "Pune", "ONION", 2000.0), (2, "Nashik", "Nashik", "ONION", 2200.0)], "mandi_id long, mandi string, district string, commodity string, price double")
    r = decisions.allocation(latest, F.lit("Pune"), 1000.0).first()
    assert (r.best, r.best_net, r.second_net, r.single_value) == ("Pune", 1886.25, 1833.8, 18862.5)


def test_resolution_and_previous_report(spark):
    rows = [("a", 1, "O", date(2026, 9, 1), 10.0, None, None, None, None, "CEDA", 30, False, "x"), ("b", 1, "O", date(2026, 9, 1), 20.0, None, None, None, None, "DATA_GOV_IN", 40, False, None), ("c", 1, "O", date(2026, 9, 3), 25.0, None, None, None, None, "DATA_GOV_IN", 40, False, None), ("d", 1, "O", date(2026, 9, 3), 24.0, None, None, None, None, "DATA_GOV_IN", 40, False, "x")]
    obs = spark.createDataFrame(rows, OBS).withColumn("grade", F.lit(None).cast("string"))
    assert {(r.observation_id, r.rows_of_day) for r in market.resolved(obs).collect()} == {("b", 2), ("c", 2), ("d", 2)}
    out = {r.observation_id: (r.previous_price, r.trend_percent, r.trend) for r in market.with_trend(market.with_previous(obs, obs)).collect()}
    assert out == {"a": (None, None, "none"), "b": (None, None, "none"), "c": (20.0, 25.0, "up"), "d": (None, None, "none")}


def test_unknown_filter(spark):
    with pytest.raises(ValueError):
        market.where(prices(spark, [1]), color="red")


CASES = {
    "onions in Pune": "LATEST_PRICE", "will onion price go up tomorrow": "FORECAST", "is it risky to sell onion": "RISK_EXPLANATION", "my onion leaves are turning yellow, what now": "CLARIFICATION", "hello": "GENERAL_GREETING", "hi, onion price?": "LATEST_PRICE",
    "कांद्याचा भाव काय आहे": "LATEST_PRICE", "should I sell now": "SELL_TIMING", "which mandi is best": "RECOMMENDATION_EXPLANATION", "what is the MSP": "MARKET_EDUCATION", "how accurate is the forecast": "FORECAST_UNCERTAINTY", "wheat trend last month": "PRICE_HISTORY", "आमच्या गावात": "CLARIFICATION",
}


def test_intents(spark):
    turns = spark.createDataFrame([(k, 0, text) for k, text in enumerate(CASES)] + [(99, 0, None)], "conv_id long, turn long, text string")
    out = {r.conv_id: r.intent for r in talks.understood(turns).collect()}
    assert [out[k] for k in range(len(CASES))] == list(CASES.values()) and out[99] == "CLARIFICATION"


def test_carry_forward(spark):
    turns = spark.createDataFrame([(1, 0, "onion price in Pune"), (1, 1, "what about Nashik"), (1, 2, "and for sweet potatoes"), (2, 0, "what about it")], "conv_id long, turn long, text string")
    out = [(r.crop, r.place, r.intent) for r in talks.understood(turns).orderBy("conv_id", "turn").collect()]
    assert out == [("Onion", "Pune", "LATEST_PRICE"), ("Onion", "Nashik", "LATEST_PRICE"), ("Sweet Potato", "Nashik", "LATEST_PRICE"), (None, None, "CLARIFICATION")]


def test_numbers(spark):
    x = spark.createDataFrame([("१,४०० and 1,00,000 or 3.5",)], "t string").select(t.numbers(F.col("t")).alias("n"), t.ungrounded(F.lit("about 1650, 12 days, 1800"), F.array(F.lit(1649.5))).alias("u")).first()
    assert x.n[0] == 1400 and x.n[-1] == 3.5 and x.u == [1800.0]


SPOKEN = [
    ("en", "₹1,400/quintal", "1400 rupees per quintal"), ("en", "₹1,000 - ₹1,600", "1000 to 1600 rupees"), ("en", "2026-10-08: **+3.5%** <b>up</b>", "8 October 2026: plus 3.5 percent up"), ("en", None, ""), ("en", "  *** ", ""),
    ("en", "wait 7,8 days", "wait 7,8 days"), ("en", "Bags of 10,20 and 1,400", "Bags of 10,20 and 1400"), ("en", "INR 1,20,000 in all", "120000 rupees in all"), ("en", "Rs. 2,450 per quintal", "2450 rupees per quintal"),
    ("en", "in INR per quintal", "in rupees per quintal"), ("en", "INR/quintal", "rupees per quintal"), ("en", "It was ₹1,400, an old price.", "It was 1400 rupees, an old price."), ("en", "up +2% , down (-1 %) or 3-4", "up plus 2 percent, down (minus 1 percent) or 3-4"),
    ("en", "**Wheat** • at https://example.org today 🙂", "Wheat at today"), ("en", "1,2345 and 12,34,567.50", "1,2345 and 1234567.50"), ("en", "2026-13-01", "2026-13-01"),
    ("hi", "₹1,400/क्विंटल, दिनांक 2026-10-08, +5%", "1400 रुपये प्रति क्विंटल, दिनांक 8 अक्टूबर 2026, प्लस 5 प्रतिशत"), ("mr", "₹1,000 - ₹1,600, 2026-10-08", "1000 ते 1600 रुपये, 8 ऑक्टोबर 2026"),
]


def test_speech(spark):
    rows = spark.createDataFrame([(k, x) for k, (_, x, _) in enumerate(SPOKEN)], "k int, t string")
    for language in ("en", "hi", "mr"):
        out = {r.k: r.s for r in rows.select("k", speech(F.col("t"), language).alias("s")).collect()}
        assert [(x, out[k]) for k, (lang, x, _) in enumerate(SPOKEN) if lang == language] == [(x, y) for lang, x, y in SPOKEN if lang == language]
    long = spark.createDataFrame([("word " * 400,)], "t string").select(speech(F.col("t")).alias("s")).first().s
    assert len(long) <= 1000 and long.endswith("word…")


def test_ridge_is_the_closed_form():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    x[:, 2] = 5.0  # without spread: only the penalty keeps it in place
    w, mean, scale = models.ridge(x, y)
    assert scale[2] == 1 and w[3] == 0 and np.allclose(w[0], y.mean())
    z = (x[:, :2] - mean[:2]) / scale[:2]
    assert np.allclose(w[1:3], np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean())))
    free = models.ridge(x[:, :2], y, 0.0)[0]
    assert np.allclose(np.linalg.lstsq(np.hstack([np.ones((40, 1)), z]), y, rcond=None)[0], free)


def test_ridge_beats_the_last_value_on_a_steady_series(spark):
    series = prices(spark, steady(180))
    out = models.ridge_forecast(series, 1, 1).collect()
    assert len(out) == 36
    before = {START + timedelta(k + 1): v for k, v in enumerate(steady(180))}
    assert np.mean([abs(r.actual - r.predicted) for r in out]) < np.mean([abs(r.actual - before[r.reported_date]) for r in out])


def test_every_step_of_a_walk_is_a_fit_of_its_own():
    rng = np.random.default_rng(3)
    x = np.column_stack([1000 + rng.normal(0, 30, 50).cumsum(), rng.normal(0, 1, 50), np.full(50, 7.0)])
    y = np.log(1000 + rng.normal(0, 20, 50))
    rows = np.arange(12, 50)
    got = models.walk(x, y, rows, rows - 1)
    for i, value in zip(rows, got):
        w, mean, scale = models.ridge(x[: i - 1], y[: i - 1])
        assert value == pytest.approx(w[0] + ((x[i] - mean) / scale) @ w[1:], abs=1e-8)


def test_forecasts_are_of_the_chosen_model_for_all_horizons(spark):
    values = steady(80)
    series = prices(spark, values, arrivals=[1.0] * 80)
    assert models.chosen(models.walked(series)).first().model == "ridge"  # without boosted trees
    walk = models.walked(series, boosted=("validation", "latest")).cache()
    model = models.chosen(walk).first().model
    latest = {r.horizon: r for r in walk.filter("part = 'latest'").collect()}
    out = {r.horizon: r for r in models.selected_forecasts(series).collect()}
    assert sorted(out) == list(range(1, 8))
    rows = models.feature_rows(series).toPandas()
    columns = [*s.FEATURES, *s.CALENDAR]
    for h, r in out.items():
        one = rows[rows["horizon"] == h].sort_values("reported_date")
        past, now = one[one["part"] != "latest"], one[one["part"] == "latest"]
        w, mean, scale = models.ridge(past[columns].to_numpy(float), np.log(past["target"].to_numpy(float)))
        assert latest[h].ridge == pytest.approx(np.exp(w[0] + ((now[columns].to_numpy(float)[0] - mean) / scale) @ w[1:]), abs=0.01)
        assert r.model == model and r.predicted == pytest.approx(latest[h][model], abs=0.01) and r.forecast_date == START + timedelta(79 + h) and r.last_price == values[-1] and r.lower <= r.predicted <= r.upper
    assert models.selected_forecasts(series, str(START + timedelta(79 + 31))).count() == 0
    assert models.walked(series.limit(0)).count() == 0


def test_models_are_chosen_by_every_validation_day(spark):
    """Of 80 days 16 are validation days, and trees that are a candidate for a choice are grown for each, as ridge is."""
    walk = models.walked(prices(spark, steady(80), arrivals=[1.0] * 80), (1, 7), ("validation", "latest"))
    told = walk.groupBy("horizon", "part").agg(F.count("*").alias("days"), F.count(F.nanvl("gbm", F.lit(None).cast("double"))).alias("boosted")).collect()
    assert {(r.horizon, r.part): (r.days, r.boosted) for r in told if r.part != "train" and r.part != "test"} == {(h, part): (n, n) for h in (1, 7) for part, n in (("validation", 16), ("latest", 1))}
    assert not any(r.boosted for r in told if r.part in ("train", "test"))
    test = models.boosted_forecast(prices(spark, steady(80), arrivals=[1.0] * 80), (1,)).collect()
    assert len(test) == 6  # every third of 16 test days


def test_a_walk_sees_no_later_price(spark):
    values = steady(60)
    day = START + timedelta(40)
    seen = lambda v: [x for _, x in sorted((r.horizon, r.ridge) for r in models.walked(prices(spark, v, arrivals=[1.0] * 60)).filter(F.col("reported_date") == F.lit(day)).collect())]
    assert seen(values) == pytest.approx(seen(values[:40] + [v * 2 for v in values[40:]])) and len(seen(values)) == 7


def test_series_too_short_to_walk_or_choose(spark):
    for n, forecasts in ((0, 0), (1, 0), (14, 0), (24, 1), (25, 2)):  # a horizon needs 10 targets before the latest day, and the first 14 days are no rows
        assert models.walked(prices(spark, steady(60)[:n], arrivals=[1.0] * n)).filter("part = 'latest'").count() == forecasts


def test_conflicts_only_on_touched_days_and_only_once(spark):
    rows = [("a", 5, "A", 100.0, None), ("b", 5, "B", 100.4, None), ("c", 5, "C", 101.0, None), ("d", 6, "A", 100.0, "x"), ("e", 6, "B", 200.0, "x"), ("f", 6, "B", 201.0, "y"), ("g", 6, "A", 90.0, None)]
    obs = spark.createDataFrame([(i, 1, "ONION", date(2026, 1, day), source, price, variety, None) for i, day, source, price, variety in rows], "observation_id string, mandi_id long, commodity string, reported_date date, source string, modal_price double, variety string, grade string")
    pairs = lambda log: sorted((r.observation_id_a, r.observation_id_b) for r in log.collect())
    every = serving.conflicts(obs, obs)
    assert pairs(every) == [("a", "c"), ("b", "c"), ("d", "e")]
    assert pairs(serving.conflicts(obs, obs.filter("observation_id = 'f'"))) == [("d", "e")]
    assert pairs(serving.conflicts(obs, obs, every.filter("price_b < 150"))) == [("d", "e")]
    assert serving.conflicts(obs.limit(0), obs).count() == 0


def test_pages_lookups_guards_and_windows(spark):
    rows = spark.createDataFrame([(k, f" Name{k % 3}") for k in range(7)], "id long, name string")
    assert [(r.id, r.total) for r in serving.page(rows, F.desc("id"), limit=3, offset=5).collect()] == [(1, 7), (0, 7)]
    asked = spark.createDataFrame([("NAME1 ",), ("4",), ("x",), (None,)], "asked string")
    assert sorted((r.asked, r.id) for r in serving.lookup(rows, asked, "id", "id", "name").collect()) == [("4", 4), ("NAME1 ", 1)]
    batch = spark.createDataFrame([("A", "1"), ("A", None), (None, "1"), ("B", "1")], "source string, source_record_key string")
    assert sorted(str(tuple(r)) for r in serving.guarded(batch, batch.union(batch).filter("source = 'A'")).filter("action = 'skipped'").collect()) == ["('A', '1', 'skipped')"]
    log = spark.createDataFrame([("A", "SUCCESS", date(2026, 1, 1)), ("B", "SUCCESS", date(2025, 1, 1)), ("C", "FAILED", date(2026, 1, 9)), ("D", "SUCCESS", date(2026, 1, 10))], "source string, status string, synced_on date")
    assert {r.source: r.days for r in serving.incremental_window(log, "2026-01-10").collect()} == {"A": 10, "B": 30, "C": 30, "D": 3}
    known = spark.createDataFrame([("K", "old")], "code string, name string")
    assert [tuple(r) for r in serving.new_members(known, spark.createDataFrame([("K", "new"), ("N", "b"), ("N", "a"), (None, "c")], "code string, name string"), "code", "name").collect()] == [("N", "a")]


def test_inbox_counts_all_and_lists_the_newest(spark):
    rows = [(1, k, f"2001-01-{k:02d}") for k in range(1, 8)] + [(2, 20, "2001-01-01"), (None, 21, "2001-01-01")]
    triggers = spark.createDataFrame(rows, "user long, alert_id long, reported_date string")
    read = spark.createDataFrame([(7,), (7,), (1,), (None,)], "alert_id long")
    out = {(r.user, r.alert_id): (r.is_read, r.total, r.unread) for r in serving.inbox(triggers, read, 3).collect()}
    assert out == {(1, 7): (True, 7, 5), (1, 6): (False, 7, 5), (1, 5): (False, 7, 5), (2, 20): (False, 1, 1), (None, 21): (False, 1, 1)}
    assert serving.inbox(triggers.limit(0), read).count() == 0


def test_samples_count_only_where_nothing_else_is(spark):
    rows = [("S", "a", 1, True, 5.0, "2001-01-03"), ("S", "a", 2, False, 6.0, "2001-01-01"), ("S", "a", 3, False, 7.0, "2001-01-01"), ("T", "a", 4, True, 8.0, "2001-01-01"), ("T", "a", 5, False, 0.0, "2001-01-09")]
    obs = spark.createDataFrame(rows, "state string, commodity string, mandi_id long, is_sample boolean, modal_price double, reported_date string").selectExpr("*", "'INR/quintal' AS price_unit", "CAST(mandi_id AS STRING) AS observation_id")
    out = [(r.state, r.mandi_id, r.role, r.sample_only) for r in serving.prices_in_area(obs, "state").orderBy("state", "place").collect()]
    assert out == [("S", 2, "primary", False), ("S", 3, "alternative", False), ("T", 4, "primary", True)]


def test_answers_say_what_is_missing(spark):
    said = spark.createDataFrame([(1, 1, "Onion", "LATEST_PRICE"), (1, 2, None, "LATEST_PRICE"), (1, 3, "Wheat", "LATEST_PRICE"), (1, 4, "Onion", "FORECAST")], "conv_id int, turn int, crop string, intent string")
    names = spark.createDataFrame([("Onion", "c1"), ("Wheat", "c2")], "crop string, commodity string")
    prices = spark.createDataFrame([("c1", 1400.5, "2001-01-01", "N")], "commodity string, modal_price double, reported_date string, mandi string")
    out = [(r.turn, r.status, r.answer) for r in serving.answers(said, names, prices).orderBy("turn").collect()]
    assert out == [(1, "ANSWERED", "The newest price of Onion is ₹1400.50 per quintal."), (2, "NO_COMMODITY", None), (3, "NO_DATA", None)]


def test_spelling_variants(spark):
    variants = spark.createDataFrame([(" Nasik", "Nashik"), ("NASIK ", "Other"), (None, "x")], "variant string, name string")
    asked = spark.createDataFrame([("nasik",), ("Pune",), (None,)], "asked string")
    assert {r.asked: r.name for r in serving.respelled(asked, variants).collect()} == {"nasik": "Nashik", "Pune": "Pune", None: None}


def plain_boosting(x, y, trees=boosting.TREES):
    """One model, node by node; x are bins. Predictions of its own rows."""
    out = np.full(len(y), y.mean())

    def grow(rows, rest, depth):
        best, cut = boosting.LEAST_GAIN, None
        score = lambda r: rest[r].sum() ** 2 / (len(r) + boosting.L2)
        for f in range(x.shape[1]):
            for b in range(boosting.BINS):
                left, right = rows[x[rows, f] <= b], rows[x[rows, f] > b]
                if min(len(left), len(right)) >= boosting.LEAST_LEAF and score(left) + score(right) - score(rows) > best + 1e-9:
                    best, cut = score(left) + score(right) - score(rows), (left, right)
        if depth == 0 or cut is None:
            return {int(r): boosting.RATE * rest[rows].sum() / (len(rows) + boosting.L2) for r in rows}
        return grow(cut[0], rest, depth - 1) | grow(cut[1], rest, depth - 1)

    for _ in range(trees):
        added = grow(np.arange(len(y)), y - out, boosting.DEPTH)
        out = out + np.array([added[k] for k in range(len(y))])
    return out


def test_boosting_of_many_models_is_that_of_each():
    rng = np.random.default_rng(5)
    sets = []
    for n in (60, 12, 35):
        x = rng.normal(size=(n, 3))
        sets.append((boosting.codes(x, boosting.edges(x)), np.where(x[:, 0] > 0, 1.0, 0.0) + 0.3 * x[:, 1] + rng.normal(0, 0.05, n)))
    model = np.repeat(np.arange(3), [len(y) for _, y in sets])
    code = np.concatenate([c for c, _ in sets])
    grown = boosting.fit(model, code, np.concatenate([y for _, y in sets]), 3, trees=12)
    got = grown.predict(model, code)
    assert got == pytest.approx(np.concatenate([plain_boosting(c, y, 12) for c, y in sets]), abs=1e-5)


def test_models_of_the_same_rows_are_grown_together_as_by_fits_of_their_own(monkeypatch):
    rng = np.random.default_rng(17)
    groups = []
    for n in (60, 90, 400):
        x = np.column_stack([rng.normal(0, 1, (n, 3)), np.sin(np.arange(n) % 7), np.full(n, 2.0)])  # few bins of the last two have rows
        rows = np.append(np.arange(n // 5, n, 4), n - 1)
        groups.append((boosting.codes(x, boosting.edges(x[: n // 2])), 7 + x[:, 0] * (x[:, 1] > 0) + rng.normal(0, 0.1, n), rows, rows - np.minimum(rows, 3)))
    alone = [[boosting.fit(np.zeros(k, int), code[:k], y[:k], 1, 9).predict(np.zeros(1, int), code[i : i + 1])[0] for i, k in zip(rows, known)] for code, y, rows, known in groups]
    real, fitted = boosting.fit, []
    monkeypatch.setattr(boosting, "fit", lambda model, *rest: fitted.append(len(model)) or real(model, *rest))
    for got, expected in zip(boosting.walk(groups, 9), alone):
        assert got == pytest.approx(expected, abs=1e-12)
    assert sum(fitted) < 0.3 * sum(known.sum() for *_, known in groups)  # the early models, which few others are like


def test_boosting_walks_over_known_rows_only():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 4))
    y = x[:, 0] + rng.normal(0, 0.1, 50)
    code, rows = boosting.codes(x, boosting.edges(x[:30])), np.arange(30, 50, 3)
    got = boosting.walk([(code, y, rows, rows - 2)])[0]
    changed = y.copy()
    changed[40:] += 100
    again = boosting.walk([(code, changed, rows, rows - 2)])[0]
    assert got[rows - 2 <= 40] == pytest.approx(again[rows - 2 <= 40]) and abs(again[-1] - got[-1]) > 1
    assert np.sqrt(np.mean((got - y[rows]) ** 2)) < 0.6 * y.std()


def test_stored_models_score_as_they_were_fitted(spark, tmp_path):
    series = prices(spark, steady(80), arrivals=[1.0] * 80)
    path = str(tmp_path / "models")
    store.save(store.trained(series, (1, 3)), path, "v1")
    store.save(store.trained(series, (1,)), path, "v2")
    store.save(store.trained(series, (1, 3)), path, "v1")  # the same version again
    models_ = store.load(spark, path, "v1")
    assert [(r.version, r.model, r.models) for r in store.versions(store.load(spark, path)).orderBy("version", "model").collect()] == [("v1", "gbm", 2), ("v1", "ridge", 2), ("v2", "gbm", 1), ("v2", "ridge", 1)]
    ask = store.latest_rows(series, (1, 3))
    first = {(r.model, r.horizon): r.predicted for r in store.scored(models_, ask).collect()}
    assert first == {(r.model, r.horizon): r.predicted for r in store.scored(models_, ask).collect()} and len(first) == 4
    walk = {r.horizon: r for r in models.walked(series, (1, 3), ("latest",)).filter("part = 'latest'").collect()}
    for (model, h), value in first.items():
        assert value == pytest.approx(walk[h][model], rel=1e-6)


def test_boosted_trees_are_a_candidate(spark):
    """A price that jumps by weekday in a way that no line follows."""
    values = [2000.0 + (500 if (k * 5) % 7 in (1, 2, 4) else 0) + 3 * np.sin(k) for k in range(160)]
    out = models.selected_forecasts(prices(spark, values, arrivals=[1.0] * 160)).collect()
    assert {r.model for r in out} == {"gbm"} and len(out) == 7
    later = {START + timedelta(k): 2000.0 + (500 if (k * 5) % 7 in (1, 2, 4) else 0) for k in range(160, 170)}
    assert all(abs(r.predicted - later[r.forecast_date]) < 120 for r in out)


def test_the_last_day_is_taken_before_sources_are_ranked(spark):
    rows = [(1, "x", "2001-01-01", "A", 40), (1, "x", "2001-01-02", "B", 30), (1, "x", "2001-01-02", "B", 30), (1, "x", "2001-01-02", "C", 10), (2, "x", "2001-01-01", "C", 10), (2, "x", "2001-01-01", "A", 40)]
    obs = spark.createDataFrame(rows, "mandi_id long, commodity string, reported_date string, source string, precedence int").withColumn("reported_date", F.to_date("reported_date"))
    out = market.latest_resolved(obs)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.mandi_id, str(r.reported_date), r.source, r.rows_of_day) for r in out.collect()) == [(1, "2001-01-02", "B", 3), (1, "2001-01-02", "B", 3), (2, "2001-01-01", "A", 2)]
    assert sorted(map(str, out.collect())) == sorted(map(str, market.latest_day(market.resolved(obs)).collect()))
