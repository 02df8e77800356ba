"""Lists that are paged, plans, exports, appended lines, files of series, and arrival features in models."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.operators import decisions as dec
from granary.operators import exchange as x
from granary.operators import lists, models
from granary.operators import risk as r
from granary.operators import series as s

DAY = dt.date(2026, 3, 1)


def triggers(spark):
    rows = [(1, k, k % 2, "ONION", DAY + dt.timedelta(k // 2)) for k in range(7)] + [(2, 90, 0, "WHEAT", DAY), (None, 91, 0, "WHEAT", DAY)]
    return spark.createDataFrame(rows, "user int, alert_id int, mandi_id int, commodity string, reported_date date")


def test_history_pages(spark):
    page = lambda **k: sorted((q.user, q.alert_id, q.total, q.total_pages) for q in lists.history_page(triggers(spark), **k).collect() if q.user)
    assert page(page=2, limit=3) == [(1, 1, 7, 3), (1, 2, 7, 3), (1, 3, 7, 3)]
    assert page(page=9, limit=3) == []
    assert page(mandi_id=1, limit=2) == [(1, 3, 3, 2), (1, 5, 3, 2)]
    assert page(commodity="WHEAT") == [(2, 90, 1, 1)]
    assert page(since="2026-03-04") == [(1, 6, 1, 1)]
    assert [q.alert_id for q in lists.history_page(triggers(spark)).filter("user IS NULL").collect()] == [91]
    assert lists.history_page(triggers(spark).limit(0)).count() == 0
    assert [lists.bounded(v, 20, 100) for v in (None, 0, -3, 7, 500)] == [20, 20, 1, 7, 100]


def test_unread_counts_do_not_depend_on_what_is_shown(spark):
    rows = spark.createDataFrame([(1, k, DAY, k % 2 == 0) for k in range(6)] + [(2, 9, DAY, True)], "user int, notification_id int, created_on date, is_read boolean")
    shown = lambda **k: sorted((q.user, q.notification_id, q.unread) for q in lists.notifications(rows, **k).collect())
    assert shown(limit=2) == [(1, 4, 3), (1, 5, 3), (2, 9, 0)]
    assert shown(unread_only=True) == [(1, 1, 3), (1, 3, 3), (1, 5, 3)]


def test_favourites_show_defaults_first(spark):
    chosen = spark.createDataFrame([(1, "A", False, DAY), (1, "B", True, None), (1, "C", None, DAY + dt.timedelta(1)), (1, "GONE", True, DAY)], "user int, commodity string, is_default boolean, created_on date")
    items = spark.createDataFrame([("A",), ("B",), ("C",)], "commodity string")
    assert [q.commodity for q in lists.favourites(chosen, items, "commodity").orderBy("place").collect()] == ["B", "C", "A"]


def test_a_page_says_nothing_of_all_data(spark):
    page = spark.createDataFrame([(True, DAY, "MOCK_PROVIDER")], "is_sample boolean, reported_date date, source string")
    sources = spark.createDataFrame([("CEDA", False, 5, 2, DAY), ("MOCK_PROVIDER", True, 9, 0, DAY)], "source string, is_sample boolean, records long, stale_days int, last_date date")
    one = lists.with_global_freshness(lists.page_meta(page, "2026-03-05"), sources).first()
    assert (one.genuine_rows, one.sample_rows, one.latest_genuine, one.page_age, one.global_age, one.global_records, one.is_stale) == (0, 1, None, None, 2, 5, False)
    none = lists.with_global_freshness(lists.page_meta(page.limit(0), "2026-03-05"), sources.filter("is_sample")).first()
    assert (none.genuine_rows, none.global_records, none.is_stale) == (0, 0, None)


def test_a_plan_has_a_total_only_if_all_its_parts_do(spark):
    latest = spark.createDataFrame([(1, "ONION", 2000.0), (2, "ONION", 1000.0)], "mandi_id long, commodity string, price double")
    forecasts = spark.createDataFrame([(1, "ONION", 2, 2100.0)], "mandi_id long, commodity string, horizon int, predicted double")
    schema = "ask_id int, commodity string, mandi_id long, quantity double, days int, allocations array<struct<mandi_id: long, quantity: double, days: int>>"
    asks = [(1, "ONION", 1, 10.0, 2, None), (2, "ONION", 1, 10.0, 0, []), (3, "ONION", 1, 1.0, 1, [(1, 10.0, 2), (2, 1.0, 0)]), (4, "ONION", 1, 1.0, 1, [(1, 10.0, 2), (2, 1.0, 3)]), (5, "KALE", 1, 1.0, 2, None)]
    got = {q.ask_id: (q.mode, q.markets, q.value_now, q.value_then, q.status) for q in dec.scenarios(spark.createDataFrame(asks, schema), latest, forecasts).collect()}
    assert got == {
        1: ("single", 1, 20000.0, 21000.0, "AVAILABLE"), 2: ("single", 1, 20000.0, 20000.0, "AVAILABLE"), 3: ("plan", 2, 21000.0, 22000.0, "AVAILABLE"),
        4: ("plan", 2, 21000.0, None, "NO_FORECAST"), 5: ("single", 1, None, None, "NO_MARKET_DATA"),
    }


def test_units(spark):
    rows = spark.createDataFrame([(None,), ("",), ("QUINTAL",), ("inr/Kg",), (" INR/quintal ",)], "raw string")
    assert [q[0] for q in rows.select(x.canonical_unit(F.col("raw"))).collect()] == ["INR/quintal", "INR/quintal", "INR/quintal", "INR/kg", "INR/quintal"]
    fields = spark.createDataFrame([([("Modal Price (Rs./Quintal)", "m")],), ([("p", "rate_rs/kg")],), ([("per kg", None), ("per quintal", None)],), ([("state", "s")],), ([],), (None,)], "f array<struct<name: string, id: string>>")
    assert [q[0] for q in fields.select(x.unit_of_fields(F.col("f"))).collect()] == ["INR/quintal", "INR/kg", "INR/quintal", None, None, None]


def test_genuine_rows_are_not_trained_on_as_made_up(spark):
    made = lambda rows: spark.createDataFrame(rows, "mandi_id long, commodity string, reported_date date, source string, is_sample boolean")
    old, new = DAY - dt.timedelta(365), DAY
    good = [(m, "ONION", day, "MOCK_PROVIDER", True) for m in range(20) for day in (old, old + dt.timedelta(1), new)]
    assert x.made_up_series(made(good), 1).count() == 40
    shards = [x.made_up_series(made(good), shard=(k, 3)) for k in range(3)]
    assert sum(q.count() for q in shards) == 60 and all(q.select("mandi_id").distinct().count() * 3 == q.count() for q in shards)
    for bad in ((1, "ONION", new, "CEDA", True), (1, "ONION", new, "MOCK_PROVIDER", False), (1, "ONION", new, None, None)):
        with pytest.raises(ValueError, match="1 rows"):
            x.made_up_series(made([*good, bad]))
    assert x.made_up_series(made([]), 1, (0, 2)).count() == 0


def test_appended_lines(spark, tmp_path):
    folder = str(tmp_path / "log")
    line = lambda *rows: x.append_lines(spark.createDataFrame(rows, "k string, at int, v string"), folder)
    line(("a", 1, "old"), ("b", 5, "only"))
    line(("a", 2, None))
    (tmp_path / "log" / "part-torn.json").write_text('{"k": "a", "at": 9, "v')
    got = x.last_lines(spark, folder, "k string, at int, v string", ("k",), "at")
    assert sorted(tuple(q) for q in got.collect()) == [("a", 2, None), ("b", 5, "only")]


def test_report_upsert(spark):
    schema = "source string, commodity string, report_date date, price double, arrivals double, msp double"
    old = spark.createDataFrame([("S", "A", DAY, 1.0, None, None), ("S", "B", DAY, 1.0, 2.0, 0.0), ("S", "C", DAY, 1.0, 2.0, 3.0)], schema)
    new = spark.createDataFrame([("S", "A", DAY, 9.0, None, None, 1), ("S", "A", DAY, 1.0, None, None, 2), ("S", "B", DAY, 1.0, 2.0, None, 1), ("S", "D", DAY, 4.0, None, None, 1)], schema + ", seq int")
    assert sorted((q.commodity, q.action, q.msp) for q in x.report_plan(old, new).collect()) == [("A", "unchanged", None), ("B", "updated", None), ("C", "kept", 3.0), ("D", "inserted", None)]


def series(spark, n: int = 70):
    rng = np.random.default_rng(3)
    rows = []
    for mandi in (1, 2):
        for k in range(n):
            there = mandi == 1 and k != 30 or mandi == 2 and k % 2 == 0  # market 2 has arrivals on every other day only
            rows.append((mandi, "ONION", DAY + dt.timedelta(k), 1000 + 3.0 * k + float(rng.integers(0, 40)), float(50 + rng.integers(0, 20)) if there else None, False))
    return spark.createDataFrame(rows, "mandi_id long, commodity string, reported_date date, price double, arrivals double, is_sample boolean")


def test_arrival_features_are_gated_by_series(spark):
    got = s.training_matrix(series(spark), 2, arrivals=True).toPandas()
    plain = s.training_matrix(series(spark), 2).toPandas()
    assert len(got[got.mandi_id == 2]) == len(plain[plain.mandi_id == 2]) and got[got.mandi_id == 2][list(s.ARRIVALS)].isna().all().all()
    mine = got[got.mandi_id == 1]
    assert mine[list(s.ARRIVALS)].notna().all().all() and mine["has_arrivals"].all()
    # the day without arrivals is among the seven before the days 31 to 37
    missing = {DAY + dt.timedelta(k) for k in range(31, 38)}
    assert set(plain[plain.mandi_id == 1].reported_date) - set(mine.reported_date) == missing
    one = mine.sort_values("reported_date").iloc[-1]
    past = series(spark).filter("mandi_id = 1").toPandas().set_index("reported_date")["arrivals"]
    before = past[past.index < one.reported_date]
    assert one.arrival_lag_1 == before.iloc[-1] and one.arrival_lag_7 == before.iloc[-7] and one.arrival_mean_7 == pytest.approx(before.iloc[-7:].mean()) and one.arrival_change == before.iloc[-1] - before.iloc[-2]


def test_ridge_with_arrivals_is_a_fit_with_their_columns(spark):
    data = series(spark)
    got = models.ridge_forecast(data, 1, arrivals=True).toPandas().set_index(["mandi_id", "reported_date"])
    without = models.ridge_forecast(data, 1).toPandas().set_index(["mandi_id", "reported_date"])
    assert np.allclose(got.loc[2].predicted.astype(float), without.loc[2].predicted.astype(float))
    rows = models.feature_rows(data, (1,), True).filter("mandi_id = 1").toPandas().sort_values("reported_date").reset_index(drop=True)
    columns = [*s.FEATURES, *s.CALENDAR, *s.ARRIVALS]
    day = max(d for m, d in got.index if m == 1)
    at = rows.index[rows.reported_date == day][0]
    known = rows[pd.to_datetime(rows.target_date) < pd.Timestamp(day)]
    w, mean, scale = models.ridge(known[columns].to_numpy(float), np.log(known["target"].to_numpy(float)))
    want = np.exp(w[0] + ((rows.loc[at, columns].to_numpy(float) - mean) / scale) @ w[1:])
    assert got.loc[(1, day)].predicted == pytest.approx(want, rel=1e-6)
    assert abs(got.loc[(1, day)].predicted - without.loc[(1, day)].predicted) > 1e-9


def test_profile_is_that_of_its_parts(spark):
    data = series(spark).unionByName(series(spark, 4).withColumn("mandi_id", F.col("mandi_id") + 2))
    told, latest = s.forecasts(data), r.last_rows(data)
    want = latest.select(*s.SERIES)
    for part in (r.price_decline(latest, told), r.volatility(data), r.arrival_surge(data), r.uncertainty(told), r.freshness(latest, "2026-05-12")):
        want = want.join(part, [*s.SERIES], "left")
    rows = lambda q: sorted(tuple(v) for v in q.collect())
    assert rows(r.profile(data, told, "2026-05-12")) == rows(r.overall(want)) and len(rows(want)) == 4
