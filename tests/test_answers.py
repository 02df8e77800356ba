import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from granary.functions import texts as t
from granary.operators import answers as a
from granary.sources import catalogues

TODAY = "2026-01-20"
OBS = "observation_id string, commodity string, mandi string, reported_date date, modal_price double, source string"


@pytest.fixture
def told(spark):
    rows = [("1", "C1", "M1", date(2026, 1, 18), 1500.5, "CEDA"), ("2", "C1", "M1", date(2026, 1, 15), 1400.0, "CEDA"), ("3", "C1", "M2", date(2026, 1, 5), 900.0, "CEDA"), ("4", "C2", "M2", date(2025, 12, 1), 80.0, "DATA_GOV_IN")]
    obs = spark.createDataFrame(rows, OBS)
    forecast = spark.createDataFrame(
        [("C1", "M1", 1, date(2026, 1, 19), 1510.0, 1400.0, 1620.0, False), ("C1", "M1", 3, date(2026, 1, 21), 1530.0, 1400.0, 1700.0, False), ("C2", "M2", 1, date(2025, 12, 2), 81.0, 70.0, 90.0, True)],
        "commodity string, scope string, horizon int, forecast_date date, predicted double, lower double, upper double, is_sample boolean",
    )
    names, markets = spark.createDataFrame([("Onion", "C1"), ("Wheat", "C2")], "crop string, commodity string"), spark.createDataFrame([("Nashik", "M1"), ("Pune", "M2")], "place string, market string")

    def ask(*turns, forecasts=forecast):
        asked = spark.createDataFrame([(1, k, *x) for k, x in enumerate(turns)], "conv_id long, turn long, language string, intent string, crop string, place string, horizon int")
        out = a.answered(asked, names, markets, a.price_evidence(obs, TODAY), a.trend_evidence(obs), a.forecast_evidence(forecasts))
        return [r for _, r in sorted((r.turn, r) for r in out.collect())]

    return ask


def test_each_kind_of_evidence_stands_alone(told):
    whole, no_forecast, nothing, unknown, none = told(
        ("en", "SELL_TIMING", "Onion", "Nashik", None), ("en", "SELL_TIMING", "Onion", "Pune", None), ("en", "LATEST_PRICE", "Wheat", "Nashik", None), ("en", "LATEST_PRICE", "Mango", None, None), ("hi", "LATEST_PRICE", None, None, None)
    )
    assert whole.answer == (
        "Onion was at ₹1500.50 per quintal in M1 on 2026-01-18 (source: CEDA). Over 2 reporting days it went from ₹1400.00 to ₹1500.50, 7.2 percent. "
        "For 2026-01-19 the model expects ₹1510.00, between ₹1400.00 and ₹1620.00. Prices can turn, so weigh storage and transport before you decide."
    )
    assert whole.kinds == ["price", "trend", "forecast"] and whole.limitations == ["PROJECTION"] and whole.grounded
    assert json.loads(whole.sources)[1] == {"type": "trend", "date": "2026-01-18", "count": 2}  # nulls are left out
    assert no_forecast.kinds == ["price"] and no_forecast.limitations == ["STALE_PRICE", "NO_TREND", "NO_FORECAST"] and "15 days old" in no_forecast.answer
    assert (nothing.status, nothing.limitations, nothing.sources) == ("NO_DATA", ["NO_PRICE"], "[]") and nothing.answer == "There is no recent price of Wheat."
    assert unknown.status == "UNSUPPORTED_CROP" and none.status == "NO_COMMODITY" and none.answer == a.TEMPLATES["hi"]["ask_crop"]


def test_horizons_samples_and_places(told):
    third, sampled, everywhere, lost, greeting = told(
        ("mr", "FORECAST", "Onion", "Nashik", 3), ("en", "FORECAST", "Wheat", "Pune", None), ("en", "FORECAST", "Onion", None, None), ("en", "LATEST_PRICE", "Onion", "Delhi", None), ("en", "GENERAL_GREETING", None, None, None)
    )
    assert "₹1530.00" in third.answer and "2026-01-21" in third.answer and third.grounded
    assert sampled.kinds == ["price"] and sampled.limitations == ["STALE_PRICE", "SAMPLE_FORECAST_ONLY"] and "81.00" not in sampled.answer
    assert everywhere.limitations == ["NO_FORECAST"] and everywhere.answer.endswith("There is no forecast for it.")
    assert lost.limitations == ["UNKNOWN_PLACE"] and "M1" in lost.answer and greeting.status == "GREETING" and greeting.sources == "[]"


def test_numbers_without_evidence_are_found(spark):
    rows = spark.createDataFrame([("It is ₹1500 now", [1500.5]), ("It is ₹1600 now", [1500.5])], "x string, allowed array<double>")
    assert [r.n for r in rows.select(F.size(t.ungrounded(F.col("x"), F.col("allowed"))).alias("n")).collect()] == [0, 1]


def test_every_template_names_the_same_values():
    for key in a.TEMPLATES["en"]:
        assert len({frozenset(x for named, x in a.pieces(a.TEMPLATES[lang][key]) if named) for lang in a.TEMPLATES}) == 1


def test_catalogues_keep_malformed_answers_apart(spark, tmp_path):
    whole = {"status": "ok", "output": {"data": [{"commodity_id": 1, "commodity_name": "Onion", "more": [1]}, {"commodity_id": 2, "commodity_name": "Wheat"}, {"commodity_id": 1, "commodity_name": "Onion"}]}}
    texts = [json.dumps(whole), json.dumps(whole)[:40], "[]x", json.dumps({"output": {"data": []}})]
    for k, x in enumerate(texts):
        (tmp_path / f"{k}.json").write_text(x)
    items, bad = catalogues.catalogue(spark, str(tmp_path), "commodities")
    assert sorted(map(tuple, items.collect())) == [(1, "Onion"), (2, "Wheat")]
    assert sorted(r.value for r in bad.collect()) == sorted([texts[1], texts[2]])


def test_the_last_quantity_of_a_day_counts(spark):
    prices = spark.createDataFrame([(1, "d1", 10.0), (1, "d2", 11.0), (2, "d1", 12.0)], "market_id long, date string, price double")
    quantities = spark.createDataFrame([(1, "d1", 5, 1), (1, "d1", 7, 3), (1, "d1", 6, 2), (3, "d1", 9, 1)], "market_id long, date string, quantity long, seq int")
    out = {(r.market_id, r.date): (r.quantity, r.arrival_unit) for r in catalogues.with_quantities(prices, quantities, F.col("seq")).collect()}
    assert out == {(1, "d1"): (7, "tonne"), (1, "d2"): (None, None), (2, "d1"): (None, None)}
