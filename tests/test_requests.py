from datetime import date

import pytest
from pyspark.sql import functions as F

from granary.operators import requests as r

ASK = "search string, source string, start string, end string, limit string, offset string, order string, samples string"


def test_requests_are_rejected_not_bent(spark):
    rows = [
        (None,) * 8, ("  कांदा  (लाल) ", " data_gov_in ", "2026-02-28", "2026-03-01", "1000", "0", "desc", "false"), ("<b>", "a-b", "2026-02-31", "01/03/2026", "1001", "-1", "up", "TRUE"),
        ("", "", "", "", "", "", "", ""), ("a" * 65, None, "2026-03-02", "2026-03-01", "1.5", "99999999999999999999", None, None), (None, None, "2010-01-01", "2026-01-01", None, None, None, None),
    ]
    out = r.history_request(spark.createDataFrame(rows, ASK)).collect()
    plain = lambda x: (x.search, x.source, x.start, x.end, x.limit, x.offset, x.order, x.samples, x.errors)
    assert plain(out[0]) == plain(out[3]) == (None, None, None, None, 100, 0, "ASC", True, [])
    assert plain(out[1]) == ("कांदा (लाल)", "DATA_GOV_IN", date(2026, 2, 28), date(2026, 3, 1), 1000, 0, "DESC", False, [])
    assert out[2].errors == ["search", "source", "start", "end", "limit", "offset", "order", "samples"]
    assert out[4].errors == ["search", "limit", "offset", "start_after_end"] and out[5].errors == ["span"]


def test_names_and_amounts(spark):
    amounts = {0.0: "₹0", 999.0: "₹999", 1000.0: "₹1,000", 123456.0: "₹1,23,456", 12345678.5: "₹1,23,45,678.50", -2450.25: "-₹2,450.25"}
    rows = spark.createDataFrame([(x,) for x in amounts], "x double")
    assert {v.x: v.s for v in rows.select("x", r.rupees(F.col("x")).alias("s")).collect()} == amounts
    names = spark.createDataFrame([("Nashik APMC (Market 10121)",), (" Pune  ( market 5 ) Main",), (None,)], "n string")
    assert [v.m for v in names.select(r.market_name(F.col("n")).alias("m")).collect()] == ["Nashik APMC", "Pune Main", ""]


@pytest.mark.parametrize("text,code", [("Sweet potato", None), ("potato", "POTATO"), ("sweet  potato, then KANDA!", "ONION"), ("", None), (None, None), ("tomatoes", None), ("x aloo sweet onion", "POTATO"), ("sweet", None)])
def test_alias_after_sweet_is_none(spark, text, code):
    assert r.alias_codes(spark.createDataFrame([(1, text)], "text_id long, text string")).first().code == code


def test_why_a_forecast_is_missing(spark):
    asked = spark.createDataFrame([(1, "A", None), (2, "A", None), (3, "A", 1), (4, "A", 9), (4, "A", 1), (4, "A", None)], "mandi_id long, commodity string, horizon int")
    observed = spark.createDataFrame([(2, "A", 20), (3, "A", 21), (4, "A", 50)], "mandi_id long, commodity string, n long")
    forecasts = spark.createDataFrame([(4, "A", 1)], "mandi_id long, commodity string, horizon int")
    out = {(x.mandi_id, x.horizon): x.reason for x in r.empty_reason(asked, observed, forecasts).collect()}
    assert out == {(1, None): "NO_MARKET_DATA", (2, None): "INSUFFICIENT_HISTORY", (3, 1): "NO_FORECAST", (4, 9): "NO_FORECAST_FOR_FILTER", (4, 1): None, (4, None): None}
