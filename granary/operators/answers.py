"""Answers to what turns ask, out of several kinds of evidence: newest price, trend and forecast.

Each kind is looked up by itself, so one that is missing leaves the others as they are and becomes a limitation. A sentence comes from a template
for its language; every number in an answer is checked against the evidence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import texts as t
from granary.functions.numbers import rounded

WANTS_PRICE = ("LATEST_PRICE", "SELL_TIMING", "PRICE_HISTORY", "FORECAST", "FORECAST_UNCERTAINTY", "RISK_EXPLANATION")
WANTS_TREND = ("PRICE_HISTORY", "SELL_TIMING", "RISK_EXPLANATION")
WANTS_FORECAST = ("FORECAST", "FORECAST_UNCERTAINTY", "SELL_TIMING")
#: The scope of all markets, and days after which a price is old.
EVERYWHERE, OLD_DAYS, TREND_DAYS = "*", 7, 7

TEMPLATES = {
    "en": {
        "greeting": "Hello! Ask me for the price of a crop, its trend or a forecast.",
        "ask_crop": "Which crop do you mean?",
        "unsupported": "I have no prices of {crop}.",
        "price": "{crop} was at ₹{price} per quintal in {market} on {day} (source: {source}).",
        "old": "This report is {age} days old.",
        "no_price": "There is no recent price of {crop}.",
        "trend": "Over {days} reporting days it went from ₹{oldest} to ₹{latest}, {change} percent.",
        "forecast": "For {day} the model expects ₹{predicted}, between ₹{lower} and ₹{upper}.",
        "no_forecast": "There is no forecast for it.",
        "sell": "Prices can turn, so weigh storage and transport before you decide.",
        "risk": "Price risk grows with large swings and old reports.",
    },
    "hi": {
        "greeting": "नमस्ते! किसी फसल का भाव, रुझान या अनुमान पूछिए।",
        "ask_crop": "आप किस फसल के बारे में पूछ रहे हैं?",
        "unsupported": "{crop} के भाव मेरे पास नहीं हैं।",
        "price": "{day} को {market} में {crop} का भाव ₹{price} प्रति क्विंटल था (स्रोत: {source})।",
        "old": "यह सूचना {age} दिन पुरानी है।",
        "no_price": "{crop} का कोई ताज़ा भाव नहीं मिला।",
        "trend": "{days} सूचना-दिनों में भाव ₹{oldest} से ₹{latest} हुआ, {change} प्रतिशत।",
        "forecast": "{day} के लिए अनुमान ₹{predicted} है, ₹{lower} और ₹{upper} के बीच।",
        "no_forecast": "इसका कोई अनुमान नहीं है।",
        "sell": "भाव बदल सकते हैं; भंडारण और ढुलाई का खर्च भी देखें।",
        "risk": "बड़े उतार-चढ़ाव और पुरानी सूचना से जोखिम बढ़ता है।",
    },
    "mr": {
        "greeting": "नमस्कार! पिकाचा भाव, कल किंवा अंदाज विचारा.",
        "ask_crop": "आपण कोणत्या पिकाबद्दल विचारत आहात?",
        "unsupported": "{crop} चे भाव माझ्याकडे नाहीत.",
        "price": "{day} रोजी {market} मध्ये {crop} चा भाव ₹{price} प्रति क्विंटल होता (स्रोत: {source}).",
        "old": "ही माहिती {age} दिवस जुनी आहे.",
        "no_price": "{crop} चा ताजा भाव मिळाला नाही.",
        "trend": "{days} नोंद-दिवसांत भाव ₹{oldest} वरून ₹{latest} झाला, {change} टक्के.",
        "forecast": "{day} साठी अंदाज ₹{predicted} आहे, ₹{lower} ते ₹{upper} दरम्यान.",
        "no_forecast": "याचा अंदाज उपलब्ध नाही.",
        "sell": "भाव बदलू शकतात; साठवण आणि वाहतूक खर्चही पाहा.",
        "risk": "मोठे चढउतार आणि जुनी माहिती यांमुळे जोखीम वाढते.",
    },
}


def pieces(template: str) -> list[tuple[bool, str]]:
    """Fixed texts (False) and names of values (True), in order."""
    return [(k % 2 == 1, x) for k, x in enumerate(re.split(r"\{(\w+)\}", template)) if x]


def said(key: str, language: Column, **values: Column) -> Column:
    """The template of the row's language with its values; English for a language that has none. Null if a value is null."""
    text = lambda lang: F.concat(*[values[x] if named else F.lit(x) for named, x in pieces(TEMPLATES[lang][key])])
    out = F
    for lang in TEMPLATES:
        if lang != "en":
            out = out.when(language == lang, text(lang))
    return out.otherwise(text("en"))


def by_scope(obs: DataFrame) -> DataFrame:
    """Each row for its market and for all markets together (scope)."""
    return obs.withColumn("scope", F.explode(F.array("mandi", F.lit(EVERYWHERE))))


def price_evidence(obs: DataFrame, today: str) -> DataFrame:
    """The newest report of each commodity and scope, as a struct. One aggregate: of one day the greatest id."""
    row = F.struct("modal_price", F.col("mandi").alias("market"), "source", "reported_date")
    best = by_scope(obs).groupBy("commodity", "scope").agg(F.max_by(row, F.struct("reported_date", "observation_id")).alias("p"))
    age = F.datediff(F.to_date(F.lit(today)), F.col("p.reported_date"))
    return best.select("commodity", "scope", F.struct("p.*", age.alias("age"), (age > OLD_DAYS).alias("old")).alias("price"))


def trend_evidence(obs: DataFrame) -> DataFrame:
    """Change over the last TREND_DAYS reporting days (two at least) of mean prices a day, as a struct."""
    cents = F.sum(F.floor(F.col("modal_price") * 100 + 0.5))
    daily = by_scope(obs).groupBy("commodity", "scope", "reported_date").agg(rounded(cents / F.count("*") / 100.0).alias("mean"))
    newest = Window.partitionBy("commodity", "scope").orderBy(F.desc("reported_date"))
    last = daily.withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= TREND_DAYS).groupBy("commodity", "scope").agg(
        F.count("*").alias("days"), F.min_by("mean", "reported_date").alias("oldest"), F.max_by("mean", "reported_date").alias("latest"), F.max("reported_date").alias("until")
    ).filter("days >= 2 AND oldest > 0")
    change = rounded((F.col("latest") - F.col("oldest")) / F.col("oldest") * 100, 1)
    return last.select("commodity", "scope", F.struct("days", "oldest", "latest", change.alias("change"), "until").alias("trend"))


def forecast_evidence(forecasts: DataFrame) -> DataFrame:
    """Forecasts (commodity, scope: a market, horizon, forecast_date, predicted, lower, upper, is_sample) as structs; there are none for all markets together."""
    return forecasts.select("commodity", "scope", "horizon", F.struct("forecast_date", "predicted", "lower", "upper", "is_sample").alias("forecast"))


def answered(asked: DataFrame, names: DataFrame, markets: DataFrame, price: DataFrame, trend: DataFrame, forecast: DataFrame) -> DataFrame:
    """Each asked turn with status, answer, sources (JSON without nulls), limitations (array of codes) and whether all its numbers are grounded.

    asked: conv_id, turn, language, intent, crop, place and horizon; names: crop and commodity; markets: place and market. A place that is no market is
    answered for all markets, with the limitation UNKNOWN_PLACE.
    """
    wants = lambda kinds: F.col("intent").isin(*kinds)
    rows = asked.join(names, "crop", "left").join(markets, "place", "left").withColumn("scope", F.coalesce("market", F.lit(EVERYWHERE))).withColumn("ahead", F.coalesce("horizon", F.lit(1)))
    rows = rows.join(price, ["commodity", "scope"], "left").join(trend, ["commodity", "scope"], "left").join(forecast.withColumnRenamed("horizon", "ahead"), ["commodity", "scope", "ahead"], "left")
    real = wants(WANTS_FORECAST) & F.col("forecast").isNotNull() & ~F.col("forecast.is_sample")
    rows = rows.withColumns({"price": F.when(wants(WANTS_PRICE), F.col("price")), "trend": F.when(wants(WANTS_TREND), F.col("trend")), "sampled": F.coalesce(wants(WANTS_FORECAST) & F.col("forecast.is_sample"), F.lit(False)), "forecast": F.when(real, F.col("forecast"))})
    language, crop, money, day = F.col("language"), F.col("crop"), lambda c: F.format_string("%.2f", c), lambda c: c.cast("string")
    p, tr, f = (lambda n, k=k: F.col(f"{k}.{n}") for k in ("price", "trend", "forecast"))
    say = lambda key, test, **values: F.when(test, said(key, language, **values))
    told_price = p("modal_price").isNotNull() & (F.col("intent") != "PRICE_HISTORY")
    parts = F.array(
        say("price", told_price, crop=crop, price=money(p("modal_price")), market=p("market"), day=day(p("reported_date")), source=p("source")),
        say("old", told_price & p("old"), age=p("age").cast("string")),
        say("no_price", wants(WANTS_PRICE) & F.col("price").isNull(), crop=crop),
        say("trend", F.col("trend").isNotNull(), days=tr("days").cast("string"), oldest=money(tr("oldest")), latest=money(tr("latest")), change=F.format_string("%.1f", tr("change"))),
        say("forecast", F.col("forecast").isNotNull(), day=day(f("forecast_date")), predicted=money(f("predicted")), lower=money(f("lower")), upper=money(f("upper"))),
        say("no_forecast", F.col("intent").isin("FORECAST", "FORECAST_UNCERTAINTY") & F.col("forecast").isNull()),
        say("sell", F.col("intent") == "SELL_TIMING"),
        say("risk", F.col("intent") == "RISK_EXPLANATION"),
    )
    asks = wants(WANTS_PRICE)
    status = (
        F.when(F.col("intent") == "GENERAL_GREETING", "GREETING").when(~asks, "NOT_A_PRICE_QUESTION").when(crop.isNull(), "NO_COMMODITY").when(F.col("commodity").isNull(), "UNSUPPORTED_CROP")
        .when(F.col("price").isNull() & F.col("trend").isNull() & F.col("forecast").isNull(), "NO_DATA").otherwise("ANSWERED")
    )
    rows = rows.withColumn("status", status)
    answer = (
        F.when(F.col("status") == "GREETING", said("greeting", language)).when(F.col("status") == "NO_COMMODITY", said("ask_crop", language)).when(F.col("status") == "UNSUPPORTED_CROP", said("unsupported", language, crop=crop))
        .when(F.col("status").isin("ANSWERED", "NO_DATA"), F.array_join(F.array_compact(parts), " "))
    )
    known = F.col("status").isin("ANSWERED", "NO_DATA")
    limits = (
        ("STALE_PRICE", p("old")), ("NO_PRICE", F.col("price").isNull()), ("NO_TREND", wants(WANTS_TREND) & F.col("trend").isNull()), ("PROJECTION", F.col("forecast").isNotNull()),
        ("SAMPLE_FORECAST_ONLY", F.col("sampled")), ("NO_FORECAST", wants(WANTS_FORECAST) & F.col("forecast").isNull() & ~F.col("sampled")), ("UNKNOWN_PLACE", F.col("place").isNotNull() & F.col("market").isNull()),
    )
    limitations = F.when(known, F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in limits]))).otherwise(F.array().cast("array<string>"))
    none = F.lit(None)
    source = lambda kind, there, name, date, count: F.when(there, F.struct(F.lit(kind).alias("type"), name.cast("string").alias("source"), date.cast("string").alias("date"), count.cast("int").alias("count")))
    sources = F.array_compact(F.array(
        source("price", F.col("price").isNotNull(), p("source"), p("reported_date"), none), source("trend", F.col("trend").isNotNull(), none, tr("until"), tr("days")), source("forecast", F.col("forecast").isNotNull(), none, f("forecast_date"), none)
    ))
    years = [F.year(c).cast("double") for c in (p("reported_date"), f("forecast_date"))]
    allowed = F.array_compact(F.array(*[c.cast("double") for c in (p("modal_price"), p("age"), tr("oldest"), tr("latest"), F.abs(tr("change")), f("predicted"), f("lower"), f("upper"))], *years))
    out = rows.withColumns({"answer": answer, "limitations": limitations, "sources": F.when(known, sources), "allowed": allowed})
    # names of markets and crops have numbers too, which say nothing of prices
    plain = F.regexp_replace(F.coalesce("answer", F.lit("")), r"[\p{L}_]+[\d#]+\d*", " ")
    grounded = F.size(t.ungrounded(plain, F.col("allowed"))) == 0
    payload = F.to_json("sources", {"ignoreNullFields": "true"})
    return out.select("conv_id", "turn", "intent", "crop", "place", "status", "answer", F.coalesce(payload, F.lit("[]")).alias("sources"), "limitations", grounded.alias("grounded"), F.transform("sources", lambda x: x["type"]).alias("kinds"))
