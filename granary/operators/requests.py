"""Requests as rows: what they ask for, checked and never bent to fit, and what a client shows of the answer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import records as rec
from granary.functions.numbers import rounded

# What a text and a source code may consist of.
TEXT = r"^[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}\s.,'()&/_-]*$"
CODE = r"^[A-Z0-9_]{1,32}$"
FRESH_DAYS, LEAST_OBSERVATIONS, PRICE_UNIT = 7, 21, "INR/quintal"


@dataclass(frozen=True)
class Checked:
    """A value, and whether something was given that isn't one."""

    value: Column
    bad: Column


def _given(raw: Column) -> Column:
    return raw.isNotNull() & (raw != "")


def _checked(raw: Column, good: Column, value: Column, fallback: Column | None = None) -> Checked:
    bad = _given(raw) & ~F.coalesce(good, F.lit(False))
    return Checked(F.when(_given(raw) & ~bad, value).otherwise(fallback) if fallback is not None else F.when(_given(raw) & ~bad, value), bad)


def text(raw: Column, most: int = 100) -> Checked:
    """White space collapsed; letters, marks, digits and some punctuation of any script. A blank text is none."""
    value = F.trim(F.regexp_replace(raw, r"\s+", " "))
    return _checked(F.nullif(value, F.lit("")), value.rlike(TEXT) & (F.length(value) <= most), value)


def integer(raw: Column, least: int, most: int, fallback: int | None = None) -> Checked:
    value = F.when(F.trim(raw).rlike(r"^-?\d+$"), F.trim(raw).try_cast("long"))
    return _checked(raw, value.between(least, most), value, None if fallback is None else F.lit(fallback).cast("long"))


def iso_date(raw: Column) -> Checked:
    """A day of the calendar, written YYYY-MM-DD."""
    value = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("date"))
    return _checked(raw, value.isNotNull(), value)


def boolean(raw: Column, fallback: bool) -> Checked:
    return _checked(raw, raw.isin("true", "false"), raw == "true", F.lit(fallback))


def one_of(raw: Column, *allowed: str, fallback: str | None = None) -> Checked:
    value = F.upper(F.trim(raw))
    return _checked(raw, value.isin(*allowed), value, None if fallback is None else F.lit(fallback))


def code(raw: Column) -> Checked:
    value = F.upper(F.trim(raw))
    return _checked(raw, value.rlike(CODE), value)


def checked(rows: DataFrame, fields: dict[str, Checked], also: dict[str, Column] | None = None) -> DataFrame:
    """rows with each field's value, and errors: the names of fields that are wrong, in their order, then those of also whose test is true."""
    wrong = [F.when(c.bad, F.lit(name)) for name, c in fields.items()] + [F.when(test, F.lit(name)) for name, test in (also or {}).items()]
    return rows.withColumns({name: c.value for name, c in fields.items()} | {"errors": F.array_compact(F.array(*wrong))})


def history_request(rows: DataFrame, most_days: int = 3660) -> DataFrame:
    """A request for a page of the history. rows: search, source, start, end, limit, offset, order and samples, all texts.

    Nothing is clamped: what is out of range is an error, and so are a start after the end and a span of more than most_days.
    """
    c = F.col
    start, end = iso_date(c("start")), iso_date(c("end"))
    fields = {
        "search": text(c("search"), 64), "source": code(c("source")), "start": start, "end": end, "limit": integer(c("limit"), 1, 1000, 100), "offset": integer(c("offset"), 0, 1_000_000, 0),
        "order": one_of(c("order"), "ASC", "DESC", fallback="ASC"), "samples": boolean(c("samples"), True),
    }
    return checked(rows, fields, {"start_after_end": start.value > end.value, "span": F.datediff(end.value, start.value) >= most_days})


def market_name(name: Column) -> Column:
    """Without the number that a source gives a market in brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\s*\(\s*market\s*\d+\s*\)", ""), r"\s+", " "))


def displayable(rows: DataFrame) -> Column:
    """Has a row of prices all that is shown of it? Nothing is made up."""
    name, source = F.coalesce(F.nullif("mandi", F.lit("")), F.nullif("market_code", F.lit(""))), F.nullif("source", F.lit(""))
    shown = (F.col("modal_price") > 0) & (F.col("price_unit") == PRICE_UNIT) & F.col("reported_date").isNotNull() & name.isNotNull() & source.isNotNull() & (F.col("quality_status") != "REJECTED")
    return F.coalesce(shown, F.lit(False))


def label(today: str) -> Column:
    """sample, verified (FRESH_DAYS old at most) or historical."""
    sample = F.coalesce(F.col("is_sample"), F.lit(False)) | F.coalesce(F.col("source").rlike("(?i)MOCK|FIXTURE|SYNTHETIC"), F.lit(False))
    age = F.greatest(F.datediff(F.to_date(F.lit(today)), "reported_date"), F.lit(0))
    return F.when(sample, "sample").when(age <= FRESH_DAYS, "verified").otherwise("historical")


def rupees(amount: Column) -> Column:
    """In the Indian grouping: the last three digits, then pairs; paise only where there are any."""
    whole = F.floor(F.abs(amount) + 1e-9).cast("long").cast("string")
    paise = rounded(F.abs(amount) - F.floor(F.abs(amount) + 1e-9))
    head = F.regexp_replace(F.substring(whole, F.lit(1), F.length(whole) - 3), r"(\d)(?=(?:\d{2})+$)", "$1,")
    grouped = F.when(F.length(whole) > 3, F.concat(head, F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    return F.concat(F.when(amount < 0, "-₹").otherwise("₹"), grouped, F.when(paise > 0, F.substring(F.format_string("%.2f", paise), 2, 3)).otherwise(""))


#: Orders of a table of prices; a missing number counts as 0, and equal rows go by their id.
SORTS = {
    "price-desc": lambda: F.coalesce("modal_price", F.lit(0.0)).desc(),
    "price-asc": lambda: F.coalesce("modal_price", F.lit(0.0)).asc(),
    "arrivals-desc": lambda: F.coalesce("arrival_quantity", F.lit(0.0)).desc(),
    "date-desc": lambda: F.col("reported_date").desc_nulls_last(),
    "name-asc": lambda: F.coalesce(F.nullif("mandi", F.lit("")), "market_code").asc_nulls_first(),
}


def empty_reason(asked: DataFrame, observed: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Why a series (mandi_id, commodity, and a horizon or null) has no forecast to show; null where it has.

    observed: one row of a series with n, its number of reports; forecasts: rows with horizon. NO_MARKET_DATA, INSUFFICIENT_HISTORY (fewer than
    LEAST_OBSERVATIONS), NO_FORECAST, or NO_FORECAST_FOR_FILTER if there are some of other horizons.
    """
    series = ["mandi_id", "commodity"]
    have = forecasts.groupBy(*series).agg(F.collect_set("horizon").alias("horizons"))
    out = asked.join(observed.select(*series, "n"), series, "left").join(have, series, "left")
    n = F.coalesce("n", F.lit(0))
    fits = F.col("horizon").isNull() | F.array_contains("horizons", F.col("horizon"))
    reason = F.when(n == 0, "NO_MARKET_DATA").when(n < LEAST_OBSERVATIONS, "INSUFFICIENT_HISTORY").when(F.col("horizons").isNull(), "NO_FORECAST").when(~fits, "NO_FORECAST_FOR_FILTER")
    return out.select(*asked.columns, reason.alias("reason"))


def alert_list(rules: DataFrame, markets: DataFrame, triggers: DataFrame) -> DataFrame:
    """Each user's alerts, active ones first, then the latest: place in the list, market, state and when it fired last.

    markets: mandi_id, mandi and state; triggers: alert_id and reported_date.
    """
    from pyspark.sql import Window

    fired = triggers.groupBy("alert_id").agg(F.max("reported_date").alias("last_triggered"))
    out = rules.join(markets, "mandi_id", "left").join(fired, "alert_id", "left")
    order = Window.partitionBy("user").orderBy(F.col("is_active").desc(), F.col("last_triggered").desc_nulls_last(), F.col("alert_id").desc())
    return out.withColumn("place", F.row_number().over(order))


def alias_codes(texts: DataFrame) -> DataFrame:
    """text_id and code, the commodity of the first word (or pair of words) of a text that is an alias; a word after "sweet" is none. Null without one."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
    # neighbours come from the same array, shifted, so that no word looks at the whole of it
    shifted = F.concat(F.array(F.lit("")), F.split(plain, " "))
    both = texts.select("text_id", F.posexplode(F.arrays_zip(F.split(plain, " ").alias("word"), shifted.alias("before"))).alias("k", "x")).select("text_id", "k", "x.word", "x.before")
    known = lambda x: rec.lookup(rec.CODE_OF_ALIAS, x)
    alone = F.when(F.col("before") != "sweet", known(F.col("word")))
    pair = F.when(F.col("word").isNotNull(), known(F.concat(F.col("before"), F.lit(" "), F.col("word"))))  # it begins a word earlier
    hits = both.withColumn("code", F.coalesce(pair, alone)).withColumn("at", F.when(pair.isNotNull(), F.col("k") * 2 - 3).otherwise(F.col("k") * 2)).filter("code IS NOT NULL")
    first = hits.groupBy("text_id").agg(F.min_by("code", "at").alias("code"))
    return texts.select("text_id").join(first, "text_id", "left")


def sorted_page(rows: DataFrame, mode: str, limit: int, key: str = "observation_id") -> DataFrame:
    """The first rows of a table in one of SORTS. An unknown mode leaves the order by key."""
    order = [SORTS[mode]()] if mode in SORTS else []
    return rows.orderBy(*order, key).limit(limit)


def unioned(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
