"""Decisions from prices: hold or sell, plans over markets, allocation by net price, movements, comparison and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.numbers import percent_change, rounded
from granary.operators.market import SERIES, first_rows, genuine

# Fixed values of the freight model: rupees a quintal and kilometre, distances.
FREIGHT_BASE, FREIGHT_PER_KM = 80.0, 1.35
SAME_KM, MISSING_KM, DEFAULT_KM = 25.0, 30.0, 140.0
DISTANCES = {
    ("ahmednagar", "pune"): 122.0, ("nashik", "pune"): 212.0, ("ahmednagar", "nashik"): 158.0, ("pune", "solapur"): 250.0, ("kolhapur", "pune"): 235.0, ("aurangabad", "pune"): 230.0,
    ("chhatrapati sambhajinagar", "pune"): 230.0, ("pune", "satara"): 110.0, ("jalgaon", "nashik"): 235.0, ("dhule", "nashik"): 160.0, ("ahmednagar", "solapur"): 225.0,
}
SPLIT = 0.6


def hold_or_sell(latest: DataFrame, forecasts: DataFrame, quantity: float, days: int, storage_per_day: float = 0.0) -> DataFrame:
    """Value now, and after so many days by the forecast for that horizon; 0 days is the spot price with full confidence.

    latest: series, price; forecasts: series, horizon, predicted, lower, upper, confidence. Without a forecast the later values are null.
    """
    now = latest.select(*SERIES, F.col("price").alias("price_now"))
    if days == 0:
        out = now.withColumn("price_then", F.col("price_now")).withColumn("lower", F.col("price_now")).withColumn("upper", F.col("price_now")).withColumn("confidence", F.lit(100.0))
    else:
        out = now.join(forecasts.filter(F.col("horizon") == days).select(*SERIES, F.col("predicted").alias("price_then"), "lower", "upper", "confidence"), [*SERIES], "left")
    value = lambda c: rounded(F.col(c) * quantity)
    out = out.select(*SERIES, "price_now", "price_then", "confidence", value("price_now").alias("value_now"), value("price_then").alias("value_then"), value("lower").alias("value_low"), value("upper").alias("value_high"))
    out = out.withColumn("difference", rounded(F.col("value_then") - F.col("value_now"))).withColumn("difference_percent", percent_change(F.col("price_now"), F.col("price_then")))
    return out.withColumn("after_storage", rounded(F.col("difference") - storage_per_day * days * quantity)).withColumn("status", F.when(F.col("price_then").isNull(), "NO_FORECAST").otherwise("AVAILABLE"))


def plan_totals(rows: DataFrame, key: str = "commodity") -> DataFrame:
    """Totals over the markets of a plan; a later total only if all markets have one."""
    whole = F.bool_and(F.col("value_then").isNotNull())
    total = lambda c: F.sum(F.floor(F.col(c) * 100 + 0.5)) / 100.0
    return rows.groupBy(key).agg(F.count("*").alias("markets"), total("value_now").alias("total_now"), F.when(whole, total("value_then")).alias("total_then"), whole.alias("complete"))


def scenarios(asked: DataFrame, latest: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Each request's plan: over its allocations if it has any, else over the one market that it names.

    asked: ask_id, commodity, mandi_id, quantity, days, and allocations, an array of (mandi_id, quantity, days). latest: series and price;
    forecasts: series, horizon, predicted. A part without a price or a forecast for its days has no value, and a plan with such a part no total.
    Status: NO_MARKET_DATA, NO_FORECAST or AVAILABLE. All requests are answered by one join with each table.
    """
    multi = F.coalesce(F.array_size("allocations") > 0, F.lit(False))
    single = F.array(F.struct(F.col("mandi_id"), F.col("quantity"), F.col("days")))
    parts = asked.select("ask_id", "commodity", F.when(multi, "plan").otherwise("single").alias("mode"), F.explode(F.when(multi, F.col("allocations")).otherwise(single)).alias("a")).select("ask_id", "commodity", "mode", "a.*")
    out = parts.join(latest.select(*SERIES, F.col("price").alias("price_now")), [*SERIES], "left")
    out = out.join(forecasts.select(*SERIES, F.col("horizon").alias("days"), "predicted"), [*SERIES, "days"], "left")
    then = F.when(F.col("price_now").isNotNull(), F.when(F.col("days") == 0, F.col("price_now")).otherwise(F.col("predicted")))
    out = out.withColumn("now", rounded(F.col("price_now") * F.col("quantity"))).withColumn("then", rounded(then * F.col("quantity")))
    total = lambda c: F.when(F.count(c) == F.count("*"), F.sum(F.floor(F.col(c) * 100 + 0.5)) / 100.0)
    by = out.groupBy("ask_id", "mode").agg(F.count("*").alias("markets"), total("now").alias("value_now"), total("then").alias("value_then"))
    status = F.when(F.col("value_now").isNull(), "NO_MARKET_DATA").when(F.col("value_then").isNull(), "NO_FORECAST").otherwise("AVAILABLE")
    return by.select("*", rounded(F.col("value_then") - F.col("value_now")).alias("difference"), percent_change(F.col("value_now"), F.col("value_then")).alias("difference_percent"), status.alias("status"))


def distance_km(a: Column, b: Column) -> Column:
    """By the sorted pair of names in lower case; fixed values for the same, a missing and an unlisted place."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    known = F.create_map(*[F.lit(x) for (p, q), km in DISTANCES.items() for x in (f"{p}__{q}", km)])
    pair = F.array_join(F.array_sort(F.array(a, b)), "__")
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), MISSING_KM).when(a == b, SAME_KM).otherwise(F.coalesce(F.try_element_at(known, pair), F.lit(DEFAULT_KM)))


def freight(km: Column) -> Column:
    return rounded(FREIGHT_BASE + FREIGHT_PER_KM * km)


def allocation(latest: DataFrame, farmer_district: Column, quantity_kg: float) -> DataFrame:
    """For each commodity the market of the best net price (price less freight, 0 at least), a 60/40 split over the best two, and which earns more.

    latest: mandi_id, mandi, district, commodity, price. Ties go to the lower market number.
    """
    quintals = quantity_kg / 100.0
    cost = freight(distance_km(farmer_district, F.col("district")))
    rows = latest.filter(F.col("price") > 0).withColumn("freight", cost).withColumn("net", F.greatest(rounded(F.col("price") - F.col("freight")), F.lit(0.0)))
    w = Window.partitionBy("commodity").orderBy(F.col("net").desc(), "mandi_id")
    two = rows.withColumn("k", F.row_number().over(w)).filter("k <= 2")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    out = two.groupBy("commodity").agg(at("mandi", 1).alias("best"), at("net", 1).alias("best_net"), at("mandi", 2).alias("second"), at("net", 2).alias("second_net"))
    single = rounded(F.col("best_net") * quintals)
    split = F.when(F.col("second_net").isNotNull(), rounded(F.col("best_net") * quintals * SPLIT + F.col("second_net") * quintals * (1 - SPLIT)))
    return out.withColumn("single_value", single).withColumn("split_value", split).withColumn("split_loss", rounded(single - split))



def allocation_plans(latest: DataFrame, farmer_district: Column, quantity_kg: int) -> DataFrame:
    """Both plans of each commodity, a row for each market of a plan: all to the market of the best net price (plan single), or 60 and 40 percent to the best two (plan split).

    latest: mandi_id, mandi, district, commodity, price. A commodity with one market has only plan single. Sums are whole rupees, rounded for each market;
    delta is what a plan brings beyond plan single. Ties go to the lower market number; rows without a positive price are no markets.
    """
    cost = freight(distance_km(farmer_district, F.col("district")))
    rows = latest.filter(F.col("price") > 0).withColumn("cost", cost).withColumn("net_price", F.greatest(rounded(F.col("price") - F.col("cost")), F.lit(0.0)))
    best = Window.partitionBy("commodity").orderBy(F.col("net_price").desc(), "mandi_id")
    two = rows.withColumn("place", F.row_number().over(best)).filter("place <= 2")
    first_kg = int(quantity_kg * SPLIT + 0.5)
    part = lambda plan, share, kg: F.struct(F.lit(plan).alias("plan"), F.lit(share).alias("share_percent"), F.lit(kg).cast("long").alias("kg"))
    share = round(SPLIT * 100)
    of_first = F.array(part("single", 100, quantity_kg), part("split", share, first_kg))
    parts = two.withColumn("p", F.explode(F.when(F.col("place") == 1, of_first).otherwise(F.array(part("split", 100 - share, quantity_kg - first_kg)))))
    parts = parts.select("commodity", "p.plan", "place", "mandi", "p.share_percent", "p.kg", "price", "cost", "net_price")
    whole = lambda c: F.floor(F.col("kg") / 100.0 * F.col(c) + 0.5).cast("long")
    parts = parts.select("*", whole("price").alias("gross"), whole("cost").alias("freight"), whole("net_price").alias("net"))
    plan, crop = Window.partitionBy("commodity", "plan"), Window.partitionBy("commodity")
    parts = parts.withColumn("plan_net", F.sum("net").over(plan)).withColumn("plan_freight", F.sum("freight").over(plan)).withColumn("markets", F.max("place").over(crop))
    single = F.max(F.when(F.col("plan") == "single", F.col("net"))).over(crop)
    return parts.withColumn("delta", F.col("plan_net") - single).filter("plan = 'single' or markets > 1").drop("cost", "markets")


def movements(obs: DataFrame) -> DataFrame:
    """Between the last two reporting days of each (market, commodity, variety): change of price and arrivals in percent."""
    keys = (*SERIES, "variety")
    days = first_rows(obs, (*keys, "reported_date"), F.col("observation_id").desc())
    w = Window.partitionBy(*keys).orderBy(F.col("reported_date").desc())
    two = days.withColumn("k", F.row_number().over(w)).filter("k <= 2")
    at = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    out = two.groupBy(*keys).agg(at("reported_date", 1).alias("day"), at("reported_date", 2).alias("day_before"), *[at(c, k).alias(f"{n}{k}") for c, n in (("modal_price", "p"), ("arrival_quantity", "a")) for k in (1, 2)]).filter("day_before is not null")
    return out.select(*keys, "day", "day_before", percent_change(F.col("p2"), F.col("p1")).alias("price_percent"), percent_change(F.col("a2"), F.col("a1")).alias("arrivals_percent"))


def top_movements(moves: DataFrame, most: int = 5) -> DataFrame:
    """By the larger of the two changes (price if equal), then the newer day."""
    price, arrivals = (F.coalesce(F.abs(c), F.lit(0.0)) for c in ("price_percent", "arrivals_percent"))
    out = moves.withColumn("size", F.greatest(price, arrivals)).withColumn("driver", F.when(price >= arrivals, "price").otherwise("arrivals")).filter("size > 0")
    return out.orderBy(F.desc("size"), F.desc("day"), *SERIES, "variety").limit(most)


def comparison(rows: DataFrame, most: int = 6) -> DataFrame:
    """Of each (commodity, variety, grade, unit, day) with two or more markets: the dearest first; leads if strictly dearer than the next."""
    keys = ("commodity", "variety", "grade", "price_unit", "reported_date")
    one = first_rows(rows, (*keys, "mandi_id"), F.col("modal_price").desc(), F.col("observation_id").desc())
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.col("modal_price").desc(), "mandi_id")
    out = one.withColumn("markets", F.count("*").over(w)).filter("markets >= 2").withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("modal_price").over(order))
    return out.filter(F.col("place") <= most).select(*keys, "mandi_id", "modal_price", "place", ((F.col("place") == 1) & (F.col("modal_price") > F.col("next"))).alias("leads"))


def alert_triggers(obs: DataFrame, rules: DataFrame, today: str, done: DataFrame | None = None) -> DataFrame:
    """Active rules that the newest genuine report of their series fulfils and whose report isn't stale; done: (alert_id, observation_id) that triggered before.

    A report is stale if the end of its day is more than freshness_hours before today's start.
    """
    newest = first_rows(genuine(obs, "usable"), SERIES, F.col("reported_date").desc(), F.col("observation_id").desc()).select(*SERIES, "observation_id", "modal_price", "reported_date", "source")
    out = rules.filter("is_active").join(newest, [*SERIES])
    fresh = F.datediff(F.to_date(F.lit(today)), F.col("reported_date")) * 24 - 24 <= F.col("freshness_hours")
    hit = F.when(F.col("condition") == "gte", F.col("modal_price") >= F.col("target_price")).otherwise(F.col("modal_price") <= F.col("target_price"))
    out = out.filter(fresh & hit)
    if done is not None:
        out = out.join(done.select("alert_id", "observation_id"), ["alert_id", "observation_id"], "left_anti")
    return out.select("alert_id", *SERIES, "observation_id", "modal_price", "target_price", "condition", "reported_date", "source")


def wanted_pairs(favourite_commodities: DataFrame, favourite_markets: DataFrame, rules: DataFrame) -> DataFrame:
    """Each user's favourite commodities by favourite markets, and the pairs of the user's alerts, each once. All three have a column user."""
    grid = favourite_commodities.select("user", "commodity").join(favourite_markets.select("user", "mandi_id"), "user")
    return grid.select("user", *SERIES).unionByName(rules.select("user", *SERIES)).distinct()


def dashboard(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The newest usable report of every wanted pair; nulls where there is none."""
    newest = first_rows(genuine(obs, "usable"), SERIES, F.col("reported_date").desc(), F.col("observation_id").desc())
    return pairs.join(newest.select(*SERIES, "modal_price", "reported_date", "source"), [*SERIES], "left")


def upsert_state(current: DataFrame, new: DataFrame) -> DataFrame:
    """Sync state by source: what is new where it is known, and never an earlier latest date."""
    n = new.select("source", *[F.col(c).alias(f"_{c}") for c in ("last_status", "latest_date")])
    return current.join(n, "source", "full_outer").select("source", F.coalesce("_last_status", "last_status").alias("last_status"), F.greatest("latest_date", "_latest_date").alias("latest_date"))
