"""From raw records to observations: normalise, validate, drop repeats, find conflicts, merge into what is there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import records as r
from granary.functions.numbers import rounded

# Limits and registered sources.
EARLIEST, OUTLIER = "2000-01-01", 1_000_000.0
GENUINE, SAMPLES = ("DATA_GOV_IN", "CEDA"), ("MOCK_PROVIDER",)
IDENTITY = ("source", "mandi_code", "commodity_code", "price_date", "variety", "grade")
DAY = ("mandi_code", "commodity_code", "price_date")


def some(*flags: Column) -> Column:
    return F.array_compact(F.array(*flags))


TEXTS = ("source", "source_record_key", "state", "district", "market", "commodity", "variety", "grade", "price_date", "date_format", "min_price", "max_price", "modal_price", "price_unit", "arrivals_quantity", "arrival_unit")
PRICES = ("min_price", "max_price", "modal_price")


#: The texts that a column of a normalised record is made of, where these aren't the one of its name.
MADE_OF = {
    "mandi_code": ("state", "district", "market"), "commodity_code": ("commodity",), "price_date": ("price_date", "date_format"), **{n: (n, "price_unit") for n in PRICES},
    "arrivals_quantity": ("arrivals_quantity", "arrival_unit"), "arrival_unit": ("arrivals_quantity", "arrival_unit"), "quality_flags": TEXTS,
}


def normalised(raw: DataFrame, wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Raw text fields (TEXTS, with seq and is_sample_data) to typed ones with flags, or the wanted ones of these. Nothing missing is guessed."""
    needed = [n for n in TEXTS if wanted is None or any(n in MADE_OF.get(w, (w,)) for w in wanted)]
    c = {n: F.col(n) for n in TEXTS}
    # One function over all texts, and one over all numbers: written out for each, they make methods that the JVM leaves uncompiled.
    cleaned = F.transform(F.array(*[F.col(n).cast("string") for n in needed]), r.clean)
    out = raw.select("seq", F.coalesce("is_sample_data", F.lit(False)).alias("is_sample_data"), cleaned.alias("_texts"))
    t = {n: F.col("_texts")[needed.index(n)] if n in needed else F.lit(None).cast("string") for n in TEXTS}
    numbers = (*PRICES, "arrivals_quantity")
    values = {"_numbers": F.transform(F.array(*[t[n] for n in numbers]), r.number), "_day": r.calendar_date(t["price_date"], F.coalesce(t["date_format"], F.lit("AUTO"))), "_factor": r.price_factor(t["price_unit"]), "_weight": r.arrival_factor(t["arrival_unit"])}
    # A table of one row, for what comes out of it is computed once: a filter of the records would be pushed below a plain projection, and clean all
    # texts again for each of its columns. The outer form isn't filtered, either.
    out = out.select("seq", "is_sample_data", F.inline_outer(F.array(F.struct(*[x.alias(n) for n, x in (t | values).items()]))))
    out = out.withColumns({f"_{n}": r.place_slug(c[n]) for n in ("state", "district", "market")} | {"_commodity": r.commodity_slug(c["commodity"])})
    out = out.withColumns({f"_{n}": F.col("_numbers")[k] for k, n in enumerate(numbers)})
    located = c["state"].isNotNull() & c["district"].isNotNull() & c["market"].isNotNull()
    out = out.withColumns({"mandi_code": F.when(located, r.code(F.col("_state"), F.col("_district"), F.col("_market"))), "commodity_code": F.when(F.col("_commodity").isNotNull(), r.code(F.col("_commodity")))})
    flag = lambda test, name: F.when(test, F.lit(name))
    flags = [
        flag(F.col("mandi_code").isNull(), "MISSING_LOCATION"), flag(F.col("commodity_code").isNull(), "MISSING_COMMODITY"),
        flag(F.col("_day").isNull() & c["price_date"].isNotNull(), "INVALID_DATE"), flag(c["price_date"].isNull(), "MISSING_DATE"),
        flag(F.col("_factor").isNull() & c["price_unit"].isNotNull(), "UNKNOWN_PRICE_UNIT"), flag(c["price_unit"].isNull(), "MISSING_PRICE_UNIT"),
    ]
    for n in PRICES:
        zero = (F.col(f"_{n}") == 0) if n != "modal_price" else F.lit(False)  # a zero range means that none was reported
        flags += [flag(F.col(f"_{n}").isNull() & c[n].isNotNull(), f"UNPARSEABLE_{n.upper()}"), flag(zero, f"ZERO_{n.upper()}_TREATED_AS_MISSING"), flag(c[n].isNull() | F.coalesce(zero, F.lit(False)), f"MISSING_{n.upper()}")]
    amount = F.col("_arrivals_quantity")
    flags += [flag(amount.isNull() & c["arrivals_quantity"].isNotNull(), "UNPARSEABLE_ARRIVALS"), flag(amount.isNotNull() & F.col("_weight").isNull(), "UNKNOWN_ARRIVAL_UNIT")]
    price = lambda n: rounded((F.col(f"_{n}") if n == "modal_price" else F.nullif(F.col(f"_{n}"), F.lit(0.0))) * F.col("_factor"))
    out = out.select(
        "seq", "is_sample_data", "source", "source_record_key", "variety", "grade", "state", "district", "market", "mandi_code", "commodity_code", F.col("_day").alias("price_date"), *[price(n).alias(n) for n in PRICES],
        F.when(F.col("_factor").isNotNull(), F.lit("INR/quintal")).alias("price_unit"), rounded(amount * F.col("_weight")).alias("arrivals_quantity"), F.when(amount.isNotNull() & F.col("_weight").isNotNull(), F.lit("tonne")).alias("arrival_unit"), some(*flags).alias("quality_flags"),
    )
    return out if wanted is None else out.select(*wanted)


def rejections(now: str) -> Column:
    """The codes of what makes a normalised record unusable."""
    source, modal, low, high, day = (F.col(c) for c in ("source", "modal_price", "min_price", "max_price", "price_date"))
    bad = lambda x: F.coalesce(x <= 0, F.lit(False))
    rules = (
        ("MISSING_SOURCE", source.isNull()), ("UNKNOWN_SOURCE", ~source.isin(*GENUINE, *SAMPLES)), ("SAMPLE_FLAG_ON_GENUINE_SOURCE", source.isin(*GENUINE) & F.col("is_sample_data")), ("SAMPLE_SOURCE_NOT_FLAGGED", source.isin(*SAMPLES) & ~F.col("is_sample_data")),
        ("MISSING_STATE", F.col("state").isNull()), ("MISSING_DISTRICT", F.col("district").isNull()), ("MISSING_MARKET", F.col("market").isNull()), ("MISSING_COMMODITY", F.col("commodity_code").isNull()),
        ("INVALID_DATE", day.isNull() & F.array_contains("quality_flags", "INVALID_DATE")), ("MISSING_DATE", day.isNull() & ~F.array_contains("quality_flags", "INVALID_DATE")),
        ("FUTURE_DATE", day > F.date_add(F.to_date(F.lit(now)), 1)), ("DATE_TOO_OLD", day < F.to_date(F.lit(EARLIEST))), ("UNKNOWN_PRICE_UNIT", F.col("price_unit").isNull()),
        ("NON_POSITIVE_PRICE", bad(modal) | bad(low) | bad(high)), ("MISSING_MODAL_PRICE", modal.isNull()), ("MIN_ABOVE_MAX", low > high), ("MODAL_OUTSIDE_RANGE", F.coalesce(modal < low, F.lit(False)) | F.coalesce(modal > high, F.lit(False))),
        ("NEGATIVE_ARRIVALS", F.col("arrivals_quantity") < 0), ("UNKNOWN_ARRIVAL_UNIT", F.col("arrivals_quantity").isNotNull() & F.col("arrival_unit").isNull()),
    )
    return some(*[F.when(test, F.lit(name)) for name, test in rules])


def validated(records: DataFrame, now: str) -> DataFrame:
    """With errors (rejection codes), warnings and quality_status."""
    out = records.withColumn("errors", rejections(now)).withColumn("warnings", some(F.when(F.col("modal_price") > OUTLIER, F.lit("PRICE_OUTLIER"))))
    status = F.when(F.size("errors") > 0, "REJECTED").when((F.size("quality_flags") > 0) | (F.size("warnings") > 0), "FLAGGED").otherwise("VALID")
    return out.withColumn("quality_status", status)


def rejection_summary(checked: DataFrame) -> DataFrame:
    # The outer form: the plain one would make a filter that computes all errors a second time.
    return checked.select(F.explode_outer("errors").alias("code")).groupBy("code").agg(F.count("*").alias("records")).filter("code is not null")


def fingerprints(*columns: Column) -> list[Column]:
    """128 bits of some values, as two columns; nulls differ from all else. Equal values have equal ones, and others don't, but for a chance of 3e-39 a pair."""
    told = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(k), *told) for k in (0, 1)]


def deduplicated(records: DataFrame) -> DataFrame:
    """The last record (by seq) of each identity, how many there were, and how many earlier ones had other values."""
    # Fingerprints of identity and values are a fraction of their width, and a caller that wants few columns has only these shuffled. They are
    # columns, and stay so: windows over expressions have a shuffle of all records each.
    key = dict(zip(("_key_a", "_key_b"), fingerprints(*[F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for c in IDENTITY])))
    values = fingerprints(*[F.col(c) for c in ("modal_price", "min_price", "max_price", "arrivals_quantity", "price_unit", "arrival_unit") if c in records.columns])
    out = records.withColumns(key | {"_values": F.struct(*[v.alias(n) for n, v in zip("ab", values)])})
    whole = Window.partitionBy(*key)
    last = whole.orderBy(F.col("seq").desc())
    out = out.withColumns({"_last": F.row_number().over(last), "_kept": F.first("_values").over(last)})
    out = out.withColumns({"copies": F.count("*").over(whole), "conflicts": F.count_if(F.col("_values") != F.col("_kept")).over(whole)})
    return out.filter("_last = 1").drop("_last", "_kept", "_values", *key)


def _source_pairs(days: DataFrame, told) -> DataFrame:
    """For each market-day and pair of the sources in its sides (an array of structs, one for each source) the verdict v and the number of pairs, as told says."""
    a, b = F.col("a"), F.col("b")
    pairs = days.select(*DAY, "sides", F.explode("sides").alias("a")).select(*DAY, "a", F.explode("sides").alias("b")).filter(a["source"] < b["source"])
    v, n = told(a, b)
    return pairs.select(*DAY, a["source"].alias("source_a"), b["source"].alias("source_b"), v.alias("v"), n.cast("long").alias("pairs"))


def overlaps(records: DataFrame) -> DataFrame:
    """For each market-day and pair of sources: CONFLICT if comparable rows differ in price, MATCH if comparable rows only agree, else GRANULARITY_MISMATCH.

    Rows compare if variety and grade are equal (nulls too), or if one side has no variety and each source has one row.
    """
    each = records.dropna(subset=[*DAY, "source"]).groupBy(*DAY, "variety", "grade", "source").agg(F.count("*").alias("rows"), F.min("modal_price").alias("low"), F.max("modal_price").alias("high"))
    # Of rows that compare, the difference is greatest between the least price of a source and the greatest of another: no pair of rows is made.
    differ = lambda a, b: r.prices_differ(a["low"], b["high"]) | r.prices_differ(a["high"], b["low"])
    verdict = lambda a, b: F.when(F.coalesce(differ(a, b), F.lit(False)), 2).otherwise(1)
    side = F.struct("source", "rows", "low", "high")
    same = _source_pairs(each.groupBy(*DAY, "variety", "grade").agg(F.collect_list(side).alias("sides")), lambda a, b: (verdict(a, b), F.lit(0)))
    whole = each.groupBy(*DAY, "source").agg(F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or(F.col("variety").isNull()).alias("open"))
    loose = lambda a, b: (a["open"] | b["open"]) & (a["rows"] == 1) & (b["rows"] == 1)
    every = _source_pairs(whole.groupBy(*DAY).agg(F.collect_list(F.struct("source", "rows", "low", "high", "open")).alias("sides")), lambda a, b: (F.when(loose(a, b), verdict(a, b)).otherwise(0), a["rows"] * b["rows"]))
    out = every.unionByName(same).groupBy(*DAY, "source_a", "source_b").agg(F.max("v").alias("v"), F.sum("pairs").alias("pairs"))
    return out.select(*DAY, "source_a", "source_b", "pairs", F.when(F.col("v") == 2, "CROSS_SOURCE_CONFLICT").when(F.col("v") == 1, "CROSS_SOURCE_MATCH").otherwise("GRANULARITY_MISMATCH").alias("class"))


VALUES = ("modal_price", "min_price", "max_price", "arrivals_quantity")


def merge_plan(current: DataFrame, new: DataFrame) -> DataFrame:
    """What an upsert of new records (one for each identity) does to current ones: inserted, updated (with the old price) or unchanged."""
    old = current.select(*[F.col(c).alias(f"_{c}") for c in (*IDENTITY, *VALUES)], F.lit(True).alias("_there"))
    same_key = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in VALUES])
    action = F.when(F.col("_there").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return new.join(old, same_key, "left").withColumn("action", action).withColumnRenamed("_modal_price", "previous_modal_price").drop("_there", *[f"_{c}" for c in (*IDENTITY, "min_price", "max_price", "arrivals_quantity")])


def merged(current: DataFrame, new: DataFrame) -> DataFrame:
    """current with new records inserted or in place of their older versions."""
    fresh = new.select(*current.columns)
    keys = new.select(*[F.col(c).alias(f"_{c}") for c in IDENTITY])
    untouched = current.join(keys, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY]), "left_anti")
    return untouched.unionByName(fresh)


def revisions(current: DataFrame, new: DataFrame) -> DataFrame:
    """A row for each changed record, with old and new values as JSON."""
    plan = merge_plan(current, new).filter("action = 'updated'")
    return plan.select(*IDENTITY, F.to_json(F.struct(F.col("previous_modal_price").alias("modal_price"))).alias("previous_values"), F.to_json(F.struct(*VALUES)).alias("new_values"))


def new_only(log: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Found rows whose key isn't logged yet; each once."""
    return found.dropDuplicates([*keys]).join(log.select(*keys), [*keys], "left_anti")


def windows(start: str, end: str, days: int, spark) -> DataFrame:
    """The range cut into windows of at most so many days, both ends inclusive."""
    one = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr(f"INTERVAL {int(days)} DAYS"))).alias("from"))
    return one.withColumn("to", F.least(F.date_add("from", days - 1), F.to_date(F.lit(end))))


def pending(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planned windows without a complete entry in the manifest."""
    return planned.join(manifest.filter("status = 'complete'").select("from", "to"), ["from", "to"], "left_anti")
