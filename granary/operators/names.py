"""Names of commodities and places: fuzzy lookup, scopes, and the directory of locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """The different runs of size characters; none of a shorter text."""
    n = F.length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(index: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked text the least key of the index's texts that contain it (asked, key). index: key and text, each text once; asked: asked and text, not empty.

    A text of up to GRAM characters is a gram itself, whose least key is counted along with it. A longer one is joined on the rarest of its own
    grams, and what that finds is checked. No pair of texts without a gram in common is made. Grams are many times the rows that they are
    cut from, which their estimated size doesn't show, so they are joined by sorting and never broadcast.
    """
    sized = index.select("key", F.col("text").alias("whole"), F.explode(F.array(*[F.lit(k) for k in range(1, GRAM + 1)])).alias("size"))
    every = [F.when(F.col("size") == k, grams(F.col("whole"), k)) for k in range(1, GRAM + 1)]
    known = sized.select("key", "whole", F.explode(F.coalesce(*every)).alias("gram"))
    counted = known.groupBy("gram").agg(F.count("*").alias("n"), F.min("key").alias("least")).hint("merge")
    cut = F.coalesce(*[F.when(F.least(F.length("text"), F.lit(GRAM)) == k, grams(F.col("text"), k)) for k in range(1, GRAM + 1)])
    wanted = asked.filter(F.length("text") > 0).select("asked", "text", F.explode(cut).alias("gram")).join(counted, "gram", "left")
    rarest = wanted.groupBy("asked", "text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "least")).alias("g")).select("asked", "text", "g.*").filter("n > 0")
    short = rarest.filter(F.length("text") <= GRAM).select("asked", F.col("least").alias("key"))
    longer = rarest.filter(F.length("text") > GRAM).select("asked", "text", "gram").join(known.hint("merge"), "gram").filter(F.contains("whole", "text"))
    return short.unionByName(longer.groupBy("asked").agg(F.min("key").alias("key")))


def fuzzy_lookup(rows: DataFrame, asked: DataFrame, key: str, exact: tuple[str, ...] = (), part: tuple[str, ...] = (), script: tuple[str, ...] = (), exact_first: bool = True) -> DataFrame:
    """For each asked text (column asked) the row that it names, with how: exact (the key, or one of exact without case), part (in one of part, without
    case) or script (in one of script, as it is written).

    With exact_first a row that is named exactly goes before others; then the least key counts. Outer spaces don't matter; an empty or null
    text, or one that fits nothing, gives no row. % and _ stand for themselves.
    """
    texts = asked.filter(F.length(F.trim("asked")) > 0).select("asked", F.trim("asked").alias("text")).distinct()
    lower = texts.select("asked", F.lower("text").alias("text"))
    names = lambda columns, change: F.explode(F.array(*[change(F.col(c)) for c in columns]))
    # Of the rows that spell a text alike only the least key can count, so each different text is looked at once.
    entries = lambda columns, change: rows.select(F.col(key).alias("key"), names(columns, change).alias("text")).filter("text is not null").groupBy("text").agg(F.min("key").alias("key"))
    spelt = entries((key, *exact), lambda c: F.lower(c.cast("string")))
    found = spelt.hint("merge").join(lower, "text").select("key", "asked", F.lit(0).alias("rank"))
    if part:
        found = found.unionByName(contained(entries(part, lambda c: F.lower(c)), lower).select("key", "asked", F.lit(1).alias("rank")))
    if script:
        found = found.unionByName(contained(entries(script, lambda c: c), texts).select("key", "asked", F.lit(2).alias("rank")))
    order = F.struct((F.col("rank") > 0).alias("later"), "key", "rank") if exact_first else F.struct("key", "rank")
    best = found.groupBy("asked").agg(F.min(order).alias("b"))
    how = F.element_at(F.array(*map(F.lit, ("exact", "part", "script"))), F.col("b.rank") + 1)
    return best.select("asked", F.col("b.key").alias(key), how.alias("how"))


def scopes(asked: DataFrame, commodities: DataFrame, geographies: DataFrame, markets: DataFrame) -> DataFrame:
    """ask_id, status and the ids of a commodity, state and district with the number of its markets. Each is a number or a name (without case and outer
    spaces), never a part of one; a name is looked for inside the state only.

    commodities: commodity_id, commodity_name; geographies: state_id, state_name, district_id, district_name; markets: district_id, market_id.
    status: INCOMPLETE if one isn't given, else NO_COMMODITY, NO_STATE or NO_DISTRICT for the first that isn't known, else OK.
    """
    plain = lambda c: F.lower(F.trim(F.col(c).cast("string")))

    def named(rows: DataFrame, name: str, *inside: str) -> DataFrame:
        """By number, or else by name: the least number of those."""
        both = F.explode(F.array(F.col(f"{name}_id").cast("string"), plain(f"{name}_name")))
        return rows.select(*inside, f"{name}_id", both.alias(f"_{name}")).groupBy(*inside, f"_{name}").agg(F.min(f"{name}_id").alias(f"{name}_id"))

    out = asked.select("ask_id", *[F.nullif(plain(c), F.lit("")).alias(f"_{c}") for c in ("commodity", "state", "district")])
    whole = F.col("_commodity").isNotNull() & F.col("_state").isNotNull() & F.col("_district").isNotNull()
    out = out.join(named(commodities, "commodity"), "_commodity", "left").join(named(geographies, "state"), "_state", "left")
    out = out.join(named(geographies, "district", "state_id"), ["state_id", "_district"], "left")
    out = out.join(markets.groupBy("district_id").agg(F.count("*").alias("n")), "district_id", "left")
    missing = [F.when(F.col(f"{c}_id").isNull(), F.lit(f"NO_{c.upper()}")) for c in ("commodity", "state", "district")]
    status = F.coalesce(F.when(~whole, "INCOMPLETE"), *missing, F.lit("OK"))
    known = lambda c: F.when(F.col("status") == "OK", F.col(c)).alias(c)
    return out.withColumn("status", status).select("ask_id", "status", *map(known, ("commodity_id", "state_id", "district_id")), F.when(F.col("status") == "OK", F.coalesce("n", F.lit(0))).alias("markets"))


#: Names of places: 2 to 100 characters, first a letter or digit, then these too.
PLACE_NAME = r"^[\p{L}\p{N}][\p{L}\p{M}\p{N} .,'()\-/&@+\[\]\"]{1,99}$"


def same_name(name: Column) -> Column:
    """Equal for names that differ in case or in how accents are composed only."""
    return F.collate(name, "UNICODE_CI")


def cleaned(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def checked_places(places: DataFrame, districts: DataFrame) -> DataFrame:
    """places (district_code, state_code or null, name, place: their order) with why they are left out (excluded), null where they stay."""
    known = districts.select("district_code", F.col("state_code").alias("_state"))
    rows = places.join(known, "district_code", "left").withColumn("name", cleaned(F.col("name")))
    mapped = F.col("_state").isNotNull() & (F.col("state_code").isNull() | (F.col("state_code") == F.col("_state")))
    return rows.withColumn("excluded", F.when(~mapped, "unmapped_parent").when(~F.coalesce(F.col("name").rlike(PLACE_NAME), F.lit(False)), "unsupported_name")).drop("_state")


def directory(states: DataFrame, districts: DataFrame, checked: DataFrame) -> DataFrame:
    """For each district its state and the sorted names of its places; of names that are the same the first (least place) stays."""
    first = checked.filter("excluded is null").groupBy("district_code", same_name(F.col("name")).alias("_same")).agg(F.min(F.struct("place", "name")).alias("f"))
    names = first.groupBy("district_code").agg(F.array_sort(F.collect_list(F.struct(F.lower("f.name").alias("folded"), F.col("f.name").alias("name")))).alias("n"))
    out = districts.join(states, "state_code").join(names, "district_code", "left")
    sorted_names = F.coalesce(F.transform("n", lambda x: x["name"]), F.array().cast("array<string>"))
    return out.select("state_code", "state_name", "district_code", "district_name", F.size(sorted_names).alias("place_count"), sorted_names.alias("names"))


def chosen_places(asked: DataFrame, places: DataFrame) -> DataFrame:
    """Asked names (ask_id, district_code, name) with the listed spelling (listed), null where the district has no such place. places: directory()."""
    options = places.select("district_code", F.explode("names").alias("listed")).withColumn("_same", same_name(F.col("listed")))
    return asked.withColumn("_same", same_name(cleaned(F.col("name")))).join(options, ["district_code", "_same"], "left").select("ask_id", "district_code", "name", "listed")
