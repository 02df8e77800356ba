"""Conversations: what each turn asks about, with what earlier turns of its conversation said."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import texts as t


def understood(turns: DataFrame) -> DataFrame:
    """conv_id, turn, the crop and place named here or last before in the conversation, horizon and intent. turns: conv_id, turn, text.

    A null text says nothing.
    """
    own = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("crop_here", t.crop(F.col("text"))).withColumn("place_here", t.place(F.col("text")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumn("crop", F.last("crop_here", ignorenulls=True).over(before)).withColumn("place", F.last("place_here", ignorenulls=True).over(before))
    context = F.col("crop").isNotNull() | F.col("place").isNotNull()
    return out.select("conv_id", "turn", "crop", "place", t.horizon(F.col("text")).alias("horizon"), t.intent(F.col("text"), F.col("crop_here"), F.col("place_here"), context).alias("intent"))


#: Intents that are answered out of data, for which a profile fills in what wasn't said, and how many earlier turns count.
DATA_INTENTS = ("LATEST_PRICE", "PRICE_HISTORY", "FORECAST", "FORECAST_UNCERTAINTY", "SELL_TIMING", "RISK_EXPLANATION")
REMEMBERED = 4


def remembered(turns: DataFrame, profiles: DataFrame, most: int = REMEMBERED) -> DataFrame:
    """The user's turns as understood, where crop and place come from the turn, else the newest of the user's last turns that names one, else the profile, if data is asked for.

    turns: conv_id, turn, role, text; profiles: conv_id (one row each), profile_crop, profile_place. assumed says what came from the profile. What the assistant said never counts.
    """
    own = turns.filter("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("crop_here", t.crop(F.col("text"))).withColumn("place_here", t.place(F.col("text")))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-most, 0)
    own = own.withColumn("said_crop", F.last("crop_here", ignorenulls=True).over(before)).withColumn("said_place", F.last("place_here", ignorenulls=True).over(before))
    context = F.col("said_crop").isNotNull() | F.col("said_place").isNotNull()
    own = own.withColumn("intent", t.intent(F.col("text"), F.col("crop_here"), F.col("place_here"), context)).join(profiles, "conv_id", "left")
    asks = F.col("intent").isin(*DATA_INTENTS)
    named = {n: F.coalesce(f"said_{n}", F.when(asks, F.col(f"profile_{n}"))) for n in ("crop", "place")}
    taken = [F.when(asks & F.col(f"said_{n}").isNull() & F.col(f"profile_{n}").isNotNull(), F.lit(f"{n}_from_profile")) for n in named]
    return own.select("conv_id", "turn", "intent", *[x.alias(n) for n, x in named.items()], F.concat_ws(",", *taken).alias("assumed"))


#: An alias table of more rows isn't sent to every task.
MOST_BROADCAST = 100_000


def named_places(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each text the longest alias that it mentions as a whole; market if it belongs to one, else its district. aliases: alias, market, district.

    Texts are cut into runs of one to four words and joined on equality, so the alias table may have any size: it is brought to a row for each
    alias and broadcast, or joined by sorting where it has more than MOST_BROADCAST. The runs, which are many times the texts, are never broadcast.
    """
    known = aliases.groupBy(F.lower("alias").alias("alias")).agg(F.count_distinct("market").alias("markets"), F.min("market").alias("market"), F.min("district").alias("district"))
    small = known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+", " "), " "), lambda w: w != "")
    w = F.col("words")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))))
    said = texts.select("text_id", words.alias("words")).filter(F.size("words") > 0).select("text_id", F.explode(F.array_distinct(runs)).alias("alias"))
    hits = said.join(F.broadcast(known) if small else known.hint("merge"), "alias")
    best = hits.groupBy("text_id").agg(F.max(F.struct(F.length("alias").alias("size"), "alias", "markets", "market", "district")).alias("b"))
    return best.select("text_id", "b.alias", F.when(F.col("b.markets") == 1, F.col("b.market")).alias("market"), "b.district")
