"""Small cases by hand: what a user said before, plans for a harvest, runs and sources, what a market pays now."""

from datetime import date

from pyspark.sql import functions as F

from granary.operators import decisions, market, quality, talks


def test_only_the_users_last_turns_and_then_the_profile_count(spark):
    turns = [
        (1, 1, "user", "onion price"), (1, 2, "assistant", "potato in Pune"), (1, 3, "user", "thanks"), (1, 4, "user", "hello"), (1, 5, "user", None), (1, 6, "user", "price?"), (1, 7, "user", "price?"),
        (2, 1, "user", "hello"), (2, 2, "user", "price today?"), (2, 3, "user", "tomato price in Nashik"), (3, 1, "user", "price today?"), (4, 1, "assistant", "onion price"),
    ]
    profiles = spark.createDataFrame([(1, None, "Pune"), (2, "POTATO", None), (9, "POTATO", "Pune")], "conv_id long, profile_crop string, profile_place string")
    rows = talks.remembered(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"), profiles).collect()
    got = {(r.conv_id, r.turn): (r.crop, r.place, r.assumed) for r in rows}
    onion, tomato = got[1, 1][0], got[2, 3][0]
    assert onion and tomato and onion != tomato
    assert got[1, 1] == (onion, "Pune", "place_from_profile") and got[1, 6] == (onion, "Pune", "place_from_profile")
    assert got[1, 3][1:] == (None, "")  # thanks asks for no data
    assert got[1, 7] == (None, "Pune", "place_from_profile")  # five turns ago is too long ago
    assert got[2, 1] == (None, None, "") and got[2, 2] == ("POTATO", None, "crop_from_profile") and got[2, 3][2] == "" and got[2, 3][1]
    assert got[3, 1] == (None, None, "") and len(rows) == 10


def test_plans_of_a_harvest(spark):
    latest = [(1, "A", "Far", "onion", 1000.0), (2, "B", "Far", "onion", 1000.0), (3, "C", "Far", "onion", 900.0), (1, "A", "Far", "rice", 100.0), (2, "B", "Far", "rice", 0.0), (1, "A", "Far", "salt", None)]
    df = spark.createDataFrame(latest, "mandi_id long, mandi string, district string, commodity string, price double")
    cost = df.select(decisions.freight(decisions.distance_km(F.lit("Near"), F.col("district")))).first()[0]
    rows = decisions.allocation_plans(df, F.lit("Near"), 1005).collect()
    got = {(r.commodity, r.plan, r.place): r for r in rows}
    assert set(got) == {("onion", "single", 1), ("onion", "split", 1), ("onion", "split", 2), ("rice", "single", 1)}
    whole = lambda x: int(x + 0.5)
    assert [(got[k].mandi, got[k].share_percent, got[k].kg) for k in sorted(got)] == [("A", 100, 1005), ("A", 60, 603), ("B", 40, 402), ("A", 100, 1005)]
    single, first, second = (got["onion", *k] for k in (("single", 1), ("split", 1), ("split", 2)))
    assert (single.gross, single.freight, single.net) == (10050, whole(10.05 * cost), whole(10.05 * (1000 - cost))) and single.plan_net == single.net and single.delta == 0
    assert first.plan_net == first.net + second.net == whole(6.03 * (1000 - cost)) + whole(4.02 * (1000 - cost)) and first.plan_freight == first.freight + second.freight and second.delta == first.plan_net - single.net
    assert got["rice", "single", 1].net == whole(10.05 * max(0, 100 - cost))
    assert decisions.allocation_plans(df.limit(0), F.lit("Near"), 1005).collect() == []


def test_runs_and_sources(spark):
    runs = [(k, "A" if k < 8 else "B", s, date(2026, 1, k), 10) for k, s in enumerate(["SUCCESS", "FAILED", "PARTIAL_SUCCESS", "FAILED", "FAILED", "SUCCESS", "FAILED", "FAILED"], 1)] + [(9, "B", "SUCCESS", None, None)]
    df = spark.createDataFrame(runs, "run_id long, source string, status string, synced_on date, records_fetched long")
    r = quality.refresh_summary(df).first()
    assert (r.batches, r.fetched, r.successful, r.failed, r.last_success, r.last_run, r.last_status, r.last_source, list(r.last_failed)) == (9, 80, 3, 6, date(2026, 1, 6), 8, "FAILED", "B", [8, 7, 5, 4, 3])
    r = quality.refresh_summary(df.limit(0)).first()
    assert (r.batches, r.fetched, r.last_run, list(r.last_failed)) == (0, 0, None, [])
    registry = spark.createDataFrame([("A", 1, False), ("B", 2, False), ("C", 3, True)], "source string, precedence int, is_sample boolean")
    got = {r.source: (r.last_run, r.last_status, r.last_success, r.stale_days, r.due) for r in quality.sources_with_states(registry, df, "2026-01-09").collect()}
    assert got == {"A": (7, "FAILED", date(2026, 1, 6), 3, False), "B": (8, "FAILED", None, None, True), "C": (None, None, None, None, True)}


def test_what_a_market_pays_now(spark):
    obs = spark.createDataFrame(
        [(f"o{k}", 1, "A", c, v, None, date(2026, 1, d), 5.0, s, p) for k, (c, v, d, s, p) in enumerate([("onion", None, 2, "x", 1), ("onion", "red", 2, "x", 1), ("onion", "red", 2, "y", 0), ("onion", "red", 1, "x", 1), ("rice", "b", 1, "y", 0)])],
        "observation_id string, mandi_id long, mandi string, commodity string, variety string, grade string, reported_date date, modal_price double, source string, precedence int",
    )
    (r,) = market.current_prices(obs).collect()
    assert [x.observation_id for x in r.current_prices] == ["o0", "o1", "o4"]


def test_places_are_found_by_the_alias_table_however_small_the_texts_are(spark, monkeypatch):
    """Runs of words are many times the texts: the side that is broadcast is that of the aliases, or none."""
    aliases = spark.createDataFrame([("Nashik", "Nashik", "West"), ("West", "Nashik", "West"), ("WEST", "Pune", "West"), *[(f"place {k}", f"P{k}", "East") for k in range(300)]], "alias string, market string, district string")
    texts = spark.range(12).select(F.col("id").alias("text_id"), F.concat(F.lit("from nashik to place "), (F.col("id") % 4).cast("string"), F.lit(" in the west")).alias("text"))
    for most, broadcast in ((talks.MOST_BROADCAST, True), (10, False)):
        monkeypatch.setattr(talks, "MOST_BROADCAST", most)
        out = talks.named_places(texts, aliases)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == broadcast
        assert {r.text_id: (r.alias, r.market, r.district) for r in out.collect()} == {k: (f"place {k % 4}", f"P{k % 4}", "East") for k in range(12)}
    west = spark.createDataFrame([(1, "go west")], "text_id long, text string")
    assert [tuple(r) for r in talks.named_places(west, aliases).collect()] == [(1, "west", None, "West")]
