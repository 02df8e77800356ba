import os
import shutil
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary.operators import history, ingest, names, report, trace
from granary.plans import provenance as plans

SMALL = "/root/testdata/sf0.001"
KEPT = "id long, day date, price double"


def reports(spark, n=100):
    rows = spark.range(n).select(F.col("id"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("day"), (F.col("id") * 1.5).alias("price"))
    return rows.filter("dayofyear(day) < 21 OR dayofyear(day) > 30")  # the third window has no report


def windows_of(df):
    return sorted(str(r["from"]) for r in df.collect())


def test_a_history_stops_and_goes_on(spark, tmp_path):
    planned, past = ingest.windows("2026-01-01", "2026-02-19", 10, spark), history.History(spark, str(tmp_path), KEPT)
    first = past.run(reports(spark), planned, "day", most_rows=21)
    assert sorted((str(r["from"]), r.records, r.run) for r in first.collect()) == [("2026-01-01", 20, 1), ("2026-01-11", 20, 1)]
    assert windows_of(past.pending(planned)) == ["2026-01-21", "2026-01-31", "2026-02-10"]
    second = past.run(reports(spark), planned, "day")
    assert sorted((str(r["from"]), r.records, r.run) for r in second.collect()) == [("2026-01-21", 0, 2), ("2026-01-31", 20, 2), ("2026-02-10", 20, 2)]
    assert past.pending(planned).count() == 0 and past.run(reports(spark), planned, "day").count() == 0
    assert sorted(r.id for r in past.rows().collect()) == sorted(r.id for r in reports(spark).collect())


def test_a_second_run_makes_no_rows_that_the_first_has_committed(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def price(x: int) -> float:
        made.add(1)
        return float(x)

    rows = reports(spark).withColumn("price", F.udf(price, "double")("id")).select(*reports(spark).columns)
    planned, past = ingest.windows("2026-01-01", "2026-02-19", 10, spark), history.History(spark, str(tmp_path), KEPT)
    half = reports(spark).count() // 2
    first = sum(r.records for r in past.run(rows, planned, "day", half).collect())
    second = sum(r.records for r in past.run(rows, planned, "day").collect())
    assert first > 0 and second > 0 and first + second == reports(spark).count() == past.rows().count()
    assert made.value == first + second


def test_cut_or_changed_windows_are_pending_again(spark, tmp_path):
    planned, past = ingest.windows("2026-01-01", "2026-02-19", 10, spark), history.History(spark, str(tmp_path), KEPT)
    past.run(reports(spark), planned, "day")
    shutil.rmtree(tmp_path / "data/window=2026-01-11")  # rows are gone
    one = spark.createDataFrame([(5, date(2026, 2, 1), 0.0)], KEPT)
    one.write.mode("append").parquet(str(tmp_path / "data/window=2026-01-31"))  # rows were added
    assert windows_of(past.pending(planned)) == ["2026-01-11", "2026-01-31"]
    past.run(reports(spark), planned, "day")
    assert past.pending(planned).count() == 0 and past.rows().count() == reports(spark).count()
    entries = spark.read.schema(history.ENTRY).parquet(str(tmp_path / "manifest/run=1")).collect()
    forged = spark.createDataFrame([(*r[:3], r.records + 1, *r[4:]) for r in entries], history.ENTRY)
    forged.write.mode("overwrite").parquet(str(tmp_path / "manifest/run=1"))  # seals no longer fit; windows of the second run keep theirs
    assert windows_of(past.entries()) == ["2026-01-11", "2026-01-31"]


def test_a_run_that_is_cut_off_leaves_no_entry(spark, tmp_path, monkeypatch):
    planned, past = ingest.windows("2026-01-01", "2026-02-19", 10, spark), history.History(spark, str(tmp_path), KEPT)
    past.run(reports(spark), planned, "day", most_rows=1)
    whole = history.digests
    written = lambda: any("run=2" in str(f) for f in Path(tmp_path).rglob("*.parquet"))
    with monkeypatch.context() as m:
        m.setattr(history, "digests", lambda *a: 1 / 0 if written() else whole(*a))
        with pytest.raises(ZeroDivisionError):
            past.run(reports(spark), planned, "day")  # rows are written, then it ends
    assert (tmp_path / "data/window=2026-02-10").exists() and len(windows_of(past.pending(planned))) == 4
    past.run(reports(spark), planned, "day")
    assert past.pending(planned).count() == 0 and past.rows().count() == reports(spark).count()


def test_fuzzy_lookup(spark):
    rows = spark.createDataFrame(
        [(1, "ON", "Red Onion", "लाल कांदा"), (2, "PO", "Potato", "आलू"), (3, "ONION", "Kanda", None), (4, "SW", "Sweet potato 100%", "रताळे"), (5, None, None, None), (12, "X", "a", "")],
        "id long, code string, name string, hindi string",
    )
    asked = ["onion", " potato ", "RED", "कांदा", "आलू", "12", "a", "o", "100%", "%", "on", "weet pot", "nothing", "", None, "  ", "a_b"]
    out = {r.asked: (r.id, r.how) for r in names.fuzzy_lookup(rows, spark.createDataFrame([(a,) for a in asked], "asked string"), "id", ("code", "name"), ("name",), ("hindi",)).collect()}
    assert out == {
        "onion": (3, "exact"), " potato ": (2, "exact"), "RED": (1, "part"), "कांदा": (1, "script"), "आलू": (2, "script"), "12": (12, "exact"), "a": (12, "exact"), "o": (1, "part"), "100%": (4, "part"),
        "%": (4, "part"), "on": (1, "exact"), "weet pot": (4, "part"),
    }
    by_id = {r.asked: r.id for r in names.fuzzy_lookup(rows, spark.createDataFrame([("onion",)], "asked string"), "id", ("code",), ("name",), exact_first=False).collect()}
    assert by_id == {"onion": 1}  # without that order the least number counts
    assert names.fuzzy_lookup(rows.limit(0), spark.createDataFrame([("a",)], "asked string"), "id", (), ("name",)).count() == 0


def test_a_fuzzy_lookup_makes_no_cross_join(spark):
    rows = spark.range(2000).select("id", F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))
    asked = spark.range(2000).select(F.concat(F.lit("e 1"), F.col("id").cast("string")).alias("asked"))
    out = names.fuzzy_lookup(rows, asked, "id", (), ("name",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    expected = {}
    for k in range(2000):
        hits = [i for i in range(2000) if f"e 1{k}" in f"name {i}"]
        if hits:
            expected[f"e 1{k}"] = hits[0]
    assert {r.asked: r.id for r in out.collect()} == expected


def test_scopes(spark):
    crops = spark.createDataFrame([(1, "Onion"), (2, "Tomato")], "commodity_id long, commodity_name string")
    geo = spark.createDataFrame([(27, "Maharashtra", 516, "Nashik"), (27, "Maharashtra", 521, "Pune"), (24, "Gujarat", 600, "Pune")], "state_id long, state_name string, district_id long, district_name string")
    markets = spark.createDataFrame([(516, 1), (516, 2), (600, 3)], "district_id long, market_id long")
    asks = [(1, "onion ", "MAHARASHTRA", "nashik"), (2, "2", "24", "Pune"), (3, "oni", "27", "516"), (4, "1", "Goa", "516"), (5, "1", "27", "600"), (6, None, "27", "516"), (7, "1", "27", "521"), (8, "1", "27", " ")]
    out = {r.ask_id: (r.status, r.commodity_id, r.state_id, r.district_id, r.markets) for r in names.scopes(spark.createDataFrame(asks, "ask_id long, commodity string, state string, district string"), crops, geo, markets).collect()}
    none = (None,) * 4
    assert out == {1: ("OK", 1, 27, 516, 2), 2: ("OK", 2, 24, 600, 1), 3: ("NO_COMMODITY", *none), 4: ("NO_STATE", *none), 5: ("NO_DISTRICT", *none), 6: ("INCOMPLETE", *none), 7: ("OK", 1, 27, 521, 0), 8: ("INCOMPLETE", *none)}


def test_directory_keeps_the_first_spelling(spark):
    states = spark.createDataFrame([(27, "Maharashtra")], "state_code int, state_name string")
    districts = spark.createDataFrame([(1, 27, "Nashik"), (2, 27, "Empty")], "district_code int, state_code int, district_name string")
    rows = [(3, 1, 27, "NIPHAD"), (1, 1, None, "Niphad"), (2, 1, 27, "Café"), (4, 1, 27, "CAFÉ"), (5, 1, 24, "Wrong"), (6, 9, 27, "Lost"), (7, 1, 27, "x"), (8, 1, 27, "!bad"), (9, 1, 27, None), (10, 1, 27, "  Ab   cd "), (11, 1, 27, "a" * 101)]
    checked = names.checked_places(spark.createDataFrame(rows, "place long, district_code int, state_code int, name string"), districts)
    assert {r.place: r.excluded for r in checked.collect() if r.excluded} == {5: "unmapped_parent", 6: "unmapped_parent", 7: "unsupported_name", 8: "unsupported_name", 9: "unsupported_name", 11: "unsupported_name"}
    listed = names.directory(states, districts, checked).cache()
    assert {r.district_name: (r.place_count, r.names) for r in listed.collect()} == {"Nashik": (3, ["Ab cd", "Café", "Niphad"]), "Empty": (0, [])}
    asks = spark.createDataFrame([(1, 1, "niphad"), (2, 1, "café"), (3, 2, "Niphad"), (4, 1, "Nip"), (5, None, "Niphad")], "ask_id long, district_code int, name string")
    assert {r.ask_id: r.listed for r in names.chosen_places(asks, listed).collect()} == {1: "Niphad", 2: "Café", 3: None, 4: None, 5: None}


def test_trace_names_every_difference(spark):
    raw = plans.raw(spark, SMALL).limit(200).cache()
    stored = plans.normal(spark, SMALL).join(raw.select("seq"), "seq", "left_semi").withColumn("modal_price", F.col("modal_price") + 1).withColumn("state", F.lit(None).cast("string"))
    out = trace.traced(stored, raw, plans.NOW).filter("size(differences) > 0").collect()
    assert out and all({x.field for x in r.differences} <= {"modal_price", "state"} for r in out)
    for r in out:
        for x in r.differences:
            assert x.field != "modal_price" or float(x.stored) == pytest.approx(float(x.replayed) + 1)
            assert x.field != "state" or x.stored is None
    lost = trace.traced(stored, raw.limit(0), plans.NOW)
    assert {r.verdict for r in lost.collect()} == {"SAMPLE_ONLY", "INCOMPLETE"}
    marked = trace.traced(stored, raw.withColumn("fixture", F.lit(True)), plans.NOW, "fixture")
    assert {r.verdict for r in marked.collect()} == {"SYNTHETIC_FIXTURE"}


def test_traced_records_are_packed(spark):
    """Odd characters, nulls beside empty texts, zeros of either sign and numbers of other kinds; what is shuffled for names and verdicts has neither records nor errors in it."""
    raw = plans.raw(spark, SMALL).filter("state is not null").limit(6).withColumns({"variety": F.lit("a\u001fb\u001bN\u001b0"), "grade": F.lit("\u001b1"), "arrivals_quantity": F.lit("0"), "arrival_unit": F.lit("t"), "min_price": F.lit("1e-3")}).cache()
    stored = ingest.normalised(raw)
    same = trace.traced(stored.withColumns({"arrivals_quantity": F.lit("-0.0"), "price_date": F.date_format("price_date", "yyyy-MM-dd")}), raw, plans.NOW)
    assert {len(r.differences) for r in same.collect()} == {0}
    odd = trace.traced(stored.withColumns({"variety": F.lit("a\u001fb"), "grade": F.lit(None).cast("string"), "arrival_unit": F.lit("")}), raw, plans.NOW)
    expected = {("variety", "a\u001fb", "a\u001fb\u001bN\u001b0"), ("grade", None, "\u001b1"), ("arrival_unit", "", "tonne")}
    assert [{tuple(x) for x in r.differences} for r in odd.collect()] == [expected] * 6
    plan = odd.select("seq", "verdict", F.transform("differences", lambda x: x["field"]).alias("fields"))._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert [[x.output().apply(k).dataType().simpleString() for k in range(x.output().size())] for x in (plan.left(), plan.right())] == [["string", "string", "boolean"]] * 2


def test_the_report_reads_the_observations_once(spark):
    out = report.sections(plans.p.observations(spark, SMALL), plans.TODAY)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "Cartesian" not in plan
    empty = plans.whole_report(spark, SMALL).filter("section = 'coverage'").withColumn("value", F.lit(0).cast("long"))
    assert "no records at all" in {r.gap for r in report.gaps(empty).collect()}
    none = report.refresh(plans.p.sync_log(spark, SMALL).limit(0))
    assert {r.gap for r in report.gaps(none).collect()} == {"no run has succeeded"}
    assert report.sections(plans.p.observations(spark, SMALL).limit(0), plans.TODAY).filter("value <> 0").count() == 0


def test_windows_without_rows_are_complete_too(spark, tmp_path):
    past = history.History(spark, str(tmp_path), KEPT)
    planned = ingest.windows("2026-01-01", "2026-01-10", 5, spark)
    out = past.run(reports(spark).limit(0), planned, "day").collect()
    assert [(r.records, r.status) for r in out] == [(0, "complete")] * 2 and past.pending(planned).count() == 0
    assert past.rows().count() == 0 and timedelta(4) == out[0]["to"] - out[0]["from"]


def test_a_fuzzy_lookup_looks_once_at_names_that_repeat(spark):
    """Grams are many times the rows that they are cut from: none is broadcast, and equal names don't multiply what is found."""
    rows = spark.range(3000).select(F.col("id"), F.lit("Brand").alias("code"), F.concat(F.lit("hot bolt "), (F.col("id") % 3).cast("string")).alias("name"))
    asked = spark.createDataFrame([("brand",), ("bolt",), ("t 2",), ("1",), (" olt 1",), ("none",)], "asked string")
    out = names.fuzzy_lookup(rows, asked, "id", ("code",), ("name",))
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.asked: (r.id, r.how) for r in out.collect()} == {"brand": (0, "exact"), "bolt": (0, "part"), "t 2": (2, "part"), "1": (1, "exact"), " olt 1": (1, "part")}


def test_repeats_of_a_day_and_no_row_multiplied(spark):
    rows = [("A", 1, "x", "v"), ("A", 1, "x", "v"), ("A", 1, "x", "v"), ("B", 1, "x", None), ("B", 1, "x", None), (None, 2, "x", "v"), ("A", 2, "x", "v"), (None, 3, "x", "v")]
    named = spark.createDataFrame(rows, "source string, mandi_id long, commodity string, variety string")
    obs = plans.p.observations(spark, SMALL).limit(8).select(*[F.lit(None).cast(t).alias(c) for c, t in plans.p.observations(spark, SMALL).dtypes if c not in (*named.columns, "reported_date")]).limit(1)
    obs = named.crossJoin(obs).withColumn("reported_date", F.to_date(F.lit("2001-01-01")))
    found = {(r.section, r.metric): r.value for r in report.sections(obs, plans.TODAY).filter("key = 'all'").collect()}
    assert [found["duplicates", m] for m in ("identities", "groups", "duplicate_rows")] == [5, 2, 3]
    assert [found["cross_source_overlaps", m] for m in ("market_days", "overlapping", "records")] == [3, 1, 5]
    plan = report.sections(plans.p.observations(spark, SMALL), plans.TODAY)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_lines_are_shuffled_as_they_are_read(spark):
    """Where the parts are too many to be broadcast, there is one shuffle of the lines, of columns of theirs: the suppliers' size is seen by Catalyst."""
    folder, limit = "/root/testdata/sf0.01", "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(os.path.getsize(f"{folder}/supplier.parquet") + 1))
    try:
        assert os.path.getsize(f"{folder}/part.parquet") > 3 * os.path.getsize(f"{folder}/supplier.parquet")  # so that the columns of it that count are too large
        plan = plans.p.observations(spark, folder).select("observation_id", "state", "variety", "modal_price")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    assert plan.count("Exchange hashpartitioning(") == 2 and "Exchange hashpartitioning(l_partkey" in plan
    assert "md5(" not in plan[plan.index("Exchange hashpartitioning(l_partkey") :]
