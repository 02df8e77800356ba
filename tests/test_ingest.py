import hashlib
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from granary.functions import records as r
from granary.operators import ingest as i

RAW = "seq long, source string, is_sample_data boolean, source_record_key string, state string, district string, market string, commodity string, variety string, grade string, price_date string, date_format string, min_price string, max_price string, modal_price string, price_unit string, arrivals_quantity string, arrival_unit string"
ROW = {"seq": 1, "source": "DATA_GOV_IN", "is_sample_data": False, "source_record_key": "k", "state": "Maharashtra", "district": "Pune", "market": "Pune", "commodity": "Onion", "variety": "Red", "grade": "FAQ", "price_date": "15/02/2026", "date_format": "DMY", "min_price": "1200", "max_price": "1800", "modal_price": "1500", "price_unit": "INR/quintal", "arrivals_quantity": None, "arrival_unit": None}


def one(spark, **changes):
    raw = spark.createDataFrame([tuple((ROW | changes).values())], RAW)
    return i.validated(i.normalised(raw), "2026-10-10").first()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_a_clean_record(spark):
    x = one(spark)
    assert (x.mandi_code, x.commodity_code, x.price_date, x.modal_price, x.errors, x.quality_status) == ("MAHARASHTRA__PUNE__PUNE", "ONION", date(2026, 2, 15), 1500.0, [], "VALID")


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({"commodity": "Sweet Potato"}, {"commodity_code": "SWEET_POTATO"}),
        ({"market": "Pune(Moshi)"}, {"mandi_code": "MAHARASHTRA__PUNE__PUNE_MOSHI"}),
        ({"state": " - "}, {"mandi_code": None, "errors": ["MISSING_STATE"]}),
        ({"price_date": "31/02/2026"}, {"price_date": None, "errors": ["INVALID_DATE"]}),
        ({"price_date": "2026-02-15"}, {"price_date": None}),
        ({"price_date": "2026-2-5T10:00", "date_format": "AUTO"}, {"price_date": date(2026, 2, 5)}),
        ({"price_date": "03/04/2026"}, {"price_date": date(2026, 4, 3)}),
        ({"price_date": ""}, {"errors": ["MISSING_DATE"]}),
        ({"price_date": "15/02/2027"}, {"errors": ["FUTURE_DATE"]}),
        ({"price_date": "15/02/1999"}, {"errors": ["DATE_TOO_OLD"]}),
        ({"modal_price": ""}, {"modal_price": None, "errors": ["MISSING_MODAL_PRICE"]}),
        ({"modal_price": "0"}, {"errors": ["NON_POSITIVE_PRICE", "MODAL_OUTSIDE_RANGE"]}),
        ({"min_price": "0"}, {"min_price": None, "errors": [], "quality_flags": ["ZERO_MIN_PRICE_TREATED_AS_MISSING", "MISSING_MIN_PRICE"]}),
        ({"max_price": "x1"}, {"max_price": None, "quality_flags": ["UNPARSEABLE_MAX_PRICE"]}),
        ({"modal_price": "1,500.5"}, {"modal_price": 1500.5}),
        ({"price_unit": "Rs / kg", "min_price": "12", "max_price": "18", "modal_price": "15"}, {"modal_price": 1500.0}),
        ({"price_unit": "₹/tonne", "min_price": "12000", "max_price": "18000", "modal_price": "15000"}, {"modal_price": 1500.0}),
        ({"price_unit": "INR/bag"}, {"modal_price": None, "errors": ["UNKNOWN_PRICE_UNIT", "MISSING_MODAL_PRICE"]}),
        ({"min_price": None, "max_price": None, "modal_price": "2000000"}, {"errors": [], "warnings": ["PRICE_OUTLIER"], "quality_status": "FLAGGED"}),
        ({"source": "X"}, {"errors": ["UNKNOWN_SOURCE"]}),
        ({"is_sample_data": True}, {"errors": ["SAMPLE_FLAG_ON_GENUINE_SOURCE"]}),
        ({"source": "MOCK_PROVIDER"}, {"errors": ["SAMPLE_SOURCE_NOT_FLAGGED"]}),
        ({"arrivals_quantity": "25", "arrival_unit": "Quintals"}, {"arrivals_quantity": 2.5, "arrival_unit": "tonne"}),
        ({"arrivals_quantity": "25", "arrival_unit": "sacks"}, {"arrivals_quantity": None, "quality_flags": ["UNKNOWN_ARRIVAL_UNIT"]}),
        ({"arrivals_quantity": "-1", "arrival_unit": "t"}, {"errors": ["NEGATIVE_ARRIVALS"]}),
        ({"min_price": "1900"}, {"errors": ["MIN_ABOVE_MAX", "MODAL_OUTSIDE_RANGE"]}),
    ],
)
def test_faults(spark, changes, expected):
    x = one(spark, **changes).asDict()
    assert {k: x[k] for k in expected} == expected


def test_names_in_other_scripts(spark):
    assert one(spark, commodity="कांदा").commodity_code == "ONION"
    other = one(spark, commodity="मिरची").commodity_code
    assert other.startswith("U") and len(other) == 11 and one(spark, commodity=" मिरची ").commodity_code == other
    assert len(one(spark, commodity="long name " * 12).commodity_code) == 64
    assert r.name_key("ﬁve①") == "five1" and r.name_key(" - ") is None and r.latin("कांदा") is None
    assert one(spark, commodity="Ｏｎｉｏｎ").commodity_code == "ONION" and one(spark, market="Ｐｕｎｅ（Ｍｏｓｈｉ）").mandi_code == "MAHARASHTRA__PUNE__PUNE_MOSHI"
    assert one(spark, commodity="!!").commodity_code is None and one(spark, commodity=None).commodity_code is None
    assert one(spark, market="!!").mandi_code == "MAHARASHTRA__PUNE__U" + hashlib.sha1(b"").hexdigest()[:10].upper()


def test_a_filter_of_records_cleans_no_text_again(spark):
    """Texts and numbers are cleaned by one function each, in one place of the plan, whatever is asked of what comes out."""
    raw = spark.createDataFrame([tuple((ROW | {"seq": k} | changes).values()) for k, changes in enumerate(({}, {"modal_price": "NR"}, {"price_date": "x"}, {"state": "-"}, {"source": None}))], RAW)
    out = i.normalised(raw).filter("modal_price is not null").dropna(subset=["mandi_code", "price_date", "source"])
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("transform(") == 2
    assert [x.seq for x in out.collect()] == [0]


def test_wanted_columns_of_records_clean_no_other_text(spark):
    raw = spark.createDataFrame([tuple((ROW | {"seq": k} | changes).values()) for k, changes in enumerate(({}, {"min_price": "5", "arrivals_quantity": "3", "arrival_unit": "qtl"}, {"state": " Na "}, {"price_unit": None}))], RAW)
    whole = i.normalised(raw)
    for wanted in (("seq", *i.IDENTITY, *i.VALUES), (*i.DAY, "modal_price"), ("arrival_unit", "seq"), ("quality_flags", "is_sample_data"), tuple(whole.columns)):
        assert sorted(map(repr, i.normalised(raw, wanted).collect())) == sorted(map(repr, whole.select(*wanted).collect()))
    plan = i.normalised(raw, (*i.DAY, "modal_price"))._jdf.queryExecution().optimizedPlan().toString()
    assert "modal_price" in plan and "arrivals_quantity" not in plan.split("LogicalRDD")[0].split("LocalRelation")[0].split("transform(")[-1]


@pytest.mark.parametrize("text, expected", [(" a\tb  c ", "a b c"), ("  ", None), ("", None), ("\n-\r", None), ("NULL", None), (" n/A ", None), ("na na", "na na"), ("none\u2028", None), ("null \u2028", None), ("nullify", "nullify"), ("\u2028", None), (None, None)])
def test_clean_text(spark, text, expected):
    assert value(spark, r.clean(F.lit(text).cast("string"))) == expected
    old = F.when(~F.lit(text).rlike(r._MISSING), F.trim(F.regexp_replace(F.lit(text), r"\s+", " ")))
    assert value(spark, old) == expected


@pytest.mark.parametrize("text, expected", [("2026-2-5", date(2026, 2, 5)), ("2026-02-05T10:00", date(2026, 2, 5)), ("5/2/2026", date(2026, 2, 5)), ("31-02-2026", None), ("29/02/2024", date(2024, 2, 29)), ("2026-13-01", None), ("2026-00-10", None), ("0001-01-01", date(1, 1, 1))])
def test_days_are_real(spark, text, expected):
    found = F.lit(text)
    assert value(spark, r.calendar_date(found, F.lit("AUTO"))) == expected
    assert value(spark, F.try_to_date(F.regexp_replace(F.regexp_replace(found, r.ISO, "$1-$2-$3"), r.DMY, "$3-$2-$1"), "yyyy-M-d")) == expected  # as by a pattern


def records(spark, *rows):
    base = {"seq": 1, "source": "DATA_GOV_IN", "mandi_code": "M", "commodity_code": "ONION", "price_date": date(2026, 9, 1), "variety": "Red", "grade": "FAQ", "modal_price": 1400.0, "min_price": None, "max_price": None, "arrivals_quantity": None}
    schema = "seq long, source string, mandi_code string, commodity_code string, price_date date, variety string, grade string, modal_price double, min_price double, max_price double, arrivals_quantity double"
    return spark.createDataFrame([tuple((base | {"seq": k} | x).values()) for k, x in enumerate(rows)], schema)


def test_repeats_within_a_source(spark):
    twice = i.deduplicated(records(spark, {}, {})).collect()
    assert [(x.seq, x.copies, x.conflicts) for x in twice] == [(1, 2, 0)]
    changed = i.deduplicated(records(spark, {}, {"modal_price": 1550.0})).collect()
    assert [(x.seq, x.modal_price, x.conflicts) for x in changed] == [(1, 1550.0, 1)]
    assert i.deduplicated(records(spark, {}, {"variety": "White"}, {"grade": None})).count() == 3


def test_repeats_take_one_shuffle(spark):
    found = i.deduplicated(records(spark, {}, {"modal_price": 1550.0}, {"source": "data_gov_in", "modal_price": 1550.0, "variety": "RED"}, {"source": None}, {"source": ""}))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((x.seq, x.source, x.copies, x.conflicts) for x in found.collect()) == [(2, "data_gov_in", 3, 1), (4, "", 2, 0)]


def test_repeats_are_known_by_fingerprints(spark):
    """Neither the identity nor the values are shuffled for a caller that doesn't want them; a null in one value isn't a null in another."""
    found = i.deduplicated(records(spark, {}, {"min_price": 5.0}, {"max_price": 5.0}, {"max_price": 5.0, "modal_price": 0.0}, {"max_price": 5.0, "modal_price": -0.0}, {"source": None, "variety": "DATA_GOV_IN"})).select("seq", "copies", "conflicts")
    plan, shuffled = found._jdf.queryExecution().optimizedPlan(), None
    while plan.children().nonEmpty():
        plan, above = plan.children().head(), plan.nodeName()
        shuffled = plan.output().size() if above == "Window" else shuffled  # below the last window
    assert shuffled == 4  # seq, and fingerprints of identity (two columns) and values
    assert sorted((x.seq, x.copies, x.conflicts) for x in found.collect()) == [(4, 5, 3), (5, 1, 0)]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([{}, {"source": "CEDA", "variety": None, "grade": None}], "CROSS_SOURCE_MATCH"),
        ([{}, {"source": "CEDA", "variety": None, "grade": None, "modal_price": 1650.0}], "CROSS_SOURCE_CONFLICT"),
        ([{}, {"variety": "White"}, {"source": "CEDA", "variety": None, "grade": None}], "GRANULARITY_MISMATCH"),
        ([{}, {"variety": "White"}, {"source": "CEDA", "modal_price": 1500.0}], "CROSS_SOURCE_CONFLICT"),
    ],
)
def test_overlaps(spark, rows, expected):
    assert [x["class"] for x in i.overlaps(records(spark, *rows)).collect()] == [expected]


def test_merge(spark):
    current = records(spark, {}, {"variety": "White"}, {"variety": None})
    new = records(spark, {"modal_price": 1500.0}, {"variety": None}, {"variety": "New"})
    plan = {x.variety: (x.action, x.previous_modal_price) for x in i.merge_plan(current, new).collect()}
    assert plan == {"Red": ("updated", 1400.0), None: ("unchanged", 1400.0), "New": ("inserted", None)}
    state = i.merged(current, new)
    assert {(x.variety, x.modal_price) for x in state.collect()} == {("Red", 1500.0), ("White", 1400.0), (None, 1400.0), ("New", 1400.0)} and state.count() == 4
    assert i.merge_plan(state, new).filter("action != 'unchanged'").isEmpty()
    assert i.revisions(current, new).count() == 1
    assert i.new_only(current, new, "variety").count() == 2  # null equals nothing here


HASHED = {"source": "DATA_GOV_IN", "source_record_key": "KEY-1", "mandi_code": "M", "commodity_code": "ONION", "price_date": date(2026, 2, 15), "price_unit": "INR/quintal", "modal_price": 1500.0, "min_price": 1200.0, "max_price": 1800.0, "arrivals_quantity": 12.5, "arrival_unit": "tonne", "variety": "Red", "grade": "FAQ"}


def test_content_hash(spark):
    kinds = "source string, source_record_key string, mandi_code string, commodity_code string, price_date date, price_unit string, modal_price double, min_price double, max_price double, arrivals_quantity double, arrival_unit string, variety string, grade string"
    versions = [HASHED] + [HASHED | {k: None} for k in HASHED] + [HASHED | {"variety": ""}, HASHED | {"min_price": 0.0}]
    hashes = [x.h for x in spark.createDataFrame([tuple(v.values()) for v in versions], kinds).select(r.content_hash().alias("h")).collect()]
    assert len(set(hashes)) == len(versions)
    import hashlib

    text = "\x1f".join(["SDATA_GOV_IN", "SKEY-1", "SM", "SONION", "S2026-02-15", "SINR/quintal", "#1500", "#1200", "#1800", "#12.5", "Stonne", "SRed", "SFAQ"])
    assert hashes[0] == hashlib.sha256(text.encode()).hexdigest()


def test_windows(spark):
    w = i.windows("2026-01-01", "2026-01-20", 7, spark)
    assert [(str(x["from"]), str(x["to"])) for x in w.orderBy("from").collect()] == [("2026-01-01", "2026-01-07"), ("2026-01-08", "2026-01-14"), ("2026-01-15", "2026-01-20")]
    done = w.limit(1).withColumn("status", F.lit("complete")).unionByName(w.filter("day(`from`) = 8").withColumn("status", F.lit("failed")))
    assert i.pending(w, done).count() == 2


def test_overlaps_of_many_rows_make_no_pairs(spark):
    """Each verdict and count as over all pairs, without a join of rows with rows."""
    rng = random.Random(3)
    rows = [{"source": rng.choice(["CEDA", "DATA_GOV_IN", "OTHER", None]), "mandi_code": f"M{k % 7}" if k % 40 else None, "variety": rng.choice(["Red", None]), "grade": rng.choice(["FAQ", "B", None]), "modal_price": rng.choice([1400.0, 1405.0, 1410.0, -2.0, 0.4, None])} for k in range(60)]
    rows += [{"source": s, "mandi_code": f"N{k}", "variety": v, "modal_price": p} for k, (v, p) in enumerate([(None, 1400.0), (None, 1500.0), ("Red", None)]) for s, v, p in (("A", "Red", 1400.0), ("B", v, p))]
    found = i.overlaps(records(spark, *rows))
    expected, base = {}, {"variety": "Red", "grade": "FAQ"}
    rows = [base | x for x in rows]
    n = lambda x: sum(y["mandi_code"] == x["mandi_code"] and y["source"] == x["source"] for y in rows)
    for x in rows:
        for y in rows:
            if x["mandi_code"] and x["mandi_code"] == y["mandi_code"] and x["source"] and y["source"] and x["source"] < y["source"]:
                same = (x["variety"], x["grade"]) == (y["variety"], y["grade"]) or (None in (x["variety"], y["variety"]) and n(x) == n(y) == 1)
                p, q = x["modal_price"], y["modal_price"]
                v = 0 if not same else 2 if p is not None and q is not None and abs(p - q) / max(min(p, q), 1.0) > 0.005 else 1
                key = (x["mandi_code"], x["source"], y["source"])
                old = expected.get(key, (0, 0))
                expected[key] = (max(old[0], v), old[1] + 1)
    names = {2: "CROSS_SOURCE_CONFLICT", 1: "CROSS_SOURCE_MATCH", 0: "GRANULARITY_MISMATCH"}
    assert {(x.mandi_code, x.source_a, x.source_b): (x["class"], x.pairs) for x in found.collect()} == {k: (names[v], c) for k, (v, c) in expected.items()}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_normalising_makes_no_method_that_the_jvm_leaves_uncompiled(spark):
    raw = spark.range(1).select(F.col("id").alias("seq"), (F.col("id") > 0).alias("is_sample_data"), *[F.col("id").cast("string").alias(c) for c in i.TEXTS])
    hashed = i.normalised(raw).select("seq", r.content_hash())
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    made = debug.codegenStringSeq(hashed._jdf.queryExecution().executedPlan())
    assert max(made.apply(k)._3().maxMethodCodeSize() for k in range(made.size())) < 8000


def test_numbers_of_several_forms(spark):
    said = spark.createDataFrame([("1,234.5",), ("12,34,567",), ("-3",), ("1e3",), (".5",), ("NaN",), ("1d",), (",",), (None,)], "x string")
    assert [v.x for v in said.select(r.number(F.col("x")).alias("x")).collect()] == [1234.5, 1234567.0, -3.0, 1000.0, 0.5, None, None, None, None]
