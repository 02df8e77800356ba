"""Queries over where data come from: historical windows, names and places, traces of records, and the quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import history, ingest, names, report, trace
from granary.plans.ingestion import CODES, NOW, RAW_SQL, normal, raw
from granary.plans.registry import query
from granary.session import work_folder
from granary.sources import prices as p
from granary.sources.prices import SYNC_SQL, TODAY

KEPT = "observation_id string, mandi_id long, commodity string, variety string, grade string, reported_date date, modal_price double, source string"


@query("""WITH days AS (SELECT reported_date AS d, count(*) AS n FROM obs GROUP BY 1),
span AS (SELECT min(d) AS a, max(d) AS b, CAST(sum(n) AS BIGINT) // 2 AS half FROM days),
planned AS (SELECT CAST(x AS DATE) AS "from", least(CAST(x AS DATE) + 89, b) AS "to" FROM (SELECT unnest(generate_series(a, b, INTERVAL 90 DAY)) AS x, b FROM span)),
counted AS (SELECT "from", "to", CAST(coalesce(sum(n), 0) AS BIGINT) AS records FROM planned LEFT JOIN days ON d BETWEEN "from" AND "to" GROUP BY 1, 2),
run AS (SELECT *, coalesce(sum(records) OVER (ORDER BY "from" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counted)
SELECT "from", "to", 'complete' AS status, records, CASE WHEN before < half THEN 1 ELSE 2 END AS run FROM run, span""")
def resumed_history(spark, d):
    """All reports in windows of 90 days: a first run stops at half of them, a second one takes up the rest; entries are checked against what was written."""
    obs = p.observations(spark, d)
    span = obs.agg(F.min("reported_date").cast("string").alias("a"), F.max("reported_date").cast("string").alias("b"), F.count("*").alias("n")).first()
    planned = ingest.windows(span.a, span.b, 90, spark)
    past = history.History(spark, work_folder(spark), KEPT)
    past.run(obs, planned, "reported_date", span.n // 2)
    past.run(obs, planned, "reported_date")
    return past.verified().select("from", "to", "status", "records", "run")


ASKED = """asked AS (SELECT DISTINCT asked FROM (SELECT substr(p_name, 2, 5) AS asked FROM part UNION ALL SELECT upper(substr(p_name, 1, 2)) FROM part UNION ALL SELECT lower(p_brand) FROM part
  UNION ALL SELECT substr(p_type, 2, 4) FROM part UNION ALL SELECT ' ' || CAST(s_suppkey * 3 AS VARCHAR) || ' ' FROM supplier UNION ALL SELECT s_name FROM supplier UNION ALL SELECT ' '))"""


@query(f"""WITH {ASKED}, rows AS (SELECT p_partkey, p_brand, p_name, p_type FROM part),
hits AS (SELECT asked, p_partkey, CASE WHEN CAST(p_partkey AS VARCHAR) = lower(trim(asked)) OR lower(p_brand) = lower(trim(asked)) THEN 0 WHEN contains(lower(p_name), lower(trim(asked))) THEN 1 WHEN contains(p_type, trim(asked)) THEN 2 END AS rank FROM asked, rows WHERE trim(asked) <> ''),
best AS (SELECT asked, p_partkey, rank, row_number() OVER (PARTITION BY asked ORDER BY rank > 0, p_partkey) AS k FROM hits WHERE rank IS NOT NULL)
SELECT asked, p_partkey, ['exact', 'part', 'script'][rank + 1] AS how FROM best WHERE k = 1""", obs=False)
def fuzzy_lookup(spark, d):
    """Parts by number, brand, a piece of their name, or a piece of their type as it is written."""
    part, supplier = p.table(spark, d, "part"), p.table(spark, d, "supplier")
    number = F.concat(F.lit(" "), (F.col("s_suppkey") * 3).cast("string"), F.lit(" "))
    pieces = F.array(F.substring("p_name", 2, 5), F.upper(F.substring("p_name", 1, 2)), F.lower("p_brand"), F.substring("p_type", 2, 4), F.lit(" "))
    asked = part.select(F.explode(pieces).alias("asked")).unionByName(supplier.select(F.explode(F.array(number, "s_name")).alias("asked"))).distinct()
    return names.fuzzy_lookup(part, asked, "p_partkey", ("p_brand",), ("p_name",), ("p_type",))


@query("""WITH asks AS (SELECT c_custkey AS ask_id, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey % 30 AS VARCHAR) WHEN 1 THEN ' BRAND#' || CAST(c_custkey % 30 AS VARCHAR) || ' ' WHEN 2 THEN 'Brand#' || CAST(c_custkey % 25 + 1 AS VARCHAR) ELSE CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'brand#1' END END AS commodity,
    CASE WHEN c_custkey % 5 = 0 THEN CAST(n_regionkey AS VARCHAR) ELSE lower(r_name) END AS state, CASE WHEN c_custkey % 7 = 0 THEN 'NATION_' || CAST(c_custkey % 25 AS VARCHAR) WHEN c_custkey % 7 = 1 THEN CAST(c_nationkey AS VARCHAR) ELSE n_name END AS district
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
crops AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INTEGER) AS commodity_id, p_brand AS commodity_name FROM part),
geo AS (SELECT n_regionkey AS state_id, r_name AS state_name, n_nationkey AS district_id, n_name AS district_name FROM nation JOIN region ON n_regionkey = r_regionkey),
found AS (SELECT ask_id, nullif(lower(trim(commodity)), '') AS c, state AS s, lower(district) AS t FROM asks),
one AS (SELECT f.*, (SELECT min(commodity_id) FROM crops WHERE CAST(commodity_id AS VARCHAR) = c OR lower(commodity_name) = c) AS commodity_id, (SELECT min(state_id) FROM geo WHERE CAST(state_id AS VARCHAR) = s OR lower(state_name) = s) AS state_id FROM found f),
two AS (SELECT one.*, (SELECT min(district_id) FROM geo WHERE geo.state_id = one.state_id AND (CAST(district_id AS VARCHAR) = t OR lower(district_name) = t)) AS district_id FROM one),
told AS (SELECT *, CASE WHEN c IS NULL THEN 'INCOMPLETE' WHEN commodity_id IS NULL THEN 'NO_COMMODITY' WHEN state_id IS NULL THEN 'NO_STATE' WHEN district_id IS NULL THEN 'NO_DISTRICT' ELSE 'OK' END AS status FROM two)
SELECT ask_id, status, CASE WHEN status = 'OK' THEN commodity_id END AS commodity_id, CASE WHEN status = 'OK' THEN state_id END AS state_id, CASE WHEN status = 'OK' THEN district_id END AS district_id,
  CASE WHEN status = 'OK' THEN (SELECT count(*) FROM supplier WHERE s_nationkey = district_id) END AS markets FROM told""", obs=False)
def scope_resolution(spark, d):
    """A commodity, state and district from each customer, by number or name, some of them wrong or missing."""
    key, text = F.col("c_custkey"), lambda c: c.cast("string")
    geo = p.table(spark, d, "nation").join(p.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asks = p.table(spark, d, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    crop = F.when(key % 4 == 0, text(key % 30)).when(key % 4 == 1, F.concat(F.lit(" BRAND#"), text(key % 30), F.lit(" "))).when(key % 4 == 2, F.concat(F.lit("Brand#"), text(key % 25 + 1))).when(key % 3 == 0, " ").otherwise("brand#1")
    state = F.when(key % 5 == 0, text(F.col("n_regionkey"))).otherwise(F.lower("r_name"))
    district = F.when(key % 7 == 0, F.concat(F.lit("NATION_"), text(key % 25))).when(key % 7 == 1, text(F.col("c_nationkey"))).otherwise(F.col("n_name"))
    crops = p.table(spark, d, "part").select(F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int").alias("commodity_id"), F.col("p_brand").alias("commodity_name")).distinct()
    places = geo.select(F.col("n_regionkey").alias("state_id"), F.col("r_name").alias("state_name"), F.col("n_nationkey").alias("district_id"), F.col("n_name").alias("district_name"))
    markets = p.table(spark, d, "supplier").select(F.col("s_nationkey").alias("district_id"), F.col("s_suppkey").alias("market_id"))
    return names.scopes(asks.select(key.alias("ask_id"), crop.alias("commodity"), state.alias("state"), district.alias("district")), crops, places, markets)


PLACES = """places AS (SELECT s_suppkey AS place, s_nationkey AS district_code, CASE WHEN s_suppkey % 11 = 0 THEN 9 ELSE n_regionkey END AS state_code, CASE WHEN s_suppkey % 7 = 0 THEN '!' || s_name WHEN s_suppkey % 2 = 0 THEN 'GRAM  ' || CAST(s_suppkey % 40 AS VARCHAR) ELSE chr(201) || 'cole ' || CAST(s_suppkey % 40 AS VARCHAR) END AS name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 1000000000000 + c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 99 ELSE c_nationkey END, NULL, CASE WHEN c_custkey % 2 = 0 THEN ' Gram ' || CAST(c_custkey % 60 AS VARCHAR) ELSE 'e' || chr(769) || 'cole ' || CAST(c_custkey % 60 AS VARCHAR) END FROM customer),
checked AS (SELECT place, p.district_code AS district_code, trim(regexp_replace(p.name, '\\s+', ' ', 'g')) AS name, CASE WHEN n_nationkey IS NULL OR (state_code IS NOT NULL AND state_code <> n_regionkey) THEN 'unmapped_parent'
    WHEN NOT regexp_full_match(trim(regexp_replace(p.name, '\\s+', ' ', 'g')), '[\\p{L}\\p{N}][\\p{L}\\p{M}\\p{N} .,''()\\-/&@+\\[\\]"]{1,99}') THEN 'unsupported_name' END AS excluded FROM places p LEFT JOIN nation ON p.district_code = n_nationkey),
firsts AS (SELECT district_code, arg_min(name, place) AS name, lower(nfc_normalize(name)) AS same FROM checked WHERE excluded IS NULL GROUP BY district_code, lower(nfc_normalize(name)))"""


def places(spark, d):
    """Suppliers as villages, with the state that they say they lie in, and customers as towns without one."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    nation, number = p.table(spark, d, "nation"), lambda k, n: (k % n).cast("string")
    village = F.when(s % 7 == 0, F.concat(F.lit("!"), "s_name")).when(s % 2 == 0, F.concat(F.lit("GRAM  "), number(s, 40))).otherwise(F.concat(F.lit("École "), number(s, 40)))
    villages = p.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    villages = villages.select(s.cast("long").alias("place"), F.col("s_nationkey").alias("district_code"), F.when(s % 11 == 0, 9).otherwise(F.col("n_regionkey")).alias("state_code"), village.alias("name"))
    town = F.when(c % 2 == 0, F.concat(F.lit(" Gram "), number(c, 60))).otherwise(F.concat(F.lit("école "), number(c, 60)))
    towns = p.table(spark, d, "customer").select((c + 1_000_000_000_000).alias("place"), F.when(c % 13 == 0, 99).otherwise(F.col("c_nationkey")).alias("district_code"), F.lit(None).cast("int").alias("state_code"), town.alias("name"))
    districts = nation.select(F.col("n_nationkey").alias("district_code"), F.col("n_regionkey").alias("state_code"), F.col("n_name").alias("district_name"))
    return names.checked_places(villages.unionByName(towns), districts), districts


def listed(spark, d):
    checked, districts = places(spark, d)
    states = p.table(spark, d, "region").select(F.col("r_regionkey").alias("state_code"), F.col("r_name").alias("state_name"))
    return names.directory(states, districts, checked)


@query(f"""WITH {PLACES}, listed AS (SELECT district_code, list(name ORDER BY lower(name), name) AS names FROM firsts GROUP BY district_code)
SELECT n_regionkey AS state_code, r_name AS state_name, n_nationkey AS district_code, n_name AS district_name, coalesce(len(names), 0) AS place_count, array_to_string(coalesce(names, []), '|') AS names
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN listed ON district_code = n_nationkey""", obs=False)
def location_directory(spark, d):
    return listed(spark, d).withColumn("names", F.array_join("names", "|"))


@query(f"WITH {PLACES} SELECT excluded, count(*) AS places FROM checked WHERE excluded IS NOT NULL GROUP BY excluded", obs=False)
def excluded_places(spark, d):
    return places(spark, d)[0].filter("excluded is not null").groupBy("excluded").agg(F.count("*").alias("places"))


@query(f"""WITH {PLACES}, asks AS (SELECT o_orderkey AS ask_id, CAST(o_custkey % 25 AS INTEGER) AS district_code, CASE WHEN o_orderkey % 2 = 0 THEN 'gram ' ELSE 'E' || chr(769) || 'COLE  ' END || CAST(o_orderkey % 70 AS VARCHAR) AS name FROM orders)
SELECT ask_id, a.district_code AS district_code, a.name AS name, f.name AS listed FROM asks a LEFT JOIN firsts f ON f.district_code = a.district_code AND f.same = lower(nfc_normalize(regexp_replace(a.name, '\\s+', ' ', 'g')))""", obs=False)
def location_options(spark, d):
    """Is what a user chose a place of the district? However it is written, as listed."""
    key = F.col("o_orderkey")
    name = F.concat(F.when(key % 2 == 0, "gram ").otherwise("ÉCOLE  "), (key % 70).cast("string"))
    asks = p.table(spark, d, "orders").select(key.alias("ask_id"), (F.col("o_custkey") % 25).cast("int").alias("district_code"), name.alias("name"))
    return names.chosen_places(asks, listed(spark, d))


@query(f"""WITH {RAW_SQL}, told AS (SELECT codes.*, raw.k AS k, concat_ws(',', {CODES.replace("fault", "codes.fault").replace("source", "codes.source").replace("price_date", "codes.price_date").replace("state", "codes.state").replace("district", "codes.district").replace("commodity_code", "codes.commodity_code").replace("is_sample_data", "codes.is_sample_data")}) AS errors FROM codes JOIN raw ON codes.seq = raw.seq),
diff AS (SELECT *, CASE WHEN k % 17 <> 0 THEN concat_ws(',', CASE WHEN k % 19 = 0 AND grade IS NOT NULL THEN 'grade' END, CASE WHEN k % 13 = 0 AND modal_price IS NOT NULL THEN 'modal_price' END) END AS differing FROM told)
SELECT seq, differing, CASE WHEN source IS NULL OR source NOT IN ('DATA_GOV_IN', 'CEDA') OR is_sample_data THEN 'SAMPLE_ONLY' WHEN k % 17 = 0 THEN 'INCOMPLETE' WHEN errors <> '' OR differing <> '' THEN 'FAIL' ELSE 'GENUINE_TRACE_PASS' END AS verdict FROM diff""")
def record_trace(spark, d):
    """Stored records of which some were changed since, against their raw ones, of which some are gone."""
    k = F.conv(F.substring("seq", 1, 6), 16, 10).cast("long")
    stored = normal(spark, d).withColumns({"modal_price": F.when(k % 13 == 0, F.col("modal_price") + 1).otherwise(F.col("modal_price")), "grade": F.when(k % 19 != 0, F.col("grade"))})
    out = trace.traced(stored, raw(spark, d).filter(k % 17 != 0), NOW)
    return out.select("seq", F.array_join(F.transform("differences", lambda x: x["field"]), ",").alias("differing"), "verdict")


def _sections_sql() -> str:
    value = lambda section, key, metric, x, where="obs", group="": f"SELECT '{section}' AS section, {key} AS key, '{metric}' AS metric, CAST({x} AS BIGINT) AS value FROM {where} {group}"
    n, genuine, flagged = "count(*)", "count(*) FILTER (WHERE NOT is_sample)", "count(*) FILTER (WHERE quality_status = 'FLAGGED')"
    day = lambda x: f"date_diff('day', DATE '1970-01-01', {x})"
    parts = [value("coverage", "'all'", m, x) for m, x in (("records", n), ("genuine", genuine), ("flagged", flagged), ("first", day("min(reported_date)")), ("last", day("max(reported_date)")))]
    bad = {
        "modal_not_positive": "modal_price <= 0", "min_above_max": "min_price > max_price", "modal_outside": "modal_price < min_price OR modal_price > max_price", "arrivals_negative": "arrival_quantity < 0",
        "future_dated": f"reported_date > DATE '{TODAY}'", "unit_unknown": "price_unit <> 'INR/quintal'",
    }
    parts += [value("invalid_records", "'all'", m, f"count(*) FILTER (WHERE {x})") for m, x in bad.items()]
    parts += [value("missing_values", f"'{c}'", "missing", f"count(*) FILTER (WHERE {c} IS NULL)") for c in report.PROFILED]
    for section, column in report.BY_VALUE.items():
        column = "year(reported_date)" if column == "year" else column
        parts += [value(section, f"coalesce(CAST({column} AS VARCHAR), '(none)')", m, x, group=f"GROUP BY {column}") for m, x in (("records", n), ("genuine", genuine), ("flagged", flagged))]
    days = "(SELECT count(*) AS n, count(DISTINCT source) AS s FROM obs GROUP BY mandi_id, commodity, reported_date)"
    parts += [value("cross_source_overlaps", "'all'", m, x, days) for m, x in (("market_days", n), ("overlapping", "count(*) FILTER (WHERE s > 1)"), ("records", "coalesce(sum(n) FILTER (WHERE s > 1), 0)"))]
    same = "(SELECT count(*) AS n FROM obs GROUP BY source, mandi_id, commodity, reported_date, variety, grade)"
    parts += [value("duplicates", "'all'", m, x, same) for m, x in (("identities", n), ("groups", "count(*) FILTER (WHERE n > 1)"), ("duplicate_rows", "sum(n - 1)"))]
    refresh = {
        "runs": n, "succeeded": "count(*) FILTER (WHERE status = 'SUCCESS')", "not_whole": "count(*) FILTER (WHERE status IN ('FAILED', 'PARTIAL_SUCCESS'))",
        "last_success": day("max(synced_on) FILTER (WHERE status = 'SUCCESS')"), "fetched": "coalesce(sum(records_fetched), 0)",
    }
    return " UNION ALL ".join(parts + [value("refresh", "'all'", m, x, "runs") for m, x in refresh.items()])


SECTIONS = f"{SYNC_SQL.strip()}, report AS ({_sections_sql()})"


def whole_report(spark, d):
    return report.sections(p.observations(spark, d), TODAY).unionByName(report.refresh(p.sync_log(spark, d)))


@query(f"WITH {SECTIONS} SELECT * FROM report")
def quality_sections(spark, d):
    return whole_report(spark, d)


@query(f"""WITH {SECTIONS}, said AS (SELECT *, CASE WHEN section = 'coverage' AND metric = 'records' AND value = 0 THEN 'no records at all' WHEN section = 'missing_values' AND value > 0 THEN 'records without ' || key
  WHEN metric = 'modal_not_positive' AND value > 0 THEN 'prices that aren''t positive' WHEN metric = 'future_dated' AND value > 0 THEN 'records of days to come' WHEN metric = 'unit_unknown' AND value > 0 THEN 'records without a known unit'
  WHEN metric = 'duplicate_rows' AND value > 0 THEN 'rows that repeat an identity' WHEN metric = 'last_success' AND value IS NULL THEN 'no run has succeeded' WHEN metric = 'not_whole' AND value > 0 THEN 'runs that failed or were partial' END AS gap FROM report)
SELECT gap, coalesce(value, 0) AS records FROM said WHERE gap IS NOT NULL""")
def quality_gaps(spark, d):
    return report.gaps(whole_report(spark, d))
