"""Queries over raw records, which are observations written in the ways that publishers write them, with their faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import records as rec
from granary.functions.numbers import rounded
from granary.operators import ingest as i
from granary.plans.registry import query
from granary.sources import prices as p

NOW = "2001-09-01"


def raw(spark, d) -> DataFrame:
    """Observations as text: two date forms, three price units and three arrival units, aliases in other scripts and widths, and every so often a fault."""
    obs = p.observations(spark, d).withColumn("k", F.conv(F.substring("observation_id", 1, 6), 16, 10).cast("long")).withColumn("fault", F.col("k") % 97)
    k, fault = F.col("k"), F.col("fault")
    unit = F.element_at(F.array(*map(F.lit, ("Rs / Quintal", "INR/kg", "₹/tonne"))), (k % 3 + 1).cast("int"))
    scale = F.element_at(F.array(*map(F.lit, (1.0, 0.01, 10.0))), (k % 3 + 1).cast("int"))
    price = lambda c: F.format_string("%.4f", F.col(c) * scale)
    day = F.when(k % 2 == 0, F.date_format("reported_date", "dd/MM/yyyy")).otherwise(F.date_format("reported_date", "yyyy-M-d"))
    return obs.select(
        F.col("observation_id").alias("seq"), F.when(fault == 1, F.lit(None)).when(fault == 2, "SCRAPER").otherwise(F.col("source")).alias("source"), F.when(fault == 3, ~F.col("is_sample")).otherwise(F.col("is_sample")).alias("is_sample_data"),
        F.col("observation_id").alias("source_record_key"), F.when(fault == 4, " - ").otherwise(F.col("state")).alias("state"), F.when(fault == 5, "N/A").otherwise(F.col("district")).alias("district"), F.concat(F.lit("  "), F.col("mandi"), F.lit(" (Main) ")).alias("market"),
        F.when(fault == 6, "null").when(k % 11 == 0, "Kanda").when(k % 11 == 1, "कांदा").when(k % 11 == 2, "Ｏｎｉｏｎ").otherwise(F.col("commodity")).alias("commodity"), "variety", "grade",
        F.when(fault == 7, "31/02/2001").when(fault == 8, "").otherwise(day).alias("price_date"), F.lit("AUTO").alias("date_format"), F.when(fault == 9, "0").otherwise(price("min_price")).alias("min_price"),
        F.when(fault == 10, "abc").otherwise(price("max_price")).alias("max_price"), F.when(fault == 11, "-5").when(fault == 12, "NR").otherwise(price("modal_price")).alias("modal_price"), F.when(fault == 13, "Rs/bag").otherwise(unit).alias("price_unit"),
        F.when(fault == 14, "-3").otherwise(F.col("arrival_quantity").cast("int").cast("string")).alias("arrivals_quantity"), F.element_at(F.array(*map(F.lit, ("Tonnes", "quintal", "sacks"))), (k % 7 % 3 + 1).cast("int")).alias("arrival_unit"),
    )


def normal(spark, d, *wanted: str) -> DataFrame:
    return i.normalised(raw(spark, d), wanted or None)


def checked(spark, d) -> DataFrame:
    return i.validated(normal(spark, d), NOW)


K = "CAST(('0x' || substr(observation_id, 1, 6)) AS BIGINT)"
RAW_SQL = f"""keyed AS (SELECT *, {K} AS k, {K} % 97 AS fault, [1.0, 0.01, 10.0][CAST({K} % 3 + 1 AS INTEGER)] AS scale FROM obs),
raw AS (
  SELECT observation_id AS seq, CASE WHEN fault = 1 THEN NULL WHEN fault = 2 THEN 'SCRAPER' ELSE source END AS source, CASE WHEN fault = 3 THEN NOT is_sample ELSE is_sample END AS is_sample_data, CASE WHEN fault = 4 THEN NULL ELSE state END AS state, CASE WHEN fault = 5 THEN NULL ELSE district END AS district, mandi || ' (Main)' AS market,
         CASE WHEN fault = 6 THEN NULL WHEN k % 11 IN (0, 1, 2) THEN 'ONION' ELSE regexp_replace(upper(commodity), '[^A-Z0-9]+', '_', 'g') END AS commodity_code, variety, grade, CASE WHEN fault IN (7, 8) THEN NULL ELSE reported_date END AS price_date,
         fault, k, [1.0, 100.0, 0.1][CAST(k % 3 + 1 AS INTEGER)] AS factor, CAST(printf('%.4f', min_price * scale) AS DOUBLE) AS low, CAST(printf('%.4f', max_price * scale) AS DOUBLE) AS high, CAST(printf('%.4f', modal_price * scale) AS DOUBLE) AS modal,
         CASE WHEN fault = 14 THEN -3 ELSE CAST(arrival_quantity AS INTEGER) END AS amount, [1.0, 0.1, NULL][CAST(k % 7 % 3 + 1 AS INTEGER)] AS weight FROM keyed),
normal AS (
  SELECT seq, is_sample_data, source, state, district, market, CASE WHEN state IS NOT NULL AND district IS NOT NULL THEN replace(upper(state), ' ', '_') || '__' || upper(district) || '__' || regexp_replace(upper(market), '[^A-Z0-9]+$|[^A-Z0-9_]+', '_', 'g') END AS code0, commodity_code, price_date, variety, grade,
         CASE WHEN fault = 13 OR fault = 9 THEN NULL ELSE floor(low * factor * 100 + 0.5) / 100 END AS min_price, CASE WHEN fault IN (13, 10) THEN NULL ELSE floor(high * factor * 100 + 0.5) / 100 END AS max_price,
         CASE WHEN fault IN (13, 12) THEN NULL WHEN fault = 11 THEN floor(-5 * factor * 100 + 0.5) / 100 ELSE floor(modal * factor * 100 + 0.5) / 100 END AS modal_price, CASE WHEN fault <> 13 THEN 'INR/quintal' END AS price_unit,
         floor(amount * weight * 100 + 0.5) / 100 AS arrivals_quantity, CASE WHEN amount IS NOT NULL AND weight IS NOT NULL THEN 'tonne' END AS arrival_unit, fault, amount, weight FROM raw),
codes AS (SELECT *, regexp_replace(code0, '_+$', '') AS mandi_code FROM normal)"""


@query(f"WITH {RAW_SQL} SELECT seq, mandi_code, commodity_code, price_date, min_price, max_price, modal_price, price_unit, arrivals_quantity, arrival_unit FROM codes")
def normalised_records(spark, d):
    return normal(spark, d, "seq", "mandi_code", "commodity_code", "price_date", "min_price", "max_price", "modal_price", "price_unit", "arrivals_quantity", "arrival_unit")


CODES = f"""CASE WHEN source IS NULL THEN 'MISSING_SOURCE' END, CASE WHEN source = 'SCRAPER' THEN 'UNKNOWN_SOURCE' END, CASE WHEN source IN ('DATA_GOV_IN', 'CEDA') AND is_sample_data THEN 'SAMPLE_FLAG_ON_GENUINE_SOURCE' END, CASE WHEN source = 'MOCK_PROVIDER' AND NOT is_sample_data THEN 'SAMPLE_SOURCE_NOT_FLAGGED' END,
CASE WHEN state IS NULL THEN 'MISSING_STATE' END, CASE WHEN district IS NULL THEN 'MISSING_DISTRICT' END, CASE WHEN commodity_code IS NULL THEN 'MISSING_COMMODITY' END, CASE WHEN fault = 7 THEN 'INVALID_DATE' END, CASE WHEN fault = 8 THEN 'MISSING_DATE' END,
CASE WHEN price_date > DATE '{NOW}' + 1 THEN 'FUTURE_DATE' END, CASE WHEN price_date < DATE '2000-01-01' THEN 'DATE_TOO_OLD' END, CASE WHEN price_unit IS NULL THEN 'UNKNOWN_PRICE_UNIT' END, CASE WHEN modal_price <= 0 OR min_price <= 0 OR max_price <= 0 THEN 'NON_POSITIVE_PRICE' END,
CASE WHEN modal_price IS NULL THEN 'MISSING_MODAL_PRICE' END, CASE WHEN min_price > max_price THEN 'MIN_ABOVE_MAX' END, CASE WHEN coalesce(modal_price < min_price, false) OR coalesce(modal_price > max_price, false) THEN 'MODAL_OUTSIDE_RANGE' END, CASE WHEN arrivals_quantity < 0 THEN 'NEGATIVE_ARRIVALS' END"""


@query(f"WITH {RAW_SQL} SELECT seq, concat_ws(',', {CODES}) AS errors FROM codes")
def validation_codes(spark, d):
    return checked(spark, d).select("seq", F.array_join("errors", ",").alias("errors"))


@query(f"WITH {RAW_SQL} SELECT code, count(*) AS records FROM (SELECT unnest([{CODES}]) AS code FROM codes) WHERE code IS NOT NULL GROUP BY code")
def rejection_summary(spark, d):
    return i.rejection_summary(checked(spark, d))


DEDUPED = """ranked AS (SELECT *, row_number() OVER w AS last, count(*) OVER (PARTITION BY source, mandi_code, commodity_code, price_date, variety, grade) AS copies FROM codes WINDOW w AS (PARTITION BY source, mandi_code, commodity_code, price_date, variety, grade ORDER BY seq DESC)),
kept AS (SELECT * FROM ranked WHERE last = 1)"""


@query(f"""WITH {RAW_SQL}, {DEDUPED}
SELECT k.seq AS seq, k.copies AS copies, (SELECT count(*) FROM codes c WHERE c.source IS NOT DISTINCT FROM k.source AND c.mandi_code IS NOT DISTINCT FROM k.mandi_code AND c.commodity_code IS NOT DISTINCT FROM k.commodity_code AND c.price_date IS NOT DISTINCT FROM k.price_date AND c.variety IS NOT DISTINCT FROM k.variety AND c.grade IS NOT DISTINCT FROM k.grade
  AND NOT (c.modal_price IS NOT DISTINCT FROM k.modal_price AND c.min_price IS NOT DISTINCT FROM k.min_price AND c.max_price IS NOT DISTINCT FROM k.max_price AND c.arrivals_quantity IS NOT DISTINCT FROM k.arrivals_quantity)) AS conflicts FROM kept k""")
def dedupe_within_source(spark, d):
    return i.deduplicated(normal(spark, d, "seq", *i.IDENTITY, *i.VALUES, "price_unit", "arrival_unit")).select("seq", "copies", "conflicts")


@query(f"""WITH {RAW_SQL}, v AS (SELECT *, count(*) OVER (PARTITION BY mandi_code, commodity_code, price_date, source) AS n FROM codes WHERE modal_price IS NOT NULL),
pairs AS (
  SELECT a.mandi_code, a.commodity_code, a.price_date, a.source AS source_a, b.source AS source_b,
    CASE WHEN (a.variety IS NOT DISTINCT FROM b.variety AND a.grade IS NOT DISTINCT FROM b.grade) OR ((a.variety IS NULL OR b.variety IS NULL) AND a.n = 1 AND b.n = 1) THEN CASE WHEN abs(a.modal_price - b.modal_price) / greatest(least(a.modal_price, b.modal_price), 1.0) > 0.005 THEN 2 ELSE 1 END ELSE 0 END AS v
  FROM v a JOIN v b ON a.mandi_code = b.mandi_code AND a.commodity_code = b.commodity_code AND a.price_date = b.price_date AND a.source < b.source)
SELECT mandi_code, commodity_code, price_date, source_a, source_b, count(*) AS pairs, CASE max(v) WHEN 2 THEN 'CROSS_SOURCE_CONFLICT' WHEN 1 THEN 'CROSS_SOURCE_MATCH' ELSE 'GRANULARITY_MISMATCH' END AS class FROM pairs GROUP BY mandi_code, commodity_code, price_date, source_a, source_b""")
def overlap_classes(spark, d):
    return i.overlaps(normal(spark, d, *i.DAY, "source", "variety", "grade", "modal_price").filter("modal_price is not null"))


NUM = lambda c: f"coalesce('#' || CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END, 'N')"
TXT = lambda c: f"coalesce('S' || {c}, 'N')"


@query(f"""WITH {RAW_SQL} SELECT seq, sha256({" || chr(31) || ".join([TXT("source"), TXT("seq"), TXT("mandi_code"), TXT("commodity_code"), TXT("CAST(price_date AS VARCHAR)"), TXT("price_unit"), *[NUM(c) for c in ("modal_price", "min_price", "max_price", "arrivals_quantity")], TXT("arrival_unit"), TXT("variety"), TXT("grade")])}) AS content_hash FROM codes""")
def content_hash(spark, d):
    return normal(spark, d).select("seq", rec.content_hash().alias("content_hash"))


@query(f"""WITH {RAW_SQL}, {DEDUPED},
old AS (SELECT * FROM kept WHERE substr(seq, 1, 1) < '8'), new AS (SELECT *, CASE WHEN substr(seq, 2, 1) < '4' THEN floor(modal_price * 1.1 * 100 + 0.5) / 100 ELSE modal_price END AS price FROM kept WHERE substr(seq, 1, 1) >= '4')
SELECT seq, CASE WHEN substr(seq, 1, 1) >= '8' THEN 'inserted' WHEN price IS NOT DISTINCT FROM modal_price THEN 'unchanged' ELSE 'updated' END AS action, CASE WHEN substr(seq, 1, 1) < '8' THEN modal_price END AS previous_modal_price FROM new""")
def upsert_actions(spark, d):
    """A second batch: the upper three quarters of the records, of which a quarter have another price."""
    kept = i.deduplicated(normal(spark, d))
    new = kept.filter("substr(seq, 1, 1) >= '4'").withColumn("modal_price", F.when(F.substring("seq", 2, 1) < "4", rounded(F.col("modal_price") * 1.1)).otherwise(F.col("modal_price")))
    return i.merge_plan(kept.filter("substr(seq, 1, 1) < '8'"), new).select("seq", "action", "previous_modal_price")


@query("""WITH planned AS (SELECT CAST(d AS DATE) AS "from", least(CAST(d AS DATE) + 6, DATE '1995-12-31') AS "to" FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 7 DAY)) AS d))
SELECT "from", "to" FROM planned WHERE NOT EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderdate AS DATE) = planned."from" AND o_orderstatus = 'F')""", obs=False)
def pending_windows(spark, d):
    """Weeks of a year; complete are those on whose first day a run succeeded."""
    done = p.sync_log(spark, d).filter("status = 'SUCCESS'").select(F.col("synced_on").alias("from")).distinct()
    planned = i.windows("1995-01-01", "1995-12-31", 7, spark)
    manifest = planned.join(done, "from").withColumn("status", F.lit("complete"))
    return i.pending(planned, manifest)
