"""Queries of what goes out and comes back: units, exports, files of series, appended lines, national reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import exchange as x
from granary.operators import ingest as i
from granary.operators import market as m
from granary.operators import series as s
from granary.plans.ingestion import CODES, DEDUPED, NOW, RAW_SQL, normal
from granary.plans.registry import query
from granary.session import work_folder
from granary.sources import files
from granary.sources import prices as p
from granary.sources.prices import SYNC_SQL


@query("""WITH said AS (SELECT p_partkey, p_type AS unit, [p_name || ' (Rs./Quintal)', 'price INR / kg', 'rate per  KG', 'modal price', NULL, 'per kg or per quintal'][CAST(p_partkey % 6 + 1 AS INTEGER)] AS label, ['inr/', 'INR/', ' Inr/', ''][CAST(p_partkey % 4 + 1 AS INTEGER)] AS prefix FROM part)
SELECT coalesce(['INR/quintal', 'INR/kg', 'INR/kg', NULL, NULL, 'INR/quintal'][CAST(p_partkey % 6 + 1 AS INTEGER)], '(none)') AS field_unit, 'INR/' || lower(unit) AS canonical, count(*) AS parts FROM said GROUP BY 1, 2""", obs=False)
def price_units(spark, d):
    """Units that labels of fields speak of, and stored units in their one form."""
    k = F.col("p_partkey")
    label = F.get(F.array(F.concat("p_name", F.lit(" (Rs./Quintal)")), F.lit("price INR / kg"), F.lit("rate per  KG"), F.lit("modal price"), F.lit(None), F.lit("per kg or per quintal")), (k % 6).cast("int"))
    prefix = F.get(F.array(*map(F.lit, ("inr/", "INR/", " Inr/", ""))), (k % 4).cast("int"))
    fields = F.array(F.struct(F.lit("state").alias("name"), F.lit("state_id").alias("id")), F.struct(label.alias("name"), F.lit("f1").alias("id")))
    return p.table(spark, d, "part").groupBy(F.coalesce(x.unit_of_fields(fields), F.lit("(none)")).alias("field_unit"), x.canonical_unit(F.concat(prefix, "p_type")).alias("canonical")).agg(F.count("*").alias("parts"))


@query("SELECT mandi, commodity, count(*) AS records FROM obs WHERE contains(upper(mandi), 'NATION_1') AND contains(upper(commodity), 'D#2') GROUP BY 1, 2")
def selected_series(spark, d):
    return p.observations(spark, d).filter(x.selects("nation_1", "d#2")).groupBy("mandi", "commodity").agg(F.count("*").alias("records"))


@query(f"""WITH {RAW_SQL}, {DEDUPED.replace("FROM codes", "FROM (SELECT * FROM codes WHERE concat_ws(',', " + CODES + ") = '') codes")},
now AS (SELECT seq, CASE WHEN seq < '4' THEN modal_price + 1 ELSE modal_price END AS was FROM kept WHERE seq < 'c')
SELECT k.seq AS seq, CASE WHEN n.seq IS NULL THEN 'inserted' WHEN was = modal_price THEN 'unchanged' ELSE 'updated' END AS action, was AS previous_modal_price FROM kept k LEFT JOIN now n ON n.seq = k.seq""")
def reimported_export(spark, d):
    """Checked records written as CSV by month with their status, read back, and imported over a table that lacks a quarter of them and has another quarter at old prices."""
    checked = i.validated(normal(spark, d), NOW)
    columns = ["seq", *i.IDENTITY, *i.VALUES]
    status = F.when(F.size("errors") == 0, "valid").otherwise("rejected").alias("validation_status")
    path = f"{work_folder(spark)}/export"
    files.write_csv(checked.select(*columns, status), path, "price_date")
    kinds = {"price_date": "date", **dict.fromkeys(i.VALUES, "double")}
    back = files.read_csv(spark, path, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in [*columns, "validation_status"])).select(*columns, "validation_status")
    known = i.deduplicated(back.filter("validation_status = 'valid'")).select(*columns).filter("seq < 'c'")
    current = known.withColumn("modal_price", F.when(F.col("seq") < "4", F.col("modal_price") + 1).otherwise(F.col("modal_price")))
    return x.reimport_plan(back, current).select("seq", "action", "previous_modal_price")


@query("""WITH made AS (SELECT * FROM obs WHERE source = 'MOCK_PROVIDER'), recent AS (SELECT * FROM made WHERE reported_date > (SELECT max(reported_date) FROM made) - 730)
SELECT mandi_id, commodity, count(*) AS records, min(reported_date) AS first_date, max(reported_date) AS last_date FROM recent WHERE CAST('0x' || substr(md5(mandi_id || '/' || commodity), 1, 8) AS BIGINT) % 3 = 1 GROUP BY 1, 2""")
def made_up_series(spark, d):
    """Made-up reports written as CSV and read again: the last two years, of one shard of three."""
    columns = ["mandi_id", "commodity", "reported_date", "modal_price", "source", "is_sample"]
    path = f"{work_folder(spark)}/made-up"
    files.write_csv(p.observations(spark, d).filter(F.col("source") == x.MADE_UP).select(*columns), path)
    rows = files.read_csv(spark, path, "mandi_id long, commodity string, reported_date date, modal_price double, source string, is_sample boolean")
    return x.made_up_series(rows, 2, (1, 3)).groupBy(*s.SERIES).agg(F.count("*").alias("records"), F.min("reported_date").alias("first_date"), F.max("reported_date").alias("last_date"))


@query(f"WITH {SYNC_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY source, status ORDER BY synced_on DESC, run_id DESC) AS k FROM (SELECT * FROM (SELECT source, status, max(synced_on) AS synced_on FROM runs GROUP BY 1, 2) JOIN runs USING (source, status, synced_on))) SELECT source, status, synced_on, run_id, records_fetched FROM k WHERE k = 1", obs=False)
def appended_runs(spark, d):
    """Runs appended as JSON lines in two batches; the last of each source and status."""
    runs = p.sync_log(spark, d).withColumn("at", F.struct("synced_on", "run_id")).select("source", "status", "at", "records_fetched")
    folder = f"{work_folder(spark)}/runs"
    for half in (0, 1):
        x.append_lines(runs.filter(F.col("at.run_id") % 2 == half), folder)
    last = x.last_lines(spark, folder, "source string, status string, at struct<synced_on: date, run_id: long>, records_fetched long", ("source", "status"), "at")
    return last.select("source", "status", "at.synced_on", "at.run_id", "records_fetched")


@query("""WITH reports AS (SELECT 'AGMARKNET' AS source, commodity, reported_date AS report_date, floor(sum(CAST(floor(modal_price * 100 + 0.5) AS BIGINT)) / count(*) + 0.5) / 100 AS price, sum(arrival_quantity) AS arrivals, CASE WHEN dayofyear(reported_date) % 4 = 0 THEN 1500.0 END AS msp FROM obs GROUP BY commodity, reported_date),
old AS (SELECT source, commodity, report_date, CASE WHEN day(report_date) = 7 THEN price + 1 ELSE price END AS price, arrivals, CASE WHEN day(report_date) = 9 THEN 0.0 ELSE msp END AS msp FROM reports WHERE month(report_date) <> 2),
new AS (SELECT * FROM reports WHERE month(report_date) <> 3)
SELECT coalesce(n.source, o.source) AS source, coalesce(n.commodity, o.commodity) AS commodity, coalesce(n.report_date, o.report_date) AS report_date, CASE WHEN n.source IS NULL THEN o.price ELSE n.price END AS price, CASE WHEN n.source IS NULL THEN o.msp ELSE n.msp END AS msp,
  CASE WHEN n.source IS NULL THEN 'kept' WHEN o.source IS NULL THEN 'inserted' WHEN n.price IS NOT DISTINCT FROM o.price AND n.arrivals IS NOT DISTINCT FROM o.arrivals AND n.msp IS NOT DISTINCT FROM o.msp THEN 'unchanged' ELSE 'updated' END AS action
FROM old o FULL JOIN new n ON n.source = o.source AND n.commodity = o.commodity AND n.report_date = o.report_date""")
def report_upsert(spark, d):
    """National reports over a table without those of February, with old prices on each 7th and a support price of 0 on each 9th; the batch lacks March and says each report twice."""
    day = F.col("report_date")
    reports = m.national_reports(p.observations(spark, d)).select(F.lit("AGMARKNET").alias("source"), "commodity", F.col("reported_date").alias("report_date"), "price", "arrivals", F.when(F.dayofyear("reported_date") % 4 == 0, 1500.0).alias("msp"))
    old = reports.filter(F.month(day) != 2).withColumn("price", F.when(F.day(day) == 7, F.col("price") + 1).otherwise(F.col("price"))).withColumn("msp", F.when(F.day(day) == 9, 0.0).otherwise(F.col("msp")))
    new = reports.filter(F.month(day) != 3).withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("price", F.when(F.col("seq") == 1, F.col("price") * 2).otherwise(F.col("price")))
    return x.report_plan(old, new).select("source", "commodity", "report_date", "price", "msp", "action")
