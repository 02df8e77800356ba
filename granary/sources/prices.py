"""Market observations made from the star schema, with their dimension, alert and log tables.

A market is a nation, its codes are its suppliers; a commodity is a brand, a variety a part type, a grade a line status; price and
arrivals are those of a line item; a line's return flag is its source. Grades of line 7 and arrivals of line 6 are unreported.
No query here knows more of the tables than these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.numbers import rounded

# Source, precedence, whether its rows are samples.
SOURCES = (("DATA_GOV_IN", 40, False), ("CEDA", 30, False), ("MOCK_PROVIDER", 0, True))
SOURCE_OF_FLAG = {"A": "DATA_GOV_IN", "N": "CEDA", "R": "MOCK_PROVIDER"}
#: "Today" for every question of freshness.
TODAY = "2001-11-10"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "source string, precedence int, is_sample boolean")


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code (a supplier) to market, district and state."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "s_suppkey", F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.col("n_nationkey").cast("long").alias("mandi_id"), F.col("n_name").alias("mandi"), F.col("s_name").alias("market_code")
    )


def commodities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part to commodity, category and variety."""
    number = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("commodity"), F.concat(F.lit("FAMILY_"), (number % 5).cast("string")).alias("category"), F.col("p_type").alias("variety"))



def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each reported price. The dimensions are joined by broadcast as Catalyst sees fit.

    Lines are dealt by part, once, whether the parts can be broadcast or not, so that a file of few row groups is work for all cores; they are
    dealt as they are read, as the key and the texts that are made of them are wider. Each dimension is joined with the lines, not with another
    one before, as the size of a join is estimated as the product of both sides.
    """
    line, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    lines = line.repartition("l_partkey").join(commodities(spark, sf_dir), line.l_partkey == F.col("p_partkey")).join(s, line.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("long").cast("string")
    text = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    key = F.md5(F.concat_ws("|", *text, F.col("l_shipdate").cast("date").cast("string"), *[cents(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], "l_returnflag", "l_linestatus"))
    source = F.create_map(*[F.lit(x) for kv in SOURCE_OF_FLAG.items() for x in kv])[F.col("l_returnflag")]
    modal = rounded(F.col("l_extendedprice") / F.col("l_quantity"))
    base = lines.select(
        key.alias("observation_id"), F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.col("n_nationkey").cast("long").alias("mandi_id"), F.col("n_name").alias("mandi"), F.col("s_name").alias("market_code"), "commodity", "category", "variety",
        F.when(F.col("l_linenumber") != 7, F.col("l_linestatus")).alias("grade"), F.col("l_shipdate").cast("date").alias("reported_date"),
        modal.alias("modal_price"), rounded(modal * (1 - F.col("l_discount"))).alias("min_price"), rounded(modal * (1 + F.col("l_tax"))).alias("max_price"),
        F.when(F.col("l_linenumber") != 6, F.col("l_quantity")).alias("arrival_quantity"), source.alias("source"),
    )
    flags = F.array_compact(F.array(F.when(F.col("grade").isNull(), F.lit("MISSING_GRADE")), F.when(F.col("arrival_quantity").isNull(), F.lit("MISSING_ARRIVALS")), F.when(F.col("modal_price") > 4000, F.lit("PRICE_OUTLIER"))))
    return base.join(F.broadcast(sources(spark)), "source", "left").select(
        "observation_id", "state", "district", "mandi_id", "mandi", "market_code", "commodity", "category", "variety", "grade", "reported_date", "modal_price", "min_price", "max_price",
        "arrival_quantity", F.when(F.col("arrival_quantity").isNotNull(), F.lit("tonne")).alias("arrival_unit"), F.lit("INR/quintal").alias("price_unit"), "source", F.coalesce("precedence", F.lit(10)).alias("precedence"), F.coalesce("is_sample", F.lit(False)).alias("is_sample"),
        flags.alias("quality_flags"), F.when(F.size(flags) > 0, "FLAGGED").otherwise("VALID").alias("quality_status"),
    )


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("alert_id"), F.col("c_nationkey").cast("long").alias("mandi_id"), F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string")).alias("commodity"), rounded(F.abs("c_acctbal") * 0.5).alias("target_price"),
        F.when(key % 2 == 0, "gte").otherwise("lte").alias("condition"), ((key % 12 + 1) * 60).alias("freshness_hours"), (key % 17 != 0).alias("is_active"),
    )


def sync_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each order."""
    status = F.create_map(*[F.lit(x) for x in ("F", "SUCCESS", "O", "PARTIAL_SUCCESS", "P", "FAILED")])[F.col("o_orderstatus")]
    fetched = F.floor(F.col("o_totalprice") / 1000).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_custkey") % 2 == 0, "CEDA").otherwise("DATA_GOV_IN").alias("source"), status.alias("status"), F.col("o_orderdate").cast("date").alias("synced_on"), fetched.alias("records_fetched"),
        F.when(status == "FAILED", F.lit("error: api-key=abc123 token=xyz")).alias("message"),
    )


_SOURCE = "CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_OF_FLAG.items()) + " END"
OBS_SQL = f"""
sources(source, precedence, is_sample) AS (VALUES {", ".join(f"('{s}', {p}, {str(x).lower()})" for s, p, x in SOURCES)}),
obs0 AS (
  SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'), CAST(floor(l_quantity * 100 + 0.5) AS BIGINT), CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT),
                   CAST(floor(l_discount * 100 + 0.5) AS BIGINT), CAST(floor(l_tax * 100 + 0.5) AS BIGINT), l_returnflag, l_linestatus)) AS observation_id,
         r_name AS state, n_name AS district, CAST(n_nationkey AS BIGINT) AS mandi_id, n_name AS mandi, s_name AS market_code, p_brand AS commodity,
         'FAMILY_' || CAST(CAST(regexp_extract(p_brand, '#([0-9]+)', 1) AS INTEGER) % 5 AS VARCHAR) AS category, p_type AS variety,
         CASE WHEN l_linenumber <> 7 THEN l_linestatus END AS grade, CAST(l_shipdate AS DATE) AS reported_date,
         floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS modal_price, l_discount, l_tax,
         CASE WHEN l_linenumber <> 6 THEN l_quantity END AS arrival_quantity, {_SOURCE} AS source
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
obs AS (
  SELECT observation_id, state, district, mandi_id, mandi, market_code, commodity, category, variety, grade, reported_date, modal_price,
         floor(modal_price * (1 - l_discount) * 100 + 0.5) / 100 AS min_price, floor(modal_price * (1 + l_tax) * 100 + 0.5) / 100 AS max_price, arrival_quantity,
         CASE WHEN arrival_quantity IS NOT NULL THEN 'tonne' END AS arrival_unit, 'INR/quintal' AS price_unit, obs0.source AS source, coalesce(precedence, 10) AS precedence, coalesce(is_sample, false) AS is_sample,
         list_filter([CASE WHEN grade IS NULL THEN 'MISSING_GRADE' END, CASE WHEN arrival_quantity IS NULL THEN 'MISSING_ARRIVALS' END, CASE WHEN modal_price > 4000 THEN 'PRICE_OUTLIER' END], lambda x: x IS NOT NULL) AS quality_flags,
         CASE WHEN grade IS NULL OR arrival_quantity IS NULL OR modal_price > 4000 THEN 'FLAGGED' ELSE 'VALID' END AS quality_status
  FROM obs0 LEFT JOIN sources ON sources.source = obs0.source)"""

ALERTS_SQL = """
alerts AS (
  SELECT c_custkey AS alert_id, CAST(c_nationkey AS BIGINT) AS mandi_id, 'Brand#' || CAST(c_custkey % 25 + 1 AS VARCHAR) AS commodity, floor(abs(c_acctbal) * 0.5 * 100 + 0.5) / 100 AS target_price,
         CASE WHEN c_custkey % 2 = 0 THEN 'gte' ELSE 'lte' END AS condition, (c_custkey % 12 + 1) * 60 AS freshness_hours, c_custkey % 17 <> 0 AS is_active FROM customer)"""

SYNC_SQL = """
runs AS (
  SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 2 = 0 THEN 'CEDA' ELSE 'DATA_GOV_IN' END AS source, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'PARTIAL_SUCCESS' WHEN 'P' THEN 'FAILED' END AS status,
         CAST(o_orderdate AS DATE) AS synced_on, CAST(floor(o_totalprice / 1000) AS BIGINT) AS records_fetched, CASE WHEN o_orderstatus = 'P' THEN 'error: api-key=abc123 token=xyz' END AS message FROM orders)"""
