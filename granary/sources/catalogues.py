"""Catalogues and price and quantity rows of a publisher that answers in nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUES = {
    "commodities": "commodity_id long, commodity_name string",
    "geographies": "census_state_id long, census_state_name string, census_district_id long, census_district_name string",
    "markets": "market_id long, market_name string, census_district_id long",
}


def parsed(rows: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """rows with column as a struct of the schema; and those whose text isn't JSON of that form, as they are. A null text is in neither.

    The schema is given, so no pass over the data guesses it, and fields beyond it are left out.
    """
    options = {"columnNameOfCorruptRecord": "_malformed", "mode": "PERMISSIVE"}
    read = rows.filter(F.col(column).isNotNull()).withColumn("_read", F.from_json(column, f"{schema}, _malformed string", options))
    fault = F.col("_read").isNull() | F.col("_read._malformed").isNotNull()
    good = read.filter(~fault).withColumn(column, F.col("_read").dropFields("_malformed")).drop("_read")
    return good, read.filter(fault).select(*rows.columns)


def catalogue(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """The items of answers {"output": {"data": [...]}} (one a file), each once; and the texts of answers that can't be read."""
    answers = spark.read.option("wholetext", True).text(path)
    item = ", ".join(f"{name}: {type_}" for name, type_ in (field.split() for field in CATALOGUES[kind].split(", ")))
    good, bad = parsed(answers, "value", f"output struct<data: array<struct<{item}>>>")
    return good.select(F.explode("value.output.data").alias("item")).select("item.*").distinct(), bad


def with_quantities(prices: DataFrame, quantities: DataFrame, order: Column) -> DataFrame:
    """Price rows (market_id, date and more) with the quantity of their market and day, of several the last in order, and its unit.

    Quantities without a price play no part; a price without one has null. The right side has a row for each key before the join.
    """
    last = quantities.groupBy("market_id", "date").agg(F.max_by("quantity", order).alias("quantity"))
    out = prices.join(last, ["market_id", "date"], "left")
    return out.withColumn("arrival_unit", F.when(F.col("quantity").isNotNull(), "tonne"))
