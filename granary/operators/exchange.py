"""What goes out and comes back: units, exports and their re-import, series from files, appended lines, and upserts of national reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators import ingest
from granary.operators.market import SERIES

PRICE_UNIT = "INR/quintal"
#: Fixed value: the source whose rows are made up.
MADE_UP = "MOCK_PROVIDER"


def unit_of_fields(fields: Column) -> Column:
    """The price unit that the labels of a response's fields (array of structs of name and id) speak of: a quintal before a kilogram; null if none does."""
    label = lambda f: F.concat_ws(" ", f["name"], f["id"])
    said = F.lower(F.array_join(F.transform(fields, label), " "))
    speaks = lambda unit: said.rlike(rf"(per\s+|rs\.?\s*/?\s*|inr\s*/\s*){unit}")
    return F.when(speaks("quintal"), PRICE_UNIT).when(speaks("kg"), "INR/kg")


def canonical_unit(raw: Column) -> Column:
    """INR/ and the unit in lower case; a quintal where nothing is given."""
    unit = F.lower(F.regexp_replace(F.trim(raw), r"(?i)^inr/", ""))
    return F.when(raw.isNull() | (raw == ""), PRICE_UNIT).otherwise(F.concat(F.lit("INR/"), unit))


def selects(mandi_part: str | None = None, commodity_part: str | None = None) -> Column:
    """Rows whose market and commodity contain these parts, in any case; no part, or an empty one, takes all, and null contains nothing else."""
    tests = [F.contains(F.upper(F.coalesce(c, F.lit(""))), F.lit(part.upper())) for c, part in (("mandi", mandi_part), ("commodity", commodity_part)) if part]
    return reduce(lambda x, y: x & y, tests, F.lit(True))


def shard_of(parts: int, *keys: str) -> Column:
    """The same share of the keys on every machine and in every engine: the first 32 bits of an MD5."""
    text = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(parts))


def made_up_series(rows: DataFrame, years: float | None = None, shard: tuple[int, int] | None = None) -> DataFrame:
    """Rows of a file of made-up reports: those of the last years (of 365 days) before its newest day, and of the series of one shard (k of n).

    Raises ValueError if any row isn't flagged as made up: nothing genuine is trained on as if it were. That and the newest day are one aggregate.
    """
    flagged = F.coalesce((F.col("source") == MADE_UP) & F.col("is_sample"), F.lit(False))
    found = rows.agg(F.count_if(~flagged).alias("bad"), F.max("reported_date").alias("last")).first()
    if found.bad:
        raise ValueError(f"{found.bad} rows aren't flagged as made up")
    out = rows
    if years and found.last is not None:
        out = out.filter(F.col("reported_date") > F.date_sub(F.lit(found.last), round(365 * years)))
    if shard is not None:
        out = out.filter(shard_of(shard[1], *SERIES) == shard[0])
    return out


def append_lines(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines beside those that are there; what is written is seen whole or, if the job fails, not at all."""
    rows.write.mode("append").json(folder)


def last_lines(spark: SparkSession, folder: str, schema: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last line of each key. Lines that aren't JSON, or lack a key, are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder).dropna(subset=[*keys])
    columns = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct(order, *[c for c in columns if c != order]))
    return rows.groupBy(*keys).agg(newest.alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in columns])


def reimport_plan(exported: DataFrame, current: DataFrame) -> DataFrame:
    """What an export does to current records: its valid rows, one of each identity, as inserted, updated or unchanged.

    exported: normalised records with validation_status, as they were written; an export says which rows were valid when it was made.
    """
    good = exported.filter("validation_status = 'valid'").drop("validation_status")
    return ingest.merge_plan(current, ingest.deduplicated(good))


REPORT = ("source", "commodity", "report_date")
REPORT_VALUES = ("price", "arrivals", "msp")


def report_plan(current: DataFrame, new: DataFrame) -> DataFrame:
    """National reports after an upsert, each with its action: kept (not in new), unchanged, updated or inserted.

    A report is known by source, commodity and day, and changed if any of its values is (nulls are equal, and differ from 0). Of repeated new
    reports the last by seq counts. One full join on the key, and nothing is written for unchanged ones.
    """
    last = Window.partitionBy(*REPORT).orderBy(F.col("seq").desc())
    one = new.withColumn("_k", F.row_number().over(last)).filter("_k = 1")
    right = one.select(*[F.col(c).alias(f"_{c}") for c in (*REPORT, *REPORT_VALUES)], F.lit(True).alias("_new"))
    left = current.select(*REPORT, *REPORT_VALUES, F.lit(True).alias("_old"))
    out = left.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in REPORT]), "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in REPORT_VALUES])
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    pick = lambda c: F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return out.select(*[pick(c) for c in (*REPORT, *REPORT_VALUES)], action.alias("action"))
