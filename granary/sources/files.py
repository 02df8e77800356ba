"""Files: gzip CSV in year and month folders with digests, the wide national report, JSON lines, and a paged web API as a data source."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(c, "|").alias(c) if kind.startswith("array") else F.col(c).cast("string").alias(c) for c, kind in df.dtypes])


def _by_month(df: DataFrame, day: str) -> DataFrame:
    """As text, with year and month, brought together by these; what is shuffled are the columns as they are, as numbers take less room than text."""
    dealt = df.withColumns({"year": F.year(F.to_date(day)), "month": F.month(F.to_date(day))}).hint("rebalance", "year", "month")
    return _flat(dealt).withColumn("month", F.lpad("month", 2, "0"))


def write_csv(df: DataFrame, path: str, day: str | None = None) -> None:
    """Columns in their order, arrays joined by |, nulls empty; with a date column, in folders by year and month. The commit is atomic by task and job.

    Rows are brought together by month first, so that a folder has few files; months that are large are split over tasks again.
    """
    out = _by_month(df, day) if day else _flat(df)
    writer = out.write.mode("overwrite").option("header", True).option("compression", "gzip").option("emptyValue", "").option("nullValue", "")
    (writer.partitionBy("year", "month") if day else writer).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Text columns with '' as null; a schema spares a pass over the data."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def digest(df: DataFrame) -> DataFrame:
    """records and a digest of all rows that doesn't depend on their order or on files."""
    row = F.xxhash64(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in df.columns]))
    return df.agg(F.count("*").alias("records"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod(row, F.lit(1_000_000_007))), F.lit(0)).alias("sum"))


MISSING = ("", "-", "na", "null")


def amount(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(text, ",", ""))
    return F.when(~F.lower(plain).isin(*MISSING), plain.try_cast("double"))


def wide_report(spark: SparkSession, path: str) -> DataFrame:
    """A report with a title and a sub-header line, then columns "Price on 06 Oct, 2026" and "Arrival on ..." for each day: one row for each commodity and day.

    Only the header comes to the driver.
    """
    head = next((r.value for r in spark.read.text(path).filter(F.col("value").startswith("Commodity Group")).limit(1).collect()), None)
    if head is None:
        raise ValueError(f"{path} has no line that begins with Commodity Group")
    names = [f"c{k}" for k in range(len(_fields(head)))]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path)
    rows = rows.filter(F.col("c1").isNotNull() & (F.col("c1") != "Commodity"))
    days: dict[str, dict[str, str]] = {}
    msp = None
    for n, field in zip(names, _fields(head)):
        kind, _, day = field.strip().partition(" on ")
        if day and kind in ("Price", "Arrival"):
            days.setdefault(day, {})[kind] = n
        elif field.startswith("MSP"):
            msp = n
    cells = [F.struct(F.to_date(F.lit(d), "dd MMM, yyyy").alias("report_date"), *[(amount(F.col(c[k])) if k in c else F.lit(None).cast("double")).alias(n) for k, n in (("Price", "price"), ("Arrival", "arrivals"))]) for d, c in days.items()]
    return rows.select(F.col("c0").alias("commodity_group"), F.col("c1").alias("commodity"), (amount(F.col(msp)) if msp else F.lit(None).cast("double")).alias("msp"), F.explode(F.array(*cells)).alias("d")).select("commodity_group", "commodity", "msp", "d.*")


def _fields(line: str) -> list[str]:
    import csv

    return next(csv.reader([line]))


class Day(InputPartition):
    def __init__(self, value: str, most: int | None = None):
        self.value, self.most = value, most


class DailyReports(DataSource):
    """spark.read.format("daily_reports"): one partition for each day from "from" to "to" of a paged JSON API, newest day first.

    Options: url, from, to, page (records a page), day_field, and any "filter.<name>". A day's pages are asked for until one isn't full.
    A request that fails on the way or on the server's side is made again, "retries" times (3), after "pause" seconds (1) that double each time.
    With "max_records" a run stops after so many records, so the oldest ones are left out; planned_days says which.
    """

    @classmethod
    def name(cls) -> str:
        return "daily_reports"

    def schema(self) -> str:
        return ", ".join(f"{n} string" for n in REPORT)

    def reader(self, schema) -> DataSourceReader:
        return _DayReader(dict(self.options), [f.name for f in schema.fields])


#: Fields of a report, and those that name it.
REPORT = ("state", "district", "market", "commodity", "variety", "grade", "arrival_date", "min_price", "max_price", "modal_price")
NAMING, LONGEST_KEY = REPORT[:7], 200


def field_name(key: str) -> str:
    """A key in lower case, its words joined by _, whatever stands between them (_x0020_ is a space)."""
    return re.sub("[^a-z0-9]+", "_", key.lower().replace("_x0020_", "_")).strip("_")


def _answer(options: dict[str, str], day: str, offset: int, limit: int) -> dict:
    asked = {k[7:]: v for k, v in options.items() if k.startswith("filter.")}
    query = urllib.parse.urlencode({"limit": limit, "offset": offset, options.get("day_field", "arrival_date"): day, **asked})
    retries, pause = int(options.get("retries", "3")), float(options.get("pause", "1"))
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(f"{options['url']}?{query}", timeout=20) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as fault:
            if attempt == retries or (fault.code < 500 and fault.code != 429):
                raise
        except OSError:
            if attempt == retries:
                raise
        time.sleep(pause * 2**attempt)
    raise AssertionError


class PlannedDay(NamedTuple):
    day: date
    #: Records that the API has (None: not asked), and those that a run reads (None: all).
    total: int | None
    planned: int | None

    @property
    def partial(self) -> bool:
        return bool(self.planned) and self.planned < self.total

    @property
    def skipped(self) -> bool:
        return self.total is None and self.planned == 0


def planned_days(options: dict[str, str]) -> list[PlannedDay]:
    """What a run reads of each day, newest first. With max_records the totals of days are asked for, one small request each, until they suffice."""
    first, last = (date.fromisoformat(options[k]) for k in ("from", "to"))
    days = [last - timedelta(k) for k in range((last - first).days + 1)]
    if "max_records" not in options:
        return [PlannedDay(day, None, None) for day in days]
    out, left = [], int(options["max_records"])
    for day in days:
        if left <= 0:
            out.append(PlannedDay(day, None, 0))
            continue
        total = _answer(options, f"{day:%d/%m/%Y}", 0, 1).get("total")
        if total is None:
            raise ValueError("the API states no total, which max_records needs")
        out.append(PlannedDay(day, int(total), min(left, int(total))))
        left -= int(total)
    return out


class _DayReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fields: list[str]):
        self.options, self.fields = options, fields

    def partitions(self) -> list[InputPartition]:
        return [Day(f"{d.day:%d/%m/%Y}", d.planned) for d in planned_days(self.options) if d.planned != 0] or [Day("", 0)]

    def read(self, partition: Day) -> Iterator[tuple]:
        page, at = int(self.options.get("page", "100")), 0
        while partition.most is None or at < partition.most:
            limit = page if partition.most is None else min(page, partition.most - at)
            records = _answer(self.options, partition.value, at, limit)["records"]
            for record in records:
                plain = {field_name(k): v for k, v in record.items()}
                yield tuple(None if plain.get(f) is None else str(plain[f]) for f in self.fields)
            if len(records) < limit:
                return
            at += len(records)


def raw_records(reports: DataFrame, source: str = "DATA_GOV_IN", price_unit: str | None = None) -> DataFrame:
    """Reports as raw records of a source. The key of a record is made of the fields that name it; without a stated unit the usual one is assumed, and said to be."""
    key = F.substring(F.concat_ws("|", *[F.trim(F.coalesce(c, F.lit(""))) for c in NAMING]), 1, LONGEST_KEY)
    text = lambda x: F.lit(x).cast("string")
    return reports.select(
        F.lit(source).alias("source"), F.lit(False).alias("is_sample_data"), key.alias("source_record_key"), "state", "district", "market", "commodity", "variety", "grade",
        F.col("arrival_date").alias("price_date"), F.lit("DMY").alias("date_format"), "min_price", "max_price", "modal_price", F.lit(price_unit or "INR/quintal").alias("price_unit"),
        text(None).alias("arrivals_quantity"), text(None).alias("arrival_unit"), F.lit(price_unit is None).alias("price_unit_assumed"),
    )
