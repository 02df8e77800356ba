"""Streams of reports: market-days, repeats within the late window, upserts with revisions, and alerts. Each runs over what is there and stops."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.numbers import rounded

#: Reports may be so late.
LATE = "3 days"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def reports(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """market (a user), commodity (an event type), price, time and whether it is a sample, of a folder or file of events."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    number = F.get_json_object("props", "$.k").cast("int")
    return raw.select(
        F.col("event_id").alias("report_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("market"),
        F.col("event_type").alias("commodity"),
        F.col("value").alias("price"),
        F.coalesce(number % 10 == 0, F.lit(False)).alias("is_sample"),
    )


def market_days(feed: DataFrame) -> DataFrame:
    """Reports, lowest and highest price and sum of each commodity and day (a tumbling window)."""
    cents = F.sum(F.floor(F.col("price") * 100 + 0.5))
    days = feed.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("w"), "commodity")
    return days.agg(F.count("*").alias("reports"), F.min("price").alias("lowest"), F.max("price").alias("highest"), cents.alias("cents")).select(F.col("w.start").cast("date").alias("day"), "commodity", "reports", "lowest", "highest", rounded(F.col("cents") / 100.0 / F.col("reports")).alias("mean"))


def distinct_reports(feed: DataFrame, *keys: str) -> DataFrame:
    """The first of equal keys within the late window; state older than that is dropped."""
    return feed.withWatermark("ts", LATE).dropDuplicatesWithinWatermark([*keys])


def run(out: DataFrame, folder: str, mode: str, each=None) -> None:
    """Work off what is there in micro-batches. each(batch, number) replaces the Parquet sink."""
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{folder}/out")
    writer.start().awaitTermination()


def whole_result(out: DataFrame, folder: str) -> DataFrame:
    """The final state of a complete-mode stream: each batch is written anew under its number, the last one is the result."""
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{folder}/batch{number}"
        batch.write.mode("overwrite").parquet(path)
        last[:] = [path]

    run(out, folder, "complete", keep)
    return out.sparkSession.read.parquet(last[0])


class Upserts:
    """A foreachBatch sink that keeps the newest price of each key and logs what it replaced.

    The state lies in buckets by key. A batch reads and writes only the buckets that it has keys of, as a new version of each; a manifest for
    each batch, written last, names every bucket's version. A batch that is run again starts from the manifest before it, so
    it gives the same state; versions that neither the last nor the last but one manifest names are removed.
    """

    VALUES = ("ts", "report_id", "price")

    def __init__(self, folder: str, keys: tuple[str, ...], buckets: int = 64):
        self.folder, self.keys, self.buckets, self.number = folder, keys, buckets, None

    def _path(self, spark: SparkSession, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self, spark: SparkSession, number: int) -> dict[int, int]:
        """The version of each bucket after a batch: as many entries as there are buckets."""
        path, fs = self._path(spark, f"manifest/{number}")
        if number < 0 or not fs.exists(path):
            return {}
        return {int(k): v for k, v in json.loads(spark.read.text(f"{self.folder}/manifest/{number}").first()[0]).items()}

    def _read(self, spark: SparkSession, versions: dict[int, int], schema: str) -> DataFrame:
        paths = [f"{self.folder}/state/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, known = batch.sparkSession, self.manifest(batch.sparkSession, number - 1)
        schema = ", ".join(f"{c} {batch.schema[c].dataType.simpleString()}" for c in (*self.keys, *self.VALUES))
        newest = batch.groupBy(*self.keys).agg(F.max(F.struct(*self.VALUES)).alias("n")).select(*self.keys, "n.*")
        touched = [r[0] for r in newest.select(self._bucket().alias("bucket")).distinct().collect()]  # as many as there are buckets at most
        old = self._read(spark, {b: known[b] for b in touched if b in known}, schema)
        old = old.select(*self.keys, *[F.col(c).alias(f"old_{c}") for c in self.VALUES])
        both = newest.join(old, [*self.keys], "full_outer").persist()
        later = F.col("ts").isNotNull() & (F.col("old_ts").isNull() | (F.struct("ts", "report_id") > F.struct("old_ts", "old_report_id")))
        pick = lambda c: F.when(later, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
        state = both.select(*self.keys, *map(pick, self.VALUES)).withColumn("bucket", self._bucket())
        state.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/state/version={number}")
        revised = both.filter(later & F.col("old_ts").isNotNull()).select(*self.keys, F.col("old_price").alias("previous_price"), "price", "ts")
        revised.write.mode("overwrite").parquet(f"{self.folder}/revisions/batch={number}")
        both.unpersist()
        new = known | dict.fromkeys(touched, number)
        spark.createDataFrame([(json.dumps(new),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/{number}")
        for b, v in self.manifest(spark, number - 2).items():
            if v not in (known.get(b), new.get(b)):
                path, fs = self._path(spark, f"state/version={v}/bucket={b}")
                fs.delete(path, True)
        self.number, self.schema = number, schema

    def state(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, self.manifest(spark, self.number), self.schema)

    def revisions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/revisions").drop("batch")


#: A report is judged so long after its time, so that what is late by LATE at most is known then.
WAIT = 3 * 24 * 3600 * 1_000_000
#: Reports of a series that are at most WAIT apart are one session (one whose start is another's end is joined to it), so nothing follows its last report within WAIT.
APART = f"{WAIT} microseconds"


def triggered(judged: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose condition a judged report fulfils while it is fresh: the end of its day is at most freshness_hours before it was judged."""
    price, day_end = F.col("price"), F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MILLISECOND")
    hit = F.when(F.col("condition") == "gte", price >= F.col("target")).otherwise(price <= F.col("target"))
    fresh = day_end + F.make_dt_interval(hours=F.col("freshness_hours")) >= F.col("judged")
    return judged.join(rules, ["market", "commodity"]).filter(hit & fresh).select("alert_id", "report_id", "price", "ts", "judged")


def alerts(feed: DataFrame, rules: DataFrame, folder: str, end: Column) -> DataFrame:
    """Each rule with each report that it fires on, once. rules: alert_id, market, commodity, target, condition and freshness_hours.

    Genuine reports (no samples, a positive price) are judged WAIT after their time, in event time, and those that are left when the feed
    ends, then (end). A report fires only if no newer one of its series came meanwhile, so neither the order of arrival nor the size of
    batches matters as long as nothing is later than LATE. These are the last reports of sessions, of which the state holds a row each. A series
    that is silent holds no state once its last report is judged.
    """
    spark = feed.sparkSession
    genuine = feed.filter(~F.col("is_sample") & (F.col("price") > 0)).withWatermark("ts", LATE)
    last = F.max(F.struct(F.unix_micros("ts").alias("us"), "report_id", "price")).alias("last")
    settled = genuine.groupBy(F.session_window("ts", APART), "market", "commodity").agg(last).select("market", "commodity", "last.*")
    timed = lambda df: df.select("market", "commodity", "report_id", "price", F.timestamp_micros("us").alias("ts"), F.timestamp_micros(F.col("us") + WAIT).alias("judged"))
    run(triggered(timed(settled), rules), folder, "append")
    left = timed(spark.read.format("statestore").load(f"{folder}/checkpoint").select("value.market", "value.commodity", "value.max.*"))
    fired = spark.read.schema("alert_id long, report_id long, price double, ts timestamp, judged timestamp").parquet(f"{folder}/out")
    return fired.unionByName(triggered(left.withColumn("judged", F.least("judged", end)), rules))
