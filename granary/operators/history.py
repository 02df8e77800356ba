"""Historical windows: read once, committed one by one, checked, and taken up where a run stopped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = "`from` date, `to` date, status string, records long, xor long, total long, run int, seal string"
SEALED = ("from", "to", "status", "records", "xor", "total", "run")


def seal() -> Column:
    """A digest of an entry's own fields: one that was changed or cut no longer fits."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in SEALED]), 256)


def digests(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """records, xor and total of each key's rows, whatever their order and files are."""
    row = F.xxhash64(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))
    return rows.groupBy(key).agg(F.count("*").alias("records"), F.bit_xor(row).alias("xor"), F.sum(F.pmod(row, F.lit(1_000_000_007))).alias("total"))


class History:
    """A folder with the rows of each window (data/window=day) and a manifest of sealed entries (manifest/run=number).

    A run writes whole windows first and their entries last, from what it reads back. So a run that is cut off leaves windows without an
    entry, and these are pending again, as are windows whose rows or entry were tampered with.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.columns = spark.createDataFrame([], schema).columns

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def entries(self) -> DataFrame:
        """The last entry of each window whose seal fits."""
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/manifest").filter(F.col("seal") == seal())
        last = F.row_number().over(Window.partitionBy("from", "to").orderBy(F.desc("run")))
        return rows.withColumn("_k", last).filter("_k = 1").drop("_k")

    def rows(self) -> DataFrame:
        """All windows' rows, with the window's first day as window."""
        if not self._exists("data"):
            return self.spark.createDataFrame([], f"{self.schema}, window date")
        return self.spark.read.schema(f"{self.schema}, window date").option("basePath", f"{self.folder}/data").parquet(f"{self.folder}/data")

    def verified(self) -> DataFrame:
        """Complete entries that agree with the rows that are there now."""
        done = self.entries().filter("status = 'complete'")
        found = digests(self.rows(), self.columns, "window").select(F.col("window").alias("from"), *[F.col(c).alias(f"_{c}") for c in ("records", "xor", "total")])
        same = [F.col(c).eqNullSafe(F.coalesce(f"_{c}", F.lit(0).cast("long"))) for c in ("records", "xor", "total")]
        return done.join(found, "from", "left").filter(same[0] & same[1] & same[2]).select(*done.columns)

    def pending(self, planned: DataFrame) -> DataFrame:
        return planned.join(self.verified().select("from", "to"), ["from", "to"], "left_anti")

    def run(self, rows: DataFrame, planned: DataFrame, day: str, most_rows: int | None = None) -> DataFrame:
        """Write the pending windows, in order, until one would begin after most_rows rows; the entries of this run.

        planned: from and to of windows that don't overlap; rows outside of them are not touched. There are as many windows as the calendar
        allows, so they are broadcast and ordered in one place; rows are only counted, written and read back by all tasks.
        """
        number = (self.entries().agg(F.max("run")).first()[0] or 0) + 1
        todo = self.pending(planned)
        todo = self.spark.createDataFrame(todo.collect(), todo.schema)  # so that what is there is read and checked once
        days = F.broadcast(todo.select(F.col("from").alias("window"), F.explode(F.sequence("from", "to")).alias("_day")))
        tag = lambda windows: self._between(rows.select(*self.columns), windows, day).join(days, F.col(day) == F.col("_day")).drop("_day")
        tagged = tag(todo)
        counts = tagged.groupBy(F.col("window").alias("from")).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy("from").rowsBetween(Window.unboundedPreceding, -1))
        ordered = todo.join(counts, "from", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("before", F.coalesce(before, F.lit(0)))
        plan = f"{self.folder}/plan/run={number}"
        (ordered if most_rows is None else ordered.filter(F.col("before") < most_rows)).write.mode("overwrite").parquet(plan)
        chosen = self.spark.read.parquet(plan)
        some = tag(chosen).join(F.broadcast(chosen.filter("n > 0").select(F.col("from").alias("window"))), "window", "left_semi")
        self._clear(chosen.filter("n = 0"))
        out = some.select(*self.columns, "window").hint("rebalance", "window").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("window").parquet(f"{self.folder}/data")
        read = digests(self.rows().join(F.broadcast(chosen.select(F.col("from").alias("window"))), "window", "left_semi"), self.columns, "window")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        made = chosen.select("from", "to").join(read.withColumnRenamed("window", "from"), "from", "left")
        made = made.select("from", "to", F.lit("complete").alias("status"), zero("records"), zero("xor"), zero("total"), F.lit(number).alias("run")).withColumn("seal", seal())
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/run={number}")
        return self.spark.read.schema(ENTRY).parquet(f"{self.folder}/manifest/run={number}")

    @staticmethod
    def _between(rows: DataFrame, windows: DataFrame, day: str) -> DataFrame:
        """Rows from the first to the last day of some windows: a plain filter, which goes below what rows are joined of, unlike the windows' days."""
        a, b = windows.agg(F.min("from"), F.max("to")).first()
        return rows.filter(F.col(day).between(F.lit(a), F.lit(b)))

    def _clear(self, windows: DataFrame) -> None:
        """Windows without rows keep none of an earlier run."""
        for r in windows.select(F.col("from").cast("string").alias("w")).collect():  # as many as the calendar allows
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/window={r.w}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
