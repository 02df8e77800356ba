"""Stored models: a row for each series, horizon and version, and their scores in the JVM.

Linear models are weights over standardised features; trees are arrays in breadth-first order. Both act on log prices. A row to be
scored has its features as a map from name to value, so that a model needs no more than its own ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import boosting
from granary.operators.market import SERIES
from granary.operators.models import LEAST_ROWS, dealt, feature_rows, in_blocks, ridge
from granary.operators.series import CALENDAR, FEATURES, HORIZONS

MODEL = (
    "mandi_id long, commodity string, horizon int, model string, trained_rows long, trained_to date, columns array<string>, intercept double, "
    "mean array<double>, scale array<double>, weights array<double>, feature array<int>, threshold array<double>, value array<double>"
)
NODES, LEAVES = 2**boosting.DEPTH - 1, 2**boosting.DEPTH


def trained(series: DataFrame, horizons=HORIZONS, models: tuple[str, ...] = ("ridge", "gbm")) -> DataFrame:
    """A model of each kind for each series and horizon with LEAST_ROWS known targets, of all of them."""
    columns = [*FEATURES, *CALENDAR]

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in in_blocks(frames):
            out, grown = [], []
            for group in block:
                known = group[group["part"] != "latest"]
                if len(known) < LEAST_ROWS:
                    continue
                x, y = known[columns].to_numpy(float), np.log(known["target"].to_numpy(float))
                head = [*(known[c].iloc[0] for c in (*SERIES, "horizon"))]
                tail = [len(known), known["target_date"].max(), columns]
                if "ridge" in models:
                    w, mean, scale = ridge(x, y)
                    out.append([*head, "ridge", *tail, w[0], mean.tolist(), scale.tolist(), w[1:].tolist(), None, None, None])
                first = x[(known["part"] == "train").to_numpy()]
                if "gbm" in models and len(first) >= LEAST_ROWS:
                    bounds = boosting.edges(first)
                    grown.append((head, tail, bounds, boosting.codes(x, bounds), y))
            if grown:
                model = np.repeat(np.arange(len(grown)), [len(g[4]) for g in grown])
                trees = boosting.fit(model, np.concatenate([g[3] for g in grown]), np.concatenate([g[4] for g in grown]), len(grown))
                for k, (head, tail, bounds, _, _) in enumerate(grown):
                    feature, last = trees.feature[k].ravel(), trees.bin[k].ravel()
                    # no split, or one after the last bin, sends all to the left
                    threshold = np.where(last < len(bounds), bounds[np.minimum(last, len(bounds) - 1), feature], np.inf)
                    out.append([*head, "gbm", *tail, trees.base[k], None, None, None, feature.tolist(), threshold.tolist(), trees.value[k].ravel().tolist()])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    return dealt(feature_rows(series, horizons)).mapInPandas(blocks, MODEL)


def lag_models(rows: DataFrame) -> DataFrame:
    """Models of one feature (log_last), by least squares in one aggregate. rows: series, horizon, reported_date, actual and last_value (positive ones count)."""
    good = rows.filter("actual > 0 AND last_value > 0").withColumns({"y": F.ln("actual"), "x": F.ln("last_value")})
    fits = good.groupBy(*SERIES, "horizon").agg(
        F.count("*").alias("trained_rows"), F.max("reported_date").alias("trained_to"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")
    ).filter((F.col("trained_rows") >= LEAST_ROWS) & F.col("slope").isNotNull())
    none = F.lit(None).cast("array<double>")
    return fits.select(
        *SERIES, F.col("horizon").cast("int").alias("horizon"), F.lit("lag").alias("model"), "trained_rows", "trained_to", F.array(F.lit("log_last")).alias("columns"), "intercept",
        F.array(F.lit(0.0)).alias("mean"), F.array(F.lit(1.0)).alias("scale"), F.array("slope").alias("weights"), none.cast("array<int>").alias("feature"), none.alias("threshold"), none.alias("value"),
    )


def save(models: DataFrame, path: str, version: str) -> None:
    """Models of a version replace those stored under it; other versions stay."""
    out = models.withColumn("version", F.lit(version))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Stored models, with their version; given one, no other version's files are read."""
    out = spark.read.schema(f"{MODEL}, version string").option("basePath", path).parquet(path)
    return out if version is None else out.filter(F.col("version") == version)


def versions(models: DataFrame) -> DataFrame:
    return models.groupBy("version", "model").agg(F.count("*").alias("models"), F.count_distinct(*SERIES).alias("series"), F.max("trained_to").alias("trained_to"))


def log_score(values: Column) -> Column:
    """What the model of a row says of values (a map from feature to number): a weighted sum, or the sum of its trees."""
    x = F.transform("columns", lambda c: F.element_at(values, c))
    spread = F.zip_with(F.zip_with(x, "mean", lambda a, m: a - m), "scale", lambda a, s: a / s)
    linear = F.aggregate(F.zip_with(spread, "weights", lambda a, w: a * w), F.col("intercept"), lambda total, a: total + a)

    def child(tree: Column, node: Column) -> Column:
        at = tree * NODES + node
        return 2 * node + 1 + (F.get(x, F.get("feature", at)) > F.get("threshold", at)).cast("int")

    def leaf(tree: Column) -> Column:
        node = F.lit(0)
        for _ in range(boosting.DEPTH):
            node = child(tree, node)
        return F.get("value", tree * LEAVES + node - NODES)

    trees = F.aggregate(F.sequence(F.lit(0), (F.size("value") / LEAVES).cast("int") - 1), F.col("intercept"), lambda total, tree: total + leaf(tree))
    return F.when(F.col("weights").isNotNull(), linear).otherwise(trees)


def scored(models: DataFrame, rows: DataFrame) -> DataFrame:
    """The prices that stored models predict for rows (series, horizon, values and more)."""
    return models.join(rows, [*SERIES, "horizon"]).withColumn("predicted", F.exp(log_score(F.col("values"))))


def latest_rows(series: DataFrame, horizons=HORIZONS) -> DataFrame:
    """What models are asked after the last report: the features of each series and horizon as a map."""
    columns = [*FEATURES, *CALENDAR]
    rows = feature_rows(series, horizons).filter("part = 'latest'")
    values = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))
    return rows.select(*SERIES, "horizon", F.date_sub("reported_date", 1).alias("last_date"), F.expr("date_add(reported_date, horizon - 1)").alias("forecast_date"), values.alias("values"))
