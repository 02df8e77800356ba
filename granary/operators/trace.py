"""Can a stored record be made again from the raw one that it came from? Replay, differences and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.ingest import GENUINE, normalised, validated

COMPARED = (
    "source", "is_sample_data", "state", "district", "market", "mandi_code", "commodity_code", "variety", "grade", "price_date",
    "min_price", "max_price", "modal_price", "price_unit", "arrivals_quantity", "arrival_unit",
)


NUMBERS = ("min_price", "max_price", "modal_price", "arrivals_quantity")
KINDS = {"is_sample_data": "boolean", "price_date": "date", **dict.fromkeys(NUMBERS, "double")}
#: Between fields of a packed record, before what stands for another character, and in place of a null.
BETWEEN, ESCAPE, NULL = "\u001f", "\u001b", "\u001bN"


def packed() -> Column:
    """The compared fields of a record as one text, which takes half the bytes of a struct in a shuffle. Equal records have equal texts, and others haven't."""
    swap = lambda c, old, new: F.replace(c, F.lit(old), F.lit(new))
    typed = {f: F.col(f).cast(KINDS.get(f, "string")) for f in COMPARED}
    texts = [(c + F.lit(0.0)).cast("string") if f in NUMBERS else c.cast("string") if f in KINDS else swap(swap(c, ESCAPE, ESCAPE + "0"), BETWEEN, ESCAPE + "1") for f, c in typed.items()]  # 0 and -0 are equal
    return F.concat_ws(BETWEEN, *[F.coalesce(c, F.lit(NULL)) for c in texts])


def differences(stored: Column, replayed: Column) -> Column:
    """The fields in which two packed records differ, as an array of field, stored and replayed (both as text); nulls are equal to each other."""
    swap = lambda c, old, new: F.replace(c, F.lit(old), F.lit(new))
    plain = lambda c: F.when(c != NULL, swap(swap(c, ESCAPE + "1", BETWEEN), ESCAPE + "0", ESCAPE))
    fields = F.arrays_zip(F.array(*map(F.lit, COMPARED)).alias("field"), F.split(stored, BETWEEN, -1).alias("stored"), F.split(replayed, BETWEEN, -1).alias("replayed"))
    differ = F.filter(fields, lambda x: x["stored"] != x["replayed"])
    return F.when(stored == replayed, F.array().cast("array<struct<field: string, stored: string, replayed: string>>")).otherwise(
        F.transform(differ, lambda x: F.struct(x["field"].alias("field"), plain(x["stored"]).alias("stored"), plain(x["replayed"]).alias("replayed")))
    )


def traced(stored: DataFrame, raw: DataFrame, now: str, marker: str | None = None) -> DataFrame:
    """Each stored record (COMPARED, seq) with its stages, differences and verdict, by the raw record of its seq.

    Stages are PASS, FAIL or UNAVAILABLE: raw, normaliser, validator and stored. The verdict is SYNTHETIC_FIXTURE for raw records with a marker
    (a column), SAMPLE_ONLY for samples and other sources, FAIL or INCOMPLETE after the worst stage, else GENUINE_TRACE_PASS.
    """
    # What a verdict needs is told before the join, so that a caller that doesn't want the errors has none shuffled.
    again = validated(normalised(raw), now).select("seq", packed().alias("replayed"), "errors", (F.size("errors") == 0).alias("_valid"))
    if marker is not None:
        again = again.join(raw.select("seq", F.col(marker).alias("_marker")), "seq")
    genuine = F.coalesce(F.col("source").isin(*GENUINE), F.lit(False)) & ~F.coalesce(F.col("is_sample_data"), F.lit(False))
    rows = stored.select("seq", packed().alias("stored"), genuine.alias("_genuine")).join(again, "seq", "left")
    there = F.col("replayed").isNotNull()
    rows = rows.withColumn("differences", F.when(there, differences(F.col("stored"), F.col("replayed"))))
    stage = lambda good: F.when(~there, "UNAVAILABLE").when(good, "PASS").otherwise("FAIL")
    stages = F.struct(
        stage(F.lit(True)).alias("raw"), stage(F.lit(True)).alias("normaliser"), stage(F.col("_valid")).alias("validator"), stage(F.size("differences") == 0).alias("stored")
    )
    rows = rows.withColumn("stages", stages)
    any_stage = lambda what: F.array_contains(F.array(*[F.col("stages")[s] for s in ("raw", "normaliser", "validator", "stored")]), what)
    fixture = F.coalesce(F.col("_marker"), F.lit(False)) if marker is not None else F.lit(False)
    verdict = F.when(fixture, "SYNTHETIC_FIXTURE").when(~F.col("_genuine"), "SAMPLE_ONLY").when(any_stage("FAIL"), "FAIL").when(any_stage("UNAVAILABLE"), "INCOMPLETE").otherwise("GENUINE_TRACE_PASS")
    return rows.select("seq", "stages", "differences", "errors", verdict.alias("verdict"))
