"""The stash: what was moved aside and not yet finalized or restored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatum.functions import derive
from estatum.operators import joins

LIFE = ("stash_committed", "stash_finalized", "stash_restored")


def entries(audit: DataFrame) -> DataFrame:
    """(machine_id, manifest_run_id, source, ...) whose last event is the commit.
    Rows without run or source, or with a payload that isn't JSON, do not count."""
    rows = audit.filter(F.col("action").isin(*LIFE)).withColumn("source", F.get_json_object("payload", "$.source")).filter("source IS NOT NULL AND manifest_run_id IS NOT NULL")
    last = rows.groupBy("machine_id", "manifest_run_id", "source").agg(F.max_by(F.struct("id", "action", "timestamp", "permanode_id", F.get_json_object("payload", "$.destination").alias("destination")), "id").alias("e"))
    return last.filter(F.col("e.action") == "stash_committed").select("machine_id", "manifest_run_id", "source", "e.id", "e.timestamp", "e.permanode_id", "e.destination")


def in_flight(audit: DataFrame, now: Column) -> DataFrame:
    return entries(audit).groupBy("manifest_run_id").agg(F.count(F.lit(1)).alias("entries"), F.max(derive.age_hours(F.col("timestamp"), now)).alias("oldest_age_hours"))


def summary(audit: DataFrame, by: list[str] | None = None) -> DataFrame:
    return entries(audit).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("in_flight"), F.count_distinct("manifest_run_id").alias("runs"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def due(audit: DataFrame, now: Column, cooling_off_days: int = 7, force: bool = False) -> DataFrame:
    ready = F.lit(True) if force else F.coalesce(derive.age_hours(F.col("timestamp"), now) >= 24 * cooling_off_days, F.lit(False))
    return entries(audit).withColumn("state", F.when(ready, "due").otherwise("skipped_young"))


def _there(df: DataFrame, files: DataFrame, column: str, flag: str) -> DataFrame:
    there = files.select(F.col("path").alias(column), F.lit(True).alias(flag)).distinct()
    return df.join(there, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def restorable(flying: DataFrame, files: DataFrame) -> DataFrame:
    out = _there(_there(flying, files, "source", "_s"), files, "destination", "_d")
    return out.withColumn("state", F.when(~F.col("_d"), "errored").when(F.col("_s"), "skipped_occupied").otherwise("restored")).drop("_s", "_d")


def verify(flying: DataFrame, files: DataFrame, claims: DataFrame, exclude: list[str]) -> DataFrame:
    out = _there(_there(flying, files, "source", "_s"), files, "destination", "_d")
    out = joins.canonical_outside(out, claims, exclude) if exclude else joins.canonical_outside(out, claims, ["/_none"])
    state = F.when(~F.col("_d"), "dst-missing").when(F.col("_s"), "src-still-present").when(F.col("permanode_id").isNull(), "no-permanode").when(F.col("canonical_path").isNull(), "no-canonical-elsewhere").otherwise("ok")
    return out.withColumn("state", state).drop("_s", "_d")
