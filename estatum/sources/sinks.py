"""Writing plans, buckets, logs, snapshots and health points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatum.operators import stats
from estatum.sources.files import COLUMNS, ESCAPES

LEFT_OUT = ("tiers", "embeddings", "legacy_import_log", "attached_inventories")


def write_manifest(rows: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """Tab-separated rows in as many parts as the plan has, and a head of one small part:
    marker, provenance (``#`` lines) and column names.  Read it with read_manifest; people
    read ``0-head`` and ``1-rows`` one behind the other.  Tabs, line ends and backslashes
    in values are escaped with a backslash, as is a # that a row would begin with."""
    clean = lambda c: reduce(lambda x, ab: F.replace(x, F.lit(ab[0]), F.lit(ab[1])), ESCAPES, F.coalesce(F.col(c).cast("string"), F.lit("")))
    text = F.regexp_replace(F.concat_ws("\t", *map(clean, COLUMNS)), "^#", r"\\#")
    head = ["# estatum-manifest-v1", *[f"# {k}: {v}" for k, v in provenance.items()], "\t".join(COLUMNS)]
    rows.select(text.alias("value")).write.text(f"{path}/1-rows")
    rows.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/0-head")


def write_buckets(rows: DataFrame, path: str) -> DataFrame:
    """One folder a presence kind, and the counts."""
    rows.write.partitionBy("kind").option("sep", "\t").option("header", "true").csv(f"{path}/buckets")
    counts = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.json(f"{path}/stats")
    return counts


def nas_rows(plan: DataFrame) -> DataFrame:
    clean = F.regexp_replace(F.coalesce("rationale", F.lit("")), "[\\t\\n]", " ")
    return plan.filter(F.col("action") == "nas_manifest").select("manifest_run_id", "permanode_id", "size_bytes", "source_path", "source_tier", clean.alias("rationale"))


def export_nas_manifest(plan: DataFrame, path: str) -> DataFrame:
    """Rows for the storage box; returns the log rows."""
    rows = nas_rows(plan)
    rows.write.partitionBy("manifest_run_id").option("sep", "\t").csv(path)
    return rows.select("manifest_run_id", "permanode_id", F.lit("nas_manifest_exported").alias("action"))


def export_audit(audit: DataFrame, after: Column | None = None, before: Column | None = None, actions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Log rows in [after, before), oldest first; write them with ``.write.json``."""
    out = audit
    if after is not None:
        out = out.filter(F.col("timestamp") >= after)
    if before is not None:
        out = out.filter(F.col("timestamp") < before)
    if actions:
        out = out.filter(F.col("action").isin(*actions))
    out = out.orderBy("id")
    return out.limit(limit) if limit else out


#: Options of the text that a row is hashed as: every field, times to the microsecond.
AS_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timeZone": "UTC"}


def content_hash(df: DataFrame) -> Column:
    """Aggregate that names a multiset of rows, whatever their order: how many, and the
    sums of four 64-bit parts of their SHA-256, so doubled rows count as often as they
    are there."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), AS_JSON), 256)
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *map(part, range(4))), 256)


def export_event(manifest: DataFrame) -> DataFrame:
    """The log row of an export: who, and the counts as payload."""
    return manifest.select("machine_id", F.lit("db_export_created").alias("action"), F.to_json(F.struct("claim_rows", "permanode_rows", "audit_rows", "payload_hash", "wire_format_version")).alias("payload"))


def export_snapshot(tables: dict[str, DataFrame], path: str, machine: str, with_embeddings: bool = False) -> DataFrame:
    """Tables as Parquet and a manifest row with counts and a payload hash; its log row
    is ``export_event``."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    rows, hashes = {}, []
    for name in sorted(tables):
        if name in LEFT_OUT and not (with_embeddings and name == "embeddings"):
            continue
        tables[name].withColumn("_machine", F.lit(machine)).write.mode("overwrite").partitionBy("_machine").parquet(f"{path}/{name}")
        r = tables[name].agg(F.count(F.lit(1)).alias("n"), content_hash(tables[name]).alias("h")).first()
        rows[name], _ = r.n, hashes.append(f"{name}={r.h}")
    out = spark.createDataFrame([(machine, 1, rows.get("claims", 0), rows.get("permanodes", 0), rows.get("audit_log", 0), ";".join(hashes))], "machine_id string, wire_format_version int, claim_rows long, permanode_rows long, audit_rows long, payload string")
    return out.withColumn("payload_hash", F.sha2("payload", 256)).drop("payload")


def detach(registry: DataFrame, machine: str) -> tuple[DataFrame, DataFrame]:
    """(registry without the machine, log rows)."""
    gone = registry.filter(F.col("machine_id") == machine)
    return registry.join(gone, "machine_id", "left_anti"), gone.select("machine_id", F.lit("inventory_detached").alias("action"))


def prune_series(points: DataFrame, now: Column, max_age_days: int = 90, max_lines: int = 5000, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """Points of a health series that stay: young ones, of these the newest; of one time
    those of the greatest ``ties`` (as far as the series has them)."""
    young = points.filter(F.col("generated_at") >= now - F.make_interval(days=F.lit(max_age_days)))
    order = [F.desc("generated_at"), *[F.desc(c) for c in ties if c in points.columns]]
    return stats.last_n_per_key(young, ["machine_id"], order, max_lines)


def append_health_snapshot(point: DataFrame, path: str) -> None:
    """Append a point to the series below ``path``, and make it LATEST."""
    point.write.mode("append").json(f"{path}/series")
    point.write.mode("overwrite").json(f"{path}/LATEST")
