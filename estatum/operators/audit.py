"""Tamper-evident logs: chains of row hashes, one a machine."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from estatum.functions import derive
from estatum.scratch import scratch, stored

GENESIS = "0" * 64
FIELDS = ["action", "actor", "manifest_run_id", "payload", "permanode_id", "timestamp"]


def payload_of(columns: list[str] = FIELDS):
    return derive.canonical_audit_json(columns)


def _checked(audit: DataFrame, columns: list[str]) -> DataFrame:
    """Row-local part of the check."""
    return audit.withColumn("_hash_ok", F.coalesce(F.col("row_hash") == derive.audit_row_hash(F.col("prev_hash"), payload_of(columns)), F.lit(False)))


#: Rows of a chain that one task checks or chains, about; ranges that a chain is cut into
#: at most.
ROWS, RANGES = 1_000_000, 1000


def _ranged(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``rows`` with the ``_part`` of its chain that each belongs to: chains of more than
    ``most`` rows are cut into ranges of ids of about so many rows each (by percentiles of
    the chain's own ids), others are one part."""
    at = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    named = [F.col(k).alias(f"_{k}") for k in keys]
    long = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*named, "_n")
    # a cut for so many rows of the whole log, so both sides are small
    step = F.ceil(RANGES / F.ceil(F.first("_n") / most)).cast("int")
    quantiles = F.percentile_approx("id", [i / RANGES for i in range(1, RANGES)], 10_000)
    cuts = rows.select(*keys, "id").join(F.broadcast(long), at).groupBy(*[f"_{k}" for k in keys]).agg(F.filter(quantiles, lambda c, i: (i + 1) % step == 0).alias("_cuts"))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("id"))), F.lit(0))
    return rows.join(F.broadcast(cuts), at, "left").withColumn("_part", part).drop("_cuts", *[f"_{k}" for k in keys])


def verify_chain(audit: DataFrame, columns: list[str] = FIELDS, keys: list[str] = ["machine_id"], rows: int = ROWS) -> DataFrame:  # noqa: B006
    """Per chain: ok, rows_checked up to the first failure, its id and message.

    Chains of more than ``rows`` are cut into ranges of ids, so no machine's log is one
    task's; links are checked within ranges, and the edges of a chain's ranges against
    each other."""
    ranged = _ranged(_checked(audit, columns).select(*keys, "id", "prev_hash", "row_hash", "_hash_ok"), keys, rows)
    inside = Window.partitionBy(*keys, "_part").orderBy("id")
    linked = ranged.withColumns({"_before": F.lag("row_hash").over(inside), "_rn": F.row_number().over(inside)})
    torn = (F.col("_rn") > 1) & ~F.coalesce(F.col("prev_hash") == F.col("_before"), F.lit(False))
    bad = torn | ~F.col("_hash_ok")
    why = F.when(torn, "prev_hash mismatch").otherwise("row_hash mismatch")
    first_bad = F.min_by(F.when(bad, F.struct("id", F.col("_rn").cast("long").alias("rn"), why.alias("why"))), F.when(bad, F.col("id")))
    parts = linked.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("id").alias("_first"), F.min_by("prev_hash", "id").alias("_head"), F.max_by("row_hash", "id").alias("_tip"), first_bad.alias("_bad"))
    order = Window.partitionBy(*keys).orderBy("_part")
    skip = F.coalesce(F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = F.coalesce(F.col("_head") == F.coalesce(F.lag("_tip").over(order), F.lit(GENESIS)), F.lit(False))
    edges = parts.select(*keys, "_rows", skip.alias("_skip"), F.when(~met, F.struct(F.col("_first").alias("id"), F.lit(1).cast("long").alias("rn"), F.lit("prev_hash mismatch").alias("why"))).otherwise(F.col("_bad")).alias("_bad"))
    out = edges.groupBy(*keys).agg(F.sum("_rows").alias("_all"), F.min_by(F.when(F.col("_bad").isNotNull(), F.struct("_bad", "_skip")), F.when(F.col("_bad").isNotNull(), F.col("_skip"))).alias("e"))
    return out.select(*keys, F.col("e").isNull().alias("ok"), F.coalesce(F.col("e._skip") + F.col("e._bad.rn") - 1, F.col("_all")).cast("long").alias("rows_checked"), F.col("e._bad.id").alias("bad_id"), F.col("e._bad.why").alias("message"))


def verify_long_chain(audit: DataFrame, parts: int | None = None, columns: list[str] = FIELDS) -> DataFrame:
    """One chain without a key, in ``parts`` ranges, or more where these would be of more
    than a million rows."""
    rows = min(ROWS, max(1, audit.count() // parts)) if parts else ROWS
    return verify_chain(audit.withColumn("chain", F.lit("one")), columns, ["chain"], rows)


#: Text that a row is hashed as.
body_of = json.JSONEncoder(sort_keys=True, separators=(",", ":")).encode


def row_hash(prev: str, row: dict) -> str:
    return hashlib.sha256((prev + body_of(row)).encode()).hexdigest()


def append_batch(audit: DataFrame, rows: DataFrame, columns: list[str] = FIELDS, most: int = ROWS) -> DataFrame:
    """New rows (machine_id, id and ``columns``) chained behind each machine's tip.
    A chain is sequential; machines run in parallel.  A machine's rows stream through
    a task in order of id, and only the last hash is kept.  Column values are strings.

    Where a machine has more than ``most`` new rows, the batch is chained in rounds, each a
    job over the machines' next ranges of about so many rows: what a task sorts doesn't
    grow with the batch.  The rounds are run and written at once, in the scratch folder."""
    tips = audit.groupBy("machine_id").agg(F.max_by("row_hash", "id").alias("_tip"))
    bodies = _bodies(rows, columns)
    sizes = rows.groupBy("machine_id").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if (sizes.most or 0) <= most:
        return _chain(bodies, tips, columns)
    spark, tips = rows.sparkSession, stored(tips, "tips")
    ranges, chained = scratch(spark, "ranges"), scratch(spark, "chained")
    ranged = _ranged(stored(bodies, "bodies"), ["machine_id"], most)
    ranged.repartitionByRange(1 + sizes.all // most, "_part", "id").write.partitionBy("_part").parquet(ranges)
    schema, turns = _chain(bodies, tips, columns).schema, sorted(r[0] for r in spark.read.parquet(ranges).select("_part").distinct().collect())
    for turn in turns:
        part = spark.read.schema(bodies.schema).parquet(f"{ranges}/_part={turn}")
        _chain(part, tips, columns).write.parquet(f"{chained}/turn={turn}")
        done = spark.read.schema(schema).parquet(f"{chained}/turn={turn}").groupBy(F.col("machine_id").alias("_m")).agg(F.max_by("row_hash", "id").alias("_new"))
        # a machine without rows in a range keeps its tip
        both = tips.join(done, F.col("machine_id").eqNullSafe(F.col("_m")), "full_outer")
        tips = stored(both.select(F.when(F.col("_new").isNull(), F.col("machine_id")).otherwise(F.col("_m")).alias("machine_id"), F.coalesce("_new", "_tip").alias("_tip")), "tips")
    return spark.read.schema(schema).parquet(*[f"{chained}/turn={t}" for t in turns])


def _bodies(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the text that each is hashed as."""
    keys = sorted(columns)

    def write(frames):
        for f in frames:
            values = zip(*[f[k].astype(object).where(f[k].notna(), None) for k in keys], strict=True)
            yield f.assign(_body=[body_of(dict(zip(keys, v, strict=True))) for v in values])

    new = rows.select("machine_id", "id", *columns)
    return new.mapInPandas(write, T.StructType([*new.schema, T.StructField("_body", T.StringType())]))


def _chain(bodies: DataFrame, tips: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with their ``_body``, chained behind their machine's ``_tip``."""
    known = tips.select(F.col("machine_id").alias("_m"), "_tip")
    todo = bodies.join(known, F.col("machine_id").eqNullSafe(F.col("_m")), "left").drop("_m").withColumn("_tip", F.coalesce("_tip", F.lit(GENESIS)))
    schema = bodies.drop("_body").schema.add("prev_hash", "string").add("row_hash", "string")

    def chain(frames):
        machine, prev = None, None
        for f in frames:
            before, after = [], []
            for m, tip, body in zip(f["machine_id"], f["_tip"], f["_body"], strict=True):
                machine, prev = m, prev if prev is not None and m == machine else tip
                before.append(prev)
                prev = hashlib.sha256((prev + body).encode()).hexdigest()
                after.append(prev)
            yield f[["machine_id", "id", *columns]].assign(prev_hash=before, row_hash=after)

    return todo.repartition("machine_id").sortWithinPartitions("machine_id", "id").mapInPandas(chain, schema)


def resolve_before(audit: DataFrame, before) -> DataFrame:
    return audit.filter(F.col("timestamp") < before).agg(F.max("id").alias("through_id"))


def plan_segment(audit: DataFrame, through_id: int, hot_min_rows: int = 100) -> DataFrame:
    """Bounds and tips of the rows up to ``through_id``, and whether they may be
    sealed: not empty, no gap, enough rows left."""
    cold = audit.filter(F.col("id") <= through_id).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("row_count"), F.max_by("row_hash", "id").alias("tip_hash"), F.min_by("prev_hash", "id").alias("first_prev_hash"))
    hot = audit.filter(F.col("id") > through_id).agg(F.count(F.lit(1)).alias("hot_rows"))
    reason = F.when(F.col("row_count") == 0, "empty").when(F.col("row_count") != F.col("last_id") - F.col("first_id") + 1, "gap in ids").when(F.col("hot_rows") < hot_min_rows, "too few rows left hot")
    return cold.crossJoin(hot).withColumn("refused", reason)


def seal_segment(audit: DataFrame, plan: DataFrame, segment_id: str, path: str) -> DataFrame:
    """Write the rows of a plan that isn't refused; returns the registry row."""
    p = plan.first()
    if p.refused:
        raise ValueError(p.refused)
    audit.filter(F.col("id").between(p.first_id, p.last_id)).withColumn("segment_id", F.lit(segment_id)).write.mode("append").partitionBy("segment_id").parquet(path)
    return plan.select(F.lit(segment_id).alias("segment_id"), "first_id", "last_id", "row_count", "first_prev_hash", "tip_hash")


def verify_segments(segments: DataFrame, registry: DataFrame, columns: list[str] = FIELDS, most: int = ROWS) -> DataFrame:
    """Each sealed segment against its registry row: ids, links, hashes, tip, and
    its first link against the tip of the segment before.  Segments of more than ``most``
    rows are checked in ranges of ids, and the edges of these against each other."""
    ranged = _ranged(_checked(segments, columns).select("segment_id", "id", "prev_hash", "row_hash", "_hash_ok"), ["segment_id"], most)
    inside = Window.partitionBy("segment_id", "_part").orderBy("id")
    rows = ranged.withColumns({"_before": F.lag("row_hash").over(inside), "_id": F.lag("id").over(inside)})
    linked = F.coalesce(F.col("prev_hash") == F.col("_before"), F.col("_before").isNull())
    follows = F.coalesce(F.col("id") == F.col("_id") + 1, F.lit(True))
    parts = rows.groupBy("segment_id", "_part").agg(F.bool_and("_hash_ok").alias("hashes_ok"), F.bool_and(linked).alias("links_ok"), F.bool_and(follows).alias("ids_ok"), F.min("id").alias("_first"), F.max("id").alias("_last"), F.max_by("row_hash", "id").alias("tip"), F.min_by("prev_hash", "id").alias("head"))
    order = Window.partitionBy("segment_id").orderBy("_part")
    edges = parts.withColumns({"_before": F.lag("tip").over(order), "_id": F.lag("_last").over(order)})
    linked = F.coalesce(F.col("head") == F.col("_before"), F.col("_before").isNull())
    follows = F.coalesce(F.col("_first") == F.col("_id") + 1, F.lit(True))
    inner = edges.groupBy("segment_id").agg(F.bool_and("hashes_ok").alias("hashes_ok"), F.bool_and(F.col("links_ok") & linked).alias("links_ok"), F.bool_and(F.col("ids_ok") & follows).alias("ids_ok"), F.max_by("tip", "_part").alias("tip"), F.min_by("head", "_part").alias("head"))
    before = registry.withColumn("_prior", F.lag("tip_hash").over(Window.orderBy("first_id")))
    out = before.join(inner, "segment_id", "left")
    ok = F.col("hashes_ok") & F.col("links_ok") & F.col("ids_ok") & (F.col("tip") == F.col("tip_hash")) & (F.col("head") == F.col("first_prev_hash")) & (F.col("_prior").isNull() | (F.col("_prior") == F.col("head")))
    return out.select("segment_id", F.coalesce(ok, F.lit(False)).alias("ok"))


def verify_attached(registry: DataFrame, audits: DataFrame, now, columns: list[str] = FIELDS) -> DataFrame:
    """Chains of all admitted inventories; the time of the last good check moves on
    success only, and a missing payload is not ok."""
    out = registry.join(verify_chain(audits, columns), "machine_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return out.withColumn("chain_verified_at", F.coalesce(F.when(F.col("ok"), now), F.col("chain_verified_at")))
