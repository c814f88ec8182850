"""Health checks as rows (machine_id, name, level, message), for all machines at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatum.functions import derive
from estatum.operators import stats

# Names of checks, limits in hours and ratios.
DEFAULT_FAIL_ON = ("stale_scan", "broken_audit", "stash_overdue", "fp_not_ready")
TOKENS = (*DEFAULT_FAIL_ON, "rollup_stale", "dual_presence_poor", "mounts", "attached", "adapters")
STASH_HOURS = 7 * 24 + 24.0
ROLLUP_HOURS = 24.0
PRESENCE_RATIO = 0.5
WEEK, MONTH = 168.0, 720.0


def _row(df: DataFrame, name: str, level: Column, message: Column | None = None, keys: tuple[str, ...] = ("machine_id",)) -> DataFrame:
    return df.select(*keys, F.lit(name).alias("name"), level.alias("level"), (message if message is not None else F.lit("")).alias("message"))


def stale_scan(freshness: DataFrame, machines: DataFrame | None = None) -> DataFrame:
    """From scan_freshness; machines without any root fail as well."""
    stale = (F.col("level") == "fail") | F.col("finished_at").isNull()
    by = freshness.groupBy("machine_id").agg(F.count_if(stale).alias("stale"), F.count_if(F.col("unfinished_started_at").isNotNull()).alias("open"), F.count(F.lit(1)).alias("roots"))
    if machines is not None:
        by = machines.select("machine_id").distinct().join(by, "machine_id", "left").na.fill(0, ["stale", "open", "roots"])
    level = F.when(F.col("roots") == 0, "fail").when(F.col("stale") > 0, "fail").when(F.col("open") > 0, "warn").otherwise("ok")
    message = F.when(F.col("roots") == 0, F.lit("no finished scan of any root")).when(F.col("stale") > 0, F.concat(F.col("stale").cast("string"), F.lit(" stale or unfinished roots"))).when(F.col("open") > 0, F.concat(F.col("open").cast("string"), F.lit(" scans in progress"))).otherwise("")
    return _row(by, "stale_scan", level, message)


def broken_audit(chains: DataFrame, skipped: bool = False) -> DataFrame:
    level = F.lit("skipped") if skipped else F.when(F.col("ok").isNull(), "unknown").when(F.col("ok"), "ok").otherwise("fail")
    return _row(chains, "broken_audit", level, F.coalesce("message", F.lit("")))


def stash_overdue(summary: DataFrame, now: Column, limit: float = STASH_HOURS) -> DataFrame:
    """From stash.summary by machine."""
    age = derive.age_hours(F.col("oldest"), now)
    level = F.when(F.coalesce("in_flight", F.lit(0)) == 0, "ok").when(age.isNull(), "unknown").when(age > limit, "fail").otherwise("ok")
    return _row(summary, "stash_overdue", level)


def rollup_stale(rollups: DataFrame, now: Column, most: float = ROLLUP_HOURS) -> DataFrame:
    age = derive.age_hours(F.col("refreshed_at"), now)
    level = F.when(F.col("counts_source") == "live", "ok").when(F.col("counts_source") == "rollup", F.when(age > most, "fail").otherwise("ok")).otherwise("unknown")
    return _row(rollups, "rollup_stale", level)


def dual_presence_poor(counts: DataFrame, least: float = PRESENCE_RATIO) -> DataFrame:
    """From presence_counts by machine."""
    scored = F.col("dual") + F.col("store_only")
    nothing = F.when((F.col("mount_error") > 0) | (F.col("missing_store") == F.col("counted")), "warn").otherwise("unknown")
    level = F.when(F.coalesce("counted", F.lit(0)) == 0, "unknown").when(scored == 0, nothing).when(F.col("cloud_safe_ratio") < least, "fail").otherwise("ok")
    return _row(counts, "dual_presence_poor", level)


def adapter_freshness(audit: DataFrame, now: Column, most: float = WEEK) -> DataFrame:
    ends = audit.filter(F.col("action").isin("replicate_end", "archive_end")).groupBy("machine_id", "action").agg(F.max("timestamp").alias("last"))
    age = derive.age_hours(F.col("last"), now)
    return _row(ends, "adapters", F.when(age.isNull(), "unknown").when(age > most, "warn").otherwise("ok"), F.col("action"))


def attached_freshness(registry: DataFrame, now: Column, most: float = MONTH) -> DataFrame:
    imported, checked = (derive.age_hours(F.col(c), now) for c in ("imported_at", "chain_verified_at"))
    level = F.when(~F.col("payload_exists"), "fail").when(imported > most, "warn").when(checked.isNull() | (checked > most), "warn").otherwise("ok")
    return _row(registry, "attached", level)


def mount_reasons() -> Column:
    c = F.col
    return F.array_compact(F.array(F.when(~c("exists"), "missing"), F.when(c("error").isNotNull(), "error"), F.when(c("free_bytes") < 10 << 30, "low_free"), F.when((c("total_bytes") > 0) & (c("free_bytes") / c("total_bytes") < 0.05), "low_free_ratio"), F.when(c("latency_ms") > 2000, "high_latency")))


def mount_checks(probes: DataFrame) -> DataFrame:
    r = probes.withColumn("reasons", mount_reasons())
    missing = F.col("critical") & (F.array_contains("reasons", "missing") | F.array_contains("reasons", "error"))
    by = r.groupBy("machine_id").agg(F.count_if(missing).alias("gone"), F.count_if(F.size("reasons") > 0).alias("odd"))
    return _row(by, "mounts", F.when(F.col("gone") > 0, "fail").when(F.col("odd") > 0, "warn").otherwise("ok"))


def probe_roots(tiers: DataFrame, runs: DataFrame) -> DataFrame:
    """Tier prefixes (JSON array or comma list) and roots of finished scans."""
    text = F.col("path_prefixes")
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.transform(F.split(text, ","), F.trim))
    a = tiers.select(F.explode(listed).alias("root"), F.col("name").alias("tier")).filter("root <> ''")
    b = runs.filter("finished_at IS NOT NULL").select(F.col("root_path").alias("root"), derive.tier(F.concat("root_path", F.lit("/"))).alias("tier"))
    return a.union(b).distinct()


def cloud_gate(verdicts: DataFrame) -> DataFrame:
    """Verdicts (present, ready, problems) of machines."""
    n = F.coalesce(F.size("problems"), F.lit(0))
    level = F.when(~F.col("present"), "skipped").when(F.col("ready") & (n <= 0), "ok").when(~F.col("ready") | (n > 0), "fail").otherwise("unknown")
    return _row(verdicts, "fp_not_ready", level, F.array_join("problems", "; "))


def checks(frames: list[DataFrame]) -> DataFrame:
    return stats.union_all(frames)


def overall(all_checks: DataFrame) -> DataFrame:
    return all_checks.groupBy("machine_id").agg(derive.worst_level(F.col("level")).alias("overall"))


def fail_on(all_checks: DataFrame, tokens: tuple[str, ...] = DEFAULT_FAIL_ON) -> DataFrame:
    if unknown := set(tokens) - set(TOKENS):
        raise ValueError(f"unknown checks {sorted(unknown)}")
    return all_checks.filter(F.col("name").isin(*tokens) & (F.col("level") == "fail"))


def score(all_checks: DataFrame) -> DataFrame:
    level = F.col("level")
    loss = F.when(level == "fail", 35).when(level == "warn", 12).when(level == "unknown", 4).otherwise(0)
    return all_checks.groupBy("machine_id").agg(F.greatest(F.lit(0), 100 - F.sum(loss)).cast("int").alias("score"))


def report(machines: DataFrame, all_checks: DataFrame) -> DataFrame:
    """One row a machine: counts, worst level, score, the checks as a list."""
    rows = all_checks.groupBy("machine_id").agg(F.array_sort(F.collect_list(F.struct("name", "level", "message"))).alias("checks"))
    return machines.join(overall(all_checks), "machine_id", "left").join(score(all_checks), "machine_id", "left").join(rows, "machine_id", "left").withColumn("overall", F.coalesce("overall", F.lit("unknown")))


def compact_snapshot(reports: DataFrame) -> DataFrame:
    return reports.select("machine_id", "overall", "score", F.transform("checks", lambda c: F.struct(c["name"].alias("name"), c["level"].alias("level"))).alias("checks"))


def queues(plans: DataFrame, flying: DataFrame, jobs: DataFrame) -> DataFrame:
    """Open and blocked plans, stash runs in flight, overdue jobs."""
    open_ = plans.filter(F.col("status").isin("registered", "dry_run_ok", "dry_run_failed", "partially_applied")).select(F.lit("plan").alias("kind"), F.col("plan_id").alias("item"))
    blocked = plans.filter(F.size("blocked_reasons") > 0).select(F.lit("blocked").alias("kind"), F.col("plan_id").alias("item"))
    stash = flying.select(F.lit("stash").alias("kind"), F.col("manifest_run_id").alias("item"))
    late = jobs.filter("overdue").select(F.lit("job").alias("kind"), F.col("job").alias("item"))
    return stats.union_all([open_, blocked, stash, late])


def overdue_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Add ``overdue`` to jobs (job, period_hours, weekday, day, month, hour, minute,
    last_run_at).  Intervals: later than period plus grace.  Calendars: the first
    due time after the last run (or 14 days back) lies before now less grace.
    weekday: 0 is Sunday; fields that are null match always."""
    grace = F.when(F.col("period_hours").isNotNull(), F.when(F.col("period_hours") <= 24, 6.0).otherwise(24.0)).when(F.col("weekday").isNotNull(), 24.0).when(F.col("hour").isNotNull(), 6.0).otherwise(12.0)
    last = F.coalesce("last_run_at", now - F.make_interval(days=F.lit(14)))
    days = F.sequence(F.to_date(last), F.date_add(F.to_date(now), 1))
    fits = lambda d: (F.col("weekday").isNull() | (F.dayofweek(d) - 1 == F.col("weekday") % 7)) & (F.col("day").isNull() | (F.dayofmonth(d) == F.col("day"))) & (F.col("month").isNull() | (F.month(d) == F.col("month")))
    fires = F.transform(F.filter(days, fits), lambda d: d.cast("timestamp") + F.make_interval(hours=F.coalesce("hour", F.lit(0)), mins=F.coalesce("minute", F.lit(0))))
    next_fire = F.array_min(F.filter(fires, lambda t: t > last))
    hours = F.make_dt_interval(hours=grace.cast("int"))
    interval = F.coalesce((F.unix_micros(now) - F.unix_micros("last_run_at")) / 3.6e9 > F.col("period_hours") + grace, F.lit(True))
    known = F.col("period_hours").isNotNull() | F.coalesce("hour", "weekday", "day", "month").isNotNull()
    calendar = F.coalesce(next_fire < now - hours, F.lit(False))
    return jobs.withColumn("overdue", F.when(known, F.when(F.col("period_hours").isNotNull(), interval).otherwise(calendar)))


def job_level(jobs: DataFrame) -> DataFrame:
    c = F.col
    level = F.when(~c("installed"), "warn").when(F.coalesce(c("last_exit"), F.lit(0)) != 0, "fail").when(F.coalesce(c("overdue"), F.lit(False)), "warn").when(~c("loaded"), "warn").otherwise("ok")
    return jobs.withColumn("level", level)


# health of a fleet ----------------------------------------------------------


def fleet_matrix(summary: DataFrame, runs: DataFrame, chains: DataFrame, registry: DataFrame, local: str, now: Column) -> DataFrame:
    """One row a machine: counts, last finished scan, chain, envelope, levels;
    the local machine first.  Every input is summed by machine before it is joined."""
    scans = runs.filter("finished_at IS NOT NULL").groupBy("machine_id").agg(F.max("finished_at").alias("last_scan"))
    out = summary.join(scans, "machine_id", "left").join(chains.select("machine_id", F.col("ok").alias("chain_ok")), "machine_id", "left").join(registry, "machine_id", "left")
    out = out.withColumn("source", F.when(F.col("machine_id") == local, "local").otherwise("attached"))
    for c, t in (("scan_age", "last_scan"), ("envelope_age", "envelope_at"), ("chain_age", "chain_verified_at")):
        out = out.withColumn(c, derive.age_hours(F.col(t), now))
    return fleet_levels(out).orderBy(F.when(F.col("source") == "local", 0).otherwise(1), "machine_id")


def fleet_levels(rows: DataFrame) -> DataFrame:
    c, is_local = F.col, F.col("source") == "local"
    gone = ~is_local & ~F.coalesce("payload_exists", F.lit(False))
    scan = F.when(c("scan_age").isNull() | (c("scan_age") > WEEK), "fail").otherwise("ok")
    envelope = F.when(is_local, F.when(c("envelope_age").isNull(), "warn").when(c("envelope_age") > 192, "fail").otherwise("ok")).otherwise(F.when(gone | c("envelope_age").isNull() | (c("envelope_age") > MONTH), "fail").otherwise("ok"))
    chain = F.when(is_local, F.when(c("chain_ok").isNull(), "unknown").when(c("chain_ok"), "ok").otherwise("fail")).otherwise(F.when(gone | ~F.coalesce("chain_ok", F.lit(True)), "fail").when(c("chain_age").isNull() | (c("chain_age") > MONTH), "warn").otherwise("ok"))
    out = rows.withColumns({"scan_level": scan, "envelope_level": envelope, "chain_level": chain})
    worst = F.greatest(*[derive.level_rank(c(x)) for x in ("scan_level", "envelope_level", "chain_level")])
    return out.withColumn("level", F.element_at(F.array(F.lit("ok"), F.lit("unknown"), F.lit("warn"), F.lit("fail")), worst + 1))


def envelope_sla(matrix: DataFrame) -> DataFrame:
    away = F.col("source") == "attached"
    return matrix.agg(F.count_if(away).alias("attached"), F.count_if(away & (F.col("envelope_age") > MONTH)).alias("stale"), F.count_if(away & ~F.coalesce("payload_exists", F.lit(False))).alias("missing"), F.count_if(away & F.col("chain_verified_at").isNull()).alias("never_verified"), F.max(F.when(~away, F.col("envelope_level"))).alias("local_level"), derive.worst_level(F.col("envelope_level")).alias("worst"))


def fleet_checks(matrix: DataFrame) -> DataFrame:
    """Named checks over all machines with the machines concerned."""
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("machine_id"))))
    c = F.col
    tests = {"fleet_stale_scan": c("scan_level") == "fail", "fleet_chain_stale": c("chain_level").isin("warn", "fail"), "envelope_sla": c("envelope_level").isin("warn", "fail"), "attached_missing": (c("source") == "attached") & ~F.coalesce("payload_exists", F.lit(False))}
    wide = matrix.agg(*[F.struct(listed(t).alias("machines"), F.coalesce(F.max(F.when(t, derive.level_rank(c({"fleet_stale_scan": "scan_level", "fleet_chain_stale": "chain_level"}.get(n, "envelope_level"))))), F.lit(0)).alias("r")).alias(n) for n, t in tests.items()])
    long = wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, tests)), F.array(*tests))).alias("name", "v"))
    return long.select("name", F.when(F.col("v.r") == 3, "fail").when(F.col("v.r") == 2, "warn").otherwise("ok").alias("level"), F.array_join("v.machines", ",").alias("machines"))


def fleet_overall(matrix: DataFrame, checked: DataFrame) -> DataFrame:
    return matrix.select("level").unionByName(checked.select("level")).agg(derive.worst_level(F.col("level")).alias("overall"))


def fleet_fail_on(checked: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    return checked.filter(F.col("name").isin(*tokens) & (F.col("level") == "fail"))


def stale_ids(matrix: DataFrame) -> DataFrame:
    return matrix.filter(F.col("level").isin("warn", "fail")).select("machine_id", "level")
