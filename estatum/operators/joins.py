"""Lookups and joins over claims, permanodes, runs and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatum.functions import derive
from estatum.operators import stats


def current_claims(claims: DataFrame, permanodes: DataFrame, with_members: bool = False) -> DataFrame:
    """Current claims with their hash; archive members only on request."""
    rows = stats.current(claims)
    rows = rows if with_members else rows.filter("container_path IS NULL")
    return rows.join(permanodes.select("permanode_id", "canonical_hash"), "permanode_id")


def inspect(targets: DataFrame, permanodes: DataFrame, hashes: DataFrame, claims: DataFrame) -> DataFrame:
    """For each target its permanode: by id, else hash, else any other hash, else
    path (current first, newest id)."""
    t = targets.select("target").distinct()
    found = [
        t.join(permanodes, F.col("target") == F.col("permanode_id")).select("target", F.lit(1).alias("how"), F.lit(0).alias("o"), "permanode_id"),
        t.join(permanodes, F.col("target") == F.col("canonical_hash")).select("target", F.lit(2).alias("how"), F.lit(0).alias("o"), "permanode_id"),
        t.join(hashes, F.col("target") == F.col("hex")).select("target", F.lit(3).alias("how"), F.lit(0).alias("o"), "permanode_id"),
        t.join(claims, F.col("target") == F.col("file_path")).select("target", F.lit(4).alias("how"), (F.when(F.col("is_current"), 0).otherwise(1) * (1 << 60) - F.col("claim_id")).alias("o"), "permanode_id"),
    ]
    return stats.latest_per_key(stats.union_all(found), ["target"], [F.asc("how"), F.asc("o"), F.asc("permanode_id")]).drop("o")


def get_permanode(ids: DataFrame, permanodes: DataFrame, claims: DataFrame, audit: DataFrame, n: int = 20) -> DataFrame:
    """Heads of the given permanodes with their last ``n`` log rows, a row a claim (or
    one without, where there is none): order by observed_at and claim_id to list them.
    A very common content is many rows, not one long one."""
    own = claims.join(ids, "permanode_id", "left_semi").select("permanode_id", "claim_id", "observed_at", "machine_id", "file_path", "is_current")
    rows = stats.last_n_per_key(audit.join(ids, "permanode_id", "left_semi"), ["permanode_id"], [F.desc("id")], n).groupBy("permanode_id").agg(F.reverse(F.array_sort(F.collect_list("id"))).alias("audit_ids"))
    heads = permanodes.join(ids, "permanode_id", "left_semi").join(rows, "permanode_id", "left")
    return heads.join(own, "permanode_id", "left")


def claims_of(claims: DataFrame, permanode: str) -> DataFrame:
    return claims.filter(F.col("permanode_id") == permanode).orderBy(F.desc("observed_at"), F.desc("claim_id"))


def filter_machine(claims: DataFrame, prefix: str) -> DataFrame:
    return claims.filter(F.col("machine_id").startswith(prefix))


def has_current_claim(permanodes: DataFrame, claims: DataFrame) -> DataFrame:
    return permanodes.join(stats.current(claims), "permanode_id", "left_semi")


def canonical_claim(claims: DataFrame) -> DataFrame:
    """One current claim a permanode: best tier, then lowest id.  An aggregate with partial
    sums, so a very common content is no one task's."""
    order = F.struct(derive.tier_priority(F.col("tier")).alias("p"), "claim_id")
    best = F.min_by(F.struct(*[c for c in claims.columns if c != "permanode_id"]), order)
    return stats.current(claims).groupBy("permanode_id").agg(best.alias("_c")).select("permanode_id", "_c.*").select(*claims.columns)


def not_embedded(permanodes: DataFrame, claims: DataFrame, embeddings: DataFrame, model: str, version: str, limit: int | None = None, again: bool = False) -> DataFrame:
    """Permanodes without a vector of (model, version), with their canonical claim."""
    todo = permanodes.select("permanode_id")
    if not again:
        done = embeddings.filter((F.col("model_name") == model) & (F.col("model_version") == version))
        todo = todo.join(done, "permanode_id", "left_anti")
    out = canonical_claim(claims).join(todo, "permanode_id", "left_semi").orderBy("permanode_id")
    return out.limit(limit) if limit else out


def preflight(plan: DataFrame, local: DataFrame, attached: DataFrame) -> DataFrame:
    """Plan rows whose content has no current local claim but is known to another
    inventory: the first in registry order is named.  These are refused."""
    absent = plan.join(stats.current(local), "permanode_id", "left_anti")
    elsewhere = attached.select("permanode_id", "registry_order", "attached_machine_id").distinct()
    keys = [c for c in plan.columns]
    return stats.latest_per_key(absent.join(elsewhere, "permanode_id"), keys, [F.asc("registry_order")])


def other_copies(plan: DataFrame, claims: DataFrame, home: str, first: int = 5) -> DataFrame:
    """Current claims of a row's content outside the row's own path forms: how many, and
    the ``first`` paths in order.  Counted a content, less what lies at the row's own
    forms, so a content of very many copies is met once a row, not once a copy."""
    rows = plan.select("row_id", "permanode_id", derive.path_aliases(F.col("source_path"), home).alias("aliases"))
    at = stats.current(claims).groupBy("permanode_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    total = at.groupBy("permanode_id").agg(F.sum("n").alias("total"))
    forms = rows.select("row_id", "permanode_id", F.explode("aliases").alias("file_path"))
    own = forms.join(at, ["permanode_id", "file_path"]).groupBy("row_id").agg(F.sum("n").alias("own"))
    # a row has four path forms at most, so among so many more paths are its first ones
    few = stats.last_n_per_key(at, ["permanode_id"], [F.asc("file_path")], first + 4).groupBy("permanode_id").agg(F.array_sort(F.collect_list(F.struct("file_path", "n"))).alias("few"))
    out = rows.join(own, "row_id", "left").join(total.join(few, "permanode_id"), "permanode_id", "left")
    copies = F.coalesce(F.col("total") - F.coalesce("own", F.lit(0)), F.lit(0))
    others = F.filter("few", lambda x: ~F.array_contains("aliases", x["file_path"]))
    paths = F.slice(F.flatten(F.transform(others, lambda x: F.array_repeat(x["file_path"], F.least(x["n"], F.lit(first)).cast("int")))), 1, first)
    return out.select("row_id", "permanode_id", copies.alias("copies"), F.when(copies > 0, paths).alias("paths"), (copies == 0).alias("last_copy"))


def canonical_outside(entries: DataFrame, claims: DataFrame, prefixes: list[str]) -> DataFrame:
    """Least current path of each entry's content outside all prefixes."""
    inside = derive.any_of([derive.under_prefix(F.col("file_path"), p) for p in prefixes])
    out = stats.current(claims).filter(~inside).join(entries.select("permanode_id").distinct(), "permanode_id", "left_semi")
    return entries.join(out.groupBy("permanode_id").agg(F.min("file_path").alias("canonical_path")), "permanode_id", "left")


def presence(claims: DataFrame, store: DataFrame, mount: DataFrame, home: str, **roots) -> DataFrame:
    """Presence kind of each claim by two listings (relative, and for the mount
    an optional error flag)."""
    mapped = claims.withColumn("m", derive.map_store_mount(F.col("file_path"), home, **roots))
    s = store.select(F.col("relative").alias("_s")).distinct()
    err = F.bool_or("error") if "error" in mount.columns else F.lit(False)
    m = mount.groupBy(F.col("relative").alias("_m")).agg(err.alias("_err"))
    joined = mapped.join(s, F.col("m.relative") == F.col("_s"), "left").join(m, F.col("m.relative") == F.col("_m"), "left")
    in_store, in_mount = F.col("_s").isNotNull(), F.col("_m").isNotNull()
    kind = F.when(F.col("m.kind") != "unknown", F.col("m.kind")).when(F.coalesce("_err", F.lit(False)), "mount_error").when(in_store & in_mount, "dual").when(in_store, "store_only").when(in_mount, "mount_only").otherwise("missing_store")
    return joined.select(*claims.columns, F.col("m.relative").alias("relative"), kind.alias("kind"))


def scan_freshness(runs: DataFrame, now: Column, max_age_hours: float = 168.0) -> DataFrame:
    """Per machine and root: the latest finished run, its age and level, and the
    start of an unfinished one; roots that never finished fail."""
    keys = ["machine_id", "root_path"]
    done = stats.latest_per_key(runs.filter("finished_at IS NOT NULL"), keys, [F.desc("finished_at"), F.desc("id")]).select(*keys, F.col("id").alias("run_id"), "finished_at")
    open_ = runs.filter("finished_at IS NULL").groupBy(*keys).agg(F.max("started_at").alias("unfinished_started_at"))
    out = done.join(open_, keys, "full_outer").withColumn("age_hours", derive.age_hours(F.col("finished_at"), now))
    return out.withColumn("level", derive.level_for_age(F.col("age_hours"), max_age_hours)).withColumn("tier", derive.tier(F.concat("root_path", F.lit("/"))))


def machine_summary(claims: DataFrame, runs: DataFrame, audit: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Every machine of any table with its counts, first and last sighting."""
    c = claims.groupBy("machine_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("is_current").alias("current_claims"), F.min("observed_at").alias("c0"), F.max("observed_at").alias("c1"))
    r = runs.groupBy("machine_id").agg(F.count(F.lit(1)).alias("runs"), F.min("started_at").alias("r0"), F.max("started_at").alias("r1"))
    a = audit.groupBy("machine_id").agg(F.count(F.lit(1)).alias("audit_rows"), F.min("timestamp").alias("a0"), F.max("timestamp").alias("a1"))
    frames = [c.select("machine_id"), r.select("machine_id"), a.select("machine_id")]
    if registry is not None:
        frames.append(registry.select("machine_id"))
    out = stats.union_distinct(frames).join(c, "machine_id", "left").join(r, "machine_id", "left").join(a, "machine_id", "left")
    n = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return out.select("machine_id", n("claims"), n("current_claims"), n("runs"), n("audit_rows"), F.least("c0", "r0", "a0").alias("first_seen"), F.greatest("c1", "r1", "a1").alias("last_seen"))


def verify_content(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Outcome of comparing recorded size and hash with what is there now."""
    f = lambda p: files.select(F.col("path").alias(f"{p}_path_"), F.col("size_bytes").alias(f"{p}_size"), F.col("hash").alias(f"{p}_hash"))
    joined = plan.join(f("src"), F.col("source_path") == F.col("src_path_"), "left").join(f("dst"), F.col("destination_path") == F.col("dst_path_"), "left")
    same = lambda p: (F.col(f"{p}_size") == F.col("size_bytes")) & (F.col(f"{p}_hash") == F.col("canonical_hash"))
    there = F.col("dst_path_").isNotNull()
    outcome = F.when(there & same("dst"), "skipped_ok").when(there, "mismatch").when(F.col("src_path_").isNull(), "missing").when(same("src"), "would_succeed").otherwise("mismatch")
    return joined.select(*plan.columns, outcome.alias("outcome"))


def seed_plan(claims: DataFrame, permanodes: DataFrame, prefix: str, action: str = "reclassify", limit: int = 500) -> DataFrame:
    """Plan rows from the largest current claims under a prefix."""
    if action not in ("reclassify", "retire_direct"):
        raise ValueError(f"action {action!r} can't be seeded")
    rows = stats.current(claims).filter(derive.under_prefix(F.col("file_path"), prefix)).filter(F.length("permanode_id") == 32)
    joined = rows.join(permanodes.select("permanode_id", "canonical_hash"), "permanode_id", "left")
    out = joined.select(F.lit(action).alias("action"), "permanode_id", F.coalesce("canonical_hash", F.lit("0" * 64)).alias("canonical_hash"), "size_bytes", F.col("file_path").alias("source_path"), F.col("tier").alias("source_tier"))
    return stats.top_n_truncated(out, [F.desc("size_bytes"), F.asc("source_path")], max(1, min(50_000, limit)))


def plan_audit_rows(audit: DataFrame, run_id: str) -> DataFrame:
    return audit.filter(F.col("manifest_run_id") == run_id).orderBy("id")


def find_by_path(claims: DataFrame, permanodes: DataFrame, part: str, limit: int = 10) -> DataFrame:
    rows = stats.current(claims).filter(F.col("file_path").contains(part))
    return rows.join(permanodes.select("permanode_id", "canonical_hash"), "permanode_id").orderBy("permanode_id", "file_path").limit(limit)


def find_by_hash(permanodes: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return permanodes.filter(F.col("canonical_hash").startswith(prefix)).orderBy("canonical_hash", "permanode_id").limit(limit)
