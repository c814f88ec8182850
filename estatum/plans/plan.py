"""Retention and promotion plans over claims, and the backlog of plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estatum.functions import derive
from estatum.operators import stats
from estatum.scratch import stored

# Tiers and what becomes of their copies, reasons that block, intents.
CLOUD_TIERS = {"DropboxStorage": "dropbox-cloud-trash-account-specific"}
LIVE = ("boot", "L1", "L1w", "L2", "L3a", "DropboxStorage")
HARD = ("empty_plan", "manifest_missing", "dry_run_errors")
INTENTS = {"cloud_retire": ("dual",), "local_reclaim": ("dual", "store_only")}


@dataclass(frozen=True)
class Retention:
    skip_substrings: tuple[str, ...] = ("/@eaDir/", "/.fseventsd/")
    skip_prefixes: tuple[str, ...] = ("._",)
    skip_exact: tuple[str, ...] = (".DS_Store",)
    priority: dict[str, int] = field(default_factory=lambda: dict(derive.TIER_PRIORITY))
    live: tuple[str, ...] = LIVE
    nas: tuple[str, ...] = ("Backup",)
    stash_roots: dict[str, str] = field(default_factory=dict)
    recovered: tuple[str, ...] = ()
    cooling_off_days: int = 7
    no_promote: tuple[str, ...] = ()


@dataclass(frozen=True)
class Phase:
    name: str
    destination_root: str
    domain: str | None = None
    path_contains: str | None = None
    max_files: int | None = None
    mirror_from: str | None = None
    other_keys: tuple[str, ...] = ()


def _fields(given: dict, known: set[str], needed: set[str], where: str) -> dict:
    if (odd := set(given) - known) or (odd := needed - set(given)):
        raise ValueError(f"{where}: unknown or missing {sorted(odd)}")
    return given


def _header(policy: dict, kind: str, parts: set[str]) -> dict:
    _fields(policy, {"version", "kind", "metadata", *parts}, {"version", *parts}, kind)
    if policy["version"] != 1 or policy.get("kind", kind) != kind:
        raise ValueError(f"not a version 1 {kind}")
    return policy


def retention_of(policy: dict) -> Retention:
    """The rules of a parsed retention policy; unknown fields and wrong kinds are refused."""
    p = _header(policy, "RetentionPolicy", {"exclusions", "dedup_retire"})
    skip = _fields(p["exclusions"], {"always_skip_substrings", "no_promote_substrings", "basename_prefixes", "basename_exact"}, set(), "exclusions")
    d = _fields(p["dedup_retire"], {"strategy", "tier_priority", "live_tiers", "cooling_off_days", "stash_roots", "nas_manifest_tiers", "recovered_substrings"}, {"tier_priority", "live_tiers"}, "dedup_retire")
    if d.get("strategy", "keep-highest-priority-tier") != "keep-highest-priority-tier" or d.get("cooling_off_days", 7) < 0:
        raise ValueError("unknown strategy, or a negative number of days")
    many = lambda of, name: tuple(of.get(name) or ())
    return Retention(many(skip, "always_skip_substrings"), many(skip, "basename_prefixes"), many(skip, "basename_exact"), {k: int(v) for k, v in d["tier_priority"].items()}, many(d, "live_tiers"), many(d, "nas_manifest_tiers"), dict(d.get("stash_roots") or {}), many(d, "recovered_substrings"), d.get("cooling_off_days", 7), many(skip, "no_promote_substrings"))


@dataclass(frozen=True)
class Promotion:
    """A promotion policy: phases, and what they have in common."""

    phases: list[Phase]
    source_tier: str = "Backup"
    translations: list[tuple[str, str]] = field(default_factory=list)
    strip: str | None = None

    def promote(self, claims: DataFrame, retention: Retention | None = None, phase: str | None = None, max_files: int | None = None) -> DataFrame:
        return promote(claims, self.phases, self.source_tier, self.translations, self.strip, retention.no_promote if retention else (), phase, max_files)


def promotion_of(policy: dict) -> Promotion:
    """The phases of a parsed promotion policy.  A phase whose match has keys that aren't
    known matches nothing."""
    p = _header(policy, "PromotionPolicy", {"defaults", "phases"})
    settings = {"path_translations", "source_tier", "copy_strategy", "hash_algo", "preserve_mtime", "mirror_strip_prefix", *(f"on_dst_exists_{c}" for c in ("size_match_hash_match", "size_match_hash_mismatch", "size_mismatch"))}
    d = _fields(p["defaults"], settings, set(), "defaults")
    moves = [_fields(t, {"from", "to"}, {"from", "to"}, "path_translations") for t in d.get("path_translations") or ()]
    phases = []
    for x in p["phases"]:
        x = _fields(x, {"name", "match", "destination_root", "max_files", "mirror_from"}, {"name", "match", "destination_root"}, "phase")
        if x.get("max_files") is not None and x["max_files"] < 1:
            raise ValueError("max_files is less than 1")
        match = dict(x["match"])
        phases.append(Phase(x["name"], x["destination_root"], match.pop("domain", None), match.pop("path_contains", None), x.get("max_files"), x.get("mirror_from"), tuple(match)))
    return Promotion(phases, d.get("source_tier", "Backup"), [(t["from"], t["to"]) for t in moves], d.get("mirror_strip_prefix"))


def dedup_retire(claims: DataFrame, policy: Retention, run_id: str, root_prefix: str | None = None) -> DataFrame:
    """Plan rows for every copy but the keeper of each content with several
    current claims (claims: current_claims).  Contents with one copy leave before
    the window, so a shuffle carries only what can be planned."""
    path = F.col("file_path")
    rows = claims.filter(~derive.is_noise(path, policy.skip_substrings, policy.skip_prefixes, policy.skip_exact))
    if root_prefix:
        rows = rows.filter(derive.under_prefix(path, root_prefix))
    kept = keepers(rows, policy)
    ranked = rows.join(kept, "permanode_id")
    known = [t for t in policy.live if t in policy.priority]
    tier = F.col("tier")
    live, cloud = tier.isin(*known), tier.isin(*CLOUD_TIERS)
    action = F.when(cloud & live, "retire_direct").when(live, "stash").when(tier.isin(*policy.nas), "nas_manifest")
    target = F.when(action == "retire_direct", F.create_map(*[F.lit(x) for kv in CLOUD_TIERS.items() for x in kv])[tier]).otherwise(tier)
    stash = derive.stash_destination(path, tier, F.lit(run_id), policy.stash_roots)
    keeper = F.col("keeper")
    out = ranked.filter(F.col("claim_id") != keeper["claim_id"]).filter(~((tier == keeper["tier"]) & (path == keeper["file_path"]))).withColumn("action", action).filter("action IS NOT NULL")
    why = F.concat(F.lit("dedup of permanode "), F.col("permanode_id"), F.lit("; canonical lives on "), keeper["tier"], F.lit(" ("), keeper["file_path"], F.lit(")"))
    planned = out.select(F.lit(run_id).alias("manifest_run_id"), "action", "permanode_id", "canonical_hash", "size_bytes", "claim_id", path.alias("source_path"), tier.alias("source_tier"), F.when(F.col("action") == "stash", stash).alias("destination_path"), target.alias("destination_tier"), why.alias("rationale"))
    clash = planned.filter("destination_path IS NOT NULL").groupBy("destination_path").agg((F.count(F.lit(1)) > 1).alias("destination_conflict"))
    return planned.join(clash, "destination_path", "left").withColumn("destination_conflict", F.coalesce("destination_conflict", F.lit(False)))


def recovered_bias(substrings: tuple[str, ...]) -> Column:
    """1 for a recovered copy: ordered before anything else, others come first where
    a content has any, and where it has none all are equal."""
    return derive.any_of([F.col("file_path").contains(s) for s in substrings]).cast("int")


def keepers(rows: DataFrame, policy: Retention) -> DataFrame:
    """(permanode_id, keeper) of contents with several rows: the copy to keep.  An
    aggregate with partial sums, so a very common content is no one task's."""
    order = F.struct(recovered_bias(policy.recovered).alias("b"), derive.tier_priority(F.col("tier"), policy.priority).alias("p"), "claim_id")
    best = F.min_by(F.struct("tier", "file_path", "claim_id"), order)
    return rows.groupBy("permanode_id").agg(F.count(F.lit(1)).alias("_n"), best.alias("keeper")).filter("_n > 1").drop("_n")


def keeper_rank(rows: DataFrame, policy: Retention, width: int = 100_000) -> DataFrame:
    """Rows of contents with several, with ``rank`` and the ``keeper`` (tier,
    file_path, claim_id).  Ranks are counted inside ranges of ``width`` claim ids, and
    ranges are counted together, so a hot content is many tasks' work."""
    marked = rows.withColumns({"_b": recovered_bias(policy.recovered), "_p": derive.tier_priority(F.col("tier"), policy.priority), "_range": F.floor(F.col("claim_id") / width)})
    keys, order = ["permanode_id"], ["_b", "_p", "_range"]
    counts = marked.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = marked.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, *order).orderBy("claim_id")))
    out = ranked.join(counts.withColumn("_before", before).drop("_n"), [*keys, *order]).join(keepers(rows, policy), "permanode_id")
    return out.withColumn("rank", F.col("_rn") + F.col("_before")).drop(*order, "_rn", "_before")


def source_only(claims: DataFrame, tier: str) -> DataFrame:
    """Permanodes with no claim off the source tier."""
    return claims.groupBy("permanode_id").agg(F.bool_and(F.coalesce(F.col("tier") == tier, F.lit(False))).alias("only")).filter("only").select("permanode_id")


def phase_match(phases: list[Phase], domain: Column, path: Column) -> Column:
    """Index of the first phase whose keys all match."""
    out = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(phases))):
        cond = F.lit(not p.other_keys)
        if p.domain is not None:
            cond &= F.coalesce(domain == p.domain, F.lit(False))
        if p.path_contains is not None:
            cond &= path.contains(p.path_contains)
        out = F.when(cond, F.lit(i)).otherwise(out)
    return out


def promote(claims: DataFrame, phases: list[Phase], source_tier: str = "Backup", translations: list[tuple[str, str]] = (), strip: str | None = None, no_promote: tuple[str, ...] = (), phase_name: str | None = None, max_files: int | None = None) -> DataFrame:
    """Plan rows that bring contents which live on the source tier alone to the
    destination of their phase; one copy of each, the lowest claim id."""
    chosen = [p for p in phases if phase_name in (None, p.name)]
    rows = claims.filter(~derive.any_of([F.col("file_path").contains(s) for s in no_promote]))
    one = rows.join(source_only(claims, source_tier), "permanode_id", "left_semi").groupBy("permanode_id").agg(F.min_by(F.struct("claim_id", "file_path", "canonical_hash", "size_bytes", "domain"), "claim_id").alias("c")).select("permanode_id", "c.*")
    matched = one.withColumn("_phase", phase_match(chosen, F.col("domain"), F.col("file_path"))).filter("_phase IS NOT NULL")
    src = derive.translate_path(F.col("file_path"), list(translations))
    dest, name, cap = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, p in enumerate(chosen):
        here = F.col("_phase") == i
        dest = F.when(here, derive.promote_destination(src, p.destination_root, p.mirror_from, strip)).otherwise(dest)
        name, cap = F.when(here, F.lit(p.name)).otherwise(name), F.when(here, F.lit(p.max_files).cast("int")).otherwise(cap)
    out = matched.select("permanode_id", "canonical_hash", "size_bytes", "claim_id", F.lit("promote").alias("action"), src.alias("source_path"), F.lit(source_tier).alias("source_tier"), dest.alias("destination_path"), name.alias("phase"), cap.alias("_cap"))
    if any(p.max_files for p in chosen):
        caps = {p.name: p.max_files for p in chosen if p.max_files}
        capped = [stats.last_n_per_key(out.filter(F.col("phase") == n), ["phase"], [F.asc("permanode_id")], m) for n, m in caps.items()]
        out = stats.union_all([out.filter(~F.col("phase").isin(*caps)), *capped])
    out = out.drop("_cap").orderBy("permanode_id")
    return out.limit(max_files) if max_files is not None else out


def blocked_reasons() -> Column:
    """Ordered tokens (fixed values) of a plans row (rows_total, manifest_exists, dry_run_errors,
    retire_direct, cloud_retire_ready, has_filter, sample_paths, cap, stale)."""
    c = F.col
    cloudy = F.exists("sample_paths", lambda p: F.lower(p).rlike("dropbox|cloudstorage|fileprovider"))
    tests = (
        (c("rows_total") <= 0, "empty_plan"),
        (~c("manifest_exists"), "manifest_missing"),
        (c("dry_run_errors") > 0, "dry_run_errors"),
        ((c("retire_direct") > 0) & ~c("cloud_retire_ready"), "fp_not_ready"),
        ((c("retire_direct") >= 1000) & ~c("has_filter") & cloudy, "dual_presence_unfiltered"),
        (c("rows_total") > c("cap"), "oversize_for_mcp"),
        (c("stale"), "stale_inventory"),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in tests]))


def register(rows: DataFrame, created_at: Column, **flags) -> DataFrame:
    """One backlog row a plan run: counts, bytes, digest, reasons, status."""
    defaults = {"manifest_exists": True, "dry_run_errors": None, "cloud_retire_ready": None, "has_filter": False, "cap": None, "stale": False} | flags
    kinds = {"dry_run_errors": "long", "cap": "long"}
    counts = rows.groupBy("manifest_run_id", "action").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"), F.sum(F.xxhash64("action", "permanode_id", "source_path").cast("decimal(38,0)")).alias("h"), F.slice(F.array_sort(F.collect_set(F.substring_index("source_path", "/", 3))), 1, 5).alias("s"))
    out = counts.groupBy(F.col("manifest_run_id").alias("plan_id")).agg(F.sum("n").alias("rows_total"), F.coalesce(F.sum("b"), F.lit(0)).alias("estimated_bytes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("action_counts"), F.sha2(F.sum("h").cast("string"), 256).alias("content_sha"), F.flatten(F.collect_list("s")).alias("sample_paths"), F.coalesce(F.sum(F.when(F.col("action") == "retire_direct", F.col("n"))), F.lit(0)).alias("retire_direct"))
    for k, v in defaults.items():
        out = out.withColumn(k, F.lit(v).cast(kinds.get(k, "boolean")))
    out = out.withColumn("blocked_reasons", blocked_reasons()).withColumn("created_at", created_at)
    return out.withColumn("status", F.when(F.arrays_overlap("blocked_reasons", F.array(*map(F.lit, HARD))), "blocked").otherwise("registered"))


def list_plans(plans: DataFrame, status: str | None = None, policy: str | None = None, limit: int = 50) -> DataFrame:
    """Last write of each plan, newest first."""
    out = stats.latest_per_key(plans, ["plan_id"], [F.desc("write_ts")])
    if status:
        out = out.filter(F.col("status") == status)
    if policy:
        out = out.filter(F.col("policy_name") == policy)
    return out.orderBy(F.desc("write_ts"), "plan_id").limit(max(1, min(500, limit)))


# Actions that finish a row.
DONE = ("stash_committed", "promote_committed", "retire_direct_executed", "nas_manifest_exported")


def refresh_status(plans: DataFrame, audit: DataFrame) -> DataFrame:
    """Status of plans (plan_id, rows_total, blocked_reasons, dry_run_errors,
    dry_run_ok) from what the log says was done for each run."""
    done = audit.filter(F.col("action").isin(*DONE)).groupBy(F.col("manifest_run_id").alias("plan_id")).agg(F.count(F.lit(1)).alias("done"))
    n = F.coalesce("done", F.lit(0))
    status = F.when((n > 0) & (n >= F.col("rows_total")), "applied").when(n > 0, "partially_applied").when(F.arrays_overlap("blocked_reasons", F.array(*map(F.lit, HARD))), "blocked").when(F.col("dry_run_errors") > 0, "dry_run_failed").when(F.col("dry_run_ok") > 0, "dry_run_ok").otherwise("registered")
    return plans.join(done, "plan_id", "left").withColumn("status", status).withColumn("done", n)


def dry_run_digest(outcomes: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return outcomes.groupBy("plan_id").agg(F.count_if(o == "errored").alias("errors"), F.count_if(o == "applied").alias("applied"), F.count_if(o == "skipped").alias("skipped"), (F.count_if(o == "errored") == 0).alias("ok"))


def prune(plans: DataFrame, now: Column, days: int = 90, execute: bool = False, dry_run: bool = False) -> DataFrame:
    """Plans older than ``days`` (dry run), or the backlog without them."""
    if execute == dry_run:
        raise ValueError("one of execute and dry_run is needed")
    old = F.coalesce(F.col("created_at") < now - F.make_interval(days=F.lit(days)), F.lit(False))
    return plans.filter(~old if execute else old)


def filter_presence(rows: DataFrame, presence: DataFrame, intent: str = "observe") -> DataFrame:
    """Plan rows with their presence kind, those that the intent allows."""
    out = rows.join(presence.select(F.col("file_path").alias("source_path"), "kind").distinct(), "source_path", "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    return out.filter(F.col("kind").isin(*INTENTS[intent])) if intent in INTENTS else out


def presence_sample(claims: DataFrame, tier: str = "DropboxStorage", limit: int = 32) -> DataFrame:
    return stats.current(claims).filter(F.col("tier") == tier).orderBy("claim_id").limit(limit)


def presence_ready(counts: DataFrame, mount_present: bool) -> DataFrame:
    return counts.withColumn("ready", F.lit(mount_present) & (F.col("counted") > 0) & (F.col("dual") > 0))


def needs_cloud_gate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("manifest_run_id").agg(F.bool_or(F.col("action") == "retire_direct").alias("needs_gate"))


def simulate(verified: DataFrame, max_files: int | None = None) -> DataFrame:
    """Outcome of a dry run of plan rows with a ``check`` (verify_content's
    outcome): applied, skipped beyond ``max_files``, or errored with a text.  With a limit
    the plan is stored, as it is read twice."""
    a = F.col("action")
    error = F.when(a.isin("restore", "finalize_stash", "reclassify"), F.concat(F.lit("unsupported action "), a)).when(a.isin("stash", "promote") & F.col("destination_path").isNull(), F.concat(a, F.lit(" row without destination"))).when(F.col("check").isin("missing", "mismatch"), F.concat(F.lit("content "), F.col("check")))
    out, good = verified.withColumn("error", error), F.col("error").isNull()
    beyond = F.lit(False)
    if max_files is not None:
        out = stored(out, "plan")
        # the last row that a run may apply: a row a run
        first = stats.last_n_per_key(out.filter(good).select("manifest_run_id", "row_id"), ["manifest_run_id"], [F.asc("row_id")], max_files)
        last = first.groupBy(F.col("manifest_run_id").alias("_run")).agg(F.max("row_id").alias("_last"))
        out = out.join(last, F.col("manifest_run_id").eqNullSafe(F.col("_run")), "left")
        beyond = F.coalesce(F.col("row_id") > F.col("_last"), F.lit(True))
    outcome = F.when(~good, "errored").when(beyond, "skipped").otherwise("applied")
    return out.withColumn("outcome", outcome).drop("_run", "_last")


def record_outcomes(outcomes: DataFrame, claims: DataFrame, home: str) -> DataFrame:
    """Claims after the rows applied: every path form of what was retired is no
    longer current."""
    gone = outcomes.filter((F.col("outcome") == "applied") & (F.col("action") == "retire_direct")).select(F.explode(derive.path_aliases(F.col("source_path"), home)).alias("file_path"), F.lit(True).alias("_gone")).distinct()
    return claims.join(gone, "file_path", "left").withColumn("is_current", F.col("is_current") & F.col("_gone").isNull()).drop("_gone")


def outcome_events(outcomes: DataFrame) -> DataFrame:
    """Log rows of a run, between its start and its end."""
    names = F.create_map(*[F.lit(x) for kv in {"stash": "stash_committed", "promote": "promote_committed", "retire_direct": "retire_direct_executed", "nas_manifest": "nas_manifest_exported"}.items() for x in kv])
    rows = outcomes.filter(F.col("outcome") == "applied").select("manifest_run_id", names[F.col("action")].alias("action"), F.to_json(F.struct(F.col("source_path").alias("source"), F.col("destination_path").alias("destination"))).alias("payload"), "row_id", F.lit(1).alias("_o"))
    runs = outcomes.select("manifest_run_id").distinct()
    edge = lambda name, o: runs.select("manifest_run_id", F.lit(name).alias("action"), F.lit("{}").alias("payload"), F.lit(None).cast("long").alias("row_id"), F.lit(o).alias("_o"))
    return edge("apply_start", 0).unionByName(rows).unionByName(edge("apply_end", 2))


def bulk_prep(rows: DataFrame, presence: DataFrame) -> DataFrame:
    """Counts by kind of a plan for cloud retirement; execution stays blocked."""
    kinds = filter_presence(rows, presence).groupBy("manifest_run_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_total"))
    return kinds.withColumn("selected", F.col("kind") == "dual").withColumn("execute", F.lit("blocked"))


def attach_filter(plans: DataFrame, filters: DataFrame) -> DataFrame:
    """Plans with their latest presence filter, reasons renewed."""
    last = stats.latest_per_key(filters, ["plan_id"], [F.desc("at")]).select("plan_id", F.lit(True).alias("_f"))
    out = plans.join(last, "plan_id", "left").withColumn("has_filter", F.col("has_filter") | F.col("_f").isNotNull()).drop("_f")
    return out.withColumn("blocked_reasons", blocked_reasons())
