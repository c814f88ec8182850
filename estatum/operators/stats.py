"""Counts, crosstabs and trees over claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estatum.functions import derive
from estatum.scratch import stored

DIMENSIONS = ("tier", "domain", "volume", "extension", "classification", "machine_id", "source")
MEASURES = {"claim_count": F.count, "permanode_count": F.count_distinct, "bytes_total": F.sum}


def current(claims: DataFrame) -> DataFrame:
    return claims.filter("is_current")


def _grouped(claims: DataFrame, *keys: str) -> DataFrame:
    return current(claims).groupBy(*keys).agg(F.count(F.lit(1)).alias("claim_count"), F.count_distinct("permanode_id").alias("permanode_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_total"))


def by_tier(claims: DataFrame) -> DataFrame:
    return _grouped(claims, "tier").orderBy(F.desc("bytes_total"), "tier")


def by_domain(claims: DataFrame) -> DataFrame:
    return _grouped(claims, "domain").orderBy(F.desc("bytes_total"), F.asc_nulls_last("domain"))


def by_volume(claims: DataFrame) -> DataFrame:
    return _grouped(claims, "volume").orderBy(F.desc("bytes_total"), F.asc_nulls_last("volume"))


def by_extension(claims: DataFrame, n: int = 20) -> DataFrame:
    out = current(claims).groupBy("extension").agg(F.count(F.lit(1)).alias("claim_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_total"))
    return out.orderBy(F.desc("bytes_total"), F.asc_nulls_last("extension")).limit(n)


def by_classification(claims: DataFrame, n: int = 20) -> DataFrame:
    out = current(claims).groupBy("classification").agg(F.count(F.lit(1)).alias("claim_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_total"))
    return out.orderBy(F.desc("claim_count"), F.asc_nulls_last("classification")).limit(n)


def copies(claims: DataFrame) -> DataFrame:
    return current(claims).groupBy("permanode_id").agg(F.count(F.lit(1)).alias("claim_count"))


def duplicates(claims: DataFrame, permanodes: DataFrame, n: int = 20, min_claims: int = 2) -> DataFrame:
    # the count comes before the join, so a very common content is one row there
    many = copies(claims).filter(F.col("claim_count") >= min_claims)
    out = many.join(permanodes.select("permanode_id", "canonical_hash", "size_bytes"), "permanode_id")
    return out.orderBy(F.desc("claim_count"), F.desc("size_bytes"), "permanode_id").limit(n)


def overview(claims: DataFrame, permanodes: DataFrame, top: int = 5) -> DataFrame:
    """One row: totals, the greatest tiers and domains, the largest content."""
    counted = copies(claims)
    total = current(claims).agg(F.count(F.lit(1)).alias("current_claims"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_total"))
    nodes = permanodes.join(counted, "permanode_id", "left").agg(
        F.count(F.lit(1)).alias("permanodes"),
        F.count_if(F.col("claim_count") >= 2).alias("duplicated"),
        F.max(F.when(F.col("claim_count").isNotNull(), F.struct("size_bytes", "permanode_id", "claim_count"))).alias("largest"),
    )
    firsts = lambda df, c: df.limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes_total")).alias("o"), F.col(c).alias("v")))).alias("l")).select(F.transform("l", lambda x: x["v"]).alias(f"top_{c}s"))
    out = reduce(lambda a, b: a.crossJoin(b), [nodes, total, firsts(by_tier(claims), "tier"), firsts(by_domain(claims), "domain")])
    return out.select("permanodes", "current_claims", "bytes_total", "duplicated", F.col("largest.permanode_id").alias("largest_id"), F.col("largest.size_bytes").alias("largest_bytes"), F.col("largest.claim_count").alias("largest_copies"), "top_tiers", "top_domains")


def cross(claims: DataFrame, a: str, b: str | None = None, measure: str = "claim_count", filters: dict[str, str] | None = None, prefix: str | None = None, limit: int = 100) -> DataFrame:
    """Crosstab of one or two dimensions, greatest cells first, and whether more
    than ``limit`` (1 to 500) cells were there."""
    for d in [a, *([b] if b else []), *(filters or {})]:
        if d not in DIMENSIONS:
            raise ValueError(f"unknown dimension {d!r}")
        if d == "source" and "source" not in claims.columns:
            raise ValueError("source needs claims of several inventories")
    if a == b or measure not in MEASURES:
        raise ValueError("equal dimensions or unknown measure")
    limit, keys, rows = max(1, min(500, limit)), [a, *([b] if b else [])], current(claims)
    for k, v in (filters or {}).items():
        rows = rows.filter(F.col(k) == v)
    if prefix:
        rows = rows.filter(derive.under_prefix(F.col("file_path"), prefix))
    arg = {"claim_count": F.lit(1), "permanode_count": F.col("permanode_id"), "bytes_total": F.col("size_bytes")}[measure]
    cells = rows.groupBy(*keys).agg(F.coalesce(MEASURES[measure](arg), F.lit(0)).cast("long").alias("value"))
    return top_n_truncated(cells, [F.desc("value"), *[F.asc_nulls_last(k) for k in keys]], limit)


def top_n_truncated(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows, each with the flag that there were more."""
    first = df.orderBy(*order).limit(n + 1)
    numbered = first.withColumn("_rn", F.row_number().over(Window.orderBy(*order))).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > n)
    return numbered.filter(F.col("_rn") <= n).drop("_rn")


def path_tree(claims: DataFrame, prefix: str, measure: str = "bytes_total", overlay: str | None = None, limit: int = 100) -> DataFrame:
    """Children of a prefix with counts, and with ``overlay`` the value that holds
    most bytes below each child.  Distinct contents are exact per child."""
    path = F.col("file_path")
    rows = current(claims).filter(derive.under_prefix(path, prefix)).withColumn("name", F.coalesce(derive.next_segment(path, prefix), derive.leaf_name(path, prefix)))
    rows = rows.withColumn("_dir", derive.next_segment(path, prefix).isNotNull()).filter("name IS NOT NULL")
    out = rows.groupBy("name").agg(F.bool_or("_dir").alias("is_dir"), F.count(F.lit(1)).alias("claim_count"), F.count_distinct("permanode_id").alias("permanode_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_total"))
    if overlay:
        shade = rows.groupBy("name", F.coalesce(F.col(overlay).cast("string"), F.lit("(none)")).alias("o")).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"))
        out = out.join(shade.groupBy("name").agg(F.max(F.struct("b", "o"))["o"].alias("overlay")), "name")
    out = out.withColumn("path", derive.child_path(F.lit(prefix.rstrip("/")), F.col("name")))
    return top_n_truncated(out, [F.desc(measure), F.asc("name")], max(1, min(500, limit)))


def _common(a: Column, b: Column) -> Column:
    """How many parts two paths begin with alike."""
    return F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))


def _meets(contents: DataFrame) -> DataFrame:
    """For each two neighbours of (permanode_id, parts) in order of content and path, the
    part of the tree where their paths meet.  Order is by ranges over tasks, whose edges
    are compared with each other, so no content is one task's."""
    keys = ["permanode_id", "parts"]
    dealt = stored(contents.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "contents")
    inside = Window.partitionBy("_part").orderBy(*keys)
    rows = dealt.withColumns({"_id": F.lag("permanode_id").over(inside), "_before": F.lag("parts").over(inside), "_rn": F.row_number().over(inside)})
    # a row a range: what the range before ends with
    last = dealt.groupBy("_part").agg(F.max(F.struct(*keys)).alias("l"))
    edge = last.select(F.col("_part").alias("_p"), F.lag("l").over(Window.orderBy("_part")).alias("_edge"))
    first = F.col("_rn") == 1
    met = rows.join(F.broadcast(edge), F.col("_part") == F.col("_p")).select("permanode_id", "parts", F.when(first, F.col("_edge.permanode_id")).otherwise(F.col("_id")).alias("_id"), F.when(first, F.col("_edge.parts")).otherwise(F.col("_before")).alias("_before"))
    return met.filter(F.col("permanode_id") == F.col("_id")).select(F.slice("parts", F.lit(1), _common(F.col("parts"), F.col("_before"))).alias("parts"))


def path_rollup(claims: DataFrame, overlay: str | None = None) -> DataFrame:
    """Every path and directory of the current claims at once: (parent, name, path,
    is_dir, claim_count, permanode_count, bytes_total), with ``overlay`` the value that
    holds most bytes below.  Written as a table (``write_rollup``) it answers every prefix.

    Distinct contents are exact: a content counts 1 at each of its paths and -1 where two
    neighbouring ones meet, so below any directory that holds it the sum is 1.  What is
    dealt to the directories above is one row a path, not one a claim and content."""
    rows = current(claims).withColumn("parts", F.split("file_path", "/"))
    contents = rows.filter("permanode_id IS NOT NULL").select("permanode_id", "parts").distinct()
    zero = F.lit(0).cast("long")
    leaves = rows.groupBy("parts").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"), F.count_distinct("permanode_id").alias("w"))
    met = _meets(contents).groupBy("parts").agg(zero.alias("n"), zero.alias("b"), (-F.count(F.lit(1))).alias("w"))
    up = leaves.unionByName(met).select("n", "b", "w", F.size("parts").alias("_size"), "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("_depth"))
    # a path of which nothing is a claim is only where contents meet
    at = F.array_join(F.slice("parts", F.lit(1), F.col("_depth")), "/")
    out = up.groupBy(at.alias("path"), F.col("_depth").alias("depth")).agg(F.bool_or((F.col("_size") > F.col("_depth")) & (F.col("n") > 0)).alias("is_dir"), F.sum("n").alias("claim_count"), F.sum("w").alias("permanode_count"), F.sum("b").alias("bytes_total"))
    if overlay:
        shade = rows.groupBy("parts", F.coalesce(F.col(overlay).cast("string"), F.lit("(none)")).alias("o")).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"))
        shade = shade.select("parts", "o", "b", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("_depth")).groupBy(at.alias("_path"), F.col("_depth").alias("_d"), "o").agg(F.sum("b").alias("b"))
        most = shade.groupBy("_path", "_d").agg(F.max(F.struct("b", "o"))["o"].alias("overlay"))
        out = out.join(most, (F.col("path") == F.col("_path")) & (F.col("depth") == F.col("_d"))).drop("_path", "_d")
    name = F.substring_index("path", "/", -1)
    parent = F.when(F.col("depth") > 1, F.left("path", F.length("path") - F.length(name) - 1))
    return out.withColumns({"parent": parent, "name": name}).select("parent", "name", "path", *[c for c in out.columns if c not in ("path", "depth")])


def write_rollup(rollup: DataFrame, path: str) -> None:
    """As a table in order of parent: a prefix reads the few row groups that hold it."""
    rollup.repartitionByRange("parent", "name").sortWithinPartitions("parent", "name").write.parquet(path)


def path_children(rollup: DataFrame, prefix: str, measure: str = "bytes_total", limit: int = 100) -> DataFrame:
    """What ``path_tree`` gives for a prefix, from a stored rollup."""
    rows = rollup.filter((F.col("parent") == prefix.rstrip("/")) & (F.col("is_dir") | (F.col("name") != ""))).drop("parent")
    return top_n_truncated(rows, [F.desc(measure), F.asc("name")], max(1, min(500, limit)))


def path_tree_presence(tree: DataFrame, presence: DataFrame, cap: int | None = 200) -> DataFrame:
    """Colour of children by presence kind of their own path."""
    joined = tree.join(presence.select(F.col("file_path").alias("path"), "kind"), "path", "left")
    if cap is None:
        return joined.withColumn("kind", F.coalesce("kind", F.lit("unprobed")))
    place = F.row_number().over(Window.orderBy(F.desc("bytes_total"), "path"))
    return joined.withColumn("_rn", place).withColumn("kind", F.when(F.col("_rn") <= cap, F.coalesce("kind", F.lit("unprobed"))).otherwise("unprobed")).drop("_rn")


def inventory_counts(permanodes: DataFrame, claims: DataFrame, runs: DataFrame, audit: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    machines = union_distinct([claims.select("machine_id"), runs.select("machine_id"), audit.select("machine_id")])
    parts = [n(permanodes, "permanodes"), n(current(claims), "current_claims"), n(runs, "scan_runs"), n(audit, "audit_entries"), n(machines, "machines")]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def rollup_cache(cache: DataFrame, live: DataFrame, now: Column, max_age_hours: float = 24.0) -> DataFrame:
    """The newest cached counts if young enough, else the live ones."""
    names = live.columns
    newest = cache.agg(F.max_by(F.struct(*names), "refreshed_at").alias("c"), F.max("refreshed_at").alias("at"))
    young = F.coalesce((F.unix_micros(now) - F.unix_micros("at")) / 3.6e9 <= max_age_hours, F.lit(False))
    both = live.crossJoin(newest).withColumn("_young", young)
    return both.select(*[F.when(F.col("_young"), F.col(f"c.{c}")).otherwise(F.col(c)).alias(c) for c in names], F.when(F.col("_young"), "rollup").otherwise("live").alias("counts_source"))


def latest_scan(runs: DataFrame) -> DataFrame:
    """By start, among finished runs."""
    return runs.filter("finished_at IS NOT NULL").orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def recent_runs(runs: DataFrame, n: int = 10, root: str | None = None) -> DataFrame:
    chosen = runs.filter(F.col("root_path") == root) if root else runs
    first = chosen.orderBy(F.desc("id")).limit(n).withColumn("in_progress", F.col("finished_at").isNull())
    return first.withColumn("any_in_progress", F.bool_or("in_progress").over(Window.partitionBy()))


def tail_audit(audit: DataFrame, n: int = 20, action: str | None = None) -> DataFrame:
    chosen = audit.filter(F.col("action") == action) if action else audit
    return chosen.orderBy(F.desc("id")).limit(n)


def last_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 16) -> DataFrame:
    """The first ``n`` rows of each key in ``order``.  Each of ``salts`` parts of a key
    keeps its own first ones before they are merged, so a hot key is not one task's."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(salts)))
    few = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    return few.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return last_n_per_key(df, keys, order, 1)


def machine_details(summary: DataFrame, runs: DataFrame, audit: DataFrame) -> DataFrame:
    """Each machine's summary with its last 5 runs and last 10 audit lines."""
    last_runs = last_n_per_key(runs, ["machine_id"], [F.desc("id")], 5).groupBy("machine_id").agg(F.reverse(F.array_sort(F.collect_list("id"))).alias("run_ids"))
    line = F.format_string("%s #%d", "action", "id")
    lines = last_n_per_key(audit, ["machine_id"], [F.desc("id")], 10).groupBy("machine_id").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("id", line.alias("t"))))), lambda x: x["t"]).alias("audit_lines"))
    return summary.join(last_runs, "machine_id", "left").join(lines, "machine_id", "left")


def action_counts(plan_rows: DataFrame) -> DataFrame:
    return plan_rows.groupBy("manifest_run_id", "action").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_total"))


def presence_counts(presence: DataFrame, keys: list[str] | None = None) -> DataFrame:
    kind, size = F.col("kind"), F.col("size_bytes")
    n = {k: F.count_if(kind == k).alias(k) for k in ("dual", "store_only", "mount_only", "missing_store", "mount_error", "conflict_name_path", "outside_store_root", "unknown")}
    out = presence.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("counted"), *n.values(), F.sum(F.when(kind == "dual", size)).alias("dual_bytes"), F.sum(F.when(kind == "store_only", size)).alias("store_only_bytes"))
    return out.withColumn("cloud_safe_ratio", F.try_divide(F.col("dual"), F.col("dual") + F.col("store_only")))


# Actions that end an adapter's run, and those that end a source of it.
RUN_ENDS = ("replicate_end", "archive_end")
SOURCE_ENDS = ("replicate_source", "archive_source")


def run_totals(audit: DataFrame, end_actions: tuple[str, ...] = RUN_ENDS) -> DataFrame:
    """The latest end row of each adapter, with the figures of its payload; a payload
    that is no JSON has none."""
    figures = ("runs", "successes", "failures", "skipped", "bytes")
    rows = audit.filter(F.col("action").isin(*end_actions)).withColumn("p", F.from_json("payload", "policy_name string, " + ", ".join(f"{c} long" for c in figures)))
    return rows.groupBy("action").agg(F.max_by(F.struct("id", "timestamp", "machine_id", "manifest_run_id", F.col("p.policy_name").alias("policy"), *[f"p.{c}" for c in figures]), "id").alias("r")).select("action", "r.*")


def run_sources(audit: DataFrame, actions: tuple[str, ...] = SOURCE_ENDS) -> DataFrame:
    """Per run what became of its sources: those that ran, with which result, and those
    switched off (no return code)."""
    p = F.from_json("payload", "returncode int, skipped boolean, stats struct<bytes: double>")
    rows = audit.filter(F.col("action").isin(*actions)).select("manifest_run_id", p.alias("p"))
    code, ran = F.col("p.returncode"), F.col("p.returncode").isNotNull()
    moved = F.when(ran, F.coalesce("p.stats.bytes", F.lit(0)).cast("long"))
    return rows.groupBy("manifest_run_id").agg(F.count_if(ran).alias("runs"), F.count_if(code == 0).alias("successes"), F.count_if(code != 0).alias("failures"), F.count_if(~ran & F.coalesce("p.skipped", F.lit(False))).alias("skipped"), F.coalesce(F.sum(moved), F.lit(0)).alias("bytes"))


def meta_kv(meta: DataFrame) -> DataFrame:
    return meta.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "value")).alias("value"))


def permanode_upsert(observed: DataFrame) -> DataFrame:
    """One identity a (hash, size): first sighting kept, last moved on."""
    out = observed.groupBy("canonical_hash", "size_bytes").agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), F.min_by("algo", F.struct("observed_at", "algo")).alias("algo"))
    return out.withColumn("permanode_id", derive.permanode_id(F.col("canonical_hash"), F.col("size_bytes"))).filter("permanode_id IS NOT NULL")


def hashes_upsert(observed: DataFrame) -> DataFrame:
    return observed.groupBy("permanode_id", "algo").agg(F.min_by("hex", F.struct("computed_at", "hex")).alias("hex"))


#: Claims that one task ranks, about.
CLAIMS_A_TASK = 500_000


def supersede_claims(claims: DataFrame, order: list[Column] | None = None, most: int = CLAIMS_A_TASK) -> DataFrame:
    """The newest sighting of each (machine, path, container) is current; a delete
    closes it.  More than ``most`` claims are dealt into parts of about so many by path, so
    what a task sorts doesn't grow with the claims."""
    n, cores = claims.count(), claims.sparkSession.sparkContext.defaultParallelism
    dealt = claims.repartition(max(cores, -(-n // most)), "machine_id", "file_path") if n > most else claims
    newest = Window.partitionBy("machine_id", "file_path", "container_path").orderBy(*(order or [F.desc("scan_run_id"), F.desc("claim_id")]))
    rn = F.row_number().over(newest)
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in claims.columns else F.lit(False)
    return dealt.withColumn("_rn", rn).withColumn("is_current", (F.col("_rn") == 1) & ~gone).drop("_rn")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    return union_all(frames).distinct()


def name_divergence(store: DataFrame, mount: DataFrame) -> DataFrame:
    """Visible names on one side only, and how many on both."""
    a, b = (df.select("name").filter(~F.col("name").startswith(".")).distinct() for df in (store, mount))
    both = a.withColumn("s", F.lit(True)).join(b.withColumn("m", F.lit(True)), "name", "full_outer")
    side = F.when(F.col("s") & F.col("m"), "both").when(F.col("s"), "store_only").otherwise("mount_only")
    return both.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("names"))
