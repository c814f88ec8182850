"""Queries over the derived inventory, and their twins in DuckDB's SQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estatum.functions import derive
from estatum.operators import audit, embed, health, joins, stats
from estatum.plans import plan, stash
from estatum.sources import files, sinks, trees
from estatum.streaming import stream
from estatum.scratch import scratch, stored
from estatum.testbed import HOME, NOW, Estate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TIER_CASE = """CASE WHEN regexp_matches({p}, '/Library/CloudStorage/Dropbox(-[^/]+)?(/|$)') THEN '{c}'
 WHEN starts_with({p}, '/Users/') THEN '{u}' WHEN starts_with({p}, '/private/') OR starts_with({p}, '/var/') THEN '{s}'
 WHEN starts_with({p}, '/Volumes/Level 1w') THEN '{w}' WHEN starts_with({p}, '/Volumes/Level 1/') THEN '{l1}'
 WHEN starts_with({p}, '/Volumes/Level 2/') THEN '{l2}'
 WHEN starts_with({p}, '/Volumes/Level_3a/') OR starts_with({p}, '/Volumes/NFS-Level3a/') THEN '{l3}'
 WHEN starts_with({p}, '/Volumes/Backup/') OR starts_with({p}, '/Volumes/NFS-Backup/') THEN 'Backup'
 WHEN starts_with({p}, '/Volumes/DropboxStorage') THEN 'DropboxStorage' WHEN starts_with({p}, '/Volumes/BOOTCAMP/') THEN 'BOOTCAMP'
 WHEN starts_with({p}, '/Volumes/') THEN {o} ELSE '{n}' END"""


def tier_sql(p: str) -> str:
    return TIER_CASE.format(p=p, c="DropboxStorage", u="boot", s="boot", w="L1w", l1="L1", l2="L2", l3="L3a", o="'other-volume'", n="unknown")


def volume_sql(p: str) -> str:
    return TIER_CASE.format(p=p, c="Dropbox_CloudStorage", u="boot-Users", s="boot-system", w="Level_1w", l1="Level_1", l2="Level_2", l3="Level_3a", o=f"regexp_extract({p}, '^/Volumes/([^/]+)/', 1)", n="")


def priority_sql(t: str) -> str:
    return f"CASE {t} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in derive.TIER_PRIORITY.items()) + " ELSE 999 END"


ROOT_SQL = "['/Users/ana','/Volumes/Level 1','/Volumes/Level 1w','/Volumes/Level 2','/Volumes/Level_3a','/Volumes/DropboxStorage/Dropbox','/Volumes/Backup','/Volumes/NFS-Backup']"
CLAIMS = f"""raw AS (SELECT doc_id AS claim_id, sha256(text) AS canonical_hash, strlen(text)::BIGINT AS size_bytes, 'm' || (doc_id % 3) AS machine_id,
 {ROOT_SQL}[CAST(substr(source, 4) AS INT) % 8 + 1] || '/' || CASE lang WHEN 'en' THEN 'Documents' WHEN 'de' THEN 'Photos' WHEN 'fr' THEN 'Music' WHEN 'es' THEN 'src' ELSE 'misc' END || '/' || doc_id || ['.txt','.PDF','.jpg','','.mp3','.tar.gz'][CAST(doc_id % 6 AS INT) + 1] AS file_path,
 doc_id % 4 + 1 AS scan_run_id, doc_id % 10 <> 9 AS is_current, CASE WHEN doc_id % 17 = 0 THEN '/Volumes/Level 2/a.zip' END AS container_path, doc_id * 60 AS observed, doc_id AS doc_id FROM documents),
named AS (SELECT *, left(sha256(canonical_hash || ':' || size_bytes), 32) AS permanode_id, regexp_extract(file_path, '[^/]*$') AS base FROM raw),
claims AS (SELECT *, {tier_sql('file_path')} AS tier, {volume_sql('file_path')} AS volume,
 CASE WHEN contains(base, '.') THEN nullif(lower(regexp_extract(base, '[^.]*$')), '') END AS extension,
 CASE WHEN contains(lower(file_path), '/photos/') OR contains(lower(file_path), '/dcim/') THEN 'photos' WHEN contains(lower(file_path), '/music/') THEN 'music' WHEN contains(lower(file_path), '/documents/') THEN 'documents' WHEN contains(lower(file_path), '/src/') THEN 'code' END AS domain,
 CASE WHEN starts_with(file_path, '/Volumes/Level 2/') THEN 'Level-Two' WHEN regexp_matches(file_path, '/[0-9]*5\\.') OR regexp_matches(file_path, '/[0-9]*5$') THEN 'Numbered-Five' END AS classification FROM named),
cur AS (SELECT * FROM claims WHERE is_current),
nodes AS (SELECT permanode_id, min(canonical_hash) AS canonical_hash, min(size_bytes) AS size_bytes FROM claims GROUP BY 1)"""
LINES = f"""lraw AS (SELECT CAST(l_partkey AS VARCHAR) AS permanode_id, {ROOT_SQL}[CAST(l_suppkey % 8 AS INT) + 1] || '/' || year(l_shipdate) || '/' || l_orderkey || '-' || l_linenumber || CASE l_returnflag WHEN 'A' THEN '.jpg' WHEN 'N' THEN '.txt' ELSE '.mp3' END AS file_path,
 CAST(l_quantity AS BIGINT) AS size_bytes, 'm' || (l_suppkey % 3) AS machine_id, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS scan_run_id, CAST(trunc(l_extendedprice * 100) AS BIGINT) AS claim_id FROM lineitem),
lines AS (SELECT *, {tier_sql('file_path')} AS tier FROM lraw)"""
RUNS = "runs AS (SELECT o_orderkey AS id, '/Volumes/' || o_orderpriority AS root_path, 'm' || (o_custkey % 3) AS machine_id, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 2 HOUR END AS finished_at FROM orders)"
LOG = """log AS (SELECT event_id AS id, 'm' || (user_id % 3) AS machine_id, CASE event_type WHEN 'purchase' THEN 'stash_committed' WHEN 'signup' THEN 'stash_finalized' WHEN 'error' THEN 'stash_restored' WHEN 'click' THEN 'replicate_end' ELSE 'archive_end' END AS action,
 'run' || (user_id % 20) AS manifest_run_id, json_extract_string(props, '$.k') AS k, ts AS timestamp FROM events),
stashed AS (SELECT machine_id, manifest_run_id, '/s/' || k AS source, max(id) AS id FROM log WHERE action LIKE 'stash%' AND k IS NOT NULL GROUP BY 1, 2, 3),
flying AS (SELECT s.*, l.timestamp, '/d/' || l.k AS destination FROM stashed s JOIN log l USING (id) WHERE l.action = 'stash_committed')"""
STORES = ["/Users/ana/Library/CloudStorage/Dropbox/", *derive.CLOUD_STORES]
REL = "CASE " + " ".join(f"WHEN starts_with(file_path, '{s}') THEN substr(file_path, {len(s) + 1})" for s in STORES) + " END"
PRESENCE = f"""rel AS (SELECT *, {REL} AS relative FROM claims),
kinds AS (SELECT *, CASE WHEN relative IS NULL THEN 'outside_store_root' WHEN doc_id % 7 <> 0 AND doc_id % 11 = 0 THEN 'mount_error' WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'dual' WHEN doc_id % 5 <> 0 THEN 'store_only' WHEN doc_id % 7 <> 0 THEN 'mount_only' ELSE 'missing_store' END AS kind FROM rel)"""


def query(name: str, sql: str | None = None, ctes: str = CLAIMS):
    def add(f):
        QUERIES[name] = lambda spark, folder: f(Estate(spark, folder))
        if sql is not None:
            SQL[name] = f"WITH {ctes} {sql}"
        return f

    return add


AGG = "count(*) AS claim_count, count(DISTINCT permanode_id) AS permanode_count, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes_total"

# functions ------------------------------------------------------------------


@query("derive_path_parts", "SELECT claim_id, regexp_replace(file_path, '/[^/]*$', '') AS parent_dir, base AS basename, extension FROM claims")
def _(e):
    return e.claims.select("claim_id", derive.path_parts(F.col("file_path")).alias("p")).select("claim_id", "p.*")


@query("derive_tier", f"SELECT claim_id, tier, volume, {priority_sql('tier')} AS priority FROM claims")
def _(e):
    return e.claims.select("claim_id", "tier", "volume", derive.tier_priority(F.col("tier")).alias("priority"))


@query("derive_permanode_id", "SELECT claim_id, permanode_id FROM claims")
def _(e):
    return e.claims.select("claim_id", "permanode_id")


@query("derive_hash_grade", "SELECT claim_id, CASE WHEN count(*) OVER (PARTITION BY permanode_id) > 1 THEN 'archive' ELSE 'fast' END AS grade FROM claims")
def _(e):
    many = e.claims.groupBy("permanode_id").agg((F.count(F.lit(1)) > 1).alias("dup"))
    return e.claims.join(many, "permanode_id").select("claim_id", derive.hash_grade(F.col("size_bytes"), F.col("dup")).alias("grade"))


@query("derive_noise", "SELECT claim_id, contains(file_path, '/Music/') OR starts_with(base, '1') OR base IN ('30.txt') AS noise FROM claims")
def _(e):
    return e.claims.select("claim_id", derive.is_noise(F.col("file_path"), ("/Music/",), ("1",), ("30.txt",)).alias("noise"))


@query("derive_classify", "SELECT claim_id, domain, classification FROM claims")
def _(e):
    return e.claims.select("claim_id", "domain", "classification")


@query("derive_classify_counts", "SELECT count(*) AS scanned, count(domain) AS domain_updated, count(classification) AS classification_updated FROM claims")
def _(e):
    return e.claims.agg(F.count(F.lit(1)).alias("scanned"), F.count("domain").alias("domain_updated"), F.count("classification").alias("classification_updated"))


@query("derive_segments", """SELECT claim_id, CASE WHEN starts_with(file_path, '/Volumes/Level 2/') AND contains(substr(file_path, 18), '/') THEN split_part(substr(file_path, 18), '/', 1) END AS segment,
 CASE WHEN starts_with(file_path, '/Volumes/Level 2/Photos/') THEN substr(file_path, 25) END AS leaf, starts_with(file_path, '/Volumes/Level 2/') AS below FROM claims""")
def _(e):
    p = F.col("file_path")
    return e.claims.select("claim_id", derive.next_segment(p, "/Volumes/Level 2").alias("segment"), derive.leaf_name(p, "/Volumes/Level 2/Photos").alias("leaf"), derive.under_prefix(p, "/Volumes/Level 2/").alias("below"))


@query("derive_prefixes", "SELECT claim_id, regexp_replace(replace(file_path || '\\//', '\\', '/'), '/+$', '') AS normal, file_path || '/x' AS child FROM claims")
def _(e):
    p = F.col("file_path")
    return e.claims.select("claim_id", derive.normalize_prefix(F.concat(p, F.lit("\\//"))).alias("normal"), derive.child_path(p, F.lit("x")).alias("child"))


@query("derive_cloud_paths", f"SELECT claim_id, {REL} AS relative, '/Volumes/DropboxStorage/.CloudStorage/Data/Dropbox/' || {REL} AS store, '/Users/ana/Library/CloudStorage/Dropbox/' || {REL} AS mount, {REL} IS NOT NULL AS is_cloud FROM claims")
def _(e):
    rel = derive.cloud_relative(F.col("file_path"), HOME)
    return e.claims.select("claim_id", rel.alias("relative"), derive.cloud_store_path(rel).alias("store"), derive.cloud_mount_path(rel, HOME).alias("mount"), derive.is_cloud_path(F.col("file_path"), HOME).alias("is_cloud"))


@query("derive_delete_target", f"SELECT claim_id, coalesce('/Users/ana/Library/CloudStorage/Dropbox/' || {REL}, file_path) AS target, CASE WHEN {REL} IS NOT NULL THEN 'DropboxStorage' END AS tier_hint, {REL} IS NOT NULL AS used_mount FROM claims")
def _(e):
    return e.claims.select("claim_id", derive.resolve_delete_target(F.col("file_path"), HOME).alias("t")).select("claim_id", "t.*")


@query("derive_aliases", f"""SELECT claim_id, a AS alias FROM (SELECT claim_id, unnest(CASE WHEN {REL} IS NULL THEN [file_path] ELSE list_distinct([file_path, '/Volumes/DropboxStorage/.CloudStorage/Data/Dropbox/' || {REL}, '/Users/ana/Library/CloudStorage/Dropbox/' || {REL}, '/Volumes/DropboxStorage/Dropbox/' || {REL}]) END) AS a FROM claims)""")
def _(e):
    return e.claims.select("claim_id", F.explode(derive.path_aliases(F.col("file_path"), HOME)).alias("alias"))


@query("derive_conflict_names", "SELECT claim_id, doc_id % 13 = 0 AS conflict FROM claims")
def _(e):
    return e.claims.select("claim_id", derive.is_conflict_name(F.concat(F.lit("a/"), F.when(F.col("claim_id") % 13 == 0, "b (Selective Sync Conflict)").otherwise("b"), F.lit("/c"))).alias("conflict"))


@query("derive_store_mount", f"SELECT claim_id, {REL} AS relative, CASE WHEN {REL} IS NULL THEN 'outside_store_root' ELSE 'unknown' END AS kind FROM claims")
def _(e):
    return e.claims.select("claim_id", derive.map_store_mount(F.col("file_path"), HOME).alias("m")).select("claim_id", "m.relative", "m.kind")


@query("derive_destinations", """SELECT claim_id, '/D/' || CASE WHEN contains(file_path, '/Photos/') THEN split_part(file_path, '/Photos/', 2) WHEN starts_with(file_path, '/Volumes/Backup/') THEN substr(file_path, 17) ELSE base END AS promoted,
 CASE WHEN tier = 'L2' THEN '/Stash/r1/' || base ELSE regexp_replace(file_path, '/[^/]*$', '') || '/_cooling-off-stash/r1/' || base END AS stashed,
 CASE WHEN starts_with(file_path, '/Volumes/NFS-Backup/') THEN '/Volumes/Backup/' || substr(file_path, 21) ELSE file_path END AS translated FROM claims""")
def _(e):
    p = F.col("file_path")
    return e.claims.select("claim_id", derive.promote_destination(p, "/D", "/Photos/", "/Volumes/Backup/").alias("promoted"), derive.stash_destination(p, F.col("tier"), F.lit("r1"), {"L2": "/Stash"}).alias("stashed"), derive.translate_path(p, [("/Volumes/NFS-Backup/", "/Volumes/Backup/")]).alias("translated"))


@query("derive_ages", f"SELECT id, round(greatest(0, epoch(TIMESTAMP '{NOW}' - timestamp) / 3600.0), 6) AS age, CASE WHEN epoch(TIMESTAMP '{NOW}' - timestamp) / 3600.0 > 2000 THEN 'fail' ELSE 'ok' END AS level FROM log", LOG)
def _(e):
    age = derive.age_hours(F.col("timestamp"), e.now)
    return e.events.select("id", F.round(age, 6).alias("age"), derive.level_for_age(age, 2000).alias("level"))


@query("derive_capacity", "SELECT p_partkey, CASE WHEN p_size::BIGINT * 1000000000 < 10737418240 THEN 'warn' WHEN p_size < 15 THEN 'warn' ELSE 'ok' END AS capacity, CASE WHEN p_retailprice > 2000 THEN 'warn' ELSE 'ok' END AS latency FROM part", "x AS (SELECT 1)")
def _(e):
    free = F.col("p_size").cast("long") * 1000000000
    return e.read("part").select("p_partkey", derive.capacity_level(free, F.lit(300000000000)).alias("capacity"), derive.latency_level(F.col("p_retailprice")).alias("latency"))


@query("derive_text", "SELECT claim_id, concat_ws(' ', base, classification, domain, regexp_replace(file_path, '/[^/]*$', ''), tier) AS text FROM claims")
def _(e):
    p = F.col("file_path")
    return e.claims.select("claim_id", derive.permanode_text(derive.basename(p), F.col("classification"), F.col("domain"), derive.parent_dir(p), F.col("tier")).alias("text"))


@query("derive_audit_hash", """SELECT id, sha256(repeat('0', 64) || '{"action":"' || action || '","machine_id":"' || machine_id || '","permanode_id":null}') AS row_hash FROM log""", LOG)
def _(e):
    return e.events.select("id", derive.audit_row_hash(F.lit("0" * 64), derive.canonical_audit_json(["machine_id", "action", "permanode_id", "id"])).alias("row_hash"))


# counts ---------------------------------------------------------------------


@query("stats_by_tier", f"SELECT tier, {AGG} FROM cur GROUP BY tier")
def _(e):
    return stats.by_tier(e.claims)


@query("stats_by_tier_lines", f"SELECT tier, {AGG} FROM lines GROUP BY tier", LINES)
def _(e):
    return stats.by_tier(e.line_claims)


@query("stats_by_domain", f"SELECT domain, {AGG} FROM cur GROUP BY domain")
def _(e):
    return stats.by_domain(e.claims)


@query("stats_by_volume", f"SELECT volume, {AGG} FROM cur GROUP BY volume")
def _(e):
    return stats.by_volume(e.claims)


@query("stats_by_extension", "SELECT extension, count(*) AS claim_count, CAST(sum(size_bytes) AS BIGINT) AS bytes_total FROM cur GROUP BY extension ORDER BY bytes_total DESC, extension NULLS LAST LIMIT 3")
def _(e):
    return stats.by_extension(e.claims, 3)


@query("stats_by_classification", "SELECT classification, count(*) AS claim_count, CAST(sum(size_bytes) AS BIGINT) AS bytes_total FROM cur GROUP BY classification ORDER BY claim_count DESC, classification NULLS LAST LIMIT 20")
def _(e):
    return stats.by_classification(e.claims)


@query("stats_duplicates", "SELECT permanode_id, n.canonical_hash, n.size_bytes, count(*) AS claim_count FROM cur JOIN nodes n USING (permanode_id) GROUP BY 1, 2, 3 HAVING count(*) >= 2 ORDER BY claim_count DESC, n.size_bytes DESC, permanode_id LIMIT 20")
def _(e):
    return stats.duplicates(e.claims, e.permanodes)


@query("stats_overview", """, c AS (SELECT permanode_id, count(*) AS n FROM cur GROUP BY 1), big AS (SELECT permanode_id, size_bytes, n FROM nodes JOIN c USING (permanode_id) ORDER BY size_bytes DESC, permanode_id DESC LIMIT 1)
 SELECT (SELECT count(*) FROM nodes) AS permanodes, (SELECT count(*) FROM cur) AS current_claims, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM cur) AS bytes_total, (SELECT count(*) FROM c WHERE n >= 2) AS duplicated, big.permanode_id AS largest_id, big.size_bytes AS largest_bytes, big.n AS largest_copies, (SELECT string_agg(tier, ',' ORDER BY b DESC, tier) FROM (SELECT tier, sum(size_bytes) AS b FROM cur GROUP BY 1 ORDER BY b DESC, tier LIMIT 5)) AS top_tiers, (SELECT string_agg(coalesce(domain, '-'), ',' ORDER BY b DESC, domain NULLS LAST) FROM (SELECT domain, sum(size_bytes) AS b FROM cur GROUP BY 1 ORDER BY b DESC, domain NULLS LAST LIMIT 5)) AS top_domains FROM big""")
def _(e):
    return stats.overview(e.claims, e.permanodes).withColumns({c: F.array_join(c, ",", "-") for c in ("top_tiers", "top_domains")})


@query("stats_cross", "SELECT tier, extension, CAST(sum(size_bytes) AS BIGINT) AS value, (SELECT count(*) FROM (SELECT DISTINCT tier, extension FROM cur WHERE machine_id = 'm1')) > 10 AS truncated FROM cur WHERE machine_id = 'm1' GROUP BY 1, 2 ORDER BY value DESC, tier NULLS LAST, extension NULLS LAST LIMIT 10")
def _(e):
    return stats.cross(e.claims, "tier", "extension", "bytes_total", {"machine_id": "m1"}, limit=10)


@query("stats_cross_prefix", "SELECT domain, count(DISTINCT permanode_id) AS value, false AS truncated FROM cur WHERE starts_with(file_path, '/Volumes/Level 1/') GROUP BY 1")
def _(e):
    return stats.cross(e.claims, "domain", measure="permanode_count", prefix="/Volumes/Level 1")


@query("stats_path_tree", """SELECT name, is_dir, claim_count, permanode_count, bytes_total, overlay, '/Volumes/' || name AS path, false AS truncated FROM (
 SELECT split_part(substr(file_path, 10), '/', 1) AS name, true AS is_dir, count(*) AS claim_count, count(DISTINCT permanode_id) AS permanode_count, CAST(sum(size_bytes) AS BIGINT) AS bytes_total FROM cur WHERE starts_with(file_path, '/Volumes/') GROUP BY 1)
 JOIN (SELECT name, overlay FROM (SELECT split_part(substr(file_path, 10), '/', 1) AS name, coalesce(domain, '(none)') AS overlay, row_number() OVER (PARTITION BY split_part(substr(file_path, 10), '/', 1) ORDER BY sum(size_bytes) DESC, coalesce(domain, '(none)') DESC) AS rn FROM cur WHERE starts_with(file_path, '/Volumes/') GROUP BY 1, 2) WHERE rn = 1) USING (name)""")
def _(e):
    return stats.path_tree(e.claims, "/Volumes", overlay="domain")


@query("stats_path_rollup", """, w AS (SELECT *, string_split(file_path, '/') AS parts FROM cur), x AS (SELECT permanode_id, size_bytes, domain, unnest(range(1, len(parts) + 1)) AS d, parts FROM w),
 y AS (SELECT array_to_string(parts[1:d], '/') AS path, d, d < len(parts) AS above, permanode_id, size_bytes, coalesce(domain, '(none)') AS o FROM x),
 o AS (SELECT path, o, row_number() OVER (PARTITION BY path ORDER BY sum(size_bytes) DESC, o DESC) AS n FROM y GROUP BY 1, 2)
 SELECT path, bool_or(above) AS is_dir, count(*) AS claim_count, count(DISTINCT permanode_id) AS permanode_count, CAST(sum(size_bytes) AS BIGINT) AS bytes_total, any_value(o.o) AS overlay FROM y JOIN o USING (path) WHERE o.n = 1 GROUP BY path""")
def _(e):
    """All levels of the tree, written as a table and read again."""
    path = scratch(e.spark, "rollup")
    stats.write_rollup(stats.path_rollup(e.claims, "domain"), path)
    return e.spark.read.parquet(path).select("path", "is_dir", "claim_count", "permanode_count", "bytes_total", "overlay")


@query("stats_path_tree_pages", "SELECT split_part(regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', ''), '/', 2) AS name, count(*) AS claim_count FROM pages GROUP BY 1", "x AS (SELECT 1)")
def _(e):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "")
    rows = e.read("pages").select(F.concat(path, F.lit("/_")).alias("file_path"))
    return rows.groupBy(derive.next_segment(F.col("file_path"), "/").alias("name")).agg(F.count(F.lit(1)).alias("claim_count"))


@query("stats_path_tree_presence", "SELECT DISTINCT file_path AS path, kind FROM kinds WHERE tier = 'DropboxStorage' AND is_current AND domain = 'photos'", f"{CLAIMS}, {PRESENCE}")
def _(e):
    whole = stats.current(e.claims).filter((F.col("tier") == "DropboxStorage") & (F.col("domain") == "photos")).select(F.col("file_path").alias("path"), F.col("size_bytes").alias("bytes_total")).distinct()
    return stats.path_tree_presence(whole, joins.presence(e.claims, e.store, e.mount, HOME), cap=None).select("path", "kind").distinct()


@query("stats_inventory_counts", ", ids AS (SELECT machine_id FROM claims UNION SELECT machine_id FROM runs UNION SELECT machine_id FROM log) SELECT (SELECT count(*) FROM nodes) AS permanodes, (SELECT count(*) FROM cur) AS current_claims, (SELECT count(*) FROM runs) AS scan_runs, (SELECT count(*) FROM log) AS audit_entries, (SELECT count(*) FROM ids) AS machines", f"{CLAIMS}, {RUNS}, {LOG}")
def _(e):
    return stats.inventory_counts(e.permanodes, e.claims, e.runs, e.events)


@query("stats_rollup_cache", "SELECT (SELECT count(*) FROM nodes) AS permanodes, (SELECT count(*) FROM cur) AS current_claims, 'rollup' AS counts_source")
def _(e):
    live = e.permanodes.agg(F.count(F.lit(1)).alias("permanodes")).crossJoin(stats.current(e.claims).agg(F.count(F.lit(1)).alias("current_claims")))
    return stats.rollup_cache(live.withColumn("refreshed_at", e.now - F.make_dt_interval(hours=F.lit(3))), live, e.now)


@query("stats_latest_scan", "SELECT id, root_path FROM runs WHERE finished_at IS NOT NULL ORDER BY started_at DESC, id DESC LIMIT 1", RUNS)
def _(e):
    return stats.latest_scan(e.runs).select("id", "root_path")


@query("stats_recent_runs", ", r AS (SELECT id, machine_id, finished_at IS NULL AS in_progress FROM runs WHERE root_path = '/Volumes/1-URGENT' ORDER BY id DESC LIMIT 10) SELECT *, (SELECT bool_or(in_progress) FROM r) AS any_in_progress FROM r", RUNS)
def _(e):
    return stats.recent_runs(e.runs, 10, "/Volumes/1-URGENT").select("id", "machine_id", "in_progress", "any_in_progress")


@query("stats_tail_audit", "SELECT id, machine_id, action FROM log WHERE action = 'stash_committed' ORDER BY id DESC LIMIT 20", LOG)
def _(e):
    return stats.tail_audit(e.events, 20, "stash_committed").select("id", "machine_id", "action")


SUMMARY = """, c AS (SELECT machine_id, count(*) AS claims, count(*) FILTER (is_current) AS current_claims, make_timestamp((1704067200 + min(observed)) * 1000000) AS c0, make_timestamp((1704067200 + max(observed)) * 1000000) AS c1 FROM claims GROUP BY 1), r AS (SELECT machine_id, count(*) AS runs, min(started_at) AS r0, max(started_at) AS r1 FROM runs GROUP BY 1), a AS (SELECT machine_id, count(*) AS audit_rows, min(timestamp) AS a0, max(timestamp) AS a1 FROM log GROUP BY 1)
 SELECT machine_id, coalesce(claims, 0) AS claims, coalesce(current_claims, 0) AS current_claims, coalesce(runs, 0) AS runs, coalesce(audit_rows, 0) AS audit_rows, least(c0, r0, a0) AS first_seen, greatest(c1, r1, a1) AS last_seen"""
SUMMARY_FROM = " FROM (SELECT machine_id FROM c UNION SELECT machine_id FROM r UNION SELECT machine_id FROM a) LEFT JOIN c USING (machine_id) LEFT JOIN r USING (machine_id) LEFT JOIN a USING (machine_id)"


@query("joins_machine_summary", SUMMARY + SUMMARY_FROM, f"{CLAIMS}, {RUNS}, {LOG}")
def _(e):
    return joins.machine_summary(e.claims, e.runs, e.events)


@query("stats_machine_details", SUMMARY + ", (SELECT string_agg(id, ',' ORDER BY id DESC) FROM (SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM runs x WHERE x.machine_id = m.machine_id) WHERE n <= 5) AS run_ids, (SELECT string_agg(action || ' #' || id, ',' ORDER BY id DESC) FROM (SELECT id, action, row_number() OVER (ORDER BY id DESC) AS n FROM log x WHERE x.machine_id = m.machine_id) WHERE n <= 10) AS audit_lines" + SUMMARY_FROM.replace("a)", "a) m", 1), f"{CLAIMS}, {RUNS}, {LOG}")
def _(e):
    out = stats.machine_details(joins.machine_summary(e.claims, e.runs, e.events), e.runs, e.events)
    return out.withColumns({"run_ids": F.array_join(F.transform("run_ids", lambda x: x.cast("string")), ","), "audit_lines": F.array_join("audit_lines", ",")})


@query("stats_run_totals", """, r AS (SELECT *, 'p' || (id % 7) || '.yml' AS policy FROM log WHERE action IN ('replicate_end', 'archive_end'))
 SELECT action, id, timestamp, machine_id, manifest_run_id, policy, id % 5 AS runs, id % 5 - id % 2 AS successes, id % 2 AS failures, id % 3 AS skipped, id * 1000 AS bytes FROM r WHERE id IN (SELECT max(id) FROM r GROUP BY action)""", LOG)
def _(e):
    n = lambda x: x.cast("string")
    i = F.col("id")
    # figures of a run, as its adapter writes them; every 11th payload is no JSON
    payload = F.concat(F.lit('{"policy_name":"p'), n(i % 7), F.lit('.yml","runs":'), n(i % 5), F.lit(',"successes":'), n(i % 5 - i % 2), F.lit(',"failures":'), n(i % 2), F.lit(',"skipped":'), n(i % 3), F.lit(',"bytes":'), n(i * 1000), F.lit("}"))
    return stats.run_totals(e.events.withColumn("payload", payload))


@query("stats_run_sources", ", r AS (SELECT *, id % 3 = 0 AS off, CASE WHEN id % 3 <> 0 THEN id % 4 END AS code FROM log WHERE action IN ('replicate_end', 'archive_end')) SELECT manifest_run_id, count(code) AS runs, count(*) FILTER (code = 0) AS successes, count(*) FILTER (code <> 0) AS failures, count(*) FILTER (off) AS skipped, CAST(coalesce(sum(id) FILTER (code IS NOT NULL), 0) AS BIGINT) AS bytes FROM r GROUP BY 1", LOG)
def _(e):
    i = F.col("id")
    payload = F.when(i % 3 == 0, F.lit('{"skipped":true}')).otherwise(F.concat(F.lit('{"returncode":'), (i % 4).cast("string"), F.lit(',"stats":{"bytes":'), i.cast("string"), F.lit("}}")))
    rows = e.events.withColumn("action", F.when(F.col("action") == "replicate_end", "replicate_source").when(F.col("action") == "archive_end", "archive_source").otherwise(F.col("action")))
    return stats.run_sources(rows.withColumn("payload", payload))


@query("stats_meta_kv", "SELECT k AS key, max_by(CAST(id AS VARCHAR), id) AS value FROM log WHERE k IS NOT NULL GROUP BY k", LOG)
def _(e):
    rows = e.events.select(F.substring(F.get_json_object("payload", "$.source"), 4, 99).alias("key"), F.col("id").cast("string").alias("value"), F.col("id").alias("updated_at")).filter("key IS NOT NULL")
    return stats.meta_kv(rows)


@query("stats_permanode_upsert", "SELECT permanode_id, canonical_hash, size_bytes, min(observed) AS first_seen, max(observed) AS last_seen FROM claims GROUP BY 1, 2, 3")
def _(e):
    rows = e.claims.select("canonical_hash", "size_bytes", (F.unix_seconds("observed_at") - 1704067200).alias("observed_at"), F.lit("sha256").alias("algo"))
    return stats.permanode_upsert(rows).select("permanode_id", "canonical_hash", "size_bytes", F.col("first_seen_at").alias("first_seen"), F.col("last_seen_at").alias("last_seen"))


@query("stats_hashes_upsert", "SELECT permanode_id, extension AS algo, min_by(base, claim_id) AS hex FROM claims WHERE extension IS NOT NULL GROUP BY 1, 2")
def _(e):
    rows = e.claims.filter("extension IS NOT NULL").select("permanode_id", F.col("extension").alias("algo"), derive.basename(F.col("file_path")).alias("hex"), F.col("claim_id").alias("computed_at"))
    return stats.hashes_upsert(rows)


@query("stats_supersede_claims", "SELECT machine_id, file_path, max(scan_run_id) AS scan_run_id, count(*) AS sightings FROM lines GROUP BY 1, 2", LINES)
def _(e):
    marked = stats.supersede_claims(e.line_claims)
    return marked.groupBy("machine_id", "file_path").agg(F.max(F.when(F.col("is_current"), F.col("scan_run_id"))).alias("scan_run_id"), F.count(F.lit(1)).alias("sightings"))


@query("setops_union_all", "SELECT source, count(*) AS n FROM (SELECT 'local' AS source FROM claims UNION ALL SELECT 'attached' FROM claims WHERE machine_id = 'm2') GROUP BY 1")
def _(e):
    return files.fan_out(e.claims, e.claims.filter("machine_id = 'm2'").drop("domain")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("setops_union_distinct", "SELECT machine_id FROM claims UNION SELECT machine_id FROM runs UNION SELECT machine_id FROM log", f"{CLAIMS}, {RUNS}, {LOG}")
def _(e):
    return stats.union_distinct([t.select("machine_id") for t in (e.claims, e.runs, e.events)])


@query("setops_name_divergence", ", s AS (SELECT DISTINCT base AS name FROM rel WHERE relative IS NOT NULL AND doc_id % 5 <> 0), m AS (SELECT DISTINCT base AS name FROM rel WHERE relative IS NOT NULL AND doc_id % 7 <> 0) SELECT CASE WHEN s.name IS NULL THEN 'mount_only' WHEN m.name IS NULL THEN 'store_only' ELSE 'both' END AS side, count(*) AS names FROM s FULL JOIN m ON s.name = m.name GROUP BY 1", f"{CLAIMS}, {PRESENCE}")
def _(e):
    name = derive.basename(F.col("relative")).alias("name")
    return stats.name_divergence(e.store.select(name), e.mount.select(name))


@query("window_latest_per_key", "SELECT machine_id, action, max(id) AS id, max_by(manifest_run_id, id) AS manifest_run_id FROM log GROUP BY 1, 2", LOG)
def _(e):
    return stats.latest_per_key(e.events, ["machine_id", "action"], [F.desc("id")]).select("machine_id", "action", "id", "manifest_run_id")


@query("window_last_n_per_key", "SELECT machine_id, id FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY id DESC) AS n FROM log) WHERE n <= 20", LOG)
def _(e):
    return stats.last_n_per_key(e.events, ["machine_id"], [F.desc("id")], 20).select("machine_id", "id")


@query("window_chain_lag", "SELECT id, lag(action) OVER (PARTITION BY machine_id ORDER BY id) AS before FROM log", LOG)
def _(e):
    return e.events.select("id", F.lag("action").over(Window.partitionBy("machine_id").orderBy("id")).alias("before"))


# joins ----------------------------------------------------------------------


@query("joins_current_claims", "SELECT claim_id, permanode_id, n.canonical_hash FROM cur JOIN nodes n USING (permanode_id) WHERE container_path IS NULL")
def _(e):
    return joins.current_claims(e.claims.drop("canonical_hash"), e.permanodes).select("claim_id", "permanode_id", "canonical_hash")


@query("joins_inspect", """, t AS (SELECT permanode_id AS target FROM claims WHERE doc_id % 3 = 0 UNION SELECT canonical_hash FROM claims WHERE doc_id % 3 = 1 UNION SELECT file_path FROM claims WHERE doc_id % 3 = 2),
 f AS (SELECT target, 1 AS how, 0 AS o, permanode_id FROM t JOIN nodes ON target = permanode_id UNION ALL SELECT target, 2, 0, permanode_id FROM t JOIN nodes ON target = canonical_hash UNION ALL SELECT target, 4, CASE WHEN is_current THEN 0 ELSE 1 END * (1::BIGINT << 60) - claim_id, permanode_id FROM t JOIN claims ON target = file_path)
 SELECT target, how, permanode_id FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY how, o, permanode_id) AS n FROM f) WHERE n = 1""")
def _(e):
    c, k = e.claims, F.col("claim_id") % 3
    targets = c.filter(k == 0).select(F.col("permanode_id").alias("target")).union(c.filter(k == 1).select("canonical_hash")).union(c.filter(k == 2).select("file_path"))
    none = c.select("permanode_id", F.lit("-").alias("hex")).filter("false")
    return joins.inspect(targets, e.permanodes, none, c.select("file_path", "claim_id", "is_current", "permanode_id"))


NAMED = """, heard AS (SELECT permanode_id, l.id, row_number() OVER (PARTITION BY permanode_id ORDER BY l.id DESC) AS rn FROM claims JOIN log l ON l.id % 500 = doc_id),
 told AS (SELECT permanode_id, string_agg(id, ',' ORDER BY id DESC) AS audit_ids FROM heard WHERE rn <= 20 GROUP BY 1)"""


@query("joins_get_permanode", NAMED + " SELECT permanode_id, n.canonical_hash, n.size_bytes, claim_id, file_path, machine_id, is_current, coalesce(audit_ids, '') AS audit_ids FROM claims JOIN nodes n USING (permanode_id) LEFT JOIN told USING (permanode_id)", f"{CLAIMS}, {LOG}")
def _(e):
    named = e.events.drop("permanode_id").join(e.claims.select("permanode_id", "claim_id"), F.col("id") % 500 == F.col("claim_id"))
    out = joins.get_permanode(e.permanodes.select("permanode_id"), e.permanodes, e.claims, named)
    ids = F.coalesce(F.array_join(F.transform("audit_ids", lambda x: x.cast("string")), ","), F.lit(""))
    return out.select("permanode_id", "canonical_hash", "size_bytes", "claim_id", "file_path", "machine_id", "is_current", ids.alias("audit_ids"))


@query("joins_claims_of", "SELECT claim_id FROM claims WHERE permanode_id = (SELECT min(permanode_id) FROM claims)")
def _(e):
    return joins.claims_of(e.claims, e.claims.agg(F.min("permanode_id")).first()[0]).select("claim_id")


@query("joins_filter_machine", "SELECT claim_id FROM claims WHERE starts_with(machine_id, 'm1')")
def _(e):
    return joins.filter_machine(e.claims, "m1").select("claim_id")


@query("joins_has_current_claim", "SELECT permanode_id FROM nodes WHERE permanode_id IN (SELECT permanode_id FROM cur)")
def _(e):
    return joins.has_current_claim(e.permanodes, e.claims).select("permanode_id")


@query("joins_not_embedded", f"SELECT permanode_id, claim_id FROM (SELECT *, row_number() OVER (PARTITION BY permanode_id ORDER BY {priority_sql('tier')}, claim_id) AS n FROM cur) WHERE n = 1 AND permanode_id NOT IN (SELECT permanode_id FROM claims WHERE doc_id % 3 = 0)")
def _(e):
    done = e.claims.filter("claim_id % 3 = 0").select("permanode_id", F.lit("m").alias("model_name"), F.lit("1").alias("model_version"))
    return joins.not_embedded(e.permanodes, e.claims, done, "m", "1").select("permanode_id", "claim_id")


PLAN = ", pl AS (SELECT claim_id AS row_id, permanode_id, file_path AS source_path, size_bytes, canonical_hash FROM cur)"


def _plan(e, extra=()):
    return stats.current(e.claims).select(F.col("claim_id").alias("row_id"), "permanode_id", F.col("file_path").alias("source_path"), "size_bytes", "canonical_hash", *extra)


@query("joins_preflight", PLAN + " SELECT row_id, permanode_id, 'm' || min(CAST(substr(c.machine_id, 2) AS INT)) AS attached_machine_id FROM pl JOIN claims c USING (permanode_id) WHERE permanode_id NOT IN (SELECT permanode_id FROM cur WHERE machine_id = 'm0') AND c.machine_id <> 'm0' GROUP BY 1, 2")
def _(e):
    away = e.claims.filter("machine_id <> 'm0'").select("permanode_id", F.substring("machine_id", 2, 9).cast("int").alias("registry_order"), F.col("machine_id").alias("attached_machine_id"))
    return joins.preflight(_plan(e).select("row_id", "permanode_id"), e.claims.filter("machine_id = 'm0'"), away).select("row_id", "permanode_id", "attached_machine_id")


@query("joins_other_copies", PLAN + ", o AS (SELECT row_id, permanode_id, c.file_path FROM pl JOIN cur c USING (permanode_id) WHERE c.file_path <> source_path) SELECT row_id, pl.permanode_id, count(o.file_path) AS copies, count(o.file_path) = 0 AS last_copy, string_agg(o.file_path, ',' ORDER BY o.file_path) FILTER (o.n <= 5) AS paths FROM pl LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY file_path) AS n FROM o) o USING (row_id) GROUP BY 1, 2")
def _(e):
    return joins.other_copies(_plan(e), e.claims, HOME).withColumn("paths", F.array_join("paths", ","))


@query("joins_canonical_outside", PLAN + ", o AS (SELECT permanode_id, min(file_path) AS p FROM cur WHERE NOT starts_with(file_path, '/Volumes/Level 1/') AND NOT starts_with(file_path, '/Users/ana/') GROUP BY 1) SELECT row_id, p AS canonical_path FROM pl LEFT JOIN o USING (permanode_id)")
def _(e):
    return joins.canonical_outside(_plan(e), e.claims, ["/Volumes/Level 1", "/Users/ana"]).select("row_id", "canonical_path")


@query("joins_presence", "SELECT claim_id, kind FROM kinds", f"{CLAIMS}, {PRESENCE}")
def _(e):
    return joins.presence(e.claims, e.store, e.mount, HOME).select("claim_id", "kind")


@query("stats_presence_counts", "SELECT machine_id, count(*) AS counted, count(*) FILTER (kind = 'dual') AS dual, count(*) FILTER (kind = 'store_only') AS store_only, CAST(sum(size_bytes) FILTER (kind = 'dual') AS BIGINT) AS dual_bytes, round(count(*) FILTER (kind = 'dual') / (count(*) FILTER (kind IN ('dual', 'store_only'))), 6) AS cloud_safe_ratio FROM kinds GROUP BY 1", f"{CLAIMS}, {PRESENCE}")
def _(e):
    return stats.presence_counts(joins.presence(e.claims, e.store, e.mount, HOME), ["machine_id"]).select("machine_id", "counted", "dual", "store_only", "dual_bytes", F.round("cloud_safe_ratio", 6).alias("cloud_safe_ratio"))


FRESH = f""", dn AS (SELECT *, row_number() OVER (PARTITION BY machine_id, root_path ORDER BY finished_at DESC, id DESC) AS n FROM runs WHERE finished_at IS NOT NULL), d1 AS (SELECT machine_id, root_path, id AS run_id, finished_at FROM dn WHERE n = 1), op AS (SELECT machine_id, root_path, max(started_at) AS unfinished_started_at FROM runs WHERE finished_at IS NULL GROUP BY 1, 2),
 fresh AS (SELECT machine_id, root_path, run_id, finished_at, unfinished_started_at, CASE WHEN finished_at IS NULL OR epoch(TIMESTAMP '{NOW}' - finished_at) / 3600.0 > 168 THEN 'fail' ELSE 'ok' END AS level FROM d1 FULL JOIN op USING (machine_id, root_path))"""


@query("joins_scan_freshness", FRESH + " SELECT machine_id, root_path, run_id, level, unfinished_started_at IS NOT NULL AS unfinished FROM fresh", RUNS)
def _(e):
    return joins.scan_freshness(e.runs, e.now).select("machine_id", "root_path", "run_id", "level", F.col("unfinished_started_at").isNotNull().alias("unfinished"))


@query("joins_verify_content", PLAN + " SELECT row_id, CASE WHEN row_id % 7 = 0 THEN 'missing' WHEN row_id % 5 = 0 THEN 'mismatch' ELSE 'would_succeed' END AS outcome FROM pl")
def _(e):
    there = e.claims.filter("claim_id % 7 <> 0").select(F.col("file_path").alias("path"), F.when(F.col("claim_id") % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), F.col("canonical_hash").alias("hash"))
    return joins.verify_content(_plan(e, [F.lit(None).cast("string").alias("destination_path")]), there).select("row_id", "outcome")


@query("joins_seed_plan", "SELECT 'retire_direct' AS action, permanode_id, canonical_hash, size_bytes, file_path AS source_path, tier AS source_tier, (SELECT count(*) FROM cur WHERE starts_with(file_path, '/Volumes/DropboxStorage/')) > 25 AS truncated FROM cur WHERE starts_with(file_path, '/Volumes/DropboxStorage/') ORDER BY size_bytes DESC, file_path LIMIT 25")
def _(e):
    return joins.seed_plan(e.claims.drop("canonical_hash"), e.permanodes, "/Volumes/DropboxStorage", "retire_direct", 25)


@query("query_find_by_path", "SELECT claim_id, permanode_id, file_path FROM cur WHERE contains(file_path, '/Photos/') ORDER BY permanode_id, file_path LIMIT 10")
def _(e):
    return joins.find_by_path(e.claims.drop("canonical_hash"), e.permanodes, "/Photos/").select("claim_id", "permanode_id", "file_path")


@query("query_find_by_hash", "SELECT permanode_id, canonical_hash FROM nodes WHERE starts_with(canonical_hash, 'a') ORDER BY canonical_hash, permanode_id LIMIT 10")
def _(e):
    return joins.find_by_hash(e.permanodes, "a").select("permanode_id", "canonical_hash")


@query("joins_plan_audit_rows", "SELECT id, action FROM log WHERE manifest_run_id = 'run3'", LOG)
def _(e):
    return joins.plan_audit_rows(e.events, "run3").select("id", "action")


# plans ----------------------------------------------------------------------

RANKED = f""", ok AS (SELECT * FROM cur WHERE container_path IS NULL AND NOT contains(file_path, '/misc/')),
 biased AS (SELECT *, contains(file_path, '/Photos/') AS rec, bool_or(contains(file_path, '/Photos/')) OVER w AND bool_or(NOT contains(file_path, '/Photos/')) OVER w AS mixed, count(*) OVER w AS n FROM ok WINDOW w AS (PARTITION BY permanode_id)),
 ranked AS (SELECT *, row_number() OVER o AS rank, first_value(tier) OVER o AS keeper_tier, first_value(file_path) OVER o AS keeper_path FROM biased WHERE n > 1 WINDOW o AS (PARTITION BY permanode_id ORDER BY CASE WHEN mixed AND rec THEN 1 ELSE 0 END, {priority_sql('tier')}, claim_id)),
 retire AS (SELECT *, CASE WHEN tier = 'DropboxStorage' THEN 'retire_direct' WHEN tier IN ('boot','L1','L1w','L2','L3a') THEN 'stash' WHEN tier = 'Backup' THEN 'nas_manifest' END AS action FROM ranked WHERE rank > 1 AND NOT (tier = keeper_tier AND file_path = keeper_path))"""
POLICY = plan.retention_of({"version": 1, "kind": "RetentionPolicy", "exclusions": {"always_skip_substrings": ["/misc/"], "basename_prefixes": ["._"]}, "dedup_retire": {"tier_priority": derive.TIER_PRIORITY, "live_tiers": ["boot", "L1", "L1w", "L2", "L3a", "DropboxStorage"], "stash_roots": {"L2": "/Volumes/Level 2/_stash"}, "nas_manifest_tiers": ["Backup"], "recovered_substrings": ["/Photos/"]}})


def _retire(e):
    return plan.dedup_retire(joins.current_claims(e.kept_claims.drop("canonical_hash"), e.kept_permanodes), POLICY, "r1")


@query("plan_dedup_retire", RANKED + """ SELECT claim_id, action, permanode_id, file_path AS source_path, tier AS source_tier, CASE WHEN action = 'stash' THEN CASE WHEN tier = 'L2' THEN '/Volumes/Level 2/_stash/r1/' || base ELSE regexp_replace(file_path, '/[^/]*$', '') || '/_cooling-off-stash/r1/' || base END END AS destination_path,
 CASE WHEN action = 'retire_direct' THEN 'dropbox-cloud-trash-account-specific' ELSE tier END AS destination_tier, 'dedup of permanode ' || permanode_id || '; canonical lives on ' || keeper_tier || ' (' || keeper_path || ')' AS rationale FROM retire WHERE action IS NOT NULL""")
def _(e):
    return _retire(e).select("claim_id", "action", "permanode_id", "source_path", "source_tier", "destination_path", "destination_tier", "rationale")


@query("plan_action_counts", RANKED + " SELECT action, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes_total FROM retire WHERE action IS NOT NULL GROUP BY 1")
def _(e):
    return stats.action_counts(_retire(e)).drop("manifest_run_id")


@query("plan_keeper_rank", RANKED + " SELECT claim_id, rank, keeper_path FROM ranked")
def _(e):
    rows = joins.current_claims(e.kept_claims.drop("canonical_hash"), e.kept_permanodes).filter(~F.col("file_path").contains("/misc/"))
    many = rows.groupBy("permanode_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return plan.keeper_rank(rows.join(many, "permanode_id", "left_semi"), POLICY).select("claim_id", F.col("rank").cast("long").alias("rank"), F.col("keeper.file_path").alias("keeper_path"))


@query("plan_source_only", "SELECT permanode_id FROM cur GROUP BY 1 HAVING bool_and(tier = 'Backup')")
def _(e):
    return plan.source_only(stats.current(e.claims), "Backup")


PROMOTION = plan.promotion_of({"version": 1, "kind": "PromotionPolicy", "defaults": {"path_translations": [{"from": "/Volumes/NFS-Backup/", "to": "/Volumes/Backup/"}]}, "phases": [
    {"name": "photos", "match": {"domain": "photos"}, "destination_root": "/Volumes/Level 2/Photos", "mirror_from": "/Photos/"},
    {"name": "docs", "match": {"domain": "documents"}, "destination_root": "/Volumes/Level 2/Docs"},
    {"name": "rest", "match": {"path_contains": "/Backup/"}, "destination_root": "/Volumes/Level_3a/Rest"},
]})
PHASES = PROMOTION.phases
PHASE_CASE = "CASE WHEN domain = 'photos' THEN 'photos' WHEN domain = 'documents' THEN 'docs' WHEN contains(file_path, '/Backup/') THEN 'rest' END"


@query("plan_phase_match", f"SELECT claim_id, {PHASE_CASE} AS phase FROM claims")
def _(e):
    names = F.array(*[F.lit(p.name) for p in PHASES])
    return e.claims.select("claim_id", F.get(names, plan.phase_match(PHASES, F.col("domain"), F.col("file_path"))).alias("phase"))


@query("plan_promote", f""", only_ AS (SELECT permanode_id FROM cur GROUP BY 1 HAVING bool_and(tier = 'Backup')), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY permanode_id ORDER BY claim_id) AS n FROM cur WHERE permanode_id IN (SELECT * FROM only_)) WHERE n = 1), ph AS (SELECT *, {PHASE_CASE} AS phase FROM one)
 SELECT claim_id, permanode_id, phase, CASE WHEN starts_with(file_path, '/Volumes/NFS-Backup/') THEN '/Volumes/Backup/' || substr(file_path, 21) ELSE file_path END AS source_path, CASE phase WHEN 'photos' THEN '/Volumes/Level 2/Photos/' || base WHEN 'docs' THEN '/Volumes/Level 2/Docs/' || base ELSE '/Volumes/Level_3a/Rest/' || base END AS destination_path FROM ph WHERE phase IS NOT NULL""")
def _(e):
    return PROMOTION.promote(stats.current(e.kept_claims)).select("claim_id", "permanode_id", "phase", "source_path", "destination_path")


def _backlog(e):
    o = e.read("orders")
    return o.select(F.col("o_orderkey").cast("string").alias("plan_id"), (F.col("o_orderkey") % 4 * 700).alias("rows_total"), (F.col("o_custkey") % 5 != 0).alias("manifest_exists"), (F.col("o_custkey") % 3).alias("dry_run_errors"), (F.col("o_orderkey") % 4 * 500).alias("retire_direct"), (F.col("o_custkey") % 2 == 0).alias("cloud_retire_ready"), F.lit(False).alias("has_filter"), F.array(F.lit("/Volumes/DropboxStorage/a")).alias("sample_paths"), F.lit(2000).cast("long").alias("cap"), (F.col("o_custkey") % 7 == 0).alias("stale"), F.lit(0).alias("dry_run_ok"))


@query("plan_blocked_reasons", """SELECT CAST(o_orderkey AS VARCHAR) AS plan_id, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'empty_plan' END, CASE WHEN o_custkey % 5 = 0 THEN 'manifest_missing' END, CASE WHEN o_custkey % 3 > 0 THEN 'dry_run_errors' END, CASE WHEN o_orderkey % 4 > 0 AND o_custkey % 2 <> 0 THEN 'fp_not_ready' END, CASE WHEN o_orderkey % 4 * 500 >= 1000 THEN 'dual_presence_unfiltered' END, CASE WHEN o_orderkey % 4 * 700 > 2000 THEN 'oversize_for_mcp' END, CASE WHEN o_custkey % 7 = 0 THEN 'stale_inventory' END) AS reasons FROM orders""", "x AS (SELECT 1)")
def _(e):
    return _backlog(e).select("plan_id", F.array_join(plan.blocked_reasons(), ",").alias("reasons"))


@query("plan_register", RANKED + " SELECT 'r1' AS plan_id, count(*) AS rows_total, CAST(sum(size_bytes) AS BIGINT) AS estimated_bytes, count(*) FILTER (action = 'retire_direct') AS retire_direct, 'registered' AS status FROM retire WHERE action IS NOT NULL")
def _(e):
    return plan.register(_retire(e), e.now).select("plan_id", "rows_total", "estimated_bytes", "retire_direct", "status")


@query("plan_list", "SELECT plan_id, write_ts FROM (SELECT manifest_run_id AS plan_id, max(id) AS write_ts FROM log GROUP BY 1) ORDER BY write_ts DESC, plan_id LIMIT 5", LOG)
def _(e):
    return plan.list_plans(e.events.select(F.col("manifest_run_id").alias("plan_id"), F.col("id").alias("write_ts")), limit=5)


@query("plan_refresh_status", "SELECT run AS plan_id, CASE WHEN done >= 100 THEN 'applied' ELSE 'partially_applied' END AS status, done FROM (SELECT manifest_run_id AS run, count(*) AS done FROM log WHERE action = 'stash_committed' GROUP BY 1)", LOG)
def _(e):
    plans = e.events.filter("action = 'stash_committed'").select(F.col("manifest_run_id").alias("plan_id"), F.lit(100).alias("rows_total"), F.array().cast("array<string>").alias("blocked_reasons"), F.lit(0).alias("dry_run_errors"), F.lit(0).alias("dry_run_ok")).distinct()
    return plan.refresh_status(plans, e.events).select("plan_id", "status", "done")


@query("plan_prune", "SELECT CAST(o_orderkey AS VARCHAR) AS plan_id FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 1000 DAY", "x AS (SELECT 1)")
def _(e):
    rows = e.read("orders").select(F.col("o_orderkey").cast("string").alias("plan_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return plan.prune(rows, F.lit("2001-01-01").cast("timestamp"), 1000, dry_run=True).select("plan_id")


@query("plan_filter_presence", "SELECT claim_id AS row_id, kind FROM kinds WHERE is_current AND kind IN ('dual', 'store_only')", f"{CLAIMS}, {PRESENCE}")
def _(e):
    return plan.filter_presence(_plan(e), joins.presence(e.claims, e.store, e.mount, HOME), "local_reclaim").select("row_id", "kind")


@query("plan_bulk_prep", "SELECT kind, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes_total, kind = 'dual' AS selected FROM kinds WHERE is_current GROUP BY kind", f"{CLAIMS}, {PRESENCE}")
def _(e):
    rows = _plan(e, [F.lit("r1").alias("manifest_run_id")])
    return plan.bulk_prep(rows, joins.presence(e.claims, e.store, e.mount, HOME)).select("kind", "n", "bytes_total", "selected")


@query("plan_presence_sample", "SELECT claim_id, file_path FROM cur WHERE tier = 'DropboxStorage' ORDER BY claim_id LIMIT 32")
def _(e):
    return plan.presence_sample(e.claims).select("claim_id", "file_path")


@query("plan_presence_ready", "SELECT count(*) > 0 AND count(*) FILTER (kind = 'dual') > 0 AS ready FROM kinds", f"{CLAIMS}, {PRESENCE}")
def _(e):
    return plan.presence_ready(stats.presence_counts(joins.presence(e.claims, e.store, e.mount, HOME)), True).select("ready")


@query("plan_needs_cloud_gate", RANKED + " SELECT 'r1' AS manifest_run_id, bool_or(action = 'retire_direct') AS needs_gate FROM retire WHERE action IS NOT NULL")
def _(e):
    return plan.needs_cloud_gate(_retire(e))


SIM = RANKED + ", sim AS (SELECT claim_id, action, CASE WHEN claim_id % 3 = 0 THEN 'content missing' END AS error, row_number() OVER (PARTITION BY claim_id % 3 = 0 ORDER BY claim_id) AS nth, file_path FROM retire WHERE action IS NOT NULL)"


def _simulated(e):
    rows = _retire(e).withColumn("row_id", F.col("claim_id")).withColumn("check", F.when(F.col("claim_id") % 3 == 0, "missing").otherwise("would_succeed"))
    return plan.simulate(rows, 20)


@query("plan_simulate", SIM + " SELECT claim_id, error, CASE WHEN error IS NOT NULL THEN 'errored' WHEN nth > 20 THEN 'skipped' ELSE 'applied' END AS outcome FROM sim")
def _(e):
    return _simulated(e).select("claim_id", "error", "outcome")


@query("plan_dry_run_digest", SIM + " SELECT count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (error IS NULL AND nth <= 20) AS applied, count(*) FILTER (error IS NULL AND nth > 20) AS skipped, count(*) FILTER (error IS NOT NULL) = 0 AS ok FROM sim")
def _(e):
    return plan.dry_run_digest(_simulated(e).withColumn("plan_id", F.col("manifest_run_id"))).drop("plan_id")


@query("plan_record_outcomes", SIM + " SELECT claim_id, is_current AND NOT (claim_id IN (SELECT claim_id FROM sim WHERE action = 'retire_direct' AND error IS NULL AND nth <= 20)) AS is_current FROM claims")
def _(e):
    return plan.record_outcomes(_simulated(e), e.claims, HOME).select("claim_id", "is_current")


@query("plan_outcome_events", SIM + " SELECT CASE action WHEN 'stash' THEN 'stash_committed' WHEN 'retire_direct' THEN 'retire_direct_executed' ELSE 'nas_manifest_exported' END AS action, count(*) AS n FROM sim WHERE error IS NULL AND nth <= 20 GROUP BY 1 UNION ALL SELECT 'apply_start', 1 UNION ALL SELECT 'apply_end', 1")
def _(e):
    return plan.outcome_events(_simulated(e)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("stash_in_flight", f"SELECT manifest_run_id, count(*) AS entries, round(max(epoch(TIMESTAMP '{NOW}' - timestamp) / 3600.0), 6) AS oldest_age_hours FROM flying GROUP BY 1", LOG)
def _(e):
    return stash.in_flight(e.events, e.now).withColumn("oldest_age_hours", F.round("oldest_age_hours", 6))


@query("stash_summary", "SELECT machine_id, count(*) AS in_flight, count(DISTINCT manifest_run_id) AS runs FROM flying GROUP BY 1", LOG)
def _(e):
    return stash.summary(e.events, ["machine_id"]).select("machine_id", "in_flight", "runs")


@query("stash_due", f"SELECT id, CASE WHEN epoch(TIMESTAMP '{NOW}' - timestamp) / 3600.0 >= 2400 THEN 'due' ELSE 'skipped_young' END AS state FROM flying", LOG)
def _(e):
    return stash.due(e.events, e.now, 100).select("id", "state")


def _listing(e):
    both = e.events.select(F.get_json_object("payload", "$.source").alias("s"), F.get_json_object("payload", "$.destination").alias("d"), F.substring(F.get_json_object("payload", "$.source"), 4, 9).cast("long").alias("k"))
    return both.filter("k % 3 = 0").select(F.col("s").alias("path")).union(both.filter("k % 5 <> 0").select("d")).distinct()


@query("stash_restorable", "SELECT id, CASE WHEN CAST(substr(source, 4) AS INT) % 5 = 0 THEN 'errored' WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN 'skipped_occupied' ELSE 'restored' END AS state FROM flying", LOG)
def _(e):
    return stash.restorable(stash.entries(e.events), _listing(e)).select("id", "state")


@query("stash_verify", "SELECT id, CASE WHEN CAST(substr(source, 4) AS INT) % 5 = 0 THEN 'dst-missing' WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN 'src-still-present' ELSE 'no-permanode' END AS state FROM flying", LOG)
def _(e):
    return stash.verify(stash.entries(e.events), _listing(e), e.claims, ["/s"]).select("id", "state")


# logs -----------------------------------------------------------------------


COLUMNS = ["action", "manifest_run_id", "payload"]


def _chained(e):
    """The log as chains, one a machine."""
    rows = e.events.select("machine_id", "id", *COLUMNS)
    return audit.append_batch(rows.withColumn("row_hash", F.lit("")).filter("false"), rows, COLUMNS), COLUMNS


def _tampered(e):
    """The chained log with payloads changed afterwards, on two of the machines."""
    odd = (F.col("id") % 97 == 96) & (F.col("machine_id") != "m1")
    return stored(_chained(e)[0], "chain").withColumn("payload", F.when(odd, F.lit("{}")).otherwise(F.col("payload")))


BROKEN = ", n AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY id) AS rn FROM log), b AS (SELECT machine_id, min(id) AS bad_id, min(rn) AS rn FROM n WHERE id % 97 = 96 AND machine_id <> 'm1' GROUP BY 1), v AS (SELECT machine_id, b.bad_id IS NULL AS ok, coalesce(b.rn - 1, count(*)) AS rows_checked, b.bad_id, CASE WHEN b.bad_id IS NOT NULL THEN 'row_hash mismatch' END AS message FROM log LEFT JOIN b USING (machine_id) GROUP BY machine_id, b.bad_id, b.rn)"


@query("audit_verify_chain", BROKEN + " SELECT * FROM v", LOG)
def _(e):
    return audit.verify_chain(_tampered(e), COLUMNS)


@query("audit_append_and_verify", "SELECT machine_id, true AS ok, count(*) AS rows_checked FROM log GROUP BY 1", LOG)
def _(e):
    chained, columns = _chained(e)
    return audit.verify_chain(stored(chained, "chain"), columns).select("machine_id", "ok", "rows_checked")


def _one_chain(e):
    """All machines' rows as one chain."""
    rows = e.events.select(F.lit("all").alias("machine_id"), "id", *COLUMNS)
    return audit.append_batch(rows.withColumn("row_hash", F.lit("")).filter("false"), rows, COLUMNS)


@query("audit_verify_long_chain", ", b AS (SELECT min(id) AS bad FROM log WHERE id % 997 = 996) SELECT bad IS NULL AS ok, (SELECT count(*) FROM log WHERE bad IS NULL OR id < bad) AS rows_checked, bad AS bad_id FROM b", LOG)
def _(e):
    bad = stored(_one_chain(e), "chain").withColumn("payload", F.when(F.col("id") % 997 == 996, F.lit("{}")).otherwise(F.col("payload")))
    return audit.verify_long_chain(bad, 8, COLUMNS).select("ok", "rows_checked", "bad_id")


@query("audit_resolve_before", "SELECT max(id) AS through_id FROM log WHERE timestamp < (SELECT max(timestamp) - INTERVAL 30 DAY FROM log)", LOG)
def _(e):
    top = e.events.agg((F.max("timestamp") - F.make_interval(days=F.lit(30))).alias("_t"))
    return audit.resolve_before(e.events.crossJoin(F.broadcast(top)), F.col("_t"))


@query("audit_plan_segment", "SELECT min(id) AS first_id, max(id) AS last_id, count(*) AS row_count, (SELECT count(*) FROM log WHERE id > 500) AS hot_rows, CASE WHEN count(*) <> max(id) - min(id) + 1 THEN 'gap in ids' WHEN (SELECT count(*) FROM log WHERE id > 500) < 100 THEN 'too few rows left hot' END AS refused FROM log WHERE id <= 500", LOG)
def _(e):
    return audit.plan_segment(_one_chain(e), 500).select("first_id", "last_id", "row_count", "hot_rows", "refused")


@query("audit_export", "SELECT id, action FROM log WHERE action IN ('stash_committed', 'stash_restored') ORDER BY id LIMIT 50", LOG)
def _(e):
    return sinks.export_audit(e.events, actions=["stash_committed", "stash_restored"], limit=50).select("id", "action")


# health ---------------------------------------------------------------------

@query("health_stale_scan", FRESH + " SELECT machine_id, 'stale_scan' AS name, CASE WHEN count(*) FILTER (level = 'fail') > 0 THEN 'fail' WHEN count(unfinished_started_at) > 0 THEN 'warn' ELSE 'ok' END AS level, CASE WHEN count(*) FILTER (level = 'fail') > 0 THEN count(*) FILTER (level = 'fail') || ' stale or unfinished roots' WHEN count(unfinished_started_at) > 0 THEN count(unfinished_started_at) || ' scans in progress' ELSE '' END AS message FROM fresh GROUP BY 1", RUNS)
def _(e):
    return health.stale_scan(joins.scan_freshness(e.runs, e.now))


@query("health_stash_overdue", f"SELECT machine_id, 'stash_overdue' AS name, CASE WHEN epoch(TIMESTAMP '{NOW}' - min(timestamp)) / 3600.0 > 192 THEN 'fail' ELSE 'ok' END AS level, '' AS message FROM flying GROUP BY 1", LOG)
def _(e):
    return health.stash_overdue(stash.summary(e.events, ["machine_id"]), e.now)


@query("health_dual_presence", ", p AS (SELECT machine_id, count(*) FILTER (kind = 'dual') AS d, count(*) FILTER (kind = 'store_only') AS s FROM kinds GROUP BY 1) SELECT machine_id, 'dual_presence_poor' AS name, CASE WHEN d + s = 0 THEN 'unknown' WHEN d / (d + s) < 0.5 THEN 'fail' ELSE 'ok' END AS level, '' AS message FROM p", f"{CLAIMS}, {PRESENCE}")
def _(e):
    return health.dual_presence_poor(stats.presence_counts(joins.presence(e.claims, e.store, e.mount, HOME), ["machine_id"]))


@query("health_adapters", f"SELECT machine_id, 'adapters' AS name, CASE WHEN epoch(TIMESTAMP '{NOW}' - max(timestamp)) / 3600.0 > 168 THEN 'warn' ELSE 'ok' END AS level, action AS message FROM log WHERE action IN ('replicate_end', 'archive_end') GROUP BY machine_id, action", LOG)
def _(e):
    return health.adapter_freshness(e.events, e.now)


def _checks(e):
    gate = e.runs.select("machine_id").distinct().select("machine_id", (F.col("machine_id") != "m0").alias("present"), (F.col("machine_id") == "m1").alias("ready"), F.when(F.col("machine_id") == "m2", F.array(F.lit("layout"))).otherwise(F.array().cast("array<string>")).alias("problems"))
    return health.checks([health.stale_scan(joins.scan_freshness(e.runs, e.now)), health.stash_overdue(stash.summary(e.events, ["machine_id"]), e.now), health.cloud_gate(gate)])


ALL = FRESH + f""", al AS (SELECT machine_id, 'stale_scan' AS name, CASE WHEN count(*) FILTER (level = 'fail') > 0 THEN 'fail' WHEN count(unfinished_started_at) > 0 THEN 'warn' ELSE 'ok' END AS level, CASE WHEN count(*) FILTER (level = 'fail') > 0 THEN count(*) FILTER (level = 'fail') || ' stale or unfinished roots' WHEN count(unfinished_started_at) > 0 THEN count(unfinished_started_at) || ' scans in progress' ELSE '' END AS message FROM fresh GROUP BY 1
 UNION ALL SELECT machine_id, 'stash_overdue', CASE WHEN epoch(TIMESTAMP '{NOW}' - min(timestamp)) / 3600.0 > 192 THEN 'fail' ELSE 'ok' END, '' FROM flying GROUP BY 1
 UNION ALL SELECT machine_id, 'fp_not_ready', CASE machine_id WHEN 'm0' THEN 'skipped' WHEN 'm1' THEN 'ok' ELSE 'fail' END, CASE machine_id WHEN 'm2' THEN 'layout' ELSE '' END FROM (SELECT DISTINCT machine_id FROM runs))"""


@query("health_checks", ALL + " SELECT * FROM al", f"{RUNS}, {LOG}")
def _(e):
    return _checks(e)


@query("health_overall", ALL + " SELECT machine_id, CASE max(CASE level WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' WHEN 1 THEN 'unknown' ELSE 'ok' END AS overall, CAST(greatest(0, 100 - sum(CASE level WHEN 'fail' THEN 35 WHEN 'warn' THEN 12 WHEN 'unknown' THEN 4 ELSE 0 END)) AS INT) AS score FROM al GROUP BY 1", f"{RUNS}, {LOG}")
def _(e):
    c = _checks(e)
    return health.overall(c).join(health.score(c), "machine_id")


@query("health_fail_on", ALL + " SELECT machine_id, name FROM al WHERE level = 'fail' AND name IN ('stale_scan', 'fp_not_ready')", f"{RUNS}, {LOG}")
def _(e):
    return health.fail_on(_checks(e), ("stale_scan", "fp_not_ready")).select("machine_id", "name")


@query("health_report", ALL + ", k AS (SELECT machine_id, count(*) AS claims FROM claims GROUP BY 1), g AS (SELECT machine_id, CASE max(CASE level WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' WHEN 1 THEN 'unknown' ELSE 'ok' END AS overall, CAST(greatest(0, 100 - sum(CASE level WHEN 'fail' THEN 35 WHEN 'warn' THEN 12 WHEN 'unknown' THEN 4 ELSE 0 END)) AS INT) AS score, string_agg(name || '=' || level, ',' ORDER BY name, level) AS checks FROM al GROUP BY 1) SELECT machine_id, coalesce(claims, 0) AS claims, overall, score, checks FROM g LEFT JOIN k USING (machine_id)", f"{CLAIMS}, {RUNS}, {LOG}")
def _(e):
    out = health.report(joins.machine_summary(e.claims, e.runs, e.events).select("machine_id", "claims"), _checks(e))
    listed = F.array_join(F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), c["level"])), ",")
    return out.select("machine_id", "claims").join(health.compact_snapshot(out), "machine_id").withColumn("checks", listed)


def _probes(e):
    p = e.read("part")
    return p.select(F.concat(F.lit("m"), (F.col("p_partkey") % 3).cast("string")).alias("machine_id"), F.col("p_partkey"), (F.col("p_partkey") % 9 != 0).alias("exists"), F.lit(None).cast("string").alias("error"), (F.col("p_size").cast("long") * 1000000000).alias("free_bytes"), F.lit(400000000000).alias("total_bytes"), F.col("p_retailprice").alias("latency_ms"), (F.col("p_partkey") % 2 == 0).alias("critical"))


@query("health_mount_reasons", "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 9 = 0 THEN 'missing' END, CASE WHEN p_size::BIGINT * 1000000000 < 10737418240 THEN 'low_free' END, CASE WHEN p_size < 20 THEN 'low_free_ratio' END, CASE WHEN p_retailprice > 2000 THEN 'high_latency' END) AS reasons FROM part", "x AS (SELECT 1)")
def _(e):
    return _probes(e).select("p_partkey", F.array_join(health.mount_reasons(), ",").alias("reasons"))


@query("health_mounts", "SELECT 'm' || (p_partkey % 3) AS machine_id, 'mounts' AS name, CASE WHEN count(*) FILTER (p_partkey % 18 = 0) > 0 THEN 'fail' ELSE 'warn' END AS level, '' AS message FROM part GROUP BY 1", "x AS (SELECT 1)")
def _(e):
    return health.mount_checks(_probes(e))


@query("health_probe_roots", "SELECT DISTINCT root_path AS root, 'other-volume' AS tier FROM runs WHERE finished_at IS NOT NULL UNION SELECT '/Volumes/A', 'A' UNION SELECT '/Volumes/B', 'A'", RUNS)
def _(e):
    tiers = e.runs.limit(1).select(F.lit("A").alias("name"), F.lit('["/Volumes/A", "/Volumes/B"]').alias("path_prefixes"))
    return health.probe_roots(tiers, e.runs)


@query("health_jobs", "SELECT o_orderkey AS job, CASE WHEN epoch(TIMESTAMP '2000-01-01' - o_orderdate) / 3600.0 > 24 * (o_custkey % 40 + 1) + CASE WHEN o_custkey % 40 = 0 THEN 6 ELSE 24 END THEN true ELSE false END AS overdue, CASE WHEN o_custkey % 11 = 0 THEN 'fail' WHEN epoch(TIMESTAMP '2000-01-01' - o_orderdate) / 3600.0 > 24 * (o_custkey % 40 + 1) + CASE WHEN o_custkey % 40 = 0 THEN 6 ELSE 24 END THEN 'warn' ELSE 'ok' END AS level FROM orders", "x AS (SELECT 1)")
def _(e):
    none = F.lit(None).cast("int")
    jobs = e.read("orders").select(F.col("o_orderkey").alias("job"), (24.0 * (F.col("o_custkey") % 40 + 1)).alias("period_hours"), *[none.alias(c) for c in ("weekday", "day", "month", "hour", "minute")], F.col("o_orderdate").cast("timestamp").alias("last_run_at"), F.lit(True).alias("installed"), F.lit(True).alias("loaded"), F.when(F.col("o_custkey") % 11 == 0, 1).otherwise(0).alias("last_exit"))
    return health.job_level(health.overdue_jobs(jobs, F.lit("2000-01-01").cast("timestamp"))).select("job", "overdue", "level")


@query("health_queues", "SELECT 'plan' AS kind, CAST(o_orderkey AS VARCHAR) AS item FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey % 15 = 0 UNION ALL SELECT 'stash', manifest_run_id FROM flying GROUP BY manifest_run_id", LOG)
def _(e):
    plans = _backlog(e).filter("rows_total > 0").filter(F.col("plan_id").cast("long") % 4 != 0).join(e.read("orders").filter("o_custkey % 15 = 0").select(F.col("o_orderkey").cast("string").alias("plan_id")), "plan_id", "left_semi").select("plan_id", F.lit("registered").alias("status"), F.array().cast("array<string>").alias("blocked_reasons"))
    jobs = plans.select(F.col("plan_id").alias("job"), F.lit(False).alias("overdue"))
    return health.queues(plans, stash.in_flight(e.events, e.now), jobs)


def _fleet(e):
    """Twelve machines by customer: ages of scans, envelopes and checks by number."""
    o = e.read("orders")
    i = (F.col("o_custkey") % 12).cast("int")
    rows = o.select(i.alias("i"), F.concat(F.lit("f"), i.cast("string")).alias("machine_id"), F.col("o_orderkey").alias("id"))
    hours = lambda c: e.now - F.make_dt_interval(hours=c.cast("int"))
    runs = rows.select("machine_id", hours(F.col("i") * 40 + F.col("id") % 5).alias("finished_at"))
    each = rows.select("machine_id", "i").distinct()
    registry = each.filter("i <> 11").select("machine_id", hours(F.col("i") * 110).alias("envelope_at"), hours(F.col("i") * 60).alias("imported_at"), F.when(F.col("i") != 5, hours(F.col("i") * 90)).alias("chain_verified_at"), (F.col("i") % 4 != 3).alias("payload_exists"))
    verdicts = each.select("machine_id", (F.col("i") != 7).alias("ok"))
    return each.select("machine_id"), runs, verdicts, registry


def _matrix(e):
    machines, runs, verdicts, registry = _fleet(e)
    return health.fleet_matrix(machines, runs, verdicts, registry, "f2", e.now)


RANK = "CASE {} WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END"
LEVEL = "CASE {} WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' WHEN 1 THEN 'unknown' ELSE 'ok' END"
FLEET = f"""fr AS (SELECT o_custkey % 12 AS i, min((o_custkey % 12) * 40 + o_orderkey % 5) AS scan_age FROM orders GROUP BY 1),
fa AS (SELECT 'f' || i AS machine_id, i, CASE i WHEN 2 THEN 'local' ELSE 'attached' END AS source, i <> 2 AND (i = 11 OR i % 4 = 3) AS gone, i * 110 AS envelope_age, i <> 7 AS chain_ok, CASE WHEN i NOT IN (5, 11) THEN i * 90 END AS chain_age, CASE WHEN scan_age > 168 THEN 'fail' ELSE 'ok' END AS scan_level FROM fr),
fl AS (SELECT *, CASE WHEN i = 2 THEN CASE WHEN envelope_age > 192 THEN 'fail' ELSE 'ok' END WHEN gone OR envelope_age > 720 THEN 'fail' ELSE 'ok' END AS envelope_level,
 CASE WHEN i = 2 THEN CASE WHEN chain_ok THEN 'ok' ELSE 'fail' END WHEN gone OR NOT chain_ok THEN 'fail' WHEN chain_age IS NULL OR chain_age > 720 THEN 'warn' ELSE 'ok' END AS chain_level FROM fa),
fm AS (SELECT *, {LEVEL.format("greatest(" + ", ".join(RANK.format(c) for c in ("scan_level", "envelope_level", "chain_level")) + ")")} AS level FROM fl),
fc AS (SELECT 'fleet_stale_scan' AS name, max({RANK.format('scan_level')}) AS r, string_agg(machine_id, ',' ORDER BY machine_id) FILTER (scan_level = 'fail') AS machines FROM fm
 UNION ALL SELECT 'fleet_chain_stale', max({RANK.format('chain_level')}), string_agg(machine_id, ',' ORDER BY machine_id) FILTER (chain_level IN ('warn', 'fail')) FROM fm
 UNION ALL SELECT 'envelope_sla', max({RANK.format('envelope_level')}), string_agg(machine_id, ',' ORDER BY machine_id) FILTER (envelope_level IN ('warn', 'fail')) FROM fm
 UNION ALL SELECT 'attached_missing', max(CASE WHEN gone THEN {RANK.format('envelope_level')} ELSE 0 END), string_agg(machine_id, ',' ORDER BY machine_id) FILTER (gone) FROM fm)"""


@query("fleet_matrix", "SELECT machine_id, source, scan_level, envelope_level, chain_level, level FROM fm", FLEET)
def _(e):
    return _matrix(e).select("machine_id", "source", "scan_level", "envelope_level", "chain_level", "level")


@query("fleet_sla", f"SELECT count(*) FILTER (i <> 2) AS attached, count(*) FILTER (i NOT IN (2, 11) AND envelope_age > 720) AS stale, count(*) FILTER (gone) AS missing, count(*) FILTER (i IN (5, 11)) AS never_verified, max(envelope_level) FILTER (i = 2) AS local_level, {LEVEL.format('max(' + RANK.format('envelope_level') + ')')} AS worst FROM fm", FLEET)
def _(e):
    return health.envelope_sla(_matrix(e))


@query("fleet_checks", f"SELECT name, {LEVEL.format('r')} AS level, coalesce(machines, '') AS machines FROM fc", FLEET)
def _(e):
    return health.fleet_checks(_matrix(e))


@query("fleet_overall", f"SELECT {LEVEL.format('greatest((SELECT max(' + RANK.format('level') + ') FROM fm), (SELECT max(r) FROM fc))')} AS overall", FLEET)
def _(e):
    m = _matrix(e)
    return health.fleet_overall(m, health.fleet_checks(m))


@query("fleet_fail_on", "SELECT name, machines FROM fc WHERE r = 3 AND name IN ('fleet_stale_scan', 'attached_missing')", FLEET)
def _(e):
    return health.fleet_fail_on(health.fleet_checks(_matrix(e)), ("fleet_stale_scan", "attached_missing")).select("name", "machines")


@query("fleet_stale_ids", "SELECT machine_id, level FROM fm WHERE level IN ('warn', 'fail')", FLEET)
def _(e):
    return health.stale_ids(_matrix(e))


@query("health_attached", "SELECT machine_id, 'attached' AS name, CASE WHEN i % 4 = 3 THEN 'fail' WHEN i * 60 > 720 THEN 'warn' WHEN chain_age IS NULL OR chain_age > 720 THEN 'warn' ELSE 'ok' END AS level, '' AS message FROM fa WHERE i <> 11", FLEET)
def _(e):
    return health.attached_freshness(_fleet(e)[3], e.now)


@query("health_broken_audit", BROKEN + " SELECT machine_id, 'broken_audit' AS name, CASE WHEN ok THEN 'ok' ELSE 'fail' END AS level, coalesce(message, '') AS message FROM v", LOG)
def _(e):
    return health.broken_audit(audit.verify_chain(_tampered(e), COLUMNS))


@query("health_rollup_stale", "SELECT DISTINCT 'r' || (o_custkey % 6) AS machine_id, 'rollup_stale' AS name, CASE o_custkey % 3 WHEN 0 THEN CASE WHEN o_custkey % 6 * 9 > 24 THEN 'fail' ELSE 'ok' END WHEN 1 THEN 'ok' ELSE 'unknown' END AS level, '' AS message FROM orders", "x AS (SELECT 1)")
def _(e):
    i = F.col("o_custkey") % 6
    source = F.when(i % 3 == 0, "rollup").when(i % 3 == 1, "live")
    rows = e.read("orders").select(F.concat(F.lit("r"), i.cast("string")).alias("machine_id"), source.alias("counts_source"), (e.now - F.make_dt_interval(hours=(i * 9).cast("int"))).alias("refreshed_at")).distinct()
    return health.rollup_stale(rows, e.now)


# sources --------------------------------------------------------------------


@query("sources_skip_noise", "SELECT claim_id FROM claims WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0")
def _(e):
    path = F.concat(F.lit("/a/"), F.when(F.col("claim_id") % 10 == 0, "@eaDir/").otherwise(""), F.when(F.col("claim_id") % 7 == 0, "._x").otherwise("x"))
    return files.skip_noise_paths(e.claims.select("claim_id", path.alias("path"))).select("claim_id")


@query("sources_reuse_unchanged", "SELECT doc_id AS claim_id, doc_id % 4 = 0 AND doc_id % 3 = 0 AND container_path IS NULL AND doc_id % 5 <> 0 AS reused FROM claims")
def _(e):
    listing = e.claims.select("claim_id", F.col("file_path").alias("path"), F.when(F.col("claim_id") % 5 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), "mtime")
    kept, todo = files.reuse_unchanged(listing, e.claims, 1, "m0")
    return kept.select("claim_id", F.lit(True).alias("reused")).union(todo.select("claim_id", F.lit(False)))


@query("sources_latest_finished_run", "SELECT root_path, machine_id, max_by(id, (started_at, id)) AS run_id FROM runs WHERE finished_at IS NOT NULL GROUP BY 1, 2", RUNS)
def _(e):
    return files.latest_finished_run(e.runs)


@query("sources_scan_paths", "SELECT file_path AS path, CASE WHEN min(doc_id) % 2 = 0 THEN NULL ELSE 'missing' END AS error FROM claims GROUP BY 1")
def _(e):
    return files.scan_paths(e.claims.select(F.col("file_path").alias("path")), e.claims.filter("claim_id % 2 = 0").select(F.col("file_path").alias("path"), "size_bytes")).select("path", "error")


@query("sources_scan_counters", "SELECT scan_run_id AS run_id, count(*) FILTER (doc_id % 5 <> 0) AS walked, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 4 = 0) AS hashed, count(*) FILTER (doc_id % 4 = 1) AS reused, count(*) FILTER (doc_id % 4 = 3) AS skipped, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 4 = 2) AS errored, CAST(coalesce(sum(size_bytes) FILTER (doc_id % 4 = 0), 0) AS BIGINT) AS bytes_hashed, count(DISTINCT permanode_id) AS permanodes, count(*) FILTER (doc_id % 5 = 0 AND doc_id % 4 <> 2) AS members_walked, count(*) FILTER (doc_id % 5 = 0 AND doc_id % 4 = 2) AS members_errored FROM (SELECT * REPLACE (doc_id % 7 AS scan_run_id) FROM claims) GROUP BY 1")
def _(e):
    state = F.get(F.array(F.lit("hashed"), F.lit("reused"), F.lit("errored"), F.lit("skipped")), (F.col("claim_id") % 4).cast("int"))
    return files.scan_counters(e.claims.select((F.col("claim_id") % 7).alias("run_id"), state.alias("state"), "size_bytes", "permanode_id", (F.col("claim_id") % 5 == 0).alias("member")))


@query("sources_is_archive", "SELECT claim_id, ends_with(lower(file_path), '.tar.gz') AS archive FROM claims")
def _(e):
    return e.claims.select("claim_id", derive.is_archive(F.col("file_path")).alias("archive"))


@query("sources_import_hash_table", ", i AS (SELECT *, CASE WHEN doc_id % 8 = 0 THEN 'error' WHEN contains(file_path, '/Music/') THEN 'noise' ELSE 'ok' END AS state FROM claims) SELECT count(*) AS read, count(*) FILTER (state = 'error') AS errors, count(*) FILTER (state = 'noise') AS noise, count(DISTINCT permanode_id) FILTER (state = 'ok') AS permanodes, count(*) FILTER (state = 'ok') AS inserted FROM i")
def _(e):
    rows = e.claims.select(F.col("file_path").alias("path"), F.col("canonical_hash").alias("sha256"), "size_bytes", F.when(F.col("claim_id") % 8 == 0, "io").alias("error"), "tier", "volume", "domain", "container_path")
    return files.import_hash_table(rows, ("/Music/",))[1].drop("skipped")


@query("sources_imported_claims", "SELECT file_path, permanode_id, canonical_hash, size_bytes, 'sha256' AS algo, tier, volume, domain, container_path FROM claims WHERE doc_id % 8 <> 0 AND NOT contains(file_path, '/Music/')")
def _(e):
    rows = e.claims.select(F.col("file_path").alias("path"), F.col("canonical_hash").alias("sha256"), "size_bytes", F.when(F.col("claim_id") % 8 == 0, "io").alias("error"), "tier", "volume", "domain", "container_path")
    return files.import_hash_table(rows, ("/Music/",))[0]


@query("sources_ingest_gate", "SELECT DISTINCT 'g' || user_id % 8 AS machine_id, user_id % 8 <> 4 AS version_ok, user_id % 8 <> 0 AS foreign_ok, user_id % 8 NOT IN (2, 3) AS hash_ok, user_id % 8 <> 1 AS chain_ok, user_id % 8 <> 3 AS count_ok, user_id % 8 >= 5 AS admitted FROM events", "x AS (SELECT 1)")
def _(e):
    """Eight inventories: the own one, a broken chain, a payload in which one row stands
    for another, one that lacks a row, a later version, and three good ones."""
    rows = e.read("events").select(F.concat(F.lit("g"), (F.col("user_id") % 8).cast("string")).alias("machine_id"), "event_id", "event_type")
    count = lambda df: df.groupBy("machine_id").agg(F.count(F.lit(1)).alias("audit_rows"), sinks.content_hash(df).alias("payload_hash"))
    least = rows.groupBy("machine_id").agg(F.min("event_id").alias("_lo"), F.max("event_id").alias("_hi"), F.max_by("event_type", "event_id").alias("_type"))
    one = F.col("event_id") == F.col("_lo")
    m = F.col("machine_id")
    sent = rows.join(least, "machine_id").filter(~((m == "g3") & one)).select("machine_id", F.when((m == "g2") & one, F.col("_hi")).otherwise(F.col("event_id")).alias("event_id"), F.when((m == "g2") & one, F.col("_type")).otherwise(F.col("event_type")).alias("event_type"))
    said = count(rows).withColumn("wire_format_version", F.when(m == "g4", 2).otherwise(1))
    return files.ingest_gate(said, count(sent), said.select("machine_id", (m != "g1").alias("ok")), "g0").select("machine_id", "version_ok", "foreign_ok", "hash_ok", "chain_ok", "count_ok", "admitted")


@query("sources_list_attached", "SELECT machine_id, machine_id <> 'm2' AS payload_exists FROM runs GROUP BY 1", RUNS)
def _(e):
    registry = e.runs.groupBy("machine_id").agg(F.max("started_at").alias("imported_at"))
    return files.list_attached(registry, registry.filter("machine_id <> 'm2'")).select("machine_id", "payload_exists")


@query("sinks_detach", "SELECT DISTINCT machine_id FROM runs WHERE machine_id <> 'm1'", RUNS)
def _(e):
    return sinks.detach(e.runs.select("machine_id").distinct(), "m1")[0]


@query("sinks_nas_rows", RANKED + " SELECT permanode_id, file_path AS source_path FROM retire WHERE action = 'nas_manifest'")
def _(e):
    return sinks.nas_rows(_retire(e)).select("permanode_id", "source_path")


@query("sinks_prune_series", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY finished_at DESC, id DESC) AS n FROM runs WHERE finished_at >= TIMESTAMP '2000-06-01' - INTERVAL 900 DAY) WHERE n <= 100000", RUNS)
def _(e):
    points = e.runs.filter("finished_at IS NOT NULL").withColumn("generated_at", F.col("finished_at"))
    return sinks.prune_series(points, F.lit("2000-06-01").cast("timestamp"), 900, 100000).select("id")


GATED = ", c AS (SELECT machine_id, count(*) AS n FROM log GROUP BY 1)"


def _gated(e):
    counted = stored(e.events.groupBy("machine_id").agg(F.count(F.lit(1)).alias("audit_rows"), sinks.content_hash(e.events).alias("payload_hash")), "gate")
    verdicts = counted.select("machine_id", (F.col("machine_id") != "m2").alias("ok"))
    return files.ingest_gate(counted.withColumn("wire_format_version", F.lit(1)), counted, verdicts, "m0")


@query("sources_admit", GATED + " SELECT machine_id, CASE machine_id WHEN 'm1' THEN 'now' ELSE 'before' END AS imported FROM c WHERE machine_id <> 'm0'", LOG)
def _(e):
    registry = e.events.select("machine_id").distinct().filter("machine_id <> 'm0'").withColumn("imported_at", e.now - F.make_dt_interval(days=F.lit(5)))
    out = files.admit(registry, _gated(e), e.now)
    return out.select("machine_id", F.when(F.col("imported_at") == e.now, "now").otherwise("before").alias("imported"))


@query("sources_admit_events", GATED + " SELECT machine_id, 'inventory_attached' AS action, n AS audit_rows FROM c WHERE machine_id = 'm1'", LOG)
def _(e):
    return files.admit_events(_gated(e)).select("machine_id", "action", F.get_json_object("payload", "$.audit_rows").cast("long").alias("audit_rows"))


@query("sources_resolve_attached", "SELECT DISTINCT machine_id FROM runs WHERE machine_id = 'm1'", RUNS)
def _(e):
    return files.resolve_attached(e.runs.select("machine_id").distinct(), "m1")


@query("sources_fan_out", "SELECT claim_id, source FROM (SELECT claim_id, 'local' AS source FROM claims WHERE machine_id = 'm0' UNION ALL SELECT claim_id, 'attached' FROM claims WHERE machine_id = 'm2')")
def _(e):
    of = lambda m: e.claims.filter(F.col("machine_id") == m)
    return files.fan_out(of("m0"), None, of("m2").drop("domain")).select("claim_id", "source")


# round trips: what is written is read back -----------------------------------


def _tree(e):
    """The documents as text files, 64 to a file, and one that scans leave out."""
    path = scratch(e.spark, "tree")
    _by_chunk(e).select("chunk", "value").write.partitionBy("chunk").text(path)
    e.spark.range(1).select(F.lit("noise").alias("value")).write.text(f"{path}/@eaDir")
    return path


def _chunk():
    return F.regexp_extract("path", "chunk=([0-9]+)/", 1).cast("long").alias("chunk")


TREE = "t AS (SELECT doc_id // 64 AS chunk, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1)"


@query("sources_scan_tree", "SELECT chunk, strlen(body)::BIGINT AS size_bytes FROM t", TREE)
def _(e):
    return files.skip_noise_paths(files.scan_tree(e.spark, _tree(e))).filter("path LIKE '%/part-%'").select(_chunk(), "size_bytes")


@query("sources_hash_files", "SELECT chunk, strlen(body)::BIGINT AS size_bytes, sha256(body) AS hash, 'sha256' AS algo, CAST(NULL AS VARCHAR) AS error FROM t", TREE)
def _(e):
    return files.skip_noise_paths(files.hash_files(e.spark, _tree(e))).filter("path LIKE '%/part-%'").select(_chunk(), "size_bytes", "hash", "algo", "error")


@query("sources_hash_files_xxh3", "SELECT chunk, strlen(body)::BIGINT AS size_bytes, 32 AS digits, 'xxh3_128' AS algo, CASE WHEN chunk % 2 = 1 THEN 'gone' END AS error, chunk % 2 = 0 AS same FROM t", TREE)
def _(e):
    """Every other file goes between the listing and the hashing; equal contents have
    equal hashes: each file is hashed beside a copy of itself."""
    listed = files.scan_tree(e.spark, _tree(e)).filter("path LIKE '%/part-%'").withColumn("chunk", _chunk())
    gone = F.when(F.col("chunk") % 2 == 1, F.concat("path", F.lit(".gone"))).otherwise(F.col("path"))
    out = files.hash_listed(listed.withColumn("path", gone), "xxh3_128").select(_chunk(), F.col("size_bytes").alias("read"), "hash", "algo", F.when(F.col("error").isNotNull(), "gone").alias("error"))
    again = files.hash_listed(listed, "xxh3_128").select(_chunk(), "size_bytes", F.col("hash").alias("own"))
    return out.join(again, "chunk").select("chunk", "size_bytes", F.length("own").alias("digits"), "algo", "error", F.coalesce((F.col("hash") == F.col("own")) & (F.col("read") == F.col("size_bytes")), F.lit(False)).alias("same"))


def _by_chunk(e):
    """The documents as (chunk, doc_id, value), in order, a chunk of 64 in one
    task, which passes them on in batches: no chunk is held whole."""
    rows = e.read("documents").select(F.floor(F.col("doc_id") / 64).alias("chunk"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    return rows.repartition("chunk").sortWithinPartitions("chunk", "doc_id")


def _runs(frames):
    """(chunk, its rows so far) of frames in order of chunk, a batch's share at a time."""
    for f in frames:
        for c, part in f.groupby("chunk", sort=False):
            yield int(c), part


def _zips(folder):
    """Write each chunk of texts as a zip below ``folder``; gives their paths."""
    import zipfile

    def write(frames):
        for c, parts in itertools.groupby(_runs(frames), key=lambda x: x[0]):
            path, k = f"{folder}/{c}.zip", 0
            with trees.created(path) as out, zipfile.ZipFile(out, "w") as z:
                for _, part in parts:
                    for i, t in zip(part["doc_id"], part["value"], strict=True):
                        z.writestr(f"d/{i}.txt", t, zipfile.ZIP_DEFLATED if k % 4 else zipfile.ZIP_STORED)
                        k += 1
                z.writestr("__MACOSX/d/._x", "no")
            yield pd.DataFrame({"path": [path]})

    return write


def _archives(e):
    """The documents as zips, 64 to a zip."""
    return stored(_by_chunk(e).mapInPandas(_zips(scratch(e.spark, "zips")), "path string"), "paths")


MEMBER_ROWS = "SELECT (doc_id // 64) || '.zip' AS archive, 'd/' || doc_id || '.txt' AS member, sha256(coalesce(text, '')) AS hash, strlen(coalesce(text, ''))::BIGINT AS size_bytes, CAST(NULL AS VARCHAR) AS error FROM documents"


@query("sources_explode_archives", MEMBER_ROWS, "x AS (SELECT 1)")
def _(e):
    return files.explode_archives(_archives(e)).select(derive.basename(F.col("container_path")).alias("archive"), "member", "hash", "size_bytes", "error")


@query("udtf_archive_members", MEMBER_ROWS, "x AS (SELECT 1)")
def _(e):
    trees.register(e.spark)
    _archives(e).createOrReplaceTempView("estatum_archives")
    return e.spark.sql("SELECT regexp_extract(m.container_path, '[^/]*$', 0) AS archive, m.member, m.hash, m.size_bytes, m.error FROM estatum_archives a, LATERAL archive_members(a.path) m")


def _manifest(e):
    path = scratch(e.spark, "manifest")
    sinks.write_manifest(_retire(e), path, {"run": "r1"})
    return path


@query("sources_manifest", RANKED + " SELECT action, permanode_id, canonical_hash, size_bytes, file_path AS source_path, tier AS source_tier, CASE WHEN action = 'retire_direct' THEN 'dropbox-cloud-trash-account-specific' ELSE tier END AS destination_tier, 'r1' AS run FROM retire WHERE action IS NOT NULL")
def _(e):
    head, rows = files.read_manifest(e.spark, _manifest(e))
    return rows.drop("destination_path", "rationale").withColumn("run", F.lit(head["run"]))


@query("sources_load_plan_rows", RANKED + " SELECT action, permanode_id, file_path AS source_path, '# estatum-manifest-v1,# run: r1' AS comments FROM retire WHERE action IS NOT NULL")
def _(e):
    comments, rows = files.load_plan_rows(e.spark, _manifest(e))
    return rows.select("action", "permanode_id", "source_path", F.lit(",".join(sorted(comments))).alias("comments"))


@query("sinks_write_buckets", "SELECT kind, claim_id FROM kinds", f"{CLAIMS}, {PRESENCE}")
def _(e):
    path = scratch(e.spark, "buckets")
    sinks.write_buckets(joins.presence(e.claims, e.store, e.mount, HOME).select("kind", "claim_id"), path)
    return e.spark.read.option("sep", "\t").option("header", "true").schema("claim_id long, kind string").csv(f"{path}/buckets").select("kind", "claim_id")


@query("sinks_export_nas_manifest", RANKED + " SELECT 'r1' AS manifest_run_id, permanode_id, 'nas_manifest_exported' AS action, (SELECT count(*) FROM retire WHERE action = 'nas_manifest') AS rows_written FROM retire WHERE action = 'nas_manifest'")
def _(e):
    path = scratch(e.spark, "nas")
    log = sinks.export_nas_manifest(_retire(e), path)
    return log.withColumn("rows_written", F.lit(e.spark.read.text(path).count()).cast("long"))


@query("sinks_export_snapshot", " SELECT 'm0' AS machine_id, 1 AS wire_format_version, (SELECT count(*) FROM claims) AS claim_rows, (SELECT count(*) FROM nodes) AS permanode_rows, (SELECT count(*) FROM log) AS audit_rows, (SELECT count(*) FROM claims) AS read_back, 'db_export_created' AS action", f"{CLAIMS}, {LOG}")
def _(e):
    path = scratch(e.spark, "snapshot")
    out = sinks.export_snapshot({"claims": e.claims, "permanodes": e.permanodes, "audit_log": e.events, "tiers": e.claims.select("tier").distinct()}, path, "m0")
    event = sinks.export_event(out).select("action")
    return out.drop("payload_hash").withColumn("read_back", F.lit(e.spark.read.parquet(f"{path}/claims").count()).cast("long")).crossJoin(event)


@query("sources_policy_tables", "SELECT r_regionkey AS rule_order, r_name AS name, '/' || n_name || '/' AS needle FROM region JOIN nation ON r_regionkey = n_regionkey", "x AS (SELECT 1)")
def _(e):
    rows = e.read("nation").join(e.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("r_regionkey", "n_nationkey").select("r_name", "n_name").collect()
    names = list(dict.fromkeys(r.r_name for r in rows))
    policy = {"version": 1, "kind": "ClassificationPolicy", "domains": [{"name": x, "rules": [{"path_substring_any_of": [f"/{r.n_name}/" for r in rows if r.r_name == x]}]} for x in names]}
    return files.policy_tables(e.spark, policy)["domains"].withColumn("rule_order", F.col("rule_order").cast("long"))


@query("sources_policy_retention", "SELECT 'exclusions.substrings' AS setting, row_number() OVER (ORDER BY n_nationkey) - 1 AS place, '/' || n_name || '/' AS value FROM nation", "x AS (SELECT 1)")
def _(e):
    names = [f"/{r.n_name}/" for r in e.read("nation").orderBy("n_nationkey").select("n_name").collect()]
    tables = files.policy_tables(e.spark, {"version": 1, "kind": "RetentionPolicy", "exclusions": {"substrings": names}})
    return tables["exclusions"].select(F.concat(F.lit("exclusions."), "setting").alias("setting"), F.col("place").cast("long").alias("place"), "value")


@query("sources_policy_replication", """SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS rule_order, unnest(['name', 'source', 'excludes', 'excludes']) AS setting, unnest([0, 0, 0, 1]) AS place, unnest([n_name, '/' || n_regionkey, '*.tmp', n_name || '/**']) AS value FROM nation""", "x AS (SELECT 1)")
def _(e):
    rows = e.read("nation").orderBy("n_nationkey").select("n_name", "n_regionkey").collect()
    sources = [{"name": r.n_name, "source": f"/{r.n_regionkey}", "excludes": ["*.tmp", f"{r.n_name}/**"]} for r in rows]
    tables = files.policy_tables(e.spark, {"version": 1, "kind": "ReplicationPolicy", "sources": sources})
    return tables["sources"].select(F.col("rule_order").cast("long").alias("rule_order"), "setting", F.col("place").cast("long").alias("place"), "value")


@query("sources_policy_archive", "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS rule_order, unnest(['name', 'repository', 'keep.daily']) AS setting, unnest([r_name, '/backup/' || r_regionkey, CAST(r_regionkey + 7 AS VARCHAR)]) AS value FROM region", "x AS (SELECT 1)")
def _(e):
    rows = e.read("region").orderBy("r_regionkey").select("r_name", "r_regionkey").collect()
    archives = [{"name": r.r_name, "repository": f"/backup/{r.r_regionkey}", "keep": {"daily": r.r_regionkey + 7}} for r in rows]
    tables = files.policy_tables(e.spark, {"version": 1, "kind": "ArchivePolicy", "archives": archives})
    return tables["archives"].select(F.col("rule_order").cast("long").alias("rule_order"), "setting", "value")


@query("sources_health_series", "SELECT lpad(CAST(id AS VARCHAR), 12, '0') AS generated_at, machine_id FROM runs ORDER BY id DESC LIMIT 48", RUNS)
def _(e):
    path = scratch(e.spark, "health")
    point = lambda part: e.runs.filter(F.col("id") % 2 == part).select(F.lpad(F.col("id").cast("string"), 12, "0").alias("generated_at"), "machine_id")
    for part in (0, 1):
        sinks.append_health_snapshot(point(part), path)
    return files.health_series(e.spark, f"{path}/series", "generated_at string, machine_id string")


@query("plan_attach_filter", """SELECT CAST(o_orderkey AS VARCHAR) AS plan_id, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'empty_plan' END, CASE WHEN o_custkey % 5 = 0 THEN 'manifest_missing' END, CASE WHEN o_custkey % 3 > 0 THEN 'dry_run_errors' END, CASE WHEN o_orderkey % 4 > 0 AND o_custkey % 2 <> 0 THEN 'fp_not_ready' END, CASE WHEN o_orderkey % 4 * 500 >= 1000 AND o_custkey % 4 <> 0 THEN 'dual_presence_unfiltered' END, CASE WHEN o_orderkey % 4 * 700 > 2000 THEN 'oversize_for_mcp' END, CASE WHEN o_custkey % 7 = 0 THEN 'stale_inventory' END) AS reasons, o_custkey % 4 = 0 AS has_filter FROM orders""", "x AS (SELECT 1)")
def _(e):
    filters = e.read("orders").filter("o_custkey % 4 = 0").select(F.col("o_orderkey").cast("string").alias("plan_id"), F.col("o_orderdate").alias("at"))
    return plan.attach_filter(_backlog(e), filters).select("plan_id", F.array_join("blocked_reasons", ",").alias("reasons"), "has_filter")


@query("audit_segments", ", h AS (SELECT max(id) // 2 AS mid FROM log) SELECT 's' || CASE WHEN id <= mid THEN 1 ELSE 2 END AS segment_id, min(id) AS first_id, max(id) AS last_id, count(*) AS row_count, bool_and(id <= mid) AS ok FROM log, h GROUP BY 1", LOG)
def _(e):
    """Two sealed segments, the second one changed afterwards."""
    log, path = stored(_one_chain(e), "log"), scratch(e.spark, "segments")
    lo, hi = log.agg(F.min("id"), F.max("id")).first()
    mid = hi // 2
    first = audit.seal_segment(log, audit.plan_segment(log, mid, 0), "s1", path)
    second = audit.seal_segment(log.filter(F.col("id") > mid), audit.plan_segment(log.filter(F.col("id") > mid), hi, 0), "s2", path)
    bad = e.spark.read.parquet(path).withColumn("payload", F.when(F.col("id") == hi, "{}").otherwise(F.col("payload")))
    registry = first.unionByName(second)
    return registry.select("segment_id", "first_id", "last_id", "row_count").join(audit.verify_segments(bad, registry, COLUMNS), "segment_id")


@query("audit_verify_attached", ", m AS (SELECT DISTINCT machine_id FROM log UNION SELECT 'm9') SELECT machine_id, machine_id = 'm1' AS ok, machine_id = 'm1' AS moved FROM m", LOG)
def _(e):
    registry = e.events.select("machine_id").distinct().unionByName(e.spark.range(1).select(F.lit("m9").alias("machine_id"))).withColumn("chain_verified_at", e.now - F.make_dt_interval(days=F.lit(3)))
    out = audit.verify_attached(registry, _tampered(e), e.now, COLUMNS)
    return out.select("machine_id", "ok", (F.col("chain_verified_at") == e.now).alias("moved"))


# vectors --------------------------------------------------------------------


@query("embed_search", ", q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT CAST(vec_id AS VARCHAR) AS permanode_id, round(1 - list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))), 6) AS distance FROM embeddings, q WHERE label = 3 ORDER BY 1 - list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))), 1 LIMIT 10", "x AS (SELECT 1)")
def _(e):
    q = e.embeddings.filter("vec_id = 0").select(F.col("vector").alias("q"))
    rows = e.embeddings.filter("model_version = '3'").crossJoin(F.broadcast(q))
    return embed.search(rows, F.col("q")).select("permanode_id", F.round("distance", 6).alias("distance"))


@query("embed_search_many", ", q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS permanode_id, list_distance(embedding::DOUBLE[], v::DOUBLE[]) AS distance FROM embeddings, q) SELECT query_id, permanode_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, permanode_id) AS rank FROM d) WHERE rank <= 5", "x AS (SELECT 1)")
def _(e):
    q = e.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    return embed.search_many(e.embeddings, q, 5, "l2").select("query_id", "permanode_id", F.col("rank").cast("long").alias("rank"))


@query("embed_candidates", f"SELECT permanode_id, concat_ws(' ', base, classification, domain, regexp_replace(file_path, '/[^/]*$', ''), tier) AS text FROM (SELECT *, row_number() OVER (PARTITION BY permanode_id ORDER BY {priority_sql('tier')}, claim_id) AS n FROM cur) WHERE n = 1")
def _(e):
    return embed.candidates(e.permanodes, e.claims, e.embeddings.filter("false"), "m", "1")


@query("embed_upsert", "SELECT CAST(vec_id AS VARCHAR) AS permanode_id, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS computed_at FROM embeddings", "x AS (SELECT 1)")
def _(e):
    old = e.embeddings.withColumn("computed_at", F.lit(1))
    return embed.upsert(old, old.filter("vec_id % 2 = 0").withColumn("computed_at", F.lit(2))).select("permanode_id", "computed_at")


@query("embed_dimension", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64", "x AS (SELECT 1)")
def _(e):
    return embed.check_dimension(e.embeddings, 64).select("vec_id")


@query("embed_mean_pool", "SELECT vec_id, round(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings", "x AS (SELECT 1)")
def _(e):
    v = F.transform("vector", lambda x: x.cast("double"))
    pooled = embed.mean_pool_normalize(F.array(v, v, F.transform(v, lambda x: x * 9)), F.array(F.lit(1), F.lit(1), F.lit(0)))
    return e.embeddings.select("vec_id", F.round(pooled[0], 5).alias("first"))


@query("embed_run", "SELECT count(DISTINCT permanode_id) AS candidates, count(DISTINCT permanode_id) AS embedded, 0 AS errors FROM cur")
def _(e):
    none = e.embeddings.filter("false")
    return embed.batch_report(embed.run(embed.candidates(e.permanodes, e.claims, none, "m", "1")))


# streams, as batches over the same events ------------------------------------


@query("stream_event_paths", "SELECT doc_id AS id, p AS event_path FROM (SELECT doc_id, unnest(CASE WHEN doc_id % 4 = 0 THEN [file_path, '/moved/' || doc_id] ELSE [file_path] END) AS p FROM claims)")
def _(e):
    rows = e.claims.select(F.col("claim_id").alias("id"), F.col("file_path").alias("path"), F.when(F.col("claim_id") % 4 == 0, F.concat(F.lit("/moved/"), F.col("claim_id").cast("string"))).alias("moved_to"))
    return stream.event_paths(rows).select("id", "event_path")


@query("stream_debounce", ", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT CAST(user_id AS VARCHAR) AS root, count(*) AS n FROM s GROUP BY user_id, session", "x AS (SELECT 1)")
def _(e):
    rows = e.read("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("root"), F.col("event_type").alias("path"), F.lit("created").alias("kind"), F.lit(None).cast("string").alias("moved_to"))
    return stream.debounce(rows, "6 hours").select("root", F.size("events").cast("long").alias("n"))


@query("stream_live_stats", "SELECT h AS started, event_type AS tier, count(*) AS claim_count, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS bytes_total FROM (SELECT date_trunc('hour', ts) AS h, event_type, CAST(trunc(value) AS BIGINT) AS value FROM events) GROUP BY h, event_type", "x AS (SELECT 1)")
def _(e):
    rows = e.read("events").select(F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_type").alias("tier"), F.col("value").cast("long").alias("size_bytes"))
    return stream.live_stats(rows)


@query("embed_stub_vectors", "SELECT (SELECT count(DISTINCT text) FROM documents) AS texts, (SELECT count(DISTINCT text) FROM documents) AS vectors, 384 AS least, 384 AS most, (SELECT count(DISTINCT text) FROM documents) AS units", "x AS (SELECT 1)")
def _(e):
    rows = e.read("documents").select(F.sha2("text", 256).alias("permanode_id"), "text").filter("text IS NOT NULL").distinct()
    out = embed.run(rows).filter("error IS NULL")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return out.agg(F.count_distinct("permanode_id").alias("texts"), F.count_distinct(F.xxhash64("vector")).alias("vectors"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.count_if(F.abs(norm - 1) < 1e-4).alias("units"))


def _file_events(e):
    """Events as JSON files: users are roots, error events are deletes."""
    kinds = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "click", "moved").when(F.col("event_type") == "signup", "opened").otherwise("created")
    path = F.concat(F.lit("/r/"), F.when(F.col("event_id") % 9 == 0, ".Trashes/").otherwise(""), F.col("event_type"), F.lit("/"), (F.col("event_id") % 40).cast("string"))
    moved = F.when(F.col("event_type") == "click", F.concat(F.lit("/m/"), (F.col("event_id") % 40).cast("string")))
    rows = e.read("events").select(path.alias("path"), kinds.alias("kind"), moved.alias("moved_to"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("root"), F.lit(False).alias("is_dir"), "event_id")
    return rows


FILES = """fe AS (SELECT event_id, ts, 'u' || (user_id % 10) AS root, '/r/' || CASE WHEN event_id % 9 = 0 THEN '.Trashes/' ELSE '' END || event_type || '/' || (event_id % 40) AS path, CASE WHEN event_type = 'click' THEN '/m/' || (event_id % 40) END AS moved_to,
 CASE event_type WHEN 'error' THEN 'deleted' WHEN 'click' THEN 'moved' WHEN 'signup' THEN 'opened' ELSE 'created' END AS kind FROM events),
known AS (SELECT * FROM fe WHERE kind <> 'opened' AND event_id % 9 <> 0)"""


def _watched(e):
    """The events as a stream of files."""
    folder = scratch(e.spark, "events")
    _file_events(e).drop("event_id").write.json(folder)
    return stream.file_events(e.spark, folder)


def _drained(df, label):
    """What a stream writes until its input ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "checkpoint")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("stream_watch", "SELECT path, kind, moved_to, root, count(*) AS n FROM known GROUP BY ALL", FILES)
def _(e):
    return _drained(_watched(e), "watched").groupBy("path", "kind", "moved_to", "root").agg(F.count(F.lit(1)).alias("n"))


@query("stream_unique_paths", """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY root ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM known), s AS (SELECT *, sum(fresh) OVER (PARTITION BY root ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g),
 p AS (SELECT root, session, unnest([path, moved_to]) AS p FROM s WHERE kind <> 'deleted') SELECT root, session, count(DISTINCT p) AS paths FROM p WHERE p IS NOT NULL GROUP BY 1, 2""", FILES)
def _(e):
    batches = stream.unique_paths(stream.debounce(stream.clean_events(_file_events(e)), "6 hours"))
    # sessions are numbered with those that deletes leave empty
    every = stream.debounce(stream.clean_events(_file_events(e)), "6 hours").select("root", "started", F.row_number().over(Window.partitionBy("root").orderBy("started")).cast("long").alias("session"))
    return batches.join(every, ["root", "started"]).select("root", "session", F.size("paths").cast("long").alias("paths"))


BOUNDED = """, e AS (SELECT root, path, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY root ORDER BY epoch_us(ts) // 1000, path) AS n FROM known),
 r AS (SELECT root, n, ms, ms AS started, path FROM e WHERE n = 1 UNION ALL SELECT e.root, e.n, e.ms, CASE WHEN e.ms - r.ms > 3600000 OR e.ms - r.started >= 21600000 THEN e.ms ELSE r.started END, e.path FROM r JOIN e ON e.root = r.root AND e.n = r.n + 1),
 b AS (SELECT root, started, max(ms) AS ended, count(DISTINCT path) AS paths FROM r GROUP BY 1, 2), l AS (SELECT *, lead(started) OVER (PARTITION BY root ORDER BY started) AS later, (SELECT max(ms) FROM e) - 10000 AS mark FROM b)
 SELECT root, make_timestamp(started * 1000) AS started, make_timestamp(ended * 1000) AS ended, paths, CASE WHEN later IS NOT NULL THEN CASE WHEN later - ended > 3600000 THEN 'quiet' ELSE 'wait' END WHEN least(ended + 3600000, started + 21600000) >= ended + 3600000 THEN 'quiet' ELSE 'wait' END AS reason
 FROM l WHERE later IS NOT NULL OR least(ended + 3600000, started + 21600000) <= mark"""


@query("stream_debounce_bounded", BOUNDED, f"RECURSIVE {FILES}")
def _(e):
    """Batches of the bounded debounce; one whose timer no event has reached stays open."""
    return _drained(stream.debounce_bounded(_watched(e), 3_600_000, 6 * 3_600_000), "bounded").select("root", "started", "ended", F.size("paths").cast("long").alias("paths"), "reason")


# trees that change -------------------------------------------------------------

CHANGED = f"{TREE}, c AS (SELECT *, chunk % 5 AS k FROM t)"


def _texts(e):
    """The documents as files of a tree, 64 to a file; gives (chunk, path)."""
    folder = scratch(e.spark, "live").removeprefix("file://")

    def write(frames):
        for c, parts in itertools.groupby(_runs(frames), key=lambda x: x[0]):
            path = f"{folder}/s{c % 3}/{c}.txt"
            with trees.created(path) as out:
                for _, part in parts:
                    for t in part["value"]:
                        out.write(f"{t}\n".encode())
            yield pd.DataFrame({"chunk": [c], "path": [path]})

    return folder, stored(_by_chunk(e).mapInPandas(write, "chunk long, path string"), "texts")


def _change(texts, folder):
    """Of five files one goes, one grows, one is renamed, one moves to another folder, and
    one stays beside a new one."""
    import os

    def run(frames):
        for f in frames:
            for c, p in zip(f["chunk"], f["path"], strict=True):
                k = c % 5
                if k == 0:
                    os.unlink(p)
                elif k == 1:
                    with open(p, "a") as out:
                        out.write("more")
                elif k == 4:
                    with open(f"{os.path.dirname(p)}/new-{c}.txt", "w") as out:
                        out.write(f"new {c}")
                else:
                    to = f"{os.path.dirname(p)}/moved-{c}.txt" if k == 2 else f"{folder}/t/{c}.txt"
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    os.rename(p, to)
            yield f[["chunk"]]

    texts.mapInPandas(run, "chunk long").write.format("noop").mode("overwrite").save()


@query("stream_watch_tree", """ SELECT 0 AS batch, chunk || '.txt' AS name, 'created' AS kind, NULL AS moved_name FROM c
 UNION ALL SELECT 1, chunk || '.txt', CASE k WHEN 0 THEN 'deleted' WHEN 1 THEN 'modified' ELSE 'moved' END, CASE k WHEN 2 THEN 'moved-' || chunk || '.txt' WHEN 3 THEN chunk || '.txt' END FROM c WHERE k < 4 UNION ALL SELECT 1, 'new-' || chunk || '.txt', 'created', NULL FROM c WHERE k = 4""", CHANGED)
def _(e):
    """Events of a tree as it is found, and after it changed."""
    folder, texts = _texts(e)
    state, checkpoint, out = (scratch(e.spark, x) for x in ("listings", "checkpoint", "events"))

    def run():
        events = stream.watch(e.spark, [folder], state)
        sink = events.writeStream.foreachBatch(lambda frame, i: stream.pair_moves(frame).write.mode("overwrite").parquet(f"{out}/batch={i}"))
        sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run()
    _change(texts, folder)
    run()
    name = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    got = e.spark.read.parquet(out)
    return got.select(F.col("batch").cast("long").alias("batch"), name("path").alias("name"), "kind", name("moved_to").alias("moved_name"))


@query("stream_refresh_claims", """ SELECT chunk || '.txt' AS name, sha256(body) AS canonical_hash, strlen(body)::BIGINT AS size_bytes, left(sha256(sha256(body) || ':' || strlen(body)), 32) AS permanode_id, 0 AS batch FROM c WHERE k = 4
 UNION ALL SELECT CASE k WHEN 2 THEN 'moved-' ELSE '' END || chunk || '.txt', sha256(b), strlen(b)::BIGINT, left(sha256(sha256(b) || ':' || strlen(b)), 32), 1 FROM (SELECT *, CASE k WHEN 1 THEN body || 'more' ELSE body END AS b FROM c) WHERE k IN (1, 2, 3)
 UNION ALL SELECT 'new-' || chunk || '.txt', sha256('new ' || chunk), strlen('new ' || chunk)::BIGINT, left(sha256(sha256('new ' || chunk) || ':' || strlen('new ' || chunk)), 32), 1 FROM c WHERE k = 4""", CHANGED)
def _(e):
    """Open claims after a tree was scanned, changed, and scanned again by its events."""
    folder, texts = _texts(e)
    state, checkpoint, out = (scratch(e.spark, x) for x in ("listings", "checkpoint", "claims"))
    for change in (lambda: None, lambda: _change(texts, folder)):
        change()
        stream.refresh_claims(stream.watch(e.spark, [folder], state), out, "m0", checkpoint).awaitTermination()
    return stream.open_claims(e.spark, out).select(F.regexp_extract("file_path", "[^/]*$", 0).alias("name"), "canonical_hash", "size_bytes", "permanode_id", "batch")


LIVE = """, seen AS (SELECT machine_id, file_path, tier, size_bytes, 1 AS run, doc_id, false AS gone FROM claims UNION ALL SELECT machine_id, file_path, CASE WHEN doc_id % 2 = 0 THEN 'moved' ELSE tier END, size_bytes + 1, 2, doc_id, doc_id % 9 = 0 FROM claims WHERE doc_id % 3 = 0 UNION ALL SELECT machine_id, file_path, 'late', 1, 0, doc_id, false FROM claims WHERE doc_id % 4 = 0),
 last AS (SELECT *, row_number() OVER (PARTITION BY machine_id, file_path ORDER BY run DESC, doc_id DESC) AS n FROM seen) SELECT tier, count(*) AS claim_count, CAST(sum(size_bytes) AS BIGINT) AS bytes_total FROM last WHERE n = 1 AND NOT gone GROUP BY 1"""


@query("stream_current_counts", LIVE)
def _(e):
    """Claims of three runs as they arrive: the second supersedes a third of the first and
    closes some, the third brings older ones."""
    c = e.claims.select("machine_id", "file_path", F.lit(None).cast("string").alias("container_path"), "tier", "size_bytes", F.lit(1).cast("long").alias("scan_run_id"), "claim_id", F.lit(False).alias("deleted"))
    i = F.col("claim_id")
    second = c.filter(i % 3 == 0).withColumns({"tier": F.when(i % 2 == 0, "moved").otherwise(F.col("tier")), "size_bytes": F.col("size_bytes") + 1, "scan_run_id": F.lit(2).cast("long"), "deleted": i % 9 == 0})
    third = c.filter(i % 4 == 0).withColumns({"tier": F.lit("late"), "size_bytes": F.lit(1).cast("long"), "scan_run_id": F.lit(0).cast("long")})
    folder, checkpoint, out = (scratch(e.spark, x) for x in ("arriving", "checkpoint", "deltas"))
    e.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for rows in (c, second, third):
        rows.write.mode("append").parquet(folder)
        deltas = stream.current_deltas(e.spark.readStream.schema(c.schema).parquet(folder))
        deltas.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.current_counts(e.spark.read.schema(stream.DELTA).parquet(out))


@query("stream_audit_tip", "SELECT machine_id, id, NOT (id % 97 = 96 AND machine_id <> 'm1') AS ok FROM log", LOG)
def _(e):
    """Links of the chained log as a stream, payloads changed afterwards."""
    rows, folder = _tampered(e), scratch(e.spark, "chain")
    rows.write.parquet(folder)
    live = e.spark.readStream.schema(rows.schema).parquet(folder)
    return _drained(stream.audit_tip(live, COLUMNS), "tips")
