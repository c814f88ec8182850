"""Reading file trees, archives, hash tables, manifests, snapshots, policies."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatum.functions import derive
from estatum.operators import audit as chains
from estatum.operators import stats
from estatum.sources.trees import SKIP_DIRS, SKIP_NAMES, explode_archives, hash_files, hash_listed, scan_tree  # noqa: F401

MANIFEST = "action string, permanode_id string, canonical_hash string, size_bytes long, source_path string, source_tier string, destination_path string, destination_tier string, rationale string"
#: What a manifest writes for a character: backslashes first.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
COLUMNS = [x.split(" ")[0] for x in MANIFEST.split(", ")]
POLICY_KINDS = ("RetentionPolicy", "ClassificationPolicy", "PromotionPolicy", "ReplicationPolicy", "ArchivePolicy")
KNOWN_FIELDS = {"version", "kind", "metadata", "defaults", "exclusions", "dedup_retire", "domains", "clusters", "phases", "sources", "targets", "replications", "archives"}


def skip_noise_paths(files: DataFrame, column: str = "path") -> DataFrame:
    parts, name = F.split(column, "/"), derive.basename(F.col(column))
    parents = F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1))
    return files.filter(~(F.exists(parents, lambda s: s.isin(*SKIP_DIRS)) | name.startswith("._") | name.isin(*SKIP_NAMES)))


def reuse_unchanged(files: DataFrame, claims: DataFrame, run_id: int, machine: str) -> tuple[DataFrame, DataFrame]:
    """(files with the identity they had in an earlier run, files to hash)."""
    old = claims.filter((F.col("scan_run_id") == run_id) & (F.col("machine_id") == machine) & F.col("container_path").isNull()).select(F.col("file_path").alias("path"), "permanode_id", F.col("size_bytes").alias("_size"), F.date_trunc("second", "mtime").alias("_mtime")).dropDuplicates(["path"])
    same = (F.col("_size") == F.col("size_bytes")) & (F.col("_mtime") == F.date_trunc("second", F.col("mtime")))
    joined = files.join(old, "path", "left")
    keep = F.coalesce(same, F.lit(False))
    return joined.filter(keep).drop("_size", "_mtime"), joined.filter(~keep).drop("_size", "_mtime", "permanode_id")


def latest_finished_run(runs: DataFrame) -> DataFrame:
    return runs.filter("finished_at IS NOT NULL").groupBy("root_path", "machine_id").agg(F.max_by("id", F.struct("started_at", "id")).alias("run_id"))


def scan_paths(paths: DataFrame, listing: DataFrame) -> DataFrame:
    """Of an incremental list, what is there with its listing row, what isn't as an
    error; noise and repeats left out."""
    wanted = skip_noise_paths(paths.filter(F.col("path").startswith("/")).dropDuplicates(["path"]))
    out = wanted.join(listing, "path", "left")
    return out.withColumn("error", F.when(F.col("size_bytes").isNull(), "missing"))


def scan_counters(rows: DataFrame) -> DataFrame:
    """Per run, from rows (run_id, state, size_bytes, permanode_id, member)."""
    s, m = F.col("state"), F.coalesce("member", F.lit(False))
    n = lambda c: F.count_if(c)
    return rows.groupBy("run_id").agg(n(~m).alias("walked"), n(~m & (s == "hashed")).alias("hashed"), n(s == "reused").alias("reused"), n(s == "skipped").alias("skipped"), n(~m & (s == "errored")).alias("errored"), F.coalesce(F.sum(F.when(s == "hashed", F.col("size_bytes"))), F.lit(0)).alias("bytes_hashed"), n(m & (s != "errored")).alias("members_walked"), n(m & (s == "errored")).alias("members_errored"), F.count_distinct("permanode_id").alias("permanodes"))


def import_hash_table(rows: DataFrame, noise: tuple[str, ...] = ("/@eaDir/", "/.fseventsd/")) -> tuple[DataFrame, DataFrame]:
    """(claims, counters) of an older flat table of hashes."""
    bad = F.col("error").isNotNull() | F.coalesce("sha256", F.lit("")).isin("") | F.col("size_bytes").isNull()
    noisy = derive.any_of([F.col("path").contains(n) for n in noise])
    state = F.when(bad, "error").when(noisy, "noise").otherwise("ok")
    marked = rows.withColumn("_state", state)
    good = marked.filter("_state = 'ok'").select(derive.permanode_id(F.col("sha256"), F.col("size_bytes")).alias("permanode_id"), F.lower(F.trim("sha256")).alias("canonical_hash"), F.lit("sha256").alias("algo"), F.col("path").alias("file_path"), "size_bytes", F.coalesce("tier", F.lit("unknown")).alias("tier"), F.coalesce("volume", F.lit("")).alias("volume"), "domain", "container_path")
    claims = good.dropDuplicates(["file_path", "container_path"])
    counted = marked.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("_state") == "error").alias("errors"), F.count_if(F.col("_state") == "noise").alias("noise"), F.count_distinct(F.when(F.col("_state") == "ok", F.struct("sha256", "size_bytes"))).alias("permanodes"))
    return claims, counted.crossJoin(claims.agg(F.count(F.lit(1)).alias("inserted"))).withColumn("skipped", F.col("read") - F.col("errors") - F.col("noise") - F.col("inserted"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or of all parts of a folder; what is no UTF-8 is replaced."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.make_valid_utf8("value").alias("value"))


def _comments(lines: DataFrame) -> list[str]:
    return [r.value for r in lines.filter(F.col("value").startswith("#")).collect()]


def read_manifest(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """Provenance and rows of a plan file; other columns or no marker are refused."""
    lines = _lines(spark, path)
    head = _comments(lines)
    if not any("-manifest-v1" in x for x in head):
        raise ValueError("not a manifest")
    text = lines.filter(~F.col("value").startswith("#"))
    if text.filter(F.col("value") == "\t".join(COLUMNS)).isEmpty():
        raise ValueError("columns are not a manifest's")
    rows = text.filter(F.col("value") != "\t".join(COLUMNS)).select(_cells("value").alias("v"))
    types = [x.split(" ")[1] for x in MANIFEST.split(", ")]
    empty = {"destination_path", "size_bytes", "rationale"}
    cells = [(F.nullif(F.get("v", F.lit(i)), F.lit("")) if c in empty else F.get("v", F.lit(i))).cast(t).alias(c) for i, (c, t) in enumerate(zip(COLUMNS, types, strict=True))]
    named = dict(x.lstrip("# ").split(": ", 1) for x in head if ": " in x)
    return named, rows.select(*cells)


def _cells(line: str) -> Column:
    return F.transform(F.split(line, "\t"), unescape)


def unescape(value: Column) -> Column:
    """Undo ESCAPES; a lone backslash marks where an escaped one stood meanwhile."""
    marked = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    for plain, written in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("#", "\\#")):
        marked = F.replace(marked, F.lit(written), F.lit(plain))
    return F.replace(marked, F.lit("\x00"), F.lit("\\"))


def load_plan_rows(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(comments, rows) of any tab-separated plan: whatever columns its first line names,
    as strings.  Lines that begin with # are comments, wherever they are; short lines have
    nulls.  Values of a manifest are unescaped as write_manifest wrote them, of other
    files unquoted as CSV has it."""
    lines = _lines(spark, path)
    comments, body = _comments(lines), lines.filter(~F.col("value").startswith("#"))
    ours = any("-manifest-v1" in c for c in comments)
    header = "\t".join(COLUMNS) if ours else (body.first() or [""])[0]
    names = next(csv.reader([header], delimiter="\t"), [])
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rest = body.filter((F.col("value") != header) & (F.length("value") > 0))
    if not names:
        return comments, spark.createDataFrame([], "value string")
    if ours:
        return comments, rest.select(_cells("value").alias("v")).select(*[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)])
    options = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\x00", "emptyValue": ""}
    return comments, rest.select(F.from_csv("value", schema, options).alias("r")).select("r.*")


def fan_out(local: DataFrame, *attached: DataFrame) -> DataFrame:
    """Local and admitted inventories as one table with their source; an inventory
    whose payload is missing (None) is left out."""
    return stats.union_all([local.withColumn("source", F.lit("local")), *[a.withColumn("source", F.lit("attached")) for a in attached if a is not None]])


def ingest_gate(manifests: DataFrame, payloads: DataFrame, verdicts: DataFrame, own: str, version: int = 1) -> DataFrame:
    """Admission of foreign inventories: every gate a column, ``admitted`` all of
    them.  payloads: (machine_id, payload_hash, audit_rows) as counted."""
    p = payloads.select("machine_id", F.col("payload_hash").alias("_hash"), F.col("audit_rows").alias("_audit"))
    out = manifests.join(p, "machine_id", "left").join(verdicts.select("machine_id", F.col("ok").alias("_chain")), "machine_id", "left")
    gates = {"version_ok": F.col("wire_format_version") <= version, "foreign_ok": F.col("machine_id") != own, "hash_ok": F.col("payload_hash") == F.col("_hash"), "chain_ok": F.col("_chain"), "count_ok": F.col("audit_rows") == F.col("_audit")}
    out = out.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in gates.items()}).drop("_hash", "_audit", "_chain")
    ok = F.lit(True)
    for g in gates:
        ok &= F.col(g)
    return out.withColumn("admitted", ok)


def admit(registry: DataFrame, gated: DataFrame, now: Column) -> DataFrame:
    """Registry after the admitted ones: newest row of each machine."""
    new = gated.filter("admitted").select("machine_id", now.alias("imported_at"))
    return stats.latest_per_key(registry.select("machine_id", "imported_at").unionByName(new), ["machine_id"], [F.desc("imported_at")])


def admit_events(gated: DataFrame) -> DataFrame:
    """Log rows of the admitted inventories."""
    return gated.filter("admitted").select("machine_id", F.lit("inventory_attached").alias("action"), F.to_json(F.struct("payload_hash", "wire_format_version", "audit_rows")).alias("payload"))


def list_attached(registry: DataFrame, payloads: DataFrame) -> DataFrame:
    there = payloads.select("machine_id").distinct().withColumn("payload_exists", F.lit(True))
    return registry.join(there, "machine_id", "left").withColumn("payload_exists", F.coalesce("payload_exists", F.lit(False))).orderBy(F.desc("imported_at"), "machine_id")


def resolve_attached(registry: DataFrame, prefix: str) -> DataFrame:
    found = registry.filter(F.col("machine_id").startswith(prefix))
    if (n := found.limit(2).count()) != 1:
        raise ValueError(f"{prefix!r} names {'no' if n == 0 else 'more than one'} inventory")
    return found


def policy_tables(spark: SparkSession, policy: dict) -> dict[str, DataFrame]:
    """Rule tables, in rule order, of a parsed policy file."""
    if policy.get("version") != 1 or policy.get("kind") not in POLICY_KINDS:
        raise ValueError("not a version 1 policy of a known kind")
    if unknown := set(policy) - KNOWN_FIELDS:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    out = {}
    if policy.get("domains"):
        rows = [(i, d["name"], n) for i, d in enumerate(policy["domains"]) for r in d["rules"] for n in r["path_substring_any_of"]]
        out["domains"] = spark.createDataFrame(rows, "rule_order int, name string, needle string")
    if policy.get("clusters"):
        rows = [(i, c["label"], r) for i, c in enumerate(policy["clusters"]) for r in c["regex_any_of"]]
        out["clusters"] = spark.createDataFrame(rows, "rule_order int, label string, pattern string")
    if policy.get("phases"):
        rows = [(i, p["name"], {k: str(v) for k, v in p["match"].items()}, p["destination_root"], p.get("max_files")) for i, p in enumerate(policy["phases"])]
        out["phases"] = spark.createDataFrame(rows, "rule_order int, name string, match map<string,string>, destination_root string, max_files int")
    flat = lambda prefix, x: [p for k, v in x.items() for p in flat(f"{prefix}{k}.", v)] if isinstance(x, dict) else [(prefix[:-1], i, str(v)) for i, v in enumerate(x if isinstance(x, list) else [x]) if v is not None]
    # retention, replication and archive rules: a row a setting, lists in order
    for name in ("defaults", "exclusions", "dedup_retire"):
        if policy.get(name):
            out[name] = spark.createDataFrame(flat("", policy[name]), "setting string, place int, value string")
    for name in ("sources", "targets", "replications", "archives"):
        if policy.get(name):
            rows = [(i, *r) for i, entry in enumerate(policy[name]) for r in flat("", entry if isinstance(entry, dict) else {"value": entry})]
            out[name] = spark.createDataFrame(rows, "rule_order int, setting string, place int, value string")
    return out


def health_series(spark: SparkSession, path: str, schema: str, limit: int = 48) -> DataFrame:
    """Last points, oldest first; lines that can't be read are dropped."""
    points = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return points.orderBy(F.desc("generated_at")).limit(limit).orderBy("generated_at")


@dataclass(frozen=True)
class Verified:
    rows: DataFrame
    chains: DataFrame


def verified_inventory(claims: DataFrame, audit: DataFrame) -> Verified:
    """Claims of the machines whose log is intact, and all verdicts."""
    verdicts = chains.verify_chain(audit)
    return Verified(claims.join(verdicts.filter("ok").select("machine_id"), "machine_id", "left_semi"), verdicts)
