"""Column expressions over file claims: path parts, tiers, identities, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Storage classes by path prefix, in the order in which they are
# tried: (prefix, tier, volume).
TIER_PREFIXES = (
    ("/Users/", "boot", "boot-Users"),
    ("/private/", "boot", "boot-system"),
    ("/var/", "boot", "boot-system"),
    ("/Volumes/Level 1w", "L1w", "Level_1w"),
    ("/Volumes/Level 1/", "L1", "Level_1"),
    ("/Volumes/Level 2/", "L2", "Level_2"),
    ("/Volumes/Level_3a/", "L3a", "Level_3a"),
    ("/Volumes/NFS-Level3a/", "L3a", "Level_3a"),
    ("/Volumes/Backup/", "Backup", "Backup"),
    ("/Volumes/NFS-Backup/", "Backup", "Backup"),
    ("/Volumes/DropboxStorage", "DropboxStorage", "DropboxStorage"),
    ("/Volumes/BOOTCAMP/", "BOOTCAMP", "BOOTCAMP"),
)
# How cloud mounts, tiers by preference, store roots, conflict copies,
# archive sizes and levels are named and ranked.
CLOUD_MOUNT = r"/Library/CloudStorage/Dropbox(-[^/]+)?(/|$)"
TIER_PRIORITY = {"boot": 0, "L1": 1, "L1w": 2, "L2": 3, "L3a": 4, "DropboxStorage": 5, "Backup": 6, "BOOTCAMP": 7, "other-volume": 8, "unknown": 99}
UNLISTED = 999
CLOUD_STORES = ("/Volumes/DropboxStorage/.CloudStorage/Data/Dropbox/", "/Volumes/DropboxStorage/Dropbox/")
MOUNT_REL = "Library/CloudStorage/Dropbox"
ICLOUD_REL = "Library/Mobile Documents"
CONFLICT = " (Selective Sync Conflict)"
ARCHIVE_GRADE = 104857600
LEVEL_RANK = {"ok": 0, "skipped": 0, "unknown": 1, "warn": 2, "fail": 3}


def _first(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = otherwise if otherwise is not None else F.lit(None)
    for cond, value in reversed(cases):
        out = F.when(cond, value).otherwise(out)
    return out


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.left(path, F.greatest(F.lit(1), F.length(path) - F.length(basename(path)) - 1))).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    base = basename(path)
    return F.when(F.contains(base, F.lit(".")), F.nullif(F.lower(F.substring_index(base, ".", -1)), F.lit("")))


def path_parts(path: Column) -> Column:
    return F.struct(parent_dir(path).alias("parent_dir"), basename(path).alias("basename"), extension(path).alias("extension"))


def _tier(path: Column, k: int) -> Column:
    cloud = (path.rlike(CLOUD_MOUNT), F.lit(("DropboxStorage", "Dropbox_CloudStorage")[k]))
    rules = [(path.startswith(p), F.lit((t, v)[k])) for p, t, v in TIER_PREFIXES]
    other = (path.startswith("/Volumes/"), F.lit("other-volume") if k == 0 else F.regexp_extract(path, r"^/Volumes/([^/]+)/", 1))
    return _first([cloud, *rules, other], F.lit(("unknown", "")[k]))


def tier(path: Column) -> Column:
    return _tier(F.coalesce(path, F.lit("")), 0)


def volume(path: Column) -> Column:
    return _tier(F.coalesce(path, F.lit("")), 1)


def tier_priority(name: Column, priority: dict[str, int] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (priority or TIER_PRIORITY).items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), F.lit(UNLISTED))


def permanode_id(hash_: Column, size: Column) -> Column:
    """Null for an empty hash or a negative size."""
    clean = F.lower(F.trim(hash_))
    return F.when((F.length(clean) > 0) & (size >= 0), F.left(F.sha2(F.concat_ws(":", clean, size.cast("string")), 256), F.lit(32)))


def hash_grade(size: Column, suspected: Column) -> Column:
    return F.when((size >= ARCHIVE_GRADE) | F.coalesce(suspected, F.lit(False)), "archive").otherwise("fast")


def is_noise(path: Column, substrings=(), prefixes=(), exact=()) -> Column:
    base = basename(path)
    return any_of([path.contains(s) for s in substrings] + [base.startswith(p) for p in prefixes] + ([base.isin(*exact)] if exact else []))


def domain(path: Column, rules: list[tuple[str, list[str]]]) -> Column:
    low = F.lower(path)
    return _first([(any_of([low.contains(n.lower()) for n in needles]), F.lit(name)) for name, needles in rules], F.lit(None).cast("string"))


def cluster(path: Column, rules: list[tuple[str, list[str]]]) -> Column:
    return _first([(any_of([path.rlike(r) for r in regexes]), F.lit(label)) for label, regexes in rules], F.lit(None).cast("string"))


def classify(claims, domains, clusters, reclassify_all: bool = False):
    """Fill (or, with ``reclassify_all``, renew) domain and classification; a path
    that matches nothing keeps what it has."""
    out = claims
    for name, new in (("domain", domain(F.col("file_path"), domains)), ("classification", cluster(F.col("file_path"), clusters))):
        out = out.withColumn(name, F.coalesce(new, F.col(name)) if reclassify_all else F.coalesce(F.col(name), new))
    return out


def normalize_prefix(p: Column) -> Column:
    return F.rtrim(F.translate(p, "\\", "/"), F.lit("/"))


def under_prefix(path: Column, prefix: str) -> Column:
    p = prefix.rstrip("/")
    return (path == p) | path.startswith(p + "/")


def _rest(path: Column, prefix: str) -> Column:
    p = prefix.rstrip("/")
    return F.when(path.startswith(p + "/"), F.substring(path, len(p) + 2, 1 << 30))


def next_segment(path: Column, prefix: str) -> Column:
    """The directory under ``prefix`` on the way to ``path``; null for a direct child."""
    rest = _rest(path, prefix)
    return F.when(F.instr(rest, "/") > 0, F.substring_index(rest, "/", 1))


def leaf_name(path: Column, prefix: str) -> Column:
    rest = _rest(path, prefix)
    return F.when((F.instr(rest, "/") == 0) & (F.length(rest) > 0), rest)


def child_path(prefix: Column, name: Column) -> Column:
    return F.when(prefix == "", F.concat(F.lit("/"), name)).otherwise(F.concat(prefix, F.lit("/"), name))


def cloud_relative(path: Column, home: str) -> Column:
    roots = (f"{home}/{MOUNT_REL}/", *CLOUD_STORES)
    return F.coalesce(*[_first([(path.startswith(r), F.substring(path, len(r) + 1, 1 << 30)), (path == r.rstrip("/"), F.lit(""))], F.lit(None).cast("string")) for r in roots])


def _join(root: str, rel: Column) -> Column:
    clean = F.ltrim(rel, F.lit("/"))
    return F.when(clean == "", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), clean))


def cloud_store_path(rel: Column) -> Column:
    return _join(CLOUD_STORES[0].rstrip("/"), rel)


def cloud_mount_path(rel: Column, home: str) -> Column:
    return _join(f"{home}/{MOUNT_REL}", rel)


def is_cloud_path(path: Column, home: str) -> Column:
    return cloud_relative(path, home).isNotNull() | under_prefix(path, f"{home}/{ICLOUD_REL}")


def resolve_delete_target(path: Column, home: str, prefer_mount: bool = True) -> Column:
    """(target, tier_hint, used_mount): what to check is always what to delete."""
    rel = cloud_relative(path, home)
    icloud = under_prefix(path, f"{home}/{ICLOUD_REL}")
    target = F.when(rel.isNotNull(), cloud_mount_path(rel, home)).otherwise(path) if prefer_mount else path
    hint = _first([(rel.isNotNull(), F.lit("DropboxStorage")), (icloud, F.lit("iCloudDrive"))], F.lit(None).cast("string"))
    used = _first([(rel.isNotNull(), F.lit(prefer_mount)), (icloud, F.lit(True))], F.lit(False))
    return F.struct(target.alias("target"), hint.alias("tier_hint"), used.alias("used_mount"))


def path_aliases(path: Column, home: str) -> Column:
    rel = cloud_relative(path, home)
    link = _join(CLOUD_STORES[1].rstrip("/"), rel)
    forms = F.array(path, cloud_store_path(rel), cloud_mount_path(rel, home), link)
    return F.when(rel.isNull(), F.array(path)).otherwise(F.array_distinct(forms))


def is_conflict_name(rel: Column) -> Column:
    return F.coalesce(F.exists(F.split(rel, "/"), lambda s: s.contains(CONFLICT) | s.endswith(CONFLICT.strip())), F.lit(False))


def map_store_mount(path: Column, home: str, store_root: str | None = None, mount_root: str | None = None) -> Column:
    """(relative, store_path, mount_path, kind) by prefixes only."""
    p, builtin = F.trim(path), cloud_relative(F.trim(path), home)
    store = (store_root or CLOUD_STORES[0]).rstrip("/")
    mount = (mount_root or f"{home}/{MOUNT_REL}").rstrip("/")
    given = [r for r in (store_root and store, mount_root and mount) if r] if store_root else []
    strip = lambda r: F.ltrim(F.substring(p, len(r) + 1, 1 << 30), F.lit("/"))
    rel = _first([(under_prefix(p, r), strip(r)) for r in given], builtin)
    out = rel.isNull() | (p == "")
    kind = _first([(out, F.lit("outside_store_root")), (is_conflict_name(rel), F.lit("conflict_name_path"))], F.lit("unknown"))
    return F.struct(rel.alias("relative"), F.when(out, F.nullif(p, F.lit(""))).otherwise(_join(store, rel)).alias("store_path"), F.when(~out, _join(mount, rel)).alias("mount_path"), kind.alias("kind"))


def translate_path(path: Column, rules: list[tuple[str, str]]) -> Column:
    return _first([(path.startswith(a), F.concat(F.lit(b), F.substring(path, len(a) + 1, 1 << 30))) for a, b in rules], path)


def promote_destination(path: Column, root: str, mirror_from: str | None = None, strip: str | None = None) -> Column:
    """Below ``root``: what follows the last sentinel, else the stripped prefix,
    else the name alone; an empty rest falls through."""
    parts = []
    if mirror_from:
        at = F.length(path) - F.locate(mirror_from[::-1], F.reverse(path)) + 2
        parts.append(F.when(path.contains(mirror_from), F.nullif(F.ltrim(F.substring(path, at, F.lit(1 << 30)), F.lit("/")), F.lit(""))))
    if strip:
        parts.append(F.when(path.startswith(strip), F.nullif(F.ltrim(F.substring(path, len(strip) + 1, 1 << 30), F.lit("/")), F.lit(""))))
    return F.concat(F.lit(root.rstrip("/") + "/"), F.coalesce(*parts, basename(path)))


def stash_destination(path: Column, tier_: Column, run_id: Column, roots: dict[str, str]) -> Column:
    root = _first([(tier_ == t, F.lit(r.rstrip("/"))) for t, r in roots.items()], F.concat(F.rtrim(parent_dir(path), F.lit("/")), F.lit("/_cooling-off-stash")))
    return F.concat_ws("/", root, run_id, basename(path))


def age_hours(ts: Column, now: Column) -> Column:
    """Hours up to ``now``, never negative; null for what can't be read."""
    t = F.try_to_timestamp(ts.cast("string"))
    return F.when(t.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(t)) / 3.6e9))


def level_for_age(age: Column, most: float, missing: str = "fail") -> Column:
    return _first([(age.isNull(), F.lit(missing)), (age > most, F.lit("fail"))], F.lit("ok"))


def level_rank(level: Column) -> Column:
    return _first([(level == k, F.lit(v)) for k, v in LEVEL_RANK.items()], F.lit(1))


def worst_level(level: Column) -> Column:
    """Aggregate: the worst level of a group; ok before skipped, unknown if none."""
    return F.coalesce(F.max_by(level, level_rank(level) * 2 + F.when(level == "ok", 1).otherwise(0)), F.lit("unknown"))


def capacity_level(free: Column, total: Column, least: int = 10 << 30, ratio: float = 0.05) -> Column:
    return _first([(free.isNull(), F.lit("unknown")), (free < least, F.lit("warn")), ((total > 0) & (free / total < ratio), F.lit("warn"))], F.lit("ok"))


def latency_level(ms: Column, most: float = 2000.0) -> Column:
    return _first([(ms.isNull(), F.lit("unknown")), (ms > most, F.lit("warn"))], F.lit("ok"))


def permanode_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def is_archive(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(zip|tar|tgz|tar\.gz|tbz2|tar\.bz2|txz|tar\.xz)$")


def canonical_audit_json(columns: list[str]) -> Column:
    """JSON of the named columns in ASCII, keys sorted, nulls kept, no blanks."""
    return ascii_json(F.to_json(F.struct(*[F.col(c) for c in sorted(columns) if c not in ("id", "prev_hash", "row_hash")]), {"ignoreNullFields": "false"}))


def ascii_json(text: Column) -> Column:
    """Characters beyond ASCII as \\u escapes of their UTF-16 units, in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"([\x00-\x7E]+|[^\x00-\x7E]+)"), F.lit(1))
    units = lambda x: F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^[\x00-\x7E]"), x).otherwise(units(x))), "")
    return F.when(text.rlike(r"[^\x00-\x7E]"), escaped).otherwise(text)


def audit_row_hash(prev: Column, payload: Column) -> Column:
    return F.when(prev.rlike("^[0-9a-f]{64}$"), F.sha2(F.concat(prev, payload), 256))
