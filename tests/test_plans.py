"""Laws of plans and logs."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from estatum.operators import audit, embed, health, joins, stats
from estatum.plans import plan, stash
from estatum.testbed import Estate

CLAIM = "claim_id long, permanode_id string, canonical_hash string, machine_id string, file_path string, tier string, size_bytes long, domain string, is_current boolean, container_path string"


def claims(spark, *rows):
    return spark.createDataFrame([(i, p, "0" * 64, "m1", path, tier, 1000, dom, True, None) for i, p, path, tier, dom in rows], CLAIM)


def test_cloud_copy_is_retired_directly(spark):
    c = claims(spark, (1, "a" * 32, "/Volumes/Level 1/x", "L1", None), (2, "a" * 32, "/Volumes/DropboxStorage/x", "DropboxStorage", None))
    r = plan.dedup_retire(c, plan.Retention(), "run").collect()
    assert [(x.action, x.destination_path, x.destination_tier) for x in r] == [("retire_direct", None, "dropbox-cloud-trash-account-specific")]


def test_recovered_copies_never_win(spark):
    c = claims(spark, (1, "a" * 32, "/Users/u/Recovered/x", "boot", None), (2, "a" * 32, "/Volumes/Level 2/x", "L2", None))
    r = plan.dedup_retire(c, plan.Retention(recovered=("/Recovered/",)), "run").collect()
    assert [x.claim_id for x in r] == [1]


def test_plan_spares_a_keeper(spark, folder):
    e = Estate(spark, folder)
    current = joins.current_claims(e.claims.drop("canonical_hash"), e.permanodes)
    rows = plan.dedup_retire(current, plan.Retention(), "run")
    left = current.join(rows, "claim_id", "left_anti").select("permanode_id").distinct()
    assert rows.count() > 0 and rows.join(left, "permanode_id", "left_anti").count() == 0


def test_destination_conflict(spark):
    c = claims(spark, *[(i, p, f"/Volumes/Level 2/{d}/x", "L2", None) for i, (p, d) in enumerate([("a" * 32, "p"), ("a" * 32, "q"), ("b" * 32, "r"), ("b" * 32, "s")])])
    r = plan.dedup_retire(c, plan.Retention(stash_roots={"L2": "/S"}), "run").collect()
    assert len(r) == 2 and all(x.destination_conflict for x in r)


def test_promote_caps_phases(spark):
    c = claims(spark, *[(i, f"{i:032d}", f"/Volumes/Backup/Music/{i}.mp3", "Backup", "music") for i in range(4)], (9, "z" * 32, "/Volumes/Backup/a", "Backup", "music"), (10, "z" * 32, "/Volumes/Level 2/a", "L2", "music"))
    phases = [plan.Phase("odd", "/X", domain="music", other_keys=("size",)), plan.Phase("music", "/M", domain="music", max_files=2, mirror_from="/Music/")]
    r = plan.promote(c, phases).collect()
    assert [x.destination_path for x in r] == ["/M/0.mp3", "/M/1.mp3"]


def test_stash_life(spark):
    j = lambda s: f'{{"source":"{s}","destination":"/d"}}'
    rows = [(1, "m", "r", "stash_committed", j("a")), (2, "m", "r", "stash_committed", j("b")), (3, "m", "r", "stash_finalized", j("a")), (4, "m", None, "stash_committed", j("c")), (5, "m", "r", "stash_committed", "not json"), (6, "m", "r", "stash_restored", j("z"))]
    log = spark.createDataFrame(rows, "id long, machine_id string, manifest_run_id string, action string, payload string").withColumns({"timestamp": F.lit("2026-01-01").cast("timestamp"), "permanode_id": F.lit(None).cast("string")})
    assert [r.source for r in stash.entries(log).collect()] == ["b"]


FIELDS = ["action", "payload"]


def chain(spark, n=30):
    rows = spark.createDataFrame([(f"m{i % 2}", i, "a", f"é{i}") for i in range(n)], "machine_id string, id long, action string, payload string")
    return audit.append_batch(rows.withColumn("row_hash", F.lit("")).filter("false"), rows, FIELDS).cache()


@pytest.mark.parametrize("field", ["action", "payload", "prev_hash", "row_hash"])
def test_tampering_is_found(spark, field):
    bad = chain(spark).withColumn(field, F.when(F.col("id") == 12, "0" * 63 + "1").otherwise(F.col(field)))
    got = {r.machine_id: (r.ok, r.rows_checked, r.bad_id) for r in audit.verify_chain(bad, FIELDS).collect()}
    assert got == {"m0": (False, 6, 12), "m1": (True, 15, None)}
    only = bad.filter("machine_id = 'm0'")
    r = audit.verify_long_chain(only, 4, FIELDS).first()
    assert (r.ok, r.rows_checked, r.bad_id) == (False, 6, 12)


def test_chain_grows_behind_its_tip(spark):
    c = chain(spark, 10)
    more = spark.createDataFrame([("m0", 100, "b", None), ("m7", 101, "b", "x")], "machine_id string, id long, action string, payload string")
    both = c.unionByName(audit.append_batch(c, more, FIELDS))
    assert all(r.ok for r in audit.verify_chain(both, FIELDS).collect())


def test_segments(spark, tmp_path):
    c = chain(spark).filter("machine_id = 'm0'").withColumn("id", F.col("id") / 2).withColumn("id", F.col("id").cast("long"))
    p = audit.plan_segment(c, 9, hot_min_rows=3)
    registry = audit.seal_segment(c, p, "s1", str(tmp_path / "seg"))
    assert [r.ok for r in audit.verify_segments(spark.read.parquet(str(tmp_path / "seg")), registry, FIELDS).collect()] == [True]
    assert audit.plan_segment(c, 9, hot_min_rows=50).first().refused == "too few rows left hot"


def test_fan_out_of_nothing_is_local(spark, folder):
    from estatum.sources import files

    c = Estate(spark, folder).claims
    assert sorted(stats.by_tier(files.fan_out(c)).collect()) == sorted(stats.by_tier(c).collect())


def test_tree_children_sum_to_the_parent(spark, folder):
    c = Estate(spark, folder).claims
    kids = stats.path_tree(c, "/Volumes", limit=500).agg(F.sum("bytes_total"), F.sum("claim_count")).first()
    whole = stats.current(c).filter(F.col("file_path").startswith("/Volumes/")).agg(F.sum("size_bytes"), F.count(F.lit(1))).first()
    assert tuple(kids) == tuple(whole)


def test_cross_refuses(spark, folder):
    c = Estate(spark, folder).claims
    for bad in (("tier", "tier"), ("colour", None), ("source", None)):
        with pytest.raises(ValueError):
            stats.cross(c, *bad)


def test_calendar_jobs(spark):
    kinds = "job string, period_hours double, weekday int, day int, month int, hour int, minute int, last_run_at timestamp"
    ts = lambda s: __import__("datetime").datetime.fromisoformat(s)
    rows = [("sunday", None, 0, None, None, 3, 0, ts("2026-08-01 00:00")), ("daily ok", None, None, None, None, 3, 0, ts("2026-08-05 03:30")), ("daily late", None, None, None, None, 3, 0, ts("2026-08-03 03:30")), ("new", None, None, None, None, 3, 0, None), ("period", 24.0, None, None, None, None, None, ts("2026-08-04 00:00")), ("none", None, None, None, None, None, None, None)]
    out = health.overdue_jobs(spark.createDataFrame(rows, kinds), F.lit("2026-08-05 12:00").cast("timestamp"))
    assert {r.job: r.overdue for r in out.collect()} == {"sunday": True, "daily ok": False, "daily late": True, "new": True, "period": True, "none": None}


def test_hash_rule():
    assert audit.row_hash("0" * 64, {"b": None, "a": "x"}) == hashlib.sha256(("0" * 64 + '{"a":"x","b":null}').encode()).hexdigest()


def test_search_of_many_queries(spark):
    """Queries in many batches get the same neighbours."""
    vectors = spark.range(60).selectExpr("CAST(id AS STRING) AS permanode_id", "array(float(id), float(id % 7)) AS vector")
    asked = spark.range(40).selectExpr("id AS query_id", "array(float(id + 0.2), float(id % 5)) AS query")
    few, many = ({(r.query_id, r["rank"], r.permanode_id) for r in embed.search_many(vectors, asked, 3, "l2", batch=batch).collect()} for batch in (1000, 7))
    assert few == many and len(many) == 120


RETAIN = {"version": 1, "kind": "RetentionPolicy", "exclusions": {"always_skip_substrings": ["/x/"], "no_promote_substrings": [".photoslibrary/"], "basename_prefixes": ["._"], "basename_exact": [".DS_Store"]}, "dedup_retire": {"tier_priority": {"L1": 1, "Backup": 6}, "live_tiers": ["L1"], "cooling_off_days": 3, "stash_roots": {"L1": "/s"}, "nas_manifest_tiers": ["Backup"], "recovered_substrings": ["/RECOVERED-"]}}
PROMOTE = {"version": 1, "kind": "PromotionPolicy", "defaults": {"mirror_strip_prefix": "/Volumes/Backup/", "path_translations": [{"from": "/n/", "to": "/m/"}]}, "phases": [{"name": "a", "match": {"domain": "photos"}, "destination_root": "/p", "max_files": 2}, {"name": "b", "match": {"path_contains": "/b/", "year": "2024"}, "destination_root": "/q", "mirror_from": "b/"}]}


def test_policies_become_plans():
    got = plan.retention_of(RETAIN)
    assert got == plan.Retention(("/x/",), ("._",), (".DS_Store",), {"L1": 1, "Backup": 6}, ("L1",), ("Backup",), {"L1": "/s"}, ("/RECOVERED-",), 3, (".photoslibrary/",))
    p = plan.promotion_of(PROMOTE)
    assert p.phases == [plan.Phase("a", "/p", "photos", None, 2, None, ()), plan.Phase("b", "/q", None, "/b/", None, "b/", ("year",))]
    assert (p.source_tier, p.translations, p.strip) == ("Backup", [("/n/", "/m/")], "/Volumes/Backup/")
    change = lambda base, **x: {**base, **x}
    for bad in (change(RETAIN, version=2), change(RETAIN, kind="Other"), change(RETAIN, colour=1), change(RETAIN, exclusions={"skip": []}), change(RETAIN, dedup_retire={"live_tiers": []}), change(RETAIN, dedup_retire={**RETAIN["dedup_retire"], "cooling_off_days": -1}), change(RETAIN, dedup_retire={**RETAIN["dedup_retire"], "strategy": "newest"}), {"version": 1}):
        with pytest.raises(ValueError):
            plan.retention_of(bad)
    for bad in (change(PROMOTE, phases=[{"name": "a"}]), change(PROMOTE, phases=[{**PROMOTE["phases"][0], "max_files": 0}]), change(PROMOTE, defaults={"colour": 1}), change(PROMOTE, defaults={"path_translations": [{"from": "/a"}]})):
        with pytest.raises(ValueError):
            plan.promotion_of(bad)


def test_promotion_leaves_out_what_retention_names(spark):
    rows = [(1, "p1", "/Volumes/Backup/x.photoslibrary/1", "photos"), (2, "p2", "/Volumes/Backup/d/2", "photos"), (3, "p3", "/Volumes/Backup/b/3", None)]
    claims = spark.createDataFrame([(*r, "h", 1, "Backup") for r in rows], "claim_id long, permanode_id string, file_path string, domain string, canonical_hash string, size_bytes long, tier string")
    out = plan.promotion_of(PROMOTE).promote(claims, plan.retention_of(RETAIN)).collect()
    assert [(r.claim_id, r.phase, r.destination_path) for r in out] == [(2, "a", "/p/d/2")]


def test_pooling_of_long_vectors(spark):
    """The mask's sum and the length are worked out once, not for each entry."""
    v = F.transform(F.sequence(F.lit(1), F.lit(512)), lambda x: (x + F.col("id")).cast("double"))
    rows = spark.range(0, 8, 1, 1).select("id", embed.mean_pool_normalize(F.array(v, v, F.transform(v, lambda x: x * 9)), F.array(F.lit(1), F.lit(1), F.lit(0))).alias("u"))
    began = time.perf_counter()
    got = rows.collect()
    assert time.perf_counter() - began < 15
    for r in got:
        length = sum((i + r.id) ** 2 for i in range(1, 513)) ** 0.5
        assert r.u == pytest.approx([(i + r.id) / length for i in range(1, 513)])
    empty = embed.mean_pool_normalize(F.array(F.array(F.lit(3.0))), F.array(F.lit(0)))
    assert spark.range(1).select(empty.alias("u")).first().u == [0.0]
