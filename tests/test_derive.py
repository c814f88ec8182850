import pytest
from pyspark.sql import functions as F

from estatum.functions import derive as d


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "p string").select(f(F.col("p")).alias("x")).first().x


def tier_cases():
    """A path below each prefix, one beside it, and paths that no prefix names."""
    for prefix, tier, volume in d.TIER_PREFIXES:
        yield f"{prefix}{'' if prefix.endswith('/') else '/'}k/q.bin", tier, volume
    yield from [(None, "unknown", ""), ("", "unknown", ""), ("relative/q", "unknown", ""), ("/srv/q", "unknown", "")]
    yield from [("/Volumes/Kestrel/q", "other-volume", "Kestrel"), ("/Volumes/Level 2", "other-volume", None), ("/volumes/Level 2/q", "unknown", "")]
    yield from [(f"/Users/kim/{d.MOUNT_REL}{end}", "DropboxStorage", "Dropbox_CloudStorage") for end in ("", "/q", "-Work/q")]
    yield from [(f"/Users/kim/{d.MOUNT_REL}x/q", "boot", "boot-Users")]


@pytest.mark.parametrize(("path", "tier", "volume"), list(tier_cases()))
def test_tier(spark, path, tier, volume):
    assert one(spark, path, d.tier) == tier and (volume is None or one(spark, path, d.volume) == volume)


@pytest.mark.parametrize(("path", "ext"), [("/a/b.TXT", "txt"), ("/a/.bashrc", "bashrc"), ("/a/b", None), ("/a/b.", None), ("/a.b/c", None)])
def test_extension(spark, path, ext):
    assert one(spark, path, d.extension) == ext


def test_permanode_id(spark):
    rows = spark.createDataFrame([(" AB ", 1), ("ab", 1), ("ab", 2), ("", 1), ("ab", -1)], "h string, s long")
    ids = [r.x for r in rows.select(d.permanode_id(F.col("h"), F.col("s")).alias("x")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 32 and ids[3:] == [None, None]


def test_segments(spark):
    seg = lambda p, q: one(spark, p, lambda c: d.next_segment(c, q))
    assert seg("/a/b/c.txt", "/a") == "b" and seg("/a/c.txt", "/a") is None and seg("/ab/c/d", "/a") is None
    assert one(spark, "/a/c.txt", lambda c: d.leaf_name(c, "/a/")) == "c.txt"
    assert one(spark, "/a_b/x", lambda c: d.under_prefix(c, "/a%")) is False


def test_promote_destination(spark):
    to = lambda p, **k: one(spark, p, lambda c: d.promote_destination(c, "/D/", **k))
    assert to("/x/Music/a/Music/b.mp3", mirror_from="/Music/") == "/D/b.mp3"
    assert to("/x/Music/", mirror_from="/Music/", strip="/x/") == "/D/Music/"
    assert to("/x/y/z", strip="/x/") == "/D/y/z" and to("/q/z") == "/D/z"


def test_presence_names(spark):
    assert one(spark, "a/b (Selective Sync Conflict)/c", d.is_conflict_name) is True
    assert one(spark, "a/b/c", d.is_conflict_name) is False
    store = "/Volumes/DropboxStorage/Dropbox/a"
    assert one(spark, store, lambda c: d.path_aliases(c, "/h")) == [store, "/Volumes/DropboxStorage/.CloudStorage/Data/Dropbox/a", "/h/Library/CloudStorage/Dropbox/a"]
    assert one(spark, "/s/a", lambda c: d.map_store_mount(c, "/h", "/s", "/m")).mount_path == "/m/a"


def test_levels(spark):
    rows = spark.createDataFrame([("a", "ok"), ("a", "skipped"), ("b", "warn"), ("b", "unknown"), ("c", "fail"), ("c", "warn")], "k string, l string")
    got = {r.k: r.w for r in rows.groupBy("k").agg(d.worst_level(F.col("l")).alias("w")).collect()}
    assert got == {"a": "ok", "b": "warn", "c": "fail"}
    assert spark.createDataFrame([], "l string").agg(d.worst_level(F.col("l")).alias("w")).first().w == "unknown"
    ages = [one(spark, v, lambda c: d.level_for_age(c.cast("double"), 10)) for v in ("10", "10.5", None)]
    assert ages == ["ok", "fail", "fail"]
    assert one(spark, "not a time", lambda c: d.age_hours(c, F.current_timestamp())) is None


def test_canonical_json(spark):
    import json

    rows = [("a", None), ("é 😀 ü", 'q"uo\\te\n'), ("ASCII only", "ÿ\x7f~")]
    got = spark.createDataFrame(rows, "b string, a string").select("a", "b", d.canonical_audit_json(["b", "a", "id"]).alias("j")).collect()
    assert all(r.j == json.dumps({"a": r.a, "b": r.b}, sort_keys=True, separators=(",", ":")) for r in got) and len(got) == 3
