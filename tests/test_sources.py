import datetime
import hashlib
import io
import os
import tarfile
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from estatum.operators import embed
from estatum.sources import files, sinks, trees


def test_scan_and_hash(spark, tmp_path):
    (tmp_path / "a" / "@eaDir").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_text("hello")
    (tmp_path / "a" / "@eaDir" / "y").write_text("no")
    listed = files.skip_noise_paths(files.scan_tree(spark, str(tmp_path))).collect()
    assert [(r.path.endswith("/a/x.txt"), r.size_bytes) for r in listed] == [(True, 5)]
    hashed = files.skip_noise_paths(files.hash_files(spark, str(tmp_path))).first()
    assert hashed.hash == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824" and hashed.error is None


def test_walk_lists_no_more_than_it_must(spark, tmp_path):
    """Directories on the skip list are never listed, links never followed."""
    calls = tmp_path / "calls"
    root = tmp_path / "root"
    for p in ("a/b/c", "a/@eaDir/deep", "d/.Trashes", "e"):
        (root / p).mkdir(parents=True)
    for p in ("a/x", "a/b/c/y", "a/@eaDir/deep/no", "d/.hidden", "d/._no", "d/.DS_Store", "d/_u"):
        (root / p).write_text("1")
    (root / "e" / "link").symlink_to(root / "a")
    (root / "e" / "file").symlink_to(root / "a" / "x")
    os.mkfifo(root / "e" / "pipe")

    def lister(path):
        with open(calls, "a") as f:
            f.write(path + "\n")
        return trees.list_directory(path)

    for listed in (1, 3, 5000):
        calls.write_text("")
        rows = trees.walk(spark, f"file://{root}", lister, listed).collect()
        assert sorted(r.path.removeprefix(str(root)) for r in rows if r.kind == "file") == ["/a/b/c/y", "/a/x", "/d/.hidden", "/d/_u"]
        want = sorted(str(root / p) for p in ("", "a", "a/b", "a/b/c", "d", "e"))
        assert sorted(calls.read_text().split("\n")[:-1]) == want == sorted(r.path for r in rows if r.kind == "dir")


def test_what_cannot_be_listed_or_read(spark, tmp_path):
    (tmp_path / "big").write_bytes(b"x" * 1000)
    (tmp_path / "gone").write_text("1")

    def lister(path):
        if path.endswith("/bad"):
            raise OSError("no entry")
        yield from trees.list_directory(path)
        yield "bad", "dir", None, None, None

    assert [(r.path.rpartition("/")[2], r.error) for r in trees.walk(spark, str(tmp_path), lister).filter("error IS NOT NULL").collect()] == [("bad", "no entry")]
    listed = files.scan_tree(spark, str(tmp_path)).cache()
    assert listed.count() == 2
    (tmp_path / "gone").unlink()
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")
    try:
        for algo, digits in (("sha256", 64), ("xxh3_128", 32)):
            got = {r.path.rpartition("/")[2]: r for r in files.hash_listed(listed, algo).collect()}
            assert len(got["big"].hash) == digits and got["big"].size_bytes == 1000 and got["big"].error is None
            assert got["gone"].hash is None and "No such file" in got["gone"].error and got["gone"].mtime is not None
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    with pytest.raises(ValueError):
        files.hash_files(spark, str(tmp_path), "md5")


def archives(folder):
    with zipfile.ZipFile(folder / "a.ZIP", "w") as f:
        f.writestr("d/a.txt", "one")
        f.writestr("d/b.txt", "two" * 1000, zipfile.ZIP_DEFLATED)
        f.writestr("d/c.txt", "three" * 1000, zipfile.ZIP_BZIP2)
        f.writestr("__MACOSX/d/._a.txt", "no")
        f.writestr("d/spoilt.txt", "spoilt bytes")
    raw = bytearray((folder / "a.ZIP").read_bytes())
    at = raw.index(b"spoilt bytes")
    raw[at] ^= 1
    (folder / "a.ZIP").write_bytes(raw)
    for name, mode in (("b.tgz", "w:gz"), ("c.tar.xz", "w:xz"), ("d.tar", "w")):
        with tarfile.open(folder / name, mode) as f:
            for member, data in (("b.txt", b"two"), ("@eaDir/x", b"no"), ("e/big", b"0123456789" * 5000)):
                info = tarfile.TarInfo(member)
                info.size = len(data)
                f.addfile(info, io.BytesIO(data))
    (folder / "bad.tar").write_bytes(b"junk")
    (folder / "bad.zip").write_bytes(b"junk")
    cut = (folder / "b.tgz").read_bytes()
    (folder / "cut.tgz").write_bytes(cut[: len(cut) // 2])
    (folder / "c.txt").write_text("text")


def test_archives(spark, tmp_path):
    archives(tmp_path)
    rows = files.explode_archives(files.scan_tree(spark, str(tmp_path))).collect()
    got = {(r.container_path.rpartition("/")[2], r.member): r for r in rows}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for member, data in (("d/a.txt", b"one"), ("d/b.txt", b"two" * 1000), ("d/c.txt", b"three" * 1000)):
        r = got.pop(("a.ZIP", member))
        assert (r.hash, r.size_bytes, r.error, r.container_sha256) == (sha(data), len(data), None, sha((tmp_path / "a.ZIP").read_bytes()))
    assert "checksum" in got.pop(("a.ZIP", "d/spoilt.txt")).error
    for name in ("b.tgz", "c.tar.xz", "d.tar"):
        assert [got.pop((name, m)).hash for m in ("b.txt", "e/big")] == [sha(b"two"), sha(b"0123456789" * 5000)]
    assert got.pop(("bad.tar", None)).error and got.pop(("bad.zip", None)).error
    assert got and {k[0] for k in got} == {"cut.tgz"} and any(r.error for r in got.values())
    trees.register(spark)
    files.scan_tree(spark, str(tmp_path)).filter("path LIKE '%a.ZIP' OR path LIKE '%tar.xz'").createOrReplaceTempView("some_archives")
    lateral = spark.sql("SELECT m.* FROM some_archives s, LATERAL archive_members(s.path) m").collect()
    assert sorted((r.member, r.hash) for r in lateral) == sorted((r.member, r.hash) for r in rows if r.container_path.endswith(("a.ZIP", "tar.xz")))


def test_members_pass_in_chunks(tmp_path, monkeypatch):
    """A member of 64 MB takes a few chunks of memory."""
    monkeypatch.setattr(trees, "CHUNK", 1 << 20)
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big", "w") as f:
        for _ in range(64):
            f.write(bytes(1 << 20))
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as t:
        info = tarfile.TarInfo("big")
        info.size = 64 << 20
        with zipfile.ZipFile(tmp_path / "z.zip") as z:
            t.addfile(info, z.open("big"))
    tracemalloc.start()
    try:
        (lot,) = trees.places_of(str(tmp_path / "z.zip"))
        rows = [*trees.zip_rows(str(tmp_path / "z.zip"), "-", map(trees.Place, lot), "sha256"), *trees.tar_rows(str(tmp_path / "t.tgz"), "-", "sha256")]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {r[3:] for r in rows} == {(hashlib.sha256(bytes(64 << 20)).hexdigest(), 64 << 20, None)} and most < 16 << 20


def test_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("stash", "a" * 32, "0" * 64, 5, "/x", "L2", None, "L2", "why"), ("#stash", "b" * 32, "0" * 64, 6, "/tab\tand\nline\\n\r", "L2", "/d#\\t", "L2", None)], files.MANIFEST)
    sinks.write_manifest(rows, str(tmp_path / "m"), {"run": "r1"})
    head, back = files.read_manifest(spark, str(tmp_path / "m"))
    assert head["run"] == "r1" and sorted(back.collect()) == sorted(rows.collect(), key=lambda r: r.action)
    (tmp_path / "bad.tsv").write_text("\t".join(files.COLUMNS) + "\n")
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "bad.tsv"))


def test_plans_are_loaded_as_they_are(spark, tmp_path):
    """Tabs, quotes, backslashes and comments survive; foreign files are read as CSV."""
    odd = '/a\tb/c\\d "e"\n#'
    rows = spark.createDataFrame([("stash", "a" * 32, "0" * 64, 5, odd, "L2", None, "L2", '"why"'), ("#x", "b" * 32, "0" * 64, 6, '"/q', "L2", "", "L2", None)], files.MANIFEST)
    sinks.write_manifest(rows.repartition(2), str(tmp_path / "m"), {"run": "r1", "by": "a: b"})
    comments, back = files.load_plan_rows(spark, str(tmp_path / "m"))
    assert sorted(comments) == ["# by: a: b", "# estatum-manifest-v1", "# run: r1"] and back.columns == files.COLUMNS
    assert sorted((r.action, r.source_path, r.rationale) for r in back.collect()) == [("#x", '"/q', ""), ("stash", odd, '"why"')]
    assert len(list((tmp_path / "m" / "1-rows").glob("part-*"))) == 2
    (tmp_path / "f.tsv").write_bytes(b'# one\nsource_path\tmy col\textra\n/a\t"x\ty"\t1\n# two\n/b\xff\t""\n\n/c\tp ""q\t2\tmore\n')
    comments, back = files.load_plan_rows(spark, str(tmp_path / "f.tsv"))
    assert comments == ["# one", "# two"] and back.columns == ["source_path", "my col", "extra"]
    assert sorted(map(tuple, back.collect()), key=str) == [("/a", "x\ty", "1"), ("/b\ufffd", "", None), ("/c", 'p ""q', "2")]
    (tmp_path / "empty.tsv").write_text("# only\n")
    assert files.load_plan_rows(spark, str(tmp_path / "empty.tsv"))[0] == ["# only"]


def test_snapshot(spark, tmp_path):
    t = {"claims": spark.range(5), "tiers": spark.range(2)}
    m = sinks.export_snapshot(t, str(tmp_path), "m1").first()
    assert m.claim_rows == 5 and not (tmp_path / "tiers").exists()
    assert sinks.export_snapshot({"claims": spark.range(5).repartition(3)}, str(tmp_path / "2"), "m1").first().payload_hash == m.payload_hash


def test_payload_hash_sees_changes(spark):
    h = lambda rows, ddl="a long, b string, t timestamp": spark.createDataFrame(rows, ddl).repartition(3).agg(sinks.content_hash(spark.createDataFrame(rows, ddl)).alias("h")).first().h
    at = datetime.datetime(2024, 1, 1, 0, 0, 0, 1)
    rows = [(1, "x", at), (1, "x", at), (3, None, None)]
    assert h(rows) == h(rows[::-1])
    others = [[(2, "x", at), (2, "x", at), (3, None, None)], rows[:2], rows + rows[:1], [(1, "x", at), (3, None, None), (3, None, None)], [*rows[:2], (3, "", None)], [(1, "x", at), (1, "x", at.replace(microsecond=2)), rows[2]], []]
    assert len({h(r) for r in [rows, *others]}) == len(others) + 1
    assert h([(1, 2)], "a long, b long") != h([(2, 1)], "a long, b long")


def test_policies(spark):
    good = {"version": 1, "kind": "ClassificationPolicy", "domains": [{"name": "d", "rules": [{"path_substring_any_of": ["/a/", "/b/"]}]}]}
    assert files.policy_tables(spark, good)["domains"].count() == 2
    for bad in ({**good, "version": 2}, {**good, "colour": 1}, {**good, "kind": "Other"}):
        with pytest.raises(ValueError):
            files.policy_tables(spark, bad)


def test_buckets_and_series(spark, tmp_path):
    rows = spark.createDataFrame([("dual", "a"), ("store_only", "b")], "kind string, p string")
    sinks.write_buckets(rows, str(tmp_path / "b"))
    assert sorted(x.name for x in (tmp_path / "b" / "buckets").glob("kind=*")) == ["kind=dual", "kind=store_only"]
    for i in range(3):
        sinks.append_health_snapshot(spark.createDataFrame([(f"2026-01-0{i + 1}", "m")], "generated_at string, machine_id string"), str(tmp_path / "s"))
    (tmp_path / "s" / "series" / "bad.json").write_text("{broken\n")
    assert [r.generated_at for r in files.health_series(spark, str(tmp_path / "s" / "series"), "generated_at string, machine_id string", 2).collect()] == ["2026-01-02", "2026-01-03"]


def test_resolve(spark):
    reg = spark.createDataFrame([("abc",), ("abd",)], "machine_id string")
    assert files.resolve_attached(reg, "abc").count() == 1
    for p in ("ab", "x"):
        with pytest.raises(ValueError):
            files.resolve_attached(reg, p)


def test_stub_vectors(spark):
    v = embed.stub_vector("x")
    assert len(v) == 384 and abs(float((v * v).sum()) - 1) < 1e-5 and (v == embed.stub_vector("x")).all() and (v != embed.stub_vector("y")).any()
    rows = spark.createDataFrame([("a", "x"), ("b", "bad")], "permanode_id string, text string")

    def fussy(texts):
        if (texts == "bad").any():
            raise ValueError("no")
        return embed.stub_embedder(texts)

    got = embed.batch_report(embed.run(rows, fussy)).first()
    assert tuple(got) == (2, 1, 1)
    assert embed.search(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "permanode_id string, vector array<float>"), F.array(F.lit(0.1), F.lit(1.0)), 1).first().permanode_id == "b"


def test_series_of_equal_times(spark):
    """Of points of one time those of the greatest ids stay, however they are dealt."""
    at = F.lit("2026-01-01").cast("timestamp")
    points = spark.range(4000).repartition(7, "id").select("id", F.lit("m").alias("machine_id"), (at + F.make_dt_interval(days=(F.col("id") % 2).cast("int"))).alias("generated_at"))
    got = {r.id for r in sinks.prune_series(points, at, 90, 2500).select("id").collect()}
    assert got == {i for i in range(4000) if i % 2 or i >= 3000}
