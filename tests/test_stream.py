"""Streams give what the same events give as a batch."""

import hashlib
import json
import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from estatum.operators import audit, stats
from estatum.sources import watch
from estatum.streaming import stream


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def event(path, ts, kind="created", moved_to=None, root="r"):
    return {"path": path, "kind": kind, "moved_to": moved_to, "ts": f"2026-01-01T00:00:{ts}", "root": root, "is_dir": False}


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_debounce_matches_batch(spark, tmp_path):
    rows = [event("/a", "00.000"), event("/b", "00.500", moved_to="/c", kind="moved"), event("/a", "00.900"), event("/d", "03.000", "deleted"), event("/e/.Trashes/x", "03.100"), event("/z", "59.000")]
    write(tmp_path / "in", "1.json", rows)
    # an empty later file lets the watermark close what is open
    write(tmp_path / "in", "2.json", [event("/late", "59.900", root="other")])
    live = stream.unique_paths(stream.debounce(stream.file_events(spark, str(tmp_path / "in"))))
    batch = stream.unique_paths(stream.debounce(stream.clean_events(spark.read.schema(stream.EVENT).json(str(tmp_path / "in")))))
    got = {tuple(r.paths) for r in drain(live, tmp_path, "debounced")}
    want = {tuple(r.paths) for r in batch.collect()}
    assert ("/a", "/b", "/c") in want and got <= want and ("/a", "/b", "/c") in got


def test_bounded_debounce(spark, tmp_path):
    rows = [event(f"/p{i}", f"{i * 0.5:06.3f}") for i in range(30)] + [event("/q", "40.000")]
    write(tmp_path / "in", "1.json", rows)
    out = drain(stream.debounce_bounded(stream.file_events(spark, str(tmp_path / "in")), 750, 5000), tmp_path, "bounded")
    waits = [r for r in out if r.reason == "wait"]
    assert len(waits) >= 2 and all((r.ended - r.started).total_seconds() <= 5 for r in out)
    assert waits[0].paths[:2] == ["/p0", "/p1"]


def test_bounded_debounce_of_one_busy_root(spark, tmp_path):
    """100 000 events of one root in several micro-batches: batches are cut greedily, and
    the time is linear in the events."""
    spent = []
    for n in (25_000, 100_000):
        base = tmp_path / str(n)
        for part in range(4):  # a file a micro-batch, in order
            ids = spark.range(part * n // 4, (part + 1) * n // 4, 1, 1)
            ids.select(F.lit("r").alias("root"), F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("id") * 10).alias("ts"), F.concat(F.lit("/p"), (F.col("id") % 5000).cast("string")).alias("path")).write.mode("append").parquet(str(base / "in"))
            time.sleep(1)
        live = stream.debounce_bounded(spark.readStream.schema("root string, ts timestamp, path string").option("maxFilesPerTrigger", 1).parquet(str(base / "in")), 750, 5000)
        began = time.perf_counter()
        out = drain(live, tmp_path, f"busy{n}")
        spent.append(time.perf_counter() - began)
        # every batch lasts from its first event to the last before the longest wait
        assert all(r.reason == "wait" and (r.ended - r.started).total_seconds() == 4.99 and len(r.paths) == 500 for r in out)
        assert n // 500 - 3 <= len(out) <= n // 500
    assert spent[1] < 8 * spent[0]


def events_of(spark, root, tmp_path, out, fail=False, existing="created", parts=4):
    """Events that one run of the watch gives, by micro-batch."""

    def each(frame, i):
        rows = stream.pair_moves(frame).collect()
        if fail:
            raise RuntimeError("lost")
        out.setdefault(i, []).extend((r.path.removeprefix(str(root)), r.kind, r.moved_to and r.moved_to.removeprefix(str(root))) for r in rows)

    watched = stream.watch(spark, [str(root)], f"file://{tmp_path / 'state'}", parts, existing)
    q = watched.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    except StreamingQueryException:
        assert fail
    return {i: sorted(v, key=str) for i, v in out.items()}


def test_watch(spark, tmp_path):
    root, out = tmp_path / "root", {}
    for p in ("a/x", "a/y", "b/c/z", "b/._no", "@eaDir/no"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(p)
    assert events_of(spark, root, tmp_path, out) == {0: [("/a/x", "created", None), ("/a/y", "created", None), ("/b/c/z", "created", None)]}
    (root / "a/x").write_text("longer than before")
    (root / "a/y").rename(root / "b/y")
    (root / "b/c/z").unlink()
    (root / "new").write_text("n")
    # the batch is lost after it was read; what changes meanwhile is the next batch's
    events_of(spark, root, tmp_path, out, fail=True)
    (root / "a/x").unlink()
    (root / "later").write_text("1")
    got = events_of(spark, root, tmp_path, out)
    assert got[1] == [("/a/x", "modified", None), ("/a/y", "moved", "/b/y"), ("/b/c/z", "deleted", None), ("/new", "created", None)]
    if 2 not in got:
        got = events_of(spark, root, tmp_path, out)
    assert got[2] == [("/a/x", "deleted", None), ("/later", "created", None)]
    assert len({watch.NAME.fullmatch(p.name)[1] for p in (tmp_path / "state").iterdir()}) <= 2
    assert [v for v in events_of(spark, root, tmp_path, out).values()][3:] == [] or events_of(spark, root, tmp_path, out)[3] == []


def test_watch_of_what_cannot_be_listed(spark, tmp_path):
    """An unmounted root keeps its files; existing ones may be passed over."""
    root, out = tmp_path / "root", {}
    (root / "a").mkdir(parents=True)
    (root / "a/x").write_text("1")
    events_of(spark, root, tmp_path, out, existing="ignored")
    root.rename(tmp_path / "away")
    events_of(spark, root, tmp_path, out, existing="ignored")
    (tmp_path / "away").rename(root)
    (root / "a/y").write_text("2")
    assert [x for v in events_of(spark, root, tmp_path, out, existing="ignored").values() for x in v] == [("/a/y", "created", None)]


def test_refresh(spark, tmp_path):
    """Claims follow the files, and a batch given twice leaves the same claims."""
    root, folder = tmp_path / "root", str(tmp_path / "claims")
    root.mkdir()
    for p in ("a", "b", "c"):
        (root / p).write_text(p)
    event_rows = lambda *rows: spark.createDataFrame([(str(root / p), k, str(root / m) if m else None) for p, k, m in rows], "path string, kind string, moved_to string")
    first = event_rows(("a", "created", None), ("b", "created", None), ("c", "created", None), ("never", "created", None))
    opened = lambda: sorted((r.file_path.rpartition("/")[2], r.canonical_hash[:6], r.state, r.batch) for r in stream.open_claims(spark, folder).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:6]
    for _ in range(2):
        stream.refresh_batch(first, 0, folder, "m0")
        assert opened() == [("a", sha("a"), "hashed", 0), ("b", sha("b"), "hashed", 0), ("c", sha("c"), "hashed", 0)]
    (root / "a").write_text("changed")
    (root / "b").rename(root / "d")
    second = event_rows(("a", "modified", None), ("b", "moved", "d"), ("c", "modified", None))
    for _ in range(2):
        stream.refresh_batch(second, 1, folder, "m0")
        assert opened() == [("a", sha("changed"), "hashed", 1), ("c", sha("c"), "reused", 1), ("d", sha("b"), "hashed", 1)]
    assert stream.claim_log(spark, folder).count() == 7
    # another machine's claims of the same paths are its own
    stream.refresh_batch(first, 2, folder, "m1")
    assert {(r.machine_id, r.state) for r in stream.open_claims(spark, folder).collect()} == {("m0", "hashed"), ("m0", "reused"), ("m1", "hashed")}


def test_states_of_claims(spark, tmp_path, monkeypatch):
    """With a state every two batches claims are as they are without."""
    root = tmp_path / "root"
    root.mkdir()
    rows = lambda *names: spark.createDataFrame([(str(root / n), "modified", None) for n in names], "path string, kind string, moved_to string")
    seen = {}
    for every in (2, 1000):
        monkeypatch.setattr(stream, "STATE_EVERY", every)
        folder = str(tmp_path / f"claims{every}")
        for i in range(5):
            (root / f"f{i % 3}").write_text(f"{every and i}")
            if i == 3:
                (root / "f1").unlink()
            for _ in range(2):  # each batch is repeated
                stream.refresh_batch(rows(f"f{i % 3}", "f1"), i, folder, "m")
        seen[every] = sorted((r.file_path, r.canonical_hash, r.batch) for r in stream.open_claims(spark, folder).collect())
    assert seen[2] == seen[1000] and len(seen[2]) == 3 and sorted(p.name for p in (tmp_path / "claims2" / "state").iterdir()) == ["upto=1", "upto=3"]
    assert stream.open_claims(spark, str(tmp_path / "claims2"), 2).count() == 2


def test_current_counts(spark, tmp_path):
    """After any prefix of the stream the counts equal those of the batch."""
    schema = "machine_id string, file_path string, container_path string, tier string, size_bytes long, scan_run_id long, claim_id long, deleted boolean"
    steps = [
        [("m", "/a", None, "L1", 5, 1, 1, False), ("m", "/b", None, "L1", 7, 1, 2, False), ("m", "/a", "/z.zip", "L2", 1, 1, 3, False)],
        [("m", "/a", None, "L2", 6, 2, 4, False), ("m", "/b", None, "L1", 7, 2, 5, True), ("n", "/a", None, "L2", 2, 1, 6, False)],
        [("m", "/b", None, "L1", 9, 1, 7, False), ("m", "/a", None, "L3a", 9, 3, 8, False), ("m", "/a", None, "L1", 8, 3, 9, False)],
        [("m", "/b", None, "boot", 3, 4, 10, False), ("n", "/a", None, "L2", 2, 2, 11, True)],
    ]
    so_far = []
    for rows in steps:
        so_far += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        deltas = stream.current_deltas(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        deltas.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        live = stream.current_counts(spark.read.schema(stream.DELTA).parquet(str(tmp_path / "out")))
        batch = stats.by_tier(stats.supersede_claims(spark.createDataFrame(so_far, schema)).withColumn("permanode_id", F.lit("p")))
        assert {(r.tier, r.claim_count, r.bytes_total) for r in live.collect()} == {(r.tier, r.claim_count, r.bytes_total) for r in batch.collect()}


def test_current_counts_of_many_paths(spark, tmp_path):
    """Paths share the calls for their states: there are no more keys than buckets."""
    c = spark.range(20_000).select(F.lit("m").alias("machine_id"), F.concat(F.lit("/"), F.col("id").cast("string")).alias("file_path"), F.lit(None).cast("string").alias("container_path"), F.lit("L1").alias("tier"), F.lit(2).cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("scan_run_id"), F.col("id").alias("claim_id"))
    later = c.filter("claim_id % 2 = 0").withColumns({"tier": F.lit("L2"), "scan_run_id": F.lit(2).cast("long")})
    for rows in (c, later):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        deltas = stream.current_deltas(spark.readStream.schema(c.schema).parquet(str(tmp_path / "in")))
        q = deltas.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
    got = spark.read.schema(stream.DELTA).parquet(str(tmp_path / "out"))
    # a row a bucket and tier that changed, not a row a path
    assert got.count() <= 3 * stream.BUCKETS
    assert {tuple(r) for r in stream.current_counts(got).collect()} == {("L1", 10_000, 20_000), ("L2", 10_000, 20_000)}


def test_chain_tip(spark, tmp_path):
    rows = spark.createDataFrame([("m0", i, "a", str(i)) for i in range(6)], "machine_id string, id long, action string, payload string")
    fields = ["action", "payload"]
    chained = audit.append_batch(rows.withColumn("row_hash", F.lit("")).filter("false"), rows, fields)
    bad = chained.withColumn("payload", F.when(F.col("id") == 3, "x").otherwise(F.col("payload")))
    bad.coalesce(1).write.parquet(str(tmp_path / "log"))
    live = stream.audit_tip(spark.readStream.schema(bad.schema).parquet(str(tmp_path / "log")), fields)
    assert [r.id for r in drain(live, tmp_path, "tips") if not r.ok] == [3]


def test_chain_tip_in_ranges(spark, tmp_path):
    """Links inside ranges of ids, between them, over gaps and from one run to the next."""
    digest = lambda prev, body: hashlib.sha256((prev + body).encode()).hexdigest()
    schema, want, batches = "machine_id string, id long, payload string, prev_hash string, row_hash string", {}, []
    tips = dict.fromkeys(("m0", "m1", None), "0" * 64)
    for at in (range(-9, 20), range(20, 90)):
        rows = []
        for m in tips:
            for i in [*(i for i in at if i % 7 and not 40 < i < 60), *[None] * (m == "m0")]:
                body = json.dumps({"payload": str(i)}, separators=(",", ":"))
                prev = "f" * 64 if i in (8, 25, 64) and m == "m0" else None if i == 31 and m == "m1" else tips[m]
                row = digest(prev or "", body if i not in (-1, 15, 89) or m == "m1" else "x")
                want[m, at.start if i is None else i, i is None] = prev == tips[m] and prev is not None and row == digest(prev, body)
                rows.append((m, i, str(i), prev, row))
                tips[m] = row
        batches.append(rows[::2] + rows[1::2][::-1])
    assert list(want.values()).count(False) == 3 + 2 * 3 + 1
    got = []
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "log"))
        live = stream.audit_tip(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), ["payload"], ids=8)
        live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    got = spark.read.schema("machine_id string, id long, ok boolean").parquet(str(tmp_path / "out")).collect()
    assert sorted(map(str, ((r.machine_id, r.id, r.ok) for r in got))) == sorted(map(str, ((m, None if none else i, ok) for (m, i, none), ok in want.items())))


def test_chain_tip_holds_no_rows():
    """Rows of a range are passed on before the next range is read."""
    import pandas as pd

    class Tip:
        def getValueState(self, *_):
            return self

        def exists(self):
            return False

        def update(self, value):
            self.value = value

    read, tip, processor = [], Tip(), stream.ChainTip()
    processor.init(tip)

    def frames():
        for k in (1, 0, 2):
            read.append(k)
            yield pd.DataFrame({"machine_id": ["m"], "first": [4 * k], "head": [f"{k}" if k else "0" * 64], "good": [k != 2], "tip": [f"{k + 1}"], "ids": [[4 * k + 1]], "oks": [[True]]})

    out = processor.handleInputRows(("m",), frames(), None)
    assert next(out)["ids"].tolist() == [[5]] and read == [1]
    *_, last = out
    assert last["ids"].tolist() == [[0, 4, 8]] and last["oks"].tolist() == [[True, True, False]] and tip.value == ("3",)


def test_live_stats(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01 00:10:00", "L1", 5), ("2026-01-01 00:20:00", "L1", 6), ("2026-01-01 09:00:00", "L2", 1)], "t string, tier string, size_bytes long").select(F.col("t").cast("timestamp").alias("observed_at"), "tier", "size_bytes")
    rows.coalesce(1).write.parquet(str(tmp_path / "c"))
    live = stream.live_stats(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "c")))
    got = drain(live, tmp_path, "live", "update")
    assert {(r.tier, r.claim_count, r.bytes_total) for r in got} == {("L1", 2, 11), ("L2", 1, 1)}
