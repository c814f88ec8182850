"""File events and log rows as streams."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from estatum.functions import derive
from estatum.scratch import stored
from estatum.sources import files, trees
from estatum.sources import watch as watches

EVENT = "path string, kind string, moved_to string, ts timestamp, root string, is_dir boolean"
KINDS = ("created", "modified", "deleted", "moved")
BATCH = "root string, started long, ended long, paths array<string>, reason string"


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a folder of JSON files; directories, unknown kinds and noise go."""
    raw = spark.readStream.schema(EVENT).json(folder)
    return clean_events(raw)


def clean_events(raw: DataFrame) -> DataFrame:
    known = raw.filter(F.col("kind").isin(*KINDS) & ~F.coalesce("is_dir", F.lit(False)))
    return files.skip_noise_paths(known)


def watch(spark: SparkSession, roots: list[str], state: str, parts: int = 8, existing: str = "created") -> DataFrame:
    """Events of file trees themselves, a listing a micro-batch: see ``sources.watch``."""
    watches.register(spark)
    return spark.readStream.format("estate_events").options(roots=json.dumps(roots), state=state, parts=str(parts), existing=existing).load()


def pair_moves(batch: DataFrame) -> DataFrame:
    """Events of one micro-batch of ``watch`` where a file deleted in one part of a root
    and created in another, alike in inode, size and time, is moved."""
    keys = ["root", "file_id"]
    one = lambda kind, name: batch.filter(F.col("kind") == kind).groupBy(*keys).agg(F.min("path").alias(name))
    pairs = one("deleted", "_from").join(one("created", "_to"), keys)
    joined = batch.join(pairs, keys, "left")
    left = (F.col("kind") == "deleted") & F.coalesce(F.col("path") == F.col("_from"), F.lit(False))
    came = (F.col("kind") == "created") & F.coalesce(F.col("path") == F.col("_to"), F.lit(False))
    rest = joined.filter(~came).withColumn("moved_to", F.when(left, F.col("_to")).otherwise(F.col("moved_to"))).withColumn("kind", F.when(left, "moved").otherwise(F.col("kind")))
    return rest.select(*batch.columns)


def event_paths(events: DataFrame) -> DataFrame:
    """A row a path: the source, then the destination."""
    return events.select("*", F.posexplode(F.array_compact(F.array("path", "moved_to"))).alias("place", "event_path"))


def debounce(events: DataFrame, gap: str = "750 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Batches that end after a quiet gap; late events up to ``delay`` count."""
    marked = events.withWatermark("ts", delay)
    out = marked.groupBy(F.session_window("ts", gap).alias("w"), "root").agg(F.sort_array(F.collect_list(F.struct("ts", "path", "kind", "moved_to"))).alias("events"))
    return out.select("root", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def unique_paths(batches: DataFrame, drop_deleted: bool = True) -> DataFrame:
    """Distinct paths of each batch in first-seen order; batches left empty go."""
    live = F.filter("events", lambda e: e["kind"] != "deleted") if drop_deleted else F.col("events")
    paths = F.flatten(F.transform(live, lambda e: F.array_compact(F.array(e["path"], e["moved_to"]))))
    return batches.withColumn("paths", F.array_distinct(paths)).filter(F.size("paths") > 0)


class BoundedDebounce(StatefulProcessor):
    """Per root: a batch ends after a quiet gap, at the latest after a longest
    wait.  Times are event times; a timer ends what no later event ends.  The open batch
    is its two times and a list of paths, to which a micro-batch adds only its own new
    ones; the list is read once, when the batch ends, and holds what came within the
    longest wait."""

    def __init__(self, gap_ms: int, wait_ms: int):
        self.gap, self.wait = gap_ms, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, ended long")
        self.paths = handle.getListState("paths", "path string")

    def _row(self, key, started: int, ended: int, fresh: dict[str, None], reason: str) -> pd.DataFrame:
        held = dict.fromkeys(p for (p,) in self.paths.get()) if self.paths.exists() else {}
        self.paths.clear()
        self.open.clear()
        return pd.DataFrame({"root": [key[0]], "started": [started], "ended": [ended], "paths": [list(held | fresh)], "reason": [reason]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["ms", "path"], kind="stable")
        started, ended = self.open.get() if self.open.exists() else (None, None)
        fresh: dict[str, None] = {}
        for now, path in zip(got["ms"].tolist(), got["path"], strict=True):
            if started is not None and (now - ended > self.gap or now - started >= self.wait):
                yield self._row(key, started, ended, fresh, "quiet" if now - ended > self.gap else "wait")
                started, fresh = None, {}
            started, ended = (now, now) if started is None else (started, max(ended, now))
            fresh[path] = None
        if started is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.open.update((started, ended))
            self.paths.appendList([(p,) for p in fresh])
            self.handle.registerTimer(min(ended + self.gap, started + self.wait))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            started, ended = self.open.get()
            yield self._row(key, started, ended, {}, "quiet" if expiredTimerInfo.getExpiryTimeInMs() >= ended + self.gap else "wait")

    def close(self) -> None:
        pass


def debounce_bounded(events: DataFrame, gap_ms: int = 750, wait_ms: int = 5000, delay: str = "10 seconds") -> DataFrame:
    """(root, started, ended, paths, reason).  Needs the RocksDB state store provider."""
    rows = events.withWatermark("ts", delay).select("root", "ts", F.unix_millis("ts").alias("ms"), "path")
    out = rows.groupBy("root").transformWithStateInPandas(statefulProcessor=BoundedDebounce(gap_ms, wait_ms), outputStructType=T._parse_datatype_string(BATCH), outputMode="append", timeMode="EventTime")
    return out.select("root", F.timestamp_millis("started").alias("started"), F.timestamp_millis("ended").alias("ended"), "paths", "reason")


CLAIM = "machine_id string, file_path string, container_path string, permanode_id string, canonical_hash string, algo string, size_bytes long, mtime timestamp, tier string, deleted boolean, state string, error string"


def stat_paths(paths: DataFrame) -> DataFrame:
    """(path, size_bytes, mtime, error) of listed paths, as they are now: what isn't a
    regular file is ``missing``."""

    def run(frames):
        for f in frames:
            out = []
            for p in f["path"]:
                try:
                    s = os.lstat(p)
                    out.append((s.st_size, s.st_mtime_ns // 1000, None) if trees.stat.S_ISREG(s.st_mode) else (None, None, "missing"))
                except (FileNotFoundError, NotADirectoryError):
                    out.append((None, None, "missing"))
                except OSError as e:
                    out.append((None, None, str(e)))
            yield pd.DataFrame({"path": f["path"], "size_bytes": pd.array([x for x, _, _ in out], "Int64"), "us": pd.array([x for _, x, _ in out], "Int64"), "error": [x for _, _, x in out]})

    return paths.select("path").mapInPandas(run, "path string, size_bytes long, us long, error string").select("path", "size_bytes", F.timestamp_micros("us").alias("mtime"), "error")


#: Batches after which the open claims are written as a state of their own.
STATE_EVERY = 20


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)  # nothing is written yet


def claim_log(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """All claims of a folder with their ``batch``; those before a batch, if one is given."""
    rows = _read(spark, f"{folder}/log", CLAIM + ", batch long")
    return rows if before is None else rows.filter(F.col("batch") < before)


def newest_claims(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest claim of each path of each machine, closed ones included: from the last
    state before ``before``, and the batches since."""
    states = _read(spark, f"{folder}/state", CLAIM + ", batch long, upto long")
    states = states if before is None else states.filter(F.col("upto") < before)
    last = states.agg(F.max("upto")).first()[0]
    rows = claim_log(spark, folder, before)
    if last is not None:
        rows = states.filter(F.col("upto") == last).drop("upto").unionByName(rows.filter(F.col("batch") > last))
    return rows.groupBy("machine_id", "file_path", "container_path").agg(F.max_by(F.struct(*rows.columns), "batch").alias("c")).select("c.*")


def open_claims(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest claim of each path of each machine, unless that closes it."""
    return newest_claims(spark, folder, before).filter("NOT deleted")


def refresh_batch(frame: DataFrame, batch_id: int, folder: str, machine: str, algo: str = "sha256") -> None:
    """Write the claims of one batch of events: paths are looked at as they are now, those
    of unchanged size and time (to the second) keep their identity, others are hashed,
    and paths that are gone close the claim they had.  A batch's rows are one folder,
    made from the batches before alone, so a repeated batch replaces its own.  Every
    STATE_EVERY batches the newest claims are written as a state, so a batch reads the
    last state and the batches since, not all there ever were."""
    spark = frame.sparkSession
    paths = files.skip_noise_paths(event_paths(frame).select(F.col("event_path").alias("path")).distinct())
    now = stored(stat_paths(paths), "seen")
    known = open_claims(spark, folder, batch_id).filter(F.col("machine_id") == machine).join(now.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    known = known.select("file_path", "permanode_id", "canonical_hash", "algo", F.col("size_bytes").alias("_size"), F.date_trunc("second", "mtime").alias("_mtime"))
    joined = stored(now.join(known, F.col("path") == F.col("file_path"), "left"), "known")
    same = F.coalesce((F.col("_size") == F.col("size_bytes")) & (F.col("_mtime") == F.date_trunc("second", F.col("mtime"))) & (F.col("algo") == algo), F.lit(False))
    gone = F.coalesce(F.col("error") == "missing", F.lit(False))
    kept = joined.filter(same).select("path", "permanode_id", "canonical_hash", "algo", "size_bytes", "mtime", F.lit(False).alias("deleted"), F.lit("reused").alias("state"), F.lit(None).cast("string").alias("error"))
    closed = joined.filter(gone & F.col("file_path").isNotNull()).select("path", "permanode_id", "canonical_hash", "algo", F.col("_size").alias("size_bytes"), F.col("_mtime").alias("mtime"), F.lit(True).alias("deleted"), F.lit("gone").alias("state"), F.lit(None).cast("string").alias("error"))
    hashed = trees.hash_listed(joined.filter(~same & ~gone).select("path", "size_bytes", "mtime", "error"), algo)
    # a file that went between the look and the reading is the next batch's
    added = hashed.filter("error IS NULL").select("path", derive.permanode_id(F.col("hash"), F.col("size_bytes")).alias("permanode_id"), F.col("hash").alias("canonical_hash"), "algo", "size_bytes", "mtime", F.lit(False).alias("deleted"), F.lit("hashed").alias("state"), "error")
    rows = kept.unionByName(closed).unionByName(added)
    out = rows.select(F.lit(machine).alias("machine_id"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("container_path"), "permanode_id", "canonical_hash", "algo", "size_bytes", "mtime", derive.tier(F.col("path")).alias("tier"), "deleted", "state", "error")
    out.write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")
    if batch_id % STATE_EVERY == STATE_EVERY - 1:
        newest_claims(spark, folder, batch_id + 1).write.mode("overwrite").parquet(f"{folder}/state/upto={batch_id}")


def refresh_claims(events: DataFrame, folder: str, machine: str, checkpoint: str, algo: str = "sha256"):
    """Start a query that keeps the claims below ``folder`` current from events: each
    micro-batch is scanned, hashed and written once, see ``refresh_batch``.  Read them with
    ``open_claims``."""
    sink = events.writeStream.foreachBatch(lambda frame, i: refresh_batch(frame, i, folder, machine, algo))
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_stats(claims: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and bytes by tier and window of time as claims arrive."""
    window = F.window("observed_at", size, slide) if slide else F.window("observed_at", size)
    out = claims.withWatermark("observed_at", delay).groupBy(window.alias("w"), "tier").agg(F.count(F.lit(1)).alias("claim_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes_total"))
    return out.select(F.col("w.start").alias("started"), "tier", "claim_count", "bytes_total")


DELTA = "tier string, claims long, bytes long"
NEWEST = "machine_id string, file_path string, container string, run long, claim long, tier string, size long, deleted boolean"
#: Buckets that paths are dealt into by hash, each with one state.
BUCKETS = 256


class CurrentClaim(StatefulProcessor):
    """Keeps the newest claim of each path (machine, path, container) of a bucket; gives
    what changes in the counts of current claims, by tier, when claims come, are superseded
    or closed.  A bucket's state is one list, read and written as a whole: a call a path
    would cost milliseconds each.  A batch of few paths touches their buckets only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getListState("newest", NEWEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {r[:3]: r[3:] for r in map(tuple, self.newest.get())} if self.newest.exists() else {}
        fresh: dict[tuple, tuple] = {}
        for f in rows:
            values = (f[c] for c in ("machine_id", "file_path", "container", "scan_run_id", "claim_id", "tier", "size_bytes", "deleted"))
            for m, p, c, run, claim, tier, size, deleted in zip(*values, strict=True):
                path, new = (m, p, c), (int(run), int(claim), tier, int(size), bool(deleted))
                old = fresh.get(path) or held.get(path)
                if old is None or old[:2] < new[:2]:  # an older one that comes late changes nothing
                    fresh[path] = new
        changes: dict[str, list[int]] = {}
        for path, new in fresh.items():
            for sign, claim in ((-1, held.get(path)), (1, new)):
                if claim is not None and not claim[4]:
                    by = changes.setdefault(claim[2], [0, 0])
                    by[0] += sign
                    by[1] += sign * claim[3]
        if fresh:
            self.newest.put([path + claim for path, claim in {**held, **fresh}.items()])
        yield pd.DataFrame([(tier, *by) for tier, by in changes.items() if any(by)], columns=["tier", "claims", "bytes"])

    def close(self) -> None:
        pass


def current_deltas(claims: DataFrame) -> DataFrame:
    """A stream of DELTA rows from a stream of claims (with ``deleted``): write it as a
    table; ``current_counts`` of any prefix equals ``stats.by_tier`` of the claims so far.
    Needs the RocksDB state store provider."""
    none = F.lit(False)
    rows = claims.select("machine_id", "file_path", F.coalesce("container_path", F.lit("")).alias("container"), "scan_run_id", "claim_id", "tier", F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"), (F.coalesce("deleted", none) if "deleted" in claims.columns else none).alias("deleted"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("machine_id", "file_path", "container"), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=CurrentClaim(), outputStructType=T._parse_datatype_string(DELTA), outputMode="append", timeMode="None")


def current_counts(deltas: DataFrame) -> DataFrame:
    """Counts and bytes of current claims by tier, from their changes."""
    out = deltas.groupBy("tier").agg(F.sum("claims").alias("claim_count"), F.sum("bytes").alias("bytes_total"))
    return out.filter("claim_count > 0")


#: Ids that one call checks the links of; ranges whose verdicts are written at once.
IDS, PASSED = 1 << 16, 8
PART = "machine_id string, first long, head string, good boolean, tip string, ids array<long>, oks array<boolean>"
TIPS = "machine_id string, ids array<long>, oks array<boolean>"


class ChainPart(StatefulProcessor):
    """Checks the links inside a range of ids of a machine's rows of a micro-batch; its
    first link is left to ``ChainTip``, with the range's last hash.  Keeps nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("id", kind="stable")
        ids, heads, tips, good = (got[c].to_numpy() for c in ("id", "prev_hash", "row_hash", "good"))
        oks = good[1:] & (heads[1:] == tips[:-1])
        yield pd.DataFrame({"machine_id": [key[0]], "first": ids[:1], "head": heads[:1], "good": good[:1], "tip": tips[-1:], "ids": [ids[1:].tolist()], "oks": [oks.astype(bool).tolist()]})

    def close(self) -> None:
        pass


class ChainTip(StatefulProcessor):
    """Keeps each machine's tip; says of each link whether it fits.  Links inside ranges are
    passed on as they come, and the first ones, one a range, wait to be put in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tip = handle.getValueState("tip", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        edges = []
        for f in rows:
            firsts = [None if pd.isna(x) else int(x) for x in f["first"]]
            edges += zip(firsts, f["head"], f["good"].tolist(), f["tip"], strict=True)
            for i in range(0, len(f), PASSED):
                yield f[["machine_id", "ids", "oks"]].iloc[i : i + PASSED]
        tip = self.tip.get()[0] if self.tip.exists() else "0" * 64
        edges.sort(key=lambda e: (e[0] is None, e[0] or 0))
        oks = []
        for _, head, good, last in edges:
            oks.append(good and head == tip)
            tip = last
        self.tip.update((tip,))
        yield pd.DataFrame({"machine_id": [key[0]], "ids": [[e[0] for e in edges]], "oks": [oks]})

    def close(self) -> None:
        pass


def audit_tip(audit: DataFrame, columns: list[str], ids: int = IDS) -> DataFrame:
    """(machine_id, id, ok) of log rows as they arrive.  A micro-batch is cut into ranges of
    ``ids`` ids of a machine, each one call's, and a machine's tip meets the ranges' first
    and last hashes: no task holds a machine's rows, however many come at once.  Where ids
    are sparse, wider ranges hold as many rows with fewer calls.  Needs the RocksDB state
    store provider."""
    chain = lambda rows, by, processor, schema: rows.groupBy(*by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=T._parse_datatype_string(schema), outputMode="append", timeMode="None")
    hashed = F.sha2(F.concat("prev_hash", derive.canonical_audit_json(columns)), 256)
    rows = audit.select("machine_id", "id", "prev_hash", "row_hash", F.coalesce(F.col("row_hash") == hashed, F.lit(False)).alias("good"), F.expr(f"id div {ids}").alias("part"))
    parts = chain(rows, ["machine_id", "part"], ChainPart(), PART)
    return chain(parts, ["machine_id"], ChainTip(), TIPS).select("machine_id", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("oks").alias("ok"))))
