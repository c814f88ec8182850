"""A streaming source of file events: the differences of successive listings.

    spark.readStream.format("estate_events").option("roots", '["/data"]').option("state", folder).load()

A micro-batch is one listing.  Roots are dealt by the names just below them into parts,
each listed by a task, in order of path, into a file of the state folder; its events
are what a merge with the part's file of the batch before gives.  A listing that is there
is read, not made again, so a batch that is repeated after a failure has the same
events, however the tree has changed meanwhile; files of committed batches go.

A directory that can't be listed (an unmounted volume) keeps the entries it had, so
its files aren't reported as deleted.  Moves are seen within a part, by equal inode, size
and time; ``stream.pair_moves`` finds those between parts of one batch."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from estatum.sources.trees import SKIP_DIRS, plain, skipped

EVENT = "path string, kind string, moved_to string, ts timestamp, root string, is_dir boolean, file_id string"
LISTING = pa.schema([("root", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime_us", pa.int64()), ("inode", pa.int64())])
#: Parts that roots are dealt into, and rows of a block of a listing.
PARTS, ROWS = 8, 10_000
NAME = re.compile(r"turn=(\d{12})-part=(\d+)\.arrow")


class State:
    """Listings in a folder, by batch and part."""

    def __init__(self, folder: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), plain(folder))

    def path(self, turn: int, part: int) -> str:
        return f"{self.folder}/turn={turn:012d}-part={part}.arrow"

    def there(self, path: str) -> bool:
        return self.store.get_file_info(path).type == fs.FileType.File

    def turns(self) -> list[tuple[int, str]]:
        found = self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return [(int(m[1]), f.path) for f in found if (m := NAME.fullmatch(f.base_name))]

    def rows(self, turn: int, part: int) -> Iterator[tuple]:
        path = self.path(turn, part)
        if not self.there(path):
            return
        with self.store.open_input_file(path) as f, ipc.open_stream(f) as blocks:
            for b in blocks:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def listed_at(self, turn: int, part: int) -> datetime:
        with self.store.open_input_file(self.path(turn, part)) as f, ipc.open_stream(f) as blocks:
            return datetime.fromtimestamp(int(blocks.schema.metadata[b"listed_us"]) / 1e6, UTC)

    def write(self, turn: int, part: int, rows: Iterator[tuple]) -> None:
        """Write a listing; of several writers the first one counts."""
        self.store.create_dir(self.folder, recursive=True)
        new = f"{self.folder}/new-{uuid.uuid4().hex}"
        schema = LISTING.with_metadata({"listed_us": str(time.time_ns() // 1000)})
        with self.store.open_output_stream(new) as f, ipc.new_stream(f, schema) as out:
            held = []
            for r in rows:
                held.append(r)
                if len(held) == ROWS:
                    out.write_batch(pa.record_batch(list(zip(*held, strict=True)), schema=schema))
                    held = []
            if held:
                out.write_batch(pa.record_batch(list(zip(*held, strict=True)), schema=schema))
        final = self.path(turn, part)
        try:
            if isinstance(self.store, fs.LocalFileSystem):
                os.link(new, final)  # fails where there is one
                os.unlink(new)
            else:
                self.store.move(new, final)
        except OSError:
            if not self.there(final):
                raise
            self.store.delete_file(new)

    def forget(self, before: int) -> None:
        for turn, path in self.turns():
            if turn < before:
                self.store.delete_file(path)


def order(path: str) -> list[str]:
    """Paths are listed in the order of their parts."""
    return path.split("/")


def below(root: str, part: int, parts: int, known) -> Iterator[tuple]:
    """Listing rows of one part of a root, in order.  ``known(folder)`` gives the rows that
    a folder had, for one that can't be listed."""

    def entries(folder: str, top: bool) -> Iterator[tuple]:
        try:
            with os.scandir(folder) as found:
                named = sorted(found, key=lambda e: e.name)
        except OSError:
            yield from known(folder)
            return
        for e in named:
            if top and zlib.crc32(e.name.encode("utf-8", "surrogateescape")) % parts != part:
                continue
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in SKIP_DIRS:
                        yield from entries(e.path, False)
                elif e.is_file(follow_symlinks=False) and not skipped(e.name):
                    s = e.stat(follow_symlinks=False)
                    yield root, e.path, s.st_size, s.st_mtime_ns // 1000, s.st_ino
            except FileNotFoundError:
                continue  # gone since
            except OSError:
                yield from known(e.path)

    yield from entries(root, True)


def merged(old: Iterator[tuple], new: Iterator[tuple]) -> Iterator[tuple]:
    """(old row or None, new row or None) by root and path; both are in order."""
    key = lambda r: (r[0], order(r[1]))
    a, b = next(old, None), next(new, None)
    while a is not None or b is not None:
        x, y = a and key(a), b and key(b)
        if b is None or (a is not None and x < y):
            yield a, None
            a = next(old, None)
        elif a is None or y < x:
            yield None, b
            b = next(new, None)
        else:
            yield a, b
            a, b = next(old, None), next(new, None)


def identity(row: tuple) -> str:
    return f"{row[4]}:{row[2]}:{row[3]}"


def events(old, new, at: datetime) -> Iterator[tuple]:
    """EVENT rows between two listings, given as functions that open them.  What is held
    is what was deleted."""
    gone = {(a[0], identity(a)): a for a, b in merged(old(), new()) if b is None}
    moved = set()
    for a, b in merged(old(), new()):
        if a is None:
            from_ = gone.get((b[0], identity(b)))
            if from_ is not None and from_[1] not in moved:
                moved.add(from_[1])
                yield from_[1], "moved", b[1], at, b[0], False, identity(b)
            else:
                yield b[1], "created", None, at, b[0], False, identity(b)
        elif b is not None and a[2:4] != b[2:4]:
            yield b[1], "modified", None, at, b[0], False, identity(b)
    for a, b in merged(old(), new()):
        if b is None and a[1] not in moved:
            yield a[1], "deleted", None, at, a[0], False, identity(a)


class Part(InputPartition):
    def __init__(self, part: int, start: int, end: int):
        self.part, self.start, self.end = part, start, end


class EstateEventsReader(DataSourceStreamReader):
    def __init__(self, options):
        given = options.get("roots") or options.get("path")
        if not given or not options.get("state"):
            raise ValueError("roots and state are needed")
        self.roots = sorted({plain(r).rstrip("/") or "/" for r in (json.loads(given) if given.startswith("[") else [given])})
        self.state, self.parts = options["state"], int(options.get("parts", PARTS))
        self.silent = options.get("existing", "created") == "ignored"

    def initialOffset(self) -> dict:
        return {"turn": 0}

    def latestOffset(self) -> dict:
        """The batch after the last that was listed, wholly or in part."""
        return {"turn": 1 + max((t for t, _ in State(self.state).turns()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(p, start["turn"], end["turn"]) for p in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        state, part, start, end = State(self.state), partition.part, partition.start, partition.end

        def known(folder: str):
            return (r for r in state.rows(start, part) if r[1].startswith(f"{folder.rstrip('/')}/"))

        if not state.there(state.path(end, part)):
            state.write(end, part, (r for root in self.roots for r in below(root, part, self.parts, known)))
        if start == 0 and self.silent:
            return
        yield from events(lambda: state.rows(start, part), lambda: state.rows(end, part), state.listed_at(end, part))

    def commit(self, end: dict) -> None:
        State(self.state).forget(end["turn"])


class EstateEvents(DataSource):
    """Options: ``roots`` (a path, or a JSON list), ``state`` (a folder that driver and
    executors share), ``parts``, and ``existing``: "created" or "ignored" files at the
    start."""

    @classmethod
    def name(cls) -> str:
        return "estate_events"

    def schema(self) -> str:
        return EVENT

    def streamReader(self, schema) -> EstateEventsReader:
        return EstateEventsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EstateEvents)
