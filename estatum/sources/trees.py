"""File trees as Spark jobs: walking, hashing and opening archives.

Paths are read where tasks run: plain and file: paths as mounted files, others through
the file system that pyarrow knows for their scheme.  Nothing is held whole: files and
members pass in chunks, and what can't be read is a row with an error."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
import os
import stat
import struct
import tarfile
import zipfile
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from estatum.functions import derive
from estatum.scratch import scratch

# Directories and names that a scan leaves out.
SKIP_DIRS = (".fseventsd", ".Spotlight-V100", ".Trashes", ".TemporaryItems", ".DocumentRevisions-V100", ".PKInstallSandboxManager", "@eaDir", "@SynoResource")
SKIP_NAMES = (".DS_Store", ".apdisk", ".localized")
#: Bytes read at once; entries that a task lists before it leaves directories to others.
CHUNK, LISTED = 8 << 20, 5000
#: Bytes and files that a hashing task is meant for; compressed bytes of a lot of members.
TASK_BYTES, TASK_FILES, LOT = 256 << 20, 10_000, 64 << 20
ALGORITHMS = ("sha256", "xxh3_128")
ENTRY = "path string, kind string, size_bytes long, mtime_us long, error string"
HASHED = "path string, size_bytes long, mtime timestamp, hash string, algo string, error string"
MEMBERS = "container_path string, container_sha256 string, member string, hash string, size_bytes long, error string"
PLACE = "name string, offset long, packed long, size long, method int, crc long, secret boolean"


def names(ddl: str) -> list[str]:
    return [x.split(" ")[0] for x in ddl.split(", ")]


def skipped(name: str) -> bool:
    return name.startswith("._") or name in SKIP_NAMES


def plain(path: str) -> str:
    """A file: path without its scheme."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def opened(path: str):
    """A seekable file, closed by its ``with``."""
    if "://" not in path:
        return open(path, "rb")  # noqa: SIM115
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def created(path: str):
    """A new file to write to."""
    if "://" not in (path := plain(path)):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")  # noqa: SIM115
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner)


def list_directory(path: str) -> Iterator[tuple[str, str, int | None, int | None, str | None]]:
    """(name, kind, size, mtime in microseconds, error) of the entries of one directory.
    Links are ``other``, as are devices and pipes."""
    if "://" not in path:
        with os.scandir(path) as entries:
            for e in entries:
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError as why:
                    yield e.name, "file", None, None, str(why)
                    continue
                kind = "file" if stat.S_ISREG(s.st_mode) else "dir" if stat.S_ISDIR(s.st_mode) else "other"
                yield e.name, kind, s.st_size, s.st_mtime_ns // 1000, None
        return
    store, inner = fs.FileSystem.from_uri(path)
    for i in store.get_file_info(fs.FileSelector(inner)):
        kind = {fs.FileType.File: "file", fs.FileType.Directory: "dir"}.get(i.type, "other")
        yield i.base_name, kind, i.size, (i.mtime_ns or 0) // 1000, None


def walk(spark: SparkSession, root: str, lister: Callable = list_directory, listed: int = LISTED, skip: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """ENTRY rows of a tree: files, and the directories that were listed.

    A round is a job over the directories still to be listed, each listed by one task.  A
    task goes on below what it lists until it has seen ``listed`` entries; directories
    beyond are the next round's, dealt anew.  Those on the skip list are dropped by name,
    never listed; links are not followed.  A directory that can't be listed is a row with
    an error."""

    def expand(frames):
        seen = 0
        for f in frames:
            todo = deque(f["path"])
            while todo:
                folder, out, error = todo.popleft(), [], None
                if seen >= listed:
                    yield pd.DataFrame([(p, "todo", None, None, None) for p in (folder, *todo)], columns=names(ENTRY))
                    break
                try:
                    for name, kind, size, at, why in lister(folder):
                        seen += 1
                        path = f"{folder.rstrip('/')}/{name}"
                        if kind == "dir" and name not in skip:
                            todo.append(path)
                        elif kind == "file" and not skipped(name):
                            out.append((path, kind, size, at, why))
                        if len(out) >= 10_000:
                            yield pd.DataFrame(out, columns=names(ENTRY))
                            out = []
                except Exception as why:  # noqa: BLE001  a store's error may be any
                    error = str(why)
                yield pd.DataFrame([*out, (folder, "dir", None, None, error)], columns=names(ENTRY))

    base, turn, cores = scratch(spark, "walk"), 0, spark.sparkContext.defaultParallelism
    todo, n = spark.createDataFrame([(plain(root),)], "path string"), 1
    while n:
        dealt = todo.repartition(min(n, 4 * cores), "path")
        dealt.mapInPandas(expand, ENTRY).write.parquet(f"{base}/round={turn}")
        todo = spark.read.schema(ENTRY).parquet(f"{base}/round={turn}").filter("kind = 'todo'").select("path")
        n, turn = todo.count(), turn + 1
    return spark.read.schema(ENTRY).parquet(base).filter("kind <> 'todo'")


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size_bytes, mtime, error) of every regular file below ``root`` but noise;
    directories that can't be listed are rows without size and time."""
    rows = walk(spark, root).filter("kind = 'file' OR error IS NOT NULL")
    return rows.select("path", "size_bytes", F.timestamp_micros("mtime_us").alias("mtime"), "error")


def hasher(algo: str):
    if algo == "sha256":
        return hashlib.sha256()
    import xxhash

    return xxhash.xxh3_128()


def chunks(handle) -> Iterator[bytes]:
    while buf := handle.read(CHUNK):
        yield buf


def digest_of(parts, algo: str) -> tuple[str, int]:
    """(hash, bytes) of chunks."""
    h, n = hasher(algo), 0
    for p in parts:
        h.update(p)
        n += len(p)
    return h.hexdigest(), n


def hash_listed(files: DataFrame, algo: str = "sha256") -> DataFrame:
    """HASHED rows of listed files (path, size_bytes, mtime, and an error that stands for
    itself).  The size is what was read.  Files are dealt so that a task has about
    TASK_BYTES or TASK_FILES; a file of any size passes in chunks."""
    if algo not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algo!r}")

    def run(frames):
        for f in frames:
            out = []
            for path, why in zip(f["path"], f["error"], strict=True):
                value = size = None
                if why is None:
                    try:
                        with opened(plain(path)) as handle:
                            value, size = digest_of(chunks(handle), algo)
                    except Exception as e:  # noqa: BLE001  one bad file doesn't end the scan
                        why = str(e) or type(e).__name__
                out.append((value, size, why))
            yield pd.DataFrame({"path": f["path"], "size_bytes": pd.array([s for _, s, _ in out], "Int64"), "mtime_us": f["mtime_us"].astype("Int64"), "hash": [h for h, _, _ in out], "error": [e for _, _, e in out]})

    known = files.select("path", F.unix_micros("mtime").alias("mtime_us"), F.col("error") if "error" in files.columns else F.lit(None).cast("string").alias("error"))
    total = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n = 1 + max(total.b // TASK_BYTES, total.n // TASK_FILES)
    done = known.repartition(max(n, min(total.n, known.sparkSession.sparkContext.defaultParallelism), 1), "path").mapInPandas(run, "path string, size_bytes long, mtime_us long, hash string, error string")
    return done.select("path", "size_bytes", F.timestamp_micros("mtime_us").alias("mtime"), "hash", F.lit(algo).alias("algo"), "error")


def hash_files(spark: SparkSession, root: str, algo: str = "sha256") -> DataFrame:
    """Content hashes of a tree: HASHED."""
    return hash_listed(scan_tree(spark, root), algo)


# archives -------------------------------------------------------------------


def is_noise(member: str) -> bool:
    *parents, name = member.split("/")
    return skipped(name) or any(p == "__MACOSX" or p in SKIP_DIRS for p in parents)


def zip_places(handle) -> Iterator[tuple]:
    """PLACE of each regular member, from the central directory alone."""
    with zipfile.ZipFile(handle) as z:
        for i in z.infolist():
            if not i.is_dir() and not is_noise(i.filename):
                yield i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, bool(i.flag_bits & 1)


def member_data(handle, place) -> Iterator[bytes]:
    """Stored or deflated bytes of ``place`` from where the handle stands, as they were."""
    left, inflate = place.packed, zlib.decompressobj(-15)
    while left:
        if not (buf := handle.read(min(CHUNK, left))):
            raise ValueError("the archive ends early")
        left -= len(buf)
        if place.method == zipfile.ZIP_STORED:
            yield buf
            continue
        while True:
            part = inflate.decompress(buf, CHUNK)
            yield part
            buf = inflate.unconsumed_tail
            if not buf and len(part) < CHUNK:
                break


def zip_member(handle, place) -> Iterator[bytes]:
    """A member by range: its own header, then its data, chunk by chunk."""
    if place.secret:
        raise ValueError("encrypted")
    if place.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        with zipfile.ZipFile(handle) as z, z.open(next(i for i in z.infolist() if i.header_offset == place.offset)) as member:
            yield from chunks(member)
        return
    handle.seek(place.offset)
    head = handle.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member where the directory says")
    handle.seek(place.offset + 30 + sum(struct.unpack("<HH", head[26:30])))
    crc = size = 0
    for part in member_data(handle, place):
        crc, size = zlib.crc32(part, crc), size + len(part)
        yield part
    if (crc, size) != (place.crc, place.size):
        raise ValueError("checksum or size differs")


def zip_rows(path: str, own: str | None, places, algo: str) -> Iterator[tuple]:
    with opened(path) as handle:
        for p in places:
            try:
                yield path, own, p.name, *digest_of(zip_member(handle, p), algo), None
            except Exception as e:  # noqa: BLE001  one bad member doesn't end the rest
                yield path, own, p.name, None, None, str(e) or type(e).__name__


def unpacked(handle):
    """The handle, or what it holds compressed; an early end is an error then."""
    first = handle.read(6)
    handle.seek(0)
    for magic, kind in ((b"\x1f\x8b", gzip.GzipFile), (b"BZh", bz2.BZ2File), (b"\xfd7zXZ\0", lzma.LZMAFile)):
        if first.startswith(magic):
            return kind(handle) if kind is not gzip.GzipFile else kind(fileobj=handle)
    return handle


def tar_rows(path: str, own: str | None, algo: str) -> Iterator[tuple]:
    """Members of a tar of any compression, as its bytes pass once."""
    with opened(path) as handle, tarfile.open(fileobj=unpacked(handle), mode="r|") as t:
        for m in t:
            if m.isfile() and not is_noise(m.name):
                try:
                    yield path, own, m.name, *digest_of(chunks(t.extractfile(m)), algo), None
                except (tarfile.TarError, OSError, EOFError, zlib.error) as e:
                    yield path, own, m.name, None, None, str(e) or type(e).__name__
                    return  # what follows can't be found
            t.members = []


def places_of(path: str) -> Iterator[list]:
    """Lots of members of a zip, of about LOT compressed bytes each."""
    lot, held = [], 0
    with opened(path) as handle:
        for p in zip_places(handle):
            lot.append(p)
            held += p[2]
            if held >= LOT:
                yield lot
                lot, held = [], 0
    if lot:
        yield lot


class Place:
    """A member's PLACE."""

    __slots__ = names(PLACE)

    def __init__(self, values):
        for k, v in zip(self.__slots__, values, strict=True):
            setattr(self, k, v)


def own_digest(path: str) -> str:
    with opened(path) as handle:
        return digest_of(chunks(handle), "sha256")[0]


def explode_archives(files: DataFrame, algo: str = "sha256") -> DataFrame:
    """MEMBERS and tier of the archives among listed files (path).  A zip's members are
    dealt by lots of its central directory and read by range, a tar passes as a stream in
    one task; noise is left out, and an archive or member that can't be read is a row with
    an error."""
    if algo not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algo!r}")
    shape = f"path string, own string, lot int, places array<struct<{PLACE.replace(', ', ',').replace(' ', ':')}>>, error string"

    def plan(frames):
        for f in frames:
            for path in map(plain, f["path"]):
                try:
                    own = own_digest(path)
                    lots = places_of(path) if path.lower().endswith(".zip") else [None]
                    for i, lot in enumerate(lots):
                        rows = None if lot is None else [dict(zip(names(PLACE), p, strict=True)) for p in lot]
                        yield pd.DataFrame({"path": [path], "own": [own], "lot": [i], "places": [rows], "error": [None]})
                except Exception as e:  # noqa: BLE001
                    yield pd.DataFrame({"path": [path], "own": [None], "lot": [0], "places": [None], "error": [str(e) or type(e).__name__]})

    def read(frames):
        for f in frames:
            for r in f.itertuples():
                if r.error is not None:
                    rows = [(r.path, None, None, None, None, r.error)]
                elif r.places is None:
                    rows = whole_tar(r.path, r.own, algo)
                else:
                    rows = zip_rows(r.path, r.own, [Place(p.values()) if isinstance(p, dict) else Place(p) for p in r.places], algo)
                for part in parts(rows):
                    yield pd.DataFrame(part, columns=names(MEMBERS)).astype({"size_bytes": "Int64"})

    cores = files.sparkSession.sparkContext.defaultParallelism
    archives = files.filter(derive.is_archive(F.col("path"))).select("path")
    lots = archives.repartition(4 * cores, "path").mapInPandas(plan, shape).repartition(4 * cores, "path", "lot")
    return lots.mapInPandas(read, MEMBERS).withColumn("tier", derive.tier(F.col("container_path")))


def parts(rows, most: int = 1000) -> Iterator[list]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held


def whole_tar(path: str, own: str, algo: str) -> Iterator[tuple]:
    try:
        yield from tar_rows(path, own, algo)
    except Exception as e:  # noqa: BLE001  no archive, or its end is missing
        yield path, own, None, None, None, str(e) or type(e).__name__


@udtf(returnType=MEMBERS)
class ArchiveMembers:
    """MEMBERS of one archive, for SQL: ``LATERAL archive_members(path)``."""

    def eval(self, path: str):
        if path is None:
            return
        path = plain(path)
        try:
            own = own_digest(path)
            if not path.lower().endswith(".zip"):
                yield from whole_tar(path, own, "sha256")
                return
            for lot in places_of(path):
                yield from zip_rows(path, own, map(Place, lot), "sha256")
        except Exception as e:  # noqa: BLE001
            yield path, None, None, None, None, str(e) or type(e).__name__


def register(spark: SparkSession) -> None:
    """Make ``archive_members`` known to SQL."""
    spark.udtf.register("archive_members", ArchiveMembers)
