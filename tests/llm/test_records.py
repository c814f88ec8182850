"""Media, archives and neighbours: round trips and brute force."""

import base64
import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from estatum.llm import media, neighbours, warc


def test_netpbm_and_bmp_round_trips():
    rng = np.random.default_rng(0)
    grey = rng.integers(0, 256, (7, 5)).astype(np.uint8)
    assert (media.decode(b"P5\n# note\n5 7\n255\n" + grey.tobytes()) == grey).all()
    assert (media.decode(b"P2 5 7 255 " + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    rgb = rng.integers(0, 256, (3, 4, 3)).astype(np.uint8)
    assert (media.decode(b"P6 4 3 255\n" + rgb.tobytes()) == rgb).all()
    wide = rng.integers(0, 65536, (2, 3)).astype(">u2")
    assert (media.decode(b"P5 3 2 65535\n" + wide.tobytes()) == wide).all()
    bits = rng.integers(0, 2, (3, 10)).astype(np.uint8)
    assert (media.decode(b"P4 10 3\n" + np.packbits(bits, axis=1).tobytes()) == bits).all()
    assert (media.decode(b"P1 10 3\n" + "".join(map(str, bits.ravel())).encode()) == bits).all()
    assert (media.decode(media.encode_bmp(grey)) == grey).all()
    body = b"".join(r[:, ::-1].tobytes() for r in rgb[::-1])
    bmp = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 4, 3, 1, 24, 0, len(body), 0, 0, 0, 0) + body
    assert (media.decode(bmp) == rgb).all()
    for bad in (b"", b"P5", b"P9 1 1 1 ", b"GIF89a", b"BM", b"P5 4 4 255\nxx"):
        assert media.features(bad, 4)[0] is False


def test_media_of_awkward_tables(spark):
    """Empty, with null and broken media, repeated rows, and columns of the result's names."""
    schema = "media binary, ok int, dhash string"
    assert media.media_tiles(spark.createDataFrame([], schema).select("media"), []).count() == 0
    good = b"P5\n2 2\n255\n\x00\x01\x02\x03"
    rows = [(good, 1, "a"), (good, 1, "a"), (None, 2, "b"), (b"P5", 3, "c")]
    out = media.media_tiles(spark.createDataFrame(rows, schema).withColumnRenamed("ok", "own").drop("dhash"), ["own"]).collect()
    assert sorted((r.own, r.ok, r.dhash is not None) for r in out) == [(1, True, True), (1, True, True), (2, False, False), (3, False, False)]


def test_archives_of_awkward_pages(spark):
    """Extra columns whose names are used inside, null ids, repeated rows, an empty table."""
    schema = "page_id long, url string, html string, name string, _h string, refers_to string"
    rows = [(1, "u", "same", "n", "h", "r"), (1, "u", "same", "n", "h", "r"), (2, None, "same", "n", "h", "r"), (3, "u", None, None, None, None), (None, "u", "same", "n", "h", "r")]
    pages = lambda r: spark.createDataFrame(r, schema).select("page_id", "url", "html", "name")
    files = warc.pack_archives(warc.link_revisits(pages(rows)))
    got = sorted((str(r.record_id), r.record_type, str(r.refers_to)) for r in warc.read_archives(files).collect())
    assert [x[1] for x in got if x[0] == "2"] == ["revisit"] and [x[2] for x in got if x[0] == "2"] == ["1"]
    assert len(got) == 5 and sum(x[1] == "response" for x in got) == 4
    assert warc.read_archives(warc.pack_archives(warc.link_revisits(pages([])))).count() == 0


def test_area_resize():
    a = np.arange(24, dtype=np.float64).reshape(4, 6)
    assert np.allclose(media.area_resize(a, 2, 3), a.reshape(2, 2, 3, 2).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(a, 8, 12), np.kron(a, np.ones((2, 2))))
    assert np.isclose(media.area_resize(a, 3, 5).mean(), a.mean())
    brute = np.kron(a, np.ones((3, 5))).reshape(3, 4, 5, 6).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(a, 3, 5), brute)


def test_texts_as_media(spark):
    texts = [None, "", "x", "é" * 100, "y" * 64, "z" * 100_000, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("tile", F.lit(1))
    m, n = media.pgm_of(F.col("text"))
    got = {r.doc_id: r for r in media.media_tiles(df.select("doc_id", n.alias("n"), m.alias("media")), ["doc_id", "n"]).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n, r.n_samples, r.samples_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert np.load(io.BytesIO(bytes(r.tile_npy))).shape == (16, 16)
    assert got[2].dhash == got[6].dhash and got[2].tile_npy == got[6].tile_npy


def pages(spark):
    rng = random.Random(0)
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abc <>", k=rng.randint(1, 3000)))) for i in range(60)]
    rows += [(100 + i, "u\r\nX: y", "same é 😀") for i in range(20)] + [(200, None, None), (201, "u", ""), (202, "u", "big" * 300_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    got = {int(r.record_id): r for r in warc.read_archives(warc.pack_archives(warc.link_revisits(df), archive_bytes=20_000)).collect()}
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    for i, _, h in rows:
        raw, r = (h or "").encode(), got[i]
        assert r.error is None and r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        if first[h or ""] == i:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("revisit", str(first[h or ""]), b"")
    assert len(got) == len(rows)
    linked = {r.page_id: r.refers_to for r in warc.link_revisits(df, 100).collect()}
    assert all(linked[i] is None for i, _, h in rows if len((h or "").encode()) < 100)


def test_pages_of_one_id(spark):
    """Ids that stand for several payloads lose none; null ids and empty tables pass."""
    df = spark.createDataFrame([(1, "u", "A"), (2, "u", "A"), (2, "v", "B"), (2, "w", "B"), (None, "x", "A"), (3, None, "B")], "page_id long, url string, html string")
    got = sorted((r.record_id or "", r.record_type, r.refers_to or "", bytes(r.payload)) for r in warc.read_archives(warc.pack_archives(warc.link_revisits(df))).collect())
    assert [g[1:] for g in got if g[0] == "2"] == [("response", "", b"B"), ("response", "", b"B"), ("revisit", "1", b"")]
    assert ("3", "revisit", "2", b"") in got and ("1", "response", "", b"A") in got and len(got) == 6
    assert warc.read_archives(warc.pack_archives(warc.link_revisits(df.filter("false")))).count() == 0


def test_query_of_pages_and_its_twin(spark, folder):
    import duckdb

    from estatum.llm import queries

    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet')")
    out = queries.queries()["op5_warc"](spark, folder)
    twin = con.execute(queries.oracle_sql()["op5_warc"])
    names = [c[0] for c in twin.description]
    assert sorted(map(tuple, out.select(*names).collect()), key=repr) == sorted(twin.fetchall(), key=repr)


def test_archive_is_plain_zstandard():
    records = [warc.record(i, "u", b"payload %d" % i * 50, None) for i in range(40)]
    data = warc.archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    with d.stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True) as f:
        assert f.read() == b"".join(records)
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    squeezed = struct.pack("<II", magic, len(packed)) + packed + data[8 + size :]
    assert list(warc.frames(squeezed)) == records


@pytest.mark.parametrize("change", [(b"Content-Length: ", b"Content-Length: 9"), (b"WARC/1.1", b"HTTP/1.1"), (b"sha1:", b"sha1:A"), (b"WARC-Date", b"X-Date")])
def test_bad_records(spark, change):
    good = warc.record(1, "u", b"abc", None)
    bad = good.replace(*change, 1)
    df = spark.createDataFrame([("a", bytearray(warc.archive([good, bad, good]))), ("b", bytearray(warc.archive([good])[:-9])), ("c", bytearray())], "name string, content binary")
    out = warc.read_archives(df).collect()
    assert [bool(r.error) for r in out if r.archive == "a"] == [False, True, False]
    assert [bool(r.error) for r in out if r.archive == "b"] == [True] and not [r for r in out if r.archive == "c"]


def exact(x, ids, q, k):
    out = {}
    for i in q:
        d = np.sqrt(((x - x[ids == i][0]) ** 2).sum(1))
        at = np.flatnonzero(ids != i)
        out[i] = [(int(ids[j]), d[j]) for j in at[np.lexsort((ids[at], d[at]))][:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(0, 0.3, (3000, 16))).astype(np.float32)
    x[500:1500] = x[500]  # a third are one vector
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, [1.0] * 3, 0), (9004, [None] * 16, 0), (None, [1.0] * 16, 0), (9005, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, part int").repartition(6)
    out = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    want = exact(x.astype(np.float64), np.arange(3000), range(0, 3000, 100), 10)
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)
    for q, v in got.items():
        assert v == sorted(v, key=lambda p: (p[1], p[0]))
        assert all(abs(s - np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum())) < 1e-12 for i, s in v)
    assert got[600] == [(i, 0.0) for i in range(500, 510)]


def test_clusters_are_pruned(spark, monkeypatch):
    """On clustered vectors a tenth of the rows is visited, and found is what is near."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (60, 24))
    x = (centres[rng.integers(0, 60, 12000)] + rng.normal(0, 0.25, (12000, 24))).astype(np.float32)
    monkeypatch.setattr(neighbours, "PER_PART", 256)
    pairs, old = [0], neighbours.meet

    def counted(ask, filed, have, k):
        pairs[0] += sum(r["count"] * r.n for r in ask.groupBy("part").count().join(have, "part").collect())
        return old(ask, filed, have, k)

    monkeypatch.setattr(neighbours, "meet", counted)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    out = neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    want = exact(x.astype(np.float64), np.arange(12000), range(0, 12000, 50), 10)
    hit = sum(r.vec_id in {a for a, _ in want[r.query_id]} for r in out)
    assert len(out) == 2400 and hit >= 0.9 * 2400 and pairs[0] <= 0.1 * 240 * 12000


def test_parts_of_parts(spark, monkeypatch):
    """Two levels of networks: more leaves than one network has parts, and as little visited."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (100, 16))
    x = (centres[rng.integers(0, 100, 6000)] + rng.normal(0, 0.15, (6000, 16))).astype(np.float32)
    for name, value in {"PER_PART": 128, "WIDE": 8, "SAMPLE": 1500}.items():
        monkeypatch.setattr(neighbours, name, value)
    seen, old = [], neighbours.meet

    def counted(ask, filed, have, k):
        seen.append((have.count(), sum(r["count"] * r.n for r in ask.groupBy("part").count().join(have, "part").collect())))
        return old(ask, filed, have, k)

    monkeypatch.setattr(neighbours, "meet", counted)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    out = neighbours.nearest(df, F.col("vec_id") % 50 == 0, sample=1500).collect()
    want = exact(x.astype(np.float64), np.arange(6000), range(0, 6000, 50), 10)
    hit = sum(r.vec_id in {a for a, _ in want[r.query_id]} for r in out)
    assert len(out) == 1200 and hit >= 0.9 * 1200 and seen[0][0] > 8 and seen[0][1] <= 0.3 * 120 * 6000


def test_repeated_ids(spark):
    """Rows of one id are candidates each, but never the query's own."""
    rows = [(i % 40, [float(i), 1.0]) for i in range(400)]
    out = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 0, k=3).collect()
    assert out and all(r.vec_id != r.query_id for r in out)


def test_queries_short_of_neighbours(spark, monkeypatch):
    """Parts of few rows: queries go on to others until all have ten."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 4)) * 5)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "PER_PART", 32)
    got = neighbours.nearest(df, F.lit(True), k=60, recall=0.01).groupBy("query_id").count().collect()
    assert len(got) == 300 and {r["count"] for r in got} == {60}


def test_few_vectors(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(0, 400, 100)], "vec_id long, embedding array<float>")
    out = neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect()
    assert len(out) == 4 * 3
    assert neighbours.nearest(df.filter("false"), F.lit(True)).count() == 0


def test_balanced_parts():
    x = np.random.default_rng(0).normal(size=(800, 8))
    parts = neighbours.balanced_parts(x, neighbours.knn(x, 5), 8)
    assert np.bincount(parts, minlength=8).max() <= np.ceil(1.05 * 100) + 1
