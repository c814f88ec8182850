"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the training texts are quantised to powers of
LOG_BASE, and an n-gram of level q is put into the filter q + 1 times, with q + 1
families of hash functions; its level is read back by probing family after
family until one is absent.  There are as many families as the number of training
tokens needs, so no count is cut.  Absence is certain, so a count is never read too
low, and each further wrong level takes another false positive.

The filter is made of shards, one a bucket of n-grams by hash, built where the
counts are gathered, so it grows with the corpus.  Where all shards together are at
most BROADCAST_BYTES they are broadcast, and one pass over the texts scores them.
Beyond, probes go to the shards: a task sends the distinct n-grams of its batch to
their buckets once, a bucket answers with levels, and the batch is scored from these.
Both ways give the same scores, and both cost in proportion to the texts.

A word v after u has probability (q(uv) + MU * p(v)) / (q(u) + MU), q the counts
read from the filter and p(v) = (q(v) + 0.1) / (N + 0.1 * (V + 1)): the pair
smoothed by the word, which is itself smoothed.  The end of a text is a token;
its start is a context.

``base`` scores need exact counts of words.  They are joined by bucket: a task
sends the distinct words of its batch once, with the texts that hold them, so a
frequent word is one row a batch, not one a text.  A bucket with more than
PART_BYTES of such rows (a very frequent word) is dealt over several tasks, each with
a copy of its counts, so copies are in proportion to what they serve.

Null text counts as empty: the end alone.  Repeated rows are scored once each; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatum.llm import text as tx
from estatum.llm.common import extended, materialize, table

U = np.uint64
END, START = U(0x1234567890ABCDEF), U(0x0FEDCBA987654321)
LOG_BASE, HASHES, BITS = 1.5, 4, 8.0
MU = 20.0
BROADCAST_BYTES = 256 << 20
#: Bytes of occurrences that one task looks up with a copy of a bucket's counts.
PART_BYTES = 64 << 20
#: Hot buckets (16 bytes each) up to which their numbers of parts are broadcast.
FEW_HOT = 1_000_000
#: Tokens whose counts a task merges before sending them on.
BATCH = 1 << 20
#: Documents to a bucket of the counts.
PER_BUCKET = 8192


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block with an end behind each text, and each one's text."""
    h, counts = tx.words(data, offsets)
    n = len(offsets) - 1
    out = np.full(len(h) + n, END)
    doc = np.repeat(np.arange(n), np.diff(counts) + 1)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(counts))] = h
    return out, doc


def contexts(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The word before each token."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.flatnonzero(np.diff(doc, prepend=-1))] = START
    return before


def pair(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tx.mix(u * U(0x9E3779B97F4A7C15) + v)


def bucket_of(v: np.ndarray, buckets: int) -> np.ndarray:
    return ((v >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, buckets: int, *cols):
    """(bucket, columns) of rows that are sorted by bucket."""
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, *(c[edges[b] : edges[b + 1]] for c in cols)


def _record(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def pack_counts(keys: np.ndarray, counts: np.ndarray, width: int) -> tuple[bytes, bytes]:
    """Keys cut to ``width`` bytes, counts to one; greater counts repeat the key."""
    times = (counts + 254) // 255
    at = np.repeat(np.arange(len(keys)), times)
    each = np.full(len(at), 255)
    each[np.cumsum(times) - 1] = counts - 255 * (times - 1)
    return np.ascontiguousarray(keys[at]).view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), each.astype(np.uint8).tobytes()


def unpack_keys(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(U).ravel()


#: Bytes of a key by kind: words are told apart exactly, pairs within their bucket.
WIDTH = {1: 8, 2: 6}


def ngram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed counts by bucket and kind (1 word, 2 pair) of texts.  Each task
    merges equal n-grams of its batches before it sends them."""
    names, kinds = ["bucket", "kind", "keys", "counts"], (pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def flush(held):
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        for kind, key in ((1, v), (2, pair(u, v))):
            uniq, n = np.unique(key, return_counts=True)
            bucket = bucket_of(uniq, buckets)
            yield _record([(b, kind, *pack_counts(k, c, WIDTH[kind])) for b, k, c in _by_bucket(bucket, buckets, uniq, n)], names, kinds)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for _, _, data, off in tx.blocks(b.column(0)):
                h, doc = tokens(data, off)
                held.append((contexts(h, doc), h))
                size += len(h)
                if size >= BATCH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return docs.select("text").mapInArrow(run, "bucket long, kind int, keys binary, counts binary")


def merge(keys: list[bytes], counts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    k = unpack_keys(b"".join(keys), width)
    c = np.frombuffer(b"".join(counts), np.uint8).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def shards(counts: DataFrame) -> DataFrame:
    """A row a bucket: its words and their exact counts, tokens, shard of words
    and pairs."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        words, pairs = ((f["keys"][f["kind"] == k], f["counts"][f["kind"] == k]) for k in (1, 2))
        wk, wc = merge(list(words[0]), list(words[1]), 8)
        pk, pc = merge(list(pairs[0]), list(pairs[1]), 6)
        shard = build(np.concatenate([filter_key(wk, 1), filter_key(pk, 2)]), np.concatenate([wc, pc]), BITS)
        return pd.DataFrame({"bucket": [f["bucket"].iloc[0]], "words": [wk.tobytes()], "word_counts": [wc.tobytes()], "n": [int(wc.sum())], "v": [len(wk)], "shard": [shard], "size": [len(shard)]})

    return counts.groupBy("bucket").applyInPandas(run, "bucket long, words binary, word_counts binary, n long, v long, shard binary, size long")


def filter_key(keys: np.ndarray, kind: int) -> np.ndarray:
    """What the filter is asked for: the 48 bits that every kind keeps, and the kind."""
    return (keys & U((1 << 48) - 1)) | U(kind << 48)


def level(c: np.ndarray) -> np.ndarray:
    return np.round(np.log(np.maximum(c, 1)) / math.log(LOG_BASE)).astype(np.int64)


def levels_of(total: int) -> int:
    """Families of hash functions that counts up to ``total`` can need; the greatest long needs 109."""
    return math.ceil(math.log(max(total, 1)) / math.log(LOG_BASE)) + 1


def _bits(keys: np.ndarray, family: int, n_bits: int):
    """Bit numbers of one family for each key, one array a hash function."""
    a = tx.mix(keys + U((family + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    b = (a >> U(32)) | U(1)
    for i in range(HASHES):
        yield ((a + U(i) * b & U(0xFFFFFFFF)) * U(n_bits) >> U(32)).astype(np.int64)


def build(keys: np.ndarray, counts: np.ndarray, bits_a_level: float = BITS) -> bytes:
    """A shard: bits for every key's levels, in one byte array."""
    q = level(counts)
    n_bits = max(64, int(bits_a_level * (q + 1).sum()) + 7 & ~7)
    if n_bits >= 2**32:  # never with PER_BUCKET documents of usual length
        raise ValueError("a shard outgrew its bit numbers: use more buckets")
    bits = np.zeros(n_bits, np.bool_)
    for f in range(int(q.max(initial=-1)) + 1):
        for at in _bits(keys[q >= f], f, n_bits):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Shards by bucket, joined in one array; n-grams of other buckets are absent.
    ``total`` is no less than any count."""

    def __init__(self, shards: dict[int, bytes], buckets: int, total: int = 2**63 - 1):
        self.buckets, self.families = buckets, levels_of(total)
        self.size = np.zeros(buckets, np.int64)
        self.start = np.zeros(buckets, np.int64)
        at = 0
        for b, s in shards.items():
            self.size[b], self.start[b] = 8 * len(s), at
            at += len(s)
        self.data = b"".join(shards.values())

    def _probe(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        data = np.frombuffer(self.data, np.uint8)
        out, left = np.zeros(len(keys), np.uint8), np.flatnonzero(self.size[bucket] > 0)
        for f in range(self.families):
            if not len(left):
                break
            k, size, start = keys[left], self.size[bucket[left]].astype(U), self.start[bucket[left]]
            a = tx.mix(k + U((f + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            b = (a >> U(32)) | U(1)
            ok = np.ones(len(left), bool)
            for i in range(HASHES):
                at = ((a + U(i) * b & U(0xFFFFFFFF)) * size >> U(32)).astype(np.int64)
                ok &= (data[start + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            left = left[ok]
            out[left] = f + 1
        return out

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """0 where absent, else level + 1; equal keys are asked once."""
        uniq, at = np.unique(keys, return_inverse=True)
        bucket = bucket_of(uniq, self.buckets)
        return self._probe(filter_key(uniq, kind), bucket)[at]


def count_of(levels: np.ndarray) -> np.ndarray:
    return np.where(levels > 0, LOG_BASE ** (levels.astype(np.float64) - 1), 0.0)


def token_scores(word: np.ndarray, both: np.ndarray, before: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 probabilities from levels of the word, the pair and the context."""
    p1 = (count_of(word) + 0.1) / (n + 0.1 * (v + 1))
    joint = np.minimum(count_of(both), np.minimum(count_of(word), count_of(before)))
    return np.log10((joint + MU * p1) / (count_of(before) + MU))


SCORED = "token_key long, n_tokens long, score double"


def _asked(data: np.ndarray, off: np.ndarray) -> tuple:
    """Of a block of texts: word hashes, each one's text, pairs, and contexts as the
    filter knows them (texts end where others start: the start's count is the end's)."""
    h, doc = tokens(data, off)
    u = contexts(h, doc)
    return h, doc, pair(u, h), np.where(u == START, END, u)


def _text_scores(h, doc, rows: int, levels, n: int, v: int) -> tuple:
    """Key, number of tokens and score of each text of a block."""
    edges = np.searchsorted(doc, np.arange(rows + 1))
    place = np.arange(len(h)) - edges[doc]
    key = np.add.reduceat(tx.mix(h + place.astype(U) * U(0x9E3779B97F4A7C15)), edges[:-1])
    return key.view(np.int64), np.diff(edges), np.bincount(doc, token_scores(*levels, n, v), rows)


def broadcast_scores(docs: DataFrame, keep: list[str], f: Filter, n: int, v: int) -> DataFrame:
    """``keep`` columns plus SCORED, by a filter that every worker holds."""
    shared = docs.sparkSession.sparkContext.broadcast(f)
    schema = extended(docs.select(*keep).schema, SCORED)

    def run(batches):
        for b in batches:
            at = len(keep)
            for first, rows, data, off in tx.blocks(b.column(at)):
                h, doc, pairs, before = _asked(data, off)
                levels = (shared.value.levels(h, 1), shared.value.levels(pairs, 2), shared.value.levels(before, 1))
                own = _text_scores(h, doc, rows, levels, n, v)
                yield pa.RecordBatch.from_arrays([*b.slice(first, rows).columns[:at], *map(pa.array, own)], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def _dealt_keys(words: list, pairs: list, buckets: int) -> tuple:
    """(distinct words and distinct pairs of a batch, the order in which its buckets ask
    for them, the bucket of each): who has the texts needs no keys beside the answers."""
    keys = [np.unique(np.concatenate(x)) for x in (words, pairs)]
    bucket = bucket_of(np.concatenate(keys), buckets)
    return keys, np.argsort(bucket, kind="stable"), bucket


def sent_batches(docs: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """A row a (batch, bucket): the keys that a batch of about BATCH tokens asks for.  The
    texts travel in one row more a batch, in a bucket below 0 of its own, so no bucket
    has the texts of several."""
    kept = docs.select(F.struct(*keep).alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    rows_of = T.StructType([*T._parse_datatype_string("bucket long, batch long, keys binary, levels binary").fields, T.StructField("own", T.ArrayType(kept.schema["own"].dataType)), T.StructField("texts", T.ArrayType(T.StringType()))])

    def ask(batches):
        from pyspark import TaskContext

        batch, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            own, texts = (pa.concat_arrays([h[0].column(i) for h in held]) for i in (0, 1))
            keys, order, bucket = _dealt_keys([h[1] for h in held], [h[2] for h in held], buckets)
            fk = np.concatenate([filter_key(k, kind) for kind, k in zip((1, 2), keys, strict=True)])
            parts = list(_by_bucket(bucket[order], buckets, fk[order]))
            names = [pa.array([-1 - batch, *[b for b, _ in parts]], pa.int64()), pa.array([batch] * (1 + len(parts)), pa.int64()), pa.array([None, *[k.tobytes() for _, k in parts]], pa.binary()), pa.nulls(1 + len(parts), pa.binary())]
            at = pa.array([0] + [len(own)] * (1 + len(parts)), pa.int32())
            return pa.RecordBatch.from_arrays([*names, pa.ListArray.from_arrays(at, own), pa.ListArray.from_arrays(at, texts)], names=rows_of.names)

        for b in batches:
            for first, rows, data, off in tx.blocks(b.column(1)):
                h, _, pairs, before = _asked(data, off)
                held.append((b.slice(first, rows), np.unique(np.concatenate([h, before])), np.unique(pairs)))
                size += len(h)
                if size >= BATCH:
                    yield flush()
                    batch, held, size = batch + 1, [], 0
        if held:
            yield flush()

    return kept.mapInArrow(ask, rows_of)


def routed_scores(docs: DataFrame, keep: list[str], built: DataFrame, buckets: int, n: int, v: int) -> DataFrame:
    """The same scores where the filter is too large to broadcast."""
    sent = sent_batches(docs, keep, buckets)
    rows_of, own_type = sent.schema, sent.schema["own"].dataType.elementType

    def probe(f: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or f["bucket"].iloc[0] < 0:
            return f
        bucket = int(f["bucket"].iloc[0])
        own = Filter({bucket: bytes(shard["shard"].iloc[0])} if len(shard) else {}, buckets, n)
        keys = np.frombuffer(b"".join(f["keys"]), U)
        levels = own._probe(keys, np.full(len(keys), bucket))
        at = np.concatenate([[0], np.cumsum([len(k) // 8 for k in f["keys"]])])
        return f.assign(keys=None, levels=[levels[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)])

    def gather(f: pd.DataFrame) -> pd.DataFrame:
        head, rest = f[f["bucket"] < 0].iloc[0], f[f["bucket"] >= 0].sort_values("bucket")
        blocks = [(rows, *_asked(data, off)) for _, rows, data, off in tx.blocks(pa.array(head["texts"], pa.string()))]
        keys, order, _ = _dealt_keys([x for _, h, _, _, before in blocks for x in (h, before)], [pairs for _, _, _, pairs, _ in blocks], buckets)
        levels = np.empty(len(order), np.uint8)
        levels[order] = np.frombuffer(b"".join(rest["levels"]), np.uint8)
        find = lambda k, kind: levels[np.searchsorted(keys[kind], k) + kind * len(keys[0])]
        out = [_text_scores(h, doc, rows, (find(h, 0), find(pairs, 1), find(before, 0)), n, v) for rows, h, doc, pairs, before in blocks]
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pd.DataFrame({"own": list(head["own"]), "token_key": cols[0], "n_tokens": cols[1], "score": cols[2]})

    answered = sent.groupBy("bucket").cogroup(built.select("bucket", "shard").groupBy("bucket")).applyInPandas(probe, rows_of)
    scored = answered.groupBy("batch").applyInPandas(gather, T.StructType([T.StructField("own", own_type), *T._parse_datatype_string(SCORED).fields]))
    return scored.select("own.*", "token_key", "n_tokens", "score")


def model_scores(docs: DataFrame, keep: list[str], built: DataFrame, buckets: int, n: int, v: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``keep`` columns plus SCORED of all texts, by the filter of ``built``."""
    if (built.agg(F.sum("size")).first()[0] or 0) > limit:
        return routed_scores(docs, keep, built, buckets, n, v)
    f = Filter({r.bucket: bytes(r.shard) for r in built.select("bucket", "shard").toLocalIterator()}, buckets, n)
    return broadcast_scores(docs, keep, f, n, v)


OCCURRENCES = "bucket long, batch long, ids array<long>, token_keys binary, keys binary, spans binary, owners binary, times binary"
SUMS = "batch long, ids array<long>, token_keys binary, owners binary, logs binary, known binary"


def occurrences(docs: DataFrame, buckets: int) -> DataFrame:
    """A row a (task's batch, bucket): its distinct words, and for each the texts
    of the batch that hold it, by number, and how often.  One row more a batch, in a
    bucket below 0 of its own, names its texts."""
    names = [x.split(" ")[0] for x in OCCURRENCES.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5)

    def flush(held, batch):
        ids, token_keys = [x for c in held for x in c[2]], np.concatenate([c[3] for c in held])
        h, doc = np.concatenate([c[0] for c in held]), np.concatenate([c[1] for c in held])
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
        times = np.diff(np.append(edge, len(h)))
        h, doc = h[edge], doc[edge]
        rows = [(-1 - batch, batch, ids, token_keys.tobytes(), None, None, None, None)]
        for b, k, d, t in _by_bucket(bucket_of(h, buckets), buckets, h, doc, times):
            uniq, n = np.unique(k, return_counts=True)
            rows.append((b, batch, None, None, uniq.tobytes(), n.astype(np.uint32).tobytes(), d.astype(np.uint32).tobytes(), np.minimum(t, 2**32 - 1).astype(np.uint32).tobytes()))
        return _record(rows, names, kinds)

    def run(batches):
        from pyspark import TaskContext

        batch, held, size, n = TaskContext.get().partitionId() << 32, [], 0, 0
        for b in batches:
            for first, rows, data, off in tx.blocks(b.column(1)):
                h, doc = tokens(data, off)
                edges = np.searchsorted(doc, np.arange(rows + 1))
                place = np.arange(len(h)) - edges[doc]
                key = np.add.reduceat(tx.mix(h + place.astype(U) * U(0x9E3779B97F4A7C15)), edges[:-1])
                held.append((h, doc + n, b.column(0).slice(first, rows).to_pylist(), key))
                size, n = size + len(h), n + rows
                if size >= BATCH:
                    yield flush(held, batch)
                    batch, held, size, n = batch + 1, [], 0, 0
        if held:
            yield flush(held, batch)

    return docs.select("doc_id", "text").mapInArrow(run, OCCURRENCES)


def base_sums(docs: DataFrame, built: DataFrame, buckets: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, token_key, logs, known): per text the sum of log10(c + 0.1) and the
    number of tokens with c > 0.  Sums of a (batch, bucket) travel as one row."""
    # an occurrence is 12 bytes at most; buckets with many go in parts
    parts = built.select("bucket", F.ceil(F.col("n") * 12 / part_bytes).cast("long").alias("parts")).filter("parts > 1")
    parts = F.broadcast(parts) if parts.count() <= FEW_HOT else parts
    there = occurrences(docs, buckets).join(parts, "bucket", "left").withColumn("part", F.pmod("batch", F.coalesce("parts", F.lit(1)))).drop("parts")
    known = built.select("bucket", "words", "word_counts").join(parts, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def look_up(f: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if len(f) and f["bucket"].iloc[0] < 0:
            return f[["batch", "ids", "token_keys"]].assign(owners=None, logs=None, known=None)
        words = np.frombuffer(counts["words"].iloc[0], U) if len(counts) else np.empty(0, U)
        have = np.append(np.frombuffer(counts["word_counts"].iloc[0], np.int64) if len(counts) else [], 0)
        out = []
        for r in f.itertuples():
            keys, n = np.frombuffer(r.keys, U), np.frombuffer(r.spans, np.uint32)
            at = np.searchsorted(words, keys)
            inside = at < len(words)
            at[inside] = np.where(words[at[inside]] == keys[inside], at[inside], len(words))
            c = np.repeat(have[at], n)
            owner, place = np.unique(np.frombuffer(r.owners, np.uint32), return_inverse=True)
            t = np.frombuffer(r.times, np.uint32).astype(np.float64)
            out.append((r.batch, None, None, owner.tobytes(), np.bincount(place, t * np.log10(c + 0.1)).tobytes(), np.bincount(place, t * (c > 0)).astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["batch", "ids", "token_keys", "owners", "logs", "known"])

    def add(f: pd.DataFrame) -> pd.DataFrame:
        head = f[f["ids"].notna()].iloc[0]
        logs, known_ = np.zeros(len(head["ids"])), np.zeros(len(head["ids"]), np.int64)
        for r in f[f["ids"].isna()].itertuples():
            at = np.frombuffer(r.owners, np.uint32)
            logs[at] += np.frombuffer(r.logs)
            known_[at] += np.frombuffer(r.known, np.int64)
        return pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in head["ids"]], dtype="Int64"), "token_key": np.frombuffer(head["token_keys"], np.int64), "logs": logs, "known": known_})

    keys = ["bucket", "part"]
    parts_ = there.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(look_up, SUMS)
    total = parts_.groupBy("batch").applyInPandas(add, "doc_id long, token_key long, logs double, known long")
    # equal rows have equal sums
    return total.groupBy("doc_id", "token_key").agg(F.max("logs").alias("logs"), F.max("known").alias("known"))


def language_scores(docs: DataFrame, trains: Column) -> DataFrame:
    """Scores of documents (doc_id, text), learned from those that meet ``trains``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", trains.alias("_trains"))
    n_docs = docs.count()
    buckets = max(8, -(-n_docs // PER_BUCKET))
    built = materialize(shards(ngram_counts(docs.filter("_trains"), buckets)), "shards")
    total = built.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    base = base_sums(docs, built, buckets)
    scored = model_scores(docs, ["doc_id", "_trains"], built, buckets, total.n, total.v)
    right = base.select(F.col("doc_id").alias("_d"), F.col("token_key").alias("_k"), "logs", "known")
    joined = scored.join(right, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("token_key") == F.col("_k")))
    floor = math.log10(total.n + 0.1 * (total.v + 1))
    return joined.select("doc_id", (~F.col("_trains")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * floor).alias("base_score"), "score")


def op4_language_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_scores(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0)
