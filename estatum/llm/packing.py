"""Best-fit packing of tokenized documents into sequences of fixed length.

Documents become runs of token ids with one end id; only runs longer than a
sequence are cut.  Packing is bulk-synchronous, longest pieces first: class by class
of lengths (each half the one before), supersteps run until no piece of the class is
left.  A superstep is one Spark job over two sorted tables, pieces and gaps:

* a sweep over both, by falling size, gives each piece its successors, the gaps that
  hold it, as a count;
* pieces that want the same gaps are told apart by rank: as many of the longest as
  there are gaps get one, and each takes the last (tightest) gap that leaves one to
  all shorter pieces;
* a second sweep, along the ranks, meets pieces with their gaps.

Then gaps shrink and the next superstep follows; where no gap holds what is left, new
sequences are opened, as many as its tokens fill.  Short pieces of one length go in
bundles, which halve down to single pieces.

Pieces of one length are interchangeable, and so are gaps of one size, so both tables
hold runs (size, count): at most ``capacity`` lengths, and for the gaps as many runs
as supersteps have cut, whatever the corpus.  Each piece then looks up its place by
its rank among the pieces of its length; ranks come from salted windows, so no
length, however common, is one task's.

Null text counts as empty (the end id alone).  Repeated rows are packed once each, as
are rows of one id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatum.llm.common import extended, materialize, table, with_rank

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
#: How the byte-level vocabulary splits text before merging, in the
#: standard library's terms, which agree with it on plain texts (letters first, since most
#: words are of these and no other way begins with one).
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
SPLIT = re.compile(rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?[^\s\d{LETTER}]+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞€]")
SPECIAL = "<|endoftext|>"
#: Words kept by a worker in each of two generations, characters of the texts that are split
#: at once, words that are encoded at once.
CACHED, AT_ONCE, WORDS = 500_000, 1 << 19, 4096
#: Classes of lengths: the last takes all under this share of the capacity.  By how much bundles shrink.
LAST, SHRINK = 16, 4


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, all by the tokenizer.  Words, which
    it never merges across, are encoded in lots, as lines, and kept; texts that the split
    does not cover are given to the tokenizer whole.  Of the words, those
    met since the last CACHED new ones are kept, and the CACHED before them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lines(self, words: list[str]) -> list[bytes]:
        """Ids of words of the split that aren't space, given to the tokenizer as lines of
        one text, which it cuts at the same places: no such word has the line end's id."""
        (e,) = self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        ends = (4 * np.flatnonzero(ids == self.line)).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(x + 4 for x in ends)], [*ends, len(data)], strict=True)]

    def learn(self, words: set[str]) -> None:
        """Keep the ids of words that are not among the young."""
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        fresh = []
        for w in words:
            if (ids := self.old.get(w)) is None:
                fresh.append(w)
            else:
                self.young[w] = ids
        spaces, fresh = [w for w in fresh if w.isspace()], [w for w in fresh if not w.isspace()]
        self.young.update(zip(spaces, self.raw(spaces), strict=True))
        for i in range(0, len(fresh), WORDS):
            lot = fresh[i : i + WORDS]
            self.young.update(zip(lot, self.lines(lot), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if NOT_PLAIN.search(t) or SPECIAL in t else SPLIT.findall(t) for t in texts]
        known = [words and list(map(self.young.get, words)) for words in split]
        gaps = [words and [i for i, ids in enumerate(found) if ids is None] for words, found in zip(split, known, strict=True)]
        self.learn({words[i] for words, at in zip(split, gaps, strict=True) if words for i in at})
        for words, found, at in zip(split, known, gaps, strict=True):
            for i in at or ():
                found[i] = self.young[words[i]]
        return [self.raw([t])[0] if words is None else b"".join(found) for t, words, found in zip(texts, split, known, strict=True)]

    def stream(self, texts):
        """Ids of each text, in order; texts go in lots of about AT_ONCE characters."""
        lot, size = [], 0
        for t in texts:
            lot.append(t)
            size += len(t)
            if size >= AT_ONCE:
                yield from self.encode(lot)
                lot, size = [], 0
        yield from self.encode(lot)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One a worker process, kept from task to task."""
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first takes the rest."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, keep: list[str], path: str, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``keep`` columns plus piece, start, length, ids_crc32 (and ids)."""
    schema = extended(docs.select(*keep).schema, "piece integer, start long, length integer, ids_crc32 long" + ", ids binary" * with_ids)

    def run(batches):
        own = encoder(path)
        for b in batches:
            at, rows = [], []
            for i, ids in enumerate(own.stream(t.as_py() or "" for t in b.column(b.num_columns - 1))):
                ids += b"\0\0\0\0"
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * s : 4 * (s + n)]
                    at.append(i)
                    rows.append((k, s, n, zlib.crc32(part), part if with_ids else None))
            take = pa.array(at, pa.int32())
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            cols = [c.take(take) for c in b.columns[:-1]] + [pa.array([r[k] for r in rows], kinds[k]) for k in range(4 + with_ids)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


PLACES = "_length int, _from long, _n long, _fit long, _first long, _at int"


#: One superstep over pieces {p} (length, done, fit, n) and gaps {g} (gap, first, n).
SUPERSTEP = """
WITH runs AS (SELECT 0 AS kind, gap AS size, n, gap, first, 0L AS length, 0L AS done, 0L AS fit FROM {g} UNION ALL SELECT 1, length * fit, n, 0L, 0L, length, done, fit FROM {p}),
-- gaps that hold a size, and pieces of at least that size
swept AS (SELECT *, sum(IF(kind = 0, n, 0)) OVER down AS holds, sum(IF(kind = 1, n, 0)) OVER down AS wants FROM runs WINDOW down AS (ORDER BY size DESC, kind, first, length ROWS UNBOUNDED PRECEDING)),
-- pieces that get a gap, up to each: no more than there are gaps, longest first
ranked AS (SELECT *, wants + least(0, min(IF(kind = 1, holds - wants, NULL)) OVER (ORDER BY size DESC, kind, first, length ROWS UNBOUNDED PRECEDING)) AS gets FROM swept),
shifted AS (SELECT *, coalesce(max(IF(kind = 1, gets, NULL)) OVER (ORDER BY size DESC, kind, first, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
 min(IF(kind = 1, holds - gets, NULL)) OVER (ORDER BY size DESC, kind, first, length ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shift FROM ranked),
-- both on the axis of the gaps' ranks
spans AS (SELECT kind, gap, first, length, done, fit, IF(kind = 1, before + shift, holds - n) AS start, IF(kind = 1, gets + shift, holds) AS stop FROM shifted),
met AS (SELECT start, lead(start) OVER (ORDER BY start, kind) AS next, last(IF(kind = 0, struct(gap, first, start, stop), NULL), true) OVER axis AS g, last(IF(kind = 1, struct(length, done, fit, start, stop), NULL), true) OVER axis AS p
 FROM spans WHERE stop > start WINDOW axis AS (ORDER BY start, kind ROWS UNBOUNDED PRECEDING)),
taken AS (SELECT *, least(coalesce(next, g.stop), g.stop, p.stop) - start AS m FROM met WHERE g IS NOT NULL AND p IS NOT NULL)
SELECT p.length, p.done + p.fit * (start - p.start) AS rank, m * p.fit AS n, p.fit, g.first + start - g.start AS first, {capacity} - g.gap AS at FROM taken WHERE m > 0"""


def superstep(spark: SparkSession, pieces: list[tuple], gaps: list[tuple], capacity: int) -> list[tuple]:
    """Match runs of bundles (length, done, fit, n): n bundles of ``fit`` pieces of one
    length, of which ``done`` are placed, with runs of gaps (gap, first, n), one bundle
    a gap.  Gives PLACES."""
    runs = lambda rows, names: spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], pa.int64()) for i, c in enumerate(names)}))
    out = spark.sql(SUPERSTEP, p=runs(pieces, ("length", "done", "fit", "n")), g=runs(gaps, ("gap", "first", "n")), capacity=capacity)
    return [tuple(r) for r in out.collect()]


def _bundles(left: dict[int, int], done: dict[int, int], lengths: list[int], size: int) -> list[tuple]:
    """Runs of bundles of about ``size`` tokens, of as many pieces as are left."""
    out = []
    for x in lengths:
        if left[x]:
            fit = max(1, min(size // x, left[x]))
            out.append((x, done[x], fit, left[x] // fit))
    return out


def _shrink(gaps: dict[int, dict[int, int]], taken: list[tuple], capacity: int) -> None:
    """Cut what was taken out of the runs of gaps ({gap: {first: n}}), and add what is
    left of each."""
    cut: dict[tuple, int] = {}
    for length, _, n, fit, first, at in taken:
        cut[capacity - at, first] = n // fit
        rest = capacity - at - fit * length
        if rest:
            gaps.setdefault(rest, {})[first] = n // fit
    for gap in {g for g, _ in cut}:
        runs, kept = gaps.pop(gap), {}
        own = sorted((f, n) for (g, f), n in cut.items() if g == gap)
        for first, n in runs.items():
            at = first
            for f, m in own:
                if first <= f < first + n:
                    if f > at:
                        kept[at] = f - at
                    at = f + m
            if at < first + n:
                kept[at] = first + n - at
        if kept:
            gaps[gap] = kept


def sweeps(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """PLACES of the pieces that ``counts`` gives by length: (length, first rank,
    pieces, pieces a sequence, first sequence, offset), so many to each of consecutive
    sequences.  The driver holds the runs and asks for superstep after superstep."""
    left, done = dict(counts), dict.fromkeys(counts, 0)
    gaps: dict[int, dict[int, int]] = {}
    out, opened, top = [], 0, capacity
    while top:
        low = 0 if top * LAST <= capacity else top // 2
        lengths = sorted(x for x in left if low < x <= top)
        while any(left[x] for x in lengths):
            widest, shortest = max(gaps, default=0), min(x for x in lengths if left[x])
            if widest < shortest:
                tokens = sum(x * left[x] for x in lengths)
                new = max(-(-tokens // capacity), sum(left[x] for x in lengths if 2 * x > capacity))
                gaps[capacity] = {opened: new}
                opened, widest = opened + new, capacity
            size = capacity
            while size >= 2 * top and size > 2 * widest:
                size //= 2
            while size:
                pieces = _bundles(left, done, lengths, size)
                if pieces and min(x * fit for x, _, fit, _ in pieces) <= max(gaps, default=0):
                    least = min(x * fit for x, _, fit, _ in pieces)
                    taken = superstep(spark, pieces, [(g, f, n) for g, runs in gaps.items() if g >= least for f, n in runs.items()], capacity)
                    for length, _, n, *_ in taken:
                        left[length] -= n
                        done[length] += n
                    _shrink(gaps, taken, capacity)
                    out += taken
                size = max(size // SHRINK, top) if size > top else size // SHRINK if low == 0 and size > SHRINK else int(size > 1)
        top = low
    return out


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to
    ``capacity``.  What passes the driver is one count a length, and runs of places,
    whose number follows the capacity and the supersteps."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.createDataFrame(sweeps(spark, counts, capacity), PLACES)
    ranked = with_rank(pieces, ["length"], order, "_rank", salts=256)
    k = F.col("_rank") - F.col("_from")
    joined = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n")))
    return joined.select(*pieces.columns, (F.col("_first") + F.floor(k / F.col("_fit"))).alias("sequence_id"), (F.col("_at") + F.pmod(k, F.col("_fit")) * F.col("length")).cast("long").alias("offset"))


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Documents (doc_id, text) to placed pieces, ids by the tokenizer of ``path``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    pieces = materialize(token_pieces(docs, ["doc_id"], path, capacity=capacity), "pieces")
    placed = pack(pieces, ["doc_id", "piece"], capacity)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
