"""Exact removal of repeated substrings, by sorted suffixes.

A byte goes if some string of LENGTH bytes that covers it also starts elsewhere,
in the same text or another.  Matches never cross texts, and all strings are
judged on the input.

Sorting every suffix of a corpus is not needed to find these.  Each string of
LENGTH bytes has an anchor, the least of the hashes of its GRAM-byte windows
(all places of the least one, on ties), so equal strings have equal anchors at
equal places; only about 2 of LENGTH - GRAM places are anchors.  Anchors are counted
first, and a bit map of bounded size keeps most of those that occur once from
being looked at again (where it fills up, more pass; none that matters is lost).
An anchor comes with its context, all bytes that strings with it may reach.

* Contexts that occur twice: all strings in them are repeats.  They are counted
  by digest, with partial sums, so a text with many copies is no one's burden.
* Contexts that occur once, beside others of the same anchor: their suffixes to
  the right and reversed prefixes to the left of the anchor are sorted, by
  deep-shallow sorting: multikey quicksort on words of bytes down to a shallow
  depth, then blind tries for the groups with longer common prefixes.  The common
  prefixes of neighbours tell which ends agree, and how far; strings at an offset
  are equal if both ends are.
* Anchors with more than GROUP such contexts: their strings are counted by
  digest, each on its own, so that no task holds a group of unbounded size.

Null text counts as empty.  Repeated rows repeat each other.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estatum.llm import text as tx
from estatum.llm.common import extended, materialize, table

U = np.uint64
LENGTH, GRAM = 200, 128
REACH = LENGTH - GRAM
#: Bytes by which multikey quicksort tells ends apart, beyond the anchor's own.
SHALLOW, GROUP = 32, 20_000
#: Bits of the map of repeated anchors at most; bytes of places and spans up to which these are broadcast.
MAP_BITS = 1 << 29
FEW_BYTES = 128 << 20
#: Rows that one sort takes at most, groups being whole.
ROWS = 20_000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place, by doubling."""
    h, width, base = tx._RAW[data], 1, int(tx._BASE)
    while width < GRAM:
        h = h[: len(h) - width] * U(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    return tx.mix(h)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive values, by doubling."""
    out, width = h, 1
    while 2 * width <= w:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    return np.minimum(out[: len(h) - w + 1], out[w - width : len(h) - width + 1]) if w > width else out


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(text, place within it, gram hash, context digest) of a block's anchors."""
    ends, starts = offsets[1:], offsets[:-1]
    if len(data) < LENGTH:
        return None
    h = gram_hashes(data)
    low = sliding_min(h, REACH + 1)
    # strings that cross texts have no anchor
    doc = np.repeat(np.arange(len(starts)), ends - starts)
    valid = doc[: len(low)] == doc[LENGTH - 1 :]
    low = np.where(valid, low, U(0))
    # an anchor is the least of some string that holds it
    high = ~sliding_min(~np.concatenate([np.zeros(REACH, U), low, np.zeros(REACH, U)]), REACH + 1)
    at = np.flatnonzero(high == h)
    at = at[h[at] != 0]
    if not len(at):
        return None
    d = doc[at]
    left, right = np.minimum(at - starts[d], REACH), np.minimum(ends[d] - at, LENGTH)
    first, last = at - left, at + right - GRAM
    key = tx.mix(left.astype(U) * U(1009) + right.astype(U))
    for k in range(0, REACH + LENGTH, GRAM):
        key = tx.mix(key * tx._BASE + h[np.minimum(first + k, last)])
    return d, at - starts[d], h[at], key, left, right


ANCHORS = "row long, doc_id long, gram long, context long, at long"


def _at(place, left, right):
    """Place of an anchor in its text and the bytes of context on both sides."""
    return place << 16 | left << 8 | right


def anchor_grams(docs: DataFrame) -> DataFrame:
    """(gram, n) of the anchors of texts, summed by block."""

    def run(batches):
        for b in batches:
            for _, _, data, off in tx.blocks(b.column(0)):
                found = anchors(data, off)
                if found is not None:
                    gram, n = np.unique(found[2], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long")


def repeated_map(grams: DataFrame) -> bytes:
    """Bits of the grams; each part of the map is made by one task."""
    bits = 1 << min(MAP_BITS.bit_length() - 1, max(20, (16 * grams.count()).bit_length()))
    part = bits // 64

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(part, np.bool_)
        out[f["bit"].to_numpy() % part] = True
        return pd.DataFrame({"part": [int(f["bit"].iloc[0]) // part], "map": [np.packbits(out, bitorder="little").tobytes()]})

    rows = grams.select(F.col("gram").bitwiseAND(F.lit(bits - 1)).alias("bit")).withColumn("_p", F.floor(F.col("bit") / part))
    have = {r.part: bytes(r.map) for r in rows.groupBy("_p").applyInPandas(fill, "part long, map binary").collect()}
    return b"".join(have.get(i, bytes(part // 8)) for i in range(64))


def anchor_rows(docs: DataFrame, bit_map: bytes) -> DataFrame:
    """ANCHORS of texts (row, doc_id, text) whose gram the map has."""
    names = [x.split(" ")[0] for x in ANCHORS.split(", ")]
    shared = docs.sparkSession.sparkContext.broadcast(bit_map)

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            for first, n, data, off in tx.blocks(b.column(2)):
                found = anchors(data, off)
                if found is None:
                    continue
                low = (found[2] & U(8 * len(bits) - 1)).astype(np.int64)
                keep = np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                if not len(keep):
                    continue
                d, place, gram, context, left, right = (x[keep] for x in found)
                take = pa.array(first + d)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(_at(place, left, right))], names=names)

    return docs.select("row", "doc_id", "text").mapInArrow(run, ANCHORS)


# deep-shallow sorting -------------------------------------------------------


def _word_keys(m: np.ndarray, depth: int) -> np.ndarray:
    return np.ascontiguousarray(m[:, depth : depth + 8]).view(">u8").ravel()


def multikey_order(m: np.ndarray, group: np.ndarray, start: int = 0, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by group, then by ``depth`` bytes from ``start`` on:
    multikey quicksort with eight bytes a step; ranges that are told apart drop
    out.  Also returns, per place in the order, whether it ties with the one before."""
    order = np.argsort(group, kind="stable")
    tied = np.concatenate([[False], group[order][1:] == group[order][:-1]])
    for k in range(start, min(start + depth, m.shape[1] - 7), 8):
        if not tied.any():
            break
        live = tied.copy()
        live[:-1] |= tied[1:]
        at = np.flatnonzero(live)
        part = np.cumsum(~tied)[at]
        keys = _word_keys(m[order[at]], k)
        inner = np.lexsort((keys, part))
        order[at] = order[at][inner]
        keys, part = keys[inner], part[inner]
        same = np.concatenate([[False], (keys[1:] == keys[:-1]) & (part[1:] == part[:-1])])
        tied[at] = same
    return order, tied


class BlindTrie:
    """Strings with a common prefix, by the places where they first differ.

    A node is (depth, children by byte) and a leaf a string's number; bytes
    between depths are not kept.  To insert, walk blindly to a leaf, compare with
    it once, and split the path where they differ."""

    def __init__(self, rows: list[bytes], depth: int):
        self.rows, self.root = rows, 0
        self.equal: dict[int, list[int]] = {0: [0]}
        for i in range(1, len(rows)):
            self._insert(i, depth)

    def _insert(self, i: int, depth: int) -> None:
        rows, s = self.rows, self.rows[i]
        node, path = self.root, []
        while type(node) is tuple:
            path.append(node)
            node = node[1].get(s[node[0]], next(iter(node[1].values())))
        t = rows[node]
        if s == t:
            self.equal[node].append(i)
            return
        x = np.frombuffer(s, np.uint8)[depth:] != np.frombuffer(t, np.uint8)[depth:]
        d = depth + int(x.argmax())
        self.equal[i] = [i]
        up = None
        for n in path:
            if n[0] >= d:
                break
            up = n
        below = self.root if up is None else up[1].get(s[up[0]])
        if type(below) is tuple and below[0] == d:
            below[1][s[d]] = i
            return
        new = (d, {t[d]: below, s[d]: i})
        if up is None:
            self.root = new
        else:
            up[1][s[up[0]]] = new

    def order(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and each one's common prefix with the one before
        (-1: equal, or the first)."""
        out, lcp, stack = [], [], [(self.root, -1)]
        while stack:
            node, d = stack.pop()
            if type(node) is tuple:
                kids = sorted(node[1].items())
                stack += [(kid, node[0] if k else d) for k, (_, kid) in reversed(list(enumerate(kids)))]
            else:
                for k, i in enumerate(self.equal[node]):
                    out.append(i)
                    lcp.append(-1 if k else d)
        return out, lcp


def common_prefixes(m: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in the order."""
    width = m.shape[1]
    differ = m[order[1:]] != m[order[:-1]]
    return np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), width)])


def deep_shallow(m: np.ndarray, group: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``m`` within groups, whose first ``start`` bytes are
    equal, and common prefixes of neighbours in it (0 where the group changes)."""
    order, tied = multikey_order(m, group, start)
    edges = np.flatnonzero(~tied)
    ends = np.append(edges[1:], len(order))
    for a, b in zip(edges[ends - edges > 1], ends[ends - edges > 1], strict=True):
        rows = [x.tobytes() for x in m[order[a:b]]]
        inner, _ = BlindTrie(rows, start).order()
        order[a:b] = order[a:b][inner]
    lcp = common_prefixes(m, order)
    g = group[order]
    lcp[1:][g[1:] != g[:-1]] = 0
    return order, lcp


def repeated_offsets(gram: np.ndarray, left: np.ndarray, right: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """Rows x (REACH + 1): whether the string that starts so many bytes before
    the anchor also occurs in another row of the same gram.

    ``right``: bytes from the anchor on, ``left``: bytes before it, backwards; both
    filled up, with the numbers of real bytes in ``rights`` and ``lefts``."""
    out = np.zeros((len(gram), REACH + 1), bool)
    ro, rl = deep_shallow(right, gram, GRAM)
    lo, ll = deep_shallow(left, gram)
    rg, lg = np.empty(len(gram), np.int64), np.empty(len(gram), np.int64)
    new = lambda order: np.concatenate([[True], gram[order][1:] != gram[order][:-1]])
    fresh_r, fresh_l = new(ro), new(lo)
    for o in range(REACH + 1):
        able = (lefts >= o) & (rights >= LENGTH - o)
        if not able.any():
            continue
        rg[ro] = np.cumsum(fresh_r | (rl < LENGTH - o))
        lg[lo] = np.cumsum(fresh_l | (ll < o))
        at = np.flatnonzero(able)
        key = rg[at] * (len(gram) + 1) + lg[at]
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        out[at, o] = n[inverse] > 1
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true offsets, (first, last)."""
    x = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(x[::2].tolist(), (x[1::2] - 1).tolist(), strict=True))


STARTS = "row long, doc_id long, lo int, hi int"


def compare_contexts(rows: DataFrame) -> DataFrame:
    """STARTS (first and last start of repeated strings) of contexts (row, doc_id,
    gram, place, lefts, rights, context bytes), all of a gram together."""

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        n = len(f)
        left, right = np.zeros((n, REACH), np.uint8), np.zeros((n, LENGTH), np.uint8)
        lefts, rights = f["lefts"].to_numpy(), f["rights"].to_numpy()
        for i, (c, a) in enumerate(zip(f["bytes"], lefts, strict=True)):
            raw = np.frombuffer(c, np.uint8)
            left[i, :a] = raw[:a][::-1]
            right[i, : len(raw) - a] = raw[a:]
        flags = repeated_offsets(f["gram"].to_numpy(), left, right, lefts, rights)
        ids, docs, places = f["row"].to_numpy(), f["doc_id"].tolist(), f["place"].to_numpy()
        out = [(ids[i], docs[i], places[i] - b, places[i] - a) for i in np.flatnonzero(flags.any(axis=1)) for a, b in _spans(flags[i])]
        return pd.DataFrame(out, columns=["row", "doc_id", "lo", "hi"])

    def run(frames):
        held = []
        size = 0
        for f in frames:
            held.append(f)
            size += len(f)
            if size < ROWS:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = np.flatnonzero((whole["gram"] != whole["gram"].iloc[-1]).to_numpy())
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield solve(whole.iloc[:cut].reset_index(drop=True))
            held, size = [whole.iloc[cut:]], len(whole) - cut
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    return rows.repartition("gram").sortWithinPartitions("gram").mapInPandas(run, STARTS)


def count_strings(rows: DataFrame) -> DataFrame:
    """STARTS of the same contexts, where a gram has too many for one task: each
    string of LENGTH bytes is counted by two digests."""
    offsets = F.sequence(F.greatest(F.lit(0), LENGTH - F.col("rights")), F.col("lefts"))
    each = rows.filter((F.col("lefts") + F.col("rights")) >= LENGTH).withColumn("o", F.explode(offsets))
    string = F.substring(F.col("bytes"), F.col("lefts") - F.col("o") + 1, F.lit(LENGTH))
    # by gram and offset as well: anchors of one text may reach the same string
    keys = ["gram", "o", "k1", "k2"]
    keyed = each.select("row", "doc_id", (F.col("place") - F.col("o")).cast("int").alias("lo"), "gram", "o", F.xxhash64(string).alias("k1"), F.hash(string).alias("k2"))
    twice = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return keyed.join(twice, keys).select("row", "doc_id", "lo", F.col("lo").alias("hi"))


def cut_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Remove from each text the bytes from ``lo`` to ``hi`` + LENGTH of its
    ``starts``.  Gives ``keep``, n_bytes, n_removed, n_spans, kept (bytes)."""
    schema = extended(docs.select(*keep).schema, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

    def run(batches):
        for b in batches:
            rows = []
            for t, s in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                raw = (t.as_py() or "").encode()
                spans = sorted((x["lo"], x["hi"] + LENGTH) for x in s.as_py() or [])
                merged: list[list[int]] = []
                for lo, hi in spans:
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                at, parts = 0, []
                for lo, hi in merged:
                    parts.append(raw[at:lo])
                    at = hi
                kept = b"".join([*parts, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *cols], names=schema.names)

    return docs.select(*keep, "text", "starts").mapInArrow(run, schema)


def few(df: DataFrame, lists: str, width: int) -> DataFrame:
    """``df``, to be broadcast if it takes up to FEW_BYTES: 32 bytes a row, and ``width``
    an element of the array ``lists``."""
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(lists)), F.lit(0)).alias("cells")).first()
    return F.broadcast(df) if 32 * n.rows + width * n.cells <= FEW_BYTES else df


def merged_spans(starts: DataFrame) -> DataFrame:
    """(_r, _d, starts) of STARTS: a row a text, its runs of starts merged where the
    strings that start there touch."""
    order = Window.partitionBy("row", "doc_id").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("lo") <= before + LENGTH, 0).otherwise(1)
    runs = starts.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy("row", "doc_id", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return each.groupBy(F.col("row").alias("_r"), F.col("doc_id").alias("_d")).agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of (doc_id, text)."""
    # a text is named by its id and its own hash, so equal ids do not mix texts
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    again = materialize(anchor_grams(docs).groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram"), "grams")
    found = materialize(anchor_rows(docs, repeated_map(again)), "anchors")
    contexts = materialize(found.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "doc_id", "at")).alias("x")).select("gram", "context", "n", "x.*"), "contexts")
    # strings of contexts that occur twice
    twice = contexts.filter("n > 1").select("gram", "context")
    part = lambda shift, bits: F.shiftright("at", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    place, left, right = part(16, 31), part(8, 8), part(0, 8)
    sure = found.join(twice, ["gram", "context"], "left_semi").select("row", "doc_id", (place - left).alias("lo"), F.least(place, place + right - LENGTH).alias("hi"))
    # contexts that occur once beside others
    grams = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1").drop("least")
    mixed = contexts.join(grams, "gram").select("row", "doc_id", F.struct("gram", "kinds", place.alias("place"), left.alias("lefts"), right.alias("rights")).alias("a"))
    wanted = materialize(mixed.groupBy(F.col("row").alias("_r"), F.col("doc_id").alias("_d")).agg(F.collect_list("a").alias("places")), "wanted")
    named = (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    single = docs.join(few(wanted, "places", 56), named)
    sliced = single.select("row", "doc_id", F.encode("text", "UTF-8").alias("raw"), F.explode("places").alias("a")).select("row", "doc_id", "a.*", F.substring("raw", F.col("a.place") - F.col("a.lefts") + 1, F.col("a.lefts") + F.col("a.rights")).alias("bytes"))
    sliced = materialize(sliced.dropDuplicates(["row", "doc_id", "place"]), "sliced")
    compared = compare_contexts(sliced.filter(F.col("kinds") <= GROUP)).unionByName(count_strings(sliced.filter(F.col("kinds") > GROUP)))
    starts = materialize(merged_spans(sure.unionByName(compared).filter("lo <= hi")), "starts")
    return cut_spans(docs.join(few(starts, "starts", 32), named, "left"), ["doc_id"])


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
