"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles.  Documents of one set are one class, and the
join runs over classes.  In each of TREES independent trees the classes branch by
one minwise token a step, every tree and step with a hash function of its own: the
members of a node go to the child that their least token names.  A node with at
most SMALL members stops there and is compared exhaustively; a greater one
branches again.  Two sets of similarity s walk a tree's whole path together with
probability s ** DEPTH, and are compared wherever that path stops, so a pair at
0.8 is missed by all trees with probability (1 - 0.41) ** 28, which is 4e-7, whatever
the number of documents; by the sketches below with 1.3e-6, so with under 2e-6 in all.

Nodes that are still greater after DEPTH steps hold texts alike in most tokens
(large groups of near copies, one template).  More branching would lose links, as a
pair need not meet in a child, so these are compared in blocks, every pair of blocks
but those within the node's largest class.  A node of m members outside its largest
class copies each about m / SPLIT times.

Sketches tell which pairs of a node may be similar; what may be is confirmed on
full sets.  To lose no link without confirming every pair of a big group, links go
in two rounds: first each member's two closest and the node's hub, then only pairs
across the classes these links make.  A hub's set travels once a block of pairs.

Texts without words are linked with nothing.  A null id takes no part and is kept.
Repeated rows are one class.  Rows of one id and different texts are documents of
their own; where both lie in one component, both have its id.  An empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from estatum.llm import text as tx
from estatum.llm.common import materialize, table

TREES, DEPTH, SLOTS = 28, 4, 128
#: Members up to which a node stops branching; rows of a first comparison and of a block of greater nodes.
SMALL, LIMIT, SPLIT = 24, 2048, 1024
#: Share of equal sketch bytes from which a pair is confirmed: five standard deviations below 0.8.
MAYBE = 0.62
SIGNATURE = "doc_id long, text_hash long, n long, s1 long, s2 long, steps array<int>, sketch binary, keys binary"
#: Ids (16 bytes each) up to which those of the texts to look up are broadcast.
FEW_IDS = 1_000_000
#: Pairs that one copy of a set serves when they are confirmed.
SERVED = 64
#: Rounds of stars at most; they halve a path's length, so this is never met.
STARS = 100


def _functions() -> tuple[np.ndarray, np.ndarray]:
    a = tx.mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)
    return a, tx.mix(np.arange(1001, 1001 + SLOTS, dtype=np.uint64))


def _sets(batches, k: int):
    """(ids, list of sets) of blocks of texts; the text is the last column."""
    for b in batches:
        for first, n, data, off in tx.blocks(b.column(b.num_columns - 1)):
            yield b.slice(first, n), tx.shingles(*tx.words(data, off), k)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per document: size and digest of its set, the minwise tokens it walks by
    (DEPTH a tree), its sketch, and the short names of its whole paths."""

    def run(batches):
        a, c = _functions()
        for b, sets in _sets(batches, k):
            mins = np.zeros((len(sets), SLOTS), np.uint64)
            sums = np.zeros((len(sets), 2), np.uint64)
            for i, s in enumerate(sets):
                if len(s):
                    low = np.full(SLOTS, np.uint64(2**64 - 1))
                    for j in range(0, len(s), 4096):
                        low = np.minimum(low, (s[j : j + 4096, None] * a + c).min(axis=0))
                    mins[i] = low
                    sums[i] = tx.mix(s).sum(), np.bitwise_xor.reduce(tx.mix(s + np.uint64(77)))
            mins = tx.mix(mins)
            paths = np.repeat(np.arange(TREES, dtype=np.uint64)[None, :], len(sets), axis=0)
            for d in range(DEPTH):
                paths = tx.mix(paths * np.uint64(0x9E3779B97F4A7C15) + mins[:, d : DEPTH * TREES : DEPTH])
            steps = np.ascontiguousarray(mins[:, : DEPTH * TREES].astype(np.uint32)).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * DEPTH * TREES, pa.int32()), pa.array(steps.ravel()))
            raw = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0].view(np.int64)), pa.array(sums[:, 1].view(np.int64)), lists, raw((mins & np.uint64(255)).astype(np.uint8)), raw(paths.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *own], names=[x.split(" ")[0] for x in SIGNATURE.split(", ")])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SIGNATURE)


def packed_sets(docs: DataFrame, k: int, short: bool = False) -> DataFrame:
    """(rep, set) of (rep, text): each set's sorted hashes as bytes, of 64 bits, or of
    the low 32."""
    kind = np.uint32 if short else np.uint64

    def run(batches):
        for b, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.astype(kind).tobytes() for s in sets], pa.binary())], names=["rep", "set"])

    return docs.select("rep", "text").mapInArrow(run, "rep long, set binary")


def texts_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the classes in ``wanted`` (rep): one text a class."""
    named = reps.join(wanted, "rep", "left_semi").select("rep", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"))
    named = materialize(named, "wanted")
    # few ids go to the texts; many would not fit, and both are shuffled
    named = F.broadcast(named) if named.count() <= FEW_IDS else named
    found = docs.join(named, (F.col("doc_id") == F.col("_d")) & (F.xxhash64("text") == F.col("_t"))).select("rep", "text")
    return found.dropDuplicates(["rep"])


def _shared(short: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j; equal i stand together."""
    sets = [np.frombuffer(x, np.uint32) for x in short]
    tokens, number = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    mine = [number[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    mark, out = np.zeros(len(tokens), np.int64), np.zeros(len(i), np.int64)
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(i)), strict=True):
        mark[mine[i[a]]] = 1
        for c in range(a, b, 512):
            part = [mine[x] for x in j[c : min(c + 512, b)]]
            out[c : c + len(part)] = np.add.reduceat(mark[np.concatenate(part)], np.concatenate([[0], np.cumsum([len(x) for x in part])[:-1]]))
        mark[mine[i[a]]] = 0
    return out


def _groups(frames, keys: list[str]):
    """Whole groups of consecutive equal keys, several at a time."""
    held = None
    for f in frames:
        held = f if held is None else pd.concat([held, f], ignore_index=True)
        last = held[keys].iloc[-1]
        same = (held[keys] == last).all(axis=1).to_numpy()
        cut = len(held) - int(same[::-1].argmin() if not same.all() else len(held))
        if cut:
            yield held.iloc[:cut]
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _runs(f: pd.DataFrame, keys: list[str]) -> np.ndarray:
    v = f[keys].to_numpy()
    edge = np.flatnonzero((v[1:] != v[:-1]).any(axis=1)) + 1
    return np.concatenate([[0], edge, [len(f)]])


def _similar(s1, n1, s2, n2) -> np.ndarray:
    est = np.empty((len(s1), len(s2)), np.float32)
    for i in range(0, len(s1), 32):
        est[i : i + 32] = np.count_nonzero(s1[i : i + 32, None, :] == s2[None, :, :], axis=2) / SLOTS
    ratio = np.minimum(n1[:, None], n2[None, :]) * 100 >= 80 * np.maximum(n1[:, None], n2[None, :])
    return np.where(ratio, est, 0)


def _names(sketches: np.ndarray) -> np.ndarray:
    """Short names of whole paths, a column a tree: a sketch's bytes stand in the
    order of trees and steps."""
    return np.ascontiguousarray(sketches[:, : DEPTH * TREES]).view(np.uint32)


def _closest(est: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Of the pairs ``near``, those of a member with its two closest or with the hub,
    the member with most similar ones."""
    m, rows = len(est), np.arange(len(est))
    if m <= 6:
        return near
    out = np.zeros_like(near)
    top = np.argsort(-est, axis=1, kind="stable")[:, :2]
    out[np.repeat(rows, 2), top.ravel()] = True
    out[:, int(near.sum(axis=1).argmax())] = True
    out |= out.T
    return out & near


def small_pairs(members: DataFrame) -> DataFrame:
    """(a, b, close) of members (node, tree, rep, n, sketch) of small nodes: all pairs
    that are similar by sketches.  A pair that walks a whole path together in an
    earlier tree is left to that."""

    def run(frames):
        for f in _groups(frames, ["node"]):
            ids, n, tree = f["rep"].to_numpy(), f["n"].to_numpy(), f["tree"].to_numpy()
            sk = np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(-1, SLOTS)
            names = _names(sk)
            edges = _runs(f, ["node"])
            a, b, c = [], [], []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                est = _similar(sk[s:e], n[s:e], sk[s:e], n[s:e])
                np.fill_diagonal(est, 0)
                near = est >= MAYBE
                i, j = np.nonzero(np.triu(near, 1))
                if not len(i):
                    continue
                fresh = ~(names[s + i, : tree[s]] == names[s + j, : tree[s]]).any(axis=1)
                i, j = i[fresh], j[fresh]
                a.append(ids[s + i])
                b.append(ids[s + j])
                c.append(_closest(est, near)[i, j])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "close": np.concatenate(c)})

    found = _sorted(members, ["node"]).mapInPandas(run, "a long, b long, close boolean")
    return found.groupBy("a", "b").agg(F.bool_or("close").alias("close"))


def close_pairs(members: DataFrame, keys: list[str]) -> DataFrame:
    """First round of greater nodes: the pairs of each member with its two closest and
    with the hub of its group."""

    def run(frames):
        for f in _groups(frames, keys):
            ids, n = f["rep"].to_numpy(), f["n"].to_numpy()
            sk = np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(-1, SLOTS)
            edges = _runs(f, keys)
            a, b = [], []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                est = _similar(sk[s:e], n[s:e], sk[s:e], n[s:e])
                np.fill_diagonal(est, 0)
                i, j = np.nonzero(np.triu(_closest(est, est >= MAYBE), 1))
                a.append(ids[s + i])
                b.append(ids[s + j])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return _sorted(members, keys).mapInPandas(run, "a long, b long").distinct()


def cross_pairs(members: DataFrame, keys: list[str], share: int) -> DataFrame:
    """Second round of greater nodes: all pairs of a group that are similar by sketches
    and by short sets, and are of different classes; where ``side`` is given, pairs
    across sides only.  A pair is left to the first tree whose whole path it walks
    together, as it is compared there."""

    def run(frames):
        for f in _groups(frames, keys):
            ids, n, comp, side, tree = (f[c].to_numpy() for c in ("rep", "n", "comp", "side", "tree"))
            sk = np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(-1, SLOTS)
            names = _names(sk)
            edges = _runs(f, keys)
            a, b = [], []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                est = _similar(sk[s:e], n[s:e], sk[s:e], n[s:e])
                ok = np.triu((est >= MAYBE) & (comp[s:e, None] != comp[None, s:e]), 1)
                if side[s] >= 0:
                    ok &= side[s:e, None] != side[None, s:e]
                i, j = np.nonzero(ok)
                t = int(tree[s])
                if t and len(i):
                    first = ~(names[s + i, :t] == names[s + j, :t]).any(axis=1)
                    i, j = i[first], j[first]
                if len(i):
                    # one more in common than the short sets show, for good measure
                    common = _shared(list(f["set"].iloc[s:e]), i, j) + 1
                    fits = 100 * common >= share * (n[s + i] + n[s + j] - common)
                    i, j = i[fits], j[fits]
                a.append(ids[s + i])
                b.append(ids[s + j])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return _sorted(members, keys).mapInPandas(run, "a long, b long").filter("a < b").distinct()


def _sorted(members: DataFrame, keys: list[str]) -> DataFrame:
    return members.repartition(*keys).sortWithinPartitions(*keys, "rep")


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, share: int, whole: int = 100) -> DataFrame:
    """Pairs with whole * intersection >= share * union, on full sets.

    Each pair's rarer end brings its own set; the set of the other end, which may be
    a hub, is sent once to every SERVED of its pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("deg"))
    ends = materialize(ends, "ends")
    sets = materialize(packed_sets(texts_of(docs, reps, ends), k), "sets")
    sized = pairs
    for c in "ab":
        sized = sized.join(ends.select(F.col("rep").alias(c), F.col("deg").alias(f"deg_{c}")), c)
    turned = F.col("deg_b") > F.col("deg_a")
    hub = sized.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("rep"), F.greatest("deg_a", "deg_b").alias("deg"))
    served = materialize(hub.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(3)), F.ceil(F.col("deg") / SERVED)).cast("long")).drop("deg"), "served")
    tails = served.join(sets, "rep").select("hub", "part", "rep", "set")
    heads = served.select("hub", "part").distinct().join(sets.withColumnRenamed("rep", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("rep"), "set")
    ordered = heads.unionByName(tails).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("rep").asc_nulls_first())

    def run(batches):
        own = None
        for batch in batches:
            a, b = [], []
            for hub, rep, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                s = np.frombuffer(data.as_buffer(), np.uint64)
                if rep is None:
                    own = s
                    continue
                common = len(np.intersect1d(own, s, assume_unique=True))
                if whole * common >= share * (len(own) + len(s) - common):
                    a.append(min(hub, rep))
                    b.append(max(hub, rep))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each linked id reaches.  Alternates large
    and small stars until the links no longer change; each step is a minimum by id
    and a join, whose hubs adaptive execution splits."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(STARS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: greater neighbours go to the least neighbour
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: smaller neighbours, and the document, go to the least one
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        seen = Observation()
        edges = materialize(small.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v") % 1000003).alias("s")), "edges")
        state = seen.get
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"components did not settle in {STARS} rounds")


def walk(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (rep, tree, node) of the nodes where branching stops: those of 2 to
    SMALL members, and, with their ``size``, the greater ones at the last step."""
    tree = lambda t: F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.col("steps")[t * DEPTH]).alias("node"), F.slice("steps", t * DEPTH + 2, DEPTH - 1).alias("rest"))
    active = reps.select("rep", F.explode(F.array(*map(tree, range(TREES)))).alias("x")).select("rep", "x.*")
    small = []
    for step in range(DEPTH):
        size = active.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        level = materialize(active.join(size, "node"), "level")
        small.append(level.filter(F.col("size") <= SMALL).select("rep", "tree", "node"))
        great = level.filter(F.col("size") > SMALL)
        if step < DEPTH - 1:
            active = great.select("rep", "tree", F.xxhash64("node", F.col("rest")[0]).alias("node"), F.slice("rest", 2, DEPTH).alias("rest"))
    return reduce(DataFrame.unionByName, small), great.select("rep", "tree", "node", "size")


def block_pairs(big: DataFrame) -> DataFrame:
    """Every pair of blocks of each node (node, rep, comp, size), as a node of its own, but
    pairs within the node's largest class; ``side`` is the block, or -1 where a block
    is paired with itself."""
    classes = big.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = classes.groupBy("node").agg(F.max(F.struct("n", "comp")).alias("most"))
    parts = lambda c: F.ceil(c / SPLIT).cast("long")
    numbered = big.join(most, "node").withColumns({"_rest": parts(F.col("size") - F.col("most.n")), "_own": parts(F.col("most.n")), "_in": F.col("comp") == F.col("most.comp")})
    side = F.when(F.col("_in"), F.col("_rest") + F.pmod(F.xxhash64("rep", F.lit(9)), F.col("_own"))).otherwise(F.pmod(F.xxhash64("rep", F.lit(9)), F.col("_rest")))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("_in"), F.col("_rest")).otherwise(F.col("_rest") + F.col("_own")) - 1)
    paired = numbered.withColumn("side", side).withColumn("other", F.explode(others))
    named = paired.withColumn("node", F.xxhash64("node", F.least("side", "other"), F.greatest("side", "other")))
    return named.withColumn("side", F.when(F.col("side") == F.col("other"), -1).otherwise(F.col("side"))).drop("size", "most", "_rest", "_own", "_in", "other")


def similar_classes(docs: DataFrame, reps: DataFrame, k: int, share: int) -> DataFrame:
    """(id, root) of the linked ones of representatives (rep, doc_id, text_hash, n,
    steps, sketch)."""
    small, great = walk(reps)
    sketches = reps.select("rep", "n", "sketch")
    maybe = materialize(small_pairs(small.join(sketches, "rep")), "maybe")
    chunked = great.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(5)), F.ceil(F.col("size") / LIMIT)).cast("long"))
    close = close_pairs(chunked.join(sketches, "rep"), ["node", "chunk"])
    first = materialize(maybe.filter("close").select("a", "b").unionByName(close).distinct(), "pairs")
    roots = components(confirm(first, docs, reps, k, share))

    # second round: pairs across the classes of the first
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    rest = maybe.filter("NOT close").join(of("a"), "a", "left").join(of("b"), "b", "left")
    found = rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    named = great.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root", "size")
    several = named.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").drop("lo", "hi")
    mixed = materialize(named.join(several, "node"), "mixed")
    if not mixed.isEmpty():
        carried = materialize(sketches.join(packed_sets(texts_of(docs, reps, mixed.select("rep").distinct()), k, short=True), "rep"), "carried")
        whole = mixed.filter(F.col("size") <= LIMIT).drop("size").withColumn("side", F.lit(-1).cast("long"))
        blocks = block_pairs(mixed.filter(F.col("size") > LIMIT))
        for part in (whole, blocks.filter("side = -1"), blocks.filter("side >= 0")):
            found = found.unionByName(cross_pairs(part.join(carried, "rep"), ["node"], share))
    fresh = materialize(found.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    if fresh.isEmpty():
        return roots
    # links between classes join their roots
    more = confirm(fresh, docs, reps, k, share)
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tops = components(joined)
    up = tops.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
    moved = roots.join(up, F.col("root") == F.col("_i"), "left").select("id", F.coalesce("_r", "root").alias("root"))
    return moved.unionByName(tops.join(roots, "id", "left_anti").select("id", "root"))


def classes_of(docs: DataFrame, k: int = 5, share: int = 80) -> DataFrame:
    """(doc_id, text_hash, n, component_id, chosen) of documents (doc_id, text): the
    size of each one's set, the smallest id of its component, and whether the row's
    text is the one that stands for it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(signatures(docs, k), "signatures")
    by_set = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2")
    first = F.struct("doc_id", "text_hash")
    reps = materialize(by_set.agg(F.min(first).alias("x"), F.min_by(F.struct("steps", "sketch"), first).alias("y")).select("n", "s1", "s2", "x.*", "y.*", F.monotonically_increasing_id().alias("rep")), "reps")
    roots = similar_classes(docs, reps, k, share)
    rooted = reps.select("n", "s1", "s2", "rep", F.struct("doc_id", "text_hash").alias("own")).join(roots, F.col("rep") == F.col("id"), "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = materialize(rooted.select("n", "s1", "s2", "own", "root"), "rooted")
    least = rooted.groupBy("root").agg(F.min("own").alias("least"))
    labels = rooted.join(least, "root").select("n", "s1", "s2", "least")
    out = signed.select("doc_id", "text_hash", "n", "s1", "s2").join(labels, ["n", "s1", "s2"], "left")
    alone = F.coalesce(F.struct("doc_id", "text_hash") == F.col("least"), F.lit(True))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("least.doc_id"), F.col("doc_id")))
    return out.select("doc_id", "text_hash", "n", component.alias("component_id"), (F.col("doc_id").isNull() | alone).alias("chosen"))


def near_duplicates(docs: DataFrame, k: int = 5, share: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text) whose
    sets of ``k``-word shingles have a similarity of ``share`` percent."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return classes_of(docs, k, share).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
