"""Prefix trie of conversations by double-array tries of prefix shards.

A turn is the digest of its role and text (16 bytes of SHA-256), so no text is sorted
or joined.  Turns are dealt by ranges of (conversation, turn), so a conversation of any
length is many tasks' work, and packed into rows of up to SEGMENT turns; a longer
conversation goes on in further bands of SEGMENT turns, each below the digest of all
turns before it.  Equal segments below one prefix are one row from then on, with their
number, so common conversations cost no more than rare ones.

Distinct segments are dealt by ranges of their digests: neighbours share prefixes.
Each task cuts its range into shards of about SHARD turns.  In a shard digests become
dense ids, BASE and CHECK are packed over them (groups of siblings by first fit, the
largest first, only children into the cells left), and walking all segments through the
arrays sums what every node has.  Only nodes on a shard's last path, or on what its
first path shares with the shard before, can be other shards' too: their sums are keyed
by a digest of their path and added up globally.  All sums add up, because a shard
counts a node for its ancestors only if the shard before doesn't hold it.

Null conversation ids take no part; null roles and texts are empty.  Turns of one
number (nulls first) are ordered by digest, repeated rows are turns each.  Remainders
of negative ids have their sign, as in SQL.  An empty table gives no rows; extra columns
are ignored.  Turns are told apart by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estatum.llm.common import materialize, table

#: Turns of a row, and of a shard's double array (about; one more row at most).
SEGMENT, SHARD = 4096, 200_000
#: Bytes of a turn's digest; turns that a conversation may take over from another.
WIDE, HEADS = 16, 5
#: Characters of a piece of a node's list of ids.
PIECE = 1 << 20
#: Cells that first fit tries for a group of siblings before it takes new ones.
TRIES = 256
PIECES = "conv_id long, part int, start long, n long, path binary, lens array<int>"
NODES = "shard long, split boolean, key binary, parent_key binary, prefix binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, chars long, distinct_chars long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def names(ddl: str) -> list[str]:
    return [x.split(" ")[0] for x in ddl.split(", ")]


def short_digest(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * WIDE))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars) of a table of turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = short_digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).alias("chars")).filter("conv_id IS NOT NULL")


def packed(rows: DataFrame, most: int) -> DataFrame:
    """PIECES: turns in order, as one row for each run of a conversation in a task's
    range, of up to ``most`` turns; ``start`` counts within the range."""
    order = ["conv_id", "turn", "digest"]

    def run(frames):
        conv, part, start, path, lens, held = None, 0, 0, [], [], 0

        def piece():
            return conv, part, start, held, b"".join(path), np.concatenate(lens)

        for f in frames:
            out, ids = [], f["conv_id"].to_numpy(np.int64)
            if not len(ids):
                continue
            digests, chars, part = f["digest"].tolist(), f["chars"].to_numpy(np.int32), int(f["part"].iloc[0])
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:], strict=False):
                if ids[a] != conv:
                    if held:
                        out.append(piece())
                    conv, start, path, lens, held = int(ids[a]), 0, [], [], 0
                while a < b:
                    if held == most:
                        out.append(piece())
                        start, path, lens, held = start + held, [], [], 0
                    to = min(b, a + most - held)
                    path += digests[a:to]
                    lens.append(chars[a:to])
                    held, a = held + to - a, to
            yield pd.DataFrame(out, columns=names(PIECES))
        if held:
            yield pd.DataFrame([piece()], columns=names(PIECES))

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("conv_id", "digest", "chars", F.spark_partition_id().alias("part")).mapInPandas(run, PIECES)


def rebuilt(pieces: DataFrame) -> DataFrame:
    """(conv_id, at, path, lens, bands-to-be's total) of the conversations after the
    first turns of another were put in place of their own."""
    meta, own = pieces.select("conv_id", "part", "start", "n"), Window.partitionBy("conv_id")
    before = own.orderBy("part", "start").rowsBetween(Window.unboundedPreceding, -1)
    placed = meta.select("conv_id", "part", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), F.sum("n").over(own).alias("total"))
    placed = pieces.join(placed, ["conv_id", "part", "start"]).select("conv_id", "at", "n", "total", "path", "lens")
    near = placed.filter((F.col("conv_id") % 100 == 0) & (F.col("at") < HEADS))
    few = F.array_sort(F.collect_list(F.struct("at", F.substring("path", F.lit(1), (HEADS - F.col("at")).cast("int") * WIDE).alias("p"), F.slice("lens", F.lit(1), (HEADS - F.col("at")).cast("int")).alias("l"))))
    heads = near.groupBy(F.col("conv_id").alias("_base")).agg(few.alias("h")).select("_base", joined_parts("h", "p").alias("_path"), F.flatten(F.transform("h", lambda x: x["l"])).alias("_lens"))
    h = F.crc32(F.col("conv_id").cast("string")) % (HEADS + 1)
    wide = placed.withColumn("h", h.cast("int")).join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_base"), "left")
    head = F.coalesce(F.substring("_path", F.lit(1), F.col("h") * WIDE), F.lit("").cast("binary"))
    wide = wide.withColumns({"head": head, "cut": F.greatest(F.col("h") - F.col("at"), F.lit(0)).cast("int"), "heads": (F.length(head) / WIDE).cast("int")})
    first, none = F.col("at") == 0, F.array().cast("array<int>")
    own_path = F.substring("path", F.col("cut") * WIDE + 1, F.length("path"))
    own_lens = F.slice("lens", F.col("cut") + 1, F.size("lens"))
    out = wide.select(
        "conv_id", F.when(first, 0).otherwise(F.greatest("at", "h") - F.col("h") + F.col("heads")).cast("long").alias("at"),
        F.when(first, F.concat("head", own_path)).otherwise(own_path).alias("path"),
        F.when(first, F.concat(F.coalesce(F.slice("_lens", F.lit(1), F.col("heads")), none), own_lens)).otherwise(own_lens).alias("lens"),
        (F.col("heads") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("total"),
    )
    return out.filter((F.col("at") == 0) | (F.size("lens") > 0))


def joined_parts(column: str, field: str) -> Column:
    """The binary fields of an array of structs, one behind the other."""
    return F.aggregate(column, F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x[field]))


def segments(pieces: DataFrame, most: int) -> DataFrame:
    """(conv_id, band, path, lens, total): rebuilt conversations cut at multiples of
    ``most`` turns.  A segment is put together from at most as many pieces as it has turns."""
    end = F.col("at") + F.size("lens")
    spread = pieces.withColumn("band", F.explode(F.sequence(F.floor(F.col("at") / most), F.floor(F.greatest(end - 1, F.col("at")) / most))))
    lo, hi = F.greatest("at", F.col("band") * most), F.least(end, (F.col("band") + 1) * most)
    skip, n = (lo - F.col("at")).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")
    cut = spread.select("conv_id", "band", "total", F.struct(lo.alias("at"), F.substring("path", skip * WIDE + 1, n * WIDE).alias("p"), F.slice("lens", skip + 1, n).alias("l")).alias("x"))
    whole = cut.groupBy("conv_id", "band").agg(F.max("total").alias("total"), F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select("conv_id", "band", "total", joined_parts("x", "p").alias("path"), F.flatten(F.transform("x", lambda x: x["l"])).alias("lens"))


def chained(segs: DataFrame, most: int) -> DataFrame:
    """Segments with ``prefix`` (what all turns before are called; zeros at band 0),
    ``next_prefix`` where they are full, ``after`` (code points of later segments) and
    ``last``."""
    digit = F.sha2(F.concat(F.col("band").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("path")), 256)
    number = lambda i: F.conv(F.substring(digit, i, 15), 16, 10).cast("decimal(38,0)")
    name = lambda a, b: short_digest(F.concat_ws(",", a.cast("string"), b.cast("string")))
    zeros, full = F.unhex(F.lit("00" * WIDE)), F.size("lens") == most
    one = segs.filter(F.col("total") <= most).select("conv_id", "band", "path", "lens", zeros.alias("prefix"), F.when(full, name(number(1), number(16))).alias("next_prefix"), F.lit(0).cast("long").alias("after"), F.lit(True).alias("last"))
    # longer conversations: a row a segment, without its turns, is summed in order
    long = segs.filter(F.col("total") > most)
    chars = F.aggregate("lens", F.lit(0).cast("long"), lambda acc, x: acc + x)
    narrow = long.select("conv_id", "band", full.alias("full"), number(1).alias("a"), number(16).alias("b"), chars.alias("chars"), ((F.col("band") + 1) * most >= F.col("total")).alias("last"))
    up, down = (Window.partitionBy("conv_id").orderBy(o) for o in (F.asc("band"), F.desc("band")))
    upto, rest = up.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    a, b = F.sum("a").over(upto), F.sum("b").over(upto)
    known = narrow.select("conv_id", "band", "last", F.when(F.col("band") == 0, zeros).otherwise(name(a - F.col("a"), b - F.col("b"))).alias("prefix"), F.when(F.col("full"), name(a, b)).alias("next_prefix"), F.coalesce(F.sum("chars").over(rest), F.lit(0)).alias("after"))
    return one.unionByName(long.select("conv_id", "band", "path", "lens").join(known, ["conv_id", "band"]))


def ids_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): the digest of a key's ids in order, joined by
    commas.  Ids are dealt by ranges and joined to pieces of text; only these stream, in
    order, through the one task of their key."""

    def pieces(frames):
        key, first, held, size = None, 0, [], 0
        for f in frames:
            out = []
            for k, c in zip(f["key"], f["conv_id"].tolist(), strict=True):
                if k != key or size > PIECE:
                    if held:
                        out.append((key, first, ",".join(held)))
                    key, first, held, size = k, c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            yield pd.DataFrame(out, columns=["key", "first", "ids"])
        if held:
            yield pd.DataFrame([(key, first, ",".join(held))], columns=["key", "first", "ids"])

    def digests(frames):
        key, state = None, None
        for f in frames:
            out = []
            for k, text in zip(f["key"], f["ids"], strict=True):
                if k != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])

    joined = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInPandas(pieces, "key string, first long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "first").mapInPandas(digests, "key string, ends_sha256 string")


def double_array(parent: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(BASE, CHECK, cell of each node) of a trie whose node i > 0 is reached from
    ``parent[i]`` by ``code[i]``; node 0 is the root, in cell 0.  Groups of siblings are
    in order of code."""
    n = len(parent)
    kids = 1 + np.argsort(parent[1:], kind="stable")
    heads, sizes = np.unique(parent[kids], return_index=True)[1], np.bincount(parent[1:], minlength=n)
    sizes = sizes[parent[kids[heads]]] if n > 1 else np.zeros(0, np.int64)
    used = np.zeros(2 * n + 64 + int(code.max(initial=0)), bool)
    used[0], low, top = True, 1, 1
    cell, base_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for g in np.argsort(-sizes, kind="stable"):
        if sizes[g] < 2:
            break
        group = kids[heads[g] : heads[g] + sizes[g]]
        offs = code[group] - code[group[0]]
        tries = np.flatnonzero(~used[low : low + 8 * TRIES])[: max(1, min(TRIES, (1 << 22) // len(offs)))] + low
        need = int(tries[-1] + offs[-1] + 1) if len(tries) else 0
        need = max(need, top + int(offs[-1]) + 1)
        if need > len(used):
            used = np.concatenate([used, np.zeros(max(need - len(used), len(used)), bool)])
        fits = np.flatnonzero(~used[tries[:, None] + offs].any(axis=1)) if len(tries) else []
        at = int(tries[fits[0]]) if len(fits) else top
        used[at + offs] = True
        cell[group], base_of[parent[group[0]]] = at + offs, at - code[group[0]]
        top = max(top, at + int(offs[-1]) + 1)
        if len(tries) and not len(fits):
            low = int(tries[len(tries) // 2])  # crowded cells are left to only children
    only = kids[heads[sizes == 1]]
    free = np.flatnonzero(~used)[: len(only)]
    if len(free) < len(only):
        free = np.concatenate([free, np.arange(len(used), len(used) + len(only) - len(free))])
    cell[only], base_of[parent[only]] = free, free - code[only]
    cells = int(cell.max(initial=0)) + 1
    base, check = np.zeros(cells, np.int64), np.full(cells, -1, np.int64)
    base[cell], check[cell[1:]] = base_of, cell[parent[1:]]
    return base, check, cell


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDE
    return int(np.flatnonzero(np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8))[0]) // WIDE


def shard_nodes(rows: pd.DataFrame, shard: int, band: int, most: int, shared: int, before: int) -> pd.DataFrame:
    """NODES of one shard: rows (way, lens, n, low, after, ...) in order of way, of whose
    first the shard before has ``shared`` turns on its last way, ``before`` turns long."""
    ways, lens = rows["way"].tolist(), [np.asarray(x, np.int64) for x in rows["lens"]]
    size = np.array([len(w) // WIDE for w in ways])
    off = np.concatenate([[0], np.cumsum(size)[:-1]])
    codes = np.unique(np.frombuffer(b"".join(ways), f"V{WIDE}"), return_inverse=True)[1].reshape(-1).astype(np.int64) + 1
    flat = np.concatenate([np.concatenate([[0], x]) for x in lens])  # the first of a way names its prefix
    # nodes, as the ways make them in order
    total = int(size.sum()) + 1
    parent, code, chars, depth = (np.zeros(total, np.int64) for _ in range(4))
    stack, ends, made, prior = np.zeros(int(size.max()) + 1, np.int64), np.zeros(len(ways), np.int64), 1, None
    first_path = last_path = stack[:0]
    for r, (o, m) in enumerate(zip(off.tolist(), size.tolist(), strict=True)):
        same = 0 if prior is None else common(prior, ways[r])
        new = np.arange(made, made + m - same)
        parent[new] = np.concatenate([[stack[same - 1] if same else 0], new[:-1]])[: len(new)]
        code[new], chars[new], depth[new] = codes[o + same : o + m], flat[o + same : o + m], np.arange(same, m)
        stack[same:m] = new
        made, prior, ends[r] = made + len(new), ways[r], stack[m - 1]
        first_path = stack[:m].copy() if r == 0 else first_path
        last_path = stack[:m]
    parent, code, chars, depth = parent[:made], code[:made], chars[:made], depth[:made]
    base, check, cell = double_array(parent, code)
    # every way walks through the arrays, level by level
    n, low, after = (rows[c].to_numpy(np.int64) for c in ("n", "low", "after"))
    run = np.concatenate([[0], np.cumsum(flat)])
    left = run[np.repeat(off + size, size)] - run[:-1]
    members, least, text = np.zeros(len(base), np.int64), np.full(len(base), np.iinfo(np.int64).max), np.zeros(len(base), np.int64)
    here, by_size = np.zeros(len(ways), np.int64), np.argsort(-size, kind="stable")
    longer = np.searchsorted(-size[by_size], -np.arange(int(size.max())), side="left")
    for d, k in enumerate(longer.tolist()):
        r = by_size[:k]
        to = base[here[r]] + codes[off[r] + d]
        if not np.array_equal(check[to], here[r]):
            raise AssertionError("a way leaves the double array")
        here[r] = to
        np.add.at(members, to, n[r])
        np.minimum.at(least, to, low[r])
        np.add.at(text, to, n[r] * left[off[r] + d] + after[r])
    members, least, text = members[cell], least[cell], text[cell]
    # what subtrees sum; the shard before counts what it holds too
    owned = np.ones(made, bool)
    owned[0] = owned[first_path[:shared]] = False
    children = np.bincount(parent[1:][owned[1:]], minlength=made)
    childless = np.bincount(parent[1:], minlength=made) == 0
    childless[0] = False
    distinct, leaves = np.where(owned, chars, 0), (childless & owned).astype(np.int64)
    deep = rows[["deep_children", "deep_leaves", "deep_chars"]].fillna(0).to_numpy(np.int64)
    on = deep[:, 0] > 0
    children[ends] += deep[:, 0]
    leaves[ends[on]] = deep[on, 1]
    distinct[ends] += deep[:, 2]
    if shared and shared == before:
        leaves[first_path[shared - 1]] -= 1  # the last of the shard before goes on here
    levels = np.argsort(depth[1:], kind="stable") + 1
    bounds = np.searchsorted(depth[levels], np.arange(int(depth.max()) + 2))
    for d in range(int(depth.max()), 0, -1):
        x = levels[bounds[d] : bounds[d + 1]]
        np.add.at(distinct, parent[x], distinct[x])
        np.add.at(leaves, parent[x], leaves[x])
    # nodes that other shards may have as well
    split, key = np.zeros(made, bool), np.full(made, None, object)
    for path, way in ((first_path[:shared], ways[0]), (last_path, ways[-1])):
        split[path] = True
        for i, node in enumerate(path.tolist()):
            key[node] = hashlib.sha256(b"%d:" % band + way[: WIDE * (i + 1)]).digest()[:WIDE]
    ended = np.full(made, None, object)
    ended[ends] = rows["ends_sha256"].to_numpy(object)
    above, tops = np.full(made, None, object), np.full(made, None, object)
    inner = depth >= 1
    above[inner & ~split[parent]] = least[parent[inner & ~split[parent]]]
    up = np.where(inner & split[parent], key[parent], None)
    is_top = np.flatnonzero(depth == 0)[1:]  # but the root of the array
    prefixes, lifts = {}, {}
    for node, way, lift in zip(stack_tops(ends, parent), ways, rows["top_low"], strict=True):
        prefixes[node], lifts[node] = way[:WIDE], lift
    tops[is_top] = [prefixes[x] for x in is_top.tolist()]
    if band:
        second = np.flatnonzero(depth == 1)
        above[second], up[second] = [int(lifts[x]) for x in parent[second].tolist()], None
    out = pd.DataFrame({"shard": shard, "split": split, "key": key, "parent_key": up, "prefix": tops, "conv_id": least, "depth": depth + band * most, "parent_conv_id": pd.array(above, "Int64"), "n_convs": members, "n_children": children, "n_leaves": leaves, "chars": text, "distinct_chars": distinct, "ends_sha256": ended})
    return out.iloc[1:]


def stack_tops(ends: np.ndarray, parent: np.ndarray) -> list[int]:
    """The ancestor just below the root of each node, by pointer doubling."""
    up = parent.copy()
    up[parent == 0] = np.flatnonzero(parent == 0)
    while not np.array_equal(up, up[up]):
        up = up[up]
    return up[ends].tolist()


def band_nodes(rows: DataFrame, band: int, most: int, shard: int) -> DataFrame:
    """NODES of the distinct segments of one band."""
    dealt = materialize(rows.repartitionByRange("way").withColumn("part", F.spark_partition_id()), "ways")
    edges = dealt.groupBy("part").agg(F.min("way").alias("first"), F.max("way").alias("last"))
    lag = F.lag("last").over(Window.orderBy("part"))  # a row a part

    def meet(frames):
        for f in frames:
            yield pd.DataFrame({"part": f["part"], "shared": [0 if b is None else common(a, b) for a, b in zip(f["first"], f["before"], strict=True)], "n": [0 if b is None else len(b) // WIDE for b in f["before"]]})

    known = {r.part: (r.shared, r.n) for r in edges.select("part", "first", lag.alias("before")).mapInPandas(meet, "part int, shared int, n int").collect()}

    def run(frames):
        held, turns, count, part, last, tail = [], 0, 0, None, b"", b""

        def flush():
            f = pd.concat(held)
            shared, before = (common(last, f["way"].iloc[0]), len(last) // WIDE) if last else known[part]
            return shard_nodes(f, (part << 24) + count, band, most, shared, before)

        for f in frames:
            ways, parts, start = f["way"].tolist(), f["part"].tolist(), 0
            for i, (way, p) in enumerate(zip(ways, parts, strict=True)):
                if p != part or turns >= shard:
                    if turns:
                        held.append(f.iloc[start:i])
                        yield flush()
                    last, count = (tail, count + 1) if p == part else (b"", 0)
                    held, turns, part, start = [], 0, p, i
                turns, tail = turns + len(way) // WIDE, way
            held.append(f.iloc[start:])
        if turns:
            yield flush()

    return materialize(dealt.repartition("part").sortWithinPartitions("part", "way").mapInPandas(run, NODES), "nodes")


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with the sums of those that several shards hold, and their parents' ids."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "chars", "distinct_chars")]
    parts = nodes.filter("split")
    whole = materialize(parts.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("ends_sha256").alias("ends_sha256"), *sums), "merged")
    lows = whole.select(F.col("key").alias("_key"), F.col("conv_id").alias("_low"))
    # a shard's own nodes meet their parents by shard: the root's many children are dealt
    here = parts.select(F.col("shard").alias("_shard"), F.col("key").alias("_k")).join(lows, F.col("_k") == F.col("_key")).select("_shard", "_key", "_low")
    columns = ["conv_id", "depth", F.coalesce("parent_conv_id", "_low").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("chars") - F.col("distinct_chars")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")]
    inner = nodes.filter("NOT split").join(here, (F.col("shard") == F.col("_shard")) & (F.col("parent_key") == F.col("_key")), "left").select(*columns)
    return inner.unionByName(whole.join(lows, F.col("parent_key") == F.col("_key"), "left").select(*columns))


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shard: int = SHARD) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    if segment < HEADS:
        raise ValueError(f"a segment needs {HEADS} turns at least")
    pieces = materialize(packed(turn_rows(conversations), segment), "pieces")
    segs = materialize(segments(rebuilt(pieces), segment), "segments")
    ways = chained(segs, segment).withColumn("way", F.concat("prefix", "path"))
    ways = ways.withColumn("key", F.sha2(F.concat(F.col("band").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("way")), 256))
    ends = ids_digests(ways.filter("last").select("key", "conv_id"))
    distinct = ways.groupBy("band", "key", "way", "lens", "next_prefix").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.sum("after").alias("after"))
    distinct = materialize(distinct.join(ends, "key", "left"), "distinct")
    bands, deep, out = distinct.agg(F.max("band")).first()[0], None, []
    for band in range(-1 if bands is None else bands, -1, -1):
        rows = distinct.filter(F.col("band") == band)
        counts = {"deep_children": "n_children", "deep_leaves": "n_leaves", "deep_chars": "distinct_chars"}
        if deep is None:
            rows = rows.withColumns({c: F.lit(0).cast("long") for c in counts})
        else:
            below = deep.groupBy(F.col("prefix").alias("_prefix")).agg(*[F.sum(v).alias(k) for k, v in counts.items()])
            rows = rows.join(below, F.col("next_prefix") == F.col("_prefix"), "left").drop("_prefix")
        if band:
            above = distinct.filter((F.col("band") == band - 1) & F.col("next_prefix").isNotNull()).select(F.col("next_prefix").alias("_above"), F.col("low").alias("top_low"))
            rows = rows.join(above, F.substring("way", 1, WIDE) == F.col("_above"), "left").drop("_above")
        else:
            rows = rows.withColumn("top_low", F.lit(None).cast("long"))
        made = band_nodes(rows.select("way", "lens", "n", "low", "after", *counts, "ends_sha256", "top_low"), band, segment, shard)
        deep = made.filter("prefix IS NOT NULL")
        out.append(merged_nodes(made if band == 0 else made.filter("prefix IS NULL")))
    if not out:
        return conversations.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def op13_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
