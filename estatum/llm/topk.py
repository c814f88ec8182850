"""Exact top-k inner products by block-at-a-time pruning.

Vectors are documents: entry i, as the integer floor(256 x), is the weight of term i, and
a negative one that of the term's opposite.  Documents are dealt by ranges of their
strongest terms and cut into blocks of up to BLOCK documents; a block's row holds its
forward index (a matrix of weights), the greatest weight of each term and its opposite,
and its least id.  A shard is so many blocks that their indexes take about SHARD bytes.

A query's bound on a block is the sum of its weights times the term maxima.  In the
first wave each query visits the shard of its greatest bound, which gives it a k-th
score; in the second the shards whose bounds don't fall below that (or tie with it and
hold a smaller id).  In a shard a query takes blocks in falling order of bound, a few and
then more, and stops when bounds fall below its k-th score.  Nothing is lost: bounds
are true, so the pruning is safe, and where vectors have no structure (bounds of all
blocks over the k-th score) all blocks are scored, as matrix products.

Queries are packed by ranges too, so those that visit a shard travel as a row for so
many of them, and a shard's blocks are copied once for each lot of LOT such rows.

Null ids and vectors, and vectors with null or non-finite entries, take no part.  An
entry missing in a shorter vector weighs 0; empty and zero vectors score 0 against all.
Rows of a query's own id are not its candidates; other repeated rows are candidates
each, and rows of one id that are queries get results each.  Ties go to the smaller id.
An empty table gives no rows; extra columns are ignored.  Sums are exact: in doubles
where they stay below 2**53, in Python's integers beyond, and scores past a long's
range count as its ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estatum.llm.common import materialize, table
from estatum.operators import stats

SCALE = 256
#: Documents of a block; bytes of a shard's indexes and of a row of queries; most queries of such a row.
BLOCK, SHARD, QUERIES, MOST = 64, 2 << 20, 128 << 10, 1024
#: Rows of queries that meet one copy of a shard; shards whose maxima meet a row of queries at once.
LOT, CHUNK = 16, 2048
#: Strongest terms that documents are ordered by; first blocks that a query takes in a shard, and how the number grows.
STRONG, FIRST, GROWTH = 4, 4, 4
BLOCKS = "shard long, block long, n int, dim int, ids binary, index binary, maxima array<double>, least long"
ASKED = "number long, lot long, shard long, n int, dim int, places binary, ids binary, index binary, kth binary, kth_id binary"
FOUND = "number long, place int, query_id long, vec_id long, score long"
NONE, LONG = np.iinfo(np.int64).min, 2**63 - 1


def names(ddl: str) -> list[str]:
    return [x.split(" ")[0] for x in ddl.split(", ")]


def weighted(vectors: DataFrame) -> DataFrame:
    """(vec_id, w, strong): weights, and the names of the strongest terms in order."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))

    def run(frames):
        for f in frames:
            w = [np.floor(SCALE * np.asarray(x, np.float64)) if x is not None else np.zeros(0) for x in f["v"]]
            strong = [np.argsort(-np.abs(x), kind="stable")[:STRONG] for x in w]
            named = [(2 * s + (x[s] < 0)).astype(np.int32) for x, s in zip(w, strong, strict=True)]
            yield pd.DataFrame({"vec_id": f["vec_id"], "w": w, "strong": named})

    return rows.mapInPandas(run, "vec_id long, w array<double>, strong array<int>")


def to_bytes(m: np.ndarray) -> bytes:
    """A matrix of weights in two bytes an entry where they fit, else in eight."""
    return m.astype("<i2").tobytes() if np.abs(m).max(initial=0) <= 32767 else m.astype("<f8").tobytes()


def to_matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    if not n * dim:
        return np.zeros((n, dim))
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * n * dim else "<f8").reshape(n, dim).astype(np.float64)


def stacked(weights: list) -> np.ndarray:
    dim = max(map(len, weights), default=0)
    out = np.zeros((len(weights), dim))
    for i, w in enumerate(weights):
        out[i, : len(w)] = w
    return out


def dealt(rows: DataFrame) -> DataFrame:
    order = ["strong", "vec_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())


def blocks_of(rows: DataFrame) -> DataFrame:
    """BLOCKS of (vec_id, w, strong), in ranges of the strongest terms."""

    def run(frames):
        held, weight, shard, block, part = [], 0, 0, 0, 0

        def made():
            ids, w = np.array([i for i, _ in held], np.int64), stacked([x for _, x in held])
            maxima = np.concatenate([w.max(axis=0), (-w).max(axis=0)])
            return (part << 32) + shard, block, len(ids), w.shape[1], ids.astype("<i8").tobytes(), to_bytes(w), maxima, int(ids.min())

        for f in frames:
            out = []
            for i, w in zip(f["vec_id"].tolist(), f["w"], strict=True):
                if len(held) == BLOCK:
                    out.append(made())
                    weight, block, held = weight + len(out[-1][5]), block + 1, []
                    if weight >= SHARD:
                        shard, weight = shard + 1, 0
                held.append((i, w))
            part = int(f["part"].iloc[0]) if len(f) else part
            yield pd.DataFrame(out, columns=names(BLOCKS))
        if held:
            yield pd.DataFrame([made()], columns=names(BLOCKS))

    return dealt(rows).select("vec_id", "w", "part").mapInPandas(run, BLOCKS)


def numbered(queries: DataFrame) -> DataFrame:
    """(query_id, w, number, place): queries with the row of queries they travel in."""

    def run(frames):
        number, place, size = 0, 0, 0
        for f in frames:
            at = []
            for w in f["w"]:
                if place == MOST or size >= QUERIES:
                    number, place, size = number + 1, 0, 0
                at.append((number, place))
                place, size = place + 1, size + 2 * len(w)
            part = int(f["part"].iloc[0]) if len(f) else 0
            yield pd.DataFrame({"query_id": f["vec_id"], "w": f["w"], "number": [(part << 32) + n for n, _ in at], "place": pd.array([p for _, p in at], "int32")})

    return dealt(queries).mapInPandas(run, "query_id long, w array<double>, number long, place int")


def doubled(q: np.ndarray, dim: int) -> np.ndarray:
    """Weights of terms and of opposites, as far as documents of ``dim`` entries go."""
    out = np.zeros((len(q), dim))
    m = min(dim, q.shape[1])
    out[:, :m] = q[:, :m]
    return np.concatenate([np.maximum(out, 0), np.maximum(-out, 0)], axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers: doubles below 2**53, Python's integers beyond, cut to a
    long's range."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    big = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(big(a) @ big(b).T, -LONG, LONG).astype(np.int64)


class Asked:
    """A row of queries."""

    def __init__(self, r):
        self.number, self.n = r.number, r.n
        self.places, self.ids = np.frombuffer(r.places, "<i4"), np.frombuffer(r.ids, "<i8")
        self.kth, self.kth_id = np.frombuffer(r.kth, "<i8").copy(), np.frombuffer(r.kth_id, "<i8").copy()
        self.w = to_matrix(r.index, r.n, r.dim)

    def some(self, at: np.ndarray) -> tuple:
        w = self.w[at]
        return len(at), w.shape[1], self.places[at].tobytes(), self.ids[at].tobytes(), to_bytes(w), self.kth[at].tobytes(), self.kth_id[at].tobytes()


def bounds(q: Asked, maxima: list, least: np.ndarray) -> np.ndarray:
    """Bounds of a row of queries on blocks or shards, LONG's opposite where none can be
    of use; blocks may differ in length."""
    out = np.zeros((q.n, len(maxima)), np.int64)
    dims = np.array([len(m) // 2 for m in maxima])
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        out[:, at] = product(doubled(q.w, d), np.stack([maxima[i] for i in at])) if d else 0
    useless = (out < q.kth[:, None]) | ((out == q.kth[:, None]) & (least[None, :] > q.kth_id[:, None]))
    return np.where(useless, NONE, out)


def visit(q: Asked, blocks: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the ``k`` best documents of a shard for each query of a row,
    as far as they can be among its best of all."""
    least = np.array([b.least for b in blocks])
    limit = bounds(q, [np.asarray(b.maxima) for b in blocks], least)
    order = np.argsort(-limit, axis=1, kind="stable")
    best = tuple(np.zeros(0, np.int64) for _ in range(3))
    at, width, index = 0, FIRST, {}
    while at < len(blocks):
        # the next blocks of each query, those whose bounds haven't fallen below its k-th score
        mine = np.zeros(limit.shape, bool)
        np.put_along_axis(mine, order[:, at : at + width], True, axis=1)
        mine &= (limit > NONE) & ((limit > q.kth[:, None]) | ((limit == q.kth[:, None]) & (least[None, :] <= q.kth_id[:, None])))
        if not mine.any():
            break
        got = [best]
        for j in np.flatnonzero(mine.any(axis=0)):
            b, who = blocks[j], np.flatnonzero(mine[:, j])
            if j not in index:
                index[j] = np.frombuffer(b.ids, "<i8"), to_matrix(b.index, b.n, b.dim)
            ids, w = index[j]
            m = min(b.dim, q.w.shape[1])
            score = product(q.w[who][:, :m], w[:, :m])
            i, c = np.nonzero((score >= q.kth[who][:, None]) & (ids[None, :] != q.ids[who][:, None]))
            got.append((who[i], ids[c], score[i, c]))
        who, ids, score = (np.concatenate(x) for x in zip(*got, strict=True))
        sort = np.lexsort((ids, -score, who))
        who, ids, score = who[sort], ids[sort], score[sort]
        rank = np.arange(len(who)) - np.searchsorted(who, who, side="left")
        best = who[rank < k], ids[rank < k], score[rank < k]
        last = rank == k - 1
        better = (score[last] > q.kth[who[last]]) | ((score[last] == q.kth[who[last]]) & (ids[last] < q.kth_id[who[last]]))
        q.kth[who[last][better]], q.kth_id[who[last][better]] = score[last][better], ids[last][better]
        at, width = at + width, width * GROWTH
    return best


def rows_of(queries: DataFrame, kth: DataFrame | None) -> DataFrame:
    """ASKED rows of numbered queries, with the k-th score that each has so far."""
    if kth is None:
        queries = queries.withColumns({"kth": F.lit(NONE), "kth_id": F.lit(LONG)})
    else:
        queries = queries.join(kth, ["number", "place"], "left").withColumns({"kth": F.coalesce("kth", F.lit(NONE)), "kth_id": F.coalesce("kth_id", F.lit(LONG))})

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place")
        w, raw = stacked(list(f["w"])), lambda c, t: f[c].to_numpy(t).tobytes()
        row = (int(f["number"].iloc[0]), 0, 0, len(f), w.shape[1], raw("place", "<i4"), raw("query_id", "<i8"), to_bytes(w), raw("kth", "<i8"), raw("kth_id", "<i8"))
        return pd.DataFrame([row], columns=names(ASKED))

    return queries.groupBy("number").applyInPandas(pack, ASKED)


def shards_of(blocks: DataFrame) -> DataFrame:
    """(shard, maxima, least): the term maxima of all blocks of a shard."""

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        d = max(len(m) // 2 for m in f["maxima"])
        parts = np.stack([np.concatenate([np.pad(x, (0, d - len(x))) for x in np.split(np.asarray(m, np.float64), 2)]) for m in f["maxima"]])
        return pd.DataFrame({"shard": f["shard"].iloc[:1], "maxima": [parts.max(axis=0)], "least": [int(f["least"].min())]})

    return blocks.select("shard", "maxima", "least").groupBy("shard").applyInPandas(whole, "shard long, maxima array<double>, least long")


def dealt_over(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("long")


def routed(asked: DataFrame, shards: DataFrame, lots: int, chunks: int, first: bool) -> DataFrame:
    """Rows of queries for each shard that some of them visit: of every chunk of shards
    the one of the greatest bound in the first wave, all others that may be of use in
    the second."""

    def route(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, right = [], right.sort_values("shard")
        shard, maxima, least = right["shard"].tolist(), [np.asarray(m) for m in right["maxima"]], right["least"].to_numpy(np.int64)
        for r in left.itertuples() if len(right) else ():
            q, free = Asked(r), Asked(r)
            free.kth[:], free.kth_id[:] = NONE, LONG
            top = bounds(free, maxima, least).argmax(axis=1)
            use = np.zeros((q.n, len(shard)), bool) if first else bounds(q, maxima, least) > NONE
            use[np.arange(q.n), top] = first
            out += [(q.number, r.lot, shard[j], *q.some(np.flatnonzero(use[:, j]))) for j in np.flatnonzero(use.any(axis=0))]
        return pd.DataFrame(out, columns=names(ASKED))

    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.withColumn("lot", dealt_over("number", lots)).withColumn("chunk", spread(chunks))
    right = shards.withColumn("chunk", dealt_over("shard", chunks)).withColumn("lot", spread(lots))
    return left.groupBy("lot", "chunk").cogroup(right.groupBy("lot", "chunk")).applyInPandas(route, ASKED)


def visited(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """FOUND of rows of queries in the shards that they are for."""

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=names(FOUND)).astype({c: "int64" for c in names(FOUND)})]
        here = list(right.sort_values("block").itertuples())
        for r in left.sort_values("number").itertuples():
            q = Asked(r)
            who, ids, score = visit(q, here, k)
            out.append(pd.DataFrame({"number": q.number, "place": q.places[who], "query_id": q.ids[who], "vec_id": ids, "score": score}))
        return pd.concat(out)

    wanted = asked.select(F.col("shard").alias("_shard"), F.col("lot").alias("_lot")).distinct()
    copies = blocks.join(wanted, F.col("shard") == F.col("_shard")).withColumnRenamed("_lot", "lot").drop("_shard")
    return asked.groupBy("shard", "lot").cogroup(copies.groupBy("shard", "lot")).applyInPandas(search, FOUND)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) that meet
    ``is_query``, against all rows."""
    rows = weighted(vectors)
    blocks = materialize(blocks_of(rows), "blocks")
    queries = materialize(numbered(rows.filter(is_query)), "queries")
    shards = materialize(shards_of(blocks), "shards")
    asked = materialize(rows_of(queries, None), "asked")
    lots, chunks = (max(1, -(-n // size)) for n, size in ((asked.count(), LOT), (shards.count(), CHUNK)))
    first = materialize(visited(materialize(routed(asked, shards, lots, chunks, True), "routed"), blocks, k), "found")
    keys, order = ["number", "place"], [F.desc("score"), F.asc("vec_id")]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kth = first.withColumn("rank", nth).filter(F.col("rank") == k).select(*keys, F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
    later = routed(materialize(rows_of(queries, kth), "asked"), shards, lots, chunks, False)
    found = first.unionByName(visited(materialize(later, "routed"), blocks, k))
    best = stats.last_n_per_key(found, keys, order, k)
    return best.withColumn("rank", nth).select("query_id", "rank", "vec_id", "score")


def op11_topk(spark, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
