"""Approximate nearest neighbours by learned partitions.

On a bounded sample a graph of exact neighbours is cut into equal parts that
sever few edges; a small network learns to tell a vector's part.  There is a part for
every PER_PART rows, LEAST at least.  Beyond WIDE parts each part is cut again, by a
network of its own, fitted on a bounded sample of its rows, up to WIDE * WIDE leaves (33
million rows at PER_PART; then leaves grow).  Every vector is filed under its likeliest
leaf; a query visits as many of its likeliest leaves as the sample needs to reach the
target recall, and all vectors there are reranked by exact distance, in blocks of
bounded size.  A query whose leaves hold fewer than it asks for goes on to all others,
so none is short of neighbours that there are.

How much is visited depends on the vectors: a tenth where they lie in clusters, more
than half where all directions are alike and near ones hardly nearer than others.

Vectors that are null, zero, of another length than the sample's, or that hold
null or non-finite components take no part.  An empty table gives no rows.  Rows
of a query's own id are never its neighbours; ties go to the smaller id.  Repeated rows
are candidates each; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estatum.llm.common import empty_like, materialize, table

#: Vectors that the fit gathers on the driver at most, by hash of id.
SAMPLE = 4096
#: Rows to a part, parts at least, parts of one network, and recall on the sample that the
#: number of parts to visit is chosen for.
PER_PART, LEAST, WIDE, RECALL = 2048, 8, 128, 0.95
#: Rows of a rerank block: candidates, and queries; a candidate is copied once for so many queries of its part.
BLOCK, QUERIES = 4096, 2048
NEAREST = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(column)
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def knn(x: np.ndarray, k: int) -> np.ndarray:
    """Exact neighbours within a sample, by blocks of rows."""
    out, norms = np.empty((len(x), k), np.int64), (x * x).sum(1)
    for i in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[i : i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Parts of equal size: halves along principal axes first, then rounds in
    which nodes move to the part of most of their neighbours, best gains first,
    while it has room for 5 percent more than its share."""
    label = np.zeros(len(x), np.int64)
    for _ in range(int(np.log2(parts))):
        new = np.zeros_like(label)
        for p in np.unique(label):
            at = np.flatnonzero(label == p)
            c = x[at] - x[at].mean(0)
            axis = np.linalg.svd(c, full_matrices=False)[2][0] if len(at) > 1 else np.ones(x.shape[1])
            rank = np.argsort(np.argsort(c @ axis, kind="stable"), kind="stable")
            new[at] = 2 * p + (rank >= (len(at) + 1) // 2)
        label = new
    room = int(np.ceil(1.05 * len(x) / parts))
    back = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()]), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])], axis=1)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (back[0], label[back[1]]), 1.0)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """One hidden layer that tells a vector's part."""

    def __init__(self, x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 96, steps: int = 300, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        z, y = self._in(x), np.eye(parts)[label]
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(z), min(len(z), 1024))
            a = np.maximum(z[pick] @ p[0] + p[1], 0)
            o = a @ p[2] + p[3]
            o = np.exp(o - o.max(1, keepdims=True))
            g = (o / o.sum(1, keepdims=True) - y[pick]) / len(pick)
            h = (g @ p[2].T) * (a > 0)
            for k, d in enumerate((z[pick].T @ h, h.sum(0), a.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.parts = p, parts

    def _in(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of the parts."""
        p = self.p
        o = np.maximum(self._in(x) @ p[0] + p[1], 0) @ p[2] + p[3]
        o -= o.max(axis=1, keepdims=True)
        return o - np.log(np.exp(o).sum(axis=1, keepdims=True))


class Tree:
    """A network over parts, and under each part perhaps one over its own."""

    def __init__(self, top: Router, below: dict[int, Router], wide: int):
        self.top, self.below, self.wide, self.probes = top, below, wide, 1
        self.leaves = top.parts * wide

    def filed(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        part = self.top.odds(x).argmax(axis=1)
        leaf = part * self.wide
        for p, router in self.below.items():
            at = np.flatnonzero(part == p)
            if len(at):
                leaf[at] += router.odds(x[at]).argmax(axis=1)
        return leaf

    def order(self, x: np.ndarray) -> np.ndarray:
        """All leaves by falling probability; a part without a network is its first leaf."""
        full = np.full((len(x), self.top.parts, self.wide), -np.inf)
        full[:, :, 0] = 0
        for p, router in self.below.items():
            full[:, p, : router.parts] = router.odds(x)
        full += self.top.odds(x)[:, :, None]
        return np.argsort(-full.reshape(len(x), -1), axis=1, kind="stable")


def fit(x: np.ndarray, parts: int, k: int = 10) -> Router:
    """A router over balanced parts of the neighbour graph of a sample."""
    x = x.astype(np.float64)
    parts = max(1, min(parts, 1 << int(np.log2(max(1, len(x) // 32)))))
    k = min(k, len(x) - 1)
    if parts == 1 or k < 1:
        return Router(x, np.zeros(len(x), np.int64), 1, steps=1)
    return Router(x, balanced_parts(x, knn(x, k), parts), parts)


def calibrate(tree: Tree, x: np.ndarray, k: int, recall: float) -> int:
    """Leaves that a query visits, so that on the sample it meets its neighbours."""
    k = min(k, len(x) - 1)
    if tree.leaves == 1 or k < 1:
        return 1
    x = x.astype(np.float64)
    graph, leaf = knn(x, k), tree.filed(x)
    met = np.zeros(tree.leaves)
    for i in range(0, len(x), 256):
        place = np.argsort(tree.order(x[i : i + 256]), axis=1)
        np.add.at(met, np.take_along_axis(place, leaf[graph[i : i + 256]], axis=1).ravel(), 1)
    return int(np.searchsorted(np.cumsum(met), recall * met.sum())) + 1


def deepened(rows: DataFrame, top: Router, wide: int, sample: int) -> Tree:
    """A tree of two levels: each part's network is fitted where a bounded sample of the
    part's rows meets."""
    tree = Tree(top, {}, wide)
    if wide == 1:
        return tree
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def part(frames):
        for f in frames:
            x = np.stack(f["v"].to_numpy()).astype(np.float64) if len(f) else np.empty((0, 1))
            yield f.assign(part=(shared.value.filed(x) // wide).astype("int32") if len(f) else np.zeros(0, "int32"))

    dealt = materialize(rows.mapInPandas(part, "vec_id long, v array<float>, part int"), "parts")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    drawn = dealt.join(F.broadcast(sizes), "part").filter(F.pmod(F.xxhash64("vec_id", "v", F.lit(12)), F.col("n")) < sample)

    def learn(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": f["part"].iloc[:1], "router": [pickle.dumps(fit(np.stack(f["v"].to_numpy()), wide))]})

    fitted = drawn.groupBy("part").applyInPandas(learn, "part int, router binary").collect()
    return Tree(top, {r.part: pickle.loads(bytes(r.router)) for r in fitted}, wide)


def rerank(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of each query of a block."""
    ids = rows["vec_id"].to_numpy(np.int64)
    x = np.stack(rows["v"].to_numpy()).astype(np.float64) if len(rows) else np.empty((0, 0))
    out = []
    if len(rows):
        for q, v in zip(queries["query_id"], queries["v"], strict=True):
            d = x - np.asarray(v, np.float64)
            score = np.sqrt((d * d).sum(1))
            other = np.flatnonzero(ids != q)
            if len(other) > k:
                bound = np.partition(score[other], k - 1)[k - 1]
                other = other[score[other] <= bound]
            best = other[np.lexsort((ids[other], score[other]))[:k]]
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, is_query, k: int = 10, parts: int | None = None, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) that
    meet ``is_query``, against all rows."""
    spark = vectors.sparkSession
    rows = usable(vectors.select("vec_id", F.col("embedding").alias("v")).filter("vec_id IS NOT NULL"), "v")
    drawn = rows.select("v", F.xxhash64("vec_id", F.lit(11)).alias("_h"), "vec_id").orderBy("_h", "vec_id").limit(sample).collect()
    if not drawn:
        return empty_like(spark, "query_id long, rank int, vec_id long, score double")
    dim = int(np.bincount([len(r.v) for r in drawn]).argmax())
    rows = rows.filter(F.size("v") == dim)
    x = np.array([r.v for r in drawn if len(r.v) == dim])
    want = parts or max(LEAST, 1 << max(0, -(-rows.count() // PER_PART) - 1).bit_length())
    top = fit(x, min(want, WIDE))
    tree = deepened(rows, top, max(1, min(WIDE, want // top.parts)) if top.parts == WIDE else 1, sample)
    tree.probes = calibrate(tree, x, k, recall)
    shared, probes = spark.sparkContext.broadcast(tree), tree.probes

    def route(frames):
        for f in frames:
            v = np.stack(f["v"].to_numpy()).astype(np.float64) if len(f) else np.empty((0, dim))
            ask, visits = f["asks"].to_numpy(bool), [None] * len(f)
            at = np.flatnonzero(ask)
            for i in range(0, len(at), 256):
                for j, o in zip(at[i : i + 256], shared.value.order(v[at[i : i + 256]])[:, :probes], strict=True):
                    visits[j] = o.astype("int32")
            yield f.drop(columns="asks").assign(part=shared.value.filed(v).astype("int32") if len(f) else np.zeros(0, "int32"), parts=visits)

    # where a row is filed, and where it looks, by falling odds
    filed = rows.withColumn("asks", F.coalesce(is_query, F.lit(False))).mapInPandas(route, "vec_id long, v array<float>, part int, parts array<int>")
    filed = materialize(filed, "filed")
    asked = filed.filter("parts IS NOT NULL").select(F.col("vec_id").alias("query_id"), "v", "parts")
    have = materialize(filed.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "sizes")
    visit = lambda q, parts_: q.select("query_id", "v", F.explode(parts_).alias("part"))
    found = materialize(meet(visit(asked, F.col("parts")), filed, have, k), "found")
    # queries that met too few go to the other parts as well
    met = found.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    short = asked.join(met, F.col("query_id") == F.col("_q"), "left").filter(F.coalesce("_n", F.lit(0)) < k).drop("_q", "_n")
    short = materialize(short, "short")
    if have.agg(F.sum("n")).first()[0] > k and probes < tree.leaves and not short.isEmpty():
        others = F.array_except(F.sequence(F.lit(0), F.lit(tree.leaves - 1)), "parts")
        found = found.unionByName(meet(visit(short, others), filed, have, k))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def meet(ask: DataFrame, filed: DataFrame, have: DataFrame, k: int) -> DataFrame:
    """NEAREST of queries (query_id, v, part) among the rows filed under each part, whose
    numbers ``have`` gives: every block of a part's rows meets its queries, batch by
    batch.  A part's rows travel once for QUERIES of its queries, so where parts are a
    block or less, no more than the queries do."""
    want = ask.groupBy("part").agg(F.count(F.lit(1)).alias("_asks"))
    # a row a part that has both: WIDE * WIDE at most
    both = have.join(want, "part").select("part", F.ceil(F.col("n") / BLOCK).alias("_blocks"), F.ceil(F.col("_asks") / QUERIES).alias("_batches"))
    both = F.broadcast(materialize(both, "parts"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("long")
    left = ask.join(both, "part").withColumn("batch", dealt("query_id", "_batches")).withColumn("block", spread("_blocks"))
    right = filed.select("vec_id", "v", "part").join(both, "part").withColumn("block", dealt("vec_id", "_blocks")).withColumn("batch", spread("_batches"))
    keys = ["part", "block", "batch"]
    left = left.select("query_id", *[F.col(c).alias(c) for c in ("v", *keys)])  # columns of its own
    right = right.select("vec_id", "v", *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, r: rerank(q, r, k), NEAREST)


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
