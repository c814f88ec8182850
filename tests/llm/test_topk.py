"""Exact top-k against all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatum.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def is_query():
    return F.col("vec_id") % 3 == 0



def brute(rows, k=5, divisor=3):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % divisor == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable if i != q)[:k]
            out += [(q, r, i, max(-(2**63 - 1), min(-s, 2**63 - 1))) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.fixture
def small(monkeypatch):
    """Many blocks, shards, lots and chunks; set before tasks are pickled."""
    for name, value in {"BLOCK": 4, "SHARD": 64, "MOST": 5, "LOT": 2, "CHUNK": 3, "FIRST": 1, "GROWTH": 2}.items():
        monkeypatch.setattr(topk, name, value)


def clustered(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    return [(i, (centre[i % 6] + 0.1 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_clusters(spark):
    rows = clustered(0, 300)
    assert got(topk.top_products(spark.createDataFrame(rows, SCHEMA).repartition(4), is_query())) == brute(rows)


def test_ties_and_awkward_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(3)]) for i in range(60)] + [(i, [0.5, 0.5, 0.5]) for i in range(60, 120)]
    rows += [(200, None), (201, [None, 1.0, 1.0]), (204, [float("nan")] * 3), (207, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (210, []), (213, [0.0] * 3), (216, [1.0]), (219, [1.0] * 6), (3, [0.25, 0.25, -1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", number int, part int").repartition(3)
    assert got(topk.top_products(df, is_query())) == brute(rows)


def test_great_weights(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 3.0]), (2, [-1e30, 2.0]), (3, [2.0**45, 2.0**30]), (4, [2.0**44 + 1, 5.0]), (6, [3.0, 2.0**20])]
    want = brute(rows)
    assert sorted((q, s) for q, _, _, s in want) == sorted((q, s) for q, _, _, s in got(topk.top_products(spark.createDataFrame(rows, SCHEMA), is_query())))


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, [1.0]), (1, [2.0])], [(0, []), (3, [])], [(1, [1.0])]])
def test_few(spark, rows):
    assert got(topk.top_products(spark.createDataFrame(rows, SCHEMA), is_query())) == brute(rows)


def test_small_blocks(small):
    """The search inside a task, with limits so small that all of them matter."""
    import pandas as pd

    rows = clustered(2, 200)
    w = [np.floor(256 * np.array(v)) for _, v in rows]
    blocks = []
    for b in range(0, 200, 4):
        m = np.stack(w[b : b + 4])
        blocks.append((0, b // 4, 4, 8, np.arange(b, b + 4, dtype="<i8").tobytes(), topk.to_bytes(m), np.concatenate([m.max(axis=0), (-m).max(axis=0)]), b))
    here = list(pd.DataFrame(blocks, columns=topk.names(topk.BLOCKS)).itertuples())
    at = np.arange(0, 200, 3)
    far = np.full(len(at), topk.NONE, "<i8")
    row = pd.DataFrame([(1, 0, 0, len(at), 8, np.arange(len(at), dtype="<i4").tobytes(), at.astype("<i8").tobytes(), topk.to_bytes(np.stack(w)[at]), far.tobytes(), np.full(len(at), topk.LONG, "<i8").tobytes())], columns=topk.names(topk.ASKED))
    q = topk.Asked(next(row.itertuples()))
    who, ids, score = topk.visit(q, here, 5)
    assert sorted(zip(at[who].tolist(), ids.tolist(), score.tolist(), strict=True)) == sorted((q, i, s) for q, _, i, s in brute(rows))


def test_pruning(spark, monkeypatch):
    """Clustered vectors: most blocks are never scored."""
    import pandas as pd

    rows = [(i, v) for i, v in clustered(3, 1200, 16)]
    order = sorted(range(1200), key=lambda i: i % 6)
    w = np.floor(256 * np.array([rows[i][1] for i in order]))
    here = []
    for b in range(0, 1200, 8):
        m = w[b : b + 8]
        ids = np.array(order[b : b + 8])
        here.append((0, b // 8, len(m), 16, ids.astype("<i8").tobytes(), topk.to_bytes(m), np.concatenate([m.max(axis=0), (-m).max(axis=0)]), int(ids.min())))
    here = list(pd.DataFrame(here, columns=topk.names(topk.BLOCKS)).itertuples())
    scored, plain = [], topk.to_matrix
    row = pd.DataFrame([(1, 0, 0, 1, 16, np.zeros(1, "<i4").tobytes(), np.array([order[0]], "<i8").tobytes(), topk.to_bytes(w[:1]), np.array([topk.NONE], "<i8").tobytes(), np.array([topk.LONG], "<i8").tobytes())], columns=topk.names(topk.ASKED))
    q = topk.Asked(next(row.itertuples()))
    monkeypatch.setattr(topk, "to_matrix", lambda *a: scored.append(a) or plain(*a))
    _, ids, _ = topk.visit(q, here, 5)
    assert len(scored) < 0.4 * len(here) and [(order[0], r, i) for r, i in enumerate(ids.tolist(), 1)] == [x[:3] for x in brute(rows, divisor=1) if x[0] == order[0]]


def test_waves(spark, small):
    rows = clustered(4, 150)
    assert got(topk.top_products(spark.createDataFrame(rows, SCHEMA).repartition(2), is_query())) == brute(rows)


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(topk.op11_topk(spark, folder)) == brute(rows, divisor=50)
