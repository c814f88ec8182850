"""Vectors of contents, and search among them."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from estatum.functions import derive
from estatum.operators import joins, stats

DIMENSION = 384


def candidates(permanodes: DataFrame, claims: DataFrame, embeddings: DataFrame, model: str, version: str, limit: int | None = None, again: bool = False) -> DataFrame:
    """(permanode_id, text) still without a vector."""
    rows = joins.not_embedded(permanodes, claims, embeddings, model, version, limit, again)
    path = F.col("file_path")
    text = derive.permanode_text(derive.basename(path), F.col("classification"), F.col("domain"), derive.parent_dir(path), F.col("tier"))
    return rows.select("permanode_id", text.alias("text"))


def stub_vector(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """A direction that only the text decides: normal draws, seeded by its digest."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest(), "big")
    v = np.random.default_rng(seed).standard_normal(dimension)
    return (v / np.linalg.norm(v)).astype(np.float32)


def stub_embedder(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: stub_vector(t or "").tolist())


def run(rows: DataFrame, embedder=stub_embedder, batch: int = 32) -> DataFrame:
    """(permanode_id, vector, error) by any function from a batch of texts to a
    batch of vectors; a batch that fails is tried one text at a time."""

    def embed(frames):
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                try:
                    yield pd.DataFrame({"permanode_id": part["permanode_id"], "vector": list(embedder(part["text"])), "error": None})
                except Exception:  # noqa: BLE001  a plug-in may raise anything
                    for _, r in part.iterrows():
                        try:
                            vector, error = list(embedder(pd.Series([r["text"]])))[0], None
                        except Exception as e:  # noqa: BLE001
                            vector, error = None, str(e)
                        yield pd.DataFrame({"permanode_id": [r["permanode_id"]], "vector": [vector], "error": [error]})

    return rows.select("permanode_id", "text").mapInPandas(embed, "permanode_id string, vector array<float>, error string")


def batch_report(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("error").isNull()).alias("embedded"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def once(value: Column, use) -> Column:
    """``use(value)``, where the value is worked out once: inside a lambda an expression
    is worked out again for each entry."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def mean_pool_normalize(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set, scaled to unit length."""

    def mean(on: Column) -> Column:
        zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
        total = F.aggregate(on, zero, lambda acc, x: F.zip_with(acc, x["t"], lambda a, b: a + b))
        return once(F.greatest(F.size(on), F.lit(1)), lambda n: F.transform(total, lambda x: x / n))

    def unit(m: Column) -> Column:
        norm = F.greatest(F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
        return once(norm, lambda n: F.transform(m, lambda x: x / n))

    on = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] != 0)
    return once(once(on, mean), unit)


def upsert(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    rest = [c for c in embeddings.columns if c not in ("permanode_id", "model_name", "model_version", "computed_at")]
    both = embeddings.unionByName(new).groupBy("permanode_id", "model_name", "model_version").agg(F.max_by(F.struct("computed_at", *rest), "computed_at").alias("r"))
    return both.select("permanode_id", "model_name", "model_version", "r.*")


def check_dimension(rows: DataFrame, dimension: int = DIMENSION, column: str = "vector") -> DataFrame:
    return rows.filter(F.size(column) == dimension)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    d = lambda x: x.cast("double")
    if metric == "l2":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (d(x) - d(y)) * (d(x) - d(y)))))
    dot = total(F.zip_with(a, b, lambda x, y: d(x) * d(y)))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: d(x) * d(x))))
    return 1 - dot / (norm(a) * norm(b))


def search(embeddings: DataFrame, query: Column, k: int = 10, metric: str = "cosine") -> DataFrame:
    """The ``k`` nearest of one model's vectors; the model is filtered before."""
    return embeddings.withColumn("distance", distance(F.col("vector"), query, metric)).orderBy("distance", "permanode_id").limit(k)


#: Queries and vectors of a tile of search_many.
BATCH, BLOCK = 1024, 8192


def nearest(q: np.ndarray, x: np.ndarray, names: np.ndarray, k: int, metric: str) -> list[tuple]:
    """(query's place, name, distance) of the ``k`` nearest rows of a block for each query:
    products pick those that may be, and their distances are taken entry by entry."""
    if metric == "l2":
        rough, scale = (x * x).sum(1)[None, :] + (q * q).sum(1)[:, None] - 2 * (q @ x.T), (x * x).sum(1).max() + (q * q).sum(1)
    else:
        nq, nx = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
        rough, scale = -(q @ x.T) / np.outer(nq, nx), np.ones(len(q))
    out = []
    for i in range(len(q)):
        at = np.arange(len(x))
        if len(x) > k:
            at = np.flatnonzero(rough[i] <= np.partition(rough[i], k - 1)[k - 1] + 1e-9 * scale[i])
        if metric == "l2":
            d = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
        else:
            d = 1 - (x[at] * q[i]).sum(1) / (nx[at] * nq[i])
        for j in np.lexsort((names[at], d))[:k]:
            out.append((i, names[at[j]], d[j]))
    return out


def usable(vector: Column, metric: str) -> Column:
    """Vectors that have a distance: finite entries, and for angles a length."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.coalesce(~F.exists(vector, bad), F.lit(False))
    return good if metric == "l2" else good & F.exists(vector, lambda x: x != 0)


def search_many(embeddings: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", batch: int = BATCH, block: int = BLOCK) -> DataFrame:
    """The same for a table of queries (query_id, query), with their ``rank``.  Blocks of
    vectors meet batches of queries as matrix products, and a tile gives ``k`` rows a
    query at most; a vector is copied once for ``batch`` queries, a query once for ``block``
    vectors.  Vectors of other lengths than a query's, or without a distance, are passed
    over."""
    rows = embeddings.select("permanode_id", "vector").filter(usable(F.col("vector"), metric))
    asked = queries.select("query_id", "query").filter(usable(F.col("query"), metric))
    blocks, batches = (max(1, -(-df.count() // size)) for df, size in ((rows, block), (asked, batch)))
    dealt = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("batch", dealt(batches, "query_id", "query")).withColumn("block", spread(blocks))
    right = rows.withColumn("block", dealt(blocks, "permanode_id", "vector")).withColumn("batch", spread(batches))
    schema = T.StructType([asked.schema["query_id"], rows.schema["permanode_id"], T.StructField("distance", T.DoubleType())])

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        sizes = r["vector"].map(len)
        for n, part in q.groupby(q["query"].map(len)):
            same = r[sizes == n]
            if len(same):
                stack = lambda c: np.stack(c.to_numpy()).astype(np.float64)
                ids = part["query_id"].tolist()
                out += [(ids[i], name, d) for i, name, d in nearest(stack(part["query"]), stack(same["vector"]), same["permanode_id"].to_numpy(), k, metric)]
        return pd.DataFrame(out, columns=schema.names)

    found = left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInPandas(meet, schema)
    order = [F.asc("distance"), F.asc("permanode_id")]
    best = stats.last_n_per_key(found, ["query_id"], order, k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
