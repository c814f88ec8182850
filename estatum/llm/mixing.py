"""Mixing sources to target weights by entropy balancing.

Every word of a document carries its document's rate.  Entropy balancing takes the
rates of least Kullback-Leibler divergence, over words, from the current mix that meet
token constraints: each source's total exactly, and, so that a new mix of sources
does not turn into another mix of languages or lengths, each language's and each
length band's share of the corpus, as nearly as a ridge lets it (they may contradict
the sources' totals).  The solution is exponentially tilted,

    rate = exp(multiplier of the source + multipliers of the document's features),

and its convex dual is minimised by Newton's method.  The sources' multipliers follow
from the features', so the dual is one of at most FEATURES and 32 unknowns, whatever
the number of sources.  In each iteration Spark sums value, gradient and Hessian over
all cells (source, language, band) with their tokens; the driver solves a system of
that bounded size.  Rates above the ceiling are cut to it, and the source's multiplier
is renewed so that its total still holds.  Rates are then rounded into copies from the
longest documents to the shortest, and rounding errors are carried along.

Null text has size 0.  Null is a source and a language of its own; the source is
ordered last.  Without a column ``lang`` all is one language.  Repeated rows are
documents of their own, and of equal rows it does not matter which is copied.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from estatum.llm.common import WORD, extended, materialize, table, with_rank

#: Weights by the rank of a source, repeating; no document is taken more often than CEILING times.
WEIGHTS = (5.0, 2.0, 1.0)
CEILING = 3.0
#: Languages with a constraint of their own, those of most tokens; the others share one.
FEATURES = 32
#: Strength of the ridge, Newton's iterations at most, and the gradient's share of all tokens at which they end.
RIDGE, ROUNDS, CLOSE = 0.05, 40, 1e-7
#: Documents up to which their counts (48 bytes each) are broadcast.
FEW = 1_000_000


def word_count(text: Column) -> Column:
    """Number of words, without an array of them: bytes where a word starts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) of (source, size): shares of the whole by
    weight; what lies above ``ceiling`` times a source's size is reshared among
    the others.  Water-filling: the level is found from sources in the order in
    which they reach their ceilings.  The windows run over one row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = by.withColumn("_i", F.row_number().over(Window.orderBy(F.encode(F.col("source"), "UTF-8").asc_nulls_last())) - 1)
    cycle = F.array(*map(F.lit, weights))
    w = ordered.withColumn("_w", F.get(cycle, (F.col("_i") % len(weights)).cast("int"))).withColumn("_cap", ceiling * F.col("source_size"))
    up = Window.orderBy(F.col("_cap") / F.col("_w"), "_i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = w.withColumns({"_full": F.coalesce(F.sum("_cap").over(up), F.lit(0.0)), "_used": F.coalesce(F.sum("_w").over(up), F.lit(0.0)), "_all": F.sum("source_size").over(whole), "_sumw": F.sum("_w").over(whole)})
    # level if exactly the sources before this one are at their ceilings
    level = (F.col("_all") - F.col("_full")) / (F.col("_sumw") - F.col("_used"))
    levels = filled.withColumn("_level", level)
    right = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap") * (1 + 1e-12), F.struct("_used", "_level"))).over(whole)
    return levels.withColumn("_at", right["_level"]).select("source", "source_size", F.least("_cap", F.coalesce(F.col("_at"), F.lit(0.0)) * F.col("_w")).alias("target"))


def _sources(frames):
    """Whole sources, one after the other, of frames that are sorted by ``number``."""
    held = None
    for f in frames:
        held = f if held is None else pd.concat([held, f], ignore_index=True)
        last = held["number"].iloc[-1]
        done = held[held["number"] != last]
        for _, g in done.groupby("number", sort=False):
            yield g
        held = held[held["number"] == last]
    if held is not None and len(held):
        yield held


def _sums(cells: DataFrame, mu: np.ndarray) -> np.ndarray:
    """Over all sources: target * log of the tilted tokens, expected tokens by feature,
    and their covariance, in one array; every task sums its own sources first."""
    k = len(mu)

    def run(frames):
        value, grad, hess, seen = 0.0, np.zeros(k), np.zeros((k, k)), False
        for g in _sources(frames):
            a, t, lang, band = (g[c].to_numpy() for c in ("tokens", "target", "lang", "band"))
            if t[0] <= 0 or a.sum() <= 0:
                continue
            seen = True
            top = (mu[lang] + mu[band]).max()
            w = a * np.exp(mu[lang] + mu[band] - top)
            value += t[0] * (np.log(w.sum()) + top)
            p, own = w / w.sum(), np.zeros(k)
            np.add.at(own, lang, p)
            np.add.at(own, band, p)
            both = np.diag(own)
            np.add.at(both, (lang, band), p)
            np.add.at(both, (band, lang), p)
            grad += t[0] * own
            hess += t[0] * (both - np.outer(own, own))
        if seen:
            flat = np.concatenate([[value], grad, hess.ravel()])
            yield pd.DataFrame({"at": np.arange(len(flat)), "x": flat})

    rows = cells.repartition("number").sortWithinPartitions("number").mapInPandas(run, "at long, x double")
    out = np.zeros(1 + k + k * k)
    # len(out) rows at most, in one job; an iterator would run a job for each partition
    for r in rows.groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r.at] = r.x
    return out


def balance(cells: DataFrame, shares: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> np.ndarray:
    """Multipliers of the features by Newton's method on the dual.  ``cells``: (number,
    target, tokens, lang, band), the last two indices of features; ``shares``: wanted
    tokens by feature.  A step is halved until the dual falls."""
    k, mu = len(shares), np.zeros(len(shares))
    strength = ridge * shares + 1e-9 * max(shares.sum(), 1.0)

    def at(m):
        x = _sums(cells, m)
        value = x[0] - shares @ m + 0.5 * strength @ (m * m)
        return value, x[1 : 1 + k] - shares + strength * m, x[1 + k :].reshape(k, k) + np.diag(strength)

    value, grad, hess = at(mu)
    for _ in range(rounds):
        if np.abs(grad).max(initial=0.0) <= CLOSE * max(shares.sum(), 1.0):
            break
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        for _ in range(20):
            new = at(mu - step)
            if new[0] <= value:
                break
            step /= 2
        mu, (value, grad, hess) = mu - step, new
    return mu


def cell_rates(cells: DataFrame, mu: np.ndarray, ceiling: float) -> DataFrame:
    """(number, lang, band, rate): the tilted rates of each cell, at most ``ceiling``, with
    the multiplier of the source that gives its target."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        a, t = g["tokens"].to_numpy(np.float64), float(g["target"].iloc[0])
        tilt = np.exp(mu[g["lang"]] + mu[g["band"]])
        low, high = 0.0, ceiling / tilt.min()
        if t < ceiling * a.sum() * (1 - 1e-12):
            for _ in range(100):
                mid = (low + high) / 2
                low, high = (mid, high) if (a * np.minimum(ceiling, mid * tilt)).sum() < t else (low, mid)
        rate = np.minimum(ceiling, high * tilt) if t > 0 else np.zeros(len(a))
        return g[["number", "lang", "band"]].assign(rate=rate)

    return cells.groupBy("number").applyInPandas(solve, "number long, lang int, band int, rate double")


def mix(docs: DataFrame, keep: list[str], weights: tuple[float, ...] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` to the
    ``keep`` columns of documents (doc_id, text, source, and lang if there)."""
    size = word_count(F.col("text"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    base = materialize(docs.select(F.struct(*keep).alias("_keep"), F.monotonically_increasing_id().alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("doc_id", "source")], lang.alias("_lang"), size.alias("size"), F.xxhash64("text").alias("_text")), "sizes")
    goals = source_targets(base.select(F.col("_source").alias("source"), "size"), weights, ceiling)
    goals = materialize(goals.withColumn("number", F.row_number().over(Window.orderBy("source")).cast("long")), "goals")
    # features: languages first, then bands of sizes by powers of two
    by_lang = base.groupBy("_lang").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "_lang").limit(FEATURES).collect()
    names = {r._lang: i for i, r in enumerate(by_lang)}
    other = len(names)
    listed = F.lit(other)
    for name, i in names.items():
        listed = F.when(F.col("_lang").eqNullSafe(F.lit(name)), i).otherwise(listed)
    band = F.lit(other + 1) + F.floor(F.log2(F.col("size") + 1)).cast("int")
    marked = base.drop("_keep").withColumns({"lang": listed.cast("int"), "band": band.cast("int")})
    sums = marked.groupBy("_source", "lang", "band").agg(F.sum("size").alias("tokens"))
    cells = materialize(sums.join(goals, F.col("_source").eqNullSafe(F.col("source"))).select("number", "target", "tokens", "lang", "band"), "cells")
    shares = np.zeros(other + 1 + 64)
    whole = sums.select(F.explode(F.array("lang", "band")).alias("f"), "tokens").groupBy("f").agg(F.sum("tokens").alias("n")).collect()
    for r in whole:
        shares[r.f] = r.n
    shares = shares[: max([r.f for r in whole], default=0) + 1]
    mu = balance(cells, shares)
    rates = goals.join(cell_rates(cells, mu, ceiling), "number").select("source", "source_size", "target", "lang", "band", "rate")
    classes = copy_classes(marked, rates, ceiling)
    # equal in id and text are interchangeable, so a rerun copies the same
    ranked = with_rank(marked, ["_source", "lang", "size"], ["_doc_id", "_text"], "_r")
    joined = ranked.join(classes, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("lang") == F.col("_l")))
    copies = F.floor(F.col("_copies") / F.col("_n")) + F.when(F.col("_r") < F.col("_copies") % F.col("_n"), 1).otherwise(0)
    counted = materialize(joined.select("_id", "size", "source_size", "target", "rate", copies.cast("int").alias("copies")), "copies")
    # few counts go to the kept columns; many would not fit, and both are shuffled
    counted = F.broadcast(counted) if counted.count() <= FEW else counted
    return base.select("_id", "_keep").join(counted, "_id").select("_keep.*", "size", "source_size", "target", "rate", "copies")


def copy_classes(marked: DataFrame, rates: DataFrame, ceiling: float) -> DataFrame:
    """One row a (source, language, size): how many copies its documents make together.

    Rates are rounded from the longest documents to the shortest, what a size is
    short of or has too much being carried to the next; a long document is not taken
    where it alone would overshoot what the shorter ones can meet.  A group holds a source's
    distinct sizes by language, which the longest document bounds, not its documents."""
    counts = marked.groupBy(F.col("_source").alias("_s"), F.col("lang").alias("_l"), F.col("band").alias("_b"), F.col("size").alias("_z")).agg(F.count(F.lit(1)).alias("_n"))
    joined = counts.join(rates, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_l") == F.col("lang")) & (F.col("_b") == F.col("band"))).drop("source", "lang", "band", "_b")

    def round_off(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["_z", "_l"], ascending=False)
        wanted = f["rate"] * f["_n"] * f["_z"]
        # what is left to take, and what the shorter documents can take at most
        left, after = float(wanted.sum()), ceiling * (f["_n"] * f["_z"])[::-1].cumsum()[::-1].shift(-1, fill_value=0.0)
        rest, out = 0.0, []
        for z, n, rate, want, most in zip(f["_z"], f["_n"], f["rate"], wanted, after, strict=True):
            if not z:
                out.append(round(rate * n))
                continue
            want += rest
            low, high = math.ceil((left - most) / z - 1e-9), math.floor(left / z + 1e-9)
            c = round(want / z)
            if low <= high:
                c = min(max(c, low), high)
            else:  # one more overshoots, one less can't be made up for: the smaller error
                c = high if left - most - high * z < low * z - left else low
            c = int(min(max(c, 0), ceiling * n))
            rest, left = want - c * z, left - c * z
            out.append(c)
        return f.assign(_copies=out)

    return joined.groupBy("_s").applyInPandas(round_off, extended(joined.schema, "_copies long"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), ["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")
