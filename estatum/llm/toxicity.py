"""Toxicity by a linear-chain conditional random field.

Two states a token (clean, toxic); a token's features are the word and its first
4, 5 and 6 letters (inflected words share a stem), emissions are weights of
those with toxic log-odds, transitions a 2 x 2 matrix.  Labels are of documents only, so token labels are
made first: in documents labelled toxic, words with a feature whose smoothed log-odds between
toxic and clean labelled documents pass a threshold are toxic tokens, and all
tokens of other documents are clean.  The CRF is fitted to these by gradient
ascent on the conditional likelihood; forward-backward marginals of the toxic
state then give offending offsets and, through a logistic curve fitted on the
training documents, a document's score.

Null and empty texts have no tokens and get the score of a text without any
toxic marginal.  Rows repeated in the input are repeated in the output; extra
columns are ignored; an empty table gives no rows, and without labels nothing is
toxic.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatum.llm.common import extended, materialize, table

TOKEN = re.compile(r"[^\W\d_]+")
#: Bound of the labelled documents (by hash) that the fit gathers in one task.
FIT_DOCS = 1600
#: Weight from which a word or stem of the fit's documents is listed.
LISTED = 1.5
#: Label rows (16 bytes each) up to which they are broadcast.
SMALL_LABELS = 1_000_000
#: A token is labelled toxic if its document is and its log-odds are at least this.
ODDS = 2.5
STEMS = (4, 5, 6)


def listed_features(texts: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and ``word``: a row for each distinct word of a text, and stem."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    stems = [F.transform(F.filter(F.col("_w"), lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in STEMS]
    return texts.select(*keep, found.alias("_w")).select(*keep, F.explode(F.array_distinct(F.concat("_w", *stems))).alias("word"))


def word_odds(labelled: DataFrame, least: float = LISTED, among: DataFrame | None = None) -> DataFrame:
    """(word, weight): the words and stems ("^" before them), of those ``among`` (word) if
    given, whose log-odds between documents labelled 1 and 0, over all labelled rows, are
    at least ``least``; the greatest first, ties by word."""
    words = listed_features(labelled, "toxic")
    words = words if among is None else words.join(F.broadcast(among), "word", "left_semi")
    by = words.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("b"))
    n = labelled.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("na"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("nb"))
    odds = F.log((F.col("a") + 0.5) / (F.col("na") + 1.0)) - F.log((F.col("b") + 0.5) / (F.col("nb") + 1.0))
    # the support term keeps rare words, whose odds are noise, near zero
    scored = by.filter("a + b >= 4").crossJoin(F.broadcast(n)).select("word", (odds * (1 - F.exp(-(F.col("a") + F.col("b")) / 3.0))).alias("weight"))
    return scored.filter(F.col("weight") >= least).orderBy(F.desc("weight"), "word")


def evidence(tagged: list[tuple[int, int, float]]) -> float:
    """Log-odds that some word is toxic, from marginals that are not negligible."""
    return -sum(np.log1p(-min(p, 1 - 1e-9)) for _, _, p in tagged if p >= 0.1)


def features_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in STEMS if len(word) > n)]


class Memo(dict):
    """Emission by word, 0.0 where no feature is listed; bounded."""

    def __init__(self, crf: Crf):
        self.crf = crf

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        found = [x for f in features_of(word) if (x := self.crf.emit.get(f)) is not None]
        self[word] = out = (self.crf.bias + sum(found) or 1e-12) if found else 0.0
        return out


class Crf:
    """Emission of the toxic state, less that of the clean state: ``bias`` plus
    the weights of a word's listed features; start and transition scores."""

    def __init__(self, emit: dict[str, float], bias: float, start: np.ndarray, trans: np.ndarray, a: float = 1.0, b: float = 0.0):
        self.emit, self.bias, self.start, self.trans, self.a, self.b = emit, bias, start, trans, a, b
        step = np.exp(trans) * np.exp([0.0, bias])[None, :]
        self.eig, right = np.linalg.eig(step)
        self.right, self.left = right.real, np.linalg.inv(right).real
        self.eig = self.eig.real
        self.memo: Memo | None = None

    def leap(self, n: int) -> np.ndarray:
        """Transfer over ``n`` unlisted tokens, scaled: a power of one matrix."""
        return (self.right * (self.eig / self.eig.max()) ** n) @ self.left

    def marginals(self, positions: list[int], values: list[float], length: int) -> np.ndarray:
        """Probability of the toxic state at the listed tokens of a sequence, by
        forward-backward; runs of unlisted tokens are leapt over in one step."""
        n = len(positions)
        into, scale = [], np.exp(self.trans)
        alpha = np.empty((n, 2))
        for k in range(n):
            e = np.exp([0.0, values[k]])
            if k == 0:
                if positions[0] == 0:
                    v = np.exp(self.start)
                else:
                    v = np.exp(self.start + [0.0, self.bias]) @ self.leap(positions[0] - 1) @ scale
            else:
                m = self.leap(positions[k] - positions[k - 1] - 1) @ scale
                into.append(m)
                v = alpha[k - 1] @ m
            v = v * e
            alpha[k] = v / v.sum()
        beta = np.ones((n, 2))
        if n:
            beta[-1] = self.leap(length - 1 - positions[-1]) @ np.ones(2)
            for k in range(n - 2, -1, -1):
                v = into[k] @ (np.exp([0.0, values[k + 1]]) * beta[k + 1])
                beta[k] = v / v.sum()
        p = alpha * beta
        return p[:, 1] / p.sum(axis=1)

    def tag(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, marginal) of the listed words, offsets in code points."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if self.memo is None:
            self.memo = Memo(self)
        memo, words = self.memo, TOKEN.findall(low)
        values = [memo[w] for w in words]
        at = [i for i, v in enumerate(values) if v]
        if not at:
            return []
        p = self.marginals(at, [values[i] for i in at], len(words))
        want, found = dict(zip(at, p, strict=True)), []
        for i, m in enumerate(TOKEN.finditer(low)):
            if i in want:
                found.append((m.start(), m.end(), float(want[i])))
        return found

    def score(self, tagged: list[tuple[int, int, float]]) -> float:
        total = min(evidence(tagged), 20.0)
        return float(1 / (1 + np.exp(-np.clip(self.a * total + self.b, -500, 500))))


def fit(docs: list[tuple[str, int]], odds: dict[str, float], rounds: int = 40, rate: float = 0.5, shrink: float = 1e-3, segment: int = 128) -> Crf:
    """Fit to (text, label) rows, cut into segments; runs over the padded matrix
    of their words."""
    index = {f: i for i, f in enumerate(odds)}
    ids: dict[str, int] = {}
    marks: list[bool] = []
    pairs: list[tuple[int, int]] = []
    rows, labels = [], []
    for text, toxic in docs:
        found = []
        for w in TOKEN.findall((text or "").lower()):
            if w not in ids:
                ids[w] = len(ids)
                hit = [index[f] for f in features_of(w) if f in index]
                pairs += [(ids[w], i) for i in hit]
                marks.append(any(odds[f] >= ODDS for f in features_of(w) if f in index))
            found.append(ids[w])
        for i in range(0, len(found), segment):
            rows.append(found[i : i + segment])
            labels.append([int(bool(toxic) and marks[w]) for w in rows[-1]])
    emit, bias = np.zeros(len(index)), np.array([-1.0])
    start, trans = np.array([0.0, -3.0]), np.array([[0.0, -3.0], [0.0, -1.0]])
    if not rows:
        return Crf({}, -1.0, start, trans, 1.0, -1.0)
    width = max(map(len, rows))
    x, y, on = (np.zeros((len(rows), width), np.int32) for _ in range(3))
    for i, (r, v) in enumerate(zip(rows, labels, strict=True)):
        x[i, : len(r)], y[i, : len(r)], on[i, : len(r)] = r, v, 1
    on = on.astype(bool)
    word_of, feature_of = (np.array(c, np.int64) for c in (zip(*pairs, strict=True) if pairs else ([], [])))
    uses = np.bincount(x[on], minlength=len(ids))
    seen = np.bincount(feature_of, uses[word_of], minlength=len(index))
    state = [np.zeros_like(emit), np.zeros(1), np.zeros(2), np.zeros((2, 2))]
    for _ in range(rounds):
        value = bias[0] + np.bincount(word_of, emit[feature_of], minlength=len(ids))
        m = np.exp(trans)
        by_word, at_start, pairs_seen = np.zeros(len(ids)), np.zeros(2), np.zeros((2, 2))
        for lo in range(0, len(rows), 1024):  # bounds what the sums below hold at once
            xs, ys, live = x[lo : lo + 1024], y[lo : lo + 1024], on[lo : lo + 1024]
            e = np.exp(np.stack([np.zeros(xs.shape), value[xs]], axis=-1))
            alpha, beta = np.empty((*xs.shape, 2)), np.ones((*xs.shape, 2))
            v = np.exp(start) * e[:, 0]
            alpha[:, 0] = v / v.sum(1, keepdims=True)
            for t in range(1, width):
                v = (alpha[:, t - 1] @ m) * e[:, t]
                alpha[:, t] = np.where(live[:, t, None], v / v.sum(1, keepdims=True), alpha[:, t - 1])
            for t in range(width - 2, -1, -1):
                v = (beta[:, t + 1] * e[:, t + 1]) @ m.T
                beta[:, t] = np.where(live[:, t + 1, None], v / v.sum(1, keepdims=True), 1.0)
            g = alpha * beta
            g /= g.sum(-1, keepdims=True)
            pair = alpha[:, :-1, :, None] * m * (e * beta)[:, 1:, None, :]
            pair /= pair.sum((-1, -2), keepdims=True)
            both = live[:, 1:]
            np.add.at(pairs_seen, (ys[:, :-1][both], ys[:, 1:][both]), 1)
            pairs_seen -= pair[both].sum(0)
            by_word += np.bincount(xs[live], (ys - g[..., 1])[live], minlength=len(ids))
            at_start += np.bincount(ys[:, 0], minlength=2) - g[:, 0].sum(0)
        steps = (
            (emit, np.bincount(feature_of, by_word[word_of], minlength=len(index)) / np.maximum(seen, 1) ** 0.5),
            (bias, by_word.sum(keepdims=True) / on.sum() ** 0.5),
            (start, at_start / len(rows)),
            (trans, pairs_seen / max(1, on[:, 1:].sum()) ** 0.5),
        )
        # adaptive steps: each weight's by its own past gradients
        for k, (w, d) in enumerate(steps):
            d = d - shrink * w
            state[k] += d * d
            w += rate * d / (np.sqrt(state[k]) + 1e-8)
    model = Crf({f: float(emit[i]) for f, i in index.items()}, float(bias[0]), start, trans)
    # logistic curve from summed marginals to labels, by Newton steps
    z = np.array([evidence(model.tag(t or "")) for t, _ in docs])
    t = np.array([float(bool(v)) for _, v in docs])
    z1, w = np.stack([np.minimum(z, 20), np.ones_like(z)], axis=1), np.array([1.0, -1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z1 @ w))
        h = (z1 * (p * (1 - p))[:, None]).T @ z1 + 1e-2 * np.eye(2)
        w = w + np.linalg.solve(h, z1.T @ (t - p) - 1e-2 * w)
    model.a, model.b = float(max(w[0], 1e-3)), float(w[1])
    return model


def train(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> Crf:
    """Fit on (doc_id, text, toxic).  The CRF is fitted on at most ``fit_docs`` rows, half
    toxic, by hash; the odds of the words that these hold cover every labelled row."""
    labelled = labelled.filter("text IS NOT NULL AND toxic IS NOT NULL")
    parts = []
    for label in (1, 0):
        part = labelled.filter((F.col("toxic") == 1) if label else (F.col("toxic") != 1))
        parts.append(part.select("text", F.lit(label).alias("label"), F.xxhash64("doc_id", F.lit(7)).alias("_h")).orderBy("_h", "text").limit(fit_docs // 2))
    picked = materialize(parts[0].unionByName(parts[1]), "fit")
    # only features that the fit sees can get a weight, so the list is bounded by its documents
    among = listed_features(picked).distinct()
    return fitted(picked, word_odds(labelled, among=among))


def fitted(picked: DataFrame, odds: DataFrame) -> Crf:
    """``fit`` to (text, label, _h) and (word, weight), in a task: neither the texts nor what
    the fit takes are the driver's, which gets the weights alone."""

    def run(batches):
        docs, listed = [], {}
        for b in batches:
            for kind, x, text in zip(b.column("kind").to_pylist(), b.column("x").to_pylist(), b.column("text").to_pylist(), strict=True):
                if kind:
                    listed[text] = x
                else:
                    docs.append((text, int(x)))
        model = fit(docs, listed)
        model.memo = None  # each worker keeps its own
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    texts = picked.select(F.lit(0).alias("kind"), F.col("label").cast("double").alias("x"), "_h", "text")
    words = odds.select(F.lit(1).alias("kind"), F.col("weight").alias("x"), F.lit(0).cast("long").alias("_h"), F.col("word").alias("text"))
    rows = texts.unionByName(words).repartition(1).sortWithinPartitions("kind", F.desc("x"), "_h", "text")
    models = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(models[0].model) if models else fit([], {})


def toxic_scores(df: DataFrame, model: Crf, keep: list[str], text: str = "text", span_at: float = 0.5) -> DataFrame:
    """``keep`` columns plus score, predicted and spans; spans are words of marginal ``span_at`` or more."""
    schema = extended(df.select(*keep).schema, "score double, predicted int, spans array<struct<start:int,end:int,p:double>>")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    session = df.sparkSession.sparkContext.broadcast(model)  # a word or stem with toxic odds, and its weight

    def run(batches):
        m = session.value
        for b in batches:
            tagged = [m.tag(x.as_py() or "") for x in b.column(b.num_columns - 1)]
            scores = [m.score(t) for t in tagged]
            spans = [[{"start": s, "end": e, "p": p} for s, e, p in t if p >= span_at] for t in tagged]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)], names=schema.names)

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def train_split(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows the fit may see: crc32(doc_id as text) mod 5 is not 0.  Of several
    labels of one document the toxic one counts; labels without an id or a mark do not."""
    marks = labels.select(F.col("doc_id").alias("_d"), "toxic").filter("toxic IS NOT NULL").filter(F.crc32(F.col("_d").cast("string")) % 5 != 0).groupBy("_d").agg(F.max("toxic").alias("toxic"))
    # few labels go to the texts; many would not fit, and both are shuffled
    marks = F.broadcast(marks) if labels.count() <= SMALL_LABELS else marks
    return docs.select("doc_id", "text").join(marks, F.col("doc_id") == F.col("_d")).drop("_d")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = materialize(train_split(docs, table(spark, sf_dir, "labels")), "labelled")
    model = train(labelled)
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out")
    out = toxic_scores(docs.select("doc_id", "text", held), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
