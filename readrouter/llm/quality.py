"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled good texts of the training fold; the unlabelled set is web text of the same fold, whatever
its labels. The share of good texts among the unlabelled (the class prior) is estimated from how two first
positive-against-unlabelled classifiers, each fitted on one half of the ids, rank the positives and all documents of the other half. A small network over text statistics
and a weight for each hashed word are then fitted together to the non-negative risk with the logistic loss, so the output
estimates the chance of label 1.

Defined results: null text counts as empty; empty texts are scored like others (all statistics 0, no words); repeated rows are
scored each. Without positives or without unlabelled texts every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow, with_fields
from .sparse import Rows, common_terms, shrunk, sums

SYMBOL = re.compile(r"[^\w\s.,;:'’\"()\-]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"\d")
STOP = re.compile(r"[.,;:!?]")
N_STATISTICS = 13
WORD = re.compile(r"\w+")
BUCKETS = 1 << 18
#: Words remembered by a worker before it starts anew.
REMEMBERED = 300_000


def statistics(text: str | None) -> list[float]:
    """Counts and ratios of the whole text."""
    text = text or ""
    n, words = len(text), text.split()
    w = len(words)
    if not w:
        return [0.0] * N_STATISTICS
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    symbols, upper = len(SYMBOL.findall(text)), len(UPPER.findall(text))
    doubled = sum(a == b for a, b in zip(words, words[1:]))
    lines = text.split("\n")
    return [
        symbols / n, float(np.sqrt(symbols / n)), upper / n, float(np.sqrt(upper / n)), len(DIGIT.findall(text)) / n, len(STOP.findall(text)) / w,
        1 - len(counts) / w, doubled / w, float(np.sqrt(doubled / w)), max(counts.values()) / w, float(np.log1p(w)) / 10, n / w / 20, len(set(lines)) / len(lines),
    ]


class Words:
    """The buckets of a text's words, or their places in a model; remembers what it found for a word."""

    def __init__(self, places: dict[int, int] | None = None):
        self.places, self.known = places, {}

    def __call__(self, text: str | None) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, found = self.known, set()
        for word in set(WORD.findall((text or "").lower())):
            at = known.get(word)
            if at is None:
                bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
                at = known[word] = bucket if self.places is None else self.places.get(bucket, -1)
            if at >= 0:
                found.add(at)
        return sorted(found)


@dataclass
class QualityModel:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    places: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def logits(self, x: np.ndarray, words: list[list[int]]) -> np.ndarray:
        rows = Rows.of_lists(words, np.zeros(len(words)))
        return _forward(_scaled(x, self.mean, self.scale), self.layers)[1] + sums(self.weights[rows.places], rows.sizes)

    def __call__(self, x: np.ndarray, words: list[list[int]]) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), 0.5)
        return _sigmoid(self.logits(x, words))


@dataclass
class Texts:
    """Scaled statistics and words of some texts."""

    x: np.ndarray
    words: Rows

    def __len__(self) -> int:
        return len(self.x)

    def batches(self, size: int) -> list["Texts"]:
        return [Texts(self.x[i * size : (i + 1) * size], part) for i, part in enumerate(self.words.parts(size))]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _forward(x, layers):
    a, b, c, d = layers
    h = np.tanh(x @ a + b)
    return h, (h @ c + d)[:, 0]


def _logits(t: Texts, layers, weights):
    h, z = _forward(t.x, layers)
    return h, z + sums(weights[t.words.places], t.words.sizes)


def _backward(t: Texts, h, gz, layers, k):
    gh = gz[:, None] * layers[2][:, 0] * (1 - h * h)
    return [t.x.T @ gh, gh.sum(0), (h.T @ gz)[:, None], np.array([gz.sum()]), np.bincount(t.words.places, np.repeat(gz, t.words.sizes), minlength=k)]


def fit_nnpu(p: Texts, u: Texts, prior: float | None, k: int, hidden: int = 12, steps: int = 600, batch: int = 512, l1: float = 3e-3, seed: int = 11) -> tuple[list[np.ndarray], np.ndarray]:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) by batches of both sets; prior None: plain positives against unlabelled.

    The network's layers move by Adam, the weights of the words by proximal Adagrad with an L1 penalty.
    """
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 0.4, (p.x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.4, (hidden, 1)), np.zeros(1)]
    weights, seen = np.zeros(k), np.full(k, 1e-8)
    m, s = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers]
    pi = 0.5 if prior is None else prior
    of_p, of_u = p.batches(batch), u.batches(batch)
    turns = [np.concatenate([rng.permutation(len(b)) for _ in range(-(-steps // len(b)))]) for b in (of_p, of_u)]
    for t in range(1, steps + 1):
        bp, bu = of_p[turns[0][t - 1]], of_u[turns[1][t - 1]]
        hp, zp = _logits(bp, layers, weights)
        hu, zu = _logits(bu, layers, weights)
        plus = _backward(bp, hp, (_sigmoid(zp) - 1) * pi / len(bp), layers, k)
        if prior is None:
            minus = _backward(bu, hu, _sigmoid(zu) * 0.5 / len(bu), layers, k)
            grads = [a + b for a, b in zip(plus, minus)]
        else:
            minus = [a - b for a, b in zip(_backward(bu, hu, _sigmoid(zu) / len(bu), layers, k), _backward(bp, hp, _sigmoid(zp) * pi / len(bp), layers, k))]
            negative = np.logaddexp(0, zu).mean() - pi * np.logaddexp(0, zp).mean()
            # Below zero the negative risk is over-fitted: step back from it instead.
            grads = [a + b for a, b in zip(plus, minus)] if negative >= 0 else [-b for b in minus]
        rate = 0.02 * min(1.0, 2 * (1 - t / (steps + 1)))
        for j in range(4):
            g = grads[j] + 1e-4 * layers[j]
            m[j] = 0.9 * m[j] + 0.1 * g
            s[j] = 0.999 * s[j] + 0.001 * g * g
            layers[j] = layers[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)
        seen += grads[4] ** 2
        size = 0.05 / np.sqrt(seen)
        weights = shrunk(weights - size * grads[4], size * l1)
    return layers, weights


#: Thresholds, as quantiles of the positives' scores, at which shares are compared.
LEVELS = np.linspace(0.02, 0.9, 60)


def _prior(share_p: np.ndarray, share_u: np.ndarray, n_p: int, n_u: int) -> float:
    """Share of unlabelled to share of positives above the threshold at which the upper bound of that ratio is least."""
    slack = np.sqrt(np.log(20) / (2 * n_p)) + np.sqrt(np.log(20) / (2 * n_u))
    bound = np.where(share_p > 0.05, (share_u + slack) / np.maximum(share_p, 1e-6), np.inf)
    best = int(bound.argmin())
    return float(np.clip(share_u[best] / share_p[best] if np.isfinite(bound[best]) else 1.0, 0.02, 0.98))


def _above(z: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of z reach each cut; cuts rise."""
    return len(z) - np.searchsorted(np.sort(z), cuts)


def estimate_prior(zp: np.ndarray, zu: np.ndarray) -> float:
    cuts = np.quantile(zp, LEVELS)
    return _prior(_above(zp, cuts) / len(zp), _above(zu, cuts) / len(zu), len(zp), len(zu))


def _measure(batches):
    words = Words()
    for batch in batches:
        texts = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([statistics(t) for t in texts], pa.list_(pa.float64())), pa.array([np.array(words(t), "<i4").tobytes() for t in texts], pa.binary()), batch.column(1)], ["x", "words", "half"])


def _count_above(batches, models, cuts):
    """How many texts reach each cut by the model of their half, and all texts under the number of cuts."""
    words, counts, n = [Words(m.places) for m in models], np.zeros(len(cuts), np.int64), 0
    for batch in batches:
        half = batch.column(1).to_numpy()
        texts = batch.column(0).to_pylist()
        for k, model in enumerate(models):
            own = [texts[i] for i in np.flatnonzero(half == k)]
            z = model.logits(np.array([statistics(t) for t in own]).reshape(-1, N_STATISTICS), [words[k](t) for t in own])
            counts, n = counts + _above(z, cuts), n + len(own)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts) + 1), pa.int32()), pa.array(np.append(counts, n), pa.int64())], ["cut", "n"])


def train(documents: DataFrame, labels: DataFrame, max_positives: int = 8192, max_unlabelled: int = 16_384, least: int = 5) -> QualityModel:
    """Fit on rows outside the held-out fold.

    The two bounds are the most rows the driver holds of each set, taken by hash of the id; words of under `least` of them have
    no weight. The class prior is estimated from all documents of the fold.
    """
    fold = ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()
    good = labels.where(fold & (F.col("quality") == 1)).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positives)
    other = documents.where(fold).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(max_unlabelled)
    halves = documents.where(fold).select("doc_id", "text", F.xxhash64(F.lit(2), "doc_id").bitwiseAND(1).cast("int").alias("half"))
    found = []
    for ids in (good, other):
        rows = map_arrow(halves.join(F.broadcast(ids), "doc_id").select("text", "half"), _measure, "x array<double>, words binary, half int").collect()
        rows.sort()  # the order of partitions must not change the fit
        rows = [rows[i] for i in np.random.default_rng(len(rows)).permutation(len(rows))]
        found.append((np.array([r["x"] for r in rows]).reshape(-1, N_STATISTICS), [np.frombuffer(r["words"], "<i4") for r in rows], np.array([r["half"] for r in rows], np.int64)))
    (xp, wp, hp), (xu, wu, hu) = found
    if not len(xp) or not len(xu):
        return QualityModel(0.5, np.zeros(N_STATISTICS), np.ones(N_STATISTICS), [])
    used, words = common_terms(wp + wu, BUCKETS, least)
    wp, wu, k = words[: len(wp)], words[len(wp) :], len(used)
    mean, scale = xp.mean(0), np.maximum(np.concatenate([xp, xu]).std(0), 1e-3)
    texts = lambda x, w, at: Texts(_scaled(x[at], mean, scale), Rows.of_lists([w[i] for i in np.flatnonzero(at)], np.zeros(int(at.sum()))))

    def model(prior: float, layers, weights) -> QualityModel:
        kept = np.flatnonzero(weights)
        return QualityModel(prior, mean, scale, layers, {int(used[i]): n for n, i in enumerate(kept)}, weights[kept])

    first, zp = [], []
    for half in (0, 1):
        sides = [texts(xp, wp, hp != half), texts(xu, wu, hu != half)]
        if not all(map(len, sides)):
            sides = [texts(xp, wp, hp >= 0), texts(xu, wu, hu >= 0)]
        layers, weights = fit_nnpu(*sides, None, k, steps=300)
        zp.append(_logits(texts(xp, wp, hp == half), layers, weights)[1])
        first.append(model(0.5, layers, weights))
    zp = np.concatenate(zp)
    cuts = np.quantile(zp, LEVELS)
    counts = map_arrow(halves.select("text", "half"), partial(_count_above, models=first, cuts=cuts), "cut int, n bigint").groupBy("cut").agg(F.sum("n").alias("n")).collect()
    above = np.array([r["n"] for r in sorted(counts)])
    prior = _prior(_above(zp, cuts) / len(zp), above[:-1] / above[-1], len(zp), int(above[-1]))
    everything = lambda h: np.ones(len(h), bool)
    return model(prior, *fit_nnpu(texts(xp, wp, everything(hp)), texts(xu, wu, everything(hu)), prior, k))


def _score(batches, model, text_at):
    words = Words(model.places)
    for batch in batches:
        texts = batch.column(text_at).to_pylist()
        x = np.array([statistics(t) for t in texts]).reshape(-1, N_STATISTICS)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model(x, [words(t) for t in texts]), pa.float64())], [*batch.schema.names, "score"])


def score(documents: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """documents with a column `score`, 0 to 1."""
    rest = documents.drop("score")
    return map_arrow(rest, partial(_score, model=model, text_at=rest.columns.index(text)), with_fields(rest, "score double"))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The op5 contract: doc_id, held_out, score, predicted."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
