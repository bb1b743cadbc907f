"""Toxicity: a factorization machine over hashed terms.

Terms are the words of the case-folded text and their leading 4 to 7 characters, hashed into 2^20 buckets. A second-order
factorization machine is fitted over their presence. Every bucket that a few training texts hold has a weight, and an L1
penalty, not a test of each term by itself, sets weights to zero. The factors start from the directions in which
pairs of terms explain what the linear part leaves (power iteration on the loss's second-order term, made sparse as it
goes), so terms that say nothing alone and much together are found. Weights and factors are then fitted together by
sparse minibatches.

Defined results: null text counts as empty; an empty text has the score of the bias alone; repeated rows are scored
each; other columns pass through, and an output column that clashes with one of them replaces it. With no labelled rows, or
one class only, every score is the label rate (0.5 without labels).
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
from .sparse import Rows, common_terms, shrunk, spread, sums

WORD = re.compile(r"\w+")
BUCKETS = 1 << 20
#: Words remembered by a worker before it starts anew.
REMEMBERED = 300_000


def terms(word: str) -> list[int]:
    """Buckets of a word and of its leading characters."""
    parts = {f"w:{word}"} | {f"p:{word[:n]}" for n in range(4, 8) if len(word) > n}
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in parts]


@dataclass
class FactorizationMachine:
    bias: float = 0.0
    buckets: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def score(self, present: list[int]) -> float:
        return float(self.scores([present])[0])

    def scores(self, present: list[list[int]]) -> np.ndarray:
        """Scores of texts, each given by the places of its terms in the model."""
        sizes = np.array([len(x) for x in present], np.int64)
        at = np.concatenate([np.asarray(x, np.int64) for x in present]) if len(present) else np.zeros(0, np.int64)
        z = self.bias + sums(self.weights[at], sizes) + _pairs(self.factors[at], sizes)[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _pairs(factors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group the sum of the products of all pairs of its factors, and the factors' sum."""
    total = sums(factors, sizes)
    return 0.5 * ((total * total).sum(1) - sums((factors * factors).sum(1), sizes)), total


class Presence:
    """Which chosen terms a text holds; remembers what it found for a word."""

    def __init__(self, buckets: dict[int, int]):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str | None) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, found = self.known, set()
        for word in set(WORD.findall((text or "").lower())):
            at = known.get(word)
            if at is None:
                at = known[word] = tuple({self.buckets[b] for b in terms(word) if b in self.buckets})
            if at:
                found.update(at)
        return sorted(found)


class Fit:
    """The state of a machine that is being fitted: parameters and the squares of their gradients (Adagrad)."""

    def __init__(self, bias: float, k: int, rank: int):
        self.bias, self.w, self.v = bias, np.zeros(k, np.float32), np.zeros((k, rank), np.float32)
        self.seen_bias, self.seen_w, self.seen_v = 1e-8, np.full(k, 1e-8, np.float32), np.full(k, 1e-8, np.float32)

    def logits(self, rows: Rows, paired: Rows | None) -> np.ndarray:
        z = self.bias + sums(self.w[rows.places], rows.sizes)
        return z if paired is None else z + _pairs(self.v[paired.places], paired.sizes)[0]

    def loss(self, parts: list[tuple[Rows, Rows | None]]) -> float:
        z = np.concatenate([self.logits(*p) for p in parts])
        y = np.concatenate([p[0].labels for p in parts])
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def step(self, rows: Rows, paired: Rows | None, rate: float, l1: float, group: float) -> None:
        """A proximal Adagrad step: L1 on the weights, the L2 norm of each term's factors as a group."""
        g = ((1 / (1 + np.exp(-np.clip(self.logits(rows, paired), -30, 30))) - rows.labels) / len(rows)).astype(np.float32)
        dw = np.bincount(rows.places, np.repeat(g, rows.sizes), minlength=len(self.w)).astype(np.float32)
        self.seen_w += dw * dw
        size = rate / np.sqrt(self.seen_w)
        moved = self.w - size * dw
        self.w = shrunk(moved, size * l1)
        if paired is not None and len(paired.places):
            v = self.v[paired.places]
            of = paired.of()
            dv = spread(paired.places, g[of][:, None] * (sums(v, paired.sizes)[of] - v), len(self.w))
            self.seen_v += (dv * dv).mean(1)
            size = 0.2 * rate / np.sqrt(self.seen_v)
            moved = self.v - size[:, None] * dv
            norm = np.sqrt((moved * moved).sum(1))
            self.v = moved * np.maximum(1 - size * group / np.maximum(norm, 1e-12), 0)[:, None]
        self.seen_bias += float(g.sum()) ** 2
        self.bias -= rate * float(g.sum()) / self.seen_bias**0.5


def pair_directions(parts: list[Rows], residuals: list[np.ndarray], k: int, rank: int, kept: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Factors along which pairs of terms explain the residuals best, by power iteration; later rounds keep ever fewer terms, at last `kept`."""
    single = sum(np.bincount(p.places, np.repeat(g, p.sizes), minlength=k) for p, g in zip(parts, residuals)).astype(np.float32)

    def times(u):
        out = -single[:, None] * u
        for p, g in zip(parts, residuals):
            out += spread(p.places, (sums(u[p.places], p.sizes) * g[:, None])[p.of()], k)
        return out

    u = np.random.default_rng(seed).normal(0, 1, (k, rank)).astype(np.float32)
    for i in range(rounds):
        u = np.linalg.qr(times(u))[0].astype(np.float32)
        u = np.pad(u, ((0, 0), (0, rank - u.shape[1])))
        room = kept << (rounds - 1 - i)
        if i >= rounds // 2 and room < k:
            norm = (u * u).sum(1)
            u[norm < np.partition(norm, -room)[-room]] = 0
    inner = u.T @ times(u)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values = np.maximum(values, 0)
    return (u @ turn * np.sqrt(values / max(values.max(), 1e-12))).astype(np.float32)


def fit_machine(rows: list, labels: np.ndarray, buckets: list[int], rank: int = 4, steps: int = 3000, seed: int = 7, rate: float = 0.1, l1: float = 2e-4, group: float = 1e-3, factored: int = 512) -> FactorizationMachine:
    """Fit on rows of places in buckets; every tenth row chooses the epoch. `factored` terms get factors, all get weights."""
    n, k = len(rows), len(buckets)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    machine = FactorizationMachine(bias, {b: i for i, b in enumerate(buckets)}, np.zeros(k), np.zeros((k, rank)))
    if not n or not k or labels.min() == labels.max():
        return machine
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    data = Rows.of_lists([rows[i] for i in order], np.asarray(labels)[order])
    held = n // 10 if n >= 50 else 0
    batches, tests = data.part(held, n).parts(128), (data.part(0, held) if held else data).parts(1024)
    fit = Fit(bias, k, rank)
    best = (fit.loss([(t, None) for t in tests]), fit.bias, fit.w, fit.v)
    for epoch in range(6):  # the linear part alone, as far as it holds on rows that it has not seen
        for i in rng.permutation(len(batches)):
            fit.step(batches[i], None, rate / 2, 1e-3, group)
        best = min(best, (fit.loss([(t, None) for t in tests]), fit.bias, fit.w, fit.v), key=lambda x: x[0])
    fit.bias, fit.w = best[1:3]
    residuals = [((b.labels - 1 / (1 + np.exp(-np.clip(fit.logits(b, None), -30, 30)))) / n).astype(np.float32) for b in batches]
    start = pair_directions(batches, residuals, k, rank, factored, seed=seed)
    live = np.abs(start).sum(1) > 0
    batches, tests = [(b, b.only(live)) for b in batches], [(t, t.only(live)) for t in tests]
    tried = []
    for scale in (0.03, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5):
        fit.v = scale * start
        tried.append((fit.loss(batches), scale))
    fit.v = min(tried)[1] * start
    for epoch in range(max(8, -(-steps // len(batches)))):
        for i in rng.permutation(len(batches)):
            fit.step(*batches[i], rate, l1, group)
        best = min(best, (fit.loss(tests), fit.bias, fit.w, fit.v), key=lambda x: x[0])
    _, machine.bias, machine.weights, machine.factors = best[0], float(best[1]), best[2].astype(float), best[3].astype(float)
    return machine


def _present(batches):
    """The buckets of each text's terms, sorted, as little-endian 32-bit integers, and its label."""
    known: dict[str, list[int]] = {}
    for batch in batches:
        found = []
        for text in batch.column(0).to_pylist():
            held: set[int] = set()
            for word in set(WORD.findall((text or "").lower())):
                own = known.get(word)
                if own is None:
                    own = known[word] = terms(word)
                held.update(own)
            if len(known) > REMEMBERED:
                known.clear()
            found.append(np.array(sorted(held), "<i4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["present", "label"])


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 16_384, least: int = 5) -> FactorizationMachine:
    """Fit on labelled rows outside the held-out fold: all of them, or max_rows of them by hash of the id.

    max_rows bounds what the driver ever holds. A term in under `least` of these texts, or in all of them, is not used.
    """
    chosen = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    rows = map_arrow(texts, _present, "present binary, label int").collect()
    rows.sort()  # the order of partitions must not change the fit
    y = np.array([r["label"] for r in rows])
    used, held = common_terms([np.frombuffer(r["present"], "<i4") for r in rows], BUCKETS, least)
    machine = fit_machine(held, y, used.tolist())
    # Terms that the penalties left out need not travel.
    kept = np.flatnonzero((machine.weights != 0) | (np.abs(machine.factors).sum(1) > 0))
    return FactorizationMachine(machine.bias, {int(used[i]): n for n, i in enumerate(kept)}, machine.weights[kept], machine.factors[kept])


def _score(batches, machine, text_at):
    find = Presence(machine.buckets)
    for batch in batches:
        scores = machine.scores([find(t) for t in batch.column(text_at).to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])


def score(documents: DataFrame, machine: FactorizationMachine, text: str = "text") -> DataFrame:
    """documents with a column `score`, 0 to 1."""
    rest = documents.drop("score")
    return map_arrow(rest, partial(_score, machine=machine, text_at=rest.columns.index(text)), with_fields(rest, "score double"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The op1 contract: doc_id, held_out, score, predicted."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of documents that score under the threshold."""
    machine = train(documents, labels)
    columns = documents.columns
    return score(documents.drop("score"), machine).where(F.col("score") < threshold).select(*columns) if "score" not in columns else documents.join(score(documents.select("doc_id", "text"), machine).where(F.col("score") >= threshold).select("doc_id").distinct(), "doc_id", "left_anti").select(*columns)
