"""Quality by ordinal regression: a cumulative-link model over hashed words.

``P(grade > k) = sigmoid(w . x - t_k)`` with one weight vector for all grades and ordered
thresholds ``t_0 < t_1 < ...``. The expected grade is the sum of these tail probabilities,
and one of them decides which documents are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Step, append_steps, emitted

_tokens = re.compile(r"\w+|[^\w\s]+").findall


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample that the model is fitted on, and how it is fitted."""

    sample_rows: int = 9_000  #: rated rows about, chosen by a hash of the id
    bits: int = 22  #: tokens are hashed to 2 ** bits slots
    least_rows: int = 15  #: sampled rows that a slot must occur in to be tested
    error: float = 0.05  #: chance that a slot without effect passes the test, all tested slots together
    steps: int = 100
    ridge: float = 1e-4


class Features:
    """Hashed tokens and word beginnings of a text with damped counts, and measures of its shape."""

    def __init__(self, bits: int):
        self.mask, self.cache = (1 << bits) - 1, {}

    def slots(self, token: str) -> tuple[int, ...]:
        """The slots of a token and of its first four and five characters."""
        at = self.cache.get(token)
        if at is None:
            if len(self.cache) >= 200_000:
                self.cache.clear()
            parts = [token, *(f"{token[:n]}~" for n in (4, 5) if len(token) > n)]
            at = tuple(zlib.crc32(p.encode()) & self.mask for p in parts)
            if len(token) <= 64:
                self.cache[token] = at
        return at

    def __call__(self, text: str | None) -> dict[int, float]:
        tokens = _tokens(text.lower()) if text else []
        if not tokens:
            return {}
        counts, slots, total = Counter(tokens), self.slots, len(tokens)
        sums: dict[int, int] = {}
        for token, n in counts.items():
            for at in slots(token):
                sums[at] = sums.get(at, 0) + n
        out = {at: 1.0 if n == 1 else 1.0 + math.log(n) / 2 for at, n in sums.items()}
        marks = sum(n for t, n in counts.items() if not t[0].isalnum())
        shape = {"#marks": marks / total, "#few": 1.0 / (1.0 + math.log1p(total)), "#repeat": 1.0 - len(counts) / total}
        for name, value in shape.items():
            out[slots(name)[0]] = value
        return out


@dataclass(frozen=True)
class Model:
    """Weights of the slots that have one, shared by all grades, and the thresholds between them."""

    bits: int
    weights: dict[int, float]
    thresholds: np.ndarray

    def tails(self, features: dict[int, float]) -> np.ndarray:
        """P(grade > k) for each k."""
        weights = self.weights
        score = sum(weights[at] * v for at, v in features.items() if at in weights)
        return _sigmoid(score - self.thresholds)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_rows(texts: list[str], grades: list[int], levels: int, how: Fit = Fit()) -> Model:
    """The model of greatest likelihood, weights held by a ridge."""
    features = Features(how.bits)
    rows = [features(text) for text in texts]
    return fit_features([(np.fromiter(r.keys(), np.int32, len(r)), np.fromiter(r.values(), np.float32, len(r))) for r in rows], grades, levels, how)


def fit_features(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], levels: int, how: Fit = Fit()) -> Model:
    """As ``fit_rows``, from each text's slots and their values."""
    at = np.concatenate([r[0] for r in rows] or [np.empty(0, np.int32)])
    of = np.concatenate([r[1] for r in rows] or [np.empty(0, np.float32)])
    own = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    slots, at, seen = np.unique(at, return_inverse=True, return_counts=True)
    common = _telling(at, own, np.asarray(grades, np.int64), seen, levels, how)
    kept = common[at]
    slots, at, of, own = slots[common], (np.cumsum(common) - 1)[at[kept]], of[kept], own[kept]
    y, size, gaps = np.asarray(grades, np.int64), len(slots), levels - 1
    loss = likelihood(at, of, own, y, size, levels, how.ridge)
    # thresholds are a first one and the logs of the gaps after it, so they stay ordered
    theta = _least(loss, np.zeros(size + gaps), how.steps) if len(rows) else np.zeros(size + gaps)
    return Model(how.bits, dict(zip(slots.tolist(), theta[:size].tolist(), strict=True)), _cuts(theta, size))


def likelihood(at: np.ndarray, of: np.ndarray, own: np.ndarray, y: np.ndarray, size: int, levels: int, ridge: float):
    """The function to make least: of weights, a first threshold and the logs of the gaps between thresholds.

    Entry i says that slot ``at[i]`` has the value ``of[i]`` in row ``own[i]``, whose grade is ``y[own[i]]``.
    """
    gaps, rows = levels - 1, len(y)
    everyone, edge, n = np.arange(rows), np.zeros((rows, 1)), max(1, rows)

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean negative log-likelihood with its ridge, and its gradient."""
        z = np.bincount(own, of * theta[at], rows)
        over = _sigmoid(z[:, None] - _cuts(theta, size)[None, :])
        tail = np.concatenate([edge + 1, over, edge], 1)
        slope = np.concatenate([edge, over * (1 - over), edge], 1)
        p = np.maximum(tail[everyone, y] - tail[everyone, y + 1], 1e-12)
        lower, upper = slope[everyone, y] / p / n, slope[everyone, y + 1] / p / n
        to_cut = np.zeros((rows, gaps + 2))
        to_cut[everyone, y] += lower
        to_cut[everyone, y + 1] -= upper
        to_cut = to_cut[:, 1:-1].sum(0)
        grad = np.zeros_like(theta)
        grad[:size] = np.bincount(at, of * (upper - lower)[own], size) + ridge * theta[:size]
        grad[size] = to_cut.sum()
        for k in range(1, gaps):
            grad[size + k] = to_cut[k:].sum() * math.exp(theta[size + k])
        return float(-np.log(p).sum() / n + ridge / 2 * (theta[:size] @ theta[:size])), grad

    return loss


def _telling(at: np.ndarray, own: np.ndarray, grades: np.ndarray, seen: np.ndarray, levels: int, how: Fit) -> np.ndarray:
    """The slots, however many, whose rows differ from the others in P(grade > k) for some k.

    The test's level is ``how.error`` for all tested slots together, by Bonferroni.
    """
    kept, tested = np.zeros(len(seen), bool), seen >= how.least_rows
    if not tested.any():
        return kept
    cut = NormalDist().inv_cdf(1 - how.error / 2 / np.count_nonzero(tested))
    for k in range(levels - 1):
        over = grades > k
        share = over.mean()
        z = np.abs(np.bincount(at, over[own], len(seen)) - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
        kept |= tested & (z >= cut)
    return kept


def _least(loss, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """A minimum by L-BFGS with a halving line search."""
    value, grad = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        direction, alphas = -grad, []
        for s, y, r in reversed(pairs):
            alphas.append(r * (s @ direction))
            direction = direction - alphas[-1] * y
        if pairs:
            s, y, r = pairs[-1]
            direction = direction / (r * (y @ y))
        for (s, y, r), alpha in zip(pairs, reversed(alphas), strict=True):
            direction = direction + (alpha - r * (y @ direction)) * s
        slope = grad @ direction
        if slope >= -1e-12:
            break
        size = 1.0 if pairs else min(1.0, 1.0 / np.abs(grad).sum())
        while True:
            new_value, new_grad = loss(x + size * direction)
            if new_value <= value + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, y = size * direction, new_grad - grad
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y, 1.0 / (s @ y))]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, grad = x + s, new_value, new_grad
        if done:
            break
    return x


def _cuts(theta: np.ndarray, size: int) -> np.ndarray:
    return theta[size] + np.concatenate([[0.0], np.cumsum(np.exp(theta[size + 1 :]))])


def sampled(rated: DataFrame, key: str = "doc_id", how: Fit = Fit()) -> DataFrame:
    """About ``how.sample_rows`` of the ratings, chosen by a hash of the id (null ids never)."""
    n = rated.select(F.lit(1)).count()
    share = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(1 << 20))
    return rated.where(F.col(f"`{key}`").isNotNull() & (share < F.lit(math.ceil((1 << 20) * min(1.0, how.sample_rows / max(1, n))))))


def _feature_rows(bits: int):
    def make():
        features = Features(bits)

        def work(texts, grades):
            for t, g in zip(texts, grades, strict=True):
                row = features(t)
                yield g, list(row), list(row.values())

        return work

    return make


def fit(rated: DataFrame, levels: int, text: str = "text", grade: str = "grade", how: Fit = Fit()) -> Model:
    """The model from rows with a text and a grade from 0 to ``levels`` - 1, at most twice ``how.sample_rows``.

    What comes to the driver are the rows' hashed words, not their texts.
    """
    t, g = F.col(f"`{text}`"), F.col(f"`{grade}`")
    rows = rated.where(t.isNotNull() & g.isNotNull() & (g >= 0) & (g < levels)).select(t.alias("t"), g.cast("int").alias("g")).limit(2 * how.sample_rows)
    got = emitted(rows, ["t", "g"], _feature_rows(how.bits), "g int, at array<int>, of array<float>").toArrow()
    arrays = [[x.values.to_numpy() for x in got.column(name)] for name in ("at", "of")]
    return fit_features(list(zip(*arrays, strict=True)), got.column("g").to_pylist(), levels, how)


FIELDS = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probs", T.ArrayType(T.DoubleType()))]


def graded(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade and tail_probs (P(grade > k) for each k).

    A null or empty text is scored by the thresholds alone; a very long one by all its
    words; repeated rows and texts with the same words tie; an empty table gives an empty
    one; columns named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        features = Features(own.bits)

        def work(texts):
            for t in texts:
                tails = own.tails(features(t))
                yield float(tails.sum()), tails.tolist()

        return work

    return append_steps(docs, Step([text], make, FIELDS))
