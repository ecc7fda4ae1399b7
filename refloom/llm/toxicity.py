"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of the whole text: words, and their first
four and five letters, hashed into 2**18 buckets. The pairwise part sees combinations (an insult together with a group)
that additive weights miss. The machine has up to ``FEATURES`` buckets by their own effect on the label and up to
``BY_PAIRS`` more by the effect of a pair, so a bucket that matters only beside another one is in it too. Other buckets say nothing about
the label in the sample and are left out, so long texts don't drift.

Nulls and empty texts have no terms: their score is sigmoid(w0). Repeated rows score alike, a row each. An empty table gives
no rows. Without labelled rows of both classes every score is 0.5. Where an id has several label rows, the smallest label
counts. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.base import LETTERS, held_out, labelled_sample, prepare

PER_CLASS, MAX_CHARS = 2500, 20_000
BUCKETS, FEATURES, BY_PAIRS, RANK, STEPS = 1 << 18, 1024, 128, 6, 120
#: Buckets of which all pairs are tested, the most frequent ones of the sample; effects (squared z) from which one counts,
#: and rows that a pair needs in common.
PAIRED, OWN_EFFECT, PAIR_EFFECT, MET = 4096, 8.0, 40.0, 8
#: Penalties of single and pairwise weights that are tried on every fifth row of the sample, none of it held out.
PENALTIES = ((1e-4, 1e-3), (1e-3, 1e-3), (1e-4, 1e-2))
_CACHE = 400_000


def term_buckets(word: str) -> tuple[int, ...]:
    terms = {f"w{word}"} | {f"{k}{word[:k]}" for k in (4, 5) if len(word) >= k}
    return tuple(crc32(t.encode()) % BUCKETS for t in terms)


@dataclass
class ToxicityModel:
    index: dict[int, int]
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, features: list[int]) -> float:
        z = self.w0
        if features:
            v = self.v[features]
            z += float(self.w[features].sum()) + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return 1 / (1 + float(np.exp(-min(30.0, max(-30.0, z)))))


def _fit(x: np.ndarray, y: np.ndarray, rank: int, steps: int, penalties: tuple[float, float] = PENALTIES[0]) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, Adam on the whole sample; both parts are regularised."""
    rng = np.random.default_rng(7)
    p = [np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))], dtype=np.float32), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.05, (x.shape[1], rank)).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        xv = x @ p[2]
        z = p[0][0] + x @ p[1] + 0.5 * ((xv**2).sum(1) - x @ (p[2] ** 2).sum(1))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        xe = x.T @ e
        grads = [np.array([e.sum()]), xe + penalties[0] * p[1], x.T @ (e[:, None] * xv) - p[2] * xe[:, None] + penalties[1] * p[2]]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g**2
            p[i] = (p[i] - (0.08 if i < 2 else 0.02) * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return float(p[0][0]), p[1], p[2]


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Learn from a bounded sample (see base.labelled_sample)."""
    prepare(docs.sparkSession)
    rows = labelled_sample(docs, labels, "toxic", per_class, max_chars)
    y = rows.y.to_numpy(dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, 0.0, np.zeros(0, np.float32), np.zeros((0, RANK), np.float32))
    sets = [{b for w in set(LETTERS.findall(t.lower())) for b in term_buckets(w)} for t in rows.text]
    penalties = _choose_penalties(sets, y)
    index = {b: i for i, b in enumerate(choose_buckets(sets, y))}
    return ToxicityModel(index, *_fit(_matrix(sets, index), y, RANK, STEPS, penalties))


def _choose_penalties(sets: list[set[int]], y: np.ndarray) -> tuple[float, float]:
    """Those of ``PENALTIES`` with the smallest loss on every fifth row of a label after learning from the others; buckets are those of
    the others too. The first ones where a label has under five rows."""
    tried = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        tried[np.flatnonzero(y == label)[4::5]] = True
    if len(set(y[tried])) < 2:
        return PENALTIES[0]
    learned, rest = ([s for s, t in zip(sets, tried, strict=True) if t == side] for side in (False, True))
    index = {b: i for i, b in enumerate(choose_buckets(learned, y[~tried]))}
    x, x_rest = _matrix(learned, index), _matrix(rest, index)

    def loss(penalties: tuple[float, float]) -> float:
        w0, w, v = _fit(x, y[~tried], RANK, STEPS, penalties)
        z = w0 + x_rest @ w + 0.5 * (((x_rest @ v) ** 2).sum(1) - x_rest @ (v**2).sum(1))
        return float(np.logaddexp(0, np.where(y[tried] == 1, -z, z)).mean())

    return min(PENALTIES, key=loss)


def _matrix(sets: list[set[int]], index: dict[int, int]) -> np.ndarray:
    x = np.zeros((len(sets), len(index)), dtype=np.float32)
    for i, s in enumerate(sets):
        x[i, [index[b] for b in s if b in index]] = 1
    return x


def choose_buckets(sets: list[set[int]], y: np.ndarray) -> list[int]:
    """Buckets with an effect on the label, by themselves or in a pair, strongest first."""
    count = np.zeros((2, BUCKETS), dtype=np.float32)
    for s, label in zip(sets, y, strict=True):
        count[int(label), list(s)] += 1
    seen, n = count.sum(0), len(y)
    rate = count / np.array([(y == 0).sum(), (y == 1).sum()], dtype=np.float32)[:, None]
    both = seen / n
    strength = (rate[1] - rate[0]) ** 2 / np.maximum(both * (1 - both), 1e-6)
    strength[seen < 3] = 0
    chosen = [int(b) for b in np.argsort(-strength, kind="stable")[:FEATURES] if strength[b] > OWN_EFFECT / n]

    # the effect of a pair beyond those of its members: the mean of (y - mean)(a - mean)(b - mean), as a z value
    often = np.argsort(-seen, kind="stable")[:PAIRED]
    often = often[(seen[often] >= 3) & (seen[often] < n)]
    x = _matrix(sets, {int(b): i for i, b in enumerate(often)})
    raw = x.copy()
    x -= x.mean(0)
    x /= np.sqrt((x**2).mean(0))
    error = (y - y.mean())[:, None] / float(y.std())
    known = np.isin(often, chosen)
    pairs = []
    for lo in range(0, len(often), 256):
        z2 = (x[:, lo : lo + 256].T @ (x * error)) ** 2 / n
        z2[raw[:, lo : lo + 256].T @ raw < MET] = 0
        z2[known[lo : lo + 256, None] & known[None, :]] = 0
        i, j = np.nonzero(z2 > PAIR_EFFECT)
        ahead = lo + i < j
        pairs += zip((-z2[i[ahead], j[ahead]]).tolist(), (lo + i[ahead]).tolist(), j[ahead].tolist(), strict=True)
    found = dict.fromkeys(chosen)
    for _, i, j in sorted(pairs):
        new = [b for b in (int(often[i]), int(often[j])) if b not in found]
        if len(found) + len(new) <= len(chosen) + BY_PAIRS:
            found.update(dict.fromkeys(new))
    return list(found)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each input row."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}

        def features(word: str) -> tuple[int, ...]:
            if len(known) >= _CACHE:
                known.clear()
            known[word] = found = tuple(model.index[b] for b in term_buckets(word) if b in model.index)
            return found

        for texts in batches:
            out = []
            for t in texts:
                found: set[int] = set()
                for w in set(LETTERS.findall((t or "").lower())):
                    hit = known.get(w)
                    if hit := features(w) if hit is None else hit:
                        found.update(hit)
                out.append(model.score(sorted(found)))
            yield pd.Series(out, dtype="float64")

    prepare(docs.sparkSession)
    return docs.select("doc_id", score("text").alias("score")).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
