"""Quality classifier: two zstandard dictionaries, one of good and one of bad text; whichever compresses a text better tells its kind.

d = (bytes under the bad dictionary - bytes under the good one) / bytes of the text, the normalised compressed-size
difference, becomes a score by logistic calibration; nothing else goes into it. (Over the text's own bytes, a text that
shrinks to nothing under either dictionary, one word again and again, has next to no difference; over the sum of the
compressed sizes it would have a chance one.) A text of a few words shows no difference because it is too short to be
compressed, so every text counts as if ``usual_bytes`` bytes of usual text, of the labelled sample's mean difference, came
with it. Whole texts are compressed, in blocks of ``BLOCK`` bytes so that the
dictionary keeps its weight in long texts. The dictionaries' size and the bytes of usual text are those of ``DICTIONARIES`` and
``USUALS`` that rank the calibrating half of the sample best; held-out rows have no part in it.

Nulls and empty texts: no bytes, so d is the mean difference and the score is the calibration's value there. Rows with a null id are scored
as any other. Repeated rows are scored alike, one output row for each. An empty table gives no rows. Without labelled rows
of both classes every score is 0.5. Where an id has several label rows, the smallest label counts. Columns of the input
other than doc_id and text are ignored, or kept as they are by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.base import free_name, held_out, labelled_sample, prepare

#: The sample that is learned from: rows of each label, characters of a row. Half trains dictionaries, half calibrates.
PER_CLASS, MAX_CHARS = 1500, 50_000
BLOCK, LEVEL = 512, 3
#: Settings that are tried on the half that calibrates, none of it held out: bytes of a dictionary, bytes of usual text.
DICTIONARIES, USUALS = (40_000, 112_640), (16, 64, 256)


def _dictionary(texts: list[str], size: int) -> bytes:
    samples = [b[i : i + BLOCK] for b in (t.encode("utf-8", "replace") for t in texts) for i in range(0, len(b), BLOCK)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their text itself serves
        return b"".join(samples)[-size:]


@dataclass
class Sizes:
    """Compressed sizes of texts under one dictionary."""

    content: bytes
    level: int = LEVEL

    def __post_init__(self):
        data = zstandard.ZstdCompressionDict(self.content) if self.content else None
        if data is not None:
            data.precompute_compress(level=self.level)
        self.z = zstandard.ZstdCompressor(level=self.level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def of(self, raw: bytes, block: int = BLOCK) -> int:
        return sum(len(self.z.compress(raw[i : i + block])) for i in range(0, len(raw), block))


def difference(text: str | None, good: Sizes, bad: Sizes, usual: float = 0.0, usual_bytes: int = USUALS[0]) -> float:
    """The normalised size difference of a text."""
    raw = (text or "").encode("utf-8", "replace")
    return (bad.of(raw) - good.of(raw) + usual_bytes * usual) / (len(raw) + usual_bytes)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    usual: float = 0.0
    usual_bytes: int = USUALS[0]

    def score(self, d) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(d, dtype=np.float64) * self.slope + self.offset, -30, 30)))


def _calibrate(d: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number by Newton's method, lightly regularised."""
    scale = max(float(d.std()), 1e-6)
    x = np.column_stack([d / scale, np.ones(len(d))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = weight * p * (1 - p) + 1e-9
        step = np.linalg.solve((x * s[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (weight * (y - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> QualityModel:
    """Learn from a bounded sample (see base.labelled_sample). labels, lang, source and doc_id are never inputs."""
    prepare(docs.sparkSession)
    rows = labelled_sample(docs, labels, "quality", per_class, max_chars)
    share = labels.where(~held_out() & F.col("quality").isin(0, 1)).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    by = {y: list(rows.text[rows.y == y]) for y in (0, 1)}
    if len(by[0]) < 2 or len(by[1]) < 2:
        return QualityModel(b"", b"", 0.0, 0.0)
    fit, rest = {y: t[0::2] for y, t in by.items()}, {y: t[1::2] for y, t in by.items()}
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weight = np.where(y == 1, share / len(rest[1]), (1 - share) / len(rest[0])) * len(y)
    best = None
    for size in DICTIONARIES:
        good, bad = (_dictionary(fit[k], size) for k in (1, 0))
        g, b = Sizes(good), Sizes(bad)
        sizes = [[(g.of(raw), b.of(raw), len(raw)) for raw in (t.encode("utf-8", "replace") for t in rest[k])] for k in (0, 1)]
        means = [np.mean([(v - u) / max(1, n) for u, v, n in rows]) for rows in sizes]
        usual = float((1 - share) * means[0] + share * means[1])
        for usual_bytes in USUALS:
            d = np.array([(v - u + usual_bytes * usual) / (n + usual_bytes) for rows in sizes for u, v, n in rows])
            ranked = _ranking(d, y)
            if best is None or ranked > best[0]:
                best = ranked, QualityModel(good, bad, *_calibrate(d, y, weight), usual, usual_bytes)
    return best[1]


def _ranking(d: np.ndarray, y: np.ndarray) -> float:
    """How often a good text stands above a bad one; ties count half (area under the curve)."""
    _, place, n = np.unique(d, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    good = y == 1
    return float((rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, and the size difference they rest on: one row for each input row."""
    prepare(docs.sparkSession)
    return (
        docs.select("doc_id", _scorer(model)("text").alias("found"))
        .select("doc_id", held_out().alias("held_out"), "found.score", "found.size_difference")
        .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "size_difference")
    )


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, with the columns they came with. Null and empty texts get the
    calibration's value at the mean difference; repeated rows stay or go together."""
    prepare(docs.sparkSession)
    found = free_name(docs, "quality")
    return docs.withColumn(found, _scorer(model)("text")).where(F.col(found)["score"] >= threshold).drop(found)


def _scorer(model: QualityModel):
    @F.pandas_udf("score double, size_difference double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        good, bad = Sizes(model.good), Sizes(model.bad)
        for texts in batches:
            d = np.array([difference(t, good, bad, model.usual, model.usual_bytes) for t in texts], dtype=np.float64)
            yield pd.DataFrame({"score": model.score(d), "size_difference": d})

    return score
