"""Hard negatives by product quantisation: for each anchor its best rows of the same label (positives), and for each of these
the best rows of other labels whose score lies in a window below the positive's.

1. A vector becomes integers, floor(scale * x). Its components, two by two, are coded by the nearest of 256 integer centroids
   (learned from at most 2 * ``SAMPLE`` rows, taken by a hash of their id); every row is coded, and the norm of what the code leaves
   out, its residual, is stored beside the code.
2. An anchor has a table of its inner products with all centroids. The sum of a row's entries is an integer score, off from
   the exact one by at most |anchor| * |residual| (Cauchy-Schwarz). Rows whose upper bound is below the k-th best lower bound, or
   whose bounds miss the window, are left out: no row of the result can be among them, so recall is 1 by construction.
3. The rest is scored by exact integer inner products, and the best of each window are kept.

Anchors and rows meet in blocks: a group holds one block of each, whatever a label's share of the rows. A block gives its best
k for each anchor or window, and the best of these are taken over all blocks. The work is anchors times rows, as the task states
it; rows shuffled are that over the block size.

Rows without an id, label or vector, or with a null or non-finite component, take no part. Shorter vectors are filled up with zeros.
Rows that repeat an id count once, with the smallest label and vector. Scaled components beyond the square root of 2**62 over
their number are set to it, so that scores fit 64 bits. Positives of a negative score have no window. Empty vectors score 0. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.base import prepare

SUB, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 4096, 8
ROW_BLOCK, ANCHOR_BLOCK, AT_ONCE = 8192, 8192, 32


def integers(vectors: pd.Series, scale: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each vector has finite components only, and floor(scale * x) of those that do, filled up with zeros."""
    most = min(2**31 - 1, math.isqrt(2**62 // max(1, dims)))
    fine, out = np.zeros(len(vectors), dtype=bool), []
    for i, v in enumerate(vectors):
        x = np.asarray(v, dtype=np.float64)
        if np.isfinite(x).all():
            fine[i] = True
            q = np.zeros(dims, dtype=np.int64)
            q[: len(x)] = np.clip(np.floor(np.clip(x, -1e300, 1e300) * scale), -most, most)
            out.append(q)
    return fine, np.array(out, dtype=np.int64).reshape(-1, dims)


def parts(q: np.ndarray) -> np.ndarray:
    """Rows of integers as (rows, subspaces, SUB), filled up with zeros."""
    n, d = q.shape
    m = max(1, -(-d // SUB))
    return np.pad(q, ((0, 0), (0, m * SUB - d))).reshape(n, m, SUB)


def fit_codebook(q: np.ndarray) -> np.ndarray:
    """Integer centroids (subspaces, CENTROIDS, SUB) of a sample, by Lloyd's rounds from points spread over the sorted sample."""
    p = parts(q).astype(np.float64)
    book = np.zeros((p.shape[1], CENTROIDS, SUB))
    for m in range(p.shape[1]):
        x = p[:, m]
        points = np.unique(x, axis=0)
        if not len(points):
            continue
        c = points[np.linspace(0, len(points) - 1, CENTROIDS).astype(int)]
        for _ in range(ROUNDS):
            near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            count = np.bincount(near, minlength=CENTROIDS)
            for s in range(SUB):
                total = np.bincount(near, weights=x[:, s], minlength=CENTROIDS)
                c[:, s] = np.where(count > 0, total / np.maximum(1, count), c[:, s])
        book[m] = c
    return np.rint(book).astype(np.int64)


def encode(q: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, subspaces) and the norms of the residuals."""
    p = parts(q)
    codes = np.zeros(p.shape[:2], dtype=np.uint8)
    rest = np.zeros(len(q))
    for m in range(p.shape[1]):
        x, c = p[:, m].astype(np.float64), book[m].astype(np.float64)
        codes[:, m] = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        rest += ((x - c[codes[:, m]]) ** 2).sum(1)
    return codes, np.sqrt(rest)


def bounds(anchors: np.ndarray, codes: np.ndarray, residuals: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (rows, anchors) of the integer inner products, from look-up tables and residual norms."""
    tables = np.ascontiguousarray(np.einsum("ams,mks->mka", parts(anchors), book))
    score = np.zeros((len(codes), len(anchors)), dtype=np.int64)
    for m in range(codes.shape[1]):
        score += tables[m].take(codes[:, m], axis=0)
    norms = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
    off = np.ceil(np.outer(residuals, norms) * (1 + 1e-9)).astype(np.int64) + 1
    return score - off, score + off


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _ints(column: pd.Series, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), width)


def _unpack(rows: pd.DataFrame, anchors: pd.DataFrame, dims: int, book: np.ndarray):
    """Both sides of a group: rows as (ids, integers, codes, residuals), anchors as (ids, integers), and labels as numbers."""
    labels = pd.factorize(pd.concat([rows.label, anchors.label], ignore_index=True))[0]
    own = (rows.vec_id.to_numpy(), _ints(rows.q, np.int32, dims).astype(np.int64), _ints(rows.codes, np.uint8, len(book)), rows.residual.to_numpy())
    return own, (anchors.vec_id.to_numpy(), _ints(anchors.q, np.int32, dims).astype(np.int64)), labels[: len(rows)], labels[len(rows) :]


def _best_of_same_label(book: np.ndarray, dims: int, k: int):
    def search(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            (ids, q, codes, residuals), (names, a), label, of = _unpack(rows, anchors, dims, book)
            for kind in np.unique(of):
                mine = np.flatnonzero(label == kind)
                if not len(mine):
                    continue
                asking = np.flatnonzero(of == kind)
                for at in range(0, len(asking), AT_ONCE):
                    some = asking[at : at + AT_ONCE]
                    low, high = bounds(a[some], codes[mine], residuals[mine], book)
                    for c, i in enumerate(some):
                        other = ids[mine] != names[i]
                        lows = low[other, c]
                        keep = other
                        if len(lows) > k:
                            keep = other & (high[:, c] >= np.partition(lows, -k)[-k])
                        found = mine[keep]
                        exact = q[found] @ a[i]
                        out += [(names[i], ids[found[j]], exact[j]) for j in best(exact, ids[found], k)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"], dtype="int64")

    return search


def window_candidates(low: np.ndarray, high: np.ndarray, bottom: int, top: int, k: int) -> np.ndarray:
    """Which rows may be among the first k with a score of bottom to top: bounds that meet the window, and no k rows surely before."""
    may = (high >= bottom) & (low <= top)
    sure = low[may & (low >= bottom) & (high <= top)]
    if len(sure) > k:
        may &= high >= np.partition(sure, -k)[-k]
    return may


def _best_of_windows(book: np.ndarray, dims: int, k: int, lowest: int, highest: int):
    def search(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            (ids, q, codes, residuals), (names, a), label, of = _unpack(rows, anchors, dims, book)
            positives = anchors.positives.tolist()
            for at in range(0, len(names), AT_ONCE):
                low, high = bounds(a[at : at + AT_ONCE], codes, residuals, book)
                for c in range(low.shape[1]):
                    i = at + c
                    other = np.flatnonzero(label != of[i])
                    lo, hi = low[other, c], high[other, c]
                    windows = [(p["positive_id"], int(s), -(-lowest * int(s) // 100), highest * int(s) // 100) for p in positives[i] if (s := p["positive_score"]) >= 0]
                    chosen = [window_candidates(lo, hi, bottom, top, k) for *_, bottom, top in windows]
                    if not chosen:
                        continue
                    any_ = np.flatnonzero(np.logical_or.reduce(chosen))
                    exact = np.zeros(len(other), dtype=np.int64)
                    exact[any_] = q[other[any_]] @ a[i]
                    for (positive, score, bottom, top), may in zip(windows, chosen, strict=True):
                        j = np.flatnonzero(may & (exact >= bottom) & (exact <= top))
                        found = ids[other[j]]
                        out += [(names[i], positive, score, found[x], exact[j[x]]) for x in best(exact[j], found, k)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"], dtype="int64")

    return search


def _coded(book: np.ndarray, scale: float, dims: int):
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fine, q = integers(b.vector, scale, dims)
            codes, residuals = encode(q, book)
            yield pd.DataFrame({"vec_id": b.vec_id[fine].to_numpy(), "label": b.label[fine].to_numpy(), "q": [r.tobytes() for r in q.astype(np.int32)], "codes": [c.tobytes() for c in codes], "residual": residuals})

    return code


def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, search, schema: str) -> DataFrame:
    """Every block of rows with every block of anchors. There are at least as many blocks of rows as shuffle partitions."""
    parts_ = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, others = max(-(-n_rows // ROW_BLOCK), parts_), max(1, -(-n_anchors // ANCHOR_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("i", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("j", every(others))
    right = anchors.withColumn("j", F.pmod(F.xxhash64("vec_id"), F.lit(others)).cast("int")).withColumn("i", every(blocks))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(lambda l, r: search(l, r), schema)  # noqa: E741


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: float = 256, positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95) -> DataFrame:
    """rows(vec_id, vector, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on vec_id. A negative's score lies between ``lowest`` and ``highest`` hundredths of the positive's.
    """
    prepare(rows.sparkSession)
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("vector").cast("array<double>").alias("vector")).dropna()
    given = given.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.*").checkpoint()
    n_rows, n_anchors, dims = given.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.coalesce(F.max(F.greatest(F.size("vector"), F.lit(1))), F.lit(1))).first()
    sample = given.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n_rows))) < SAMPLE).limit(2 * SAMPLE).select("vector").toPandas()
    book = fit_codebook(integers(sample.vector, scale, dims)[1])
    coded = given.mapInPandas(_coded(book, scale, dims), "vec_id long, label string, q binary, codes binary, residual double").checkpoint()
    anchors = coded.where(is_anchor).select("vec_id", "label", "q")

    near = _met(coded, anchors, n_rows, n_anchors, _best_of_same_label(book, dims, positives), "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives)
    asked = anchors.join(near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "vec_id").checkpoint()

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _met(coded, asked, n_rows, n_anchors, _best_of_windows(book, dims, negatives, lowest, highest), schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
