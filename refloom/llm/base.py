"""What the operators share: session settings, the train/held-out split, word and shingle hashes."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; texts are long, so far fewer than Spark's 10,000.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and make sure that checkpoint() has a folder that all executors share.

    The folder is the one the cluster names in spark.checkpoint.dir. Only a local session, where all is one machine, gets a
    folder of its own if none is named; on a cluster that is an error.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="refloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(col="doc_id"):
    """crc32 of the id as text, mod 5, is 0. Rows without an id count as held out: nothing is learned from them."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, max_chars: int):
    """Texts and labels to learn from, as a pandas frame on the driver.

    Bounded: at most ``per_class`` rows of each label, none over ``max_chars`` characters; rows are chosen among those that have
    such a text, by the smallest hash of their id, so the same ones at every run. Held-out rows never take part. Of several
    labels of one id the smallest counts, of several texts the one with the smallest hash.
    """
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    picked = None
    usable = labels.select("doc_id", F.col(column).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("y").alias("y"))
    usable = usable.join(texts.select("doc_id"), "doc_id", "left_semi")
    for y in (0, 1):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # 2 * per_class pairs of integers at most: always small enough to send to every task
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r")).select("doc_id", "r.text", "y").toPandas()
    order = [xxhash.xxh64_intdigest(str(i)) for i in found.doc_id]
    return found.assign(o=order).sort_values(["o", "doc_id"]).drop(columns="o").reset_index(drop=True)


_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWER = np.cumprod(np.full(256, 0x5851F42D4C957F2D, dtype=np.uint64))
_PLACE = mix(np.arange(1001, 1065, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LONG = 256
_SEGMENT = 1 << 20


def _segment_words(buf: np.ndarray) -> np.ndarray:
    inside = ~_SPACE[buf]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(first, lens)
    h = np.add.reduceat(_BYTE[buf[inside]] * _POWER[np.minimum(at, _LONG - 1)], first)
    h = mix(h + lens.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for i in np.flatnonzero(lens > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes())
    return h


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text in order: A-Z lower-cased, words are runs without ASCII white space.

    Works through long texts in segments of 1 MiB, cut between words, so memory follows the words, not the bytes.
    """
    if not text:
        return np.empty(0, dtype=np.uint64)
    buf = np.frombuffer(text.encode("utf-8", "replace").translate(_TO_LOWER), dtype=np.uint8)
    if len(buf) <= _SEGMENT:
        return _segment_words(buf)
    parts, lo = [], 0
    while lo < len(buf):
        hi = lo + _SEGMENT
        if hi < len(buf):
            while hi < len(buf) and not (gaps := np.flatnonzero(_SPACE[buf[hi : hi + 4096]])).size:
                hi += 4096
            hi = min(len(buf), hi + int(gaps[0]) if gaps.size else len(buf))
        parts.append(_segment_words(buf[lo:hi]))
        lo = hi
    return np.concatenate(parts)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; with 1 to k-1 words their whole sequence is one shingle."""
    w = word_hashes(text)
    n = len(w)
    if n == 0:
        return w
    if n < k:
        return mix(np.add.reduce(w * _PLACE[:n], keepdims=True) + np.uint64(n * 0xD1B54A32D192ED03 % 2**64))
    total = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        total += w[j : n - k + 1 + j] * _PLACE[j]
    return np.unique(mix(total))


LETTERS = re.compile(r"[^\W\d_]+")
