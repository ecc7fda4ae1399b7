"""Stupid back-off scores of every document under bigram counts of the whole corpus.

S(w | v) = c(v w) / c(v) if c(v w) >= ``min_count``, else 0.4 * c(w) / N. A document's score is the mean of log S over its
words; the first word follows a start symbol that each non-empty document has once. Words are runs without ASCII white
space, A-Z lower-cased.

The joins are relational, but rows are packed: a row holds a chunk's n-grams of one hash partition.
1. Word counts, pre-aggregated in each task, make the word table. Words above N / ``HEAVY`` occurrences are at most HEAVY,
   so their counts go to every task.
2. Each task deals its bigrams (context, word, document) into partitions by the context's hash, by context and word for
   heavy contexts. All bigrams of a context meet in a partition, which so knows c(v w) and c(v). It sums what is decided;
   back-offs to rare words become requests, one row for each partition of words' hashes that is asked.
3. Requests meet the word table, partition by partition.
4. Partial sums meet by chunk, the bounded set of documents that a task handled together.

Words are told apart by 48-bit hashes. Nulls, empty texts and those without words have n_tokens 0 and a null score. Rows
without an id are scored too. Repeated rows count each time and each have a row. Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.base import mix, prepare, word_hashes

MIN_COUNT, BACKOFF, HEAVY = 2, 0.4, 20_000
CHUNK_TOKENS, CHUNK_DOCS, PART_TOKENS = 1_500_000, 60_000, 2_000_000
_START, _END = np.uint64(1), np.uint64(2)
_BITS = np.uint64(48)
_PACKED = "part long, kind string, chunk long, a binary, b binary, c binary"
_COLUMNS = ["part", "kind", "chunk", "a", "b", "c"]


def word_ids(text: str | None) -> np.ndarray:
    return np.maximum(word_hashes(text) >> (np.uint64(64) - _BITS), np.uint64(3))


def _squeeze(x: np.ndarray, width: int) -> bytes:
    """Integers of so many bytes, byte by byte place, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.compress(planes.tobytes(), 1)


def _unsqueeze(raw: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def _runs(x: np.ndarray) -> tuple[bytes, bytes]:
    """A sorted array as steps between its values and the lengths of their runs."""
    v, n = np.unique(x, return_counts=True)
    return _squeeze(np.diff(v, prepend=np.uint64(0)), 6), _squeeze(n, 4)


def _unruns(steps: bytes, n: bytes) -> np.ndarray:
    return np.repeat(np.cumsum(_unsqueeze(steps, 6), dtype=np.uint64), _unsqueeze(n, 4).astype(np.int64))


def _framed(a: bytes, b: bytes) -> bytes:
    return np.array([len(a)], dtype="<u4").tobytes() + a + b


def _unframed(raw: bytes) -> tuple[bytes, bytes]:
    n = 4 + int(np.frombuffer(raw[:4], dtype="<u4")[0])
    return raw[4:n], raw[n:]


def _lookup(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of sorted keys, 0 where x isn't one."""
    if not len(keys):
        return np.zeros(len(x))
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], 0)


def _count_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[np.ndarray] = []
    size = 0

    def table() -> pd.DataFrame:
        w, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"w": w.astype(np.int64), "n": n})

    for frame in frames:
        for t in frame.text:
            held.append(word_ids(t))
            size += len(held[-1])
        if size >= CHUNK_TOKENS:
            yield table()
            held, size = [], 0
    if size:
        yield table()


def word_table(docs: DataFrame) -> DataFrame:
    """w (48-bit hash), n: how often each word occurs in the corpus."""
    return docs.select("text").mapInPandas(_count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _home(chunk: int, parts: int) -> int:
    """The partition of what belongs to a chunk; hashed, since numbers of first chunks have many factors of two in common."""
    return int(mix(np.array([chunk], dtype=np.uint64))[0] % np.uint64(parts))


def _deal(heavy: np.ndarray, parts: int):
    def pack(ids: list, words: list[np.ndarray], chunk: int) -> pd.DataFrame:
        n = np.array([len(w) for w in words])
        full = [i for i in range(len(words)) if n[i]]
        out = [(_home(chunk, parts), "docs", chunk, np.array([0 if pd.isna(i) else int(i) for i in ids], dtype="<i8").tobytes(), np.array([pd.isna(i) for i in ids], dtype=np.uint8).tobytes(), n.astype("<i8").tobytes())]
        if full:
            edge = np.array([_START], dtype=np.uint64), np.array([_END], dtype=np.uint64)
            v = np.concatenate([x for i in full for x in (edge[0], words[i])])
            w = np.concatenate([x for i in full for x in (words[i], edge[1])])
            d = np.repeat(np.array(full, dtype=np.uint64), n[full] + 1)
            hot = _lookup(heavy, np.ones(len(heavy)), v) > 0
            part = (np.where(hot, mix(v * np.uint64(0x9E3779B97F4A7C15) + w), mix(v)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((v, part))
            v, w, d, part = v[order], w[order], d[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts, len(part))[1:], strict=True):
                out.append((int(part[lo]), "pairs", chunk, _framed(*_runs(v[lo:hi])), _squeeze(w[lo:hi], 6), _squeeze(d[lo:hi], 2)))
        return pd.DataFrame(out, columns=_COLUMNS)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId() << 32
        ids, words, size = [], [], 0
        for frame in frames:
            for i, t in zip(frame.doc_id, frame.text, strict=True):
                ids.append(i)
                words.append(word_ids(t))
                size += len(words[-1])
                if size >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield pack(ids, words, chunk)
                    chunk, ids, words, size = chunk + 1, [], [], 0
        if ids:
            yield pack(ids, words, chunk)

    return deal


def _sums(chunks: np.ndarray, docs: np.ndarray, values: np.ndarray, known: list[int], parts: int) -> list[tuple]:
    """Rows of partial sums by chunk and document."""
    order = np.lexsort((docs, chunks))
    chunks, docs, values = chunks[order], docs[order], values[order]
    first = np.flatnonzero(np.diff(chunks.astype(np.int64) * (1 << 16) + docs, prepend=-1))
    total = np.add.reduceat(values, first) if len(first) else values
    out = []
    owner = chunks[first]
    for k in np.unique(owner):
        lo, hi = np.searchsorted(owner, [k, k + 1])
        out.append((_home(known[k], parts), "sums", known[k], docs[first[lo:hi]].astype("<u2").tobytes(), total[lo:hi].astype("<f8").tobytes(), b""))
    return out


def _score_pairs(heavy: np.ndarray, counts: np.ndarray, total: int, parts: int, min_count: int):
    floor = np.log(BACKOFF / max(1, total))

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        out = [tuple(r) for r in frame[frame.kind == "docs"][_COLUMNS].itertuples(index=False)]
        frame = frame[frame.kind == "pairs"]
        if len(frame):
            v, w, d, chunk = [], [], [], []
            known = frame.chunk.tolist()
            for k, (a, b, c) in enumerate(frame[["a", "b", "c"]].itertuples(index=False)):
                v.append(_unruns(*_unframed(a)))
                w.append(_unsqueeze(b, 6))
                d.append(_unsqueeze(c, 2).astype(np.int32))
                chunk.append(np.full(len(d[-1]), k, dtype=np.int32))
            v, w, d, chunk = (np.concatenate(x) for x in (v, w, d, chunk))
            _, at, seen = np.unique(mix(v * np.uint64(0x9E3779B97F4A7C15) + w), return_inverse=True, return_counts=True)
            both = seen[at].astype(np.float64)
            _, at, seen = np.unique(v, return_inverse=True, return_counts=True)
            context = _lookup(heavy, counts, v)
            context = np.where(context > 0, context, seen[at])
            del v, at, seen
            scored = w != _END
            near = scored & (both >= min_count)
            plain = _lookup(heavy, counts, w)
            known_word = scored & ~near & (plain > 0)
            value = np.zeros(len(w))
            value[near] = np.log(both[near] / context[near])
            value[known_word] = floor + np.log(plain[known_word])
            done = near | known_word
            out += _sums(chunk[done], d[done], value[done], known, parts)
            ask = scored & ~done
            w, d, chunk = w[ask], d[ask], chunk[ask]
            part = (mix(w) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((w, part))
            w, d, chunk, part = w[order], d[order], chunk[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            known = np.array(known, dtype=np.uint64)
            for lo, hi in zip(cuts, np.append(cuts, len(part))[1:], strict=True):
                # one row for a partition that is asked, whatever the chunks: a row a chunk too would grow with the cube of the corpus
                owners, owner = np.unique(chunk[lo:hi], return_inverse=True)
                out.append((int(part[lo]), "asks", -1, _framed(*_runs(w[lo:hi])), _framed(_squeeze(np.diff(known[owners], prepend=np.uint64(0)), 8), _squeeze(owner, 4)), _squeeze(d[lo:hi], 2)))
        return pd.DataFrame(out, columns=_COLUMNS)

    return score


def _answer(total: int, parts: int):
    floor = np.log(BACKOFF / max(1, total))

    def answer(asked: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        out = [tuple(r) for r in asked[asked.kind == "docs"][_COLUMNS].itertuples(index=False)]
        # a chunk's sums have met here, so one row of them goes on
        for k, g in asked[asked.kind == "sums"].groupby("chunk", sort=False):
            docs, sums = np.frombuffer(b"".join(g.a), dtype="<u2").astype(np.int64), np.frombuffer(b"".join(g.b), dtype="<f8")
            out += _sums(np.zeros(len(docs), dtype=np.int64), docs, sums, [k], parts)
        asked = asked[asked.kind == "asks"]
        if len(asked):
            order = np.argsort(words.w.to_numpy(), kind="stable")
            keys, n = words.w.to_numpy()[order].astype(np.uint64), words.n.to_numpy()[order]
            chunk, d, value = [], [], []
            for a, b, c in asked[["a", "b", "c"]].itertuples(index=False):
                x = _unruns(*_unframed(a))
                value.append(floor + np.log(np.maximum(1, _lookup(keys, n, x))))
                d.append(_unsqueeze(c, 2).astype(np.int64))
                steps, owner = _unframed(b)
                chunk.append(np.cumsum(_unsqueeze(steps, 8), dtype=np.uint64)[_unsqueeze(owner, 4).astype(np.int64)])
            known, chunk = np.unique(np.concatenate(chunk), return_inverse=True)
            out += _sums(chunk, np.concatenate(d), np.concatenate(value), known.tolist(), parts)
        return pd.DataFrame(out, columns=_COLUMNS)

    return answer


def _finish(frame: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for _, g in frame.groupby("chunk", sort=False):
        head = g[g.kind == "docs"].iloc[0]
        ids, none, n = np.frombuffer(head.a, dtype="<i8"), np.frombuffer(head.b, dtype=np.uint8), np.frombuffer(head.c, dtype="<i8")
        total = np.zeros(len(ids))
        for a, b in g[g.kind == "sums"][["a", "b"]].itertuples(index=False):
            total[np.frombuffer(a, dtype="<u2")] += np.frombuffer(b, dtype="<f8")
        mean = np.divide(total, n, out=np.full(len(ids), np.nan), where=n > 0)
        rows.append(pd.DataFrame({"doc_id": pd.array([None if x else int(i) for i, x in zip(ids, none, strict=True)], dtype="Int64"), "n_tokens": n, "score": [None if np.isnan(x) else float(x) for x in mean]}))
    out = pd.concat(rows) if rows else pd.DataFrame({"doc_id": pd.array([], dtype="Int64"), "n_tokens": [], "score": []})
    return out.astype({"n_tokens": "int64", "score": "object"})


def score_documents(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_tokens, score (mean log S, null without words): one row for each input row."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = word_table(docs).checkpoint()
    total = int(words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    parts = max(1, -(-total // PART_TOKENS))
    top = words.where(F.col("n") > total / HEAVY).toPandas().sort_values("w")  # fewer than HEAVY rows
    starts = _non_empty(docs)
    heavy = np.concatenate([[_START], top.w.to_numpy().astype(np.uint64)]).astype(np.uint64)
    counts = np.concatenate([[max(1, starts)], top.n.to_numpy()]).astype(np.float64)
    dealt = docs.mapInPandas(_deal(heavy, parts), _PACKED)
    scored = dealt.groupBy("part").applyInPandas(_score_pairs(heavy, counts, total, parts, min_count), _PACKED)
    word_part = F.pandas_udf(lambda w: pd.Series((mix(w.to_numpy().astype(np.uint64)) % np.uint64(parts)).astype(np.int64)), "long")
    rare = words.where(F.col("n") <= total / HEAVY).withColumn("part", word_part("w"))
    answered = scored.groupBy("part").cogroup(rare.groupBy("part")).applyInPandas(_answer(total, parts), _PACKED)
    return answered.groupBy("chunk").applyInPandas(_finish, "doc_id long, n_tokens long, score double")


def _non_empty(docs: DataFrame) -> int:
    """Documents with a word."""
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count()
