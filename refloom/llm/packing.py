"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows of ``capacity`` ids, each a sequence of its own without padding, and a rest.
Rests over ``capacity // 4`` ids are halved until they are not, so that differencing has enough small pieces to even out
windows. Documents are dealt by a hash of id and row number into groups of about ``GROUP`` documents; within a group the rests are divided among
W = ceil(ids / capacity) windows: partial partitions with the largest imbalance are merged again and again, largest sums of
one against smallest of the other. Whenever a window exceeds the capacity, W rises and the group is divided anew.

Nulls and empty texts have only the closing id 0. A document without an id is packed as any other. Repeated rows are packed
once for each row. An empty table gives no pieces. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache
from operator import itemgetter
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.base import prepare

CAPACITY, GROUP, END_ID = 1024, 256, 0
#: What needs more care than most texts: characters on which the libraries' Unicode tables might differ, or white space in a row.
_UNUSUAL, _GAPS = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]"), re.compile(r"\s\s")
_LONG = 100_000


@cache
def _encoders(json_path: str, ranks_path: str | None, pattern: str | None):
    """The tokenizer file's own encoder, and if its ranks are given two faster ones: of the full pattern, and without its
    look-ahead, which matters only where white space characters follow each other."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    slow.encode_special_tokens = True
    if not ranks_path:
        return slow, None, None
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast, plain = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, pattern.replace(r"\s+(?!\S)|", "")))
    return slow, fast, plain


def encode(text: str, json_path: str, ranks_path: str | None, pattern: str | None) -> list[int]:
    """The tokenizer's ids of a text. The same vocabulary as ranks gives the same ids several times as fast; texts with
    unusual characters, and very long ones with very long runs, go through the tokenizer file itself."""
    slow, fast, plain = _encoders(json_path, ranks_path, pattern)
    if fast is None:
        return slow.encode(text, add_special_tokens=False).ids
    if not text.isascii() and _UNUSUAL.search(text) or len(text) > _LONG and re.search(r"\S{5000}|\s{5000}", text):
        return slow.encode(text, add_special_tokens=False).ids
    return (fast if _GAPS.search(text) else plain).encode_ordinary(text)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full windows, then the rest in parts of at most a quarter window."""
    full = [(s, capacity) for s in range(0, n - n % capacity, capacity)]
    rest, at = n % capacity, n - n % capacity
    if rest:
        parts = -(-rest // max(1, capacity // 4))
        edges = [at + rest * i // parts for i in range(parts + 1)]
        full += [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return full


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: divide the sizes among so many ways with near-equal sums; the members of each way, by index."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made, largest = len(heap), itemgetter(0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # both hold their non-empty ways, largest first; the k-th largest of one meets the k-th smallest of the other
        if len(a) + len(b) <= ways:
            rows = a + b
        else:
            alone = ways - len(b)
            rows = a[:alone] + [(x + y, p + q) for (x, p), (y, q) in zip(a[alone:], reversed(b), strict=False)] + b[: ways - len(a)]
        rows.sort(key=largest, reverse=True)
        heapq.heappush(heap, ((rows[-1][0] if len(rows) == ways else 0) - rows[0][0], made, rows))
        made += 1
    return [members for _, members in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """As few near-equal windows as differencing finds within the capacity."""
    total = sum(sizes)
    ways = max(1, -(-total // capacity))
    while sizes:
        found = difference(sizes, ways)
        worst = max(sum(sizes[i] for i in w) for w in found)
        if worst <= capacity:
            return found
        ways += max(1, ways * (worst - capacity) // (8 * capacity))
    return []


def tokenize(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, doc_tokens, pieces (start, length, ids_crc32): the ids themselves stay in the task."""

    @F.pandas_udf("doc_tokens long, pieces array<struct<start: long, length: long, ids_crc32: long>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                ids = array("I", encode(t, json_path, ranks_path, pattern) if t else ())
                ids.append(END_ID)
                if sys.byteorder == "big":
                    ids.byteswap()
                raw, size = memoryview(ids).cast("B"), ids.itemsize
                out.append((len(ids), [{"start": s, "length": n, "ids_crc32": crc32(raw[s * size : (s + n) * size])} for s, n in cut(len(ids), capacity)]))
            yield pd.DataFrame(out, columns=["doc_tokens", "pieces"])

    prepare(docs.sparkSession)
    return docs.select("doc_id", pieces("text").alias("_t")).select("doc_id", "_t.doc_tokens", "_t.pieces")


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The number of groups follows the number of documents, so a group stays small at any size.
    """
    groups = max(1, -(-docs.select(F.lit(1)).count() // GROUP))
    rows = tokenize(docs, json_path, ranks_path, pattern, capacity)
    # by the row's number too: copies and rows without an id spread like any others
    numbered = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)))
    dealt = numbered.select("g", "doc_id", "doc_tokens", F.inline("pieces"))

    def divide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = group.length.tolist()
        loose = [i for i, n in enumerate(sizes) if n < capacity]
        sequences = [[i] for i, n in enumerate(sizes) if n >= capacity]
        sequences += [[loose[i] for i in w] for w in windows([sizes[i] for i in loose], capacity)]
        number, offset = [0] * len(sizes), [0] * len(sizes)
        first = int(group.g.iloc[0]) << 32
        for k, members in enumerate(sequences):
            at = 0
            for i in sorted(members):
                number[i], offset[i] = first + k, at
                at += sizes[i]
        return group.assign(sequence_id=number, offset=offset).drop(columns="g")

    kinds = dict(rows.dtypes)
    return dealt.groupBy("g").applyInPandas(divide, f"doc_id {kinds['doc_id']}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
