"""Stupid back-off scores of any order, computed relationally: tables of n-gram counts, joined to exploded n-grams.

S(w | v1..vk) = c(v1..vk w) / c(v1..vk) if c(v1..vk w) >= ``min_count``, else 0.4 * S(w | v2..vk); without context c(w) / N.
A document's score is the mean of log S over its words; order - 1 start symbols stand before the first. Words are runs
without ASCII white space, A-Z lower-cased, told apart by 48-bit hashes.

1. Exploded n-grams, each with its number of times in its document: a column for each word, the last one is scored.
2. The count table of the longest n-grams (written out), and from it those of shorter ones; combined in tasks before they
   meet, so an n-gram that is everywhere is a row for each task.
3. Each distinct n-gram gets its log S by joins with the tables of its suffixes and contexts.
4. The exploded n-grams meet the scored ones by key and are summed per document. The scored side is unique by key, so a
   frequent n-gram's rows can be split over tasks (adaptive skew joins).

Nulls, empty texts and those without words have n_tokens 0 and a null score. Rows without an id are scored too. Repeated
rows count each time and each have a row. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.base import mix, prepare
from refloom.llm.lmscore import BACKOFF, MIN_COUNT, word_ids

_START, _NONE = 1, 2
#: Rows of n-grams handed to Spark at once.
FRAME_ROWS = 200_000


def exploded(docs: DataFrame, order: int) -> DataFrame:
    """row, doc_id, t1..t<order>, n: the distinct n-grams of each document and how often it has them.

    A document without words has one row, n = 0, of an n-gram that is no other's.
    """
    names = [f"t{i + 1}" for i in range(order)]

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held, size = [], 0
            for row, doc_id, text in zip(frame["row"], frame.doc_id, frame.text, strict=True):
                w = word_ids(text).astype(np.int64)
                if len(w):
                    padded = np.concatenate([np.full(order - 1, _START, dtype=np.int64), w])
                    windows = np.lib.stride_tricks.sliding_window_view(padded, order)
                    keys = reduce(lambda k, i: mix(k + windows[:, i].astype(np.uint64)), range(order), np.zeros(len(w), dtype=np.uint64))
                    _, at, n = np.unique(keys, return_index=True, return_counts=True)
                    found = windows[at]
                else:
                    found, n = np.full((1, order), _NONE, dtype=np.int64), np.zeros(1, dtype=np.int64)
                    found[0, 0] = -1 - row
                for lo in range(0, len(n), FRAME_ROWS):
                    part = pd.DataFrame(found[lo : lo + FRAME_ROWS], columns=names)
                    held.append(part.assign(row=row, doc_id=pd.array([None if pd.isna(doc_id) else int(doc_id)], dtype="Int64").repeat(len(part)), n=n[lo : lo + FRAME_ROWS]))
                    size += len(part)
                    if size >= FRAME_ROWS:
                        yield pd.concat(held)
                        held, size = [], 0
            if held:
                yield pd.concat(held)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(grams, ", ".join(f"{c} long" for c in ["row", "doc_id", *names, "n"]))


def count_tables(grams: DataFrame, order: int) -> list[DataFrame]:
    """The tables of counts of 1 to ``order`` words: t<order - k + 1>..t<order>, n.

    Shorter tables also have the run of start symbols that is a context of first words.
    """
    names = [f"t{i + 1}" for i in range(order)]
    longest = grams.where("n > 0").groupBy(*names).agg(F.sum("n").alias("n")).checkpoint()
    tables = []
    for k in range(1, order):
        last = names[order - k :]
        # the k words before the first word of a document, in the columns of the last k
        before = reduce(lambda a, b: a & b, (F.col(c) == _START for c in names[:-1]))
        starts = longest.where(before).select(*(F.lit(_START).cast("long").alias(c) for c in last), "n")
        tables.append(longest.select(*last, "n").unionByName(starts).groupBy(*last).agg(F.sum("n").alias("n")))
    return [*tables, longest]


def scored_grams(tables: list[DataFrame], total: int, min_count: int) -> DataFrame:
    """t1..t<order>, s: log S of the last word after those before it, for each distinct n-gram."""
    order = len(tables)
    names = [f"t{i + 1}" for i in range(order)]
    out = tables[-1].withColumnRenamed("n", f"n{order}")
    for k in range(1, order):
        last, context = names[order - k :], names[order - k - 1 : -1]
        out = out.join(tables[k - 1].withColumnRenamed("n", f"n{k}"), last)
        # the context of k words, under its own names
        out = out.join(tables[k - 1].select(*(F.col(a).alias(b) for a, b in zip(last, context, strict=True)), F.col("n").alias(f"m{k}")), context)
    s = F.log(F.col("n1") / F.lit(float(max(1, total)))) + float((order - 1) * np.log(BACKOFF))
    for k in range(2, order + 1):
        s = F.when(F.col(f"n{k}") >= min_count, F.log(F.col(f"n{k}") / F.col(f"m{k - 1}")) + float((order - k) * np.log(BACKOFF))).otherwise(s)
    return out.select(*names, s.alias("s"))


def backoff_scores(docs: DataFrame, order: int = 3, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_tokens, score (mean log S, null without words): one row for each input row."""
    prepare(docs.sparkSession)
    names = [f"t{i + 1}" for i in range(order)]
    grams = exploded(docs, order)
    tables = count_tables(grams, order)
    total = int(tables[-1].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    met = grams.join(scored_grams(tables, total, min_count), names, "left")
    sums = met.groupBy("row", "doc_id").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.col("s")).alias("s"))
    return sums.select("doc_id", "n_tokens", (F.when(F.col("n_tokens") > 0, F.col("s")) / F.col("n_tokens")).alias("score"))
