"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Edges that one task of a round takes; up to so many tasks a round is sized by its edges, beyond that by the session's settings.
TASK_ROWS, MOST_TASKS = 20_000, 100


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first())


def _few(df: DataFrame, rows: int) -> DataFrame:
    """In as many partitions as so many rows need: a round is small work, and each task of it leaves files and events."""
    return df.coalesce(-(-rows // TASK_ROWS)) if rows <= MOST_TASKS * TASK_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (id, component): every linked id with the smallest id that it reaches.

    Each round is two aggregations with partial sums and two joins; lineage is cut by checkpoint(), and no list of
    neighbours is ever gathered. Loops and repeated edges are allowed; null ends are dropped. A round never has more edges
    than the one before, so its steps are sized by the count of that: ``TASK_ROWS`` in a task, as many tasks as that takes.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.col("u").isNotNull().alias("_a"), F.col("v").isNotNull().alias("_b")).where("_a and _b and u != v").select("u", "v").distinct().checkpoint()
    mark = _mark(e)
    while mark[0]:
        n = mark[0]
        e = _few(e, n)
        both = _few(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n)
        low = _few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
        large = _few(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"), n).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(near.select("u", F.col("m").alias("v")))
        e = _few(_few(small, 2 * n).distinct(), n).checkpoint()
        if (now := _mark(e)) == mark:
            break
        mark = now
    e = _few(e, max(1, mark[0]))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
