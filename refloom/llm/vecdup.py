"""Near-duplicate vectors of one label by Euclidean p-stable hashing: every pair whose cosine is at least ``least``.

1. Vectors that are equal, label included, become one class. A class is named by its smallest vec_id.
2. Unit vectors are projected on random Gaussian directions, shifted and cut into cells of ``WIDTH``; ``k`` cells make a table's key.
   Two unit vectors at distance c share a cell with probability p(c). k follows from the number of classes (so that unrelated vectors,
   at distance sqrt(2), rarely share a key), and the number of tables from k, so that a pair right at the threshold shares no
   key with probability ``MISS`` at most. Both grow slowly: tables as the classes to the power 0.12.
3. In a bucket each class meets two centres, by exact cosine in double precision; links make clusters. Where a bucket still holds
   several clusters, its largest meets the rest and the rest meets itself, in blocks. So a bucket full of copies of one
   vector costs its members once, and unrelated ones that hash together meet all.
4. A link lies within a cluster. All pairs of a cluster meet in blocks by matrix products, and only each class's number of linked
   vectors leaves a task: the count is of all links, found by hashing or not. Rows grow with the square of a cluster's different
   vectors over the block of 2,048.

Vectors that are null or zero or hold null or non-finite components, and rows without a label, link with nothing: n_links 0,
component_id their own id. Shorter vectors are filled up with zeros. Rows without an id link with nothing and have no
component; they are kept. Rows that repeat an id count as one vector, that of the smallest label and hash, and each has a row with
its result. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.base import mix, prepare
from refloom.llm.components import components

LEAST, WIDTH, MISS, SEED = 0.98, 2.0, 1e-7, 13
BLOCK, GROUP_ROWS, STRIPE = 2048, 4096, 512


def shared(c: float, width: float = WIDTH) -> float:
    """Probability that two vectors at distance c fall into one cell of a random direction."""
    r = width / c
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, least: float = LEAST) -> tuple[int, int]:
    """Cells in a key and number of tables for n vectors."""
    near, far = shared(math.sqrt(2 - 2 * least)), shared(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(2, n)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log1p(-(near**k)))


def table_keys(units: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(rows, tables) keys of unit vectors."""
    rng = np.random.default_rng(SEED)
    directions, shift = rng.standard_normal((units.shape[1], k * tables)), rng.random(k * tables) * WIDTH
    odd = mix(np.arange(1, k * tables + 1, dtype=np.uint64)) | np.uint64(1)
    cells = np.floor((units @ directions + shift) / WIDTH).astype(np.int64).view(np.uint64)
    sums = (cells * odd).reshape(len(units), tables, k).sum(2)
    return mix(sums + odd.reshape(tables, k)[:, 0]).view(np.int64)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a with rows of b."""
    return (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1)))


def _scaled(x: np.ndarray) -> np.ndarray:
    """The vector over its largest component, so that squares neither overflow nor vanish."""
    return x / np.abs(x).max()


def _vectors(dims: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b.vector:
                x = np.zeros(dims)
                given = np.asarray([] if v is None else v, dtype=np.float64)
                x[: len(given)] = given
                if not np.isfinite(x).all() or not x.any():
                    out.append((None, None, None))
                    continue
                x = x + 0.0  # no negative zeros
                d = xxhash.xxh3_128_digest(x.tobytes())
                out.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), _scaled(x).tobytes()))
            found = pd.DataFrame(out, columns=["hi", "lo", "v"])
            yield pd.DataFrame({"vec_id": b.vec_id, "label": b.label, "hi": found.hi.astype("Int64"), "lo": found.lo.astype("Int64"), "v": found.v})

    return read


def _rows(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _keys(k: int, tables: int):
    def keys(column: pd.Series) -> pd.Series:
        x = _rows(column)
        return pd.Series(list(table_keys(x / np.sqrt((x * x).sum(1))[:, None], k, tables)))

    keys.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(keys, "array<long>")


def _linked(least: float):
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="bool")
        x, y = _rows(a), _rows(b)
        return pd.Series((x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= least)

    linked.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(linked, "boolean")


def _sides(g: pd.DataFrame, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    own = g.own.to_numpy()
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def forest(x: np.ndarray, labels: list[int], left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between rows in ``left`` and in ``right`` that join what labels don't join already; enough to join all that are linked."""
    root = {k: k for k in labels}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    out = []
    for at in range(0, len(left), STRIPE):
        some = left[at : at + STRIPE]
        for a, b in zip(*np.nonzero(cosines(x[some], x[right]) >= least), strict=True):
            p, q = find(labels[some[a]]), find(labels[right[b]])
            if p != q:
                root[p] = q
                out.append((int(some[a]), int(right[b])))
    return out


def _meet(least: float):
    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), g in frame.groupby(["key", "i", "j"], sort=False):
            ids = g.cid.to_numpy()
            out += [(ids[a], ids[b]) for a, b in forest(_rows(g.v), g.main.tolist(), *_sides(g, i, j), least)]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return meet


def _count(least: float):
    def count(frame: pd.DataFrame) -> pd.DataFrame:
        ids, numbers = [], []
        for (_, i, j), g in frame.groupby(["cluster", "i", "j"], sort=False):
            x, copies, of = _rows(g.v), g.copies.to_numpy(), np.zeros(len(g), dtype=np.int64)
            left, right = _sides(g, i, j)
            for at in range(0, len(left), STRIPE):
                some = left[at : at + STRIPE]
                near = cosines(x[some], x[right]) >= least
                if i == j:
                    near &= some[:, None] != right[None, :]
                of[some] += near @ copies[right]
                if i != j:
                    of[right] += copies[some] @ near
            ids.append(g.cid.to_numpy())
            numbers.append(of)
        return pd.DataFrame({"cid": np.concatenate(ids), "n": np.concatenate(numbers)})

    return count


def _dealt(members: DataFrame, unit: str) -> DataFrame:
    """Members with ``own`` and an array ``others`` of blocks: a row for each block that theirs meets, with the number g of its group."""
    total = members.agg(F.coalesce(F.sum(F.size("others")), F.lit(0))).first()[0]
    rows = members.withColumn("other", F.explode("others")).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "others")
    return rows.withColumn("g", F.pmod(F.xxhash64(unit, "i", "j"), F.lit(max(1, int(total) // GROUP_ROWS))))


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _left_over(keyed: DataFrame, lean: DataFrame, clusters: DataFrame, least: float) -> DataFrame:
    """(u, v): links between clusters of a bucket that its centres left apart. Up to three members have all met."""
    full = keyed.groupBy("key").count().where("count > 3").select("key")
    named = keyed.join(full, "key").join(clusters.withColumnRenamed("id", "cid"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("main")).checkpoint()
    by = named.groupBy("key", "main").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("main", F.struct("c", "main")).alias("most"), F.max("c").alias("m"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    by = by.select("key", "most", _blocks(F.col("all") - F.col("m")).alias("rest"), _blocks(F.col("m")).alias("mains"))
    h, is_most = F.xxhash64("cid"), F.col("main") == F.col("most")
    members = named.join(by, "key").withColumns({"own": F.when(is_most, F.col("rest") + F.pmod(h, F.col("mains"))).otherwise(F.pmod(h, F.col("rest"))).cast("int"), "others": F.sequence(F.lit(0), F.when(is_most, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)})
    return _dealt(members.select("key", "cid", "main", "own", "others").join(lean.select("cid", "v"), "cid"), "key").groupBy("g").applyInPandas(_meet(least), "u long, v long")


def find_links(classes: DataFrame, least: float = LEAST) -> DataFrame:
    """classes(cid, label, v) -> (u, v): links that span each component."""
    k, tables = plan_tables(classes.count(), least)
    keyed = classes.select("cid", "label", F.explode(_keys(k, tables)("v")).alias("key")).select("cid", F.xxhash64("label", "key").alias("key"))
    ends = keyed.select("key", F.col("cid").bitwiseXOR(F.col("key")).alias("x")).groupBy("key").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a != b")
    centres = ends.select("key", F.array(F.col("a").bitwiseXOR(F.col("key")), F.col("b").bitwiseXOR(F.col("key"))).alias("centres"))
    keyed = keyed.join(centres, "key").checkpoint()
    pairs = keyed.select("cid", F.explode("centres").alias("c")).where("cid != c").select(F.least("cid", "c").alias("u"), F.greatest("cid", "c").alias("w")).distinct()
    lean = classes.select("cid", "label", "v")
    met = pairs.join(lean.toDF("u", "l", "a"), "u").join(lean.toDF("w", "m", "b"), "w").where("l = m")
    passing = met.where(_linked(least)("a", "b")).select("u", F.col("w").alias("v")).checkpoint()
    return passing.unionByName(_left_over(keyed.select("key", "cid"), lean, components(passing).checkpoint(), least)).checkpoint()


def count_links(members: DataFrame, least: float = LEAST) -> DataFrame:
    """members(cluster, cid, copies, v) -> cid, n: vectors of other classes of the cluster that are linked with the class."""
    sizes = members.groupBy("cluster").agg(_blocks(F.count(F.lit(1))).alias("blocks"))
    named = members.join(sizes, "cluster").withColumns({"own": F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"), "others": F.sequence(F.lit(0), F.col("blocks") - 1)}).drop("blocks").checkpoint()
    return _dealt(named, "cluster").groupBy("g").applyInPandas(_count(least), "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n"))


def near_vectors(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """rows(vec_id, vector, label) -> vec_id, n_links, component_id, kept: one row for each input row."""
    prepare(rows.sparkSession)
    given = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    dims = max(1, given.agg(F.coalesce(F.max(F.size("vector")), F.lit(1))).first()[0])
    read = given.mapInPandas(_vectors(dims), "vec_id long, label string, hi long, lo long, v binary").checkpoint()
    chosen = read.where("hi is not null and label is not null and vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("label", "hi", "lo", "v")).alias("r")).select("vec_id", "r.*")
    classes = chosen.groupBy("label", "hi", "lo").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).checkpoint()
    found = components(find_links(classes, least)).checkpoint()
    members = found.withColumnRenamed("id", "cid").join(classes.select("cid", "copies", "v"), "cid").select(F.col("component").alias("cluster"), "cid", "copies", "v")
    counted = found.withColumnRenamed("id", "cid").join(count_links(members, least), "cid")
    named = classes.join(counted, "cid", "left").where("component is not null or copies > 1").select("label", "hi", "lo", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    of_id = chosen.select("vec_id", "label", "hi", "lo").join(named, ["label", "hi", "lo"]).select("vec_id", "n_links", "component")
    out = read.select("vec_id").join(of_id, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
