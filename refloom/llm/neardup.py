"""Near-duplicates by HyperMinHash: exact components of the links between 5-word shingle sets of a Jaccard similarity of
at least ``percent`` / 100.

1. A set's sketch has 128 registers. A shingle's hash picks one; the smallest rest of the hash in it is stored as its
   leading-zero count and ten more bits, 16 bits in all. Equal sets become one class; links are sought between classes.
2. Empty registers borrow from others (densification), then 30 bands of five registers make bucket keys. A pair at
   similarity 0.8 shares no bucket with probability (1 - 0.8**5)**30 = 7e-6, at 0.85 with 2e-8. Classes so small that no
   different set can reach the threshold are left out.
3. In a bucket every class first meets two centres, those with the smallest and largest (id xor key); centres differ from
   bucket to bucket. A pair passes if its sizes allow the threshold and its collision-corrected estimate is within five
   standard errors of it. The components of passing pairs are clusters.
4. Where a bucket of four or more still holds several clusters, all its pairs of different clusters meet, in blocks of 256
   members: the bucket's largest cluster against the rest, and the rest against each other. Rows grow with the square of
   the rest only, over the block. Clusters are taken anew with the pairs that pass.
5. Within clusters all pairs are confirmed on full shingle sets made from the texts, in blocks of 256 members against each
   other where a cluster is larger: no pair is left out, so the rows grow with the square of a cluster over the block. A block
   of a larger cluster is one row, its texts compressed together, which near copies are to a small part. Groups of block
   meetings are sized by what is dealt to them. Only a spanning forest of confirmed links leaves a task.
6. The confirmed links' components, carried over to all members of each class.

Texts without words, empty ones and nulls have the empty set: n_shingles 0, linked with nothing. Rows without an id take
part in no link; their component_id is null. Repeated rows are members of one class and each have a row. An empty
table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.base import mix, prepare, shingle_set
from refloom.llm.components import components

REGISTERS, MANTISSA, BANDS, ROWS = 128, 10, 30, 5
PERCENT, BLOCK, GROUP_ROWS = 80, 256, 512
BROADCAST_ROWS = 1_000_000

_REST = 64 - REGISTERS.bit_length() + 1
_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_REST)
_rng = np.random.default_rng(20)
_BORROW = np.argsort(_rng.random((REGISTERS, REGISTERS)), axis=1)
_BORROW = np.concatenate([np.arange(REGISTERS)[:, None], _BORROW], axis=1)
_CHOSEN = np.argsort(_rng.random((BANDS, REGISTERS)), axis=1)[:, :ROWS]
_PLACES = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of hashes: 0 if empty, else 1 + (leading zeros, mantissa bits) of the bucket's minimum."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if not len(shingles):
        return out
    first = np.searchsorted(shingles, _EDGES)
    there = first < np.append(first[1:], len(shingles))
    v = shingles[first[there]] & np.uint64((1 << _REST) - 1)
    bits = np.frexp(v.astype(np.float64))[1].astype(np.uint64)  # position of the highest bit that is set
    zeros = np.uint64(_REST) - np.minimum(bits, np.uint64(_REST))
    body = ((v << zeros) >> np.uint64(_REST - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out[there] = ((zeros << np.uint64(MANTISSA)) | body).astype(np.uint16) + np.uint16(1)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """Bucket keys of a sketch's bands, as signed integers."""
    r = registers
    if not r.all():
        r = r[_BORROW[np.arange(REGISTERS), (r[_BORROW] > 0).argmax(1)]]
    return mix((r[_CHOSEN].astype(np.uint64) * _PLACES).sum(1) + _PLACES[:, 0]).view(np.int64)


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that agree by chance between disjoint sets of n and m elements (the large-set approximation)."""
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    return 0.1699194871597391 * REGISTERS / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2


def passes(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether pairs of sketches (rows of a and b) may reach the threshold: the estimate is within five standard errors."""
    t = percent / 100
    used = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    chance = expected_collisions(n, m)
    estimate = (same - chance) / np.maximum(1, used - chance)
    return estimate >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(1, used))


def _sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out = []
        for t in texts:
            s = shingle_set(t)
            d = xxhash.xxh3_128_digest(s.tobytes())
            out.append((len(s), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), sketch(s).tobytes()))
        yield pd.DataFrame(out, columns=["n", "hi", "lo", "registers"])


def _keys(registers: pd.Series) -> pd.Series:
    return pd.Series([band_keys(np.frombuffer(r, dtype=np.uint16)) for r in registers], dtype="object")


def _may_link(percent: int):
    def may_link(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="bool")
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(-1, REGISTERS) for s in (a, b))
        return pd.Series(passes(x, y, n.to_numpy(dtype=np.float64), m.to_numpy(dtype=np.float64), percent))

    may_link.__annotations__ = {"a": pd.Series, "b": pd.Series, "n": pd.Series, "m": pd.Series, "return": pd.Series}
    return F.pandas_udf(may_link, "boolean")


def meet(sketches: np.ndarray, n: np.ndarray, labels: list[int], left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A forest of the passing pairs of a row in ``left`` with one in ``right``, of those that labels don't join already."""
    root: dict[int, int] = {k: k for k in labels}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    links = []
    low = percent / 100
    for i in left.tolist():
        # sizes alone rule out most of a mixed bucket
        js = right[(np.minimum(n[right], n[i]) >= low * np.maximum(n[right], n[i]) - 1e-6) & (right != i)]
        if len(js):
            for j in js[passes(np.broadcast_to(sketches[i], (len(js), REGISTERS)), sketches[js], np.full(len(js), n[i]), n[js], percent)].tolist():
                p, q = find(labels[i]), find(labels[j])
                if p != q:
                    root[p] = q
                    links.append((i, j))
    return links


def _meet(percent: int):
    def meet_all(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), g in frame.groupby(["key", "i", "j"], sort=False):
            ids, own = g.cid.to_numpy(), g.own.to_numpy()
            sketches = np.frombuffer(b"".join(g.registers), dtype=np.uint16).reshape(-1, REGISTERS)
            links = meet(sketches, g.n.to_numpy(dtype=np.float64), g.label.tolist(), np.flatnonzero(own == i), np.flatnonzero(own == j), percent)
            out += [(ids[a], ids[b]) for a, b in links]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return meet_all


def confirmed(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that reach the threshold, by exact intersection sizes of all pairs."""
    k = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(k), size)
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(seen > 1) - 1  # of the shingles that more than one set has
    shared = seen[at] > 1
    rows, cols = owner[shared], column[at[shared]]
    both = np.zeros((k, k), dtype=np.float64)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for lo in range(0, int(cols[-1]) + 1 if len(cols) else 0, 8192):
        a, b = np.searchsorted(cols, [lo, lo + 8192])
        held = np.zeros((k, 8192), dtype=np.float32)
        held[rows[a:b], cols[a:b] - lo] = 1
        both += held @ held.T
    union = size[:, None] + size[None, :] - both
    left, right = np.nonzero(np.triu(100 * both >= percent * union, 1))
    root = list(range(k))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    links = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q:
            root[p] = q
            links.append((i, j))
    return links


def _confirm(percent: int):
    def confirm(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in frame.groupby(["cluster", "i", "j"], sort=False):
            ids, sets, known = [], [], set()
            for cid, n, hi, lo, text in g[["cid", "n", "hi", "lo", "text"]].itertuples(index=False):
                if cid in known:
                    continue
                s = shingle_set(text)
                d = xxhash.xxh3_128_digest(s.tobytes())
                # another text under the same id isn't the class's
                if len(s) == n and (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)) == (hi, lo):
                    ids.append(cid)
                    sets.append(s)
                    known.add(cid)
            if len(ids) > 1:
                out += [(ids[i], ids[j]) for i, j in confirmed(sets, percent)]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return confirm


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """A side of so many rows, broadcast if that is few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _left_over(keyed: DataFrame, lean: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """(u, v): passing pairs of buckets' members that the centres left in different clusters. Up to three members have all met."""
    full = keyed.groupBy("key").count().where("count > 3").select("key").checkpoint()
    named = keyed.join(_sent(full, full.count()), "key").join(clusters.select(F.col("id").alias("cid"), "component"), "cid", "left").select("key", "cid", F.coalesce("component", "cid").alias("label"))
    by = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("m"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    opened = by.select("key", "main", F.ceil((F.col("all") - F.col("m")) / BLOCK).cast("int").alias("rest"), F.ceil(F.col("m") / BLOCK).cast("int").alias("mains")).checkpoint()
    members = named.join(_sent(opened, opened.count()), "key")
    is_main = F.col("label") == F.col("main")
    h = F.xxhash64("cid")
    members = members.select("key", "cid", "label", F.when(is_main, F.col("rest") + F.pmod(h, F.col("mains"))).otherwise(F.pmod(h, F.col("rest"))).cast("int").alias("own"), F.when(is_main, F.col("rest")).otherwise(F.col("rest") + F.col("mains")).alias("others")).checkpoint()
    dealt = members.join(lean, "cid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "n", "label", "registers")
    groups = max(1, int(members.agg(F.coalesce(F.sum("others"), F.lit(0))).first()[0]) // 2048)
    return dealt.withColumn("g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups))).groupBy("g").applyInPandas(_meet(percent), "u long, v long")


def _compare(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(u, v): confirmed links of members (cluster, cid, n, hi, lo, own, others): each is dealt to its block's meetings with
    the blocks of ``others``. Groups are sized by what is dealt."""
    members = members.where(F.size("others") > 0).checkpoint()
    large = F.size("others") > 1
    count, dealt, met = members.agg(F.count(F.lit(1)), F.count_if(~large), F.coalesce(F.sum(F.when(large, F.size("others"))), F.lit(0))).first()
    texts = docs.select(F.col("doc_id").alias("cid"), "text").join(_sent(members, count), "cid")
    at = lambda groups: F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(max(1, int(groups)))).alias("g")
    rows = texts.where(~large).select("cluster", F.col("own").alias("i"), F.col("own").alias("j"), *_TEXT).select("*", at(dealt // GROUP_ROWS))
    links = rows.groupBy("g").applyInPandas(_confirm(percent), "u long, v long")
    if met:
        packed = texts.where(large).select("cluster", "own", "others", *_TEXT).groupBy("cluster", "own").applyInPandas(_pack, "cluster long, own int, others array<int>, packed binary")
        # two blocks' meeting has the pairs within each of them too
        blocks = packed.withColumn("other", F.explode("others")).where("other <> own").select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "packed")
        links = links.unionByName(blocks.select("*", at(met // GROUP_ROWS)).groupBy("g").applyInPandas(_confirm_packed(percent), "u long, v long"))
    return links.checkpoint()


_TEXT = ["cid", "n", "hi", "lo", "text"]


def _pack(frame: pd.DataFrame) -> pd.DataFrame:
    """A block of a cluster as one row; rows of similar length stand together."""
    rows = frame.sort_values("n")[_TEXT].itertuples(index=False, name=None)
    how = zstandard.ZstdCompressionParameters.from_level(3, window_log=24, enable_ldm=True)
    packed = zstandard.ZstdCompressor(compression_params=how).compress(pickle.dumps(list(rows)))
    return pd.DataFrame({"cluster": frame.cluster.iloc[:1], "own": frame.own.iloc[:1], "others": frame.others.iloc[:1], "packed": [packed]})


def _confirm_packed(percent: int):
    confirm = _confirm(percent)

    def confirm_blocks(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (cluster, i, j), g in frame.groupby(["cluster", "i", "j"], sort=False):
            rows = [r for p in g.packed for r in pickle.loads(zstandard.decompress(p))]
            out.append(confirm(pd.DataFrame(rows, columns=_TEXT).assign(cluster=cluster, i=i, j=j)))
        return pd.concat(out)

    return confirm_blocks


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def confirm_clusters(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(u, v): a forest of the links of members (cluster, cid, n, hi, lo), which may be linked within clusters only."""
    sizes = members.groupBy("cluster").agg(_blocks(F.count(F.lit(1))).alias("blocks"))
    named = members.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    return _compare(docs, named.withColumn("others", F.sequence(F.lit(0), F.col("blocks") - 1)).drop("blocks"), percent)


def find_links(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v): confirmed links between classes, named by their smallest doc_id; enough of them to span each component."""
    least_set = -(-percent // (100 - percent))  # a set of n reaches n / (n + 1) at most with a different one
    large = classes.where((F.col("n") >= least_set) & F.col("cid").isNotNull())
    keyed = large.select("cid", F.explode(F.pandas_udf(_keys, "array<long>")("registers")).alias("key")).checkpoint()
    ends = keyed.select("key", F.col("cid").bitwiseXOR(F.col("key")).alias("x")).groupBy("key").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a != b")
    centres = ends.select("key", F.array(F.col("a").bitwiseXOR(F.col("key")), F.col("b").bitwiseXOR(F.col("key"))).alias("centres"))
    pairs = keyed.join(centres, "key").select("cid", F.explode("centres").alias("c")).where("cid != c").select(F.least("cid", "c").alias("u"), F.greatest("cid", "c").alias("v")).distinct()

    lean = large.select("cid", "n", "registers")
    left = lean.toDF("u", "n", "a")
    right = lean.toDF("v", "m", "b")
    fit = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    sized = pairs.join(left.select("u", "n"), "u").join(right.select("v", "m"), "v").where(fit)
    passing = sized.join(left.select("u", "a"), "u").join(right.select("v", "b"), "v").where(_may_link(percent)("a", "b", "n", "m")).select("u", "v").checkpoint()

    passing = passing.unionByName(_left_over(keyed, lean, components(passing).checkpoint(), percent)).checkpoint()
    clusters = components(passing).checkpoint()
    members = clusters.join(large.select(F.col("cid").alias("id"), "n", "hi", "lo"), "id").select(F.col("component").alias("cluster"), F.col("id").alias("cid"), "n", "hi", "lo")
    return confirm_clusters(docs, members, percent)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each input row. Links reach ``percent`` (50 to 99) / 100."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.select("doc_id", F.pandas_udf(_sketches, "n long, hi long, lo long, registers binary")("text").alias("_s")).select("doc_id", "_s.*").checkpoint()
    classes = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("cid"), F.max("n").alias("n"), F.max("registers").alias("registers"), F.count(F.lit(1)).alias("copies")).checkpoint()
    found = components(find_links(docs, classes, percent)).withColumnRenamed("id", "cid")
    named = classes.select("hi", "lo", "cid", "copies").join(found, "cid", "left").where("component is not null or copies > 1").select("hi", "lo", F.coalesce("component", "cid").alias("component"))
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = rows.select("doc_id", "n", "hi", "lo").join(named, ["hi", "lo"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; columns as they came.

    Rows that repeat id and text count as one. Null and empty texts and rows without an id are in no group: they stay. An id
    with several texts stays if one of them is its group's smallest. An empty table stays empty.
    """
    out = near_duplicates(docs, percent).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).where("not kept or rows > 1").checkpoint()
    gone, again = out.where("not kept").select("doc_id"), out.where("kept").select("doc_id")
    n_gone, n_again = out.agg(F.count_if(~F.col("kept")), F.count_if(F.col("kept"))).first()
    rest = docs.join(_sent(gone, n_gone), "doc_id", "left_anti").select(*docs.columns)
    if not n_again:
        return rest
    single = rest.join(_sent(again, n_again), "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(rest.join(_sent(again, n_again), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
