"""The prefix trie of conversations: every distinct sequence of first turns is a node.

1. A turn (role, text) becomes a 128-bit digest of both and the text's length. A conversation is its digests in order, joined to one
   string, so that strings sort as turn arrays do and a conversation stands right before those that extend it.
2. Conversations are range-partitioned by (string, id) and sorted. Equal ones differ in their id, so a conversation that a third of
   all ids share is spread over partitions too.
3. In a partition a sweep keeps the open nodes on a stack. The common prefix of a row and the one before it (LCP) tells which nodes
   close and which open. A node that opens and closes between a partition's first and last row is finished there. Nodes on the paths
   of the first and the last row leave as fragments under a digest of their prefix.
4. Adjacent partitions are stitched: fragments of a node are added up, and for each border what both sides counted is taken off
   once, for all nodes of the common prefix of the last row before it and the first one after. Counts, sums and smallest members
   add up; ids that end at a node are hashed in a stream, fragment after fragment, which needs no list of them.
5. Children of finished nodes know their parent; children of fragments get it by a join with the stitched nodes, of which there are
   as many as partitions times turns at most (sent to all tasks only if they are few).

Null roles and texts count as empty ones. Turns sort by number, null first, then by digest. Rows without a conversation id take
no part; repeated rows are turns of their own. A conversation is held by one row, 40 bytes a turn. An empty table has no
conversation and so no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.base import prepare

#: Characters of a turn's digest; turns in a range partition; ids in a fragment of those that end; stitched nodes sent to all tasks.
WIDE, PART_TURNS, IDS, BROADCAST_ROWS, OUT_ROWS = 32, 200_000, 4096, 100_000, 8192
NOTHING = hashlib.sha256(b"").hexdigest()
SCHEMA = "kind string, key string, parent string, part int, seq long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string"


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, turns: an array of (digest, size) in order."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, WIDE)
    one = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), digest.alias("digest"), F.char_length(text).alias("size"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuild(arrays: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Every conversation with the first ``head`` turns (``most`` at most) of the conversation ``base`` in place of its own."""
    heads = arrays.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("first"))
    joined = arrays.withColumn("base", base).join(heads, "base", "left")
    first = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), head)
    own = F.slice("turns", head + 1, F.greatest(F.size("turns") - head, F.lit(0)))
    return joined.select("conv_id", F.concat(first, own).alias("turns"))


class Node:
    """An open node of the sweep. ``whole``: it opened after the partition's first row, so what came of it so far is all there is."""

    __slots__ = ("children", "depth", "ended", "ids", "key", "kids", "least", "leaves", "members", "saved", "seq", "sha", "size", "whole")

    def __init__(self, depth: int, size: int, key: str, whole: bool):
        self.depth, self.size, self.key, self.whole = depth, size, key, whole
        self.members, self.children, self.leaves, self.saved, self.least = 0, 0, 0, 0, None
        self.ended, self.seq, self.sha, self.ids, self.kids = 0, 0, None, [], []

    def add(self, members: int, least: int) -> None:
        self.members += members
        self.least = least if self.least is None else min(self.least, least)


def common_turns(a: str, b: str) -> int:
    n = min(len(a), len(b)) // WIDE
    k = 0
    while k < n and a[k * WIDE : (k + 1) * WIDE] == b[k * WIDE : (k + 1) * WIDE]:
        k += 1
    return k


def next_key(key: str, path: str, depth: int) -> str:
    """The key of the prefix of ``depth`` turns, from that of one turn less."""
    return xxhash.xxh3_128_hexdigest(key + path[(depth - 1) * WIDE : depth * WIDE])


def sweep(part: int, rows: Iterator[tuple[int, str, list[int]]]) -> Iterator[tuple]:
    """Sorted rows (id, path, sizes of turns) of a partition -> rows of SCHEMA.

    node: a finished one, with its parent's id or, below a fragment, its parent's key. part: a fragment. ends: ids that end at a
    fragment, in order. edge: the path of the first and of the last row (seq 0 and 1), sizes in ``ends``.
    """
    stack: list[Node] = []
    last, sizes = None, []

    def row(kind: str, key=None, parent=None, seq=None, conv=None, depth=None, up=None, n=None, c=None, leaves=None, saved=None, ends=None) -> tuple:
        return (kind, key, parent, part, seq, conv, depth, up, n, c, leaves, saved, ends)

    def flush_ids(v: Node) -> Iterator[tuple]:
        if v.ids:
            yield row("ends", key=v.key, seq=v.seq, ends=",".join(map(str, v.ids)))
            v.seq, v.ids = v.seq + 1, []

    def flush_kids(v: Node) -> Iterator[tuple]:
        for kid in v.kids:
            yield (*kid[:2], v.key, *kid[3:])
        v.kids = []

    def close(at_end: bool) -> Iterator[tuple]:
        """Take the top node off. At the partition's end it may go on in the next one."""
        v = stack.pop()
        v.leaves += v.children == 0
        v.saved += (v.members - 1) * v.size
        up = stack[-1] if stack else None
        if up:
            up.leaves, up.saved, up.children = up.leaves + v.leaves, up.saved + v.saved, up.children + 1
            up.add(v.members, v.least)
        if v.whole and not at_end:
            for kid in v.kids:
                yield (*kid[:7], v.least, *kid[8:])
            up.kids.append(row("node", conv=v.least, depth=v.depth, n=v.members, c=v.children, leaves=v.leaves, saved=v.saved, ends=v.sha.hexdigest() if v.sha else NOTHING))
            if not up.whole and len(up.kids) >= IDS:
                yield from flush_kids(up)
        else:
            yield from flush_ids(v)
            yield from flush_kids(v)
            yield row("part", key=v.key, parent=up.key if up else None, conv=v.least, depth=v.depth, n=v.members, c=v.children, leaves=v.leaves, saved=v.saved)

    for conv, path, row_sizes in rows:
        if last is None:
            yield row("edge", seq=0, key=path, ends=",".join(map(str, row_sizes)))
            stack.append(Node(0, 0, "", False))
        else:
            keep = common_turns(last, path)
            while len(stack) > keep + 1:
                yield from close(False)
        for d in range(len(stack), len(row_sizes) + 1):
            stack.append(Node(d, row_sizes[d - 1], next_key(stack[-1].key, path, d), last is not None))
        v = stack[-1]
        v.add(1, conv)
        if v.whole:
            # it may turn out to be a fragment, so that its ids are written in chunks besides
            v.sha = v.sha or hashlib.sha256()
            v.sha.update((f",{conv}" if v.ended else str(conv)).encode())
        v.ended += 1
        v.ids.append(conv)
        if len(v.ids) >= IDS:
            yield from flush_ids(v)
        last, sizes = path, row_sizes
    if last is not None:
        while stack:
            yield from close(True)
        yield row("edge", seq=1, key=last, ends=",".join(map(str, sizes)))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyspark

    part = pyspark.TaskContext.get().partitionId()
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    numbers = ("seq", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns, dtype="object")
        return out.astype(dict.fromkeys(numbers, "Int64") | {"part": "Int32"})

    held = []
    rows = ((int(c), p, [int(x) for x in s]) for b in batches for c, p, s in zip(b.conv_id, b.path, b.sizes, strict=True))
    for out in sweep(part, rows):
        held.append(out)
        if len(held) >= OUT_ROWS:
            yield frame(held)
            held = []
    if held:
        yield frame(held)


def borders(before: str, sizes: list[int], after: str) -> list[tuple[str, int, int, int]]:
    """The last path before a border, its sizes, and the first one after -> key, children, leaves, saved for each node of their common
    prefix: what has to be added to the fragments of both sides, since both counted the common nodes."""
    common = common_turns(before, after)
    keys = [""]
    for d in range(1, common + 1):
        keys.append(next_key(keys[-1], before, d))
    out, below = [], 0
    for d in range(common, -1, -1):
        below += sizes[d - 1] if d else 0
        out.append((keys[d], -int(d < common), -int(common == len(sizes)), below))
    return out


def _borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ints = lambda s: [int(x) for x in s.split(",")] if s else []
    for b in batches:
        rows = [x for p, z, a in zip(b.before, b.sizes, b.after, strict=True) for x in borders(p, ints(z), a)]
        yield pd.DataFrame(rows, columns=["key", "c", "l", "s"])


def _hash_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks sorted by (key, part, seq) -> key, ends: the hash of each key's chunks joined by commas."""
    at, sha, out = None, None, []
    for b in batches:
        for key, ends in zip(b.key, b.ends, strict=True):
            if key != at:
                if at is not None:
                    out.append((at, sha.hexdigest()))
                at, sha = key, hashlib.sha256()
                sha.update(ends.encode())
            else:
                sha.update(f",{ends}".encode())
        yield pd.DataFrame(out, columns=["key", "ends"], dtype="object")
        out = []
    if at is not None:
        yield pd.DataFrame([(at, sha.hexdigest())], columns=["key", "ends"], dtype="object")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """conv_id, turns (as of ``turn_arrays``), one row an id -> a row for each node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = prepare(rebuilt.sparkSession)
    paths = rebuilt.select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")).checkpoint()
    turns = paths.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(turns) // PART_TURNS))
    swept = paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInPandas(_sweep, SCHEMA).checkpoint()

    # two rows a partition
    edges = swept.where("kind = 'edge'").select("part", "seq", F.col("key").alias("before"), F.col("ends").alias("sizes"))
    after = Window.orderBy("part", "seq")
    edges = edges.withColumns({"after": F.lead("before").over(after)}).where("seq = 1 and after is not null")
    twice = edges.select("before", "sizes", "after").mapInPandas(_borders, "key string, c long, l long, s long")
    zero, none = F.lit(0).cast("long"), F.lit(None)
    counted = swept.where("kind = 'part'").select("key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved")
    counted = counted.unionByName(twice.select("key", none.cast("string").alias("parent"), none.cast("long").alias("conv_id"), none.cast("long").alias("depth"), zero.alias("n_convs"), F.col("c").alias("n_children"), F.col("l").alias("n_leaves"), F.col("s").alias("saved")))
    whole = counted.groupBy("key").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")))
    chunks = swept.where("kind = 'ends'").select("key", "part", "seq", "ends").repartition("key").sortWithinPartitions("key", "part", "seq")
    hashed = chunks.mapInPandas(_hash_ends, "key string, ends string")
    stitched = whole.join(hashed, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(NOTHING))).checkpoint()

    few = stitched.count() <= BROADCAST_ROWS
    named = stitched.select(F.col("key").alias("parent"), F.col("conv_id").alias("up"))
    named = F.broadcast(named) if few else named
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256")]
    nodes = swept.where("kind = 'node'")
    inner = nodes.where("parent is null").select(columns)
    below = nodes.where("parent is not null").drop("parent_conv_id").join(named, "parent").withColumnRenamed("up", "parent_conv_id").select(columns)
    return inner.unionByName(below).unionByName(stitched.join(named, "parent", "left").withColumnRenamed("up", "parent_conv_id").select(columns))
