"""Benchmark decontamination: MinHash containment search with size partitions, then exact shingle containment.

Words are runs of letters and digits, lower-cased; a text's set holds its distinct 5-word shingles. A text of an item with
fewer words is one shingle of its own width, sought among the documents' shingles of that width. An item's set is the union
over its texts.

Search: of an item's shingles those are searched that at most ``HOT_ITEMS`` items have (all of them if the rest couldn't
tell), so a prompt that many items share pairs nothing. A document that holds ``threshold`` of an item holds at least k of
the searched shingles. Documents fall into partitions by set size (powers of two); a partition of sets below N has 4 N hash
bins for items of k >= 8 and N / 4 for items of k >= 64, and a document's signature is the smallest hash in each bin. A
shingle that document and item share is its bin's minimum on both sides with probability s = (1 - exp(-x)) / x, x = 0.3 or
4.8 (the sets' union over the bins), however long the document is; an item becomes a candidate from the number of equal
minima below which a containing document falls with probability ``MISSED`` at most. Items of k < 8 are sought by every
shingle of a document, and are candidates from k on: nothing is missed. Verification: the exact share of the item's shingles
that the candidate's full set holds, at least ``threshold``.

Nulls and empty texts have no shingles: never reported. Documents or items without an id can't be reported. Repeated rows
with one id are reported once, for the union of their sets. Empty tables give no pairs. Columns other than ids and text are
ignored.
"""

from __future__ import annotations

from math import comb, exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.base import prepare
from refloom.llm.native import at, let, positions, run_starts

WIDTH, THRESHOLD, MISSED, HOT_ITEMS = 5, 0.8, 1e-6, 64
#: Rows up to which a checked side is sent to every task: 24 bytes each.
BROADCAST_ROWS = 1_000_000
#: Least k of items that are sought by a signature, bits of its bins above those of the set size, and x.
KINDS = {1: (8, 2, 0.3), 2: (64, -2, 4.8)}
#: Sets of 2**29 shingles and more fit into no row.
_LAST_PARTITION = 28


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of the runs of ``width`` words, in order."""
    return F.transform(positions(F.size(words) - (width - 1)), lambda i: F.xxhash64(F.lit(width), *(at(words, i + j) for j in range(width))))


def _all_shingles(words: Column, widths: list[int]) -> Column:
    return F.array_distinct(F.concat(*(shingle_hashes(words, k) for k in widths)))


def _partition(n: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"), F.lit(_LAST_PARTITION))


def signature(shingles: Column, partition: Column, extra: int) -> Column:
    """Bin minima: an array of bin * 2**32 + the smallest upper half of a hash in that bin."""
    return let(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), partition + (1 + extra))) - 1,
        lambda mask: let(
            F.sort_array(F.transform(shingles, lambda h: F.shiftleft(h.bitwiseAND(mask), 32) + F.shiftrightunsigned(h, 32))),
            lambda s: F.transform(run_starts(s, lambda x: F.shiftright(x, 32)), lambda i: at(s, i)),
        ),
    )


def _keys(kind: int) -> Column:
    """What a document (p, s) is looked up by, for items of a kind."""
    if kind == 0:
        return F.transform("s", lambda h: F.xxhash64(F.lit(0), F.lit(0), h))
    signed = F.struct("p", signature(F.col("s"), F.col("p"), KINDS[kind][1]).alias("m"))
    return let(signed, lambda x: F.transform(x["m"], lambda m: F.xxhash64(F.lit(kind), x["p"], m)))


def least_hits(k: int, x: float) -> int:
    """The number of equal minima that a document holding k searched shingles stays below with probability MISSED at most."""
    s = (1 - exp(-x)) / x
    below, t = (1 - s) ** k, 0
    while below <= MISSED:
        t += 1
        below += comb(k, t) * s**t * (1 - s) ** (k - t)
    return max(1, t)


def _needed(k: Column, kind: Column) -> Column:
    """Hits from which an item is a candidate. Beyond k = 256 the number for 256 serves, which is only less strict."""
    tables = {i: F.array(*(F.lit(least_hits(n, x)) for n in range(least, 257))) for i, (least, _, x) in KINDS.items()}
    out = k
    for i, (least, _, _) in KINDS.items():
        out = F.when(kind == i, F.element_at(tables[i], (F.least(k, F.lit(256)) - (least - 1)).cast("int"))).otherwise(out)
    return out


def item_sets(items: DataFrame, widths: list[int]) -> DataFrame:
    """item_id, h, n (size of the item's set), k (searched shingles that a containing document holds at least), searched."""
    own = F.coalesce(*(F.when(F.col("width") == w, shingle_hashes(F.col("w"), w)) for w in widths))
    sets = items.select("item_id", F.explode(own).alias("h")).distinct()
    hot = sets.groupBy("h").count().where(F.col("count") > HOT_ITEMS).select("h", F.lit(True).alias("hot"))
    sets = sets.join(hot, "h", "left").select("item_id", "h", F.coalesce("hot", F.lit(False)).alias("hot")).checkpoint()
    return sets.join(sets.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("hot")).alias("cold")), "item_id")


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of the items that documents hold."""
    spark = prepare(docs.sparkSession)
    items = items.select(F.col(item_id).alias("item_id"), words_of(F.col("text")).alias("w")).where(F.col("item_id").isNotNull() & (F.size("w") > 0))
    items = items.withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most WIDTH numbers
    docs = docs.select(F.col(doc_id).alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    if not widths:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, n_item_shingles long, n_shared long, containment double")
    need = F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    k = F.col("cold") - (F.col("n") - need)  # of the cold shingles a containing document lacks n - need at most
    sets = item_sets(items, widths).select("item_id", "h", "n", need.alias("need"), F.when(k >= 1, k).otherwise(need).alias("k"), ((k < 1) | ~F.col("hot")).alias("searched"))
    kind = F.when(F.col("k") < KINDS[1][0], 0).when(F.col("k") < KINDS[2][0], 1).otherwise(2)
    sets = sets.select("item_id", "h", "n", "need", "searched", _needed(F.col("k"), kind).alias("needed"), kind.alias("kind")).checkpoint()
    kinds = sorted(r.kind for r in sets.select("kind").distinct().collect())  # at most three numbers

    # an item fits into the partitions of sets that can hold enough of it
    def registers(i: int) -> DataFrame:
        mine = sets.where(F.col("kind") == i)
        if i == 0:
            return mine.where("searched").select("item_id", "needed", F.xxhash64(F.lit(0), F.lit(0), "h").alias("key"))
        bits = F.greatest(F.lit(0), F.col("p") + (1 + KINDS[i][1]))
        dealt = mine.withColumn("p", F.explode(F.sequence(_partition(F.col("need")), F.lit(_LAST_PARTITION))))
        dealt = dealt.withColumn("bin", F.col("h").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)).withColumn("low", F.shiftrightunsigned("h", 32))
        least = dealt.groupBy("item_id", "p", "bin").agg(F.min_by(F.struct("low", "needed", "searched"), "low").alias("m")).where("m.searched")
        return least.select("item_id", "m.needed", F.xxhash64(F.lit(i), "p", F.shiftleft("bin", 32) + F.col("m.low")).alias("key"))

    found = registers(kinds[0])
    for i in kinds[1:]:
        found = found.unionByName(registers(i))
    found = found.checkpoint()
    size = found.count()

    own = docs.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", _all_shingles(F.col("w"), widths).alias("s")).select("doc_id", _partition(F.size("s")).alias("p"), "s")
    keys = [_keys(i) for i in kinds]
    probes = own.select("doc_id", F.explode(F.concat(*keys)).alias("key"))
    hits = probes.join(F.broadcast(found) if size <= BROADCAST_ROWS else found, "key")
    candidates = hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("met"), F.max("needed").alias("needed")).where("met >= needed").select("doc_id", "item_id").checkpoint()

    # only what candidates are to be compared in meets, so frequent shingles join nothing else
    asked = candidates.join(sets.select("item_id", "h", "n"), "item_id").checkpoint()
    few = asked.count() <= BROADCAST_ROWS
    ids = candidates.select("doc_id").distinct()
    some = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    full = some.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", F.explode(_all_shingles(F.col("w"), widths)).alias("h"))
    met = full.join(F.broadcast(asked) if few else asked, ["doc_id", "h"]).distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"), F.max("n").alias("n_item_shingles"))
    return (
        met.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
        .where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item_shingles"))
        .select("doc_id", "item_id", "n_item_shingles", "n_shared", "containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that hold no benchmark item, columns as they came. Rows without an id, texts without words and all rows
    beside an empty benchmark stay; repeated rows stay or go together."""
    found = find_contained(docs, items, threshold).select("doc_id").distinct().checkpoint()
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "doc_id", "left_anti").select(*docs.columns)
