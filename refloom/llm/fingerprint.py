"""Order MinHash fingerprints, within Spark's own functions.

Tokens are words, runs of up to 16 characters between spaces; characters from U+0E00 on, most of which belong to scripts
without spaces, are tokens of their own. A longer run (an address, encoded data) is cut after each vowel, low digit or
letter beyond ASCII, and after 16 characters without any: by what it holds, not by where it begins, so an edit moves only
the tokens around it. The elements of a text are its 3-token k-mers, each numbered by its
occurrence, so repeats differ. Hashes deal the elements into ``SLOTS`` slots; a slot takes its two minimal elements, keeps
them in text order and hashes the pair. A slot agrees only if both k-mers survive an edit in the same order, so likeness
(agreeing slots among those filled on either side) follows edit distance rather than set overlap.

A fingerprint is 4 hexadecimal digits a slot, ``....`` where the slot is empty. Nulls and empty texts, and those of spaces
only, have no tokens: all slots are empty, and two such texts are alike (1.0). Fewer than 3 tokens make one k-mer. Equal
texts have equal fingerprints. Documents without an id come last in the order. Repeated rows each have a row; among rows of
one id, the order is that of the texts. Columns other than doc_id and text are ignored.

Token positions count up to 2**26; the order of two chosen k-mers beyond that, in a text of over 64 million tokens, is that
of their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.llm.base import prepare
from refloom.llm.native import at, let, lengths, positions, run_starts

K, SLOTS, TUPLE = 3, 64, 2
_POS_BITS, _EMPTY = 26, "...."
_POS_MASK = (1 << _POS_BITS) - 1
_TOKEN = r"(?<![!-\u0DFF])[!-\u0DFF]{1,16}(?![!-\u0DFF])|[\u0E00-\x{10FFFF}]|[!-\u0DFF]{0,15}?[aeiouAEIOU0-4\x80-\u0DFF]|[!-\u0DFF]{1,16}"


def _kmers(tokens: Column) -> Column:
    n = F.size(tokens)
    several = F.transform(positions(n - (K - 1)), lambda i: F.xxhash64(*(at(tokens, i + j) for j in range(K))))
    return F.when(n >= K, several).when(n > 0, F.array(F.xxhash64(F.array_join(tokens, " ")))).otherwise(F.array().cast("array<bigint>"))


def _with_position(h: Column, i: Column) -> Column:
    """The hash's upper bits, made non-negative, above the position."""
    return F.shiftleft(F.shiftrightunsigned(h, _POS_BITS + 1), _POS_BITS).bitwiseOR(F.least(i, F.lit(_POS_MASK)).cast("long"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))

    def key(x: Column) -> Column:
        return F.shiftright(x, _POS_BITS)

    def slot(x: Column) -> Column:
        return F.shiftright(x, 57)

    def numbered(s: Column) -> Column:
        """Occurrence-numbered elements of the k-mers, sorted: their new hash (slot first) above the position."""
        return let(
            run_starts(s, key),
            lambda starts: let(
                F.flatten(F.transform(lengths(starts, F.size(s)), lambda n: F.sequence(F.lit(1), n))),
                lambda occurrence: F.sort_array(F.transform(s, lambda x, j: _with_position(F.xxhash64(key(x), at(occurrence, j)), x.bitwiseAND(F.lit(_POS_MASK))))),
            ),
        )

    def minimal(e: Column) -> Column:
        """slot -> hash of its minimal elements in text order, as a map."""

        def entry(start: Column, length: Column) -> Column:
            chosen = F.array_sort(F.transform(F.slice(e, start + 1, F.least(length, F.lit(TUPLE))), lambda x: F.struct(x.bitwiseAND(F.lit(_POS_MASK)).alias("p"), key(x).alias("h"))))
            return F.struct(slot(at(e, start)).cast("int").alias("k"), F.substring(F.lpad(F.hex(F.xxhash64(F.transform(chosen, lambda c: c["h"]))), 16, "0"), 13, 4).alias("v"))

        return let(run_starts(e, slot), lambda starts: F.map_from_entries(F.zip_with(starts, lengths(starts, F.size(e)), entry)))

    kmers = let(tokens, _kmers)
    packed = F.sort_array(let(kmers, lambda ks: F.transform(ks, lambda h, i: _with_position(h, i))))
    filled = let(let(packed, numbered), minimal)
    return F.lower(let(filled, lambda m: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.coalesce(at_map(m, k), F.lit(_EMPTY))), "")))


def at_map(m: Column, k: Column) -> Column:
    return F.try_element_at(m, k)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that are filled in either fingerprint; 1.0 if none is."""
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))

    def part(f: Column, k: Column) -> Column:
        return F.substr(f, k * 4 + 1, F.lit(4))

    filled = F.size(F.filter(slots, lambda k: (part(a, k) != _EMPTY) | (part(b, k) != _EMPTY)))
    same = F.size(F.filter(slots, lambda k: (part(a, k) == part(b, k)) & (part(a, k) != _EMPTY)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(same / filled)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint: one row for each input row."""
    return docs.select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


def following(ids: DataFrame, order: list[Column], key: str) -> DataFrame:
    """ids with ``next_<key>``: the key of the row that follows in the order, and of the first one after the last.

    Rows are dealt into ranges; a window looks within a range, and a table of one row for each range links their ends.
    """
    parts = max(1, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = ids.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("_range").orderBy(*order)
    linked = ranged.withColumn("_next", F.lead(key).over(inside)).withColumn("_first", F.row_number().over(inside) == 1).withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
    heads = linked.where("_first").select("_range", F.col(key).alias("_head"))
    ring = Window.orderBy("_range")  # one row for each range
    heads = heads.withColumn("_after", F.coalesce(F.lead("_head").over(ring), F.first("_head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return linked.join(F.broadcast(heads.select("_range", "_after")), "_range").select(*ids.columns, F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_next")).alias(f"next_{key}"))


def edited_copies(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited copy, whose last third is replaced by the start of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").count()
    if ids.where("count > 1 or doc_id is null").limit(1).count():  # only then is it worth a sort of the texts
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    else:
        rows = rows.withColumn("nth", F.lit(1))
    # a key without nulls, so that every row finds itself
    rows = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "nth", "doc_id", "text")
    sizes = rows.select("key", "nth", "doc_id", F.length("text").cast("long").alias("n_chars")).checkpoint()
    chain = following(sizes.select(F.struct("key", "nth").alias("row"), "doc_id", "nth", "n_chars"), [F.col("doc_id").desc_nulls_last(), F.col("nth")], "row")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    # texts are dealt once, with their fingerprints: both joins below take the same columns, so they share the exchange
    texts = rows.select("key", "nth", "text", fingerprint(F.col("text")).alias("fingerprint"))
    # what each document lends to the one before it: the start of its text, and its fingerprint
    asked = chain.select("next_row.key", "next_row.nth", F.col("row.key").alias("to_key"), F.col("row.nth").alias("to_nth"), third.alias("take"))
    lent = texts.join(asked, ["key", "nth"]).select(F.col("to_key").alias("key"), F.col("to_nth").alias("nth"), F.substr(F.col("text"), F.lit(1), F.col("take")).alias("start"), F.col("fingerprint").alias("next_fingerprint"))
    own = lent.join(sizes, ["key", "nth"])
    edited = texts.join(own, ["key", "nth"]).withColumn("edited", F.concat(F.substr(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.col("start")))
    done = edited.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
