"""Operators of the plan and apply workflows: occurrences, blocks, overlaps, groups, styles, time stamps, versioned writes, reports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_FORM = "%Y-%m-%d %H:%M:%S"
SEVERITIES = ("ERROR", "WARN", "INFO")
#: Above this many rows a small side is joined by a shuffle.
BROADCAST_ROWS = 100_000
# The seed of uneven gaps, and the least gap and spread of gaps.
SEED, LEAST_GAP, GAP_SPREAD, GAP_STEPS = "gf-spread-", 0.55, 0.9, 10_000


def consume_occurrences(planned: DataFrame, inventory: DataFrame) -> DataFrame:
    """planned(doc, text, place) against inventory(doc, text, marker): the n-th planned marker of a text takes the n-th there is."""
    nth = lambda d, by: d.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "text").orderBy(by)))
    return nth(planned, "place").join(nth(inventory, "marker"), ["doc", "text", "nth"]).select("doc", "text", "place", "marker")


def pair_blocks(marks: DataFrame) -> DataFrame:
    """marks(doc, pos, pmid, doi), one of the two filled -> doc, pos, pmid, doi: each PMID with the first DOI before the next PMID.

    A block's number is a running count, so no interval join is needed.
    """
    block = marks.withColumn("block", F.count("pmid").over(Window.partitionBy("doc").orderBy("pos"))).where("block > 0")
    return block.groupBy("doc", "block").agg(F.min(F.when(F.col("pmid").isNotNull(), F.col("pos"))).alias("pos"), F.max("pmid").alias("pmid"), F.min_by("doi", F.when(F.col("doi").isNotNull(), F.col("pos"))).alias("doi")).drop("block")


def drop_overlaps(spans: DataFrame) -> DataFrame:
    """spans(doc, pass, start, stop) -> those kept, taken by pass, then start; one that overlaps a kept one goes."""
    rows = spans.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pass", "start", "stop"))).alias("s"))
    none = F.slice(F.col("s"), 1, 0)
    keep = F.aggregate("s", none, lambda kept, x: F.when(F.exists(kept, lambda k: (x["start"] < k["stop"]) & (k["start"] < x["stop"])), kept).otherwise(F.array_append(kept, x)))
    return rows.select("doc", F.inline(keep))


def references_start(paragraphs: DataFrame, least: int = 3) -> DataFrame:
    """paragraphs(doc, para, is_heading, is_ref) -> doc, start: the first heading of references, else the first run of so many entries."""
    w = Window.partitionBy("doc").orderBy("para")
    island = paragraphs.withColumn("gap", F.sum(F.when(F.col("is_ref"), 0).otherwise(1)).over(w))
    runs = island.where("is_ref").groupBy("doc", "gap").agg(F.min("para").alias("start"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).groupBy("doc").agg(F.min("start").alias("run"))
    heads = paragraphs.groupBy("doc").agg(F.min(F.when(F.col("is_heading"), F.col("para"))).alias("head"))
    return heads.join(runs, "doc", "left").select("doc", F.coalesce("head", "run").alias("start"))


def split_body(paragraphs: DataFrame, starts: DataFrame) -> DataFrame:
    """Each paragraph with the part it is in: body or references."""
    return paragraphs.join(starts, "doc", "left").withColumn("part", F.when(F.col("para") >= F.col("start"), "references").otherwise("body")).drop("start")


def inherited(styles: DataFrame, value: str = "value") -> DataFrame:
    """styles(doc, style, based_on, value) -> doc, style, value: the nearest value up the chain of bases.

    A document's styles are few, so each document is a map and the chain a fold of as many steps as it has styles; a cycle ends there.
    """
    per = styles.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("style", F.struct(F.col("based_on").alias("base"), F.col(value).alias("v"))))).alias("m"), F.collect_list("style").alias("all"))
    one = per.select("doc", "m", F.explode("all").alias("style"), F.size("all").alias("n"))
    start = F.struct(F.col("style").alias("at"), F.lit(None).cast(styles.schema[value].dataType).alias("v"))

    def up(s: Column, _: Column) -> Column:
        here = F.try_element_at(F.col("m"), s["at"])
        return F.when(s["v"].isNotNull() | s["at"].isNull(), s).otherwise(F.struct(here["base"].alias("at"), here["v"].alias("v")))

    return one.select("doc", "style", F.aggregate(F.sequence(F.lit(1), F.col("n")), start, up, lambda s: s["v"]).alias(value))


def whole_markers(members: DataFrame) -> DataFrame:
    """members(doc, marker, key, items) -> doc, marker, keys: markers of which every item has a key."""
    by = members.groupBy("doc", "marker").agg(F.bool_and(F.col("key").isNotNull()).alias("all"), F.count(F.lit(1)).alias("n"), F.max("items").alias("items"), F.array_sort(F.collect_set("key")).alias("keys"))
    return by.where("all and n = items").select("doc", "marker", "keys")


def resolve_by_words(names: DataFrame, styles: DataFrame) -> DataFrame:
    """names(name, words) against styles(style, words): a name's style, if its words are all in the words of exactly one.

    Names and styles of the same words are handled as one. A set of words meets only the styles that hold its rarest word (rare among
    the styles), so frequent words make no rows.
    """
    bag = lambda c: F.array_sort(F.array_distinct(c))
    kinds = styles.groupBy(bag("words").alias("words")).agg(F.min("style").alias("lo"), F.max("style").alias("hi"))
    by_word = kinds.select("words", "lo", "hi", F.explode("words").alias("w"))
    counts = by_word.groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    small = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    named = names.select("name", bag("words").alias("asked"))
    rarest = named.select("asked").distinct().select("asked", F.explode("asked").alias("w")).join(F.broadcast(counts) if small else counts, "w", "left")
    rarest = rarest.groupBy("asked").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "w")).alias("r")).where("r.f > 0").select("asked", "r.w")
    hits = rarest.join(by_word, "w").where(F.size(F.array_except("asked", "words")) == 0)
    one = hits.groupBy("asked").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi").select("asked", F.col("lo").alias("style"))
    return named.join(one, "asked").select("name", "style")


def spread_times(events: DataFrame, start: str, stop: str) -> DataFrame:
    """events(doc, place) -> with at: seconds from start to stop, in order, with uneven gaps that depend on the place alone; a lone event falls on stop."""
    w = Window.partitionBy("doc").orderBy("place")
    i = F.row_number().over(w) - 2
    h = F.conv(F.substring(F.sha1(F.concat(F.lit(SEED), i.cast("string"))), 1, 8), 16, 10).cast("long")
    gap = F.when(i < 0, 0.0).otherwise(F.lit(LEAST_GAP) + F.lit(GAP_SPREAD) * ((h % GAP_STEPS) / F.lit(float(GAP_STEPS))))
    rows = events.withColumn("gap", gap).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc"))).withColumn("k", F.row_number().over(w))
    share = F.when(F.col("k") == F.col("n"), 1.0).otherwise(F.sum("gap").over(w) / F.sum("gap").over(Window.partitionBy("doc")))
    a, b = F.unix_timestamp(F.lit(start)), F.unix_timestamp(F.lit(stop))
    return rows.withColumn("at", F.timestamp_seconds(a + F.floor((b - a) * share))).drop("gap", "n", "k")


def spread_marks(marks: DataFrame, author: str, start: str, stop: str, least_minutes: int = 15) -> DataFrame:
    """marks(doc, mark, kind, author, para, pos, at) with ``at`` of one author's marks spread from start to stop, others' as they were.

    The tracked marks of a paragraph are one edit and share a time; each comment (kind ``comment``, placed where its range begins) has
    its own, before the paragraph's edit; comments without a place come last, by mark. A window shorter than ``least_minutes`` begins
    earlier; one that begins after its end is refused.
    """
    begin, end = (datetime.strptime(x, WINDOW_FORM) for x in (start, stop))
    if begin > end:
        raise ValueError(f"the window begins at {start}, after its end at {stop}")
    begin = min(begin, end - timedelta(minutes=least_minutes))
    comment = F.col("kind") == "comment"
    of_comment = lambda c: F.when(comment, F.coalesce(c, F.lit(0))).otherwise(F.lit(0))
    edit = F.struct(F.col("para").isNull().alias("lost"), F.coalesce("para", F.lit(0)).alias("para"), (~comment).alias("edit"), of_comment("pos").alias("pos"), of_comment("mark").alias("mark"))
    rows = marks.withColumn("_edit", F.when(F.col("author") == author, edit))
    events = rows.where("_edit is not null").select("doc", F.col("_edit").alias("place")).distinct()
    timed = spread_times(events, begin.strftime(WINDOW_FORM), end.strftime(WINDOW_FORM)).select("doc", F.col("place").alias("_edit"), F.col("at").alias("_at"))
    return rows.join(timed, ["doc", "_edit"], "left").select(*(F.coalesce("_at", "at").alias("at") if c == "at" else F.col(c) for c in marks.columns))


def versioned_write(items: DataFrame, patches: DataFrame) -> DataFrame:
    """patches(key, base_version, value) on items(key, version): written where the version is still the base, else conflict; missing without an item."""
    return patches.join(items.select("key", "version"), "key", "left").withColumn("outcome", F.when(F.col("version").isNull(), "missing").when(F.col("version") == F.col("base_version"), "written").otherwise("conflict"))


def ensure_names(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """wanted(name) against present(key, name), case and outer white space aside -> name_key, key: null where one must be created, once for each."""
    k = F.lower(F.trim("name"))
    have = present.groupBy(k.alias("name_key")).agg(F.min("key").alias("key"))
    return wanted.select(k.alias("name_key")).distinct().join(have, "name_key", "left")


def report(findings: DataFrame) -> DataFrame:
    """findings(doc, severity, check, message, location, source) -> doc, text: grouped by severity, ERROR first."""
    line = F.concat(F.lit("  ["), F.col("check"), F.lit("]"), F.coalesce(F.concat(F.lit("  ["), F.nullif("location", F.lit("")), F.lit("]")), F.lit("")), F.lit(" "), F.col("message"), F.coalesce(F.concat(F.lit("  ("), F.nullif("source", F.lit("")), F.lit(")")), F.lit("")))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    by = findings.where(F.col("severity").isin(*SEVERITIES)).groupBy("doc", "severity").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(line)).alias("lines"), F.first(rank).alias("rank"))
    block = F.concat(F.lit("--- "), F.col("severity"), F.lit(" ("), F.col("n").cast("string"), F.lit(") ---\n"), F.array_join("lines", "\n"))
    return by.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))).alias("b")).select("doc", F.concat(F.array_join(F.transform("b", lambda x: x["t"]), "\n"), F.lit("\n")).alias("text"))


def finding_json(check: Column, severity: Column, message: Column, location: Column, source: Column) -> Column:
    return F.to_json(F.struct(check.alias("check"), severity.alias("severity"), message.alias("message"), location.alias("location"), F.nullif(source, F.lit("")).alias("source")))


def disallowed_report(entries: DataFrame, examples: int = 3) -> DataFrame:
    """entries(doc, entry, fields) -> doc, field, n, examples: how many entries carry a field, and the first of them."""
    rows = entries.select("doc", "entry", F.explode("fields").alias("field"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc", "field").orderBy("entry")))
    return first.groupBy("doc", "field").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= examples, F.col("entry")))).alias("examples"))


def find_anchor(anchors: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """anchors(doc, anchor) in paragraphs(doc, para, text, is_toc) -> doc, anchor, n, para: para if one holds it, or one outside the contents."""
    hits = anchors.join(paragraphs, "doc").where(F.contains("text", "anchor"))
    by = hits.groupBy("doc", "anchor").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_toc")).alias("body"), F.min("para").alias("any"), F.min(F.when(~F.col("is_toc"), F.col("para"))).alias("one"))
    return by.select("doc", "anchor", "n", F.when(F.col("body") == 1, F.col("one")).when(F.col("n") == 1, F.col("any")).alias("para"))


def pages_until_nothing_new(seen: DataFrame) -> DataFrame:
    """seen(list, page, id) -> list, pages: how many pages to read until one adds nothing, that one included."""
    w = Window.partitionBy("list", "id").orderBy("page")
    by = seen.withColumn("new", F.row_number().over(w) == 1).groupBy("list", "page").agg(F.count_if("new").alias("new"))
    return by.groupBy("list").agg(F.coalesce(F.min(F.when(F.col("new") == 0, F.col("page"))), F.max("page")).alias("pages"))
