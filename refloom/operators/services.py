"""What is asked of remote services and kept from them, as relations: scans of pages, batches, identifier maps, caches and
their age, degraded reads. Nothing here connects; answers are tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.identifiers import none_if_empty, normalise_doi, normalise_pmcid
from refloom.functions.rendering import filled

# Seconds for a scan, rows of a page and of key batches, hours that caches serve, days that notices do.
BUDGET, LEAST_BUDGET, PAGE, KEYS_AT_ONCE = 120.0, 5.0, 100, 50
LIBRARY_HOURS, ANSWER_DAYS, NOTICE_DAYS = 24, 14, 7


def budget(asked: Column) -> Column:
    """Seconds for a scan: what is asked for, at least LEAST_BUDGET; BUDGET for what isn't a number."""
    return F.greatest(F.coalesce(F.trim(asked).try_cast("double"), F.lit(BUDGET)), F.lit(LEAST_BUDGET))


def scan_status(pages: DataFrame, most: int | None = None) -> DataFrame:
    """pages(scan, page, elapsed, total, n, budget) -> scan, pages, items, status of reading page by page.

    A scan ends with its total, with ``most`` items, with an empty page, or (late) with the page before which the budget
    was used up. It is complete only if it has read the total; less is an error, not a smaller library.
    """
    w = Window.partitionBy("scan").orderBy("page")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pages.withColumn("_before", before).withColumn("_late", F.col("elapsed") > F.col("budget"))
    goal = F.col("total") if most is None else F.least("total", F.lit(most))
    stop = (F.col("_before") >= goal) | F.col("_late") | (F.col("n") == 0)
    rows = rows.withColumn("_stopped", F.max(F.when(stop, 1).otherwise(0)).over(w))
    read = rows.groupBy("scan").agg(
        F.count_if(F.col("_stopped") == 0).alias("pages"), F.sum(F.when(F.col("_stopped") == 0, F.col("n")).otherwise(0)).alias("items"), F.max("total").alias("total"),
        F.min_by("_late", F.when(F.col("_stopped") == 1, F.col("page"))).alias("_late"), F.min_by("_before", F.when(F.col("_stopped") == 1, F.col("page"))).alias("_at"),
    )
    wanted = F.col("total") if most is None else F.least("total", F.lit(most))
    items = F.col("items") if most is None else F.least("items", F.lit(most))
    status = F.when(F.col("total").isNull(), "unknown total").when(items >= wanted, "complete").when(F.coalesce("_late", F.lit(False)), "out of time").otherwise("incomplete")
    return read.select("scan", "pages", items.alias("items"), status.alias("status"))


def probe(headers: DataFrame) -> DataFrame:
    """headers(scan, total, version as text) -> scan, total, version, ok: what isn't a number is an error, never 0."""
    total, version = F.trim("total").try_cast("long"), F.trim("version").try_cast("long")
    return headers.select("scan", total.alias("total"), version.alias("version"), total.isNotNull().alias("ok"))


def live(items: DataFrame) -> DataFrame:
    """Items that aren't in the trash."""
    return items.where(~F.coalesce(F.col("deleted"), F.lit(False)))


def search_items(items: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(query, text) against items(key, title, families, date): query, key where title, creators and year together hold
    every word of the text. Joined on each query's rarest word."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    held = items.select("key", words(F.concat_ws(" ", "title", F.array_join("families", " "), "date")).alias("have"))
    asked = queries.select("query", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    by_word = held.select("key", F.explode("have").alias("word"))
    often = by_word.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    rare = asked.select("query", F.explode("words").alias("word")).join(often, "word", "left").groupBy("query").agg(F.min_by("word", F.struct(F.coalesce("c", F.lit(0)), "word")).alias("word"))
    met = rare.join(by_word, "word").join(asked, "query").join(held, "key")
    return met.where(F.size(F.array_except("words", "have")) == 0).select("query", "key")


def by_key(asked: DataFrame, items: DataFrame) -> DataFrame:
    """asked(pos, key) with found and the item's version; a key that isn't there is not an error."""
    return asked.join(items.select("key", "version").withColumn("found", F.lit(True)), "key", "left").select("pos", "key", F.coalesce("found", F.lit(False)).alias("found"), "version")


def children(parents: DataFrame, items: DataFrame) -> DataFrame:
    """parents(key) with the number and sorted keys of their live children among items(key, parent, deleted)."""
    kids = live(items).where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("key")).alias("children"))
    return parents.join(kids, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def key_batches(keys: DataFrame, size: int = KEYS_AT_ONCE) -> DataFrame:
    """keys(list, pos, key) -> list, batch, keys: distinct keys in order of first place, so many a batch."""
    first = keys.groupBy("list", "key").agg(F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("list").orderBy("pos")) - 1
    return first.withColumn("_n", nth).withColumn("batch", F.floor(F.col("_n") / size)).groupBy("list", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "key"))), lambda x: x["key"]).alias("keys"))


def fetch_batched(asked: DataFrame, records: DataFrame, failed: DataFrame, size: int) -> DataFrame:
    """asked(list, pos, id) against records(id, ...), fetched in batches of ``size`` different ids a list, in order of first place, of which
    failed(list, batch) went wrong -> list, pos, id, batch, status (found, missing, degraded) and the record's columns.

    Each asked row has a row. What a failed batch asked for is degraded, not missing: its record isn't known. Of several records of an id
    the smallest counts.
    """
    first = asked.where("id is not null").groupBy("list", "id").agg(F.min("pos").alias("_pos"))
    nth = F.row_number().over(Window.partitionBy("list").orderBy("_pos", "id")) - 1
    batches = first.withColumn("batch", F.floor(nth / size)).select("list", "id", "batch").join(failed.select("list", "batch").distinct().withColumn("_bad", F.lit(True)), ["list", "batch"], "left")
    columns = [c for c in records.columns if c != "id"]
    one = records.groupBy("id").agg(F.min(F.struct(*columns)).alias("_r"))
    # a failed batch meets no record
    met = batches.withColumn("_id", F.when(F.col("_bad").isNull(), F.col("id"))).join(one.withColumnRenamed("id", "_id"), "_id", "left")
    status = F.when(F.col("_bad"), "degraded").when(F.col("_r").isNull(), "missing").otherwise("found")
    found = met.select("list", "id", "batch", status.alias("status"), *(F.col(f"_r.{c}").alias(c) for c in columns))
    return asked.join(found, ["list", "id"], "left").select("list", "pos", "id", "batch", F.coalesce("status", F.lit("missing")).alias("status"), *columns)


def fetch_status(fetched: DataFrame) -> DataFrame:
    """list, n, found, missing, degraded of ``fetch_batched``."""
    return fetched.groupBy("list").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("status") == x).alias(x) for x in ("found", "missing", "degraded")))


def deleted_since(changes: DataFrame, since: int) -> DataFrame:
    """Keys whose deletion came after a version."""
    return changes.where((F.col("op") == "delete") & (F.col("version") > since)).select("key").distinct()


def pmids_of_pmcids(asked: DataFrame, records: DataFrame) -> DataFrame:
    """asked(list, pmcid) with the PMID that records(pmcid, pmid, errmsg) give, for each spelling that was asked for."""
    known = records.where(filled(F.col("pmid")).isNotNull()).select(normalise_pmcid(F.col("pmcid")).alias("_id"), F.trim("pmid").alias("pmid")).where("_id is not null").groupBy("_id").agg(F.max("pmid").alias("pmid"))
    return asked.select("list", "pmcid").distinct().withColumn("_id", normalise_pmcid(F.col("pmcid"))).join(known, "_id", "left").select("list", "pmcid", "pmid")


def pmcids_of(asked: DataFrame, records: DataFrame) -> DataFrame:
    """asked(id), a DOI or PMID, with the PMCID that records(pmcid, pmid, doi) give."""
    ids = F.array(F.struct(F.lit("pmid").alias("kind"), filled(F.col("pmid")).alias("id")), F.struct(F.lit("doi").alias("kind"), none_if_empty(normalise_doi(F.col("doi"))).alias("id")))
    known = records.select(normalise_pmcid(F.col("pmcid")).alias("pmcid"), F.explode(ids).alias("e")).where("e.id is not null and pmcid is not null").groupBy("e.kind", "e.id").agg(F.min("pmcid").alias("pmcid")).toDF("_kind", "_id", "pmcid")
    digits = F.trim("id").rlike(r"^\d+$")
    keyed = asked.withColumn("_kind", F.when(digits, "pmid").otherwise("doi")).withColumn("_id", F.when(digits, F.trim("id")).otherwise(none_if_empty(normalise_doi(F.col("id")))))
    return keyed.join(known, ["_kind", "_id"], "left").select(*asked.columns, "pmcid")


def search_results(answers: DataFrame, most: int) -> DataFrame:
    """answers(term, pos, pmid, ok) -> term, pmids (digits only, distinct, in order, at most so many), degraded."""
    good = answers.where(F.col("ok") & F.trim("pmid").rlike(r"^\d+$")).groupBy("term", F.trim("pmid").alias("pmid")).agg(F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("term").orderBy("pos"))
    listed = good.withColumn("_n", nth).where(F.col("_n") <= most).groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "pmid"))), lambda x: x["pmid"]).alias("pmids"))
    status = answers.groupBy("term").agg((F.count_if(~F.col("ok")) > 0).alias("degraded"))
    return status.join(listed, "term", "left").select("term", F.coalesce("pmids", F.array().cast("array<string>")).alias("pmids"), "degraded")


def limited_queries(items: DataFrame, most: int = 60) -> DataFrame:
    """items(plan, pos, query) with ``asked``: whether its query is among the first ``most`` different ones of the plan."""
    first = items.groupBy("plan", "query").agg(F.min("pos").alias("_first"))
    nth = first.withColumn("_n", F.row_number().over(Window.partitionBy("plan").orderBy("_first")))
    return items.join(nth, ["plan", "query"]).select("plan", "pos", "query", (F.col("_n") <= most).alias("asked"))


def cache_usable(cached: DataFrame, scope: Column, kind: Column, library: Column) -> Column:
    """A cache serves if it has items and a version and is of this scope and this library; an unmarked one never does."""
    c = cached
    return F.coalesce(c["items"].isNotNull() & c["version"].try_cast("long").isNotNull() & (F.coalesce(c["top"], F.lit(True)) == scope) & (c["library_type"] == kind) & (c["library_id"] == library), F.lit(False))


def fresh(age: Column, limit: float) -> Column:
    """Whether something of an age serves under a limit in the same unit; an unknown age doesn't."""
    return F.coalesce((age >= 0) & (age < limit), F.lit(False))


def notice_source(age_days: Column, network: Column, refreshed: Column) -> Column:
    """(use, check, severity) of a notice feed: a fresh one; else a refreshed one; else a stale one with a note, or none."""
    there = age_days.isNotNull()
    row = lambda use, check, severity: F.struct(F.lit(use).alias("use"), F.lit(check).cast("string").alias("check"), F.lit(severity).cast("string").alias("severity"))
    return (
        F.when(there & (age_days <= NOTICE_DAYS), row("cached", None, None))
        .when(~network & there, row("stale", "CITE-RW-STALE-GATE", "WARN")).when(~network, row("none", "CITE-RW-STALE-GATE", "WARN"))
        .when(refreshed, row("refreshed", "CITE-RW-REFRESH", "INFO")).when(there, row("stale", "CITE-RW-STALE", "INFO")).otherwise(row("none", "CITE-RW-UNAVAIL", "INFO"))
    )


def index_source(age_hours: Column, readable: Column, doi_cache: Column, strict: Column) -> Column:
    """(use, degraded) of a library index: fresh cache, new read, and where reading fails and it isn't strict a stale cache or the DOIs alone; else unavailable."""
    row = lambda use, degraded: F.struct(F.lit(use).alias("use"), F.lit(degraded).alias("degraded"))
    return (
        F.when(fresh(age_hours, LIBRARY_HOURS), row("cached", False)).when(readable, row("read", False)).when(strict, row("unavailable", True))
        .when(age_hours.isNotNull(), row("stale", True)).when(doi_cache, row("dois only", True)).otherwise(row("unavailable", True))
    )


def resync_watermark(version_before: Column, version_after: Column) -> Column:
    """The version a full read is known to hold: the one from before it, so no change in between is passed over."""
    return F.least(version_before, version_after)


def can_write(access: Column) -> Column:
    """Whether a key's access says so plainly."""
    return F.coalesce(access == "true", F.lit(False))


def library_identity(group: Column, user: Column) -> Column:
    """(kind, id): a group before a user; null without either."""
    pick = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("id"))
    return F.when(filled(group).isNotNull(), pick("groups", filled(group))).when(filled(user).isNotNull(), pick("users", filled(user)))


def item_uri(kind: Column, library: Column, key: Column) -> Column:
    """An item's address, "" where any part of it is unknown."""
    return F.coalesce(F.concat(F.lit("http://zotero.org/"), filled(kind), F.lit("/"), filled(library), F.lit("/items/"), filled(key)), F.lit(""))


def timeout(asked: Column, usual: float = 10.0) -> Column:
    """Seconds to wait for an answer, at least one; the usual ones for what isn't a number."""
    return F.greatest(F.coalesce(F.trim(asked).try_cast("double"), F.lit(usual)), F.lit(1.0))
