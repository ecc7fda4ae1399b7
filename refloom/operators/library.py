"""Library joins: indexes, precedence lookup, gated creation, key reconciliation, incremental merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.identifiers import none_if_empty, normalise_doi
from refloom.functions.names import fuzzy_title_key, library_title_key
from refloom.lineage import cut


def item_doi(doi: Column, extra: Column) -> Column:
    return none_if_empty(normalise_doi(F.coalesce(none_if_empty(doi), none_if_empty(F.regexp_extract(extra, r"(?im)^\s*DOI:\s*(.+)", 1)))))


def item_pmid(pmid: Column, extra: Column) -> Column:
    return F.coalesce(none_if_empty(pmid), none_if_empty(F.regexp_extract(extra, r"(?im)^\s*PMID:\s*(\d+)", 1)))


def identified(items: DataFrame) -> DataFrame:
    """items(pos, key, title, doi, pmid, extra) with clean doi, pmid and title_key."""
    return items.select("pos", "key", item_doi(F.col("doi"), F.col("extra")).alias("doi"), item_pmid(F.col("pmid"), F.col("extra")).alias("pmid"), none_if_empty(library_title_key(F.col("title"))).alias("title_key"))


def build_indexes(items: DataFrame) -> DataFrame:
    """(kind, value, key): the last item of a DOI or PMID wins, the first of a title."""
    rows = identified(items).select("pos", "key", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("doi", "doi"), ("pmid", "pmid"), ("title", "title_key"))))).alias("e")).select("pos", "key", "e.*").where("value is not null")
    return rows.groupBy("kind", "value").agg(F.when(F.first("kind") == "title", F.min_by("key", "pos")).otherwise(F.max_by("key", "pos")).alias("key"))


def lookup(rows: DataFrame, index: DataFrame, doi: Column, pmid: Column, title: Column) -> DataFrame:
    """rows with ``library_key`` and ``matched_by``: DOI before PMID before exact title."""
    out = rows.withColumn("_doi", none_if_empty(normalise_doi(doi))).withColumn("_pmid", none_if_empty(F.trim(pmid))).withColumn("_title", none_if_empty(library_title_key(title)))
    for kind in ("doi", "pmid", "title"):
        side = index.where(F.col("kind") == kind).select(F.col("value").alias(f"_{kind}"), F.col("key").alias(f"_key_{kind}"))
        out = out.join(side, f"_{kind}", "left")
    hit = F.coalesce("_key_doi", "_key_pmid", "_key_title")
    by = F.when(F.col("_key_doi").isNotNull(), "doi").when(F.col("_key_pmid").isNotNull(), "pmid").when(F.col("_key_title").isNotNull(), "title")
    return out.select(*rows.columns, hit.alias("library_key"), by.alias("matched_by"))


def gate_creation(candidates: DataFrame, index: DataFrame, degraded: bool = False) -> DataFrame:
    """candidates(pos, doi, pmid, title) with an outcome: skipped if the library has it, repeated within the batch, refused
    where an unreadable library could hide a title, else created. The library is asked by DOI before PMID before exact title.

    What a candidate is known by is worked out once and written out. Each distinct identity is looked up, not each candidate, and so
    are the PMIDs and titles that stand behind a stronger identity; candidates without one are spread, as equal keys would meet in a task.
    """
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    keyed = candidates.withColumn("_doi", named("doi", none_if_empty(normalise_doi(F.col("doi"))))).withColumn("_title", named("title", none_if_empty(library_title_key(F.col("title")))))
    keyed = keyed.withColumn("identity", F.coalesce("_doi", named("pmid", none_if_empty(F.col("pmid"))), "_title"))
    second = F.when(F.col("_doi").isNotNull(), named("pmid", none_if_empty(F.trim("pmid"))))
    third = F.when(F.col("identity") != F.col("_title"), F.col("_title"))
    keyed = cut(keyed.select(*candidates.columns, "identity", second.alias("_second"), third.alias("_third")))

    values = cut(index.select(F.concat_ws(":", "kind", "value").alias("_id"), "key"))
    # a window would send all rows of a hot identity to one task; the smallest position is an aggregate
    first = keyed.where("identity is not null").groupBy("identity").agg(F.min("pos").alias("_first"))
    own = F.when(F.col("identity").startswith("pmid:"), named("pmid", F.trim(F.substring("identity", 6, 2**31 - 1)))).otherwise(F.col("identity"))
    found = _met(keyed, "identity", first.withColumn("_id", own).join(values, "_id", "left").drop("_id").withColumnRenamed("identity", "_id").withColumnRenamed("key", "_key_identity"))
    # often few: written out, its size tells how to join it
    behind = cut(keyed.select(F.col("_second").alias("_id")).union(keyed.select("_third")).where("_id is not null").distinct().join(values, "_id"))
    for c in ("_second", "_third"):
        found = _met(found, c, behind.withColumnRenamed("key", f"_key{c}"))
    key = F.coalesce("_key_identity", "_key_second", "_key_third")
    by = F.when(F.col("_key_identity").isNotNull(), F.substring_index("identity", ":", 1)).when(F.col("_key_second").isNotNull(), "pmid").when(F.col("_key_third").isNotNull(), "title")
    outcome = F.when(F.col("library_key").isNotNull(), "skipped").when(F.col("_first") < F.col("pos"), "repeated").when(F.lit(degraded) & ~F.col("identity").startswith("doi:"), "refused").otherwise("created")
    out = found.withColumn("library_key", key).withColumn("matched_by", by).withColumn("outcome", outcome)
    return out.select("identity", *candidates.columns, "library_key", "matched_by", "outcome")


def _met(rows: DataFrame, column: str, side: DataFrame) -> DataFrame:
    """rows(pos) with what side(_id) has of the column's identifier, if any; those without an identifier are spread by position."""
    spread = F.coalesce(column, F.concat(F.lit("-"), F.xxhash64("pos").cast("string")))
    return rows.withColumn("_id", spread).join(side, "_id", "left").drop("_id")


def reconcile(cited: DataFrame, custom: DataFrame, omitted: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc, key, status) of keys: expected = (cited + custom) - omitted; orphan if expected but not listed, uncited if listed but not expected."""
    expected = cited.select("doc", "key").unionByName(custom.select("doc", "key")).distinct().join(omitted.select("doc", "key"), ["doc", "key"], "left_anti").withColumn("_e", F.lit(1))
    both = expected.join(listed.select("doc", "key").distinct().withColumn("_l", F.lit(1)), ["doc", "key"], "full")
    return both.select("doc", "key", F.when(F.col("_l").isNull(), "orphan").when(F.col("_e").isNull(), "uncited").otherwise("ok").alias("status"))


def merge_changes(changes: DataFrame, since: int = -1) -> DataFrame:
    """changes(version, key, op, payload) -> the live snapshot: the latest change of each key, deleted keys gone."""
    latest = changes.where(F.col("version") > since).groupBy("key").agg(F.max_by(F.struct("version", "op", "payload"), "version").alias("c"))
    return latest.where("c.op <> 'delete'").select("key", "c.version", "c.payload")


def reorder(asked: DataFrame, items: DataFrame) -> DataFrame:
    """asked(pos, key) with the item of each key, in the order asked for; null where there is none."""
    return asked.join(items, "key", "left")


def bind_positions(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked(request, pos, key) against rows(request, place, key, value): by key; only where no row of a request has a key, by place."""
    by = rows.groupBy("request").agg(F.max(F.col("key").isNotNull()).alias("_by_key"))
    match = lambda place: F.when(F.coalesce("_by_key", F.lit(False)), F.concat(F.lit("k"), "key")).otherwise(F.concat(F.lit("p"), F.col(place).cast("string"))).alias("_match")
    given = rows.join(by, "request").select("request", match("place"), "value")
    return asked.join(by, "request", "left").select("request", "pos", "key", match("pos")).join(given, ["request", "_match"], "left").drop("_match")


def cited_key(doi: Column, title: Column, year: Column, first_author: Column) -> Column:
    """Key of a cited work: its DOI, else title with year and first author."""
    return F.coalesce(F.concat(F.lit("doi:"), none_if_empty(normalise_doi(doi))), F.concat(F.lit("title:"), fuzzy_title_key(title), F.lit("|"), F.coalesce(year, F.lit("")), F.lit("|"), F.coalesce(first_author, F.lit(""))))


def not_yet_cited(rows: DataFrame, cited: DataFrame) -> DataFrame:
    """rows(cited_key) without those whose key is among the cited ones; rows without a key stay."""
    return rows.join(cited.select("cited_key").distinct(), "cited_key", "left_anti").select(*rows.columns)


def not_yet_cited_works(works: DataFrame, live: DataFrame) -> DataFrame:
    """works(doi, title, year, author) without those that live(doi, title, year, author), what a document cites already, has.

    By their key: the DOI, else the title with year and first author. A work without a DOI also goes if any live one has its title, since
    a live citation may lack year and authors; one with a DOI never goes by its title. Works without DOI and title stay.
    """
    title = lambda: none_if_empty(fuzzy_title_key(F.col("title")))
    key = F.when(none_if_empty(F.trim("doi")).isNotNull() | title().isNotNull(), cited_key(F.col("doi"), F.col("title"), F.col("year"), F.lower("author")))
    keys = live.select(key.alias("_key")).where("_key is not null").distinct().withColumn("_cited", F.lit(True))
    titles = live.select(title().alias("_title")).where("_title is not null").distinct().withColumn("_shadow", F.lit(True))
    met = works.withColumn("_key", key).withColumn("_title", F.when(none_if_empty(F.trim("doi")).isNull(), title())).join(keys, "_key", "left").join(titles, "_title", "left")
    return met.where("_cited is null and _shadow is null").select(*works.columns)
