"""Moving a document from another manager's library: what becomes of the exported records, and of the citations that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.identifiers import none_if_empty, normalise_doi
from refloom.functions.names import fuzzy_title_key
from refloom.operators import library

AUTHORS = "array<struct<family:string,given:string,literal:string>>"


def split_authors(names: Column) -> Column:
    """"Last, First" strings as (family, given, literal)."""
    part = lambda x, i: F.trim(F.coalesce(F.get(F.split(x, ",", 2), i), F.lit("")))
    return F.transform(names, lambda x: F.struct(part(x, 0).alias("family"), part(x, 1).alias("given"), F.lit(None).cast("string").alias("literal"))).cast(AUTHORS)


def merged_record(found: Column, record: Column) -> Column:
    """What an item is made of: each field of the resolved work (title, doi, journal, year, type, volume, pages, authors) or, where that is
    empty, of the exported record, whose authors are strings."""
    of = lambda c: F.trim(F.coalesce(none_if_empty(F.trim(found[c])), record[c], F.lit("")))
    fields = [of(c).alias(c) for c in ("title", "doi", "journal", "year", "volume", "pages")]
    kind = F.coalesce(none_if_empty(found["type"]), F.lit("article-journal")).alias("type")
    authors = F.when(F.size(found["authors"]) > 0, found["authors"]).otherwise(split_authors(F.coalesce(record["authors"], F.array().cast("array<string>"))))
    return F.struct(*fields, kind, authors.alias("authors"))


def decide_records(records: DataFrame, index: DataFrame, gates: DataFrame) -> DataFrame:
    """records(source, rec, tier, retracted, found, record, pmid) with key, outcome and data: refused if the source's migration can't write or
    the library can't be read, skipped if retracted, matched if the library has the work, else create, with merged data.

    Only a resolution of tier high counts: others are the record's own fields.
    """
    rows = records.join(gates, "source", "left").withColumn("found", F.when(F.col("tier") == "high", F.col("found")))
    rows = rows.withColumn("data", merged_record(F.col("found"), F.col("record")))
    met = library.lookup(rows, index, F.col("data.doi"), F.col("pmid"), F.col("data.title"))
    fine = F.coalesce(F.col("readable") & (F.col("writable") == "yes"), F.lit(False))
    outcome = F.when(~fine, "refused").when(F.col("retracted"), "skipped").when(F.col("library_key").isNotNull(), "matched").otherwise("create")
    out = met.withColumn("outcome", outcome)
    return out.select("source", "rec", "record", F.when(F.col("outcome") == "matched", F.col("library_key")).alias("key"), "outcome", F.when(F.col("outcome") == "create", F.col("data")).alias("data"))


def _identity(doi: Column, title: Column) -> Column:
    return F.coalesce(F.concat(F.lit("doi:"), none_if_empty(normalise_doi(doi))), F.concat(F.lit("title:"), none_if_empty(fuzzy_title_key(title))))


def items_to_create(decided: DataFrame) -> DataFrame:
    """identity, data: one item for records of one DOI or, without it, one title, with the data of the first."""
    rows = decided.where("outcome = 'create'").withColumn("identity", _identity(F.col("data.doi"), F.col("data.title"))).where("identity is not null")
    return rows.groupBy("identity").agg(F.min_by("data", F.struct("source", "rec")).alias("data"))


def with_created(decided: DataFrame, answers: DataFrame) -> DataFrame:
    """Decided records with the keys that the service answered by identity: created, or failed without one."""
    rows = decided.withColumn("identity", F.when(F.col("outcome") == "create", _identity(F.col("data.doi"), F.col("data.title")))).join(answers.select("identity", F.col("key").alias("_new")), "identity", "left")
    made = F.col("outcome") == "create"
    return rows.select("source", "rec", "record", F.when(made, F.col("_new")).otherwise(F.col("key")).alias("key"), F.when(made & F.col("_new").isNull(), "failed").when(made, "created").otherwise(F.col("outcome")).alias("outcome"))


def migrate_citations(cited: DataFrame, records: DataFrame) -> DataFrame:
    """cited(source, doc, field, item, doi, title) with records of ``with_created`` -> with rec, key, outcome: of the record of its DOI, or
    else of its fuzzy title (of several the first), or unmatched; and status: converted if all items of its field have a key."""
    keyed = records.select("source", "rec", "key", "outcome", none_if_empty(normalise_doi(F.col("record.doi"))).alias("_doi"), none_if_empty(fuzzy_title_key(F.col("record.title"))).alias("_title"))
    first = lambda c, name: keyed.where(F.col(c).isNotNull()).groupBy("source", c).agg(F.min(F.struct("rec", "key", "outcome")).alias(name))
    asked = cited.withColumn("_doi", none_if_empty(normalise_doi(F.col("doi")))).withColumn("_title", none_if_empty(fuzzy_title_key(F.col("title"))))
    met = asked.join(first("_doi", "_d"), ["source", "_doi"], "left").join(first("_title", "_t"), ["source", "_title"], "left").withColumn("_r", F.coalesce("_d", "_t"))
    rows = met.select(*cited.columns, "_r.rec", "_r.key", F.coalesce("_r.outcome", F.lit("unmatched")).alias("outcome"))
    # a field's items are few; a join with their sum would look all of them up a second time, and lose those without doc or field
    whole = F.bool_and(F.col("key").isNotNull()).over(Window.partitionBy("doc", "field"))
    return rows.withColumn("status", F.when(whole, "converted").otherwise("left"))
