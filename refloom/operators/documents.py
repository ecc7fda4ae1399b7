"""Views, fields and cited works of documents given as tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refloom.functions.citations import payload_pmid, word_tag
from refloom.functions.identifiers import none_if_empty, normalise_doi
from refloom.functions.rendering import excerpt

ITEM = "id STRING, uris ARRAY<STRING>, itemData STRUCT<title: STRING, DOI: STRING, PMID: STRING, note: STRING>"
CITATION = f"citationID STRING, citationItems ARRAY<STRUCT<{', '.join(p.replace(' ', ': ', 1) for p in ITEM.split(', ', 2))}>>"


def _visible(view: str) -> Column:
    shown = {"accepted": ~F.col("in_del") & ~F.col("in_move_from") & (F.col("kind") != "dt"), "rejected": ~F.col("in_ins") & ~F.col("in_move_to"), "raw": F.lit(True)}[view]
    return shown & ~F.col("in_fallback") & F.col("kind").isin("t", "dt")


def paragraphs(tokens: DataFrame, view: str = "accepted") -> DataFrame:
    """doc, part, para, text of a view: accepted (without deletions), rejected (without insertions) or raw.

    Each visible paragraph once: those inside text boxes belong to their box, not to the text (see text_boxes).
    """
    rows = tokens.where("error is null and not in_txbx").groupBy("doc", "part", "para").agg(F.array_sort(F.collect_list(F.when(_visible(view), F.struct("pos", "text")))).alias("t"), F.max("pstyle").alias("pstyle"))
    return rows.select("doc", "part", "para", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"), "pstyle")


def text_boxes(tokens: DataFrame, view: str = "accepted") -> DataFrame:
    """doc, part, para, text of the paragraphs inside text boxes; a box's copy for old readers is left out."""
    rows = tokens.where("error is null and in_txbx and not in_fallback").groupBy("doc", "part", "para").agg(F.array_sort(F.collect_list(F.when(_visible(view), F.struct("pos", "text")))).alias("t"))
    return rows.select("doc", "part", "para", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))


def fields(tokens: DataFrame) -> DataFrame:
    """doc, part, pos, instruction of the outermost complete fields, of simple ones and of content controls that carry a citation."""
    w = Window.partitionBy("doc", "part").orderBy("pos")
    step = F.when(F.col("text") == "begin", 1).when(F.col("text") == "end", -1).otherwise(0)
    marks = tokens.where("kind in ('fld', 'instr')").withColumn("depth", F.sum(F.when(F.col("kind") == "fld", step).otherwise(0)).over(w))
    opens = (F.col("kind") == "fld") & (F.col("text") == "begin") & (F.col("depth") == 1)
    marks = marks.withColumn("field", F.sum(F.when(opens, 1).otherwise(0)).over(w)).where("field > 0")
    complex_ = marks.groupBy("doc", "part", "field").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.when((F.col("kind") == "instr") & (F.col("depth") == 1), F.struct("pos", "text")))).alias("t"), F.max((F.col("text") == "end") & (F.col("depth") == 0) & (F.col("kind") == "fld")).alias("complete"))
    complex_ = complex_.where("complete").select("doc", "part", "pos", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("instruction"))
    return complex_.unionByName(tokens.where("kind in ('fldsimple', 'sdt')").select("doc", "part", "pos", F.col("text").alias("instruction")))


def manager(instruction: Column) -> Column:
    """Which citation manager wrote a field; the order of the rules matters. Null for other fields."""
    x = F.trim(instruction)
    return (
        F.when(x.rlike(r"^ADDIN ZOTERO_"), "zotero").when(x.rlike(r"EN\.CITE|EN\.REF"), "endnote")
        .when(x.rlike(r"(?i)CSL_CITATION|mendeley"), "mendeley").when(x.rlike(r"^(?:CITATION|BIBLIOGRAPHY)\b"), "word")
    )


def manager_counts(found: DataFrame) -> DataFrame:
    by = found.withColumn("manager", manager(F.col("instruction"))).groupBy("doc")
    return by.agg(*(F.count_if(F.col("manager") == m).alias(m) for m in ("zotero", "mendeley", "endnote", "word")))


def citation_sources(found: DataFrame, manual: DataFrame) -> DataFrame:
    """fields(doc, pos, instruction) and manual references(doc, para, text, doi, title) -> doc, manager, place, excerpt, doi, title,
    low_confidence: a row for each citation; one without a field is of manager ``manual`` and only a guess. Other fields have none.
    Of a field with several works the first one's identifiers are given; a malformed payload has none."""
    by = found.withColumn("manager", manager(F.col("instruction"))).where("manager is not null")
    first = cited_items(by).where("item = 0").select("doc", "pos", "doi", "title")
    fields_ = by.join(first, ["doc", "pos"], "left").select("doc", "manager", F.col("pos").cast("long").alias("place"), excerpt(F.col("instruction")).alias("excerpt"), "doi", "title", F.lit(False).alias("low_confidence"))
    return fields_.unionByName(manual.select("doc", F.lit("manual").alias("manager"), F.col("para").cast("long").alias("place"), excerpt(F.col("text")).alias("excerpt"), "doi", "title", F.lit(True).alias("low_confidence")))


def source_counts(sources: DataFrame) -> DataFrame:
    """doc and how many citations each manager has, and how many are manual."""
    return sources.groupBy("doc").agg(*(F.count_if(F.col("manager") == m).alias(m) for m in ("zotero", "mendeley", "endnote", "word", "manual")))


def cited_items(found: DataFrame) -> DataFrame:
    """doc, pos, item, key, title, doi of the works that fields cite; malformed payloads are skipped."""
    parsed = found.select("doc", "pos", F.from_json(F.regexp_extract("instruction", r"(?s)\{.*\}", 0), CITATION).alias("c")).where("c.citationItems is not null")
    items = parsed.select("doc", "pos", F.posexplode("c.citationItems").alias("item", "x"))
    key = F.coalesce(none_if_empty(F.element_at(F.split(F.get("x.uris", 0), "/"), -1)), F.col("x.id"))
    return items.select("doc", "pos", "item", key.alias("key"), F.col("x.itemData.title").alias("title"), F.col("x.itemData.DOI").alias("doi"))


def cited_data(found: DataFrame) -> DataFrame:
    """doc, pos, item, key, data of every work in the citation fields, data mapping its members to their JSON text. The key is the last
    part of the work's id, of its data or else of its entry; empty without one. Other fields and malformed payloads give nothing."""
    payload = F.when(F.contains("instruction", F.lit("ZOTERO_ITEM CSL_CITATION")), F.regexp_extract("instruction", r"(?s)\{.*\}", 0))
    # one parse: the members of a work's data, each as its JSON text
    items = found.select("doc", "pos", F.from_json(payload, "citationItems ARRAY<STRUCT<id: STRING, itemData: MAP<STRING, STRING>>>").alias("c")).select("doc", "pos", F.posexplode("c.citationItems").alias("item", "x"))
    raw = F.trim(F.coalesce(none_if_empty(F.col("x.itemData")["id"]), F.col("x.id"), F.lit("")))
    return items.select("doc", "pos", "item", F.element_at(F.split(raw, "/"), -1).alias("key"), F.col("x.itemData").alias("data"))


def _data(*names: str) -> Column:
    return F.trim(F.coalesce(*(none_if_empty(F.col("data")[n]) for n in names), F.lit("")))


def cited_dois(found: DataFrame) -> DataFrame:
    """doc, rank, doi: a document's cited DOIs in order, each in the form in which it came first."""
    rows = cited_data(found).withColumn("doi", _data("DOI", "doi")).where("doi <> ''")
    place = F.struct("pos", "item")
    # a DOI that a third of the fields cite is added up before it is shuffled
    first = rows.groupBy("doc", normalise_doi(F.col("doi")).alias("same")).agg(F.min_by("doi", place).alias("doi"), F.min(place).alias("at"))
    return first.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("at")).alias("rank"), "doi")


def cited_references(found: DataFrame) -> DataFrame:
    """doc, rank, key, doi, pmid, title, authors of a document's cited works in order: of one key the first, and all without a key."""
    data = F.col("data")
    rows = cited_data(found).select(
        "doc", F.struct("pos", "item").alias("at"), "key", _data("DOI", "doi").alias("doi"),
        F.coalesce(payload_pmid(F.coalesce(data["PMID"], data["pmid"]), data["extra"], data["note"]), F.lit("")).alias("pmid"),
        _data("title").alias("title"), data["author"].alias("authors"),
    )
    same = F.when(F.col("key") != "", F.col("key")).otherwise(F.concat(F.lit("/"), F.to_json("at")))
    first = rows.groupBy("doc", same.alias("same")).agg(F.min(F.struct("at", "key", "doi", "pmid", "title", "authors")).alias("r"))
    # authors are parsed of the works that stay
    authors = F.coalesce(F.from_json("r.authors", "ARRAY<STRUCT<family: STRING, given: STRING, literal: STRING>>"), F.array().cast("array<struct<family:string,given:string,literal:string>>"))
    return first.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("r.at")).alias("rank"), "r.key", "r.doi", "r.pmid", "r.title", authors.alias("authors"))


def cited_sources(found: DataFrame, sources: DataFrame) -> DataFrame:
    """doc, pos, tag, status, title, doi, year, authors of Word's CITATION fields by the sources stored in their document
    (``sources.docx.read_sources``): found, not found, or unreadable where the document has a store that can't be read and none that
    has the tag. Of several sources of one tag the last in the package counts."""
    tagged = found.where(manager(F.col("instruction")) == "word").select("doc", "pos", word_tag(F.col("instruction")).alias("tag")).where("tag is not null")
    stored = sources.where("error is null").groupBy("doc", "tag").agg(F.max(F.struct("part", "place", "title", "doi", "year", "authors")).alias("s"))
    broken = sources.where("error is not null").select("doc").distinct().withColumn("_broken", F.lit(True))
    met = tagged.join(stored, ["doc", "tag"], "left").join(broken, "doc", "left")
    status = F.when(F.col("s").isNotNull(), "found").when(F.col("_broken"), "unreadable").otherwise("not found")
    return met.select("doc", "pos", "tag", status.alias("status"), "s.title", "s.doi", "s.year", "s.authors")
