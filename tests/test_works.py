"""Cited works of fields, stores of sources in packages, records merged by precedence: named cases."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from refloom.functions import people, rendering
from refloom.operators import documents, migration, services
from refloom.sources import docx


def field(*items):
    return "ADDIN ZOTERO_ITEM CSL_CITATION " + json.dumps({"citationItems": list(items)}) + " "


def test_cited_works_once_in_order(spark):
    rows = [
        ("d", 1, field({"id": "1/K1", "itemData": {"DOI": " 10.1/A ", "title": "T", "PMID": 12, "author": [{"family": "Lee"}]}}, {"id": "", "itemData": {"title": "no key"}})),
        ("d", 2, "ADDIN ZOTERO_ITEM CSL_CITATION {broken"), ("d", 3, None), ("d", 4, "ADDIN ZOTERO_BIBL {}"),
        ("d", 5, field({"id": "9", "itemData": {"id": "x/K1", "doi": "https://doi.org/10.1/a."}}, {"itemData": {"title": "no key"}}, {"id": "7", "itemData": {"DOI": "10.1/b", "extra": "a\nPMID: 77", "author": "odd"}})),
    ]
    found = spark.createDataFrame(rows, "doc string, pos long, instruction string")
    assert [r.doi for r in documents.cited_dois(found).orderBy("rank").collect()] == ["10.1/A", "10.1/b"]
    got = [(r.key, r.doi, r.pmid, r.title, len(r.authors)) for r in documents.cited_references(found).orderBy("rank").collect()]
    assert got == [("K1", "10.1/A", "12", "T", 1), ("", "", "", "no key", 0), ("", "", "", "no key", 0), ("7", "10.1/b", "77", "", 0)]
    assert documents.cited_dois(found.limit(0)).count() == documents.cited_references(found.limit(0)).count() == 0


def test_a_cited_work_is_parsed_once(spark):
    twice = '{"id": "a/K3", "itemData": {"DOI": "10.1/c", "DOI": "10.1/d", "title": null, "note": {"x": [1, 2]}}}'
    rows = [
        ("d", 1, field({"id": "1/K1", "itemData": "odd"}, {"id": "K2", "itemData": {"DOI": "10.1/b", "title": 5}}, {"id": "K4", "itemData": None}, {"id": "K5", "itemData": [1]})),
        ("d", 2, 'ADDIN ZOTERO_ITEM CSL_CITATION {"citationItems": [' + twice + "]}"),
    ]
    found = documents.cited_references(spark.createDataFrame(rows, "doc string, pos long, instruction string"))
    assert [(r.key, r.doi, r.title, len(r.authors)) for r in found.orderBy("rank").collect()] == [("K1", "", "", 0), ("K2", "10.1/b", "5", 0), ("K4", "", "", 0), ("K5", "", "", 0), ("K3", "10.1/c", "", 0)]
    assert "get_json_object" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sources_are_read_and_joined_by_tag(spark, tmp_path):
    b = docx.B[1:-1]
    source = lambda tag, title: f"<b:Source><b:Tag>{tag}</b:Tag><b:Title>{title}</b:Title><b:Year>2020</b:Year><b:DOI>doi:10.1234/x.</b:DOI><b:Author><b:Author><b:NameList><b:Person><b:Last>Lee</b:Last><b:First>Ann bo</b:First></b:Person></b:NameList></b:Author></b:Author></b:Source>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("customXml/item1.xml", f'<b:Sources xmlns:b="{b}">{source("Lee20", "First")}{source("Lee20", "Second")}{source("", "no tag")}</b:Sources>')
        z.writestr("customXml/item2.xml", f'<b:Sources xmlns:b="{b}">')
        z.writestr("word/document.xml", "<x/>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    sources = docx.read_sources(spark, str(tmp_path)).cache()
    rows = sorted(((r.doc[-6:], r.part, r.tag, r.title, r.doi, r.authors, r.error is not None) for r in sources.collect()), key=str)
    assert rows == [("a.docx", "customXml/item1.xml", "Lee20", "First", "10.1234/x", ["Lee AB"], False), ("a.docx", "customXml/item1.xml", "Lee20", "Second", "10.1234/x", ["Lee AB"], False), ("a.docx", "customXml/item2.xml", None, None, None, None, True), ("b.docx", None, None, None, None, None, True)]
    doc = next(r.doc for r in sources.collect() if r.doc.endswith("a.docx"))
    found = spark.createDataFrame([(doc, 1, "CITATION Lee20 \\l 1033"), (doc, 2, " CITATION Zed "), ("c", 3, "CITATION Lee20"), (doc, 4, "PAGEREF x")], "doc string, pos long, instruction string")
    got = {r.pos: (r.status, r.title) for r in documents.cited_sources(found, sources).collect()}
    assert got == {1: ("found", "Second"), 2: ("unreadable", None), 3: ("not found", None)}


def test_records_are_merged_by_precedence(spark):
    found = "struct<title:string,doi:string,journal:string,year:string,type:string,volume:string,pages:string,authors:array<struct<family:string,given:string,literal:string>>>"
    record = "struct<title:string,doi:string,journal:string,year:string,volume:string,pages:string,authors:array<string>>"
    own = ("Own", "10.1234/o", "J", "1999", "3", None, ["Lee, Ann B", "WHO"])
    rows = [(1, (" Real ", "", None, "2001", "", "4", "1-9", [("Ng", "Po", None), (None, None, "Group")]), own), (2, None, own), (3, ("Real", "10.1234/r", None, None, None, None, None, []), (None,) * 7)]
    df = spark.createDataFrame(rows, f"rec int, found {found}, record {record}")
    got = {r.rec: r.m for r in df.select("rec", migration.merged_record(F.col("found"), F.col("record")).alias("m")).collect()}
    assert (got[1].title, got[1].doi, got[1].journal, got[1].year, got[1].volume, got[1].pages, got[1].type) == ("Real", "10.1234/o", "J", "2001", "4", "1-9", "article-journal")
    assert [a.literal or a.family for a in got[1].authors] == ["Ng", "Group"] and [(a.family, a.given) for a in got[2].authors] == [("Lee", "Ann B"), ("WHO", "")]
    assert (got[3].title, got[3].pages, got[3].authors) == ("Real", "", [])


def test_batches_that_fail_are_degraded(spark):
    asked = spark.createDataFrame([("l", i, x) for i, x in enumerate(["a", "b", "a", "c", None, "d"])] + [("m", 0, "c")], "list string, pos int, id string")
    records = spark.createDataFrame([("a", "A"), ("c", "C2"), ("c", "C1"), ("d", "D")], "id string, title string")
    failed = spark.createDataFrame([("l", 1), ("l", 9)], "list string, batch long")
    got = services.fetch_batched(asked, records, failed, 2).collect()
    assert sorted((r.list, r.pos, r.batch, r.status, r.title) for r in got) == [("l", 0, 0, "found", "A"), ("l", 1, 0, "missing", None), ("l", 2, 0, "found", "A"), ("l", 3, 1, "degraded", None), ("l", 4, None, "missing", None), ("l", 5, 1, "degraded", None), ("m", 0, 0, "found", "C1")]
    assert [tuple(r) for r in services.fetch_status(spark.createDataFrame(got)).orderBy("list").collect()] == [("l", 6, 2, 2, 2), ("m", 1, 1, 0, 0)]


def test_a_style_that_nobody_knows_is_an_error(spark):
    fields = [F.lit(x) for x in ("T", "J", "2001", "1", "", "2-3", "", "")]
    one = lambda style: spark.range(1).select(rendering.format_reference(F.lit(style), F.array(*map(F.lit, ["A B", "C D"])), *fields, F.lit("short"), {"short": 1})).first()[0]
    assert one("vancouver") == "A B, et al. T. J. 2001;1:2-3." and one("author_year").startswith("A B, C D (2001). T.")
    with pytest.raises(Exception, match="unknown style: odd"):
        one("odd")


def test_metadata_of_a_work_to_create(spark):
    raw = F.struct(F.lit("A <i>big</i> &amp;amp; bold").alias("t"), F.lit(" J &amp; K ").alias("j"), F.array(*map(F.lit, ["SMITH-JONES, ANNA B", "WHO", " ", "McDonald J"])).alias("a"))
    once = spark.range(1).select(people.normalise_meta(raw["t"], raw["j"], raw["a"]).alias("m")).first().m
    assert (once.title, once.journal) == ("A big & bold", "J & K") and [(a.family, a.given) for a in once.authors] == [("Smith-Jones", "Anna B"), ("WHO", ""), ("McDonald", "J")]
