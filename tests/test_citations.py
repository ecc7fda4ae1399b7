"""Markers, entries and payloads: named cases, and links against a plain reading of the rules."""

import re

import pytest
from pyspark.sql import functions as F

from refloom.functions import citations as c


@pytest.fixture(scope="module")
def one(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("marker", "want"),
    [
        ("(Orr et al., 2020)", [("Orr", "2020", "")]),
        ("(Ames et al., 2022; Bohr, 2012)", [("Ames", "2022", ""), ("Bohr", "2012", "")]),
        ("(Ames et al., 2022 and Bohr et al., 2012)", [("Ames", "2022", ""), ("Bohr", "2012", "")]),
        ("(Ames and Bohr, 2020)", [("Ames", "2020", "")]),
        ("(Ames & Bohr, 2020a)", [("Ames", "2020", "a")]),
        ("Dorn and Eden (2019)", [("Dorn", "2019", "")]),
        ("(Ames, 2019, 2020)", [("Ames", "2019", ""), ("Ames", "2020", "")]),
        ("(Ames, 2020a, b)", [("Ames", "2020", "a"), ("Ames", "2020", "b")]),
        ("(Ames, 2019; 2020)", [("Ames", "2019", ""), ("Ames", "2020", "")]),
        ("(Ames, 2019 and 2020)", [("Ames", "2019", ""), ("Ames", "2020", "")]),
        ("(2019)", [("", "2019", "")]),
        ("(Ames et al., n.d.; Bohr, 2012)", [("Ames", "", ""), ("Bohr", "2012", "")]),
        ("(Ames, 2020 and references therein)", [("Ames", "2020", "")]),
        ("(Ames, 2020; since the war)", [("Ames", "2020", "")]),
        ("(Ames, 2020; Since the war)", [("Ames", "2020", "")]),
        ("(Ó Briain, 2001; Pagán, 1999)", [("Ó Briain", "2001", ""), ("Pagán", "1999", "")]),
        ("", []),
    ],
)
def test_author_year_items(one, marker, want):
    assert [tuple(r) for r in one(c.author_year_items(F.lit(marker)))] == want


def test_entries(one):
    assert one(c.first_author_keys(F.lit("12. de Vries A, Lee B. Title. 2020;1:2."))) == ["devries", "vries"]
    assert one(c.first_author_keys(F.lit("[3] Østergård-Weiß K. T. 2001"))) == ["ostergardweiss"]
    assert one(c.first_author_keys(F.lit("lower case text"))) == []
    assert [tuple(r) for r in one(c.entry_years(F.lit("Ames A. T. 2020a;5:1. Accessed 2021, 12020.")))] == [("2020", "a"), ("2021", "")]
    assert one(c.marker_item_count(F.lit("[3,5-7]"), F.lit("numeric"))) == 4 and one(c.marker_item_count(F.lit("(no)"), F.lit("author"))) == 1


def test_payload_parts(one):
    assert one(c.payload_pmid(F.lit("PMID 12 3"), F.lit(None), F.lit(None))) == "123"
    assert one(c.payload_pmid(F.lit(""), F.lit("DOI: 1\npmid: 77"), F.lit("PMID: 5"))) == "77" and one(c.payload_pmid(F.lit(None), F.lit("x"), F.lit(None))) is None
    assert one(c.pmid_list(F.array(F.lit(" 7"), F.lit("x1"), F.lit("7"), F.lit("08")))) == ["7", "08"]
    people = F.from_json(F.lit('[{"family":" Lee ","given":"Ann bo"},{"literal":"Data Group"},{"given":"x"},{}]'), "array<struct<family:string,given:string,literal:string>>")
    assert one(c.author_names(people)) == ["Lee AB", "Data Group"]
    assert one(c.word_tag(F.lit(r" CITATION \l 1033 Abc20 \n"))) == "Abc20" and one(c.word_tag(F.lit(r"CITATION \n Tag \l 1033"))) == "Tag" and one(c.word_tag(F.lit("PAGE"))) is None
    assert one(c.uri_library(F.lit("http://zotero.org/groups/12/items/AB"))) == "groups:12" and one(c.uri_library(F.lit("x"))) is None
    assert one(c.field_kind(F.lit(" ADDIN ZOTERO_ITEM {}"))) == "ZOTERO_ITEM" and one(c.field_kind(F.lit("PAGEREF x"))) == "PAGEREF"
    assert one(c.record_query(F.lit("10.1/x"), F.lit(""), F.array(*map(F.lit, "abcd")), F.lit("T"), F.lit(None), F.lit("2001"))) == "10.1/x. a, b, c. T. 2001"


def test_endnote_records(one):
    xml = "<EndNote><Cite><record><contributors><authors><author><style face='x'>Lee, A</style></author><author>Ng, B</author></authors></contributors><titles><title><style>A &amp; <i>b</i></style></title></titles><dates><year>2001</year></dates><electronic-resource-num>doi:10.1/X</electronic-resource-num></record></Cite></EndNote>"
    want = [("A & b", "2001", "10.1/x", ["Lee, A", "Ng, B"])]
    text = " ADDIN EN.CITE " + xml.replace("10.1/X", "10.1234/X")
    assert [tuple(r) for r in one(c.endnote_items(F.lit(text)))] == [("A & b", "2001", "10.1234/x", ["Lee, A", "Ng, B"])] != want
    assert [r.year for r in one(c.endnote_items(F.lit(text.replace("<", "&lt;").replace(">", "&gt;"))))] == ["2001"]
    assert one(c.endnote_items(F.lit("ADDIN EN.CITE"))) == [] and one(c.endnote_items(F.lit("<EndNote><record>open"))) == []


@pytest.mark.parametrize(
    ("text", "raised", "lowered", "taken", "want"),
    [
        ("as shown12,13 here", [(8, 13)], [], [], [(8, 13)]),
        ("as shown12, here", [(8, 12)], [], [], [(8, 10)]),
        ("10 3 and R2 m2", [(3, 4), (10, 11), (13, 14)], [], [], []),
        ("1Department", [(0, 1)], [], [], []),
        ("the 3rd", [(4, 5)], [], [], []),
        ("range5-7.", [(5, 8)], [], [], [(5, 8)]),
        ("gone[12]", [(5, 7)], [], [(4, 8)], []),
        ("Jane Doe1,2, John Roe3 here", [(8, 11), (21, 22)], [], [], []),
        ("value0 as4", [(9, 10)], [], [], []),
        ("etap2", [(4, 5)], [(3, 4)], [], []),
        ("over1000", [(4, 8)], [], [], []),
    ],
)
def test_superscripts(spark, text, raised, lowered, taken, want):
    kind = "array<struct<start:int,stop:int>>"
    df = spark.createDataFrame([(text, raised, lowered, taken)], f"t string, r {kind}, l {kind}, k {kind}")
    assert [tuple(x) for x in df.select(c.superscript_spans(F.col("t"), F.col("r"), F.col("l"), F.col("k")).alias("x")).first().x] == want
    assert re.sub(r"\s", "", text)
