"""Short file names, and where a work's open file is: named cases."""

import hashlib

import pytest

from refloom.operators import access, naming

DATED = "2026_Oct_R01_Smith_Human_Microglia_Atlas_Project_Specific_Aims_draft_1.docx"


def short(spark, names, **how):
    rows = naming.short_names(spark.createDataFrame([("f", i, n) for i, n in enumerate(names)], "folder string, pos long, name string"), **how)
    return [r.short for r in rows.orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Aims.docx", "Aims.docx"),
        ("a__b.docx", "a__b.docx"),
        ("my aims.docx", "my_aims.docx"),
        (".profile", "profile"),
        ("été.p df", "t.p_df"),
        ("***.txt", "file.txt"),
        ("One_Two_Three_Four_Five_Six_Seven_Eight_draft_1.docx", "One_Two_Three_Four_Five_Six_Seven_Eight.docx"),
        # the last filler alone is enough
        ("draft_2_One_Two_Three_Four_Five_Six_Seven_final_v2.docx", "draft_2_One_Two_Three_Four_Five_Six_Seven.docx"),
        # fillers, then the date, then the third word as long as more than three are left
        (DATED, "R01_Smith_Atlas_Project_Specific_Aims.docx"),
        ("Alpha_Beta_Gamma_Delta_Epsilon_Zeta_Theta_Kappa_Lambda.docx", "Alpha_Beta_Gamma_Delta_Theta_Kappa_Lambda.docx"),
        (None, None),
    ],
)
def test_short_name(spark, name, want):
    got = short(spark, [name])[0]
    assert got == want
    assert got is None or len(got) <= naming.LONGEST


def test_what_stays_too_long_gets_a_digest(spark):
    name = "x" * 60 + ".docx"
    digest = hashlib.sha1(name.encode()).hexdigest()[:6]
    assert short(spark, [name]) == [f"{digest}_{'x' * 38}.docx"]
    # an extension that leaves no room
    name = "a." + "y" * 60
    assert short(spark, [name]) == [hashlib.sha1(name.encode()).hexdigest()[:6] + "." + "y" * 60]


def test_names_of_a_folder_differ(spark):
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()[:6]
    assert short(spark, ["a b.txt", "a_b.txt", "a b.txt", "a b.txt"]) == ["a_b.txt", f"{sha('a_b.txt')}_a_b.txt", f"{sha('a b.txt')}_a_b.txt", f"{sha('a b.txt+')}_a_b.txt"]


def test_date_and_fillers_go_when_asked(spark):
    assert short(spark, ["2026_10_26_R01_Lee_Aims_draft_3.docx", "2026_Oct_Aims_v2.docx", "2026_Oct.docx"], drop_date=True) == ["R01_Lee_Aims.docx", "Aims.docx", "2026_Oct.docx"]


def test_no_names(spark):
    assert short(spark, []) == []


def test_first_open_source_wins(spark):
    works = spark.createDataFrame([(0, "10.1/A", None, " 2101.00001 "), (1, "https://doi.org/10.1/a", "5", None), (2, "10.1/b", None, ""), (3, "10.1/c", None, None), (4, "10.1/d", "7", None), (5, None, "7", None), (6, None, None, None), (7, "10.1/e", "9", None)], "work int, doi string, pmid string, arxiv string")
    table = lambda *rows: spark.createDataFrame(list(rows), "doi string, payload string")
    locations = table(("10.1/a", '{"best_oa_location":{"url":"L"},"oa_locations":[{"url_for_pdf":"U"}]}'), ("10.1/b", "{"))
    registry = table(("10.1/B", '{"message":{},"link":[{"URL":"http://arxiv.org/abs/2002.00001"}]}'), ("10.1/c", "no"))
    graph = table(("10.1/c", '{"openAccessPdf":{"url":"S"}}'), ("10.1/d", '{"openAccessPdf":{"url":""}}'))
    ids = spark.createDataFrame([("pmc8", "7", ""), ("PMC3", "", "10.1/E"), ("PMC4", "9", "")], "pmcid string, pmid string, doi string")
    got = {r.work: (r.source, r.url) for r in access.open_files(works, locations, registry, graph, ids).collect()}
    pmc = "https://pmc.ncbi.nlm.nih.gov/articles/{}/pdf/"
    assert got == {
        0: ("arxiv", "https://arxiv.org/pdf/2101.00001.pdf"), 1: ("locations", "U"), 2: ("registry", "https://arxiv.org/pdf/2002.00001.pdf"), 3: ("graph", "S"),
        4: ("archive", pmc.format("PMC8")), 5: ("archive", pmc.format("PMC8")), 6: (None, None), 7: ("archive", pmc.format("PMC3")),
    }
