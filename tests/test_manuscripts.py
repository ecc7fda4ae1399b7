"""Named cases of line shapes, payloads and workflow operators."""

import json

import pytest
from pyspark.sql import functions as F

from refloom.functions import payloads, people, shapes
from refloom.operators import items, workflows


@pytest.fixture
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()[0]


ARTICLE = """<PubmedArticle><MedlineCitation><PMID Version="1">77</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1998 Dec-1999 Jan</MedlineDate></PubDate></JournalIssue><ISOAbbreviation>J X</ISOAbbreviation></Journal>
<ArticleTitle>On things</ArticleTitle><Abstract><AbstractText Label="AIM">To see.</AbstractText><AbstractText>Seen.</AbstractText></Abstract>
<AuthorList><Author><LastName>Lee</LastName><ForeName>Ann</ForeName><Initials>A</Initials></Author><Author><CollectiveName>Data Group</CollectiveName></Author></AuthorList><ELocationID EIdType="doi">10.1/e</ELocationID></Article></MedlineCitation></PubmedArticle>"""


def test_article(one):
    a = one(payloads.article_fields(F.lit(ARTICLE)))
    assert (a.pmid, a.title, a.abstract, a.journal, a.year, a.authors, a.doi) == ("77", "On things", "AIM: To see. Seen.", "J X", "1998", ["Lee A", "Data Group"], "10.1/e")


def test_surname_in_text(one):
    at = lambda t, f, g: one(shapes.surname_in_text(F.lit(t), F.lit(f), F.lit(g)))
    assert at("Smith AB, Lee C. 2019", "Smith", "") and not at("Smithson AB", "Smith", "Ann")
    assert at("Ng, M.T.S. Title", "Ng", "Mei Tan Sue") and not at("Ng Title", "Ng", "Mei") and not at("Ng Title", "Ng", "")
    assert at("a (b) c", "(b", "") is False and not at("x", "", "A")


def test_bibliographic_query(one):
    q = lambda t: one(shapes.bibliographic_query(F.lit(t)))
    assert q("Smith J.A., Lee H-T. et al. Title") == "Smith J A., Lee H T. Title"
    assert q("Smith AB. Title. 2019") == "Smith AB. Title. 2019"


@pytest.mark.parametrize(("old", "new", "want"), [("abc", "abc", None), ("aab", "aaab", ("", "a")), ("", "x", ("", "x")), ("x", "", ("x", "")), ("the cat sat", "the dog sat", ("cat", "dog"))])
def test_changed_span(one, old, new, want):
    found = one(shapes.changed_span(F.lit(old), F.lit(new)))
    assert (found and tuple(found)) == want


def test_rough_title_and_tokens(one):
    assert one(shapes.rough_title(F.lit("1. Smith A. A title of some length 10. J 10. 2019"))) == "A title of some length 10"
    assert one(shapes.word_tokens(F.lit("  a b\n c"))) == ["  a ", "b\n ", "c"] and one(shapes.word_tokens(F.lit("  "))) == ["  "] and one(shapes.word_tokens(F.lit(""))) == []


def test_malformed_payloads(one):
    for schema, field in ((payloads.WORK, payloads.published_doi), (payloads.OPEN_ACCESS, payloads.open_pdf), (payloads.WORK, payloads.arxiv_pdf), (payloads.PROFILE, payloads.profile_works)):
        for raw in ("", "[", "{}", None):
            assert not one(field(payloads.parsed(F.lit(raw).cast("string"), schema)))


def test_overlaps_and_cycles(spark):
    spans = spark.createDataFrame([(1, 1, 0, 5), (1, 0, 3, 6), (1, 1, 6, 8), (2, 0, 0, 1)], "doc int, pass int, start int, stop int")
    assert sorted(map(tuple, workflows.drop_overlaps(spans).collect())) == [(1, 0, 3, 6), (1, 1, 6, 8), (2, 0, 0, 1)]
    styles = spark.createDataFrame([(1, "a", "b", None), (1, "b", "a", None), (1, "c", "d", None), (1, "d", None, "sup"), (1, "e", "gone", None)], "doc int, style string, based_on string, value string")
    assert dict(r[1:] for r in workflows.inherited(styles).collect()) == {"a": None, "b": None, "c": "sup", "d": "sup", "e": None}


def test_people(one):
    p = lambda f, g: tuple(one(people.normalise_person(F.lit(f), F.lit(g))))
    assert p("VAN DER BERG-SMITH", "JOHN A.") == ("van der Berg-Smith", "John A.") and p("O'BRIEN", "JA") == ("O'Brien", "JA") and p("MCDONALD", "ANNA-MARIA") == ("McDonald", "Anna-Maria")
    assert p("DeLisi", "Ann") == ("DeLisi", "Ann") and p("ENIGMA", "") == ("ENIGMA", "") and p("DE", "JRR") == ("De", "JRR")
    s = lambda t: (lambda r: r and tuple(r))(one(people.split_author(F.lit(t))))
    assert s("Smith, Ann") == ("Smith", "Ann") and s("van Dyk AB") == ("van Dyk", "AB") and s("Nice AB") == ("Nice", "AB") and s("EXAMPLE CONSORTIUM ABC") == ("EXAMPLE CONSORTIUM ABC", "") and s(" ") is None
    assert one(people.clean_markup(F.lit("A <i>b</i>&amp;amp; c<br/>d &lt;sub&gt;2&lt;/sub&gt; a < b"))) == "A b& c d 2 a < b"


def test_items(spark, one):
    works = spark.createDataFrame([(1, "posted-content", "T", "2020", "bioRxiv", "1", "2", "3", "10.1/x"), (2, "dataset", "U", None, "J", "1", "2", "", "")], "pos int, type string, title string, year string, journal string, volume string, issue string, pages string, doi string")
    got = {r.pos: (r.item_type, json.loads(r.item)) for r in items.to_items(works).collect()}
    assert got[1] == ("preprint", {"itemType": "preprint", "title": "T", "date": "2020", "DOI": "10.1/x", "repository": "bioRxiv"})
    assert got[2] == ("journalArticle", {"itemType": "journalArticle", "title": "U", "date": "", "DOI": "", "publicationTitle": "J", "volume": "1", "issue": "2", "pages": ""})
    c = F.expr("array(named_struct('creatorType', 'author', 'lastName', 'Lee', 'firstName', 'ann b', 'name', null), named_struct('creatorType', 'editor', 'lastName', 'X', 'firstName', '', 'name', null), named_struct('creatorType', null, 'lastName', '', 'firstName', '', 'name', 'Data Group'))")
    assert one(items.creators_to_authors(c)) == ["Lee AB", "Data Group"]
    assert one(items.prefs_chunks(F.lit("abcde"), 2)) == ["ab", "cd", "e"] and one(items.prefs_chunks(F.lit(""), 2)) == []


def test_comments_and_styles(spark):
    new = spark.createDataFrame([(1, 5), (1, 3), (2, 1)], "doc int, place int")
    have = spark.createDataFrame([(1, 4), (1, 2)], "doc int, id int")
    assert sorted((r.doc, r.place, r.id) for r in items.number_comments(new, have).collect()) == [(1, 3, 5), (1, 5, 6), (2, 1, 0)]
    assert [tuple(r) for r in items.orphan_comments(have, spark.createDataFrame([(1, 4), (2, 2)], "doc int, id int")).collect()] == [(1, 2)]
    styles = spark.createDataFrame([("b", "brain"), ("a", "brain"), ("n", "nature"), ("n", "nat")], "style string, key string")
    got = items.nearest_styles(spark.createDataFrame([(1, "brains"), (2, None)], "name int, key string"), styles, 2).collect()
    assert [(r.name, r.style, r.rank) for r in sorted(got, key=lambda r: (r.name, r.rank))] == [(1, "a", 1), (1, "b", 2), (2, "a", 1), (2, "b", 2)]


@pytest.mark.parametrize(("old", "new", "ops"), [("a b c", "a b c", ["equal"]), ("", "x", ["insert"]), ("x y", "", ["delete"]), ("one two three and something long here", "one 2 three and something long there", ["equal", "replace", "equal", "replace"]), ("p q r", "s q t", ["replace"])])
def test_redline(one, old, new, ops):
    got = one(items.redline(F.lit(old), F.lit(new)))
    assert [r.op for r in got] == ops and "".join(r.old for r in got) == old and "".join(r.new for r in got) == new


@pytest.mark.parametrize(
    ("text", "want"),
    [("Figures 1 and 2 and Table 1", [1, 2]), ("Figs 1-3, 7", [1, 2, 3, 7]), ("Figure 1 and 23 patients", [1]), ("Fig. 1, 100 cells", [1]), ("figures 3 through 5 or 9", [3, 4, 5, 9]), ("Fig. S1", []), ("Figure 1-5000000", [1, 5000000]), ("Fig 5–3 and, later, Figure 8", [3, 4, 5, 8]), ("Figure 99999999999", []), ("", [])],
)
def test_figure_numbers(one, text, want):
    assert one(shapes.figure_numbers(F.lit(text))) == want


def test_kept_words_between_edits(one):
    """A stretch of exactly the least length without its trailing space joins the edits, one more letter keeps it."""
    ops = lambda old, new: [r.op for r in one(items.redline(F.lit(old), F.lit(new)))]
    assert ops("a abcdefg b", "c abcdefg d") == ["replace"] and ops("a abcdefgh b", "c abcdefgh d") == ["replace", "equal", "replace"]
    assert ops("x a b", "x c b") == ["equal", "replace", "equal"]


def test_redlines_against_brute_force(spark):
    """Joined pieces give both texts, kept pieces between edits are long, and no two edits stand side by side."""
    import random

    rng = random.Random(3)
    pairs = []
    for _ in range(200):
        old = " ".join(rng.choice(["a", "river", "mountains", "of", "stone"]) for _ in range(rng.randint(0, 14)))
        pairs.append((old, " ".join(w if rng.random() < 0.7 else rng.choice(["b", "lake", "valleys"]) for w in old.split()) or "new"))
    for old, new, got in spark.createDataFrame(pairs, "old string, new string").select("old", "new", items.redline(F.col("old"), F.col("new"))).collect():
        assert "".join(r.old for r in got) == old and "".join(r.new for r in got) == new
        assert all(len(r.old.strip()) >= 8 for k, r in enumerate(got) if r.op == "equal" and 0 < k < len(got) - 1)
        assert all("equal" in (a.op, b.op) for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize(
    ("url", "public"),
    [("http://[::1]/", False), ("http://2130706433/", False), ("http://localhost./", False), ("http://0177.0.0.1/", False), ("http://0x7f.1/", False), ("https://[2606:4700::1]:443/x", True), ("http://[fe80::1]/", False), ("http://[::ffff:10.0.0.1]/", False), ("https://example.org", True), ("https://example.org.", True), ("http://router/", False), ("http://8.8.8.8:80/a", True), ("http://192.0.2.1/", False), ("http://256.1.1.1/", False), ("ftp://example.org/", False), ("", False)],
)
def test_public_addresses(one, url, public):
    assert one(payloads.is_public_address(F.lit(url))) is public


def test_nearest_styles_take_any_catalogue(spark):
    styles = spark.createDataFrame([(f"s{i}", f"style number {i}") for i in range(50)], "style string, key string")
    names = spark.createDataFrame([(1, "style number 7"), (2, "style number 41")], "name int, key string")
    got = {(r.name, r["rank"]): r.style for r in items.nearest_styles(names, styles, 2, chunk=10).collect()}
    whole = {(r.name, r["rank"]): r.style for r in items.nearest_styles(names, styles, 2).collect()}
    assert got == whole and got[1, 1] == "s7" and got[2, 1] == "s41"


def test_group_merging(spark):
    from refloom.operators import verification as v

    df = spark.createDataFrame([("*First Group;A,x;*The Mid Group;B,y;*Last Group", "A,x;MID GROUP,;B,y;C,z")], "m string, t string").select(v.parse_authors(F.col("m")).alias("m"), v.parse_authors(F.col("t")).alias("t"))
    got = df.select(v.merge_groups(F.col("m"), v.align_groups(F.col("m"), F.col("t"))).alias("x")).first().x
    assert [a.family or a.literal for a in got.authors] == ["First Group", "A", "The Mid Group", "B", "Last Group", "C"] and got.kept == ["First Group", "Last Group"]


def test_positions_bind_only_without_keys(spark):
    from refloom.operators import library

    asked = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b")], "request int, pos int, key string")
    rows = spark.createDataFrame([(1, 0, "b", "B"), (1, 1, None, "?"), (2, 0, None, "x"), (2, 1, None, "y")], "request int, place int, key string, value string")
    assert {(r.request, r.key): r.value for r in library.bind_positions(asked, rows).collect()} == {(1, "a"): None, (1, "b"): "B", (2, "a"): "x", (2, "b"): "y"}


def test_marks_of_one_author_are_spread(spark):
    rows = [(1, 1, "ins", "a", 0, 3), (1, 2, "del", "a", 0, 4), (1, 3, "comment", "a", 0, 9), (1, 4, "comment", "a", None, None), (1, 5, "ins", "b", 0, 5), (2, 6, "ins", "a", 7, 1)]
    marks = spark.createDataFrame([(*r, None) for r in rows], "doc int, mark int, kind string, author string, para int, pos int, at timestamp")
    got = {r.mark: r.at and r.at.strftime("%H:%M:%S") for r in workflows.spread_marks(marks, "a", "2024-01-01 08:00:00", "2024-01-01 10:00:00").collect()}
    # the comment, then the paragraph's edit, then the comment without a place; a lone edit falls on the end
    assert got[3] == "08:00:00" and got[1] == got[2] and "08:00:00" < got[1] < "10:00:00" and got[4] == "10:00:00" and got[5] is None and got[6] == "10:00:00"
    with pytest.raises(ValueError, match="begins"):
        workflows.spread_marks(marks, "a", "2024-01-01 10:00:01", "2024-01-01 10:00:00")
