"""A plan applied to documents: each refusal and each outcome of a marker, by named cases."""

import re
import time

import pytest
from pyspark.sql import functions as F

from refloom.lineage import cut
from refloom.operators import unification as u
from refloom.plans import catalogue, unify
from refloom.plans.relations import relation

@pytest.mark.parametrize(
    ("raw", "want"),
    [("PMID: 12", ("pmid", "12")), (" 123456789 ", ("pmid", "123456789")), ("1234567890", None), ("ABCD1234", ("key", "ABCD1234")), ("doi: 10.1234/X.", ("doi", "10.1234/x")), ("https://doi.org/10.1234/a(1)", ("doi", "10.1234/a(1)")), ("see 10.1234/x", None), ("", None), (None, None)],
)
def test_identifiers(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "x string").select(u.given_identifier(F.col("x"))).first()[0]
    assert (tuple(got) if got else None) == want


REFUSED = {
    "no number": ([("77", 0, "1")], [], "unknown marker"), "no text": ([("[5]", 0, "1")], [], "unknown marker"), "twice": ([("4", 0, "1"), ("04", 0, "1")], [], "given twice"), "too many": ([("4", 0, "1"), ("4", 1, "2")], [], "wrong number of identifiers"),
    "odd": ([("4", 0, "x y")], [], "malformed identifier"), "absent": ([("4", 0, "ZZZZZZZZ")], [], "no such item"), "both": ([("0", 0, "1")], [1], "decided twice"),
}
GATES = {"unread": ((False, True, "yes"), "library not readable"), "not added": ((True, False, "yes"), "missing from the library"), "locked": ((True, True, "no"), "no write access"), "unsure": ((True, True, "unknown"), "write access not verified")}
#: document -> named identifiers, references accepted by name, gates
CASES = {"plain": ([], [], (True, True, "yes")), "accepted": ([], [2, 3], (True, True, "yes")), "named": ([("[1,2]", 0, "KKKKKKKK"), ("[1,2]", 1, "10.1234/N"), ("4", 0, "99")], [], (True, True, "yes")), "number wins": ([("[1]", 0, "1"), ("0", 0, "2")], [], (True, True, "yes"))}
CASES |= {k: (g, a, (True, True, "yes")) for k, (g, a, _) in REFUSED.items()} | {k: ([], [], g) for k, (g, _) in GATES.items()}


def relations(spark, cases):
    """The same draft under each case's name, with its decisions and gates."""
    text = "See [1] and [1,2] and [2] then (Lee, 2001) and [9]"
    at = text.index
    make = lambda rows, schema: spark.createDataFrame([(d, *r) for d in cases for r in rows], f"doc string, {schema}")
    markers = make([(0, "numeric", "[1]", 0, at("[1]"), 1, False), (1, "numeric", "[1,2]", 0, at("[1,2]"), 2, False), (2, "numeric", "[2]", 0, at("[2]") + 1, 1, False), (3, "author-year", "(Lee, 2001)", 0, 0, 1, False), (4, "numeric", "[9]", 0, at("[9]"), 1, False), (5, "numeric", "[1]", 0, at("[1]"), 1, True), (6, "numeric", "[1]", 0, at("[1]"), 1, False)], "marker int, kind string, text string, para int, start int, items int, live boolean")
    links = make([(0, 0, 1), (1, 0, 1), (1, 1, 2), (2, 0, 1), (3, 0, 1), (5, 0, 1), (6, 0, 1)], "marker int, item int, ref int")
    references = make([(1, 1, "One", "10.1234/a", "", True, False, True, None), (2, 2, "Two", "", "", False, False, True, "OLDKEY01"), (3, 3, "Gone", "10.1234/g", "", True, True, True, None)], "ref int, number int, title string, doi string, pmid string, auto boolean, retracted boolean, has_data boolean, key string")
    held = make([(1, "bracket", "[CITE]", 1, True, "Held", "10.1234/K", ""), (2, "comment", "[CITE]", 1, True, "Held", "10.1234/k", ""), (3, "bracket", "[?]", 1, False, "x", "", "")], "ph int, kind string, text string, places int, chosen boolean, title string, doi string, pmid string")
    given = spark.createDataFrame([(d, *g) for d, (gs, _, _) in cases.items() for g in gs], "doc string, name string, item int, identifier string")
    accepted = spark.createDataFrame([(d, r) for d, (_, rs, _) in cases.items() for r in rs], "doc string, ref int")
    gates = spark.createDataFrame([(d, *g) for d, (_, _, g) in cases.items()], "doc string, readable boolean, add_missing boolean, writable string")
    index = spark.createDataFrame([("doi", "10.1234/k", "KKKKKKKK")], "kind string, value string, key string")
    known = spark.createDataFrame([("doi", "10.1234/n", "New", None, "7")], "kind string, value string, title string, doi string, pmid string")
    answers = spark.createDataFrame([("doi:10.1234/a", "NEWKEY01"), ("doi:10.1234/n", "NEWKEY02")], "identity string, key string")
    return markers, links, references, held, make([(0, text)], "para int, text string"), given, accepted, gates, index, known, answers


def outcomes(spark, cases):
    markers, links, references, held, paragraphs, given, accepted, gates, index, known, answers = relations(spark, cases)
    assigned = cut(u.parse_assigned(u.assign(markers, given)))
    found = cut(u.problems(markers, assigned, accepted, links, index, gates))
    works = cut(u.with_answers(cut(u.settle(references, accepted, held, assigned, found, index, known, gates)), answers))
    placed = cut(u.place_markers(markers, links, works, paragraphs))
    return found.collect(), works.collect(), placed.collect(), u.summary(works, placed, u.place_placeholders(held, works), found).collect()


@pytest.fixture(scope="module")
def applied(spark):
    found, works, placed, totals = outcomes(spark, CASES)
    return {d: ([r.problem for r in found if r.doc == d], {(r.source, r.id): (r.outcome, r.reason, r.key) for r in works if r.doc == d}, {r.marker: (r.outcome, r.reason, r["keys"]) for r in placed if r.doc == d}, next(r for r in totals if r.doc == d)) for d in CASES}


def test_plan_is_applied(applied):
    problems, works, marks, total = applied["plain"]
    assert not problems and works["reference", 1] == ("added", None, "NEWKEY01") and works["reference", 3][0] == "retracted" and ("reference", 2) not in works
    assert works["placeholder", 1] == ("matched", None, "KKKKKKKK") and works["placeholder", 3][1] == "no resolution supplied"
    assert marks[0] == ("replaced", None, ["NEWKEY01"]) and marks[1] == ("unresolved", "not all works accepted with a key", None)
    assert marks[2][1] == "not at its place" and marks[3][0] == "replaced" and 4 not in marks and marks[5][0] == "live"
    assert marks[6] == ("unresolved", "overlaps an earlier marker", None)
    assert (total.status, total.replaced, total.unresolved, total.added, total.retracted) == ("partial", 3, 4, 1, 1)


def test_accepting_by_name_takes_retracted_and_unsure_ones(applied):
    _, works, marks, _ = applied["accepted"]
    assert works["reference", 3] == ("needs_input", "create failed", None) and marks[1] == ("replaced", None, ["NEWKEY01", "OLDKEY01"])


def test_named_identifiers_own_their_marker(applied):
    problems, works, marks, _ = applied["named"]
    assert not problems and marks[1] == ("replaced", None, ["KKKKKKKK", "NEWKEY02"])
    assert marks[4] == ("unresolved", "an identifier has no item", None) and works["marker", 4][1] == "identifier not resolved"
    assert not applied["number wins"][0]


@pytest.mark.parametrize("case", REFUSED)
def test_any_bad_decision_refuses_the_whole_document(applied, case):
    problems, works, marks, total = applied[case]
    assert problems == [REFUSED[case][2]]
    assert {o for o, _, _ in works.values()} <= {"refused"} and {o for o, _, _ in marks.values()} <= {"refused"} and (total.status, total.replaced, total.added) == ("refused", 0, 0)


@pytest.mark.parametrize("case", GATES)
def test_gates_leave_markers_as_text(applied, case):
    _, works, marks, _ = applied[case]
    assert works["reference", 1] == ("needs_input", GATES[case][1], None) and marks[0][0] == "unresolved"


def test_nothing_to_do(spark):
    assert outcomes(spark, {}) == ([], [], [], [])


def test_one_field_for_all_items_of_a_request(spark):
    requests = [(1, "here", ["KKKKKKKK", "doi:10.1234/K"]), (2, "here", ["10.1234/none"]), (3, "here", ["odd one"]), (4, "gone", ["KKKKKKKK"]), (5, "twice", ["KKKKKKKK"]), (6, "here", [])]
    asked = spark.createDataFrame([("d", *r) for r in requests], "doc string, request int, anchor string, identifiers array<string>")
    found = spark.createDataFrame([("d", "here", 1, 4), ("d", "twice", 2, None)], "doc string, anchor string, n long, para int")
    index = spark.createDataFrame([("doi", "10.1234/k", "KKKKKKKK")], "kind string, value string, key string")
    got = {r.request: r for r in u.cite_into(asked, index, found, spark.createDataFrame([("d", 4, "put it here, please")], "doc string, para int, text string"), F.lit("http://x/")).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "inserted", 2: "no such item", 3: "malformed", 4: "not found", 5: "not unique", 6: "malformed"}
    assert (got[1].before, got[1].after, got[1]["keys"]) == ("put it here", ", please", ["KKKKKKKK", "KKKKKKKK"]) and got[1].code.startswith("ADDIN ZOTERO_ITEM") and got[2].code is None


SF = "/root/testdata/sf0.001"


def shuffles(df):
    """Keys of the shuffles that the plan has before it runs."""
    return re.findall(r"(?m)^[ :+*()\d-]*Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_markers_are_shuffled_once_to_be_drawn_and_once_to_be_placed(spark):
    assert len(shuffles(catalogue.queries()["unify_placed"](spark, SF))) <= 2
    refs = cut(relation(spark, SF, "unify_refs"))
    drawn = unify._markers(spark, SF, refs)
    assert drawn.select("doc", "marker", "text", "start", "items", "live").exceptAll(relation(spark, SF, "unify_markers").select("doc", "marker", "text", "start", "items", "live")).isEmpty()
    assert drawn.count() == relation(spark, SF, "unify_markers").count() and len(shuffles(spark.sql(unify._BY_DOC, lineitem=spark.read.parquet(f"{SF}/lineitem.parquet")))) == 1


def test_first_of_two_references_of_a_number_is_placed(spark):
    markers = spark.createDataFrame([("d", 0, "numeric", "[1]", 0, 0, 1, False)], "doc string, marker int, kind string, text string, para int, start int, items int, live boolean")
    links = spark.createDataFrame([("d", 0, 0, 2), ("d", 0, 0, 1)], "doc string, marker int, item int, ref int")
    works = spark.createDataFrame([("d", "reference", 1, None, k, "matched") for k in ("KEY1", "KEY0")] + [("d", "reference", 2, None, "KEY2", "matched")], "doc string, source string, id long, item int, key string, outcome string")
    got = u.place_markers(markers, links, works, spark.createDataFrame([("d", 0, "[1]")], "doc string, para int, text string")).collect()
    assert [(r.marker, r.outcome, r["keys"]) for r in got] == [(0, "replaced", ["KEY0"])]


def test_a_cut_that_releases_leaves_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    kept = cut(spark.range(1000).repartition(3, "id"), release=True)
    own = files() - before
    # the events of a query may still hold it when it ends, so its files go with those of the next at the latest
    cut(spark.range(1), release=True)
    until = time.time() + 10
    while own & files() and time.time() < until:
        time.sleep(0.2)
    assert not own & files() and kept.count() == 1000


def test_problems_draw_the_markers_of_decided_documents_only(spark):
    refs, _, docs = unify._drawn(spark, SF)
    some = docs.where("doc % 2 = 0")
    drawn = unify._markers(spark, SF, refs, some)
    whole = relation(spark, SF, "unify_markers").join(some, "doc", "left_semi").select("doc", "marker", "text", "start", "items", "live")
    assert drawn.count() == whole.count() > 0 and drawn.select(whole.columns).exceptAll(whole).isEmpty()
