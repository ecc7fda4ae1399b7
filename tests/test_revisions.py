"""Fields inside fields, repairing and resolving tracked changes, paragraphs put in and struck: named cases over real packages."""

import pytest
from test_sources import write_document

from refloom.operators import documents, edits, revisions
from refloom.sources import docx


def run(text):
    return f"<w:r><w:t>{text}</w:t></w:r>"


def fld(kind):
    return f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'


def code(text, tag="instrText"):
    return f"<w:r><w:{tag}>{text}</w:{tag}></w:r>"


def tokens_of(spark, tmp_path, body):
    write_document(tmp_path / "a.docx", body)
    return docx.read_tokens(spark, str(tmp_path)).cache()


def texts(tokens, accept):
    done = revisions.resolve_all(tokens, accept)
    return [r.text for r in documents.paragraphs(done.drop("status"), "raw").orderBy("para").collect()]


def test_inner_fields_come_before_the_outer_one_and_name_it(spark, tmp_path):
    inner = fld("begin") + code(" PAGEREF x ") + fld("separate") + run("7") + fld("end")
    body = "<w:p>" + fld("end") + fld("begin") + code("ADDIN A") + inner + code(" {more}") + fld("separate") + code("late") + run("r") + fld("end") + fld("begin") + code("open") + inner + "</w:p>"
    got = revisions.nested_fields(tokens_of(spark, tmp_path, body)).orderBy("rank").collect()
    assert [(r.kind, r.instruction, r.level) for r in got] == [("PAGEREF", " PAGEREF x ", 2), ("A", "ADDIN A {more}", 1), ("PAGEREF", " PAGEREF x ", 2)]
    assert got[0].parent == got[1].begin and got[1].parent is None and got[2].parent is not None
    assert got[1].separate is not None and got[1].begin < got[0].begin < got[0].end < got[1].separate < got[1].end


def test_struck_instructions_are_in_the_instruction_only(spark, tmp_path):
    body = "<w:p>" + fld("begin") + code("A ") + "<w:del>" + code("B", "delInstrText") + "</w:del>" + fld("end") + "</w:p>"
    r = revisions.nested_fields(tokens_of(spark, tmp_path, body)).first()
    assert (r.code, r.instruction, r.separate) == ("A ", "A B", None)


def test_fields_of_no_tokens(spark):
    empty = spark.createDataFrame([], docx.TOKENS)
    assert revisions.nested_fields(empty).count() == revisions.fix_tracking(empty).count() == revisions.resolve_all(empty, False).count() == 0


def test_field_is_wrapped_like_its_begin(spark, tmp_path):
    body = "<w:p><w:ins>" + fld("begin") + "</w:ins>" + code("X") + fld("separate") + "<w:del><w:r><w:delText>gone</w:delText></w:r></w:del>" + "<w:moveTo>" + run("in") + "</w:moveTo>" + fld("end") + run("after") + "</w:p>"
    tokens = tokens_of(spark, tmp_path, body)
    assert edits.tracking_issues(tokens).first().fixable is False
    once = revisions.fix_tracking(tokens).orderBy("pos").collect()
    assert [(r.kind, r.in_ins, r.fixed, r.stuck) for r in once if r.kind != "p"] == [
        ("fld", True, False, False), ("instr", True, True, False), ("fld", True, True, False), ("dt", False, False, True), ("t", False, False, False), ("fld", True, True, False), ("t", False, False, False),
    ]
    mended = revisions.fix_tracking(tokens).drop("fixed", "stuck")
    assert revisions.fix_tracking(mended).where("fixed").count() == 0
    assert [(r.loose, r.stuck) for r in revisions.loose_runs(mended).collect()] == [(1, 1)]


def test_inner_field_takes_its_own_marks_first(spark, tmp_path):
    """The inner field is struck, so its runs can't be wrapped as inserted any more."""
    body = "<w:p><w:ins>" + fld("begin") + "</w:ins>" + code("o") + "<w:del>" + fld("begin") + "</w:del>" + code("i") + fld("end") + fld("end") + "</w:p>"
    got = [(r.in_ins, r.in_del, r.stuck) for r in revisions.fix_tracking(tokens_of(spark, tmp_path, body)).orderBy("pos").collect() if r.kind != "p"]
    assert got == [(True, False, False), (True, False, False), (False, True, True), (False, True, True), (False, True, True), (True, False, False)]


def test_comment_marks_outlive_what_is_dropped(spark, tmp_path):
    body = '<w:p><w:del><w:commentRangeStart w:id="4"/><w:r><w:delText>old</w:delText></w:r><w:commentRangeEnd w:id="4"/><w:r><w:delText>x</w:delText><w:commentReference w:id="4"/></w:r></w:del><w:ins>' + run("new") + "</w:ins></w:p>"
    tokens = tokens_of(spark, tmp_path, body)
    for accept, text in ((True, "new"), (False, "oldx")):
        done = revisions.resolve_all(tokens, accept)
        assert [r.kind for r in done.orderBy("pos").collect() if r.kind in revisions.COMMENT_MARKS] == ["cstart", "cend", "cref"]
        assert texts(tokens, accept) == [text]
        assert done.where("in_ins or in_del or kind = 'dt'").count() == 0


def test_rejected_paragraph_marks_join_paragraphs(spark, tmp_path):
    mark = "<w:pPr><w:rPr><w:ins/></w:rPr></w:pPr>"
    body = f"<w:p>{run('a')}</w:p><w:p>{mark}{run('b')}</w:p><w:p>{mark}<w:ins>{run('gone')}</w:ins></w:p><w:p>{run('c')}</w:p><w:p>{mark}{run('last')}</w:p>"
    tokens = tokens_of(spark, tmp_path, body)
    assert texts(tokens, True) == ["a", "b", "gone", "c", "last"]
    assert texts(tokens, False) == ["a", "bc", "last"]


def test_empty_shell_at_the_end_goes(spark, tmp_path):
    mark = "<w:pPr><w:rPr><w:ins/></w:rPr></w:pPr>"
    assert texts(tokens_of(spark, tmp_path, f"<w:p>{run('a')}</w:p><w:p>{mark}<w:ins>{run('x')}</w:ins></w:p>"), False) == ["a"]


def test_property_changes_are_kept_or_reverted(spark, tmp_path):
    body = f'<w:p><w:pPr><w:jc w:val="left"/><w:rPr><w:b/></w:rPr><w:pPrChange><w:pPr><w:jc w:val="right"/></w:pPr></w:pPrChange></w:pPr><w:r><w:rPr><w:b/><w:rPrChange><w:rPr/></w:rPrChange></w:rPr><w:t>x</w:t></w:r></w:p>'
    tokens = tokens_of(spark, tmp_path, body)
    props = lambda accept: [r.text for r in revisions.resolve_all(tokens, accept).where("kind = 'props'").orderBy("pos").collect()]
    assert props(True) == ["jc=left", "b"] and props(False) == ["jc=right", ""]


def test_changes_of_a_table_are_refused(spark, tmp_path):
    body = f"<w:tbl><w:tr><w:tc><w:tcPr><w:cellIns/></w:tcPr><w:p><w:ins>{run('x')}</w:ins></w:p></w:tc></w:tr></w:tbl>"
    tokens = tokens_of(spark, tmp_path, body)
    assert [r.element for r in revisions.refused_documents(tokens).collect()] == ["cellIns"]
    left = revisions.resolve_all(tokens, True)
    assert {r.status for r in left.collect()} == {"refused"} and left.where("in_ins").count() == tokens.where("in_ins").count() > 0


@pytest.fixture(scope="module")
def edited(spark):
    paragraphs = spark.createDataFrame([("d", 0, "zero", None), ("d", 1, "one", "Normal"), ("d", 2, "", None)], "doc string, para int, text string, style string")
    steps = [("d", 1, "insert", 1, [(None, "a"), ("H", "b")]), ("d", 2, "delete", 1, None), ("d", 3, "insert", 1, [(None, "c")]), ("d", 4, "delete", 2, None), ("d", 5, "insert", 9, [(None, "lost")]), ("d", 6, "insert", 0, [])]
    return revisions.edit_paragraphs(paragraphs, spark.createDataFrame(steps, "doc string, seq int, op string, para int, blocks array<struct<style:string,text:string>>"))


def test_inserts_and_deletes_at_one_place(edited):
    got = [(r.place, r.para, r.op, r.text) for r in edited.orderBy("place").collect()]
    assert got == [(0, 0, "keep", "zero"), (1, 1, "delete", "one"), (2, None, "insert", "c"), (3, None, "insert", "a"), (4, None, "insert", "b"), (5, 2, "keep", "")]


def test_edits_accepted_and_rejected(edited):
    view = lambda accept: [r.text for r in revisions.paragraphs_after(edited, accept).orderBy("place").collect()]
    assert view(True) == ["zero", "", "c", "a", "b", ""] and view(False) == ["zero", "one", ""]
