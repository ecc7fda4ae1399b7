"""Plans: what their modules hold, and results on inputs with many rows of one key."""

import ast
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from refloom.lineage import cut
from refloom.operators import library, migration, revisions, verification
from refloom.plans import works

PLANS = sorted((Path(__file__).resolve().parents[1] / "refloom" / "plans").glob("*.py"))


@pytest.mark.parametrize("path", PLANS, ids=lambda p: p.stem)
def test_a_module_binds_each_name_once(path):
    """A query reads the module's names when it runs, so one that is bound again further down changes it."""
    bound = Counter(t.id for node in ast.parse(path.read_text()).body if isinstance(node, ast.Assign) for t in node.targets if isinstance(t, ast.Name))
    bound.update(node.name for node in ast.parse(path.read_text()).body if isinstance(node, ast.FunctionDef))
    assert [name for name, n in bound.items() if n > 1] == []


def test_a_cut_result_is_read_by_the_columns_that_are_used(spark):
    """A later step that uses one column reads one, and an empty result keeps its types."""
    df = cut(spark.range(100).selectExpr("id", "repeat('x', 100) AS long", "named_struct('a', id, 'b', array(1, 2)) AS s"))
    assert df.columns == ["id", "long", "s"]
    assert df.inputFiles() and df.agg({"id": "sum"}).first()[0] == 4950
    empty = cut(df.where("id < 0"))
    assert empty.count() == 0 and empty.columns == df.columns


def test_foreign_works_of_one_title(spark):
    """Each cited work finds the first item of its title whose year and authors don't contradict, as comparing all pairs does."""
    years, families = ["", "2001", "in 2002", None], [[], ["Ng"], ["Lee", "ng"], ["Po", "Ng", "Lee"]]
    items = [(i, f"K{i:03}", "One title" if i % 3 else "Other: title", None, None, "", years[i * 7 % 4], families[i * 5 % 7 % 4]) for i in range(40, 0, -1)]
    lib = spark.createDataFrame(items, "pos long, key string, title string, doi string, pmid string, extra string, date string, families array<string>")
    cited = [(i, None, None, title, year, author) for i, (title, year, author) in enumerate((t, y, a) for t in ("One title!", "Other title!", "None", "") for y in ("2001", "2002", "1999", "", None) for a in ("NG", " Lee", "Po", "X", "", None))]
    got = verification.match_foreign(spark.createDataFrame(cited, "cite long, doi string, pmid string, title string, year string, author string"), library.build_indexes(lib), lib)

    def fits(item, year, author):
        own = re.sub(r"^in ", "", item[6] or "")
        return (not (year or "").strip() or not own or own == year) and (not (author or "").strip() or not item[7] or author.strip().lower() in [f.lower() for f in item[7]])

    key = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    want = {i: min(((x[0], x[1]) for x in items if key(x[2]) == key(t) and fits(x, y, a)), default=(0, None))[1] for i, _, _, t, y, a in cited}
    assert {r.cite: r.library_key for r in got.collect()} == want


def test_foreign_works_do_not_meet_in_all_pairs_of_a_title(spark, capsys):
    none = spark.createDataFrame([], "cite long, doi string, pmid string, title string, year string, author string, pos long, key string, extra string, date string, families array<string>")
    verification.match_foreign(none, library.build_indexes(none), none).explain()
    assert re.search(r"Join.*_title#\d+, _by_year#\d+, _by_author#\d+\]", capsys.readouterr().out)


def test_the_index_that_records_meet_is_built_once(spark, monkeypatch):
    """Three joins by DOI, PMID and title read an index that was written before."""
    written = []
    monkeypatch.setattr(works, "cut", lambda df: written.append(df) or cut(df))
    assert works._decided(spark, "/root/testdata/sf0.001").count() == 200
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in written]
    assert [p.count("Generate explode") for p in plans] == [1, 0]


def test_citations_are_looked_up_once(spark):
    """A field's status takes no second lookup of all citations, and citations outside a document or field stay."""
    records = spark.createDataFrame([(1, 5, "K5", "created", ("10.1/a", "A b")), (1, 4, "K4", "matched", ("10.1/A.", "Other")), (1, 6, None, "failed", ("", "Last"))], "source long, rec long, key string, outcome string, record struct<doi:string,title:string>")
    rows = [(1, 1, 0, 1, "10.1/a", ""), (1, 1, 0, 2, "", "a B!"), (1, 1, 1, 1, "10.1/z", "other"), (1, 1, 1, 2, "", "last"), (1, None, None, 1, "", "Other"), (2, 2, 0, 1, "10.1/a", "")]
    out = migration.migrate_citations(spark.createDataFrame(rows, "source long, doc long, field int, item int, doi string, title string"), records)
    got = {(r.source, r.doc, r.field, r.item): (r.rec, r.key, r.outcome, r.status) for r in out.collect()}
    assert got == {
        (1, 1, 0, 1): (4, "K4", "matched", "converted"), (1, 1, 0, 2): (5, "K5", "created", "converted"), (1, 1, 1, 1): (4, "K4", "matched", "left"),
        (1, 1, 1, 2): (6, None, "failed", "left"), (1, None, None, 1): (4, "K4", "matched", "converted"), (2, 2, 0, 1): (None, None, "unmatched", "left"),
    }
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


@pytest.mark.parametrize("degraded", [False, True])
def test_what_candidates_are_known_by_is_worked_out_once(spark, degraded):
    """Outcomes are those of asking for each candidate by each identifier; what is looked up was worked out and written before."""
    items = [(1, "K1", "One", "10.1/a", None, ""), (2, "K2", "Two", None, "7", ""), (3, "K3", "Trois  été", "10.1/c", "9", ""), (4, "K4", "one", "10.1/A.", None, "")]
    dois, pmids, titles = ["10.1/A", "https://doi.org/10.1/c).", "10.1/x", "", None], ["7", " 9 ", "  ", "8", None], ["ONE", "trois ete", "Café", "cafe", " ", None]
    rows = [(i * 7 % 151, *c) for i, c in enumerate((d, p, t) for d in dois for p in pmids for t in titles)]
    index = library.build_indexes(spark.createDataFrame(items, "pos long, key string, title string, doi string, pmid string, extra string"))
    out = library.gate_creation(spark.createDataFrame(rows, "pos long, doi string, pmid string, title string"), index, degraded)
    assert out.columns == ["identity", "pos", "doi", "pmid", "title", "library_key", "matched_by", "outcome"]
    assert "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()

    doi_of = {"10.1/A": "10.1/a", "https://doi.org/10.1/c).": "10.1/c", "10.1/x": "10.1/x"}
    known = {"doi": {"10.1/a": "K4", "10.1/c": "K3"}, "pmid": {"7": "K2", "9": "K3"}, "title": {"one": "K1", "two": "K2", "trois ete": "K3"}}
    title_of = {"ONE": "one", "trois ete": "trois ete", "Café": "cafe", "cafe": "cafe"}
    asked = {pos: {"doi": doi_of.get(d), "pmid": (p or "").strip() or None, "title": title_of.get(t)} for pos, d, p, t in rows}
    named = {pos: f"doi:{doi_of[d]}" if doi_of.get(d) else f"pmid:{p}" if p else f"title:{title_of[t]}" if title_of.get(t) else None for pos, d, p, t in rows}
    first = {}
    for pos, name in named.items():
        first[name] = min(pos, first.get(name, pos))

    def want(pos):
        key, by = next(((known[k][v], k) for k, v in asked[pos].items() if v in known[k]), (None, None))
        name = named[pos]
        return name, key, by, "skipped" if key else "repeated" if name and first[name] < pos else "refused" if degraded and name and not name.startswith("doi:") else "created"

    assert len(asked) == len(rows) and {r.pos: (r.identity, r.library_key, r.matched_by, r.outcome) for r in out.collect()} == {pos: want(pos) for pos in asked}


def test_a_block_of_near_copies_is_sent_compressed():
    from refloom.llm import neardup

    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 400)]
    texts = [" ".join(f"e{i}" if k == i else w for k, w in enumerate(base)) for i in range(256)]
    frame = pd.DataFrame({"cluster": 7, "own": 2, "others": [[0, 1, 2]] * 256, "cid": range(256), "n": 396, "hi": range(256), "lo": 0, "text": texts})
    packed = neardup._pack(frame)
    assert len(packed) == 1 and packed.own[0] == 2 and 20 * len(packed.packed[0]) < sum(map(len, texts))
    from pickle import loads

    import zstandard

    assert sorted(loads(zstandard.decompress(packed.packed[0]))) == [(i, 396, i, 0, t) for i, t in enumerate(texts)]


def test_tokens_are_not_put_together_in_few_tasks(spark):
    """Tasks that hold sorts of many small rows are as many as shuffles have, whatever the rows' compressed size."""
    t = spark.range(4000).selectExpr("id div 20 AS doc", "'p' AS part", "0 AS para", "id AS pos", "'fld' AS kind", "CASE id % 2 WHEN 0 THEN 'begin' ELSE 'end' END AS text", "false AS in_ins", "false AS in_del")
    assert revisions._levels(t).select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
