"""The pipeline over a small folder, each stage against what its operator says of its own input."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from refloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from refloom.llm.base import table

    docs, out = table(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, docs, SF).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_filter_and_keep_columns(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
        assert 0 < after.count() <= before.count(), name
        assert after.join(before, before.columns, "left_anti").count() == 0, name


def test_last_stage_holds_every_document(stages):
    _, before, after = stages[-1]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert after.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def shingles(text, pattern, lower, k=5):
    w = re.findall(pattern, lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_duplicates_leave_one_of_each(stages):
    """Against all pairs of whole sets: of each group linked at 0.8 the smallest id stays."""
    _, before, after = next(s for s in stages if s[0] == "near_duplicates")
    ascii_lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    sets = {r.doc_id: shingles(r.text, r"[^\x20\x09-\x0D]+", ascii_lower) for r in before.collect()}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert {r.doc_id for r in after.collect()} == {i for i in ids if find(i) == i}


def test_documents_with_items_go(spark, stages):
    """Against every item's set and every document's."""
    _, before, after = next(s for s in stages if s[0] == "decontamination")
    sets = lambda text: shingles(text, r"[^\W_]+", str.lower)
    items = {r.item_id: sets(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {r.doc_id for r in before.collect() if not any(len(s & sets(r.text)) >= 0.8 * len(s) for s in items.values() if s)}
    assert {r.doc_id for r in after.collect()} == want


def test_classifiers_decide(spark, stages):
    """Quality and language keep what their operators, applied to the stage's input, accept."""
    from refloom.llm import langid, quality
    from refloom.llm.base import table

    _, before, after = stages[0]
    scored = quality.score_quality(before, quality.fit_quality(before, table(spark, SF, "labels")))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored.where("predicted = 1").collect()}
    _, before, after = stages[1]
    found = langid.identify_languages(before, langid.fit_languages(before))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in found.where("lang_pred <> 'und' and score >= 0.3").collect()}


def test_stages_take_odd_tables(spark, stages):
    """Nulls in any column, no rows, repeated rows and extra columns with names of the operators' own."""
    _, docs, _ = stages[0]
    odd = docs.limit(60)
    nulls = spark.createDataFrame([(None,) * len(odd.columns)] * 2, odd.schema)
    odd = odd.unionByName(nulls).unionByName(odd.limit(3))
    for name in ("quality", "language", "found", "component_id", "kept", "w", "n"):
        odd = odd.withColumn(name, F.lit("x"))
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, SF)
            if name == "packing":
                assert got.select("doc_id").distinct().count() == table.select("doc_id").distinct().count()
            else:
                assert got.columns == table.columns and got.count() <= table.count(), name


def test_run_gives_what_the_stages_give(spark, stages):
    got = {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {tuple(r) for r in stages[-1][2].collect()}


def test_all_queries_are_registered():
    names = queries.queries()
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
