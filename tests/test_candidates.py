"""Candidates are the best of all works that share a token, whatever the tokens' frequencies."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from refloom.operators import items, library, ordered, resolver


@pytest.mark.parametrize(("seed", "seeds"), [(1, 64), (2, 1)])
def test_candidates_are_the_best_of_all(spark, monkeypatch, seed, seeds):
    monkeypatch.setattr(resolver, "SEEDS", seeds)
    rng = np.random.default_rng(seed)
    # a token in nearly all titles, some frequent ones, many rare ones; equal titles; references with unknown tokens
    words = lambda n: sorted({f"t{min(int(rng.zipf(1.6)), 60)}" for _ in range(n)} | ({"every"} if rng.random() < 0.9 else set()))
    titles = [words(int(rng.integers(1, 8))) for _ in range(80)]
    works = [(i, titles[int(rng.integers(80))]) for i in range(200)]
    refs = [(i, words(int(rng.integers(1, 10))) + [f"new{k}" for k in range(int(rng.integers(0, 4)))]) for i in range(60)] + [(100, ["nowhere"]), (101, [])]
    got = resolver.rank_candidates(spark.createDataFrame(refs, "ref int, tokens array<string>"), spark.createDataFrame(works, "work int, tokens array<string>"), 5).collect()
    want = []
    for ref, tokens in refs:
        scores = sorted((-round(len(set(tokens) & set(t)) / len(set(tokens) | set(t)), 6), w) for w, t in works if set(tokens) & set(t))
        want += [(ref, w, -s, k + 1) for k, (s, w) in enumerate(scores[:5])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_candidates_of_nothing(spark):
    none = spark.createDataFrame([], "ref int, tokens array<string>")
    assert resolver.rank_candidates(none, none.withColumnRenamed("ref", "work"), 5).count() == 0


def test_nearest_styles_are_the_best_of_all_pairs(spark):
    from difflib import SequenceMatcher

    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcde -"), n))
    styles = [(f"s{int(rng.integers(40))}", word(int(rng.integers(0, 14)))) for _ in range(90)]
    names = [(i, word(int(rng.integers(0, 14)))) for i in range(40)] + [(98, None), (99, styles[0][1])]
    got = items.nearest_styles(spark.createDataFrame(names, "name int, key string"), spark.createDataFrame(styles, "style string, key string"), 3, chunk=17).collect()
    want = []
    for name, key in names:
        best = {}
        for style, k in styles:
            best[style] = max(best.get(style, 0.0), SequenceMatcher(None, key or "", k).ratio())
        want += [(name, s, round(r, 9), k + 1) for k, (s, r) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3])]
    assert sorted((r[0], r[1], round(r[2], 9), r[3]) for r in got) == sorted(want)


def test_rows_are_numbered_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = ordered.number_rows(rows, "n", F.col("x")).collect()
    assert sorted((r.x, r.n) for r in got) == [(x, x + 1) for x in range(1000)]
    assert ordered.number_rows(rows.limit(0), "n", F.col("x")).count() == 0


def test_titles_shadow_works_without_a_doi(spark):
    schema = "id int, doi string, title string, year string, author string"
    live = spark.createDataFrame([(0, "10.1234/a", "Known Work", "2001", "Lee"), (0, "", "Bare", None, None)], schema)
    works = spark.createDataFrame([(1, "https://doi.org/10.1234/A", "x", "", ""), (2, "", "known  work!", "1999", "Ng"), (3, "10.1234/b", "Known work", "", ""), (4, "", "bare", "2020", "Po"), (5, None, None, None, None), (6, "", "Other", "", "")], schema)
    assert sorted(r.id for r in library.not_yet_cited_works(works, live).collect()) == [3, 5, 6]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("had (1) seizures, (2) falls, and (3) pain.", [0, 1, 2]), ("A (1). And b (2).", []), ("robust (1) and confirmed (2)", []), ("see (5)", []), ("(1) a; (2) b. (3) c", [0, 1]), ("(1) a, (2) B", []), ("(1), (2) x", []),
        ("cf. (1) Big. then (1) small, (2) tiny", [1, 2]), ("(1) a and (2) b or (3) c [4], (5) d", [0, 1, 2]), ("band (1) a band (2) b", []), ("", []),
    ],
)
def test_enumerators_of_a_sentence(spark, text, want):
    assert spark.range(1).select(ordered.text_enumerators(F.lit(text))).first()[0] == want


def test_last_run_discards_what_is_excluded(spark):
    def run(kinds, numbers=None):
        rows = [("d", i, k == "r", k == "f", (numbers or {}).get(i), k == "b", k == "x") for i, k in enumerate(kinds)]
        got = ordered.reference_run(spark.createDataFrame(rows, "doc string, para int, is_ref boolean, filler_ok boolean, number int, blank boolean, excluded boolean")).collect()
        return [(r.start, r.length) for r in got]

    assert run("rrrorr") == [(0, 3)] and run("rrrx") == [] and run("rrrbrrr") == [(4, 3)] and run("rr") == []
    assert run("rfr", {0: 1, 1: 2, 2: 3}) == [(0, 3)] and run("rfr", {0: 1, 1: 3, 2: 3}) == [] and run("frrr", {0: 1}) == [(1, 3)]
