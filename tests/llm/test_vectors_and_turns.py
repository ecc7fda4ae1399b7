"""Hard negatives, near-duplicate vectors and the trie of turns against brute force, and their edge cases."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refloom.llm import hardneg, turntrie, vecdup

VECTORS = "vec_id long, vector array<float>, label int, q string, `key` int, v int, cid int"


def vector_rows(rng, n, d=6, labels=3):
    """Random, near, equal and opposite vectors, some of them not usable, some repeated."""
    base = rng.standard_normal((8, d))
    rows = []
    for i in range(n):
        x = base[rng.integers(8)] + rng.standard_normal(d) * rng.choice([0, 0.02, 0.05, 0.1])
        rows.append((i * 5, [float(np.float32(c)) for c in x * rng.choice([0.5, 1, 3])], int(rng.integers(labels)), "x", 1, 2, 3))
    rows[3] = (*rows[3][:1], None, *rows[3][2:])
    rows[4] = (*rows[4][:1], [0.0] * d, *rows[4][2:])
    rows[5] = (*rows[5][:1], [*rows[5][1][:-1], float("nan")], *rows[5][2:])
    rows[6] = (*rows[6][:1], [*rows[6][1][:-1], None], *rows[6][2:])
    rows[7] = (*rows[7][:1], [*rows[7][1][:-1], float("inf")], *rows[7][2:])
    rows[8] = (*rows[8][:2], None, *rows[8][3:])
    rows[9] = (*rows[9][:1], rows[9][1][:-2], *rows[9][2:])
    rows[10] = (*rows[10][:1], [], *rows[10][2:])
    rows.append((None, *rows[11][1:]))
    return [*rows, rows[12], rows[12]]


def usable(rows, zero=True):
    out = {}
    for i, x, label, *_ in rows:
        if i is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x) and (zero or any(x)):
            out[i] = (label, x)
    return out


def brute_negatives(rows, positives=5, negatives=3, every=25):
    v = {i: (label, [math.floor(256 * c) for c in x]) for i, (label, x) in usable(rows).items()}
    out = []
    for a in (i for i in v if i % every == 0):
        score = {i: sum(p * q for p, q in zip(v[a][1], v[i][1], strict=False)) for i in v if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if v[i][0] == v[a][0]][:positives]:
            found = [i for i in order if v[i][0] != v[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negatives]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hardneg, "ROW_BLOCK", 20)
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", 7)
    rows = vector_rows(np.random.default_rng(seed), 120)
    got = hardneg.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 25 == 0).collect()
    want = brute_negatives(rows)
    assert sorted(tuple(r) for r in got) == want and len(want) > 20


def test_hard_negatives_with_ties_and_few_rows(spark):
    same = [(i * 25, [1.0, 0.0], i % 2, "x", 1, 2, 3) for i in range(6)] + [(200, [0.6, 0.5], 1, "x", 1, 2, 3), (201, [0.6, -0.5], 1, "x", 1, 2, 3)]
    got = hardneg.hard_negatives(spark.createDataFrame(same, VECTORS), F.col("vec_id") % 25 == 0).collect()
    want = brute_negatives(same)
    assert sorted(tuple(r) for r in got) == want and any(r[3] == 200 and r[2] == 1 for r in want)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(25, [1.0], 1, "x", 1, 2, 3)], [(None, None, None, None, None, None, None)]):
        assert hardneg.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 25 == 0).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.integers(1, 60))
def test_bounds_hold_every_exact_score(seed, dims, n):
    rng = np.random.default_rng(seed)
    q = rng.integers(-300, 300, (n, dims))
    book = hardneg.fit_codebook(q[: max(1, n // 2)])
    low, high = hardneg.bounds(q[:3], *hardneg.encode(q, book), book)
    exact = q @ q[:3].T
    assert (low <= exact).all() and (exact <= high).all()
    for c in range(exact.shape[1]):
        bottom, top = sorted(rng.integers(exact.min() - 5, exact.max() + 5, 2).tolist())
        may = hardneg.window_candidates(low[:, c], high[:, c], bottom, top, 3)
        inside = np.flatnonzero((exact[:, c] >= bottom) & (exact[:, c] <= top))
        assert may[inside[hardneg.best(exact[inside, c], inside, 3)]].all()


def test_huge_components_are_clipped():
    fine, q = hardneg.integers(__import__("pandas").Series([[1e300, -1e300], [0.5, -0.001]]), 256, 2)
    assert fine.all() and q.tolist() == [[2147483647, -2147483647], [128, -1]] or q[1].tolist() == [128, -1]
    assert abs(int(q[0, 0])) ** 2 * 2 <= 2**63


def brute_vectors(rows, least=0.98):
    v = usable(rows, zero=False)
    d = max(len(x) for _, x in v.values())
    x = {i: np.pad(np.array(x, dtype=np.float64), (0, d - len(x))) for i, (_, x) in v.items()}
    near = {i: [j for j in v if j != i and v[i][0] == v[j][0] and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= least] for i in v}
    out = {}
    for i in sorted({r[0] for r in rows if r[0] is not None}):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, [])), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize(("seed", "block"), [(3, 2048), (4, 3)])
def test_near_vectors_match_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(vecdup, "BLOCK", block)
    rows = vector_rows(np.random.default_rng(seed), 160)
    got = vecdup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    want = brute_vectors(rows)
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == want
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert len({c for _, c, _ in want.values()}) > 5 and max(n for n, _, _ in want.values()) > 5


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in (np.ones(6) if i % 3 == 0 else rng.standard_normal(6))], 0, "x", 1, 2, 3) for i in range(900)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vecdup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got == brute_vectors(rows) and got[0][0] >= 299


def test_buckets_of_several_clusters_are_compared_in_blocks(spark, monkeypatch):
    """All keys alike: everything meets in one bucket, whose centres join few of the clusters."""
    monkeypatch.setattr(vecdup, "BLOCK", 4)
    monkeypatch.setattr(vecdup, "plan_tables", lambda n, least: (1, 40))
    monkeypatch.setattr(vecdup, "WIDTH", 2.0)
    rows = vector_rows(np.random.default_rng(7), 90, d=2, labels=1)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vecdup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect() if r.vec_id is not None}
    assert got == brute_vectors(rows)


def test_near_vectors_of_nothing(spark):
    assert vecdup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    only = [(1, None, 1, "x", 1, 2, 3), (2, [], None, "x", 1, 2, 3)]
    assert sorted(tuple(r) for r in vecdup.near_vectors(spark.createDataFrame(only, VECTORS)).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_tables_grow_slowly_and_miss_no_pair_at_the_threshold():
    for n in (10, 10**5, 10**9):
        k, tables = vecdup.plan_tables(n)
        p = vecdup.shared(math.sqrt(2 - 2 * 0.98))
        assert (1 - p**k) ** tables <= vecdup.MISS and n * vecdup.shared(math.sqrt(2)) ** k <= 1
    assert vecdup.plan_tables(10**9)[1] < 10 * vecdup.plan_tables(10**5)[1]


TURNS = "conv_id long, turn long, role string, text string, part int, `key` string, path string"


def turn_rows(rng, n):
    texts = ["a", "bb", "", None, "é" * 3, "long " * 40]
    rows = []
    for c in rng.permutation(n).tolist():
        length = 3 if c % 3 == 0 else int(rng.integers(1, 8))
        for t in range(length):
            same = c % 3 == 0
            rows.append((c * 7, None if t == 0 and c % 2 else t, None if t % 4 == 3 else "user", "one" if same else texts[rng.integers(len(texts))], 1, "k", "p"))
    return [*rows, (None, 1, "user", "no id", 1, "k", "p")]


def brute_trie(rows, rebuilt=True):
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        made[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, ids in members.items():
        leaves, saved, todo = 0, 0, [p]
        while todo:
            q = todo.pop()
            leaves += q not in kids
            saved += (len(members[q]) - 1) * (len(q[-1][1]) if q else 0)
            todo += kids.get(q, [])
        ends = ",".join(str(c) for c in sorted(ids) if len(made[c]) == len(p))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "turns"), [(1, 200_000), (2, 12), (3, 3)])
def test_trie_matches_brute_force(spark, seed, turns, monkeypatch):
    """Few and many partitions: a conversation that a third of all ids share then crosses many borders."""
    monkeypatch.setattr(turntrie, "PART_TURNS", turns)
    monkeypatch.setattr(turntrie, "BROADCAST_ROWS", 5 if turns == 3 else 100_000)
    rows = turn_rows(np.random.default_rng(seed), 90)
    c = F.col("conv_id")
    arrays = turntrie.turn_arrays(spark.createDataFrame(rows, TURNS))
    got = turntrie.prefix_trie(turntrie.rebuild(arrays, c - c % 100, (F.crc32(c.cast("string")) % 6).cast("int"), 5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows)


def test_trie_of_conversations_as_they_are(spark):
    rows = [(1, 1, "u", "a", 1, "k", "p"), (1, 1, "u", "a", 1, "k", "p"), (2, None, "u", "a", 1, "k", "p"), (-3, 5, "u", "a", 1, "k", "p"), (-3, 2, "u", "b", 1, "k", "p")]
    got = turntrie.prefix_trie(turntrie.turn_arrays(spark.createDataFrame(rows, TURNS))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows, rebuilt=False)


def test_trie_of_turnless_and_of_no_conversations(spark):
    assert turntrie.prefix_trie(turntrie.turn_arrays(spark.createDataFrame([], TURNS))).count() == 0
    none = spark.createDataFrame([(5, []), (3, [])], "conv_id long, turns array<struct<digest:string,size:int>>")
    assert [tuple(r) for r in turntrie.prefix_trie(none).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=25), st.integers(1, 6), st.integers(1, 3))
def test_sweep_and_borders_add_up_wherever_partitions_end(paths, per, ids):
    """Fragments and border rows of partitions of any size give the same nodes as one partition, ids in chunks included."""
    turn = lambda x: f"{x:0{turntrie.WIDE}d}"
    rows = sorted((("".join(map(turn, p)), i, [x + 1 for x in p]) for i, p in enumerate(paths)), key=lambda r: r[:2])
    whole, chunk = turntrie.IDS, ids
    turntrie.IDS = chunk
    try:
        nodes, parts, ends, edges = [], {}, {}, []
        for k, at in enumerate(range(0, len(rows), per)):
            for kind, key, parent, part, seq, conv, depth, up, n, c, leaves, saved, text in turntrie.sweep(k, iter([(i, p, s) for p, i, s in rows[at : at + per]])):
                if kind == "node":
                    nodes.append((conv, depth, up, parent, n, c, leaves, saved, text))
                elif kind == "part":
                    parts.setdefault(key, []).append((conv, depth, parent, n, c, leaves, saved))
                elif kind == "ends":
                    ends.setdefault(key, []).append(((part, seq), text))
                else:
                    edges.append((part, seq, key, [int(x) for x in text.split(",")] if text else []))
    finally:
        turntrie.IDS = whole
    edges.sort()
    fix = {}
    for (_, s, before, sizes), (_, _, after, _) in zip(edges, edges[1:], strict=False):
        if s == 1:
            for key, c, leaves, saved in turntrie.borders(before, sizes, after):
                fix.setdefault(key, []).append((c, leaves, saved))
    stitched = {}
    for key, found in parts.items():
        f = fix.get(key, [])
        text = ",".join(t for _, t in sorted(ends.get(key, [])))
        stitched[key] = (min(x[0] for x in found), found[0][1], found[0][2], sum(x[3] for x in found), *(sum(x[4 + j] for x in found) + sum(x[j] for x in f) for j in range(3)), hashlib.sha256(text.encode()).hexdigest())
    got = [(c, d, stitched[p][0] if p is not None else None, *rest) for c, d, p, *rest in stitched.values()]
    got += [(c, d, up if parent is None else stitched[parent][0], *rest) for c, d, up, parent, *rest in nodes]
    turns = [(i, t, "", "x" * (x + 1)) for i, p in enumerate(paths) for t, x in enumerate(p)]
    made = {i: tuple(p) for i, p in enumerate(paths)}
    want = brute_trie([(*t, 0) for t in turns], rebuilt=False) if turns else []
    if all(made.values()):
        assert sorted(got, key=str) == want
    else:
        assert len(got) == len({p[:d] for p in made.values() for d in range(len(p) + 1)})
