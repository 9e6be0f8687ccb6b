import math

import numpy as np
import pytest

from ticketloom.llm import neighbours as N


def brute(ids, m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = {}
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]
        out[int(ids[a])] = [(int(ids[b]), float(s[a, b])) for b in order]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "issue_id long, vec array<float>")


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, d))
    return (centres[rng.integers(0, len(centres), n)] + 0.5 * rng.normal(size=(n, d))).astype(np.float32)


@pytest.mark.parametrize("n,d,cells,shard_rows", [(1500, 24, 3, 100_000), (600, 64, 3, 100), (2000, 24, 12, 300)])
def test_recall_against_brute_force(spark, n, d, cells, shard_rows):
    """All cells asked, cells cut into several shards, and fewer cells asked than there are."""
    m = clustered(n, d, n)
    rows = [(k, m[k].tolist()) for k in range(n)]
    got = {}
    for r in N.nearest([N.usable_vectors(table(spark, rows), "issue_id", "vec", d, "s")], 3, cells=cells, shard_rows=shard_rows).collect():
        got.setdefault(r.id, set()).add(r.other)
    want = brute(np.arange(n), m.astype(float), 3)
    recall = np.mean([len(got[i] & {x for x, _ in w}) / 3 for i, w in want.items()])
    assert recall >= 0.95


def test_a_stored_graph_is_the_built_one():
    m = clustered(900, 16, 2)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    built = N.Graph(m)
    read = N.Graph(m, flat=built.flat())
    assert len(built.links) > 1 and built.entry == read.entry
    assert all((a == b).all() for a, b in zip(built.links, read.links))


def test_unusable_and_repeated_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0]), (7, [1.0, 0.0, 0.0]), (8, [inf, 1.0]), (9, []), (None, [1.0, 1.0]), (10, [-1.0, 0.0]), (11, [None, 1.0])]
    usable = N.usable_vectors(table(spark, rows), "issue_id", "vec", 2, "s")
    assert sorted(r.id for r in usable.collect()) == [1, 2, 10]
    found = N.nearest([usable], 3)
    pairs = [tuple(r) for r in N.similar_pairs(found, 0.85).collect()]
    assert pairs == [("s", 1, 2)]
    best = {(r.id, r.rank): r for r in found.collect()}
    assert best[1, 1].similarity == round(2 / math.hypot(2, 0.1), 6) and best[1, 2].other == 10


def test_ties_go_to_the_smaller_id(spark):
    rows = [(k, [1.0, 0.0]) for k in range(30, 0, -1)]
    got = {}
    for r in N.nearest([N.usable_vectors(table(spark, rows), "issue_id", "vec", 2, "s")], 3, cells=2, beam=64).collect():
        got.setdefault(r.id, []).append(r.other)
    assert sorted(got[30]) == [1, 2, 3] and sorted(got[1]) == [2, 3, 4]


@pytest.mark.parametrize("scaled", [False, True])
def test_more_ties_than_the_beam_holds(spark, scaled):
    n, rng = 6000, np.random.default_rng(8)
    copies = rng.random(n) < 0.33
    scale = 1 + rng.random(n) if scaled else np.ones(n)
    m = np.where(copies[:, None], clustered(40, 16, 3)[0] * scale[:, None], clustered(n, 16, 4)).astype(np.float32)
    rows = [(k, m[k].tolist()) for k in range(n)]
    got = {}
    for r in N.nearest([N.usable_vectors(table(spark, rows), "issue_id", "vec", 16, "s")], 3, cells=2).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other, r.similarity))
    same = np.flatnonzero(copies)
    assert all(got[i] == [(j, 1.0) for j in same[:4] if j != i][:3] for i in same)
    u = m / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    asked = np.flatnonzero(~copies)[::40]
    hits = 0
    for i in asked:
        s = np.round(u @ u[i], 6)
        s[i] = -2
        hits += len({o for o, _ in got[i]} & set(np.lexsort((np.arange(n), -s))[:3]))
    assert hits >= 0.95 * 3 * len(asked)


def test_small_and_empty_spaces(spark):
    none = N.usable_vectors(table(spark, []), "issue_id", "vec", 2, "a")
    one = N.usable_vectors(table(spark, [(1, [1.0, 2.0])]), "issue_id", "vec", 2, "b")
    assert N.nearest([none, one], 3).count() == 0
