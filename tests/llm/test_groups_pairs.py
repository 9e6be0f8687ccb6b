import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import components as K
from ticketloom.llm import near_duplicates as N


def brute_groups(edges):
    group = {}
    for u, v in edges:
        if u is None or v is None or u == v:
            continue
        a, b = group.get(u, {u}), group.get(v, {v})
        for x in a | b:
            group[x] = a | b
    return {x: min(g) for x, g in group.items()}


def found_groups(spark, edges, **options):
    df = spark.createDataFrame(edges, "u long, v long")
    return {r.id: r.group_id for r in K.connected_components(df, **options).collect()}


def test_chain_star_and_repeats(spark):
    rnd = random.Random(3)
    ids = rnd.sample(range(1000, 9000), 400)
    chain = list(zip(ids[:200], ids[1:200]))
    star = [(ids[200], x) for x in ids[201:300]]
    pairs = [(ids[k], ids[k + 1]) for k in range(300, 398, 2)]
    edges = chain + star + pairs + [(b, a) for a, b in pairs] + [(5, 5), (None, 7), (7, None)] + star
    assert found_groups(spark, edges) == brute_groups(edges)


@pytest.mark.parametrize("first,rounds", [(0, 1), (0, 2), (1, 1), (3, 9)])
def test_rounds_decide_nothing(spark, first, rounds):
    """A long chain off the hub: contractions before, and frontier joins before, at, or after its end."""
    edges = [(50, k) for k in range(51, 60)] + [(k, k + 1) for k in range(59, 65)] + [(1, 65)] + [(200, 201)]
    assert found_groups(spark, edges, first_rounds=first, frontier_rounds=rounds) == brute_groups(edges)


def test_giant_component_is_peeled_whole(spark):
    """A star is complete after the first round, so the search starts in the long chain and ends when all of it is reached."""
    rnd = random.Random(4)
    ids = rnd.sample(range(1000, 9000), 300)
    edges = [(1, k) for k in range(2, 60)] + list(zip(ids, ids[1:]))
    report = {}
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.id: r.group_id for r in K.connected_components(df, report=report).collect()}
    assert got == brute_groups(edges) and report["peeled"] == 300


def test_no_edges(spark):
    assert found_groups(spark, []) == {}


def test_edges_from_fields(spark):
    rows = [(1, "2||x||A-3", None), (2, "", "1"), (3, None, None), (3, None, "77"), (None, "1", "2")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "issue_id long, l string, d string, v int").select("issue_id", "l", "d", "v")
    assert sorted(map(tuple, K.tied_edges(df, ["l", "d"]).collect())) == [(1, 2), (1, 3)]


def brute_pairs(records, threshold, least):
    import re

    sets = [(i, set(re.findall("[a-z0-9_]+", t.lower()))) for i, t in records if t]
    out = set()
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i != j and min(len(x), len(y)) >= least and len(x & y) >= threshold * len(x | y) - 1e-9:
                out.add((min(i, j), max(i, j)))
    return out


def edited(rnd, words, vocabulary):
    out = list(words)
    for _ in range(rnd.randint(0, len(words) // 3)):
        k = rnd.randrange(len(out))
        kind = rnd.random()
        if kind < 0.4:
            out[k] = rnd.choice(vocabulary)
        elif kind < 0.7:
            out.insert(k, rnd.choice(vocabulary))
        elif len(out) > 5:
            del out[k]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("threshold,seed", [(0.7, 1), (0.8, 2), (0.5, 3)])
def test_pairs_against_brute_force(spark, threshold, seed):
    """A small vocabulary (so unrelated records share much), sizes across bands, edits around the threshold."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(160)]
    records, k = [], 0
    for _ in range(60):
        base = rnd.sample(vocabulary, rnd.randint(18, 90))
        for _ in range(rnd.randint(1, 5)):
            k += 1
            records.append((k, " ".join(edited(rnd, base, vocabulary))))
    records += [records[0], (k + 1, records[0][1].upper()), (k + 2, None), (k + 3, ""), (k + 4, "short")]
    df = spark.createDataFrame([(*r, "clash") for r in records], "id long, text string, words string")
    got = {tuple(r) for r in N.near_duplicate_pairs(df, "id", F.col("text"), threshold, 20).collect()}
    want = brute_pairs(records, threshold, 20)
    assert got == want and len(want) > 20


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 300).astype(np.uint64)
    for _ in range(50):
        a, b = (rng.choice(pool, rng.integers(1, 100), replace=False) for _ in range(2))
        s = [N._sketches(x, np.array([0])) for x in (a, b)]
        distance = sum(bin(int(np.uint64(p[0]) ^ np.uint64(q[0]))).count("1") for p, q in zip((s[0][0].view(np.uint64), s[0][1].view(np.uint64)), (s[1][0].view(np.uint64), s[1][1].view(np.uint64))))
        assert distance <= len(set(a.tolist()) ^ set(b.tolist()))


def test_classes_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text), (2, text), (2, text), (3, text + " more words"), (4, "other " * 30)], "id long, text string")
    got = {r.issue_id: (r.class_id, r.n_members, r.n_links) for r in N.near_duplicate_classes(df, "id", F.col("text"), 0.7, 20).collect()}
    assert got == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 1, 1)}
    assert N.near_duplicate_pairs(df.limit(0), "id", F.col("text"), 0.7, 20).count() == 0
