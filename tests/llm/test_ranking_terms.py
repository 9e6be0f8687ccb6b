import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ticketloom.llm import distinctive_terms as D
from ticketloom.llm import rank_fusion as R

INF, NAN = float("inf"), float("nan")


def brute_positions(rows):
    out = {}
    for g, item, v in rows:
        values = [x for h, _, x in rows if h == g]
        v = None if v is None or v != v else v
        out[g, item] = len(values) if v is None else 1 + sum(x is not None and x == x and x > v for x in values)
    return out


@pytest.mark.parametrize("range_rows", [50_000, 5])
def test_positions_against_brute_force(spark, range_rows):
    """With tiny ranges every group is cut; the result is the same."""
    rows = [(k % 2, k, [None, NAN, INF, -INF, 0.0, -0.0][k % 6] if k % 5 == 0 else float((k * 7) % 40)) for k in range(150)]
    df = spark.createDataFrame(rows, "g long, item long, v double").withColumn("value", R.finite(F.col("v"))).drop("v")
    assert {(r.g, r.item): r.position for r in R.positions(df, ["g"], range_rows=range_rows).collect()} == brute_positions(rows)


@pytest.mark.parametrize("range_rows", [50_000, 7])
def test_final_ranks_of_ties_in_ranges(spark, range_rows):
    """A hot group whose medians are nearly all equal, a null group and a small one."""
    rows = [(g, k, 3 if k % 9 else 1, 2.5 if k % 4 else 2.0) for g, n in ((1, 90), (None, 4), (3, 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g long, item long, median_position long, mean_position double")
    got = {(r.g, r.item): r.final_rank for r in R.final_ranks(df, ["g"], "item", range_rows).collect()}
    want = {(g, x[1]): k for g in (1, None, 3) for k, x in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[3], r[1])), 1)}
    assert got == want


def candidates(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], "query_id long, issue_id long, seed_score double, pool_rank int, position string")


def reranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, issue_id long, feature_scores map<string,double>, scored_at timestamp_ntz")


def ranks(spark, cand, rer):
    w = {"seed_score": 1.0} | {f: 1.0 for f in R.FEATURES}
    return R.aggregate_ranks(R.candidate_scores(candidates(spark, cand), reranked(spark, rer)), ["query_id"], "issue_id", w)


def test_scale_does_not_decide(spark):
    """Item 3 is far ahead in one huge score only; item 1 leads in the six others."""
    t = datetime(2024, 1, 1)
    f = lambda x: {n: x for n in R.FEATURES}
    got = R.final_ranks(ranks(spark, [(1, 1, 0.1), (1, 2, 0.2), (1, 3, 1e12), (1, 3, 1e12)], [(1, 1, f(0.9), t), (1, 2, f(0.5), t), (1, 3, f(0.1), t)]), ["query_id"], "issue_id")
    assert [r.issue_id for r in got.orderBy("final_rank").collect()] == [1, 2, 3]


def test_latest_row_missing_features_and_ties(spark):
    old, new = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [(1, 1, {"bm25": 9.0}, old), (1, 1, {"bm25": 0.0, "bm25_plus": NAN, "tfidf_cosine": None}, new), (1, 1, {"bm25": 0.0}, None), (1, 2, None, new), (1, 9, {"bm25": 99.0}, new), (None, 1, {}, old)]
    merged = ranks(spark, [(1, 1, None), (1, 2, None), (2, 5, NAN)], rows)
    got = {(r.query_id, r.issue_id): r for r in merged.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 5)}
    assert got[1, 1].mean_position == pytest.approx((1 + 6 * 2) / 7) and got[1, 2].mean_position == 2 and got[2, 5].median_position == 1
    best = {r.query_id: r.issue_id for r in R.best_by_mean(merged, ["query_id"], "issue_id").collect()}
    assert best == {1: 1, 2: 5}


def test_empty_tables(spark):
    assert ranks(spark, [], []).count() == 0


def test_weighted_median(spark):
    rows = [([(1, 1.0), (5, 3.0), (9, 1.0)],), ([(1, 1.0), (2, 1.0)],), ([(7, 2.0)],)]
    df = spark.createDataFrame(rows, "p array<struct<position:bigint,weight:double>>")
    assert [r[0] for r in df.select(R.weighted_median(F.col("p"))).collect()] == [5, 1, 7]


BAGS = "issue_id long, term_frequency map<string,int>, document_length long, prepared_at timestamp_ntz, term string"


def bags(spark, rows):
    return spark.createDataFrame([(i, m, 0, t, "clash") for i, m, t in rows], BAGS)


@pytest.mark.parametrize("hot", [0.01, 2.0])
def test_terms_against_brute_force(spark, hot):
    """Whether terms take the broadcast or the shuffle way makes no difference."""
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [(1, {"x": 3, "y": 1, "z": 0}, b), (1, {"q": 5}, a), (2, {"x": 1}, a), (2, {"x": 1}, a), (3, None, a), (4, {"z": 0}, a), (5, {}, a), (6, {"y": 1, "x": 1}, None)]
    got = {(r.issue_id, r.term): r for r in D.term_scores(bags(spark, rows), hot).collect()}
    assert set(got) == {(1, "x"), (1, "y"), (2, "x"), (6, "y"), (6, "x")}
    r = got[1, "x"]
    assert (r.n_records, r.df, r.cf) == (3, 3, 5)
    assert r.tfidf == pytest.approx((1 + math.log(3)) * (math.log(4 / 4) + 1), abs=1e-6)
    assert r.ridf == pytest.approx(math.log2(3 / 3) + math.log2(1 - math.exp(-5 / 3)))
    top = {x.issue_id: x.term for x in D.top_term(D.term_scores(bags(spark, rows), hot), "tfidf").collect()}
    assert top == {1: "x", 2: "x", 6: "y"}


def test_no_bags(spark):
    assert D.term_scores(bags(spark, [])).count() == 0


def test_collection_frequency(spark):
    rows = [(0, "a", 2, 9), (0, "a", 2, 9), (1, "a", 3, 9), (1, "b", None, 9), (1, None, 4, 9)]
    df = spark.createDataFrame(rows, "segment_id long, term string, document_frequency long, doc_count long")
    assert {r.term: r.document_frequency for r in D.collection_frequency(df).collect()} == {"a": 5, "b": 0}
