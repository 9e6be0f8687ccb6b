"""Candidate generation: ranked pools per query from lexical, dense and fused scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block and corpus rows of one chunk that a task multiplies; both sides of a task are bounded.
QUERY_BLOCK, CORPUS_CHUNK = 512, 50_000


#: The lexical scores of a pair, which pools cut from them keep.
LEXICAL = ("bm25", "bm25_plus", "tfidf_cosine", "coarse")


def top_pool(scored: DataFrame, pool: int, score: str = "seed", keep: Sequence[str] = ()) -> DataFrame:
    """The `pool` best candidates of each query: qid, issue_id, seed, rank, and the columns of `keep`. Ties of the score rounded to 6 decimals go to the smaller id."""
    order = Window.partitionBy("qid").orderBy(F.desc(F.round(score, 6)), "issue_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool).select("qid", "issue_id", F.col(score).alias("seed"), "rank", *keep)


def sparse_candidates(lexical: DataFrame, score: str, pool: int) -> DataFrame:
    """Best candidates by one lexical score above 0, with all their lexical scores."""
    return top_pool(lexical.where(F.col(score) > 0).select("qid", "issue_id", F.col(score).alias("seed"), *LEXICAL), pool, keep=LEXICAL)


def sparse_pools(lexical: DataFrame, scores: Sequence[str], pool: int) -> DataFrame:
    """sparse_candidates() by several scores in one pass over the pairs: score_name and the columns of sparse_candidates()."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).alias("seed")) for s in scores]))
    rows = lexical.select("qid", "issue_id", *LEXICAL, each.alias("s")).select("s.score_name", "qid", "issue_id", "s.seed", *LEXICAL).where("seed > 0")
    order = Window.partitionBy("score_name", "qid").orderBy(F.desc(F.round("seed", 6)), "issue_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)


def with_fallback(candidates: DataFrame, queries: DataFrame, prepared: DataFrame, pool: int) -> DataFrame:
    """Adds, for queries (qid, project_key) without candidates, the first records of their project, or of the corpus if the project has none; seed 0."""
    empty = queries.join(candidates.select("qid").distinct(), "qid", "left_anti")
    ids = prepared.select("issue_id", "project_key")
    by_id = Window.partitionBy("project_key").orderBy("issue_id")
    firsts = ids.where(F.col("project_key") != "").withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= pool)
    own = empty.join(firsts, "project_key").select("qid", "issue_id", F.lit(0.0).alias("seed"), "rank")
    # The first ids of the corpus, `pool` at most, are one value: a list that every remaining query takes apart.
    corpus = ids.select("issue_id").orderBy("issue_id").limit(pool).agg(F.array_sort(F.collect_list("issue_id"))).scalar()
    none = empty.join(own.select("qid").distinct(), "qid", "left_anti")
    rest = none.select("qid", F.posexplode(corpus).alias("at", "issue_id")).select("qid", "issue_id", F.lit(0.0).alias("seed"), (F.col("at") + 1).alias("rank"))
    scores = [c for c in LEXICAL if c in candidates.columns]
    more = own.unionByName(rest).withColumns({c: F.lit(0.0) for c in scores})  # they share no term with the query
    return candidates.unionByName(more.select(*candidates.columns))


def exclude_self(candidates: DataFrame) -> DataFrame:
    """Drops the query itself, after the pool was cut: it uses up one place."""
    return candidates.where(F.col("qid") != F.col("issue_id"))


def dense_topk(queries: DataFrame, corpus: DataFrame, pool: int, positive: bool = True) -> DataFrame:
    """Exact best candidates by cosine: qid, issue_id, seed, rank; with `positive` only similarities above 0.

    queries (qid, vector), corpus (issue_id, vector), vectors as array<double> of one dimension, not zero. Blocks of
    queries meet chunks of the corpus as matrices in a cogrouped map; each pair of block and chunk keeps its best.
    """
    n_queries, n_rows = queries.count(), corpus.count()
    blocks, chunks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // CORPUS_CHUNK), min(8, n_rows // 500))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select("qid", F.col("vector").alias("q_vector")).withColumn("block", place("qid", blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    c = corpus.select("issue_id", F.col("vector").alias("c_vector")).withColumn("chunk", place("issue_id", chunks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "issue_id": np.zeros(0, np.int64), "seed": np.zeros(0)})
        right = right.sort_values("issue_id", ignore_index=True)
        a, b = (np.stack(x.to_numpy()).astype(float) for x in (left["q_vector"], right["c_vector"]))
        s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        rounded = np.round(s, 6)
        k = min(pool, s.shape[1])
        order = np.argsort(-rounded, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(a)), k)
        out = pd.DataFrame({"qid": left["qid"].to_numpy()[row], "issue_id": right["issue_id"].to_numpy()[order.ravel()], "seed": np.take_along_axis(s, order, 1).ravel()})
        return out[out["seed"] > 0] if positive else out

    found = q.groupBy("block", "chunk").cogroup(c.groupBy("block", "chunk")).applyInPandas(best, "qid long, issue_id long, seed double")
    return top_pool(found, pool)


def reciprocal_rank_fusion(sparse: DataFrame, dense: DataFrame, pool: int, sparse_weight: float = 0.52, dense_weight: float = 0.48,
                           rank_constant: int = 25, score_mix: float = 0.18) -> DataFrame:
    """Fuses two ranked lists: weight / (constant + rank) + mix * normalised seed, summed over the lists; one union, one aggregate."""
    def part(ranked: DataFrame, weight: float, seed: Column) -> DataFrame:
        return ranked.select("qid", "issue_id", (weight / (rank_constant + F.col("rank")) + score_mix * seed).alias("seed"))

    squashed = F.when(F.col("seed") > 0, F.col("seed") / (F.col("seed") + 8)).otherwise(0.0)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("seed")))
    both = part(sparse, sparse_weight, squashed).unionByName(part(dense, dense_weight, clamped))
    return top_pool(both.groupBy("qid", "issue_id").agg(F.sum("seed").alias("seed")), pool)
