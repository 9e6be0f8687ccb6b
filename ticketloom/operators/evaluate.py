"""Evaluation of rankings: rank metrics at several cut-offs and threshold metrics, all queries of a model in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 3, 5, 10)
THRESHOLDS = (0.45, 0.55, 0.65)


def labels(issues: DataFrame, task: str, sample_size: int | None = None) -> DataFrame:
    """(qid, issue_id) relevant pairs: linked ids for 'similarity', duplicate ids for 'duplicates'; the first sample_size queries by id.

    Relevant ids need not be in the corpus: such ones count against recall.
    """
    field = {"similarity": "linked_issue_ids", "duplicates": "duplicate_issue_ids"}[task]
    pairs = issues.select(F.col("issue_id").alias("qid"), F.explode(F.array_distinct(field)).alias("issue_id"))
    if sample_size is None:
        return pairs
    first = pairs.select("qid").distinct().orderBy("qid").limit(sample_size)
    return pairs.join(first, "qid")


def judged(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Ranked rows (qid, issue_id, rank, ...) of labelled queries with hit (0/1), hits_so_far and n_relevant."""
    n = relevant.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    marks = relevant.select("qid", "issue_id", F.lit(1).alias("hit"))
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.join(n, "qid").join(marks, ["qid", "issue_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
        .withColumn("hits_so_far", F.sum("hit").over(so_far))
    )


def rank_metrics(ranked: DataFrame, relevant: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """(metric, k, value): mrr (at the largest cut-off) and recall, map, precision, ndcg, hit_rate at each k.

    Means are over all labelled queries; one without results counts 0 everywhere. Average precision divides by the
    number of relevant ids, precision by k. Values are rounded to 6 decimals after averaging.
    """
    deepest = max(cutoffs)
    n = relevant.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    rows = judged(ranked.where(F.col("rank") <= deepest), relevant)
    aggs = [F.max(F.when(F.col("hit") == 1, 1 / F.col("rank"))).alias("rr")]
    for k in cutoffs:
        within = (F.col("hit") == 1) & (F.col("rank") <= k)
        aggs += [
            F.count_if(within).alias(f"h{k}"),
            F.sum(F.when(within, F.col("hits_so_far") / F.col("rank"))).alias(f"p{k}"),
            F.sum(F.when(within, 1 / F.log2(F.col("rank") + F.lit(1.0)))).alias(f"g{k}"),
        ]
    per = n.join(rows.groupBy("qid").agg(*aggs), "qid", "left").fillna(0)
    means = [F.avg("rr").alias("mrr")]
    for k in cutoffs:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))
        means += [
            F.avg(F.col(f"h{k}") / F.col("n_relevant")).alias(f"recall@{k}"), F.avg(F.col(f"p{k}") / F.col("n_relevant")).alias(f"map@{k}"),
            F.avg(F.col(f"h{k}") / k).alias(f"precision@{k}"), F.avg(F.col(f"g{k}") / ideal).alias(f"ndcg@{k}"), F.avg(F.when(F.col(f"h{k}") > 0, 1.0).otherwise(0.0)).alias(f"hit_rate@{k}"),
        ]
    wide = per.agg(*means)
    cells = [F.struct(F.lit("mrr").alias("metric"), F.lit(deepest).alias("k"), F.col("mrr").alias("value"))]
    cells += [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(f"`{m}@{k}`").alias("value")) for m in ("recall", "map", "precision", "ndcg", "hit_rate") for k in cutoffs]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.metric", "c.k", F.round(F.coalesce("c.value", F.lit(0.0)), 6).alias("value"))


def threshold_metrics(ranked: DataFrame, relevant: DataFrame, deepest: int = 10, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(threshold, precision, recall, f1) from counts summed over all queries' top lists; a relevant id that is not in a list at all is a miss."""
    rows = judged(ranked.where(F.col("rank") <= deepest), relevant)
    total = relevant.count()
    sums = rows.agg(*[c for i, t in enumerate(thresholds) for c in (F.count_if((F.col("score") >= t) & (F.col("hit") == 1)).alias(f"tp{i}"), F.count_if((F.col("score") >= t) & (F.col("hit") == 0)).alias(f"fp{i}"))])
    both = sums.withColumn("total", F.lit(total).cast("bigint"))
    cells = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("total") - F.col(f"tp{i}")).alias("fn")) for i, t in enumerate(thresholds)]))
    c = both.select(cells.alias("c")).select("c.*")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("threshold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def binary_metrics(scored: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 and loss (cross-entropy) of rows (label, probability), in one aggregate."""
    y, said = F.col("label") == 1, F.col("probability") >= cutoff
    p = F.least(F.greatest(F.col("probability"), F.lit(1e-12)), F.lit(1 - 1e-12))
    s = scored.agg(F.count("*").alias("n"), F.count_if(y & said).alias("tp"), F.count_if(~y & said).alias("fp"), F.count_if(y & ~said).alias("fn"), F.avg(-F.when(y, F.log(p)).otherwise(F.log(1 - p))).alias("loss"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    pr, re = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select(F.round(ratio(F.col("n") - F.col("fp") - F.col("fn"), F.col("n")), 6).alias("accuracy"), F.round(pr, 6).alias("precision"), F.round(re, 6).alias("recall"),
                    F.round(F.when((pr > 0) & (re > 0), 2 * pr * re / (pr + re)).otherwise(0.0), 6).alias("f1"), F.round(F.coalesce("loss", F.lit(0.0)), 6).alias("loss"))
