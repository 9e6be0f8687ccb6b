"""One ranking from several scores on unlike scales, by median rank aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.text import let
from ticketloom.storage import discard, materialize

#: Rows of a range, which one task sorts.
RANGE_ROWS = 50_000


def finite(value: Column) -> Column:
    """The value as double, NaN as null."""
    value = value.cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def in_ranges(rows: DataFrame, group: list[str], order: list[str], range_rows: int) -> DataFrame:
    """rows with `__part`, the number of a range of (group, order) that holds about range_rows of them; written to the shared folder.

    Ranges follow the rows, not the groups: a hot group lies in as many ranges as its rows need, small ones share one.
    """
    parts = max(1, -(-rows.count() // range_rows))
    return materialize(rows.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def positions(scores: DataFrame, group: list[str], value: str = "value", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds `position` to each row: 1 + number of the group's rows with a larger value; null values get the group's row count.

    Works on distinct values with counts, so ties of any number cost one row. These are cut into ranges of range_rows;
    ranks inside a range are added to the counts of the ranges above, so no task sorts more than a range. Exact.
    """
    values = materialize(scores.groupBy(*group, value).agg(F.count("*").alias("__n")), "values")
    ranged = in_ranges(values, group, [value], range_rows)
    discard(values)
    above = Window.partitionBy(*group).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranged.groupBy(*group, "__part").agg(F.sum("__n").alias("__rows"))
        .withColumn("__all", F.sum("__rows").over(Window.partitionBy(*group)))
        .withColumn("__above", F.coalesce(F.sum("__rows").over(above), F.lit(0)))
        .drop("__rows")
    )
    inside = Window.partitionBy(*group, "__part").orderBy(F.desc_nulls_last(value)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranged.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0))).alias("r")
        .join(parts.hint("merge").alias("p"), _same("r", "p", [*group, "__part"]))
        .withColumn("position", F.when(F.col(f"r.{value}").isNull(), F.col("__all")).otherwise(1 + F.col("__above") + F.col("__inside")))
        .select(*[F.col(f"r.{g}").alias(g) for g in [*group, value]], "position")
    )
    return scores.alias("s").hint("merge").join(ranked.hint("merge").alias("k"), _same("s", "k", [*group, value])).select("s.*", "k.position")


def _same(left: str, right: str, columns: list[str]) -> Column:
    """Equality of the columns of two aliased tables, null with null."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def weighted_median(pairs: Column) -> Column:
    """Lower weighted median of an array of struct(position, weight): the smallest position at which half the weight is reached."""
    half = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["weight"]) / 2
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("bigint").alias("median"))
    step = lambda h: lambda a, p: F.struct(
        (a["seen"] + p["weight"]).alias("seen"),
        F.when(a["median"].isNull() & (a["seen"] + p["weight"] >= h), p["position"]).otherwise(a["median"]).alias("median"),
    )
    return let(half, lambda h: F.aggregate(F.array_sort(pairs), start, step(h), lambda a: a["median"]))


def aggregate_ranks(items: DataFrame, group: list[str], item: str, weights: dict[str, float], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Median rank aggregation of the score columns named in `weights`.

    items has one row per (group, item). Every score is replaced by its position in the group; items are ordered by
    the weighted median position, then the mean position, then the item id.

    Result: group, item, median_position, mean_position, final_rank. Null and NaN scores take the last position of
    the group; infinities are ordinary extremes; ties share a position; a group of one item has rank 1; an empty table
    gives no rows; other columns are ignored.
    """
    names = list(weights)
    scores = items.select(
        *group, item,
        F.explode(F.array(*[F.struct(F.lit(n).alias("score_name"), finite(F.col(n)).alias("value")) for n in names])).alias("s"),
    ).select(*group, item, "s.*")
    ranked = positions(scores, [*group, "score_name"], range_rows=range_rows)
    # One position a score: fixed columns, which are aggregated in hash maps, and not lists, which would be sorted.
    each = {f"__p{k}": F.max(F.when(F.col("score_name") == n, F.col("position"))) for k, n in enumerate(names)}
    wide = ranked.groupBy(*group, item).agg(*[c.alias(k) for k, c in each.items()])
    pairs = F.array(*[F.struct(F.col(f"__p{k}").alias("position"), F.lit(float(weights[n])).alias("weight")) for k, n in enumerate(names)])
    total = reduce(Column.__add__, [F.col(k) for k in each])
    return wide.select(*group, item, weighted_median(pairs).alias("median_position"), (total / len(names)).alias("mean_position"))


def final_ranks(merged: DataFrame, group: list[str], item: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds final_rank (1..n per group) to aggregate_ranks: by median position, mean position, then item, numbered within ranges of that order."""
    order = ["median_position", "mean_position", item]
    ranged = in_ranges(materialize(merged, "merged"), group, order, range_rows)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = ranged.withColumn("__row", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order)))
    joined = within.alias("r").join(parts.hint("merge").alias("p"), _same("r", "p", [*group, "__part"]))
    return joined.select("r.*", (F.col("__before") + F.col("__row")).alias("final_rank")).drop("__part", "__row")


FEATURES = ("bm25", "bm25_plus", "tfidf_cosine", "title_ngram", "description_overlap", "dense_cosine")


def candidate_scores(candidates: DataFrame, reranked: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row per distinct (query_id, issue_id) of candidates, with seed_score and the features of its latest rerank row.

    Of several rows of a pair the latest scored_at counts (null times are oldest; of equal times the largest features,
    compared in order). Of several seed scores of a pair the largest counts. A candidate without rerank row has null
    features; a rerank row without candidate is not used.
    """
    pairs = candidates.groupBy("query_id", "issue_id").agg(F.max(finite(F.col("seed_score"))).alias("seed_score"))
    latest = (
        reranked.groupBy("query_id", "issue_id")
        .agg(F.max(F.struct("scored_at", *[finite(F.try_element_at("feature_scores", F.lit(f))).alias(f) for f in features])).alias("r"))
        .select("query_id", "issue_id", *[F.col(f"r.{f}").alias(f) for f in features])
    )
    return pairs.join(latest, ["query_id", "issue_id"], "left")


def best_by_mean(merged: DataFrame, group: list[str], item: str) -> DataFrame:
    """Per group the item of the lowest mean position (then median position, then id); partial aggregation, no sort."""
    first = F.min(F.struct("mean_position", "median_position", item)).alias("b")
    return merged.groupBy(*group).agg(first).select(*group, F.col(f"b.{item}").alias(item))
