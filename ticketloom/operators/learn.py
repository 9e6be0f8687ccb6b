"""Supervised pair models: training pairs with hard negatives, logistic regression, a small network, splits and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.storage import discard, materialize

NEGATIVES_PER_POSITIVE = 4
#: Candidates of a query among which its negatives are looked for: this many, or 4 for each positive where that is more.
TRAINING_POOL, POOL_PER_POSITIVE = 80, 4
#: Rows whose activations are held at once when the loss over all training pairs is computed.
LOSS_ROWS = 50_000


def related_pairs(prepared: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    """(qid, issue_id): the linked and duplicate records of every record that are in the corpus; holdout (issue_id) on neither side."""
    ids = prepared.select("issue_id")
    if holdout is not None:
        ids = ids.join(holdout.select("issue_id"), "issue_id", "left_anti")
    related = prepared.select(F.col("issue_id").alias("qid"), F.explode(F.array_union("linked_issue_ids", "duplicate_issue_ids")).alias("issue_id")).where("qid <> issue_id")
    return related.join(ids, "issue_id", "left_semi").join(ids.withColumnRenamed("issue_id", "qid"), "qid", "left_semi").select("qid", "issue_id").distinct()


def pool_sizes(related: DataFrame) -> DataFrame:
    """(qid, pool): how many candidates of each query its negatives are looked for among."""
    return related.groupBy("qid").agg(F.greatest(F.lit(TRAINING_POOL), F.count("*") * POOL_PER_POSITIVE).alias("pool"))


def training_pairs(prepared: DataFrame, candidates: DataFrame, per_positive: int = NEGATIVES_PER_POSITIVE, holdout: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """(qid, issue_id, seed, label): every labelled query's related records (label 1) and its hardest other candidates (label 0).

    Negatives are the query's candidates by rank, then the corpus by ascending id, per_positive for each positive.
    holdout (issue_id): records that appear on neither side. Positives outside the candidates have seed 0; with seeds
    (qid, issue_id, seed), those outside of it.
    """
    ids = prepared.select("issue_id")
    if holdout is not None:
        ids = ids.join(holdout.select("issue_id"), "issue_id", "left_anti")
    related = related_pairs(prepared, holdout)
    need = related.groupBy("qid").agg((F.count("*") * per_positive).alias("need"))
    pool = candidates.select("qid", "issue_id", "seed", "rank")
    if holdout is not None:
        pool = pool.join(ids, "issue_id", "left_semi")
    known = (candidates if seeds is None else seeds).select("qid", "issue_id", "seed")
    positive = related.join(known, ["qid", "issue_id"], "left").select("qid", "issue_id", F.coalesce("seed", F.lit(0.0)).alias("seed"), F.lit(1).alias("label"))
    hard = pool.join(need, "qid").where("qid <> issue_id")
    if holdout is None:
        # Of the first candidates only the query itself and its positives are none of its negatives, so no later one is needed.
        hard = hard.where(F.col("rank") <= F.col("need") + F.col("need") / per_positive + 1)
    hard = hard.join(related, ["qid", "issue_id"], "left_anti")
    order = Window.partitionBy("qid").orderBy("rank")
    hard = hard.withColumn("place", F.row_number().over(order)).where("place <= need")
    hard = materialize(hard, "hard")
    short = need.join(hard.groupBy("qid").agg(F.count("*").alias("have")), "qid", "left").withColumn("missing", F.col("need") - F.coalesce("have", F.lit(0))).where("missing > 0")
    # A gap is filled from the first ids of the corpus: a query looks at as many places as it lacks, and as many more as
    # may be taken there (its positives, its negatives so far, itself). Places meet ids in an equi-join.
    short = short.withColumn("last", F.col("need") + (F.col("need") / per_positive).cast("bigint") + 1)
    most = short.agg(F.max("last")).first()[0] or 0
    first_ids = ids.orderBy("issue_id").limit(int(most)).withColumn("at", F.row_number().over(Window.orderBy("issue_id")))
    fill = short.select("qid", "missing", F.explode(F.sequence(F.lit(1), F.col("last").cast("int"))).alias("at")).join(first_ids, "at").where("qid <> issue_id")
    fill = fill.join(related, ["qid", "issue_id"], "left_anti").join(hard.select("qid", "issue_id"), ["qid", "issue_id"], "left_anti")
    fill = fill.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("issue_id"))).where("place <= missing")
    return positive.unionByName(hard.select("qid", "issue_id", "seed", F.lit(0).alias("label"))).unionByName(fill.select("qid", "issue_id", F.lit(0.0).alias("seed"), F.lit(0).alias("label")))


def split_column(seed: int = 13, validation: float = 0.15, test: float = 0.15):
    """'train', 'validation' or 'test' by a hash of the pair: stable under any partitioning."""
    u = F.pmod(F.xxhash64("qid", "issue_id", F.lit(seed)), F.lit(10_000)) / 10_000
    return F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train")


@dataclass(frozen=True)
class LogisticModel:
    weights: dict[str, float]
    bias: float


@dataclass(frozen=True)
class MlpModel:
    names: tuple[str, ...]
    hidden: list[list[float]]
    hidden_bias: list[float]
    out: list[float]
    out_bias: float
    epochs: list[dict[str, float]] = field(default_factory=list)


def fit_logistic(examples: DataFrame, names: Sequence[str], l2: float = 0.01, epochs: int = 300) -> LogisticModel:
    """Logistic regression with the positives weighted by negatives / positives, fitted by Spark's distributed optimiser.

    Without examples the bias is -1.5, with one class only the model is flat at 0.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n, pos = examples.agg(F.count("*"), F.sum("label")).first()
    if not n:
        return LogisticModel(dict.fromkeys(names, 0.0), -1.5)
    if pos in (0, n):
        return LogisticModel(dict.fromkeys(names, 0.0), 0.0)
    weighted = examples.withColumn("w", F.when(F.col("label") == 1, (n - pos) / pos).otherwise(1.0))
    data = VectorAssembler(inputCols=list(names), outputCol="x").transform(weighted).select("x", F.col("label").cast("double").alias("y"), "w")
    # The penalty is per example there and per unit of weight here.
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=epochs, regParam=l2 * n / (2 * (n - pos)), standardization=False).fit(data)
    return LogisticModel(dict(zip(names, map(float, model.coefficients))), float(model.intercept))


def train_mlp(x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, hidden: int = 32, rate: float = 0.03, epochs: int = 300, l2: float = 0.001, seed: int = 13, patience: int = 35, least: int = 40, batch: int = 32) -> tuple[list[np.ndarray], list[dict[str, float]]]:
    """One hidden layer of rectified units, sigmoid output, stochastic gradient descent in small batches; the weights of the best validation loss."""
    rng = np.random.default_rng(seed)
    w1, b1, w2, b2 = rng.uniform(-0.08, 0.08, (x.shape[1], hidden)), np.zeros(hidden), rng.uniform(-0.08, 0.08, hidden), 0.0
    pos = max(1, int(y.sum()))
    weight = np.where(y == 1, (len(y) - pos) / pos, 1.0)

    def loss(a: np.ndarray, b: np.ndarray) -> float:
        total = 0.0
        for k in range(0, len(b), LOSS_ROWS):
            p = np.clip(1 / (1 + np.exp(-np.clip(np.maximum(a[k:k + LOSS_ROWS] @ w1 + b1, 0) @ w2 + b2, -30, 30))), 1e-9, 1 - 1e-9)
            total -= float((b[k:k + LOSS_ROWS] * np.log(p) + (1 - b[k:k + LOSS_ROWS]) * np.log(1 - p)).sum())
        return total / len(b) if len(b) else 0.0

    best, kept, waited, curve = np.inf, None, 0, []
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            at = order[k:k + batch]
            h = np.maximum(x[at] @ w1 + b1, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y[at]) * weight[at] / len(at)
            dh = np.outer(d, w2) * (h > 0)
            w2 = w2 - rate * (h.T @ d + l2 * w2)
            b2 = b2 - rate * d.sum()
            w1 = w1 - rate * (x[at].T @ dh + l2 * w1)
            b1 = b1 - rate * dh.sum(0)
        now = loss(vx, vy) if len(vy) else loss(x, y)
        curve.append({"epoch": epoch + 1, "train_loss": loss(x, y), "validation_loss": now})
        if now < best - 1e-5:
            best, kept, waited = now, [w1.copy(), b1.copy(), w2.copy(), np.array([b2])], 0
        else:
            waited += 1
            if epoch + 1 >= least and waited >= patience:
                break
    return kept or [w1, b1, w2, np.array([b2])], curve


def fit_mlp(examples: DataFrame, names: Sequence[str], **options) -> MlpModel:
    """Fits the network in one task (sequential by nature) on all training pairs, which it reads in batches into one array; without examples (but those held out for tests) the bias is -1."""
    rows = examples.withColumn("part", split_column()).where("part <> 'test'").select("qid", "issue_id", F.col("label").cast("double").alias("label"), (F.col("part") == "train").alias("train"), *[F.col(c).cast("double").alias(c) for c in names])
    rows = materialize(rows, "examples")
    n, n_train = rows.agg(F.count("*"), F.count_if("train")).first()
    if not n:
        return MlpModel(tuple(names), [], [], [], -1.0)

    def fit(batches):
        x, y, at = np.empty((n, len(names))), np.empty(n), 0
        for batch in batches:
            y[at:at + len(batch)] = batch["label"]
            for k, name in enumerate(names):
                x[at:at + len(batch), k] = batch[name]
            at += len(batch)
        (w1, b1, w2, b2), curve = train_mlp(x[:n_train], y[:n_train], x[n_train:], y[n_train:], **options)
        yield pd.DataFrame({"hidden": [w1.T.tolist()], "hidden_bias": [b1.tolist()], "out": [w2.tolist()], "out_bias": [float(b2[0])], "train_loss": [[c["train_loss"] for c in curve]], "validation_loss": [[c["validation_loss"] for c in curve]]})

    schema = "hidden array<array<double>>, hidden_bias array<double>, out array<double>, out_bias double, train_loss array<double>, validation_loss array<double>"
    got = rows.repartition(1).sortWithinPartitions(F.desc("train"), "qid", "issue_id").select("label", *names).mapInPandas(fit, schema).first()
    discard(rows)
    curve = [{"epoch": k + 1, "train_loss": a, "validation_loss": b} for k, (a, b) in enumerate(zip(got.train_loss, got.validation_loss))]
    return MlpModel(tuple(names), got.hidden, got.hidden_bias, got.out, got.out_bias, curve)


def diagnostics(model: MlpModel, spark) -> DataFrame:
    """(epoch, train_loss, validation_loss) of a fitted network, ready to be written as JSON or CSV."""
    return spark.createDataFrame(pd.DataFrame(model.epochs or {"epoch": [], "train_loss": [], "validation_loss": []}), "epoch long, train_loss double, validation_loss double")


def write_diagnostics(model: MlpModel, spark, path: str) -> None:
    """The loss curve as one JSON and one CSV file under path."""
    curve = diagnostics(model, spark).coalesce(1)
    curve.write.mode("overwrite").json(path + "/curve.json")
    curve.write.mode("overwrite").option("header", True).csv(path + "/curve.csv")
