"""Mixing sources to target weights by the cube method of balanced sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.storage import is_written, materialize

#: Documents that one flight moves in one task; larger sources are cut into blocks, whose left-over documents (at most
#: two a block) fly again together.
BLOCK_ROWS = 20_000
#: Share of a source's tokens that the landing may miss before single documents are used once more or once less.
TOLERANCE = 0.001
_EPS = 1e-9


def plan_sources(sizes: DataFrame, weights: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per weighted source: target_weight, max_repeats, n_docs, n_tokens and `uses`, how often its tokens are to be used.

    sizes has one row per source with documents (n_docs, n_tokens), weights one per weighted source (identical rows
    count once; the largest weight and cap of a source count). Weights are normed over the sources that have tokens.
    Without total_tokens the total is the largest at which every such source reaches its share within its cap, so all
    shares are met. With it, sources at their cap give the rest of the total to the others in proportion.
    """
    w = weights.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    joined = w.join(sizes, "source", "left")  # one row per weighted source: as many as the weights table names
    rows = joined.select("source", F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("r"), F.coalesce("n_docs", F.lit(0)).alias("d"), F.coalesce("n_tokens", F.lit(0)).alias("t")).toPandas()
    usable = (rows.w > 0) & (rows.r > 0) & (rows.t > 0)
    uses = np.zeros(len(rows))
    if usable.any():
        u = rows[usable]
        share = (u.w / u.w.sum()).to_numpy()
        most = (u.t * u.r).to_numpy(float)
        if total_tokens is None:
            given = share * (most / share).min()
        else:
            given, open_ = np.zeros(len(u)), np.ones(len(u), bool)
            for _ in range(len(u)):
                rest = total_tokens - given[~open_].sum()
                given[open_] = rest * share[open_] / share[open_].sum()
                over = open_ & (given > most)
                given = np.minimum(given, most)
                if not over.any() or not (open_ := open_ & ~over).any():
                    break
        uses[usable.to_numpy()] = np.minimum(given / u.t.to_numpy(float), u.r.to_numpy(float))
    rows["uses"] = uses
    plan = rows.rename(columns={"w": "target_weight", "r": "max_repeats", "d": "n_docs", "t": "n_tokens"})
    return sizes.sparkSession.createDataFrame(plan.astype({"source": object, "max_repeats": int}), "source string, target_weight double, max_repeats int, n_docs long, n_tokens long, uses double")


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube flight: moves pi through the null space of (1, size) until at most two entries are strictly between 0 and 1.

    Each step takes three fractional entries and a direction that changes neither their number nor their size, and goes
    to the border one way or the other with probabilities that keep every expectation.
    """
    pi = pi.astype(float).copy()
    todo = np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS)).tolist()[::-1]
    draws = rng.random(len(todo) + 1)
    held: list[int] = []
    k = 0
    while True:
        while len(held) < 3 and todo:
            held.append(todo.pop())
        if len(held) < 3:
            break
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u[0] == u[1] == u[2] == 0:
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for x, d in zip(held, u):
            if d > 0:
                up, down = min(up, (1 - pi[x]) / d), min(down, pi[x] / d)
            elif d < 0:
                up, down = min(up, -pi[x] / d), min(down, (pi[x] - 1) / d)
        step = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        for x, d in zip(held, u):
            pi[x] += step * d
        held = [x for x in held if _EPS < pi[x] < 1 - _EPS]
    pi[pi <= _EPS] = 0
    pi[pi >= 1 - _EPS] = 1
    return pi


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The at most two fractional entries that a flight leaves, set to 0 or 1 so that the size changes least (then the number)."""
    pi = pi.copy()
    left = np.flatnonzero((pi > 0) & (pi < 1))
    best = min(
        (np.array([(bits >> k) & 1 for k in range(len(left))], float) for bits in range(1 << len(left))),
        key=lambda x: (abs(float(((x - pi[left]) * size[left]).sum())), abs(float((x - pi[left]).sum()))),
    )
    pi[left] = best
    return pi


def even_out(uses: np.ndarray, size: np.ndarray, cap: np.ndarray, total: float, rounds: int = 500, tolerance: float = TOLERANCE) -> np.ndarray:
    """Changes how often single documents are used, within 0..cap, until their size is within tolerance of `total` or no change helps.

    The landing of a long document can miss the total by its length. A change uses one document once more, one once
    less, or both; the best of all is taken each time, so few documents leave their drawn numbers, and none where the
    flight has met the total already.
    """
    uses = uses.copy()
    none = np.array([-1])  # stands for no document, of size 0
    for _ in range(rounds):
        miss = total - float((uses * size).sum())
        if abs(miss) <= tolerance * total:
            break
        more, less = np.concatenate([none, np.flatnonzero(uses < cap)]), np.concatenate([none, np.flatnonzero(uses > 0)])
        more_size, less_size = np.where(more < 0, 0, size[more]), np.where(less < 0, 0, size[less])
        order = np.argsort(more_size, kind="stable")
        more, more_size = more[order], more_size[order]
        at = np.searchsorted(more_size, less_size + miss)
        pairs = np.concatenate([np.clip(at - 1, 0, len(more) - 1), np.clip(at, 0, len(more) - 1)])
        left = np.abs(miss - (more_size[pairs] - np.tile(less_size, 2)))
        best = int(left.argmin())
        if left[best] >= abs(miss):
            break
        for k, d in ((more[pairs[best]], 1), (np.tile(less, 2)[best], -1)):
            if k >= 0:
                uses[k] += d
    return uses


_ITEM = "doc_id long, source string, n_tokens long, pi double, whole int, cap int"


def _fly(last: bool, seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        rng = np.random.default_rng([seed, int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFF, len(pdf)])
        size, wanted, whole = pdf["n_tokens"].to_numpy(float), pdf["pi"].to_numpy(), pdf["whole"].to_numpy()
        pi = flight(wanted, size, rng)
        if last:
            pi = even_out(landing(pi, size) + whole, size, pdf["cap"].to_numpy(), float(((wanted + whole) * size).sum())) - whole
        pdf["pi"] = pi
        return pdf[["doc_id", "source", "n_tokens", "pi", "whole", "cap"]]

    return run


def balanced_sample(items: DataFrame, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """items (doc_id, source, n_tokens, pi, whole, cap) with pi set to a whole number: a balanced sample in which each source keeps its sums of pi and pi * n_tokens but for the landing.

    A document is to be used whole + pi times, cap times at most. Sources larger than block_rows fly in blocks; what the
    blocks leave (at most two documents each) flies again, so each round holds 2 / block_rows of the documents of the
    one before. The last flight lands and is evened out, which may use one of its documents once more or less.
    """
    decided = None
    while True:
        sizes = items.groupBy("source").agg(F.count("*").alias("n"))
        largest = sizes.agg(F.max("n")).first()[0] or 0
        blocks = sizes.select("source", F.ceil(F.col("n") / block_rows).alias("blocks"))
        # One row per weighted source: as many as the weights table names, whatever the documents are.
        placed = items.join(F.broadcast(blocks), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks"))).drop("blocks")
        last = largest <= block_rows
        flown = placed.groupBy("source", "block").applyInPandas(_fly(last, seed), _ITEM)
        if last:
            return flown if decided is None else decided.unionByName(flown)
        flown = materialize(flown, "flight")
        settled = flown.where("pi = 0 OR pi = 1")
        decided = settled if decided is None else decided.unionByName(settled)
        items = flown.where("pi > 0 AND pi < 1")


def mix(counted: DataFrame, weights: DataFrame, total_tokens: int | None = None, seed: int = 7, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(chosen, plan): chosen has doc_id, source, n_tokens, repeats (1..max_repeats) of every document used.

    counted has doc_id, source, n_tokens. Each document of a source is used floor(uses) times, and once more for those
    that the cube sample takes with probability uses - floor(uses); the landing may change single documents by one, so
    that a source of few long documents meets its tokens as well. Documents without source, of a source without weight,
    or without tokens are not used (a text of no tokens adds to no share). A weighted source without documents is in
    the plan with 0 uses. Empty tables give no rows.
    """
    counted = counted if is_written(counted) else materialize(counted, "counted")
    sizes = counted.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    plan = plan_sources(sizes, weights, total_tokens)
    uses = plan.where("uses > 0").select("source", F.floor("uses").cast("int").alias("whole"), (F.col("uses") - F.floor("uses")).alias("pi"), F.col("max_repeats").alias("cap"))
    items = counted.where(F.col("n_tokens") > 0).join(F.broadcast(uses), "source")  # one row per weighted source
    drawn = balanced_sample(items.select("doc_id", "source", "n_tokens", "pi", "whole", "cap"), seed, block_rows)
    chosen = drawn.select("doc_id", "source", "n_tokens", (F.col("whole") + F.round("pi")).cast("int").alias("repeats")).where("repeats > 0")
    return chosen, plan


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of the plan: target_weight, reached_share (of all tokens drawn), n_drawn, tokens_drawn, most_repeats, max_repeats."""
    drawn = chosen.groupBy("source").agg(
        F.count("*").alias("n_drawn"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens_drawn"), F.max("repeats").alias("most_repeats"))
    drawn = materialize(drawn, "drawn")
    total = drawn.agg(F.sum("tokens_drawn")).first()[0] or 1
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return plan.join(drawn, "source", "left").select(
        "source", "target_weight", F.round(F.coalesce("tokens_drawn", F.lit(0)) / total, 6).alias("reached_share"), "max_repeats", zero("n_drawn"), zero("tokens_drawn"), zero("most_repeats"))


def kept_promises(chosen: DataFrame, plan: DataFrame, within: float = 0.01) -> DataFrame:
    """Per source of the plan that has tokens: cap_kept, and share_met: its tokens are those planned, up to `within` of them or its shortest document."""
    drawn = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most"), F.min("n_tokens").alias("shortest"))
    wanted = F.col("uses") * F.col("n_tokens")
    joined = plan.where("n_tokens > 0 AND max_repeats > 0 AND target_weight > 0").join(drawn, "source", "left")
    return joined.select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("cap_kept"),
                         (F.abs(F.coalesce("tokens", F.lit(0)) - wanted) <= F.greatest(wanted * within, F.coalesce("shortest", "n_tokens"))).alias("share_met"))
