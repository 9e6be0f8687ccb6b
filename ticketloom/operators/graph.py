"""Graph and metadata evidence: link edges, metadata seeds, two-hop propagation, neighbour context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.operators.candidates import top_pool
from ticketloom.storage import materialize

LINKED, DUPLICATE = 0.7, 1.0
DECAY, SECOND_DECAY, SEED_NODES = 0.65, 0.28, 50


def link_edges(prepared: DataFrame) -> DataFrame:
    """Undirected edges in both directions (src, dst, w) between records of the corpus; the larger weight of several links counts."""
    ids = prepared.select(F.col("issue_id").alias("dst"))
    raw = prepared.select(F.col("issue_id").alias("src"), F.explode("linked_issue_ids").alias("dst"), F.lit(LINKED).alias("w")).unionByName(
        prepared.select(F.col("issue_id").alias("src"), F.explode("duplicate_issue_ids").alias("dst"), F.lit(DUPLICATE).alias("w")))
    inside = raw.join(ids, "dst", "left_semi").select("src", "dst", "w")
    return inside.unionByName(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


#: Metadata values with the weight a shared one has: single ones, which many records share, and lists.
SINGLE = {"project_key": 0.14, "issue_type": 0.10, "priority": 0.07, "status": 0.05}
LISTS = {"component_terms": 0.20, "affected_version_terms": 0.12, "fix_version_terms": 0.12}


def _single_keys() -> list[Column]:
    return [F.when(F.col(c) != "", F.array(F.struct(F.concat(F.lit(c + "="), F.col(c)).alias("key"), F.lit(w).alias("w")))) for c, w in SINGLE.items()]


def _list_keys() -> list[Column]:
    def keys(c: str, w: float) -> Column:
        return F.transform(F.array_distinct(c), lambda x: F.struct(F.concat(F.lit(c + "="), x).alias("key"), F.lit(w).alias("w")))

    return [keys(c, w) for c, w in LISTS.items()]


def _exploded(rows: DataFrame, keys: list[Column], *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.flatten(F.array_compact(F.array(*keys)))).alias("m")).select(*keep, "m.key", "m.w")


def metadata_keys(prepared: DataFrame) -> DataFrame:
    """(issue_id, key, w): every metadata value of a record with the weight a shared one has."""
    return _exploded(prepared, _single_keys() + _list_keys(), "issue_id")


def metadata_seeds(prepared: DataFrame, queries: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(qid, issue_id, seed): the weights of the metadata values a query shares with each record, 1 at most; one join, one aggregate.

    asked: the prepared queries (issue_id = qid) if they are not records of the corpus.
    """
    keys = metadata_keys(prepared)
    own = metadata_keys(prepared if asked is None else asked).join(queries.select(F.col("qid").alias("issue_id")), "issue_id").select(F.col("issue_id").alias("qid"), "key", "w")
    return own.join(keys.select("issue_id", "key"), "key").groupBy("qid", "issue_id").agg(F.least(F.lit(1.0), F.round(F.sum("w"), 9)).alias("seed"))


def metadata_of(pairs: DataFrame, prepared: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(qid, issue_id, seed): metadata_seeds() of given pairs; those that share nothing have 0."""
    side = lambda df, key, p: df.select(F.col("issue_id").alias(key), *[F.col(c).alias(p + c) for c in (*SINGLE, *LISTS)])
    both = pairs.select("qid", "issue_id").join(side(prepared if asked is None else asked, "qid", "q_"), "qid").join(side(prepared, "issue_id", "c_"), "issue_id")
    total = F.lit(0.0)
    for c, w in SINGLE.items():
        total = total + F.lit(w) * T.binary_match(F.col("q_" + c), F.col("c_" + c))
    for c, w in LISTS.items():
        total = total + F.lit(w) * F.coalesce(F.size(F.array_intersect("q_" + c, "c_" + c)), F.lit(0))
    return both.select("qid", "issue_id", F.least(F.lit(1.0), F.round(total, 9)).alias("seed"))


def metadata_top(prepared: DataFrame, queries: DataFrame, pool: int, asked: DataFrame | None = None) -> DataFrame:
    """(qid, issue_id, seed): the `pool` best pairs of metadata_seeds() per query, without forming the others.

    Single values (a type, a status) are shared by large parts of the corpus, but there are few combinations of them: a
    query meets the combinations, and of each only the first ids that could be among its best. Lists are joined by value.
    """
    own = (prepared if asked is None else asked).join(queries.select(F.col("qid").alias("issue_id")), "issue_id").withColumnRenamed("issue_id", "qid")
    combination = F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in SINGLE]).alias("combination")
    records = prepared.select("issue_id", combination, *SINGLE, *LISTS)
    kinds = records.groupBy("combination").agg(*[F.first(c).alias(c) for c in SINGLE])
    singles = _exploded(own, _single_keys(), "qid").join(_exploded(kinds, _single_keys(), "combination").drop("w"), "key").groupBy("qid", "combination").agg(F.sum("w").alias("single"))
    first = Window.partitionBy("combination").orderBy("issue_id")
    members = records.select("combination", "issue_id").withColumn("at", F.row_number().over(first)).where(F.col("at") <= pool)
    sizes = members.groupBy("combination").agg(F.count("*").alias("n"))
    # Of combinations in descending order those are expanded before which fewer than `pool` records stand; equal ones together.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc(F.round("single", 6))).rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    level = Window.partitionBy("qid", F.round("single", 6))
    near = singles.join(sizes, "combination").withColumn("upto", before).withColumn("here", F.sum("n").over(level)).where(F.col("upto") - F.col("here") < pool)
    plain = near.join(members, "combination").select("qid", "issue_id", F.col("single").alias("seed"))
    listed = _exploded(own, _list_keys(), "qid").join(_exploded(records, _list_keys(), "issue_id", "combination").drop("w"), "key").groupBy("qid", "issue_id", "combination").agg(F.sum("w").alias("lists"))
    listed = listed.join(singles, ["qid", "combination"], "left").select("qid", "issue_id", (F.col("lists") + F.coalesce("single", F.lit(0.0))).alias("seed"))
    best = plain.unionByName(listed).groupBy("qid", "issue_id").agg(F.least(F.lit(1.0), F.round(F.max("seed"), 9)).alias("seed"))
    return top_pool(best, pool).select("qid", "issue_id", "seed")


def propagate(seeds: DataFrame, edges: DataFrame, nodes: int = SEED_NODES, exclude_query_edges: bool = False) -> DataFrame:
    """(qid, issue_id, seed): from each query's best seeds over one and two edges; the second never leads back to the seed."""
    top = top_pool(seeds, nodes).select("qid", F.col("issue_id").alias("a"), F.col("seed").alias("s"))
    e1 = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("w1"))
    e2 = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("w").alias("w2"))
    one = top.join(e1, "a")
    if exclude_query_edges:
        one = one.where("a <> qid AND b <> qid")
    one = one.withColumn("h", F.col("s") * F.col("w1") * DECAY)
    two = one.join(e2, "b").where("c <> a")
    both = (
        top.select("qid", F.col("a").alias("issue_id"), F.col("s").alias("seed"))
        .unionByName(one.select("qid", F.col("b").alias("issue_id"), F.col("h").alias("seed")))
        .unionByName(two.select("qid", F.col("c").alias("issue_id"), (F.col("h") * F.col("w2") * SECOND_DECAY).alias("seed")))
    )
    return both.groupBy("qid", "issue_id").agg(F.sum("seed").alias("seed"))


def graph_candidates(base: DataFrame, prepared: DataFrame, queries: DataFrame, edges: DataFrame, pool: int, exclude_query_edges: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """Seeds from a fused list and shared metadata, plus what propagates from the best of them, cut to the pool.

    A record with nothing but metadata is in the pool only if it is among the best by metadata, so the other such
    pairs are not formed.
    """
    ranked = base.select("qid", "issue_id", (1 / (8 + F.col("rank")) + T.clamp(F.col("seed"))).alias("seed"))
    pairs = ranked.select("qid", "issue_id").unionByName(metadata_top(prepared, queries, max(pool, SEED_NODES), asked).select("qid", "issue_id")).distinct()
    seeds = ranked.unionByName(metadata_of(pairs, prepared, asked)).groupBy("qid", "issue_id").agg(F.sum("seed").alias("seed"))
    seeds = materialize(seeds, "seeds")
    spread = materialize(propagate(seeds, edges, exclude_query_edges=exclude_query_edges), "spread")
    reached = metadata_of(spread.join(seeds, ["qid", "issue_id"], "left_anti"), prepared, asked)
    combined = seeds.unionByName(reached).unionByName(spread).groupBy("qid", "issue_id").agg(F.sum("seed").alias("seed"))
    return top_pool(combined, pool)


def graph_context(pairs: DataFrame, prepared: DataFrame, edges: DataFrame, exclude_query_edges: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """(qid, issue_id, graph_context): how well a candidate's neighbours fit the query, weighted by the edges, 1 at most; candidates without neighbours are absent.

    With exclude_query_edges the query itself is no neighbour, so a link that is to be found is no evidence for itself.
    asked: the prepared queries (issue_id = qid) if they are not records of the corpus.
    """
    cols = ("project_key", "issue_type", "component_terms", "affected_version_terms", "fix_version_terms", "title_ngrams")
    q = (prepared if asked is None else asked).select(F.col("issue_id").alias("qid"), *[F.col(c).alias(f"q_{c}") for c in cols])
    n = prepared.select(F.col("issue_id").alias("dst"), *[F.col(c).alias(f"n_{c}") for c in cols])
    j = lambda c: T.jaccard(F.col(f"q_{c}"), F.col(f"n_{c}"))
    support = (
        0.25 * T.binary_match(F.col("q_project_key"), F.col("n_project_key")) + 0.35 * j("component_terms") + 0.15 * j("affected_version_terms")
        + 0.15 * j("fix_version_terms") + 0.10 * T.binary_match(F.col("q_issue_type"), F.col("n_issue_type")) + 0.12 * j("title_ngrams")
    )
    near = pairs.select("qid", "issue_id").join(edges.withColumnRenamed("src", "issue_id"), "issue_id")
    if exclude_query_edges:
        near = near.where("dst <> qid AND issue_id <> qid")
    joined = near.join(q, "qid").join(n, "dst")
    return joined.groupBy("qid", "issue_id").agg(F.least(F.lit(1.0), F.sum(support * F.col("w")) / F.sum("w")).alias("graph_context"))
