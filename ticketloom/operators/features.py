"""Pair features: one double column per feature, rounded to 4 decimals where the rerankers expect it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import text as T

STANDARD = ("bm25", "bm25_plus", "tfidf_cosine", "title_ngram", "description_overlap", "candidate_seed")
ENGINEERED = (
    "bm25", "bm25_plus", "tfidf_cosine", "title_overlap", "title_ngram", "description_overlap", "term_overlap", "component_overlap",
    "affected_version_overlap", "fix_version_overlap", "project_match", "issue_type_match", "priority_match", "status_match", "length_ratio", "candidate_seed",
)
NEURAL = (*ENGINEERED, "dense_cosine")

_SIDE = ("issue_key", "project_key", "issue_type", "priority", "status", "weighted_terms", "title_terms", "description_terms", "title_ngrams",
         "component_terms", "affected_version_terms", "fix_version_terms", "document_length")


def _r4(c: Column) -> Column:
    return F.round(c, 4)


def pair_rows(candidates: DataFrame, lexical: DataFrame | None, prepared: DataFrame, query_side: DataFrame | None = None) -> DataFrame:
    """candidates (qid, issue_id, seed, rank) with their raw lexical scores (0 where no term is shared) and both records' sets, as q_* and c_*.

    lexical: the scores of the pairs; None if the candidates carry them.
    query_side: the prepared queries (issue_id = qid) if they are not records of the corpus.
    """
    side = lambda df, p: df.select(F.col("issue_id").alias("qid" if p == "q" else "issue_id"), *[F.col(c).alias(f"{p}_{c}") for c in _SIDE])
    joined = candidates
    if lexical is not None:
        scores = lexical.select("qid", "issue_id", "bm25", "bm25_plus", "tfidf_cosine")
        joined = candidates.join(scores, ["qid", "issue_id"], "left").fillna(0.0, ["bm25", "bm25_plus", "tfidf_cosine"])
    return joined.join(side(query_side if query_side is not None else prepared, "q"), "qid").join(side(prepared, "c"), "issue_id")


def other_issue(pairs: DataFrame, by_id: bool = True) -> DataFrame:
    """Pairs whose records are not the same issue: they differ in key where the query has one, and in id (the qid of a new record is no id)."""
    same_key = F.coalesce((F.col("q_issue_key") == F.col("c_issue_key")) & (F.col("q_issue_key") != ""), F.lit(False))
    return pairs.where(~same_key & (F.col("qid") != F.col("issue_id")) if by_id else ~same_key)


def standard(pairs: DataFrame) -> DataFrame:
    """The six standard features; keeps the other columns."""
    return pairs.withColumns({
        "bm25": _r4(T.squash(F.col("bm25"))), "bm25_plus": _r4(T.squash(F.col("bm25_plus"))), "tfidf_cosine": _r4(F.col("tfidf_cosine")),
        "title_ngram": _r4(T.jaccard(F.col("q_title_ngrams"), F.col("c_title_ngrams"))),
        "description_overlap": _r4(T.jaccard(F.col("q_description_terms"), F.col("c_description_terms"))),
        "candidate_seed": _r4(T.normalize_seed(F.col("seed"))),
    })


def standard_compared(pairs: DataFrame) -> DataFrame:
    """standard() of pairs that carry title_jaccard and description_jaccard in place of both records' sets."""
    return pairs.withColumns({
        "bm25": _r4(T.squash(F.col("bm25"))), "bm25_plus": _r4(T.squash(F.col("bm25_plus"))), "tfidf_cosine": _r4(F.col("tfidf_cosine")),
        "title_ngram": _r4(F.col("title_jaccard")), "description_overlap": _r4(F.col("description_jaccard")), "candidate_seed": _r4(T.normalize_seed(F.col("seed"))),
    })


def _set_overlaps() -> dict[str, Column]:
    return {f"{n}_overlap": _r4(T.jaccard(F.col(f"q_{n}_terms"), F.col(f"c_{n}_terms"))) for n in ("component", "affected_version", "fix_version")}


def _matches() -> dict[str, Column]:
    return {f"{n}_match": T.binary_match(F.col(f"q_{c}"), F.col(f"c_{c}")) for n, c in (("project", "project_key"), ("issue_type", "issue_type"), ("priority", "priority"), ("status", "status"))}


def engineered(pairs: DataFrame) -> DataFrame:
    """Standard features plus overlaps, matches and the length ratio (16 in all)."""
    return standard(pairs).withColumns({
        "title_overlap": _r4(T.jaccard(F.col("q_title_terms"), F.col("c_title_terms"))),
        "term_overlap": _r4(T.overlap_ratio(F.array_distinct("q_weighted_terms"), F.array_distinct("c_weighted_terms"))),
        **_set_overlaps(), **_matches(),
        "length_ratio": _r4(T.length_ratio(F.col("q_document_length"), F.col("c_document_length"))),
    })


def with_cosine(pairs: DataFrame, vectors: DataFrame, name: str = "dense_cosine", query_vectors: DataFrame | None = None) -> DataFrame:
    """Adds a cosine column from vectors (issue_id, vector): dense_cosine = max(0, cos), any other name = (cos + 1) / 2; 0 if a side has no vector."""
    sized = lambda df, key, p: df.select(F.col("issue_id").alias(key), F.col("vector").alias(p), F.sqrt(T.dot(F.col("vector"), F.col("vector"))).alias(p + "n"))
    joined = pairs.join(sized(vectors if query_vectors is None else query_vectors, "qid", "__q"), "qid", "left").join(sized(vectors, "issue_id", "__c"), "issue_id", "left")
    length = F.col("__qn") * F.col("__cn")
    cos = F.coalesce(F.when(length > 0, T.dot(F.col("__q"), F.col("__c")) / length), F.lit(0.0))
    value = F.greatest(F.lit(0.0), cos) if name == "dense_cosine" else F.when(F.col("__q").isNull() | F.col("__c").isNull(), 0.0).otherwise(T.unit_interval(cos))
    return joined.withColumn(name, _r4(value)).drop("__q", "__c", "__qn", "__cn")


def hybrid(pairs: DataFrame) -> DataFrame:
    """Adds rrf_seed to features with dense_cosine."""
    return pairs.withColumn("rrf_seed", _r4(T.clamp(F.col("seed"))))


def rag(pairs: DataFrame) -> DataFrame:
    """Adds agreement, alignment (mean of three) and retrieval confidence to engineered features with dense_cosine.

    Half of a sum of two 4-decimal numbers often ends in 5: it is rounded as a decimal number, so halves go up in any engine.
    """
    c = F.col
    return pairs.withColumns({
        "semantic_lexical_agreement": F.round((c("dense_cosine") + c("bm25_plus")).cast("decimal(12,4)") / 2, 4).cast("double"),
        "metadata_alignment": _r4((c("project_match") + c("component_overlap") + c("issue_type_match")) / 3),
        "retrieval_confidence": _r4((c("candidate_seed") + c("dense_cosine") + c("bm25_plus")) / 3),
    })


def graph(pairs: DataFrame, context: DataFrame) -> DataFrame:
    """Adds overlaps, matches, alignment (mean of seven), graph_context (from graph_context()) and graph_seed to standard features with dense_cosine."""
    c = F.col
    wide = pairs.withColumns({**_set_overlaps(), **_matches()})
    seven = c("project_match") + c("issue_type_match") + c("priority_match") + c("status_match") + c("component_overlap") + c("affected_version_overlap") + c("fix_version_overlap")
    return wide.join(context, ["qid", "issue_id"], "left").withColumns({
        "metadata_alignment": _r4(seven / 7), "graph_context": _r4(F.coalesce("graph_context", F.lit(0.0))), "graph_seed": _r4(F.least(F.lit(1.0), c("seed"))),
    })


def embedding_seed(pairs: DataFrame) -> DataFrame:
    """Adds llm_embedding_cosine, the seed cosine on [0, 1], to standard features."""
    return pairs.withColumn("llm_embedding_cosine", _r4(T.unit_interval(F.col("seed"))))


def cross_score(pairs: DataFrame, score_pairs) -> DataFrame:
    """Adds llm_cross_score = sigmoid of a pair scorer: a column function of (query text, candidate text) built from the first 320 weighted terms."""
    as_text = lambda p: F.coalesce(F.nullif(F.array_join(F.slice(f"{p}_weighted_terms", 1, 320), " "), F.lit("")), F.lit("empty issue"))
    return embedding_seed(pairs).withColumn("llm_cross_score", _r4(T.sigmoid(score_pairs(as_text("q"), as_text("c")))))
