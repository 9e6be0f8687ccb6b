"""Queries of the similarity engine over issue_document, with the SQL they are checked against.

Search queries are the records whose id is divisible by 100, against all records; evaluations ask for every labelled record.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.operators import candidates as C
from ticketloom.operators import evaluate as E
from ticketloom.operators import features as X
from ticketloom.operators import graph as G
from ticketloom.operators import learn as L
from ticketloom.operators import random_indexing as RI
from ticketloom.operators import rerank as R
from ticketloom.operators.index import build_index, idf_bm25, idf_tfidf
from ticketloom.plans import oracle as O
from ticketloom.plans import oracle_values as V
from ticketloom.plans.pipelines import MODELS, Session
from ticketloom.sinks.reports import metric_pivot
from ticketloom.sources import issues as S
from ticketloom.sources import synthetic as SY
from ticketloom.storage import exists, materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The pool of the registered queries is the engine's.
POOL, SUPERVISED = 250, 80
_SESSIONS: dict[tuple, Session] = {}


def forget() -> None:
    """Drops what is kept of all folders, so that the next query builds it anew."""
    _SESSIONS.clear()


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return S.normalize(S.latest(table(spark, d, "issue_document")))


def _vectors(spark: SparkSession, d: str, name: str, column: str, dimension: int) -> DataFrame:
    """Vectors of the right dimension with finite elements, not all zero; of several per id the smallest."""
    v = F.col(column)
    good = (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return table(spark, d, name).where(v.isNotNull() & good).groupBy("issue_id").agg(F.min(v).cast("array<double>").alias("vector"))


def _shared_words(a: Column, b: Column) -> Column:
    """A stand-in for a cross encoder: how many of the words of two whole texts are shared."""
    return T.jaccard(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))) * 6.0 - 3.0


def _session(spark: SparkSession, d: str, labelled: bool = False) -> Session:
    """The index of a folder, built once and kept as long as its tables are there."""
    key = (spark.sparkContext.applicationId, d, labelled)
    kept = _SESSIONS.get(key)
    if kept is None or not exists(kept.index.prepared):
        other = _SESSIONS.get((spark.sparkContext.applicationId, d, not labelled))
        index = other.index if other is not None and exists(other.index.prepared) else build_index(_issues(spark, d))
        asks = index.prepared.where((F.size("linked_issue_ids") > 0) | (F.size("duplicate_issue_ids") > 0)) if labelled else index.prepared.where(F.col("issue_id") % 100 == 0)
        vectors = {"dense": materialize(_vectors(spark, d, "dense_embedding_space", "document_vector", 192), "dense"), "sbert": materialize(_vectors(spark, d, "sbert_embedding_space", "embedding", 64), "sbert")}
        vectors["e5"] = vectors["sbert"]
        kept = _SESSIONS[key] = Session(index, asks.select(F.col("issue_id").alias("qid")), vectors, pair_scorer=_shared_words, pool=POOL, models=() if labelled else tuple(MODELS))
    return kept


# Text and scalar functions

@query("q_normalize", f"SELECT issue_id, {O.norm('title')} AS title, {O.norm('description_text')} AS description_text FROM issue_document")
def _(spark, d):
    return table(spark, d, "issue_document").select("issue_id", *[T.normalize_text(F.col(c)).alias(c) for c in ("title", "description_text")])


@query("q_tokenize_counts", f"SELECT doc_id, len({O.tokens('text')}) AS n_tokens, len(list_distinct({O.tokens('text')})) AS n_terms, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS n_words FROM documents")
def _(spark, d):
    t = T.tokenize(F.col("text"))
    n = lambda c, a: F.size(c).cast("bigint").alias(a)
    return table(spark, d, "documents").select("doc_id", n(t, "n_tokens"), n(F.array_distinct(t), "n_terms"), n(T.tokenize(F.col("text"), True), "n_words"))


@query("q_label_normalize", f"SELECT DISTINCT issue_type, {O.label('issue_type')} AS label FROM issue_document")
def _(spark, d):
    return table(spark, d, "issue_document").select("issue_type", T.normalize_label(F.col("issue_type")).alias("label")).distinct()


@query("q_char_ngrams", O.PREPARED.replace("raw AS", "WITH raw AS", 1) + " SELECT issue_id, array_to_string(list_sort(title_ngrams), '|') AS grams FROM prepared")
def _(spark, d):
    return _issues(spark, d).select("issue_id", F.array_join(F.array_sort(T.char_ngrams(F.col("title"))), "|").alias("grams"))


_PAIRS = "WITH " + O.PREPARED.lstrip() + ", pairs AS (SELECT DISTINCT query_id, issue_id FROM candidate_match)"


def _pairs(spark: SparkSession, d: str, column, name: str) -> DataFrame:
    p = _issues(spark, d).select("issue_id", column.alias(name))
    k = table(spark, d, "candidate_match").select("query_id", "issue_id").distinct()
    return k.join(p.select(F.col("issue_id").alias("query_id"), F.col(name).alias("a")), "query_id").join(p.withColumnRenamed(name, "b"), "issue_id")


@query("q_title_jaccard", _PAIRS + f" SELECT query_id, p.issue_id, round({O.jaccard('a.title_terms', 'b.title_terms')}, 6) AS title_jaccard, round({O.jaccard('a.title_ngrams', 'b.title_ngrams')}, 6) AS title_ngram FROM pairs p JOIN prepared a ON a.issue_id = query_id JOIN prepared b ON b.issue_id = p.issue_id")
def _(spark, d):
    t = _pairs(spark, d, F.struct(F.array_distinct(T.tokenize(F.col("title"))).alias("t"), T.char_ngrams(F.col("title")).alias("g")), "x")
    return t.select("query_id", "issue_id", F.round(T.jaccard(F.col("a.t"), F.col("b.t")), 6).alias("title_jaccard"), F.round(T.jaccard(F.col("a.g"), F.col("b.g")), 6).alias("title_ngram"))


@query("q_term_overlap", _PAIRS + f" SELECT query_id, p.issue_id, round({O.overlap('a.description_terms', 'b.description_terms')}, 6) AS term_overlap FROM pairs p JOIN prepared a ON a.issue_id = query_id JOIN prepared b ON b.issue_id = p.issue_id")
def _(spark, d):
    t = _pairs(spark, d, F.array_distinct(T.tokenize(F.col("description_text"))), "x")
    return t.select("query_id", "issue_id", F.round(T.overlap_ratio(F.col("a"), F.col("b")), 6).alias("term_overlap"))


_SEEDS = "round(CASE WHEN s < 0 THEN greatest(0, least(1, (s + 1) / 2)) WHEN s <= 1 THEN s ELSE s / (s + 12) END, 8)"


@query("q_score_functions", f"SELECT query_id, issue_id, s, round(CASE WHEN s > 0 THEN s / (s + 8) ELSE 0 END, 8) AS squashed, {_SEEDS} AS seed, round(1 / (1 + exp(-greatest(least(s, 30), -30))), 8) AS probability, round(greatest(0, least(1, (s + 1) / 2)), 8) AS unit FROM (SELECT DISTINCT query_id, issue_id, seed_score AS s FROM candidate_match WHERE seed_score IS NOT NULL AND NOT isnan(seed_score))")
def _(spark, d):
    s = F.col("s")
    k = table(spark, d, "candidate_match").where(F.col("seed_score").isNotNull() & ~F.isnan("seed_score")).select("query_id", "issue_id", F.col("seed_score").alias("s")).distinct()
    return k.select("query_id", "issue_id", "s", F.round(T.squash(s), 8).alias("squashed"), F.round(T.normalize_seed(s), 8).alias("seed"), F.round(T.sigmoid(s), 8).alias("probability"), F.round(T.unit_interval(s), 8).alias("unit"))


@query("q_grouped_split", r"""SELECT issue_id, loaded_at, array_to_string(list_filter(string_split(coalesce(components, ''), '||'), lambda x: x <> ''), ',') AS components,
    len(list_filter(string_split(coalesce(fix_versions, ''), '||'), lambda x: x <> '')) AS n_fix_versions FROM tawos_issue_search_document""")
def _(spark, d):
    return table(spark, d, "tawos_issue_search_document").select("issue_id", "loaded_at", F.array_join(T.split_grouped(F.col("components")), ",").alias("components"), F.size(T.split_grouped(F.col("fix_versions"))).cast("bigint").alias("n_fix_versions"))


# Index

_W = "WITH "


@query("q_weighted_terms_tf", _W + O.INDEX + " SELECT issue_id, term, tf FROM bags")
def _(spark, d):
    return _session(spark, d).index.postings.select("issue_id", "term", "tf")


@query("q_weighted_sequence", _W + O.PREPARED + " SELECT issue_id, array_to_string(weighted_terms, ' ') AS terms, document_length FROM sized")
def _(spark, d):
    return _session(spark, d).prepared.select("issue_id", F.array_join("weighted_terms", " ").alias("terms"), "document_length")


@query("q_doc_stats", _W + O.INDEX + " SELECT n AS doc_count, round(avgdl, 6) AS avg_doc_length, (SELECT count(*) FROM frequencies) AS n_terms FROM corpus")
def _(spark, d):
    i = _session(spark, d).index
    return i.document_frequency.agg(F.lit(i.n).cast("bigint").alias("doc_count"), F.round(F.lit(i.avg_length), 6).alias("avg_doc_length"), F.count("*").alias("n_terms"))


@query("q_df_idf", _W + O.INDEX + " SELECT DISTINCT term, df, round(idf, 6) AS idf_bm25, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf_tfidf FROM postings")
def _(spark, d):
    i = _session(spark, d).index
    n = F.lit(i.n)
    return i.document_frequency.select("term", "df", F.round(idf_bm25(n, F.col("df")), 6).alias("idf_bm25"), F.round(idf_tfidf(n, F.col("df")), 6).alias("idf_tfidf"))


@query("q_postings", _W + O.INDEX + " SELECT term, p.issue_id, tf, round(w / norm, 6) AS weight FROM postings p JOIN norms USING (issue_id)")
def _(spark, d):
    i = _session(spark, d).index
    return i.postings.select("term", "issue_id", "tf", F.round("unit_weight", 6).alias("weight"))


# Retrieval

def _top(name: str, score: str):
    @query(name, _W + O.lexical() + ", " + O.pool("hits", "lexical", score, 11, f"{score} > 0") + " SELECT qid, issue_id, round(seed, 6) AS score, rank FROM hits WHERE qid <> issue_id")
    def _(spark, d):
        hits = C.exclude_self(C.sparse_candidates(_session(spark, d).lexical(), score, 11))
        return hits.select("qid", "issue_id", F.round("seed", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


for _name, _score in (("q_bm25_topk", "bm25"), ("q_bm25plus_topk", "bm25_plus"), ("q_tfidf_topk", "tfidf_cosine"), ("q_coarse_candidates", "coarse")):
    _top(_name, _score)


@query("q_candidate_fallback", _W + O.PREPARED + """, asks AS (SELECT DISTINCT -row_number() OVER (ORDER BY project_key) AS qid, project_key FROM (SELECT DISTINCT project_key FROM prepared WHERE project_key <> '' UNION ALL SELECT 'no such project')),
    placed AS (SELECT issue_id, project_key, row_number() OVER (PARTITION BY project_key ORDER BY issue_id) AS r, row_number() OVER (ORDER BY issue_id) AS a FROM prepared)
    SELECT qid, issue_id, r AS rank FROM asks JOIN placed USING (project_key) WHERE r <= 250 UNION ALL SELECT qid, issue_id, a FROM asks, placed WHERE asks.project_key = 'no such project' AND a <= 250""")
def _(spark, d):
    """Queries of unseen words only, one of every project and one of none: the first records of the project, else of the corpus."""
    from pyspark.sql import Window

    p = _session(spark, d).prepared
    keys = p.where("project_key <> ''").select("project_key").distinct().unionByName(spark.createDataFrame([("no such project",)], "project_key string"))
    asks = keys.withColumn("qid", -F.row_number().over(Window.orderBy("project_key")).cast("bigint"))
    nothing = spark.createDataFrame([], "qid long, issue_id long, seed double, rank int")
    return C.with_fallback(nothing, asks.select("qid", "project_key"), p, POOL).select("qid", "issue_id", F.col("rank").cast("bigint").alias("rank"))


def _dense_query(name: str, space: str, positive: bool):
    @query(name, _W + O.PREPARED + f", {O.SEARCH_QUERIES}, {O.VECTORS}, {O.cosines(space, positive)}, {O.pool('hits', f'cos_{space}', 'c', POOL)} SELECT qid, issue_id, round(seed, 6) AS cosine, rank FROM hits")
    def _(spark, d):
        return _session(spark, d).by_vector(space, positive).select("qid", "issue_id", F.round("seed", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


_dense_query("q_dense_topk", "dense", True)
_dense_query("q_sbert_topk", "sbert", False)


@query("q_rrf_fusion", _W + O.lexical() + ", " + O.fused(POOL) + " SELECT qid, issue_id, round(seed, 6) AS score, rank FROM fused")
def _(spark, d):
    return _session(spark, d).fused().select("qid", "issue_id", F.round("seed", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# Features

_SPARSE = _W + O.lexical() + ", " + O.pool("bm", "lexical", "bm25", POOL, "bm25 > 0")


@query("q_features_standard", _SPARSE + ", " + O.features("bm") + f" SELECT qid, issue_id, {', '.join(X.STANDARD)} FROM features")
def _(spark, d):
    s = _session(spark, d)
    return X.other_issue(s.features("bm25", C.exclude_self(s.candidates("bm25")))).select("qid", "issue_id", *X.STANDARD)


_COARSE = _W + O.lexical() + ", " + O.pool("co", "lexical", "coarse", SUPERVISED, "coarse > 0") + ", " + O.features("co")


@query("q_features_engineered", _COARSE + f" SELECT qid, issue_id, {', '.join(X.ENGINEERED)} FROM features")
def _(spark, d):
    s = _session(spark, d)
    return X.other_issue(s.features("logreg-engineered", C.exclude_self(s.candidates("logreg-engineered")))).select("qid", "issue_id", *X.ENGINEERED)


# Models

_RANKED = " SELECT qid, issue_id, place AS rank, score, reasons FROM ranked"
_FUSED = _W + O.lexical() + ", " + O.fused(POOL)
_EVIDENCE = "round((project_match + component_overlap + issue_type_match) / 3, 4) AS metadata_alignment, (round((dense_cosine + bm25_plus) * 10000)::BIGINT + 1) // 2 / 10000 AS semantic_lexical_agreement, round((candidate_seed + dense_cosine + bm25_plus) / 3, 4) AS retrieval_confidence"
_GRAPH_POOL = ", ".join([O.EDGES, O.METADATA, O.GRAPH_SEEDS, O.PROPAGATED, "combined AS (SELECT qid, issue_id, sum(s) AS s FROM (SELECT * FROM seeds UNION ALL SELECT * FROM spread) GROUP BY 1, 2)", O.pool("graph_pool", "combined", "s", POOL)])
_SEVEN = "round((project_match + issue_type_match + priority_match + status_match + component_overlap + affected_version_overlap + fix_version_overlap) / 7, 4) AS metadata_alignment, round(coalesce(graph_context, 0), 4) AS graph_context, round(least(1.0, seed), 4) AS graph_seed"
_E5_SOURCE = "(SELECT *, round(greatest(0, least(1, (seed + 1) / 2)), 4) AS llm_embedding_cosine FROM features)"


_TEXT = "(SELECT issue_id, list_distinct(string_split(coalesce(nullif(array_to_string(list_slice(weighted_terms, 1, 320), ' '), ''), 'empty issue'), ' ')) AS x FROM prepared)"
_CROSS_SOURCE = f"""(SELECT f.*, round(1 / (1 + exp(-greatest(least({O.jaccard('a.x', 'b.x')} * 6.0 - 3.0, 30), -30))), 4) AS llm_cross_score
    FROM {_E5_SOURCE} f JOIN {_TEXT} a ON a.issue_id = qid JOIN {_TEXT} b ON b.issue_id = f.issue_id)"""


def _fixed(model: str, vectors: str = O.VECTORS, new: bool = False) -> str:
    """SQL of a model's ranking, with reasons as one text. new: the queries are records outside the corpus, equal to records of it."""
    sparse, fused = _SPARSE, _W + O.lexical() + ", " + O.fused(POOL, vectors)
    features = lambda *a: O.features(*a, keep_self=new)
    if model in ("bm25", "lexical"):
        head, source = sparse + ", " + features("bm"), "features"
    elif model in ("bm25-plus", "tfidf-cosine"):
        score = model.replace("-", "_")
        head, source = _W + O.lexical() + ", " + O.pool("bm", "lexical", score, POOL, f"{score} > 0") + ", " + features("bm"), "features"
    elif model == "random-indexing-dense":
        head, source = fused + ", " + O.pool("fall", "(SELECT d.qid, d.issue_id, d.seed FROM dense d UNION ALL SELECT qid, f.issue_id, 0 FROM (SELECT q.qid, p.project_key FROM queries q JOIN prepared p ON p.issue_id = q.qid WHERE q.qid NOT IN (SELECT qid FROM dense)) m JOIN prepared f USING (project_key) WHERE project_key <> '')", "seed", POOL) + ", " + features("fall", "dense"), "features"
    elif model in ("sbert-dense", "llm-e5-large", "llm-e5-cross-reranker"):
        head = _W + O.lexical() + f", {O.VECTORS}, {O.cosines('sbert', False)}, {O.pool('sb', 'cos_sbert', 'c', SUPERVISED if model.endswith("reranker") else POOL)}, " + features("sb", "sbert")
        source = {"sbert-dense": "features", "llm-e5-large": _E5_SOURCE}.get(model, _CROSS_SOURCE)
    elif model == "hybrid-sparse-dense":
        head, source = fused + ", " + features("fused", "dense"), f"(SELECT *, round({O.clamp('seed')}, 4) AS rrf_seed FROM features)"
    elif model == "rag-hybrid-judge":
        head, source = fused + ", " + features("fused", "dense"), f"(SELECT *, {_EVIDENCE} FROM features)"
    else:
        head, source = ", ".join([fused, _GRAPH_POOL, features("graph_pool", "dense"), O.context("graph_pool")]), f"(SELECT f.* , {_SEVEN} FROM features f LEFT JOIN context USING (qid, issue_id))"
    score = O.JUDGE_SCORE if model == "rag-hybrid-judge" else O.linear_score(model)
    if model in V.RULES:
        table_, otherwise = V.RULES[model]
        reasons = O.rules(list(table_), f"'{otherwise}'")
    elif model == "rag-hybrid-judge":
        bands = "coalesce(" + ", ".join(f"CASE WHEN {O.JUDGE_SCORE} >= {least} THEN '{t}' END" for least, t in V.JUDGE_OTHERWISE) + ")"
        reasons = O.rules([(c.format(score=f"({O.JUDGE_SCORE})"), t) for c, t in V.JUDGE_RULES], bands)
    else:
        reasons = O.linear_reasons(model, 0.05 if model == "hybrid-sparse-dense" else 0.08)
    return head + ", " + O.ranked(score, source, 10, f", {reasons} AS reasons")


def _rank_query(name: str, model: str):
    @query(name, _fixed(model) + _RANKED)
    def _(spark, d):
        return _session(spark, d).ranked(model).select("qid", "issue_id", F.col("rank").cast("bigint").alias("rank"), "score", F.array_join("reasons", "; ").alias("reasons"))


for _name, _model in (("q_rank_bm25", "bm25"), ("q_rank_bm25_plus", "bm25-plus"), ("q_rank_tfidf", "tfidf-cosine"), ("q_rank_lexical", "lexical"), ("q_dense_rank", "random-indexing-dense"), ("q_sbert_rank", "sbert-dense"),
                      ("q_e5_rank", "llm-e5-large"), ("q_cross_rank", "llm-e5-cross-reranker"), ("q_hybrid_rank", "hybrid-sparse-dense"), ("q_rag_judge", "rag-hybrid-judge"), ("q_graph_rank", "graph-metadata-aware")):
    _rank_query(_name, _model)


# Random indexing on its own vectors, and new records

@query("q_ri_rank", _fixed("random-indexing-dense", O.RANDOM_VECTORS) + _RANKED)
def _(spark, d):
    """The random-indexing model on the vectors learnt from the corpus."""
    return _own_vectors(spark, d).ranked("random-indexing-dense").select("qid", "issue_id", F.col("rank").cast("bigint").alias("rank"), "score", F.array_join("reasons", "; ").alias("reasons"))


def _own_vectors(spark: SparkSession, d: str) -> Session:
    """The session whose dense vectors are those learnt from the corpus."""
    s = _session(spark, d)
    return s.part("own", lambda: Session(s.index, s.queries, {k: v for k, v in s.vectors.items() if k != "dense"}, s.pair_scorer, POOL, models=tuple(MODELS), _made={"tokens": s.token_vectors(), "terms": s.terms()}))


def _new_records(spark: SparkSession, d: str) -> Session:
    """The queries' records as new ones, without id and key (qid: the negative id), with the vectors an encoder would give them."""
    s = _session(spark, d)

    def make() -> Session:
        own = s.prepared.join(s.queries.select(F.col("qid").alias("issue_id")), "issue_id", "left_semi")
        asked = materialize(own.withColumns({"issue_id": -F.col("issue_id"), "issue_key": F.lit(None).cast("string")}), "asked")
        given = {k: s.vectors[k].select((-F.col("issue_id")).alias("issue_id"), "vector") for k in ("sbert", "e5")}
        vectors = {k: v for k, v in s.vectors.items() if k != "dense"}
        made = {"tokens": s.token_vectors(), "edges": s.edges()}
        return Session(s.index, asked.select(F.col("issue_id").alias("qid")), vectors, s.pair_scorer, POOL, asked=asked, query_vectors=given, models=tuple(MODELS), _made=made)

    return s.part("new", make)


_FITTED = ("logreg-engineered", "pairwise-neural-mlp")


def _new_query(model: str):
    """A search of new records; the SQL searches for the equal records of the corpus and keeps them in their own lists."""
    dense = model in ("random-indexing-dense", "hybrid-sparse-dense", "rag-hybrid-judge", "graph-metadata-aware")
    sql = None if model in _FITTED else _fixed(model, O.RANDOM_VECTORS if dense else O.VECTORS, True) + " SELECT -qid AS qid, issue_id, place AS rank, score FROM ranked"

    @query("q_search_new_" + model.replace("-", "_"), sql)
    def _(spark, d):
        fitted = _fitted(spark, d, model) if model in _FITTED else None
        return _new_records(spark, d).ranked(model, reranker=fitted).select("qid", "issue_id", F.col("rank").cast("bigint").alias("rank"), "score")


for _model in MODELS:
    _new_query(_model)


@query("q_find_duplicates", _fixed("bm25") + " SELECT qid, issue_id, place AS rank, score FROM ranked WHERE score >= 0.55")
def _(spark, d):
    return _session(spark, d).ranked("bm25").where("score >= 0.55").select("qid", "issue_id", F.col("rank").cast("bigint").alias("rank"), "score")


_UNFITTED = [m for m in MODELS if m not in _FITTED]


@query("q_compare_models", " UNION ALL ".join(f"SELECT * FROM ({_fixed(m)} SELECT '{m}' AS model, qid, issue_id, place AS rank, score FROM ranked WHERE place <= 5)" for m in _UNFITTED))
def _(spark, d):
    s = _session(spark, d)
    parts = [s.ranked(m, 5).select(F.lit(m).alias("model"), "qid", "issue_id", F.col("rank").cast("bigint").alias("rank"), "score") for m in _UNFITTED]
    return reduce(DataFrame.unionByName, parts)


# Graph

@query("q_graph_edges", _W + O.PREPARED + ", " + O.EDGES + " SELECT src, dst, w FROM edges")
def _(spark, d):
    return _session(spark, d).edges()


@query("q_metadata_seeds", _W + O.PREPARED + f", {O.SEARCH_QUERIES}, {O.METADATA} SELECT qid, issue_id, round(seed, 6) AS seed FROM meta_seeds")
def _(spark, d):
    s = _session(spark, d)
    return G.metadata_seeds(s.prepared, s.queries).withColumn("seed", F.round("seed", 6))


@query("q_metadata_top", _W + O.PREPARED + f", {O.SEARCH_QUERIES}, {O.METADATA}, {O.pool('hits', 'meta_seeds', 'seed', 20)} SELECT qid, issue_id, round(seed, 6) AS seed FROM hits")
def _(spark, d):
    s = _session(spark, d)
    return G.metadata_top(s.prepared, s.queries, 20).withColumn("seed", F.round("seed", 6))


@query("q_graph_candidates", _FUSED + ", " + _GRAPH_POOL + " SELECT qid, issue_id, round(seed, 6) AS seed, rank FROM graph_pool")
def _(spark, d):
    return _session(spark, d).candidates("graph-metadata-aware").select("qid", "issue_id", F.round("seed", 6).alias("seed"), F.col("rank").cast("bigint").alias("rank"))


@query("q_two_hop_propagation", _FUSED + ", " + ", ".join([O.EDGES, O.METADATA, O.GRAPH_SEEDS, O.PROPAGATED]) + " SELECT qid, issue_id, round(s, 6) AS score FROM spread")
def _(spark, d):
    s = _session(spark, d)
    base = s.fused().select("qid", "issue_id", (1 / (8 + F.col("rank")) + T.clamp(F.col("seed"))).alias("seed"))
    seeds = base.unionByName(G.metadata_seeds(s.prepared, s.queries)).groupBy("qid", "issue_id").agg(F.sum("seed").alias("seed"))
    return G.propagate(seeds, s.edges()).select("qid", "issue_id", F.round("seed", 6).alias("score"))


@query("q_graph_context", ", ".join([_FUSED, O.EDGES, O.context("fused")]) + " SELECT qid, issue_id, round(graph_context, 6) AS graph_context FROM context")
def _(spark, d):
    s = _session(spark, d)
    return G.graph_context(s.fused(), s.prepared, s.edges()).withColumn("graph_context", F.round("graph_context", 6))


# Random indexing

_RI, _COOC, _TOKEN = O.RANDOM_ENTRIES, O.COOCCURRENCE, O.TOKEN_VECTORS


@query("q_random_index_vectors", _W + O.INDEX + ", " + _RI + " SELECT term, dim, sign FROM entries")
def _(spark, d):
    i = _session(spark, d).index
    return i.document_frequency.select("term", F.explode(RI.index_entries(F.col("term"))).alias("e")).select("term", "e.dim", "e.sign")


@query("q_cooccurrence", _W + O.PREPARED + ", " + _COOC + " SELECT term, neighbour, round(weight, 6) AS weight FROM cooc")
def _(spark, d):
    return RI.cooccurrence(_session(spark, d).prepared).withColumn("weight", F.round("weight", 6))


@query("q_ri_token_vectors", ", ".join([_W + O.INDEX, _RI, _COOC, _TOKEN]) + " SELECT term, dim, round(value, 6) AS value FROM unit")
def _(spark, d):
    return _session(spark, d).token_vectors().withColumn("value", F.round("value", 6))


@query("q_ri_doc_topk", ", ".join([_W + O.INDEX, O.SEARCH_QUERIES, _RI, _COOC, _TOKEN, O.RANDOM_DOCUMENTS, """
    cos AS (SELECT a.issue_id AS qid, b.issue_id, sum(a.v * b.v) AS c FROM docs a JOIN queries ON qid = a.issue_id JOIN docs b USING (dim) GROUP BY 1, 2)""", O.pool("hits", "cos", "c", 11, "c > 0")])
    + " SELECT qid, issue_id, round(seed, 6) AS cosine, rank FROM hits WHERE qid <> issue_id")
def _(spark, d):
    s = _session(spark, d)
    v = s.once("ri", lambda: RI.document_vectors(s.index, s.token_vectors()))
    q = v.join(s.queries.select(F.col("qid").alias("issue_id")), "issue_id").select(F.col("issue_id").alias("qid"), "vector")
    return C.exclude_self(C.dense_topk(q, v, 11)).select("qid", "issue_id", F.round("seed", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


# Supervised models

_TRAIN = """
related AS (SELECT DISTINCT issue_id AS qid, o AS issue_id FROM (SELECT issue_id, unnest(list_concat(linked_issue_ids, duplicate_issue_ids)) AS o FROM prepared) WHERE o <> issue_id AND o IN (SELECT issue_id FROM prepared)),
need AS (SELECT qid, count(*) * 4 AS need FROM related GROUP BY 1),
hard AS (SELECT c.qid, c.issue_id, c.seed, row_number() OVER (PARTITION BY c.qid ORDER BY rank) AS place, need FROM co c JOIN need USING (qid) WHERE c.qid <> c.issue_id AND rank <= greatest(80, need) AND NOT EXISTS (SELECT 1 FROM related r WHERE r.qid = c.qid AND r.issue_id = c.issue_id)),
pairs AS MATERIALIZED (SELECT r.qid, r.issue_id, coalesce(seed, 0) AS seed, 1 AS label FROM related r JOIN need n USING (qid) LEFT JOIN co ON co.qid = r.qid AND co.issue_id = r.issue_id AND co.rank <= greatest(80, need) UNION ALL SELECT qid, issue_id, seed, 0 FROM hard WHERE place <= need)"""
_TRAINING = _W + O.lexical(O.EVERY_LABELLED) + ", " + O.pool("co", "lexical", "coarse", POOL, "coarse > 0") + ", " + _TRAIN


def _training(spark: SparkSession, d: str) -> DataFrame:
    s = _session(spark, d, True)
    return s.once("training", lambda: s.training("logreg-engineered").select("qid", "issue_id", "seed", "label", *X.ENGINEERED))


@query("q_training_pairs", _TRAINING + " SELECT qid, issue_id, round(seed, 6) AS seed, label FROM pairs")
def _(spark, d):
    return _training(spark, d).select("qid", "issue_id", F.round("seed", 6).alias("seed"), "label")


@query("q_hard_negatives", _TRAINING + " SELECT qid, issue_id, round(seed, 6) AS seed FROM pairs WHERE label = 0")
def _(spark, d):
    return _training(spark, d).where("label = 0").select("qid", "issue_id", F.round("seed", 6).alias("seed"))


#: Weights for scoring without fitting.
_FIXED_LOGISTIC = {n: round(0.9 - 0.05 * k, 2) for k, n in enumerate(X.ENGINEERED)}
_FIXED_HIDDEN = [[round(((i * 7 + j * 3) % 11 - 5) / 20, 2) for j in range(len(X.NEURAL))] for i in range(32)]
_FIXED_OUT = [round(((i * 5) % 9 - 4) / 8, 3) for i in range(32)]


def _sql_mlp() -> str:
    units = " + ".join(f"{o} * greatest(0.1 + {O.weighted(dict(zip(X.NEURAL, w)))}, 0.0)" for w, o in zip(_FIXED_HIDDEN, _FIXED_OUT))
    return f"1 / (1 + exp(-greatest(least(-0.2 + {units}, 30), -30)))"


@query("q_logistic_score", _COARSE + ", " + O.ranked(f"1 / (1 + exp(-greatest(least(-2.0 + {O.weighted(_FIXED_LOGISTIC)}, 30), -30)))") + " SELECT qid, issue_id, place AS rank, score FROM ranked")
def _(spark, d):
    s = _session(spark, d)
    return s.ranked("logreg-engineered", reranker=R.logistic(_FIXED_LOGISTIC, -2.0)).select("qid", "issue_id", F.col("rank").cast("bigint").alias("rank"), "score")


@query("q_mlp_score", _FUSED + ", " + O.features(f"(SELECT * FROM fused WHERE rank <= {SUPERVISED})", "dense") + ", " + O.ranked(_sql_mlp()) + " SELECT qid, issue_id, place AS rank, score FROM ranked")
def _(spark, d):
    """The network at its size (32 units over 17 features), with weights that SQL can state."""
    s = _session(spark, d)
    return s.ranked("pairwise-neural-mlp", reranker=R.neural(X.NEURAL, _FIXED_HIDDEN, [0.1] * 32, _FIXED_OUT, -0.2)).select("qid", "issue_id", F.col("rank").cast("bigint").alias("rank"), "score")


@query("q_features_neural", _FUSED + ", " + O.features(f"(SELECT * FROM fused WHERE rank <= {SUPERVISED})", "dense") + f" SELECT qid, issue_id, {', '.join(X.NEURAL)} FROM features")
def _(spark, d):
    s = _session(spark, d)
    return X.other_issue(s.features("pairwise-neural-mlp", C.exclude_self(s.candidates("pairwise-neural-mlp")))).select("qid", "issue_id", *X.NEURAL)


def _fitted(spark: SparkSession, d: str, model: str) -> R.Reranker:
    """A supervised model fitted on every labelled record."""
    s = _session(spark, d, True)
    return s.part(f"model:{model}", lambda: s.reranker(model))


def _fitted_query(name: str, model: str):
    @query(name)
    def _(spark, d):
        """Ranking by the fitted model (rows only: SQL has no such optimiser)."""
        found = _session(spark, d).ranked(model, reranker=_fitted(spark, d, model))
        return found.select("qid", "issue_id", F.col("rank").cast("bigint").alias("rank"), "score", F.array_join("reasons", "; ").alias("reasons"))


_fitted_query("q_rank_logreg", "logreg-engineered")
_fitted_query("q_rank_mlp", "pairwise-neural-mlp")


@query("q_logreg_fit")
def _(spark, d):
    """Coefficients of a fitted logistic model (another optimiser than SQL has: rows only)."""
    m = L.fit_logistic(_training(spark, d), X.ENGINEERED)
    return spark.createDataFrame([*m.weights.items(), ("bias", m.bias)], "feature string, weight double")


@query("q_mlp_fit")
def _(spark, d):
    """Loss curve of the network as the model fits it: 17 features over the fused pool, 300 epochs at most (rows only)."""
    s = _session(spark, d, True)
    return L.diagnostics(L.fit_mlp(s.training("pairwise-neural-mlp"), X.NEURAL), spark)


_SCORED = _TRAINING + ", " + O.features("(SELECT *, 0 AS rank FROM pairs)", keep_self=True) + f", scored AS (SELECT label, 1 / (1 + exp(-greatest(least(-2.0 + {O.weighted(_FIXED_LOGISTIC)}, 30), -30))) AS p FROM features JOIN pairs USING (qid, issue_id))"


@query("q_binary_metrics", _SCORED + """, s AS (SELECT count(*) AS n, count_if(label = 1 AND p >= 0.5) AS tp, count_if(label = 0 AND p >= 0.5) AS fp, count_if(label = 1 AND p < 0.5) AS fn, avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) AS loss FROM scored),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM s)
    SELECT round((n - fp - fn) / n, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr > 0 AND re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, round(loss, 6) AS loss FROM r""")
def _(spark, d):
    p = T.sigmoid(F.lit(-2.0) + R.weighted_sum(_FIXED_LOGISTIC))
    return E.binary_metrics(_training(spark, d).select("label", p.alias("probability")))


# Evaluation

def _judged_sql(field: str) -> str:
    """Ranking of bm25 over all labelled queries, judged by a field's ids."""
    head = _W + O.lexical(O.EVERY_LABELLED) + ", " + O.pool("bm", "lexical", "bm25", POOL, "bm25 > 0") + ", " + O.features("bm") + ", " + O.ranked(O.linear_score("bm25"))
    return head + f""", relevant AS (SELECT issue_id AS qid, unnest({field}) AS issue_id FROM prepared), n_relevant AS (SELECT qid, count(*) AS n FROM relevant GROUP BY 1),
    judged AS (SELECT k.*, n, CASE WHEN r.issue_id IS NULL THEN 0 ELSE 1 END AS hit FROM ranked k JOIN n_relevant USING (qid) LEFT JOIN relevant r ON r.qid = k.qid AND r.issue_id = k.issue_id),
    counted AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY place) AS so_far FROM judged)"""


def _metric_sql(field: str) -> str:
    ks = "(SELECT unnest([1, 3, 5, 10]) AS k)"
    per = f"""per AS (SELECT m.qid, m.n, k, count_if(hit = 1 AND place <= k) AS h, coalesce(sum(CASE WHEN hit = 1 AND place <= k THEN so_far / place END), 0) AS p, coalesce(sum(CASE WHEN hit = 1 AND place <= k THEN 1 / log2(place + 1) END), 0) AS g,
      coalesce(max(CASE WHEN hit = 1 THEN 1 / place END), 0) AS rr FROM n_relevant m CROSS JOIN {ks} LEFT JOIN counted c ON c.qid = m.qid GROUP BY 1, 2, 3),
    full_ AS (SELECT *, list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM per)"""
    rows = ["SELECT 'mrr' AS metric, 10 AS k, round(avg(rr), 6) AS value FROM full_ WHERE k = 10"]
    rows += [f"SELECT '{m}', k, round(avg({x}), 6) FROM full_ GROUP BY k" for m, x in (("recall", "h / n"), ("map", "p / n"), ("precision", "h / k"), ("ndcg", "g / ideal"), ("hit_rate", "CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END"))]
    return _judged_sql(field) + ", " + per + " " + " UNION ALL ".join(rows)


def _ranked_all(spark: SparkSession, d: str) -> DataFrame:
    s = _session(spark, d, True)
    return s.once("eval", lambda: s.ranked("bm25").select("qid", "issue_id", "rank", "score"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The best matches of every labelled record by the bm25 model."""
    return _session(spark, d, True).ranked("bm25").select("qid", "issue_id", "rank", "score")


def _eval_query(name: str, task: str, field: str):
    @query(name, _metric_sql(field))
    def _(spark, d):
        return E.rank_metrics(_ranked_all(spark, d), E.labels(_session(spark, d, True).prepared, task))


_eval_query("q_eval_similarity", "similarity", "linked_issue_ids")
_eval_query("q_eval_duplicates", "duplicates", "duplicate_issue_ids")


@query("q_eval_threshold", _judged_sql("duplicate_issue_ids") + """, s AS (SELECT t AS threshold, count_if(score >= t AND hit = 1) AS tp, count_if(score >= t AND hit = 0) AS fp, (SELECT count(*) FROM relevant) AS total FROM judged, (SELECT unnest([0.45::DOUBLE, 0.55, 0.65]) AS t) GROUP BY 1),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN total > 0 THEN tp / total ELSE 0 END AS re FROM s)
    SELECT threshold, round(p, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN p > 0 AND re > 0 THEN 2 * p * re / (p + re) ELSE 0 END, 6) AS f1 FROM r""")
def _(spark, d):
    return E.threshold_metrics(_ranked_all(spark, d), E.labels(_session(spark, d, True).prepared, "duplicates"))


@query("q_benchmark_report_pivot", f"SELECT metric, max(value) FILTER (k = 1) AS k1, max(value) FILTER (k = 3) AS k3, max(value) FILTER (k = 5) AS k5, max(value) FILTER (k = 10) AS k10 FROM ({_metric_sql('linked_issue_ids')}) GROUP BY 1")
def _(spark, d):
    m = E.rank_metrics(_ranked_all(spark, d), E.labels(_session(spark, d, True).prepared, "similarity")).select(F.lit("bm25").alias("model"), F.lit("similarity").alias("task"), "*")
    return metric_pivot(m, [1, 3, 5, 10]).drop("model", "task").toDF("metric", "k1", "k3", "k5", "k10")


# Sources

@query("q_duplicate_pairs", _W + O.ISSUES + " SELECT DISTINCT least(issue_id, o) AS left_issue_id, greatest(issue_id, o) AS right_issue_id FROM (SELECT issue_id, unnest(duplicate_issue_ids) AS o FROM issues)")
def _(spark, d):
    return S.duplicate_pairs(_issues(spark, d))


@query("q_reverse_links", _W + O.ISSUES + """, l AS (SELECT issue_id AS a, unnest(linked_issue_ids) AS b FROM issues), both_ AS (SELECT a, b FROM l UNION SELECT b, a FROM l)
    SELECT issue_id, coalesce(array_to_string(list_sort(list(b)), ','), '') AS linked FROM issues LEFT JOIN both_ ON a = issue_id GROUP BY 1""")
def _(spark, d):
    return S.reverse_links(_issues(spark, d)).select("issue_id", F.array_join(F.col("linked_issue_ids").cast("array<string>"), ",").alias("linked"))


@query("q_metadata_group_concat", """SELECT project_key, array_to_string(list_sort(list_distinct(list(c))), '||') AS components, count(DISTINCT CASE WHEN lower(issue_type) = 'bug' THEN c END) AS n_bug_components
    FROM (SELECT project_key, issue_type, unnest(list_filter(string_split(components, '||'), lambda x: x <> '')) AS c FROM tawos_issue_search_document) GROUP BY 1""")
def _(spark, d):
    rows = table(spark, d, "tawos_issue_search_document").select("project_key", "issue_type", F.explode(T.split_grouped(F.col("components"))).alias("c"))
    return rows.groupBy("project_key").agg(F.array_join(F.array_sort(F.collect_set("c")), "||").alias("components"), F.count_distinct(F.when(F.lower("issue_type") == "bug", F.col("c"))).alias("n_bug_components"))


@query("q_relational_source", _W + O.ISSUES + """ SELECT issue_id, project_key, coalesce(description_text, '') AS description_text, array_to_string(components, '||') AS components, array_to_string(affected_versions, '||') AS affected_versions,
    array_to_string(fix_versions, '||') AS fix_versions, array_to_string(linked_issue_ids, ',') AS linked, array_to_string(duplicate_issue_ids, ',') AS duplicates, array_to_string(list_slice(comments, 1, 2), '##') AS comments
    FROM issues WHERE project_key IS NOT NULL""")
def _(spark, d):
    """The records taken apart into the relational tables and joined again, with the first two comments; issues without project fall away."""
    i = _issues(spark, d)
    key = lambda c: F.xxhash64(c)

    def names(column: str, to: str):
        return i.select("issue_id", F.explode(column).alias("name")).select("issue_id", key("name").alias(to))

    def named(*columns: str):
        return reduce(DataFrame.unionByName, [i.select(F.explode(c).alias("name")) for c in columns]).distinct().select(key("name").alias("id"), "name")

    links = i.select("issue_id", F.explode("linked_issue_ids").alias("target_issue_id"), F.lit("Relates").alias("name")).unionByName(i.select("issue_id", F.explode("duplicate_issue_ids").alias("target_issue_id"), F.lit("DUPLICATE").alias("name")))
    tables = {
        "issue": i.select(F.col("issue_id").alias("id"), "issue_key", key("project_key").alias("project_id"), "title", "description_text", F.lit(None).cast("string").alias("description"), F.col("issue_type").alias("type"), "priority", "status", "resolution"),
        "project": i.where("project_key IS NOT NULL").select(key("project_key").alias("id"), "project_key").distinct(),
        "issue_component": names("components", "component_id"), "component": named("components"), "affected_version": names("affected_versions", "affected_version_id"), "fix_version": names("fix_versions", "fix_version_id"),
        "version": named("affected_versions", "fix_versions"), "issue_link": links,
        "comment": i.select("issue_id", F.posexplode("comments").alias("creation_date", "comment_text")).withColumn("comment", F.lit(None).cast("string")),
    }
    r = S.from_relational(tables, 2)
    joined = lambda c, sep: F.array_join(F.col(c).cast("array<string>"), sep)
    return r.select("issue_id", "project_key", "description_text", *[joined(c, "||").alias(c) for c in ("components", "affected_versions", "fix_versions")], joined("linked_issue_ids", ",").alias("linked"), joined("duplicate_issue_ids", ",").alias("duplicates"), joined("comments", "##").alias("comments"))


@query("q_first_n_comments", _W + O.ISSUES + " SELECT issue_id, array_to_string(list_slice(comments, 1, 2), '##') AS comments FROM issues WHERE len(comments) > 0")
def _(spark, d):
    c = _issues(spark, d).select("issue_id", F.posexplode("comments").alias("creation_date", "comment_text"))
    return S.first_comments(c, 2).select("issue_id", F.array_join("comments", "##").alias("comments"))


@query("q_group_activity_by_day", "SELECT user_id, ts::DATE AS day, count(*) AS n_events, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY 1, 2")
def _(spark, d):
    return S.activity_by_day(table(spark, d, "events"), "user_id", "ts", "event_type").withColumn("kinds", F.array_join("kinds", ","))


@query("q_json_source", _W + O.ISSUES + " SELECT issue_id, issue_key, title, array_to_string(components, '||') AS components, len(comments) AS n_comments, array_to_string(duplicate_issue_ids, ',') AS duplicates FROM issues WHERE title IS NOT NULL")
def _(spark, d):
    """Records written as nested JSON and decoded again."""
    i = _issues(spark, d).where(F.col("title").isNotNull())
    meta = F.struct("issue_id", F.col("title").alias("summary"), F.col("description_text").alias("description"), "project_key", "issue_type", "priority", "status", "resolution", "components", "affected_versions", "fix_versions", "comments", "linked_issue_ids", "duplicate_issue_ids")
    back = S.decode_json(i.select(F.to_json(F.struct(F.col("issue_key").alias("jira_id"), meta.alias("metadata"))).alias("record")))
    return back.select("issue_id", "issue_key", "title", F.array_join("components", "||").alias("components"), F.size("comments").cast("bigint").alias("n_comments"), F.array_join(F.col("duplicate_issue_ids").cast("array<string>"), ",").alias("duplicates"))


@query("q_search_view", _W + "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY loaded_at DESC NULLS LAST, coalesce(status, '') DESC, coalesce(title, '') DESC) AS rn FROM tawos_issue_search_document) WHERE rn = 1) SELECT coalesce(project_key, '') AS project_key, count(*) AS n_issues, count_if(coalesce(description_text, '') = '')::BIGINT AS n_without_text FROM latest GROUP BY 1")
def _(spark, d):
    """The search view (nulls as empty texts) over the newest row of every tracked record, read back with SQL."""
    S.search_view(S.latest(table(spark, d, "tawos_issue_search_document"), "loaded_at"), "issue_search")
    return spark.sql("SELECT project_key, count(*) AS n_issues, count_if(description_text = '') AS n_without_text FROM issue_search GROUP BY project_key")


@query("q_synthetic_dataset")
def _(spark, d):
    """A generated collection: every record with the number of its changes and of the days they fall on (rows only)."""
    made = SY.issues(spark, 500)
    days = SY.activity(SY.history(made)).groupBy("issue_id").agg(F.count("*").alias("n_days"), F.sum(F.size("events")).alias("n_changes"))
    return made.select("issue_id", "issue_key", "title", "status", "role", F.size("linked_issue_ids").alias("n_links")).join(days, "issue_id", "left")


@query("q_synthetic_labels", """SELECT * FROM (VALUES ('duplicate', 'high', 1, 500), ('linked', 'medium', 1, 500), ('hard_negative', 'low', 0, 500), ('random_negative', 'low', 0, 1000)) t(relationship_type, similarity_band, label, n)""")
def _(spark, d):
    """Pair labels of a generated collection by relationship."""
    return SY.pair_labels(SY.issues(spark, 500)).groupBy("relationship_type", "similarity_band", "label").agg(F.count("*").alias("n"))
