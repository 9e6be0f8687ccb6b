"""The model catalogue, the pipelines behind it, and benchmark suites."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.operators import blocks as B
from ticketloom.operators import candidates as C
from ticketloom.operators import features as X
from ticketloom.operators import graph as G
from ticketloom.operators import learn as L
from ticketloom.operators import random_indexing as RI
from ticketloom.operators import rerank as R
from ticketloom.operators.index import SearchIndex, ad_hoc_bags, ad_hoc_terms, lexical_scores, pair_scores, query_terms
from ticketloom.storage import materialize

#: The pools of the first stage.
POOL, SUPERVISED_POOL = 250, 80


@dataclass(frozen=True)
class ModelSpec:
    name: str
    family: str
    description: str
    needs_vectors: str | None = None
    supervised: bool = False
    uses_dense: bool = False


#: The names of the models.
MODELS: dict[str, ModelSpec] = {m.name: m for m in (
    ModelSpec("bm25", "sparse", "BM25 retrieval and a lexical linear reranker"),
    ModelSpec("bm25-plus", "sparse", "BM25+ retrieval and a lexical linear reranker"),
    ModelSpec("tfidf-cosine", "sparse", "TF-IDF cosine retrieval and a lexical linear reranker"),
    ModelSpec("lexical", "sparse", "BM25 retrieval with balanced lexical weights"),
    ModelSpec("logreg-engineered", "supervised", "coarse retrieval, 16 features, logistic regression", supervised=True),
    ModelSpec("random-indexing-dense", "dense", "random-indexing vectors trained on the corpus", uses_dense=True),
    ModelSpec("sbert-dense", "dense", "precomputed sentence vectors", needs_vectors="sbert"),
    ModelSpec("hybrid-sparse-dense", "hybrid", "reciprocal-rank fusion of BM25+ and dense vectors", uses_dense=True),
    ModelSpec("pairwise-neural-mlp", "neural", "fused retrieval, 17 features, a small network", supervised=True, uses_dense=True),
    ModelSpec("rag-hybrid-judge", "judge", "fused retrieval and a rule-based judge", uses_dense=True),
    ModelSpec("graph-metadata-aware", "graph", "fused retrieval spread over links and metadata", uses_dense=True),
    ModelSpec("llm-e5-large", "language", "precomputed transformer vectors", needs_vectors="e5"),
    ModelSpec("llm-e5-cross-reranker", "language", "transformer vectors and a pluggable pair scorer", needs_vectors="e5"),
)}

#: The lexical score that cuts a model's first pool.
_POOL_SCORES = {"bm25": "bm25", "lexical": "bm25", "bm25-plus": "bm25_plus", "tfidf-cosine": "tfidf_cosine", "logreg-engineered": "coarse"} | dict.fromkeys(
    ("hybrid-sparse-dense", "pairwise-neural-mlp", "rag-hybrid-judge", "graph-metadata-aware"), "bm25_plus")
#: The themes of the suites and their models.
_THEMES = {
    "sparse-lexical": (("tfidf-cosine", "bm25", "bm25-plus"), ()),
    "classical-ml": (("bm25", "bm25-plus", "logreg-engineered"), ()),
    "dense-semantic": (("bm25-plus", "logreg-engineered", "random-indexing-dense", "sbert-dense"), ()),
    "hybrid-sparse-dense": (("bm25-plus", "random-indexing-dense", "hybrid-sparse-dense"), ()),
    "deep-pairwise": (("hybrid-sparse-dense", "pairwise-neural-mlp"), ("logreg-engineered",)),
    "llm-rag": (("hybrid-sparse-dense", "rag-hybrid-judge"), ("pairwise-neural-mlp",)),
    "llm-transformer": (("bm25", "llm-e5-large", "llm-e5-cross-reranker"), ()),
    "graph-metadata": (("hybrid-sparse-dense", "rag-hybrid-judge", "graph-metadata-aware"), ()),
}
#: 16 suites: every theme for both tasks; the second group joins for duplicates only.
SUITES: dict[str, tuple[str, tuple[str, ...]]] = {
    f"{theme}-{task}": (task, models + (more if task == "duplicates" else ())) for theme, (models, more) in _THEMES.items() for task in ("similarity", "duplicates")
}


def resolve_models(names: Sequence[str] | None) -> list[str]:
    """Known model names in the order asked for, each once; None, 'all', 'all-runnable' and '*' mean all; ValueError for unknown ones."""
    if not names:
        return list(MODELS)
    out: list[str] = []
    for raw in names:
        name = raw.strip().lower()
        if name in ("all", "all-runnable", "*"):
            out += MODELS
        elif name in MODELS:
            out.append(name)
        else:
            raise ValueError(f"unknown model {raw!r}; known: {', '.join(MODELS)}")
    return list(dict.fromkeys(out))


@dataclass
class Session:
    """An index and a set of queries (qid), with the parts that pipelines share; each part is built once, when first used.

    Queries are records of the corpus, or new records: then `asked` holds them prepared (issue_id = qid), and
    query_vectors their vectors in the precomputed spaces. models: those that will be asked for, so that they share work.
    A pool of 0 is the default one.
    """

    index: SearchIndex
    queries: DataFrame
    vectors: dict[str, DataFrame] = field(default_factory=dict)
    pair_scorer: Callable | None = None
    pool: int = POOL
    exclude_query_edges: bool = False
    asked: DataFrame | None = None
    query_vectors: dict[str, DataFrame] = field(default_factory=dict)
    models: tuple[str, ...] = ()
    diagnostics: str | None = None
    _made: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.pool = self.pool or POOL

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = materialize(make(), name.replace(":", "-"))
        return self._made[name]

    def part(self, name: str, make: Callable):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def prepared(self) -> DataFrame:
        return self.index.prepared

    def terms(self) -> DataFrame:
        return self.once("terms", lambda: query_terms(self.index, self.queries) if self.asked is None else ad_hoc_terms(self.index, self.asked))

    def lexical(self) -> DataFrame:
        """Scores of all pairs that share a term; never written whole, only pools cut from it are."""
        return lexical_scores(self.index, self.terms())

    def lexical_pool(self, score: str, pool: int | None = None) -> DataFrame:
        n = pool or self.pool
        if n == self.pool and score in self.shared_scores():
            pools = self.once(f"pools:{n}", lambda: B.lexical_pools(self.index, self.terms(), self.shared_scores(), n))
            return pools.where(F.col("score_name") == score).drop("score_name")
        return self.once(f"pool:{score}:{n}", lambda: B.lexical_pools(self.index, self.terms(), [score], n).drop("score_name"))

    def shared_scores(self) -> list[str]:
        """The lexical scores of the models that this session serves, if there are several: their pools are cut in one pass."""
        scores = sorted({_POOL_SCORES[m] for m in self.models if m in _POOL_SCORES})
        return scores if len(scores) > 1 else []

    def query_rows(self) -> DataFrame:
        side = self.prepared if self.asked is None else self.asked
        return self.queries.join(side.select(F.col("issue_id").alias("qid"), F.coalesce("project_key", F.lit("")).alias("project_key")), "qid").select("qid", "project_key")

    def token_vectors(self) -> DataFrame:
        return self.once("tokens", lambda: RI.token_vectors(self.index))

    def dense_vectors(self) -> DataFrame:
        """Random-indexing vectors of the corpus, or those given as 'dense'."""
        return self.vectors.get("dense") or self.once("ri", lambda: RI.document_vectors(self.index, self.token_vectors()))

    def of_queries(self, space: str) -> DataFrame | None:
        """(issue_id, vector) of new records in a space; None if the queries are records of the corpus."""
        if self.asked is None:
            return None
        if space in self.query_vectors or space in self.vectors or space != "dense":
            return self.query_vectors[space]
        return self.once("asked-ri", lambda: RI.query_vectors(self.index, ad_hoc_bags(self.index, self.asked), self.token_vectors()))

    def sparse(self, score: str, pool: int | None = None) -> DataFrame:
        return C.with_fallback(self.lexical_pool(score, pool), self.query_rows(), self.prepared, pool or self.pool)

    def by_vector(self, space: str, positive: bool, pool: int | None = None) -> DataFrame:
        n = pool or self.pool
        v = self.dense_vectors() if space == "dense" else self.vectors[space]
        q = (v if self.asked is None else self.of_queries(space)).join(self.queries.select(F.col("qid").alias("issue_id")), "issue_id").select(F.col("issue_id").alias("qid"), "vector")
        return self.once(f"top:{space}:{n}", lambda: C.dense_topk(q, v, n, positive))

    def fused(self) -> DataFrame:
        return self.once("fused", lambda: C.reciprocal_rank_fusion(self.sparse("bm25_plus"), self.by_vector("dense", True), self.pool))

    def edges(self) -> DataFrame:
        return self.once("edges", lambda: G.link_edges(self.prepared))

    def candidates(self, model: str) -> DataFrame:
        """The ranked pool of a model, the query itself included."""
        if model in ("bm25", "lexical"):
            return self.sparse("bm25")
        if model in ("bm25-plus", "tfidf-cosine"):
            return self.sparse(model.replace("-", "_"))
        if model == "logreg-engineered":
            return C.with_fallback(self.lexical_pool("coarse"), self.query_rows(), self.prepared, self.pool).where(F.col("rank") <= SUPERVISED_POOL)
        if model == "random-indexing-dense":
            return C.with_fallback(self.by_vector("dense", True), self.query_rows(), self.prepared, self.pool)
        if model == "sbert-dense":
            return self.by_vector("sbert", False)
        if model in ("llm-e5-large", "llm-e5-cross-reranker"):
            found = self.by_vector("e5", False)
            return found if model == "llm-e5-large" else found.where(F.col("rank") <= SUPERVISED_POOL)
        if model == "graph-metadata-aware":
            return self.once("graph", lambda: G.graph_candidates(self.fused(), self.prepared, self.queries, self.edges(), self.pool, self.exclude_query_edges, self.asked))
        return self.fused().where(F.col("rank") <= SUPERVISED_POOL) if model == "pairwise-neural-mlp" else self.fused()

    def features(self, model: str, candidates: DataFrame) -> DataFrame:
        carried = set(C.LEXICAL) <= set(candidates.columns)
        pairs = X.pair_rows(candidates, None if carried else pair_scores(self.index, self.terms(), candidates), self.prepared, self.asked)
        cosine = lambda rows: X.with_cosine(rows, self.dense_vectors(), query_vectors=self.of_queries("dense"))
        if model == "logreg-engineered":
            return X.engineered(pairs)
        if model == "random-indexing-dense":
            return cosine(X.standard(pairs))
        if model == "sbert-dense":
            return X.with_cosine(X.standard(pairs), self.vectors["sbert"], "sbert_cosine", self.of_queries("sbert"))
        if model == "hybrid-sparse-dense":
            return X.hybrid(cosine(X.standard(pairs)))
        if model == "pairwise-neural-mlp":
            return cosine(X.engineered(pairs))
        if model == "rag-hybrid-judge":
            return X.rag(cosine(X.engineered(pairs)))
        if model == "graph-metadata-aware":
            context = G.graph_context(candidates, self.prepared, self.edges(), self.exclude_query_edges, self.asked)
            return X.graph(cosine(X.standard(pairs)), context)
        if model == "llm-e5-large":
            return X.embedding_seed(X.standard(pairs))
        if model == "llm-e5-cross-reranker":
            return X.cross_score(X.standard(pairs), self.pair_scorer)
        return X.standard(pairs)

    def training_depth(self) -> int:
        """Candidates that the query with most positives is trained with."""
        return self.part("deepest", lambda: L.pool_sizes(L.related_pairs(self.prepared)).agg(F.max("pool")).first()[0]) or L.TRAINING_POOL

    def training_candidates(self, model: str, holdout: DataFrame | None = None) -> DataFrame:
        """The ranked pool of a supervised model for its training, as deep as the positives of each query ask for, whatever the search pool is."""
        most = self.training_depth()
        sizes = L.pool_sizes(L.related_pairs(self.prepared, holdout))
        cut = lambda ranked: ranked.join(sizes, "qid").where(F.col("rank") <= F.col("pool")).drop("pool")
        if model == "logreg-engineered":
            return cut(self.sparse("coarse", most))
        return cut(C.reciprocal_rank_fusion(cut(self.sparse("bm25_plus", most)), cut(self.by_vector("dense", True, most)), most))

    def training(self, model: str, holdout: DataFrame | None = None) -> DataFrame:
        """Training pairs of a supervised model with its features, over the queries of this session; a search pool below the training pool limits the seeds of positives."""
        found = self.training_candidates(model, holdout)
        seeds = found.where(F.col("rank") <= self.pool) if self.pool < L.TRAINING_POOL else found
        pairs = materialize(L.training_pairs(self.prepared, found, holdout=holdout, seeds=seeds).withColumn("rank", F.lit(0)), "pairs")
        # Most pairs are in the lexical pool that the candidates come from, with their scores; only the others' are summed.
        pool = self.sparse(_POOL_SCORES[model], self.training_depth()).select("qid", "issue_id", *C.LEXICAL)
        known = materialize(pairs.join(pool, ["qid", "issue_id"], "left"), "known")
        others = known.where("bm25 IS NULL").drop(*C.LEXICAL)
        others = others.join(pair_scores(self.index, self.terms(), others), ["qid", "issue_id"], "left").fillna(0.0, list(C.LEXICAL))
        return self.features(model, known.where("bm25 IS NOT NULL").unionByName(others))

    def reranker(self, model: str, holdout: DataFrame | None = None) -> R.Reranker:
        if model == "logreg-engineered":
            m = L.fit_logistic(self.training(model, holdout), X.ENGINEERED)
            return R.logistic(m.weights, m.bias)
        if model == "pairwise-neural-mlp":
            m = L.fit_mlp(self.training(model, holdout), X.NEURAL)
            if self.diagnostics:
                L.write_diagnostics(m, self.prepared.sparkSession, f"{self.diagnostics}/{model}")
            return R.neural(m.names, m.hidden, m.hidden_bias, m.out, m.out_bias)
        fixed = {"random-indexing-dense": R.dense, "sbert-dense": R.sbert, "rag-hybrid-judge": R.judge, "graph-metadata-aware": R.graph, "llm-e5-large": R.e5, "llm-e5-cross-reranker": R.cross}
        return fixed.get(model) or R.linear(R.LINEAR_WEIGHTS[model], 0.05 if model == "hybrid-sparse-dense" else 0.08)

    def compared(self, model: str) -> DataFrame:
        """Pairs of other issues with the standard features, for models that read nothing else; the pools are neither written nor joined with the records."""
        rows = B.lexical_pools(self.index, self.terms(), [_POOL_SCORES[model]], self.pool, True)
        pairs = X.standard_compared(rows.where(~F.col("same_key") & (F.col("qid") != F.col("issue_id"))))
        # A query without terms has no candidates but those of its project.
        rest = self.query_rows().join(self.terms().select("qid").distinct(), "qid", "left_anti")
        nothing = self.prepared.sparkSession.createDataFrame([], "qid long, issue_id long, seed double, rank int, " + ", ".join(f"{c} double" for c in C.LEXICAL))
        fallback = X.other_issue(self.features(model, C.exclude_self(C.with_fallback(nothing, rest, self.prepared, self.pool))))
        columns = ["qid", "issue_id", *X.STANDARD]
        return pairs.select(*columns).unionByName(fallback.select(*columns))

    def available(self, model: str) -> bool:
        """Whether what the model needs is there: precomputed vectors, also those of new records, and for the cross reranker a pair scorer."""
        need = MODELS[model].needs_vectors or ("dense" if MODELS[model].uses_dense and "dense" in self.vectors else None)
        return (need is None or need in self.vectors and (self.asked is None or need in self.query_vectors)) and (model != "llm-e5-cross-reranker" or self.pair_scorer is not None)

    def ranked(self, model: str, top_k: int = 10, reranker: R.Reranker | None = None) -> DataFrame:
        """qid, issue_id, rank, score, reasons: pool, without the query itself, features, rerank, the best top_k by score, then id."""
        if not self.available(model):
            raise RuntimeError(f"model {model!r} is known but what it needs is not available")
        if MODELS[model].family == "sparse" and self.asked is None and not self.models:
            pairs = self.compared(model)
        else:
            found = self.candidates(model)
            pairs = X.other_issue(self.features(model, C.exclude_self(found) if self.asked is None else found), self.asked is None)
        scored = (reranker or self.part(f"model:{model}", lambda: self.reranker(model)))(pairs).select("qid", "issue_id", "score", "reasons")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "issue_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
