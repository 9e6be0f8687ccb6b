"""The engine: search, duplicates, comparison and evaluation over an indexed collection."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.config import Settings
from ticketloom.operators import evaluate as E
from ticketloom.operators.embedding import embed
from ticketloom.operators.index import build_index, prepare
from ticketloom.plans.pipelines import MODELS, POOL, SUITES, ModelSpec, Session, resolve_models
from ticketloom.sources.issues import SCHEMA, normalize, repository
from ticketloom.storage import materialize

log = logging.getLogger(__name__)
#: Parts of a session that belong to the corpus and serve every session.
_SHARED = ("ri", "tokens", "edges")


class Engine:
    """vectors: precomputed spaces by name ('sbert', 'e5', 'dense') as (issue_id, vector array<double>); pair_scorer: a column function of two texts for the cross reranker.

    encoders: by space a function that loads an encoder of texts (see operators.embedding.embed), for new records.
    exclude_query_edges: keeps a query's own links out of the graph evidence, so an evaluation does not see its labels.
    diagnostics: a folder that gets the loss curve of every network fitted; None writes none.
    """

    def __init__(self, issues: DataFrame, vectors: dict[str, DataFrame] | None = None, pair_scorer: Callable | None = None, pool: int = POOL,
                 encoders: dict[str, Callable] | None = None, exclude_query_edges: bool = False, diagnostics: str | None = None):
        self.issues = normalize(issues).cache()
        self.index = build_index(self.issues)
        self.vectors, self.pair_scorer, self.pool = dict(vectors or {}), pair_scorer, pool or POOL
        self.encoders, self.exclude_query_edges, self.diagnostics = dict(encoders or {}), exclude_query_edges, diagnostics
        # Vectors learnt from the corpus and fitted models serve all later queries; a Session's parts hold what belongs to its queries.
        self._models: dict = {}

    @classmethod
    def from_source(cls, spark: SparkSession, settings: Settings, **options) -> "Engine":
        if settings.source in ("jdbc", "mysql"):
            login = {k: v for k, v in (("user", settings.jdbc_user), ("password", settings.jdbc_password)) if v}
            repo = repository(settings.source, url=settings.jdbc_url, properties=login, comment_limit=settings.comment_limit if settings.include_comments else None, limit=settings.limit, partitions=settings.partitions)
        elif settings.source == "json":
            repo = repository("json", path=settings.path, limit=settings.limit)
        else:
            repo = repository(settings.source, **({"path": settings.path} if settings.source == "parquet" else {}))
        return cls(repo.load(spark), pool=settings.pool, **{"diagnostics": f"{settings.results_dir}/diagnostics" if settings.diagnostics else None, **options})

    @property
    def catalog(self) -> dict[str, ModelSpec]:
        return MODELS

    def session(self, queries: DataFrame) -> Session:
        s = Session(self.index, queries, dict(self.vectors), self.pair_scorer, self.pool, self.exclude_query_edges, diagnostics=self.diagnostics)
        s._made.update({k: self._models[k] for k in _SHARED if k in self._models})
        return s

    def runnable(self, models: Sequence[str] | None = None, session: Session | None = None) -> list[str]:
        """The models asked for whose needs are met; the others are skipped with a warning, but RuntimeError if none is left."""
        probe = session or self.session(self.issues.select(F.col("issue_id").alias("qid")))
        names = resolve_models(models)
        ready = [m for m in names if probe.available(m)]
        for m in names:
            if m not in ready:
                log.warning("model %s is skipped: what it needs is not available", m)
        if not ready:
            raise RuntimeError(f"none of the models can run: {', '.join(names)}")
        return ready

    def _reranker(self, model: str):
        """A supervised model is fitted once, on every labelled record."""
        if not MODELS[model].supervised:
            return None
        if model not in self._models:
            asks = self.index.prepared.where((F.size("linked_issue_ids") > 0) | (F.size("duplicate_issue_ids") > 0)).select(F.col("issue_id").alias("qid"))
            self._models[model] = self.session(asks).reranker(model)
        return self._models[model]

    def _ranked(self, session: Session, model: str, top_k: int) -> DataFrame:
        if model not in MODELS:
            raise ValueError(f"unknown model {model!r}; known: {', '.join(MODELS)}")
        out = session.ranked(model, top_k, self._reranker(model))
        self._models.update({k: session._made[k] for k in _SHARED if k in session._made})
        return out

    def search(self, queries: DataFrame, model: str = "bm25", top_k: int = 10) -> DataFrame:
        """Best matches of records of the corpus (queries: qid): qid, issue_id, rank, score, reasons, issue_key, title."""
        return self._named(self._ranked(self.session(queries.select("qid").distinct()), model, top_k))

    def asking(self, records: DataFrame, query_vectors: dict[str, DataFrame] | None = None) -> Session:
        """A session of new records: the columns of the source schema, absent ones null; qid names each.

        query_vectors: their vectors (issue_id = qid, vector) in precomputed spaces; spaces with an encoder are encoded here.
        """
        have = dict(records.dtypes)
        full = normalize(records.select("qid", *[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in SCHEMA.split(", ")) if n != "issue_id"]))
        asked = materialize(prepare(full.withColumn("issue_id", F.col("qid"))), "asked")
        given = dict(query_vectors or {})
        for name, load in self.encoders.items():
            given.setdefault(name, materialize(embed(asked, load, "query: " if name == "e5" else ""), "encoded"))
        s = self.session(asked.select(F.col("issue_id").alias("qid")))
        s.asked, s.query_vectors = asked, given
        return s

    def search_new(self, records: DataFrame, model: str = "bm25", top_k: int = 10, query_vectors: dict[str, DataFrame] | None = None) -> DataFrame:
        """Best matches of new records by any model whose needs are met (see asking())."""
        return self._named(self._ranked(self.asking(records, query_vectors), model, top_k))

    def compare_new(self, records: DataFrame, models: Sequence[str] | None = None, top_k: int = 10, query_vectors: dict[str, DataFrame] | None = None) -> DataFrame:
        """search_new() of several models; those that cannot run are skipped with a warning."""
        session = self.asking(records, query_vectors)
        session.models = tuple(self.runnable(models, session))
        parts = [self._named(self._ranked(session, m, top_k)).withColumn("model", F.lit(m)) for m in session.models]
        return reduce(DataFrame.unionByName, parts)

    def _named(self, found: DataFrame) -> DataFrame:
        return found.join(self.issues.select("issue_id", "issue_key", "title"), "issue_id")

    def find_duplicates(self, queries: DataFrame, model: str = "bm25", top_k: int = 10, threshold: float = 0.55) -> DataFrame:
        return self.search(queries, model, top_k).where(F.col("score") >= threshold)

    def compare_models(self, queries: DataFrame, models: Sequence[str] | None = None, top_k: int = 10) -> DataFrame:
        session = self.session(queries.select("qid").distinct())
        session.models = tuple(self.runnable(models, session))
        return reduce(DataFrame.unionByName, [self._named(self._ranked(session, m, top_k)).withColumn("model", F.lit(m)) for m in session.models])

    def evaluate(self, task: str, models: Sequence[str] | None = None, sample_size: int | None = None, top_k_values: Sequence[int] = E.CUTOFFS, folds: int = 0) -> DataFrame:
        """(model, task, metric, k, value), and threshold metrics for duplicates (k: 100 * threshold).

        Labelled queries in ascending order, the first sample_size of them. With folds, supervised models are fitted
        once per fold (by a hash of the query) without that fold's records on either side of a training pair.
        """
        relevant = E.labels(self.index.prepared, task, sample_size).cache()
        session = self.session(relevant.select("qid").distinct())
        session.models = tuple(self.runnable(models))
        deepest, out = max(top_k_values), None
        for m in session.models:
            ranked = self._held_out(session, m, deepest, folds) if folds and MODELS[m].supervised else self._ranked(session, m, deepest)
            ranked = ranked.select("qid", "issue_id", "rank", "score").cache()
            part = E.rank_metrics(ranked, relevant, top_k_values)
            if task == "duplicates":
                t = E.threshold_metrics(ranked, relevant, deepest)
                cells = F.explode(F.array(*[F.struct(F.lit(f"threshold_{c}").alias("metric"), F.round(F.col("threshold") * 100).cast("int").alias("k"), F.col(c).alias("value")) for c in ("precision", "recall", "f1")]))
                part = part.unionByName(t.select(cells.alias("c")).select("c.*"))
            part = part.select(F.lit(m).alias("model"), F.lit(task).alias("task"), "metric", "k", "value")
            out = part if out is None else out.unionByName(part)
        return out

    def _held_out(self, session: Session, model: str, top_k: int, folds: int) -> DataFrame:
        everyone = self.session(self.index.prepared.where((F.size("linked_issue_ids") > 0) | (F.size("duplicate_issue_ids") > 0)).select(F.col("issue_id").alias("qid")))
        fold = lambda c: F.pmod(F.xxhash64(c), F.lit(folds))
        out = None
        for k in range(folds):
            fitted = everyone.reranker(model, self.index.prepared.where(fold("issue_id") == k).select("issue_id"))
            part = session.ranked(model, top_k, fitted).where(fold("qid") == k)
            out = part if out is None else out.unionByName(part)
        return out

    def run_suite(self, name: str, **options) -> tuple[DataFrame, list[str], list[str]]:
        """Metrics of a named suite, the models that ran and those that were skipped."""
        if name not in SUITES:
            raise ValueError(f"unknown suite {name!r}; known: {', '.join(SUITES)}")
        task, models = SUITES[name]
        ready = self.runnable(models)
        return self.evaluate(task, ready, **options), ready, [m for m in models if m not in ready]
