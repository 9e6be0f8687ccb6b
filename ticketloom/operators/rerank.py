"""Rerankers: score columns in [0, 1] rounded to 6 decimals, with at most four reasons."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.text import clamp, relu, sigmoid

Reranker = Callable[[DataFrame], DataFrame]

#: The weights of the linear models.
LINEAR_WEIGHTS: dict[str, dict[str, float]] = {
    "bm25": {"bm25": 0.70, "bm25_plus": 0.12, "title_ngram": 0.10, "description_overlap": 0.08},
    "bm25-plus": {"bm25_plus": 0.62, "bm25": 0.18, "tfidf_cosine": 0.10, "title_ngram": 0.06, "description_overlap": 0.04},
    "tfidf-cosine": {"tfidf_cosine": 0.62, "bm25_plus": 0.18, "bm25": 0.10, "title_ngram": 0.06, "description_overlap": 0.04},
    "lexical": {"bm25": 0.62, "bm25_plus": 0.18, "tfidf_cosine": 0.10, "title_ngram": 0.06, "description_overlap": 0.04},
    "hybrid-sparse-dense": {"dense_cosine": 0.36, "bm25_plus": 0.24, "bm25": 0.10, "tfidf_cosine": 0.06, "title_ngram": 0.08, "description_overlap": 0.06, "candidate_seed": 0.06, "rrf_seed": 0.04},
    "random-indexing-dense": {"dense_cosine": 0.84, "title_ngram": 0.10, "description_overlap": 0.06},
    "sbert-dense": {"sbert_cosine": 0.80, "bm25_plus": 0.08, "title_ngram": 0.06, "description_overlap": 0.06},
    "graph-metadata-aware": {"bm25_plus": 0.16, "dense_cosine": 0.16, "metadata_alignment": 0.20, "graph_context": 0.20, "graph_seed": 0.08, "title_ngram": 0.08, "description_overlap": 0.06, "component_overlap": 0.06},
    "llm-e5-large": {"llm_embedding_cosine": 0.78, "title_ngram": 0.12, "description_overlap": 0.10},
    "llm-e5-cross-reranker": {"llm_cross_score": 0.90, "llm_embedding_cosine": 0.10},
}
#: The judge's weights.
JUDGE_WEIGHTS = {
    "dense_cosine": 0.24, "bm25_plus": 0.16, "title_ngram": 0.09, "description_overlap": 0.08, "component_overlap": 0.10, "project_match": 0.08,
    "issue_type_match": 0.06, "priority_match": 0.04, "candidate_seed": 0.05, "semantic_lexical_agreement": 0.05, "metadata_alignment": 0.05,
}
#: The texts that explain a feature.
LINEAR_TEXTS = {
    "bm25": "strong lexical overlap across issue text",
    "bm25_plus": "bm25-plus found strong sparse text similarity",
    "tfidf_cosine": "tf-idf cosine similarity is high",
    "title_ngram": "title wording is very similar",
    "description_overlap": "description tokens overlap heavily",
}
LOGISTIC_TEXTS = {
    "bm25": "strong lexical overlap supports the match",
    "bm25_plus": "bm25-plus indicates a close sparse-text match",
    "tfidf_cosine": "tf-idf cosine similarity is strong",
    "title_overlap": "title tokens overlap closely",
    "title_ngram": "title wording is very similar",
    "description_overlap": "description text overlaps strongly",
    "component_overlap": "component metadata is aligned",
    "project_match": "the issues belong to the same project",
    "issue_type_match": "issue types match",
    "priority_match": "priority metadata matches",
    "length_ratio": "issue lengths are similar",
}
NEURAL_TEXTS = {
    "dense_cosine": "neural duplicate model found strong semantic alignment",
    "bm25_plus": "sparse overlap still supports the pair strongly",
    "title_ngram": "title phrasing is closely aligned",
    "description_overlap": "descriptions share important duplicate signals",
    "component_overlap": "component metadata points to the same subsystem",
    "project_match": "both issues belong to the same project",
}
#: The rules that explain a score, each a condition with its text, and the text if none holds.
RULES: dict[str, tuple[tuple[tuple[str, str], ...], str]] = {
    "random-indexing-dense": ((
        ("dense_cosine >= 0.16", "dense semantic embeddings found a close meaning-level match"),
        ("title_ngram >= 0.10", "title wording is also similar"),
        ("description_overlap >= 0.08", "description text overlaps as well"),
    ), "dense semantic similarity was the primary ranking signal"),
    "sbert-dense": ((
        ("sbert_cosine >= 0.72", "SBERT embeddings found a strong semantic duplicate signal"),
        ("sbert_cosine >= 0.58 AND sbert_cosine < 0.72", "SBERT embeddings found moderate semantic similarity"),
        ("bm25_plus >= 0.22", "sparse lexical evidence also supports the pair"),
        ("title_ngram >= 0.10", "title wording is aligned"),
    ), "SBERT semantic similarity was the main ranking signal"),
    "graph-metadata-aware": ((
        ("graph_context >= 0.12", "graph neighbors connected to similar issues support this match"),
        ("metadata_alignment >= 0.22", "project, component, and issue metadata align closely"),
        ("dense_cosine >= 0.16", "semantic embeddings also place the issues close together"),
        ("bm25_plus >= 0.22", "sparse lexical evidence is still strong"),
    ), "graph and metadata evidence suggests only a weak connection"),
    "llm-e5-large": ((
        ("llm_embedding_cosine >= 0.65", "transformer embeddings found a strong semantic match"),
        ("title_ngram >= 0.12", "title wording is also closely aligned"),
        ("description_overlap >= 0.08", "description overlap further supports the match"),
    ), "transformer semantic similarity was the main ranking signal"),
    "llm-e5-cross-reranker": ((
        ("llm_cross_score >= 0.70", "cross-encoder judged this pair as a strong duplicate candidate"),
        ("llm_cross_score >= 0.55 AND llm_cross_score < 0.70", "cross-encoder found moderate duplicate evidence"),
        ("llm_cross_score < 0.55", "cross-encoder found weak duplicate evidence"),
        ("llm_embedding_cosine >= 0.65", "embedding retrieval also supports this candidate"),
    ), "cross-encoder found weak duplicate evidence"),
}
#: The judge's explanations; {score} is its clamped score. The last table is for matches without any, by least score.
JUDGE_RULES = (
    ("dense_cosine >= 0.20 AND bm25_plus >= 0.25", "rag-style reasoning found both semantic and lexical evidence for the same issue"),
    ("dense_cosine >= 0.20 AND bm25_plus < 0.25", "rag-style reasoning found a strong meaning-level match"),
    ("dense_cosine < 0.20 AND bm25_plus >= 0.25", "rag-style reasoning found strong textual overlap"),
    ("project_match >= 1 OR component_overlap >= 0.2 OR metadata_alignment >= 0.35", "retrieved project and component context supports the match"),
    ("title_ngram >= 0.12 OR description_overlap >= 0.10", "the retrieved issue language closely matches the new report"),
    ("retrieval_confidence < 0.12 AND {score} < 0.45", "retrieved evidence is thin, so the match should be reviewed carefully"),
)
JUDGE_OTHERWISE = (
    (0.55, "rag-style reasoning found moderate duplicate evidence across the retrieved context"),
    (0.35, "rag-style reasoning found this issue related, but not strongly confirmed as a duplicate"),
    (0.0, "rag-style reasoning found only weak support for this candidate"),
)
#: What the fitted models say when no feature stands out; the network's first text is for scores of 0.5 and more.
LOGISTIC_OTHERWISE = "the engineered feature model found a moderate overall match"
NEURAL_OTHERWISE = ("the neural duplicate classifier found a strong overall pairwise match", "the neural duplicate classifier found only weak duplicate evidence")


def weighted_sum(weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.col(name)
    return total


def ranked_reasons(texts: Mapping[str, str], key: Callable[[str], Column], passes: Callable[[str], Column]) -> Column:
    """Texts of the features that pass, largest key first (ties in the order of `texts`), four at most."""
    rows = F.array(*[F.when(passes(n), F.struct((-key(n)).alias("k"), F.lit(i).alias("i"), F.lit(t).alias("t"))) for i, (n, t) in enumerate(texts.items())])
    return F.slice(F.transform(F.array_sort(F.array_compact(rows)), lambda r: r["t"]), 1, 4)


def rule_reasons(rules: Sequence[tuple[Column, str]], otherwise: Column) -> Column:
    """Texts of the rules that hold, in order, four at most; else the one text of `otherwise`."""
    held = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return F.slice(F.when(F.size(held) > 0, held).otherwise(F.array(otherwise)), 1, 4)


def linear(weights: Mapping[str, float], threshold: float = 0.08) -> Reranker:
    """Clamped weighted sum; reasons by weighted value from features of at least the threshold."""
    texts = {n: t for n, t in LINEAR_TEXTS.items() if weights.get(n, 0) > 0}

    def run(pairs: DataFrame) -> DataFrame:
        reasons = ranked_reasons(texts, lambda n: F.col(n) * weights[n], lambda n: F.col(n) >= threshold)
        return pairs.withColumn("score", F.round(clamp(weighted_sum(weights)), 6)).withColumn("reasons", reasons)

    return run


def _by_rules(model: str) -> Reranker:
    """Clamped weighted sum with the reasons of RULES."""
    table, otherwise = RULES[model]

    def run(pairs: DataFrame) -> DataFrame:
        conditions = [(F.expr(c), t) for c, t in table]
        return pairs.withColumn("score", F.round(clamp(weighted_sum(LINEAR_WEIGHTS[model])), 6)).withColumn("reasons", rule_reasons(conditions, F.lit(otherwise)))

    return run


dense, sbert, graph, e5, cross = (_by_rules(m) for m in ("random-indexing-dense", "sbert-dense", "graph-metadata-aware", "llm-e5-large", "llm-e5-cross-reranker"))


def judge_score(penalty: float = 0.08) -> Column:
    """The judge's score before clamping: a weighted sum, three bonuses for agreeing evidence, two penalties for its absence."""
    c = F.col
    bonus = lambda cond, v: F.when(cond, v).otherwise(0.0)
    return (
        weighted_sum(JUDGE_WEIGHTS)
        + bonus((c("dense_cosine") >= 0.22) & (c("bm25_plus") >= 0.28), 0.10)
        + bonus((c("semantic_lexical_agreement") >= 0.28) & (c("metadata_alignment") >= 0.40), 0.08)
        + bonus((c("retrieval_confidence") >= 0.40) & (c("metadata_alignment") >= 0.30), 0.04)
        - bonus((c("project_match") == 0) & (c("component_overlap") == 0) & (c("dense_cosine") < 0.14), penalty)
        - bonus((c("issue_type_match") == 0) & (c("retrieval_confidence") < 0.16), 0.04)
    )


def judge(pairs: DataFrame, penalty: float = 0.08) -> DataFrame:
    """The judge's score with the reasons of JUDGE_RULES."""
    scored = pairs.withColumn("__s", clamp(judge_score(penalty)))
    rules = [(F.expr(c.format(score="__s")), t) for c, t in JUDGE_RULES]
    otherwise = F.coalesce(*[F.when(F.col("__s") >= least, F.lit(t)) for least, t in JUDGE_OTHERWISE])
    return scored.withColumn("score", F.round("__s", 6)).withColumn("reasons", rule_reasons(rules, otherwise)).drop("__s")


def logistic(weights: Mapping[str, float], bias: float, threshold: float = 0.06) -> Reranker:
    """Probability of a logistic model; reasons from contributions above the threshold."""
    texts = {n: t for n, t in LOGISTIC_TEXTS.items() if n in weights}

    def run(pairs: DataFrame) -> DataFrame:
        found = ranked_reasons(texts, lambda n: F.col(n) * weights[n], lambda n: F.col(n) * weights[n] > threshold)
        reasons = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(LOGISTIC_OTHERWISE)))
        return pairs.withColumn("score", F.round(sigmoid(F.lit(bias) + weighted_sum(weights)), 6)).withColumn("reasons", reasons)

    return run


def mlp_probability(names: Sequence[str], hidden: Sequence[Sequence[float]], hidden_bias: Sequence[float], out: Sequence[float], out_bias: float) -> Column:
    """One hidden layer of rectified units and a sigmoid output, as a column expression over the weights."""
    total = F.lit(float(out_bias))
    for w, b, o in zip(hidden, hidden_bias, out):
        total = total + F.lit(float(o)) * relu(F.lit(float(b)) + weighted_sum(dict(zip(names, map(float, w)))))
    return sigmoid(total)


def neural(names: Sequence[str], hidden, hidden_bias, out, out_bias, threshold: float = 0.08) -> Reranker:
    """Probability of a small network; reasons from the raw features."""

    def run(pairs: DataFrame) -> DataFrame:
        scored = pairs.withColumn("score", F.round(mlp_probability(names, hidden, hidden_bias, out, out_bias), 6))
        found = ranked_reasons({n: t for n, t in NEURAL_TEXTS.items() if n in names}, F.col, lambda n: F.col(n) >= threshold)
        weak = F.when(F.col("score") >= 0.5, NEURAL_OTHERWISE[0]).otherwise(NEURAL_OTHERWISE[1])
        return scored.withColumn("reasons", F.when(F.size(found) > 0, found).otherwise(F.array(weak)))

    return run
