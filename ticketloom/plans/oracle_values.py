"""Values that the SQL checks the engine with: weights, rules and words, stated apart from the engine's own so that a wrong one shows."""

from __future__ import annotations

#: The stop words.
STOPWORDS = "a an and are as at be by for from in is it of on or that the this to when with".split()
#: The weights of the linear models and of the judge.
LINEAR_WEIGHTS = {
    "bm25": {"bm25": 0.7, "bm25_plus": 0.12, "title_ngram": 0.1, "description_overlap": 0.08},
    "bm25-plus": {"bm25_plus": 0.62, "bm25": 0.18, "tfidf_cosine": 0.1, "title_ngram": 0.06, "description_overlap": 0.04},
    "tfidf-cosine": {"tfidf_cosine": 0.62, "bm25_plus": 0.18, "bm25": 0.1, "title_ngram": 0.06, "description_overlap": 0.04},
    "lexical": {"bm25": 0.62, "bm25_plus": 0.18, "tfidf_cosine": 0.1, "title_ngram": 0.06, "description_overlap": 0.04},
    "hybrid-sparse-dense": {"dense_cosine": 0.36, "bm25_plus": 0.24, "bm25": 0.1, "tfidf_cosine": 0.06, "title_ngram": 0.08, "description_overlap": 0.06, "candidate_seed": 0.06, "rrf_seed": 0.04},
    "random-indexing-dense": {"dense_cosine": 0.84, "title_ngram": 0.1, "description_overlap": 0.06},
    "sbert-dense": {"sbert_cosine": 0.8, "bm25_plus": 0.08, "title_ngram": 0.06, "description_overlap": 0.06},
    "graph-metadata-aware": {"bm25_plus": 0.16, "dense_cosine": 0.16, "metadata_alignment": 0.2, "graph_context": 0.2, "graph_seed": 0.08, "title_ngram": 0.08, "description_overlap": 0.06, "component_overlap": 0.06},
    "llm-e5-large": {"llm_embedding_cosine": 0.78, "title_ngram": 0.12, "description_overlap": 0.1},
    "llm-e5-cross-reranker": {"llm_cross_score": 0.9, "llm_embedding_cosine": 0.1},
}
JUDGE_WEIGHTS = {"dense_cosine": 0.24, "bm25_plus": 0.16, "title_ngram": 0.09, "description_overlap": 0.08, "component_overlap": 0.1, "project_match": 0.08, "issue_type_match": 0.06, "priority_match": 0.04, "candidate_seed": 0.05, "semantic_lexical_agreement": 0.05, "metadata_alignment": 0.05}
#: The texts that explain a feature.
LINEAR_TEXTS = {
    "bm25": "strong lexical overlap across issue text",
    "bm25_plus": "bm25-plus found strong sparse text similarity",
    "tfidf_cosine": "tf-idf cosine similarity is high",
    "title_ngram": "title wording is very similar",
    "description_overlap": "description tokens overlap heavily",
}
#: The rules that explain a score, in order, and the text if none holds.
RULES = {
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
