"""Queries of the training-data operators, with the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketloom.llm import components, corpus_tokens, distinctive_terms, markup, mixing, near_duplicates, neighbours, rank_fusion, shared_spans
from ticketloom.operators.candidates import dense_topk
from ticketloom.storage import materialize, table

WEIGHTS = {"seed_score": 1.0} | {f: 1.0 for f in rank_fusion.FEATURES}


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = rank_fusion.candidate_scores(table(spark, sf_dir, "candidate_match"), table(spark, sf_dir, "rerank_result"))
    return rank_fusion.aggregate_ranks(items, ["query_id"], "issue_id", WEIGHTS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_fusion.best_by_mean(_ranks(spark, sf_dir), ["query_id"], "issue_id")


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_fusion.final_ranks(_ranks(spark, sf_dir), ["query_id"], "issue_id").withColumn("mean_position", F.round("mean_position", 6))


_P1 = """
WITH pairs AS (SELECT query_id, issue_id, max(CASE WHEN NOT isnan(seed_score) THEN seed_score END) AS seed_score FROM candidate_match GROUP BY 1, 2),
latest AS (
  SELECT * FROM (SELECT query_id, issue_id, feature_scores AS f, row_number() OVER (PARTITION BY query_id, issue_id ORDER BY scored_at DESC) AS rn FROM rerank_result) WHERE rn = 1),
long AS (
""" + " UNION ALL ".join(
    f"SELECT p.query_id, p.issue_id, '{f}' AS score_name, "
    + ("seed_score" if f == "seed_score" else f"CASE WHEN NOT isnan(l.f['{f}']) THEN l.f['{f}'] END")
    + " AS v FROM pairs p LEFT JOIN latest l USING (query_id, issue_id)" for f in WEIGHTS
) + """),
ranked AS (
  SELECT query_id, issue_id, score_name, CASE WHEN v IS NULL THEN count(*) OVER (PARTITION BY query_id, score_name)
         ELSE rank() OVER (PARTITION BY query_id, score_name ORDER BY v DESC NULLS LAST) END AS position FROM long),
merged AS (SELECT query_id, issue_id, quantile_disc(position, 0.5) AS median_position, sum(position) / 7.0 AS mean_position FROM ranked GROUP BY 1, 2)
"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = distinctive_terms.term_scores(table(spark, sf_dir, "prepared_issue"))
    return distinctive_terms.top_term(scores, "tfidf").select("issue_id", "term")


def p7_distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = distinctive_terms.term_scores(table(spark, sf_dir, "prepared_issue")).withColumn("distinctiveness", F.round("distinctiveness", 6))
    return distinctive_terms.top_term(scores, "distinctiveness")


def p7_collection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms.collection_frequency(table(spark, sf_dir, "search_index"))


_P7 = """
WITH latest AS (
  SELECT issue_id, term_frequency AS tf FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY prepared_at DESC) AS rn FROM prepared_issue) WHERE rn = 1),
postings AS (SELECT issue_id, e.key AS term, e.value AS tf FROM (SELECT issue_id, unnest(map_entries(tf)) AS e FROM latest) WHERE e.value > 0),
n AS (SELECT count(DISTINCT issue_id) AS n FROM postings),
stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM postings GROUP BY 1),
scored AS (
  SELECT issue_id, p.term, round((1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1), 6) AS tfidf,
         round(tf * (log2(n / df) + log2(1 - exp(-cf / n))), 6) AS distinctiveness
  FROM postings p JOIN stats USING (term), n)
"""


def _words_of():
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description_text", F.lit("")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "issue_document"), "issue_id", _words_of(), 0.7, 20)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "issue_document"), "issue_id", _words_of(), 0.7, 20)


_P3 = """
WITH sets AS (
  SELECT DISTINCT issue_id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description_text, '')), '[a-z0-9_]+'))) AS w FROM issue_document),
big AS (SELECT * FROM sets WHERE len(w) >= 20),
classes AS (SELECT *, row_number() OVER (ORDER BY class_id, w) AS c, len(w) AS n FROM (SELECT w, min(issue_id) AS class_id, count(DISTINCT issue_id) AS n_members FROM big GROUP BY w)),
terms AS (SELECT c, unnest(w) AS t FROM classes),
shared AS (SELECT a.c AS c, b.c AS d, count(*) AS s FROM terms a JOIN terms b USING (t) WHERE a.c <> b.c GROUP BY 1, 2),
near AS (SELECT c, d FROM shared JOIN classes x USING (c) JOIN classes y ON y.c = d WHERE s >= 0.7 * (x.n + y.n - s)),
member AS (SELECT DISTINCT issue_id, c FROM big JOIN classes USING (w))
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = components.tied_edges(table(spark, sf_dir, "tawos_issue_search_document"), ["duplicate_issue_ids", "linked_issue_ids"])
    return components.connected_components(edges).select(F.col("id").alias("issue_id"), "group_id")


def p5_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_members"))


_P5 = r"""
WITH RECURSIVE tokens AS (
  SELECT issue_id, unnest(string_split(linked_issue_ids, '||')) AS token FROM tawos_issue_search_document
  UNION ALL SELECT issue_id, unnest(string_split(duplicate_issue_ids, '||')) FROM tawos_issue_search_document),
pairs AS (SELECT DISTINCT issue_id AS u, try_cast(regexp_extract(token, '([0-9]+)[\s\p{Z}]*$', 1) AS BIGINT) AS v FROM tokens),
tied AS (SELECT u, v FROM pairs WHERE u <> v AND v IN (SELECT issue_id FROM tawos_issue_search_document)),
edges AS (SELECT u, v FROM tied UNION SELECT v, u FROM tied),
reach(id, other) AS (SELECT u, v FROM edges UNION SELECT r.id, e.v FROM reach r JOIN edges e ON e.u = r.other),
groups AS (SELECT id AS issue_id, least(id, min(other)) AS group_id FROM reach GROUP BY id)
"""


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_tokens.token_counts(table(spark, sf_dir, "documents"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document decoded from its ids; equals its text (null as empty)."""
    return corpus_tokens.decode_corpus(p8_ids(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = corpus_tokens.token_counts(table(spark, sf_dir, "documents"), keep=("source",))
    return mixing.mix(counted, table(spark, sf_dir, "source_weights"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, sf_dir))


def p9_kept_promises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether caps and shares are kept, for the largest total that meets every share, and for the whole corpus's tokens as total, at which caps bind."""
    counted = materialize(corpus_tokens.token_counts(table(spark, sf_dir, "documents"), keep=("source",)), "counted")
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    weights = table(spark, sf_dir, "source_weights")
    parts = [mixing.kept_promises(*mixing.mix(counted, weights, t)).select(F.lit(name).alias("total"), "*") for name, t in (("largest", None), ("given", total))]
    return parts[0].unionByName(parts[1])


def p9_everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of a total that no source can reach: every document as often as its source allows."""
    counted = corpus_tokens.token_counts(table(spark, sf_dir, "documents"), keep=("source",))
    return mixing.mix(counted, table(spark, sf_dir, "source_weights"), 10**15)[0].select("doc_id", "source", "repeats")


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 most similar others of every usable vector, in both spaces."""
    dense = neighbours.usable_vectors(table(spark, sf_dir, "dense_embedding_space"), "issue_id", "document_vector", 192, "dense")
    sbert = neighbours.usable_vectors(table(spark, sf_dir, "sbert_embedding_space"), "issue_id", "embedding", 64, "sbert")
    return neighbours.nearest([dense, sbert], 3).withColumn("rank", F.col("rank").cast("bigint"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(p6_neighbours(spark, sf_dir), 0.85)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.issue_texts(table(spark, sf_dir, "tawos_issue_search_document"), table(spark, sf_dir, "issue_document"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.elements(_texts(spark, sf_dir), ["field_name", "issue_id", "item_no"])
    return found.select("field_name", "issue_id", "item_no", "kind", "content")


def p4_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_text(_texts(spark, sf_dir), ["field_name", "issue_id", "item_no"])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "documents"))


def p10_shared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shared_spans.shared_parts(docs, shared_spans.shared_spans(docs))


def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact 3 nearest that the graphs find, by space, for every vector whose id is divisible by 100 against all."""
    parts = None
    for space, name, column, d in (("dense", "dense_embedding_space", "document_vector", 192), ("sbert", "sbert_embedding_space", "embedding", 64)):
        rows = materialize(neighbours.usable_vectors(table(spark, sf_dir, name), "issue_id", column, d, space), space)
        asked = rows.where(F.col("id") % 100 == 0)
        v = F.col("vector").cast("array<double>").alias("vector")
        exact = dense_topk(asked.select(F.col("id").alias("qid"), v), rows.select(F.col("id").alias("issue_id"), v), 4, positive=False).where("qid <> issue_id")
        exact = exact.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("place <= 3")
        found = neighbours.nearest([rows], 3).select(F.col("id").alias("qid"), F.col("other").alias("issue_id"), F.lit(1).alias("hit"))
        part = exact.join(found, ["qid", "issue_id"], "left").agg(F.lit(space).alias("space_name"), F.count_distinct("qid").alias("n_queries"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def p6_recall_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the recall of p6_recall is 0.9 at least, by space."""
    return p6_recall(spark, sf_dir).select("space_name", "n_queries", (F.col("recall") >= 0.9).alias("reached"))


QUERIES = {
    "p10_found": p10_found, "p10_shared_parts": p10_shared_parts,
    "p4_found": p4_found, "p4_clean_text": p4_clean_text,
    "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p6_recall": p6_recall, "p6_recall_reached": p6_recall_reached,
    "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_kept_promises": p9_kept_promises, "p9_everything": p9_everything,
    "p3_found": p3_found, "p3_classes": p3_classes,
    "p5_found": p5_found, "p5_group_sizes": p5_group_sizes,
    "p8_ids": p8_ids, "p8_token_counts": p8_token_counts, "p8_round_trip": p8_round_trip,
    "p1_found": p1_found, "p1_ranking": p1_ranking,
    "p7_found": p7_found, "p7_distinctive": p7_distinctive, "p7_collection_frequency": p7_collection_frequency,
}
_P6 = """
        WITH raw AS (SELECT 'dense' AS space_name, issue_id, document_vector AS v FROM dense_embedding_space WHERE len(document_vector) = 192
          UNION ALL SELECT 'sbert', issue_id, embedding FROM sbert_embedding_space WHERE len(embedding) = 64),
        usable AS (SELECT space_name, issue_id, min(v)::DOUBLE[] AS v FROM raw WHERE len(list_filter(v, lambda x: isnan(x) OR x IS NULL)) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY 1, 2),
        scored AS (SELECT a.space_name, a.issue_id AS id, b.issue_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS s
          FROM usable a JOIN usable b ON a.space_name = b.space_name AND a.issue_id <> b.issue_id),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY space_name, id ORDER BY s DESC, other) AS rn FROM scored) WHERE rn <= 3)
        """
_P10 = """
        WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
        windows AS (SELECT doc_id, i, md5(substr(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM docs)),
        shared AS (SELECT h FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
        starts AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM windows WHERE h IN (SELECT h FROM shared)),
        runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM starts),
        spans AS (SELECT doc_id, min(i) AS span_start, max(i) + 200 AS span_end FROM runs GROUP BY doc_id, run)
        """

SQL = {
    "p9_kept_promises": """SELECT total, source, true AS cap_kept, true AS share_met FROM (SELECT DISTINCT source FROM source_weights WHERE target_weight > 0 AND max_repeats > 0),
        (SELECT unnest(['largest', 'given']) AS total) WHERE source IN (SELECT source FROM documents WHERE length(text) > 0)""",
    "p9_everything": """SELECT doc_id, source, max_repeats AS repeats FROM documents
        JOIN (SELECT source, max(max_repeats) AS max_repeats, max(target_weight) AS w FROM source_weights GROUP BY 1) USING (source) WHERE length(text) > 0 AND w > 0 AND max_repeats > 0""",
    "p6_neighbours": _P6 + "SELECT space_name AS space, id, other, s AS similarity, rn AS rank FROM best",
    "p6_recall_reached": _P6 + "SELECT space_name, count(*) AS n_queries, true AS reached FROM usable WHERE issue_id % 100 = 0 GROUP BY 1",
    "p10_found": _P10 + "SELECT doc_id, span_start, span_end FROM spans",
    "p10_shared_parts": _P10 + """, own AS (SELECT doc_id, count(*) AS n_spans, sum(span_end - span_start)::BIGINT AS shared_chars FROM spans GROUP BY 1)
        SELECT doc_id, length(text) AS n_chars, coalesce(n_spans, 0) AS n_spans, coalesce(shared_chars, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(shared_chars, 0) / length(text), 6) END AS shared_part
        FROM (SELECT DISTINCT doc_id, text FROM documents) LEFT JOIN own USING (doc_id)""",
    "p6_found": _P6 + "SELECT DISTINCT space_name, least(id, other) AS left_issue_id, greatest(id, other) AS right_issue_id FROM best WHERE s >= 0.85",
    "p3_found": _P3 + """SELECT DISTINCT least(a.issue_id, b.issue_id) AS left_issue_id, greatest(a.issue_id, b.issue_id) AS right_issue_id
        FROM (SELECT c, d FROM near UNION ALL SELECT c, c FROM classes) n JOIN member a ON a.c = n.c JOIN member b ON b.c = n.d WHERE a.issue_id <> b.issue_id""",
    "p3_classes": _P3 + """, links AS (SELECT c, count(*) AS n_links FROM near GROUP BY c)
        SELECT DISTINCT issue_id, class_id, n_members, coalesce(n_links, 0) AS n_links FROM member JOIN classes USING (c) LEFT JOIN links USING (c)""",
    "p5_found": _P5 + "SELECT issue_id, group_id FROM groups",
    "p5_group_sizes": _P5 + "SELECT group_id, count(*) AS n_members FROM groups GROUP BY 1",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p1_found": _P1 + """SELECT query_id, issue_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mean_position, median_position, issue_id) AS rn FROM merged) WHERE rn = 1""",
    "p1_ranking": _P1 + """SELECT query_id, issue_id, median_position, round(mean_position, 6) AS mean_position,
        row_number() OVER (PARTITION BY query_id ORDER BY median_position, mean_position, issue_id) AS final_rank FROM merged""",
    "p7_found": _P7 + "SELECT issue_id, term FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY tfidf DESC, term) AS rn FROM scored) WHERE rn = 1",
    "p7_distinctive": _P7 + "SELECT issue_id, term, distinctiveness FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY distinctiveness DESC, term) AS rn FROM scored) WHERE rn = 1",
    "p7_collection_frequency": """SELECT term, coalesce(sum(document_frequency), 0)::BIGINT AS document_frequency, count(DISTINCT segment_id) AS n_segments
        FROM (SELECT DISTINCT segment_id, term, document_frequency, doc_count FROM search_index) WHERE term IS NOT NULL GROUP BY 1""",
}
