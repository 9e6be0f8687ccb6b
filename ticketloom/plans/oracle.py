"""SQL that states the engine's tables and scores for a second engine (DuckDB), built from named parts."""

from __future__ import annotations

from ticketloom.plans.oracle_values import JUDGE_WEIGHTS, LINEAR_TEXTS, LINEAR_WEIGHTS, STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9_\-]+', ' ', 'g'))"


def label(x: str) -> str:
    return f"nullif(replace({norm(x)}, ' ', '_'), '')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9_]+'), lambda w: w NOT IN ({_STOP}))"


def labels(x: str) -> str:
    return f"list_filter(list_transform({x}, lambda y: {label('y')}), lambda y: y IS NOT NULL)"


def texts(x: str) -> str:
    return f"list_filter(list_transform(coalesce({x}, []), lambda y: trim(y)), lambda y: y <> '')"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) ELSE 0 END"


def match(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} AND {a} <> '' THEN 1.0::DOUBLE ELSE 0.0 END"


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def weighted(weights: dict[str, float]) -> str:
    return " + ".join(["0.0", *[f"{w} * {n}" for n, w in weights.items()]])


ISSUES = f"""
raw AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY updated_at DESC NULLS LAST, coalesce(status, '') DESC, coalesce(title, '') DESC) AS rn FROM issue_document),
issues AS (SELECT issue_id, issue_key, project_key, title, description_text, issue_type, priority, status, resolution,
  {", ".join(f"list_sort(list_distinct({texts(c)})) AS {c}" for c in ("components", "affected_versions", "fix_versions"))}, {texts("comments")} AS comments,
  {", ".join(f"list_sort(list_distinct(coalesce({c}, []))) AS {c}" for c in ("linked_issue_ids", "duplicate_issue_ids"))} FROM raw WHERE rn = 1)"""

PREPARED = ISSUES + f""",
parts AS (SELECT *, {tokens("title")} AS t, {tokens("description_text")} AS d, flatten(list_transform(comments, lambda c: {tokens("c")})) AS m,
  {labels("components")} AS co, {labels("affected_versions")} AS av, {labels("fix_versions")} AS fv, {norm("title")} AS s,
  list_filter([{", ".join(label(c) for c in ("issue_type", "priority", "status", "project_key"))}], lambda y: y IS NOT NULL) AS meta FROM issues),
prepared AS MATERIALIZED (SELECT issue_id, issue_key, project_key, issue_type, priority, status, linked_issue_ids, duplicate_issue_ids,
  list_concat(list_concat(list_concat(list_concat(t, t), list_concat(t, d)), list_concat(m, list_concat(co, co))), list_concat(list_concat(av, fv), list_concat(meta, meta))) AS weighted_terms,
  list_distinct(t) AS title_terms, list_distinct(d) AS description_terms,
  CASE WHEN length(s) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(length(s) - 2, 1) + 1), lambda i: substr(s, i, 3))) END AS title_ngrams,
  list_distinct(co) AS component_terms, list_distinct(av) AS affected_version_terms, list_distinct(fv) AS fix_version_terms FROM parts),
sized AS (SELECT *, greatest(len(weighted_terms), 1) AS document_length FROM prepared)"""

INDEX = PREPARED + """,
bags AS (SELECT issue_id, term, count(*) AS tf FROM (SELECT issue_id, unnest(weighted_terms) AS term FROM prepared) GROUP BY 1, 2),
corpus AS (SELECT count(*) AS n, avg(document_length) AS avgdl FROM sized),
frequencies AS (SELECT term, count(*) AS df FROM bags GROUP BY 1),
postings AS MATERIALIZED (SELECT b.*, df, document_length, n, avgdl, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w
  FROM bags b JOIN frequencies USING (term) JOIN sized USING (issue_id), corpus),
norms AS (SELECT issue_id, sqrt(sum(w * w)) AS norm FROM postings GROUP BY 1)"""

SEARCH_QUERIES = "queries AS (SELECT issue_id AS qid FROM prepared WHERE issue_id % 100 = 0)"
EVERY_LABELLED = "queries AS (SELECT issue_id AS qid FROM prepared WHERE len(linked_issue_ids) > 0 OR len(duplicate_issue_ids) > 0)"


def lexical(queries: str = SEARCH_QUERIES) -> str:
    return INDEX + f""",
{queries},
lexical AS MATERIALIZED (SELECT q.issue_id AS qid, p.issue_id, sum(q.idf * least(q.tf, 3) * (p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.document_length / p.avgdl)))) AS bm25,
  sum(q.idf * least(q.tf, 3) * (p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.document_length / p.avgdl)) + 1)) AS bm25_plus,
  sum(q.w * p.w) / any_value(nq.norm * np.norm) AS tfidf_cosine, sum(q.idf * least(q.tf, 3) * least(p.tf, 3)) AS coarse
  FROM postings q JOIN queries ON qid = q.issue_id JOIN postings p USING (term) JOIN norms nq ON nq.issue_id = q.issue_id JOIN norms np ON np.issue_id = p.issue_id GROUP BY 1, 2)"""


def pool(name: str, source: str, score: str, size: int, where: str = "true") -> str:
    return f"""{name} AS MATERIALIZED (SELECT qid, issue_id, seed, rank FROM (SELECT qid, issue_id, {score} AS seed, row_number() OVER (PARTITION BY qid ORDER BY round({score}, 6) DESC, issue_id) AS rank FROM {source} WHERE {where}) WHERE rank <= {size})"""


VECTORS = """
vectors AS (SELECT space, issue_id, min(v)::DOUBLE[] AS v FROM (SELECT 'dense' AS space, issue_id, document_vector AS v FROM dense_embedding_space WHERE len(document_vector) = 192
    UNION ALL SELECT 'sbert', issue_id, embedding FROM sbert_embedding_space WHERE len(embedding) = 64)
  WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY 1, 2)"""


def cosines(space: str, positive: bool) -> str:
    return f"""cos_{space} AS (SELECT * FROM (SELECT a.issue_id AS qid, b.issue_id, list_cosine_similarity(a.v, b.v) AS c FROM vectors a JOIN queries ON qid = a.issue_id JOIN vectors b ON b.space = a.space WHERE a.space = '{space}') {"WHERE c > 0" if positive else ""})"""


#: Random-indexing vectors of the corpus, as token entries, co-occurrences, token vectors and document vectors.
RANDOM_ENTRIES = r"""
digests AS (SELECT term, substr(sha256(term), 1, 60) || substr(sha256(term || '#'), 1, 60) AS h FROM frequencies),
triples AS (SELECT term, i, ('0x' || substr(h, i * 6 + 1, 4))::INT % 192 AS dim, CASE WHEN ('0x' || substr(h, i * 6 + 5, 2))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS sign FROM digests, range(20) r(i)),
firsts AS (SELECT term, dim, arg_min(sign, i) AS sign, min(i) AS i FROM triples GROUP BY 1, 2),
entries AS MATERIALIZED (SELECT term, dim, sign FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY i) AS r FROM firsts) WHERE r <= 8)"""
COOCCURRENCE = """
seq AS (SELECT issue_id, unnest(weighted_terms) AS term, generate_subscripts(weighted_terms, 1) AS i FROM prepared),
cooc AS MATERIALIZED (SELECT a.term, b.term AS neighbour, sum(1.0::DOUBLE / abs(a.i - b.i)) AS weight FROM seq a JOIN seq b ON a.issue_id = b.issue_id AND b.i BETWEEN a.i - 3 AND a.i + 3 AND a.i <> b.i GROUP BY 1, 2)"""
TOKEN_VECTORS = """
mixed AS (SELECT term, dim, sum(v) AS v FROM (SELECT c.term, dim, 2 * weight * sign AS v FROM cooc c JOIN entries e ON e.term = neighbour UNION ALL SELECT term, dim, 0.35 * sign FROM entries) GROUP BY 1, 2),
unit AS MATERIALIZED (SELECT term, dim, v / norm AS value FROM mixed JOIN (SELECT term, sqrt(sum(v * v)) AS norm FROM mixed GROUP BY 1) USING (term) WHERE norm > 0)"""
RANDOM_DOCUMENTS = """
doc AS (SELECT issue_id, dim, sum((1 + ln(tf)) * idf * value) AS v FROM postings JOIN unit USING (term) GROUP BY 1, 2),
docs AS MATERIALIZED (SELECT issue_id, dim, v / norm AS v FROM doc JOIN (SELECT issue_id, sqrt(sum(v * v)) AS norm FROM doc GROUP BY 1) USING (issue_id) WHERE norm > 0)"""
RANDOM_VECTORS = ",".join([RANDOM_ENTRIES, COOCCURRENCE, TOKEN_VECTORS, RANDOM_DOCUMENTS, """
vectors AS MATERIALIZED (SELECT 'dense' AS space, i.issue_id, list(coalesce(d.v, 0.0) ORDER BY k) AS v FROM (SELECT DISTINCT issue_id FROM docs) i CROSS JOIN range(192) r(k) LEFT JOIN docs d ON d.issue_id = i.issue_id AND d.dim = k GROUP BY 2)"""])


def fused(size: int, vectors: str = VECTORS) -> str:
    return ",\n".join([
        pool("sparse", "lexical", "bm25_plus", size, "bm25_plus > 0"), vectors, cosines("dense", True), pool("dense", "cos_dense", "c", size),
        f"""fuse AS (SELECT qid, issue_id, sum(x) AS s FROM (SELECT qid, issue_id, 0.52 / (25 + rank) + 0.18 * seed / (seed + 8) AS x FROM sparse
            UNION ALL SELECT qid, issue_id, 0.48 / (25 + rank) + 0.18 * {clamp("seed")} FROM dense) GROUP BY 1, 2)""",
        pool("fused", "fuse", "s", size),
    ])


def features(candidates: str, cosine: str | None = None, keep_self: bool = False) -> str:
    """CTE `features` of all pair features over a ranked CTE."""
    sq = lambda c: f"round(coalesce({c}, 0) / (coalesce({c}, 0) + 8), 4)"
    seed = "CASE WHEN seed < 0 THEN greatest(0, least(1, (seed + 1) / 2)) WHEN seed <= 1 THEN seed ELSE seed / (seed + 12) END"
    j = lambda c: f"round({jaccard(f'q.{c}', f'c.{c}')}, 4)"
    cos = ""
    if cosine:
        value = "greatest(0, coalesce(list_cosine_similarity(vq.v, vc.v), 0))" if cosine == "dense" else "CASE WHEN vq.v IS NULL OR vc.v IS NULL THEN 0 ELSE (list_cosine_similarity(vq.v, vc.v) + 1) / 2 END"
        cos = f", round({value}, 4) AS {cosine}_cosine"
    joins = f"LEFT JOIN vectors vq ON vq.space = '{cosine}' AND vq.issue_id = k.qid LEFT JOIN vectors vc ON vc.space = '{cosine}' AND vc.issue_id = k.issue_id" if cosine else ""
    return f"""features AS MATERIALIZED (SELECT k.qid, k.issue_id, k.seed, k.rank, {sq("l.bm25")} AS bm25, {sq("l.bm25_plus")} AS bm25_plus, round(coalesce(tfidf_cosine, 0), 4) AS tfidf_cosine,
  {j("title_ngrams")} AS title_ngram, {j("description_terms")} AS description_overlap, round({seed}, 4) AS candidate_seed, {j("title_terms")} AS title_overlap,
  round({overlap("list_distinct(q.weighted_terms)", "list_distinct(c.weighted_terms)")}, 4) AS term_overlap, {j("component_terms")} AS component_overlap,
  {j("affected_version_terms")} AS affected_version_overlap, {j("fix_version_terms")} AS fix_version_overlap,
  {match("q.project_key", "c.project_key")} AS project_match, {match("q.issue_type", "c.issue_type")} AS issue_type_match, {match("q.priority", "c.priority")} AS priority_match, {match("q.status", "c.status")} AS status_match,
  round(least(q.document_length, c.document_length)::DOUBLE / greatest(q.document_length, c.document_length), 4) AS length_ratio{cos}
  FROM {candidates} k LEFT JOIN lexical l ON l.qid = k.qid AND l.issue_id = k.issue_id JOIN sized q ON q.issue_id = k.qid JOIN sized c ON c.issue_id = k.issue_id {joins} {"" if keep_self else "WHERE k.qid <> k.issue_id AND NOT coalesce(q.issue_key = c.issue_key AND q.issue_key <> '', false)"})"""


def ranked(score: str, source: str = "features", top_k: int = 10, extra: str = "") -> str:
    return f"""ranked AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, issue_id) AS place FROM (SELECT *, round({score}, 6) AS score{extra} FROM {source})) WHERE place <= {top_k})"""


def linear_score(model: str) -> str:
    return clamp(weighted(LINEAR_WEIGHTS[model]))


def linear_reasons(model: str, threshold: float = 0.08) -> str:
    w = {n: v for n, v in LINEAR_WEIGHTS[model].items() if n in LINEAR_TEXTS}
    rows = ", ".join(f"CASE WHEN {n} >= {threshold} THEN {{'k': -{n} * {w[n]}, 'i': {i}, 't': '{t}'}} END" for i, (n, t) in enumerate((n, t) for n, t in LINEAR_TEXTS.items() if n in w))
    return f"array_to_string(list_transform(list_slice(list_sort(list_filter([{rows}], lambda r: r IS NOT NULL)), 1, 4), lambda r: r.t), '; ')"


def rules(conditions: list[tuple[str, str]], otherwise: str) -> str:
    held = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in conditions) + "], lambda r: r IS NOT NULL)"
    return f"array_to_string(list_slice(CASE WHEN len({held}) > 0 THEN {held} ELSE [{otherwise}] END, 1, 4), '; ')"


JUDGE_SCORE = clamp(
    weighted(JUDGE_WEIGHTS)
    + " + CASE WHEN dense_cosine >= 0.22 AND bm25_plus >= 0.28 THEN 0.10 ELSE 0 END + CASE WHEN semantic_lexical_agreement >= 0.28 AND metadata_alignment >= 0.40 THEN 0.08 ELSE 0 END"
    " + CASE WHEN retrieval_confidence >= 0.40 AND metadata_alignment >= 0.30 THEN 0.04 ELSE 0 END - CASE WHEN project_match = 0 AND component_overlap = 0 AND dense_cosine < 0.14 THEN 0.08 ELSE 0 END"
    " - CASE WHEN issue_type_match = 0 AND retrieval_confidence < 0.16 THEN 0.04 ELSE 0 END")

EDGES = """
named AS (SELECT issue_id AS src, unnest(linked_issue_ids) AS dst, 0.7 AS w FROM prepared UNION ALL SELECT issue_id, unnest(duplicate_issue_ids), 1.0 FROM prepared),
inside AS (SELECT * FROM named WHERE dst IN (SELECT issue_id FROM prepared)),
edges AS MATERIALIZED (SELECT src, dst, max(w)::DOUBLE AS w FROM (SELECT src, dst, w FROM inside UNION ALL SELECT dst, src, w FROM inside) GROUP BY 1, 2)"""

METADATA = """
meta_keys AS (""" + " UNION ALL ".join(
    [f"SELECT issue_id, '{c}=' || {c} AS key, {w}::DOUBLE AS w FROM prepared WHERE {c} <> ''" for c, w in (("project_key", 0.14), ("issue_type", 0.10), ("priority", 0.07), ("status", 0.05))]
    + [f"SELECT issue_id, '{c}=' || x AS key, {w}::DOUBLE AS w FROM (SELECT issue_id, unnest({c}) AS x FROM prepared)" for c, w in (("component_terms", 0.20), ("affected_version_terms", 0.12), ("fix_version_terms", 0.12))]
) + """),
meta_seeds AS MATERIALIZED (SELECT qid, k.issue_id, least(1.0, round(sum(o.w), 9)) AS seed FROM meta_keys o JOIN queries ON qid = o.issue_id JOIN meta_keys k USING (key) GROUP BY 1, 2)"""

GRAPH_SEEDS = f"""
seeds AS (SELECT qid, issue_id, sum(s) AS s FROM (SELECT qid, issue_id, 1 / (8 + rank) + {clamp("seed")} AS s FROM fused UNION ALL SELECT qid, issue_id, seed FROM meta_seeds) GROUP BY 1, 2)"""

PROPAGATED = pool("starts", "seeds", "s", 50) + """,
hop1 AS (SELECT qid, src AS a, dst AS b, seed * w * 0.65 AS h FROM starts JOIN edges ON src = issue_id),
hop2 AS (SELECT qid, dst AS c, h * w * 0.28 AS h FROM hop1 JOIN edges ON src = b WHERE dst <> a),
spread AS MATERIALIZED (SELECT qid, issue_id, sum(s) AS s FROM (SELECT qid, issue_id, seed AS s FROM starts UNION ALL SELECT qid, b, h FROM hop1 UNION ALL SELECT qid, c, h FROM hop2) GROUP BY 1, 2)"""


def context(candidates: str) -> str:
    j = lambda c: jaccard(f"q.{c}", f"n.{c}")
    return f"""context AS MATERIALIZED (SELECT k.qid, k.issue_id, least(1.0, sum(e.w * (0.25 * {match("q.project_key", "n.project_key")} + 0.35 * ({j("component_terms")}) + 0.15 * ({j("affected_version_terms")})
  + 0.15 * ({j("fix_version_terms")}) + 0.10 * {match("q.issue_type", "n.issue_type")} + 0.12 * ({j("title_ngrams")}))) / sum(e.w)) AS graph_context
  FROM {candidates} k JOIN edges e ON e.src = k.issue_id JOIN prepared q ON q.issue_id = k.qid JOIN prepared n ON n.issue_id = e.dst GROUP BY 1, 2)"""
