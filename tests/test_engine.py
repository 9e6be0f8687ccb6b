import inspect
import json
import math

import pytest
from pyspark.sql import functions as F

from ticketloom.api import Engine
from ticketloom.config import Settings
from ticketloom.operators import blocks as B
from ticketloom.operators import candidates as C
from ticketloom.operators import evaluate as E
from ticketloom.operators import graph as G
from ticketloom.operators import learn as L
from ticketloom.operators import random_indexing as RI
from ticketloom.operators.index import build_index, lexical_scores, query_terms
from ticketloom.plans.pipelines import SUITES, Session, resolve_models
from ticketloom.sources import issues as S


def issues(spark, rows):
    """rows: dicts with issue_id and whatever differs from an empty record."""
    names = [c.split()[0] for c in S.SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], S.SCHEMA)


WORDS = "cache ledger printer queue mirror invoice account folder editor portal".split()


@pytest.fixture(scope="module")
def engine(spark):
    rows = [
        {"issue_id": k, "issue_key": f"P-{k}", "project_key": "AB"[k % 2], "title": f"{WORDS[k % 10]} {WORDS[(k + 1) % 10]} fails", "description_text": " ".join(WORDS[(k * j) % 10] for j in range(1, 6)),
         "issue_type": "Bug", "components": [WORDS[k % 3]], "linked_issue_ids": [(k + 10) % 40] if k % 3 else [], "duplicate_issue_ids": [(k + 20) % 40, 999] if k % 4 == 0 else []}
        for k in range(40)
    ]
    vectors = spark.createDataFrame([(k, [math.cos(k), math.sin(k), 0.3]) for k in range(40)], "issue_id long, vector array<double>")
    return Engine(issues(spark, rows), {"sbert": vectors, "e5": vectors}, pair_scorer=lambda a, b: F.levenshtein(a, b) / -10.0, pool=20)


def test_lexical_by_hand(spark):
    idx = build_index(S.normalize(issues(spark, [{"issue_id": k, "description_text": t} for k, t in ((1, "xx yy"), (2, "yy zz"), (3, "zz ww"))])))
    got = {(r.qid, r.issue_id): r for r in lexical_scores(idx, query_terms(idx, spark.createDataFrame([(1,)], "qid long"))).collect()}
    assert set(got) == {(1, 1), (1, 2)}
    idf = math.log(1 + 1.5 / 2.5)
    assert got[1, 2].bm25 == pytest.approx(idf) and got[1, 2].bm25_plus == pytest.approx(2 * idf) and got[1, 1].tfidf_cosine == pytest.approx(1)
    w_y, w_x = math.log(4 / 3) + 1, math.log(2) + 1
    assert got[1, 2].tfidf_cosine == pytest.approx(w_y * w_y / (w_x * w_x + w_y * w_y) ** 0.5 / (2 * w_y * w_y) ** 0.5)


def test_self_uses_a_place(engine, spark):
    q = spark.createDataFrame([(4,)], "qid long")
    s = engine.session(q)
    s.pool = 5
    assert s.candidates("bm25").count() == 5 and C.exclude_self(s.candidates("bm25")).count() == 4


@pytest.mark.parametrize("model", ["bm25", "bm25-plus", "tfidf-cosine", "lexical", "random-indexing-dense", "sbert-dense", "hybrid-sparse-dense", "rag-hybrid-judge", "graph-metadata-aware", "llm-e5-large", "llm-e5-cross-reranker", "logreg-engineered", "pairwise-neural-mlp"])
def test_every_model_ranks(engine, spark, model):
    found = engine.search(spark.createDataFrame([(4,), (8,)], "qid long"), model, 5).collect()
    assert len(found) == 10 and all(0 <= r.score <= 1 and r.qid != r.issue_id and 1 <= len(r.reasons) <= 4 or not r.reasons for r in found)
    for q in (4, 8):
        ranked = sorted((r.rank, -r.score) for r in found if r.qid == q)
        assert [r[0] for r in ranked] == [1, 2, 3, 4, 5] and [r[1] for r in ranked] == sorted(r[1] for r in ranked)


def test_new_records_and_duplicates(engine, spark):
    new = spark.createDataFrame([(-1, "cache ledger fails", "A"), (-2, "unseenword", "B"), (-3, "unseenword", "none")], "qid long, title string, project_key string")
    got = {}
    for r in engine.search_new(new, "bm25", 3).collect():
        got.setdefault(r.qid, []).append(r.issue_id)
    assert got[-2] == [1, 3, 5] and got[-3] == [0, 1, 2] and len(got[-1]) == 3
    dup = engine.find_duplicates(spark.createDataFrame([(4,)], "qid long"), threshold=0.5).collect()
    assert all(r.score >= 0.5 for r in dup)


ALL = ["bm25", "bm25-plus", "tfidf-cosine", "lexical", "random-indexing-dense", "sbert-dense", "hybrid-sparse-dense", "rag-hybrid-judge", "graph-metadata-aware", "llm-e5-large", "llm-e5-cross-reranker", "logreg-engineered", "pairwise-neural-mlp"]


@pytest.mark.parametrize("model", ALL)
def test_every_model_takes_new_records(engine, spark, model):
    """A new record without id and key: its copy in the corpus comes first, or at least in every list."""
    new = spark.createDataFrame([(-1, "cache ledger fails", "A", "Bug", ["cache"]), (-2, "neverseen words", None, None, None)], "qid long, title string, project_key string, issue_type string, components array<string>")
    vector = spark.createDataFrame([(-1, [1.0, 0.0, 0.3]), (-2, [0.0, 1.0, 0.3])], "issue_id long, vector array<double>")
    found = engine.search_new(new, model, 5, {"sbert": vector, "e5": vector}).collect()
    assert {r.qid for r in found} == {-1, -2} and all(0 <= r.score <= 1 and 1 <= r.rank <= 5 for r in found)


def test_comparing_new_records(engine, spark):
    new = spark.createDataFrame([(-1, "cache ledger fails")], "qid long, title string")
    got = engine.compare_new(new, ["bm25", "sbert-dense", "hybrid-sparse-dense"], 3)
    assert {r.model for r in got.collect()} == {"bm25", "hybrid-sparse-dense"}
    with pytest.raises(RuntimeError):
        engine.search_new(new, "sbert-dense")
    from ticketloom.api import Engine as E_

    coded = E_(engine.issues, {"sbert": engine.vectors["sbert"]}, pool=5, encoders={"sbert": lambda: lambda texts: [[1.0, 0.0, 0.3] for _ in texts]})
    assert coded.search_new(new, "sbert-dense", 3).count() == 3


def test_unseen_terms_are_encoded(engine, spark):
    """A query's vector by hand: known terms by their token vectors, unseen ones by six positions of length one together."""
    from ticketloom.operators.index import ad_hoc_bags

    s = engine.asking(spark.createDataFrame([(-1, "cache neverseen")], "qid long, title string"))
    bags = {r.term: r for r in ad_hoc_bags(s.index, s.asked).collect()}
    tokens = {}
    for r in s.token_vectors().where("term = 'cache'").collect():
        tokens[r.dim] = r.value
    e = spark.createDataFrame([("neverseen",)], "t string").select(RI.index_entries(F.col("t"), 192, 6).alias("e")).first().e
    n = s.index.n
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    want = [(1 + math.log(bags["cache"].tf)) * idf(bags["cache"].df) * tokens.get(d, 0.0) for d in range(192)]
    for x in e:
        want[x.dim] += (1 + math.log(3)) * idf(0) * x.sign / 6**0.5
    norm = math.sqrt(sum(x * x for x in want))
    assert bags["neverseen"].df == 0 and s.of_queries("dense").first().vector == pytest.approx([x / norm for x in want])


def test_the_same_key_is_the_same_issue(engine, spark):
    new = spark.createDataFrame([(-1, "P-4", "cache ledger fails")], "qid long, issue_key string, title string")
    assert 4 not in {r.issue_id for r in engine.search_new(new, "bm25", 20).collect()}
    without = new.select("qid", "title")
    assert engine.search_new(without, "bm25", 20).count() == 20


def test_query_edges_are_no_evidence(engine, spark):
    from ticketloom.api import Engine as E_

    blind = E_(engine.issues, pool=20, exclude_query_edges=True)
    q = spark.createDataFrame([(4,)], "qid long")
    s, t = engine.session(q), blind.session(q)
    assert t.exclude_query_edges
    neighbour = s.edges().where("src = 4").first().dst
    pairs = spark.createDataFrame([(4, neighbour)], "qid long, issue_id long")
    edges = s.edges().where(F.col("src").isin(4, neighbour) & F.col("dst").isin(4, neighbour))
    assert G.graph_context(pairs, s.prepared, edges).count() == 1 and G.graph_context(pairs, s.prepared, edges, True).count() == 0


def test_pool_of_nothing_is_the_default(engine):
    assert Session(engine.index, engine.index.prepared).pool == Session(engine.index, engine.index.prepared, pool=0).pool == 250


def test_fusion_keeps_the_order_of_equal_lists(spark):
    ranked = spark.createDataFrame([(1, k, 1.0 / k, k) for k in range(1, 6)], "qid long, issue_id long, seed double, rank int")
    got = C.reciprocal_rank_fusion(ranked, ranked, 5).orderBy("rank").collect()
    assert [r.issue_id for r in got] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("group", [65_536, 10])
def test_pools_without_all_pairs(engine, spark, monkeypatch, group):
    """Pools of blocks and parts are those cut from all pairs, and their sets compare like the records' own; nothing but pools leaves a task."""
    monkeypatch.setattr(B, "PART", 7)
    monkeypatch.setattr(B, "GROUP", group)
    monkeypatch.setattr(B, "RARE", 2)
    engine.index.made.clear()
    terms = query_terms(engine.index, engine.index.prepared.select(F.col("issue_id").alias("qid")))
    scores, key = list(C.LEXICAL), lambda r: (r.score_name, r.qid, r.issue_id, r["rank"])
    want = {key(r): r for r in C.sparse_pools(lexical_scores(engine.index, terms), scores, 6).collect()}
    found = B.lexical_pools(engine.index, terms, scores, 6, True)
    got = {key(r): r for r in found.collect()}
    engine.index.made.clear()
    assert set(got) == set(want) and all(got[k][c] == pytest.approx(want[k][c]) for k in want for c in ("seed", *scores))
    side = {r.issue_id: r for r in engine.index.prepared.collect()}
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0
    for (_, q, c, _), r in got.items():
        assert r.title_jaccard == pytest.approx(jaccard(side[q].title_ngrams, side[c].title_ngrams)) and r.description_jaccard == pytest.approx(jaccard(side[q].description_terms, side[c].description_terms))
        assert r.same_key == (q == c)


def test_evaluation_forms_no_pairs(engine):
    """Lexical models of a session of their own rank without a join of pairs with records, as with it."""
    everyone = engine.index.prepared.select(F.col("issue_id").alias("qid"))
    lean, wide = (Session(engine.index, everyone, pool=20, models=m) for m in ((), ("bm25", "bm25-plus")))
    rows = lambda s: {(r.qid, r.issue_id, r["rank"], r.score, tuple(r.reasons)) for r in s.ranked("bm25").collect()}
    plan = lean.ranked("bm25")._jdf.queryExecution().optimizedPlan().toString()
    assert rows(lean) == rows(wide) and "saturation" not in plan


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 7, 1, 0.9), (1, 8, 2, 0.6), (1, 9, 3, 0.5)], "qid long, issue_id long, rank int, score double")
    relevant = spark.createDataFrame([(1, 8), (1, 99), (2, 5)], "qid long, issue_id long")
    m = {(r.metric, r.k): r.value for r in E.rank_metrics(ranked, relevant, (1, 3)).collect()}
    assert m["mrr", 3] == 0.25 and m["recall", 3] == 0.25 and m["map", 3] == 0.125 and m["hit_rate", 1] == 0 and m["precision", 3] == round(1 / 6, 6)
    assert m["ndcg", 3] == pytest.approx(1 / math.log2(3) / (1 + 1 / math.log2(3)) / 2, abs=1e-6)
    t = {r.threshold: r for r in E.threshold_metrics(ranked, relevant, 3).collect()}
    assert t[0.55].precision == 0.5 and t[0.55].recall == round(1 / 3, 6) and t[0.65].f1 == 0


def test_propagation_by_hand(spark):
    edges = spark.createDataFrame([(1, 2, 0.7), (2, 1, 0.7), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    seeds = spark.createDataFrame([(9, 1, 0.5)], "qid long, issue_id long, seed double")
    got = {r.issue_id: r.seed for r in G.propagate(seeds, edges).collect()}
    assert got == {1: 0.5, 2: pytest.approx(0.5 * 0.7 * 0.65), 3: pytest.approx(0.5 * 0.7 * 0.65 * 0.28)}


def test_index_entries(spark):
    got = spark.createDataFrame([("cache",), ("ledger",)], "t string").select(RI.index_entries(F.col("t")).alias("e")).collect()
    for r in got:
        assert len({e.dim for e in r.e}) == 8 and all(0 <= e.dim < 192 and e.sign in (1.0, -1.0) for e in r.e)


def test_training_pairs_and_models(engine, spark):
    s = engine.session(engine.issues.select(F.col("issue_id").alias("qid")))
    pairs = L.training_pairs(s.prepared, s.candidates("logreg-engineered"))
    rows = pairs.collect()
    for q in {r.qid for r in rows}:
        pos = [r.issue_id for r in rows if r.qid == q and r.label]
        neg = [r.issue_id for r in rows if r.qid == q and not r.label]
        assert pos and len(neg) == 4 * len(pos) and not set(pos) & set(neg) and q not in pos + neg and 999 not in pos
    held = L.training_pairs(s.prepared, s.candidates("logreg-engineered"), holdout=spark.createDataFrame([(0,)], "issue_id long")).collect()
    assert all(0 not in (r.qid, r.issue_id) for r in held)
    nothing = spark.createDataFrame([], "qid long, issue_id long, label int, x double")
    assert L.fit_logistic(nothing, ["x"]).bias == -1.5 and L.fit_mlp(nothing, ["x"]).out_bias == -1


def test_the_network_learns_from_all_pairs(spark):
    """More pairs than the former sample of 200,000: the loss curve is that of all of them."""
    rows = spark.range(240_000).select(F.col("id").alias("qid"), (F.col("id") % 997).alias("issue_id"), (F.col("id") % 5 == 0).cast("int").alias("label"), ((F.col("id") * 7919) % 1000 / 1000).alias("a"), ((F.col("id") % 5) / 5).alias("b"))
    options = {"hidden": 4, "epochs": 2, "batch": 2000}
    got = L.fit_mlp(rows, ["a", "b"], **options).epochs
    pdf = rows.withColumn("part", L.split_column()).where("part <> 'test'").toPandas().sort_values(["qid", "issue_id"])
    x, y, train = pdf[["a", "b"]].to_numpy(float), pdf["label"].to_numpy(float), (pdf["part"] == "train").to_numpy()
    want = L.train_mlp(x[train], y[train], x[~train], y[~train], **options)[1]
    assert [e["validation_loss"] for e in got] == pytest.approx([e["validation_loss"] for e in want], abs=1e-12)
    assert [e["train_loss"] for e in got] == pytest.approx([e["train_loss"] for e in want], abs=1e-12)


@pytest.mark.parametrize("model", ["logreg-engineered", "pairwise-neural-mlp"])
def test_training_pool_grows_with_the_positives(spark, model):
    """A hub of 25 links is trained with its 100 best candidates, though a search keeps 20."""
    rows = [{"issue_id": 1000, "title": "cache ledger", "linked_issue_ids": list(range(800, 825))}]
    rows += [{"issue_id": k, "title": "printer folder"} for k in range(200)] + [{"issue_id": k, "title": "cache ledger " + "queue " * (k % 7)} for k in range(700, 900)]
    s = Engine(issues(spark, rows), pool=20).session(spark.createDataFrame([(1000,)], "qid long"))
    negatives = s.training(model).where("label = 0").select("issue_id", "seed").collect()
    ranked = sum(r.issue_id >= 700 and r.seed > 0 for r in negatives)
    assert len(negatives) == 100 and ranked >= 100 - 25 - 1


def test_default_pool_is_the_references():
    assert inspect.signature(Engine).parameters["pool"].default == Session.pool == Settings().pool == Settings.from_env().pool == 250


def test_evaluate_and_suites(engine):
    got = engine.evaluate("duplicates", ["bm25", "logreg-engineered"], sample_size=6, top_k_values=(1, 5), folds=2).collect()
    assert {r.model for r in got} == {"bm25", "logreg-engineered"} and all(0 <= r.value <= 1 for r in got)
    metrics, ran, skipped = engine.run_suite("sparse-lexical-similarity", sample_size=4)
    assert ran == ["tfidf-cosine", "bm25", "bm25-plus"] and not skipped and metrics.count() == 3 * 21


def test_catalogue():
    assert len(SUITES) == 16 and len(resolve_models(["*"])) == 13 and resolve_models([" BM25 ", "bm25"]) == ["bm25"]
    with pytest.raises(ValueError):
        resolve_models(["nope"])


def test_unavailable_models(spark, engine):
    bare = Engine(engine.issues, pool=5)
    with pytest.raises(RuntimeError):
        bare.runnable(["sbert-dense"])
    assert bare.runnable(["sbert-dense", "bm25"]) == ["bm25"]


def test_json_source(spark, tmp_path):
    nested = {"jira_id": "K-7", "metadata": {"issue_id": 7, "summary": "T", "description": None, "components": "a||b", "comments": ["c", " "], "related_issues": ["X-8", 9], "duplicate_issues": "gamma-3"}, "title": "ignored"}
    flat = {"id": "Q-8", "key": "Q-8", "title": "U", "components": ["z", "a", "a"], "linked_issue_ids": None}
    (tmp_path / "x.json").write_text(json.dumps({"issues": [nested, flat]}))
    rows = {r.issue_id: r for r in S.JsonRepository(str(tmp_path / "x.json")).load(spark).collect()}
    assert rows[7].title == "T" and rows[7].description_text == "" and rows[7].components == ["a", "b"] and rows[7].comments == ["c"]
    assert rows[7].linked_issue_ids == [8, 9] and rows[7].duplicate_issue_ids == [3] and rows[8].linked_issue_ids == [7] and rows[8].components == ["a", "z"]
    (tmp_path / "y.json").write_text(json.dumps(flat))
    assert S.JsonRepository(str(tmp_path / "y.json"), limit=0).load(spark).count() == 0
    (tmp_path / "z.json").write_text(json.dumps([{"id": 1, "title": "no key"}]))
    with pytest.raises(Exception, match="without id, key or title"):
        S.JsonRepository(str(tmp_path / "z.json")).load(spark).collect()
    with pytest.raises(NotImplementedError):
        S.repository("jira_api").load(spark)


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps({"id": k, "key": f"K-{k}", "title": "t", "linked_issue_ids": [1]}) for k in range(1, 4)) + "\n\n")
    got = {r.issue_id: r.linked_issue_ids for r in S.JsonRepository(str(tmp_path / "x.jsonl")).load(spark).collect()}
    assert set(got) == {1, 2, 3} and got[2] == [1]


def test_jdbc_source(spark):
    """Over an embedded database; the tables are read by three connections."""
    url, login = "jdbc:derby:memory:tickets;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    tables = {
        "issue": spark.createDataFrame([(k, f"P-{k}", 10, f"title {k}", None, "raw", "Bug", None, "Open", None) for k in range(1, 8)], "id long, issue_key string, project_id long, title string, description_text string, description string, type string, priority string, status string, resolution string"),
        "project": spark.createDataFrame([(10, "P")], "id long, project_key string"), "component": spark.createDataFrame([(5, "ui")], "id long, name string"), "version": spark.createDataFrame([(3, "1.0")], "id long, name string"),
        "issue_component": spark.createDataFrame([(k, 5) for k in range(1, 8)], "issue_id long, component_id long"), "affected_version": spark.createDataFrame([(1, 3)], "issue_id long, affected_version_id long"),
        "fix_version": spark.createDataFrame([], "issue_id long, fix_version_id long"), "issue_link": spark.createDataFrame([(1, 4, "Duplicate")], "issue_id long, target_issue_id long, name string"),
        "comment": spark.createDataFrame([(1, None, "b", 2)], "issue_id long, comment_text string, comment string, creation_date int"),
    }
    try:
        for name, df in tables.items():
            df.toDF(*[c.upper() for c in df.columns]).write.jdbc(url, name, mode="overwrite", properties=login)
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no embedded database: {str(e)[:200]}")
    repo = S.repository("jdbc", url=url, properties=login, comment_limit=2, partitions=3)
    assert repo.read(spark, "issue").rdd.getNumPartitions() == 3
    got = {r.issue_id: r for r in repo.load(spark).collect()}
    assert len(got) == 7 and got[1].duplicate_issue_ids == [4] and got[4].duplicate_issue_ids == [1] and got[1].comments == ["b"] and got[7].components == ["ui"]


def test_relational_source(spark):
    t = {
        "issue": spark.createDataFrame([(1, "P-1", 10, "T", None, "raw", "Bug", None, "Open", None), (2, "P-2", 99, "no project", "d", None, None, None, None, None)], "id long, issue_key string, project_id long, title string, description_text string, description string, type string, priority string, status string, resolution string"),
        "project": spark.createDataFrame([(10, "P")], "id long, project_key string"),
        "issue_component": spark.createDataFrame([(1, 5), (1, 6), (1, 5)], "issue_id long, component_id long"), "component": spark.createDataFrame([(5, "ui"), (6, "db")], "id long, name string"),
        "affected_version": spark.createDataFrame([(1, 3)], "issue_id long, affected_version_id long"), "fix_version": spark.createDataFrame([], "issue_id long, fix_version_id long"), "version": spark.createDataFrame([(3, "1.0")], "id long, name string"),
        "issue_link": spark.createDataFrame([(1, 4, "Duplicate"), (1, 5, "duplicate"), (1, 6, "Relates")], "issue_id long, target_issue_id long, name string"),
        "comment": spark.createDataFrame([(1, None, "b", 2), (1, "a", None, 1), (1, None, None, 0), (1, "c", None, 3)], "issue_id long, comment_text string, comment string, creation_date int"),
    }
    r = S.from_relational(t, comment_limit=2).collect()
    assert len(r) == 1 and r[0].components == ["db", "ui"] and r[0].duplicate_issue_ids == [4, 5] and r[0].linked_issue_ids == [6] and r[0].comments == ["a", "b"] and r[0].fix_versions == [] and r[0].description_text == "raw"


def test_command_line(spark, tmp_path, capsys):
    from ticketloom.cli import main

    assert main(["models"]) == 0 and main(["suites"]) == 0
    (tmp_path / "i.json").write_text(json.dumps([{"id": k, "key": f"K-{k}", "title": f"{WORDS[k]} fails", "duplicate_issue_ids": [(k + 1) % 5]} for k in range(5)]))
    args = ["--source", "json", "--path", str(tmp_path / "i.json"), "--results-dir", str(tmp_path / "out")]
    assert main(["similar", *args, "--title", "cache fails"]) == 0
    assert "[K-0]" in capsys.readouterr().out
    assert main(["evaluate", *args, "--task", "duplicates", "--models", "bm25"]) == 0
    spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "issue_id long, vector array<double>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(0, [1.0, 0.0])], "issue_id long, vector array<double>").write.parquet(str(tmp_path / "q"))
    spaces = ["--vectors", f"sbert={tmp_path / 'v'}", "--query-vectors", f"sbert={tmp_path / 'q'}"]
    for model in ("sbert-dense", "pairwise-neural-mlp", "graph-metadata-aware"):
        capsys.readouterr()
        assert main(["similar", *args, *spaces, "--title", "cache fails", "--model", model]) == 0
        assert "[K-0]" in capsys.readouterr().out
    assert list((tmp_path / "out" / "diagnostics" / "pairwise-neural-mlp").glob("*"))
    assert list((tmp_path / "out").glob("*/*/report.md"))


def test_streaming_search(engine, spark, tmp_path):
    from ticketloom.streaming.search_stream import read_records, search_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"issue_id": 900, "title": "cache ledger"}) + "\n")
    search_stream(engine, read_records(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), top_k=2).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_generated_collection(spark):
    from ticketloom.sources import synthetic as SY

    made = SY.issues(spark, 30)
    rows = made.collect()
    assert len(rows) == 150 and len({r.issue_id for r in rows}) == 150 and sum(len(r.duplicate_issue_ids) for r in rows) == 60
    assert {tuple(r)[:3] for r in rows} == {tuple(r)[:3] for r in SY.issues(spark, 30).collect()}
    kinds = {r.relationship_type: r["count"] for r in SY.pair_labels(made).groupBy("relationship_type").count().collect()}
    assert kinds == {"duplicate": 30, "linked": 30, "hard_negative": 30, "random_negative": 60}
    pairs = SY.pair_labels(made).collect()
    assert len({(r.left_issue_id, r.right_issue_id) for r in pairs}) == 150 and all(r.left_issue_id < r.right_issue_id for r in pairs)
    assert {(r.relationship_type, r.similarity_band, r.label) for r in pairs} == {("duplicate", "high", 1), ("linked", "medium", 1), ("hard_negative", "low", 0), ("random_negative", "low", 0)}
    back = {r.issue_id: r for r in S.decode_json(SY.as_records(made)).collect()}
    assert len(back) == 150 and all(back[r.issue_id].title == r.title and back[r.issue_id].duplicate_issue_ids == sorted(r.duplicate_issue_ids) for r in rows)


def test_generated_history(spark):
    from ticketloom.sources import synthetic as SY

    made = SY.issues(spark, 20)
    events = SY.history(made)
    n = {r.issue_id: r["count"] for r in events.groupBy("issue_id").count().collect()}
    want = {"Open": 1, "In Progress": 2, "Resolved": 4}
    assert all(n[r.issue_id] == want[r.status] for r in made.collect())
    days = SY.activity(events).collect()
    assert sum(len(r.events) for r in days) == sum(n.values()) and all(e.created.date() == r.day for r in days for e in r.events)
    assert any(e.description.startswith("reporter changed status from Needs Triage to Open") for r in days for e in r.events)


def test_generated_collection_is_searchable(spark):
    from ticketloom.sources import synthetic as SY

    made = SY.issues(spark, 30)
    found = Engine(made.drop("cluster_id", "role"), pool=30).evaluate("duplicates", ["bm25"], top_k_values=(5,)).where("metric = 'recall'").first()
    assert found.value > 0.5


def test_embedding_slot(engine, spark):
    from ticketloom.operators.embedding import embed

    got = embed(engine.index.prepared, lambda: lambda texts: [[len(t), 1.0] for t in texts], "query: ", batch=7).collect()
    assert len(got) == 40 and all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 for r in got)


def test_blake2b_entries(spark):
    df = spark.createDataFrame([("cache",)], "t string")
    e = df.select(RI.blake2b_entries(F.col("t")).alias("e")).first().e
    import hashlib

    h = hashlib.blake2b(b"cache", digest_size=32).digest()
    assert (e[0].dim, e[0].sign) == ((h[0] * 256 + h[1]) % 192, 1.0 if h[2] % 2 == 0 else -1.0) and len({x.dim for x in e}) == 8


def test_diagnostics_files(spark, tmp_path):
    m = L.MlpModel(("x",), [], [], [], 0.0, [{"epoch": 1, "train_loss": 0.5, "validation_loss": 0.6}])
    L.write_diagnostics(m, spark, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d" / "curve.json")).count() == 1
