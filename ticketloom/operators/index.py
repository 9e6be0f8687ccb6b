"""The search index as tables: prepared records, weighted term bags, postings with statistics, norms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.storage import discard, materialize

BM25_K1, BM25_B, BM25_DELTA = 1.2, 0.75, 1.0
TF_CAP = 3
#: Query terms that may be broadcast (about 60 bytes each), and scored pairs that one task sums, few enough for its hash map to
#: stay in the processor caches (4 million pairs a task took twice as long).
BROADCAST_TERMS, PAIRS_PER_TASK = 1_000_000, 150_000


def weighted_terms(r: dict[str, Column] | None = None) -> Column:
    """The weighted term sequence: title three times, description, comments, components twice, affected and fix versions, type, priority, status and project twice."""
    c = F.col
    meta = F.array_compact(F.array(*[T.normalize_label(c(x)) for x in ("issue_type", "priority", "status", "project_key")]))
    comments = F.flatten(F.transform(F.coalesce(c("comments"), F.array().cast("array<string>")), lambda x: T.tokenize(x)))
    parts = labels = T.labels(c("components"))
    title = T.tokenize(c("title"))
    return F.concat(title, title, title, T.tokenize(c("description_text")), comments, parts, labels, T.labels(c("affected_versions")), T.labels(c("fix_versions")), meta, meta)


def prepare(issues: DataFrame) -> DataFrame:
    """Per record the sets that pair features compare, and document_length (1 at least)."""
    return issues.select(
        "issue_id", "issue_key", "project_key", "issue_type", "priority", "status", "linked_issue_ids", "duplicate_issue_ids",
        weighted_terms().alias("weighted_terms"),
        F.array_distinct(T.tokenize(F.col("title"))).alias("title_terms"),
        F.array_distinct(T.tokenize(F.col("description_text"))).alias("description_terms"),
        T.char_ngrams(F.col("title")).alias("title_ngrams"),
        *[F.array_distinct(T.labels(F.col(c))).alias(a) for c, a in (("components", "component_terms"), ("affected_versions", "affected_version_terms"), ("fix_versions", "fix_version_terms"))],
    ).withColumn("document_length", F.greatest(F.size("weighted_terms"), F.lit(1)).cast("bigint"))


def term_bags(prepared: DataFrame) -> DataFrame:
    """(issue_id, term, tf) of the weighted terms; partial counts before the shuffle."""
    return prepared.select("issue_id", F.explode("weighted_terms").alias("term")).groupBy("issue_id", "term").agg(F.count("*").alias("tf"))


def described_bags(prepared: DataFrame) -> DataFrame:
    """term_bags() with `described`: whether the term is one of the description."""
    every = F.concat(F.transform("weighted_terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d"))), F.transform("description_terms", lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d"))))
    return prepared.select("issue_id", F.explode(every).alias("e")).groupBy("issue_id", "e.term").agg(F.sum("e.n").alias("tf"), (F.sum("e.d") > 0).alias("described"))


def idf_bm25(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_tfidf(n: Column, df: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def tfidf_weight(tf: Column, n: Column, df: Column) -> Column:
    return (1 + F.log(tf.cast("double"))) * idf_tfidf(n, df)


@dataclass(frozen=True)
class SearchIndex:
    """prepared: one row per record. postings: (term, term_id, issue_id, tf, described, df, saturation, unit_weight). n, avg_length: of the corpus.
    vocabulary: (term, term_id, df), term_id from 0 without gaps. made: tables that operators keep with the index.

    saturation is the BM25 factor of the term in the record, unit_weight its tf-idf weight over the record's norm: what
    depends on one side only is computed once, so scoring a pair is three products a shared term.
    """

    prepared: DataFrame
    postings: DataFrame
    n: int
    avg_length: float
    vocabulary: DataFrame
    made: dict = field(default_factory=dict, compare=False)

    @property
    def document_frequency(self) -> DataFrame:
        return self.vocabulary.select("term", "df")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Writes df with a number for each row, from 0 without gaps: the place in its partition after the rows of those before."""
    rows = materialize(df.withColumn("__at", F.monotonically_increasing_id()), name)
    sizes = sorted(rows.groupBy(F.shiftright("__at", 33).alias("part")).count().collect())
    before, total = [], 0
    for part, n in sizes:
        before += [F.lit(part), F.lit(total)]
        total += n
    first = F.element_at(F.create_map(*before), F.shiftright("__at", 33)) if before else F.lit(0)
    return rows.withColumn("term_id", (first + F.col("__at").bitwiseAND(F.lit(2**33 - 1))).cast("int")).drop("__at")


def build_index(issues: DataFrame) -> SearchIndex:
    """Builds and writes the index tables. One shuffle by (record, term) for the bags, one by term for the document frequencies, one by record for norms and lengths."""
    prepared = materialize(prepare(issues), "prepared")
    bags = materialize(described_bags(prepared), "bags")
    n, avg_length = prepared.agg(F.count("*"), F.avg("document_length")).first()
    n, avg_length = max(n, 1), avg_length or 1.0
    vocabulary = numbered(bags.groupBy("term").agg(F.count("*").alias("df")), "vocabulary")
    weighted = bags.join(vocabulary, "term").withColumn("w", tfidf_weight(F.col("tf"), F.lit(n), F.col("df")))
    per_record = weighted.groupBy("issue_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("length"))
    tf = F.col("tf")
    saturation = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.lit(avg_length)))
    postings = weighted.join(per_record, "issue_id").select("term", "term_id", "issue_id", "tf", "described", "df", saturation.alias("saturation"), (F.col("w") / F.col("norm")).alias("unit_weight"))
    postings = materialize(postings, "postings")
    discard(bags)
    return SearchIndex(prepared, postings, n, avg_length, vocabulary)


def query_terms(index: SearchIndex, queries: DataFrame) -> DataFrame:
    """(qid, term, term_id, described, impact, unit_weight) of queries that are records of the corpus (qid = issue_id); impact is idf times the capped count."""
    own = index.postings.join(queries.select(F.col("qid").alias("issue_id")), "issue_id")
    impact = idf_bm25(F.lit(index.n), F.col("df")) * F.least("tf", F.lit(TF_CAP))
    return own.select(F.col("issue_id").alias("qid"), "term", "term_id", "described", impact.alias("impact"), "unit_weight")


def ad_hoc_bags(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """(issue_id, term, term_id, tf, df) of prepared records outside the corpus (issue_id: their qid); an unseen term has df 0."""
    return term_bags(asked).join(index.vocabulary, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))


def ad_hoc_terms(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """(qid, term, term_id, described, impact, unit_weight) of prepared records outside the corpus; unseen terms (term_id null) count in the norm. described is not known."""
    weighted = ad_hoc_bags(index, asked).withColumn("w", tfidf_weight(F.col("tf"), F.lit(index.n), F.col("df")))
    norms = weighted.groupBy("issue_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    impact = idf_bm25(F.lit(index.n), F.col("df")) * F.least("tf", F.lit(TF_CAP))
    return weighted.join(norms, "issue_id").select(F.col("issue_id").alias("qid"), "term", "term_id", F.lit(False).alias("described"), impact.alias("impact"), (F.col("w") / F.col("norm")).alias("unit_weight"))


def _sums() -> list:
    return [
        F.sum(F.col("impact") * F.col("saturation")).alias("bm25"),
        F.sum(F.col("impact") * (F.col("saturation") + BM25_DELTA)).alias("bm25_plus"),
        F.sum(F.col("q_weight") * F.col("unit_weight")).alias("tfidf_cosine"),
        F.sum(F.col("impact") * F.least("tf", F.lit(TF_CAP))).alias("coarse"),
    ]


def pair_scores(index: SearchIndex, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """lexical_scores of given pairs (qid, issue_id) alone: the queries' terms of each pair meet the postings by record and term."""
    q = terms.select("qid", "term_id", "impact", F.col("unit_weight").alias("q_weight"))
    asked = pairs.select("qid", "issue_id").join(q, "qid")
    return asked.join(index.postings, ["issue_id", "term_id"]).groupBy("qid", "issue_id").agg(*_sums())


def lexical_scores(index: SearchIndex, terms: DataFrame) -> DataFrame:
    """(qid, issue_id, bm25, bm25_plus, tfidf_cosine, coarse) of every pair that shares a term: one join on the term, one aggregate.

    Up to BROADCAST_TERMS query terms (counted first) are broadcast to postings partitioned by record, so the pairs of
    a record are summed where they arise and only the postings move; beyond that both sides are shuffled by term.
    """
    n_terms, n_queries = terms.agg(F.count("*"), F.count_distinct("qid")).first()
    q = terms.select("qid", "term", "impact", F.col("unit_weight").alias("q_weight"))
    if n_terms <= BROADCAST_TERMS:
        least = int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tasks = min(50_000, max(least, index.n * n_queries // PAIRS_PER_TASK))
        joined = index.postings.repartition(tasks, "issue_id").join(F.broadcast(q), "term")
    else:
        joined = index.postings.join(q, "term")
    return joined.groupBy("qid", "issue_id").agg(*_sums())
