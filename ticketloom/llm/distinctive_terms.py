"""How distinctive a term is of a record: residual inverse document frequency and weighted tf-idf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.storage import materialize

#: A term in more than this share of the records is hot. A record has a bounded number of terms on average, so there
#: are at most (mean terms per record) / HOT_SHARE hot terms, whatever the size of the collection.
HOT_SHARE = 0.001


def latest_bags(bags: DataFrame) -> DataFrame:
    """issue_id and the counts above 0 of its latest bag (null times are oldest; of equal times the longest, then largest text form).

    A null or empty map, or one with no count above 0, gives no row; repeated rows count once.
    """
    latest = bags.groupBy("issue_id").agg(
        F.max_by(F.col("term_frequency"), F.struct("prepared_at", F.coalesce(F.size("term_frequency"), F.lit(-1)), F.xxhash64(F.map_entries("term_frequency")))).alias("tf")
    )
    entries = F.filter(F.map_entries("tf"), lambda e: (e["value"] > 0) & e["key"].isNotNull())
    return latest.select("issue_id", entries.alias("terms")).where(F.size("terms") > 0)


def term_scores(bags: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """Scores of every (record, term): issue_id, term, tf, df, cf, n_records, ridf, distinctiveness, tfidf.

    ridf = -log2(df/N) + log2(1 - exp(-cf/N)): the observed inverse document frequency minus what a Poisson spread of
    the term's cf occurrences over N records would give. distinctiveness = tf * ridf. tfidf = (1 + ln tf) *
    (ln((1+N)/(1+df)) + 1), rounded to 6 decimals. Counts are of all records.

    Statistics are counted with partial aggregation. Hot terms (bounded in number, see HOT_SHARE) reach the postings
    by broadcast, the others by a shuffle join that then holds no hot key. Bags are as in latest_bags.
    """
    records = materialize(latest_bags(bags), "bags")
    postings = records.select("issue_id", F.explode("terms").alias("e")).select("issue_id", F.col("e.key").alias("term"), F.col("e.value").cast("bigint").alias("tf"))
    n = records.count()
    stats = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).withColumn("n_records", F.lit(n).cast("bigint"))
    stats = materialize(stats, "stats")
    lam = F.col("cf") / F.col("n_records")
    stats = stats.withColumn("ridf", F.log2(F.col("n_records") / F.col("df")) + F.log2(-F.expm1(-lam)))
    hot = stats.where(F.col("df") > F.col("n_records") * hot_share)
    marked = postings.join(F.broadcast(hot), "term", "left")
    cold = marked.where(F.col("df").isNull()).select("issue_id", "term", "tf").hint("merge").join(stats.where(F.col("df") <= F.col("n_records") * hot_share), "term")
    both = marked.where(F.col("df").isNotNull()).unionByName(cold)
    return both.withColumn("distinctiveness", F.col("tf") * F.col("ridf")).withColumn(
        "tfidf", F.round((1 + F.log(F.col("tf").cast("double"))) * (F.log((1 + F.col("n_records")) / (1 + F.col("df"))) + 1), 6)
    )


def top_term(scores: DataFrame, score: str) -> DataFrame:
    """Per record the term of the largest score, then the smaller term: one partial aggregate, no sort of a record's terms."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col("term"))).alias("b")
    return scores.groupBy("issue_id").agg(best).select("issue_id", F.col("b.term").alias("term"), (-F.col("b.s")).alias(score))


def collection_frequency(index: DataFrame) -> DataFrame:
    """Document frequency of each term over all segments of a search index.

    Identical rows count once, null terms not at all, null counts as 0; rows of one segment and term that differ add up.
    """
    return (
        index.select("segment_id", "term", "document_frequency", "doc_count").distinct().where(F.col("term").isNotNull())
        .groupBy("term").agg(F.coalesce(F.sum("document_frequency"), F.lit(0)).alias("document_frequency"), F.count_distinct("segment_id").alias("n_segments"))
    )
