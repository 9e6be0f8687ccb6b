"""Random indexing: token vectors from weighted neighbourhoods, document vectors as weighted sums."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.text import let
from ticketloom.operators.index import SearchIndex, idf_bm25

DIMENSIONS, ACTIVE, WINDOW, PASSES, LEXICAL_MIX = 192, 8, 3, 2, 0.35
#: Positions of a term that only a query has.
UNSEEN_ACTIVE = 6
#: Triples read from two SHA-256 digests of a token; far more than ACTIVE distinct positions.
_TRIPLES = 20


def index_entries(token: Column, dimensions: int = DIMENSIONS, active: int = ACTIVE) -> Column:
    """The token's sparse sign vector as array of struct(dim, sign): the first `active` distinct positions of its digests.

    Each three bytes give a position (first two, modulo the dimensions) and a sign (parity of the third). SHA-256
    stands for a hash that Spark SQL lacks, so the vectors are other ones of the same kind.
    """
    def triples(digest: Column) -> Column:
        byte = lambda at, n: F.conv(digest.substr(at, F.lit(n)), 16, 10).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(_TRIPLES - 1)), lambda i: F.struct(F.pmod(byte(i * 6 + 1, 4), F.lit(dimensions)).alias("dim"), F.when(byte(i * 6 + 5, 2) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))

    def firsts(found: Column) -> Column:
        places = F.slice(F.array_distinct(F.transform(found, lambda d: d["dim"])), 1, active)
        return F.transform(places, lambda x: F.filter(found, lambda d: d["dim"] == x)[0])

    digest = F.concat(F.substring(F.sha2(token, 256), 1, 60), F.substring(F.sha2(F.concat(token, F.lit("#")), 256), 1, 60))
    return let(let(digest, triples), firsts)


def blake2b_entries(token: Column, dimensions: int = DIMENSIONS, active: int = ACTIVE) -> Column:
    """index_entries from BLAKE2b digests, rehashed when used up; in Python, as Spark SQL lacks that hash."""

    @F.pandas_udf("array<struct<dim:int,sign:double>>")
    def entries(tokens: pd.Series) -> pd.Series:
        def one(word: str) -> list[tuple[int, float]]:
            digest, found = hashlib.blake2b(word.encode(), digest_size=32).digest(), {}
            while True:
                for high, low, sign in zip(digest[0:30:3], digest[1:30:3], digest[2:30:3]):
                    found.setdefault((high * 256 + low) % dimensions, -1.0 if sign % 2 else 1.0)
                    if len(found) == active:
                        return list(found.items())
                digest = hashlib.blake2b(digest, digest_size=32).digest()

        return tokens.map(one)

    return entries(token)


def _pair_at(distance: int):
    return lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.lit(distance).alias("d"))


def cooccurrence(prepared: DataFrame, window: int = WINDOW) -> DataFrame:
    """(term, neighbour, weight): 1 / distance summed over all places within the window, in both directions; no self-join, counted before the shuffle."""
    near = []
    for d in range(1, window + 1):
        n = F.size("weighted_terms") - d
        left, right = F.slice("weighted_terms", F.lit(1), F.greatest(n, F.lit(0))), F.slice("weighted_terms", F.lit(d + 1), F.greatest(n, F.lit(0)))
        near.append(F.zip_with(left, right, _pair_at(d)))
    places = prepared.select(F.explode(F.concat(*near)).alias("p")).select("p.*").groupBy("a", "b", "d").agg(F.count("*").alias("n"))
    w = F.col("n") / F.col("d")
    both = places.select(F.col("a").alias("term"), F.col("b").alias("neighbour"), w.alias("weight")).unionByName(places.select(F.col("b").alias("term"), F.col("a").alias("neighbour"), w.alias("weight")))
    return both.groupBy("term", "neighbour").agg(F.sum("weight").alias("weight"))


def token_vectors(index: SearchIndex, dimensions: int = DIMENSIONS, active: int = ACTIVE, window: int = WINDOW, passes: int = PASSES, mix: float = LEXICAL_MIX, hashing=index_entries) -> DataFrame:
    """(term, dim, value) of the unit token vectors: passes * sum of the neighbours' sign vectors by weight, plus mix * the own one."""
    terms = index.document_frequency.select("term")
    entries = terms.select("term", F.explode(hashing(F.col("term"), dimensions, active)).alias("e")).select("term", "e.dim", "e.sign")
    spread = (
        cooccurrence(index.prepared, window)
        .join(entries.withColumnRenamed("term", "neighbour"), "neighbour")
        .groupBy("term", "dim").agg((F.sum(F.col("weight") * F.col("sign")) * passes).alias("value"))
    )
    mixed = spread.unionByName(entries.select("term", "dim", (F.col("sign") * mix).alias("value"))).groupBy("term", "dim").agg(F.sum("value").alias("value"))
    norms = mixed.groupBy("term").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return mixed.join(norms, "term").where("norm > 0").select("term", "dim", (F.col("value") / F.col("norm")).alias("value"))


def unseen_vectors(terms: DataFrame, dimensions: int = DIMENSIONS, active: int = UNSEEN_ACTIVE, hashing=index_entries) -> DataFrame:
    """(term, dim, value) of unit length for terms the training has not seen: their sign vectors, of fewer positions."""
    entries = terms.select("term", F.explode(hashing(F.col("term"), dimensions, active)).alias("e"))
    return entries.select("term", "e.dim", (F.col("e.sign") / math.sqrt(active)).alias("value"))


def query_vectors(index: SearchIndex, bags: DataFrame, vectors: DataFrame) -> DataFrame:
    """(issue_id, vector) of records outside the corpus, from ad_hoc_bags() and the token vectors of the corpus."""
    known = vectors.join(bags.select("term").distinct(), "term", "left_semi")
    unseen = unseen_vectors(bags.where("df = 0").select("term").distinct())
    return encode(bags, known.unionByName(unseen), index.n)


def document_vectors(index: SearchIndex, vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(issue_id, vector) of unit length of the records of the corpus; records of zero weight are absent."""
    return encode(index.postings, vectors, index.n, dimensions)


def encode(bags: DataFrame, vectors: DataFrame, n: int, dimensions: int = DIMENSIONS) -> DataFrame:
    """(issue_id, vector) of unit length: the token vectors of bags (issue_id, term, tf, df) weighted by (1 + ln tf) * idf.

    Token vectors become arrays; one aggregate sums all dimensions of a record, map-side first.
    """
    dense = vectors.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
    dense = dense.select("term", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("v"))
    weight = (1 + F.log(F.col("tf").cast("double"))) * idf_bm25(F.lit(n), F.col("df"))
    joined = bags.select("issue_id", "term", weight.alias("w")).join(dense, "term")
    sums = joined.groupBy("issue_id").agg(*[F.sum(F.col("w") * F.col("v")[d]).alias(f"d{d}") for d in range(dimensions)])
    packed = sums.select("issue_id", F.array(*[F.col(f"d{d}") for d in range(dimensions)]).alias("s"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    return packed.withColumn("n", norm).where("n > 0").select("issue_id", F.transform("s", lambda x: x / F.col("n")).alias("vector"))
