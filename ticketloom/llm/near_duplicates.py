"""Records that repeat others with small edits: parity sketches, a pigeonhole join per size band, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.storage import discard, materialize

#: Parts beyond those the pigeonhole needs; a record leaves out as many of its emptiest parts.
SLACK = 2
#: Tokens whose signatures are made together.
BATCH_TOKENS = 150_000
#: The signature of no token is the one key that unrelated records share by rule; its answers are spread over so many keys.
EMPTY_KEYS = 64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def bands(threshold: float, smallest: int, largest: int) -> list[int]:
    """Lower ends of the size bands; two sets of the threshold's Jaccard similarity lie in the same band or in neighbouring ones."""
    ends = [max(1, smallest)]
    while ends[-1] <= largest:
        ends.append(int(np.ceil(ends[-1] / threshold)) + 1)
    return ends


def allowed(threshold: float, both: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of two sets with together `both` elements at the threshold."""
    return np.floor((1 - threshold) / (1 + threshold) * both + 1e-9).astype(np.int64)


def _parts(threshold: float, ends: list[int]) -> np.ndarray:
    most = allowed(threshold, 2 * (np.array(ends[1:]) - 1))
    return (most + 2) // 2 + SLACK


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(row: np.ndarray, xor: np.ndarray, part: np.ndarray, band: np.ndarray, kind: int, rep: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows, join keys) of signatures. The empty signature of a part is EMPTY_KEYS keys: an answer takes one of them, a question asks all."""
    empty = np.flatnonzero(xor == 0)
    salt = np.zeros(len(xor), np.uint64)
    if len(empty) and probe:
        more = np.repeat(empty, EMPTY_KEYS - 1)
        row, xor, part, band = (np.concatenate([x, x[more]]) for x in (row, xor, part, band))
        salt = np.concatenate([salt, np.tile(np.arange(1, EMPTY_KEYS, dtype=np.uint64), len(empty))])
    elif len(empty):
        salt[empty] = _mix(rep[row[empty]].view(np.uint64)) % np.uint64(EMPTY_KEYS)
    place = (band.astype(np.uint64) << np.uint64(32)) | (part.astype(np.uint64) << np.uint64(1)) | np.uint64(kind)
    return row, _mix(xor + _mix((place + (salt << np.uint64(48))) * _GOLDEN + _GOLDEN)).view(np.int64)


def _sketches(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit parity sketch: each token flips one bit, so the Hamming distance of two sketches is at most the symmetric difference."""
    bit = (h & np.uint64(127)).astype(np.int64)
    one = np.uint64(1) << (bit & 63).astype(np.uint64)
    out = [np.bitwise_xor.reduceat(np.where(bit // 64 == k, one, np.uint64(0)), start).view(np.int64) for k in (0, 1)]
    return out[0], out[1]


def signature_rows(pdf: pd.DataFrame, threshold: float, ends: list[int], probe: bool) -> pd.DataFrame:
    """Join keys of a batch of sets (rep, size, hashes).

    Tokens are spread over the parts of the band; the XOR of a part's token hashes is its signature. If two sets
    differ in at most d tokens, then of any (d+2)//2 parts one differs in at most one token. A set asks (probe) in its
    own band with its fullest parts, as they are (kind 0) and with one token taken out (kind 1); it answers (index) in
    its band and the next, as it is (both kinds) and with one token taken out (kind 0).
    """
    parts = _parts(threshold, ends)
    size = pdf["size"].to_numpy(np.int64)
    rep = pdf["rep"].to_numpy(np.int64)
    h = np.concatenate([np.asarray(x, np.int64) for x in pdf["hashes"]]).view(np.uint64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    row = np.repeat(np.arange(len(size)), size)
    s0, s1 = _sketches(h, start)
    own = np.searchsorted(np.array(ends), size, side="right") - 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for step in (0,) if probe else (0, 1):
        band = np.minimum(own + step, len(parts) - 1)
        if step:
            fits = own + 1 < len(parts)
        else:
            fits = np.ones(len(size), bool)
        g = parts[band]
        first = np.concatenate([[0], np.cumsum(g)])
        cell = first[row] + ((h >> np.uint64(32)) % g[row].astype(np.uint64)).astype(np.int64)
        xor = np.zeros(first[-1], np.uint64)
        np.bitwise_xor.at(xor, cell, h)
        count = np.bincount(cell, minlength=first[-1])
        cell_row = np.repeat(np.arange(len(size)), g)
        part = np.arange(first[-1]) - first[cell_row]
        chosen = fits[cell_row]
        if probe:
            need = (allowed(threshold, 2 * size) + 2) // 2
            order = np.lexsort((part, -count, cell_row))
            place = np.empty(first[-1], np.int64)
            place[order] = np.arange(first[-1]) - first[cell_row]
            chosen = place < need[cell_row]
        cells = np.flatnonzero(chosen)
        tokens = np.flatnonzero(chosen[cell])
        without = xor[cell[tokens]] ^ h[tokens]
        whole = cell_row[cells], xor[cells], part[cells], band[cell_row[cells]]
        less = row[tokens], without, part[cell[tokens]], band[row[tokens]]
        for signatures, kind in ((whole, 0), (less, 1)) if probe else ((whole, 0), (whole, 1), (less, 0)):
            found.append(_keys(*signatures, kind, rep, probe))
    at = np.concatenate([f[0] for f in found])
    return pd.DataFrame({
        "key": np.concatenate([f[1] for f in found]), "rep": rep[at], "size": size[at].astype(np.int32), "s0": s0[at], "s1": s1[at],
    })


def _signatures(classes: DataFrame, threshold: float, ends: list[int], probe: bool) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["size"].cumsum() // BATCH_TOKENS, sort=False):
                yield signature_rows(part, threshold, ends, probe)

    return classes.select("rep", "size", "hashes").mapInPandas(rows, "key long, rep long, size int, s0 long, s1 long")


def word_classes(records: DataFrame, id_col: str, text, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of records with the same set of words, both written to the shared folder.

    classes: rep (a number), class_id (smallest id), size, words, hashes. members: rep, id, one row per record, so a
    set that millions of records share is millions of rows and never one array.
    """
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))))
    sets = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words.alias("words")).where(F.size("words") >= min_words)
    # 128 bits: no two sets share them by chance.
    sets = materialize(sets.select("id", "words", *[F.xxhash64("words", F.lit(k)).alias(f"k{k}") for k in (1, 2)]), "sets")
    numbered = sets.groupBy("words", "k1", "k2").agg(F.min("id").alias("class_id")).withColumn("rep", F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    members = materialize(sets.select("id", "k1", "k2").distinct().hint("merge").join(numbered.select("k1", "k2", "rep"), ["k1", "k2"]).select("rep", "id"), "members")
    discard(sets)
    classes = numbered.select("rep", "class_id", F.size("words").alias("size"), "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    return classes, members


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (left_rep, right_rep) of classes whose Jaccard similarity reaches the threshold, each pair once; exact.

    Every join here is a sort-merge join: nothing is known about the number of rows that a Python map yields.
    """
    sizes = classes.agg(F.min("size"), F.max("size")).first()
    ends = bands(threshold, sizes[0] or 1, sizes[1] or 1)
    ask = _signatures(classes, threshold, ends, True).select("key", *[F.col(c).alias(f"a_{c}") for c in ("rep", "size", "s0", "s1")])
    give = _signatures(classes, threshold, ends, False).select("key", *[F.col(c).alias(f"b_{c}") for c in ("rep", "size", "s0", "s1")])
    distance = F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))) + F.bit_count(F.col("a_s1").bitwiseXOR(F.col("b_s1")))
    ratio = (1 - threshold) / (1 + threshold)
    near = (
        ask.hint("merge").join(give.hint("merge"), "key")
        .where((F.col("a_size") > F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_rep") > F.col("b_rep"))))
        .where(F.col("b_size") >= F.col("a_size") * threshold - 1e-9)
        .where(distance <= (F.col("a_size") + F.col("b_size")) * ratio + 1e-9)
        .select("a_rep", "b_rep").distinct()
    )
    a = classes.select(F.col("rep").alias("a_rep"), F.col("words").alias("a_words")).hint("merge")
    b = classes.select(F.col("rep").alias("b_rep"), F.col("words").alias("b_words")).hint("merge")
    shared = F.size(F.array_intersect("a_words", "b_words"))
    return (
        near.hint("merge").join(a, "a_rep").hint("merge").join(b, "b_rep")
        .where(shared >= threshold * (F.size("a_words") + F.size("b_words") - shared) - 1e-9)
        .select(F.col("a_rep").alias("left_rep"), F.col("b_rep").alias("right_rep"))
    )


def near_duplicate_pairs(records: DataFrame, id_col: str, text, threshold: float, min_words: int) -> DataFrame:
    """Pairs (left_issue_id < right_issue_id) of records whose word sets reach the Jaccard threshold.

    Words are the runs of [a-z0-9_] of the lower-cased text expression; records of fewer than min_words distinct words
    take no part (so null and empty texts do not). Records of equal word sets form a class; the sketch join runs over
    classes, and pairs are read off the classes' members. A record repeated under its id counts once; if one id has
    several texts, a pair counts if any of them reach the threshold. An empty table gives no rows. Exact.
    """
    classes, members = word_classes(records, id_col, text, min_words)
    pairs = materialize(similar_classes(classes, threshold), "pairs")
    x = members.select(F.col("rep").alias("left_rep"), F.col("id").alias("x"))
    y = members.select(F.col("rep").alias("right_rep"), F.col("id").alias("y"))
    across = pairs.join(x, "left_rep").hint("merge").join(y, "right_rep").select("x", "y").where("x <> y")
    within = x.join(y, F.col("left_rep") == F.col("right_rep")).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("left_issue_id"), F.greatest("x", "y").alias("right_issue_id")).distinct()


def near_duplicate_classes(records: DataFrame, id_col: str, text, threshold: float, min_words: int) -> DataFrame:
    """One row per record with at least min_words distinct words: issue_id, class_id (smallest id of the records with the same words), n_members, n_links (similar other classes)."""
    classes, members = word_classes(records, id_col, text, min_words)
    pairs = materialize(similar_classes(classes, threshold), "pairs")
    ends = pairs.select(F.explode(F.array("left_rep", "right_rep")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("n_members"))
    named = classes.select("rep", "class_id").join(sizes, "rep").hint("merge").join(ends.hint("merge"), "rep", "left")
    return members.join(named.hint("merge"), "rep").select(F.col("id").alias("issue_id"), "class_id", "n_members", F.coalesce("n_links", F.lit(0)).alias("n_links"))
