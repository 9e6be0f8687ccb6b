"""Encoding of a whole corpus with a public byte-level BPE tokenizer through a table of distinct words."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.storage import materialize

#: Where the vocabulary file lies on every node.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer cuts text into words (fixed by the vocabulary's publisher); (?U) gives \s its Unicode meaning.
WORDS = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A word with at least 1/HOT_WORDS of all occurrences is hot: there are at most HOT_WORDS of them in any corpus. Words
#: of more than NAME_CHARS characters go by a name of bounded length, so the list of hot words is bounded in bytes too.
HOT_WORDS = 20_000
NAME_CHARS, NAME_HEAD = 64, 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def word_encoder(path: str):
    """A pandas UDF from words to their ids; a word is never cut again."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        whole = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})
        for words in batches:
            yield pd.Series([whole.encode_ordinary(w) for w in words])

    return encode


def _name(word: Column) -> Column:
    """The word, or for a long one its beginning and digest."""
    digest = F.concat(F.substring(word, 1, NAME_HEAD), F.lit("\n"), F.sha2(word, 256))
    return F.when(F.length(word) <= NAME_CHARS, word).otherwise(digest)


def _names(words: pa.Array) -> pa.Array:
    """_name() of an Arrow array."""
    at = np.flatnonzero((pc.utf8_length(words).to_numpy(zero_copy_only=False) > NAME_CHARS))
    if not len(at):
        return words
    long = [w[:NAME_HEAD] + "\n" + hashlib.sha256(w.encode()).hexdigest() for w in words.take(pa.array(at)).to_pylist()]
    mask = np.zeros(len(words), bool)
    mask[at] = True
    return pc.replace_with_mask(words, pa.array(mask), pa.array(long, words.type))


def word_table(split: DataFrame, vocab_path: str = BYTE_BPE_50K) -> DataFrame:
    """Each distinct word of the column `words` once: name, n (occurrences), ids. Written to the shared folder."""
    counted = split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return materialize(counted.select(_name(F.col("word")).alias("name"), "n", word_encoder(vocab_path)("word").alias("ids")), "words")


def _hot_words(vocab: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The names of the hot words (at most HOT_WORDS), their ids end to end, and where each word's ids start.

    Their lengths are bounded as well: n >= total / HOT_WORDS for each, and all lengths times n are at most the corpus's
    characters, so together they have at most HOT_WORDS times the mean length of a word.
    """
    total = vocab.agg(F.sum("n")).first()[0] or 1
    hot = vocab.where(F.col("n") * HOT_WORDS >= total).select("name", "ids").collect()
    ends = np.cumsum([0, *[len(r.ids) for r in hot]])
    return [r.name for r in hot], np.array([i for r in hot for i in r.ids], np.int32), ends


def _codes(hot: list[str]):
    """Arrow batches (keys, words) -> (keys, codes): per word its place in the hot words, -1 for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(hot, pa.string())
        for b in batches:
            words = b.column(b.num_columns - 1)
            codes = pc.fill_null(pc.index_in(_names(words.flatten()), value_set=known), -1)
            lists = pa.ListArray.from_arrays(_offsets(words), codes)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], [*b.schema.names[:-1], "codes"])

    return run


def _cold(hot: list[str]):
    """Arrow batches (keys, words) -> (keys, pos, name) of the words that are not hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(hot, pa.string())
        for b in batches:
            words = b.column(b.num_columns - 1)
            flat = _names(words.flatten())
            at = np.flatnonzero(pc.is_in(flat, value_set=known).to_numpy(zero_copy_only=False) == 0)
            starts = _offsets(words).to_numpy()
            row = np.searchsorted(starts, at, side="right") - 1
            pos = (at - starts[row]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row)) for c in b.columns[:-1]], pa.array(pos), flat.take(pa.array(at))], [*b.schema.names[:-1], "pos", "name"])

    return run


def _offsets(lists: pa.ListArray) -> pa.Array:
    """Offsets into flatten() of a list column without nulls."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _assemble(hot_ids: np.ndarray, hot_ends: np.ndarray):
    """Arrow batches (keys, codes, cold) -> (keys, ids): the ids of hot words by their code, of the others by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.append(np.diff(hot_ends), 0)
        for b in batches:
            codes_col, cold_col = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            starts = _offsets(codes_col).to_numpy()
            codes = codes_col.flatten().to_numpy()
            n = size[codes]
            cold = cold_col.flatten()
            cold_rows = pc.list_parent_indices(cold_col).to_numpy()
            cold_ids = cold.field("ids")
            at = starts[cold_rows] + cold.field("pos").to_numpy()
            n[at] = pc.list_value_length(cold_ids).to_numpy()
            ends = np.concatenate([[0], np.cumsum(n)])
            out = np.empty(ends[-1], np.int32)
            inside = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
            hot_at = np.repeat(codes >= 0, n)
            out[hot_at] = hot_ids[(np.repeat(hot_ends[codes], n) + inside)[hot_at]]
            if len(at):
                order = np.argsort(at, kind="stable")
                cold_sizes = pc.list_value_length(cold_ids).to_numpy()
                flat = cold_ids.flatten().to_numpy()
                cold_starts = np.concatenate([[0], np.cumsum(cold_sizes)])[:-1]
                k = cold_sizes[order]
                take = np.repeat(cold_starts[order], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                out[~hot_at] = flat[take]
            lists = pa.ListArray.from_arrays(pa.array(ends[starts].astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], lists], [*b.schema.names[:-2], "ids"])

    return run


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab_path: str = BYTE_BPE_50K, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, and ids (array<int>, without special tokens) of every document.

    Words are split in Spark, each distinct word is encoded once, and ids are joined back by position: hot words (a
    list of bounded size) where the text is read, all others by a shuffle of their occurrences alone. Empty and null
    texts give an empty array. A repeated row gives one result; rows of one doc_id with different texts give one
    result each. Other columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.xxhash64(F.col(text)).alias("__h"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = dict(keyed.dtypes)
    keys = ["doc_id", *keep, "__h"]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    split = materialize(keyed.select(*keys, F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words")), "split")
    vocab = word_table(split, vocab_path)
    hot, hot_ids, hot_ends = _hot_words(vocab)
    coded = split.mapInArrow(_codes(hot), schema + ", codes array<int>").dropDuplicates(keys)
    rest = split.select("doc_id", "__h", "words").mapInArrow(_cold(hot), f"doc_id {kinds['doc_id']}, __h long, pos int, name string")
    cold = (
        rest.hint("merge").join(vocab.select("name", "ids"), "name")
        .groupBy("doc_id", "__h").agg(F.collect_set(F.struct("pos", "ids")).alias("cold"))
        .withColumnsRenamed({"doc_id": "__d", "__h": "__g"})
    )
    none = F.array().cast("array<struct<pos:int,ids:array<int>>>")
    on = coded["doc_id"].eqNullSafe(cold["__d"]) & (coded["__h"] == cold["__g"])
    both = coded.hint("merge").join(cold.hint("merge"), on, "left").select(*keys, "codes", F.coalesce("cold", none).alias("cold"))
    return both.mapInArrow(_assemble(hot_ids, hot_ends), schema + ", ids array<int>").drop("__h")


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocab_path: str = BYTE_BPE_50K, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep` and n_tokens of every distinct row."""
    return encode_corpus(docs, doc_id, text, vocab_path, keep).select("doc_id", *keep, F.size("ids").cast("long").alias("n_tokens"))


def piece_table(spark: SparkSession, vocab_path: str = BYTE_BPE_50K) -> DataFrame:
    """(id, piece) of the vocabulary, pieces as hexadecimal bytes: a table of the vocabulary's fixed size."""
    rows = spark.read.text("file://" + vocab_path if vocab_path.startswith("/") else vocab_path).select(F.split("value", " ").alias("r"))
    return rows.select(F.col("r")[1].cast("int").alias("id"), F.hex(F.unbase64(F.col("r")[0])).alias("piece"))


def decode_corpus(encoded: DataFrame, vocab_path: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id and text of encoded documents: every id meets its piece in a join with the table id -> piece, and a row's pieces are put together by position.

    The table has the size of the vocabulary, whatever the corpus is, so it is broadcast. Ids must be those of the
    vocabulary. Empty and null lists give ''; each row gives one.
    """
    rows = materialize(encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), F.monotonically_increasing_id().alias("row")), "rows")
    # Rows move before they are taken apart: their ids then meet again where they are, without a shuffle.
    placed = rows.repartition("row").select("row", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(piece_table(encoded.sparkSession, vocab_path)), "id")
    lists = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"))
    hexed = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    texts = lists.select("row", F.decode(F.unhex(hexed), "UTF-8").alias("text"))
    return rows.select("row", "doc_id").join(texts.hint("merge"), "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
