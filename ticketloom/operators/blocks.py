"""Lexical pools of many queries: blocks of queries meet packed parts of the corpus as matrices, and no pair leaves its task before the cut.

A part holds the postings of some thousand records in flat arrays, a block the terms of some hundred queries. The product
of both (a cartesian one, so neither side is shuffled) is streamed through one task a block and group of parts. It sums
scores in single precision, keeps what can be among the best within the bound of the rounding error, and computes the exact
scores, and set overlaps, of that alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.operators.index import BM25_B, BM25_DELTA, BM25_K1, TF_CAP, SearchIndex
from ticketloom.storage import materialize

#: Records of a part and of a group of parts, queries of a block and of a batch of exact scores; all tasks are bounded by them.
PART, GROUP, BLOCK, BATCH = 4096, 65_536, 512, 64
#: Blocks that even few queries are cut into, of at least so many queries.
LEAST_BLOCKS, LEAST_QUERIES = 12, 32
#: A term in more than this share of a part's records is multiplied as a row of a matrix; the terms in at most so many are summed pair by pair.
DENSE_SHARE, RARE = 1 / 12, 8
#: Symbols of normalised titles; a gram of up to three is a number.
_SYMBOLS = " -_0123456789abcdefghijklmnopqrstuvwxyz"
_GRAMS = (len(_SYMBOLS) + 1) ** 3
_NO_KEY = -(2**63)
LEXICAL = ("bm25", "bm25_plus", "tfidf_cosine", "coarse")
#: Postings of a part are by term, then record: its distinct terms with the number of their records in the part (counts) and in the corpus (df).
_PART = "part int, ids binary, keys binary, norms binary, terms binary, counts binary, df binary, docs binary, tf binary, described binary, gram_sizes binary, grams binary"
_BLOCK = "block int, q_ids binary, q_keys binary, q_sizes binary, q_terms binary, q_described binary, q_impact binary, q_unit binary, q_gram_sizes binary, q_grams binary"


def _gram_numbers(grams: pd.Series) -> np.ndarray:
    """Numbers of all grams of a column of lists; titles are normalised, so all symbols are known."""
    at = {c: k + 1 for k, c in enumerate(_SYMBOLS)}
    base = len(_SYMBOLS) + 1
    known: dict[str, int] = {}
    out = []
    for g in grams:
        for s in g:
            n = known.get(s)
            if n is None:
                n = 0
                for c in s:
                    n = n * base + at[c]
                known[s] = n
            out.append(n)
    return np.array(out, np.int32)


def _records(index: SearchIndex) -> DataFrame:
    """(issue_id, key, title_ngrams): key is the smallest id with the same issue key, null without one."""
    keyed = index.prepared.where("issue_key <> ''").groupBy("issue_key").agg(F.min("issue_id").alias("key"))
    return index.prepared.select("issue_id", "issue_key", "title_ngrams").join(keyed, "issue_key", "left").select("issue_id", "key", "title_ngrams")


def _flat(rows: pd.DataFrame, sides: pd.DataFrame, id_name: str):
    """The rows by id, then term, the ids, the number of rows of each, its keys and grams."""
    rows = rows.sort_values([id_name, "term_id"], ignore_index=True)
    ids, sizes = np.unique(rows[id_name].to_numpy(np.int64), return_counts=True)
    own = sides.set_index(id_name).reindex(ids)
    keys = own["key"].astype("Int64").fillna(_NO_KEY).to_numpy(np.int64)
    grams = own["title_ngrams"].map(lambda g: g if g is not None and not isinstance(g, float) else ())
    return rows, ids, sizes.astype(np.int32), keys, grams.map(len).to_numpy(np.int32), _gram_numbers(grams)


def parts(index: SearchIndex) -> DataFrame:
    """The packed corpus, written once for an index."""
    if "parts" not in index.made:
        n = max(1, -(-index.n // PART))
        place = F.pmod(F.xxhash64("issue_id"), F.lit(n)).cast("int").alias("part")

        def pack(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame({c.split()[0]: [] for c in _PART.split(", ")})
            rows, ids, sizes, keys, gram_sizes, grams = _flat(left, right, "issue_id")
            first = np.cumsum(sizes) - sizes
            norms = _tf_weight(rows["tf"].to_numpy()[first]) * _idf(total, rows["df"].to_numpy()[first]) / rows["unit_weight"].to_numpy()[first]
            terms = rows["term_id"].to_numpy(np.int32)
            order = np.argsort(terms, kind="stable")
            terms, at, counts = np.unique(terms[order], return_index=True, return_counts=True)
            arrays = (ids, keys, norms, terms, counts.astype(np.int32), rows["df"].to_numpy(np.int32)[order][at], np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)[order], _narrow(rows["tf"].to_numpy(np.int32)[order]),
                      rows["described"].to_numpy(np.uint8)[order], gram_sizes, grams)
            return pd.DataFrame([(left["part"].iloc[0], *[a.tobytes() for a in arrays])], columns=[c.split()[0] for c in _PART.split(", ")])

        total = index.n
        rows = index.postings.select(place, "issue_id", "term_id", F.col("tf").cast("int").alias("tf"), "described", F.col("df").cast("int").alias("df"), "unit_weight")
        packed = rows.groupBy("part").cogroup(_records(index).select(place, "*").groupBy("part")).applyInPandas(pack, _PART)
        index.made["parts"] = materialize(packed, "parts")
    return index.made["parts"]


def _blocks(index: SearchIndex, terms: DataFrame, n: int, compare: bool) -> DataFrame:
    place = F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int").alias("block")
    sides = _records(index).withColumnRenamed("issue_id", "qid")
    sides = sides.join(terms.select("qid").distinct(), "qid", "left_semi") if compare else sides.limit(0)

    def pack(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c.split()[0]: [] for c in _BLOCK.split(", ")})
        rows, ids, sizes, keys, gram_sizes, grams = _flat(left, right, "qid")
        arrays = (ids, keys, sizes, rows["term_id"].to_numpy(np.int32), rows["described"].to_numpy(np.uint8), rows["impact"].to_numpy(float), rows["unit_weight"].to_numpy(float), gram_sizes, grams)
        return pd.DataFrame([(left["block"].iloc[0], *[a.tobytes() for a in arrays])], columns=[c.split()[0] for c in _BLOCK.split(", ")])

    rows = terms.select(place, "qid", "term_id", "described", "impact", "unit_weight")
    return materialize(rows.groupBy("block").cogroup(sides.select(place, "*").groupBy("block")).applyInPandas(pack, _BLOCK), "blocks")


class _Part:
    def __init__(self, row: dict, n: int, avg_length: float):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.keys, self.norms, self.terms, self.counts, self.df = get("ids", np.int64), get("keys", np.int64), get("norms", float), get("terms", np.int32), get("counts", np.int32), get("df", np.int32)
        self.docs, self.described, self.gram_sizes, self.grams = get("docs", np.uint16), get("described", np.uint8), get("gram_sizes", np.int32), get("grams", np.int32)
        self.tf = get("tf", np.uint8 if len(row["tf"]) == len(self.docs) else np.int32)
        self.gram_starts = np.concatenate([[0], np.cumsum(self.gram_sizes, dtype=np.int64)])
        length = np.bincount(self.docs, self.tf, minlength=len(self.ids))
        self.damping = BM25_K1 * (1 - BM25_B + BM25_B * length / avg_length)
        self.idf = _idf(n, self.df)

    def saturation(self, docs: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * (BM25_K1 + 1) / (tf + self.damping[docs])

    def values(self, score: str) -> np.ndarray:
        """The record's side of a score, of every posting."""
        if score == "tfidf_cosine":
            return (_tf_weight(self.tf) * np.repeat(self.idf, self.counts) / self.norms[self.docs]).astype(np.float32)
        if score == "coarse":
            return np.minimum(self.tf, TF_CAP).astype(np.float32)
        return (self.saturation(self.docs, self.tf) + (BM25_DELTA if score == "bm25_plus" else 0.0)).astype(np.float32)

    def by_record(self, lookup: np.ndarray) -> None:
        """Puts the postings in the order of the records; their terms become places in `lookup`."""
        order = np.argsort(self.docs, kind="stable")
        self.sizes = np.bincount(self.docs, minlength=len(self.ids))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.repeat(lookup[self.terms], self.counts)[order]
        self.tf, self.described, self.docs = self.tf[order], self.described[order], None


def _narrow(tf: np.ndarray) -> np.ndarray:
    """Counts as single bytes where all of them fit; the reader tells by the length."""
    return tf.astype(np.uint8) if tf.max(initial=0) < 256 else tf


def _tf_weight(tf: np.ndarray) -> np.ndarray:
    return 1 + np.log(tf.astype(float))


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class _Block:
    """The queries of a block with the records that can be among the best of each."""

    def __init__(self, row: dict, scores: Sequence[str], pool: int, compare: bool):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, self.keys, self.sizes, self.terms = get("q_ids", np.int64), get("q_keys", np.int64), get("q_sizes", np.int32), get("q_terms", np.int32)
        self.described, self.impact, self.unit = get("q_described", np.uint8), get("q_impact", float), get("q_unit", float)
        self.gram_sizes, self.grams = get("q_gram_sizes", np.int32), get("q_grams", np.int32)
        self.scores, self.pool, self.compare = scores, pool, compare
        self.starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.gram_starts = np.concatenate([[0], np.cumsum(self.gram_sizes, dtype=np.int64)])
        self.words, self.word = np.unique(self.terms, return_inverse=True)
        self.row = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.order = np.argsort(self.word, kind="stable")
        self.word_starts = np.concatenate([[0], np.cumsum(np.bincount(self.word, minlength=len(self.words)))])
        self.parts: list[_Part] = []
        # Of each score and query: parts, places and scores of what is kept, and what a record must have.
        self.kept = {s: [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))] * len(self.ids) for s in scores}
        self.least = {s: np.zeros(len(self.ids)) for s in scores}
        self.error = (int(self.sizes.max(initial=0)) + 8) * 2.0**-23

    def add(self, part: _Part) -> None:
        at, n, b = len(self.parts), len(part.ids), len(self.ids)
        self.parts.append(part)
        first, count = np.cumsum(part.counts) - part.counts, part.counts
        own = np.searchsorted(self.words, part.terms)
        own[own == len(self.words)] = 0
        asked = self.words[own] == part.terms
        first, count, own, docs = first[asked], count[asked], own[asked], part.docs
        dense, rare = count > max(RARE, n * DENSE_SHARE), count <= RARE
        q_first, q_count = self.word_starts[own], np.diff(self.word_starts)[own]
        for score in self.scores:
            value = part.values(score)
            weight = (self.unit if score == "tfidf_cosine" else self.impact)[self.order].astype(np.float32)
            rows = self.row[self.order]
            a, q = np.zeros((int(dense.sum()), n), np.float32), np.zeros((b, int(dense.sum())), np.float32)
            k = np.arange(len(a))
            x, y = _ranges(first[dense], count[dense]), _ranges(q_first[dense], q_count[dense])
            a[np.repeat(k, count[dense]), docs[x]] = value[x]
            q[rows[y], np.repeat(k, q_count[dense])] = weight[y]
            s = q @ a
            for f, c, qf, qc in zip(*[z[~dense & ~rare].tolist() for z in (first, count, q_first, q_count)]):
                d, r = docs[f:f + c], rows[qf:qf + qc]
                s[r[:, None], d] += weight[qf:qf + qc, None] * value[f:f + c]
            # Every posting of a rare term meets every query that has it.
            x, y = _ranges(first[rare], count[rare]), np.repeat(np.arange(int(rare.sum())), count[rare])
            many = q_count[rare][y]
            x, y = np.repeat(x, many), _ranges(q_first[rare][y], many)
            np.add.at(s, (rows[y], docs[x]), weight[y] * value[x])
            self._keep(score, at, s)

    def _keep(self, score: str, at: int, s: np.ndarray) -> None:
        kept, least = self.kept[score], self.least[score]
        for r in range(len(s)):
            found = np.flatnonzero(s[r] > least[r]).astype(np.int32)
            if not len(found):
                continue
            p, d, v = kept[r]
            p, d, v = np.concatenate([p, np.full(len(found), at, np.int32)]), np.concatenate([d, found]), np.concatenate([v, s[r, found]])
            if len(v) > self.pool:
                # The pool is cut by scores rounded to 6 decimals: a millionth below the last place may still be in it.
                least[r] = max(0.0, float(np.partition(v, len(v) - self.pool)[len(v) - self.pool]) * (1 - 3 * self.error) - 2e-6)
                good = v > least[r]
                p, d, v = p[good], d[good], v[good]
            kept[r] = p, d, v

    def finish(self) -> Iterator[pa.RecordBatch]:
        lookup = np.full(max([int(self.words[-1]) if len(self.words) else 0, *[int(p.terms.max(initial=0)) for p in self.parts]]) + 1, len(self.words), np.int32)
        lookup[self.words] = np.arange(len(self.words))
        idf = np.ones(len(self.words))
        for part in self.parts:
            seen = lookup[part.terms] < len(self.words)
            idf[lookup[part.terms[seen]]] = part.idf[seen]
            part.by_record(lookup)
        unit_idf = self.unit * idf[self.word]
        for low in range(0, len(self.ids), BATCH):
            rows = range(low, min(low + BATCH, len(self.ids)))
            mine = slice(self.starts[low], self.starts[rows.stop])
            at = (self.row[mine] - low) * (len(self.words) + 1) + self.word[mine]
            spread = lambda x: np.bincount(at, x[mine], minlength=len(rows) * (len(self.words) + 1))  # noqa: B023, E731
            impact, unit, described = spread(self.impact), spread(unit_idf), spread(self.described)
            grams = np.zeros(len(rows) * _GRAMS, np.uint8)
            if self.compare:
                grams[np.repeat(np.arange(len(rows)), self.gram_sizes[rows.start:rows.stop]) * _GRAMS + self.grams[self.gram_starts[low]:self.gram_starts[rows.stop]]] = 1
            q_described = described.reshape(len(rows), -1).sum(1)
            for name in self.scores:
                out = []
                for k, part in enumerate(self.parts):
                    chosen = [self.kept[name][r][1][self.kept[name][r][0] == k] for r in rows]
                    row, doc = np.repeat(np.arange(len(rows)), [len(c) for c in chosen]), np.concatenate(chosen)
                    if not len(doc):
                        continue
                    size = part.sizes[doc]
                    x = _ranges(part.starts[doc], size)
                    y = np.repeat(row * (len(self.words) + 1), size) + part.words[x]
                    begin = np.cumsum(size) - size
                    w, tf = impact[y], part.tf[x]
                    total = lambda v: np.add.reduceat(v, begin)  # noqa: B023, E731
                    bm25 = total(w * part.saturation(np.repeat(doc, size), tf))
                    got = {"row": row, "qid": self.ids[low + row], "issue_id": part.ids[doc], "bm25": bm25, "bm25_plus": bm25 + BM25_DELTA * total(w), "tfidf_cosine": total(unit[y] * _tf_weight(tf)) / part.norms[doc],
                           "coarse": total(w * np.minimum(tf, TF_CAP))}
                    if self.compare:
                        shared, theirs = total(described[y] * part.described[x]), np.add.reduceat(part.described[x].astype(float), begin)
                        got["description_jaccard"] = _jaccard(shared, q_described[row], theirs)
                        size = part.gram_sizes[doc]
                        x = _ranges(part.gram_starts[doc], size)
                        pair = np.repeat(np.arange(len(doc)), size)
                        shared = np.bincount(pair, grams[row[pair] * _GRAMS + part.grams[x]], minlength=len(doc))
                        got["title_jaccard"] = _jaccard(shared, self.gram_sizes[low + row].astype(float), size.astype(float))
                        got["same_key"] = (self.keys[low + row] == part.keys[doc]) & (part.keys[doc] != _NO_KEY)
                    out.append(got)
                if not out:
                    continue
                all_ = {c: np.concatenate([o[c] for o in out]) for c in out[0]}
                order = np.lexsort((all_["issue_id"], -np.round(all_[name], 6), all_["row"]))
                row = all_["row"][order]
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                order, rank = order[rank <= self.pool], rank[rank <= self.pool]
                columns = {"score_name": pa.array([name] * len(order))} | {c: all_[c][order] for c in all_ if c != "row"} | {"seed": all_[name][order], "rank": rank.astype(np.int32)}
                yield pa.RecordBatch.from_pydict(columns)


def _jaccard(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((a > 0) & (b > 0), shared / np.maximum(a + b - shared, 1), 0.0)


def lexical_pools(index: SearchIndex, terms: DataFrame, scores: Sequence[str], pool: int, compare: bool = False) -> DataFrame:
    """score_name, qid, issue_id, seed, rank and all lexical scores of the `pool` best records of each query by each score, as candidates.sparse_pools() cuts them from all pairs.

    terms: of query_terms() or ad_hoc_terms(). compare (queries of the corpus only) adds title_jaccard and
    description_jaccard, and same_key: whether both have the same issue key.
    """
    n = terms.agg(F.count_distinct("qid")).first()[0]
    n = max(1, -(-n // BLOCK), min(LEAST_BLOCKS, n // LEAST_QUERIES))
    known = terms.where("term_id IS NOT NULL")
    blocks, packed, groups = _blocks(index, known, n, compare), parts(index), max(1, -(-index.n // GROUP))
    names = ["score_name string", "qid long", "issue_id long", "seed double", "rank int", *[f"{c} double" for c in LEXICAL]]
    names += ["title_jaccard double", "description_jaccard double", "same_key boolean"] if compare else []
    columns = [c.split()[0] for c in names]
    scores, total, avg_length = list(scores), index.n, index.avg_length

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                row = {c: v.as_buffer() if pa.types.is_binary(v.type) or pa.types.is_large_binary(v.type) else v.as_py() for c, v in row.items()}
                if row["block"] != number:
                    if block is not None:
                        yield from (b.select(columns) for b in block.finish())
                    block, number = _Block(row, scores, pool, compare), row["block"]
                block.add(_Part(row, total, avg_length))
        if block is not None:
            yield from (b.select(columns) for b in block.finish())

    left = blocks.repartitionByRange(n, "block")
    found = left.hint("shuffle_replicate_nl").crossJoin(packed.coalesce(groups)).mapInArrow(scan, ", ".join(names))
    if groups == 1:
        return found
    order = Window.partitionBy("score_name", "qid").orderBy(F.desc(F.round("seed", 6)), "issue_id")
    return found.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool).select(*columns)
