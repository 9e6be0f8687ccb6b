"""Long exact spans shared between documents: winnowed anchors route texts past suffix automata of bounded reference shards."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.storage import discard, materialize

#: Characters of an anchor; any string of `least` characters holds one of its text's anchors wholly.
ANCHOR = 80
#: Characters of distinct text of a reference shard, and of the shards whose automaton is built together.
SHARD_CHARS = 150_000
#: Tasks of a stage at most.
MOST_TASKS = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k codes: doubling, so O(n log k) vector operations."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = _mix(codes.astype(np.uint64) + np.uint64(1))
    out, done, width = None, 0, 1
    while True:
        if k & width:
            out = h[:n].copy() if out is None else _mix(out * _BASE + h[done:done + n])
            done += width
            if done == k:
                return out
        h = _mix(h[:-width] * _BASE + h[width:] + np.uint64(width))
        width *= 2


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values, by doubling."""
    out, width = x, 1
    while width * 2 <= w:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[:len(x) - w + 1], out[w - width:]) if width < w else out


def anchors(codes: np.ndarray, least: int, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the winnowed anchors: of every `least` characters the k-gram of the least hash (the first of equals)."""
    h = gram_hashes(codes, k)
    w = least - k + 1
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    ranked = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    at = np.unique(_window_minima(ranked, w) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return h[at].view(np.int64), at


class Automaton:
    """A suffix automaton of several texts, each belonging to one or more owners; every state knows whether it occurs with two owners."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.owner: list[int] = [-1]
        self.shared: list[int] = []

    def add(self, text: str, owner: int) -> None:
        """owner: a number of the owner; -2 for a text that two owners have."""
        nxt, link, length, own = self.next, self.link, self.length, self.owner
        last = 0
        for c in text:
            if c in nxt[last]:
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._split(last, q, c)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                own.append(-1)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
                last = cur
            own[last] = owner if own[last] in (-1, owner) else -2

    def _split(self, p: int, q: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.owner.append(-1)
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def finish(self) -> None:
        """shared[s]: length of the longest suffix of state s that two owners have."""
        own, link, length = self.owner, self.link, self.length
        order = sorted(range(1, len(link)), key=length.__getitem__, reverse=True)
        for s in order:
            up = link[s]
            if own[s] != -1:
                own[up] = own[s] if own[up] in (-1, own[s]) else -2
        self.shared = [0] * len(link)
        for s in reversed(order):
            self.shared[s] = length[s] if own[s] == -2 else self.shared[link[s]]

    def spans(self, text: str, least: int) -> list[tuple[int, int]]:
        """Runs of the text (one that was added) covered by strings of at least `least` characters that two owners have."""
        s, out = 0, []
        for k, c in enumerate(text):
            s = self.next[s][c]
            n = self.shared[s]
            if n >= least:
                if out and out[-1][1] >= k + 1 - n:
                    while len(out) > 1 and out[-2][1] >= k + 1 - n:
                        out.pop()
                    out[-1] = (min(out[-1][0], k + 1 - n), k + 1)
                else:
                    out.append((k + 1 - n, k + 1))
        return out


def _merge(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals; overlapping and touching ones become one."""
    out: list[list[int]] = []
    for b, e in sorted(zip(begin.tolist(), end.tolist())):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def _anchor_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            hs, ps, ds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d, t in zip(ids, b.column("text").to_pylist()):
                h, p = anchors(_codes(t), least)
                hs.append(h)
                ps.append(p)
                ds.append(np.full(len(h), d, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ds, hs, ps)], ["doc_id", "hash", "pos"])

    return run


def _grouped(places: DataFrame) -> DataFrame:
    return places.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "pos")).alias("places"))


def _region_rows(least: int, length: int):
    """(doc_id, text, places [(shard, pos)]) -> (shard, doc_id, begin, region): per shard the text around its anchors of `length` characters, neighbours merged."""
    reach = least - length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, text, places in zip(pdf["doc_id"], pdf["text"], pdf["places"]):
                by = defaultdict(list)
                for p in places:
                    by[p["shard"]].append(p["pos"])
                for shard, at in by.items():
                    at = np.array(at)
                    for b, e in _merge(np.maximum(at - reach, 0), np.minimum(at + least, len(text))):
                        rows.append((shard, d, b, text[b:e]))
            yield pd.DataFrame(rows, columns=["shard", "doc_id", "begin", "region"])

    return run


def longer(length: int, least: int) -> tuple[int, int]:
    """(step, length) of the two longer anchors, at pos - step and at pos, of which every window of `least` characters around an anchor of `length` holds one."""
    step = -(-(least - length) // 2)
    return step, min(length + step, least + 1 - step)


def _longer_rows(least: int, length: int):
    """(doc_id, text, places) -> (doc_id, hash, pos) of the longer anchors that stand for anchors of `length` characters."""
    step, more = longer(length, least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, text, places in zip(pdf["doc_id"], pdf["text"], pdf["places"]):
                for at in sorted({q for p in places for q in (p["pos"] - step, p["pos"]) if 0 <= q <= len(text) - more}):
                    rows.append((d, gram_hashes(_codes(text[at:at + more]), more)[:1].view(np.int64)[0], at))
            yield pd.DataFrame(rows, columns=["doc_id", "hash", "pos"])

    return run


def _automaton_spans(least: int):
    """Distinct regions of some shards (shard, k1, k2, low, high, region) -> spans (shard, k1, k2, s, e) inside each region of one owner."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["shard", "k1", "k2"], ignore_index=True)
        owner = pd.factorize(pdf["low"])[0]
        owner[(pdf["low"] != pdf["high"]).to_numpy()] = -2
        automaton = Automaton()
        for region, own in zip(pdf["region"], owner.tolist()):
            automaton.add(region, own)
        automaton.finish()
        rows = [(k, s, e) for k in np.flatnonzero(owner != -2).tolist() for s, e in automaton.spans(pdf["region"].iat[k], least)]
        out = pdf[["shard", "k1", "k2"]].iloc[[r[0] for r in rows]].reset_index(drop=True)
        return out.assign(s=[r[1] for r in rows], e=[r[2] for r in rows])

    return run


def _by_automata(distinct: DataFrame, needed: DataFrame, least: int, shard_chars: int) -> DataFrame:
    """Spans (shard, k1, k2, s, e) inside the regions of one owner; shards are put together to automata of about shard_chars characters."""
    chars = needed.agg(F.sum("chars")).first()[0] or 0
    bundles = int(max(1, -(-chars // max(shard_chars, 1))))
    rows = distinct.join(needed.select("shard"), "shard", "left_semi").withColumn("bundle", F.pmod(F.xxhash64("shard"), F.lit(bundles)))
    # A task for every automaton: they are small as data and long as work, so the optimiser would put too many together.
    rows = rows.repartition(min(bundles, MOST_TASKS), "bundle")
    return rows.groupBy("bundle").applyInPandas(_automaton_spans(least), "shard long, k1 long, k2 long, s long, e long")


def unite(spans: DataFrame) -> DataFrame:
    """Per doc_id the union of its spans; overlapping and touching ones become one."""
    order = Window.partitionBy("doc_id").orderBy("span_start", "span_end")
    reached = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reached.isNull() | (F.col("span_start") > reached), 1).otherwise(0)
    runs = spans.withColumn("__new", begins).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "__run").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end")).drop("__run")


def shared_spans(docs: DataFrame, least: int = 200, doc_id: str = "doc_id", text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, span_start, span_end: maximal runs of characters that lie in strings of at least `least` characters which another doc_id's text holds too.

    Positions are code points from 0, the end exclusive; overlapping or touching strings make one run.

    1. Winnowing picks anchors (hashes of ANCHOR characters) such that every `least` characters hold one; equal strings
       have equal anchors. Anchors in one document only end here (a count with partial aggregation).
    2. The reference shard of an anchor is the smallest document that has it. Each document sends the text around its
       anchors (every window of `least` characters that holds one) to their shards, so two documents with a common
       string meet in a shard of one of its anchors: no pairs are made. Equal regions of a shard are one, with its
       smallest and largest document.
    3. A shard of more than shard_chars of distinct text (one passage in a large part of all documents) is routed anew
       by longer anchors, two for each of its anchors, until every shard fits: at the full length of a window all
       regions of a shard are equal. All shards are thus bounded and treated alike.
    4. A suffix automaton of the distinct regions of a shard marks the states that two documents reach. Each region of
       one document streams through it, and the matching statistics above the threshold are its spans; a region that
       two documents have is a span itself.
    5. The spans of a region go back to every document that has it, and the runs of a document are united.

    Null, empty and shorter texts have no spans; a repeated row of one doc_id is no other document; an empty table
    gives no rows. Hashes only route and name regions (128 bits).
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= least))
    found = materialize(texts.mapInArrow(_anchor_rows(least), "doc_id long, hash long, pos long"), "anchors")
    in_two = lambda t, *more: t.groupBy("hash").agg(F.min("doc_id").alias("shard"), F.max("doc_id").alias("most")).where("shard < most").select("hash", *more)
    places = materialize(found.join(in_two(found, "shard").hint("merge"), "hash").select("doc_id", "shard", "pos"), "places")
    discard(found)
    length, out = ANCHOR, None
    while True:
        rows = texts.hint("merge").join(_grouped(places).hint("merge"), "doc_id").mapInPandas(_region_rows(least, length), "shard long, doc_id long, begin long, region string")
        regions = materialize(rows.withColumns({f"k{k}": F.xxhash64("region", F.lit(k)) for k in (1, 2)}), "regions")
        distinct = regions.groupBy("shard", "k1", "k2", "region").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        distinct = materialize(distinct, "distinct")
        sizes = materialize(distinct.groupBy("shard").agg(F.sum(F.length("region")).alias("chars"), F.count_if(F.col("low") == F.col("high")).alias("single")), "sizes")
        large = sizes.where((F.col("single") > 0) & (F.col("chars") > shard_chars) & F.lit(length < least)).select("shard")
        fits = sizes.where((F.col("single") > 0) & ((F.col("chars") <= shard_chars) | F.lit(length == least)))
        whole = distinct.where("low < high").join(large, "shard", "left_anti").select("shard", "k1", "k2", F.lit(0).cast("bigint").alias("s"), F.length("region").cast("bigint").alias("e"))
        spans = whole.unionByName(_by_automata(distinct, fits, least, shard_chars)).hint("merge")
        placed = spans.join(regions.select("shard", "k1", "k2", "doc_id", "begin"), ["shard", "k1", "k2"]).select("doc_id", (F.col("begin") + F.col("s")).alias("span_start"), (F.col("begin") + F.col("e")).alias("span_end"))
        out = placed if out is None else out.unionByName(placed)
        if large.isEmpty():
            return unite(out.distinct())
        again = places.join(large, "shard", "left_semi")
        longer_found = materialize(texts.hint("merge").join(_grouped(again).hint("merge"), "doc_id").mapInPandas(_longer_rows(least, length), "doc_id long, hash long, pos long"), "anchors")
        length = longer(length, least)[1]
        places = materialize(longer_found.join(in_two(longer_found).hint("merge"), "hash").select("doc_id", F.col("hash").alias("shard"), "pos"), "places")


def shared_parts(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_chars, n_spans, shared_chars and shared_part (0..1, null for empty and null texts); documents without spans included."""
    own = spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.length(text).cast("long").alias("n_chars")).distinct()
    joined = rows.join(own, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
    return joined.withColumn("shared_part", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)))
