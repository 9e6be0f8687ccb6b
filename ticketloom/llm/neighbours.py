"""Most similar vectors for every vector: a small-world graph per shard, stored as flat neighbour arrays; vectors ask the nearest shards, whose results are merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.storage import discard, materialize

#: Cells of a collection; more where a cell would exceed SHARD_ROWS on average, MOST_CELLS at most. A cell of more than
#: SHARD_ROWS vectors is several shards.
CELLS, SHARD_ROWS, MOST_CELLS = 4, 100_000, 512
#: Vectors that the cells' centres are fitted on: so many a cell, but at least and at most these.
SAMPLE_A_CELL, SAMPLE_LEAST, SAMPLE_MOST = 64, 2_048, 32_768
#: Links of a node in the upper layers and in the lowest one; candidates kept while building and while searching.
LINKS, BASE_LINKS, BUILD_BEAM, SEARCH_BEAM = 12, 24, 40, 56
#: Queries that walk the graph together, and nodes that are inserted together.
BATCH = 512
#: Beam entries expanded in one step of the walk.
EXPAND = 4
#: Similarities that a comparison with a whole shard holds at once.
SCAN_CELLS = 4_000_000
#: In a row of ids: no more ids.
NONE = np.iinfo(np.int64).max


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, held as flat neighbour arrays (-1: no link)."""

    def __init__(self, vectors: np.ndarray, seed: int = 5, flat: list[np.ndarray] | None = None):
        """Builds the graph, or takes it from the arrays of flat()."""
        self.v = vectors
        n = len(vectors)
        if flat is not None:
            self.level = np.array([(len(x) - BASE_LINKS) // LINKS for x in flat])
            self.links = []
            for layer in range(int(self.level.max()) + 1):
                lo, width = (0, BASE_LINKS) if layer == 0 else (BASE_LINKS + (layer - 1) * LINKS, LINKS)
                links = np.full((n, width), -1, np.int32)
                at = np.flatnonzero(self.level >= layer)
                links[at] = np.stack([flat[k][lo:lo + width] for k in at])
                self.links.append(links)
            self.entry = int(self.level.argmax())
            return
        rng = np.random.default_rng(seed)
        self.level = (-np.log(rng.random(n) + 1e-12) / np.log(LINKS)).astype(int)
        # Nodes of higher layers come first: a batch then never needs an entry point above those it can find.
        self.order = np.argsort(-self.level, kind="stable")
        top = int(self.level.max()) if n else 0
        self.links = [np.full((n, BASE_LINKS if layer == 0 else LINKS), -1, np.int32) for layer in range(top + 1)]
        self.entry = int(self.order[0]) if n else -1
        self._build()

    def flat(self) -> list[np.ndarray]:
        """Per node its links from the lowest layer up to its own, as one array."""
        return [np.concatenate([self.links[layer][k] for layer in range(level + 1)]) for k, level in enumerate(self.level.tolist())]

    def _build(self) -> None:
        done = 1
        n = len(self.v)
        while done < n:
            batch = self.order[done:done + min(BATCH, done)]
            self._insert(batch)
            done += len(batch)

    def _insert(self, batch: np.ndarray) -> None:
        levels = self.level[batch]
        among = self.v[batch] @ self.v[batch].T
        np.fill_diagonal(among, -np.inf)
        at = np.full(len(batch), self.entry, np.int32)
        for layer in range(len(self.links) - 1, -1, -1):
            here = np.flatnonzero(levels >= layer)
            down = np.flatnonzero(levels < layer)
            if len(down):
                ids, _ = self.walk(self.v[batch[down]], at[down], layer, 1)
                at[down] = ids[:, 0]
            if not len(here):
                continue
            ids, sims = self.walk(self.v[batch[here]], at[here], layer, BUILD_BEAM)
            at[here] = ids[:, 0]
            fellow = among[np.ix_(here, here)]
            k = min(len(here) - 1, BUILD_BEAM // 2)
            if k > 0:
                near = np.argpartition(-fellow, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, batch[here][near].astype(np.int32)], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(fellow, near, 1)], axis=1)
            chosen = self._diverse(ids, sims, LINKS)
            self.links[layer][batch[here], :LINKS] = chosen
            self._link_back(batch[here], chosen, layer)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """Of each row's candidates the m best that are nearer to the row's node than to a better one chosen; then the best of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = (ids >= 0) & np.isfinite(sims)
        v = self.v[np.maximum(ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(ids.shape, bool)
        nearest = np.full(ids.shape, -np.inf, np.float32)
        count = np.zeros(len(ids), int)
        for c in range(ids.shape[1]):
            ok = valid[:, c] & (nearest[:, c] < sims[:, c]) & (count < m)
            taken[ok, c] = True
            count += ok
            nearest = np.where(ok[:, None], np.maximum(nearest, between[:, :, c]), nearest)
        rank = np.argsort(np.where(valid, np.where(taken, 0, 1), 2), axis=1, kind="stable")[:, :m]
        out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        if out.shape[1] < m:
            out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _link_back(self, nodes: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        links = self.links[layer]
        width = links.shape[1]
        src = np.repeat(nodes, chosen.shape[1])
        dst = chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, start, n = np.unique(dst, return_index=True, return_counts=True)
        most = int(n.max()) if len(n) else 0
        fresh = np.full((len(targets), most), -1, np.int32)
        fresh[np.repeat(np.arange(len(targets)), n), np.arange(len(dst)) - np.repeat(start, n)] = src
        ids = np.concatenate([links[targets], fresh], axis=1)
        ids = np.where((ids[:, :, None] == ids[:, None, :]).argmax(axis=2) < np.arange(ids.shape[1]), -1, ids) if ids.shape[1] <= 96 else ids
        full = (ids >= 0).sum(axis=1) > width
        packed = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)
        links[targets[~full]] = packed[~full, :width]
        if full.any():
            t, ids = targets[full], ids[full]
            sims = np.einsum("td,tcd->tc", self.v[t], self.v[np.maximum(ids, 0)])
            links[t] = self._diverse(ids, np.where(ids >= 0, sims, -np.inf), width)

    def walk(self, queries: np.ndarray, entry: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks of all queries in lockstep: (ids, similarities), best first, of width `beam` (-1 where fewer were reached)."""
        links, v = self.links[layer], self.v
        q = len(queries)
        ids = np.full((q, beam), -1, np.int32)
        sims = np.full((q, beam), -np.inf, np.float32)
        open_ = np.zeros((q, beam), bool)
        mark = np.zeros((q, len(v)), np.uint8)
        expand = min(EXPAND, beam)
        ids[:, 0] = entry
        sims[:, 0] = np.einsum("qd,qd->q", queries, v[entry])
        open_[:, 0] = True
        mark[np.arange(q), entry] = 255
        active = np.arange(q)
        while len(active):
            rank = np.where(open_[active], sims[active], -np.inf)
            best = np.argpartition(-rank, expand - 1, axis=1)[:, :expand] if beam > expand else np.tile(np.arange(beam), (len(active), 1))
            useful = np.isfinite(np.take_along_axis(rank, best, 1))
            open_[active[:, None], best] = False
            nodes = np.where(useful, ids[active[:, None], best], -1)
            near = np.where((nodes >= 0)[:, :, None], links[nodes], -1).reshape(len(active), -1)
            r, c = np.nonzero(near >= 0)
            node, row = near[r, c], active[r]
            unseen = mark[row, node] == 0
            r, c, node, row = r[unseen], c[unseen], node[unseen], row[unseen]
            mark[row, node] = c + 1
            once = mark[row, node] == c + 1
            r, c, node, row = r[once], c[once], node[once], row[once]
            found = np.full(near.shape, -np.inf, np.float32)
            found[r, c] = np.einsum("kd,kd->k", queries[row], v[node])
            all_sims = np.concatenate([sims[active], found], axis=1)
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_open = np.concatenate([open_[active], np.isfinite(found)], axis=1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            ids[active] = np.where(np.isfinite(sims[active]), np.take_along_axis(all_ids, keep, 1), -1)
            open_[active] = np.take_along_axis(all_open, keep, 1)
            active = active[open_[active].any(axis=1)]
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(queries), self.entry, np.int32)
        for layer in range(len(self.links) - 1, 0, -1):
            at = self.walk(queries, at, layer, 1)[0][:, 0]
        return self.walk(queries, at, 0, beam)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists of at most `width` ids as rows filled up with NONE."""
    n = np.diff(column.offsets.to_numpy())
    out = np.full((len(n), width), NONE, np.int64)
    out[np.arange(width) < n[:, None]] = column.flatten().to_numpy()
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _scan(queries: np.ndarray, exact: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rounded similarities) of the k most similar others of each query among all rows of the shard, by similarity, then id (-1, -inf: none left)."""
    at, best = np.full((len(queries), k), -1), np.full((len(queries), k), -np.inf)
    step = max(1, SCAN_CELLS // len(own))
    for a in range(0, len(queries), step):
        s = np.round(queries[a:a + step] @ exact.T, 6)
        s[own == ids[a:a + step, None]] = -np.inf
        for r, row in enumerate(s, a):
            near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
            near = near[np.isfinite(row[near])]
            near = near[np.lexsort((own[near], -row[near]))][:k]
            at[r, :len(near)], best[r, :len(near)] = near, row[near]
    return at, best


def _answers(graph: Graph, exact: np.ndarray, own: np.ndarray, members: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, similarity rounded to 6 decimals) of the k most similar members of other classes in the shard, by rounded similarity, then smaller id.

    own holds the smallest id of each class of the shard, members its smallest ids (NONE: no more). The walk keeps an
    arbitrary part of what is equally similar; where that could reach the best k, the whole shard is compared.
    """
    rows, others, sims = [], [], []
    for a in range(0, len(queries), BATCH):
        q, asking = queries[a:a + BATCH], ids[a:a + BATCH]
        near, _ = graph.search(q.astype(np.float32), beam)
        s = np.round(np.einsum("qd,qcd->qc", q, exact[np.maximum(near, 0)]), 6)
        other = own[np.maximum(near, 0)]
        s = np.where((near >= 0) & (other != asking[:, None]), s, -np.inf)
        last = np.where(np.isfinite(s), s, np.inf).min(axis=1)
        # Classes by their smallest id: the k best ids are members of the k best classes.
        order = np.lexsort((other, -s), axis=1)[:, :k]
        s, near = np.take_along_axis(s, order, 1), np.take_along_axis(near, order, 1)
        tied = np.flatnonzero((s[:, -1] <= last) & (len(own) > beam))
        if len(tied):
            near[tied, :], s[tied, :] = _scan(q[tied], exact, own, asking[tied], s.shape[1])
        other = members[np.maximum(near, 0)].reshape(len(q), -1)
        s = np.where(other == NONE, -np.inf, np.repeat(s, members.shape[1], axis=1))
        order = np.lexsort((other, -s), axis=1)[:, :k]
        s, other = np.take_along_axis(s, order, 1), np.take_along_axis(other, order, 1)
        r, c = np.nonzero(np.isfinite(s))
        rows.append(r + a)
        others.append(other[r, c])
        sims.append(s[r, c])
    return np.concatenate(rows), np.concatenate(others), np.concatenate(sims)


_OUT = pa.schema([("space", pa.string()), ("id", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())])


def visits(cells: int) -> int:
    """How many of the nearest cells a vector asks: all of few, and one more each time their number doubles."""
    return min(cells, CELLS + int(np.ceil(np.log2(max(cells / CELLS, 1)))))


def centres(vectors: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centres of `cells` clusters of unit vectors (k-means by cosine)."""
    rng = np.random.default_rng(seed)
    out = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        own = (vectors @ out.T).argmax(axis=1)
        for k in range(len(out)):
            if (own == k).any():
                out[k] = vectors[own == k].sum(axis=0)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def _route(to: np.ndarray, most: int):
    """Adds `cells`: the `most` cells of the nearest centres, the nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _unit(_matrix(b.column("vector"), to.shape[1]))
            near = np.argsort(-np.round(m @ to.T, 9), axis=1, kind="stable")[:, :most].astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, cells], [*b.schema.names, "cells"])

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slot, id) -> the same rows with their place `node` in the graph of the slot and their `links` there."""

    def built(slot: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        column = rows.column("vector").chunk(0)
        flat = Graph(_unit(_matrix(column, len(column[0]))).astype(np.float32)).flat()
        ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
        links = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
        rows = rows.append_column("node", pa.array(np.arange(len(flat), dtype=np.int32))).append_column("links", links)
        yield from rows.to_batches(max_chunksize=4096)

    slot, parts = None, []
    for b in batches:
        slots = b.column("slot").to_numpy()
        cuts = np.flatnonzero(np.diff(slots)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(slots)]])):
            if hi > lo and slots[lo] != slot:
                if parts:
                    yield from built(slot, parts)
                slot, parts = slots[lo], []
            if hi > lo:
                parts.append(b.slice(int(lo), int(hi - lo)))
    if parts:
        yield from built(slot, parts)


def _per_shard(k: int, beam: int):
    """Over rows sorted by (slot, is_query, node): takes the graph of each shard from its node rows, then answers its queries as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, ids, lists, vecs, links, graph, exact, own, members = None, [], [], [], [], None, None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            slots = b.column("slot").to_numpy()
            asks = b.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero((np.diff(slots) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(slots)]])):
                part = b.slice(int(lo), int(hi - lo))
                if slots[lo] != slot:
                    slot, ids, lists, vecs, links, graph = slots[lo], [], [], [], [], None
                own_ids = part.column("id").to_numpy()
                m = _unit(_matrix(part.column("vector"), len(part.column("vector")[0])))
                if not asks[lo]:
                    ids.append(own_ids)
                    lists.append(_padded(part.column("ids"), k + 1))
                    vecs.append(m)
                    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(part.column("links")).to_numpy(zero_copy_only=False))])
                    links += np.split(part.column("links").flatten().to_numpy(), starts[1:-1])
                    continue
                if graph is None:
                    if not ids:
                        continue
                    own, members, exact = np.concatenate(ids), np.concatenate(lists), np.concatenate(vecs)
                    graph = Graph(exact.astype(np.float32), flat=links)
                    lists, vecs, links = [], [], []
                rows, others, sims = _answers(graph, exact, own, members, own_ids, m, k, beam)
                yield pa.RecordBatch.from_arrays([part.column("space").take(pa.array(rows)), pa.array(own_ids[rows]), pa.array(others), pa.array(sims)], schema=_OUT)

    return run


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str, dimension: int, space: str) -> DataFrame:
    """space, id, vector of the vectors that take part: not null, of the dimension, every element a finite number, not all zero.

    Repeated rows count once; of several vectors of one id the smallest (compared element by element) counts.
    """
    v = F.col(vector_col)
    good = (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return (
        rows.where(F.col(id_col).isNotNull() & v.isNotNull() & good)
        .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("vector"))
        .select(F.lit(space).alias("space"), "id", "vector")
    )


def equal_classes(rows: DataFrame, n_ids: int) -> tuple[DataFrame, DataFrame]:
    """Of rows of usable_vectors: (space, id, vector, ids) of every distinct vector with the smallest id and the n_ids smallest that have it; (space, class, id) of all rows.

    Vectors are told apart by 128 bits of hashes, so the vectors themselves are moved once only.
    """
    rows = materialize(rows.withColumns({f"k{k}": F.xxhash64("vector", F.lit(k)) for k in (1, 2)}), "vectors")
    keys = rows.select("space", "k1", "k2", "id")
    first = keys.groupBy("space", "k1", "k2").agg(F.min("id").alias("class"))
    members = materialize(keys.join(first.hint("merge"), ["space", "k1", "k2"]).select("space", "class", "id"), "members")
    least = members.withColumn("place", F.row_number().over(Window.partitionBy("space", "class").orderBy("id"))).where(F.col("place") <= n_ids)
    ids = least.groupBy("space", F.col("class").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("ids"))
    classes = materialize(rows.select("space", "id", "vector").join(ids.hint("merge"), ["space", "id"]).select("space", "id", "vector", "ids"), "classes")
    discard(rows)
    return classes, members


def _routed(classes: DataFrame, cells: int, shard_rows: int) -> tuple[DataFrame, dict[str, list[int]]]:
    """classes with `cells`, the cells each vector asks (its own first), written to the shared folder; per space the number of shards of every cell."""
    kinds, out, sizes = dict(classes.dtypes), None, {}
    schema = f"space string, id long, vector {kinds['vector']}, ids array<long>, cells array<int>"
    for r in classes.groupBy("space").agg(F.count("*").alias("n"), F.first(F.size("vector")).alias("d")).orderBy("space").collect():
        here = classes.where(F.col("space") == r.space)
        n = min(MOST_CELLS, max(cells, -(-r.n // shard_rows)))
        sample = here.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(min(SAMPLE_MOST, max(SAMPLE_LEAST, SAMPLE_A_CELL * n))).select("vector").toArrow()
        to = centres(_unit(_matrix(sample.column("vector").combine_chunks(), r.d)), n)
        part = here.select("space", "id", "vector", "ids").mapInArrow(_route(to, visits(len(to))), schema)
        out, sizes[r.space] = part if out is None else out.unionByName(part), [0] * len(to)
    if out is None:
        return classes.withColumn("cells", F.array().cast("array<int>")), sizes
    out = materialize(out, "routed")
    for r in out.groupBy("space", F.col("cells")[0].alias("cell")).count().collect():
        sizes[r.space][r.cell] = -(-r["count"] // shard_rows)
    return out, sizes


def nearest(spaces: list[DataFrame], k: int, cells: int = CELLS, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """space, id, other, similarity, rank: for every vector the k most similar others of its space (cosine rounded to 6 decimals, then the smaller id).

    spaces are tables of usable_vectors. Equal vectors make one class, which is indexed and asked for once.

    1. Centres fitted on a bounded sample cut a space into cells; every class belongs to its nearest one. A cell of more
       than shard_rows classes is cut further by a hash of the id. Each such shard has one graph, built by one task and
       stored row by row: a class with its links on all layers as one flat array.
    2. Every class asks the shards of its nearest cells (visits()), so the work grows with the number of classes alone. A
       task loads the graph of one shard; the classes that ask pass by as a stream.
    3. A class's best over those shards and its own smallest ids, one more than k, give the answer of every member,
       itself left out.

    Approximate: a neighbour is missed if its cell is not asked or the walk of its shard misses it; the similarities are
    exact, and so are ties. Spaces of one vector or none give no rows.
    """
    rows = spaces[0]
    for s in spaces[1:]:
        rows = rows.unionByName(s)
    classes, members = equal_classes(rows, k + 1)
    routed, sizes = _routed(classes, cells, shard_rows)
    first, firsts, counts = 0, F.lit(None).cast("array<int>"), F.lit(None).cast("array<int>")
    for space, shards in sizes.items():
        here, starts = F.col("space") == space, np.cumsum([first, *shards]).tolist()
        firsts = F.when(here, F.array(*map(F.lit, starts[:-1]))).otherwise(firsts)
        counts = F.when(here, F.array(*map(F.lit, shards))).otherwise(counts)
        first = starts[-1]
    own = F.col("cells")[0]
    shard_of = F.get(firsts, own) + F.pmod(F.xxhash64("id"), F.get(counts, own).cast("bigint")).cast("int")
    indexed = routed.select("space", "id", "vector", "ids", shard_of.alias("slot")).repartitionById(max(first, 1), F.col("slot")).sortWithinPartitions("slot", "id")
    kind = dict(routed.dtypes)["vector"]
    graphs = materialize(indexed.mapInArrow(_build, f"space string, id long, vector {kind}, ids array<long>, slot int, node int, links array<int>"), "graphs")
    asked = F.flatten(F.transform(F.filter("cells", lambda c: F.get(counts, c) > 0), lambda c: F.sequence(F.get(firsts, c), F.get(firsts, c) + F.get(counts, c) - 1)))
    asks = routed.select("space", "id", "vector", F.explode(asked).alias("slot"), F.lit(True).alias("is_query"))
    placed = graphs.withColumn("is_query", F.lit(False)).unionByName(asks, allowMissingColumns=True).repartitionById(max(first, 1), F.col("slot")).sortWithinPartitions("slot", "is_query", "node")
    found = placed.select("slot", "is_query", "space", "id", "vector", "ids", "links").mapInArrow(_per_shard(k, beam), "space string, id long, other long, similarity double")
    found = found.unionByName(classes.select("space", "id", F.explode("ids").alias("other"), F.lit(1.0).alias("similarity")))
    best = Window.partitionBy("space", "id").orderBy(F.desc("similarity"), "other")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    lists = found.groupBy("space", F.col("id").alias("class")).agg(F.array_sort(F.collect_list(F.struct("place", "other", "similarity"))).alias("found"))
    others = F.slice(F.filter("found", lambda f: f["other"] != F.col("id")), 1, k)
    out = members.join(lists.hint("merge"), ["space", "class"]).select("space", "id", F.posexplode(others).alias("at", "f"))
    return out.select("space", "id", "f.other", "f.similarity", (F.col("at") + 1).alias("rank"))


def similar_pairs(neighbours: DataFrame, least: float) -> DataFrame:
    """space_name, left_issue_id < right_issue_id: distinct pairs of nearest() with at least that similarity."""
    return neighbours.where(F.col("similarity") >= least).select(
        F.col("space").alias("space_name"), F.least("id", "other").alias("left_issue_id"), F.greatest("id", "other").alias("right_issue_id")).distinct()
