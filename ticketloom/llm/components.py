"""Group identifiers for records linked directly or indirectly: the giant component is peeled by frontier joins, the rest labelled by minimum propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.references import named_ids
from ticketloom.storage import discard, is_written, materialize

#: Rounds of minimum propagation before the hub is chosen. Small components are complete by then and have no edges
#: left, so the hub is found among the large ones, whose paths are shorter as well.
FIRST_ROUNDS = 3
#: Frontier joins between two contractions. The search goes on until the frontier is empty, whatever their number.
FRONTIER_ROUNDS = 4


def tied_edges(rows: DataFrame, fields: list[str], id_col: str = "issue_id") -> DataFrame:
    """Distinct edges (u < v) between ids that both have rows, from text fields that name ids."""
    ids = rows.select(F.col(id_col).alias("v")).where(F.col("v").isNotNull()).distinct()
    named = F.array_distinct(F.concat(*[named_ids(F.col(f)) for f in fields]))
    pairs = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("a"), F.explode(named).alias("v")).where(F.col("a") != F.col("v")).distinct()
    return pairs.hint("merge").join(ids.hint("merge"), "v", "left_semi").select(F.least("a", "v").alias("u"), F.greatest("a", "v").alias("v")).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def propagate(edges: DataFrame) -> DataFrame:
    """(u, parent): one round of minimum propagation. Every vertex takes the smallest id among its neighbours and itself, then twice its parent's parent."""
    low = _both_ways(edges).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("parent"))
    for _ in range(2):
        up = low.select(F.col("u").alias("parent"), F.col("parent").alias("above"))
        low = low.hint("merge").join(up.hint("merge"), "parent").select("u", F.col("above").alias("parent"))
    return low


def contract(edges: DataFrame, parent: DataFrame) -> DataFrame:
    """Edges between the parents of the ends (an end without parent stays), without loops and repeats."""
    pu = parent.select("u", F.col("parent").alias("pu"))
    pv = parent.select(F.col("u").alias("v"), F.col("parent").alias("pv"))
    moved = edges.join(pu, "u", "left").hint("merge").join(pv, "v", "left").select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
    return materialize(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")


def compose(mappings: list[tuple[DataFrame, bool]]) -> DataFrame:
    """(u, parent) of doing the mappings one after the other, put together from the last: each is a part of the size of the one before.

    The flag tells whether a mapping names every vertex that is left; vertices that one does not name keep their parent.
    """
    labels = mappings[-1][0]
    for mapped, every in reversed(mappings[:-1]):
        above = labels.select(F.col("u").alias("parent"), F.col("parent").alias("above")).hint("merge")
        own = mapped.hint("merge").join(above, "parent", "left").select("u", F.coalesce("above", "parent").alias("parent"))
        labels = own if every else own.unionByName(labels.hint("merge").join(mapped.select("u").hint("merge"), "u", "left_anti"))
    return labels


def _hub(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The vertex (u) with edges that stands for most ids so far; of equal ones that of most edges, then the smallest."""
    degree = _both_ways(edges).groupBy("u").agg(F.count("*").alias("degree"))
    size = labels.groupBy(F.col("parent").alias("u")).agg(F.count("*").alias("size"))
    ranked = degree.hint("merge").join(size.hint("merge"), "u", "left")
    return ranked.orderBy(F.desc_nulls_last("size"), F.desc("degree"), "u").select("u").limit(1)


def _frontiers(edges: DataFrame, start: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """(seen, whole): the vertices within `rounds` frontier joins of start, and whether nothing more can be reached."""
    seen = frontier = materialize(start, "frontier")
    steps = _both_ways(edges)
    for _ in range(rounds):
        reached = frontier.join(steps.hint("merge"), "u").select(F.col("v").alias("u")).distinct().hint("merge").join(seen, "u", "left_anti")
        frontier = materialize(reached, "frontier")
        if frontier.isEmpty():
            return seen, True
        seen = seen.unionByName(frontier)
    return seen, False


def connected_components(edges: DataFrame, first_rounds: int = FIRST_ROUNDS, frontier_rounds: int = FRONTIER_ROUNDS, report: dict | None = None) -> DataFrame:
    """Labels (id, group_id) of every id in an edge (u, v); group_id is the smallest id of its component.

    1. first_rounds rounds of minimum propagation contract the graph; components that they complete have no edges left.
    2. The largest vertex that still has edges is the hub. Breadth-first frontier joins from it go on until the
       frontier is empty: its component is then wholly known, becomes one vertex and is anti-joined away. After every
       frontier_rounds joins what was reached becomes one vertex and the graph is contracted once more, so a component
       of a long diameter takes logarithmically many joins as well.
    3. What remains is labelled by further rounds of minimum propagation.

    The mappings of all rounds, each a part of the size of the one before, are composed at the end. Self loops and null ends are ignored; repeated
    edges count once; no edges give no rows. report: a dictionary that gets 'frontier_joins' and 'peeled' (ids).
    """
    edges = materialize(
        edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
    )
    mappings: list[tuple[DataFrame, bool]] = []
    joins, peeled = 0, None

    def step(mapped: DataFrame, every: bool) -> None:
        nonlocal edges
        mapped = mapped if is_written(mapped) else materialize(mapped, "parent")
        mappings.append((mapped, every))
        following = contract(edges, mapped)
        discard(edges)
        edges = following

    if not first_rounds:  # every id stands for itself
        mappings.append((materialize(_both_ways(edges).select("u").distinct().select("u", F.col("u").alias("parent")), "parent"), True))
    for _ in range(first_rounds):
        if not mappings or not edges.isEmpty():
            step(propagate(edges), True)
    start = None if edges.isEmpty() else materialize(_hub(edges, compose(mappings)), "hub")
    while start is not None:
        seen, whole = _frontiers(edges, start, frontier_rounds)
        joins += frontier_rounds
        root = seen.agg(F.min("u")).first()[0]
        merged = seen.select("u", F.lit(root).cast("bigint").alias("parent"))
        if whole:
            rest = materialize(edges.join(seen.hint("merge"), "u", "left_anti"), "edges")
            mappings.append((materialize(merged, "parent"), False))
            discard(edges)
            edges, start, peeled = rest, None, root
        else:
            step(merged, False)
            low = materialize(propagate(edges), "parent")
            start = materialize(low.where(F.col("u") == root).select(F.col("parent").alias("u")), "hub")
            step(low, True)
    while not edges.isEmpty():
        step(propagate(edges), True)
    labels = compose(mappings)
    if report is not None:
        report.update(frontier_joins=joins, peeled=0 if peeled is None else labels.where(F.col("parent") == peeled).count())
    return labels.select(F.col("u").alias("id"), F.col("parent").alias("group_id"))
