"""Connected components by contraction and alternating large-star and small-star rounds.

Edges are first contracted task by task: each bounded run of edges becomes stars around
its smallest nodes, without an exchange.  A round of stars is two aggregations
and two equi-joins over the edges, so no node's neighbours are ever gathered in one
row.  Hot nodes (centres of large stars) are pre-aggregated before the shuffle,
and in the joins, which ``join_counted`` makes, their edges stay where they are.  The
edges of every round go to the shared checkpoint folder.  Rounds end when nothing
changes; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.joins import join_counted
from prosegauge.runtime import cut

#: Edges in a file of a round, and in a run that a task contracts.
A_FILE, A_RUN = 100_000, 1 << 18


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each is linked to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[one], root[other]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        node, root = roots(*map(np.concatenate, zip(*held)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(node[node != root]), pa.array(root[node != root])], names=["u", "v"])

    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        if sum(len(a) for a, _ in held) >= A_RUN:
            yield flush()
    if held:
        yield flush()


def _kept(edges: DataFrame, n: int) -> DataFrame:
    """Edges contracted and checkpointed, in as many parts as their number needs."""
    parts = -(-max(1, n) // A_FILE)
    if parts < int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        edges = edges.repartition(parts)
    return cut(edges.mapInArrow(_contracted, "u long, v long"))


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"] or 0


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("count"))
    least = least.select("u", F.least("u", "m").alias("m"), "count")
    return join_counted(both.where("v > u"), least, ["u"], total=n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("count"))
    moved = join_counted(edges, least, ["u"], total=n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for each node of an edge.

    ``edges`` has columns ``a`` and ``b``; edges with a null end and loops are
    left out, repeated edges count once.  No edges: no rows.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges = _kept(edges, edges.count())
    state, before = _state(edges), None
    while state[0] and state != before:
        edges = _kept(_small_star(cut(_large_star(edges, state[0])), state[0]), state[0])
        before, state = state, _state(edges)
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
