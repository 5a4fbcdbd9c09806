"""Connected components of an edge table: forests within tasks, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm.common import fitted, settle

EDGE = "u long, v long"


def local_forest(batches: Iterator[pa.RecordBatch], at_once: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Edges of one task -> (node, smallest node it is linked with here) for all but the smallest ones."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                above[max(u, v)] = min(u, v)
    nodes = [x for x in above if above[x] != x]
    for k in range(0, len(nodes), at_once):
        part = nodes[k : k + at_once]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, edges_per_task: int = 500_000, settle: Callable[[DataFrame, str], DataFrame] = settle) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``node, root`` for every node of an edge; root is the smallest id.

    Each task reduces about ``edges_per_task`` edges to a forest, whose trees are stars. As many tasks as the
    edges need do so; one alone is done with that. The forests of several are joined by
    star steps: each joins nodes with the smallest of their neighbours, found by a pre-aggregated minimum, so
    a node with very many neighbours is no special case. The number of steps grows with the
    logarithm of the longest chain. Every step is written to the shared folder. Self loops and
    repeated edges are fine; with no edge the result is empty. The work is done when this is called, not when the result is read.
    """
    edges = settle(edges.select("a", "b"), "edges")
    tasks = max(1, -(-edges.count() // edges_per_task))
    star = settle((edges.coalesce(1) if tasks == 1 else edges.repartition(tasks)).mapInArrow(local_forest, EDGE), "star")
    seen, settled = None, tasks == 1
    while not settled:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "star")
        state = star.agg(
            F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))
        ).first()
        settled, seen = state == seen, state
    roots = fitted(star.select("v").distinct(), star.count()).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
