"""Connected components of an edge list.

Every task first replaces its edges by a forest of stars (union-find over its own part), so what
is left is at most one edge for each vertex and task.  Then rounds follow until only stars are
left: all edges of a vertex meet and are joined up with what else lies there, and every
edge is moved on from its end to that end's own ends.  Rounds grow with the logarithm of the
longest path.  A vertex with very many neighbours is never dealt by its neighbours but only as
the end of a join, which the skew join splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import stage


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of this part as (vertex, least vertex of its component here)."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        top = v
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(v, v)) != top:
            parent[v], v = top, p
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    members = list(parent)
    yield pa.record_batch({"a": pa.array(members, pa.int64()), "b": pa.array([root(v) for v in members], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` (the smallest vertex reachable) of every vertex in ``a, b``; repeated edges and loops do no harm.

    Each round is written to the shared folder; the driver sees whether anything has changed.
    """
    now = stage(edges.select("a", "b").mapInArrow(_stars, "a long, b long"), "edges")
    while True:
        met = now.repartition("a").mapInArrow(_stars, "a long, b long")
        ends = met.select(F.col("a").alias("b"), F.col("b").alias("end"))
        moved = met.join(ends.hint("merge"), "b", "left")
        now = stage(moved.select("a", F.coalesce("end", "b").alias("b"), F.col("end").isNotNull().alias("moved")).distinct(), "edges")
        if now.where("moved").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
    found = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("vertex"), "component").distinct())
