"""Connected components of an edge list too large for one machine.

Each partition first contracts its edges with union-find, so what is shuffled is a forest.
Then large-star and small-star steps alternate until the edges no longer change; they end
as one star per component around its smallest node. Both steps are an aggregation and a
join by node. The aggregates are written before they are joined: then both sides of the join
are plain exchanges, and adaptive execution splits the node with most neighbours.

Defined cases: no edges give no rows; edges may repeat and run in both directions; an edge
from a node to itself adds nothing; nodes are of any type that sorts, and not null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import discard, materialize


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of each partition as stars (node, root)."""

    def run(it):
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in it:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                u, v = root(u), root(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
            if len(parent) > 2_000_000:  # bounds memory; what is left over meets in the next step
                yield stars(parent, root, b.schema)
                parent.clear()
        if parent:
            yield stars(parent, root, edges_schema)

    edges_schema = pa.schema([("u", pa.binary() if edges.schema["u"].dataType.simpleString() == "binary" else pa.int64())] * 1)

    def stars(parent, root, schema):
        kind = schema.field(0).type
        nodes = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, edges.schema)


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (u, root) for every node that is not the smallest of its component."""
    e = materialize(_contracted(edges).distinct(), "edges")
    was = _state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large-star")
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        e = materialize(small, "edges")
        discard(least, large, down)
        now = _state(e)
        if now == was:
            break
        was = now
    return e.select("u", F.col("v").alias("root"))
