"""Connected components over an edge table, in rounds of two star contractions.

Large star: each node links its larger neighbours to the least one it knows;
small star: each node links its smaller neighbours and itself to the least.
Both keep components and turn any graph into stars in few rounds. A node of
huge degree is split by the skewed-join handling, counts and minima combine
before the shuffle, and each round is written to the shared folder. A graph of
up to SINGLE edges, whether it came so or rounds made it so, is finished at
once by one task: each round costs the driver a dozen shuffles, however few
edges are left.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch, ship

#: Edges that one task finishes (16 bytes each).
SINGLE = 1 << 17


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    linked = joined.where("v > u") if large else joined
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def stars(u, v):
    """(nodes, roots) of edges (numpy arrays in and out): each node that is no root, and the least node it can reach."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        hooked = root.copy()
        np.minimum.at(hooked, root[a], low)
        np.minimum.at(hooked, root[b], low)
        while (hooked != (up := hooked[hooked])).any():
            hooked = up
        root = hooked
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _finish(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    parts = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(2)] for b in batches]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(np.concatenate(x) for x in zip(*parts)))], names=["u", "root"])


def roots(edges: DataFrame) -> DataFrame:
    """(u, root): for each node of `edges` (u, v) but the roots, the least node it can reach; ids are bigints.

    No edges give no rows; loops and repeated edges change nothing.
    """
    edges = scratch(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0] > SINGLE:
        older, edges = edges, scratch(_star(_star(edges, True), False), "edges")
        drop_scratch(older)
        before, state = state, _state(edges)
        if before == state:
            return edges.select("u", F.col("v").alias("root"))
    ship(edges.sparkSession)
    return scratch(edges.coalesce(1).mapInArrow(_finish, "u bigint, root bigint"), "roots")
