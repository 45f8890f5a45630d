"""Connected components of links between ids: alternating large-star and small-star steps, and one task for what is few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Of two longs each: as many links or fewer are joined in one task, which a few shuffles of many steps would outweigh.
LOCAL_LINKS = 200_000


def _joined(batches):
    """u, v -> node, component of all links that come; path halving."""
    parts = [np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)]) for b in batches if b.num_rows]
    if not parts:
        return
    ids, places = np.unique(np.concatenate(parts, 1), return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in places.reshape(2, -1).T.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)  # ids are sorted, so the smallest is the root
    roots = np.array([find(x) for x in range(len(ids))])
    moved = np.flatnonzero(roots != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[roots[moved]])], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, component: the smallest id reachable, for every node that has a smaller one.

    Neighbours are only ever reduced to their minimum, which tasks aggregate before they send anything; a node
    with very many neighbours meets its minimum in a join that may be split. Links stay on the executors. Steps go on
    until every node points to one that points nowhere, or until so few links are left that one task can take them.
    """
    state = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "links")
    while state.limit(LOCAL_LINKS + 1).count() > LOCAL_LINKS:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.hint("merge").join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        step = materialize(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(state)
        state = step
        # Every node points to one that points nowhere: a node that points twice, or to one that points on, is unsettled.
        ends = state.groupBy("u").agg(F.count(F.lit(1)).alias("n")).unionByName(state.select(F.col("v").alias("u"), F.lit(-1).cast("long").alias("n")).distinct())
        if ends.groupBy("u").agg(F.count(F.lit(1)).alias("sides"), F.max("n").alias("n")).where("sides > 1 or n > 1").isEmpty():
            return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return materialize(state.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
