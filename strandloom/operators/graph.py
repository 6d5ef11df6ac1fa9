"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

EDGES = "a long, b long"


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and, for each, the least node that these edges reach: label passing with pointer jumping."""
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = ix[: len(a)], ix[len(a) :], np.arange(len(nodes))
    while len(x):
        m = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], m)
        np.minimum.at(root, root[y], m)
        while (jump := root[root]).tobytes() != root.tobytes():
            root = jump
        keep = root[x] != root[y]
        x, y = x[keep], y[keep]
    return nodes, nodes[root]


#: edges that a task's Python holds before it contracts them, about
MOST = 1 << 20


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a task by stars of local components. Edges are contracted MOST at a time, and stars go out when they fill half of
    that, so memory has a bound whatever the task holds; rounds join what was parted."""
    have: list[list[np.ndarray]] = [[], []]
    size = 0
    for x in batches:
        for i in (0, 1):
            have[i].append(x.column(i).to_numpy())
        size += len(x)
        if size >= MOST:
            n, r = local_roots(*(np.concatenate(h) for h in have))
            n, r = n[n != r], r[n != r]
            if len(n) > MOST // 2:
                yield from _edges(n, r)
                n, r = n[:0], r[:0]
            have, size = [[n], [r]], len(n)
    if size:
        n, r = local_roots(*(np.concatenate(h) for h in have))
        yield from _edges(n[n != r], r[n != r])


def _edges(a: np.ndarray, b: np.ndarray, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(a), rows):
        yield pa.RecordBatch.from_arrays([pa.array(a[k : k + rows]), pa.array(b[k : k + rows])], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the least node reachable.

    Each task first contracts its own edges; then large-star and small-star rounds run until nothing
    changes. Empty input gives no rows; self-loops and repeated edges have no effect.
    """
    ship(edges.sparkSession)
    e = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, EDGES)
    e = cut(e)
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        e = down.join(small, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
