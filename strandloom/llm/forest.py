"""Embedding near-duplicates by a forest of random-projection trees with spill.

1. Equal vectors of one label form a class. Vectors that are null, zero, or hold null or non-finite
   components, and rows without a label, link with nothing.
2. Each tree splits recursively at the median of a random projection, fitted on at most `SAMPLE` vectors that
   a hash picks. Every class goes down all trees; near a threshold it goes to both children, so a close pair
   is rarely parted. Leaves of more than `LARGEST` classes of a label are split on at the mean of a further
   projection over all of their classes, round by round, until none is left. A split that would hardly lessen
   the pairs, as among near copies that all lie within the spill, isn't made; such a leaf is compared
   exactly, all with one pivot first, then what that leaves with all.
3. Within each leaf and label all cosines are computed in double precision; the links found leave as stars,
   one per local component, and are united across trees.
4. Links are then counted within the components by blocks, so that a link between members counts even if
   every tree had parted it. Pairs themselves are never written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from ._graph import EDGES, components, local_roots
from .minhash import _blocks, _groups, _rest, _sides, _sized, _stars

TREES, LEAF, LARGEST, BLOCK = 8, 200, 3000, 1500
SAMPLE = 20_000
WORTH = 0.9  # a split is made if it leaves at most this share of the pairs
SPILL = 0.8  # of the spread that the projection of a pair at the threshold has


def direction(d: int, *seed: int) -> np.ndarray:
    x = np.random.Generator(np.random.PCG64([abs(s) for s in seed])).standard_normal(d)
    return x / np.linalg.norm(x)


def vectors(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plant(sample: np.ndarray, depth: int, trees: int, spill: float, seed: int = 11) -> list[dict[int, float]]:
    """Thresholds of each tree by heap number of the node (root 1); a node without sample rows, or whose split isn't worth it, is a leaf."""
    out = []
    for t in range(trees):
        cuts: dict[int, float] = {}
        todo = [(1, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if node.bit_length() > depth or len(rows) < 8:
                continue
            p = sample[rows] @ direction(sample.shape[1], seed, t, node)
            mid = float(np.median(p))
            if np.sum(p - mid <= spill) ** 2 + np.sum(p - mid > -spill) ** 2 > WORTH * len(p) ** 2:
                continue
            cuts[node] = mid
            todo += [(2 * node, rows[p <= cuts[node]]), (2 * node + 1, rows[p > cuts[node]])]
        out.append(cuts)
    return out


def _descend(forest: list[dict[int, float]], spill: float, seed: int = 11) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            dims = np.array([len(r) for r in raw])
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                x = unit(vectors([raw[i] for i in mine]))
                rows, trees, leaves = [], [], []
                for t, cuts in enumerate(forest):
                    todo = [(1, np.arange(len(mine)))]
                    while todo:
                        node, at = todo.pop()
                        if node not in cuts or not len(at):
                            rows.append(mine[at])
                            trees.append(np.full(len(at), t))
                            leaves.append(np.full(len(at), node))
                            continue
                        p = x[at] @ direction(x.shape[1], seed, t, node) - cuts[node]
                        todo += [(2 * node, at[p <= spill]), (2 * node + 1, at[p > -spill])]
                r = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(r), b.column(1).take(r), b.column(2).take(r), pa.array(np.full(len(r), d)), pa.array(np.concatenate(trees)), pa.array(np.concatenate(leaves))], names=["node", "label", "vec", "dim", "tree", "leaf"])

    return run


def _project(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for vec, tree, leaf in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("vec", "tree", "leaf"))):
                x = np.frombuffer(vec)
                x = x / np.abs(x).max()
                out.append(float(x @ direction(len(x), seed, tree, leaf & 0x7FFFFFFFFFFFFFFF) / np.linalg.norm(x)))
            yield b.append_column("p", pa.array(out, pa.float64()))

    return run


LEAFED = "node long, label string, vec binary, dim long, tree long, leaf long"


LEAF_KEYS = ["label", "dim", "tree", "leaf"]


def _split_on(leaves: DataFrame, spill: float, most_rounds: int = 40) -> tuple[DataFrame, DataFrame | None]:
    """Split leaves over LARGEST until none is left; leaves whose split isn't worth it, or still large at the end, come apart from the others."""
    done, stuck, keys = [], [], LEAF_KEYS
    for k in range(most_rounds):
        large = cut(leaves.groupBy(*keys).count().where(F.col("count") > LARGEST))
        if large.isEmpty():
            done.append(leaves)
            break
        done.append(leaves.join(large, keys, "left_anti").select(leaves.columns))
        p = cut(leaves.join(large, keys, "left_semi").select(leaves.columns).mapInArrow(_project(1000 + k), LEAFED + ", p double"))
        mid = p.groupBy(*keys).agg(F.avg("p").alias("mid"))
        p = p.join(mid, keys).withColumn("side", F.expr(f"filter(array(0, 1), s -> (s = 0 and p - mid <= {spill!r}) or (s = 1 and p - mid > -{spill!r}))"))
        child = p.groupBy(*keys).agg(*[F.count_if(F.array_contains("side", i)).cast("double").alias(f"n{i}") for i in (0, 1)])
        hard = cut(child.join(large, keys).where(F.col("n0") * F.col("n0") + F.col("n1") * F.col("n1") > WORTH * F.col("count") * F.col("count")).select(*keys))
        if not hard.isEmpty():
            stuck.append(cut(p.join(hard, keys, "left_semi").select(leaves.columns)))
            p = p.join(hard, keys, "left_anti")
        leaves = cut(p.withColumn("side", F.explode("side")).withColumn("leaf", F.xxhash64("leaf", "side")).select(leaves.columns))
    else:
        stuck.append(leaves)
    return reduce(DataFrame.union, done), reduce(DataFrame.union, stuck) if stuck else None


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
    return (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]


def _leaf_links(cosine: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 4):
            if len(rows) < 2:
                continue
            ids, x = np.array([r[0] for r in rows], np.int64), vectors([r[1] for r in rows])
            a, b = [], []
            for i in range(0, len(ids), BLOCK):
                for j in range(0, i + 1, BLOCK):
                    p, q = np.nonzero(_cosines(x[i : i + BLOCK], x[j : j + BLOCK]) >= cosine)
                    a.append(ids[i + p])
                    b.append(ids[j + q])
            nodes, roots = local_roots(np.concatenate(a), np.concatenate(b))
            star = nodes != roots
            if star.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[star]), pa.array(roots[star])], names=["a", "b"])

    return run


STAR = "label string, dim long, tree long, leaf long, a long, b long"


def _block_links(cosine: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*leaf, p, q), rows in _groups(batches, 6):
            ids, side, x = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]), vectors([r[2] for r in rows])
            left, right = _sides(side, p, q)
            a, b = [ids[:0]], [ids[:0]]
            for i in range(0, len(left), BLOCK):
                for j in range(0, len(right), BLOCK):
                    at, to = left[i : i + BLOCK], right[j : j + BLOCK]
                    m, n = np.nonzero(_cosines(x[at], x[to]) >= cosine)
                    u, r = local_roots(ids[at[m]], ids[to[n]])
                    a.append(u)
                    b.append(r)
            nodes, roots = local_roots(np.concatenate(a), np.concatenate(b))
            star = nodes != roots
            if k := int(star.sum()):
                yield pa.RecordBatch.from_arrays([*(pa.array([v] * k) for v in leaf), pa.array(nodes[star]), pa.array(roots[star])], names=[*LEAF_KEYS, "a", "b"])

    return run


def _exact(leaves: DataFrame, cosine: float) -> DataFrame:
    """Stars of the components of whole leaves of any size: who links with the pivot needs no other link, the rest meet all."""
    keys, on = LEAF_KEYS, [*LEAF_KEYS, "p", "q"]

    def links(df: DataFrame) -> DataFrame:
        return df.select(*on, "node", "side", "vec").repartition(*on).sortWithinPartitions(*on).mapInArrow(_block_links(cosine), STAR)

    sized = cut(_sized(leaves, keys))
    first = cut(links(_stars(sized, keys, BLOCK)))
    # the pivot is the least node of a leaf, and so the root of each of its chunks' links
    return first.union(links(_rest(sized, keys, first.select(*keys, F.col("a").alias("node")), BLOCK))).select("a", "b")


def _count_links(cosine: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, p, q), rows in _groups(batches, 3):
            ids, side, n = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
            x, links = vectors([r[3] for r in rows]), np.zeros(len(rows), np.int64)
            left, right = _sides(side, p, q)
            for i in range(0, len(left), BLOCK):
                for j in range(0, len(right), BLOCK):
                    at, to = left[i : i + BLOCK], right[j : j + BLOCK]
                    hit = (_cosines(x[at], x[to]) >= cosine) & (ids[at][:, None] != ids[to][None, :])
                    links[at] += hit @ n[to]
                    if p != q:
                        links[to] += hit.T @ n[at]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], names=["node", "links"])

    return run


def near_vectors(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Only rows with equal, non-null labels and equally long vectors are compared. Equal vectors are linked, as are
    repeated rows; component_id is the least vec_id reachable (nulls aside) and kept marks rows that carry it.
    Invalid vectors have no links and are their own component. An empty table gives no rows; other columns of any
    name are ignored.
    """
    spark = df.sparkSession
    ship(spark)
    v = F.col("vec0")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec0"), F.col(label_col).cast("string").alias("label"))
    good = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.expr("forall(vec0, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vec0, x -> x <> 0)")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("node", F.when(F.col("good"), F.xxhash64("label", v)))
    classes = rows.where("good").groupBy("node").agg(F.first("label").alias("label"), F.first("vec0").alias("vec0"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = cut(classes.mapInArrow(_pack, "node long, label string, vec binary, least long, n long"))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, int(np.ceil(np.log2(max(most, 1) / LEAF))))
    sample = classes.orderBy(F.hash("node"), "node").limit(SAMPLE).select("vec").collect() if depth else []
    by_dim: dict[int, list[bytes]] = {}
    for r in sample:
        by_dim.setdefault(len(r.vec), []).append(bytes(r.vec))
    common = max(by_dim.values(), key=len) if by_dim else []
    d = len(common[0]) // 8 if common else 1
    # vectors of other lengths than the commonest meet in the leaves that the later splits make
    spill = SPILL * float(np.sqrt(2 - 2 * cosine)) / float(np.sqrt(d))
    forest = plant(unit(vectors(common)), depth, TREES, spill) if common else [{}] * TREES
    plain = classes.select("node", "label", "vec")
    fits = plain.where(F.length("vec") == 8 * d).mapInArrow(_descend(forest, spill), LEAFED)
    other = plain.where(F.length("vec") != 8 * d).mapInArrow(_descend([{}] * TREES, spill), LEAFED)
    leaves, stuck = _split_on(cut(fits.union(other)), spill)
    keys = LEAF_KEYS
    links = leaves.select(*keys, "node", "vec").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_leaf_links(cosine), EDGES)
    if stuck is not None:
        links = links.union(_exact(stuck, cosine))
    roots = cut(components(links))
    members = roots.select(F.col("root").alias("cluster"), "node").join(classes.select("node", F.col("n").alias("copies"), "vec"), "node")
    keys = ["cluster", "p", "q"]
    members = _blocks(members, ["cluster"], "node", BLOCK).select(*keys, "node", "side", "copies", "vec")
    counts = members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_count_links(cosine), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "least", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(counts, "node", "left")
    named = named.select("node", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.where("good").select("vec_id", "node").join(named, "node").select("vec_id", "n_links", "component_id")
    none = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles."""
    for b in batches:
        raw = [np.array(v, np.float64).tobytes() for v in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary()), b.column(3), b.column(4)], names=["node", "label", "vec", "least", "n"])
