"""MinHash near-duplicates by a signature-coordinate inverted join.

1. One pass over the texts gives each document its distinct shingles' number, a 128-bit digest
   of that set and a signature of `COORDS` minima. Documents with one set form a class.
2. Each class is posted under the coordinate-value pairs of its signature's first `PREFIX` coordinates
   only: a pair of similarity s has no such list in common with probability (1 - s) ^ PREFIX. Lists with
   one entry vanish in the count. In a list, collisions are counted over whole signatures, of 16 bits a
   coordinate; `MATCH` of `COORDS` are a candidate. A list yields a spanning forest of its matching pairs, never
   all of them.
3. Components of these candidates are the groups within which links are confirmed on full shingle
   sets, recomputed from the texts of group members alone. A pair is compared until its two sides
   are known to be connected.

Lists over `BLOCK` entries and groups over `GROUP` members are first compared with one pivot each, the
least member, in chunks: near copies of one text join it, and need no comparison among each other to be
connected. A hot group of n near copies so costs about n comparisons. Of a list, see _candidates for what the
pivot doesn't take; of a group, that meets all members, in pairs of blocks. A task never holds more than two blocks.

A pair of Jaccard similarity 0.85 agrees on fewer than MATCH coordinates with probability 3e-6 and shares no
list with probability 9e-10, less for greater similarity; none under the threshold is ever linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from . import _text as T
from ._graph import EDGES, components

COORDS, MATCH, PREFIX = 64, 40, 11
BLOCK, GROUP = 2000, 400
DEEPER, LEVELS = 8, 5  # further pairs of coordinates that a large list of unlike members is posted under; how often
SLICE = 500_000  # shingles that are compared at once
_r = np.random.Generator(np.random.PCG64(77))
MUL = _r.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray, k: int, one: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    h, first = T.words(data, off, lower=True)
    n = np.diff(first)
    at = T.whole(first, k)
    s = T.mix(T.roll(h, k)[at] + np.uint64(k)) if len(at) else np.zeros(0, np.uint64)
    doc = T.owner(first)[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        total = np.array([T.mix(T.roll(h[first[d] : first[d + 1]], int(n[d])) + np.uint64(n[d]))[0] for d in short], np.uint64)
        s, doc = np.concatenate([s, total]), np.concatenate([doc, short])
    bits = np.uint64(max(len(off) - 2, 0).bit_length())
    if bits:  # the number of the text sorts first; a text alone in its slice keeps all 64 bits
        s = (s >> bits) | (doc.astype(np.uint64) << (np.uint64(64) - bits))
    s = np.sort(s)
    if len(s):
        s = s[np.concatenate([[True], s[1:] != s[:-1]])]
    if bits:
        doc = (s >> (np.uint64(64) - bits)).astype(np.int64)
        s = s << bits
    else:
        doc = np.zeros(len(s), np.int64)
    return s & ~np.uint64(0xFFF), np.searchsorted(doc, np.arange(len(off)))


def signatures(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = T.column(b, "text")
            for i, j in T.slices(off):
                s, first = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = np.diff(first)
                some = n > 0
                at = first[:-1][some]
                h1, h2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                sig = np.zeros((j - i, COORDS), np.uint32)
                if len(at):
                    m = T.mix(s)
                    h1[some] = np.add.reduceat(m, at)
                    h2[some] = np.add.reduceat(m * m, at)
                    for c in range(COORDS):
                        x = m * MUL[c]
                        x ^= x >> np.uint64(31)
                        sig[some, c] = np.minimum.reduceat((x * T.BASE) >> np.uint64(32), at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([r.tobytes() for r in sig[:, :PREFIX]], pa.binary()), pa.array([r.tobytes() for r in sig.astype(np.uint16)], pa.binary())],
                    names=["doc_id", "fp", "n_shingles", "h1", "h2", "post", "sig"],
                )

    return run


def _forest(ids: np.ndarray, ok: Callable[[int, np.ndarray], np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges between left and right rows. ok(i, js): which of js link with i; it is asked only across components."""
    comp, out, same = np.arange(len(ids)), [], left is right
    for n, i in enumerate(left):
        js = right[:n] if same else right
        js = js[comp[js] != comp[i]]
        if not len(js):
            continue
        hits = js[ok(int(i), js)]
        for j in hits[np.unique(comp[hits], return_index=True)[1]]:
            out.append((int(ids[i]), int(ids[j])))
            comp[comp == comp[j]] = comp[i]
    return out


def _sides(side: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.arange(len(side))
    return (rows, rows) if p == q else (rows[side == p], rows[side == q])


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of rows with equal leading columns from batches that are sorted by them."""
    now, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists (list, p, q, node, side, sig) to spanning edges of the pairs with MATCH collisions."""
    out: list[tuple[int, int]] = []
    for (_, p, q), rows in _groups(batches, 3):
        if len(rows) == 2 and p == q:  # most lists
            x, y = (np.frombuffer(r[2], np.uint16) for r in rows)
            if (x == y).sum() >= MATCH:
                out.append((rows[0][0], rows[1][0]))
        elif len(rows) > 1:
            ids = np.array([r[0] for r in rows], np.int64)
            sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(-1, COORDS)
            side = np.array([r[1] for r in rows])

            def ok(i: int, js: np.ndarray, sig: np.ndarray = sig) -> np.ndarray:
                return (sig[js] == sig[i]).sum(1) >= MATCH

            out += _forest(ids, ok, *_sides(side, p, q))
        if len(out) > 20000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _blocks(df: DataFrame, keys: list[str], node: str, most: int) -> DataFrame:
    """df with the pairs of blocks (p, q) in which each row takes part and its own block, `side`; small groups have one, (0, 0).

    The block count comes from the group's exact size; a row of a group of n blocks is sent n times, so
    that every pair of a hot group meets in some task and no task sees more than two blocks.
    """
    x = _sized(df, keys).withColumn("n", F.ceil(F.col("size") / most).cast("int"))
    x = x.withColumn("side", F.when(F.col("n") > 1, F.pmod(F.xxhash64(node), F.col("n"))).otherwise(0).cast("int"))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return x.withColumns({"p": F.least("side", "o"), "q": F.greatest("side", "o")}).drop("o", "n", "size")


def _sized(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups of two or more, with the group's size."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1"), keys)


def _parts(df: DataFrame, most: int) -> Column:
    return F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / most)).cast("int")


def _stars(sized: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Small groups whole as (0, 0); large ones in chunks (p, -1), each with the group's least node on side -1."""
    small = sized.where(F.col("size") <= most).withColumns({"p": F.lit(0), "q": F.lit(0), "side": F.lit(0)})
    large = sized.where(F.col("size") > most)
    pivot = large.groupBy(*keys).agg(F.min("node").alias("pivot"))
    large = large.join(pivot, keys)
    chunks = large.where("node <> pivot").withColumns({"p": _parts(large, most), "q": F.lit(-1)}).withColumn("side", F.col("p"))
    heads = large.where("node = pivot").withColumn("p", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / most).cast("int") - 1))).withColumns({"q": F.lit(-1), "side": F.lit(-1)})
    return small.unionByName(chunks.drop("pivot")).unionByName(heads.drop("pivot")).drop("size")


def _rest(sized: DataFrame, keys: list[str], linked: DataFrame, most: int) -> DataFrame:
    """Rows of large groups that `linked` (keys, node) doesn't name, in blocks p, against all rows of their group in blocks q < 0."""
    large = sized.where(F.col("size") > most)
    left = large.join(linked, [*keys, "node"], "left_anti").select(large.columns)
    counts = left.groupBy(*keys).agg(F.count("*").alias("left"))
    n, m = F.ceil(F.col("left") / most).cast("int"), F.ceil(F.col("size") / most).cast("int")
    mine = left.join(counts, keys).withColumn("p", F.pmod(F.xxhash64("node"), n).cast("int")).withColumn("side", F.col("p")).withColumn("q", F.explode(F.sequence(-m, F.lit(-1))))
    all_ = large.join(counts, keys).withColumn("q", (-1 - _parts(large, most)).cast("int")).withColumn("side", F.col("q")).withColumn("p", F.explode(F.sequence(F.lit(0), n - 1)))
    return mine.unionByName(all_).drop("left", "size")


def _digest(s: np.ndarray) -> tuple[int, int]:
    m = T.mix(s)
    return int(m.sum().view(np.int64)), int((m * m).sum().view(np.int64))


def _confirm(k: int, percent: int) -> Callable:
    """Texts of clusters (cluster, p, q, node, side, h1, h2, text) to spanning edges of the links among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for (_, p, q), rows in _groups(batches, 3):
            sets, own = [], []
            for node, side, h1, h2, text in rows:
                raw = np.frombuffer(text.encode(), np.uint8)
                s, _ = shingles(raw, np.array([0, len(raw)]), k)
                if _digest(s) == (h1, h2):  # another text may have the same doc_id
                    sets.append(s)
                    own.append((node, side))
            if len(own) < 2:
                continue
            ids, side = (np.array(x, np.int64) for x in zip(*own))
            size = np.array([len(s) for s in sets])

            def ok(i: int, js: np.ndarray, sets: list = sets, size: np.ndarray = size) -> np.ndarray:
                hit = 100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])
                some = np.flatnonzero(hit)
                for at in np.split(some, np.flatnonzero(np.diff(np.cumsum(size[js[some]]) // SLICE)) + 1):
                    if len(at):
                        many = np.concatenate([sets[j] for j in js[at]])
                        pos = np.minimum(np.searchsorted(sets[i], many), size[i] - 1)
                        both = np.add.reduceat((sets[i][pos] == many).astype(np.int64), np.concatenate([[0], np.cumsum(size[js[at]])[:-1]]))
                        hit[at] = 100 * both >= percent * (size[i] + size[js[at]] - both)
                return hit

            out += _forest(ids, ok, *_sides(side, p, q))
        yield _edges(out)

    return run


def _near() -> Column:
    """Coordinates on which sig and pivot_sig collide."""
    return sum((F.expr(f"cast(substring(sig, {2 * c + 1}, 2) = substring(pivot_sig, {2 * c + 1}, 2) as int)") for c in range(COORDS)), F.lit(0))


def _candidates(classes: DataFrame) -> DataFrame:
    """Edges of a forest over the classes' pairs with MATCH collisions that share a list.

    A list over BLOCK entries is compared with its pivot, the least node: what collides with it enough is connected
    through it. If at most BLOCK of the others are left, they meet all members, so the work is in proportion to the
    list. If more are left, the list is one that unlike documents share, as by a common line: its members are
    posted anew, under the list and two more coordinate-value pairs together, for each of the next DEEPER pairs of
    coordinates. A pair of similarity s shares one of these but for a chance of (1 - s^2) ^ DEEPER, and unlike ones part.
    Lists that are still large after LEVELS such rounds go in pairs of blocks, whatever is left.
    """
    post = F.array(*[F.expr(f"substring(post, {4 * c + 1}, 4)") for c in range(PREFIX)])
    posted = classes.select("node", F.posexplode(post).alias("at", "value")).select("node", "at", F.xxhash64("at", "value").alias("list"))
    sigs = classes.select("node", "sig")
    keys, found = ["list", "p", "q"], []

    def collide(x: DataFrame) -> DataFrame:
        return x.select(*keys, "node", "side", "sig").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(T.lean(_collide), EDGES)

    for level in range(LEVELS + 1):
        # signatures go to lists of two or more alone
        sized = cut(_sized(posted, ["list"]))
        small = sized.where(F.col("size") <= BLOCK).withColumns({"p": F.lit(0), "q": F.lit(0), "side": F.lit(0)}).drop("size").join(sigs, "node")
        large = sized.where(F.col("size") > BLOCK)
        if large.isEmpty():
            found.append(collide(small))
            break
        large = cut(large.join(sigs, "node").select("node", "at", "list", "size", "sig"))
        pivots = large.groupBy("list").agg(F.min(F.struct("node", F.col("sig").alias("pivot_sig"))).alias("pivot")).select("list", F.col("pivot.node").alias("pivot"), "pivot.pivot_sig")
        linked = cut(large.join(pivots, "list").where(_near() >= MATCH).select("list", "node", "pivot", "size"))
        found.append(linked.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        left = cut(linked.groupBy("list").agg((F.first("size") - F.count("*")).alias("left")).where("left > 0"))
        few = left if level == LEVELS else left.where(F.col("left") <= BLOCK)
        rest = _rest(large.join(few.select("list"), "list").select(large.columns), ["list"], linked.select("list", "node"), BLOCK)
        found.append(collide(small.unionByName(rest.select(small.columns))))
        many = left.where(F.col("left") > BLOCK)
        if level == LEVELS or many.isEmpty():
            break
        many = large.join(many.select("list"), "list").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(DEEPER))))
        value = lambda c: F.expr(f"substring(sig, 2 * (({c}) % {COORDS}) + 1, 2)")
        posted = many.select("node", ((F.col("at") + 2 * F.col("k")) % COORDS).cast("int").alias("at"), F.xxhash64("list", "k", value("at + 2 * k - 1"), value("at + 2 * k")).alias("list"))
    return reduce(DataFrame.union, found)


def grouped(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(doc_id, fp, n_shingles, component_id, root): root names the component, null for a text without shingles."""
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("fp", F.xxhash64("text"))
    sig = cut(docs.mapInArrow(T.lean(signatures(k)), "doc_id long, fp long, n_shingles long, h1 long, h2 long, post binary, sig binary"))
    some = sig.where("n_shingles > 0").withColumn("key", F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id0"), "fp"))
    classes = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("post").alias("post"), F.first("sig").alias("sig"))
    classes = cut(classes.select(F.xxhash64("h1", "h2").alias("node"), "h1", "h2", "least", "key.id0", "key.fp", "post", "sig"))
    candidates = components(_candidates(classes))
    members = cut(candidates.join(classes.drop("post", "sig"), "node").select(F.col("root").alias("cluster"), "node", "h1", "h2", "id0", "fp"))
    sized = cut(_sized(members.select("cluster", "node"), ["cluster"]))
    # one text of each clustered class, fetched once
    texts = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id0"), "fp", "text").join(members.drop("cluster"), ["id0", "fp"])
    texts = cut(texts.select("node", "h1", "h2", "text").dropDuplicates(["node"]))

    def confirm(x: DataFrame) -> DataFrame:
        keys = ["cluster", "p", "q"]
        x = x.join(texts, "node").select(*keys, "node", "side", "h1", "h2", "text")
        return x.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(T.lean(_confirm(k, percent)), EDGES)

    edges = cut(confirm(_stars(sized, ["cluster"], GROUP)))
    if not sized.where(F.col("size") > GROUP).isEmpty():
        # the pivot is a cluster's root: its least node
        linked = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sized.select("cluster", "node"), "node").union(sized.select(F.col("cluster").alias("node"), "cluster").distinct()).distinct()
        rest = cut(_rest(sized, ["cluster"], linked, GROUP))
        if not rest.isEmpty():
            edges = edges.union(cut(confirm(rest)))
    roots = components(edges)
    named = classes.select("h1", "h2", "node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("h1", "h2", "component_id", "root")
    full = sig.where("n_shingles > 0").join(named, ["h1", "h2"]).select("doc_id", "fp", "n_shingles", "component_id", "root")
    none = sig.where("n_shingles = 0").select("doc_id", "fp", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return full.union(none)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Null, empty and blank texts have no shingles and link with nothing; texts of fewer than k words are
    one shingle. Rows with equal sets are linked, so repeated rows share a component; component_id is the
    least doc_id in it (nulls aside) and kept marks rows that carry it. An empty table gives no rows. Other
    columns of any name are ignored.
    """
    found = grouped(df, id_col, text_col, k, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """One row of df, all columns, for each component: the one of the least id, then of the least hash of its text.

    Rows with one id and one text are one document, rows with one id and other texts are others. A row without an
    id gets one from its text, greater than all others, so such rows with equal texts are one document too, and
    stay only where their component has no document with an id. Null, empty and blank texts are components of
    their own. An empty table gives no rows; columns may have any names.
    """
    own, text = "__own", "__fp"
    while own in df.columns or text in df.columns:
        own, text = own + "_", text + "_"
    fp = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = df.withColumns({own: F.coalesce(F.col(id_col).cast("long"), F.lit(2**62) + F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(2**61))), text: fp})
    found = grouped(rows, own, text_col, k, percent)
    some = found.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select("k.*")
    kept = some.union(found.where("root is null").select("doc_id", "fp").distinct()).select(F.col("doc_id").alias(own), F.col("fp").alias(text))
    return rows.join(kept, [own, text], "left_semi").dropDuplicates([own, text]).drop(own, text)
