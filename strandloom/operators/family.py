"""Gene families: pair relations, graphs, components and reciprocal best hits.

Relations are edge tables (row_idx, col_idx, value) over a dense gene index; no matrix is built.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.gff import number
from .graph import components

RELATIONS = ("dN", "dS", "id_subject_query", "id_query_subject")


def match_relations(columns: list[str]) -> dict[str, str]:
    """Relation name to the column that carries it, by name without case; the first two columns are ids."""
    names = {r.lower(): r for r in RELATIONS}
    out: dict[str, str] = {}
    for c in columns[2:]:
        if (r := names.get(c.lower())) and r not in out:
            out[r] = c
    return out


@dataclass
class Family:
    genes: DataFrame  # gene_idx, id, scaffold, start_pos, end_pos
    topology: DataFrame  # row_idx, col_idx, both ways
    relations: dict[str, DataFrame] = field(default_factory=dict)  # row_idx, col_idx, value
    edges: DataFrame | None = None  # lo, hi, and the relations' greatest values with lo as query (f_) and as subject (b_); what the others come from


def family(features: DataFrame, pairs: DataFrame) -> Family:
    """The family of the pairs' genes. Rows with NaN or null in a matched value column go first; then genes are numbered by
    (scaffold, start, end, id), and rows with an unknown id go, a known partner staying numbered."""
    if len(pairs.columns) < 2:
        raise ValueError("pairs need two id columns")
    kinds, rel = dict(pairs.dtypes), match_relations(pairs.columns)
    q, s = pairs.columns[:2]
    if kinds[q] != "string" or kinds[s] != "string":
        raise ValueError("ids must be strings")
    if bad := [c for c in rel.values() if kinds[c] not in ("double", "float", "int", "bigint")]:
        raise ValueError(f"not numbers: {bad}")
    x = pairs.select(F.col(q).alias("query"), F.col(s).alias("subject"), *[F.col(c).cast("double").alias(r) for r, c in rel.items()])
    for r in rel:
        x = x.where(F.col(r).isNotNull() & ~F.isnan(r))
    ids = x.select(F.col("query").alias("id")).union(x.select("subject")).distinct()
    first = features.groupBy("id").agg(F.min(F.struct("scaffold", "start_pos", "end_pos")).alias("f")).join(ids, "id", "left_semi")
    genes = number(first.select("id", "f.*"), "scaffold", "start_pos", "end_pos", "id").withColumnRenamed("feature_idx", "gene_idx")
    at = genes.select("id", "gene_idx")
    x = x.join(at.select(F.col("id").alias("query"), F.col("gene_idx").alias("q")), "query").join(at.select(F.col("id").alias("subject"), F.col("gene_idx").alias("s")), "subject")
    # one row for each two genes; a self pair is forward
    forth = F.col("q") <= F.col("s")
    e = x.groupBy(F.least("q", "s").alias("lo"), F.greatest("q", "s").alias("hi")).agg(F.lit(True).alias("on"), *[F.max(F.when(way, F.col(r))).alias(f"{p}_{r}") for r in rel for p, way in (("f", forth), ("b", ~forth))]).drop("on")
    both = F.array(F.struct(F.col("lo").alias("row_idx"), F.col("hi").alias("col_idx")), F.struct(F.col("hi").alias("row_idx"), F.col("lo").alias("col_idx")))
    out = Family(genes, e.select(F.inline(F.array_distinct(both))), edges=e)
    for r in rel:
        out.relations[r] = e.select(F.inline(_of_edge(r))).where("value is not null")
    return out


def _of_edge(r: str) -> Column:
    """The cells (row_idx, col_idx, value) of a relation that an edge fills, null values among them."""
    cell = lambda a, b, v: F.struct(F.col(a).alias("row_idx"), F.col(b).alias("col_idx"), v.alias("value"))
    f, b = F.col(f"f_{r}"), F.col(f"b_{r}")
    if r in RELATIONS[:2]:
        return F.array(cell("lo", "hi", F.greatest(f, b)))
    return F.array(cell("lo", "hi", f), cell("hi", "lo", b)) if r == RELATIONS[2] else F.array(cell("hi", "lo", f), cell("lo", "hi", b))


def column(f: Family, gene_idx: int) -> DataFrame:
    """Column gene_idx of every relation, dense: (relation, gene_idx, value)."""
    if f.edges is not None and f.relations:
        # the gene's edges are asked for once, and all relations go to the genes as columns of one row
        mine = f.edges.where((F.col("lo") == gene_idx) | (F.col("hi") == gene_idx))
        tagged = lambda n: F.transform(_of_edge(n), lambda c: F.struct(F.lit(n).alias("relation"), c["row_idx"].alias("gene_idx"), c["col_idx"].alias("col_idx"), c["value"].alias("value")))
        cells = F.concat(*[tagged(n) for n in f.relations])
        wide = mine.select(F.inline(cells)).where(F.col("col_idx") == gene_idx).groupBy("gene_idx").agg(*[F.max(F.when(F.col("relation") == n, F.col("value"))).alias(n) for n in f.relations])
        x = f.genes.select("gene_idx").join(wide, "gene_idx", "left")
        return x.select(F.inline(F.array(*[F.struct(F.lit(n).alias("relation"), F.col("gene_idx").alias("gene_idx"), F.coalesce(n, F.lit(0.0)).alias("value")) for n in f.relations])))
    parts = [f.genes.select("gene_idx").join(r.where(F.col("col_idx") == gene_idx).select(F.col("row_idx").alias("gene_idx"), "value"), "gene_idx", "left").select(F.lit(n).alias("relation"), "gene_idx", F.coalesce("value", F.lit(0.0)).alias("value")) for n, r in f.relations.items()]
    return reduce(DataFrame.union, parts)


def subfamily(f: Family, ids: list[str]) -> Family:
    """The induced family of some genes, renumbered in order; unknown or no ids are an error."""
    kept = f.genes.where(F.col("id").isin(ids))
    if not ids or kept.count() < len(set(ids)):
        raise ValueError("unknown ids, or none")
    genes = number(kept.withColumnRenamed("gene_idx", "old"), "old").withColumnRenamed("feature_idx", "gene_idx")
    new = genes.select("old", "gene_idx")

    def inner(e: DataFrame) -> DataFrame:
        e = e.join(new.select(F.col("old").alias("row_idx"), F.col("gene_idx").alias("r")), "row_idx").join(new.select(F.col("old").alias("col_idx"), F.col("gene_idx").alias("c")), "col_idx")
        return e.select(F.col("r").alias("row_idx"), F.col("c").alias("col_idx"), *[c for c in ("value",) if c in e.columns])

    return Family(genes.drop("old"), inner(f.topology), {n: inner(r) for n, r in f.relations.items()})


def topology_graph(f: Family) -> DataFrame:
    """Undirected edges (a < b); self pairs are no edges."""
    return f.topology.where("row_idx < col_idx").select(F.col("row_idx").alias("a"), F.col("col_idx").alias("b"))


def weighted_graph(f: Family, relation: str) -> DataFrame | None:
    """Edges (a, b, weight): undirected for dN and dS (a < b), directed for identities; zero cells are no edges."""
    if relation not in f.relations:
        return None
    e = f.relations[relation].where("row_idx <> col_idx and value <> 0")
    return e.select(F.col("row_idx").alias("a"), F.col("col_idx").alias("b"), F.col("value").alias("weight"))


def gene_components(f: Family) -> DataFrame:
    """(gene_idx, component) for all genes; a component is named by its least gene."""
    c = components(topology_graph(f))
    return f.genes.select("gene_idx").join(c.select(F.col("node").alias("gene_idx"), "root"), "gene_idx", "left").select("gene_idx", F.coalesce("root", "gene_idx").alias("component"))


def _cell(e: DataFrame, f: Family, relation: str, row: str, col: str, name: str) -> DataFrame:
    """e with the relation's value at (row, col), 0 where absent."""
    r = f.relations[relation].select(F.col("row_idx").alias(row), F.col("col_idx").alias(col), F.col("value").alias(name))
    return e.join(r, [row, col], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def scored_edges(f: Family, scoring: str = "mean") -> DataFrame:
    """Edges (lo, hi, q, s, identity and the relations' values), q and s as the identities' storage says."""
    scoring = {"avg": "mean", "average": "mean", "minimum": "min", "maximum": "max"}.get(scoring.lower(), scoring.lower())
    if scoring not in ("mean", "min", "max"):
        raise ValueError("scoring must be mean, min or max")
    has_sq, has_qs = (r in f.relations for r in RELATIONS[2:])
    if f.edges is not None:
        way = F.coalesce("f_" + (RELATIONS[2] if has_sq else RELATIONS[3]), F.lit(0.0)) != 0 if has_sq or has_qs else F.lit(True)
        at = [F.greatest(f"f_{r}", f"b_{r}") if r in RELATIONS[:2] else F.when(way, F.col(f"f_{r}")).otherwise(F.col(f"b_{r}")) for r in RELATIONS if r in f.relations]
        e = f.edges.where("lo < hi").select("lo", "hi", F.when(way, F.col("lo")).otherwise(F.col("hi")).alias("q"), F.when(way, F.col("hi")).otherwise(F.col("lo")).alias("s"), *[F.coalesce(v, F.lit(0.0)).alias(r) for v, r in zip(at, [r for r in RELATIONS if r in f.relations])])
        return _identity(e, f, scoring)
    e = topology_graph(f).select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    if has_sq:
        e = _cell(e, f, "id_subject_query", "lo", "hi", "__way")
    elif has_qs:
        e = _cell(e, f, "id_query_subject", "hi", "lo", "__way")
    else:
        e = e.withColumn("__way", F.lit(1.0))
    way = F.col("__way") != 0
    e = e.withColumns({"q": F.when(way, F.col("lo")).otherwise(F.col("hi")), "s": F.when(way, F.col("hi")).otherwise(F.col("lo"))}).drop("__way")
    for r in RELATIONS[:2]:
        if r in f.relations:
            e = _cell(e, f, r, "lo", "hi", r)
    if has_sq:
        e = _cell(e, f, "id_subject_query", "q", "s", "id_subject_query")
    if has_qs:
        e = _cell(e, f, "id_query_subject", "s", "q", "id_query_subject")
    return _identity(e, f, scoring)


def _identity(e: DataFrame, f: Family, scoring: str) -> DataFrame:
    vals = [F.col(r) for r in RELATIONS[2:] if r in f.relations]
    if vals:
        two = len(vals) == 2
        e = e.withColumn("identity", vals[0] if not two else {"mean": (vals[0] + vals[1]) / 2, "min": F.least(*vals), "max": F.greatest(*vals)}[scoring])
    return e


def best_hits(f: Family, scoring: str = "mean") -> DataFrame:
    """The best edge of each component: least dS, then dN, then greatest identity, then least genes.

    (query, subject, the relations, tied): tied says that another edge ranks equally.
    """
    if not f.relations:
        raise ValueError("no relation to rank edges by")
    if f.edges is not None:
        f = replace(f, edges=cut(f.edges))  # asked for edges and components
        f.topology = f.edges.select(F.col("lo").alias("row_idx"), F.col("hi").alias("col_idx"))  # lo < hi is all that a graph takes
    e = scored_edges(f, scoring)
    c = gene_components(f).select(F.col("gene_idx").alias("lo"), "component")
    order: list[Column] = [F.col(r) for r in ("dS", "dN") if r in f.relations] + ([-F.col("identity")] if "identity" in e.columns else [])
    # edges of one rank are counted on the way, so that both steps combine before they shuffle
    ranked = e.join(c, "lo").groupBy("component", F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)]).alias("o")).agg(F.count("*").alias("n"), F.min(F.struct("lo", "hi", *[x for x in e.columns if x not in ("lo", "hi")])).alias("e"))
    e = ranked.groupBy("component").agg(F.min_by(F.struct("n", "e"), "o").alias("b")).select("b.e.*", (F.col("b.n") > 1).alias("tied"))
    name = lambda c, out: f.genes.select(F.col("gene_idx").alias(c), F.col("id").alias(out))
    return e.join(name("q", "query"), "q").join(name("s", "subject"), "s").select("query", "subject", *[r for r in RELATIONS if r in f.relations], "tied")


def _cells(pairs: DataFrame, row_idx: str, half: bool = False) -> tuple[DataFrame, DataFrame]:
    """Gene indices by first appearance (all of column 1, then all of column 2), and the last written value of each cell; `half`: of those with i < j."""
    a, b, p1, p2 = (c for c in pairs.columns if c != row_idx)
    pairs = pairs.select(F.col(row_idx).alias("r"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(p1).alias("p1"), F.col(p2).alias("p2"))
    seen = pairs.select(F.lit(0).alias("c"), "r", F.col("a").alias("id")).union(pairs.select(F.lit(1), "r", "b"))
    first = seen.groupBy("id").agg(F.min(F.struct("c", "r")).alias("f"))
    genes = number(first.select("id", "f.c", "f.r"), "c", "r").select("id", F.col("feature_idx").alias("i"))
    x = pairs.join(genes.select(F.col("id").alias("a"), F.col("i").alias("x")), "a").join(genes.select(F.col("id").alias("b"), F.col("i").alias("y")), "b")
    if half:
        on = F.col("x") < F.col("y")
        x = x.where("x <> y").groupBy(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
        return genes, x.agg(F.max_by(F.struct(F.when(on, F.col("p1")).otherwise(F.col("p2")).alias("own"), F.when(on, F.col("p2")).otherwise(F.col("p1")).alias("other")), "r").alias("v")).select("i", "j", "v.own", "v.other")
    # within a row the second cell is written after the first
    cell = lambda i, j, k, own, other: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), "r", F.lit(k).alias("k"), F.col(own).alias("own"), F.col(other).alias("other"))
    cells = x.select(F.explode(F.array(cell("x", "y", 0, "p1", "p2"), cell("y", "x", 1, "p2", "p1"))).alias("v")).select("v.*")
    last = cells.groupBy("i", "j").agg(F.max_by(F.struct("own", "other"), F.struct("r", "k")).alias("v")).select("i", "j", "v.own", "v.other")
    return genes, last


def _mutual(cells: DataFrame, score: Column, lowest: bool = False) -> DataFrame:
    """Candidates (i, j): j is the best of row i, and i the best of column j; the first index wins ties."""
    c = cells.withColumn("score", score)
    c = (c if lowest else c.where("score > 0")).select("i", "j", (F.col("score") if lowest else -F.col("score")).alias("s"))
    row = c.groupBy("i").agg(F.min(F.struct("s", "j")).alias("b")).select("i", "b.j")
    col = c.groupBy("j").agg(F.min(F.struct("s", "i")).alias("b")).select("b.i", "j")
    return row.join(col, ["i", "j"])


def _greedy(found: DataFrame) -> DataFrame:
    """The candidates that remain if they are taken in order of i, and each gene once.

    A candidate (i, j) meets the one that ends in i and the one that begins with j, no others. Where both of these come
    later it is taken; where one comes earlier it is taken if that one isn't; where both do, if neither is. So a candidate
    with one earlier neighbour depends on how far a line of such neighbours goes, which pointers that double tell.
    """
    near = found.select("i", "j").join(found.select(F.col("j").alias("i"), F.col("i").alias("p")), "i", "left").join(found.select(F.col("i").alias("j"), F.lit(True).alias("on")), "j", "left")
    near = near.select(F.col("i").alias("id"), F.col("j").alias("n"), F.array_distinct(F.filter(F.array("p", F.when(F.col("on"), F.col("j"))), lambda k: k < F.col("i"))).alias("early"))
    e = cut(near.select("id", "n", "early", F.when(F.size("early") == 1, F.col("early")[0]).otherwise(F.col("id")).alias("to"), F.when(F.size("early") == 1, 1).otherwise(0).cast("long").alias("d")))
    while True:
        far = e.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        step = e.join(far, "to").select("id", "n", "early", F.col("to2").alias("to"), (F.col("d") + F.col("d2")).alias("d"), (F.col("to") != F.col("to2")).alias("moved"))
        e = cut(step)
        if e.where("moved").isEmpty():
            break
    taken = e.where("size(early) < 2 and d % 2 = 0").select("id", "n")
    last = e.where("size(early) = 2").select("id", "n", F.explode("early").alias("k"))
    held = last.join(taken.select(F.col("id").alias("k")), "k", "left_semi").select("id").distinct()
    last = last.select("id", "n").distinct().join(held, "id", "left_anti")
    return taken.union(last).select(F.col("id").alias("i"), F.col("n").alias("j"))


def _alike(pairs: DataFrame, row_idx: str, s: str) -> DataFrame:
    """pair_best_hits by a score that both directions share: the best of a row is the best of that column.

    Each row writes both cells of its two genes, so the last row of an unordered pair tells both; of candidates a gene keeps one.
    """
    genes, last = _cells(pairs, row_idx, True)
    score = {"max": F.greatest("own", "other"), "mean": (F.col("own") + F.col("other")) / 2, "ds": F.col("own")}[s]
    c = last.where("i < j").withColumn("score", score)
    c = c.select("i", "j", F.col("score").alias("s"), "own", "other") if s == "ds" else c.where("score > 0").select("i", "j", (-F.col("score")).alias("s"), "own", "other")
    side = lambda a, b, own, other: F.struct(F.col(a).alias("i"), F.struct("s", F.col(b).alias("j"), F.col(own).alias("own"), F.col(other).alias("other")).alias("b"))
    best = cut(c.select(F.inline(F.array(side("i", "j", "own", "other"), side("j", "i", "other", "own")))).groupBy("i").agg(F.min("b").alias("b")).select("i", "b.j", "b.own", F.col("b.other").alias("back")))
    x = best.where("i < j").join(best.where("j < i").select(F.col("i").alias("j"), F.col("j").alias("i")), ["i", "j"])
    name = lambda c, out: genes.select(F.col("i").alias(c), F.col("id").alias(out))
    x = x.join(name("j", "GeneID"), "j").join(name("i", "ParalogID"), "i")
    return x.select("GeneID", "ParalogID", F.col("own").alias("ds"), F.least("own", "back").alias("min_ds")) if s == "ds" else _percents(x)


def pair_best_hits(pairs: DataFrame, row_idx: str, scoring: str = "max") -> DataFrame:
    """Reciprocal best hits of (gene, paralog, value1, value2) by position; row_idx gives the rows' order.

    'max' and 'mean' score both directions alike, 'double_max' each by its own value; 'ds' takes the lowest value1
    over observed pairs. GeneID is the best hit, ParalogID the gene that probed for it.
    """
    s = {"maximum": "max", "avg": "mean", "average": "mean"}.get(scoring.lower(), scoring.lower())
    if s not in ("max", "mean", "double_max", "ds"):
        raise ValueError("scoring must be max, mean, double_max or ds")
    if s == "ds":
        a, b, v = [c for c in pairs.columns if c != row_idx][:3]
        pairs = pairs.select(row_idx, a, b, v, F.col(v).alias("__v"))
    if s != "double_max":
        return _alike(pairs, row_idx, s)
    genes, cells = _cells(pairs, row_idx)
    cells = cut(cells)  # asked four times
    found = _greedy(cut(_mutual(cells.where("i <> j"), F.col("own"))))
    name = lambda c, out: genes.select(F.col("i").alias(c), F.col("id").alias(out))
    back = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("own").alias("back"))
    x = found.join(cells.select("i", "j", "own"), ["i", "j"]).join(back, ["i", "j"], "left").withColumn("back", F.coalesce("back", F.lit(0.0)))
    x = x.join(name("j", "GeneID"), "j").join(name("i", "ParalogID"), "i")
    return _percents(x)


def _percents(x: DataFrame) -> DataFrame:
    return x.select("GeneID", "ParalogID", F.col("own").alias("perc_1"), F.col("back").alias("perc_2"), F.greatest("own", "back").alias("max_perc"), ((F.col("own") + F.col("back")) / 2).alias("mean_perc"))

