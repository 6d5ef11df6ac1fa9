"""Findings of the second round: each case failed before."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import ontology
from strandloom.operators import family, graph, intervals, signal
from strandloom.plans import registry
from strandloom.sources import table

SF = "/root/testdata/sf0.001"


def term(i: int) -> str:
    return f'{{"id":"x/SO_{i:07d}","lbl":"t{i}","meta":{{"definition":{{"val":"d"}}}}}}'


def test_ontology_of_many_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(f'{{"graphs":[{{"nodes":[{term(9)},{term(8)},{term(7)}]}}]}}')
    (tmp_path / "b.json").write_text(f'{{"graphs":[{{"nodes":[{term(1)}, {{"id":"x/other"}}, {term(2)}]}}]}}')
    dim = ontology.read_terms(spark, str(tmp_path))
    assert [tuple(r)[:3] for r in dim.orderBy("short_id").collect()] == [(1, 9, "t9"), (2, 8, "t8"), (3, 7, "t7"), (4, 1, "t1"), (5, 2, "t2")]
    asked = spark.createDataFrame([("t2",), ("t9",), ("no",)], "k string")
    plan = ontology.find(asked, dim, "k", "label", "short_id", "found")
    assert sorted(((r.k, r.found) for r in plan.collect()), key=str) == [("no", None), ("t2", 5), ("t9", 1)]


@pytest.mark.parametrize("merge", [True, False])
def test_depth_runs_cross_bins(spark, merge):
    x = spark.createDataFrame([(1, "c", 3, 30), (2, "c", 8, 20), (1, "c", 90, 91)], "measurement int, scaffold string, start_pos long, end_pos long")
    want = [(3, 7, 1), (8, 20, 2), (21, 30, 1), (31, 89, 0), (90, 91, 1)]
    for coarse in (4, 8, 1 << 20):
        got = intervals.depth(x, merge, coarse)
        assert sorted((r.start_pos, r.end_pos, r["count"]) for r in got.collect()) == want


def exchanged(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def moved_by(df, key: str) -> list[str]:
    return [line for line in exchanged(df).splitlines() if re.search(rf"hashpartitioning\({key}#", line)]


@pytest.mark.parametrize("name", ["feature_frequency_bed", "metagene_bed", "metagene_exclude", "feature_frequency_meth", "metagene_meth", "metagene_meth_sqrt", "metagene_meth_unweighted", "profile_bed", "profile_meth"])
def test_pairs_stay_where_they_meet(spark, name):
    """Nothing but sums by feature moves by feature."""
    df = registry.QUERIES[name](spark, SF)
    assert "SortMergeJoin [feature_idx" not in exchanged(df)
    assert len(moved_by(df, "feature_idx")) <= 1


def test_values_of_a_group_stay_spread(spark):
    df = registry.QUERIES["kde_bed"](spark, SF)
    assert not re.search(r"SortMergeJoin \[scaffold#\d+\]", exchanged(df))


def test_contracting_holds_a_bounded_number_of_edges(monkeypatch):
    monkeypatch.setattr(graph, "MOST", 1000)
    read = []

    def batches():
        for k in range(100):
            read.append(k)
            a = np.arange(k * 1000, k * 1000 + 1000, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(a + 1)], names=["a", "b"])

    out = graph._contract(batches())
    first = next(out)
    assert len(read) < 10
    assert len(first) + sum(len(b) for b in out) == 50000 and len(read) == 100


def test_family_resolves_pairs_once(spark):
    f = registry.the_family(spark, SF)
    for df in (family.column(f, 5), family.scored_edges(f)):
        assert len(re.findall(r"SortMergeJoin \[(query|subject)#|BroadcastHashJoin \[(query|subject)#", exchanged(df))) == 2


def test_best_hits_resolve_pairs_once(spark):
    assert not re.search(r"Join \[a#|Join \[b#|row_key", exchanged(registry.QUERIES["rbh_pairs_mean"](spark, SF)))


def test_samples_of_many_files(spark, tmp_path):
    for name, lines in {"m1.bed/a": "s1\t4\t9\n", "m1.bed/b": "s1\t0\t3\n", "t/a": "id,v\ng1,1\n", "t/b": "id,v\ng2,2\n", "x.csv": "id,v\ng3,3\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(lines)
    sheet = spark.createDataFrame([("bed", f"{tmp_path}/m1.bed"), ("many", f"{tmp_path}/t"), ("one", f"{tmp_path}/x.csv")], "level string, path string")
    x = table.experiment(spark, sheet)
    assert sorted(((r.level, r.start_pos, r.id, r.v) for r in x.collect()), key=str) == [("bed", 1, None, None), ("bed", 5, None, None), ("many", None, "g1", 1.0), ("many", None, "g2", 2.0), ("one", None, "g3", 3.0)]
    assert "SortMergeJoin" not in exchanged(x)


@pytest.mark.parametrize("name, most", [("read_call_files", 7), ("read_read_files", 5)])
def test_sets_are_written_by_many_tasks(spark, monkeypatch, tmp_path, name, most):
    """sf0.01 has 150,000 orders of 13 bases a tenth: 3 places and more of each scaffold."""
    monkeypatch.setattr(registry, "own_folder", lambda s, n: f"{tmp_path}/{n}")
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        registry.QUERIES[name](spark, "/root/testdata/sf0.01")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(list(tmp_path.rglob("part-*"))) > most


@pytest.mark.parametrize("name", ["metagene_bed", "metagene_exclude"])
def test_metagene_meets_intervals_once(spark, name):
    """Neither a sweep of depth nor a second join for the body, and one kind of join at every size."""
    plan = exchanged(registry.QUERIES[name](spark, SF))
    assert len(re.findall(r"Join \[scaffold#", plan)) == len(re.findall(r"SortMergeJoin \[scaffold#", plan)) == 1
    assert not re.search(r"Window \[.*\], \[scaffold#", plan)


def test_breaks_give_the_interpolated_profile(spark):
    """Overlapping runs, bodies of 2 bases and more, of fewer bases than points and of more; against bases one by one."""
    rng, flank, bins = np.random.default_rng(3), 2, 5
    lengths = [2, 3, 4, 5, 6, 9, 31]
    runs = [(i, n + 2 * flank, *sorted(int(v) for v in rng.integers(1, n + 2 * flank + 1, 2)), int(rng.integers(1, 4))) for i, n in enumerate(lengths) for _ in range(12)]
    want = np.zeros(2 * flank + bins)
    for _, n, a, z, c in runs:
        base = np.zeros(n)
        base[a - 1 : z] = c
        body = base[flank:-flank]
        want += np.concatenate([base[:flank], np.interp(np.arange(bins) * (len(body) - 1) / (bins - 1), np.arange(len(body)), body), base[-flank:]])
    x = spark.createDataFrame(runs, "feature_idx long, region_len long, rel_start long, rel_end long, count long")
    got = [r.value for r in signal.mean_profile_runs(x, 3, flank, bins).orderBy("slot").collect()]
    assert np.allclose(got, want / 3 / len(lengths), atol=1e-12, rtol=0)


def test_tasks_hold_a_bounded_number_of_calls(spark, monkeypatch):
    """Lines move once by position and once by bin, to as many tasks as there are lines for; no map task aggregates sites."""
    monkeypatch.setattr(registry, "CALLS", 500)
    plan = exchanged(registry.QUERIES["metagene_meth_sqrt"](spark, SF))
    parts = spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500 + 1
    assert parts > 10
    assert len(re.findall(rf"hashpartitioning\(scaffold#\d+, pos#\w+, {parts}\)", plan)) == 1
    assert len(re.findall(rf"hashpartitioning\(scaffold#\d+, __level#\d+, __bin#\w+, {parts}\)", plan)) == 2
    assert not re.search(r"hashpartitioning\((file_idx|scaffold#\d+, pos#\w+, context)", plan)


def test_pairs_of_a_code_are_spread(spark):
    cols = "start_pos long, end_pos long, code long"
    rows = lambda n, codes: [(i, i + 9, codes[i % len(codes)]) for i in range(n)]
    left = spark.createDataFrame(rows(240, [7, 7, 7, 1]) + [(1, 2, 5), (3, 4, None), (1, 2, 7), (1, 2, 7)], cols)
    right = spark.createDataFrame(rows(150, [7, 7, 2]) + [(8, 9, 1), (8, 9, None), (1, 2, 7), (1, 2, 7)], cols)
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    want = plain(intervals.left_join_on(left, right))
    for cell in (8, 50, 1000):
        got = intervals.left_join_on(left, right, cell=cell)
        assert got.columns == ["start_pos", "end_pos", "code", "r_start", "r_end", "r_code"] and plain(got) == want
    tasks = intervals.left_join_on(left, right, cell=8).groupBy(F.spark_partition_id()).count()
    assert tasks.agg(F.max("count")).first()[0] < len(want) / 20
    for on in ("start", "end", "interval"):
        assert plain(intervals.left_join_on(left, right, on, 4)) == plain(intervals.left_join_on(left, right, on))
