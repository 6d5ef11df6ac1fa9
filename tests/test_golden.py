"""Small cases worked out by hand."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import codec, ontology
from strandloom.operators import family, genome, intervals, signal, tabular
from strandloom.operators.graph import components
from strandloom.sources import arrow, bed, calls, gff, table


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def col_of(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f("v").alias("x")).orderBy("i").collect()]


def features(spark, rows):
    return spark.createDataFrame(rows, "feature_idx long, scaffold string, start_pos long, end_pos long, strand int, feature_type string, id string")


def runs(spark, rows):
    return spark.createDataFrame(rows, "measurement int, scaffold string, start_pos long, end_pos long")


def test_ids_and_strands(spark):
    ids = ["gene:WB1", "gene:transcript:TX1", "mRNA:RNA:CDS:Protein:ABC", "gene-family:A", "gene:", "gene:gene:"]
    assert col_of(spark, ids, "string", codec.sanitize_id) == ["WB1", "TX1", "ABC", "gene-family:A", "gene:", "gene:"]
    assert col_of(spark, list("+-.?x"), "string", codec.strand_code) == [0, 1, 2, 3, 3]
    assert col_of(spark, [0xFC, 0xFF, 1], "long", codec.strand_char) == ["+", "?", "-"]
    assert col_of(spark, [256, -5, 7], "long", lambda c: codec.clamp_field(c, 8)) == [255, 0, 7]
    assert col_of(spark, ["00042", "4294967295", "4294967296", "", "1e3", "+7", " 7", "-1", "9" * 40], "string", codec.parse_uint32) == [42, 4294967295] + [None] * 7
    assert col_of(spark, ["CpG_OT_a", "CTOT", "CHH_OB", "CTOB", "none"], "string", codec.infer_strand) == [0, 0, 1, 1, 3]


def test_percent_and_payload(spark):
    assert col_of(spark, [0.0, 50.0, 100.0, -10.0, 140.0, math.nan], "double", codec.encode_percent) == [0, 128, 255, 0, 255, 0]
    assert all(one(spark, codec.encode_percent(codec.decode_percent(F.lit(c)))) == c for c in (0, 1, 77, 128, 254, 255))
    grid = spark.range(256).selectExpr("id as n").selectExpr("n", "explode(sequence(0, n)) as m").selectExpr("m", "n - m as u").withColumn("p", codec.pack_payload("m", "u"))
    assert grid.where((codec.get_meth("p") != F.col("m")) | (codec.get_unmeth("p") != F.col("u"))).count() == 0
    df = spark.createDataFrame([(10, 5), (-5, 3), (0, 0), (100000, 900000)], "m long, u long").withColumn("p", codec.pack_payload("m", "u", 2, 1))
    r = df.select(codec.get_depth("p"), codec.get_meth("p"), codec.get_unmeth("p"), codec.meth_percent("p"), codec.get_context("p"), codec.get_strand("p")).collect()
    assert tuple(r[0])[:3] == (15, 10, 5) and tuple(r[1])[:3] == (3, 0, 3) and math.isnan(r[2][3]) and r[3][0] == 65535 and abs(r[3][3] - 10) < 0.2
    assert {tuple(x)[4:] for x in r} == {(2, 1)}


def test_gff_files(spark, tmp_path):
    lines = ["##gff-version 3", "chr1\tRefSeq\tgene\t5\t20\t.\t+\t.\tID=gene:GENE1;gene_biotype=protein_coding", "chr1\t.\tmRNA\t6\t9\t.\t.\t.\tID=a,b", "chr1\tX\tnovel\t1\t2\t.\t+\t.\tID=q", "chr2\tX\texon\t1\t2\t.\t-\t.\tNote=1"]
    (tmp_path / "a.gff").write_text("\n".join(lines[:3]))
    with gzip.open(tmp_path / "b.gff.gz", "wt") as f:
        f.write("\n".join(lines[3:]) + "\n")
    files = [str(tmp_path / "a.gff"), str(tmp_path / "b.gff.gz")]
    got = gff.read_gff(spark, files, ontology.terms(spark)).orderBy("feature_idx").collect()
    assert [(r.feature_idx, r.id, r.strand, r.source, r.biotype, r.term) for r in got] == [(1, "GENE1", 0, "RefSeq", "protein_coding", 46), (2, "NA", 2, "NA", "NA", 47), (3, "NA", 1, "X", "NA", 53)]
    # without an ontology no type is lost
    assert [(r.feature_idx, r.feature_type, r.term) for r in gff.read_gff(spark, files).orderBy("feature_idx").collect()] == [(1, "gene", 46), (2, "mRNA", 47), (3, "novel", None), (4, "exon", 53)]
    x = genome.Species("worm", "6239").with_annotation(spark, files[0]).with_annotation(spark, files[1])
    assert x.name == "worm" and sorted((r.feature_idx, r.feature_type) for r in x.features.collect()) == [(1, "gene"), (2, "mRNA"), (3, "novel"), (4, "exon")]
    (tmp_path / "t.json").write_text('{"graphs":[{"nodes":[{"id":"x/SO_0000704","lbl":"gene","meta":{"definition":{"val":"d"}}},{"id":"x/other","lbl":"no","meta":{"definition":{"val":"d"}}},{"id":"x/SO_0000147","lbl":"exon","meta":{"definition":{"val":"e"}}}]}]}')
    assert [tuple(r)[:3] for r in ontology.read_terms(spark, str(tmp_path / "t.json")).orderBy("short_id").collect()] == [(1, 704, "gene"), (2, 147, "exon")]


def test_bed_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("s1\t4\t1609\ns1\t0\t5\tn\t0\t-")
    assert sorted((r.start_pos, r.end_pos, r.strand) for r in bed.read_bed(spark, str(tmp_path / "a.bed")).collect()) == [(1, 5, 1), (5, 1609, 3)]


def test_overlap_and_joins(spark):
    a = spark.createDataFrame([("c", 10, 50, 7), ("c", 200, 300, 0)], "scaffold string, start_pos long, end_pos long, v int")
    b = spark.createDataFrame([("c", 30, 100)], "scaffold string, start_pos long, end_pos long")
    assert [(r.frag_start, r.frag_end, r.v) for r in intervals.overlap_join(a, b).collect()] == [(30, 50, 7)]
    cols = "start_pos long, end_pos long, code long"
    left = spark.createDataFrame([(10, 20, 100), (30, 40, 200), (50, 60, 300)], cols)
    right = spark.createDataFrame([(11, 21, 100), (35, 45, 999), (55, 65, 300), (70, 80, 300)], cols)
    got = sorted(((r.code, r.r_start) for r in intervals.left_join_on(left, right).collect()), key=str)
    assert got == [(100, 11), (200, None), (300, 55), (300, 70)]
    with pytest.raises(ValueError):
        intervals.left_join_on(left, right, "other")


@pytest.mark.parametrize("coarse", [1 << 20, 4])
def test_depth(spark, coarse):
    def bases(df):
        return [r.c for r in df.select(F.explode(F.sequence("start_pos", "end_pos")).alias("b"), F.col("count").alias("c")).orderBy("b").collect()]

    m = runs(spark, [(1, "c", 1, 5), (1, "c", 10, 12), (2, "c", 3, 11)])
    assert bases(intervals.depth(m, coarse=coarse)) == [1, 1, 2, 2, 2, 1, 1, 1, 1, 2, 2, 1]
    m = runs(spark, [(1, "c", 1, 5), (1, "c", 3, 8)])
    assert bases(intervals.depth(m, coarse=coarse)) == [1] * 8
    assert bases(intervals.depth(m, False, coarse)) == [1, 1, 2, 2, 2, 1, 1, 1]
    m = runs(spark, [(i, "c", 1, 2) for i in range(256)])
    assert bases(intervals.depth(m, coarse=coarse)) == [256, 256]
    with pytest.raises(Exception, match="256 measurements; 255 are supported"):
        intervals.depth(m, most=255).collect()


def test_segments_that_touch_stay_apart(spark):
    x = runs(spark, [(1, "c", 1, 4), (1, "c", 5, 9), (1, "c", 9, 40), (1, "c", 41, 42)])
    for coarse in (1 << 20, 5, 8):
        got = sorted((r.start_pos, r.end_pos) for r in intervals.merge_segments(x, coarse=coarse).collect())
        assert got == [(1, 4), (5, 40), (41, 42)]


def test_profiles(spark):
    f = features(spark, [(1, "c", 3, 6, 0, "gene", "g")])
    counts = [2, 4, 0, 6, 12, 0, 8, 10]
    r = spark.createDataFrame([("c", i, i, c) for i, c in enumerate(counts, 1)], "scaffold string, start_pos long, end_pos long, count long")
    p = signal.project_runs(f, r, "gene", 2)
    got = {x.slot: x.value for x in signal.profile_runs(p, 2, 2, 3).collect()}
    assert [got.get(s, 0.0) for s in range(1, 8)] == [1, 2, 0, 4.5, 0, 4, 5]
    mean = [x.value for x in signal.mean_profile_runs(p, 2, 2, 3).orderBy("slot").collect()]
    assert mean == [1, 2, 0, 4.5, 0, 4, 5]
    rev = signal.project_runs(f.withColumn("strand", F.lit(1)), r, "gene", 2)
    assert {x.slot: x.value for x in signal.profile_runs(rev, 2, 2, 3).collect()} == {1: 5, 2: 4, 4: 4.5, 6: 2, 7: 1}


def test_call_profiles(spark):
    levels = spark.createDataFrame([(1, 10, 1, 1.0, 10), (1, 10, 3, 0.25, 5), (1, 10, 4, 0.75, 15), (1, 10, 10, 0.5, 8)], "feature_idx long, region_len long, rel_base long, level float, weight long")
    got = {r.slot: (r.level, r.weight) for r in signal.profile_calls(levels, 2, 3).collect()}
    assert got == {1: (1.0, 10), 3: (0.625, 20), 7: (0.5, 8)}
    assert {r.slot: (r.level, r.weight) for r in signal.profile_calls(levels, 2, 3, by_depth=False).collect()}[3] == (0.5, 2)
    two = spark.createDataFrame([(1, 10, 1, 1.0, 30), (2, 10, 1, 0.0, 10)], levels.schema)
    mean = lambda **k: signal.mean_profile_calls(two, 2, 3, **k).orderBy("slot").first().value
    assert mean() == 0.75 and mean(by_depth=False) == 0.5 and abs(mean(transform=F.sqrt) - 30**0.5 / (30**0.5 + 10**0.5)) < 1e-12
    assert math.isnan(signal.mean_profile_calls(two, 2, 3).orderBy(F.desc("slot")).first().value)
    with pytest.raises(Exception, match="finite"):
        signal.mean_profile_calls(two, 2, 3, transform=lambda w: -w).collect()
    f = features(spark, [(1, "c", 100, 110, 0, "gene", "g")])
    c = spark.createDataFrame([("c", 105, 30, 0, 0, 0), ("c", 105, 0, 10, 0, 1)], "scaffold string, pos long, m long, u long, context int, strand int")
    c = c.withColumn("payload", codec.pack_payload("m", "u", F.col("context"), F.col("strand")))
    r = signal.project_calls(f, c, "gene", 5).first()
    assert (r.rel_base, r.level, r.weight) == (11, 0.75, 40)


def test_calls(spark):
    reads = ["head", "r\t+\tchr1\t100\tZ", "r\t+\tchr1\t100\tZx", "r\t-\tchr1\t100\tz", "r\t+\tchr1\t200\tX", "\t\tchr1\t200\tx", "r\t+\tchr2\t5\tU", "r\t+\tchr2\t6"]
    df = spark.createDataFrame([(x,) for x in reads], "value string")
    got = {(r.scaffold, r.pos, r.context): (r.meth, r.unmeth) for r in calls.count_reads(calls.parse_reads(df)).collect()}
    assert got == {("chr1", 100, 0): (2, 1), ("chr1", 200, 1): (1, 1), ("chr2", 5, 3): (1, 0)}
    cov = ["c\t30\t30\t50\t2\t1\r", "c\t30\t30\t50\t4\t2", "c\t7\t7\t50\t60000\t60000", "c\tx\t7\t50\t1\t1", "c\t7\t7\t50\t1"]
    x = calls.load_coverage(spark.createDataFrame([(v,) for v in cov], "value string"))
    got = {r.pos: (r.d, r.m) for r in x.select("pos", codec.get_depth("payload").alias("d"), codec.get_meth("payload").alias("m")).collect()}
    assert got[30] == (9, 6) and got[7][0] == 65535 and abs(got[7][1] / 65535 - 0.5) < 0.002
    sets = spark.createDataFrame([(1, "c", 1, 3000, 2000), (2, "c", 1, 3000, 2000), (2, "c", 2, 1, 0)], "k int, scaffold string, pos long, m long, u long").withColumns({"context": F.lit(0), "strand": F.lit(0)})
    sets = sets.withColumn("payload", codec.pack_payload("m", "u", F.col("context"), F.col("strand"))).drop("m", "u")
    for exact in (False, True):
        got = {r.pos: r.d for r in calls.merge(sets, "k", exact).select("pos", codec.get_depth("payload").alias("d")).collect()}
        assert got == {1: 10000, 2: 1}
    grid = spark.range(1, 11).select(F.lit("c").alias("scaffold"), (F.col("id") * 100).alias("pos"))
    assert [calls.in_range(grid, *b).count() for b in ((300, 500), (301, 499), (700, 699))] == [3, 1, 0]


def test_store_keeps_odd_names(spark, tmp_path):
    df = spark.createDataFrame([("scaffold|weird:name", 5, 0, 1, 77), ("015", 6, 0, 1, 78), ("15", 7, 0, 1, 79)], "scaffold string, pos long, context int, strand int, payload long")
    calls.write(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in calls.read(spark, str(tmp_path / "c")).select(df.columns).collect()) == sorted(tuple(r) for r in df.collect())


def test_quantiles(spark):
    t = spark.createDataFrame([(i, i, float(i)) for i in range(1, 9)], "row_idx long, feature_idx long, v double")
    assert [r.bin for r in tabular.quantile_bins(t, ["v"], 4).orderBy("row_idx").collect()] == [1, 1, 2, 2, 3, 3, 4, 4]
    r = spark.createDataFrame([(1, 1, 3.0, 1.0), (2, 2, 2.0, 9.0), (3, 3, 2.0, 1.0), (4, 4, 1.0, 5.0), (5, 5, 0.1, 1.0), (6, 6, 0.1, 2.0)], "row_idx long, feature_idx long, a double, b double")
    assert [x.bin for x in tabular.quantiles_by_rank(r, ["a", "b"], 3).orderBy("row_idx").collect()] == [3, 3, 2, 2, 1, 1]
    tied = r.withColumns({"a": F.lit(1.0)})
    assert [x.bin for x in tabular.quantiles_by_rank(tied, ["a"], 3).orderBy("row_idx").collect()] == [1, 1, 2, 2, 3, 3]
    five = t.where("row_idx <= 5")
    assert [x.bin for x in tabular.quantiles_by_rank(five, ["v"], 4).orderBy("row_idx").collect()] == [1, 2, 3, 4, 4]
    for bad in (lambda: tabular.quantile_bins(t, ["v"], 0), lambda: tabular.quantiles_by_rank(t, [], 3), lambda: tabular.quantiles_by_rank(t, ["zz"], 3)):
        with pytest.raises(ValueError):
            bad()


def genes(spark):
    return features(spark, [(i, "chr1" if i < 4 else "chr2", i * 100, i * 100 + 50, 0, "gene", f"g{i}") for i in range(1, 7)])


def test_family(spark):
    cols = "query string, subject string, DS double, dn double, id_subject_query double, id_query_subject double"
    rows = [("g1", "g2", 0.5, 0.1, 90.0, 80.0), ("g2", "g3", 0.2, 0.1, 70.0, 99.0), ("g5", "g6", 0.3, 0.2, 60.0, 60.0), ("g1", "nope", 0.1, 0.1, 1.0, 1.0), ("g3", "g4", math.nan, 0.1, 1.0, 1.0)]
    f = family.family(genes(spark), spark.createDataFrame(rows, cols))
    assert [(r.gene_idx, r.id) for r in f.genes.orderBy("gene_idx").collect()] == [(1, "g1"), (2, "g2"), (3, "g3"), (4, "g5"), (5, "g6")]
    got = {(r.query, r.subject) for r in family.best_hits(f).collect()}
    assert got == {("g2", "g3"), ("g5", "g6")}
    comp = {r.gene_idx: r.component for r in family.gene_components(f).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    sub = family.subfamily(f, ["g2", "g6", "g5"])
    assert {(r.row_idx, r.col_idx, r.value) for r in sub.relations["dS"].collect()} == {(2, 3, 0.3)}
    with pytest.raises(ValueError):
        family.subfamily(f, ["g2", "zz"])
    only = spark.createDataFrame([("g1", "g2", 90.0, 70.0), ("g1", "g3", 95.0, 69.0), ("g2", "g3", 70.0, 60.0)], "q string, s string, id_subject_query double, id_query_subject double")
    f = family.family(genes(spark), only)
    hits = {s: [(r.query, r.subject) for r in family.best_hits(f, s).collect()] for s in ("mean", "min", "max")}
    assert hits == {"mean": [("g1", "g3")], "min": [("g1", "g2")], "max": [("g1", "g3")]}
    tie = family.family(genes(spark), only.withColumns({"id_subject_query": F.lit(5.0), "id_query_subject": F.lit(5.0)}))
    assert [(r.query, r.subject, r.tied) for r in family.best_hits(tie).collect()] == [("g1", "g2", True)]


def test_pair_best_hits(spark):
    rows = [(1, "A", "B", 95.0, 93.0), (2, "A", "C", 50.0, 40.0), (3, "C", "D", 80.0, 85.0)]
    df = spark.createDataFrame(rows, "row_idx int, GeneID string, ParalogID string, p1 double, p2 double")
    got = sorted((r.GeneID, r.ParalogID, r.perc_1, r.perc_2) for r in family.pair_best_hits(df, "row_idx").collect())
    assert got == [("B", "A", 95.0, 93.0), ("D", "C", 80.0, 85.0)]
    assert sorted((r.perc_1, r.perc_2) for r in family.pair_best_hits(df, "row_idx", "double_max").collect()) == [(80.0, 85.0), (95.0, 93.0)]
    ds = family.pair_best_hits(df.drop("p2"), "row_idx", "ds")
    assert sorted((r.GeneID, r.ParalogID, r.ds) for r in ds.collect()) == [("C", "A", 50.0)]
    with pytest.raises(ValueError):
        family.pair_best_hits(df, "row_idx", "other")


def test_double_max_is_greedy(spark):
    # a ring of candidates: each probes the next
    rows = [(1, "a", "b", 90.0, 1.0), (2, "b", "c", 90.0, 1.0), (3, "c", "a", 90.0, 1.0)]
    df = spark.createDataFrame(rows, "row_idx int, g string, p string, x double, y double")
    assert [(r.GeneID, r.ParalogID) for r in family.pair_best_hits(df, "row_idx", "double_max").collect()] == [("b", "a")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, 500), (300, 301), (301, 300), (1000, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 201)) and got[1000] == 1 and got[301] == got[300] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables(spark, tmp_path):
    f = genes(spark)
    t = spark.createDataFrame([(1, "g1", 1.0, 2), (2, "zz", 3.0, 4), (3, "g1", 5.0, 6)], "r int, id string, a double, b int")
    x = table.load(t, f, "id", "r", ["a", "b"])
    assert {(r.row_idx, r.feature_idx) for r in x.collect()} == {(1, None), (2, None), (3, 1)}
    assert table.by_id(x, "g1").first().row_idx == 3 and table.by_ids(x, ["g1", "zz"]).count() == 1
    assert table.choose(x, ["a", "b"], ["b", "a"]).columns[-2:] == ["a", "b"] and table.choose(x, ["a", "b"], ["q"]) is None
    assert table.load(t, f, "a", "r", ["b"]) is None
    (tmp_path / "x.csv").write_text("id,v\ng1,1\ng2,2.5\n")
    (tmp_path / "y.csv").write_text("id,v\ng3,4\n")
    sheet = spark.createDataFrame([("wt", "d1", str(tmp_path / "x.csv")), ("mut", "d1", str(tmp_path / "y.csv"))], "strain string, day string, path string")
    assert sorted((r.strain, r.id, r.v) for r in table.experiment(spark, sheet).collect()) == [("mut", "g3", 4.0), ("wt", "g1", 1.0), ("wt", "g2", 2.5)]
    assert {(r.strain, r.day, r.n) for r in table.level_counts(sheet, ["day", "strain"]).collect()} == {(None, "d1", 2), ("wt", "d1", 1), ("mut", "d1", 1)}
    (tmp_path / "z.BED").write_text("s1\t4\t9\n")
    mixed = sheet.union(spark.createDataFrame([("wt", "d2", str(tmp_path / "z.BED"))], sheet.schema))
    assert sorted(((r.strain, r.day, r.id, r.v, r.start_pos) for r in table.experiment(spark, mixed).collect()), key=str) == [("mut", "d1", "g3", 4.0, None), ("wt", "d1", "g1", 1.0, None), ("wt", "d1", "g2", 2.5, None), ("wt", "d2", None, None, 5)]
    tree = table.variables(spark, mixed)
    assert list(tree) == ["wt", "mut"] and list(tree["wt"].covariates) == ["d1", "d2"] and tree["wt"].covariates["d1"].data.count() == 2
    with pytest.raises(ValueError):
        table.Variable("x")
    for bad in (sheet.select("path"), sheet.union(sheet), sheet.withColumn("path", F.lit("/no/such.csv")).limit(1)):
        with pytest.raises((ValueError, FileNotFoundError)):
            table.experiment(spark, bad)


def test_lookups(spark):
    f = genes(spark).withColumns({"source": F.lit("s"), "biotype": F.lit("b")})
    assert genome.by_id(f, "g2").first().feature_idx == 2 and genome.by_id(f, "none").count() == 0
    assert genome.by_ids(f, ["g1", "g9"]).count() == 1 and genome.of_type(f, "gene", "chr2").count() == 3
    r = genome.record(genome.with_code(f).select("scaffold", "start_pos", "end_pos", "code"), f).orderBy("start_pos").first()
    assert (r.id, r.feature_type, r.metadata) == ("g1", "gene", ["g1", "s", "b"])


def test_wide_and_narrow_intervals_meet(spark):
    """Lengths over many levels, on either side."""
    r = random.Random(4)
    make = lambda n: [(i, "c", s, s + r.choice([0, 5, 511, 512, 5000, 40_000, 300_000])) for i in range(n) for s in [r.randrange(1, 200_000)]]
    a, b, p = make(60), make(60), [(i, r.randrange(1, 500_000)) for i in range(60)]
    da, db = spark.createDataFrame(a, "i long, scaffold string, start_pos long, end_pos long"), spark.createDataFrame(b, "j long, scaffold string, start_pos long, end_pos long")
    got = sorted((x.i, x.j, x.frag_start, x.frag_end) for x in intervals.overlap_join(da, db).collect())
    assert got == sorted((i, j, max(s, t), min(e, f)) for i, _, s, e in a for j, _, t, f in b if s <= f and t <= e)
    dp = spark.createDataFrame([(i, "c", x) for i, x in p], "k long, scaffold string, pos long")
    assert sorted((x.i, x.k) for x in intervals.point_join(da, dp).collect()) == sorted((i, k) for i, _, s, e in a for k, x in p if s <= x <= e)


def test_quantiles_are_exact(spark):
    import numpy as np

    r = random.Random(5)
    rows = [(g, float(r.choice([1, 1, 1, 2, 7, r.random()]))) for g in "ab" for _ in range(r.randrange(1, 200))] + [("c", 3.0)]
    got = {x.g: x.q for x in tabular.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for g in "abc":
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g], [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_greedy_in_order(spark):
    """Candidates that form paths and rings, against taking them one by one."""
    r = random.Random(6)
    for n in (2, 9, 60):
        to = list(range(n))
        r.shuffle(to)
        pairs = [(i, j) for i, j in enumerate(to) if i != j and r.random() < 0.85]
        taken, want = set(), []
        for i, j in sorted(pairs):
            if not {i, j} & taken:
                want.append((i, j))
                taken |= {i, j}
        assert sorted(map(tuple, family._greedy(spark.createDataFrame(pairs, "i long, j long")).collect())) == want
    line = [(i, i + 1) for i in range(40)]
    assert sorted(map(tuple, family._greedy(spark.createDataFrame(line, "i long, j long")).collect())) == line[::2]


def test_kde(spark):
    v = spark.createDataFrame([("c", float(x)) for x in (1, 2, 2, 3, 7)] + [("d", 1.0), ("c", math.nan)], "scaffold string, value double")
    got = signal.kde(v, 64).orderBy("x").collect()
    assert {r.scaffold for r in got} == {"c"} and len(got) == 64
    area = sum((b.x - a.x) * (a.density + b.density) / 2 for a, b in zip(got, got[1:]))
    assert abs(area - 1) < 1e-3


@pytest.mark.parametrize("compression", ["zstd", "lz4", None])
def test_arrow_exchange(spark, tmp_path, compression):
    df = calls.create(spark, "scaffold|weird:name", [9, 5, 2**32 - 1], [77, 78, 2**28 - 1]).union(calls.create(spark, "scaffold_weird_name", [1], [5]))
    arrow.write_folder(df, str(tmp_path / "a"), compression)
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["scaffold_weird_name.arrow", "scaffold_weird_name_2.arrow", "scaffolds.tsv"]
    assert sorted(map(tuple, arrow.read_folder(spark, str(tmp_path / "a")).collect())) == sorted(map(tuple, df.collect()))
    one = arrow.read_files(spark, str(tmp_path / "a" / "scaffold_weird_name_2.arrow")).collect()
    assert [r.pos for r in one] == [5, 9, 2**32 - 1]
    with pytest.raises(FileNotFoundError):
        arrow.read_folder(spark, str(tmp_path))
    arrow.write_folder(df, str(tmp_path / "b"), compression, most=2)  # a large scaffold in parts
    assert len(list((tmp_path / "b").iterdir())) == 4 and sorted(map(tuple, arrow.read_folder(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        calls.create(spark, "c", [1, 2], [3])
    assert {r.scaffold: r.n_sites for r in calls.summary(df).collect()} == {"scaffold|weird:name": 3, "scaffold_weird_name": 1}
