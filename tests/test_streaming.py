"""Site counts of files that arrive one after another."""

from strandloom.streaming import counts


def test_site_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    q = counts.site_counts(counts.read_lines(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("sites").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        (tmp_path / "in" / "a_OT_.txt").write_text("head\nr\t+\tc\t5\tZ\nr\t+\tc\t5\tz\n")
        q.processAllAvailable()
        (tmp_path / "in" / "b_OT_.txt").write_text("r\t+\tc\t5\tZ\nr\t+\tc\t6\tH\n")
        q.processAllAvailable()
        got = {(r.scaffold, r.pos, r.context, r.strand): (r.meth, r.unmeth) for r in spark.table("sites").collect()}
        assert got == {("c", 5, 0, 0): (2, 1), ("c", 6, 2, 0): (1, 0)}
    finally:
        q.stop()
