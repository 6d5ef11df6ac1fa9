"""Rendezvous sharding: laws of movement, balance and numbering."""

import zlib
from collections import Counter

from strandloom.llm import sharding

SCHEMA = "doc_id long, text string, shard string, slot int"


def rows_of(spark, rows, **kw):
    return sharding.shard(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA), kw.pop("weights", [1.0] * 8), **kw).collect()


def test_law(spark):
    rows = [(i, f"text é {i % 50}") for i in range(4000)] + [(None, None), (7, "text"), (7, "text"), (8, "")]
    got = rows_of(spark, rows)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.law == "key" and by.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 8)
    assert 250 < sum(r.grown_shard == 8 for r in got) < 650
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(8)) and min(n.values()) > 350
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    text = dict(rows[:4000])
    for r in got[:500]:
        t = (text.get(r.doc_id) or "").encode()
        if r.doc_id not in (7, 8, None):
            assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))


def test_removal_and_weights(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'t' as text")
    a = {r.doc_id: r.shard for r in sharding.shard(df, [1.0, 1.0, 2.0]).collect()}
    n = Counter(a.values())
    assert 0.45 < n[2] / 4000 < 0.55
    b = {r.doc_id: r.shard for r in sharding.shard(df, [1.0, 1.0]).collect()}
    assert all(b[k] == v for k, v in a.items() if v != 2)


def test_null_and_empty(spark):
    got = rows_of(spark, [(None, None), (None, ""), (1, None)])
    assert all(r.size == 1 and r.text_crc32 == 0 for r in got)
    assert rows_of(spark, []) == []
