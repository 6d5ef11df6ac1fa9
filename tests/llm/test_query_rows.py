"""Registered queries that have no SQL, against brute force over the smallest tables."""

import os
import re
import struct
import zlib
from collections import Counter
from hashlib import md5, sha256
from math import log

import pytest

from strandloom.llm import pii, queries
from strandloom.llm.mixing import solve
from strandloom.llm.render import render

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_op2(spark, docs):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for r in queries.op2_pii(spark, SF).collect():
        t, out = docs[r.doc_id].text or "", []
        for k, (kind, p) in enumerate(plain.items()):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m.group())
                ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
                if ok:
                    out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        want = [x for *_, x in sorted(out)]
        assert r.base_sha256 == sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_op3(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op3_render(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == render(pages[r.page_id])
        assert "<script" not in r.text and "track(" not in r.text
        # words of the paragraphs come out
        inner = re.findall(r"<p>([^<>&]{20,})</p>", pages[r.page_id])
        assert all(re.sub(r"\s+", " ", x).strip() in r.text for x in inner[:5])


def test_op5(spark, docs):
    for r in queries.op5_quality(spark, SF).collect():
        t = docs[r.doc_id].text or ""
        w = words(t)
        n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_op6(spark, docs):
    total = Counter()
    for r in docs.values():
        total[r.source] += len(words(r.text))
    keys = sorted(total)
    import numpy as np

    n = np.array([total[k] for k in keys])
    plan = solve(n, 0.95, 4.0, int(n.sum()))
    got = Counter()
    for r in queries.op6_mixing(spark, SF).collect():
        assert r.n_tokens == len(words(docs[r.doc_id].text))
        got[r.source] += r.n_tokens
    longest = max(len(words(r.text)) for r in docs.values())
    for k, want in zip(keys, plan.tokens):
        assert want <= got[k] <= want + longest


def test_op7(spark, docs):
    def place(doc_id, n):
        cost = [-log((int(md5(f"k{doc_id}#{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) for s in range(n)]
        return cost.index(min(cost))

    rows = queries.op7_rendezvous(spark, SF).collect()
    for r in rows:
        t = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "key", place(r.doc_id, 8), place(r.doc_id, 9))
    for s in range(8):
        mine = sorted(r.slot for r in rows if r.shard == s)
        assert mine == list(range(len(mine)))


def test_op8(spark, docs):
    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    for r in queries.op8_pieces(spark, SF).collect():
        ids = lib.encode(docs[r.doc_id].text or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == sha256(lib.decode(ids).encode()).hexdigest()


def test_op10(spark, docs):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    seen = [(r.predicted, toxic[r.doc_id]) for r in rows if r.doc_id in toxic]
    assert sum(p == y for p, y in seen) / len(seen) > 0.95
