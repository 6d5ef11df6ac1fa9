"""The pipeline's stages, each held against brute force on its own input, and the registered queries' shape."""

import os
import re
from collections import Counter
from hashlib import sha256

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents and of each stage's table."""
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, f) in enumerate(pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        out.append(docs.collect())
        if k < 4:
            assert docs.columns == COLUMNS
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def test_toxicity(spark, stages):
    before, after = stages[0], stages[1]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert kept < {r.doc_id for r in before} and all(r in set(before) for r in after)
    clean = [d for d, y in toxic.items() if y == 0]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_near_copies(stages):
    before, after = stages[1], stages[2]
    sets = [shingles(r.text) for r in before]
    comp = list(range(len(before)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    least = {}
    for i, r in enumerate(before):
        least[comp[i]] = min(least.get(comp[i], r.doc_id), r.doc_id)
    assert {r.doc_id for r in after} == set(least.values()) and len(after) == len(least)


def test_masking(stages):
    from strandloom.llm import pii

    before, after = ({r.doc_id: r for r in x} for x in stages[2:4])
    assert set(before) == set(after)
    for d, r in before.items():
        spans = pii.base_spans(r.text)
        assert (after[d].text == r.text) == (not spans) or not spans
        assert after[d].n_chars == len(after[d].text)
        assert all(r.text[a:b] not in after[d].text or len(spans) > 1 for a, _, b in spans)


def test_mixing(stages):
    before, after = stages[3], stages[4]
    n = Counter(r.doc_id for r in after)
    assert set(n) == {r.doc_id for r in before} and max(n.values()) <= 2
    assert {tuple(r) for r in after} == {tuple(r) for r in before}


def test_encoding(stages):
    from strandloom.llm import queries

    lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in stages[4]}
    assert Counter(r.doc_id for r in stages[5]) == Counter(r.doc_id for r in stages[4])
    for r in stages[5]:
        ids = lib.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert (r.ids, r.n_tokens, r.decoded_sha256) == (ids, len(ids), sha256(lib.decode(ids).encode()).hexdigest())


def test_run(spark, stages):
    assert Counter((r.doc_id, r.n_tokens) for r in pipeline.run(spark, SF).collect()) == Counter((r.doc_id, r.n_tokens) for r in stages[5])


def test_queries(spark):
    from strandloom.llm import queries

    want = {
        "op1_substring": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op2_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op3_render": ["page_id", "text", "n_chars", "n_lines"],
        "op4_forest": ["vec_id", "n_links", "component_id", "kept"], "op5_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op6_mixing": ["doc_id", "source", "n_tokens", "weight", "epoch", "block_key", "doc_key"], "op7_rendezvous": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op8_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op9_minhash": ["doc_id", "n_shingles", "component_id", "kept"], "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    }
    assert set(want) == set(queries.QUERIES)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, SF)
        assert df.columns[: len(columns)] == columns
        if name not in ("op3_render", "op4_forest", "op6_mixing"):
            assert df.count() == n
    rows = queries.op2_pii(spark, SF).collect()
    for r in rows[:50]:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
