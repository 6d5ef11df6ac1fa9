"""Encoding against the library: ids, spans, decoding, and normalisation through a compiled map."""

import random
import struct

import pytest

sp = pytest.importorskip("sentencepiece")
pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")

from strandloom.llm import pieces  # noqa: E402
from strandloom.llm.queries import tokenizer

MODEL = tokenizer("piece_bpe_32k.model")
TEXTS = ["", " ", "  two  spaces ", "a", "plain words here", "É ñ ß 漢字 🙂 ‍", "▁mark▁ ▁", "tab\tnew\nline\r", "<s> </s> <unk>", "x" * 3000, " " * 40 + "end", "\u0000nul", "1.2.3.4 a@b.c", "é"]


def random_texts(seed, n=200):
    r = random.Random(seed)
    parts = ["the", "The", " ", "  ", "\n", "é", "漢", "🙂", "▁", ".", "0", "ing", "zz", "\t", "ß"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_ids_and_decoding(spark):
    lib = sp.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate([None, *TEXTS, *random_texts(1)]))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in pieces.encode(df, MODEL).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == want
        assert got[i].decoded == lib.decode(want)
        raw = (t or "").encode()
        spans = list(zip(got[i].span_from, got[i].span_to))
        assert b"".join(raw[a:b] for a, b in spans) == raw
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    assert pieces.encode(df.limit(0), MODEL).collect() == []


def test_digest(spark):
    from hashlib import sha256

    lib = sp.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pieces.encode(df, MODEL, digest=True).collect():
        ids = lib.encode(TEXTS[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == sha256(lib.decode(ids).encode()).hexdigest()
        assert r.n_bytes == len(TEXTS[r.doc_id].encode())


def test_parts_of_long_texts(monkeypatch):
    lib = sp.SentencePieceProcessor(model_file=MODEL)
    e = pieces.Encoder(MODEL)
    for size in (1, 2, 5, 17):
        monkeypatch.setattr(pieces, "PART", size)
        for t in [*TEXTS, *random_texts(2)]:
            norm, _ = e.normalize(t)
            assert "".join(x for p in e.parts(norm) for x in p) == norm
            assert list(struct.unpack(f"<{len(e.ids(norm)) // 4}I", e.ids(norm))) == lib.encode(t)


def double_array(keys):
    """A compiled map in the double-array format, built naively: keys to replacement bytes."""
    pool, at = b"", {}
    for k, v in keys.items():
        at[k] = len(pool)
        pool += v + b"\0"
    units, used = {0: 0}, {0}
    trie = {}
    for k in keys:
        node = trie
        for c in k:
            node = node.setdefault(c, {})
        node[-1] = at[k]

    def place(node, pos, label):
        children = sorted(c for c in node if c >= 0)
        leaf = -1 in node
        need = ([0] if leaf else []) + children
        base = next(b for b in range(1, 1 << 20) if all((pos ^ b ^ c) not in used for c in need) and (b < 1 << 21))
        for c in need:
            used.add(pos ^ base ^ c)
        units[pos] = (base << 10) | (label & 0xFF) | (0x100 if leaf else 0)
        if leaf:
            units[pos ^ base] = 0x80000000 | node[-1]
        for c in children:
            place(node[c], pos ^ base ^ c, c)

    place(trie, 0, 0)
    size = (max(units) // 256 + 1) * 256
    return struct.pack("<I", 4 * size) + struct.pack(f"<{size}I", *(units.get(i, 0) for i in range(size))) + pool


@pytest.mark.parametrize("squeeze,dummy,escape", [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
def test_compiled_map(squeeze, dummy, escape):
    keys = {b"a": b"A", b"ab": b"<ab>", b"abcd": b"", "é".encode(): b"e", "　".encode(): b" ", b"\t": b" ", "ﬁ".encode(): b"fi", b"q ": b"  "}
    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    spec.precompiled_charsmap, spec.remove_extra_whitespaces, spec.add_dummy_prefix, spec.escape_whitespaces, spec.name = double_array(keys), bool(squeeze), bool(dummy), bool(escape), "own"
    lib = sp.SentencePieceProcessor(model_proto=m.SerializeToString())
    own = pieces.Normalizer(spec)
    r = random.Random(9)
    parts = ["a", "ab", "abc", "abcd", "é", "　", "\t", " ", "ﬁ", "x", "漢", "q "]
    for t in ["", " ", "ab", "abcd", *("".join(r.choice(parts) for _ in range(r.randrange(1, 25))) for _ in range(300))]:
        norm, at = own(t)
        assert len(at) == len(norm.encode()) + 1 and (at[1:] >= at[:-1]).all()
        want = lib.normalize(t)
        assert norm == want, (t, norm, want)
