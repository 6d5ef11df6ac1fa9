"""Offset-preserving SentencePiece encoding and decoding.

The text is normalised by longest-prefix matching through the model's compiled character map (a
double-array trie with its replacement pool), which records for every normalised byte where its source
began. Normalised text falls into segments before each run of word marks; where no vocabulary piece
crosses such a boundary, segments merge independently, so each distinct one is merged once and then looked
up. Piece lengths then project every piece through the alignment to a byte span of the original text.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._text import lean

MARK = "▁"
CACHE = 150_000  # segments a worker remembers before it forgets all
PART = 1 << 20  # characters of normalised text that are segmented at once


class CharMap:
    """A compiled character map: uint32 trie size, double-array units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.pool = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at `at`."""
        if not self.units:
            return None
        units, found, node = self.units, None, 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])]


class Normalizer:
    def __init__(self, spec: object, suffix: bool = False):
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes and its end the source byte at which the match began."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze and self.escape and self.dummy and not self.suffix:
            return self._plain(text)
        return self._matched(text)

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        src = np.frombuffer(text.encode(), np.uint8)
        at = np.arange(len(src))
        at = np.maximum.accumulate(np.where((src & 0xC0) == 0x80, 0, at))
        at = np.repeat(at, 1 + 2 * (src == 32))
        return MARK + text.replace(" ", MARK), np.concatenate([[0, 0, 0], at, [len(src)]])

    def _matched(self, text: str) -> tuple[str, np.ndarray]:
        data, mark = text.encode(), MARK.encode() if self.escape else b" "
        out, at, i = bytearray(), [], 0

        def prefix(i: int) -> tuple[int, bytes]:
            if m := self.map.longest(data, i):
                return m
            n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            return n, data[i : i + n]

        if self.squeeze:
            while i < len(data):
                n, x = prefix(i)
                if x != b" ":
                    break
                i += n
            if i == len(data):
                return "", np.zeros(1, np.int64)
        if self.dummy and not self.suffix:
            out += mark
            at += [i] * len(mark)
        space = self.squeeze
        while i < len(data):
            n, x = prefix(i)
            if space:
                x = x.lstrip(b" ")
            if x:
                y = x.replace(b" ", mark)
                out += y
                at += [i] * len(y)
                space = x.endswith(b" ")
            i += n
            if not self.squeeze:
                space = False
        if self.squeeze:
            while out.endswith(mark):
                i = at[len(out) - len(mark)]
                del out[len(out) - len(mark) :], at[len(out) :]
        if self.dummy and self.suffix:
            out += mark
            at += [i] * len(mark)
        return out.decode(), np.array([*at, i], np.int64)


class Encoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.normalize = Normalizer(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix)
        pieces = model.pieces
        # a piece that crosses into a word, or matches before merging, ties segments together
        tied = any(p.type == 4 or MARK in p.piece.lstrip(MARK) for p in pieces) or model.trainer_spec.model_type != 2
        self.segment = re.compile("(?s).+" if tied else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.tied = tied
        self.size = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in pieces], np.int64)
        self.unknown = [i for i, p in enumerate(pieces) if p.type == 2]
        self.bos, self.eos = (struct.pack("<I", i()) for i in (self.whole.bos_id, self.whole.eos_id))
        spec = model.normalizer_spec
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.name = b"", False, False, "identity"
        self.merge = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.known: dict[str, bytes] = {}

    def parts(self, norm: str) -> Iterator[list[str]]:
        i = 0
        while i < len(norm):
            j = len(norm) if self.tied else i + PART
            if j < len(norm):  # to the start of the next segment
                while j < len(norm) and norm[j] != MARK:
                    j += 1
                while 0 < j < len(norm) and norm[j - 1] == MARK and j - 1 > i:
                    j -= 1
                if j == i + PART or norm[i:j].strip(MARK) == "":
                    while j < len(norm) and norm[j] == MARK:
                        j += 1
                    while j < len(norm) and norm[j] != MARK:
                        j += 1
            yield self.segment.findall(norm[i:j])
            i = j

    def ids(self, norm: str) -> bytes:
        """Little-endian 32-bit ids of normalised text, without begin and end."""
        out = []
        for segments in self.parts(norm):
            try:
                out.append(b"".join(map(self.known.__getitem__, segments)))
            except KeyError:
                new = [s for s in dict.fromkeys(segments) if s not in self.known]
                if len(self.known) + len(new) > CACHE:
                    self.known.clear()
                    new = list(dict.fromkeys(segments))
                for s, x in zip(new, self.merge.encode(new, num_threads=1)):
                    self.known[s] = struct.pack(f"<{len(x)}I", *x)
                out.append(b"".join(map(self.known.__getitem__, segments)))
        return b"".join(out)

    def spans(self, ids: np.ndarray, norm: str, at: np.ndarray) -> np.ndarray:
        """For each id the byte range [from, to) of the source text; rows are pieces."""
        size = self.size[ids]
        for u in self.unknown:
            if (ids == u).any():  # an unknown piece is the characters between its known neighbours
                return self._spans_by_piece(norm, at)
        to = np.cumsum(size)
        return np.stack([at[to - size], at[to]], 1)

    def _spans_by_piece(self, norm: str, at: np.ndarray) -> np.ndarray:
        ends, n = [0], 0
        for p in self.merge.encode(norm, out_type="immutable_proto").pieces:
            n += len(p.surface.encode())
            ends.append(n)
        return np.stack([at[ends[:-1]], at[ends[1:]]], 1)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _run(path: str, digest: bool) -> Callable:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()] if digest else [pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", "n_bytes"] if digest else ["ids", "decoded", "span_from", "span_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            rows, begin, size = [], 0, 0

            def batch(end: int, b: pa.RecordBatch = b) -> pa.RecordBatch:
                cols = list(zip(*rows)) or [[] for _ in kinds]
                return pa.RecordBatch.from_arrays([b.column(0).slice(begin, end - begin), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", *names])  # noqa: B023

            for n, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                norm, at = e.normalize(text)
                raw = e.bos + e.ids(norm) + e.eos
                ids = np.frombuffer(raw, np.uint32)
                span = e.spans(ids[1:-1], norm, at).astype(np.int32)
                decoded = e.whole.decode(ids.tolist())
                if digest:
                    rows.append((len(ids), sha256(raw).hexdigest(), sha256(decoded.encode()).hexdigest(), zlib.crc32(span.tobytes()), int(span[-1, 1]) if len(span) else 0))
                else:
                    rows.append((ids.astype(np.int32), decoded, np.concatenate([[0], span[:, 0], at[-1:]]).astype(np.int32), np.concatenate([[0], span[:, 1], at[-1:]]).astype(np.int32)))
                    size += len(text)
                    if size > PART:
                        yield batch(n + 1)
                        rows, begin, size = [], n + 1, 0
            if rows or not len(b):
                yield batch(len(b))

    return run


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, ids, decoded, span_from, span_to) for every row; with digest, their digests instead.

    ids hold the begin and end ids, whose spans are empty; decoded is the library's decode(ids). The byte range
    [span_from[i], span_to[i]) of the UTF-8 text is what piece i came from; ranges tile the text in order. A null
    text is empty: two ids. Rows are independent, so repeats, ties and order don't matter; other columns of any
    name are ignored. `model` is a path that every executor can read.
    """
    ship(df.sparkSession)
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long, n_bytes long" if digest else "ids array<int>, decoded string, span_from array<int>, span_to array<int>"
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_run(model, digest)), f"doc_id {dict(df.select(id_col).dtypes)[id_col]}, {kind}")
