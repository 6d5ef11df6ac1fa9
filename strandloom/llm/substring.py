"""Substring dedup by seed and extend.

Every window of `window` consecutive words has one anchor: the least hash among its GRAM-word grams
(the leftmost of equal ones). The choice depends on the window's words alone, so equal windows have equal
anchors at equal offsets, and the windows of one anchor occurrence are neighbours.

1. Seeds. Each task reads its texts and sends the anchor occurrences alone, each with a hash of its reach: the words of
   all its windows. An occurrence whose reach an earlier document of the task has is a repeat whatever other tasks
   hold and stays, so a passage that a third of all documents share leaves a task once.
2. Seeds are joined on their anchors. Where the reach is the same too, the match runs past it on both sides, and all
   windows of the later occurrences are repeats. Anchors seen once end here. What is left are the ends of
   matches: the first occurrence of each reach of an anchor with several.
3. Extension. Only for these the texts are looked up, and the hashes of the windows that hold the anchor are taken
   one word further from it at a time, to both sides. Within an anchor, a window is a repeat if an earlier occurrence
   extends as far: the first holder of each is found by grouping, as comparing occurrences in pairs would be
   quadratic in hot anchors.
4. Ranges of windows from both steps join into maximal repeats and meet their documents, whose covered words go.

Buckets of seeds are resolved one at a time, so a task holds one of SPREAD parts of its shuffle partition. Equality is
decided on 60 bits of anchor hash, 40 bits of window or reach hash and the offset.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, parted, ship
from . import _text as T

GRAM = 6
FLUSH = 12 << 20  # bytes of text that a task packs at once
SPREAD = 16  # buckets for each shuffle partition
RANGES = "id0 long, fp int, lo int, hi int"
JOINED = RANGES + ", open boolean"
NO_ID = -(2**63)


def occurrences(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Anchor occurrences: (document, hash, first window's start, offset of the anchor in it, windows), and all window hashes in order."""
    at = T.whole(first, window)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z, z, z, z.view(np.uint64)
    n = window - GRAM + 1  # grams in a window; at most 16
    m = T.mix(T.roll(h, GRAM)) & ~np.uint64(15)
    have = 1
    while have < n:  # least gram of 1, 2, 4, ... n; the low bits are its offset
        step = min(have, n - have)
        m = np.minimum(m[: len(m) - step], m[step:] + np.uint64(step))
        have += step
    best = m[at]
    anchor = at + (best & np.uint64(15)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    wh = T.mix(T.roll(h, window)[at])
    count = np.diff(np.concatenate([new, [len(at)]]))
    doc = np.searchsorted(first, at[new], "right") - 1
    return doc, best[new] >> np.uint64(4), at[new], anchor[new] - at[new], count, wh


def reach(key: np.ndarray, offset: np.ndarray, count: np.ndarray, wh: np.ndarray) -> np.ndarray:
    """A hash of all words in the windows of each anchor occurrence."""
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    rank = np.arange(len(wh)) - np.repeat(begin, count)
    return T.mix(np.add.reduceat(T.mix(wh + rank.astype(np.uint64) * T.STEP), begin) + key * T.BASE + offset.astype(np.uint64))


def pack(parts: list[tuple], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Occurrences (id0, fp, start, hash, offset, windows, hashes) to one blob for each bucket; hashes are one of each occurrence or one of each window."""
    id0, fp, start, key, offset, count, wh = (np.concatenate(x) for x in zip(*parts))
    long = count if len(wh) != len(key) else np.ones(len(key), np.int64)
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    begin = np.concatenate([[0], np.cumsum(long)[:-1]])[order]
    id0, fp, start, key, offset, count, bucket, long = (x[order] for x in (id0, fp, start, key, offset, count, bucket, long))
    take = np.repeat(begin - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(len(wh))
    wh5 = np.ascontiguousarray(wh[take].view(np.uint8).reshape(-1, 8)[:, 3:])
    ends = np.concatenate([[0], np.cumsum(long)])
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    z = zstandard.ZstdCompressor(level=1)
    for i, j in zip(cut[:-1], cut[1:]):
        if i < j:
            ids = np.diff(id0[i:j], prepend=0)
            small = z.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(j - i, -1).T).tobytes() for x in (ids, fp[i:j].astype(np.int32), start[i:j].astype(np.int32), offset[i:j].astype(np.uint8), count[i:j].astype(np.uint8))))
            yield int(bucket[i]), struct.pack("<qqq", j - i, ends[j] - ends[i], len(small)) + small + key[i:j].tobytes() + wh5[ends[i] : ends[j]].tobytes()


def blobs(parts: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    rows = list(pack(parts, buckets))
    for at in range(0, len(rows), 64):
        b, data = zip(*rows[at : at + 64])
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "blob"])


def unpack(blob: bytes) -> tuple:
    n, m, size = struct.unpack_from("<qqq", blob)
    small = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[24 : 24 + size]), np.uint8)
    cols, at = [], 0
    for kind in (np.int64, np.int32, np.int32, np.uint8, np.uint8):
        w = np.dtype(kind).itemsize
        cols.append(np.ascontiguousarray(small[at : at + n * w].reshape(w, n).T).view(kind).ravel())
        at += n * w
    key = np.frombuffer(blob, np.uint64, n, 24 + size)
    wh = np.zeros((m, 8), np.uint8)
    wh[:, 3:] = np.frombuffer(blob, np.uint8, 5 * m, 24 + size + 8 * n).reshape(m, 5)
    return np.cumsum(cols[0]), cols[1], cols[2], key, cols[3].astype(np.int64), cols[4].astype(np.int64), wh.view(np.uint64).ravel()


def _seeds(window: int, buckets: int) -> Callable:
    """Texts to blobs of seeds; ranges that the task decides itself ride along, in some bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, local = [], 0, []
        seen, seen_id = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal parts, size, local
            if parts:
                yield from blobs(parts, buckets)
            if local:
                x = [np.concatenate(c) for c in zip(*local)]
                data = b"".join([struct.pack("<q", -len(x[0])), x[0].astype(np.int64).tobytes(), *(c.astype(np.int32).tobytes() for c in x[1:])])
                yield pa.RecordBatch.from_arrays([pa.array([int(x[0][0]) % buckets], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "blob"])
            parts, size, local = [], 0, []

        for b in batches:
            data, off = T.column(b, "text")
            ids, fps = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("id0", "fp"))
            for i, j in T.slices(off):
                h, first = T.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                doc, key, start, offset, count, wh = occurrences(h, first, window)
                size += int(off[j] - off[i])
                if len(doc):
                    id0, fp = ids[i:j][doc], fps[i:j][doc]
                    start = start - first[doc]
                    order = np.lexsort((start, fp, id0)) if (np.diff(ids[i:j]) <= 0).any() else np.arange(len(doc))
                    context = reach(key, offset, count, wh)
                    _, where, which = np.unique(context[order], return_index=True, return_inverse=True)
                    lead = np.empty(len(context), np.int64)
                    lead[order] = order[where[which]]
                    keep = lead == np.arange(len(context))
                    # a repeated row holds the same windows at the same place: they neither count twice nor go
                    gone = ~keep & ((id0 != id0[lead]) | (fp != fp[lead]) | (start != start[lead]))
                    at = np.minimum(np.searchsorted(seen, context), max(len(seen) - 1, 0))
                    if len(seen):
                        before = (seen[at] == context) & (seen_id[at] < id0)
                        keep &= ~before
                        gone |= before
                    fresh = keep if not len(seen) else keep & (seen[at] != context)
                    seen, seen_id = np.concatenate([seen, context[fresh]]), np.concatenate([seen_id, id0[fresh]])
                    o = np.argsort(seen, kind="stable")
                    seen, seen_id = seen[o], seen_id[o]
                    if gone.any():
                        local.append(joined(id0[gone], fp[gone], start[gone], (start + count)[gone]))
                    if keep.any():
                        parts.append((id0[keep], fp[keep], start[keep], key[keep], offset[keep], count[keep], context[keep]))
                if size > FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _extend(window: int, buckets: int) -> Callable:
    """Texts with the starts of their open seeds to blobs of those seeds' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            data, off = T.column(b, "text")
            ids, fps = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("id0", "fp"))
            wanted = b.column(b.schema.get_field_index("starts"))
            n, flat = np.diff(wanted.offsets.to_numpy()), wanted.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(n)])
            for i, j in T.slices(off):
                h, first = T.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                doc, key, start, offset, count, wh = occurrences(h, first, window)
                open_ = np.isin(start, flat[ends[i] : ends[j]].astype(np.int64) + np.repeat(first[:-1], n[i:j]))
                if open_.any():
                    parts.append((ids[i:j][doc[open_]], fps[i:j][doc[open_]], (start - first[doc])[open_], key[open_], offset[open_], count[open_], wh[np.repeat(open_, count)]))
                    size += int(count[open_].sum()) * 16
                if size > FLUSH:
                    yield from blobs(parts, buckets)
                    parts, size = [], 0
        if parts:
            yield from blobs(parts, buckets)

    return run


def joined(id0: np.ndarray, fp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of window starts [lo, hi) in order, with those that meet in one document joined."""
    if not len(id0):
        return id0, fp, lo, hi
    new = np.flatnonzero(np.concatenate([[True], (id0[1:] != id0[:-1]) | (fp[1:] != fp[:-1]) | (lo[1:] != hi[:-1])]))
    return id0[new], fp[new], lo[new], hi[np.concatenate([new[1:] - 1, [len(hi) - 1]])]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Seeds and decided ranges of one bucket after another, from blobs sorted by bucket."""
    now, parts, done = None, [], []
    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
            if k != now and (parts or done):
                yield parts, done
                parts, done = [], []
            now, data = k, blob.as_buffer().to_pybytes()
            (n,) = struct.unpack_from("<q", data)
            if n < 0:
                done.append(tuple([np.frombuffer(data, np.int64, -n, 8)] + [np.frombuffer(data, np.int32, -n, 8 - 8 * n - 4 * n * k) for k in range(3)]))
            else:
                parts.append(unpack(data))
    if parts or done:
        yield parts, done


def _ranges(x: tuple, open_: bool | None = None) -> pa.RecordBatch:
    cols = [pa.array(np.ascontiguousarray(v), t) for v, t in zip(x, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
    names = ["id0", "fp", "lo", "hi"]
    if open_ is not None:
        cols, names = [*cols, pa.array([open_] * len(cols[0]), pa.bool_())], [*names, "open"]
    return pa.RecordBatch.from_arrays(cols, names=names)


def _often(key: np.ndarray) -> np.ndarray:
    """Which keys come twice or more."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    often = np.zeros(len(key), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    return often


def _join_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of seeds to ranges that are repeats, and to the open ends of matches."""
    for parts, done in _buckets(batches):
        for x in done:
            yield _ranges(x, False)
        if not parts:
            continue
        id0, fp, start, key, offset, count, context = (np.concatenate(x) for x in zip(*parts))
        often = _often(key)
        id0, fp, start, key, count, context = (x[often] for x in (id0, fp, start, key, count, context))
        if not len(id0):
            continue
        by = np.lexsort((start, fp, id0, context, key))
        id0, fp, start, key, count, context = (x[by] for x in (id0, fp, start, key, count, context))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        head = new_key | np.concatenate([[True], context[1:] != context[:-1]])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        # repeated rows hold the same windows at the same place: not earlier
        later = (id0 != id0[lead]) | (fp != fp[lead]) | (start != start[lead])
        at = np.flatnonzero(later)
        if len(at):
            at = at[np.lexsort((start[at], fp[at], id0[at]))]
            yield _ranges(joined(id0[at], fp[at], start[at], (start + count)[at]), False)
        group = np.cumsum(new_key) - 1
        several = np.bincount(group[head])[group] > 1  # anchors of several reaches
        at = np.flatnonzero(head & several)
        if len(at):
            yield _ranges((id0[at], fp[at], start[at], start[at] + count[at]), True)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of open seeds with their windows to ranges that are repeats."""
    for parts, _ in _buckets(batches):
        id0, fp, start, key, offset, count, wh = (np.concatenate(x) for x in zip(*parts))
        rank = np.arange(len(wh)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        row = np.repeat(np.arange(len(count)), count)
        ident = T.mix(wh + key[row] * T.BASE + (offset[row] - rank).astype(np.uint64))
        w_start = start[row] + rank
        order = np.lexsort((start, fp, id0))  # occurrences by document
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.lexsort((w_start, place[row], ident))
        later = np.zeros(len(wh), bool)
        s = ident[by]
        i0, f0, w0 = id0[row[by]], fp[row[by]], w_start[by]
        head = np.concatenate([[True], s[1:] != s[:-1]])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        later[by] = (i0 != i0[lead]) | (f0 != f0[lead]) | (w0 != w0[lead])
        at = np.flatnonzero(later)
        at = at[np.lexsort((w_start[at], fp[row[at]], id0[row[at]]))]
        if len(at):
            yield _ranges(joined(id0[row[at]], fp[row[at]], w_start[at], w_start[at] + 1))


def _apply(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, marks = b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("marks"))
            n_words, n_removed, kept, spans = [], [], [], []
            for text, m in zip(texts, marks):
                w = (text.as_py() or "").encode().split()
                n_words.append(len(w))
                gone = []
                if m.is_valid:
                    for lo, hi in sorted((x["lo"], x["hi"]) for x in m.as_py()):
                        if gone and lo <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], hi + window - 1)
                        else:
                            gone.append([lo, hi + window - 1])
                removed = sum(hi - lo for lo, hi in gone)
                if gone:
                    at, left = 0, []
                    for lo, hi in gone:
                        left += w[at:lo]
                        at = hi
                    w = left + w[at:]
                n_removed.append(removed)
                kept.append(b" ".join(w))
                spans.append(gone)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed"],
            )

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed) for every row; removed lists word ranges [from, to).

    A word goes if a window that covers it also starts earlier in the input: in a smaller doc_id, or earlier
    in the same document. Null ids come before all others. Rows with one doc_id but other texts are other
    documents, ordered by a 31-bit fingerprint of the text; equal rows are one document, and each of them
    gets its result. Null, empty and short texts have no window and lose nothing; kept_text is then their words.
    An empty table gives no rows; other columns of any name are ignored. window is 7 to 21.
    """
    if not GRAM < window <= GRAM + 15:
        raise ValueError("window must be between 7 and 21 words")
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"id0": F.coalesce("doc_id", F.lit(NO_ID)), "fp": F.pmod(F.xxhash64("text"), F.lit(2**31 - 1)).cast("int")})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["id0", "fp"]

    def bucketed(x: DataFrame) -> DataFrame:
        return x.repartition(parts, "bucket").sortWithinPartitions("bucket")

    seeds = docs.select(*key, "text").mapInArrow(T.lean(_seeds(window, parts * SPREAD)), "bucket int, blob binary")
    met = cut(bucketed(seeds).mapInArrow(T.lean(_join_seeds), JOINED))
    # texts are parted and sorted once; both joins find them so
    texts = parted(docs, parts, *key)
    ends = met.where("open").groupBy(*key).agg(F.collect_list("lo").alias("starts"))
    windows = texts.join(ends, key).select(*key, "text", "starts").mapInArrow(T.lean(_extend(window, parts * SPREAD)), "bucket int, blob binary")
    ranges = met.where("not open").drop("open").union(bucketed(windows).mapInArrow(T.lean(_resolve), RANGES))
    marks = ranges.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    return texts.join(marks, key, "left").select("doc_id", "text", "marks").mapInArrow(T.lean(_apply(window)), "doc_id long, n_words long, n_removed long, kept_text string, removed array<array<int>>")
