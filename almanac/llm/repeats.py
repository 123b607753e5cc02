"""Repeated passages across documents, by suffix arrays with a tree of common-prefix intervals.

A byte is removed where a string of ``length`` bytes that covers it also starts in a document with a
smaller id.  Three passes over the texts:

1.  Every text gives its anchors (see ``anchors``): hashes of short strings such that equal windows of
    ``length`` bytes have equal anchors, and for each anchor a hash of its context, the bytes of all its
    windows.  Anchors meet in buckets by hash, packed in columns.  Equal contexts are one class, held by
    its smallest document; every other document of the class repeats all windows of that context.
2.  What is left are anchors with several different contexts, mostly at the ends of passages.  One
    context per class is read from the texts of its documents, and contexts with the same anchor meet
    in one suffix array: suffixes in order, the lengths of common prefixes between neighbours, and the
    intervals of the array whose suffixes share at least ``length`` bytes.  Such an interval holds all
    occurrences of a repeat; its smallest document keeps it, the others lose it.
3.  Every text is cut by the windows that were found.

An anchor with more contexts than ``hot`` is not gathered: its windows go through a map-side minimum by
their hashes instead.  A copy of one text or passage costs one row per task and class, not one per copy.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; rows with the same
id never remove from each other and each is cut for itself; rows without an id come after all others;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .anchors import anchors_of, span_hashes, words_of
from .common import materialise, partitions

#: Anchors that a task gathers before it hands them on; a worker holds some 100 bytes for each while it sorts them.
FLUSH = 1_000_000
#: Contexts or windows that a task hands on at once.
PORTION = 10_000
#: Bits dropped from anchor hashes (they only bring contexts together) and from context hashes.
ANCHOR_SHIFT, CONTEXT_SHIFT = np.uint64(24), np.uint64(8)
FULL, CONTEXT, HOT = 0, 1, 2
LAST = (1 << 63) - 1


# --- suffix arrays ------------------------------------------------------------------------------------


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, 0 after each; per position its text, its offset there and how many bytes follow."""
    sizes = np.asarray([len(t) for t in texts], dtype=np.int64)
    which = np.repeat(np.arange(len(texts)), sizes + 1)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(texts) else np.empty(0, np.int64)
    offset = np.arange(int(sizes.sum()) + len(texts)) - starts[which]
    left = sizes[which] - offset
    symbols = np.zeros(len(which), dtype=np.int64)
    symbols[left > 0] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    symbols[left > 0] += 1
    return symbols, which, offset, left


def ranked(key: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the keys, which lie below ``top``; their dense ranks from 1 on; how many ranks there are."""
    n = len(key)
    low = n.bit_length()
    if (top - 1).bit_length() + low <= 64:  # key and place in one number: sorting those is several times faster
        ordered = np.sort((key.astype(np.uint64) << np.uint64(low)) | np.arange(n, dtype=np.uint64))
        order = (ordered & np.uint64((1 << low) - 1)).astype(np.int64)
        ordered >>= np.uint64(low)
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    dense = np.cumsum(first_of(ordered))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = dense
    return order, rank, int(dense[-1]) if n else 0


def enhanced_suffix_array(symbols: np.ndarray, left: np.ndarray, depth: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``shortest`` bytes or more in order and the common prefix of each with the one before, exact up to ``depth`` bytes at least.

    Ranks of prefixes double in length, from the symbols that fit one number on; at last the suffixes
    are sorted by the ranks of up to three prefixes that cover ``depth`` bytes.  The same ranks, from
    long to short and then symbol by symbol, give the common prefixes.  A prefix ends with its text.
    """
    n, at = len(symbols), np.nonzero(left >= shortest)[0]
    if not len(at):
        return at, np.zeros(0, dtype=np.int64)
    codes = np.cumsum(np.bincount(symbols) > 0)[symbols] - 1  # symbols that occur, numbered in their order
    bits = max(1, int(codes.max()).bit_length())
    size = max(1, (64 - n.bit_length()) // bits)
    padded = np.concatenate([codes, np.zeros(size, dtype=np.int64)])
    word = padded[: n + 1].copy()
    for j in range(1, size):
        word[:n] = (word[:n] << bits) | padded[j : j + n]
    word[n] = 0
    pack = size
    _, rank, top = ranked(word[:n], 1 << (bits * pack))
    rank = np.append(rank, 0)  # what lies past the end has rank 0
    levels = [(size, rank)]
    while 3 * size < depth and top < n:
        second = np.zeros(n, dtype=np.int64)
        second[: max(0, n - size)] = rank[size:n]
        _, rank, top = ranked(rank[:n] * (top + 1) + second, (top + 1) ** 2)
        rank = np.append(rank, 0)
        size *= 2
        levels.append((size, rank))
    key, most = rank[at], top
    order = None
    for step in (size, depth - size):
        if order is None or step > size:
            order, key, most = ranked(key * (top + 1) + rank[np.minimum(at + step, n)], (most + 1) * (top + 1))
    order = at[order]
    common = np.zeros(len(order), dtype=np.int64)
    a, b = order[1:], order[:-1]
    got = np.zeros(len(a), dtype=np.int64)
    for size, rank in [levels[-1]] * 2 + levels[::-1]:
        got += (rank[np.minimum(a + got, n)] == rank[np.minimum(b + got, n)]) * size
    other = word[np.minimum(a + got, n)] ^ word[np.minimum(b + got, n)]
    for j in range(1, pack):
        got += other < (1 << (bits * j))
    common[1:] = np.minimum(got, np.minimum(left[a], left[b]))
    return order, common


def interval_tree(texts: list[bytes], at_least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats: (length, all occurrences as (text, offset)) of every repeat of ``at_least`` bytes or more.

    A stack scan over the common prefixes opens and closes the intervals of the suffix array.  An
    interval's suffixes differ in the byte after the common prefix; it is reported where they differ in
    the byte before it too (a text's start differs from everything).
    """
    symbols, which, offset, left = join_texts(texts)
    order, common = enhanced_suffix_array(symbols, left, max(map(len, texts), default=0), at_least)
    if not len(order):
        return []
    before = np.where(offset[order] > 0, symbols[order - 1], -1 - which[order])
    out, stack = [], []  # stack of [length, first place, byte before or None where they differ]
    lengths = [*common.tolist()[1:], 0]
    for i, length in enumerate(lengths):
        low, kind = i, int(before[i])
        while stack and stack[-1][0] > length:
            size, low, inner = stack.pop()
            kind = inner if inner == kind else None
            if kind is None:
                out.append((size, [(int(which[p]), int(offset[p])) for p in sorted(order[low : i + 1].tolist())]))
            if stack and stack[-1][0] >= length:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == kind else None
                kind = stack[-1][2]
        if length >= at_least:
            if stack and stack[-1][0] == length:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == kind else None
            else:
                stack.append([length, low, kind])
    return out


def repeated_windows(contexts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window offset) of the windows that also stand in a context of a smaller document.

    The intervals of at least ``length`` common bytes are the roots of the interval tree; each holds
    all occurrences of one window.
    """
    symbols, which, offset, left = join_texts(contexts)
    order, common = enhanced_suffix_array(symbols, left, length, length)
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    root = np.nonzero(common < length)[0]  # first place of every interval
    owner = docs[which[order]]
    low = np.minimum.reduceat(owner, root)
    interval = np.cumsum(common < length) - 1
    hit = order[owner > low[interval]]
    return which[hit], offset[hit]


# --- columns in rows -----------------------------------------------------------------------------------


def packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, byte plane by byte plane: planes of zeros take next to no room in a shuffle."""
    n = len(columns[0])
    return n.to_bytes(8, "little") + b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(n, 8).T).tobytes() for c in columns)


def unpacked(blob: bytes, count: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(blob, dtype=np.uint8, offset=8).reshape(count, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").reshape(n) for p in planes]


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Mask of the rows that differ from the row before in any of the sorted keys."""
    out = np.ones(len(keys[0]), dtype=bool)
    if len(out) > 1:
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def by_document(docs: np.ndarray, values: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(document, kind, packed values) per document."""
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    cut = np.nonzero(first_of(docs))[0] if len(docs) else np.empty(0, np.int64)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(docs)]):
        yield int(docs[a]), kind, values[a:b].astype("<u8").tobytes()


ROWS = "bucket int, doc long, kind int, blob binary"


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


_ROW_NAMES, _ROW_TYPES = ["bucket", "doc", "kind", "blob"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def anchor_rows(texts: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """Packed anchors by bucket (doc null), and what a task already knows to be repeated (doc set).

    Within a task a class of equal contexts is one row with its smallest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, c, d = (np.concatenate([x[i] for x in kept]) for i in range(3))
            order = np.lexsort((d, c, h))
            h, c, d = h[order], c[order], d[order]
            first = first_of(h, c)
            low = d[first][np.cumsum(first) - 1]
            known = d > low
            again = known & first_of(h, c, d)
            yield _batch([(int(doc % buckets), doc, kind, blob) for doc, kind, blob in by_document(d[again], c[again], FULL)], _ROW_NAMES, _ROW_TYPES)
            h, c, d = h[first], c[first], d[first]
            place = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            h, c, d = h[order], c[order], d[order]
            ends = np.cumsum(np.bincount(place, minlength=buckets)).tolist()
            for b, (a, z) in enumerate(zip([0, *ends[:-1]], ends)):
                if z > a:
                    yield _batch([(b, None, FULL, packed(np.diff(h[a:z], prepend=np.uint64(0)), c[a:z], d[a:z].astype(np.uint64)))], _ROW_NAMES, _ROW_TYPES)

        size = 0
        for b in batches:
            ids = b.column(0).to_numpy()
            texts = (t.as_py().encode("utf-8", "replace") for t in b.column(1))
            for i, (_, h, _, _, c) in enumerate(anchors_of(texts, length, k)):
                kept.append((h >> ANCHOR_SHIFT, c >> CONTEXT_SHIFT, np.full(len(h), ids[i])))
                size += len(h)
                if size >= FLUSH:
                    yield from flush()
                    kept, size = [], 0
        if size:
            yield from flush()

    return texts.select("key", "text").mapInArrow(run, ROWS)


def settle(rows: DataFrame, hot: int) -> DataFrame:
    """(doc, kind, blob): contexts of a document that are repeated whole, and those that must be looked at.

    A bucket holds all classes of its anchors.  A document above the smallest of its class repeats the
    whole context; the smallest of a class is looked at where the anchor has other contexts in other
    documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = _ROW_NAMES[1:], _ROW_TYPES[1:]
        hs, cs, ds = [], [], []
        for b in batches:
            docs = b.column("doc")
            forward = docs.is_valid()
            if pa.compute.any(forward).as_py():
                f = b.filter(forward)
                yield pa.RecordBatch.from_arrays([f.column(n) for n in names], names=names)
            for blob in b.filter(docs.is_null()).column("blob"):
                h, c, d = unpacked(blob.as_py(), 3)
                hs.append(np.cumsum(h, dtype=np.uint64))
                cs.append(c)
                ds.append(d.astype(np.int64))
        if not hs:
            return
        h, c, d = np.concatenate(hs), np.concatenate(cs), np.concatenate(ds)
        order = np.lexsort((d, c, h))
        h, c, d = h[order], c[order], d[order]
        first = first_of(h, c)
        low = d[first][np.cumsum(first) - 1]
        full = d > low
        yield _batch(list(by_document(d[full], c[full], FULL)), names, types)
        h, c, d = h[first], c[first], d[first]
        group = first_of(h)
        at = np.nonzero(group)[0]
        n = np.diff([*at, len(h)])
        several = (n > 1) & (np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at))
        of = np.cumsum(group) - 1
        for kind, which in ((CONTEXT, several & (n <= hot)), (HOT, several & (n > hot))):
            look = which[of]
            yield _batch(list(by_document(d[look], c[look], kind)), names, types)

    return rows.groupBy("bucket").applyInArrow(run, "doc long, kind int, blob binary")


def _values(blobs: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(blobs), dtype="<u8"))


def squeezed(texts: DataFrame) -> DataFrame:
    """(key, doc_id, z): texts compressed before they are shuffled."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=4)
        for b in batches:
            z = pa.array([press.compress(t.as_py().encode("utf-8", "replace")) for t in b.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), z], names=["key", "doc_id", "z"])

    return texts.select("key", "doc_id", "text").mapInArrow(run, f"key long, doc_id {kind}, z binary")


def _plain(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def wanted_contexts(batches: Iterator[pa.RecordBatch], kind: int, length: int, k: int) -> Iterator[tuple]:
    """(document, anchor, mark, bytes) of the contexts of one kind, every context of a document once."""
    for b in batches:
        docs, zs, all_kinds, all_blobs = (b.column(n).to_pylist() for n in ("key", "z", "kinds", "blobs"))
        wants = [_values([x for x, y in zip(blobs, kinds) if y == kind]) for kinds, blobs in zip(all_kinds, all_blobs)]
        for doc, want, (data, h, first, last, c) in zip(docs, wants, anchors_of(map(_plain, zs), length, k, [len(w) > 0 for w in wants])):
            c = c >> CONTEXT_SHIFT
            at = np.nonzero(np.isin(c, want))[0]
            for i in at[np.unique(c[at], return_index=True)[1]].tolist():
                yield doc, int(h[i] >> ANCHOR_SHIFT), int(c[i]), data[int(first[i]) : int(last[i]) + length]


def in_portions(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of ``PORTION`` rows, however many rows a batch that was read gives."""
    while part := list(islice(rows, PORTION)):
        yield _batch(part, names, types)


def contexts_of(joined: DataFrame, length: int, k: int) -> DataFrame:
    """(h, doc, c, body) of the contexts that meet in suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((h, doc, c, body) for doc, h, c, body in wanted_contexts(batches, CONTEXT, length, k))
        yield from in_portions(rows, ["h", "doc", "c", "body"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])

    return joined.mapInArrow(run, "h long, doc long, c long, body binary")


def hot_windows(joined: DataFrame, length: int, k: int) -> DataFrame:
    """(window, doc, c, place) per window of the contexts whose anchors are hot; ``window`` is a hash."""

    def windows(body: bytes) -> list[int]:
        n = len(body) - length + 1
        return span_hashes(words_of(body), np.arange(n), np.full(n, length), length).view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((x, doc, c, place) for doc, _, c, body in wanted_contexts(batches, HOT, length, k) for place, x in enumerate(windows(body)))
        yield from in_portions(rows, ["window", "doc", "c", "place"], [pa.int64(), pa.int64(), pa.int64(), pa.int32()])

    return joined.mapInArrow(run, "window long, doc long, c long, place int")


def whole_anchors(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor in portions of about ``most`` rows, however many a batch holds; an anchor is never cut."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        rest.append(b)
        if sum(x.num_rows for x in rest) >= most:
            rows = pa.concat_batches(rest)
            h = rows.column("h").to_numpy()
            end = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            at = 0
            while at < end:
                cut = int(np.searchsorted(h, h[min(at + most, end) - 1], side="right"))
                yield rows.slice(at, cut - at)
                at = cut
            rest = [rows.slice(end)]
    if rest:
        yield pa.concat_batches(rest)


def look(contexts: DataFrame, length: int, most: int = 8_000) -> DataFrame:
    """(doc, c, places): the windows of each context that a smaller document has too.

    Contexts come sorted by anchor; a suffix array takes whole anchors, about ``most`` contexts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_anchors(batches, most):
            docs, marks = rows.column("doc").to_numpy(), rows.column("c").to_numpy()
            which, place = repeated_windows(rows.column("body").to_pylist(), docs, length)
            order = np.lexsort((place, which))
            which, place = which[order], place[order].astype("<i4")
            cut = np.nonzero(first_of(which))[0] if len(which) else np.empty(0, np.int64)
            ends = [*cut[1:].tolist(), len(which)]
            out = [(int(docs[which[a]]), int(marks[which[a]]), place[a:z].tobytes()) for a, z in zip(cut.tolist(), ends)]
            yield _batch(out, ["doc", "c", "places"], [pa.int64(), pa.int64(), pa.binary()])

    return _by_anchor(contexts).mapInArrow(run, "doc long, c long, places binary")


def _by_anchor(contexts: DataFrame) -> DataFrame:
    n = partitions(contexts.sparkSession)
    return contexts.select("h", "doc", "c", "body").repartition(n, "h").sortWithinPartitions("h")


def repeat_groups(contexts: DataFrame, length: int, most: int = 8_000) -> DataFrame:
    """(text, size, doc, c, place): maximal repeats of ``length`` bytes or more within the contexts, one row per occurrence.

    The report beside the cut: which strings repeat, and where all their occurrences stand (context ``c``
    of document ``doc``, ``place`` bytes in).  Strings are maximal within contexts; a passage longer than
    a context shows as several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_anchors(batches, most):
            docs, marks, bodies = rows.column("doc").to_pylist(), rows.column("c").to_pylist(), rows.column("body").to_pylist()
            out = []
            for size, at in interval_tree(bodies, length):
                text = bodies[at[0][0]][at[0][1] : at[0][1] + size]
                out += [(text, size, docs[i], marks[i], place) for i, place in at]
            yield _batch(out, ["text", "size", "doc", "c", "place"], [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32()])

    return _by_anchor(contexts).mapInArrow(run, "text binary, size int, doc long, c long, place int")


def look_hot(w: DataFrame) -> DataFrame:
    """The same for hot anchors, from one row per window: smallest documents by a map-side minimum."""
    low = w.groupBy("window").agg(F.min("doc").alias("low"))
    hit = w.join(low, "window").where("doc > low").select("doc", "c", F.hex(F.col("place")).alias("place"))
    little = F.unhex(F.concat(*[F.substring(F.lpad("place", 8, "0"), i, 2) for i in (7, 5, 3, 1)]))
    one = hit.select("doc", "c", little.alias("one")).groupBy("doc", "c").agg(F.collect_list("one").alias("all"))
    return one.select("doc", "c", F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x)), "")).alias("places"))


CUT = "n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that the given intervals cover."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    inside = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    turn = np.nonzero(inside[1:] != inside[:-1])[0]
    return turn[::2], turn[1::2]


def cut_texts(joined: DataFrame, length: int, k: int, texts: bool) -> DataFrame:
    """Per row the removed runs and the bytes that stay (or their SHA-256)."""
    kind = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, spans, kept = [], [], []
            zs, fulls, all_marks, all_places = (b.column(n).to_pylist() for n in ("z", "full", "marks", "places"))
            hit = [bool(full or marks) for full, marks in zip(fulls, all_marks)]
            for full, marks, places, (data, _, first, last, c) in zip(fulls, all_marks, all_places, anchors_of(map(_plain, zs), length, k, hit)):
                left, right = np.empty(0, np.int64), np.empty(0, np.int64)
                if full or marks:
                    c = c >> CONTEXT_SHIFT
                    whole = np.isin(c, _values(full)) if full else np.zeros(len(c), dtype=bool)
                    starts, ends = [first[whole]], [last[whole] + length]
                    if marks:
                        found: dict[int, list[bytes]] = {}
                        for m, p in zip(marks, places):
                            found.setdefault(m, []).append(p)
                        for i in np.nonzero(np.isin(c, np.asarray(list(found), dtype=np.uint64)) & ~whole)[0]:
                            at = first[i] + np.frombuffer(b"".join(found[int(c[i])]), dtype="<i4")
                            starts.append(at)
                            ends.append(at + length)
                    left, right = covered(len(data), np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64))
                stay = b"".join(data[a:e] for a, e in zip([0, *right.tolist()], [*left.tolist(), len(data)]))
                sizes.append(len(data))
                spans.append([{"start": a, "end": e} for a, e in zip(left.tolist(), right.tolist())])
                kept.append(stay if texts else hashlib.sha256(stay).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, {CUT}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 24, hot: int = 20_000, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (removed runs of bytes), kept (the bytes that stay, or their SHA-256 if not ``texts``)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = settle(anchor_rows(rows, length, k, partitions(spark)), hot).groupBy("doc").agg(F.collect_list("kind").alias("kinds"), F.collect_list("blob").alias("blobs"))
    known = materialise(known, "known")
    # Both joins with the texts take the same rows and columns of them, so that one shuffle of the texts serves both.
    z = squeezed(rows).where("key is not null")

    def holding(kind: int) -> DataFrame:
        some = known.where(F.exists("kinds", lambda x: x == kind))
        return z.join(some, z.key == some.doc).select("key", "doc_id", "z", "kinds", "blobs")

    found = look(contexts_of(holding(CONTEXT), length, k), length)
    if known.agg(F.bool_or(F.exists("kinds", lambda x: x == HOT))).first()[0]:
        found = found.unionByName(look_hot(materialise(hot_windows(holding(HOT), length, k), "windows")))
    found = found.groupBy("doc").agg(F.collect_list("c").alias("marks"), F.collect_list("places").alias("places")).withColumnRenamed("doc", "_d")
    pairs = F.filter(F.arrays_zip("kinds", "blobs"), lambda x: x["kinds"] == FULL)
    full = known.select(F.col("doc").alias("_f"), F.transform(pairs, lambda x: x["blobs"]).alias("full"))
    cuts = full.join(found, full._f == found._d, "full").select(F.coalesce("_f", "_d").alias("_k"), "full", "marks", "places")
    joined = z.join(cuts, z.key == cuts._k, "left").select("doc_id", "z", "full", "marks", "places")
    return cut_texts(joined, length, k, texts)


def digest(found: DataFrame) -> DataFrame:
    """Sizes and counts of :func:`remove_repeats` with ``texts=False``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))
