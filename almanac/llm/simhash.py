"""SimHash near-duplicates: exact Hamming links by vantage-point shards.

Fingerprints are compared as distinct values, so copies cost nothing.  Each level of the tree measures
the distance to a vantage point and cuts it into bands; the bands of all levels name a shard.  Two
fingerprints at most r apart differ by at most r in every distance to a vantage point (triangle
inequality), so a fingerprint visits exactly the shards whose bands its balls of radius r touch, and
shards further off are never looked at.  Inside a shard the same bound, on two vantage points of the
shard's own, prunes stretches before the remaining pairs are compared.  A shard returns a spanning forest
of its links, at most one row per fingerprint, never all pairs.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like
any other; fewer words than a shingle has make one shingle; rows that repeat an id get their own
fingerprints and, where those are equal or linked, the same component; a null id never names a
component unless nothing else does; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, materialise, partitions, sieve, sifted
from .neighbours import grouped

#: Shingles hashed at a time, so that a very long text needs little memory.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = 4) -> int:
    """Signed 64-bit SimHash of the word shingles, lower-cased A-Z; bit set where over half the hashes have it."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        some = words[at : at + CHUNK + size - 1]
        line = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1) - 1
        first = np.concatenate([[0], ends[:-1] + 1])
        k = min(CHUNK, n - at)
        last = ends[min(size, len(some)) - 1 :][:k]
        got = b"".join([digest(line[a:b], 42) for a, b in zip(first[:k].tolist(), last.tolist())])
        bits = np.unpackbits(np.frombuffer(got, dtype=np.uint8).reshape(k, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp) per row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py(), size) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fp], names=["doc_id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text, F.xxhash64(text)).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def vantage(level: int) -> int:
    """The vantage point of a level: a fixed random code, equal after every restart."""
    return int.from_bytes(xxhash.xxh64_digest(f"vantage {level}".encode(), 7), "big", signed=True)


def distance(fp: Column, level: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(vantage(level)))).cast("int")


def bands(fps: DataFrame, levels: int, count: int) -> list[list[int]]:
    """Per level the cut points of its distances: at most 65 counts per level reach the driver."""
    cuts = []
    for level in range(levels):
        hist = dict(fps.groupBy(distance(F.col("fp"), level)).count().collect())
        total, run, cut = sum(hist.values()), 0, []
        for d in range(65):
            if run >= total * (len(cut) + 1) / count and len(cut) < count - 1 and d:
                cut.append(d)
            run += hist.get(d, 0)
        cuts.append(cut)
    return cuts


def _band(d: Column, cut: list[int]) -> Column:
    """0-based band of a distance."""
    out = F.lit(0)
    for c in cut:
        out = out + (d >= c).cast("int")
    return out


def _extend(shards: Column, reach: Column, count: int) -> Column:
    """Shard numbers with one more level: every shard so far with every band of ``reach``."""
    return F.flatten(F.transform(shards, lambda t: F.transform(reach, lambda b: t * count + b)))


def forest(own: np.ndarray, guests: np.ndarray, radius: int, among: bool = True) -> np.ndarray:
    """Spanning forest of the links between ``own`` and ``guests`` and, with ``among``, inside ``own``: pairs (fp, root fp).

    Codes are ordered by their distances to two vantage points of the shard.  The codes of ``own`` with
    the same two distances are compared with the stretches whose distances both differ by at most
    ``radius``; guests are never compared with guests.
    """
    codes = np.concatenate([own, guests]).astype(np.uint64)
    if len(own) == 0 or len(codes) < 2:
        return np.empty((0, 2), dtype=np.uint64)
    first = own.astype(np.uint64)[0]
    second = first ^ np.uint64(0xAAAAAAAAAAAAAAAA)  # half the bits away
    d1, d2 = (np.bitwise_count(codes ^ v).astype(np.int64) for v in (first, second))
    key = d1 * 256 + d2 + 64  # 64 keeps d2 - radius in its row
    order = np.argsort(key, kind="stable")
    codes, key = codes[order], key[order]
    mine = np.nonzero(order < len(own))[0]  # places of own codes, in order
    met = np.arange(len(codes)) if among else np.nonzero(order >= len(own))[0]
    met_code, met_key = codes[met], key[met]
    root = np.arange(len(codes))

    def roots(at: np.ndarray) -> np.ndarray:
        top = root[at]
        while not np.array_equal(up := root[top], top):
            top = up
        root[at] = top
        return top

    def root_of(i: int) -> int:
        while root[i] != i:
            i = int(root[i])
        return i

    cells = np.concatenate([np.nonzero(np.concatenate([[True], key[mine][1:] != key[mine][:-1]]))[0], [len(mine)]])
    for a, b in zip(cells[:-1].tolist(), cells[1:].tolist()):
        at = int(key[mine[a]])
        for e in range(-radius, radius + 1):
            lo, hi = np.searchsorted(met_key, [at + 256 * e - radius, at + 256 * e + radius + 1])
            for c in range(int(lo), int(hi), 8192):
                up = min(c + 8192, int(hi))
                for r in range(a, b, 256):
                    rows = mine[r : min(r + 256, b)]
                    i, j = np.nonzero(np.bitwise_count(codes[rows][:, None] ^ met_code[None, c:up]) <= radius)
                    x, y = roots(rows[i]), roots(met[j + c])
                    new = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[x != y], axis=0)
                    for p, q in new.tolist():
                        p, q = root_of(p), root_of(q)
                        root[max(p, q)] = min(p, q)
    ends = roots(np.arange(len(codes)))
    moved = np.nonzero(ends != np.arange(len(codes)))[0]
    return np.stack([codes[moved], codes[ends[moved]]], axis=1)


def links(fps: DataFrame, radius: int = 4, levels: int = 3, count: int = 4, chunk: int = 1 << 15) -> DataFrame:
    """Spanning edges (a, b) of all links between distinct fingerprints (column ``fp``).

    A pair meets in the larger of its two shards, so each pair is compared once.  A shard is compared by
    tiles, one chunk of its own fingerprints with itself, with another of its own or with one of its
    guests, so that no task holds more than about two chunks, whatever lies in the shard; the number of tiles
    follows the data.  A further level saves about a quarter of the comparisons and triples the copies.
    """
    cuts = bands(fps, levels, count)
    home, touched = F.lit(0).cast("long"), F.array(F.lit(0).cast("long"))
    for level, cut in enumerate(cuts):
        d = distance(F.col("fp"), level)
        home = home * count + _band(d, cut)
        touched = _extend(touched, F.sequence(_band(d - radius, cut), _band(d + radius, cut)), count)
    spread = fps.select("fp", home.alias("home"), F.explode(touched).alias("shard")).where("shard >= home")
    spread = spread.select("shard", "fp", (F.col("shard") == F.col("home")).alias("own"))
    sizes = spread.groupBy(F.col("shard").alias("_s")).agg(F.count(F.when(F.col("own"), 1)).alias("mine"), F.count(F.when(~F.col("own"), 1)).alias("others"))
    chunks = lambda n: F.ceil(F.col(n) / F.lit(chunk)).cast("int")
    # A shard without own fingerprints has no links.
    sizes = materialise(sizes.where("mine > 0").select("_s", chunks("mine").alias("m"), chunks("others").alias("g")), "shards")
    at = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    # Tile (row, column): row is a chunk of own fingerprints, column one of own (from row on) or, after those, of guests.
    every = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    place = at("m")
    as_row = F.transform(every(place, F.col("m") + F.col("g") - 1), lambda c: F.struct(place.alias("r"), c.alias("c"), F.lit(True).alias("first")))
    as_column = F.transform(every(F.lit(0), place - 1), lambda r: F.struct(r.alias("r"), place.alias("c"), F.lit(False).alias("first")))
    as_guest = F.transform(every(F.lit(0), F.col("m") - 1), lambda r: F.struct(r.alias("r"), (F.col("m") + at("g")).alias("c"), F.lit(False).alias("first")))
    tiles = F.when(F.col("own"), F.concat(as_row, as_column)).otherwise(as_guest)
    dealt = spread.join(sizes, F.col("shard") == F.col("_s")).select("shard", "fp", F.explode(tiles).alias("t")).select("shard", "t.r", "t.c", "fp", F.col("t.first").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, guests, among = [], [], False
        for b in batches:
            fp, mine = b.column("fp").to_numpy(), b.column("own").to_numpy(zero_copy_only=False)
            own.append(fp[mine])
            guests.append(fp[~mine])
            among = among or (b.num_rows > 0 and b.column("r")[0] == b.column("c")[0])
        pairs = forest(np.concatenate(own).view(np.uint64), np.concatenate(guests).view(np.uint64), radius, among).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.groupBy("shard", "r", "c").applyInArrow(run, "a long, b long")


def rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4, levels: int = 3, count: int = 4, chunk: int = 1 << 15) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp), and per fingerprint (fp, low, root): its smallest id and its component.

    ``root`` is a fingerprint of the component, so components are told apart whatever their ids.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, size), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    comp = components(links(fps.select("fp"), radius, levels, count, chunk)).withColumnsRenamed({"node": "_n", "component": "_c"})
    return rows, materialise(fps.join(comp, fps.fp == comp._n, "left").select("fp", "low", F.coalesce("_c", "fp").alias("root")), "roots")


#: Bands of smallest hashes that name candidate groups, and hashes in a band: of sets that share four fifths, one
#: in 1,600 shares no band.
BANDS, IN_BAND = 14, 4
MULTIPLIERS = np.random.default_rng(2024).integers(0, 1 << 63, (BANDS * IN_BAND, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Candidate sets that are compared in one task at a time.
TILE = 1024


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles; fewer words make one shingle, none an empty set."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    found = [np.empty(0, dtype=np.uint64)]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - size + 1) if words else 0
    for at in range(0, n, CHUNK):
        last = min(at + CHUNK, n)
        found.append(np.unique(np.fromiter((digest(b" ".join(words[i : i + size]), 42) for i in range(at, last)), dtype=np.uint64, count=last - at)))
    return np.unique(np.concatenate(found))


def sketch(shingles: np.ndarray) -> tuple[int, int, list[int]]:
    """A hash of the set, its SimHash, and the keys of its bands (as signed numbers)."""
    if not len(shingles):
        return 0, 0, []
    bits, least = np.zeros(64, dtype=np.int64), np.full(BANDS * IN_BAND, ~np.uint64(0))
    for at in range(0, len(shingles), 8192):
        some = shingles[at : at + 8192]
        bits += np.unpackbits(some.byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (some[None, :] * MULTIPLIERS[:, :1] + MULTIPLIERS[:, 1:]).min(axis=1))
    fp = int.from_bytes(np.packbits(2 * bits > len(shingles)).tobytes(), "big", signed=True)
    sig = int.from_bytes(xxhash.xxh64_digest(shingles.tobytes(), 42), "big", signed=True)
    keys = [int.from_bytes(xxhash.xxh64_digest(least[b * IN_BAND : (b + 1) * IN_BAND].tobytes(), b), "big", signed=True) for b in range(BANDS)]
    return sig, fp, keys


def verified(sigs: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> list[tuple[int, int]]:
    """Spanning links (sig, sig) of the sets that share at least ``similarity`` of their union.

    Sets are ordered by the distance of their fingerprints to a vantage point; a set meets the stretch that
    the triangle bound leaves, then those at most ``radius`` bits away, and then the sets themselves.
    """
    codes = fps.view(np.uint64)
    d = np.bitwise_count(codes ^ codes[0]).astype(np.int64)
    order = np.argsort(d, kind="stable")
    codes, d = codes[order], d[order]
    root = list(range(len(order)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    ends = np.searchsorted(d, d + radius, "right")
    for i in range(len(order)):
        near = i + 1 + np.nonzero(np.bitwise_count(codes[i + 1 : ends[i]] ^ codes[i]) <= radius)[0]
        a = sets[order[i]]
        for j in near.tolist():
            b = sets[order[j]]
            if min(len(a), len(b)) < similarity * max(len(a), len(b)) or find(i) == find(j):
                continue
            common = len(np.intersect1d(a, b, assume_unique=True))
            if common >= similarity * (len(a) + len(b) - common):
                root[find(j)] = find(i)
                out.append((int(sigs[order[i]]), int(sigs[order[j]])))
    return out


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, radius: int = 20) -> tuple[DataFrame, DataFrame]:
    """As :func:`rooted`, with links between texts whose word shingles share at least ``similarity``.

    At such a similarity fingerprints of 64 bits differ by about 10, where a vantage point prunes next to nothing.
    So sets that share a band of smallest hashes make candidate groups, the groups are the shards,
    and inside a shard the vantage point and ``radius`` go before the exact comparison.  A group of more than
    ``TILE`` sets is taken apart by its bands, and what is still larger is compared by tiles of chunks.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sketch(shingle_set(t.as_py(), size)) for t in b.column(1)]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], names=["doc_id", "text_hash", "fp", "code", "keys"])

    text = F.col(text_col).cast("string")
    marked = docs.select(F.col(id_col).alias("doc_id"), text, F.xxhash64(text)).mapInArrow(marks, f"doc_id {kind}, text_hash long, fp long, code long, keys array<long>")
    marked = materialise(marked, "marked")  # ``fp`` is the hash of the set here
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("key")
    sets = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), first, F.first("code").alias("code"), F.first("keys").alias("keys")), "sets")

    banded = sets.select("fp", F.explode("keys").alias("band"))
    shared = materialise(banded.groupBy("band").agg(F.min("fp").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    touching = banded.join(shared, "band")
    groups = materialise(components(touching.where("fp <> centre").select("fp", "centre"), "fp", "centre"), "groups")
    sizes = groups.groupBy(F.col("component").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    sized = groups.join(sizes, groups.component == F.col("_c"))
    apart = sized.where(F.col("_n") > TILE).select(F.col("node").alias("_f"))
    members = sized.where(F.col("_n") <= TILE).select(F.col("component").alias("shard"), F.col("node").alias("fp"))
    members = members.unionByName(touching.join(apart, touching.fp == F.col("_f"), "left_semi").select(F.col("band").alias("shard"), "fp"))
    members = materialise(members, "members")

    # One text of each candidate set gives the set again; the other texts stay where they are.
    some = sets.join(members.select(F.col("fp").alias("_m")).distinct(), F.col("fp") == F.col("_m"), "left_semi")
    some = materialise(some.select(F.col("key.doc_id").alias("_id"), F.col("key.text_hash").alias("_h"), "fp", "code"), "candidates")
    texts = docs.select(F.col(id_col).alias("_i"), text.alias("_t"), F.xxhash64(text).alias("_x"))
    texts = sifted(texts, "_x", sieve(some, "_h")).where("_maybe")
    texts = texts.join(some, texts._x.eqNullSafe(some._h) & texts._i.eqNullSafe(some._id)).select("fp", "code", "_t")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # rows equal in id and text give one set per task
        for b in batches:
            fresh = [i for i, f in enumerate(b.column(0).to_pylist()) if not (f in seen or seen.add(f))]
            packed = [shingle_set(b.column(2)[i].as_py(), size).tobytes() for i in fresh]
            at = pa.array(fresh, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(packed, pa.binary())], names=["fp", "code", "shingles"])

    whole = materialise(texts.mapInArrow(again, "fp long, code long, shingles binary"), "shingles")
    chunks = members.groupBy(F.col("shard").alias("_s")).agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("chunks"))
    dealt = members.join(chunks, members.shard == F.col("_s")).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("long"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))
    dealt = dealt.select("shard", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), F.col("fp").alias("_f"))
    tiled = dealt.join(whole, F.col("_f") == whole.fp).select("shard", "a", "b", "fp", "code", "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, 3):
            at = np.unique(g.column("fp").to_numpy(), return_index=True)[1]
            if len(at) > 1:
                held = [np.frombuffer(g.column("shingles")[i].as_py(), dtype=np.uint64) for i in at.tolist()]
                pairs = verified(g.column("fp").to_numpy()[at], g.column("code").to_numpy()[at], held, similarity, radius)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    tiled = tiled.repartition(partitions(docs.sparkSession), "shard", "a", "b").sortWithinPartitions("shard", "a", "b")
    comp = components(tiled.mapInArrow(check, "a long, b long")).withColumnsRenamed({"node": "_n", "component": "_c"})
    named = sets.join(comp, sets.fp == comp._n, "left").select("fp", "low", F.coalesce("_c", "fp").alias("root"))
    return marked.select("doc_id", "text_hash", "fp"), materialise(named, "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row doc_id, fp and component_id, the smallest id reachable over links of at most ``radius`` bits."""
    rows, named = rooted(docs, id_col, text_col, **options)
    # The component's name is the smallest id of any of its fingerprints: a map-side minimum.
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
    names = materialise(named.join(ids, "root").select(F.col("fp").alias("_fp"), "component_id"), "names")
    return rows.join(names, rows.fp == names._fp).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unique_ids: bool = True, find=rooted, **options) -> DataFrame:
    """The input with one row of each group of near-duplicates: the smallest id, nulls last, then the smallest text hash.

    ``find`` makes the groups: :func:`rooted` by fingerprints, :func:`similar` by shared shingles.

    Rows without an id are told apart by their texts.  With ``unique_ids`` an id names one document: of
    groups whose kept rows repeat an id, one row stays.  Without it each group keeps its row.
    """
    rows, named = find(docs, id_col, text_col, **options)
    keyed = rows.join(named.select(F.col("fp").alias("_fp"), "root"), rows.fp == F.col("_fp"))
    # Minima are taken map-side; no row of a group, however large, is sorted with the others.
    kept = keyed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("key"))
    kept = kept.select(F.col("key.doc_id").alias("_id"), F.col("key.text_hash").alias("_h")).distinct()
    if unique_ids:
        named_ids = kept.where("_id is not null").groupBy("_id").agg(F.min("_h").alias("_h"))
        kept = named_ids.unionByName(kept.where("_id is null"))
    kept = materialise(kept, "kept")
    # A text moves only if its row may have to go or to be told from a row equal in id and text.
    found = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    doubtful = found.join(kept, found.doc_id.eqNullSafe(kept._id) & (found.text_hash == kept._h), "left").where("n > 1 or _h is null")
    texts = F.xxhash64(F.col(text_col).cast("string"))
    out = sifted(docs.withColumn("_text_hash", texts), "_text_hash", sieve(doubtful, "text_hash"))
    # Rows equal in id and text: one of them stays.  Copies go map-side, so none is a hot key of the join.
    moved = out.where("_maybe").dropDuplicates([id_col, "_text_hash"])
    moved = moved.join(kept, moved[id_col].eqNullSafe(kept._id) & (F.col("_text_hash") == kept._h), "left_semi")
    return out.where("not _maybe").select(*[F.col(c) for c in docs.columns]).unionByName(moved.select(*[F.col(c) for c in docs.columns]))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
