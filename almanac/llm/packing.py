"""Best-fit packing of tokenised documents, planned on the histogram of their lengths.

The plan looks at counts of lengths only, so its size depends on the sequence length and not on the
number of documents.  It says: of the pieces of length L, those with rank a .. a+n-1 go to the
sequences q .. q+n-1 at one offset.  A piece finds its slot by its length and its rank within it.

Defined results: a null text is an empty one; an empty text is a document of one closing id; an
empty table gives an empty result; rows that repeat an id are packed each for itself; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, partitions

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


#: Ids of runs of characters that a worker has met; kept between its tasks, up to KEPT entries.
KNOWN: dict[str, dict[str, bytes]] = {}
KEPT = 600_000
#: Runs that can be cut into the tokenizer's words here: printable ASCII and the letters of Latin-1,
#: which no normal form changes and whose lower case is a single letter.
SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: printable ones for themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


BYTES = byte_letters()


def encode_run(run: str, known: dict[str, bytes], tokenizer) -> bytes:
    """Ids of one run without spaces.  The model is asked for words it has not met yet; odd runs go through the whole tokenizer."""
    if not SIMPLE.fullmatch(run) or "<|" in run:
        return np.asarray(tokenizer.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()
    out = []
    for part in PARTS.findall(run.lower()):
        ids = known.get(part)
        if ids is None:
            letters = part if part.isascii() else "".join([BYTES[b] for b in part.encode()])
            ids = known[part] = array("I", [t.id for t in tokenizer.model.tokenize(letters)]).tobytes()
        out.append(ids)
    return b"".join(out)


def tokenised(text: str, known: dict[str, bytes], tokenizer) -> bytes:
    """The text's ids as little-endian unsigned 32-bit numbers, for a tokenizer of lower-cased byte-level words.

    The tokenizer never joins characters across white space, so each distinct run between spaces is
    encoded once per worker and then looked up.
    """
    words = text.replace("\n", " ").split(" ")
    try:
        return b"".join([known[w] for w in words])
    except KeyError:
        if len(known) > KEPT:
            known.clear()
    out = []
    for w in words:
        ids = known.get(w)
        if ids is None:
            ids = known[w] = encode_run(w, known, tokenizer) if w else b""
        out.append(ids)
    return b"".join(out)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; only documents above the capacity are cut."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer, known = Tokenizer.from_file(tokenizer_path), KNOWN.setdefault(tokenizer_path, {})
        tail = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            which, no, start, length, crc = [], [], [], [], []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                ids = memoryview(tokenised(texts[i].as_py() or "", known, tokenizer) + tail)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    which.append(i)
                    no.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(no, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES.format(id=kind.simpleString()))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) of best-fit on decreasing lengths.

    Sequences with the same free room form ranges; the longest pieces go first, each to the range
    with the least room that holds it, a whole range at a time.  Work and result depend on the
    number of ranges, which the capacity bounds, not on the counts.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free room -> ranges (first sequence, count)
    heap_of: list[int] = []  # sorted list of rooms in use
    out, sequences = [], 0

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                i = int(np.searchsorted(heap_of, free)) if heap_of else 0
                heap_of.insert(i, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        fresh: list[tuple[int, int, int]] = []
        while left:
            i = int(np.searchsorted(heap_of, length)) if heap_of else 0
            if i == len(heap_of):
                # Nothing holds it: open sequences and fill each with as many as fit.
                each = capacity // length
                full = left // each
                for k in range(each if full else 0):
                    out.append((length, rank + k * full, full, sequences, k * length))
                if full:
                    put(capacity - each * length, sequences, full)
                    sequences, rank, left = sequences + full, rank + each * full, left - each * full
                if left:
                    for k in range(left):
                        out.append((length, rank + k, 1, sequences, k * length))
                    put(capacity - left * length, sequences, 1)
                    sequences, left = sequences + 1, 0
                break
            free = heap_of[i]
            first, n = room[free].pop()
            if not room[free]:
                del room[free]
                heap_of.pop(i)
            used = min(n, left)
            out.append((length, rank, used, first, capacity - free))
            put(free - length, first, used)
            put(free, first + used, n - used)
            rank, left = rank + used, left - used
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", parts: DataFrame | None = None) -> DataFrame:
    """Per piece its sequence and its place in it; see the module's text.

    The driver receives one count per length, at most ``capacity`` rows.  Ranks are taken within
    (length, salt) and shifted by the counts of the salts before, so that a length shared by a third
    of all pieces is spread over all tasks.
    """
    spark = docs.sparkSession
    parts = materialise(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces") if parts is None else parts
    salts = max(8, min(1024, partitions(spark)))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    cells = materialise(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "lengths")  # at most capacity * 1024 rows
    counts = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("n")).collect()}
    runs = sorted(best_fit(counts, capacity))
    key = np.asarray([[a, b] for a, b, *_ in runs], dtype=np.int64).reshape(-1, 2)
    at = (key[:, 0] << 44) + key[:, 1]
    seq, off = (np.asarray([r[i] for r in runs], dtype=np.int64) for i in (3, 4))
    plan = spark.sparkContext.broadcast((at, key[:, 1], seq, off))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = cells.select(F.col("length").alias("_l"), F.col("salt").alias("_t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
    ranked = ranked.join(shift, (ranked.length == shift._l) & (ranked.salt == shift._t))
    ranked = ranked.select(*parts.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, first, seq, off = plan.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            i = np.searchsorted(starts, (length << 44) + rank, side="right") - 1
            columns = [b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(seq[i] + rank - first[i]), pa.array(off[i])], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
