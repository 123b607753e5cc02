"""Two-pass shuffle, importance resampling and spelling variants against plain Python."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from almanac.llm import queries, resampling, sharding, spelling
from almanac.session import new_path

SCHEMA = "doc_id long, text string, source string, shard int, slot string, bucket long, h long, row string, word string, n long, rank int, weight double, key string"


def frame(spark, rows):
    """Rows (doc_id, text) with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "s", 3, "x", 1, 2, "r", "w", 5, 6, 0.5, "k") for i, t in rows], SCHEMA)


def corpus(n=300, seed=5):
    rng = np.random.default_rng(seed)
    words = [a + b + c for a in ("thin", "mar", "ol", "Sto") for b in ("é", "an", "ing", "able") for c in ("tion", "ly", "ness", "ûr")]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 60)))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)]


ODD = [(None, None), (None, "nobody nowhere thinking"), (7001, None), (7002, ""), (7003, " \n\t "), (7004, "x" * 70000), (7005, "日本語 text ÀÉÿ×÷ßẞ A\x00B"), (7006, "ab " * 9000), (3, "a second row three"), (7007, "Z"), (7008, "thinking, Thinking; THINKING")]


# --- two-pass shuffle ---------------------------------------------------------------------------------


def spark_hash(seed, key, text):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    if key is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
    if text is not None:
        h = xxhash.xxh64_intdigest(text.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def shuffled_by_hand(rows, buckets, shards, seed=2024):
    """(doc_id, text, shard, slot): buckets in turn, each exchanged from its last place down."""
    parts = defaultdict(list)
    for key, text in rows:
        h = spark_hash(seed, key, text)
        parts[h % buckets].append((h, key, text))
    order = []
    for b in sorted(parts):
        part = sorted(parts[b], key=lambda r: r[0])
        rng = np.random.default_rng([seed, b])
        draws = rng.integers(0, np.arange(len(part), 0, -1))
        for i in range(len(part) - 1, 0, -1):
            j = draws[len(part) - 1 - i]
            part[i], part[j] = part[j], part[i]
        order += part
    n, taken, out = len(order), Counter(), []
    for p, (_, key, text) in enumerate(order):
        s = p * shards // n
        out.append((key, text, s, taken[s]))
        taken[s] += 1
    return out


def test_shuffle_is_the_exchange_of_every_bucket(spark):
    rows = corpus() + ODD
    for parts, size in ((3, 1 << 14), (7, 1 << 14), (2, 1 << 30)):
        docs = frame(spark, rows).repartition(parts)
        got = [(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.write_shards(docs, bucket_bytes=size).collect()]
        total = sum(len((t or "").encode()) + 16 for _, t in rows)
        assert sorted(map(str, got)) == sorted(map(str, shuffled_by_hand(rows, max(8, -(-total // size)), 40)))


def test_shards_are_files_in_slot_order(spark):
    path = new_path(spark, "shards")
    docs = frame(spark, corpus()).withColumn("extra", F.create_map(F.lit("a"), F.col("doc_id")))
    out = sharding.write_shards(docs, shards=3, path=path)
    assert out.columns == [c if c not in ("shard", "slot") else f"{c}_input" for c in docs.columns] + ["shard", "slot"]
    assert {r["shard_input"] for r in out.collect()} == {3} and out.count() == 300
    for s in range(3):
        files = {}
        for r in spark.read.parquet(f"{path}/shard={s}").select("slot", F.input_file_name().alias("f")).collect():
            files.setdefault(r["f"], []).append(r["slot"])
        slots = sorted(x for f in files.values() for x in f)
        assert slots == list(range(100)) and all(f == sorted(f) for f in files.values())


def test_equal_rows_are_spread(spark):
    """A third of all rows are the same: they don't meet in one bucket, and none is lost."""
    rows = corpus(400) + [(5, "one row, again and again")] * 200 + [(None, None)] * 50
    docs = frame(spark, rows).repartition(6)
    got = sharding.write_shards(docs, shards=10).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    assert [sum(r["shard"] == s for r in got) for s in range(10)] == [65] * 10
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(65)) for s in range(10))
    per = Counter(r["shard"] for r in got if r["doc_id"] == 5 and r["text"] and r["text"].startswith("one row"))
    assert len(per) == 10 and max(per.values()) < 60


def test_order_is_uniform():
    """Every order of four rows comes about equally often."""
    seen = Counter(tuple(sharding.exchange_order(4, 1, b).tolist()) for b in range(12000))
    assert len(seen) == 24 and min(seen.values()) > 380 and max(seen.values()) < 620
    assert sharding.exchange_order(0, 1, 1).tolist() == [] and sharding.exchange_order(1, 1, 1).tolist() == [0]


def test_shuffle_of_nothing_and_digest(spark):
    assert sharding.digest(sharding.write_shards(frame(spark, []))).count() == 0
    rows = sharding.digest(sharding.write_shards(frame(spark, ODD))).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    for key, text in ODD:
        if key is not None:
            raw = (text or "").encode()
            assert (by[key]["size"], by[key]["text_crc32"], by[key]["law"], by[key]["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


# --- importance resampling ------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs_by_hand(text, least, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def resampled_by_hand(docs, target, least=1, most=1, buckets=10_000, percent=10, words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    cut = [(i, *runs_by_hand(t, least, most)) for i, t in docs]
    s, t = (Counter(bucket(f) for x in rows for f in x) for rows in ([c[2] for c in cut], [runs_by_hand(x, least, most)[1] for x in target]))
    n, m = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n + buckets) / ((s[b] + 1.0) * (m + buckets))))
    out = []
    for i, count, fs in cut:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append((i, count, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= words), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[3], x[2]))
    drawn = len(able) * percent // 100
    want = [(x[0], *x[2:], k + 1 if k < drawn else None) for k, x in enumerate(able)]
    return want + [(x[0], *x[2:], None) for x in out if x[1] < words]


@pytest.mark.parametrize("least, most, buckets, percent", [(1, 1, 10_000, 10), (1, 2, 500, 50), (2, 3, 70_000, 30)])
def test_resample(spark, monkeypatch, least, most, buckets, percent):
    monkeypatch.setattr(resampling, "STRETCH", 64)  # texts come in many stretches
    rows = corpus() + ODD + [(77, "same id and text " * 9)] * 3 + [(None, "no id at all " * 9)] * 2
    target = [t for _, t in corpus(20, 8)] + [None, "ab ab Ab thinking"]
    aim = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, packed int")
    got = resampling.resample(frame(spark, rows).repartition(5), aim, least=least, most=most, buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = resampled_by_hand(rows, target, least, most, buckets, percent)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_resample_of_nothing(spark):
    aim = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(frame(spark, []), aim).count() == 0
    got = resampling.resample(frame(spark, corpus(40)), aim).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, resampled_by_hand(corpus(40), [])))


def test_split_keeps_words_with_their_places():
    text = "Über-x  a1\x00b\n日本 ẞ"
    found = resampling.splitter().pre_tokenize_str(text)
    assert [(text[a:b], (a, b)) for _, (a, b) in found] == found and [w for w, _ in found] == re.findall(resampling.WORD, text)


# --- spelling variants -----------------------------------------------------------------------------------


def counts_by_hand(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(n):
    form, near = {}, {}
    for w in n:
        others = [x for x in n if one_edit(w, x)]
        near[w] = len(others)
        if others:
            top = min(others, key=lambda x: (-n[x], x))
            if n[top] >= 10 * n[w]:
                form[w] = top
    out = []
    for w in n:
        r = w
        while r in form:
            r = form[r]
        out.append((w, n[w], near[w], form.get(w), n[form[w]] if w in form else None, r))
    return out


def test_variants(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 500)
    monkeypatch.setattr(spelling, "HELD", 40)  # counts are handed on many times
    # A chain of three forms, an insertion beside an equal letter, an edit in every quarter, and accents.
    base = "aabbccddee"
    texts = [" ".join([base] * 2000), " ".join(["aabbccddeee"] * 300), " ".join(["aabbcccddeee"] * 25), "aabbcccddeeez " * 2, "xabbccddee axbbccddee aabbxcddee aabbccddex aabbccddeè " * 3, "abbccddee abbccddee aabbccdde bbccddeea " * 2, "émigrés émigrês émigrés èmigrés emigrés " * 4]
    rows = [(10_000 + i, t) for i, t in enumerate(texts)] + corpus(400) + ODD + [(10_000, texts[0])] * 2
    n = counts_by_hand(rows)
    counted = {r["word"]: r["n"] for r in spelling.word_counts(frame(spark, rows)).where("n >= 2").collect()}
    assert counted == n
    got = spelling.variants(frame(spark, rows).repartition(5))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, variants_by_hand(n)))
    assert {r["word"]: r["root"] for r in got.collect()}["aabbcccddeeez"] == base


def test_near_pairs_of_random_words(spark):
    """A tiny alphabet makes many words one edit apart, with repeated letters everywhere."""
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abé"), int(rng.integers(2, 11)))) for _ in range(900)})
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = [(r["word"], r["other"]) for r in spelling.near_pairs(table).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "short words only"), (3, "onlyonce")])).count() == 0


def test_queries_are_registered():
    assert {"op11_two_pass_shuffle", "op12_importance_resampling", "op13_spelling_chunks"} <= set(queries.QUERIES)
