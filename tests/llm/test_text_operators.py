"""Mixing, packing, personal data, licences, repeats, SimHash and toxicity against plain Python."""

import hashlib
import inspect
import os
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
import zstandard
from tokenizers import Tokenizer

from almanac.llm import licences, mixing, packing, pii, repeats, simhash, toxicity
from almanac.llm.common import sieve, sifted

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, size int, h string, component_id string"
ODD = [None, "", " \n\t ", "a", "MIT License", "naïve Ünïcode 日本語 text", "x" * 5000, "tab\tand\x0bfeed"]


def frame(spark, rows, schema=SCHEMA):
    """Rows (doc_id, text[, source]) with extra columns whose names clash with those the operators use."""
    rows = [(*r, *["s1"][: 3 - len(r)]) for r in rows]
    return spark.createDataFrame([(i, t, s, 7, "h", "c") for i, t, s in rows], schema)


# --- mixing -----------------------------------------------------------------------------------------


def mix_by_hand(rows, weights=(3, 1, 2)):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = Counter()
    for (_, _, s), n in zip(rows, sizes):
        total[s] += n
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    whole, target, free = 1.5 * sum(sizes), {}, set(names)
    while free:
        level = (whole - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in over} if over else {s: level * weight[s] for s in free}
        free = free - over if over else set()
    return sizes, total, target


def test_mix(spark):
    rows = [(i, "w " * (i % 40), f"src{i % 5}" if i % 7 else None) for i in range(400)] + [(None, "no id", "src1"), (3, "w w w", "src3"), (5, None, "only null")]
    got = mixing.mix(frame(spark, rows)).collect()
    sizes, total, target = mix_by_hand(rows)
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in total:
        assert abs(taken[s] - target[s]) <= 40
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    docs = frame(spark, rows)
    out = mixing.apply(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)


def test_thresholds_are_nested(spark):
    docs = spark.range(3000).selectExpr("'s' as source", "(id * 7919) % 68719476736 as h", "id % 13 as size")
    cuts = mixing.thresholds(docs, spark.createDataFrame([("s", float(b)) for b in (10, 500, 9000)], "source string, budget double")).orderBy("budget").collect()
    below = [r["below"] for r in cuts]
    assert below == sorted(below)
    for r in cuts:
        assert abs(docs.where(docs.h < r["below"]).agg({"size": "sum"}).first()[0] - r["budget"]) <= 13


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]


# --- packing ----------------------------------------------------------------------------------------


def check_packed(rows, expect, capacity):
    sequences = {}
    by_doc = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    assert {k: sorted(v) for k, v in by_doc.items()} == expect
    return len(sequences)


def test_pack(spark):
    rows = [(i, "word " * (i * 37 % 90)) for i in range(150)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, "don't <|endoftext|> STOP's é " * 40)]
    tokenizer, capacity, expect, total = Tokenizer.from_file(TOKENIZER), 64, {}, 0
    for i, t in rows:
        ids = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        total += len(ids)
        expect[i] = [(k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    got = packing.pack(frame(spark, rows), TOKENIZER, capacity).collect()
    assert check_packed(got, expect, capacity) <= -(-total // capacity) * 1.05 + 1


def test_pack_repeated_rows_and_nothing(spark):
    got = packing.pack(frame(spark, [(1, "a b c")] * 50 + [(None, None)]), TOKENIZER, 8).collect()
    assert len(got) == 51 and len({(r["sequence_id"], r["offset"]) for r in got}) == 51
    assert packing.pack(frame(spark, []), TOKENIZER).count() == 0


def test_best_fit_uses_few_sequences():
    rng = np.random.default_rng(5)
    for capacity, n in ((20, 500), (4096, 4000)):
        lengths = rng.integers(1, capacity + 1, n)
        runs = packing.best_fit({int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}, capacity)
        fill = Counter()
        for length, _, count, first, _ in runs:
            for q in range(first, first + count):
                fill[q] += length
        assert max(fill.values()) <= capacity and sum(fill.values()) == lengths.sum()
        assert len(fill) <= 1.12 * max(-(-lengths.sum() // capacity), (2 * lengths > capacity).sum())


# --- personal data ----------------------------------------------------------------------------------


def luhn(d):
    total = 0
    for i, c in enumerate(map(int, reversed(d))):
        total += c if i % 2 == 0 else (2 * c - 9 if 2 * c > 9 else 2 * c)
    return total % 10 == 0


def base_by_hand(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


TEXTS = [
    "mail a.b@c.de_x@y.org or x@y then b@q@r.st, end a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111111111",
    "call +1 (499) 555-6503. or +12 345 or +1+2 345 6789 0", "é😀 x@y.zz 😀 10.0.0.1 ñ +49 30 1234567", "5500005555555559 ab4111111111111111cd", "1 " * 40, "a" * 300 + "@" + "b" * 300, "@@@ ... +++",
    "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and note: nothing here", "9" * 4000 + ".1.1.1",
]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(0, TEXTS[0]), (0, "other text 1.1.1.1"), (None, "x@y.zz")]
    got = pii.digest(pii.find(frame(spark, rows))).collect()
    want = []
    for i, t in rows:
        s = ",".join(f"{k}:{a}:{b}" for k, a, b in base_by_hand(t or ""))
        n = Counter(k for k, *_ in base_by_hand(t or ""))
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(s.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))


def test_bootstrap_finds_unseen_values(spark):
    seeds = [(i, f"text token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" more words: plenty") for i in range(30)]
    seeds += [(100 + i, f"words: w{i}ord and title: thing{chr(97 + i % 26)}") for i in range(30)]
    found = pii.digest(pii.find(frame(spark, [*seeds, (500, "here token = \"abcd-77\" ends"), (501, "words: secret")]))).collect()
    spans = {r["doc_id"]: r["spans"] for r in found}
    assert spans[500] == "secret:14:21" and spans[501] == "" and spans[100] == ""
    text = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, [*seeds, (500, "here token = \"abcd-77\" ends"), (600, None), (601, "a@b.cc, 1.1.1.1")])).collect()}
    assert text[500] == "here token = \"[SECRET]\" ends" and text[600] is None and text[601] == "[EMAIL], [IP]"


def test_long_secrets_and_keys_are_whole(spark):
    seeds = [(i, f"text token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" more {'k' * 60}: {hashlib.md5(str(i).encode()).hexdigest()}") for i in range(30)]
    long = "aB3" * 400
    text = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, [*seeds, (500, f"a token = \"{long}\" b"), (501, f"{'k' * 60}: abc-77 c")])).collect()}
    assert text[500] == "a token = \"[SECRET]\" b" and text[501] == f"{'k' * 60}: [SECRET] c"


def test_contexts_in_running_text(spark):
    rows = [(i, f"bring passport number {hashlib.sha1(str(i).encode()).hexdigest()[:24]}z9 along or call me on +49 30 {1234567 + i} today") for i in range(40)]
    rows += [(100 + i, f"chapter numbered {10000 + i} follows") for i in range(40)]
    rows += [(500, "your passport number X1234567, please"), (501, "call me on 8841-22"), (502, "chapter numbered 20000 follows"), (503, "nothing but passport number and call me on monday"), (504, "call me on 4111111111111112")]
    spans = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(frame(spark, rows))).collect()}
    assert spans[500] == "secret:21:29" and spans[501] == "secret:11:18" and spans[502] == spans[503] == spans[504] == spans[100] == ""


def values_by_hand(text):
    """Places (patterns, value, start, end): keys with their marks, and the words around values in running text."""
    keyed = []
    for m in regex.finditer(r"(?<![A-Za-z0-9_-])([A-Za-z][A-Za-z0-9_-]*+ {0,2}+[=:] {0,2}+[\"']?+)[^\s\"',;=:]{3,}+", text):
        keyed.append(([re.sub(" +", " ", m.group(1)).lower()], text[m.end(1) : m.end()], m.end(1), m.end()))
    kinds = [r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"\+[0-9][ ().0-9-]+[0-9]", r"[0-9](?:[ -]?[0-9]){15,}+"]
    found = list(regex.finditer("|".join([*kinds, r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{5,}+"]), text))
    edges = [0, *[e for m in found for e in m.span()], len(text)]
    words = [[w for w in regex.split(r"[^\p{L}]+", text[a:b].lower()) if w] for a, b in zip(edges[::2], edges[1::2])]
    prose = []
    for i, m in enumerate(found):
        last, first = words[i][-3:], words[i + 1][:3]
        near = ["before " + " ".join(last[-n:]) for n in range(1, len(last) + 1)] + ["after " + " ".join(first[:n]) for n in range(1, len(first) + 1)]
        if not any(a < m.end() and m.start() < b for *_, a, b in keyed):
            prose.append((near, m.group(), *m.span()))
    return keyed + prose


def learned_by_hand(texts, rounds=3):
    """All learned spans by text: three rounds over the graph of patterns and values in plain Python."""
    seeds, edges, at = {}, set(), {}
    for t in texts:
        base = base_by_hand(t)
        at[t] = [(p, v, a, b, any(c < b and a < d for _, c, d in base)) for p, v, a, b in values_by_hand(t)]
        for near, v, *_, crosses in at[t]:
            mixed = re.search("[0-9]", v) and re.search("[A-Za-z]", v) and " " not in v
            for p in near:
                edges.add((p, v))
                seeds[p, v] = max(seeds.get((p, v), 0.0), float(bool(crosses or (mixed and len(v) >= 20))))
    conf = dict(seeds)
    for i in range(rounds):
        of = {p: [conf[e] for e in edges if e[0] == p] for p in {p for p, _ in edges}}
        trust = {p: sum(c) / (len(c) + 2.0) for p, c in of.items()}
        if i < rounds - 1:
            best = {v: max(trust[p] for p, w in edges if w == v) for v in {v for _, v in edges}}
            conf = {(p, v): max(c, best[v]) for (p, v), c in conf.items()}
    trusted = {p for p, c in trust.items() if c >= (0.6 if re.search("[=:]", p) else 0.8)}
    form = regex.compile(pii.FORM)
    return {t: sorted({(a, b) for near, v, a, b, crosses in places if not crosses and any(p in trusted and (re.search("[=:]", p) or not form.search(v)) for p in near)}) for t, places in at.items()}


def test_learned_spans_by_hand(spark):
    rng = np.random.default_rng(5)
    parts = ["passport number {}", "call me on {}", "token = \"{}\"", "id: {} ", "section {} follows", "write to {} today,", "plain words only", "host={} é"]
    values = [lambda i: hashlib.sha1(str(i).encode()).hexdigest(), lambda i: f"AB{i % 40}-{i % 7}xyz", lambda i: f"+49 30 {1000000 + i}", lambda i: f"u{i}@mail.org", lambda i: f"10.0.{i % 300}.7", lambda i: f"{10000 + i % 50}"]
    likely = {0: 0, 1: 2, 2: 0, 3: 1, 4: 5, 5: 3, 6: 0, 7: 4}
    rows = []
    for i in range(250):
        picks = rng.integers(0, len(parts), 3)
        rows.append((i, " ".join(parts[p].format(values[likely[p] if rng.random() < 0.93 else int(rng.integers(6))](int(rng.integers(1000)))) for p in picks)))
    rows += [(900 + i, t) for i, t in enumerate(TEXTS)]
    want = learned_by_hand({t for _, t in rows})
    got = {r["doc_id"]: sorted((x["start"], x["end"]) for x in r["learned"]) for r in pii.find(frame(spark, rows).repartition(4)).collect()}
    assert got == {i: want[t] for i, t in rows} and sum(map(len, want.values())) > 20


def test_a_very_long_text_with_many_values(spark):
    n = 20000
    text = " ".join(f"u{i}@mail.org token={f'{i:05d}abcdef' * 3} é 10.1.2.{i % 300}" for i in range(n))
    docs = frame(spark, [(1, text), (2, None)])
    row = next(r for r in pii.digest(pii.find(docs)).collect() if r["doc_id"] == 1)
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_by_hand(text)).encode()).hexdigest()
    redacted = next(r["text"] for r in pii.redact(docs).collect() if r["doc_id"] == 1)
    assert redacted == " ".join("[EMAIL] token=[SECRET] é " + ("[IP]" if i % 300 < 256 else f"10.1.2.{i % 300}") for i in range(n))


def test_no_texts_no_spans(spark):
    assert pii.find(frame(spark, [])).count() == 0
    docs = frame(spark, [(1, "plain"), (1, "plain")])
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == 2


# --- licences ---------------------------------------------------------------------------------------


def test_licences(spark):
    notice = dict((label, text) for label, text in licences.NOTICES)
    rows = [(i, t) for i, t in enumerate(ODD)] + [
        (100, "Foo mit. License, MIT-license; gnu General Public license apache LICENSE"), (101, "pre " * 500 + notice["bsd"].upper() + " post"),
        (102, "Licensed under CC BY-NC 4.0."), (103, notice["mpl"].replace("subject", "now subject", 1)), (104, "mit public license general"), (101, "repeated id"), (None, "the mit license"),
    ]
    got = licences.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(n, label) for p, label in licences.PHRASES.items() for n in range(len(w)) if w[n : n + len(p.split())] == p.split()]
        r = by[i, len(w)]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(at), min([n for n, _ in at], default=None), max([n for n, _ in at], default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    label = {r["doc_id"]: r["labels"] for r in got if r["n_words"] != 2}
    assert "bsd" in label[101] and label[102] == "cc-by-nc" and label[103] == "mpl" and label[104] == ""
    assert licences.scan(frame(spark, [])).count() == 0


# --- repeats ----------------------------------------------------------------------------------------


def cut_by_hand(rows, size):
    low = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            low.setdefault(b[i : i + size], repeats.LAST if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if low[b[i : i + size]] < (repeats.LAST if d is None else d):
                gone[i : i + size] = b"\x01" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeats(spark, hot):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcé"), 7))
    passages = [" ".join(word() for _ in range(n)) for n in (8, 12, 30)]
    rows = [(int(i), " ".join(word() for _ in range(6)) + passages[i % 3] + (" " + passages[(i + 1) % 3][5:] if i % 4 else "") + word()) for i in rng.permutation(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(200, "ab" * 200), (201, "x" + "ab" * 60), (202, "a" * 49), (203, "a" * 50), (204, "a" * 51), (7, rows[3][1]), (7, "new " + rows[4][1]), (None, rows[9][1]), (None, rows[9][1])]
    got = repeats.digest(repeats.remove_repeats(frame(spark, rows).repartition(5), texts=False, hot=hot)).collect()
    assert sorted(str(tuple(r)) for r in got) == cut_by_hand(rows, 50)


def test_repeats_shuffle_the_texts_once(spark):
    rows = [(i, f"{i} " + "a passage that stands in several of the documents, here and there " * (i % 3)) for i in range(30)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = repeats.digest(repeats.remove_repeats(frame(spark, rows), texts=False))
        assert sorted(str(tuple(r)) for r in got.collect()) == cut_by_hand(rows, 50)
        assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_anchor_with_the_most_contexts_fits_a_worker():
    n = inspect.signature(repeats.remove_repeats).parameters["hot"].default
    rng = np.random.default_rng(5)
    sides = rng.integers(97, 123, (n, 52), dtype=np.uint8)
    bodies = [bytes(x[:26]) + b"the same anchor of texts" + bytes(x[26:]) for x in sides]
    tracemalloc.start()
    try:
        which, _ = repeats.repeated_windows(bodies, np.arange(n), 50)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not len(which) and most < 300e6


def test_a_batch_of_many_anchors_is_looked_at_in_portions():
    batch = lambda h: pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "n": pa.array(range(len(h)), pa.int64())})
    h = sorted([*range(40), *[7] * 9, *[39] * 3, *[40] * 5])
    for sizes in ([57], [20, 20, 17], [1] * 57):
        cut = np.cumsum([0, *sizes]).tolist()
        got = [b.column("h").to_pylist() for b in repeats.whole_anchors((batch(h[a:z]) for a, z in zip(cut, cut[1:])), 4)]
        assert [x for part in got for x in part] == h
        assert all(set(a).isdisjoint(b) for i, a in enumerate(got) for b in got[:i])
        assert all(len([x for x in part if x != part[-1]]) < 4 for part in got)


def test_hot_windows_are_handed_on_in_portions(monkeypatch):
    monkeypatch.setattr(repeats, "PORTION", 100)
    text = bytes(np.random.default_rng(6).integers(97, 123, 400, dtype=np.uint8))
    _, _, _, _, c = next(repeats.anchors_of([text]))
    marks = (c >> repeats.CONTEXT_SHIFT).astype("<u8").tobytes()
    batch = pa.RecordBatch.from_pydict({"key": [3], "z": [zstandard.ZstdCompressor().compress(text)], "kinds": [[repeats.HOT]], "blobs": [[marks]]})
    found = list(repeats.wanted_contexts(iter([batch]), repeats.HOT, 50, 24))
    rows = iter([(doc, p) for doc, _, _, body in found for p in range(len(body) - 49)])
    got = [b.num_rows for b in repeats.in_portions(rows, ["doc", "place"], [pa.int64(), pa.int64()])]
    assert sum(got) == len(text) - 49 and max(got) == 100
    assert not list(repeats.wanted_contexts(iter([batch]), repeats.CONTEXT, 50, 24))


def test_repeat_groups(spark):
    bodies = [(7, 1, 10, b"x" * 3 + b"abcdefghij" + b"1"), (7, 2, 20, b"y" + b"abcdefghij" + b"22"), (7, 3, 30, b"cdefghij3"), (9, 4, 40, b"zzzzzzzz")]
    contexts = spark.createDataFrame([(*r, None) for r in bodies], "h long, doc long, c long, body binary, place int")
    got = {}
    for r in repeats.repeat_groups(contexts, 8).collect():
        assert r["size"] == len(r["text"])
        got.setdefault(bytes(r["text"]), set()).add((r["doc"], r["c"], r["place"]))
    assert got == {b"abcdefghij": {(1, 10, 3), (2, 20, 1)}, b"cdefghij": {(1, 10, 5), (2, 20, 3), (3, 30, 0)}}


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(frame(spark, [])).count() == 0
    one = repeats.remove_repeats(frame(spark, [(1, "a" * 60), (2, "b" + "a" * 60)])).orderBy("doc_id").collect()
    assert [bytes(r["kept"]) for r in one] == [b"a" * 60, b"b"] and [tuple(s) for s in one[1]["spans"]] == [(1, 61)]


def test_long_texts_are_worked_in_parts(monkeypatch):
    from almanac.llm import anchors

    rng = np.random.default_rng(1)
    data = bytes(rng.integers(97, 101, 9000, dtype=np.uint8))
    whole = anchors.anchors(data)
    monkeypatch.setattr(anchors, "CHUNK", 1000)
    parts = anchors.anchors(data)
    for h, first, last, _ in (whole, parts):
        assert first[0] == 0 and last[-1] == len(data) - 50 and (first[1:] == last[:-1] + 1).all()
    anchor = lambda a: np.repeat(a[0], a[2] - a[1] + 1)
    assert (anchor(whole) == anchor(parts)).all()


def test_short_texts_are_worked_together(monkeypatch):
    from almanac.llm import anchors

    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in rng.integers(0, 400, 500).tolist()]
    texts += [texts[7][:50], b"", bytes(rng.integers(97, 101, 5000, dtype=np.uint8))] + texts[:20]
    calls = []
    plain = anchors.gram_hashes
    monkeypatch.setattr(anchors, "gram_hashes", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(anchors, "CHUNK", 3000)  # the longest text is worked in parts
    wanted = [i % 5 > 0 for i in range(len(texts))]
    got = list(anchors.anchors_of(iter(texts), wanted=wanted))
    assert len(calls) < len(texts) / 4
    assert [x[0] for x in got] == texts
    for (_, *found), text, want in zip(got, texts, wanted):
        alone = anchors.anchors(text if want else b"")
        assert all(a.tolist() == b.tolist() for a, b in zip(found, alone))
        assert int((found[2] - found[1] + 1).sum()) == (max(0, len(text) - 49) if want else 0)


def test_equal_contexts_have_equal_hashes():
    from almanac.llm import anchors

    rng = np.random.default_rng(6)
    for _ in range(50):
        data = bytes(rng.integers(97, 123, 300, dtype=np.uint8))
        _, first, last, c = anchors.anchors(data)
        for a, z, x in zip(first.tolist(), last.tolist(), c.tolist()):
            assert anchors.anchors(data[a : z + 50])[3].tolist() == [x]  # alone the context is the whole text


def test_suffixes_too_short_for_a_repeat_are_not_sorted():
    rng = np.random.default_rng(8)
    for _ in range(200):
        texts = [bytes(rng.choice(list(b"ab\0"), rng.integers(0, 30)).tolist()) for _ in range(rng.integers(1, 6))]
        shortest, depth = int(rng.integers(1, 6)), int(rng.integers(6, 40))
        symbols, which, offset, left = repeats.join_texts(texts)
        order, common = repeats.enhanced_suffix_array(symbols, left, depth, shortest)
        assert sorted(order.tolist()) == np.nonzero(left >= shortest)[0].tolist()
        suffix = [texts[which[p]][offset[p] :] for p in order]
        for a, b, n in zip(suffix, suffix[1:], common[1:].tolist()):
            same = len(os.path.commonprefix([a, b]))
            assert a[:depth] <= b[:depth] and min(n, depth) == min(same, depth) and n <= same
    none = repeats.enhanced_suffix_array(*(repeats.join_texts([b"ab"])[i] for i in (0, 3)), 5, 5)
    assert [len(x) for x in none] == [0, 0] and repeats.interval_tree([b"ab"], 5) == []


def test_interval_tree():
    rng = np.random.default_rng(2)
    for _ in range(200):
        texts = [bytes(rng.choice(list(b"ab"), rng.integers(0, 13)).tolist()) for _ in range(rng.integers(1, 4))]
        least, seen = int(rng.integers(1, 4)), {}
        for a, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(i + least, len(t) + 1):
                    seen.setdefault(t[i:j], []).append((a, i))
        want = []
        for w, at in seen.items():
            left = {texts[a][i - 1] if i else ("start", a) for a, i in at}
            right = {texts[a][i + len(w)] if i + len(w) < len(texts[a]) else ("end", a) for a, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.append((len(w), sorted(at)))
        assert sorted((n, sorted(at)) for n, at in repeats.interval_tree(texts, least)) == sorted(want)


# --- SimHash ----------------------------------------------------------------------------------------


def fingerprint_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components_by_hand(rows, radius):
    fp = [fingerprint_by_hand(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    low = {}
    for (d, _), g in zip(rows, group):
        low[g] = d if low.get(g) is None else min(low[g], d) if d is not None else low[g]
    return [(d, f"{f:016x}", low[g]) for (d, _), f, g in zip(rows, fp, group)]


def test_simhash(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    base = [list(rng.choice(words, 300)) for _ in range(12)]
    rows = []
    for i in range(90):
        t = list(base[i % 12])
        for _ in range(i % 4):
            t[int(rng.integers(300))] = str(rng.choice(words))
        rows.append((i, " ".join(t)))
    rows += [(200 + i, t) for i, t in enumerate(ODD)] + [(3, rows[4][1]), (3, rows[4][1]), (None, rows[0][1]), (None, "quite alone here with words")]
    got = simhash.digest(simhash.near_duplicates(frame(spark, rows).repartition(4))).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, components_by_hand(rows, 4)))
    tiles = simhash.digest(simhash.near_duplicates(frame(spark, rows).repartition(4), chunk=3)).collect()
    assert sorted(map(str, tiles)) == sorted(map(str, got))
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert len(kept) == len({c for *_, c in components_by_hand(rows, 4)})
    monkeypatch.setattr(simhash, "CHUNK", 16)
    assert all(simhash.fingerprint(t) % 2**64 == fingerprint_by_hand(t) for _, t in rows)


def test_keep_one_keeps_unrelated_texts(spark):
    rng = np.random.default_rng(11)
    text = [" ".join(rng.choice([f"w{i}" for i in range(300)], 80)) for _ in range(12)]
    rows = [(None, t) for t in text[:6]] + [(None, text[0]), (None, text[1]), (7, text[6]), (7, text[7]), (7, text[7]), (8, text[1]), (9, text[8])]
    assert len({c for c in map(fingerprint_by_hand, text)}) == 12
    got = sorted(map(str, ((r["doc_id"], r["text"]) for r in simhash.keep_one(frame(spark, rows).repartition(3), unique_ids=False).collect())))
    want = [(None, t) for i, t in enumerate(text[:6]) if i != 1] + [(8, text[1]), (7, text[6]), (7, text[7]), (9, text[8])]
    assert got == sorted(map(str, want))
    got = [r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [None] * 5 + [7, 8, 9]))


def test_sieve_misses_nothing(spark):
    keys = [0, 1, -1, 32767, 32768, 2**63 - 1, -(2**63), 2**25, 77]
    held = sieve(spark.createDataFrame([(k,) for k in keys], "h long"), "h")
    rows = spark.createDataFrame([(k,) for k in [*keys, *range(500, 700), None]], "x long")
    got = [(r["x"], r["_maybe"]) for r in sifted(rows, "x", held).collect()]
    assert len(got) == len(keys) + 201 and {x for x, ok in got if ok} == set(keys)
    small = sieve(spark.createDataFrame([(k,) for k in keys], "h long"), "h", 64)
    got = {r["x"]: r["_maybe"] for r in sifted(rows, "x", small, 64).collect()}
    assert all(got[x] == (x is not None and x % 64 in {k % 64 for k in keys}) for x in got)


def test_only_doubtful_texts_move(spark, monkeypatch):
    rng = np.random.default_rng(13)
    text = [" ".join(rng.choice([f"w{i}" for i in range(300)], 80)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(text)] + [(100, text[3]), (4, text[4]), (None, text[5]), (None, text[6]), (None, "alone here"), (None, "alone here"), (101, None), (102, "")]
    want = sorted(map(str, [*enumerate(text), (None, "alone here"), (101, None)]))
    for find in (simhash.rooted, simhash.similar):
        out = simhash.keep_one(frame(spark, rows).repartition(3), unique_ids=False, find=find)
        plan = out._jdf.queryExecution().optimizedPlan()
        assert plan.nodeName() == "Union"
        stay, go = (plan.children().apply(i).toString() for i in range(2))
        assert "Aggregate" not in stay and "LeftSemi" not in stay and "Aggregate" in go and "LeftSemi" in go
        assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == want
    # Bits that nearly all hashes share: every text moves, the rows are the same.
    monkeypatch.setattr(simhash, "sieve", lambda keys, col: sieve(keys, col, 4))
    monkeypatch.setattr(simhash, "sifted", lambda df, col, maps: sifted(df, col, maps, 4))
    assert sorted(str((r["doc_id"], r["text"])) for r in simhash.keep_one(frame(spark, rows).repartition(3), unique_ids=False, find=simhash.similar).collect()) == want


def test_forest_links_what_is_near():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 2**63, 400, dtype=np.uint64)
    codes[200:300] = codes[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    codes[300:] = codes[200] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    codes = np.unique(codes)
    pairs = simhash.forest(codes[: len(codes) // 2], codes[len(codes) // 2 :], 4)
    assert len(pairs) < len(codes)
    parent = {int(c): int(c) for c in codes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        parent[root(a)] = root(b)
    half = len(codes) // 2
    apart = simhash.forest(codes[:half], codes[half:], 4, among=False)
    inside = [(a, b) for a in codes[:half].tolist() for b in codes[half:].tolist() if bin(a ^ b).count("1") <= 4]
    assert {int(x) for p in apart for x in p} == {x for p in inside for x in p}
    own = set(codes[: len(codes) // 2].tolist())
    for a in codes.tolist():
        for b in codes.tolist():
            if (a in own or b in own) and bin(a ^ b).count("1") <= 4:
                assert root(a) == root(b)


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert [r["component_id"] for r in simhash.near_duplicates(frame(spark, [(5, None), (4, "")])).collect()] == [4, 4]


# --- toxicity ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def learned(spark):
    rng = np.random.default_rng(8)
    words = [a + b for a in ("th", "er", "ou", "lin", "mar", "sto") for b in ("an", "ing", "es", "ly", "ed")]
    rows, labels = [], []
    for i in range(600):
        t = list(rng.choice(words, 40))
        toxic = i % 6 == 0
        if toxic:
            t[3], t[9] = str(rng.choice(["idiot", "moron", "loser"])), str(rng.choice(["idiot", "moron", "loser"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic), 1))
    labels += [(1, None, 0), (2, 7, 0), (None, 1, 0), (0, 0, 1)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, text int")


def test_toxicity(spark, learned):
    docs, labels = learned
    model = toxicity.fit(docs, labels)
    for hidden, word in (("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooot", "idiot"), ("m0r0n", "moron"), ("l0$er", "loser"), ("iidiot", "idiot")):
        assert word in toxicity.readings(hidden, model.costs)
    assert "moron" in toxicity.tokens("what a m o r o n there") and model.restore("you 1D10T") == "you idiot"
    plain = "thing erly marling stoed ouan " * 8
    asked = [(1, plain), (2, plain + " idiot loser"), (3, plain + " 1d10t l0$er"), (4, plain + " m o r o n IDIOOOT"), (5, None), (6, ""), (7, "123 45 !!! @@@"), (None, plain)]
    score = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, asked), model).collect()}
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == len(asked)
    assert min(score[2], score[3], score[4]) >= 0.3 > max(score[k] for k in (1, 5, 6, 7, None))
    out = toxicity.classify(docs, labels).join(labels.where("toxic in (0, 1)").groupBy("doc_id").agg({"toxic": "max"}), "doc_id").collect()
    unseen = [r for r in out if r["held_out"]]
    assert len(unseen) > 100 and all(r["predicted"] == r["max(toxic)"] for r in unseen)
    assert {r["doc_id"] for r in unseen} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 500


def test_long_and_wrapped_disguises(spark, learned):
    model = toxicity.fit(*learned)
    said = lambda text: {w for t in toxicity.tokens(text) for w in toxicity.readings(t, model.costs)}
    for wrapped in ('"1d10t"', "[1d10t]", "(1d10t),"):
        assert "idiot" in said(wrapped)
    sentence = "thing erly moron souly marling ouan"
    assert "moron" in said("  ".join(" ".join(w) for w in sentence.split()))
    assert "moron" in said(" ".join("thingmoron"))
    assert "moron" in said(".".join("thing" * 12 + "moron" + "erly"))
    assert len(toxicity.decode("a.b" * 20_000, model.costs)) == 40_000


def test_toxicity_without_labels(spark, learned):
    docs, labels = learned
    assert {r["score"] for r in toxicity.classify(docs.limit(5), labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert toxicity.keep_clean(docs.limit(5), labels.limit(0)).count() == 5
