"""Neighbours, exact top-k and packaged archives against plain Python."""

import base64
import hashlib
import io
import math
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import neighbours, topk, warc
from almanac.llm.common import components

VECTORS = "vec_id long, embedding array<float>, label int, node int, v string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, x, 1, "v", "s") for i, v, x in rows], VECTORS)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


ODD = [(9001, None, 1), (9002, [None, 1.0], 1), (9003, [float("nan"), 1.0], 1), (9004, [float("inf")] * 8, 1), (9005, [0.0] * 8, 1), (9006, [], 1), (9007, [1.0] * 3, 1), (None, [1.0] * 8, 1)]


def planted(seed=0, groups=25):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(groups):
        centre = rng.standard_normal(8)
        for _ in range(40 if g == 0 else int(rng.integers(1, 5))):
            rows.append((i, (centre + 0.1 * rng.standard_normal(8)).astype(np.float32).tolist(), [0, 1, 2, None][g % 4]))
            i += 1
    rows += [(1000 + k, rows[2][1], 0) for k in range(5)] + [(2000, [2 * c for c in rows[3][1]], 0), (2001, rows[2][1], 1), (2002, rows[2][1], None)]
    order = rng.permutation(len(rows))
    return [rows[k] for k in order]


def test_neighbours(spark):
    rows = planted() + ODD + [(9006, [1.0] * 8, 2), (None, planted()[5][1], 1), (9007, [1.0] * 3, 1), (3000, planted()[7][1], 0), (3000, planted()[9][1], 1)]
    ok = [v is not None and usable(v) and any(v) and x is not None for _, v, x in rows]
    unit_ = [np.asarray(v, dtype=np.float64) / np.sqrt(np.dot(v, v)) if good else None for (_, v, _), good in zip(rows, ok)]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit_[i] @ unit_[j] >= 0.93] for i in range(len(rows))]
    want = Counter()
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        want[(vec_id, len(near[i]), low, vec_id == low)] += 1
    got = neighbours.near_duplicates(vectors(spark, rows).repartition(3), leaf=8, k=4)
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == want


@pytest.mark.parametrize("options", [{}, {"tries": 1, "leaf": 32}, {"tries": 0}])
def test_linked_tight_groups(spark, monkeypatch, options):
    """Two groups whose 6 nearest are all their own, linked across, and pairs apart of them."""
    if options.get("tries", 1):  # the lists alone find them
        monkeypatch.setattr(neighbours, "tile_links", None)
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    centres = [axes[0], 0.942 * axes[0] + np.sqrt(1 - 0.942**2) * axes[1]]
    v = [c + 0.004 * rng.standard_normal(64) for c in centres for _ in range(30)]
    v += [axes[2 + i // 2] + 0.01 * rng.standard_normal(64) for i in range(40)]
    x = np.asarray(v, dtype=np.float32).astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = x @ x.T
    assert (s[:30, 30:60] >= 0.93).sum() > 200 and np.sort(s[:30, :30], axis=1)[:, -7].min() > s[:30, 30:60].max()
    links = (s >= 0.93).sum(axis=1) - 1
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(vectors(spark, [(i, np.float32(r).tolist(), 1) for i, r in enumerate(v)]), **options).collect()}
    assert [got[i]["n_links"] for i in range(100)] == links.tolist()
    assert [got[i]["component_id"] for i in range(100)] == [0] * 60 + [i - i % 2 for i in range(60, 100)]
    assert {r["recall"] for r in got.values()} == {1.0}


def test_no_neighbours(spark):
    assert neighbours.near_duplicates(vectors(spark, [])).count() == 0
    got = neighbours.near_duplicates(vectors(spark, [(5, [1.0, 0.0], 1), (4, None, 1)])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (10, 11), (12, 11), (20, 21), (21, 20), (30, 30)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 501 + i) for i in range(200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got[4] == 1 and got[12] == 10 and got[21] == 20 and 30 not in got and got[140] == 100 and got[700] == 500 and len(got) == 4 + 3 + 2 + 41 + 201


def best_by_hand(rows, k):
    v = {}
    for i, x, _ in rows:
        if i is not None and usable(x):
            y = [math.floor(256 * c) for c in x]
            v[i] = min(v.get(i, y), y)
    out = []
    for q in v:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[q], w)), i) for i, w in v.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), np.float32(rng.integers(-3, 4, 8) / 64 if i % 2 else rng.standard_normal(8)).tolist(), 1) for i in range(700)]
    rows += [(750, [0.0] * 8, 1), (800, rows[3][1], 1), (801, rows[3][1], 1), (801, rows[3][1], 1), (50, [9.0] * 8, 2)] + ODD
    table = topk.integer_vectors(vectors(spark, rows).repartition(3))
    for shard_rows, query_rows in ((8192, 4096), (100, 4)):
        got = topk.search(table, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, query_rows=query_rows).collect()
        assert sorted(map(tuple, got)) == best_by_hand(rows, 5)


def test_topk_with_few_rows(spark):
    few = [(50, [1.0], 1), (51, [2.0], 1), (100, [0.5], 1)]
    table = topk.integer_vectors(vectors(spark, few))
    assert sorted(map(tuple, topk.search(table, F.col("vec_id") % 50 == 0).collect())) == best_by_hand(few, 5)
    none = topk.integer_vectors(vectors(spark, []))
    assert topk.search(none, F.col("vec_id") % 50 == 0).count() == 0


def test_threshold_search_stops_early():
    rng = np.random.default_rng(2)
    shard = np.abs(rng.integers(0, 10, (5000, 4)))
    shard[77] = 1000
    looked = []
    original = topk.best_of
    topk.best_of = lambda ids, scores, k: looked.append(len(ids)) or original(ids, scores, k)
    try:
        found = list(topk.threshold_search(np.arange(5000), shard, np.asarray([-1]), np.asarray([[1, 2, 3, 4]]), 1))
    finally:
        topk.best_of = original
    assert found[0][1].tolist() == [77] and sum(looked) < 200


# --- archives ---------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, path string, records int"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}\r\nEvil: 1", t, "d", "p", 3) for i, t in rows], PAGES)


def expected(rows, at_least=0):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        top = max((x for x in groups[t or ""] if x is not None), default=None)
        again = len(b) >= at_least and i != top and top is not None
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None))
    return Counter(out)


@pytest.mark.parametrize("at_least", [0, 5])
def test_round_trip(spark, tmp_path, at_least):
    rows = [(i, f"<p>page {i % 20} é</p>" * (1 + i % 3)) for i in range(90)] + [(200, None), (201, ""), (202, "\r\n\r\nx\r\n"), (203, "日本" * 4000), (204, "abc"), (205, "abc"), (89, rows_of := "twice"), (89, rows_of), (None, "no id"), (None, "<p>page 3 é</p>")]
    got = warc.round_trip(pages(spark, rows).repartition(4), str(tmp_path / "a"), at_least=at_least).collect()
    assert Counter(map(tuple, got)) == expected(rows, at_least)


def test_payloads_and_package_sizes(spark, tmp_path):
    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(60)]
    manifest = warc.write_archives(warc.plan_records(pages(spark, rows).coalesce(1)), str(tmp_path / "b"), most=4000)
    from almanac.llm.common import materialise

    manifest = materialise(manifest, "packages")
    listed = manifest.collect()
    assert len(listed) > 3 and sum(r["records"] for r in listed) == 60
    back = warc.read_archives(spark, manifest).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in back} == dict(rows)
    with zipfile.ZipFile(listed[0]["path"]) as z:
        assert z.testzip() is None and set(z.namelist()) == {warc.WARC_MEMBER, warc.INDEX_MEMBER}


def test_no_pages(spark, tmp_path):
    assert warc.round_trip(pages(spark, []), str(tmp_path / "c")).count() == 0


def package(data):
    return warc.Package(lambda at, n: data[at : at + n], len(data))


def test_zip64_directory(monkeypatch):
    out = io.BytesIO()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    rows = [(i, "u", f"payload {i}".encode() * 30, warc.sha1_base32(f"payload {i}".encode() * 30), None, False) for i in range(9)]
    assert warc.write_package(out, iter(rows), 1 << 20) == (9, False)
    data = out.getvalue()
    assert warc.ZIP64_END in data and warc.ZIP64_LOCATOR in data
    assert [r["payload"] for r in package(data).records()] == [r[2] for r in rows]


def test_damage_is_seen():
    out = io.BytesIO()
    warc.write_package(out, iter([(1, "u", b"abc" * 50, warc.sha1_base32(b"abc" * 50), None, False)]), 1 << 20)
    with pytest.raises(ValueError):
        package(out.getvalue()[:-30])
    with pytest.raises(ValueError):
        warc.parse_record(b"HTTP/1.1 200\r\n\r\nx")
