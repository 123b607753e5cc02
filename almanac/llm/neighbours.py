"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from random-projection leaves and is refined by joins of neighbours of
neighbours: every node sends its vector to its neighbours in both directions, and a node that holds the
vectors of its neighbours proposes each pair of them that beats what either already has.  Rounds go on
until few entries change.  Entries at or above the threshold are links, and links make components.

A list whose entries are all links is saturated and may hide links.  Two nodes whose link is in neither
list both have such lists, so the saturated nodes get a second list of as many places, for the nearest
nodes outside their own component, and descend again with it; its links merge components, the lists are
enlarged again, and so on until no saturated list gains a link.  Within a component nothing needs to be found: its links
are counted by tiles, which return one count per node and never a pair.

An audit compares a bounded sample of the nodes with all nodes, each node weighing the same; while its
recall is below the target, leaves with other projections are added, and only after ``tries`` times
the labels are compared whole, by tiles.

Equal vectors of a label are one node; they are links of each other and never expanded.  Vectors of
different or null labels, null or zero vectors and vectors with null or non-finite components link with
nothing.  Cosines are of double precision.  Every row has its row in the result: rows that repeat an id
or have none are vectors like others, and a component is named by its smallest id (null, if it has none).
An empty table gives an empty result; other columns are ignored, whatever their names.

Bounds: a leaf is one task's work and holds at most about ``leaf`` nodes, a tile four times as many; a node joins at most
``k`` forward and ``k`` backward neighbours of either list per round (the backward ones chosen by a hash); the sample
of the audit has at most ``sample`` nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import components, materialise, partitions
from .topk import matrix

EDGES = "u long, v long, sim double"


def unit(rows: list[np.ndarray]) -> np.ndarray:
    """Rows as unit vectors in double precision; the scaling by the largest component avoids overflow."""
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The runs of equal values in the first ``keys`` long columns of sorted batches."""
    rest: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = np.stack([b.column(i).to_numpy() for i in range(keys)], axis=1)
        cuts = np.nonzero((cols[1:] != cols[:-1]).any(axis=1))[0] + 1
        if last is not None and (cols[0] != last).any() and rest:
            yield pa.concat_batches(rest)
            rest = []
        at = 0
        for cut in cuts.tolist():
            rest.append(b.slice(at, cut - at))
            yield pa.concat_batches(rest) if len(rest) > 1 else rest[0]
            rest, at = [], cut
        rest.append(b.slice(at))
        last = cols[-1]
    if rest:
        yield pa.concat_batches(rest)


def rows_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of all rows; label and v are null where a row links with nothing."""
    x = F.col(vec_col)
    number = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    ok = x.isNotNull() & F.col(label_col).isNotNull() & F.forall(x, number) & F.exists(x, lambda c: c != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(ok, F.col(label_col).cast("string")).alias("label"), F.when(ok, x.cast("array<double>")).alias("v"))


def with_bits(nodes: DataFrame, leaf: int) -> DataFrame:
    """``nodes`` with the number of planes that cut their label and vector length into leaves of about ``leaf``."""
    sizes = nodes.groupBy(F.col("kind").alias("_k")).agg(F.count(F.lit(1)).alias("_size"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_size") / F.lit(leaf)))).cast("long")
    return nodes.join(sizes, nodes.kind == F.col("_k")).withColumn("bits", bits).drop("_k", "_size")


def leaf_edges(nodes: DataFrame, trees: list[int], k: int, leaf: int) -> DataFrame:
    """Neighbour candidates (u, v, sim): the k nearest of another ``part`` within each random-projection leaf.

    A leaf is the nodes of one label and one vector length on the same sides of random planes, as
    many as its label needs (column ``bits``); leaves above ``leaf`` are split by a hash, differently in every tree.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = matrix(b.column("v"))
            n = len(rows)
            codes = np.zeros((len(trees), n), dtype=np.int64)
            sizes, bits = np.asarray([len(r) for r in rows]), b.column("bits").to_numpy()
            for size in np.unique(sizes):
                at = np.nonzero(sizes == size)[0]
                x = unit([rows[i] for i in at])
                for t, tree in enumerate(trees):
                    most = int(bits[at].max())
                    planes = np.random.default_rng(10_007 * tree + int(size)).standard_normal((most, int(size)))  # the first planes are the same for all
                    codes[t, at] = ((x @ planes.T) > 0) @ (1 << np.arange(most)) & ((1 << bits[at]) - 1) if most else 0
            for t, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), pa.array(np.full(n, tree, dtype=np.int64)), pa.array(codes[t])], names=["node", "label", "tree", "code"])

    signs = nodes.select("node", "label", "v", "bits").mapInArrow(code, "node long, label string, tree long, code long")
    signs = materialise(signs, "signs")
    sizes = signs.groupBy("label", "tree", "code").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / F.lit(leaf))
    split = signs.join(sizes, ["label", "tree", "code"]).where("n > 1")
    split = split.select("node", F.xxhash64("label", "tree", "code", F.pmod(F.xxhash64("node", "tree"), chunks)).alias("leaf"))
    rows = split.join(nodes.select("node", "part", "v"), "node").select("leaf", "node", F.size("v").cast("long").alias("size"), "part", "v")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, 2):
            n = g.num_rows
            if n < 2:
                continue
            ids = g.column("node").to_numpy()
            x = unit(matrix(g.column("v")))
            part = g.column("part").to_numpy()
            s = x @ x.T
            s[part[:, None] == part[None, :]] = -2
            m = min(k, n - 1)
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            sims = np.take_along_axis(s, best, axis=1).ravel()
            real = sims > -2
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)[real]), pa.array(ids[best].ravel()[real]), pa.array(sims[real])], names=["u", "v", "sim"])

    dealt = rows.select("leaf", "size", "node", "part", "v").repartition(partitions(nodes.sparkSession), "leaf").sortWithinPartitions("leaf", "size")
    return dealt.mapInArrow(near, EDGES)


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    """(u, near) with the k nearest (sim, v) of every node; both steps share one shuffle."""
    n = partitions(edges.sparkSession)
    once = edges.repartition(n, "u").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    top = once.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return top.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("sim", "v")), asc=False).alias("near"))


def local_joins(graph: DataFrame, nodes: DataFrame, k: int, also: DataFrame | None = None) -> DataFrame:
    """Candidates (u, v, sim) of different parts, proposed by common neighbours, that beat the k-th entry of u's list.

    ``also`` are further neighbours (u, v) over which vectors are sent.
    """
    flat = graph.select("u", F.explode("near").alias("e")).select("u", "e.v")
    flat = flat if also is None else flat.union(also)
    back = flat.select(F.col("v").alias("u"), F.col("u").alias("v"))
    order = Window.partitionBy("u").orderBy(F.xxhash64("u", "v"))
    back = back.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    own = nodes.select(F.col("node").alias("u"), F.col("node").alias("v"))
    mail = flat.union(back).union(own).distinct()
    worst = F.when(F.size("near") >= k, F.element_at("near", -1)["sim"]).otherwise(F.lit(-2.0))
    state = nodes.select("node", "kind", "part", "v").join(graph.select(F.col("u").alias("node"), worst.alias("worst")), "node", "left")
    state = state.select(F.col("node").alias("_n"), "kind", "part", F.col("v").alias("x"), F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    sent = mail.join(state, mail.v == state._n).select(F.col("u").alias("centre"), "kind", F.col("v").alias("node"), "part", "x", "worst")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, sims = [], [], []
        for g in grouped(batches, 2):
            n = g.num_rows
            if n < 2:
                continue
            ids, worst, part = (g.column(c).to_numpy() for c in ("node", "worst", "part"))
            x = unit(matrix(g.column("x")))
            s = x @ x.T
            s[part[:, None] == part[None, :]] = -3
            i, j = np.nonzero(s > worst[:, None])
            us.append(ids[i])
            vs.append(ids[j])
            sims.append(s[i, j])
            if len(us) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (us, vs, sims)], names=["u", "v", "sim"])
                us, vs, sims = [], [], []
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (us, vs, sims)], names=["u", "v", "sim"])

    dealt = sent.repartition(partitions(graph.sparkSession), "centre").sortWithinPartitions("centre", "kind")
    return dealt.mapInArrow(propose, EDGES)


def descend(graph: DataFrame, nodes: DataFrame, k: int, rounds: int, change: float, also: DataFrame | None = None) -> DataFrame:
    """Refine until fewer than ``change`` of the entries are new, at most ``rounds`` times."""
    for _ in range(rounds):
        old = graph.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.sim")
        new = materialise(best_lists(old.union(local_joins(graph, nodes, k, also)), k), "graph")
        flat = new.select("u", F.explode("near").alias("e")).select("u", "e.v")
        fresh, entries = flat.join(old.select("u", "v", F.lit(1).alias("_o")), ["u", "v"], "left").agg(F.count_if(F.col("_o").isNull()), F.count(F.lit(1))).first()
        graph = new
        if fresh <= change * max(1, entries):
            break
    return graph


def links_in(graph: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the entries of the lists that are links."""
    return graph.select("u", F.explode("near").alias("e")).where(F.col("e.sim") >= threshold).select(F.col("u").alias("a"), F.col("e.v").alias("b"))


def enlarge(nodes: DataFrame, graph: DataFrame, linked: DataFrame, threshold: float, k: int, leaf: int, trees: list[int], rounds: int, change: float) -> tuple[DataFrame, DataFrame]:
    """(links, components) after the saturated nodes have looked outside their components until none gains a link.

    Each turn that goes on merges components, so there are few: as many as the longest chain of groups
    that find each other one after the other.
    """
    parts = materialise(components(linked), "components")
    full = graph.where((F.size("near") >= k) & (F.element_at("near", -1)["sim"] >= threshold))
    also = materialise(full.select("u", F.explode("near").alias("e")).select("u", "e.v"), "saturated")
    if not also.head(1):
        return linked, parts
    side = nodes.drop("bits", "part").join(also.select(F.col("u").alias("_u")).distinct(), F.col("node") == F.col("_u"), "left_semi")
    side = materialise(with_bits(side, leaf), "saturated_nodes")
    while True:
        own = parts.select(F.col("node").alias("_n"), F.col("component").alias("part"))
        here = materialise(side.join(own, side.node == own._n).drop("_n"), "outside")
        lists = materialise(best_lists(leaf_edges(here, trees, k, leaf), k), "graph")
        lists = descend(lists, here, k, rounds, change, also)
        more = materialise(links_in(lists, threshold), "links")
        if not more.head(1):
            return linked, parts
        linked = materialise(linked.union(more), "links")
        parts = materialise(components(linked), "components")


def tiles(members: DataFrame, tile: int) -> DataFrame:
    """``members`` (component, node, copies, x) dealt and sorted by tiles (component, a, b).

    Components are cut into chunks of about ``tile`` nodes by a hash, and every two chunks of a component
    meet once.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("chunks"))
    m = members.join(sizes, "component").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    m = m.select("component", F.least("mine", "other").cast("long").alias("a"), F.greatest("mine", "other").cast("long").alias("b"), F.col("mine").cast("long").alias("mine"), "node", "copies", "x")
    return m.repartition(partitions(members.sparkSession), "component", "a", "b").sortWithinPartitions("component", "a", "b")


def tile_links(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """Spanning edges (a, b) of all links among the members of each component: at most one row per node of a tile."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, 3):
            ids = g.column("node").to_numpy()
            x = unit(matrix(g.column("x")))
            near = x @ x.T >= threshold
            free = np.ones(len(ids), dtype=bool)
            src, dst = [], []
            for start in np.nonzero(near.sum(axis=1) > 1)[0].tolist():
                todo = [start] if free[start] else []
                free[start] = False
                while todo:
                    i = todo.pop()
                    found = np.nonzero(near[i] & free)[0]
                    free[found] = False
                    src.append(np.full(len(found), ids[i]))
                    dst.append(ids[found])
                    todo.extend(found.tolist())
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["a", "b"])

    return tiles(members, tile).mapInArrow(span, "a long, b long")


def tile_counts(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(node, links): per node the vectors of its component that it links with, counted with their copies.

    A tile returns one count per node.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, links = [], []
        for g in grouped(batches, 3):
            ids, copies = g.column("node").to_numpy(), g.column("copies").to_numpy()
            a, b, mine = (g.column(c).to_numpy() for c in ("a", "b", "mine"))
            x = unit(matrix(g.column("x")))
            near = (x @ x.T >= threshold).astype(np.float64)
            np.fill_diagonal(near, 0)
            if a[0] != b[0]:
                near[mine[:, None] == mine[None, :]] = 0  # chunks meet themselves in their own tile
            nodes.append(ids)
            links.append((near @ copies).astype(np.int64))
            if len(nodes) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links))], names=["node", "links"])
                nodes, links = [], []
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(links))], names=["node", "links"])

    return tiles(members, tile).mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, sample: int) -> float:
    """Mean recall of the links of a node, for a sample of about ``sample`` nodes against all nodes; nodes without links don't count."""
    total = nodes.count()
    share = max(1, total // max(1, sample))
    some = nodes.where(F.pmod(F.xxhash64("node", F.lit(99)), F.lit(share)) == 0).select("node", "label", "v").limit(4 * sample).collect()
    if not some:
        return 1.0
    by_kind: dict = {}
    for r in some:
        by_kind.setdefault((r["label"], len(r["v"])), []).append((r["node"], np.asarray(r["v"])))
    asked = nodes.sparkSession.sparkContext.broadcast({key: (np.asarray([i for i, _ in rows]), unit([v for _, v in rows])) for key, rows in by_kind.items()})

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, labels, copies, ids = matrix(b.column("v")), b.column("label").to_pylist(), b.column("copies").to_numpy(), b.column("node").to_numpy()
            where: dict = {}
            for i, (label, r) in enumerate(zip(labels, rows)):
                where.setdefault((label, len(r)), []).append(i)
            for key, at in where.items():
                if key in asked.value:
                    q, x = asked.value[key]
                    near = (unit([rows[i] for i in at]) @ x.T >= threshold) & (ids[at][:, None] != q[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array((near * copies[at][:, None]).sum(axis=0).astype(np.int64))], names=["node", "links"])

    true = nodes.select("node", "label", "copies", "v").mapInArrow(truth, "node long, links long").groupBy("node").agg(F.sum("links").alias("t"))
    reached = true.where("t > 0").join(counts, "node", "left").agg(F.avg(F.least("t", F.coalesce("links", F.lit(0))) / F.col("t"))).first()[0]
    return 1.0 if reached is None else reached


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, k: int = 6, leaf: int = 512, trees: int = 3, rounds: int = 4, change: float = 0.01, sample: int = 256, recall: float = 0.99, tries: int = 3) -> DataFrame:
    """One row per row of the input: vec_id, n_links, component_id, kept, recall (of the audit, the same in all rows)."""
    rows = materialise(rows_of(vectors, id_col, vec_col, label_col), "vectors")
    nodes = rows.where("label IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    # A written number stays the node's, whichever task reads it again.
    nodes = materialise(nodes.withColumns({"node": F.monotonically_increasing_id(), "kind": F.xxhash64("label", F.size("v"))}), "nodes")
    nodes = materialise(with_bits(nodes, leaf).withColumn("part", F.col("node")), "nodes")

    def settle(parts: DataFrame) -> DataFrame:
        info = nodes.select(F.col("node").alias("_n"), "copies", F.col("v").alias("x"))
        members = parts.join(info, parts.node == info._n).select("component", "node", "copies", "x")
        return materialise(tile_counts(members, threshold, 2 * leaf), "counts")

    graph, reached, parts, counts = None, 0.0, None, None
    for attempt in range(tries):
        planes = list(range(attempt * trees, (attempt + 1) * trees))
        edges = leaf_edges(nodes, planes, k, leaf)
        if graph is not None:
            edges = edges.union(graph.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.sim"))
        graph = descend(materialise(best_lists(edges, k), "graph"), nodes, k, rounds, change)
        linked = materialise(links_in(graph, threshold), "links")
        linked, parts = enlarge(nodes, graph, linked, threshold, k, leaf, [1000 + t for t in planes], rounds, change)
        counts = settle(parts)
        reached = audit(nodes, counts, threshold, sample)
        if reached >= recall:
            break
    else:
        whole = nodes.select(F.col("kind").alias("component"), "node", "copies", F.col("v").alias("x"))
        parts = materialise(components(tile_links(whole, threshold, 2 * leaf)), "components")
        counts = settle(parts)
        reached = audit(nodes, counts, threshold, sample)
    own = nodes.select("node", "label", "v", "low", "copies").join(counts, "node", "left").join(parts, "node", "left")
    own = materialise(own.withColumn("component", F.coalesce("component", "node")), "named")
    named = own.groupBy(F.col("component").alias("_c")).agg(F.min("low").alias("component_id"))
    per_node = own.join(named, own.component == named._c)
    per_node = per_node.select(F.col("label").alias("_l"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(per_node, (rows.label == per_node._l) & (rows.v == per_node._v), "left")
    component = F.when(F.col("_l").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(float(reached)).alias("recall"))


NEIGHBOURS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS low FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(low, e.vec_id) AS component_id, coalesce(low, e.vec_id) = e.vec_id AS kept, CAST(1 AS DOUBLE) AS recall
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
