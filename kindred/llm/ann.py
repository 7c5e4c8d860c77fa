"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy search walks it.

Different vectors are the nodes; equal ones share a node. Lists start from exact neighbours inside small
blocks (leaves of random-hyperplane trees fitted on a bounded sample, all rows assigned; leaves that are
still large are halved by further hyperplanes). Rounds of NN-descent then bring each node's neighbours and
reverse neighbours together by joins, and every pair of which one is new there is compared, until a round
changes less than a share of DELTA of all neighbours. A query starts at its own node and expands the nearest
unexpanded nodes of its beam, a few for each hop, for all queries at once, until all beams are expanded; beams
widen with the square root of the nodes. Found vectors are scored exactly.

Defined cases: vectors that are null or zero, hold null, NaN or infinity, or are not of the most common
length take no part, nor rows with a null vec_id; rows of one vec_id are candidates each, and queries once for
each of their vectors; ties go to the smaller vec_id; with fewer candidates than asked all found are returned; an
empty table gives no rows; columns beside vec_id and embedding are ignored.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, prepare, table

DEGREE, TREES, LEAF, SAMPLE = 36, 4, 64, 20_000
#: Larger tables have larger leaves, up to LEAF_MOST vectors, but none of over this share, and TREES_MOST trees: comparing
#: inside a leaf costs far less than a round of the descent.
LEAF_MOST, LEAF_SHARE, TREES_MOST = 512, 1 / 128, 8
#: NN-descent ends with the first round that changes less than this share of the neighbours.
DELTA = 0.01
#: Reverse links that a search may follow from a node, the nearest first.
BACK = 48
#: New neighbours, as many seen ones, and as many reverse ones of either kind, that a node brings together in a round.
MEET = 18
#: Up to so many components of queries' vectors, 8 bytes each, are sent to where the vectors are; more queries go in rounds.
PLACES = 2_000_000
#: Queries whose beams one call handles; candidates of neighbour lists that are held before the nearest of each node are kept.
BEAMS, HELD = 64, 1_000_000
#: The least beam, and its growth with the square root of the nodes: neighbours among more nodes are harder to reach.
BEAM, WIDEN, EXPAND, TOP = 256, 1.7, 96, 10
_NB = "array<struct<d:float,n:bigint>>"


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows with a valid vector."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    got = rows.select("vec_id", F.when(ok, v).alias("v")).where("vec_id is not null and v is not null")
    sizes = got.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return got
    return got.where(F.size("v") == sizes[0][0])


def matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def tree_splits(sample: np.ndarray, depth: int, trees: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each tree the normals and medians of its inner nodes, in heap order."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        normals = rng.standard_normal((2**depth - 1, sample.shape[1]))
        medians, at = np.zeros(2**depth - 1), np.zeros(len(sample), int)
        for node in range(2**depth - 1):
            mine = np.flatnonzero(at == node)
            if len(mine):
                p = sample[mine] @ normals[node]
                medians[node] = np.median(p)
                at[mine] = 2 * node + 1 + (p > medians[node])
        out.append((normals, medians))
    return out


def leaves(v: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    normals, medians = tree
    at = np.zeros(len(v), int)
    for _ in range(depth):
        at = 2 * at + 1 + ((v * normals[at]).sum(1) > medians[at])
    return at


def gaps(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (i, j) of vectors in single precision, the same wherever a pair is met."""
    v = v.astype(np.float32).astype(np.float64)
    d = v[i] - v[j]
    return (d * d).sum(-1).astype(np.float32)


def neighbour_lists(ids: np.ndarray, rows: np.ndarray, near: np.ndarray, d: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A batch (id, nb): nb of ids[rows[k]] are the next counts[k] of (d, ids[near])."""
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    nb = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(d), pa.array(ids[near])], ["d", "n"]))
    return pa.RecordBatch.from_arrays([pa.array(ids[rows]), nb], ["id", "nb"])


def halved(placed: DataFrame, leaf: int, seed: int = 11) -> DataFrame | None:
    """(tree, id, part) of rows (tree, leaf, id, v) in leaves of over 1.25 x leaf rows: halved by hyperplanes through
    the medians until no part is larger. None if there are none."""

    def over(rows):
        return F.broadcast(rows.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1.25 * leaf).select("tree", "leaf"))  # a row for each large part

    def project(batches):
        for b in batches:
            tree, at, v = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(3))
            p = np.zeros(len(v))
            for t, k in set(zip(tree.tolist(), at.tolist(), strict=True)):
                mine = (tree == t) & (at == k)
                p[mine] = v[mine] @ np.random.default_rng([seed, t, k]).standard_normal(v.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], ["tree", "leaf", "id", "v", "p"])

    done, rest = [], cut(placed.join(over(placed), ["tree", "leaf"]).select("tree", "leaf", "id", "v"))
    while not rest.isEmpty():
        sided = cut(rest.mapInArrow(project, "tree int, leaf long, id long, v array<double>, p double"))
        mids = sided.groupBy("tree", "leaf").agg(F.percentile_approx("p", 0.5, 1000).alias("mid"), F.min("p").alias("lo"), F.max("p").alias("hi"))
        with_mid = sided.join(F.broadcast(mids), ["tree", "leaf"])  # a row for each large part
        up = (F.col("p") > F.col("mid")) | ((F.col("mid") == F.col("hi")) & (F.col("p") == F.col("hi")))
        halves = cut(with_mid.select("tree", (2 * F.col("leaf") + 1 + up.cast("int")).alias("leaf"), "id", "v", (F.col("lo") < F.col("hi")).alias("apart")))
        large = over(halves.where("apart"))  # what no hyperplane tells apart stays together
        done.append(halves.join(large, ["tree", "leaf"], "left_anti").select("tree", "id", F.col("leaf").alias("part")))
        rest = cut(halves.join(large, ["tree", "leaf"]).select("tree", "leaf", "id", "v"))
    return functools.reduce(DataFrame.union, done) if done else None


def start_lists(nodes: DataFrame, n: int, degree: int, leaf: int, trees: int = 0) -> DataFrame:
    """(id, nb): exact nearest of each node inside its blocks."""
    spark = nodes.sparkSession
    depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / leaf))), int(np.log2(SAMPLE / 16))))
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()]) if depth else None
    trees = (trees or TREES) if depth else 1
    shared = spark.sparkContext.broadcast(tree_splits(sample, depth, trees) if depth else [None])

    def assign(batches):
        for b in batches:
            v = matrix(b.column(1))
            for t, tree in enumerate(shared.value):
                at = leaves(v, tree, depth) if depth else np.zeros(len(v), int)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(at), b.column(0), b.column(1)], ["tree", "leaf", "id", "v"])

    placed = nodes.select("id", "v").mapInArrow(assign, "tree int, leaf long, id long, v array<double>")
    parts = halved(placed, leaf)
    blocks = placed.withColumn("part", F.col("leaf")) if parts is None else placed.join(parts, ["tree", "id"], "left").withColumn("part", F.coalesce("part", "leaf"))

    def knn(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, v = t["id"].to_numpy(), matrix(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"])
        m, k = len(ids), min(degree, len(ids) - 1)
        if k < 1:
            return pa.table({"id": pa.array([], pa.int64()), "nb": pa.array([], pa.list_(pa.struct([("d", pa.float32()), ("n", pa.int64())])))})
        near = np.empty((m, k), int)
        sq = (v * v).sum(1)
        for a in range(0, m, 256):
            g = sq[None, :] - 2 * v[a : a + 256] @ v.T
            g[np.arange(len(g)), np.arange(a, a + len(g))] = np.inf
            near[a : a + 256] = np.argpartition(g, k - 1, axis=1)[:, :k]
        rows = np.arange(m)
        d = gaps(v, np.repeat(rows, k), near.ravel())
        return pa.Table.from_batches([neighbour_lists(ids, rows, near.ravel(), d, np.full(m, k))])

    return blocks.select("tree", "leaf", "id", "v", "part").groupBy("tree", "part").applyInArrow(knn, f"id long, nb {_NB}")


def kept_lists(ids: np.ndarray, rows: np.ndarray, d: np.ndarray, n: np.ndarray, degree: int) -> pa.RecordBatch:
    """A batch (id, nb): of each of the different `ids` the `degree` nearest different (d, n) of the entries of its rows."""
    order = np.lexsort((n, d, rows))
    rows, d, n = rows[order], d[order], n[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (n[1:] != n[:-1]) | (d[1:] != d[:-1])
    rows, d, n = rows[first], d[first], n[first]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < degree
    rows, d, n = rows[keep], d[keep], n[keep]
    off = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(ids)))]).astype(np.int32)
    nb = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(d), pa.array(n)], ["d", "n"]))
    return pa.RecordBatch.from_arrays([pa.array(ids), nb], ["id", "nb"])


def nearest(lists: DataFrame, degree: int) -> DataFrame:
    """(id, nb): the `degree` nearest of all lists of an id, nearest first. An id's lists are few and short, and come together."""

    def merge(batches):
        held, size = [], 0

        def flush(last: bool):
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t["id"].to_numpy()
            end = len(ids) if last else int(np.searchsorted(ids, ids[-1]))  # the last id may go on in the next batch
            held, size = ([] if last else t.slice(end).to_batches()), 0
            if end:
                mine, rows = np.unique(ids[:end], return_inverse=True)
                nb = t["nb"].slice(0, end).combine_chunks()
                nb = nb.chunk(0) if isinstance(nb, pa.ChunkedArray) else nb
                flat = nb.flatten()
                yield kept_lists(mine, np.repeat(rows, nb.value_lengths().to_numpy()), flat.field("d").to_numpy(), flat.field("n").to_numpy(), degree)

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= 20_000:
                yield from flush(False)
        if held:
            yield from flush(True)

    return lists.select("id", "nb").repartition("id").sortWithinPartitions("id").mapInArrow(merge, f"id long, nb {_NB}")


def as_bytes(batches):
    """(id, v) with the vectors as bytes in single precision."""
    for b in batches:
        v = matrix(b.column(1)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["m", "v"])


def first_of(edges: DataFrame, key: str | list[str], order: list[Column], most: int) -> DataFrame:
    return edges.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("k") <= most).drop("k")


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits of each of 64-bit numbers, as splitmix64 does it."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def picked(batches, meet: int, turn: int):
    """(c, m, new): by lot up to `meet` of the new and of the other neighbours of each row (id, ns, new)."""
    for b in batches:
        c = b.column(0).to_numpy()
        rows, m, new = np.repeat(np.arange(len(c)), b.column(1).value_lengths().to_numpy()), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((m, mixed(mixed(c[rows] + turn) ^ m.astype(np.uint64)), new, rows))
        group = 2 * rows[order] + new[order]
        order = order[np.arange(len(order)) - np.searchsorted(group, group) < meet]
        yield pa.RecordBatch.from_arrays([pa.array(c[rows[order]]), pa.array(m[order]), pa.array(new[order])], ["c", "m", "new"])


def descend(nodes: DataFrame, graph: DataFrame, degree: int, meet: int, turn: int) -> DataFrame:
    """One round over (id, nb, seen): at every node neighbours and reverse neighbours meet, up to `meet` of each that are
    new (not in seen) and as many others; pairs of which one is new are compared, and keep what is nearer than
    their farthest. New neighbours that have met others are seen."""
    new = ~F.array_contains("seen", F.col("e.n"))
    out = graph.select(F.col("id").alias("c"), "seen", F.explode("nb").alias("e")).select("c", F.col("e.n").alias("m"), new.alias("new"))
    lot = lambda *x: [F.xxhash64(*x, F.lit(turn)), F.col("m")]
    flags = F.transform("nb", lambda e: ~F.array_contains("seen", e["n"]))
    near = graph.select("id", F.transform("nb", lambda e: e["n"]).alias("ns"), flags.alias("new")).mapInArrow(functools.partial(picked, meet=meet, turn=turn), "c long, m long, new boolean")
    back = first_of(out.select(F.col("m").alias("c"), F.col("c").alias("m"), "new"), ["c", "new"], lot("c", "m"), meet)
    meets = near.union(back).groupBy("c", "m").agg(F.max("new").alias("new"))
    far = graph.select(F.col("id").alias("m"), F.when(F.size("nb") >= degree, F.element_at("nb", -1)["d"]).otherwise(F.lit(float("inf")).cast("float")).alias("far"))
    known = nodes.select("id", "v").mapInArrow(as_bytes, "m long, v binary").join(far, "m")
    rooms = meets.join(known, "m").groupBy("c").agg(F.collect_list(F.struct("m", "new", "far", "v")).alias("x")).where(F.exists("x", lambda m: m["new"]))  # 4 * meet members at most

    def run(batches):
        for b in batches:
            x = b.column(0)
            off, x = x.offsets.to_numpy(), x.values
            ids_, new_, far_ = (x.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            v_ = np.frombuffer(b"".join(x.field(3).to_pylist()), np.float32).reshape(len(ids_), -1)
            for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                m, ids, fresh, kth, v = e - s, ids_[s:e], new_[s:e], far_[s:e], v_[s:e]
                sq = (v * v).sum(1)
                rough = sq[:, None] + sq[None, :] - 2 * (v @ v.T)
                rough *= 1 - 1e-4  # what may be near enough is measured exactly
                i, j = np.nonzero((fresh[:, None] | fresh[None, :]) & ~np.eye(m, dtype=bool) & (rough < kth[:, None] + 1e-4 * sq[:, None]))
                d = gaps(v, i, j)
                keep = d < kth[i]
                i, j, d = i[keep], j[keep], d[keep]
                if len(i):
                    yield ids[i], d, ids[j]

    def batched(batches):
        held, size = [], 0

        def flush():
            to, d, n = (np.concatenate(x) for x in zip(*held, strict=True))
            ids, rows = np.unique(to, return_inverse=True)
            return kept_lists(ids, rows, d, n, degree)

        for x in run(batches):
            held.append(x)
            size += len(x[0])
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    better = rooms.select("x").mapInArrow(batched, f"id long, nb {_NB}")
    merged = nearest(graph.select("id", "nb").unionByName(better), degree)
    met = near.where("new").groupBy("c").agg(F.collect_list("m").alias("met")).withColumnRenamed("c", "id")
    none = F.array().cast("array<bigint>")
    seen = F.array_intersect(F.transform("nb", lambda e: e["n"]), F.concat("seen", F.coalesce("met", none)))
    return merged.join(graph.select("id", "seen"), "id").join(met, "id", "left").select("id", "nb", seen.alias("seen"))


def changed(old: DataFrame, new: DataFrame) -> float:
    """Share of the neighbours in `new` that `old` lacks."""
    of = lambda c: F.transform(c, lambda e: e["n"])
    both = new.join(old.select("id", F.col("nb").alias("had")), "id", "left")
    fresh = F.size(F.array_except(of("nb"), F.coalesce(of("had"), F.array().cast("array<bigint>"))))
    n, m = both.agg(F.sum(fresh), F.sum(F.size("nb"))).collect()[0]
    return n / m if m else 0.0


def build_graph(nodes: DataFrame, degree: int = 0, delta: float = 0.0, leaf: int = 0) -> DataFrame:
    """(id, nb) of every node (id, v): its nearest found, nearest first. Lists only get nearer, so rounds end."""
    prepare(nodes.sparkSession)
    n = nodes.count()
    degree, delta, leaf = degree or DEGREE, delta or DELTA, leaf or max(LEAF, min(LEAF_MOST, int(n * LEAF_SHARE)))
    graph = cut(nearest(start_lists(nodes, n, degree, leaf, TREES_MOST if leaf > LEAF else TREES), degree).withColumn("seen", F.array().cast("array<bigint>")))
    for turn in itertools.count():
        old, graph = graph, cut(descend(nodes, graph, degree, MEET, turn))
        few = changed(old, graph) < delta
        drop(old)
        if few:
            return graph.select("id", "nb")


def square(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = 0, expand: int = 0) -> DataFrame:
    """(q, v, beam) of queries (q, node, v): nodes met, nearest first, the query's own included; all are expanded.

    A beam's farthest only gets nearer, so no node is expanded twice and the hops end. What a beam knows already is dropped
    before vectors are fetched, a vector goes once to all queries that meet it, and what is farther than a full beam's last
    goes nowhere. Queries whose vectors are too many to be sent go in rounds."""
    beam, expand = beam or max(BEAM, int(WIDEN * nodes.count() ** 0.5)), expand or EXPAND
    out = graph.select("id", F.explode("nb").alias("e")).select("id", F.col("e.n").alias("n"), F.col("e.d").alias("d"))
    back = first_of(out.select(F.col("n").alias("id"), F.col("id").alias("n"), "d"), "id", [F.col("d"), F.col("n")], BACK)
    links = cut(out.select("id", "n").union(back.select("id", "n")).groupBy("id").agg(F.collect_set("n").alias("ns")))
    places = queries.agg(F.sum(F.size("v"))).collect()[0][0] or 0
    rounds = max(1, -(-places // PLACES))
    done = [walk(nodes, links, queries if rounds == 1 else queries.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == k), beam, expand) for k in range(rounds)]
    return functools.reduce(DataFrame.unionByName, done).join(queries.select("q", "v"), "q")


def walk(nodes: DataFrame, links: DataFrame, queries: DataFrame, beam: int, expand: int) -> DataFrame:
    """(q, beam) of one round of search()."""
    spark = nodes.sparkSession
    kind = "array<struct<d:double,n:bigint,x:boolean>>"
    own = F.array(F.struct(F.lit(0.0).alias("d"), F.col("node").alias("n"), F.lit(False).alias("x"))).cast(kind)
    state = cut(queries.select("q", own.alias("beam")))
    rows = queries.select("q", "v").orderBy("q").toArrow()  # PLACES components at most
    asked, points = rows["q"].to_numpy(), matrix(rows["v"].combine_chunks())
    groups = max(1, -(-len(asked) // BEAMS))
    group = F.pmod(F.xxhash64("q"), F.lit(groups)).alias("g")
    shared = spark.sparkContext.broadcast((asked, points))

    def parts(t: pa.Table):
        """For each query of a group its rows of a table (q, new, ..)."""
        t = t.sort_by([("q", "ascending"), ("new", "ascending")]).combine_chunks()
        q = t["q"].to_numpy()
        at = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1], [True]])) if len(q) else np.zeros(1, int)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield q[s], t.slice(s, e - s)

    def unknown(t: pa.Table) -> pa.Table:
        """(q, id) of what the opened nodes lead to and the beam, the row that is not new, lacks."""
        qs, ids = [], []
        for q, mine in parts(t):
            have, new = (mine.filter(x)["ns"].combine_chunks().flatten().to_numpy() for x in (pc.invert(mine["new"]), mine["new"]))
            fresh = np.setdiff1d(new, have)
            qs.append(np.full(len(fresh), q))
            ids.append(fresh)
        return pa.table({"q": np.concatenate(qs), "id": np.concatenate(ids)})

    def measure(batches):
        """(q, d, n) of nodes (id, v, qs) and what their queries know as `far`."""
        names, at = shared.value
        for b in batches:
            v, qs = matrix(b.column(1)), b.column(2)
            node, flat = np.repeat(np.arange(b.num_rows), qs.value_lengths().to_numpy()), qs.flatten()
            k, far = np.searchsorted(names, flat.field("q").to_numpy()), flat.field("far").to_numpy()
            for s in range(0, len(k), 100_000):
                i, j = node[s : s + 100_000], k[s : s + 100_000]
                d = ((at[j] - v[i]) ** 2).sum(1)
                keep = d <= far[s : s + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(names[j[keep]]), pa.array(d[keep]), b.column(0).take(pa.array(i[keep]))], ["q", "d", "n"])

    def merge(t: pa.Table) -> pa.Table:
        """(q, beam) of beams, whose opened nodes are marked now, and of what was found (q, new, beam)."""
        names, beams, size = [], [], []
        for q, mine in parts(t):
            flat = mine["beam"].combine_chunks().flatten()
            d, n, x = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("d", "n", "x"))
            own = len(mine["beam"][0])  # the row that is not new comes first
            x = x.copy()
            x[np.flatnonzero(~x[:own])[:expand]] = True
            best = np.lexsort((n, d))[:beam]
            names.append(q)
            size.append(len(best))
            beams.append((d[best], n[best], x[best]))
        d, n, x = (np.concatenate(c) for c in zip(*beams, strict=True))
        off = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        return pa.table({"q": pa.array(names, pa.int64()), "beam": pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([pa.array(d), pa.array(n), pa.array(x)], ["d", "n", "x"]))})

    while not state.where(F.exists("beam", lambda b: ~b["x"])).isEmpty():
        going = state.where(F.exists("beam", lambda b: ~b["x"]))
        todo = F.slice(F.filter("beam", lambda b: ~b["x"]), 1, expand)
        open_ = going.select("q", F.explode(F.transform(todo, lambda b: b["n"])).alias("id")).join(links, "id").select(group, "q", F.lit(True).alias("new"), "ns")
        have = going.select(group, "q", F.lit(False).alias("new"), F.transform("beam", lambda b: b["n"]).alias("ns"))
        fresh = open_.union(have).groupBy("g").applyInArrow(unknown, "q long, id long")
        far = going.select("q", F.when(F.size("beam") >= beam, F.element_at("beam", -1)["d"]).otherwise(float("inf")).alias("far"))
        met = fresh.join(F.broadcast(far), "q").groupBy("id").agg(F.collect_list(F.struct("q", "far")).alias("qs"))  # far: a row for each query of the round
        found = nodes.select("id", "v").join(met, "id").mapInArrow(measure, "q long, d double, n long")
        new = found.groupBy("q").agg(F.collect_list(F.struct("d", "n", F.lit(False).alias("x"))).alias("beam"))
        both = state.select(group, "q", F.lit(False).alias("new"), "beam").union(new.select(group, "q", F.lit(True).alias("new"), F.col("beam").cast(kind)))
        old, state = state, cut(both.groupBy("g").applyInArrow(merge, f"q long, beam {kind}"))
        drop(old)
    return state


def nearest_neighbours(rows: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): of the rows (vec_id, embedding) that are queries, the nearest others."""
    prepare(rows.sparkSession)
    vectors = cut(usable(rows).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies")).withColumn("id", F.xxhash64("v")))
    nodes = cut(vectors.groupBy("id").agg(F.first("v").alias("v")))
    each = vectors.select("id", "vec_id", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(top + 1)))).alias("copy"))
    members = first_of(each, "id", [F.col("vec_id"), F.col("copy")], top + 1)
    queries = cut(vectors.where(is_query).select(F.xxhash64("vec_id", "id").alias("q"), "vec_id", F.col("id").alias("node"), "v"))
    state = search(nodes, build_graph(nodes), queries.select("q", "node", "v"))
    near = state.select("q", "v", F.explode(F.slice("beam", 1, top + 1)).alias("b")).select("q", "v", F.col("b.n").alias("id"))
    scored = near.join(nodes.select("id", F.col("v").alias("w")), "id").select("q", "id", F.sqrt(square("v", "w")).alias("score"))
    asked = queries.select("q", F.col("vec_id").alias("query_id"), "node")
    found = scored.join(members, "id").join(asked, "q").where(~((F.col("vec_id") == F.col("query_id")) & (F.col("id") == F.col("node")) & (F.col("copy") == 1)))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
