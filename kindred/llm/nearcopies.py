"""Near copies: different texts whose sets of five-word runs have a Jaccard similarity of 0.8 or more, found exactly.

Two such sets of at most n runs share one of their first n // 5 + 1 runs in any order that holds for all
sets (prefix filter). The order is that of the runs' hashes, but runs that over CELL prefixes hold come
last. Sets that share a run of their prefixes form a cell. Small cells give pairs; those whose sketches
do not rule it out and that are not linked yet are compared. In large cells all members are first compared with one of them, which links a
group of copies at a cost of its size, wherever its members are. What is left of cells that hold several groups is
dealt out in pairs of blocks of at most MANY members and walked there: what is linked to a member leaves,
and no pair is ever written.

Sets are several times their texts' size, so they are never stored: texts are read anew for the few that are compared.

Defined cases: equal sets are one node; a text of fewer than five words is one run; null and empty texts
have the empty set and are copies of one another only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, prepare
from .components import connected_components

WORDS, SEED = 5, 42
CELL = 32
#: Members of a block of a large cell; a task holds two blocks at once.
MANY = 2048
#: Runs of large cells that are put last, the most frequent first. Any choice is exact; it only saves comparisons.
LATE = 2_000_000
#: Slices, at most, in which sets are brought to what is compared, and runs (8 bytes each) that go in one.
SLICES, FEW = 8, 16_000_000
#: Up to so many nodes are sent to where the sets are.
SENT = 1_000_000
_EDGE = "a long, b long"


def runs(text: bytes, n: int = WORDS, step: int = 1 << 16) -> np.ndarray:
    """Sorted different XXH64 of the runs of n words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > n:
        starts, ends = starts[: 1 - n], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    parts = [np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i : i + step].tolist(), ends[i : i + step].tolist(), strict=True)], np.uint64) for i in range(0, len(starts), step)]
    return np.unique(np.concatenate(parts).view(np.int64))


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of a set's runs in 1024 places: two sketches differ in no more bits than their sets in members."""
    odd = np.bincount(h & 1023, minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _texts(docs: DataFrame, *cols: Column) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(*cols, F.xxhash64("text").alias("th"), F.col("text").cast("string").cast("binary").alias("text"))


def _node(h: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(h.tobytes(), SEED)


def _lists(lists: list[np.ndarray]) -> pa.ListArray:
    off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))


def _nodes(hs: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([_node(h) for h in hs], np.uint64).view(np.int64))


def run_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, n, sk, fp) of every row: th is a hash of the text, node one of its set of runs, n the set's size, sk
    its sketch, fp the text's SimHash as a signed long."""
    src = _texts(docs, F.col("doc_id"))

    def run(batches):
        from .simhash import fingerprint

        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(2)]
            hs = [runs(t) for t in texts]
            n = pa.array(np.array([len(h) for h in hs], np.int32))
            fp = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _nodes(hs), n, _lists([sketch(h) for h in hs]), fp], ["doc_id", "th", "node", "n", "sk", "fp"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, th long, node long, n int, sk array<long>, fp long")


def postings(docs: DataFrame, late: np.ndarray) -> DataFrame:
    """(node, n, run) of the prefixes, once for each node and task; runs of `late` come last in every set."""
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches):
        seen, names = set(), ["node", "n", "run"]
        for b in batches:
            nodes, sizes, out = [], [], []
            for t in b.column(1):
                h = runs(t.as_py() or b"")
                node = _node(h)
                if node in seen or not len(h):
                    continue
                seen.add(node)
                k = len(h) // 5 + 1
                if len(shared.value):
                    at = np.searchsorted(shared.value, h)
                    hot = shared.value[np.minimum(at, len(shared.value) - 1)] == h
                    h = np.concatenate([h[~hot], h[hot]])
                nodes.append(node)
                sizes.append(len(h))
                out.append(h[:k])
            many = [len(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(nodes, np.uint64).view(np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int32), many)), pa.array(np.concatenate([*out, np.zeros(0, np.int64)]))], names)

    return _texts(docs).mapInArrow(run, "node long, n int, run long")


def sets_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hs): the runs of some nodes, from one text each, read again."""
    nodes = cut(nodes.select("node").distinct())
    few = nodes.count() <= SENT
    wanted = sets.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").groupBy("node").agg(F.min("th").alias("th")).select("th").distinct()
    src = _texts(docs).join(F.broadcast(wanted) if few else wanted, "th", "left_semi")

    def run(batches):
        seen = set()
        for b in batches:
            hs = []
            for th, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if th not in seen:
                    seen.add(th)
                    hs.append(runs(t.as_py() or b""))
            yield pa.RecordBatch.from_arrays([_nodes(hs), _lists(hs)], ["node", "hs"])

    return src.select("th", "text").mapInArrow(run, "node long, hs array<long>").groupBy("node").agg(F.first("hs").alias("hs"))


def walk(nodes: np.ndarray, off: np.ndarray, flat: np.ndarray, group: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what is near among the sets flat[off[k]:off[k + 1]]; members of a group are connected already."""
    _, flat = np.unique(flat, return_inverse=True)
    sizes, a, b = np.diff(off), [], []
    rest, mark = np.arange(len(nodes)), np.zeros(int(flat.max()) + 1, bool)
    held, at = flat, off[:-1]

    def leave(stay):
        nonlocal rest, held, at
        held = held[np.repeat(stay, sizes[rest])]
        rest = rest[stay]
        at = np.concatenate([[0], np.cumsum(sizes[rest])])[:-1].astype(int)

    while len(rest):
        first = group[rest] == group[rest[0]]
        queue = rest[first].tolist()
        leave(~first)
        while queue and len(rest):
            i = queue.pop()
            mine = flat[off[i] : off[i + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[held].astype(np.int64), at)
            mark[mine] = False
            near = 9 * both >= 4 * (sizes[i] + sizes[rest])
            if near.any():
                a += [int(nodes[i])] * int(near.sum())
                b += nodes[rest[near]].tolist()
                near = np.isin(group[rest], group[rest[near]])
                queue += rest[near].tolist()
                leave(~near)
    return a, b


def dealt(members: DataFrame, most: int) -> DataFrame:
    """Adds `block` to rows (run, group, node, ..), which come in every block that they share with one of another
    group of their cell. A cell's largest group is cut in parts of about `most` rows, so are all others together; a block is
    a part of the largest and one of the others, or two of the others, and so never holds over about 2 * most rows."""
    sizes = members.groupBy("run", "group").agg(F.count(F.lit(1)).alias("m"))
    cells = sizes.groupBy("run").agg(F.max(F.struct("m", "group")).alias("top"), F.sum("m").alias("all"))
    part = lambda c: F.ceil(c / F.lit(float(most))).cast("int")
    cells = cells.select("run", F.col("top.group").alias("main"), F.greatest(part(F.col("top.m")), F.lit(1)).alias("mains"), part(F.col("all") - F.col("top.m")).alias("others"))
    each = members.join(cells, "run").where("others > 0")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    name = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_main = F.transform(count("mains"), lambda i: name(0, i, mine("others")))
    among = F.transform(count("others"), lambda j: name(1, F.least(j, mine("others")), F.greatest(j, mine("others"))))
    blocks = F.when(F.col("group") == F.col("main"), F.transform(count("others"), lambda j: name(0, mine("mains"), j))).otherwise(F.concat(with_main, among))
    return each.select(*members.columns, F.explode(blocks).alias("block")).repartition("run", "block")


def _walked(members: DataFrame, most: int) -> DataFrame:
    """Edges of each run's members (run, node, group, hs)."""

    def run(t: pa.Table) -> pa.Table:
        hs = t["hs"].combine_chunks()
        hs = hs.combine_chunks() if isinstance(hs, pa.ChunkedArray) else hs
        off = np.concatenate([[0], np.cumsum(hs.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
        a, b = walk(t["node"].to_numpy(), off, hs.flatten().to_numpy(), t["group"].to_numpy())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt(members.select("run", "node", "group", "hs"), most).groupBy("run", "block").applyInArrow(run, _EDGE)


def _hopeful(members: DataFrame, most: int) -> DataFrame:
    """Of each run's members (run, node, group, n, sk) those whose sketch allows a near copy in another group."""

    def run(t: pa.Table) -> pa.Table:
        sk = t["sk"].combine_chunks()
        sk = (sk.combine_chunks() if isinstance(sk, pa.ChunkedArray) else sk).flatten().to_numpy().view(np.uint64).reshape(-1, 16)  # bits of signed numbers are counted without the sign
        n, group = t["n"].to_numpy().astype(int), t["group"].to_numpy()
        keep = [bool(((group != group[i]) & (9 * np.bitwise_count(sk ^ sk[i]).sum(1, dtype=np.int64) <= n + n[i])).any()) for i in range(len(n))]
        return t.select(["run", "node", "group", "n"]).filter(pa.array(keep, pa.bool_()))

    return dealt(members.select("run", "node", "group", "n", "sk"), most).groupBy("run", "block").applyInArrow(run, "run long, node long, group long, n int").distinct()


def _near(a: str, b: str) -> Column:
    return 9 * F.size(F.array_intersect(a, b)) >= 4 * (F.size(a) + F.size(b))


def _grouped(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds each member's group so far to rows (run, node, ..) of the cells that hold several."""
    all_ = cut(cells.join(connected_components(edges), "node", "left").select(*cells.columns, F.coalesce("root", "node").alias("group")))
    several = all_.groupBy("run").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("run")
    return all_.join(several, "run", "left_semi")


def sliced(rows: DataFrame, key: str, nodes: list[str], known: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """make(rows, sets) of one slice of the values of key after the other; of known (node, hs) only sets that the slice names
    are on their way. `n` of a row are the runs that it brings; they tell how many slices there are. A slice is one statement."""
    n = min(SLICES, -(-(rows.agg(F.sum("n")).collect()[0][0] or 0) // max(FEW, 1)))
    if n <= 1:
        return cut(make(rows, known))
    at = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    named = cut(rows.select(at.alias("at"), F.explode(F.array(*nodes)).alias("node")).groupBy("node").agg(F.collect_set("at").alias("at")))  # n at most
    few = named.count() <= SENT

    def one(k: int) -> DataFrame:
        ids = named.where(F.array_contains("at", k)).select("node")
        return cut(make(rows.where(at == k), known.join(F.broadcast(ids) if few else ids, "node", "left_semi")))

    parts = [one(k) for k in range(n)]
    drop(named)
    return reduce(DataFrame.union, parts)


def checked(docs: DataFrame, sets: DataFrame, met: DataFrame) -> DataFrame:
    """Edges (a, b) of the rows (node, first) of met that are near copies."""
    met = cut(met)
    known = cut(sets_of(docs, sets, met.select(F.explode(F.array("node", "first")).alias("node"))))
    heads = known.select(F.col("node").alias("first"), F.col("hs").alias("other"))
    edges = cut(met.join(known, "node").join(heads, "first").where(_near("hs", "other")).select(F.col("node").alias("a"), F.col("first").alias("b")))
    drop(known, met)
    return edges


def components(docs: DataFrame, sets: DataFrame, cell: int = CELL, many: int = MANY, linked: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes of run_sets(docs) that have a near copy; root names the component. `linked`: edges (a, b)
    that are known to be near copies; what they connect is not compared again."""
    prepare(docs.sparkSession)
    hot = postings(docs, np.zeros(0, np.int64)).groupBy("run").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > cell)
    late = np.sort(hot.orderBy(F.desc("k"), "run").limit(LATE).select("run").toArrow()["run"].to_numpy())  # 8 bytes each, no rows
    lists = postings(docs, late).repartition("run").distinct().groupBy("run").agg(F.collect_list(F.struct("n", "node")).alias("l"))
    met = cut(lists.where(F.size("l") > 1))
    one = met.where(F.size("l") <= cell).select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b"))
    close = 5 * F.least("a.n", "b.n") >= 4 * F.greatest("a.n", "b.n")
    pairs = cut(one.where("a.node > b.node").where(close).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), (F.col("a.n") + F.col("b.n")).alias("n")).distinct())
    sketches = sets.groupBy("node").agg(F.first("sk").alias("sk"))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    side = lambda t, c, k: t.select(F.col("node").alias(k), F.col(c).alias(f"{c[0]}{k}"))
    hopeful = pairs.join(side(sketches, "sk", "a"), "a").join(side(sketches, "sk", "b"), "b").where(9 * apart <= F.col("n")).select("a", "b", "n")
    if linked is not None:
        groups = connected_components(linked)
        of = lambda k: groups.select(F.col("node").alias(k), F.col("root").alias(f"g{k}"))
        hopeful = hopeful.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b", "n")
    hopeful = cut(hopeful)
    drop(pairs)
    known = cut(sets_of(docs, sets, hopeful.select(F.explode(F.array("a", "b")).alias("node"))))
    edges = sliced(hopeful, "a", ["a", "b"], known, lambda part, mine: part.join(side(mine, "hs", "a"), "a").join(side(mine, "hs", "b"), "b").where(_near("ha", "hb")).select("a", "b"))
    drop(known, hopeful)
    if linked is not None:
        edges = edges.union(linked)
    big = cut(met.where(F.size("l") > cell).select("run", F.explode("l").alias("m")).select("run", "m.n", "m.node"))
    drop(met)
    if big.isEmpty():
        return connected_components(edges)
    # Each node in one of its large cells, against the cell's first: groups of copies are linked at once.
    known = cut(sets_of(docs, sets, big))
    once = big.groupBy("node").agg(F.min("run").alias("run"))
    firsts = once.groupBy("run").agg(F.min("node").alias("first"))
    heads = firsts.join(known.select(F.col("node").alias("first"), F.col("hs").alias("other")), "first")
    starred = once.join(known, "node").join(heads, "run").where("node <> first").where(_near("hs", "other")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    edges = edges.union(cut(starred))
    # Then, in all large cells, only members whose sketches allow a link to another group are compared.
    nodes = cut(_grouped(big, edges).join(sketches, "node"))
    left = cut(_hopeful(nodes, many))
    return connected_components(edges.union(sliced(left, "run", ["node"], known, lambda part, mine: _walked(part.join(mine, "node"), many))))
