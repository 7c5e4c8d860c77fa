"""Best-fit packing by patterns: documents, cut into pieces of at most one sequence, share sequences.

Lengths are at most the sequence length, so their histogram has a fixed size whatever the corpus.
On it, patterns of two to four pieces that fill a sequence exactly are enumerated, their repeat
counts fitted by non-negative least squares and rounded within supply, and what is left is packed
best-fit decreasing, whole classes of equal gaps at a time. Every piece then finds its place from its
rank among pieces of its length: pieces are ranked in salted groups, so no length is hot.

Defined cases: a null text is an empty one, which has one piece of the closing id alone; repeated rows
are packed each; null ids are carried; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, prepare, table
from .wordbpe import default_path, encoder

SEQUENCE = 2048
#: Groups in which the pieces of one length are ranked: so many, and more where a group would hold over GROUP pieces.
SALTS, GROUP, LOTS = 64, 50_000, 1024
#: The most frequent lengths, of which patterns of three and of four are built.
TRIPLE_LENGTHS, FOUR_LENGTHS = 64, 16


def tokenise(docs: DataFrame, path: str, limit: int = SEQUENCE, closing: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, lot) of every piece of every row; lots differ among equal rows of a task."""
    prepare(docs.sparkSession)
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        enc, lot = encoder(path), 0
        for first, ids, lens, b in ((*part, b) for b in batches for part in enc.parts(b.column(1))):
            lens = lens + 1
            count = -(-lens // limit)
            row = np.repeat(np.arange(len(lens)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * limit
            length = np.minimum(limit, lens[row] - start)
            closed = np.empty(len(ids) + len(lens), "<u4")
            ends = np.cumsum(lens)
            body = np.ones(len(closed), bool)
            body[ends - 1] = False
            closed[body], closed[ends - 1] = ids, closing
            at = (ends - lens)[row] + start
            crc = [zlib.crc32(closed[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            lots = pa.array((lot + np.arange(len(row))) % LOTS, pa.int32())
            lot += len(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), lots], ["doc_id", "piece", "start", "length", "ids_crc32", "lot"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, lot int")


def exact_patterns(hist: np.ndarray) -> np.ndarray:
    """Rows (a, b, c, d), falling, the last may be 0, of lengths in the histogram that fill a sequence."""
    limit = len(hist) - 1
    a = np.arange(1, limit // 2 + 1)
    found = [np.stack([limit - a, a, 0 * a, 0 * a], 1)]
    for size, most in ((3, TRIPLE_LENGTHS), (4, FOUR_LENGTHS)):
        top = np.argsort(-hist[:limit], kind="stable")[:most]
        top = top[(top > 0) & (hist[top] > 0)]
        each = np.stack([x.ravel() for x in np.meshgrid(*[top] * (size - 1))], 1)
        last = limit - each.sum(1)
        whole = np.zeros((int((last > 0).sum()), 4), np.int64)
        whole[:, : size - 1], whole[:, size - 1] = each[last > 0], last[last > 0]
        found.append(-np.sort(-whole, axis=1))
    found = np.unique(np.concatenate(found), axis=0)
    need = np.where(found > 0, hist[found] > 0, True)
    return found[need.all(1)]


def fit_counts(patterns: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of pattern counts against the histogram, by projected accelerated gradients."""
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0

    def apply(x):
        return np.bincount(patterns[used], np.repeat(x[:, None], patterns.shape[1], 1)[used], len(hist))

    ones = np.ones(len(patterns))
    norm = max(float((apply(ones)[patterns] * used).sum(1).max()), 1.0)  # bounds the largest eigenvalue
    x = momentum = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        r = apply(momentum) - hist
        new = np.maximum(momentum - (r[patterns] * used).sum(1) / norm, 0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many sequences), using up the histogram exactly. hist[n]: pieces of length n."""
    limit, left, out = len(hist) - 1, hist.astype(np.int64).copy(), []
    if left[limit]:
        out.append(((limit,), int(left[limit])))
        left[limit] = 0
    patterns = exact_patterns(left)
    counts = np.floor(fit_counts(patterns, left.astype(float)) + 0.5).astype(np.int64)
    for i in np.argsort(-counts, kind="stable"):
        if not counts[i]:
            break
        p = [int(n) for n in patterns[i] if n]
        c = int(min(counts[i], *(left[n] // p.count(n) for n in p)))
        if c > 0:
            out.append((tuple(p), c))
            for n in p:
                left[n] -= c
    gaps: list[dict[tuple[int, ...], int]] = [{} for _ in range(limit + 1)]  # open sequences by what they still hold
    room = np.zeros(limit + 1, bool)

    def put(p: tuple[int, ...], c: int) -> None:
        g = limit - sum(p)
        gaps[g][p] = gaps[g].get(p, 0) + c
        room[g] = True

    for n in range(limit - 1, 0, -1):
        c = int(left[n])
        while c:
            at = np.flatnonzero(room[n:])
            if not len(at):
                each = limit // n
                if c >= each:
                    put((n,) * each, c // each)
                if c % each:
                    put((n,) * (c % each), 1)
                break
            g = int(at[0]) + n
            p, have = gaps[g].popitem()
            room[g] = bool(gaps[g])
            m = min(c, have)
            if m < have:
                gaps[g][p] = have - m
                room[g] = True
            put((*p, n), m)
            c -= m
    return out + [(p, c) for g in gaps for p, c in g.items()]


def places(plans: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for p, c in plans:
        at = 0
        for n in p:
            rows.append((n, taken.get(n, 0), base, at))
            taken[n] = taken.get(n, 0) + c
            at += n
        base += c
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, limit: int = SEQUENCE, salts: int = SALTS) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, piece, .., length, lot) instead of lot. Reads `pieces`, a written table, three times."""
    spark = prepare(pieces.sparkSession)
    hist = np.zeros(limit + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():  # at most `limit` rows
        hist[n] = c
    salts = max(salts, -(-int(hist.max()) // GROUP))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "lot"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
    shared = spark.sparkContext.broadcast(places(plan(hist)))
    near = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "lot")
    ranked = salted.withColumn("k", F.row_number().over(near)).join(counts.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.select(*[c for c in pieces.columns if c != "lot"], (F.col("before") + F.col("k") - 1).alias("rank"))

    def run(batches):
        where = shared.value
        key = (where[:, 0] << 44) | where[:, 1]
        for b in batches:
            n, r = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            i = np.searchsorted(key, (n << 44) | r, "right") - 1
            cols = [*b.columns[:-1], pa.array(where[i, 2] + r - where[i, 1]), pa.array(where[i, 3])]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes[:-1])
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, limit: int = SEQUENCE) -> DataFrame:
    return pack(cut(tokenise(docs, path, limit)), limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and place."""
    return pack_documents(docs, default_path())
