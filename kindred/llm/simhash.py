"""SimHash near-duplicates: fingerprints linked at few differing bits, through a segment-popcount embedding.

A fingerprint's 32 segments of two bits have popcounts 0 to 2. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints. Vectors within distance 2 differ in at
most two coordinates, so they agree in a cell of at least one of 15 grids, each of which leaves out
two of six blocks of coordinates. Candidates from a cell pass the Manhattan bound, then the exact test.

Cells of over CELL different fingerprints aren't paired but divided along all coordinates: vectors within
distance 2 have a vector within distance 1 of both between them, so members meet under the at most 65 vectors
within distance 1 of theirs. Should such a finer cell be over CELL too, its members are linked by bits: two
fingerprints differ in at most two bits exactly if the one or a flip of one of its bits equals the other or a
flip of one of its bits. Nothing is dropped and no cell is quadratic.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; equal
fingerprints are one node; a component whose ids are all null has a null id; repeated rows share
their component; columns beside doc_id and text are ignored by the query and kept by the stage.

The pipeline's stage finds candidates in this same way, and takes those for near copies whose sets of five-word runs are
alike. Near copies whose fingerprints differ in more bits are then found by their sets (nearcopies).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, prepare, table
from .components import connected_components
from .nearcopies import checked, components, run_sets

SHINGLE, SEED, BITS = 3, 42, 2
CELL = 32
_LOW = 0x5555555555555555
_BLOCKS = (6, 6, 5, 5, 5, 5)


def fingerprint(text: bytes, n: int = SHINGLE, step: int = 1 << 16) -> int:
    """Bit k is set if it is in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > n:
        starts, ends = starts[: 1 - n], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), step):
        h = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i : i + step].tolist(), ends[i : i + step].tolist(), strict=True)]
        ones += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp) of every row: th is a hash of the text, fp the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    src = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or b"") for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "th", "fp"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, th long, fp long")


def embedding(fp):
    """Popcounts of two-bit segments in unary, so the Manhattan distance is the bit count of an exclusive or."""
    low, odd = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    both, any_ = fp.bitwiseAND(odd).bitwiseAND(low), fp.bitwiseOR(odd).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(any_)


def grids() -> list[int]:
    """Signed masks of the coordinates that each grid keeps."""
    ends = np.cumsum(_BLOCKS)
    block = [sum(3 << (2 * k) for k in range(e - n, e)) for n, e in zip(_BLOCKS, ends, strict=True)]
    masks = [sum(block) - block[i] - block[j] for i in range(6) for j in range(i)]
    return [_signed(m) for m in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def paired(cells: DataFrame) -> DataFrame:
    """Edges (a, b) of the members of small cells (l: fingerprints) that are near: first the Manhattan bound, then the bits."""
    pairs = cells.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a > b")
    bound = F.bit_count(embedding(F.col("a")).bitwiseXOR(embedding(F.col("b")))) <= BITS
    return pairs.where(bound).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)


def beside(e: Column) -> Column:
    """The vectors within Manhattan distance 1 of a vector in unary: each segment is 0, 1 or 3."""
    out = [e]
    for k in range(32):
        low, high = (_signed(1 << (2 * k + i)) for i in (0, 1))
        none, full = e.bitwiseAND(F.lit(low)) == 0, e.bitwiseAND(F.lit(high)) != 0
        out += [F.when(none, e.bitwiseOR(F.lit(low))).otherwise(F.when(full, e.bitwiseXOR(F.lit(high))).otherwise(e.bitwiseXOR(F.lit(low))))]
        out += [F.when(none | full, F.lit(None).cast("long")).otherwise(e.bitwiseOR(F.lit(high)))]
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect exactly the different fingerprints (fp) within two bits of one another, each
    pair directly or through common neighbours."""
    emb = fps.select("fp", embedding(F.col("fp")).alias("e"))
    keys = emb.select("fp", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in grids()])).alias("grid", "cell"))
    counts = keys.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keys.join(counts, ["grid", "cell"])
    near = paired(shared.where(F.col("n") <= cell).groupBy("grid", "cell").agg(F.collect_list("fp").alias("l")))
    full = cut(shared.where(F.col("n") > cell).select("fp").distinct())
    if full.isEmpty():
        return near
    finer = full.select("fp", F.explode(beside(embedding(F.col("fp")))).alias("key"))
    met = finer.join(finer.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    near = near.union(paired(met.where(F.col("n") <= cell).groupBy("key").agg(F.collect_list("fp").alias("l"))))
    flips = [0, *[_signed(1 << k) for k in range(64)]]
    hot = met.where(F.col("n") > cell).select("fp").distinct()
    same = hot.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(f)) for f in flips])).alias("key")).groupBy("key").agg(F.collect_list("fp").alias("l")).where(F.size("l") > 1)  # 65 at most
    return near.union(same.select(F.explode("l").alias("a"), F.array_min("l").alias("b")).where("a <> b"))


def roots(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """(fp, root, component_id) of each different fingerprint of rows (doc_id, fp)."""
    ids = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = connected_components(links(ids.select("fp"), cell)).select(F.col("node").alias("fp"), "root")
    at = cut(ids.join(comps, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    return at.join(at.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near(docs: DataFrame, sets: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) of nodes of run_sets(docs): of each component of fingerprints every node that is a near copy of its first."""
    comps = connected_components(links(cut(sets.select("fp").distinct()), cell)).select(F.col("node").alias("fp"), "root")
    rooted = cut(sets.select("node", "fp").distinct().join(comps, "fp", "left").select("node", F.coalesce("root", "fp").alias("root")).distinct())
    firsts = rooted.groupBy("root").agg(F.min("node").alias("first"))
    return checked(docs, sets, rooted.join(firsts, "root").where("node <> first").select("node", "first").distinct())


def hexed(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = cut(fingerprints(table(spark, sf_dir, "documents")).drop("th"))
    return fps.join(roots(fps), "fp").select("doc_id", hexed("fp").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id's; of several texts under it, that of the smallest hash."""
    sets = cut(run_sets(docs))
    rooted = cut(sets.select("doc_id", "th", "node").join(components(docs, sets, linked=near(docs, sets)), "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    at = rooted.join(least, "root").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = cut(at.groupBy("root").agg(F.min("doc_id").alias("k_id"), F.min("th").alias("k_th"), F.count(F.lit(1)).alias("k_n")))
    h = fresh(docs, "text_hash")
    rows = docs.withColumn(h, F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(kept["k_id"]) & (rows[h] == kept["k_th"])
    if kept.where("k_n > 1").isEmpty():
        return rows.join(kept, same, "left_semi").drop(h)
    # Some ids repeat: what stands several times is reduced to one row.
    found = rows.join(kept, same).drop("k_id", "k_th")
    single = found.where("k_n = 1").select(*[found[c] for c in docs.columns])
    again = found.where("k_n > 1").select(F.col("doc_id").alias("i"), F.col(h).alias("h"), F.struct(*[F.col(c) for c in docs.columns]).alias("r"))
    return single.union(again.groupBy("i", "h").agg(F.first("r").alias("r")).select("r.*"))
