"""Sharding by histogram sort: splitters of a hash order are probed until shards are of equal bytes.

The order is by a hash of the text, then by a hash of the id. Texts whose copies together hold over HEAVY of
a shard are few; each goes whole to the shard with the most room if it fits there, and only one that fits
nowhere is cut among its rows. For all others each round counts exact bytes below candidate boundaries inside
the intervals that still hold a splitter, for all splitters at once, and narrows them until what lies below a
boundary is within tolerance of its goal, or takes the nearer end of the one text that straddles it: copies
stay together. Then rows move once.

The main path has DataFrame operations only. Defined cases: a null text has no bytes and is equal to other
null texts only; rows of equal id and text are one key and stay together; ties in the order are rows of equal
hashes, told apart by id; an empty table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS, TOLERANCE, HEAVY = 8, 0.002, 0.01
#: Candidate boundaries for each open interval and round.
PROBES = 4096
#: Hash space of either level.
SPACE = 1 << 60


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, k1, k2) of every row."""
    text = F.col("text").cast("string").cast("binary")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    k1 = F.shiftrightunsigned(F.xxhash64("text"), 4)
    k2 = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("id")), 4)
    return docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(text), F.lit(0).cast("long")).alias("text_crc32"), k1.alias("k1"), k2.alias("k2"))


def probe(rows: DataFrame, key: str, goals: dict[int, float], slack: float) -> dict[int, int]:
    """For each goal (bytes from the start of `rows`) a boundary of `key`: what lies below it is within `slack` of
    the goal, or as near as the one key that straddles the goal allows."""
    open_ = {j: (0, SPACE, 0.0) for j in goals}
    done: dict[int, int] = {}
    while open_:
        spans = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        bucket = F.lit(None).cast("struct<i:int,b:bigint>")
        for i, (lo, hi) in enumerate(spans):
            width = -(-(hi - lo) // PROBES)
            bucket = F.when((F.col(key) >= lo) & (F.col(key) < hi), F.struct(F.lit(i).alias("i"), F.expr(f"({key} - {lo}L) div {width}L").alias("b"))).otherwise(bucket)
        counted = rows.select(bucket.alias("p"), F.col(key).alias("v"), "size").where("p is not null").groupBy("p.i", "p.b").agg(F.sum("size").alias("bytes"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # at most PROBES rows for each of a few spans
        bins = {s: {} for s in spans}
        for i, b, *found in counted:
            bins[spans[i]][b] = found
        for j, (lo, hi, before) in list(open_.items()):
            width, at = -(-(hi - lo) // PROBES), before
            for b in sorted(bins[(lo, hi)]):
                n, least, most = bins[(lo, hi)][b]
                start = lo + b * width
                if abs(at - goals[j]) <= slack:
                    done[j] = start
                elif abs(at + n - goals[j]) <= slack:
                    done[j] = min(start + width, hi)
                elif at + n <= goals[j]:
                    at += n
                    continue
                elif least == most:
                    done[j] = least if goals[j] - at <= at + n - goals[j] else least + 1
                else:
                    open_[j] = (start, min(start + width, hi), at)
                    break
                del open_[j]
                break
            else:
                done[j] = hi
                del open_[j]
    return done


def heavy_texts(rows: DataFrame, least: float) -> list[tuple[int, int]]:
    """(k1, bytes) of the texts whose rows hold over `least` bytes, largest first."""
    width = SPACE // PROBES
    bucket = F.expr(f"k1 div {width}L")
    full = [r[0] for r in rows.groupBy(bucket.alias("b")).agg(F.sum("size").alias("n")).where(F.col("n") > least).collect()]  # PROBES rows at most
    if not full:
        return []
    found = rows.where(bucket.isin(full)).groupBy("k1").agg(F.sum("size").alias("n")).where(F.col("n") > least).collect()  # fewer than all bytes over `least`
    return sorted(((r.k1, r.n) for r in found), key=lambda x: (-x[1], x[0]))


def place_heavy(heavy: list[tuple[int, int]], shards: int, mean: float, slack: float) -> tuple[list[float], dict[int, list[tuple[int, float]]]]:
    """(room left in each shard, (shard, bytes of it there) for each heavy text): whole where one fits."""
    room, out = [mean] * shards, {}
    for k, n in heavy:
        j = max(range(shards), key=lambda i: room[i])
        if n <= room[j] + slack:
            out[k] = [(j, n)]
            room[j] -= n
            continue
        out[k], left = [], float(n)
        for j in sorted(range(shards), key=lambda i: -room[i]):
            part = min(left, max(room[j], 0.0))
            if part > slack:
                out[k].append((j, part))
                room[j] -= part
                left -= part
        j, part = out[k][-1]
        out[k][-1] = (j, part + left)
    return room, out


def assign(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds shard and slot. `rows` are keyed() and read once a round."""
    spark = rows.sparkSession
    mean = (rows.agg(F.sum("size")).collect()[0][0] or 0) / shards
    slack = tolerance * mean
    heavy = heavy_texts(rows, HEAVY * mean)
    room, placed = place_heavy(heavy, shards, mean, slack)
    light = rows.where(~F.col("k1").isin([k for k, _ in heavy])) if heavy else rows
    found = probe(light, "k1", {j: sum(max(r, 0.0) for r in room[:j]) for j in range(1, shards)}, slack) if mean else {}
    shard: Column = F.lit(0)
    for j in sorted(found):
        shard = shard + (F.col("k1") >= found[j]).cast("int")
    if heavy:  # shards / HEAVY rows at most
        table_ = []
        for k, parts in placed.items():
            goals = {i: sum(n for _, n in parts[:i]) for i in range(1, len(parts))}
            cuts = probe(rows.where(F.col("k1") == k), "k2", goals, slack) if goals else {}
            table_.append((k, [cuts[i] for i in sorted(cuts)], [j for j, _ in parts]))
        at = spark.createDataFrame(table_, "k1 long, cuts array<long>, js array<int>")
        rows = rows.join(F.broadcast(at), "k1", "left")
        own = F.get("js", F.size(F.filter("cuts", lambda c: c <= F.col("k2"))))
        cells = rows.withColumn("shard", F.coalesce(own, shard)).drop("cuts", "js")
    else:
        cells = rows.withColumn("shard", shard)
    # In a shard rows stand by the top bits of their text's hash, then by a salt, so no group is large.
    cells = cells.withColumn("cell", F.shiftright("k1", 48) * 64 + F.shiftright("k2", 54))
    first = cells.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    part = first.groupBy("shard", F.shiftright("cell", 6).alias("block")).agg(F.sum("n").alias("m"))
    part = part.select("shard", "block", (F.sum("m").over(Window.partitionBy("shard").orderBy("block")) - F.col("m")).alias("before"))
    inner = Window.partitionBy("shard", "block").orderBy("cell")
    first = first.withColumn("block", F.shiftright("cell", 6)).join(part, ["shard", "block"]).select("shard", "cell", (F.col("before") + F.sum("n").over(inner) - F.col("n")).alias("first"))
    order = Window.partitionBy("shard", "cell").orderBy("k1", "k2", "doc_id", "text_crc32")
    return cells.withColumn("r", F.row_number().over(order)).join(first, ["shard", "cell"]).withColumn("slot", F.col("first") + F.col("r") - 1).drop("r", "first", "cell")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(keyed(table(spark, sf_dir, "documents")))
    return assign(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
