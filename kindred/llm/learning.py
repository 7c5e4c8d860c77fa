"""What the two text models share: a bounded labelled sample, its features, and one fitting task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, prepare
from .textfeat import ngram_keys

#: Features of all rows that a fit reads, four bytes each: with the rows it bounds the memory of the one fitting task.
FEATURES = 16_000_000


def labelled_sample(labels: DataFrame, target: str, most: int) -> DataFrame:
    """At most `most` labelled ids, chosen by a hash of the id: (id, y).

    Only ids whose crc32 of the id as text leaves 0 or 2 modulo 3 may teach. Null ids or labels and
    ids with contradicting labels teach nothing.
    """
    return (
        labels.select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (~held_out("id")))
        .groupBy("id")
        .agg(F.min("y").alias("y"), F.max("y").alias("y2"))
        .where("y = y2")
        .select("id", "y")
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_in_one_task(docs: DataFrame, sample: DataFrame, fit: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes], bits: int, most: int = FEATURES, **features) -> bytes | None:
    """Features of the sampled documents, made where the documents are, then fitted by one task.

    The sample is bounded by its caller, hence broadcast and gathered; besides, ids are taken in the order of
    a hash while their rows hold `most` features together, those with over a hundredth of it left out.
    `fit` gets labels, row pointers and feature ids; None if nothing is labelled.
    """
    prepare(docs.sparkSession)
    joined = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("t")).join(F.broadcast(sample), "id").select("id", "t", "y")

    def featurise(batches):
        for b in batches:
            rows, idx = ngram_keys(b.column(1), bits, **features)
            ptr = np.searchsorted(rows, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(idx, pa.int32()))], ["id", "y", "f"])

    def train(batches):
        ids, ys, fs, lens = [], [], [], []
        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            ys.append(b.column(1).to_numpy(zero_copy_only=False))
            fs.append(b.column(2).flatten().to_numpy())
            lens.append(b.column(2).value_lengths().to_numpy(zero_copy_only=False))
        if not ids:
            return
        ids, y, lens, flat = np.concatenate(ids), np.concatenate(ys), np.concatenate(lens), np.concatenate(fs)
        del fs, ys
        order = np.lexsort((lens, ids))  # the same rows in the same order whatever the partitions
        at, ptr = np.cumsum(lens) - lens, np.concatenate([[0], np.cumsum(lens[order])])
        sorted_ = np.concatenate([flat[a : a + n] for a, n in zip(at[order].tolist(), lens[order].tolist(), strict=True)])
        del flat
        yield pa.RecordBatch.from_arrays([pa.array([fit(y[order], ptr, sorted_)], pa.binary())], ["model"])

    feats = cut(joined.mapInArrow(featurise, f"id {dict(joined.dtypes)['id']}, y int, f array<int>"))
    sizes = feats.groupBy("id").agg(F.xxhash64("id").alias("h"), F.sum(F.size("f") + 1).alias("n")).orderBy("h", "id").collect()  # as many rows as the sample
    taken = [r for r in sizes if r.n <= most // 100]
    total = np.cumsum([r.n for r in taken])
    fits = [(r.id,) for r, n in zip(taken, total, strict=True) if n <= most]
    if len(fits) < len(sizes):
        feats = feats.join(F.broadcast(docs.sparkSession.createDataFrame(fits, feats.select("id").schema)), "id")
    got = feats.select("id", "y", "f").repartition(1).mapInArrow(train, "model binary").collect()
    drop(feats)
    return bytes(got[0][0]) if got else None
