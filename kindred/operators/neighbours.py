"""Exact nearest rows by cosine for a stated set of queries, a block of queries at a time."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the rows compares: they bound what is sent to the tasks.
BLOCK = 2000


def cosine_topk(rows: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, cosine) of rows (vec_id, embedding): the k nearest others of each query by cosine, rounded to
    nine places before it is ranked, ties to the smaller id. Null and zero vectors take no part."""
    spark = rows.sparkSession
    ok = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull())
    v = rows.where(ok).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    ids = v.where(is_query).select("vec_id")
    parts = max(1, -(-ids.count() // block))
    out = []
    for p in range(parts):
        mine = v.where(is_query & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p)).collect()  # about a block
        if not mine:
            continue
        q = np.array([r.v for r in mine])
        shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in mine]), q / np.linalg.norm(q, axis=1, keepdims=True)))

        def near(batches, shared=shared):
            names, unit = shared.value
            for b in batches:
                x = np.array(b["v"].tolist())
                c = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ unit.T, 9)
                own = b["vec_id"].to_numpy()
                c[own[:, None] == names[None, :]] = -np.inf
                m = min(k, len(own))
                order = np.lexsort((np.broadcast_to(own[:, None], c.shape), -c), axis=0)[:m]
                got = np.take_along_axis(c, order, 0)
                keep = np.isfinite(got)
                yield pd.DataFrame({"query_id": np.broadcast_to(names, got.shape)[keep], "vec_id": own[order][keep], "cosine": got[keep]})

        out.append(v.mapInPandas(near, "query_id long, vec_id long, cosine double"))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, cosine double")
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return functools.reduce(DataFrame.union, out).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")
