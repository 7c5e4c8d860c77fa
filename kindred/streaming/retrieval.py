"""Retrieval for a stream of targets against a static reference collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.retrieval import candidate_edges


def stream_candidates(targets: DataFrame, refs: DataFrame, to: str, checkpoint: str, **options):
    """Writes the candidates of each micro-batch of `targets` to a folder of its own under `to`; a batch that runs
    again replaces its folder. Returns the started query."""

    def batch(df: DataFrame, number: int) -> None:
        both = refs.where(F.col("src") == 1).unionByName(df.where(F.col("src") > 1))
        candidate_edges(both, **options).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return targets.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
