"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

A row for each length that occurs: documents and tokens of that length, of at least it, and what is
left of the corpus if every document is cut to it. Suffix sums go by blocks of lengths, so no task
needs the whole histogram.

Defined cases: null and empty texts have length 0; repeated rows count each; an empty table gives an
empty histogram; columns beside text are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, prepare, table
from .wordbpe import default_path, encoder

BLOCK = 4096


def encoded_lengths(docs: DataFrame, path: str) -> DataFrame:
    """(length) of every row's text."""
    prepare(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for b in batches:
            for _, _, lens in enc.parts(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(lens)], ["length"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(length, docs, tokens, docs_at_least, tokens_at_least, tokens_if_cut, share_below) by length.

    tokens_if_cut is the sum of min(length, this length) over all documents, share_below the part of
    the documents that are shorter.
    """
    counts = cut(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("docs"))).select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.expr(f"length div {BLOCK}").alias("block"))
    blocks = counts.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(Window.partitionBy(F.lit(1))).alias("all_d"), F.sum("t").over(Window.partitionBy(F.lit(1))).alias("all_t"))
    own = Window.partitionBy("block").orderBy(F.desc("length"))
    out = counts.join(blocks, "block").withColumn("docs_at_least", F.sum("docs").over(own) + F.col("d_after")).withColumn("tokens_at_least", F.sum("tokens").over(own) + F.col("t_after"))
    return out.select("length", "docs", "tokens", "docs_at_least", "tokens_at_least", (F.col("all_t") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("tokens_if_cut"), ((F.col("all_d") - F.col("docs_at_least")) / F.col("all_d")).alias("share_below"))


def cut_total(hist: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left if documents are cut to `limit`, documents that it shortens, tokens lost."""
    longer = F.col("length") > limit
    return hist.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("docs")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(longer, F.col("docs"))), F.lit(0)).alias("docs_cut"), F.coalesce(F.sum(F.when(longer, (F.col("length") - limit) * F.col("docs"))), F.lit(0)).alias("tokens_lost"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a part q of the documents don't exceed."""
    total = F.max(F.col("docs_at_least"))
    all_docs = hist.agg(total.alias("n"))
    at_most = F.col("n") - F.col("docs_at_least") + F.col("docs")
    return hist.crossJoin(F.broadcast(all_docs)).where(at_most >= F.ceil(F.lit(q) * F.col("n"))).agg(F.min("length").alias("length"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(encoded_lengths(table(spark, sf_dir, "documents"), default_path()))
