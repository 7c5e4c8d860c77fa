"""Readers and writers of record files, truth lists, record tables and result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_indic, latin_fold, with_views
from .store import Files

# Headers of the files.
RECORD = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")


class RecordError(ValueError):
    """A file or table breaks its format."""


def _lines(spark: SparkSession, path: str, header: tuple[str, ...]) -> DataFrame:
    """(line, cells) of a tab-separated file's rows that aren't blank, the line numbers counted from 1; the header is checked."""
    text = spark.read.text(path)
    head = text.limit(1).collect()
    said = [c.strip().lower() for c in head[0][0].split("\t")] if head else []
    if said != list(header):
        raise RecordError(f"header of {path} is not {header}" + (": it looks comma-separated" if head and "\t" not in head[0][0] and "," in head[0][0] else ""))
    rows = text.where(F.trim("value") != "").select(F.split("value", "\t").alias("cells"))
    wide = rows.where(F.size("cells") != len(header)).limit(1).collect()
    if wide and len(header) > 2:
        number = _line_of(text, "\t".join(wide[0].cells))
        raise RecordError(f"{path}, line {number}: {len(wide[0].cells)} columns, not {len(header)}")
    return rows


def _line_of(text: DataFrame, line: str) -> int:
    """The number of the first line that reads so: lines before it are counted, split by split."""
    at = text.select(F.col("value"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    first = at.where(F.col("value") == line).orderBy("block", "k").first()
    return at.where((F.col("block") < first.block) | ((F.col("block") == first.block) & (F.col("k") <= first.k))).count()


def read_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Tab-separated records of one source, validated: header, width, id prefix `tag-`, no repeated id. Empty cells stay '',
    blank lines are skipped."""
    cells = _lines(spark, path, RECORD)
    rows = cells.select(*[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(RECORD)]).where(F.lower(F.trim("entity_id")) != RECORD[0])
    bad = rows.agg(F.count_if(~F.startswith("entity_id", F.lit(f"{tag}-"))), F.count(F.lit(1)) - F.count_distinct("entity_id")).collect()[0]
    if bad[0] or bad[1]:
        raise RecordError(f"{path}: {bad[0]} ids without the prefix {tag}-, {bad[1]} repeated ids")
    return rows


def record_views(rows: DataFrame) -> DataFrame:
    """Adds normalised, Latin and folded views and script flags to (.., name_raw, addr_raw)."""
    out = with_views(rows, name="name_raw", addr="addr_raw")
    return out.withColumns({"name_fold": latin_fold(F.col("name_norm")), "addr_fold": latin_fold(F.col("addr_norm")), "name_indic": is_indic(F.col("name_raw")), "addr_indic": is_indic(F.col("addr_raw")), "addr_missing": F.trim("addr_raw") == ""})


def with_ordinals(rows: DataFrame, key: str) -> DataFrame:
    """Adds `ordinal`, a gapless number from 0 in the order of `key`: rows are counted in ranges of the key, then numbered
    inside each, so no task has them all. Rows of one key have any order among them."""
    spread = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    from .store import written

    kept = written(spread)
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("from")).collect()  # a row for each partition
    first, starts = 0, {}
    for r in sorted(sizes, key=lambda r: r.part):
        starts[r.part] = first - r["from"]
        first += r.n
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("part")) if starts else F.lit(0)
    return kept.withColumn("ordinal", (F.col("at") + shift).cast("long")).drop("part", "at")


# The columns of a record table.
RECORD_TABLE = ("ordinal", "entity_id", "name_raw", "addr_raw", "name_norm", "addr_norm", "name_fold", "addr_fold", "country", "name_indic", "addr_indic", "addr_missing")


def write_records(spark: SparkSession, path: str, tag: str, to: str) -> DataFrame:
    """The record table of a source file at `to`, which is replaced: views, flags and ordinals in the order of the ids."""
    rows = read_records(spark, path, tag).select("entity_id", F.col("business_name").alias("name_raw"), F.col("business_address").alias("addr_raw"), "country")
    with_ordinals(record_views(rows), "entity_id").select(*RECORD_TABLE).write.mode("overwrite").option("compression", "zstd").parquet(to)
    return spark.read.parquet(to)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, tgt_ids) of a two-column list; an empty cell is an empty list, ids are not trimmed, repeats fail."""
    cells = _lines(spark, path, TRUTH).select(F.get("cells", F.lit(0)).alias("ref_id"), F.coalesce(F.get("cells", F.lit(1)), F.lit("")).alias("ids"))
    out = cells.where(F.lower(F.trim("ref_id")) != TRUTH[0]).select("ref_id", F.filter(F.split("ids", ","), lambda x: x != "").alias("tgt_ids"))
    bad = out.agg(F.count(F.lit(1)) - F.count_distinct("ref_id"), F.count_if(F.size("tgt_ids") != F.size(F.array_distinct("tgt_ids")))).collect()[0]
    if bad[0] or bad[1]:
        raise RecordError(f"{path}: {bad[0]} repeated rows, {bad[1]} lists with a repeated id")
    return out


def write_truth(truth: DataFrame, to: str) -> None:
    """A truth table: rows (ref_id, tgt_ids) as two columns of text, ids joined by commas, in the order of the references."""
    rows = truth.select(F.col("ref_id").cast("string").alias(TRUTH[0]), F.array_join(F.col("tgt_ids").cast("array<string>"), ",").alias(TRUTH[1]))
    rows.orderBy(TRUTH[0]).write.mode("overwrite").option("compression", "zstd").parquet(to)


def read_truth_table(spark: SparkSession, at: str) -> DataFrame:
    """(ref_id, tgt_ids) of write_truth()."""
    return spark.read.parquet(at).select(F.col(TRUTH[0]).alias("ref_id"), F.filter(F.split(TRUTH[1], ","), lambda x: x != "").alias("tgt_ids"))


def links(truth: DataFrame) -> DataFrame:
    return truth.select("ref_id", F.explode("tgt_ids").alias("tgt_id"))


def sample_rows(rows: DataFrame, wanted: DataFrame, key: str = "entity_id") -> DataFrame:
    """The rows whose key is wanted, each once however often it is wanted."""
    return rows.join(wanted.select(key), key, "left_semi")


def id_lists(required: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(ref_id, name): sorted comma lists of different ids, '' for references without a pair."""
    lists = pairs.groupBy("ref_id").agg(F.array_join(F.array_sort(F.collect_set("tgt_id")), ",").alias(name))
    return required.select("ref_id").join(lists, "ref_id", "left").select("ref_id", F.coalesce(name, F.lit("")).alias(name))


def scored_lists(required: DataFrame, scored: DataFrame) -> DataFrame:
    """(ref_id, matches, candidates): of scored edges (ref_id, tgt_id, selected) all as candidates, the selected as
    matches; a row for every required reference. Edges of a reference that isn't required fail."""
    strange = scored.join(required, "ref_id", "left_anti").select("ref_id").limit(1).collect()
    if strange:
        raise RecordError(f"scored edge of the unknown reference {strange[0].ref_id}")
    ids = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    name = F.col("tgt_id").cast("string")
    lists = scored.groupBy("ref_id").agg(ids(F.when(F.col("selected"), name)).alias("matches"), ids(name).alias("candidates"))
    return required.select("ref_id").join(lists, "ref_id", "left").na.fill("", ["matches", "candidates"])


def write_lists(lists: DataFrame, path: str, header: tuple[str, str]) -> None:
    """A folder of tab-separated list files, ordered by reference, each with the header."""
    lists.toDF(*header).orderBy(header[0]).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "\u0000").csv(path)


def write_list_file(lists: DataFrame, path: str, header: tuple[str, str]) -> None:
    """One file of the lists, in the order of the references: sorted parts are written by all tasks and then put one after
    the other on the shared file system, never gathered in one process."""
    spark = lists.sparkSession
    files, beside = Files(spark), f"{path}.parts"
    a, b = lists.columns[:2]
    lists.orderBy(a).select(F.concat_ws("\t", F.col(a).cast("string"), F.coalesce(F.col(b).cast("string"), F.lit("")))).write.mode("overwrite").text(beside)
    p, fs = files._at(path)
    out, jvm = fs.create(p, True), spark._jvm
    try:
        out.write(("\t".join(header) + "\n").encode())
        for name in files.names(beside):
            if name.startswith("part-"):
                part = fs.open(files._at(f"{beside}/{name}")[0])
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                finally:
                    part.close()
    finally:
        out.close()
    files.delete(beside)


def write_scored_outputs(required: DataFrame, scored: DataFrame, folder: str) -> int:
    """matching_results.tsv and candidate_pairs.tsv of scored edges; how many references have a match."""
    from .store import written

    lists = written(scored_lists(required, scored))
    write_list_file(lists.select("ref_id", "matches"), f"{folder}/matching_results.tsv", TRUTH)
    write_list_file(lists.select("ref_id", "candidates"), f"{folder}/candidate_pairs.tsv", CANDIDATES)
    return lists.where("matches <> ''").count()


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)
