"""Checks of exported lists, as rows (severity, check, entity, detail); no rows of severity `error` mean that all hold."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.records import CANDIDATES, TRUTH
from ..sources.store import Files

COLUMNS = ("severity", "check", "entity", "detail")


def _row(df: DataFrame, check: str, entity: str = "ref_id", detail: str | None = None, severity: str = "error") -> DataFrame:
    text = F.col(detail).cast("string") if detail else F.lit("")
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.col(entity).cast("string").alias("entity"), text.alias("detail"))


def list_violations(required: DataFrame, lists: DataFrame, name: str, known: DataFrame | None, foreign: Column | None = None, own: Column | None = None) -> DataFrame:
    """Of lists (ref_id, ids): missing, repeated and unrequired rows; in lists repeated ids, ids of the references' own
    source (`own`, of tgt_id; unless given, the row's own id), ids of no source (`foreign`), unknown ids."""
    each = lists.select("ref_id", F.explode("ids").alias("tgt_id"))
    own = F.col("ref_id").cast("string") == F.col("tgt_id").cast("string") if own is None else own
    other = each.where(~own)
    out = [
        _row(required.join(lists, "ref_id", "left_anti"), f"{name} row missing"),
        _row(lists.select("ref_id").distinct().join(required, "ref_id", "left_anti"), f"{name} row not required"),
        _row(lists.groupBy("ref_id").count().where("count > 1"), f"{name} row repeated"),
        _row(each.groupBy("ref_id", "tgt_id").count().where("count > 1"), f"{name} id repeated", detail="tgt_id"),
        _row(each.where(own).distinct(), f"{name} of itself", detail="tgt_id"),
    ]
    if foreign is not None:
        out.append(_row(other.where(foreign).distinct(), f"{name} id of no source", detail="tgt_id"))
        other = other.where(~foreign)
    if known is not None:
        out.append(_row(other.distinct().join(known, "tgt_id", "left_anti"), f"{name} id unknown", detail="tgt_id"))
    return functools.reduce(DataFrame.union, out)


def outside(matches: DataFrame, candidates: DataFrame, severity: str = "error") -> DataFrame:
    """Matches that their reference's candidates lack."""
    pairs = lambda lists: lists.select("ref_id", F.explode("ids").alias("tgt_id"))
    return _row(pairs(matches).join(pairs(candidates), ["ref_id", "tgt_id"], "left_anti").distinct(), "match outside the candidates", detail="tgt_id", severity=severity)


def violations(required: DataFrame, matches: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(severity, check, entity, detail) of match and candidate lists (ref_id, ids) against required (ref_id) and known (tgt_id)."""
    return list_violations(required, matches, "match", known).union(list_violations(required, candidates, "candidate", known)).union(outside(matches, candidates))


def support_difference(ledger: DataFrame, exported: DataFrame) -> DataFrame:
    """(side, ref_id, tgt_id) of pairs that stand more often on one side."""
    a, b = ledger.select("ref_id", "tgt_id"), exported.select("ref_id", "tgt_id")
    return a.exceptAll(b).withColumn("side", F.lit("ledger")).union(b.exceptAll(a).withColumn("side", F.lit("exported"))).select("side", "ref_id", "tgt_id")


def read_lists(spark: SparkSession, path: str, header: tuple[str, str]) -> tuple[DataFrame | None, str]:
    """(rows (ref_id, ids, tabbed), '') of a list file, or (None, what is wrong with it). Blank lines are skipped."""
    if not Files(spark).exists(path):
        return None, "file missing"
    text = spark.read.text(path)
    head = text.limit(1).collect()
    if not head:
        return None, "file empty"
    if "\t" not in head[0][0] and "," in head[0][0]:
        return None, "header looks comma-separated"
    if [c.strip().lower() for c in head[0][0].split("\t")] != list(header):
        return None, "header wrong"
    left = F.substring_index("value", "\t", 1)
    rest = F.substring("value", F.length(left) + 2, F.length("value"))
    ids = F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    rows = text.where(F.trim("value") != "").where(F.lower(F.trim(left)) != header[0])
    return rows.select(left.alias("ref_id"), ids.alias("ids"), F.contains("value", F.lit("\t")).alias("tabbed")), ""


def _files(spark: SparkSession, matching: str, candidate: str | None, required: DataFrame, known: DataFrame | None, soft: bool) -> DataFrame:
    out, read = [], {}
    fact = lambda severity, check, entity: spark.createDataFrame([(severity, check, entity, "")], ", ".join(f"`{c}` string" for c in COLUMNS))
    for name, path, header in (("match", matching, TRUTH), ("candidate", candidate, CANDIDATES)):
        rows, wrong = read_lists(spark, path, header) if path else (None, "file missing")
        if wrong:
            out.append(fact("warning" if soft and name == "candidate" and wrong == "file missing" else "error", f"{name} {wrong}", path or ""))
            continue
        read[name] = rows.where("tabbed").select("ref_id", "ids") if soft else rows.select("ref_id", "ids")
        if soft:
            out.append(_row(rows.where("not tabbed"), f"{name} row without a tab"))
        tgt = F.col("tgt_id")
        foreign = ~(F.startswith(tgt, F.lit("S2-")) | F.startswith(tgt, F.lit("S3-")))
        out.append(list_violations(required.select("ref_id").distinct(), read[name], name, known, foreign, F.startswith(tgt, F.lit("S1-"))))
    if len(read) == 2:
        out.append(outside(read["match"], read["candidate"], "warning" if soft else "error"))
    return functools.reduce(DataFrame.union, out)


def file_violations(spark: SparkSession, matching: str, candidate: str, required: DataFrame, known: DataFrame | None) -> DataFrame:
    """The strict audit of the two list files against required (ref_id) and known (tgt_id)."""
    return _files(spark, matching, candidate, required, known, soft=False)


def official_findings(spark: SparkSession, matching: str, candidate: str | None, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The organisers' rules: a missing candidate file and matches outside the candidates only warn, rows without a tab are
    errors, ids are looked up only if `known` is given."""
    return _files(spark, matching, candidate, required, known, soft=True)


def scored_support(spark: SparkSession, candidate: str, edges: DataFrame, required: DataFrame) -> DataFrame:
    """(severity, check, entity, detail): pairs of the candidate file that weren't scored (edges: ref_id, tgt_id) or the other way
    round, required rows (ref_id) that are missing, and rows out of the references' order."""
    rows, wrong = read_lists(spark, candidate, CANDIDATES)
    if wrong:
        return spark.createDataFrame([("error", f"candidate {wrong}", candidate, "")], ", ".join(f"`{c}` string" for c in COLUMNS))
    pairs = rows.select("ref_id", F.explode("ids").alias("tgt_id"))
    diff = support_difference(edges.select(F.col("ref_id").cast("string").alias("ref_id"), F.col("tgt_id").cast("string").alias("tgt_id")), pairs)
    out = diff.select(F.lit("error"), F.when(F.col("side") == "ledger", "scored pair not exported").otherwise("exported pair not scored"), "ref_id", "tgt_id")
    out = _row(required.select("ref_id").distinct().join(rows, "ref_id", "left_anti"), "candidate row missing").union(out)
    # Lines stand in order if none is smaller than the largest before it: by blocks of the file, then inside them.
    at = spark.read.text(candidate).where(F.trim("value") != "").select(F.substring_index("value", "\t", 1).alias("ref_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k")).where(F.lower("ref_id") != CANDIDATES[0])
    tops = at.groupBy("block").agg(F.max("ref_id").alias("top")).withColumn("before", F.max("top").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each block of the file
    inside = Window.partitionBy("block").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    late = at.join(F.broadcast(tops.select("block", "before")), "block").withColumn("top", F.greatest(F.max("ref_id").over(inside), "before")).where("top > ref_id")
    return out.union(_row(late, "candidate row out of order"))


def passed(findings: DataFrame) -> bool:
    return findings.where("severity = 'error'").isEmpty()
