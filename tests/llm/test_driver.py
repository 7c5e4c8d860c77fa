"""What the driver does: few statements, little memory."""

import pytest

pytest.importorskip("kindred.llm.entry")

from pyspark.sql import functions as F

from kindred.llm import common, nearcopies


def test_slices_follow_the_runs_that_rows_bring_and_are_one_statement_each(spark, monkeypatch):
    known = common.cut(spark.range(300).select(F.col("id").alias("node"), F.array("id", F.col("id") * 2).alias("hs")))
    rows = common.cut(spark.range(30_000).select((F.col("id") % 300).alias("a"), (F.col("id") * 7 % 300).alias("b"), F.lit(4).alias("n")))
    side = lambda t, k: t.select(F.col("node").alias(k), F.col("hs").alias(f"h{k}"))
    make = lambda part, mine: part.join(side(mine, "a"), "a").join(side(mine, "b"), "b").select("a", "b", F.element_at("ha", -1).alias("x"), F.element_at("hb", -1).alias("y"))
    want = sorted(map(tuple, make(rows, known).collect()))
    made = []
    monkeypatch.setattr(nearcopies, "cut", lambda df: made.append(1) or common.cut(df))
    assert sorted(map(tuple, nearcopies.sliced(rows, "a", ["a", "b"], known, make).collect())) == want and len(made) == 1  # many rows, small sets
    for few, slices in ((60_000, 2), (0, 5)):
        made.clear()
        monkeypatch.setattr(nearcopies, "FEW", few)
        monkeypatch.setattr(nearcopies, "SLICES", 5)
        assert sorted(map(tuple, nearcopies.sliced(rows, "a", ["a", "b"], known, make).collect())) == want and len(made) == 1 + slices
    made.clear()
    assert nearcopies.sliced(rows.limit(0), "a", ["a", "b"], known, make).count() == 0 and len(made) == 1


def test_freed_native_memory_is_given_back(spark, monkeypatch):
    said = common.trim(spark)
    assert said is None or "native heap" in said
    given = []
    monkeypatch.setattr(common, "trim", given.append)
    assert common.cut(spark.range(3)).count() == 3 and given == [spark]
    common._trims.clear()

    class Bare:  # a JVM without the command
        sparkContext = spark.sparkContext
        _jvm = None

    assert common._trimmer(Bare)() is None
