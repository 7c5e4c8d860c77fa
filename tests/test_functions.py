import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import similarity as S
from kindred.functions import text as X


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr.alias("x")).collect()[0][0]


def test_normal_views(spark):
    rows = [(1, "Straße & Co."), (2, "ＡＢＣ  ltd"), (3, ""), (4, "plain-Text")]
    rows += [(5, None), (6, "कमल प्राइवेट Ltd")]
    got = {r.i: (r.n_norm, r.n_latin) for r in X.with_views(spark.createDataFrame(rows, ["i", "t"]), n="t").collect()}
    assert {i: n for i, (n, _) in got.items()} == {1: "strasse co", 2: "abc ltd", 3: "", 4: "plain text", 5: None, 6: "कमल प्राइवेट ltd"}
    assert got[6][1].split()[0] == "kamal" and got[2][1] == "abc ltd"


def test_tokens_and_trigrams(spark):
    assert one(spark, X.tokens(F.col("t")), t="a bc def") == ["bc", "def"]
    assert one(spark, X.trigrams(F.col("t")), t="abc abcd abcde") == ["abc", "bcd", "abc", "bcd", "cde"]
    assert one(spark, X.trigrams(F.col("t")), t="") == []
    assert one(spark, X.latin_fold(F.col("t")), t="café niño कि") == "cafe nino कि"
    assert one(spark, X.numbers(F.col("t")), t="no 007 x 0 12b") == ["7", "0", "12"]


def test_terms_equal_their_parts(spark):
    texts = ["", "a", "abc", "abcd  ab", "café crème éa\u0301é\u0301te e\u0301t\u0301e\u0301", "कमल प्राइवेट कि", "\u0301abcd x\u0301\u0302yzw", "naïve naive", "w" * 90, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    norm, fold = F.col("t"), X.latin_fold(F.col("t"))
    parts = F.array_sort(F.array_distinct(F.concat(X.trigrams(norm), X.tokens(norm), X.trigrams(fold))))
    for r in rows.select("t", X.merged_terms(norm).alias("got"), parts.alias("want"), F.transform(F.split("t", " "), X.latin_fold).alias("folds")).collect():
        assert r.got == r.want and (r.t is None or r.got == X.text_terms(r.t) and r.folds == [X.fold_word(w) for w in r.t.split(" ")])
    # Characters beyond 16 bits stay whole; the regular expression of trigrams() halves them.
    assert one(spark, X.merged_terms(F.col("t")), t="𐍈𐍈𐍈𐍈 ab𐍈d") == ["ab𐍈", "ab𐍈d", "b𐍈d", "𐍈𐍈𐍈", "𐍈𐍈𐍈𐍈"]


def test_skeletons_meet_across_scripts(spark):
    assert one(spark, X.skeletons(F.col("t")), t="private limited") == ["prvt", "lmt"]
    assert one(spark, X.skeletons(F.col("t")), t="phaallee boook") == ["pl", "pk"]
    both = spark.createDataFrame([("आरांत प्रोडक्ट्स प्राइवेट लिमिटेड",), ("aarant products private limited",)], ["t"])
    a, b = (r.s for r in X.with_views(both, n="t").select(X.skeletons(F.col("n_latin")).alias("s")).collect())
    assert a[2:] == b[2:] == ["prvt", "lmt"] and len(a) == len(b) == 4


@pytest.mark.parametrize(("text", "indic"), [("abc", False), ("क", True), ("x ൿ", True), ("é", False)])
def test_script_flag(spark, text, indic):
    assert one(spark, X.is_indic(F.col("t")), t=text) is indic


@pytest.mark.parametrize(("text", "latin"), [("कमल", "kamal"), ("कि", "ki"), ("क्या", "kya"), ("अंक", "ank"), ("क १२", "k 12"), ("abc", "abc"), ("", "")])
def test_transliteration(text, latin):
    assert X.transliterate_text(text) == latin


@pytest.mark.parametrize(("a", "b", "s"), [("martha", "marhta", 0.961111), ("abcd", "abxy", 0.666667), ("", "x", 0.0), ("same", "same", 1.0), ("dwayne", "duane", 0.84)])
def test_jaro_winkler(a, b, s):
    assert S.jaro_winkler_text(a, b) == pytest.approx(s, abs=1e-6)


def windowed(a, b):
    """Jaro-Winkler as it is defined, by windows."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, left, m = [True] * len(b), [], 0
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                left.append(ch)
                m += 1
                break
    if not m:
        return 0.0
    right = [ch for ch, f in zip(b, free, strict=True) if not f]
    s = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right, strict=True)) // 2) / m) / 3
    p = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return s + p * 0.1 * (1 - s) if s > 0.7 else s


@given(st.text("abcé", max_size=14), st.text("abcé", max_size=14))
@settings(max_examples=400, deadline=None)
def test_jaro_winkler_equals_windows(a, b):
    assert S.jaro_winkler_text(a, b) == pytest.approx(windowed(a, b), abs=1e-12)


def test_set_scores(spark):
    a, b, none = (F.array(*map(F.lit, x)) for x in (["x", "y"], ["y", "z"], []))
    none = F.array().cast("array<string>")
    assert one(spark, S.jaccard(a, b), t=1) == pytest.approx(1 / 3)
    assert one(spark, S.jaccard(none, none), t=1) == 0
    assert one(spark, S.contained(none, b), t=1) is False
    assert one(spark, S.different(a, b), t=1) == 2
    assert one(spark, S.f_half(F.lit(1), F.lit(3), F.lit(1)), t=1) == pytest.approx(5 / 7)
    assert one(spark, S.f_half(F.lit(0), F.lit(0), F.lit(0)), t=1) == 1
