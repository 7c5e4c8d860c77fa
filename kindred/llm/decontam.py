"""Benchmark decontamination by a distributed positional inverted index. DataFrame operations only.

Test items are cut into windows of words. Corpus counts of the test terms order each window's terms by
rarity; a window with a term that the corpus lacks can't occur. Postings (document, term, position) of
the two rarest terms of the windows are stored; the list of the rarest term, shifted by its offset, is
intersected with the shifted list of the second. Postings of rarest terms keep the words around them,
by which what is left is checked word for word; windows' places are then merged into hit words.

Defined cases: null texts have no words; items without words have no windows; a null item_id is not
reported; rows of equal doc_id and text are judged once and reported each; empty tables give clean
documents or no rows; columns beside doc_id, item_id and text are ignored, and kept by the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh, table

#: What is in no word, character by character: Java looks single characters up in a table but tests ranges
#: one after the other, which takes five times as long.
_OUTSIDE = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
#: Words of the text as it stands, which are lower-cased one by one, and what parts them.
WORD, BETWEEN = f"[^{_OUTSIDE}]+", f"[{_OUTSIDE}]+"
WINDOW = 10
#: Up to so many different test terms are sent to where the texts are; more meet the words by a shuffle.
SMALL = 100_000


def raw_words(text: str) -> Column:
    return F.regexp_extract_all(F.col(text).cast("string"), F.lit(WORD), F.lit(0))


def split_words(text: str) -> Column:
    """The words; the first and the last may be '' besides, which shifts positions alike in a document."""
    return F.split(F.col(text).cast("string"), BETWEEN)


def word_count(words: str) -> Column:
    """How many of split_words() are words; null texts have none."""
    blank = lambda at: (F.element_at(words, at) == "").cast("int")
    return F.coalesce(F.greatest(F.size(words) - blank(1) - blank(-1), F.lit(0)), F.lit(0)).cast("long")


def doc_key() -> list[Column]:
    """128 bits that tell documents apart, null or repeated ids included."""
    return [F.xxhash64("doc_id", "text").alias("d1"), F.xxhash64("text", F.lit("key")).alias("d2")]


def item_windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(w, n) of the different windows, their words joined by blanks, and (w, item) of where they are from."""
    words = items.select(F.col("item_id").cast("string").alias("item"), F.transform(raw_words("text"), ascii_lower).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    found = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, size))).alias("l"))
    owners = cut(found.select(F.array_join("l", " ").alias("w"), "item").distinct())
    return owners.select("w", F.size(F.split("w", " ")).alias("n")).distinct(), owners


def corpus_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): how often each test term stands in the documents."""
    words = docs.select(F.explode(split_words("text")).alias("t")).select(ascii_lower("t").alias("term"))
    if terms.count() <= SMALL:
        return words.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(terms, "term")


def around_word(words: Column, pos: Column, around: int) -> Column:
    """The words up to `around` before and after position `pos` as they stand, joined by blanks."""
    first = F.greatest(pos - around, F.lit(0))
    return F.array_join(F.slice(words, first + 1, pos - first + around + 1), " ")


def postings(docs: DataFrame, terms: DataFrame, around: int = 0) -> DataFrame:
    """(d1, d2, term, pos, near) of each place of the terms (term, lead), positions from 0. `near` are the words
    around it, for leading terms only; null where the terms are too many to be sent to the texts: words then move
    without their texts, and contexts() finds what is around those that matter. Repeated rows repeat."""
    words = docs.select(*doc_key(), split_words("text").alias("ws")).select("*", F.posexplode("ws").alias("pos", "t"))
    if terms.count() <= SMALL:
        near = F.when(F.col("lead"), around_word(F.col("ws"), F.col("pos"), around))
        return words.select("d1", "d2", "ws", ascii_lower("t").alias("term"), "pos").join(F.broadcast(terms), "term").select("d1", "d2", "term", "pos", near.alias("near"))
    return words.select("d1", "d2", ascii_lower("t").alias("term"), "pos").join(terms, "term").select("d1", "d2", "term", "pos", F.lit(None).cast("string").alias("near"))


def contexts(docs: DataFrame, places: DataFrame, around: int) -> DataFrame:
    """(d1, d2, pos, near) of places (d1, d2, pos): only texts that hold one are joined, each once with all its places."""
    of = places.groupBy("d1", "d2").agg(F.collect_set("pos").alias("at"))
    texts = docs.select(*doc_key(), split_words("text").alias("ws")).join(of, ["d1", "d2"])
    each = texts.select("d1", "d2", "ws", F.explode("at").alias("pos"))
    return each.select("d1", "d2", "pos", around_word(F.col("ws"), F.col("pos"), around).alias("near")).groupBy("d1", "d2", "pos").agg(F.first("near").alias("near"))


def by_rarity(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(w, n, df, term, off, r): the windows that can occur, their terms ranked from the rarest."""
    each = windows.select("w", "n", F.posexplode(F.split("w", " ")).alias("off", "term")).join(counts, "term", "left")
    possible = each.groupBy("w").agg(F.count("df").alias("c"), F.count(F.lit(1)).alias("a")).where("c = a").select("w")
    return each.join(possible, "w").withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy("df", "term", "off")))


def candidates(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(d1, d2, w, term, pos): places of a window's rarest term where the second rarest stands as it should."""
    first = ranked.where("r = 1").select("w", "term", "off")
    second = ranked.where("r = 2").select("w", F.col("term").alias("term2"), F.col("off").alias("off2"))
    need = cut(first.join(second, "w", "left").withColumn("id", F.xxhash64("w")))
    starts = index.join(need.drop("w"), "term").where(F.col("pos") >= F.col("off"))
    alone = starts.where("term2 is null").select("d1", "d2", "id", "term", "pos")
    pairs = starts.where("term2 is not null").select("d1", "d2", "id", F.col("term").alias("lead"), F.col("pos").alias("at"), F.col("term2").alias("term"), (F.col("pos") - F.col("off") + F.col("off2")).alias("pos"))
    both = pairs.join(index, ["d1", "d2", "term", "pos"]).select("d1", "d2", "id", F.col("lead").alias("term"), F.col("at").alias("pos"))
    return alone.union(both).join(need.select("id", "w", "term", "off"), ["id", "term"]).select("d1", "d2", "w", "term", "pos", "off")


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(d1, d2, spans): by document, the exact occurrences (start, n, w) of windows; and (w, item)."""
    windows, owners = item_windows(items, size)
    terms = cut(windows.select(F.explode(F.split("w", " ")).alias("term")).distinct())
    ranked = cut(by_rarity(windows, cut(corpus_counts(docs, terms))))
    rare = cut(ranked.where("r <= 2").groupBy("term").agg(F.max(F.col("r") == 1).alias("lead")))
    stored = cut(postings(docs, rare, size - 1))
    index = stored.select("d1", "d2", "term", "pos").distinct()
    found = candidates(index, ranked)
    if rare.count() <= SMALL:
        found = found.join(stored.where("near is not null"), ["d1", "d2", "term", "pos"])
    else:
        found = cut(found)
        found = found.join(contexts(docs, found, size - 1), ["d1", "d2", "pos"])
    # The words around the rarest term decide the rest of the phrase.
    before = F.least(F.col("pos"), F.lit(size - 1))
    n = F.size(F.split("w", " "))
    text = F.array_join(F.transform(F.slice(F.split("near", " "), before - F.col("off") + 1, n), ascii_lower), " ")
    exact = found.where(text == F.col("w")).select("d1", "d2", F.struct((F.col("pos") - F.col("off")).alias("start"), n.alias("n"), "w").alias("s"))
    return cut(exact.groupBy("d1", "d2").agg(F.array_sort(F.collect_set("s")).alias("spans"))), owners


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, size: int = WINDOW) -> DataFrame:
    """(d1, d2, w, start): places of a window's rarest term around which all its other terms stand within
    `slop` words, in any order. A term that the window holds twice needs one place."""
    windows, _ = item_windows(items, size)
    terms = cut(windows.select(F.explode(F.split("w", " ")).alias("term")).distinct())
    ranked = cut(by_rarity(windows, cut(corpus_counts(docs, terms))))
    index = cut(postings(docs, ranked.select("term", F.lit(False).alias("lead")).distinct()).drop("near").distinct())
    anchors = index.join(ranked.where("r = 1").select("w", "term"), "term").select("d1", "d2", "w", F.col("pos").alias("start"))
    others = ranked.select("w", "term").distinct()
    need = others.groupBy("w").agg(F.count(F.lit(1)).alias("need"))
    near = anchors.join(others, "w").join(index, ["d1", "d2", "term"]).where(F.abs(F.col("pos") - F.col("start")) <= slop)
    return near.groupBy("d1", "d2", "w", "start").agg(F.count_distinct("term").alias("have")).join(need, "w").where("have = need").select("d1", "d2", "w", "start")


def hit_words(spans: str) -> Column:
    """How many words sorted spans (start, n, ..) cover together."""
    end = lambda s: s["start"] + s["n"]
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct((a["hit"] + F.greatest(end(s) - F.greatest(a["to"], s["start"]), F.lit(0))).alias("hit"), F.greatest(a["to"], end(s)).alias("to"))
    return F.aggregate(spans, zero, step, lambda a: a["hit"])


def judge(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    spans, owners = phrase_matches(docs, items, size)
    named = spans.select("d1", "d2", F.explode(F.array_distinct(F.col("spans.w"))).alias("w")).join(owners, "w").groupBy("d1", "d2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = spans.select("d1", "d2", hit_words("spans").alias("hit")).join(named, ["d1", "d2"])
    each = docs.select("doc_id", *doc_key(), split_words("text").alias("ws")).select("doc_id", "d1", "d2", word_count("ws").alias("n_words"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("hit", F.lit(0)).cast("long")
    return each.join(hits, ["d1", "d2"], "left").select("doc_id", "n_words", hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, whole as they were."""
    spans, _ = phrase_matches(docs, table(spark, sf_dir, "benchmark"))
    a, b = fresh(docs, "key_1"), fresh(docs, "key_2")
    d1, d2 = doc_key()
    hit = spans.select(F.col("d1").alias(a), F.col("d2").alias(b))
    return docs.withColumns({a: d1, b: d2}).join(hit, [a, b], "left_anti").drop(a, b)


_SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SQL_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_SQL_LOW}, '{_SQL_WORD}') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_SQL_LOW}, '{_SQL_WORD}') AS ws FROM benchmark),
i AS (SELECT item, ws, unnest(range(greatest(len(ws) - 9, 1))) AS s FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, array_to_string(ws[s + 1 : s + 10], ' ') AS w, least(len(ws), 10) AS n FROM i),
l AS (SELECT DISTINCT n FROM w),
p AS (SELECT k, s, n, array_to_string(ws[s + 1 : s + n], ' ') AS w FROM (SELECT k, ws, n, unnest(range(len(ws) - n + 1)) AS s FROM d, l WHERE len(ws) >= n)),
m AS (SELECT p.k, p.s, p.n, w.item FROM p JOIN w ON p.w = w.w AND p.n = w.n),
h AS (SELECT k, count(DISTINCT pos) AS hit FROM (SELECT k, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT k, s, n FROM m)) GROUP BY k),
t AS (SELECT k, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)
"""
