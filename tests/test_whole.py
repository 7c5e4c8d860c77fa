"""Queries over whole texts against brute force, on texts that are equal up to a cut."""

from collections import Counter

import __spark_entry__ as entry
from kindred.plans import catalog

HEAD = "abcd " * 14
TEXTS = {0: HEAD + "one\nx", 3: HEAD + "two\nx", 6: HEAD + "one\nx", 9: "k\nsame\nthird", 12: "k\nsame\nfourth", 15: "k\nsame\nthird", 18: "single", 1: "k\nsame\nthird", 21: ""}


def test_whole_texts_are_read(spark, tmp_path):
    spark.createDataFrame([(i, t, "en") for i, t in TEXTS.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    ask = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    same = Counter((i % 3, t) for i, t in TEXTS.items())
    want = {(n, min(i for i, t in TEXTS.items() if (i % 3, t) == k)) for k, n in same.items() if n > 1}
    assert {(r.n, r.first_id) for r in ask("duplicate_groups")} == want == {(2, 0), (2, 9)}
    views = {r.rec_id: (r.name_norm, r.addr_norm) for r in ask("record_views")}
    assert views == {i: tuple(" ".join(x.split()) for x in (t + "\n").split("\n", 1)) for i, t in TEXTS.items()}
    df = Counter()
    for i, t in TEXTS.items():
        if i % 3 == 0:
            w = t.split("\n", 1)[1].split() if "\n" in t else []
            df.update({x for x in w if len(x) >= 2} | {x[k : k + 3] for x in w if len(x) >= 4 for k in range(len(x) - 2)})
    assert {r.term: r.df for r in ask("df_map") if r.field == "addr"} == dict(df)
    assert [(r.ref_id, r.tgt_id) for r in ask("truth_links")] == [(9, 1)]


def test_slices_bring_only_records_that_their_edges_name(spark, tmp_path, monkeypatch):
    texts = {i: f"shop {i % 7} {'green' if i % 2 else 'blue'} lane\n{i % 5} harbour street number {i % 11}" for i in range(60)}
    spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    row = lambda r: (r.src, r.tgt_id, r.ref_id, r.score)
    want = {row(r) for r in catalog.World(spark, str(tmp_path)).scored.collect()}
    monkeypatch.setattr(catalog, "FEW", 1)
    met = []

    def make(edges, targets, refs):
        met.append(edges.count())
        ids = lambda df, c: sorted(r[c] for r in df.select(c).distinct().collect())
        assert ids(refs, "rec_id") == ids(edges, "ref_id") and ids(targets, "rec_id") == ids(edges, "tgt_id")
        return edges.select("src", "tgt_id", "ref_id")

    w = catalog.World(spark, str(tmp_path))
    assert w._sliced("seen", make).count() == len(want) == sum(met) and len(met) > 4
    again = type("Anew", (catalog.World,), {"_kept": lambda self, name, make: catalog.World._kept(self, "anew-" * name.startswith("scored") + name, make)})
    assert {row(r) for r in again(spark, str(tmp_path)).scored.collect()} == want
