"""Small fixtures: odd rows (nulls, empty, repeated, long, clashing columns), and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("kindred.llm.entry")
from pyspark.sql import functions as F

from kindred.llm import ann, components, decontam, lengths, nearcopies, packing, quality, sharding, simhash, toxicity, urltree, warc
from kindred.llm.common import cut
from kindred.llm.wordbpe import default_path, encoder

DOC = "doc_id long, text string, lang string, source string, score double, length long"
R = random.Random(5)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "ta") for b in ("ne", "so", "vi", "po", "du")]
SAY = lambda n: " ".join(R.choice(WORDS) for _ in range(n))
LONG = SAY(6000)
TEXTS = [None, "", "One", "A b", LONG, LONG, *[SAY(40) for _ in range(20)], "Tab\tand\nline é ß don't <|endoftext|>", "same text here now", "same text here now"]


def docs(spark, texts=TEXTS, null_id=True):
    rows = [(i, t, "en", "s", 0.0, 1) for i, t in enumerate(texts)] + ([(None, "no id", None, None, None, None), (3, "A b", "en", "s", 0.0, 1)] if null_id else [])
    return spark.createDataFrame(rows, DOC)


def test_word_bpe_equals_the_tokenizer():
    import pyarrow as pa

    enc = encoder(default_path())
    texts = [*TEXTS, "don't we'll 's ''s x's 12a3 naïve ÉÀß× İ ’s", "x\x1cy", "日本 語", "'", "a" * 40]
    ids, off = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids


def test_packing_is_exact(spark):
    got = packing.pack_documents(docs(spark), default_path(), 64).collect()
    tok = encoder(default_path()).tok
    want = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*TEXTS, "no id", "A b"])
    assert sum(r.length for r in got) == want
    seqs = {}
    for r in got:
        assert r.length <= 64 and r.start == 64 * r.piece
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack_documents(docs(spark).limit(0), default_path()).count() == 0
    ids = [*tok.encode("One", add_special_tokens=False).ids, 0]
    assert next(r.ids_crc32 for r in got if r.doc_id == 2) == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_length_histogram(spark):
    tok = encoder(default_path()).tok
    n = np.array([len(tok.encode(t or "", add_special_tokens=False).ids) for t in [*TEXTS, "no id", "A b"]])
    hist = lengths.histogram(lengths.encoded_lengths(docs(spark), default_path())).cache()
    for r in hist.collect():
        assert (r.docs, r.docs_at_least, r.tokens_at_least, r.tokens_if_cut) == ((n == r.length).sum(), (n >= r.length).sum(), n[n >= r.length].sum(), np.minimum(n, r.length).sum())
    assert lengths.cut_total(hist, 50).collect()[0][0] == np.minimum(n, 50).sum()
    assert lengths.quantile(hist, 0.5).collect()[0][0] == np.sort(n)[int(np.ceil(0.5 * len(n))) - 1]


def reference_fp(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def test_fingerprints_and_components(spark):
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(docs(spark)).collect()}
    assert all(got[i] == reference_fp(t) for i, t in enumerate(TEXTS))
    kept = simhash.stage(spark, docs(spark), "")
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i in range(len(TEXTS)) if i not in (1, 5, len(TEXTS) - 1)]
    assert simhash.stage(spark, docs(spark).limit(0), "").count() == 0


@pytest.mark.parametrize("cell", [2, 32])
def test_links_equal_brute_force(spark, cell):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 6, dtype=np.int64)
    fps = {int(b) for b in base} | {0, -1, *range(12)}
    for b in base[:3]:
        for _ in range(40):
            x = int(b)
            for k in r.integers(0, 64, r.integers(1, 4)):
                x ^= 1 << int(k)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), cell)
    got = {x.node: x.root for x in components.connected_components(edges).collect()}
    assert all(got.get(x, x) == root(x) for x in fps)


@pytest.mark.parametrize("small", [0, decontam.SMALL])
def test_decontamination_equals_brute_force(spark, monkeypatch, small):
    import re

    monkeypatch.setattr(decontam, "SMALL", small)
    items = [(1, SAY(30)), (2, "ru po"), (None, SAY(12)), (4, None), (5, ""), (11, SAY(12))]
    texts = [*TEXTS, "x. " + items[0][1].upper() + " y", items[0][1][:60], "Ru, po! ru po", "... " + items[0][1] + "!", "?!", ". one", items[-1][1] + " " + items[-1][1]]
    got = {r.doc_id: r for r in decontam.judge(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).where("doc_id is not null").collect()}
    find = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    for i, t in enumerate(texts):
        w, hit, who = find(t), set(), set()
        for item, s in items:
            v = find(s)
            for k in range(max(len(v) - 9, 1) if v else 0):
                win = v[k : k + 10]
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        who.add(item)
        who = sorted(str(x) for x in who if x is not None)
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(w), len(hit), len(who))
        assert got[i].items_sha256 == hashlib.sha256(",".join(who).encode()).hexdigest()


@pytest.mark.parametrize("slop", [1, 4])
def test_proximity_equals_brute_force(spark, slop):
    r = random.Random(3)
    items = [(1, "ka lo mi"), (2, "Ru po ru"), (3, "du"), (4, None)]
    texts = [" ".join(r.choice(["ka", "lo", "mi", "ru", "po", "du", "xx", "yy"]) for _ in range(60)) for _ in range(12)] + [None, "", "mi ka lo", "lo, KA mi!"]
    d = docs(spark, texts, False)
    key = {(x.d1, x.d2): x.doc_id for x in d.select("doc_id", *decontam.doc_key()).collect()}
    found = decontam.proximity_matches(d, spark.createDataFrame(items, "item_id long, text string"), slop).collect()
    got = {(key[x.d1, x.d2], x.w, x.start) for x in found}
    words = [(t or "").lower().replace(",", "").replace("!", "").split() for t in texts]
    df = {t: sum(w.count(t) for w in words) for w in words for t in w}
    want = set()
    for w in ("ka lo mi", "ru po ru", "du"):
        rare = min(w.split(), key=lambda t: (df[t], t))
        want |= {(i, w, p) for i, ws in enumerate(words) for p, t in enumerate(ws) if t == rare and all(x in ws[max(0, p - slop) : p + slop + 1] for x in w.split())}
    assert got == want and want


def test_shards_are_even_and_gapless(spark):
    texts = [SAY(R.randint(1, 60)) for _ in range(400)] + ["hot text " * 20] * 200 + [None, ""]
    rows = sharding.assign(sharding.keyed(docs(spark, texts)), 4).collect()
    size = {}
    for r in rows:
        size.setdefault(r.shard, []).append(r)
    assert max(sum(r["size"] for r in s) for s in size.values()) < 1.05 * sum(r["size"] for r in rows) / 4
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in size.values())
    assert sharding.assign(sharding.keyed(docs(spark, texts).limit(0))).count() == 0


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "u\r\nX: y", ""), (None, "n", "solo"), (5, "c", "WARC/1.1\r\nWARC-Type: revisit\r\n")] + [(100 + i, "h", "hot") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    at = f"file://{tmp_path}/a"
    warc.write(pages, at)
    got = {r.page_id: r for r in warc.read_headers(spark, at).collect()}
    assert (got[2].record_type, got[1].record_type, got[1].refers_to, got[3].refers_to, got[4].record_type) == ("response", "revisit", 2, 4, "response")
    assert sum(r.record_type == "response" for r in got.values() if r.page_id and r.page_id >= 100) == 1
    assert {r.page_id: bytes(r.payload).decode() for r in warc.records(spark, at).collect()} == {p: h or "" for p, _, h in rows}
    warc.export(spark, at, f"{tmp_path}/w")
    whole = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    assert whole.count(b"WARC-Record-ID") == len(rows) and whole.endswith(b"\r\n\r\n")


def test_url_rules_and_templates(spark):
    urls = [("http://Example.com/en/1", "example.com/en/", "block"), ("https://www.example.com/en/1", "www.example.com/en/", "allow"), ("http://a.b.com/x?y", "com/", "allow"), ("http://x.net/es/1", "net/es/", "block"), ("http://x.com", None, None), (None, None, "allow"), ("no scheme", None, "allow"), ("http://q.org/a/b/c/d/e/f", None, "allow")]
    got = {r.page_id: r for r in urltree.judge(spark.createDataFrame([(i, u, "h") for i, (u, _, _) in enumerate(urls)], "page_id long, url string, host string")).collect()}
    for i, (_, rule, verdict) in enumerate(urls):
        assert got[i].rule == rule and got[i].verdict in ({verdict} if verdict else {"allow", "block"})
    bad = [(i, f"http://z.net/es/{i}") for i in range(20)] + [(100 + i, f"http://y.org/p/{i}") for i in range(20)]
    judged = urltree.judge(spark.createDataFrame(bad, "page_id long, url string"), (("z.net/es/", "block"),)).collect()
    assert {r.verdict for r in judged if r.page_id >= 100} == {"block"} or {r.template for r in judged if r.page_id >= 100} == {"/p/*"}


def five_word_runs(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies():
    r = random.Random(8)
    line = [f"line{k}" for k in range(12)]
    out = []
    for g in range(12):
        base = [f"{r.choice(WORDS)}{r.randrange(9)}" for _ in range(200 if g == 0 else r.choice([8, 30, 80, 200]))]
        for c in range(14 if g == 0 else 3):
            w = list(base)
            for k in r.sample(range(len(w)), min(len(w), c % 5)):
                w[k] = f"new{r.randrange(10**6)}"
            out.append(" ".join((line if g % 2 else []) + w))
    return out + ["", "  ", "one two", "One two", "one two three"]


@pytest.mark.parametrize(("cell", "many"), [(1, 3), (3, 3), (3, 2048), (32, 2048)])
def test_near_copies_equal_brute_force(spark, cell, many):
    texts = near_copies()
    sets = [five_word_runs(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    rows = cut(nearcopies.run_sets(docs(spark, texts, False)))
    roots = {x.node: x.root for x in nearcopies.components(docs(spark, texts, False), rows, cell, many).collect()}
    got = {r.doc_id: roots.get(r.node, r.node) for r in rows.collect()}
    assert all((got[a] == got[b]) == (root(a) == root(b)) for a in got for b in got)
    assert len({root(a) for a in got}) < len({frozenset(x) for x in sets}) - 12


def test_stage_drops_near_copies(spark):
    texts = near_copies()
    firsts = [i for i, t in enumerate(texts) if not any(five_word_runs(t) == five_word_runs(u) or len(five_word_runs(t) & five_word_runs(u)) >= 0.8 * len(five_word_runs(t) | five_word_runs(u)) for u in texts[:i])]
    kept = [r.doc_id for r in simhash.stage(spark, docs(spark, texts, False), "").collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(firsts)


def test_stage_takes_candidates_from_fingerprints(spark, monkeypatch):
    """What two bits tell is linked by fingerprints and an exact check alone; the sets find the rest, in slices or at once."""
    r = random.Random(5)
    long = [f"w{r.randrange(10**6)}" for _ in range(600)]
    line = "a very common line of words " * 60
    texts = [" ".join(long), " ".join([*long[:-1], "x"]), line + " ".join(long[:20]), line + " ".join(long[20:40]), " ".join(long[:300]), "", " "]
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() <= 2
    d = docs(spark, texts, False)
    sets = cut(nearcopies.run_sets(d))
    node = {x.doc_id: x.node for x in sets.collect()}
    fp = {x.doc_id: x.fp for x in sets.collect()}
    assert fp == {i: (f := simhash.fingerprint(t.encode())) - (f >> 63 << 64) for i, t in enumerate(texts)}
    linked = simhash.near(d, sets)
    assert {frozenset(x) for x in linked.collect()} == {frozenset({node[0], node[1]})}
    given = []
    monkeypatch.setattr(simhash, "components", lambda *a, linked, **k: given.append(linked.count()) or nearcopies.components(*a, linked=linked, **k))
    assert sorted(x.doc_id for x in simhash.stage(spark, d, "").collect()) == [0, 2, 3, 4, 5] and given == [1]


def test_near_copies_in_slices(spark, monkeypatch):
    texts = near_copies()
    d = docs(spark, texts, False)
    sets = cut(nearcopies.run_sets(d))
    want = {tuple(x) for x in nearcopies.components(d, sets, 3).collect()}
    monkeypatch.setattr(nearcopies, "FEW", 0)
    monkeypatch.setattr(nearcopies, "SLICES", 2)
    made = []
    monkeypatch.setattr(nearcopies, "_walked", lambda members, many, f=nearcopies._walked: made.append({r.run for r in members.select("run").distinct().collect()}) or f(members, many))
    assert {tuple(x) for x in nearcopies.components(d, sets, 3, linked=simhash.near(d, sets)).collect()} == want
    assert len(made) == 2 and not made[0] & made[1] and made[0] | made[1]


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((600, 8)).astype(np.float32)
    v[50:90] = v[50]
    rows = [(i, [float(x) for x in v[i]]) for i in range(600)] + [(700, None), (800, [0.0] * 8), (900, [float("nan")] * 8), (1000, [1.0] * 7 + [None])]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    hit = 0
    again = rows + [(100, [float(x) for x in v[7]]), (3, [float(x) for x in v[100]]), (100, [float(x) for x in v[100]])]
    few = ann.nearest_neighbours(spark.createDataFrame([(*x, "clash") for x in again], "vec_id long, embedding array<float>, v string"), F.col("vec_id") == 100).collect()
    assert len(few) == 20 and sorted(x.vec_id for x in few if x.score == 0) == [3, 7, 100]
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 100).count() == 0
    for q in range(0, 600, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(600), d))[:10]
        mine = sorted((x for x in got if x.query_id == q), key=lambda x: x["rank"])
        assert [x["rank"] for x in mine] == list(range(1, 11))
        assert all(abs(x.score - d[x.vec_id]) < 1e-12 for x in mine)
        hit += len({x.vec_id for x in mine} & set(best.tolist()))
    assert hit >= 0.9 * 60 and {x.query_id for x in got} == set(range(0, 600, 100))


def test_large_leaves_keep_neighbours_together(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 64)  # four leaves at most
    v = np.random.default_rng(2).standard_normal((1600, 2))
    nodes = cut(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"))
    got = {r.id: {e["n"] for e in r.nb} for r in ann.nearest(ann.start_lists(nodes, 1600, 8, 40), 8).collect()}
    d = ((v[:, None] - v[None]) ** 2).sum(-1) + np.diag([np.inf] * 1600)
    assert np.mean([len(got[i] & set(np.argsort(d[i])[:8].tolist())) / 8 for i in range(1600)]) > 0.85


def test_descent_carries_the_result(spark):
    v = np.random.default_rng(6).standard_normal((5000, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    d = ((v[::50, None] - v[None]) ** 2).sum(-1)
    d[np.arange(100), np.arange(0, 5000, 50)] = np.inf
    best = np.argsort(d, 1)[:, :10]
    nodes = cut(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"))
    share = lambda g: np.mean([len(set(g[50 * k][:10]) & set(best[k].tolist())) / 10 for k in range(100)])
    lists = lambda df: {r.id: [e["n"] for e in r.nb] for r in df.where("id % 50 = 0").collect()}
    start = share(lists(ann.nearest(ann.start_lists(nodes, 5000, 24, 64), 24)))
    assert start < 0.75 < 0.97 < share(lists(ann.build_graph(nodes, degree=24)))


def test_search_ends_with_expanded_beams(spark):
    v = np.random.default_rng(4).standard_normal((400, 4))
    nodes = cut(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"))
    graph = ann.build_graph(nodes, degree=6, leaf=20)
    unseen = graph.withColumn("seen", F.array().cast("array<bigint>"))
    assert ann.changed(graph, ann.descend(nodes, unseen, 6, ann.MEET, 99)) < 3 * ann.DELTA
    state = ann.search(nodes, graph, nodes.where("id < 3").select(F.col("id").alias("q"), F.col("id").alias("node"), "v"), beam=100, expand=8).collect()
    assert len(state) == 3 and all(b["x"] for r in state for b in r.beam)


def test_search_in_rounds_and_lists_over_batches(spark, monkeypatch):
    v = np.random.default_rng(7).standard_normal((400, 4))
    nodes = cut(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>"))
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    lists = spark.createDataFrame([(i, [(float(d[i, j]), int(j)) for j in np.argsort(d[i])[k : k + 9]]) for i in range(400) for k in range(1, 5)], "id long, nb array<struct<d:float,n:bigint>>")
    graph = cut(ann.nearest(lists.union(lists), 7))  # every list twice, and those of an id share most of theirs
    assert {r.id: [e["n"] for e in r.nb] for r in graph.collect()} == {i: np.argsort(d[i])[1:8].tolist() for i in range(400)}
    rounds, walk = [], ann.walk
    monkeypatch.setattr(ann, "walk", lambda *x: rounds.append(1) or walk(*x))
    monkeypatch.setattr(ann, "PLACES", 8)  # two queries' components
    queries = nodes.where("id < 5").select(F.col("id").alias("q"), F.col("id").alias("node"), "v")
    got = {r.q: [b["n"] for b in r.beam][:10] for r in ann.search(nodes, graph, queries, beam=60, expand=8).collect()}
    assert len(rounds) == 3 and got == {i: np.argsort(d[i])[:10].tolist() for i in range(5)}


def labelled(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        bad, rude = i % 4 == 0, i % 5 == 0
        text = " ".join(w + "%%%" if bad else w for w in SAY(30).split()) + (" vile nasty" if rude else "")
        rows.append((i, text, "en", "s", 0.0, 1))
        labels.append((i, int(not bad), int(rude)))
    rows += [(9001, None, None, None, None, None), (None, "", None, None, None, None)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame([*labels, (None, 1, 0), (9001, None, None)], "doc_id long, quality int, toxic int")


def test_text_models_on_held_out_rows(spark):
    d, labels = labelled(spark)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    s = {r.doc_id: r.score for r in quality.QualityClassifier.fit(d, labels).score(d).collect()}
    assert all(0 <= x <= 1 for x in s.values()) and len(s) == 242
    assert np.mean([(s[i] >= 0.5) == (i % 4 != 0) for i in range(240) if held(i)]) > 0.95
    t = toxicity.ToxicityModel.fit(d, labels).score(d).collect()
    assert np.mean([r.toxic == (r.doc_id % 5 == 0) for r in t if r.doc_id is not None and r.doc_id < 240 and held(r.doc_id)]) > 0.95
    assert all(r.p_1 >= r.p_2 and abs(r.severity - r.p_1 - r.p_2) < 1e-9 for r in t)
    none = quality.QualityClassifier.fit(d, labels.limit(0))
    assert none.keep(d).count() == 242 and none.keep(d).columns == d.columns
    assert toxicity.ToxicityModel.fit(d.limit(0), labels).keep(d).count() == 242
