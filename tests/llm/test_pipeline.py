"""The text models and the whole pipeline against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("kindred.llm.entry")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from kindred.llm import decontam, lengths, packing, quality, simhash, toxicity
from kindred.llm.wordbpe import default_path, encoder

R = random.Random(17)
WORDS = ["".join(R.choice("bdklmnprst") + R.choice("aeiou") for _ in range(3)) for _ in range(400)]
M64 = (1 << 64) - 1
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, length long, node string, text_hash int"


def say(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def mix(h):
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & M64
    return h ^ h >> 31


def features(text, bits, bigrams=True, shapes=True):
    """The hashed features of a text as a set, one word after the other."""
    runs = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", (text or "").encode())
    hashes, forms = [], []
    for w in runs:
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
        head, tail = int.from_bytes(low[:8], "little"), int.from_bytes(low[-8:], "little") if len(low) > 8 else 0
        h = mix((head + len(low) * 0x9E3779B97F4A7C15) & M64) ^ mix((tail * 0xD6E8FEB86659FD93 + 1) & M64)
        ups = sum(65 <= b <= 90 for b in w)
        word = re.match(rb"[0-9A-Za-z\x80-\xff]", w)
        hashes.append(h)
        forms.append(1 + (48 <= w[0] <= 57) + 2 * (65 <= w[0] <= 90) + 4 * (ups == len(w) > 1) + 8 * min(len(w) // 4, 6) if word else h)
    out = set(hashes)
    if bigrams:
        out |= {mix((a * 3 + b) & M64) for a, b in zip(hashes, hashes[1:], strict=False)}
    if shapes:
        out |= {mix((a * 5 + b + 77) & M64) for a, b in zip(forms, forms[1:], strict=False)}
    return sorted({h & ((1 << bits) - 1) for h in out})


def good(model, text):
    if model is None:
        return 0.5
    a, b, bias = np.frombuffer(model, np.float64, 3)
    ratio, w = np.frombuffer(model, np.float32, offset=24).reshape(2, -1).astype(float)
    f = features(text, quality.BITS)
    m = sum(ratio[k] * w[k] for k in f) / max(math.sqrt(sum(ratio[k] ** 2 for k in f)), 1e-9) + bias
    return 1 / (1 + math.exp(-min(max(a * m + b, -30), 30)))


def rude(model, text):
    """P(grade >= 1), P(grade >= 2)."""
    if model is None:
        return 0.0, 0.0
    theta = np.frombuffer(model, np.float64, 2)
    w = np.frombuffer(model, np.float32, offset=16)
    z = sum(float(w[k]) for k in features(text, toxicity.BITS, False, False))
    return tuple(1 / (1 + math.exp(-min(max(z - t, -40), 40))) for t in theta)


def corpus():
    R.seed(17)
    texts = []
    for k in range(220):
        t = say(R.randint(12, 60))
        t = " ".join(w + "%%%" for w in t.split()) if k % 4 == 0 else t
        texts.append(t + " vile nasty filth" if k % 5 == 0 else t)
    base = say(90).split()
    texts += [" ".join(base), " ".join(base), " ".join(base[:40] + ["other"] + base[41:]), " ".join(base[:39] + ["some", "more"] + base[41:]), say(3000), None, "", "  ", "One", "İ é 日本 ß", "x" * 5000]
    rows = [(k, t, "en", "s", len(t or ""), 0.5, 1, 2, "n", 3) for k, t in enumerate(texts)]
    rows += [rows[1], (None, "no id at all " + say(20), None, None, None, None, None, None, None, None), (3, "another text under a known id " + say(20), "en", "s", 1, None, 1, 1, "n", 1)]
    labels = [(k, int(k % 4 != 0), int(k % 5 == 0)) for k in range(220)] + [(None, 1, 1), (221, None, None), (5, 1, 1), (5, 0, 0)]
    items = [(1, rows[30][1]), (2, "One"), (None, say(12)), (4, None), (5, say(30))]
    return rows, labels, items


def frames(spark):
    rows, labels, items = corpus()
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), spark.createDataFrame(items, "item_id long, text string")


def test_scores_equal_plain_python(spark):
    d, labels, _ = frames(spark)
    q, t = quality.QualityClassifier.fit(d, labels), toxicity.ToxicityModel.fit(d, labels)
    texts = [(r.doc_id, r.text) for r in d.collect()]
    key = lambda x: (str(x[0]), x[1])
    got = sorted(((r.doc_id, r.score) for r in q.score(d).collect()), key=key)
    want = sorted(((i, good(q.model, x)) for i, x in texts), key=key)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-6)
    got = sorted(((str(r.doc_id), r.p_1, r.p_2) for r in t.score(d).collect()))
    want = sorted(((str(i), *rude(t.model, x)) for i, x in texts))
    assert np.allclose([x[1:] for x in got], [x[1:] for x in want], atol=1e-5)


def test_held_out_labels_teach_nothing(spark):
    d, labels, _ = frames(spark)
    held = [r for r in labels.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    flipped = spark.createDataFrame([(r.doc_id, 1 - (r.quality or 0), 1 - (r.toxic or 0)) if r in held else tuple(r) for r in labels.collect()], labels.schema)
    assert len(held) > 50
    assert quality.QualityClassifier.fit(d, labels).model == quality.QualityClassifier.fit(d, flipped).model
    assert toxicity.ToxicityModel.fit(d, labels).model == toxicity.ToxicityModel.fit(d, flipped).model


def test_ratios_and_descent():
    rows = [[0, 1], [0, 2], [0, 3], [1, 2], [3], [0, 1, 2, 3], [2], []]
    y = np.array([1, 1, 0, 0, 0, 1, 0, 1])
    ptr, idx = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.array([k for r in rows for k in r], np.int32)
    model = quality.fit_model(y, ptr, idx)
    ratio = np.frombuffer(model, np.float32, 1 << quality.BITS, 24)
    for k in range(4):
        p, q = (1 + sum(k in r for r, c in zip(rows, y, strict=True) if c == s) for s in (1, 0))
        assert ratio[k] == pytest.approx(math.log(p / 4) - math.log(q / 4), abs=1e-6)
    r = np.random.default_rng(0)
    x, s = r.standard_normal((60, 5)), np.sign(r.standard_normal(60))
    flat = (np.arange(61) * 5, np.tile(np.arange(5), 60), x.ravel())
    cost = lambda w: w @ w / 2 + np.maximum(1 - s * (x @ w[:5] + w[5]), 0).sum()
    best = cost(quality.dual_descent(s, *flat, 5, np.arange(60), rounds=3000))
    assert cost(quality.dual_descent(s, *flat, 5, np.arange(60))) < 1.1 * best
    w = np.zeros(6)
    for k in range(20000):  # plain subgradient steps find nothing better
        out = s * (x @ w[:5] + w[5]) < 1
        w -= (w - np.append((s[out, None] * x[out]).sum(0), s[out].sum())) / (k + 1)
        best_seen = min(cost(w), best_seen) if k else cost(w)
    assert best < best_seen * 1.001


def test_one_class_no_class_and_bounds(spark):
    d, labels, _ = frames(spark)
    ones = labels.where("quality = 1")
    assert {round(r.score, 3) for r in quality.QualityClassifier.fit(d, ones).score(d).collect()} == {1.0}
    none = labels.where("toxic = 0").where("doc_id <> 5")
    assert not any(r.toxic for r in toxicity.ToxicityModel.fit(d, none).score(d).collect())
    assert quality.QualityClassifier.fit(d, labels, most=40).score(d).count() == d.count()
    assert quality.QualityClassifier.fit(d.limit(0), labels).score(d.limit(0)).count() == 0


def test_empty_tables(spark):
    d, _, items = frames(spark)
    assert decontam.judge(d.limit(0), items).count() == 0
    clean = decontam.judge(d, items.limit(0)).collect()
    assert len(clean) == d.count() and not any(r.contaminated or r.n_items for r in clean)
    assert lengths.histogram(lengths.encoded_lengths(d.limit(0), default_path())).count() == 0
    assert simhash.roots(simhash.fingerprints(d.limit(0))).count() == 0


def five(text):
    w = bytes(text or "", "utf8").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def windows_hit(text, items):
    find = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    words = find(text)
    for _, s in items:
        v = find(s)
        for k in range(max(len(v) - 9, 1) if v else 0):
            win = v[k : k + 10]
            if any(words[a : a + len(win)] == win for a in range(len(words) - len(win) + 1)):
                return True
    return False


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows, _, items = corpus()
    d, labels, bench = frames(spark)
    for name, df in (("documents", d), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now, read = rows, d
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        if name == "quality":
            model = quality.QualityClassifier.fit(read, labels).model
            now = [r for r in now if good(model, r[1]) >= 0.5]
        elif name == "toxicity":
            model = toxicity.ToxicityModel.fit(read, labels).model
            now = [r for r in now if rude(model, r[1])[0] < 0.5]
        elif name == "near_duplicates":
            sets = [five(r[1]) for r in now]
            parent = list(range(len(now)))

            def root(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a in range(len(now)):
                for b in range(a):
                    if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                        parent[root(a)] = root(b)
            groups = {}
            for a in range(len(now)):
                groups.setdefault(root(a), []).append(now[a])
            first = lambda g: [r for r in g if r[0] == min((r[0] for r in g if r[0] is not None), default=None)]
            choices = [first(g) for g in groups.values()]
        else:
            now = [r for r in now if not windows_hit(r[1], items)]
        out = stage(spark, read, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        read = spark.read.parquet(f"{tmp_path}/stage{k}")
        got = Counter(tuple(r) for r in read.collect())
        if name == "near_duplicates":
            assert sum(got.values()) == len(choices) and all(sum(got[r] for r in set(c)) == 1 for c in choices)
            now = [r for r, n in got.items() for _ in range(n)]
        assert got == Counter(now), name
        assert len(now) > 20
    last = corpus_pipeline.STAGES[-1][1](spark, read, str(tmp_path)).collect()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    tok = encoder(default_path()).tok
    want = Counter()
    for r in now:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), packing.SEQUENCE):
            part = np.array(ids[p : p + packing.SEQUENCE], "<u4")
            want[r[0], p // packing.SEQUENCE, p, len(part), zlib.crc32(part.tobytes())] += 1
    pieces = lambda rows_: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows_)
    assert pieces(last) == pieces(whole.collect()) == want
    total = sum(n * k[3] for k, n in want.items())
    assert len({r.sequence_id for r in last}) == -(-total // packing.SEQUENCE)
