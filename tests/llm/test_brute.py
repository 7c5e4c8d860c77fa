"""Whole results against plain Python on small fixtures: sharding, URL templates, archives, tokenizer, models."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("kindred.llm.entry")
from pyspark.sql import functions as F

from kindred.llm import common, components, sharding, urltree, warc, wordbpe
from kindred.llm.wordbpe import default_path, encoder

R = random.Random(11)


def word(n=6):
    return "".join(R.choice("abcdefghij") for _ in range(n))


# --- tokenizer


def same_ids(enc, texts):
    ids, off = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids


@pytest.fixture
def enc():
    e = encoder(default_path())
    e._forget()
    yield e
    e._forget()


def test_words_with_equal_polynomial_hashes(enc):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    same_ids(enc, [a, b, f"{b} {a} {b}"])


def test_full_table_and_equal_hashes(enc, monkeypatch):
    texts = [" ".join(word(R.randint(1, 24)) for _ in range(1500)) + "don't 12a ÉÀ" for _ in range(4)]
    monkeypatch.setattr(wordbpe, "SLOTS", 256)
    monkeypatch.setattr(wordbpe, "MEMO", 300)
    enc._forget()
    same_ids(enc, texts)
    real = wordbpe.ends_hash
    monkeypatch.setattr(wordbpe, "ends_hash", lambda h, t, n: real(h, t, n) & np.uint64(7))
    enc._forget()
    same_ids(enc, texts[:1])


def test_texts_without_blanks_and_in_parts(enc, monkeypatch):
    zh = "".join(chr(R.randrange(0x4E00, 0x9FA5)) for _ in range(3000))
    monkeypatch.setattr(wordbpe, "PART", 200)
    monkeypatch.setattr(wordbpe, "GAP", 300)
    monkeypatch.setattr(wordbpe, "SLICE", 500)
    monkeypatch.setattr(wordbpe, "PIECE", 700)
    same_ids(enc, [zh, "。".join(zh[i : i + 9] for i in range(0, 900, 9)), None, "", zh[:400] + "don't <|endoftext|> ẞΣ" + zh[:50], "ab" * 900 + "é", word(2000), "a b's " * 700, "x\x1cy ’ 1 " * 90])


# --- sharding


def test_equal_texts_share_a_shard(spark):
    texts = [t for _ in range(300) for t in [" ".join(word() for _ in range(R.randint(1, 60)))] for _ in range(R.randint(1, 3))] + ["heavy " * 30] * 60 + [None, None, "", ""]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "y")]
    got = sharding.assign(sharding.keyed(spark.createDataFrame(rows, "doc_id long, text string, size string"))).collect()
    assert len(got) == len(rows)
    where, total = defaultdict(set), Counter()
    for r in got:
        t = "no id" if r.doc_id is None else texts[r.doc_id]
        b = (t or "").encode()
        assert (r["size"], r.text_crc32) == (len(b) + 1, zlib.crc32(b))
        where[t].add(r.shard)
        total[r.shard] += r["size"]
    assert all(len(s) == 1 for s in where.values())
    mean = sum(total.values()) / sharding.SHARDS
    assert set(total) <= set(range(8)) and max(abs(total[j] - mean) for j in range(8)) < 0.02 * mean
    for j in total:
        assert sorted(r.slot for r in got if r.shard == j) == list(range(sum(r.shard == j for r in got)))


def test_only_texts_beyond_a_shard_are_cut(spark):
    texts = ["a" * 99] * 400 + ["b" * 99] * 90 + [word(30) for _ in range(900)]
    rows = sharding.assign(sharding.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    total, shards = Counter(), defaultdict(set)
    for r in rows:
        total[r.shard] += r["size"]
        shards[texts[r.doc_id]].add(r.shard)
    mean = sum(total.values()) / 8
    assert max(abs(x - mean) for x in total.values()) < 0.02 * mean and len(total) == 8
    assert len(shards["a" * 99]) > 1 and all(len(s) == 1 for t, s in shards.items() if t != "a" * 99)


# --- URL templates


def tree_of(paths, least=urltree.MIN_PAGES, share=urltree.MIN_SHARE):
    """{(host, path): (family, template)} of {(host, path): pages}."""
    out = {}

    def grow(host, template, family, members):
        n = sum(paths[host, p] for p, _ in members)
        if len({tuple(r) for _, r in members}) == 1 or n < least:
            one = len({tuple(r) for _, r in members}) == 1
            for p, r in members:
                whole = one or not r
                out[host, p] = (family + ("/*" * len(r) if whole else "/**"), template + ("".join("/" + s for s in r) if whole else "/**"))
            return
        k = 0
        while all(len(r) > k for _, r in members) and len({r[k] for _, r in members}) == 1:
            k += 1
        if k:
            grow(host, template + "".join("/" + s for s in members[0][1][:k]), family + "/*" * k, [(p, r[k:]) for p, r in members])
            return
        seen, below = Counter(), defaultdict(list)
        for p, r in members:
            if r:
                seen[r[0]] += paths[host, p]
        for p, r in members:
            if not r:
                out[host, p] = (family, template)
            else:
                below[r[0] if seen[r[0]] >= least and seen[r[0]] >= share * n else None].append((p, r[1:]))
        for s, m in below.items():
            grow(host, template + ("/*" if s is None else "/" + s), family + "/*", m)

    for host in {h for h, _ in paths}:
        mine = [(p, [s for s in p.split("/") if s]) for h, p in paths if h == host]
        # Equal rests under different paths (a//b, a/b) are paths of their own.
        grow(host, "", "", mine)
    return out


def verdicts(urls, rules):
    """[(host, path, rule, verdict, purity, known)] by plain loops."""
    judged = []
    for u in urls:
        host = path = ""
        if u and "://" in u:
            tail = u.split("://", 1)[1]
            host = re.split("[/?#]", tail, maxsplit=1)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            path = re.split("[?#]", tail, maxsplit=1)[0]
            path = path[len(re.split("[/?#]", tail, maxsplit=1)[0]) :]
        fits = [(len(r), r, v) for r, v in rules if (h := r.partition("/")[0], p := "/" + r.partition("/")[2]) and (host == h or host.endswith("." + h)) and path.startswith(p)]
        judged.append([host, path, *(max(fits)[1:] if fits else (None, None))])
    paths = Counter((h, p) for h, p, _, _ in judged)
    tree = tree_of(paths)
    lab = defaultdict(lambda: [0, 0])
    for h, p, _, v in judged:
        if v:
            f, t = tree[h, p]
            for key in ((h, f, t), (h, f), (h,), ()):
                lab[key][0] += v == "block"
                lab[key][1] += 1
    smooth = lambda b, n, to: (b + urltree.PRIOR * to) / (n + urltree.PRIOR)
    g = lab[()][0] / lab[()][1] if lab[()][1] else 0.0
    branch = {}
    for h, f in {k for k in lab if len(k) == 2}:
        rates = defaultdict(lambda: [0, 0])
        for k in [k for k in lab if len(k) == 3 and k[:2] == (h, f)]:
            r = rates[lab[k][0] / lab[k][1]]
            r[0] += lab[k][0]
            r[1] += lab[k][1]
        groups, last = [], None
        for r in sorted(rates):
            b, n = rates[r]
            new = True
            if last is not None:
                pooled = (b + last[0] + 1) / (n + last[1] + 2)
                new = b / n - last[0] / last[1] > urltree.ALIKE * (pooled * (1 - pooled) * (1 / n + 1 / last[1])) ** 0.5
            groups = groups + [[r]] if new else [*groups[:-1], groups[-1] + [r]]
            last = (b, n)
        for grp in groups:
            total = [sum(rates[r][i] for r in grp) for i in (0, 1)]
            for r in grp:
                branch[h, f, r] = total
    for row in judged:
        if row[3] is None:
            h, p = row[:2]
            f, t = tree[h, p]
            ph = smooth(*lab[h,], g)
            pf = smooth(*lab[h, f], ph)
            b, n = lab[h, f, t]
            purity = smooth(*branch[h, f, b / n], pf) if n else pf
            row += [purity, "branch" if n else "family" if lab[h, f][1] else "host" if lab[h,][1] else "none"]
            row[3] = "block" if purity >= urltree.REJECT else "allow"
        else:
            row += [None, None]
    return judged


def test_templates_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net", "http://x.com/a?b://c/d", "ftp://a.net/es/\u2028\n/x#y", "http://a.net//es//1"]
    for host in ("a.net", "b.net", "www.c.org", "d.com", "e.org", "www.example.com"):
        for _ in range(70):
            urls.append(f"http://{host}/{R.choice(['en', 'es', 'fr', 'it'])}/{R.choice(['news', 'p', word(2)])}/{R.randrange(40)}" + R.choice(["", "/", f"/{word(1)}", f"/deep/er/and/{R.randrange(9)}/{word(3)}/x"]))
    urls += ["http://a.net/same/" + "q/" * 200] * 9 + ["http://f.org/" + "r/" * 150 + str(k) for k in range(30)] + ["http://g.net/es/1", "http://g.net/de/1", "http://h.org/only"]
    rules = (*urltree.RULES, ("c.org/es/", "block"), ("f.org/" + "r/" * 150 + "2", "block"))
    df = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(urls)] + [(None, "http://e.org/en/p/1", None, None)], "page_id long, url string, host string, purity double")
    got = {r.page_id: r for r in urltree.judge(df, rules).collect()}
    want = verdicts([*urls, "http://e.org/en/p/1"], rules)
    assert len(got) == len(urls) + 1
    for i, (host, path, rule, verdict, purity, known) in enumerate(want):
        r = got[i if i < len(urls) else None]
        assert (r.host, r.path, r.rule, r.verdict, r.known) == (host, path, rule, verdict, known), urls[i]
        assert purity is None and r.purity is None or abs(r.purity - purity) < 1e-9
    assert {k for *_, k in want} == {None, "branch", "family", "host", "none"} and {v for _, _, r, v, _, _ in want if r is None} == {"allow", "block"}
    assert urltree.judge(df.limit(0)).count() == 0


# --- archives

ODD = ["http://a/\u2028Content-Length: 5", "http://a/\u0085WARC-Refers-To: <urn:page:7>", "u\r\nWARC-Type: revisit", "v\x0bWARC-Type: revisit\x0c\u2029x", None, ""]


@pytest.mark.parametrize("least", [0, 6])
def test_read_back_equals_brute_force(spark, tmp_path, least):
    pages = [(i, ODD[i % 6], R.choice(["<p>é</p>", "", None, "a\r\n\r\nb", "solo %d" % i, "\r\n\r\n"])) for i in range(80)]
    pages += [(7, ODD[1], "twice"), (7, ODD[0], "twice"), (7, ODD[0], "twice"), (None, "n", "twice"), (None, "n", "null only")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, header string, sha256 int")
    at = f"file://{tmp_path}/a"
    warc.write(df, at, least)
    got = Counter(tuple(r) for r in warc.read_back(spark, at).collect())
    want, groups = Counter(), defaultdict(list)
    for p, u, h in pages:
        groups[(h or "").encode()].append((p, u or ""))
    for b, rows in groups.items():
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        lead = max(rows, key=lambda r: (r[0] is not None, r[0] or 0))[0]
        for k, (p, _) in enumerate(sorted(rows, key=lambda r: (r[0] != lead, r[1]))):
            first = k == 0 or len(b) < least
            want[p, len(b), digest, "response" if first else "revisit", None if first else lead] += 1
    assert got == want
    whole = {(r.page_id, bytes(r.payload)) for r in warc.records(spark, at).collect()}
    assert whole == {(p, (h or "").encode()) for p, _, h in pages}
    at = f"file://{tmp_path}/none"
    warc.write(df.limit(0), at)
    assert warc.read_back(spark, at).count() == warc.records(spark, at).count() == 0


def test_a_changed_payload_is_noticed(spark, tmp_path):
    at = f"file://{tmp_path}/a"
    warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), at)
    spark.read.parquet(f"{at}/payloads").withColumn("payload", F.lit(b"y")).write.parquet(f"{at}/other")
    with pytest.raises(Exception, match="does not match its digest"):
        moved = f"file://{tmp_path}/b"
        spark.read.parquet(f"{at}/headers").write.parquet(f"{moved}/headers")
        spark.read.parquet(f"{at}/other").write.parquet(f"{moved}/payloads")
        warc.read_back(spark, moved).collect()


def test_few_edges_are_connected_in_one_task(spark, monkeypatch):
    r = random.Random(11)
    edges = [(k, k + 1) for k in range(1000, 1200)] + [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)] + [(5000, 5000 + k) for k in range(40)] + [(7, 7), (-(1 << 63), (1 << 63) - 1)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        before = dict(root)
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    made = []
    monkeypatch.setattr(components, "cut", lambda df: made.append(1) or common.cut(df))
    df = spark.createDataFrame(edges, "a long, b long")
    got = lambda **k: sorted((x.node, x.root) for x in components.connected_components(df, **k).collect())
    assert got() == sorted(root.items()) and len(made) == 2
    assert got(small=0) == sorted(root.items()) and len(made) > 6
    assert components.connected_components(df.limit(0)).count() == 0
