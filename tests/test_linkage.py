"""The whole path on small files, and audits of what it writes."""

import random

import pytest

from kindred.operators import audit, model
from kindred.functions.pairs import FEATURES, pair_features
from kindred.plans.linkage import Linkage

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def company(r):
    return f"{r.choice(['Alpha', 'Beta', 'Gamma', 'Delta', 'Omega'])} {''.join(r.choice('bcdfglmnprst') + r.choice('aeiou') for _ in range(3))} {r.choice(['Ltd', 'Inc', 'GmbH'])}", f"{r.randrange(1, 900)} {''.join(r.choice('bcdfglmnprst') + r.choice('aeiou') for _ in range(3))} Street"


def noisy(r, text):
    w = text.split()
    if r.random() < 0.4:
        w[-1] = w[-1].upper() + "."
    if r.random() < 0.3:
        k = r.randrange(len(w))
        w[k] = w[k][:-1] + r.choice("aeiou")
    return " ".join(w)


def files(folder, part, seed, refs=160):
    r = random.Random(seed)
    rows, truth, n = {1: [], 2: [], 3: []}, [], 0
    for k in range(refs):
        country = r.choice(["US", "India"])
        name, address = company(r)
        rows[1].append((f"S1-{k:04}", name, address, country))
        mine = []
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            src, n = r.choice([2, 3]), n + 1
            rows[src].append((f"S{src}-{n:04}", noisy(r, name), noisy(r, address) if r.random() > 0.1 else "", country))
            mine.append(rows[src][-1][0])
        truth.append((f"S1-{k:04}", ",".join(mine)))
    for _ in range(refs // 2):
        src, n = r.choice([2, 3]), n + 1
        rows[src].append((f"S{src}-{n:04}", *company(r), r.choice(["US", "India"])))
    out = []
    for src in (1, 2, 3):
        out.append(f"{folder}/{part}{src}.tsv")
        open(out[-1], "w").write(HEAD + "".join("\t".join(x) + "\n" for x in rows[src]))
    open(f"{folder}/{part}-truth.tsv", "w").write("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(x) + "\n" for x in truth))
    return tuple(out), f"{folder}/{part}-truth.tsv", {a: set(b.split(",")) - {""} for a, b in truth}


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("link"))
    train, truth, _ = files(at, "train", 1)
    test, _, known = files(at, "test", 2, 60)
    return Linkage(spark, f"file://{at}/work", train, truth, test, config=model.TrainConfig(rounds=4, depth=3, least=2)), at, known


def f_half(t, s):
    return 1.0 if not t and not s else 0.0 if not t or not s else 5 * len(t & s) / (len(t) + 4 * len(s))


def test_from_files_to_checked_results(path):
    link, at, known = path
    assert sum(link.ingest()["rows"].values()) == link.records().count()
    report = link.train_models()
    assert report["release"]["stage"] in ("first", "second") and len(report["top_features"]) == 20
    assert 0.5 < report["second"]["D"]["all"]["macro"] <= 1
    again = Linkage(link.spark, link.root, link.train, link.truth, link.test, config=link.config)
    assert again.release()["policy"] == report["release"]["policy"]
    assert link.choose()["chosen"] in ("owner", "threshold")
    a, b = link.calibrate()["calibrator"]
    assert a <= 0
    assert {"all", "singletons"} <= set(link.audit("A", least=1)["slices"])
    again = link.reselect(update=True)
    assert again["found"]["D"]["all"]["macro"] >= again["frozen"]["D"]["all"]["macro"] - 1e-9
    from kindred.__main__ import main

    step = ["--root", link.root, "--train", *link.train, "--truth", link.truth, "--test", *link.test, "--output", f"file://{at}/out"]
    out = main(["export", *step])
    assert out["edges"] >= out["selected"] > 0 and out["multi_owner"] == 0
    assert main(["validate", *step])["pass"]
    said = {x.split("\t")[0]: set(x.rstrip("\n").split("\t")[1].split(",")) - {""} for x in open(f"{at}/out/matching_results.tsv").readlines()[1:]}
    assert set(said) == set(known) and sum(f_half(known[k], said[k]) for k in known) / len(known) > 0.6


def test_a_release_holds_for_its_own_models_only(path):
    link, *_ = path
    other = Linkage(link.spark, link.root, link.train, link.truth, link.test, features=list(FEATURES[:37]))
    with pytest.raises(ValueError, match="features differ"):
        other.release()
    with pytest.raises(ValueError, match="unknown features"):
        Linkage(link.spark, link.root, link.train, link.truth, features=["no such"])


def test_features_keep_their_order(spark):
    assert tuple(pair_features()) == FEATURES and len(FEATURES) == 50


def listed(spark, folder, matches, candidates):
    (folder / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + matches)
    (folder / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\n" + candidates)
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "ref_id string")
    known = spark.createDataFrame([("S2-1",), ("S3-1",)], "tgt_id string")
    return str(folder / "m.tsv"), str(folder / "c.tsv"), required, known


GOOD = "S1-1\tS2-1\nS1-2\t\n"
FAULTS = [
    ("S1-1\tS2-1\n", GOOD, "match row missing"), (GOOD + "S1-2\t\n", GOOD, "match row repeated"), (GOOD + "S1-9\t\n", GOOD, "match row not required"),
    ("S1-1\tS2-1,S2-1\nS1-2\t\n", GOOD, "match id repeated"), ("S1-1\tS1-2\nS1-2\t\n", GOOD, "match of itself"), ("S1-1\tX-1\nS1-2\t\n", GOOD, "match id of no source"),
    ("S1-1\tS2-7\nS1-2\t\n", GOOD, "match id unknown"), ("S1-1\tS3-1\nS1-2\t\n", GOOD, "match outside the candidates"), (GOOD, "S1-1\tS2-1,S2-9\nS1-2\t\n", "candidate id unknown"),
]


@pytest.mark.parametrize(("matches", "candidates", "check"), FAULTS)
def test_each_fault_is_found(spark, tmp_path, matches, candidates, check):
    m, c, required, known = listed(spark, tmp_path, matches, candidates)
    assert check in {r.check for r in audit.file_violations(spark, m, c, required, known).collect()}
    soft = {r.check: r.severity for r in audit.official_findings(spark, m, c, required, known).collect()}
    assert soft[check] == ("warning" if check == "match outside the candidates" else "error")


def test_good_files_pass_and_broken_ones_are_named(spark, tmp_path):
    m, c, required, known = listed(spark, tmp_path, GOOD, GOOD)
    assert audit.file_violations(spark, m, c, required, known).count() == 0 and audit.passed(audit.official_findings(spark, m, c, required))
    soft = audit.official_findings(spark, m, f"{tmp_path}/none.tsv", required)
    assert [(r.severity, r.check) for r in soft.collect()] == [("warning", "candidate file missing")]
    assert [r.check for r in audit.file_violations(spark, f"{tmp_path}/none.tsv", c, required, known).collect()] == ["match file missing"]
    for head, said in (("", "match file empty"), ("source1_entity_id,matched_entity_ids\n", "match header looks comma-separated"), ("a\tb\n", "match header wrong")):
        (tmp_path / "m.tsv").write_text(head)
        assert said in {r.check for r in audit.official_findings(spark, m, c, required).collect()}
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\nS1-2\t\n")
    assert "match row without a tab" in {r.check for r in audit.official_findings(spark, m, c, required).collect()}


def test_support_is_what_was_scored(spark, tmp_path):
    _, c, required, _ = listed(spark, tmp_path, GOOD, "S1-1\tS2-1,S3-1\nS1-2\t\n")
    edges = lambda rows: spark.createDataFrame(rows, "ref_id string, tgt_id string")
    assert audit.scored_support(spark, c, edges([("S1-1", "S2-1"), ("S1-1", "S3-1")]), required).count() == 0
    got = {(r.check, r.entity, r.detail) for r in audit.scored_support(spark, c, edges([("S1-1", "S2-1"), ("S1-2", "S3-1")]), required).collect()}
    assert got == {("scored pair not exported", "S1-2", "S3-1"), ("exported pair not scored", "S1-1", "S3-1")}
    listed(spark, tmp_path, GOOD, "S1-2\t\nS1-1\tS2-1\n")
    assert {r.check for r in audit.scored_support(spark, c, edges([("S1-1", "S2-1")]), required).collect()} == {"candidate row out of order"}


def test_calibration_and_bounds(spark):
    r = random.Random(3)
    rows = [(s, float(r.random() < 1 / (1 + 2.718281828 ** (-6 * s + 3)))) for s in (r.random() for _ in range(4000))]
    a, b = model.platt_fit(spark.createDataFrame(rows, "score double, label double"))
    assert a == pytest.approx(-6, abs=0.6) and b == pytest.approx(3, abs=0.4)
    a, _ = model.platt_fit(spark.createDataFrame([(s, 1 - y) for s, y in rows], "score double, label double"))
    assert a == pytest.approx(0, abs=1e-3)
    bounds = model.poisson_bounds()
    assert len(bounds) > 15 and bounds[0] == pytest.approx(0.36787944) and bounds[-1] < 1
    deltas = [(k, r.gauss(0.1, 1)) for k in range(400)]
    got = model.bootstrap_bound(spark.createDataFrame(deltas, "ref_id long, delta double"), 300).first()
    mean = sum(d for _, d in deltas) / 400
    assert got.mean == pytest.approx(mean) and got.lower == pytest.approx(mean - 1.645 / 20, abs=0.03)


def test_background_targets_are_unsupervised(spark):
    roles = spark.createDataFrame([("r1", "F"), ("r2", "B"), ("t1", "F"), ("t2", "B"), ("t3", "F")], "rec_id string, role string")
    edges = spark.createDataFrame([(2, t, r) for t in ("t1", "t2", "t3") for r in ("r1", "r2")], "src int, tgt_id string, ref_id string")
    truth = spark.createDataFrame([("r1", "t1"), ("r2", "t2"), ("r2", "t3")], "ref_id string, tgt_id string")
    got = {(x.ref_id, x.tgt_id): x.label for x in model.supervised(model.with_roles(edges, roles), truth).collect()}
    assert got == {("r1", "t1"): 1, ("r2", "t1"): 0, ("r1", "t2"): None, ("r2", "t2"): None, ("r1", "t3"): 0, ("r2", "t3"): 0}
