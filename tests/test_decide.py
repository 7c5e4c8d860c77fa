import random

import pytest

from kindred.operators import audit, decide, retrieval


def f_half(t, s):
    if not t and not s:
        return 1.0
    if not t or not s:
        return 0.0
    return 5 * len(t & s) / (len(t) + 4 * len(s))


@pytest.mark.parametrize("seed", range(3))
def test_threshold_and_owner_sweeps_match_brute_force(spark, seed):
    r = random.Random(seed)
    refs = list(range(6))
    edges = [(2, t, ref, r.choice([0.1, 0.3, 0.5, 0.52, 0.9])) for t in range(100, 112) for ref in r.sample(refs, r.randint(1, 3))]
    truth = [(r.choice(refs), t) for t in range(100, 112) if r.random() < 0.7]
    e = spark.createDataFrame(edges, "src int, tgt_id long, ref_id long, score double")
    t = spark.createDataFrame(truth, "ref_id long, tgt_id long")
    req = spark.createDataFrame([(x,) for x in refs], "ref_id long")
    true = {x: {b for a, b in truth if a == x} for x in refs}

    def macro(chosen, tau):
        return sum(f_half(true[x], {b for _, b, ref, s in chosen if ref == x and s >= tau}) for x in refs) / len(refs)

    for row in decide.threshold_sweep(e, t, req).collect():
        assert row.macro == pytest.approx(macro(edges, row.tau))
    for row in decide.owner_sweep(e, t, req, (0.0, 0.05)).collect():
        won = []
        for tgt in {x[1] for x in edges}:
            s = sorted((x for x in edges if x[1] == tgt), key=lambda x: -x[3])
            if len(s) == 1 or s[0][3] > s[1][3] and s[0][3] - s[1][3] >= row.gamma:
                won.append(s[0])
        best = max((round(macro(won, tau), 9), -tau) for tau in {*(x[3] for x in won), float("inf")})
        assert (row.macro, -row.tau) == best
    grid = decide.tau_grid(e, t, req, points=50)
    assert grid["macro"] <= max(macro(edges, tau) for tau in {*(x[3] for x in edges), 2.0}) + 1e-12 and grid["macro"] == pytest.approx(macro(edges, grid["tau"]))
    table = decide.policy_table(e, t, req)
    for r_ in table.collect():
        policy = {k: v for k, v in r_.asDict().items() if v is not None}
        said = [tuple(x) for x in decide.apply_policy(e, policy).select("src", "tgt_id", "ref_id", "score").collect()] if r_.tau != float("inf") else []
        assert r_.macro == pytest.approx(macro(said, -1), abs=2e-9), policy
    best = decide.select_policy(table)
    assert best["macro"] == pytest.approx(max(r_.macro for r_ in table.collect()), abs=2e-9)


def test_compaction_keeps_ties(spark):
    pool = spark.createDataFrame([(2, 1, k, v) for k, v in enumerate([0.9, 0.5, 0.5, 0.1])], "src int, tgt_id long, ref_id long, v double")
    assert sorted(x.ref_id for x in retrieval.compact(pool, 2).collect()) == [0, 1, 2]


def test_joint_hits_enter_with_zero(spark):
    pool = spark.createDataFrame([(2, 1, 7, 0.9, 1, None, 3.0, None, None, 1)], "src int, tgt_id long, ref_id long, v double, name_rank int, addr_rank int, name_score double, addr_score double, margin double, pool_size long")
    joined = spark.createDataFrame([(2, 1, 8, 4.0, 1)], "src int, tgt_id long, ref_id long, joint_score double, joint_rank int")
    got = {x.ref_id: (x.v, x.joint_rank, x.pool_size) for x in retrieval.with_joint(pool, joined).collect()}
    assert got == {7: (0.9, 0, 1), 8: (0.0, 1, 1)}


def test_audit_finds_each_kind(spark):
    lists = lambda rows: spark.createDataFrame(rows, "ref_id long, ids array<long>")
    required = spark.createDataFrame([(1,), (2,)], "ref_id long")
    known = spark.createDataFrame([(10,), (11,)], "tgt_id long")
    got = {(x.check, x.entity, x.detail) for x in audit.violations(required, lists([(1, [10, 10]), (3, [99])]), lists([(1, [11]), (2, [])]), known).collect()}
    assert {("match row missing", "2", ""), ("match row not required", "3", ""), ("match id repeated", "1", "10"), ("match id unknown", "3", "99"), ("match outside the candidates", "1", "10")} <= got


def test_competition_rivals(spark):
    e = spark.createDataFrame([(2, 1, 5, 0.9), (2, 1, 6, 0.4), (2, 2, 5, 0.3)], "src int, tgt_id long, ref_id long, score double")
    got = {(x.tgt_id, x.ref_id): (x.t_rank, round(x.t_gap_other, 6), x.r_n, round(x.r_gap_max, 6)) for x in decide.competition(e).collect()}
    assert got == {(1, 5): (0, 0.5, 2, 0.0), (1, 6): (1, -0.5, 1, 0.0), (2, 5): (0, 1.3, 2, -0.6)}


def brute_expected(probs, beta, floor):
    """How many of the falling probabilities are taken."""
    empty, best, take = 1.0, -1.0, 0
    for p in probs:
        empty *= max(1 - p, 1e-12)
    for k in range(1, len(probs) + 1):
        if probs[k - 1] > floor:
            v = round(5 * sum(probs[:k]) / (sum(probs) + beta + 4 * k), 9)
            if v > best:
                best, take = v, k
    return take if best > round(empty, 9) else 0


def test_expected_f_equals_brute_force(spark):
    r = random.Random(4)
    edges = [(2, 100 * ref + k, ref, r.choice([0.0, 0.05, 0.3, 0.6, 0.9, 1.0])) for ref in range(30) for k in range(r.randint(1, 6))]
    e = spark.createDataFrame(edges, "src int, tgt_id long, ref_id long, score double")
    for beta, floor in ((0.0, 0.0), (0.3, 0.1)):
        got = {ref: 0 for ref in range(30)}
        for x in decide.expected_f(e, beta, floor).collect():
            got[x.ref_id] += 1
        assert got == {ref: brute_expected(sorted((s for *_, f, s in edges if f == ref), reverse=True), beta, floor) for ref in range(30)}


def test_row_thresholds_and_predictions(spark):
    e = spark.createDataFrame([(2, 1, 5, 0.9), (2, 2, 5, 0.7), (2, 3, 5, 0.6), (2, 4, 6, 0.5), (3, 4, 7, 0.8)], "src int, tgt_id long, ref_id long, score double")
    got = decide.apply_policy(e, {"kind": "rows", "gamma": 0.0, "start": 0.6, "extra": 0.7})
    assert sorted((x.ref_id, x.tgt_id) for x in got.collect()) == [(5, 1), (5, 2), (7, 4)]
    lists = {x.ref_id: [t.tgt_id for t in x.tgt_ids] for x in decide.predictions(got, e).collect()}
    assert lists == {5: [1, 2], 6: [], 7: [4]}
    with pytest.raises(ValueError, match="kind"):
        decide.apply_policy(e, {"kind": "other"})


def test_missing_truth_is_an_error(spark):
    required, truths = (spark.createDataFrame([(x,) for x in ids], "ref_id long") for ids in ((1, 2), (1,)))
    with pytest.raises(ValueError, match="2 is missing"):
        decide.checked_truth(required, truths)
    assert decide.checked_truth(truths, required).count() == 1


def test_address_pairs_and_adaptive_budget(spark):
    posts = spark.createDataFrame([("x", "addr", t, r, 3) for r, ts in {1: ["12", "high", "st"], 2: ["12", "low"], 3: ["high", "st"]}.items() for t in ts], "country string, field string, term string, ref_id long, dl int")
    targets = spark.createDataFrame([(2, 9, "x", ["12", "high", "st"]), (2, 10, "x", ["st", "high", "none"]), (2, 11, "x", ["low"])], "src int, rec_id long, country string, addr_set array<string>")
    got = {(x.tgt_id, x.ref_id) for x in retrieval.address_pairs(targets, retrieval.df_map(posts), posts).collect()}
    assert got == {(9, 1), (10, 1), (10, 3)}
    rows = [(2, t, r, v, n, a) for t in (1, 2, 3) for r, v, n, a in ((7, 1.0, 1, 1 if t < 3 else 2), (8, 0.6, 2, 2 if t < 3 else 1), (9, 0.5, 3, 3), (10, 0.4, 4, 4))]
    pool = spark.createDataFrame(rows, "src int, tgt_id long, ref_id long, v double, name_rank int, addr_rank int").selectExpr("*", "IF(tgt_id = 2, 0.01D, 0.4D) AS margin")
    flags = spark.createDataFrame([(2, 1, False, False), (2, 2, True, False), (2, 3, False, False)], "src int, tgt_id long, addr_missing boolean, indic boolean")
    kept = [x.tgt_id for x in retrieval.adaptive_budget(pool, flags).collect()]
    assert [kept.count(t) for t in (1, 2, 3)] == [1, 3, 3]
