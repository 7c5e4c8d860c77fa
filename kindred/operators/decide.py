"""Decisions over scored edges (src, tgt_id, ref_id, score): competition features, owners, thresholds, policies, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import best_f_half, f_half

TGT = ["src", "tgt_id"]


def cosine_competition(edges: DataFrame, high: float = 0.9) -> DataFrame:
    """(src, tgt_id, ref_id, c, c_t_rank, c_t_gap_other, c_r_rank, c_r_gap_max) of edges with a cosine `c`: the same
    competition by cosine instead of by score."""
    c = competition(edges.withColumn("score", F.col("c")), high)
    return c.select(*TGT, "ref_id", F.col("s1").alias("c"), F.col("t_rank").alias("c_t_rank"), F.col("t_gap_other").alias("c_t_gap_other"), F.col("r_rank").alias("c_r_rank"), F.col("r_gap_max").alias("c_r_gap_max"))


def competition(edges: DataFrame, high: float = 0.5) -> DataFrame:
    """Adds s1 and, for the target (t_) and the reference (r_), group size, rank, distance to the rival or best, high scores."""
    t, r = Window.partitionBy(*TGT), Window.partitionBy("ref_id")
    by_t, by_r = t.orderBy(F.desc("score"), "ref_id"), r.orderBy(F.desc("score"), *TGT)
    rank = F.row_number().over(by_t) - 1
    rival = F.when(rank == 0, F.coalesce(F.lead("score").over(by_t), F.lit(-1.0))).otherwise(F.max("score").over(t))
    return edges.select(
        *TGT, "ref_id", F.col("score").alias("s1"), F.count(F.lit(1)).over(t).alias("t_n"), F.count(F.lit(1)).over(r).alias("r_n"), rank.alias("t_rank"), (F.row_number().over(by_r) - 1).alias("r_rank"),
        (F.col("score") - rival).alias("t_gap_other"), (F.col("score") - F.max("score").over(r)).alias("r_gap_max"), F.count_if(F.col("score") >= high).over(t).alias("t_n_hi"), F.count_if(F.col("score") >= high).over(r).alias("r_n_hi"),
    )


def owners(edges: DataFrame, gamma: Column | float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """The edge of each target's single best reference, if it leads by gamma; exact ties abstain."""
    w = Window.partitionBy(*keys, *TGT).orderBy(F.desc("score"), "ref_id")
    out = edges.withColumn("k", F.row_number().over(w)).withColumn("rival", F.lead("score").over(w))
    lead = F.col("rival").isNull() | (F.col("score") > F.col("rival")) & (F.col("score") - F.col("rival") >= gamma)
    return out.where((F.col("k") == 1) & lead).drop("k", "rival")


def counts(selected: DataFrame, truth: DataFrame, required: DataFrame) -> DataFrame:
    """(ref_id, n_true, n_said, tp) of every required reference; absent predictions are empty."""
    t = truth.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n_true"))
    hit = truth.select("ref_id", "tgt_id", F.lit(1).alias("hit"))
    s = selected.join(hit, ["ref_id", "tgt_id"], "left").groupBy("ref_id").agg(F.count(F.lit(1)).alias("n_said"), F.count("hit").alias("tp"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_true", "n_said", "tp")]
    return required.select("ref_id").distinct().join(t, "ref_id", "left").join(s, "ref_id", "left").select("ref_id", *zero)


def entity_scores(c: DataFrame) -> DataFrame:
    return c.withColumn("f", f_half(F.col("tp"), F.col("n_true"), F.col("n_said")))


def score_report(selected: DataFrame, candidates: DataFrame, truth: DataFrame, required: DataFrame) -> DataFrame:
    """One row: macro, oracle, blocking and scoring loss, tp, fp, fn, empty predictions and truths."""
    said = entity_scores(counts(selected, truth, required))
    reach = counts(candidates, truth, required).select("ref_id", F.col("tp").alias("reachable"))
    each = said.join(reach, "ref_id").withColumn("best", best_f_half(F.col("n_true"), F.col("reachable")))
    return each.agg(
        F.avg("f").alias("macro"), F.avg("best").alias("oracle"), (1 - F.avg("best")).alias("blocking_loss"), (F.avg("best") - F.avg("f")).alias("scoring_loss"), F.sum("tp").alias("tp"),
        F.sum(F.col("n_said") - F.col("tp")).alias("fp"), F.sum(F.col("n_true") - F.col("tp")).alias("fn"), F.count_if(F.col("n_said") == 0).alias("empty_said"), F.count_if(F.col("n_true") == 0).alias("empty_true"),
    )


def checked_truth(required: DataFrame, truths: DataFrame) -> DataFrame:
    """`required`, if each of its references has a row in `truths` (ref_id, ..); else an error. Truths may be empty lists."""
    lost = required.join(truths, "ref_id", "left_anti").select("ref_id").limit(1).collect()
    if lost:
        raise ValueError(f"truth of the required reference {lost[0].ref_id} is missing")
    return required


def evaluate(selected: DataFrame, candidates: DataFrame, truth: DataFrame, required: DataFrame, least: int = 200) -> DataFrame:
    """(slice, refs, macro, oracle, tp, fp, fn, said_per_ref, true_per_ref): over all references, without true links
    (`singletons`), with some (`linked`), and by country, where that has `least` references. required: (ref_id, country)."""
    country = required.groupBy("ref_id").agg(F.min("country").alias("country"))
    reach = counts(candidates, truth, required).select("ref_id", F.col("tp").alias("reach"))
    each = entity_scores(counts(selected, truth, required)).join(reach, "ref_id").join(country, "ref_id").withColumn("best", best_f_half(F.col("n_true"), F.col("reach")))
    kinds = F.array(F.lit("all"), F.when(F.col("n_true") == 0, "singletons").otherwise("linked"), F.concat(F.lit("country:"), F.coalesce("country", F.lit(""))))
    out = each.select("*", F.explode(kinds).alias("slice")).groupBy("slice").agg(
        F.count(F.lit(1)).alias("refs"), F.avg("f").alias("macro"), F.avg("best").alias("oracle"), F.sum("tp").alias("tp"), F.sum(F.col("n_said") - F.col("tp")).alias("fp"),
        F.sum(F.col("n_true") - F.col("tp")).alias("fn"), F.avg("n_said").alias("said_per_ref"), F.avg("n_true").alias("true_per_ref"),
    )
    return out.where(~F.startswith("slice", F.lit("country:")) | (F.col("refs") >= least))


def volumes(edges: DataFrame, selected: DataFrame, sure: float = 0.99) -> DataFrame:
    """(country, edges, refs, selected, said_per_ref, nonempty, middle): of the references with candidates; middle is the
    share of all edges that are selected with a score below `sure`."""
    key = ["src", "tgt_id", "ref_id"]
    mark = selected.select(*key).distinct().withColumn("chosen", F.lit(1))
    by_ref = edges.join(mark, key, "left").groupBy("country", "ref_id").agg(F.count(F.lit(1)).alias("n"), F.count("chosen").alias("s"), F.count_if((F.col("chosen") == 1) & (F.col("score") < sure)).alias("m"))
    out = by_ref.groupBy("country").agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("refs"), F.sum("s").alias("selected"), F.count_if(F.col("s") > 0).alias("some"), F.sum("m").alias("m"))
    return out.select("country", "edges", "refs", "selected", (F.col("selected") / F.col("refs")).alias("said_per_ref"), (F.col("some") / F.col("refs")).alias("nonempty"), (F.col("m") / F.col("edges")).alias("middle"))


def multi_owner(selected: DataFrame) -> DataFrame:
    """(src, tgt_id, n) of targets that several references have."""
    return selected.groupBy(*TGT).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def candidate_sizes(candidates: DataFrame, truth: DataFrame, required: DataFrame) -> DataFrame:
    """One row: how many candidates references have (mean, median, p90, p95, p99, most, share without), and what part of the
    truth they hold: of all links, by reference, references with any and with all of theirs."""
    n = candidates.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n"))
    kept = counts(candidates, truth, required).join(n.select("ref_id", "n"), "ref_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    true = F.col("n_true") > 0
    return kept.agg(
        F.avg("n").alias("mean"), *[F.percentile("n", F.lit(q)).alias(a) for a, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))], F.max("n").alias("most"), F.avg((F.col("n") == 0).cast("double")).alias("without"),
        (F.sum("tp") / F.nullif(F.sum("n_true"), F.lit(0))).alias("micro_recall"), F.avg(F.when(true, F.col("tp") / F.col("n_true"))).alias("macro_recall"),
        F.avg(F.when(true, (F.col("tp") > 0).cast("double"))).alias("any_hit"), F.avg(F.when(true, (F.col("tp") == F.col("n_true")).cast("double"))).alias("all_hit"),
    )


# The buckets of the rank of a target's true reference.
RANKS = ((2, "rank_1_2"), (4, "rank_3_4"), (8, "rank_5_8"), (16, "rank_9_16"), (64, "gt16"))


def rank_bucket(rank: Column) -> Column:
    out = F.lit("not_top64")
    for most, name in reversed(RANKS):
        out = F.when(rank <= most, name).otherwise(out)
    return out


def threshold_sweep(edges: DataFrame, truth: DataFrame, required: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, tau, macro): the mean F0.5 if all edges of at least tau are taken, at every distinct score.

    Each reference's score changes only where it gains edges, so changes are summed by distinct score; the
    running sum is over distinct scores, in two levels of blocks, not over edges.
    """
    req = required.select("ref_id").distinct()
    n_true = truth.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n_true"))
    base = req.join(n_true, "ref_id", "left").select("ref_id", F.coalesce("n_true", F.lit(0)).alias("n_true"))
    hit = truth.select("ref_id", "tgt_id", F.lit(1).alias("hit"))
    step = edges.join(hit, ["ref_id", "tgt_id"], "left").groupBy(*keys, "ref_id", "score").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("h")).join(base, "ref_id")
    down = Window.partitionBy(*keys, "ref_id").orderBy(F.desc("score"))
    step = step.withColumns({"n": F.sum("n").over(down), "h": F.sum("h").over(down)})
    step = step.withColumn("f", f_half(F.col("h"), F.col("n_true"), F.col("n")))
    step = step.withColumn("gain", F.col("f") - F.coalesce(F.lag("f").over(down), F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)))
    gains = step.groupBy(*keys, F.floor(F.col("score") * 256).alias("block"), "score").agg(F.sum("gain").alias("gain"))
    after = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = gains.groupBy(*keys, "block").agg(F.sum("gain").alias("g")).withColumn("before", F.coalesce(F.sum("g").over(after), F.lit(0.0))).drop("g")
    inner = Window.partitionBy(*keys, "block").orderBy(F.desc("score"))
    start = base.agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("n_true") == 0).alias("empty"))
    out = gains.join(blocks, [*keys, "block"]).crossJoin(F.broadcast(start))  # start: one row
    return out.select(*keys, F.col("score").alias("tau"), ((F.col("empty") + F.col("before") + F.sum("gain").over(inner)) / F.col("refs")).alias("macro"))


def base_score(truth: DataFrame, required: DataFrame) -> DataFrame:
    """One row (macro): the mean F0.5 if nothing is said, which is the share of references without a true link."""
    req = required.select("ref_id").distinct()
    some = truth.select("ref_id").distinct().withColumn("some", F.lit(1))
    return req.join(some, "ref_id", "left").agg(F.avg(F.when(F.col("some").isNull(), 1.0).otherwise(0.0)).alias("macro"))


def best_threshold(sweep: DataFrame, keys: tuple[str, ...] = (), base: DataFrame | None = None) -> DataFrame:
    """(keys, macro, tau): the best mean; of equal ones (to nine places) the smallest tau. With the one-row `base` of
    base_score() infinity stands for saying nothing, where every threshold does worse."""
    m = F.round("macro", 9)
    out = sweep.groupBy(*keys).agg(F.max(F.struct(m.alias("macro"), (-F.col("tau")).alias("neg"))).alias("b")).select(*keys, "b.macro", (-F.col("b.neg")).alias("tau"))
    if base is None:
        return out
    none = base.select(F.round("macro", 9).alias("none"))
    if not keys:
        out = none.join(out, F.lit(True), "left")  # both: one row
    else:
        out = out.crossJoin(F.broadcast(none))
    better = F.coalesce(F.col("macro") >= F.col("none"), F.lit(False))
    return out.select(*keys, F.when(better, F.col("macro")).otherwise(F.col("none")).alias("macro"), F.when(better, F.col("tau")).otherwise(float("inf")).alias("tau"))


def owner_sweep(edges: DataFrame, truth: DataFrame, required: DataFrame, gammas=(0.0, 0.02, 0.05, 0.1)) -> DataFrame:
    """(gamma, macro, tau): the best threshold over owners for each margin."""
    each = edges.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    return best_threshold(threshold_sweep(owners(each, F.col("gamma"), ("gamma",)), truth, required, ("gamma",)), ("gamma",), base_score(truth, required))


def expected_f(edges: DataFrame, beta: Column | float = 0.0, floor: Column | float = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges chosen by expected F0.5 of probabilities `score`: per reference (and keys) the best prefix, the shortest of
    equal ones, or none if that all are wrong is at least as likely. beta: links expected outside the edges."""
    beta, floor = (c if isinstance(c, Column) else F.lit(float(c)) for c in (beta, floor))
    q = F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0))
    w = Window.partitionBy(*keys, "ref_id")
    order = w.orderBy(F.desc("q"), *TGT)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    e = edges.withColumn("q", q).withColumns({"k": F.row_number().over(order), "part": F.sum("q").over(upto), "all_q": F.sum("q").over(w)})
    e = e.withColumn("value", F.when(F.col("q") > F.greatest(floor, F.lit(0.0)), F.round(5 * F.col("part") / (F.col("all_q") + beta + 4 * F.col("k")), 9)))
    e = e.withColumns({"best": F.max("value").over(w), "none": F.round(F.exp(F.sum(F.log(F.greatest(1 - F.col("q"), F.lit(1e-12)))).over(w)), 9)})
    e = e.withColumn("last", F.min(F.when(F.col("value") == F.col("best"), F.col("k"))).over(w))
    return e.where((F.col("k") <= F.col("last")) & (F.col("none") < F.col("best"))).select(*edges.columns)


def start_and_extra(edges: DataFrame, start: float, extra: float) -> DataFrame:
    """Per reference: none if its best edge is below `start`, else the best and all others from `extra` on."""
    w = Window.partitionBy("ref_id")
    best = F.row_number().over(w.orderBy(F.desc("score"), *TGT))
    e = edges.withColumn("k_", best).withColumn("top_", F.max("score").over(w))
    return e.where((F.col("top_") >= start) & ((F.col("k_") == 1) | (F.col("score") >= extra))).drop("k_", "top_")


def apply_policy(edges: DataFrame, policy: dict, taus: dict[str, float] | None = None) -> DataFrame:
    """The edges that a policy selects. Its kind is threshold (tau), owner (gamma, tau), efm (gamma, beta, floor) or
    rows (gamma, start, extra). `taus`: other thresholds for some countries, in the column country."""
    kind = policy["kind"]
    if kind == "efm":
        return expected_f(owners(edges, policy["gamma"]), policy["beta"], policy.get("floor", 0.0))
    if kind == "rows":
        return start_and_extra(owners(edges, policy["gamma"]), policy["start"], policy["extra"])
    if kind not in ("threshold", "owner"):
        raise ValueError(f"no policy of the kind {kind}")
    pool = owners(edges, policy["gamma"]) if kind == "owner" else edges
    return by_country(pool, taus or {}, policy["tau"])


def predictions(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref_id, tgt_ids) of every reference that has edges: its selected targets, sorted, maybe none."""
    some = selected.groupBy("ref_id").agg(F.array_sort(F.collect_set(F.struct(*TGT))).alias("tgt_ids"))
    empty = F.array().cast(dict(some.dtypes)["tgt_ids"])
    return edges.select("ref_id").distinct().join(some, "ref_id", "left").select("ref_id", F.coalesce("tgt_ids", empty).alias("tgt_ids"))


def macro(selected: DataFrame, truth: DataFrame, required: DataFrame, keys: DataFrame) -> DataFrame:
    """(keys, macro): the mean F0.5 of selected edges (keys, ref_id, tgt_id) for every row of `keys`, a small table."""
    names = keys.columns
    req = required.select("ref_id").distinct()
    n_true = truth.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n_true"))
    hit = truth.select("ref_id", "tgt_id", F.lit(1).alias("hit"))
    base = req.join(n_true, "ref_id", "left").select("ref_id", F.coalesce("n_true", F.lit(0)).alias("n_true"))
    said = selected.join(hit, ["ref_id", "tgt_id"], "left").groupBy(*names, "ref_id").agg(F.count(F.lit(1)).alias("n_said"), F.count("hit").alias("tp"))
    # Where nothing is said a reference scores 1 or 0 by its truth: only what is said need be summed for each key.
    empty = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    gain = said.join(base, "ref_id").groupBy(*names).agg(F.sum(f_half(F.col("tp"), F.col("n_true"), F.col("n_said")) - empty).alias("gain"))
    start = base.agg(F.count(F.lit(1)).alias("refs"), F.sum(empty).alias("start"))
    each = keys.join(gain, names, "left").crossJoin(F.broadcast(start))  # start: one row
    return each.select(*names, ((F.col("start") + F.coalesce("gain", F.lit(0.0))) / F.col("refs")).alias("macro"))


def policy_table(edges: DataFrame, truth: DataFrame, required: DataFrame, gammas=(0.0, 0.02, 0.05, 0.1, 0.2), efm_gammas=(0.0, 0.1), betas=(0.0, 0.1, 0.3), floors=(0.0, 0.1)) -> DataFrame:
    """(kind, gamma, beta, floor, tau, macro) of every candidate policy, thresholds the best of each family by the exact
    sweep: one threshold, owners for each gamma, expected F for each gamma, beta and floor."""
    spark = edges.sparkSession
    void = F.lit(None).cast("double")
    one = best_threshold(threshold_sweep(edges, truth, required), base=base_score(truth, required))
    out = one.select(F.lit("threshold").alias("kind"), void.alias("gamma"), void.alias("beta"), void.alias("floor"), "tau", "macro")
    swept = owner_sweep(edges, truth, required, gammas)
    out = out.union(swept.select(F.lit("owner"), "gamma", void, void, "tau", "macro"))
    grid = spark.createDataFrame([(float(g), float(b), float(f)) for g in efm_gammas for b in betas for f in floors], "gamma double, beta double, floor double")
    own = owners(edges.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in efm_gammas]))), F.col("gamma"), ("gamma",))
    chosen = expected_f(own.join(F.broadcast(grid), "gamma"), F.col("beta"), F.col("floor"), ("gamma", "beta", "floor"))  # grid: a row for each setting
    scores = macro(chosen, truth, required, grid)
    return out.union(scores.select(F.lit("efm"), "gamma", "beta", "floor", F.lit(0.0), "macro"))


# The order of the families where means tie.
FAMILIES = ("threshold", "owner", "efm")


def select_policy(table: DataFrame) -> dict:
    """The best row of a policy table; of equal means (to nine places) the earlier family, then the smaller settings."""
    family = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(FAMILIES)])
    r = table.orderBy(F.desc(F.round("macro", 9)), family, *[F.asc_nulls_first(c) for c in ("gamma", "beta", "floor", "tau")]).first()
    return {k: v for k, v in r.asDict().items() if v is not None}


def tau_grid(edges: DataFrame, truth: DataFrame, required: DataFrame, points: int = 600, near: float = 0.02, fine: int = 81) -> dict:
    """{tau, macro}: the best threshold of a grid of score quantiles, then of `fine` points around it; infinity if none
    beats saying nothing. The exact sweep is never worse."""
    spark = edges.sparkSession
    inside = edges.join(required.select("ref_id").distinct(), "ref_id", "left_semi")
    best = {"tau": float("inf"), "macro": base_score(truth, required).first().macro}
    shares = [i / (points - 1) for i in range(points)]
    taus = inside.agg(F.percentile("score", F.array(*[F.lit(x) for x in shares])).alias("t")).first().t
    for grid in (taus, None):
        if grid is None:
            if best["tau"] == float("inf"):
                break
            grid = [best["tau"] - near + 2 * near * i / (fine - 1) for i in range(fine)]
        table = spark.createDataFrame([(float(t),) for t in sorted(set(grid or []))], "tau double")
        found = macro(inside.join(F.broadcast(table), F.col("score") >= F.col("tau")), truth, required, table)  # table: a few hundred points
        top = found.orderBy(F.desc("macro"), "tau").first()
        if top and top.macro > best["macro"]:
            best = {"tau": top.tau, "macro": top.macro}
    return best


def by_country(edges: DataFrame, taus: dict[str, float], default: float) -> DataFrame:
    """Edges that reach their country's threshold, `default` where it has none of its own."""
    tau = F.lit(default)
    for c, t in taus.items():
        tau = F.when(F.col("country") == c, t).otherwise(tau)
    return edges.where(F.col("score") >= tau)


def matched_volume(edges: DataFrame, required: DataFrame, per_ref: float, grid: list[float]) -> DataFrame:
    """(tau, per_ref): the grid's threshold whose predictions for each reference come nearest to `per_ref`."""
    e = edges.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in grid])))
    n = required.select("ref_id").distinct().agg(F.count(F.lit(1)).alias("refs"))
    rate = e.groupBy("tau").agg(F.count_if(F.col("score") >= F.col("tau")).alias("n")).crossJoin(F.broadcast(n)).select("tau", (F.col("n") / F.col("refs")).alias("per_ref"))
    return rate.orderBy(F.round(F.abs(F.col("per_ref") - per_ref), 9), "tau").limit(1)
