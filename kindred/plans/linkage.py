"""The whole path from record files to checked result files, stage by stage, over one Store.

ingest, split, environment, retrieve (index, query terms, pool, edges), features, train, choose, calibrate, evaluate,
export, validate. Each table is a stage that is made once and read again; each step leaves a report.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pairs import FEATURES, feature_rows, with_sets
from ..functions.similarity import platt
from ..operators import audit, decide, model, retrieval, splits
from ..sources import records as R
from ..sources.store import Store, written

SOURCES = (1, 2, 3)


@dataclass(frozen=True)
class Recipe:
    """How candidates are retrieved. Models and policies hold for one recipe only."""

    budget: int = retrieval.BUDGET
    lane_k: int = retrieval.LANE_K
    max_terms: int = retrieval.MAX_TERMS
    joint_k: int = retrieval.JOINT_K


@dataclass
class Linkage:
    """`train`, `test`: paths of the three sources' files; `truth`: that of the true links of train."""

    spark: SparkSession
    root: str
    train: tuple[str, str, str]
    truth: str
    test: tuple[str, str, str] | None = None
    recipe: Recipe = field(default_factory=Recipe)
    config: model.TrainConfig = field(default_factory=model.TrainConfig)
    features: list[str] = field(default_factory=lambda: list(FEATURES))

    def __post_init__(self):
        unknown = set(self.features) - set(FEATURES)
        if unknown:
            raise ValueError(f"unknown features {sorted(unknown)}")
        self.store = Store(self.spark, self.root)

    # Relations

    def _state(self, *paths: str) -> list[str]:
        return [x for p in paths for x in self.store.files.state(p)]

    def records(self, part: str = "train") -> DataFrame:
        """Records of the three sources with views, terms and sets: (src, rec_id, country, ..); rec_id is the id in the files."""
        paths = self.train if part == "train" else self.test

        def make() -> DataFrame:
            out = None
            for src, path in zip(SOURCES, paths, strict=True):
                rows = R.read_records(self.spark, path, f"S{src}").select(F.lit(src).alias("src"), F.col("entity_id").alias("rec_id"), "country", F.col("business_name").alias("name_raw"), F.col("business_address").alias("addr_raw"))
                out = rows if out is None else out.unionByName(rows)
            return with_sets(retrieval.with_terms(R.record_views(out)))

        return self.store.table(f"records-{part}", self._state(*paths), make)

    def links(self) -> DataFrame:
        return self.store.table("links", self._state(self.truth), lambda: R.links(R.read_truth(self.spark, self.truth)))

    def ingest(self, part: str = "train") -> dict:
        """Counts by source and country, and targets for each reference."""
        r = self.records(part)
        return self.store.report(f"ingest-{part}", {"rows": {f"S{x.src}:{x.country}": x["count"] for x in r.groupBy("src", "country").count().collect()}, "density": [x.asDict() for x in splits.density(r).collect()]})

    def roles(self, seed: str = "split", audit_share: float = 0.05) -> DataFrame:
        """(rec_id, src, role), A2 reserved out of B; fails where a link's ends differ."""
        r, truth = self.records(), self.links()
        out = self.store.table("roles", [seed, str(audit_share), *self._state(*self.train, self.truth)], lambda: splits.reserve_audit(splits.assign_roles(r, truth, seed), truth, audit_share))
        bad = splits.split_violations(out, truth, splits.components(r, truth)).limit(1).collect()
        if bad:
            raise ValueError(f"the split is broken: {bad[0].asDict()}")
        return out

    def environment(self, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
        """(catalog, traffic) over train, as dense as test is (as train, without one)."""
        like = self.records("test" if self.test else "train")
        quotas = like.where("src = 1").groupBy("country").agg(F.count(F.lit(1)).alias("quota"))
        per = like.groupBy("country").pivot("src", list(SOURCES)).count().na.fill(0)
        density = per.select("country", F.explode(F.array(*[F.struct(F.lit(s).alias("src"), (F.col(str(s)) / F.nullif(F.col("1"), F.lit(0))).alias("per_ref")) for s in (2, 3)])).alias("x")).select("country", "x.*").where("per_ref is not null")
        key = [str(scale), *self._state(*self.train, self.truth, *(self.test or ()))]
        sized = quotas.select("country", F.bround(F.col("quota") * scale).cast("long").alias("quota"))
        catalog = self.store.table(f"catalog-{scale}", key, lambda: splits.catalog_fill(self.roles(), self.records(), sized, "dense-catalog"))

        def traffic() -> DataFrame:
            refs = catalog.groupBy("country").agg(F.count(F.lit(1)).alias("refs"))
            room = density.join(refs, "country").select("country", "src", F.bround(F.col("per_ref") * F.col("refs")).cast("long").alias("quota"))
            return splits.traffic_fill(catalog, self.records(), self.links(), room, "dense-traffic", ghosts_too=True)

        out = catalog, self.store.table(f"traffic-{scale}", key, traffic)
        self.store.report(f"environment-{scale}", {"countries": [x.asDict() for x in splits.environment_report(*out, self.links()).collect()]})
        return out

    def _world(self, part: str, scale: float) -> tuple[DataFrame, list[str]]:
        if part == "test":
            return self.records("test"), self._state(*self.test)
        return splits.environment(self.records(), *self.environment(scale)), [str(scale), *self._state(*self.train, self.truth, *(self.test or ()))]

    def edges(self, part: str = "train", scale: float = 1.0) -> DataFrame:
        world, key = self._world(part, scale)
        key = [*key, str(asdict(self.recipe))]
        name = f"{part}-{scale}"
        refs, targets, r = world.where("src = 1"), world.where("src > 1"), self.recipe
        stats = self.store.table(f"stats-{name}", key, lambda: retrieval.corpus_stats(refs))
        dfs = self.store.table(f"df-{name}", key, lambda: retrieval.df_map(retrieval.postings(refs)))
        plan = self.store.table(f"terms-{name}", key, lambda: retrieval.rare_terms(targets, dfs, max(r.max_terms, retrieval.JOINT_TERMS)))
        found = self.store.table(f"found-{name}", key, lambda: retrieval.search(plan, refs, stats, r.lane_k, r.max_terms, r.joint_k))
        pool = self.store.table(f"pool-{name}", key, lambda: retrieval.fuse(retrieval.lanes(found)))
        out = self.store.table(f"edges-{name}", key, lambda: retrieval.with_joint(pool, retrieval.joint(found), r.budget))
        self.store.report(f"retrieve-{name}", asdict(r))
        return out

    def feature_table(self, part: str = "train", scale: float = 1.0) -> DataFrame:
        """(src, tgt_id, ref_id, country, the 50 features) of the edges."""
        world, key = self._world(part, scale)
        name = f"{part}-{scale}"

        def make() -> DataFrame:
            e = self.edges(part, scale)
            dfs, stats = (self.store.table(f"{t}-{name}", [*key, str(asdict(self.recipe))], lambda: None) for t in ("df", "stats"))
            return feature_rows(e, world, dfs, stats)

        return self.store.table(f"features-{name}", [*key, str(asdict(self.recipe))], make)

    # Models and policies

    def _labelled(self, scale: float = 1.0) -> DataFrame:
        e = model.with_labels(model.with_roles(self.feature_table("train", scale), self.roles()), self.links())
        return e.withColumn("fits", model.teaches())

    def _required(self, role: str, scale: float = 1.0) -> DataFrame:
        catalog = self.environment(scale)[0]
        return catalog.join(self.roles().where(F.col("role") == role).select("rec_id"), "rec_id", "left_semi").select(F.col("rec_id").alias("ref_id"), "country")

    def _model_paths(self) -> list[str]:
        return [f"{self.root}/models/{n}" for n in ("fold-0", "fold-1", "second")]

    def _fold(self, df: DataFrame) -> DataFrame:
        # Folds go by a number; ids of text are hashed to one.
        return df.withColumn("ref_text", F.col("ref_id")).withColumn("ref_id", F.abs(F.xxhash64("ref_id")) % F.lit(1 << 31))

    def train_models(self, gain: float = 0.002) -> dict:
        """Both stages, a policy of each chosen on D; the second is released if it gains enough there. K is only reported."""
        e = written(self._labelled())
        numbered = self._fold(e)
        scored, folds, second = model.two_stages(numbered, self.features, self.config)
        scored = written(scored.withColumn("ref_id", F.col("ref_text")).drop("ref_text"))
        prints = [model.save_model(m, p) for m, p in zip([*folds, second], self._model_paths(), strict=True)]
        truth, out = self.links(), {}
        for stage, column in (("first", "s"), ("second", "score")):
            s = scored.drop("score").withColumn("score", F.col(column)) if column == "s" else scored
            s = s.select("src", "tgt_id", "ref_id", "country", "score")
            required = self._required("D")
            table = decide.policy_table(self._inside(s, required), truth, required)
            policy = decide.select_policy(table)
            out[stage] = {"policy": policy, **{role: self.evaluate(s, policy, role) for role in ("D", "K")}}
        stage = "second" if out["second"]["policy"]["macro"] >= out["first"]["policy"]["macro"] + gain else "first"
        bundle = {"stage": stage, "policy": out[stage]["policy"], "models": prints, "features": model.feature_version(self.features), "recipe": asdict(self.recipe), "calibrator": None}
        model.write_release(self.spark, f"{self.root}/release.json", bundle)
        return self.store.report("train", {**out, "release": bundle, "edges": e.count(), "teaching": e.where("fits").count(), "top_features": model.importances(second)})

    def _inside(self, edges: DataFrame, required: DataFrame) -> DataFrame:
        """All edges of the targets that a required reference competes for: owners are decided among all of them."""
        touched = edges.join(required.select("ref_id"), "ref_id", "left_semi").select("src", "tgt_id").distinct()
        return edges.join(touched, ["src", "tgt_id"], "left_semi")

    def release(self) -> dict:
        prints = [model.model_fingerprint(model.load_model(p)) for p in self._model_paths()]
        return model.read_release(self.spark, f"{self.root}/release.json", models=prints, features=model.feature_version(self.features), recipe=asdict(self.recipe))

    def scores(self, part: str = "train", scale: float = 1.0) -> DataFrame:
        """(src, tgt_id, ref_id, country, score) by the released models, calibrated if the release is."""
        bundle = self.release()
        *folds, second = (model.load_model(p) for p in self._model_paths())
        s = written(model.mean_score(folds, self.feature_table(part, scale)))
        s = model.predict(second, model.with_competition(s), "score") if bundle["stage"] == "second" else s.withColumn("score", F.col("s"))
        if bundle["calibrator"]:
            s = s.withColumn("score", platt(F.col("score"), *bundle["calibrator"]))
        return s.select("src", "tgt_id", "ref_id", "country", "score")

    def choose(self, role: str = "D", least_gain: float = 0.001) -> dict:
        """Threshold or owners on one cohort: owners if the bootstrap's lower bound of their gain is enough."""
        s, required, truth = written(self.scores()), self._required(role), self.links()
        own = decide.owner_sweep(s, truth, required).orderBy(F.desc(F.round("macro", 9)), "gamma").first()
        one = decide.best_threshold(decide.threshold_sweep(s, truth, required), base=decide.base_score(truth, required)).first()
        kinds = {"threshold": {"kind": "threshold", "tau": one.tau}, "owner": {"kind": "owner", "gamma": own.gamma, "tau": own.tau}}
        f = {k: decide.entity_scores(decide.counts(decide.apply_policy(s, p).select("ref_id", "tgt_id"), truth, required)).select("ref_id", F.col("f").alias(k)) for k, p in kinds.items()}
        bound = model.bootstrap_bound(f["owner"].join(f["threshold"], "ref_id").select("ref_id", (F.col("owner") - F.col("threshold")).alias("delta"))).first()
        return self.store.report(f"choose-{role}", {"policies": kinds, "lower": bound.lower, "chosen": "owner" if bound.lower is not None and bound.lower >= least_gain else "threshold"})

    def calibrate(self, role: str = "K", kind: str = "owner") -> dict:
        """Fits the calibration on the cohort's edges and freezes the policy on calibrated scores in the release."""
        bundle = self.release()
        model.write_release(self.spark, f"{self.root}/release.json", {**bundle, "calibrator": None})
        raw, required, truth = written(self.scores()), self._required(role), self.links()
        a, b = model.platt_fit(model.with_labels(raw.join(required.select("ref_id"), "ref_id", "left_semi"), truth).select("score", "label"))
        s = written(raw.withColumn("score", platt(F.col("score"), a, b)))
        if kind == "owner":
            r = decide.owner_sweep(s, truth, required).orderBy(F.desc(F.round("macro", 9)), "gamma").first()
            policy = {"kind": "owner", "gamma": r.gamma, "tau": r.tau, "macro": r.macro}
        else:
            r = decide.best_threshold(decide.threshold_sweep(s, truth, required), base=decide.base_score(truth, required)).first()
            policy = {"kind": "threshold", "tau": r.tau, "macro": r.macro}
        bundle = {**bundle, "policy": policy, "calibrator": [a, b]}
        model.write_release(self.spark, f"{self.root}/release.json", bundle)
        return self.store.report("calibrate", bundle)

    def evaluate(self, scored: DataFrame, policy: dict, role: str, scale: float = 1.0, least: int = 200) -> dict:
        required = self._required(role, scale)
        table = decide.evaluate(decide.apply_policy(scored, policy).select("ref_id", "tgt_id"), scored.select("ref_id", "tgt_id"), self.links(), required, least)
        return {r.slice: r.asDict() for r in table.collect()}

    def audit(self, role: str = "A2", scale: float = 1.0, least: int = 500) -> dict:
        """The frozen release on a cohort that taught and chose nothing; with another scale, how it bears other catalogs."""
        bundle = self.release()
        return self.store.report(f"audit-{role}-{scale}", {"policy": bundle["policy"], "slices": self.evaluate(self.scores("train", scale), bundle["policy"], role, scale, least)})

    def reselect(self, scale: float = 1.0, update: bool = False) -> dict:
        """The frozen policy on D and K of an environment, and the one that would be chosen there on D; with `update` it
        becomes the release's where it does better on D."""
        bundle, s, truth = self.release(), written(self.scores("train", scale)), self.links()
        required = self._required("D", scale)
        found = decide.select_policy(decide.policy_table(self._inside(s, required), truth, required))
        out = {"frozen": {r: self.evaluate(s, bundle["policy"], r, scale) for r in ("D", "K")}, "policy": found, "found": {r: self.evaluate(s, found, r, scale) for r in ("D", "K")}}
        out["updated"] = update and found["macro"] > out["frozen"]["D"]["all"]["macro"]
        if out["updated"]:
            model.write_release(self.spark, f"{self.root}/release.json", {**bundle, "policy": found})
        return self.store.report(f"reselect-{scale}", out)

    # Results

    def export(self, folder: str, taus: dict[str, float] | None = None) -> dict:
        """The two result files of test, by the release's policy; other thresholds for some countries."""
        bundle, s = self.release(), written(self.scores("test"))
        chosen = written(decide.apply_policy(s, bundle["policy"], taus))
        required = self.records("test").where("src = 1").select(F.col("rec_id").alias("ref_id"))
        marked = s.join(chosen.select("src", "tgt_id", "ref_id", F.lit(True).alias("selected")), ["src", "tgt_id", "ref_id"], "left").na.fill(False, ["selected"])
        some = R.write_scored_outputs(required, marked, folder)
        return self.store.report("export", {"edges": s.count(), "selected": chosen.count(), "references_with_matches": some, "multi_owner": decide.multi_owner(chosen).count(), "countries": [r.asDict() for r in decide.volumes(s, chosen).collect()]})

    def validate(self, folder: str) -> dict:
        """The strict audit, the organisers' rules and the support of the exported files."""
        m, c = f"{folder}/matching_results.tsv", f"{folder}/candidate_pairs.tsv"
        r = self.records("test")
        required, known = r.where("src = 1").select(F.col("rec_id").alias("ref_id")), r.where("src > 1").select(F.col("rec_id").alias("tgt_id"))
        checks = {"strict": audit.file_violations(self.spark, m, c, required, known), "official": audit.official_findings(self.spark, m, c, required, known), "support": audit.scored_support(self.spark, c, self.edges("test"), required)}
        found = {k: [x.asDict() for x in v.limit(20).collect()] for k, v in checks.items()}
        return self.store.report("validate", {**found, "pass": all(audit.passed(v) for v in checks.values())})
