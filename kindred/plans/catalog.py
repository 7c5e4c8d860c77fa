"""Named queries over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import re
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions.pairs import enrich, pair_features, shared_term_weight, with_sets
from ..operators import audit, decide, model, neighbours, retrieval, splits
from ..sources.records import id_lists, record_views, scored_lists
from ..sources.store import Store, fingerprint, session_root

#: Slices of the references of stages that bring both sides' texts together, up to so many edges that go in one, and edges
#: of a slice whose ids are sent to where the texts are.
SLICES, FEW, SENT = 12, 20_000, 1_000_000


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents: the first line is the name, all that follows it the address. l1 and l2 are the first two lines, whole."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    line = lambda k: F.split_part("text", F.lit("\n"), F.lit(k))
    rest = F.expr("substring(text, length(split_part(text, '\n', 1)) + 2)")
    return d.select((F.col("doc_id") % 3 + 1).cast("int").alias("src"), F.col("doc_id").alias("rec_id"), F.col("lang").alias("country"), line(1).alias("l1"), line(2).alias("l2"), line(1).alias("name_raw"), rest.alias("addr_raw"), F.concat(F.lit("S"), F.col("doc_id") % 3 + 1, F.lit("-"), F.col("doc_id")).alias("entity_id"))


class World:
    """Relations of a test folder. What several queries read (records, postings, query terms, pool, edges, scores) is made
    once a session for each state of the documents and kept in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.store = Store(spark, session_root(spark))
        self.spark, self.raw = spark, raw_records(spark, sf_dir)
        self.key = self.store.files.state(f"{sf_dir}/documents.parquet")
        self.name = fingerprint(sf_dir)[:12]

    def _kept(self, name: str, make) -> DataFrame:
        return self.store.table(f"{self.name}/{name}", self.key, make)

    def _sliced(self, name: str, make) -> DataFrame:
        """make(edges, targets, references) for one slice of the references after the other. Only records that the slice's edges
        name come, picked by their ids before anything is made of their texts, so what texts take on their way is a slice's share."""
        edges = self.edges.count()
        slices = 1 if edges <= FEW else max(SLICES, -(-edges // SENT))

        def part(k: int) -> DataFrame:
            e = self.edges.where(F.pmod(F.xxhash64("ref_id"), F.lit(slices)) == k)

            def fresh() -> DataFrame:
                sent = F.broadcast if e.count() <= 2 * SENT else lambda ids: ids
                named = lambda key, side: self.views.where(side).join(sent(e.select(F.col(key).alias("rec_id")).distinct()), "rec_id", "left_semi")
                return make(e, named("tgt_id", "src > 1"), named("ref_id", "src = 1"))

            return self._kept(f"{name}-{k}", fresh)

        return reduce(DataFrame.unionByName, [part(k) for k in range(slices)])

    @cached_property
    def views(self) -> DataFrame:
        """Only the normalised views are kept; the others are made from them where they are read."""
        keep = ["src", "rec_id", "country", "name_norm", "addr_norm", "name_indic", "addr_indic", "addr_missing"]
        v = self._kept("views", lambda: record_views(self.raw.drop("l1", "l2")).select(*keep))
        return v.withColumns({f"{f}_{kind}": of(F.col(f"{f}_norm")) for f in ("name", "addr") for kind, of in (("latin", X.latin_view), ("fold", X.latin_fold))})

    @cached_property
    def records(self) -> DataFrame:
        """Records with the terms that retrieval asks for."""
        return self._kept("records", lambda: retrieval.with_terms(self.views).select("src", "rec_id", "country", "name_terms", "addr_terms"))

    @property
    def sides(self) -> DataFrame:
        """Records with the sets that pairs compare."""
        return with_sets(self.views)

    @property
    def refs(self) -> DataFrame:
        return self.records.where("src = 1")

    @property
    def truth(self) -> DataFrame:
        owner = self.raw.where("src = 1").groupBy("country", "l1", "l2").agg(F.min("rec_id").alias("ref_id"))
        return self.raw.where("src > 1").join(owner, ["country", "l1", "l2"]).select("ref_id", F.col("rec_id").alias("tgt_id"), "src", "country")

    @property
    def links(self) -> DataFrame:
        return self.truth.select("ref_id", "tgt_id")

    @property
    def near_links(self) -> DataFrame:
        """Targets and all references that share their first line with them, or their second, so that some share a target."""
        refs, targets = self.raw.where("src = 1"), self.raw.where("src > 1")
        by = lambda c: refs.where(F.col(c) != "").select(F.col("rec_id").alias("ref_id"), "country", c).join(targets.select(F.col("rec_id").alias("tgt_id"), "country", c), ["country", c]).select("ref_id", "tgt_id")
        return by("l1").union(by("l2")).distinct()

    @property
    def required(self) -> DataFrame:
        return self.raw.where("src = 1").select(F.col("rec_id").alias("ref_id"), "country")

    @property
    def posts(self) -> DataFrame:
        return retrieval.postings(self.refs)

    @cached_property
    def dfs(self) -> DataFrame:
        return self._kept("df", lambda: retrieval.df_map(self.posts))

    @cached_property
    def stats(self) -> DataFrame:
        return self._kept("stats", lambda: retrieval.corpus_stats(self.refs))

    @cached_property
    def terms(self) -> DataFrame:
        return self._kept("terms", lambda: retrieval.rare_terms(self.records.where("src > 1"), self.dfs))

    def plan(self, most: int = retrieval.MAX_TERMS) -> DataFrame:
        return self.terms.where(F.col("k") <= most)

    @cached_property
    def found(self) -> DataFrame:
        return self._kept("found", lambda: retrieval.search(self.plan(), self.refs, self.stats))

    @property
    def lanes(self) -> DataFrame:
        return retrieval.lanes(self.found)

    @cached_property
    def pool(self) -> DataFrame:
        return self._kept("pool", lambda: retrieval.fuse(self.lanes))

    @property
    def joint(self) -> DataFrame:
        return retrieval.joint(self.found)

    @cached_property
    def edges(self) -> DataFrame:
        return self._kept("edges", lambda: retrieval.with_joint(self.pool, self.joint))

    @cached_property
    def scored(self) -> DataFrame:
        """Edges with a fixed linear score of retrieval and token evidence, and the country."""
        sets = lambda v, p, *keys: v.select(*keys, *[X.token_set(F.col(f"{f}_norm")).alias(f"{p}_{f}") for f in ("name", "addr")])
        j = lambda f: S.jaccard(F.col(f"r_{f}"), F.col(f"t_{f}"))

        def make(edges: DataFrame, targets: DataFrame, refs: DataFrame) -> DataFrame:
            e = edges.join(sets(targets, "t", "src", F.col("rec_id").alias("tgt_id"), "country"), ["src", "tgt_id"]).join(sets(refs, "r", F.col("rec_id").alias("ref_id")), "ref_id")
            return e.select("src", "tgt_id", "ref_id", "country", F.round(0.5 * F.col("v") + 0.3 * j("name") + 0.2 * j("addr"), 6).alias("score"))

        return self._sliced("scored", make)

    def token_features(self, names) -> DataFrame:
        """Features of the edges that need nothing but both sides."""
        return self._sliced("features-tokens", lambda e, t, r: enrich(e, with_sets(t.unionByName(r))).select("src", "tgt_id", "ref_id", *[pair_features(False)[k].alias(k) for k in names]))

    @property
    def chosen(self) -> DataFrame:
        return decide.apply_policy(self.scored, {"kind": "owner", "gamma": 0.02, "tau": 0.7})

    @cached_property
    def features(self) -> DataFrame:
        def make(edges: DataFrame, targets: DataFrame, refs: DataFrame) -> DataFrame:
            e = enrich(edges, with_sets(targets.unionByName(refs)))
            weight = shared_term_weight(e, self.dfs, self.stats.where("field = 'name'").select("country", "n_docs"))
            full = e.join(weight, ["src", "tgt_id", "ref_id"], "left")
            return full.select("src", "tgt_id", "ref_id", "country", *[c.alias(n) for n, c in pair_features().items()])

        return self._sliced("features", make)

    @cached_property
    def roles(self) -> DataFrame:
        return self._kept("roles", lambda: splits.assign_roles(self.raw, self.links))

    @property
    def quotas(self) -> DataFrame:
        return self.raw.where("src = 1").groupBy("country").agg(F.floor(F.count(F.lit(1)) / 2).alias("quota"))

    @property
    def catalog(self) -> DataFrame:
        return splits.catalog_fill(self.roles, self.raw, self.quotas)

    @property
    def per_ref(self) -> DataFrame:
        """(country, src, per_ref): targets of each source for each reference."""
        n = self.raw.groupBy("country").agg(*[F.count_if(F.col("src") == s).alias(f"n{s}") for s in (1, 2, 3)]).where("n1 > 0")
        return n.select("country", F.explode(F.array(*[F.struct(F.lit(s).alias("src"), (F.col(f"n{s}") / F.col("n1")).alias("per_ref")) for s in (2, 3)])).alias("x")).select("country", "x.*")

    @cached_property
    def dense(self) -> tuple[DataFrame, DataFrame]:
        return splits.dense_environment(self.roles, self.raw, self.links, self.quotas, self.per_ref, scale=1.2)

    @property
    def cohort(self) -> tuple[DataFrame, DataFrame]:
        both = self.per_ref.groupBy("country").agg(F.sum("per_ref").alias("per_ref"))
        return splits.cohort_environment(self.roles, self.raw, self.links, "D", self.quotas, both)


def _out(df: DataFrame, *cols, **rounded: int) -> DataFrame:
    """Whole numbers as long, fractions rounded to six places: the types that both engines share."""
    kinds = dict(df.select(*cols).dtypes) if cols else dict(df.dtypes)
    cols = cols or tuple(df.columns)
    fix = lambda c: F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint", "tinyint", "smallint") else F.round(c, 6).alias(c) if kinds[c] in ("double", "float") else F.col(c)
    return df.select(*[fix(c) for c in cols])


_T = lambda f: (f"list_filter(string_split({f}, ' '), lambda t: length(t) >= 2)")
_G = lambda f: (f"flatten(list_transform(list_filter(string_split({f}, ' '), lambda t: length(t) >= 4), lambda t: list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))))")
_N = lambda f: (rf"trim(regexp_replace(replace(lower(nfc_normalize({f})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}\p{{M}}]+', ' ', 'g'))")
_M = lambda f: f"list_sort(list_distinct(list_concat(list_concat({_G(f + '_norm')}, {_T(f + '_norm')}), {_G(f + '_fold')})))"
_J = lambda a, b: f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0.0)"
_F = "CASE WHEN n_true = 0 AND n_said = 0 THEN 1.0::DOUBLE WHEN n_true = 0 OR n_said = 0 THEN 0.0::DOUBLE ELSE 5.0::DOUBLE * tp / (n_true + 4.0::DOUBLE * n_said) END"


def _plan(n: int) -> str:
    return f"SELECT * FROM (SELECT q.*, d.df, row_number() OVER (PARTITION BY src, tgt_id, q.field ORDER BY d.df, q.term) AS k FROM qterms q JOIN dfm d USING (country, field, term)) WHERE k <= {n}"


def _scores(plan: str) -> str:
    return f"SELECT p.src, p.tgt_id, p.field, o.ref_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * 2.2::DOUBLE / (1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM {plan} p JOIN stats USING (country, field) JOIN posts o USING (country, field, term) GROUP BY ALL"


def _sha(seed: str, c: str = "rec_id") -> str:
    return f"sha256('{seed}:' || CAST({c} AS VARCHAR))"


CTES = {
    "rec": "SELECT CAST(doc_id % 3 + 1 AS BIGINT) AS src, doc_id AS rec_id, lang AS country, split_part(text, chr(10), 1) AS l1, split_part(text, chr(10), 2) AS l2, split_part(text, chr(10), 1) AS name_raw, substr(text, length(split_part(text, chr(10), 1)) + 2) AS addr_raw FROM documents",
    "nrm": f"SELECT *, {_N('name_raw')} AS name_norm, {_N('addr_raw')} AS addr_norm FROM rec",
    "vw": "SELECT *, strip_accents(name_norm) AS name_fold, strip_accents(addr_norm) AS addr_fold FROM nrm",
    "trm": f"SELECT *, {_M('name')} AS name_terms, {_M('addr')} AS addr_terms FROM vw",
    "truth": "SELECT o.ref_id, r.rec_id AS tgt_id, r.src, r.country FROM rec r JOIN (SELECT country, l1, l2, min(rec_id) AS ref_id FROM rec WHERE src = 1 GROUP BY ALL) o USING (country, l1, l2) WHERE r.src > 1",
    "fld": "SELECT src, rec_id, country, 'name' AS field, name_terms AS terms FROM trm UNION ALL SELECT src, rec_id, country, 'addr', addr_terms FROM trm",
    "posts": "SELECT country, field, rec_id AS ref_id, len(terms) AS dl, unnest(terms) AS term FROM fld WHERE src = 1",
    "dfm": "SELECT country, field, term, count(*) AS df FROM posts GROUP BY ALL",
    "stats": "SELECT country, field, count(*) AS n_docs, avg(len(terms)) AS avgdl FROM fld WHERE src = 1 GROUP BY ALL",
    "qterms": "SELECT src, rec_id AS tgt_id, country, field, unnest(terms) AS term FROM fld WHERE src > 1",
    "plan16": _plan(16),
    "plan8": _plan(8),
    "hits": _scores("plan16"),
    "lane": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt_id, field ORDER BY score DESC, ref_id) AS rank FROM hits) WHERE rank <= 8",
    "wide": "SELECT src, tgt_id, ref_id, max(rank) FILTER (WHERE field = 'name') AS name_rank, max(score) FILTER (WHERE field = 'name') AS name_score, max(rank) FILTER (WHERE field = 'addr') AS addr_rank, max(score) FILTER (WHERE field = 'addr') AS addr_score FROM lane GROUP BY ALL",
    "fus": "SELECT *, round((coalesce(1.0::DOUBLE / (60 + name_rank), 0) + coalesce(1.0::DOUBLE / (60 + addr_rank), 0)) / ((max((name_rank IS NOT NULL)::INT) OVER q + max((addr_rank IS NOT NULL)::INT) OVER q) / 61.0::DOUBLE), 9) AS v FROM wide WINDOW q AS (PARTITION BY src, tgt_id)",
    "rnk": "SELECT *, row_number() OVER (PARTITION BY src, tgt_id ORDER BY v DESC, addr_rank NULLS LAST, name_rank NULLS LAST, ref_id) AS fused_rank, count(*) OVER (PARTITION BY src, tgt_id) AS pool_size, rank() OVER (PARTITION BY src, tgt_id ORDER BY v DESC) AS place FROM fus",
    "pool": "SELECT *, max(CASE WHEN fused_rank = 1 THEN v END) OVER q - max(CASE WHEN fused_rank = 2 THEN v END) OVER q AS margin FROM rnk WINDOW q AS (PARTITION BY src, tgt_id)",
    "jhits": _scores("plan8"),
    "joint": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt_id ORDER BY joint_score DESC, ref_id) AS joint_rank FROM (SELECT src, tgt_id, ref_id, round(sum(score), 6) AS joint_score FROM jhits GROUP BY ALL HAVING count(*) = 2)) WHERE joint_rank <= 2",
    "edges": "SELECT k.src, k.tgt_id, k.ref_id, coalesce(p.v, 0.0::DOUBLE) AS v, coalesce(name_rank, 0) AS name_rank, coalesce(addr_rank, 0) AS addr_rank, coalesce(joint_rank, 0) AS joint_rank, coalesce(s.pool_size, 0) AS pool_size, coalesce(name_score, 0) AS name_score, coalesce(addr_score, 0) AS addr_score, coalesce(joint_score, 0) AS joint_score, coalesce(margin, 0) AS margin FROM (SELECT src, tgt_id, ref_id FROM pool WHERE place <= 2 UNION SELECT src, tgt_id, ref_id FROM joint) k LEFT JOIN pool p USING (src, tgt_id, ref_id) LEFT JOIN joint USING (src, tgt_id, ref_id) LEFT JOIN (SELECT DISTINCT src, tgt_id, pool_size FROM pool) s ON s.src = k.src AND s.tgt_id = k.tgt_id",
    "enr": "SELECT e.*, t.country, t.name_norm AS tn, t.addr_norm AS ta, r.name_norm AS rn, r.addr_norm AS ra FROM edges e JOIN trm t ON t.rec_id = e.tgt_id JOIN trm r ON r.rec_id = e.ref_id",
    "scored": f"SELECT src, tgt_id, ref_id, country, round(0.5::DOUBLE * v + 0.3::DOUBLE * {_J(f'list_distinct({_T("rn")})', f'list_distinct({_T("tn")})')} + 0.2::DOUBLE * {_J(f'list_distinct({_T("ra")})', f'list_distinct({_T("ta")})')}, 6) AS score FROM enr",
    "own": "SELECT * FROM (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS rival FROM scored WINDOW w AS (PARTITION BY src, tgt_id ORDER BY score DESC, ref_id)) WHERE k = 1 AND (rival IS NULL OR (score > rival AND score - rival >= 0.02::DOUBLE))",
    "chosen": "SELECT * FROM own WHERE score >= 0.7",
    "req": "SELECT rec_id AS ref_id, country FROM rec WHERE src = 1",
    "cnt": "SELECT q.ref_id, q.country, coalesce(n_true, 0) AS n_true, coalesce(n_said, 0) AS n_said, coalesce(tp, 0) AS tp, coalesce(reach, 0) AS reach FROM req q LEFT JOIN (SELECT ref_id, count(*) AS n_true FROM truth GROUP BY 1) USING (ref_id) LEFT JOIN (SELECT c.ref_id, count(*) AS n_said, count(t.tgt_id) AS tp FROM chosen c LEFT JOIN truth t USING (ref_id, tgt_id) GROUP BY 1) USING (ref_id) LEFT JOIN (SELECT c.ref_id, count(*) AS reach FROM scored c JOIN truth t USING (ref_id, tgt_id) GROUP BY 1) USING (ref_id)",
    "ent": f"SELECT *, {_F} AS f, CASE WHEN n_true = 0 THEN 1.0::DOUBLE WHEN reach = 0 THEN 0.0::DOUBLE ELSE 5.0::DOUBLE * reach / (n_true + 4.0::DOUBLE * reach) END AS best FROM cnt",
    "lone": "SELECT rec_id, min(rec_id) OVER (PARTITION BY src, country, name_raw, addr_raw) AS head FROM rec WHERE src > 1 AND rec_id NOT IN (SELECT tgt_id FROM truth)",
    "heads": "SELECT r.rec_id, r.src, r.country, CASE WHEN r.src = 1 THEN least(coalesce(n, 0), 4) ELSE 10 + r.src END AS stratum FROM rec r LEFT JOIN (SELECT ref_id, count(*) AS n FROM truth GROUP BY 1) c ON c.ref_id = r.rec_id WHERE r.rec_id NOT IN (SELECT tgt_id FROM truth) AND (r.src = 1 OR r.rec_id IN (SELECT head FROM lone))",
    "strata": "SELECT *, (row_number() OVER (ORDER BY country, stratum) - 1) % 4 AS turn, CAST(floor(size * 0.05::DOUBLE) AS BIGINT) AS each, CAST(floor(size * 0.05::DOUBLE * 4 + 0.5::DOUBLE) AS BIGINT) - 4 * CAST(floor(size * 0.05::DOUBLE) AS BIGINT) AS extra FROM (SELECT country, stratum, count(*) AS size FROM heads GROUP BY ALL)",
    "hroles": f"SELECT rec_id, src, country, CASE WHEN k <= q0 THEN 'F' WHEN k <= q0 + q1 THEN 'D' WHEN k <= q0 + q1 + q2 THEN 'K' WHEN k <= q0 + q1 + q2 + q3 THEN 'A' ELSE 'B' END AS role FROM (SELECT h.*, row_number() OVER (PARTITION BY country, stratum ORDER BY {_sha('split')}, rec_id) AS k, {', '.join(f'each + ((({j} - turn + 4) % 4) < extra)::INT AS q{j}' for j in range(4))} FROM heads h JOIN strata USING (country, stratum))",
    "roles": "SELECT rec_id, src, role FROM hroles WHERE src = 1 UNION ALL SELECT t.tgt_id, t.src, h.role FROM truth t JOIN hroles h ON h.rec_id = t.ref_id UNION ALL SELECT l.rec_id, r.src, h.role FROM lone l JOIN rec r USING (rec_id) JOIN hroles h ON h.rec_id = l.head",
    "cat": f"SELECT rec_id, country, kept FROM (SELECT rec_id, country, role, CASE WHEN role = 'B' THEN 'fill' ELSE 'held' END AS kept, row_number() OVER (PARTITION BY country, role = 'B' ORDER BY {_sha('fill')}, rec_id) AS k, count(*) FILTER (WHERE role <> 'B') OVER (PARTITION BY country) AS held, count(*) OVER (PARTITION BY country) AS n FROM roles JOIN rec USING (rec_id) WHERE rec.src = 1) WHERE kept = 'held' OR k <= greatest(n // 2 - held, 0)",
}



# Signs beyond ASCII become capitals, which normalised texts lack: DuckDB's similarities count bytes.
_A = lambda f: f"translate({f}, 'äçèéêíñóöüàâîïôûëáú', 'ABCDEFGHIJKLMNOPQRS')"
_WORDS = "[" + ", ".join(f"'{w}'" for w in X.GENERIC_WORDS) + "]"


def _spelled(t: str) -> str:
    for x, y in X.DIGRAPHS:
        t = f"replace({t}, '{x}', '{y}')"
    return f"translate({t}, '{X.MERGED}', '{X.INTO}')"


_NUMS = r"list_transform(regexp_extract_all(addr_norm, '\d+'), lambda n: CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END)"
CTES |= {
    "wrd": f"SELECT DISTINCT unnest(string_split(name_norm || ' ' || addr_norm, ' ')) AS t FROM vw UNION SELECT unnest({_WORDS})",
    "wr1": f"SELECT t, {_spelled('t')} AS r FROM wrd",
    "wr2": "SELECT t, substr(r, 1, 1) || regexp_replace(substr(r, 2), '[aeiouyh]', '', 'g') AS s FROM wr1",
    "wr3": "SELECT t, array_to_string(list_filter(string_split(s, ''), lambda c, i: i = 1 OR c <> substr(s, i - 1, 1)), '') AS k FROM wr2",
    "tok": "SELECT rec_id, 'name' AS f, unnest(string_split(name_norm, ' ')) AS t, generate_subscripts(string_split(name_norm, ' '), 1) AS i FROM vw UNION ALL SELECT rec_id, 'addr', unnest(string_split(addr_norm, ' ')), generate_subscripts(string_split(addr_norm, ' '), 1) FROM vw",
    "skl": "SELECT rec_id, coalesce(list(DISTINCT k ORDER BY k) FILTER (k <> '' AND f = 'name'), []) AS name_skel, coalesce(list(DISTINCT k ORDER BY k) FILTER (k <> '' AND f = 'addr'), []) AS addr_skel FROM tok JOIN wr3 USING (t) GROUP BY rec_id",
    "dul": f"SELECT list(k) AS dull FROM wr3 WHERE t IN (SELECT unnest({_WORDS}))",
    "ft": f"SELECT v.*, name_skel, addr_skel, list_sort(list_distinct({_T('name_norm')})) AS name_set, list_sort(list_distinct({_T('addr_norm')})) AS addr_set, list_filter(list_distinct({_T('name_norm')}), lambda t: NOT list_contains({_WORDS}, t)) AS name_core, list_distinct(list_filter({_T('addr_norm')}, lambda t: regexp_matches(t, '\\d'))) AS addr_num_set, {_NUMS} AS addr_nums, list_filter(name_skel, lambda k: NOT list_contains(dull, k)) AS name_skel_core, regexp_matches(name_raw, '[\u0900-\u0dff]') AS name_indic FROM vw v JOIN skl USING (rec_id) CROSS JOIN dul",
    "nlinks": "SELECT DISTINCT o.rec_id AS ref_id, r.rec_id AS tgt_id FROM rec r JOIN rec o ON o.src = 1 AND r.src > 1 AND o.country = r.country AND ((o.l1 = r.l1 AND r.l1 <> '') OR (o.l2 = r.l2 AND r.l2 <> ''))",
    "walk": "SELECT ref_id AS a, tgt_id AS b FROM nlinks UNION SELECT tgt_id, ref_id FROM nlinks",
    "duo": "SELECT gamma, s.*, row_number() OVER w AS k, lead(score) OVER w AS rival FROM scored s CROSS JOIN (SELECT unnest([0.0, 0.02, 0.05, 0.1, 0.2])::DOUBLE AS gamma) WINDOW w AS (PARTITION BY gamma, src, tgt_id ORDER BY score DESC, ref_id)",
    "owng": "SELECT * FROM duo WHERE k = 1 AND (rival IS NULL OR (score > rival AND score - rival >= gamma))",
    "nt": "SELECT q.ref_id, count(t.tgt_id) AS n_true FROM req q LEFT JOIN truth t USING (ref_id) GROUP BY 1",
    "none": "SELECT count(*) AS refs, count(*) FILTER (WHERE n_true = 0) AS empty FROM nt",
    "fam": "SELECT 'owner' AS kind, gamma, src, tgt_id, ref_id, score FROM owng UNION ALL SELECT 'threshold', NULL, src, tgt_id, ref_id, score FROM scored",
    "swp": f"SELECT kind, gamma, tau, (any_value(empty) + sum({_F} - (n_true = 0)::INT::DOUBLE)) / any_value(refs) AS macro FROM (SELECT f.kind, f.gamma, t.tau, f.ref_id, count(*) AS n_said, count(u.tgt_id) AS tp FROM fam f JOIN (SELECT DISTINCT kind, gamma, score AS tau FROM fam) t ON t.kind = f.kind AND t.gamma IS NOT DISTINCT FROM f.gamma AND f.score >= t.tau LEFT JOIN truth u ON u.ref_id = f.ref_id AND u.tgt_id = f.tgt_id GROUP BY ALL) JOIN nt USING (ref_id) CROSS JOIN none GROUP BY kind, gamma, tau",
    "bst": "SELECT kind, gamma, CASE WHEN m >= z THEN m ELSE z END AS macro, CASE WHEN m >= z THEN tau ELSE 'inf'::DOUBLE END AS tau FROM (SELECT kind, gamma, max(round(macro, 9)) AS m, arg_min(tau, (-round(macro, 9), tau)) AS tau FROM swp GROUP BY ALL) CROSS JOIN (SELECT round(empty / refs, 9) AS z FROM none)",
    "efq": "SELECT gamma, beta, floor_, src, tgt_id, ref_id, q, row_number() OVER o AS k, sum(q) OVER (o ROWS UNBOUNDED PRECEDING) AS part, sum(q) OVER w AS all_q, sum(ln(greatest(1 - q, 1e-12::DOUBLE))) OVER w AS lnone FROM (SELECT o.*, beta, floor_, greatest(least(score, 1.0::DOUBLE), 0.0::DOUBLE) AS q FROM owng o CROSS JOIN (SELECT unnest([0.0, 0.1, 0.3])::DOUBLE AS beta) CROSS JOIN (SELECT unnest([0.0, 0.1])::DOUBLE AS floor_) WHERE gamma IN (0.0, 0.1)) WINDOW w AS (PARTITION BY gamma, beta, floor_, ref_id), o AS (PARTITION BY gamma, beta, floor_, ref_id ORDER BY q DESC, src, tgt_id)",
    "efv": "SELECT *, CASE WHEN q > floor_ THEN round(5 * part / (all_q + beta + 4 * k), 9) END AS value FROM efq",
    "efb": "SELECT *, max(value) OVER w AS best, round(exp(lnone), 9) AS none_ FROM efv WINDOW w AS (PARTITION BY gamma, beta, floor_, ref_id)",
    "efs": "SELECT * FROM (SELECT *, min(CASE WHEN value = best THEN k END) OVER (PARTITION BY gamma, beta, floor_, ref_id) AS last_ FROM efb) WHERE k <= last_ AND none_ < best",
    "efm": f"SELECT g.gamma, g.beta, g.floor_, (any_value(empty) + coalesce(sum({_F} - (n_true = 0)::INT::DOUBLE) FILTER (WHERE n_said IS NOT NULL), 0)) / any_value(refs) AS macro FROM (SELECT * FROM (SELECT unnest([0.0, 0.1])::DOUBLE AS gamma) CROSS JOIN (SELECT unnest([0.0, 0.1, 0.3])::DOUBLE AS beta) CROSS JOIN (SELECT unnest([0.0, 0.1])::DOUBLE AS floor_)) g CROSS JOIN none LEFT JOIN (SELECT e.gamma, e.beta, e.floor_, e.ref_id, count(*) AS n_said, count(t.tgt_id) AS tp FROM efs e LEFT JOIN truth t USING (ref_id, tgt_id) GROUP BY ALL) x ON x.gamma = g.gamma AND x.beta = g.beta AND x.floor_ = g.floor_ LEFT JOIN nt USING (ref_id) GROUP BY ALL",
    "ccnt": "SELECT q.ref_id, q.country, coalesce(n_true, 0) AS n_true, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp FROM req q LEFT JOIN (SELECT ref_id, count(*) AS n_true FROM truth GROUP BY 1) USING (ref_id) LEFT JOIN (SELECT e.ref_id, count(*) AS n, count(t.tgt_id) AS tp FROM edges e LEFT JOIN truth t USING (ref_id, tgt_id) GROUP BY 1) USING (ref_id)",
    "per": "SELECT country, src, n / n1 AS per_ref FROM (SELECT country, src, count(*) AS n, (SELECT count(*) FROM rec z WHERE z.src = 1 AND z.country = r.country) AS n1 FROM rec r WHERE src > 1 GROUP BY ALL) WHERE n1 > 0",
    "dcat": f"SELECT rec_id, country, kept FROM (SELECT r.rec_id, rec.country, CASE WHEN role = 'B' THEN 'fill' ELSE 'held' END AS kept, row_number() OVER (PARTITION BY rec.country, role = 'B' ORDER BY {_sha('dense-catalog', 'r.rec_id')}, r.rec_id) AS k, count(*) FILTER (WHERE role <> 'B') OVER (PARTITION BY rec.country) AS held, count(*) OVER (PARTITION BY rec.country) AS n FROM roles r JOIN rec USING (rec_id) WHERE rec.src = 1) WHERE kept = 'held' OR k <= greatest(round_even((n // 2) * 1.2::DOUBLE, 0) - held, 0)",
    "dtra": f"SELECT rec_id, src, country, kept FROM (SELECT r.rec_id, r.src, r.country, CASE WHEN c.rec_id IS NULL THEN 'fill' ELSE 'owned' END AS kept, row_number() OVER (PARTITION BY r.country, r.src, c.rec_id IS NULL ORDER BY {_sha('dense-traffic', 'r.rec_id')}, r.rec_id) AS k, count(c.rec_id) OVER (PARTITION BY r.country, r.src) AS have, CAST(round_even(p.per_ref * (SELECT count(*) FROM dcat z WHERE z.country = r.country), 0) AS BIGINT) AS quota FROM rec r LEFT JOIN truth t ON t.tgt_id = r.rec_id LEFT JOIN dcat c ON c.rec_id = t.ref_id LEFT JOIN per p ON p.country = r.country AND p.src = r.src WHERE r.src > 1) WHERE kept = 'owned' OR k <= greatest(quota - have, 0)",
    "ncat": f"SELECT rec_id, country, kept FROM (SELECT r.rec_id, rec.country, CASE WHEN role = 'D' THEN 'held' ELSE 'fill' END AS kept, row_number() OVER (PARTITION BY rec.country, role = 'D' ORDER BY {_sha('cohort-catalog', 'r.rec_id')}, r.rec_id) AS k, count(*) FILTER (WHERE role = 'D') OVER (PARTITION BY rec.country) AS held, (SELECT count(*) FROM rec z WHERE z.src = 1 AND z.country = rec.country) AS n FROM roles r JOIN rec USING (rec_id) WHERE rec.src = 1 AND role IN ('D', 'F', 'B')) WHERE kept = 'held' OR k <= greatest(n // 2 - held, 0)",
    "must": "SELECT r.rec_id, r.src, rec.country FROM roles r JOIN rec USING (rec_id) WHERE r.src > 1 AND r.role = 'D'",
    "need": "SELECT f.country, greatest(CAST(round_even((SELECT sum(per_ref) FROM per WHERE per.country = f.country) * f.refs, 0) AS BIGINT) - (SELECT count(*) FROM must WHERE must.country = f.country), 0) AS need FROM (SELECT rec.country, count(*) AS refs FROM roles JOIN rec USING (rec_id) WHERE rec.src = 1 AND role = 'D' GROUP BY 1) f",
    "bpool": "SELECT r.rec_id, r.src, rec.country FROM roles r JOIN rec USING (rec_id) WHERE r.src > 1 AND r.role = 'B'",
    "deal": "SELECT country, src, part + (row_number() OVER (PARTITION BY country ORDER BY src) <= need - sum(part) OVER (PARTITION BY country))::INT AS room FROM (SELECT country, src, need, need * n // sum(n) OVER (PARTITION BY country) AS part FROM (SELECT country, src, count(*) AS n FROM bpool GROUP BY ALL) JOIN need USING (country))",
    "ctra": f"SELECT rec_id, src, country, 'must' AS kept FROM must UNION ALL SELECT rec_id, src, country, 'fill' FROM (SELECT b.*, row_number() OVER (PARTITION BY country, src ORDER BY {_sha('cohort-traffic')}, rec_id) AS k FROM bpool b) JOIN deal USING (country, src) WHERE k <= room",
}


def sql(final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items()) + "\n" + final


Q: dict = {}
O: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        Q[name] = lambda spark, sf_dir: f(World(spark, sf_dir))
        if oracle:
            O[name] = sql(oracle)
        return f

    return keep


def _text(c: str):
    return F.array_join(c, "|")


_E = "FROM scored"
_ACC = "count(*) FILTER (WHERE regexp_matches(name_raw, '[^\\x00-\\x7F]'))"
# Text views
query("record_views", "SELECT src, rec_id, name_norm, addr_norm, name_fold, addr_fold, trim(addr_raw) = '' AS addr_missing, regexp_matches(name_raw, '[\u0900-\u0dff]') AS name_indic, regexp_matches(addr_raw, '[\u0900-\u0dff]') AS addr_indic FROM vw")(lambda w: _out(w.views, "src", "rec_id", "name_norm", "addr_norm", "name_fold", "addr_fold", "addr_missing", "name_indic", "addr_indic"))
query("tokens_trigrams", f"SELECT rec_id, array_to_string({_T('name_norm')}, '|') AS toks, array_to_string({_G('name_norm')}, '|') AS tris FROM vw")(lambda w: w.views.select("rec_id", _text(X.tokens(F.col("name_norm"))).alias("toks"), _text(X.trigrams(F.col("name_norm"))).alias("tris")))
query("merged_terms", "SELECT rec_id, array_to_string(name_terms, '|') AS name_terms, array_to_string(addr_terms, '|') AS addr_terms FROM trm")(lambda w: w.records.select("rec_id", _text("name_terms").alias("name_terms"), _text("addr_terms").alias("addr_terms")))
query("term_streams", "SELECT rec_id, " + ", ".join(f"array_to_string({of(f + '_' + view)}, '|') AS {f}_{kind}" for f in ("name", "addr") for kind, of, view in (("tri", _G, "norm"), ("word", _T, "norm"), ("foldtri", _G, "fold"))) + " FROM vw WHERE src = 1")(lambda w: retrieval.term_streams(w.views.where("src = 1")).select("rec_id", *[_text(f"{f}_{k}").alias(f"{f}_{k}") for f in ("name", "addr") for k in ("tri", "word", "foldtri")]))
query("numeric_tokens", "SELECT rec_id, array_to_string(addr_nums, '|') AS nums, array_to_string(list_sort(addr_num_set), '|') AS numset FROM ft")(lambda w: w.sides.select("rec_id", _text("addr_nums").alias("nums"), _text(F.array_sort("addr_num_set")).alias("numset")))
query("core_tokens", "SELECT rec_id, array_to_string(name_set, '|') AS toks, array_to_string(list_sort(name_core), '|') AS core FROM ft")(lambda w: w.sides.select("rec_id", _text("name_set").alias("toks"), _text(F.array_sort("name_core")).alias("core")))
query("skeletons", "SELECT rec_id, coalesce(string_agg(k, ' ' ORDER BY i) FILTER (k <> ''), '') AS skeleton FROM tok JOIN wr3 USING (t) WHERE f = 'name' GROUP BY rec_id")(lambda w: w.views.select("rec_id", F.array_join(X.skeletons(F.col("name_latin")), " ").alias("skeleton")))
query("transliteration", "SELECT rec_id, name_norm AS latin FROM vw")(lambda w: w.views.select("rec_id", F.col("name_latin").alias("latin")))
# Collections
query("country_distribution", "SELECT src, country, count(*) AS n FROM rec GROUP BY ALL")(lambda w: _out(w.raw.groupBy("src", "country").agg(F.count(F.lit(1)).alias("n"))))
query("target_density", "SELECT country, count(*) FILTER (WHERE src = 1) AS refs, count(*) FILTER (WHERE src > 1) AS targets, round(count(*) FILTER (WHERE src > 1) / count(*) FILTER (WHERE src = 1), 6) AS density, round(count(*) FILTER (WHERE src = 2) / count(*) FILTER (WHERE src = 1), 6) AS density_s2, round(count(*) FILTER (WHERE src = 3) / count(*) FILTER (WHERE src = 1), 6) AS density_s3 FROM rec GROUP BY country")(lambda w: _out(splits.density(w.raw)))
query("truth_links", "SELECT ref_id, tgt_id, src FROM truth")(lambda w: _out(w.truth, "ref_id", "tgt_id", "src"))
query("profile", f"SELECT src, country, count(*) AS n, count(*) FILTER (WHERE trim(addr_raw) = '') AS blank_addr, {_ACC} AS non_ascii, count(*) FILTER (WHERE regexp_matches(name_raw, '[\u0900-\u0dff]')) AS indic, max(length(name_raw)) AS longest, quantile_disc(length(name_raw), 0.5) AS p50, quantile_disc(length(name_raw), 0.9) AS p90, quantile_disc(length(name_raw), 0.99) AS p99 FROM rec GROUP BY ALL")(lambda w: _out(w.raw.groupBy("src", "country").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("addr_raw") == "").alias("blank_addr"), F.count_if(~X.is_ascii(F.col("name_raw"))).alias("non_ascii"), F.count_if(X.is_indic(F.col("name_raw"))).alias("indic"), F.max(F.length("name_raw")).alias("longest"), *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY length(name_raw))").cast("long").alias(a) for a, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])))
query("truth_sizes", "SELECT n_true, count(*) AS refs FROM nt GROUP BY 1")(lambda w: _out(decide.counts(w.links.limit(0), w.links, w.required).groupBy("n_true").agg(F.count(F.lit(1)).alias("refs"))))
query("duplicate_groups", "SELECT src, country, count(*) AS n, min(rec_id) AS first_id, string_agg(CAST(rec_id AS VARCHAR), ',' ORDER BY rec_id) AS ids FROM rec GROUP BY src, country, name_raw, addr_raw HAVING count(*) > 1")(lambda w: _out(splits.duplicate_groups(w.raw).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))))
# Retrieval
query("index_postings", "SELECT country, field, term, ref_id, dl FROM posts")(lambda w: _out(w.posts, "country", "field", "term", "ref_id", "dl"))
query("df_map", "SELECT country, field, term, df FROM dfm")(lambda w: _out(w.dfs))
query("corpus_stats", "SELECT country, field, n_docs, round(avgdl, 6) AS avgdl FROM stats")(lambda w: _out(w.stats))
query("rare_term_plan", "SELECT src, tgt_id, country, field, term, df FROM plan16")(lambda w: _out(w.plan(), "src", "tgt_id", "country", "field", "term", "df"))
query("name_lane_topk", "SELECT src, tgt_id, ref_id, score, rank FROM lane WHERE field = 'name'")(lambda w: _out(w.lanes.where("field = 'name'"), "src", "tgt_id", "ref_id", "score", "rank"))
query("addr_lane_topk", "SELECT src, tgt_id, ref_id, score, rank FROM lane WHERE field = 'addr'")(lambda w: _out(w.lanes.where("field = 'addr'"), "src", "tgt_id", "ref_id", "score", "rank"))
query("joint_lane_topk", "SELECT src, tgt_id, ref_id, joint_score, joint_rank FROM joint")(lambda w: _out(w.joint))
query("rrf_fuse", "SELECT src, tgt_id, ref_id, round(v, 6) AS v, fused_rank, pool_size, round(margin, 6) AS margin FROM pool")(lambda w: _out(w.pool, "src", "tgt_id", "ref_id", "v", "fused_rank", "pool_size", "margin"))
query("compact_strict", "SELECT src, tgt_id, ref_id, round(v, 6) AS v FROM pool WHERE place <= 2")(lambda w: _out(retrieval.compact(w.pool), "src", "tgt_id", "ref_id", "v"))
query("candidate_edges", "SELECT src, tgt_id, ref_id, round(v, 6) AS v, name_rank, addr_rank, joint_rank, pool_size, name_score, addr_score, joint_score, round(margin, 6) AS margin FROM edges")(lambda w: _out(w.edges))
query("adaptive_compaction", "SELECT src, tgt_id, ref_id, CAST(budget AS BIGINT) AS budget FROM (SELECT p.*, CASE WHEN n = a AND margin >= 0.05 THEN 1 WHEN trim(addr_raw) = '' OR n IS NULL OR a IS NULL OR n <> a THEN 3 ELSE 2 END AS budget FROM (SELECT *, max(CASE WHEN name_rank = 1 THEN ref_id END) OVER q AS n, max(CASE WHEN addr_rank = 1 THEN ref_id END) OVER q AS a FROM pool WINDOW q AS (PARTITION BY src, tgt_id)) p JOIN rec ON rec.rec_id = p.tgt_id) WHERE place <= budget")(lambda w: _out(retrieval.adaptive_budget(w.pool, w.views.where("src > 1").select("src", F.col("rec_id").alias("tgt_id"), "addr_missing", (F.col("name_indic") | F.col("addr_indic")).alias("indic"))), "src", "tgt_id", "ref_id", "budget"))
_flip = {k: re.sub(r"\bsrc (= 1|> 1)", lambda m: "src > 1" if m[1] == "= 1" else "src = 1", v) for k, v in CTES.items() if k in ("posts", "stats", "qterms")}
query("forward_candidates")(lambda w: _out(retrieval.candidate_edges(w.records.withColumn("src", F.when(F.col("src") == 1, 2).otherwise(1)))))
O["forward_candidates"] = "WITH " + ",\n".join(f"{k} AS ({_flip.get(k, v)})" for k, v in CTES.items() if k in ("rec", "nrm", "vw", "trm", "fld", "posts", "dfm", "stats", "qterms", "plan16", "plan8", "hits", "lane", "wide", "fus", "rnk", "pool", "jhits", "joint", "edges")).replace("SELECT src, rec_id AS tgt_id", "SELECT 2 AS src, rec_id AS tgt_id") + "\nSELECT CAST(src AS BIGINT) AS src, tgt_id, ref_id, round(v, 6) AS v, name_rank, addr_rank, joint_rank, pool_size, name_score, addr_score, joint_score, round(margin, 6) AS margin FROM edges"
query("address_pairs", "SELECT src, tgt_id, ref_id, row_number() OVER (PARTITION BY src, tgt_id ORDER BY dfs, ref_id) AS rank FROM (SELECT w.src, w.tgt_id, o.ref_id, sum(w.df) AS dfs FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt_id ORDER BY term IS DISTINCT FROM number, df, term) AS k FROM (SELECT *, first_value(CASE WHEN regexp_matches(term, '\\d') THEN term END) OVER (PARTITION BY src, tgt_id ORDER BY regexp_matches(term, '\\d') DESC, df, term) AS number FROM (SELECT f.src, f.rec_id AS tgt_id, f.country, d.term, d.df FROM (SELECT src, rec_id, country, unnest(addr_set) AS term FROM ft WHERE src > 1) f JOIN dfm d ON d.field = 'addr' AND d.country = f.country AND d.term = f.term))) w JOIN posts o ON o.field = 'addr' AND o.country = w.country AND o.term = w.term WHERE w.k <= 2 GROUP BY ALL HAVING count(*) = 2) QUALIFY rank <= 8")(lambda w: _out(retrieval.address_pairs(w.sides.where("src > 1"), w.dfs, w.posts)))
query("retrieval_screen", "SELECT 8 AS lane_k, 16 AS max_terms, 2 AS budget, 2 AS joint_k, country, count(*) AS links, count(*) FILTER (WHERE hit) AS found, round(count(*) FILTER (WHERE hit) / count(*), 6) AS recall, round(sum(pairs) / count(*), 6) AS pairs_per_query FROM (SELECT t.src, t.tgt_id, t.country, (SELECT count(*) FROM edges e WHERE e.src = t.src AND e.tgt_id = t.tgt_id) AS pairs, EXISTS (SELECT 1 FROM edges e WHERE e.src = t.src AND e.tgt_id = t.tgt_id AND e.ref_id = t.ref_id) AS hit FROM truth t) GROUP BY GROUPING SETS ((country), ())")(lambda w: _out(retrieval.screen(w.records, w.truth.select("src", "tgt_id", "ref_id"), [(8, 16, 2, 2)])))
query("owner_rank_histogram", "SELECT CASE WHEN fused_rank <= 2 THEN 'rank_1_2' WHEN fused_rank <= 4 THEN 'rank_3_4' WHEN fused_rank <= 8 THEN 'rank_5_8' WHEN fused_rank <= 16 THEN 'rank_9_16' WHEN fused_rank <= 64 THEN 'gt16' ELSE 'not_top64' END AS bucket, count(*) AS n FROM truth t LEFT JOIN pool p USING (src, tgt_id, ref_id) GROUP BY 1")(lambda w: _out(w.truth.join(w.pool, ["src", "tgt_id", "ref_id"], "left").groupBy(decide.rank_bucket(F.col("fused_rank")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))))
query("candidate_size_report", "SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5)::DOUBLE, 6) AS median, round(quantile_cont(n, 0.9)::DOUBLE, 6) AS p90, round(quantile_cont(n, 0.95)::DOUBLE, 6) AS p95, round(quantile_cont(n, 0.99)::DOUBLE, 6) AS p99, max(n) AS most, round(avg((n = 0)::INT), 6) AS without, round(sum(tp) / sum(n_true), 6) AS micro_recall, round(avg(tp / n_true) FILTER (WHERE n_true > 0), 6) AS macro_recall, round(avg((tp > 0)::INT) FILTER (WHERE n_true > 0), 6) AS any_hit, round(avg((tp = n_true)::INT) FILTER (WHERE n_true > 0), 6) AS all_hit FROM ccnt")(lambda w: _out(decide.candidate_sizes(w.edges.select("ref_id", "tgt_id"), w.links, w.required)))
# Features
_J2 = lambda v: _J(f"r.{v}", f"t.{v}")
_D2 = lambda a, b: f"(len(list_distinct(list_concat({a}, {b}))) - len(list_intersect({a}, {b})))"
_L2 = lambda v: f"CASE WHEN least(length(r.{v}), length(t.{v})) = 0 THEN 0 ELSE least(length(r.{v}), length(t.{v})) / greatest(length(r.{v}), length(t.{v})) END"
_JW = lambda a, b: f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE jaro_winkler_similarity({_A(a)}, {_A(b)}) END"
_LV = lambda v: f"CASE WHEN r.{v} = '' OR t.{v} = '' THEN 0 ELSE 1 - levenshtein({_A('r.' + v)}, {_A('t.' + v)}) / greatest(length(r.{v}), length(t.{v})) END"
_NA = "(r.addr_norm = '' OR t.addr_norm = '')"
_RN, _TN = "list_distinct(r.addr_nums)", "list_distinct(t.addr_nums)"
_JOIN = lambda v: (f"array_to_string(r.{v}, ' ')", f"array_to_string(t.{v}, ' ')")
_SQL_FEATURES = {
    "name_jw": _JW("r.name_norm", "t.name_norm"), "name_lev_norm": _LV("name_norm"), "name_tok_jaccard": _J2("name_set"), "name_tok_overlap": "len(list_intersect(r.name_set, t.name_set))",
    "name_exact": "(r.name_norm = t.name_norm)::INT", "name_sorted_exact": "(r.name_set = t.name_set)::INT", "name_sorted_jw": _JW(*_JOIN("name_set")), "name_len_ratio": _L2("name_norm"),
    "name_char_len_diff": "abs(length(r.name_norm) - length(t.name_norm))", "name_containment": "((len(r.name_set) > 0 AND list_has_all(t.name_set, r.name_set)) OR (len(t.name_set) > 0 AND list_has_all(r.name_set, t.name_set)))::INT",
    "name_shared_df_weight": "coalesce((SELECT avg(ln((s.n_docs + 1) / (coalesce(d.df, 0) + 1)) + 1) FROM (SELECT unnest(list_intersect(r.name_set, t.name_set)) AS x) u JOIN stats s ON s.country = t.country AND s.field = 'name' LEFT JOIN dfm d ON d.country = t.country AND d.field = 'name' AND d.term = u.x), 0)",
    "name_target_indic": "t.name_indic::INT", "name_ref_indic": "r.name_indic::INT", "addr_jw": _JW("r.addr_norm", "t.addr_norm"), "addr_lev_norm": _LV("addr_norm"), "addr_tok_jaccard": _J2("addr_set"),
    "addr_exact": f"(r.addr_norm = t.addr_norm AND NOT {_NA})::INT", "addr_sorted_exact": f"(r.addr_set = t.addr_set AND NOT {_NA})::INT", "addr_shared_numeric": "len(list_intersect(r.addr_num_set, t.addr_num_set))",
    "addr_numeric_jaccard": _J2("addr_num_set"), "addr_len_ratio": _L2("addr_norm"), "addr_char_len_diff": "abs(length(r.addr_norm) - length(t.addr_norm))", "addr_target_missing": "(t.addr_norm = '')::INT",
    "addr_ref_missing": "(r.addr_norm = '')::INT", "name_exact_addr_conflict": f"(r.name_norm = t.name_norm AND NOT {_NA} AND len(list_intersect(r.addr_set, t.addr_set)) = 0)::INT", "name_exact_addr_missing": f"(r.name_norm = t.name_norm AND {_NA})::INT",
    "fused_v": "e.v", "rank": "e.name_rank", "margin_g": "e.margin", "is_name_top1": "(e.name_rank = 1)::INT", "is_addr_top1": "(e.addr_rank = 1)::INT", "name_lane_score": "e.name_score", "addr_lane_score": "e.addr_score",
    "pool_size": "e.pool_size", "joint_rank": "e.joint_rank", "joint_score": "e.joint_score", "source_s2": "(e.src = 2)::INT", "addr_num_jaccard_all": _J(_RN, _TN),
    "addr_num_conflict": f"(len({_RN}) > 0 AND len({_TN}) > 0 AND len(list_intersect({_RN}, {_TN})) = 0)::INT", "addr_first_num_eq": "CASE WHEN len(r.addr_nums) = 0 OR len(t.addr_nums) = 0 THEN -1 ELSE (r.addr_nums[1] = t.addr_nums[1])::INT END",
    "addr_num_symdiff": _D2(_RN, _TN), "name_fold_jw": f"CASE WHEN r.name_norm = '' OR t.name_norm = '' THEN 0 ELSE {_JW('r.name_fold', 't.name_fold')} END", "addr_fold_jw": f"CASE WHEN {_NA} THEN 0 ELSE {_JW('r.addr_fold', 't.addr_fold')} END",
    "name_core_jaccard": _J2("name_core"), "name_core_exact": f"(len(r.name_core) > 0 AND {_D2('r.name_core', 't.name_core')} = 0)::INT", "name_core_missing_tokens": _D2("r.name_core", "t.name_core"),
    "name_skel_jaccard": _J2("name_skel"), "name_skel_jw": _JW(*_JOIN("name_skel")), "name_skel_core_jaccard": _J2("name_skel_core"), "addr_skel_jaccard": f"CASE WHEN {_NA} THEN 0 ELSE {_J2('addr_skel')} END",
}
query("pair_features", "SELECT e.src, e.tgt_id, e.ref_id, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in _SQL_FEATURES.items()) + " FROM edges e JOIN ft t ON t.rec_id = e.tgt_id JOIN ft r ON r.rec_id = e.ref_id")(lambda w: _out(w.features.drop("country")))
_six = ("name_tok_jaccard", "name_tok_overlap", "addr_tok_jaccard", "name_exact", "name_char_len_diff", "addr_len_ratio")
query("features_tokens", "SELECT e.src, e.tgt_id, e.ref_id, " + ", ".join(f"round(CAST({_SQL_FEATURES[k]} AS DOUBLE), 6) AS {k}" for k in _six) + " FROM edges e JOIN ft t ON t.rec_id = e.tgt_id JOIN ft r ON r.rec_id = e.ref_id")(lambda w: _out(w.token_features(_six)))
_comp = "count(*) OVER t AS t_n, count(*) OVER r AS r_n, row_number() OVER bt - 1 AS t_rank, row_number() OVER br - 1 AS r_rank, round(score - CASE WHEN row_number() OVER bt = 1 THEN coalesce(lead(score) OVER bt, -1.0) ELSE max(score) OVER t END, 6) AS t_gap_other, round(score - max(score) OVER r, 6) AS r_gap_max"
_wins = "WINDOW t AS (PARTITION BY src, tgt_id), r AS (PARTITION BY ref_id), bt AS (PARTITION BY src, tgt_id ORDER BY score DESC, ref_id), br AS (PARTITION BY ref_id ORDER BY score DESC, src, tgt_id)"
query("competition_features", f"SELECT src, tgt_id, ref_id, score AS s1, {_comp}, count(*) FILTER (WHERE score >= 0.5) OVER t AS t_n_hi, count(*) FILTER (WHERE score >= 0.5) OVER r AS r_n_hi FROM scored {_wins}")(lambda w: _out(decide.competition(w.scored)))
# Decisions
query("owner_winners", "SELECT src, tgt_id, ref_id, score FROM own")(lambda w: _out(decide.owners(w.scored, 0.02), "src", "tgt_id", "ref_id", "score"))
query("apply_threshold", "SELECT s.ref_id, coalesce(string_agg(src || ':' || tgt_id, ',' ORDER BY src, tgt_id) FILTER (WHERE score >= 0.7), '') AS tgts FROM scored s GROUP BY 1")(lambda w: decide.predictions(decide.apply_policy(w.scored, {"kind": "threshold", "tau": 0.7}), w.scored).select("ref_id", F.array_join(F.transform("tgt_ids", lambda t: F.concat_ws(":", t["src"].cast("string"), t["tgt_id"].cast("string"))), ",").alias("tgts")))
query("apply_owner", "SELECT src, tgt_id, ref_id, score FROM chosen")(lambda w: _out(w.chosen, "src", "tgt_id", "ref_id", "score"))
query("apply_expected_f", "SELECT src, tgt_id, ref_id, q AS score FROM efs WHERE gamma = 0.1 AND beta = 0.1 AND floor_ = 0.1")(lambda w: _out(decide.apply_policy(w.scored, {"kind": "efm", "gamma": 0.1, "beta": 0.1, "floor": 0.1}), "src", "tgt_id", "ref_id", "score"))
query("apply_row_thresholds", "SELECT src, tgt_id, ref_id, score FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, src, tgt_id) AS p, max(score) OVER (PARTITION BY ref_id) AS top FROM own) WHERE top >= 0.6 AND (p = 1 OR score >= 0.8)")(lambda w: _out(decide.apply_policy(w.scored, {"kind": "rows", "gamma": 0.02, "start": 0.6, "extra": 0.8}), "src", "tgt_id", "ref_id", "score"))
query("threshold_sweep", "SELECT tau, round(macro, 6) AS macro FROM swp WHERE kind = 'threshold'")(lambda w: _out(decide.threshold_sweep(w.scored, w.links, w.required)))
query("owner_policy_sweep", "SELECT gamma, round(macro, 6) AS macro, tau FROM bst WHERE kind = 'owner' AND gamma < 0.2")(lambda w: _out(decide.owner_sweep(w.scored, w.links, w.required)))
query("policy_table", "SELECT kind, gamma, NULL::DOUBLE AS beta, NULL::DOUBLE AS floor, tau, round(macro, 6) AS macro FROM bst UNION ALL SELECT 'efm', gamma, beta, floor_, 0.0, round(macro, 6) FROM efm")(lambda w: _out(decide.policy_table(w.scored, w.links, w.required)))
query("grid_threshold")(lambda w: w.spark.createDataFrame([tuple(decide.tau_grid(w.scored, w.links, w.required).values())], "tau double, macro double"))
query("expected_f_selection", "SELECT src, tgt_id, ref_id, q AS score FROM (SELECT *, min(CASE WHEN value = best THEN k END) OVER w AS last_ FROM (SELECT *, max(value) OVER w AS best, round(exp(lnone), 9) AS none_ FROM (SELECT *, CASE WHEN q > 0 THEN round(5 * part / (all_q + 4 * k), 9) END AS value FROM (SELECT src, tgt_id, ref_id, q, row_number() OVER o AS k, sum(q) OVER (o ROWS UNBOUNDED PRECEDING) AS part, sum(q) OVER w AS all_q, sum(ln(greatest(1 - q, 1e-12::DOUBLE))) OVER w AS lnone FROM (SELECT *, greatest(least(score, 1.0::DOUBLE), 0.0::DOUBLE) AS q FROM scored) WINDOW w AS (PARTITION BY ref_id), o AS (PARTITION BY ref_id ORDER BY q DESC, src, tgt_id))) WINDOW w AS (PARTITION BY ref_id)) WINDOW w AS (PARTITION BY ref_id)) WHERE k <= last_ AND none_ < best")(lambda w: _out(decide.expected_f(w.scored), "src", "tgt_id", "ref_id", "score"))
query("per_country_tau", "SELECT src, tgt_id, ref_id, score FROM scored WHERE score >= CASE country WHEN 'en' THEN 0.8 WHEN 'fr' THEN 0.6 ELSE 0.7 END")(lambda w: _out(decide.apply_policy(w.scored, {"kind": "threshold", "tau": 0.7}, {"en": 0.8, "fr": 0.6}), "src", "tgt_id", "ref_id", "score"))
query("matched_volume_tau", "SELECT tau, round(per_ref, 6) AS per_ref FROM (SELECT tau, count(*) FILTER (WHERE score >= tau) / (SELECT count(*) FROM req) AS per_ref FROM scored CROSS JOIN (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS tau) GROUP BY tau) ORDER BY round(abs(per_ref - 1.0), 9), tau LIMIT 1")(lambda w: _out(decide.matched_volume(w.scored, w.required, 1.0, [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])))
query("multi_owner_targets", "SELECT src, tgt_id, count(*) AS n FROM scored WHERE score >= 0.5 GROUP BY ALL HAVING count(*) > 1")(lambda w: _out(decide.multi_owner(w.scored.where("score >= 0.5"))))
query("platt_scores", "SELECT src, tgt_id, ref_id, round(1 / (1 + exp(least(greatest(-8.0::DOUBLE * score + 4.0::DOUBLE, -30), 30))), 6) AS p FROM scored")(lambda w: _out(w.scored.select("src", "tgt_id", "ref_id", S.platt(F.col("score"), -8.0, 4.0).alias("p"))))
# Evaluation
query("entity_scores", "SELECT ref_id, n_true, n_said, tp, round(f, 6) AS f FROM ent")(lambda w: _out(decide.entity_scores(decide.counts(w.chosen, w.links, w.required))))
query("score_report", "SELECT round(avg(f), 6) AS macro, round(avg(best), 6) AS oracle, round(1 - avg(best), 6) AS blocking_loss, round(avg(best) - avg(f), 6) AS scoring_loss, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_said - tp) AS BIGINT) AS fp, CAST(sum(n_true - tp) AS BIGINT) AS fn, count(*) FILTER (WHERE n_said = 0) AS empty_said, count(*) FILTER (WHERE n_true = 0) AS empty_true FROM ent")(lambda w: _out(decide.score_report(w.chosen, w.scored, w.links, w.required)))
query("slice_report", "SELECT slice, count(*) AS refs, round(avg(f), 6) AS macro, round(avg(best), 6) AS oracle, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_said - tp) AS BIGINT) AS fp, CAST(sum(n_true - tp) AS BIGINT) AS fn, round(avg(n_said), 6) AS said_per_ref, round(avg(n_true), 6) AS true_per_ref FROM (SELECT *, unnest(['all', CASE WHEN n_true = 0 THEN 'singletons' ELSE 'linked' END, 'country:' || country]) AS slice FROM ent) GROUP BY slice HAVING slice NOT LIKE 'country:%' OR count(*) >= 200")(lambda w: _out(decide.evaluate(w.chosen.select("ref_id", "tgt_id"), w.scored.select("ref_id", "tgt_id"), w.links, w.required)))
query("volumes", "SELECT country, CAST(sum(n) AS BIGINT) AS edges, count(*) AS refs, CAST(sum(s) AS BIGINT) AS selected, round(sum(s) / count(*), 6) AS said_per_ref, round(count(*) FILTER (WHERE s > 0) / count(*), 6) AS nonempty, round(sum(m) / sum(n), 6) AS middle FROM (SELECT e.country, e.ref_id, count(*) AS n, count(c.tgt_id) AS s, count(c.tgt_id) FILTER (WHERE e.score < 0.99) AS m FROM scored e LEFT JOIN chosen c USING (src, tgt_id, ref_id) GROUP BY ALL) GROUP BY country")(lambda w: _out(decide.volumes(w.scored, w.chosen)))
query("bootstrap_lcb")(lambda w: _out(model.bootstrap_bound(_paired(w))))


def _paired(w: World) -> DataFrame:
    """Differences by reference between owners and one threshold."""
    f = lambda p, n: decide.entity_scores(decide.counts(decide.apply_policy(w.scored, p), w.links, w.required)).select("ref_id", F.col("f").alias(n))
    return f({"kind": "owner", "gamma": 0.02, "tau": 0.7}, "a").join(f({"kind": "threshold", "tau": 0.7}, "b"), "ref_id").select("ref_id", (F.col("a") - F.col("b")).alias("delta"))


query("paired_deltas", f"SELECT ref_id, round(a.f - b.f, 6) AS delta FROM ent a JOIN (SELECT ref_id, {_F} AS f FROM (SELECT q.ref_id, n_true, count(s.tgt_id) AS n_said, count(t.tgt_id) AS tp FROM nt q LEFT JOIN (SELECT * FROM scored WHERE score >= 0.7) s USING (ref_id) LEFT JOIN truth t ON t.ref_id = s.ref_id AND t.tgt_id = s.tgt_id GROUP BY ALL)) b USING (ref_id)")(lambda w: _out(_paired(w)))
# Splits and environments
query("components", "SELECT r.rec_id, coalesce(g, r.rec_id) AS group_id FROM rec r LEFT JOIN (SELECT a, min(b) AS g FROM (WITH RECURSIVE far AS (SELECT a, b FROM walk UNION SELECT f.a, w.b FROM far f JOIN walk w ON w.a = f.b) SELECT * FROM far) GROUP BY a) ON a = r.rec_id")(lambda w: _out(splits.components(w.raw, w.near_links), "rec_id", "group_id"))
query("role_assignment", "SELECT rec_id, src, role FROM roles")(lambda w: _out(w.roles))
query("split_manifest", "SELECT r.rec_id, r.src, r.role, least(coalesce(o.g, r.rec_id), r.rec_id, coalesce(t.g, r.rec_id)) AS group_id, rec.country, coalesce(o.n, 0) AS truth_size, r.src = 1 AS is_anchor FROM roles r JOIN rec USING (rec_id) LEFT JOIN (SELECT ref_id, count(*) AS n, min(tgt_id) AS g FROM truth GROUP BY 1) o ON o.ref_id = r.rec_id LEFT JOIN (SELECT x.tgt_id, least(x.ref_id, y.g) AS g FROM truth x JOIN (SELECT ref_id, min(tgt_id) AS g FROM truth GROUP BY 1) y USING (ref_id)) t ON t.tgt_id = r.rec_id")(lambda w: _out(splits.manifest(w.raw, w.links, w.roles)))
query("leakage_check", "SELECT t.ref_id, t.tgt_id, a.role AS ref_role, b.role AS tgt_role FROM nlinks t JOIN roles a ON a.rec_id = t.ref_id JOIN roles b ON b.rec_id = t.tgt_id WHERE a.role <> b.role")(lambda w: _out(splits.leaks(w.roles, w.near_links)))
query("split_violations", "SELECT 'link across roles' AS check_, t.ref_id AS a, t.tgt_id AS b FROM nlinks t JOIN roles a ON a.rec_id = t.ref_id JOIN roles b ON b.rec_id = t.tgt_id WHERE a.role <> b.role UNION SELECT 'protected record teaches', t.ref_id, t.tgt_id FROM nlinks t JOIN roles a ON a.rec_id = t.ref_id JOIN roles b ON b.rec_id = t.tgt_id WHERE a.role IN ('D', 'K', 'A') OR b.role IN ('D', 'K', 'A') UNION SELECT 'link across groups', t.ref_id, t.tgt_id FROM nlinks t WHERE NOT EXISTS (SELECT 1 FROM truth x WHERE x.tgt_id = t.tgt_id AND x.ref_id = t.ref_id)")(lambda w: splits.split_violations(w.roles, w.near_links, splits.components(w.raw, w.links), w.near_links.toDF("a", "b")).withColumnRenamed("check", "check_"))
query("reserve_audit", f"SELECT r.rec_id, r.src, CASE WHEN c.rec_id IS NOT NULL OR o.tgt_id IS NOT NULL THEN 'A2' ELSE r.role END AS role FROM roles r LEFT JOIN (SELECT rec_id FROM roles WHERE src = 1 AND role = 'B' AND substr({_sha('audit')}, 1, 16) < '{int(0.1 * 2**64):016x}') c ON c.rec_id = r.rec_id LEFT JOIN (SELECT tgt_id FROM truth JOIN roles x ON x.rec_id = ref_id WHERE x.role = 'B' AND substr({_sha('audit', 'ref_id')}, 1, 16) < '{int(0.1 * 2**64):016x}') o ON o.tgt_id = r.rec_id")(lambda w: _out(splits.reserve_audit(w.roles, w.links)))
query("catalog_fill", "SELECT rec_id, country, kept FROM cat")(lambda w: _out(w.catalog))


@query("traffic_fill", f"SELECT rec_id, src, country, kept FROM (SELECT r.rec_id, r.src, r.country, CASE WHEN t.ref_id IS NULL THEN 'fill' ELSE 'owned' END AS kept, row_number() OVER (PARTITION BY r.country, r.src, t.ref_id IS NULL ORDER BY {_sha('traffic', 'r.rec_id')}, r.rec_id) AS k, count(t.ref_id) OVER (PARTITION BY r.country, r.src) AS have, (SELECT count(*) FROM rec z WHERE z.country = r.country AND z.src = r.src) // 2 AS quota FROM rec r LEFT JOIN truth t ON t.tgt_id = r.rec_id WHERE r.src > 1 AND (t.ref_id IS NULL OR t.ref_id IN (SELECT rec_id FROM cat))) WHERE kept = 'owned' OR k <= greatest(quota - have, 0)")
def _traffic(w: World) -> DataFrame:
    quotas = w.raw.where("src > 1").groupBy("country", "src").agg(F.floor(F.count(F.lit(1)) / 2).alias("quota"))
    return _out(splits.traffic_fill(w.catalog, w.raw, w.links, quotas))


query("whole_environment", "SELECT rec_id, src, country FROM rec")(lambda w: _out((lambda c, t: c.select("rec_id", F.lit(1).alias("src"), "country").union(t.select("rec_id", "src", "country")))(*splits.whole_environment(w.raw))))
query("dense_catalog", "SELECT rec_id, country, kept FROM dcat")(lambda w: _out(w.dense[0]))
query("dense_traffic", "SELECT rec_id, src, country, kept FROM dtra")(lambda w: _out(w.dense[1]))
query("ghost_references", "SELECT rec_id FROM rec WHERE src = 1 AND rec_id NOT IN (SELECT rec_id FROM dcat)")(lambda w: _out(splits.ghosts(w.roles, w.dense[0])))
query("environment_report", "SELECT c.country, c.refs, coalesce(t.n, 0) AS targets, round(coalesce(t.n, 0) / c.refs, 6) AS targets_per_ref, round(CASE WHEN t.n > 0 THEN 1 - t.o / t.n ELSE 0 END, 6) AS ownerless FROM (SELECT country, count(*) AS refs FROM dcat GROUP BY 1) c LEFT JOIN (SELECT d.country, count(*) AS n, count(c.rec_id) AS o FROM dtra d LEFT JOIN truth x ON x.tgt_id = d.rec_id LEFT JOIN dcat c ON c.rec_id = x.ref_id GROUP BY 1) t ON t.country = c.country")(lambda w: _out(splits.environment_report(*w.dense, w.links)))
query("cohort_catalog", "SELECT rec_id, country, kept FROM ncat")(lambda w: _out(w.cohort[0]))
query("cohort_traffic", "SELECT rec_id, src, country, kept FROM ctra")(lambda w: _out(w.cohort[1]))
# Models
query("oof_folds", "SELECT rec_id AS ref_id, (rec_id * 2654435761 % 1000003) % 2 AS fold FROM rec WHERE src = 1")(lambda w: _out(w.required.select("ref_id", model.fold().alias("fold"))))
query("train_mask", "SELECT e.src, e.tgt_id, e.ref_id, a.role IN ('F', 'B') AND b.role IN ('F', 'B') AS fits, (t.tgt_id IS NOT NULL)::INT::DOUBLE AS label FROM edges e JOIN roles a ON a.rec_id = e.ref_id JOIN roles b ON b.rec_id = e.tgt_id LEFT JOIN truth t ON t.ref_id = e.ref_id AND t.tgt_id = e.tgt_id")(lambda w: _out(model.with_labels(model.with_roles(w.edges, w.roles), w.links).withColumn("fits", model.teaches()), "src", "tgt_id", "ref_id", "fits", "label"))
query("masked_labels", "SELECT e.src, e.tgt_id, e.ref_id, CASE WHEN b.role = 'F' THEN (a.role = 'F' AND t.tgt_id IS NOT NULL)::INT::DOUBLE END AS label FROM edges e JOIN roles a ON a.rec_id = e.ref_id JOIN roles b ON b.rec_id = e.tgt_id LEFT JOIN truth t ON t.ref_id = e.ref_id AND t.tgt_id = e.tgt_id")(lambda w: _out(model.supervised(model.with_roles(w.edges, w.roles), w.links), "src", "tgt_id", "ref_id", "label"))


@query("gbt_scores")
def _gbt(w: World) -> DataFrame:
    """Both stages on all 50 features and the competition of out-of-fold scores."""
    e = model.with_labels(model.with_roles(w.features, w.roles), w.links).withColumn("fits", model.teaches())
    scored, _, _ = model.two_stages(e, list(pair_features()), model.TrainConfig(rounds=10, depth=5, least=20))
    return _out(scored, "src", "tgt_id", "ref_id", "s", "score")


# Results
query("match_lists", "SELECT q.ref_id, coalesce(ids, '') AS ids FROM req q LEFT JOIN (SELECT ref_id, string_agg(DISTINCT CAST(tgt_id AS VARCHAR), ',' ORDER BY CAST(tgt_id AS VARCHAR)) AS ids FROM chosen GROUP BY 1) USING (ref_id)")(lambda w: id_lists(w.required, w.chosen.select("ref_id", F.col("tgt_id").cast("string").alias("tgt_id")), "ids"))
query("candidate_lists", "SELECT q.ref_id, coalesce(ids, '') AS ids FROM req q LEFT JOIN (SELECT ref_id, string_agg(DISTINCT CAST(tgt_id AS VARCHAR), ',' ORDER BY CAST(tgt_id AS VARCHAR)) AS ids FROM edges GROUP BY 1) USING (ref_id)")(lambda w: id_lists(w.required, w.edges.select("ref_id", F.col("tgt_id").cast("string").alias("tgt_id")), "ids"))
query("scored_lists", "SELECT q.ref_id, coalesce(m, '') AS matches, coalesce(c, '') AS candidates FROM req q LEFT JOIN (SELECT ref_id, string_agg(DISTINCT CAST(tgt_id AS VARCHAR), ',' ORDER BY CAST(tgt_id AS VARCHAR)) AS c, string_agg(DISTINCT CAST(tgt_id AS VARCHAR), ',' ORDER BY CAST(tgt_id AS VARCHAR)) FILTER (WHERE score >= 0.7) AS m FROM scored GROUP BY 1) USING (ref_id)")(lambda w: scored_lists(w.required, w.scored.withColumn("selected", F.col("score") >= 0.7)))


@query("audit_violations", """SELECT 'match row missing' AS check_, CAST(ref_id AS VARCHAR) AS entity, '' AS detail FROM (SELECT DISTINCT ref_id FROM truth) WHERE ref_id NOT IN (SELECT ref_id FROM scored WHERE score >= 0.5)
UNION ALL SELECT DISTINCT 'match row not required', CAST(ref_id AS VARCHAR), '' FROM scored WHERE score >= 0.5 AND ref_id NOT IN (SELECT ref_id FROM truth)
UNION ALL SELECT 'match row repeated', CAST(ref_id AS VARCHAR), '' FROM scored WHERE score >= 0.5 GROUP BY ref_id HAVING count(DISTINCT src) > 1
UNION ALL SELECT DISTINCT 'match id unknown', CAST(ref_id AS VARCHAR), CAST(tgt_id AS VARCHAR) FROM scored WHERE score >= 0.5 AND src <> 2
UNION ALL SELECT 'candidate row missing', CAST(ref_id AS VARCHAR), '' FROM (SELECT DISTINCT ref_id FROM truth) WHERE ref_id NOT IN (SELECT ref_id FROM chosen)
UNION ALL SELECT DISTINCT 'candidate row not required', CAST(ref_id AS VARCHAR), '' FROM chosen WHERE ref_id NOT IN (SELECT ref_id FROM truth)
UNION ALL SELECT DISTINCT 'candidate of itself', CAST(ref_id AS VARCHAR), CAST(ref_id AS VARCHAR) FROM chosen
UNION ALL SELECT DISTINCT 'candidate id repeated', CAST(c.ref_id AS VARCHAR), CAST(c.tgt_id AS VARCHAR) FROM chosen c JOIN truth t USING (ref_id, tgt_id)
UNION ALL SELECT DISTINCT 'candidate id unknown', CAST(ref_id AS VARCHAR), CAST(tgt_id AS VARCHAR) FROM (SELECT ref_id, tgt_id, src FROM chosen UNION SELECT c.ref_id, t.tgt_id, t.src FROM (SELECT DISTINCT ref_id FROM chosen) c JOIN truth t USING (ref_id)) WHERE src <> 2
UNION ALL SELECT DISTINCT 'match outside the candidates', CAST(ref_id AS VARCHAR), CAST(tgt_id AS VARCHAR) FROM scored s WHERE score >= 0.5 AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.ref_id = s.ref_id AND c.tgt_id = s.tgt_id) AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.ref_id = s.ref_id AND t.tgt_id = s.tgt_id AND t.ref_id IN (SELECT ref_id FROM chosen))""")
def _audit(w: World) -> DataFrame:
    """Faulty lists: matches come a source a row; candidates are the chosen edges, the references' own ids and true links
    once more; only references with true links are required, only targets of source 2 known."""
    some = w.scored.where("score >= 0.5")
    matches = some.groupBy("ref_id", "src").agg(F.collect_list("tgt_id").alias("ids")).drop("src")
    true = w.links.groupBy("ref_id").agg(F.collect_list("tgt_id").alias("true"))
    empty = F.array().cast("array<bigint>")
    candidates = w.chosen.groupBy("ref_id").agg(F.collect_list("tgt_id").alias("ids")).join(true, "ref_id", "left").select("ref_id", F.concat("ids", F.array("ref_id"), F.coalesce("true", empty)).alias("ids"))
    known = w.raw.where("src = 2").select(F.col("rec_id").alias("tgt_id"))
    return audit.violations(w.links.select("ref_id").distinct(), matches, candidates, known).select(F.col("check").alias("check_"), "entity", "detail")


query("support_diff", "SELECT 'ledger' AS side, ref_id, tgt_id FROM (SELECT ref_id, tgt_id FROM scored EXCEPT ALL SELECT ref_id, tgt_id FROM truth) UNION ALL SELECT 'exported', ref_id, tgt_id FROM (SELECT ref_id, tgt_id FROM truth EXCEPT ALL SELECT ref_id, tgt_id FROM scored)")(lambda w: audit.support_difference(w.scored, w.links))


# Vectors and plain tables


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    head = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    lead = e.join(head, ["label", "vec_id"]).select("label", F.col("embedding").alias("lead"))
    return e.join(lead, "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("lead")), 6).alias("cosine"))


Q["embedding_cosine"] = _emb
O["embedding_cosine"] = "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(l.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) l USING (label)"
Q["embedding_cosine_topk"] = lambda spark, d: _out(neighbours.cosine_topk(_embeddings(spark, d), F.col("vec_id") % 50 == 0))
O["embedding_cosine_topk"] = "SELECT query_id, rank, vec_id, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS cosine FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= 10"


def _cosine_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The competition by cosine of edges whose two documents have vectors of their ids."""
    v = _embeddings(spark, sf_dir)
    side = lambda key: v.select(F.col("vec_id").alias(key), F.col("embedding").alias(f"{key}_v"))
    e = World(spark, sf_dir).scored.join(side("ref_id"), "ref_id").join(side("tgt_id"), "tgt_id")
    return _out(decide.cosine_competition(e.withColumn("c", F.round(S.cosine(F.col("ref_id_v"), F.col("tgt_id_v")), 6))))


Q["cosine_competition"] = _cosine_features
O["cosine_competition"] = sql("SELECT src, tgt_id, ref_id, c, t_rank AS c_t_rank, t_gap_other AS c_t_gap_other, r_rank AS c_r_rank, r_gap_max AS c_r_gap_max FROM (SELECT src, tgt_id, ref_id, score AS c, " + _comp + " FROM (SELECT s.src, s.tgt_id, s.ref_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM scored s JOIN embeddings a ON a.vec_id = s.ref_id JOIN embeddings b ON b.vec_id = s.tgt_id) " + _wins + ")")
Q["string_similarity"] = lambda spark, d: (lambda p: p.select("p_partkey", F.round(S.levenshtein_ratio(F.col("p_name"), F.col("p_type")), 6).alias("lev"), F.round(S.jaro_winkler(F.col("p_name"), F.col("p_type")), 6).alias("jw")))(spark.read.parquet(f"{d}/part.parquet"))
O["string_similarity"] = "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS lev, round(jaro_winkler_similarity(p_name, p_type), 6) AS jw FROM part"
