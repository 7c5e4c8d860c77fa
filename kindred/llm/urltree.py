"""URL filters: rules, and where none fits a path-template tree by host. DataFrame operations only.

A node of the tree is a host's template so far. What all its pages' paths have in common stays literal; then
the node splits: a path segment stays literal if at least MIN_PAGES pages and a part MIN_SHARE of the node's
pages have it, else it becomes `*`. A node of one path, or of fewer than MIN_PAGES pages, is a leaf: the former
takes the rest of the path as it is, the latter ends in `**` if its paths go on. There is no cap on depth.

Templates of a host that differ in literals only are branches of one family; those with labelled pages whose
blocked rates don't differ significantly are merged. A branch's purity is its share of blocked labelled pages,
smoothed towards its family's, which is smoothed towards its host's and that towards the whole table's; a
template without labelled pages joins its family's branch as a whole and has the family's purity. Templates
of a purity of at least REJECT are rejected. Labels are the rules' verdicts.

Defined cases: a null url, or one without `://`, has an empty host and path and so no segments; rows are
judged each, repeated ones alike; ties between rules of one length go to the smaller rule; without
labelled pages nothing is rejected; columns beside page_id and url are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MIN_PAGES, MIN_SHARE = 5, 0.01
#: Up to so many segments of nodes are sent to all tasks.
SENT = 100_000
#: Pages that the prior counts for, and the smoothed share of blocked pages from which a template is rejected.
PRIOR, REJECT = 4.0, 0.8
#: Rates closer than so many standard errors are alike.
ALIKE = 1.64


def parts(url: str) -> tuple[Column, Column]:
    c = F.col(url).cast("string")
    has = F.coalesce(F.contains(c, F.lit("://")), F.lit(False))
    host = ascii_lower(F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(c, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. `rules` is a list of the caller's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def templates(paths: DataFrame, least: int = MIN_PAGES, share: float = MIN_SHARE) -> DataFrame:
    """(host, path, n, blocked, labelled, family, template) of rows (host, path, n, blocked, labelled), one for each path."""
    node = ["host", "template"]
    fixed = ["host", "path", "n", "blocked", "labelled", "family", "template"]
    rest = F.filter(F.split("path", "/"), lambda s: s != "")
    now = paths.select("host", "path", "n", "blocked", "labelled", F.lit("").alias("family"), F.lit("").alias("template"), rest.alias("rest"))
    literal = lambda c: F.array_join(F.transform(c, lambda s: F.concat(F.lit("/"), s)), "")
    done = []
    while True:
        now = cut(now.withColumn("seg", F.get("rest", F.lit(0))))
        if now.isEmpty():
            break
        segs = cut(now.groupBy(*node, "seg").agg(F.sum("n").alias("m"), F.min("rest").alias("lo"), F.max("rest").alias("hi")))
        nodes = segs.groupBy(*node).agg(F.sum("m").alias("all"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        # The least and the greatest path of a node agree as far as all its paths do.
        unlike = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), False)
        common = F.when(unlike == 0, F.least(F.size("lo"), F.size("hi"))).otherwise(unlike - 1).cast("int")
        state = F.when((F.col("all") < least) & (F.col("lo") != F.col("hi")), "few").when(F.col("lo") == F.col("hi"), "one").when(common > 0, "skip").otherwise("split")
        nodes = cut(nodes.select(*node, "all", state.alias("state"), common.alias("common")))
        frequent = (F.col("m") >= least) & (F.col("m") >= share * F.col("all")) & F.col("seg").isNotNull()
        kept = segs.join(nodes.where("state = 'split'"), node).where(frequent).select(*node, "seg", F.lit(True).alias("literal"))
        # Few nodes are sent to where the paths are, so a large node's paths need not meet in one task.
        side = F.broadcast if segs.count() <= SENT else lambda df: df
        each = now.join(side(nodes.drop("all")), node).join(side(kept), [*node, "seg"], "left")
        whole = (F.col("state") == "one") | F.col("seg").isNull()
        ends = F.when(whole, literal(F.col("rest"))).otherwise("/**")
        stars = F.when(whole, F.repeat(F.lit("/*"), F.size("rest"))).otherwise("/**")
        leaf = F.col("state").isin("few", "one") | F.col("seg").isNull()
        each = cut(each.withColumn("leaf", leaf))
        done.append(each.where("leaf").withColumns({"template": F.concat("template", ends), "family": F.concat("family", stars)}).select(*fixed))
        skip = F.col("state") == "skip"
        took = F.when(skip, F.col("common")).otherwise(1)
        step = F.when(skip, literal(F.slice("rest", 1, F.greatest("common", F.lit(0))))).when(F.col("literal"), F.concat(F.lit("/"), "seg")).otherwise("/*")
        now = each.where("not leaf").withColumns({"template": F.concat("template", step), "family": F.concat("family", F.repeat(F.lit("/*"), took)), "rest": F.slice("rest", took + 1, F.size("rest"))}).select(*fixed, "rest")
    return functools.reduce(DataFrame.union, done) if done else now.select(*fixed)


def smoothed(blocked: str, labelled: str, towards: str) -> Column:
    return (F.col(blocked) + PRIOR * F.col(towards)) / (F.col(labelled) + PRIOR)


def merged(tree: DataFrame) -> DataFrame:
    """(host, family, template, branch, purity, known): known tells what labelled pages the purity rests on: the
    'branch', its 'family', the 'host', or 'none', the whole table alone. Templates without labels have branch -1."""
    stats = cut(tree.groupBy("host", "family", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")))
    total = stats.agg(F.coalesce(F.sum("b") / F.nullif(F.sum("l"), F.lit(0)), F.lit(0.0)).alias("g"))
    hosts = stats.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb")).crossJoin(F.broadcast(total)).withColumn("h", smoothed("hb", "hl", "g"))  # total: one row
    families = stats.groupBy("host", "family").agg(F.sum("l").alias("fl"), F.sum("b").alias("fb")).join(hosts, "host").withColumn("f", smoothed("fb", "fl", "h"))
    # Branches: along the rates of a family's labelled templates, a new one where neighbours differ.
    rates = stats.where("l > 0").groupBy("host", "family", (F.col("b") / F.col("l")).alias("rate")).agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    order = Window.partitionBy("host", "family").orderBy("rate")
    near = rates.withColumns({"l0": F.lag("l").over(order), "b0": F.lag("b").over(order)})
    pooled = (F.col("b") + F.col("b0") + 1) / (F.col("l") + F.col("l0") + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / F.col("l0")))
    differs = F.coalesce((F.col("rate") - F.col("b0") / F.col("l0") > ALIKE * error).cast("int"), F.lit(0))
    some = near.withColumn("new", differs).withColumn("branch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pool = Window.partitionBy("host", "family", "branch")
    some = some.select("host", "family", "rate", "branch", F.sum("l").over(pool).alias("bl"), F.sum("b").over(pool).alias("bb"))
    each = stats.withColumn("rate", F.col("b") / F.nullif(F.col("l"), F.lit(0))).join(families, ["host", "family"]).join(some, ["host", "family", "rate"], "left")
    known = F.when(F.col("l") > 0, "branch").when(F.col("fl") > 0, "family").when(F.col("hl") > 0, "host").otherwise("none")
    return each.select("host", "family", "template", F.coalesce("branch", F.lit(-1).cast("long")).alias("branch"), F.when(F.col("l") > 0, smoothed("bb", "bl", "f")).otherwise(F.col("f")).alias("purity"), known.alias("known"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity, known) of every row; the last three null where a rule fits."""
    host, path = parts("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    thin = cut(rows.select("page_id", "host", "path", "r.rule", "r.verdict"))
    paths = thin.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.count("verdict").alias("labelled"))
    tree = cut(templates(paths))
    judged = tree.where("labelled < n").join(merged(tree), ["host", "family", "template"]).select("host", "path", "template", "purity", "known")
    open_ = thin.where("verdict is null").drop("rule", "verdict").join(judged, ["host", "path"])
    verdict = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    void = F.lit(None).cast("string")
    return open_.select("page_id", "host", "path", void.alias("rule"), verdict.alias("verdict"), "template", "purity", "known").union(
        thin.where("verdict is not null").select("page_id", "host", "path", "rule", "verdict", void, F.lit(None).cast("double"), void)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
