"""Identity-disjoint roles, density-matched catalogs and traffic. Sampling is by hash order, so it repeats exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

#: Held-out roles, each with this share of a stratum; the rest is B.
ROLES, SHARE = ("F", "D", "K", "A"), 0.05
#: Roles whose records may never teach, and those that may fill a catalog.
PROTECTED, BACKGROUND = ("D", "K", "A", "A2"), ("F", "B")


def hash_order(seed: str, column: str = "rec_id") -> Column:
    return F.sha2(F.concat(F.lit(seed + ":"), F.col(column).cast("string")), 256)


def with_place(rows: DataFrame, seed: str, *keys: str, name: str = "k") -> DataFrame:
    """Adds each row's place from 1 in the hash order of its keys: rows are counted in 4096 buckets of the hash and
    sorted inside them only, so no key's rows meet in one task."""
    h = rows.withColumn("h_", hash_order(seed)).withColumn("b_", F.substring("h_", 1, 3))
    sizes = h.groupBy(*keys, "b_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(*keys).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"{c}_") for c in keys], F.col("b_").alias("b__"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    inside = h.withColumn("r_", F.row_number().over(Window.partitionBy(*keys, "b_").orderBy("h_", "rec_id")))
    same = F.col("b_") == F.col("b__")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return inside.join(F.broadcast(sizes), same).select(*rows.columns, (F.col("before_") + F.col("r_")).alias(name))  # sizes: 4096 rows for each of a few keys


def components(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(rec_id, src, country, group_id): what links connect shares a group, named by its smallest member; others are their own."""
    nodes = graph.components(truth.select(F.col("ref_id").alias("a"), F.col("tgt_id").alias("b")))
    found = nodes.select(F.col("node").alias("rec_id"), "root")
    return records.select("rec_id", "src", "country").join(found, "rec_id", "left").select("rec_id", "src", "country", F.coalesce("root", "rec_id").alias("group_id"))


def duplicate_groups(records: DataFrame) -> DataFrame:
    """(src, country, n, first_id, ids): equal payloads that stand at least twice, the ids sorted."""
    out = records.groupBy("src", "country", "name_raw", "addr_raw").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("first_id"), F.array_sort(F.collect_list("rec_id")).alias("ids"))
    return out.where("n > 1").select("src", "country", "n", "first_id", "ids")


def heads(records: DataFrame, truth: DataFrame) -> DataFrame:
    """(rec_id, head): whose role a record has. A link's members have that of their component's smallest reference;
    unlinked targets of equal payload that of the smallest of them; others their own."""
    group = components(records, truth)
    top = group.where("src = 1").groupBy("group_id").agg(F.min("rec_id").alias("top"))
    linked = group.join(top, "group_id", "left").select("rec_id", "top")
    lone = records.join(linked.where("top is null").select("rec_id"), "rec_id", "left_semi")
    least = lone.groupBy("src", "country", "name_raw", "addr_raw").agg(F.min("rec_id").alias("head"))
    same = [lone[c].eqNullSafe(least[c]) for c in ("src", "country", "name_raw", "addr_raw")]
    alike = lone.join(least, same[0] & same[1] & same[2] & same[3]).select(lone["rec_id"], "head")
    return linked.where("top is not null").select("rec_id", F.col("top").alias("head")).union(alike)


def quotas(sizes: DataFrame) -> DataFrame:
    """Adds the array q of how many heads of each stratum (country, stratum, size) get each of ROLES: largest remainders,
    ties by the order of the roles, which turns from stratum to stratum."""
    turned = sizes.withColumn("turn", (F.row_number().over(Window.orderBy("country", "stratum")) - 1) % len(ROLES))  # a row for each stratum
    each = F.floor(F.col("size") * SHARE)
    extra = F.floor(F.col("size") * SHARE * len(ROLES) + 0.5) - each * len(ROLES)
    return turned.withColumn("q", F.array(*[each + (F.pmod(F.lit(j) - F.col("turn"), F.lit(len(ROLES))) < extra).cast("int") for j in range(len(ROLES))]))


def assign_roles(records: DataFrame, truth: DataFrame, seed: str = "split") -> DataFrame:
    """(rec_id, src, role): references stratified by country and number of targets, unlinked targets by country and
    source, shares by largest remainder; all else inherits (see heads)."""
    n_true = truth.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("ref_id", "rec_id")
    of = heads(records, truth)
    stratum = F.when(F.col("src") == 1, F.least(F.coalesce("n", F.lit(0)), F.lit(4))).otherwise(10 + F.col("src"))
    own = of.where("rec_id = head").select("rec_id").join(records.select("rec_id", "src", "country"), "rec_id").join(n_true, "rec_id", "left").select("rec_id", "src", "country", stratum.cast("int").alias("stratum"))
    limits = quotas(own.groupBy("country", "stratum").agg(F.count(F.lit(1)).alias("size"))).select(F.col("country").alias("c_"), F.col("stratum").alias("s_"), "q")
    ranked = with_place(own, seed, "country", "stratum").join(F.broadcast(limits), F.col("country").eqNullSafe(F.col("c_")) & (F.col("stratum") == F.col("s_")))
    role: Column = F.lit("B")
    for j in reversed(range(len(ROLES))):
        upto = sum((F.col("q")[i] for i in range(j + 1)), F.lit(0))
        role = F.when(F.col("k") <= upto, ROLES[j]).otherwise(role)
    return of.join(ranked.select(F.col("rec_id").alias("head"), role.alias("role")), "head").join(records.select("rec_id", "src"), "rec_id").select("rec_id", "src", "role")


def leaks(roles: DataFrame, truth: DataFrame) -> DataFrame:
    """Links whose ends have different roles."""
    r = roles.select(F.col("rec_id").alias("ref_id"), F.col("role").alias("ref_role"))
    t = roles.select(F.col("rec_id").alias("tgt_id"), F.col("role").alias("tgt_role"))
    return truth.join(r, "ref_id", "left").join(t, "tgt_id", "left").where("not ref_role <=> tgt_role").select("ref_id", "tgt_id", "ref_role", "tgt_role")


def split_violations(roles: DataFrame, truth: DataFrame, groups: DataFrame, teaching: DataFrame | None = None) -> DataFrame:
    """(check, a, b): links across roles, links across groups (rec_id, group_id), and teaching pairs (a, b) of which one is protected."""
    out = leaks(roles, truth).select(F.lit("link across roles").alias("check"), F.col("ref_id").alias("a"), F.col("tgt_id").alias("b"))
    side = lambda k: groups.select(F.col("rec_id").alias(k), F.col("group_id").alias(f"{k}_g"))
    across = truth.join(side("ref_id"), "ref_id", "left").join(side("tgt_id"), "tgt_id", "left").where("not ref_id_g <=> tgt_id_g")
    out = out.union(across.select(F.lit("link across groups"), "ref_id", "tgt_id"))
    if teaching is not None:
        held = roles.where(F.col("role").isin(*PROTECTED)).select("rec_id")
        for end in ("a", "b"):
            out = out.union(teaching.join(held.withColumnRenamed("rec_id", end), end, "left_semi").select(F.lit("protected record teaches"), "a", "b"))
    return out.distinct()


def manifest(records: DataFrame, truth: DataFrame, roles: DataFrame) -> DataFrame:
    """(rec_id, src, role, group_id, country, truth_size, is_anchor) of every record."""
    n = truth.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("ref_id", "rec_id")
    out = components(records, truth).join(roles.select("rec_id", "role"), "rec_id").join(n, "rec_id", "left")
    return out.select("rec_id", "src", "role", "group_id", "country", F.when(F.col("src") == 1, F.coalesce("n", F.lit(0))).otherwise(0).cast("int").alias("truth_size"), (F.col("src") == 1).alias("is_anchor"))


def reserve_audit(roles: DataFrame, truth: DataFrame, share: float = 0.1, seed: str = "audit") -> DataFrame:
    """B references whose hash falls below `share` become A2 with all that they own. Doing it again changes nothing."""
    bound = f"{min(int(share * 2**64), 2**64 - 1):016x}"
    chosen = roles.where((F.col("src") == 1) & F.col("role").isin("B", "A2") & (F.substring(hash_order(seed), 1, 16) < bound)).select("rec_id")
    owned = truth.join(chosen.withColumnRenamed("rec_id", "ref_id"), "ref_id", "left_semi").select(F.col("tgt_id").alias("rec_id"))
    mark = chosen.union(owned).distinct().withColumn("reserved", F.lit(True))
    return roles.join(mark, "rec_id", "left").select("rec_id", "src", F.when(F.col("reserved"), "A2").otherwise(F.col("role")).alias("role"))


def _filled(pool: DataFrame, limit: DataFrame, seed: str, *keys: str) -> DataFrame:
    """The first rows of the pool in hash order, up to (keys, room)."""
    named = limit.select(*[F.col(c).alias(f"{c}_l") for c in keys], "room")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_l"))
    return with_place(pool, seed, *keys).join(F.broadcast(named), same).where("k <= room").select(*pool.columns)  # limit: a row for each of a few keys


def catalog_fill(roles: DataFrame, records: DataFrame, quotas: DataFrame, seed: str = "fill", held_roles: tuple[str, ...] | None = None, background: tuple[str, ...] = ("B",)) -> DataFrame:
    """(rec_id, country, kept): references of held-out roles (all but the background's, or the named) always, background
    ones in hash order up to (country, quota). What is left over are ghosts: their targets own no reference."""
    refs = roles.where("src = 1").join(records.select("rec_id", "country"), "rec_id")
    held = refs.where(F.col("role").isin(*held_roles) if held_roles else ~F.col("role").isin(*background))
    room = held.groupBy("country").agg(F.count(F.lit(1)).alias("held"))
    limit = quotas.join(room, "country", "left").select("country", F.greatest(F.col("quota") - F.coalesce("held", F.lit(0)), F.lit(0)).alias("room"))
    rest = refs.where(F.col("role").isin(*background)).join(held, "rec_id", "left_anti").select("rec_id", "country")
    return held.select("rec_id", "country", F.lit("held").alias("kept")).union(_filled(rest, limit, seed, "country").select("rec_id", "country", F.lit("fill").alias("kept")))


def ghosts(roles: DataFrame, catalog: DataFrame) -> DataFrame:
    """References outside the catalog."""
    return roles.where("src = 1").join(catalog.select("rec_id"), "rec_id", "left_anti").select("rec_id")


def traffic_fill(catalog: DataFrame, records: DataFrame, truth: DataFrame, quotas: DataFrame, seed: str = "traffic", ghosts_too: bool = False) -> DataFrame:
    """(rec_id, src, country, kept): all targets that the catalog owns, then ownerless ones in hash order up to (country,
    src, quota). `ghosts_too`: targets of references outside the catalog are ownerless as well."""
    targets = records.where("src > 1").select("rec_id", "src", "country").join(truth.select(F.col("tgt_id").alias("rec_id"), "ref_id"), "rec_id", "left")
    owned = targets.join(catalog.select(F.col("rec_id").alias("ref_id")), "ref_id", "left_semi").select("rec_id", "src", "country").distinct()
    have = owned.groupBy("country", "src").agg(F.count(F.lit(1)).alias("have"))
    limit = quotas.join(have, ["country", "src"], "left").select("country", "src", F.greatest(F.col("quota") - F.coalesce("have", F.lit(0)), F.lit(0)).alias("room"))
    lone = targets.join(owned, "rec_id", "left_anti") if ghosts_too else targets.where("ref_id is null")
    fill = _filled(lone.select("rec_id", "src", "country").distinct(), limit, seed, "country", "src")
    return owned.withColumn("kept", F.lit("owned")).union(fill.select("rec_id", "src", "country", F.lit("fill").alias("kept")))


def cohort_traffic(roles: DataFrame, records: DataFrame, truth: DataFrame, role: str, density: DataFrame, seed: str = "cohort") -> DataFrame:
    """(rec_id, src, country, kept): targets of the cohort's role and those that its references own (`must`), then B targets
    up to density (country, per_ref) for each of its references, dealt to the sources in proportion to their B targets,
    what the division leaves to the first sources."""
    named = roles.join(records.select("rec_id", "country"), "rec_id")
    focal = named.where((F.col("src") == 1) & (F.col("role") == role))
    owned = truth.join(focal.select(F.col("rec_id").alias("ref_id")), "ref_id", "left_semi").select(F.col("tgt_id").alias("rec_id"))
    must = named.where((F.col("src") > 1) & (F.col("role") == role)).select("rec_id", "src", "country").union(named.where("src > 1").join(owned, "rec_id", "left_semi").select("rec_id", "src", "country")).distinct()
    wanted = focal.groupBy("country").agg(F.count(F.lit(1)).alias("refs")).join(density, "country").join(must.groupBy("country").agg(F.count(F.lit(1)).alias("have")), "country", "left")
    wanted = wanted.select("country", F.greatest(F.bround(F.col("per_ref") * F.col("refs")).cast("long") - F.coalesce("have", F.lit(0)), F.lit(0)).alias("need"))
    pool = named.where("src > 1 and role = 'B'").join(must, "rec_id", "left_anti").select("rec_id", "src", "country")
    by_country = Window.partitionBy("country")
    shares = pool.groupBy("country", "src").agg(F.count(F.lit(1)).alias("n")).join(wanted, "country")  # a row for each country and source
    shares = shares.withColumn("all", F.sum("n").over(by_country)).withColumn("part", F.expr("need * n div all"))
    left = F.col("need") - F.sum("part").over(by_country)
    limit = shares.select("country", "src", (F.col("part") + (F.row_number().over(by_country.orderBy("src")) <= left).cast("int")).alias("room"))
    fill = _filled(pool, limit, seed, "country", "src")
    return must.withColumn("kept", F.lit("must")).union(fill.select("rec_id", "src", "country", F.lit("fill").alias("kept")))


def environment(records: DataFrame, catalog: DataFrame, traffic: DataFrame) -> DataFrame:
    """The records of a catalog's references and a traffic's targets: what retrieval is run on."""
    return records.where("src = 1").join(catalog.select("rec_id"), "rec_id", "left_semi").unionByName(records.where("src > 1").join(traffic.select("rec_id"), "rec_id", "left_semi"))


def whole_environment(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, traffic) of everything, as a test without labels has it."""
    return records.where("src = 1").select("rec_id", "country", F.lit("held").alias("kept")), records.where("src > 1").select("rec_id", "src", "country", F.lit("owned").alias("kept"))


def dense_environment(roles: DataFrame, records: DataFrame, truth: DataFrame, quotas: DataFrame, density: DataFrame, scale: float = 1.0, held_roles: tuple[str, ...] | None = None, seed: str = "dense") -> tuple[DataFrame, DataFrame]:
    """(catalog, traffic): catalog up to scale * quota by country; then targets up to density (country, src, per_ref) for each
    of the catalog's references, those of ghosts among them."""
    catalog = catalog_fill(roles, records, quotas.select("country", F.bround(F.col("quota") * scale).cast("long").alias("quota")), f"{seed}-catalog", held_roles)
    refs = catalog.groupBy("country").agg(F.count(F.lit(1)).alias("refs"))
    room = density.join(refs, "country").select("country", "src", F.bround(F.col("per_ref") * F.col("refs")).cast("long").alias("quota"))
    return catalog, traffic_fill(catalog, records, truth, room, f"{seed}-traffic", ghosts_too=True)


def cohort_environment(roles: DataFrame, records: DataFrame, truth: DataFrame, role: str, quotas: DataFrame, density: DataFrame, seed: str = "cohort") -> tuple[DataFrame, DataFrame]:
    """(catalog, traffic) around the references of one role: F and B references fill the catalog, B targets the traffic."""
    catalog = catalog_fill(roles, records, quotas, f"{seed}-catalog", (role,), BACKGROUND)
    return catalog, cohort_traffic(roles, records, truth, role, density, f"{seed}-traffic")


def environment_report(catalog: DataFrame, traffic: DataFrame, truth: DataFrame) -> DataFrame:
    """(country, refs, targets, targets_per_ref, ownerless): ownerless is the share of targets without a reference in the catalog."""
    own = truth.join(catalog.select(F.col("rec_id").alias("ref_id")), "ref_id", "left_semi").select(F.col("tgt_id").alias("rec_id")).distinct().withColumn("own", F.lit(1))
    t = traffic.join(own, "rec_id", "left").groupBy("country").agg(F.count(F.lit(1)).alias("targets"), F.count("own").alias("own"))
    out = catalog.groupBy("country").agg(F.count(F.lit(1)).alias("refs")).join(t, "country", "left").na.fill(0, ["targets", "own"])
    return out.select("country", "refs", "targets", (F.col("targets") / F.col("refs")).alias("targets_per_ref"), F.when(F.col("targets") > 0, 1 - F.col("own") / F.col("targets")).otherwise(0.0).alias("ownerless"))


def density(records: DataFrame) -> DataFrame:
    """(country, refs, targets, density, density_s2, density_s3): targets for each reference."""
    n = lambda s: F.count_if(F.col("src") == s)
    refs = F.nullif(n(1), F.lit(0))
    return records.groupBy("country").agg(n(1).alias("refs"), (n(2) + n(3)).alias("targets"), ((n(2) + n(3)) / refs).alias("density"), (n(2) / refs).alias("density_s2"), (n(3) / refs).alias("density_s3"))
