"""The 50 features of a candidate pair, in their fixed order, as one wide projection over two records' views.

What depends on one record alone (words, numbers, skeletons) is made once a record by with_sets(), not once a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import contained, different, jaccard, jaro_winklers, length_ratio, levenshtein_ratio
from .text import GENERIC_WORDS, core_tokens, numbers, numeric_tokens, skeleton_token, skeletons_of, token_set

# The features' names, in order.
FEATURES = tuple(
    """
name_jw name_lev_norm name_tok_jaccard name_tok_overlap name_exact name_sorted_exact
name_sorted_jw name_len_ratio name_char_len_diff name_containment name_shared_df_weight name_target_indic
name_ref_indic addr_jw addr_lev_norm addr_tok_jaccard addr_exact addr_sorted_exact
addr_shared_numeric addr_numeric_jaccard addr_len_ratio addr_char_len_diff addr_target_missing addr_ref_missing
name_exact_addr_conflict name_exact_addr_missing fused_v rank margin_g is_name_top1
is_addr_top1 name_lane_score addr_lane_score pool_size joint_rank joint_score
source_s2 addr_num_jaccard_all addr_num_conflict addr_first_num_eq addr_num_symdiff name_fold_jw
addr_fold_jw name_core_jaccard name_core_exact name_core_missing_tokens name_skel_jaccard name_skel_jw
name_skel_core_jaccard addr_skel_jaccard
""".split()
)
#: What enrich() carries of either record.
VIEWS = ("name_norm", "addr_norm", "name_fold", "addr_fold", "name_indic", "addr_indic", "name_set", "addr_set", "name_core", "addr_num_set", "addr_nums", "name_skel", "addr_skel", "name_skel_core")


def with_sets(views: DataFrame) -> DataFrame:
    """Adds the sets and lists of a record's views that pair features compare."""
    dull = F.array(*[skeleton_token(F.lit(w)) for w in GENERIC_WORDS])
    skeleton = lambda f: F.array_sort(F.array_distinct(skeletons_of(F.array_distinct(F.split(f"{f}_latin", " ")))))
    out = views.withColumns({"name_set": F.array_sort(token_set(F.col("name_norm"))), "addr_set": F.array_sort(token_set(F.col("addr_norm"))), "name_core": core_tokens(F.col("name_norm")), "addr_num_set": numeric_tokens(F.col("addr_norm")), "addr_nums": numbers(F.col("addr_norm")), "name_skel": skeleton("name"), "addr_skel": skeleton("addr")})
    return out.withColumn("name_skel_core", F.array_except("name_skel", dull))


def shared_term_weight(edges: DataFrame, dfs: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(keys, name_weight): mean over shared name tokens of ln((N + 1)/(df + 1)) + 1; pairs without any are left out.

    edges come with name_set of both sides; dfs (country, field, term, df); n_docs (country, n_docs)."""
    keys = ["src", "tgt_id", "ref_id"]
    shared = edges.select(*keys, "country", F.explode(F.array_intersect("ref_name_set", "tgt_name_set")).alias("term"))
    known = shared.join(dfs.where("field = 'name'").select("country", "term", "df"), ["country", "term"], "left").join(F.broadcast(n_docs), "country", "left")  # n_docs: a row for each country
    return known.groupBy(*keys).agg(F.avg(F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("name_weight"))


def pair_features(with_weight: bool = True) -> dict[str, Column]:
    """The features by name, in order, over columns ref_VIEW, tgt_VIEW and the edge's own (and name_weight)."""
    two = lambda view: (F.col(f"ref_{view}"), F.col(f"tgt_{view}"))
    (rn, tn), (ra, ta), (rs, ts), (ras, tas) = two("name_norm"), two("addr_norm"), two("name_set"), two("addr_set")
    (rcore, tcore), (rnum, tnum), (rall, tall) = two("name_core"), two("addr_num_set"), two("addr_nums")
    (rsk, tsk), (rask, task), (rsc, tsc) = two("name_skel"), two("addr_skel"), two("name_skel_core")
    words = lambda c: F.array_join(c, " ")
    no_name, no_addr = (rn == "") | (tn == ""), (ra == "") | (ta == "")
    num = lambda c: c.cast("double")
    named = lambda c: F.when(no_name, 0.0).otherwise(c)
    placed = lambda c: F.when(no_addr, 0.0).otherwise(c)
    same = lambda a, b: different(a, b) == 0
    seen = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("double")
    jw = jaro_winklers((rn, tn), (words(rs), words(ts)), (ra, ta), two("name_fold"), two("addr_fold"), (words(rsk), words(tsk)))
    jw = {k: F.get(jw, F.lit(i)) for i, k in enumerate(("name", "sorted", "addr", "name_fold", "addr_fold", "skeleton"))}
    both_numbers = (F.size(rall) > 0) & (F.size(tall) > 0)
    rset, tset = F.array_distinct(rall), F.array_distinct(tall)
    return {
        "name_jw": named(jw["name"]),
        "name_lev_norm": named(levenshtein_ratio(rn, tn)),
        "name_tok_jaccard": jaccard(rs, ts),
        "name_tok_overlap": num(F.size(F.array_intersect(rs, ts))),
        "name_exact": num(rn == tn),
        "name_sorted_exact": num(rs == ts),
        "name_sorted_jw": jw["sorted"],
        "name_len_ratio": length_ratio(rn, tn),
        "name_char_len_diff": num(F.abs(F.length(rn) - F.length(tn))),
        "name_containment": num(contained(rs, ts)),
        "name_shared_df_weight": seen("name_weight") if with_weight else F.lit(0.0),
        "name_target_indic": num(F.col("tgt_name_indic")),
        "name_ref_indic": num(F.col("ref_name_indic")),
        "addr_jw": placed(jw["addr"]),
        "addr_lev_norm": placed(levenshtein_ratio(ra, ta)),
        "addr_tok_jaccard": jaccard(ras, tas),
        "addr_exact": num((ra == ta) & ~no_addr),
        "addr_sorted_exact": num((ras == tas) & ~no_addr),
        "addr_shared_numeric": num(F.size(F.array_intersect(rnum, tnum))),
        "addr_numeric_jaccard": jaccard(rnum, tnum),
        "addr_len_ratio": length_ratio(ra, ta),
        "addr_char_len_diff": num(F.abs(F.length(ra) - F.length(ta))),
        "addr_target_missing": num(ta == ""),
        "addr_ref_missing": num(ra == ""),
        "name_exact_addr_conflict": num((rn == tn) & ~no_addr & (jaccard(ras, tas) == 0)),
        "name_exact_addr_missing": num((rn == tn) & no_addr),
        "fused_v": seen("v"),
        "rank": seen("name_rank"),
        "margin_g": seen("margin"),
        "is_name_top1": num(F.col("name_rank") == 1),
        "is_addr_top1": num(F.col("addr_rank") == 1),
        "name_lane_score": seen("name_score"),
        "addr_lane_score": seen("addr_score"),
        "pool_size": seen("pool_size"),
        "joint_rank": seen("joint_rank"),
        "joint_score": seen("joint_score"),
        "source_s2": num(F.col("src") == 2),
        "addr_num_jaccard_all": jaccard(rset, tset),
        "addr_num_conflict": num(both_numbers & (F.size(F.array_intersect(rset, tset)) == 0)),
        "addr_first_num_eq": F.when(~both_numbers, -1.0).otherwise(num(F.get(rall, F.lit(0)) == F.get(tall, F.lit(0)))),
        "addr_num_symdiff": num(different(rset, tset)),
        "name_fold_jw": named(jw["name_fold"]),
        "addr_fold_jw": placed(jw["addr_fold"]),
        "name_core_jaccard": jaccard(rcore, tcore),
        "name_core_exact": num(same(rcore, tcore) & (F.size(rcore) > 0)),
        "name_core_missing_tokens": num(different(rcore, tcore)),
        "name_skel_jaccard": jaccard(rsk, tsk),
        "name_skel_jw": jw["skeleton"],
        "name_skel_core_jaccard": jaccard(rsc, tsc),
        "addr_skel_jaccard": placed(jaccard(rask, task)),
    }


def enrich(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Edges with the views of both sides and the target's country."""
    side = lambda p, *keys: records.select(*keys, *[F.col(v).alias(f"{p}_{v}") for v in VIEWS])
    own = edges.drop("country")
    return own.join(side("tgt", "src", F.col("rec_id").alias("tgt_id"), "country"), ["src", "tgt_id"]).join(side("ref", F.col("rec_id").alias("ref_id")), "ref_id")


def feature_rows(edges: DataFrame, records: DataFrame, dfs: DataFrame, stats: DataFrame) -> DataFrame:
    """(src, tgt_id, ref_id, country, the features) of edges; dfs and stats as the index has them."""
    full = enrich(edges, records)
    weight = shared_term_weight(full, dfs, stats.where("field = 'name'").select("country", "n_docs"))
    full = full.join(weight, ["src", "tgt_id", "ref_id"], "left")
    return full.select("src", "tgt_id", "ref_id", "country", *[c.alias(n) for n, c in pair_features().items()])
