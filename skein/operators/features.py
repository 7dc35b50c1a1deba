"""The 63 features of a candidate pair. Undefined is null, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import strings as S
from ..functions.tables import LEGAL_TOKENS
from .tables import kept

FEATURE_GROUPS = {
    "stage1": ["sparse_score", "sparse_rank", "sparse_name_score", "sparse_name_rank", "dense_rank", "n_channels", "cand_is_s3", "same_country"],
    "name": ["name_lev", "name_jw", "name_tsort", "name_tset", "name_partial", "name_jacc", "name_wjacc", "name_lcsub", "name_exact", "core_lev", "core_tset", "core_jacc", "core_exact", "core_contained", "legal_match", "name_abbrev_sim", "acronym_match", "name_first_tok", "name_ntok_diff", "name_len_ratio", "name_num_match"],
    "address": ["addr_lev", "addr_tsort", "addr_tset", "addr_partial", "addr_jacc", "addr_wjacc", "addr_contain", "addr_lcsub", "addr_num_jacc", "addr_num_overlap", "addr_num_conflict", "addr_first_num", "addr_last_num", "addr_comp_jacc", "addr_tail_jacc", "addr_missing_s1", "addr_missing_cand", "addr_len_ratio"],
    "tfidf": ["full_tfidf_cos", "name_tfidf_cos"],
    "dense": ["bge_m3_cos"],
    "structure": ["grp_n_cands", "grp_n_same_src", "grp_rank_tfidf", "grp_gap_tfidf", "grp_rank_bge", "grp_gap_bge", "grp_rank_name", "grp_gap_name", "grp_margin_tfidf", "sim_to_top1", "cand_n_s1", "cand_rank_s1", "cand_gap_s1"],
}
FEATURES = [f for group in FEATURE_GROUPS.values() for f in group]
DENSE_DERIVED = ("bge_m3_cos", "dense_rank", "grp_rank_bge", "grp_gap_bge")


#: Features that compare two texts in Python: the comparison and the texts.
COMPARED = {
    "name_lev": ("levenshtein", "name"), "name_jw": ("jaro_winkler", "name"), "name_tsort": ("token_sort", "name"), "name_tset": ("token_set", "name"), "name_partial": ("partial", "name"), "name_lcsub": ("common_substring", "name"),
    "core_lev": ("levenshtein", "core"), "core_tset": ("token_set", "core"), "name_abbrev_sim": ("abbreviation", "core"),
    "addr_lev": ("levenshtein", "addr"), "addr_tsort": ("token_sort", "addr"), "addr_tset": ("token_set", "addr"), "addr_partial": ("partial", "addr"), "addr_lcsub": ("common_substring", "addr"),
}


def levenshtein_similarity(a: Column, b: Column, distance: Column) -> Column:
    return F.coalesce(1 - distance / F.nullif(F.greatest(F.length(a), F.length(b)), F.lit(0)), F.lit(1.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def length_ratio(a: Column, b: Column) -> Column:
    return F.when((a != "") & (b != ""), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def text_features(a: str = "a", b: str = "b", compare=None) -> dict[str, Column]:
    """Features of the texts alone, from columns <side>_name, _core, _addr, _comps. compare: the column of a comparison of COMPARED; UDFs if None."""
    compare = compare or (lambda name, x: getattr(S, name)(F.col(f"{a}_{x}"), F.col(f"{b}_{x}")))
    of = {f: compare(*how) for f, how in COMPARED.items()}
    n1, n2, c1, c2, d1, d2 = (F.col(f"{s}_{x}") for x in ("name", "core", "addr") for s in (a, b))
    tn1, tn2, tc1, tc2, td1, td2 = map(N.words, (n1, n2, c1, c2, d1, d2))
    m1, m2, u1, u2 = map(N.numbers, (n1, n2, d1, d2))
    p1, p2 = F.col(f"{a}_comps"), F.col(f"{b}_comps")
    legal = F.array(*map(F.lit, LEGAL_TOKENS))
    l1, l2 = (F.array_sort(F.array_intersect(t, legal)) for t in (tn1, tn2))
    both = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0)
    tail = lambda c: N.words(F.array_join(F.slice(c, F.greatest(F.size(c) - 1, F.lit(1)), F.lit(2)), " "))
    last = lambda u: F.try_element_at(F.filter(u, lambda x: F.length(x) >= 4), F.lit(-1))
    shared = F.size(F.array_intersect(u1, u2))
    return {
        "name_lev": levenshtein_similarity(n1, n2, of["name_lev"]), "name_jw": of["name_jw"], "name_tsort": of["name_tsort"], "name_tset": of["name_tset"], "name_partial": of["name_partial"],
        "name_jacc": jaccard(tn1, tn2), "name_lcsub": of["name_lcsub"], "name_exact": _flag((n1 == n2) & (n1 != "")),
        "core_lev": levenshtein_similarity(c1, c2, of["core_lev"]), "core_tset": of["core_tset"], "core_jacc": jaccard(tc1, tc2), "core_exact": _flag((c1 == c2) & (c1 != "")),
        "core_contained": _flag((c1 != "") & (c2 != "") & (F.contains(c1, c2) | F.contains(c2, c1))), "legal_match": F.when(both(l1, l2), (l1 == l2).cast("double")),
        "name_abbrev_sim": of["name_abbrev_sim"], "acronym_match": S.initialism(c1, c2), "name_first_tok": _flag(F.get(tc1, F.lit(0)) == F.get(tc2, F.lit(0))),
        "name_ntok_diff": F.abs(F.size(tn1) - F.size(tn2)).cast("double"), "name_len_ratio": length_ratio(n1, n2), "name_num_match": F.when(both(m1, m2), F.arrays_overlap(m1, m2).cast("double")),
        "addr_lev": levenshtein_similarity(d1, d2, of["addr_lev"]), "addr_tsort": of["addr_tsort"], "addr_tset": of["addr_tset"], "addr_partial": of["addr_partial"], "addr_jacc": jaccard(td1, td2),
        "addr_contain": F.when(both(td1, td2), F.size(F.array_intersect(td1, td2)) / F.least(F.size(F.array_distinct(td1)), F.size(F.array_distinct(td2)))), "addr_lcsub": of["addr_lcsub"],
        "addr_num_jacc": F.when(both(u1, u2), jaccard(u1, u2)), "addr_num_overlap": F.when(both(u1, u2), shared.cast("double")), "addr_num_conflict": F.when(both(u1, u2), (shared == 0).cast("double")),
        "addr_first_num": F.when(both(u1, u2), (F.get(u1, F.lit(0)) == F.get(u2, F.lit(0))).cast("double")), "addr_last_num": F.when(both(u1, u2), (last(u1) == last(u2)).cast("double")),
        "addr_comp_jacc": F.when(both(p1, p2), jaccard(p1, p2)), "addr_tail_jacc": F.when(both(p1, p2), jaccard(tail(p1), tail(p2))),
        "addr_missing_s1": (d1 == "").cast("double"), "addr_missing_cand": (d2 == "").cast("double"), "addr_len_ratio": length_ratio(d1, d2),
    }


def weighted_jaccard(pairs: DataFrame, a: str, b: str, idf: DataFrame, out: str) -> DataFrame:
    """pairs (q, p and the two texts) with out: IDF of shared tokens by IDF of all tokens of both, null if there is none."""
    toks = lambda c: F.array_distinct(N.words(F.col(c)))
    t = pairs.select("q", "p", toks(a).alias("_a"), toks(b).alias("_b")).select("q", "p", "_a", "_b", F.explode(F.array_union("_a", "_b")).alias("token"))
    t = t.select("q", "p", "token", (F.array_contains("_a", F.col("token")) & F.array_contains("_b", F.col("token"))).alias("both")).join(idf.select("token", "idf"), "token", "left")
    # tokens come from the texts that were counted; one that was not has the weight of a token met nowhere
    default = idf.agg(F.max("default_idf").alias("d"))
    t = t.crossJoin(F.broadcast(default)).withColumn("w", F.coalesce("idf", "d"))
    share = t.groupBy("q", "p").agg(F.round(F.sum(F.when(F.col("both"), F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias(out))
    return pairs.join(share, ["q", "p"], "left")


def word_weights(records: DataFrame, text: str, idf: DataFrame, out: str) -> DataFrame:
    """(entity_id, out): the IDF of each distinct word of a record's text, in their order. Every word is one that was counted."""
    words = records.select("entity_id", F.posexplode(F.array_distinct(N.words(F.col(text)))).alias("place", "token"))
    each = words.join(idf.select("token", "idf"), "token").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("place", "idf"))).alias("w"))
    return each.select("entity_id", F.col("w.idf").alias(out))


def rank_and_gap(key: str, col: str, rank: str, gap: str) -> dict[str, Column]:
    """Rank (lowest of ties, best first) and distance to the best within a key; null values have neither."""
    w = W.partitionBy(key)
    return {rank: F.when(F.col(col).isNotNull(), F.rank().over(w.orderBy(F.col(col).desc_nulls_last())).cast("double")), gap: F.max(col).over(w) - F.col(col)}


def structure(pairs: DataFrame) -> DataFrame:
    """pairs (q, p, source, full_tfidf_cos, bge_m3_cos, name_tset) with context among the candidates of q, and of the queries of p."""
    by_q, by_p = W.partitionBy("q"), W.partitionBy("p")
    d = pairs.withColumn("_t", F.coalesce("full_tfidf_cos", F.lit(0.0)))
    whole = by_q.orderBy(F.col("_t").desc(), "p").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = d.withColumns(
        {"grp_n_cands": F.count("*").over(by_q).cast("double"), "grp_n_same_src": F.count("*").over(W.partitionBy("q", "source")).cast("double"), "cand_n_s1": F.count("*").over(by_p).cast("double")}
        | rank_and_gap("q", "_t", "grp_rank_tfidf", "grp_gap_tfidf")
        | rank_and_gap("q", "bge_m3_cos", "grp_rank_bge", "grp_gap_bge")
        | rank_and_gap("q", "name_tset", "grp_rank_name", "grp_gap_name")
        | rank_and_gap("p", "_t", "cand_rank_s1", "cand_gap_s1")
        | {"grp_margin_tfidf": F.max("_t").over(by_q) - F.coalesce(F.nth_value("_t", 2).over(whole), F.lit(0.0)), "top_p": F.first("p").over(whole)}
    )
    return d.drop("_t")


def build(pairs: DataFrame, records: DataFrame, full: tuple[DataFrame, DataFrame], name: tuple[DataFrame, DataFrame], embeddings: DataFrame | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """(q, p, FEATURES...) of pairs (q, p, source, <ch>_score, <ch>_rank); with only, just those of its features, and of the groups that they
    do not need nothing is computed.

    records: entity_id, ckey, name, addr, comps. full, name: texts (entity_id, text) and weights (part, gram, idf) for all countries.
    embeddings: entity_id, embedding. Raises if a pair names an unknown record.
    """
    from .dense import pair_cosine as dense_cosine
    from .tfidf import text_cosine, token_idf

    wanted = [f for f in FEATURES if only is None or f in only]
    named = lambda *some: any(f in wanted for f in some)
    cosine = lambda d, left, right, of, out: text_cosine(d, left, right, of[0], "text", of[1], out)
    of_text = text_features(compare=lambda name, x: F.col(f"_{name}_{x}"))
    of_text = {f: c for f, c in of_text.items() if f in wanted or f == "name_tset" and named("grp_rank_name", "grp_gap_name")}
    known = records.select("entity_id")
    unknown = pairs.select(F.explode(F.array("q", "p")).alias("entity_id")).join(known, "entity_id", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("pairs name records that are not there")
    have = lambda c: F.col(c) if c in pairs.columns else F.lit(None)
    ranks = [c for c in pairs.columns if c.endswith("_rank")]
    # every group of features is a table of its own by (q, p), made from the pairs and not from one another; what several need is written
    # once, so that no plan holds more than one group
    pairs = kept(pairs)
    weighted = [x for x in ("name", "addr") if named(f"{x}_wjacc")]
    sides = records
    if weighted:
        used = kept(pairs.select(F.explode(F.array("q", "p")).alias("entity_id")).distinct().join(records.select("entity_id", *weighted), "entity_id"))
        for x in weighted:
            sides = sides.join(word_weights(used, x, token_idf(used, x), f"{x}_w"), "entity_id", "left")
        sides = kept(sides)
    own = {"ckey": F.col("ckey"), "name": F.col("name"), "addr": F.col("addr")} | {f"{x}_w": F.col(f"{x}_w") for x in weighted}
    if named("core_lev", "core_tset", "core_jacc", "core_exact", "core_contained", "name_abbrev_sim", "acronym_match", "name_first_tok"):
        own["core"] = N.core_name(F.col("name"))
    if named("addr_comp_jacc", "addr_tail_jacc"):
        own["comps"] = F.col("comps")
    side = lambda s, key: sides.select(F.col("entity_id").alias(key), *[c.alias(f"{s}_{x}") for x, c in own.items()])
    base = pairs.join(side("a", "q"), "q").join(side("b", "p"), "p")
    base = S.compared(base, list(dict.fromkeys(COMPARED[f] for f in of_text if f in COMPARED)), weighted)
    of_text |= {f"{x}_wjacc": F.col(f"_weighted_{x}") for x in weighted}
    stage1 = {c: have(c).cast("double") for c in ("sparse_score", "sparse_name_score")} | {c: F.nullif(have(c).cast("double"), F.lit(0.0)) for c in ("sparse_rank", "sparse_name_rank", "dense_rank")}
    stage1 |= {"n_channels": sum(((F.coalesce(F.col(c), F.lit(0)) > 0).cast("double") for c in ranks), F.lit(0.0)), "cand_is_s3": (F.col("source") == "S3").cast("double"), "same_country": (F.col("a_ckey") == F.col("b_ckey")).cast("double")}
    d = kept(base.select("q", "p", "source", F.col("a_ckey").alias("part"), "b_ckey", *[c.alias(n) for n, c in (stage1 | of_text).items()]))
    placed, d = d.select("q", "p", "part", "b_ckey"), d.drop("part", "b_ckey")
    cosines = kept(cosine(placed, "q", "p", full, "full_tfidf_cos").select("q", "p", "b_ckey", "full_tfidf_cos"))
    d = d.join(cosines.drop("b_ckey"), ["q", "p"])
    if named("name_tfidf_cos"):
        d = d.join(cosine(placed, "q", "p", name, "name_tfidf_cos").select("q", "p", "name_tfidf_cos"), ["q", "p"])
    by_vector = embeddings is not None and named("bge_m3_cos", "grp_rank_bge", "grp_gap_bge")
    d = dense_cosine(d, "q", "p", embeddings, "bge_m3_cos") if by_vector else d.withColumn("bge_m3_cos", F.lit(None).cast("double"))
    d = d if "name_tset" in of_text else d.withColumn("name_tset", F.lit(None).cast("double"))
    d = structure(kept(d))
    if named("sim_to_top1"):
        first = W.partitionBy("q").orderBy(F.coalesce("full_tfidf_cos", F.lit(0.0)).desc(), "p").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        tops = kept(cosines.select("q", "p", F.col("b_ckey").alias("part"), F.first("p").over(first).alias("top_p")))
        to_top = cosine(tops, "p", "top_p", full, "sim_to_top1").select("q", "p", F.when(F.col("p") != F.col("top_p"), F.col("sim_to_top1")).alias("sim_to_top1"))
        d = d.join(to_top, ["q", "p"])
    return d.select("q", "p", *wanted)
