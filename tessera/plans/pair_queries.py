"""Queries over candidate pairs: features, scores, decisions, evaluation, audits."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import similarity as sim
from tessera.operators import blocking as blk
from tessera.operators import decision as dec
from tessera.operators import evaluation as ev
from tessera.operators import features as feat
from tessera.operators import learning
from tessera.operators import sampling as smp
from tessera.operators import stats
from tessera.plans.er_queries import CAND, COUNTS, F05, FEATURES, KEYS, POLICY, candidate_pairs, keys, labelled, query, r6, scored_pairs, sides, table, universe
from tessera.sources.records import read_truth_tsv, write_tsv
from tessera.sources.scratch import kept

# --- features ---------------------------------------------------------------------------


def pair_rows(spark, sf_dir):
    return candidate_pairs(spark, sf_dir, carry=feat.KEYS)


def _columns(rows: DataFrame, names: list[str]) -> DataFrame:
    kinds = dict(rows.dtypes)
    return rows.select("s1", "mid", *(r6(c, c) if kinds[c] == "double" else c for c in names))


@query(
    FEATURES
    + """ SELECT s1, mid, (provenance & 1) <> 0 AS retrieved_sorted_name, (provenance & 2) <> 0 AS retrieved_exact_address, (provenance & 4) <> 0 AS retrieved_name_token, (provenance & 8) <> 0 AS retrieved_address_token,
    passes::BIGINT AS retrieval_pass_count, substr(mid, 1, 3) = 'S2-' AS target_is_s2, substr(mid, 1, 3) = 'S3-' AS target_is_s3 FROM f"""
)
def pair_features_provenance(spark, sf_dir):
    rows = feat.provenance_features(pair_rows(spark, sf_dir)[2])
    return _columns(rows, ["retrieved_sorted_name", "retrieved_exact_address", "retrieved_name_token", "retrieved_address_token", "retrieval_pass_count", "target_is_s2", "target_is_s3"])


@query(
    FEATURES
    + """ SELECT s1, mid, an <> '' AND an = bn AS exact_name_norm, ao <> '' AND ao = bo AS exact_name_sorted, aa <> '' AND aa = ba AS exact_address_norm, ax <> '' AND ax = bx AS exact_name_nosuffix,
    len(ar) > 0 AND list_sort(list_distinct(ar)) = list_sort(list_distinct(br)) AS exact_numeric_set, ap <> '' AND ap = bp AS exact_postal_token, ac <> '' AND ac = bc AS country_agreement FROM f"""
)
def pair_features_exact(spark, sf_dir):
    return _columns(feat.exact_features(pair_rows(spark, sf_dir)[2]), feat.GROUPS["exact"])


@query(
    FEATURES
    + """ SELECT s1, mid, length(an) = 0 AS s1_name_missing, length(bn) = 0 AS target_name_missing, length(aa) = 0 AS s1_address_missing, length(ba) = 0 AS target_address_missing,
    length(an) AS s1_name_chars, length(bn) AS target_name_chars, length(aa) AS s1_address_chars, length(ba) AS target_address_chars,
    len(aw) AS s1_name_tokens, len(bw) AS target_name_tokens, len(av) AS s1_address_tokens, len(bv) AS target_address_tokens,
    abs(length(an) - length(bn)) AS name_char_abs_diff, abs(length(aa) - length(ba)) AS address_char_abs_diff,
    round(abs(length(an) - length(bn))::DOUBLE / greatest(length(an), length(bn), 1), 6) AS name_char_relative_diff, round(abs(length(aa) - length(ba))::DOUBLE / greatest(length(aa), length(ba), 1), 6) AS address_char_relative_diff FROM f"""
)
def pair_features_length(spark, sf_dir):
    return _columns(feat.length_features(pair_rows(spark, sf_dir)[2]), feat.GROUPS["length"])


_TOKENS = [c for c in feat.GROUPS["token"] if not c.endswith("shared_idf")]


def _token_sql(prefix: str, n: str, u: str, a: str, b: str) -> str:
    return f"""{n} AS {prefix}_token_intersection, {u} AS {prefix}_token_union, round(CASE WHEN {u} > 0 THEN {n}::DOUBLE / {u} ELSE 0 END, 6) AS {prefix}_jaccard,
    round({n}::DOUBLE / greatest(len({a}), 1), 6) AS {prefix}_containment_s1, round({n}::DOUBLE / greatest(len({b}), 1), 6) AS {prefix}_containment_target"""


@query(FEATURES + f" SELECT s1, mid, {_token_sql('name', 'nin', 'nun', 'aw', 'bw')}, {_token_sql('address', 'ain', 'aun', 'av', 'bv')} FROM f")
def pair_features_token(spark, sf_dir):
    return _columns(feat.token_features(pair_rows(spark, sf_dir)[2]), _TOKENS)


@query(
    FEATURES
    + """ SELECT s1, mid, len(list_intersect(list_distinct(ar), list_distinct(br))) AS shared_address_numbers, len(ar) > 0 AND len(br) > 0 AND list_sort(list_distinct(ar)) <> list_sort(list_distinct(br)) AS conflicting_address_numbers,
    (ap <> '' AND ap = bp)::BIGINT AS shared_postal_tokens, ap <> '' AND bp <> '' AND ap <> bp AS conflicting_postal_tokens, len(ar) > 0 AND ar = br AS digit_sequence_equal, len(ar) > 0 AND len(br) > 0 AND coalesce(ar[1] = br[1], false) AS house_number_equal FROM f"""
)
def pair_features_numeric(spark, sf_dir):
    return _columns(feat.numeric_features(pair_rows(spark, sf_dir)[2]), feat.GROUPS["numeric"])


@query(
    FEATURES
    + """, z AS (SELECT s1, mid, CASE WHEN regexp_matches(an, '[a-z]') THEN 1 ELSE 0 END::BIGINT AS x, CASE WHEN regexp_matches(bn, '[a-z]') THEN 1 ELSE 0 END::BIGINT AS w FROM f)
    SELECT s1, mid, x AS s1_script_class, w AS target_script_class, x > 0 AND x = w AS same_script_class, x > 0 AND w > 0 AND x <> w AS script_conflict FROM z"""
)
def pair_features_script(spark, sf_dir):
    return _columns(feat.script_features(pair_rows(spark, sf_dir)[2]), feat.GROUPS["script"])


@query()
def pair_features_fuzzy(spark, sf_dir):
    return _columns(feat.fuzzy_features(pair_rows(spark, sf_dir)[2]), feat.GROUPS["fuzzy"])


@query()
def pair_features_all(spark, sf_dir):
    s1, t, cand = candidate_pairs(spark, sf_dir)
    return feat.all_features(cand, s1, t)


@query()
def pair_features_name_fuzzy(spark, sf_dir):
    rows = feat.romanized_features(feat.name_fuzzy_features(pair_rows(spark, sf_dir)[2]))
    return _columns(rows, ["name_wratio", "name_jaro", "name_compact_ratio", "translit_ratio", "translit_token_ratio", "translit_ng3"])


def _gram_sql(f: str, n: int) -> str:
    return f"(CASE WHEN length({f}) >= {n} THEN list_distinct(list_transform(range(1, length({f}) - {n - 2}), lambda i: substr({f}, i, {n}))) ELSE [] END)"


def _jaccard_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_concat({a}, {b})) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END)"


def _lev_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {a} <> '' AND {b} <> '' THEN 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) ELSE 0 END)"


_INITIALS = "array_to_string(list_transform(list_filter(string_split({0}, ' '), lambda x: length(x) > 0), lambda x: x[1]), '')"


@query(
    FEATURES
    + f""", h AS (SELECT s1, mid, an, bn, replace(an, ' ', '') AS x, replace(bn, ' ', '') AS w, {_INITIALS.format("an")} AS ia, {_INITIALS.format("bn")} AS ib, (an <> '' AND bn <> '') AS ok FROM f)
    SELECT s1, mid, {", ".join(f"round(CASE WHEN ok THEN {_jaccard_sql(_gram_sql('an', n), _gram_sql('bn', n))} ELSE 0 END, 6) AS name_ng{n}" for n in (2, 3, 4))}, round({_lev_sql("an", "bn")}, 6) AS name_levenshtein,
    (ok AND (ia = ib OR x = ib OR w = ia))::INT::DOUBLE AS initial_compat, (ok AND (starts_with(x, w) OR starts_with(w, x)))::INT::DOUBLE AS prefix_compat, (ok AND (ends_with(x, w) OR ends_with(w, x)))::INT::DOUBLE AS suffix_compat FROM h"""
)
def pair_features_name(spark, sf_dir):
    return _columns(feat.name_features(pair_rows(spark, sf_dir)[2]), ["name_ng2", "name_ng3", "name_ng4", "name_levenshtein", "initial_compat", "prefix_compat", "suffix_compat"])


@query(
    FEATURES
    + f""", h AS (SELECT *, list_filter(av, lambda x: NOT regexp_matches(x, '[0-9]')) AS lw, list_filter(bv, lambda x: NOT regexp_matches(x, '[0-9]')) AS rw, (aa <> '' AND ba <> '') AS ok FROM f)
    SELECT s1, mid, (NOT ok)::INT::DOUBLE AS addr_missing, (ok AND least(len(lw), len(rw)) < 2)::INT::DOUBLE AS addr_weak, round(CASE WHEN ok THEN {_jaccard_sql(_gram_sql('aa', 3), _gram_sql('ba', 3))} ELSE 0 END, 6) AS addr_ng3,
    round({_lev_sql("aa", "ba")}, 6) AS addr_levenshtein, round({_jaccard_sql("lw", "rw")}, 6) AS addr_locality_jaccard, round({_jaccard_sql("list_distinct(ar)", "list_distinct(br)")}, 6) AS number_jaccard,
    coalesce(len(ar) > 0 AND len(br) > 0 AND ar[1] <> br[1], false)::INT::DOUBLE AS house_conflict_v2, (len(list_intersect(list_filter(ar, lambda x: length(x) IN (5, 6)), list_filter(br, lambda x: length(x) IN (5, 6)))) > 0)::INT::DOUBLE AS postal_equal_v2,
    (len(list_intersect(list_filter(ar, lambda x: length(x) >= 9), list_filter(br, lambda x: length(x) >= 9))) > 0)::INT::DOUBLE AS phone_equal_v2 FROM h"""
)
def pair_features_address(spark, sf_dir):
    return _columns(feat.address_features(pair_rows(spark, sf_dir)[2]), ["addr_missing", "addr_weak", "addr_ng3", "addr_levenshtein", "addr_locality_jaccard", "number_jaccard", "house_conflict_v2", "postal_equal_v2", "phone_equal_v2"])


@query(FEATURES + f" SELECT s1, mid, round({_lev_sql('an', 'bn')}, 6) AS name_levenshtein, round({_lev_sql('aa', 'ba')}, 6) AS address_levenshtein FROM f")
def levenshtein_sim(spark, sf_dir):
    rows = pair_rows(spark, sf_dir)[2]

    def one(a, b):
        return F.when((F.col(a) != "") & (F.col(b) != ""), sim.levenshtein_similarity(F.col(a), F.col(b))).otherwise(0.0)

    return rows.select("s1", "mid", r6(one("a_name_norm", "b_name_norm"), "name_levenshtein"), r6(one("a_addr_norm", "b_addr_norm"), "address_levenshtein"))


@query(FEATURES + " SELECT s1, mid, round(jaro_winkler_similarity(an, bn), 6) AS name_jaro_winkler, round(jaro_winkler_similarity(aa, ba), 6) AS address_jaro_winkler FROM f")
def jaro_winkler_sim(spark, sf_dir):
    rows = pair_rows(spark, sf_dir)[2]
    return rows.select("s1", "mid", r6(sim.jaro_winkler_similarity("a_name_norm", "b_name_norm"), "name_jaro_winkler"), r6(sim.jaro_winkler_similarity("a_addr_norm", "b_addr_norm"), "address_jaro_winkler"))


@query(
    FEATURES
    + """, tk AS (SELECT s1, mid, ac AS cc, aw, bw, unnest(list_distinct(list_concat(aw, bw))) AS tok FROM f), tn AS (SELECT count(*)::DOUBLE AS n FROM t),
    wt AS (SELECT tk.*, coalesce(ln(1 + tn.n / d.df), 1.0) AS w FROM tk CROSS JOIN tn LEFT JOIN ndf d ON tk.cc = d.cc AND tk.tok = d.tok)
    SELECT f.s1, f.mid, round(coalesce(x.v, 0.0), 6) AS name_weighted_jaccard FROM f LEFT JOIN (SELECT s1, mid, sum(CASE WHEN list_contains(aw, tok) AND list_contains(bw, tok) THEN w ELSE 0.0 END) / sum(w) AS v FROM wt GROUP BY s1, mid) x ON f.s1 = x.s1 AND f.mid = x.mid"""
)
def weighted_jaccard(spark, sf_dir):
    s1, t, rows = pair_rows(spark, sf_dir)
    out = feat.weighted_jaccard(rows, blk.token_df(t, "name_nosuffix"), t.count(), "name_nosuffix", "name_weighted_jaccard")
    return out.select("s1", "mid", r6("name_weighted_jaccard", "name_weighted_jaccard"))


_CONTEXT = """, cx AS (SELECT s1, mid, score, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, mid) AS n, count(*) OVER (PARTITION BY s1) AS candidate_count, count(*) OVER (PARTITION BY s1, substr(mid, 1, 2)) AS source_candidate_count,
  max(score) OVER (PARTITION BY s1) AS top_score, max(score) OVER (PARTITION BY s1, substr(mid, 1, 2)) AS source_top, sum(score) OVER (PARTITION BY s1) AS total, sum((score >= 0.8)::INT) OVER (PARTITION BY s1) AS high_count, sum((score >= 0.7)::INT) OVER (PARTITION BY s1) AS current_high_count FROM sc),
cy AS (SELECT *, coalesce(max(CASE WHEN n = 2 THEN score END) OVER (PARTITION BY s1), 0.0) AS second_score FROM cx)"""


@query(FEATURES + _CONTEXT + " SELECT s1, mid, score, candidate_count, source_candidate_count, top_score, second_score, round(top_score - second_score, 6) AS score_gap, high_count::BIGINT AS high_count, round(score - top_score, 6) AS relative_to_top FROM cy")
def entity_context(spark, sf_dir):
    scored = scored_pairs(spark, sf_dir)[2].select("s1", "mid", "score")
    return feat.entity_context(scored).withColumns({c: F.round(c, 6) for c in ("score_gap", "relative_to_top")})


@query(
    FEATURES
    + _CONTEXT
    + """ SELECT s1, mid, score, top_score AS current_top, second_score AS current_second, round(top_score - second_score, 6) AS current_gap, round(score - top_score, 6) AS current_relative, round(total, 6) AS current_sum,
    current_high_count::BIGINT AS current_high_count, source_top AS current_source_top, round(score - source_top, 6) AS current_source_relative FROM cy"""
)
def residual_context(spark, sf_dir):
    scored = scored_pairs(spark, sf_dir)[2].select("s1", "mid", "score")
    return dec.residual_context(scored).withColumns({c: F.round(c, 6) for c in ("current_gap", "current_relative", "current_sum", "current_source_relative")})


@query(
    FEATURES
    + f""", an0 AS (SELECT s1, mid AS anchor, score AS anchor_score FROM (SELECT s1, mid, score, row_number() OVER (PARTITION BY s1, substr(mid, 1, 2) ORDER BY score DESC, mid) AS n FROM sc WHERE score >= 0.61) WHERE n <= 2),
    cr AS (SELECT sc.s1, sc.mid, {_lev_sql("x.name_norm", "w.name_norm")} AS n, {_lev_sql("x.addr_norm", "w.addr_norm")} AS a, {_jaccard_sql("list_distinct(regexp_extract_all(x.addr_norm, '[0-9]+'))", "list_distinct(regexp_extract_all(w.addr_norm, '[0-9]+'))")} AS d, anchor_score
      FROM sc JOIN t x ON sc.mid = x.mid JOIN an0 ON sc.s1 = an0.s1 JOIN t w ON an0.anchor = w.mid WHERE substr(sc.mid, 1, 2) <> substr(an0.anchor, 1, 2))
    SELECT sc.s1, sc.mid, round(coalesce(max(n), 0.0), 6) AS cross_name, round(coalesce(max(a), 0.0), 6) AS cross_address, round(coalesce(max(d), 0.0), 6) AS cross_numeric, round(coalesce(max(least(n, a) * anchor_score), 0.0), 6) AS cross_joint,
    round(coalesce(max(n), 0.0), 6) AS cross_translit, coalesce(sum((n >= 0.8 AND (a >= 0.6 OR n >= 0.9))::INT), 0)::BIGINT AS cross_support_count, coalesce(max(anchor_score), 0.0) AS cross_seed_score FROM sc LEFT JOIN cr ON sc.s1 = cr.s1 AND sc.mid = cr.mid GROUP BY sc.s1, sc.mid"""
)
def cross_anchor(spark, sf_dir):
    _, t, scored, _ = scored_pairs(spark, sf_dir)
    out = feat.cross_anchor_features(scored.select("s1", "mid", "score"), t, sim.levenshtein_similarity, sim.levenshtein_similarity)
    return out.drop("score").withColumns({c: F.round(c, 6) for c in ("cross_name", "cross_address", "cross_translit", "cross_numeric", "cross_joint")})


@query()
def cross_anchor_fuzzy(spark, sf_dir):
    """The cross-source features with their own measures, which SQL has not."""
    _, t, scored, _ = scored_pairs(spark, sf_dir)
    out = feat.cross_anchor_features(scored.select("s1", "mid", "score"), t, sim.ratio, sim.token_set_ratio, sim.ratio)
    return out.drop("score").withColumns({c: F.round(c, 6) for c in ("cross_name", "cross_address", "cross_translit", "cross_numeric", "cross_joint")})


# --- scores and samples -----------------------------------------------------------------


@query(FEATURES + " SELECT s1, mid, score FROM sc")
def score_logit(spark, sf_dir):
    return scored_pairs(spark, sf_dir)[2].select("s1", "mid", "score")


#: Containments stand in for the fuzzy set ratios where SQL has to follow.
_PLAIN_SETS = {"name_token_set_ratio": "name_containment_s1", "address_token_set_ratio": "address_containment_s1"}


def _rule_rows(spark, sf_dir):
    s1, t, rows = pair_rows(spark, sf_dir)
    for group in (feat.provenance_features, feat.exact_features, feat.token_features, feat.numeric_features):
        rows = group(rows)
    return s1, t, rows


_SET_SQL = {"n": "nin::DOUBLE / greatest(len(aw), 1)", "a": "ain::DOUBLE / greatest(len(av), 1)"}
_HARD_SQL = f"""(100 * passes::INT + 80 * (aa <> '' AND aa = ba)::INT + 60 * (ax <> '' AND ax = bx)::INT + 40 * (ao <> '' AND ao = bo)::INT + 20 * {_SET_SQL["n"]} + 20 * {_SET_SQL["a"]}
  + 12 * (len(ar) > 0 AND list_sort(list_distinct(ar)) = list_sort(list_distinct(br)))::INT + 12 * (ap <> '' AND ap = bp)::INT)"""


@query(
    FEATURES
    + f""" SELECT s1, mid, round(least(1.0, 0.30 * (aa <> '' AND aa = ba)::INT + 0.24 * (ax <> '' AND ax = bx)::INT + 0.12 * (ao <> '' AND ao = bo)::INT + 0.10 * {_SET_SQL["n"]} + 0.08 * {_SET_SQL["a"]}
    + 0.06 * (len(ar) > 0 AND ar = br)::INT + 0.05 * (ap <> '' AND ap = bp)::INT + CASE WHEN passes >= 2 THEN 0.05 ELSE 0.0 END), 6) AS score FROM f"""
)
def score_rule(spark, sf_dir):
    return _rule_rows(spark, sf_dir)[2].select("s1", "mid", r6(dec.rule_score(None, _PLAIN_SETS), "score"))


@query()
def score_rule_fuzzy(spark, sf_dir):
    rows = feat.fuzzy_features(_rule_rows(spark, sf_dir)[2])
    return rows.select("s1", "mid", r6(dec.rule_score(None), "score"))


_HARD = FEATURES + f", hd AS (SELECT f.s1, f.mid, round({_HARD_SQL}, 6) AS hard_score, (ax <> '' AND ax = bx) OR (aa <> '' AND aa = ba) OR (ao <> '' AND ao = bo) AS collides, f.provenance, f.passes, (gt.mid IS NOT NULL)::INT AS y FROM f LEFT JOIN gt ON f.s1 = gt.s1 AND f.mid = gt.mid)"


def _hard_rows(spark, sf_dir):
    s1, t, rows = _rule_rows(spark, sf_dir)
    hard = F.round(dec.weighted_score(dec.HARD_WEIGHTS, _PLAIN_SETS), 6).alias("hard_score")
    exact = F.col("exact_name_nosuffix") | F.col("exact_address_norm") | F.col("exact_name_sorted")
    return labelled(rows.select("s1", "mid", "provenance", hard, exact.alias("collides")), blk.truth_links(s1, t))


@query(_HARD + " SELECT s1, mid, y, hard_score FROM (SELECT *, row_number() OVER (PARTITION BY s1, substr(mid, 1, 2), y ORDER BY hard_score DESC, md5(mid || ':current-hybrid-v1'), mid) AS n FROM hd) WHERE y = 1 OR n <= 10")
def neg_sample_hybrid(spark, sf_dir):
    return smp.hard_negatives(_hard_rows(spark, sf_dir).select("s1", "mid", "y", "hard_score"), 10, "current-hybrid-v1")


@query(
    _HARD
    + """ SELECT s1, mid, y, hard_score FROM hd WINDOW w AS (PARTITION BY s1, substr(mid, 1, 2), y)
    QUALIFY y = 1 OR row_number() OVER (w ORDER BY hard_score DESC, mid) <= 6 OR row_number() OVER (w ORDER BY md5(mid || ':mixed-v1-42'), mid) <= 3
      OR ((collides OR passes >= 2) AND row_number() OVER (w ORDER BY collides DESC, provenance DESC, hard_score DESC, mid) <= 3)"""
)
def neg_sample_mixed(spark, sf_dir):
    rows = _hard_rows(spark, sf_dir)
    return smp.mixed_negatives(rows, F.col("collides")).select("s1", "mid", "y", "hard_score")


@query(_HARD + " SELECT s1, mid, y, hard_score FROM hd QUALIFY y = 1 OR row_number() OVER (PARTITION BY s1, y ORDER BY hard_score DESC, mid) <= 20")
def neg_sample_hard(spark, sf_dir):
    return smp.ranked_negatives(_hard_rows(spark, sf_dir).select("s1", "mid", "y", "hard_score"), 20, F.desc("hard_score"))


@query(_HARD + " SELECT s1, mid, y, hard_score FROM hd QUALIFY y = 1 OR row_number() OVER (PARTITION BY s1, y ORDER BY md5(mid || ':42'), mid) <= 20")
def neg_sample_random(spark, sf_dir):
    return smp.random_negatives(_hard_rows(spark, sf_dir).select("s1", "mid", "y", "hard_score"), 20, "42")


@query(FEATURES + " SELECT s1, mid, y, score FROM (SELECT *, row_number() OVER (PARTITION BY s1, y ORDER BY score DESC, mid) AS a, row_number() OVER (PARTITION BY s1, y ORDER BY md5(mid || ':mined'), mid) AS b FROM y) WHERE y = 1 OR a <= 10 OR b <= 2")
def neg_sample_mined(spark, sf_dir):
    _, _, scored, truth = scored_pairs(spark, sf_dir)
    return smp.mined_negatives(labelled(scored.select("s1", "mid", "score"), truth))


@query("SELECT doc_id, CASE WHEN (('0x' || substr(md5('42:' || doc_id::VARCHAR), 1, 8))::UBIGINT / 4294967296.0) < 0.1 THEN 'val' ELSE 'train' END AS split, round(('0x' || substr(md5('42:' || doc_id::VARCHAR), 1, 8))::UBIGINT / 4294967296.0, 6) AS fraction FROM documents")
def md5_split(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", smp.split_label(key, "42").alias("split"), r6(smp.md5_fraction(key, "42"), "fraction"))


@query("SELECT doc_id, CASE WHEN substr(md5(doc_id::VARCHAR), 1, 2) <= '07' THEN 'tune' WHEN substr(md5(doc_id::VARCHAR), 1, 2) <= '0f' THEN 'threshold' ELSE 'fit' END AS role, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT % 100)::BIGINT AS percent, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT % 8)::BIGINT AS shard, substr(md5(doc_id::VARCHAR), 1, 1) AS nibble FROM documents")
def inner_split(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", smp.inner_role(key).alias("role"), smp.percent_role(key).alias("percent"), smp.sha_shard(key).alias("shard"), smp.nibble_shard(key).alias("nibble"))


@query("SELECT doc_id, lang, source, draw FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || ':sample'), doc_id::VARCHAR) AS draw FROM documents) WHERE draw <= 3")
def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").withColumn("key", F.col("doc_id").cast("string"))
    return smp.stratified_sample(rows, ["lang", "source"], "key", "sample", 3).drop("key")


@query("SELECT c_custkey, CASE WHEN n <= 50 THEN 'tune' WHEN n <= 80 THEN 'threshold' ELSE 'fit' END AS role FROM (SELECT c_custkey, row_number() OVER (ORDER BY sha256(c_custkey::VARCHAR), c_custkey::VARCHAR) AS n FROM customer)")
def quota_roles(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("key"))
    return smp.quota_roles(rows, "key", [("tune", 50), ("threshold", 30)], "fit").select("c_custkey", "role")


@query(FEATURES + " SELECT s1, mid, y, score FROM y WHERE y = 1 OR score >= 0.5 OR substr(md5(s1 || mid), 1, 1) = '0'")
def thinned_pairs(spark, sf_dir):
    _, _, scored, truth = scored_pairs(spark, sf_dir)
    rows = labelled(scored.select("s1", "mid", "score"), truth)
    return smp.thinned(rows, F.concat("s1", "mid"), (F.col("y") == 1) | (F.col("score") >= 0.5))


# --- decisions ----------------------------------------------------------------------------

_GRID = [0.2, 0.35, 0.5, 0.61, 0.75, 0.9]


@query(
    FEATURES
    + f""", th AS (SELECT unnest({_GRID})::DOUBLE AS threshold), pr AS (SELECT threshold, s1, count(*) AS pred_n, sum(y)::BIGINT AS tp FROM y JOIN th ON score >= threshold GROUP BY ALL),
    g AS (SELECT th.threshold, un.truth_n, coalesce(pr.pred_n, 0) AS pred_n, coalesce(pr.tp, 0) AS tp FROM un CROSS JOIN th LEFT JOIN pr ON pr.s1 = un.s1 AND pr.threshold = th.threshold) SELECT threshold, round(avg({F05}), 6) AS f05 FROM g GROUP BY threshold"""
)
def threshold_grid(spark, sf_dir):
    s1, _, scored, truth = scored_pairs(spark, sf_dir)
    return dec.threshold_grid(labelled(scored, truth), universe(s1, truth), _GRID).withColumn("f05", F.round("f05", 6))


@query(FEATURES + " SELECT s1, mid, score FROM sc WHERE score >= CASE WHEN substr(mid, 1, 2) = 'S2' THEN 0.6 ELSE 0.7 END AND NOT (len(ar) > 0 AND len(br) > 0 AND list_sort(list_distinct(ar)) <> list_sort(list_distinct(br)))")
def source_threshold(spark, sf_dir):
    s1, t, scored, _ = scored_pairs(spark, sf_dir)
    rows = feat.numeric_features(feat.paired(scored, s1, t))
    return dec.accept_by_source(rows, 0.6, 0.7, F.col("conflicting_address_numbers")).select("s1", "mid", "score")


@query(FEATURES + " SELECT s1, mid, score FROM sc WHERE score >= CASE WHEN aa = '' OR ba = '' THEN 0.7 ELSE 0.5 END")
def address_threshold(spark, sf_dir):
    rows = scored_pairs(spark, sf_dir, "addr_norm")[2]
    return dec.accept_by_address(rows, (F.col("a_addr_norm") == "") | (F.col("b_addr_norm") == ""), 0.5, 0.7).select("s1", "mid", "score")


@query(FEATURES + _CONTEXT + " SELECT s1, mid, score FROM cy WHERE score >= greatest(0.05, least(0.95, 0.61 + CASE WHEN candidate_count > 10 THEN 0.1 ELSE 0.0 END))")
def context_threshold(spark, sf_dir):
    # the number of candidates is all that this reads of the context
    rows = scored_pairs(spark, sf_dir)[2].withColumn("cross_joint", F.lit(0.0))
    return dec.accept_by_context(rows, 0.61, 0.1, 0.05, many=10).select("s1", "mid", "score")


@query(
    FEATURES
    + """, q AS (SELECT s1, mid, score, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, mid) AS n, sum(score) OVER (PARTITION BY s1) AS total, sum(score) OVER (PARTITION BY s1 ORDER BY score DESC, mid ROWS UNBOUNDED PRECEDING) AS head,
      round(exp(sum(ln(1 - least(score, 0.999999999999999))) OVER (PARTITION BY s1)), 12) AS empty, max(score) OVER (PARTITION BY s1) AS top FROM sc),
    v AS (SELECT *, round(1.25 * head / (0.25 * total + n), 12) AS worth FROM q), b AS (SELECT *, max(worth) OVER (PARTITION BY s1) AS best FROM v),
    kk AS (SELECT *, min(CASE WHEN worth = best THEN n END) OVER (PARTITION BY s1) AS k FROM b) SELECT s1, mid, score FROM kk WHERE best > CASE WHEN top >= 1 THEN 0.0 ELSE empty END AND n <= k"""
)
def expected_set(spark, sf_dir):
    return dec.accept_expected_set(scored_pairs(spark, sf_dir)[2].select("s1", "mid", "score"))


@query(FEATURES + " SELECT s1, mid, score FROM (SELECT s1, mid, score, row_number() OVER (PARTITION BY mid ORDER BY score DESC, s1) AS n FROM sc WHERE score >= 0.5) WHERE n = 1")
def conflict_resolution(spark, sf_dir):
    return dec.resolve_conflicts(dec.accept(scored_pairs(spark, sf_dir)[2].select("s1", "mid", "score"), 0.5))


@query(FEATURES + _CONTEXT + " SELECT s1, mid, score FROM cy WHERE CASE WHEN candidate_count > 1 AND top_score >= 0.8 AND top_score - second_score >= 0.2 THEN n = 1 ELSE score >= 0.5 END")
def gap_policy(spark, sf_dir):
    return dec.accept_by_gap(scored_pairs(spark, sf_dir)[2].select("s1", "mid", "score"), 0.5)


@query(FEATURES + " SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS rows, round(avg(score), 6) AS predicted, round(avg(y), 6) AS observed FROM y GROUP BY 1")
def calibration_bins(spark, sf_dir):
    _, _, scored, truth = scored_pairs(spark, sf_dir)
    return dec.calibration_bins(labelled(scored, truth)).withColumns({c: F.round(c, 6) for c in ("predicted", "observed")})


@query(
    FEATURES
    + """ SELECT s1, mid, round(1 / (1 + exp(-greatest(-40.0, least(40.0, 1.2 * ln(greatest(1e-6, least(score, 1 - 1e-6)) / (1 - greatest(1e-6, least(score, 1 - 1e-6)))) - 0.3)))), 6) AS platt,
    round(CASE WHEN score < 0.1 THEN 0.05 WHEN score < 0.5 THEN 0.05 + (score - 0.1) * 0.2623457 / 0.4 WHEN score < 0.9 THEN 0.3123457 + (score - 0.5) * 0.5876543 / 0.4 ELSE 0.9 END::DOUBLE, 6) AS monotone FROM sc"""
)
def calibrated_scores(spark, sf_dir):
    scored = scored_pairs(spark, sf_dir)[2]
    return scored.select("s1", "mid", r6(dec.platt(F.col("score"), 1.2, -0.3), "platt"), r6(dec.interpolate(F.col("score"), [0.1, 0.5, 0.9], [0.05, 0.3123457, 0.9]), "monotone"))


_SETS = FEATURES + ", acc AS (SELECT s1, mid, score FROM sc WHERE score >= 0.61)"


def accepted_pairs(spark, sf_dir):
    s1, t, scored, truth = scored_pairs(spark, sf_dir)
    return s1, t, dec.accept(scored, 0.61).select("s1", "mid", "score"), truth


@query(_SETS + " SELECT s.s1, coalesce(array_to_string(list_sort(list(acc.mid) FILTER (WHERE acc.mid IS NOT NULL)), ','), '') AS matched, count(acc.mid) AS n FROM s LEFT JOIN acc ON s.s1 = acc.s1 GROUP BY s.s1")
def prediction_sets(spark, sf_dir):
    s1, _, accepted, _ = accepted_pairs(spark, sf_dir)
    return dec.prediction_sets(accepted, s1)


@query()
def tsv_roundtrip(spark, sf_dir):
    """Prediction sets written as TSV, reread as links and counted beside the pairs."""
    from tessera.sources.scratch import scratch_path

    s1, _, accepted, _ = accepted_pairs(spark, sf_dir)
    path = scratch_path(spark, "matches")
    write_tsv(dec.prediction_sets(accepted, s1).select(F.col("s1").alias("source1_entity_id"), F.col("matched").alias("matched_entity_ids")), path, "source1_entity_id", unique="source1_entity_id")
    return ev.identity_difference(read_truth_tsv(spark, path).filter("mid IS NOT NULL"), accepted)


def summary_rows(scored: DataFrame, s1: DataFrame, t: DataFrame) -> DataFrame:
    """Scored pairs with what the utility summary reads, by built-in measures."""
    cross = feat.cross_anchor_features(scored.select("s1", "mid", "score"), t, sim.levenshtein_similarity, sim.levenshtein_similarity)
    rows = feat.script_features(feat.paired(cross.select("s1", "mid", "score", "cross_joint"), s1, t))
    like = lambda key: F.when((F.col(f"a_{key}") != "") & (F.col(f"b_{key}") != ""), sim.levenshtein_similarity(F.col(f"a_{key}"), F.col(f"b_{key}"))).otherwise(0.0)
    return rows.withColumns({"name_similarity": like("name_norm"), "address_similarity": like("addr_norm"), "address_missing": (F.col("a_addr_norm") == "") | (F.col("b_addr_norm") == "")})


_SUMMARY_DOUBLES = ("gap", "candidate_log_count", "score_sum", "s2_log_count", "s3_log_count", "missing_fraction", "cross_max", "cross_mean", "top_name", "top_address", "top_cross", "score_mean")


@query(
    FEATURES
    + f""", an0 AS (SELECT s1, mid AS anchor, score AS anchor_score FROM sc WHERE score >= 0.61 QUALIFY row_number() OVER (PARTITION BY s1, substr(mid, 1, 2) ORDER BY score DESC, mid) <= 2),
    cr AS (SELECT sc.s1, sc.mid, max(least({_lev_sql("sc.bn", "w.name_norm")}, {_lev_sql("sc.ba", "w.addr_norm")}) * anchor_score) AS j FROM sc JOIN an0 ON sc.s1 = an0.s1 JOIN t w ON an0.anchor = w.mid WHERE substr(sc.mid, 1, 2) <> substr(an0.anchor, 1, 2) GROUP BY ALL),
    r AS (SELECT sc.*, coalesce(cr.j, 0.0) AS j, {_lev_sql("an", "bn")} AS ns, {_lev_sql("aa", "ba")} AS ad, aa = '' OR ba = '' AS mi, regexp_matches(an, '[a-z]') AS x, regexp_matches(bn, '[a-z]') AS w, row_number() OVER (PARTITION BY sc.s1 ORDER BY score DESC, sc.mid) AS n, substr(sc.mid, 1, 2) = 'S2' AS is2 FROM sc LEFT JOIN cr ON sc.s1 = cr.s1 AND sc.mid = cr.mid)
    SELECT s1, max(score) AS top, coalesce(max(score) FILTER (WHERE n = 2), 0.0) AS second, coalesce(max(score) FILTER (WHERE n = 3), 0.0) AS third, round(max(score) - coalesce(max(score) FILTER (WHERE n = 2), 0.0), 6) AS gap, round(ln(1 + count(*)), 6) AS candidate_log_count,
    round(sum(score), 6) AS score_sum, count(*) FILTER (WHERE score >= 0.8) AS high_count, coalesce(max(score) FILTER (WHERE is2), 0.0) AS s2_top, coalesce(max(score) FILTER (WHERE NOT is2), 0.0) AS s3_top, round(ln(1 + sum(is2::INT)), 6) AS s2_log_count, round(ln(1 + sum((NOT is2)::INT)), 6) AS s3_log_count,
    round(avg(mi::INT), 6) AS missing_fraction, round(max(j), 6) AS cross_max, round(avg(j), 6) AS cross_mean, round(max(ns) FILTER (WHERE n = 1), 6) AS top_name, round(max(ad) FILTER (WHERE n = 1), 6) AS top_address, round(max(j) FILTER (WHERE n = 1), 6) AS top_cross,
    max(mi::INT) FILTER (WHERE n = 1)::DOUBLE AS top_missing, 0.0::DOUBLE AS top_script, round(avg(score), 6) AS score_mean FROM r GROUP BY s1"""
)
def utility_summary(spark, sf_dir):
    """The 20 inputs of the utility model; records are ASCII, so scripts cannot conflict."""
    s1, t, scored, _ = scored_pairs(spark, sf_dir)
    return dec.utility_summary(summary_rows(scored, s1, t)).withColumns({c: F.round(c, 6) for c in _SUMMARY_DOUBLES})


# --- evaluation ------------------------------------------------------------------------------


def accepted_counts(spark, sf_dir):
    s1, t, scored, truth = scored_pairs(spark, sf_dir)
    accepted = dec.accept(scored, 0.61)
    return s1, t, accepted.select("s1", "mid", "score"), truth, ev.labelled_counts(blk.truth_sizes(s1, t), accepted)


@query(_SETS + COUNTS + f" SELECT count(*) AS entities, round(avg({F05}), 6) AS f05 FROM ec")
def f05_macro(spark, sf_dir):
    return ev.macro_f05(accepted_counts(spark, sf_dir)[4]).withColumn("f05", F.round("f05", 6))


@query(
    _SETS
    + COUNTS
    + f""" SELECT cc, count(*) AS entities, round(avg(CASE WHEN pred_n = 0 THEN (truth_n = 0)::INT::DOUBLE ELSE tp::DOUBLE / pred_n END), 6) AS precision, round(avg(CASE WHEN truth_n = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / truth_n END), 6) AS recall, round(avg({F05}), 6) AS f05,
    round(avg((truth_n = 0)::INT), 6) AS singleton_share, round(coalesce(avg(CASE WHEN truth_n = 0 THEN (pred_n = 0)::INT::DOUBLE END), 1.0), 6) AS singleton_accuracy FROM ec GROUP BY cc"""
)
def f05_by_country(spark, sf_dir):
    out = ev.entity_report(accepted_counts(spark, sf_dir)[4], "cc")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f05", "singleton_share", "singleton_accuracy")})


@query(_SETS + COUNTS + " SELECT sum(truth_n)::BIGINT AS truth_n, sum(pred_n)::BIGINT AS pred_n, sum(tp)::BIGINT AS tp, round(CASE WHEN sum(pred_n) > 0 THEN sum(tp)::DOUBLE / sum(pred_n) ELSE 1 END, 6) AS precision, round(CASE WHEN sum(truth_n) > 0 THEN sum(tp)::DOUBLE / sum(truth_n) ELSE 1 END, 6) AS recall FROM ec")
def micro_pr(spark, sf_dir):
    return ev.micro(accepted_counts(spark, sf_dir)[4]).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(
    FEATURES
    + ", acc AS (SELECT s1, mid FROM sc)"
    + COUNTS
    + """ SELECT cc, count(*) AS entities, sum(tp)::BIGINT AS recovered, sum(truth_n)::BIGINT AS truth, round(avg(CASE WHEN truth_n = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 1.25 * (tp::DOUBLE / truth_n) / (0.25 + tp::DOUBLE / truth_n) END), 6) AS oracle_f05,
    count(*) FILTER (WHERE truth_n > 0 AND tp = truth_n) AS complete, count(*) FILTER (WHERE truth_n > 0 AND tp = 0) AS lost FROM ec GROUP BY cc"""
)
def candidate_oracle(spark, sf_dir):
    s1, t, scored, _ = scored_pairs(spark, sf_dir)
    return ev.candidate_oracle(ev.labelled_counts(blk.truth_sizes(s1, t), scored), "cc").withColumn("oracle_f05", F.round("oracle_f05", 6))


@query(
    _SETS
    + COUNTS
    + f""", z AS (SELECT ec.*, CASE WHEN truth_n >= 5 THEN '5+' ELSE truth_n::VARCHAR END AS truth_band, (s.addr_norm = '') AS address_missing FROM ec JOIN s ON ec.s1 = s.s1) SELECT truth_band, address_missing, count(*) AS entities, round(avg({F05}), 6) AS f05 FROM z GROUP BY ALL"""
)
def slice_eval(spark, sf_dir):
    s1, _, _, _, counts = accepted_counts(spark, sf_dir)
    rows = counts.join(s1.select("s1", (F.col("addr_norm") == "").alias("address_missing")), "s1").withColumn("truth_band", ev.count_band("truth_n"))
    return ev.macro_f05(rows, "truth_band", "address_missing").withColumn("f05", F.round("f05", 6))


@query(_SETS + COUNTS + " SELECT CASE WHEN pred_n >= 5 THEN '5+' ELSE pred_n::VARCHAR END AS band, count(*) AS entities, sum(tp)::BIGINT AS tp FROM ec GROUP BY 1")
def count_bands(spark, sf_dir):
    return accepted_counts(spark, sf_dir)[4].groupBy(ev.count_band("pred_n").alias("band")).agg(F.count("*").alias("entities"), F.sum("tp").alias("tp"))


@query(
    _SETS
    + COUNTS
    + f""", z AS (SELECT ec.*, NOT EXISTS (SELECT 1 FROM s o WHERE o.cc = s.cc AND o.name_sorted = s.name_sorted AND substr(md5(o.s1), 1, 1) >= '8') AS unseen FROM ec JOIN s ON ec.s1 = s.s1 WHERE substr(md5(s.s1), 1, 1) < '8')
    SELECT unseen, count(*) AS entities, round(avg({F05}), 6) AS f05 FROM z GROUP BY unseen"""
)
def unseen_key_slice(spark, sf_dir):
    """Evaluated S1 (half by hash) whose name key no S1 of the other half has."""
    s1, _, _, _, counts = accepted_counts(spark, sf_dir)
    half = F.substring(F.md5("s1"), 1, 1) < "8"
    seen = s1.filter(~half).select("cc", "name_sorted").distinct().withColumn("seen", F.lit(True))
    rows = counts.join(s1.filter(half).select("s1", "name_sorted"), "s1").join(seen, ["cc", "name_sorted"], "left").withColumn("unseen", F.col("seen").isNull())
    return ev.macro_f05(rows, "unseen").withColumn("f05", F.round("f05", 6))


@query(_SETS + COUNTS + " SELECT round(avg(pred_n), 6) AS mean, median(pred_n) AS median, round(quantile_cont(pred_n, 0.9), 6) AS p90, round(quantile_cont(pred_n, 0.95), 6) AS p95, round(quantile_cont(pred_n, 0.99), 6) AS p99, max(pred_n) AS max FROM ec")
def dist_quantiles(spark, sf_dir):
    out = ev.distribution(accepted_counts(spark, sf_dir)[4])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "p90", "p95", "p99")})


@query()
def bootstrap_ci(spark, sf_dir):
    out = ev.bootstrap_interval(accepted_counts(spark, sf_dir)[4], ev.f05())
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


@query(
    FEATURES
    + f""", cu AS (SELECT s1, count(*) OVER w AS pred_n, sum(y) OVER w AS tp FROM y WINDOW w AS (PARTITION BY s1 ORDER BY score DESC)), bs AS (SELECT cu.s1, max({F05}) AS b FROM cu JOIN un ON cu.s1 = un.s1 GROUP BY cu.s1)
    SELECT un.s1, un.truth_n, round(greatest(coalesce(b, 0.0), CASE WHEN truth_n = 0 THEN 1.0 ELSE 0.0 END), 6) AS best FROM un LEFT JOIN bs ON un.s1 = bs.s1"""
)
def entity_threshold_oracle(spark, sf_dir):
    s1, _, scored, truth = scored_pairs(spark, sf_dir)
    return ev.entity_threshold_oracle(labelled(scored, truth), universe(s1, truth)).select("s1", "truth_n", r6("best", "best"))


@query(
    FEATURES
    + """, b0 AS (SELECT s1, mid FROM sc WHERE score >= 0.75), ad AS (SELECT s1, mid FROM sc WHERE score >= 0.5 AND score < 0.75)
    SELECT (SELECT count(*) FROM b0) AS base_pairs, (SELECT count(*) FROM b0 JOIN gt USING (s1, mid)) AS base_links, count(*) AS added_pairs, count(gt.mid) AS added_links, round(1000.0 * count(gt.mid) / greatest(count(*), 1), 6) AS links_per_1000 FROM ad LEFT JOIN gt ON ad.s1 = gt.s1 AND ad.mid = gt.mid"""
)
def incremental_eval(spark, sf_dir):
    """What pairs below a threshold add to those above it, without recounting these."""
    _, _, scored, truth = scored_pairs(spark, sf_dir)
    rows = labelled(scored, truth).filter("score >= 0.5")
    base = F.col("score") >= 0.75
    out = rows.agg(F.count_if(base).alias("base_pairs"), F.count_if(base & (F.col("y") == 1)).alias("base_links"), F.count_if(~base).alias("added_pairs"), F.count_if(~base & (F.col("y") == 1)).alias("added_links"))
    return out.withColumn("links_per_1000", F.round(1000.0 * F.col("added_links") / F.greatest("added_pairs", F.lit(1)), 6))


_CLASS = """CASE WHEN pred_n > tp AND tp < truth_n THEN 'both' WHEN pred_n > tp THEN 'over' WHEN tp < truth_n THEN 'under' WHEN truth_n = 0 THEN 'singleton' ELSE 'right' END"""


@query(_SETS + COUNTS + f" SELECT {_CLASS} AS class, count(*) AS entities, sum(truth_n)::BIGINT AS truth, sum(pred_n)::BIGINT AS predicted, round(quantile_cont(pred_n, 0.5), 6) AS median_pred FROM ec GROUP BY 1")
def entity_classes(spark, sf_dir):
    counts = accepted_counts(spark, sf_dir)[4]
    return counts.groupBy(F.expr(_CLASS).alias("class")).agg(F.count("*").alias("entities"), F.sum("truth_n").alias("truth"), F.sum("pred_n").alias("predicted"), r6(F.expr("percentile(pred_n, 0.5D)"), "median_pred"))


_ERRORS = {"missing_address": "(a_addr_norm = '' OR b_addr_norm = '')", "same_name": "(a_name_nosuffix = b_name_nosuffix)", "same_address": "(a_addr_norm <> '' AND a_addr_norm = b_addr_norm)", "high_score": "(score >= 0.9)"}


@query(
    FEATURES
    + ", er AS (SELECT *, CASE WHEN y = 1 AND score < 0.61 THEN 'missed' WHEN y = 0 AND score >= 0.61 THEN 'wrong' ELSE 'right' END AS outcome FROM (SELECT y.*, s.name_nosuffix AS a_name_nosuffix, t.name_nosuffix AS b_name_nosuffix, s.addr_norm AS a_addr_norm, t.addr_norm AS b_addr_norm FROM y JOIN s ON y.s1 = s.s1 JOIN t ON y.mid = t.mid)) SELECT outcome, count(*) AS pairs, "
    + ", ".join(f"count(*) FILTER (WHERE {e}) AS {n}" for n, e in _ERRORS.items())
    + " FROM er GROUP BY outcome"
)
def error_taxonomy(spark, sf_dir):
    """Signals of missed and wrong pairs at the decision threshold; signals overlap."""
    rows = scored_pairs(spark, sf_dir, "name_nosuffix", "addr_norm")[2]
    outcome = F.when((F.col("y") == 1) & (F.col("score") < 0.61), "missed").when((F.col("y") == 0) & (F.col("score") >= 0.61), "wrong").otherwise("right")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("pairs"), *(F.count_if(F.expr(e)).alias(n) for n, e in _ERRORS.items()))


# --- audits and profiles --------------------------------------------------------------------


@query(
    KEYS
    + """ SELECT count(*) AS links, (count(*) - count(DISTINCT s1 || mid)) AS duplicates, 0::BIGINT AS unknown_s1, 0::BIGINT AS unknown_target, count(*) FILTER (WHERE substr(mid, 1, 2) = 'S2') AS to_s2, count(*) FILTER (WHERE substr(mid, 1, 2) = 'S3') AS to_s3,
    count(*) FILTER (WHERE sharers > 1) AS shared_target_links FROM (SELECT *, count(*) OVER (PARTITION BY mid) AS sharers FROM gt)"""
)
def gt_integrity(spark, sf_dir):
    s1, t = sides(spark, sf_dir)
    return ev.truth_integrity(blk.truth_links(s1, t), s1, t)


@query(
    CAND
    + """ SELECT count(*) AS rows, count(*) - count(DISTINCT c.s1 || c.mid) AS duplicates, count(*) FILTER (WHERE c.s1 NOT LIKE 'S1-%') AS bad_s1, count(*) FILTER (WHERE NOT regexp_matches(c.mid, '^S[23]-')) AS bad_target, count(*) FILTER (WHERE s.cc IS NULL OR t.cc IS NULL) AS unknown_id,
    count(*) FILTER (WHERE s.cc <> t.cc) AS country_mismatch, count(*) FILTER (WHERE (name_token_rank > 0) <> ((provenance & 4) > 0)) AS name_rank_mismatch, count(*) FILTER (WHERE (address_token_rank > 0) <> ((provenance & 8) > 0)) AS address_rank_mismatch,
    count(*) FILTER (WHERE provenance < 1 OR provenance > 15) AS bad_provenance FROM cand c LEFT JOIN s ON c.s1 = s.s1 LEFT JOIN t ON c.mid = t.mid"""
)
def candidate_audit(spark, sf_dir):
    s1, t, cand = candidate_pairs(spark, sf_dir)
    return ev.candidate_audit(cand, s1, t)


@query(CAND + " SELECT 'name' AS pass, count(*) AS rows, count(*) FILTER (WHERE source_rank > 50) AS beyond_quota, max(source_rank) AS deepest, count(*) - count(DISTINCT s1 || mid) AS duplicates FROM nrank UNION ALL SELECT 'address', count(*), count(*) FILTER (WHERE source_rank > 50), max(source_rank), count(*) - count(DISTINCT s1 || mid) FROM arank")
def pass_audit(spark, sf_dir):
    passes = blk.token_pass(*sides(spark, sf_dir), POLICY)
    one = lambda name, p: p.agg(F.lit(name).alias("pass"), F.count("*").alias("rows"), F.count_if(~blk.within_quota(POLICY)).alias("beyond_quota"), F.max("source_rank").alias("deepest"), (F.count("*") - F.count_distinct("s1", "mid")).alias("duplicates"))
    return one("name", passes[0]).unionByName(one("address", passes[1]))


@query(_SETS + " SELECT (SELECT count(*) FROM s) AS rows, 0::BIGINT AS duplicate_s1, 0::BIGINT AS not_accepted, 0::BIGINT AS not_listed")
def output_audit(spark, sf_dir):
    s1, _, accepted, _ = accepted_pairs(spark, sf_dir)
    return ev.output_audit(dec.prediction_sets(accepted, s1), accepted)


@query(CAND + " SELECT s.cc, count(DISTINCT s.s1) AS entities, count(c.mid) AS candidates, count(DISTINCT c.mid) AS targets, count(*) FILTER (WHERE c.provenance = 1) AS sorted_only, round(avg(bit_count(c.provenance)), 6) AS mean_passes FROM s LEFT JOIN cand c ON s.s1 = c.s1 GROUP BY s.cc")
def country_diagnostics(spark, sf_dir):
    s1, _, cand = candidate_pairs(spark, sf_dir, carry=("cc",))
    return ev.country_report(cand, s1).withColumn("mean_passes", F.round("mean_passes", 6))


@query(
    KEYS
    + """, sp AS (SELECT s1, cc, name_sorted, CASE WHEN substr(md5(s1), 1, 1) < '4' THEN 'val' ELSE 'train' END AS split FROM s), v AS (SELECT * FROM sp WHERE split = 'val'), r AS (SELECT cc, name_sorted, count(*) AS n FROM sp WHERE split = 'train' GROUP BY ALL)
    SELECT v.cc, count(*) AS val_rows, count(r.n) AS colliding, coalesce(max(r.n), 0) AS most FROM v LEFT JOIN r ON v.cc = r.cc AND v.name_sorted = r.name_sorted GROUP BY v.cc"""
)
def split_collisions(spark, sf_dir):
    """Validation S1 whose name key a training S1 has too, and grouped counts of it."""
    s1, _ = sides(spark, sf_dir)
    val = F.substring(F.md5("s1"), 1, 1) < "4"
    train = s1.filter(~val).groupBy("cc", "name_sorted").agg(F.count("*").alias("n"))
    rows = s1.filter(val).join(train, ["cc", "name_sorted"], "left")
    return rows.groupBy("cc").agg(F.count("*").alias("val_rows"), F.count("n").alias("colliding"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


@query()
def feature_parity(spark, sf_dir):
    """The Arrow and the built-in form of the Levenshtein features agree row by row."""

    @F.pandas_udf(T.DoubleType())
    def plain(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            row = list(range(len(y) + 1))
            for i, p in enumerate(x, 1):
                row, last = [i], row
                for j, q in enumerate(y, 1):
                    row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != q)))
            return 1 - row[-1] / max(len(x), len(y)) if x or y else 1.0

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    rows = pair_rows(spark, sf_dir)[2]
    built_in = rows.select("s1", "mid", sim.levenshtein_similarity(F.col("a_name_norm"), F.col("b_name_norm")).alias("name"), sim.levenshtein_similarity(F.col("a_addr_norm"), F.col("b_addr_norm")).alias("address"))
    other = rows.select("s1", "mid", plain("a_name_norm", "b_name_norm").alias("name"), plain("a_addr_norm", "b_addr_norm").alias("address"))
    return ev.feature_parity(built_in, other, ["name", "address"])


_STATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS nulls, round(min({c}), 6)::DOUBLE AS low, round(max({c}), 6)::DOUBLE AS high, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS sd, round(quantile_cont({c}, 0.25), 6)::DOUBLE AS p25, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS p50, round(quantile_cont({c}, 0.75), 6)::DOUBLE AS p75 FROM (SELECT {c}::DOUBLE AS {c} FROM lineitem)" for c in _STATS))
def feature_stats(spark, sf_dir):
    out = stats.column_stats(table(spark, sf_dir, "lineitem"), _STATS)
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high", "p25", "p50", "p75")} | {c: F.round(c, 4) for c in ("mean", "sd")})


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS corr FROM lineitem" for i, a in enumerate(_STATS) for b in _STATS[i + 1 :]))
def feature_corr(spark, sf_dir):
    return stats.correlations(table(spark, sf_dir, "lineitem"), _STATS).withColumn("corr", F.round("corr", 6))


_SEP = ["score", "name_shared_idf", "address_shared_idf"]


@query(
    FEATURES
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(CASE WHEN sqrt((var_pop(CASE WHEN y = 1 THEN {c} END) + var_pop(CASE WHEN y = 0 THEN {c} END)) / 2) > 0 THEN abs(avg(CASE WHEN y = 1 THEN {c} END) - avg(CASE WHEN y = 0 THEN {c} END)) / sqrt((var_pop(CASE WHEN y = 1 THEN {c} END) + var_pop(CASE WHEN y = 0 THEN {c} END)) / 2) ELSE 0 END, 6) AS separation FROM y"
        for c in _SEP
    )
)
def separation(spark, sf_dir):
    _, _, scored, truth = scored_pairs(spark, sf_dir)
    return stats.separations(labelled(scored, truth), _SEP).withColumn("separation", F.round("separation", 6))


@query()
def approx_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.agg(F.percentile_approx("l_extendedprice", [0.25, 0.5, 0.75], 10000).alias("quartiles"), F.approx_count_distinct("l_partkey", 0.02).alias("parts")).select(F.element_at("quartiles", 1).alias("p25"), F.element_at("quartiles", 2).alias("p50"), F.element_at("quartiles", 3).alias("p75"), "parts")


@query(
    KEYS
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) AS rows, count(*) FILTER (WHERE length({c}) = 0) AS empty, round(quantile_cont(length({c}), 0.5), 6) AS chars_p50, round(quantile_cont(length({c}), 0.95), 6) AS chars_p95, max(length({c})) AS chars_max, round(quantile_cont(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END, 0.5), 6) AS words_p50, max(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END) AS words_max FROM rec"
        for c in ("business_name", "business_address")
    )
)
def record_profile(spark, sf_dir):
    from tessera.sources.records import derived_records

    out = stats.text_profile(derived_records(spark, sf_dir), ["business_name", "business_address"])
    return out.withColumns({c: F.round(c, 6) for c in ("chars_p50", "chars_p95", "words_p50")})


@query()
def ml_train_score(spark, sf_dir):
    """Logistic regression and boosted trees on built-in features, trained on links of
    hash-chosen S1 and applied to all pairs, with a Platt calibration of the first."""
    s1, t, cand = candidate_pairs(spark, sf_dir)
    rows = feat.paired(cand, s1, t)
    for group in (feat.provenance_features, feat.exact_features, feat.length_features, feat.token_features, feat.numeric_features):
        rows = group(rows)
    columns = [c for g in ("exact", "token", "numeric") for c in feat.GROUPS[g]] + ["retrieval_pass_count", "name_token_rank", "address_token_rank"]
    data = labelled(rows.select("s1", "mid", *columns), blk.truth_links(s1, t))
    data = kept(data, "pairs")
    train = data.filter(smp.inner_role(F.col("s1")) == "fit")
    linear, trees = learning.fit_logistic(train, columns), learning.fit_trees(train, columns, depth=3, rounds=5)
    scored = learning.scored_by(linear, data, columns, "linear")
    a, b = learning.fit_platt(scored.filter(smp.inner_role(F.col("s1")) == "fit"), "linear")
    out = learning.scored_by(trees, scored, columns, "trees")
    return out.select("s1", "mid", "y", r6("linear", "linear"), r6("trees", "trees"), r6(dec.platt(F.col("linear"), a, b), "calibrated"), r6(dec.ensemble({"linear": 0.5, "trees": 0.5}), "ensemble"))


@query()
def entity_utility(spark, sf_dir):
    """A forest predicts each S1's F0.5 at fifteen thresholds and picks one of them."""
    s1, t, scored, truth = scored_pairs(spark, sf_dir)
    rows, every, choices = labelled(scored, truth), universe(s1, truth), list(learning.UTILITY_THRESHOLDS)
    summary = dec.utility_summary(summary_rows(scored, s1, t))
    columns = [c for c in summary.columns if c != "s1"]
    hits = [F.sum(F.when(F.col("score") >= c, F.col("y")).otherwise(0)).alias(f"tp{i}") for i, c in enumerate(choices)]
    sizes = [F.count_if(F.col("score") >= c).alias(f"pred{i}") for i, c in enumerate(choices)]
    per = rows.groupBy("s1").agg(*hits, *sizes).join(every.select("s1", "truth_n"), "s1")
    data = summary.join(per.select("s1", *(ev.f05("truth_n", f"pred{i}", f"tp{i}").alias(f"utility{i}") for i in range(len(choices)))), "s1")
    data = kept(data, "summaries")
    models = learning.fit_utility(data, columns, [f"utility{i}" for i in range(len(choices))], trees=5)
    return learning.chosen_threshold(models, data, columns, choices)


@query("SELECT o_orderpriority AS label, count(*) AS rows FROM orders GROUP BY 1 ORDER BY rows DESC, label LIMIT 3")
def top_labels(spark, sf_dir):
    """A top-n report with a full tie-break."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "label").limit(3)
