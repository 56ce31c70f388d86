"""Reports on links, policies and decisions, planted violations, and fitted corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import normalize as norm
from tessera.functions import similarity as sim
from tessera.operators import blocking as blk
from tessera.operators import decision as dec
from tessera.operators import evaluation as ev
from tessera.operators import expansion as exp
from tessera.operators import features as feat
from tessera.operators import learning
from tessera.operators import sampling as smp
from tessera.operators.blocking import passes_sql
from tessera.plans.er_queries import _JOINT, _N4, _NEIGH, _POLICIES, CAND, F05, FEATURES, KEYS, LOSSY, POLICY, _policy_sets, candidate_pairs, labelled, query, r6, scored_pairs, sides, table, universe
from tessera.plans.pair_queries import _gram_sql, _jaccard_sql, _lev_sql, _SETS, accepted_pairs, summary_rows
from tessera.sources.records import write_features
from tessera.sources.scratch import kept, scratch_path

# --- links ------------------------------------------------------------------------------

_PREFIX = "len(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: substr({0}, 1, i) = substr({1}, 1, i)))"
_INITIAL = "array_to_string(list_transform(list_filter(string_split({0}, ' '), lambda x: x <> ''), lambda x: x[1]), '')"
_WORDS = "list_filter(list_distinct(string_split({0}, ' ')), lambda x: x <> '')"
_RUNS = "regexp_extract_all({0}, '[0-9]+')"
_POST = "regexp_extract({0}, '[0-9]{{5,6}}')"
_SCRIPT = "CASE WHEN regexp_matches({0}, '[a-z]') THEN 1 ELSE 0 END"


def _grams_sql(label: str, a: str, b: str) -> str:
    out = []
    for n in (2, 3, 4):
        x, y = _gram_sql(a, n), _gram_sql(b, n)
        out += [f"len(list_intersect({x}, {y})) AS {label}_{n}gram_overlap", f"round({_jaccard_sql(x, y)}, 6) AS {label}_{n}gram_jaccard"]
    return ", ".join(out)


def _diagnostics_sql(policy) -> str:
    """CTEs up to ``dg``, the diagnostics of all links under a policy."""
    df = lambda words, table: f"(SELECT struct_pack(lo := min(d.df), hi := max(d.df)) FROM {table} d WHERE d.cc = p.cc AND list_contains({words}, d.tok))"
    return f"""{KEYS}, {passes_sql(policy)},
lk AS (SELECT gt.s1, gt.mid, p.cc, p.name_norm AS sn, o.name_norm AS tn, p.name_nosuffix AS sx, o.name_nosuffix AS tx, p.name_sorted AS so, o.name_sorted AS tso, p.name_acronym AS sac, o.name_acronym AS tac, p.addr_norm AS sa, o.addr_norm AS ta,
  list_intersect({_WORDS.format("p.name_nosuffix")}, {_WORDS.format("o.name_nosuffix")}) AS nw, list_intersect({_WORDS.format("p.addr_norm")}, {_WORDS.format("o.addr_norm")}) AS aw FROM gt JOIN s p ON gt.s1 = p.s1 JOIN t o ON gt.mid = o.mid),
wd AS (SELECT s1, mid, min(n.df) AS name_min_df, max(n.df) AS name_max_df FROM (SELECT s1, mid, cc, unnest(nw) AS tok FROM lk) JOIN ndf n USING (cc, tok) GROUP BY ALL),
ad AS (SELECT s1, mid, min(n.df) AS address_min_df, max(n.df) AS address_max_df FROM (SELECT s1, mid, cc, unnest(aw) AS tok FROM lk) JOIN adf n USING (cc, tok) GROUP BY ALL),
d0 AS (SELECT lk.*, c.s1 IS NOT NULL AS recovered, name_min_df, name_max_df, address_min_df, address_max_df,
  (so <> '' AND so = tso) OR (sa <> '' AND sa = ta) OR coalesce(name_min_df <= {policy.df_cap}, false) OR coalesce(address_min_df <= {policy.df_cap}, false) AS key_eligible, left(lk.mid, 2) AS target_source
  FROM lk LEFT JOIN wd USING (s1, mid) LEFT JOIN ad USING (s1, mid) LEFT JOIN cand c ON lk.s1 = c.s1 AND lk.mid = c.mid),
dg AS (SELECT s1, mid, sn, tn, sa, ta, so, tso, cc, recovered, key_eligible, CASE WHEN recovered THEN 'recovered' WHEN key_eligible THEN 'eligible_but_lost' ELSE 'no_key_eligible' END AS miss_category,
  sn <> '' AND sn = tn AS exact_name, sx <> '' AND sx = tx AS exact_nosuffix, so <> '' AND so = tso AS exact_sorted, len(nw) AS name_token_overlap, len(aw) AS address_token_overlap, length(sac) >= 3 AND sac = tac AS acronym_equal,
  {_INITIAL.format("sn")} <> '' AND {_INITIAL.format("sn")} = {_INITIAL.format("tn")} AS initials_equal, {_PREFIX.format("sn", "tn")} AS prefix_overlap, {_PREFIX.format("reverse(sn)", "reverse(tn)")} AS suffix_overlap,
  len(list_intersect({_RUNS.format("sa")}, {_RUNS.format("ta")})) AS numeric_overlap, {_POST.format("sa")} <> '' AND {_POST.format("sa")} = {_POST.format("ta")} AS postal_equal,
  coalesce({_RUNS.format("sa")}[1] = {_RUNS.format("ta")}[1], false) AS house_equal, sa <> '' AND ta <> '' AS both_address, sa = '' AS s1_address_missing, ta = '' AS target_address_missing,
  {_SCRIPT.format("sn")} = {_SCRIPT.format("tn")} AS same_script, false AS devanagari_latin, {_SCRIPT.format("sn")} || ':' || {_SCRIPT.format("tn")} AS script_relation, target_source,
  count(*) OVER (PARTITION BY s1) AS truth_n, sum(recovered::INT) OVER (PARTITION BY s1) - recovered::INT > 0 AS true_sister_retrieved, sum(recovered::INT) OVER (PARTITION BY s1) - sum(recovered::INT) OVER (PARTITION BY s1, target_source) > 0 AS cross_source_sister,
  name_min_df, name_max_df, address_min_df, address_max_df, {_grams_sql("name", "sn", "tn")}, {_grams_sql("address", "sa", "ta")} FROM d0)"""


def diagnosed(s1: DataFrame, t: DataFrame, policy) -> DataFrame:
    dfs = {"name": blk.token_df(t, "name_nosuffix"), "address": blk.token_df(t, "addr_norm")}
    return feat.link_diagnostics(blk.truth_links(s1, t), s1, t, blk.candidates(s1, t, policy), dfs, policy.df_cap)


@query(f"{_diagnostics_sql(POLICY)} SELECT s1, mid, {', '.join(feat.DIAGNOSTICS)} FROM dg")
def link_diagnostics(spark, sf_dir):
    """Every link with some 40 facts about how it was, or could have been, found."""
    out = diagnosed(*sides(spark, sf_dir), POLICY).select("s1", "mid", *feat.DIAGNOSTICS)
    return out.withColumns({c: F.round(c, 6) for c in feat.DIAGNOSTICS if c.endswith("jaccard")})


@query()
def link_diagnostics_fuzzy(spark, sf_dir):
    """The fuzzy likenesses of links and of their sisters."""
    rows = feat.sister_likeness(diagnosed(*sides(spark, sf_dir), LOSSY["short_quota"]))
    return rows.select("s1", "mid", *(r6(c, c) for c in ("name_ratio", "name_token_sort_ratio", "name_wratio", "address_ratio", "sister_name_similarity", "sister_address_similarity", "strongest_target_name")), "sister_closer_than_s1")


#: Signals of missed links, which overlap; ``reordered`` compares sorted names.
_SIGNALS = {
    "no_eligible_key": "NOT key_eligible",
    "eligible_but_lost": "key_eligible",
    "df_above_cutoff": "NOT key_eligible AND (coalesce(name_min_df, 0) > {cap} OR coalesce(address_min_df, 0) > {cap})",
    "name_variation": "NOT exact_name AND name_3gram_overlap > 0",
    "address_variation": "both_address AND address_jaccard_1 < 1 AND address_3gram_overlap > 0",
    "acronym_or_initials": "acronym_equal OR initials_equal",
    "script_mismatch": "NOT same_script",
    "devanagari_latin": "devanagari_latin",
    "numeric_evidence": "numeric_overlap > 0 OR house_equal OR postal_equal",
    "cross_source_sister": "cross_source_sister",
    "reordered_name": "sorted_likeness > plain_likeness + 0.15",
}
_LOSING = ["rare_words", "short_quota"]


def _miss_sql(name: str) -> str:
    policy = LOSSY[name]
    hits = ", ".join(when.format(cap=policy.df_cap) for when in _SIGNALS.values())
    return f"""SELECT '{name}' AS policy, signal, count(*) FILTER (WHERE hit) AS links, count(DISTINCT s1) FILTER (WHERE hit) AS entities, round(count(*) FILTER (WHERE hit) / count(*)::DOUBLE, 6) AS share FROM (
    {_diagnostics_sql(policy)}, ms AS (SELECT *, (sa <> ta)::INT * -1 + 1 AS address_jaccard_1, {_lev_sql("so", "tso")} AS sorted_likeness, {_lev_sql("sn", "tn")} AS plain_likeness FROM dg WHERE NOT recovered)
    SELECT s1, unnest({list(_SIGNALS)}) AS signal, unnest([{hits}]) AS hit FROM ms) GROUP BY signal"""


def misses(spark, sf_dir) -> DataFrame:
    """Missed links under the policies that lose some, with what the signals read."""
    s1, t = sides(spark, sf_dir)
    like = lambda key: F.when((F.col(f"a_{key}") != "") & (F.col(f"b_{key}") != ""), sim.levenshtein_similarity(F.col(f"a_{key}"), F.col(f"b_{key}"))).otherwise(0.0)
    rows = [diagnosed(s1, t, LOSSY[name]).filter("NOT recovered").withColumns({"policy": F.lit(name), "cap": F.lit(LOSSY[name].df_cap)}) for name in _LOSING]
    same = F.when(F.col("a_addr_norm") == F.col("b_addr_norm"), 1).otherwise(0)
    return kept(reduce(DataFrame.unionByName, rows).withColumns({"address_jaccard_1": same, "sorted_likeness": like("name_sorted"), "plain_likeness": like("name_norm")}), "misses")


@query(" UNION ALL ".join(map(_miss_sql, _LOSING)))
def miss_categories(spark, sf_dir):
    """Eleven overlapping signals of the links that two lossy policies miss."""
    signals = {name: F.expr(when.format(cap="cap")) for name, when in _SIGNALS.items()}
    return ev.signal_counts(misses(spark, sf_dir), signals, "policy").withColumn("share", F.round("share", 6))


_MISS_DIMENSIONS = {"country": "cc", "target_source": "target_source", "both_address": "both_address::VARCHAR", "script_relation": "script_relation"}


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS policy, dimension, value, count(*) AS links, count(DISTINCT s1) AS entities FROM ({_diagnostics_sql(LOSSY[name])} SELECT s1, unnest({list(_MISS_DIMENSIONS)}) AS dimension, unnest([{', '.join(_MISS_DIMENSIONS.values())}]) AS value FROM dg WHERE NOT recovered) GROUP BY dimension, value"
        for name in _LOSING
    )
)
def miss_slices(spark, sf_dir):
    """The missed links by country, source, addresses and scripts."""
    dimensions = {"country": F.col("a_cc"), "target_source": F.col("target_source"), "both_address": F.col("both_address"), "script_relation": F.col("script_relation")}
    rows = ev.by_dimension(misses(spark, sf_dir), dimensions, "policy", "s1")
    return rows.groupBy("policy", "dimension", "value").agg(F.count("*").alias("links"), F.count_distinct("s1").alias("entities"))


# --- policies ---------------------------------------------------------------------------

_LINK_SQL = "SELECT gt.s1, gt.mid, s.cc, left(gt.mid, 2) AS source, CASE WHEN s.addr_norm = '' OR t.addr_norm = '' THEN 'either_missing' ELSE 'both_present' END AS address FROM gt JOIN s ON gt.s1 = s.s1 JOIN t ON gt.mid = t.mid"


@query(
    CAND
    + _JOINT
    + f""", lk AS ({_LINK_SQL}), pl AS (SELECT unnest({list(_POLICIES)}) AS policy), r AS (SELECT pl.policy, unnest(['country', 'source', 'address']) AS dimension, unnest([lk.cc, lk.source, lk.address]) AS value, ps.s1 IS NOT NULL AS hit
    FROM lk CROSS JOIN pl LEFT JOIN ps ON ps.policy = pl.policy AND ps.s1 = lk.s1 AND ps.mid = lk.mid)
    SELECT policy, dimension, value, count(*) AS links, count(*) FILTER (WHERE hit) AS recovered, round(count(*) FILTER (WHERE hit) / count(*)::DOUBLE, 6) AS recall FROM r GROUP BY ALL"""
)
def policy_slices(spark, sf_dir):
    """Recall of rank policies by country, source and missing addresses."""
    s1, t, sets = _policy_sets(spark, sf_dir)
    links = blk.truth_links(s1, t).join(s1.select("s1", "cc", F.col("addr_norm").alias("sa")), "s1").join(t.select("mid", F.col("addr_norm").alias("ta")), "mid")
    address = F.when((F.col("sa") == "") | (F.col("ta") == ""), "either_missing").otherwise("both_present")
    out = ev.policy_slices(sets, links, list(_POLICIES), {"country": F.col("cc"), "source": blk.source_of(), "address": address})
    return out.withColumn("recall", F.round("recall", 6))


@query(
    CAND
    + _JOINT
    + """, b AS (SELECT DISTINCT p.policy, c.s1, c.mid FROM cand c CROSS JOIN (SELECT DISTINCT policy FROM ps) p), x AS (SELECT coalesce(ps.policy, b.policy) AS policy, coalesce(ps.s1, b.s1) AS s1, coalesce(ps.mid, b.mid) AS mid, ps.s1 IS NOT NULL AS p, b.s1 IS NOT NULL AS q
    FROM ps FULL JOIN b ON ps.policy = b.policy AND ps.s1 = b.s1 AND ps.mid = b.mid), z AS (SELECT x.*, gt.s1 IS NOT NULL AS y FROM x LEFT JOIN gt ON x.s1 = gt.s1 AND x.mid = gt.mid)
    SELECT policy, count(*) FILTER (WHERE p AND NOT q) AS gained_pairs, count(*) FILTER (WHERE p AND NOT q AND y) AS gained_links, count(*) FILTER (WHERE q AND NOT p) AS lost_pairs, count(*) FILTER (WHERE q AND NOT p AND y) AS lost_links,
    count(*) FILTER (WHERE p AND q) AS kept_pairs, count(*) FILTER (WHERE p AND q AND y) AS kept_links FROM z GROUP BY policy"""
)
def policy_changes(spark, sf_dir):
    """Pairs and links that rank policies gain over the union, and lose from it."""
    s1, t, sets = _policy_sets(spark, sf_dir)
    return ev.policy_changes(sets, blk.candidates(s1, t, POLICY), blk.truth_links(s1, t))


#: Seed thresholds, quotas and frequency caps of the expansion grid.
_GRID = {"threshold": (0.61, 0.8, 0.95), "quota": (5, 10, 20), "cap": (1000, 5000)}


def _grid_sql() -> str:
    parts = []
    for cap in _GRID["cap"]:
        edges = _NEIGH.replace("df <= 1000", f"df <= {cap}")
        parts.append(
            f"""SELECT {cap} AS df_cap, * FROM ({FEATURES}{_N4}{edges}, oj AS (SELECT sc.s1, sc.mid AS seed, sc.score, e.neighbour, row_number() OVER (PARTITION BY sc.s1, sc.mid ORDER BY left(e.seed, 2) <> left(e.neighbour, 2) DESC, e.shared DESC, round(e.evidence, 9) DESC, e.neighbour) AS q
            FROM sc JOIN edges e ON sc.mid = e.seed), gr AS (SELECT a.v::DOUBLE AS threshold, b.v::BIGINT AS quota, oj.s1, oj.neighbour, count(*) AS support FROM (SELECT unnest({list(_GRID["threshold"])}) AS v) a, (SELECT unnest({list(_GRID["quota"])}) AS v) b, oj WHERE oj.score >= a.v AND oj.q <= b.v GROUP BY ALL)
            SELECT threshold, quota, count(*) AS pairs, count(*) FILTER (WHERE c.s1 IS NULL) AS new_pairs, count(*) FILTER (WHERE c.s1 IS NULL AND gt.s1 IS NOT NULL) AS new_links, max(support) AS most_support
            FROM gr LEFT JOIN cand c ON gr.s1 = c.s1 AND gr.neighbour = c.mid LEFT JOIN gt ON gr.s1 = gt.s1 AND gr.neighbour = gt.mid GROUP BY ALL)"""
        )
    return " UNION ALL ".join(parts)


@query(_grid_sql())
def expansion_grid(spark, sf_dir):
    """One-hop expansion at every seed threshold, quota and frequency cap."""
    _, t, scored, truth = scored_pairs(spark, sf_dir)
    seeds = kept(scored.select("s1", F.col("mid").alias("seed"), F.col("score").alias("seed_score")), "seeds")
    known, links = seeds.select("s1", F.col("seed").alias("mid"), F.lit(1).alias("known")), truth.withColumn("y", F.lit(1))
    out = []
    for cap in _GRID["cap"]:
        joined = kept(exp.seed_edges(seeds, exp.neighbour_index(t, cap=cap, k=20), min(_GRID["threshold"]), max(_GRID["quota"])), "seed-edges")
        for threshold in _GRID["threshold"]:
            for quota in _GRID["quota"]:
                found = exp.best_edges(joined.filter((F.col("seed_score") >= threshold) & (F.col("seed_edge") <= quota))).join(known, ["s1", "mid"], "left").join(links, ["s1", "mid"], "left")
                fresh = F.col("known").isNull()
                row = found.agg(F.count("*").alias("pairs"), F.count_if(fresh).alias("new_pairs"), F.count_if(fresh & (F.col("y") == 1)).alias("new_links"), F.max("support").alias("most_support"))
                out.append(row.select(F.lit(cap).cast("int").alias("df_cap"), F.lit(threshold).alias("threshold"), F.lit(quota).cast("long").alias("quota"), "*"))
    return reduce(DataFrame.unionByName, out).filter("pairs > 0")


# --- decisions --------------------------------------------------------------------------

_SLICES = """unnest(['source', 'address', 'script_relation', 'provenance', 'rank_band']) AS dimension, unnest([left(mid, 2), CASE WHEN aa = '' OR ba = '' THEN 'either_missing' ELSE 'both_present' END, 'same_or_empty', provenance::VARCHAR,
  CASE WHEN source_balanced_rank = 0 THEN '0' WHEN source_balanced_rank <= 10 THEN '1-10' WHEN source_balanced_rank <= 25 THEN '11-25' ELSE '26-50' END]) AS value"""


@query(
    FEATURES
    + f""", z AS (SELECT y, score >= 0.61 AS yes, {_SLICES} FROM y) SELECT dimension, value, count(*) AS candidates, count(*) FILTER (WHERE y = 1) AS recovered_truth, count(*) FILTER (WHERE yes) AS predicted,
    count(*) FILTER (WHERE yes AND y = 1) AS tp, count(*) FILTER (WHERE yes AND y = 0) AS fp, count(*) FILTER (WHERE NOT yes AND y = 1) AS matcher_fn FROM z GROUP BY ALL"""
)
def pair_slices(spark, sf_dir):
    """Decided pairs by source, address, scripts, provenance and rank."""
    s1, t, scored, truth = scored_pairs(spark, sf_dir)
    rows = feat.script_features(feat.paired(labelled(scored, truth), s1, t)).withColumn("accepted", F.col("score") >= 0.61)
    missing = (F.col("a_addr_norm") == "") | (F.col("b_addr_norm") == "")
    dimensions = {
        "source": blk.source_of(),
        "address": F.when(missing, "either_missing").otherwise("both_present"),
        "script_relation": F.when(F.col("script_conflict"), "conflict").otherwise("same_or_empty"),
        "provenance": F.col("provenance"),
        "rank_band": ev.rank_band("source_balanced_rank"),
    }
    return ev.pair_slices(rows, dimensions)


_SIGNAL_COLUMNS = ["name_similarity", "address_similarity", "name_jaccard", "address_jaccard", "candidate_count", "source_balanced_rank", "name_shared_idf", "score"]
_EVIDENCE = f""", ev AS (SELECT f.s1, f.mid, y.y, y.score, f.source_balanced_rank, f.name_shared_idf, {_lev_sql("f.an", "f.bn")} AS name_similarity, {_lev_sql("f.aa", "f.ba")} AS address_similarity,
  CASE WHEN nun > 0 THEN nin::DOUBLE / nun ELSE 0 END AS name_jaccard, CASE WHEN aun > 0 THEN ain::DOUBLE / aun ELSE 0 END AS address_jaccard, count(*) OVER (PARTITION BY f.s1) AS candidate_count, f.aa = '' OR f.ba = '' AS address_missing,
  count(*) FILTER (WHERE y.score >= 0.61) OVER (PARTITION BY f.s1) AS pred_n, count(*) FILTER (WHERE y.y = 1 AND left(f.mid, 2) = 'S2') OVER (PARTITION BY f.s1) AS s2_links, count(*) FILTER (WHERE y.y = 1 AND left(f.mid, 2) = 'S3') OVER (PARTITION BY f.s1) AS s3_links, un.truth_n
  FROM f JOIN y ON f.s1 = y.s1 AND f.mid = y.mid JOIN un ON f.s1 = un.s1)"""
_MASKS = {
    "A_strong_missed": "y = 1 AND score < 0.61 AND (name_similarity >= 0.8 OR address_similarity >= 0.8)",
    "B_similar_wrong": "y = 0 AND score >= 0.61 AND (name_similarity >= 0.8 OR address_similarity >= 0.8)",
    "B_all_wrong": "y = 0 AND score >= 0.61",
    "C_right": "y = 1 AND score >= 0.61",
    "D_hard_rejected": "y = 0 AND score < 0.61 AND score >= 0.05",
    "E_underpredicted": "pred_n < truth_n",
    "F_overpredicted": "pred_n > truth_n",
    "G_address_missing": "address_missing",
    "H_script_conflict": "false",
    "I_S2_only": "s2_links > 0 AND s3_links = 0",
    "J_S3_only": "s3_links > 0 AND s2_links = 0",
    "K_both_sources": "s2_links > 0 AND s3_links > 0",
}


def _distributions_sql(masks: dict[str, str], source: str) -> str:
    return f"""z AS (SELECT s1, unnest({list(masks)}) AS mask, unnest([{", ".join(masks.values())}]) AS hit, {", ".join(_SIGNAL_COLUMNS)} FROM {source}),
    w AS (SELECT s1, mask, unnest({_SIGNAL_COLUMNS}) AS signal, unnest([{", ".join(f"{c}::DOUBLE" for c in _SIGNAL_COLUMNS)}]) AS v FROM z WHERE hit)
    SELECT mask, signal, count(*) AS pairs, count(DISTINCT s1) AS entities, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90 FROM w GROUP BY ALL"""


def evidence_rows(spark, sf_dir) -> DataFrame:
    """Candidates with label, score, similarities and the counts of their s1."""
    from pyspark.sql import Window

    s1, t, scored, truth = scored_pairs(spark, sf_dir)
    rows = feat.script_features(feat.token_features(feat.paired(labelled(scored, truth), s1, t)))
    like = lambda key: F.when((F.col(f"a_{key}") != "") & (F.col(f"b_{key}") != ""), sim.levenshtein_similarity(F.col(f"a_{key}"), F.col(f"b_{key}"))).otherwise(0.0)
    per, y = Window.partitionBy("s1"), F.col("y") == 1
    rows = rows.withColumns(
        {
            "name_similarity": like("name_norm"),
            "address_similarity": like("addr_norm"),
            "address_missing": (F.col("a_addr_norm") == "") | (F.col("b_addr_norm") == ""),
            "candidate_count": F.count("*").over(per),
            "pred_n": F.count_if(F.col("score") >= 0.61).over(per),
            "s2_links": F.count_if(y & (blk.source_of() == "S2")).over(per),
            "s3_links": F.count_if(y & (blk.source_of() == "S3")).over(per),
        }
    )
    return rows.join(universe(s1, truth).select("s1", "truth_n"), "s1")


def _six_places(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "p10", "p50", "p90")})


@query(FEATURES + _EVIDENCE + ", " + _distributions_sql(_MASKS, "ev"))
def error_masks(spark, sf_dir):
    """Overlapping classes of decided pairs with the distribution of eight signals in each."""
    similar = (F.col("name_similarity") >= 0.8) | (F.col("address_similarity") >= 0.8)
    return _six_places(ev.mask_distributions(evidence_rows(spark, sf_dir), ev.error_masks(similar), _SIGNAL_COLUMNS))


_ENTITY_MASKS = {"under": "pred_n < truth_n", "over": "pred_n > truth_n", "S2_only": "t2 > 0 AND t3 = 0", "S3_only": "t3 > 0 AND t2 = 0", "multi_source": "t2 > 0 AND t3 > 0"}


@query(
    FEATURES
    + _EVIDENCE
    + ", tr AS (SELECT s1, count(*) FILTER (WHERE left(mid, 2) = 'S2') AS t2, count(*) FILTER (WHERE left(mid, 2) = 'S3') AS t3 FROM gt GROUP BY s1), ew AS (SELECT ev.*, coalesce(t2, 0) AS t2, coalesce(t3, 0) AS t3 FROM ev LEFT JOIN tr USING (s1)), "
    + _distributions_sql(_ENTITY_MASKS, "ew")
)
def entity_source_classes(spark, sf_dir):
    """Entities over- and underpredicted, or linked to one source or both by all links."""
    s1, t = sides(spark, sf_dir)
    sources = blk.truth_links(s1, t).groupBy("s1").agg(F.count_if(blk.source_of() == "S2").alias("t2"), F.count_if(blk.source_of() == "S3").alias("t3"))
    rows = evidence_rows(spark, sf_dir).join(sources, "s1", "left").na.fill(0, ["t2", "t3"])
    return _six_places(ev.mask_distributions(rows, {name: F.expr(when) for name, when in _ENTITY_MASKS.items()}, _SIGNAL_COLUMNS))


@query(
    FEATURES
    + f""", th AS (SELECT range AS c, range / 100.0::DOUBLE AS threshold FROM range(101)), pr AS (SELECT c, s1, count(*) AS pred_n, sum(y)::BIGINT AS tp FROM y JOIN th ON score >= threshold GROUP BY ALL),
    g AS (SELECT th.c, un.truth_n, coalesce(pr.pred_n, 0) AS pred_n, coalesce(pr.tp, 0) AS tp FROM un CROSS JOIN th LEFT JOIN pr ON pr.s1 = un.s1 AND pr.c = th.c), m AS (SELECT c, avg({F05}) AS v FROM g GROUP BY c),
    a AS (SELECT c FROM m WHERE c % 5 = 0 ORDER BY round(v, 12) DESC, c LIMIT 1), b AS (SELECT m.c, m.v FROM m, a WHERE m.c BETWEEN a.c - 5 AND a.c + 5 ORDER BY round(v, 12) DESC, m.c LIMIT 1)
    SELECT c / 100.0::DOUBLE AS threshold, round(v, 6) AS f05 FROM b"""
)
def threshold_search(spark, sf_dir):
    """The threshold of the two-stage search and its macro F0.5."""
    s1, _, scored, truth = scored_pairs(spark, sf_dir)
    rows, every = kept(labelled(scored, truth).select("s1", "y", "score"), "labelled"), kept(universe(s1, truth), "universe")
    best = dec.best_threshold(rows, every)
    return dec.threshold_grid(rows, every, [best]).withColumn("f05", F.round("f05", 6))


@query()
def fitted_corrections(spark, sf_dir):
    """A residual corrector and a monotone calibration, fitted on a hash-chosen part of the S1."""
    scored = scored_pairs(spark, sf_dir)
    rows = kept(labelled(dec.residual_context(scored[2].select("s1", "mid", "score")), scored[3]), "context")
    columns = [c for c in rows.columns if c.startswith("current_")]
    fit = rows.filter(smp.inner_role(F.col("s1")) == "fit")
    corrected = learning.residual_margin(learning.fit_residual(fit, columns), rows, columns)
    corrected = kept(corrected.withColumn("corrected", dec.residual_score(F.col("score"), F.col("margin"))).select("s1", "mid", "y", "score", "corrected"), "corrected")
    x, y = learning.fit_isotonic(corrected.filter(smp.inner_role(F.col("s1")) == "fit"), "corrected")
    return corrected.select("s1", "mid", "y", "score", r6("corrected", "corrected"), r6(dec.interpolate(F.col("corrected"), x, y), "calibrated"))


@query()
def boosted_ensemble(spark, sf_dir):
    """Two boosters of unlike depth, their weighted mean, and the choice among the three.

    The choice is the cheapest whose macro F0.5 on the tuning S1 is within 0.001 of the best;
    rounds stop where F0.5 no longer rises.
    """
    s1, t, cand = candidate_pairs(spark, sf_dir, likeness=True, labels=True)
    rows = feat.provenance_features(cand)
    columns = ["exact_name_nosuffix", "exact_address_norm", "name_jaccard", "address_jaccard", "retrieval_pass_count", "name_token_rank", "address_token_rank"]
    data = kept(rows.select("s1", "mid", *columns, "y"), "pairs")
    role = smp.inner_role(F.col("s1"))
    fit, every = data.filter(role == "fit"), blk.truth_sizes(s1, t).filter(role == "tune")

    def quality(scored: DataFrame, name: str) -> float:
        rows = scored.filter(role == "tune").withColumn("score", F.col(name))
        return dec.threshold_grid(rows, every, [0.5]).first()["f05"]

    stages = [(n, learning.fit_trees(fit, columns, depth=2, rounds=n)) for n in (2, 5, 10)]
    kept_round = learning.early_stop([quality(learning.scored_by(model, data, columns, "p"), "p") for _, model in stages], patience=1)
    deep = learning.fit_trees(fit, columns, depth=4, rounds=5)
    scored = learning.scored_by(deep, learning.scored_by(stages[kept_round][1], data, columns, "shallow"), columns, "deep")
    scored = kept(scored.withColumn("both", dec.ensemble({"shallow": 0.4, "deep": 0.6})).select("s1", "mid", "y", "shallow", "deep", "both"), "scores")
    pick = learning.simplest_within([(name, quality(scored, name), cost) for name, cost in (("shallow", 1.0), ("deep", 2.0), ("both", 3.0))])
    return scored.select("s1", "mid", "y", r6("shallow", "shallow"), r6("deep", "deep"), r6("both", "both"), F.lit(pick).alias("chosen"), r6(pick, "score"))


@query()
def feature_sink(spark, sf_dir):
    """Features written with fixed types and described columns, reread and compared."""
    s1, t, cand = candidate_pairs(spark, sf_dir)
    rows = kept(feat.token_features(feat.exact_features(feat.paired(cand, s1, t))), "features")
    columns = feat.GROUPS["exact"] + [c for c in feat.GROUPS["token"] if not c.endswith("shared_idf")]
    path = scratch_path(spark, "features")
    write_features(rows, path, {c: f"feature {c} of a candidate pair" for c in columns}, "1")
    back = spark.read.parquet(path)
    described = sum(f.metadata.get("version") == "1" for f in back.schema.fields)
    return ev.feature_parity(rows, back, columns).withColumn("described", F.lit(described))


# --- planted violations -----------------------------------------------------------------

#: Names that every audit gets along with the right rows: who breaks which rule.
_PLANTED = ", ".join(f"('{s}', '{m}')" for s, m in (("S1-00000000", "S2-99999999"), ("S1-99999999", "S2-00000001"), ("S9-00000000", "S2-00000001"), ("S1-00000003", "S4-00000001")))


def planted_links(spark, truth: DataFrame) -> DataFrame:
    """The links, the first of them twice, and links of ids that are unknown or ill-formed."""
    wrong = spark.sql(f"SELECT * FROM VALUES {_PLANTED} AS v(s1, mid)")
    return truth.unionByName(truth.orderBy("s1", "mid").limit(1)).unionByName(wrong)


@query(
    KEYS
    + f""", pl AS (SELECT * FROM gt UNION ALL SELECT * FROM (SELECT * FROM gt ORDER BY s1, mid LIMIT 1) UNION ALL SELECT * FROM (VALUES {_PLANTED}) v(s1, mid))
    SELECT count(*) AS links, count(*) - (SELECT count(*) FROM (SELECT DISTINCT s1, mid FROM pl)) AS duplicates, count(*) FILTER (WHERE s1 NOT IN (SELECT s1 FROM s)) AS unknown_s1, count(*) FILTER (WHERE mid NOT IN (SELECT mid FROM t)) AS unknown_target,
    count(*) FILTER (WHERE left(mid, 2) = 'S2') AS to_s2, count(*) FILTER (WHERE left(mid, 2) = 'S3') AS to_s3, count(*) FILTER (WHERE sharers > 1) AS shared_target_links FROM (SELECT *, count(*) OVER (PARTITION BY mid) AS sharers FROM pl)"""
)
def gt_integrity_planted(spark, sf_dir):
    """The integrity counts of links among which some are wrong."""
    s1, t = sides(spark, sf_dir)
    return ev.truth_integrity(planted_links(spark, blk.truth_links(s1, t)), s1, t)


#: Set lines that break a rule each: a repeated S1, an unknown one, repeated, unsorted,
#: ill-formed and unknown ids, and (by what is left out) an absent S1.
_LINES = [("S1-00000000", ""), ("S1-99999999", "S2-00000001"), ("S1-00000003", "S2-00000001,S2-00000001"), ("S1-00000003", "S3-00000002,S2-00000001"), ("S1-00000003", "X-1"), ("S1-00000003", "S2-99999999")]
_LINES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in _LINES)


@query(
    _SETS
    + f""", ps AS (SELECT s.s1, coalesce(array_to_string(list_sort(list(acc.mid) FILTER (WHERE acc.mid IS NOT NULL)), ','), '') AS matched FROM s LEFT JOIN acc ON s.s1 = acc.s1 WHERE s.s1 <> 'S1-00000006' GROUP BY s.s1 UNION ALL SELECT * FROM (VALUES {_LINES_SQL}) v(s1, matched)),
    pi AS (SELECT s1, list_filter(string_split(matched, ','), lambda x: x <> '') AS ids FROM ps)
    SELECT count(*) AS rows, count(*) - count(DISTINCT s1) AS repeated_s1, count(*) FILTER (WHERE s1 NOT IN (SELECT s1 FROM s)) AS unknown_s1, count(*) FILTER (WHERE len(ids) <> len(list_distinct(ids))) AS repeated_ids, count(*) FILTER (WHERE ids <> list_sort(ids)) AS unsorted,
    count(*) FILTER (WHERE len(list_filter(ids, lambda x: NOT regexp_matches(x, '^S[23]-'))) > 0) AS bad_prefix, (SELECT count(*) FROM (SELECT unnest(ids) AS m FROM pi) WHERE m NOT IN (SELECT mid FROM t)) AS unknown_ids, (SELECT count(*) FROM s WHERE s1 NOT IN (SELECT s1 FROM ps)) AS absent_s1 FROM pi"""
)
def submission_check_planted(spark, sf_dir):
    """The rules for submitted sets, on sets of which some break them."""
    s1, t, accepted, _ = accepted_pairs(spark, sf_dir)
    lines = spark.createDataFrame(_LINES, "s1 string, matched string")
    sets = dec.prediction_sets(accepted, s1).select("s1", "matched").filter("s1 <> 'S1-00000006'").unionByName(lines)
    return ev.submission_check(sets, s1, t)


@query(
    CAND
    + """, z AS (SELECT 'name' AS field, cc, tok, df, CASE WHEN length(tok) > 6 THEN df + 1 ELSE df END AS said FROM ndf UNION ALL SELECT 'address', cc, tok, df, CASE WHEN length(tok) > 6 THEN df + 1 ELSE df END FROM adf)
    SELECT field, count(*) AS tokens, count(*) FILTER (WHERE said <> df) AS differing FROM z GROUP BY field"""
)
def token_df_planted(spark, sf_dir):
    """The recount of word frequencies finds those that are off by one."""
    _, t = sides(spark, sf_dir)
    said = F.when(F.length("tok") > 6, F.col("df") + 1).otherwise(F.col("df"))
    fields = {"name": "name_nosuffix", "address": "addr_norm"}
    return reduce(DataFrame.unionByName, [ev.df_recount(blk.token_df(t, key).withColumn("df", said), t, key).select(F.lit(f).alias("field"), "tokens", "differing") for f, key in fields.items()])


@query(
    FEATURES
    + """, z AS (SELECT s1, mid, CASE WHEN nin = 0 THEN NULL ELSE nin END AS a, CASE WHEN ain = 0 THEN 'NaN'::DOUBLE ELSE ain / 1.0::DOUBLE END AS b FROM f WHERE ain <> 1), w AS (SELECT * FROM z UNION ALL SELECT * FROM z WHERE b > 5 AND NOT isnan(b))
    SELECT count(*) AS rows, count(*) FILTER (WHERE a IS NULL) AS nulls, count(*) FILTER (WHERE isnan(b)) AS nans, count(*) - (SELECT count(*) FROM z) AS duplicates, 0::BIGINT AS added, (SELECT count(*) FROM f) - (SELECT count(*) FROM z) AS missing FROM w"""
)
def feature_audit_planted(spark, sf_dir):
    """The audit of features counts nulls, NaNs, repeated and missing pairs that are there."""
    s1, t, cand = candidate_pairs(spark, sf_dir)
    rows = kept(feat.token_features(feat.paired(cand, s1, t)).select("s1", "mid", "name_token_intersection", "address_token_intersection"), "tokens").filter("address_token_intersection <> 1")
    a = F.when(F.col("name_token_intersection") != 0, F.col("name_token_intersection"))
    b = F.when(F.col("address_token_intersection") == 0, F.lit(float("nan"))).otherwise(F.col("address_token_intersection").cast("double"))
    spoiled = rows.select("s1", "mid", a.alias("a"), b.alias("b"))
    return ev.feature_audit(spoiled.unionByName(spoiled.filter("b > 5 AND NOT isnan(b)")), cand, ["a", "b"])


# --- keys of other scripts, splits --------------------------------------------------------

_RAW = "trim(regexp_replace(regexp_replace(strip_accents(replace(replace(lower({0}), 'ß', 'ss'), '&', ' and ')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', ' ', 'g'), ' +', ' ', 'g'))"
_FORMS = ", ".join(f"'{w}'" for w in norm.LEGAL_FORMS)


@query(
    f"""WITH r AS (SELECT 'S' || (doc_id % 3 + 1) || '-' || lpad(doc_id::VARCHAR, 8, '0') AS entity_id, string_split(text, ' ') AS w, upper(lang) AS country FROM documents WHERE text IS NOT NULL),
    n AS (SELECT entity_id, country, {_RAW.format("array_to_string(w[1:4], ' ')")} AS name_norm, {_RAW.format("array_to_string(w[5:12], ' ')")} AS addr_norm, array_to_string(w[5:12], ' ') AS raw FROM r),
    v AS (SELECT *, list_filter(string_split(name_norm, ' '), lambda x: x <> '') AS nw FROM n), c AS (SELECT *, CASE WHEN len(list_filter(nw, lambda x: x NOT IN ({_FORMS}))) > 0 THEN list_filter(nw, lambda x: x NOT IN ({_FORMS})) ELSE nw END AS cw FROM v)
    SELECT entity_id, lower(country) AS cc, name_norm, array_to_string(cw, ' ') AS name_nosuffix, array_to_string(list_sort(list_distinct(cw)), ' ') AS name_sorted,
    CASE WHEN len(cw) >= 2 THEN array_to_string(list_transform(cw, lambda x: x[1]), '') ELSE '' END AS name_acronym, addr_norm, array_to_string(list_sort(list_distinct(regexp_extract_all(raw, '\\p{{Nd}}+'))), ',') AS numbers FROM c"""
)
def normalize_keys_unicode(spark, sf_dir):
    """Keys of records that hold the documents' words as they are, accents and marks included."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    w = F.split("text", " ", 13)
    entity = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    records = docs.select(entity.alias("entity_id"), F.array_join(F.slice(w, 1, 4), " ").alias("business_name"), F.array_join(F.slice(w, 5, 8), " ").alias("business_address"), F.upper("lang").alias("country"))
    keys = norm.normalized_keys(records)
    return keys.select("entity_id", "cc", "name_norm", "name_nosuffix", "name_sorted", "name_acronym", "addr_norm", F.array_join("num_tokens", ",").alias("numbers"))


@query(
    KEYS
    + f""", sp AS (SELECT s1, cc, name_nosuffix, addr_norm, substr(md5(s1), 1, 1) < '4' AS val FROM s WHERE name_nosuffix <> ''), kz AS (SELECT cc, name_nosuffix, count(*) FILTER (WHERE val) AS nv, count(*) FILTER (WHERE NOT val) AS nt FROM sp GROUP BY ALL HAVING nv > 0 AND nt > 0),
    mx AS (SELECT a.cc, a.name_nosuffix, max(CASE WHEN a.addr_norm <> '' AND b.addr_norm <> '' THEN {_jaccard_sql(_WORDS.format("a.addr_norm"), _WORDS.format("b.addr_norm"))} END) AS j FROM kz JOIN sp a USING (cc, name_nosuffix) JOIN sp b USING (cc, name_nosuffix) WHERE a.val AND NOT b.val AND nv <= 5 AND nt <= 5 GROUP BY ALL)
    SELECT CASE WHEN mx.cc IS NULL THEN 'frequent_key' WHEN j IS NULL THEN 'no_address' WHEN j >= 0.999 THEN 'same_address' WHEN j >= 0.8 THEN 'near_address' WHEN j >= 0.5 THEN 'half_address' WHEN j > 0 THEN 'some_address' ELSE 'other_address' END AS collision,
    count(*) AS keys, sum(nv)::BIGINT AS val_rows FROM kz LEFT JOIN mx USING (cc, name_nosuffix) GROUP BY ALL"""
)
def split_collision_types(spark, sf_dir):
    """Name keys on both sides of a split, typed by how alike the addresses across it are.

    Keys with more than five rows on a side are counted as frequent and not compared.
    """
    s1, _ = sides(spark, sf_dir)
    rows = s1.filter("name_nosuffix <> ''").select("s1", "cc", "name_nosuffix", "addr_norm", (F.substring(F.md5("s1"), 1, 1) < "4").alias("val"))
    key = ["cc", "name_nosuffix"]
    sizes = rows.groupBy(*key).agg(F.count_if("val").alias("nv"), F.count_if(~F.col("val")).alias("nt")).filter("nv > 0 AND nt > 0")
    rare = rows.join(sizes.filter("nv <= 5 AND nt <= 5").select(*key), key, "left_semi")
    across = rare.filter("val").join(rare.filter("NOT val").select(*key, F.col("addr_norm").alias("other")), key)
    j = F.when((F.col("addr_norm") != "") & (F.col("other") != ""), sim.jaccard(F.array_distinct(norm.words(F.col("addr_norm"))), F.array_distinct(norm.words(F.col("other")))))
    likest = across.groupBy(*key).agg(F.max(j).alias("j"), F.lit(True).alias("typed"))
    x = F.col("j")
    kind = F.when(F.col("typed").isNull(), "frequent_key").when(x.isNull(), "no_address").when(x >= 0.999, "same_address").when(x >= 0.8, "near_address").when(x >= 0.5, "half_address").when(x > 0, "some_address").otherwise("other_address")
    return sizes.join(likest, key, "left").groupBy(kind.alias("collision")).agg(F.count("*").alias("keys"), F.sum("nv").alias("val_rows"))


@query(
    KEYS
    + """, g AS (SELECT s1, cc, name_nosuffix, CASE WHEN ('0x' || substr(md5('grouped:' || cc || '|' || name_nosuffix), 1, 8))::UBIGINT / 4294967296.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM s),
    l AS (SELECT cc, name_nosuffix FROM g GROUP BY ALL HAVING count(DISTINCT split) > 1) SELECT split, count(*) AS entities, count(DISTINCT cc || '|' || name_nosuffix) AS keys, (SELECT count(*) FROM l) AS shared_keys FROM g GROUP BY split"""
)
def grouped_holdout(spark, sf_dir):
    """A holdout of whole (country, name) groups: no name key is on both sides."""
    s1, _ = sides(spark, sf_dir)
    group = F.concat_ws("|", "cc", "name_nosuffix")
    rows = s1.select(group.alias("group"), smp.grouped_split(group, "grouped").alias("split"))
    shared = rows.groupBy("group").agg(F.count_distinct("split").alias("sides")).agg(F.count_if(F.col("sides") > 1).alias("shared_keys"))
    return rows.groupBy("split").agg(F.count("*").alias("entities"), F.count_distinct("group").alias("keys")).crossJoin(shared)  # one row
