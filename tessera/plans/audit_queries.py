"""Audits, diagnostics and projections that complete the operator inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import normalize as norm
from tessera.functions import similarity as sim
from tessera.operators import blocking as blk
from tessera.operators import decision as dec
from tessera.operators import evaluation as ev
from tessera.operators import expansion as exp
from tessera.operators import features as feat
from tessera.operators import learning
from tessera.plans.er_queries import _N4, CAND, FEATURES, KEYS, POLICY, candidate_pairs, labelled, query, r6, scored_pairs, sides, table
from tessera.plans.pair_queries import _CONTEXT, accepted_pairs
from tessera.sources.records import derived_records


@query(CAND + " SELECT s1, mid, n FROM (SELECT s1, mid, row_number() OVER (PARTITION BY s1 ORDER BY bit_count(provenance) DESC, mid) AS n FROM cand) WHERE n <= 5")
def popcount_rank(spark, sf_dir):
    """The five candidates of each S1 that most passes found."""
    cand = candidate_pairs(spark, sf_dir)[2]
    w = Window.partitionBy("s1").orderBy(F.desc(F.bit_count("provenance")), "mid")
    return cand.select("s1", "mid", F.row_number().over(w).cast("long").alias("n")).filter("n <= 5")


@query(
    CAND
    + """ SELECT p.field, count(*) AS links, count(*) FILTER (WHERE p.source_rank IS NULL) AS not_listed, count(*) FILTER (WHERE p.source_rank <= 50) AS within_quota, count(*) FILTER (WHERE p.source_rank > 50) AS beyond_quota, max(p.source_rank) AS deepest FROM (
    SELECT 'name' AS field, gt.s1, gt.mid, r.source_rank FROM gt LEFT JOIN nrank r ON gt.s1 = r.s1 AND gt.mid = r.mid UNION ALL SELECT 'address', gt.s1, gt.mid, r.source_rank FROM gt LEFT JOIN arank r ON gt.s1 = r.s1 AND gt.mid = r.mid) p GROUP BY p.field"""
)
def pass_cap_diagnostics(spark, sf_dir):
    """Links per token pass: not on its list, within its quota, beyond it."""
    s1, t = sides(spark, sf_dir)
    truth, out = blk.truth_links(s1, t), None
    for field, ranked in zip(("name", "address"), blk.token_pass(s1, t, POLICY)):
        rows = truth.join(ranked.select("s1", "mid", "source_rank"), ["s1", "mid"], "left")
        rank = F.col("source_rank")
        one = rows.agg(F.lit(field).alias("field"), F.count("*").alias("links"), F.count_if(rank.isNull()).alias("not_listed"), F.count_if(rank <= 50).alias("within_quota"), F.count_if(rank > 50).alias("beyond_quota"), F.max(rank).alias("deepest"))
        out = one if out is None else out.unionByName(one)
    return out.filter("links > 0")


#: The number of S1 that densities are projected to.
_PROJECT_TO = 1_000_000.0


@query(CAND + f" SELECT (SELECT count(*) FROM s) AS entities, count(*) AS candidates, round(count(*)::DOUBLE / (SELECT count(*) FROM s), 6) AS density, round({_PROJECT_TO} * (count(*)::DOUBLE / (SELECT count(*) FROM s)), 0) AS projected FROM cand")
def density_projection(spark, sf_dir):
    """Candidates per S1, scaled to a number of S1."""
    s1, _, cand = candidate_pairs(spark, sf_dir)
    sizes = s1.agg(F.count("*").alias("entities")).crossJoin(cand.agg(F.count("*").alias("candidates")))  # one row each
    density = F.col("candidates") / F.col("entities")
    return sizes.select("entities", "candidates", r6(density, "density"), F.round(_PROJECT_TO * density, 0).alias("projected"))


@query(FEATURES + " SELECT count(*) AS rows, 0::BIGINT AS nulls, 0::BIGINT AS nans, count(*) - count(DISTINCT s1 || mid) AS duplicates, 0::BIGINT AS added, 0::BIGINT AS missing FROM f")
def feature_audit(spark, sf_dir):
    s1, t, cand = candidate_pairs(spark, sf_dir)
    rows = feat.token_features(feat.length_features(feat.exact_features(feat.paired(cand, s1, t))))
    columns = [c for g in ("exact", "length", "token") for c in feat.GROUPS[g]]
    return ev.feature_audit(rows, cand, columns)


@query(
    FEATURES
    + _CONTEXT
    + """ SELECT s1, mid, round(1 / (1 + exp(-greatest(-40.0, least(40.0, ln(greatest(1e-6, least(score, 1 - 1e-6)) / (1 - greatest(1e-6, least(score, 1 - 1e-6)))) + 0.5 * (score - top_score) + 0.2 * (top_score - second_score))))), 6) AS score FROM cy"""
)
def residual_scores(spark, sf_dir):
    """Scores corrected on the logit scale by a margin from their context."""
    rows = dec.residual_context(scored_pairs(spark, sf_dir)[2].select("s1", "mid", "score"))
    margin = 0.5 * F.col("current_relative") + 0.2 * F.col("current_gap")
    return rows.select("s1", "mid", r6(dec.residual_score(F.col("score"), margin), "score"))


@query(FEATURES + " SELECT s1, mid, y, round(1.0::DOUBLE / count(*) OVER (PARTITION BY s1), 6) AS weight FROM y")
def entity_weights(spark, sf_dir):
    _, _, scored, truth = scored_pairs(spark, sf_dir)
    rows = labelled(scored.select("s1", "mid"), truth)
    return learning.entity_weights(rows).withColumn("weight", F.round("weight", 6))


@query()
def paired_bootstrap(spark, sf_dir):
    """Interval of the gain in F0.5 of one threshold over another, S1 by S1."""
    s1, _, scored, truth = scored_pairs(spark, sf_dir)
    one, two = (ev.entity_counts(s1.select("s1", "cc"), truth, dec.accept(scored, t)) for t in (0.61, 0.5))
    out = ev.paired_interval(one, two, ev.f05())
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


@query(KEYS + " SELECT count(*) AS rows, 0::BIGINT AS repeated_s1, 0::BIGINT AS unknown_s1, 0::BIGINT AS repeated_ids, 0::BIGINT AS unsorted, 0::BIGINT AS bad_prefix, 0::BIGINT AS unknown_ids, 0::BIGINT AS absent_s1 FROM s")
def submission_check(spark, sf_dir):
    s1, t, accepted, _ = accepted_pairs(spark, sf_dir)
    return ev.submission_check(dec.prediction_sets(accepted, s1), s1, t)


@query("SELECT count(*) AS rows, 0::BIGINT AS differing FROM documents")
def normalize_replay(spark, sf_dir):
    """Records whose built-in keys differ from the Unicode rule: none, as they are ASCII."""
    rows = derived_records(spark, sf_dir)
    name, address = (norm.unicode_norm(c) != norm.ascii_norm(F.col(c)) for c in ("business_name", "business_address"))
    return rows.select(name.alias("n"), address.alias("a")).agg(F.count("*").alias("rows"), F.count_if(F.col("n") | F.col("a")).alias("differing"))


@query(CAND + " SELECT 'name' AS field, count(*) AS tokens, 0::BIGINT AS differing FROM ndf UNION ALL SELECT 'address', count(*), 0::BIGINT FROM adf")
def token_df_verification(spark, sf_dir):
    """Document frequencies against a recount by distinct ids."""
    _, t = sides(spark, sf_dir)
    one, two = (ev.df_recount(blk.token_df(t, key), t, key).select(F.lit(f).alias("field"), "tokens", "differing") for f, key in (("name", "name_nosuffix"), ("address", "addr_norm")))
    return one.unionByName(two)


@query(
    KEYS
    + """ SELECT s1, cc, reason FROM (SELECT s1, cc, 'hash' AS reason, row_number() OVER (PARTITION BY cc ORDER BY md5(s1 || ':smoke'), s1) AS n, 4 AS cap FROM s
    UNION ALL SELECT s1, cc, 'missing_address', row_number() OVER (PARTITION BY cc ORDER BY md5(s1 || ':smoke'), s1), 2 FROM s WHERE addr_norm = '') WHERE n <= cap"""
)
def smoke_selection(spark, sf_dir):
    """A few S1 of each country by hash, and a few without an address (a sampling operator)."""
    s1, _ = sides(spark, sf_dir)
    w = Window.partitionBy("cc").orderBy(F.md5(F.concat("s1", F.lit(":smoke"))), "s1")

    def first(rows, reason, n):
        return rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n).select("s1", "cc", F.lit(reason).alias("reason"))

    return first(s1, "hash", 4).unionByName(first(s1.filter("addr_norm = ''"), "missing_address", 2))


@query(KEYS + _N4 + " SELECT cc, gram, df FROM g4df ORDER BY df DESC, cc, gram LIMIT 20")
def ngram_top(spark, sf_dir):
    """The twenty most frequent 4-grams (a top-n report)."""
    return exp.gram_df(sides(spark, sf_dir)[1]).orderBy(F.desc("df"), "cc", "gram").limit(20)


@query("SELECT p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) AS jaro_winkler, levenshtein(p_name, p_type)::INT AS edits FROM part")
def part_similarity(spark, sf_dir):
    """String similarities over a table of natural names."""
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", r6(sim.jaro_winkler_similarity("p_name", "p_type"), "jaro_winkler"), F.levenshtein("p_name", "p_type").alias("edits"))
