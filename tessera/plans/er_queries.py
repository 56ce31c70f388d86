"""Registered entity-resolution queries and the same results as DuckDB SQL.

Records are derived from ``documents`` (``sources.records``); ``POLICY`` holds the
limits, those of the surveyed system.  Doubles are rounded to six places in both engines, as sums come in any
order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import normalize as norm
from tessera.functions import similarity as sim
from tessera.operators import blocking as blk
from tessera.operators import decision as dec
from tessera.operators import evaluation as ev
from tessera.operators import expansion as exp
from tessera.operators import features as feat
from tessera.operators import sampling as smp
from tessera.operators import stats
from tessera.operators.blocking import Policy, passes_sql
from tessera.sources.records import NUMBERED_SQL, RECORDS_SQL, derived_records, numbered_records
from tessera.sources.scratch import kept

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = f"WITH {RECORDS_SQL}, {norm.KEYS_SQL}"
#: The keys of the records of ``part``, which have codes and repeated names.
NUMBERED = f"WITH {NUMBERED_SQL}, {norm.KEYS_SQL}"
#: The limits of the candidate passes, here and in their SQL.
POLICY = Policy()
CAND = f"{KEYS}, {passes_sql(POLICY)}"

#: A small linear logit over features that SQL can express.
DEMO_MODEL = {
    "features": ["exact_name_nosuffix", "exact_address_norm", "name_jaccard", "address_jaccard", "retrieval_pass_count"],
    "mean": [0.0, 0.0, 0.0, 0.0, 0.0],
    "scale": [1.0, 1.0, 1.0, 1.0, 1.0],
    "coefficient": [2.0, 3.0, 2.0, 3.0, 0.5],
    "intercept": -4.0,
}

FEATURES = (
    CAND
    + r""",
fp AS (SELECT c.*, s.name_norm AS an, t.name_norm AS bn, s.name_nosuffix AS ax, t.name_nosuffix AS bx, s.name_sorted AS ao, t.name_sorted AS bo,
  s.addr_norm AS aa, t.addr_norm AS ba, s.cc AS ac, t.cc AS bc,
  list_filter(list_distinct(string_split(s.name_nosuffix, ' ')), lambda x: length(x) > 0) AS aw, list_filter(list_distinct(string_split(t.name_nosuffix, ' ')), lambda x: length(x) > 0) AS bw,
  list_filter(list_distinct(string_split(s.addr_norm, ' ')), lambda x: length(x) > 0) AS av, list_filter(list_distinct(string_split(t.addr_norm, ' ')), lambda x: length(x) > 0) AS bv,
  regexp_extract_all(s.addr_norm, '[0-9]+') AS ar, regexp_extract_all(t.addr_norm, '[0-9]+') AS br,
  regexp_extract(s.addr_norm, '[0-9]{5,6}') AS ap, regexp_extract(t.addr_norm, '[0-9]{5,6}') AS bp
  FROM cand c JOIN s ON c.s1 = s.s1 JOIN t ON c.mid = t.mid),
f AS (SELECT *, len(list_intersect(aw, bw)) AS nin, len(list_distinct(list_concat(aw, bw))) AS nun, len(list_intersect(av, bv)) AS ain, len(list_distinct(list_concat(av, bv))) AS aun,
  bit_count(provenance & 15) AS passes FROM fp),
sc AS (SELECT s1, mid, provenance, source_balanced_rank, name_shared_idf, address_shared_idf, an, bn, aa, ba, ar, br, ap, bp, round(1 / (1 + exp(-(-4.0
  + 2.0 * (ax <> '' AND ax = bx)::INT + 3.0 * (aa <> '' AND aa = ba)::INT + 2.0 * (CASE WHEN nun > 0 THEN nin::DOUBLE / nun ELSE 0 END)
  + 3.0 * (CASE WHEN aun > 0 THEN ain::DOUBLE / aun ELSE 0 END) + 0.5 * passes))), 6) AS score FROM f),
y AS (SELECT sc.*, (gt.mid IS NOT NULL)::INT AS y FROM sc LEFT JOIN gt ON sc.s1 = gt.s1 AND sc.mid = gt.mid),
un AS (SELECT s.s1, s.cc, count(gt.mid) AS truth_n FROM s LEFT JOIN gt ON s.s1 = gt.s1 GROUP BY ALL)"""
)

#: Counts per S1 of a set ``acc`` of accepted pairs, and F0.5, as SQL.
COUNTS = """, ec AS (SELECT un.s1, un.cc, un.truth_n, coalesce(p.pred_n, 0) AS pred_n, coalesce(p.tp, 0) AS tp FROM un LEFT JOIN
  (SELECT acc.s1, count(*) AS pred_n, count(gt.mid) AS tp FROM acc LEFT JOIN gt ON acc.s1 = gt.s1 AND acc.mid = gt.mid GROUP BY acc.s1) p ON un.s1 = p.s1)"""
F05 = "(CASE WHEN truth_n = 0 AND pred_n = 0 THEN 1.0::DOUBLE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 1.25 * tp / (0.25 * truth_n + pred_n) END)"


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def r6(column, name: str):
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name)


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.normalized_keys(derived_records(spark, sf_dir))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = kept(keys(spark, sf_dir), "keys")  # every pass reads them
    return blk.queries_of(k), blk.targets_of(k)


def numbered_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = kept(norm.normalized_keys(numbered_records(spark, sf_dir)), "numbered-keys")
    return blk.queries_of(k), blk.targets_of(k)


def candidate_pairs(spark, sf_dir, **more):
    """s1 rows, targets, candidates; ``more`` is what ``blocking.candidates`` takes."""
    s1, t = sides(spark, sf_dir)
    return s1, t, blk.candidates(s1, t, POLICY, **more)


def scored_pairs(spark, sf_dir, *carry: str):
    """s1 rows, targets, candidates with label, candidate_count, the texts of ``carry`` and the demo score, links."""
    s1, t, cand = candidate_pairs(spark, sf_dir, likeness=True, labels=True, carry=carry)
    rows = feat.provenance_features(cand)
    scored = rows.select(*(c for c in cand.columns if c not in DEMO_MODEL["features"]), F.round(dec.logit_score(DEMO_MODEL), 6).alias("score"))
    return s1, t, scored, blk.truth_links(s1, t)


def labelled(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """With y, 1 for links; scored pairs have it."""
    if "y" in scored.columns:
        return scored
    return scored.join(truth.withColumn("y", F.lit(1)), ["s1", "mid"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def universe(s1: DataFrame, truth: DataFrame) -> DataFrame:
    counts = truth.groupBy("s1").agg(F.count("*").alias("truth_n"))
    return s1.select("s1", "cc").join(counts, "s1", "left").na.fill(0, ["truth_n"])


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- normalisation ---------------------------------------------------------------


@query(KEYS + " SELECT entity_id, src, cc, name_norm, name_nosuffix, name_sorted, name_acronym, addr_norm, array_to_string(num_tokens, ',') AS num_tokens FROM k")
def normalize_keys(spark, sf_dir):
    return keys(spark, sf_dir).drop("truth_key").withColumn("num_tokens", F.array_join("num_tokens", ","))


@query()
def normalize_unicode(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.select("doc_id", F.sha2(norm.unicode_norm("text"), 256).alias("norm_sha256"), F.sha2(norm.fold_accents("text"), 256).alias("folded_sha256"), F.sha2(norm.transliterate("text"), 256).alias("roman_sha256"))


_SUFFIX = ", ".join(f"'{w}'" for w in norm.LEGAL_FORMS)


@query(
    f"""WITH n AS (SELECT 'customer' AS kind, c_name AS raw FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'part', p_name FROM part),
    w AS (SELECT kind, raw, list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(raw), '&', ' and '), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda x: length(x) > 0) AS ws FROM n),
    c AS (SELECT kind, raw, CASE WHEN len(list_filter(ws, lambda x: x NOT IN ({_SUFFIX}))) > 0 THEN list_filter(ws, lambda x: x NOT IN ({_SUFFIX})) ELSE ws END AS cw FROM w)
    SELECT kind, array_to_string(cw, ' ') AS nosuffix, array_to_string(list_sort(list_distinct(cw)), ' ') AS sorted_name,
    CASE WHEN len(cw) >= 2 THEN array_to_string(list_transform(cw, lambda x: x[1]), '') ELSE '' END AS acronym, count(*) AS n FROM c GROUP BY ALL"""
)
def suffix_strip_acronym(spark, sf_dir):
    names = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(c).alias("raw")) for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))]
    rows = reduce(DataFrame.unionByName, names).withColumn("n", norm.ascii_norm(F.col("raw")))
    n = F.col("n")
    return rows.select("kind", norm.nosuffix(n).alias("nosuffix"), norm.sorted_words(n).alias("sorted_name"), norm.acronym(n).alias("acronym")).groupBy("kind", "nosuffix", "sorted_name", "acronym").agg(F.count("*").alias("n"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '\\p{Nd}+'))), ',') AS numbers FROM documents")
def num_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(norm.digit_runs(F.col("text")), ",").alias("numbers"))


@query(
    """WITH c AS (SELECT doc_id, text, (regexp_matches(text, '\\p{Latin}'))::INT AS l, (regexp_matches(text, '[\\x{904}-\\x{939}\\x{958}-\\x{961}]'))::INT AS d FROM documents WHERE text IS NOT NULL)
    SELECT CASE WHEN text = '' THEN 0 WHEN l + d > 1 THEN 3 WHEN l = 1 THEN 1 WHEN d = 1 THEN 2 ELSE 0 END::BIGINT AS script_class,
    CASE WHEN regexp_matches(text, '\\p{Devanagari}') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '\\p{Devanagari}') THEN 'deva' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS script_name,
    count(*) AS n FROM c GROUP BY ALL"""
)
def script_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select(norm.script_class(F.col("text")).cast("long").alias("script_class"), norm.script_name(F.col("text")).alias("script_name")).groupBy("script_class", "script_name").agg(F.count("*").alias("n"))


# --- blocking ----------------------------------------------------------------------


@query(CAND + " SELECT 'name' AS field, cc, tok, df FROM ndf UNION ALL SELECT 'address', cc, tok, df FROM adf")
def token_df(spark, sf_dir):
    _, t = sides(spark, sf_dir)
    return reduce(DataFrame.unionByName, [blk.token_df(t, c).select(F.lit(f).alias("field"), "cc", "tok", "df") for f, c in (("name", "name_nosuffix"), ("address", "addr_norm"))])


def _block(key):
    return lambda spark, sf_dir: blk.exact_block(*sides(spark, sf_dir), key)


for _name, _key in (("block_sorted_name", "name_sorted"), ("block_exact_addr", "addr_norm"), ("block_exact_name", "name_nosuffix")):
    QUERIES[_name] = _block(_key)
    ORACLE_SQL[_name] = KEYS + f" SELECT s.s1, t.mid FROM s JOIN t ON s.cc = t.cc AND s.{_key} = t.{_key} WHERE length(s.{_key}) > 0"


@query(KEYS + " SELECT cc, name_sorted, n_s1, n_targets, n_s1 * n_targets AS pairs FROM (SELECT cc, name_sorted, count(*) AS n_s1 FROM s WHERE length(name_sorted) > 0 GROUP BY ALL) JOIN (SELECT cc, name_sorted, count(*) AS n_targets FROM t GROUP BY ALL) USING (cc, name_sorted)")
def volume_by_key(spark, sf_dir):
    return blk.block_volumes(*sides(spark, sf_dir), "name_sorted")


@query(
    KEYS
    + """ SELECT cc, count(*) AS n_keys, sum(a.n * b.n)::BIGINT AS total_pairs, max(a.n * b.n) AS largest_key FROM (SELECT cc, name_nosuffix, count(*) AS n FROM s WHERE length(name_nosuffix) > 0 GROUP BY ALL) a
    JOIN (SELECT cc, name_nosuffix, count(*) AS n FROM t GROUP BY ALL) b USING (cc, name_nosuffix) GROUP BY cc"""
)
def join_size_estimate(spark, sf_dir):
    return blk.join_size(*sides(spark, sf_dir), "name_nosuffix")


@query(
    KEYS
    + """ SELECT count(*) AS keys, count(*) FILTER (WHERE sorted_pairs < exact_pairs) AS violations, coalesce(sum(sorted_pairs), 0)::BIGINT AS sorted_pairs, coalesce(sum(exact_pairs), 0)::BIGINT AS exact_pairs FROM (
    SELECT s1, count(*) FILTER (WHERE s.name_sorted = t.name_sorted) AS sorted_pairs, count(*) FILTER (WHERE s.name_nosuffix = t.name_nosuffix) AS exact_pairs
    FROM s JOIN t ON s.cc = t.cc AND s.name_sorted = t.name_sorted WHERE length(s.name_sorted) > 0 GROUP BY s1)"""
)
def block_containment(spark, sf_dir):
    """Every exact-name pair is a sorted-name pair: counted per s1, not asserted."""
    s1, t = sides(spark, sf_dir)
    pairs = blk.exact_block(s1, t, "name_sorted").withColumn("x", F.lit(0)).unionByName(blk.exact_block(s1, t, "name_nosuffix").withColumn("x", F.lit(1)))
    per = pairs.groupBy("s1").agg(F.count_if(F.col("x") == 0).alias("a"), F.count_if(F.col("x") == 1).alias("b"))
    return per.agg(F.count("*").alias("keys"), F.count_if(F.col("a") < F.col("b")).alias("violations"), F.coalesce(F.sum("a"), F.lit(0)).alias("sorted_pairs"), F.coalesce(F.sum("b"), F.lit(0)).alias("exact_pairs"))


_RANKED = ["s1", "mid", "shared", "score", "both_pass", "postal_shared", "numeric_shared", "exact_name", "exact_addr", "coverage_s1", "coverage_target", "jaccard", "source_rank"]
_RANK_SQL = "s1, mid, shared, round(score, 6) AS score, both_pass, postal_shared, numeric_shared, exact_name, exact_addr, round(coverage_s1, 6) AS coverage_s1, round(coverage_target, 6) AS coverage_target, round(jaccard, 6) AS jaccard, source_rank"


def _rank_columns(df):
    return df.select("field", *(r6(c, c) if c in ("score", "coverage_s1", "coverage_target", "jaccard") else c for c in _RANKED))


@query(CAND + " SELECT s1, mid, shared, round(score, 6) AS score FROM nshort")
def token_pass_name(spark, sf_dir):
    s1, t = sides(spark, sf_dir)
    return blk.shortlist(blk.token_scores(s1, t, "name_nosuffix", POLICY.df_cap), POLICY.shortlist).select("s1", "mid", "shared", r6("score", "score"))


@query(CAND + " SELECT s1, mid, shared, round(score, 6) AS score FROM ashort")
def token_pass_addr(spark, sf_dir):
    s1, t = sides(spark, sf_dir)
    return blk.shortlist(blk.token_scores(s1, t, "addr_norm", POLICY.df_cap), POLICY.shortlist).select("s1", "mid", "shared", r6("score", "score"))


@query(CAND + f" SELECT 'name' AS field, {_RANK_SQL} FROM nrank UNION ALL SELECT 'address', {_RANK_SQL} FROM arank")
def evidence_rank(spark, sf_dir):
    return _rank_columns(blk.all_ranks(blk.token_evidence(*sides(spark, sf_dir), POLICY)))


@query(
    CAND
    + """ SELECT s1, mid, source_rank, row_number() OVER (PARTITION BY s1 ORDER BY both_pass DESC, postal_shared DESC, numeric_shared DESC, exact_name DESC, exact_addr DESC,
    round(score, 12) DESC, shared DESC, coverage_s1 DESC, coverage_target DESC, jaccard DESC, mid) AS joint_rank FROM nrank"""
)
def joint_rank(spark, sf_dir):
    return blk.joint_rank(blk.token_pass(*sides(spark, sf_dir), POLICY)[0]).select("s1", "mid", "source_rank", "joint_rank")


#: The blocks of the derived records are small below sf0.1, so here heavy begins at 8, and
#: the token passes keep few of the pairs that the cap would spare.
_HEAVY = Policy(df_cap=20, shortlist=20, s2_quota=1, s3_quota=1, heavy_block=8, heavy_cap=5)


@query(f"{KEYS}, {passes_sql(_HEAVY)} SELECT s1, mid, block, heavy_rank, heavy_rank <= {_HEAVY.heavy_cap} AS within_cap FROM hv")
def heavy_cap(spark, sf_dir):
    """Ranks within heavy blocks, where a block is heavy from 8 targets and capped at 5."""
    s1, t = sides(spark, sf_dir)
    return blk.heavy_ranks(s1, t, _HEAVY).withColumn("within_cap", F.col("heavy_rank") <= _HEAVY.heavy_cap)


@query(f"{KEYS}, {passes_sql(_HEAVY)} SELECT s1, mid, provenance, heavy_sorted_block FROM cand")
def heavy_union(spark, sf_dir):
    """The union of the passes under the policy of ``heavy_cap``: its cap drops pairs."""
    return blk.candidates(*sides(spark, sf_dir), _HEAVY).select("s1", "mid", "provenance", "heavy_sorted_block")


_DYN = """, dk AS (SELECT s.s1, coalesce(a.n, 0) AS sorted_n, coalesce(b.n, 0) AS addr_n, coalesce(c.n, 0) AS both_n FROM s LEFT JOIN (SELECT s1, count(*) AS n FROM srt GROUP BY s1) a ON s.s1 = a.s1
  LEFT JOIN (SELECT s1, count(*) AS n FROM xad GROUP BY s1) b ON s.s1 = b.s1 LEFT JOIN (SELECT s1, count(*) AS n FROM srt JOIN xad USING (s1, mid) GROUP BY s1) c ON s.s1 = c.s1),
dkk AS (SELECT *, (CASE WHEN both_n > 0 THEN 25 WHEN addr_n > 0 OR sorted_n BETWEEN 1 AND 5 THEN 50 ELSE 75 END)::BIGINT AS k FROM dk)"""


@query(CAND + _DYN + " SELECT s1, sorted_n, addr_n, both_n, k FROM dkk")
def dynamic_k(spark, sf_dir):
    s1, t = sides(spark, sf_dir)
    return blk.dynamic_k(s1, blk.exact_block(s1, t, "name_sorted"), blk.exact_block(s1, t, "addr_norm"))


@query(CAND + " SELECT s1, mid, provenance, name_token_rank, address_token_rank, source_balanced_rank, heavy_sorted_block, round(name_shared_idf, 6) AS name_shared_idf, round(address_shared_idf, 6) AS address_shared_idf FROM cand")
def policy_union(spark, sf_dir):
    cand = candidate_pairs(spark, sf_dir)[2]
    return cand.withColumns({c: F.round(c, 6) for c in ("name_shared_idf", "address_shared_idf")})


_POLICIES = {f"joint_{n}": f"joint_rank <= {n}" for n in (75, 100, 150, 200)} | {
    f"source_{a}_{b}": f"source_rank <= CASE WHEN substr(mid, 1, 2) = 'S2' THEN {a} ELSE {b} END" for a, b in ((37, 38), (49, 51), (50, 50), (75, 75))
}


def _policy_sets(spark, sf_dir):
    """policy, s1, mid of several rank policies over both token passes."""
    s1, t = sides(spark, sf_dir)
    ranked = [blk.joint_rank(p).select("s1", "mid", "source_rank", "joint_rank") for p in blk.token_pass(s1, t, POLICY)]
    every = ranked[0].unionByName(ranked[1])
    return s1, t, reduce(DataFrame.unionByName, [every.filter(cond).select(F.lit(name).alias("policy"), "s1", "mid").distinct() for name, cond in _POLICIES.items()])


_JOINT = """, jr AS (SELECT s1, mid, source_rank, row_number() OVER (PARTITION BY fld, s1 ORDER BY both_pass DESC, postal_shared DESC, numeric_shared DESC, exact_name DESC, exact_addr DESC,
  round(score, 12) DESC, shared DESC, coverage_s1 DESC, coverage_target DESC, jaccard DESC, mid) AS joint_rank FROM (SELECT 1 AS fld, * FROM nrank UNION ALL SELECT 2, * FROM arank)),
ps AS (""" + " UNION ALL ".join(f"SELECT DISTINCT '{n}' AS policy, s1, mid FROM jr WHERE {c}" for n, c in _POLICIES.items()) + ")"
_POLICY_FIGURES = """, pf AS (SELECT ps.policy, count(*) AS candidates, count(gt.mid) AS recovered FROM ps LEFT JOIN gt ON ps.s1 = gt.s1 AND ps.mid = gt.mid GROUP BY ps.policy),
pq AS (SELECT q.policy, avg(n) AS mean_n, quantile_cont(n, 0.99) AS p99 FROM (SELECT x.policy, s.s1, count(ps.mid) AS n FROM s CROSS JOIN (SELECT DISTINCT policy FROM ps) x LEFT JOIN ps ON ps.s1 = s.s1 AND ps.policy = x.policy GROUP BY ALL) q GROUP BY q.policy)"""


def _policy_figures(spark, sf_dir):
    s1, t, sets = _policy_sets(spark, sf_dir)
    truth = blk.truth_links(s1, t).withColumn("hit", F.lit(1))
    figures = sets.join(truth, ["s1", "mid"], "left").groupBy("policy").agg(F.count("*").alias("candidates"), F.count("hit").alias("recovered"))
    names = F.explode(F.array(*(F.lit(p) for p in _POLICIES))).alias("policy")
    per = s1.select("s1", names).join(sets.groupBy("policy", "s1").agg(F.count("*").alias("n")), ["policy", "s1"], "left").na.fill(0)
    return figures.join(per.groupBy("policy").agg(r6(F.avg("n"), "mean_n"), r6(F.expr("percentile(n, 0.99D)"), "p99")), "policy")


@query(CAND + _JOINT + _POLICY_FIGURES + " SELECT policy, candidates, recovered, round(mean_n, 6) AS mean_n, round(p99, 6) AS p99 FROM pf JOIN pq USING (policy)")
def policy_compare(spark, sf_dir):
    return _policy_figures(spark, sf_dir)


@query(
    CAND
    + _JOINT
    + _POLICY_FIGURES
    + """, pt AS (SELECT policy, candidates, recovered, round(mean_n, 6) AS mean_n, round(p99, 6) AS p99 FROM pf JOIN pq USING (policy))
    SELECT a.policy, a.recovered, a.candidates FROM pt a WHERE NOT EXISTS (SELECT 1 FROM pt b WHERE b.policy <> a.policy AND b.recovered >= a.recovered AND b.mean_n <= a.mean_n AND b.p99 <= a.p99
    AND (b.recovered > a.recovered OR b.mean_n < a.mean_n OR b.p99 < a.p99))"""
)
def pareto_frontier(spark, sf_dir):
    return exp.pareto_frontier(_policy_figures(spark, sf_dir), "policy", ["recovered"], ["mean_n", "p99"]).select("policy", "recovered", "candidates")


@query(
    CAND
    + _JOINT
    + """ SELECT CASE WHEN a.s1 IS NULL THEN 'only_b' WHEN b.s1 IS NULL THEN 'only_a' ELSE 'both' END AS side, count(*) AS n
    FROM (SELECT s1, mid FROM ps WHERE policy = 'joint_100') a FULL JOIN (SELECT s1, mid FROM ps WHERE policy = 'source_50_50') b ON a.s1 = b.s1 AND a.mid = b.mid GROUP BY ALL"""
)
def identity_diff(spark, sf_dir):
    sets = _policy_sets(spark, sf_dir)[2]
    return ev.identity_difference(sets.filter("policy = 'joint_100'"), sets.filter("policy = 'source_50_50'"))


@query(CAND + _JOINT + " SELECT s1, mid FROM ps WHERE policy = 'joint_100' EXCEPT SELECT s1, mid FROM ps WHERE policy = 'source_50_50'")
def policy_except(spark, sf_dir):
    sets = _policy_sets(spark, sf_dir)[2]
    return sets.filter("policy = 'joint_100'").select("s1", "mid").subtract(sets.filter("policy = 'source_50_50'").select("s1", "mid"))


@query(CAND + _JOINT + " SELECT s1, mid FROM ps WHERE policy = 'joint_100' INTERSECT SELECT s1, mid FROM ps WHERE policy = 'source_50_50'")
def policy_intersect(spark, sf_dir):
    sets = _policy_sets(spark, sf_dir)[2]
    return sets.filter("policy = 'joint_100'").select("s1", "mid").intersect(sets.filter("policy = 'source_50_50'").select("s1", "mid"))


@query(
    CAND
    + """ SELECT variant, s1, mid FROM (SELECT 'idf' AS variant, s1, mid, row_number() OVER (PARTITION BY s1 ORDER BY round(score, 12) DESC, shared DESC, mid) AS rk, 100 AS cap FROM nscore
    UNION ALL SELECT 'balanced', s1, mid, row_number() OVER (PARTITION BY s1, substr(mid, 1, 2) ORDER BY round(score, 12) DESC, shared DESC, mid), 50 FROM nscore
    UNION ALL SELECT 'idf_coverage', n.s1, n.mid, row_number() OVER (PARTITION BY n.s1 ORDER BY round(score + 2.0 * shared / least(len(list_distinct(string_split(s.name_nosuffix, ' '))), len(list_distinct(string_split(t.name_nosuffix, ' ')))), 12) DESC, shared DESC, n.mid), 100
      FROM nscore n JOIN s ON n.s1 = s.s1 JOIN t ON n.mid = t.mid
    UNION ALL SELECT 'dynamic', n.s1, n.mid, row_number() OVER (PARTITION BY n.s1 ORDER BY round(score, 12) DESC, shared DESC, n.mid), CASE WHEN EXISTS (SELECT 1 FROM srt WHERE srt.s1 = n.s1) THEN 50 WHEN EXISTS (SELECT 1 FROM xad WHERE xad.s1 = n.s1) THEN 100 ELSE 200 END FROM nscore n) WHERE rk <= cap"""
)
def refinement_variants(spark, sf_dir):
    s1, t = sides(spark, sf_dir)
    scores = kept(blk.token_scores(s1, t, "name_nosuffix", POLICY.df_cap), "scores")
    order = [F.desc("shared"), F.asc("mid")]
    base = F.round("score", 12).desc()
    per, src = Window.partitionBy("s1"), Window.partitionBy("s1", blk.source_of())

    def variant(rows, name, window, first, cap):
        return rows.withColumn("rk", F.row_number().over(window.orderBy(first, *order))).filter(F.col("rk") <= cap).select(F.lit(name).alias("variant"), "s1", "mid")

    n = lambda side: F.size(F.array_distinct(F.split("name_nosuffix", " "))).alias(side)
    covered = scores.join(s1.select("s1", n("n1")), "s1").join(t.select("mid", n("n2")), "mid")
    hits = lambda key, name: blk.exact_block(s1, t, key).select("s1", F.lit(1).alias(name)).distinct()
    banded = scores.join(hits("name_sorted", "x"), "s1", "left").join(hits("addr_norm", "z"), "s1", "left")
    cap = F.when(F.col("x") == 1, 50).when(F.col("z") == 1, 100).otherwise(200)
    coverage = F.round(F.col("score") + 2.0 * F.col("shared") / F.least("n1", "n2"), 12).desc()
    return reduce(DataFrame.unionByName, [variant(scores, "idf", per, base, 100), variant(scores, "balanced", src, base, 50), variant(covered, "idf_coverage", per, coverage, 100), variant(banded, "dynamic", per, base, cap)])


# --- losses and reports ---------------------------------------------------------------

#: Losses are reported under the limits in force and under two that lose links.
LOSSY = {
    "reference": POLICY,
    "rare_words": Policy(df_cap=4, shortlist=5, s2_quota=1, s3_quota=1, heavy_block=8, heavy_cap=1),
    "short_quota": Policy(df_cap=20, shortlist=5, s2_quota=1, s3_quota=1, heavy_block=8, heavy_cap=1),
}

_LOSS = """, go AS (SELECT gt.s1, gt.mid, s.cc, s.addr_norm AS sa, t.addr_norm AS ta, s.name_norm AS sn, t.name_norm AS tn, s.name_sorted <> '' AND s.name_sorted = t.name_sorted AS sorted_ok, s.addr_norm <> '' AND s.addr_norm = t.addr_norm AS addr_ok,
  coalesce(n.shared, 0) AS name_n, coalesce(a.shared, 0) AS addr_n, (SELECT count(*) FROM t z WHERE z.cc = s.cc AND z.name_sorted = s.name_sorted) AS key_n,
  list_filter(list_intersect(string_split(s.name_nosuffix, ' '), string_split(t.name_nosuffix, ' ')), lambda x: x <> '') AS nw, list_filter(list_intersect(string_split(s.addr_norm, ' '), string_split(t.addr_norm, ' ')), lambda x: x <> '') AS aw,
  list_distinct(list_concat(string_split(s.addr_norm, ' '), string_split(t.addr_norm, ' '))) AS au
  FROM gt JOIN s ON gt.s1 = s.s1 JOIN t ON gt.mid = t.mid LEFT JOIN nscore n ON gt.s1 = n.s1 AND gt.mid = n.mid LEFT JOIN ascore a ON gt.s1 = a.s1 AND gt.mid = a.mid),
gl AS (SELECT go.*, CASE WHEN c.s1 IS NOT NULL THEN 'found' WHEN sorted_ok OR addr_ok OR name_n > 0 OR addr_n > 0 THEN 'cap_or_rank' WHEN len(nw) + len(aw) > 0 THEN 'df_above_cutoff' ELSE 'no_key' END AS outcome FROM go LEFT JOIN cand c ON go.s1 = c.s1 AND go.mid = c.mid)"""


def _each_policy(select: str) -> str:
    """A query on ``gl`` under every lossy policy, the policy's name first."""
    return " UNION ALL ".join(f"SELECT '{name}' AS policy, * FROM ({KEYS}, {passes_sql(policy)}{_LOSS} {select})" for name, policy in LOSSY.items())


def loss_rows(s1: DataFrame, t: DataFrame, policy: Policy) -> DataFrame:
    """Links with their eligible passes and what became of them under a policy."""
    cand = blk.candidates(s1, t, policy)
    key = F.col("name_sorted")
    sizes = t.filter(key != "").groupBy("cc", "name_sorted").agg(F.count("*").alias("key_n"))
    left = s1.join(sizes, ["cc", "name_sorted"], "left").select("s1", "cc", key.alias("so"), F.col("addr_norm").alias("sa"), F.col("name_norm").alias("sn"), F.col("name_nosuffix").alias("sx"), F.coalesce("key_n", F.lit(0)).alias("key_n"))
    right = t.select("mid", key.alias("to"), F.col("addr_norm").alias("ta"), F.col("name_norm").alias("tn"), F.col("name_nosuffix").alias("tx"))
    pair = blk.truth_links(s1, t).join(left, "s1").join(right, "mid")
    for field, name in (("name_nosuffix", "name_n"), ("addr_norm", "addr_n")):
        pair = pair.join(blk.token_scores(s1, t, field, policy.df_cap).select("s1", "mid", F.col("shared").alias(name)), ["s1", "mid"], "left")
    pair = pair.na.fill(0, ["name_n", "addr_n"]).withColumn("sorted_ok", (F.col("so") != "") & (F.col("so") == F.col("to"))).withColumn("addr_ok", (F.col("sa") != "") & (F.col("sa") == F.col("ta")))
    common = lambda a, b: F.size(F.array_intersect(norm.words(F.col(a)), norm.words(F.col(b))))
    found = cand.select("s1", "mid", F.lit(1).alias("found"))
    outcome = (
        F.when(F.col("found") == 1, "found")
        .when(F.col("sorted_ok") | F.col("addr_ok") | (F.col("name_n") > 0) | (F.col("addr_n") > 0), "cap_or_rank")
        .when(common("sx", "tx") + common("sa", "ta") > 0, "df_above_cutoff")
        .otherwise("no_key")
    )
    return pair.join(found, ["s1", "mid"], "left").withColumn("outcome", outcome)


def _loss(spark, sf_dir):
    """``loss_rows`` of every lossy policy."""
    s1, t = sides(spark, sf_dir)
    return reduce(DataFrame.unionByName, [kept(loss_rows(s1, t, policy), "losses").withColumn("policy", F.lit(name)) for name, policy in LOSSY.items()])


def _band(c):
    return F.when(F.col(c) >= 3, "3+").otherwise(F.col(c).cast("string"))


@query(_each_policy("SELECT outcome, cc, substr(mid, 1, 2) AS source, CASE WHEN sa = '' AND ta = '' THEN 'both_missing' WHEN sa = '' THEN 's1_missing' WHEN ta = '' THEN 'target_missing' ELSE 'both_present' END AS address, count(*) AS links FROM gl GROUP BY ALL"))
def retrieval_loss(spark, sf_dir):
    sa, ta = F.col("sa") == "", F.col("ta") == ""
    address = F.when(sa & ta, "both_missing").when(sa, "s1_missing").when(ta, "target_missing").otherwise("both_present")
    return _loss(spark, sf_dir).groupBy("policy", "outcome", "cc", blk.source_of().alias("source"), address.alias("address")).agg(F.count("*").alias("links"))


@query(
    _each_policy(
        """SELECT outcome, CASE WHEN name_n >= 3 THEN '3+' ELSE name_n::VARCHAR END AS name_band, CASE WHEN addr_n >= 3 THEN '3+' ELSE addr_n::VARCHAR END AS addr_band,
    CASE WHEN len(au) = 0 OR len(aw) = 0 THEN 'none' WHEN len(aw)::DOUBLE / len(au) >= 0.75 THEN 'high' WHEN len(aw)::DOUBLE / len(au) >= 0.4 THEN 'middle' ELSE 'low' END AS likeness,
    CASE WHEN key_n > 20 THEN '21+' WHEN key_n > 5 THEN '6-20' WHEN key_n > 0 THEN '1-5' ELSE '0' END AS key_frequency,
    CASE WHEN regexp_matches(sn, '[a-z]') THEN 1 ELSE 0 END || ':' || CASE WHEN regexp_matches(tn, '[a-z]') THEN 1 ELSE 0 END AS scripts, count(*) AS links FROM gl GROUP BY ALL"""
    )
)
def lost_pair_anatomy(spark, sf_dir):
    """Links by outcome, shared words, likeness of addresses, frequency of the name key and scripts."""
    a, b = F.split("sa", " "), F.split("ta", " ")
    common, union = F.size(F.array_intersect(norm.words(F.col("sa")), norm.words(F.col("ta")))), F.size(F.array_union(a, b))
    j = common / F.greatest(union, F.lit(1))
    likeness = F.when(common == 0, "none").when(j >= 0.75, "high").when(j >= 0.4, "middle").otherwise("low")
    n = F.col("key_n")
    frequency = F.when(n > 20, "21+").when(n > 5, "6-20").when(n > 0, "1-5").otherwise("0")
    scripts = F.concat_ws(":", *(norm.script_class(F.col(c)).cast("string") for c in ("sn", "tn")))
    return _loss(spark, sf_dir).groupBy("policy", "outcome", _band("name_n").alias("name_band"), _band("addr_n").alias("addr_band"), likeness.alias("likeness"), frequency.alias("key_frequency"), scripts.alias("scripts")).agg(F.count("*").alias("links"))


@query(_each_policy("SELECT CASE WHEN name_n > 0 AND addr_n > 0 THEN 'both' WHEN name_n > 0 THEN 'name_only' WHEN addr_n > 0 THEN 'address_only' ELSE 'neither' END AS passes, count(*) AS links, count(*) FILTER (WHERE outcome <> 'found') AS lost FROM gl GROUP BY ALL"))
def pass_attribution(spark, sf_dir):
    passes = F.when((F.col("name_n") > 0) & (F.col("addr_n") > 0), "both").when(F.col("name_n") > 0, "name_only").when(F.col("addr_n") > 0, "address_only").otherwise("neither")
    return _loss(spark, sf_dir).groupBy("policy", passes.alias("passes")).agg(F.count("*").alias("links"), F.count_if(F.col("outcome") != "found").alias("lost"))


@query(CAND + " SELECT provenance, count(*) AS candidates, count(gt.mid) AS links FROM cand LEFT JOIN gt ON cand.s1 = gt.s1 AND cand.mid = gt.mid GROUP BY provenance")
def provenance_yield(spark, sf_dir):
    s1, t, cand = candidate_pairs(spark, sf_dir)
    return cand.join(blk.truth_links(s1, t).withColumn("hit", F.lit(1)), ["s1", "mid"], "left").groupBy("provenance").agg(F.count("*").alias("candidates"), F.count("hit").alias("links"))


@query(
    KEYS
    + """, sk AS (SELECT k1.cc, k1.name_sorted, k1.n_s1, (SELECT count(*) FROM t WHERE t.cc = k1.cc AND t.name_sorted = k1.name_sorted) AS n_targets FROM (SELECT cc, name_sorted, count(*) AS n_s1 FROM s WHERE length(name_sorted) > 0 GROUP BY ALL) k1)
    SELECT cc, count(*) AS keys, median(n_targets) AS median_targets, round(quantile_cont(n_targets, 0.95), 6) AS p95, round(quantile_cont(n_targets, 0.99), 6) AS p99, max(n_targets) AS most FROM sk GROUP BY cc"""
)
def heavy_key_report(spark, sf_dir):
    s1, t = sides(spark, sf_dir)
    per = s1.filter(F.length("name_sorted") > 0).select("cc", "name_sorted").distinct().join(t.groupBy("cc", "name_sorted").agg(F.count("*").alias("n")), ["cc", "name_sorted"], "left").na.fill(0, ["n"])
    return per.groupBy("cc").agg(F.count("*").alias("keys"), F.median("n").alias("median_targets"), r6(F.expr("percentile(n, 0.95D)"), "p95"), r6(F.expr("percentile(n, 0.99D)"), "p99"), F.max("n").alias("most"))


@query(
    KEYS
    + """, d AS (SELECT s.s1, t.mid, len(list_intersect(list_distinct(string_split(s.addr_norm, ' ')), list_distinct(string_split(t.addr_norm, ' '))))::DOUBLE / len(list_distinct(list_concat(string_split(s.addr_norm, ' '), string_split(t.addr_norm, ' ')))) AS j,
    (s.name_sorted = t.name_sorted)::INT AS found FROM gt JOIN s ON gt.s1 = s.s1 JOIN t ON gt.mid = t.mid)
    SELECT CASE WHEN j >= 0.75 THEN 'high' WHEN j >= 0.4 THEN 'middle' ELSE 'low' END AS band, count(*) AS links, sum(found)::BIGINT AS found FROM d GROUP BY ALL"""
)
def address_conversion(spark, sf_dir):
    """Links found by sorted name, by similarity of their addresses."""
    s1, t = sides(spark, sf_dir)
    rows = feat.paired(blk.truth_links(s1, t), s1, t)
    j = sim.jaccard(F.array_distinct(F.split("a_addr_norm", " ")), F.array_distinct(F.split("b_addr_norm", " ")))
    band = F.when(j >= 0.75, "high").when(j >= 0.4, "middle").otherwise("low")
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("links"), F.sum((F.col("a_name_sorted") == F.col("b_name_sorted")).cast("long")).alias("found"))


# --- further passes ---------------------------------------------------------------------

_GRAMS = "list_distinct(list_transform(range(1, length({f}) - 2), lambda i: substr({f}, i, 4)))"
_N4 = (
    """, tg4 AS (SELECT mid, cc, unnest("""
    + _GRAMS.format(f="name_norm")
    + """) AS gram FROM t WHERE length(name_norm) BETWEEN 4 AND 64),
g4df AS (SELECT cc, gram, count(*) AS df FROM tg4 GROUP BY ALL),
tot AS (SELECT count(*)::DOUBLE AS n FROM t),
sg4 AS (SELECT s1, cc, unnest("""
    + _GRAMS.format(f="name_norm")
    + """) AS gram FROM s WHERE length(name_norm) BETWEEN 4 AND 64),
sel4 AS (SELECT * FROM (SELECT s1, cc, gram, df, row_number() OVER (PARTITION BY s1 ORDER BY df, gram) AS kr FROM sg4 JOIN g4df USING (cc, gram) WHERE df <= 1000) WHERE kr <= 4),
hit4 AS (SELECT s1, mid, count(*) AS shared, sum(ln(1.0 + tot.n / df)) AS evidence FROM sel4 JOIN tg4 USING (cc, gram) CROSS JOIN tot GROUP BY s1, mid),
name4r AS (SELECT *, row_number() OVER (PARTITION BY s1, substr(mid, 1, 2) ORDER BY round(evidence, 9) DESC, shared DESC, mid) AS source_rank FROM hit4),
name4 AS (SELECT * FROM name4r WHERE source_rank <= 25)"""
)


@query(KEYS + _N4 + " SELECT cc, gram, df FROM g4df")
def ngram_df(spark, sf_dir):
    return exp.gram_df(sides(spark, sf_dir)[1])


@query(KEYS + _N4 + " SELECT s1, mid, shared, round(evidence, 6) AS evidence, source_rank FROM name4")
def name4_pass(spark, sf_dir):
    s1, t = sides(spark, sf_dir)
    return exp.gram_pass(s1, t, "name_norm", cap=1000, quota=25).withColumn("evidence", F.round("evidence", 6))


@query(
    KEYS
    + """, ta4 AS (SELECT mid, cc, unnest("""
    + _GRAMS.format(f="addr_norm")
    + """) AS gram FROM t WHERE length(addr_norm) BETWEEN 4 AND 96), a4df AS (SELECT cc, gram, count(*) AS df FROM ta4 GROUP BY ALL), tot AS (SELECT count(*)::DOUBLE AS n FROM t),
    sa4 AS (SELECT s1, cc, unnest("""
    + _GRAMS.format(f="addr_norm")
    + """) AS gram FROM s WHERE length(addr_norm) BETWEEN 4 AND 96),
    sel AS (SELECT * FROM (SELECT s1, cc, gram, df, row_number() OVER (PARTITION BY s1 ORDER BY df, gram) AS kr FROM sa4 JOIN a4df USING (cc, gram) WHERE df <= 200) WHERE kr <= 4),
    hit AS (SELECT s1, mid, count(*) AS shared, sum(ln(1.0 + tot.n / df)) AS evidence FROM sel JOIN ta4 USING (cc, gram) CROSS JOIN tot GROUP BY s1, mid)
    SELECT s1, mid, shared, round(evidence, 6) AS evidence, source_rank FROM (SELECT h.*, row_number() OVER (PARTITION BY h.s1, substr(h.mid, 1, 2) ORDER BY round(evidence, 9) DESC, shared DESC, round(jaro_winkler_similarity(s.name_norm, t.name_norm), 9) DESC, h.mid) AS source_rank
    FROM hit h JOIN s ON h.s1 = s.s1 JOIN t ON h.mid = t.mid) WHERE source_rank <= 15"""
)
def address4_pass(spark, sf_dir):
    s1, t = sides(spark, sf_dir)
    return exp.gram_pass(s1, t, "addr_norm", cap=200, quota=15, high=96, tie="name_norm").withColumn("evidence", F.round("evidence", 6))


def _key_pass_sql(key: str, cap: int, quota: int, keys: str = KEYS) -> str:
    return (
        keys
        + f""", tk AS (SELECT mid, cc, name_norm AS n2, addr_norm AS a2, unnest({key}) AS ky FROM t), kdf AS (SELECT cc, ky, count(*) AS df FROM tk GROUP BY ALL),
    sk AS (SELECT * FROM (SELECT x.*, df, row_number() OVER (PARTITION BY s1 ORDER BY df, ky) AS kr FROM (SELECT s1, cc, name_norm AS n1, addr_norm AS a1, unnest({key}) AS ky FROM s) x JOIN kdf USING (cc, ky) WHERE df <= {cap}) WHERE kr = 1),
    h AS (SELECT s1, mid, max(round(jaro_winkler_similarity(n1, n2), 9)) AS name_similarity, max(round(CASE WHEN a1 <> '' AND a2 <> '' THEN jaro_winkler_similarity(a1, a2) ELSE 0.0 END, 9)) AS address_similarity, min(df) AS key_df FROM sk JOIN tk USING (cc, ky) GROUP BY s1, mid)
    SELECT s1, mid, round(name_similarity, 6) AS name_similarity, round(address_similarity, 6) AS address_similarity, key_df, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY s1, substr(mid, 1, 2) ORDER BY name_similarity DESC, address_similarity DESC, key_df, mid) AS source_rank FROM h) WHERE source_rank <= {quota}"""
    )


def _six(df):
    return df.withColumns({c: F.round(c, 6) for c in ("name_similarity", "address_similarity")})


@query(_key_pass_sql("CASE WHEN length(name_acronym) BETWEEN 3 AND 12 THEN [name_acronym] ELSE [] END", 200, 10))
def acronym_pass(spark, sf_dir):
    return _six(exp.key_pass(*sides(spark, sf_dir), exp.acronym_key(), 200, 10))


@query(_key_pass_sql("list_filter(num_tokens, lambda x: length(x) BETWEEN 4 AND 6)", 200, 10, NUMBERED))
def postal_numeric_pass(spark, sf_dir):
    return _six(exp.key_pass(*numbered_sides(spark, sf_dir), exp.numeric_key(), 200, 10))


@query(KEYS + " SELECT cc, x.src, length(n) AS digits, count(*) AS n FROM (SELECT src, cc, unnest(num_tokens) AS n FROM k) x WHERE length(n) BETWEEN 1 AND 3 GROUP BY ALL")
def house_number_profile(spark, sf_dir):
    rows = keys(spark, sf_dir).select("src", "cc", F.explode("num_tokens").alias("n")).filter(F.length("n").between(1, 3))
    return rows.groupBy("cc", "src", F.length("n").cast("long").alias("digits")).agg(F.count("*").alias("n"))


_SEED_ORDER = "source_balanced_rank ASC NULLS LAST, round(name_shared_idf, 12) DESC NULLS LAST, round(address_shared_idf, 12) DESC NULLS LAST, mid"


def _sister_sql(seed_cte: str, quota: int) -> str:
    return (
        CAND
        + _N4
        + f""", {seed_cte},
    qg AS (SELECT DISTINCT seeds.s1, seeds.seed, t.cc, g.gram FROM seeds JOIN t ON seeds.seed = t.mid JOIN tg4 g ON g.mid = t.mid),
    qsel AS (SELECT * FROM (SELECT qg.*, df, row_number() OVER (PARTITION BY s1, seed ORDER BY df, gram) AS kr FROM qg JOIN g4df USING (cc, gram) WHERE df <= 1000) WHERE kr <= 4),
    qh AS (SELECT s1, tg4.mid, count(*) AS shared, sum(ln(1.0 + tot.n / df)) AS evidence, count(DISTINCT seed) AS contributing_seeds FROM qsel JOIN tg4 USING (cc, gram) CROSS JOIN tot WHERE substr(tg4.mid, 1, 2) <> substr(seed, 1, 2) GROUP BY s1, tg4.mid)
    SELECT s1, mid, shared, round(evidence, 6) AS evidence, contributing_seeds, s1_rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY contributing_seeds DESC, round(evidence, 9) DESC, shared DESC, mid) AS s1_rank FROM qh) WHERE s1_rank <= {quota}"""
    )


@query(_sister_sql(f"seeds AS (SELECT s1, mid AS seed FROM (SELECT s1, mid, row_number() OVER (PARTITION BY s1 ORDER BY {_SEED_ORDER}) AS sr FROM cand) WHERE sr <= 1)", 10))
def sister_single(spark, sf_dir):
    _, t, cand = candidate_pairs(spark, sf_dir)
    return exp.sister_pass(exp.best_seeds(cand, 1), t, cap=1000, quota=10).withColumn("evidence", F.round("evidence", 6))


@query(
    _sister_sql(
        f"""own AS (SELECT *, row_number() OVER (PARTITION BY s1, substr(mid, 1, 2) ORDER BY {_SEED_ORDER}) AS o FROM cand),
    seeds AS (SELECT s1, mid AS seed FROM (SELECT s1, mid, row_number() OVER (PARTITION BY s1 ORDER BY o, {_SEED_ORDER}) AS sr FROM own WHERE o <= 2) WHERE sr <= 3)""",
        15,
    )
)
def sister_multi(spark, sf_dir):
    _, t, cand = candidate_pairs(spark, sf_dir)
    return exp.sister_pass(exp.interleaved_seeds(cand, 2, 3), t, cap=1000, quota=15).withColumn("evidence", F.round("evidence", 6))


@query(
    f"{NUMBERED}, {passes_sql(POLICY)}"
    + """, sd AS (SELECT s1, mid AS seed FROM (SELECT s1, mid, row_number() OVER (PARTITION BY s1 ORDER BY mid) AS sr FROM cand WHERE (provenance & 2) > 0 AND (provenance & 12) > 0 AND (provenance & 1) = 0) WHERE sr <= 3),
    ky AS (SELECT mid, cc, name_sorted, src FROM t WHERE length(name_sorted) > 0), sm AS (SELECT cc, name_sorted, src FROM ky GROUP BY ALL HAVING count(*) <= 20),
    raw AS (SELECT DISTINCT sd.s1, k2.mid FROM sd JOIN ky k1 ON sd.seed = k1.mid JOIN ky k2 ON k1.cc = k2.cc AND k1.name_sorted = k2.name_sorted AND k1.src <> k2.src JOIN sm ON sm.cc = k2.cc AND sm.name_sorted = k2.name_sorted AND sm.src = k2.src)
    SELECT s1, mid FROM (SELECT s1, mid, row_number() OVER (PARTITION BY s1 ORDER BY mid) AS rk FROM raw) WHERE rk <= 20 EXCEPT SELECT s1, mid FROM cand"""
)
def sister_sorted_name(spark, sf_dir):
    s1, t = numbered_sides(spark, sf_dir)
    return exp.sorted_name_sisters(blk.candidates(s1, t, POLICY), t)


_NEIGH = """, nsel AS (SELECT * FROM (SELECT mid AS seed, cc, gram, df, row_number() OVER (PARTITION BY mid ORDER BY df, gram) AS kr FROM tg4 JOIN g4df USING (cc, gram) WHERE df <= 1000) WHERE kr <= 4),
nh AS (SELECT seed, tg4.mid AS neighbour, count(*) AS shared, sum(ln(1.0 + tot.n / df)) AS evidence FROM nsel JOIN tg4 USING (cc, gram) CROSS JOIN tot WHERE tg4.mid <> seed GROUP BY ALL),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, substr(neighbour, 1, 2) ORDER BY shared DESC, round(evidence, 9) DESC, neighbour) AS edge_rank FROM nh) WHERE edge_rank <= 20)"""


@query(KEYS + _N4 + _NEIGH + " SELECT seed, neighbour, shared, round(evidence, 6) AS evidence, edge_rank, substr(seed, 1, 2) || '>' || substr(neighbour, 1, 2) AS direction FROM edges")
def neighbor_index(spark, sf_dir):
    return exp.neighbour_index(sides(spark, sf_dir)[1], cap=1000, k=20).withColumn("evidence", F.round("evidence", 6)).select("seed", "neighbour", "shared", "evidence", "edge_rank", "direction")


@query(
    FEATURES
    + _N4
    + _NEIGH
    + """, oj AS (SELECT sc.s1, sc.mid AS seed, sc.score AS seed_score, e.neighbour, e.shared, e.evidence, row_number() OVER (PARTITION BY sc.s1, sc.mid ORDER BY (substr(e.seed, 1, 2) <> substr(e.neighbour, 1, 2)) DESC, e.shared DESC, round(e.evidence, 9) DESC, e.neighbour) AS q FROM sc JOIN edges e ON sc.mid = e.seed WHERE sc.score >= 0.5)
    SELECT s1, neighbour AS mid, seed, seed_score, support FROM (SELECT *, row_number() OVER (PARTITION BY s1, neighbour ORDER BY seed_score DESC, shared DESC, round(evidence, 9) DESC, seed) AS c, count(*) OVER (PARTITION BY s1, neighbour) AS support FROM oj WHERE q <= 3) WHERE c = 1"""
)
def one_hop_expand(spark, sf_dir):
    _, t, scored, _ = scored_pairs(spark, sf_dir)
    return exp.one_hop(scored.select("s1", F.col("mid").alias("seed"), F.col("score").alias("seed_score")), exp.neighbour_index(t, cap=1000, k=20), 0.5, 3)


#: Ranks that the sweep lifts to: of heavy blocks, of the token passes, of name 4-grams.
_SWEEP = {"heavy": 300, "tokens": 80, "name4": 40}


@query(
    CAND
    + _N4
    + f""", lifted AS (SELECT 'tokens' AS sweep, s1, mid FROM ranked WHERE source_rank BETWEEN {POLICY.s2_quota + 1} AND {_SWEEP["tokens"]} UNION SELECT 'heavy', s1, mid FROM hv WHERE heavy_rank BETWEEN {POLICY.heavy_cap + 1} AND {_SWEEP["heavy"]}
    UNION SELECT 'name4', s1, mid FROM name4r WHERE source_rank BETWEEN 26 AND {_SWEEP["name4"]})
    SELECT l.sweep, l.s1, l.mid FROM lifted l ANTI JOIN cand USING (s1, mid)"""
)
def cap_sweep(spark, sf_dir):
    """Pairs that higher quotas and a higher heavy cap would add, by the cap that is lifted."""
    s1, t, cand = candidate_pairs(spark, sf_dir)
    within = lambda rows, rank, low, high, name: rows.filter(F.col(rank).between(low, high)).select(F.lit(name).alias("sweep"), "s1", "mid")
    lifted = [within(p, "source_rank", POLICY.s2_quota + 1, _SWEEP["tokens"], "tokens") for p in blk.token_pass(s1, t, POLICY)]
    lifted.append(within(blk.heavy_ranks(s1, t, POLICY), "heavy_rank", POLICY.heavy_cap + 1, _SWEEP["heavy"], "heavy"))
    lifted.append(within(exp.gram_pass(s1, t, "name_norm", cap=1000, quota=_SWEEP["name4"]), "source_rank", 26, _SWEEP["name4"], "name4"))
    return reduce(DataFrame.unionByName, lifted).distinct().join(cand.select("s1", "mid"), ["s1", "mid"], "left_anti")


@query(CAND + _N4 + " SELECT mask, count(*) AS pairs FROM (SELECT s1, mid, bit_or(b) AS mask FROM (SELECT s1, mid, 1::BIGINT AS b FROM cand UNION ALL SELECT s1, mid, 2 FROM name4 UNION ALL SELECT s1, mid, 4 FROM srt) GROUP BY ALL) GROUP BY mask")
def pass_union_mask(spark, sf_dir):
    s1, t, cand = candidate_pairs(spark, sf_dir)
    return exp.pass_mask(cand, exp.gram_pass(s1, t, "name_norm", cap=1000, quota=25), blk.exact_block(s1, t, "name_sorted")).groupBy("mask").agg(F.count("*").alias("pairs"))


@query(CAND + _N4 + " SELECT n.s1, n.mid, 0::BIGINT AS provenance, 0::BIGINT AS name_token_rank, 0::BIGINT AS address_token_rank, 0::BIGINT AS source_balanced_rank FROM name4 n LEFT JOIN cand c ON n.s1 = c.s1 AND n.mid = c.mid WHERE c.s1 IS NULL")
def new_only_candidates(spark, sf_dir):
    s1, t, cand = candidate_pairs(spark, sf_dir)
    return exp.new_only(exp.gram_pass(s1, t, "name_norm", cap=1000, quota=25), cand)


@query(
    CAND
    + f""", ms AS (SELECT gt.s1, gt.mid FROM gt LEFT JOIN cand c ON gt.s1 = c.s1 AND gt.mid = c.mid WHERE c.s1 IS NULL), rk AS (SELECT s1, mid, row_number() OVER (PARTITION BY s1 ORDER BY {_SEED_ORDER}) AS sr FROM cand),
    ts AS (SELECT rk.s1, rk.mid, sr FROM rk JOIN gt ON rk.s1 = gt.s1 AND rk.mid = gt.mid)
    SELECT x.k, count(DISTINCT ts.s1 || ts.mid) AS true_seeds, count(DISTINCT ms.s1 || ms.mid) AS reachable, count(DISTINCT CASE WHEN substr(ts.mid, 1, 2) <> substr(ms.mid, 1, 2) THEN ms.s1 || ms.mid END) AS reachable_opposite
    FROM (SELECT unnest([1, 2, 3, 5])::BIGINT AS k) x LEFT JOIN ts ON ts.sr <= x.k LEFT JOIN ms ON ms.s1 = ts.s1 GROUP BY x.k"""
)
def sister_opportunity(spark, sf_dir):
    """Missed links that true seeds within a rank could reach."""
    s1, t, cand = candidate_pairs(spark, sf_dir)
    truth = blk.truth_links(s1, t)
    missed = truth.join(cand.select("s1", "mid"), ["s1", "mid"], "left_anti").withColumnRenamed("mid", "lost")
    seeds = exp.best_seeds(cand, 5).join(truth.withColumnRenamed("mid", "seed"), ["s1", "seed"])
    tiers = spark.createDataFrame([(k,) for k in (1, 2, 3, 5)], "k long")
    ks = F.filter(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3, 5))), lambda k: F.col("seed_rank") <= k)
    rows = seeds.join(missed, "s1", "left").withColumn("k", F.explode(ks))
    opposite = blk.source_of("seed") != blk.source_of("lost")
    per = rows.groupBy("k").agg(F.count_distinct("s1", "seed").alias("true_seeds"), F.count_distinct(F.when(F.col("lost").isNotNull(), F.concat("s1", "lost"))).alias("reachable"), F.count_distinct(F.when(opposite, F.concat("s1", "lost"))).alias("reachable_opposite"))
    return tiers.join(per, "k", "left").na.fill(0)
