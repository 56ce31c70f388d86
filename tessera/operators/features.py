"""Features of candidate pairs, as columns over both records of a pair.

``paired`` puts the keys of S1 (prefix a_) and target (prefix b_) beside a pair; the
groups below add columns to it.  Missing values are empty strings; every ratio is
guarded, so features are never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions.normalize import script_class, transliterate, words
from tessera.operators.blocking import source_of

KEYS = ("name_norm", "name_nosuffix", "name_sorted", "addr_norm", "cc")

#: Columns that other columns determine; a model leaves them out.
REDUNDANT = ("provenance", "retrieved_sorted_name", "retrieved_exact_address", "target_is_s3")

#: Named groups for ablation.
GROUPS = {
    "provenance": ["provenance", "retrieved_sorted_name", "retrieved_exact_address", "retrieved_name_token", "retrieved_address_token", "retrieval_pass_count", "name_token_rank", "address_token_rank", "source_balanced_rank", "heavy_sorted_block", "target_is_s2", "target_is_s3"],
    "exact": ["exact_name_norm", "exact_name_sorted", "exact_address_norm", "exact_name_nosuffix", "exact_numeric_set", "exact_postal_token", "country_agreement"],
    "length": ["s1_name_missing", "target_name_missing", "s1_address_missing", "target_address_missing", "s1_name_chars", "target_name_chars", "s1_address_chars", "target_address_chars", "s1_name_tokens", "target_name_tokens", "s1_address_tokens", "target_address_tokens", "name_char_abs_diff", "address_char_abs_diff", "name_char_relative_diff", "address_char_relative_diff"],
    "token": [f"{p}_{s}" for p in ("name", "address") for s in ("token_intersection", "token_union", "jaccard", "containment_s1", "containment_target", "shared_idf")],
    "numeric": ["shared_address_numbers", "conflicting_address_numbers", "shared_postal_tokens", "conflicting_postal_tokens", "digit_sequence_equal", "house_number_equal"],
    "fuzzy": [f"{p}_{s}" for p in ("name", "address") for s in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio")],
    "script": ["s1_script_class", "target_script_class", "same_script_class", "script_conflict"],
}
GROUPS["all"] = [c for group in list(GROUPS.values()) for c in group]


def paired(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    left = s1.select("s1", *(F.col(k).alias(f"a_{k}") for k in KEYS))
    right = targets.select("mid", *(F.col(k).alias(f"b_{k}") for k in KEYS))
    return pairs.join(left, "s1").join(right, "mid")


def _equal(key: str) -> Column:
    return (F.col(f"a_{key}") != "") & (F.col(f"a_{key}") == F.col(f"b_{key}"))


def _runs(side: str) -> Column:
    return F.regexp_extract_all(f"{side}_addr_norm", F.lit(r"(\d+)"), F.lit(1))


def _postal(side: str) -> Column:
    return F.regexp_extract(f"{side}_addr_norm", r"\d{5,6}", 0)


def _both(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0)


def provenance_features(rows: DataFrame) -> DataFrame:
    p = F.col("provenance")
    return rows.withColumns(
        {
            "retrieved_sorted_name": p.bitwiseAND(1) != 0,
            "retrieved_exact_address": p.bitwiseAND(2) != 0,
            "retrieved_name_token": p.bitwiseAND(4) != 0,
            "retrieved_address_token": p.bitwiseAND(8) != 0,
            "retrieval_pass_count": F.bit_count(p.bitwiseAND(15)).cast("long"),
            "target_is_s2": F.col("mid").startswith("S2-"),
            "target_is_s3": F.col("mid").startswith("S3-"),
        }
    )


def exact_features(rows: DataFrame) -> DataFrame:
    a, b = (F.array_sort(F.array_distinct(_runs(x))) for x in "ab")
    return rows.withColumns(
        {
            "exact_name_norm": _equal("name_norm"),
            "exact_name_sorted": _equal("name_sorted"),
            "exact_address_norm": _equal("addr_norm"),
            "exact_name_nosuffix": _equal("name_nosuffix"),
            "exact_numeric_set": (F.size(a) > 0) & (a == b),
            "exact_postal_token": (_postal("a") != "") & (_postal("a") == _postal("b")),
            "country_agreement": _equal("cc"),
        }
    )


def length_features(rows: DataFrame) -> DataFrame:
    out: dict[str, Column] = {}
    sides = (("s1", "a"), ("target", "b"))
    for label, key in (("name", "name_norm"), ("address", "addr_norm")):
        size = {x: F.length(f"{x}_{key}").cast("long") for _, x in sides}
        for who, x in sides:
            out[f"{who}_{label}_missing"] = size[x] == 0
            out[f"{who}_{label}_chars"] = size[x]
            out[f"{who}_{label}_tokens"] = F.size(F.array_distinct(words(F.col(f"{x}_{'name_nosuffix' if label == 'name' else key}")))).cast("long")
        gap = F.abs(size["a"] - size["b"])
        out[f"{label}_char_abs_diff"] = gap
        out[f"{label}_char_relative_diff"] = gap / F.greatest(size["a"], size["b"], F.lit(1))
    return rows.withColumns(out)


def token_features(rows: DataFrame) -> DataFrame:
    out: dict[str, Column] = {}
    for label, key in (("name", "name_nosuffix"), ("address", "addr_norm")):
        a, b = (F.array_distinct(words(F.col(f"{x}_{key}"))) for x in "ab")
        common = F.size(F.array_intersect(a, b)).cast("long")
        out[f"{label}_token_intersection"] = common
        out[f"{label}_token_union"] = F.size(F.array_union(a, b)).cast("long")
        out[f"{label}_jaccard"] = sim.jaccard(a, b)
        out[f"{label}_containment_s1"] = common / F.greatest(F.size(a), F.lit(1))
        out[f"{label}_containment_target"] = common / F.greatest(F.size(b), F.lit(1))
    return rows.withColumns(out)


def numeric_features(rows: DataFrame) -> DataFrame:
    """Numbers conflict if both sides have some and the sets are unequal."""
    a, b = _runs("a"), _runs("b")
    sets = [F.array_sort(F.array_distinct(x)) for x in (a, b)]
    pa, pb = _postal("a"), _postal("b")
    return rows.withColumns(
        {
            "shared_address_numbers": F.size(F.array_intersect(a, b)).cast("long"),
            "conflicting_address_numbers": _both(a, b) & (sets[0] != sets[1]),
            "shared_postal_tokens": ((pa != "") & (pa == pb)).cast("long"),
            "conflicting_postal_tokens": (pa != "") & (pb != "") & (pa != pb),
            "digit_sequence_equal": (F.size(a) > 0) & (a == b),
            "house_number_equal": _both(a, b) & (F.get(a, F.lit(0)) == F.get(b, F.lit(0))),
        }
    )


def script_features(rows: DataFrame) -> DataFrame:
    a, b = (script_class(F.col(f"{x}_name_norm")).cast("long") for x in "ab")
    both = (a > 0) & (b > 0)
    return rows.withColumns({"s1_script_class": a, "target_script_class": b, "same_script_class": (a > 0) & (a == b), "script_conflict": both & (a != b)})


def fuzzy_features(rows: DataFrame) -> DataFrame:
    """The four fuzzy ratios of names and of addresses, by one UDF call each."""
    fields = {"name": "name_norm", "address": "addr_norm"}
    rows = rows.withColumns({f"{label}_fuzzy": sim.fuzzy_ratios(f"a_{key}", f"b_{key}") for label, key in fields.items()})
    rows = rows.withColumns({f"{label}_{name}": F.col(f"{label}_fuzzy")[name] for label in fields for name in sim.RATIOS})
    return rows.drop(*(f"{label}_fuzzy" for label in fields))


def all_features(candidates: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """The 65 features of candidate pairs."""
    rows = paired(candidates, s1, targets)
    for group in (provenance_features, exact_features, length_features, token_features, numeric_features, fuzzy_features, script_features):
        rows = group(rows)
    return rows.select("s1", "mid", *GROUPS["all"])


def _initials(text: Column) -> Column:
    return F.array_join(F.transform(words(text), lambda w: F.substring(w, 1, 1)), "")


def name_features(rows: DataFrame) -> DataFrame:
    """Character and affix features of names (no fuzzy ratios)."""
    a, b = F.col("a_name_norm"), F.col("b_name_norm")
    valid = (a != "") & (b != "")
    x, y = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    out = {f"name_ng{n}": F.when(valid, sim.jaccard(sim.grams(a, n), sim.grams(b, n))).otherwise(0.0) for n in (2, 3, 4)}
    out["name_levenshtein"] = F.when(valid, sim.levenshtein_similarity(a, b)).otherwise(0.0)
    out["initial_compat"] = (valid & ((_initials(a) == _initials(b)) | (x == _initials(b)) | (y == _initials(a)))).cast("double")
    out["prefix_compat"] = (valid & (x.startswith(y) | y.startswith(x))).cast("double")
    out["suffix_compat"] = (valid & (x.endswith(y) | y.endswith(x))).cast("double")
    return rows.withColumns(out)


def name_fuzzy_features(rows: DataFrame) -> DataFrame:
    a, b = F.col("a_name_norm"), F.col("b_name_norm")
    x, y = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    return rows.withColumns({"name_wratio": sim.weighted_ratio(a, b), "name_jaro": F.when((a != "") & (b != ""), sim.jaro_winkler_similarity(a, b)).otherwise(0.0), "name_compact_ratio": sim.ratio(x, y)})


def romanized_features(rows: DataFrame) -> DataFrame:
    """Similarities of romanised names."""
    x, y = transliterate("a_name_norm"), transliterate("b_name_norm")
    rows = rows.withColumns({"a_roman": x, "b_roman": y})
    a, b = F.col("a_roman"), F.col("b_roman")
    return rows.withColumns(
        {"translit_ratio": sim.ratio(a, b), "translit_token_ratio": sim.token_sort_ratio(a, b), "translit_ng3": F.when((a != "") & (b != ""), sim.jaccard(sim.grams(a, 3), sim.grams(b, 3))).otherwise(0.0)}
    ).drop("a_roman", "b_roman")


def address_features(rows: DataFrame) -> DataFrame:
    a, b = F.col("a_addr_norm"), F.col("b_addr_norm")
    valid = (a != "") & (b != "")
    na, nb = _runs("a"), _runs("b")
    plain = [F.array_distinct(F.filter(words(x), lambda w: ~w.rlike("[0-9]"))) for x in (a, b)]

    def share(low: int, high: int) -> Column:
        keep = [F.filter(n, lambda v: F.length(v).between(low, high)) for n in (na, nb)]
        return F.arrays_overlap(*keep).cast("double")

    return rows.withColumns(
        {
            "addr_missing": (~valid).cast("double"),
            "addr_weak": (valid & (F.least(F.size(plain[0]), F.size(plain[1])) < 2)).cast("double"),
            "addr_ng3": F.when(valid, sim.jaccard(sim.grams(a, 3), sim.grams(b, 3))).otherwise(0.0),
            "addr_levenshtein": F.when(valid, sim.levenshtein_similarity(a, b)).otherwise(0.0),
            "addr_locality_jaccard": sim.jaccard(*plain),
            "number_jaccard": sim.jaccard(F.array_distinct(na), F.array_distinct(nb)),
            "house_conflict_v2": (_both(na, nb) & (F.get(na, F.lit(0)) != F.get(nb, F.lit(0)))).cast("double"),
            "postal_equal_v2": share(5, 6),
            "phone_equal_v2": share(9, 1 << 20),
        }
    )


def weighted_jaccard(rows: DataFrame, df: DataFrame, total: int, key: str, name: str) -> DataFrame:
    """Sum of token weights of the intersection over that of the union.

    The weight is ln(1 + total / df); 1 for a token that no target has.
    """
    a, b = (F.array_distinct(words(F.col(f"{x}_{key}"))) for x in "ab")
    token = rows.select("s1", "mid", F.col("a_cc").alias("cc"), a.alias("x"), b.alias("y")).withColumn("tok", F.explode(F.array_union("x", "y")))
    weight = F.coalesce(F.log1p(F.lit(float(total)) / F.col("df")), F.lit(1.0))
    weighed = token.join(df, ["cc", "tok"], "left").withColumn("weight", weight)
    common = F.array_contains("x", F.col("tok")) & F.array_contains("y", F.col("tok"))
    sums = weighed.groupBy("s1", "mid").agg((F.sum(F.when(common, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias(name))
    return rows.join(sums, ["s1", "mid"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def entity_context(scored: DataFrame) -> DataFrame:
    """Score context of each pair within its s1: counts, top, second, gap, relative."""
    per = Window.partitionBy("s1")
    ordered = per.orderBy(F.desc("score"), "mid")
    out = scored.withColumn("n", F.row_number().over(ordered))
    top = F.max("score").over(per)
    second = F.coalesce(F.max(F.when(F.col("n") == 2, F.col("score"))).over(per), F.lit(0.0))
    return out.withColumns(
        {
            "candidate_count": F.count("*").over(per),
            "source_candidate_count": F.count("*").over(Window.partitionBy("s1", source_of())),
            "top_score": top,
            "second_score": second,
            "score_gap": top - second,
            "high_count": F.sum((F.col("score") >= 0.8).cast("long")).over(per),
            "relative_to_top": F.col("score") - top,
        }
    ).drop("n")


def anchors(scored: DataFrame, threshold: float = 0.61, per_source: int = 2) -> DataFrame:
    """(s1, anchor, anchor_score): the best targets of each (s1, source) above a score."""
    w = Window.partitionBy("s1", source_of()).orderBy(F.desc("score"), "mid")
    return scored.filter(F.col("score") >= threshold).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_source).select("s1", F.col("mid").alias("anchor"), F.col("score").alias("anchor_score"))


def cross_anchor_features(scored: DataFrame, targets: DataFrame, name_measure, address_measure, roman_measure=None, threshold: float = 0.61) -> DataFrame:
    """Support of a pair by anchors of the other source.

    The measures take (target text, anchor text); each is 0 for an empty text.
    ``roman_measure`` (by default the one of names) compares romanised names.
    """
    text = targets.select("mid", "name_norm", "addr_norm", transliterate("name_norm").alias("roman"))
    other = text.select(F.col("mid").alias("anchor"), F.col("name_norm").alias("n2"), F.col("addr_norm").alias("a2"), F.col("roman").alias("r2"))
    other = anchors(scored, threshold).join(other, "anchor")
    rows = scored.select("s1", "mid").join(text, "mid").join(other, "s1").filter(source_of() != source_of("anchor"))
    both = lambda x, y, m: F.when((F.col(x) != "") & (F.col(y) != ""), m(F.col(x), F.col(y))).otherwise(0.0)
    nums = [F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))) for c in ("addr_norm", "a2")]
    rows = rows.withColumns({"n": both("name_norm", "n2", name_measure), "a": both("addr_norm", "a2", address_measure), "r": both("roman", "r2", roman_measure or name_measure), "d": sim.jaccard(*nums)})
    supports = (F.col("n") >= 0.8) & ((F.col("a") >= 0.6) | (F.col("r") >= 0.9))
    per = rows.groupBy("s1", "mid").agg(
        F.max("n").alias("cross_name"),
        F.max("a").alias("cross_address"),
        F.max("r").alias("cross_translit"),
        F.max("d").alias("cross_numeric"),
        F.max(F.least("n", "a") * F.col("anchor_score")).alias("cross_joint"),
        F.sum(supports.cast("long")).alias("cross_support_count"),
        F.max("anchor_score").alias("cross_seed_score"),
    )
    return scored.join(per, ["s1", "mid"], "left").na.fill(0, per.columns[2:])


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))).cast("long")


def shared_word_df(rows: DataFrame, df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows with the least and the greatest frequency of the words that a pair shares."""
    a, b = (words(F.col(f"{x}_{key}")) for x in "ab")
    token = rows.select("s1", "mid", F.col("a_cc").alias("cc"), F.explode(F.array_intersect(a, b)).alias("tok")).join(df, ["cc", "tok"])
    ends = token.groupBy("s1", "mid").agg(F.min("df").alias(f"{label}_min_df"), F.max("df").alias(f"{label}_max_df"))
    return rows.join(ends, ["s1", "mid"], "left")


def link_diagnostics(links: DataFrame, s1: DataFrame, targets: DataFrame, candidates: DataFrame, dfs: dict[str, DataFrame], df_cap: int) -> DataFrame:
    """Why a link was found or not: its keys, likenesses, frequencies and sisters.

    ``dfs`` has the word frequencies of the name and the address.  A sister is another
    link of the same s1; a retrieved one could lead to a missed one.
    """
    more = ("name_acronym", "name_norm")
    found = candidates.select("s1", "mid", F.lit(True).alias("recovered"))
    rows = paired(links, s1, targets).join(s1.select("s1", F.col(more[0]).alias("a_acronym")), "s1").join(targets.select("mid", F.col(more[0]).alias("b_acronym")), "mid")
    for label, key in (("name", "name_nosuffix"), ("address", "addr_norm")):
        rows = shared_word_df(rows, dfs[label], key, label)
    rows = rows.join(found, ["s1", "mid"], "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))
    a, b, sa, sb = (F.col(c) for c in ("a_name_norm", "b_name_norm", "a_addr_norm", "b_addr_norm"))
    rare = lambda label: F.coalesce(F.col(f"{label}_min_df") <= df_cap, F.lit(False))
    eligible = _equal("cc") & (_equal("name_sorted") | _equal("addr_norm") | rare("name") | rare("address"))
    na, nb = _runs("a"), _runs("b")
    scripts = [script_class(x).cast("long") for x in (a, b)]
    overlap = lambda x, y: F.size(F.array_intersect(x, y)).cast("long")
    out = {
        "key_eligible": eligible,
        "miss_category": F.when(F.col("recovered"), "recovered").when(eligible, "eligible_but_lost").otherwise("no_key_eligible"),
        "exact_name": _equal("name_norm"),
        "exact_nosuffix": _equal("name_nosuffix"),
        "exact_sorted": _equal("name_sorted"),
        "name_token_overlap": overlap(words(F.col("a_name_nosuffix")), words(F.col("b_name_nosuffix"))),
        "address_token_overlap": overlap(words(sa), words(sb)),
        "acronym_equal": (F.length("a_acronym") >= 3) & (F.col("a_acronym") == F.col("b_acronym")),
        "initials_equal": (_initials(a) != "") & (_initials(a) == _initials(b)),
        "prefix_overlap": common_prefix(a, b),
        "suffix_overlap": common_prefix(F.reverse(a), F.reverse(b)),
        "numeric_overlap": overlap(na, nb),
        "postal_equal": (_postal("a") != "") & (_postal("a") == _postal("b")),
        "house_equal": _both(na, nb) & (F.get(na, F.lit(0)) == F.get(nb, F.lit(0))),
        "both_address": (sa != "") & (sb != ""),
        "s1_address_missing": sa == "",
        "target_address_missing": sb == "",
        "same_script": scripts[0] == scripts[1],
        "devanagari_latin": (F.least(*scripts) == 1) & (F.greatest(*scripts) == 2),
        "script_relation": F.concat_ws(":", *(c.cast("string") for c in scripts)),
        "target_source": source_of(),
    }
    for label, x, y in (("name", a, b), ("address", sa, sb)):
        for n in (2, 3, 4):
            left, right = sim.grams(x, n), sim.grams(y, n)
            out |= {f"{label}_{n}gram_overlap": overlap(left, right), f"{label}_{n}gram_jaccard": sim.jaccard(left, right)}
    rows = rows.withColumns(out)
    per, hit = Window.partitionBy("s1"), F.col("recovered").cast("long")
    own = F.sum(hit).over(Window.partitionBy("s1", "target_source"))
    return rows.withColumns({"truth_n": F.count("*").over(per), "true_sister_retrieved": F.sum(hit).over(per) - hit > 0, "cross_source_sister": F.sum(hit).over(per) - own > 0})


#: The columns of ``link_diagnostics`` beside s1 and mid.
DIAGNOSTICS = [
    "recovered", "key_eligible", "miss_category", "exact_name", "exact_nosuffix", "exact_sorted", "name_token_overlap", "address_token_overlap", "acronym_equal", "initials_equal",
    "prefix_overlap", "suffix_overlap", "numeric_overlap", "postal_equal", "house_equal", "both_address", "s1_address_missing", "target_address_missing", "same_script", "devanagari_latin",
    "script_relation", "target_source", "truth_n", "true_sister_retrieved", "cross_source_sister", "name_min_df", "name_max_df", "address_min_df", "address_max_df",
    *(f"{label}_{n}gram_{kind}" for label in ("name", "address") for n in (2, 3, 4) for kind in ("overlap", "jaccard")),
]


def sister_likeness(diagnosed: DataFrame) -> DataFrame:
    """Fuzzy ratios of links, and of their targets with other links' targets of the s1.

    ``diagnosed`` are rows of ``link_diagnostics``; links of one s1 are few, and pairs of
    them are joined on the s1.
    """
    a, b, sa, sb = (F.col(c) for c in ("a_name_norm", "b_name_norm", "a_addr_norm", "b_addr_norm"))
    rows = diagnosed.withColumns({"name_ratio": sim.ratio(a, b), "name_token_sort_ratio": sim.token_sort_ratio(a, b), "name_wratio": sim.weighted_ratio(a, b), "address_ratio": sim.ratio(sa, sb)})
    sister = diagnosed.select("s1", F.col("mid").alias("sister"), b.alias("n2"), sb.alias("a2"), F.col("recovered").alias("seed"))
    pair = diagnosed.select("s1", "mid", b.alias("n1"), sb.alias("a1")).join(sister, "s1").filter("mid <> sister")
    pair = pair.withColumns({"n": sim.ratio("n1", "n2"), "a": sim.ratio("a1", "a2")})
    seen = lambda c: F.max(F.when(F.col("seed"), F.col(c)))
    best = pair.groupBy("s1", "mid").agg(seen("n").alias("sister_name_similarity"), seen("a").alias("sister_address_similarity"), F.max("n").alias("strongest_target_name"))
    rows = rows.join(best, ["s1", "mid"], "left").na.fill(0.0, best.columns[2:])
    return rows.withColumn("sister_closer_than_s1", F.col("true_sister_retrieved") & (F.col("sister_name_similarity") > F.col("name_ratio")))
