"""Scores of pairs and policies that turn scores into sets.

Scored pairs have s1, mid and score.  Policies return the accepted pairs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocking import source_of

# Weights of the deterministic score.
RULE_WEIGHTS = {
    "exact_address_norm": 0.30,
    "exact_name_nosuffix": 0.24,
    "exact_name_sorted": 0.12,
    "name_token_set_ratio": 0.10,
    "address_token_set_ratio": 0.08,
    "digit_sequence_equal": 0.06,
    "several_passes": 0.05,
    "exact_postal_token": 0.05,
}
# Weights of the score that ranks hard negatives.
HARD_WEIGHTS = {
    "retrieval_pass_count": 100,
    "exact_address_norm": 80,
    "exact_name_nosuffix": 60,
    "exact_name_sorted": 40,
    "name_token_set_ratio": 20,
    "address_token_set_ratio": 20,
    "exact_numeric_set": 12,
    "exact_postal_token": 12,
}


def weighted_score(weights: dict[str, float], rename: dict[str, str] | None = None) -> Column:
    """Sum of weight * feature; booleans count as 0 and 1."""
    rename = rename or {}
    return sum((F.col(rename.get(c, c)).cast("double") * w for c, w in weights.items()), F.lit(0.0))


def rule_score(rows: DataFrame, rename: dict[str, str] | None = None) -> Column:
    """The deterministic score, at most 1; ``rows`` need retrieval_pass_count."""
    weights = dict(RULE_WEIGHTS)
    passes = weights.pop("several_passes")
    return F.least(F.lit(1.0), weighted_score(weights, rename) + F.when(F.col("retrieval_pass_count") >= 2, passes).otherwise(0.0))


def logit_score(model: dict | str) -> Column:
    """Probability of a plain linear logit: features, mean, scale, coefficient, intercept.

    ``model`` is the dict or the path of its JSON file.
    """
    if isinstance(model, str):
        with open(model) as lines:
            model = json.load(lines)
    z = F.lit(float(model["intercept"]))
    for name, mean, scale, weight in zip(model["features"], model["mean"], model["scale"], model["coefficient"]):
        z = z + (F.col(name).cast("double") - mean) / scale * weight
    return 1 / (1 + F.exp(-z))


def ensemble(scores: dict[str, float]) -> Column:
    """Weighted mean of score columns."""
    return sum((F.col(c) * w for c, w in scores.items()), F.lit(0.0)) / sum(scores.values())


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(p, F.lit(1 - 1e-6)))
    return F.log(q / (1 - q))


def residual_score(p: Column, margin: Column) -> Column:
    """A score corrected by a margin on the logit scale."""
    z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), logit(p) + margin))
    return 1 / (1 + F.exp(-z))


def residual_context(scored: DataFrame) -> DataFrame:
    """The score's place within its s1 and its source: the columns of a corrector."""
    per, src = Window.partitionBy("s1"), Window.partitionBy("s1", source_of())
    n = F.row_number().over(per.orderBy(F.desc("score"), "mid"))
    out = scored.withColumn("n", n)
    top, source_top = F.max("score").over(per), F.max("score").over(src)
    second = F.coalesce(F.max(F.when(F.col("n") == 2, F.col("score"))).over(per), F.lit(0.0))
    return out.withColumns(
        {
            "current_top": top,
            "current_second": second,
            "current_gap": top - second,
            "current_relative": F.col("score") - top,
            "current_sum": F.sum("score").over(per),
            "current_high_count": F.sum((F.col("score") >= 0.7).cast("long")).over(per),
            "current_source_top": source_top,
            "current_source_relative": F.col("score") - source_top,
        }
    ).drop("n")


def platt(p: Column, coefficient: float, intercept: float) -> Column:
    z = coefficient * logit(p) + intercept
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))


def interpolate(p: Column, x: list[float], y: list[float]) -> Column:
    """Piecewise linear through (x, y), flat outside; x ascending."""
    out = F.lit(float(y[-1]))
    for i in range(len(x) - 1, 0, -1):
        slope = (y[i] - y[i - 1]) / (x[i] - x[i - 1]) if x[i] > x[i - 1] else 0.0
        out = F.when(p < x[i], y[i - 1] + (p - x[i - 1]) * slope).otherwise(out)
    return F.when(p < x[0], F.lit(float(y[0]))).otherwise(out)


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, rows, predicted, observed of (score, y); a score of 1 is in the last bin."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("rows"), F.avg("score").alias("predicted"), F.avg("y").alias("observed"))


def accept(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.filter(F.col("score") >= threshold)


def accept_by_source(scored: DataFrame, s2: float, s3: float, reject: Column | None = None) -> DataFrame:
    """Thresholds by source; ``reject`` drops pairs whatever their score."""
    kept = scored.filter(F.col("score") >= F.when(source_of() == "S2", s2).otherwise(s3))
    return kept if reject is None else kept.filter(~reject)


def accept_by_address(scored: DataFrame, missing: Column, present_t: float, missing_t: float) -> DataFrame:
    return scored.filter(F.col("score") >= F.when(missing, missing_t).otherwise(present_t))


def accept_by_context(scored: DataFrame, threshold: float, dense: float, discount: float, many: int = 250) -> DataFrame:
    """Stricter for S1 with many candidates, milder with support across sources.

    Needs candidate_count and cross_joint; the threshold stays within 0.05 and 0.95.
    """
    t = F.lit(threshold) + F.when(F.col("candidate_count") > many, dense).otherwise(0.0) - F.when(F.col("cross_joint") >= 0.8, discount).otherwise(0.0)
    return scored.filter(F.col("score") >= F.greatest(F.lit(0.05), F.least(F.lit(0.95), t)))


def accept_by_gap(scored: DataFrame, threshold: float, top_min: float = 0.8, gap: float = 0.2) -> DataFrame:
    """The top pair alone where it stands clear of the second, else all above the threshold."""
    w = Window.partitionBy("s1")
    out = scored.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "mid")))
    top, second = F.max("score").over(w), F.max(F.when(F.col("n") == 2, F.col("score"))).over(w)
    out = out.withColumn("clear", second.isNotNull() & (top >= top_min) & (top - second >= gap))
    return out.filter(F.when(F.col("clear"), F.col("n") == 1).otherwise(F.col("score") >= threshold)).drop("n", "clear")


def accept_expected_set(scored: DataFrame) -> DataFrame:
    """The prefix of each s1's pairs, best first, with the greatest expected F0.5.

    A prefix of k is worth 1.25 * (sum of its p) / (0.25 * sum of all p + k), the empty
    set the product of 1 - p; the shortest of the best wins.
    """
    per = Window.partitionBy("s1")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    ordered = per.orderBy(F.desc("p"), "mid")
    out = scored.withColumn("p", p).withColumn("n", F.row_number().over(ordered)).withColumn("total", F.sum("p").over(per))
    head = F.sum("p").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("worth", F.round(1.25 * head / (0.25 * F.col("total") + F.col("n")), 12))
    empty = F.round(F.when(F.max("p").over(per) >= 1.0, 0.0).otherwise(F.exp(F.sum(F.log1p(-F.least("p", F.lit(1 - 1e-15)))).over(per))), 12)
    out = out.withColumn("best", F.max("worth").over(per)).withColumn("empty", empty)
    out = out.withColumn("k", F.min(F.when(F.col("worth") == F.col("best"), F.col("n"))).over(per))
    return out.filter((F.col("best") > F.col("empty")) & (F.col("n") <= F.col("k"))).drop("p", "n", "total", "worth", "best", "empty", "k")


def resolve_conflicts(accepted: DataFrame) -> DataFrame:
    """One s1 per target: the best score, then the smaller s1.

    Each task keeps the best pair of a target before any pair is shuffled.
    """
    schema = accepted.schema

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by([("mid", "ascending"), ("score", "descending"), ("s1", "ascending")])
        mid = table.combine_chunks().column("mid").chunk(0)
        return table.filter(pa.concat_arrays([pa.array([True]), pc.not_equal(mid[1:], mid[:-1])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, least = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                n += batch.num_rows
            if n > 200_000 + 2 * least:
                held = [best(pa.concat_tables(held))]
                n = least = held[0].num_rows
        if held:
            yield from best(pa.concat_tables(held)).to_batches(max_chunksize=20_000)

    w = Window.partitionBy("mid").orderBy(F.desc("score"), "s1")
    return accepted.mapInArrow(run, schema).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def threshold_grid(scored: DataFrame, universe: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, f05: macro F0.5 of each threshold over all S1.

    ``scored`` has y (is a link), ``universe`` s1 and truth_n.  One pass: per s1 and
    threshold the counts come from an explode of the thresholds a pair passes.
    """
    from tessera.operators.evaluation import f05

    grid = F.filter(F.array(*(F.lit(t) for t in thresholds)), lambda t: F.col("score") >= t)
    counts = scored.select("s1", "y", F.explode(grid).alias("threshold")).groupBy("s1", "threshold").agg(F.count("*").alias("pred_n"), F.sum("y").alias("tp"))
    every = universe.select("s1", "truth_n", F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold"))
    rows = every.join(counts, ["s1", "threshold"], "left").na.fill(0, ["pred_n", "tp"])
    return rows.groupBy("threshold").agg(F.avg(f05()).alias("f05"))


def best_threshold(scored: DataFrame, universe: DataFrame) -> float:
    """Two stages: 0 to 1 by 0.05, then around the best by 0.01; a tie goes lower."""
    first = [round(0.05 * i, 2) for i in range(21)]

    def best(values: list[float]) -> float:
        return threshold_grid(scored, universe, values).orderBy(F.round("f05", 12).desc(), "threshold").first()["threshold"]

    at = best(first)
    return best([round(at + 0.01 * i, 2) for i in range(-5, 6) if 0 <= at + 0.01 * i <= 1])


def utility_summary(scored: DataFrame) -> DataFrame:
    """Per s1 the 20 inputs of a utility model.

    Peaks, gap, counts and sums of scores, by source too; from the pairs' columns
    cross_joint, name_similarity, address_similarity, address_missing and script_conflict
    their means and the values of the best pair.
    """
    w = Window.partitionBy("s1").orderBy(F.desc("score"), "mid")
    rows = scored.withColumn("n", F.row_number().over(w)).withColumn("is_s2", source_of() == "S2")
    peak = lambda k: F.coalesce(F.max(F.when(F.col("n") == k, F.col("score"))), F.lit(0.0))
    part = lambda c, of: F.coalesce(F.max(F.when(c, of)), F.lit(0.0))
    best = lambda c: F.max(F.when(F.col("n") == 1, F.col(c).cast("double")))
    return rows.groupBy("s1").agg(
        peak(1).alias("top"),
        peak(2).alias("second"),
        peak(3).alias("third"),
        (peak(1) - peak(2)).alias("gap"),
        F.log1p(F.count("*")).alias("candidate_log_count"),
        F.sum("score").alias("score_sum"),
        F.sum((F.col("score") >= 0.8).cast("long")).alias("high_count"),
        part(F.col("is_s2"), F.col("score")).alias("s2_top"),
        part(~F.col("is_s2"), F.col("score")).alias("s3_top"),
        F.log1p(F.sum(F.col("is_s2").cast("long"))).alias("s2_log_count"),
        F.log1p(F.sum((~F.col("is_s2")).cast("long"))).alias("s3_log_count"),
        F.avg(F.col("address_missing").cast("double")).alias("missing_fraction"),
        F.max("cross_joint").alias("cross_max"),
        F.avg("cross_joint").alias("cross_mean"),
        best("name_similarity").alias("top_name"),
        best("address_similarity").alias("top_address"),
        best("cross_joint").alias("top_cross"),
        best("address_missing").alias("top_missing"),
        best("script_conflict").alias("top_script"),
        F.avg("score").alias("score_mean"),
    )


def prediction_sets(accepted: DataFrame, universe: DataFrame) -> DataFrame:
    """s1, matched (sorted, comma-separated), n for every s1."""
    lists = accepted.groupBy("s1").agg(F.array_sort(F.collect_set("mid")).alias("ids"))
    return universe.select("s1").distinct().join(lists, "s1", "left").select("s1", F.coalesce(F.array_join("ids", ","), F.lit("")).alias("matched"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n"))
