"""Candidates and evidence of ``operators.matching`` and what is counted on them."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.normalize import normalized_keys
from tessera.operators import blocking as blk
from tessera.operators import decision as dec
from tessera.operators import evaluation as ev
from tessera.operators import features as feat
from tessera.operators import matching
from tessera.plans import registry

SF = "/root/testdata/sf0.001"
POLICY = blk.Policy(df_cap=40, shortlist=6, s2_quota=2, s3_quota=3, heavy_block=4, heavy_cap=3)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(7)
    word = lambda: rng.choice("acme tools noble paris lumen delta kiosk 75001 12 9".split())
    rows = []
    for i in range(300):
        name, address = " ".join(word() for _ in range(rng.randint(0, 3))), " ".join(word() for _ in range(rng.randint(0, 4)))
        rows.append((f"S{i % 3 + 1}-{i:04d}", name, address, rng.choice(["xx", "yy"]), rng.choice([None, "e1", "e2", "e3"])))
    keys = normalized_keys(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, truth_key string")).cache()
    return blk.queries_of(keys), blk.targets_of(keys)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pair_is_joined_or_sorted(sides):
    for df in (blk.candidates(*sides, POLICY), blk.token_evidence(*sides, POLICY)):
        assert "SortMergeJoin" not in plan_of(df) and "Window" not in plan_of(df)


def test_short_lists_and_blocks_like_their_joins(sides):
    s1, t = sides
    evidence = blk.token_evidence(s1, t, POLICY)
    for field, key in blk.FIELDS.items():
        want = blk.shortlist(blk.token_scores(s1, t, key, POLICY.df_cap), POLICY.shortlist)
        got = blk.field_ranks(evidence, field)
        assert rows_of(got, "s1", "mid", "shared", F.round("score", 9)) == rows_of(want, "s1", "mid", "shared", F.round("score", 9))
        places = got.groupBy("s1", blk.source_of()).agg(F.max("source_rank").alias("m"), F.count_distinct("source_rank").alias("d"), F.count("*").alias("n"))
        assert places.filter("m <> n OR d <> n").count() == 0
    cand = blk.candidates(s1, t, POLICY)
    assert rows_of(cand.filter("provenance & 2 > 0"), "s1", "mid") == rows_of(blk.exact_block(s1, t, "addr_norm"), "s1", "mid")
    block = blk.exact_block(s1, t, "name_sorted").join(blk.heavy_ranks(s1, t, POLICY), ["s1", "mid"], "left")
    alone = block.join(cand.filter("provenance > 1"), ["s1", "mid"], "left_anti").filter(f"heavy_rank IS NULL OR heavy_rank <= {POLICY.heavy_cap}")
    assert rows_of(cand.filter("provenance = 1"), "s1", "mid") == rows_of(alone, "s1", "mid")


def test_parts_do_not_matter(sides, monkeypatch):
    whole = rows_of(blk.candidates(*sides, POLICY), "*")
    monkeypatch.setattr(matching, "PART_ROWS", 7)
    monkeypatch.setattr(matching, "BATCH_ROWS", 3)
    assert rows_of(blk.candidates(*sides, POLICY), "*") == whole


def test_further_columns_like_features(sides):
    s1, t = sides
    got = blk.candidates(s1, t, POLICY, likeness=True, labels=True, carry=feat.KEYS)
    rows = feat.token_features(feat.exact_features(feat.paired(got.select("s1", "mid"), s1, t)))
    columns = ["exact_name_nosuffix", "exact_address_norm", "name_jaccard", "address_jaccard", *(f"{x}_{k}" for x in "ab" for k in feat.KEYS)]
    assert rows_of(got, "s1", "mid", *columns) == rows_of(rows, "s1", "mid", *columns)
    links = blk.truth_links(s1, t)
    assert rows_of(got.filter("y = 1"), "s1", "mid") == rows_of(got.join(links, ["s1", "mid"], "left_semi"), "s1", "mid")
    assert rows_of(blk.truth_sizes(s1, t), "s1", "truth_n") == rows_of(ev.entity_counts(s1.select("s1"), links, links), "s1", "truth_n")
    counts = ev.labelled_counts(blk.truth_sizes(s1, t), got)
    assert rows_of(counts, "s1", "truth_n", "pred_n", "tp") == rows_of(ev.entity_counts(s1.select("s1", "cc"), links, got), "s1", "truth_n", "pred_n", "tp")


def test_conflicts_over_many_batches(spark):
    rows = spark.range(60_000).selectExpr("concat('S1-', id % 997) AS s1", "concat('S2-', id % 50) AS mid", "(id * 7919 % 13) / 13 AS score").repartition(3)
    want = rows.groupBy("mid").agg(F.min(F.struct((-F.col("score")).alias("a"), "s1")).alias("b")).select("mid", "b.s1", (-F.col("b.a")).alias("score"))
    assert rows_of(dec.resolve_conflicts(rows), "mid", "s1", "score") == rows_of(want, "mid", "s1", "score")
    assert dec.resolve_conflicts(rows.filter("score > 2")).count() == 0


@pytest.mark.parametrize("name", ["count_bands", "address_threshold", "calibrated_scores", "candidate_oracle", "country_diagnostics", "error_taxonomy", "calibration_bins", "dist_quantiles", "context_threshold", "entity_classes"])
def test_queries_shuffle_no_pairs(spark, name):
    """Beyond records and counts: no join on the target, no window over pairs."""
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan
    assert not any(kind in line and "[mid#" in line for line in plan.splitlines() for kind in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin"))
