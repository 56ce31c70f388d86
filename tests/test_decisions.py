import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import decision as dec
from tessera.operators import evaluation as ev
from tessera.operators import sampling as smp


def scored(spark, rows):
    return spark.createDataFrame(rows, "s1 string, mid string, score double")


def pairs(df):
    return sorted((r["s1"], r["mid"]) for r in df.collect())


def brute_expected(p):
    order = sorted(p, reverse=True)
    best, size = float(np.prod([1 - x for x in p])), 0
    for k in range(1, len(order) + 1):
        value = 1.25 * sum(order[:k]) / (0.25 * sum(p) + k)
        if value > best + 1e-12:
            best, size = value, k
    return size


def test_expected_sets(spark):
    rng = np.random.default_rng(4)
    groups = {"low": [0.01, 0.02], "high": [0.99, 0.98], "sure": [1.0, 0.3], **{f"g{i}": rng.random(rng.integers(1, 7)).round(3).tolist() for i in range(30)}}
    rows = [(k, f"S2-{i}", float(p)) for k, ps in groups.items() for i, p in enumerate(ps)]
    got = {r["s1"]: r["count"] for r in dec.accept_expected_set(scored(spark, rows)).groupBy("s1").count().collect()}
    assert {k: got.get(k, 0) for k in groups} == {k: brute_expected(p) for k, p in groups.items()}
    assert got.get("low", 0) == 0 and got["high"] == 2


def test_conflicts_and_gap(spark):
    rows = scored(spark, [("a", "S2-1", 0.9), ("b", "S2-1", 0.9), ("b", "S2-2", 0.6), ("c", "S2-2", 0.7), ("c", "S3-1", 0.95)])
    assert pairs(dec.resolve_conflicts(rows)) == [("a", "S2-1"), ("c", "S2-2"), ("c", "S3-1")]
    assert pairs(dec.accept_by_gap(rows, 0.5)) == [("a", "S2-1"), ("b", "S2-1"), ("c", "S3-1")]


def test_thresholds(spark):
    rows = scored(spark, [("a", "S2-1", 0.65), ("a", "S3-1", 0.65)])
    assert pairs(dec.accept(rows, 0.65)) == [("a", "S2-1"), ("a", "S3-1")]
    assert pairs(dec.accept_by_source(rows, 0.6, 0.7)) == [("a", "S2-1")]
    assert pairs(dec.accept_by_source(rows, 0.6, 0.6, F.col("mid") == "S2-1")) == [("a", "S3-1")]


def test_best_threshold_takes_the_lower_of_a_tie(spark):
    rows = spark.createDataFrame([("a", "S2-1", 0.9, 1), ("b", "S2-2", 0.3, 0)], "s1 string, mid string, score double, y int")
    universe = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "s1 string, truth_n int")
    assert dec.best_threshold(rows, universe) == pytest.approx(0.31)


def test_logit_model(spark, tmp_path):
    model = {"features": ["x", "flag"], "mean": [1.0, 0.0], "scale": [2.0, 1.0], "coefficient": [1.0, -0.5], "intercept": 0.25}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(model))
    rows = spark.createDataFrame([(3.0, True)], "x double, flag boolean")
    assert rows.select(dec.logit_score(str(path)).alias("p")).first()["p"] == pytest.approx(1 / (1 + np.exp(-0.75)))


def test_calibration(spark):
    rows = spark.createDataFrame([(0.05, 0), (0.15, 1), (1.0, 1), (0.95, 0)], "score double, y int")
    got = {r["bin"]: (r["rows"], r["observed"]) for r in dec.calibration_bins(rows).collect()}
    assert got == {0: (1, 0.0), 1: (1, 1.0), 9: (2, 0.5)}
    x, y = [0.1, 0.5, 0.9], [0.0, 0.4, 1.0]
    out = [r["v"] for r in rows.select(dec.interpolate(F.col("score"), x, y).alias("v")).collect()]
    assert out == pytest.approx(np.interp([0.05, 0.15, 1.0, 0.95], x, y).tolist())


def test_f05_rules(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 2, 0), (2, 0, 0), (2, 2, 0), (2, 1, 1), (4, 5, 3)], "truth_n int, pred_n int, tp int")
    got = [r["f"] for r in rows.select(ev.f05().alias("f")).collect()]
    p, r = 3 / 5, 3 / 4
    assert got == pytest.approx([1, 0, 0, 0, 1.25 / 1.5, 1.25 * p * r / (0.25 * p + r)])


def test_counts_keep_every_s1(spark):
    universe = spark.createDataFrame([("a",), ("b",), ("c",)], "s1 string")
    links = spark.createDataFrame([("a", "S2-1"), ("a", "S2-2")], "s1 string, mid string")
    predicted = spark.createDataFrame([("a", "S2-1"), ("b", "S3-1")], "s1 string, mid string")
    counts = ev.entity_counts(universe, links, predicted)
    assert sorted((r["s1"], r["truth_n"], r["pred_n"], r["tp"]) for r in counts.collect()) == [("a", 2, 1, 1), ("b", 0, 1, 0), ("c", 0, 0, 0)]
    assert ev.macro_f05(counts).first()["f05"] == pytest.approx((1.25 / 1.5 + 0 + 1) / 3)
    m = ev.micro(counts).first()
    assert (m["precision"], m["recall"]) == (0.5, 0.5)


def test_bootstrap(spark):
    values = np.random.default_rng(1).random(400)
    rows = spark.createDataFrame([(f"s{i}", float(v)) for i, v in enumerate(values)], "s1 string, v double")
    one, two = (ev.bootstrap_interval(rows, F.col("v"), reps=200).first() for _ in range(2))
    assert one == two and one["low"] < one["mean"] < one["high"]
    low, high = ev.bootstrap(values, 500)
    assert one["low"] == pytest.approx(low, abs=0.02) and one["high"] == pytest.approx(high, abs=0.02)


def test_entity_oracle_does_not_split_ties(spark):
    rows = spark.createDataFrame([("a", "S2-1", 0.5, 1), ("a", "S2-2", 0.5, 0), ("a", "S2-3", 0.2, 1)], "s1 string, mid string, score double, y int")
    universe = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "s1 string, truth_n int")
    got = {r["s1"]: r["best"] for r in ev.entity_threshold_oracle(rows, universe).collect()}
    assert got == {"a": pytest.approx(1.25 * 2 / (0.5 + 3)), "b": 1.0, "c": 0.0}


def test_release_gate():
    good = {"macro_f05": 0.9, "macro_drop": 0.0, "pair_precision": 0.97, "country_drop": 0.0, "duplicates": 0, "outside_candidates": 0, "missing_s1": 0}
    assert ev.release_gate(good) == [] and ev.release_gate(good | {"macro_f05": 0.87, "duplicates": 1}) == ["macro_f05", "duplicates"]


def test_hash_splits(spark):
    import hashlib

    rows = spark.range(500).select(F.col("id").cast("string").alias("k"))
    got = rows.select("k", smp.md5_fraction(F.col("k"), "42").alias("f"), smp.percent_role(F.col("k")).alias("p"), smp.sha_shard(F.col("k")).alias("s")).collect()
    for r in got:
        assert r["f"] == int(hashlib.md5(f"42:{r['k']}".encode()).hexdigest()[:8], 16) / 2**32
        digest = hashlib.sha256(r["k"].encode()).digest()
        assert r["p"] == int.from_bytes(digest[:8], "big") % 100 and r["s"] == int.from_bytes(digest[:4], "big") % 8


def test_negative_samples(spark):
    rows = spark.createDataFrame([("a", f"S{2 + i % 2}-{i}", int(i == 0), float(i)) for i in range(20)], "s1 string, mid string, y int, hard_score double")
    got = smp.hard_negatives(rows, 2, "x").collect()
    assert sorted(r["mid"] for r in got) == ["S2-0", "S2-16", "S2-18", "S3-17", "S3-19"]
    # each source of an s1 has its own hard, colliding and random ones
    rows = rows.withColumn("provenance", F.when(F.col("mid") == "S3-7", 5).otherwise(1))
    mixed = smp.mixed_negatives(rows, F.col("mid") == "S2-4", hard=1, collide=1, random=0)
    assert sorted(r["mid"] for r in mixed.collect()) == ["S2-0", "S2-18", "S2-4", "S3-19", "S3-7"]
    assert smp.mixed_negatives(rows, F.lit(False), hard=0, collide=0, random=2).count() == 1 + 4
    hard = smp.ranked_negatives(rows, 3, F.desc("hard_score"))
    assert sorted(r["mid"] for r in hard.collect()) == ["S2-0", "S2-18", "S3-17", "S3-19"]
    one, two = ([r["mid"] for r in smp.random_negatives(rows, 5, seed).orderBy("mid").collect()] for seed in ("a", "b"))
    assert len(one) == len(two) == 6 and one != two


def test_quota_roles(spark):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(40)], "key string, n int")
    got = smp.quota_roles(rows, "key", [("tune", 5), ("threshold", 3)], "fit").collect()
    order = sorted((hashlib.sha256(r["key"].encode()).hexdigest(), r["key"]) for r in got)
    want = {key: "tune" if i < 5 else "threshold" if i < 8 else "fit" for i, (_, key) in enumerate(order)}
    assert {r["key"]: r["role"] for r in got} == want and len(got) == 40


def test_slices_and_changes(spark):
    links = spark.createDataFrame([("a", "S2-1", "x"), ("a", "S3-1", "x"), ("b", "S2-2", "y")], "s1 string, mid string, cc string")
    sets = spark.createDataFrame([("p", "a", "S2-1"), ("p", "b", "S2-9"), ("q", "b", "S2-2")], "policy string, s1 string, mid string")
    got = {(r["policy"], r["dimension"], r["value"]): (r["links"], r["recovered"]) for r in ev.policy_slices(sets, links, ["p", "q"], {"cc": F.col("cc"), "source": F.substring("mid", 1, 2)}).collect()}
    assert got["p", "cc", "x"] == (2, 1) and got["q", "cc", "y"] == (1, 1) and got["q", "source", "S3"] == (1, 0) and len(got) == 8
    base = spark.createDataFrame([("a", "S2-1"), ("b", "S2-2")], "s1 string, mid string")
    changes = {r["policy"]: r for r in ev.policy_changes(sets, base, links).collect()}
    assert [changes["p"][c] for c in ("gained_pairs", "gained_links", "lost_pairs", "lost_links", "kept_pairs", "kept_links")] == [1, 0, 1, 1, 1, 1]
    assert [changes["q"][c] for c in ("gained_pairs", "lost_pairs", "kept_links")] == [0, 1, 1]


def test_masks_overlap(spark):
    rows = spark.createDataFrame([("a", 1, 0.9, 1, 2, False), ("a", 0, 0.7, 1, 2, True), ("b", 1, 0.2, 0, 1, False)], "s1 string, y int, score double, pred_n int, truth_n int, address_missing boolean")
    rows = rows.withColumns({"script_conflict": F.lit(False), "s2_links": F.lit(1), "s3_links": F.lit(0), "v": F.col("score")})
    got = {r["mask"]: (r["pairs"], r["entities"], r["p50"]) for r in ev.mask_distributions(rows, ev.error_masks(F.col("score") < 0.5), ["v"]).collect()}
    assert got["A_strong_missed"] == (1, 1, 0.2) and got["B_all_wrong"] == (1, 1, 0.7) and got["C_right"] == (1, 1, 0.9)
    assert got["E_underpredicted"][:2] == (3, 2) and got["G_address_missing"][:2] == (1, 1) and got["I_S2_only"][:2] == (3, 2)
    assert "B_similar_wrong" not in got and "J_S3_only" not in got


def test_bootstrap_by_values(spark):
    """Grouping entities by their value leaves the interval what it is for entities."""
    rows = spark.range(2000).select(F.col("id").cast("string").alias("s1"), (F.col("id") % 3 / 2).alias("v"))
    got = ev.bootstrap_interval(rows, F.col("v"), 1000).first()
    low, high = ev.bootstrap(np.array([i % 3 / 2 for i in range(2000)]), 1000)
    assert abs(got["mean"] - 0.49975) < 1e-3 and abs(got["low"] - low) < 0.004 and abs(got["high"] - high) < 0.004
    assert ev.bootstrap_interval(rows.limit(0), F.col("v")).first()["mean"] is None
