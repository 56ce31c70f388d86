"""Registered queries against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each family; the comparison of all of them takes several minutes.
CHECKED = [
    "normalize_keys",
    "suffix_strip_acronym",
    "evidence_rank",
    "heavy_cap",
    "policy_union",
    "retrieval_loss",
    "address4_pass",
    "acronym_pass",
    "sister_multi",
    "one_hop_expand",
    "pair_features_length",
    "pair_features_address",
    "weighted_jaccard",
    "cross_anchor",
    "neg_sample_mixed",
    "inner_split",
    "expected_set",
    "f05_by_country",
    "candidate_audit",
    "feature_stats",
    "heavy_union",
    "link_diagnostics",
    "policy_changes",
    "error_masks",
    "threshold_search",
    "gt_integrity_planted",
    "submission_check_planted",
    "feature_audit_planted",
    "normalize_keys_unicode",
    "grouped_holdout",
    "postal_numeric_pass",
    "sister_sorted_name",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", CHECKED)
def test_like_duckdb(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(plain(r[c]) for c in want.columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"s1", "matched", "n"}


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
