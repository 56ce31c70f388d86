import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import learning
from tessera.plans import registry

COLUMNS = ["a", "b"]


@pytest.fixture
def observed(spark):
    """The session after an observed query, as operators that count what they write leave it."""
    spark.range(3).observe(Observation(), F.count(F.lit(1)).alias("n")).collect()
    return spark


@pytest.fixture
def pairs(observed):
    return observed.range(300).selectExpr("id", "id % 7 AS a", "id % 5 = 2 AS b", "CAST(id % 7 + id % 3 > 5 AS int) AS y")


def test_logistic_scores_after_an_observed_query(pairs):
    model = learning.fit_logistic(pairs, COLUMNS)
    rows = learning.scored_by(model, pairs, COLUMNS).orderBy("id").collect()
    _, scaler, linear = model.stages
    x = np.array([[r[c] for c in COLUMNS] for r in rows], dtype=float)
    z = (x - scaler.mean.toArray()) / scaler.std.toArray() @ linear.coefficients.toArray() + linear.intercept
    assert len(rows) == 300
    assert [r["score"] for r in rows] == pytest.approx(list(1 / (1 + np.exp(-z))))
    assert np.mean([r["score"] for r in rows if r["y"]]) > 0.6 > 0.4 > np.mean([r["score"] for r in rows if not r["y"]])


def test_platt_and_trees_after_an_observed_query(pairs):
    scored = learning.scored_by(learning.fit_logistic(pairs, COLUMNS), pairs, COLUMNS, "linear")
    a, b = learning.fit_platt(scored, "linear")
    both = learning.scored_by(learning.fit_trees(pairs, COLUMNS, depth=2, rounds=2), scored, COLUMNS, "trees")
    assert a > 0 and np.isfinite(b)
    assert both.filter("linear BETWEEN 0 AND 1 AND trees BETWEEN 0 AND 1").count() == 300


def test_ml_train_score_after_an_observed_query(observed):
    sf = "/root/testdata/sf0.001"
    rows = registry.QUERIES["ml_train_score"](observed, sf).collect()
    want = {(r["s1"], r["mid"]) for r in registry.QUERIES["policy_union"](observed, sf).select("s1", "mid").collect()}
    assert len(rows) == len(want) and {(r["s1"], r["mid"]) for r in rows} == want
    assert {r["y"] for r in rows} == {0, 1}
    assert all(0 <= r[c] <= 1 for r in rows for c in ("linear", "trees", "calibrated", "ensemble"))
    assert all(r["ensemble"] == pytest.approx((r["linear"] + r["trees"]) / 2, abs=2e-6) for r in rows)
