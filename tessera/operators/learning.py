"""Training and calibration of pair models with ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# The thresholds that a utility model chooses from.
UTILITY_THRESHOLDS = (0.15, 0.25, 0.35, 0.45, 0.55, 0.61, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.98, 1.01)


def _assembled(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="error")


def numeric(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in columns})


def class_weights(rows: DataFrame, label: str = "y") -> DataFrame:
    """``weight``: both classes weigh the same in total."""
    counts = rows.agg(F.count("*").alias("n"), F.sum(label).alias("k")).first()
    up, down = counts["n"] / (2 * max(counts["k"] or 0, 1)), counts["n"] / (2 * max(counts["n"] - (counts["k"] or 0), 1))
    return rows.withColumn("weight", F.when(F.col(label) == 1, up).otherwise(down))


def entity_weights(rows: DataFrame) -> DataFrame:
    """``weight``: every s1 weighs the same in total."""
    return rows.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("s1")))


def fit_logistic(rows: DataFrame, columns: list[str], label: str = "y"):
    """Standardised logistic regression on (weighted) pairs."""
    stages = [_assembled(columns), StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol=label, weightCol="weight", maxIter=50, regParam=1e-4)]
    model = Pipeline(stages=stages).fit(class_weights(numeric(rows, columns), label))
    # Scoring ships the model to executors, and its training summary holds the session, which
    # cannot be serialised once a query of it has been observed.
    model.stages[-1]._java_obj.setSummary(rows.sparkSession._jvm.scala.Option.empty())
    return model


def fit_trees(rows: DataFrame, columns: list[str], label: str = "y", depth: int = 5, rounds: int = 20, seed: int = 42):
    """Gradient-boosted trees on (weighted) pairs."""
    trees = GBTClassifier(featuresCol="x", labelCol=label, weightCol="weight", maxDepth=depth, maxIter=rounds, seed=seed)
    return Pipeline(stages=[_assembled(columns), trees]).fit(class_weights(numeric(rows, columns), label))


def scored_by(model, rows: DataFrame, columns: list[str], name: str = "score") -> DataFrame:
    """Rows with the model's probability of a link."""
    out = model.transform(numeric(rows, columns))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("x", "z", "rawPrediction", "probability", "prediction")


def fit_platt(rows: DataFrame, score: str = "score", label: str = "y") -> tuple[float, float]:
    """Coefficient and intercept of a logistic curve on the logit of a score."""
    from tessera.operators.decision import logit

    assembled = _assembled(["l"]).transform(rows.withColumn("l", logit(F.col(score))))
    model = LogisticRegression(featuresCol="x", labelCol=label).fit(assembled)
    return float(model.coefficients[0]), float(model.intercept)


def fit_isotonic(rows: DataFrame, score: str = "score", label: str = "y") -> tuple[list[float], list[float]]:
    """Boundaries and values of a monotone calibration."""
    model = IsotonicRegression(featuresCol=score, labelCol=label).fit(rows.withColumn(label, F.col(label).cast("double")))
    return [float(v) for v in model.boundaries], [float(v) for v in model.predictions]


def fit_utility(summaries: DataFrame, columns: list[str], utilities: list[str], depth: int = 4, trees: int = 20, seed: int = 42) -> list:
    """A forest per threshold choice that predicts an entity's utility."""
    data = _assembled(columns).transform(numeric(summaries, columns))
    return [RandomForestRegressor(featuresCol="x", labelCol=u, maxDepth=depth, numTrees=trees, seed=seed, predictionCol=f"u_{u}").fit(data) for u in utilities]


def fit_residual(rows: DataFrame, columns: list[str], score: str = "score", label: str = "y", depth: int = 3, rounds: int = 10, seed: int = 42):
    """Boosted trees for what a score misses, to be added on the logit scale.

    The target is the first step of boosting from the score: (y - p) / (p (1 - p)), held
    within 4.
    """
    p = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col(score)))
    step = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), (F.col(label) - p) / (p * (1 - p))))
    trees = GBTRegressor(featuresCol="x", labelCol="step", predictionCol="margin", maxDepth=depth, maxIter=rounds, stepSize=0.1, seed=seed)
    return Pipeline(stages=[_assembled(columns), trees]).fit(numeric(rows, columns).withColumn("step", step))


def residual_margin(model, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the ``margin`` of a fitted residual model."""
    return model.transform(numeric(rows, columns)).drop("x")


def chosen_threshold(models: list, summaries: DataFrame, columns: list[str], thresholds: list[float]) -> DataFrame:
    """s1, threshold: the choice of greatest predicted utility, the first on a tie."""
    rows = _assembled(columns).transform(numeric(summaries, columns))
    for model in models:
        rows = model.transform(rows)
    names = [m.getPredictionCol() for m in models]
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    pick = F.lit(thresholds[-1])
    for name, t in reversed(list(zip(names, thresholds))):
        pick = F.when(F.col(name) == best, t).otherwise(pick)
    return rows.select("s1", pick.alias("threshold"))


def simplest_within(results: list[tuple[str, float, float]], margin: float = 0.001) -> str:
    """Of (name, quality, cost) the cheapest that is within ``margin`` of the best quality."""
    best = max(quality for _, quality, _ in results)
    return min((r for r in results if r[1] >= best - margin), key=lambda r: (r[2], -r[1], r[0]))[0]


def early_stop(qualities: list[float], patience: int = 3) -> int:
    """The round to keep when quality (macro F0.5 of a round) no longer rises."""
    best = 0
    for i, quality in enumerate(qualities):
        if quality > qualities[best]:
            best = i
        elif i - best >= patience:
            break
    return best
