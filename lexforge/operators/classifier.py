"""Tabular classification: alphabetical label codes and a random forest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.session import cut


def pipeline(features: list[str], label: str, trees: int = 10, depth: int = 5, labels: list[str] | None = None) -> Pipeline:
    """Encode categories (unseen ones get a code of their own), assemble, train."""
    coded = [f"{f}_code" for f in features]
    stages = [
        StringIndexer(inputCols=features, outputCols=coded, stringOrderType="alphabetAsc", handleInvalid="keep"),
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        VectorAssembler(inputCols=coded, outputCol="features"),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=512, seed=42),
    ]
    return Pipeline(stages=stages)


def cross_checked(part: DataFrame, features: list[str], label: str) -> DataFrame:
    """Confusion counts (label, predicted, n) on a held-out fifth of parts, by size band."""
    band = F.when(F.col("p_size") <= 16, "small").when(F.col("p_size") <= 33, "medium").otherwise("large")
    rows = part.withColumn(label, band)
    fold = F.pmod(F.xxhash64("p_partkey"), F.lit(5))
    train, test = rows.where(fold != 0), rows.where(fold == 0)
    model = pipeline(features, label).fit(train)
    names = model.stages[1].labels
    predicted = IndexToString(inputCol="prediction", outputCol="predicted", labels=names).transform(model.transform(test))
    return predicted.groupBy(F.col(label).alias("label"), "predicted").agg(F.count(F.lit(1)).alias("n"))


# --- training with a grid, cross-validation and importances by name ---

GRID = {"maxDepth": [4, 8], "numTrees": [10, 30], "minInstancesPerNode": [1]}


@dataclass(frozen=True)
class Trained:
    """A fitted pipeline, the names of its classes, its features by importance, what the grid found, and test metrics."""

    model: PipelineModel
    classes: list[str]
    importances: list[tuple[str, float]]
    chosen: dict
    cv_mean: float
    cv_std: float
    test: DataFrame


def held_out(key: str, label: str, share: int = 20) -> Column:
    """Whether a row is of the test share (in a hundred), by a hash of its key and class, so each class gives its share."""
    return F.pmod(F.xxhash64(key, label, F.lit(42)), F.lit(100)) < share


def train(rows: DataFrame, key: str, features: list[str], label: str, grid: dict | None = None, folds: int = 3) -> Trained:
    """Fit a forest on four fifths of each class; each combination of ``grid`` is tried on ``folds`` folds, in parallel.

    Features are categories (nulls are one of their own, unseen ones too), the label a string; rows without label teach
    nothing. The best combination by mean accuracy is fitted again on all folds; ``test`` has the other fifth with
    ``predicted`` and ``confidence``.
    """
    clean = rows.where(F.col(label).isNotNull()).select(key, F.col(label).alias("_class"), *[F.coalesce(F.col(f).cast("string"), F.lit("(none)")).alias(f) for f in features])
    clean = cut(clean.withColumn("_test", held_out(key, "_class")).withColumn("_fold", F.pmod(F.xxhash64(F.lit(7), key), F.lit(folds)).cast("int")))
    coder = Pipeline(stages=pipeline(features, "_class").getStages()[:3]).fit(clean.where("not _test"))
    known = cut(coder.transform(clean).select(key, "_class", "label", "features", "_test", "_fold"))
    forest = RandomForestClassifier(maxBins=4096, seed=42)
    combos = ParamGridBuilder()
    for name, values in (grid or GRID).items():
        combos = combos.addGrid(forest.getParam(name), values)
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    tuned = CrossValidator(estimator=forest, estimatorParamMaps=combos.build(), evaluator=judge, numFolds=folds, foldCol="_fold", parallelism=4, seed=42).fit(known.where("not _test"))
    best = max(range(len(tuned.avgMetrics)), key=lambda i: tuned.avgMetrics[i])
    weights = sorted(zip(features, tuned.bestModel.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
    classes = coder.stages[1].labels
    model = PipelineModel(stages=[coder.stages[0], coder.stages[2], tuned.bestModel])
    told = predict(tuned.bestModel, classes, known.where("_test")).select(key, F.col("_class").alias("label"), "predicted", "confidence")
    return Trained(model, classes, weights, {p.name: v for p, v in tuned.getEstimatorParamMaps()[best].items()}, tuned.avgMetrics[best], tuned.stdMetrics[best], told)


def predict(forest, classes: list[str], rows: DataFrame) -> DataFrame:
    """Adds predicted, the name of the likeliest class, and confidence, its probability."""
    said = IndexToString(inputCol="prediction", outputCol="predicted", labels=classes).transform(forest.transform(rows))
    return said.withColumn("confidence", F.array_max(vector_to_array("probability")))


def explained(predicted: DataFrame, trained: Trained, texts: dict[str, str], other: str, top: int = 3) -> DataFrame:
    """Adds explanation: the text of the predicted class, how sure it is, and the ``top`` features by importance."""
    told = F.lit(other)
    for name, text in texts.items():
        told = F.when(F.col("predicted") == name, text).otherwise(told)
    names = ", ".join(f for f, _ in trained.importances[:top])
    return predicted.withColumn("explanation", F.concat(told, F.format_string(" (confidence: %.0f%%). Key factors: ", F.col("confidence") * 100), F.lit(names), F.lit(".")))
