"""A local text classifier by pyspark.ml, trained and run where the data lies."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics

#: Labelled rows that a model is fitted on at most, a random choice.
FIT_ROWS = 200_000


def train(labelled: DataFrame, text: str = "content", label: str = "label", features: int = 1 << 15, iterations: int = 20, rows: int = FIT_ROWS) -> PipelineModel:
    """Of rows with a text and a label; at least two labels are needed. Beyond ``rows`` a random
    part of about that size is fitted on."""
    known = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("_text"), F.col(label).alias("_label"))
    n = known.count()
    used = known.sample(rows / n, seed=42) if n > rows else known
    index = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(used)
    if len(index.labels) < 2:
        raise ValueError("a classifier needs two labels at least")
    steps = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=iterations, regParam=0.01), IndexToString(inputCol="_p", outputCol="predicted_value", labels=index.labels),
    ]
    return Pipeline(stages=[index.setHandleInvalid("keep"), *steps]).fit(used)


def classify(docs: DataFrame, model: PipelineModel, text: str = "content") -> DataFrame:
    """``docs`` with ``predicted_value``; a null text is taken as empty."""
    rows = docs.drop("predicted_value").withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    flow = PipelineModel(model.stages[1:])
    return flow.transform(rows).drop("_text", "_words", "_tf", "_x", "rawPrediction", "probability", "_p")


def evaluate(scored: DataFrame, label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support of each class of a classified table."""
    return metrics.classification_report(scored, label, "predicted_value")


def predictions(docs: DataFrame, model: PipelineModel, name: str, text: str = "content", label: str = "label") -> DataFrame:
    """As rows of predictions: free of cost, correct where the score is 1 (case-sensitive)."""
    out = classify(docs, model, text)
    same = F.coalesce(F.col("predicted_value") == F.col(label), F.lit(False))
    return out.select(F.col("id").alias("document_id"), F.lit(name).alias("model"), "predicted_value", F.col(label).alias("expected_value"), same.alias("is_correct"), same.cast("double").alias("example_score"), F.lit(0.0).alias("llm_cost"), F.lit(0.0).alias("response_time"))
