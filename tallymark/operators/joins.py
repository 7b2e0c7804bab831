"""Joins of documents, labels, models and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_label(labels: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One label for each document: the last in the given order."""
    return labels.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def labelled(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Documents that have a label; the others are dropped."""
    return docs.join(labels, key)


def remaining(docs: DataFrame, models: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Every document for every model that has no finished prediction yet.

    The result is as large as the run, so the models are gathered to one array and exploded
    beside each document: it is spread by documents, not by models.
    """
    names = models.select("model").distinct().agg(F.array_sort(F.collect_list("model")).alias("_all"))
    every = docs.select(key).join(F.broadcast(names)).select(key, F.explode("_all").alias("model"))
    return every.join(done.select(key, "model").distinct(), [key, "model"], "left_anti")


def models_without_results(models: DataFrame, preds: DataFrame) -> DataFrame:
    return models.select("model").distinct().join(preds.select("model").distinct(), "model", "left_anti")


def relabel(preds: DataFrame, labels: DataFrame, key: str, value: str) -> DataFrame:
    """``expected_value`` replaced where a new label is known, others kept."""
    new = labels.select(key, F.col(value).alias("_new"), F.lit(True).alias("_hit"))
    return preds.join(new, key, "left").withColumn("expected_value", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("expected_value"))).drop("_new", "_hit")


def unknown_labels(preds: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Labels of documents that have no prediction."""
    return labels.join(preds.select(key).distinct(), key, "left_anti")


def reapply_rates(preds: DataFrame, imputed: Column, rate: Column | None = None) -> DataFrame:
    """``llm_cost`` by a given rate; else imputed for models all of whose costs are 0.

    Which models those are is an aggregate, so no model's rows are gathered in one task.
    """
    free = preds.groupBy(F.col("model").alias("_m")).agg(F.bool_and(F.coalesce(F.col("llm_cost") == 0, F.lit(True))).alias("_free"))
    joined = preds.join(free, preds["model"].eqNullSafe(free["_m"]), "left")
    own = F.when(F.col("_free"), imputed).otherwise(F.col("llm_cost"))
    return joined.withColumn("new_cost", own if rate is None else F.coalesce(rate, own)).drop("_m", "_free")


def valid_staging(rows: DataFrame, wanted: DataFrame, key: str, hash_: str, order: list[Column]) -> DataFrame:
    """Cached rows whose hash is the one wanted now, the last one written of each document
    and model; rows of failed predictions are no results."""
    ok = rows.where(~F.coalesce(F.col("predicted_value").startswith("ERROR:"), F.lit(False))).join(wanted.select(key, hash_).distinct(), [key, hash_], "left_semi")
    return ok.withColumn("_r", F.row_number().over(Window.partitionBy("model", key).orderBy(*order))).where("_r = 1").drop("_r")


def zip_lists(a: Column, b: Column) -> Column:
    """Structs ``a, b`` of the items of two lists by position, nulls beyond the shorter one."""
    none = F.expr("array()")
    return F.zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def nearest_library(imports: DataFrame, patterns: DataFrame) -> DataFrame:
    """First pattern whose library is the imported name or a prefix of its dotted path.

    An equi-join on every dotted prefix takes the place of a nested-loop join.
    """
    parts = F.split("library", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    hit = imports.withColumn("_p", F.explode(prefixes)).join(patterns.withColumnRenamed("library", "_p"), "_p")
    first = Window.partitionBy("file", "library").orderBy("ordinal")
    return hit.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_p")


def documents_of(preds: DataFrame, docs: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``preds`` with the content of their documents, null where a document is unknown."""
    return preds.drop(content).join(docs.select(key, content).dropDuplicates([key]), key, "left")
