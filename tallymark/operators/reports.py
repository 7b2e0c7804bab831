"""The tables behind a report, and its pages."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics

# Names of metrics as a reader sees them.
TITLES = {
    "exact": "Exact match", "exact_compare": "Normalised match", "threshold": "Threshold", "text_similarity": "Text similarity", "comparator": "Comparator",
    "llm": "Judge", "embedding": "Embedding similarity", "text": "Text equality", "list_greedy_f1": "List, best pairs", "list_ordered_f1": "List, in order", "list_aligned_f1": "List, aligned",
}


def metric_title(metric: Column, params: Column | None = None) -> Column:
    """A metric's name for a reader, with its parameters (a map) in brackets."""
    table = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    name = F.coalesce(F.try_element_at(table, metric), F.when(metric.startswith("agg:"), F.concat(F.lit("Object, "), F.substring_index(metric, ":", -1))), metric)
    if params is None:
        return name
    told = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.when(F.coalesce(F.size(params), F.lit(0)) > 0, F.concat(name, F.lit(" ("), told, F.lit(")"))).otherwise(name)


def chart_rows(table: DataFrame) -> DataFrame:
    """``model, ordinal`` and measures as a chart shows them, half-even rounded: accuracy in
    percent to 2, costs to 6, times to 3 places. Models come by cost, those without last."""
    out = table.select(
        "model", F.bround(100 * F.col("accuracy"), 2).alias("accuracy"), F.bround(100 * F.col("average_score"), 2).alias("score"), F.bround("total_cost", 6).alias("total_cost"),
        F.bround("average_cost", 6).alias("average_cost"), F.bround("total_time", 3).alias("total_time"), F.bround("average_time", 3).alias("average_time"),
    )
    return out.orderBy(F.asc_nulls_last("total_cost"), "model")


def field_scores(fields: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each model and field in percent to 2 places."""
    return fields.select("model", "field", *[F.bround(100 * F.col(c), 2).alias(c) for c in ("precision", "recall", "f1")])


def field_best(fields: DataFrame, by: str = "field") -> DataFrame:
    """The greatest precision, recall and F1 of each field over all models."""
    return fields.groupBy(by).agg(*[F.max(c).alias(f"best_{c}") for c in ("precision", "recall", "f1")])


def field_names(fields: DataFrame) -> DataFrame:
    return fields.select("field").distinct().orderBy("field")


def field_tree(fields: DataFrame, metric: str | None = None) -> DataFrame:
    """``path, parent, name, depth, leaf`` and, with ``metric``, ``method``: every prefix of the
    dotted fields once; the method of a node is that of its fields if they have one only."""
    parts = F.split("field", r"\.")
    extra = [] if metric is None else [F.col(metric).alias("_m")]
    prefixes = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.struct(F.array_join(F.slice("_p", F.lit(1), i), ".").alias("path"), F.array_join(F.slice("_p", F.lit(1), i - 1), ".").alias("parent"), F.element_at("_p", i).alias("name"), i.alias("depth"), (i == F.size("_p")).alias("leaf")))
    rows = fields.withColumn("_p", parts).select(F.explode(prefixes).alias("n"), *extra).select("n.*", *extra and ["_m"])
    method = [] if metric is None else [F.when(F.countDistinct(F.when(F.col("leaf"), F.col("_m"))) == 1, F.min(F.when(F.col("leaf"), F.col("_m")))).alias("method")]
    return rows.groupBy("path").agg(F.min("parent").alias("parent"), F.min("name").alias("name"), F.min("depth").alias("depth"), F.bool_or("leaf").alias("leaf"), *method)


def document_details(preds: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """``document_id, content, expected_value, results``: what every model said of a document,
    by model; the first expected value by model counts. A document has as many results as
    there are models, so its list is as long as the run has models."""
    order = F.col("model")
    rows = preds.groupBy("document_id").agg(
        F.min_by("expected_value", F.when(F.col("expected_value").isNotNull(), order)).alias("expected_value"),
        F.array_sort(F.collect_list(F.struct("model", "predicted_value", "is_correct", "example_score", "llm_cost", "response_time"))).alias("results"),
    )
    if docs is None:
        return rows.select("document_id", F.lit(None).cast("string").alias("content"), "expected_value", "results")
    known = docs.select(F.col("id").alias("document_id"), "content").dropDuplicates(["document_id"])
    return rows.join(known, "document_id", "left").select("document_id", "content", "expected_value", "results")


def recommended(table: DataFrame, text: str) -> str | None:
    """The first model by cost that a recommendation names; None if it names none."""
    hit = table.where(F.instr(F.lit(text), F.col("model")) > 0).orderBy(F.asc_nulls_last("total_cost"), "model").select("model").first()
    return hit[0] if hit else None


def summary(table: DataFrame, fields: DataFrame | None = None) -> list[str]:
    """Lines for a console: a model's accuracy, score, cost and time, then its fields. Models and
    fields are those of a configuration, not data."""
    show = lambda x, p: "-" if x is None else f"{x:.{p}f}"
    lines = [f"{r.model}: accuracy {show(r.accuracy, 2)} %, score {show(r.score, 2)} %, cost {show(r.total_cost, 6)}, time {show(r.total_time, 3)} s" for r in chart_rows(table).toLocalIterator()]
    if fields is not None:
        lines += [f"{r.model} {r.field}: precision {show(r.precision, 2)} %, recall {show(r.recall, 2)} %" for r in field_scores(fields).orderBy("model", "field").toLocalIterator()]
    return lines


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file on any file system that Spark knows; it appears whole or not at all."""
    jvm = spark.sparkContext._jvm
    to, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".part"))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    fs.delete(to, False)
    fs.rename(part, to)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, None if there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def page(preds: DataFrame, fields: DataFrame | None = None, recommendation: str = "") -> str:
    """One HTML page: metrics of each model by cost, best values, fields, times. Only aggregates
    reach the driver."""
    table = metrics.model_metrics(preds)
    parts = [("Models", chart_rows(table)), ("Best", metrics.best_models(table)), ("Response time", metrics.histogram(preds, "response_time").orderBy("model", "bin"))]
    if fields is not None:
        parts += [("Fields", field_scores(fields).orderBy("field", "model")), ("Best of each field", field_best(fields).orderBy("field"))]
    body = "".join(f"<h2>{html.escape(t)}</h2>{d.toPandas().to_html(index=False)}" for t, d in parts)
    advice = f"<p>{html.escape(recommendation)}</p>" if recommendation else ""
    return f"<!doctype html><meta charset=utf-8><title>Evaluation</title><h1>Evaluation</h1>{advice}{body}"


def bars(table: DataFrame) -> DataFrame:
    """``measure, model, value, share`` of the bar charts: accuracy, total cost and total time,
    and each as a share of the greatest."""
    rows = chart_rows(table)
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("accuracy", "total_cost", "total_time")])
    flat = rows.select("model", F.explode(each).alias("r")).select("r.measure", "model", "r.value")
    most = flat.groupBy("measure").agg(F.max("value").alias("_top"))
    return flat.join(most, "measure").select("measure", "model", "value", F.when(F.col("_top") > 0, F.col("value") / F.col("_top")).otherwise(0.0).alias("share"))
